"""Cross-tokenizer alignment against a version with loops."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cellpulse.llm import alignment
from cellpulse.llm.bpe import byte_alphabet
from tests.llm.frames import documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    alphabet = byte_alphabet()

    def bytes_a(i):
        return bytes(alphabet[c] for c in ta.id_to_token(i))

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    texts, links, holders = [], [], Counter()
    for _, text in rows:
        groups = []
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            joined = [b"".join(map(f, x)) for f, x in ((bytes_a, a), (bytes_b, b))]
            if joined[0] == joined[1] == (" " + text).encode():
                i = j = 0
                while i < len(a):
                    left, right = [a[i]], [b[j]]
                    na, nb, i, j = len(bytes_a(a[i])), len(bytes_b(b[j])), i + 1, j + 1
                    while na != nb:
                        if na < nb:
                            left.append(a[i])
                            na, i = na + len(bytes_a(a[i])), i + 1
                        else:
                            right.append(b[j])
                            nb, j = nb + len(bytes_b(b[j])), j + 1
                    groups.append((left, right))
        texts.append(groups)
        links.append(Counter((x, y) for left, right in groups for x in left for y in right))
        holders.update(links[-1].keys())
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), groups, mine in zip(rows, texts, links, strict=True):
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            -1 if i is None else i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), mine.total(),
            sum(n for p, n in mine.items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in mine.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def test_equals_a_plain_version(spark):
    """Copies, other scripts, runs without a common boundary, special tokens as text, texts that are not spelled by their tokens."""
    rng = random.Random(2)
    words = "the internationalisation of tokenizers é日本語 😀 don't 12345 3.14159 foo_bar naïve Straße ... <s> </s> <unk> <|endoftext|> \t \n  ▁".split(" ")
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300 + i, rows[7][1]) for i in range(3)]
    odd = [None, "", " ", "\n", "  two  spaces  ", "a" * 3_000, " " * 500, "=-" * 400, "한국어" * 200, "٣" * 300, "x\x00y", "▁", "a▁b", "ﬁ", "<|endoftext|>", "<s>"]
    rows += [(400 + i, t) for i, t in enumerate(odd)] + [(None, "without an id"), (5, "a repeated id"), (5, "a repeated id")]
    docs = documents(spark, rows)
    for block_chars in (alignment.BLOCK_CHARS, 800):
        got = alignment.measure(docs, A, B, block_chars=block_chars)
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain(rows)


def test_one_very_long_text(spark):
    text = "some words, again and again; " * 40_000
    got = alignment.measure(documents(spark, [(1, text), (2, text)]), A, B).collect()
    assert {r.doc_id for r in got} == {1, 2} and got[0].n_links > 240_000 and got[0].count_sum == 2 * got[0].n_links


def test_empty_table(spark):
    assert alignment.measure(documents(spark, []), A, B).collect() == []
