"""Packing, token attribution and sampled segmentations against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cellpulse.llm import packing, sampled_pieces, token_counts
from cellpulse.llm.bpe import encoder
from cellpulse.llm.queries import BYTE_BPE, PIECES
from tests.llm.frames import TEXTS, documents

TRICKY = [*(t or "" for _, t in TEXTS), "a\n\n\n  b\r\n\n \n\tc", "日本語\n😀😀 \n é", " <|endoftext|> x\n", "x\u0085y z  \n", " " * 20_000, "1" * 5_000]


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_those_of_the_tokenizer_file(text):
    enc = encoder(BYTE_BPE)
    assert enc.fast is not None
    ids = enc.ids(text).tolist()
    assert ids == enc.slow.encode(text, add_special_tokens=False).ids
    assert enc.byte_lengths[ids].sum() == len(text.encode())


def test_added_tokens_have_their_own_ids_where_asked_for():
    text = "a <|endoftext|> b"
    plain = Tokenizer.from_file(BYTE_BPE)
    want = plain.encode(text, add_special_tokens=False).ids
    enc = encoder(BYTE_BPE, added=True)
    assert enc.ids(text).tolist() == want and 50256 in want and 50256 not in encoder(BYTE_BPE).ids(text).tolist()
    assert enc.byte_lengths[want].sum() == len(text)


def test_packed_ids_are_those_of_the_contract(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "no such token")]
    plain = Tokenizer.from_file(BYTE_BPE)
    want = {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(documents(spark, rows), BYTE_BPE).collect()} == want


@pytest.mark.parametrize("lengths", [[1], [1024] * 5, list(range(1, 1025)), [341] * 7 + [342] * 6, [700, 300, 24, 500, 524] * 9, [600] * 50])
def test_plan_packs_every_length_once(lengths):
    groups = packing.rounded(dict(Counter(lengths)), 1024)
    assert Counter(x for content, n in groups for x in content for _ in range(n)) == Counter(lengths)
    assert all(sum(content) <= 1024 for content, _ in groups)
    used: dict[int, list[tuple[int, int]]] = defaultdict(list)
    ranks = Counter()
    for length, first, until, sequence, each, offset in packing.rank_ranges(groups):
        assert first == ranks[length]
        ranks[length] = until
        for n in range(until - first):
            used[sequence + n // each].append((offset + n % each * length, length))
    for places in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024


def test_the_program_beats_plain_best_fit():
    """Lengths of which best fit, longest first, wastes much."""
    rng = np.random.default_rng(1)
    histogram = dict(Counter(rng.integers(330, 360, 20_000).tolist()))
    used = sum(n for _, n in packing.rounded(histogram, 1024))
    plain = sum(n for _, n in packing.rounded(histogram, 1024, rounds=0))
    assert used < 0.97 * plain


def check_packed(rows, texts, capacity):
    enc = encoder(BYTE_BPE)
    want = Counter()
    for i, t in texts:
        ids = np.append(enc.ids(t or ""), np.uint32(2)).astype("<u4")
        cuts = packing.cut(len(ids), capacity)
        assert all(n == capacity for _, n in cuts[1:]) and sum(n for _, n in cuts) == len(ids)
        want.update((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return places


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packed_rows(spark, capacity):
    packed = packing.pack(documents(spark), BYTE_BPE, capacity, with_ids=True)
    places = check_packed(packed.collect(), TEXTS, capacity)
    whole = {r.sequence_id: r.input_ids for r in packing.sequences(packed).collect()}
    assert {s: len(x) for s, x in whole.items()} == {s: sum(n for _, n in p) for s, p in places.items()}


def test_empty_tables(spark):
    none = documents(spark, [])
    assert packing.pack(none, BYTE_BPE).collect() == []
    assert token_counts.count_tokens(none, BYTE_BPE).collect() == []
    assert sampled_pieces.sampled(none, PIECES, ["doc_id"]).collect() == []


def plain_counts(text, starts, ends, rule):
    enc = encoder(BYTE_BPE)
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    out, at = np.zeros(len(starts) + 1), 0
    for i in enc.ids(text):
        n = int(enc.byte_lengths[i])
        chars = sorted(set(owner[at : at + n]))
        at += n
        of = [next((s for s in range(len(starts)) if starts[s] <= c < ends[s]), len(starts)) for c in chars]
        if rule == "start":
            out[of[0]] += 1
        elif rule == "most":
            out[min(set(of), key=lambda s: (-of.count(s), s))] += 1
        else:
            for s in of:
                out[s] += 1 / len(of)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    rng = random.Random(3)
    enc, lines = encoder(BYTE_BPE), re.compile(token_counts.LINE)
    for text in TRICKY[:-2]:
        if len(text) > 5_000:
            continue
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 8)))
        odd = (np.array(cuts[:-1:2], np.int64), np.array(cuts[1::2], np.int64))
        for starts, ends in (token_counts.sections_between(text, lines), odd):
            starts = starts[: len(ends)]
            _, first, end = token_counts.token_spans(enc, text)
            got, outside, _ = token_counts.attribute(first, end, starts, ends, rule)
            assert np.allclose([*got, outside], plain_counts(text, starts, ends, rule))


def test_sections_add_up_to_the_document(spark):
    rows = token_counts.count_tokens(documents(spark), BYTE_BPE).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    enc = encoder(BYTE_BPE)
    assert {k for k in by_doc} == {(i, len(enc.ids(t or ""))) for i, t in TEXTS}
    for (i, n), part in by_doc.items():
        copies = sum(k == i and len(enc.ids(t or "")) == n for k, t in TEXTS)
        assert sum(r.n_tokens for r in part) == n * copies


def test_given_spans(spark):
    rows = [(1, "alpha beta gamma", [(6, 10), (11, 13)]), (2, None, None), (3, "x", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.count_tokens(docs, BYTE_BPE, "split", spans_col="spans").collect()}
    assert (3, -1) in got and got[3, -1] == 1 and (2, 0) not in got
    assert 0 < got[1, 0] < 1.5 and got[1, -1] > 0


def test_rule_must_be_known(spark):
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_tokens(documents(spark), BYTE_BPE, "other")


def every(lattice, at=0):
    if at == len(lattice):
        yield (), 0.0
        return
    for end, ids, w in lattice[at]:
        for rest, p in every(lattice, end):
            yield (*ids, *rest), w + p


def test_lattice_probabilities_sum_to_one():
    v = sampled_pieces.vocabulary(PIECES, 0.3)
    for word in ("▁theea", "▁日é", "▁▁▁x", "Ω😀"):
        assert math.isclose(sum(math.exp(p) for _, p in every(v.of(word))), 1, rel_tol=1e-9)


def test_samples_follow_the_distribution():
    """First draws follow the probabilities, and inclusion scores make the sample's estimate of every probability unbiased."""
    v = sampled_pieces.vocabulary(PIECES, 0.3)
    lattices = [v.of("▁the"), v.of("▁an")]
    exact = {a + b: math.exp(p + q) for a, p in every(lattices[0]) for b, q in every(lattices[1])}
    times, first, estimate = 4_000, Counter(), Counter()
    for s in range(times):
        drawn, bound = sampled_pieces.sample(lattices, 3, random.Random(s))
        assert len({tuple(i) for i, _, _ in drawn}) == 3
        assert [g for _, _, g in drawn] == sorted((g for _, _, g in drawn), reverse=True) and bound <= drawn[-1][2]
        first[tuple(drawn[0][0])] += 1
        for ids, p, _ in drawn:
            assert math.isclose(math.exp(p), exact[tuple(ids)], rel_tol=1e-9)
            estimate[tuple(ids)] += math.exp(p) / sampled_pieces.inclusion(p, bound) / times
    for ids, p in exact.items():
        assert abs(first[ids] / times - p) < 5 * math.sqrt(p * (1 - p) / times) + 1e-3
        assert abs(estimate[ids] - p) < 0.05


def test_few_segmentations_are_all_returned():
    v = sampled_pieces.vocabulary(PIECES, 1.0)
    drawn, bound = sampled_pieces.sample([v.of("▁a")], 50, random.Random(0))
    assert len(drawn) == len(list(every(v.of("▁a")))) and bound == -math.inf and sampled_pieces.inclusion(-9.0, bound) == 1
    assert sampled_pieces.sample([], 4, random.Random(0))[0][0][:2] == ([], 0.0)


def test_sampled_rows_decode_to_their_text(spark):
    docs = documents(spark).withColumnRenamed("ids", "other")
    rows = sampled_pieces.sampled(docs, PIECES, ["doc_id", "lang"], k=3).collect()
    texts = defaultdict(set)
    for i, t in TEXTS:
        texts[i].add(t or "")
    assert all(r.decoded in texts[r.doc_id] for r in rows)
    assert {(r.doc_id, r.decoded) for r in rows} == {(i, t or "") for i, t in TEXTS}
    assert len({tuple(r.ids) for r in rows if r.doc_id == 9}) == 3
    again = sampled_pieces.sampled(docs.repartition(3), PIECES, ["doc_id", "lang"], k=3).collect()
    pick = lambda rs: sorted((str(r.doc_id), r.decoded, r["sample"], r.ids) for r in rs)
    assert pick(rows) == pick(again)


def test_plain_round_trip(spark):
    out = sampled_pieces.decoded(sampled_pieces.encoded(documents(spark), PIECES, out_col="own"), PIECES, "own").select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in out) and len(out) == len(TEXTS)
