"""Near copies by the 0.8 rule on five-word shingles, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from cellpulse.llm import near_copies, simhash
from tests.llm.frames import TEXTS, documents


def plain_set(text):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    first: dict[int, int] = {}
    for (i, _), r in zip(rows, root, strict=True):
        first[r] = min(i, first.get(r, i))
    return set(first.values())


def corpus(seed=3):
    """Strangers that share a common line, a chain of edits, a crowd of near copies, and pairs right at the limit."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3_000)]
    line = "one very common line of nine words in all"
    texts = [f"{line} {' '.join(rng.choices(words, k=rng.randrange(10, 60)))}" for _ in range(150)]
    base = rng.choices(words, k=120)
    for _ in range(80):
        own = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 5)):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    link = rng.choices(words, k=100)
    for k in range(12):
        link = [*link[:k * 7], rng.choice(words), *link[k * 7 + 1:]]
        texts.append(" ".join(link))
    for k in range(30):
        own = rng.choices(words, k=60)
        texts += [" ".join(own), " ".join([*own, *rng.choices(words, k=10 + k % 6)])]
    texts += [texts[0].upper(), "", None, " \n", "x", "X"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("members", "sample", "elements"), [(near_copies.MEMBERS, near_copies.SAMPLE, near_copies.GROUP_ELEMENTS), (11, 40, 200)])
def test_keeps_what_brute_force_keeps(spark, members, sample, elements):
    rows = corpus()
    docs = documents(spark, rows)
    kept = near_copies.keep_one_each(docs, members=members, sample=sample, elements=elements)
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) and set(got) == plain_kept(rows)


def test_the_stage_checks_every_link(spark):
    """Documents with few differing bits and little in common stay; one with many differing bits and much in common goes."""
    rows = corpus(5)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, documents(spark, rows), "").collect()} == plain_kept(rows)


def test_rows_without_an_id_stay(spark):
    rows = [(i, t) for i, t in TEXTS if i != 9]
    got = [r.doc_id for r in near_copies.keep_one_each(documents(spark, rows)).collect()]
    assert got.count(None) == 2 and {i for i in got if i is not None} == plain_kept([(i, t) for i, t in rows if i is not None])
    assert near_copies.keep_one_each(documents(spark, [])).collect() == []


def test_pairs_beyond_seven_bits_go(spark):
    """Similar texts whose fingerprints differ in more than seven bits."""
    rng = random.Random(8)
    rows = []
    while len(rows) < 10:
        one = " ".join(f"w{rng.randrange(3_000)}" for _ in range(60))
        two = f"{one} {' '.join(f'v{rng.randrange(3_000)}' for _ in range(13))}"
        if ((simhash.fingerprint(one, 2, True) ^ simhash.fingerprint(two, 2, True)) % 2**64).bit_count() > 7:
            rows += [(len(rows), one), (len(rows) + 1, two)]
    assert {r.doc_id for r in near_copies.keep_one_each(documents(spark, rows)).collect()} == {0, 2, 4, 6, 8}


def test_tallies_never_tell_more_than_the_difference():
    rng = random.Random(3)
    for n in (1, 40, 300, 3_000):
        for m in (n, n + n // 5, 20 * n):
            one = [rng.getrandbits(60) for _ in range(n)]
            two = one[: n // 2] + [rng.getrandbits(60) for _ in range(m - n // 2)]
            a, b = (near_copies.tally(np.unique(np.array(x, np.int64))).tobytes() for x in (one, two))
            told = near_copies.distance(a, b)
            assert told <= len(set(one) ^ set(two)) and told == near_copies.distance(b, a) and near_copies.distance(a, a) == 0
    packed = np.unique(np.arange(2_000, dtype=np.int64) * 2**20)
    assert near_copies.distance(near_copies.tally(packed).tobytes(), near_copies.tally(packed[:1_999]).tobytes()) <= 1


def test_the_stage_goes_by_fingerprints_first(spark, monkeypatch):
    """SimHash links that the check confirms stand without the search; links between strangers fall."""
    words = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "v"])), (2, "stranger"), (3, "one more stranger")]
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "u long, v long")
    assert [tuple(r) for r in near_copies.checked(documents(spark, rows).select("doc_id", "text"), pairs).collect()] == [(0, 1)]
    proposed = {tuple(r) for r in simhash.proposals(documents(spark, rows)).collect()}
    near = {(a, b) for a in range(4) for b in range(a) if ((simhash.fingerprint(rows[a][1], 4) ^ simhash.fingerprint(rows[b][1], 4)) % 2**64).bit_count() <= 4}
    assert proposed == {(b, a) for a, b in near}
    monkeypatch.setattr(near_copies, "links", lambda *_: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(simhash, "proposals", lambda docs: pairs)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, documents(spark, rows), "").collect()} == {0, 2, 3}


def test_a_refused_link_does_not_hide_the_others_of_its_group(spark, monkeypatch):
    """SimHash gives a spanning forest: two similar texts may hang together by a third only, to which neither is similar."""
    rng = random.Random(5)
    own = rng.choices([f"w{k}" for k in range(900)], k=60)
    rows = [(0, "an entirely other text of some words " * 3), (1, " ".join(own)), (2, " ".join(own[:-1])), (3, " ".join(own))]
    docs = documents(spark, rows)
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "digest long, members array<long>")
    monkeypatch.setattr(near_copies, "candidates", lambda heads, members: none)
    proposed = spark.createDataFrame([(0, 2), (0, 3)], "u long, v long")
    assert {r.doc_id for r in near_copies.keep_one_each(docs, proposed=proposed).collect()} == {0, 1}
