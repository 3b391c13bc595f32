"""Invertible sketches against plain bags of paragraphs."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellpulse.llm import fingerprints
from tests.llm.frames import TEXTS, documents


def bag(text):
    return Counter(m.group() for m in re.finditer(fingerprints.PARAGRAPH, text))


def likeness(a, b):
    x, y = bag(a), bag(b)
    d, both = sum(((x - y) + (y - x)).values()), x.total() + y.total()
    return 1.0 if not both else (both - d) / (both + d)


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def prose(rng, n):
    return "".join(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(4, 30))) + rng.choice([". ", ".\n", "\n\n", "! ", " "]) for _ in range(n))


def check(rows, got):
    assert len(got) == len(rows)
    order = [t or "" for _, t in sorted(rows, key=lambda r: -r[0])]
    follows = dict(zip(sorted((i for i, _ in rows), reverse=True), order[1:] + order[:1], strict=True))
    texts = {i: t or "" for i, t in rows}
    prints = {}
    for r in got:
        text, following = texts[r.doc_id], follows[r.doc_id]
        new = edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, new)) and r.near_next == pytest.approx(likeness(text, following))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint


def test_equals_plain_bags(spark):
    """Small and large differences, repeats, empty texts, one very long text, more rows than a bucket."""
    rng = random.Random(4)
    rows = [(3 * i, prose(rng, rng.choice([0, 1, 5, 40]))) for i in range(700)]
    rows += [(5_000 + i, rows[i][1]) for i in range(60)] + [(9_000, None), (9_001, ""), (9_002, "same line\n" * 300), (9_003, "x" * 200_000), (9_004, prose(rng, 3_000))]
    check(rows, fingerprints.compare(documents(spark, rows)).collect())


def test_small_sketches_are_retried(spark):
    """A table of three rows with six cells: everything but equal pairs needs a larger sketch."""
    rng = random.Random(6)
    base = prose(rng, 60)
    rows = [(1, base), (2, base + prose(rng, 20)), (3, base)]
    check(rows, fingerprints.compare(documents(spark, rows), cells=6).collect())


def test_peeling_recovers_digests_with_counts(spark):
    one, two = Counter({11: 2, 12: 1, -13: 1, 14: 5}), Counter({12: 1, 14: 2, 15: 1})
    rows = [(1, 60, 0, sign, d) for c, sign in ((one, 1), (two, -1)) for d in c.elements()]
    parts = spark.createDataFrame(rows, "k int, size long, seed int, sign long, digest long")
    got = {r.digest: r.n for r in fingerprints.peel(fingerprints.sketch_cells(parts, ["k"]), ["k"]).collect()}
    mask = lambda d: ((d % 2**64) >> 33 << 33) | ((d % 2**64) & fingerprints.HALF)
    want = {mask(d): one[d] - two[d] for d in one | two if one[d] != two[d]}
    assert {k % 2**64: n for k, n in got.items()} == want


def test_defined_cases(spark):
    got = fingerprints.compare(documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in TEXTS)
    assert [r.near_next for r in fingerprints.compare(documents(spark, [(7, "alone")])).collect()] == [1.0]
    assert fingerprints.compare(documents(spark, [])).collect() == []


def test_paragraphs_add_up_to_the_text(spark):
    texts = ["", "\n\na\n", "No end here " * 60, "One. Two! Three?\nFour é日😀. " * 30]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = frame.select("t", F.regexp_extract_all("t", F.lit(fingerprints.PARAGRAPH), F.lit(0)).alias("p")).collect()
    assert all("".join(r.p) == r.t for r in cut)
