"""Blocked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cellpulse.llm import lexical
from tests.llm.frames import TEXTS, documents


def words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, total = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        asked = Counter(words(text))
        scored = []
        for i, c in bags:
            m = 25 + (75 * c.total() * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if s:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=1):
    """Words of very different frequency, groups of copies, planted passages, ties."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    draw = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(800)], k=n))
    items = [(i, f"{draw(20)}. {draw(12)}!") for i in range(25)]
    rows = [(i, draw(rng.choice([0, 3, 30, 200]))) for i in range(600)]
    rows += [(1_000 + i, f"{draw(20)} {items[i % 25][1]} {draw(10)}") for i in range(60)]
    rows += [(2_000 + i, rows[5][1] + " the same tail w700 w701") for i in range(300)] + [(3_000, None), (3_001, "Straße É w1-W2_w3"), (None, items[0][1]), (7, "a repeated id w5")]
    items += [(90, ""), (91, None), (92, "nothing here"), (93, "W1 w1 w1 w700"), (94, "straße é"), (95, draw(400))]
    return rows, items


@pytest.mark.parametrize(("segment", "block", "chars"), [(lexical.SEGMENT, lexical.BLOCK, lexical.QUERY_CHARS), (40, 4, lexical.QUERY_CHARS), (200, 16, 900)])
def test_equals_scoring_everything(spark, segment, block, chars):
    rows, items = corpus()
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(documents(spark, rows), asked, segment=segment, block=block, query_chars=chars)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, items)


def test_segments_hold_about_as_many_documents_as_asked_for(spark):
    rows, items = corpus()
    vocabulary = {t: i for i, t in enumerate(sorted({w.encode() for _, t in items for w in words(t)}))}
    index, _, _ = lexical.build(documents(spark, rows), vocabulary, segment=64)
    sizes = [len(r.doc_ids) for r in index.select("doc_ids").collect()]
    assert max(sizes) <= 2 * 64 and sum(sizes) >= 600


def test_bounds_hold_and_skip(spark):
    """Every summary is the maximum of its block, and most blocks of frequent terms are never opened."""
    rows, items = corpus()
    vocabulary = {t: i for i, t in enumerate(sorted({w.encode() for _, t in items for w in words(t)}))}
    index, numbers, weights = lexical.build(documents(spark, rows), vocabulary, block=4)
    for r in index.collect():
        a = {c: np.array(r[c]) for c in lexical.ARRAYS}
        for t, first, until in zip(a["list_terms"], a["list_ptr"][:-1], a["list_ptr"][1:], strict=True):
            for b in range(first, until):
                best = Counter()
                for row in a["block_docs"][a["block_ptr"][b] : a["block_ptr"][b + 1]]:
                    for e in range(a["row_ptr"][row], a["row_ptr"][row + 1]):
                        if a["terms"][e] >= t:
                            best[a["terms"][e]] = max(best[a["terms"][e]], a["impacts"][e])
                s = slice(a["summary_ptr"][b], a["summary_ptr"][b + 1])
                assert best[t] and dict(zip(a["summary_terms"][s].tolist(), a["summary_max"][s].tolist(), strict=True)) == dict(best)


def test_defined_cases(spark):
    asked = spark.createDataFrame([(1, "one two token"), (2, None)], "item_id long, text string")
    got = lexical.search(documents(spark), asked).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(TEXTS, [(1, "one two token"), (2, None)])
    assert lexical.search(documents(spark, []), asked).collect() == []
    assert lexical.search(documents(spark), asked.filter("false")).collect() == []
