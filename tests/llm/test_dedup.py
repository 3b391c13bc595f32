"""Exact and near duplicates against brute force, with the cases the docstrings define."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellpulse.llm import components, exact_dedup, simhash
from tests.llm.frames import TEXTS, documents


def test_exact_groups(spark):
    got = exact_dedup.mark_duplicates(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    by_sha: dict[str, list] = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in TEXTS]
    for text in set(normal):
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        ids = [i for (i, _), t in zip(TEXTS, normal, strict=True) if t == text]
        first = min((i for i in ids if i is not None), default=None)
        assert {r.group_size for r in rows} == {len(ids)} and {r.keep_id for r in rows} == {first}
        assert sum(r.kept for r in rows) == 1 and all(r.doc_id == first for r in rows if r.kept)


def test_exact_keeps_whole_rows(spark):
    docs = documents(spark)
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert kept == sorted([(False, 1), (False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)])


@pytest.mark.parametrize("megabytes", [0, 64])
def test_a_full_filter_changes_nothing(spark, megabytes):
    """With no room at all, one segment takes all bits, and everything is grouped exactly."""
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(40)}") for i in range(300)]
    got = {r.doc_id: r.keep_id for r in exact_dedup.mark_duplicates(documents(spark, rows), max_filter_mb=megabytes).collect()}
    first: dict[str, int] = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in rows}


def test_unique_rows_pass_straight_through(spark):
    rows = exact_dedup._hashed(documents(spark, [(i, f"unique text {i}") for i in range(20_000)]), "doc_id", "text")
    segments = exact_dedup._segments(20_000, 64)
    tested = exact_dedup.with_suspicion(rows, exact_dedup.repeat_filter(rows, segments), segments)
    assert tested.filter("_suspect").count() < 600


def test_native_plan(spark):
    plan = exact_dedup.mark_duplicates(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact_dedup.mark_duplicates(none).collect() == []
    assert exact_dedup.keep_first(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one_each(none).collect() == []


def plain_fingerprint(text, words=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "Ä B", "a b c d", "A b\x0bC d e", "w " * 9_000 + "end", "ÀÉ İ ß x y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "", 4) % 2**64 == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(0)
    for radius in (2, 3, 4, 7):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min((m % 2**64).bit_count() for m in masks) >= 18
        for _ in range(3_000):
            gap = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(gap & m % 2**64 == 0 for m in masks)


def plain_components(values, radius):
    root = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize(("bucket", "radius"), [(2, 4), (5, 4), (4_096, 4), (5, 3), (6, 7)])
def test_links_connect_what_all_pairs_connect(spark, bucket, radius):
    """Chains, dense balls around one point, and strangers; small buckets force the way for crowded ones."""
    rng = random.Random(bucket)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centre, values = rng.getrandbits(64), []
    values += [flip(centre, rng.randint(0, 3)) for _ in range(60)]
    at = rng.getrandbits(64)
    for _ in range(30):
        values.append(at := flip(at, rng.choice((1, 4, 5))))
    values = sorted({v - 2**64 if v >= 2**63 else v for v in [*values, *(rng.getrandbits(64) for _ in range(40))]})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, bucket)
    number = {v: k for k, v in enumerate(values)}
    pairs = [(number[r.u], number[r.v]) for r in edges.collect()]
    assert all((values[a] ^ values[b]) % 2**64 and ((values[a] ^ values[b]) % 2**64).bit_count() <= radius for a, b in pairs)
    root = list(range(len(values)))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert root == plain_components([v % 2**64 for v in values], radius)


def test_near_duplicate_rows(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    values = [plain_fingerprint(t) for _, t in TEXTS]
    assert sorted(r.fingerprint for r in got) == sorted(f"{v:016x}" for v in values)
    for (i, t), v in zip(TEXTS, values, strict=True):
        near = [k for (k, _), w in zip(TEXTS, values, strict=True) if (v ^ w).bit_count() <= 4]
        want = min((k for k in near if k is not None), default=None)
        assert {r.component_id for r in got if r.doc_id == i and r.fingerprint == f"{v:016x}"} == {want}, t
    kept = simhash.keep_one_each(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 6, 7, 8, None}


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {n: 0 for n in range(41)} | {n: 100 for n in range(100, 130)} | {n: 200 for n in range(200, 207)}
    assert got == want


def test_hot_groups_join_whole(spark):
    from cellpulse.llm.common import join_groups

    rows = spark.range(6_000).select(F.when(F.col("id") < 4_000, 0).otherwise(F.col("id")).alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    assert join_groups(rows, groups, "key", "size", 6_000).agg(F.sum("size"), F.count("*")).first()[:] == (4_000 * 4_000 + 2_000, 6_000)


def test_spanning_links_find_one_component():
    nodes = np.array([0, 1, 3, 7, 15, 31], np.int64)
    assert len(simhash.spanning_links(nodes, 1)) == 5
