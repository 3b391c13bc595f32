"""SimHash near-duplicates, linked through covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority vote of that bit over the hashes of its word shingles. Fingerprints
link when at most ``radius`` bits differ. The masks come from a code with radius + 1 check bits: bit i has the nonzero
label f(i), and table v (one for each nonzero v, 31 for radius 4) keeps the bits where f(i) and v have odd overlap. Up to
``radius`` differing bits span less than the whole label space, so some v is orthogonal to all their labels, its
mask hides all of them, and the pair meets in that table. No pair within the radius is missed.

Equal fingerprints are one node from the start. A bucket of two is a pair; a bucket of up to ``BUCKET`` nodes is searched in one
task for a spanning forest of its links, never for all its pairs. In a larger bucket, up to radius ``BALL_RADIUS``, two nodes link exactly
if the balls of half the radius around them share a point, so the points are grouped instead, and rows grow in proportion to the
bucket; for a larger radius the balls get too big, and the bucket is cut into blocks that are searched two by two.

Defined cases: a null or blank text has fingerprint zero and links like any other; a text of fewer words than a shingle is one
shingle; rows with a null id get a fingerprint and the component of the fingerprint, null if no row of it has an id; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import join_groups, whole_text
from cellpulse.llm.components import connected
from cellpulse.plans.series import spread
from cellpulse.plans.storage import durable

BITS = 64
SEED = 42
BALL_RADIUS = 4
BUCKET = 4_096
BROADCAST_KEYS = 200_000
STEP = 65_536


def fingerprint(text: str, words: int, distinct: bool = False) -> int:
    """The signed 64-bit SimHash of a text, of its shingles or of the set of them.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as intended.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) > words:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = len(found) - words + 1
        pieces = [joined[a:b] for a, b in zip(starts[:last].tolist(), ends[words - 1 :].tolist(), strict=True)]
    else:
        pieces = [joined]
    if distinct:
        pieces = list(dict.fromkeys(pieces))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp)`` for every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, distinct) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), of(whole_text(text_col)).alias("fp"))


def masks(radius: int) -> list[int]:
    """The kept bits of each table, as signed 64-bit numbers.

    Labels are dealt from a fixed shuffle of all of them, so that every table keeps about half of the bits.
    """
    labels = np.random.default_rng(radius).permutation(2 ** (radius + 1) - 1) + 1
    kept = [sum(1 << i for i in range(BITS) if (int(labels[i % len(labels)]) & v).bit_count() % 2) for v in range(1, len(labels) + 1)]
    return [_signed(x) for x in kept]


def _signed(x: int) -> int:
    return x - 2**BITS if x >= 2 ** (BITS - 1) else x


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def spanning_links(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the nodes, by search from one node to those not reached yet."""
    links: list[tuple[int, int]] = []
    waiting = np.sort(nodes)
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(waiting ^ at) <= radius
            if near.any():
                reached = waiting[near]
                waiting = waiting[~near]
                links += [(int(at), int(x)) for x in reached]
                front += list(reached)
    return links


def _search_buckets(radius: int):  # noqa: ANN202
    """Spanning links of every bucket; what earlier buckets of the task have connected already is not linked again."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            fresh = []
            for nodes in batch["nodes"]:
                for u, v in spanning_links(np.asarray(nodes, np.int64), radius):
                    a, b = root(u), root(v)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        fresh.append((u, v))
            yield pd.DataFrame(fresh, columns=["u", "v"], dtype="int64")

    return search


def _ball(fp: Column, radius: int) -> Column:
    """All points within ``radius`` bits; the bits a table keeps may differ too, which only adds points that pair nobody falsely."""
    flips = [sum(1 << i for i in some) for k in range(radius + 1) for some in combinations(range(BITS), k)]
    return F.explode(F.transform(_numbers([_signed(x) for x in flips]), lambda x: x.bitwiseXOR(fp)))


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect the same nodes as all pairs within the radius."""
    # few bytes of fingerprints become many rows, so they are dealt to all tasks first
    every = spread(nodes.select("fp"), "fp").select("fp", F.posexplode(_numbers(masks(radius))).alias("table", "_mask"))
    members = every.select("table", F.col("fp").bitwiseAND(F.col("_mask")).alias("key"), "fp")
    content = [F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("content")]
    counted = members.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"), *content)
    shared = durable(counted.filter("n > 1"), "buckets")
    # the ends of a bucket and the exclusive-or of its members name all of them where there are two or three
    third = F.col("x").bitwiseXOR(F.col("u")).bitwiseXOR(F.col("v"))
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    three = F.array(pair(F.col("u"), F.col("v")), pair(F.col("u"), third), pair(third, F.col("v")))
    triples = shared.filter("n = 3").select("u", "v", "x").distinct().select(F.explode(three).alias("p")).select("p.u", "p.v")
    pairs = shared.filter("n = 2").select("u", "v").unionByName(triples)
    pairs = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    # near copies share many buckets; those with the same members, by size, ends and hash, are searched once
    first = F.min(F.struct("table", "key")).alias("_first")
    keys = shared.filter("n > 3").groupBy("n", "u", "v", "content").agg(first).select("_first.table", "_first.key", "n")
    # the planner takes the members for as small as the fingerprints they come from, and must not broadcast them
    few = keys.count() <= BROADCAST_KEYS
    crowded = members.join(F.broadcast(keys), ["table", "key"]) if few else members.hint("merge").join(keys, ["table", "key"])
    some = crowded.filter(F.col("n") <= bucket).groupBy("table", "key").agg(F.collect_list("fp").alias("nodes"))
    found = some.select("nodes").mapInPandas(_search_buckets(radius), "u long, v long")
    edges = pairs.unionByName(found)
    if shared.filter(F.col("n") > bucket).isEmpty():
        return edges.distinct()
    if radius <= BALL_RADIUS and radius % 2 == 0:
        large = crowded.filter(F.col("n") > bucket).select("fp").distinct()
        points = large.select("fp", _ball(F.col("fp"), radius // 2).alias("point"))
        first = points.groupBy("point").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        return edges.unionByName(points.join(first, "point").filter("fp <> u").select("u", F.col("fp").alias("v"))).distinct()
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = crowded.filter(F.col("n") > bucket).select("table", "key", "fp", mine.alias("_b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
    pairs = dealt.groupBy("table", "key", F.least("_b", "_o"), F.greatest("_b", "_o")).agg(F.collect_list("fp").alias("nodes"))
    return edges.unionByName(pairs.select("nodes").mapInPandas(_search_buckets(radius), "u long, v long")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    distinct: bool = False,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    rows = durable(fingerprints(docs, id_col, text_col, words, distinct), "fingerprints")
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    found = durable(links(nodes.select("fp"), radius, bucket), "links")
    ends = [nodes.select(F.col("fp").alias(c), F.col("rep").alias(f"_{c}")) for c in ("u", "v")]
    # a fingerprint all of whose rows lack an id cannot name a component, but it still connects: it goes by a negative stand-in
    stand_in = lambda rep, fp: F.struct(F.col(rep).isNull().alias("none"), F.coalesce(F.col(rep), F.col(fp)).alias("id"))
    edges = found.join(ends[0], "u").join(ends[1], "v").select(stand_in("_u", "u").alias("u"), stand_in("_v", "v").alias("v"))
    roots = connected(edges).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    named = nodes.withColumn("_node", stand_in("rep", "fp")).join(roots, "_node", "left")
    root_id = F.when(~F.col("_root.none"), F.col("_root.id"))
    known = named.select("fp", F.coalesce(root_id, F.col("rep")).alias("component_id"), "n")
    out = join_groups(rows, durable(known, "components"), "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Pairs of ids ``(u, v)`` that link what fingerprints within ``radius`` bits link: each id with the smallest of its fingerprint, and
    those along the links between fingerprints. Rows without an id are left out."""
    rows = durable(fingerprints(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, words), "fingerprints")
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    shared = nodes.filter("n > 1").select("fp", "rep", "n")
    same = rows.join(shared, "fp").filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    ends = [nodes.select(F.col("fp").alias(f"_{c}"), F.col("rep").alias(c)) for c in ("u", "v")]
    found = links(nodes.select("fp"), radius, bucket).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return same.unionByName(found.join(ends[0], "_u").join(ends[1], "_v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` whose id names their component, and rows without an id that are alone."""
    judged = near_duplicates(docs, id_col, text_col, **how)
    dropped = judged.filter("component_id is not null and doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    return rows.join(dropped, F.col("_id") == F.col("_dropped"), "left_anti").select("_row.*")
