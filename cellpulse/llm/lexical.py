"""Ranked lexical search over posting lists that are blocked by geometry, exactly.

Documents become sparse vectors over the terms of the queries, numbered from the rarest term to the most frequent one. They are dealt to segments
of bounded size by the signs of random projections, so like ones lie together. In a segment every posting list is clustered: representatives
are taken from the list, each of its documents goes to the most similar one, and the documents of a representative are a block. A block
stores the coordinatewise maximum of its documents over its own term and the more frequent ones that some query asks for together with it.

A document is looked for in the list of the rarest query term it holds, so these coordinates are all that can add to its score there, and the product of
query and summary is an upper bound for every document of the block that no earlier list has. Blocks are visited by falling bound; one is skipped
only when its bound is below the score of the k-th best document found so far. Nothing is estimated: scores and bounds are whole numbers.
A segment gives its best k documents per query, and a window ranks those of all segments.

Queries are taken in blocks of at most ``QUERY_CHARS`` characters (one query more at most), each with one scan of the documents, so what the driver and the tasks hold of
them is bounded; so are the segments, also where copies share one vector.

Defined cases: a null text has no terms and is no document of the statistics; a query without terms has no result; a document with score 0 is none.
A very long text is one row with its query terms. Repeated rows and ids are ranked one by one; of equal scores the smaller id is first, null last;
queries that repeat are answered each. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import whole_text
from cellpulse.plans.storage import durable

QUERY_CHARS = 4_000_000
CODE_BITS = 12
SEGMENT = 4_096
BLOCK = 32
DIMENSIONS = 16
SEED = 42
LONG_QUERY = 4_096
"""Beyond so many distinct terms in a query, summaries keep all coordinates instead of those that share a query with the list's term."""
IMPACT_BITS = 20
"""An impact is at most 1,000,000."""

TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z as a-z."""
    return (text or "").encode().translate(TABLE).split()


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one unit of weight scores, in whole numbers."""
    m = 100 - 75 + (75 * n * documents) // terms
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1_000 * math.log((2 * documents + 2) / (2 * df + 1)))


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, the number of terms ``n``, and the vocabulary's terms in the text with their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                lengths.append(len(words))
                found = np.fromiter((i for i in map(vocabulary.get, words) if i is not None), np.int32)
                ids, times = np.unique(found, return_counts=True)
                terms.append(ids)
                tfs.append(times.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c) if c else [], pa.int32())) for c in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, n long, terms array<int>, tfs array<int>")


def _directions(n_terms: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n_terms, dimensions))


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated lists and where each begins, with the end."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.cumsum([0, *pc.list_value_length(whole).to_pylist()])
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def coded(vectors: DataFrame, numbers: np.ndarray, weights: np.ndarray) -> DataFrame:
    """Terms renumbered and sorted, and the signs of some projections of the weighted vector as ``code``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions(len(weights), CODE_BITS)
        for batch in batches:
            terms, ends = _flat(batch.column("terms"))
            tfs = _flat(batch.column("tfs"))[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            order = np.lexsort((numbers[terms], row))
            terms, tfs = numbers[terms][order], tfs[order]
            signs = np.zeros((batch.num_rows, CODE_BITS), bool)
            if len(terms):
                signs = np.add.reduceat(weights[terms][:, None] * directions[terms], ends[:-1], axis=0) > 0
            columns = [batch.column("doc_id"), batch.column("n"), _list(terms, ends, pa.int32()), _list(tfs, ends, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signs @ (1 << np.arange(CODE_BITS)), pa.int32())], ["doc_id", "n", "terms", "tfs", "code"])

    id_type = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(code, f"doc_id {id_type}, n long, terms array<int>, tfs array<int>, code int")


def dealt(vectors: DataFrame, segment: int) -> DataFrame:
    """Add ``segment``: runs of codes with about ``segment`` documents, and several segments for a code with more."""
    counts = sorted((r["code"], r["count"]) for r in vectors.groupBy("code").count().collect())
    places, current, filled = [], 0, 0
    for code, count in counts:
        parts = -(-count // segment)
        if parts > 1 or filled + count > segment:
            current, filled = current + (filled > 0), 0
        places.append((code, current, parts))
        if parts > 1:
            current, filled = current + parts, 0
        else:
            filled += count
    known = vectors.sparkSession.createDataFrame(places, "code int, _first int, _parts int")
    salt = F.pmod(F.xxhash64("doc_id", "_nth"), F.col("_parts")).cast("int")
    tagged = vectors.withColumn("_nth", F.monotonically_increasing_id())
    return tagged.join(F.broadcast(known), "code").withColumn("segment", F.col("_first") + salt).drop("_first", "_parts", "code", "_nth")


ARRAYS = ("row_ptr", "terms", "impacts", "list_terms", "list_ptr", "block_ptr", "block_docs", "summary_ptr", "summary_terms", "summary_max")
"""What a segment consists of: rows of terms and impacts; lists of blocks of rows; a summary of terms and maxima for each block."""


def clustered(points: np.ndarray, block: int) -> np.ndarray:
    """The number of the representative most similar to each point; representatives are taken evenly from the list."""
    chosen = np.linspace(0, len(points) - 1, -(-len(points) // block)).astype(np.int64)
    return (points @ points[chosen].T).argmax(axis=1)


def build_segment(
    docs: pa.Table, weights: np.ndarray, directions: np.ndarray, documents: int, total: int, block: int, partners: dict[int, np.ndarray] | None = None
) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The rows of a segment by id, its posting lists in blocks, and the summaries of the blocks; and the ids."""
    docs = docs.take(pc.sort_indices(docs.column("doc_id"), null_placement="at_end"))
    terms, ptr = _flat(docs.column("terms"))
    row = np.repeat(np.arange(docs.num_rows), np.diff(ptr))
    impacts = impact(_flat(docs.column("tfs"))[0], docs.column("n").to_numpy()[row], documents, total)
    points = np.add.reduceat((weights[terms] * impacts)[:, None] * directions[terms], ptr[:-1], axis=0)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    posting = np.argsort(terms, kind="stable")
    starts = np.flatnonzero(np.diff(terms[posting], prepend=-1))
    wanted = np.ones(len(weights), bool) if partners is None else np.zeros(len(weights), bool)
    list_terms, list_ptr, sizes, members, lengths, keys, maxima = [], [0], [], [], [], [], []
    for own in np.split(posting, starts[1:]) if len(starts) else []:
        term = int(terms[own[0]])
        if len(own) > block:
            label = clustered(points[row[own]], block)
            order = np.argsort(label, kind="stable")
            own, label = own[order], label[order]
            number = np.cumsum(np.diff(label, prepend=label[0]) != 0)
        else:
            number = np.zeros(len(own), np.int64)
        # a posting's share in the summary: its document's coordinates from the list's own term on
        many = ptr[row[own] + 1] - own
        at = np.repeat(own - (np.cumsum(many) - many), many) + np.arange(many.sum())
        number_at = np.repeat(number, many)
        if partners is not None:
            wanted[partners[term]] = True
            kept = wanted[terms[at]]
            at, number_at = at[kept], number_at[kept]
            wanted[partners[term]] = False
        packed = np.sort(((number_at * len(weights) + terms[at]) << IMPACT_BITS) + impacts[at])
        last = np.flatnonzero(np.append(np.diff(packed >> IMPACT_BITS), 1))
        key = packed[last] >> IMPACT_BITS
        blocks = int(number[-1]) + 1
        list_terms.append(term)
        list_ptr.append(list_ptr[-1] + blocks)
        sizes.append(np.bincount(number, minlength=blocks))
        members.append(row[own])
        lengths.append(np.bincount(key // len(weights), minlength=blocks))
        keys.append(key % len(weights))
        maxima.append(packed[last] & ((1 << IMPACT_BITS) - 1))

    def ends(counts: list[np.ndarray]) -> np.ndarray:
        return np.append(0, np.cumsum(np.concatenate(counts)))

    return {
        "row_ptr": ptr, "terms": terms, "impacts": impacts, "list_terms": np.array(list_terms), "list_ptr": np.array(list_ptr),
        "block_ptr": ends(sizes), "block_docs": np.concatenate(members),
        "summary_ptr": ends(lengths), "summary_terms": np.concatenate(keys), "summary_max": np.concatenate(maxima),
    }, docs.column("doc_id").combine_chunks()


def partners_of(asked: list[np.ndarray], n_terms: int) -> dict[int, np.ndarray] | None:
    """For each term, the terms from it on that share a query with it; None, which stands for all, where a query is very long."""
    if max(map(len, asked), default=0) > LONG_QUERY:
        return None
    found: dict[int, list[np.ndarray]] = {t: [] for t in range(n_terms)}
    for ids in asked:
        for i, t in enumerate(ids.tolist()):
            found[t].append(ids[i:])
    return {t: np.unique(np.concatenate(x)) if x else np.array([t]) for t, x in found.items()}


def search_segment(index: dict[str, np.ndarray], queries: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, k: int) -> list[tuple[int, int, int]]:
    """``(query, row, score)`` of the best ``k`` rows for each query of (number, sorted terms, weights)."""
    ptr, terms, impacts, list_terms, list_ptr, block_ptr, block_docs, summary_ptr, summary_terms, summary_max = (index[c] for c in ARRAYS)
    wanted, out = np.zeros(n_terms, np.int64), []
    for number, ids, weights in queries:
        at = np.searchsorted(list_terms, ids)
        at = at[(at < len(list_terms)) & (list_terms[np.minimum(at, len(list_terms) - 1)] == ids)]
        if not len(at):
            continue
        wanted[ids] = weights
        blocks, bounds = [], []
        for x in at.tolist():
            first, until = int(list_ptr[x]), int(list_ptr[x + 1])
            a, b = int(summary_ptr[first]), int(summary_ptr[until])
            blocks.append(np.arange(first, until))
            bounds.append(np.add.reduceat(wanted[summary_terms[a:b]] * summary_max[a:b], summary_ptr[first:until] - a))
        blocks, bounds = np.concatenate(blocks), np.concatenate(bounds)
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen, done, step, least = np.zeros(len(ptr) - 1, bool), 0, 4, 1
        while done < len(blocks) and bounds[done] >= least:
            now = blocks[done : done + step]
            now = now[bounds[done : done + step] >= least]
            done, step = done + step, step * 2
            fresh = np.unique(np.concatenate([block_docs[block_ptr[b] : block_ptr[b + 1]] for b in now.tolist()]))
            fresh = fresh[~seen[fresh]]
            if not len(fresh):
                continue
            seen[fresh] = True
            many = ptr[fresh + 1] - ptr[fresh]
            entry = np.repeat(ptr[fresh] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            got = np.add.reduceat(wanted[terms[entry]] * impacts[entry], np.cumsum(many) - many)
            rows, scores = np.concatenate((rows, fresh)), np.concatenate((scores, got))
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k:
                least = max(1, int(scores[-1]))
        wanted[ids] = 0
        out += [(number, r, s) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) if s > 0]
    return out


def build(
    docs: DataFrame,
    vocabulary: dict[bytes, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    segment: int = SEGMENT,
    block: int = BLOCK,
    queries: list[Counter] | None = None,
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The index over the terms of ``vocabulary``, one row per segment; and for each entry of the vocabulary its number there and, by number, its weight.

    If ``queries`` are given, the index is for these alone: summaries leave out what no query asks for together with the list's term.
    """
    vectors = durable(forward(docs, vocabulary, id_col, text_col), "vectors")
    stats = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    documents, total = int(stats["documents"]), int(stats["total"])
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    numbers = np.empty(len(df), np.int64)
    numbers[np.argsort(df, kind="stable")] = np.arange(len(df))
    weights = np.zeros(len(df), np.int64)
    weights[numbers] = [weight(int(x), documents) for x in df]
    asked = None if queries is None else [np.sort(numbers[[vocabulary[t] for t in q]]) for q in queries]
    partners = None if asked is None else partners_of(asked, len(df))
    placed = dealt(durable(coded(vectors.filter("size(terms) > 0"), numbers, weights), "coded"), segment)
    id_type = vectors.schema["doc_id"].dataType.simpleString()

    def rows(key: tuple, group: pa.Table) -> pa.Table:
        built, ids = build_segment(group, weights, _directions(len(weights), DIMENSIONS), documents, total, block, partners)
        arrays = [_list(built[c], np.array([0, len(built[c])]), pa.int32()) for c in ARRAYS]
        named = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), named, *arrays], ["segment", "doc_ids", *ARRAYS])

    schema = f"segment int, doc_ids array<{id_type}>, " + ", ".join(f"{c} array<int>" for c in ARRAYS)
    return durable(placed.groupBy("segment").applyInArrow(rows, schema), "index"), numbers, weights


def _answers(index: DataFrame, items: list[tuple[int, Counter]], vocabulary: dict[bytes, int], numbers: np.ndarray, weights: np.ndarray, k: int) -> DataFrame:
    asked = []
    for number, terms in items:
        ids = numbers[[vocabulary[t] for t in terms]]
        order = np.argsort(ids)
        asked.append((number, ids[order], (np.array(list(terms.values()), np.int64) * weights[ids])[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ARRAYS}
                found = search_segment(arrays, asked, len(weights), k)
                ids = batch.column("doc_ids")[i].values.take(pa.array([r for _, r, _ in found], pa.int64()))
                columns = [pa.array([x for x, _, _ in found], pa.int32()), ids, pa.array([x for _, _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_item", "doc_id", "score"])

    return index.mapInArrow(run, f"_item int, doc_id {index.schema['doc_ids'].dataType.elementType.simpleString()}, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    query_chars: int = QUERY_CHARS,
    segment: int = SEGMENT,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), whole_text(item_text_col).alias("text"))
    chars = asked.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // query_chars))
    results = []
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        counted = [(i, Counter(terms_of(r["text"]))) for i, r in enumerate(mine)]
        counted = [(i, c) for i, c in counted if c]
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, c in counted for t in c}))}
        index, numbers, weights = build(docs, vocabulary, id_col, text_col, segment, block, [c for _, c in counted])
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"_item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = _answers(index, counted, vocabulary, numbers, weights, k)
        best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        results.append(ranked.join(F.broadcast(named), "_item").select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
