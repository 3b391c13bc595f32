"""Which tokens of two tokenizers stand for the same bytes, and how often across the corpus.

Texts are grouped by full text first, so each distinct text is encoded and aligned once, however many copies it has. Where a token of A and
a token of B end at the same byte, both sequences are cut; what lies between two cuts is a group, and all A-B pairs of tokens in a group are
links. A pair counts once for every document that holds it linked, so a distinct text adds its number of copies.

Plan: one shuffle of the texts by themselves; a pass that encodes and aligns; pair counts by partial aggregation. Distinct texts come
in blocks of bounded size, and a block asks for each of its pairs once, since texts of one corpus share most of them. The answers
meet the block's texts in one group, and measures are joined to the documents by the digest of the text.

Token bytes: an A entry is decoded from the byte-level alphabet; a B piece is its UTF-8 with U+2581 as a space, a byte piece is its byte. A
reads a space and the text, B the text, to which it adds that space; strings of special tokens are plain text.

Defined cases: a text that is null or empty, or whose tokens do not spell space+text (a normaliser, a character that stands for a space), has
no tokens and all zeros. A very long text is a block of its own; a group without inner cuts is taken by distinct ids. Repeated rows count as
documents of their own. An id may be null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.bpe import Encoder
from cellpulse.llm.common import join_groups, whole_text
from cellpulse.plans.storage import durable

BLOCK_CHARS = 4_000_000
WIDE = 64
"""A group with more links than this is taken by distinct ids."""

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Pieces:
    """The B tokenizer with the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self._bytes(i) for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[Encoder, Pieces]:
    return Encoder(a_path), Pieces(b_path)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each A token and each B token, from the byte lengths of both sequences, which have one sum."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(a_ends, b_ends)
    return np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)


def linked_pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs as ``a * width + b``, sorted, with the number of links of each."""
    per_a, per_b = np.bincount(group_a), np.bincount(group_b)
    first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
    wide = np.flatnonzero(per_a * per_b > WIDE)
    narrow = np.ones(len(per_a), bool)
    narrow[wide] = False
    mine = np.flatnonzero(narrow[group_a])
    partners = per_b[group_a[mine]]
    at = np.repeat(first_b[group_a[mine]], partners) + np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners)
    pairs, counts = np.unique(np.repeat(a[mine], partners) * width + b[at], return_counts=True)
    if len(wide):
        more, times = [pairs], [counts]
        for g in wide.tolist():
            ua, ca = np.unique(a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            more.append((ua[:, None] * width + ub).ravel())
            times.append((ca[:, None] * cb).ravel())
        pairs, where = np.unique(np.concatenate(more), return_inverse=True)
        counts = np.bincount(where, np.concatenate(times)).astype(np.int64)
    return pairs, counts.astype(np.int64)


def spelled(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
    """Groups as ``a1,a2|b1;a3|b2``."""
    each = []
    for ids, groups in ((a, group_a), (b, group_b)):
        last = np.append(np.flatnonzero(np.diff(groups)), len(ids) - 1)
        words = list(map(str, ids.tolist()))
        begin = 0
        if len(last) == len(words):
            each.append(words)
            continue
        side = []
        for end in (last + 1).tolist():
            side.append(words[begin] if end - begin == 1 else ",".join(words[begin:end]))
            begin = end
        each.append(side)
    return ";".join([f"{x}|{y}" for x, y in zip(*each, strict=True)])


def align_text(text: str, enc: Encoder, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A ids, B ids and the groups of both, or None if the text has no tokens by definition."""
    if not text:
        return None
    raw = (" " + text).encode()
    b = pieces.ids(text)
    if b"".join([pieces.bytes[i] for i in b.tolist()]) != raw:
        return None
    a = enc.ids(" " + text).astype(np.int64)
    if b"".join([enc.token_bytes[i] for i in a.tolist()]) != raw:
        return None
    return a, b, *align(enc.byte_lengths[a], pieces.lengths[b])


def aligned(texts: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``texts`` (text, copies): key, copies, block, n_a, n_b, n_groups, groups_sha256, and the distinct linked pairs with
    their links. A pair is its A id times the size of B's vocabulary, plus its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pieces = tokenizers(a_path, b_path)
        block, room = TaskContext.get().partitionId() << 32, block_chars
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                if room < len(text):
                    block, room = block + 1, block_chars
                room -= len(text)
                found = align_text(text, enc, pieces)
                if found is None:
                    out.append((block, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                a, b, group_a, group_b = found
                pairs, links = linked_pairs(*found, pieces.size)
                digest = hashlib.sha256(spelled(a, b, group_a, group_b).encode()).hexdigest()
                out.append((block, len(a), len(b), int(group_a[-1]) + 1, digest, pairs, links))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            ends = pa.array(np.cumsum([0, *map(len, columns[5])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c) if c else [], pa.int64())) for c in columns[5:]]
            names = ["key", "copies", "block", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "links"]
            plain = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *plain, *lists], names)

    schema = "key binary, copies long, block long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<long>"
    return texts.select("text", "key", "copies").mapInArrow(run, schema)


def pair_counts(done: DataFrame, width: int) -> DataFrame:
    """``pair``, the number of documents that hold it linked, and whether that is its A id's highest number."""
    counts = done.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("count"))
    a = F.expr(f"pair div {width}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _measure(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(answers["pair"].to_numpy())
    known, counts, best = (answers[c].to_numpy()[order] for c in ("pair", "count", "best"))
    rows = []
    for pairs, links in zip(texts["pairs"], texts["links"], strict=True):
        at = np.searchsorted(known, pairs)
        rows.append((links.sum(), links[best[at]].sum(), (links * counts[at]).sum()) if len(pairs) else (0, 0, 0))
    measured = pd.DataFrame(rows, columns=["n_links", "n_best", "count_sum"], dtype="int64")
    return pd.concat([texts[["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256"]].reset_index(drop=True), measured], axis=1)


def measure(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    distinct = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = distinct.select("text", F.unhex(F.sha2("text", 256)).alias("key"), "copies")
    done = durable(aligned(keyed, a_path, b_path, block_chars), "aligned")
    width = Pieces(b_path).size
    asked = done.select(F.col("block").alias("asking"), F.explode("pairs").alias("pair")).distinct()
    answers = asked.join(pair_counts(done, width), "pair")
    schema = "key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    measured = durable(done.groupBy("block").cogroup(answers.groupBy("asking")).applyInPandas(_measure, schema), "measured")
    named = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    joined = join_groups(named, measured, "key", "copies", docs.count())
    return joined.select("doc_id", *MEASURES, "groups_sha256")
