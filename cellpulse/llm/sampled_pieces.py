"""SentencePiece encoding and decoding, with sampled segmentations.

For subword regularisation a text gets ``k`` different segmentations, drawn without replacement from the distribution over all
of them: each has a probability, its log-probability is perturbed by Gumbel noise, and the k largest perturbed values are a sample without
replacement. The lattice is never enumerated. The largest noise below a node of the search tree is drawn first and its children's given it, so a
node's perturbed value is exactly that of the best segmentation below it, and best-first search (A-star with an exact bound) reaches
the k best one by one. Of the open nodes only as many as are still wanted need to be remembered.

A segmentation's probability is proportional to the product of its pieces' weights, ``(2 + rank) ** -theta``, with the vocabulary's ranks. Its
inclusion score is the chance that it is among those drawn, given the next perturbed value: the weight it needs in
estimates over the sample. Noise comes from the row's key, so a lost task draws the same sample again.

Pieces do not cross word boundaries, so the lattice is a chain of word lattices, and those of recent words are kept.

Defined cases: a null or empty text has one segmentation, the empty one; fewer than ``k`` segmentations are all returned, with inclusion
score 1; characters that the vocabulary lacks are spelt in bytes; rows with equal keys and texts get equal samples; null keys are
keys; an empty table gives an empty result. Decoding gives the text back, unless it holds the vocabulary's own space sign.
"""

from __future__ import annotations

import math
import random
import re
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import whole_text

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
KEPT_WORDS = 20_000
KEPT_LENGTH = 48

Lattice = list[list[tuple[int, tuple[int, ...], float]]]
"""Per position: where each piece from here ends, its ids, and its log-probability given the position."""


class Vocabulary:
    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weights: dict[str, tuple[int, float]] = {}
        size = self.model.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                rank = min(size, max(0.0, -self.model.get_score(i)))
                self.weights[piece] = (i, -theta * math.log(2 + rank))
        self.rare = -theta * math.log(2 + size)
        self.longest = max(map(len, self.weights))
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.weights)
        self.lattice = lru_cache(KEPT_WORDS)(self._lattice)

    def words(self, text: str) -> list[str]:
        normal = self.model.normalize(text)
        return WORD.findall(normal) if self.words_apart else [normal] if normal else []

    def of(self, word: str) -> Lattice:
        return self.lattice(word) if len(word) <= KEPT_LENGTH else self._lattice(word)

    def _lattice(self, word: str) -> Lattice:
        """Probabilities of the pieces from every position, by summing over all ways to the end, from the back."""
        n = len(word)
        total, out = [0.0] * (n + 1), [[] for _ in range(n)]
        for at in range(n - 1, -1, -1):
            found = []
            for end in range(at + 1, min(n, at + self.longest) + 1):
                known = self.weights.get(word[at:end])
                if known:
                    found.append((end, (known[0],), known[1] + total[end]))
                elif end == at + 1:
                    found.append((end, tuple(self.byte_ids[b] for b in word[at].encode()), self.rare + total[end]))
            top = max(w for _, _, w in found)
            total[at] = top + math.log(sum(math.exp(w - top) for _, _, w in found))
            out[at] = [(end, ids, w - total[at]) for end, ids, w in found]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Vocabulary:
    return Vocabulary(path, theta)


def noise(key: Sequence, seed: int) -> random.Random:
    """A generator that depends on the row's key and the seed alone."""
    return random.Random(blake2b(repr((seed, *key)).encode(), digest_size=16).digest())


def sample(lattices: list[Lattice], k: int, rng: random.Random) -> tuple[list[tuple[list[int], float, float]], float]:
    """The ``k`` segmentations with the largest perturbed log-probability, as (ids, log-probability, perturbed value), and the value of the next."""
    draw, log, exp, log1p = rng.random, math.log, math.exp, math.log1p
    root = -log(-log(draw() or 5e-324))
    # (perturbed value, order, log-probability, word, position, pieces so far)
    open_: list[tuple] = [(root, 0, 0.0, 0, 0, None)]
    done: list[tuple[list[int], float, float]] = []
    order = 0
    while open_ and len(done) < k:
        value, _, logp, word, at, path = open_.pop()
        room = k - len(done)
        while word < len(lattices):
            options = lattices[word][at]
            if len(options) == 1:
                end, ids, step = options[0]
            else:
                tries = [logp + w - log(-log(draw() or 5e-324)) for _, _, w in options]
                best = max(tries)
                top = tries.index(best)
                for j, g in enumerate(tries):
                    if j == top:
                        continue
                    gap = exp(g - best)
                    v = value - g + (log1p(-gap) if gap < 1 else -math.inf)
                    new = value - max(0.0, v) - log1p(exp(-abs(v)))
                    if len(open_) < room or new > open_[0][0]:
                        order += 1
                        end, ids, w = options[j]
                        place = (word, end) if end < len(lattices[word]) else (word + 1, 0)
                        insort(open_, (new, order, logp + w, *place, (path, ids)))
                        if len(open_) > room:
                            del open_[0]
                end, ids, step = options[top]
            logp += step
            path = (path, ids)
            word, at = (word, end) if end < len(lattices[word]) else (word + 1, 0)
        pieces = []
        while path is not None:
            path, ids = path
            pieces.append(ids)
        done.append(([i for ids in reversed(pieces) for i in ids], logp, value))
    return done, open_[-1][0] if open_ else -math.inf


def inclusion(logp: float, bound: float) -> float:
    """The chance that the perturbed value exceeds the bound."""
    return 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(700.0, logp - bound)))


def sampled(docs: DataFrame, model: str, keys: Sequence[str], k: int = 4, theta: float = 1.0, seed: int = 0, text_col: str = "text") -> DataFrame:
    """One row per drawn segmentation: the key columns, sample (from 1), ids, log_prob, perturbed, inclusion, decoded."""
    source = docs.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(keys)], whole_text(text_col).alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, theta)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                names = list(zip(*[batch.column(j).to_pylist() for j in range(len(keys))], strict=True))
                row, rows = [], []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    drawn, bound = sample([vocab.of(w) for w in vocab.words(text)], k, noise(names[n], seed))
                    for j, (ids, logp, value) in enumerate(drawn):
                        row.append(n)
                        rows.append((j + 1, ids, logp, value, inclusion(logp, bound), vocab.model.decode(ids)))
                where = pa.array(row, pa.int64())
                columns = {f"_k{j}": batch.column(j).take(where) for j in range(len(keys))}
                kinds = {"sample": pa.int32(), "ids": pa.list_(pa.int32()), "log_prob": pa.float64(), "perturbed": pa.float64(), "inclusion": pa.float64(), "decoded": pa.string()}
                columns |= {c: pa.array([r[j] for r in rows], kind) for j, (c, kind) in enumerate(kinds.items())}
                yield pa.RecordBatch.from_pydict(columns)

    key_types = ", ".join(f"_k{j} {source.schema[f'_k{j}'].dataType.simpleString()}" for j in range(len(keys)))
    out = source.mapInArrow(draw, f"{key_types}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded string")
    return out.select(*[F.col(f"_k{j}").alias(c) for j, c in enumerate(keys)], "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded")


def encoded(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the vocabulary's own segmentation of each text."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(vocabulary(model, 1.0).model.encode(texts.to_list(), num_threads=1), dtype=object)

    return docs.withColumn(out_col, encode(whole_text(text_col)))


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids decode to null."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        sp = vocabulary(model, 1.0).model
        return pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in ids], dtype=object)

    return rows.withColumn(out_col, decode(F.col(ids_col)))
