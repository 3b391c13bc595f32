"""Quality classifier by co-training of two views.

One view sees the text: the frequencies of its byte pairs, hashed, and how often its words repeat. The other sees what comes with a page: language,
source, length, and its layout (lines, repeated lines, shares of capitals, digits, symbols and spaces). Both start from
labelled documents. In every round each view labels the unlabelled documents it is surest of, as many of either class as the
labels have in proportion, and hands them to the other view. At the end both are calibrated on labelled
documents held out from all rounds, and their log-odds are combined as those of independent witnesses.

The classifiers are fitted on the driver, on a bounded sample: at most ``max_labelled`` labelled and ``max_pool`` unlabelled
documents, those with the smallest hash of their id. Only their fixed-length feature vectors travel. All documents are then scored
where they lie.

Defined cases: a null text is empty; null language or source is a value of its own; a document whose labels contradict each other is
unlabelled; with fewer than ``MIN_OF_CLASS`` labelled documents of either class nothing can be learnt and every document has
score 1 and is kept; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import whole_text

PAIRS, REPEATS = 512, 3
TEXT = PAIRS + REPEATS
SHRINK = 32
LANGS, SOURCES, LAYOUT = 16, 64, 8
META = LANGS + SOURCES + LAYOUT
BLOCK = 1 << 20
MAX_LABELLED = 4_000
MAX_POOL = 3_000
MIN_OF_CLASS = 2
HELD_OUT = 0.25
ROUNDS = 4
SHARE_A_ROUND = 0.1
SURE = 0.9

UPPER = np.array([chr(b).isupper() and b < 128 for b in range(256)])
LOWER = np.array([chr(b).islower() and b < 128 for b in range(256)])
DIGIT = np.array([48 <= b < 58 for b in range(256)])
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
SYMBOL = ~(UPPER | LOWER | DIGIT | SPACE) & (np.arange(256) < 128)


def text_view(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, shrunk for short texts, and of words that repeat."""
    counts = np.zeros(PAIRS)
    for at in range(0, max(1, len(text) - 1), BLOCK):
        b = np.frombuffer(text[at : at + BLOCK + 1], np.uint8).astype(np.uint32)
        pairs = ((b[:-1] << 8 | b[1:]) * np.uint32(40_503) >> 5) & (PAIRS - 1)
        counts += np.bincount(pairs, minlength=PAIRS)
    words = text.split()
    n = len(words) + SHRINK
    repeats = [sum(map(eq, words, words[1:])) / n, (len(words) - len(set(words))) / n, len(words) / n]
    return np.sqrt([*(counts / (SHRINK + counts.sum())), *repeats]).astype(np.float32)


def meta_view(text: bytes, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(META, np.float32)
    out[zlib.crc32(f"lang {lang}".encode()) % LANGS] = 1
    out[LANGS + zlib.crc32(f"source {source}".encode()) % SOURCES] = 1
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, lines = len(text) + SHRINK, text.split(b"\n")
    known = n_chars if n_chars is not None and n_chars == n_chars and n_chars >= 0 else len(text)
    words = counts[SPACE].sum()
    shares = [counts[c].sum() / size for c in (UPPER, DIGIT, SYMBOL, SPACE)]
    out[LANGS + SOURCES :] = [
        np.log1p(known) / 5, np.log1p(len(lines)) / 3, 1 - len(set(lines)) / len(lines), np.log1p(size / (words + SHRINK / 6)), *(3 * np.sqrt(s) for s in shares),
    ]
    return out


@dataclass
class Linear:
    """Logistic regression with its calibration ``slope * logit + shift``."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, start: Linear | None = None, steps: int = 200, ridge: float = 1e-4) -> Linear:
    """Both classes weigh the same; accelerated gradient descent with the step the curvature allows."""
    share = y.mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    rate = 4 / (max((x * x).sum(1).max(), 1.0) + 1)
    weight = weight.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32) if start is None else start.weights
    b = 0.0 if start is None else start.bias
    pw, pb = w, b
    for k in range(steps):
        m = np.float32(k / (k + 3))
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        pw, pb = w, b
        gap = ((sigmoid(x @ vw + vb) - y) * weight).astype(np.float32)
        w, b = vw - np.float32(rate) * (gap @ x + np.float32(ridge) * vw), vb - rate * float(gap.sum())
    return Linear(w, float(b))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling with smoothed targets, by Newton steps."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    z = model.raw(x)
    spread = max(float(z.std()), 1e-9)
    design = np.column_stack([z / spread, np.ones_like(z)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(design @ theta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])), -2, 2)
    model.slope, model.shift = max(float(theta[0]), 1e-3) / spread, float(theta[1])


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        a, b = self.text.calibrated(text), self.meta.calibrated(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray, np.ndarray], pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """Each input: text view, metadata view (and labels)."""
    y = labelled[2].astype(float)
    share = y.mean()
    given: list[dict[int, float]] = [{}, {}]
    models: list[Linear] = []
    for r in range(rounds + 1):
        for v in (0, 1):
            rows = list(given[v])
            x = np.vstack([labelled[v], pool[v][rows]]) if rows else labelled[v]
            target = np.concatenate([y, [given[v][k] for k in rows]])
            new = fit(x, target, models[v] if r else None)
            models[v : v + 1] = [new]
        if r == rounds or not len(pool[0]):
            break
        for v in (0, 1):
            p = sigmoid(models[v].raw(pool[v]))
            other = given[1 - v]
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                many = int(np.ceil(SHARE_A_ROUND * part * len(p)))
                fresh = [int(k) for k in np.argsort(-sure, kind="stable") if sure[k] >= SURE and int(k) not in other]
                other.update(dict.fromkeys(fresh[:many], label))
    for v in (0, 1):
        calibrate(models[v], held[v], held[2].astype(float))
    good, bad = held[2].sum() + 1, len(held[2]) - held[2].sum() + 1
    return CoTrained(models[0], models[1], float(np.log(good / bad)))


def _columns(docs: DataFrame, text_col: str, n_chars: str) -> list[Column]:
    """Text, language, source and length; what the table lacks counts as null."""
    have = {c for c in docs.columns}
    return [
        whole_text(text_col).alias("text"),
        *((F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(a) for a, c, t in (("lang", "lang", "string"), ("source", "source", "string"), ("n_chars", n_chars, "double"))),
    ]


def _views(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in batch["text"]]
    text = np.array([text_view(b) for b in raw], np.float32).reshape(len(raw), TEXT)
    meta = [meta_view(b, s, o, n) for b, s, o, n in zip(raw, batch["lang"], batch["source"], batch["n_chars"], strict=True)]
    return text, np.array(meta, np.float32).reshape(len(raw), META)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int, max_pool: int) -> DataFrame:
    """Ids to learn from, with label (null: pool) and a hash; at most ``max_labelled + max_pool`` rows."""
    order = [F.xxhash64("_id"), F.col("_id")]
    clear = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    known = clear.filter("_id is not null and _y = _z").select("_id", F.col("_y").cast("double").alias("_y"))
    chosen = known.orderBy(*order).limit(max_labelled)
    ids = docs.select(F.col(id_col).alias("_id")).filter("_id is not null").orderBy(*order).limit(max_labelled + max_pool).distinct()
    labelled_too = known.join(F.broadcast(ids), "_id", "left_semi").select("_id")
    pool = ids.join(F.broadcast(labelled_too), "_id", "left_anti").orderBy(*order).limit(max_pool)
    both = chosen.unionByName(pool.select("_id", F.lit(None).cast("double").alias("_y")))
    return both.select("_id", "_y", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(1_000)).alias("_fold"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    n_chars: str = "n_chars",
    max_labelled: int = MAX_LABELLED,
    max_pool: int = MAX_POOL,
    rounds: int = ROUNDS,
) -> CoTrained | None:
    """The fitted pair of classifiers, or None if the labels do not allow any."""
    sample = _sample(docs, labels, id_col, label_col, max_labelled, max_pool)
    rows = docs.select(F.col(id_col).alias("_id"), *_columns(docs, text_col, n_chars)).join(F.broadcast(sample), "_id").drop_duplicates(["_id"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                text, meta = _views(part)
                yield pd.DataFrame({"id": part["_id"].to_numpy(), "y": part["_y"].to_numpy(), "fold": part["_fold"].to_numpy(), "text": [x.tobytes() for x in text], "meta": [x.tobytes() for x in meta]})

    id_type = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInPandas(features, f"id {id_type}, y double, fold long, text binary, meta binary").toPandas().sort_values("id")
    if not len(got):
        return None
    view = [np.vstack([np.frombuffer(x, np.float32) for x in got[c]]) for c in ("text", "meta")]
    y, held = got["y"].to_numpy(float), got["fold"].to_numpy() < 1_000 * HELD_OUT
    known = ~np.isnan(y)
    part = lambda where: (view[0][where], view[1][where], y[where])
    labelled, apart = part(known & ~held), part(known & held)
    for x in (labelled, apart):
        if min((x[2] > 0.5).sum(), (x[2] <= 0.5).sum()) < MIN_OF_CLASS:
            return None
    return co_train(labelled, apart, part(~known)[:2], rounds)


def _scorer(model: CoTrained | None):  # noqa: ANN202
    @F.pandas_udf("text_score double, meta_score double, score double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        n = len(text)
        out = np.ones((3, n))
        whole = pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars})
        for at in range(0, n if model else 0, 256):
            out[:, at : at + 256] = model.scores(*_views(whole.iloc[at : at + 256]))
        return pd.DataFrame({"text_score": out[0], "meta_score": out[1], "score": out[2]})

    return score


def scored(docs: DataFrame, model: CoTrained | None, text_col: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``_row`` with the whole row and ``_score`` with the three probabilities."""
    return docs.select(F.struct("*").alias("_row"), _scorer(model)(*_columns(docs, text_col, n_chars)).alias("_score"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, **how) -> DataFrame:  # noqa: ANN003
    """Per row: doc_id, text_score, meta_score, score, keep."""
    out = scored(docs, train(docs, labels, id_col, **how))
    return out.select(F.col(f"_row.`{id_col}`").alias("doc_id"), "_score.*", (F.col("_score.score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, **how) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` that pass."""
    return scored(docs, train(docs, labels, id_col, **how)).filter(F.col("_score.score") >= threshold).select("_row.*")
