"""Token counts per section, by attributing the tokens of whole documents.

A document is encoded once, as a whole, so the counts of its sections add up to its own count, which encoding each section by
itself would not give. Tokens have character spans. The spans of tokens and sections are joined as intervals where the document lies, by
binary search over both ordered lists. A token that reaches over a boundary goes, under the rule ``start``, to the section with
its first character; under ``most``, to the section with most of its characters, the earlier one of equals; under ``split``, to
every section it touches, in proportion to the characters there.

Sections are what lies between separators (a pattern; the separator belongs to the section before it), or spans that the caller has in a
column. Characters outside all sections count for section −1.

Defined cases: a null text is empty; an empty text is one empty section without tokens; repeated rows are counted once each; bytes of
one character that are spread over several tokens all have the span of that character; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.bpe import Encoder, encoder
from cellpulse.llm.common import whole_text

RULES = ("start", "most", "split")
LINE = r"\n+"


def token_spans(enc: Encoder, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the first character and the end of each token."""
    ids = enc.ids(text)
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(enc.byte_lengths[ids])
    if len(ids) and ends[-1] != len(raw):
        raise ValueError("the tokenizer does not keep all bytes; its tokens have no spans")
    # number of the character that each byte belongs to, by counting the bytes that begin one
    owner = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return ids, owner[starts] if len(ids) else starts[:0], owner[ends - 1] + 1 if len(ids) else ends


def sections_between(text: str, separator: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends; a separator at the end of the text opens no further section."""
    cuts = [m.end() for m in separator.finditer(text) if m.end() > m.start()]
    starts = [0, *(c for c in cuts if c < len(text))]
    return np.array(starts, np.int64), np.array([*starts[1:], len(text)], np.int64)


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, float, int]:
    """Tokens per section, tokens outside all sections, and how many tokens touch a boundary; sections are in order and apart."""
    n = len(starts)
    out = np.zeros(n + 1)
    low = np.searchsorted(ends, first, side="right")
    high = np.searchsorted(starts, end, side="left") - 1
    inside = (low == high) & (low < n)
    inside[inside] = (first[inside] >= starts[low[inside]]) & (end[inside] <= ends[low[inside]])
    out += np.bincount(low[inside], minlength=n + 1)
    crossing = np.flatnonzero(~inside)
    for t in crossing:
        a, b, width = first[t], end[t], end[t] - first[t]
        touched = {int(s): min(b, ends[s]) - max(a, starts[s]) for s in range(low[t], high[t] + 1) if min(b, ends[s]) > max(a, starts[s])}
        apart = width - sum(touched.values())
        if rule == "split":
            for s, part in touched.items():
                out[s] += part / width
            out[n] += apart / width
        elif rule == "most":
            best = min(touched, key=lambda s: (-touched[s], s), default=n)
            out[n if apart > touched.get(best, 0) else best] += 1
        else:
            out[next((s for s in touched if starts[s] <= a), n)] += 1
    return out[:n], float(out[n]), len(crossing)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    rule: str = "start",
    separator: str = LINE,
    spans_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens, and for the document doc_tokens and doc_crossing.

    ``spans_col`` names an ``array<struct<start:int,end:int>>`` of spans in order and apart; without it the separator makes the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spans = F.col(spans_col) if spans_col else F.lit(None).cast("array<struct<start:int,end:int>>")
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), spans.alias("spans"))
    pattern = re.compile(separator)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row, parts = [], []
            for k, (text, given) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                ids, first, end = token_spans(enc, text)
                if spans_col:
                    starts = np.array([s["start"] for s in given or ()], np.int64)
                    ends = np.array([s["end"] for s in given or ()], np.int64)
                else:
                    starts, ends = sections_between(text, pattern)
                tokens, outside, crossing = attribute(first, end, starts, ends, rule)
                number = np.arange(len(starts))
                if outside:
                    number, starts, ends, tokens = np.append(number, -1), np.append(starts, -1), np.append(ends, -1), np.append(tokens, outside)
                row.append(np.full(len(number), k))
                parts.append((number, starts, ends, tokens, np.full(len(number), len(ids)), np.full(len(number), crossing)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            names = (("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("doc_tokens", pa.int64()), ("doc_crossing", pa.int64()))
            arrays = {name: pa.array(c, kind) for (name, kind), c in zip(names, columns, strict=True)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(np.concatenate(row)))} | arrays)

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, section int, start long, end long, n_tokens double, doc_tokens long, doc_crossing long")
