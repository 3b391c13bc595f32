"""Secrets in texts, by rules and by character Markov models, in DataFrame functions only.

The rules find assignments to telling names, access keys and long hexadecimal runs. Besides them, any long run of key characters with a letter
among them is a candidate: two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are
compared by the logarithm of their likelihood ratio, and a run that is far likelier random is a secret too. The models are trained
from labelled samples. Where none are given, what the rules found is labelled random and the remaining words of a
bounded number of documents are labelled ordinary. A model is a table of a few thousand numbers, whatever the input.

Positions count code points, ends are exclusive. Defined cases: a null text is empty; a table without a single rule hit has a random model that is
uniform; repeated rows get equal results; one row comes out for each row that goes in.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import whole_text
from cellpulse.plans.storage import durable

# The rules, with the least number of characters of their value
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
RULES = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))

KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(KEY_CHARACTERS) + 1
CANDIDATE = r"([A-Za-z0-9+/_=-]{16,})"
WORD = r"([A-Za-z0-9+/_=-]{4,})"
KINDS = (*(kind for kind, _, _ in RULES), "markov")

MAX_RANDOM = 20_000
MAX_DOCUMENTS = 1_000
UNIFORM_SHARE = 0.3
SMOOTHING = 0.1
MARGIN = 4.0


def _spans(text: Column, pattern: str, kind: int, least: int) -> Column:
    """All matches as (start, kind, end, value) where the value, group 1, is long enough.

    Splitting by the pattern gives the gaps between the very matches that extraction gives, so their lengths add up to positions.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value"))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,value:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        out = F.when(F.length(x["value"]) >= least, F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), out.alias("found"))

    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the rules' spans in order, and the candidate runs that touch none of them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    found = rows.select(
        "doc_id",
        F.array_sort(F.concat(*[_spans(F.col("text"), p, k, n) for k, (_, p, n) in enumerate(RULES)])).alias("base"),
        _spans(F.col("text"), CANDIDATE, len(RULES), 16).alias("runs"),
    )
    touches = lambda run: F.exists("base", lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return found.select("doc_id", "base", F.filter("runs", lambda r: r["value"].rlike("[A-Za-z]") & ~touches(r)).alias("runs"))


def samples_by_rule(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples (value, random): at most ``MAX_RANDOM`` rule hits and the words of ``MAX_DOCUMENTS`` documents."""
    random = found.select(F.explode("base").alias("b")).select(F.col("b.value").alias("value"))
    random = random.orderBy(F.xxhash64("value"), "value").limit(MAX_RANDOM).withColumn("random", F.lit(True))
    ids = docs.select(F.col(id_col).alias("_id")).filter("_id is not null")
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(MAX_DOCUMENTS).distinct()
    rest = whole_text(text_col)
    for _, pattern, _ in RULES:
        rest = F.regexp_replace(rest, pattern, " ")
    some = docs.select(F.col(id_col).alias("_id"), rest.alias("_rest")).join(F.broadcast(ids), "_id", "left_semi")
    words = some.select(F.explode(F.regexp_extract_all("_rest", F.lit(WORD), F.lit(1))).alias("value"))
    return random.unionByName(words.withColumn("random", F.lit(False)))


def _states(value: Column) -> Column:
    """The number of each character; 0 is the state before the first and any other character."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(KEY_CHARACTERS), c))


def log_ratios(samples: DataFrame) -> list[float]:
    """Per pair of states, log of the likelihood ratio of random to ordinary; the counts are at most two per pair."""
    states = samples.select("random", _states(F.col("value")).alias("now"))
    pairs = states.select("random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("now")).alias("before"), F.col("now").alias("now"))).alias("p"))
    counted = pairs.select("random", "p.before", "p.now").filter("now is not null").groupBy("random", "before", "now").count().collect()
    n = {(r["random"], r["before"], r["now"]): r["count"] for r in counted}
    total = {(kind, a): sum(n.get((kind, a, b), 0) for b in range(STATES)) for kind in (True, False) for a in range(STATES)}
    share = lambda kind, a, b: (n.get((kind, a, b), 0) + SMOOTHING) / (total[kind, a] + SMOOTHING * STATES)
    mixed = lambda a, b: (1 - UNIFORM_SHARE) * share(True, a, b) + UNIFORM_SHARE / STATES
    return [math.log(mixed(a, b) / share(False, a, b)) for a in range(STATES) for b in range(STATES)]


def likelihood_ratio(value: Column, ratios: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def add(state: Column, now: Column) -> Column:
        return F.struct((state["sum"] + F.get(table, state["before"] * STATES + now)).alias("sum"), now.alias("before"))

    return F.aggregate(_states(value), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("before")), add, lambda s: s["sum"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """Per row: doc_id and ``spans``, structs of start, kind (a place in ``KINDS``), end, value and score (null for rules)."""
    found = durable(hits(docs, id_col, text_col), "hits")
    ratios = log_ratios(samples if samples is not None else samples_by_rule(docs, found, id_col, text_col))
    with_score = lambda s, score: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))
    scored = F.transform("runs", lambda r: with_score(r, likelihood_ratio(r["value"], ratios)))
    random = F.filter(scored, lambda r: r["score"] > margin)
    base = F.transform("base", lambda b: with_score(b, F.lit(None).cast("double")))
    return found.select("doc_id", F.array_sort(F.concat(base, random)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_markov."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(RULES))
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(RULES)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(len(RULES)).alias("n_markov"),
    )
