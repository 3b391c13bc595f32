"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into paragraphs: lines, and in long lines stretches up to a sentence end. Each paragraph's 62-bit digest is added to one cell
in each of three subtables. A cell holds four sums: how many digests, their upper and lower halves, and a check value. Sketches of one size
subtract cell by cell; what two versions share cancels. Peeling recovers the rest: a cell whose sums are a multiple of one digest
gives that digest and how often it is more frequent in the one version, and it is taken out of its other cells. Subtables take turns, so
no digest is taken out twice. Sums, unlike xor, keep repeated paragraphs apart from absent ones. If cells are left over, the
pair is tried again with a larger sketch under another seed, large enough for all paragraphs of both versions.

The likeness of two versions is the Jaccard similarity of their bags of paragraphs: with d differing ones, (a + b - d) / (a + b + d).

Plan: sketches of all versions of a row are aggregated where the row lies (the rows are dealt by row number once, as digests,
and every later grouping is by that number and more), so neither the cells nor the rounds of peeling are shuffled.

Defined cases: a null text is empty and has no paragraph; two empty texts are alike (1.0), an empty and another are not (0.0). A very long text
is one row of digests, eight bytes for about 100 characters; its cells are rows. Repeated rows and equal ids: the order is by id, then by the hash
of the text; the rows of one id follow each other. A null id comes last. Ids are whole numbers. A table of one row is its own next.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import partitions, whole_text
from cellpulse.plans.storage import durable

PARAGRAPH = r"[^\n]{96,320}?[.!?]+(?=\s)\s?|[^\n]{1,320}\n*|\n+"
CELLS = 36
SUBTABLES = 3
STEPS = 12
SPARE = 1.7
BUCKET_ROWS = 512
MAX_BUCKETS = 65_536
HALF = 2**31 - 1
LEAST = -(2**63)
LEFT = "n <> 0 OR hi <> 0 OR lo <> 0 OR chk <> 0"


def digests(text: Column, paragraph: str = PARAGRAPH) -> Column:
    """The digest of each paragraph, in order, repeats included; all paragraphs together are the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(paragraph), F.lit(0)), lambda p: F.xxhash64(p))


def _check(hi: str, lo: str) -> str:
    return f"(xxhash64({hi}, {lo}, 'check') & {HALF}L)"


def _cell(hi: str, lo: str, subtable: int) -> str:
    """The digest's cell in one of the three equal parts of a sketch."""
    width = f"(size div {SUBTABLES})"
    return f"(pmod(xxhash64({hi}, {lo}, {subtable}, seed), {width}) + {width} * {subtable})"


def sketch_cells(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, size, seed, cell, n, hi, lo, chk from rows of ``keys``, size, seed, sign, digest; cells that cancel are left out."""
    one = parts.selectExpr(*keys, "size", "seed", "sign", "shiftrightunsigned(digest, 33) AS hi", f"digest & {HALF}L AS lo")
    cells = ", ".join(_cell("hi", "lo", j) for j in range(SUBTABLES))
    spread = one.selectExpr(*keys, "size", "seed", "sign", "hi", "lo", f"{_check('hi', 'lo')} AS chk", f"explode(array({cells})) AS cell")
    sums = [F.sum("sign").alias("n"), *[F.expr(f"sum(sign * {c}) AS {c}") for c in ("hi", "lo", "chk")]]
    return spread.groupBy(*keys, "size", "seed", "cell").agg(*sums).filter(LEFT)


def peel(cells: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """What the difference of two sketches gives: rows of ``keys`` with a digest and its signed count ``n``, and rows with a null digest
    for the cells that are left over.

    Every step looks at one subtable. A row there that holds one digest becomes three: the digest, and its opposite for the other two cells.
    """
    fixed = [*keys, "size", "seed"]
    state = cells.selectExpr(*fixed, "named_struct('cell', cell, 'digest', CAST(NULL AS long), 'n', n, 'hi', hi, 'lo', lo, 'chk', chk) AS r")
    for step in range(steps):
        j = step % SUBTABLES
        single = f"""digest IS NULL AND n <> 0 AND x BETWEEN 0 AND {HALF} AND y BETWEEN 0 AND {HALF} AND x * n = hi AND y * n = lo
            AND chk = n * {_check("x", "y")} AND cell = {_cell("x", "y", j)}"""
        opposite = ", ".join(
            f"named_struct('cell', {_cell('x', 'y', k)}, 'digest', CAST(NULL AS long), 'n', -n, 'hi', -hi, 'lo', -lo, 'chk', -chk)"
            for k in range(SUBTABLES)
            if k != j
        )
        found = "named_struct('cell', -1L, 'digest', shiftleft(x, 33) | y, 'n', n, 'hi', hi, 'lo', lo, 'chk', chk)"
        kept = "named_struct('cell', cell, 'digest', digest, 'n', n, 'hi', hi, 'lo', lo, 'chk', chk)"
        state = (
            state.selectExpr(*fixed, "r.*", "r.hi div nullif(r.n, 0) AS x", "r.lo div nullif(r.n, 0) AS y")
            .selectExpr(*fixed, f"explode(CASE WHEN {single} THEN array({found}, {opposite}) ELSE array({kept}) END) AS r")
            .groupBy(*fixed, F.expr("r.cell AS cell"), F.expr("r.digest AS digest"))
            .agg(*[F.expr(f"sum(r.{c}) AS {c}") for c in ("n", "hi", "lo", "chk")])
            .selectExpr(*fixed, "named_struct('cell', cell, 'digest', digest, 'n', n, 'hi', hi, 'lo', lo, 'chk', chk) AS r")
        )
    return state.selectExpr(*keys, "r.*").filter(LEFT).select(*keys, "digest", "n")


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the text of the next row by descending id; after the last comes the first.

    Some rows, drawn by hash, are the first ones of buckets. Such a row goes to its own bucket, and as a guest to the end of the bucket before, so
    a window over buckets finds every row's next one, and texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(LEAST)).alias("_k"), F.xxhash64("text").alias("_h"))
    total = docs.count()
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    drawn = F.pmod(F.xxhash64("_k", "_h", F.lit("bucket")), F.lit(max(1, total // buckets))) == 0
    heads = rows.select("_k", "_h")
    points = {(r[0], r[1]) for r in heads.filter(drawn).distinct().collect()} if buckets > 1 else set()
    first = heads.orderBy(F.desc("_k"), F.desc("_h")).first()
    points = sorted(points | ({(first[0], first[1])} if first else set()), reverse=True)
    # the points as two folded constants; a row's bucket is the last point not before it
    ks, hs = (F.split(F.lit(",".join(str(p[c]) for p in points or [(0, 0)])), ",").cast("array<bigint>") for c in (0, 1))
    widths = [2**i for i in reversed(range(len(points).bit_length()))]

    def step(low: Column, w: Column) -> Column:
        k, h = F.get(ks, low + w), F.get(hs, low + w)
        return F.when((k > F.col("_k")) | ((k == F.col("_k")) & (h >= F.col("_h"))), low + w).otherwise(low)

    bucket = F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), step) if points else F.lit(0)
    placed = rows.withColumn("_bucket", bucket)
    is_head = (F.get(ks, F.col("_bucket")) == F.col("_k")) & (F.get(hs, F.col("_bucket")) == F.col("_h"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(max(1, len(points)))).alias("b"), F.lit(True).alias("guest"))
    placed = placed.select("doc_id", "text", "_k", "_h", F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))).alias("_at"))
    order = Window.partitionBy("_at.b").orderBy("_at.guest", F.col("doc_id").isNull(), F.desc("_k"), F.desc("_h"))
    return placed.select("doc_id", "text", F.lead("text").over(order).alias("next_text"), F.col("_at.guest").alias("guest")).filter("not guest").drop("guest")


def edited_version(text: Column, next_text: Column) -> Column:
    """The text whose last floor(n / 2) code points are replaced by as many first ones of the next text, or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def differences(versions: DataFrame, cells: int = CELLS) -> DataFrame:
    """``_row``, ``pair`` and the number ``d`` of differing paragraphs, from rows of ``_row``, ``pair`` and the digest arrays ``own`` and ``other``.

    The first try has ``cells`` cells, the second ``SPARE`` for each paragraph of both versions, the further ones half as much again each time.
    """
    keys = ["_row", "pair"]
    amount = F.size("own") + F.size("other")
    left, done, attempt = versions, None, 0
    while True:
        wanted = F.ceil(F.lit(SPARE * 1.5 ** (attempt - 1)) * amount) + cells if attempt else F.lit(cells)
        size = (F.floor(wanted / SUBTABLES) * SUBTABLES).cast("long")
        sized = left.select(*keys, size.alias("size"), F.lit(attempt).alias("seed"), "own", "other")
        both = F.concat(
            F.transform("own", lambda x: F.struct(x.alias("digest"), F.lit(1).cast("long").alias("sign"))),
            F.transform("other", lambda x: F.struct(x.alias("digest"), F.lit(-1).cast("long").alias("sign"))),
        )
        parts = sized.repartition(partitions(versions), "_row").select(*keys, "size", "seed", F.explode(both).alias("_p"))
        parts = parts.select(*keys, "size", "seed", "_p.*")
        # a pair whose sketches cancel has no row left; it differs nowhere
        peeled = peel(sketch_cells(parts, keys), keys)
        found = peeled.groupBy(*keys).agg(F.sum(F.when(F.col("digest").isNotNull(), F.abs("n"))).alias("d"), F.max(F.col("digest").isNull()).alias("_failed"))
        judged = durable(found, "peeled")
        solved = judged.filter("not _failed").select(*keys, "d")
        done = solved if done is None else done.unionByName(solved)
        failed = judged.filter("_failed").select(*keys)
        if failed.isEmpty():
            return done
        left = left.join(failed, keys, "left_semi")
        attempt += 1


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraph: str = PARAGRAPH, cells: int = CELLS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the numbers of differing
    paragraphs ``differing_edited`` and ``differing_next``.

    A fingerprint lists the cells of the sketch in order, each as count, upper and lower half sum and check sum, in hexadecimal.
    """
    rows = _in_order(docs, id_col, text_col).withColumn("_edited", edited_version(F.col("text"), F.col("next_text")))
    hashed = durable(
        rows.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            digests(F.col("text"), paragraph).alias("own"), digests(F.col("_edited"), paragraph).alias("edited"), digests(F.col("next_text"), paragraph).alias("next"),
        ),
        "versions",
    )
    pairs = hashed.select("_row", "own", F.explode(F.create_map(F.lit("edited"), F.col("edited"), F.lit("next"), F.col("next"))).alias("pair", "other"))
    found = differences(pairs, cells)
    apart = found.groupBy("_row").agg(*[F.max(F.when(F.col("pair") == p, F.col("d"))).alias(f"_d_{p}") for p in ("edited", "next")])
    shown = fingerprint_strings(hashed, cells)
    sizes = hashed.select("_row", "doc_id", "n_chars", "edited_sha256", *[F.size(c).cast("long").alias(f"_n_{c}") for c in ("own", "edited", "next")])
    joined = sizes.join(shown, "_row", "left").join(apart, "_row", "left")

    def likeness(pair: str) -> Column:
        both, d = F.col("_n_own") + F.col(f"_n_{pair}"), F.coalesce(F.col(f"_d_{pair}"), F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    blank = ";" * (cells // SUBTABLES * SUBTABLES - 1)
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        F.coalesce("fingerprint", F.lit(blank)).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit(blank)).alias("edited_fingerprint"),
        likeness("edited").alias("near_edited"), likeness("next").alias("near_next"),
        F.coalesce("_d_edited", F.lit(0).cast("long")).alias("differing_edited"), F.coalesce("_d_next", F.lit(0).cast("long")).alias("differing_next"),
    )


def fingerprint_strings(hashed: DataFrame, cells: int = CELLS) -> DataFrame:
    """``_row``, fingerprint and edited_fingerprint from the digest arrays ``own`` and ``edited``."""
    size = cells // SUBTABLES * SUBTABLES
    versions = F.create_map(F.lit("own"), F.col("own"), F.lit("edited"), F.col("edited"))
    dealt = hashed.select("_row", "own", "edited").repartition(partitions(hashed), "_row")
    each = dealt.select("_row", F.explode(versions).alias("version", "_d")).select("_row", "version", F.explode("_d").alias("digest"))
    parts = each.select("_row", "version", F.lit(size).cast("long").alias("size"), F.lit(0).alias("seed"), F.lit(1).cast("long").alias("sign"), "digest")
    shown = F.concat_ws(",", *[F.lower(F.hex(c)) for c in ("n", "hi", "lo", "chk")])
    cell = sketch_cells(parts, ["_row", "version"]).select("_row", "version", F.struct(F.col("cell").cast("int").alias("cell"), shown.alias("s")).alias("_c"))

    def text(version: str) -> Column:
        filled = F.map_from_entries(F.collect_list(F.when(F.col("version") == version, F.col("_c"))))
        return F.concat_ws(";", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(filled, i), F.lit(""))))

    return cell.groupBy("_row").agg(text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"))
