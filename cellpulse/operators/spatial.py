"""Grid geometry, distances and nearby landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.plans.dims import literal_table
from cellpulse.settings import PanelSpec

# The sixteen reference points of the city, in decimal degrees.
LANDMARKS = (
    ("Duomo", 45.4642, 9.1900, "historic centre"),
    ("Galleria Vittorio Emanuele II", 45.4659, 9.1899, "historic centre"),
    ("Teatro alla Scala", 45.4674, 9.1895, "historic centre"),
    ("Brera", 45.4719, 9.1881, "historic centre"),
    ("Milano Centrale station", 45.4857, 9.2040, "transport hub"),
    ("Porta Garibaldi station", 45.4848, 9.1875, "transport hub"),
    ("Porta Venezia", 45.4749, 9.2049, "inner ring"),
    ("Corso Buenos Aires", 45.4790, 9.2100, "retail"),
    ("Navigli", 45.4520, 9.1750, "nightlife"),
    ("Universita Bocconi", 45.4470, 9.1900, "university"),
    ("Politecnico, Citta Studi", 45.4780, 9.2270, "university"),
    ("Fiera Milano City / CityLife", 45.4780, 9.1560, "business / exhibition"),
    ("San Siro stadium", 45.4781, 9.1240, "stadium"),
    ("Porta Romana", 45.4497, 9.2043, "inner ring"),
    ("Lambrate", 45.4850, 9.2380, "outer district"),
    ("Bicocca", 45.5140, 9.2110, "university / outer"),
)


def landmarks(spark: SparkSession) -> DataFrame:
    return literal_table(spark, LANDMARKS, ("name", "latitude", "longitude", "kind"), ("string", "double", "double", "string"))


def grid_row(area: Column | str, side: int) -> Column:
    return F.floor((X.col(area) - 1) / side).cast("long")


def grid_col(area: Column | str, side: int) -> Column:
    return ((X.col(area) - 1) % side).cast("long")


def grid_position(cells: DataFrame, spec: PanelSpec) -> DataFrame:
    """Zero-based row and column, row-major; ids below 1 or beyond the grid get ``in_grid`` false."""
    return cells.select(
        "*",
        grid_row("area", spec.grid_side).alias("grid_row"),
        grid_col("area", spec.grid_side).alias("grid_col"),
        F.col("area").between(1, spec.grid_side**2).alias("in_grid"),
    )


def totals_grid(totals: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per grid row and one column per grid column, cells without data NULL."""
    placed = grid_position(totals.select("area", "total"), spec)
    return placed.groupBy("grid_row").pivot("grid_col", list(range(spec.grid_side))).agg(F.sum("total"))


def cell_centroid(ring_points: DataFrame) -> DataFrame:
    """Mean of the ring's vertices per cell, leaving out a closing vertex that repeats the first."""
    ends = ring_points.groupBy("cell_id").agg(
        F.min_by(F.struct("lon", "lat"), "pos").alias("_first"),
        F.max_by(F.struct("lon", "lat"), "pos").alias("_last"),
        F.sum("lon").alias("_lon"),
        F.sum("lat").alias("_lat"),
        F.count(F.lit(1)).alias("_n"),
    )
    closed = (F.col("_first") == F.col("_last")) & (F.col("_n") > 1)
    n = F.col("_n") - closed.cast("int")
    drop = closed.cast("int")
    return ends.select(
        "cell_id",
        ((F.col("_lat") - F.col("_last.lat") * drop) / n).alias("latitude"),
        ((F.col("_lon") - F.col("_last.lon") * drop) / n).alias("longitude"),
    )


def with_landmarks(cells: DataFrame, k: int = 3) -> DataFrame:
    """Add ``nearby``: the ``k`` closest landmarks as ``(metres, name, kind)``, nearest first.

    The sixteen points are constants, so each cell is handled where it is: no join and no shuffle.
    """
    points = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(la).alias("la"), F.lit(lo).alias("lo"), F.lit(kd).alias("kind")) for n, la, lo, kd in LANDMARKS]
    )
    measured = F.transform(
        points,
        lambda p: F.struct(
            X.haversine(F.col("latitude"), F.col("longitude"), p["la"], p["lo"]).alias("metres"),
            p["name"].alias("name"),
            p["kind"].alias("kind"),
        ),
    )
    return cells.withColumn("nearby", F.slice(F.array_sort(measured), 1, k))


def nearest_landmarks(cells: DataFrame, k: int = 3) -> DataFrame:
    """One row per cell and landmark rank."""
    return with_landmarks(cells, k).select(
        "area", F.posexplode("nearby").alias("i", "p")
    ).select("area", (F.col("i") + 1).alias("nearest_rank"), F.col("p.name").alias("name"), F.col("p.kind").alias("kind"), F.col("p.metres").alias("metres"))


def describe_cell(cells: DataFrame) -> DataFrame:
    """Rounded position, nearest landmark and a one-line context text."""
    text = F.transform(
        "nearby",
        lambda p: F.concat(p["name"], F.lit(" "), F.format_string("%.0f", p["metres"]), F.lit(" m")),
    )
    first = F.element_at("nearby", 1)
    return with_landmarks(cells).select(
        "area",
        F.round("latitude", 5).alias("latitude"),
        F.round("longitude", 5).alias("longitude"),
        first["name"].alias("nearest"),
        F.round(first["metres"], 0).cast("long").alias("nearest_m"),
        first["kind"].alias("nearest_kind"),
        F.array_join(text, "; ").alias("context"),
    )
