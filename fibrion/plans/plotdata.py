"""The numbers behind the figures, as DataFrames of bounded size: heat maps are averaged into tiles before they leave the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiles(rows: DataFrame, value: Column, n_rows: int = 500, n_columns: int = 1000) -> DataFrame:
    """(chrom, mol_index, pos) with a value -> chrom, row, column, value, n: means over a grid of at most n_rows x n_columns
    tiles a chromosome; molecules and positions fall into tiles of equal width. Null values don't count."""
    sizes = rows.groupBy("chrom").agg((F.max("mol_index") + 1).alias("mols"), (F.max("pos") + 1).alias("width"))  # a row a chromosome
    tall, wide = F.greatest(F.ceil(F.col("mols") / n_rows), F.lit(1)), F.greatest(F.ceil(F.col("width") / n_columns), F.lit(1))
    placed = rows.withColumn("value", value).where("value is not null").join(sizes, "chrom")
    keys = ["chrom", F.floor(F.col("mol_index") / tall).alias("row"), F.floor(F.col("pos") / wide).alias("column")]
    return placed.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def meth_prob(prob: DataFrame, **grid: int) -> DataFrame:
    return tiles(prob, F.col("p"), **grid)


def meth_energy(prob: DataFrame, emax: float = 10.0, **grid: int) -> DataFrame:
    """Log odds of methylation, held within emax on both sides; places without a probability don't count."""
    odds = F.expr("ln(greatest(p, 1e-12) / greatest(1 - p, 1e-12))")
    return tiles(prob, F.when(F.col("p").isNotNull(), F.least(F.greatest(odds, F.lit(-emax)), F.lit(emax))), **grid)


def energy_track(frames: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """chrom, mol_index, run, time, energy, temp of the frames with start <= time <= end."""
    held = frames.where(F.col("time") >= start)
    return (held if end is None else held.where(F.col("time") <= end)).select("chrom", "mol_index", "run", "time", "energy", "temp")


def kymograph(frames: DataFrame, nucbp: int) -> DataFrame:
    """chrom, time, pos, n: molecules' runs that cover a position in a frame (positions that none covers are left out)."""
    covered = frames.select("chrom", "time", F.explode("positions").alias("at"))
    covered = covered.groupBy("chrom", "time", "at").agg(F.count("*").alias("n"))
    spread = covered.select("chrom", "time", "n", F.explode(F.sequence(F.col("at"), F.col("at") + nucbp - 1)).alias("pos"))
    return spread.groupBy("chrom", "time", "pos").agg(F.sum("n").alias("n"))


def occupancy(analysis: DataFrame, **grid: int) -> DataFrame:
    """Tiles of the exact occupancy; molecules without one are left out."""
    return tiles(analysis.select("chrom", "mol_index", F.posexplode("occupancy").alias("pos", "occ")), F.col("occ"), **grid)


def mean_by_position(rows: DataFrame, value: str) -> DataFrame:
    """chrom, pos, value, n: the track over a heat map."""
    return rows.groupBy("chrom", "pos").agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def downsample(rows: DataFrame, value: str, max_rows: int, how: str = "mean") -> DataFrame:
    """(chrom, mol_index, pos) with a value -> chrom, row, pos, value: at most `max_rows` rows a chromosome. mean, sum, min and
    max are over rows between the edges trunc(i n / max_rows), nulls left out; stride keeps every ceil(n / max_rows)-th row."""
    if how not in ("mean", "sum", "min", "max", "stride") or max_rows < 1:
        raise ValueError("how is mean, sum, min, max or stride, and max_rows at least 1")
    sizes = rows.groupBy("chrom").agg((F.max("mol_index") + 1).alias("n"))  # a row a chromosome
    placed = rows.join(sizes, "chrom")
    if how == "stride":
        step = F.ceil(F.col("n") / max_rows)
        return placed.where(F.col("mol_index") % step == 0).select("chrom", F.floor(F.col("mol_index") / step).alias("row"), "pos", F.col(value).alias("value"))
    place = F.when(F.col("n") <= max_rows, F.col("mol_index")).otherwise(F.ceil((F.col("mol_index") + 1) * max_rows / F.col("n")) - 1)
    total = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](value)
    return placed.groupBy("chrom", place.cast("long").alias("row"), "pos").agg(F.coalesce(total, F.lit(0.0)).alias("value") if how == "sum" else total.alias("value"))
