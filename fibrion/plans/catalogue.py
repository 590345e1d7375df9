"""Every query of the engine over the driver's tables, with its SQL where SQL expresses it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import Settings, run_seed
from ..operators import simulate
from . import oracles, relations


def _relation(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relation(spark, name, sf_dir)


QUERIES = {name: partial(_relation, name) for name in relations.R if name not in relations.STEPS}
#: SQL written from the definitions where there is such (oracles), otherwise the relations' own text in DuckDB's dialect.
ORACLE_SQL = {name: relations.duckdb_sql(name) for name in QUERIES} | oracles.SQL


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")  # each vector stands for a molecule
    return v.select(F.col("vec_id").alias("mol"), F.transform("embedding", lambda x: 8.0 * x.cast("double")).alias("e"))


_SETTINGS = Settings(nucbp=10, llink=5, elink=0.5, mu=-1.0)


def _exact_occupancy(spark, sf_dir):
    solved = simulate.exact(_energies(spark, sf_dir), _SETTINGS)
    return solved.select("mol", F.posexplode("occupancy").alias("pos", "occ")).withColumn("occ", F.round("occ", 6))


def _exact_counts(spark, sf_dir):
    return simulate.exact(_energies(spark, sf_dir), _SETTINGS).select("mol", "status", *(F.round(c, 6).alias(c) for c in ("logz", "mean_n", "var_n")))


def _sampled(spark, sf_dir):
    return simulate.occupancy(simulate.samples(_energies(spark, sf_dir), _SETTINGS, 8, 1), 64, _SETTINGS.nucbp)


def _mcmc(spark, sf_dir):
    frames = simulate.trajectories(_energies(spark, sf_dir), _SETTINGS, 2, 1, 20, 2.0, 10)
    return frames.select("mol", "run", "time", "energy", "temp", F.size("positions").alias("n_nuc"))


def _mcmc_counts(spark, sf_dir):
    return simulate.mean_count(simulate.trajectories(_energies(spark, sf_dir), _SETTINGS, 2, 1, 20, 2.0, 10))


def _mcmc_occupancy(spark, sf_dir):
    return simulate.occupancy_at(simulate.trajectories(_energies(spark, sf_dir), _SETTINGS, 2, 1, 20, 2.0, 10), 64, _SETTINGS.nucbp)


_LONG = Settings(nucbp=147, llink=40, elink=0.5, mu=-1.0)


def _long_molecules(spark, sf_dir):
    """Molecules of 5,056 positions, from 79 vectors each (of the last one's too, if they are fewer)."""
    v = _energies(spark, sf_dir).groupBy(F.floor(F.col("mol") / 79).alias("mol")).agg(F.sort_array(F.collect_list(F.struct("mol", "e"))).alias("x"))
    return v.select("mol", F.flatten("x.e").alias("e")).where(F.size("e") >= 147)


def _exact_long(spark, sf_dir):
    return simulate.exact(_long_molecules(spark, sf_dir), _LONG).select("mol", "status", *(F.round(c, 6).alias(c) for c in ("logz", "mean_n", "var_n")))


def _mcmc_long(spark, sf_dir):
    frames = simulate.trajectories(_long_molecules(spark, sf_dir), _LONG, 5, 1, 1, 2.0, 1)
    return frames.select("mol", "run", "time", "energy", F.size("positions").alias("n_nuc"))


def _evidence(spark, sf_dir):
    found = simulate.llink_evidence(_energies(spark, sf_dir), _SETTINGS, list(range(0, 65, 5)))
    return found.withColumn("evidence", F.round("evidence", 6))


def _em(spark, sf_dir):
    return simulate.em_fit(relations.relation(spark, "window_counts", sf_dir)).select("chrom", "channel", "rate_prot", "rate_acc", "pi", "loglik")


def _channel_tests(spark, sf_dir):
    return simulate.em_fit(relations.relation(spark, "window_counts", sf_dir)).select("chrom", "channel", "margin", "contrast")


def _leak(spark, sf_dir):
    return simulate.leak_fit(relations.relation(spark, "window_counts", sf_dir))


def _nu(spark, sf_dir):
    return simulate.nu_fit(relations.relation(spark, "control_counts", sf_dir))


def _linkage_rows(spark, sf_dir):
    # 200 molecules with adjoining ids stand for a chromosome
    return _energies(spark, sf_dir).withColumn("chrom", F.floor(F.col("mol") / 200))


def _linkage(spark, sf_dir):
    return simulate.linkage_order(_linkage_rows(spark, sf_dir))


def _distances(spark, sf_dir):
    strips = simulate.distance_strips(_linkage_rows(spark, sf_dir))
    return strips.select("chrom", "rank", "strip", F.posexplode("distances").alias("i", "d")).select("chrom", "rank", (F.col("strip") * simulate.STRIP + F.col("i")).cast("long").alias("other"), F.round("d", 6).alias("d")).where("other < rank")


def _seeds(spark, sf_dir):
    seed = F.udf(lambda m: [run_seed(7, 0, m, r) for r in range(3)], "array<long>")  # one call a molecule
    return _energies(spark, sf_dir).select(F.col("mol"), F.posexplode(seed("mol")).alias("run", "seed"))


QUERIES |= {
    "exact_occupancy": _exact_occupancy, "exact_counts": _exact_counts, "sampled_occupancy": _sampled, "mcmc_summary": _mcmc, "mcmc_mean_count": _mcmc_counts, "mcmc_occupancy": _mcmc_occupancy, "exact_long": _exact_long, "mcmc_long": _mcmc_long,
    "llink_evidence": _evidence, "em_fit": _em, "channel_tests": _channel_tests, "leak_fit": _leak, "nu_fit": _nu, "linkage_order": _linkage, "distances": _distances, "seed_table": _seeds,
}
ORACLE_SQL["distances"] = """
WITH v AS (SELECT vec_id // 200 AS chrom, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY vec_id // 200 ORDER BY vec_id) - 1 AS rank FROM embeddings)
SELECT CAST(a.chrom AS BIGINT) AS chrom, a.rank, b.rank AS other, round(8 * list_distance(a.e, b.e), 6) AS d FROM v a JOIN v b ON a.chrom = b.chrom AND b.rank < a.rank"""
