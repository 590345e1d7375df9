"""A dataset of runs: energies, seeds, configurations and what is computed from them, in one folder of Parquet tables.

Tables: energies (chrom, mol, e), runs (tm: chrom, mol_index, run, status, seed, energy, positions; mcmc: chrom, mol_index, run,
time, energy, temp, positions) and what `put` stores. `meta` holds the settings; entries that older folders lack take their
defaults."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import Settings, run_seed
from ..operators import simulate
from ..shipping import ship
from . import files

DEFAULTS = {"method": "tm", "nsim": 0, "seed": 0, "nsweep": 0, "start_temp": 1.0, "freq": 1, "cooling": "linear"}
_SHIFT = 1 << 40


class Dataset:
    def __init__(self, spark: SparkSession, path: str, chroms: list[str] | None = None):
        """Opens the folder; `chroms` limits every table (unknown ones raise ValueError)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = DEFAULTS | json.loads(files.read_text(spark, f"{self.path}/meta.json"))
        if chroms is not None and set(chroms) - set(self.meta["chroms"]):
            raise ValueError(f"unknown chromosomes: {sorted(set(chroms) - set(self.meta['chroms']))}")
        self.all, self.chroms = self.meta["chroms"], list(chroms or self.meta["chroms"])
        s = dict(self.meta["settings"])
        s["llink"] = dict(map(tuple, s["llink"])) if isinstance(s["llink"], list) else s["llink"]
        self.settings = Settings(**s)

    @classmethod
    def create(cls, spark: SparkSession, path: str, energies: DataFrame, chroms: list[str], settings: Settings, method: str = "tm", nsim: int = 0, seed: int = 0, nsweep: int = 1000, start_temp: float = 1.0, freq: int = 1, cooling: str = "linear") -> Dataset:
        """A new folder (it must not exist) with the energies (chrom, mol, e); a failure removes it. mcmc needs a run at least,
        tm none, and every chromosome a linker range."""
        if files.exists(spark, path):
            raise FileExistsError(path)
        if method not in ("tm", "mcmc") or nsim < (method == "mcmc"):
            raise ValueError("method is tm or mcmc, with one run at least for mcmc and none at least for tm")
        lacking = [] if isinstance(settings.llink, int) else sorted(set(chroms) - set(dict(settings.llink)))
        if lacking:
            raise ValueError(f"no linker range for {lacking}")
        try:
            energies.write.partitionBy("chrom").parquet(f"{path}/energies")
            kept = spark.read.schema(energies.schema).parquet(f"{path}/energies")
            if kept.isEmpty():
                raise ValueError("no molecules")
            meta = {"chroms": list(chroms), "settings": asdict(settings), "method": method, "nsim": nsim, "seed": seed, "nsweep": nsweep, "start_temp": start_temp, "freq": freq, "cooling": cooling}
            files.write_json(spark, f"{path}/meta.json", meta)
        except BaseException:
            files.remove(spark, path)
            raise
        return cls(spark, path)

    def table(self, name: str) -> DataFrame:
        out = self.spark.read.parquet(f"{self.path}/{name}")
        return out.withColumn("chrom", F.col("chrom").cast("string")).where(F.col("chrom").isin(self.chroms)) if "chrom" in out.columns else out

    def has(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.path}/{name}/_SUCCESS")

    def put(self, name: str, rows: DataFrame, overwrite: bool = False) -> DataFrame:
        """Stores a derived table, as an experiment does."""
        if self.has(name) and not overwrite:
            raise FileExistsError(f"{name} exists")
        new = f"{self.path}/_new-{name}"
        rows.write.mode("overwrite").parquet(new)
        files.replace(self.spark, new, f"{self.path}/{name}")
        return self.table(name)

    def save(self, path: str, overwrite: bool = False) -> Dataset:
        """A copy of the opened chromosomes at `path` (never onto itself)."""
        path = path.rstrip("/")
        if path == self.path:
            raise ValueError("a dataset can't be saved onto itself")
        if files.exists(self.spark, path) and not overwrite:
            raise FileExistsError(path)
        new = f"{path}-new"
        files.remove(self.spark, new)
        for name in files.folders(self.spark, self.path):
            self.table(name).write.parquet(f"{new}/{name}")
        files.write_json(self.spark, f"{new}/meta.json", self.meta | {"chroms": self.chroms})
        files.replace(self.spark, new, path)
        return Dataset(self.spark, path)

    def _numbered(self, rows: DataFrame, mol: str) -> DataFrame:
        place = F.array_position(F.array(*map(F.lit, self.all)), F.col("chrom")) - 1
        return rows.withColumn("mol", place * F.lit(_SHIFT) + F.col(mol))

    def _named(self, rows: DataFrame) -> DataFrame:
        chrom = F.element_at(F.array(*map(F.lit, self.all)), F.expr(f"cast(mol div {_SHIFT} + 1 as int)"))
        return rows.select(chrom.alias("chrom"), (F.col("mol") % _SHIFT).alias("mol_index"), *[c for c in rows.columns if c not in ("mol", "chrom")])

    def _each(self, rows: DataFrame, kernel: Callable[[DataFrame, Settings], DataFrame]) -> DataFrame:
        by: dict[Settings, list[str]] = {}
        for c in self.chroms:
            by.setdefault(self.settings.of(c), []).append(c)
        return self._named(reduce(DataFrame.unionByName, [kernel(rows.where(F.col("chrom").isin(cs)), s) for s, cs in by.items()]))

    def seed_table(self) -> DataFrame:
        """chrom, mol_index, run, seed of every run, whether it was asked for or not."""
        master, nsim = self.meta["seed"], self.meta["nsim"]
        ship(self.spark)
        seeds = F.udf(lambda m: [run_seed(master, 0, m, r) for r in range(nsim)], "array<long>")  # one call a molecule
        return self._named(self._numbered(self.table("energies").select("chrom", "mol"), "mol").select("mol", F.posexplode(seeds("mol")).alias("run", "seed")))

    def _made(self, wanted: DataFrame, seed: int) -> DataFrame:
        """The runs of (chrom, mol_index, run)."""
        m = self.meta
        e = self._numbered(self.table("energies"), "mol")
        rows = self._numbered(wanted, "mol_index").select("mol", "run").join(e, "mol").select("chrom", "mol", "run", "e")
        if m["method"] == "tm":
            return self._each(rows, lambda r, s: simulate.sampled_runs(r, s, seed))
        return self._each(rows, lambda r, s: simulate.trajectory_runs(r, s, seed, m["nsweep"], m["start_temp"], m["freq"], m["cooling"]))

    def expected(self, mols: list[int] | None = None) -> DataFrame:
        """chrom, mol_index, run of all runs (of some molecules)."""
        rows = self.table("energies").select("chrom", F.col("mol").alias("mol_index"))
        rows = rows if mols is None else rows.where(F.col("mol_index").isin(list(mols)))
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.meta["nsim"] - 1))).alias("run")) if self.meta["nsim"] else rows.withColumn("run", F.lit(0)).where("false")

    def run(self, mols: list[int] | None = None) -> DataFrame:
        """Stores the runs of all molecules, or of some."""
        return self.put("runs", self._made(self.expected(mols), self.meta["seed"]), overwrite=True)

    def status(self) -> DataFrame:
        """chrom, mol_index, run, status of every expected run: complete, truncated (mcmc: fewer frames than its sweeps give),
        corrupted (null configurations that its energies don't explain), no_energy, missing."""
        runs, m = self.table("runs"), self.meta
        frames = m["nsweep"] // m["freq"] + 1 if m["method"] == "mcmc" else 1
        held = runs.groupBy("chrom", "mol_index", "run").agg(F.count("*").alias("n"), F.count("positions").alias("known"))
        reach = self.table("energies").select("chrom", F.col("mol").alias("mol_index"), (~F.exists(F.slice("e", F.lit(1), F.greatest(F.size("e") - self.settings.nucbp + 1, F.lit(0))), lambda x: x.isNull())).alias("usable"))
        rows = self.expected().join(held, ["chrom", "mol_index", "run"], "left").join(reach, ["chrom", "mol_index"])
        status = F.when(~F.col("usable"), "no_energy").when(F.col("n").isNull(), "missing").when(F.col("known") < F.col("n"), "corrupted").when(F.col("n") < frames, "truncated").otherwise("complete")
        return rows.select("chrom", "mol_index", "run", status.alias("status"))

    def incomplete(self) -> DataFrame:
        return self.status().where("status not in ('complete', 'no_energy')").select("chrom", "mol_index", "run")

    def rerun(self, only: DataFrame | None = None, seed: int | None = None) -> DataFrame:
        """Makes incomplete runs, or the given ones (chrom, mol_index, run), anew: as in a whole run, or from another seed."""
        wanted = (only if only is not None else self.incomplete()).select("chrom", "mol_index", "run").distinct()
        have = self.table("runs").join(wanted, ["chrom", "mol_index", "run"], "left_anti")
        return self.put("runs", have.unionByName(self._made(wanted, self.meta["seed"] if seed is None else seed)), overwrite=True)

    def runs(self) -> DataFrame:
        """The (chrom, mol_index, run) that there are."""
        return self.table("runs").select("chrom", "mol_index", "run").distinct()

    def at(self, chrom: str, mol: int, run: int, time: int | None = None) -> list:
        """The stored rows of a run, or its frame at a time."""
        rows = self.table("runs").where((F.col("chrom") == chrom) & (F.col("mol_index") == mol) & (F.col("run") == run))
        return rows.where(F.col("time") == time).collect() if time is not None else rows.collect()

    def extract(self, aggregate: Callable[[str, int, pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None, time: int | None = None) -> DataFrame:
        """The stored rows (at a time), or a user's aggregate `aggregate(chrom, mol, frames)` over the runs of each molecule that
        there are, with rows of `schema`."""
        rows = self.table("runs") if time is None else self.table("runs").where(F.col("time") == time)
        if (aggregate is None) != (schema is None):
            raise TypeError("an aggregate and its schema go together")
        if aggregate is None:
            return rows
        names = self.all
        return simulate.extract(self._numbered(rows, "mol_index").drop("chrom", "mol_index"), lambda mol, b: aggregate(names[mol // _SHIFT], mol % _SHIFT, b), schema)

    def analyze(self, time: int | None = None, name: str = "analysis") -> DataFrame:
        """Stores occupancy and mean number of nucleosomes of every molecule with their variances: exact (tm), or at a time (the
        last frame) over the runs that there are (mcmc, without variances; null where a molecule has no run)."""
        e = self._numbered(self.table("energies"), "mol")
        if self.meta["method"] == "tm":
            if time is not None:
                raise ValueError("exact results have no time")
            return self.put(name, self._each(e, simulate.exact), overwrite=True)
        frames = self._numbered(self.table("runs"), "mol_index").select("mol", "run", "time", "positions")
        width = e.agg(F.max(F.size("e"))).first()[0]
        occ = simulate.occupancy_at(frames, width, self.settings.nucbp, time)
        occ = occ.groupBy("mol").agg(F.sort_array(F.collect_list(F.struct("pos", "occ"))).alias("x")).select("mol", F.col("x.occ").alias("occupancy"))
        rows = e.select("mol", F.size("e").alias("nbp")).join(occ, "mol", "left").join(simulate.mean_count(frames, time), "mol", "left")
        return self.put(name, self._named(rows.select("mol", F.expr("slice(occupancy, 1, nbp)").alias("occupancy"), "mean_n", "runs")), overwrite=True)

    def access(self, name: str = "analysis") -> DataFrame:
        """chrom, mol_index, access: one less the occupancy."""
        return self.table(name).select("chrom", "mol_index", F.transform("occupancy", lambda x: F.lit(1.0) - x).alias("access"))
