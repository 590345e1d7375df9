"""An experiment: the calls of up to three samples with their molecules, chromosomes and derived tables, in one folder of Parquet tables.

Tables: sizes (chrom, length, nbp), sequences (chrom, seq), molecules (source, chrom, mol, mol_index, strand), calls
(source, chrom, mol, pos, strand, q; dealt by source and chrom) and what `put` stores. `meta` holds the load's settings."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import relations
from . import files

SOURCES = ("test", "meth", "unmeth")
CHANNELS = {"A": (1,), "CG": (3, 4), "GC": (2, 4)}  # fixed values: contexts that an enzyme reads


class Experiment:
    def __init__(self, spark: SparkSession, path: str, chroms: list[str] | None = None):
        """Opens the folder; `chroms` limits every table (unknown ones raise ValueError)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = json.loads(files.read_text(spark, f"{self.path}/meta.json"))
        known = sorted(r[0] for r in spark.read.parquet(f"{self.path}/sizes").select("chrom").collect())
        if chroms is not None and set(chroms) - set(known):
            raise ValueError(f"unknown chromosomes: {sorted(set(chroms) - set(known))}")
        self.chroms = known if chroms is None else list(chroms)

    def table(self, name: str) -> DataFrame:
        out = self.spark.read.parquet(f"{self.path}/{name}")
        return out.where(F.col("chrom").isin(self.chroms)) if "chrom" in out.columns else out

    def has(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.path}/{name}/_SUCCESS")

    def put(self, name: str, rows: DataFrame, overwrite: bool = False) -> DataFrame:
        """Stores a derived table: written beside, then put in the old one's place by renaming; a failure leaves the old one."""
        if self.has(name) and not overwrite:
            raise FileExistsError(f"{name} exists")
        new = f"{self.path}/_new-{name}"
        rows.write.mode("overwrite").parquet(new)
        files.replace(self.spark, new, f"{self.path}/{name}")
        return self.table(name)

    def note(self, name: str, params: dict) -> None:
        """Keeps what a derived table was made with (see `params`)."""
        self.meta.setdefault("params", {})[name] = params
        _write_meta(self.spark, self.path, self.meta)

    def params(self, name: str) -> dict | None:
        return self.meta.get("params", {}).get(name)

    def save(self, path: str, overwrite: bool = False) -> Experiment:
        """A copy of the opened chromosomes at `path` (never onto itself)."""
        path = path.rstrip("/")
        if path == self.path:
            raise ValueError("an experiment can't be saved onto itself")
        if files.exists(self.spark, path) and not overwrite:
            raise FileExistsError(path)
        names = files.folders(self.spark, self.path)
        new = f"{path}-new"
        files.remove(self.spark, new)
        for name in names:
            rows = self.table(name)
            (rows.write.partitionBy("source", "chrom") if name == "calls" else rows.write).parquet(f"{new}/{name}")
        _write_meta(self.spark, new, self.meta)
        files.replace(self.spark, new, path)
        return Experiment(self.spark, path)

    def sources(self) -> list[str]:
        return [s for s in SOURCES if s in self.meta["sources"]]

    def controls(self) -> bool:
        return {"meth", "unmeth"} <= set(self.meta["sources"])

    def relation(self, name: str, lnuc: int = 147, lbin: int = 30, low: float = 0.0, high: float = 1.0, leak: float = 0.1, clip: tuple[float, float] = (0.001, 0.999), mask: str | None = "keep_mask", strand: str | None = None, tables: dict[str, DataFrame] | None = None, **replaced: str) -> DataFrame:
        """A relation of `plans.relations` over this experiment: one plan for all chromosomes that have room for a footprint.

        `replaced` gives relations another text, which may read `tables`. Molecules that table `mask` drops read nothing.
        strand: only molecules of it. Calls that repeat a molecule's place raise ValueError for relations that read them."""
        if name not in _ALL_MOLECULES and (twice := self.meta.get("duplicate")):
            raise ValueError(f"calls repeat a place of a molecule, such as {twice}")
        sizes = self.table("sizes").where(F.col("nbp") >= lnuc)
        if sizes.isEmpty():
            raise ValueError(f"no chromosome has room for a footprint of {lnuc}")
        known = relations.build(LNUC=lnuc, LBIN=lbin, low=low, high=high, leak=leak, clip=clip) | self._base() | replaced
        molecules, calls = self.table("molecules"), self.table("calls")
        if strand is not None:
            molecules, calls = molecules.where(F.col("strand") == strand), calls.join(molecules.where(F.col("strand") == strand).select("source", "chrom", "mol"), ["source", "chrom", "mol"], "left_semi")
        readers = molecules
        if mask is not None and name not in _ALL_MOLECULES and self.has(mask):
            gone = self.table(mask).where(~F.col("keep")).select("source", "chrom", "mol")
            calls, readers = (x.join(gone, ["source", "chrom", "mol"], "left_anti") for x in (calls, readers))
        own = {"exp_calls": calls, "exp_molecules": molecules, "exp_readers": readers, "exp_sizes": sizes, "exp_bases": files.site_masks(self.table("sequences"))}
        return relations.over(self.spark, name, known, own | (tables or {}))

    def _base(self) -> dict[str, str]:
        labels = self.meta["mtase"] or list(files.LABELS)
        on = sorted({c for v in labels for c in CHANNELS[v]})
        whole = relations.R
        either = self.meta["ignore_strand"]
        side = lambda s, v: f"({v in labels} AND {f'(plus_{v.lower()} OR minus_{v.lower()})' if either else f'{s}_{v.lower()}'}) AS {s}_{v.lower()}"
        names = [f"{s}_{v.lower()}" for v in files.LABELS for s in ("plus", "minus")]
        out = {
            "sizes": "SELECT chrom, nbp FROM exp_sizes",
            "calls": "SELECT source, chrom, mol, pos, strand, q FROM exp_calls",
            "molecules": "SELECT source, chrom, mol, mol_index, strand FROM exp_molecules",
            "readers": "SELECT source, chrom, mol, strand FROM exp_readers",
            "bases": "SELECT chrom, pos, base FROM exp_bases",
            "full_masks": "SELECT chrom, pos, " + ", ".join(side(s, v) for v in files.LABELS for s in ("plus", "minus")) + f" FROM ({whole['site_masks']}) x",
            "full_channels": f"SELECT chrom, pos, CASE WHEN channel IN ({', '.join(map(str, on))}) THEN channel ELSE CAST(0 AS BIGINT) END AS channel FROM ({whole['site_channels']}) x",
            "site_masks": "SELECT * FROM full_masks",
            "site_channels": "SELECT * FROM full_channels",
        }
        if self.meta["wrap"]:  # a position stands for itself and its mirror; label sites are those of the whole sequence
            mirror = "FROM {0} a JOIN exp_sizes z ON a.chrom = z.chrom JOIN {0} b ON a.chrom = b.chrom AND b.pos = z.length - 1 - a.pos WHERE a.pos < z.nbp"
            out["site_masks"] = "SELECT a.chrom, a.pos, " + ", ".join(f"a.{n} OR b.{n} AS {n}" for n in names) + " " + mirror.format("full_masks")
            out["site_channels"] = "SELECT a.chrom, a.pos, CASE WHEN a.channel = b.channel THEN a.channel ELSE CAST(0 AS BIGINT) END AS channel " + mirror.format("full_channels")
            out["label_sites"] = whole["label_sites"].replace("site_masks", "full_masks")
        if not self.controls():
            out["eta_source"] = "SELECT 'test' AS source"
            out["normalised"] = "SELECT source, chrom, mol_index, mol, nbp, pos, round(s, 6) AS n FROM smoothed_all WHERE source = 'test'"
            out["bound_values"] = "SELECT chrom, side AS source, n FROM normalised CROSS JOIN (SELECT 'meth' AS side UNION ALL SELECT 'unmeth') y WHERE n IS NOT NULL"
        return out


#: Relations that see dropped molecules and repeated calls too.
_ALL_MOLECULES = {"coverage", "dropout_fractions", "dropout_summary", "dropout_ecdf", "dropout_mask_separate", "dropout_mask_aggregate"}


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    files.write_json(spark, f"{path}/meta.json", meta)


def load_raw(
    spark: SparkSession, out_dir: str, chromsize: str, test_file: str, unmeth_file: str | None = None, meth_file: str | None = None, fasta_file: str | None = None, mtase: list[str] | None = None,
    chroms: list[str] | None = None, wrap: bool = False, ignore_strand: bool = False, colidx: list[int] | None = None, max_nmol: int | None = None, seed: int = 0,
) -> Experiment:
    """Reads call files into a new experiment at `out_dir`; a failure removes it.

    Molecules are numbered by name in each (source, chromosome) before any row is dropped, after the optional draw of
    `max_nmol` of them. Then canonical calls (`-`), calls off the enzymes' sites on their strand (if `mtase` and sequences
    are given) and calls outside the chromosome go, and positions fold to the centre under `wrap`. A molecule's strand is
    that of its first row. Calls that repeat a molecule's place are kept, but dense results over them raise ValueError.
    Controls must have exactly the chromosomes of the test sample."""
    if mtase is not None and (len(set(mtase)) < len(mtase) or set(mtase) - set(files.LABELS) or not mtase):
        raise ValueError(f"mtase takes different labels of {files.LABELS}")
    if files.exists(spark, out_dir):
        raise FileExistsError(out_dir)
    try:
        sizes = files.chrom_sizes(spark, chromsize, wrap, chroms)
        sizes.write.parquet(f"{out_dir}/sizes")
        sizes = spark.read.parquet(f"{out_dir}/sizes")
        sequences = files.reference(spark, fasta_file, sizes)
        sequences.write.parquet(f"{out_dir}/sequences")
        sequences = spark.read.parquet(f"{out_dir}/sequences")
        given = {s: f for s, f in zip(SOURCES, (test_file, meth_file, unmeth_file), strict=True) if f}
        raw = reduce(DataFrame.unionByName, [files.calls(spark, f, colidx).withColumn("source", F.lit(s)).withColumn("_row", F.monotonically_increasing_id()) for s, f in given.items()])
        raw = raw.join(sizes.select("chrom", "length", "nbp"), "chrom")
        mols = raw.groupBy("source", "chrom", "mol_id").agg(F.min_by("strand", "_row").alias("strand"))
        if max_nmol is not None:
            drawn = files.number(spark, mols.withColumn("_draw", F.xxhash64(F.lit(seed), "source", "mol_id")).withColumn("_key", F.struct("_draw", "mol_id")), ["source", "chrom"], "_key", "_rank", f"{out_dir}/_drawn")
            mols = drawn.where(F.col("_rank") < max_nmol).drop("_draw", "_key", "_rank")
        mols = files.number(spark, mols, ["source", "chrom"], "mol_id", "mol_index", f"{out_dir}/_dealt").withColumn("mol", F.col("mol_index"))
        mols.write.parquet(f"{out_dir}/molecules")
        mols = spark.read.parquet(f"{out_dir}/molecules")
        found = {s: set() for s in given}
        for r in mols.select("source", "chrom").distinct().collect():
            found[r["source"]].add(r["chrom"])
        for s in found:
            if found[s] != found["test"]:
                raise ValueError(f"the {s} control has other chromosomes than the test sample")
        rows = raw.join(mols.select("source", "chrom", "mol_id", "mol"), ["source", "chrom", "mol_id"]).where("mod_code <> '-' and upos >= 0 and upos < length")
        if mtase and fasta_file:
            m = files.site_masks(sequences).where(F.size(F.array_union("plus", "minus")) > 0)
            label = F.array(*map(F.lit, mtase))
            m = m.select("chrom", F.col("pos").alias("upos"), F.arrays_overlap("plus", label).alias("p"), F.arrays_overlap("minus", label).alias("m"), F.lit(True).alias("site"))
            either = F.coalesce(F.col("p") | F.col("m"), F.lit(False))
            strand = F.when(F.col("strand") == "+", F.coalesce("p", F.lit(False))).when(F.col("strand") == "-", F.coalesce("m", F.lit(False))).otherwise(True)
            unsequenced = F.col("seq_chrom").isNull()
            rows = rows.join(m, ["chrom", "upos"], "left").join(sequences.select("chrom", F.lit(True).alias("seq_chrom")), "chrom", "left")
            rows = rows.where(unsequenced | (either if ignore_strand else strand))
        folded = F.when(F.col("upos") > (F.col("length") - 1) / 2, F.col("length") - F.col("upos") - 1).otherwise(F.col("upos")) if wrap else F.col("upos")
        rows = rows.withColumn("pos", folded.cast("long")).where("pos < nbp")
        rows = rows.select("source", "chrom", "mol", "pos", "strand", "q")
        rows.write.partitionBy("source", "chrom").parquet(f"{out_dir}/calls")
        for name in ("_drawn", "_dealt"):
            files.remove(spark, f"{out_dir}/{name}")
        twice = spark.read.parquet(f"{out_dir}/calls").groupBy("source", "chrom", "mol", "pos").count().where("count > 1").first()
        _write_meta(spark, out_dir, {"duplicate": list(twice[:4]) if twice else None, "sources": list(given), "mtase": list(mtase) if mtase else None, "wrap": wrap, "ignore_strand": ignore_strand})
    except BaseException:
        files.remove(spark, out_dir)
        raise
    return Experiment(spark, out_dir)
