"""Synthetic footprint data: planted nucleosomes, sequences and calls, each molecule from a seed of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place(rng: np.random.Generator, nbp: int, footprint: int, mean_linker: float, shape: float = 4.0) -> list[int]:
    """Starts of nucleosomes with rounded gamma linkers between, until none fits."""
    out, at = [], int(rng.integers(0, footprint + 1)) - footprint // 2
    while True:
        at += int(round(rng.gamma(shape, mean_linker / shape)))
        if at + footprint > nbp:
            return out
        if at >= 0:
            out.append(at)
        at += footprint


def sequence(nbp: int, seed: int) -> str:
    """Uniform random bases."""
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), nbp))


def molecules(spark: SparkSession, seq: str, chrom: str, nmol: int, seed: int, footprint: int = 147, linker: float = 40.0, p_nuc: float = 0.05, p_linker: float = 0.8, separation: float = 2.0, naked: str | None = None) -> DataFrame:
    """mol_id, chrom, strand, starts, pos, q: scores of all adenine sites of a strand (T on -) of each molecule.

    A site is methylated with p_nuc inside nucleosomes, p_linker outside; its score is the posterior of Normal(+-separation, 1).
    `naked`: "meth" has no nucleosomes, "unmeth" no methylation beyond p_nuc / 2."""
    bases = np.frombuffer(seq.encode(), np.uint8)
    sites = {"+": np.flatnonzero(bases == ord("A")), "-": np.flatnonzero(bases == ord("T"))}
    stream = {None: 0, "meth": 1, "unmeth": 2}[naked]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m in b["id"]:
                rng = np.random.default_rng([seed, stream, int(m)])
                starts = [] if naked else place(rng, len(seq), footprint, linker)
                strand = "+" if m % 2 == 0 else "-"
                at = sites[strand]
                inside = np.zeros(len(seq), bool)
                for s in starts:
                    inside[s : s + footprint] = True
                p = np.full(len(at), p_nuc / 2) if naked == "unmeth" else np.where(inside[at], p_nuc, p_linker)
                x = rng.normal(np.where(rng.random(len(at)) < p, separation, -separation), 1)
                rows.append((f"{chrom}_{m:08d}", chrom, strand, starts, at.tolist(), (1 / (1 + np.exp(-2 * separation * x))).tolist()))
            yield pd.DataFrame(rows, columns=["mol_id", "chrom", "strand", "starts", "pos", "q"])

    dealt = spark.range(nmol).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.mapInPandas(run, "mol_id string, chrom string, strand string, starts array<long>, pos array<long>, q array<double>")


def write(rows: DataFrame, path: str) -> None:
    """A call file (tab-separated, with header), as a folder of parts."""
    long = rows.select(F.col("mol_id").alias("read_id"), F.explode(F.arrays_zip("pos", "q")).alias("x"), "chrom", F.col("strand").alias("ref_strand"))
    long = long.select("read_id", F.col("x.pos").alias("ref_position"), "chrom", "ref_strand", F.col("x.q").alias("mod_qual"), F.lit("a").alias("mod_code"))
    long.write.option("sep", "\t").option("header", True).csv(path)


def write_truth(rows: DataFrame, footprint: int, path: str) -> None:
    """chrom, start, end, mol_id of each planted nucleosome (half-open)."""
    long = rows.select("chrom", F.explode("starts").alias("start"), "mol_id")
    long.select("chrom", "start", (F.col("start") + footprint).alias("end"), "mol_id").write.option("sep", "\t").csv(path)


def write_reference(spark: SparkSession, seqs: dict[str, str], fasta: str, chromsize: str) -> None:
    spark.createDataFrame([(f">{c}\n{s}",) for c, s in seqs.items()], "value string").coalesce(1).write.text(fasta)
    spark.createDataFrame([(f"{c}\t{len(s)}",) for c, s in seqs.items()], "value string").coalesce(1).write.text(chromsize)
