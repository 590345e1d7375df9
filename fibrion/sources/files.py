"""Readers of the input files: chromosome sizes, sequences, call tables, simulation settings. All paths go through Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALL_COLUMNS = ("read_id", "ref_position", "chrom", "ref_strand", "mod_qual", "mod_code")  # fixed values: column names of a call file
CALL_TYPES = ("string", "long", "string", "string", "double", "string")
LABELS = ("A", "CG", "GC")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"could not rename {old} to {new}")


def replace(spark: SparkSession, new: str, place: str) -> None:
    """Puts folder `new` in the place of another, if there is one; if that fails, the old one is back in its place."""
    old = f"{place.rpartition('/')[0]}/_old-{place.rpartition('/')[2]}"
    remove(spark, old)
    had = exists(spark, place)
    if had:
        rename(spark, place, old)
    try:
        rename(spark, new, place)
    except BaseException:
        if had:
            rename(spark, old, place)
        raise
    remove(spark, old)


def write_json(spark: SparkSession, path: str, what: dict) -> None:
    """A small file, written beside and put in its place."""
    fs, p = _fs(spark, f"{path}.new")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    replace(spark, f"{path}.new", path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The tables of a folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_")]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as one text."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def _first_line(spark: SparkSession, path: str) -> str:
    return (spark.read.text(path).first() or [""])[0]


def chrom_sizes(spark: SparkSession, path: str, wrap: bool = False, chroms: list[str] | None = None) -> DataFrame:
    """chrom, length, nbp (half the length, rounded down, if `wrap`). A first line `chrom<TAB>length` is a header.

    Repeated names, lengths that are no number and unknown `chroms` raise ValueError; an empty file has no rows."""
    header = _first_line(spark, path) == "chrom\tlength"
    rows = spark.read.csv(path, sep="\t", schema="chrom string, length long", header=header)
    bad = rows.groupBy("chrom").agg(F.count("*").alias("n"), F.min("length").alias("low")).where("n > 1 or low is null or chrom is null").first()
    if bad:
        raise ValueError(f"chromosome sizes: {bad['chrom']} is repeated or has no length")
    if chroms is not None:
        found = {r[0] for r in rows.where(F.col("chrom").isin(list(chroms))).collect()}
        if set(chroms) - found:
            raise ValueError(f"unknown chromosomes: {sorted(set(chroms) - found)}")
        rows = rows.where(F.col("chrom").isin(list(chroms)))
    return rows.withColumn("nbp", F.floor(F.col("length") / 2) if wrap else F.col("length"))


def fasta(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """chrom, seq (upper case, without white space) of each record; absent names of `wanted` are just missing."""
    rows = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\s]+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    out = rows.select(head.alias("chrom"), seq.alias("seq"))
    return out if wanted is None else out.where(F.col("chrom").isin(list(wanted)))


def reference(spark: SparkSession, path: str | None, sizes: DataFrame) -> DataFrame:
    """Sequences of the chromosomes in `sizes`; another length than there raises ValueError."""
    if path is None:
        return spark.createDataFrame([], "chrom string, seq string")
    out = fasta(spark, path).join(sizes.select("chrom", "length"), "chrom")
    bad = out.where(F.length("seq") != F.col("length")).select("chrom").first()
    if bad:
        raise ValueError(f"the sequence of {bad['chrom']} has another length than the size table")
    return out.select("chrom", "seq")


def calls(spark: SparkSession, path: str, colidx: list[int] | None = None) -> DataFrame:
    """mol_id, upos, chrom, strand, q, mod_code of a tab-separated call file.

    With `colidx` the file has no header and these are the places of molecule, position, chromosome, strand, quality and
    code; otherwise columns go by name (a leading # of the header is dropped) and extra ones are left unread. gz and bz2
    are read as they are, but by one task a file, so their rows are dealt out again. Null or unreadable fields drop the row."""
    if path.endswith(".xz"):
        raise ValueError("xz is not a codec of Spark's readers: repack the file as bz2 or leave it unpacked")
    first = _first_line(spark, path).split("\t")
    names = [f"c{i}" for i in range(len(first))] if colidx else [c.lstrip("#").strip() for c in first]
    if colidx:
        if len(colidx) != 6 or len(set(colidx)) != 6 or not all(0 <= i < len(first) for i in colidx):
            raise ValueError("colidx takes six different column places")
        places = list(colidx)
    else:
        missing = [c for c in CALL_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"call file without columns {missing}")
        places = [names.index(c) for c in CALL_COLUMNS]
    kinds = {p: t for p, t in zip(places, CALL_TYPES, strict=True)}
    schema = ", ".join(f"c{i} {kinds.get(i, 'string')}" for i in range(len(first)))  # places, not names: names may clash
    rows = spark.read.csv(path, sep="\t", schema=schema, header=not colidx, enforceSchema=True)
    out = rows.select(*(F.col(f"c{p}").alias(n) for p, n in zip(places, ("mol_id", "upos", "chrom", "strand", "q", "mod_code"), strict=True))).dropna()
    return out.repartition("chrom", "mol_id") if path.endswith((".gz", ".bz2")) else out


def site_masks(sequences: DataFrame) -> DataFrame:
    """chrom, pos, base, plus and minus (arrays of labels) of every position.

    Sequences are cut into pieces of 8,192 bases with their neighbours' edge bases, so the work is linear and spreads."""
    pieces = sequences.select("chrom", F.split("seq", r"(?<=\G.{8192})").alias("cut"))
    edged = F.expr("transform(cut, (c, i) -> struct(i * 8192L as start, concat(if(i = 0, 'N', right(get(cut, i - 1), 1)), c, coalesce(left(get(cut, i + 1), 1), 'N')) as padded))")
    p = pieces.select("chrom", F.explode(edged).alias("p")).select("chrom", "p.start", "p.padded").where("length(padded) > 2")
    s = p.select("chrom", "start", "padded", F.explode(F.expr("sequence(1, length(padded) - 2)")).alias("i"))
    s = s.selectExpr("chrom", "start + i - 1 as pos", "substr(padded, i + 1, 1) as base", "substr(padded, i, 1) as prev", "substr(padded, i + 2, 1) as next")
    plus = F.expr("filter(array(if(base = 'A', 'A', null), if(base = 'C' and next = 'G', 'CG', null), if(base = 'C' and prev = 'G', 'GC', null)), x -> x is not null)")
    minus = F.expr("filter(array(if(base = 'T', 'A', null), if(base = 'G' and prev = 'C', 'CG', null), if(base = 'G' and next = 'C', 'GC', null)), x -> x is not null)")
    return s.select("chrom", "pos", "base", plus.alias("plus"), minus.alias("minus"))


def number(spark: SparkSession, rows: DataFrame, groups: list[str], key: str, name: str, store: str) -> DataFrame:
    """`rows` with `name`: place of `key` in its group from 0. One range sort over all groups, so a large group takes many tasks.

    The dealt rows are written to `store` first: the numbers must not change when a lost task runs again."""
    dealt = rows.repartitionByRange(*groups, key).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(store)
    dealt = spark.read.schema(dealt.schema).parquet(store)
    counts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(key))
    out = dealt.join(counts.drop("_n"), [*groups, "_part"]).withColumn(name, (within - 1 + F.col("_before")).cast("long"))
    return out.drop("_part", "_before")


def settings(spark: SparkSession, path: str) -> dict:
    """Simulation settings of a .json, .yaml or .yml file; keys of a `llink` map become text; another suffix raises ValueError."""
    if path.endswith(".json"):
        out = json.loads(read_text(spark, path))
    elif path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML settings needs the yaml library") from e
        out = yaml.safe_load(read_text(spark, path))
    else:
        raise ValueError(f"settings are read from .json, .yaml or .yml files, not {path}")
    if isinstance(out.get("llink"), dict):
        out["llink"] = {str(k): int(v) for k, v in out["llink"].items()}
    return out


def energies(spark: SparkSession, path: str, nbp: int, emax: float = float("inf")) -> DataFrame:
    """mol (the file's name), e: energies of text files of `position energy` lines; # starts a comment, positions outside the
    molecule are left out, energies are held within emax, places without a line are null."""
    if not emax >= 0:
        raise ValueError("emax is a number of 0 or more")
    rows = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("mol"), F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+").alias("w"))
    rows = rows.where(F.size("w") >= 2).select("mol", F.expr("try_cast(w[0] as int)").alias("pos"), F.expr("try_cast(w[1] as double)").alias("e"))
    rows = rows.where((F.col("pos") >= 0) & (F.col("pos") < nbp)).withColumn("e", F.least(F.greatest("e", F.lit(-emax)), F.lit(emax)))
    held = rows.groupBy("mol").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", "e")))).alias("at"))
    return held.select("mol", F.transform(F.sequence(F.lit(0), F.lit(nbp - 1)), lambda p: F.col("at")[p]).alias("e"))


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """mol_id, start, end (half-open) of a tab-separated file with the molecule's name and comma lists of starts and of lengths."""
    rows = spark.read.csv(path, sep="\t", schema="mol_id string, starts string, lengths string", comment="#")
    lists = [F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long")) for c in ("starts", "lengths")]
    pairs = rows.select("mol_id", F.explode(F.arrays_zip(lists[0].alias("s"), lists[1].alias("n"))).alias("x"))
    return pairs.select("mol_id", F.col("x.s").alias("start"), (F.col("x.s") + F.col("x.n")).alias("end"))
