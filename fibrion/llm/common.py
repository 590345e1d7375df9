"""What the training-data operators share: shared folder, lineage cuts, joins on hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import is_local, ship

__all__ = ["ship", "table", "shared_dir", "fresh_dir", "tidy", "cut", "stored", "stored_at", "drop", "numbered", "partitions", "lower_az", "n_words", "salted_left_join"]

#: A word as the operators count it: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, one of our own if the session
    runs on this machine alone; otherwise ValueError, for executors would each write to a disk of their own."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if got:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(got)
        return got
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fibrion-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path under the shared folder; what is written there goes when the driver ends."""
    top = f"{shared_dir(spark).rstrip('/')}/fibrion-{what}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{top}/data"


def tidy(spark: SparkSession) -> None:
    """Lets the driver drop frames that are no longer used, and Spark their shuffle files, broadcasts and checkpoints, which
    otherwise stay until the driver happens to collect its garbage. For operators of many rounds on a cluster."""
    if not is_local(spark):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint: computed once, and read again after an executor is lost."""
    shared_dir(df.sparkSession)
    tidy(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Written to the shared folder as Parquet and read again (computed once, and columns not asked for aren't read); and
    where it lies."""
    out = fresh_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out), out


def stored(df: DataFrame, what: str) -> DataFrame:
    return stored_at(df, what)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Removes what lies at the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns with `row`, a number of its own for each row. Written once: numbers made anew in a second scan could
    fall on other rows, for files are split by the number of cores at hand."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_left_join(rows: DataFrame, lookup: DataFrame, keys: list[str], salt_by: str, salts: int = 16) -> DataFrame:
    """Left join with a lookup that has one row a key. A hot key's rows are dealt to `salts` tasks; the lookup is
    repeated `salts` times for it, so pass only the lookup's rows that matter."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
