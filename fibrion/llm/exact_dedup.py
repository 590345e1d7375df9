"""Exact dedup by deterministic block naming.

A text (UTF-8, A-Z lower-cased) is cut into blocks of fixed size. All distinct blocks are sorted and get integer names:
equal blocks one name, different blocks different ones. Then adjacent pairs of names are named in the same way, level
after level, until each document has a single name; with its number of blocks that is an identity without collisions.

Naming at scale: each task first folds the copies it holds itself, so a hot block or pair reaches the naming shuffle once a
task; there, rows are dealt by key and sorted, and a name is (partition, rank). Rows get their names back by a join on the
row that stands for them in their own task, so no join key has more rows than a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 8_192  #: bytes
#: Distinct keys that a task remembers to fold its own copies; beyond it starts afresh (results do not depend on it).
REMEMBERED = 4_000
_UP = bytes(range(256)).translate(bytes.maketrans(common.UPPER.encode(), common.LOWER.encode()))


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_UP)


def _fold(batch_rows: Iterator[tuple[int, int, int, int | None, bytes | None, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (row, block, blocks, doc_id, sha, key) -> the same with the (row, block) that stands for the key; the key only there."""
    seen: dict[bytes, tuple[int, int]] = {}
    held = 0
    out: list[tuple] = []
    size = 0
    for row, pos, n, doc, sha, key in batch_rows:
        got = seen.get(key)
        first = got is None
        if first:
            if len(seen) >= REMEMBERED or held > 16 << 20:
                seen.clear()
                held = 0
            got = seen[key] = (row, pos)
            held += len(key)
        out.append((row, pos, n, doc, sha, *got, key if first else None))
        size += len(key) * first + 64
        if size > 8 << 20:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SCHEMA = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("rep", pa.int64()), ("rep_pos", pa.int32()), ("key", pa.binary())])
_DDL = "row long, pos int, n int, doc_id long, sha binary, rep long, rep_pos int, key binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = normalise(text.as_py())
                n = max(1, -(-len(raw) // BLOCK))
                for p in range(n):
                    yield row, p, n, None if p else doc, None if p else hashlib.sha256(raw).digest(), raw[p * BLOCK : (p + 1) * BLOCK]

    return _fold(rows(), _SCHEMA)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for row, pos, n, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield row, pos, n, None, None, left.to_bytes(8, "big") + (b"" if right is None else right.to_bytes(8, "big"))

    return _fold(rows(), _SCHEMA)


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (rep, rep_pos, key) of a partition -> (rep, rep_pos, name)."""
    part, rank, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        names = []
        for key in b.column(2).to_pylist():
            if key != last:
                rank, last = rank + 1, key
            names.append(part << 40 | rank)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.int64())], names=["rep", "rep_pos", "name"])


def _named(folded: DataFrame) -> DataFrame:
    """Rows (row, pos, n, doc_id, sha, name) of folded rows, which are read twice and so must be stored or checkpointed."""
    n = common.partitions(folded.sparkSession)
    distinct = folded.where("key is not null").select("rep", "rep_pos", "key")
    names = distinct.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_name, "rep long, rep_pos int, name long")
    return folded.select("row", "pos", "n", "doc_id", "sha", "rep", "rep_pos").join(names, ["rep", "rep_pos"]).select("row", "pos", "n", "doc_id", "sha", "name")


def identities(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> (row, doc_id, sha, n, name): sha256 of the normalised text, and an identity that equal texts
    alone share. `row` must be unique.

    The input is read once: its blocks are stored with their rows' numbers before anything is joined, so numbers that
    another reading would deal out differently can't part a text from its name."""
    common.ship(rows.sparkSession)
    folded, path = common.stored_at(rows.select("row", "doc_id", "text").mapInArrow(_blocks, _DDL), "blocks")
    current = common.cut(_named(folded))
    common.drop(rows.sparkSession, path)
    out = current.where("pos = 0").select("row", "doc_id", "sha", "n")
    done = [current.where("n = 1").select("row", "name")]
    current = current.where("n > 1").select("row", "pos", "n", "name")
    while (top := current.agg(F.max("n")).first()[0]) is not None:
        pair = current.withColumn("half", F.expr("pos div 2")).groupBy("row", "half").agg(
            F.first("n").alias("n"), F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("left"), F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))).alias("right")
        )
        pair = common.cut(pair.select("row", F.col("half").cast("int").alias("pos"), "n", "left", "right"))
        folded = common.cut(pair.mapInArrow(_pairs, _DDL))
        current = common.cut(_named(folded).withColumn("n", F.expr("cast((n + 1) div 2 as int)")).drop("doc_id", "sha"))
        done.append(current.where("n = 1").select("row", "name"))
        if top <= 2:
            break
        current = current.where("n > 1")
    names = done[0]
    for d in done[1:]:
        names = names.unionByName(d)
    return out.join(names, "row")


def exact_dedup(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of (doc_id, text): row, doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays (a null doc_id only if all are null,
    and then keep_id is null); of rows that also share that doc_id, one stays. `row` names a column that tells rows apart,
    if there is one; otherwise rows are numbered here. Other columns are left out.
    """
    own = F.col(row) if row else F.monotonically_increasing_id()
    full = common.cut(identities(docs.select(own.alias("row"), F.col("doc_id").cast("long"), "text")))
    best = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("row"))
    groups = full.groupBy("n", "name").agg(F.count("*").alias("size"), F.max(best).alias("best")).where("size > 1")
    groups = groups.select("n", "name", "size", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"))
    out = common.salted_left_join(full, groups, ["n", "name"], "row")
    single = F.col("size").isNull()
    return out.select(
        "row",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents")).drop("row")


OP9_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
