"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, which puts those that differ in few bits close together. Over the sorted run, nodes
hold the bits on which all fingerprints below them agree (a mask and a pattern); a child keeps only what its parent
hasn't factored out. A search descends with the differences counted so far and leaves out a whole group when they
exceed the limit, so every link within the limit is found.

For many machines, the index is cut by its top nodes: two fingerprints of 64 bits that differ in at most 2 agree on at
least two of four 16-bit fields, so each of the six pairs of fields is brought to the front in turn, and a shared front
of 32 bits is a top node. Top nodes are dealt to the tasks; a task indexes and searches what is below its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, forest

LIMIT, SHINGLE, SEED = 2, 3, 42
FANOUT, QUERIES = 8, 4_096
SEARCHED = 500_000  #: rows below whole top nodes that are indexed at a time, at least
_BITS = np.arange(63, -1, -1, dtype="u8")


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle (the whole sequence if it has fewer words)."""
    import xxhash

    if not words:
        return np.empty(0, "u8")
    text = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], "u8")
    sizes = np.fromiter(map(len, words), "i8", len(words))
    start = np.cumsum(sizes + 1) - sizes - 1
    digest = xxhash.xxh64_intdigest
    ends = (start + sizes)[k - 1 :].tolist()
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=False)), "u8", len(words) - k + 1)


def _majority(h: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, "i8")
    for i in range(0, len(h), 200_000):
        part = np.ascontiguousarray(h[i : i + 200_000])
        ones += np.unpackbits(part.view("u1").reshape(-1, 8)[:, ::-1], axis=1).sum(0, dtype="i8")
    return int(((ones * 2 > len(h)).astype("u8") << _BITS).sum(dtype="u8"))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return _majority(_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle))


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, text) -> (row, doc_id, fp): the fingerprint's 64 bits as a signed long; zero without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["row", "doc_id", "fp"])

    common.ship(rows.sparkSession)
    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def fronted(fp: np.ndarray, front: tuple[int, int]) -> np.ndarray:
    """The four 16-bit fields with two of them first."""
    out = np.zeros_like(fp)
    for place, k in enumerate([*front, *(i for i in range(4) if i not in front)]):
        out |= (fp >> np.uint64(48 - 16 * k) & np.uint64(0xFFFF)) << np.uint64(48 - 16 * place)
    return out


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, node) -> a row (place, rank, fp, node) for each of the six fronts."""
    for b in batches:
        fp = b.column(0).to_numpy().view("u8")
        for place, front in enumerate(combinations(range(4), 2)):
            rank = gray_rank(fronted(fp, front)).view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), place, "i4")), pa.array(rank), *b.columns], names=["place", "rank", "fp", "node"])


def links(fp: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of one group whose fingerprints differ in at most `limit` bits. fp: in Gray order within its group;
    group: ascending."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, "i8")
    sizes = np.diff(np.r_[starts, n])
    levels = [(np.arange(n), np.arange(n) + 1, fp, np.full(n, ~np.uint64(0), "u8"))]  # leaves: first, past the last, pattern, mask
    of = np.repeat(np.arange(len(starts)), sizes)
    while len(levels[-1][0]) > len(starts):
        lo, hi, pattern, mask = levels[-1]
        g = of[lo]
        rank = np.arange(len(lo)) - np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1]
        new = np.flatnonzero(rank % FANOUT == 0)
        agree = np.bitwise_and.reduceat(mask, new) & ~(np.bitwise_or.reduceat(pattern, new) ^ np.bitwise_and.reduceat(pattern, new))
        top = np.bitwise_and.reduceat(pattern, new) & agree
        first, last = lo[new], hi[np.r_[new[1:], len(lo)] - 1]
        parent = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(lo)]))
        levels[-1] = (lo, hi, pattern, mask & ~agree[parent], new)  # the shared bits go to the upper node
        levels.append((first, last, top, agree))
    lo, hi, pattern, mask = levels[-1]
    levels[-1] = (lo, hi, pattern, mask, np.arange(len(lo)))
    left, right = [], []
    wanted = np.flatnonzero(np.repeat(sizes > 1, sizes))
    for at in range(0, len(wanted), QUERIES):
        q = wanted[at : at + QUERIES]
        node, seen = of[q], np.zeros(len(q), "u1")
        for depth in range(len(levels) - 1, -1, -1):
            _, hi, pattern, mask, _ = levels[depth]
            seen = seen + np.bitwise_count((fp[q] ^ pattern[node]) & mask[node])
            keep = (seen <= limit) & (hi[node] > q + 1)
            q, node, seen = q[keep], node[keep], seen[keep]
            if depth:
                new = levels[depth - 1][4]
                begin, end = new[node], np.r_[new[1:], len(levels[depth - 1][0])][node]
                k = end - begin
                node = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())
                q, seen = np.repeat(q, k), np.repeat(seen, k)
        keep = node > q
        left.append(q[keep])
        right.append(node[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, "i8"),) * 2


def _search(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (place, rank, fp, node) -> edges (a, b) that join what links below each top node."""
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1] >> 32) != 0)]) if len(rows) else np.empty(0, "i8")
            i, j = links(np.ascontiguousarray(rows[:, 2]).view("u8"), group, limit)
            root = forest(len(rows), i, j) if len(i) else np.arange(len(rows))
            far = np.flatnonzero(root != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(rows[far, 3]), pa.array(rows[root[far], 3])], names=["a", "b"])

        top = None  # the node that held rows end in
        for b in batches:
            rows = np.column_stack([c.to_numpy().astype("i8") for c in b.columns])
            if not len(rows):
                continue
            front = np.column_stack([rows[:, 0], rows[:, 1] >> 32])
            if sum(map(len, held)) > SEARCHED and (other := (front != top).any(1)).any():
                first = int(np.argmax(other))
                yield edges(np.concatenate([*held, rows[:first]]))
                held, rows = [], rows[first:]
            held.append(rows)
            top = tuple(front[-1])
        if held:
            yield edges(np.concatenate(held))

    return run


def near_links(prints: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) -> the distinct fingerprints (fp, node: their smallest doc_id, docs), and edges (a, b) of nodes that join
    all whose fingerprints differ in at most `limit` bits. Needs limit <= 2 (the six fronts)."""
    if limit > 2:
        raise ValueError("the fronts find every link only up to 2 differing bits")
    n = common.partitions(prints.sparkSession)
    nodes = common.cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("docs")))
    laid = nodes.select("fp", "node").mapInArrow(_lay, "place int, rank long, fp long, node long")
    dealt = laid.repartition(n, "place", F.shiftright("rank", 32)).sortWithinPartitions("place", "rank")
    return nodes, dealt.mapInArrow(_search(limit), "a long, b long")


def near_groups(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp) -> (fp, component): for each fingerprint that more than one document has or that links to another,
    the smallest doc_id that its documents reach."""
    nodes, edges = near_links(prints, limit)
    found = components(edges)
    linked = nodes.join(found, nodes.node == found.node, "left").select("fp", "docs", F.coalesce("component", nodes.node).alias("component"), found.node.isNotNull().alias("linked"))
    return linked.where("linked or docs > 1").select("fp", "component")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT, row: str | None = None) -> DataFrame:
    """One row per row of (doc_id, text): row, doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts and texts without words have fingerprint zero and link like any other. Rows with a null doc_id
    take no part in linking and have a null component. Repeated doc_ids: a row for each. `row` names a column that tells
    rows apart, if there is one. Other columns are left out.
    """
    own = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(own.alias("row"), F.col("doc_id").cast("long"), "text")
    prints = common.cut(fingerprints(rows, shingle))
    out = common.salted_left_join(prints, near_groups(prints, limit), ["fp"], "row")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(common.table(spark, sf_dir, "documents")).drop("row")
