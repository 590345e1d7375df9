"""Near-dedup by exact Jaccard similarity of word shingles, as a prefix-filtered self-join.

A text is the set of its five-word shingles (64-bit hashes; lower-cased A-Z, words between ASCII white space). If two sets
reach a similarity of t, each holds at least t of the other's members, so under any one order of all shingles their first
n - ceil(t n) + 1 members (of n) meet. The order puts rare shingles first, by a sketch of counts over all texts, so a
common line or passage is seldom among them. Only texts that share such a shingle are compared: first on bitmaps of their
sets, which differ in no more bits than the sets in members, so no pair is lost there, and what is left on the whole sets.

SimHash goes first (simhash_dedup: fingerprints of the same shingles, Gray-order index): what its index links is held
against the sets, and what reaches the similarity is joined. Fingerprints within two bits are few of the
pairs at 0.8 (those differ in 3 to 11 bits), so the join finds the rest. A large group of copies is not listed pair by
pair either: every text is held against three that share its shingle (the first, the next one in size, and the next one
in an order of its own for each shingle, so that a group is mixed well), and what passes is joined. Then a text that may
reach the similarity with one of another component is listed once with that component, and is held against the bitmaps
of all its members, dealt in blocks; only pairs whose bitmaps allow the similarity become rows. A pair left out is in one
component already, so the components are those of all pairs that reach the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash_dedup import fingerprints, near_links

SHINGLE = 5
#: Similarity 0.8, as a fraction.
NUM, DEN = 4, 5
#: The sketch has 2**BITS counters, which travel in PARTS compressed pieces.
BITS, PARTS = 22, 64
#: Pairs that a task looks at together; it holds four times as many results.
PAIRS = 250_000
#: Members of a component that are held against its candidates in one block, about.
BLOCK = 1_024
#: The largest filter of wanted rows has 2**FILTER bits.
FILTER = 26
#: Bits of a set's bitmap.
MAP = 2_048


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The ascending hashes of all k-word shingles (of the whole sequence if it has fewer words)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    n = max(1, len(h) - k + 1)
    x = np.zeros(n, "u8")
    for j in range(min(k, len(h))):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return np.unique(x ^ (x >> np.uint64(33)))


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(piece: bytes, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(piece, decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> the task's counters (up to 65,535), in pieces (part, counts)."""
    total = np.zeros(1 << BITS, "u2")
    for b in batches:
        for t in b.column(0):
            at, n = np.unique((shingles(t.as_py()) >> np.uint64(64 - BITS)).astype("i8"), return_counts=True)
            total[at] = np.minimum(total[at] + n, 65_535)
    pieces = [_packed(p) for p in np.split(total, PARTS)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype="i4")), pa.array(pieces, pa.binary())], names=["part", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pieces (part, counts) of some parts -> the binary digits of their sums."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            total[part] = total.get(part, 0) + _unpacked(piece.as_py(), (1 << BITS) // PARTS, "u2").astype("i8")
    digits = [_packed(np.ceil(np.log2(v + 1)).astype("u1")) for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(digits, pa.binary())], names=["part", "counts"])


def sketch(rows: DataFrame) -> np.ndarray:
    """For each counter, the number of binary digits of its count over all texts."""
    n = common.partitions(rows.sparkSession)
    found = rows.select("text").mapInArrow(_count, "part int, counts binary").repartition(n, "part").mapInArrow(_add, "part int, counts binary").collect()
    total = np.zeros((PARTS, (1 << BITS) // PARTS), "u1")
    for r in found:
        total[r.part] = _unpacked(bytes(r.counts), total.shape[1], "u1")
    return total.ravel()


def _prefixes(level: np.ndarray):
    packed = _packed(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text) -> (shingle, row, place, size) for the first shingles of each text in the common order."""
        level = _unpacked(packed, 1 << BITS, "u1")
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                first, sizes = [], []
                for t in part.column(1):
                    s = shingles(t.as_py())
                    order = np.argsort(level[(s >> np.uint64(64 - BITS)).astype("i8")], kind="stable")
                    first.append(s[order[: len(s) + (-NUM * len(s) // DEN) + 1]])
                    sizes.append(len(s))
                k = np.array(list(map(len, first)))
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                cols = [np.concatenate(first).view("i8"), np.repeat(part.column(0).to_numpy(), k), place.astype("i4"), np.repeat(np.array(sizes, "i4"), k)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["shingle", "row", "place", "size"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Batches sorted by their first column -> arrays of whole groups."""
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        held.append(np.column_stack([c.to_numpy().astype("i8") for c in b.columns]))
        n += b.num_rows
        if n > 500_000:
            rows = np.concatenate(held)
            last = rows[:, 0] == rows[-1, 0]
            if not last.all():
                yield rows[~last]
            held = [rows[last]]
            n = len(held[0]) if not last.all() else 0
    if held:
        yield np.concatenate(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shingle, row, place, size) -> those whose shingle more than one row has."""
    for rows in _groups(batches):
        same = rows[1:, 0] == rows[:-1, 0]
        keep = rows[np.r_[same, False] | np.r_[False, same]]
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(keep[:, 0]), pa.array(keep[:, 1]), pa.array(keep[:, 2].astype("i4")), pa.array(keep[:, 3].astype("i4"))], names=["shingle", "row", "place", "size"])


def _mixed(x: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    x = x.astype("u8") * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _may(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j of (shingle, label, row, place, size, ...), which share the shingle, may reach the similarity."""
    size_i, size_j = rows[i, 4], rows[j, 4]
    fits = DEN * np.minimum(size_i, size_j) >= NUM * np.maximum(size_i, size_j)
    # at the first shingle that both have, all that they share is still to come
    return fits & ((DEN + NUM) * np.minimum(size_i - rows[i, 3], size_j - rows[j, 3]) >= NUM * (size_i + size_j))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shingle, label: size, row, place, size) -> pairs (a, b) of rows that share the shingle and may reach the
    similarity: each row with its group's first, with the one before it, and with the one before it in a mixed order."""
    for rows in _groups(batches):
        if not len(rows):
            continue
        new = rows[1:, 0] != rows[:-1, 0]
        start = np.flatnonzero(np.r_[True, new])[np.cumsum(np.r_[False, new])]
        at = np.flatnonzero(~new) + 1
        order = np.lexsort((_mixed(rows[:, 2] + _mixed(rows[:, 0]).view("i8")), start))
        i, j = np.r_[start[at], at - 1, order[at - 1]], np.r_[at, at, order[at]]
        fits = _may(rows, i, j)
        a, b = rows[i[fits], 2], rows[j[fits], 2]
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shingle, label, row, place, size, docs) -> (row, label, docs): rows that may reach the similarity with a
    row of the label, which has `docs` rows; the row's own label has fewer, or as many and is larger."""
    for rows in _groups(batches):
        n = len(rows)
        if not n:
            continue
        new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        other = new | np.r_[True, rows[1:, 1] != rows[:-1, 1]]
        many = np.flatnonzero(other)[np.cumsum(other) - 1] - start
        upto = np.cumsum(many)
        seen: list[np.ndarray] = []
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            k = many[lo:hi]
            j = np.repeat(np.arange(lo, hi), k)
            i = np.repeat(start[lo:hi] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            fits = _may(rows, i, j)
            i, j = i[fits], j[fits]
            up = rows[i, 5] >= rows[j, 5]  # labels ascend in a group
            x, to = np.where(up, j, i), np.where(up, i, j)
            seen.append(np.column_stack([rows[x, 2], rows[to, 1], rows[to, 5]]))
            if sum(map(len, seen)) > 4 * PAIRS or hi == n:
                seen = [np.unique(np.concatenate(seen), axis=0)]
                if len(seen[0]) > 2 * PAIRS or hi == n:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, seen[0].T)), names=["row", "label", "docs"])
                    seen = []
            lo = hi


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (label, block, kind, row, size, map) -> pairs (a, b) of a block's members (kind 0) and its candidates (kind
    1) whose sizes and bitmaps allow the similarity."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.column_stack([b.column(k).to_numpy().astype("i8") for k in range(5)])
        maps = np.frombuffer(b"".join(b.column(5).to_pylist()), "u8").reshape(len(rows), -1)
        cuts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1), True])
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if key != tuple(rows[lo, :2]):
                key, held = tuple(rows[lo, :2]), []
            if not rows[lo, 2]:
                held.append((rows[lo:hi, 3:], maps[lo:hi]))
                continue
            if len(held) != 1:
                held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
            (own, bits) = held[0]
            step = max(1, 16_000 // len(own))
            for at in range(lo, hi, step):
                to = min(hi, at + step)
                apart = np.bitwise_count(maps[at:to, None] ^ bits).sum(2, dtype="i8")
                size, sizes = rows[at:to, 4, None], own[:, 1]
                fits = ((DEN + NUM) * apart <= (DEN - NUM) * (size + sizes)) & (DEN * np.minimum(size, sizes) >= NUM * np.maximum(size, sizes))
                x, m = np.nonzero(fits)
                found.append(np.column_stack([rows[at + x, 3], own[m, 0]]))
        if found:
            a, c = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])


def _places(row: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mixed(row, by) >> np.uint64(64 - bits)).astype("i8") for by in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def among(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a table (row, ...) whose `row` is in wanted (row, distinct), and perhaps some in twenty of the others: a
    filter of 8 to 16 bits a wanted row (up to 2**FILTER in all), so that a join doesn't move the whole table."""
    bits = min(FILTER, max(10, (8 * wanted.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, some = np.zeros(1 << bits, "u1"), False
        for b in batches:
            some |= b.num_rows > 0
            for at in _places(b.column(0).to_numpy(), bits):
                marks[at] = 1
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(np.packbits(marks))], pa.binary())], names=["marks"])

    marks = np.zeros((1 << bits) // 8, "u1")
    for r in wanted.select("row").mapInArrow(mark, "marks binary").toLocalIterator():
        marks |= _unpacked(bytes(r.marks), len(marks), "u1")
    packed = _packed(marks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(_unpacked(packed, (1 << bits) // 8, "u1"))
        for b in batches:
            one, two = _places(b.column(0).to_numpy(), bits)
            yield b.filter(pa.array((marks[one] & marks[two]).astype(bool)))

    return table.mapInArrow(keep, table.schema)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, size, map): the bitmap of the set."""
    for b in batches:
        sizes, maps = [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            bits = np.zeros(MAP, "u1")
            bits[(s % np.uint64(MAP)).astype("i8")] = 1
            sizes.append(len(s))
            maps.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], names=["row", "size", "map"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, size of a, size of b, map of a, map of b) -> the pairs (a, b) whose bitmaps allow the similarity."""
    for b in batches:
        left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), "u8").reshape(b.num_rows, -1) for k in (4, 5))
        apart = np.bitwise_count(left ^ right).sum(1, dtype="i8")
        both = b.column(2).to_numpy().astype("i8") + b.column(3).to_numpy()
        yield b.select(["a", "b"]).filter(pa.array((DEN + NUM) * apart <= (DEN - NUM) * both))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> the pairs (a, b) that reach the similarity."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        ok = np.zeros(b.num_rows, bool)
        for k, (i, j, left, right) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)):
            if len(held) > 2_000:
                held.clear()
            for row, text in ((i, left), (j, right)):
                if row not in held:
                    held[row] = shingles(text.as_py())
            own, other = held[i], held[j]
            both = len(np.intersect1d(own, other, assume_unique=True))
            ok[k] = DEN * both >= NUM * (len(own) + len(other) - both)
        yield b.select(["a", "b"]).filter(pa.array(ok))


def near_rows(rows: DataFrame) -> DataFrame:
    """(row, text), row unique -> (row, component): for each row that a chain of texts of similarity 0.8 or more links to
    another, the smallest row it reaches. Null texts and texts without words are equal to one another."""
    spark = common.ship(rows.sparkSession)
    n = common.partitions(spark)
    first = rows.select("row", "text").mapInArrow(_prefixes(sketch(rows)), "shingle long, row long, place int, size int")
    shared = first.repartition(n, "shingle").sortWithinPartitions("shingle").mapInArrow(_shared, "shingle long, row long, place int, size int")
    shared = common.cut(shared)

    maps = common.cut(rows.select("row", "text").mapInArrow(_maps, "row long, size int, map binary"))

    def beside(pairs: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
        """Pairs with columns of the table for both sides."""
        wanted = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        table = among(table.select("row", *names), wanted).join(wanted, "row")
        for side, other in (("a", "b"), ("b", "a")):
            own = table.select(F.col("row").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in names))
            pairs = common.salted_left_join(pairs, own, [side], other, 4)
        return pairs.select("a", "b", *(f"{x}_{side}" for x in names for side in ("a", "b")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity."""
        return common.cut(beside(pairs, rows, ["text"]).mapInArrow(_verify, "a long, b long"))

    prints = common.cut(fingerprints(rows.select("row", F.col("row").alias("doc_id"), "text"), SHINGLE))
    nodes, near = near_links(prints)  # ids are rows here
    copies = prints.join(nodes.where("docs > 1").select("fp", "node"), "fp").where("node < row").select(F.col("node").alias("a"), F.col("row").alias("b"))
    linked = common.cut(copies.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    dealt = shared.select("shingle", F.col("size").cast("long").alias("label"), "row", "place", "size").repartition(n, "shingle")
    pairs = dealt.sortWithinPartitions("shingle", "label", "row").mapInArrow(_neighbours, "a long, b long")
    pairs = common.cut(pairs.unionByName(linked).distinct())
    pairs = common.cut(beside(pairs, maps, ["size", "map"]).mapInArrow(_close, "a long, b long"))
    found = common.cut(components(verified(pairs)).withColumnRenamed("node", "row"))

    labels = common.cut(found.join(found.groupBy("component").agg(F.count("*").alias("docs")), "component").withColumnRenamed("component", "label"))
    own = (F.coalesce("label", "row").alias("label"), F.coalesce("docs", F.lit(1).cast("long")).alias("docs"))
    dealt = shared.join(labels, "row", "left").select("shingle", own[0], "row", "place", "size", own[1]).repartition(n, "shingle")
    met = dealt.sortWithinPartitions("shingle", "label", "row").mapInArrow(_across, "row long, label long, docs long")
    met = common.cut(met.distinct())
    blocks = F.ceil(F.col("docs") / BLOCK)
    wanted = met.groupBy("label").agg(F.max("docs").alias("docs"))
    members = maps.join(labels.select("row", "label"), "row", "left").select("row", "size", "map", own[0])
    members = common.salted_left_join(members, wanted, ["label"], "row", 4).where("docs is not null")
    members = members.withColumn("block", F.pmod(F.xxhash64("row"), blocks)).withColumn("kind", F.lit(0))
    seekers = met.join(maps, "row").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("kind", F.lit(1))
    columns = ("label", "block", "kind", "row", "size", "map")
    both = members.select(*columns).unionByName(seekers.select(*columns)).repartition(n, "label", "block").sortWithinPartitions("label", "block", "kind")
    rest = verified(common.cut(both.mapInArrow(_blocks, "a long, b long")))
    joined = found.select(F.col("row").alias("a"), F.col("component").alias("b")).unionByName(rest)
    return components(joined).withColumnRenamed("node", "row")
