"""Approximate nearest neighbours with randomly rotated one-bit codes.

Each vector is scaled to length 1, rotated by a fixed random rotation and reduced to the signs of its components, packed
into 64-bit words, with two correction scalars: its length and the inner product of the unit vector with its own code.
A query is rotated too and rounded to four bits a component; popcounts of its four bit planes with a code give the inner
product of query and code, and the scalars turn that into an estimate of query and vector with a known error. A vector
is reranked (exact double inner product on the original components) unless estimate plus error bound stays below the
k-th best exact score met so far.

Rows lie in cells: by number of components, by nearest of some directions fitted on a bounded sample, and by the binary
order of their length. Every row is in a cell. A query is held against the cells that promise most. How many is measured:
some queries are held against all rows by brute force, and the least number of cells that would have given them `RECALL`
of their neighbours is what every query gets. Vectors with structure need few cells; of vectors without any (all
directions alike) most cells are needed, and the work then grows with the square of the table. Tables of few cells are
searched whole. Neighbouring cells are bundled, so a query goes once to a bundle and brings k rows back from it; a large
cell is a bundle of its own and dealt to blocks by hash. Queries of a bundle are dealt to blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY = 20, 20
BOUND = 3.0  #: standard errors that an estimate may be off before its vector can be missed
PLANES = 4
LEAST_BITS = 256  #: bits of a code at least: short vectors are rotated into a wider space, for the error falls with its root
STEP = 64  #: queries estimated at a time
SEED = 7
#: Rows a cell has on average, and how many cells there are at most; vectors of the sample that directions are fitted on
#: a cell, numbers in the sample at most, rounds of fitting.
CELL, MOST_CELLS, PER_CELL, SAMPLE_NUMBERS, ROUNDS = 1_024, 4_096, 32, 1 << 24, 10
#: The share of the measured queries' neighbours that the cells must hold, how many queries are measured, cells up to which
#: all are searched, and rows that a query's cells hold at least.
RECALL, MEASURED, FEW_CELLS, PROBED = 0.98, 256, 8, 1_024
ROW_BLOCK, QUERY_BLOCK = 8_192, 4_096  #: rows of a bundle, or of a large cell's block, and queries that a task holds
TOGETHER = 0.6  #: share of a bundle's queries and cells that meet from which all of them do, at once
LONGEST_BAND = 40  #: lengths from 2**-40 to 2**40 have bands of their own


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation to a multiple of 64 dimensions, LEAST_BITS at least: dim x padded, orthonormal rows."""
    wide = max(-(-dim // 64) * 64, LEAST_BITS)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


_rotations: dict[int, np.ndarray] = {}


def _rotation(dim: int) -> np.ndarray:
    """The worker's rotation."""
    if dim not in _rotations:
        if len(_rotations) > 8:
            _rotations.clear()
        _rotations[dim] = rotation(dim)
    return _rotations[dim]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the lengths; scaled by the largest component first, so squares neither overflow nor vanish."""
    big = np.abs(x).max(1, keepdims=True)
    y = x / big
    length = np.sqrt((y * y).sum(1, keepdims=True))
    with np.errstate(over="ignore"):
        norm = np.minimum(big * length, np.finfo("f8").max)
    return y / length, norm[:, 0]


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes n x words, lengths, inner products of unit vector and code)."""
    u, norm = unit(x)
    y = u @ rot
    factor = np.abs(y).sum(1) / np.sqrt(y.shape[1])
    return np.packbits(y > 0, axis=1, bitorder="little").view("<u8"), norm, factor


def estimates(queries: np.ndarray, rot: np.ndarray, codes: np.ndarray, norm: np.ndarray, factor: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors, and the bound on their error (queries x vectors)."""
    u, length = unit(queries)
    q = u @ rot
    wide = q.shape[1]
    low = q.min(1, keepdims=True)
    step = np.maximum((q.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    whole = np.rint((q - low) / step).astype("u1")
    rounded = low + step * whole
    on = np.zeros((len(q), len(codes)), "f4")  # sum of the rounded query's whole numbers where the code's bit is set
    for p in range(PLANES):
        plane = np.packbits(whole >> p & 1, axis=1, bitorder="little").view("<u8")
        for w in range(codes.shape[1]):
            on += np.float32(1 << p) * np.bitwise_count(plane[:, w, None] & codes[None, :, w])
    ones = np.bitwise_count(codes).sum(1)
    with_code = (2 * (step * on + low * ones) - rounded.sum(1, keepdims=True)) / np.sqrt(wide)
    off = np.sqrt(((q - rounded) ** 2).sum(1, keepdims=True))
    error = bound * np.sqrt((1 - factor**2).clip(0) / (wide - 1) + off**2 / wide)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = norm * length[:, None]
        return with_code / factor * scale, error / factor * scale


def exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b, both held column by column, in double precision, components in order.
    One that overflows both ways has no value and comes last."""
    out = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for left, right in zip(a, b, strict=True):
            out += left[i] * right[j]
    return np.where(np.isnan(out), -np.inf, out)


def _kth(part: np.ndarray, est: np.ndarray, own: np.ndarray, columns: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the 4 k rows of the best estimates (-inf with fewer than k)."""
    first = min(4 * k, est.shape[1])
    near = np.argpartition(-est, first - 1, axis=1)[:, :first]
    score = exact(part, np.repeat(np.arange(len(near)), first), columns, near.ravel()).reshape(near.shape)
    score[np.take_along_axis(own, near, 1)] = -np.inf
    return np.sort(score, axis=1)[:, -k] if first >= k else np.full(len(score), -np.inf)


def search(qid: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, coded, rot: np.ndarray, k: int, bound: float = BOUND, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest among the rows but its own, without those below the query's floor: (index of query, index of
    row, score)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    columns = np.ascontiguousarray(x.T)
    for lo in range(0, len(q), STEP):
        part = q[lo : lo + STEP]
        est, err = estimates(part, rot, *coded, bound)
        own = qid[lo : lo + STEP, None] == rows[None, :]
        est = np.where(own, -np.inf, np.nan_to_num(est))
        least = None if floor is None else floor[lo : lo + STEP]
        if least is not None and np.isfinite(least).all():  # all have k scores already
            part, kth = np.ascontiguousarray(part.T), least
        else:
            part = np.ascontiguousarray(part.T)
            kth = _kth(part, est, own, columns, k)
            kth = kth if least is None else np.maximum(kth, least)
        with np.errstate(over="ignore"):
            i, j = np.nonzero(~(est + np.nan_to_num(err) < kth[:, None]) & ~own)
        s = exact(part, i, columns, j)
        reach = (s >= kth[i]) & (s > -np.inf)
        i, j, s = i[reach], j[reach], s[reach]
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[keep] + lo, j[keep], s[keep]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def directions(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k unit vectors, each near to the mean of the unit vectors that are nearest to it (fewer than k samples: one)."""
    rng = np.random.default_rng(seed)
    if len(sample) < k or k == 1:
        mean = sample.sum(0, keepdims=True) if len(sample) else np.ones((1, sample.shape[1]))
        return (mean / max(np.linalg.norm(mean), 1e-300)).astype("f4")
    u = sample.astype("f4")
    c = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        own = nearest_of(u, c)
        total = np.zeros((k, u.shape[1]))
        np.add.at(total, own, u)
        lone = np.linalg.norm(total, axis=1) < 1e-9
        total[lone] = u[rng.choice(len(u), int(lone.sum()))]
        c = (total / np.linalg.norm(total, axis=1, keepdims=True)).astype("f4")
    return c


def nearest_of(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The direction with the largest inner product, for each vector."""
    out = np.empty(len(u), "i4")
    for lo in range(0, len(u), 1_024):
        out[lo : lo + 1_024] = (u[lo : lo + 1_024] @ c.T).argmax(1)
    return out


def probed(u: np.ndarray, c: np.ndarray, cells: np.ndarray, probes: int, rows: int) -> list[np.ndarray]:
    """For each unit query, the places in `cells` (direction, band, rows) that it is held against: those that promise the
    largest inner products, as many as `probes` and as hold `rows` rows."""
    promise = u @ c[cells[:, 0]].T + 2 / np.sqrt(u.shape[1])
    promise = np.where(promise > 0, promise * np.exp2(cells[:, 1]), promise * np.exp2(-cells[:, 1]))
    order = np.argsort(-promise, axis=1, kind="stable")
    held = np.cumsum(cells[order, 2], axis=1)
    many = np.maximum((held < rows).sum(1) + 1, probes)
    return [o[:m] for o, m in zip(order, many, strict=True)]


def bundles(own: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """The bundle of each cell (direction, band, rows): neighbouring directions together, up to `size` rows; larger cells alone."""
    near = nearest_of(c, directions(c, max(1, len(c) // 16))) if len(c) > 16 else np.zeros(len(c), "i4")
    out = np.zeros(len(own), "i8")
    last, held = -1, size + 1
    for i in np.lexsort((own[:, 1], own[:, 0], near[own[:, 0]])):
        n = int(own[i, 2])
        if held + n > size:
            last, held = last + 1, 0
        out[i] = last
        held += n
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype("f8")


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(components, rows with as many) of rows (row, vec_id, embedding)."""
    sizes = b.column(2).value_lengths().to_numpy()
    for dim in np.unique(sizes):
        yield int(dim), b.filter(pa.array(sizes == dim))


def probes_for(recall: float, ranks: np.ndarray) -> int:
    """The least number of cells that hold `recall` of the neighbours, whose cells have these places in their queries' orders."""
    return int(np.sort(ranks)[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _ranks(coded: DataFrame, asks: list, centres: dict, cells: dict, k: int) -> dict[int, np.ndarray]:
    """For each length among the measured queries, the places that the cells of their k nearest have in their orders."""
    ids = {dim: np.array([r["row"] for r in asks if r["dim"] == dim], "i8") for dim in {r["dim"] for r in asks}}
    q = {dim: np.array([r["embedding"] for r in asks if r["dim"] == dim], "f8") for dim in ids}
    shared = coded.sparkSession.sparkContext.broadcast((ids, q))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's k best rows of each query."""
        ids, q = shared.value
        best = {dim: [np.empty((len(q[dim]), 0)) for _ in range(3)] for dim in q}  # scores, centres, bands
        for b in batches:
            for dim, part in _by_length(b):
                if dim in q:
                    s = exact_all(q[dim], _vectors(part.column(2), dim))
                    s[ids[dim][:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                    new = [s, *(np.broadcast_to(part.column(c).to_numpy().astype("f8"), s.shape) for c in (3, 4))]
                    both = [np.concatenate(x, 1) for x in zip(best[dim], new, strict=True)]
                    top = np.argsort(-both[0], axis=1, kind="stable")[:, :k]
                    best[dim] = [np.take_along_axis(x, top, 1) for x in both]
        for dim, (s, c, band) in best.items():
            at = np.repeat(np.arange(len(s)), s.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, dim, "i4")), pa.array(at), pa.array(s.ravel()), pa.array(c.ravel()), pa.array(band.ravel())], names=["dim", "query", "score", "centre", "band"])

    rows = coded.select("row", "vec_id", "embedding", "centre", "band").mapInArrow(score, "dim int, query long, score double, centre double, band double")
    best = Window.partitionBy("dim", "query").orderBy(F.desc("score"))
    found = rows.where("score > double('-inf')").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).collect()  # MEASURED x k rows
    out: dict[int, list[int]] = {}
    for dim, x in q.items():
        order = probed(unit(x)[0].astype("f4"), centres[dim], cells[dim], len(cells[dim]), 0)
        names = {(c, band): i for i, (c, band, _) in enumerate(cells[dim].tolist())}
        places = [dict(zip(o.tolist(), range(len(o)), strict=True)) for o in order]
        out[dim] = [places[r["query"]][names[int(r["centre"]), int(r["band"])]] for r in found if r["dim"] == dim]
    return {dim: np.array(v) for dim, v in out.items() if v}


def exact_all(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of two sets of vectors, in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
    return np.where(np.isnan(s), -np.inf, s)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, bound: float = BOUND, cell: int = CELL, recall: float = RECALL, most_cells: int = MOST_CELLS) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null vec_id.
    Vectors of other lengths are searched among their own length. Rows that repeat a vec_id are candidates and queries of
    their own (a row is never its own neighbour). A pair whose inner product overflows both ways takes no part. An empty
    table gives an empty result. Other columns are left out.

    Directions are fitted on at most PER_CELL vectors a cell (SAMPLE_NUMBERS numbers in all), those of the least hashes;
    the number of cells searched is measured on the MEASURED queries of the least hashes, against all rows.
    """
    spark = common.ship(vectors.sparkSession)
    kind = "array<float>" if "FloatType" in repr(vectors.schema["embedding"].dataType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).where("vec_id is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row a length
    total = sum(sizes.values())
    of = {dim: max(1, min(n // cell, most_cells * n // total)) for dim, n in sizes.items()}
    centres = {dim: np.zeros((1, dim), "f4") for dim in sizes}
    many = {dim: m for dim, m in of.items() if m > 1}
    if many:
        share = min(1.0, sum(PER_CELL * m for m in many.values()) / total, SAMPLE_NUMBERS / sum(d * sizes[d] for d in many))
        at = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30))
        drawn = rows.where((at < int(share * (1 << 30))) & F.size("embedding").isin(list(many))).select("embedding")
        held = drawn.limit(2 * int(share * total) + 1_000).toArrow().column(0).combine_chunks()
        lengths = held.value_lengths().to_numpy()
        for dim, m in many.items():
            centres[dim] = directions(unit(_vectors(held.filter(pa.array(lengths == dim)), dim))[0], m)
    shared = spark.sparkContext.broadcast(centres)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                x = _vectors(part.column(2), dim)
                codes, norm, factor = encode(x, _rotation(dim))
                own = nearest_of(unit(x)[0].astype("f4"), shared.value[dim])
                band = np.rint(np.log2(norm)).clip(-LONGEST_BAND, LONGEST_BAND).astype("i4")
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed, pa.array(norm), pa.array(factor), pa.array(np.full(len(x), dim, "i4")), pa.array(own), pa.array(band)], names=[*part.schema.names, "code", "norm", "factor", "dim", "centre", "band"])

    base = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    coded = common.cut(base.mapInArrow(index, f"row long, vec_id long, embedding {kind}, code binary, norm double, factor double, dim int, centre int, band int"))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r in coded.groupBy("dim", "centre", "band").agg(F.count("*").alias("n")).collect():  # a row a cell
        found.setdefault(r["dim"], []).append((r["centre"], r["band"], r["n"]))
    cells = {dim: np.array(sorted(v)) for dim, v in found.items()}
    first = dict(zip(cells, np.cumsum([0, *map(len, cells.values())]).tolist(), strict=False))
    is_query = F.col("vec_id") % every == 0
    probes = {dim: len(own) for dim, own in cells.items()}
    large = [dim for dim, own in cells.items() if len(own) > FEW_CELLS]
    if large:
        asks = coded.where(is_query & F.col("dim").isin(large)).orderBy(F.xxhash64("vec_id", "embedding"), "row").limit(MEASURED).select("row", "embedding", "dim").collect()
        for dim, ranks in _ranks(coded, asks, centres, cells, k).items():
            probes[dim] = probes_for(recall, ranks)
    n_cells = sum(map(len, cells.values()))
    bundle, n_bundles = np.zeros(n_cells, "i8"), 0
    held_rows = np.zeros(n_cells, "i8")
    for dim, own in cells.items():
        at = slice(first[dim], first[dim] + len(own))
        bundle[at] = bundles(own, centres[dim], ROW_BLOCK) + n_bundles
        n_bundles = int(bundle[at].max()) + 1
        held_rows[at] = own[:, 2]
    blocks = -(-np.bincount(bundle, held_rows, n_bundles).astype("i8") // ROW_BLOCK)
    table = spark.sparkContext.broadcast((cells, first, probes, bundle))

    def routed(part: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(index of query, bundle, the query's cells in it) of a batch's queries."""
        own, start, many = (t[dim] for t in table.value[:3])
        u = unit(_vectors(part.column(2), dim))[0].astype("f4")
        at, where, inside = [], [], []
        for lo in range(0, len(u), 256):
            for i, places in enumerate(probed(u[lo : lo + 256], shared.value[dim], own, many, PROBED), lo):
                places = places + start
                of = table.value[3][places]
                order = np.argsort(of, kind="stable")
                names, begin = np.unique(of[order], return_index=True)
                at += [i] * len(names)
                where += names.tolist()
                inside += np.split(places[order], begin[1:])
        return np.array(at, "i8"), np.array(where, "i8"), inside

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                yield pa.RecordBatch.from_arrays([pa.array(routed(part, dim)[1], pa.int64())], names=["bundle"])

    asked = coded.where(is_query).select("row", "vec_id", "embedding").mapInArrow(route, "bundle long").groupBy("bundle").agg(F.count("*").alias("n")).collect()  # a row a bundle
    query_blocks = np.zeros(n_bundles, "i8")
    for r in asked:
        query_blocks[r["bundle"]] = -(-r["n"] // QUERY_BLOCK)
    dealt = spark.sparkContext.broadcast((blocks, query_blocks))
    out_schema = f"bundle long, rb int, qb int, asked boolean, cells array<int>, row long, vec_id long, embedding {kind}, code binary, norm double, factor double"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its cell's bundle, once for each block of queries there; each query to all blocks of its bundles."""

        def out(part: pa.RecordBatch, take: np.ndarray, where: np.ndarray, rb: np.ndarray, qb: np.ndarray, inside: list[np.ndarray], asks: bool) -> pa.RecordBatch:
            t = part.take(pa.array(take))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in inside])])
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*inside, np.empty(0, "i8")]), pa.int32()))
            keys = [pa.array(where, pa.int64()), pa.array(rb, pa.int32()), pa.array(qb, pa.int32()), pa.array(np.full(len(take), asks)), own]
            cols = [pa.nulls(len(take), c.type) if asks and i > 2 else c for i, c in enumerate(t.columns[:6])]
            return pa.RecordBatch.from_arrays([*keys, *cols], names=["bundle", "rb", "qb", "asked", "cells", *t.schema.names[:6]])

        def spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            take = np.repeat(np.arange(len(times)), times)
            return take, np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)

        blocks, query_blocks = dealt.value
        for b in batches:
            for dim, part in _by_length(b):
                own, start = table.value[0][dim], table.value[1][dim]
                place = {(c, d): i + start for i, (c, d, _) in enumerate(own.tolist())}
                cell = np.array([place[x] for x in zip(part.column(7).to_pylist(), part.column(8).to_pylist(), strict=True)])
                where, key = table.value[3][cell], part.column(0).to_numpy()
                take, qb = spread(query_blocks[where])
                yield out(part, take, where[take], key[take] % blocks[where[take]], qb, list(cell[take, None]), False)
                queries = part.filter(pa.array(part.column(1).to_numpy() % every == 0))
                if queries.num_rows:
                    i, where, inside = routed(queries, dim)
                    take, rb = spread(blocks[where])
                    own_key = queries.column(0).to_numpy()[i[take]]
                    for lo in range(0, len(take), 20_000):
                        t = take[lo : lo + 20_000]
                        yield out(queries, i[t], where[t], rb[lo : lo + 20_000], own_key[lo : lo + 20_000] % query_blocks[where[t]], [inside[j] for j in t], True)

    def block(held: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        asks = held.column("asked").combine_chunks()
        left, right = held.filter(pc.invert(asks)).combine_chunks(), held.filter(asks).combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        dim = len(left.column("embedding")[0])
        x, q = (_vectors(t.column("embedding").combine_chunks(), dim) for t in (left, right))
        numpy = lambda t, c: t.column(c).to_numpy()
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), "<u8").reshape(len(x), -1)
        row, ids, norm, factor = (numpy(left, c) for c in ("row", "vec_id", "norm", "factor"))
        qrow, qid = numpy(right, "row"), numpy(right, "vec_id")
        cell = left.column("cells").combine_chunks().flatten().to_numpy()
        lists = right.column("cells").combine_chunks()
        of = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        wanted = lists.flatten().to_numpy()
        best = np.full((len(q), k), -np.inf)
        found = []
        if len(wanted) >= TOGETHER * len(q) * len(np.unique(cell)):  # nearly all meet anyway
            cell, of, wanted = np.zeros(len(cell), "i4"), np.arange(len(q)), np.zeros(len(q), "i4")
        for c in np.unique(cell):
            rows, at = np.flatnonzero(cell == c), of[wanted == c]
            if len(at):
                i, j, s = search(qrow[at], q[at], row[rows], ids[rows], x[rows], (codes[rows], norm[rows], factor[rows]), _rotation(dim), k, bound, best[at, 0])
                new = np.full((len(at), k), -np.inf)
                new[i, np.arange(len(i)) - np.searchsorted(i, i)] = s
                best[at] = np.sort(np.concatenate([best[at], new], 1), axis=1)[:, -k:]
                found.append((at[i], rows[j], s))
        i, j, s = (np.concatenate([f[c] for f in found]) if found else np.empty(0, "i8") for c in range(3))
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table([pa.array(qrow[i[keep]]), pa.array(qid[i[keep]]), pa.array(ids[j[keep]]), pa.array(s[keep].astype("f8"))], names=names)

    spread = coded.mapInArrow(deal, out_schema)
    near = spread.groupBy("bundle", "rb", "qb").applyInArrow(block, "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))


#: Brute force over all rows; equal to the query where all cells are searched, as on tables of up to FEW_CELLS x CELL rows.
OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
