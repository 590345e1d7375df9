"""Physical model over DataFrames: a row a molecule (energies as an array), kernels on Arrow batches.

Input rows: mol (long), e (array<double>, null elements missing). Results don't depend on partitioning: each molecule
is solved alone and every random draw has a seed of its own."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics, statistics
from ..shipping import ship


def _spread(rows: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Deals rows of long work to all cores; a count of its own keeps small rows from being put together again."""
    ship(rows.sparkSession)
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


TOGETHER = 512  #: molecules that a kernel takes at a time


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows with energies of one length, TOGETHER at most."""
    for _, part in b.groupby(b["e"].map(len)):
        for lo in range(0, len(part), TOGETHER):
            yield part.iloc[lo : lo + TOGETHER]


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.array([np.array(v, float) for v in part["e"]])


def exact(mols: DataFrame, settings: physics.Settings) -> DataFrame:
    """mol, status, logz, mean_n, var_n, occupancy and var_occupancy (arrays). A molecule with a missing energy at a possible
    start has status no_energy and nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b):
                out = physics.solve(_matrix(part), settings)
                bad = np.isnan(out["logz"])
                one = lambda v, bad=bad: [None if q else float(x) for x, q in zip(v, bad, strict=True)]
                row = lambda v, bad=bad: [None if q else x.tolist() for x, q in zip(v, bad, strict=True)]
                yield pd.DataFrame({"mol": part["mol"].to_numpy(), "status": np.where(bad, "no_energy", "ok"), **{c: one(out[c]) for c in ("logz", "mean_n", "var_n")}, **{c: row(out[c]) for c in ("occupancy", "var_occupancy")}})

    return _spread(mols, "mol").mapInPandas(run, "mol long, status string, logz double, mean_n double, var_n double, occupancy array<double>, var_occupancy array<double>")


def samples(mols: DataFrame, settings: physics.Settings, nsim: int, seed: int) -> DataFrame:
    """mol, run, status, seed, energy, positions: exact samples, all of a molecule from one solution. A molecule with a missing
    energy has status no_energy and nulls."""
    return sampled_runs(mols.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(nsim - 1)))), settings, seed)


def sampled_runs(runs: DataFrame, settings: physics.Settings, seed: int) -> DataFrame:
    """As `samples`, for given (mol, run, e)."""
    grouped = runs.groupBy("mol").agg(F.first("e").alias("e"), F.sort_array(F.collect_list("run")).alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for mol, e, wanted in b[["mol", "e", "runs"]].itertuples(index=False):
                e = np.asarray(e, float)
                own = [physics.run_seed(seed, 0, int(mol), int(r)) for r in wanted]
                for r, o, pos in zip(wanted, own, physics.samples(e, settings, own), strict=True):
                    rows.append((mol, r, "no_energy", o, None, None) if pos is None else (mol, r, "ok", o, physics.config_energy(pos, e, settings), pos))
            yield pd.DataFrame(rows, columns=["mol", "run", "status", "seed", "energy", "positions"])

    return _spread(grouped, "mol").mapInPandas(run, "mol long, run int, status string, seed long, energy double, positions array<int>")


def trajectories(mols: DataFrame, settings: physics.Settings, nsim: int, seed: int, nsweep: int, start_temp: float, freq: int = 1, cooling: str = "linear") -> DataFrame:
    """mol, run, time, energy, temp, positions: Metropolis frames; runs of a batch move in step. Runs of a molecule with a
    missing energy have no frames (they count as missing in a census of runs)."""
    return trajectory_runs(mols.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(nsim - 1)))), settings, seed, nsweep, start_temp, freq, cooling)


def trajectory_runs(runs: DataFrame, settings: physics.Settings, seed: int, nsweep: int, start_temp: float, freq: int = 1, cooling: str = "linear") -> DataFrame:
    """As `trajectories`, for given (mol, run, e)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b):
                mol, nth = part["mol"].to_numpy(), part["run"].to_numpy()
                seeds = [physics.run_seed(seed, 0, int(m), int(r)) for m, r in zip(mol, nth, strict=True)]
                frames = physics.metropolis_runs(_matrix(part), settings, nsweep, start_temp, seeds, cooling, freq)
                yield pd.DataFrame([(mol[i], nth[i], *f) for i, *f in frames], columns=["mol", "run", "time", "energy", "temp", "positions"])

    # a step's cost hardly grows with the runs that take it together: one part a core, not more
    return _spread(runs, "mol", "run", parts=runs.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "mol long, run int, time long, energy double, temp double, positions array<int>")


def occupancy(frames: DataFrame, nbp: int, nucbp: int) -> DataFrame:
    """mol, pos, occ: share of a molecule's runs that cover each position, from start positions by running sums."""
    runs = frames.groupBy("mol").agg(F.count("*").alias("runs"))
    step = frames.select("mol", F.explode("positions").alias("s")).select("mol", F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("s") + nucbp).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    step = step.groupBy("mol", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    grid = runs.select("mol", "runs", F.explode(F.sequence(F.lit(0), F.lit(nbp - 1))).alias("pos"))
    total = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("mol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(step, ["mol", "pos"], "left").select("mol", "pos", (total / F.col("runs")).alias("occ"))


def occupancy_at(frames: DataFrame, nbp: int, nucbp: int, time: int | None = None) -> DataFrame:
    """mol, pos, occ of Metropolis frames at a time (each run's last frame by default)."""
    last = frames.groupBy("mol", "run").agg(F.max("time").alias("time")) if time is None else None
    held = frames.where(F.col("time") == time) if last is None else frames.join(last, ["mol", "run", "time"])
    return occupancy(held.select("mol", "positions"), nbp, nucbp)


def mean_count(frames: DataFrame, time: int | None = None) -> DataFrame:
    """mol, mean_n, runs: mean number of starts over a molecule's runs, at a time (the last frame by default)."""
    count = F.size("positions").cast("double")
    if time is not None:
        held = frames.where(F.col("time") == time).select("mol", count.alias("n"))
    else:
        held = frames.groupBy("mol", "run").agg(F.max_by(count, "time").alias("n"))
    return held.groupBy("mol").agg(F.avg("n").alias("mean_n"), F.count("*").alias("runs"))


def llink_evidence(mols: DataFrame, settings: physics.Settings, candidates: list[int]) -> DataFrame:
    """llink, evidence, mols: sum over molecules of log Z with the data less log Z without, for each candidate; molecules with
    missing energies don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for llink, own in b.groupby("llink"):
                s = replace(settings, llink=int(llink))
                for part in _parts(own):
                    e = _matrix(part)
                    z = physics.log_z(e, s) - physics.log_z(np.zeros((1, e.shape[1])), s)[0]
                    yield pd.DataFrame({"llink": [int(llink)], "evidence": [float(np.nansum(z))], "mols": [int((~np.isnan(z)).sum())]})

    spread = mols.withColumn("llink", F.explode(F.array(*map(F.lit, candidates))))
    found = _spread(spread, "mol", "llink").mapInPandas(run, "llink int, evidence double, mols long")
    return found.groupBy("llink").agg(F.sum("evidence").alias("evidence"), F.sum("mols").alias("mols"))


CHANNELS = (1, 2, 3, 4)
ONE_TASK = 2_000_000  #: bins of a group that one task fits; larger groups are fitted by a round of sums at a time
_FIT = "rate_prot double, rate_acc double, pi double, loglik double, margin double, contrast double"


def wide_bins(bins: DataFrame, *sums: str, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(keys, mol, bin, channel, sums) -> keys, mol, bin and each sum as an array over CHANNELS (zero where a bin has none)."""
    each = [F.array(*(F.coalesce(F.sum(F.when(F.col("channel") == c, F.col(x))), F.lit(0.0)).cast("double") for c in CHANNELS)).alias(x) for x in sums]
    return bins.groupBy(*keys, "mol", "bin").agg(*each)


def em_fit(bins: DataFrame, keys: tuple[str, ...] = ("chrom",), one_task: int = ONE_TASK) -> DataFrame:
    """(keys, mol, bin, channel, k, n) -> keys, channel, rate_prot, rate_acc, pi, loglik, margin and contrast (of the channel
    tests); one fit for each group of keys. A group of more than `one_task` bins is fitted by rounds of distributed sums."""
    wide = wide_bins(bins, "k", "n", keys=keys)
    ship(bins.sparkSession)
    sizes = wide.groupBy(*keys).agg(F.count("*").alias("bins_")).cache()
    large = [r for r in sizes.where(F.col("bins_") > one_task).collect()]  # a row a large group
    small = wide.join(F.broadcast(sizes.where(F.col("bins_") <= one_task).drop("bins_")), list(keys)) if large else wide

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        k, n = (np.stack(b[c].to_numpy()) for c in ("k", "n"))
        used = n.sum(0) > 0
        got = statistics.em(k[:, used], n[:, used])
        margin, contrast = statistics.channel_tests(k[:, used], n[:, used], None, got["rate_prot"], got["rate_acc"], got["pi"])
        out = pd.DataFrame({"channel": np.array(CHANNELS)[used], "rate_prot": got["rate_prot"], "rate_acc": got["rate_acc"], "pi": got["pi"], "loglik": got["loglik"], "margin": margin, "contrast": contrast})
        for c in reversed(keys):
            out.insert(0, c, b[c].iloc[0])
        return out

    schema = ", ".join(f"{c} string" for c in keys) + f", channel long, {_FIT}"
    out = small.groupBy(*keys).applyInPandas(fit, schema)
    for r in large:
        own = wide
        for c in keys:
            own = own.where(F.col(c) == r[c])
        rows = em_rounds(own.select("k", "n"))
        out = out.unionByName(bins.sparkSession.createDataFrame([(*(r[c] for c in keys), *x) for x in rows], schema))
    return out


def em_rounds(wide: DataFrame, max_iters: int = 200, tol: float = 1e-8) -> list[tuple]:
    """The fit of `statistics.em` and its channel tests from bins (k, n: arrays over CHANNELS) that no task holds together:
    every round is one sum over all bins for all starts. Rows (channel, protected, accessible, share, log-likelihood, margin,
    contrast)."""
    eps, size = statistics.EPS, len(CHANNELS)
    wide = wide.select(*(F.col(x)[c].alias(f"{x}{c}") for x in "kn" for c in range(size))).persist()

    def total(columns: dict) -> dict:
        return wide.agg(*(F.sum(v).alias(k) for k, v in columns.items())).first().asDict()

    def likelihood(p, channels=range(size)):
        return sum((F.col(f"k{c}") * math.log(p[c]) + F.col(f"n{c}") * math.log1p(-p[c]) - F.col(f"k{c}") * math.log1p(-p[c]) for c in channels), F.lit(0.0))

    try:
        one = F.expr("1D")
        sums = total({f"{x}{c}": F.col(f"{x}{c}") for x in "kn" for c in range(size)} | {"bins": one} | {f"b{c}": (F.col(f"n{c}") > 0).cast("double") for c in range(size)})
        used = [c for c in range(size) if sums[f"n{c}"] > 0]
        clip = lambda v: min(max(v, eps), 1 - eps)
        pooled = sum((F.col(f"k{c}") for c in range(size)), F.lit(0.0)) / sum((F.col(f"n{c}") for c in range(size)), F.lit(0.0))
        cuts = wide.agg(F.percentile_approx(pooled, [0.25, 0.5, 0.75], 100_000).alias("q")).first()["q"]
        fits = [[{c: 0.05 for c in used}, {c: 0.95 for c in used}, 0.75]]
        low = total({f"{i}{x}{c}": F.when(pooled <= cut, F.col(f"{x}{c}")).otherwise(0.0) for i, cut in enumerate(cuts) for x in "kn" for c in used})
        for i, q in enumerate((0.25, 0.5, 0.75)):
            part = lambda sign, c, i=i: [v if sign else sums[f"{x}{c}"] - v for x, v in (("k", low[f"{i}k{c}"]), ("n", low[f"{i}n{c}"]))]
            group = lambda sign, part=part: {c: clip(k / n if n > 0 else sums[f"k{c}"] / sums[f"n{c}"]) for c in used for k, n in [part(sign, c)]}
            fits.append([group(True), group(False), q])
        last, open_, ll = [-math.inf] * len(fits), set(range(len(fits))), [-math.inf] * len(fits)

        def pass_over(which, moments=True):
            columns = {}
            for i in which:
                tp, ta, pi = fits[i]
                lp, la = math.log(pi) + likelihood(tp, used), math.log1p(-pi) + likelihood(ta, used)
                top = F.greatest(lp, la)
                columns[f"ll{i}"] = top + F.log1p(F.exp(-F.abs(lp - la)))
                w = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(la - lp, F.lit(-700.0)), F.lit(700.0))))
                columns[f"w{i}"] = w
                if moments:
                    columns |= {f"{i}{x}{c}": w * F.col(f"{x}{c}") for x in "kn" for c in used}
            return total(columns)

        for _ in range(max_iters):
            got = pass_over(open_)
            for i in list(open_):
                k, n = ({c: got[f"{i}{x}{c}"] for c in used} for x in "kn")
                tp = {c: clip(k[c] / n[c]) if n[c] > 0 else fits[i][0][c] for c in used}
                ta = {c: clip((sums[f"k{c}"] - k[c]) / (sums[f"n{c}"] - n[c])) if sums[f"n{c}"] - n[c] > 0 else fits[i][1][c] for c in used}
                ll[i] = got[f"ll{i}"]
                fits[i] = [tp, ta, min(max(got[f"w{i}"] / sums["bins"], 1e-12), 1 - 1e-12)]
                if abs(ll[i] - last[i]) < tol * max(1, abs(ll[i])):
                    open_.discard(i)
                last[i] = ll[i]
            if not open_:
                break
        got = pass_over(range(len(fits)), False)
        lo, hi = statistics.PI_RANGE
        best = max(range(len(fits)), key=lambda i: (lo <= fits[i][2] <= hi, got[f"ll{i}"]))
        tp, ta, pi = fits[best]
        if sum(tp[c] * sums[f"n{c}"] for c in used) > sum(ta[c] * sums[f"n{c}"] for c in used):
            tp, ta, pi = ta, tp, 1 - pi
        alone = {c: clip(sums[f"k{c}"] / sums[f"n{c}"]) for c in used}
        columns = {}
        for c in used:
            lp, la = math.log(pi) + likelihood(tp, [c]), math.log1p(-pi) + likelihood(ta, [c])
            columns[f"two{c}"] = F.greatest(lp, la) + F.log1p(F.exp(-F.abs(lp - la)))
            columns[f"one{c}"] = likelihood(alone, [c])
        tests = total(columns)
        return [(CHANNELS[c], tp[c], ta[c], pi, got[f"ll{best}"], 2 * (tests[f"two{c}"] - tests[f"one{c}"]) - math.log(sums[f"b{c}"]), (ta[c] - tp[c]) / ta[c]) for c in used]
    finally:
        wide.unpersist()


def leak_fit(bins: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(keys, mol, bin, channel, k, n, sf, sd) -> keys, channel, leak, bound, pi, loglik, margin, contrast: the leak of each
    channel given the controls' profiles; one fit for each group of keys, in one task (its bins take some 128 bytes each)."""
    wide = wide_bins(bins, "k", "n", "sf", "sd", keys=keys)
    ship(bins.sparkSession)

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        k, n, sf, sd = (np.stack(b[c].to_numpy()) for c in ("k", "n", "sf", "sd"))
        used = n.sum(0) > 0
        k, n, sf, sd = (x[:, used] for x in (k, n, sf, sd))
        got = statistics.leak(k, n, sf, sd)
        ones = np.ones(k.shape[1])
        margin, contrast = statistics.channel_tests(k, n, (sf, sd), got["rate_prot"], ones, got["pi"], np.zeros(len(ones)), got["bound"])
        out = pd.DataFrame({"channel": np.array(CHANNELS)[used], "leak": got["rate_prot"], "bound": got["bound"], "pi": got["pi"], "loglik": got["loglik"], "margin": margin, "contrast": contrast})
        for c in reversed(keys):
            out.insert(0, c, b[c].iloc[0])
        return out

    return wide.groupBy(*keys).applyInPandas(fit, ", ".join(f"{c} string" for c in keys) + ", channel long, leak double, bound double, pi double, loglik double, margin double, contrast double")


def nu_fit(counts: DataFrame) -> DataFrame:
    """(chrom, source, channel, k, n) a site -> chrom, source, channel, nu. Sites with equal (k, n) are counted first."""
    ship(counts.sparkSession)
    keys = ["chrom", "source", "channel"]
    folded = counts.groupBy(*keys, F.round("k", 6).alias("k"), "n").agg(F.count("*").alias("sites"))

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        nu = statistics.fit_nu(*(b[c].to_numpy(float) for c in ("k", "n")), weight=b["sites"].to_numpy(float))
        return pd.DataFrame({c: [b[c].iloc[0]] for c in keys} | {"nu": [nu]})

    return folded.groupBy(*keys).applyInPandas(fit, "chrom string, source string, channel long, nu double")


MOST_LINKED = 20_000  #: rows of a group that are clustered at most: their distances take 8 bytes a pair in one task
WARN_LINKED = 5_000
STRIP = 512  #: rows of a strip of the distance matrix


def distance_strips(mols: DataFrame, group: str = "chrom", metric: str = "euclidean") -> DataFrame:
    """(group, mol, e) -> group, rank, strip, distances (of the row of that rank to the rows of the strip, in rank order), the
    lower triangle: rows are ranked by mol, strips of STRIP rows meet pairwise, each pair of strips in a task of its own."""
    ship(mols.sparkSession)
    window = Window.partitionBy(group).orderBy("mol")  # groups hold MOST_LINKED rows at most
    rows = mols.select(group, "mol", "e").withColumn("rank", F.row_number().over(window) - 1).withColumn("strip", F.floor(F.col("rank") / STRIP).cast("int"))
    counts = rows.groupBy(group).agg((F.max("strip") + 1).alias("strips"))
    rows = rows.join(F.broadcast(counts), group)
    left = rows.select(group, F.col("strip").alias("hi"), F.explode(F.sequence(F.lit(0), F.col("strip"))).alias("lo"), "rank", "e", F.lit(True).alias("left"))
    right = rows.select(group, F.explode(F.sequence(F.col("strip"), F.col("strips") - 1)).alias("hi"), F.col("strip").alias("lo"), "rank", "e", F.lit(False).alias("left"))

    def block(b: pd.DataFrame) -> pd.DataFrame:
        a, c = b[b["left"]].sort_values("rank"), b[~b["left"]].sort_values("rank")
        d = statistics.distances(_matrix(a), _matrix(c), metric)
        return pd.DataFrame({group: b[group].iloc[0], "rank": a["rank"].to_numpy(), "strip": b["lo"].iloc[0], "distances": list(d)})

    kind = mols.schema[group].dataType.simpleString()
    return left.unionByName(right).groupBy(group, "hi", "lo").applyInPandas(block, f"{group} {kind}, rank long, strip int, distances array<double>")


def linkage_order(mols: DataFrame, group: str = "chrom", metric: str = "euclidean", method: str = "ward", fill: str | float | None = None, most: int = MOST_LINKED) -> DataFrame:
    """(group, mol, e) -> group, rank, mol: leaf order of each group's molecules. Distances are made in strips by all tasks;
    agglomeration holds one group's matrix in one task, so groups of more than `most` rows raise ValueError (take a sample or
    downsample first), and more than WARN_LINKED warn."""
    if method not in statistics.METHODS:
        raise ValueError(f"method is one of {statistics.METHODS}")
    sizes = mols.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if sizes > most:
        raise ValueError(f"a group has {sizes} rows; at most {most} are clustered")
    if sizes > WARN_LINKED:
        warnings.warn(f"a group has {sizes} rows: their distances take {sizes * sizes * 8 >> 20} MB in one task", stacklevel=2)
    if fill is not None:
        mols = fill_missing(mols, fill, group)
    strips = distance_strips(mols, group, metric)
    window = Window.partitionBy(group).orderBy("mol")
    names = mols.select(group, "mol").withColumn("rank", F.row_number().over(window).cast("long") - 1)
    gathered = strips.unionByName(names.select(group, "rank", F.lit(-1).alias("strip"), F.array(F.col("mol").cast("double")).alias("distances")))
    kind = mols.schema[group].dataType.simpleString()

    def order(b: pd.DataFrame) -> pd.DataFrame:
        mol = b[b["strip"] < 0].sort_values("rank")["distances"].map(lambda v: int(v[0])).to_numpy()
        d = np.full((len(mol), len(mol)), np.nan)
        for rank, strip, row in b.loc[b["strip"] >= 0, ["rank", "strip", "distances"]].itertuples(index=False):
            d[rank, strip * STRIP : strip * STRIP + len(row)] = row
        lower = np.tril(d, -1)
        found = statistics.leaves(statistics.linkage_of(lower + lower.T, method)) if len(mol) > 1 else [0]
        return pd.DataFrame({group: b[group].iloc[0], "rank": range(len(mol)), "mol": mol[list(found)]})

    return gathered.groupBy(group).applyInPandas(order, f"{group} {kind}, rank long, mol long")


def fill_missing(mols: DataFrame, fill: str | float, group: str = "chrom") -> DataFrame:
    """Missing elements of e by a number, or by the mean of their position in the group (0 where none has a value)."""
    if fill != "mean":
        return mols.withColumn("e", F.transform("e", lambda x: F.coalesce(x, F.lit(float(fill)))))
    means = mols.select(group, F.posexplode("e").alias("pos", "v")).groupBy(group, "pos").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("m"))
    means = means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("means_"))  # a row a group
    return mols.join(means, group).withColumn("e", F.zip_with("e", "means_", lambda x, m: F.coalesce(x, m))).drop("means_")


def extract(frames: DataFrame, aggregate: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's aggregate over the runs of each molecule: `aggregate(mol, frames)` gets the molecule's frames in order of run and
    time (those that there are) and returns rows of `schema`."""
    ship(frames.sparkSession)
    by = [c for c in ("run", "time") if c in frames.columns]
    return frames.groupBy("mol").applyInPandas(lambda b: aggregate(int(b["mol"].iloc[0]), b.sort_values(by, ignore_index=True)), schema)
