"""The engine's plans against DuckDB, and its kernels against enumeration and parameter recovery."""

import itertools

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from fibrion.functions import physics, statistics
from fibrion.operators import simulate
from fibrion.plans import catalogue, oracles, plotdata

SF = "/root/testdata/sf0.001"
#: Oracles written from the definitions, each over the smallest tables.
SOME = sorted(set(oracles.SQL) | {"distances", "strand_filter", "site_channels", "window_counts", "smooth_interpolate", "run_status", "tiling", "nearest_dyad"})


def plain(df):
    rows = df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(float(x) if isinstance(x, (float, int, np.number)) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "embeddings", "documents", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert plain(got) == plain(c.execute(catalogue.ORACLE_SQL[name]).df()[list(got.columns)])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def configurations(nbp, s):
    npos = nbp - s.nucbp + 1
    for k in range(npos // s.nucbp + 2):
        for c in itertools.combinations(range(npos), k):
            if all(b - a >= s.nucbp for a, b in zip(c, c[1:], strict=False)):
                yield list(c)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.integers(0, 4), st.floats(0, 3), st.floats(-2, 2), st.floats(0.4, 3), st.integers(1, 13), st.integers(0, 1 << 30))
def test_exact_solver_by_enumeration(nucbp, llink, elink, mu, temp, nbp, seed):
    """Random settings against all configurations."""
    s = physics.Settings(nucbp, llink, elink, mu, temp)
    e = np.random.default_rng(seed).normal(0, 1.5, nbp)
    z = mean = second = 0.0
    occ = np.zeros(nbp)
    for c in configurations(nbp, s):
        w = np.exp(-physics.config_energy(c, e, s) / temp)
        z, mean, second = z + w, mean + w * len(c), second + w * len(c) ** 2
        for p in c:
            occ[p : p + nucbp] += w
    got = physics.solve(e, s)
    assert got["logz"][0] == pytest.approx(np.log(z), abs=1e-9) and physics.log_z(e, s)[0] == pytest.approx(np.log(z), abs=1e-9)
    assert got["mean_n"][0] == pytest.approx(mean / z, abs=1e-9)
    assert got["var_n"][0] == pytest.approx(second / z - (mean / z) ** 2, abs=1e-8)
    assert np.allclose(got["occupancy"][0], occ / z, atol=1e-9) and np.allclose(got["var_occupancy"][0], occ / z * (1 - occ / z), atol=1e-9)


def test_samples_and_metropolis_agree_with_exact():
    s = physics.Settings(3, 3, 0.4, 0.5)
    e = np.random.default_rng(1).standard_normal(17)
    want = physics.solve(e, s)
    drawn = physics.samples(e, s, list(range(4_000)))
    seen = np.zeros(17)
    for c in drawn:
        for p in c:
            seen[p : p + 3] += 1 / len(drawn)
    assert np.allclose(seen, want["occupancy"][0], atol=0.04)
    frames = physics.metropolis_runs(np.tile(e, (60, 1)), s, 60, 1.0, list(range(60)), "constant")
    late = [len(f[4]) for f in frames if f[1] > 20]
    assert np.mean(late) == pytest.approx(want["mean_n"][0], abs=0.1)
    assert all(f[2] == pytest.approx(physics.config_energy(f[4], e, s)) and all(b - a >= 3 for a, b in zip(f[4], f[4][1:], strict=False)) for f in frames)
    alone = physics.metropolis(e, s, 60, 1.0, 7, "constant")
    assert alone == [f[1:] for f in frames if f[0] == 7]  # a run doesn't depend on the others
    assert physics.solve(np.zeros((2, 2)), s)["occupancy"].shape == (2, 2)


def test_missing_energies_have_no_result(spark):
    s = physics.Settings(3, 2, 0.5, 0.0)
    e = np.zeros((2, 10))
    e[0, 4] = np.nan
    assert np.isnan(physics.solve(e, s)["logz"][0]) and physics.sample(e[0], s, 1) is None
    assert {f[0] for f in physics.metropolis_runs(e, s, 2, 1.0, [1, 2])} == {1}
    mols = spark.createDataFrame([(0, [0.0, None] + [0.0] * 8), (1, [0.0] * 10)], "mol long, e array<double>")
    assert {(r.mol, r.status, r.logz is None, r.occupancy is None) for r in simulate.exact(mols, s).collect()} == {(0, "no_energy", True, True), (1, "ok", False, False)}
    assert {(r.mol, r.status) for r in simulate.samples(mols, s, 2, 0).collect()} == {(0, "no_energy"), (1, "ok")}
    assert {r.mol for r in simulate.trajectories(mols, s, 1, 0, 2, 1.0).collect()} == {1}


def test_em_recovers_rates():
    rng = np.random.default_rng(2)
    state = rng.random(5_000) < 0.4
    n = rng.integers(0, 16, (5_000, 3)).astype(float)
    n[:, 2] = rng.integers(5, 25, 5_000)
    k = rng.binomial(n.astype(int), np.where(state[:, None], [0.05, 0.15, 0.4], [0.8, 0.65, 0.4])).astype(float)
    got = statistics.em(k, n)
    assert np.allclose(got["rate_prot"], [0.05, 0.15, 0.4], atol=0.02) and np.allclose(got["rate_acc"], [0.8, 0.65, 0.4], atol=0.02)
    assert got["pi"] == pytest.approx(0.4, abs=0.03)
    margin, contrast = statistics.channel_tests(k, n, None, got["rate_prot"], got["rate_acc"], got["pi"])
    assert margin[0] > 0 and margin[1] > 0 and margin[2] < 0 and contrast[0] > 0.9 and abs(contrast[2]) < 0.1


def test_leak_recovers_and_never_falls():
    """A Newton fit of the leak on simulated bins with profiles, and each step's likelihood."""
    rng = np.random.default_rng(4)
    n = rng.integers(1, 12, (4_000, 2)).astype(float)
    f, d = 0.04 + 0.02 * rng.random((4_000, 2)), 0.6 + 0.2 * rng.random((4_000, 2))
    state = rng.random(4_000) < 0.6
    k = rng.binomial(n.astype(int), f + np.where(state[:, None], [0.15, 0.3], [1.0, 1.0]) * d).astype(float)
    got = statistics.leak(k, n, n * f, n * d)
    assert np.allclose(got["rate_prot"], [0.15, 0.3], atol=0.03) and got["pi"] == pytest.approx(0.6, abs=0.04)
    scale, w, hi = np.array([0.9, 0.01]), np.ones(4_000), np.ones(2)
    for _ in range(5):
        before = statistics._log_likelihoods(k, n, statistics.rates(n, (n * f, n * d), scale)).sum(0)
        scale = statistics.improve(w, k, n, (n * f, n * d), scale, np.zeros(2), hi)
        assert (statistics._log_likelihoods(k, n, statistics.rates(n, (n * f, n * d), scale)).sum(0) >= before - 1e-9).all()


def test_em_rounds_equal_one_task(spark):
    rng = np.random.default_rng(5)
    state = rng.random(600) < 0.5
    rows = [("c", int(m), 0, c, float(rng.binomial(15, 0.1 if state[m] else 0.7)), 15.0) for m in range(600) for c in (1, 3)]
    bins = spark.createDataFrame(rows, "chrom string, mol long, bin long, channel long, k double, n double")
    one = {r.channel: r for r in simulate.em_fit(bins).collect()}
    many = {r.channel: r for r in simulate.em_fit(bins, one_task=10).collect()}
    assert set(one) == set(many) == {1, 3}
    for c in one:
        assert many[c].rate_prot == pytest.approx(one[c].rate_prot, abs=1e-4) and many[c].rate_acc == pytest.approx(one[c].rate_acc, abs=1e-4)
        assert many[c].pi == pytest.approx(one[c].pi, abs=1e-4) and many[c].margin == pytest.approx(one[c].margin, rel=1e-4)


def test_nu():
    rng = np.random.default_rng(3)
    p = rng.beta(12 * 0.4, 12 * 0.6, 4_000)
    k, n = rng.binomial(25, p).astype(float), np.full(4_000, 25.0)
    nu = statistics.fit_nu(k, n)
    assert 12 / 1.5 < nu < 12 * 1.5
    values, count = np.unique(k, return_counts=True)
    assert statistics.fit_nu(values, np.full(len(values), 25.0), weight=count) == pytest.approx(nu, rel=1e-6)
    assert statistics.fit_nu(np.array([1.0, 2]), np.array([5.0, 5])) == 10 and np.isnan(statistics.fit_nu(np.zeros(3), np.zeros(3)))


def slow_linkage(d, method):
    """Plain agglomeration: heights in order, and the sets that are joined."""
    groups, out = {i: [i] for i in range(len(d))}, []
    sq = d * d

    def apart(a, b):
        block = d[np.ix_(a, b)]
        if method == "ward":
            inner = lambda g: sq[np.ix_(g, g)].sum() / (2 * len(g))
            return np.sqrt(max(0, 2 * (inner(a + b) - inner(a) - inner(b))))
        return {"single": block.min, "complete": block.max, "average": block.mean}[method]()

    while len(groups) > 1:
        i, j = min(((i, j) for i in groups for j in groups if i < j), key=lambda p: apart(groups[p[0]], groups[p[1]]))
        out.append((apart(groups[i], groups[j]), frozenset(groups[i] + groups[j])))
        groups[i] = groups[i] + groups.pop(j)
    return out


@pytest.mark.parametrize("method", ["ward", "single", "complete", "average"])
def test_linkage_by_plain_agglomeration(method):
    x = np.random.default_rng(6).standard_normal((24, 5))
    link = statistics.linkage(x, method)
    sets = {i: frozenset([i]) for i in range(24)}
    got = []
    for step, (a, b, h, size) in enumerate(link):
        sets[24 + step] = sets[int(a)] | sets[int(b)]
        got.append((h, sets[24 + step]))
        assert size == len(sets[24 + step])
    want = slow_linkage(statistics.distances(x, x), method)
    assert [s for _, s in got] == [s for _, s in want] and np.allclose([h for h, _ in got], [h for h, _ in want])
    assert sorted(statistics.leaves(link)) == list(range(24))


def test_distances_with_missing_values(spark):
    x = np.random.default_rng(7).standard_normal((9, 6))
    x[np.random.default_rng(8).random((9, 6)) < 0.3] = np.nan
    x[:, 0] = 1.0
    got = statistics.distances(x, x)
    for i in range(9):
        for j in range(9):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            assert got[i, j] == pytest.approx(np.sqrt(((x[i] - x[j])[both] ** 2).sum() * 6 / both.sum()), abs=1e-6)
    with pytest.raises(ValueError):
        statistics.distances(x, x, "cosine")
    rows = spark.createDataFrame([("c", m, [None if np.isnan(v) else float(v) for v in r]) for m, r in enumerate(x)], "chrom string, mol long, e array<double>")
    for fill in (None, "mean", 0.0):
        order = [r.mol for r in simulate.linkage_order(rows, fill=fill).orderBy("rank").collect()]
        assert order == statistics.leaves(statistics.linkage(x, fill=fill))
    with pytest.raises(ValueError):
        simulate.linkage_order(rows, most=5)


def test_downsampled_rows(spark):
    n, m = 7, 3
    rows = spark.createDataFrame([("c", i, 0, float(i)) for i in range(n)], "chrom string, mol_index long, pos long, p double")
    edges = [int(i * n / m) for i in range(m + 1)]
    got = {r.row: r.value for r in plotdata.downsample(rows, "p", m).collect()}
    assert got == {i: np.mean(range(edges[i], edges[i + 1])) for i in range(m)}
    assert {r.value for r in plotdata.downsample(rows, "p", m, "stride").collect()} == {0.0, 3.0, 6.0}
    with pytest.raises(ValueError):
        plotdata.downsample(rows, "p", m, "median")


def test_sampled_and_stepped_queries_against_exact(spark):
    """Random queries' occupancy near the exact one, on average over the molecules; every run has its frames and its seed."""
    exact = catalogue.QUERIES["exact_occupancy"](spark, SF).toPandas()
    sampled = catalogue.QUERIES["sampled_occupancy"](spark, SF).toPandas()
    both = exact.merge(sampled, on=["mol", "pos"], suffixes=("", "_s"))
    assert len(both) == len(exact) and abs((both.occ - both.occ_s).mean()) < 0.01 and np.corrcoef(both.occ, both.occ_s)[0, 1] > 0.7
    counts = catalogue.QUERIES["mcmc_summary"](spark, SF).toPandas()
    assert len(counts) == 500 * 2 * 3 and set(counts.time) == {0, 10, 20}
    means = catalogue.QUERIES["mcmc_mean_count"](spark, SF).toPandas()
    last = counts[counts.time == 20].groupby("mol").n_nuc.mean()
    assert np.allclose(means.set_index("mol").mean_n.sort_index(), last.sort_index())
    seeds = catalogue.QUERIES["seed_table"](spark, SF).toPandas()
    assert len(seeds) == 1500 and all(r.seed == physics.run_seed(7, 0, r.mol, r.run) for r in seeds.itertuples())


def test_fit_queries_against_direct_fits(spark):
    """The fits of a chromosome from its collected bins and sites."""
    bins = catalogue.QUERIES["window_counts"](spark, SF).toPandas()
    for name in ("em_fit", "channel_tests", "leak_fit"):
        got = catalogue.QUERIES[name](spark, SF).toPandas()
        for chrom, own in bins.groupby("chrom"):
            k, n, sf, sd = (own.pivot_table(index=["mol", "bin"], columns="channel", values=v, fill_value=0).sort_index(axis=1).to_numpy(float) for v in ("k", "n", "sf", "sd"))
            mine = got[got.chrom == chrom].sort_values("channel")
            if name == "leak_fit":
                assert np.allclose(mine.leak, statistics.leak(k, n, sf, sd)["rate_prot"], atol=1e-3)
            else:
                fit = statistics.em(k, n)
                want = fit["rate_acc"] if name == "em_fit" else statistics.channel_tests(k, n, None, fit["rate_prot"], fit["rate_acc"], fit["pi"])[0]
                assert np.allclose(mine.rate_acc if name == "em_fit" else mine.margin, want, atol=1e-2)
    sites = catalogue.QUERIES["control_counts"](spark, SF).toPandas()
    for r in catalogue.QUERIES["nu_fit"](spark, SF).collect():
        own = sites[(sites.chrom == r.chrom) & (sites.source == r.source) & (sites.channel == r.channel)]
        assert r.nu == pytest.approx(statistics.fit_nu(own.k.to_numpy(float), own.n.to_numpy(float)), rel=5e-2)  # the evidence is flat up there


def test_llink_evidence_has_every_default_candidate(spark):
    got = catalogue.QUERIES["llink_evidence"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.llink for r in got) == list(range(0, 65, 5))
