"""File readers, experiments and the whole way from call files to occupancy on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrion import api
from fibrion.functions.physics import Settings
from fibrion.sources import files, synthetic


def text(path, body):
    path.write_text(body)
    return str(path)


HEAD = "#read_id\textra\tref_position\tchrom\tref_strand\tmod_qual\tmod_code\n"


def test_sizes(spark, tmp_path):
    f = text(tmp_path / "s", "chrom\tlength\nc1\t11\n2\t7\n")
    assert {tuple(r) for r in files.chrom_sizes(spark, f, wrap=True).collect()} == {("c1", 11, 5), ("2", 7, 3)}
    assert files.chrom_sizes(spark, text(tmp_path / "t", "c1\t11\n"), chroms=["c1"]).count() == 1
    for body, chroms in (("c1\t1\nc1\t2\n", None), ("c1\tx\n", None), ("c1\t1\n", ["no"])):
        with pytest.raises(ValueError):
            files.chrom_sizes(spark, text(tmp_path / "u", body), chroms=chroms)


def test_sequences_and_masks(spark, tmp_path):
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 20_000))
    f = text(tmp_path / "f", f">c1 note\nacg\nta\n>c2\n{seq}\n>other\nAA\n")
    sizes = files.chrom_sizes(spark, text(tmp_path / "s", "c1\t5\nc2\t20000\n"))
    ref = files.reference(spark, f, sizes)
    assert dict(ref.collect()) == {"c1": "ACGTA", "c2": seq}
    got = {(r.chrom, r.pos): (r.base, set(r.plus), set(r.minus)) for r in files.site_masks(ref).collect()}
    assert len(got) == 20_005
    for c, s in (("c1", "ACGTA"), ("c2", seq)):
        for i, b in enumerate(s):
            p, n = s[i - 1] if i else "N", s[i + 1] if i + 1 < len(s) else "N"
            plus = {k for k, v in {"A": b == "A", "CG": b + n == "CG", "GC": p + b == "GC"}.items() if v}
            minus = {k for k, v in {"A": b == "T", "CG": p + b == "CG", "GC": b + n == "GC"}.items() if v}
            assert got[c, i] == (b, plus, minus)
    with pytest.raises(ValueError):
        files.reference(spark, f, files.chrom_sizes(spark, text(tmp_path / "x", "c1\t6\n")))


def test_load(spark, tmp_path):
    sizes, fa = text(tmp_path / "s", "c1\t10\nc2\t4\n"), text(tmp_path / "f", ">c1\nACGTACGTAA\n")
    rows = [("m2", 0, "+", 0.5, "a"), ("m2", 3, "+", 0.9, "a"), ("m10", 3, "-", 0.25, "a"), ("m10", 3, "-", 0.75, "a"), ("m3", 8, "+", 1, "-"), ("m2", 9, ".", 0.1, "a"), ("m2", 40, "+", 0.1, "a")]
    f = text(tmp_path / "c", HEAD + "".join(f"{m}\t.\t{p}\tc1\t{s}\t{q}\t{k}\n" for m, p, s, q, k in rows) + "m1\t.\t1\tother\t+\t1\ta\n")
    e = api.load_raw(spark, str(tmp_path / "e"), sizes, f, fasta_file=fa, mtase=["A"])
    assert {(r.mol_id, r.mol_index) for r in e.table("molecules").collect()} == {("m10", 0), ("m2", 1), ("m3", 2)}
    assert {(r.mol, r.pos, r.q) for r in e.table("calls").collect()} == {(1, 0, 0.5), (0, 3, 0.25), (0, 3, 0.75), (1, 9, 0.1)}
    assert {(r.mol_id, r.strand) for r in e.table("molecules").collect()} == {("m10", "-"), ("m2", "+"), ("m3", "+")}  # of the first row
    assert api.summarize_dropout(e).count() > 0
    with pytest.raises(ValueError, match="repeat"):  # one place of a molecule twice
        api.smooth(e, 3, "none")
    folded = api.load_raw(spark, str(tmp_path / "w"), sizes, f, wrap=True)
    assert {(r.mol, r.pos) for r in folded.table("calls").collect()} == {(1, 0), (1, 3), (0, 3)}
    assert folded.meta["duplicate"] and folded.table("calls").count() == 5
    bare = text(tmp_path / "h", "c1\t+\t2\tmm\ta\t0.5\n")
    assert api.load_raw(spark, str(tmp_path / "b"), sizes, bare, colidx=[3, 2, 0, 1, 5, 4]).table("calls").count() == 1
    assert api.load_raw(spark, str(tmp_path / "m"), sizes, f, max_nmol=2).table("molecules").count() == 2
    with pytest.raises(FileExistsError):
        api.load_raw(spark, str(tmp_path / "e"), sizes, f)
    with pytest.raises(ValueError):
        api.load_raw(spark, str(tmp_path / "z"), sizes, f, meth_file=text(tmp_path / "n", HEAD + "m\t.\t1\tc2\t+\t1\ta\n"))
    assert not (tmp_path / "z").exists()
    copy = e.save(str(tmp_path / "copy"))
    assert copy.table("calls").count() == 4 and copy.meta == e.meta
    with pytest.raises(ValueError):
        copy.save(copy.path)
    with pytest.raises(ValueError):
        api.Experiment(spark, e.path, ["no"])


def test_settings(spark, tmp_path):
    assert files.settings(spark, text(tmp_path / "s.json", '{"nucbp": 147, "llink": {"1": 20}}')) == {"nucbp": 147, "llink": {"1": 20}}
    with pytest.raises(ValueError):
        files.settings(spark, text(tmp_path / "s.toml", ""))


def planted(spark, path, controls, nbp=1200, foot=100, mols=16, chroms=("c1",), wrap=False):
    """An experiment with planted footprints, and where they are."""
    seqs = {c: synthetic.sequence(nbp + 120 * i, 3 + i) for i, c in enumerate(chroms)}
    synthetic.write_reference(spark, seqs, str(path / "fa"), str(path / "size"))
    rows = [synthetic.molecules(spark, q, c, mols, 5, foot, 40.0) for c, q in seqs.items()]
    truth = [r for x in rows for r in x.orderBy("mol_id").collect()]
    for i, x in enumerate(rows):
        synthetic.write(x, str(path / "test" / f"p{i}"))
    extra = {}
    for kind in ("meth", "unmeth") if controls else ():
        for i, (c, q) in enumerate(seqs.items()):
            synthetic.write(synthetic.molecules(spark, q, c, mols, 5, foot, 40.0, naked=kind), str(path / kind / f"p{i}"))
        extra[f"{kind}_file"] = str(path / kind / "*")
    e = api.load_raw(spark, str(path / "e"), str(path / "size"), str(path / "test" / "*"), fasta_file=str(path / "fa"), mtase=["A"], wrap=wrap, **extra)
    return e, truth


@pytest.mark.parametrize("controls", [True, False])
def test_planted_footprints(spark, tmp_path, controls):
    nbp, foot = 1200, 100
    e, again = planted(spark, tmp_path, controls)
    keep = api.filter_dropout(e)
    assert keep.where("source = 'test' and keep").count() == 16 and api.summarize_dropout(e).count() > 0
    assert api.compute_model_prob(e, lnuc=foot).where("p is not null").count() == 16 * (nbp - foot + 1)
    s = Settings(nucbp=foot, llink=40, elink=0.0, mu=0.0, emax=20.0)
    found = {r["mol_index"]: r for r in api.analyze(e, s).collect()}
    truth, guess = np.zeros((16, nbp), bool), np.zeros((16, nbp), bool)
    for r in again:
        m = int(r["mol_id"].split("_")[1])
        for start in r["starts"]:
            truth[m, start : start + foot] = True
        guess[m] = np.array(found[m]["occupancy"]) > 0.5
    assert np.corrcoef(truth.ravel(), guess.ravel())[0, 1] > 0.75  # of two 0/1 vectors: Matthews' coefficient
    whole = api.run(e, s, nsim=2, seed=9).orderBy("mol_index", "run").collect()
    e.put("results", e.table("results").where(F.col("mol_index") % 3 > 0), overwrite=True)
    assert api.rerun(e, s, 2, 9).orderBy("mol_index", "run").collect() == whole
    assert api.estimate_start_temp(e) > 0
    if not controls:
        assert api.compute_empirical_prob(e, lnuc=foot).where("p between 0 and 1").count() > 0
        assert api.estimate_llink(e, s, [20, 40]).count() == 2


def test_chromosomes_of_several_lengths_in_one_plan(spark, tmp_path):
    """Chromosomes don't touch each other, and each ends where it ends."""
    e, _ = planted(spark, tmp_path, True, nbp=200, foot=30, mols=4, chroms=("a", "b"))
    pinned = {(r.chrom, r.mol_index, r.pos): r.p for r in api.compute_model_prob(e, lnuc=30, rho_leak=0.1, eta=1.0).collect()}
    assert all((v is None) == (p > (199 if c == "a" else 319) - 29) for (c, _, p), v in pinned.items())
    one = api.Experiment(spark, e.path, ["b"])
    alone = {(r.chrom, r.mol_index, r.pos): r.p for r in api.compute_model_prob(one, lnuc=30, rho_leak=0.1, eta=1.0, prob_name="alone").collect()}
    assert alone.keys() == {k for k in pinned if k[0] == "b"}
    assert all(alone[k] is None and pinned[k] is None or alone[k] == pytest.approx(pinned[k], abs=1e-9) for k in alone)


def test_model_options(spark, tmp_path):
    e, _ = planted(spark, tmp_path, True, nbp=300, foot=40, mols=8)
    foot = {"lnuc": 40, "lbin": 20}
    base = {(r.mol_index, r.pos): r.p for r in api.compute_model_prob(e, **foot, store_rho=True).collect()}
    calib = e.table("meth_prob_calib").collect()
    assert calib and all(0 <= r.leak <= r.bound <= 1 and r.margin > 0 and r.informative for r in calib)
    eta = {r.channel: r.eta for r in e.table("meth_prob_eta").collect()}
    assert set(eta) == {1} and eta[1] > 0 and e.table("meth_prob_rho").count() > 0
    half = {(r.mol_index, r.pos): r.p for r in api.compute_model_prob(e, **foot, rho_leak=calib[0].leak, eta={"A": eta[1] / 2}, prob_name="half").collect()}
    odds = lambda p: np.log(p / (1 - p))
    some = [k for k, p in base.items() if p is not None and 1e-6 < p < 1 - 1e-6][:200]
    assert some and np.allclose([2 * odds(half[k]) for k in some], [odds(base[k]) for k in some], atol=1e-5)
    e.put("keep_mask", spark.createDataFrame([("test", "c1", m, m > 2) for m in range(8)], "source string, chrom string, mol long, keep boolean"))
    got = api.compute_model_prob(e, **foot, rho_leak=0.1, eta=1.0, norm_by_strand=True, q_thres=0.5, span="calls", nu=5.0, fill_edge=0.25).collect()
    assert all(r.p is None for r in got if r.mol_index <= 2)
    assert all(r.p == 0.25 for r in got if r.mol_index > 2 and r.pos > 260) and sum(r.p is not None for r in got) == 5 * 300
    for bad in ({"eta": {"X": 1.0}}, {"span": "no"}, {"nu": -1}, {"q_thres": 2.0}, {"eta_max_lag": 0}):
        with pytest.raises(ValueError):
            api.compute_model_prob(e, **foot, **bad)


def test_empirical_gaps_masks_and_smoothing(spark, tmp_path):
    """A gap inside is one half, a dropped molecule null, edges null or given; kept rolling means must fit."""
    sizes = text(tmp_path / "s", "c1\t60\n")
    rows = [(f"m{m}", p, 0.1 + 0.1 * m) for m in range(4) for p in range(0, 60, 2) if not (m == 1 and 20 <= p < 40)]
    f = text(tmp_path / "c", HEAD + "".join(f"{m}\t.\t{p}\tc1\t+\t{q}\ta\n" for m, p, q in rows))
    e = api.load_raw(spark, str(tmp_path / "e"), sizes, f)
    got = {(r.mol_index, r.pos): r.p for r in api.compute_empirical_prob(e, lnuc=5).collect()}
    assert got[1, 25] == 0.5 and got[1, 50] != 0.5 and got[0, 10] == 0.0 and got[3, 10] == 1.0
    assert all((v is None) == (p > 55) for (_, p), v in got.items())
    with pytest.raises(ValueError):
        api.compute_empirical_prob(e, lnuc=7)
    assert {r.p for r in api.compute_empirical_prob(e, lnuc=7, resmooth=True, fill_edge=0.5).where("pos > 53").collect()} == {0.5}
    e.put("keep_mask", spark.createDataFrame([("test", "c1", m, m != 2) for m in range(4)], "source string, chrom string, mol long, keep boolean"))
    got = {(r.mol_index, r.pos): r.p for r in api.compute_empirical_prob(e, lnuc=5, resmooth=True).collect()}
    assert all(v is None for (m, _), v in got.items() if m == 2) and got[1, 25] == 0.5
    filled = {m: {(r.mol_index, r.pos): r.s for r in api.smooth(e, 5, m, f"sm_{m}").collect()} for m in ("none", "mean", "interpolate")}
    assert filled["none"][1, 25] is None and filled["mean"][1, 25] == pytest.approx(0.2) and filled["interpolate"][1, 25] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        api.compute_empirical_prob(e, norm_by_strand=True)


def test_wrapped_sequences(spark, tmp_path):
    """Under wrap a place stands for itself and its mirror; a palindrome keeps its contexts."""
    half = synthetic.sequence(200, 8)
    seq = half + half.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    synthetic.write_reference(spark, {"c1": seq}, str(tmp_path / "fa"), str(tmp_path / "size"))
    rows = [(f"m{m}", p) for m in range(4) for p in range(200) if half[p] == "A"]
    f = text(tmp_path / "c", HEAD + "".join(f"{m}\t.\t{p}\tc1\t+\t0.9\ta\n" for m, p in rows))
    e = api.load_raw(spark, str(tmp_path / "e"), str(tmp_path / "size"), f, fasta_file=str(tmp_path / "fa"), mtase=["A"], wrap=True)
    sites = {r.pos: (r.channel, r.assay_plus) for r in e.relation("assay_masks", lnuc=10).collect()}
    assert set(sites) == set(range(200))
    assert all((c == 1) == (half[p] in "AT") and a == (half[p] in "AT") for p, (c, a) in sites.items())


def test_dataset_of_runs(spark, tmp_path):
    e, _ = planted(spark, tmp_path, False, nbp=200, foot=40, mols=5)
    api.compute_model_prob(e, lnuc=40, lbin=20, eta=1.0)
    s = Settings(nucbp=40, llink={"c1": 20}, elink=0.1, mu=0.0, emax=8.0)
    data = api.simulate_runs(e, str(tmp_path / "d"), s, "mcmc", 2, 3, nsweep=6, start_temp=2.0, freq=2)
    assert {r.status for r in data.status().collect()} == {"complete"} and data.table("runs").count() == 5 * 2 * 4
    whole = sorted(map(tuple, data.table("runs").select("mol_index", "run", "time", "energy").collect()))
    seeds = {(r.mol_index, r.run): r.seed for r in data.seed_table().collect()}
    assert len(set(seeds.values())) == 10
    data.put("runs", data.table("runs").where("not (mol_index = 1 and run = 0) and not (mol_index = 2 and time = 6)"), overwrite=True)
    assert {(r.mol_index, r.run, r.status) for r in data.status().where("status <> 'complete'").collect()} == {(1, 0, "missing"), (2, 0, "truncated"), (2, 1, "truncated")}
    data.rerun()
    assert sorted(map(tuple, data.table("runs").select("mol_index", "run", "time", "energy").collect())) == whole
    last = data.extract(lambda c, m, b: b.groupby("run", as_index=False)["time"].max().assign(chrom=c, mol=m), "run int, time long, chrom string, mol long")
    assert {(r.chrom, r.time) for r in last.collect()} == {("c1", 6)} and last.count() == 10
    with pytest.raises(TypeError):
        data.extract(lambda c, m, b: b)
    found = data.analyze().collect()
    assert len(found) == 5 and all(len(r.occupancy) == 200 and r.runs == 2 for r in found)
    assert data.access().count() == 5 and data.at("c1", 0, 0, 6)
    tm = api.simulate_runs(e, str(tmp_path / "t"), s, "tm", 0)
    exact = tm.analyze().collect()
    assert all(r.status == "ok" and r.var_n >= 0 for r in exact)
    order = api.sort_by_linkage(dataset=tm)
    assert sorted(r.mol for r in order.collect()) == list(range(5))
    assert api.downsample(tm, "analysis", 2).select("row").distinct().count() == 2
    copy = tm.save(str(tmp_path / "copy"))
    assert copy.settings == s and copy.table("analysis").count() == 5
    for call in (lambda: api.simulate_runs(e, str(tmp_path / "t"), s, "tm"), lambda: tm.save(tm.path), lambda: api.simulate_runs(e, str(tmp_path / "x"), s, "mcmc", 0), lambda: api.simulate_runs(e, str(tmp_path / "y"), Settings(nucbp=40, llink={"other": 3}), "tm"), lambda: tm.analyze(5), lambda: api.Dataset(spark, tm.path, ["no"])):
        with pytest.raises((ValueError, FileExistsError, KeyError)):
            call()
    assert not (tmp_path / "x").exists()
    evidence = api.estimate_llink(e, s, [0, 20, 40], max_nmol=4)
    with pytest.warns(UserWarning):
        assert set(api.best_llink(evidence)) == {"c1"}
    assert {r.mols for r in evidence.collect()} == {4} and isinstance(api.median_mu(e), float)


def test_energy_and_interval_files(spark, tmp_path):
    (tmp_path / "e").mkdir()
    text(tmp_path / "e" / "m1", "# a comment\n0 1.5\n2 -9 # held\n7 1\nx y\n")
    got = files.energies(spark, str(tmp_path / "e"), 4, 5.0).collect()
    assert [(r.mol, r.e) for r in got] == [("m1", [1.5, None, -5.0, None])]
    f = text(tmp_path / "i", "#x\nm1\t1,5,\t2,3\nm2\t7\t1\n")
    assert {tuple(r) for r in files.intervals(spark, f).collect()} == {("m1", 1, 3), ("m1", 5, 8), ("m2", 7, 8)}


def test_failed_replacement_keeps_the_old_table(spark, tmp_path, monkeypatch):
    e, _ = planted(spark, tmp_path, False, nbp=200, foot=30, mols=2)
    e.put("t", spark.createDataFrame([(1,)], "a int"))
    kept = files.rename
    monkeypatch.setattr(files, "rename", lambda s, old, new: (_ for _ in ()).throw(OSError()) if "_new-" in old else kept(s, old, new))
    with pytest.raises(OSError):
        e.put("t", spark.createDataFrame([(2,)], "a int"), overwrite=True)
    assert [r.a for r in e.table("t").collect()] == [1]
