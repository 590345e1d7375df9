"""The functions a user calls, over an experiment (fibrion.sources.experiment) or a dataset of runs (fibrion.sources.dataset).
Derived tables are stored in its folder."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import statistics
from .functions.physics import Settings
from .operators import simulate
from .plans import plotdata, relations
from .sources.dataset import Dataset
from .sources.experiment import SOURCES, Experiment, load_raw

__all__ = ["Experiment", "Dataset", "load_raw", "summarize_dropout", "dropout_ecdf", "dropout_fractions", "filter_dropout", "smooth", "compute_empirical_prob", "compute_model_prob", "energies", "estimate_start_temp", "estimate_llink", "best_llink", "median_mu", "run", "rerun", "analyze", "simulate_runs", "sort_by_linkage", "downsample", "to_dense"]
CHANNEL_NAMES = {"A": 1, "GCH": 2, "HCG": 3, "GCG": 4}  # fixed values: channels by name


def summarize_dropout(exp: Experiment) -> DataFrame:
    return exp.relation("dropout_summary", lnuc=1)


def dropout_ecdf(exp: Experiment) -> DataFrame:
    return exp.relation("dropout_ecdf", lnuc=1)


def dropout_fractions(exp: Experiment) -> DataFrame:
    """source, chrom, mol, label, frac."""
    return exp.relation("dropout_fractions", lnuc=1)


def filter_dropout(exp: Experiment, low: float = 0.0, high: float = 1.0, mode: str = "separate", mask_name: str = "keep_mask") -> DataFrame:
    """Stores a mask: molecules whose dropout (of every label, or of all sites together) lies in [low, high]."""
    if mode not in ("separate", "aggregate") or not 0 <= low <= high <= 1:
        raise ValueError("mode is separate or aggregate, and 0 <= low <= high <= 1")
    return exp.put(mask_name, exp.relation(f"dropout_mask_{mode}", lnuc=1, low=low, high=high), overwrite=True)


def to_dense(exp: Experiment, source: str = "test", mols: list[int] | None = None) -> DataFrame:
    """chrom, k, mol_index, e: the scores by position of each molecule as an array with nulls; of given molecules, in their
    order (some may repeat)."""
    rows = exp.relation("dense_all", lnuc=1, mask=None).where(F.col("source") == source)
    rows = rows.groupBy("chrom", "mol_index").agg(F.sort_array(F.collect_list(F.struct("pos", "q"))).alias("x")).select("chrom", "mol_index", F.col("x.q").alias("e"))
    if mols is None:
        return rows.select("chrom", F.col("mol_index").alias("k"), "mol_index", "e")
    order = exp.spark.createDataFrame(list(enumerate(mols)), "k long, mol_index long")
    return rows.join(F.broadcast(order), "mol_index").select("chrom", "k", "mol_index", "e")


_FILLED = {
    "none": "s",
    "mean": "CASE WHEN pos <= nbp - {0} THEN coalesce(s, avg(s) OVER (PARTITION BY source, chrom, mol_index)) END",
    "interpolate": "coalesce(s, s0 + (s1 - s0) * (pos - p0) / CAST(p1 - p0 AS DOUBLE))",
}
_AROUND = """SELECT *, last_value(s) IGNORE NULLS OVER b AS s0, last_value(CASE WHEN s IS NOT NULL THEN pos END) IGNORE NULLS OVER b AS p0,
first_value(s) IGNORE NULLS OVER a AS s1, first_value(CASE WHEN s IS NOT NULL THEN pos END) IGNORE NULLS OVER a AS p1 FROM smoothed_all
WINDOW b AS (PARTITION BY source, chrom, mol_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY source, chrom, mol_index ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def smooth(exp: Experiment, lnuc: int = 147, nan_method: str = "mean", name: str = "smoothed", fill_edge: float | None = None, mask_name: str | None = "keep_mask") -> DataFrame:
    """Stores the rolling means of all sources (source, chrom, mol_index, mol, strand, nbp, pos, s). Gaps inside: none, mean
    of the molecule, or interpolate between neighbours; the last lnuc - 1 places get fill_edge."""
    if nan_method not in _FILLED:
        raise ValueError("nan_method is none, mean or interpolate")
    edge = "s" if fill_edge is None else f"CASE WHEN pos > nbp - {lnuc} THEN CAST({float(fill_edge)} AS DOUBLE) ELSE s END"
    text = f"SELECT source, chrom, mol_index, mol, strand, nbp, pos, {edge} AS s FROM (SELECT source, chrom, mol_index, mol, strand, nbp, pos, {_FILLED[nan_method].format(lnuc)} AS s FROM ({_AROUND if nan_method == 'interpolate' else 'SELECT * FROM smoothed_all'}) x) y"
    out = exp.put(name, exp.relation("smoothed_filled", lnuc=lnuc, mask=mask_name, smoothed_filled=text), overwrite=True)
    exp.note(name, {"lnuc": lnuc, "nan_method": nan_method})
    return out


def _edged(prob: DataFrame, keys: list[str], lnuc: int, fill_edge: float | None) -> DataFrame:
    """(keys, nbp, pos, p) with fill_edge at the last lnuc - 1 places of molecules that have any value."""
    if fill_edge is None:
        return prob.drop("nbp")
    some = F.count("p").over(Window.partitionBy(*keys)) > 0
    return prob.withColumn("p", F.when((F.col("pos") > F.col("nbp") - lnuc) & some, F.lit(float(fill_edge))).otherwise(F.col("p"))).drop("nbp")


def _no_strandless(exp: Experiment) -> None:
    bad = exp.table("molecules").where("strand not in ('+', '-')").first()
    if bad:
        raise ValueError(f"norm_by_strand needs molecules with a strand; {bad['mol_id']} of {bad['source']} has none")


def compute_empirical_prob(exp: Experiment, lnuc: int | None = None, norm_by_strand: bool = False, prob_name: str = "meth_prob", smoothed_name: str = "smoothed", resmooth: bool = False, clip_low: float = 0.1, clip_high: float = 99.9, fill_edge: float | None = None, mask_name: str | None = "keep_mask") -> DataFrame:
    """Stores (chrom, mol_index, pos, p). Stored rolling means are used again; others than without gap filling, or of another
    width, raise ValueError unless `resmooth`. Controls count only if there are both."""
    if norm_by_strand:
        if not exp.controls():
            raise ValueError("norm_by_strand needs both controls")
        _no_strandless(exp)
    if not 0 <= clip_low < clip_high <= 100:
        raise ValueError("0 <= clip_low < clip_high <= 100")
    had = exp.params(smoothed_name) if exp.has(smoothed_name) else None
    if had and not resmooth and (had["nan_method"] != "none" or lnuc not in (None, had["lnuc"])):
        raise ValueError(f"{smoothed_name} was made with {had}: pass resmooth to make it anew")
    if not had or resmooth:
        lnuc = lnuc or 147
        smooth(exp, lnuc, "none", smoothed_name, mask_name=mask_name)
    else:
        lnuc = had["lnuc"]
    out = exp.relation("empirical_prob" + ("_strand" if norm_by_strand else ""), lnuc=lnuc, clip=(clip_low / 100, clip_high / 100), mask=mask_name, tables={"exp_smoothed": exp.table(smoothed_name)}, smoothed_all="SELECT * FROM exp_smoothed")
    out = out.join(exp.table("sizes").select("chrom", "nbp"), "chrom").select("chrom", "mol_index", "nbp", "pos", "p")
    return exp.put(prob_name, _edged(out, ["chrom", "mol_index"], lnuc, fill_edge), overwrite=True)


_BINS = "SELECT r.chrom, r.mol, FLOORDIV(r.pos, {0}) AS bin, r.channel, sum(r.q) AS k, CAST(count(*) AS DOUBLE) AS n FROM read_sites r JOIN sizes z ON r.chrom = z.chrom WHERE r.source = 'test' AND r.pos < FLOORDIV(z.nbp, {0}) * {0} GROUP BY r.chrom, r.mol, FLOORDIV(r.pos, {0}), r.channel"
_FITTED = "SELECT s.chrom, s.pos, s.channel, f.informative, f.theta_prot, f.theta_acc FROM site_channels s JOIN fitted f ON s.chrom = f.chrom AND s.channel = f.channel"
_LEAKED = f"SELECT p.chrom, p.pos, p.channel, p.informative AND f.informative AS informative, greatest({relations.EPS}, least(1 - {relations.EPS}, p.f + f.leak * (p.a - p.f))) AS theta_prot, p.a AS theta_acc FROM profiles p JOIN fitted f ON p.chrom = f.chrom AND p.channel = f.channel"


def resolve_eta(eta: float | dict[str, float] | None) -> dict[int, float]:
    """Channels whose eta is given: none, all by a number, or some by name (unknown names raise ValueError)."""
    if eta is None:
        return {}
    if isinstance(eta, dict):
        if set(eta) - set(CHANNEL_NAMES):
            raise ValueError(f"unknown channels {sorted(set(eta) - set(CHANNEL_NAMES))}; known are {list(CHANNEL_NAMES)}")
        return {CHANNEL_NAMES[k]: float(v) for k, v in eta.items()}
    return dict.fromkeys(CHANNEL_NAMES.values(), float(eta))


def _read_rules(q_thres: float | None, span: str) -> dict[str, str]:
    """Relations for thresholded scores and for reads that count only between their first and last call."""
    text = relations.R["read_sites"]
    if span == "calls":
        text = f"""SELECT r.* FROM ({text}) r JOIN (SELECT source, chrom, mol, min(pos) AS lo, max(pos) AS hi FROM ({text}) y WHERE called GROUP BY source, chrom, mol) b
ON r.source = b.source AND r.chrom = b.chrom AND r.mol = b.mol WHERE r.pos BETWEEN b.lo AND b.hi"""
    if q_thres is not None:
        text = f"SELECT source, chrom, mol, strand, pos, channel, called, CASE WHEN q >= {float(q_thres)} THEN 1.0 ELSE 0.0 END AS q FROM ({text}) z"
    return {} if text == relations.R["read_sites"] else {"read_sites": text}


def compute_model_prob(
    exp: Experiment, lnuc: int = 147, lbin: int = 30, rho_leak: float | None = None, min_rel_contrast: float = 0.2, nu: float | None = None, eta: float | dict[str, float] | None = None, eta_max_lag: int = relations.LAGS,
    q_thres: float | None = None, span: str = "full", norm_by_strand: bool = False, fill_edge: float | None = None, prob_name: str = "meth_prob", mask_name: str | None = "keep_mask", store_rho: bool = False,
) -> DataFrame:
    """Stores (chrom, mol_index, pos, p), and beside it <prob_name>_calib, _theta and _eta (and _rho).

    With both controls, site rates come from them (prior strength `nu`, or fitted by channel) and the leak into protected sites is
    `rho_leak`, or fitted by channel on the test sample; otherwise a two-state mixture over bins of `lbin` places gives two
    rates a channel. A fitted channel counts if two states beat one and its contrast reaches `min_rel_contrast`. Correlated
    sites are weighed down by channel (`eta`, or from the autocorrelation of the log odds at lags up to `eta_max_lag`). Dropped
    molecules, those that read no site, and the last lnuc - 1 places (or fill_edge) are null. norm_by_strand calibrates
    each strand by itself."""
    if span not in ("full", "calls") or lbin < 1 or (nu is not None and nu < 0) or not 0 <= min_rel_contrast <= 1 or (q_thres is not None and not 0 < q_thres <= 1) or not 1 <= eta_max_lag <= relations.LAGS:
        raise ValueError(f"span is full or calls; lbin >= 1; nu >= 0; min_rel_contrast in [0, 1]; q_thres in (0, 1]; eta_max_lag in 1 to {relations.LAGS}")
    if norm_by_strand:
        _no_strandless(exp)
    given, rules, spark = resolve_eta(eta), _read_rules(q_thres, span), exp.spark
    strands = ["+", "-"] if norm_by_strand else [None]
    known = {"lnuc": lnuc, "lbin": lbin, "mask": mask_name}
    calib, thetas = [], {}
    for s in strands:
        fit, theta = _calibrate(exp, s, known, rules, lbin, nu, rho_leak, min_rel_contrast)
        name = f"{prob_name}_theta" + {None: "", "+": "_pos", "-": "_neg"}[s]
        thetas[s] = exp.put(name, theta, overwrite=True)
        if fit is not None:
            calib.append(fit.withColumn("strand", F.lit(s).cast("string")))
    if calib:
        _warn_boundaries(exp.put(f"{prob_name}_calib", reduce(DataFrame.unionByName, calib), overwrite=True))
    own = lambda s: {"tables": {"exp_theta": thetas[s]}, "strand": s, "thetas": "SELECT * FROM exp_theta"} | known | rules
    channels = sorted({c for v in exp.meta["mtase"] or list(CHANNEL_OF) for c in CHANNEL_OF[v]})
    weights = dict(given)
    if set(channels) - set(given):
        pairs = reduce(DataFrame.unionByName, [exp.relation("autocorr_stats", **own(s)) for s in strands]).groupBy("channel", "lag_").agg(*(F.sum(c).alias(c) for c in ("npair", "sxy", "sx", "sy"))).where(F.col("lag_") <= eta_max_lag).collect()
        sums = reduce(DataFrame.unionByName, [exp.relation("lam_totals", **own(s)) for s in strands]).groupBy("channel").agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2"))).collect()  # channels x lags
        for r in sums:
            mine = {p["lag_"]: (p["npair"], p["sxy"], p["sx"], p["sy"]) for p in pairs if p["channel"] == r["channel"]}
            weights.setdefault(r["channel"], statistics.eta(r["n"], r["s1"], r["s2"], mine, eta_max_lag))
        if store_rho:
            at = {r["channel"]: (r["n"], r["s1"] / r["n"], r["s2"] - r["s1"] ** 2 / r["n"]) for r in sums}
            rho = [(p["channel"], p["lag_"], (p["sxy"] - m * (p["sx"] + p["sy"]) + p["npair"] * m * m) / spread) for p in pairs for n, m, spread in [at[p["channel"]]] if spread > 0]
            exp.put(f"{prob_name}_rho", spark.createDataFrame(rho, "channel long, lag long, rho double"), overwrite=True)
    etas = exp.put(f"{prob_name}_eta", spark.createDataFrame([(c, float(weights.get(c, 1.0))) for c in channels], "channel long, eta double"), overwrite=True)
    _warn_call_fractions(exp, known, rules)
    parts = [exp.relation("windows_eta", **(own(s) | {"tables": {"exp_theta": thetas[s], "exp_eta": etas}, "etas": "SELECT channel, eta FROM exp_eta"})) for s in strands]
    prob = reduce(DataFrame.unionByName, parts)
    mols = exp.table("molecules").where("source = 'test'").select("chrom", "mol", "mol_index")
    prob = prob.join(mols, ["chrom", "mol"]).join(F.broadcast(exp.table("sizes").select("chrom", "nbp")), "chrom").select("chrom", "mol_index", "nbp", "pos", F.expr("1 / (1 + exp(w))").alias("p"))
    out = exp.put(prob_name, _edged(prob, ["chrom", "mol_index"], lnuc, fill_edge), overwrite=True)
    exp.note(prob_name, {"lnuc": lnuc, "lbin": lbin, "rho_leak": rho_leak, "nu": nu, "min_rel_contrast": min_rel_contrast, "eta_max_lag": eta_max_lag, "q_thres": q_thres, "span": span, "norm_by_strand": norm_by_strand, "fill_edge": fill_edge, "mask_name": mask_name})
    return out


CHANNEL_OF = {"A": (1,), "CG": (3, 4), "GC": (2, 4)}  # fixed values: channels that an enzyme reads


def _calibrate(exp, strand, known, rules, lbin, nu, rho_leak, min_rel_contrast) -> tuple[DataFrame | None, DataFrame]:
    """(fit by chromosome and channel, or None where none is needed; rates by site) of the molecules of a strand."""
    call = lambda name, tables=None, **more: exp.relation(name, strand=strand, tables=tables, **known, **(rules | more))
    passes = (F.col("margin") > 0) & (F.col("contrast") >= min_rel_contrast)
    if not exp.controls():
        fit = simulate.em_fit(call("window_counts", window_counts=_BINS.format(lbin)))
        fit = exp.put("_fit", fit.withColumn("informative", F.coalesce(passes, F.lit(False))), overwrite=True)
        fitted = fit.select("chrom", "channel", F.col("rate_prot").alias("theta_prot"), F.col("rate_acc").alias("theta_acc"), "informative")
        return fit, call("thetas", {"fitted": fitted}, thetas=_FITTED)
    if nu is None:
        nus = exp.put("_nus", simulate.nu_fit(call("control_counts")).fillna(10.0, ["nu"]), overwrite=True)
        prior, tables = {"nus": "SELECT chrom, source, channel, nu FROM exp_nus"}, {"exp_nus": nus}
    else:
        prior, tables = {"nus": f"SELECT chrom, source, channel, CAST({float(nu)} AS DOUBLE) AS nu FROM control_counts GROUP BY chrom, source, channel"}, {}
    if rho_leak is not None:
        return None, call("thetas", tables, **prior, thetas=relations.build(leak=float(rho_leak))["thetas"])
    fit = simulate.leak_fit(call("window_counts", tables, **prior))
    fit = exp.put("_fit", fit.withColumn("informative", F.coalesce(passes, F.lit(False))), overwrite=True)
    return fit, call("thetas", tables | {"fitted": fit.select("chrom", "channel", "leak", "informative")}, **prior, thetas=_LEAKED)


def _warn_boundaries(calib: DataFrame) -> None:
    """Warns of leaks at their bound and of a share of protected bins near 0 or 1 (a row a chromosome and channel)."""
    low, high = statistics.PI_RANGE
    odd = (F.col("pi") < low) | (F.col("pi") > high)
    if "leak" in calib.columns:
        for r in calib.where(F.col("leak") >= F.col("bound") - 1e-6).limit(20).collect():
            warnings.warn(f"{r['chrom']}: the leak of channel {r['channel']} reached its bound, so its states can't be told apart; give rho_leak", stacklevel=3)
    for r in calib.where(odd).limit(20).collect():
        warnings.warn(f"{r['chrom']}: the share of protected bins is {r['pi']:.3f}", stacklevel=3)


def _warn_call_fractions(exp: Experiment, known: dict, rules: dict, gap: float = 0.05, explicit: float = 0.5) -> None:
    """Warns of channels whose share of sites with a call lies outside the controls' by more than `gap`, where both controls' is
    at least `explicit`."""
    if not exp.controls():
        return
    found: dict[int, dict[str, float]] = {}
    for r in exp.relation("call_fractions", **known, **rules).collect():  # sources x channels
        found.setdefault(r["channel"], {})[r["source"]] = r["frac"]
    for channel, f in found.items():
        if len(f) == 3 and (low := min(f["meth"], f["unmeth"])) >= explicit and not low - gap <= f["test"] <= max(f["meth"], f["unmeth"]) + gap:
            warnings.warn(f"channel {channel}: {f['test']:.2f} of the test sample's sites have a call, outside of the controls' {low:.2f} to {max(f['meth'], f['unmeth']):.2f}", stacklevel=3)


def energies(exp: Experiment, emax: float = float("inf"), prob_name: str = "meth_prob") -> DataFrame:
    """chrom, mol, e: log odds of methylation by position, as an array with nulls where there is no probability."""
    if not emax >= 0:
        raise ValueError("emax is a number of 0 or more")
    odds = F.least(F.greatest(F.expr("ln(greatest(p, 1e-12) / greatest(1 - p, 1e-12))"), F.lit(-emax)), F.lit(emax))
    rows = exp.table(prob_name).groupBy("chrom", F.col("mol_index").alias("mol")).agg(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("p").isNotNull(), odds).alias("e")))).alias("x"))
    return rows.select("chrom", "mol", F.col("x.e").alias("e"))


def estimate_start_temp(exp: Experiment, percentile: float = 0.9, prob_name: str = "meth_prob") -> float:
    e = energies(exp, prob_name=prob_name).select(F.explode("e").alias("e")).where("e is not null")
    return e.agg(F.expr(f"approx_percentile(abs(e), {percentile}, 10000)")).first()[0]


def median_mu(exp: Experiment, emax: float = float("inf"), prob_name: str = "meth_prob") -> float:
    """The mean over chromosomes of the median energy (to a rank of one in 10,000)."""
    e = energies(exp, emax, prob_name).select("chrom", F.explode("e").alias("e")).where("e is not null")
    return e.groupBy("chrom").agg(F.expr("approx_percentile(e, 0.5, 10000)").alias("m")).agg(F.avg("m")).first()[0]


def estimate_llink(exp: Experiment, settings: Settings, llinks: list[int] | None = None, prob_name: str = "meth_prob", max_nmol: int | None = None) -> DataFrame:
    """chrom, llink, evidence, mols. max_nmol: molecules of a chromosome that count at most (those of the least hashes)."""
    if settings.temp != 1:
        warnings.warn("evidence is a probability at temperature 1 alone", stacklevel=2)
    rows = energies(exp, settings.emax, prob_name).where(F.exists("e", lambda x: x.isNotNull()))
    if max_nmol is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("chrom").orderBy(F.xxhash64("mol"), "mol"))).where(F.col("_k") <= max_nmol).drop("_k")
    parts = []
    for c in exp.chroms:
        s = settings.of(c)
        parts.append(simulate.llink_evidence(rows.where(F.col("chrom") == c), s, llinks or list(range(0, 65, 5))).select(F.lit(c).alias("chrom"), "llink", "evidence", "mols"))
    return reduce(DataFrame.unionByName, parts)


def best_llink(evidence: DataFrame, least: int = 50) -> dict[str, int]:
    """The linker range of most evidence for each chromosome (the smallest of equals); warns if it is the largest tried, or if
    fewer than `least` molecules count."""
    out = {}
    rows = evidence.groupBy("chrom").agg(F.max(F.struct("evidence", (-F.col("llink")).alias("minus"))).alias("top"), F.max("llink").alias("largest"), F.max("mols").alias("mols")).collect()
    for r in rows:  # a row a chromosome
        out[r["chrom"]] = -r["top"]["minus"]
        if out[r["chrom"]] == r["largest"]:
            warnings.warn(f"{r['chrom']}: the largest linker range tried has most evidence", stacklevel=2)
        if r["mols"] < least:
            warnings.warn(f"{r['chrom']}: {r['mols']} molecules are few", stacklevel=2)
    return out


def _keyed(exp: Experiment, settings: Settings, prob_name: str = "meth_prob") -> DataFrame:
    """Energies with one molecule number over all chromosomes (chromosome's place, then its molecule)."""
    place = F.array_position(F.array(*map(F.lit, exp.chroms)), F.col("chrom")) - 1
    return energies(exp, settings.emax, prob_name).withColumn("mol", place * F.lit(1 << 40) + F.col("mol"))


def _named(exp: Experiment, rows: DataFrame) -> DataFrame:
    chrom = F.expr(f"element_at(array({', '.join(repr(c) for c in exp.chroms)}), cast((mol div {1 << 40}) + 1 as int))")
    return rows.select(chrom.alias("chrom"), (F.col("mol") % (1 << 40)).alias("mol_index"), *[c for c in rows.columns if c != "mol"])


def _each_llink(exp: Experiment, settings: Settings, rows: DataFrame, kernel) -> DataFrame:
    """`kernel(rows, settings)` for the chromosomes of each linker range, put together."""
    by: dict[Settings, list[str]] = {}
    for c in exp.chroms:
        by.setdefault(settings.of(c), []).append(c)
    if len(by) == 1:
        return kernel(rows, next(iter(by)))
    return reduce(DataFrame.unionByName, [kernel(rows.where(F.col("chrom").isin(chroms)), s) for s, chroms in by.items()])


def run(exp: Experiment, settings: Settings, method: str = "tm", nsim: int = 1, seed: int = 0, nsweep: int = 1000, start_temp: float = 1.0, name: str = "results", freq: int = 1, cooling: str = "linear", prob_name: str = "meth_prob", use_median_mu: bool = False) -> DataFrame:
    """Stores the sampled configurations (tm: exact samples; mcmc: Metropolis frames) as table `name`."""
    if method not in ("tm", "mcmc") or nsim < 1:
        raise ValueError("method is tm or mcmc, and nsim at least 1")
    if use_median_mu:
        settings = replace(settings, mu=median_mu(exp, settings.emax, prob_name))
    kernel = (lambda e, s: simulate.samples(e, s, nsim, seed)) if method == "tm" else (lambda e, s: simulate.trajectories(e, s, nsim, seed, nsweep, start_temp, freq, cooling))
    return exp.put(name, _named(exp, _each_llink(exp, settings, _keyed(exp, settings, prob_name), kernel)), overwrite=True)


def rerun(exp: Experiment, settings: Settings, nsim: int, seed: int = 0, name: str = "results", prob_name: str = "meth_prob") -> DataFrame:
    """Fills in the exact samples that table `name` lacks: a run's seed hangs on its molecule and number alone, so the result
    equals that of a whole run."""
    e = _keyed(exp, settings, prob_name)
    whole = _named(exp, e.select("mol", F.explode(F.sequence(F.lit(0), F.lit(nsim - 1))).alias("run")))
    have = exp.table(name)
    lacking = whole.join(have.select("chrom", "mol_index", "run"), ["chrom", "mol_index", "run"], "left_anti")
    place = F.array_position(F.array(*map(F.lit, exp.chroms)), F.col("chrom")) - 1
    runs = lacking.select((place * F.lit(1 << 40) + F.col("mol_index")).alias("mol"), "run").join(e, "mol")
    return exp.put(name, have.unionByName(_named(exp, _each_llink(exp, settings, runs, lambda r, s: simulate.sampled_runs(r, s, seed)))), overwrite=True)


def analyze(exp: Experiment, settings: Settings, name: str = "analysis", prob_name: str = "meth_prob") -> DataFrame:
    """Stores exact occupancy and its variance, mean and variance of the number of nucleosomes, and log Z of every molecule."""
    return exp.put(name, _named(exp, _each_llink(exp, settings, _keyed(exp, settings, prob_name), simulate.exact)), overwrite=True)


def simulate_runs(exp: Experiment, path: str, settings: Settings, method: str = "mcmc", nsim: int = 1, seed: int = 0, nsweep: int = 1000, start_temp: float = 1.0, freq: int = 1, cooling: str = "linear", prob_name: str = "meth_prob", mols: list[int] | None = None, use_median_mu: bool = False) -> Dataset:
    """A new dataset of runs at `path` (which must not exist), of all molecules or of `mols`; seeds are those of a run of all."""
    if use_median_mu:
        settings = replace(settings, mu=median_mu(exp, settings.emax, prob_name))
    data = Dataset.create(exp.spark, path, energies(exp, settings.emax, prob_name), exp.chroms, settings, method, nsim, seed, nsweep, start_temp, freq, cooling)
    data.run(mols)
    return data


def downsample(store: Experiment | Dataset, name: str, max_rows: int, how: str = "mean", value: str | None = None) -> DataFrame:
    """chrom, row, pos, value of a stored table: one with a value a position, or with an array a molecule."""
    rows = store.table(name)
    if "pos" in rows.columns:
        return plotdata.downsample(rows, value or next(c for c in ("p", "s", "value") if c in rows.columns), max_rows, how)
    value = value or "occupancy"
    return plotdata.downsample(rows.select("chrom", "mol_index", F.posexplode(value).alias("pos", "value")), "value", max_rows, how)


def _matrix(store: Experiment | Dataset, name: str) -> DataFrame:
    """chrom, mol, e of a stored table, or of the raw test calls if an experiment has no such table."""
    if isinstance(store, Experiment) and not store.has(name):
        return to_dense(store).select("chrom", F.col("mol_index").alias("mol"), "e")
    rows = store.table(name)
    if "pos" not in rows.columns:
        value = next(c for c in ("occupancy", "e") if c in rows.columns)
        return rows.select("chrom", F.col("mol_index" if "mol_index" in rows.columns else "mol").alias("mol"), F.col(value).alias("e"))
    if "source" in rows.columns:
        rows = rows.where("source = 'test'")
    value = next(c for c in ("p", "s", "value") if c in rows.columns)
    x = rows.groupBy("chrom", F.col("mol_index").alias("mol")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))).alias("x"))
    return x.select("chrom", "mol", F.col("x.v").alias("e"))


def sort_by_linkage(exp: Experiment | None = None, dataset: Dataset | None = None, data_name: str | None = None, raw_which: str | None = None, mask_name: str | None = None, metric: str = "euclidean", method: str = "ward", fill_nan: str | float | None = None, sorted_name: str | None = None) -> DataFrame:
    """Stores the molecules in the leaf order of a hierarchical clustering (chrom, rank, mol, e) as <data_name>_sorted: of a
    table of an experiment (rolling means by default), of its raw calls of a source, or of a dataset's occupancy. Places that
    no molecule has are left out of the distances."""
    if (exp is None) == (dataset is None):
        raise ValueError("give an experiment or a dataset")
    if mask_name is not None and raw_which is None:
        raise ValueError("mask_name goes with raw_which")
    store = exp or dataset
    if raw_which is not None:
        if exp is None or raw_which not in SOURCES:
            raise ValueError(f"raw_which is one of {SOURCES}, of an experiment")
        rows, label = to_dense(exp, raw_which).select("chrom", F.col("mol_index").alias("mol"), "e"), raw_which
        if mask_name is not None:
            kept = exp.table(mask_name).where(F.col("keep") & (F.col("source") == raw_which)).select("chrom", "mol")
            rows = rows.join(kept, ["chrom", "mol"], "left_semi")
    else:
        label = data_name or ("smoothed" if exp else "analysis")
        rows = _matrix(store, label)
    used = rows.select("chrom", F.posexplode("e").alias("pos", "v")).groupBy("chrom").agg(F.max(F.when(F.col("v").isNotNull(), F.col("pos"))).alias("last"), F.min(F.when(F.col("v").isNotNull(), F.col("pos"))).alias("first"))
    rows = rows.join(used, "chrom").where("last is not null").select("chrom", "mol", F.slice("e", F.col("first") + 1, F.col("last") - F.col("first") + 1).alias("x"), "e")
    order = simulate.linkage_order(rows.select("chrom", "mol", F.col("x").alias("e")), "chrom", metric, method, fill_nan)
    return store.put(sorted_name or f"{label}_sorted", order.join(rows.select("chrom", "mol", "e"), ["chrom", "mol"]).select("chrom", "rank", "mol", "e"), overwrite=True)
