"""Command line: python -m fibrion.cli COMMAND EXPERIMENT [options]. Tables go to --out as Parquet, or are shown."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from . import api
from .functions.physics import Settings
from .plans import plotdata


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _eta(text: str) -> float | dict[str, float]:
    """A number, or a JSON object of numbers by channel name."""
    return json.loads(text)


def _fill(text: str) -> str | float:
    return text if text == "mean" else float(text)


def _settings(a: argparse.Namespace) -> Settings:
    return Settings(**{f.name: getattr(a, f.name) for f in fields(Settings)})


def _load(spark: SparkSession, a: argparse.Namespace) -> None:
    columns = [int(x) for x in a.colidx] if a.colidx else None
    api.load_raw(spark, a.experiment, a.chromsize, a.test_file, unmeth_file=a.unmeth_file, meth_file=a.meth_file, fasta_file=a.fasta_file, mtase=a.mtase, chroms=a.chroms, wrap=a.wrap, colidx=columns, max_nmol=a.max_nmol, ignore_strand=a.ignore_strand)


#: Command: (help, options by name, whether it takes the model's settings, what it does with experiment and options).
COMMANDS = {
    "load_raw": ("call files into a new experiment", {"chromsize": str, "test_file": str, "unmeth_file": str, "meth_file": str, "fasta_file": str, "mtase": _names, "colidx": _names, "max_nmol": int, "wrap": bool, "ignore_strand": bool}, False, None),
    "summarize_dropout": ("dropout of each label", {}, False, lambda e, a: api.summarize_dropout(e)),
    "plot_dropout_ecdf": ("cumulative dropout", {}, False, lambda e, a: api.dropout_ecdf(e)),
    "filter_dropout": ("store the mask of molecules kept", {"low": 0.0, "high": 1.0, "mode": "separate"}, False, lambda e, a: api.filter_dropout(e, a.low, a.high, a.mode)),
    "smooth": ("store rolling means", {"lnuc": 147, "nan_method": "mean", "name": "smoothed", "fill_edge": float}, False, lambda e, a: api.smooth(e, a.lnuc, a.nan_method, a.name, a.fill_edge)),
    "compute_empirical_prob": ("store empirical probabilities", {"lnuc": int, "norm_by_strand": bool, "resmooth": bool, "clip_low": 0.1, "clip_high": 99.9, "fill_edge": float, "prob_name": "meth_prob"}, False, lambda e, a: api.compute_empirical_prob(e, a.lnuc, a.norm_by_strand, a.prob_name, resmooth=a.resmooth, clip_low=a.clip_low, clip_high=a.clip_high, fill_edge=a.fill_edge)),
    "compute_model_prob": ("store model probabilities", {"lnuc": 147, "lbin": 30, "rho_leak": float, "min_rel_contrast": 0.2, "nu": float, "eta": _eta, "eta_max_lag": 10, "q_thres": float, "span": "full", "norm_by_strand": bool, "fill_edge": float, "prob_name": "meth_prob"}, False, lambda e, a: api.compute_model_prob(e, a.lnuc, a.lbin, a.rho_leak, a.min_rel_contrast, a.nu, a.eta, a.eta_max_lag, a.q_thres, a.span, a.norm_by_strand, a.fill_edge, a.prob_name)),
    "estimate_start_temp": ("percentile of absolute log odds", {"percentile": 0.9}, False, lambda e, a: e.spark.createDataFrame([(api.estimate_start_temp(e, a.percentile),)], "start_temp double")),
    "estimate_llink": ("evidence of linker ranges", {"llinks": _names}, True, lambda e, a: api.estimate_llink(e, _settings(a), [int(x) for x in a.llinks] if a.llinks else None)),
    "run": ("store sampled configurations", {"method": "tm", "nsim": 1, "seed": 0, "nsweep": 1000, "start_temp": 1.0, "name": "results"}, True, lambda e, a: api.run(e, _settings(a), a.method, a.nsim, a.seed, a.nsweep, a.start_temp, a.name)),
    "rerun": ("fill in exact samples that are lacking", {"nsim": 1, "seed": 0, "name": "results"}, True, lambda e, a: api.rerun(e, _settings(a), a.nsim, a.seed, a.name)),
    "analyze": ("store exact occupancy", {"name": "analysis"}, True, lambda e, a: api.analyze(e, _settings(a), a.name)),
    "sort_by_linkage": ("store molecules in the leaf order of a clustering", {"data_name": str, "raw_which": str, "mask_name": str, "metric": "euclidean", "method": "ward", "fill_nan": _fill, "sorted_name": str}, False, lambda e, a: api.sort_by_linkage(e, None, a.data_name, a.raw_which, a.mask_name, a.metric, a.method, a.fill_nan, a.sorted_name)),
    "downsample": ("fewer rows of a stored table", {"name": "meth_prob", "max_rows": 500, "how": "mean"}, False, lambda e, a: api.downsample(e, a.name, a.max_rows, a.how)),
    "plot_meth_prob": ("tiles of the probabilities", {"n_rows": 500, "n_columns": 1000}, False, lambda e, a: plotdata.meth_prob(e.table("meth_prob"), n_rows=a.n_rows, n_columns=a.n_columns)),
    "plot_meth_energy": ("tiles of the log odds", {"emax_shown": 10.0, "n_rows": 500, "n_columns": 1000}, False, lambda e, a: plotdata.meth_energy(e.table("meth_prob"), a.emax_shown, n_rows=a.n_rows, n_columns=a.n_columns)),
    "plot_energy": ("energies of Metropolis frames", {"name": "results", "tstart": 0, "tend": int}, False, lambda e, a: plotdata.energy_track(e.table(a.name), a.tstart, a.tend)),
    "plot_nuc_pos": ("cover of each position by frame", {"name": "results"}, True, lambda e, a: plotdata.kymograph(e.table(a.name), a.nucbp)),
    "plot_occup": ("tiles of the exact occupancy", {"name": "analysis", "n_rows": 500, "n_columns": 1000}, False, lambda e, a: plotdata.occupancy(e.table(a.name), n_rows=a.n_rows, n_columns=a.n_columns)),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fibrion", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (about, options, physical, _) in COMMANDS.items():
        p = sub.add_parser(name, help=about)
        p.add_argument("experiment")
        p.add_argument("--out", help="folder for the table")
        p.add_argument("--chroms", type=_names)
        own = dict(options) | ({f.name: f.default for f in fields(Settings)} if physical else {})
        for option, kind in own.items():
            if kind is bool:
                p.add_argument(f"--{option}", action="store_true")
            elif callable(kind):
                p.add_argument(f"--{option}", type=kind, required=option in ("chromsize", "test_file"))
            else:
                p.add_argument(f"--{option}", type=type(kind), default=kind)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fibrion").getOrCreate()
    if a.command == "load_raw":
        return _load(spark, a)
    rows = COMMANDS[a.command][3](api.Experiment(spark, a.experiment, a.chroms), a)
    if a.out:
        rows.write.parquet(a.out)
    else:
        rows.show()
    return rows


if __name__ == "__main__":
    main()
