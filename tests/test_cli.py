"""The command line from files to tiles, and the plot data against sums by hand."""

import pytest

from fibrion import cli
from fibrion.plans import plotdata
from fibrion.sources import synthetic


def test_commands(spark, tmp_path):
    seq = synthetic.sequence(400, 3)
    synthetic.write_reference(spark, {"c1": seq}, str(tmp_path / "fa"), str(tmp_path / "size"))
    synthetic.write(synthetic.molecules(spark, seq, "c1", 6, 5, 50, 40.0), str(tmp_path / "test"))
    e = str(tmp_path / "e")
    cli.main(["load_raw", e, "--chromsize", str(tmp_path / "size"), "--test_file", str(tmp_path / "test"), "--fasta_file", str(tmp_path / "fa"), "--mtase", "A"], spark)
    model = ["--nucbp", "50", "--llink", "10", "--elink", "0", "--emax", "10"]
    out = str(tmp_path / "out")
    assert cli.main(["compute_model_prob", e, "--lnuc", "50", "--out", out], spark).count() == spark.read.parquet(out).count() > 0
    assert cli.main(["analyze", e, *model], spark).count() == 6
    assert cli.main(["run", e, *model, "--method", "mcmc", "--nsweep", "3", "--start_temp", "2"], spark).count() == 24
    assert cli.main(["plot_energy", e, "--tstart", "1", "--tend", "2"], spark).count() == 12
    assert cli.main(["plot_nuc_pos", e, *model], spark).where("n > 6 or n < 1").count() == 0
    tiles = cli.main(["plot_occup", e, "--n_rows", "3", "--n_columns", "10"], spark).collect()
    assert len(tiles) == 30 and all(0 <= t["value"] <= 1 and t["n"] == 80 for t in tiles)
    assert cli.main(["plot_meth_energy", e, "--emax_shown", "2"], spark).where("abs(value) > 2").count() == 0
    assert cli.main(["estimate_start_temp", e], spark).first()[0] > 0
    with pytest.raises(SystemExit):
        cli.main(["no_such", e], spark)


def test_plot_data(spark):
    rows = spark.createDataFrame([("c", m, p, None if p == 3 else m + p / 10) for m in range(4) for p in range(4)], "chrom string, mol_index long, pos int, p double")
    got = {(r["row"], r["column"]): (round(r["value"], 6), r["n"]) for r in plotdata.tiles(rows, rows["p"], 2, 2).collect()}
    assert got == {(0, 0): (0.55, 4), (0, 1): (0.7, 2), (1, 0): (2.55, 4), (1, 1): (2.7, 2)}
    assert plotdata.tiles(rows.where("false"), rows["p"]).count() == 0
    frames = spark.createDataFrame([("c", 0, [1, 4]), ("c", 0, [2]), ("c", 1, [])], "chrom string, time long, positions array<int>")
    assert {(r["time"], r["pos"]): r["n"] for r in plotdata.kymograph(frames, 3).collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 2, (0, 4): 2, (0, 5): 1, (0, 6): 1}
    assert {r["pos"]: (r["value"], r["n"]) for r in plotdata.mean_by_position(rows, "p").collect()}[3] == (None, 0)
