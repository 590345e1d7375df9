"""The relational operators as named relations in portable SQL.

A relation's text refers to other relations and to the driver's tables by name; `compile` puts a relation and what it
needs into one WITH chain, so the optimizer sees the whole plan (column pruning and filters reach the Parquet scan).
NULL stands for missing throughout. Site tables (chromosome length rows) are small dimensions and join by broadcast when
the optimizer's size check allows it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EPS = "1e-4"
LAGS = 10


def _ranked(src: str, groups: list[str], key: str, wide: int = 256) -> str:
    """The rows of `src` with k, the place of the whole number `key` (different in a group) in its group, from 0. Keys are cut
    into ranges that are counted first, so no task holds more than a range's rows or a group's counts."""
    g = "".join(f"{c}, " for c in groups)
    same = "".join(f"x.{c} = b.{c} AND " for c in groups)
    own = "PARTITION BY " + ", ".join(groups) if groups else ""
    return f"""SELECT x.*, b.before_ + row_number() OVER (PARTITION BY {''.join(f'x.{c}, ' for c in groups)}x.range_ ORDER BY x.{key}) - 1 AS k
FROM (SELECT *, FLOORDIV({key}, {wide}) AS range_ FROM {src}) x JOIN (
  SELECT {g}range_, coalesce(sum(n) OVER ({own} ORDER BY range_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM (
    SELECT {g}FLOORDIV({key}, {wide}) AS range_, count(*) AS n FROM {src} GROUP BY {g}FLOORDIV({key}, {wide})) c) b ON {same}x.range_ = b.range_"""


def _selected(name: str, src: str, groups: list[str], col: str, shares: dict[str, float]) -> dict[str, str]:
    """Relations that end in `name`: the exact quantiles (linear between neighbours) of `col` a group, each under its name.

    Equal values are counted first, values are cut into ranges (64 a unit), and only the ranges that hold a wanted place are
    put in order, so no task gathers a group."""
    g = ", ".join(groups)
    same = " AND ".join(f"v.{c} = h.{c}" for c in groups)
    low = {k: f"floor({p} * (n - 1))" for k, p in shares.items()}
    high = {k: f"ceil({p} * (n - 1))" for k, p in shares.items()}
    wanted = " OR ".join(f"({r} >= h.before_ AND {r} < h.before_ + h.c)" for r in [*low.values(), *high.values()])
    at = lambda r: f"max(CASE WHEN {r} >= start_ AND {r} < start_ + c THEN x END)"
    out = ", ".join(f"round({at(low[k])} + ({p} * (max(n) - 1) - floor({p} * (max(n) - 1))) * ({at(high[k])} - {at(low[k])}), 6) AS {k}" for k, p in shares.items())
    return {
        f"{name}_vals": f"SELECT {g}, {col} AS x, floor({col} * 64) AS b, count(*) AS c FROM {src} GROUP BY {g}, {col}",
        f"{name}_hist": f"""SELECT {g}, b, c, sum(c) OVER (PARTITION BY {g} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS before_, sum(c) OVER (PARTITION BY {g}) AS n
FROM (SELECT {g}, b, sum(c) AS c FROM {name}_vals GROUP BY {g}, b) y""",
        f"{name}_near": f"""SELECT {', '.join(f'v.{c}' for c in groups)}, v.x, v.c, h.n, h.before_ + sum(v.c) OVER (PARTITION BY {', '.join(f'v.{c}' for c in groups)}, v.b ORDER BY v.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - v.c AS start_
FROM {name}_vals v JOIN {name}_hist h ON {same} AND v.b = h.b WHERE {wanted}""",
        name: f"SELECT {g}, {out} FROM {name}_near GROUP BY {g}",
    }


def build(NBP: int = 400, LNUC: int = 20, LBIN: int = 10, low: float = 0.3, high: float = 0.99, leak: float = 0.1, clip: tuple[float, float] = (0.001, 0.999)) -> dict[str, str]:  # noqa: N803
    """The relations for a footprint and a bin width, kept dropout shares and a leak rate; NBP: length of the fixture's
    chromosomes (any table `sizes` may stand for them, chromosomes may differ in length)."""
    R: dict[str, str] = {}

    # ---- data model: calls, molecules, reference sites ------------------------------------------------------------------
    R["raw_calls"] = """
SELECT CASE WHEN l_linenumber <= 4 THEN 'test' WHEN l_linenumber = 5 THEN 'meth' ELSE 'unmeth' END AS source,
       concat('c', CAST(l_suppkey % 4 AS STRING)) AS chrom, FLOORDIV(l_orderkey, 128) AS mol,
       CAST(l_partkey % 800 AS BIGINT) AS upos, CAST(l_partkey % 400 AS BIGINT) AS pos,
       CASE WHEN FLOORDIV(l_orderkey, 128) % 10 = 0 THEN '.' WHEN FLOORDIV(l_orderkey, 128) % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE l_returnflag WHEN 'N' THEN '-' WHEN 'A' THEN 'a' ELSE 'm' END AS mod_code,
       round(l_discount * 10, 1) AS q
FROM lineitem"""
    R["calls"] = """
SELECT source, chrom, mol, pos, strand, round(avg(q), 6) AS q FROM raw_calls WHERE mod_code <> '-' GROUP BY source, chrom, mol, pos, strand"""
    R["molecule_names"] = "SELECT source, chrom, mol, min(strand) AS strand FROM raw_calls GROUP BY source, chrom, mol"
    R["molecules"] = f"SELECT source, chrom, mol, strand, CAST(k AS BIGINT) AS mol_index FROM ({_ranked('molecule_names', ['source', 'chrom'], 'mol')}) x"
    R["sizes"] = f"SELECT concat('c', CAST(k AS STRING)) AS chrom, CAST({NBP} AS BIGINT) AS nbp FROM (SELECT EXPLODE_SEQ(0, 3) AS k) x"
    R["grid"] = "SELECT chrom, nbp, CAST(p AS BIGINT) AS pos FROM (SELECT chrom, nbp, EXPLODE_TO(nbp) AS p FROM sizes) x"
    R["bases"] = """
SELECT chrom, pos, substr('ACGT', CAST(1 + ((pos*pos*31 + pos*17 + c*7 + (pos*pos*pos) % 101) % 4) AS INT), 1) AS base
FROM (SELECT chrom, pos, CAST(substr(chrom, 2) AS BIGINT) AS c FROM grid) x"""
    R["neighbours"] = """
SELECT chrom, pos, base, coalesce(lag(base) OVER (PARTITION BY chrom ORDER BY pos), 'N') AS prev, coalesce(lead(base) OVER (PARTITION BY chrom ORDER BY pos), 'N') AS next FROM bases"""
    R["site_masks"] = """
SELECT chrom, pos, base = 'A' AS plus_a, base = 'T' AS minus_a,
       base = 'C' AND next = 'G' AS plus_cg, base = 'G' AND prev = 'C' AS minus_cg,
       base = 'C' AND prev = 'G' AS plus_gc, base = 'G' AND next = 'C' AS minus_gc
FROM neighbours"""
    R["site_channels"] = """
SELECT chrom, pos, CAST(CASE WHEN base IN ('A', 'T') THEN 1
  WHEN ((base = 'C' AND next = 'G') OR (base = 'G' AND prev = 'C')) AND ((base = 'C' AND prev = 'G') OR (base = 'G' AND next = 'C')) THEN 4
  WHEN (base = 'C' AND prev = 'G') OR (base = 'G' AND next = 'C') THEN 2
  WHEN (base = 'C' AND next = 'G') OR (base = 'G' AND prev = 'C') THEN 3 ELSE 0 END AS BIGINT) AS channel
FROM neighbours"""
    R["assay_masks"] = """
SELECT m.chrom, m.pos, c.channel, (plus_a OR plus_cg OR plus_gc) AND channel <> 0 AS assay_plus, (minus_a OR minus_cg OR minus_gc) AND channel <> 0 AS assay_minus
FROM site_masks m JOIN site_channels c ON m.chrom = c.chrom AND m.pos = c.pos"""
    R["wrap_contexts"] = """
SELECT a.chrom, a.pos, CASE WHEN a.channel = b.channel THEN a.channel ELSE CAST(0 AS BIGINT) END AS channel, a.channel <> b.channel AS disagree
FROM site_channels a JOIN sizes z ON a.chrom = z.chrom JOIN site_channels b ON a.chrom = b.chrom AND b.pos = z.nbp - 1 - a.pos WHERE a.pos < FLOORDIV(z.nbp, 2)"""
    R["call_filter"] = "SELECT source, chrom, mol, pos, strand, mod_code, q FROM raw_calls WHERE mod_code <> '-'"
    R["fold_positions"] = "SELECT source, chrom, mol, upos, CASE WHEN upos > 399.5 THEN 800 - upos - 1 ELSE upos END AS fpos FROM raw_calls"
    R["mol_dictionary"] = "SELECT source, chrom, mol, mol_index FROM molecules"
    R["mol_cap"] = """
SELECT source, chrom, mol, mol_index FROM (SELECT *, row_number() OVER (PARTITION BY source, chrom ORDER BY md5(concat('7:', CAST(mol AS STRING)))) AS k FROM molecules) x WHERE k <= 10"""
    R["chrom_set_check"] = """
SELECT source, count(DISTINCT chrom) AS chroms, count(DISTINCT chrom) = (SELECT count(DISTINCT chrom) FROM raw_calls WHERE source = 'test') AS same FROM raw_calls GROUP BY source"""
    for _name, _any in (("strand_filter", False), ("strand_filter_ignore", True)):
        _both = "(assay_plus OR assay_minus)"
        R[_name] = f"""
SELECT c.source, c.chrom, c.mol, c.pos, c.strand, c.q FROM calls c JOIN assay_masks s ON c.chrom = s.chrom AND c.pos = s.pos
WHERE {_both if _any else "CASE c.strand WHEN '+' THEN assay_plus WHEN '-' THEN assay_minus ELSE true END"}"""

    # ---- quality control --------------------------------------------------------------------------------------------------
    R["label_sites"] = """
SELECT chrom, pos, label, plus_, minus_ FROM (
  SELECT chrom, pos, 'A' AS label, plus_a AS plus_, minus_a AS minus_ FROM site_masks
  UNION ALL SELECT chrom, pos, 'CG', plus_cg, minus_cg FROM site_masks UNION ALL SELECT chrom, pos, 'GC', plus_gc, minus_gc FROM site_masks) x WHERE plus_ OR minus_"""
    R["label_totals"] = """
SELECT chrom, label, s.strand, CAST(sum(CASE s.strand WHEN '+' THEN CASE WHEN plus_ THEN 1 ELSE 0 END WHEN '-' THEN CASE WHEN minus_ THEN 1 ELSE 0 END ELSE 1 END) AS BIGINT) AS total
FROM label_sites CROSS JOIN (SELECT '+' AS strand UNION ALL SELECT '-' UNION ALL SELECT '.') s GROUP BY chrom, label, s.strand"""
    R["coverage"] = """
SELECT m.source, m.chrom, m.mol, m.strand, t.label, t.total, coalesce(k.covered, 0) AS covered
FROM molecules m JOIN label_totals t ON m.chrom = t.chrom AND m.strand = t.strand
LEFT JOIN (SELECT c.source, c.chrom, c.mol, l.label, count(*) AS covered FROM calls c JOIN label_sites l ON c.chrom = l.chrom AND c.pos = l.pos
  WHERE CASE c.strand WHEN '+' THEN plus_ WHEN '-' THEN minus_ ELSE true END GROUP BY c.source, c.chrom, c.mol, l.label) k
ON m.source = k.source AND m.chrom = k.chrom AND m.mol = k.mol AND t.label = k.label"""
    R["dropout_fractions"] = "SELECT source, chrom, mol, label, round(CASE WHEN total = 0 THEN 0.0 ELSE 1 - CAST(covered AS DOUBLE) / total END, 6) AS frac FROM coverage"
    R["dropout_mask_separate"] = f"SELECT source, chrom, mol, bool_and(frac BETWEEN {low} AND {high}) AS keep FROM dropout_fractions GROUP BY source, chrom, mol"
    R["pooled_fractions"] = "SELECT source, chrom, mol, round(CASE WHEN sum(total) = 0 THEN 0.0 ELSE 1 - CAST(sum(covered) AS DOUBLE) / sum(total) END, 6) AS frac FROM coverage GROUP BY source, chrom, mol"
    R["dropout_mask_aggregate"] = f"SELECT source, chrom, mol, frac BETWEEN {low} AND {high} AS keep FROM pooled_fractions"
    R["dropout_summary"] = """
SELECT chrom, source, label, count(*) AS n_mol, round(min(frac), 6) AS p0, round(PCTL(frac, 0.25), 6) AS p25, round(PCTL(frac, 0.5), 6) AS p50, round(PCTL(frac, 0.75), 6) AS p75, round(max(frac), 6) AS p100
FROM (SELECT chrom, source, label, frac FROM dropout_fractions UNION ALL SELECT chrom, source, 'aggregate', frac FROM pooled_fractions) x GROUP BY chrom, source, label"""
    R["fraction_counts"] = "SELECT source, chrom, frac, count(*) AS c FROM pooled_fractions GROUP BY source, chrom, frac"
    R["dropout_ecdf"] = """
SELECT f.source, f.chrom, f.mol, f.frac, round(100.0 * e.upto / e.n, 6) AS ecdf FROM pooled_fractions f JOIN (
  SELECT source, chrom, frac, sum(c) OVER (PARTITION BY source, chrom ORDER BY frac ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(c) OVER (PARTITION BY source, chrom) AS n FROM fraction_counts) e
ON f.source = e.source AND f.chrom = e.chrom AND f.frac = e.frac"""

    # ---- dense matrices -----------------------------------------------------------------------------------------------------
    R["dense_all"] = """
SELECT m.source, m.chrom, m.mol_index, m.mol, m.strand, g.nbp, g.pos, c.q FROM molecules m JOIN grid g ON m.chrom = g.chrom
LEFT JOIN calls c ON m.source = c.source AND m.chrom = c.chrom AND m.mol = c.mol AND g.pos = c.pos"""
    R["dense_long"] = "SELECT * FROM dense_all WHERE source = 'test'"
    R["to_dense_long"] = "SELECT chrom, mol_index, pos, q FROM dense_long"
    R["cells"] = "SELECT vec_id AS r, CAST(i AS BIGINT) AS pos, CAST(element_at_(embedding, i + 1) AS DOUBLE) AS v FROM (SELECT vec_id, embedding, EXPLODE_SEQ(0, 63) AS i FROM embeddings) x"
    R["row_mean"] = "SELECT r, round(avg(v), 6) AS mean_v, round(sum(v), 6) AS sum_v, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v FROM cells GROUP BY r"
    R["col_mean_min_max_sum"] = "SELECT pos, round(coalesce(avg(v), 0), 6) AS mean_v, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, round(sum(v), 6) AS sum_v FROM cells GROUP BY pos"
    R["row_names"] = "SELECT DISTINCT vec_id AS r FROM embeddings"
    R["row_edges"] = f"SELECT r, (SELECT count(*) FROM row_names) AS n, k FROM ({_ranked('row_names', [], 'r')}) x"
    R["downsample_mean"] = """
SELECT bin, pos, round(avg(v), 6) AS mean_v FROM (
  SELECT c.pos, c.v, CAST(ceil((e.k + 1) * 20.0 / e.n) - 1 AS BIGINT) AS bin FROM cells c JOIN row_edges e ON c.r = e.r) x GROUP BY bin, pos"""
    R["downsample_stride"] = "SELECT CAST(e.k AS BIGINT) AS row_, c.pos, round(c.v, 6) AS v FROM cells c JOIN row_edges e ON c.r = e.r WHERE e.k % ceil(e.n / 20.0) = 0"
    R["shift_center"] = f"SELECT r, pos, lag(v, {LNUC // 2}) OVER (PARTITION BY r ORDER BY pos) AS v FROM cells"
    R["shift_left"] = f"SELECT r, pos, lead(v, {LNUC // 2}) OVER (PARTITION BY r ORDER BY pos) AS v FROM cells"
    R["gather_order"] = "SELECT event_id AS k, CAST(event_id * 7919 % 500 AS BIGINT) AS r FROM events WHERE event_id % 8 = 0"
    R["gather_rows"] = "SELECT o.k, c.pos, round(c.v, 6) AS v FROM gather_order o JOIN cells c ON o.r = c.r"
    # sums of tenths often end in a 5 at the last place kept: a shift below it lets every engine round them the same way
    R["smoothed_all"] = f"""
SELECT source, chrom, mol_index, mol, strand, nbp, pos, CASE WHEN pos <= nbp - {LNUC} THEN avg(q) OVER (PARTITION BY source, chrom, mol_index ORDER BY pos RANGE BETWEEN CURRENT ROW AND {LNUC - 1} FOLLOWING) END AS s FROM dense_all"""
    R["smoothed"] = "SELECT chrom, mol_index, mol, strand, nbp, pos, s FROM smoothed_all WHERE source = 'test'"
    R["smooth_none"] = "SELECT chrom, mol_index, pos, round(s + 1e-10, 8) AS s FROM smoothed"
    R["smooth_mean"] = f"""
SELECT chrom, mol_index, pos, round(CASE WHEN pos <= nbp - {LNUC} THEN coalesce(s, avg(s) OVER (PARTITION BY chrom, mol_index)) END + 1e-10, 8) AS s FROM smoothed"""
    R["smooth_interpolate"] = """
SELECT chrom, mol_index, pos, round(coalesce(s, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN s0 + (s1 - s0) * (pos - p0) / CAST(p1 - p0 AS DOUBLE) END) + 1e-10, 8) AS s FROM (
  SELECT chrom, mol_index, pos, s, LAST_(s) AS s0, LAST_(CASE WHEN s IS NOT NULL THEN pos END) AS p0, FIRST_(s) AS s1, FIRST_(CASE WHEN s IS NOT NULL THEN pos END) AS p1 FROM smoothed) x"""

    # ---- empirical probabilities ------------------------------------------------------------------------------------------------
    for _s, _keys in (("", ["chrom"]), ("_strand", ["chrom", "strand"])):
        _k, _on = ", ".join(_keys), " AND ".join(f"x.{k} = c.{k}" for k in _keys)
        _stranded = " AND strand <> '.'" if _s else ""
        R[f"control_means{_s}"] = f"""
SELECT {_k}, pos, round(avg(CASE WHEN source = 'meth' THEN s END), 9) AS meth, round(avg(CASE WHEN source = 'unmeth' THEN s END), 9) AS unmeth
FROM smoothed_all WHERE source <> 'test'{_stranded} GROUP BY {_k}, pos"""
        R[f"normalised{_s}"] = f"""
SELECT x.source, x.chrom, x.mol_index, x.mol, x.nbp, x.pos, round((s - unmeth) / CASE WHEN abs(meth - unmeth) < 1e-9 THEN 1e-9 ELSE meth - unmeth END, 6) AS n
FROM smoothed_all x LEFT JOIN control_means{_s} c ON {_on} AND x.pos = c.pos{" WHERE x.strand <> '.'" if _s else ""}"""
        R[f"bound_values{_s}"] = f"SELECT chrom, source, n FROM normalised{_s} WHERE source <> 'test' AND n IS NOT NULL"
        R |= _selected(f"bound_ranks{_s}", f"bound_values{_s}", ["chrom", "source"], "n", {"p_lo": clip[0], "p_hi": clip[1]})
        R[f"clip_bounds{_s}"] = f"SELECT chrom, max(CASE WHEN source = 'unmeth' THEN p_lo END) AS lo, max(CASE WHEN source = 'meth' THEN p_hi END) AS hi FROM bound_ranks{_s} GROUP BY chrom"
        R[f"empirical_prob{_s}"] = f"""
SELECT x.chrom, x.mol_index, x.pos, round(CASE WHEN x.pos > x.nbp - {LNUC} OR x.known = 0 THEN NULL WHEN x.n IS NULL THEN 0.5
  WHEN x.n <= lo THEN 0.0 WHEN (x.n - lo) >= greatest(hi - lo, 1e-12) THEN 1.0 ELSE (x.n - lo) / greatest(hi - lo, 1e-12) END, 6) AS p
FROM (SELECT *, count(n) OVER (PARTITION BY chrom, mol_index) AS known FROM normalised{_s} WHERE source = 'test') x JOIN clip_bounds{_s} b ON x.chrom = b.chrom"""

    # ---- read sites, controls, model ---------------------------------------------------------------------------------------------
    R["readers"] = "SELECT source, chrom, mol, strand FROM molecules"  # molecules that are kept
    R["read_sites"] = """
SELECT m.source, m.chrom, m.mol, m.strand, s.pos, s.channel, c.q IS NOT NULL AS called, coalesce(c.q, 0.0) AS q
FROM readers m JOIN assay_masks s ON m.chrom = s.chrom
LEFT JOIN calls c ON m.source = c.source AND m.chrom = c.chrom AND m.mol = c.mol AND s.pos = c.pos
WHERE s.channel <> 0 AND (c.q IS NOT NULL OR CASE m.strand WHEN '+' THEN assay_plus WHEN '-' THEN assay_minus ELSE false END)"""
    R["read_sites_summary"] = "SELECT source, chrom, mol, channel, count(*) AS n_read, CAST(sum(CASE WHEN called THEN 1 ELSE 0 END) AS BIGINT) AS n_called, round(sum(q), 6) AS k FROM read_sites GROUP BY source, chrom, mol, channel"
    R["read_sites_span"] = """
SELECT r.source, r.chrom, r.mol, count(*) AS n_read, round(sum(r.q), 6) AS k FROM read_sites r
JOIN (SELECT source, chrom, mol, min(pos) AS lo, max(pos) AS hi FROM read_sites WHERE called GROUP BY source, chrom, mol) b
ON r.source = b.source AND r.chrom = b.chrom AND r.mol = b.mol WHERE r.pos BETWEEN b.lo AND b.hi GROUP BY r.source, r.chrom, r.mol"""
    R["q_thres"] = "SELECT source, chrom, pos, count(*) AS n, CAST(sum(CASE WHEN q >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM read_sites GROUP BY source, chrom, pos"
    R["control_counts"] = "SELECT source, chrom, pos, channel, round(sum(q), 6) AS k, CAST(count(*) AS DOUBLE) AS n FROM read_sites GROUP BY source, chrom, pos, channel"
    R["call_fractions"] = "SELECT source, channel, round(avg(CASE WHEN called THEN 1.0 ELSE 0.0 END), 6) AS frac FROM read_sites GROUP BY source, channel"
    R["nus"] = "SELECT chrom, source, channel, CAST(10 AS DOUBLE) AS nu FROM control_counts GROUP BY chrom, source, channel"
    R["rates"] = f"""
SELECT source, chrom, pos, channel, greatest({EPS}, least(1 - {EPS}, (k + nu * all_k / all_n) / (n + nu))) AS rate FROM (
  SELECT c.source, c.chrom, c.pos, c.channel, c.k, c.n, u.nu, sum(c.k) OVER (PARTITION BY c.source, c.chrom, c.channel) AS all_k, sum(c.n) OVER (PARTITION BY c.source, c.chrom, c.channel) AS all_n
  FROM control_counts c JOIN nus u ON c.chrom = u.chrom AND c.source = u.source AND c.channel = u.channel) x"""
    R["shrunk_rates"] = "SELECT source, chrom, pos, channel, round(rate, 8) AS rate FROM rates"
    R["profiles"] = """
SELECT f.chrom, f.pos, f.channel, f.rate AS f, a.rate AS a, a.rate - f.rate > 1e-9 AS informative
FROM rates f JOIN rates a ON f.chrom = a.chrom AND f.pos = a.pos WHERE f.source = 'unmeth' AND a.source = 'meth'"""
    R["control_profiles"] = "SELECT chrom, pos, channel, round(f, 8) AS f, round(a, 8) AS a, informative FROM profiles"
    R["thetas"] = f"SELECT chrom, pos, channel, informative, greatest({EPS}, least(1 - {EPS}, f + {leak} * (a - f))) AS theta_prot, a AS theta_acc FROM profiles"
    R["leak_rates"] = "SELECT chrom, pos, channel, informative, round(theta_prot, 8) AS theta_prot, round(theta_acc, 8) AS theta_acc FROM thetas"
    R["informative_fraction"] = "SELECT chrom, channel, round(avg(CASE WHEN informative THEN 1.0 ELSE 0.0 END), 6) AS frac FROM profiles GROUP BY chrom, channel"
    R["window_counts"] = f"""
SELECT r.chrom, r.mol, FLOORDIV(r.pos, {LBIN}) AS bin, r.channel, round(sum(r.q), 6) AS k, count(*) AS n, round(sum(p.f), 8) AS sf, round(sum(p.a - p.f), 8) AS sd
FROM read_sites r JOIN profiles p ON r.chrom = p.chrom AND r.pos = p.pos JOIN sizes z ON r.chrom = z.chrom
WHERE r.source = 'test' AND p.informative AND r.pos < FLOORDIV(z.nbp, {LBIN}) * {LBIN} GROUP BY r.chrom, r.mol, FLOORDIV(r.pos, {LBIN}), r.channel"""
    R["log_odds_all"] = """
SELECT r.source, r.chrom, r.mol, r.pos, r.channel, CASE WHEN t.informative THEN r.q * (ln(theta_prot) - ln(theta_acc)) + (1 - r.q) * (ln(1 - theta_prot) - ln(1 - theta_acc)) ELSE 0.0 END AS lam, t.informative
FROM read_sites r JOIN thetas t ON r.chrom = t.chrom AND r.pos = t.pos"""
    R["log_odds"] = "SELECT chrom, mol, pos, channel, lam, informative FROM log_odds_all WHERE source = 'test'"
    R["site_log_odds"] = "SELECT chrom, mol, pos, round(lam, 6) AS lam FROM log_odds"
    R["eta_source"] = "SELECT 'meth' AS source"
    R["lam_ranked"] = "SELECT l.chrom, l.mol, l.channel, l.pos, l.lam FROM log_odds_all l JOIN eta_source e ON l.source = e.source WHERE l.informative"
    _ahead = ", ".join(f"lead(pos, {j}) OVER w AS p{j}, lead(lam, {j}) OVER w AS l{j}" for j in range(1, LAGS + 1))
    R["lam_ahead"] = f"SELECT channel, pos, lam, {_ahead} FROM lam_ranked WINDOW w AS (PARTITION BY chrom, mol, channel ORDER BY pos)"
    _case = {v: "CASE j " + " ".join(f"WHEN {j} THEN {v}{j}" for j in range(1, LAGS + 1)) + " END" for v in "pl"}
    R["autocorr_stats"] = f"""
SELECT channel, lag_, count(*) AS npair, round(sum(x * y), 6) AS sxy, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy FROM (
  SELECT channel, {_case['p']} - pos AS lag_, lam AS x, {_case['l']} AS y FROM lam_ahead CROSS JOIN (SELECT EXPLODE_SEQ(1, {LAGS}) AS j) k) z WHERE lag_ <= {LAGS} GROUP BY channel, lag_"""
    R["lam_totals"] = "SELECT channel, count(*) AS n, sum(lam) AS s1, sum(lam * lam) AS s2 FROM lam_ranked GROUP BY channel"
    R["eta_rho"] = """
SELECT s.channel, s.n, a.lag_, (a.sxy - m * a.sx - m * a.sy + a.npair * m * m) / (s2 - s.n * m * m) AS rho
FROM (SELECT channel, n, s1 / n AS m, s2 FROM lam_totals) s JOIN autocorr_stats a ON s.channel = a.channel WHERE s.n > 10 AND s2 - s.n * m * m > 0"""
    R["etas"] = "SELECT c.channel, coalesce(e.eta, 1.0) AS eta FROM (SELECT DISTINCT channel FROM site_channels WHERE channel <> 0) c LEFT JOIN (SELECT channel, 1 / greatest(1 + 2 * sum(rho), 1e-3) AS eta FROM eta_rho GROUP BY channel) e ON c.channel = e.channel"
    R["eta_closed_form"] = "SELECT channel, round(eta, 4) AS eta FROM etas"
    for _n, _w, _from in (("windows", "lam", "log_odds"), ("windows_eta", "eta * lam", "(SELECT o.*, e.eta FROM log_odds o JOIN etas e ON o.channel = e.channel)")):
        R[_n] = f"""
SELECT chrom, mol, pos, CASE WHEN pos <= nbp - {LNUC} AND reads > 0 THEN w END AS w FROM (
  SELECT m.chrom, m.mol, g.nbp, g.pos, sum(coalesce({_w}, 0.0)) OVER (PARTITION BY m.chrom, m.mol ORDER BY g.pos RANGE BETWEEN CURRENT ROW AND {LNUC - 1} FOLLOWING) AS w, count(l.lam) OVER (PARTITION BY m.chrom, m.mol) AS reads
  FROM (SELECT chrom, mol FROM molecules WHERE source = 'test') m JOIN grid g ON m.chrom = g.chrom LEFT JOIN {_from} l ON m.chrom = l.chrom AND m.mol = l.mol AND g.pos = l.pos) x"""
    R["window_sum"] = "SELECT chrom, mol, pos, round(w, 6) AS w FROM windows"
    R["model_prob_fixed"] = "SELECT chrom, mol, pos, round(1 / (1 + exp(w)), 6) AS p FROM windows"
    R["model_prob_eta"] = "SELECT chrom, mol, pos, round(1 / (1 + exp(w)), 4) AS p FROM windows_eta"
    R["em_loglik_step"] = f"""
SELECT channel, round(sum(w * k) / sum(w * n), 6) AS rate_prot, round(sum((1 - w) * k) / sum((1 - w) * n), 6) AS rate_acc FROM (
  SELECT x.channel, x.k, x.n, 1 / (1 + exp(greatest(-50.0, least(50.0, y.la - y.lp)))) AS w FROM window_counts x JOIN (
    SELECT chrom, mol, bin, ln(0.75) + sum(k * ln(0.05) + (n - k) * ln(0.95)) AS lp, ln(0.25) + sum(k * ln(0.95) + (n - k) * ln(0.05)) AS la FROM window_counts GROUP BY chrom, mol, bin) y
  ON x.chrom = y.chrom AND x.mol = y.mol AND x.bin = y.bin) z GROUP BY channel"""
    R["energies"] = "SELECT r, pos, 8 * v AS e FROM cells"
    R["energy_sizes"] = "SELECT 0 AS one, abs(e) AS e FROM energies"
    R |= _selected("temperature_rank", "energy_sizes", ["one"], "e", {"t0": 0.9})
    R["start_temperature"] = "SELECT t0 FROM temperature_rank"
    R["energy_chroms"] = "SELECT r % 4 AS chrom, e FROM energies"
    R |= _selected("median_ranks", "energy_chroms", ["chrom"], "e", {"med": 0.5})
    R["median_mu"] = "SELECT round(avg(med), 5) AS mu FROM median_ranks"
    R["energy_clamp"] = "SELECT r, pos, round(greatest(-1.5, least(1.5, e)), 6) AS e FROM energies"

    # ---- occupancy, intervals, scores ----------------------------------------------------------------------------------------------
    R["axis"] = f"SELECT CAST(p AS BIGINT) AS pos FROM (SELECT EXPLODE_SEQ(0, {NBP - 1}) AS p) x"
    for _n, _odd in (("truth", 1), ("called", 0)):
        R[_n] = f"SELECT FLOORDIV(l_orderkey, 8) AS mol, CAST(l_partkey % 400 AS BIGINT) AS s FROM lineitem WHERE l_linenumber % 2 = {_odd}"
        R[f"{_n}_steps"] = f"SELECT mol, pos, sum(d) AS d FROM (SELECT mol, s AS pos, 1 AS d FROM {_n} UNION ALL SELECT mol, s + 20, -1 FROM {_n}) x GROUP BY mol, pos"
        R[f"{_n}_occ"] = f"""
SELECT mol, pos, CAST(sum(d) OVER (PARTITION BY mol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS occ FROM (
  SELECT m.mol, g.pos, coalesce(t.d, 0) AS d FROM (SELECT DISTINCT mol FROM {_n}) m CROSS JOIN axis g LEFT JOIN {_n}_steps t ON m.mol = t.mol AND g.pos = t.pos) x"""
    R["occupancy_from_intervals"] = "SELECT mol, pos, occ FROM truth_occ"
    R["interval_counts"] = "SELECT mol, count(*) AS n FROM truth GROUP BY mol"
    R["mean_count"] = "SELECT round(avg(n), 6) AS mean_n, round(var_pop(n), 6) AS var_n FROM interval_counts"
    R["access"] = "SELECT mol, pos, 1.0 - CASE WHEN occ > 0 THEN 1.0 ELSE 0.0 END AS acc FROM truth_occ"
    R["truth_levels"] = "SELECT mol, pos, sum(d) OVER (PARTITION BY mol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS occ, d FROM truth_steps WHERE d <> 0"
    R["occupancy_runs"] = f"""
SELECT mol, pos AS run_start, least(until, {NBP}) AS run_end FROM (
  SELECT mol, pos, occ, lead(pos) OVER (PARTITION BY mol ORDER BY pos) AS until FROM (SELECT mol, pos, occ, occ = d AS opens FROM truth_levels) x WHERE opens OR occ = 0) y WHERE occ > 0"""
    R["both_steps"] = "SELECT mol, pos, sum(t) AS t, sum(c) AS c FROM (SELECT mol, pos, d AS t, 0 AS c FROM truth_steps UNION ALL SELECT mol, pos, 0, d FROM called_steps) x GROUP BY mol, pos"
    R["both_segments"] = f"""
SELECT mol, greatest(0, least(until, 380) - greatest(pos, 20)) AS w, t > 0 AS t, c > 0 AS c FROM (
  SELECT mol, pos, coalesce(lead(pos) OVER (PARTITION BY mol ORDER BY pos), {NBP}) AS until, sum(t) OVER o AS t, sum(c) OVER o AS c FROM both_steps
  WINDOW o AS (PARTITION BY mol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x"""
    R["mcc_counts"] = """
SELECT mol, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(360 - tp - fp - fn AS DOUBLE) AS tn FROM (
  SELECT mol, sum(CASE WHEN t AND c THEN w ELSE 0 END) AS tp, sum(CASE WHEN c AND NOT t THEN w ELSE 0 END) AS fp, sum(CASE WHEN t AND NOT c THEN w ELSE 0 END) AS fn FROM both_segments GROUP BY mol) x
WHERE mol IN (SELECT mol FROM truth) AND mol IN (SELECT mol FROM called)"""
    R["mcc_per_mol"] = """
SELECT mol, tp, fp, fn, tn, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0.0 ELSE (tp*tn - fp*fn) / (sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)) END, 6) AS mcc FROM mcc_counts"""
    R["score_summary"] = "SELECT set_, count(*) AS n, round(avg(m), 6) AS mean_mcc, round(coalesce(stddev_samp(m), 0.0), 6) AS sd FROM (SELECT mol % 6 AS cond, mol % 2 AS set_, avg(mcc) AS m FROM mcc_per_mol GROUP BY mol % 6, mol % 2) x GROUP BY set_"
    R["paired_summary"] = "SELECT round(avg(d), 6) AS mean_diff, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM (SELECT a.mol, a.n - b.n AS d FROM interval_counts a JOIN (SELECT mol, count(*) AS n FROM called GROUP BY mol) b ON a.mol = b.mol) x"
    R["dyads"] = "SELECT DISTINCT CAST((p_partkey * 61 + p_size * 7) % 400 AS BIGINT) AS dyad FROM part WHERE p_size > 45"  # places on a chromosome: 400 at most
    R["nearest_by_place"] = "SELECT g.pos, min(abs(g.pos - y.dyad)) AS d FROM axis g CROSS JOIN dyads y GROUP BY g.pos"
    R["nearest_dyad"] = "SELECT c.mol, c.s, g.d AS dist, g.d <= 20 AS hit FROM (SELECT DISTINCT mol, s FROM called) c JOIN nearest_by_place g ON g.pos = least(c.s + 10, 399)"
    R["spacing"] = "SELECT mol, s, lead(s) OVER (PARTITION BY mol ORDER BY s) - s AS gap FROM (SELECT DISTINCT mol, s FROM called) x"
    R["tool_intersection"] = "SELECT mol FROM truth INTERSECT SELECT mol FROM called"
    R["expected_runs"] = "SELECT mol, CAST(k AS BIGINT) AS run FROM (SELECT mol, EXPLODE_SEQ(0, 7) AS k FROM (SELECT DISTINCT mol FROM truth) y) x"
    R["stored_runs"] = "SELECT FLOORDIV(l_orderkey, 8) AS mol, CAST(l_partkey % 8 AS BIGINT) AS run, count(*) AS frames, min(l_linenumber) AS least FROM lineitem GROUP BY FLOORDIV(l_orderkey, 8), l_partkey % 8"
    R["run_status"] = "SELECT e.mol, e.run, CASE WHEN g.mol IS NULL THEN 'missing' WHEN g.least > 4 THEN 'corrupted' WHEN g.frames < 3 THEN 'truncated' ELSE 'complete' END AS status FROM expected_runs e LEFT JOIN stored_runs g ON e.mol = g.mol AND e.run = g.run"
    R["incomplete_runs"] = "SELECT mol, run FROM run_status WHERE status <> 'complete'"
    R["tiling"] = """
SELECT doc_id, lo, lo + least(len, 1000) AS hi FROM (SELECT doc_id, len, CAST(least(k * 600, greatest(len - 1000, 0)) AS BIGINT) AS lo FROM (
  SELECT doc_id, len, EXPLODE_TO(CASE WHEN len <= 1000 THEN 1 ELSE 1 + FLOORDIV(len - 1000 + 599, 600) END) AS k FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS len FROM documents WHERE text IS NOT NULL) x) y) z"""
    R["bootstrap_mean"] = """
SELECT b, round(sum(w * n) / sum(w), 6) AS mean_n FROM (SELECT c.n, CAST(k AS BIGINT) AS b, 1 + (c.mol * 7919 + k * 104729) % 3 AS w FROM interval_counts c CROSS JOIN (SELECT EXPLODE_SEQ(0, 19) AS k) y) x GROUP BY b"""
    return R


R = build()

#: Relations that are steps of others rather than results of their own.
STEPS = set("""rates profiles thetas grid bases neighbours raw_calls label_sites label_totals dense_all dense_long cells row_edges row_names lam_ranked lam_ahead truth called
truth_steps called_steps truth_levels windows windows_eta log_odds log_odds_all energies smoothed smoothed_all read_sites called_occ truth_occ pooled_fractions fraction_counts normalised
normalised_strand molecule_names sizes nus eta_source eta_rho etas axis both_steps both_segments mcc_counts dyads nearest_by_place expected_runs stored_runs gather_order bound_values
bound_values_strand bound_ranks bound_ranks_strand energy_sizes energy_chroms temperature_rank median_ranks readers lam_totals""".split())
STEPS |= {k for k in R if k.endswith(("_vals", "_hist", "_near"))}


def _needs(name: str, seen: dict[str, None], known: dict[str, str]) -> None:
    for other in re.findall(r"\b\w+\b", known[name]):
        if other in known and other != name and other not in seen and re.search(rf"(?:FROM|JOIN)\s+{other}\b", known[name]):
            _needs(other, seen, known)
    seen[name] = None


_SPARK = [
    (r"EXPLODE_TO\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"explode(sequence(0L, CAST(\1 AS BIGINT) - 1))"), (r"EXPLODE_SEQ\(", "explode(sequence("), (r"(explode\(sequence\(\d+, \d+\))", r"\1)"), (r"PCTL\(", "percentile("), (r"element_at_\(embedding, i \+ 1\)", "embedding[i]"),
    (r"LAST_\(((?:[^()]|\([^()]*\))*)\)", r"last_value(\1) IGNORE NULLS OVER (PARTITION BY chrom, mol_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    (r"FIRST_\(((?:[^()]|\([^()]*\))*)\)", r"first_value(\1) IGNORE NULLS OVER (PARTITION BY chrom, mol_index ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    (r"FLOORDIV\(([^,]+), (\d+)\)", r"((\1) div \2)"),
]
_DUCK = [
    (r"EXPLODE_TO\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"unnest(range(0, CAST(\1 AS BIGINT)))"),
    (r"EXPLODE_SEQ\((\d+), (\d+)\)", lambda m: f"unnest(range({m[1]}, {int(m[2]) + 1}))"), (r"PCTL\(", "quantile_cont("), (r"element_at_\(embedding, i \+ 1\)", "embedding[i + 1]"), (r"AS STRING\)", "AS VARCHAR)"),
    (r"LAST_\(((?:[^()]|\([^()]*\))*)\)", r"last_value(\1 IGNORE NULLS) OVER (PARTITION BY chrom, mol_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    (r"FIRST_\(((?:[^()]|\([^()]*\))*)\)", r"first_value(\1 IGNORE NULLS) OVER (PARTITION BY chrom, mol_index ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    (r"FLOORDIV\(([^,]+), (\d+)\)", r"((\1) // \2)"), (r"\b(\d+\.\d+)\b(?!e)", r"CAST(\1 AS DOUBLE)"), (r"quantile_cont\(([^,]+), CAST\((\d+\.\d+) AS DOUBLE\)\)", r"quantile_cont(\1, \2)"),
]


def compile_sql(name: str, rules, known: dict[str, str] | None = None) -> str:
    """A relation and what it needs as one WITH chain."""
    R = known or globals()["R"]  # noqa: N806
    order: dict[str, None] = {}
    _needs(name, order, R)
    text = "WITH " + ",\n".join(f"{k} AS ({R[k].strip()})" for k in order if k != name) if len(order) > 1 else ""
    text += ("\n" if text else "") + R[name].strip()
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


def duckdb_sql(name: str) -> str:
    return compile_sql(name, _DUCK)


def over(spark: SparkSession, name: str, known: dict[str, str], tables: dict[str, DataFrame]) -> DataFrame:
    """A relation of `known` over the named tables."""
    text = re.sub(r"\b(\d+\.\d+)\b(?!D)", r"\1D", compile_sql(name, _SPARK, known))
    used = {t: df for t, df in tables.items() if re.search(rf"(?:FROM|JOIN) {t}\b", text)}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def relation(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """The relation over the Parquet tables of a folder."""
    text = compile_sql(name, _SPARK)
    return over(spark, name, R, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"FROM {t}\b", text)})
