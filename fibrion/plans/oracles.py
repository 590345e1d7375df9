"""DuckDB SQL of queries, written from their definitions and not from the engine's relations: other ways to the same numbers
(range joins for rolling frames, dense grids for segments, self joins for lags, whole lists for selections, recursion over
positions for the exact model)."""

from __future__ import annotations

_RAW = """raw AS (
  SELECT CASE WHEN l_linenumber < 5 THEN 'test' WHEN l_linenumber < 6 THEN 'meth' ELSE 'unmeth' END AS source, 'c' || CAST(l_suppkey % 4 AS VARCHAR) AS chrom,
         CAST(l_orderkey // 128 AS BIGINT) AS mol, CAST(l_partkey % 400 AS BIGINT) AS pos, l_returnflag AS flag, round(l_discount * 10, 1) AS q FROM lineitem
), mols AS (
  SELECT *, CASE WHEN mol % 10 = 0 THEN '.' WHEN mol % 2 = 0 THEN '+' ELSE '-' END AS strand, row_number() OVER (PARTITION BY source, chrom ORDER BY mol) - 1 AS mol_index
  FROM (SELECT DISTINCT source, chrom, mol FROM raw)
), call AS (
  SELECT source, chrom, mol, pos, round(avg(q), 6) AS q FROM raw WHERE flag <> 'N' GROUP BY ALL
)"""
# a window's mean from the calls that a range join finds in it
_SMOOTH = f"""{_RAW}, sm AS (
  SELECT m.source, m.chrom, m.mol, m.mol_index, m.strand, p.pos, avg(c.q) AS s FROM mols m CROSS JOIN (SELECT unnest(range(0, 381)) AS pos) p
  LEFT JOIN call c ON m.source = c.source AND m.chrom = c.chrom AND m.mol = c.mol AND c.pos BETWEEN p.pos AND p.pos + 19 GROUP BY ALL
)"""
_TAIL = "SELECT chrom, mol_index, unnest(range(381, 400)) AS pos, NULL::DOUBLE AS {0} FROM mols WHERE source = 'test'"


def _empirical(strand: bool) -> tuple[str, str]:
    """(clip bounds, probabilities)."""
    key, known = ("chrom, strand, pos", "WHERE strand IN ('+', '-')") if strand else ("chrom, pos", "")
    head = f"""WITH {_SMOOTH}, own AS (SELECT * FROM sm {known}), ctrl AS (
  SELECT {key}, round(avg(s) FILTER (source = 'meth'), 9) AS hi, round(avg(s) FILTER (source = 'unmeth'), 9) AS lo FROM own GROUP BY ALL
), nrm AS (
  SELECT own.*, round((s - lo) / (CASE WHEN hi - lo > -1e-9 AND hi - lo < 1e-9 THEN 1e-9::DOUBLE ELSE hi - lo END), 6) AS n FROM own LEFT JOIN ctrl USING ({key})
), lim AS (
  SELECT chrom, round(quantile_cont(n, 0.001) FILTER (source = 'unmeth'), 6) AS lo, round(quantile_cont(n, 0.999) FILTER (source = 'meth'), 6) AS hi FROM nrm GROUP BY chrom
)"""
    prob = f"""{head}, blank AS (SELECT chrom, mol_index, bool_and(n IS NULL) AS none FROM nrm WHERE source = 'test' GROUP BY ALL)
SELECT chrom, mol_index, pos, CASE WHEN none THEN NULL WHEN n IS NULL THEN 0.5::DOUBLE ELSE round(least(1::DOUBLE, greatest(0::DOUBLE, (n - lo) / greatest(hi - lo, 1e-12::DOUBLE))), 6) END AS p
FROM nrm JOIN lim USING (chrom) JOIN blank USING (chrom, mol_index) WHERE source = 'test'
UNION ALL {_TAIL.format('p')}{" AND strand <> '.'" if strand else ""}"""
    return f"{head} SELECT chrom, lo, hi FROM lim", prob


# sites from the chromosomes' texts; reads of molecules at sites; control rates; log odds
_SITES = """seq AS (
  SELECT 'c' || CAST(c AS VARCHAR) AS chrom, 'N' || string_agg('ACGT'[1 + ((p*p*31 + p*17 + c*7 + (p*p*p) % 101) % 4)], '' ORDER BY p) || 'N' AS text FROM range(4) a(c), range(400) b(p) GROUP BY c
), tri AS (
  SELECT chrom, CAST(p AS BIGINT) AS pos, text[p + 2] AS b, text[p + 1 : p + 2] AS back, text[p + 2 : p + 3] AS ahead FROM seq, range(400) r(p)
), site AS (
  SELECT *, b = 'A' OR ahead = 'CG' OR back = 'GC' AS plus, b = 'T' OR back = 'CG' OR ahead = 'GC' AS minus, 'CG' IN (back, ahead) AS cg, 'GC' IN (back, ahead) AS gc FROM tri
), chan AS (
  SELECT chrom, pos, plus, minus, CASE WHEN b IN ('A', 'T') THEN 1 WHEN cg AND gc THEN 4 WHEN gc THEN 2 WHEN cg THEN 3 ELSE 0 END AS channel FROM site
)"""
_MODEL = f"""{_RAW}, {_SITES}, reads AS (
  SELECT m.source, m.chrom, m.mol, m.strand, s.pos, s.channel, coalesce(c.q, 0) AS q FROM mols m JOIN chan s USING (chrom) LEFT JOIN call c USING (source, chrom, mol, pos)
  WHERE s.channel > 0 AND (c.q IS NOT NULL OR (m.strand = '+' AND s.plus) OR (m.strand = '-' AND s.minus))
), cnt AS (
  SELECT source, chrom, pos, channel, round(sum(q), 6) AS k, count(*) AS n FROM reads GROUP BY ALL
), pool AS (
  SELECT source, chrom, channel, sum(k) / sum(n) AS m FROM cnt GROUP BY ALL
), rate AS (
  SELECT source, chrom, pos, least(greatest((k + 10 * m) / (n + 10), 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS r FROM cnt JOIN pool USING (source, chrom, channel)
), theta AS (
  SELECT chrom, pos, u.r + 0.1::DOUBLE * (m.r - u.r) AS tp, m.r AS ta FROM (SELECT * FROM rate WHERE source = 'unmeth') u JOIN (SELECT * FROM rate WHERE source = 'meth') m USING (chrom, pos) WHERE m.r - u.r > 1e-9::DOUBLE
), lam AS (
  SELECT source, chrom, mol, pos, channel, q * ln(greatest(tp, 1e-4::DOUBLE) / ta) + (1 - q) * ln((1 - greatest(tp, 1e-4::DOUBLE)) / (1 - ta)) AS l FROM reads JOIN theta USING (chrom, pos)
), lags AS (
  SELECT a.channel, b.pos - a.pos AS lag_, count(*) AS npair, round(sum(a.l * b.l), 6) AS sxy, round(sum(a.l), 6) AS sx, round(sum(b.l), 6) AS sy
  FROM lam a JOIN lam b USING (source, chrom, mol, channel) WHERE a.source = 'meth' AND b.pos > a.pos AND b.pos <= a.pos + 10 GROUP BY ALL
), tot AS (
  SELECT channel, count(*) AS n, avg(l) AS m, sum(l * l) - count(*) * avg(l) * avg(l) AS spread FROM lam WHERE source = 'meth' GROUP BY channel
), eta AS (
  SELECT channel, CASE WHEN n <= 10 OR spread <= 0 THEN 1::DOUBLE ELSE 1 / greatest(1 + 2 * coalesce((SELECT sum((sxy - m * (sx + sy) + npair * m * m) / spread) FROM lags WHERE lags.channel = tot.channel), 0), 1e-3::DOUBLE) END AS eta FROM tot
  UNION ALL SELECT DISTINCT channel, 1::DOUBLE FROM chan WHERE channel > 0 AND channel NOT IN (SELECT channel FROM tot)
)"""


def _prob(weight: str, digits: int) -> str:
    return f"""WITH {_MODEL}, own AS (
  SELECT chrom, mol, pos, {weight} AS l FROM lam JOIN eta USING (channel) WHERE source = 'test'
), win AS (
  SELECT m.chrom, m.mol, p.pos, coalesce(sum(o.l), 0) AS w FROM mols m CROSS JOIN (SELECT unnest(range(0, 381)) AS pos) p
  LEFT JOIN own o ON m.chrom = o.chrom AND m.mol = o.mol AND o.pos >= p.pos AND o.pos < p.pos + 20 WHERE m.source = 'test' GROUP BY ALL
), any_ AS (SELECT DISTINCT chrom, mol, TRUE AS reads FROM reads JOIN (SELECT DISTINCT chrom, pos FROM rate WHERE source = 'unmeth' INTERSECT SELECT DISTINCT chrom, pos FROM rate WHERE source = 'meth') USING (chrom, pos) WHERE source = 'test')
SELECT chrom, mol, pos, CASE WHEN reads THEN round(1 / (1 + exp(w)), {digits}) END AS p FROM win LEFT JOIN any_ USING (chrom, mol)
UNION ALL SELECT chrom, mol, unnest(range(381, 400)), NULL FROM mols WHERE source = 'test'"""


_DROPOUT = f"""{_RAW}, {_SITES}, lab AS (
  SELECT chrom, pos, 'A' AS label, b = 'A' AS p, b = 'T' AS m FROM site UNION ALL SELECT chrom, pos, 'CG', ahead = 'CG', back = 'CG' FROM site UNION ALL SELECT chrom, pos, 'GC', back = 'GC', ahead = 'GC' FROM site
), per AS (
  SELECT m.source, m.chrom, m.mol, label, count(*) FILTER (CASE strand WHEN '+' THEN p WHEN '-' THEN m_ ELSE p OR m_ END) AS total,
         count(c.q) FILTER (CASE strand WHEN '+' THEN p WHEN '-' THEN m_ ELSE p OR m_ END) AS covered
  FROM mols m JOIN (SELECT chrom, pos, label, p, m AS m_ FROM lab) l USING (chrom) LEFT JOIN call c USING (source, chrom, mol, pos) GROUP BY ALL
), frac AS (
  SELECT source, chrom, mol, label, round(CASE total WHEN 0 THEN 0 ELSE (total - covered) / total END, 6) AS f FROM per
  UNION ALL SELECT source, chrom, mol, 'aggregate', round(CASE sum(total) WHEN 0 THEN 0 ELSE (sum(total) - sum(covered)) / sum(total) END, 6) FROM per GROUP BY ALL
)"""
_P = ", ".join(f"round(quantile_cont(f, {p}), 6) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75))

_COVER = """tru AS (SELECT l_orderkey // 8 AS mol, l_partkey % 400 AS s FROM lineitem WHERE l_linenumber % 2 = 1), cal AS (SELECT l_orderkey // 8 AS mol, l_partkey % 400 AS s FROM lineitem WHERE l_linenumber % 2 = 0),
tcov AS (SELECT DISTINCT mol, unnest(range(s, least(s + 20, 400))) AS pos FROM tru), ccov AS (SELECT DISTINCT mol, unnest(range(s, least(s + 20, 400))) AS pos FROM cal)"""

# footprints of 10 on 64 positions, linkers of 0 to {llink} - 1 repel; f: weights by last start, with their first two moments
_REPEL = "CASE WHEN {gap} >= {llink} THEN 1::DOUBLE ELSE exp(-0.5::DOUBLE * power(power({llink}::DOUBLE / ({gap} + 1), 6) - 1, 2)) END"


def _sum(values: str, llink: str) -> str:
    repel = _REPEL.format(gap="(x - y - 9)", llink=llink)
    return f"coalesce(list_sum(list_transform(range(1, x - 8), lambda y: {values}[y] * {repel})), 0)"


_EXACT = f"""RECURSIVE ways AS (
  SELECT vec_id AS mol, 1 AS way, list_transform(embedding[1:55], lambda v: 8 * CAST(v AS DOUBLE)) AS e FROM embeddings
  UNION ALL SELECT vec_id, 2, list_reverse(list_transform(embedding[1:55], lambda v: 8 * CAST(v AS DOUBLE))) FROM embeddings
), f(mol, way, e, x, f0, f1, f2) AS (
  SELECT mol, way, e, 0, []::DOUBLE[], []::DOUBLE[], []::DOUBLE[] FROM ways
  UNION ALL
  SELECT mol, way, e, x + 1, list_append(f0, w * (1 + a0)), list_append(f1, w * (1 + a0 + a1)), list_append(f2, w * (1 + a0 + 2 * a1 + a2)) FROM (
    SELECT *, exp(-e[x + 1] - 1) AS w, {_sum('f0', '5')} AS a0, {_sum('f1', '5')} AS a1, {_sum('f2', '5')} AS a2 FROM f WHERE x < 55)
), done AS (SELECT *, 1 + list_sum(f0) AS z FROM f WHERE x = 55)"""

SQL = {
    "smooth_none": f"WITH {_SMOOTH} SELECT chrom, mol_index, pos, round(s + 1e-10, 8) AS s FROM sm WHERE source = 'test' UNION ALL {_TAIL.format('s')}",
    "smooth_mean": f"""WITH {_SMOOTH} SELECT chrom, mol_index, pos, round(coalesce(s, m) + 1e-10, 8) AS s FROM sm
JOIN (SELECT chrom, mol_index, avg(s) AS m FROM sm WHERE source = 'test' GROUP BY ALL) USING (chrom, mol_index) WHERE source = 'test' UNION ALL {_TAIL.format('s')}""",
    "molecules": f"WITH {_RAW} SELECT source, chrom, mol, strand, mol_index FROM mols",
    "clip_bounds": _empirical(False)[0],
    "clip_bounds_strand": _empirical(True)[0],
    "empirical_prob": _empirical(False)[1],
    "empirical_prob_strand": _empirical(True)[1],
    "autocorr_stats": f"WITH {_MODEL} SELECT channel, lag_, npair, sxy, sx, sy FROM lags",
    "eta_closed_form": f"WITH {_MODEL} SELECT CAST(channel AS BIGINT) AS channel, round(eta, 4) AS eta FROM eta",
    "model_prob_fixed": _prob("l", 6),
    "model_prob_eta": _prob("eta * l", 4),
    "dropout_summary": f"WITH {_DROPOUT} SELECT chrom, source, label, count(*) AS n_mol, round(min(f), 6) AS p0, {_P}, round(max(f), 6) AS p100 FROM frac GROUP BY ALL",
    "dropout_ecdf": f"WITH {_DROPOUT} SELECT source, chrom, mol, f AS frac, round(100 * cume_dist() OVER (PARTITION BY source, chrom ORDER BY f), 6) AS ecdf FROM frac WHERE label = 'aggregate'",
    "start_temperature": "SELECT round(quantile_cont(abs(8 * CAST(v AS DOUBLE)), 0.9), 6) AS t0 FROM (SELECT unnest(embedding[1:64]) AS v FROM embeddings)",
    "median_mu": "SELECT round(avg(m), 5) AS mu FROM (SELECT median(8 * CAST(v AS DOUBLE)) AS m FROM (SELECT vec_id % 4 AS c, unnest(embedding[1:64]) AS v FROM embeddings) GROUP BY c)",
    "occupancy_runs": f"""WITH {_COVER}, edge AS (SELECT mol, pos, pos - lag(pos) OVER (PARTITION BY mol ORDER BY pos) AS gap FROM tcov), grp AS (SELECT mol, pos, count(*) FILTER (gap IS NULL OR gap > 1) OVER (PARTITION BY mol ORDER BY pos) AS g FROM edge)
SELECT CAST(mol AS BIGINT) AS mol, min(pos) AS run_start, max(pos) + 1 AS run_end FROM grp GROUP BY mol, g""",
    "mcc_per_mol": f"""WITH {_COVER}, grid AS (SELECT mol, pos FROM (SELECT DISTINCT mol FROM tru INTERSECT SELECT DISTINCT mol FROM cal), (SELECT unnest(range(20, 380)) AS pos)), cell AS (
  SELECT g.mol, t.pos IS NOT NULL AS t, c.pos IS NOT NULL AS c FROM grid g LEFT JOIN tcov t USING (mol, pos) LEFT JOIN ccov c USING (mol, pos)
), n AS (SELECT mol, count(*) FILTER (t AND c) * 1::DOUBLE AS tp, count(*) FILTER (c AND NOT t) * 1::DOUBLE AS fp, count(*) FILTER (t AND NOT c) * 1::DOUBLE AS fn, count(*) FILTER (NOT t AND NOT c) * 1::DOUBLE AS tn FROM cell GROUP BY mol)
SELECT CAST(mol AS BIGINT) AS mol, tp, fp, fn, tn, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn)) / sqrt((tn + fp) * (tn + fn)) END, 6) AS mcc FROM n""",
    "downsample_mean": """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n, embedding FROM embeddings)
SELECT CAST(ceil((k + 1) * 20 / n) - 1 AS BIGINT) AS bin, pos, round(avg(v), 6) AS mean_v FROM (SELECT k, n, unnest(range(0, 64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM r) GROUP BY ALL""",
    "exact_counts": f"""WITH {_EXACT} SELECT mol, 'ok' AS status, round(ln(z), 6) AS logz, round(list_sum(f1) / z, 6) AS mean_n, round(list_sum(f2) / z - power(list_sum(f1) / z, 2), 6) AS var_n FROM done WHERE way = 1""",
    "exact_occupancy": f"""WITH {_EXACT}, p AS (
  SELECT a.mol, list_transform(range(1, 56), lambda x: a.f0[x] * b.f0[56 - x] * exp(a.e[x] + 1) / a.z) AS s FROM done a JOIN done b ON a.mol = b.mol AND a.way = 1 AND b.way = 2
) SELECT mol, CAST(pos AS INTEGER) AS pos, round(coalesce(list_sum(s[greatest(1, pos - 8) : least(55, pos + 1)]), 0), 6) AS occ FROM p, (SELECT unnest(range(0, 64)) AS pos)""",
    "llink_evidence": f"""WITH RECURSIVE rows_ AS (
  SELECT vec_id AS mol, list_transform(embedding[1:55], lambda v: 8 * CAST(v AS DOUBLE)) AS e FROM embeddings UNION ALL SELECT -1, list_transform(range(55), lambda v: 0::DOUBLE)
), f(mol, llink, e, x, f0) AS (
  SELECT mol, l.llink, e, 0, []::DOUBLE[] FROM rows_, (SELECT unnest(range(0, 65, 5)) AS llink) l
  UNION ALL SELECT mol, llink, e, x + 1, list_append(f0, exp(-e[x + 1] - 1) * (1 + {_sum('f0', 'llink')})) FROM f WHERE x < 55
), z AS (SELECT mol, llink, ln(1 + list_sum(f0)) AS z FROM f WHERE x = 55)
SELECT CAST(a.llink AS INTEGER) AS llink, round(sum(a.z - b.z), 6) AS evidence, count(*) AS mols FROM z a JOIN z b ON a.llink = b.llink AND b.mol = -1 WHERE a.mol >= 0 GROUP BY a.llink""",
}
