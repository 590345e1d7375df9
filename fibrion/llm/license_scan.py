"""License scan: windows of the normalised whole text compared with license templates by Dice coefficient over word bigrams.

A text is normalised (lower case, everything but letters and digits to single spaces, so line ends, comment signs and
wrapping don't count) and read in windows of a template's length, at every place where a bigram of the template stands; a
window that meets the text's end is shorter. The Dice coefficient of the bigram sets of window and template, 2|A and B| /
(|A| + |B|), can reach t only if |A| lies between |B| t/(2-t) and |B| (2-t)/t, and only if |B| t/(2-t) bigrams of the template
stand in the window. So a template is compared only with texts long enough, only where that many of its bigrams stand
close enough together, and only with windows whose size lies in its bounds. DataFrame functions alone, without a shuffle.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES

THRESHOLD = 0.8


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    """All bigrams in text order."""
    w = _tokens(text)
    return list(map(" ".join, zip(w, w[1:], strict=False)))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set that can reach the threshold against one of n bigrams."""
    fits = [m for m in range(1, int(2 * n / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n)]
    return fits[0], fits[-1]


def least_shared(n: int, threshold: float) -> int:
    """Bigrams that a set must share with one of n to reach the threshold, at least."""
    return next(m for m in range(1, n + 1) if 2 * m >= threshold * (m + n))


def telling_words(sets: dict[str, set[str]], threshold: float) -> list[str]:
    """Words of which every window that reaches the threshold has one: for each template, its longest words until the
    bigrams without them can't make the threshold alone."""
    out: set[str] = set()
    for _, grams in sorted(sets.items()):
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
            rest = sum(1 for g in grams if not out & set(g.split()))
            if 2 * rest < threshold * (rest + len(grams)):
                break
            out.add(word)
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, license (of the best match; ties: the first name; null without one),
    dice (of the best match, 0 without one), n_licenses (templates that reach the threshold), licenses (their names in
    order, joined by commas; empty without one).

    The whole text is held against the templates. Null and empty texts have no match; null and repeated doc_ids keep their
    rows; other columns are left out. The templates (two words at least) are a parameter, not data, and sit in the plan.
    """
    grams = {k: bigrams(v) for k, v in sorted(templates.items())}
    sets = {k: set(v) for k, v in grams.items()}
    every = sorted(set().union(*sets.values()))
    hint = "(?i)(?<![a-z0-9])(?:" + "|".join(telling_words(sets, threshold)) + ")(?![a-z0-9])"

    words = F.split(F.trim(F.regexp_replace(common.lower_az(F.col("text")), "[^a-z0-9]+", " ")), " ")
    rows = docs.select(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(hint), words).alias("w"))
    pairs = F.slice(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.size("w") - 1)
    rows = rows.select("doc_id", F.when(F.size("w") > 1, pairs).alias("pairs"))
    places = F.transform("pairs", lambda x, i: F.when(x.isin(every), F.struct(i.alias("at"), x.alias("gram"))))
    rows = rows.select("doc_id", "pairs", F.array_compact(places).alias("hits"))

    def best(name: str) -> Column:
        """The template's best window: struct of (-dice, name), null if none reaches the threshold."""
        own, wide = sets[name], len(grams[name])  # a window holds as many bigrams as the template, repeats counted
        low, high = bounds(len(own), threshold)
        need = least_shared(len(own), threshold)
        at = F.transform(F.filter("hits", lambda h: h["gram"].isin(sorted(own))), lambda h: h["at"])
        starts = F.filter(F.zip_with(at, F.slice(at, F.lit(need), F.greatest(F.size(at), F.lit(1))), lambda a, b: F.when(b - a < wide, a)), lambda a: a.isNotNull())
        literal = F.array(*map(F.lit, sorted(own)))

        def dice(a: Column) -> Column:
            window = F.array_distinct(F.slice("pairs", a + 1, F.lit(wide)))
            value = 2.0 * F.size(F.array_intersect(window, literal)) / (F.size(window) + len(own))
            return F.when(F.size(window).between(low, high) & (value >= threshold), -value)

        found = F.array_min(F.array_compact(F.transform(starts, dice)))
        fits = F.size("hits") >= need
        return F.when(fits & found.isNotNull(), F.struct(found.alias("minus"), F.lit(name).alias("license")))

    hits = rows.select("doc_id", F.when(F.size("hits") >= min(least_shared(len(s), threshold) for s in sets.values()), F.array_compact(F.array(*map(best, sets)))).alias("found"))
    names = F.transform("found", lambda x: x["license"])
    top = F.array_min("found")
    return hits.select(
        "doc_id",
        top["license"].alias("license"),
        F.round(F.coalesce(-top["minus"], F.lit(0.0)), 9).alias("dice"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The oracle compares every window that starts at a template's bigram, without bounds and telling words."""
    values = ", ".join(f"('{k}', {len(bigrams(v))}, [{', '.join(repr(g) for g in sorted(set(bigrams(v))))}])" for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH t(license, wide, grams) AS (VALUES {values}), d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents
), p AS (
  SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM d WHERE len(w) > 1
), h AS (
  SELECT r, unnest(pairs) AS gram, generate_subscripts(pairs, 1) AS at FROM p
), s AS (
  SELECT h.r, h.at, t.license FROM h JOIN (SELECT license, unnest(grams) AS gram FROM t) t USING (gram)
), m AS (
  SELECT s.r, s.license, list_distinct(list_slice(p.pairs, s.at, s.at + t.wide - 1)) AS own, t.grams FROM s JOIN p USING (r) JOIN t USING (license)
), k AS (
  SELECT r, license, max(2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams))) AS dice FROM m GROUP BY r, license
), b AS (
  SELECT r, max(dice) AS dice, arg_min(license, struct_pack(a := -dice, b := license)) AS license, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names FROM k WHERE dice >= {THRESHOLD} GROUP BY r
)
SELECT doc_id, license, round(coalesce(dice, 0.0::DOUBLE), 9) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN b USING (r)
"""


OP6_SQL = _sql()
