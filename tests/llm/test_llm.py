"""Each operator against brute force, and its defined results on nulls, empty and long texts, ties and empty tables."""

import io
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fibrion.llm import ann_search, common, components, exact_dedup, html_extract, language_id, license_scan, mixing, near_dedup, queries, sentencepiece_codec, simhash_dedup, token_output, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, size string"
LONG = "Lorem ipsum dolor. " * 4_000
ROWS = [
    (1, "The cat sat", "en", "a", 1, 0, "x"),
    (2, "the CAT sat", "en", "a", 1, 0, "x"),
    (2, "the CAT sat", "en", "a", 1, 0, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 0, ""),
    (5, "É é\tx  y\n\n", "fr", "b", 1, 0, ""),
    (6, "é é\tx  y\n\n", "fr", "b", 1, 0, ""),
    (None, "no id", "en", None, 1, 0, ""),
    (7, LONG, "la", "c", 1, 0, ""),
    (8, LONG.upper(), "la", "c", 1, 0, ""),
    (9, LONG[:-1] + "!", "la", "c", 1, 0, ""),
    (10, "123 ???", None, "c", 1, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The odd rows as a stored table, with extra columns that clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ROWS, DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return common.ship(spark).read.parquet(path)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def con(*tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con("documents", "embeddings").execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = list(got.columns)[:2]
    a, b = (x.sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ROWS)
    groups = Counter(exact_dedup.normalise(r[1]) for r in ROWS)
    assert Counter(r.group_size for r in got) == Counter(n for n in groups.values() for _ in range(n))
    assert sum(r.kept for r in got) == len(groups)
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {2}
    assert {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
    assert {(r.doc_id, r.keep_id) for r in got if r.doc_id in (7, 8, 9)} == {(7, 8), (8, 8), (9, 9)}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_block_names_by_pairs(spark, tmp_path, monkeypatch):
    """Many blocks a text: texts that share most blocks stay apart, equal ones meet."""
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("ab"), 100_000))
    texts = [base, base, base[:-1], base[:50_000] + "c" + base[50_001:], base[:8_192] * 3, base[:8_192] * 4, base[:8_192] * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.group_size for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 2}


def slow_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(ids, prints):
    label = np.array(ids)
    prints = np.array(prints, "u8")
    while True:
        new = np.array([label[np.bitwise_count(prints ^ p) <= 2].min() for p in prints])
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, odd, none):
    got = simhash_dedup.op7_simhash(spark, SF).toPandas().sort_values("doc_id")
    docs = con("documents").execute("select doc_id, text from documents order by doc_id").fetchall()
    assert got.fingerprint.tolist() == [f"{slow_print(t):016x}" for _, t in docs]
    assert got.component_id.tolist() == slow_components([d for d, _ in docs], [int(x, 16) for x in got.fingerprint]).tolist()
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_dedup(odd).collect()}
    assert {r for r in rows if r[0] in (3, 4)} == {(3, "0" * 16, 3), (4, "0" * 16, 3)}
    assert all(c is None for d, _, c in rows if d is None)
    assert simhash_dedup.simhash_dedup(none).count() == 0


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype="u8")
    fp = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 20, (60, 2))]))
    fp = fp[np.argsort(simhash_dedup.gray_rank(fp))]
    for group in (np.zeros(len(fp), "i8"), np.sort(rng.integers(0, 9, len(fp)))):
        i, j = simhash_dedup.links(fp, group, 2)
        want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if group[a] == group[b] and bin(int(fp[a] ^ fp[b])).count("1") <= 2}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_near_stage_links_every_pair_at_four_fifths(spark, tmp_path):
    """Copies with several edits, a passage that many texts share, and short and empty texts, against all pairs."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{i}" for i in range(3_000)])
    passage = list(rng.choice(vocabulary, 30))
    texts = []
    for g in range(24):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 250)))) + passage * (g % 2)
        for edits in range(int(rng.integers(1, 9))):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "Edited"
            texts.append(" ".join(copy))
    texts += ["one two", "One  two", "one two three", "", None, " "]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "a", 1)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    label = jaccard_groups(texts)
    far = [i for i, j in enumerate(label) if (simhash_dedup.fingerprint(texts[i], 5) ^ simhash_dedup.fingerprint(texts[j], 5)).bit_count() > 2]
    assert far
    got = corpus_pipeline.near(spark, common.ship(spark).read.parquet(path), SF).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(label))
    assert sum(r.doc_id is None for r in got) == 1


def test_near_copies_are_not_listed_pair_by_pair(spark, monkeypatch):
    """A large group of near copies, some of which reach only a few others: whole components from few pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(500):
        copy = list(base)
        for at in rng.choice(150, 3 if i % 10 == 0 else 1 + i % 2, replace=False):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    made, cut = [], common.cut

    def counted(df):
        out = cut(df)
        if out.columns[:2] in (["a", "b"], ["row", "label"]):
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "cut", counted)
    got = dict(near_dedup.near_rows(common.ship(spark).createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)).collect())
    label = jaccard_groups(texts)
    assert got == {i: x for i, x in enumerate(label) if label.count(x) > 1}
    assert len(got) > 300
    assert max(made) < 20 * len(texts), made


def test_among_keeps_every_wanted_row(spark):
    table = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("row"), F.col("id").cast("string").alias("text"))
    for wanted in (table.where("row % 97 = 3").select("row"), table.where("false").select("row")):
        got = {r.row for r in near_dedup.among(table, wanted).collect()}
        want = {r.row for r in wanted.collect()}
        assert want <= got
        assert len(got) < len(want) + 40_000 / 15


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = dict(components.components(table).collect())
    assert got == dict(components.components(table, one_task=0).collect())
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert all(r["size"] == 0 for r in got if r.doc_id in (3, 4))
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
    assert mixing.mix(none).count() == 0
    again = mixing.mix(odd.repartition(2)).collect()
    assert sorted((r.doc_id or 0, r["size"], r.taken) for r in got) == sorted((r.doc_id or 0, r["size"], r.taken) for r in again)
    assert sum(r.taken for r in got) == sum(r["size"] for r in got)
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_is_the_queue_of_single_words(spark):
    """Every word a packet of its own, all sources sorted by finish time and cut at the budget; one long document, a source
    that needs three turns, sources of one document and of none."""
    rng = np.random.default_rng(9)
    sizes = {"a": rng.integers(1, 60, 40), "b": [3_000, 5, 80], "c": rng.integers(1, 9, 12), "d": [7], "e": [0, 0], None: rng.integers(1, 30, 25)}
    rows = [(k * 1_000 + i, " ".join(["w"] * int(n)), src) for k, (src, v) in enumerate(sizes.items()) for i, n in enumerate(v)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    name = {r[0]: r[2] for r in rows}
    target = {name[r.doc_id]: r.target for r in got}
    size = {src: int(sum(v)) for src, v in sizes.items()}
    order = sorted(size, key=lambda x: (x is None, x or ""))
    words = sorted((k / target[src], order.index(src)) for src in size if size[src] for k in range(1, 3 * size[src] + 1))[: sum(size.values())]
    want = Counter(order[r] for _, r in words)
    assert {src: sum(r.taken for r in got if name[r.doc_id] == src) for src in size} == {src: want[src] for src in size}
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_mixing_targets(spark):
    sizes = {"a": 10, "b": 1_000, "c": 5_000, "d": 3, "e": 0, None: 700}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted((k for k in sizes if k), key=str) + [None]
    w = dict(zip(names, [5, 2, 1, 5, 2, 1], strict=True))
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while True:
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        open_ -= over
    assert got == pytest.approx(target)


MIT_WRAPPED = """Some Project

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def slow_licenses(text):
    """All windows of all templates."""
    pairs = license_scan.bigrams(text or "")
    found = {}
    for name, template in license_scan.TEMPLATES.items():
        own, wide = set(license_scan.bigrams(template)), len(license_scan.bigrams(template))
        for i, p in enumerate(pairs):
            if p in own:
                window = set(pairs[i : i + wide])
                dice = 2 * len(window & own) / (len(window) + len(own))
                if dice >= license_scan.THRESHOLD:
                    found[name] = max(found.get(name, 0), dice)
    if not found:
        return None, 0.0, 0, ""
    top = min(found, key=lambda k: (-found[k], k))
    return top, round(found[top], 9), len(found), ",".join(sorted(found))


def test_licenses(odd, none, spark):
    assert {(r.license, r.dice, r.n_licenses, r.licenses) for r in license_scan.scan(odd).collect()} == {(None, 0.0, 0, "")}
    assert license_scan.scan(none).count() == 0
    rng = np.random.default_rng(7)
    texts = [MIT_WRAPPED, "x\nReleased under the MIT  license!\nLicensed under CC by-nc 4.0.\n" + LONG, "This project is released under the MIT License.", None, "", "mit", "under the MIT License"]
    for name, template in sorted(license_scan.TEMPLATES.items()):
        w = template.split()
        texts.append("\n".join(f"// {' '.join(w[i : i + 9])}" for i in range(0, len(w), 9)))  # wrapped, in a comment
        for share in (0.05, 0.15, 0.3):  # words changed, dropped, put in
            texts.append("before it " * 20 + " ".join(x if rng.random() > share else rng.choice(["", "other", f"{x} more"]) for x in w) + " and after")
        texts.append(" ".join(w[len(w) // 3 :]))
    got = {r.doc_id: (r.license, r.dice, r.n_licenses, r.licenses) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: slow_licenses(t) for i, t in enumerate(texts)}
    assert got[0][:2] == ("MIT", 1.0) and got[1][3] == "CC-BY-NC-4.0-notice,MIT-notice" and got[2][0] == "MIT-notice"
    lo, hi = license_scan.bounds(10, 0.8)
    assert all((2 * min(m, 10) / (m + 10) >= 0.8) == (lo <= m <= hi) for m in range(1, 40))


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1_500, 70)).astype("f4")
    x[100:160] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5_000, None), (5_020, [0.0] * 70), (5_040, [1.0] * 69 + [float("nan")]), (5_060, [1.0, None]), (None, [1.0] * 70), (40, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1))
    got = {}
    for r in ann_search.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank, r.vec_id] = r.score
    assert set(got) == set(range(0, 1_500, 20))
    x = x.astype("f8")
    hit = total = 0
    for q in range(0, 1_500, 20):
        if q == 40:
            continue
        s = x @ x[q]
        s[q] = -np.inf
        s = np.append(s, x[3] @ x[q])
        ids = np.append(np.arange(1_500), 40)
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:20]]
        hit += len({v for _, v in got[q]} & set(want.tolist()))
        total += 20
        assert sorted(r for r, _ in got[q]) == list(range(1, 21))
    assert hit / total >= 0.99
    assert ann_search.nearest(df.where("false")).count() == 0
    assert ann_search.nearest(df.where("vec_id in (0, 20)")).count() == 2


def recall(got, x, queries, k=20):
    hit = total = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:k].tolist()))
        total += k
    return hit / total


@pytest.mark.parametrize("kind", ["alike", "clustered", "long and short"])
def test_nearest_recall_over_many_cells(spark, kind, monkeypatch):
    """Cells are searched as far as the measure asks: few where vectors have structure, most where they have none."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((4_000, 24))
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((100, 24)), 40, axis=0) + 0.2 * x
    if kind == "long and short":
        x *= np.exp(rng.standard_normal((4_000, 1)))
    seen = []
    kept = ann_search.probes_for
    monkeypatch.setattr(ann_search, "probes_for", lambda r, ranks: seen.append(kept(r, ranks)) or seen[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann_search.nearest(df, cell=64).collect()
    assert recall(got, x, range(0, 4_000, 20)) >= 0.95
    if kind == "clustered":
        assert seen and seen[0] <= 12  # of about 60


def test_nearest_extreme_lengths_and_other_sizes(spark):
    """Components near 1e200 and 1e-200 and vectors of another length are found, against plain products."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 8)) * 10.0 ** rng.choice([-150, -20, 0, 20, 150], (300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1_000 + 10 * i, v) for i, v in enumerate(rng.standard_normal((30, 3)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann_search.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    sizes = dict(rows)
    for q in got:
        own = [(i, float(np.dot(v, sizes[q]))) for i, v in rows if i != q and len(v) == len(sizes[q])]
        want = [i for i, _ in sorted(own, key=lambda z: (-z[1], z[0]))[:20]]
        assert [i for _, i in sorted(got[q])] == want
    assert set(got) == {i for i, _ in rows if i % 20 == 0}


def test_estimates_stay_within_bounds():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((800, 96)), rng.standard_normal((50, 96))
    rot = ann_search.rotation(96)
    est, err = ann_search.estimates(q, rot, *ann_search.encode(x, rot))
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.99


def test_token_file_round_trip(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        vocabulary = f.read()
    tok = Tokenizer.from_str(vocabulary)
    tok.encode_special_tokens = True
    got = token_output.op5_token_output(spark, SF).toPandas().sort_values("doc_id")
    start = 0
    for (doc, text), r in zip(con("documents").execute("select doc_id, text from documents order by doc_id").fetchall(), got.itertuples(), strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    manifest = token_output.write(odd, vocabulary, str(tmp_path / "odd"))
    back = token_output.read(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in back] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    assert {r.n_tokens for r in back if r.doc_id in (3, 4)} == {1}
    assert token_output.read(spark, token_output.write(none, vocabulary, str(tmp_path / "none"))).count() == 0


def test_token_file_reads_only_wanted_frames():
    out = io.BytesIO()
    w = token_output.PartWriter(out)
    raws = [np.arange(i, i + 5, dtype="<u4").tobytes() for i in range(10)]
    for i in range(0, 10, 2):
        w.frame([i, i + 1], raws[i : i + 2])
    w.close()
    r = token_output.PartReader(out, len(out.getvalue()))
    assert dict(r.documents([3, 8])) == {3: raws[3], 8: raws[8]}
    assert r.read == 2
    bad = bytearray(out.getvalue())
    bad[int(r.offsets[1]) - 1] ^= 1
    with pytest.raises(Exception):
        list(token_output.PartReader(io.BytesIO(bytes(bad)), len(bad)).documents([0]))


def test_word_codes_equal_whole_encoding():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        enc = token_output.byte_level(f.read())
    texts = ["", " a", "a  b", "x\n\ny", "日本 a b", "a\tb", None, "a <|endoftext|> b'll", "end ", "it's 12,5 ok.\nNext é«»", "a\n b", "\n"]
    ids, n = enc.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    for t, i, j in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[i:j].tolist() == enc.whole.encode(t or "", add_special_tokens=False).ids


def test_sentencepiece(spark, odd, none):
    model = sentencepiece_codec.public_model()
    c = sentencepiece_codec.Codec(model)
    docs = [r[0] or "" for r in con("documents").execute("select text from documents").fetchall()]
    hard = ["", " ", "a  b ", "\n", "日本 <s> <0x41>", "é\t▁x", "tab\tx", "\U0001f600 ok"]
    ids, count = c.encode(pa.array(docs + hard))
    assert c.verified > len(hard)  # distinct words and whole texts
    end = np.cumsum(count)
    for t, lo, hi in zip(docs + hard, end - count, end, strict=True):
        assert ids[lo:hi].tolist() == c.sp.encode(t) and c.decode(ids[lo:hi]) == c.sp.decode(ids[lo:hi].tolist())
    c.bytes[500], kept = b"?", c.bytes[500]
    with pytest.raises(ValueError):
        c._hold_decoders()
    c.bytes[500] = kept
    with pytest.raises(ValueError):
        c._hold(["ab"], np.array([5], "<u4"), np.array([1]), True)
    got = sentencepiece_codec.op4_sentencepiece(spark, SF).collect()
    assert all(r.round_trip for r in got) and len(got) == len(docs)
    rows = sentencepiece_codec.encode_decode(odd, model).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows) and {r.n_pieces for r in rows if r.doc_id in (3, 4)} == {0}
    assert sentencepiece_codec.encode_decode(none, model).count() == 0


def test_sentencepiece_unigram():
    """A small unigram model, put together by hand, against the sentencepiece library."""

    def field(n, wire, body):
        return bytes([n << 3 | wire]) + body

    import struct

    def piece(text, score, kind):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("▁ab", -4.5, 1), ("ba", -3.2, 1)]
    trainer = field(3, 0, b"\x01")
    data = b"".join(piece(*p) for p in pieces) + field(2, 2, bytes([len(trainer)]) + trainer) + field(3, 2, b"\x00")
    c = sentencepiece_codec.Codec(data)
    assert c.model.kind == sentencepiece_codec.UNIGRAM
    c.encode(pa.array(["ab", "abab ba", "aab", "b a b"]))
    assert c.verified == 4


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs)
    got = language_id.identify(docs, net).select("doc_id", "lang", "lang_pred", "score", language_id.held_out(F.col("doc_id")).alias("out")).collect()
    own = [r for r in got if r.out and r.lang]
    assert sum(r.lang == r.lang_pred for r in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = language_id.identify(odd.withColumn("score", F.lit("clash")), net).collect()
    assert len(rows) == len(ROWS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 10))
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    once = language_id.fit(odd.withColumn("lang", F.lit("x")))  # repeated doc_ids, nulls and long texts in the sample
    assert once.languages == ["x"]


def test_language_query(spark):
    got = language_id.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = con().execute("select doc_id, lang, text from '/root/testdata/sf0.01/documents.parquet'").df()
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]
    both = got.merge(truth, on="doc_id")
    assert len(both) == len(truth)
    out = both[both.held_out & both.lang.notna()]
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_sample_has_rare_languages(spark):
    rows = [(i, f"der die das und {i}", "de") for i in range(3_000)] + [(9_000 + i, f"le la les et {i}", "fr") for i in range(8)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert net.languages == ["de", "fr"]


def test_compiled_network_is_the_same():
    rng = np.random.default_rng(5)
    net = language_id.train(["abc def " * 50, "xyz uvw " * 50] * 4, ["p", "q"] * 4, steps=20)
    x = rng.integers(0, 256, (9, language_id.WINDOW + language_id.PAD)).astype("u1")
    z = net.responses(x) @ net.weights + net.bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(net.compiled().probabilities(x), p / p.sum(1, keepdims=True), atol=1e-5)


def test_html(spark, none):
    got = html_extract.op2_html_text(spark, SF).collect()
    import html
    import re

    for pid, page in con("pages").execute("select page_id, html from pages").fetchall():
        body = re.sub(r"<br>|</?b>|<[^>]*$", " ", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split("<[^>]*>", body)) if x)
        r = next(r for r in got if r.page_id == pid)
        assert (r.text, r.n_chars) == (want, len(want))
    tree = html_extract.fitted()
    for pages, least in ((html_extract.LABELLED, 1.0), (html_extract.made_pages(150, seed=99), 0.985)):
        found = [html_extract.blocks(p) for p in pages]
        right = [(html_extract.classify(tree, html_extract.features(f)) == [b[0][0] == "+" for b in f]).tolist() for f in found]
        assert np.mean(sum(right, [])) >= least

    def used(t):
        return set() if isinstance(t, bool) else {t[0]} | used(t[2]) | used(t[3])

    assert used(tree) >= {0, 2, 3, 4} and used(tree) & {1, 5}  # words and link density of the block and its neighbours
    words = "some real words of an article that go on for a while and then some more of them "
    page = f"<div id=cookie-banner>we {words}</div><article><p>A &lt;b&gt;&nbsp; c<p>{words}</p><div class='comments'><p>{words}</p></div></article><div>{words}</div><form>{words}"
    assert html_extract.main_text([page, None, "", "<", "<a"], tree) == [f"A <b> c\n{words.strip()}", "", "", html_extract.main_text(["<"], tree)[0], ""]
    empty = none.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    assert html_extract.extract(empty).count() == 0


def test_html_furniture_on_elements_without_a_box():
    """Adverts, comments and hidden text on p, li, dd, tr, td and inline elements, closed or ended by what follows."""
    tree = html_extract.fitted()
    words = "some real words of an article that go on for a while and then some more of them"
    cases = {
        f"<p>{words}</p><p class='advert'>buy</p><p>end</p>": f"{words}\nend",
        f"<p>{words}<p class=ad>buy<p>end": f"{words}\nend",
        f"<p>{words}<p class=ad>buy <b>now</b><div>end</div>": f"{words}\nend",
        f"<ul><li>{words}<li class='comment'>no<ul><li>no</li></ul>no<li>end</ul>": f"{words}\nend",
        f"<dl><dt>{words}<dd style='display:none'>no<dd>end</dl>": f"{words}\nend",
        f"<table><tr class='share'><td>no<td>no<tr><td>{words}<td id='comments'>no<td>end</table>": f"{words}\nend",
        f"<p>{words} <span class='share'>no <span>no</span> no</span>end <em hidden>no</em>now</p>": f"{words} end now",
    }
    for body, want in cases.items():
        assert html_extract.main_text([f"<nav>home</nav><article>{body}</article><footer>no</footer>"], tree) == [want]


def test_html_keeps_what_only_looks_like_furniture(spark):
    """Names of states, lone quotes, sections about a subject, formulas, images inside words; links tell on bare pages."""
    tree = html_extract.fitted()
    words = "some real words of an article that go on for a while and then some more of them"
    menu = "".join(f"<p><a href=x>{w} {w}</a></p>" for w in ("home", "news", "sport", "money", "about"))
    cases = {
        f"<div class='post-body has-sidebar'><p>{words}</p></div>": words,
        f"<p title=it's>{words}</p><p>{words}</p>": f"{words}\n{words}",
        f"<article><p>{words}</p><section class='search'>{words}</section></article>": f"{words}\n{words}",
        f"<article><p>{words} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end</p></article>": f"{words} x=2 end",
        f"<article><p>{words} one<img src=x>two <my-tag>three</my-tag></p></article>": f"{words} onetwo three",
        f"<article><p data-id=ad title=\"a > b\">{words}</p></article>": words,
        f"{menu}<p>{words} {words}</p><p>{words} {words}</p>{menu}": f"{words} {words}\n{words} {words}",
        "<article><p>" + f"{words} " * 3_000 + "</p></article>": (f"{words} " * 3_000).strip(),
        "<p " + "a=\"b\" " * 2_000: "",
    }
    assert html_extract.main_text(list(cases), tree) == list(cases.values())
    rows = [(1, "u", list(cases)[0], 5), (1, "u", list(cases)[0], 6), (None, None, None, 7)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == {(1, "u", words, len(words)): 2, (None, None, "", 0): 1}


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(300)]

    def text(bad, n):
        w = list(rng.choice(plain, n))
        for _ in range(3 * bad):
            w[rng.integers(n)] = rng.choice(["vile!", "Awful", "nasty"])
        return " ".join(w)

    labels = [int(i % 4 == 0) for i in range(600)]
    net = toxicity.train([text(v, int(rng.integers(20, 90))) for v in labels], labels)
    fresh = [(i, text(i % 2, 60)) for i in range(200)]
    got = toxicity.scores(spark.createDataFrame(fresh, "doc_id long, text string"), net).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 190
    rows = toxicity.scores(odd, net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.scores(none, toxicity.train([], [])).count() == 0


def test_toxicity_query(spark):
    """Held-out recall and false alarms on the tables themselves, and the contract's columns."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    both = got.merge(con().execute(f"select doc_id, toxic from '{sf}/labels.parquet'").df(), on="doc_id")
    out = both[both.held_out]
    assert out[out.toxic == 1].predicted.mean() > 0.8
    assert out[out.toxic == 0].predicted.mean() < 0.05


def test_toxicity_sample(spark, odd):
    """Repeated ids, nulls and long texts in the labelled rows."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(11)] + [(2, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.scores(odd, toxicity.fit(odd, labels)).count() == len(ROWS)
    assert toxicity.scores(odd, toxicity.fit(odd.where("false"), labels)).count() == len(ROWS)


def test_toxicity_gradients():
    net = toxicity.train(["bad word here", "good word there"] * 5, [1, 0] * 5)
    b = toxicity.Batch(pa.array(["one two three four", "five six"]))
    at, y, w = b.places(np.arange(len(b.of))), np.array([1.0, 0.0], "f4"), np.ones(2, "f4")
    net.p = {k: v.astype("f8") for k, v in net.p.items()}

    def loss():
        z = net.forward(net.inputs(net.vectors(b.found)), at).astype("f8")
        return float(np.mean(np.logaddexp(0, z) - y * z))

    v = net.vectors(b.found)
    g = net.backward(b.found, v, net.inputs(v), at, y, w)
    for name, i in (("wxf", (2, 5)), ("whb", (3, 17)), ("att", (4,)), ("out", (9,)), ("bf", (20,)), ("word", (int(b.found[0][0]), 1))):
        kept = net.p[name][i]
        net.p[name][i] = kept + 1e-2
        up = loss()
        net.p[name][i] = kept - 1e-2
        down = loss()
        net.p[name][i] = kept
        assert g[name][i] == pytest.approx((up - down) / 2e-2, rel=2e-2, abs=2e-4)


def jaccard_groups(texts):
    """For each text the least index that chains of pairs of similarity 0.8 or more reach."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(sets)))
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in label:
        before = list(label)
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return label


def test_pipeline(spark):
    """The stages on the smallest table, each against a brute-force version of what it keeps."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {k: r for k, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for k, r in kept.items():
        n = exact_dedup.normalise(r.text)
        best[n] = max(best.get(n, k), k)
    kept = {k: r for k, r in kept.items() if k in best.values()}
    ids = sorted(kept)
    kept = {ids[i]: kept[ids[i]] for i in sorted(set(jaccard_groups([kept[k].text for k in ids])))}
    got = p.run(spark, SF).toPandas()
    assert got.round_trip.all()
    assert set(got.doc_id) <= set(kept)
    size = {k: len(r.text.encode().split()) for k, r in kept.items()}
    times = got.doc_id.value_counts().to_dict()
    assert max(times.values()) <= 3
    assert sum(size[k] * n for k, n in times.items()) >= 0.9 * sum(size.values())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.public_model())
    for r in got.itertuples():
        assert codec.sp.decode([int(x) for x in r.ids]) == kept[r.doc_id].text and len(r.ids) == r.n_pieces


def test_stages_on_odd_rows(spark, odd, none):
    """Null ids, sources and texts, ties, repeated rows, long texts, clashing columns, empty tables."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0
        got = stage(spark, odd, SF)
        if name != p.STAGES[-1][0]:
            assert got.columns == list(p.COLUMNS)
        rows = got.collect()
        if name == "language":
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS if r[1] and any(c.isalpha() for c in r[1]))
            assert all(r.lang for r in rows)
        elif name == "exact":
            assert len(rows) == len({exact_dedup.normalise(r[1]) for r in ROWS}) and {r.doc_id for r in rows} >= {2, 4, 8, 9, 10, None}
        elif name == "near":
            known = [r for r in ROWS if r[0] is not None]
            known.sort(key=lambda r: r[0])
            label = jaccard_groups([r[1] for r in known])
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(known[i][0] for i in set(label))
            assert sum(r.doc_id is None for r in rows) == 1
        elif name == "mix":
            assert rows and not {r.doc_id for r in rows} & {3, 4}
        else:
            assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)


def test_rows_keep_their_numbers_when_scans_are_split_anew(spark, tmp_path, monkeypatch):
    """Six files, and another split of every later scan: no document is lost or taken for another."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    docs.repartition(6).write.parquet(str(tmp_path / "docs"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    splits = iter([1, 7, 2, 9, 3, 8] * 10)
    kept = common.stored_at

    def stored_at(df, what):
        out = kept(df, what)
        spark.conf.set("spark.sql.files.minPartitionNum", next(splits))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000 * next(splits)))
        return out

    monkeypatch.setattr(common, "stored_at", stored_at)
    held = spark.read.parquet(str(tmp_path / "docs"))
    want = {}
    for k, t in texts.items():
        n = exact_dedup.normalise(t)
        want[n] = max(want.get(n, k), k)
    try:
        got = p.exact(spark, held, SF).collect()
        assert sorted(r.doc_id for r in got) == sorted(want.values()) and all(r.text == texts[r.doc_id] for r in got)
        found = exact_dedup.exact_dedup(held).collect()
        assert Counter(r.doc_id for r in found) == Counter(texts.keys()) and {r.doc_id for r in found if r.kept} == set(want.values())
        mixed = p.mix(spark, held, SF).collect()
        assert mixed and all(r.text == texts[r.doc_id] for r in mixed)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
