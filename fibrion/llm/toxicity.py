"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as a vector of its own (hashed, its first component the word's smoothed log-odds in the labelled sample) and
the mean of its character trigrams' vectors (hashed). Two gated recurrent layers read a window of words from either
side, attention pools their states, and a logistic unit scores the window. Windows overlap and cover the whole text; a
document's score is its highest window's. Labels are of documents, so training picks, for each document, the window
that speaks loudest for the label, scores all windows again with the network and picks anew. All in numpy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 32, 24
WORD_SLOTS, CHAR_SLOTS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 15, 1 << 12, 6, 6, 8
#: Labelled documents that the network is fitted on, at most, of each label: those of the least hashes among texts of at
#: most LONGEST characters, so what comes to the driver is bounded in bytes too.
SAMPLE_OF, LONGEST = {1: 2_000, 0: 2_500}, 20_000
ROUNDS, EPOCHS, LEAST_STEPS, BATCH, SEED = 2, 6, 200, 128, 5
#: Log-odds that a toxic document's strongest word must have for its label to count in full.
EVIDENCE = 1.5
STEP, CHUNK = 1_000, 4_096
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (letters and digits, lower case), text after text, and each text's number of words. Null: none."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    t = pc.replace_substring_regex(pc.utf8_lower(t), r"[^\pL\pN]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(t, " "), " ")
    flat, n = lists.flatten(), lists.value_lengths().to_numpy().astype("i8")
    full = pc.binary_length(flat).to_numpy() > 0
    if not full.all():
        ends = np.cumsum(n)
        had = np.concatenate([[0], np.cumsum(full)])
        n = had[ends] - had[ends - n]
        flat = flat.filter(pa.array(full))
    return flat, n


def slots(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each word, slots of all words' trigrams end to end, where each word's trigrams start). A word's trigrams
    are those of its bytes between single spaces, as many as it has bytes."""
    if not len(words):
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
    raw = np.frombuffer(b" " + b"  ".join(words.cast(pa.large_binary()).to_pylist()) + b"  ", "u1").astype("u8")
    sizes = pc.binary_length(words).to_numpy().astype("i8")
    start = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(start, sizes)
    at = place + np.repeat(start + 2 * np.arange(len(sizes)), sizes)
    tri = (raw[at] * np.uint64(1_000_003) + raw[at + 1]) * np.uint64(1_000_003) + raw[at + 2]
    tri = (tri * _P) >> np.uint64(40)
    whole = np.add.reduceat((tri + np.uint64(1)) * ((place.astype("u8") * np.uint64(2) + np.uint64(1)) * _P), start)
    return ((whole * _P) >> np.uint64(40)).astype("i8") % WORD_SLOTS, (tri % np.uint64(CHAR_SLOTS)).astype("i8"), start


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; wx, wh: input and state weights of (update, reset, candidate) for each direction."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, odds: np.ndarray, rng: np.random.Generator) -> Network:
        e, h = WORD_DIM + CHAR_DIM, HIDDEN
        word = rng.normal(0, 0.05, (WORD_SLOTS, WORD_DIM))
        word[:, 0] = odds
        p = {"word": word, "char": rng.normal(0, 0.05, (CHAR_SLOTS, CHAR_DIM)), "att": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for d in "fb":
            p |= {f"wx{d}": rng.normal(0, 0.4, (e, 3 * h)), f"wh{d}": rng.normal(0, 0.3, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        return cls({k: v.astype("f4") for k, v in p.items()})

    def vectors(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        word, tri, start = found
        if not len(word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), "f4")
        count = np.diff(np.r_[start, len(tri)])[:, None]
        return np.concatenate([self.p["word"][word], np.add.reduceat(self.p["char"][tri], start, axis=0) / count], 1)

    def inputs(self, vectors: np.ndarray) -> list[np.ndarray]:
        """What each word adds to the gates of each direction; a last row of zeros stands for no word."""
        return [np.concatenate([vectors @ self.p[f"wx{d}"] + self.p[f"b{d}"], np.zeros((1, 3 * HIDDEN), "f4")]) for d in "fb"]

    def forward(self, gates: list[np.ndarray], at: np.ndarray, keep: bool = False):
        """Logits of windows; at: windows x WINDOW indices into gates, -1 where the text has ended."""
        h, n = HIDDEN, len(at)
        live = (at >= 0).T[:, :, None].astype("f4")
        states = np.empty((2, WINDOW, n, h), "f4")
        cache = []
        for k, d in enumerate("fb"):
            s, wh = np.zeros((n, h), "f4"), self.p[f"wh{d}"]
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x, u = gates[k][at[:, t]], s @ wh
                zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                new = s + live[t] * (1 - z) * (c - s)
                if keep:
                    cache.append((k, t, s, z, r, c, u[:, 2 * h :]))
                s = states[k, t] = new
        both = np.concatenate([states[0], states[1]], 2)  # place x window x 2h
        e = both @ self.p["att"] + np.where(live[:, :, 0] > 0, 0, -1e9).astype("f4")
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * both).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (live, cache, both, a, pooled)) if keep else logit

    def backward(self, found, vectors, gates, at: np.ndarray, y: np.ndarray, weight: np.ndarray, words: bool = True) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean cross-entropy."""
        h = HIDDEN
        logit, (live, cache, both, a, pooled) = self.forward(gates, at, keep=True)
        d_logit = (weight * (_sigmoid(logit) - y) / weight.sum()).astype("f4")
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = (both * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["att"] = (d_e[:, :, None] * both).sum((0, 1))
        d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        d_gate = [np.zeros_like(x) for x in gates]
        carry = [np.zeros((len(at), h), "f4") for _ in "fb"]
        for k, t, s, z, r, c, uc in reversed(cache):
            wh = self.p["wh" + "fb"[k]]
            d_s = d_both[t][:, k * h : (k + 1) * h] + carry[k]
            d_new = d_s * live[t]
            d_z, d_c = -d_new * (c - s), d_new * (1 - z)
            d_pc = d_c * (1 - c * c)
            d_r = d_pc * uc
            d_x = np.concatenate([d_z * z * (1 - z), d_r * r * (1 - r), d_pc], 1)
            d_u = np.concatenate([d_x[:, : 2 * h], d_pc * r], 1)
            g["wh" + "fb"[k]] += s.T @ d_u
            carry[k] = d_s - d_new * (1 - z) + d_u @ wh.T
            np.add.at(d_gate[k], at[:, t], d_x)
        word, tri, start = found
        d_vec = np.zeros_like(vectors)
        for k, d in enumerate("fb"):
            own = d_gate[k][:-1]
            g[f"wx{d}"], g[f"b{d}"] = vectors.T @ own, own.sum(0)
            d_vec += own @ self.p[f"wx{d}"].T
        if len(word):
            if words:
                np.add.at(g["word"], word, d_vec[:, :WORD_DIM])
            count = np.diff(np.r_[start, len(tri)])
            np.add.at(g["char"], tri, np.repeat(d_vec[:, WORD_DIM:] / count[:, None], count, axis=0))
        return g


def window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, its first word within the text): windows every STRIDE words until the text is covered."""
    k = 1 + -(-np.maximum(n - WINDOW, 0) // STRIDE)
    of = np.repeat(np.arange(len(n)), k)
    return of, (np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE


class Batch:
    """Texts as distinct words, codes and windows."""

    def __init__(self, texts: pa.Array):
        flat, self.n = words_of(texts)
        coded = flat.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype("i8")
        self.found = slots(self.words)
        self.of, first = window_starts(self.n)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.first = first

    def places(self, which: np.ndarray) -> np.ndarray:
        """Windows x WINDOW codes, -1 beyond the text."""
        within = self.first[which, None] + np.arange(WINDOW)
        inside = within < self.n[self.of[which], None]
        if not len(self.code):
            return np.full(within.shape, -1)
        return np.where(inside, self.code[np.minimum(self.begin[self.of[which], None] + within, len(self.code) - 1)], -1)

    def window_logits(self, net: Network) -> np.ndarray:
        gates = net.inputs(net.vectors(self.found))
        out = np.empty(len(self.of), "f4")
        for lo in range(0, len(out), CHUNK):
            out[lo : lo + CHUNK] = net.forward(gates, self.places(np.arange(lo, min(lo + CHUNK, len(out)))))
        return out

    def logits(self, net: Network) -> np.ndarray:
        """Each text's highest window."""
        first = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
        return np.maximum.reduceat(self.window_logits(net), first)


def first_of_copies(batch: Batch, rare: int = 30) -> np.ndarray:
    """Texts without the later ones that share their two least-hashed rare words: copies would count a label twice."""
    doc = np.repeat(np.arange(len(batch.n)), batch.n)
    pair = np.unique(doc * max(1, len(batch.words)) + batch.code)
    doc, word = np.divmod(pair, max(1, len(batch.words)))
    few = np.bincount(word, minlength=len(batch.words))[word] <= rare
    doc, word = doc[few], word[few]
    hashed = (word.astype("u8") + np.uint64(1)) * _P
    order = np.lexsort((hashed, doc))
    doc, word = doc[order], word[order]
    two = np.flatnonzero((doc[1:] == doc[:-1]) & np.r_[True, doc[1:-1] != doc[:-2]]) if len(doc) > 1 else np.empty(0, "i8")
    _, first = np.unique(word[two] * np.int64(len(batch.words)) + word[two + 1], return_index=True)
    drop = np.setdiff1d(doc[two], doc[two[first]])
    return np.setdiff1d(np.arange(len(batch.n)), drop)


def word_odds(batch: Batch, y: np.ndarray, smooth: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of each distinct word between toxic and other documents, and of each word slot."""
    doc = np.repeat(np.arange(len(y)), batch.n)
    pair = np.unique(batch.code * len(y) + doc)
    word, toxic = pair // len(y), y[pair % len(y)]
    df = np.stack([np.bincount(word[toxic == v], minlength=len(batch.words)) for v in (0, 1)])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((df[1] + smooth) / (n[1] + 2 * smooth)) - np.log((df[0] + smooth * n[0] / max(n[1], 1)) / (n[0] + 2 * smooth * n[0] / max(n[1], 1)))
    odds = np.where(df.sum(0) >= 4, odds, 0).clip(-3, 4)
    table = np.zeros(WORD_SLOTS)
    strongest = np.argsort(np.abs(odds))
    table[batch.found[0][strongest]] = odds[strongest]
    return odds, table


def train(texts: list[str | None], labels: list[int], seed: int = SEED) -> Network:
    """Fits the network; labels 0/1. Without both labels it says the one there is (0 without any)."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, "f4")
    if len(set(labels)) < 2:
        net = Network.fresh(np.zeros(WORD_SLOTS), rng)
        net.p["out"][:] = 0
        net.p["bias"][0] = 4.0 if labels and labels[0] else -4.0
        return net
    batch = Batch(pa.array(texts, pa.string()))
    keep = first_of_copies(batch)
    if len(keep) < len(y) and len(set(y[keep])) == 2:
        y, batch = y[keep], Batch(pa.array([texts[i] for i in keep], pa.string()))
    odds, table = word_odds(batch, y)
    net = Network.fresh(table, rng)
    score = np.zeros(len(batch.of))  # a first guess at the window that speaks for a label: the sum of its words' odds
    for lo in range(0, len(score), CHUNK):
        at = batch.places(np.arange(lo, min(lo + CHUNK, len(score))))
        score[lo : lo + CHUNK] = np.where(at >= 0, np.maximum(odds[at], 0), 0).max(1) if len(odds) else 0
    starts = np.flatnonzero(np.r_[True, batch.of[1:] != batch.of[:-1]])
    evidence = np.maximum.reduceat(score, starts)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for _ in range(ROUNDS):
        order = np.lexsort((-score, batch.of))
        loudest = order[starts]
        quiet = np.concatenate([rng.integers(s, e, 1) for s, e, t in zip(starts, np.r_[starts[1:], len(score)], y, strict=True) if t == 0])
        chosen = np.concatenate([loudest, quiet])
        target, weight = y[batch.of[chosen]], np.ones(len(chosen), "f4")
        weight[(target == 1) & (evidence[batch.of[chosen]] < EVIDENCE)] = 0.05  # its label speaks of nothing that others share
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(chosen) // BATCH)))):
            deal = rng.permutation(len(chosen))
            for lo in range(0, len(deal), BATCH):
                pick = deal[lo : lo + BATCH]
                at = batch.places(chosen[pick])
                used, local = np.unique(at, return_inverse=True)
                local = local.reshape(at.shape) - (used[0] == -1)
                sub = slots(batch.words.take(pa.array(used[used >= 0])))
                vectors = net.vectors(sub)
                g = net.backward(sub, vectors, net.inputs(vectors), local, target[pick], weight[pick], words=False)
                step += 1
                for k, x in net.p.items():
                    if k == "word":
                        continue  # words keep their log-odds and random marks: training them would learn single documents
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    x -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        score = batch.window_logits(net)
    shown = (y == 0) | (evidence >= EVIDENCE)
    net.p["bias"] += calibration(np.maximum.reduceat(score, starts)[shown], y[shown])
    return net


def calibration(logit: np.ndarray, y: np.ndarray) -> np.float32:
    """A shift that makes the documents' mean probability that of the labels."""
    lo, hi = -8.0, 8.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _sigmoid(logit + mid).mean() < y.mean() else (lo, mid)
    return np.float32(np.clip((lo + hi) / 2, -3, 3))


_networks: dict[str, Network] = {}


def _network(key: str, p: dict) -> Network:
    """The worker's network."""
    if key not in _networks:
        _networks.clear()
        _networks[key] = Network(p)
    return _networks[key]


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, score, predicted (1 if score >= 0.5).

    All windows of the whole text are scored. Null and empty texts are one window without a word. Null and repeated
    doc_ids keep their rows; other columns are left out.
    """
    shared = common.ship(docs.sparkSession).sparkContext.broadcast(net.p)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _network(key, shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                p = _sigmoid(Batch(part.column(1)).logits(own).astype("f8"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id's text mod 5 is 0 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None, longest: int = LONGEST) -> Network:
    """Fits on at most `most` labelled documents of each label, none held out: those with the least hashes of doc_id among
    texts of at most `longest` characters. Rows that share a doc_id count as one, the least text; a doc_id with both
    labels counts for both. Null labels, ids and texts are left out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    fit_for = docs.where(F.length("text") <= longest).select(F.col("doc_id").cast("long"))
    usable = usable.join(fit_for, "doc_id", "left_semi")
    parts = [usable.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in (most or SAMPLE_OF).items()]
    chosen = parts[0].unionByName(parts[1])  # bounded by `most`
    found = docs.where(F.length("text") <= longest).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
