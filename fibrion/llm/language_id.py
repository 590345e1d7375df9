"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response in the window goes
to a softmax over the languages. A filter is a table of weights by place and byte (a convolution of one-hot bytes), so a
response is a sum of table rows. Trained with numpy on labelled text. A document's verdict is the mean of its windows'
probabilities, over all windows of the whole text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PAD = max(WIDTHS) - 1
#: Labelled documents that the network is fitted on, at most, of each language (those of the least hashes), and the
#: characters of each that count: SAMPLE x CROP characters a language come to the driver at most.
SAMPLE, CROP = 1_000, 20_000
STEPS, BATCH, SEED = 500, 96, 11
BROADCAST = 500_000  #: ids of the sample that are sent to every task at most; more are joined by a shuffle
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text as rows of WINDOW + PAD bytes; the last is filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    flat = np.zeros(n * WINDOW + PAD, "u1")
    flat[: len(raw)] = np.frombuffer(raw, "u1")
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + PAD)[::WINDOW]


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: place x byte x filter
    weights: np.ndarray  # all filters x language
    bias: np.ndarray

    def responses(self, x: np.ndarray, places: bool = False):
        """Each filter's largest response in each window (and where)."""
        out, where = [], []
        for table in self.tables:
            act = table[0][x[:, :WINDOW]]
            for k in range(1, len(table)):
                act = act + table[k][x[:, k : k + WINDOW]]
            if places:
                where.append(act.argmax(1))
            out.append(act.max(1))
        return (np.concatenate(out, 1), where) if places else np.concatenate(out, 1)

    def compiled(self) -> Network:
        """The same network with tables of byte pairs, for fast use."""
        for table in self.tables:
            if len(table) not in (2, 3, 4):
                raise ValueError("widths of 2 to 4 bytes are compiled")
        net = Network(self.languages, self.tables, self.weights, self.bias)
        net.pairs = [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1).astype("f4") for k in range(0, len(t) - 1, 2)] for t in self.tables]
        return net

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language for each window, in batches that stay in the processor's cache."""
        out = np.empty((len(x), len(self.languages)), "f4")
        for lo in range(0, len(x), 64):
            part = x[lo : lo + 64]
            pair = part[:, :-1].astype("i4") * 256 + part[:, 1:]
            pooled = []
            for table, pairs in zip(self.tables, self.pairs, strict=True):
                act = np.take(pairs[0], pair[:, :WINDOW], axis=0)
                for k, p in enumerate(pairs[1:], 1):
                    act += np.take(p, pair[:, 2 * k : 2 * k + WINDOW], axis=0)
                if len(table) % 2:
                    act += np.take(table[-1], part[:, len(table) - 1 : len(table) - 1 + WINDOW], axis=0)
                half = WINDOW
                while half % 2 == 0 and half > 1:
                    half //= 2
                    act = np.maximum(act[:, :half], act[:, half:])
                pooled.append(act.max(1))
            z = np.concatenate(pooled, 1) @ self.weights + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + 64] = z / z.sum(1, keepdims=True)
        return out


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fits the network with Adam on random crops of random windows, short crops among them."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y_of = {v: i for i, v in enumerate(languages)}
    raws = [_bytes(t) for t in texts]
    by = [[i for i, v in enumerate(labels) if v == lang and raws[i]] for lang in languages]
    by = [b or list(range(len(raws))) for b in by]
    f = FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS], rng.normal(0, 0.1, (f, len(languages))).astype("f4"), np.zeros(len(languages), "f4"))
    params = [*net.tables, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        x, y = np.zeros((BATCH, WINDOW + PAD), "u1"), np.empty(BATCH, "i8")
        for i in range(BATCH):
            lang = i % len(languages)
            d = by[lang][rng.integers(len(by[lang]))]
            n = int(rng.choice([8, 24, 64, WINDOW], p=[0.1, 0.2, 0.2, 0.5]))
            at = int(rng.integers(max(1, len(raws[d]) - n + 1)))
            crop = np.frombuffer(raws[d][at : at + n], "u1")
            x[i, : len(crop)], y[i] = crop, y_of[labels[d]]
        pooled, where = net.responses(x, places=True)
        z = pooled @ net.weights + net.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        back = p @ net.weights.T
        grads = []
        rows, cols = np.repeat(np.arange(BATCH), FILTERS), np.tile(np.arange(FILTERS), BATCH)
        for k, table in enumerate(net.tables):
            g = np.zeros_like(table)
            part = back[:, k * FILTERS : (k + 1) * FILTERS].ravel()
            for place in range(len(table)):
                np.add.at(g[place], (x[rows, where[k].ravel() + place], cols), part)
            grads.append(g)
        grads += [pooled.T @ p, p.sum(0)]
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and mean probability of each whole text; `und` and 0 if it is null or has no letter."""
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)

    def settle(held: list[tuple[int, np.ndarray]]) -> None:
        if held:
            p = net.probabilities(np.concatenate([w for _, w in held]))
            at = 0
            for i, w in held:
                sums[i] = sums.get(i, 0) + p[at : at + len(w)].sum(0, dtype="f8")
                at += len(w)

    sums: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    held, n = [], 0
    for i in known:
        w = windows(_bytes(texts[i]))
        sizes[i] = len(w)
        for lo in range(0, len(w), 4096):
            held.append((i, w[lo : lo + 4096]))
            n += len(held[-1][1])
            if n >= 4096:
                settle(held)
                held, n = [], 0
    settle(held)
    for i in known:
        mean = sums[i] / sizes[i]
        lang[i], score[i] = net.languages[int(mean.argmax())], float(min(1.0, mean.max()))
    return lang, score


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id's text mod 3 is 1 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, crop: int = CROP) -> Network:
    """Fits on at most `sample` labelled documents of each language that aren't held out (those with the least hashes of
    their doc_id, so a rare language is learnt too), `crop` characters of each. Rows that share a doc_id and a language
    count as one, the least text. Without labelled rows the network says `und`."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    least = Window.partitionBy("lang").orderBy("key", "doc_id")  # ids alone; each task passes on `sample` of a language at most
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("key")).withColumn("place", F.row_number().over(least)).where(F.col("place") <= sample).select("lang", "doc_id").distinct()
    ids = common.cut(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    found = labelled.select("lang", "doc_id", F.substring("text", 1, crop).alias("text")).join(ids, ["lang", "doc_id"])
    rows = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else Network([UNKNOWN], [np.zeros((w, 256, FILTERS), "f4") for w in WIDTHS], np.zeros((FILTERS * len(WIDTHS), 1), "f4"), np.zeros(1, "f4"))


_compiled: dict[str, Network] = {}


def _network(key: str, parts: tuple) -> Network:
    """The worker's compiled network."""
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Network(*parts).compiled()
    return _compiled[key]


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """Each row with its whole text's language: all columns of docs, with lang_pred and score put last (or replaced).

    Null text and text without a letter: `und`, score 0. Only the text is looked at; repeated rows and null ids stay.
    """
    shared = common.ship(docs.sparkSession).sparkContext.broadcast((net.languages, net.tables, net.weights, net.bias))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    place = keep.index("text")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _network(key, shared.value)
        for b in batches:
            lang, score = predict(net, b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
