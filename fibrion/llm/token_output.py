"""Token-ID output: independent zstandard frames with a trailing seek table and per-frame checksums.

A part file holds consecutive documents in ascending doc_id order:

    data frame 0 | data frame 1 | ... | skippable frame: document directory | skippable frame: seek table

A data frame is one zstandard frame (with its content checksum) of whole documents' ids, unsigned 32-bit little-endian.
The seek table is the public seekable format's: per frame its compressed size, decompressed size and the low half of the
content's XXH64, then the number of frames, a descriptor byte and a magic number. The directory has each document's id,
number of ids and frame, so a reader fetches the two tails and then only the frames that hold what it was asked for.

Parts are written by the executors through Arrow's file systems under the shared folder, first to a name of the task
attempt's own and then renamed, so a repeated task replaces the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_codes import WordCodes

SEEK_MAGIC, SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK = 0x8F92EAB1, 0x184D2A50, 0x184D2A5E
DIRECTORY_MAGIC = b"FBDX"
FRAME_TOKENS = 65_536
STEP = 1_000  #: documents encoded at a time
END_ID = 0
#: What a text must not have to be cut at words: runs of white space, white space at an end, characters beyond Latin-1.
UNPLAIN = "[^\\n\\x20-\\x7e\u00c0-\u00ff]|[ \\n][ \\n]|^[ \\n]|[ \\n]$|^$"


def byte_level(tokenizer_json: str) -> WordCodes:
    """A byte-level BPE. Its pre-tokenizer always cuts before a single space or line end that follows a word."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.encode_special_tokens = True  # a special token's string in a text is ordinary text
    vocab = tok.get_vocab(with_added_tokens=True)
    width = np.zeros(max(vocab.values()) + 1, "i8")
    for token, i in vocab.items():
        width[i] = len(token)  # in the byte-level alphabet a character is a byte
    return WordCodes(tok, tok, width, UNPLAIN, leading=True)


_encoders: dict[int, WordCodes] = {}


def encoder(tokenizer_json: str) -> WordCodes:
    """The worker's encoder; it lives as long as the worker."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = byte_level(tokenizer_json)
    return _encoders[key]


def frames(doc_ids: list, encoded: Iterable[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Groups whole documents into frames of about FRAME_TOKENS ids."""
    ids: list = []
    parts: list[bytes] = []
    total = 0
    for d, b in zip(doc_ids, encoded, strict=True):
        ids.append(d)
        parts.append(b)
        total += len(b)
        if total >= 4 * FRAME_TOKENS:
            yield ids, parts
            ids, parts, total = [], [], 0
    if ids:
        yield ids, parts


class PartWriter:
    """Writes one part file to a binary stream."""

    def __init__(self, stream):
        import zstandard

        self.out, self.z = stream, zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids, self.counts, self.frame_of = [], [], []

    def frame(self, doc_ids: list, encoded: list[bytes]) -> None:
        import xxhash

        raw = b"".join(encoded)
        packed = self.z.compress(raw)
        self.out.write(packed)
        self.ids += doc_ids
        self.counts += [len(b) // 4 for b in encoded]
        self.frame_of += [len(self.table)] * len(doc_ids)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        valid = np.array([x is not None for x in self.ids], dtype="u1")
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        body = valid.tobytes() + ids.tobytes() + np.array(self.counts, dtype="<u4").tobytes() + np.array(self.frame_of, dtype="<u4").tobytes()
        body = DIRECTORY_MAGIC + struct.pack("<Q", len(self.ids)) + self.z.compress(body)
        directory = struct.pack("<II", SKIPPABLE_DIRECTORY, len(body)) + body
        seek = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.out.write(directory + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        # the directory's length, found from the seek table's start backwards, is in its own header


class PartReader:
    """Reads a part file: its tails at once, frames only as they are asked for."""

    def __init__(self, stream, size: int):
        import zstandard

        self.f, self.z = stream, zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - 12 * n
        self.table = [struct.unpack("<III", row) for row in (self._at(start, 12 * n)[i : i + 12] for i in range(0, 12 * n, 12))]
        self.offsets = np.concatenate([[0], np.cumsum([r[0] for r in self.table], dtype="i8")])
        at = int(self.offsets[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        body = self._at(at + 8, length)
        if kind != SKIPPABLE_DIRECTORY or body[:4] != DIRECTORY_MAGIC:
            raise ValueError("no document directory before the seek table")
        m = struct.unpack("<Q", body[4:12])[0]
        raw = self.z.decompress(body[12:]) if m else b""
        self.valid = np.frombuffer(raw, "u1", m)
        self.ids = np.frombuffer(raw, "<i8", m, m)
        self.counts = np.frombuffer(raw, "<u4", m, 9 * m)
        self.frame_of = np.frombuffer(raw, "<u4", m, 13 * m)
        self.read = 0  # frames decompressed so far

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(int(offset))
        return self.f.read(int(n))

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.z.decompress(self._at(self.offsets[k], self.table[k][0])) if self.table[k][1] else b""
        if len(raw) != self.table[k][1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k][2]:
            raise ValueError(f"frame {k} fails its checksum")
        self.read += 1
        return raw

    def documents(self, wanted=None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, its ids' bytes) in file order; only frames that hold a wanted document are decompressed."""
        keep = np.ones(len(self.ids), bool) if wanted is None else self.valid.astype(bool) & np.isin(self.ids, np.asarray(list(wanted), "i8"))
        bounds = np.searchsorted(self.frame_of, np.arange(len(self.table) + 1))
        for k in range(len(self.table)):
            lo, hi = bounds[k], bounds[k + 1]
            if keep[lo:hi].any():
                raw, at = self.frame(k), 0
                for i in range(lo, hi):
                    n = 4 * int(self.counts[i])
                    if keep[i]:
                        yield (int(self.ids[i]) if self.valid[i] else None), raw[at : at + n]
                    at += n


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, tokenizer_json: str, out_dir: str, end_id: int = END_ID, parts: int | None = None):
    """Encodes every row of (doc_id, text) and writes the parts; returns the manifest's rows (part, path, docs, tokens).

    Null text: empty (the end id alone). Null doc_id: first. Repeated doc_ids: all kept, side by side. Empty table: no
    part has a document. The manifest has a row a part, so its size is bounded by the number of parts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    end = struct.pack("<I", end_id)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, enc, w, sink = ctx.partitionId(), encoder(shared.value), None, None
        system, base = _open(out_dir)
        own, name = f"{base}/.part-{part:06d}-{ctx.taskAttemptId()}", f"{base}/part-{part:06d}.ztk"
        tokens = docs_n = 0
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                ids = b.column(0).slice(lo, STEP).to_pylist()
                codes, count = enc.encode(b.column(1).slice(lo, STEP))
                raw, at = codes.tobytes(), np.concatenate([[0], 4 * np.cumsum(count)])
                encoded = [raw[i:j] + end for i, j in zip(at[:-1], at[1:], strict=True)]
                for group in frames(ids, encoded):
                    if w is None:
                        system.create_dir(base, recursive=True)
                        sink = system.open_output_stream(own)
                        w = PartWriter(sink)
                    w.frame(*group)
                docs_n += len(ids)
                tokens += sum(map(len, encoded)) // 4
        if w is not None:
            w.close()
            sink.close()
            system.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{out_dir}/part-{part:06d}.ztk"], "docs": [docs_n], "tokens": [tokens]})

    n = parts or common.partitions(spark)
    # ranges over (doc_id, hash of the text): a doc_id that many rows share doesn't go to one part
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    sorted_docs = keyed.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    return sorted_docs.mapInArrow(save, "part long, path string, docs long, tokens long").collect()


def read(spark: SparkSession, manifest) -> DataFrame:
    """Every document of the parts: doc_id, start, n_tokens, ids_crc32, from the files alone."""
    base, rows = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        rows.append((r["path"], base))
        base += r["tokens"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                system, p = _open(path)
                with system.open_input_file(p) as f:
                    out: list = []
                    for doc, raw in PartReader(f, f.size()).documents():
                        out.append((doc, start, len(raw) // 4, zlib.crc32(raw)))
                        start += len(raw) // 4
                        if len(out) == 20_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    frame = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return frame.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes the whole `documents` table, writes it in the file format and returns what the files hold."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    docs = common.table(spark, sf_dir, "documents")
    return read(spark, write(docs, vocabulary, common.fresh_dir(spark, "tokens")))
