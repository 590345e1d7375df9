"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer; `parse` reads its pieces (text, score, kind), the trainer's model type and byte
fallback, and the normaliser's settings. `build` makes the same tokenizer of library parts: the normaliser (compiled
character map, removal of extra spaces, dummy prefix, the metaspace marker for spaces), a unigram model from the scores,
or, if the model's type is BPE, merges ranked by the score of the piece they make, byte fallback, and a decoder.

Parity with the sentencepiece library is verified over all data: every distinct word that a worker meets is encoded by both,
every text that can't be cut at words is encoded whole by both, and the table that ids are decoded by is held, piece by
piece, against both libraries' decoders. The first difference raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_codes import WordCodes

MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
STEP = 1_000
#: Runs of white space, white space at an end, the marker itself: such texts are encoded whole.
UNPLAIN = "[ \\n][ \\n]|^[ \\n]|[ \\n]$|^$|\u2581|\\x00"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    unknown_text: str = " \u2047 "  # what an unknown piece decodes to


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: varints as int, 32/64-bit and length-delimited as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while i < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire) or (varint() if wire == 2 else None)
        if n is None:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, data[i : i + n]
        i += n


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 44:
                    m.unknown_text = v.decode()
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k in (3, 4, 5):
                    setattr(m, ("dummy_prefix", "remove_extra", "escape")[k - 3], bool(v))
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first: the order in which the model joins neighbours."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    ranked = []
    for piece, i in ids.items():
        pairs = [(ids[piece[:k]], ids[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        ranked += [(-m.pieces[i][1], i, *pair) for pair in pairs]
    ranked.sort()
    return [(m.pieces[a][0], m.pieces[b][0]) for _, _, a, b in ranked]


def build(m: Model, words: bool = False):
    """The tokenizer; words: for texts that are cut at words already (no prefix is added, spaces become the marker)."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == BPE:
        model = models.BPE({p[0]: i for i, p in enumerate(m.pieces)}, _merges(m), unk_token=None if unknown is None else m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        model = models.Unigram([(p[0], p[1]) for p in m.pieces], unknown, m.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tok = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra and not words:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix and not words:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if m.kind == BPE and cuts_at_words(m):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED])
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)
    return tok


def cuts_at_words(m: Model) -> bool:
    """No piece has the marker or a line end after another character, so nothing is joined over a word's start."""
    return all(MARK not in p.lstrip(MARK) and "\n" not in p[1:] for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def widths(m: Model) -> np.ndarray:
    return np.array([1 if kind == BYTE else len(p.replace(MARK, " ").encode()) for p, _, kind in m.pieces], "i8")


def piece_bytes(m: Model) -> list[bytes]:
    """What each id decodes to."""
    fixed = {CONTROL: b"", UNKNOWN: m.unknown_text.encode()}
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else fixed[kind] if kind in fixed else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]


class Codec:
    """verify: whether ids are held against the sentencepiece library's as they are made."""

    def __init__(self, data: bytes, verify: bool = True):
        import sentencepiece

        self.data, self.model = data, parse(data)
        self.whole = build(self.model)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        plain = self.model.kind == BPE and self.model.escape and not self.model.charsmap and self.model.dummy_prefix and cuts_at_words(self.model)
        self.words = WordCodes(build(self.model, words=True), self.whole, widths(self.model), UNPLAIN, leading=False, held=self._hold if verify else None) if plain else None
        self.verifies, self.verified = verify, 0
        self.bytes = piece_bytes(self.model)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        if verify:
            self._hold_decoders()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, document after document, and each document's number of ids; the library's threads share the texts."""
        if self.words:
            return self.words.encode(texts)
        whole = [t or "" for t in texts.to_pylist()]
        ids, count = WordCodes._ids(self.whole, whole)
        if self.verifies:
            self._hold(whole, ids, count, False)
        return ids, count

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if self.model.dummy_prefix and raw.startswith(" ") else raw

    def _hold(self, texts: list[str], ids: np.ndarray, count: np.ndarray, cut: bool) -> None:
        """Raises unless the sentencepiece library gives these ids; of whole texts, both decoders must give one text."""
        lead = len(self.sp.encode("x")) if cut else 0
        inner = [cut and t.startswith("\n") for t in texts]  # a word after a line end has no prefix of its own
        want = self.sp.encode(["x" + t if i else t for t, i in zip(texts, inner, strict=True)])
        flat = np.fromiter((x for w, i in zip(want, inner, strict=True) for x in (w[lead:] if i else w)), "<u4")
        if not np.array_equal(flat, ids):
            end = np.cumsum(count)
            for t, w, i, lo, hi in zip(texts, want, inner, end - count, end, strict=True):
                if (w[lead:] if i else w) != ids[lo:hi].tolist():
                    raise ValueError(f"ids differ from the sentencepiece library's on {t[:80]!r}")
        if not cut and self.model.byte_fallback:
            end = np.cumsum(count)
            parts = [ids[lo:hi] for lo, hi in zip(end - count, end, strict=True)]
            for t, part, back in zip(texts, parts, self.whole.decode_batch([x.tolist() for x in parts], skip_special_tokens=False), strict=True):
                if self.decode(part) != back:
                    raise ValueError(f"decoded text differs from the tokenizers library's on {t[:80]!r}")
        self.verified += len(texts)

    def _hold_decoders(self) -> None:
        """Raises unless every piece decodes as the sentencepiece library's does after another piece."""
        anchor = next((i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == NORMAL and MARK not in p), None)
        if anchor is None:
            return
        known = [i for i, (_, _, kind) in enumerate(self.model.pieces) if kind != BYTE]
        lead = self.model.pieces[anchor][0]
        for i, text in zip(known, self.sp.decode([[anchor, i] for i in known]), strict=True):
            if text != lead + self.bytes[i].decode():
                raise ValueError(f"piece {i} decodes to {text!r} in the sentencepiece library")


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def encode_decode(docs: DataFrame, model: bytes, with_ids: bool = False) -> DataFrame:
    """Every row's whole text encoded and decoded again: doc_id, n_pieces, n_bytes (fallback pieces), ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), text_crc32 (of the decoded text's UTF-8), round_trip; with_ids: and
    ids, the pieces' ids as an array.

    Null and empty text: no pieces, round trip true. Null or repeated doc_ids: a row for each row. Columns other than
    doc_id and text are left out. Ids that differ from the sentencepiece library's raise (see Codec).
    """
    shared = common.ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                texts = b.column(1).slice(lo, STEP)
                ids, count = c.encode(texts)
                at = np.concatenate([[0], np.cumsum(count)])
                raw = ids.tobytes()
                fallback = np.concatenate([[0], np.cumsum(c.is_byte[ids])])
                back = [c.decode(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                out = {
                    "doc_id": b.column(0).slice(lo, STEP),
                    "n_pieces": pa.array(count, pa.int64()),
                    "n_bytes": pa.array(fallback[at[1:]] - fallback[at[:-1]], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    "text_crc32": pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                    "round_trip": [x == (t or "") for x, t in zip(back, texts.to_pylist(), strict=True)],
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("i4")))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, text_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def public_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), public_model())
