"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised here: at each place the longest prefix in the model's
compiled character map is replaced (no map, or no prefix: the character stays),
white space is treated as the model's settings say, and for each byte that results
the byte of the text that it came from is recorded. The normalised text is merged into pieces
by the model with its own normaliser switched off; the pieces' lengths then project each of them
to its bytes of the text. So ids and spans both come from this normalisation.

Cases. Null is the empty text, which has no pieces. Texts are encoded whole, very long ones too.
Repeated rows each get their row; an empty table gives an empty result. Columns that docs already has under a new
column's name stay, and the new one gets an underscore. The model file is read on the driver (below 10 MB)
and travels with the function.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, small_batches

SPACE = "▁".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class CharMap:
    """The compiled map: a double-array trie over UTF-8 prefixes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :] if n else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map and its replacement."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        found, node = None, offset(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 255) != data[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & ((1 << 31) - 1)
                found = k + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


def _message(fields) -> bytes:
    """A protocol-buffer message of (number, value) pairs; whole numbers as such, bytes with their length."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def without_normaliser(model: bytes) -> bytes:
    """The model with a normaliser that changes nothing: a later normalizer_spec (field 3) is merged into the one before."""
    return model + _message([(3, _message([(2, b""), (3, 0), (4, 0), (5, 0)]))])


@dataclass
class Settings:
    map: CharMap
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def settings(model: bytes) -> Settings:
    out = Settings(CharMap(b""))
    for number, value in _fields(model):
        if number == 3:  # normalizer_spec
            for k, v in _fields(value):
                if k == 2:
                    out.map = CharMap(v)
                elif k == 3:
                    out.dummy_prefix = bool(v)
                elif k == 4:
                    out.remove_extra = bool(v)
                elif k == 5:
                    out.escape = bool(v)
    return out


def normalise(text: bytes, how: Settings) -> tuple[bytes, np.ndarray]:
    """The normalised bytes, and for each boundary between them the boundary in text (one more than bytes)."""
    if not how.map.units and not how.remove_extra:
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        wide = np.where(raw == 32, len(SPACE) if how.escape else 1, 1)
        starts = np.repeat(np.arange(len(raw)), wide)
        out, lead = text.replace(b" ", SPACE) if how.escape else text, (SPACE if how.escape else b" ") if how.dummy_prefix else b""
        return lead + out, np.concatenate([np.zeros(len(lead), np.int64), starts, [len(raw)]])
    pieces: list[tuple[bytes, int]] = []
    at = 0
    while at < len(text):
        hit = how.map.longest(text, at)
        if hit:
            n, new = hit
        else:
            lead = text[at]
            n = 1 if lead < 192 else 2 if lead < 224 else 3 if lead < 240 else 4
            new = text[at : at + n]
        pieces.append((new, at))
        at += n
    out, origin, blank = bytearray(), [], how.remove_extra
    space = SPACE if how.escape else b" "
    if how.dummy_prefix and any(p.strip(b" ") for p, _ in pieces):
        out += space
        origin += [0] * len(space)
    for new, start in pieces:
        for k in range(len(new)):
            b = new[k : k + 1]
            if b == b" ":
                if blank:
                    continue
                out += space
                origin += [start] * len(space)
            else:
                out += b
                origin.append(start)
            blank = how.remove_extra and b == b" "
    if how.remove_extra:
        while out.endswith(space) and len(out) > len(space):
            del out[-len(space) :], origin[-len(space) :]
    return bytes(out), np.array([*origin, len(text)], np.int64)


class Codec:
    def __init__(self, model: bytes):
        self.sp = spm.SentencePieceProcessor(model_proto=model)
        self.merger = spm.SentencePieceProcessor(model_proto=without_normaliser(model))
        self.how = settings(model)
        n = self.sp.get_piece_size()
        self.names = [str(i) for i in range(n)]
        self.lengths = np.array([1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(n)], np.int64)
        self.unknown = self.sp.unk_id()

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The ids, and of each piece the first byte of the text and the one after its last; an inserted prefix is empty."""
        normal, back = normalise((text or "").encode(), self.how)
        if not text or not normal:
            return [], np.zeros((0, 2), np.int64)
        merged = normal.decode()
        ids = self.merger.encode(merged)
        ends = np.cumsum(self.lengths[ids])
        if ends[-1] != len(normal) or self.unknown in ids:  # an unknown piece stands for any characters
            got = self.merger.encode(merged, out_type="immutable_proto").pieces
            ends = np.cumsum([len(p.piece.encode()) if not self.sp.is_byte(p.id) else 1 for p in got])
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        return ids, np.stack([back[bounds[:-1]], back[np.minimum(bounds[1:], len(back) - 1)]], 1)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def covers(span: np.ndarray, text: str | None) -> bool:
    """Whether the spans cover the text in order and without gap."""
    return not len(span) or bool(span[0, 0] == 0 and span[-1, 1] == len(text.encode()) and (span[1:, 0] == span[:-1, 1]).all())


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", digests: bool = True, pieces: bool = True) -> DataFrame:
    """docs with n_tokens; with digests, ids_sha256, decoded_sha256, spans_sha256 (of each piece's start and end as little-endian 64-bit numbers) and spans_ok (the spans cover the text without gap); with pieces, ids, starts and ends."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    at = docs.columns.index(text)
    new = [("n_tokens", T.LongType())]
    if digests:
        new += [*((c, T.StringType()) for c in ("ids_sha256", "decoded_sha256", "spans_sha256")), ("spans_ok", T.BooleanType())]
    if pieces:
        new += [(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")]
    more = [T.StructField(fresh(docs, c), t) for c, t in new]

    def run(batches):
        codec, digest = Codec(model), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for big in batches:
            for k in range(0, big.num_rows, 256):  # few texts at a time hold their pieces in memory
                batch = big.slice(k, 256)
                rows = []
                for t in batch.column(at).to_pylist():
                    ids, span = codec.encode(t)
                    row: list = [len(ids)]
                    if digests:
                        row += [digest(",".join([codec.names[i] for i in ids])), digest(codec.decode(ids)), hashlib.sha256(span.astype("<i8").tobytes()).hexdigest(), covers(span, t)]
                    if pieces:
                        row += [np.array(ids, np.int32), span[:, 0].astype(np.int32), span[:, 1].astype(np.int32)]
                    rows.append(row)
                types = [pa.int64(), *[pa.string()] * (3 * digests), *[pa.bool_()] * digests, *[pa.list_(pa.int32())] * (3 * pieces)]
                out = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in more)])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
