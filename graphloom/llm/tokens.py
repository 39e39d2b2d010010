"""Ids of every text by a public byte-level BPE vocabulary (problem 8).

The ranks file is turned into a sentencepiece BPE model, written field by field in its protobuf
wire format: piece i is the byte string of rank i, each byte mapped to one printable character,
with score -i, so that the pair whose union has the lowest rank is merged first, the leftmost one
on ties.  Normalisation is the identity.  A text is cut into pre-tokens by the vocabulary's
pattern, each pre-token is encoded on its own, and decoding maps the pieces' characters back.

The model is built once on the driver and sent as a broadcast variable; its size is that of the
vocabulary (under 2 MB), whatever the data.  Ids of pre-tokens are kept in a dictionary of at most
``CACHE`` entries per Python worker; it only saves time.

Cases: null, empty texts give an empty list; one row comes out for each row that goes in, repeated
rows included; texts of any length are encoded whole; other columns pass through unread.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k"
CACHE = 200_000
#: Fixed value: the vocabulary's pattern for pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The ranks file of a vocabulary; ``folder`` or GRAPHLOOM_TOKENIZERS says where they lie."""
    return os.path.join(folder or os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers"), f"{name}.tiktoken")


def byte_characters() -> str:
    """256 characters; the i-th stands for byte i.  Printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def sentencepiece_model(path: str) -> bytes:
    """The serialised sentencepiece model of a ranks file."""
    chars = byte_characters()
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
    pieces = [
        _block(1, token.decode("latin-1").translate(dict(enumerate(chars))).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)
        for rank, token in ranked
    ]
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("the ranks are not contiguous from 0")
    pieces.append(_block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(ranked))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normalizer)


class Encoder:
    """Encodes and decodes with a serialised model."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.chars = dict(enumerate(byte_characters()))
        self.bytes = {ord(c): b for b, c in self.chars.items()}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = list({w for words in cut for w in words if w not in known})
        own: dict[str, list[int]] = {}
        if new:
            mapped = [w.encode().decode("latin-1").translate(self.chars) for w in new]
            for word, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                (known if len(word) <= 64 and len(known) <= CACHE else own)[word] = ids
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w] if w in known else own[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.bytes[ord(c)] for c in text).decode()


_ENCODERS: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder for a model."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _in_chunks(texts: list, most: int = 2_000_000) -> Iterator[list]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t or "")
        if size > most:
            yield chunk
            chunk, size = [], 0
    yield chunk


def encode(df: DataFrame, key: str, text: str, path: str | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids) of each row of df; with ``counts_only``, (key, n_tokens)."""
    model = df.sparkSession.sparkContext.broadcast(sentencepiece_model(path or vocabulary_path()))
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType
    out = T.StructType(
        [T.StructField(key, kind), T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        import pyarrow as pa

        enc = encoder(model.value)
        for batch in batches:
            at = 0
            for texts in _in_chunks(batch.column(1).to_pylist()):
                ids = enc.encode_batch(texts)
                values = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), values], [key, out[1].name])
                at += len(texts)

    return source.mapInArrow(run, out)
