"""Byte-level BPE through a sentencepiece model written from the rank file.

Every token of the vocabulary becomes one piece: its bytes spelt with one
printable character per byte, scored by its negative rank, so the library's
best-score-first merges are the lowest-rank-first merges of byte-level BPE.
Piece number and rank are the same; the unknown piece the library insists on
comes last and is never produced. Normalisation is the identity. Each match of
the pre-token pattern is encoded by itself; decoding maps pieces back to bytes.

Defined cases. A null text counts as empty: no ids, no bytes. Texts of any
length are encoded whole; rows with a null id or repeated ids are encoded each
on its own; an empty table gives no rows; extra columns are carried by
``with_ids``, whose new column replaces one of the same name.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

ROWS = 128  # texts in one slice
_KEEP = 300_000  # pre-tokens remembered per task
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2  # fixed values of the model format


@lru_cache(1)
def byte_letters() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens of a rank file in order of rank."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in data.splitlines() if line)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary, as the library reads it."""
    letters = byte_letters()
    pieces = [_piece("".join(letters[b] for b in t), -float(i), _NORMAL) for i, t in enumerate(tokens)]
    pieces.append(_piece("<unk>", 0.0, _UNKNOWN))
    trainer = (_number(3, _BPE) + _number(4, len(pieces)) + _number(40, len(tokens))
               + b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43)))  # no bos, eos, pad
    identity = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, identity)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.spell = {b: letters[b] for b in range(256)}
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        found = self.split(text or "")
        known = self.known
        new = set(found).difference(known)
        if new:
            if len(known) > _KEEP:
                known.clear()
                new = set(found)
            spelt = [p.encode().decode("latin-1").translate(self.spell) for p in new]
            # tuples, which the garbage collector need not walk
            known.update(zip(new, map(tuple, self.pieces.encode(spelt, out_type=int, num_threads=1)), strict=True))
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(data: bytes, pattern: str) -> Codec:
    """One per worker and vocabulary."""
    tokens = read_ranks(data)
    return Codec(serialise(tokens), tokens, pattern)


def vocabulary(path: str) -> bytes:
    """The rank file, read on the driver and sent with the tasks (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _encoded(df: DataFrame, data: bytes, pattern: str, text_col: str, ids_col: str, bytes_col: str | None) -> DataFrame:
    """All columns of ``df``, the ids of its whole text, and the bytes they decode to."""
    added = [ids_col, *([bytes_col] if bytes_col else [])]
    rest = small_batches(df).select(*[c for c in df.columns if c not in added or c == text_col])
    fields = [*rest.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + ([T.StructField(bytes_col, T.BinaryType())] if bytes_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # small slices bound the memory of a task
                part = batch.slice(at, ROWS)
                ids = [c.encode(t) for t in part.column(text_col).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                columns = [*part.columns, pa.ListArray.from_arrays(ends, flat)]
                if bytes_col:
                    columns.append(pa.array([c.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return rest.mapInArrow(run, schema)


def with_ids(df: DataFrame, data: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of its whole text as array<int>."""
    return _encoded(df, data, pattern, text_col, ids_col, None)


def digests(docs: DataFrame, data: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = _encoded(plain, data, pattern, "text", "ids", "decoded")
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
