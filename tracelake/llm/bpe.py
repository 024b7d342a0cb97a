"""Byte-level BPE encoding and decoding.

The tokenizers library encodes over Arrow batches. Each byte is written as one printable character, so a
vocabulary of byte strings becomes one of character strings; decoding reverses that table and joins bytes
before it reads them as UTF-8, so a character that two tokens share comes out whole.

Null and empty texts have no tokens and decode to no bytes. Repeated rows each give a row. Very long texts are cut only
where no token can cross. An empty table gives an empty result. Columns other than ``id_col`` and ``text_col`` are not looked at and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import _tokens as K

_loaded: dict = {}


class Codec:
    """A rank table's tokenizer with its way back from ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = K.read_ranks(ranks_path)
        self.tokenizer = K.from_ranks(ranks, pattern)
        self.units = K.id_bytes(self.tokenizer)
        back = {c: b for b, c in enumerate(K.byte_characters())}
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            pieces[i] = bytes(back[c] for c in token)
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    @classmethod
    def get(cls, ranks_path: str, pattern: str) -> Codec:
        key = (ranks_path, pattern)
        if key not in _loaded:
            _loaded[key] = cls(ranks_path, pattern)
        return _loaded[key]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.table[np.repeat(self.at[ids], size) + step].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """(start, end) of each token in the text's bytes, one after another."""
        end = np.cumsum(self.size[ids])
        return np.stack((end - self.size[ids], end), 1)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id_col, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers in one binary value,
    decoded as the bytes those ids stand for; with ``offsets`` also each token's byte span as an array."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(ranks_path, pattern)
        for batch in batches:
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off):
                ids = list(K.of_rows(buf[off[i] : off[j]], off[i : j + 1] - off[i], codec.units))
                columns = [batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())]
                if offsets:
                    columns.append(pa.array([codec.offsets(x).tolist() for x in ids], pa.list_(pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded", "offsets"][: len(columns)])

    return source.mapInArrow(T.released(run), f"`{id_col}` {kind}, ids binary, decoded binary" + ", offsets array<array<bigint>>" * offsets)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ids as ``encode_decode`` writes them; null ids decode to no bytes."""

    @F.arrow_udf("binary")
    def back(ids: pa.Array) -> pa.Array:
        codec = Codec.get(ranks_path, pattern)
        body = b"".join(x.as_py() for x in ids)
        end = np.cumsum(codec.size[np.frombuffer(body, "<u4")])
        # tokens of the batch decoded at once; a row ends where its last token does
        last = np.cumsum([len(x.as_buffer()) // 4 for x in ids], dtype=np.int64)
        edge = np.concatenate(([0], end))[np.concatenate(([0], last))]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(codec.decode(np.frombuffer(body, "<u4")))])

    return encoded.withColumn("decoded", back(F.coalesce(F.col(ids_col), F.lit(b""))))


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``encode_decode``'s result, made in the JVM."""
    return coded.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
