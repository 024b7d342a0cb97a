"""Token counts without ids.

A text is a bag of pre-tokens (white-space marks and the characters after them, which no piece of the model
crosses). Texts are read in blocks, each kept as its distinct pre-tokens and the frequencies of these in every
document. Shards of the hash range meet the pre-tokens of all blocks, count the pieces of each distinct one once,
and answer in the order asked; answers join their block's frequencies and are summed for each document. A frequent
pre-token is one entry a block, so no shard grows with its frequency.

Null and empty texts have no tokens. Repeated rows each give a row; further columns are not looked at. A very long text
is a block of its own, cut where no piece can cross. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import _tokens as K
from ._store import cut, shards

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK = 16 << 20
#: Pre-tokens that go to the model in one call.
CALL = 20_000

_loaded: dict = {}


def _pieces(model_path: str) -> Callable[[list[bytes]], np.ndarray]:
    """Counts of pieces by a SentencePiece model that puts a space before each text it is given: so one space of a
    pre-token that begins with one is left to the model."""
    if model_path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        mark = model.piece_to_id("▁")
        alone = 1 if not model.is_unknown(mark) else len(model.encode("  ")) - 1

        def count(units: list[bytes]) -> np.ndarray:
            out = np.zeros(len(units), dtype=np.uint32)
            for k in range(0, len(units), CALL):
                part = units[k : k + CALL]
                out[k : k + CALL] = [len(ids) if u else alone for u, ids in zip(part, model.encode([u.decode() for u in part], num_threads=1))]
            return out

        _loaded[model_path] = count
    return _loaded[model_path]


def pre_token_frequencies(buf: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, and for each pair of row and pre-token in it: row, pre-token's number, frequency)."""
    start = T.pre_chunks(buf, off, only_spaces=True)
    if not len(start):
        none = np.zeros(0, np.int64)
        return [], none, none, none
    row = np.searchsorted(off, start, "right") - 1
    inner = ~np.isin(start, off[:-1])  # the model adds this space itself
    units, which = K.distinct(buf, start, inner.astype(np.int64))
    pair, times = np.unique(row * len(units) + which, return_counts=True)
    return units, pair // len(units), pair % len(units), times


def _pack_units(units: list[bytes]) -> list[pa.Array]:
    sizes = T.pack(size=np.fromiter(map(len, units), np.uint32, len(units)))
    return [pa.array([sizes], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(units))], pa.binary())]


def _unpack_units(sizes: bytes, body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    end = np.cumsum(T.unpack(sizes)["size"], dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *end], end)]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a block: ids and bytes of its documents, its distinct pre-tokens by hash, and their frequencies."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off, BLOCK):
                units, row, which, times = pre_token_frequencies(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                place = np.fromiter(map(crc32, units), np.uint32, len(units))
                order = np.argsort(place, kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                key = row * len(units) + rank[which]  # small steps once sorted
                by_key = np.argsort(key)
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().int >> 65], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.array(np.diff(off[i : j + 1]))),
                        pa.array([len(units)], pa.int64()),
                        *_pack_units([units[k] for k in order.tolist()]),
                        pa.array([T.pack(place_d=place[order])], pa.binary()),
                        pa.array([T.pack(key_d=key[by_key], times=times[by_key].astype(np.uint32))], pa.binary()),
                    ],
                    ["block", "ids", "sizes", "n_units", "unit_sizes", "units", "places", "frequencies"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"block long, ids array<{kind}>, sizes array<bigint>, n_units long, unit_sizes binary, units binary, places binary, frequencies binary")


def _ask(blocks: DataFrame, n: int) -> DataFrame:
    """Each block's distinct pre-tokens, dealt to n shards of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, sizes, body, places = (batch.column(c)[k].as_py() for c in range(4))
                units = _unpack_units(sizes, body)
                edge = np.searchsorted(T.unpack(places)["place_d"].astype(np.uint64) * np.uint64(n) >> np.uint64(32), np.arange(n + 1).astype(np.uint64)).tolist()
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = edge[s], edge[s + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.int64()), *_pack_units(units[a:b])], ["shard", "block", "unit_sizes", "units"])

    return blocks.select("block", "unit_sizes", "units", "places").mapInArrow(run, "shard int, block long, unit_sizes binary, units binary")


def _answer(model_path: str) -> Callable[[pa.Table], pa.Table]:
    """One shard: the pieces of each distinct pre-token of all blocks, counted once, in the order each block asked."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_unpack_units(a.as_py(), b.as_py()) for a, b in zip(table.column("unit_sizes"), table.column("units"))]
        number: dict[bytes, int] = {}
        which = [np.array([number.setdefault(u, len(number)) for u in units], dtype=np.int64) for units in asked]
        pieces = _pieces(model_path)(list(number))
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "pieces": pa.array([T.pack(n=pieces[w]) for w in which], pa.binary())})

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row, as the model's own library counts whole texts."""
    blocks = cut(_read(docs, id_col, text_col))
    n_bytes = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    answers = _ask(blocks, shards(docs.sparkSession, n_bytes)).groupBy("shard").applyInArrow(_answer(model_path), "block long, shard int, pieces binary")

    def join(block: pa.Table, answer: pa.Table) -> pa.Table:
        ids, sizes = (block.column(c).combine_chunks().flatten() for c in ("ids", "sizes"))
        f = T.unpack(block.column("frequencies")[0].as_py())
        order = np.argsort(answer.column("shard").to_numpy()).tolist()
        pieces = np.concatenate([np.zeros(0, np.int64), *[T.unpack(answer.column("pieces")[k].as_py())["n"] for k in order]])
        if len(pieces) != block.column("n_units")[0].as_py():
            raise RuntimeError("a block's answers are incomplete")
        row, which = np.divmod(f["key_d"], max(1, len(pieces)))
        total = np.zeros(len(ids), dtype=np.int64)
        np.add.at(total, row, f["times"] * pieces[which])
        return pa.table({id_col: ids, "n_bytes": sizes, "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)})

    joined = blocks.select("block", "ids", "sizes", "n_units", "frequencies").groupBy("block").cogroup(answers.groupBy("block"))
    return joined.applyInArrow(join, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
