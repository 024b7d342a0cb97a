"""Best-fit packing of token pieces into sequences, with certified bin counts.

Every partition packs its pieces by best-fit decreasing and computes a lower bound from dual-feasible
functions. A partition whose bin count meets the bound is certified: no packing of its pieces has fewer
bins. Partitions with a gap keep their full bins, send the pieces of the others to a common partition and
rerun best-fit decreasing there; the rerun is taken where it saves bins, else the old bins stay. What is
exchanged are (id, piece, start, length) rows, never ids or texts.

Null and empty texts have one piece with the closing id alone. A very long text has many pieces, all but the first full.
Of equally long pieces the earlier one of a partition is placed first, of equally full bins any takes it: which sequence
a piece is in may vary, the number of sequences does not. Repeated rows are packed each. Empty input gives an empty
result. Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import _tokens as K
from ._store import cut, shards

#: Pieces that a partition of a later round may hold at most, on average.
PIECES_A_PARTITION = 100_000
#: Rounds of exchange at most; the last keeps what it has.
ROUNDS = 3

_loaded: dict = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, ids) of every document: its ids and ``end_id``, as little-endian unsigned 32-bit
    integers. Only longer ones are cut, into pieces of ``capacity``; the first takes the odd length."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = K.id_bytes(K.from_file(tokenizer_path))
        units, end = _loaded[tokenizer_path], np.array([end_id], dtype="<u4")
        for batch in batches:
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off):
                row, piece, start, ids = [], [], [], []
                for r, x in enumerate(K.of_rows(buf[off[i] : off[j]], off[i : j + 1] - off[i], units)):
                    x = np.append(x, end)
                    first = (len(x) - 1) % capacity + 1
                    edges = [0, *range(first, len(x) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(i + r), piece.append(k), start.append(a), ids.append(x[a:b].tobytes())
                key = batch.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([key, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], [id_col, "piece", "start", "ids"])

    return source.mapInArrow(T.released(run), f"`{id_col}` {kind}, piece int, start long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    U(e) sends lengths over capacity - e to a whole bin and lengths under e to nothing; u(k) rounds
    (k + 1) * length / capacity down, but for exact multiples, and divides by k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = 0
    number, total = np.cumsum(count), np.cumsum(count * size)
    for e in range(capacity // 2 + 1):
        large = number[-1] - number[capacity - e]
        middle = total[capacity - e] - (total[e - 1] if e else 0)
        best = max(best, int(large + -(-middle // capacity)))
    for k in range(1, 33):
        whole = (k + 1) * size
        value = np.where(whole % capacity == 0, size * k, whole // capacity * capacity)
        best = max(best, int(-(-(value * count).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length: the fullest one that still has room, longest pieces first."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    made = 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, left = made, capacity - n
            made += 1
        else:
            r = rooms[k]
            b, left = room[r].pop(), r - n
            if not room[r]:
                rooms.pop(k)
        bins[at] = b
        if left:
            if not room[left]:
                insort(rooms, left)
            room[left].append(b)
    return bins


def _pack(length: np.ndarray, old: np.ndarray | None, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, int, int, np.ndarray]:
    """One partition of one round: (bin, offset) of its pieces, its lower bound and bins, and which pieces are to be
    exchanged. old: the bins of the round before, kept where the rerun does not save any."""
    bins, bound = best_fit_decreasing(length, capacity), lower_bound(length, capacity)
    if old is not None and old.max() <= bins.max():
        bins = old
    made = int(bins.max()) + 1
    full = np.bincount(bins, weights=length)[bins] == capacity
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    head = np.concatenate(([True], np.diff(bins[order]) > 0))
    offset = np.empty(len(length), dtype=np.int64)
    offset[order] = before - np.repeat(before[head], np.diff(np.append(np.flatnonzero(head), len(length))))
    return bins, offset, bound, made, ~full & (made > bound) & (not last)


def pack(pieces: DataFrame, capacity: int = 1024, partitions: int | None = None) -> DataFrame:
    """``pieces`` (any columns, with a long ``length`` of 1 to ``capacity``) with sequence_id, offset, and of the
    partition that packed them: lower_bound, bins, certified (they are equal)."""
    spark = pieces.sparkSession
    own = pieces.columns
    names = {c: f"c{k}" for k, c in enumerate(own)}
    pieces = cut(pieces.select(*[F.col(f"`{c}`").alias(names[c]) for c in own], F.col("length").alias("length")))
    full = pieces.filter(F.col("length") == capacity).select(
        *names.values(), (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("lower_bound"), F.lit(1).cast("long").alias("bins"),
    )
    todo = pieces.filter(F.col("length") < capacity)
    deal = [F.pmod(F.xxhash64(*names.values()), F.lit(1 << 30)).cast("int").alias("key"), "*"]
    n = 0 if partitions else todo.count()
    count = partitions or max(1, min(max(shards(spark, 0), n // PIECES_A_PARTITION), n // 2000))
    done, before = [full], 1
    for turn in range(ROUNDS + 1):
        last, few = turn == ROUNDS or count == 1, count
        dealt = todo.select(*deal) if turn == 0 else todo.withColumn("key", F.floor(F.col("part") * few / before).cast("int"))
        carried = [f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names.values()]

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            parts = [x for x in batches if x.num_rows]
            if parts:
                table = pa.Table.from_batches(parts).combine_chunks()
                length = table.column("length").to_numpy()
                old = None
                if "part" in table.column_names:
                    old = T.number(table.column("part").to_numpy().astype(np.int64) * (1 << 32) + table.column("bin").to_numpy())[1]
                bins, offset, bound, made, is_open = _pack(length, old, capacity, last)
                n = len(length)
                more = [np.full(n, TaskContext.get().partitionId(), np.int32), bins.astype(np.int64), offset, np.full(n, bound), np.full(n, made), is_open]
                own = table.select([*names.values(), "length"])
                yield from pa.Table.from_arrays([*own.columns, *map(pa.array, more)], [*own.column_names, "part", "bin", "offset", "bound", "made", "open"]).to_batches(max_chunksize=20_000)

        schema = ", ".join([*carried, "length long, part int, bin long, offset long, bound long, made long, open boolean"])
        packed = cut(dealt.repartition(few, "key").drop("key").mapInArrow(T.released(run), schema))
        settled = packed.filter(~F.col("open")).select(
            *names.values(), (F.lit(turn << 58) + F.col("part").cast("long") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset",
            F.col("bound").alias("lower_bound"), F.col("made").alias("bins"),
        )
        done.append(settled)
        todo = packed.filter("open").select(*names.values(), "length", "part", "bin")
        left = 0 if last else todo.count()
        if not left:
            break
        before = packed.agg(F.max("part")).first()[0] + 1
        count = max(1, min(before // 4, left // PIECES_A_PARTITION + 1))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "sequence_id", "offset", "lower_bound", "bins", (F.col("lower_bound") == F.col("bins")).alias("certified"))
