"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments; its embedding is the number of set bits in each. The Manhattan
distance of two embeddings is never more than the fingerprints' Hamming distance, so fingerprints within two
bits have embeddings within two steps, and then some grid point is within one step of both. Each distinct
fingerprint goes to its own grid point and the 32 next to it; fingerprints that meet at a point are compared
exactly. A point sends on a spanning forest of its links, not all pairs, and never sees a copy: equal
fingerprints are one node.

Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows each give a row and
share a component. A null id never becomes a component's id unless all its ids are null. Further columns are
not looked at. A bit in exactly half of a text's hashes is not set. Very long texts are hashed whole. Empty input gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._graph import components
from ._store import cut

SEGMENTS, WIDTH = 16, 4
#: Members of a grid point from which exact comparison goes by shared thirds of the fingerprint first.
CROWDED = 64
_THIRDS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit k is set if it is in over half of the XXH64 (seed 42) hashes of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate(([0], end))[:n].tolist()
    last = (end[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp) of every row; fp is the fingerprint as a signed long."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "text")
            out: list[int] = []
            for i, j in T.slices(off):
                raw, rows = buf[off[i] : off[j]].tobytes(), (off[i : j + 1] - off[i]).tolist()
                out += [fingerprint(raw[a:b], shingle) for a, b in zip(rows, rows[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], [id_col, "fp"])

    return source.mapInArrow(T.released(run), f"`{id_col}` {kind}, fp long")


def grid_points(fp: str = "fp") -> list:
    """The embedding of a fingerprint, packed three bits a segment (each count plus one), and its 32 neighbours."""
    counts = [F.bit_count(F.shiftrightunsigned(F.col(fp), WIDTH * k).bitwiseAND(F.lit(15))) + 1 for k in range(SEGMENTS)]
    own = sum((F.shiftleft(c.cast("long"), 3 * k) for k, c in enumerate(counts[1:], 1)), counts[0].cast("long"))
    steps = [0, *(1 << 3 * k for k in range(SEGMENTS)), *(-(1 << 3 * k) for k in range(SEGMENTS))]
    return [own.alias("own"), F.array(*[F.lit(s).cast("long") for s in steps]).alias("steps")]


def close_pairs(group: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within a group (equal values, side by side) whose fingerprints differ in at most ``most`` bits."""
    left, right = [], []

    def walk(where: np.ndarray, key: np.ndarray) -> None:
        f = fp[where]
        live, step = np.arange(len(where)), 1
        while True:
            live = live[live < len(where) - step]
            live = live[key[live] == key[live + step]]
            if not len(live):
                return
            near = np.bitwise_count(f[live] ^ f[live + step]) <= most
            left.append(where[live[near]])
            right.append(where[live[near] + step])
            step += 1

    number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    crowded = np.bincount(number)[number] > CROWDED
    walk(np.flatnonzero(~crowded), number[~crowded])
    if crowded.any():
        where = np.flatnonzero(crowded)
        for shift, bits in _THIRDS:
            part = (fp[where] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            order = np.lexsort((part, number[where]))
            key = T.number(T.mix(part[order] ^ T.mix(number[where][order].astype(np.uint64))))[1]
            walk(where[order], key)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, left, low[right])
        np.minimum.at(new, right, low[left])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links(nodes: DataFrame, most: int = 2) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``fp`` of ``nodes``: they join exactly those fingerprints that a
    chain of steps of at most ``most`` (2 or less) bits joins."""
    if most > 2:
        raise ValueError("the grid holds links of at most two bits")
    points = nodes.select("fp", *grid_points()).select("fp", "own", F.explode("steps").alias("step")).select("fp", (F.col("own") + F.col("step")).alias("point"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fp: np.ndarray, point: np.ndarray) -> pa.RecordBatch:
            low = forest(len(fp), *close_pairs(point, fp.view(np.uint64), most))
            tied = np.flatnonzero(low != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[low[tied]])], ["a", "b"])

        held = np.zeros((2, 0), dtype=np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(k).to_numpy() for k in (0, 1)])), axis=1)
            whole = int(np.searchsorted(held[1], held[1, -1])) if held.shape[1] else 0
            if whole >= 50_000:
                yield linked(held[0, :whole], held[1, :whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield linked(held[0], held[1])

    met = points.repartition("point").sortWithinPartitions("point", "fp")
    return met.mapInArrow(T.released(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as 16 hexadecimal digits, component_id) of every row: component_id is the least id that
    links of at most ``most`` differing bits reach, the row's own included."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(nodes, most)).withColumnRenamed("node", "fp")
    rooted = cut(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

#: Sampled fingerprints of a text, and shingles in each: a pair of similarity 0.8 shares none of them one time in 200.
SAMPLES, SAMPLED = 8, 3
_SALTS = T.mix(np.arange(1, SAMPLES + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each row's word shingles (A-Z lower-cased); fewer words are one shingle, none are none."""
    low = T.LOWER[buf]
    start, end, row = T.words(low, off)
    prefix = T.Prefix(T.word_hashes(low, start, end))
    edge = np.searchsorted(row, np.arange(len(off)))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        first = np.arange(a, max(b - shingle + 1, min(a + 1, b)))
        out.append(np.unique(T.mix(prefix.of(first, np.minimum(first + shingle, b)))))
    return out


def sampled_fingerprints(shingles: np.ndarray) -> list[int]:
    """Fingerprints of SAMPLES consistent samples: of the SAMPLED shingles with the least salted hashes, bit by bit
    what more than half of them have."""
    if not len(shingles):
        return [0] * SAMPLES
    out = []
    for salt in _SALTS:
        h = T.mix(shingles ^ salt)
        least = np.sort(np.partition(h, SAMPLED - 1)[:SAMPLED]) if len(h) > SAMPLED else np.resize(np.sort(h), SAMPLED)
        a, b, c = least
        out.append(int((a & b) | (a & c) | (b & c)))
    return out


#: Rows, about, whose shingles tell which are common; common shingles held at most; rows of a sample with a common one.
#: These order the shingles and so decide only how many pairs are compared, not which are found.
ORDER_ROWS, COMMON, COMMON_FROM = 20_000, 50_000, 4
#: Members of a set for each of which its prefix is longer by one: near copies then share as many more, texts that have
#: just a passage in common do not.
SPARE = 20
#: Bits of a set's parities.
PARITIES = 1024
#: Pairs whose sets are in memory at a time.
COMPARED = 500
#: Texts to compare whose keys may be broadcast; more are joined by shuffling.
BROADCAST_TEXTS = 100_000
#: Pairs for each row of a shared shingle up to which all are compared at once, without rounds of central texts first.
PAIRS_A_ROW = 4


def common_shingles(base: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that many of some rows of ``base`` (id, text_key, text) have, by hash."""
    n = base.count()
    some = base.filter(F.pmod(F.xxhash64("id", "text_key"), F.lit(1_000_000)) < 1_000_000 * ORDER_ROWS / max(1, n)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                values, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count)], ["h", "n"])

    top = some.mapInArrow(T.released(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r[1] for r in top], dtype=np.int64)[order]


def prefix_of(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The rarest shingles of a sorted set, rarest first (hashes settle ties): so many that two sets at least as similar as
    ``similarity`` have one in common, and one more for every SPARE members of the smaller one; and how many of them are not
    among the common ones."""
    n = len(shingles)
    if not n:
        return shingles, 0
    at = np.minimum(np.searchsorted(common[0], shingles), max(0, len(common[0]) - 1))
    count = np.where(common[0][at] == shingles, common[1][at], 0) if len(common[0]) else np.zeros(n, np.int64)
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1 + n // SPARE
    return shingles[np.lexsort((shingles, count))][:size], min(size, int((count == 0).sum()))


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITIES bits: each shingle falls on one and turns it over. Two sets differ in at least as many members as these
    bits differ."""
    place = (T.mix(shingles ^ _SALTS[0]) >> np.uint64(40)).astype(np.int64) % PARITIES
    return np.packbits(np.bincount(place, minlength=PARITIES).astype(np.uint8) & 1, bitorder="little").view("<i8")


def _classes(roots: DataFrame) -> DataFrame:
    """(no, root): the class of each text that is not its root, by hashes."""
    return roots.select(F.xxhash64("node").alias("no"), F.xxhash64("root").alias("root"))


def _rooted(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "no", "left").withColumn("root", F.coalesce("root", "no"))


def enough(live: DataFrame, similarity: float) -> DataFrame:
    """``live`` without the texts that have too few shared shingles for a near copy of any length. A text has as many rows
    as its prefix is long."""
    least = F.floor(F.ceil(F.col("n") * similarity - 1e-9) / SPARE) + 1
    return live.withColumn("_shared", F.count("*").over(Window.partitionBy("no"))).filter(F.col("_shared") >= least).drop("_shared")


def shared_shingles(rows: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(no, n, place, shingle) of the prefix shingles that texts of different classes have. no, a hash, stands for the text
    (texts of equal hashes both come back later). The rows of a common shingle stay where they are, so none meet in a task."""
    classes = _classes(roots)
    if classes.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        classes = F.broadcast(classes)
    found = _rooted(rows.filter("size(prefix) > 0").select(F.xxhash64("text_key").alias("no"), "n", "rare", "prefix"), classes)
    posts = found.select("no", "root", "n", "rare", F.posexplode("prefix").alias("place", "shingle"))
    several = lambda df: df.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("shingle")
    seldom = posts.filter("place < rare").drop("rare").repartition("shingle")
    common = posts.filter("place >= rare").drop("rare")
    # there are at most COMMON common shingles
    kept = seldom.join(several(seldom).hint("merge"), "shingle").unionByName(common.join(F.broadcast(several(common)), "shingle"))
    return enough(kept, similarity).select("no", "n", "place", "shingle")


def crossing(live: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, int, int]:
    """``live`` where a shingle still has texts of different classes, with root; its rows; its pairs across classes."""
    each = _rooted(live.select("no", "n", "place", "shingle"), _classes(roots))
    groups = each.groupBy("shingle", "root").count().groupBy("shingle").agg(F.sum("count").alias("size"), F.sum(F.col("count") * F.col("count")).alias("inner"))
    groups = groups.withColumn("across", (F.col("size") * F.col("size") - F.col("inner")) / 2).filter("across > 0")
    now = cut(enough(each.join(groups.select("shingle", "size", "across"), "shingle"), similarity))
    n = now.select(F.count("*"), F.coalesce(F.sum(F.col("across") / F.col("size")), F.lit(0.0))).first()
    return now, n[0], int(round(n[1]))


def central_pairs(live: DataFrame, similarity: float) -> DataFrame:
    """(x, y): each text with the most central text of each of its shared shingles, where their classes differ."""
    score = live.groupBy("no").agg(F.sum("size").alias("score"))
    scored = live.join(score, "no")
    best = scored.groupBy("shingle").agg(F.max(F.struct("score", "no", "n", "root")).alias("c"))
    met = live.join(best, "shingle").filter("root <> c.root and least(n, c.n) >= {t}D * greatest(n, c.n) - 1e-9D".format(t=similarity))
    return met.select(F.least("no", "c.no").alias("x"), F.greatest("no", "c.no").alias("y")).distinct()


def allowed_pairs(live: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """(x, y): all pairs of texts of different classes that can be near copies by their lengths, by the places of a shared
    shingle (it can be their first one in common only if enough others follow it in both) and by their parities."""
    words = [f"b{k}" for k in range(PARITIES // 64)]
    both = live.select("no", "n", "place", "shingle", "root").join(bits.select(F.xxhash64("text_key").alias("no"), *[F.col("bits")[k].alias(w) for k, w in enumerate(words)]).dropDuplicates(["no"]), "no")
    x, y = both.alias("x"), both.alias("y")
    need = f"ceil({similarity / (1 + similarity)!r}D * (x.n + y.n) - 1e-9D)"
    apart = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in words)
    rule = f"x.no < y.no and x.root <> y.root and x.place + {need} <= x.n and y.place + {need} <= y.n and {apart} <= {(1 - similarity) / (1 + similarity)!r}D * (x.n + y.n) + 1e-9D"
    return x.join(y, F.expr(f"x.shingle = y.shingle and {rule}")).select(F.col("x.no").alias("x"), F.col("y.no").alias("y")).distinct()


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, keep_id, keep_key) of every row: the rows of a class of copies and near copies name the same row to
    keep, the one with the least id. text_key is the MD5 of the text.

    Two texts are near copies if the Jaccard similarity of their sets of word shingles, computed exactly, is at least
    ``similarity``; classes are closed under that. Copies are one node. Most classes come from cheap pairs: whole
    fingerprints within two bits, by the grid, and the ends of each set of equal fingerprints of consistent samples.
    The rest comes from a prefix filter: near copies share one of their rarest shingles, so texts of different classes
    that share one are compared, first with the text of each such group that shares most (which takes up a class around
    one original without comparing its members in pairs), then all pairs that lengths and places still allow.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    common = common_shingles(base, shingle)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # a task gives the shingles of equal texts once
        for batch in batches:
            buf, off = T.column(batch, "text")
            keys = batch.column(1).to_pylist()
            whole, parts, size, same, prefix, rare, bits = [], [], [], [], [], [], []
            for i, j in T.slices(off):
                rows = off[i : j + 1] - off[i]
                raw, at = buf[off[i] : off[j]].tobytes(), rows.tolist()
                whole += [fingerprint(raw[a:b], shingle) for a, b in zip(at, at[1:])]
                for key, s in zip(keys[i:j], shingle_sets(buf[off[i] : off[j]], rows, shingle)):
                    parts.append(sampled_fingerprints(s))
                    size.append(len(s))
                    same.append(int(np.bitwise_xor.reduce(T.mix(s))) if len(s) else 0)
                    first, k = prefix_of(s if key not in seen else s[:0], similarity, common)
                    seen.add(key)
                    prefix.append(first.view(np.int64))
                    rare.append(k)
                    bits.append(parities(s))
            first = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * (PARITIES // 64), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bits])))
            fps = pa.array(np.array(parts, dtype=np.uint64).view(np.int64).reshape(-1, SAMPLES).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(whole, np.uint64).view(np.int64)), fps, pa.array(size, pa.int64()), pa.array(np.array(same, np.uint64).view(np.int64)), first, pa.array(rare, pa.int32()), flat],
                ["id", "text_key", "fp", "fps", "n", "whole", "prefix", "rare", "bits"],
            )

    rows = cut(base.mapInArrow(T.released(sketch), "id long, text_key string, fp long, fps array<long>, n long, whole long, prefix array<long>, rare int, bits array<long>"))
    texts = rows.groupBy("text_key").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("fps").alias("fps"), F.first("n").alias("n"), F.first("whole").alias("whole"))
    texts = cut(texts)
    member = texts.select("text_key", F.posexplode("fps").alias("sample", "fp"))
    ends = member.groupBy("sample", "fp").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low < high")
    near = member.join(ends, ["sample", "fp"])
    by_set = texts.groupBy("n", "whole").agg(F.min("text_key").alias("low"))
    by_fp = texts.groupBy("fp").agg(F.min("text_key").alias("low"))
    whole = links(by_fp.select("fp"), 2)
    grid = whole.join(by_fp.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    pairs = (
        near.select("text_key", F.col("low").alias("other"))
        .union(near.select("text_key", F.col("high").alias("other")))
        .union(texts.join(by_fp, "fp").select("text_key", F.col("low").alias("other")))
        .union(texts.join(by_set, ["n", "whole"]).select("text_key", F.col("low").alias("other")))
        .union(grid.select("x", "y"))
        .filter("text_key <> other")
        .select(F.least("text_key", "other").alias("a"), F.greatest("text_key", "other").alias("b"))
        .distinct()
    )
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, COMPARED):
                part = batch.slice(k, COMPARED)
                close = []
                for x, y in zip(*[shingle_sets(*T.column(part, c), shingle) for c in ("left", "right")]):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    close.append(both >= similarity * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        needed = cut(pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct().join(texts.select("text_key", "id"), "text_key"))
        if needed.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
            needed = F.broadcast(needed)
        body = base.withColumnRenamed("id", "own").join(needed, "text_key").filter(F.col("own").eqNullSafe(F.col("id"))).select("text_key", "text")
        left = body.select(F.col("text_key").alias("a"), F.col("text").alias("left"))
        right = body.select(F.col("text_key").alias("b"), F.col("text").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(T.released(compare), "a string, b string")

    def named(pairs: DataFrame) -> DataFrame:
        key = texts.select(F.xxhash64("text_key").alias("no"), "text_key")
        x, y = (key.select(F.col("no").alias(c), F.col("text_key").alias(f"{c}_key")) for c in ("x", "y"))
        return pairs.join(x, "x").join(y, "y").select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b"))

    roots = cut(components(verified(pairs)))
    live = cut(shared_shingles(rows, roots, similarity))
    least_pairs = None
    while True:
        live, n_rows, n_pairs = crossing(live, roots, similarity)
        last = n_pairs <= PAIRS_A_ROW * n_rows or (least_pairs is not None and n_pairs > 0.75 * least_pairs)
        if n_pairs:
            edges = verified(named(allowed_pairs(live, rows, similarity) if last else central_pairs(live, similarity)))
            roots = cut(components(edges.union(roots.select("node", "root"))))
        if last:
            break
        least_pairs = n_pairs
    roots = roots.withColumnRenamed("node", "text_key")
    rooted = cut(texts.join(roots, "text_key", "left").select("text_key", "id", F.coalesce("root", "text_key").alias("root")))
    keep = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("keep"))
    classes = rooted.join(keep, "root").select("text_key", F.col("keep.id").alias("keep_id"), F.col("keep.text_key").alias("keep_key"))
    return rows.select("id", "text_key").join(classes, "text_key")
