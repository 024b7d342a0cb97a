"""Ranked lexical search: every document against every query, the best k of each.

``index`` reads blocks of documents and keeps of each the postings of its terms: documents in order, frequencies, and for
every segment of a long list its greatest frequency and shortest document, from which a bound of its contributions follows
for any collection. ``search`` asks all blocks. In a block it first sums the short lists of a query term by term into
accumulators; these stand in document order and are from then on one more iterator, whose bound is their greatest sum. Then
it goes through the documents in order, over that iterator and the long lists: only documents of iterators that could still
lift one above the k-th best score are candidates, the remaining lists are looked up for those candidates alone, best bound
first, and segments whose bounds do not suffice are passed over. The k-th best score is carried on from block to block of a task.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. Null and empty texts have no
terms and are not counted. Repeated rows are documents (or queries) of their own; rows without an id come last among equal
scores. Very long texts are a block of their own. Empty tables give no rows. Further columns are not looked at.
Terms are told apart by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import cut

#: Bytes of text in a block (a longer text is a block of its own), and queries that go to all blocks at once.
BLOCK, QUERIES = 16 << 20, 1_000
#: Postings of a segment, and documents that are looked at together.
SEGMENT, WINDOW = 128, 2048
#: Lists are summed into accumulators, shortest first, while together they are at most this share of a block's documents.
SHORT = 0.5

#: Bytes between terms: ASCII but for letters and digits.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_INT64 = (1 << 63) - 1


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term."""
    low = T.LOWER[buf]
    start, end, row = T.words(low, off, _GAP)
    return T.hashes(low, start, end), row


def index_block(ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch | None:
    """The postings of one block; none where no document has a term."""
    term, row = _terms(buf, off)
    if not len(term):
        return None
    n = np.bincount(row, minlength=len(off) - 1)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    order = np.lexsort((ids, ~known))
    order = order[n[order] > 0]
    place = np.zeros(len(n), dtype=np.int64)
    place[order] = np.arange(len(order))
    n = n[order]
    first, code = T.number(term)
    hashes = term[first]
    by_hash = np.argsort(hashes)
    rank = np.empty(len(by_hash), dtype=np.int64)
    rank[by_hash] = np.arange(len(by_hash))
    pair, tf = np.unique(rank[code] * len(n) + place[row], return_counts=True)
    which, doc = np.divmod(pair, len(n))
    df = np.bincount(which, minlength=len(hashes))
    begin = np.cumsum(df) - df
    long = np.flatnonzero(df > SEGMENT)
    parts = -(-df[long] // SEGMENT)
    edge = np.repeat(begin[long], parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    seg_tf, seg_n = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64)
    for k, (a, b) in enumerate(zip(edge.tolist(), np.minimum(edge + SEGMENT, np.repeat(begin[long] + df[long], parts)).tolist())):
        seg_tf[k], seg_n[k] = tf[a:b].max(), n[doc[a:b]].min()
    columns = [
        pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([T.pack(id_d=ids[order], known=known[order].astype(np.uint8), n=n.astype(np.uint32))], pa.binary()),
        pa.array([T.pack(hash_d=hashes[by_hash], df=df.astype(np.uint32))], pa.binary()), pa.array([T.pack(doc_d=doc, tf=tf.astype(np.uint32))], pa.binary()),
        pa.array([T.pack(tf=seg_tf.astype(np.uint32), n=seg_n.astype(np.uint32))], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "docs", "terms", "postings", "segments"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block: its documents with a term in order of their ids, and the postings of its terms in order of hashes."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off, BLOCK):
                out = index_block(batch.column(0).slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if out is not None:
                    yield out

    return source.mapInArrow(T.released(run), "n_docs long, n_terms long, docs binary, terms binary, postings binary, segments binary")


@dataclass(frozen=True)
class Collection:
    """What scores take from the whole collection: its documents with a term, all their terms, and each term's documents."""

    n_docs: int
    n_terms: int
    df: dict[int, int]

    def norm(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms, in integers of 64 bits while those suffice."""
        if len(n) and 25 * int(n.max()) * self.n_docs > _INT64:
            return np.array([75 + 25 * int(x) * self.n_docs // self.n_terms for x in n], dtype=np.int64)
        return 75 + 25 * n.astype(np.int64) * self.n_docs // self.n_terms

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * self.df[term] + 1)))


def _impact(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class _Block:
    """The postings of one block under the figures of the collection."""

    def __init__(self, docs: bytes, terms: bytes, postings: bytes, segments: bytes, whole: Collection):
        d, t, p, s = map(T.unpack, (docs, terms, postings, segments))
        self.ids, self.known = d["id_d"], d["known"].astype(bool)
        self.m = whole.norm(d["n"])
        self.hashes, df = t["hash_d"].astype(np.uint64), t["df"].astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(df)))
        self.doc, self.tf = p["doc_d"], p["tf"]
        parts = np.where(df > SEGMENT, -(-df // SEGMENT), 0)
        self.part = np.concatenate(([0], np.cumsum(parts)))
        self.seg_tf, self.seg_m = s["tf"], whole.norm(s["n"])

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, -1 where the block has none."""
        at = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
        return np.where(self.hashes[at] == terms, at, -1)


class _List:
    """A long list: an iterator in document order with a bound for all of it and one for each segment."""

    def __init__(self, block: _Block, k: int, weight: int):
        a, b = block.begin[k], block.begin[k + 1]
        self.doc, self._tf, self._m, self._weight = block.doc[a:b], block.tf[a:b], block.m, weight
        x, y = block.part[k], block.part[k + 1]
        if x < y:
            self.bounds = _impact(weight, block.seg_tf[x:y], block.seg_m[x:y])
        else:
            self.bounds = _impact(weight, self._tf.max(keepdims=True), block.m[self.doc].min(keepdims=True))
        self.bound = int(self.bounds.max())

    def span(self, low: int, high: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.doc, (low, high))
        return int(a), int(b)

    def bound_of(self, a: int, b: int) -> int:
        return int(self.bounds[a // SEGMENT : (b - 1) // SEGMENT + 1].max()) if a < b else 0

    def of(self, a: int, b: int) -> np.ndarray:
        return _impact(self._weight, self._tf[a:b], self._m[self.doc[a:b]])

    def at(self, where: np.ndarray) -> np.ndarray:
        return _impact(self._weight, self._tf[where], self._m[self.doc[where]])


class _Accumulators:
    """The summed short lists as one iterator."""

    def __init__(self, doc: np.ndarray, score: np.ndarray):
        order = np.argsort(doc, kind="stable")
        doc, score = doc[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] > doc[:-1])))
        self.doc, self.score = doc[first], np.add.reduceat(score, first)
        self.bound = int(self.score.max())

    span = _List.span

    def bound_of(self, a: int, b: int) -> int:
        return int(self.score[a:b].max()) if a < b else 0

    def of(self, a: int, b: int) -> np.ndarray:
        return self.score[a:b]

    def at(self, where: np.ndarray) -> np.ndarray:
        return self.score[where]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _best(block: _Block, found: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of the block's k best among those that score above 0 and at least ``least``: the k-th best score that
    is known so far. found: number and weight of each of the query's lists (those of a repeated term with its weight summed)."""
    found = sorted(found, key=lambda f: block.begin[f[0] + 1] - block.begin[f[0]])
    room, short = max(SEGMENT, int(SHORT * len(block.m))), 0
    while short < len(found) and (room := room - int(block.begin[found[short][0] + 1] - block.begin[found[short][0]])) >= 0:
        short += 1
    iterators: list = [_List(block, n, w) for n, w in found[short:]]
    if short:
        at = np.concatenate([np.arange(block.begin[n], block.begin[n + 1]) for n, _ in found[:short]])
        weight = np.repeat([w for _, w in found[:short]], [int(block.begin[n + 1] - block.begin[n]) for n, _ in found[:short]])
        doc = block.doc[at]
        iterators.append(_Accumulators(doc, _impact(weight, block.tf[at], block.m[doc])))
        least = max(least, _kth(iterators[-1].score, k))
    iterators.sort(key=lambda x: x.bound)
    upto = np.cumsum([x.bound for x in iterators])
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, len(block.m), WINDOW):
        essential = int(np.searchsorted(upto, max(least, 1)))  # those before it cannot reach the k-th best score together
        if essential == len(iterators):
            break
        high = min(low + WINDOW, len(block.m))
        spans = [x.span(low, high) for x in iterators]
        bounds = [x.bound_of(a, b) for x, (a, b) in zip(iterators, spans)]
        if sum(bounds) < max(least, 1):
            continue
        total, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for x, (a, b) in list(zip(iterators, spans))[essential:]:
            total[x.doc[a:b] - low] += x.of(a, b)
            seen[x.doc[a:b] - low] = True
        candidates = np.flatnonzero(seen)
        rest = sum(bounds[:essential])
        for n in range(essential - 1, -1, -1):
            candidates = candidates[total[candidates] + rest >= max(least, 1)]
            rest -= bounds[n]
            a, b = spans[n]
            if not len(candidates) or a == b:
                continue
            x = iterators[n]
            where = np.minimum(a + np.searchsorted(x.doc[a:b], candidates + low), b - 1)
            met = x.doc[where] == candidates + low
            total[candidates[met]] += x.at(where[met])
        candidates = candidates[total[candidates] >= max(least, 1)]
        docs, scores = np.concatenate((docs, candidates + low)), np.concatenate((scores, total[candidates]))
        if len(docs) > k:
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
        least = max(least, _kth(scores, k))
    return docs, scores


@dataclass(frozen=True)
class _Query:
    number: int
    terms: np.ndarray
    times: np.ndarray


def _batch(rows: list) -> list[_Query]:
    out = []
    for row in rows:
        raw = np.frombuffer((row["text"] or "").encode(), np.uint8)
        terms, times = np.unique(_terms(raw, np.array([0, len(raw)]))[0], return_counts=True)
        out.append(_Query(row["number"], terms, times))
    return out


def _document_counts(blocks: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the given terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                t = T.unpack(batch.column(0)[k].as_py())
                hashes = t["hash_d"].astype(np.uint64)
                at = np.minimum(np.searchsorted(hashes, vocabulary), len(hashes) - 1)
                total += np.where(hashes[at] == vocabulary, t["df"][at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    rows = blocks.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {int(vocabulary[r["term"]]): int(r["df"]) for r in rows}


def _ask(blocks: DataFrame, queries: list[_Query], whole: Collection, k: int) -> DataFrame:
    """(number, id, score): of every task the k best documents of each query."""
    known = []
    for q in queries:
        own = [(t, c * whole.weight(t)) for t, c in zip(q.terms.tolist(), q.times.tolist()) if t in whole.df]
        known.append((q.number, np.array([t for t, _ in own], np.uint64), [w for _, w in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {number: (none, none, np.zeros(0, bool)) for number, _, _ in known}  # scores, ids, whether there is an id
        for batch in batches:
            for n in range(batch.num_rows):
                block = _Block(*(batch.column(c)[n].as_py() for c in range(4)), whole)
                for number, terms, weights in known:
                    found = [(int(at), w) for at, w in zip(block.lists(terms), weights) if at >= 0 and w]
                    if not found:
                        continue
                    score, ids, has = best[number]
                    docs, scores = _best(block, found, k, _kth(score, k))
                    score, ids, has = np.concatenate((score, scores)), np.concatenate((ids, block.ids[docs])), np.concatenate((has, block.known[docs]))
                    order = np.lexsort((ids, ~has, -score))[:k]
                    best[number] = score[order], ids[order], has[order]
        for number, (score, ids, has) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number)), pa.array(ids, mask=~has), pa.array(score)], ["number", "id", "score"])

    return blocks.select("docs", "terms", "postings", "segments").mapInArrow(T.released(run), "number long, id long, score long")


def search(blocks: DataFrame, queries: DataFrame, k: int = 20, query_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_col, rank, doc_id, score): the k documents of an index with the highest scores above 0 for every query, equal ones
    by id. Queries are read in batches of QUERIES, so neither the driver nor a task holds more of them."""
    spark = queries.sparkSession
    slim = queries.select(F.col(query_col).alias("query"), F.col(text_col).alias("text"))
    asked = cut(slim.groupBy("query", "text").agg(F.count("*").alias("times")).withColumn("number", F.monotonically_increasing_id()))
    size = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = spark.createDataFrame([], "number long, id long, score long")
    last = -1
    while rows := asked.filter(F.col("number") > last).orderBy("number").limit(QUERIES).select("number", "text").collect():
        last = rows[-1]["number"]
        batch = _batch(rows)
        vocabulary = np.unique(np.concatenate([q.terms for q in batch]))
        if len(vocabulary) and size[0]:
            whole = Collection(size[0], size[1], _document_counts(blocks, vocabulary))
            found = found.unionByName(_ask(blocks, batch, whole, k))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = ranked.join(asked.drop("text"), "number").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(F.col("query").alias(query_col), "rank", F.col("id").alias("doc_id"), "score")
