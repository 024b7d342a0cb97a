"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after its predecessor, of the word alone, and a uniform
share; the weights depend on a bucket of how often the predecessor was counted, and are learned by
expectation-maximisation on held-out counts: a fifth of the training documents (remainder 4) is left out of the
counts, and the weights that explain it best are used with the counts of all training documents.

Corpus counts never meet in one place. Texts are read in blocks; each block asks, shard by shard of the hash
range, for the counts of its distinct words and word pairs, and adds its own at the same time. Shards sum and
answer in the order asked. A frequent pair is one entry a block. The answers make each token a triple of counts;
EM sees them as a histogram over logarithmic steps, whose size the number format bounds.

Null and empty texts are one end token. A null id is not learned from (held_out). Repeated rows count and are
scored each. Without training documents every token is unknown and gets the uniform share. Columns other than
the named ones are not looked at. A very long text is a block of its own. Equal texts with equal ids get equal
scores; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import cut, shards

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK = 8 << 20
#: Remainders of crc32(id as text) modulo FOLDS.
FOLDS, HELD_OUT, TUNE = 5, 1, 4
#: Buckets of context counts: 0, 1, 2-3, 4-7, ...
BUCKETS = 24
#: Steps of the histogram in a doubling.
STEPS = 4
_NEVER = -10_000
_HALF = np.uint64(1)
_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)


def _half(h: np.ndarray) -> np.ndarray:
    """Hashes as positive signed numbers."""
    return (h >> _HALF).astype(np.int64)


def _shard_edges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    shard = ((sorted_hashes.astype(np.uint64) >> np.uint64(31)) * np.uint64(n)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(n + 1).astype(np.uint64))


def _block(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct token hashes, each token's number among them, tokens of each row), with end tokens."""
    low = T.LOWER[buf]
    start, end, row = T.words(low, off)
    rows = len(off) - 1
    n = np.bincount(row, minlength=rows) + 1
    tokens = np.full(n.sum(), _half(np.array([_END]))[0], dtype=np.int64)
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[np.cumsum(n) - 1] = False
    tokens[is_word] = _half(T.word_hashes(low, start, end))
    words, code = np.unique(tokens, return_inverse=True)
    return words, code, n


def _pairs(words: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of neighbouring tokens, each token's pair among them)."""
    h = words[code].astype(np.uint64)
    before = np.concatenate(([_BEGIN], h[:-1]))
    before[np.cumsum(n) - n] = _BEGIN
    return np.unique(_half(T.mix(before * T.BASE + T.mix(h))), return_inverse=True)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fold = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)), F.lit(HELD_OUT)).cast("int")
    source = docs.select(F.col(id_col).cast("long").alias("id"), fold.alias("fold"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fold = batch.column(0), batch.column(1).to_numpy()
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off, BLOCK):
                words, code, n = _block(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                rows = T.pack(id_d=ids[i:j], known=known[i:j].astype(np.uint8), fold=fold[i:j].astype(np.uint8), n=n.astype(np.uint32))
                learn = fold[i:j] != HELD_OUT
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().int >> 65], pa.int64()),
                        pa.array([rows], pa.binary()),
                        pa.array([T.pack(word_d=words)], pa.binary()),
                        pa.array([T.pack(code=code.astype(np.uint32))], pa.binary()),
                        pa.array([int(learn.sum())], pa.int64()),
                        pa.array([int((learn & (fold[i:j] != TUNE)).sum())], pa.int64()),
                        pa.array([int(off[j] - off[i])], pa.int64()),
                    ],
                    ["block", "rows", "words", "codes", "docs", "docs_fit", "bytes"],
                )

    return source.mapInArrow(run, "block long, rows binary, words binary, codes binary, docs long, docs_fit long, bytes long")


def _ask(blocks: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, rows, words, codes = (batch.column(c)[k].as_py() for c in range(4))
                rows, words, code = T.unpack(rows), T.unpack(words)["word_d"], T.unpack(codes)["code"]
                fold = np.repeat(rows["fold"], rows["n"])
                learn = fold != HELD_OUT
                fit = learn & (fold != TUNE)
                pairs, which = _pairs(words, code, rows["n"].astype(np.int64))
                kinds = []
                for values, number in ((words, code), (pairs, which)):
                    edge = _shard_edges(values, n)
                    kinds.append((values, np.bincount(number[learn], minlength=len(values)), np.bincount(number[fit], minlength=len(values)), edge))
                asked = np.flatnonzero((np.diff(kinds[0][3]) > 0) | (np.diff(kinds[1][3]) > 0))
                for s in asked.tolist():
                    own = [T.pack(hash_d=v[e[s] : e[s + 1]], all=a[e[s] : e[s + 1]].astype(np.uint32), fit=f[e[s] : e[s + 1]].astype(np.uint32)) for v, a, f, e in kinds]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in own]], ["shard", "block", "words", "pairs"])

    return blocks.select("block", "rows", "words", "codes").mapInArrow(run, "shard int, block long, words binary, pairs binary")


def _answer(table: pa.Table) -> pa.Table:
    """One shard: for each block its words' and pairs' counts over all blocks, in the order asked."""
    answers, totals = [], []
    for name in ("words", "pairs"):
        parts = [T.unpack(x.as_py()) for x in table.column(name)]
        size = [len(p["all"]) for p in parts]
        distinct, which = np.unique(np.concatenate([p["hash_d"] for p in parts]), return_inverse=True)
        every = np.bincount(which, np.concatenate([p["all"] for p in parts]), len(distinct)).astype(np.int64)
        fit = np.bincount(which, np.concatenate([p["fit"] for p in parts]), len(distinct)).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(size)))
        answers.append([T.pack(all=_small(every[which[a:b]]), tune=_small((every - fit)[which[a:b]])) for a, b in zip(edge, edge[1:])])
        totals += [int(every.sum()), int((every > 0).sum()), int(fit.sum()), int((fit > 0).sum())]
    head = np.arange(table.num_rows) == 0
    counted = {c: pa.array(np.where(head, t, 0)) for c, t in zip(("n", "v", "n_fit", "v_fit"), totals)}
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "words": pa.array(answers[0], pa.binary()), "pairs": pa.array(answers[1], pa.binary()), **counted})


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32 if not len(a) or a.max() < 1 << 32 else np.uint64)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context.astype(np.float64) + 1))).astype(np.int64)


def _steps(value: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(value > 0, np.rint(np.log2(np.maximum(value, 1e-300)) * STEPS), _NEVER).astype(np.int64)


def _join(docs: int, docs_fit: int):
    """Of one block: its tokens as triples of counts (pair, context, word), and the tuning tokens' histogram."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = {c: blocks.column(c)[0].as_py() for c in ("rows", "words", "codes")}
        rows, words, code = T.unpack(block["rows"]), T.unpack(block["words"])["word_d"], T.unpack(block["codes"])["code"]
        order = np.argsort(answers.column("shard").to_numpy())
        got = {}
        for name in ("words", "pairs"):
            parts = [T.unpack(answers.column(name)[int(k)].as_py()) for k in order]
            got[name] = [np.concatenate([p[f] for p in parts]).astype(np.int64) for f in ("all", "tune")]
        n = rows["n"].astype(np.int64)
        pairs, which = _pairs(words, code, n)
        if len(got["words"][0]) != len(words) or len(got["pairs"][0]) != len(pairs):
            raise RuntimeError("a block's answers are incomplete")
        first = np.cumsum(n) - n

        def counts(word: np.ndarray, pair: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w = word[code]
            context = np.concatenate(([begin], w[:-1]))
            context[first] = begin
            return pair[which], context, w

        triple = np.stack(counts(got["words"][0], got["pairs"][0], docs), 1)
        kinds, number = _distinct_rows(triple)
        tokens = T.pack(code=number.astype(np.uint32))
        table = T.pack(pair=_small(kinds[:, 0]), context=_small(kinds[:, 1]), word=_small(kinds[:, 2]))
        tune = np.repeat(rows["fold"], n) == TUNE
        pair, context, word = (x[tune] for x in counts(got["words"][0] - got["words"][1], got["pairs"][0] - got["pairs"][1], docs_fit))
        cells = np.stack((_bucket(context), _steps(pair / np.maximum(context, 1)), _steps(word)), 1)
        kinds, number = _distinct_rows(cells)
        weight = np.bincount(number, minlength=len(kinds))
        m = len(kinds)
        return pa.table(
            {
                **{name: pa.array([v, *[None] * m], pa.binary()) for name, v in (("rows", block["rows"]), ("tokens", tokens), ("triples", table))},
                **{name: pa.array([None, *kinds[:, k].tolist()], pa.int32()) for k, name in enumerate(("bucket", "pair", "word"))},
                "weight": pa.array([None, *weight.tolist()], pa.int64()),
            }
        )

    return run


def _distinct_rows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, np.zeros(0, np.int64)
    h = T.mix(a[:, 0].astype(np.uint64) + T.mix(a[:, 1].astype(np.uint64) + T.mix(a[:, 2].astype(np.uint64))))
    first, number = T.number(h)
    return a[first], number


def expectation_maximisation(cells: pd.DataFrame, n_fit: int, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (pair, word, uniform) of every bucket. cells: bucket, pair and word steps, weight. A bucket without
    held-out counts takes its lower neighbour's weights, the first one none for pairs."""
    bucket = cells["bucket"].to_numpy(np.int64)
    never = lambda q: np.where(q > _NEVER, np.exp2(np.maximum(q, -4000) / STEPS), 0.0)
    p = np.stack((never(cells["pair"].to_numpy(np.float64)), never(cells["word"].to_numpy(np.float64)) / max(1, n_fit), np.full(len(cells), 1.0 / (v + 1))), 1)
    weight = cells["weight"].to_numpy(np.float64)
    share = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    share[0] = 0.0, 0.7, 0.3
    mass = np.bincount(bucket, weight, BUCKETS)
    for _ in range(rounds):
        part = share[bucket] * p
        part *= (weight / part.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], 1) + np.array([0.0, 1e-3, 1e-3])
        share = np.where(mass[:, None] > 0, new / np.maximum(new.sum(1), 1e-300)[:, None], share)
    for b in range(1, BUCKETS):
        if not mass[b]:
            share[b] = share[b - 1]
    return share


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10."""
    spark = docs.sparkSession
    blocks = cut(_read(docs, id_col, text_col))
    *learned, n_bytes = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "docs_fit", "bytes")]).first()
    answers = cut(
        _ask(blocks, shards(spark, n_bytes)).groupBy("shard").applyInArrow(_answer, "block long, shard int, words binary, pairs binary, n long, v long, n_fit long, v_fit long")
    )
    total, distinct, total_fit, _ = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v"), F.sum("n_fit"), F.sum("v_fit")).first())
    joined = cut(
        blocks.select("block", "rows", "words", "codes").groupBy("block").cogroup(answers.select("block", "shard", "words", "pairs").groupBy("block"))
        .applyInArrow(_join(*learned), "rows binary, tokens binary, triples binary, bucket int, pair int, word int, weight long")
    )
    cells = joined.filter("weight is not null").groupBy("bucket", "pair", "word").agg(F.sum("weight").alias("weight")).toPandas()
    share = expectation_maximisation(cells, total_fit, distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, code, t = (T.unpack(batch.column(c)[k].as_py()) for c in range(3))
                pair, context, word = (t[c].astype(np.float64) for c in ("pair", "context", "word"))
                w = share[_bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, total) + w[:, 2] / (distinct + 1)
                base = np.log10((word + 0.5) / (total + 0.5 * (distinct + 1)))
                n = rows["n"].astype(np.int64)
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x[code["code"]], first) for x in (word > 0, base, np.log10(p))]
                ids = pa.array(rows["id_d"], mask=rows["known"] == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rows["fold"] == HELD_OUT), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.filter("rows is not null").select("rows", "tokens", "triples").mapInArrow(run, schema)
