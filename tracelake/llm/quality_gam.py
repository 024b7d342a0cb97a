"""Quality classifier: a generalised additive model with pairwise interactions.

A text's score is the logistic of an intercept, a number for each feature and one for each chosen pair of features, each
read from a lookup table at the feature's bin. The tables are learned by cyclic boosting: round after round every feature
in turn gets a shallow tree on its bins, fitted to what the model so far leaves unexplained, a small step of which is added to
its table. Then pairs of features are ranked by how much a tree over both explains beyond the tables, and the best are
boosted in the same way. A fold of the training rows decides how many rounds to keep. Scoring is additions of table entries
for all rows of a batch at once.

Null and empty texts have the features of no words and get a score like any other. Repeated rows each give a row. A document
with several labels has its lowest; null labels and ids are ignored. Without training labels of both kinds every score is the
share of label 1 (with one row of each kind added). Of equal cuts the first feature's lowest is taken. Very long texts are read
whole. An empty table gives an empty result. Columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import quality

#: Labelled rows that the model is fitted on at most (those with the least hash of their id).
TRAINING_ROWS = 20_000
#: Bins of a feature, and bins of a feature in a pair; pairs that get a table.
BINS, PAIR_BINS, PAIRS = 64, 12, 6
#: Rounds of boosting at most, rounds without gain on the tuning fold until it ends, and the share of a tree that is added.
ROUNDS, PATIENCE, RATE = 400, 30, 0.1
#: Weight of a leaf's shrinking towards 0, and training rows that a leaf needs.
SHRINK, LEAST_ROWS = 1.0, 10
#: From this score on a text is predicted to have label 1.
THRESHOLD = 0.3

FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "letters", "digits", "distinct", "line_words", "capitals", "marks", "ends", "short_words"]

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_MARK = np.array([b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])
_END = np.isin(np.arange(256), list(b".!?"))


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each row of a chunk."""
    c = {k: v.astype(np.float64) for k, v in quality.counts(buf, off).items()}
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[off]).astype(np.float64)
    start, end, row = T.words(buf, off)
    brief = np.bincount(row[end - start <= 3], minlength=len(off) - 1)
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    columns = [
        c["n_words"], c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_letters"] / chars, c["n_digits"] / chars,
        c["n_distinct"] / words, c["n_words"] / lines, total(_CAPITAL[buf]) / chars, total(_MARK[buf]) / chars, total(_END[buf]) / words, brief / words,
    ]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class Gam:
    """intercept; for each feature the upper edges of its bins and its table; tables of pairs with their own, coarser edges."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pair_edges: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k])]
        own = {k: np.searchsorted(self.pair_edges[k], x[:, k]) for i, j, _ in self.pairs for k in (i, j)}
        for i, j, table in self.pairs:
            z += table[own[i], own[j]]
        return 1 / (1 + np.exp(-z))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most ``bins`` bins with about as many values each; equal values share a bin."""
    levels = np.unique(values)
    cuts = (levels[1:] + levels[:-1]) / 2
    if len(cuts) < bins:
        return cuts
    return np.unique(cuts[np.searchsorted(cuts, np.quantile(values, np.arange(1, bins) / bins)).clip(0, len(cuts) - 1)])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a row of bins; gain 0 where none leaves enough rows on either side."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = (np.cumsum(a)[:-1] for a in (g, h, n))
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_ROWS) | (n.sum() - nl < LEAST_ROWS)] = 0.0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values of a tree with at most so many leaves on a row of bins: the best cut, then the best cut of a side."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, size, a, b = max(found, key=lambda x: x[0])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + size), (a + size, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree on a grid of bins that cuts one feature, then either side by the other."""
    best = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        g2, h2, n2 = (a.T if turned else a for a in (g, h, n))
        for cut in range(1, len(g2)):
            gain, values = -_gain(g.sum(), h.sum()), np.zeros(g2.shape)
            for side in (slice(0, cut), slice(cut, len(g2))):
                gs, hs, ns = g2[side].sum(0), h2[side].sum(0), n2[side].sum(0)
                _, k = _cut(gs, hs, ns)
                for part in (slice(0, k), slice(k, len(gs))):
                    if ns[part].sum() < LEAST_ROWS:
                        continue
                    gain += _gain(gs[part].sum(), hs[part].sum())
                    values[side, part] = gs[part].sum() / (hs[part].sum() + SHRINK)
            if gain > best[0] + 1e-9:
                best = float(gain), values.T if turned else values
    return best


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _boost(bins: list[np.ndarray], shapes: list[tuple[int, ...]], z: np.ndarray, y: np.ndarray, tune: np.ndarray, fit_tree) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables for the given bins (one number a row for each table), boosted in turn; those of the best round on ``tune``."""
    tables = [np.zeros(int(np.prod(s))) for s in shapes]
    learn = ~tune
    best, kept, since = _loss(z[tune], y[tune]), [t.copy() for t in tables], 0
    for _ in range(ROUNDS):
        for table, own, shape in zip(tables, bins, shapes):
            p = 1 / (1 + np.exp(-z))
            at, size = own[learn], len(table)
            g, h, n = np.bincount(at, (y - p)[learn], size), np.bincount(at, (p * (1 - p))[learn], size), np.bincount(at, minlength=size)
            step = RATE * fit_tree(g.reshape(shape), h.reshape(shape), n.reshape(shape)).reshape(-1)
            table += step
            z = z + step[own]
        loss = _loss(z[tune], y[tune])
        if loss < best - 1e-5:
            best, kept, since = loss, [t.copy() for t in tables], 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    return [t.reshape(s) for t, s in zip(kept, shapes)], sum((t[b] for t, b in zip(kept, bins)), np.zeros(len(y)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of label 1 from feature rows and labels; every fifth row is kept for tuning."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    columns = range(x.shape[1])
    if not 0 < y.sum() < len(y) or len(y) < 10:
        none = tuple(np.zeros(0) for _ in columns)
        return Gam(start, none, tuple(np.zeros(1) for _ in columns), none, ())
    tune = np.arange(len(y)) % 5 == 4
    edges = [_edges(x[~tune, k], BINS) for k in columns]
    bins = [np.searchsorted(edges[k], x[:, k]) for k in columns]
    tables, added = _boost(bins, [(len(e) + 1,) for e in edges], np.full(len(y), start), y, tune, _tree)
    z = start + added
    coarse = [_edges(x[~tune, k], PAIR_BINS) for k in columns]
    rough = [np.searchsorted(coarse[k], x[:, k]) for k in columns]
    p = 1 / (1 + np.exp(-z))
    ranked = []
    for i in columns:
        for j in range(i + 1, x.shape[1]):
            shape = len(coarse[i]) + 1, len(coarse[j]) + 1
            own = rough[i] * shape[1] + rough[j]
            sums = [np.bincount(own[~tune], w[~tune], shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y)))]
            ranked.append((-_pair_tree(*sums)[0], i, j, shape, own))
    ranked = sorted(ranked, key=lambda r: r[:3])[:PAIRS]
    pair_tables, _ = _boost([r[4] for r in ranked], [r[3] for r in ranked], z, y, tune, lambda g, h, n: _pair_tree(g, h, n)[1])
    return Gam(start, tuple(edges), tuple(tables), tuple(coarse), tuple((r[1], r[2], t) for r, t in zip(ranked, pair_tables)))


def _featured(rows: DataFrame, carry: list[str], schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "_text")
            for i, j in T.slices(off):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                arrays, names = make(x)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(len(carry))], *arrays], [*carry, *names])

    return rows.mapInArrow(T.released(run), schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Gam:
    """The model from at most ``limit`` labelled rows that are not held out."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = marked.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    sample = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _featured(
        sample.select(id_col, F.col("_label").cast("int").alias("_label"), "_text"), [id_col, "_label"], f"`{id_col}` {kind}, _label int, x array<double>",
        lambda x: ([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))], ["x"]),
    ).orderBy(F.xxhash64(id_col), id_col, "x").limit(limit).toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, (rows["_label"].to_numpy() == 1).astype(np.float64))


def classify(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))

    def make(x: np.ndarray):
        score = model.scores(x)
        return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["score", "predicted"]

    return _featured(rows, [id_col, "held_out"], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int", make)
