"""Quality rules: text statistics, and decision lists learned from labels.

``statistics`` counts, for every whole text, what the rules look at. ``learn`` grows conjunctions of thresholds
one after another (sequential covering): each rule is grown on two thirds of the labelled rows that no earlier
rule covers, pruned on the other third, and kept while it is precise enough there. ``DecisionList.verdict`` is
the ordered list as one Spark conditional expression; what no rule covers is kept.

Null and empty texts have no words and fail the base test. Repeated rows each give a row. A document with
several labels has its lowest; null labels are ignored; without labels of both kinds the list is empty and the
base test alone decides. Of tests with equal gain the first feature's lowest threshold is taken, of equally good
prunings the shorter rule. Very long texts are read whole. An empty table gives an empty result. Columns other than the
named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that a list is learned from at most (those with the least hash of their id).
TRAINING_ROWS = 20_000
#: What a list looks at: ratios of the counts.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "letters": "n_letters / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_digits", "n_distinct"]

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_LETTER = np.array([chr(b).isalpha() if b < 128 else b >= 0xC3 for b in range(256)])  # of other scripts the first byte


def counts(buf: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of every row of one chunk."""
    n = len(off) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[off])

    out = {"word_chars": total(~T.SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[buf]), "n_letters": total(_LETTER[buf]), "n_digits": total(_DIGIT[buf])}
    start, end, row = T.words(buf, off)
    out["n_words"] = np.bincount(row, minlength=n)
    salt = T.mix(np.arange(1, n + 1).astype(np.uint64))
    h = T.word_hashes(buf, start, end)
    fresh = ~pd.Series(h ^ salt[row]).duplicated().to_numpy()
    out["n_distinct"] = np.bincount(row[fresh], minlength=n)
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    first = np.arange(max(0, len(h) - window + 1))
    first = first[row[first] == row[first + window - 1]]
    sums = T.Prefix(h).of(first, first + window)
    again = first[pd.Series(T.mix(sums) ^ salt[row[first]]).duplicated(keep=False).to_numpy()]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=n)
    breaks = np.flatnonzero(buf == 10)
    line = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], breaks + 1)))
    line = line[line < len(buf)]
    line_row = np.searchsorted(off, line, "right") - 1
    stop = np.minimum(np.append(line[1:], len(buf)), off[line_row + 1])
    stop -= (stop > line) & (buf[np.maximum(stop - 1, 0)] == 10)
    worded = np.searchsorted(start, stop) > np.searchsorted(start, line)
    line, stop, line_row = line[worded], stop[worded], line_row[worded]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    twice = pd.Series(T.hashes(buf, line, stop) ^ salt[line_row]).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(line_row[twice], minlength=n)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *carry, counts) of every row."""
    source = docs.select(F.col(id_col), *[F.col(c) for c in carry], F.col(text_col).alias("_text"))
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "_text")
            for i, j in T.slices(off):
                found = counts(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                own = [batch.column(k).slice(i, j - i) for k in range(1 + len(carry))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(found[c].astype(np.int64)) for c in _COUNTS]], [id_col, *carry, *_COUNTS])

    return source.mapInArrow(T.released(run), kinds + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at least?, threshold); texts that meet it are rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, rows: pd.DataFrame) -> np.ndarray:
        met = np.ones(len(rows), dtype=bool)
        for name, above, at in self.tests:
            met &= (rows[name].to_numpy() >= at) if above else (rows[name].to_numpy() <= at)
        return met

    def column(self) -> Column:
        met = F.lit(True)
        for name, above, at in self.tests:
            value = F.expr(FEATURES[name]).cast("double")
            met = met & ((value >= at) if above else (value <= at))
        return met


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def verdict(self) -> Column:
        """True (keep) unless a rule covers the row: CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
        if not self.rules:
            return F.lit(True)
        out = F.when(self.rules[0].column(), F.lit(False))
        for rule in self.rules[1:]:
            out = out.when(rule.column(), F.lit(False))
        return out.otherwise(F.lit(True))


def _best_test(rows: pd.DataFrame, bad: np.ndarray) -> tuple[float, tuple[str, bool, float]] | None:
    """The test with the highest FOIL gain over all features and thresholds between different values."""
    p, n = bad.sum(), len(bad) - bad.sum()
    before, best = np.log2(p / (p + n)), None
    for name in FEATURES:
        value = rows[name].to_numpy()
        order = np.argsort(value, kind="stable")
        v, b = value[order], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edge):
            continue
        low = np.cumsum(b)[edge - 1].astype(float)
        middle = (v[edge] + v[edge - 1]) / 2
        for above, hit, size in ((False, low, edge), (True, p - low, len(v) - edge)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit > 0, hit * (np.log2(hit / size) - before), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = float(gain[k]), (name, above, float(middle[k]))
    return best


def fit(rows: pd.DataFrame, bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_tests: int = 4, least: int = 5) -> DecisionList:
    """Sequential covering of the ``bad`` rows; a rule must be right for ``precision`` of what it covers, in both parts."""
    rules: list[Rule] = []
    left = np.ones(len(rows), dtype=bool)
    part = np.arange(len(rows)) % 3
    for _ in range(most_rules):
        grow, prune = left & (part < 2), left & (part == 2)
        tests: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while len(tests) < most_tests and (bad & inside).any() and (~bad & inside).any():
            found = _best_test(rows[inside], bad[inside])
            if found is None:
                break
            tests.append(found[1])
            inside &= Rule((found[1],)).covers(rows)

        def worth(rule: Rule, among: np.ndarray) -> tuple[float, int]:
            met = rule.covers(rows) & among
            return (float((bad & met).sum() - (~bad & met).sum()) / max(1, met.sum()), int(met.sum()))

        options = [Rule(tuple(tests[:k])) for k in range(len(tests), 0, -1)]
        if not options:
            break
        rule = max(options, key=lambda r: (worth(r, prune)[0], -len(r.tests)))
        met = rule.covers(rows) & left
        if met.sum() < least or not met[bad].any() or bad[met].mean() < precision or (met & prune).any() and bad[met & prune].mean() < precision:
            break
        rules.append(rule)
        left &= ~met
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> DecisionList:
    """A decision list for low-quality (label 0) texts from at most ``limit`` labelled rows that pass the base test."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = marked.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    sample = docs.select(id_col, F.col(text_col).alias("_body")).join(F.broadcast(chosen), id_col)
    rows = statistics(sample, id_col, "_body", ("_label",)).filter(~base_failed())
    rows = rows.select(id_col, "_label", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]).orderBy(F.xxhash64(id_col), id_col).limit(limit).toPandas()
    return fit(rows, rows["_label"].to_numpy() == 0)


def assess(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, counts, base_failed, kept) of every row."""
    return statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())
