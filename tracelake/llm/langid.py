"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from byte-trigram counts of labelled texts. To it are added how
often pages of that language declare what this one declares, and a prior of its host, smoothed towards its
domain, that towards its address suffix, and that towards all pages. Declarations and priors are grouped sums of
the pages' text-only posteriors (a page's own share is taken out of its prior again), so the corpus is only ever
aggregated. Against the languages stands 'none of these', under which all trigrams are equally likely and which
declarations and hosts neither help nor harm. A row is rejected when its best language is not certain enough, with
'none of these' counted in, or its text has no letters.

Null and empty texts have flat likelihoods and are rejected. Null or unknown declarations count as one further
value, null hosts as one host. Repeated rows each give a row. Of equal posteriors the language first by name wins. Very
long texts count as MOST trigrams at most. Input columns keep their names, but for those of RESULTS. Empty input gives
an empty result; without labelled texts there are no languages and every row is rejected.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import cut

#: Hash buckets of trigrams; labelled texts of a language that the model is fitted on, about.
BUCKETS, TEXTS_A_LANGUAGE = 1 << 14, 2_000
#: Weight of a parent level in a prior, in pages.
SMOOTHING = 5.0
#: Trigrams overlap; a text counts as so much less evidence, and as this many trigrams at most.
OVERLAP, MOST = 3.0, 600.0
#: Hosts up to which their table is broadcast (some hundred bytes each); beyond, it is joined by shuffling.
BROADCAST_HOSTS = 10_000
#: Languages whose tables one pass over the texts takes with it (128 KB each); more languages take more passes.
LANGUAGES_A_PASS = 128
#: Bytes up to which the table of declarations (languages by languages) is broadcast; beyond, it is joined by shuffling.
BROADCAST_SAYS = 16 << 20
#: Names of what is found; input columns of these names give way.
RESULTS = ("language", "confidence", "text_language", "rejected")
#: Posterior from which a language counts as certain; prior of a text in none of the languages.
CERTAIN, NONE_PRIOR = 0.5, 0.01

#: Letters (ASCII ones in lower case) and all bytes of other scripts; everything else is a gap.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each byte trigram that is not all gaps."""
    b = _FOLD[buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (code != 0x202020) & (row[:-2] == row[2:])
    return row[:-2][keep], ((code[keep] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_p: np.ndarray

    def likelihoods(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each row under each language and, last, under none of them; trigrams of each row)."""
        row, bucket = _grams(buf, off)
        n = np.bincount(row, minlength=len(off) - 1)
        sums = np.stack([np.bincount(row, self.log_p[k][bucket], len(off) - 1) for k in range(len(self.languages))], 1) if self.languages else np.zeros((len(off) - 1, 0))
        sums = np.concatenate([sums, -np.log(BUCKETS) * n[:, None]], 1)
        return sums * (np.minimum(1.0, MOST / np.maximum(n, 1)) / OVERLAP)[:, None], n


def primary(label: Column) -> Column:
    """A label's or declaration's language: en of EN, en-US and en_GB; null where it is blank."""
    first = F.lower(F.trim(F.substring_index(F.translate(label.cast("string"), "_", "-"), "-", 1)))
    return F.when(first != "", first)


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> TextModel:
    """The trigram model of all labels, from about TEXTS_A_LANGUAGE texts of each (those whose hashed id is small);
    labels with fewer texts give all they have. It takes 128 KB a language on the driver, LANGUAGES_A_PASS times that in a
    task: labels are to be languages, of which there are some thousands at most, not free text."""
    labelled = docs.select(primary(F.col(lang_col)).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("lang is not null")
    sizes = labelled.groupBy("lang").count().collect()
    languages = tuple(sorted(r[0] for r in sizes))
    if not languages:
        return TextModel((), np.zeros((0, BUCKETS)))
    number = {x: k for k, x in enumerate(languages)}
    table = pa.table({"lang": pa.array([r[0] for r in sizes], pa.string()), "share": pa.array([TEXTS_A_LANGUAGE / r[1] for r in sizes], pa.float64())})
    shares = F.broadcast(docs.sparkSession.createDataFrame(table))  # one row a language
    chosen = labelled.join(shares, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off):
                row, bucket = _grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                cell, n = np.unique(which[i + row] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // BUCKETS), pa.array(cell % BUCKETS), pa.array(n)], ["k", "b", "n"])

    counts = np.full((len(languages), BUCKETS), 0.5)
    for k, b, n in chosen.mapInArrow(T.released(run), "k long, b long, n long").groupBy("k", "b").agg(F.sum("n")).toLocalIterator():  # BUCKETS a language at most
        counts[k, b] += n
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)))


def _pass(part: TextModel, kept: list[str], first: bool, last: bool, is_html: bool):
    """One pass over batches of (kept, _text, _ll of the languages before): adds the part's languages to _ll; the last pass
    adds 'none of these' and puts _ll, _p and _grams in place of _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(kept))
            if is_html and first:
                text = pa.array([visible_text(x or "") for x in text.to_pylist()], pa.string())
            buf, off = T.column(pa.RecordBatch.from_arrays([text], ["_text"]), "_text")
            before = None if first else batch.column(len(kept) + 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            ll, p, grams = [], [], [np.zeros(0, np.int64)]
            for i, j in T.slices(off):
                a, n = part.likelihoods(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                a = a if first else np.concatenate([before[i:j], a], 1)
                if not last:
                    ll += a[:, :-1].tolist()
                    continue
                a[:, -1] += math.log(NONE_PRIOR)
                e = np.exp(a - a.max(1, keepdims=True))
                ll += a.tolist()
                p += (e / e.sum(1, keepdims=True))[:, :-1].tolist()
                grams.append(n)
            more = [pa.array(ll, pa.list_(pa.float64()))]
            more = [*more, pa.array(p, pa.list_(pa.float64())), pa.array(np.concatenate(grams))] if last else [text, *more]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *more], [*kept, *(("_ll", "_p", "_grams") if last else ("_text", "_ll"))])

    return run


def _likelihoods(rows: DataFrame, model: TextModel, text_col: str, is_html: bool) -> DataFrame:
    """rows with _ll (log likelihoods of the languages and of none, with its prior), _p (the languages' posteriors, which
    leave out the share of none) and _grams in place of ``text_col``."""
    kept = [c for c in rows.columns if c != text_col]
    out = rows.select(*kept, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    for k in range(0, len(model.languages), LANGUAGES_A_PASS):
        part = TextModel(model.languages[k : k + LANGUAGES_A_PASS], model.log_p[k : k + LANGUAGES_A_PASS])
        last = k + LANGUAGES_A_PASS >= len(model.languages)
        out = out.mapInArrow(T.released(_pass(part, kept, k == 0, last, is_html)), schema + (", _ll array<double>, _p array<double>, _grams long" if last else ", _text string, _ll array<double>"))
    return out


_OPEN = re.compile(r"<!--|<(script|style)\b", re.I)
_CLOSE = {"": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_TAG = re.compile(r"<[^>]*>")


def visible_text(page: str) -> str:
    """A page's text without comments, scripts, styles and tags; what is opened and never closed stays. Takes time in
    proportion to the page: no closing mark is looked for again where there was none."""
    shown, at, last, missing = [], 0, 0, set()
    while (m := _OPEN.search(page, at)) is not None:
        kind, at = (m.group(1) or "").lower(), m.end()
        end = None if kind in missing else _CLOSE[kind].search(page, at)
        if end is None:
            missing.add(kind)
        else:
            shown += [page[last : m.start()], " "]
            at = last = end.end()
    text = "".join([*shown, page[last:]])
    whole = text.rfind(">") + 1
    return html.unescape(_TAG.sub(" ", text[:whole]) + text[whole:])


def _sums(model: TextModel) -> list[Column]:
    return [F.array(*[F.coalesce(F.sum(F.col("_p")[k]), F.lit(0.0)) for k in range(len(model.languages))]).alias("_mass")]


def identify(rows: DataFrame, model: TextModel, text_col: str, declared: Column, levels: list[Column], is_html: bool = False) -> DataFrame:
    """``rows`` without ``text_col``, with language, confidence, text_language and rejected.

    ``declared`` (a language, or null) and ``levels`` (address parts, coarse to fine, each within the one before) are
    expressions over ``rows``, whose columns must not start with an underscore.
    """
    k = len(model.languages)
    kept = [c for c in rows.columns if c != text_col and c not in RESULTS]
    names = [f"_l{i}" for i in range(len(levels))]
    slim = rows.select("*", F.coalesce(declared.cast("string"), F.lit("")).alias("_declared"), *[F.coalesce(x.cast("string"), F.lit("")).alias(n) for x, n in zip(levels, names)])
    if not k:
        return slim.select(*kept, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(True).alias("rejected"))
    found = cut(_likelihoods(slim, model, text_col, is_html))
    known = F.array(*[F.lit(x) for x in model.languages])
    said = F.when(F.array_contains(known, primary(F.col("_declared"))), primary(F.col("_declared"))).when(F.col("_declared") == "", F.lit("")).otherwise(F.lit("?"))
    found = found.withColumn("_said", said)
    # how a language declares itself: two rows of sums more than languages
    table = {r[0]: r[1] for r in found.groupBy("_said").agg(*_sums(model)).collect()}
    mass = np.array([[v + (0.9 if d == lang else 0.1) for v, lang in zip(m, model.languages)] for d, m in table.items()]) if table else np.ones((1, k))
    declares = {d: [*np.log(m / mass.sum(0)).tolist(), math.log(m.sum() / mass.sum())] for d, m in zip(table, mass)}
    total = [float(sum(m[i] for m in table.values())) for i in range(k)]
    top = [(t + 1.0) / (sum(total) + k) for t in total]
    # priors, coarse to fine; each level's sums come from the next finer level's
    sums, finest = {}, found
    for i in range(len(names), 0, -1):
        at = names[:i]
        finest = finest.groupBy(*at).agg(*(_sums(model) if i == len(names) else [F.array(*[F.sum(F.col("_mass")[j]) for j in range(k)]).alias("_mass")]))
        sums[i] = finest
    parent = F.array(*[F.lit(x) for x in top])
    priors = sums[1].withColumn("_up", parent) if names else None
    for i in range(1, len(names) + 1):
        level = sums[i] if i > 1 else priors
        if i > 1:
            level = level.join(priors.select(*names[: i - 1], F.col("_prior").alias("_up")), names[: i - 1])
        smooth = "transform(_mass, (m, i) -> (m + {s}D * _up[i]) / (aggregate(_mass, 0D, (a, b) -> a + b) + {s}D))".format(s=SMOOTHING)
        priors = level.withColumn("_prior", F.expr(smooth)).select(*names[:i], "_mass", "_up", "_prior")
    own = f"transform(_mass, (m, i) -> (greatest(m - _p[i], 0D) + {SMOOTHING}D * _up[i]) / (greatest(aggregate(_mass, 0D, (a, b) -> a + b) - aggregate(_p, 0D, (a, b) -> a + b), 0D) + {SMOOTHING}D))"
    if names:
        hosts = cut(priors.select(*names, "_mass", "_up"))
        # a host with a large share of the rows stays where its rows are while the table of hosts is small
        hosts = F.broadcast(hosts) if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else hosts
        joined = found.join(hosts, names).withColumn("_prior", F.expr(own))
    else:
        joined = found.withColumn("_prior", parent)
    table = pa.table({"_said": pa.array(declares, pa.string()), "_says": pa.array(declares.values(), pa.list_(pa.float64()))})
    says = rows.sparkSession.createDataFrame(table)
    joined = joined.join(F.broadcast(says) if 8 * len(declares) * (k + 1) <= BROADCAST_SAYS else says, "_said")
    fused = f"transform(_ll, (x, i) -> x + _says[i] + if(i < {k}, ln(greatest(_prior[i], 1e-9D)), 0D))"
    # transform over one value gives it a name, so that it is worked out once
    best = f"transform(array(array_max(slice(s, 1, {k}))), m -> struct(array_position(s, m) as at, 1D / aggregate(s, 0D, (a, x) -> a + exp(x - m)) as confidence))[0]"
    joined = joined.withColumn("_best", F.expr(f"transform(array({fused}), s -> {best})[0]"))
    by_text = F.expr(f"array_position(_ll, array_max(slice(_ll, 1, {k})))")
    return joined.select(*kept, known[(F.col("_best.at") - 1).cast("int")].alias("language"), F.col("_best.confidence").alias("confidence"), known[(by_text - 1).cast("int")].alias("text_language"), ((F.col("_best.confidence") < CERTAIN) | (F.col("_grams") == 0)).alias("rejected"))


def host_of(url: Column) -> Column:
    """The host of an address, with or without a scheme."""
    return F.lower(F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/:?#]*)", 1))


def declared_in(page: Column) -> Column:
    """The lang attribute of a page's html tag; null where there is none."""
    found = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(found != "", found)


def identify_pages(pages: DataFrame, model: TextModel, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id_col, host, declared, language, confidence, text_language, rejected) of every page."""
    page = F.col(html_col)
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), declared_in(page).alias("declared"), page.alias("page"))
    levels = [F.substring_index("host", ".", -1), F.substring_index("host", ".", -2), F.col("host")]
    return identify(rows, model, "page", F.col("declared"), levels, is_html=True)
