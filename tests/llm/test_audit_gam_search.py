"""Filter audit, additive quality model and lexical search against plain Python."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import filter_audit, lexical, quality_gam

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, key string, mask int, part string, words string, n long, id long, good string"


def rows_of(texts):
    """Documents with columns whose names the operators use themselves."""
    return [(k, x, lang, "k", 1, "p", "w", 7, 8, "g") for k, x, lang in texts]


# filter audit


def plain_audit(docs, labels):
    least = {}
    for k, x, _ in docs:
        if k is not None:
            least[x or ""] = min(k, least.get(x or "", k))
    good, toxic = ({k for k, q, t in labels if k is not None and (q, t)[c] == 1} for c in (0, 1))
    out = {}
    failed = []
    for k, x, lang in docs:
        x = x or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        f = {"A"} if len(words) < 100 else set()
        f |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", x)) > 10 * len(x) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", x) else set()
        f |= {"E"} if k is not None and k > least[x] else set()
        failed.append((lang or "", f, k in good, k in toxic))
    for part in {p for p, *_ in failed}:
        own = [r for r in failed if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order):
                gone, left = [r for r in left if c in r[1]], [r for r in left if c not in r[1]]
                shapley[c] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(c in r[1] for r in own) - len(gone), sum(r[1] == {c} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def random_texts(r, n):
    words = ["alpha", "Beta", "GAMMA", "de#ta", "x", "ÄÖ", "1|2", "omega"] + [f"w{k}" for k in range(300)]
    pool = [" ".join(r.choices(words, k=r.choice([0, 1, 30, 99, 100, 150]))) for _ in range(n // 2)] + [None, "", "A", " \t\n", "z " * 50_000]
    return [(k, r.choice(pool), r.choice(["de", "en", "", None])) for k in range(n)]


def test_audit_equals_filtering_in_every_order(spark):
    r = random.Random(3)
    docs = random_texts(r, 120)
    docs += [docs[4], docs[4], (None, docs[5][1], "en"), (None, docs[5][1], "en")]  # repeated rows, rows without id
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    counts = filter_audit.failure_counts(spark.createDataFrame(rows_of(docs), DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x["part"], x["filter_order"], x["step"]): list(x)[3:] for x in filter_audit.audit(counts, list(filter_audit.FILTERS)).collect()}
    assert got == plain_audit(docs, labels) and len(got) == 3 * 600


def test_audit_of_no_documents_and_of_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_counts(spark.createDataFrame([], DOCS), none), list("ABCDE")).count() == 0
    counts = filter_audit.failure_counts(spark.createDataFrame(rows_of([(1, "a", "en")]), DOCS), none)
    assert [tuple(x) for x in counts.collect()] == [("en", 1, 1, 0, 0)]


def test_other_filters_without_copies(spark):
    docs = spark.createDataFrame(rows_of([(1, "a b", "en"), (2, "a b", "en"), (3, "c", None)]), DOCS)
    filters = {"short": lambda text, words: filter_audit.F.size(words) < 2, "never": lambda text, words: filter_audit.F.lit(None).cast("boolean")}
    counts = filter_audit.failure_counts(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), filters)
    assert sorted(map(tuple, counts.collect())) == [("", 1, 1, 1, 0), ("en", 0, 2, 0, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_meet_every_order_and_keep_the_diagram(n):
    r = random.Random(n)
    weights = {m: (r.randint(0, 9), r.randint(0, 3)) for m in r.sample(range(1 << n), (1 << n) // 2 + 1)}
    d, orders = filter_audit.Diagram(weights, n), []
    for k in [None, *filter_audit.adjacent_swaps(n)]:
        if k is not None:
            d.swap(k)
        orders.append(tuple(d.order))
        seen = 0
        for variable, inside, out in d.path():
            own = [w for m, w in weights.items() if not m & seen]
            hit = [w for m, w in weights.items() if not m & seen and m >> variable & 1]
            assert inside == tuple(sum(w[c] for w in hit) for c in (0, 1)) and out == tuple(sum(w[c] for w in own) - inside[c] for c in (0, 1))
            seen |= 1 << variable
        for k, level in enumerate(d.levels):
            assert len(level) <= 2**k and len(set(level.values())) == len(level)
    assert len(set(orders)) == len(orders) == math.factorial(n)


def test_equal_functions_are_one_node():
    d = filter_audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(x) for x in d.levels] == [1] * 5


# additive model


def plain_score(model, x):
    z = model.intercept
    for k, (edges, table) in enumerate(zip(model.edges, model.tables)):
        z += table[sum(x[k] > e for e in edges)]
    for i, j, table in model.pairs:
        z += table[sum(x[i] > e for e in model.pair_edges[i])][sum(x[j] > e for e in model.pair_edges[j])]
    return 1 / (1 + math.exp(-z))


def test_scores_are_sums_of_table_entries():
    g = np.random.default_rng(1)
    x = g.normal(size=(800, 4)).round(1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (g.random(800) < 0.05)).astype(float)  # no feature tells anything by itself
    model = quality_gam.fit(x, y)
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}
    fresh = g.normal(size=(400, 4)).round(1)
    got = model.scores(fresh)
    assert np.allclose(got, [plain_score(model, r) for r in fresh])
    assert ((got >= 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.9


def test_a_tree_cuts_where_the_gain_is_greatest():
    g, h, n = np.array([5.0, 4.0, -6.0, -5.0, 9.0]), np.full(5, 20.0), np.full(5, 50)
    values = quality_gam._tree(g, h, n)
    assert values[0] == values[1] > 0 > values[2] == values[3] and values[4] > values[0]
    best = max(range(1, 5), key=lambda k: quality_gam._gain(g[:k].sum(), h[:k].sum()) + quality_gam._gain(g[k:].sum(), h[k:].sum()))
    assert quality_gam._cut(g, h, n)[1] == best
    assert len(set(quality_gam._tree(g, h, np.full(5, 1)))) == 1  # no leaf may be so small


def test_features_of_a_plain_text():
    text = "The cat.\nThe CAT? 12 #x\nThe cat.\n"
    buf = np.frombuffer(text.encode(), np.uint8)
    x = dict(zip(quality_gam.FEATURES, quality_gam.features(buf, np.array([0, len(buf)]))[0]))
    words = text.split()
    chars = sum(map(len, words))
    assert x["words"] == len(words) and x["capitals"] == sum(c.isupper() for c in text) / chars
    assert x["ends"] == 3 / len(words) and x["short_words"] == sum(len(w) <= 3 for w in words) / len(words)
    assert x["marks"] == 4 / chars and x["dup_lines"] == 1 / 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.learn(docs, labels)
    rows = quality_gam.classify(docs, model).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    bad = [r for r in held if r["quality"] == 0]
    assert sum(r["predicted"] == 0 for r in bad) / len(bad) > 0.75
    turned = labels.withColumn("quality", quality_gam.F.when(quality_gam.held_out(), 1 - quality_gam.F.col("quality")).otherwise(quality_gam.F.col("quality")))
    again = quality_gam.learn(docs.withColumn("lang", quality_gam.F.lit("xx")), turned)
    assert again.intercept == model.intercept and all((a == b).all() for a, b in zip(again.tables, model.tables))


def test_gam_edges(spark):
    texts = [(1, None, "en"), (2, "", "en"), (3, "a b c", "en"), (3, "a b c", "en"), (4, "Ä ö 1#" * 200_000, None), (None, "x", "de")]
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (3, 1)], "doc_id long, quality int")
    model = quality_gam.learn(docs, one)
    out = quality_gam.classify(docs, model).collect()
    train = [k for k, *_ in texts if k in (1, 2, 3) and zlib.crc32(str(k).encode()) % 5]
    assert len(out) == 6 and all(r["score"] == pytest.approx((len(train) + 1) / (len(train) + 2)) for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    none = spark.createDataFrame([], DOCS)
    assert quality_gam.classify(none, quality_gam.learn(none, one.limit(0))).count() == 0


# lexical search


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def plain_search(docs, items, k=20):
    bags = [(i, Counter(terms(x))) for i, x in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if no_id else i, -s) for rank, (s, no_id, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(r, n, vocabulary=60, longest=40):
    words = [f"t{k}" for k in range(vocabulary)] + ["Ünï", "x-y", "A1b", "the"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(k, " ".join(r.choices(words, weights, k=r.randint(0, longest)))) for k in range(n)]


def found(blocks, items, spark, k=20):
    return sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in lexical.search(blocks, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def test_search_equals_scoring_everything(spark):
    r = random.Random(5)
    docs = corpus(r, 700) + [(900, None), (901, ""), (902, "--- ,"), (903, "t1 t2 " * 60_000), (None, "t1 t50"), (None, "t51 ünï")]
    docs += [(k + 1000, docs[7][1]) for k in range(60)] + [docs[9], docs[9]]  # ties and repeated rows
    items = [(k, x) for k, x in corpus(r, 25, longest=12)] + [(50, "nothing here"), (51, None), (52, ""), (53, "THE the t1"), (54, "t0"), (55, docs[7][1]), (53, "THE the t1"), (53, "t2")]
    df = spark.createDataFrame([(x, "c", k) for k, x in docs], "text string, term string, doc_id long").repartition(5)
    assert found(lexical.cut(lexical.index(df)), items, spark) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert found(lexical.cut(lexical.index(none)), [(1, "a")], spark) == []
    assert lexical.search(lexical.cut(lexical.index(some)), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert found(lexical.cut(lexical.index(some)), [(1, "a")], spark) == plain_search([(1, "a")], [(1, "a")])


@pytest.mark.parametrize("window,segment,short", [(16, 4, 0.0), (64, 8, 0.1), (50, 16, 0.5), (2048, 128, 5.0)])
def test_blocks_find_their_best_whatever_is_skipped(monkeypatch, window, segment, short):
    """Small windows and segments, and any share of short lists, over one block; with a score to beat."""
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "SHORT", short)
    r = random.Random(window)
    docs = corpus(r, 500)
    ids, raw = pa.array([k for k, _ in docs]), [x.encode() for _, x in docs]
    batch = lexical.index_block(ids, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    df = Counter(t for _, x in docs for t in set(terms(x)))
    names = {t: int(lexical._terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0][0]) for t in df}
    whole = lexical.Collection(batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), {names[t]: c for t, c in df.items()})
    block = lexical._Block(*(batch.column(c)[0].as_py() for c in range(2, 6)), whole)
    for _ in range(30):
        asked = Counter(t for t in r.choices(list(names), k=r.randint(1, 9)))
        hashes = np.array([names[t] for t in asked], np.uint64)
        lists = [(int(at), c * whole.weight(names[t])) for at, (t, c) in zip(block.lists(hashes), asked.items())]
        want = [(i, s) for _, _, i, s in sorted(plain_search(docs, [(0, " ".join(asked.elements()))], 20), key=lambda x: x[1])]
        for least in (0, want[min(9, len(want) - 1)][1]):
            at, score = lexical._best(block, lists, 20, least)
            got = sorted(zip((-score).tolist(), block.ids[at].tolist()))[:20]
            assert [(i, -s) for s, i in got if -s >= max(least, 1)] == [x for x in want if x[1] >= least]


def test_norms_beyond_64_bits():
    whole = lexical.Collection(10**12, 10**14, {})
    n = np.array([1, 4_000_000], np.uint32)
    assert whole.norm(n).tolist() == [75 + 25 * int(x) * 10**12 // 10**14 for x in n]
