"""Long texts, collisions, damaged input and plain-Python references of what SQL cannot say."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tracelake.llm import _graph, _repeats, bpe, langid, lm, ogg, packing, quality, simhash, substring_bytes, substring_words, token_counts  # noqa: E402
from tracelake.llm import _text as T  # noqa: E402


def word_list(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def long_rows():
    """Three texts of about a megabyte each, so that a task cuts them into several chunks, with two shared passages."""
    r = random.Random(12)
    words = word_list(r, 4000)
    passage, other = word_list(r, 80), word_list(r, 120)
    out = []
    for k in range(3):
        body = [r.choice(words) for _ in range(150_000)]
        at = (70_000, 149_000, 20)[k]
        out.append((k, " ".join([*body[:at], *passage, *body[at:], *(other if k else [])])))
    return out


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string").coalesce(1)


def test_repeats_across_chunks(long_docs, long_rows):
    sizes = {k: len(x.split()) for k, x in long_rows}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_words.remove_repeats(long_docs).collect()}
    assert got == {0: (sizes[0], 0), 1: (sizes[1], 80), 2: (sizes[2], 200)}
    for r in substring_bytes.remove_repeats(long_docs).collect():
        text = dict(long_rows)[r["doc_id"]]
        least = {0: 0, 1: 1, 2: 2}[r["doc_id"]]
        assert r["n_bytes"] == len(text) and r["n_spans"] == least and (r["n_removed"] > 400 * least - 1)


def test_long_texts_of_other_operators(spark, long_docs, long_rows):
    import sentencepiece
    import tiktoken  # noqa: F401

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(long_docs, P.path("piece_bpe_32k.model")).collect()}
    assert got == {k: len(model.encode(x)) for k, x in long_rows}
    back = {r["doc_id"]: r["decoded_sha256"] for r in bpe.digests(bpe.encode_decode(long_docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)).collect()}
    assert back == {k: hashlib.sha256(x.encode()).hexdigest() for k, x in long_rows}
    assert {r["doc_id"]: r["ok"] for r in ogg.from_media(ogg.to_media(long_docs)).select("doc_id", (F.length("payload") >= F.col("n_bytes")).alias("ok")).collect()} == {0: True, 1: True, 2: True}
    assert len({r["component_id"] for r in simhash.near_duplicates(long_docs).collect()}) == 3
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score(long_docs).collect()} == {k: len(x.split()) + 1 for k, x in long_rows}
    assert {r["doc_id"]: r["n_words"] for r in quality.assess(long_docs, quality.DecisionList()).collect()} == {k: len(x.split()) for k, x in long_rows}
    pieces = packing.token_pieces(long_docs, P.path("byte_bpe_50k.json")).select("doc_id", "piece", (F.octet_length("ids") / 4).cast("long").alias("length"))
    packed = packing.pack(pieces)
    assert packed.filter("length > 1024").count() == 0 and packed.count() == pieces.count()


def test_slices_cover_all_rows():
    for sizes in ([], [5], [0, 0, 0], [3, 9, 1, 0, 20, 2, 2], [100] * 7):
        off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        parts = list(T.slices(off, 10))
        assert [k for i, j in parts for k in range(i, j)] == list(range(len(sizes)))
        assert all(j - i == 1 or off[j] - off[i] <= 10 for i, j in parts)


def test_rows_of_one_id_keep_their_own_spans(spark):
    """Texts under one id are told apart: a repeat in one does not cut into the other."""
    r = random.Random(3)
    passage = " ".join(word_list(r, 60))
    rows = [(1, passage), (2, passage + " tail")] + [(2, " ".join(word_list(r, 20))) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_words.remove_repeats(docs).collect())
    assert got == Counter({(1, 60, 0): 1, (2, 61, 60): 1, (2, 20, 0): 40})
    removed = Counter(r["n_removed"] for r in substring_bytes.remove_repeats(docs).collect())
    assert removed == Counter({0: 41, len(passage): 1})


def test_a_collision_of_contents_is_noticed(spark):
    """With all contents of an anchor under one hash, words still decide: the job ends instead of removing other words."""
    r = random.Random(5)
    middle = word_list(r, 40)
    rows = [(k, " ".join([*word_list(r, 30), *middle, *word_list(r, 30)])) for k in range(4)]

    def weak(buf, off):
        out = list(substring_words.regions(buf, off))
        out[4] = np.zeros(len(out[4]), np.uint64)
        return tuple(out)

    source = _repeats.with_twins(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    args = (substring_words.cut_out, substring_words.part, substring_words.repeated)
    assert _repeats.repeated_spans(source, substring_words.regions, *args, verify=True).count() == 0
    with pytest.raises(Exception, match="same hash"):
        _repeats.repeated_spans(source, weak, *args, verify=True).collect()


@pytest.mark.parametrize("module", [substring_bytes, substring_words])
@pytest.mark.parametrize("verify", [False, True])
def test_windows_of_a_hot_anchor_spread_over_shards(spark, module, verify):
    """A passage that all texts share leaves open windows at its ends in each of them. They are dealt by what they hold: no
    shard gets more than its share, and the same repeats are found as when an anchor's windows stay together."""
    r = random.Random(15)
    passage, tails = word_list(r, 70), [word_list(r, 60) for _ in range(40)]
    rows = [(k, " ".join([*word_list(r, 60), *passage, *(tails[k % 40] if k % 3 else word_list(r, 60))])) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id")
    source = _repeats.with_twins(docs, "doc_id", "text")
    args = (source, module.regions, module.cut_out, module.part, module.repeated, verify)

    def windows(hot):
        held = Counter()
        for row in _repeats.opened(*args, hot=hot).select("shard", "blob").collect():
            held[row["shard"]] += int(T.unpack(row["blob"]).get("count", np.zeros(1)).sum())
        return held

    def found(hot):
        out = set()
        for row in _repeats.repeated_spans(*args, hot=hot).collect():
            a, b = _repeats.merged(np.array(row["spans"]))
            out |= {(row["at"], x, y) for x, y in zip(a.tolist(), b.tolist())}
        return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        together, spread = windows(1 << 40), windows(50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    share = sum(spread.values()) / 32
    assert max(spread.values()) < 1.5 * share and max(together.values()) > 3 * share
    assert found(50) == found(1 << 40) and len(found(50)) >= 1999


def test_wrong_window_hashes_are_verified(monkeypatch):
    """Prefix hashes that are all equal make every suffix look alike; bytes decide."""
    contents, size = b"", []
    r = random.Random(2)
    same = "".join(r.choice("abcdef") for _ in range(60))
    for k in range(6):
        x = (same if k % 3 == 0 else "".join(r.choice("abcdef") for _ in range(60))).encode()
        contents, size = contents + x, [*size, len(x)]
    monkeypatch.setattr(T.Prefix, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    key, doc, count, lead = np.zeros(6, np.int64), np.arange(6), np.full(6, 11), np.full(6, 20)
    which, at, end = substring_bytes.repeated(key, doc, count, lead, contents, np.array(size))
    assert Counter(which.tolist()) == {3: 11} and (end - at == 50).all()


# ---------------------------------------------------------------- language ID


def brute_fusion(model, rows):
    """Posteriors by plain loops. rows: (text, declared, levels coarse to fine)."""
    k, names = len(model.languages), model.languages
    ll, ps, grams = [], [], []
    for text, _, _ in rows:
        b = [x if x >= 128 else (ord(chr(x).lower()) if chr(x).isalpha() else 0x20) for x in (text or "").encode()]
        codes = [(b[i] << 16) | (b[i + 1] << 8) | b[i + 2] for i in range(len(b) - 2)]
        cells = [((c * 2654435761) % 2**32) >> 18 for c in codes if c != 0x202020]
        n = len(cells)
        scale = min(1.0, langid.MOST / max(n, 1)) / langid.OVERLAP
        one = [sum(model.log_p[j][c] for c in cells) * scale for j in range(k)] + [-math.log(langid.BUCKETS) * n * scale + math.log(langid.NONE_PRIOR)]
        e = [math.exp(x - max(one)) for x in one]
        ll.append(one), ps.append([x / sum(e) for x in e][:-1]), grams.append(n)
    said = []
    for _, d, _ in rows:
        d = (d or "").strip().replace("_", "-").split("-")[0].lower()
        said.append(d if d in names or d == "" else "?")
    table = defaultdict(lambda: [0.0] * k)
    for d, p in zip(said, ps):
        table[d] = [a + b for a, b in zip(table[d], p)]
    weight = {d: [v + (0.9 if d == lang else 0.1) for v, lang in zip(m, names)] for d, m in table.items()}
    total = [sum(w[j] for w in weight.values()) for j in range(k)]
    says = {d: [math.log(w[j] / total[j]) for j in range(k)] + [math.log(sum(w) / sum(total))] for d, w in weight.items()}
    mass = [sum(m[j] for m in table.values()) for j in range(k)]
    top = [(m + 1) / (sum(mass) + k) for m in mass]
    sums = defaultdict(lambda: [0.0] * k)
    for (_, _, levels), p in zip(rows, ps):
        for depth in range(1, len(levels) + 1):
            at = tuple(levels[:depth])
            sums[at] = [a + b for a, b in zip(sums[at], p)]
    s = langid.SMOOTHING
    out = []
    for i, (_, _, levels) in enumerate(rows):
        prior = top
        for depth in range(1, len(levels) + 1):
            m = sums[tuple(levels[:depth])]
            own = ps[i] if depth == len(levels) else [0.0] * k
            whole = max(sum(m) - sum(own), 0) + s
            prior = [(max(m[j] - own[j], 0) + s * prior[j]) / whole for j in range(k)]
        fused = [ll[i][j] + says[said[i]][j] + math.log(max(prior[j], 1e-9)) for j in range(k)] + [ll[i][k] + says[said[i]][k]]
        best = max(range(k), key=lambda j: (fused[j], -j))
        confidence = 1 / sum(math.exp(x - fused[best]) for x in fused)
        out.append((names[best], confidence, confidence < langid.CERTAIN or grams[i] == 0))
    return out


def test_fusion_against_plain_loops(spark):
    r = random.Random(9)
    vocabulary = {"de": ["der", "und", "nicht", "für"], "en": ["the", "and", "not", "for"], "fr": ["les", "et", "pas", "pour"]}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    model = langid.fit(spark.createDataFrame([(k, text(x, 30), x) for k in range(20) for x in vocabulary], "doc_id long, text string, lang string"))
    rows = []
    for k in range(60):
        lang = r.choice(list(vocabulary))
        tld = {"de": "de", "en": "com", "fr": "fr"}[lang] if r.random() < 0.8 else "org"
        domain = f"d{k % 4}.{tld}"
        rows.append((text(lang, r.choice([1, 2, 8, 300])), r.choice([lang, lang.upper() + "-XX", None, "", "pl"]), [tld, domain, f"h{k % 2}.{domain}"]))
    rows += [(None, None, ["", "", ""]), ("12 34", "en", ["com", "d0.com", "h0.d0.com"]), ("Привет мир", "en", ["com", "d0.com", "h0.d0.com"])]
    # columns whose names the operator uses itself
    table = spark.createDataFrame([(k, t, d, *lv, 1.0, "x", 2, 3.0) for k, (t, d, lv) in enumerate(rows)], "id long, body string, said string, a string, b string, c string, p double, language string, mass int, up double")
    got = {g["id"]: g for g in langid.identify(table.repartition(3), model, "body", F.col("said"), [F.col("a"), F.col("b"), F.col("c")]).collect()}
    for k, (lang, confidence, rejected) in enumerate(brute_fusion(model, rows)):
        assert got[k]["confidence"] == pytest.approx(confidence, abs=1e-9) and got[k]["rejected"] == rejected and got[k]["p"] == 1.0 and got[k]["mass"] == 2
        if confidence > 0.5:
            assert got[k]["language"] == lang


def test_visible_text_takes_linear_time():
    import time

    assert langid.visible_text("a<!-- x --><b>c</b><SCRIPT>d</script >e<style>f</style>&amp;<!-- open < g") == "a  c  e &<!-- open < g"
    for bad in ("<!-- a ", "<script a ", "< a ", "</script  "):
        began = time.time()
        langid.visible_text(bad * 40_000)
        assert time.time() - began < 2


def test_hosts_without_a_scheme(spark):
    urls = ["http://u:p@A.b.c:80/x", "//a.b/x", "a.b.c/d?e", "a.b:8080", "", None, "/x"]
    got = [r["h"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(langid.host_of(F.col("u")).alias("h")).collect()]
    assert got == ["a.b.c", "a.b", "a.b.c", "a.b", "", None, ""]


# ---------------------------------------------------------------- quality rules


def test_best_test_against_all_thresholds():
    r = np.random.default_rng(4)
    rows = pd.DataFrame({name: r.integers(0, 6, 60).astype(float) for name in quality.FEATURES})
    bad = (rows.iloc[:, 0].to_numpy() >= 4) | (r.random(60) < 0.1)
    gain, (name, above, at) = quality._best_test(rows, bad)
    before, best = math.log2(bad.mean()), -1.0
    for c in rows.columns:
        values = sorted(set(rows[c]))
        for x, y in zip(values, values[1:]):
            for up in (True, False):
                met = rows[c].to_numpy() >= (x + y) / 2 if up else rows[c].to_numpy() <= (x + y) / 2
                if bad[met].any():
                    best = max(best, bad[met].sum() * (math.log2(bad[met].mean()) - before))
    met = rows[name].to_numpy() >= at if above else rows[name].to_numpy() <= at
    assert gain == pytest.approx(best) and bad[met].sum() * (math.log2(bad[met].mean()) - before) == pytest.approx(best)


def test_emitted_expression_is_the_list(spark):
    r = np.random.default_rng(7)
    names = list(quality.FEATURES)
    rules = quality.DecisionList(tuple(quality.Rule(tuple((names[r.integers(len(names))], bool(r.integers(2)), float(r.random() * 3)) for _ in range(1 + k % 3))) for k in range(5)))
    texts = [None, "", "a b c", "# * x " * 40, "one line\n" * 50, *[" ".join(word_list(random.Random(k), 10 + k)) for k in range(40)]]
    stats = quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules)
    out = stats.select("doc_id", "base_failed", "kept", *[F.expr(e).cast("double").alias(n) for n, e in quality.FEATURES.items()]).toPandas()
    rejected = np.zeros(len(out), dtype=bool)
    for rule in rules.rules:
        rejected |= rule.covers(out)
    assert (out["kept"].to_numpy() == (~out["base_failed"].to_numpy() & ~rejected)).all()


# ---------------------------------------------------------------- media


def test_a_damaged_file_is_told_and_harms_no_other(spark):
    good = ogg.write(ogg.payload_of(b"abc"), b"n")
    late = bytearray(good)
    late[-1] ^= 1
    rows = [(1, good), (2, bytes(late)), (3, good[:40]), (4, b""), (5, None), (6, b"no page"), (7, ogg._page(ogg.FIRST | ogg.LAST, 0, 1, 0, b"", b""))]
    got = {r["k"]: r for r in ogg.from_media(spark.createDataFrame(rows, "k long, media binary")).collect()}
    assert bytes(got[1]["payload"]) == ogg.payload_of(b"abc") and got[1]["error"] is None and got[5]["error"] is None
    assert all(got[k]["payload"] is None and got[k]["error"] for k in (2, 3, 4, 6, 7))
    assert all(got[k]["feature"] is None for k in (2, 3, 4, 5, 6, 7))


def test_media_columns_named_like_results_give_way(spark):
    rows = [(1, "p", "f", ogg.write(ogg.payload_of(b"abc"), b"n"))] * 2
    out = ogg.from_media(spark.createDataFrame(rows, "k long, Payload string, feature string, media binary"))
    assert out.columns == ["k", "media", "payload", "duration_ms", "feature", "error"]
    assert [bytes(r["payload"]) for r in out.select("payload").collect()] == [ogg.payload_of(b"abc")] * 2
    whole = spark.createDataFrame([(1, ogg.write(ogg.payload_of(b"x"), b"n"))], "k long, payload binary")
    assert bytes(ogg.from_media(whole, "payload").first()["payload"]) == ogg.payload_of(b"x")


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {(r["node"], r["root"]) for r in _graph.components(edges).collect()} == {(k, 0) for k in range(1, 41)}
    with pytest.raises(RuntimeError, match="not settled"):
        _graph.components(edges, rounds=1)


def test_features_by_plain_loops():
    r = random.Random(1)
    for n in (0, 1, 64, 5_000, 40_000):
        payload = ogg.payload_of(bytes(r.randrange(256) for _ in range(n)))
        stream = ogg.read(ogg.write(payload, b"x"))[b"PCM8"]
        swing = sum(abs(a - b) for a, b in zip(payload, payload[1:])) * 1000 // max(1, len(payload) - 1)
        packets = -(-len(payload) // ogg.PACKET)
        assert ogg.features(stream) == f"ms={len(payload) * 1000 // ogg.RATE} packets={packets} pages={stream['pages']} mean={sum(payload) * 1000 // len(payload)} swing={swing}"


def test_arrow_columns_with_offsets():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "bcd", ""])], ["text"]).slice(1)
    buf, off = T.column(batch, "text")
    assert bytes(buf) == b"bcd" and off.tolist() == [0, 0, 3, 3]
