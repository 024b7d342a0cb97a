"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and further
columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tracelake.llm import _text as T  # noqa: E402
from tracelake.llm import _repeats, bpe, langid, lm, ogg, packing, quality, simhash, substring_bytes, substring_words, token_counts  # noqa: E402

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Further columns: names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, shard int, blob string, fp long, twin string, spans string"


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Tion", "été", "naïve", "a", "in,", "%%%", "日本語", "x1", "it's", "\U0001f600", "No."]
    word = lambda: r.choice(vocabulary) if r.random() < 0.6 else "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    gap = lambda: r.choice([" ", " ", " ", "  ", "\n", "\t", "\x0b", "  ", " "])
    long = lambda k: "".join(word() + gap() for _ in range(k))
    passage, page = long(70), long(300)
    out = [None, "", " ", "\n\n", "one", "two words", "a" * 300, "ab " * 400, "the of\n" * 30, "é" * 80]
    for k in range(n - len(out)):
        kind = k % 6
        body = long(r.randint(1, 120))
        out.append({0: body, 1: body + passage, 2: page, 3: page[: r.randint(5, 900)] + body, 4: passage + " " + passage, 5: out[-1] or ""}[kind])
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(k if k != 7 else None, x) for k, x in enumerate(t)]
    return [*out, out[20], out[20], (21, t[22]), (2**60, t[25]), (-5, t[30])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", 3, "b", 9, "t", "s") for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def words_of(x):
    return WORDS.findall((x or "").encode())


# ---------------------------------------------------------------- language-model scoring


def test_lm_base_and_distribution(docs, rows, none):
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r for r in lm.score(docs).collect()}
    count, held = Counter(), {}
    for i, x in rows:
        held[i] = i is None or zlib.crc32(str(i).encode()) % 5 == 1
        if not held[i]:
            count.update([*[w.lower() for w in words_of(x)], None])
    n, v = sum(count.values()), len(count)
    for i, x in rows:
        t = [*[w.lower() for w in words_of(x)], None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[(i, len(t), round(base, 6))]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held[i], sum(count[w] > 0 for w in t), n)
        assert r["score"] < 0
    assert lm.score(none).count() == 0


def test_lm_score_against_brute_force(docs, rows):
    """The same model in plain Python, with EM over exact held-out counts instead of logarithmic steps."""
    fold = lambda i: 1 if i is None else zlib.crc32(str(i).encode()) % 5
    tokens = {k: [*[w.lower() for w in words_of(x)], "</end>"] for k, (_, x) in enumerate(rows)}

    def count(folds):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for k, (i, _) in enumerate(rows):
            if fold(i) in folds:
                t = tokens[k]
                uni.update(t)
                bi.update(zip([None, *t], t))
                ctx.update([None, *t[:-1]])
        return uni, bi, ctx

    uni, bi, ctx = count({0, 2, 3, 4})
    fu, fb, fc = count({0, 2, 3})
    v, n, fn = len(uni), sum(uni.values()), sum(fu.values())
    cells = Counter()
    for k, (i, _) in enumerate(rows):
        if fold(i) == 4:
            for a, b in zip([None, *tokens[k]], tokens[k]):
                c = fc[a]
                cells[(int(lm._bucket(np.array([c]))[0]), fb[a, b] / c if c else 0.0, fu[b] / fn)] += 1
    share = np.tile([0.4, 0.4, 0.2], (lm.BUCKETS, 1))
    share[0] = 0.0, 0.7, 0.3
    mass = np.zeros(lm.BUCKETS)
    for (b, *_), w in cells.items():
        mass[b] += w
    for _ in range(60):
        new = np.tile([0.0, 1e-3, 1e-3], (lm.BUCKETS, 1))
        for (b, p2, p1), w in cells.items():
            part = share[b] * [p2, p1, 1 / (v + 1)]
            new[b] += w * part / part.sum()
        share = np.where(mass[:, None] > 0, new / new.sum(1, keepdims=True), share)
    for b in range(1, lm.BUCKETS):
        if not mass[b]:
            share[b] = share[b - 1]
    want = []
    for k in tokens:
        s = 0.0
        for a, b in zip([None, *tokens[k]], tokens[k]):
            w = share[int(lm._bucket(np.array([ctx[a]]))[0])]
            s += math.log10(w[0] * bi[a, b] / max(1, ctx[a]) + w[1] * uni[b] / n + w[2] / (v + 1))
        want.append(s / len(tokens[k]))
    got = sorted(r["score"] / r["n_tokens"] for r in lm.score(docs).collect())
    assert np.allclose(got, sorted(want), atol=0.05)


# ---------------------------------------------------------------- language identification


def test_language_id(spark, none):
    r = random.Random(3)
    make = lambda lang: " ".join(r.choice({"en": ["the", "thing", "with", "which"], "fr": ["été", "les", "oiseau", "où"]}[lang]) for _ in range(40))
    labelled = spark.createDataFrame([(k, make(l), l) for k in range(40) for l in ("en", "fr")], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ("en", "fr")
    page = lambda lang, body: f'<html lang="{lang}-X"><head><script>var the = 1</script></head><body><p>{body}</p></body></html>'
    rows = [(k, f"http://h{k % 3}.example.{'fr' if k % 2 else 'com'}/x", page("fr" if k % 2 else "en", make("fr" if k % 2 else "en"))) for k in range(30)]
    rows += [(98, None, None), (99, "http://h1.example.fr", "<html><body>12 34</body></html>"), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = langid.identify_pages(pages, model).collect()
    assert len(got) == len(rows)
    for g in got:
        if g["page_id"] < 90:
            assert g["language"] == ("fr" if g["page_id"] % 2 else "en") and not g["rejected"] and g["confidence"] > 0.9
        else:
            assert g["rejected"]
    assert langid.identify_pages(pages.limit(0), model).count() == 0
    assert langid.fit(none).languages == () and langid.identify_pages(pages, langid.fit(none)).filter("not rejected").count() == 0


def test_host_prior_settles_a_short_text(spark):
    model = langid.TextModel(("en", "fr"), np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)))
    strong = np.array(model.log_p)
    strong[1, : langid.BUCKETS // 2] += 2
    strong[0, langid.BUCKETS // 2 :] += 2
    model = langid.TextModel(("en", "fr"), strong)
    pages = spark.createDataFrame([(k, "http://a.b.fr/", "<p>les oiseaux chantent dans les arbres</p>") for k in range(20)] + [(50, "http://a.b.fr/", "<p>abc</p>"), (51, "http://z.z.com/", "<p>abc</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify_pages(pages, model).collect()}
    assert got[50]["language"] == got[0]["language"]


def test_all_labels_are_fitted(spark, monkeypatch):
    """More labels than fit a fixed number, the rarest too, and spelling variants as one."""
    r = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    letters = {f"l{chr(97 + k // 26)}{chr(97 + k % 26)}": r.sample(alphabet, 6) for k in range(40)}
    make = lambda lang: " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(60))
    rows = [(k, make(lang), spelt) for k, (lang, spelt) in enumerate((lang, lang if n != 1 else f"{lang.upper()}_XX") for at, lang in enumerate(letters) for n in range(12 if at < 39 else 3))]
    model = langid.fit(spark.createDataFrame([*rows, (9999, "abc", " "), (9998, "abc", None)], "doc_id long, text string, lang string"))
    assert model.languages == tuple(sorted(letters))
    pages = spark.createDataFrame([(k, "http://x.com/", make(lang)) for k, lang in enumerate(letters)], "page_id long, url string, html string")
    got = {g["page_id"]: g["text_language"] for g in langid.identify_pages(pages, model).collect()}
    assert sum(got[k] == lang for k, lang in enumerate(letters)) >= 38 and got[39] == list(letters)[39]
    # passes over parts of the languages and a shuffled table of declarations change nothing
    rows_of = lambda: sorted((r["page_id"], r["language"], round(r["confidence"], 9), r["text_language"], r["rejected"]) for r in langid.identify_pages(pages, model).collect())
    whole = rows_of()
    monkeypatch.setattr(langid, "LANGUAGES_A_PASS", 16)
    monkeypatch.setattr(langid, "BROADCAST_SAYS", 0)
    assert rows_of() == whole


def test_texts_in_no_known_language_are_rejected(spark):
    """Foreign and encoded texts, whatever they declare and wherever they stand; clean texts next to them stay."""
    r = random.Random(6)
    known = {
        "en": "the people of this town have always known that water comes from the hills and goes to the sea when it rains in spring they work there with their children and think about what will happen",
        "es": "la gente de este pueblo siempre ha sabido que el agua viene de las montañas y va al mar cuando llueve en primavera trabajan con sus hijos y piensan en lo que puede pasar después",
    }
    make = lambda lang: " ".join(r.choice(known[lang].split()) for _ in range(60))
    labelled = spark.createDataFrame([(k, make(l), l) for k in range(300) for l in known], "doc_id long, text string, lang string")
    foreign = [
        "люди этого города всегда знали что вода приходит с холмов и уходит в море когда весной идут дожди они работают там со своими детьми",
        "这个城镇的人们一直知道水来自山丘流向大海春天下雨的时候他们和孩子们一起在那里工作并且思考将来会发生什么事情",
        "ludzie z tego miasta zawsze wiedzieli że woda płynie ze wzgórz i wpada do morza gdy wiosną pada deszcz pracują tam ze swoimi dziećmi",
        "tämän kaupungin ihmiset ovat aina tienneet että vesi tulee kukkuloilta ja menee mereen kun keväällä sataa he työskentelevät siellä lastensa kanssa",
        "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)),
    ]
    rows = [(k, make("es" if k % 2 else "en"), "es" if k % 2 else "en") for k in range(40)] + [(100 + k, x, "es") for k, x in enumerate(foreign)]
    pages = spark.createDataFrame([(k, "http://a.b.es/", f'<html lang="{lang}"><body><p>{x}</p></body></html>') for k, x, lang in rows], "page_id long, url string, html string")
    got = langid.identify_pages(pages, langid.fit(labelled)).collect()
    assert {g["page_id"] for g in got if g["rejected"]} == {100 + k for k in range(len(foreign))}
    assert all(g["language"] == ("es" if g["page_id"] % 2 else "en") for g in got if g["page_id"] < 100)


# ---------------------------------------------------------------- packing


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.token_pieces(docs, P.path("byte_bpe_50k.json"), capacity=64)
    out = packing.pack(pieces.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("crc")), capacity=64).toPandas()
    want = Counter()
    for i, x in rows:
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2]
        edges = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.crc) for r in out.itertuples()) .keys() >= {k for k in want if k[0] != 2**60}
    assert len(out) == sum(want.values())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 64 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 64) + 3
    assert packing.pack(packing.token_pieces(none, P.path("byte_bpe_50k.json")).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("length"))).count() == 0


def test_exchange_only_saves_bins(spark):
    r = random.Random(5)
    sizes = [r.choice([300, 341, 450, 520, 683, 700]) for _ in range(3000)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k long, length long")
    one = packing.pack(df, 1024, partitions=16).toPandas()
    first = sum(packing.best_fit_decreasing(np.array(sizes[k::16]), 1024).max() + 1 for k in range(16))
    bound = packing.lower_bound(np.array(sizes), 1024)
    assert bound <= one["sequence_id"].nunique() <= first and len(one) == 3000
    assert (one["bins"] >= one["lower_bound"]).all()


def test_lower_bound_is_one():
    r = np.random.default_rng(1)
    for _ in range(50):
        a = r.integers(1, 101, r.integers(1, 40))
        assert packing.lower_bound(a, 100) <= packing.best_fit_decreasing(a, 100).max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


# ---------------------------------------------------------------- quality rules


def brute_counts(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {q for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for q in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_statistics(docs, rows, none):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = counted(quality.statistics(docs), "doc_id", *cols)
    assert got == Counter((i, *brute_counts(x)) for i, x in rows)
    assert quality.assess(none, quality.DecisionList()).count() == 0


def test_decision_list_is_learned_and_ordered(spark):
    r = random.Random(2)
    body = lambda bad: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + ("***" if bad else "") for _ in range(60))
    docs = spark.createDataFrame([(k, body(k % 4 == 0)) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1) for k in range(200)] + [(1, None), (None, 0), (5, 1)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules.rules
    held = {x["doc_id"]: x["kept"] for x in quality.assess(docs, rules).collect() if x["doc_id"] >= 200}
    assert np.mean([held[k] == (k % 4 != 0) for k in held]) > 0.98
    assert quality.learn(docs, labels.limit(0)).rules == () and quality.learn(docs, labels.filter("quality = 1")).rules == ()


# ---------------------------------------------------------------- substring dedup


def brute_repeats(rows, units):
    least = {}
    for i, x in rows:
        u = units(x)
        for k in range(len(u) - 49):
            if i is not None:
                key = tuple(u[k : k + 50])
                least[key] = min(least.get(key, i), i)
    for i, x in rows:
        u = units(x)
        gone = [False] * len(u)
        if i is not None:
            for k in range(len(u) - 49):
                if least[tuple(u[k : k + 50])] < i:
                    gone[k : k + 50] = [True] * 50
        yield i, u, gone


def test_byte_repeats(docs, rows, none):
    out = substring_bytes.remove_repeats(docs)
    got = Counter((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out.collect())
    want = Counter()
    for i, u, gone in brute_repeats(rows, lambda x: (x or "").encode()):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[(i, bytes(b for b, g in zip(u, gone) if not g), len(u), sum(gone), runs)] += 1
    assert got == want and sum(r[3] for r in want) > 1000
    assert substring_bytes.remove_repeats(none).count() == 0


@pytest.mark.parametrize("verify", [False, True])
def test_word_repeats(docs, rows, none, verify):
    got = counted(substring_words.remove_repeats(docs, verify=verify, seed=3 * verify), "doc_id", "kept", "n_words", "n_removed")
    want = Counter((i, b" ".join(w for w, g in zip(u, gone) if not g).decode(), len(u), sum(gone)) for i, u, gone in brute_repeats(rows, words_of))
    assert got == want and sum(r[3] for r in want) > 500
    assert substring_words.remove_repeats(none).count() == 0


@pytest.mark.parametrize("module", [substring_bytes, substring_words])
def test_copies_are_told_without_their_regions(spark, module):
    """Of a text that many documents have only the least one's regions are sent, and texts are compressed where they move."""
    r = random.Random(21)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(150)) for _ in range(12)]
    texts += [texts[0][: len(texts[0]) // 2], "a few words", ""]
    rows = [(k * len(texts) + i, x) for k in range(20) for i, x in enumerate(texts)]
    rows += [(5, texts[7]), (5, texts[7]), (None, texts[3]), (None, texts[3]), (-1, texts[9]), (-1, texts[9][5:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    by_bytes = module is substring_bytes
    got = Counter((x["doc_id"], bytes(x["kept"]) if by_bytes else x["kept"].encode(), x["n_removed"]) for x in module.remove_repeats(docs).collect())
    units, gap = ((lambda x: [bytes([b]) for b in x.encode()]), b"") if by_bytes else (words_of, b" ")
    assert got == Counter((i, gap.join(u for u, g in zip(u, gone) if not g), sum(gone)) for i, u, gone in brute_repeats(rows, units))

    source = _repeats.with_twins(docs, "doc_id", "text")
    args = (module.regions, module.cut_out, module.part, module.repeated)
    held = lambda df: sum(len(T.unpack(x["blob"]).get("span_d", ())) for x in df.select("blob").collect())
    assert held(_repeats.opened(source, *args, again=_repeats.copies(source))) < 30 < 200 < held(_repeats.opened(source, *args))
    assert _repeats.copies(source).count() == 19 * len(texts) + 2  # and of two texts the first of the twenty
    assert _repeats.squeezed(source).selectExpr("sum(octet_length(text))").first()[0] < 0.7 * sum(len(x) for _, x in rows)
    assert _repeats.with_twins(docs, "doc_id", "text").filter("twin <> 0").count() == 7


@pytest.mark.parametrize("module", [substring_bytes, substring_words])
def test_every_window_has_one_region_that_its_content_decides(module):
    r = random.Random(4)
    body = " ".join("".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(300))
    other = "zz yy " + body + " xx"
    chunk = T.column(__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array([body, other, "a " * 90])], ["text"]), "text")
    row, first, count, anchor, *_ = module.regions(*chunk)
    windows = [Counter() for _ in range(3)]
    anchors = [{}, {}, {}]
    for d, s, n, a in zip(row, first, count, anchor):
        for k in range(n):
            windows[d][s + k] += 1
            anchors[d][s + k] = a
    units = [len(x.encode()) if module is substring_bytes else len(x.split()) for x in (body, other, "a " * 90)]
    assert [sorted(w) for w in windows] == [list(range(n - 49)) for n in units] and max(max(w.values()) for w in windows) == 1
    shift = 6 if module is substring_bytes else 2
    assert all(anchors[1][s + shift] == a for s, a in anchors[0].items())


def test_suffix_order_is_sorted():
    r = random.Random(6)
    buf = np.frombuffer("".join(r.choice("ab") for _ in range(600)).encode(), np.uint8)
    start = np.array([r.randrange(0, 550) for _ in range(200)])
    group = np.sort(np.array([r.randrange(5) for _ in range(200)]))
    order = substring_bytes.suffix_order(buf, group, start)
    raw = buf.tobytes()
    got = [(group[k], raw[start[k] : start[k] + 50]) for k in order]
    assert sorted(order) == list(range(200)) and got == sorted(got)


# ---------------------------------------------------------------- byte-level BPE


def test_bpe_round_trip(docs, rows, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.K.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_decode(docs, path, P.PATTERN, offsets=True)
    want = Counter((i, np.array(library.encode_ordinary(x or ""), "<u4").tobytes(), (x or "").encode()) for i, x in rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect()) == want
    for r in out.limit(20).collect():
        assert b"".join(bytes(r["decoded"])[a:b] for a, b in r["offsets"]) == bytes(r["decoded"])
    again = bpe.decode(out.select("doc_id", "ids"), path, P.PATTERN)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in again.collect()) == want
    d = bpe.digests(out).filter("doc_id = 1").first()
    assert (d["n_tokens"], d["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode_decode(none, path, P.PATTERN).count() == 0


# ---------------------------------------------------------------- Ogg


def test_ogg_round_trip(docs, rows, none):
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in ogg.from_media(ogg.to_media(docs)).collect())
    pad = lambda b: b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
    assert got == Counter((i, len((x or "").encode()), pad((x or "").encode())) for i, x in rows)
    assert ogg.from_media(ogg.to_media(none)).count() == 0


@pytest.mark.parametrize("n", [64, 255 * 64, 16_000, 16_064, 65_024, 65_280, 300_032])
def test_ogg_pages(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.write(payload, b"note")
    s = ogg.read(media)
    assert b"".join(s[b"PCM8"]["packets"][1:]) == payload and s[b"NOTE"]["packets"][1] == b"note"
    assert s[b"PCM8"]["granules"][-1] == n
    for at in (5, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.read(media[: len(media) // 2])


def test_ogg_checksum_bit_by_bit():
    page = random.Random(1).randbytes(200)
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.checksum(page) == crc


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(x, n):
    import xxhash

    w = [y.lower() for y in words_of(x)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows, none):
    prints = [brute_fingerprint(x, 3) for _, x in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows))
    assert counted(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_find_all_close_fingerprints(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(40):
            b ^= 1 << r.randrange(64)
            fps.add(b)
            fps.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()

    def classes(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for x in fps:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    brute = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if bin(a ^ b).count("1") <= 2]
    assert classes([(a["a"] % (1 << 64), a["b"] % (1 << 64)) for a in edges]) == classes(brute)


def test_fingerprints_are_sparks_own_hash(spark):
    assert spark.sql("SELECT xxhash64('the of a') AS h").first()["h"] % (1 << 64) == brute_fingerprint("The of A", 3)


def test_near_copies_by_jaccard(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(150)]
        for edits in (0, 0, 1, 2, 3, 6, 20):
            t = list(base)
            for _ in range(edits):
                t[r.randrange(150)] = word()
            rows.append((k, " ".join(t)))
            k += 1
    rows += [(k, None), (k + 1, ""), (None, rows[0][1]), rows[3], rows[3]]
    sets = [frozenset(tuple(words_of(x)[j : j + 5]) for j in range(max(1, len(words_of(x)) - 4))) if words_of(x) else frozenset() for _, x in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if (u == 0) or len(sets[a] & sets[b]) / u >= 0.8:
                root[find(a)] = find(b)
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    keep = {(g["id"], g["text_key"]): (g["keep_id"], g["keep_key"]) for g in got}
    key = lambda x: hashlib.md5((x or "").encode()).hexdigest()
    wrong = 0
    for k, (i, x) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        wrong += keep[(i, key(x))][0] != min(ids)
    assert wrong == 0


def test_near_copies_around_one_original(spark):
    """Variants that are near copies of the original, and hardly ever of each other, are one class."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    original = [word() for _ in range(300)]
    rows = [(0, " ".join(original))]
    for k in range(1, 301):
        edited = list(original)
        for place in range(r.randint(2, 9), 300, 60):
            edited[place] = word()
        rows.append((k, " ".join(edited)))
    rows += [(k, " ".join(word() for _ in range(300))) for k in range(301, 321)]
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {g["id"]: g["keep_id"] for g in got} == {k: k if k > 300 else 0 for k, _ in rows}


# ---------------------------------------------------------------- token counts


def test_token_counts(docs, rows, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = counted(token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = Counter()
    for i, x in rows:
        n = len(model.encode(x or ""))
        want[(i, len((x or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0


def test_marks_inside_texts(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a▁ b", "▁", " ▁ ", "<s> </s><unk>", "a  b   ", " ", "  ", "x  y", "\0 a", "<0x41> b"]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {k: len(model.encode(x)) for k, x in enumerate(texts)}
