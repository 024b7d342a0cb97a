"""The pipeline's stages on a small table: what they must drop, and what they must leave alone."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

LETTERS = {"en": "abcdefgh", "fr": "éèçàuvwx"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda lang: "".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7)))
    long = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage = long("en", 80)
    rows, labels = [], []

    def add(text, lang="en", kind="clean"):
        rows.append((len(rows), text, lang, f"s{len(rows) % 3}", len(text or ""), kind))
        return len(rows) - 1

    for k in range(120):
        lang = "fr" if k % 3 == 0 else "en"
        labels.append((add(long(lang, 120), lang), 1))
    for k in range(60):
        labels.append((add(" ".join(word("en") + "***" for _ in range(80)), "en", "junk"), 0))
    for k in range(10):
        add(rows[k][1], rows[k][2], "copy")
        near = rows[k + 20][1].split()
        near[5] = "changed"
        add(" ".join(near), rows[k + 20][2], "near")
        add(long("en", 60) + " " + passage + " " + long("en", 60), "en", "passage")
    add(None, None, "empty"), add("", "en", "empty"), add("1234 5678 " * 30, "en", "empty"), add("one two", "en", "short")
    top = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string")
    df.drop("kind").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), {i: (kind, text) for i, text, _, _, _, kind in rows}, passage


def test_stages(spark, folder):
    top, kinds, passage = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, top)
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()} if name != "best-fit packing" else docs.toPandas()
        if name != "best-fit packing":
            assert docs.columns == pipeline.COLUMNS
    kept = lambda name, kind: [i for i in seen[name] if kinds[i][0] == kind]
    assert not kept("language ID", "empty") and len(kept("language ID", "clean")) == 120
    assert not kept("quality rules", "junk") and not kept("quality rules", "short") and len(kept("quality rules", "clean")) == 120
    near = "SimHash near-dedup"
    assert not kept(near, "copy") and not kept(near, "near") and len(kept(near, "clean")) == 120 and len(kept(near, "passage")) == 10
    texts = {i: r["text"] for i, r in seen["substring dedup"].items()}
    assert sum(passage in t for t in texts.values()) == 1
    assert all(texts[i] == kinds[i][1] for i in kept("substring dedup", "clean"))
    packed = seen["best-fit packing"]
    assert set(packed["doc_id"]) == set(texts) and packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run_and_empty_table(spark, folder, tmp_path):
    top, kinds, _ = folder
    assert pipeline.run(spark, top).select("doc_id").distinct().count() > 100
    spark.read.parquet(f"{top}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{top}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_leave_one(spark, folder):
    top, kinds, _ = folder
    docs = spark.read.parquet(f"{top}/documents.parquet").filter("doc_id < 3")
    out = pipeline.near_duplicates(spark, docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long"))), top)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2]


def test_stages_look_at_no_other_columns_and_read_long_texts(spark, folder):
    top, kinds, passage = folder
    r = random.Random(12)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(60_000))
    more = spark.createDataFrame([(900, f"{long} {passage}", None, None, 1), (901, f"{long[:400_000]}", "en", "s1", 2), (None, long[1000:3000], "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{top}/documents.parquet").unionByName(more)
    clash = {c: F.lit("x") for c in ("_id", "_key", "_first", "text_key", "n_words", "kept", "language", "rejected", "_text", "id", "host")}
    rows = lambda df: sorted(map(str, df.select(*pipeline.COLUMNS).collect()))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumns(clash), top)
        assert out.columns == pipeline.COLUMNS
        kept = {x["doc_id"]: x["text"] for x in out.collect()}
        if name == "substring dedup":
            assert passage not in kept[900] and kept[900].startswith(long[:100])
        if name in ("quality rules", "SimHash near-dedup"):
            assert kept[900].endswith(passage) and None in kept
        if name == "language ID":
            assert rows(out) == rows(stage(spark, docs, top))
    packed = pipeline.pack(spark, docs.withColumns(clash), top)
    assert {x["doc_id"] for x in packed.select("doc_id").distinct().collect()} == {*kinds, 900, 901, None}
