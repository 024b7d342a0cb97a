"""A cleaning pipeline over ``documents``: language ID, quality rules, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. The stages drop: rows whose language stays uncertain or that have no letters; rows that fail the
quality base test or a learned rule; all but the least id of each class of copies and near copies (five-word shingles,
Jaccard similarity 0.8 or more); words of 50-word passages that a smaller id has too, and rows that this leaves empty.

Every stage looks at the columns of documents alone, whatever others a table has, reads texts whole however long they are,
takes a null text for an empty one, keeps rows apart that share an id, and makes an empty table of an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import langid, packing, quality, simhash, substring_words
from tracelake.llm._store import shared_folder
from tracelake.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of a key table that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000


def _key() -> F.Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows whose (doc_id, text key) are in ``dropped``."""
    keys = dropped.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (_key() == F.col("_key")), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose language is uncertain. Null and empty texts have no letters and go; null languages and sources
    count as a value of their own; of equally likely languages the first by name wins; repeated rows share their fate."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    rows = docs.select("doc_id", _key().alias("text_key"), F.col("lang").alias("declared"), F.col("source").alias("host"), "text")
    found = langid.identify(rows, model, "text", F.col("declared"), [F.col("host")])
    return _without(docs, simhash.cut(found.filter("rejected").select("doc_id", "text_key")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that fail the base test or a rule. Null and empty texts have no words and go; without labels of both
    kinds the base test alone decides; repeated rows share their fate."""
    docs = docs.select(*COLUMNS)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = quality.statistics(docs, carry=("text", "lang", "source", "n_chars"))
    return stats.filter(~quality.base_failed() & rules.verdict()).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of copies and near copies: that with the least id, null ids last; of equal ids the first by digest of its text,
    of whole rows that are repeated the first by their other columns. Null and empty texts are copies of one another."""
    docs = docs.select(*COLUMNS)
    rows = simhash.cut(simhash.similar_texts(docs, shingle=5, similarity=0.8))
    gone = rows.filter(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))))
    kept = _without(docs, gone.select(F.col("id").alias("doc_id"), "text_key").distinct())
    # of whole rows that stand in the table more than once, the first by their other columns stays
    again = rows.groupBy("id", "text_key").count().filter("count > 1").select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    again = simhash.cut(again)
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_key() == F.col("_key"))
    first = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("lang", "source", "n_chars"))
    once = kept.join(again, same).withColumn("_first", first).filter("_first = 1").select(*COLUMNS)
    return kept.join(again, same, "left_anti").select(*COLUMNS).unionByName(once)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated words. Null and empty texts have none and go only if words were removed; of rows that share an id none
    gives words up to the other; a passage stays in the row with the smallest id."""
    docs = docs.select(*COLUMNS)
    found = substring_words.remove_repeats(docs, carry=("lang", "source", "n_chars"), verify=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = found.filter((F.col("n_removed") == 0) | (F.col("kept") != "")).select("doc_id", text.alias("text"), "lang", "source", F.col("n_chars"), "n_removed")
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences. Null and empty texts are one piece, the end mark; repeated rows are packed each for
    themselves; ties between places are broken by ids."""
    docs = docs.select(*COLUMNS)
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)
    slim = pieces.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return packing.pack(slim, capacity=1024)


STAGES = [
    ("language ID", language),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs


#: Learned models and locally consistent parsing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None
