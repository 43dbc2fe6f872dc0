"""The corpus pipeline over ``documents``: STAGES in order, each working on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, jaccard, langid, linechunks, queries
from strandline.llm.work import Scope, dropped, new_path, released, saved


#: Keys of dropped documents that are broadcast at most; more are joined.
BROADCAST_KEYS = 1_000_000


def _few(keys: DataFrame) -> DataFrame:
    """A table of keys, marked for broadcast if it is small: texts then stay where they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without any letter. Sets lang to the predicted one.

    The network is fitted on labelled rows of docs as op10's is; where there are none, documents with letters stay as they are.
    """
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = langid.predict(docs, net)
    if net is None:
        return found.where(F.col("text").rlike(r"\p{L}")).select(docs.columns)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of lines out of every later copy; a document of which only blank lines are left goes. Updates n_chars."""
    found = linechunks.deduplicated(docs, removed="_removed_lines")
    some = (F.col("_removed_lines") == 0) | F.col("text").rlike(r"\S")
    return found.where(some).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram overlap, the one with the smallest doc_id stays.

    Where a doc_id is null or repeated, groups are made of numbered rows: different texts that share a doc_id
    stay, and rows without one are near duplicates as others are; one stays only if its whole group has none.
    """
    columns = docs.columns
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1):
        found = saved(jaccard.groups(docs), "groups", new_path(spark, "groups"))
        gone = found.where("component <> doc_id").select("doc_id")
        return docs.join(_few(gone), "doc_id", "left_anti").select(columns)
    docs = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered", new_path(spark, "numbered"))
    found = saved(jaccard.groups(docs, key="_row"), "groups", new_path(spark, "groups"))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row")
    stays = docs.select("_row", "doc_id").join(found, "_row").groupBy("component").agg(F.min(order)["_row"].alias("_row")).select("_row")
    return docs.join(stays, "_row", "left_semi").select(columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth of the words stand in benchmark windows."""
    with Scope(spark) as scope:
        found = decontaminate.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scope=scope)
        gone = saved(found.where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated")
    released(spark)
    return docs.join(_few(gone), "doc_id", "left_anti").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, as op9's."""
    return queries.encoded_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: Recurrent networks, small-threshold joins of n-grams and BPE can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        at = new_path(spark, f"stage-{name}")
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", at)
        if last:
            dropped(spark, last)
        last = at
        released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
