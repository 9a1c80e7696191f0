"""The training-data pipeline: STAGES over documents, each written as Parquet and read again by the next.

1. toxicity: documents that the ordinal regression calls toxic go.
2. exact_dedup: of texts that are equal but for white space, one document stays.
3. near_dedup: of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, the smallest id stays.
4. mixing: documents are drawn so that tokens approach tempered shares of source, language and topic.
5. bpe: token ids of the documents that are left, and digests of them and of the text they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfacet.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from sparkfacet.llm._spark import checkpoint_dir, delete, own_tables, ship, written
from sparkfacet.llm.queries import table, tokenizer_path


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name with as many _ as it takes to be none of the columns'."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fit_severity(docs, table(spark, sf_dir, "labels"))
    into = free_name(docs, "severity")
    return toxicity.with_severity(docs, model, into=into).filter(~F.col(f"{into}.toxic")).drop(into)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group, a null id coming last. Rows are told apart by id and text: unlike rows of one id are
    decided apart, and of rows with equal id and text one stays. Only keys are written and joined, never texts."""
    ship(spark)
    columns = docs.columns
    text = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), text.alias("text"))
    groups = written(ngram_join.jaccard_components(docs.select(key.alias("key"), "text"), id_col="key").select("key", "component_id"))
    gone = groups.filter("component_id < key").select(F.col("key").alias("__gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), key.alias("key"))
    stay = rows.join(gone, F.col("key") == F.col("__gone"), "left_anti")
    again = written(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("__again")))
    if again.isEmpty():
        return stay.select("row.*")
    twice = F.col("key") == F.col("__again")
    return stay.join(again, twice, "left_anti").select("row").unionByName(stay.join(again, twice, "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    into = free_name(docs, "mix")
    return mixing.with_mixture(docs, into=into).filter(F.col(f"{into}.selected")).drop(into)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256."""
    ship(spark)
    encoded = bpe.encode_decode(docs, tokenizer_path())
    return bpe.digests(encoded, "doc_id", "token_ids")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix), ("bpe", encode)]

#: The ordinal regression and the tokenizer aren't SQL; tests/llm holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's output goes once the next one is written, and what a stage writes on its way with it.

    Cases: null, empty and long texts, null ids, repeated rows and an empty table as each operator states; columns of
    documents pass all stages but the last, whatever their names (stages look up free names for their own)."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-{name}"
        with own_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
