"""Documents to packed training sequences: toxicity, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import mixing, near_dup, packing, toxicity
from tessella.llm.common import stage, text_key
from tessella.llm.tokens import token_counts

#: Characters in a block of the mix, and the power of a source's size that is its weight.
BLOCK, TEMPER = 65_536, 0.5
#: Not SQL: the first stage is a trained grammar, so run() is held against a plain version in the tests.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; the model is fitted on the labels beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.rejected(docs, model, keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (five-word shingles, 0.8).

    Documents without an id all stay. Different texts under one id are documents of their own; all but one of them count as later than any id.
    """
    known, text = docs.where("doc_id is not null"), F.xxhash64("text")
    texts = known.groupBy("doc_id").agg(F.min(text).alias("first_text"), F.max(text).alias("last_text"))
    shared = stage(texts.where("first_text <> last_text").select("doc_id", "first_text"), "shared-ids")
    own = known.withColumn("own_id", F.col("doc_id"))
    if not shared.isEmpty():
        top = known.agg(F.max("doc_id")).first()[0]
        later = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(top + 1)
        own = known.join(shared, "doc_id", "left").withColumn("own_id", F.when(text != F.col("first_text"), later).otherwise(F.col("doc_id")))
    kept = near_dup.near_duplicates(own, id_col="own_id").where("kept").select(F.col("doc_id").alias("own_id"))
    one = own.join(kept, "own_id", "left_semi").dropDuplicates(["own_id"])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The part of the mix with the target shares only: it ends where the first source does. Not a stage, as it drops the rest."""
    sized = stage(docs.select("doc_id", "source", F.length("text").alias("size")), "sizes")
    weights = mixing.tempered_weights(sized, TEMPER, size=F.col("size"))
    if not weights:
        return docs
    placed = mixing.schedule(sized, weights, BLOCK, size=F.col("size")).where("in_mix").select("doc_id", "slot", "block_no")
    return docs.join(placed.dropDuplicates(["doc_id"]), "doc_id").repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "doc_id").select(*docs.columns)


def order_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix. A source that has ended leaves its slots to the others, which keep their shares of each other.

    Documents of sources without any text have no slot and come last. Rows with null or equal ids are placed by their text.
    """
    key = F.xxhash64("doc_id", F.coalesce("source", F.lit("")), "text")
    sized = stage(docs.select(key.alias("mix_key"), "source", F.length("text").alias("size")), "sizes")
    weights = mixing.tempered_weights(sized, TEMPER, size=F.col("size"))
    if not weights:
        return docs
    period = mixing.period_for(mixing.source_sizes(sized, size=F.col("size")), weights, BLOCK)
    placed = mixing.schedule(sized, weights, BLOCK, period, id_col="mix_key", size=F.col("size"))
    slots = placed.groupBy(F.col("doc_id").alias("mix_key")).agg(F.min("slot").alias("slot"))
    order = F.col("slot").asc_nulls_last(), F.col("doc_id"), F.col("mix_key")
    return docs.withColumn("mix_key", key).join(slots, "mix_key", "left").repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows with `file_no` and `row_no`, which sort as the rows were written.

    A table that is read back comes with its largest files first, so its order is that of the files' names and of
    the rows in each; other rows have the order of their plan.
    """
    if docs.inputFiles() and "_metadata" not in docs.columns:
        try:
            return docs.select("*", F.col("_metadata.file_name").alias("file_no"), F.col("_metadata.row_index").alias("row_no"))
        except AnalysisException:  # not a table as it was read
            pass
    at = F.monotonically_increasing_id()
    return docs.withColumn("at", at).select(*docs.columns, F.lpad(F.shiftright("at", 33).cast("string"), 10, "0").alias("file_no"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row_no"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens, with an end token, go in sequences of 4,096: a shard packs consecutive documents of the mix, so sequences come in its order."""
    placed = in_order(docs).select("doc_id", "source", text_key(F.col("text")).alias("cluster"), "file_no", "row_no", "text")
    lengths = stage(token_counts(placed).withColumn("n_tokens", F.col("n_tokens") + 1), "lengths")
    before = F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    starts = lengths.groupBy("file_no").agg((F.max("row_no") + 1).alias("n")).select("file_no", F.coalesce(before, F.lit(0)).alias("before"))
    return packing.best_fit(lengths.join(F.broadcast(starts), "file_no").withColumn("place", F.col("before") + F.col("row_no")), order_col="place")


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("mixing", order_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
