"""Items to catalogue products: exact keys, blocked fuzzy names, token overlap, and the cascade of them.

Each step works on distinct keys, so repeated names cost one comparison, and joins
back by key. Fuzzy candidates come from prefix filtering: with a fixed order of
bigrams, two sets with Dice above t share one of the first n - ceil(n t / (2 - t)) + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import learning_key

DICE = 0.82


def last_by_key(catalog: DataFrame, key: Column, product: str = "id") -> DataFrame:
    """(key, product): the catalogue's last product of each key that is not blank."""
    return catalog.select(key.alias("key"), product).where("key <> ''").groupBy("key").agg(F.max(product).alias("product"))


def bigrams(key: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    pairs = F.when(F.length(key) > 1, F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(pairs)


def fuzzy_top1(names: DataFrame, catalog: DataFrame, least: float = DICE) -> DataFrame:
    """(key, product, score) for names (key) against catalogue keys (key, product): Dice of bigram sets above `least`, best first, then lowest product.

    Bigrams are ordered by the number of catalogue keys that have them, so prefixes hold the rare ones.
    """
    firsts = catalog.groupBy("key").agg(F.min("product").alias("product"))
    right = firsts.select("key", "product", F.explode(bigrams(F.col("key"))).alias("g"))
    left = names.select("key").distinct().select("key", F.explode(bigrams(F.col("key"))).alias("g"))
    counts = right.groupBy("g").agg(F.count("*").alias("among"))

    def prefixed(grams: DataFrame, *by: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("among", F.lit(0)).alias("among"), "g")))
        sets = grams.join(counts, "g", "left").groupBy(*by).agg(F.transform(order, lambda s: s["g"]).alias("grams")).withColumn("n", F.size("grams"))
        return sets.withColumn("head", F.explode(F.slice("grams", F.lit(1), (F.col("n") - F.ceil(F.col("n") * (least / (2 - least)) - 1e-9) + 1).cast("int"))))

    left, right = prefixed(left, "key").alias("l"), prefixed(right, "key", "product").alias("r")
    fits = F.least("l.n", "r.n") * 2 > least * (F.col("l.n") + F.col("r.n"))
    pairs = left.join(right, (F.col("l.head") == F.col("r.head")) & fits)
    # a pair is checked at the first prefix element that it shares
    shared = F.array_intersect("l.grams", "r.grams")
    pairs = pairs.where(F.get(shared, F.lit(0)) == F.col("l.head"))
    score = 2 * F.size(shared) / (F.col("l.n") + F.col("r.n"))
    scored = pairs.select(F.col("l.key").alias("key"), "product", score.alias("score")).where(F.col("score") > least)
    return scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("product")).alias("low"))).alias("b")).select("key", (-F.col("b.low")).alias("product"), "b.score")


def overlap_top(names: DataFrame, catalog: DataFrame, k: int = 5, least: float = 0.32) -> DataFrame:
    """(name, other, overlap, rank): the k catalogue names that share most words, as a part of the smaller word set."""
    words = lambda c: F.array_distinct(F.filter(F.split(learning_key(F.col(c)), " "), lambda w: w != ""))
    left = names.select("name", words("name").alias("w")).select("name", F.size("w").alias("n"), F.explode("w").alias("word"))
    right = catalog.select(F.col("name").alias("other"), words("name").alias("w")).select("other", F.size("w").alias("m"), F.explode("w").alias("word"))
    common = left.join(right, "word").groupBy("name", "other").agg(F.count("*").alias("common"), F.min("n").alias("n"), F.min("m").alias("m"))
    scored = common.select("name", "other", (F.col("common") / F.least("n", "m")).alias("overlap")).where(F.col("overlap") >= least)
    # the rank's limit is applied before the shuffle too
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("overlap"), "other"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("name", "other", "overlap", F.col("rank").cast("long").alias("rank"))


def cascade(items: DataFrame, catalog: DataFrame, corrections: DataFrame) -> DataFrame:
    """Items with product, how and score: a learned correction, else the code, else the name, else the nearest name, else none.

    items: name_key, code_key; catalog: id, name_key, code_key; corrections: key, product.
    The fuzzy step sees only names that nothing before it has resolved.
    """
    code = last_by_key(catalog, F.col("code_key")).withColumnsRenamed({"key": "code_key", "product": "by_code"})
    name = last_by_key(catalog, F.col("name_key"))
    learned = corrections.groupBy("key").agg(F.max("product").alias("learned")).withColumnRenamed("key", "name_key")
    found = (
        items.join(learned, "name_key", "left").join(code, "code_key", "left")
        .join(name.withColumnsRenamed({"key": "name_key", "product": "by_name"}), "name_key", "left")
    )
    open_names = found.where("learned is null and by_code is null and by_name is null").select(F.col("name_key").alias("key"))
    first = catalog.groupBy(F.col("name_key").alias("key")).agg(F.min("id").alias("product"))
    near = fuzzy_top1(open_names, first).withColumnsRenamed({"key": "name_key", "product": "near", "score": "near_score"})
    found = found.join(near, "name_key", "left")
    steps = (("learned", "correction", F.lit(1.0)), ("by_code", "sku", F.lit(1.0)), ("by_name", "name", F.lit(0.95)), ("near", "fuzzy", F.col("near_score")))
    pick = lambda value: F.coalesce(*(F.when(F.col(c).isNotNull(), value(c, how, score)) for c, how, score in steps))
    return found.select(
        *items.columns, pick(lambda c, how, score: F.col(c)).alias("product"), F.coalesce(pick(lambda c, how, score: F.lit(how)), F.lit("none")).alias("how"),
        F.coalesce(pick(lambda c, how, score: score), F.lit(0.0)).alias("score"),
    )
