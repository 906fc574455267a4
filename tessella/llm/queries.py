"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import align, bpe, dac, embed_dup, fingerprints, impact_search, lm_score, mixing, near_dup, packing, rollups, toxicity, url_model
from tessella.llm.common import scratch_path, stage, text_key
from tessella.llm.tokens import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_digests(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through every kind of change, each batch committed twice to one effect.

    Documents come in under an estimate (a quarter of their characters) for an older version,
    move to the present one by deletes and inserts, and are revised to their counts; in
    between the totals are maintained. What is left are all documents with their counts.
    """
    counts = stage(rollups.document_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k"), "counts")
    guess = F.floor(F.col("n_chars") / 4)
    guessed = counts.withColumn("n_tokens", guess)
    old = guessed.withColumn("tokenizer_version", F.lit("estimate"))
    ledger = rollups.Ledger(spark, scratch_path(spark, "ledger"))
    for name, changes in (("arrived", rollups.inserts(old)), ("moved", rollups.deletes(old).union(rollups.inserts(guessed))), ("counted", rollups.revisions(counts, guess))):
        for _ in range(2):
            ledger.commit(name, changes)
        if name == "moved":
            ledger.maintain()
    return ledger.totals()


def op5_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 tokens; equal texts, near-duplicates (five-word shingles, 0.8) and more than two documents of a source never share one."""
    docs = table(spark, sf_dir, "documents").withColumn("text_id", F.xxhash64("text"))
    # near_duplicates lower-cases A-Z; texts that differ in the case of other letters only are found by a key, which ASCII texts need not have
    key = F.when(F.octet_length("text") > F.length("text"), text_key(F.col("text")))
    keyed = docs.select("doc_id", "source", key.alias("key"), "text_id", "text")
    lengths = stage(token_counts(keyed).withColumn("n_tokens", F.col("n_tokens") + 1), "lengths")
    # by the text, not the id, so that rows without an id and different texts under one id have their own clusters; texts without words are equal
    cluster = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(0)
    found = near_dup.near_duplicates(docs, id_col="text_id").groupBy(F.col("doc_id").alias("text_id")).agg(F.min(cluster).alias("cluster"))
    clustered = stage(lengths.join(found, "text_id").drop("text_id"), "clustered")
    same = clustered.where("key is not null").groupBy("key").agg(F.min("cluster").alias("same"), F.max("cluster").alias("most"))
    same = stage(same.where("same < most").select("key", "same"), "same")
    if not same.isEmpty():
        joined = clustered.where("key is not null").join(same, "key", "left").withColumn("cluster", F.coalesce("same", "cluster"))
        clustered = stage(joined.select(*clustered.columns).union(clustered.where("key is null")), "clustered")
    return packing.best_fit(clustered)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 65,536 characters; each source weighs as the square root of its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    docs = stage(docs, "sizes")
    weights = mixing.tempered_weights(docs, size=F.col("size"))
    period = mixing.period_for(mixing.source_sizes(docs, size=F.col("size")), weights, 65_536)
    return mixing.schedule(docs, weights, 65_536, period, size=F.col("size"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_dup, op3_token_files, op4_token_counts, op5_embedding_dup, op6_packing, op7_mixing, op8_url_filter, op9_fingerprints, op10_lm_score, op11_bpe, op12_lexical_search, op13_alignment)}
#: Plain SQL over all pairs, for small tables; the others need a trained model, hashes, a scheduler or a tokenizer.
_REACH = """reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a), lowest as (select a, least(a, min(b)) as low from reach group by a)"""
ORACLES: dict[str, str] = {
    "op2_near_dup": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) as s from w),
n as (select doc_id, len(s) as n from s), e as (select doc_id, unnest(s) as g from s),
c as (select x.doc_id as a, y.doc_id as b, count(*) as m from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
both_ways as (select a, b from links union all select b, a from links), {_REACH}
select n.doc_id, CAST(n.n AS BIGINT) as n_shingles, coalesce(low, n.doc_id) as component_id, coalesce(low, n.doc_id) = n.doc_id as kept from n left join lowest on a = n.doc_id""",
    "op5_embedding_dup": f"""with recursive v as (select vec_id, CAST(embedding AS DOUBLE[]) as e from embeddings where embedding is not null and len(embedding) > 0),
g as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from g x join g y on x.vec_id < y.vec_id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95::DOUBLE),
both_ways as (select a, b from links union all select b, a from links), {_REACH}, counts as (select a, count(*) as c from both_ways group by 1)
select vec_id, coalesce(c, 0) as n_links, coalesce(low, vec_id) as component_id, coalesce(low, vec_id) = vec_id as kept from embeddings left join lowest l on l.a = vec_id left join counts k on k.a = vec_id""",
    "op12_lexical_search": """with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
totals as (select count(*) as nn, sum(len(w)) as ll from d where len(w) > 0),
p as (select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from d) group by all),
df as (select t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) as weight from p, totals group by t),
q as (select i, item_id, t, count(*) as reps from (select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from benchmark) group by all),
s as (select i, item_id, r, doc_id, CAST(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 8 * CAST(25 + (75 * n * nn) // ll AS BIGINT)))) AS BIGINT) as score from q join df using (t) join p using (t), totals group by all),
o as (select item_id, CAST(row_number() over (partition by i order by score desc, doc_id nulls last) AS INTEGER) as rank, doc_id, score from s where score > 0)
select * from o where rank <= 10""",
}
