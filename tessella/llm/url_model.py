"""URL filter: path rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov models over the bytes of host and
path, one of accepted and one of rejected URLs. The chance of a byte after a
context of k bytes is (N(context, byte) + T * chance after the shorter context) /
(N(context) + T), down to a uniform chance; T is the smoothing weight. A URL's
figure is the difference of its two log-likelihoods divided by its length, and it
passes at or above a threshold calibrated on labelled URLs kept out of the counts.

All labelled URLs are counted, each context and each context with a byte by itself:
the counts are a Spark table with one row for each key of 64 bits, so nothing but
equal hashes ever shares a count, and the driver holds none of them. URLs are scored
in chunks of up to BATCH_ROWS rows. A chunk asks for the counts of each of its keys
once, by a join, and gets back those that were seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, mix, stage, utf8

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER, SMOOTHING, BINS, FOLDS, BATCH_ROWS = 5, 2.0, 400, 5, 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for a null or a URL without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(column: pa.Array, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each byte (and of a final end byte), hashes of `bits` bits of its contexts and of context and byte, by context length."""
    flat, at = utf8(column)
    n = np.diff(at)
    size = n + order + 1  # `order` start bytes before and one end byte after
    begin = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), dtype=np.uint64)
    rows = np.repeat(np.arange(len(n)), n)
    text[begin[rows] + order + (np.arange(len(flat)) - at[:-1][rows])] = flat.astype(np.uint64) + np.uint64(2)
    text[begin + size - 1] = 1
    row = np.repeat(np.arange(len(n)), n + 1)
    here = begin[row] + order + (np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1))
    context, both = np.empty((order + 1, len(row)), np.int64), np.empty((order + 1, len(row)), np.int64)
    h = np.full(len(row), np.uint64(7))
    for k in range(order + 1):
        if k:
            h = mix(h * np.uint64(0x100000001B3) + text[here - k])
        shift = np.uint64(64 - bits)
        context[k] = (mix(h + np.uint64(k)) >> shift).astype(np.int64)
        both[k] = (mix(h + np.uint64(k) + text[here] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    return row, context, both


def fit(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n0, n1: how often rejected and accepted URLs of (text, label) have each context and each context with a byte."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, context, both = _grams(batch.column(0), order, 64)
            label = batch.column(1).to_numpy(zero_copy_only=False)[row]
            keys, at = np.unique(np.concatenate([context, both]), return_inverse=True)
            of = np.tile(label, 2 * (order + 1))
            counts = [np.bincount(at.ravel()[of == v], minlength=len(keys)) for v in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, counts)], names=["key", "n0", "n1"])

    found = urls.select("text", "label").mapInArrow(work, "key long, n0 long, n1 long")
    return found.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _ratio(row: np.ndarray, rows: int, context: list[np.ndarray], both: list[np.ndarray], smoothing: float) -> np.ndarray:
    """Each row's ratio from the counts, by label, of the contexts of its bytes and of context and byte, by context length."""
    logs = []
    for v in (0, 1):
        chance = np.full(len(row), 1 / 258)
        for seen, met in zip(context[v], both[v], strict=True):
            chance = (np.minimum(met, seen) + smoothing * chance) / (seen + smoothing)
        logs.append(np.log(chance))
    each = np.bincount(row, logs[1] - logs[0], minlength=rows)
    return each / np.maximum(np.bincount(row, minlength=rows), 1)


def ratios(column: pa.Array, counts: np.ndarray, order: int, bits: int, smoothing: float) -> np.ndarray:
    """Length-normalised log-likelihood of accepted less that of rejected, from counts by hashes of `bits` bits."""
    row, context, both = _grams(column, order, bits)
    return _ratio(row, len(column), [counts[0, v][context] for v in (0, 1)], [counts[1, v][both] for v in (0, 1)], smoothing)


def _chunked(rows: DataFrame) -> DataFrame:
    """The rows, written once, with a `chunk`: at most an Arrow batch of rows has the same."""
    names = [*rows.columns, "chunk"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, first + i))], names=names)

    return stage(rows.mapInArrow(work, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", chunk long"), "urls")


def scored(urls: DataFrame, counts: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """All columns of chunked URLs but `chunk` and `text`, and `ratio`, from the counts that fit() gives."""
    rest = [c for c in urls.columns if c not in ("chunk", "text")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy()
            for chunk in np.unique(of):
                _, context, both = _grams(batch.column(1).filter(pa.array(of == chunk)), order, 64)
                keys = np.unique(np.concatenate([context, both]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys)], names=["chunk", "key"])

    def work(rows: pa.Table, held: pa.Table) -> pa.Table:
        row, context, both = _grams(rows.column("text"), order, 64)
        keys = held.column("key").to_numpy()
        by_key = np.argsort(keys)
        # one more place, for keys that were never counted
        keys, counts = keys[by_key], [np.append(held.column(n).to_numpy()[by_key], 0) for n in ("n0", "n1")]

        def at(wanted: np.ndarray) -> np.ndarray:
            i = np.searchsorted(keys, wanted)
            return np.where(np.append(keys, 0)[i] == wanted, i, len(keys)) if len(keys) else np.zeros_like(i)

        in_context, in_both = at(context), at(both)
        found = _ratio(row, rows.num_rows, [n[in_context] for n in counts], [n[in_both] for n in counts], smoothing)
        return rows.select(rest).append_column("ratio", pa.array(found))

    held = urls.select("chunk", "text").mapInArrow(asked, "chunk long, key long").distinct().join(counts, "key")
    kinds = ", ".join(f"`{c}` {k}" for c, k in urls.select(*rest).dtypes)
    return urls.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(work, f"{kinds}, ratio double")


def threshold(ratio_label: DataFrame) -> float:
    """The bound with the best balanced accuracy, from a histogram of BINS bins a label."""
    span = 4.0
    cell = F.least(F.greatest(F.floor((F.col("ratio") + span) / (2 * span) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = ratio_label.groupBy("label", cell.alias("cell")).agg(F.count("*").alias("n")).collect()
    seen = np.zeros((2, BINS))
    for r in rows:
        seen[r["label"], r["cell"]] += r["n"]
    if not seen.sum(axis=1).all():
        return 0.0
    kept = 1 - np.concatenate([[0], np.cumsum(seen[1])]) / seen[1].sum()
    stopped = np.concatenate([[0], np.cumsum(seen[0])]) / seen[0].sum()
    good = np.flatnonzero(kept + stopped >= (kept + stopped).max() - 1e-12)
    edges = -span + np.arange(BINS + 1) * 2 * span / BINS
    return float(edges[good[np.argmin(np.abs(edges[good]))]])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio for every row.

    A rule's verdict counts where one fits, the longest; other URLs are allowed if
    their ratio is at or above the threshold. Labelled URLs are those that a rule
    decides: four folds by a hash of the URL are counted, the fifth sets the
    threshold. Without labels of both kinds the threshold is 0 and the ratio that of
    the counts there are. A null URL or one without '://' has an empty host and path
    and the ratio of an empty text. Repeated rows stay; an empty table gives none.
    """
    arrow_rows(pages.sparkSession, BATCH_ROWS)
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"), F.concat("host", "path").alias("text"))
    urls = _chunked(ruled.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))))
    label = (F.col("decided") == "allow").cast("int").alias("label")
    counts = fit(urls.where("decided is not null and fold <> 0").select("text", label))
    found = stage(scored(urls, counts), "ratios")
    bound = threshold(found.where("decided is not null and fold = 0").select("ratio", label))
    by_model = F.when(F.col("ratio") >= bound, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "ratio")
