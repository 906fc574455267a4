"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes is reduced to one row a group, written aside and moved to its
place in one step, which is the commit: of two writers of one batch the later one
finds it there. A batch that is committed already is left alone, so replaying a feed
changes nothing, and a write that was cut off leaves nothing behind that is read.
Totals are kept as a table: `maintain` adds the batches committed since to the last
totals and commits the sum together with the ids of all batches in it. Readers add
the batches that came later. Batches may come in any order.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tokens import default_path, token_counts

KEYS = ("source", "lang", "tokenizer_version")
MEASURES = ("docs", "tokens", "chars")


def inserts(counts: DataFrame) -> DataFrame:
    """Change rows that add documents: op, the keys, and new and old figures."""
    return counts.select(F.lit("insert").alias("op"), *KEYS, "n_tokens", "n_chars", F.lit(None).cast("long").alias("old_tokens"), F.lit(None).cast("long").alias("old_chars"))


def deletes(counts: DataFrame) -> DataFrame:
    """Change rows that take documents away."""
    none = F.lit(None).cast("long")
    return counts.select(F.lit("delete").alias("op"), *KEYS, none.alias("n_tokens"), none.alias("n_chars"), F.col("n_tokens").alias("old_tokens"), F.col("n_chars").alias("old_chars"))


def revisions(counts: DataFrame, old_tokens: Column) -> DataFrame:
    """Change rows that put the counts in the place of an older number of tokens."""
    return counts.select(F.lit("revise").alias("op"), *KEYS, "n_tokens", "n_chars", old_tokens.cast("long").alias("old_tokens"), F.col("n_chars").alias("old_chars"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by group of changes: inserts count their new figures, deletes their old ones, revisions the difference.

    A null figure counts as 0, a null key is a group of its own, any other op is an
    error. Equal rows are separate changes.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))).cast("long")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    now, old = F.col("op") != "delete", F.col("op") != "insert"
    moved = lambda new, was: F.when(now, n(new)).otherwise(0) - F.when(old, n(was)).otherwise(0)
    return (
        changes.select(*KEYS, sign.alias("docs"), moved("n_tokens", "old_tokens").alias("tokens"), moved("n_chars", "old_chars").alias("chars"))
        .groupBy(*KEYS)
        .agg(*(F.sum(m).alias(m) for m in MEASURES))
    )


class Ledger:
    """Committed deltas and maintained totals below a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, kind: str) -> list[str]:
        """Names of committed folders of a kind, from one listing."""
        fs, p = self._fs(f"{self.path}/{kind}=*/_SUCCESS")
        found = fs.globStatus(p)
        return sorted(s.getPath().getParent().getName().removeprefix(f"{kind}=") for s in found or [])

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Write aside, then move in one step; False if another writer was first."""
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        sc = self.spark.sparkContext
        fs, source = self._fs(aside)
        _, target = self._fs(f"{self.path}/{name}")
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            fs.delete(source, True)
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        fs, p = self._fs(f"{self.path}/batch={batch_id}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch_id: str, changes: DataFrame, verify: bool = False) -> bool:
        """Apply a batch once; False if it was there already. With `verify`, a batch of other content under a committed id is an error."""
        if not self.committed(batch_id):
            return self._publish(deltas(changes), f"batch={batch_id}")
        if verify:
            known, now = self._rows([f"batch={batch_id}"]), deltas(changes)
            if not known.exceptAll(now).union(now.exceptAll(known)).isEmpty():
                raise ValueError(f"batch {batch_id} is committed with other content")
        return False

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return self._names("batch")

    def _rows(self, names: list[str]) -> DataFrame:
        schema = ", ".join([*(f"{k} string" for k in KEYS), *(f"{m} long" for m in MEASURES)])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _state(self) -> tuple[list[str], list[str]]:
        """Folders whose sums are the totals, and the ids of the batches in the maintained ones: the latest version, and batches that came later."""
        versions, batches = self._names("totals"), self.batches()
        if not versions:
            return [f"batch={b}" for b in batches], []
        held = [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/held={versions[-1]}").collect()]  # one name a batch
        return [f"totals={versions[-1]}", *(f"batch={b}" for b in batches if b not in set(held))], held

    def maintain(self) -> None:
        """Add the batches committed since to the maintained totals.

        What is added and what is named as held come from one listing, so a batch that is committed meanwhile is left for the next time.
        A version whose totals were lost with the driver is passed over.
        """
        folders, held = self._state()
        added = [f.removeprefix("batch=") for f in folders if f.startswith("batch=")]
        if not added:
            return
        version = f"{max(map(int, self._names('totals') + self._names('held')), default=-1) + 1:012d}"
        # the batches' names first: totals without them are never read
        if self._publish(self.spark.createDataFrame([(b,) for b in held + added], "batch string").coalesce(1), f"held={version}"):
            self._publish(self._sums(self._rows(folders)), f"totals={version}")

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def totals(self) -> DataFrame:
        """The keys with docs, tokens and chars; groups that have come down to nothing are left out."""
        return self._sums(self._rows(self._state()[0]))


def document_counts(docs: DataFrame, version: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens and n_chars (code points) of every document."""
    plain = docs.select("doc_id", "source", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "text")
    counted = token_counts(plain, "text", tokenizer or default_path())
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "n_chars")
