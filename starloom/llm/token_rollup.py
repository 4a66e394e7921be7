"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A change inserts, deletes or revises the token count of a document under a tokenizer version; a batch of
changes is summed per group into signed totals and committed once under its id. Totals are additive, so
they are the sum of what is committed, and no document is read again. A commit is the completion marker of
the folder of its batch: a batch that is sent again is skipped, and one that failed half way is written anew.
A snapshot sums committed batches and names them, so readers take it and the batches that came later.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
CHANGE_SCHEMA = "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizers that SQL can express: words between white space, and runs of letters, of digits or of marks.
WORDS, RUNS = "words/1", "runs/1"
PATTERNS = {
    WORDS: r"[^\x20\x09-\x0D]+",
    RUNS: r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+",
}


def count_tokens(text: Column | str, tokenizer: str) -> Column:
    """Tokens of a text; none of a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[tokenizer])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Signed totals of each group. A revision counts the difference of its counts; null counts are zero.

    ``op`` is insert, delete or revise; any other value, null included, is an error. Null groups are groups.
    Further columns are not read.
    """
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("no such change: "), F.coalesce("op", F.lit("null"))))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old)
    return changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Committed batches below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _complete(self, kind: str) -> list[str]:
        """Names of complete folders: batches or snapshots (one for each commit since the last clean-up)."""
        fs, root = self._fs(f"{self.path}/{kind}")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.path}/{kind}/{n}/_SUCCESS")[1]))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the batch; False if it is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r} is no plain name")
        if batch_id in self.batches():
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
        return True

    def batches(self) -> list[str]:
        """Ids of all committed batches, those of the last snapshot included."""
        return sorted({*self._complete("batches"), *self._snapshot()[1]})

    def _snapshot(self) -> tuple[str | None, list[str]]:
        names = self._complete("snapshots")
        if not names:
            return None, []
        ids = self.spark.read.schema("batch_id string").parquet(f"{self.path}/snapshots/{names[-1]}/ids")
        return names[-1], [r["batch_id"] for r in ids.collect()]

    def _sum(self) -> DataFrame:
        snapshot, held = self._snapshot()
        paths = [f"{self.path}/batches/{b}" for b in self._complete("batches") if b not in set(held)]
        if snapshot:
            paths.append(f"{self.path}/snapshots/{snapshot}/totals")
        if not paths:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        deltas = self.spark.read.schema(DELTA_SCHEMA).parquet(*paths)
        return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all groups that still have documents or tokens."""
        return self._sum().where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Writes a snapshot of all committed batches; batches stay, so that a sent-again one is known."""
        ids, number = self.batches(), len(self._complete("snapshots"))
        folder = f"{self.path}/snapshots/{number:08d}"
        self._sum().write.mode("overwrite").parquet(f"{folder}/totals")
        self.spark.createDataFrame([(b,) for b in ids], "batch_id string").write.mode("overwrite").parquet(f"{folder}/ids")
        fs, marker = self._fs(f"{folder}/_SUCCESS")
        fs.create(marker, True).close()
