"""Token counts (operator 9): delta-maintained rollups.

A change of a document is a signed row: an insert adds its tokens, a delete takes them off, a
revised count does both. A batch of changes is summed by source, language and tokenizer
version before it is written; a batch appears under its own name by one rename, or not at all, so a batch that
is committed twice, again after a failure, or by two drivers at once counts once. Totals are sums over batches; compact() folds
them into one base, which remembers their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro.llm.common import delete_path, path_exists
from cirro.llm.wordtok import word_tokenizer

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def token_counts(docs: DataFrame, tokenizer_path: str, version: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of every row; the whole text counts, however long, a null one has 0 tokens.

    Null ids, sources and languages stay null, repeated rows come out as often as they came in, an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = word_tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            out = batch[["doc_id", "source", "lang"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["n_tokens"] = [len(raw) // 4 for at in range(0, len(texts), 64) for raw in tok.batch(texts[at : at + 64])]
            yield out

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    got = own.mapInPandas(run, "doc_id long, source string, lang string, n_tokens long")
    return got.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """counts: of the deleted documents, as they were inserted."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("d_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """A revised document moves from its old source, language, version and count to its new ones."""
    return deletes(old).unionAll(inserts(new))


class Rollup:
    """Totals kept at a path that all executors share.

    Null sources and languages are groups of their own. An empty batch is a batch: its name is taken. Batch
    names are any text. Repeated rows within a batch count as often as they occur. Other columns of a batch are not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _list(self) -> list[str]:
        """Names below the path, from one listing."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, written: str, name: str) -> bool:
        """Gives a written folder its name; False, and the folder goes, if there is one of that name."""
        jvm = self.spark.sparkContext._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in (written, name))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, none)
        except Exception:  # noqa: BLE001  whoever came first has the name
            if not path_exists(self.spark, f"{self.path}/{name}"):
                raise
            delete_path(self.spark, f"{self.path}/{written}")
            return False
        return True

    def _base(self, names: list[str]) -> tuple[int, set[str]]:
        """Number of the newest base (0: none) and the batches in it."""
        found = [int(n[5:]) for n in names if n.startswith("base=")]
        if not found:
            return 0, set()
        held = self.spark.read.schema("name string").parquet(f"{self.path}/base={max(found)}/names")
        return max(found), {r["name"] for r in held.collect()}  # a name for each batch

    def committed(self, batch: str) -> bool:
        return f"batch={quote(batch, safe='')}" in self.batches()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Writes the batch's sums and publishes them; False, and nothing is run, if that was done before.

        A batch whose writing broke off was never published, counts for nothing and is written anew.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("d_docs").cast("long").alias("d_docs"), F.sum("d_tokens").cast("long").alias("d_tokens"))
        written = f"_new-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{written}")
        return self._publish(written, f"batch={quote(batch, safe='')}")

    def batches(self) -> list[str]:
        names = self._list()
        return sorted(self._base(names)[1] | {n for n in names if n.startswith("batch=")})

    def _rows(self, names: list[str]) -> tuple[DataFrame, int, set[str]]:
        """Sums of the newest base and of the batches that aren't in it, that base's number, all batches."""
        number, held = self._base(names)
        new = [n for n in names if n.startswith("batch=") and n not in held]
        found = ([f"{self.path}/base={number}/sums"] if number else []) + [f"{self.path}/{n}" for n in new]
        rows = self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)
        return rows, number, held | set(new)

    def compact(self) -> None:
        """One base of all batches so far. The folders of batches that an earlier base held are deleted: whoever reads by that base no longer needs them."""
        names = self._list()
        rows, number, held = self._rows(names)
        earlier = self._base(names)[1]
        sums = rows.groupBy(*KEYS).agg(F.sum("d_docs").cast("long").alias("d_docs"), F.sum("d_tokens").cast("long").alias("d_tokens"))
        written = f"_new-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{written}/sums")
        self.spark.createDataFrame([(n,) for n in sorted(held)], "name string").coalesce(1).write.parquet(f"{self.path}/{written}/names")
        if self._publish(written, f"base={number + 1}"):
            for n in names:
                if n in earlier or (n.startswith("base=") and int(n[5:]) < number):
                    delete_path(self.spark, f"{self.path}/{n}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches; groups that are back to nothing are left out."""
        rows, _, _ = self._rows(self._list())
        out = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")
