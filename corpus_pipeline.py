"""A training corpus from `documents`, in five stages; each is written as Parquet and read again by the next.

language: documents whose language can't be told go (no text, no letter, or no language clearly ahead).
lines: lines that an earlier document has go.
near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more of their word shingles, one row stays, that of the smallest id.
benchmark: documents with a passage of the benchmark go.
packing: what is left is cut into pieces and packed into sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro.llm import decontam, langid, linededup, packing, queries, simhash
from cirro.llm.common import fresh, shared_path, table

#: Below this multiple of what equal languages have (and below 0.6 at least) no language is clearly ahead.
AHEAD, ENOUGH = 1.2, 0.6
#: Five words a shingle. A Jaccard similarity of 0.8 is a cosine of at least 0.89, at which 39 of 256 bits differ on
#: average with a deviation of 6 (48 for sets of four and five); 76 only proposes pairs, whose sets are then compared.
SHINGLE, WIDTH, RADIUS, SIMILARITY = 5, 4, 76, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told. Null and empty texts and those without a letter go; an empty table gives none; columns named like the helpers' stay."""
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    model = queries.language_model(docs)
    out = langid.predict(docs, model, names=(pred, score))
    return out.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= min(ENOUGH, AHEAD / max(1, len(model.langs))))).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without repeated lines and its n_chars counted anew. A null text becomes an empty one, rows without id stay whole, repeated rows lose the same lines."""
    out = linededup.dedup_lines(docs)
    kept = out.columns[-1]
    now = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return out.select(*[now[c].alias(c) if c in now else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that are alike stays; an id that is given twice doesn't take its other texts along."""
    return simhash.keep_one(docs, SIMILARITY, shingle=SHINGLE, width=WIDTH, radius=RADIUS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null and empty texts stay, repeated rows fare alike."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their sequences; a null text is packed as an empty one, repeated rows have pieces each."""
    return packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", pack)]

#: Language models, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents; the stages between are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
