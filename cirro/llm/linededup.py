"""Line dedup (operator 7), DataFrame functions only.

Each line gives two 64-bit hashes of its key, its document and its position. These narrow
rows, never the text, are range-partitioned by hash and sorted by document and position
inside a hash; a running first() streams over them, so no group is held in memory. What comes
back is a compressed bitmap of kept lines per document: its 64-bit words that miss a line, the others being
all ones. Keys with more rows than a quarter of a partition's share are found by a bounded sketch, get
their first document by a partial aggregation and are decided by a broadcast of a few rows for each
partition, so they're never dealt to a task by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro.llm.common import fresh, materialize

#: A key is hot from 1 / SHARE of a partition's rows on, so there are at most SHARE for each partition. TRACKED: what the sketch counts for each hot key; it takes a million at most.
SHARE, TRACKED, MOST = 4, 32, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: U+0020 and U+0009 to U+000D.
_STRIP = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_STRIP)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """doc, th (hash of the text, so that rows of one id stay apart), pos, h1, h2 of each line that may be dropped."""
    at = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("text"))
    lines = at.select("doc", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, th, n_dropped, keeps of each document that loses lines; keeps: array of (word, bits) by rising word, bit b of word w for line 64 w + b, words that are all ones left out."""
    spark = docs.sparkSession
    lines = materialize(line_hashes(docs, min_chars, id_col, text_col), "line-hashes")
    # as many ranges as the session shuffles to
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(SHARE * parts, MOST // TRACKED)
    n, top = lines.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h1, {most}, {TRACKED * most})")).first()
    hot = [(r["item"],) for r in top or [] if r["count"] * most >= n and r["count"] > 1000]
    w = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = lines
    if hot:
        # at most `most` rows
        keys = F.broadcast(spark.createDataFrame(hot, "h1 long"))
        cold = lines.join(keys, "h1", "left_anti")
    cold = cold.repartitionByRange(parts, "h1")
    drop = cold.withColumn("first_doc", F.first("doc").over(w)).where("doc > first_doc").select("doc", "th", "pos")
    if hot:
        own = lines.join(keys, "h1", "left_semi")
        firsts = own.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
        again = own.join(F.broadcast(firsts), ["h1", "h2"]).where("doc > first_doc").select("doc", "th", "pos")
        drop = drop.unionAll(again)
    bit = F.expr("shiftleft(1L, pos % 64)")
    word = drop.groupBy("doc", "th", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("lost"))
    return word.groupBy("doc", "th").agg(F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keeps"))


def expand(keeps: Column) -> Column:
    """The words of a compressed bitmap one by one, up to the last that misses a line; a line is so looked up by its place."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(keeps, i - 1)["word"])
    ones = lambda n: F.array_repeat(F.lit(-1).cast("long"), n)
    return F.flatten(F.transform(keeps, lambda k, i: F.concat(ones(k["word"] - before(i) - 1), F.array(k["bits"]))))


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns n_lines, n_dropped, kept_text (renamed with underscores where docs has such names).

    A line's key is the line stripped of U+0020 and U+0009 to U+000D with A-Z lower-cased; keys of at least
    min_chars code points held by two or more ids lose their lines in all but the smallest id. A null or
    empty text is one empty line and its kept text is empty. Rows with a null id stay whole and
    count for no key. Repeated rows of one id lose the same lines; all lines of the smallest id stay,
    repeats too. An empty table gives no rows. Other columns pass through. A very long text costs in proportion
    to its lines.
    """
    maps = keep_bitmaps(docs, min_chars, id_col, text_col).select(F.col("doc").alias("_bm_doc"), F.col("th").alias("_bm_th"), F.col("n_dropped").alias("_bm_n"), expand(F.col("keeps")).alias("_bm_keeps"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    joined = docs.join(maps, (docs[id_col] == maps["_bm_doc"]) & (F.xxhash64(docs[text_col].cast("string")) == maps["_bm_th"]), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: F.coalesce(F.get(F.col("_bm_keeps"), F.floor(i / 64).cast("int")), F.lit(-1).cast("long")).bitwiseAND(_bit(i)) != 0)
    names = {c: fresh(docs.columns, c) for c in ("n_lines", "n_dropped", "kept_text")}
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.size(lines).cast("long").alias(names["n_lines"]),
        F.coalesce("_bm_n", F.lit(0)).cast("long").alias(names["n_dropped"]),
        F.when(F.col("_bm_keeps").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(names["kept_text"]),
    )


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)).cast("int"))
