"""Sharding (operator 4), DataFrame functions only: runs of a Hilbert curve through the metadata.

Language, source and size are quantised to `BITS` bits each, names in their own order, the curve index of the cell is the
sort key, ties go by text_crc32 and doc_id, and the sorted rows are cut into runs of equal
count. A shard so covers a small box in all three dimensions, and min/max statistics prune
files on any of them. Law: rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro.llm.common import materialize

DIMS, BITS = 3, 8
#: As many different names a task ranks; more go to more tasks. Ranks don't depend on it.
MOST_NAMES = 65_536


def hilbert_table(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """Curve position and next state for state * 2^dims + cell, by the entry-point and direction rule of compact Hilbert indices."""
    size, mask = 1 << dims, (1 << dims) - 1
    gray = lambda i: i ^ (i >> 1)
    back = {gray(i): i for i in range(size)}
    right = lambda x, k: ((x >> k % dims) | (x << (dims - k % dims))) & mask if k % dims else x
    left = lambda x, k: right(x, dims - k % dims)
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # trailing set bits
    turn = lambda w: 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % dims
    place, then = [], []
    for state in range(size * dims):
        e, d = state % size, state // size
        for cell in range(size):
            w = back[right(cell ^ e, d + 1)]
            e2, d2 = e ^ left(entry(w), d + 1), (d + turn(w) + 1) % dims
            place.append(w)
            then.append(d2 * size + e2)
    return place, then


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Curve index (long) of non-negative integer coordinates below 2^bits."""
    dims = len(coords)
    place, then = hilbert_table(dims)
    at, to = F.array(*map(F.lit, place)), F.array(*map(F.lit, then))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    cell = lambda b: sum((F.shiftleft(F.call_function("shiftright", c.cast("int"), b).bitwiseAND(1), k) for k, c in enumerate(coords[1:], 1)), F.call_function("shiftright", coords[0].cast("int"), b).bitwiseAND(1))
    step = lambda acc, b: F.struct((acc["h"] * (1 << dims) + F.get(at, acc["s"] * (1 << dims) + cell(b))).alias("h"), F.get(to, acc["s"] * (1 << dims) + cell(b)).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def _ranked(rows: DataFrame, order: list[str], parts: int, name: str) -> DataFrame:
    """rows with rank (exact, from 0) in that order and total (how many there are), ranked in `parts` tasks; written once."""
    run = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    run = run.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    run = materialize(run, name)
    # a row for each of the `parts` partitions
    counts = run.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).select("part", "base", "total")
    return run.join(F.broadcast(before), "part").withColumn("rank", F.col("base") + F.col("at")).drop("part", "base", "at")


def _with_cell(docs: DataFrame, name: str, cell: str) -> DataFrame:
    """docs with cell: 0 for null, else 1 to 2^BITS - 1 in the order of the column's values, evenly spread.

    All different values are ranked, however many there are; a value's cell is found by halves among the first values of the cells.
    """
    side = (1 << BITS) - 1
    value = docs[name].cast("string")
    known = materialize(docs.select(value.alias("n_name")).where("n_name is not null").distinct(), "names")
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + known.count() // MOST_NAMES)
    ranked = _ranked(known, ["n_name"], parts, "name-runs").select("n_name", F.expr(f"1 + rank * {side} div total").cast("int").alias("n_cell"))
    firsts = ranked.groupBy("n_cell").agg(F.min("n_name").alias("n_name"))
    # one row, arrays of at most `side` elements
    firsts = firsts.agg(F.sort_array(F.collect_list(F.struct("n_cell", "n_name"))).alias("n_firsts")).select(F.col("n_firsts.n_cell").alias("n_cells"), F.col("n_firsts.n_name").alias("n_names"))
    reach = lambda upto, step: upto + F.when(F.get("n_names", upto + step - 1) <= value, step).otherwise(0)
    upto = F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(BITS))]), F.lit(0), reach)
    return docs.crossJoin(F.broadcast(firsts)).withColumn(cell, F.when(value.isNull(), 0).otherwise(F.get("n_cells", upto - 1))).select(*docs.columns, cell)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row.

    size: UTF-8 bytes of the text and 16 (null text: 16, crc 0). Shard counts differ by one at
    most; slot is gapless from 0 in each shard. Columns named in dims that docs lacks count as null, and
    nulls have a cell of their own. Repeated rows get places of their own, null ids come
    first among ties. grown_shard is null under this law. An empty table gives no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    side = 1 << BITS
    side = 1 << BITS
    there = {c: docs[c].cast("string").alias(f"d{k}") for k, c in enumerate(dims) if c in docs.columns}
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *there.values())
    keyed = materialize(keyed, "metadata")
    low, high = keyed.agg(F.log2(F.min("size").cast("double")), F.log2(F.max("size").cast("double"))).first()
    log = F.floor((F.log2(F.col("size").cast("double")) - (low or 0)) * ((side - 1) / (high - low if low != high else 1)))  # even on a logarithmic scale
    for k, c in enumerate(dims):
        keyed = _with_cell(keyed, f"d{k}", f"cell{k}") if c in there else keyed.withColumn(f"cell{k}", F.lit(0))
    keyed = keyed.select("doc_id", "size", "text_crc32", hilbert_index([F.col("cell0"), F.col("cell1"), log]).alias("curve"))
    order = ["curve", "text_crc32", "doc_id", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = _ranked(keyed, order, parts, "curve-runs")
    placed = run.withColumn("shard", F.expr(f"rank * {shards} div total")).withColumn("slot", F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
