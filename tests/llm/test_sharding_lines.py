import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cirro.llm import linededup, sharding
from cirro.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_steps_to_neighbours(dims):
    place, then = sharding.hilbert_table(dims)
    bits, cells = 3, {}
    for n in range(1 << bits * dims):
        coords = [sum((n >> (b * dims + k) & 1) << b for b in range(bits)) for k in range(dims)]
        h = s = 0
        for b in reversed(range(bits)):
            cell = sum((c >> b & 1) << k for k, c in enumerate(coords))
            h, s = h << dims | place[s << dims | cell], then[s << dims | cell]
        cells[h] = coords
    assert sorted(cells) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(cells[h], cells[h + 1], strict=True)) == 1 for h in range(len(cells) - 1))


def test_hilbert_expression_equals_the_table(spark):
    from pyspark.sql import functions as F

    place, then = sharding.hilbert_table(3)
    for r in spark.range(500).select(*[(F.col("id") * k % 256).alias(f"c{k}") for k in (3, 7, 11)]).select("*", sharding.hilbert_index([F.col("c3"), F.col("c7"), F.col("c11")]).alias("h")).collect():
        h = s = 0
        for b in reversed(range(8)):
            cell = sum((r[k] >> b & 1) << k for k in range(3))
            h, s = h << 3 | place[s << 3 | cell], then[s << 3 | cell]
        assert r["h"] == h


def test_shards(spark):
    texts = ["a b", "", None, "é" * 40, "a b", "long " * 9000] * 17
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 5}", 7) for i, t in enumerate(texts)] + [(None, "x", "en", "s1", 1), (3, texts[3], None, "s3", 7)], "doc_id long, text string, lang string, source string, slot int")
    rows = sharding.shard(df, shards=7).toPandas()
    assert len(rows) == len(texts) + 2
    counts = rows.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and list(counts.index) == list(range(7))
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    run = rows.sort_values(["shard", "slot"])
    assert run["curve"].is_monotonic_increasing
    for r in rows[rows["doc_id"].notna()].itertuples():
        raw = (texts[int(r.doc_id)] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows"
    assert rows["grown_shard"].isna().all()
    assert sharding.shard(df.limit(0)).count() == 0


DOCS = [(5, "Shared line of text\nown line number five\nx"), (2, "  SHARED LINE OF TEXT\t\nshared line of text\n"), (9, None), (10, ""), (11, "\n\n"), (12, "\x0bshared line of text\r\n" * 70 + "tail line that is new"), (13, "tiny\ntiny\ntiny"), (14, "tiny\nnine char\nnine char"), (15, "É" * 10 + "\n" + "é" * 10), (16, "é" * 10)]


def oracle(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "int64"}))
    return {r[0]: r[1:] for r in con.sql("select doc_id, n_lines, n_dropped, kept_sha256 from (" + ORACLE_SQL["op7_line_dedup"] + ")").fetchall()}


def ours(df):
    from pyspark.sql import functions as F

    return {r[0]: tuple(r[1:]) for r in linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}


def test_lines_against_sql(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert ours(df) == oracle(DOCS)


def test_hot_lines_take_the_broadcast(spark, monkeypatch):
    rows = [(i, f"the one line that all have\nown line {i} of its own\nthe one line that all have") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df) == oracle(rows)


def test_line_edges(spark):
    df = spark.createDataFrame([(None, "shared line of text", "a"), (1, "shared line of text", "b"), (1, "shared line of text", "b"), (2, "shared line of text\nmore", "c")], "doc_id long, text string, N_LINES string")
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "N_LINES", "n_lines_", "n_dropped", "kept_text"]
    got = sorted((r["doc_id"] or 0, r["kept_text"]) for r in out.collect())
    assert got == [(0, "shared line of text"), (1, "shared line of text"), (1, "shared line of text"), (2, "more")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_bitmaps_of_long_texts(spark):
    """Words of the bitmap that are all ones are left out; ten thousand lines are looked up by their place."""
    shared = "the one line that both of them have"
    lines = [shared if i in (3, 64, 700, 9999) else f"a line of its own, number {i}" for i in range(10_000)]
    df = spark.createDataFrame([(1, shared), (2, "\n".join(lines))], "doc_id long, text string")
    [row] = linededup.keep_bitmaps(df).collect()
    want = {0: ~8, 1: ~1, 10: ~(1 << 60), 156: ~(1 << 15)}
    assert (row["doc"], row["n_dropped"], {k["word"]: k["bits"] for k in row["keeps"]}) == (2, 4, want)
    [dense] = linededup.keep_bitmaps(df).select(linededup.expand(F.col("keeps"))).first()
    assert dense == [want.get(i, -1) for i in range(157)]
    kept = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(df).collect()}
    assert kept == {1: shared, 2: "\n".join(x for x in lines if x != shared)}


def test_shards_prune_on_every_dimension(spark):
    """Least and greatest values of a shard tell most shards apart, and not only on the first dimension."""
    import random

    rng = random.Random(1)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 12)), rng.choice(["de", "en", "es", "fr"]), f"s{rng.randrange(20):02d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard(df).join(df.drop("text"), "doc_id").toPandas()
    read = lambda c, v: ((out.groupby("shard")[c].min() <= v) & (out.groupby("shard")[c].max() >= v)).sum()
    assert max(read("lang", v) for v in ("de", "en", "es", "fr")) <= 20
    assert sum(read("source", f"s{k:02d}") for k in range(20)) / 20 <= 20
    assert sum(read("size", 2**k) for k in range(5, 12)) / 7 <= 20


def test_many_names_go_by_their_first_byte(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_NAMES", 3)
    df = spark.createDataFrame([(i, "t", c, None) for i, c in enumerate(["zz", "", None, "aa", "é", "b"])], "doc_id long, text string, lang string, source string")
    curve = {r["doc_id"]: r["curve"] for r in sharding.shard(df).collect()}
    assert len(curve) == 6 and len(set(curve.values())) == 6


def test_cells_are_ranks_for_any_number_of_names(spark, monkeypatch):
    """Names of one first byte, ranked by one task and by several: the same cells, evenly spread in the order of the names."""
    names = [f"https://example.org/{k * 7919 % 1000:04d}" for k in range(1000)] + ["https://é", "https://😀", "", "https://￿"]
    place = {c: k for k, c in enumerate(sorted(names))}
    want = {c: 1 + place[c] * 255 // len(names) for c in names} | {None: 0}
    df = spark.createDataFrame([(i, "t" * (i % 50), "en", c) for i, c in enumerate(names * 2 + [None])], "doc_id long, text string, lang string, source string")
    found = []
    for most in (sharding.MOST_NAMES, 1003, 150):
        monkeypatch.setattr(sharding, "MOST_NAMES", most)
        assert {(r["source"], r["cell"]) for r in sharding._with_cell(df, "source", "cell").collect()} == set(want.items())
        found.append(sorted(map(tuple, sharding.shard(df).drop("grown_shard").collect())))
    assert len(found[0]) == 2 * len(names) + 1 and found[0] == found[1] == found[2]
