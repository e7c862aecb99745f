import corpus_pipeline
from cirro.llm import simhash

SCHEMA = "doc_id long, text string"
A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(40))
Q = " ".join(f"q{i}" for i in range(40))


def test_rows_go_not_ids(spark):
    docs = [(1, A), (5, A), (5, B), (None, A), (8, Q), (8, Q), (None, None), (9, ""), (None, "only here " * 3)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert got == sorted([(1, A), (5, B), (8, Q), (9, ""), (0, "only here " * 3)])


def test_repeated_rows_keep_one_whatever_their_other_columns(spark):
    df = spark.createDataFrame([(8, Q, "x", None), (8, Q, "w", 2), (8, Q, "x", 1)], "doc_id long, text string, n_shingles string, component int")
    out = simhash.keep_one(df, 0.8)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(8, Q, "w", 2)]


def test_marks_lose_no_row_however_few_there_are(spark, monkeypatch):
    docs = [(1, A), (5, A), (5, B), (6, B + " x"), (None, A), (8, Q), (8, Q), (None, None), (9, ""), (10, "of its own")]
    df = spark.createDataFrame([(i, t, "o") for i, t in docs], SCHEMA + ", _mark string")
    for most in (1, 2, 1 << 21):
        monkeypatch.setattr(simhash, "MARKS", most)
        out = simhash.keep_one(df, 0.8)
        assert out.columns == df.columns
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, A), (5, B), (8, Q), (9, ""), (10, "of its own")])


def test_a_row_without_id_is_a_bridge(spark, monkeypatch):
    """Fingerprints 0, 15 and 255: the first and the last meet only through the row in the middle, which has no id."""
    prints = {"zero": 0, "four": 0x0F, "eight": 0xFF, "far": (1 << 63) | (0x7FFF << 20)}
    df = spark.createDataFrame([(1, "zero"), (None, "four"), (2, "eight"), (3, "far"), (None, "far")], SCHEMA)
    table = spark.createDataFrame([(t, p if p < 1 << 63 else p - (1 << 64)) for t, p in prints.items()], "t string, w0 long")
    made = lambda docs, *_: docs.join(table, docs["text"] == table["t"]).selectExpr("doc_id", "w0", "1L as n_shingles")
    monkeypatch.setattr(simhash, "fingerprints", made)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 3)]
    alone = simhash.near_duplicates(df.where("doc_id is null and text = 'four'")).collect()
    assert [(r["doc_id"], r["component_id"]) for r in alone] == [(None, None)]
