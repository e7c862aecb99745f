import numpy as np

import corpus_pipeline
from cirro.llm import simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / max(1, len(a | b)) if a or b else 1.0


def test_near_duplicates_hold_to_the_similarity_on_both_sides(spark):
    rng = np.random.default_rng(3)
    docs, pairs = [], []
    for k in range(300):  # a prefix of a text: shingle sets of n and m > n, so the similarity is n / m
        n = int(rng.integers(80, 200))
        m = int(np.floor(n / 0.8)) if k % 2 else int(np.ceil(n / 0.78))
        ws = [f"t{k}w{i}" for i in range(m + 4)]
        docs += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(ws[: n + 4]))]
        pairs.append(n / m >= 0.8)
    assert 0 < sum(pairs) < 300
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "")
    gone = set(range(600)) - {r["doc_id"] for r in out.collect()}
    assert gone == {2 * k + 1 for k, near in enumerate(pairs) if near}


def test_near_duplicates_count_distinct_shingles(spark):
    a = " ".join(f"w{i}" for i in range(200))
    docs = [(1, a), (2, a + " " + a), (3, " ".join([a] * 40)), (4, "some other text of its own"), (5, ""), (6, None), (None, a)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert {r["doc_id"] for r in out.collect()} == {1, 4, 5}
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_similar_against_brute_force_in_parts(spark):
    """Small blocks, so that a group of near copies is dealt to many parts."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(60):
        ws = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 6))):
            ws[at] = f"x{k}"
        texts.append(" ".join(ws))
    texts += texts[:3] + [" ".join(rng.permutation(base)) for _ in range(5)]
    ids = [int(i) for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, 0.8, block=500).collect()}
    sets, label = [shingles(t) for t in texts], dict(zip(ids, ids, strict=True))
    for _ in ids:
        for i, a in zip(ids, sets, strict=True):
            label[i] = min(label[j] for j, b in zip(ids, sets, strict=True) if alike(a, b) >= 0.8)
    assert got == label and 1 < len(set(label.values())) < len(label)
