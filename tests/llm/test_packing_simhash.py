import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cirro.llm import packing, simhash
from cirro.llm.queries import tokenizer_file
from cirro.llm.wordtok import WordTokenizer

PATH = tokenizer_file("word_bpe_49k.json")
TEXTS = ["", None, "One two  three\nfour five", "one two three four five", "a" * 3000, "x y " * 4000, "İstanbul ΣΑΣ <|endoftext|>", "don't'll ''s ²³ é", "same text here now", "same text here now"]
SCHEMA = "doc_id long, text string, sequence_id string, W0 int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id text", None, None), (3, TEXTS[3], "x", 1)], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_word_tokenizer_equals_the_file(texts):
    tok = TOK
    assert tok.batch(texts) == [np.array(tok.full.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


TOK = WordTokenizer(PATH, cache_size=50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(64, 100))
def test_pack_block_holds_all_once(sizes, cap):
    bins = packing.pack_block(sizes, cap)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in b) for b in bins) <= cap


def test_differencing_balances():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in b) for b in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]  # differencing's own result: 8, 7, 6, 5, 4 leave a difference of 2


def test_pack_round_trip(docs):
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH, capacity=256, piece=64).toPandas()
    for doc, part in rows.sort_values("start").groupby("doc_id"):
        ids = TOK.full.encode(TEXTS[doc] or "", add_special_tokens=False).ids + [1]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (part["doc_tokens"] == len(ids)).all() and part["length"].sum() == len(ids)
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(part["start"], part["length"], strict=True)] == part["ids_crc32"].tolist()
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= 256
    assert set(rows["doc_id"]) == set(range(len(TEXTS)))


def test_pack_empty_and_null_id(docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert packing.pack(docs.where("doc_id is null"), PATH).count() == 1


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB é\n\x0b\x85"))
def test_fingerprint(text):
    assert simhash.fingerprint(text)[0] == [plain(text)]


def brute(ids, prints, radius):
    label = list(ids)
    for _ in ids:
        for i in range(len(ids)):
            label[i] = min(label[j] for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= radius)
    return label


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh"], 40)) for _ in range(12)]
    texts = base + [b.replace("ab", "AB", 1) for b in base] + [b + " ab" for b in base] + ["", None, " \n"]
    ids = [int(i) for i in rng.permutation(len(texts)) + 10]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df, radius=12, target=(8, 8)).collect()}
    prints = [plain(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in ids] == prints
    assert [got[i]["component_id"] for i in ids] == brute(ids, prints, 12)
    assert len({got[ids[k]]["component_id"] for k in (-1, -2, -3)}) == 1


def test_near_duplicates_edges(spark, docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[9] == 8 and by[3] == 2 and by[1] == 0 and by[None] is None


def test_forest_stays_small_on_one_large_group():
    words = np.zeros((5000, 1), dtype=np.uint64)
    words[:, 0] = np.uint64(1) << np.arange(5000, dtype=np.uint64) % np.uint64(64)
    key = np.ones(5000, dtype=np.int64)
    forest = simhash.forest_of(words, None, key, None, 4, lambda k: k + 4)
    assert (forest.root == 0).all()


def test_wide_fingerprints_use_the_count_ratio(spark):
    a = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, a), (2, a + " end"), (3, a + " " + a + "x"), (4, "other words entirely in this one text here")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle=5, width=4, radius=46, count_ratio=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
