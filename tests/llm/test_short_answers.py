from cirro.llm import decontam

QUESTION = "Which of the seven northern harbours froze over in the long winter of that year?"
ITEMS = [(1, QUESTION + " B"), (2, "Who built the tall stone lighthouse beyond the western cliffs of the island? Old Tom Gray."), (None, "Where do the grey geese rest on their way across the wide cold sea? They rest on the flat islands of the north.")]


def found(text):
    return [h[1] for h in decontam.hits(decontam.build(ITEMS), [text], 0.7, 0.6)]


def test_a_short_answer_may_be_changed_or_missing():
    fill = " ".join(f"filler{i}" for i in range(60))
    for answer in ("", "B", "C"):
        assert found(f"{fill} {QUESTION} {answer} {fill}") == [1]
    assert found(ITEMS[1][1].replace("Tom ", "")) == [2] and found(ITEMS[1][1].replace("Tom", "Ben")) == [2]
    assert found(QUESTION.replace("northern harbours", "x").replace("long winter", "y")) == []


def test_items_without_id_count(spark):
    docs = spark.createDataFrame([(1, ITEMS[2][1]), (2, "other words"), (3, ITEMS[1][1])], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, bench).collect()} == {(1, None), (3, 2)}
    assert [r["doc_id"] for r in decontam.remove(docs, bench).collect()] == [2]


def test_items_of_few_words_and_of_very_many(spark):
    long = " ".join(f"long{i}" for i in range(3000)) + "."
    bench = spark.createDataFrame([(1, "Blue whale song?"), (2, "Blue, whale"), (3, long), (4, "..."), (5, QUESTION + " B"), (None, "grey seal")], "item_id long, text string")
    fill = " ".join(f"filler{i}" for i in range(200))
    docs = [(1, f"{fill} the blue whale! Song {fill}"), (2, "whale blue song"), (3, f"{fill} {long} {fill} {QUESTION} B"), (4, "a grey seal"), (5, None), (6, "... --- ..."), (4, "a grey seal")]
    got = sorted((r["doc_id"], r["item_id"] or 0) for r in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == [(1, 1), (1, 2), (3, 3), (3, 5), (4, 0), (4, 0)]


def test_passes_change_nothing(spark):
    """Small bounds, so that the items are dealt to several passes."""
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    one = list(decontam.indexes(bench))
    many = list(decontam.indexes(bench, chunk=7))
    assert len(one) == 1 and len(many) > 2
    texts = [r["text"] for r in docs.select("text").collect()]
    flat = lambda groups: sorted((h for ixs in groups for h in decontam.hits(ixs, texts, 0.7, 0.6)), key=str)
    a, b = flat(one), flat(many)
    assert [x[:3] for x in a] == [x[:3] for x in b] and len(a) > 0
    assert all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_query_against_brute_force(spark):
    """Every passage against every item by plain sets and loops."""
    import math
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"], decontam.tokens(r["text"])) for r in bench if r["text"]]
    df = Counter(w for _, _, ws in items for w in set(ws))
    mean, span = sum(len(ws) for _, _, ws in items) / len(items), max(len(ws) for _, _, ws in items)
    weight = lambda w, f, n: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))
    grams = lambda ws: {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}
    want = set()
    for d in docs:
        ws = decontam.tokens(d["text"])
        for at in range(0, len(ws), span):
            own = ws[at : at + 2 * span]
            have, there = set(own), grams(own)
            for item, text, said in items:
                raw = {w: weight(w, f, len(said)) for w, f in Counter(said).items()}
                if sum(x for w, x in raw.items() if w in have) < 0.7 * sum(raw.values()) - 1e-9:
                    continue
                q, a = map(grams, decontam.question_answer(text))
                x, y = len(q & there) / len(q), len(a & there) / len(a)
                if min(len(q), len(a)) > 2 and min(map(len, decontam.question_answer(text))) > 2:
                    if x >= 0.6 and y >= 0.6:
                        want.add((d["doc_id"], item))
                elif x == 1 or (x * len(q) + y * len(a)) >= 0.8 * (len(q) + len(a)):
                    want.add((d["doc_id"], item))
    from cirro.llm import queries

    assert {(r["doc_id"], r["item_id"]) for r in queries.op6_decontamination(spark, sf).collect()} == want and want
