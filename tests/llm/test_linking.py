import json

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cirro.llm import chat, decontam, linededup, packing, queries, rollup
from cirro.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def test_components_against_union_find(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (3, 4), (4, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["component"] for r in connected_components(chain).collect()} == {1}
    assert connected_components(chain.limit(0)).count() == 0


ITEMS = [(1, "What colour has the wide open sky at noon in June? It is blue as the sea."), (2, "Name every river that crosses the old northern border of the land"), (3, None), (4, "too short")]


def test_decontamination_finds_copies(spark):
    fill = " ".join(f"filler{i}" for i in range(300))
    docs = [(10, f"{fill} {ITEMS[0][1].upper()} {fill}"), (11, ITEMS[1][1]), (12, fill), (13, None), (14, ""), (15, "what colour has the wide open sky at noon in june"), (None, ITEMS[1][1]), (11, ITEMS[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.find(df, bench).collect())
    assert got == [(0, 2), (10, 1), (11, 2), (11, 2)]
    assert sorted(r["doc_id"] for r in decontam.remove(df, bench).collect()) == [12, 13, 14, 15]
    assert decontam.find(df.limit(0), bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0


def test_search_equals_scoring_all():
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 60").fetchall()]
    [ix] = decontam.build(items)
    docs = [decontam.tokens(t) for t in texts]
    impact = {}
    for t, k in ix.vocab.items():
        for e in range(ix.block_start[k], ix.block_start[k + 1]):
            for p in range(ix.post_start[e], ix.post_start[e + 1]):
                impact.setdefault(int(ix.post_item[p]), {})[t] = ix.post_impact[p]
    want = {}
    for d, ws in enumerate(docs):
        for s in range(0, len(ws) // ix.span * ix.span + 1, ix.span):
            have = set(ws[s : s + 2 * ix.span])
            for i, own in impact.items():
                x = sum(v for t, v in own.items() if t in have)
                if x >= 0.5:
                    want[d, s, i] = x
    got = {(d, s, i): x for d, s, i, x in decontam.search(ix, docs, 0.5)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got) and len(got) > 0


def test_rollup_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "en", "a"), (2, None, None, "a"), (3, "three", "en", None), (3, "three", "en", None)], "doc_id long, text string, lang string, source string")
    path = queries.tokenizer_file("word_bpe_49k.json")
    counts = rollup.token_counts(docs, path, "v1")
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("a/1", rollup.inserts(counts)) and not r.commit("a/1", rollup.inserts(counts))
    get = lambda: {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}
    assert get() == {("a", "en", "v1"): (1, 2), ("a", None, "v1"): (1, 0), (None, "en", "v1"): (2, 2)}
    new = counts.where("doc_id = 1").withColumn("n_tokens", F.lit(7).cast("long")).withColumn("lang", F.lit("de"))
    r.commit("b", rollup.revisions(counts.where("doc_id = 1"), new))
    r.commit("c", rollup.deletes(counts.where("doc_id = 3")))
    assert get() == {("a", "de", "v1"): (1, 7), ("a", None, "v1"): (1, 0)}
    (tmp_path / "r" / "_new-broken").mkdir()
    assert get() == {("a", "de", "v1"): (1, 7), ("a", None, "v1"): (1, 0)} and r.batches() == ["batch=a%2F1", "batch=b", "batch=c"]


def test_rollup_compacts_and_names_are_taken_once(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "1", 5), ("b", "en", "1", 7)], "source string, lang string, tokenizer_version string, n_tokens long")
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    get = lambda: sorted(tuple(x) for x in r.totals().collect())
    r.compact()
    for k in range(5):
        assert r.commit(f"b{k}", rollup.inserts(counts))
        if k % 2:
            r.compact()
            assert not r.commit(f"b{k}", rollup.inserts(counts)) and not r.commit("b0", rollup.inserts(counts))
    assert get() == [("a", "en", "1", 5, 25), ("b", "en", "1", 5, 35)] and r.batches() == [f"batch=b{k}" for k in range(5)]
    left = sorted(p.name for p in (tmp_path / "r").iterdir())
    assert len(left) < 8 and not any(n.startswith("_new") for n in left)
    # another driver that didn't see the batch when it began
    late = rollup.Rollup(spark, str(tmp_path / "r"))
    late.committed = lambda batch: False
    assert not late.commit("b4", rollup.inserts(counts)) and get() == [("a", "en", "1", 5, 25), ("b", "en", "1", 5, 35)]


def test_rollup_query_against_the_tokenizer(spark):
    """Every text through the tokenizer itself, added up plainly."""
    from collections import Counter

    from tokenizers import Tokenizer

    full = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    n = lambda t: len(full.encode(t or "", add_special_tokens=False).ids)
    docs, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r["doc_id"] % 10 == 3:
            continue
        new = r["doc_id"] % 10 == 7
        text = r["text"] and f"{r['text'].strip(' ')} {r['text'].strip(' ')}" if new else r["text"]
        key = (r["source"], r["lang"], "2" if new else "1")
        docs[key] += 1
        tokens[key] += n(text)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_token_counts_edges(spark):
    path = queries.tokenizer_file("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "one two", None, "s", 1), (1, None, "en", None, 2), (1, "", "en", None, 2), (2, "word " * 200_000, "en", "s", 3), (2, "word " * 200_000, "en", "s", 3)], "doc_id long, text string, lang string, source string, N_TOKENS int")
    got = sorted(tuple(x) for x in ((r["doc_id"] or 0, r["source"] or "", r["lang"] or "", r["n_tokens"]) for r in rollup.token_counts(df, path, "v").collect()))
    assert got == [(0, "s", "", 2), (1, "", "en", 0), (1, "", "en", 0), (2, "s", "en", 200_000), (2, "s", "en", 200_000)]
    assert rollup.token_counts(df.limit(0), path, "v").count() == 0


SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}, "say": {"properties": {"text": {"type": "string"}}, "required": []}}


def test_linking(spark):
    call = lambda *cs: json.dumps({"tool_calls": list(cs)})
    c = lambda i, name, args, deps=(): {"id": i, "name": name, "arguments": args, "depends_on": list(deps)}
    told = lambda i, x: json.dumps({"content": x, "tool_call_id": i})
    rows = [
        (1, 1, "assistant", call(c("x", "add", {"b": 2.5, "a": 1}, ["y"]), c("y", "add", {"a": "1", "c": 0}))), (1, 2, "tool", told("x", {"z": 1, "a": [1]})), (1, 3, "tool", told("y", None)), (1, 4, "tool", told("gone", 1)),
        (2, 1, "assistant", call(c("p", "say", {}, ["q"]), c("q", "nope", {}, ["p"]))), (2, 0, "tool", told("p", "early")),
        (None, 5, "assistant", call(c("n", "say", {"text": 'quote " \n é'}))), (3, 1, "assistant", "no json tool_calls"), (3, 2, "tool", None), (3, 3, "user", ""),
    ]
    every = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"STATUS": F.lit(1), "call_id": F.lit("clash")}), SCHEMAS).collect()
    assert [json.loads(r["json"]) for r in sorted((r for r in every if r["status"] == "message"), key=lambda r: r["turn"])] == [{"content": t, "conv_id": 3, "role": r, "turn": n} for _, n, r, t in rows[-3:]]
    got = {r["call_id"]: r for r in every if r["status"] != "message"}
    assert {k: r["status"] for k, r in got.items()} == {"x": "linked", "y": "linked", "gone": "no_call", "p": "early_result", "q": "no_result", "n": "no_result"}
    assert got["x"]["errors"] == [] and got["y"]["errors"] == ["extra:c", "missing:b", "type:a"] and got["q"]["errors"] == ["unknown_tool"] and got["p"]["errors"] == []
    assert got["y"]["topo"] < got["x"]["topo"] and got["p"]["topo"] is None
    line = got["x"]["json"]
    assert line == json.dumps({"arguments": {"a": 1, "b": 2.5}, "call_id": "x", "conv_id": 1, "name": "add", "result": '{"a":[1],"z":1}', "status": "linked", "turn": 1}, separators=(",", ":"))
    assert json.loads(got["n"]["json"])["arguments"]["text"] == 'quote " \n é' and json.loads(got["gone"]["json"])["name"] is None


def test_linking_repeats_and_empty(spark):
    calls = spark.createDataFrame([(1, "a", 2, "say", "{}", None), (1, "a", 1, "say", None, [])], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 4, "first"), (1, "a", 4, "first")], "conv_id long, call_id string, turn long, content string")
    r = chat.link(calls, results, SCHEMAS).collect()
    assert len(r) == 1 and (r[0]["turn"], r[0]["result_turn"], r[0]["n_calls"], r[0]["n_results"], r[0]["errors"]) == (1, 4, 2, 3, ["json"])
    assert chat.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0
    assert "Python" not in chat.link(calls, results, SCHEMAS)._jdf.queryExecution().toString()


def test_arguments_lose_nothing(spark):
    """What canonical JSON can't say stands beside it as it was said."""
    texts = {"a": '{"b": 1.0}', "b": '{"b": 12345678901234567890123456789012345678901234567890}', "c": '{"b": 1, "b": 2}', "d": "{broken", "e": '{"z": "1.0 \\\\" 2.50 \\\\\\\\", "b": 25, "a": [1, {"y": null, "x": -0.5}]}', "f": None, "g": '{"z": "' + "x 1.0 " * 20000 + '"}'}
    texts["e"] = texts["e"].replace("\\\\", "\\")
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": [{"id": k, "name": "say", "arguments": v} for k, v in texts.items()] + [{"name": "say", "arguments": {"b": 7}}]}))]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    lines = {r["call_id"]: json.loads(r["json"]) for r in got}
    assert {k for k, x in lines.items() if "raw_arguments" in x} == {"b", "c", "d"} | ({"a"} if '"b":1.0' not in next(r["json"] for r in got if r["call_id"] == "a") else set())
    assert all(lines[k]["raw_arguments"] == texts[k] for k in ("b", "c", "d")) and lines["d"]["arguments"] is None
    assert lines["e"]["arguments"] == json.loads(texts["e"]) and lines["g"]["arguments"] == json.loads(texts["g"]) and list(lines["e"]["arguments"]) == ["a", "b", "z"]
    assert lines[None]["arguments"] == {"b": 7} and lines[None]["status"] == "no_id"


def test_orders_against_longest_paths(spark):
    """Random dependencies with chains, diamonds, cycles and tails, against a plain search for longest paths."""
    import random

    rng = random.Random(7)
    deps, rows = {}, []
    for conv in [None, *range(12)]:
        n = rng.randint(1, 25)
        ids = [f"k{i}" for i in range(n)]
        for i, c in enumerate(ids):
            pool = ids[i + 1 :] if conv is None or conv % 3 else ids
            d = rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 1, 2, 3] if i % 2 else [1])))
            deps[conv, c] = set(d)
            rows.append((conv, c, i, "say", "{}", [*d, "gone"]))
    rows += [(99, f"c{i}", i, "say", "{}", [f"c{i + 1}"]) for i in range(3000)]
    deps |= {(99, f"c{i}"): {f"c{i + 1}"} if i < 2999 else set() for i in range(3000)}
    level = {}
    for _ in range(3001):  # a call has its level once all it depends on have one
        new = {k: max((level[k[0], d] + 1 for d in ds), default=0) for k, ds in deps.items() if k not in level and all((k[0], d) in level for d in ds)}
        if not new:
            break
        level |= new
    turn = {(r[0], r[1]): r[2] for r in rows}
    odd = {c for (c, k), ds in deps.items() if any(turn[c, d] >= turn[c, k] for d in ds)}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r["topo"] for r in chat.link(calls, results, SCHEMAS).collect()}
    assert got == {k: level.get(k) if k[0] in odd else turn[k] for k in deps} and None in got.values() and len(odd) > 3


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_chat"])
    cols = [d[0] for d in want.description]
    got = [tuple(r[c] for c in cols) for r in queries.op2_chat(spark, SF).collect()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


def test_pipeline_against_its_parts(spark):
    """Stage by stage on a small table: each keeps what a plain reading says it must."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(900001, "12 34 !!", "en", "x", 8), (900002, None, "en", "x", 0)], docs.schema)
    one = corpus_pipeline.language(spark, docs.union(junk), SF)
    assert one.columns == docs.columns and {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in docs.where("text rlike '[a-zA-Zà-ÿ]'").select("doc_id").collect()}
    two = corpus_pipeline.lines(spark, one, SF).cache()
    plain = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(one).collect()}
    assert two.columns == docs.columns and {r["doc_id"]: r["text"] for r in two.collect()} == plain and all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = corpus_pipeline.near_duplicates(spark, two, SF).cache()
    kept = {r["doc_id"]: r["text"] for r in three.collect()}
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets = {k: shingles(v) for k, v in plain.items()}
    alike = lambda a, b: len(a & b) / max(1, len(a | b))
    for k in plain.keys() - kept.keys():
        assert any(alike(sets[k], sets[j]) >= 0.5 for j in plain if j < k), k
    for k in kept:
        assert all(alike(sets[k], sets[j]) < 0.9 for j in kept if j < k)
    four = corpus_pipeline.benchmark(spark, three, SF)
    flagged = {r["doc_id"] for r in decontam.find(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in four.collect()} == kept.keys() - flagged and four.columns == docs.columns
    five = corpus_pipeline.pack(spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == kept.keys() - flagged
    total = packing.pack(four, queries.tokenizer_file("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m"))
    assert total.where("n <> m").count() == 0


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "packing"]
