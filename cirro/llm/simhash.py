"""SimHash near-duplicates (operator 3): tiled exact comparison of fingerprints.

Fingerprints that occur once or more are compared once each, whatever the number of
their copies. They are dealt to contiguous groups by a sort key: the population count,
which bounds the distance from below, or the number of shingles. A task compares two
groups in tiles by numpy exclusive-or and bit counts, and skips tiles whose sort keys lie
too far apart. It returns a spanning forest of the links it finds, never the pairs
themselves, so a group of n copies costs n - 1 edges; components follow by star
contraction. similar() takes such links as proposals only and holds each against the
texts' shingle sets before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.llm.common import fresh, give_back, lower_ascii, materialize, words
from cirro.llm.components import connected_components

TILE = 1024
SEEDS = (42, 43, 44, 45)
MOST_PARTITIONS = 20_000  # tasks beyond share partitions, one after the other
MARKS = 1 << 21  # a table of marks has so many rows at most, some 80 MB where it is broadcast


def fingerprint(text: str | None, shingle: int = 4, width: int = 1) -> tuple[list[int], int]:
    """`width` unsigned 64-bit words and the number of shingles.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; shingles are `shingle` words,
    repeats included, space-joined; fewer words: the whole sequence; none or null: zero.
    A bit is set if over half the shingles' hashes (XXH64, seed 42 and on) have it.
    """
    spans = _spans(text, shingle)
    return _majority(spans, width)[0], len(spans)


def _spans(text: str | None, shingle: int) -> list[bytes]:
    """The shingles in their order, repeats included."""
    w = words(lower_ascii((text or "").encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass"))
    if not w:
        return []
    joined = b" ".join(w)
    stops = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1)
    starts = np.concatenate([[0], stops[:-1]])
    n = max(1, len(w) - shingle + 1)
    return list(map(joined.__getitem__, map(slice, starts[:n].tolist(), (stops[min(shingle, len(w)) - 1 :] - 1).tolist())))


def _majority(spans: list[bytes], width: int) -> tuple[list[int], np.ndarray]:
    """`width` words of majority bits, and the spans' hashes of the first seed."""
    n, out, first = len(spans), [], [np.zeros(0, dtype=np.uint64)]
    for k, seed in enumerate(SEEDS[:width]):
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 15):
            part = spans[at : at + (1 << 15)]
            raw = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in part]), dtype=np.uint8)
            total += np.unpackbits(raw.reshape(len(part), 8)[:, ::-1], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            if k == 0:
                first.append(raw.view(">u8").astype(np.uint64))
        out.append(int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0]))
    return out, np.concatenate(first)


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, w0 .. (longs with the bits of the unsigned words) and n_shingles of every row."""
    names = [f"w{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [fingerprint(t if isinstance(t, str) else None, shingle, width) for t in batch["text"]]
            bits = np.array([g[0] for g in got], dtype=np.uint64).reshape(-1, width).view(np.int64)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), **{c: bits[:, i] for i, c in enumerate(names)}, "n_shingles": [g[1] for g in got]})
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", n_shingles long"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, schema)


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest numbers; links come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))  # hang larger roots below smaller ones
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def forest_of(left: np.ndarray, right: np.ndarray | None, key_l: np.ndarray, key_r: np.ndarray | None, radius: int, near) -> Forest:
    """Links of left with itself (right None) or of left with right, by words of shape (n, width).

    Rows must be ordered by key; near(lo, hi) is the largest key that may link to keys in lo..hi.
    Numbers of right's rows follow those of left's.
    """
    n = len(left)
    same = right is None
    right, key_r = (left, key_l) if same else (right, key_r)
    forest = Forest(n if same else n + len(right))
    width = left.shape[1]
    shift = 0 if same else n
    for a in range(0, n, TILE):
        x, top = left[a : a + TILE], near(key_l[min(a + TILE, n) - 1])
        for b in range(a if same else 0, len(right), 4 * TILE):
            y, ky = right[b : b + 4 * TILE], key_r[b : b + 4 * TILE]
            if ky[0] > top or near(ky[-1]) < key_l[a]:
                continue
            d = np.bitwise_count(np.bitwise_xor.outer(x[:, 0], y[:, 0]))
            if width > 1:
                d = d.astype(np.uint16)
                for k in range(1, width):
                    d += np.bitwise_count(np.bitwise_xor.outer(x[:, k], y[:, k]))
            hit = d <= radius
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            keep = near(np.maximum(key_l[a + i], ky[j])) >= 0
            low = near(np.minimum(key_l[a + i], ky[j]))
            keep &= low >= np.maximum(key_l[a + i], ky[j])
            forest.add(i[keep] + a, j[keep] + b + shift)
    return forest


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, width: int = 1, count_ratio: float | None = None, target: tuple[int, int] = (4096, 262_144), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word) and component_id of every row.

    Fingerprints link at `radius` or fewer differing bits; with count_ratio, only if the smaller
    number of shingles is at least that share of the larger. component_id is the smallest
    doc_id reachable by links, the row's own included. Null and empty texts have fingerprint zero
    and link like any other. A row without id links with its text, so that others may be reached through it, but
    is never the smallest unless all are without. Repeated rows come out as often as they came in. An empty table
    gives no rows; other columns are not read. target: least and largest number of
    fingerprints in a group; groups grow with the root of the input between.
    """
    ws = [f"w{i}" for i in range(width)]
    prints = materialize(fingerprints(docs, shingle, width, id_col, text_col), "fingerprints")
    by = ws if count_ratio is None else [*ws, "n_shingles"]
    reps = materialize(prints.groupBy(*by).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "distinct-fingerprints")
    reps = _with_component(reps, _links(reps, ws, radius, count_ratio, target))
    ids = reps.groupBy("component").agg(F.min("rep").alias("component_id")).withColumnRenamed("component", "i_component")
    held = reps.join(ids, reps["component"] == ids["i_component"]).select(*[F.col(c).alias(f"r_{c}") for c in by], "component_id")
    out = prints.join(held, [prints[c] == held[f"r_{c}"] for c in by])
    digits = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in ws])
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def _with_component(reps: DataFrame, links: DataFrame | None) -> DataFrame:
    """reps with the component of their node, which is their own node where nothing links."""
    if links is None:
        return reps.withColumn("component", F.col("node"))
    comp = connected_components(links).withColumnsRenamed({"node": "c_node", "component": "c_component"})
    return reps.join(comp, reps["node"] == comp["c_node"], "left").select(*reps.columns, F.coalesce("c_component", "node").alias("component"))


def _links(reps: DataFrame, ws: list[str], radius: int, ratio: float | None, target: tuple[int, int]) -> DataFrame | None:
    """Edges (u, v) of nodes: spanning forests of the links inside each pair of groups.

    Groups lie in the order of the sort key, so the groups that one must be compared with are a range of
    them: a row of the plan holds a group and its range, and executors count the pairs out.
    """
    bits = sum((F.bit_count(c) for c in ws[1:]), F.bit_count(ws[0]))
    if ratio is None:
        key, near = bits, lambda k: k + radius
    else:
        key, near = F.col("n_shingles"), lambda k: np.floor(np.asarray(k) / ratio + 1e-9).astype(np.int64) if np.ndim(k) else int(k / ratio + 1e-9)
    bucket = F.col("k") if ratio is None else F.when(F.col("k") <= 0, 0).otherwise(F.floor(F.log(1.02, F.col("k").cast("double"))) + 1)
    keyed = reps.select("node", *ws, key.cast("long").alias("k")).withColumn("bucket", bucket.cast("int"))
    # one row for each population count, or for each 2 % of the shingle count: bounded whatever the input
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("bucket").collect()
    total = sum(r["n"] for r in counts)
    if total < 2:
        return None
    size = min(max(total // 8, target[0]), target[1])
    groups: list[tuple[int, int, int]] = []  # lowest key, highest key, rows
    place: dict[int, tuple[int, int]] = {}  # bucket to its first group and its number of groups
    for r in counts:
        parts = -(-r["n"] // size)
        if parts == 1 and groups and groups[-1][2] + r["n"] <= size:
            groups[-1] = (groups[-1][0], r["hi"], groups[-1][2] + r["n"])
            place[r["bucket"]] = (len(groups) - 1, 1)
        else:
            place[r["bucket"]] = (len(groups), parts)
            groups += [(r["lo"], r["hi"], r["n"] // parts)] * parts
    lows, tops = np.array([g[0] for g in groups]), np.array([near(g[1]) for g in groups])
    last = np.searchsorted(lows, tops, side="right") - 1  # of each group, the last one that may link to it
    first = np.searchsorted(tops, lows, side="left")
    plan = reps.sparkSession.createDataFrame([(g, int(first[g]), int(last[g])) for g in range(len(groups))], "p_grp int, first int, last int")
    base = F.create_map(*[F.lit(x) for b, (g, _) in place.items() for x in (b, g)])
    parts = F.create_map(*[F.lit(x) for b, (_, p) in place.items() for x in (b, p)])
    group = (base[F.col("bucket")] + F.pmod(F.xxhash64(*ws), parts[F.col("bucket")].cast("long"))).cast("int")
    # a row for every `size` fingerprints
    dealt = keyed.withColumn("grp", group).join(F.broadcast(plan), F.col("grp") == F.col("p_grp")).withColumn("other", F.explode(F.sequence("first", "last")))
    dealt = dealt.select(F.least("grp", "other").alias("i"), F.greatest("grp", "other").alias("j"), "grp", "node", "k", *ws)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values(["k", "node"], kind="stable")
        sides = [rows[rows["grp"] == g] for g in dict.fromkeys((i, j))]
        if any(not len(s) for s in sides):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        arrays = [(s[ws].to_numpy(np.int64).view(np.uint64), s["k"].to_numpy(np.int64)) for s in sides]
        nodes = np.concatenate([s["node"].to_numpy(np.int64) for s in sides])
        two = len(sides) == 2
        forest = forest_of(arrays[0][0], arrays[1][0] if two else None, arrays[0][1], arrays[1][1] if two else None, radius, near)
        hung = np.flatnonzero(forest.root != np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[hung], "v": nodes[forest.root[hung]]})

    # a number of partitions that the planner leaves alone: little data can be much work here
    tasks = int((last - np.arange(len(groups)) + 1).sum())
    return dealt.repartition(min(tasks, MOST_PARTITIONS), "i", "j").groupBy("i", "j").applyInPandas(compare, "u long, v long")


def _sets(docs: DataFrame, shingle: int, width: int, grams: bool) -> DataFrame:
    """Of docs (doc_id, t0, t1, text): doc_id, t0, t1, w0 .. over distinct shingles, n_shingles (distinct), s0 and s1 (a digest of their set) or, for grams, s0, s1 and the sorted hashes as bytes."""
    names = [f"w{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                got, hashes = _majority(list(set(_spans(text if isinstance(text, str) else None, shingle))), 1 if grams else width)
                held = np.sort(hashes).astype("<u8").tobytes()
                digest = np.frombuffer(xxhash.xxh3_128_digest(held), dtype=np.int64).tolist()
                rows.append((*digest, held) if grams else (*np.array(got, dtype=np.uint64).view(np.int64).tolist(), len(hashes), *digest))
            out = pd.DataFrame(rows, columns=columns[3:])
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), t0=batch["t0"].to_numpy(), t1=batch["t1"].to_numpy())[columns].astype({"doc_id": "Int64"})
            del batch, rows, out
        give_back()

    schema = "doc_id long, t0 long, t1 long, " + ("s0 long, s1 long, grams binary" if grams else ", ".join(f"{c} long" for c in names) + ", n_shingles long, s0 long, s1 long")
    columns = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInPandas(run, schema)


def _hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _marks(t0: Column) -> Column:
    return F.pmod(t0, F.lit(MARKS)).cast("long")


def _maybe(df: DataFrame, t0: Column, keys: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of df (left_semi) whose text's hash t0 has a mark that some key has too, or the others (left_anti).

    Rows of a key are all among the former, so texts of the others needn't be shuffled to a join with keys. The broadcast has MARKS rows
    at most, however many keys there are: with very many of them more rows are taken for possible ones, and none is lost.
    """
    mark = fresh(df.columns, "_mark")
    marks = F.broadcast(keys.select(_marks(F.col(key)).alias(mark)).distinct())
    return df.join(marks, _marks(t0) == marks[mark], how)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    t0, t1 = _hashes(text)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), t0.alias("t0"), t1.alias("t1"), text.alias("text"))


def _similar(docs: DataFrame, similarity: float, shingle: int, width: int, radius: int, target: tuple[int, int], block: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t0, t1 and component (a number of its own) of every row."""
    ws = [f"w{i}" for i in range(width)]
    by = [*ws, "n_shingles", "s0", "s1"]
    own = _own(docs, id_col, text_col)
    prints = materialize(_sets(own, shingle, width, False), "shingle-sets")
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("holder")  # the row whose text stands for the set
    reps = materialize(prints.groupBy(*by).agg(holder).withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    proposed = _links(reps, ws, radius, similarity, target)
    links = None if proposed is None else _verified(own, reps, connected_components(proposed), ws, similarity, shingle, radius, block)
    held = _with_component(reps, links).select(F.col("s0").alias("r_s0"), F.col("s1").alias("r_s1"), "component")
    return prints.join(held, (prints["s0"] == held["r_s0"]) & (prints["s1"] == held["r_s1"])).select("doc_id", "t0", "t1", "component")


def similar(docs: DataFrame, similarity: float, shingle: int = 5, width: int = 4, radius: int = 76, target: tuple[int, int] = (4096, 262_144), block: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of every row; rows link if the Jaccard similarity of their shingle sets is at least `similarity`.

    Fingerprints of the distinct shingles at `radius` or fewer bits only propose pairs; each is then held against
    the sets themselves. Equal sets link without. Ids, null and empty texts are as in near_duplicates. block: shingles
    that a task of the second step holds of one side; larger groups of proposals are dealt to pairs of parts.
    """
    rows = materialize(_similar(docs, similarity, shingle, width, radius, target, block, id_col, text_col), "components")
    ids = rows.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "i_component")
    return rows.join(ids, rows["component"] == ids["i_component"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float, shingle: int = 5, width: int = 4, radius: int = 76, target: tuple[int, int] = (4096, 262_144), block: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group that similar() links; all columns stay.

    The row of the smallest id stays, rows without id only in groups that have none with one; of one id's different texts
    the one of the smaller hash, and of rows alike in id and text the one whose other columns come first as JSON. Rows are
    told apart by id and text, so an id that is given twice doesn't take its other texts along. Null and empty texts are alike. An
    empty table gives no rows.
    """
    rows = _similar(docs, similarity, shingle, width, radius, target, block, id_col, text_col)
    texts = materialize(rows.groupBy("doc_id", "t0", "t1").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("n")), "components")
    best = texts.groupBy(F.col("component").alias("b_component")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("b"))
    j = texts.join(best, texts["component"] == best["b_component"])
    stays = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t0") == F.col("b.t0")) & (F.col("t1") == F.col("b.t1"))
    told = j.withColumn("stays", stays).where(~F.col("stays") | (F.col("n") > 1))
    told = materialize(told.select(F.col("doc_id").alias("g_id"), F.col("t0").alias("g_t0"), F.col("t1").alias("g_t1"), "stays"), "other-rows")
    t0, t1 = _hashes(docs[text_col].cast("string"))
    same = lambda df: docs[id_col].cast("long").eqNullSafe(df["g_id"]) & (t0 == df["g_t0"]) & (t1 == df["g_t1"])
    out = _maybe(docs, t0, told, "g_t0", "left_semi").join(told, same(told), "left_anti").unionAll(_maybe(docs, t0, told, "g_t0", "left_anti"))
    again = told.where("stays")  # rows that are there more than once
    if again.isEmpty():
        return out
    rest = docs.join(again, same(again), "left_semi")
    t0, t1 = _hashes(rest[text_col].cast("string"))
    row = F.min_by(F.struct(*[rest[c] for c in rest.columns]), F.to_json(F.struct(*[rest[c] for c in rest.columns if c != text_col]))).alias("row")
    one = rest.groupBy(rest[id_col].cast("long"), t0, t1).agg(row)
    return out.unionAll(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def _verified(own: DataFrame, reps: DataFrame, groups: DataFrame, ws: list[str], similarity: float, shingle: int, radius: int, block: int) -> DataFrame:
    """Edges (u, v) of nodes: spanning forests of the pairs in each group whose sets are similar enough."""
    groups = groups.withColumnRenamed("node", "g_node")
    found = reps.join(groups, reps["node"] == groups["g_node"]).select("node", *ws, "n_shingles", "s0", "s1", "component", F.col("holder.doc_id").alias("h_id"), F.col("holder.t0").alias("h_t0"), F.col("holder.t1").alias("h_t1"))
    found = materialize(found, "proposed")
    sizes = found.groupBy("component").agg(F.ceil(F.sum("n_shingles") / block).alias("parts"))
    total = found.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(64, -(-total // block))
    held = found.join(sizes, "component").withColumn("part", F.when(F.col("parts") > 1, F.pmod("s0", F.col("parts"))).otherwise(0))
    keys = found.select("h_id", "h_t0", "h_t1")
    is_holder = own["doc_id"].eqNullSafe(keys["h_id"]) & (own["t0"] == keys["h_t0"]) & (own["t1"] == keys["h_t1"])
    texts = _maybe(own, own["t0"], keys, "h_t0", "left_semi").join(keys, is_holder, "left_semi").groupBy("doc_id", "t0", "t1").agg(F.first("text").alias("text"))  # rows alike count once
    sets = _sets(texts, shingle, len(ws), True).withColumnsRenamed({"s0": "r_s0", "s1": "r_s1"}).drop("doc_id", "t0", "t1")
    held = held.join(sets, (held["s0"] == sets["r_s0"]) & (held["s1"] == sets["r_s1"]))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    held = held.withColumn("other", other).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    held = held.withColumn("task", F.when(F.col("parts") > 1, F.xxhash64("component", "lo", "hi")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks))))

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_similar_pairs(g, ws, similarity, radius) for _, g in rows.groupby(["component", "lo", "hi"])]
        return pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *found])

    return held.select("task", "component", "lo", "hi", "part", "node", *ws, "grams").groupBy("task").applyInPandas(check, "u long, v long")


def _similar_pairs(rows: pd.DataFrame, ws: list[str], similarity: float, radius: int) -> pd.DataFrame:
    """A spanning forest of the similar pairs of one group, or of two different parts of it."""
    rows = rows.sort_values(["part", "node"], kind="stable")
    node, part = rows["node"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
    bits = np.ascontiguousarray(rows[ws].to_numpy(np.int64)).view(np.uint64)
    size = rows["grams"].map(len).to_numpy(np.int64) // 8
    n, ends = len(rows), np.cumsum(size)
    names, flat = np.unique(np.frombuffer(b"".join(rows["grams"]), dtype="<u8"), return_inverse=True)
    sets = np.split(flat, ends[:-1])
    mine, forest = np.zeros(len(names), dtype=np.int64), Forest(n)
    across = rows["lo"].iloc[0] != rows["hi"].iloc[0]
    for i in range(n):
        j = np.arange(max(i + 1, np.searchsorted(part, part[i], side="right")) if across else i + 1, n)
        close = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= radius
        close &= np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9
        j = j[close & (forest.root[j] != forest.root[i])]
        if not len(j):
            continue
        mine[sets[i]] = 1
        both = np.add.reduceat(mine[np.concatenate([sets[k] for k in j])], np.cumsum(size[j]) - size[j])
        mine[sets[i]] = 0
        hit = j[both >= similarity * (size[i] + size[j] - both) - 1e-9]
        forest.add(np.full(len(hit), i), hit)
    hung = np.flatnonzero(forest.root != np.arange(n))
    return pd.DataFrame({"u": node[hung], "v": node[forest.root[hung]]})
