"""Benchmark decontamination (operator 6): a BM25 index of test items, searched by block-max WAND.

Every passage of every document is a query. A passage is a window of 2 S words, one every S words,
S being the length of the longest item of like size (items are taken by sizes, so that a long one doesn't widen the
passages of short ones), so that a copy of an item lies whole in some passage. An item's
BM25 score is taken as a share of what its own text scores, so one threshold suits all items. Bounds
come first, as in block-max WAND: the sum of the terms' maxima, then the sum of their maxima in
each block of items; only blocks whose bound reaches the threshold are scored, and all items above
it are retrieved. A hit counts once its question and its answer are found in the passage; a side of at
most four words may be changed or missing if the rest is there. Items of fewer than FEW words must be there word by word.
The search runs over arrays of passages at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.common import fresh, materialize

BLOCK = 16
GRAM = 3
#: A side of at most SHORT triples (four words) is no evidence by itself; TOGETHER is what question and answer must then reach.
SHORT, TOGETHER = 2, 0.8
FEW = 5
SIZES = (64, 4)  # items of at most so many words are taken together, then of so many times that
_DROPPED = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LAST = re.compile(r"(?s)^(.*[.!?\n])[\s]*(\S.*)$")


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROPPED).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer, what precedes it the question; of a single sentence the last third of its words."""
    m = _LAST.match(text.strip())
    if m and tokens(m[1]) and tokens(m[2]):
        return tokens(m[1]), tokens(m[2])
    ws = tokens(text)
    cut = len(ws) - max(1, len(ws) // 3)
    return ws[:cut], ws[cut:]


def grams(ws: list[bytes]) -> set[bytes]:
    return {b" ".join(ws[i : i + GRAM]) for i in range(max(1, len(ws) - GRAM + 1))} if ws else set()


@dataclass
class Index:
    item_ids: list[int | None]
    sides: list[tuple[set[bytes], set[bytes]]]  # grams of question and answer
    exact: dict[int, list[bytes]]  # of items of few words, all of them
    span: int  # words of the longest item
    vocab: dict[bytes, int]
    peak: np.ndarray  # of each term, its largest impact
    block_start: np.ndarray  # of each term, where its blocks begin
    block: np.ndarray
    block_peak: np.ndarray
    post_start: np.ndarray  # of each block entry, where its postings begin
    post_item: np.ndarray
    post_impact: np.ndarray


@dataclass
class Statistics:
    """Of all items, whichever of them an index holds."""

    n: int
    mean: float  # words an item
    df: dict[bytes, int]
    spans: dict[int, int]  # of each size, the words of the longest item


def _size(n: int) -> int:
    size = SIZES[0]
    while size < n:
        size *= SIZES[1]
    return size


def build(items: list[tuple[int | None, str | None]], stats: Statistics | None = None, k1: float = 1.2, b: float = 0.75) -> list[Index]:
    """An index for each size of items; items without a word are left out. stats: of a benchmark of which items are a part."""
    kept = [(i, t, tokens(t)) for i, t in sorted(((i, t) for i, t in items if t), key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
    kept = [x for x in kept if x[2]]
    if not kept:
        return []
    if stats is None:
        spans: dict[int, int] = {}
        for _, _, ws in kept:
            spans[_size(len(ws))] = max(len(ws), spans.get(_size(len(ws)), 0))
        stats = Statistics(len(kept), sum(len(ws) for _, _, ws in kept) / len(kept), Counter(t for _, _, ws in kept for t in set(ws)), spans)
    by_size: dict[int, list] = {}
    for item in kept:
        by_size.setdefault(_size(len(item[2])), []).append(item)
    return [_index(own, stats.spans[size], stats, k1, b) for size, own in sorted(by_size.items())]


def _index(kept: list[tuple[int | None, str, list[bytes]]], span: int, stats: Statistics, k1: float, b: float) -> Index:
    impacts: dict[bytes, list[tuple[int, float]]] = {}
    for n, (_, _, ws) in enumerate(kept):
        raw = {t: np.log(1 + (stats.n - stats.df[t] + 0.5) / (stats.df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(ws) / stats.mean)) for t, f in Counter(ws).items()}
        own = sum(raw.values())
        for t, x in raw.items():
            impacts.setdefault(t, []).append((n, x / own))
    vocab = {t: k for k, t in enumerate(sorted(impacts))}
    peak, bs, blk, bp, ps, pi, px = [], [0], [], [], [], [], []
    for t in vocab:
        for n, x in impacts[t]:
            if len(blk) == bs[-1] or blk[-1] != n // BLOCK:
                blk.append(n // BLOCK)
                bp.append(0.0)
                ps.append(len(pi))
            bp[-1] = max(bp[-1], x)
            pi.append(n)
            px.append(x)
        peak.append(max(x for _, x in impacts[t]))
        bs.append(len(blk))
    ps.append(len(pi))
    sides = [tuple(map(grams, question_answer(t))) for _, t, _ in kept]
    exact = {n: ws for n, (_, _, ws) in enumerate(kept) if len(ws) < FEW}
    return Index([i for i, _, _ in kept], sides, exact, span, vocab, np.array(peak), np.array(bs), np.array(blk), np.array(bp), np.array(ps), np.array(pi), np.array(px))


def _expand(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position of every position in the ranges."""
    n = stops - starts
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[rows]


def search(ix: Index, docs: list[list[bytes]], threshold: float) -> list[tuple[int, int, int, float]]:
    """(document, first word of the passage, item, share) of every passage and item at or above the threshold."""
    get, unknown = ix.vocab.get, -1
    span = ix.span
    pairs, base, windows = [], 0, []
    for d, ws in enumerate(docs):
        ids = np.fromiter((get(w, unknown) for w in ws), dtype=np.int64, count=len(ws))
        at = np.flatnonzero(ids >= 0)
        if len(at):
            cell = at // span
            pairs.append((base + cell) * len(ix.vocab) + ids[at])
            after = cell > 0
            pairs.append((base + cell[after] - 1) * len(ix.vocab) + ids[at[after]])
        n = len(ws) // span + 1
        windows.append((base, d))
        base += n
    if not pairs:
        return []
    both = np.unique(np.concatenate(pairs))
    window, term = both // len(ix.vocab), both % len(ix.vocab)
    bound = np.bincount(window, weights=ix.peak[term], minlength=base)
    alive = bound[window] >= threshold - 1e-9
    window, term = window[alive], term[alive]
    if not len(window):
        return []
    row, entry = _expand(ix.block_start[term], ix.block_start[term + 1])
    blocks = int(ix.block.max()) + 1
    place = window[row] * blocks + ix.block[entry]
    spots, inverse = np.unique(place, return_inverse=True)
    alive = np.bincount(inverse, weights=ix.block_peak[entry])[inverse] >= threshold - 1e-9
    row, entry = row[alive], entry[alive]
    back, post = _expand(ix.post_start[entry], ix.post_start[entry + 1])
    place = window[row[back]] * len(ix.item_ids) + ix.post_item[post]
    spots, inverse = np.unique(place, return_inverse=True)
    share = np.bincount(inverse, weights=ix.post_impact[post], minlength=len(spots))
    out = []
    starts = np.array([s for s, _ in windows])
    for spot, x in zip(spots[share >= threshold].tolist(), share[share >= threshold].tolist(), strict=True):
        w, item = divmod(spot, len(ix.item_ids))
        k = int(np.searchsorted(starts, w, side="right")) - 1
        out.append((windows[k][1], (w - windows[k][0]) * span, item, x))
    return out


def verify(ix: Index, ws: list[bytes], start: int, item: int) -> tuple[float, float]:
    """Shares of the question's and the answer's word triples that the passage has; of an item of few words all or nothing."""
    if item in ix.exact:
        return (float(_has(ws, start, ix.span, b" ".join(ix.exact[item]))),) * 2
    have = grams(ws[start : start + 2 * ix.span])
    question, answer = ix.sides[item]
    return tuple(len(side & have | {w for w in side if w.count(b" ") < GRAM - 1 and _has(ws, start, ix.span, w)}) / max(len(side), 1) for side in (question, answer))


def _has(ws: list[bytes], start: int, span: int, gram: bytes) -> bool:
    part = gram.split(b" ")
    own = ws[start : start + 2 * span]
    return any(own[i : i + len(part)] == part for i in range(len(own)))


def counts(q: float, a: float, sides: tuple[set[bytes], set[bytes]], overlap: float) -> bool:
    """Whether the overlaps make a hit: both reach `overlap`, or, where one side has so few triples that a changed word
    takes half of them or more, the other side is there whole or TOGETHER of both sides' triples are."""
    if q >= overlap and a >= overlap:
        return True
    n, m = map(len, sides)
    if min(n, m) > SHORT or max(n, m) <= SHORT:
        return False
    return (q if n > m else a) == 1 or q * n + a * m >= TOGETHER * (n + m) - 1e-9


def hits(ixs: list[Index], texts: list[str | None], threshold: float, overlap: float) -> list[tuple[int, int | None, int, float, float, float]]:
    """(text, item's id, first word, share, question's overlap, answer's) of verified hits, the best passage for each text and item."""
    docs = [tokens(t) for t in texts]
    best: dict[tuple[int, int, int], tuple] = {}
    for k, ix in enumerate(ixs):
        for d, start, item, share in search(ix, docs, threshold):
            q, a = verify(ix, docs[d], start, item)
            if counts(q, a, ix.sides[item], overlap) and (share, -start) > best.get((d, k, item), (0, 0))[:2]:
                best[d, k, item] = (share, -start, q, a)
    return [(d, ixs[k].item_ids[item], -s, share, q, a) for (d, k, item), (share, s, q, a) in sorted(best.items())]


def indexes(benchmark: DataFrame, chunk: int = 20_000, chunk_bytes: int = 8_000_000, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Index]]:
    """Indexes of about `chunk` items and `chunk_bytes` of text at most, the bound on what is broadcast at once; more make more passes.

    Document frequencies and the mean length are those of all items, so what is found doesn't hang on the passes.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    n_rows, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    n = max(1, -(-n_rows // chunk), -(-size // chunk_bytes))
    if n == 1:
        found = build([(r["i"], r["t"]) for r in rows.collect()])
        if found:
            yield found
        return

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(part, t, 1, c) for part, ws in zip(batch["part"], map(tokens, batch["t"]), strict=True) for t, c in Counter(ws).items()], columns=["part", "word", "one", "c"])

    parts = materialize(rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))), "benchmark-parts")
    said = materialize(parts.mapInPandas(words, "part long, word binary, one long, c long").groupBy("part", "word").agg(F.sum("one").alias("df"), F.sum("c").alias("c")), "benchmark-words")
    every = said.groupBy("word").agg(F.sum("df").alias("df"))
    total = said.agg(F.sum("c")).first()[0] or 0
    sizes = parts.mapInPandas(_lengths, "size long, length long").groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("span")).collect()  # a few sizes
    with_words, spans = sum(r["n"] for r in sizes), {r["size"]: r["span"] for r in sizes}
    for k in range(n):
        own = said.where(F.col("part") == k).select("word")
        df = {bytes(r["word"]): r["df"] for r in every.join(own, "word", "left_semi").collect()}  # of a part's words
        found = build([(r["i"], r["t"]) for r in parts.where(F.col("part") == k).collect()], Statistics(with_words, total / max(with_words, 1), df, spans))
        if found:
            yield found


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [n for n in map(len, map(tokens, batch["t"])) if n]
        yield pd.DataFrame({"size": list(map(_size, own)), "length": own}, dtype="int64")


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, bm25_share, question_overlap, answer_overlap of every verified hit.

    Null and empty texts have none. Items of the same id count each for itself, those without one too; items without a word
    have no hits, those of fewer than five words hit where they stand word by word. Repeated documents have hits each, null ids too. Empty tables give
    no rows. Other columns are not read.
    """
    schema = "doc_id long, item_id long, first_word long, bm25_share double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for ixs in indexes(benchmark):
        shared = spark.sparkContext.broadcast(ixs)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), [t if isinstance(t, str) else None for t in batch["text"]]
                rows = [(None if pd.isna(ids[at + d]) else ids[at + d], item, s, x, q, a) for at in range(0, len(texts), 200) for d, item, s, x, q, a in hits(shared.value, texts[at : at + 200], threshold, overlap)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

        out = out.unionAll(own.mapInPandas(run, schema))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.6, text_col: str = "text") -> DataFrame:
    """docs without the rows that find() has a hit for; all columns stay, nothing is shuffled. Null and empty texts stay, repeated rows fare alike."""
    for ixs in indexes(benchmark):
        kept = fresh(docs.columns, "_clean")
        docs = docs.withColumn(kept, _clean(docs.sparkSession.sparkContext.broadcast(ixs), threshold, overlap)(docs[text_col].cast("string"))).where(kept).drop(kept)
    return docs


def _clean(shared: Broadcast, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = [t if isinstance(t, str) else None for t in texts]
        ok = np.ones(len(own), dtype=bool)
        for at in range(0, len(own), 200):
            ok[[at + h[0] for h in hits(shared.value, own[at : at + 200], threshold, overlap)]] = False
        return pd.Series(ok)

    return clean
