"""Quality rules (operator 8): an isolation forest over rule statistics.

Every text gives counts and a few ratios of them. A forest of random splits is grown on the
statistics of labelled documents of good quality; a document that the splits separate after few steps is
unlike them. The cut is set on labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.common import fresh

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Symbols that are counted (fixed values).
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_DIGIT, _UPPER = re.compile(r"\d+"), re.compile(r"[A-Z]+")
_STOPS = re.compile(r"[.!?](?=\s|$)")
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.int64).astype(np.uint64) | np.uint64(1)
#: The forest's columns: ratios, so that length alone condemns no text.
STATISTICS = ("mean_word", "symbols", "dup_lines", "repeats", "digits", "capitals", "distinct", "marks", "line_words", "stops", "ends")


def repeat_words(ws: list[bytes]) -> int:
    """Words in 8-word windows that the text has twice or more, the first included; a word counts once."""
    n = len(ws) - WINDOW + 1
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in ws), dtype=np.int64, count=len(ws))
    if len(code) == len(ws):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(WINDOW):
        h += mixed[k : k + n] * _MIX[k]
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    # equal hashes are compared by their words
    at = np.flatnonzero(twice)
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():
        seen.setdefault(tuple(ids[i : i + WINDOW].tolist()), []).append(i)
    cover = np.zeros(len(ws) + 1, dtype=np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(cover, places, 1)
            np.add.at(cover, np.asarray(places) + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """BASE counts and STATISTICS of a whole text (null: of no words)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    n = len(ws)
    joined = b"".join(ws)
    chars = sum(1 for _ in joined.decode("utf-8", "surrogatepass")) if not joined.isascii() else len(joined)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(ws)
    d, c = max(n, 1), max(chars, 1)
    marks = chars - sum(map(len, re.findall(r"\w+", text)))
    stats = [
        chars / d, symbols / d, dup / max(len(lines), 1), repeats / d, sum(map(len, _DIGIT.findall(text))) / c, sum(map(len, _UPPER.findall(text))) / c,
        np.log(max(len(set(ws)), 1)) / np.log(n + 1) if n > 1 else 1.0, max(marks, 0) / c, np.log1p(n / max(len(lines), 1)), len(_STOPS.findall(text)) / d, float(bool(joined) and joined[-1:] in b".!?\"'"),
    ]
    return [n, chars, symbols, dup, repeats], stats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


@dataclass
class Forest:
    """Trees as arrays; feature -1 marks leaves, whose `value` is the depth and the mean path of the rows left there."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray
    norm: float
    cut: float = 1.0
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 for rows of short paths."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, s, child, value in zip(self.feature, self.split, self.left, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                go = f[node] >= 0
                right = x[rows, np.maximum(f[node], 0)] >= s[node]
                node = np.where(go, child[node] + right, node)
            total += value[node]
        return 2 ** (-total / (len(self.feature) * self.norm))


def _path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = 200, rows: int = 256, depth: int = 10, seed: int = 3) -> Forest:
    """Random splits of a box: a column that hardly varies among the rows x is still split over the whole range that documents have, so that a document far off leaves at once."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    size = 2 ** (depth + 1)
    feature, split, left, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size))
    for t in range(trees):
        stack, used = [(0, rng.permutation(len(x))[:rows], 0, box[0].copy(), box[1].copy())], 1
        while stack:
            node, own, d, low, high = stack.pop()
            wide = np.flatnonzero(high > low)
            if d == depth or len(own) < 2 or not len(wide):
                value[t, node] = d + _path(len(own))
                continue
            f = int(rng.choice(wide))
            s = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node], left[t, node] = f, s, used
            above = x[own, f] >= s
            high_l, low_r = high.copy(), low.copy()
            high_l[f] = low_r[f] = s
            stack += [(used, own[~above], d + 1, low, high_l), (used + 1, own[above], d + 1, low_r, high)]
            used += 2
    return Forest(feature, split, left, value, max(_path(rows), 1.0), depth=depth)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, lose: float = 0.005) -> Forest:
    """Sets the cut where the share of bad rows found less that of good rows lost is greatest, of cuts that lose at most `lose` of the good rows."""
    score = forest.score(x)
    own, bad = np.sort(score[good]), score[~good]
    if not len(own):
        return forest
    least = own[int(np.ceil((1 - lose) * (len(own) - 1)))]
    best, forest.cut = -1.0, float(np.nextafter(least, 2))
    for cut in np.unique(np.concatenate([bad[bad >= least], [forest.cut]])):
        gain = (bad >= cut).mean() if len(bad) else 0.0
        gain -= (own >= cut).mean()
        if gain > best:
            best, forest.cut = gain, float(cut)
    return forest


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the BASE counts and stats (array of STATISTICS) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [measure(t if isinstance(t, str) else None) for t in batch["text"]]
            out = pd.DataFrame([g[0] for g in got], columns=list(BASE), dtype="int64")
            out.insert(0, "id", batch["id"].astype("Int64").to_numpy())
            out["stats"] = [g[1] for g in got]
            yield out.astype({"id": "Int64"})

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, "id long, " + ", ".join(f"{c} long" for c in BASE) + ", stats array<double>")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    """A calibrated forest from at most max_docs labelled documents (the bound; those of least hash); None without a good one.

    The forest grows on half of the good rows; the others and the bad rows set the cut. Rows that the
    base rules fail take no part.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("y")).where("lid is not null and y in (0, 1)").groupBy("lid").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("lid"), "lid").limit(max_docs)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen.select(F.col("lid").alias("doc_id"))), "doc_id", "left_semi")
    got = {r["id"]: r for r in features(own).toLocalIterator()}
    label = {r["lid"]: r["y"] for r in chosen.toLocalIterator()}
    ids = [i for i in sorted(got) if not base_failed(got[i]["n_words"], got[i]["n_repeat_words"])]
    order = np.random.default_rng(2).permutation(len(ids))
    x = np.array([got[ids[i]]["stats"] for i in order], dtype=float).reshape(-1, len(STATISTICS))
    y = np.array([label[ids[i]] == 1 for i in order], dtype=bool)
    good = np.flatnonzero(y)
    if len(good) < 4:
        return None
    grown, rest = good[::2], np.concatenate([good[1::2], np.flatnonzero(~y)])
    box = np.quantile(x, 0.005, axis=0), np.quantile(x, 0.995, axis=0)
    return calibrate(grow(x[grown], box), x[rest], y[rest])


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, BASE, base_failed, anomaly (double), kept of every row.

    kept is false if the base rules fail the row, else whether its anomaly lies below the cut; without a forest
    the base rules alone decide and anomaly is null. Null and empty texts have no words and fail. Repeated
    rows come out as often as they came in, null ids stay null, an empty table gives no rows.
    """
    rows = features(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    if forest is None:
        rows = rows.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~failed)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def anomaly(stats: pd.Series) -> pd.Series:
            x = np.array(stats.tolist(), dtype=float).reshape(-1, len(STATISTICS))
            return pd.Series(shared.value.score(x))

        rows = rows.withColumn("anomaly", anomaly("stats")).withColumn("kept", ~failed & (F.col("anomaly") < forest.cut))
    return rows.select(F.col("id").alias("doc_id"), *BASE, failed.alias("base_failed"), "anomaly", "kept")


def filter_quality(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that judge() doesn't keep; all columns stay."""
    kept = fresh(docs.columns, "_kept")

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        got = [measure(t if isinstance(t, str) else None) for t in texts]
        ok = np.array([not base_failed(g[0][0], g[0][4]) for g in got], dtype=bool)
        if forest is not None and len(got):
            ok &= forest.score(np.array([g[1] for g in got])) < forest.cut
        return pd.Series(ok)

    return docs.withColumn(kept, keep(docs[text_col].cast("string"))).where(kept).drop(kept)
