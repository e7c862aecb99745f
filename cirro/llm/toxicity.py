"""Toxicity (operator 5): a support vector machine on a gap-weighted subsequence kernel over the sentences' windows.

Every sentence gives windows of one word and of two neighbouring words; runs of spaced-out letters are one word. Two windows
are alike as far as they share subsequences of three characters; a subsequence counts LAMBDA to the power of the
characters it skips, within a span of SPAN, and spaces are only ever skipped. So an inserted, dropped or set-apart
character costs little, and an insult may be cut in two or be a phrase. The kernel is approximated by Nystrom
landmarks, on which a linear machine is trained. Labels belong to documents: every sentence
of a clean document is clean, and one of a toxic document's sentences holds its
worst window, which training finds by turns (multiple instances). A sentence is as bad as its worst window, and a document's
score goes by its worst window and its second and third worst words (one word may be there by chance), through a sigmoid
fitted to documents that training has not seen.

All landmarks fold into one weight per subsequence. Words are scored once and kept. For pairs a bound comes first (the norm
of a window whose subsequences are all different is the least there is), and only pairs whose bound lies above the
text's worst word are scored exactly.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.common import fresh, learn_part

LAMBDA, SPAN = 0.6, 6
PAIRS = 100_000
POWER, WEIGHT = 1.0, 0.05  # documents that have a window count by this power; all toxic windows together weigh so much of the clean ones
LONGEST, OVERLAP = 40, 8  # longer units are cut into parts that overlap
CODES, SPACE = 64, 63
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_MARKS = string.punctuation
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s]


_LONG = (1).__lt__


def _bare(token: str) -> str:
    """token without what is neither letter nor digit at its ends."""
    w = token.strip(_MARKS)
    return w if not w or (w[0].isalnum() and w[-1].isalnum()) else _EDGE.sub("", w)


def _words(sentence: str) -> list[str]:
    """Lower-cased words without punctuation at their ends, runs of single characters joined."""
    tokens = sentence.split()
    ws = [t if t.isalnum() else _bare(t) for t in tokens]
    if all(map(_LONG, map(len, ws))):
        return ws
    out: list[str] = []
    run = ""
    for w in ws:
        if len(w) == 1:
            run += w
            continue
        if run:
            out.append(run)
            run = ""
        if w:
            out.append(w)
    if run:
        out.append(run)
    return out


def windows(text: str | None) -> tuple[set[str], set[str]]:
    """The words, with ^ and $ for their ends, and the pairs of neighbouring words of a text's sentences. Accents are left out."""
    text = (text or "").lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    one: set[str] = set()
    two: set[str] = set()
    for sentence in sentences(text):
        ws = _words(sentence)
        one.update(ws)
        two.update(map(" ".join, zip(ws, ws[1:], strict=False)))
    long = [w for w in one if len(w) > LONGEST]
    words = {f"^{w}$" for w in one.difference(long)} if long else {f"^{w}$" for w in one}
    for w in long:
        words.update(w[at : at + LONGEST] for at in range(0, len(w) - OVERLAP, LONGEST - OVERLAP))
    return words, two


def _marked(pair: str) -> str:
    """A pair as a unit; of a long one the inner ends."""
    if len(pair) <= LONGEST:
        return f"^{pair}$"
    a, b = pair.split(" ")
    return f"{a[-LONGEST // 2:]} {b[:LONGEST // 2]}"


def units(text: str | None) -> set[str]:
    words, pairs = windows(text)
    return words.union(map(_marked, pairs))


def _table() -> np.ndarray:
    """Codes of the characters below 128: a-z, digits, ^ and $ have codes of their own, other characters share 25, the space is none of them."""
    o = np.arange(128)
    code = 38 + o % 25
    code = np.where((o >= 97) & (o <= 122), o - 97, code)
    code = np.where((o >= 48) & (o <= 57), o - 48 + 26, code)
    code[[94, 36, 32]] = 36, 37, SPACE
    return code.astype(np.int32)


_LOW = _table()


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return _LOW[np.frombuffer(text.encode(), dtype=np.uint8)]
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where(o < 128, _LOW[np.minimum(o, 127)], 38 + o % 25).astype(np.int32)


def subsequences(us: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit number, subsequence and weight, one row for each subsequence of each unit, weights of norm 1 in a unit."""
    flat = _codes("".join(us)).astype(np.int64)
    of = np.repeat(np.arange(len(us)), [len(u) for u in us])
    n = len(flat)
    keys, weights = [], []
    for j, k in _GAPS:
        if n <= k:
            continue
        same = np.flatnonzero((of[: n - k] == of[k:]) & (flat[: n - k] != SPACE) & (flat[j : n - k + j] != SPACE) & (flat[k:] != SPACE))
        keys.append(of[same] * CODES**3 + (flat[same] * CODES + flat[same + j]) * CODES + flat[same + k])
        weights.append(np.full(len(same), LAMBDA ** (k - 2)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
    unit, sub = key[first] // CODES**3, key[first] % CODES**3
    norm = np.sqrt(np.bincount(unit, weights=total**2, minlength=len(us)))
    return unit, sub, total / norm[unit]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of each pair; 0 for units without a subsequence."""
    unit, sub, weight = subsequences(b)
    known = np.unique(sub)
    dense = np.zeros((len(known) + 1, len(b)), dtype=np.float32)
    np.add.at(dense, (np.searchsorted(known, sub), unit), weight)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(a), 1000):
        unit, sub, weight = subsequences(a[at : at + 1000])
        place = np.searchsorted(known, sub)
        hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == sub) if len(known) else np.zeros(0, int)
        unit, place, weight = unit[hit], place[hit], weight[hit]
        if not len(unit):
            continue
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        for lo in range(0, len(first), 200):  # bounded memory
            s, e = first[lo], first[lo + 200] if lo + 200 < len(first) else len(unit)
            part = dense[place[s:e]] * weight[s:e, None].astype(np.float32)
            out[at + unit[first[lo : lo + 200]]] = np.add.reduceat(part, first[lo : lo + 200] - s, axis=0)
    return out


@cache
def _least_norms() -> np.ndarray:
    """(length, place of the space or length): norm of a window all of whose subsequences are different."""
    most = LONGEST + 4
    out = np.zeros((most, most))
    for length in range(most):
        for space in range(length + 1):
            there = np.ones(length, dtype=bool)
            there[space : space + 1] = False
            out[length, space] = np.sqrt(sum(LAMBDA ** (2 * (k - 2)) * (there[:-k] & there[j : length - k + j] & there[k:]).sum() for j, k in _GAPS if k < length))
    return np.maximum(out, 1e-9)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(CODES**3, np.float32))
    bias: float = -1.0
    slopes: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0, 0, 0]))  # of a text's worst window, second and third worst word, and of their squares
    shift: float = -3.0

    def margins(self, us: list[str]) -> np.ndarray:
        """Of each unit; a few thousand at a time, for memory's sake."""
        out = np.full(len(us), self.bias)
        for at in range(0, len(us), 4000):
            part = us[at : at + 4000]
            unit, sub, weight = subsequences(part)
            out[at : at + len(part)] += np.bincount(unit, weights=weight * self.weights[sub], minlength=len(part))
        return out

    def bounds(self, us: Sequence[str]) -> np.ndarray:
        """What margins() of each unit can be at most; units of one space at most. Some at a time, for memory's sake."""
        out = np.full(len(us), self.bias)
        for at in range(0, len(us), PAIRS):
            part = us[at : at + PAIRS]
            space = np.fromiter((u.find(" ") for u in part), dtype=np.int64, count=len(part))
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            out[at : at + len(part)] = self._bounds(_codes("".join(part)), lengths, np.where(space < 0, lengths, space))
        return out

    def pair_bounds(self, pairs: list[str]) -> np.ndarray:
        """bounds() of pairs that bear no marks yet; long ones get the highest bound there is."""
        c = _codes(f"^{'$^'.join(pairs)}$")
        lengths = np.fromiter(map(len, pairs), dtype=np.int64, count=len(pairs)) + 2
        space = np.flatnonzero(c == SPACE) - (np.cumsum(lengths) - lengths)
        long = lengths > LONGEST + 2
        return np.where(long, np.inf, self._bounds(c, lengths, np.where(long, 0, space), ~long))

    def _bounds(self, c: np.ndarray, lengths: np.ndarray, space: np.ndarray, known: np.ndarray | bool = True) -> np.ndarray:
        stops = np.cumsum(lengths)
        starts = stops - lengths
        n, total = len(c), np.zeros(len(lengths))
        pair = {j: c[: n - j] * CODES + c[j:] for j in range(1, SPAN)} if n > SPAN else {}
        weights = self.seen
        for k in range(2, SPAN) if pair else ():
            got = weights.take(pair[1][: n - k] * CODES + c[k:])
            for j in range(2, k):
                got += weights.take(pair[j][: n - k] * CODES + c[k:])
            run = np.concatenate([[0.0], np.cumsum(got, dtype=np.float64)])
            total += LAMBDA ** (k - 2) * (run[np.maximum(stops - k, starts).clip(max=n - k)] - run[starts.clip(max=n - k)])
        return np.maximum(total, 0) / _least_norms()[np.where(known, lengths, 0), np.where(known, space, 0)] + self.bias + 1e-6

    @cached_property
    def seen(self) -> np.ndarray:
        """weights, but none for subsequences with a space."""
        out = self.weights.reshape(CODES, CODES, CODES).copy()
        out[SPACE], out[:, SPACE], out[:, :, SPACE] = 0, 0, 0
        return out.ravel()

    def worst(self, words: np.ndarray, pair: float) -> tuple[float, float, float]:
        """The features of a text: the margin of its worst window, and those of its second and third worst words, of its words' margins and its worst pair's."""
        top = np.sort(np.partition(words, -3)[-3:] if len(words) > 3 else words)[::-1].tolist()
        top += [self.bias - 1] * (3 - len(top))
        return max(top[0], pair), top[1], top[2]

    def features(self, us: Sequence[str]) -> tuple[float, float, float]:
        words, pairs = [u for u in us if " " not in u], [u for u in us if " " in u]
        own = self.margins(words)
        best = own.max(initial=self.bias - 1)
        above = [pairs[i] for i in np.flatnonzero(self.bounds(pairs) > best)] if pairs else []
        return self.worst(own, self.margins(above).max(initial=self.bias - 1))

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Of rows of worst()."""
        return 1 / (1 + np.exp(-np.clip(_with_squares(features) @ self.slopes + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost * weight[active]
        step = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), xa.T @ (ca * y[active]))
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


def fit(docs: list[tuple[int, Sequence[str]]], landmarks: int = 400, rounds: int = 4, cost: float = 1.0, negatives: int = 12_000, seed: int = 0) -> Model:
    """docs: label and units of training documents, in an order that has nothing to do with the label.

    A quarter of them only fits the sigmoid. Without both labels the model calls nothing toxic. landmarks bounds the
    machine's dimensions, and negatives the words of clean documents in one round, the most frequent third and others by
    chance, to which come a quarter as many pairs by chance and as many of the worst windows.
    """
    part = [d for n, d in enumerate(docs) if n % 4 != 3]
    pos, neg = [u for y, u in part if y == 1 and u], [u for y, u in part if y == 0 and u]
    if not pos or not neg:
        return Model()
    rng = np.random.default_rng(seed)
    in_pos, in_neg = Counter(x for u in pos for x in u), Counter(x for u in neg for x in u)
    names = list(in_pos)
    proof = dict(zip(names, _evidence(np.array([in_pos[x] for x in names]), np.array([in_neg[x] for x in names]), len(pos), len(neg)).tolist(), strict=True))
    strong = 2 * np.log(len(names) + 1)  # by chance one unit of all, or none, has as much
    toxic = sorted(proof, key=lambda x: (-proof[x], x))[: landmarks // 2]
    usual = sorted(in_neg, key=lambda x: (-in_neg[x], x))[: landmarks - len(toxic)]
    marks = list(dict.fromkeys([*toxic, *usual]))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystrom map: kernel to the landmarks times this
    pool = sorted(in_neg)
    words, pairs = [x for x in pool if " " not in x], [x for x in pool if " " in x]
    often = sorted(words, key=lambda x: (-in_neg[x], x))[: negatives // 3]
    sample = list(dict.fromkeys([*often, *[words[i] for i in rng.permutation(len(words))[: negatives - len(often)]], *[pairs[i] for i in rng.permutation(len(pairs))[: negatives // 4]]]))
    unit, sub, weight = subsequences(marks)
    # what clean documents hold is clean, but for a few wrong labels: a unit that more than one in 500 of them has needs proof that
    # toxic ones have it more often, and so do two words together, for by chance any two are new; at first a unit must be proved,
    # later it must lie on the toxic side: a document that nothing speaks for teaches nothing
    dirty = [[x for x in u if proof[x] >= strong or (in_neg[x] * 500 <= len(neg) and " " not in x)] for u in pos]
    every = sorted({x for u in dirty for x in u})
    got: dict[str, float] = {}
    model, pick = Model(), lambda u: max(u, key=lambda x: (proof[x], x))
    for turn in range(rounds):
        found = [pick(u) for u in ([x for x in u if (x in got if turn else proof[x] >= strong)] for u in dirty) if u]
        worst = Counter(found)
        if not worst:
            return Model()
        hard = sample if turn == 0 else list(dict.fromkeys([*sample, *[pool[i] for i in np.argsort(-model.bounds(pool), kind="stable")[: negatives // 4]]]))
        x = kernel([*worst, *hard], marks) @ root
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([1.0] * len(worst) + [-1.0] * len(hard))
        share = np.array([worst[u] for u in worst] + [in_neg[u] for u in hard], dtype=float) ** POWER
        share[len(worst) :] *= len(hard) / share[len(worst) :].sum()
        share[: len(worst)] *= len(hard) / share[: len(worst)].sum() * WEIGHT
        w = _svm(x, y, share, cost)
        beta = root @ w[:-1]
        weights = np.zeros(CODES**3, np.float32)
        np.add.at(weights, sub, weight * beta[unit])
        model = Model(weights, float(w[-1]))
        maybe = [every[i] for i in np.flatnonzero(model.bounds(every) > 0)] if every else []
        got = {u: m for u, m in zip(maybe, model.margins(maybe).tolist(), strict=True) if m > 0}
        pick = lambda u: max(u, key=lambda x: (got[x], x))  # noqa: E731,B023
    rest = [d for n, d in enumerate(docs) if n % 4 == 3]
    if min(sum(y == k for y, _ in rest) for k in (0, 1)) < 10:
        rest = docs  # too few to go by alone
    found = np.array([model.features(u) for _, u in rest])
    label = np.array([y for y, _ in rest], dtype=float)
    if label.min(initial=1) == label.max(initial=0):
        return model
    model.slopes, model.shift = _sigmoid(_with_squares(found), label)
    return model


def _with_squares(features: np.ndarray) -> np.ndarray:
    """Windows near the toxic side tell more than in proportion, those far on the clean side nothing."""
    return np.hstack([features, np.maximum(features, -0.5) ** 2])


def _evidence(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Twice the logarithm of the likelihood ratio of a of n and b of m documents against one share in both; 0 where the first share is the smaller."""
    share = (a + b) / (n + m)
    part = lambda k, size, p: k * np.log(np.maximum(k / size, 1e-12) / p) + (size - k) * np.log(np.maximum(1 - k / size, 1e-12) / np.maximum(1 - p, 1e-12))
    return np.where(a / n > b / m, 2 * (part(a, n, share) + part(b, m, share)), 0.0)


def _sigmoid(features: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with smoothed targets, by Newton steps."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([features, np.ones(len(features))])
    ridge = np.diag([1e-2] * features.shape[1] + [1e-3])
    w = np.array([1.0] + [0.0] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (target - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_windows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most max_docs labelled documents (the bound), half of each label, those of least hash, none of them held out.

    Their sentences become sets of windows on the executors; the driver gets those sets, of a document with more than
    max_windows the ones of least hash. A document that is labelled both ways is toxic; of an id's different texts each is a document. landmarks and
    negatives of fit() bound the machine.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(learn_part(F.col("id")) != 2)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(max_docs // 2).unionAll(known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(max_docs // 2))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(units(t), key=lambda u: (zlib.crc32(u.encode("utf-8", "surrogatepass")), u))[:max_windows] if isinstance(t, str) else [] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "y": batch["y"], "units": found})

    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).join(F.broadcast(chosen), "id")
    rows = own.mapInPandas(split, "id long, th long, y int, units array<string>")
    one = sys.intern  # a unit is kept once, however many documents have it
    found = {(r["id"], r["th"]): (r["y"], tuple(map(one, r["units"]))) for r in rows.toLocalIterator()}
    rank = np.random.default_rng(1).permutation(len(found))
    order = sorted(found)
    return fit([found[order[i]] for i in rank])


class Scorer:
    def __init__(self, model: Model, cache_size: int = 600_000):
        self.model, self.cache_size = model, cache_size
        self.cache: dict[str, float] = {}

    def batch(self, texts: list[str | None]) -> np.ndarray:
        found = [windows(t) for t in texts]
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        new = list(set().union(*[w for w, _ in found]).difference(cache)) if found else []
        cache.update(zip(new, self.model.margins(new).tolist(), strict=True))
        margins = [np.fromiter(map(cache.__getitem__, w), dtype=float, count=len(w)) for w, _ in found]
        worst = np.array([x.max(initial=self.model.bias - 1) for x in margins])
        at = 0
        while at < len(found):  # some hundred thousand pairs at a time
            to, pairs = at, []
            while to < len(found) and (to == at or len(pairs) + len(found[to][1]) <= PAIRS):
                pairs += found[to][1]
                to += 1
            of = np.repeat(np.arange(at, to), [len(p) for _, p in found[at:to]])
            for lo in range(0, len(pairs), PAIRS):
                part, own = pairs[lo : lo + PAIRS], of[lo : lo + PAIRS]
                above = np.flatnonzero(self.model.pair_bounds(part) > worst[own])
                np.maximum.at(worst, own[above], self.model.margins([_marked(part[i]) for i in above]))
            at = to
        return self.model.probability(np.array([self.model.worst(x, p) for x, p in zip(margins, worst, strict=True)]).reshape(-1, 3))


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared: Broadcast) -> Scorer:
    model = shared.value
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic, scored whole.

    Null and empty texts get the probability of a unit below any other. Repeated rows score alike. Other
    columns pass through; where docs has a column of that name, the new one gets underscores. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(shared)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            yield pd.Series(np.concatenate([scorer.batch(texts[at : at + 256]) for at in range(0, len(texts), 256)] or [np.zeros(0)]))

    return docs.withColumn(fresh(docs.columns, name), run(docs[text_col].cast("string")))
