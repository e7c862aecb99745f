"""Language ID (operator 10): unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations of the product of their pieces, by the
forward algorithm; the probabilities come from expectation maximisation over the word
counts of training documents. A text's score is the product over its words. Words are never cut: the
algorithm carries on as many positions as the longest piece has characters, scaled as it goes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.llm.common import fresh, give_back, learn_part

UNDETERMINED = "und"
_WORDS = regex.compile(r"\p{L}+").findall
_MARK = "▁"
#: Odds of the model's last column, a text in none of the languages, in which every piece of the vocabulary is as likely as any other.
NONE = 1e-3
BATCH, KEPT = 1 << 20, 64  # cells of a lattice at once; longer words aren't kept between texts
RESCALE = 8


def load_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file, lower-cased, the word-start mark included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in found if p})


def word_counts(text: str | None) -> Counter:
    """Counts of the text's letter runs, lower-cased and whole, each marked as a word's start."""
    return Counter({_MARK + w: n for w, n in Counter(_WORDS((text or "").lower())).items()})


class Pieces:
    """Numbers of pieces by rolling hash, looked up for whole arrays; open addressing at a low load."""

    SLOTS = 20

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.zeros(1 << self.SLOTS, dtype=np.uint64)
        self.numbers = np.full(1 << self.SLOTS, -1, dtype=np.int32)
        for n, p in enumerate(pieces):
            key = 0
            for c in p:
                key = (key * int(_BASE) + ord(c)) % (1 << 64)
            slot = (key * int(_SPREAD)) % (1 << 64) >> (64 - self.SLOTS)
            while self.numbers[slot] >= 0:
                slot = (slot + 1) % (1 << self.SLOTS)
            self.keys[slot], self.numbers[slot] = key, n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where there is no such piece."""
        slot = ((keys * _SPREAD) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.numbers[slot]
        bad = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(bad):
            slot[bad] = (slot[bad] + 1) % (1 << self.SLOTS)
            out[bad] = self.numbers[slot[bad]]
            bad = bad[(out[bad] >= 0) & (self.keys[slot[bad]] != keys[bad])]
        return out


_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def lattice(units: list[str], pieces: Pieces) -> np.ndarray:
    """(units, longest unit + 1, longest piece): number of the piece that ends at a position with a length; size + 1 for none; a single character outside the vocabulary has number size."""
    lengths = np.array([len(u) for u in units])
    out = np.full((len(units), int(lengths.max(initial=0)) + 1, pieces.longest), pieces.size + 1, dtype=np.int32)
    code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(units)), lengths)
    offset = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - offset  # characters from here to the unit's end
    key = np.zeros(len(code), dtype=np.uint64)
    for length in range(1, pieces.longest + 1):
        at = np.flatnonzero(left >= length)
        key[at] = key[at] * _BASE + code[at + length - 1]
        got = pieces.find(key[at])
        if length == 1:
            got = np.where(got < 0, pieces.size, got)
        hit = got >= 0
        out[of[at[hit]], offset[at[hit]] + length, length - 1] = got[hit]
    return out


def forward(cells: np.ndarray, lengths: np.ndarray, prob: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods (units, languages), and with keep alpha (positions, units, languages) and the logarithms of its scales (positions, units).

    prob (pieces, languages) has a last row of zeros. Only as many positions as the longest piece has characters are carried on; they
    are scaled anew every few steps, so that words of any length neither overflow nor vanish.
    """
    n, positions, longest = cells.shape
    langs = prob.shape[1]
    near = np.zeros((longest, n, langs))  # alpha of the positions before, the last one first
    near[0] = 1
    log = np.zeros(n)
    out = np.zeros((n, langs))
    held, scales = (np.zeros((positions, n, langs)), np.zeros((positions, n))) if keep else (near, log)
    if keep:
        held[0] = 1
    for end in range(1, positions):
        now = near[0] * prob[cells[:, end, 0]]
        for length in range(2, min(end, longest) + 1):
            now += near[length - 1] * prob[cells[:, end, length - 1]]
        near[1:] = near[:-1]
        near[0] = now
        if end % RESCALE == 0:
            top = np.maximum(near.max(axis=(0, 2)), 1e-300)
            near /= top[None, :, None]
            log = log + np.log(top)
        if keep:
            held[end], scales[end] = near[0], log
        done = lengths == end
        if done.any():
            out[done] = np.log(np.maximum(near[0, done], 1e-300)) + log[done, None]
    return out, held, scales


def _backward(cells: np.ndarray, lengths: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """beta (positions, units) of one language and the logarithms of its scales."""
    n, positions, longest = cells.shape
    near = np.zeros((longest, n))  # beta of the positions after, the next one first
    log = np.zeros(n)
    out, scales = np.zeros((positions, n)), np.zeros((positions, n))
    for start in range(positions - 1, -1, -1):
        now = np.where(lengths == start, 1.0, 0.0)
        for length in range(1, min(longest, positions - 1 - start) + 1):
            now += near[length - 1] * prob[cells[:, start + length, length - 1], 0]
        near[1:] = near[:-1]
        near[0] = now
        if start % RESCALE == 0:
            top = near.max(axis=0)
            top = np.where(top > 0, top, 1.0)
            near /= top
            log = log + np.log(top)
        out[start], scales[start] = near[0], log
    return out, scales


def _together(units: list[str], longest: int) -> Iterator[list[int]]:
    """Numbers of units of like length, so many that a lattice has about BATCH cells."""
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    at = 0
    while at < len(order):
        n = max(1, BATCH // ((len(units[order[at]]) + 1) * longest))
        n = max(1, min(n, BATCH // ((len(units[order[min(at + n, len(order)) - 1]]) + 1) * longest)))
        yield order[at : at + n]
        at += n


@dataclass
class Model:
    """langs: the learnt languages; prob has a column for each, and one more for none of them."""

    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # (pieces + unknown + none, languages + 1)

    def log_likelihood(self, units: list[str]) -> np.ndarray:
        """(units, columns of prob)."""
        out = np.zeros((len(units), self.prob.shape[1]))
        for own in _together(units, self.pieces.longest):
            part = [units[i] for i in own]
            if len(part) == 1 and len(part[0]) > BATCH // self.pieces.longest:
                out[own[0]] = self._long(part[0])
            else:
                out[own] = forward(lattice(part, self.pieces), np.array([len(u) for u in part]), self.prob)[0]
        return out

    def _long(self, unit: str) -> np.ndarray:
        """Of a word whose lattice would be too large: by stretches, the last positions of each carried on to the next."""
        longest = self.pieces.longest
        step = BATCH // longest
        near, log = np.zeros((longest, self.prob.shape[1])), 0.0
        near[0] = 1
        for at in range(0, len(unit), step):
            lead = min(at, longest - 1)
            cells = lattice([unit[at - lead : at + step]], self.pieces)[0, lead + 1 :]
            for row in self.prob[cells]:
                now = (near * row).sum(axis=0)
                near[1:] = near[:-1]
                near[0] = now
                top = near.max()
                if top < 1e-100:
                    near /= max(top, 1e-300)
                    log += np.log(max(top, 1e-300))
        return np.log(np.maximum(near[0], 1e-300)) + log


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """Expectation maximisation from uniform pieces; smooth: what each piece gets on top in every round, as a share of a mean piece."""
    langs = sorted(counts)
    table = Pieces(pieces)
    prob = np.zeros((len(pieces) + 2, len(langs) + 1))
    prob[:-1, -1] = 1 / (len(pieces) + 1)
    for k, lang in enumerate(langs):
        units = sorted(counts[lang], key=lambda u: (len(u), u))
        weight = np.array([counts[lang][u] for u in units], dtype=float)
        p = prob[:, -1:].copy()
        for _ in range(rounds):
            total = np.zeros(len(pieces) + 2)
            for own in _together(units, table.longest):
                part = [units[i] for i in own]
                cells, lengths = lattice(part, table), np.array([len(u) for u in part])
                whole, alpha, a_log = forward(cells, lengths, p, keep=True)
                beta, b_log = _backward(cells, lengths, p)
                got = np.zeros(cells.shape)
                for end in range(1, int(lengths.max()) + 1):
                    after = beta[end] * weight[own]
                    for length in range(1, min(end, table.longest) + 1):
                        start = end - length
                        got[:, end, length - 1] = alpha[start, :, 0] * after * np.exp(np.minimum(a_log[start] + b_log[end] - whole[:, 0], 600))
                total += np.bincount(cells.ravel(), weights=got.ravel() * p[cells.ravel(), 0], minlength=len(total))
            total[-1] = 0
            total[:-1] += smooth * max(total.sum(), 1.0) / (len(pieces) + 1)
            p = (total / total.sum())[:, None]
        prob[:, k] = p[:, 0]
    return Model(langs, table, prob)


def train(docs: DataFrame, pieces: list[str], docs_per_lang: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most docs_per_lang documents of each language (the bound; those of least hash) of those that may be learnt from and have a lang and a text.

    Rare languages are so learnt as well as frequent ones. Their whole texts give word counts on the executors; the driver gets the
    counts by language, and the model has a column of the vocabulary's length for each language.
    """
    known = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("id is not null and text is not null and lang is not null").where(learn_part(F.col("id")) != 2)
    # partitions keep no more than that of a language before they are shuffled (at most 1000, as the planner has it)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = known.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).select("id", "lang").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found.setdefault(lang, Counter()).update(word_counts(text))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "unit", "n"]).astype({"n": "int64"})

    # at most docs_per_lang ids a language
    rows = known.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("lang", "text").mapInPandas(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for r in rows.toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["unit"]] = r["n"]
    return fit(counts, pieces)


class Scorer:
    """Language and score of texts; keeps the log likelihoods of up to `cache_size` units, and when these are full, of those that the texts at hand have."""

    def __init__(self, model: Model, cache_size: int = 160_000):
        self.model, self.cache_size = model, cache_size
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, model.prob.shape[1]))

    def _forget(self, but: set[str]) -> None:
        """Keeps `but` alone."""
        kept = list(but)
        self.rows = self.rows[[self.cache[u] for u in kept]]
        self.cache = dict(zip(kept, range(len(kept)), strict=True))

    def _learn(self, new: list[str]) -> None:
        if len(self.rows) < len(self.cache) + len(new):
            more = np.zeros((max(min(2 * len(self.rows), self.cache_size), len(self.cache) + len(new)), self.rows.shape[1]))
            more[: len(self.rows)] = self.rows
            self.rows = more
        start = len(self.cache)
        self.rows[start : start + len(new)] = self.model.log_likelihood(new)
        self.cache.update(zip(new, range(start, start + len(new)), strict=True))

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counted = [word_counts(t) for t in texts]
        if not self.model.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        cache, every = self.cache, set().union(*counted)
        long = [u for u in every if len(u) > KEPT]
        every.difference_update(long)
        new = every.difference(cache)
        if len(cache) + len(new) > self.cache_size:
            self._forget(every.difference(new))
            cache = self.cache
        if new:
            self._learn(list(new))
        apart = dict(zip(long, self.model.log_likelihood(long), strict=True))
        out = []
        for c in counted:
            if not c:
                out.append((UNDETERMINED, 0.0))
                continue
            total = np.zeros(self.rows.shape[1])
            for u in apart.keys() & c.keys() if apart else ():
                total += c.pop(u) * apart[u]
            total += np.fromiter(c.values(), dtype=float, count=len(c)) @ self.rows[list(map(cache.__getitem__, c))]
            total[-1] += np.log(NONE)
            best = int(total[:-1].argmax())
            part = np.exp(total - total.max())
            out.append((self.model.langs[best], float(part[best] / part.sum())))
        return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its posterior probability among the learnt languages and none of them.

    A text none of whose languages fits better than pieces drawn at random so has a score near 0, however many languages
    there are. A null text or one without a letter is `und` with score 0, and so is every text if the model has
    learnt no language. Ties go to the language first by name. The text is scored whole. Other
    columns pass through; where docs has a column of these names, the new ones get underscores. An
    empty table gives no rows. The broadcast holds the vocabulary times the languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)  # goes with the task: a worker that later stages use shouldn't hold its words
        for batch in batches:
            rows = [r for at in range(0, len(batch), 256) for r in scorer.batch(batch.slice(at, 256).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"])
            del batch, rows
        del scorer
        give_back()

    got = fresh(docs.columns, "_language")
    a, b = fresh(docs.columns, names[0]), fresh(docs.columns, names[1])
    out = docs.withColumn(got, score(docs[text_col].cast("string")))
    return out.select(*[out[c] for c in docs.columns], F.col(got)["lang"].alias(a), F.col(got)["score"].alias(b))


