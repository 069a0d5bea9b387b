"""Toxicity by noisy-channel deobfuscation (operator 2).

A character language model (4-grams over a folded alphabet) is counted over all documents.
Tokens that look disguised - letters mixed with leetspeak, letters spaced out, letters
repeated three times or more - open a lattice: each sign may stand for itself, for the
letters it resembles, or for nothing (a separator or a repeat). Viterbi decoding under the
language model picks the reading, and the restored text is scored: a logistic model over
character patterns (words, word beginnings and inner 5-grams) that a bounded labelled sample
shows to be typical of toxic texts. Patterns are found by one Aho-Corasick pass.

Edge cases: null and empty texts hold no pattern and get the model's base score; a sample
without toxic rows gives a constant low score; null ids are scored and not held out; extra
columns are ignored (``clean`` keeps them); repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.learning import held_out, training_rows

SAMPLE = 20_000       # labelled documents fitted on, at most
FOLDS, FOLD = 5, 0    # crc32(doc_id) mod 5 = 0 is held out
THRESHOLD = 0.5
PATTERNS = 4096       # character patterns the model holds, at most: its size, not a cut of the rows
SUPPORT = 3           # toxic documents a pattern needs
LIFT = 6.0            # times as frequent in toxic documents
ORDER, SIGNS = 4, 32  # of the language model: 32^4 counts
REMEMBERED = 32       # signs of a token whose reading is remembered, at most
SETTLE = 64           # signs after which the readings' common beginning is put aside

#: fixed values: letters that a sign may stand for
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'`^ "
#: costs of the channel, in nats
STANDS_FOR, DROPPED, REPEATED, KEPT = 1.0, 1.0, 0.3, 3.0

_FOLD = np.zeros(256, np.uint8)               # 0: between words
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)
_FOLD[128:] = 27
_FOLD[48:58] = 28
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_EDGE = "".join(set("\"'.,;:?!()[]{}<>#%&*$|=~^+-_/\\@"))
_LEADS = frozenset("@$!|+(")                  # signs that may stand for a word's first letter
_MARKS = "".join(set(_EDGE) - set("@$|+"))    # what ends a word and reads as no letter; '!' and '(' are punctuation
_BLANK = bytes(32 if chr(b) in "\"'.,;:?!()[]{}<>#%&*$|=~^+-_/\\@\t\n\r\v\f0123456789" else b for b in range(256))


# ---- language model -------------------------------------------------------------------------

def _grams(text: str) -> np.ndarray:
    s = _FOLD[np.frombuffer((" " * (ORDER - 1) + text + "    ").encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
    return ((s[:-3] * SIGNS + s[1:-2]) * SIGNS + s[2:-1]) * SIGNS + s[3:]


def _gram_table(texts: list[str]) -> np.ndarray:
    """4-gram counts of a list of texts, in slices of bounded size; grams never span two texts."""
    joined, total = (" " * (ORDER - 1)).join(texts), np.zeros(SIGNS**ORDER, np.int64)
    step = 1 << 22
    for at in range(0, len(joined), step):
        total += np.bincount(_grams(joined[at:at + step]), minlength=len(total))
    return total


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): 4-gram counts over all documents; at most 32^4 rows whatever the input."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(SIGNS**ORDER, np.int64), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                held.append(text)
                size += len(text)
                if size > 1 << 20:
                    total += _gram_table(held)
                    held, size = [], 0
        total += _gram_table(held)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen.astype(np.int32), "n": total[seen]})

    texts = docs.filter(F.length("text") > 0).select("text")
    return texts.mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(sign | three signs before), as a table of 32^4 floats."""
    rows = gram_counts(docs).toPandas()
    counts = np.zeros(SIGNS**ORDER)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(SIGNS, SIGNS, SIGNS, SIGNS)
    lower = counts.sum(axis=(0, 1))
    back = (lower + 0.5) / (lower + 0.5).sum(axis=1, keepdims=True)
    strength = 5.0
    full = (counts + strength * back[None, None]) / (counts.sum(axis=3, keepdims=True) + strength)
    return np.log(full).astype(np.float32).ravel()


def _readings(token: str) -> Iterator[list[tuple[str, float]]]:
    """Per sign of a token: what it may read as, with the channel's cost."""
    for i, c in enumerate(token):
        if c.isalpha():
            yield [(c, 0.0), *([("", REPEATED)] if i and token[i - 1] == c else [])]
        else:
            options = [(x, STANDS_FOR) for x in LOOKALIKES.get(c, "")]
            if c in SEPARATORS or not options:
                options.append(("", DROPPED))
            yield [*options, (c, KEPT)]


def _legible(token: str | list[str]) -> bool:
    """Whether a token may be a disguised word: two letters, or one among three signs that may stand for letters."""
    letters = sum(c.isalpha() for c in token)
    return letters >= 2 or letters == 1 and sum(c in LOOKALIKES for c in token) >= 2


def _sign(c: str) -> int:
    return int(_FOLD[ord(c)]) if ord(c) < 128 else 27


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a (lower-case) token of any length: Viterbi over its lattice, states = last three signs."""
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    settled = []
    for k, options in enumerate(_readings(token), 1):
        following: dict[int, tuple[float, str]] = {}
        for state, (score, text) in states.items():
            for read, cost in options:
                if read:
                    gram = state * SIGNS + _sign(read)
                    new, value, full = gram % SIGNS**3, score + float(model[gram]) - cost, text + read
                else:
                    new, value, full = state, score - cost, text
                if new not in following or value > following[new][0]:
                    following[new] = value, full
        states = following
        if k % SETTLE == 0:                   # what all readings begin with will not change any more
            same = len(commonprefix([text for _, text in states.values()]))
            settled.append(next(iter(states.values()))[1][:same])
            states = {state: (score, text[same:]) for state, (score, text) in states.items()}
    settled.append(max((score + float(model[state * SIGNS]), text) for state, (score, text) in states.items())[1])
    return "".join(settled)


class Restorer:
    """Lower-cases a text and replaces its disguised tokens; remembers up to ``most`` of them."""

    def __init__(self, model: np.ndarray, most: int = 100_000):
        self.model, self.most, self.known = model, most, {}

    def _read(self, bare: str) -> str:
        if len(bare) > REMEMBERED:
            return decode(bare, self.model)
        if bare not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[bare] = decode(bare, self.model)
        return self.known[bare]

    def _word(self, word: str) -> str:
        """A word with look-alikes or separators inside: its likeliest reading."""
        bare = word.strip(_EDGE)
        if len(bare) < 2:                                        # too little without its signs: they may be letters
            bare = word.strip(_MARKS)
        elif word[0] in _LEADS and word[1:2].isalpha():
            bare = word.rstrip(_EDGE)
        if bare.isalpha() or not bare:
            return word
        return self._read(bare) if _legible(bare) else word

    def __call__(self, text: str | None) -> str:
        low = (text or "").lower()
        words = low.split()
        for i in [i for i, w in enumerate(words) if not w.isalpha()]:
            words[i] = self._word(words[i])
        raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
        if ((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] >= 97) & (raw[2:] <= 122)).any():
            for i in [i for i, w in enumerate(words) if _TRIPLE.search(w)]:
                bare = words[i].strip(_EDGE)                     # r e p e e e ated letters
                words[i] = self._read(bare)
        single = [i for i, w in enumerate(words) if len(w) == 1 and (w.isalpha() or w in LOOKALIKES)]
        if len(single) > 2:                                      # s p a c e d letters
            for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1):
                if len(run) >= 3 and _legible([words[i] for i in run]):
                    words[run[0]] = self._read(" ".join(words[i] for i in run))
                    for i in run[1:]:
                        words[i] = ""
        restored = f" {' '.join(words)} "
        return restored.encode("utf-8", "surrogatepass").translate(_BLANK).decode("utf-8", "surrogatepass")


# ---- patterns and weights -------------------------------------------------------------------

def patterns_of(restored: str) -> set[str]:
    """Words, word beginnings and inner 5-grams of a restored text."""
    out: set[str] = set()
    for w in set(restored.split()):
        if len(w) < 3 or len(w) > 40:
            continue
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in (4, 5, 6) if len(w) > n)
        out.update(w[i:i + 5] for i in range(1, len(w) - 4))
    return out


def toxic_patterns(sample: DataFrame, model: np.ndarray) -> list[str]:
    """The patterns that mark toxic texts of the sample, strongest first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(model)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                seen: dict[str, list[int]] = {}
                for text, label in zip(pdf["text"][at:at + 500], pdf["label"][at:at + 500], strict=True):
                    for p in patterns_of(restore(text)):
                        seen.setdefault(p, [0, 0])[int(label)] += 1
                yield pd.DataFrame({"pattern": pd.Series(list(seen), dtype=object), "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]})

    totals = sample.groupBy("label").agg(F.count("*").alias("n")).toPandas().set_index("label")["n"]
    clean, toxic = float(totals.get(0, 0)), float(totals.get(1, 0))
    if not toxic:
        return []
    counted = sample.mapInPandas(count, "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    strong = counted.filter(F.col("toxic") >= SUPPORT).withColumn("lift", lift).filter(F.col("lift") >= LIFT)
    best = strong.orderBy(F.desc(F.col("toxic") * F.log("lift")), "pattern").limit(PATTERNS)
    return [r["pattern"] for r in best.select("pattern").collect()]


class Scorer:
    """Restores a text, finds the patterns and gives the logistic score. Built once per task."""

    def __init__(self, model: np.ndarray, patterns: list[str], weights: np.ndarray, bias: float):
        import ahocorasick

        self.restore, self.weights, self.bias, self.n = Restorer(model), weights, bias, len(patterns)
        self.found = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            self.found.add_word(p, k)
        if patterns:
            self.found.make_automaton()

    def hits(self, text: str | None) -> list[int]:
        restored = self.restore(text)
        return sorted({k for _, k in self.found.iter(restored)}) if self.n and restored.strip() else []

    def __call__(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.hits(text)].sum()) if self.n else self.bias
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))


def _logistic(hits: list[list[int]], y: np.ndarray, k: int, steps: int = 300, ridge: float = 2e-4, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (never negative) and bias of a logistic model over pattern presence, by Adam on the whole sample."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.fromiter((c for h in hits for c in h), dtype=np.int64, count=len(rows))
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = -2.0
    for t in range(1, steps + 1):
        z = w[k] + np.bincount(rows, w[cols], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        g = np.append(np.bincount(cols, error[rows], minlength=k), error.sum()) / len(y)
        g[:k] += ridge * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:k] = np.maximum(w[:k], 0)
    return w[:k], float(w[k])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, list[str], np.ndarray, float]:
    """(language model, patterns, weights, bias); the driver holds the 32^4 table and the sample's pattern hits."""
    model = language_model(docs)
    rows = training_rows(docs, labels, "toxic", FOLDS, FOLD, sample).persist()
    patterns = toxic_patterns(rows, model)
    if not patterns:
        rows.unpersist()
        return model, [], np.zeros(0), -4.0

    @F.pandas_udf("array<int>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = Scorer(model, patterns, np.zeros(len(patterns)), 0.0)
        for batch in texts:
            yield pd.Series([found.hits(t) for t in batch], dtype=object)

    seen = rows.select(hits("text").alias("hits"), "label").toPandas()
    rows.unpersist()
    weights, bias = _logistic([list(h) for h in seen["hits"]], seen["label"].to_numpy(dtype=float), len(patterns))
    return model, patterns, weights, bias


def toxicity(text: Column, trained: tuple[np.ndarray, list[str], np.ndarray, float]) -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*trained)
        for batch in texts:
            yield pd.Series([scorer(t) for t in batch], dtype=float)

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    trained = train(docs, labels, sample)
    scored = docs.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), toxicity(F.col("text"), trained).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows whose score stays below the threshold."""
    trained = train(docs, labels, sample)
    return docs.filter(toxicity(F.col("text"), trained) < threshold)
