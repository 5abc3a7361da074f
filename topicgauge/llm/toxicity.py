"""Toxicity: Levenshtein automata intersected with a trie of learned terms.

A lexicon of words and word beginnings is learned from labelled documents. Its
trie, intersected with the automaton of one edit (a wrong, missing, extra or
swapped letter), finds terms and their misspellings; the product is made
deterministic as it is visited. A hit weighs its term's log-odds, scaled by its
context window: quoted hits count apart from the others, hits near other hits
count more. A logistic model over the window scores gives the final score.

The model is fitted on a bounded sample of labelled rows (SAMPLE a class); all
documents are scored, whole, where they lie.

Defined results: null and empty texts have no hits and get the model's lowest
score; without labels of both kinds every score is 0; of several labels of one
document the highest counts, null labels do not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.session import materialize

# Labelled rows of each class that the model is fitted on, at most about.
SAMPLE = 12_000
# Terms of the lexicon at most.
MIN_LETTERS = 4
FUZZY_LETTERS = 5
STEMS = (4, 5)
# Evidence a term needs: log-likelihood ratio and log-odds.
MIN_EVIDENCE = 16.0
MIN_ODDS = 3.0
# Letters to either side in which quotes are looked for, and words in which other hits are.
QUOTE_WINDOW = 60
HIT_WINDOW = 12
LEVEL = 0.7
# Words whose verdict a worker remembers.
MEMORY = 400_000

_WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
_OPEN, _CLOSE = "\"“„«‹‘", "\"”“»›’"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Automaton:
    """Terms (exact or one edit away) and stems that a word matches.

    `terms` and `stems` map to weights. `known` words count only when exact.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: set[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.fuzzy: list[bool] = [False]
        for word, weight in terms.items():
            node = self._node(word)
            self.term[node], self.fuzzy[node] = weight, len(word) >= FUZZY_LETTERS
        for word, weight in stems.items():
            self.stem[self._node(word)] = weight
        self.known = known
        self._forget()

    def _node(self, word: str) -> int:
        node = 0
        for letter in word:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.stem.append(None)
                self.fuzzy.append(False)
            node = self.children[node][letter]
        return node

    def _forget(self) -> None:
        self.states = {}
        self.arcs: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.verdicts: dict[str, tuple[float, bool] | None] = {}
        self.start = self._state({(0, 0, "")})

    def _state(self, found: set) -> int:
        """Number of a state; a missing letter is an edit that reads nothing."""
        found |= {
            (child, 1, "")
            for node, edits, wait in found
            if edits == 0 and not wait
            for child in self.children[node].values()
        }
        key = frozenset(found)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.arcs.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, edits, wait in self.sets[state]:
            follow = self.children[node]
            if wait:  # the second of two swapped letters
                if wait == letter:
                    out.add((node, 1, ""))
                continue
            if letter in follow:
                out.add((follow[letter], edits, ""))
            if edits == 0:
                out.add((node, 1, ""))
                for other, child in follow.items():
                    out.add((child, 1, ""))
                    if other != letter and letter in self.children[child]:
                        out.add((self.children[child][letter], 1, other))
        return self._state(out)

    def judge(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the best match, or None."""
        if word in self.verdicts:
            return self.verdicts[word]
        if len(self.verdicts) > MEMORY or len(self.sets) > MEMORY:
            self._forget()
        state, stem = self.start, None
        node: int | None = 0
        for letter in word:
            arcs = self.arcs[state]
            nxt = arcs.get(letter)
            if nxt is None:
                nxt = arcs[letter] = self._step(state, letter)
            state = nxt
            if node is not None:
                node = self.children[node].get(letter)
                if node is not None and self.stem[node] is not None:
                    stem = max(stem or 0.0, self.stem[node])
            if not self.sets[state] and stem is None:
                break
        exact, near = stem, None
        for node, edits, wait in self.sets[state]:
            weight = self.term[node]
            if weight is None or wait:
                continue
            if edits == 0:
                exact = max(exact or 0.0, weight)
            elif self.fuzzy[node] and len(word) >= FUZZY_LETTERS - 1:
                near = max(near or 0.0, weight)
        if exact is not None:
            found = (exact, True)
        elif near is not None and word not in self.known:
            found = (near, False)
        else:
            found = None
        self.verdicts[word] = found
        return found


FEATURES = 4


def features(automaton: Automaton, text: str | None) -> list[float]:
    """Window scores: plain hits, misspelled hits, quoted hits, and hits a word."""
    judge = automaton.judge
    found = words_of(text)
    if not any(judge(w) for w in found):
        return [0.0] * FEATURES
    plain = fuzzy = quoted = 0.0
    hits, last = 0, -10 * HIT_WINDOW
    for at, match in enumerate(_WORD.finditer(text.lower())):
        verdict = judge(match.group())
        if verdict is None:
            continue
        weight, exact = verdict
        before = text[max(0, match.start() - QUOTE_WINDOW) : match.start()]
        after = text[match.end() : match.end() + QUOTE_WINDOW]
        if at - last <= HIT_WINDOW:
            weight *= 1.25
        hits, last = hits + 1, at
        if _in_quotes(before, after):
            quoted += weight
        elif exact:
            plain += weight
        else:
            fuzzy += weight
    return [math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * hits / len(found))]


def _in_quotes(before: str, after: str) -> bool:
    """Whether the nearest quotes around a place open before it and close after it."""
    opened = max(before.rfind(q) for q in _OPEN)
    closed = [p for p in (after.find(q) for q in _CLOSE) if p >= 0]
    if opened < 0 or not closed:
        return False
    # A straight quote that follows an even number of others opens a quotation.
    return before[opened] != '"' or before.count('"') % 2 == 1


@dataclass(frozen=True)
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    weights: tuple[float, ...] | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        line = rows @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(line, -40, 40)))


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _sampled(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, toxic, part): about `limit` labelled rows of each class, drawn by hash."""
    judged = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in judged.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for label in (0, 1):
        rate = F.when(F.col("toxic") == label, min(1.0, limit / max(1, sizes.get(label, 0)))).otherwise(rate)
    part = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(3)).cast("int")
    return judged.where(draw < rate).select("doc_id", "toxic", part.alias("part"))


def _evidence(k1: int, n1: int, k0: int, n0: int) -> tuple[float, float]:
    """(log-likelihood ratio, log-odds) of a term in k1 of n1 toxic and k0 of n0 other documents."""
    def g(k, n, p):
        return k * math.log(k / (n * p)) if k else 0.0

    share = (k1 + k0) / (n1 + n0)
    ratio = 2 * (g(k1, n1, share) + g(k0, n0, share) + g(n1 - k1, n1, 1 - share) + g(n0 - k0, n0, 1 - share)) if 0 < share < 1 else 0.0
    return ratio, math.log((k1 + 0.5) / (n1 + 1) * (n0 + 1) / (k0 + 0.5))


def _evidence_column(n1: int, n0: int) -> Column:
    """The first result of `_evidence` for the counts k1 and k0 of a row."""
    k1, k0 = F.least("k1", F.lit(n1)), F.least("k0", F.lit(n0))
    share = (k1 + k0) / float(n1 + n0)

    def g(k: Column, n: int, p: Column) -> Column:
        return F.when((k > 0) & (p > 0), k * F.log(k / (n * p))).otherwise(0.0)

    return 2 * (g(k1, n1, share) + g(k0, n0, share) + g(n1 - k1, n1, 1 - share) + g(n0 - k0, n0, 1 - share))


def _entries(text: str | None) -> set[str]:
    """Words and, marked by a star no word ends with twice, beginnings of words."""
    words = {w for w in words_of(text) if len(w) >= MIN_LETTERS}
    return words | {w[:n] + "**" for w in words for n in STEMS if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Lexicon from two thirds of the sample, logistic model from the rest."""
    sample = materialize(_sampled(labels, limit))
    sizes = {(r["toxic"], r["first"]): r["n"] for r in sample.groupBy("toxic", (F.col("part") < 2).alias("first")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get((1, True), 0), sizes.get((0, True), 0)
    if not n1 or not n0:
        return Model()
    # At most about 2 * SAMPLE narrow rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else other).update(_entries(text))
            names = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([toxic[x] for x in names], pa.int64()),
                    pa.array([other[x] for x in names], pa.int64()),
                ],
                names=["entry", "k1", "k0"],
            )

    counts = rows.where("part < 2").select("text", "toxic")
    counts = counts.mapInArrow(counted, "entry string, k1 long, k0 long")
    counts = materialize(counts.groupBy("entry").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")))
    # Entries far more frequent in toxic documents: all that pass, and what passes
    # is bounded by the sample, as each stands in three of its toxic documents at least.
    share = (F.col("k1") + 0.5) / (n1 + 1) * (n0 + 1) / (F.col("k0") + 0.5)
    found = (
        counts.where((F.col("k1") >= 3) & (F.log(share) >= MIN_ODDS))
        .where(_evidence_column(n1, n0) >= MIN_EVIDENCE - 1e-6)
        .orderBy(F.col("k1").desc(), "entry")
        .collect()
    )
    terms, stems = {}, {}
    for r in found:
        evidence, odds = _evidence(min(r["k1"], n1), n1, min(r["k0"], n0), n0)
        if evidence >= MIN_EVIDENCE:
            if r["entry"].endswith("**"):
                stems[r["entry"][:-2]] = odds
            else:
                terms[r["entry"]] = odds
    if not terms and not stems:
        return Model()

    def other_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms, {})
        for batch in batches:
            words = batch.column(0).to_pylist()
            near = [w for w in words if (v := automaton.judge(w)) and not v[1]]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["entry"])

    # Words of other documents that one edit turns into a term: fewer than a
    # term has neighbours.
    usual = counts.where("k0 > 0 AND k0 * 2 > k1 AND NOT endswith(entry, '**')").select("entry")
    known = frozenset(r[0] for r in usual.mapInArrow(other_words, "entry string").collect())
    lexicon = Model(terms, stems, known)
    measured = rows.where("part = 2").select("toxic", *_measured(lexicon, "text")).collect()
    if len({r["toxic"] for r in measured}) < 2:
        measured = rows.select("toxic", *_measured(lexicon, "text")).collect()
    x = np.array([list(r[1]) for r in measured], dtype=float).reshape(-1, FEATURES)
    y = np.array([r["toxic"] for r in measured], dtype=float)
    return Model(terms, stems, known, _logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[float, ...]:
    """Newton's method with a small ridge on all but the intercept."""
    rows = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(rows.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - y) + penalty @ w
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + penalty
        move = np.linalg.solve(bend, slope)
        w -= move * min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _measured(model: Model, text: str) -> list[Column]:
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(model.terms, model.stems, set(model.known))
        for texts in batches:
            yield pd.Series([features(automaton, x) for x in texts])

    return [F.pandas_udf(measure, "array<double>")(text).alias("features")]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each document."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(model.terms, model.stems, set(model.known))
        for texts in batches:
            rows = np.array([features(automaton, x) for x in texts]).reshape(-1, FEATURES)
            yield pd.Series(model.scores(rows))

    out = docs.select("doc_id", F.pandas_udf(score, "double")("text").alias("score"))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= LEVEL).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that no held-out label reached."""
    own = labels.where(fold(F.col("doc_id"), 3) != 1)
    return scored(docs, fit(docs, own))
