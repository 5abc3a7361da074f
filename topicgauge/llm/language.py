"""Language of words by a linear-chain conditional random field.

Words of a line, in stretches of at most STRETCH, are one chain. A word's
features are its affixes, its letter n-grams, the word itself and, for each
language, whether it lies in that language's learned lexicon; all but the last
are hashed into FEATURES weights a language. Transitions are learned on chains
that join pieces of documents of different languages, so switches inside a
line are expected. Forward-backward gives each word's distribution, and a
document's language is the one with the largest share over all its words.

The field is fitted on a bounded sample: about SAMPLE documents a language, and
CHAINS stretches shared out among the languages, LEAST or all of its own for
each. Every language with a stretch in the sample is learned, and every word of
every document is labelled.

Defined results: `und` with score 0 for null texts, texts without letters, and
when no labelled document was there to learn from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.session import materialize

UNKNOWN = "und"
STRETCH = 64
FEATURES = 1 << 17
# Bounds of the sample the field is fitted on.
SAMPLE = 600
CHAINS = 9000
# Stretches a language may have even when there are too many languages for CHAINS.
LEAST = 30
# Words of a language's lexicon, and the share of their uses that must be its own.
LEXICON = 400
OWN_SHARE = 0.8
ROUNDS = 4
CHAINS_A_STEP = 256
# Words whose weights a worker remembers, and stretches it labels at once.
MEMORY = 300_000
SLAB = 4096

_WORD = re.compile(r"[^\W\d_]+")


def stretches(text: str | None) -> list[list[str]]:
    """Words of a text, in lower case, in chains."""
    out = []
    for line in (text or "").lower().split("\n"):
        found = _WORD.findall(line)
        out += [found[i : i + STRETCH] for i in range(0, len(found), STRETCH)]
    return out


# Odd factors of the hashes, one for each letter's place in a feature.
_FACTORS = np.random.Generator(np.random.PCG64(3)).integers(
    1 << 62, 1 << 63, STRETCH, dtype=np.uint64
) | np.uint64(1)


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    """Weight numbers of the features of one kind."""
    x = values + _FACTORS[-1:] * np.uint64(kind + 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(FEATURES - 1)).astype(np.int32)


def hashed(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words: (slots, slots a word) for affixes and word, 2-grams, 3-grams.

    A word stands between two marks, so every word has features of each kind.
    """
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32)
    letters = letters.astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    begin = ends - sizes
    whole = np.empty((len(words), 7), dtype=np.int32)
    first = last = np.zeros(len(words), dtype=np.uint64)
    for n in range(4):
        inside = (n < sizes).astype(np.uint64)
        first = first + letters[np.minimum(begin + n, ends - 1)] * _FACTORS[n] * inside
        last = last + letters[np.maximum(ends - 1 - n, begin)] * _FACTORS[n] * inside
        if n:
            whole[:, n - 1], whole[:, n + 2] = _slots(first, n), _slots(last, n + 4)
    # Places past the factors share the last one; the word is one feature of many.
    place = np.minimum(np.arange(len(letters)) - np.repeat(begin, sizes), STRETCH - 1)
    whole[:, 6] = _slots(np.add.reduceat(letters * _FACTORS[place], begin), 9)
    out = [(whole.ravel(), np.full(len(words), 7))]
    owner = np.repeat(np.arange(len(words)), sizes)
    for n in (2, 3):
        grams = sum(letters[k : len(letters) - n + 1 + k] * _FACTORS[k] for k in range(n))
        same = owner[: len(letters) - n + 1] == owner[n - 1 :]
        out.append((_slots(grams[same], 8 + n), sizes - n + 1))
    return out


def _by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all features word by word, features a word)."""
    kinds = hashed(words)
    owners = np.concatenate([np.repeat(np.arange(len(words), dtype=np.int32), n) for _, n in kinds])
    order = np.argsort(owners, kind="stable")
    return np.concatenate([x for x, _ in kinds])[order], sum(n for _, n in kinds)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages
    lexicon: dict[str, int]  # word → language
    in_lexicon: np.ndarray  # lexicon's language x languages
    moves: np.ndarray  # languages x languages
    starts: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """One row of scores for each word."""
        if not words:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        rows = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for slots, many in hashed(words):
            rows += np.add.reduceat(self.weights[slots], np.cumsum(many) - many, axis=0)
        for i, w in enumerate(words):
            if w in self.lexicon:
                rows[i] += self.in_lexicon[self.lexicon[w]]
        return rows


def forward_backward(
    scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, starts: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Distributions of all places of a batch of chains, and summed ones of neighbours.

    `scores` is chains x places x languages; places past a chain's size are
    undefined in the result.
    """
    chains, places, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves)
    ahead = np.empty_like(e)
    now = e[:, 0] * np.exp(starts)
    ahead[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, places):
        now = (ahead[:, t - 1] @ step) * e[:, t]
        ahead[:, t] = now / now.sum(axis=1, keepdims=True)
    back = np.ones_like(e)
    joint = np.zeros((n, n)) if pairs else None
    for t in range(places - 2, -1, -1):
        inside = (t + 1 < sizes)[:, None]
        later = e[:, t + 1] * back[:, t + 1]
        if pairs:
            both = ahead[:, t][:, :, None] * step[None] * later[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            joint += (both * inside[:, :, None]).sum(axis=0)
        now = later @ step.T
        back[:, t] = np.where(inside, now / now.sum(axis=1, keepdims=True), 1.0)
    out = ahead * back
    return out / out.sum(axis=2, keepdims=True), joint


def _lexicon(chains: list[tuple[list[str], int]], n: int) -> dict[str, int]:
    counts = [Counter() for _ in range(n)]
    for words, label in chains:
        counts[label].update(words)
    sizes = [max(1, sum(c.values())) for c in counts]
    out = {}
    for label, own in enumerate(counts):
        for word, many in own.most_common(4 * LEXICON):
            rates = [c[word] / s for c, s in zip(counts, sizes)]
            if many >= 3 and rates[label] >= OWN_SHARE * sum(rates) and list(out.values()).count(label) < LEXICON:
                out[word] = label
    return out


def train(chains: list[tuple[list[str], int]], languages: list[str], seed: int = 1) -> Field:
    """Field from chains of one language each, joined at random into mixed ones."""
    n, random = len(languages), np.random.default_rng(seed)
    lexicon = _lexicon(chains, n)
    vocabulary: dict[str, int] = {}
    coded = [
        (np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]), label)
        for words, label in chains
    ]
    flat, sizes = _by_word(list(vocabulary))
    ends = np.cumsum(sizes)
    lexical = np.array([lexicon.get(w, n) for w in vocabulary])
    weights, seen_w = np.zeros((FEATURES, n)), np.full((FEATURES, n), 1e-6)
    in_lexicon, seen_l = np.zeros((n + 1, n)), np.full((n + 1, n), 1e-6)
    moves, seen_m = np.eye(n), np.full((n, n), 1e-6)
    starts, seen_s = np.zeros(n), np.full(n, 1e-6)

    def descend(values, seen, slope, rate):
        seen += slope * slope
        values -= rate * slope / np.sqrt(seen)

    for _ in range(ROUNDS):
        order = random.permutation(len(coded))
        at = 0
        while at < len(order):
            rows = []
            while at < len(order) and len(rows) < CHAINS_A_STEP:
                # Pieces of up to three stretches make one chain.
                take = order[at : at + random.integers(1, 4)]
                at += len(take)
                pieces = [coded[i] for i in take]
                if len(pieces) > 1:
                    pieces = [(w[: max(1, len(w) // len(pieces))], y) for w, y in pieces]
                rows.append(
                    (
                        np.concatenate([w for w, _ in pieces])[:STRETCH],
                        np.concatenate([np.full(len(w), y) for w, y in pieces])[:STRETCH],
                    )
                )
            long = np.array([len(w) for w, _ in rows])
            inside = np.arange(long.max())[None, :] < long[:, None]
            words, gold = np.zeros(inside.shape, dtype=np.int64), np.zeros(inside.shape, dtype=np.int64)
            words[inside] = np.concatenate([w for w, _ in rows])
            gold[inside] = np.concatenate([y for _, y in rows])
            used, where = np.unique(words[inside], return_inverse=True)
            spans = [flat[ends[u] - sizes[u] : ends[u]] for u in used]
            near = np.concatenate(spans)
            begin = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            scores = np.add.reduceat(weights[near], begin, axis=0) + in_lexicon[lexical[used]]
            full = np.zeros((*inside.shape, n))
            full[inside] = scores[where]
            found, joint = forward_backward(full, long, moves, starts, pairs=True)
            slope = found[inside]
            slope[np.arange(len(slope)), gold[inside]] -= 1
            by_word = np.stack([np.bincount(where, slope[:, y], len(used)) for y in range(n)], axis=1)
            spread = np.repeat(by_word, sizes[used], axis=0)
            steep = np.stack([np.bincount(near, spread[:, y], FEATURES) for y in range(n)], axis=1)
            descend(weights, seen_w, steep, 0.1)
            steep = np.stack([np.bincount(lexical[used], by_word[:, y], n + 1) for y in range(n)], axis=1)
            steep[n] = 0
            descend(in_lexicon, seen_l, steep, 0.1)
            follows = inside[:, 1:]
            pairs = np.bincount((gold[:, :-1] * n + gold[:, 1:])[follows], minlength=n * n)
            descend(moves, seen_m, joint - pairs.reshape(n, n), 0.1)
            first = found[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=n)
            descend(starts, seen_s, first, 0.1)
    return Field(languages, weights.astype(np.float32), lexicon, in_lexicon[:n], moves, starts)


class Labeller:
    """Labels the words of texts, remembering the scores of words it has met."""

    def __init__(self, model: Field):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, len(self.model.languages)), dtype=np.float32)

    def _codes(self, chains: list[list[str]]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self._forget()
        known = self.known
        new = {w for words in chains for w in words if w not in known}
        if new:
            fresh = sorted(new)
            start = len(known)
            for i, w in enumerate(fresh):
                known[w] = start + i
            while len(self.table) < len(known):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            for i in range(0, len(fresh), 1 << 14):
                part = fresh[i : i + (1 << 14)]
                self.table[start + i : start + i + len(part)] = self.model.emissions(part)
        return np.fromiter((known[w] for words in chains for w in words), dtype=np.int64)

    def words(self, chains: list[list[str]]) -> list[np.ndarray]:
        """For each chain the distributions of its words."""
        sizes = np.array([len(c) for c in chains])
        codes = self._codes(chains)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out: list[np.ndarray] = [np.empty(0)] * len(chains)
        # Chains of like size go together, so little is padded.
        for width in (8, 16, 32, STRETCH):
            some = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 8 else 0)))
            for low in range(0, len(some), SLAB):
                take = some[low : low + SLAB]
                inside = np.arange(width)[None, :] < sizes[take][:, None]
                places = begin[take][:, None] + np.arange(width)[None, :]
                scores = np.zeros((*inside.shape, len(self.model.languages)), dtype=np.float32)
                scores[inside] = self.table[codes[places[inside]]]
                found, _ = forward_backward(scores, sizes[take], self.model.moves, self.model.starts)
                for row, i in enumerate(take):
                    out[i] = found[row, : sizes[i]]
        return out

    def sums(self, chains: list[list[str]]) -> np.ndarray:
        """For each chain the summed distribution of its words."""
        found = self.words(chains)
        return np.array([f.sum(axis=0) for f in found]).reshape(len(chains), len(self.model.languages))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share) of each text."""
        total = np.zeros((len(texts), len(self.model.languages)))
        chains: list[list[str]] = []
        owners: list[int] = []

        def flush() -> None:
            if chains:
                np.add.at(total, owners, self.sums(chains))
                chains.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                own = stretches(text)
                for low in range(0, len(own), SLAB):
                    chains += own[low : low + SLAB]
                    owners += [i] * len(own[low : low + SLAB])
                    if len(chains) >= SLAB:
                        flush()
        flush()
        out = []
        for row in total:
            mass = row.sum()
            if mass <= 0:
                out.append((UNKNOWN, 0.0))
            else:
                best = int(np.argmax(row))
                out.append((self.model.languages[best], float(min(1.0, row[best] / mass))))
        return out


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def shares(counts: dict[str, int], limit: int) -> dict[str, int]:
    """Stretches each language may have: even shares of `limit`, where small ones leave room to others."""
    out, left = {}, limit
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(LEAST, left // (len(counts) - i)))
        left = max(0, left - out[lang])
    return out


def sampled(docs: DataFrame, per_language: int = SAMPLE, limit: int = CHAINS) -> list[tuple[str, list[str]]]:
    """(language, words) of about `limit` stretches, about equally many a language; none is left out."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = materialize(
        docs.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least"))
    )
    # One row for each language.
    chosen = docs.join(F.broadcast(counts), "lang").where(
        (draw < F.lit(per_language) / F.col("n")) | (draw == F.col("least"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            {"lang": pa.string(), "doc_id": pa.int64(), "place": pa.int64(), "words": pa.string()}
        )
        for batch in batches:
            rows = [
                {"lang": row["lang"], "doc_id": row["doc_id"], "place": i, "words": " ".join(words)}
                for row in batch.to_pylist()
                for i, words in enumerate(stretches(row["text"]))
                if words
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = materialize(
        chosen.select("lang", "doc_id", "text")
        .mapInArrow(cut, "lang string, doc_id long, place long, words string")
        .withColumn("draw", F.xxhash64("doc_id", "place"))
    )
    # The first stretch of each language stays whatever the draw.
    order = ["draw", "doc_id", "place", "words"]
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).collect()
    allowed = shares({r["lang"]: r["n"] for r in sizes}, limit)
    rates = rows.sparkSession.createDataFrame(
        [(r["lang"], allowed[r["lang"]] / r["n"]) for r in sizes], "lang string, rate double"
    )
    part = F.pmod(F.col("draw"), F.lit(1 << 30)) / float(1 << 30)
    kept = rows.join(F.broadcast(rates), "lang").where(part < F.col("rate")).select("lang", *order).collect()
    found = {r["lang"] for r in kept}
    kept += [(r["lang"], *r["first"]) for r in sizes if r["lang"] not in found]
    kept.sort(key=lambda r: (r[1], r[2] is not None, r[2] or 0, *r[3:], r[0]))
    return [(r[0], r[4].split(" ")) for r in kept]


def fit(docs: DataFrame) -> Field | None:
    """Field from the labelled rows of `docs`; None without any."""
    chains = sampled(docs)
    if not chains:
        return None
    languages = sorted({lang for lang, _ in chains})
    number = {lang: i for i, lang in enumerate(languages)}
    return train([(words, number[lang]) for lang, words in chains], languages)


def labelled(docs: DataFrame, model: Field | None) -> DataFrame:
    """All columns of `docs` with lang_pred and score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value)
        for texts in batches:
            yield pd.DataFrame(labeller.texts(texts.tolist()), columns=["lang_pred", "score"])

    kernel = F.pandas_udf(label, "lang_pred string, score double")
    out = docs.withColumn("_found", kernel("text"))
    return out.withColumns(
        {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}
    ).drop("_found")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) by a field that saw no held-out document."""
    own = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = labelled(docs.select("doc_id", "text"), fit(own))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
