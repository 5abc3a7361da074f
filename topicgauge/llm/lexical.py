"""Ranked lexical search: items against all documents, by branch and bound over document FP-trees.

Documents are restricted to the terms that items ask for. A task takes its
documents in blocks and inserts each block into a tree: below a class of like
`m`, documents share a path as long as their terms, the most frequent first, are
the same. Every node knows, of the documents below it, the greatest frequency
of each term and the least `m`. A score grows with frequency and falls with `m`,
so these give an upper bound of all scores below. Per item the tree is searched
depth first, the best child first, and branches whose bound is under the item's
k-th best score are left; that score is carried from block to block.

The counts of documents, terms and documents with a term are taken over all
documents. Items pass in slices of bounded size; nothing of the documents goes
to the driver, and a document leaves its task only as one of k results an item.

Defined results: null texts have no terms, and documents and items without
terms have no results; rows of one item_id (null ones too) are one item with
the terms of all of them; every document row is a document of its own, also
when ids repeat or are null, and null ids come after others of equal score.
Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.session import materialize, spread

K = 10
# A block closes at this many documents, or entries of (document, term).
BLOCK_ROWS = 8192
BLOCK_ENTRIES = 2 << 20
# Nodes of no more documents are not parted further.
LEAF = 32
# Terms of items that are broadcast at a time.
SLICE_BYTES = 16 << 20
# Bytes of a text that are split at a time.
PIECE = 1 << 20
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
_LAST_ID = np.iinfo(np.int64).max


def _folding() -> bytes:
    """Byte table: A-Z lower-cased, ASCII that is no letter or digit becomes a space."""
    table = bytearray(range(256))
    for at in range(128):
        char = chr(at)
        table[at] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


_FOLD = _folding()


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded length."""
    folded = (text or b"").translate(_FOLD)
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


# ---- items and restricted vectors ----------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of every item, counted."""
    kind = items.schema["item_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, times = [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                found: Counter = Counter()
                for part in terms_of(text):
                    found.update(part)
                at += [row] * len(found)
                terms += found.keys()
                times += found.values()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["item_id"].take(pa.array(at, pa.int64())),
                    pa.array(terms, pa.binary()),
                    pa.array(times, pa.int64()),
                ],
                ["item_id", "term", "times"],
            )

    texts = items.select("item_id", F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, f"item_id {kind}, term binary, times long")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Of every document the number of terms, and the vocabulary's terms in it with frequency."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: at for at, term in enumerate(shared.value)}
        for batch in batches:
            lengths, offsets, terms, tfs = [], [0], [], []
            for text in batch["text"].to_pylist():
                found: Counter = Counter()
                length = 0
                for part in terms_of(text):
                    length += len(part)
                    found.update(map(number.get, part))
                found.pop(None, None)
                lengths.append(length)
                terms += found.keys()
                tfs += found.values()
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(vectors, VECTORS)


# ---- the tree --------------------------------------------------------------------


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score before its weight; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """FP-tree of a block of restricted vectors.

    `ptr`, `term`, `tf`: the entries of document i are ptr[i]:ptr[i + 1], terms as
    numbers by falling frequency, ascending; every document has an entry.
    """

    def __init__(self, ids, m, ptr, term, tf, leaf: int = LEAF):
        self.ids, self.m, self.ptr, self.term = ids, m, ptr, term
        self.tf = tf
        self.gain = gains(tf, np.repeat(m, np.diff(ptr)))
        # By node: children (a range of nodes), documents (leaves only), and its entries.
        self.first, self.last = [np.zeros(1, np.int64)], [np.ones(1, np.int64)]
        self.docs: dict[int, np.ndarray] = {}
        self._entries = [(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self._grow(leaf)
        self.first, self.last = np.concatenate(self.first), np.concatenate(self.last)
        sizes = np.concatenate([sizes for sizes, _, _ in self._entries])
        self.node_ptr = np.concatenate([[0], np.cumsum(sizes)])
        self.node_term = np.concatenate([term for _, term, _ in self._entries])
        self.node_gain = np.concatenate([gain for _, _, gain in self._entries])
        del self._entries

    def _grow(self, leaf: int) -> None:
        """Level by level; the first level parts documents by their class of m."""
        count = len(self.ids)
        vocabulary = int(self.term.max(initial=0)) + 2
        lengths = np.diff(self.ptr)
        doc = np.arange(count)
        node, depth = np.zeros(count, np.int64), np.full(count, -1)
        nodes = 1
        while len(doc):
            # The next step of each document: its class of m, its next term, or its end.
            step = np.full(len(doc), vocabulary - 1)
            more = (depth >= 0) & (depth < lengths[doc])
            step[more] = self.term[self.ptr[doc[more]] + depth[more]]
            top = depth < 0
            step[top] = np.log2(self.m[doc[top]]).astype(np.int64)
            width = max(vocabulary, 64)
            keys, group, size = np.unique(node * width + step, return_inverse=True, return_counts=True)
            above, ended = keys // width, (keys % width == vocabulary - 1) & ~top.all()
            _, first, branches = np.unique(above, return_index=True, return_counts=True)
            # Documents that all go the same way stay in their node, one step further.
            parted = np.repeat(branches > 1, branches) | ended | top.all()
            number = np.full(len(keys), -1)
            number[parted] = nodes + np.arange(parted.sum())
            for at, many in zip(first, branches):
                if parted[at]:
                    self._set_children(above[at], number[at], number[at] + many)
            made = parted[group]
            order = np.argsort(group[made], kind="stable")
            self._add_nodes(doc[made][order], size[parted])
            nodes += int(parted.sum())
            final = parted & ((size <= leaf) | ended)
            for at in np.flatnonzero(final):
                self.docs[int(number[at])] = np.empty(0, np.int64)
            done = final[group]
            owner = number[group]
            by_leaf = np.argsort(owner[done], kind="stable")
            leaves, starts = np.unique(owner[done][by_leaf], return_index=True)
            for leaf_node, held in zip(leaves, np.split(doc[done][by_leaf], starts[1:])):
                self.docs[int(leaf_node)] = held
            node = np.where(made, owner, node)[~done]
            doc, depth = doc[~done], depth[~done] + 1

    def _set_children(self, node: int, first: int, last: int) -> None:
        at = node
        for block_first, block_last in zip(self.first, self.last):
            if at < len(block_first):
                block_first[at], block_last[at] = first, last
                return
            at -= len(block_first)

    def _add_nodes(self, docs: np.ndarray, sizes: np.ndarray) -> None:
        """Nodes over consecutive runs of `docs`: greatest tf of each term, least m."""
        self.first.append(np.zeros(len(sizes), np.int64))
        self.last.append(np.zeros(len(sizes), np.int64))
        if not len(sizes):
            return
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        least = np.minimum.reduceat(self.m[docs], starts)
        entry, lengths = _ranges(self.ptr[docs], self.ptr[docs + 1])
        at = np.repeat(np.repeat(np.arange(len(sizes)), sizes), lengths)
        width = int(self.term.max()) + 1
        keys = at * width + self.term[entry]
        order = np.argsort(keys, kind="stable")
        keys, head = np.unique(keys[order], return_index=True)
        most = np.maximum.reduceat(self.tf[entry][order], head)
        held = np.bincount(keys // width, minlength=len(sizes))
        self._entries.append((held, keys % width, gains(most, least[keys // width])))

    def bounds(self, lo: int, hi: int, worth: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores below nodes lo … hi - 1."""
        a, b = self.node_ptr[lo], self.node_ptr[hi]
        return np.add.reduceat(worth[self.node_term[a:b]] * self.node_gain[a:b], self.node_ptr[lo:hi] - a)

    def scores(self, docs: np.ndarray, worth: np.ndarray) -> np.ndarray:
        entry, lengths = _ranges(self.ptr[docs], self.ptr[docs + 1])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(worth[self.term[entry]] * self.gain[entry], starts)

    def search(self, worth: np.ndarray, best: "Best") -> int:
        """Adds the block's documents to an item's `best`; returns how many nodes were bounded."""
        looked = 0
        stack = [(np.inf, 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.level:
                continue
            held = self.docs.get(node)
            if held is not None:
                best.add(self.scores(held, worth), self.ids[held])
                continue
            lo, hi = self.first[node], self.last[node]
            looked += hi - lo
            bounds = self.bounds(lo, hi, worth)
            good = np.flatnonzero((bounds >= best.level) & (bounds > 0))
            for at in good[np.argsort(bounds[good], kind="stable")]:
                stack.append((bounds[at], int(lo + at)))
        return looked


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges start:end, one after the other, and their lengths."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum()), lengths


class Best:
    """The k best (score, id) so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.level = 0  # lower scores cannot enter any more

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.level) & (scores > 0)
        scores = np.concatenate([self.scores, scores[good]])
        ids = np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(self.scores) == self.k:
            self.level = self.scores[-1]


# ---- the search ---------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, entries = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            held.append(part)
            rows += part.num_rows
            entries += len(part["terms"].flatten())
            if rows >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                yield pa.Table.from_batches(held)
                held, rows, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def tree_of(block: pa.Table, number: np.ndarray, documents: int, terms: int) -> Tree | None:
    """The tree of the documents that hold a term; `number` renames terms by falling frequency."""
    block = block.combine_chunks()
    lists, tfs = block["terms"].combine_chunks(), block["tfs"].combine_chunks()
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    term = number[np.asarray(lists.flatten(), dtype=np.int64)]
    order = np.lexsort((term, owner))
    tf = np.asarray(tfs.flatten(), dtype=np.int64)[order]
    some = sizes > 0
    if not some.any():
        return None
    n = np.asarray(block["n"], dtype=np.int64)[some]
    m = 100 - 75 + (75 * n * documents) // terms
    ids = np.asarray(block["doc_id"].fill_null(_LAST_ID), dtype=np.int64)[some]
    ptr = np.concatenate([[0], np.cumsum(sizes[some])])
    return Tree(ids, m, ptr, term[order], tf)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def rank(docs: DataFrame, items: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents.

    `docs`: doc_id, text; `items`: item_id, text.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = materialize(item_terms(items))
    size = asked.agg(
        F.sum(F.octet_length("term") + 64).alias("bytes"), F.count_distinct("item_id").alias("items")
    ).first()
    # A slice needs an item, so no more slices than items.
    slices = max(1, min(size["items"], math.ceil((size["bytes"] or 0) / slice_bytes)))
    found = None
    for at in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == at).toArrow()
        if part.num_rows:
            some = _ranked_slice(docs, part.combine_chunks(), kind, k)
            found = some if found is None else found.unionByName(some)
    if found is None:
        none = f"item_id {kind}, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], none)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _ranked_slice(docs: DataFrame, asked: pa.Table, kind: str, k: int) -> DataFrame:
    """Up to k rows an item and task, of all documents."""
    encoded = asked["term"].combine_chunks().dictionary_encode()
    vocabulary = encoded.dictionary.to_pylist()
    vectors = materialize(restricted(spread(docs), vocabulary))
    total = vectors.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")
    ).first()
    documents, terms = total["documents"], max(total["terms"] or 0, 1)
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    holding = np.zeros(len(vocabulary), np.int64)
    holding[np.asarray(counts["term"], dtype=np.int64)] = np.asarray(counts["count"])
    number = np.empty(len(vocabulary), np.int64)
    number[np.lexsort((np.arange(len(vocabulary)), -holding))] = np.arange(len(vocabulary))
    weights = np.array([weight(documents, int(h)) for h in holding], np.int64)
    ids = asked["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    item, term = np.asarray(ids.indices), np.asarray(encoded.indices)
    worth = weights[term] * np.asarray(asked["times"], dtype=np.int64)
    order = np.argsort(item, kind="stable")
    starts = np.searchsorted(item[order], np.arange(len(ids.dictionary) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(
        (number, starts, number[term[order]], worth[order], ids.dictionary)
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, starts, term, worth, names = shared.value
        best = [Best(k) for _ in range(len(names))]
        looked_up = np.zeros(len(number), np.int64)
        for block in _blocks(batches):
            tree = tree_of(block, number, documents, terms)
            if tree is None:
                continue
            for at, held in enumerate(best):
                mine = slice(starts[at], starts[at + 1])
                looked_up[term[mine]] = worth[mine]
                tree.search(looked_up, held)
                looked_up[term[mine]] = 0
        row = np.repeat(np.arange(len(names)), [len(b.ids) for b in best])
        doc = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(row)),
                pa.array(doc, mask=doc == _LAST_ID),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            ["item_id", "doc_id", "score"],
        )

    return vectors.mapInArrow(search, f"item_id {kind}, doc_id long, score long")
