"""Line dedup with two Bloom filters, for keys seen once and keys seen twice.

A first pass over the lines sends 8-byte hashes to the slice of the once-seen
filter they belong to. Slices grow with the data; a task meets its slices one
after the other and holds the bits of one at a time. A hash that finds its bits
set is a suspected repeat. The twice-seen filter holds these, so its size goes
by the repeats and not by the lines; it is broadcast, a second pass sends only
lines it holds, and those are counted exactly by their text. Where even that
filter is too large to broadcast, hashes with their documents meet the suspects
in a join, and only lines found there go on. No repeat is lost either way.

Rule: a key (stripped, A-Z in lower case) of MIN_CHARS code points or more that
lies in MIN_DOCS documents or more stays only in the document of largest id.

Defined results: a null or empty text is one empty line; rows of one id are
one document for counts and are rewritten each for itself; rows with a null id
are together one document before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.session import materialize

MIN_CHARS = 20
MIN_DOCS = 3
PROBES = 4
BITS_PER_LINE = 12
# Bits of a twice-seen filter that is broadcast at most (128 MB), and of a slice.
MAX_BITS = 1 << 30
SLICE_BITS = 1 << 19
# Tasks that share the slices of the once-seen filter at most; each holds one slice at a time.
MAX_TASKS = 20_000
# Parts into which the lines of one key are dealt when decisions meet them.
SALTS = 32


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def counts(key: bytes) -> bool:
    """Whether a key has MIN_CHARS code points."""
    return len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS)


def keys_of(text: str | None) -> set[bytes]:
    """Distinct keys of a text that the rule is about."""
    return {k for k in map(key_of, (text or "").encode().split(b"\n")) if counts(k)}


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers inside a hash's own slice, PROBES for each hash."""
    low = hashes & np.uint64(0xFFFFFFFF)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(PROBES, dtype=np.uint64)
    return ((low[:, None] + turns * step[:, None]) % np.uint64(bits)).astype(np.int64)


def slices_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(slices)).astype(np.int64)


class TwoFilters:
    """The once-seen and the twice-seen filter of one slice."""

    def __init__(self, bits: int = SLICE_BITS):
        self.once, self.twice = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Notes hashes; returns those that were seen before, or look so."""
        block, many = np.unique(hashes, return_counts=True)
        spots = probes(block, len(self.once))
        again = self.once[spots].all(axis=1) | (many > 1)
        self.twice[spots[again].ravel()] = True
        self.once[spots.ravel()] = True
        return block[again]


def seen_again(docs: DataFrame, slices: int) -> DataFrame:
    """(hash): hashes of lines that the once-seen filter meets again.

    A hash is sent once for each document that has it, at most twice a batch.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hash(k) for text in batch.column(0).to_pylist() for k in keys_of(text)]
            if found:
                hashes, many = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
                # Two copies tell the filters all they need to know.
                hashes = np.repeat(hashes, np.minimum(many, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slices_of(hashes, slices)), pa.array(hashes.view(np.int64))],
                    names=["slice", "hash"],
                )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pair = -1, TwoFilters()
        for batch in batches:
            where = batch.column(0).to_numpy()
            hashes = batch.column(1).to_numpy().view(np.uint64)
            for number in np.unique(where).tolist():
                if number != current:
                    current, pair = number, TwoFilters()
                again = pair.add(hashes[where == number])
                if len(again):
                    yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], names=["hash"])

    sent = docs.select("text").mapInArrow(hashed, "slice long, hash long")
    dealt = sent.repartition(min(slices, MAX_TASKS), "slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(met, "hash long").distinct()


def filter_of(hashes: DataFrame, slices: int) -> bytes:
    """The twice-seen filter: a Bloom filter of all `hashes`, SLICE_BITS / 8 bytes a slice."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = slices_of(batch.column(0).to_numpy().view(np.uint64), slices)
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0)], names=["slice", "hash"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, np.ndarray] = {}
        for batch in batches:
            where = batch.column(0).to_numpy()
            found = batch.column(1).to_numpy().view(np.uint64)
            for number in np.unique(where).tolist():
                bits = filters.setdefault(number, np.zeros(SLICE_BITS, dtype=bool))
                bits[probes(found[where == number], SLICE_BITS).ravel()] = True
        for number, bits in filters.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                names=["slice", "bits"],
            )

    sent = hashes.mapInArrow(named, "slice long, hash long")
    made = sent.repartition(slices, "slice").mapInArrow(built, "slice long, bits binary")
    # At most MAX_BITS / 8 bytes in all.
    out = bytearray(slices * SLICE_BITS // 8)
    for row in made.toLocalIterator():
        start = row["slice"] * SLICE_BITS // 8
        out[start : start + SLICE_BITS // 8] = row["bits"]
    return bytes(out)


def met_suspects(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, key) of all lines whose hash is among `hashes`, without a broadcast."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, _hash(k)) for i, text in enumerate(batch.column(1).to_pylist()) for k in keys_of(text)]
            at = pa.array([i for i, _ in own], pa.int64())
            found = np.array([h for _, h in own], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0).take(at)], names=["hash", "doc_id"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for row in batch.to_pylist():
                held = set(row["held"])
                own = [k for k in keys_of(row["text"]) if np.uint64(_hash(k)).view(np.int64) in held]
                ids += [row["doc_id"]] * len(own)
                keys += [k.decode() for k in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["doc_id", "key"]
            )

    narrow = docs.select("doc_id", "text").mapInArrow(sent, "hash long, doc_id long").distinct()
    held = narrow.join(hashes, "hash", "left_semi").groupBy(F.col("doc_id").alias("_id"))
    held = held.agg(F.collect_set("hash").alias("held"))
    theirs = docs.join(held, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "held")
    return theirs.mapInArrow(kept, "doc_id long, key string")


def suspects(docs: DataFrame, twice: bytes, slices: int) -> DataFrame:
    """(doc_id, key) of all lines whose key the twice-seen filter holds."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = keys_of(text)
                ids += [doc_id] * len(own)
                keys += own
            if not keys:
                continue
            hashes = np.array([_hash(k) for k in keys], dtype=np.uint64)
            spots = probes(hashes, SLICE_BITS) + (slices_of(hashes, slices) * SLICE_BITS)[:, None]
            held = ((packed[spots >> 3] >> (7 - (spots & 7))) & 1).all(axis=1)
            take = np.flatnonzero(held).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in take], pa.int64()),
                    pa.array([keys[i].decode() for i in take], pa.string()),
                ],
                names=["doc_id", "key"],
            )

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, key string")


def repeated(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, _drop): the keys that each document loses, counted exactly."""
    judged = (
        found.groupBy("key")
        .agg(
            (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"),
            F.max("doc_id").alias("last_id"),
        )
        .where(F.col("n") >= min_docs)
    )
    # A key that a third of the documents hold is met in SALTS parts.
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    losing = dealt.join(judged, ["key", "salt"]).where("NOT (doc_id <=> last_id)")
    return losing.groupBy("doc_id").agg(F.collect_set("key").alias("_drop"))


REWRITTEN = "n_dropped long, kept string"


def _rewritten(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = []
    for text, drop in zip(texts, drops):
        if drop is None:
            rows.append((None, None))
            continue
        gone = {k.encode() for k in drop}
        old = text.encode().split(b"\n")
        new = [x for x in old if key_of(x) not in gone]
        rows.append((len(old) - len(new), b"\n".join(new).decode()))
    out = pd.DataFrame(rows, columns=["n_dropped", "kept"])
    return out.astype({"n_dropped": "Int64"})


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of `docs`, with n_lines, n_dropped and the text `kept`.

    Input columns of these names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept", "_drop", "_losing", "_new")
    text = F.coalesce("text", F.lit(""))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    total = docs.agg(F.sum(n_lines)).first()[0] or 0
    slices = max(1, -(-BITS_PER_LINE * total // SLICE_BITS))
    again = materialize(seen_again(docs, slices))
    bits = BITS_PER_LINE * again.count()
    slices = max(1, -(-bits // SLICE_BITS))
    if bits <= MAX_BITS:
        found = suspects(docs, filter_of(again, slices), slices)
    else:
        found = met_suspects(docs, again)
    found = materialize(found)
    drops = repeated(found, min_docs).withColumnRenamed("doc_id", "_losing")
    rows = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_losing")), "left")
    new = F.pandas_udf(_rewritten, REWRITTEN)(F.when(F.col("_drop").isNotNull(), text), "_drop")
    return (
        rows.withColumn("_new", new)
        .withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_dropped", F.coalesce("_new.n_dropped", F.lit(0)).cast("long"))
        .withColumn("kept", F.coalesce("_new.kept", text))
        .drop("_new", "_drop", "_losing")
    )
