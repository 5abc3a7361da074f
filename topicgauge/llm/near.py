"""Near-duplicate documents by HyperMinHash, with exact confirmation.

A document's set holds its distinct runs of `width` words. One 64-bit hash of
each run falls into one of REGISTERS registers by its high bits; a register
keeps the leading-zero count and MANTISSA bits of its smallest hash. Registers
without a hash borrow a full one by a fixed rule, and bands of ROWS registers
are the search keys. With a resemblance of 0.8, a pair shares no band with a
probability of (1 - 0.8^5)^51, about 2e-9.

Documents of equal sets are one node. In each bucket of nodes that share a
band, nodes are compared with a head of the bucket; nodes that turn out to be
connected need no further comparison, so a group of near copies costs a few
pairs a node. Only buckets whose nodes are still in different components are
looked at again: the nodes of small ones in pairs (at most SMALL / 2 for each
node), those of large ones in blocks of bounded size, of which a task takes
two, counts the shared runs of all their nodes at once and returns no more
links than join components. Pairs pass a collision-corrected estimate from the
registers (six standard errors wide), and links are confirmed on full sets.

Defined results: texts without words are linked with nothing; a text with
fewer words than a run is one run; rows that share an id are one document with
all their texts; rows without an id are their own component (null) and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.session import materialize

WIDTH = 4
PERCENT = 80
REGISTERS = 256
ROWS = 5
BANDS = REGISTERS // ROWS
MANTISSA = 10
# Nodes of a bucket that is compared in pairs.
SMALL = 16
# Runs of a block, each node counting for LEAST at least, and runs looked up at once.
BLOCK_RUNS = 1 << 18
LEAST = 512
COLUMNS = 4096

_MIX = np.random.Generator(np.random.PCG64(8))
_WORD_FACTORS = _MIX.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _MIX.integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BORROW = [_MIX.permutation(REGISTERS) for _ in range(48)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def exact_set(text: str | None, width: int) -> set[bytes]:
    found = words_of(text)
    if len(found) < width:
        return {b" ".join(found)} if found else set()
    return {b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)}


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of a document's runs, ascending."""
    found = words_of(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    size = min(width, len(found))
    runs = np.zeros(len(found) - size + 1, dtype=np.uint64)
    for i in range(size):
        runs += _scramble(each[i : i + len(runs)] * _WORD_FACTORS[i])
    if size < width:
        # A short text equals no run of a longer one.
        runs += _WORD_FACTORS[-1 - size]
    return np.unique(_scramble(runs))


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of ascending hashes; 0 where a register has none."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(hashes) == 0:
        return out
    place = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rest = (hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(3)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    bits = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out[place[first]] = ((53 - exponent) << MANTISSA) + bits + 1
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled from full ones, alike for alike sets."""
    full = registers > 0
    if full.all() or not full.any():
        return registers
    out = registers.copy()
    missing = np.flatnonzero(~full)
    for turn in _BORROW:
        source = turn[missing]
        ready = full[source]
        out[missing[ready]] = registers[source[ready]]
        missing = missing[~ready]
        if len(missing) == 0:
            return out
    # The next full register to the right, going round.
    places = np.flatnonzero(full)
    out[missing] = registers[places[np.searchsorted(places, missing) % len(places)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of filled registers (rows of a matrix)."""
    bands = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    keys = _scramble((bands + np.uint64(1)) * _BAND_FACTORS[None, :, :]).sum(axis=2, dtype=np.uint64)
    return _scramble(keys).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(resemblance, registers in use) of pairs of register rows, collision-corrected.

    Two different smallest hashes agree by chance with about the probability
    that both lie in one cell of counts and mantissas.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    chance = 1 / (3 * (1 << MANTISSA))
    share = same / np.maximum(used, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), used


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, registers) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, kept = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = run_hashes(text, width)
                sizes.append(len(hashes))
                empty = len(hashes) == 0
                names.append(None if empty else hashlib.md5(hashes.tobytes()).digest())
                kept.append(None if empty else registers_of(hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, set_id binary, registers binary"
    )


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for every band of every node."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = np.array([filled(r) for r in _matrix(batch.column(1))])
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(band_keys(rows).ravel()), pa.array(ids)], names=["bucket", "node"]
            )

    return nodes.select("node", "registers").mapInArrow(keyed, "bucket long, node long")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers do not rule out the resemblance asked for."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            share, used = estimates(_matrix(batch.column(2)), _matrix(batch.column(3)))
            level = percent / 100
            margin = 6 * np.sqrt(level * (1 - level) / np.maximum(used, 1)) + 2 / np.maximum(used, 1)
            take = pa.array(share >= level - margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(take) for i in (0, 1)], names=["a", "b"]
            )

    own = nodes.select("node", "registers")
    both = pairs.join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(judged, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the resemblance."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, last, held = [], None, set()
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if right != last:
                    last, held = right, exact_set(right, width)
                own = exact_set(left, width)
                both = len(own & held)
                take.append(100 * both >= percent * (len(own) + len(held) - both))
            mask = pa.array(take, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"]
            )

    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(judged, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: the smallest node it reaches.

    Large-star and small-star steps alternate until the edges no longer change;
    each round is written, so a lost executor costs one round at most.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        seen = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _rooted(spots: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold nodes of more than one component, with their roots."""
    own = spots.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("bucket").agg(F.min("root").alias("_x"), F.max("root").alias("_y"))
    return own.join(mixed.where("_x <> _y").select("bucket"), "bucket")


def _pair(x: Column | str, y: Column | str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _joining(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the links that connect components which earlier links left apart."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            x = above[x]
        return x

    take = []
    for i, (x, y) in enumerate(zip(roots[a].tolist(), roots[b].tolist())):
        x, y = top(x), top(y)
        if x != y:
            above[x] = y
            take.append(i)
    return take


def shared_runs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    hashes = [np.concatenate([*side, np.empty(0, dtype=np.uint64)]) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    common = np.intersect1d(*hashes)
    places = []
    for values, owner in zip(hashes, owners):
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        met = common[at] == values if len(common) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[met], kind="stable")
        places.append((at[met][order], owner[met][order]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for (at, owner), side in zip(places, (left, right)):
            low, high = np.searchsorted(at, [start, start + COLUMNS])
            part = np.zeros((len(side), COLUMNS), dtype=np.float32)
            part[owner[low:high], at[low:high] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def block_links(rest: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components, from the nodes of large buckets in bounded blocks.

    A node's home is the least root it meets in a bucket; homes are cut into
    blocks by hash. Two blocks are compared if a bucket holds nodes of both.
    """
    low = rest.groupBy("bucket").agg(F.min("root").alias("low"))
    homes = rest.join(low, "bucket").groupBy("node", "root").agg(F.min("low").alias("home"))
    homes = homes.join(sizes, "node")
    load = F.sum(F.greatest("n_shingles", F.lit(LEAST)))
    cuts = homes.groupBy("home").agg(F.ceil(load / BLOCK_RUNS).cast("long").alias("cuts"))
    name = F.struct("home", F.pmod(F.xxhash64("node"), F.col("cuts")).alias("cut"))
    homes = materialize(homes.join(cuts, "home").select("node", "root", name.alias("block")))

    def packed(group: pa.Table) -> pa.Table:
        nodes, roots = (np.array(group[c].to_pylist(), dtype=np.int64) for c in ("node", "root"))
        sets = [run_hashes(x, width) for x in group["text"].to_pylist()]
        held = np.concatenate([[len(nodes)], nodes, roots, [len(x) for x in sets]]).astype(np.int64)
        data = held.tobytes() + b"".join(x.tobytes() for x in sets)
        return pa.table(
            {"block": group["block"][:1], "data": pa.array([data], pa.binary())}
        )

    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
        nodes, roots, many = np.frombuffer(data, dtype=np.int64, count=3 * n, offset=8).reshape(3, n)
        runs = np.frombuffer(data, dtype=np.uint64, offset=8 * (3 * n + 1))
        return nodes, roots, np.split(runs, np.cumsum(many)[:-1])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = unpacked(batch.column(0)[i].as_py()), unpacked(batch.column(1)[i].as_py())
                both = shared_runs(left[2], right[2])
                m, n = (np.array([len(x) for x in side[2]]) for side in (left, right))
                linked = 100 * both >= percent * (m[:, None] + n[None, :] - both)
                a, b = np.nonzero(linked & (left[1][:, None] != right[1][None, :]))
                take = _joining(np.concatenate([left[1], right[1]]), a, b + len(m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left[0][a[take]]), pa.array(right[0][b[take]])], names=["a", "b"]
                )

    blocks = homes.join(texts, "node").select("block", "node", "root", "text")
    blocks = materialize(
        blocks.groupBy("block").applyInArrow(packed, "block struct<home:long,cut:long>, data binary")
    )
    met = rest.join(homes.select("node", "block"), "node").select("bucket", "block").distinct()
    pairs = met.join(met.withColumnRenamed("block", "other"), "bucket").where("block <= other")
    pairs = pairs.select("block", "other").distinct()
    both = pairs.join(blocks, "block").join(
        blocks.select(F.col("block").alias("other"), F.col("data").alias("data2")), "other"
    )
    found = both.select("data", "data2").mapInArrow(compared, "a long, b long")
    return found.select(*_pair("a", "b")).distinct()


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`."""
    rows = materialize(signed(docs, width))
    known = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    placed = rows.join(classes, "set_id", "left")
    placed = materialize(
        placed.select(
            "doc_id",
            "n_shingles",
            F.coalesce("node", "doc_id").alias("node"),
            F.when(F.col("doc_id") == F.col("node"), F.col("registers")).alias("registers"),
        )
    )
    nodes = placed.where("registers IS NOT NULL").select("node", "registers", "n_shingles")
    keyed = bands(nodes)
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("_last"))
    spots = materialize(
        keyed.join(shared.where("head <> _last").select("bucket", "head"), "bucket")
    )
    texts = materialize(
        docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(
            spots.select("node").distinct(), "node", "left_semi"
        )
    )
    # Rows of one id hold all their sets together.
    twins = (
        placed.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("node").alias("_x"), F.max("node").alias("_y"))
        .where("_x <> _y")
        .select("doc_id")
    )
    links = placed.join(twins, "doc_id", "left_semi").select(*_pair("doc_id", "node")).where("a <> b")

    def test(pairs: DataFrame) -> DataFrame:
        return confirmed(likely(pairs, nodes, percent), texts, width, percent)

    tested = materialize(spots.where("node <> head").select(*_pair("node", "head")).distinct())
    links = materialize(links.unionByName(test(tested)))
    rest = materialize(_rooted(spots.select("bucket", "node"), components(links)))
    many = rest.groupBy("bucket").agg((F.count(F.lit(1)) > SMALL).alias("large"))
    rest = rest.join(many, "bucket")
    small, large = (
        rest.where(F.col("large") == x).select("bucket", "node", "root") for x in (False, True)
    )
    pairs = (
        small.join(small.toDF("bucket", "node2", "root2"), "bucket")
        .where("root < root2")
        .select(*_pair("node", "node2"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    sizes = nodes.select("node", "n_shingles")
    found = confirmed(block_links(large, sizes, texts, width, percent), texts, width, percent)
    roots = components(links.unionByName(test(pairs)).unionByName(found))
    out = placed.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
    component = F.coalesce("root", "node")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
