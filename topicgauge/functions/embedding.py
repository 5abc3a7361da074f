"""Text embedding behind one small interface.

`HashedWords` needs no model. `ModelEmbedder` wraps any model
that maps a list of texts to a matrix; it is loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.vectors import as_list_array, once, unit_rows


Encode = Callable[[list[str]], np.ndarray]


class Embedder(Protocol):
    def column(self, text: Column) -> Column:
        """array<float> of unit length for each text."""

    def kernel(self) -> Callable[[], Encode]:
        """What a task calls once for its texts → (rows x dim) function; optional, for `tried_column`."""


@dataclass(frozen=True)
class HashedWords:
    """Signed word hashing: a word adds ±1 to one of `dim` slots, scaled to length 1.

    Words are what blanks separate in the lower-cased text, over the whole
    text. A batch is cut into words and dictionary-encoded by Arrow, so only
    its distinct words are hashed and everything else is one bincount.
    """

    dim: int = 64

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def vectors(texts: pa.Array) -> pa.Array:
            flat = word_counts(texts, dim)
            matrix, _ = unit_rows(flat)
            return as_list_array(matrix.astype(np.float32), pa.float32())

        return once(vectors)(text)

    def kernel(self) -> Callable[[], Encode]:
        dim = self.dim
        return lambda: lambda texts: unit_rows(word_counts(pa.array(texts, pa.string()), dim))[0]


def word_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """(rows x dim) signed counts: slot and sign from the first 32 bits of a word's MD5."""
    rows = len(texts)
    if rows == 0:
        return np.zeros((0, dim))
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    row = np.repeat(np.arange(rows), np.asarray(words.value_lengths()))
    coded = words.flatten().dictionary_encode()
    code = np.asarray(coded.indices)
    known = coded.dictionary.to_pylist()
    h = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4]) for w in known], dtype=np.int64)
    sign = np.where((h // dim) % 2 == 0, 1.0, -1.0)
    sign[np.array([w == "" for w in known], dtype=bool)] = 0.0
    flat = np.bincount(row * dim + (h % dim)[code], weights=sign[code], minlength=rows * dim)
    return flat.reshape(rows, dim)


@dataclass(frozen=True)
class ModelEmbedder:
    """`load()` runs once per worker and returns texts → (rows x dim) matrix."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    batch: int = 64

    def column(self, text: Column) -> Column:
        load, size = self.load, self.batch

        @F.arrow_udf("array<float>")
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = load()
            for texts in batches:
                values = ["" if t is None else t for t in texts.to_pylist()]
                rows = [
                    np.asarray(encode(values[i : i + size]), dtype=np.float32)
                    for i in range(0, len(values), size)
                ]
                yield as_list_array(np.vstack(rows), pa.float32()) if rows else pa.array(
                    [], type=pa.list_(pa.float32())
                )

        return once(vectors)(F.coalesce(text, F.lit("")))

    def kernel(self) -> Callable[[], Encode]:
        load, size = self.load, self.batch

        def make() -> Encode:
            encode = load()
            return lambda texts: np.vstack(
                [np.asarray(encode(texts[i : i + size])) for i in range(0, len(texts), size)]
            )

        return make


TRIED = "struct<vector:array<float>,error:string>"


def tried_column(embedder: Embedder, text: Column, dim: int) -> Column:
    """(vector, error) of each text: one of the two is null.

    A batch that fails is halved inside the task until the texts that fail on
    their own are found, so bad texts cost no further jobs.
    """
    make = embedder.kernel()

    @F.arrow_udf(TRIED)
    def tried(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        for texts in batches:
            values = ["" if t is None else t for t in texts.to_pylist()]
            vectors = np.zeros((len(values), dim), dtype=np.float32)
            errors = try_in_halves(encode, values, vectors)
            bad = np.array([e is not None for e in errors], dtype=bool)
            lists = as_list_array(vectors, pa.float32()).take(
                pa.array(np.arange(len(values)), mask=bad)
            )
            yield pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["vector", "error"])

    return once(tried)(text)


def try_in_halves(encode: Encode, texts: list[str], vectors: np.ndarray) -> list[str | None]:
    """Fills `vectors` where texts can be encoded; the error of each text, None if there is none."""
    errors: list[str | None] = [None] * len(texts)
    parts = [(0, len(texts))]
    while parts:
        start, end = parts.pop()
        if start == end:
            continue
        try:
            found = np.asarray(encode(texts[start:end]))
            if found.shape != (end - start, vectors.shape[1]):
                raise ValueError(f"embedding of shape {found.shape} for {end - start} texts of size {vectors.shape[1]}")
            vectors[start:end] = found
        except Exception as failure:
            if end - start == 1:
                errors[start] = str(failure) or type(failure).__name__
                continue
            middle = (start + end) // 2
            parts += [(start, middle), (middle, end)]
    return errors


def try_pairs(entries: DataFrame, embedder: Embedder, dim: int) -> DataFrame:
    """Both vectors of every row, and `error` where one of its texts cannot be embedded."""
    tried = entries.withColumn("_request", tried_column(embedder, F.col("request_text"), dim)).withColumn(
        "_response", tried_column(embedder, F.col("response_text"), dim)
    )
    return (
        tried.withColumn("request_embedding", F.col("_request.vector"))
        .withColumn("response_embedding", F.col("_response.vector"))
        .withColumn("error", F.coalesce("_request.error", "_response.error"))
        .drop("_request", "_response")
    )


def embed_pairs(entries: DataFrame, embedder: Embedder, dim: int) -> DataFrame:
    """Both vectors of every (request_text, response_text) row; pairing is by row.

    A vector of another size than `dim` fails the batch. Entries that bring
    their vectors are left as they are.
    """
    if "request_embedding" in entries.columns:
        return entries
    vectors = entries.withColumn("_request", embedder.column(F.col("request_text"))).withColumn(
        "_response", embedder.column(F.col("response_text"))
    )
    return (
        vectors.withColumn("request_embedding", _sized("_request", dim))
        .withColumn("response_embedding", _sized("_response", dim))
        .drop("_request", "_response")
    )


def _sized(vector: str, dim: int) -> Column:
    wrong = F.raise_error(F.format_string("embedding of size %d instead of " + str(dim), F.size(vector)))
    return F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong)
