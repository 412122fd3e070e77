"""Pre-tokens: the pieces of text within which byte-level tokenisers work, split by a public pattern inside the JVM."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def pretokens(text: Column, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Every match of ``pattern``, in order; white space has its Unicode meaning. A null text has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"(?U)({pattern})"), F.lit(0))


def with_pretokens(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), pretokens(F.col(f"`{text_col}`"), pattern).alias("words"))


def word_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Ids, word offsets and words of runs of rows with about ``most`` words, or of a single row."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        at = np.asarray(lists.offsets).astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield ids.slice(first, last - first), at[first : last + 1] - at[first], lists.values.slice(at[first], at[last] - at[first])
            first = last
        del batch, lists, at  # before the next batch is read


def in_parts(words: DataFrame, least: int = 64, most_parts: int = 16) -> DataFrame:
    """``id, part, words``: each row's words in parts of ``least`` or more, so that an Arrow batch holds a bounded number of usual words."""
    n = F.size("words")
    step = F.greatest(F.lit(least), F.ceil(n / most_parts)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda i: F.slice("words", i + 1, step))
    return words.select("id", F.posexplode(parts).alias("part", "words"))


def word_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, pa.Array]]:
    """Ids, word offsets and words of runs of whole rows, given in parts, with about ``most`` words, or of a single row."""
    ids, begins, held, count = [], [], [], 0
    for batch in batches:
        starts = np.flatnonzero(batch.column(1).to_numpy() == 0)
        at = np.asarray(batch.column(2).offsets).astype(np.int64)
        first = 0
        while first < batch.num_rows:
            ahead = starts[np.searchsorted(starts, first) :]
            k = int(np.searchsorted(at[ahead] - at[first] + count, most))
            last = int(ahead[k]) if k < len(ahead) else batch.num_rows
            own = ahead[: int(np.searchsorted(ahead, last))]
            ids += batch.column(0).take(pa.array(own)).to_pylist()
            begins.append(at[own] - at[first] + count)
            held.append(batch.column(2).values.slice(at[first], at[last] - at[first]))
            count += int(at[last] - at[first])
            first = last
            if last < batch.num_rows:
                yield ids, np.append(np.concatenate(begins), count), pa.concat_arrays(held)
                ids, begins, held, count = [], [], [], 0
    if ids:
        yield ids, np.append(np.concatenate(begins), count), pa.concat_arrays(held)
