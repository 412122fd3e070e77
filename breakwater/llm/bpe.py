"""Byte-level BPE: ranked merges folded over the distinct words of a run of documents by Spark's higher-order functions.

Documents are split into pre-tokens in the JVM and dictionary-encoded in runs, so each run carries its distinct words once.
One expression folds the merges over every distinct word's byte array, looking pairs up in a literal rank map (a two-choice hash
table in literal arrays: Spark scans a literal map from end to end), and concatenates the pieces' bytes back. Nothing is shuffled.
Words over ``LONG`` bytes are merged with a heap instead, since the fold takes quadratic time in a word's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.functions.hof import let
from breakwater.llm.pretokens import in_parts, read_ranks, with_pretokens, word_runs
from breakwater.llm.textvec import utf8
from breakwater.plans.lineage import cut

LONG = 400
#: Pre-tokens of a run: more make fewer distinct words to merge in all, fewer take less memory.
RUN = 1_500_000


def _slots(piece: bytes, bits: int) -> tuple[int, int]:
    x = zlib.crc32(piece)
    return x & ((1 << bits) - 1), x >> (32 - bits)


def cuckoo(ranks: dict[bytes, int]) -> tuple[list[bytes | None], int]:
    """Each piece in one of its two slots, and the bits of a slot's number: the fewest with which all find a place."""
    for bits in range(max(1, (len(ranks) * 20 // 9).bit_length()), 33):
        table: list[bytes | None] = [None] * (1 << bits)
        if all(_placed(table, piece, bits) for piece in ranks):
            return table, bits
    raise ValueError("no place for a piece")


def _placed(table: list[bytes | None], piece: bytes | None, bits: int) -> bool:
    at = _slots(piece, bits)[0]
    for _ in range(500):
        table[at], piece = piece, table[at]
        if piece is None:
            return True
        at = sum(_slots(piece, bits)) - at
    return False


def byte_pairs(ranks: dict[bytes, int]) -> list[int | None]:
    """The rank of each pair of bytes; the upper half of a pair's checksum is a number of its own."""
    table: list[int | None] = [None] * (1 << 16)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            table[zlib.crc32(piece) >> 16] = rank
    return table


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _rank(piece: Column, keys: Column, ranks: Column, bits: int) -> Column:
    def find(p: Column, x: Column) -> Column:
        low = x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        high = F.shiftrightunsigned(x, 32 - bits).cast("int")
        return F.when(F.get(keys, low) == p, F.get(ranks, low)).when(F.get(keys, high) == p, F.get(ranks, high))

    return let(piece, "int", lambda p: let(F.crc32(p), "int", lambda x: find(p, x)))


def _encode(word: Column, keys: Column, ranks: Column, two: Column, bits: int) -> Column:
    """The ids of one word: the leftmost pair of the lowest rank is merged again and again.

    The state is where each part starts (and the end) with the rank of each pair of neighbours.
    """
    none = F.lit(None).cast("array<int>")
    empty = F.expr("CAST(array() AS ARRAY<INT>)")

    def rank(piece: Column) -> Column:
        return _rank(piece, keys, ranks, bits)

    def span(starts: Column, first: Column, last: Column) -> Column:
        return F.substring(word, F.get(starts, first), F.get(starts, last) - F.get(starts, first))

    def step(state: Column, _: Column) -> Column:
        starts, pairs = state["starts"], state["pairs"]

        def merged(at: Column) -> Column:
            left, right = (lambda: rank(span(starts, at - 2, at + 1))), (lambda: rank(span(starts, at - 1, at + 2)))
            near = F.transform(pairs, lambda p, i: F.when(i == at - 2, left()).when(i == at, right()).otherwise(p))
            return F.struct(F.array_remove(starts, F.get(starts, at)).alias("starts"), F.filter(near, lambda _, i: i != at - 1).alias("pairs"))

        kind = "struct<starts:array<int>,pairs:array<int>>"
        return let(F.array_min(pairs), kind, lambda least: F.when(least.isNull(), state).otherwise(let(F.array_position(pairs, least).cast("int"), kind, merged)))

    n = F.octet_length(word)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(two, F.shiftright(F.crc32(F.substring(word, i, F.lit(2))), 16).cast("int")))
    start = F.struct(F.sequence(F.lit(1), n + 1).alias("starts"), pairs.alias("pairs"))
    ids = lambda starts: F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda i: rank(span(starts, i - 1, i)))
    fold = let(F.aggregate(F.sequence(F.lit(2), n), start, step)["starts"], "array<int>", ids)
    return F.when(n == 0, empty).otherwise(let(rank(word), "array<int>", lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.when(n > 1, fold).otherwise(none))))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, the leftmost pair of the lowest rank first, by a heap over a linked list."""
    n = len(word)
    ends, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:end])) is not None:
            heapq.heappush(heap, (r, k, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


@contextmanager
def _short_plans(spark: SparkSession):
    """Plans are described without their expressions: the literal tables would be printed, megabytes of text for each event of a query."""
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _packed(column: pa.Array) -> bytes:
    out, schema = pa.BufferOutputStream(), pa.schema([("x", column.type)])
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([column], schema=schema))
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Array:
    return pa.ipc.open_stream(packed).read_all().column("x").combine_chunks()


class Head:
    """Words that are seen again and again, with their ids and bytes, encoded once beforehand: a cache of at most ``most`` words.

    Which words it holds changes no result, so they come from a bounded sample of documents (all, while these are fewer): words of at
    most 64 bytes, seen ``least`` times or more, which is the smallest number (2 or more) that not too many words reach.
    """

    def __init__(self, table: pa.Table):
        self.columns = {k: _packed(table.column(k).combine_chunks()) for k in ("word", "ids", "bytes")}

    def reader(self, name: str):
        """A function that unpacks one column, so that a task is sent no other one."""
        packed = self.columns[name]
        return lambda: _unpacked(packed)

    @staticmethod
    def of(docs: DataFrame, split, coded, size: int, most: int) -> "Head":
        def count(batches):
            for _, _, words in word_runs(batches, RUN):
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["word", "n"])
            pa.default_memory_pool().release_unused()

        share = size / max(docs.count(), 1)
        seen = split(docs if share >= 1 else docs.sample(share, seed=7)).mapInArrow(count, "word binary, n long")
        seen = cut(seen.where("octet_length(word) <= 64").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
        levels = sorted(seen.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("words")).collect(), reverse=True)
        least, words = 1001, 0
        for level in levels:
            words += level.words
            if words > most:
                break
            least = level.n
        asked = seen.where(F.col("n") >= least).repartition(48).select(F.array("word").alias("words"))
        return Head(asked.select(F.col("words")[0].alias("word"), coded("words")[0].alias("coded")).select("word", F.col("coded.ids").cast("binary").alias("ids"), "coded.bytes").toArrow())


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, sample_docs: int = 1 << 16, most_words: int = 1 << 19) -> DataFrame:
    """Encode each whole text by the rank file at ``path`` and decode the ids again.

    Returns a row per input row: ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``;
    with ``keep`` also ``ids`` (an array) and ``decoded`` (bytes). A null or empty text has no ids. Repeated rows give equal rows.
    The rows are written to the shared folder, so that the caller's plan holds no literal tables.
    Only the id and the text are read, so other columns may have any name.
    """
    table = read_ranks(path)
    if missing := [x for x in range(256) if bytes([x]) not in table]:
        raise ValueError(f"{path} lacks single bytes {missing[:5]}")
    slots, bits = cuckoo(table)
    two = _literal(byte_pairs(table), "int")
    keys = _literal([x if x is None else base64.b64encode(x).decode() for x in slots], "binary")
    ranks = _literal([table.get(x) for x in slots], "int")
    names = dict((r, p) for p, r in table.items())
    pieces = _literal([base64.b64encode(names.get(r, b"")).decode() for r in range(max(names) + 1)], "binary")
    run = pa.schema([("ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("codes", pa.binary()), ("words", pa.list_(pa.binary())), ("long_ids", pa.list_(pa.string()))])

    tables = F.array(F.struct(keys.alias("keys"), ranks.alias("ranks"), pieces.alias("pieces"), two.alias("two")))

    def word(t: Column):
        def of(w: Column) -> Column:
            ids = _encode(w, t["keys"], t["ranks"], t["two"], bits)
            return let(ids, "struct<ids:string,bytes:binary>", lambda x: F.struct(F.array_join(x.cast("array<string>"), ",").alias("ids"), F.aggregate(x, F.lit(b""), lambda a, i: F.concat(a, F.get(t["pieces"], i))).alias("bytes")))

        return of

    def coded(words: str) -> Column:
        return F.get(F.transform(tables, lambda t: F.transform(words, word(t))), F.lit(0)).alias("coded")

    split = lambda x: in_parts(with_pretokens(x, id_col, text_col, pattern))
    with _short_plans(docs.sparkSession):
        head = Head.of(docs, split, coded, sample_docs, most_words)

    head_words, head_texts, head_bytes = (head.reader(k) for k in ("word", "ids", "bytes"))

    def encode_runs(batches):
        often = head_words()
        for ids, at, words in word_runs(batches, RUN):
            coded = words.dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary())
            known = pc.index_in(distinct, value_set=often).fill_null(-1).to_numpy()
            rest = np.flatnonzero(known < 0)
            sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
            longs = rest[sizes[rest] > LONG]
            found = [",".join(map(str, heap_merge(distinct[int(k)].as_py(), table))) for k in longs]
            asked = distinct.take(pa.array(rest[sizes[rest] <= LONG]))
            place = known.astype(np.int32)  # of a word: in the head, or below zero its number among those asked for, then the long ones
            place[np.concatenate([rest[sizes[rest] <= LONG], longs])] = -1 - np.arange(len(rest), dtype=np.int32)
            codes = (place[np.asarray(coded.indices)] if len(words) else place).tobytes()
            del words, coded, distinct, known, place
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], run.field(0).type), pa.array([np.diff(at).astype(np.int32).tobytes()]), pa.array([codes]), pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), asked), pa.array([found], run.field(4).type)],
                schema=run,
            )
        pa.default_memory_pool().release_unused()  # workers are used again by the next stage

    # Written, so that splitting texts and folding words do not hold their memory at the same time.
    runs = cut(split(docs).mapInArrow(encode_runs, "ids array<long>, counts binary, codes binary, words array<binary>, long_ids array<string>"))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] * keep])

    comma = pa.scalar(b",")

    def listed(ids: pa.Array) -> pa.Array:
        """Each word's ids with a comma after them, so that a text's ids are one stretch of bytes but for the last comma."""
        return pc.binary_join_element_wise(ids.cast(pa.binary()), b"", comma)

    def digest(batches):
        head_ids, often_bytes = listed(head_texts()), head_bytes()
        for batch in batches:
            for ids, counts, codes, long_ids, coded in zip(*(batch.column(k) for k in range(5)), strict=True):
                long_ids = long_ids.values
                long_bytes = [b"".join(names[int(i)] for i in x.split(",")) for x in long_ids.to_pylist()]
                # Codes from zero on are the head's, those below zero count the run's own words: in this order both are one dictionary.
                codes, counts = np.frombuffer(codes.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int32)
                code = pa.array(np.where(codes >= 0, codes, len(head_ids) - 1 - codes))
                of = pa.concat_arrays([head_ids, listed(coded.values.field("ids")), listed(long_ids)])
                commas = pc.count_substring(of, ",").to_numpy()
                text, text_at = utf8(of.take(code))
                back, back_at = utf8(pa.concat_arrays([often_bytes, coded.values.field("bytes"), pa.array(long_bytes, pa.binary())]).take(code))
                at = np.concatenate([[0], np.cumsum(counts)])
                totals = np.concatenate([[0], np.cumsum(commas[code.to_numpy()])])[at]
                text_at, back_at = text_at[at].tolist(), back_at[at].tolist()
                rows, ids = [], ids.as_py()
                for k, doc in enumerate(ids):
                    own, raw = text[text_at[k] : max(text_at[k], text_at[k + 1] - 1)], back[back_at[k] : back_at[k + 1]]
                    rows.append((doc, int(totals[k + 1] - totals[k]), hashlib.sha256(own).hexdigest(), hashlib.sha256(raw).hexdigest(), *([[int(x) for x in own.tobytes().split(b",") if x], raw.tobytes()] if keep else [])))
                    if len(rows) == 2000 or k == len(ids) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        pa.default_memory_pool().release_unused()

    with _short_plans(docs.sparkSession):
        return cut(runs.select("ids", "counts", "codes", "long_ids", coded("words")).mapInArrow(digest, kind))
