"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

Strings that are equal choose the same anchor: the leftmost least hash among their ``GRAM``-byte grams. All strings that share an anchor
occurrence lie in one span of at most ``2 * length - GRAM`` bytes, so equal strings meet under their anchor's hash. Where an anchor
has one span only, its copies are repeated as a whole. The different spans of an anchor are put into shard arrays of bounded size;
each shard's suffix array is built by induced sorting, and its permuted common prefixes tell which strings start twice. Anchors with
more than ``SPANS`` different spans get no suffix array: every string of each such span is sent as a 64-bit hash, and equal ones meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.textvec import QuickSpans, Spans, mix, slices, utf8
from breakwater.operators.skew import broadcast_small, spread_join
from breakwater.plans.lineage import cut

LENGTH = 400
GRAM = 64
#: Bytes of spans in a shard array, and most different spans of an anchor that goes into one.
SHARD = 1 << 20
SPANS = 8192
#: Bytes of text whose anchors are chosen at once; a longer text is taken in pieces that overlap.
PIECE = 1 << 20


# ---- suffix arrays -------------------------------------------------------------------------------------------------------


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one (the empty one at the end counts as smaller), and the leftmost such ones."""
    n = len(text)
    small = np.zeros(n + 1, bool)
    small[n] = True
    if n:
        change = np.flatnonzero(text[:-1] != text[1:])
        less = text[change] < text[change + 1]
        # A run of equal letters takes after its last letter; the text's last run is greater than the end.
        ends = np.concatenate([change, [n - 1]])
        small[:n] = np.repeat(np.concatenate([less, [False]]), np.diff(ends, prepend=-1))
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, leftmost


def induce(text: np.ndarray, small: np.ndarray, size: int, leftmost: np.ndarray) -> np.ndarray:
    """The suffixes' order induced from that of the leftmost smaller ones: greater ones upward from bucket heads, then smaller ones
    downward from bucket ends. What a bucket holds is handled at once; what it puts into itself follows in further rounds."""
    n = len(text)
    order = np.empty(n, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
    greater = np.bincount(text[~small[:n]], minlength=size)
    letters = text.astype(np.uint16) if size <= 1 << 16 else text
    by = np.argsort(letters[leftmost], kind="stable")
    own = leftmost[by]
    cuts = np.searchsorted(text[own], np.arange(size + 1))

    def put(places: np.ndarray, free: np.ndarray, step: int) -> None:
        before = places - 1
        before = before[before >= 0]
        before = before[small[before] == (step < 0)]
        if not len(before):
            return
        by = np.argsort(letters[before], kind="stable")
        before = before[by]
        letter = text[before]
        edges = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
        many = np.diff(np.concatenate([edges, [len(letter)]]))
        rank = np.arange(len(letter)) - np.repeat(edges, many)
        order[free[letter] + rank if step > 0 else free[letter] - 1 - rank] = before
        free[letter[edges]] += step * many

    full = np.flatnonzero(np.diff(bounds))
    free = bounds[:-1].copy()
    put(np.array([n]), free, 1)
    for c in full.tolist():
        done = bounds[c]
        while done < free[c]:
            first, done = done, free[c]
            put(order[first:done], free, 1)
        put(own[cuts[c] : cuts[c + 1]], free, 1)
    free = bounds[1:].copy()
    for c in full[::-1].tolist():
        done = bounds[c + 1]
        while done > free[c]:
            last, done = done, free[c]
            put(order[done:last][::-1], free, -1)
        put(order[bounds[c] : bounds[c] + greater[c]][::-1], free, -1)
    return order


def _ranks_by_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text of many letters: pairs of ranks are sorted, only where ranks are still shared."""
    n = len(text)
    by = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], text[by][1:] != text[by][:-1]])
    rank[by] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1
    while step < n:
        starts = np.flatnonzero(head)
        many = np.diff(np.concatenate([starts, [n]]))
        open_ = np.repeat(many > 1, many)
        if not open_.any():
            break
        places = np.flatnonzero(open_)
        who = by[places]
        second = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + second
        inner = np.argsort(key, kind="stable")
        by[places], key = who[inner], key[inner]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[places] = fresh
        rank[by] = np.flatnonzero(head)[np.cumsum(head) - 1]
        step *= 2
    return by


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """The order of a text's suffixes by induced sorting; letters are 0..size-1, and a suffix is less than one it is the head of.

    Leftmost smaller substrings are sorted by a first induction, named, and sorted as a shorter text: by the same method while
    its letters are few, by doubling where so many are different that buckets would be single places.
    """
    n = len(text)
    if n < 64 or size > max(4096, n // 64):
        return _ranks_by_doubling(text)
    small, leftmost = classify(text)
    leftmost = leftmost[leftmost < n]
    if len(leftmost) > 1:
        order = induce(text, small, size, leftmost)
        place = np.full(n + 1, -1, np.int64)
        place[leftmost] = np.arange(len(leftmost))
        ranked = place[order]
        ranked = ranked[ranked >= 0]
        # Substrings up to and with the next leftmost place share a name if they are equal; the last one has its own.
        ends = np.concatenate([leftmost[1:] + 1, [n]])
        key = Spans(text)(leftmost, ends)[ranked]
        last = ranked == len(leftmost) - 1
        differ = (key[1:] != key[:-1]) | last[1:] | last[:-1]
        names = np.concatenate([[0], np.cumsum(differ)])
        if names[-1] + 1 < len(leftmost):
            short = np.empty(len(leftmost), np.int64)
            short[ranked] = names
            ranked = suffix_array(short, int(names[-1]) + 1)
        leftmost = leftmost[ranked]
    return induce(text, small, size, leftmost)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int | None = None, fresh: np.ndarray | None = None) -> np.ndarray:
    """For each place, how much its suffix has in common with the one before it in order.

    Only places whose letters before differ from those before their predecessor's are compared; elsewhere the value falls by one.
    With ``most`` no comparison goes further than that, and the places ``fresh`` are compared anyway: values up to ``most`` less
    the distance from the last compared place are then right. Comparisons are by quick hashes, so a value may be too large.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    own = (before <= 0) | (at == 0)
    own |= text[at - 1] != text[np.maximum(before - 1, 0)]
    if fresh is not None:
        own[fresh] = True
    own = np.flatnonzero(own)
    other = before[own]
    low, high = np.zeros(len(own), np.int64), np.where(other >= 0, n - np.maximum(own, other), 0)
    if most is not None:
        high = np.minimum(high, most)
    span = QuickSpans(text)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        i, j = own[open_], other[open_]
        same = span(i, i + middle) == span(j, j + middle)
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)
    which = np.searchsorted(own, at, "right") - 1
    return np.maximum(low[which] - (at - own[which]), 0)


def repeated_starts(spans: list[bytes], length: int) -> list[np.ndarray]:
    """For each span, which of its strings of ``length`` bytes start elsewhere too, in this span or another."""
    letters, begins, at = [], [], 0
    for x in spans:
        begins.append(at)
        letters += [np.frombuffer(x, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
        at += len(x) + 1
    text = np.concatenate(letters)
    order = suffix_array(text, 257)
    # A span has at most 2 * length bytes, so within it places up to there are right.
    common = permuted_prefixes(text, order, 2 * length + max(map(len, spans)), np.array(begins))
    second = np.flatnonzero(common[order[1:]] >= length) + 1
    span, one, other = Spans(text), order[second], order[second - 1]
    same = span(one, one + length) == span(other, other + length)  # what quick hashes found is confirmed
    twice = np.zeros(len(text), bool)
    twice[one[same]] = twice[other[same]] = True
    return [twice[b : b + max(0, len(x) - length + 1)] for b, x in zip(begins, spans, strict=True)]


# ---- anchors -------------------------------------------------------------------------------------------------------------


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(row, first start, last start, anchor's hash, span's hash) of each run of strings that choose the same anchor."""
    width = length - gram + 1
    n = len(raw)
    counts = np.maximum(np.diff(at) - length + 1, 0)
    if not counts.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), counts)
    start = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts - at[:-1]).astype(np.int32), counts)
    hashes = QuickSpans(raw).grams(gram)
    place = np.arange(len(hashes), dtype=np.int32)
    bits = np.uint64(int(n).bit_length())
    padded = np.full(-(-len(place) // width) * width, ~np.uint64(0), np.uint64)
    padded[: len(place)] = ((hashes >> bits) << bits) | place.astype(np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    best = np.minimum(ahead[start], behind[start + np.int32(width - 1)])
    del ahead, behind, blocks, padded, place
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [len(row)]]) - 1
    a, b = start[first].astype(np.int64), start[last].astype(np.int64)
    anchor = (best[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    whole = mix(Spans(raw)(a, b + length) + (anchor - a).astype(np.uint64))
    row = row[first].astype(np.int64)
    return row, a - at[row], b - at[row], hashes[anchor], whole


def pieces(batches, length: int, most: int = PIECE):
    """(batch, bytes, row offsets, first byte) of pieces of about ``most`` bytes: whole rows, or parts of one long row.

    Parts overlap by ``length - 1`` bytes, so that every string of ``length`` bytes starts in exactly one of them.
    """
    for batch in slices(batches, "text", most):
        raw, at = utf8(batch.column("text"))
        if batch.num_rows > 1 or len(raw) <= 2 * most:
            yield batch, raw, at, 0
            continue
        for first in range(0, len(raw), most):
            part = raw[first : first + most + length - 1]
            yield batch, part, np.array([0, len(part)]), first


def _runs(flags: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2).astype(np.int32)


def different_spans(met: DataFrame, most: int) -> DataFrame:
    """A row per different span of the anchors that have several: its count, one place of it, and whether its anchor has more than ``most``.

    Anchors of that many spans are few, so they are counted, listed and broadcast; a join by anchor would bring all spans of one to a task.
    """
    spans = cut(met.where("mixed").groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "at", "more")).alias("of")))
    crowded = cut(spans.groupBy("anchor").agg(F.count("*").alias("spans")).where(F.col("spans") > most).select("anchor", F.lit(True).alias("yes")))
    return spans.join(broadcast_small(crowded), "anchor", "left").select("anchor", "span", "n", F.col("yes").isNotNull().alias("crowded"), "of.*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False, shard: int = SHARD, most_spans: int = SPANS) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else, in the same row or another.

    Returns a row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and with ``keep_text`` also ``kept`` (bytes).
    Strings never cross rows and are judged on the input, overlaps included. Null texts are empty. Repeated rows are copies of each
    other, so their strings all repeat. Only the id and the text are read. ``shard`` (bytes) and ``most_spans`` bound what one array
    holds and change no result.
    """
    gram = min(GRAM, length)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))

    def find(batches):
        for batch, raw, at, offset in pieces(batches, length):
            row, a, b, anchor, whole = anchors(raw, at, length, gram)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), pa.array(a + offset), pa.array((b - a).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["id", "key", "at", "more", "anchor", "span"])
        pa.default_memory_pool().release_unused()  # workers are used again by the next stage

    found = cut(texts.where(F.octet_length("text") >= length).mapInArrow(find, "id long, key long, at long, more int, anchor long, span long"))
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).where("n > 1")
    met = cut(spread_join(found, cut(shared.select("anchor", "n", (F.col("low") != F.col("high")).alias("mixed"))), ["anchor"], "n"))
    spans = different_spans(met, most_spans)
    total = spans.agg(F.coalesce(F.sum(F.col("more") + length), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))

    wanted = spans.groupBy(F.col("id").alias("wid"), F.col("key").alias("wkey")).agg(F.collect_list(F.struct("anchor", "span", "n", "crowded", "at", "more")).alias("asked"))
    having = texts.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("key") == F.col("wkey"))).select("text", "asked", "id", "key").dropDuplicates(["id", "key"])
    cut_out = having.select(F.col("text").cast("binary").alias("text"), F.explode("asked").alias("x")).select("x.anchor", "x.span", "x.n", "x.crowded", F.expr(f"substring(text, CAST(x.at + 1 AS INT), x.more + {length})").alias("bytes"))
    cut_out = cut(cut_out.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")))

    def order_shard(table: pa.Table) -> pa.Table:
        flags = repeated_starts(table.column("bytes").to_pylist(), length)
        n = table.column("n").to_pylist()
        return pa.table({"anchor": table.column("anchor"), "span": table.column("span"), "runs": pa.array([_runs(np.ones_like(f) if k > 1 else f).tobytes() for f, k in zip(flags, n, strict=True)], pa.binary())})

    runs_kind = "anchor long, span long, runs binary"
    runs = cut_out.where("NOT crowded").select("shard", "anchor", "span", "n", "bytes").groupBy("shard").applyInArrow(order_shard, runs_kind)

    def strings(batches):
        for batch in batches:
            for anchor, span, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = np.frombuffer(raw, np.uint8)
                at = np.arange(len(raw) - length + 1)
                hashes = Spans(raw)(at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), anchor)), pa.array(np.full(len(at), span)), pa.array(np.full(len(at), n)), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["anchor", "span", "n", "off", "string"])

    many = cut_out.where("crowded").select("anchor", "span", "n", "bytes").mapInArrow(strings, "anchor long, span long, n long, off int, string long")
    twice = many.groupBy("anchor", "string").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "string")
    pairs = F.expr("transform(collect_list(off), o -> o)")
    starts = many.join(twice, ["anchor", "string"]).groupBy("anchor", "span").agg(pairs.alias("offs"))

    def to_runs(batches):
        for batch in batches:
            out = []
            for offs in batch.column(2).to_pylist():
                flags = np.zeros(max(offs) + 1, bool)
                flags[offs] = True
                out.append(_runs(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["anchor", "span", "runs"])

    runs = cut(runs.unionByName(starts.mapInArrow(to_runs, runs_kind)).where("octet_length(runs) > 0"))
    every = met.where("NOT mixed").select("id", "key", "at", "more", F.lit(None).cast("binary").alias("runs"))
    some = met.where("mixed").join(runs, ["anchor", "span"]).select("id", "key", "at", "more", "runs")
    covered = every.unionByName(some).groupBy(F.col("id").alias("cid"), F.col("key").alias("ckey")).agg(F.collect_list(F.struct("at", "more", "runs")).alias("covered"))
    joined = texts.join(covered, F.col("id").eqNullSafe(F.col("cid")) & (F.col("key") == F.col("ckey")), "left").select("id", "text", "covered")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def remove(batches):
        for batch in batches:
            rows = []
            for doc, raw, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (raw or "").encode()
                kept, gone, n_spans = raw, 0, 0
                if parts.is_valid:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    at, more, runs = (parts.values.field(k) for k in ("at", "more", "runs"))
                    for a, m, r in zip(at.to_pylist(), more.to_pylist(), runs.to_pylist(), strict=True):
                        for i, j in np.frombuffer(r, np.int32).reshape(-1, 2).tolist() if r is not None else [(0, m + 1)]:
                            edge[a + i] += 1
                            edge[a + j - 1 + length] -= 1
                    mask = np.cumsum(edge[:-1]) > 0
                    gone, n_spans = int(mask.sum()), len(_runs(mask))
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append((doc, len(raw), gone, n_spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
