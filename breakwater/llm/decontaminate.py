"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

An item's shingles are runs of five words (all its words, if it has fewer). A window that reaches the similarity shares a shingle with the
item, so only places within an item's length of such a shingle are fingerprinted: nothing is lost by that, and clean text costs one
lookup a word. Windows as long as an item are fingerprinted there at every place. Two 64-bit fingerprints within ``RADIUS`` have at
least one of four 16-bit blocks within ``RADIUS // 4``, so postings of every block value that near find all of them. What they find is
verified by the exact similarity of weighted shingles (weights are counts: the sum of minima over the sum of maxima).
Where few shingles hold most of an item's weight (repeated words, rows of a table), they decide most bits and equal weights cancel, so that similar
windows can lie far apart. Such an item (``EVEN``) is also compared with every window around its shingles, by sliding counts.
Items are handled in blocks of ``BLOCK`` within one scan of all rows; documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.textvec import combine, distinct, slices, utf8, word_hashes

WIDTH = 5
SIMILAR = 0.8
RADIUS = 19
BLOCK = 256
#: An item is compared directly too if its effective number of shingles, (sum w)² / sum w², is below this share of their number.
EVEN = 0.5
#: Windows that one comparison of sliding counts covers.
WINDOWS = 1 << 16
#: Most bytes of items that one scan searches for.
MOST = 64 << 20


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class Items:
    """A block of benchmark items: shingles, fingerprints and the postings of each block value near theirs."""

    def __init__(self, rows: list[tuple[int, str]], width: int = WIDTH, radius: int = RADIUS):
        self.radius = radius
        raw, at = utf8(pa.array([t or "" for _, t in rows], pa.string()))
        words, first = word_hashes(raw, at)
        self.ids, self.words, self.sizes, self.shingles, prints = [], [], [], [], []
        self.uneven: dict[tuple[int, int], list[int]] = {}
        for k, (item, _) in enumerate(rows):
            own = words[first[k] : first[k + 1]]
            if not len(own):
                continue
            grams = combine(own, min(width, len(own)))
            self.ids.append(item)
            self.words.append(len(own))
            self.sizes.append(min(width, len(own)))
            self.shingles.append(Counter(grams.tolist()))
            prints.append(pack(votes(grams).sum(axis=0, keepdims=True))[0])
            weights = list(self.shingles[-1].values())
            if sum(weights) ** 2 < EVEN * sum(weights) * sum(w * w for w in weights):
                self.uneven.setdefault((self.sizes[-1], len(own)), []).append(len(self.ids) - 1)
        self.prints = np.array(prints, np.uint64)
        self.widths = sorted(set(self.sizes))
        self.gate = {w: distinct(np.array([g for s, c in zip(self.sizes, self.shingles, strict=True) if s == w for g in c], np.uint64)) for w in self.widths}
        near = radius // 4
        masks = np.array([sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(16), n)], np.uint32)
        self.postings = []
        for block in range(4):
            values = ((self.prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint32)
            keys = (values[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange(65537))
            self.postings.append((starts, np.repeat(np.arange(len(values)), len(masks))[order].astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) pairs within the radius."""
        found = []
        for block, (starts, items) in enumerate(self.postings):
            value = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            many = starts[value + 1] - starts[value]
            which = np.repeat(np.arange(len(prints)), many)
            place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + starts[value][which]
            found.append(which.astype(np.uint64) * np.uint64(len(self.prints)) + items[place].astype(np.uint64))
        pairs = distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        which, item = (pairs // np.uint64(max(len(self.prints), 1))).astype(np.int64), (pairs % np.uint64(max(len(self.prints), 1))).astype(np.int64)
        close = np.bitwise_count(prints[which] ^ self.prints[item]) <= self.radius
        return which[close], item[close]


def similarity(window: Counter, item: Counter) -> float:
    least = sum(min(n, item[g]) for g, n in window.items() if g in item)
    return least / (window.total() + item.total() - least)


def best_window(part: np.ndarray, starts: np.ndarray, count: int, item: Counter) -> tuple[int, float]:
    """The most similar, then the first, of the windows of ``count`` shingles at ``starts`` (rising), and its similarity: each shingle of the item
    is counted along the text once, and a window's count is a difference."""
    kinds = np.sort(np.array(list(item), np.uint64))
    weights = np.array([item[int(g)] for g in kinds])
    best = (-1, -1.0)
    for k in range(0, len(starts), WINDOWS):
        own = starts[k : k + WINDOWS]
        text = part[own[0] : own[-1] + count]
        place = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
        hit = np.flatnonzero(kinds[place] == text)
        least = np.zeros(len(own), np.int64)
        order = np.argsort(place[hit], kind="stable")
        edges = np.searchsorted(place[hit][order], np.arange(len(kinds) + 1))
        for d, w in enumerate(weights):
            at = hit[order[edges[d] : edges[d + 1]]]
            if len(at):
                least += np.minimum(np.searchsorted(at, own - own[0] + count) - np.searchsorted(at, own - own[0]), w)
        x = least / (count + weights.sum() - least)
        if x.max() > best[1]:
            best = (int(own[x.argmax()]), float(x.max()))
    return best


def leaks(words: np.ndarray, first: np.ndarray, items: Items, similar: float = SIMILAR):
    """(row, item's number, first word, words, similarity) of the most similar, then the first, window of each row for each item."""
    for width in items.widths:
        grams = combine(words, width)
        gate = items.gate[width]
        place = np.minimum(np.searchsorted(gate, grams), len(gate) - 1)
        hits = np.flatnonzero(gate[place] == grams)
        rows = np.searchsorted(first, hits, "right") - 1
        inside = hits + width <= first[rows + 1]
        hits, rows = hits[inside], rows[inside]
        lengths = sorted({n for n, s in zip(items.words, items.sizes, strict=True) if s == width})
        for row in np.unique(rows):
            low, high = int(first[row]), int(first[row + 1])
            own = hits[rows == row] if len(rows) < 1000 else hits[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")]
            best: dict[int, tuple] = {}
            # Runs of hits that no window can join are looked at one by one.
            for run in np.split(own, np.flatnonzero(np.diff(own) > 2 * lengths[-1]) + 1):
                begin, end = max(low, int(run[0]) - lengths[-1]), min(high, int(run[-1]) + lengths[-1] + width)
                part = grams[begin : end - width + 1]
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes(part), axis=0)])
                for length in lengths:
                    size = min(length, high - low)  # a text shorter than the item is a window itself
                    count = size - width + 1
                    if size > end - begin or count < 1:
                        continue
                    starts = np.zeros(len(part) + 1, np.int64)
                    np.add.at(starts, np.maximum(run - begin - count + 1, 0), 1)
                    np.add.at(starts, np.minimum(run - begin + 1, len(part)), -1)
                    starts = np.flatnonzero(np.cumsum(starts)[: len(part) - count + 1] > 0)
                    if not len(starts):
                        continue
                    which, item = items.near(pack(sums[starts + count] - sums[starts]))
                    for w, k in zip(which.tolist(), item.tolist(), strict=True):
                        if items.words[k] != length or items.sizes[k] != width:
                            continue
                        s = int(starts[w])
                        x = similarity(Counter(part[s : s + count].tolist()), items.shingles[k])
                        if x >= similar and (k not in best or (-x, begin + s) < (-best[k][4], best[k][2])):
                            best[k] = (int(row), k, begin + s, size, x)
                    for k in items.uneven.get((width, length), ()):
                        s, x = best_window(part, starts, count, items.shingles[k])
                        if x >= similar and (k not in best or (-x, begin + s) < (-best[k][4], best[k][2])):
                            best[k] = (int(row), k, begin + s, size, x)
            yield from ((r, k, at - low, n, x) for r, k, at, n, x in best.values())


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[int, str]]:
    """The benchmark's different items in order, as the driver hands them to every task.

    A benchmark is small next to what is searched (this one fits a task's memory, ``MOST`` bytes of text at most); a larger one is
    refused, to be given in parts by the caller, each of which costs a scan.
    """
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    if (size := rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) > MOST:
        raise ValueError(f"{size} bytes of benchmark items; at most {MOST} go into one scan")
    return sorted(((r.item, r.text) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _search(rows: list[tuple[int, str]], similar: float):
    """The leaks of a batch's texts over all items: blocks of items are made once a task, texts are hashed once a batch."""
    blocks = [Items(rows[k : k + BLOCK]) for k in range(0, len(rows), BLOCK)]

    def search(text: pa.Array):
        words, first = word_hashes(*utf8(text))
        for items in blocks:
            for r, k, at, n, x in leaks(words, first, items, similar):
                yield r, items.ids[k], at, n, x

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """A row per document and item that it holds: ``doc_id, item_id, at, n_words, similarity``.

    ``at`` (in words) is the first of the most similar windows. Null and empty texts and items hold nothing; an item of fewer than
    five words is found where all its words stand in order. Repeated documents give repeated rows; items that repeat both id and
    text are one item. Only the id and the text of both tables are read.
    """
    kind = "doc_id long, item_id long, at long, n_words long, similarity double"
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text_col)

    def found(batches):
        search = _search(items, similar)
        for batch in slices(batches, "text"):
            rows = [(batch.column(0)[r].as_py(), item, at, n, round(x, 6)) for r, item, at, n, x in search(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(),) * 4 + (pa.float64(),))], names=["doc_id", "item_id", "at", "n_words", "similarity"])

    return texts.mapInArrow(found, kind)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    items = _items(benchmark, item_col, item_text_col)

    def clean(batches):
        search = _search(items, similar)
        for batch in slices(batches, text_col):
            keep = np.ones(batch.num_rows, bool)
            for r, *_ in search(batch.column(text_col)):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
