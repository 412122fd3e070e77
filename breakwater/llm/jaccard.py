"""N-gram Jaccard join by prefix filters under several global token orders, and the components that its links make.

Documents of equal shingle sets are one node. Under any global token order, two sets of similarity t share a token among the first
n - ceil(t n) + 1 of each. The first order puts tokens that are seldom seen first (a bounded list of frequent ones is
counted over the whole corpus), so that passages many documents share do not meet in it unless almost all of a document is common.
A pair's first common token under the first order leaves each set only the tokens from its place on to share, so a meeting at later
places than a similar pair's first one can have counts for nothing.
Documents that meet at a prefix token are first compared with one of them only, the one in which it stands first; what that links
is one component, and only pairs of different components are compared further, so a group of near copies costs its size and no square of it.
A pair must share prefix tokens under two more orders before its sets are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.textvec import distinct, mix, shingles, slices, utf8, word_hashes
from breakwater.operators.graph import connected_components
from breakwater.operators.skew import spread_join
from breakwater.plans.lineage import cut

#: Most entries of the list of frequent tokens.
FREQUENT = 1 << 19
#: Times that a token (its 32-bit slot) is seen before it counts as frequent.
OFTEN = 6
MASK = 1 << 22
_TOKEN = np.uint64(16)  # tokens are the upper 48 bits of a shingle's hash


def sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each row's distinct shingles, in order. A slice has fewer than 65,536 rows."""
    row, hashes = shingles(*word_hashes(raw, at), width)
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hashes >> _TOKEN))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def set_keys(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number of tokens and the 64-bit hash of its set (0 for an empty one)."""
    n = np.bincount(row, minlength=rows)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + np.uint64(1)))])
    edges = np.concatenate([[0], np.cumsum(n)])
    return n, np.where(n > 0, mix(total[edges[1:]] - total[edges[:-1]] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


class Order:
    """Global token orders: by how often a token is seen (0, or the count's bit length if it is in the list), then by a hash."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        by = np.argsort(slots)
        self.slots, self.classes = slots[by].astype(np.uint32), np.array([int(c).bit_length() for c in counts[by]], np.uint8)

    def classify(self, token: np.ndarray) -> np.ndarray:
        slot = (token >> np.uint64(16)).astype(np.uint32)
        if not len(self.slots):
            return np.zeros(len(token), np.uint8)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return np.where(self.slots[at] == slot, self.classes[at], 0).astype(np.uint8)

    def prefixes(self, row: np.ndarray, token: np.ndarray, n: np.ndarray, classes: np.ndarray, which: int, percent: int) -> np.ndarray:
        """Places of the tokens that are in their rows' prefixes under order ``which``; the third order heeds no counts."""
        first = classes.astype(np.uint64) if which < 3 else np.zeros(len(token), np.uint64)
        key = (row.astype(np.uint64) << np.uint64(48)) | (first << np.uint64(42)) | (mix(token * np.uint64(2 * which + 1) + np.uint64(which)) >> np.uint64(22))
        by = np.argsort(key)
        rank = np.arange(len(by)) - (np.cumsum(n) - n)[row[by]]
        return by[rank < prefix_length(n, percent)[row[by]]]


def _frequent(texts: DataFrame, width: int, tokens: int) -> Order:
    """The slots seen most often. Slices send distinct slots with their counts, by range, as differences that compress well."""
    ranges = 1 << max(6, (tokens >> 21).bit_length())

    def count(batches):
        for batch in slices(batches, "text"):
            _, token = sets(*utf8(batch.column("text")), width)
            slot = np.sort((token >> np.uint64(16)).astype(np.uint32))
            edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])) if len(slot) else np.zeros(1, int)
            slot, n = slot[edges[:-1]], np.diff(edges).astype(np.uint32)
            cuts = np.searchsorted(slot, np.arange(ranges + 1, dtype=np.int64) * (2**32 // ranges))
            blobs = [np.stack([np.diff(slot[i:j], prepend=np.uint32(0)), n[i:j]]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def total(table: pa.Table) -> pa.Table:
        slots, counts = [], []
        for blob in table.column("blob").to_pylist():
            if blob:
                both = np.frombuffer(blob, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1).copy().view(np.uint32)[:, :, 0]
                slots.append(np.cumsum(both[0], dtype=np.uint32))
                counts.append(both[1])
        slot, n = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (slots, counts))
        by = np.argsort(slot, kind="stable")
        slot, n = slot[by], n[by].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        n = np.add.reduceat(n, starts) if len(starts) else n
        often = n >= OFTEN
        return pa.table({"slot": pa.array(slot[starts][often].astype(np.int64)), "n": pa.array(n[often])})

    counted = texts.select("text").mapInArrow(count, "part int, blob binary").groupBy("part").applyInArrow(total, "slot long, n long")
    found = counted.orderBy(F.desc("n"), "slot").limit(FREQUENT).toArrow()
    return Order(found.column("slot").to_numpy(), found.column("n").to_numpy())


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _verify(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` that share prefix tokens under the second and the third order and are similar enough."""
    left = known.select(F.col("key").alias("b"), F.col("tokens").alias("tb"), F.col("second").alias("sb"), F.col("third").alias("ub"))
    right = known.select(F.col("key").alias("a"), F.col("tokens").alias("ta"), F.col("second").alias("sa"), F.col("third").alias("ua"))
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "ta", "tb", "sa", "sb", "ua", "ub")

    def meet(x: bytes, y: bytes, of) -> int:
        both = np.sort(np.concatenate([of(x), of(y)]))
        return int(np.count_nonzero(both[1:] == both[:-1]))

    def check(batches):
        slot = lambda x: np.frombuffer(x, np.uint32)
        for batch in batches:
            keep = []
            for ta, tb, sa, sb, ua, ub in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                ok = meet(sa, sb, slot) and meet(ua, ub, slot)
                if ok:
                    both = meet(ta, tb, _unpack)
                    ok = 100 * both >= percent * ((len(ta) + len(tb)) // 6 - both)
                keep.append(bool(ok))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(check, "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: components of documents linked by a similarity of ``percent`` or more.

    Shingles are of ``width`` words; with fewer words the whole sequence is one; without words a row has none and is linked with
    nothing. ``component_id`` is the smallest id reachable, its own included. Rows that repeat, and rows of equal sets, are one node. A
    null id takes part in links but is never a component's name: such a row's ``component_id`` is null if nothing else is reachable.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def keys(batches):
        for batch in slices(batches, "text"):
            row, token = sets(*utf8(batch.column("text")), width)
            n, key = set_keys(row, token, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key)], names=["doc_id", "n", "key"])

    nodes = cut(texts.mapInArrow(keys, "doc_id long, n long, key long"))
    order = _frequent(texts, width, nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def prefix(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            row, token = sets(*utf8(batch.column("text")), width)
            n, key = set_keys(row, token, batch.num_rows)
            classes = order.classify(token)
            own = order.prefixes(row, token, n, classes, 1, percent)
            edges = np.flatnonzero(np.concatenate([[True], row[own][1:] != row[own][:-1]])) if len(own) else np.zeros(0, int)
            at = np.arange(len(own)) - np.repeat(edges, np.diff(np.append(edges, len(own))))
            new = np.zeros(batch.num_rows, bool)  # a set goes once a task, which copies of it need no more
            for k in range(batch.num_rows):
                new[k] = int(key[k]) not in seen
                seen.add(int(key[k]))
            own, at = own[new[row[own]]], at[new[row[own]]]
            size = (at << 32) | n[row[own]]
            yield pa.RecordBatch.from_arrays([pa.array((token[own] >> np.uint64(16)).astype(np.uint32).view(np.int32)), pa.array(size), pa.array(key[row[own]])], names=["slot", "size", "key"])

    met = texts.mapInArrow(prefix, "slot int, size long, key long")
    # First the slots that two nodes share, by the narrowest rows; the pivot is chosen among what is left.
    twice = met.groupBy("slot").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("slot")
    meeting = cut(met.join(twice, "slot"))
    pivots = meeting.groupBy("slot").agg(F.min(F.struct("size", "key")).alias("p")).select("slot", F.col("p.key").alias("pivot"), F.col("p.size").alias("pivot_size"))
    shared = cut(meeting.join(pivots, "slot").select("slot", "key", "size", "pivot", "pivot_size"))

    def fetch(keys: DataFrame) -> DataFrame:
        """The sets and prefixes of ``keys``, from one row of each; a bitmap of ids of fixed size spares hashing most other rows."""
        ids = nodes.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
        place = F.col("doc_id").bitwiseAND(F.lit(MASK - 1)).cast("int").alias("s")
        found = ids.select(place).groupBy(F.shiftright("s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, s & 31)")).alias("bits")).toArrow()
        bitmap = np.zeros(MASK // 32, np.uint32)
        bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)

        def asked(batches):
            for batch in batches:
                at = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False) & (MASK - 1)
                hit = (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0
                yield batch.filter(pc.or_(pa.array(hit), pc.is_null(batch.column(0))))

        def packed(batches):
            seen: set[int] = set()
            for batch in slices(asked(batches), "text"):
                row, token = sets(*utf8(batch.column("text")), width)
                n, key = set_keys(row, token, batch.num_rows)
                rows = [k for k in np.flatnonzero(n > 0).tolist() if int(key[k]) not in seen and not seen.add(int(key[k]))]
                classes = order.classify(token)
                edges = np.concatenate([[0], np.cumsum(n)])
                six = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                columns = [pa.array(key[rows]), pa.array([six[edges[k] : edges[k + 1]].tobytes() for k in rows], pa.binary())]
                for which in (2, 3):
                    own = np.sort(order.prefixes(row, token, n, classes, which, percent))
                    bounds = np.searchsorted(row[own], np.arange(batch.num_rows + 1))
                    slot = (token[own] >> np.uint64(16)).astype(np.uint32)
                    # Of equal slots (two tokens of a row, very seldom) one stays, so that a match means two rows share it.
                    columns.append(pa.array([distinct(slot[bounds[k] : bounds[k + 1]]).tobytes() for k in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "tokens", "second", "third"])

        sets_of = texts.mapInArrow(packed, "key long, tokens binary, second binary, third binary").join(keys, "key", "left_semi")
        return cut(sets_of.groupBy("key").agg(*(F.first(c).alias(c) for c in ("tokens", "second", "third"))))

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("a", "b")).alias("key")).distinct()

    def sized(x: str, y: str):
        """Whether two sets can be similar if their first common token under the first order stands at these places."""
        n = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
        left = lambda c: n(c) - F.shiftright(c, 32)
        return (100 + percent) * F.least(left(x), left(y)) >= percent * (n(x) + n(y))

    pairs = shared.where("key <> pivot").where(sized("size", "pivot_size")).select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    pairs = cut(pairs)
    known = fetch(ends(pairs))
    links = cut(_verify(pairs, known, percent))
    for last in (False, True):
        parts = connected_components(links)
        part = lambda of: parts.select(F.col("node").alias(of), F.col("component").alias(f"{of}_part"))  # noqa: B023, E731
        named = shared.join(part("key"), "key", "left").join(part("pivot"), "pivot", "left")
        named = named.select("slot", "key", "size", "pivot", F.coalesce("key_part", "key").alias("part"), F.coalesce("pivot_part", "pivot").alias("main"))
        rest = cut(named.where("part <> main").select("slot", F.col("key").alias("a"), F.col("size").alias("a_size"), F.col("part").alias("a_part"), "pivot"))
        if rest.isEmpty():
            break
        if not last:  # one more node to compare with: of those outside the first one's component the one in which the token stands first
            rest = rest.groupBy("slot", "pivot").agg(F.min(F.struct("a_size", "a", "a_part")).alias("x")).select("slot", "pivot", "x.*")
        more = rest.drop("pivot").join(named, "slot").where("a_part <> part AND key <> pivot AND a <> key AND (part = main OR a < key)" if last else "a_part <> part AND key <> pivot")
        more = more.where(sized("a_size", "size")).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
        more = cut(more)
        lacking = cut(ends(more).join(known.select("key"), "key", "left_anti"))
        if not lacking.isEmpty():
            known = known.unionByName(fetch(lacking))
        links = cut(links.unionByName(_verify(more, known, percent)))
    else:
        parts = connected_components(links)
    # One row for each node, then one for each component; groups of copies and large components are joined by broadcast.
    of_key = nodes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    linked = cut(of_key.join(parts.withColumnRenamed("node", "key"), "key", "left"))
    least = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("id"), F.count("*").alias("n_nodes"))
    joined = spread_join(linked.where("component IS NOT NULL").drop("least"), least, ["component"], "n_nodes").select("key", "rows", "id")
    ids = cut(linked.where("component IS NULL").select("key", "rows", F.col("least").alias("id")).unionByName(joined))
    out = spread_join(nodes.where("n > 0"), ids, ["key"], "rows").unionByName(nodes.where("n = 0").withColumn("id", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller id; rows without an id stay."""
    gone = link_components(docs, id_col, text_col, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
