"""How five document filters interact: what each removes at each step of each of the 120 orders in which they can be applied.

A document is reduced to a mask of the filters that it fails; everything else is arithmetic over counts by part and mask (32 a part).
Duplicates, the fifth filter, are found by partition refinement. Rows are split by their length in code points, then by hashes of
successive blocks, each eight times as long as all before it; rows that are alone in their cell leave after each split. Only texts of the cells
that are left are compared, whole: equal ones meet in each task before they are shuffled, so that a text which a third of all
rows share is one row a task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.functions.hof import let
from breakwater.operators.skew import spread_join
from breakwater.plans.lineage import cut

FILTERS = "ABCDE"
#: Limits of A (words), B (percent of distinct words), C (percent of capitals), and the characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
#: Code points of the first block; the longest text that Spark holds has nine blocks.
BLOCK, GROWTH, BLOCKS = 64, 8, 9
#: Bits of the filter of cells that is sent to every task; once it is full it spares no text the shuffle, and loses none either.
BITS = 23
_WORD = 6


def _block_hashes(text: Column, length: Column) -> Column:
    edges = [0] + [BLOCK * GROWTH**k for k in range(BLOCKS)]
    blocks = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(b - a).alias("size")) for a, b in itertools.pairwise(edges)))
    return F.transform(F.filter(blocks, lambda b: (b["at"] == 0) | (b["at"] < length)), lambda b: F.xxhash64(F.substr(text, b["at"] + 1, b["size"])))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", keep_text: bool = False) -> DataFrame:
    """``id, part``, the mask of filters A to D that each row fails (``fails``), its ``length`` and block hashes (``blocks``)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    few = let(words, "int", lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), 2).otherwise(0))
    length = F.length("text")
    loud = F.when(100 * (length - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long") > MOST_CAPITALS * length, 4).otherwise(0)
    marked = F.when(F.col("text").rlike(MARKS), 8).otherwise(0)
    return rows.select("id", "part", (few + loud + marked).alias("fails"), length.alias("length"), _block_hashes(F.col("text"), length).alias("blocks"), *(["text"] if keep_text else []))


def _cell(rounds: int | None = None) -> Column:
    return F.xxhash64("length", "blocks" if rounds is None else F.slice("blocks", 1, rounds))


def refine(rows: DataFrame) -> DataFrame:
    """The rows (``id, length, blocks``) that share a cell with another one after every split."""
    alive, k = rows.select("id", "length", "blocks"), 0
    while True:
        cells = alive.withColumn("cell", _cell(k)) if k else alive.withColumn("cell", F.col("length").cast("long"))
        several = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
        alive = cut(spread_join(cells, several, ["cell"], "n").select("id", "length", "blocks"))
        most = alive.agg(F.max(F.size("blocks"))).first()[0] or 0
        if k >= most:
            return alive
        k += 1


def smallest_ids(docs: DataFrame, alive: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``cell, first, texts``: the least id and the number of different texts of each cell that ``alive`` has, by comparing texts."""
    own = alive.select(_cell().alias("cell")).distinct()
    place = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & {(1 << _WORD) - 1} as int))")
    bits = own.withColumn("at", place(F.col("cell"))).groupBy(F.shiftright("at", _WORD).alias("word")).agg(F.bit_or(bit("at")).alias("bits"))
    texts = facts(docs, id_col, text_col, part_col, keep_text=True).select("id", "text", _cell().alias("cell")).withColumn("at", place(F.col("cell")))
    likely = texts.withColumn("word", F.shiftright("at", _WORD)).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit("at")) != 0)
    classes = likely.groupBy("cell", "text").agg(F.min("id").alias("first"))
    return classes.groupBy("cell").agg(F.min("first").alias("first"), F.count("*").alias("texts")).join(own, "cell", "left_semi")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, fails``: the mask of all five filters of each row; see ``audit_filters``."""
    names = id_col, text_col, part_col
    rows = cut(facts(docs, *names))
    cells = cut(smallest_ids(docs, refine(rows), *names))
    second = lambda first: F.when(F.col("id") > first, 16).otherwise(0)
    celled = rows.withColumn("cell", _cell())
    unlike = cells.where("texts > 1").select("cell")
    if unlike.isEmpty():
        return celled.join(cells, "cell", "left").select("id", "part", (F.col("fails") + second(F.col("first"))).alias("fails"))
    again = facts(docs, *names, keep_text=True).withColumn("cell", _cell()).join(unlike, "cell", "left_semi")
    classes = again.groupBy("cell", "text").agg(F.min("id").alias("first"))
    apart = again.join(classes, ["cell", "text"])
    rest = celled.join(unlike, "cell", "left_anti").join(cells, "cell", "left")
    return rest.select("id", "part", "fails", "first").unionByName(apart.select("id", "part", "fails", "first")).select("id", "part", (F.col("fails") + second(F.col("first"))).alias("fails"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of what each filter does at each step of each order, by part.

    The filters fail A: under 200 words; B: under 50 percent distinct words; C: over 2 percent A-Z; D: any of ``#$%&*|``; E: a text that
    also stands under a smaller id, in any part, removed or not. Returns for each part (null is the empty string), order and step:
    ``part, filter_order, step, kept`` after it, ``removed`` by it, ``redundant`` (failing it, removed earlier), ``unique_fails`` (failing
    no other filter), ``good_lost`` and ``toxic_lost`` (removed by it and labelled so) and ``shapley`` (its ``removed`` over all orders).

    Null and empty texts are equal, have no words, and fail A. Repeated rows (equal id and text) do not mark each other; a null
    id is neither less nor greater than another, so such rows never fail E. An id labelled more than once is good, or toxic, if any of its rows
    says so. No documents give no rows. Other columns are not read.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    rows = masks(docs, id_col, text_col, part_col).join(said, "id", "left")
    sums = [F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in ("quality", "toxic"))]
    counts = rows.groupBy("part", "fails").agg(*sums).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "quality", "toxic")).alias("c"))
    return _orders(counts)


def _orders(counts: DataFrame) -> DataFrame:
    """The audit of each part from ``c``, its at most 32 counts by mask."""

    def left(what: str) -> Column:
        """By set of filters: what passes them all."""
        passes = lambda s: F.filter("c", lambda m: m["fails"].bitwiseAND(s) == 0)
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.aggregate(passes(s), F.lit(0).cast("long"), lambda x, m: x + m[what]))

    orders = F.split(F.lit(" ".join(map("".join, itertools.permutations(FILTERS)))), " ")
    bits = F.transform(F.split("filter_order", ""), lambda c: F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k))), c))
    steps = counts.select("part", "c", *(left(k).alias(k) for k in ("n", "quality", "toxic")), F.explode(orders).alias("filter_order"))
    steps = steps.withColumn("bits", bits).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    steps = steps.withColumn("bit", F.get("bits", F.col("step") - 1)).withColumn("before", F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda x, b: x + b))
    at = lambda what, s: F.get(what, s)
    gone = lambda what: at(what, F.col("before")) - at(what, F.col("before") + F.col("bit"))
    weight = F.array(*(F.lit(w) for w in (24, 6, 4, 6, 24)))  # orders in which the sets of 0 to 4 other filters come before a filter
    others = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda x, s: x + F.get(weight, F.bit_count(s)) * (at("n", s) - at("n", s + F.col("bit"))))
    failing = at("n", F.lit(0)) - at("n", F.col("bit"))
    alone = at("n", 31 - F.col("bit")) - at("n", F.lit(31))
    return steps.select(
        "part", "filter_order", "step", at("n", F.col("before") + F.col("bit")).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"),
        alone.alias("unique_fails"), gone("quality").alias("good_lost"), gone("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )
