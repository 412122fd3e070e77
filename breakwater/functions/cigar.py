"""Alignment strings as arrays of (len, op), and what follows from them, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from breakwater.functions.hof import let

OPS = "array<struct<len:int,op:string>>"


def parse_cigar(text: Column, first_length: bool = False) -> Column:
    """``10S90M`` as an array of (len, op). With ``first_length`` every operation has the first one's length (a known quirk)."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    ops = F.transform(parts, lambda x: F.struct(x.substr(F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.substring(x, -1, 1).alias("op")))
    if first_length:
        return let(ops, OPS, lambda all_: F.transform(all_, lambda x: F.struct(F.get(all_, F.lit(0))["len"].alias("len"), x["op"].alias("op"))))
    return ops


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")


def total(ops: Column, letters: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda n, c: n + F.when(c["op"].isin(*letters), c["len"]).otherwise(0))


def reference_span(ops: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return total(ops, "MXD=N")


def reference_end(pos: Column, ops: Column) -> Column:
    """The last covered place (closed, 0-based)."""
    return pos + reference_span(ops) - 1


def match_bases(ops: Column) -> Column:
    return total(ops, "M")


def read_bases(ops: Column) -> Column:
    """Bases of the read itself."""
    return total(ops, "MIS=X")


def first(ops: Column) -> Column:
    return F.get(ops, F.lit(0))


def last(ops: Column) -> Column:
    return F.element_at(ops, -1)


def long_clip(ops: Column, least: int) -> Column:
    """Whether either end is soft-clipped by ``least`` bases or more."""
    return ((first(ops)["op"] == "S") & (first(ops)["len"] >= least)) | ((last(ops)["op"] == "S") & (last(ops)["len"] >= least))


def both_clipped(ops: Column) -> Column:
    return first(ops)["op"].isin("S", "H") & last(ops)["op"].isin("S", "H")


def indels(pos: Column, ops: Column, least: int = 20, parity: bool = False) -> Column:
    """Insertions and deletions of ``least`` bases or more as (left, right, op), the place advanced over every reference-consuming
    operation; with ``parity`` operations shorter than ``least`` do not advance it."""
    kind = "struct<at:bigint,found:array<struct<left:bigint,right:bigint,op:string>>>"
    empty = F.expr("CAST(array() AS array<struct<left:bigint,right:bigint,op:string>>)")

    def step(state: Column, c: Column) -> Column:
        big = c["len"] >= least
        hit = F.array(F.struct(state["at"].alias("left"), (state["at"] + c["len"]).cast("long").alias("right"), c["op"].alias("op")))
        moves = c["op"].isin("M", "D", "N", "=", "X") & (big if parity else F.lit(True))
        return F.struct((state["at"] + F.when(moves, c["len"]).otherwise(0)).cast("long").alias("at"), F.when(c["op"].isin("I", "D") & big, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found")).cast(kind)

    return F.aggregate(ops, F.struct(pos.cast("long").alias("at"), empty.alias("found")).cast(kind), step)["found"]


def parse_sa(tag: Column) -> Column:
    """``chr,pos,strand,cigar,mapq,nm;`` repeated, as an array; places become 0-based, text without ``;`` has no entries."""
    items = F.filter(F.transform(F.split(tag, ";"), lambda x: F.split(x, ",")), lambda x: F.size(x) == 6)
    return F.transform(items, lambda x: F.struct(x[0].alias("seqid"), (x[1].cast("long") - 1).alias("pos"), (x[2] == "-").alias("reverse"), parse_cigar(x[3]).alias("cigar"), x[4].cast("int").alias("mapq"), x[5].cast("int").alias("nm")))


def parse_xp(tag: Column) -> Column:
    """``chr,±pos,cigar,…;`` repeated; mapping quality and mismatches are unknown."""
    items = F.filter(F.transform(F.split(tag, ";"), lambda x: F.split(x, ",")), lambda x: F.size(x) >= 3)
    none = F.lit(None).cast("int")
    return F.transform(items, lambda x: F.struct(x[0].alias("seqid"), (F.abs(x[1].cast("long")) - 1).alias("pos"), F.startswith(x[1], F.lit("-")).alias("reverse"), parse_cigar(x[2]).alias("cigar"), none.alias("mapq"), none.alias("nm")))


def parse_xa(tag: Column) -> Column:
    """``chr,±pos,cigar,nm;`` repeated."""
    items = F.filter(F.transform(F.split(tag, ";"), lambda x: F.split(x, ",")), lambda x: F.size(x) == 4)
    return F.transform(items, lambda x: F.struct(x[0].alias("seqid"), (F.abs(x[1].cast("long")) - 1).alias("pos"), F.startswith(x[1], F.lit("-")).alias("reverse"), parse_cigar(x[2]).alias("cigar"), x[3].cast("int").alias("nm")))
