"""Flags, qualities, numbers, text and k-mers as expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from breakwater.functions.hof import let

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << k for k in range(12))


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def only_flags(flag: Column, must: int, never: int) -> Column:
    """All bits of ``must`` and none of ``never``, as one comparison: a flag that is worked out is worked out once for it."""
    return flag.bitwiseAND(F.lit(must | never)) == must


def phred(char: Column, offset: int = 33) -> Column:
    """The quality of one character under the offset 33 or 64."""
    return F.ascii(char) - offset


def mean_quality(text: Column, offset: int = 33) -> Column:
    """The mean quality of a text of characters; null if it is empty."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.try_divide(F.aggregate(chars, F.lit(0), lambda n, c: n + phred(c, offset)), F.size(chars))


def shift_quality(text: Column, by: int) -> Column:
    """Qualities of another offset: each character moved by ``by``, not below the lowest one."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.char(F.greatest(F.ascii(c) + by, F.lit(33)))), "")


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10)


def log10_add(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b) without leaving log space."""
    high, low = F.greatest(a, b), F.least(a, b)
    return high + F.log10(1 + F.pow(F.lit(10.0), low - high))


def round_to_ten(x: Column) -> Column:
    return (F.floor((x + 5) / 10) * 10).cast("long")


def round_half_down(x: Column) -> Column:
    return F.ceil(x - 0.5)


def sample_deviation(n: Column, total: Column, squares: Column) -> Column:
    """The sample deviation from whole sums, the same for every order of rows; null below two values."""
    whole = lambda c: c.cast("decimal(38,0)")
    exact = (whole(squares) * whole(n) - whole(total) * whole(total)).cast("double")
    return F.when(n > 1, F.sqrt(exact / (n.cast("double") * (n - 1))))


def log_binomial_free(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln(1 - p): a binomial log likelihood without its coefficient, which cancels in a ratio."""
    return k * F.ln(p) + (n - k) * F.ln(1 - p)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def split_any(text: Column, delimiters: str) -> Column:
    """Split at any of the characters; empty tokens stay."""
    return F.split(text, "[" + "".join(map(re.escape, delimiters)) + "]")


def info_map(info: Column) -> Column:
    """``A=1;B=2`` as a map; a key without a value maps to null."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def info_value(info: Column, key: str) -> Column:
    """The value of one key, null if it is missing."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){re.escape(key)}=([^;]*)", 1), F.lit(""))


def short_id(*parts: Column) -> Column:
    """A deterministic 8-digit hexadecimal name."""
    return F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(8))


def strip_chr(name: Column) -> Column:
    return F.regexp_replace(name, "^chr", "")


def strip_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"\.", "")


def slop(start: Column, end: Column, by: int) -> tuple[Column, Column]:
    """Both ends widened by ``by`` (not below zero), the smaller one first."""
    return F.greatest(F.least(start, end) - by, F.lit(0)), F.greatest(start, end) + by


def class_share(probabilities: Column) -> Column:
    """The greatest probability over their sum."""
    return F.try_divide(F.array_max(probabilities), F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x))


def kmers(text: Column, k: int) -> Column:
    """Every run of ``k`` characters, in order, by one pass of a pattern that looks ahead; a shorter text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1))


def _counted(sorted_values: Column) -> Column:
    """``struct<kinds, entropy>`` (natural logarithm) of an array's values, which come sorted; null for none. One fold within the row."""
    kind = "struct<last:string,n:double,kinds:bigint,total:double,sum:double>"
    log = lambda n: F.when(n > 1, n * F.ln(n)).otherwise(F.lit(0.0))

    def step(s: Column, x: Column) -> Column:
        same = s["last"] == x
        n, kinds = F.when(same, s["n"] + 1).otherwise(F.lit(1.0)), F.when(same, s["kinds"]).otherwise(s["kinds"] + 1)
        return F.struct(x.alias("last"), n.alias("n"), kinds.alias("kinds"), (s["total"] + 1).alias("total"), F.when(same, s["sum"]).otherwise(s["sum"] + log(s["n"])).alias("sum")).cast(kind)

    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("n"), F.lit(0).cast("long").alias("kinds"), F.lit(0.0).alias("total"), F.lit(0.0).alias("sum")).cast(kind)
    # sum p ln(1 / p) over the counts alone: ln t - (sum n ln n) / t
    end = lambda s: F.when(s["total"] > 0, F.struct(s["kinds"].alias("kinds"), (F.ln(s["total"]) - (s["sum"] + log(s["n"])) / s["total"]).alias("entropy")))
    return F.aggregate(sorted_values, start, step, end)


def kmer_entropy(text: Column, k: int) -> Column:
    """``struct<kinds, entropy>`` (natural logarithm) of a text's runs of ``k`` characters but the last one, which is not counted (a
    known quirk). Sorted runs are folded within the row, so nothing is shuffled; null without a run."""
    return _counted(F.sort_array(let(kmers(text, k), "array<string>", lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))))


def character_entropy(text: Column) -> Column:
    """Shannon's entropy of a text's characters in bits; null for an empty text."""
    return _counted(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")))["entropy"] / math.log(2)


def packed_kmers(text: Column, k: int) -> Column:
    """Every run of ``k`` bases of a text as a number (see ``pack_kmer``): each base is coded once, each run is a sum of its codes."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(text, "[^ATGC]", "A"), ""), lambda c: c != ""), lambda c: F.when(c == "T", 1).when(c == "G", 2).when(c == "C", 3).otherwise(0).cast("long"))

    def runs(d: Column) -> Column:
        run = lambda i: sum((F.get(d, i + j) * 4 ** (k - 1 - j) for j in range(1, k)), F.get(d, i) * 4 ** (k - 1))
        return F.when(F.size(d) >= k, F.transform(F.sequence(F.lit(0), F.size(d) - k), run)).otherwise(F.array().cast("array<bigint>"))

    return let(codes, "array<bigint>", runs)


def pack_kmer(kmer: Column) -> Column:
    """Two bits a base, the first base highest: A 0, T 1, G 2, C 3, others 0."""
    return F.conv(F.translate(F.regexp_replace(kmer, "[^ATGC]", "A"), "ATGC", "0123"), 4, 10).cast("long")


def unpack_kmer(value: Column, k: int) -> Column:
    code = lambda i: F.floor(value / F.pow(F.lit(4.0), i)).cast("long").bitwiseAND(F.lit(3)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.get(F.array(*map(F.lit, "ATGC")), code(i))), "")
