"""Binary alignments: blocked gzip is inflated and its records decoded on executors, in bounded batches of rows.

A file is split by ranges of compressed bytes. A task looks for the first block that starts in its range, then for the first record in it:
a place from which a run of records follows whose fields, names and operations are all sound. It ends with the last record that starts
in its range. With an index beside the file, a region is read from the runs of blocks that the index names, and nothing else is.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format.
CIGAR_LETTERS = "MIDNSHP=X"
BASE_LETTERS = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

ALIGNMENTS = "file string, read_name string, flag int, ref string, pos long, mapq int, cigar string, mate_ref string, mate_pos long, insert_size long, seq string, qual string, tags map<string,string>"
MAGIC = b"\x1f\x8b\x08\x04"
_QUALITY = bytes((x + 33) & 255 for x in range(256))
_BASES = str.maketrans("0123456789abcdef", BASE_LETTERS)  # of a base's four bits as a hexadecimal digit


class Inflated:
    """The inflated bytes of a blocked gzip file, read forward a block at a time."""

    def __init__(self, content: bytes):
        self.rest, self.have = memoryview(content), b""

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer only at the end."""
        parts, size = [self.have], len(self.have)
        while size < n and len(self.rest):
            unzip = zlib.decompressobj(31)
            step, block = 1 << 17, []
            while not unzip.eof:
                if not len(self.rest):
                    raise ValueError("a block ends early")
                block.append(unzip.decompress(self.rest[:step]))
                self.rest = self.rest[min(step, len(self.rest)) - len(unzip.unused_data) :]
            parts += block
            size += sum(map(len, block))
        whole = b"".join(parts)
        self.have = whole[n:]
        return whole[:n]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(source: Inflated) -> tuple[str, list[tuple[str, int]]]:
    """The header's text, and the contigs' names and lengths."""
    if source.take(4) != b"BAM\1":
        raise ValueError("no binary alignments")
    text = source.take(source.number()).rstrip(b"\0").decode()
    return text, [(source.take(source.number())[:-1].decode(), source.number()) for _ in range(source.number())]


def _tags(raw: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind == "B":
            inner, n = NUMBERS[chr(raw[at])], struct.unpack_from("<i", raw, at + 1)[0]
            value = chr(raw[at]) + "".join(f",{x:g}" if inner == "f" else f",{x}" for x in struct.unpack_from(f"<{n}{inner}", raw, at + 5))
            at += 5 + n * struct.calcsize(inner)
        else:
            number = struct.unpack_from("<" + NUMBERS[kind], raw, at)[0]
            value, at = f"{number:g}" if kind == "f" else str(number), at + struct.calcsize(NUMBERS[kind])
        out.append((name, value))
    return list(dict(out).items())


def _fields(raw: bytes, named) -> tuple:
    """One record's fields in the order of ``ALIGNMENTS`` without the file; places are 0-based, missing fields ``*``."""
    ref, pos, name_len, mapq, _, n_ops, flag, length, mate_ref, mate_pos, insert = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + name_len
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    bases, at = at + 4 * n_ops, at + 4 * n_ops + (length + 1) // 2
    seq = raw[bases:at].hex().translate(_BASES)[:length] or "*"
    quals = raw[at : at + length]
    qual = "*" if not length or quals[0] == 255 else quals.translate(_QUALITY).decode()
    cigar = "".join([f"{x >> 4}{CIGAR_LETTERS[x & 15]}" for x in ops]) or "*"
    return raw[32 : 31 + name_len].decode(), flag, named(ref), pos, mapq, cigar, named(mate_ref), mate_pos, insert, seq, qual, _tags(raw[at + length :])


def _batches(file: str, rows: Iterator[tuple], most: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ALIGNMENTS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    held = []
    for row in rows:
        held.append((file, *row))
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def records(content: bytes) -> Iterator[tuple]:
    """Each record's fields of a whole file."""
    source = Inflated(content)
    names = [name for name, _ in header(source)[1]]
    while size := source.take(4):
        yield _fields(source.take(struct.unpack("<i", size)[0]), lambda k: names[k] if k >= 0 else "*")


def read_whole_bam(spark: SparkSession, paths: str | list[str], rows: int = 10_000) -> DataFrame:
    """Like ``read_bam``, a file of at most 2 GB a task, by Spark's own reader: for stores that nothing else reaches."""

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(file, records(content.as_buffer().to_pybytes()), rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(decode, ALIGNMENTS)


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))
    return where.open_input_file(name)


class Blocks:
    """The inflated bytes of a file from the block at ``at`` on; ``place`` is the virtual offset (block, byte in it) of the next byte."""

    def __init__(self, file, at: int, ahead: int = 1 << 20):
        self.file, self.size, self.ahead = file, file.size(), ahead
        self.next, self.raw, self.raw_at = at, b"", at
        self.have, self.at, self.marks = b"", 0, []

    def _bytes(self, at: int, n: int) -> bytes:
        if not self.raw_at <= at <= at + n <= self.raw_at + len(self.raw):
            self.raw, self.raw_at = self.file.read_at(min(max(n, self.ahead), self.size - at), at), at
        return self.raw[at - self.raw_at : at - self.raw_at + n]

    def length(self, at: int) -> int:
        """Bytes of the block at ``at``; 0 if none starts there."""
        head = self._bytes(at, min(18, self.size - at))
        if len(head) < 18 or head[:4] != MAGIC or head[12:16] != b"BC\2\0":
            return 0
        n = struct.unpack_from("<H", head, 16)[0] + 1
        return n if n > 25 else 0

    def find(self, end: int) -> bool:
        """Goes to the first block that starts before ``end`` and is followed by others, or by the end of the file."""
        at = self.next
        while at < min(end, self.size):
            chunk = self._bytes(at, min(self.ahead, self.size - at))
            hit = chunk.find(MAGIC)
            if hit < 0:
                at += max(1, len(chunk) - len(MAGIC) + 1)
                continue
            at, step = at + hit, at + hit
            for _ in range(3):
                n = self.length(step) if step < self.size else 0
                if step < self.size and (not n or step + n > self.size):
                    step = -1
                    break
                step += n
            if step >= 0:
                self.next = at
                return at < end
            at += 1
        return False

    def need(self, n: int) -> bool:
        """Whether ``n`` more bytes are there; inflates blocks until they are."""
        parts, size = [self.have[self.at :]], len(self.have) - self.at
        if size >= n:
            return True
        self.marks = [(max(0, m - self.at), at, within + max(0, self.at - m)) for k, (m, at, within) in enumerate(self.marks) if k + 1 == len(self.marks) or self.marks[k + 1][0] > self.at]
        while size < n and self.next < self.size:
            took = self.length(self.next)
            if not took or self.next + took > self.size:
                raise ValueError("a block ends early")
            block = zlib.decompress(self._bytes(self.next, took), 31)
            if block:
                self.marks.append((size, self.next, 0))
            parts.append(block)
            size, self.next = size + len(block), self.next + took
        self.have, self.at = b"".join(parts), 0
        return size >= n

    def place(self) -> tuple[int, int]:
        start, block, within = next(m for m in reversed(self.marks) if m[0] <= self.at)
        return block, within + self.at - start

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("a record ends early")
        self.at += n
        return self.have[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _sound(raw: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record at ``at`` ends if its fields can be a record's; None if they cannot; -1 if it cannot be told for lack of bytes."""
    if at + 36 > len(raw):
        return -1
    size, ref, pos, name_len, _, _, n_ops, _, length, mate_ref, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
    inner = 32 + name_len + 4 * n_ops + (length + 1) // 2 + length
    if not (name_len > 1 and length >= 0 and inner <= size <= inner + (1 << 26)):
        return None
    for k, p in ((ref, pos), (mate_ref, mate_pos)):
        if not (-1 <= k < len(lengths) and -1 <= p and (k < 0 or p <= lengths[k])):
            return None
    if at + 36 + name_len + 4 * n_ops > len(raw):
        return -1
    name = raw[at + 36 : at + 36 + name_len]
    if name[-1] or not all(33 <= x <= 126 for x in name[:-1]):
        return None
    ops = struct.unpack_from(f"<{n_ops}I", raw, at + 36 + name_len)
    return at + 4 + size if all(x & 15 < len(CIGAR_LETTERS) for x in ops) else None


def first_record(blocks: Blocks, end: int, lengths: list[int], run: int = 24, window: int = 1 << 18) -> bool:
    """Moves to the first record that starts in a block before ``end``: ``run`` sound records follow from there, or all to the end."""
    if not blocks.find(end):
        return False
    while blocks.need(1):
        blocks.need(window)
        raw, last = blocks.have, blocks.next >= blocks.size
        for at in range(blocks.at, len(raw)):
            step, seen = at, 0
            while step is not None and step >= 0 and seen < run and step < len(raw):
                step, seen = _sound(raw, step, lengths), seen + 1
            if step is None or (last and step != len(raw) and seen < run) or (not last and seen < 4):
                continue
            blocks.at = at
            return blocks.place()[0] < end
        blocks.at = max(blocks.at, len(raw) - (1 << 17))
        if last or blocks.place()[0] >= end:
            return False
    return False


def _overlapping(start: int, end: int) -> list[int]:
    """The index's bins that overlap [start, end): one of the whole contig, and five levels of eightfold finer ones."""
    return [first + k for shift, first in ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for k in range(start >> shift, (max(end, start + 1) - 1 >> shift) + 1)]


def index_chunks(index: bytes, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """Virtual offsets (begin, end) of the runs that can hold records over [start, end) of contig number ``ref``, in order, joined."""
    if index[:4] != b"BAI\1":
        raise ValueError("no index")
    at, wanted = 8, set(_overlapping(start, min(end, 1 << 29)))
    for k in range(struct.unpack_from("<i", index, 4)[0]):
        found: list[tuple[int, int]] = []
        bins, at = struct.unpack_from("<i", index, at)[0], at + 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", index, at)
            if k == ref and number in wanted:
                found += struct.iter_unpack("<QQ", index[at + 8 : at + 8 + 16 * chunks])
            at += 8 + 16 * chunks
        windows, at = struct.unpack_from("<i", index, at)[0], at + 4
        if k == ref:
            first = struct.unpack_from("<Q", index, at + 8 * min(start >> 14, windows - 1))[0] if windows else 0
            out: list[tuple[int, int]] = []
            for a, b in sorted((max(a, first), b) for a, b in found if b > first):
                if out and a <= out[-1][1]:
                    out[-1] = out[-1][0], max(b, out[-1][1])
                else:
                    out.append((a, b))
            return out
        at += 8 * windows
    return []


@dataclass
class Piece(InputPartition):
    """A range of a file: bytes, or virtual offsets from an index (``exact``) that may hold records of one region (its number)."""

    file: str
    begin: int
    end: int
    exact: bool = False
    region: int = -1


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.split, self.rows = int(options["split"]), int(options["rows"])
        self.regions = [tuple(r) for r in json.loads(options["regions"])] if options.get("regions") else None

    def partitions(self):
        out = []
        for file, size, index in self.files:
            if self.regions and index:
                with _open(file) as handle, _open(index) as other:
                    names, content = [n for n, _ in header(Blocks(handle, 0))[1]], other.read()
                for k, (name, start, end) in enumerate(self.regions):
                    if name in names:
                        out += [Piece(file, a, b, True, k) for a, b in index_chunks(content, names.index(name), start, end)]
                continue
            out += [Piece(file, k, min(k + self.split, size)) for k in range(0, size, self.split)]
        return out or [Piece("", 0, 0)]

    def read(self, piece: Piece):
        if piece.file:
            yield from _batches(piece.file, self._rows(piece), self.rows)

    def _rows(self, piece: Piece) -> Iterator[tuple]:
        with _open(piece.file) as handle:
            top = Blocks(handle, 0)
            contigs = header(top)[1]
            names, lengths = [n for n, _ in contigs], [n for _, n in contigs]
            named = lambda k: names[k] if k >= 0 else "*"
            if piece.exact:
                blocks = Blocks(handle, piece.begin >> 16)
                blocks.need((piece.begin & 0xFFFF) + 1)
                blocks.at = piece.begin & 0xFFFF
                before = lambda: (lambda p: p[0] << 16 | p[1])(blocks.place()) < piece.end
            else:
                blocks = Blocks(handle, piece.begin)
                if not piece.begin:
                    blocks = top
                elif not first_record(blocks, piece.end, lengths):
                    return
                before = lambda: blocks.place()[0] < piece.end
            wanted = None if self.regions is None else [(names.index(n) if n in names else -2, a, b) for n, a, b in self.regions]
            while blocks.need(1) and before():
                raw = blocks.take(blocks.number())
                if wanted is not None:  # a record belongs to the first region that it overlaps
                    first = next((k for k, w in enumerate(wanted) if _inside(raw, *w)), -1)
                    if first < 0 or piece.region not in (-1, first):
                        continue
                yield _fields(raw, named)


class FilteredBamReader(BamReader):
    """The reader of sessions that push filters down; Spark refuses one that takes filters in others."""

    def pushFilters(self, filters):
        """A contig, and bounds of places on it, become a region; Spark applies all filters again."""
        ref, low, high = None, 0, 1 << 29
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ref",):
                ref = f.value
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("pos",):
                low = max(low, f.value)
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("pos",):
                high = min(high, f.value + 1)
            yield f
        if ref is not None and self.regions is None:
            self.regions = [(ref, low, high)]


def _inside(raw: bytes, ref: int, start: int, end: int) -> bool:
    """Whether a record overlaps [start, end) of a contig; one without operations covers one base."""
    own, pos, name_len, _, _, n_ops = struct.unpack_from("<iiBBHH", raw)
    if own != ref or pos >= end:
        return False
    ops = struct.unpack_from(f"<{n_ops}I", raw, 32 + name_len)
    return pos + max(1, sum(x >> 4 for x in ops if CIGAR_LETTERS[x & 15] in "MDN=X")) > start


class BamSource(DataSource):
    """``spark.read.format("blocked_alignments")`` with options ``files`` (JSON of path, size, index), ``split``, ``rows``, ``regions``."""

    @classmethod
    def name(cls) -> str:
        return "blocked_alignments"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return (FilteredBamReader if self.options["push"] == "true" else BamReader)(self.options)


def read_bam(spark: SparkSession, paths: str | list[str], rows: int = 10_000, split: int = 64 << 20, region: tuple[str, int, int] | list[tuple[str, int, int]] | None = None) -> DataFrame:
    """The columns that text alignments have, in tasks of about ``split`` compressed bytes; files, folders and patterns are taken.

    ``region`` (contig, start, end; 0-based, half open), or a list of them, keeps the records that overlap one, each once; where an index lies beside a file (the file's
    name, with or without its ending, and ``.bai``), only the blocks that it names are read. Filters on ``ref`` and ``pos`` do the same
    where ``spark.sql.python.filterPushdown.enabled`` is set. A file that is cut short, or of another format, is an error.
    """
    listed = lambda p: {r.path: r.length for r in spark.read.format("binaryFile").load(p).select("path", "length").toLocalIterator()}
    found = {p: n for p, n in listed(paths).items() if not p.endswith(".bai")}
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    beside = {f"{p.rsplit('/', 1)[0]}/*.bai" for p in found} if region or push == "true" else set()
    indexes: set[str] = set()
    for pattern in beside:
        try:
            indexes |= set(listed(pattern))
        except AnalysisException:  # the folder has none
            continue
    files = [(p, n, next((i for i in (f"{p}.bai", f"{p.removesuffix('.bam')}.bai") if i in indexes), None)) for p, n in sorted(found.items())]
    spark.dataSource.register(BamSource)
    options = {"files": json.dumps(files), "split": str(split), "rows": str(rows), "push": push} | ({"regions": json.dumps([region] if isinstance(region, tuple) else region)} if region else {})
    return spark.read.format("blocked_alignments").options(**options).load()


def sample_windows(contigs: DataFrame, count: int, width: int = 2000, seed: int = 1) -> list[tuple[str, int, int]]:
    """At most ``count`` different windows of ``width`` bases of the contigs (``name, length``), those of the lowest hash."""
    lengths = contigs.groupBy("name").agg(F.max("length").alias("length")).where(F.col("length") >= width)
    tiles = lengths.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / width) - 1)).alias("k"))
    few = tiles.orderBy(F.xxhash64(F.lit(seed), "name", "k"), "name", "k").limit(count)
    return [(r.name, r.k * width, (r.k + 1) * width) for r in few.collect()]


def sample_bam(spark: SparkSession, paths: str | list[str], count: int = 64, width: int = 2000, seed: int = 1) -> DataFrame:
    """The records of ``count`` random windows of the files' contigs; with indexes nothing but their blocks is read.

    For estimates, such as ``library_stats``, of files that are too large to read for them.
    """
    windows = sample_windows(read_bam_header(spark, paths)[0], count, width, seed)
    return read_bam(spark, paths, region=windows) if windows else read_bam(spark, paths).where("false")


def by_position(reads: DataFrame, contigs: DataFrame, parts: int | None = None) -> DataFrame:
    """Alignments of all files in one order: by contig as the header lists them (``contigs`` has ``name, number``), then by place.

    Ranges of places are the partitions, and each is sorted, so what follows sees every place's reads together and no task more than its range.
    """
    numbered = reads.join(contigs.select(F.col("name").alias("ref"), "number").distinct(), "ref", "left")
    order = [F.coalesce("number", F.lit(1 << 30)), "pos", "file", "read_name", "flag"]
    return numbered.repartitionByRange(*([parts] if parts else []), *order[:2]).sortWithinPartitions(*order).drop("number")


def read_bam_header(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``contigs`` (file, name, length, number) and ``samples`` (file, sample, sort order), as of text alignments; only first blocks are read."""

    def decode(batches):
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                with _open(file) as handle:
                    rows.append((file, *header(Blocks(handle, 0, 1 << 16))))
            lists = [[{"name": n, "length": k, "number": i} for i, (n, k) in enumerate(contigs)] for _, _, contigs in rows]
            kind = pa.list_(pa.struct([("name", pa.string()), ("length", pa.int64()), ("number", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(lists, kind)], names=["file", "text", "contigs"])

    found = spark.read.format("binaryFile").load(paths).select("path").where("path NOT LIKE '%.bai'")
    read = found.mapInArrow(decode, "file string, text string, contigs array<struct<name:string,length:long,number:int>>")
    tag = lambda line, key: F.nullif(F.regexp_extract("text", rf"(?m)^{line}\b.*?\t{key}:([^\t\n]+)", 1), F.lit(""))
    return read.select("file", F.inline("contigs")), read.select("file", tag("@RG", "SM").alias("sample"), tag("@HD", "SO").alias("sort_order"))
