"""Binary alignments made by hand, over several blocks, are what their text says."""

import json
import random
import struct
import zlib

import pytest

from breakwater.sources.bam import BASE_LETTERS, CIGAR_LETTERS, BamReader, by_position, read_bam, read_bam_header, read_whole_bam, sample_bam, sample_windows

TEXT = "@HD\tVN:1.6\tSO:coordinate\n@RG\tID:x\tSM:first\n"


def block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, ops, mate, mate_pos, insert, seq, qual, tags):
    packed = bytes(BASE_LETTERS.index(a) << 4 | BASE_LETTERS.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate, mate_pos, insert) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | CIGAR_LETTERS.index(o)) for n, o in ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def test_read_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", len(TEXT)) + TEXT.encode() + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", k) for n, k in ((b"chr1", 5000), (b"chr2", 700)))
    tags = b"NMC\x02" + b"SAZchr2,5,+,5M,60,0;\0" + b"XBBs" + struct.pack("<ihh", 2, 3, -4) + b"XFf" + struct.pack("<f", 0.5)
    data = head + record("a", 65, 0, 99, 60, [(2, "S"), (3, "M")], 1, 10, -7, "ACGTN", bytes([30, 31, 32, 33, 34]), tags) + record("b", 4, -1, -1, 0, [], -1, -1, 0, "ACGT", b"\xff" * 4, b"")
    data += b"".join(record(f"r{k}", 0, 1, k, 7, [(4, "M")], -1, -1, 0, "GGGG", b"\x05" * 4, b"") for k in range(3000))
    (tmp_path / "x.bam").write_bytes(b"".join(block(data[i : i + 1001]) for i in range(0, len(data), 1001)) + block(b""))
    rows = {r.read_name: r for r in read_bam(spark, str(tmp_path / "x.bam"), rows=700).collect()}
    assert len(rows) == 3002 and rows["r2999"].pos == 2999 and rows["r5"].qual == "&&&&"
    a, b = rows["a"], rows["b"]
    assert (a.flag, a.ref, a.pos, a.mapq, a.cigar, a.mate_ref, a.mate_pos, a.insert_size, a.seq, a.qual) == (65, "chr1", 99, 60, "2S3M", "chr2", 10, -7, "ACGTN", "?@ABC")
    assert a.tags == {"NM": "2", "SA": "chr2,5,+,5M,60,0;", "XB": "s,3,-4", "XF": "0.5"}
    assert (b.ref, b.pos, b.cigar, b.qual, b.tags) == ("*", -1, "*", "*", {})
    contigs, samples = read_bam_header(spark, str(tmp_path / "x.bam"))
    assert {(r.name, r.length) for r in contigs.collect()} == {("chr1", 5000), ("chr2", 700)}
    assert [(r.sample, r.sort_order) for r in samples.collect()] == [("first", "coordinate")]
    (tmp_path / "cut.bam").write_bytes(block(data)[:500])
    with pytest.raises(Exception, match="ends early"):
        read_bam(spark, str(tmp_path / "cut.bam")).collect()


def head(contigs):
    return b"BAM\1" + struct.pack("<i", len(TEXT)) + TEXT.encode() + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", k) for n, k in contigs)


def big_file(path, seed, records=4000, size=3000):
    """A sorted file of two contigs and the virtual offset of each record: (ref, pos, end, offset, offset of the next)."""
    r = random.Random(seed)
    own = sorted((r.randrange(2), r.randrange(200_000)) for _ in range(records))
    pieces, data = [], head([(b"chr1", 300_000), (b"chr2", 300_000)])
    for k, (ref, pos) in enumerate(own):
        n = r.randrange(20, 200) if k != 70 else 9000  # one record spans several blocks
        raw = record(f"r{seed}_{k}", 0, ref, pos, r.randrange(60), [(n // 2, "M"), (5, "D"), (n - n // 2, "M")], ref, pos, 0, "".join(r.choice("ACGT") for _ in range(n)), bytes(r.randrange(2, 40) for _ in range(n)), b"NMC\x02")
        pieces.append((ref, pos, pos + n + 5, len(data), len(data) + len(raw)))
        data += raw
    out, starts = b"", {}
    for i in range(0, len(data), size):
        starts[i] = len(out)
        out += block(data[i : i + size])
    path.write_bytes(out + block(b""))
    at = lambda x: starts[x - x % size] << 16 | x % size if x - x % size in starts else len(out) << 16
    return [(ref, pos, end, at(a), at(b)) for ref, pos, end, a, b in pieces]


def bin_of(start, end):
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def index_of(pieces, refs=2):
    out = b"BAI\1" + struct.pack("<i", refs)
    for ref in range(refs):
        bins, linear = {}, {}
        for k, pos, end, a, b in pieces:
            if k == ref:
                bins.setdefault(bin_of(pos, end), []).append((a, b))
                for w in range(pos >> 14, ((end - 1) >> 14) + 1):
                    linear[w] = min(linear.get(w, a), a)
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *c) for c in v) for k, v in bins.items())
        last = max(linear, default=-1) + 1
        out += struct.pack("<i", last) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(last))
    return out


def test_ranges_of_blocks_give_every_record_once(spark, tmp_path):
    big_file(tmp_path / "a.bam", 1)
    whole = sorted(map(tuple, read_whole_bam(spark, str(tmp_path / "a.bam")).collect()), key=repr)
    assert len(whole) == 4000
    for split in (997, 40_000, 1 << 26):
        got = read_bam(spark, str(tmp_path / "a.bam"), split=split)
        assert split > 1 << 20 or got.rdd.getNumPartitions() > 8
        assert sorted(map(tuple, got.collect()), key=repr) == whole


def test_region_reads_its_blocks_only(spark, tmp_path):
    pieces = big_file(tmp_path / "a.bam", 2)
    own = read_whole_bam(spark, str(tmp_path / "a.bam"))
    start, end = 60_000, 70_000
    want = sorted(f"r2_{k}" for k, (ref, pos, stop, _, _) in enumerate(pieces) if ref == 1 and pos < end and stop > start)
    names = lambda df: sorted(r.read_name for r in df.select("read_name").collect())
    assert names(read_bam(spark, str(tmp_path / "a.bam"), split=30_000, region=("chr2", start, end))) == want  # without an index
    (tmp_path / "a.bam.bai").write_bytes(index_of(pieces))
    assert names(read_bam(spark, str(tmp_path), region=("chr2", start, end))) == want and want
    path, index = f"file://{tmp_path}/a.bam", f"file://{tmp_path}/a.bam.bai"
    size = (tmp_path / "a.bam").stat().st_size
    reader = BamReader({"files": json.dumps([(path, size, index)]), "split": "1000000", "rows": "100", "regions": json.dumps([("chr2", start, end)])})
    assert sum((p.end >> 16) - (p.begin >> 16) for p in reader.partitions()) < size / 6
    assert names(read_bam(spark, str(tmp_path), region=("chr9", 0, 10))) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read_bam(spark, str(tmp_path)).where(f"ref = 'chr2' AND pos >= {start} AND pos < {end}")
        assert names(pushed) == names(own.where(f"ref = 'chr2' AND pos >= {start} AND pos < {end}"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_in_one_order(spark, tmp_path):
    for k in (3, 4):
        big_file(tmp_path / f"{k}.bam", k, 500)
    paths = [str(tmp_path / "3.bam"), str(tmp_path / "4.bam")]
    contigs = read_bam_header(spark, paths)[0]
    parts = by_position(read_bam(spark, paths, split=50_000), contigs, 5).rdd.glom().map(lambda rows: [(r.ref, r.pos) for r in rows]).collect()
    flat = [x for p in parts for x in p]
    assert len(flat) == 1000 and flat == sorted(flat) and sum(map(bool, parts)) > 1


def test_sampled_windows(spark, tmp_path):
    pieces = big_file(tmp_path / "a.bam", 6)
    contigs = read_bam_header(spark, str(tmp_path / "a.bam"))[0]
    windows = sample_windows(contigs, 9, 2000)
    assert len(set(windows)) == 9 and windows == sample_windows(contigs, 9, 2000) and all(b - a == 2000 and b <= 300_000 for _, a, b in windows)
    inside = lambda ref, pos, end: any(n == f"chr{ref + 1}" and pos < b and end > a for n, a, b in windows)
    want = sorted(f"r6_{k}" for k, (ref, pos, end, _, _) in enumerate(pieces) if inside(ref, pos, end))
    (tmp_path / "a.bam.bai").write_bytes(index_of(pieces))
    got = sample_bam(spark, str(tmp_path), 9)
    assert sorted(r.read_name for r in got.collect()) == want and want
    near = [("chr1", 1000, 1500), ("chr1", 1400, 2500), ("chr1", 0, 40_000)]  # overlapping regions give a record once
    both = sorted(r.read_name for r in read_bam(spark, str(tmp_path), region=near).collect())
    assert both == sorted(f"r6_{k}" for k, (ref, pos, end, _, _) in enumerate(pieces) if ref == 0 and pos < 40_000)
