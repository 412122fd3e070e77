"""Media columns in the Ogg container: multiplex, verify, reassemble, demultiplex and time logical streams.

A page is a 27-byte header, a segment table and a body. Its checksum is the CRC-32 of polynomial 0x04C11DB7 without
reflection, computed over the page with the checksum field zero. Lacing values of 255 continue a packet; a smaller one ends it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 8000
PACKET = 4096
_FLIP = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
_HEAD = "<4sBBqIIIB"
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, NOTES = 1, 2


def checksum(page: bytes) -> int:
    """The container's CRC: zlib's reflected CRC over bit-reversed bytes, reversed back."""
    x = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


def pages(serial: int, packets: list[tuple[bytes, int]], most: int = 64) -> Iterator[bytes]:
    """One logical stream's pages from (packet, granule position) pairs; a page holds at most ``most`` (255) segments."""
    lacing, ends = bytearray(), {}
    for data, granule in packets:
        lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        ends[len(lacing) - 1] = granule
    body = b"".join(p for p, _ in packets)
    at = 0
    for sequence, k in enumerate(range(0, len(lacing), most)):
        table = bytes(lacing[k : k + most])
        size = sum(table)
        granule = next((ends[i] for i in range(k + len(table) - 1, k - 1, -1) if i in ends), -1)
        flags = (CONTINUED if k and lacing[k - 1] == 255 else 0) | (FIRST if not k else 0) | (LAST if k + most >= len(lacing) else 0)
        page = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, sequence, 0, len(table)) + table + body[at : at + size]
        at += size
        yield page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def write_ogg(payload: bytes, notes: bytes = b"") -> bytes:
    """Two interleaved logical streams: 8-bit samples (a header packet, then ``PACKET`` samples each) and one of notes."""
    head = struct.pack("<8sIQ", b"SAMPLE8\0", RATE, len(payload))
    packets = [(head, 0)] + [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    sound, side = list(pages(SAMPLES, packets)), list(pages(NOTES, [(b"NOTES\0\0\0", 0), (notes, len(payload))]))
    return b"".join([sound[0], side[0], *sound[1:], *side[1:]])


def read_pages(stored: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(serial, sequence, flags, granule, segment table, body) of each page whose checksum holds.

    A page that is cut short, or whose checksum fails, is passed over: reading goes on at the next capture pattern.
    """
    at, view = 0, memoryview(stored)
    while (at := stored.find(b"OggS", at)) >= 0 and at + 27 <= len(stored):
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(_HEAD, stored, at)
        table = stored[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if version or len(table) < n or end > len(stored) or checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            at += 1
            continue
        yield serial, sequence, flags, granule, table, view[at + 27 + n : end]
        at = end


def demultiplex(stored: bytes) -> dict[int, dict]:
    """By serial number: ``packets`` as (bytes, granule or None), ``pages``, ``granule`` of the last page, ``lost`` and ``ended``.

    A packet that begins before a lost page, or goes on after one, is left out and counted in ``lost``.
    """
    streams: dict[int, dict] = {}
    for serial, sequence, flags, granule, table, body in read_pages(stored):
        s = streams.setdefault(serial, {"packets": [], "pages": 0, "granule": 0, "lost": 0, "ended": False, "part": [], "next": 0, "skip": False})
        if sequence != s["next"]:
            s["lost"] += max(1, sequence - s["next"])
            s["part"], s["skip"] = [], bool(flags & CONTINUED)
        elif s["part"] and not flags & CONTINUED:
            s["lost"], s["part"] = s["lost"] + 1, []
        s["next"], s["pages"] = sequence + 1, s["pages"] + 1
        at = start = 0
        ended = None
        for lace in table:
            at += lace
            if lace < 255:
                if not s["skip"]:
                    s["part"].append(bytes(body[start:at]))
                    s["packets"].append([b"".join(s["part"]), None])
                    ended = s["packets"][-1]
                s["part"], s["skip"], start = [], False, at
        if start < at and not s["skip"]:
            s["part"].append(bytes(body[start:at]))
        if ended is not None and granule >= 0:
            ended[1] = granule
        s["granule"] = max(s["granule"], granule)
        s["ended"] |= bool(flags & LAST)
    return streams


def read_ogg(stored: bytes) -> tuple[bytes, bytes, dict]:
    """The samples, the notes and what the container says of the sample stream (packets, pages, seconds, lost)."""
    streams = demultiplex(stored)
    empty = {"packets": [], "pages": 0, "granule": 0, "lost": 1, "ended": False}
    sound, side = streams.get(SAMPLES, empty), streams.get(NOTES, empty)
    rate = struct.unpack_from("<I", sound["packets"][0][0], 8)[0] if sound["packets"] and len(sound["packets"][0][0]) >= 20 else RATE
    about = {"streams": len(streams), "packets": max(0, len(sound["packets"]) - 1), "pages": sum(s["pages"] for s in streams.values()), "ms": sound["granule"] * 1000 // rate, "lost": sound["lost"] + side["lost"]}
    return b"".join(p for p, _ in sound["packets"][1:]), side["packets"][-1][0] if len(side["packets"]) > 1 else b"", about


def features(payload: bytes, about: dict) -> str:
    """Length, mean, loudness and zero crossings of unsigned 8-bit samples, in whole numbers so that equal samples print alike."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0))) if len(x) else 0
    return f"ms={about['ms']};packets={about['packets']};pages={about['pages']};lost={about['lost']};mean={int(centred.sum()) * 1000 // n};power={int((centred * centred).sum()) // n};crossings={crossings};peak={int(np.abs(centred).max()) if len(x) else 0}"


def pad(text: bytes, unit: int = 64) -> bytes:
    return text + b"\0" * ((-len(text)) % unit or (0 if text else unit))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as Ogg samples, read the stored bytes back and describe them.

    Returns a row per input row with the columns of ``_DIGEST`` (the id under ``doc_id``), and ``media`` (the stored bytes)
    if ``keep_media``. Null texts are empty ones: 64 zero samples. Repeated rows give equal rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *[("media", pa.binary())] * keep_media])

    def store(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    text = (text or "").encode()
                    stored = write_ogg(pad(text), struct.pack("<Q", len(text)))
                    back, notes, about = read_ogg(stored)
                    rows.append((doc, struct.unpack("<Q", notes)[0], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, about), *[stored] * keep_media))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(store, _DIGEST + ", media binary" * keep_media)
