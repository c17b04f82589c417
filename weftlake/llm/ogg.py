"""Op 12: media columns in Ogg: pages with checksums, packets from lacing values, logical streams, time from granule positions."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, released

#: Samples a second of each stream, streams of a file, samples in a packet, lacing values in a page of the writer; the padded size's unit.
RATE, TRACKS, FRAME, LACING, UNIT = 8000, 2, 1024, 32, 64
#: Fixed values of the format: capture pattern, header fields (version, flags, granule position, serial, sequence, checksum, segments), flags, and the PCM mapping's
#: magic and code of unsigned 8-bit samples.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
PCM, PCM_HEADER, UNSIGNED_8 = b"PCM     ", struct.Struct(">8sHHIIBBHI"), 1
#: Bytes of media that a kernel holds before it hands on a batch.
BATCH = 4 << 20
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32 (polynomial 0x04C11DB7, most significant bit first, from zero) of a page whose own checksum counts as zero.

    It is the common CRC-32, which takes the least significant bit first, of the same bytes with their bits reversed, without its complements.
    """
    mirrored = page.translate(_REVERSED)
    crc = zlib.crc32(mirrored[26:], zlib.crc32(b"\0\0\0\0", zlib.crc32(mirrored[:22], 0xFFFFFFFF))) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


# ---- writing -------------------------------------------------------------------------------------


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body)
    page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def stream_pages(packets: list[tuple[bytes, int]], serial: int, lacing: int = LACING, alone: int = 2) -> list[bytes]:
    """Pages of one logical stream of (packet, granule position at its end); the first `alone` packets, its headers, end their pages.

    A page has at most `lacing` segments; a packet that does not fit goes on in the next page, and a page in which no packet ends has the granule position -1.
    """
    pages: list[tuple] = []
    sizes, body, granule, flags = bytearray(), bytearray(), -1, FIRST

    def flush(goes_on: bool) -> None:
        nonlocal granule, flags
        pages.append((flags, granule, bytes(sizes), bytes(body)))
        sizes.clear()
        body.clear()
        granule, flags = -1, CONTINUED if goes_on else 0

    for k, (packet, end) in enumerate(packets):
        whole, rest = divmod(len(packet), 255)
        left, at = [*[255] * whole, rest], 0
        while left:
            if len(sizes) == lacing:
                flush(at > 0)
            now = left[: lacing - len(sizes)]
            size = sum(now)
            sizes += bytes(now)
            body += packet[at : at + size]
            at += size
            left = left[len(now) :]
        granule = end
        if k < alone:
            flush(False)
    if sizes:
        flush(False)
    out = []
    for k, (flag, granule, lace, data) in enumerate(pages):
        out.append(_page(flag | (LAST if k == len(pages) - 1 else 0), granule, serial, k, lace, data))
    return out


def write_media(payload: bytes, rate: int = RATE, tracks: int = TRACKS, frame: int = FRAME) -> bytes:
    """An Ogg file of 8-bit samples: frames are dealt to the tracks in turn, each track a logical stream; first all first pages, then pages of the tracks by turns.

    Serial numbers follow from the payload, so equal payloads give equal files. A track without a frame has its headers only.
    """
    base = zlib.crc32(payload)
    streams = []
    for track in range(tracks):
        comment = b"TRACK=%d/%d" % (track, tracks)
        packets = [(PCM_HEADER.pack(PCM, 0, 0, UNSIGNED_8, rate, 8, 1, frame, 0), 0), (struct.pack("<I", 0) + struct.pack("<II", 1, len(comment)) + comment, 0)]
        end = 0
        for at in range(track * frame, len(payload), tracks * frame):
            packet = payload[at : at + frame]
            end += len(packet)
            packets.append((packet, end))
        streams.append(stream_pages(packets, (base + track) & 0xFFFFFFFF))
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


# ---- reading -------------------------------------------------------------------------------------


@dataclass
class Page:
    offset: int
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    fine: bool


def read_pages(media: bytes) -> Iterator[Page]:
    """Pages in order. One with a wrong checksum is not fine, and the search for the capture pattern goes on inside it; bytes between pages and a page cut short are passed over."""
    at = media.find(CAPTURE)
    while at >= 0 and at + HEADER.size <= len(media):
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        begin = at + HEADER.size + n
        lacing = media[at + HEADER.size : begin]
        end = begin + sum(lacing)
        fine = version == 0 and len(lacing) == n and end <= len(media) and checksum(media[at:end]) == crc
        if version == 0 and len(lacing) == n and end <= len(media):
            yield Page(at, flags, granule, serial, sequence, lacing, media[begin:end] if fine else b"", fine)
        if fine and media[end : end + 4] == CAPTURE:
            at = end
        else:
            at = media.find(CAPTURE, end if fine else at + 1)


@dataclass
class Stream:
    """A logical stream: its packets with the granule position at their end and the number of the page in which they end."""

    serial: int
    rate: int = 0
    track: int = 0
    tracks: int = 1
    lost: int = 0
    expected: int = 0
    part: bytearray | None = None
    packets: list[tuple[bytes, int, int]] = field(default_factory=list)

    def take(self, page: Page) -> None:
        if page.sequence != self.expected:
            self.lost += max(1, page.sequence - self.expected)
            self.part = None
        self.expected = page.sequence + 1
        if not page.flags & CONTINUED:
            self.part = bytearray()  # what was begun and does not go on is lost
        ended, at = [], 0
        for size in page.lacing:
            if self.part is not None:
                self.part += page.body[at : at + size]
            at += size
            if size < 255:
                if self.part is not None:
                    ended.append(bytes(self.part))
                self.part = bytearray()
        if page.lacing and page.lacing[-1] < 255:
            self.part = None if page.flags & LAST else bytearray()
        end = page.granule
        made = []
        for packet in reversed(ended):  # the page's position is the end of the last packet that ends in it
            made.append((packet, end, page.sequence))
            end -= len(packet)
        self.packets += made[::-1]

    def settle(self) -> None:
        """Takes the header packets off."""
        if self.packets and self.packets[0][0][: len(PCM)] == PCM and len(self.packets[0][0]) >= PCM_HEADER.size and self.packets[0][2] == 0:
            self.rate = PCM_HEADER.unpack_from(self.packets[0][0])[4]
            self.packets = self.packets[1:]
            if self.packets and self.packets[0][2] == 1:
                if found := re.search(rb"TRACK=(\d{1,9})/(\d{1,9})", self.packets[0][0]):
                    self.track, self.tracks = int(found[1]), int(found[2])
                self.packets = self.packets[1:]
        else:
            self.packets = []  # of a stream without its header nothing is known


def read_media(media: bytes | None) -> tuple[list[Stream], int, int]:
    """(streams by track, pages, pages with a wrong checksum)."""
    streams: dict[int, Stream] = {}
    n = bad = 0
    for page in read_pages(media or b""):
        n += 1
        if page.fine:
            streams.setdefault(page.serial, Stream(page.serial)).take(page)
        else:
            bad += 1
    for s in streams.values():
        s.settle()
    return sorted(streams.values(), key=lambda s: (s.track, s.serial)), n, bad


def samples(streams: list[Stream]) -> bytes:
    """The samples of all streams by the time at which packets begin, tracks in turn."""
    # granule positions of one rate are compared, times of different rates else
    timed = [((end - len(p)) / s.rate if s.rate else 0.0, s.track, p) for s in streams for p, end, _ in s.packets]
    timed.sort(key=lambda x: x[:2])
    return b"".join(p for _, _, p in timed)


def describe(streams: list[Stream], pages: int, bad: int, payload: bytes) -> str:
    """Features of a file: streams, pages, wrong pages, lost pages, packets, length in microseconds, and of the samples about their middle: sum, sum of squares, crossings, a histogram."""
    x = np.frombuffer(payload, np.uint8)
    signed = x.astype(np.int64) - 128
    high = x >= 128
    length = max((s.packets[-1][1] * 1_000_000 // s.rate for s in streams if s.packets and s.rate), default=0)
    levels = ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))
    packets = "+".join(str(len(s.packets)) for s in streams)
    return f"streams={len(streams)};pages={pages};bad={bad};lost={sum(s.lost for s in streams)};packets={packets};us={length};sum={int(signed.sum())};squares={int((signed * signed).sum())};crossings={int((high[1:] != high[:-1]).sum())};levels={levels}"


# ---- columns -------------------------------------------------------------------------------------


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row, own in rows:
        held.append(row)
        size += own
        if size >= BATCH or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches, n: int) -> Iterator[tuple]:
    """Rows of the first n columns, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(batch.column(k).slice(at, 256).to_pylist() for k in range(n)), strict=True)


def media_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text (null: empty) as UTF-8, filled with zeros to a positive multiple of UNIT bytes, as an Ogg file. Repeated rows repeat."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        def made():
            for ident, raw in _rows(batches, 2):
                raw = raw or b""
                media = write_media(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                yield (ident, len(raw), media), len(media)

        yield from _batches(made(), schema)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(released(run), "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def packets_of(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, serial, track, packet, start_us, end_us, data): the data packets of each file's logical streams, in order, with times from granule positions.

    Pages with a wrong checksum are left out, and so are packets of which a part is lost; the other packets keep their times. Null or foreign media have no packets.
    """
    schema = pa.schema([("key", pa.int64()), ("serial", pa.int64()), ("track", pa.int32()), ("packet", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("data", pa.binary())])

    def run(batches):
        def made():
            for ident, raw in _rows(batches, 2):
                for s in read_media(raw)[0]:
                    for k, (packet, end, _) in enumerate(s.packets):
                        yield (ident, s.serial, s.track, k, (end - len(packet)) * 1_000_000 // (s.rate or 1), end * 1_000_000 // (s.rate or 1), packet), len(packet)

        yield from _batches(made(), schema)

    rows = stored.select(F.col(key).cast("long").alias("key"), F.col(media).alias("raw"))
    return rows.mapInArrow(released(run), "key long, serial long, track int, packet long, start_us long, end_us long, data binary").withColumnRenamed("key", key)


def media_features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored(key, n_bytes, media), all from the stored bytes.

    Media that are null count as empty: no payload, whose digest is that of no bytes. A damaged file has the payload of its whole packets, and says so in feature.
    """
    names = [("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(names)

    def run(batches):
        def made():
            for ident, n, raw in _rows(batches, 3):
                streams, pages, bad = read_media(raw)
                payload = samples(streams)
                row = (ident, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), describe(streams, pages, bad, payload))
                yield row, 512

        yield from _batches(made(), schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    rows = stored.select(F.col(key).cast("long").alias("key"), "n_bytes", "media")
    return rows.mapInArrow(released(run), ", ".join(f"{n} {kinds[t]}" for n, t in names)).withColumnRenamed("key", key)


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of the table documents as stored Ogg files, and what is read back from them. A null doc_id stays null; equal texts have equal values; an empty table gives no rows."""
    stored = Scratch(spark, "media").keep(media_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", compression="zstd")
    return media_features(stored)
