"""Captured responses in web archive files: a batch source with planned partitions and filters on the host, a sink, and a streaming source that polls feeds in them."""

from __future__ import annotations

import bisect
import datetime as dt
import gzip
import io
import json
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a response is: the body is text, decoded by the charset that the headers name.
RESPONSE = "url string, host string, fetched_at timestamp, status int, reason string, headers map<string,string>, body string"
POLL = "feed_url string, fetched_at timestamp, body string, error string"
#: Bytes of archive that a task reads, records that go into one file, and rows of a batch.
SPLIT, RECORDS, ROWS = 64 << 20, 50_000, 512
INTERVAL, CONCURRENCY = 1800, 3
#: Fixed words of the formats: WARC's version and record type, HTTP's version.
WARC, KIND, HTTP = "WARC/1.0", "response", "HTTP/1.1"
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


def host_name(url: str | None) -> str:
    """The url's host, lower-case, without user and port; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and folder of a path or URI. Tasks open files themselves, so it must be one that all executors reach."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- records ------------------------------------------------------------------------------------


@dataclass
class Entry:
    """A line of a file's index: where the response of a url at a time is. Lines are in order of the host's labels from the right, so hosts of a domain stand together."""

    key: str
    url: str
    at: int
    offset: int
    length: int


def host_key(host: str) -> str:
    return ",".join(reversed(host.split(".")))


def record(row: dict) -> bytes:
    """A response as one gzip member that holds one record."""
    headers = {k: v for k, v in (row.get("headers") or {}).items()}
    body = (row.get("body") or "").encode(_charset(headers), "replace")
    head = "".join(f"{_plain(k)}: {_plain(v)}\r\n" for k, v in headers.items())
    block = f"{HTTP} {row.get('status') or 0} {_plain(row.get('reason'))}\r\n{head}\r\n".encode() + body
    at = row["fetched_at"] or dt.datetime(1970, 1, 1)
    fields = f"{WARC}\r\nWARC-Type: {KIND}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {at:%Y-%m-%dT%H:%M:%S.%fZ}\r\nWARC-Target-URI: {_plain(row['url'])}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(fields.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _plain(text) -> str:
    return re.sub(r"[\r\n]+", " ", "" if text is None else str(text))


def _charset(headers: dict) -> str:
    found = next((m[1] for k, v in headers.items() if k.lower() == "content-type" and (m := _CHARSET.search(v or ""))), "utf-8")
    try:
        "".encode(found)
        return found
    except LookupError:
        return "utf-8"


def parse_record(raw: bytes) -> dict | None:
    """A response from its gzip member; None for a record of another kind."""
    data = gzip.decompress(raw)
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if fields.get("warc-type") != KIND:
        return None
    block = rest[: int(fields["content-length"])]
    head, _, body = block.partition(b"\r\n\r\n")
    if block.startswith(b"\r\n", block.find(b"\r\n") + 2) and b"\r\n\r\n" not in head:  # no header at all
        head, body = block[: block.find(b"\r\n")], block[block.find(b"\r\n") + 4 :]
    said = head.decode("utf-8", "replace").split("\r\n")
    _, status, reason = (said[0].split(" ", 2) + ["", ""])[:3]
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in said[1:])
    at = dt.datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=dt.UTC)
    url = fields["warc-target-uri"]
    return {"url": url, "host": host_name(url), "fetched_at": at, "status": int(status), "reason": reason, "headers": headers, "body": body.decode(_charset(headers), "replace")}


class Archive:
    """One archive file and its index beside it."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.files, self.path = files, path

    def index(self) -> list[Entry]:
        with self.files.open_input_stream(self.path.removesuffix(".warc.gz") + ".idx") as f:
            lines = f.read().decode().splitlines()
        return [Entry(k, u, int(a), int(o), int(n)) for k, u, a, o, n in (x.split("\t") for x in lines)]

    def find(self, hosts: set[str]) -> list[Entry]:
        entries = self.index()
        keys = [e.key for e in entries]
        return [e for k in sorted(map(host_key, hosts)) for e in entries[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]]

    def open(self, entries: list[Entry]) -> Iterator[dict]:
        """The responses of some entries; only their bytes are read."""
        with self.files.open_input_file(self.path) as f:
            for e in sorted(entries, key=lambda e: e.offset):
                f.seek(e.offset)
                got = parse_record(f.read(e.length))
                if got is not None:
                    yield got


def archives(path: str) -> list[tuple[str, int]]:
    files, root = folder(path)
    found = files.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.path.endswith(".warc.gz") and f.base_name[0] not in "_.")


# ---- batch --------------------------------------------------------------------------------------


class Split(InputPartition):
    """Some files, or the k-th of n parts of one."""

    def __init__(self, paths: list[str], k: int = 0, n: int = 1):
        self.paths, self.k, self.n = paths, k, n


_ARROW = pa.schema(
    [("url", pa.string()), ("host", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")), ("status", pa.int32()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string())]
)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def batch():
        columns = [pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in held], f.type) for f in _ARROW]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.hosts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes host = 'x' and host in (...); what it takes it applies in full."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("host",):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("host",):
                own = set(f.value)
            else:
                yield f
                continue
            self.hosts = own if self.hosts is None else self.hosts & own

    def partitions(self):
        """Small files together, large ones in parts, by their size; the indexes are read by the tasks. With no host left there is nothing to read."""
        if self.hosts is not None and not self.hosts:
            return []
        out: list[Split] = []
        held: list[str] = []
        size = 0
        for path, n in archives(self.path):
            parts = 1 if self.hosts is not None else max(1, round(n / self.split))
            if parts > 1:
                out += [Split([path], k, parts) for k in range(parts)]
                continue
            if held and size + n > self.split:
                out.append(Split(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, *([Split(held)] if held else [])]

    def read(self, partition: Split):
        return _batches(self.responses(partition))

    def responses(self, partition: Split) -> Iterator[dict]:
        files, _ = folder(self.path)
        for path in partition.paths:
            archive = Archive(files, path)
            entries = archive.find(self.hosts) if self.hosts is not None else archive.index()
            entries.sort(key=lambda e: e.offset)
            yield from archive.open(entries[len(entries) * partition.k // partition.n : len(entries) * (partition.k + 1) // partition.n])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    """Each task writes archives and their indexes under hidden names; the commit gives them their own, so a job that fails leaves nothing that a reader sees."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        files, root = folder(self.path)
        files.create_dir(root, recursive=True)
        names: list[str] = []
        rows = iter(iterator)
        while True:
            entries: list[Entry] = []
            out = io.BytesIO()
            for row in rows:
                raw = record(row.asDict())
                at = int(row["fetched_at"].timestamp()) if row["fetched_at"] else 0
                entries.append(Entry(host_key(host_name(row["url"])), _plain(row["url"]).replace("\t", "%09"), at, out.tell(), len(raw)))
                out.write(raw)
                if len(entries) == RECORDS or out.tell() >= SPLIT:
                    break
            if not entries:
                return Written(names)
            name = f"responses-{uuid.uuid4().hex}"
            entries.sort(key=lambda e: (e.key, e.url, e.at, e.offset))
            for end, data in ((".idx", "".join(f"{e.key}\t{e.url}\t{e.at}\t{e.offset}\t{e.length}\n" for e in entries).encode()), (".warc.gz", out.getvalue())):
                with files.open_output_stream(f"{root}/_{name}{end}", compression=None) as f:
                    f.write(data)
            names.append(name)

    def commit(self, messages) -> None:
        files, root = folder(self.path)
        old = [p for p, _ in archives(self.path)] if self.overwrite else []
        for m in filter(None, messages):
            for name in m.names:
                for end in (".idx", ".warc.gz"):  # an archive appears after its index
                    files.move(f"{root}/_{name}{end}", f"{root}/{name}{end}")
        for p in old:
            files.delete_file(p)
            files.delete_file(p.removesuffix(".warc.gz") + ".idx")

    def abort(self, messages) -> None:
        files, root = folder(self.path)
        for m in filter(None, messages):
            for name in m.names:
                for end in (".idx", ".warc.gz"):
                    if files.get_file_info(f"{root}/_{name}{end}").type != pafs.FileType.NotFound:
                        files.delete_file(f"{root}/_{name}{end}")


class ArchiveSource(DataSource):
    """format("webarchive"): captured responses in a folder. Options: path; split, the bytes of archive for a task.

    Spark hands filters down once for each load(): where one query needs the archive with and without a filter, load it twice.
    """

    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


# ---- polls --------------------------------------------------------------------------------------


class Feeds(InputPartition):
    """Feeds that one task polls, as of a time: whole ones, or with pages the k-th of n parts of their documents."""

    def __init__(self, urls: list[str], at: float, k: int = 0, n: int = 1):
        self.urls, self.at, self.k, self.n = urls, at, k, n


class PollReader(DataSourceStreamReader):
    """Refreshes of all feeds: the first at once, then one when an interval has begun or a refresh is asked for.

    An offset is {"tick", "request", "at"}: the interval that has begun last, the number of requests seen, and the time of the later of both. However many of them fall between two batches, they
    are one refresh. All that a batch reads follows from its end: what was captured of each feed up to that time; so a batch that is repeated from a checkpoint is the same.
    """

    def __init__(self, options: dict):
        self.feeds, self.responses, self.requests, self.clock = options["feeds"], options["responses"], options.get("requests"), options.get("clock")
        self.interval, self.concurrency = float(options.get("interval", INTERVAL)), int(options.get("concurrency", CONCURRENCY))
        self.pages = options.get("pages")

    def _now(self) -> float:
        if not self.clock:
            return time.time()
        files, path = folder(self.clock)
        with files.open_input_stream(path) as f:
            return float(f.read())

    def _asked(self, now: float) -> list[float]:
        """Times of the requests up to now: files that are named by their time."""
        if not self.requests:
            return []
        files, root = folder(self.requests)
        names = [f.base_name.removesuffix(".request") for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".request")]
        return sorted(t for t in map(float, names) if t <= now)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": -1, "request": 0, "at": 0.0}

    def latestOffset(self) -> dict:  # noqa: N802
        now = self._now()
        asked = self._asked(now)
        tick = int(now // self.interval)
        return {"tick": tick, "request": len(asked), "at": max(tick * self.interval, asked[-1] if asked else 0.0)}

    def partitions(self, start: dict, end: dict):
        if (end["tick"], end["request"]) == (start["tick"], start["request"]):
            return []
        files, path = folder(self.feeds)
        with files.open_input_stream(path) as f:
            urls = [u for u in dict.fromkeys(x.strip() for x in f.read().decode().splitlines()) if u]
        if self.pages and urls:
            return [Feeds(urls, end["at"], k, self.concurrency) for k in range(self.concurrency)]
        n = min(self.concurrency, len(urls))
        return [Feeds(urls[k::n], end["at"]) for k in range(n)]

    def _feed(self, url: str, wanted: set[str]) -> str | None:
        """The feed that a captured document belongs to: its own, or with pages the one that it is a page of."""
        if url in wanted or not self.pages:
            return url if url in wanted else None
        base, mark, number = url.rpartition(f"{self.pages}=")
        return base[:-1] if mark and number.isdigit() and base[-1:] in ("?", "&") and base[:-1] in wanted else None

    def read(self, partition: Feeds):
        files, _ = folder(self.responses)
        last: dict[str, tuple[int, Archive, Entry]] = {}
        wanted, hosts = set(partition.urls), {host_name(u) for u in partition.urls}
        for path, _ in archives(self.responses):
            archive = Archive(files, path)
            for e in archive.find(hosts):
                if e.at <= partition.at and self._dealt(e.url, partition) and self._feed(e.url, wanted) and (e.url not in last or last[e.url][0] < e.at):
                    last[e.url] = (e.at, archive, e)
        at = dt.datetime.fromtimestamp(partition.at, dt.UTC)
        for url in dict.fromkeys([*(u for u in partition.urls if self._dealt(u, partition)), *last]):
            if url not in last:
                yield url, at, None, "no response"
                continue
            _, archive, entry = last[url]
            got = next(archive.open([entry]))
            good = got["status"] == 200
            yield self._feed(url, wanted), at, got["body"] if good else None, "" if good else f"{got['status']} {got['reason']}".strip()

    @staticmethod
    def _dealt(url: str, partition: Feeds) -> bool:
        return partition.n == 1 or zlib.crc32(url.encode()) % partition.n == partition.k


class PollSource(DataSource):
    """format("feedpolls"), streaming: polls of feeds for streaming.feeds.poll_batches.

    Options: feeds, a file with a url on each line; responses, a folder of captured responses; interval in seconds; requests, a folder in which a refresh is asked for by a file <seconds>.request;
    concurrency, the tasks of a refresh; clock, a file that holds the time, for tests and for replays; pages, the query parameter by which long feeds are paged (RFC 5005): captured documents <feed>?<pages>=<number>
    are answers to a poll of the feed too, a row each, and documents rather than feeds are dealt to the tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "feedpolls"

    def schema(self) -> str:
        return POLL

    def streamReader(self, schema: StructType) -> PollReader:  # noqa: N802
        return PollReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, with filters handed down to sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(PollSource)


def ask(requests: str, at: float) -> None:
    """Asks for a refresh: RefreshNow."""
    files, root = folder(requests)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{at!r}.request") as f:
        f.write(json.dumps({"at": at}).encode())
