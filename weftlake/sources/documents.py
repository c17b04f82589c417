"""One document written and read by many tasks: each writes its part, and the commit joins the parts in order; each reads a stretch of it, from the outlines that are open where it begins."""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weftlake.sources.archive import folder

#: Bytes that the commit copies at once.
COPY = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


class DocumentWriter(DataSourceWriter):
    """Rows (line) of a frame that is sorted as a whole; parts stand in the order of their partitions. Until the commit has the whole document under a name of its own, the former one stays."""

    def __init__(self, path: str, head: str, tail: str):
        self.path, self.head, self.tail, self.run = path, head, tail, uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str, str]:
        files, path = folder(self.path)
        return files, path.rpartition("/")[0] or ".", path.rpartition("/")[2]

    def write(self, iterator) -> Part:
        files, root, name = self._place()
        files.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        part = f"_{name}-{self.run}-{number}-{uuid.uuid4().hex[:8]}"  # an attempt that is repeated writes a part of its own
        with files.open_output_stream(f"{root}/{part}", compression=None) as f:
            for row in iterator:
                f.write(f"{row.line}\n".encode())
        return Part(number, part)

    def commit(self, messages) -> None:
        files, root, name = self._place()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        whole = f"{root}/_{name}-{self.run}"
        with files.open_output_stream(whole, compression=None) as out:
            out.write(self.head.encode())
            for m in parts:
                with files.open_input_stream(f"{root}/{m.name}", compression=None) as f:
                    while data := f.read(COPY):
                        out.write(data)
            out.write(self.tail.encode())
        files.move(whole, f"{root}/{name}")
        self._clear(parts)

    def abort(self, messages) -> None:
        self._clear([m for m in messages if m is not None])

    def _clear(self, parts: list[Part]) -> None:
        files, root, _ = self._place()
        for m in parts:
            if files.get_file_info(f"{root}/{m.name}").type != pafs.FileType.NotFound:
                files.delete_file(f"{root}/{m.name}")


class DocumentSource(DataSource):
    """format("document"), for writing: options path, head and tail, the texts before and after the rows."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options.get("head", ""), self.options.get("tail", ""))


def save_lines(lines: DataFrame, path: str, order: list[str], head: str = "", tail: str = "") -> None:
    """Writes the column line of a frame in an order of columns as one text; a line that is null is left out. What passes through one place is the copy of the parts, not the rows."""
    lines.sparkSession.dataSource.register(DocumentSource)
    rows = lines.where("line is not null").orderBy(*order).select("line")
    rows.write.format("document").mode("append").option("path", path).option("head", head).option("tail", tail).save()


def attribute(c: Column) -> Column:
    """A value as an XML attribute in double quotes."""
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def save_opml(feeds: DataFrame, path: str, title: str, created: str = "") -> None:
    """Feeds (url, title, site_url, category) as one OPML file: uncategorised ones first, then categories in order, feeds by title and url. Null texts are empty. As write_opml(), for any number of feeds."""
    from html import escape

    category = F.coalesce("category", F.lit(""))
    own = F.concat(F.lit("      "), F.lit('<outline type="rss" text='), attribute(F.col("title")), F.lit(" title="), attribute(F.col("title")), F.lit(" xmlUrl="), attribute(F.col("url")))
    site = F.when(F.coalesce("site_url", F.lit("")) != "", F.concat(F.lit(" htmlUrl="), attribute(F.col("site_url")))).otherwise("")
    keys = [category.alias("c"), F.lit(1).alias("part"), F.coalesce("title", F.lit("")).alias("t"), F.coalesce("url", F.lit("")).alias("u")]
    rows = feeds.select(*keys, F.concat(own, site, F.lit("/>")).alias("line"))
    groups = feeds.select(category.alias("c")).where("c <> ''").distinct()
    begin = groups.select("c", F.lit(0).alias("part"), F.lit("").alias("t"), F.lit("").alias("u"), F.concat(F.lit("    <outline text="), attribute(F.col("c")), F.lit(" title="), attribute(F.col("c")), F.lit(">")).alias("line"))
    end = groups.select("c", F.lit(2).alias("part"), F.lit("").alias("t"), F.lit("").alias("u"), F.lit("    </outline>").alias("line"))
    dated = f"    <dateCreated>{escape(created)}</dateCreated>\n" if created else ""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>{escape(title)}</title>\n{dated}  </head>\n  <body>\n'
    save_lines(rows.unionByName(begin).unionByName(end), path, ["c", "part", "t", "u"], head, "  </body>\n</opml>\n")


# ---- reading ------------------------------------------------------------------------------------

#: Rows of a batch that a reading task hands on.
ROWS = 2048
_FOUND = pa.schema([("ord", pa.int32()), *[(c, pa.string()) for c in ("url", "title", "site_url", "category")]])
_EFFECT = pa.schema([("start", pa.int64()), ("closed", pa.int64()), ("opened", pa.list_(pa.string())), ("feeds", pa.int64())])


def _tags(batches) -> Iterator[tuple[int, bool, dict | None, bool]]:
    """(start of the stretch, closes, attributes, stays open) of each outline tag, from the texts before each '>'."""
    for batch in batches:
        for source, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tag = source[source.rfind("<") :]
            if tag.startswith("</outline") and not tag[9:].strip():
                yield start, True, None, False
            elif tag.startswith("<outline") and (len(tag) == 8 or tag[8] in " \t\r\n/"):
                whole = tag.endswith("/")
                yield start, False, ET.fromstring(tag + (">" if whole else "/>")).attrib, not whole


def _inner(attrs: dict) -> str:
    return attrs.get("text") or attrs.get("title") or ""


def _effects(batches):
    """What each stretch does to the outlines that are open: how many from before it it closes, the names of those it leaves open, and its feeds."""
    out: dict[int, list] = {}
    for start, closes, attrs, stays in _tags(batches):
        mine = out.setdefault(start, [0, [], 0])
        if closes:
            if mine[1]:
                mine[1].pop()
            else:
                mine[0] += 1
            continue
        mine[2] += bool(attrs.get("xmlUrl"))
        if stays:
            mine[1].append(_inner(attrs))
    yield pa.RecordBatch.from_pylist([{"start": s, "closed": c, "opened": o, "feeds": n} for s, (c, o, n) in out.items()], schema=_EFFECT)


def opml_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url, title, site_url, category) of one OPML file of any size, as read_opml() of its text: tasks read stretches of the file.

    Two passes: what each stretch does to the open outlines comes to the driver, a row for each stretch, and says which are open where the next begins and how many feeds came before. The file must be as
    save_opml() writes it: '>' ends tags and stands in no value, and no comment holds an outline. A tag that is no XML raises.
    """
    tags = spark.read.option("lineSep", ">").text(path).select("value", F.col("_metadata.file_block_start").alias("start"))
    open_, before, begins = [], 0, {}
    for r in sorted(tags.mapInArrow(_effects, "start long, closed long, opened array<string>, feeds long").collect(), key=lambda r: r.start):
        begins[r.start] = (tuple(open_), before)
        open_ = open_[: max(0, len(open_) - r.closed)] + list(r.opened)
        before += r.feeds

    def found(batches) -> Iterator[dict]:
        held, ord_, at = [], 0, None
        for start, closes, attrs, stays in _tags(batches):
            if start != at:
                at, held, ord_ = start, list(begins[start][0]), begins[start][1]
            if closes:
                if held:
                    held.pop()
                continue
            if attrs.get("xmlUrl"):
                yield {"ord": ord_, "url": attrs["xmlUrl"], "title": attrs.get("title") or attrs.get("text") or "", "site_url": attrs.get("htmlUrl") or "", "category": "/".join(x for x in held if x)}
                ord_ += 1
            if stays:
                held.append(_inner(attrs))

    def run(batches):
        held: list[dict] = []
        for row in found(batches):
            held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=_FOUND)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_FOUND)

    return tags.mapInArrow(run, "ord int, url string, title string, site_url string, category string")
