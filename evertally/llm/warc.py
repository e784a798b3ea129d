"""Web archives with a two-level capture index.

Every task writes the records of its rows into one archive file, each record a gzip member of its own, so that a record
can be read by its offset and length alone. Captures are sorted by URL key (host reversed, then path) into blocks of
index lines, each block a gzip member; the directory holds the first key, file, offset and length of each block. A
lookup searches the sparse directories by bisection, reads the blocks they point at, and then ranges of the archives.

A file belongs to one attempt of one task, and the written capture list names the file of each record, so a repeated task
leaves at most a file that nothing names. Archives lie in the shared folder, read and written through its own file system.

Records: of those with equal payloads of at least `min_bytes` bytes, the ones with the smallest page id are responses,
and the others are revisits without the payload; smaller payloads are always responses.

Defined results: a null html is an empty payload; a null URL is the empty URL, of key ")/"; a null page id comes after all
others; rows that repeat a page id are separate records; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally.llm.tables import small_side, written
from evertally.session import fresh_folder

#: Captures per index block.
BLOCK_LINES = 1000
#: Records closer than this in an archive are read in one range.
GAP_BYTES = 1 << 16
READ_BYTES = 1 << 22
#: Bytes of archives for each task that reads them back.
TASK_BYTES = 1 << 23
#: Of compression: 6 takes half as long again and saves a fortieth of the size.
LEVEL = 3
ASCII_SIGNS = string.punctuation
RANGES = "file string, offset bigint, length bigint"
FIGURES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
DIRECTORY = "file string, first_key string, last_key string, offset bigint, length bigint, n_lines bigint"
CAPTURES = (
    "url_key string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "file string, offset bigint, length bigint"
)


def url_key(url: str | None) -> str:
    """Host labels in reverse, a closing bracket, then the rest; scheme, user, `www.` and a standard port are dropped."""
    rest = (url or "").strip().lower()
    scheme, found, after = rest.partition("://")
    if found:
        rest = after
    rest = rest.partition("#")[0]
    cut = min((at for at in (rest.find(c) for c in "/?") if at >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2], rest[cut:]
    for port in ((":443",) if scheme == "https" else (":80",)):
        host = host.removesuffix(port)
    host = host.removeprefix("www.")
    # ASCII without spaces: index lines are split at spaces, and keys sort as bytes
    return quote(",".join(reversed(host.split("."))) + ")" + (path or "/"), safe=ASCII_SIGNS)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: str) -> str:
    """A value that stays on its line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_bytes(url: str, page_id: int | None, kind: str, refers_to: int | None, payload: bytes, digest: str) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "response":
        body += payload
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{identity}>",
        "WARC-Date: 1970-01-01T00:00:00Z",  # the rows have no time
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    @classmethod
    def parse(cls, data: bytes) -> Record:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        body = rest[: int(headers["Content-Length"])]
        if version != "WARC/1.1" or len(body) != int(headers["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
            raise ValueError("not a whole record")
        return cls(headers, body.partition(b"\r\n\r\n")[2])


def packed(data: bytes) -> bytes:
    worker = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return worker.compress(data) + worker.flush()


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


class Store:
    """Files under a folder, on whatever file system it is."""

    def __init__(self, folder: str):
        address = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")
        self.files, self.path = fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")

    def create(self, name: str):
        self.files.create_dir(self.path, recursive=True)
        return self.files.open_output_stream(f"{self.path}/{name}", compression=None)

    def open(self, name: str):
        return self.files.open_input_file(f"{self.path}/{name}")

    def read(self, name: str, offset: int, length: int) -> bytes:
        with self.open(name) as file:
            file.seek(offset)
            return file.read(length)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, file, name, offset = Store(folder), None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                lines = []
                for row in batch.to_pylist():
                    if file is None:
                        file = store.create(name)
                    payload = (row["html"] or "").encode()
                    kind = "revisit" if row["revisit"] else "response"
                    refers_to = row["first"] if row["revisit"] else None
                    digest, url = base32_sha1(payload), row["url"] or ""
                    member = packed(record_bytes(url, row["page_id"], kind, refers_to, payload, digest))
                    file.write(member)
                    lines.append((url_key(url), row["page_id"], kind, refers_to, len(payload), digest, name, offset, len(member)))
                    offset += len(member)
                yield _batch(lines, CAPTURES)
        finally:
            if file is not None:
                file.close()

    return write


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    kinds = [pa.int64() if kind == "bigint" else pa.string() for _, kind in fields]
    arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _index_writer(folder: str):
    """Blocks of index lines in one file per task, and beside it the directory of its blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, file, name, offset = Store(folder), None, f"{uuid.uuid4().hex}.idx.gz", 0
        pending: list[tuple[str, str]] = []
        directory: list[tuple] = []

        def flush() -> None:
            nonlocal file, offset
            if file is None:
                file = store.create(name)
            block = packed("".join(line for _, line in pending).encode())
            file.write(block)
            directory.append((name, pending[0][0], pending[-1][0], offset, len(block), len(pending)))
            offset += len(block)
            pending.clear()

        for batch in batches:
            for row in batch.to_pylist():
                fields = ("url_key", "file", "offset", "length", "record_type", "payload_digest")
                pending.append((row["url_key"], " ".join(str(row[f]) for f in fields) + "\n"))
                if len(pending) == BLOCK_LINES:
                    flush()
        if pending:
            flush()
        if file is not None:
            file.close()
            with store.create(f"{name}.dir") as beside:
                beside.write(packed("".join(f"{key} {at} {size}\n" for _, key, _, at, size, _ in directory).encode()))
        yield _batch(directory, DIRECTORY)

    return write


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html with `revisit`, and `first`, the smallest page id of an equal payload."""
    rows = pages.select("page_id", "url", "html").withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"))).alias("first")
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.select(F.col("digest").alias("same"), F.col("first.page_id").alias("first")), "originals")
    rows = rows.join(small_side(groups, groups.count()), (F.col("digest") == F.col("same")) & (F.col("size") >= min_bytes), "left")
    revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # a revisit needs its payload's figures only, but both come from the payload itself
    return rows.select("page_id", "url", "html", revisit.alias("revisit"), "first")


@dataclass
class Archive:
    """Written archives: the captures, and the directory of the index blocks, as tables."""

    spark: SparkSession
    folder: str
    captures: DataFrame
    directory: DataFrame

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> Archive:
        spark = pages.sparkSession
        folder = folder or fresh_folder(spark, "warc")
        captures = written(with_originals(pages, min_bytes).mapInArrow(_writer(folder), CAPTURES), "captures")
        # the page id parts captures of one URL, so a hot host or URL spreads over the ranges
        in_order = captures.repartitionByRange("url_key", "page_id", "file", "offset")
        in_order = in_order.sortWithinPartitions("url_key", "page_id", "file", "offset")
        return cls(spark, folder, captures, written(in_order.mapInArrow(_index_writer(folder), DIRECTORY), "directory"))

    def blocks_of(self, keys: DataFrame) -> DataFrame:
        """(key, file, offset, length) of the index blocks that can hold a capture of each `key`.

        Each task knows the key range of every index file (one row per file), and searches the directories of those that
        can hold a key; no block is read.
        """
        files = self.directory.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
        files = sorted((r["low"], r["high"], r["file"]) for r in files.collect())
        wanted = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
        return wanted.mapInArrow(_searcher(self.folder, files), f"key string, {RANGES}")

    def found(self, keys: DataFrame) -> DataFrame:
        """(key, file, offset, length) of all captures of the given keys.

        A block is read once, with all keys that may lie in it; the blocks of a key with many captures are many tasks' work.
        """
        blocks = self.blocks_of(keys).repartition(self._tasks(), "file", "offset")
        blocks = blocks.sortWithinPartitions("file", "offset", "key")
        return blocks.mapInArrow(_block_reader(self.folder), f"key string, {RANGES}")

    def lookup(self, urls: DataFrame) -> DataFrame:
        """(url, file, offset, length) of all captures of the given URLs; URLs of equal keys have the same captures."""
        wanted = with_keys(urls.select("url").distinct())
        return wanted.join(self.found(wanted), "key").select("url", "file", "offset", "length")

    def records(self, ranges: DataFrame) -> DataFrame:
        """The records at (file, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
        ranges = ranges.select("file", "offset", "length").withColumn("part", F.floor(F.col("offset") / READ_BYTES))
        ranges = ranges.repartition(self._tasks(), "file", "part").sortWithinPartitions("file", "offset")
        return ranges.mapInArrow(_record_reader(self.folder), FIGURES)

    def _tasks(self) -> int:
        """Read tasks, by the bytes of the archives; the sizes of their ranges say nothing of the work."""
        size = self.captures.agg(F.sum("length")).first()[0] or 0
        return max(1, -(-size // TASK_BYTES))


def with_keys(urls: DataFrame) -> DataFrame:
    """Adds the `key` of each `url`."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([url_key(url) for url in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("url"), keys], ["url", "key"])

    return urls.select("url").mapInArrow(keyed, "url string, key string")


def _index_lines(store: Store, name: str, offset: int, length: int) -> list[list[str]]:
    return [line.split(" ") for line in unpacked(store.read(name, offset, length)).decode().split("\n")[:-1]]


def _block_reader(folder: str):
    """The captures of the wanted keys; blocks come in order, each with its keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = Store(folder), None
        captures: dict[str, list[tuple[str, int, int]]] = {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if at != (row["file"], row["offset"]):
                    at, captures = (row["file"], row["offset"]), {}
                    for key, file, offset, length, *_ in _index_lines(store, *at, row["length"]):
                        captures.setdefault(key, []).append((file, int(offset), int(length)))
                found += [(row["key"], *place) for place in captures.get(row["key"], ())]
            yield _batch(found, f"key string, {RANGES}")

    return read


def _searcher(folder: str, files: list[tuple[str, str, str]]):
    """`files`: lowest and highest key of every index file, sorted."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        opened: tuple[str, list] = ("", [])  # keys come in order, so one directory at a time is enough
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                last = bisect.bisect_right(files, key, key=lambda f: f[0])
                first = last
                while first and files[first - 1][1] >= key:
                    first -= 1
                for _, _, name in files[first:last]:
                    if opened[0] != name:
                        with store.open(f"{name}.dir") as beside:
                            lines = unpacked(beside.read()).decode().split("\n")[:-1]
                        opened = name, [line.split(" ") for line in lines]
                    found += [(key, name, *block) for block in _blocks_with(opened[1], key)]
            yield _batch(found, f"key string, {RANGES}")

    return search


def _blocks_with(blocks: list[list[str]], key: str) -> Iterator[tuple[int, int]]:
    # captures of one key may start in the block before the first block that starts with it
    at = max(bisect.bisect_left(blocks, key, key=lambda block: block[0]) - 1, 0)
    while at < len(blocks) and blocks[at][0] <= key:
        yield int(blocks[at][1]), int(blocks[at][2])
        at += 1


def _together(rows: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring records of one file that one range read covers."""
    group: list[dict] = []
    for row in rows:
        if group:
            end = group[-1]["offset"] + group[-1]["length"]
            near = row["file"] == group[0]["file"] and end <= row["offset"] <= end + GAP_BYTES
            if not near or row["offset"] + row["length"] - group[0]["offset"] > READ_BYTES:
                yield group
                group = []
        group.append(row)
    if group:
        yield group


def _record_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            found = []
            for group in _together(batch.to_pylist()):
                start = group[0]["offset"]
                data = store.read(group[0]["file"], start, group[-1]["offset"] + group[-1]["length"] - start)
                for row in group:
                    at = row["offset"] - start
                    found.append(_figures(Record.parse(unpacked(data[at : at + row["length"]]))))
            yield _batch(found, FIGURES)

    return read


def _figures(record: Record) -> tuple:
    headers = record.headers
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    page_id, refers_to = (int(headers[h]) if h in headers else None for h in ("X-Page-ID", "X-Refers-To-Page-ID"))
    size = int(headers["X-Payload-Length"])
    if kind == "response" and (len(record.payload), base32_sha1(record.payload)) != (size, digest):
        raise ValueError(f"the payload of page {page_id} is not what its record says")
    return page_id, size, digest, kind, refers_to, headers["WARC-Target-URI"]


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes the pages, looks the keys of their URLs up, and returns what the archives hold for each."""
    archive = Archive.write(pages)
    records = archive.records(archive.found(with_keys(pages.select("url").distinct())))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
