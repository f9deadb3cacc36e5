"""WARC archives with a two-level capture index (operator 6).

Writing: every page becomes one record, each its own gzip member.  Of pages with
equal payloads of 100 bytes or more the one with the smallest id is written in
full (response); the others are revisits that refer to it.  Pages are range
partitioned by reversed-host URL key and id, so a hot host is spread over many
partitions; each partition writes a shard: the archive, the index blocks (a run
of sorted keys with offset and length, compressed) and the sparse directory
(first key, offset and length of every block).

Reading: a key is found by binary search over the shards' first keys, then over a
shard's directory; one block is decompressed, searched, and the record is read
by its byte range.  Neighbouring keys share blocks and read-ahead.

A task names its files by attempt and its result row names the files, so a lost or
repeated task leaves at most unused files; the rows are written to the shared
folder before anything is read back.

Edges: a null html is an empty payload; a null URL has an empty key; payloads under
100 bytes are all responses; pages that share the smallest id of a group are all
responses, and so are pages without an id if no member of their group has one;
repeated rows are records of their own; further columns are left out; an empty table
gives no archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import broadcast_if_small, map_arrow, materialize, own_dir, table

BLOCK_ENTRIES, READ_AHEAD, CACHED_BLOCKS, CACHED_PAYLOADS = 256, 1 << 20, 16, 256
LEAST_SHARED = 100  # bytes from which equal payloads are written once
DATE = "2024-01-01T00:00:00Z"  # the table has no capture time


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL: host parts reversed and lower-cased, then the rest as it is,
    but for control characters, which an index line can't hold."""
    url = F.coalesce(url, F.lit(""))
    host, rest = F.regexp_extract(url, r"://([^/?#]*)", 1), F.regexp_extract(url, r"(?s)://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(F.when(url.contains("://"), key).otherwise(url), r"[\x00-\x1f\x7f]", "%")


def _store(uri: str):
    """(file system, path) of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _plain(s: str | None) -> str:
    """A header value: line ends and other control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in s or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str] | None) -> bytes:
    name = "none" if page_id is None else page_id
    head = [f"WARC-Target-URI: {_plain(url)}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers:
        head += ["WARC-Type: revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers[0]}>", f"WARC-Refers-To-Key: {_plain(refers[1])}"]
        block = http
    else:
        head.append("WARC-Type: response")
        block = http + payload
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _order(page_id: int | None) -> tuple[bool, int]:
    """Null ids come first."""
    return (page_id is not None, page_id or 0)


class ShardWriter:
    """Archive, index blocks and directory of one shard; entries must come in order."""

    def __init__(self, folder: str):
        self.store, path = _store(folder)
        self.store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        self.names = {k: f"{path}/{name}.{k}" for k in ("warc.gz", "blocks", "directory")}
        self.files = {k: self.store.open_output_stream(n, compression=None) for k, n in self.names.items()}
        self.at, self.block_at, self.entries, self.directory, self.n = 0, 0, [], [], 0

    def add(self, key: str, page_id: int | None, raw: bytes) -> None:
        member = gzip.compress(raw, 1, mtime=0)
        self.files["warc.gz"].write(member)
        self.entries.append((key, page_id, self.at, len(member)))
        self.at += len(member)
        self.n += 1
        if len(self.entries) == BLOCK_ENTRIES:
            self._end_block()

    def _end_block(self) -> None:
        if self.entries:
            lines = "\n".join(f"{'' if i is None else i} {at} {size} {_plain(key)}" for key, i, at, size in self.entries)
            raw = zlib.compress(lines.encode("utf-8", "surrogatepass"), 6)
            self.files["blocks"].write(raw)
            self.directory.append((self.entries[0][0], self.entries[0][1], self.block_at, len(raw)))
            self.block_at += len(raw)
            self.entries = []

    def close(self) -> dict[str, str]:
        self._end_block()
        self.files["directory"].write(pack(self.directory))
        for f in self.files.values():
            f.close()
        return self.names


class Captures:
    """The index over all shards, and range reads through it."""

    def __init__(self, folder: str, shards: list[tuple[str, int | None, str, str, str]]):
        """``shards``: first key, first id, and the files of archive, blocks and directory, in order."""
        self.store, _ = _store(folder)
        self.shards = shards
        self.firsts = [(k, _order(i)) for k, i, *_ in shards]
        self.directories: OrderedDict[int, tuple[list, list]] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], tuple[list, list]] = OrderedDict()
        self.files: OrderedDict[str, object] = OrderedDict()
        self.ahead = ("", 0, b"")

    def _file(self, name: str):
        if name not in self.files:
            if len(self.files) >= 16:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.store.open_input_file(name)
        return self.files[name]

    def _directory(self, s: int) -> tuple[list, list]:
        if s not in self.directories:
            if len(self.directories) >= 64:
                self.directories.popitem(last=False)
            f = self._file(self.shards[s][4])
            f.seek(0)
            rows = unpack(f.read())
            self.directories[s] = ([(k, _order(i)) for k, i, _, _ in rows], rows)
        return self.directories[s]

    def _block(self, s: int, b: int) -> tuple[list, list]:
        if (s, b) not in self.blocks:
            if len(self.blocks) >= CACHED_BLOCKS:
                self.blocks.popitem(last=False)
            _, _, at, size = self._directory(s)[1][b]
            f = self._file(self.shards[s][3])
            f.seek(at)
            rows = []
            for line in zlib.decompress(f.read(size)).decode("utf-8", "surrogatepass").split("\n"):
                i, offset, length, key = line.split(" ", 3)
                rows.append((key, int(i) if i else None, int(offset), int(length)))
            self.blocks[s, b] = ([(k, _order(i)) for k, i, _, _ in rows], rows)
        return self.blocks[s, b]

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[int, int, int]]:
        """(shard, offset, length) of every record of a key and id: binary searches, then the entries on from there."""
        want = (_plain(key), _order(page_id))
        s = max(0, bisect_right(self.firsts, (want[0], (want[1][0], want[1][1] - 1))) - 1)
        while s < len(self.shards) and self.firsts[s] <= want:
            keys, rows = self._directory(s)
            b = max(0, bisect_right(keys, (want[0], (want[1][0], want[1][1] - 1))) - 1)
            while b < len(rows) and keys[b] <= want:
                own, entries = self._block(s, b)
                e = bisect_right(own, (want[0], (want[1][0], want[1][1] - 1)))
                while e < len(own) and own[e] == want:
                    yield s, entries[e][2], entries[e][3]
                    e += 1
                b += 1
            s += 1

    def read(self, s: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
        name, begin, held = self.ahead
        path = self.shards[s][2]
        if name != path or at < begin or at + size > begin + len(held):
            f = self._file(path)
            f.seek(at)
            self.ahead = path, at, f.read(max(size, READ_AHEAD))
            begin, held = at, self.ahead[2]
        return parse(gzip.decompress(held[at - begin : at - begin + size]))


def pack(rows: list[tuple]) -> bytes:
    return zlib.compress("\n".join(f"{'' if i is None else i} {at} {size} {_plain(key)}" for key, i, at, size in rows).encode("utf-8", "surrogatepass"), 6)


def unpack(raw: bytes) -> list[tuple]:
    rows = []
    for line in zlib.decompress(raw).decode("utf-8", "surrogatepass").split("\n"):
        i, at, size, key = line.split(" ", 3)
        rows.append((key, int(i) if i else None, int(at), int(size)))
    return rows


def _planned(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, html, digest, first_id, first_key): the payload's digest and, for shared payloads, its response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.where(F.octet_length("html") >= LEAST_SHARED)
    groups = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key"))).alias("first")).where("n > 1 and first is not null")
    groups = materialize(pages.sparkSession, groups.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key")), "payloads")
    return rows.join(broadcast_if_small(groups), "digest", "left")


def write(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) under ``folder``; one row per shard."""
    rows = _planned(pages).select("key", "page_id", "url", "html", "digest", "first_id", "first_key")
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first = None, None
        for batch in batches:
            key, page_id, url, html, digest, first_id, first_key = (batch.column(i) for i in range(7))
            ids, firsts, keys, digests, urls, first_keys = page_id.to_pylist(), first_id.to_pylist(), key.to_pylist(), digest.to_pylist(), url.to_pylist(), first_key.to_pylist()
            for k in range(batch.num_rows):
                if writer is None:
                    writer, first = ShardWriter(folder), (keys[k], ids[k])
                revisit = firsts[k] is not None and ids[k] != firsts[k]
                payload = html[k].as_py().encode("utf-8", "surrogatepass")
                writer.add(keys[k], ids[k], record(ids[k], urls[k], payload, digests[k], (firsts[k], first_keys[k]) if revisit else None))
        if writer:
            names = writer.close()
            yield pa.RecordBatch.from_pydict({"first_key": pa.array([first[0]]), "first_id": pa.array([first[1]], pa.int64()), "n": pa.array([writer.n], pa.int64()), "archive": pa.array([names["warc.gz"]]), "blocks": pa.array([names["blocks"]]), "directory": pa.array([names["directory"]])})

    return materialize(spark, map_arrow(rows, run, "first_key string, first_id long, n long, archive string, blocks string, directory string"), "shards")


def read(spark: SparkSession, shards: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Records of the distinct (key, page_id) pairs of ``wanted``, found through the index.

    What is collected and broadcast, sorted by first key, is one short row for each shard,
    of which there are as many as shuffle partitions; directories are read where they are needed."""
    ordered = [(_plain(r.first_key), r.first_id, r.archive, r.blocks, r.directory) for r in shards.collect()]
    ordered.sort(key=lambda x: (x[0], _order(x[1])))
    shipped = spark.sparkContext.broadcast(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures, payloads = Captures(folder, shipped.value), OrderedDict()

        def of_response(page_id: int, key: str) -> tuple[int, str]:
            if page_id not in payloads:
                if len(payloads) >= CACHED_PAYLOADS:
                    payloads.popitem(last=False)
                for at in captures.find(key, page_id):
                    fields, body = captures.read(*at)
                    if fields["warc-type"] == "response":
                        payloads[page_id] = len(body), hashlib.sha256(body).hexdigest()
                        break
                else:
                    raise ValueError(f"no response of page {page_id}")
            return payloads[page_id]

        for batch in batches:
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in list(captures.find(key, page_id)):
                    fields, body = captures.read(*at)
                    refers = None
                    if fields["warc-type"] == "revisit":
                        refers = int(fields["warc-refers-to"][len("<urn:page:") : -1])
                        size, digest = of_response(refers, fields["warc-refers-to-key"])
                    else:
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                    if fields["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"the payload of page {page_id} doesn't have its digest")
                    name = fields["warc-record-id"][len("<urn:page:") : -1]
                    out.append((None if name == "none" else int(name), size, digest, fields["warc-type"], refers))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wanted = wanted.select("key", "page_id").distinct()
    wanted = wanted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "page_id").sortWithinPartitions("key", "page_id")
    return map_arrow(wanted, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = own_dir(spark, "warc")
    shards = write(spark, pages, folder)
    return read(spark, shards, pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id")), folder)
