"""WARC archives with a two-level capture index.

Pages are ordered by their reversed-host URL key (SURT) with a range partitioning that splits even one host over many tasks.
Each task streams its pages into one archive of gzip members and, beside it, compressed blocks of sorted index lines; what it
returns is the sparse directory, one row per block (first and last key, place of the block and of its records).

A look-up takes a table of keys. The key ranges of the archives, one row for each write task, are broadcast and bisected for
the archives that may hold a key; keys and directory rows of one archive meet in a task, where the directory is bisected for
the blocks, a block's byte range is read and its lines are bisected, and neighbouring records come by one range read.

Of pages with equal payloads the one with the largest id is the response; the others are revisit records that refer to it
and carry no payload. The payload's length and digest stand in the header of either. Files are written through pyarrow's file
systems into the shared folder under a name of the task attempt; paths are qualified on the driver by Hadoop's file system, so
a path without a scheme is one of the default file system. The directory, which is materialised, names only files of attempts
that succeeded, so retries and lost executors leave nothing but unreferenced files.

Edge cases: a null html is an empty payload (equal to other empty ones); a null url has the empty key; repeated rows (equal
id and payload) are one response and revisits that refer to it, by the first of them in page order; an empty table gives an
empty directory; null and repeated keys are looked up once, absent ones give no row.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, join_by_share, materialise, new_path

#: Index lines in a block, and level of the gzip members.
BLOCK_LINES = 512
LEVEL = 4
#: Bytes of neighbouring records that are read at once.
READ = 4 << 20
DATE = "1970-01-01T00:00:00Z"


#: Host, and path with query, of a URL; the key leaves out scheme, user, port and fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"
REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed and comma-joined, a closing parenthesis, path and query."""
    url = url or ""
    m = re.match(HOST, url)
    host = m[1].lower().removeprefix("www.") if m else ""
    return ",".join(reversed(host.split("."))) + ")" + re.match(REST, url)[1] if host else url


def surt_column(url):
    """surt as a Column expression, without the characters that part index lines."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, HOST, 1)), r"^www\.", "")
    return _line_column(F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(u, REST, 1))))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return re.sub(r"[\r\n\t\x00]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, sha: str, size: int, refers_to) -> bytes:
    """One WARC record."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _page(value: str) -> int | None:
    text = value.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop gives it: one without a scheme belongs to the default file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system, and the path in it, for a qualified path; Hadoop's names of schemes are translated."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?=[^/])", "file:///", uri)))


DIRECTORY = "first_key string, last_key string, records long, archive string, index string, at long, size long, start long, stop long"


def _writer(folder: str):
    def run(batches):
        fs, base = open_path(folder)
        name = f"part-{uuid.uuid4().hex}"
        archive, index = f"{folder}/{name}.warc.gz", f"{folder}/{name}.cdx.gz"
        out = cdx = None
        offset = at = start = 0
        lines: list[str] = []
        verdict, leads = None, False

        def block():
            nonlocal at, start, lines
            packed = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), LEVEL, mtime=0)
            cdx.write(packed)
            keys = [x.partition("\t")[0] for x in (lines[0], lines[-1])]
            row = (*keys, len(lines), archive, index, at, len(packed), start, offset)
            at, start, lines = at + len(packed), offset, []
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], DIRECTORY.replace(",", "").split()[::2])

        for b in batches:
            for key, page_id, sha, t, url, html, response, lead in zip(*(c.to_pylist() for c in b.columns)):
                if t == 0:
                    verdict, leads = (key, page_id, sha, response), lead
                    continue
                refers_to = None
                if verdict and verdict[:3] == (key, page_id, sha):
                    refers_to, leads = (None, False) if leads else (verdict[3], False)
                payload = html.encode("utf-8", "surrogatepass")
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, cdx = (fs.open_output_stream(f"{base}/{name}.{x}.gz", compression=None) for x in ("warc", "cdx"))
                member = gzip.compress(record(page_id, url, payload, sha, len(payload), refers_to), LEVEL, mtime=0)
                out.write(member)
                lines.append(f"{key}\t{'' if page_id is None else page_id}\t{offset}\t{len(member)}\t{sha}")
                offset += len(member)
                if len(lines) >= BLOCK_LINES:
                    yield block()
        if lines:
            yield block()
        if out is not None:
            out.close()
            cdx.close()

    return run


def base32(hex40):
    """Base-32 text of a SHA-1 given as 40 hex digits: 40 bits, eight digits, at a time."""
    digits = [F.translate(F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for i in range(4)]
    return F.concat(*digits)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes the archives and their index blocks; returns the (materialised) directory."""
    spark = pages.sparkSession
    batched(spark)
    folder = qualified(spark, folder or new_path(spark, "warc"))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    src = src.select(surt_column(F.col("url")).alias("key"), "id", F.upper(F.sha1(F.col("html").cast("binary"))).alias("sha"), "url", "html")
    keys = materialise(src.select("key", "id", "sha"), "payloads")
    total = max(1, keys.count())
    groups = keys.groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("response")).filter("n > 1 AND response IS NOT NULL")
    groups = materialise(groups, "copies")
    leads = keys.join(groups.select("sha", F.col("response").alias("id")), ["sha", "id"]).groupBy("sha").agg(F.min("key").alias("lead"))
    decided = join_by_share(keys, groups.join(leads, "sha"), "sha", "n", total).distinct()
    # texts are shuffled once: what was decided about a row is dealt to the same task and sorts before it
    none = F.lit(None)
    verdicts = decided.select(
        "key", "id", "sha", F.lit(0).alias("t"), none.cast("string").alias("url"), none.cast("string").alias("html"), "response",
        (F.col("id").eqNullSafe(F.col("response")) & (F.col("key") == F.col("lead"))).alias("lead"),
    )
    texts = src.select("key", "id", "sha", F.lit(1).alias("t"), "url", "html", none.cast("long").alias("response"), none.cast("boolean").alias("lead"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = verdicts.unionByName(texts).withColumn("sha", base32("sha"))
    rows = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id", "sha", "t")
    return materialise(rows.mapInArrow(_writer(folder), DIRECTORY), "directory")


def read_block(row) -> list[list[str]]:
    """The index lines of a directory row: [key, page id, offset, length, digest], sorted by key."""
    fs, path = open_path(row["index"])
    with fs.open_input_file(path) as f:
        return [x.split("\t") for x in gzip.decompress(f.read_at(row["size"], row["at"])).decode("utf-8", "surrogatepass").split("\n")]


SCHEMA = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Archive:
    """One archive: its directory rows in key order, bisected for the blocks of ascending keys."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["at"])
        self.first, self.last = ([r[k] for r in self.rows] for k in ("first_key", "last_key"))
        self.block = self.lines = self.keys = None
        self.base, self.held = 0, b""
        #: Blocks read, and records found.
        self.reads = self.found = 0
        fs, path = open_path(rows[0]["archive"])
        self.file = fs.open_input_file(path)

    def captures(self, key: str):
        """(headers, block of the record) of the captures of a key, in page order."""
        for i in range(bisect.bisect_left(self.last, key), bisect.bisect_right(self.first, key)):
            if self.block != i:
                self.block, self.lines = i, read_block(self.rows[i])
                self.keys = [x[0] for x in self.lines]
                self.reads += 1
            for line in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                self.found += 1
                yield self._record(line, self.rows[i]["stop"])

    def _record(self, line: list[str], stop: int) -> tuple[dict[str, str], bytes]:
        _, page, offset, length, sha = line
        offset, length = int(offset), int(length)
        if offset < self.base or offset + length > self.base + len(self.held):
            self.base, self.held = offset, self.file.read_at(max(length, min(READ, stop - offset)), offset)
        headers, block = parse(zlib.decompress(self.held[offset - self.base : offset - self.base + length], 31))
        found = headers["warc-payload-digest"].removeprefix("sha1:")
        response = headers["warc-type"] == "response"
        if found != sha or (response and digest(block) != sha) or _page(headers["warc-record-id"]) != (int(page) if page else None):
            raise ValueError(f"{self.rows[0]['archive']} at {offset}: record and index differ")
        return headers, block


def lookup(directory: DataFrame, keys: DataFrame, key_col: str = "key", payloads: bool = False) -> DataFrame:
    """Every capture of the keys, found through the index: key, page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload)."""
    spark = directory.sparkSession
    batched(spark)
    ranges = directory.groupBy("archive").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("low", "high").collect()  # a row for each task that wrote
    shared = spark.sparkContext.broadcast([(r["archive"], r["low"], r["high"]) for r in ranges])

    def route(batches):
        archives = [r[0] for r in shared.value]
        low = [r[1] for r in shared.value]
        high = np.maximum.accumulate(np.array([r[2] for r in shared.value], object)).tolist() if low else []
        for b in batches:
            pairs = [(k, i) for k in b.column(0).to_pylist() for i in range(bisect.bisect_left(high, k), bisect.bisect_right(low, k)) if shared.value[i][2] >= k]
            yield pa.RecordBatch.from_arrays([pa.array([archives[i] for _, i in pairs], pa.string()), pa.array([k for k, _ in pairs], pa.string())], ["archive", "key"])

    schema = SCHEMA + (", url string, payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [x.split()[0] for x in DIRECTORY.split(", ")]

    def search(batches):
        now, pending, archive, out = None, [], None, []

        def table():
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _arrow(names))

        for b in batches:
            for r in b.to_pylist():
                if r["archive"] != now:
                    now, pending, archive = r["archive"], [], None
                if r["key"] is None:
                    pending.append(r)
                    continue
                archive = archive or Archive(pending)
                for headers, block in archive.captures(r["key"]):
                    kind = headers["warc-type"]
                    size = len(block) if kind == "response" else int(headers["warc-payload-length"])
                    refers = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                    out.append((r["key"], _page(headers["warc-record-id"]), size, headers["warc-payload-digest"].removeprefix("sha1:"), kind, refers, headers["warc-target-uri"], block)[: len(names)])
                    if len(out) >= 256:
                        yield table()
                        out = []
        if out:
            yield table()

    wanted = keys.select(F.col(key_col).cast("string").alias("key")).filter("key IS NOT NULL").distinct().mapInArrow(route, "archive string, key string")
    none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in DIRECTORY.split(", ")) if n != "archive"]
    asked = wanted.select("archive", "key", *none)
    known = directory.select("archive", F.lit(None).cast("string").alias("key"), *[n for n in rows if n != "archive"])
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = known.unionByName(asked).repartition(parts, "archive").sortWithinPartitions("archive", F.col("key").asc_nulls_first())
    return both.mapInArrow(search, schema)


def _line_column(key):
    """_line as a Column expression."""
    for c in "\r\n\t\x00":
        key = F.replace(key, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return key


def _arrow(names):
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The keys of pages."""
    return pages.select(surt_column(F.col(f"`{url_col}`").cast("string")).alias("key"))


def captures(directory: DataFrame, url: str) -> list[tuple[int | None, bytes]]:
    """(page id, block) of all captures of a URL, in page order; a revisit's block is empty."""
    spark = directory.sparkSession
    found = lookup(directory, spark.createDataFrame([(_line(surt(url)),)], "key string"), payloads=True)
    return [(r["page_id"], bytes(r["payload"])) for r in found.select("page_id", "payload").toLocalIterator()]
