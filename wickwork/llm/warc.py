"""WARC archives of pages, and an external index merge over them.

Writing: equal payloads are found by digest; the smallest id of each is a response record, the others are revisits that
refer to it. Records are put together as text by Spark's functions and written by its text writer, gzipped, so archives
are committed like any other table. Reading: each archive is unpacked as a stream and gives one run of captures, sorted by
URL key, time and id. The runs are written down, dealt out by ranges of that key, and every range merges what it got from
each run with a loser tree. Ranges in order are the whole capture history in order. A URL with very many captures is
cut by their times, since ranges are over the whole key.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import join_small, partitions, scratch_path, text_or_empty, written

#: Bytes of payload in an archive at most, unless it holds a single record; payloads are written by size classes, each
#: STEPS times the one below, so that a number of records bounds the bytes.
ARCHIVE_BYTES, SMALLEST, STEPS = 64 << 20, 16 << 10, 8
#: Captures of a range, about; ranges are merged in memory.
CAPTURES_PER_RANGE = 50_000
#: Bytes that are unpacked at a time.
STEP = 1 << 20
_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, run string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits are eight digits, and 160 bits need no padding."""
    digest = F.sha1(payload)
    part = lambda i: F.translate(F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0"), _HEX, _B32)
    return F.concat(*[part(i) for i in range(4)])


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _date(page_id: Column) -> Column:
    """A capture time for tables without one: a second for each id from 2020 on."""
    second = F.coalesce(F.pmod(page_id, F.lit(10 * 365 * 86_400)), F.lit(0))
    stamp = F.expr("timestamp_ntz'2020-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def records(df: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(value, size): a WARC/1.1 record for each row, without the last line end, and the bytes of its payload."""
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20]", "%20").alias("url"), text_or_empty(df, payload_col).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("same", F.sha2("payload", 256))
    # Only payloads that occur under several ids are looked up again; digests are grouped before the shuffle.
    firsts = rows.filter(F.col("size") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.filter("n > 1 and first < last").select("same", "first"), "repeated-payloads")
    rows = join_small(rows, firsts, ["same"], "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("size").cast("string"), F.lit(end + end))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "), _name(F.col("page_id")),
        F.lit(f"{end}WARC-Date: "), _date(F.col("page_id")),
        F.lit(f"{end}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {REVISIT}{end}WARC-Refers-To: "), _name(F.col("first")))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), length.cast("string"), F.lit(end + end),
    )
    return rows.select(F.concat(head, block, F.lit(end)).alias("value"), "size")


def write_archives(df: DataFrame, path: str, min_bytes: int = 0, **columns: str) -> None:
    """Write ``df`` as gzipped WARC files below ``path``.

    Null payloads and URLs count as empty. Payloads of fewer than ``min_bytes`` are never revisits. Rows with a null id
    are responses. Repeated rows of the smallest id of a payload are all responses. Very long payloads have archives of
    their own. An empty table writes no record; other columns than the three named are not read.
    """
    rows = records(df, min_bytes, **columns)
    size_class = F.greatest(F.ceil(F.log(float(STEPS), F.greatest("size", F.lit(1)) / SMALLEST)), F.lit(0)).cast("int")
    for no in sorted(r[0] for r in rows.select(size_class.alias("no")).distinct().collect()) or [0]:  # a dozen classes at most
        most = max(1, ARCHIVE_BYTES // (SMALLEST * STEPS**no))
        own = rows.filter(size_class == no).select("value")
        own.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size-{no}")


def _stream(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records in a gzipped archive; offsets are those of the unpacked archive.

    The archive may be one gzip member, or a member for each record, or anything between.
    """
    unpack = zlib.decompressobj(31)
    buffer, at, fed, rest = bytearray(), 0, 0, b""

    def more() -> bool:
        nonlocal fed, rest, unpack
        part = rest
        if not part:
            part = data[fed : fed + STEP]
            fed += STEP
        if not part:
            if data and not unpack.eof:
                raise ValueError(f"the archive ends within a gzip member at {at}")
            return False
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        buffer.extend(unpack.decompress(part))
        rest = unpack.unused_data
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError(f"the archive ends within a record's header at {at}")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = end + 4 + int(fields["Content-Length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError(f"the archive ends within a record at {at}")
        yield at, fields, bytes(buffer[end + 4 : size - 4])
        del buffer[:size]
        at += size


def url_key(url: str) -> str:
    """The sortable form of a URL: its host reversed, then the path, in lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?(.*)$", url.lower(), re.S)
    if not m:
        return url.lower()
    host, path = m.groups()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (path.split("#")[0] or "/")


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the archives below ``path``; those of an archive come in order and are one run.

    Digests and sizes are taken from the payload that a response record holds; a revisit has them in its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CAPTURE.split(", ")]
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, fields, block in _stream(data.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload)
                    if fields["WARC-Type"] == "revisit":
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    elif base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != digest:
                        raise ValueError(f"the payload at {offset} of {file} has another digest")
                    rows.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), file, offset, file))
                rows.sort(key=_rank)
                for lo in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (2, 3, 6, 8) else pa.string()) for i, c in enumerate(zip(*rows[lo : lo + 5000], strict=True))], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def _rank(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0


def loser_tree(runs: list[list[tuple]], rank=_rank) -> Iterator[tuple]:
    """The rows of sorted ``runs`` in order.

    Inner nodes hold the loser of their match and node 0 the overall winner, so the next row takes one match a level.
    """
    k = len(runs)
    ends: tuple = (1,)
    at = [0] * k
    key = [(0, rank(r[0]), i) if r else ends for i, r in enumerate(runs)]
    tree = [-1] * max(1, k)

    def replay(i: int) -> None:
        node = (i + k) // 2
        while node:
            j = tree[node]
            if j < 0:  # only while the tree is built: wait for an opponent
                tree[node] = i
                return
            if key[j] < key[i]:
                tree[node], i = i, j
            node //= 2
        tree[0] = i

    for i in range(k):
        replay(i)
    while k and key[i := tree[0]] != ends:
        yield runs[i][at[i]]
        at[i] += 1
        key[i] = (0, rank(runs[i][at[i]]), i) if at[i] < len(runs[i]) else ends
        replay(i)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in global order: range_no, then range_pos within the range."""
    n = max(partitions(runs.sparkSession), -(-runs.count() // CAPTURES_PER_RANGE))
    names = runs.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                by_run.setdefault(row[-1], []).append(row)
        for rows in by_run.values():  # a run keeps its order in a shuffle; if it did not, it is put right here
            if any(_rank(a) > _rank(b) for a, b in zip(rows, rows[1:], strict=False)):
                rows.sort(key=_rank)
        out, at, no = [], 0, TaskContext.get().partitionId()
        for row in loser_tree([by_run[r] for r in sorted(by_run)]):
            out.append((*row, no, at))
            at += 1
            if len(out) == 5000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"page_id", "payload_bytes", "refers_to", "offset", "range_pos"}
        cols = [*names, "range_no", "range_pos"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if x in kinds else pa.int32() if x == "range_no" else pa.string()) for x, c in zip(cols, zip(*rows, strict=True), strict=True)], names=cols)

    return runs.repartitionByRange(n, "url_key", "captured_at", "page_id").mapInArrow(merge, f"{CAPTURE}, range_no int, range_pos long")


def archive_and_index(df: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``df`` as WARC archives in the shared folder, read them back and merge their captures into one order.

    A row for each row of ``df``: the columns of CAPTURE, range_no, range_pos and capture_no, the place in the whole
    order from 1 on. refers_to is the id of a revisit's response, null for responses.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(df, path, min_bytes, **columns)
    merged = written(merge_runs(written(captures(spark, path), "runs")), "captures")
    # A row for each range.
    sizes = merged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("range_no", before.alias("before")), "ranges")
    return join_small(merged, starts, ["range_no"], "inner").withColumn("capture_no", F.col("before") + F.col("range_pos") + 1).drop("before")
