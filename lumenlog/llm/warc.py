"""WARC archives: written by Spark's own writers, read back record by record, and assembled to one row per capture.

Each page gives three records: a request, a response (or a revisit of another capture with the same payload) and
metadata that names the page; request and metadata point to the capture through WARC-Concurrent-To. A record ends with
CRLF CRLF, so a text writer with that separator writes a valid archive on any file system that Spark writes to, under
its commit protocol. Reading follows Content-Length, never separators, as payloads may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, scratch_path, table, written

END = "\r\n\r\n"
#: Classes of payload size: the most bytes of a payload, and captures of an archive.
ARCHIVES = ((8 << 10, 20_000), (64 << 10, 2_500), (1 << 20, 160), (64 << 20, 2), (None, 1))
RECORD = "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 20 bytes are 4 groups of 40 bits, 8 letters each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32)), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end: header lines with a value, Content-Length, an empty line, the block."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in headers]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def capture_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_payload: int = 0) -> DataFrame:
    """One row `value` per record of `pages` (page_id long, url string, html string)."""
    source = identified(pages.select("page_id", "url", "html"), "row").select(
        F.col("page_id").cast("long").cast("string").alias("page"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"[\r\n]", "%0A").alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.col("page_id").cast("long").alias("page_id"),
        "row",
        F.concat_ws(".", "row.file", "row.place").alias("place"),
    ).withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    long_enough = source.filter(F.col("size") >= min_payload)
    groups = long_enough.groupBy(F.col("digest").alias("g_digest"), F.col("size").alias("g_size")).agg(F.max(F.struct("page_id", "row", "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g_digest", "g_size", "first")
    # Groups of copies grow with the corpus: a merge join, whose skewed side Spark splits.
    placed = source.join(groups.hint("merge"), (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size")), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    own = _urn(F.col("page"), F.col("digest"), F.col("place"))
    other = F.when(revisit, _urn(F.col("first.page_id").cast("string"), F.col("digest"), F.col("first.place")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    common = [("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.lit(date))]
    capture = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", F.col("own")), *common,
         ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.col("other")),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), F.col("own"))), *common, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1"), F.lit(END)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), F.col("own"))), *common, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce("page", F.lit("")), F.lit("\r\n")),
    )
    return placed.withColumn("own", own).withColumn("other", other).select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write gzipped archives of `pages` under `path` (any file system Spark writes to).

    An archive holds so many captures that their payloads are at most some 160 MB, or one larger payload: pages are
    written by classes of payload size, each with a number of records a file; payloads that are equal share a class.
    """
    spark = pages.sparkSession
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    head = spark.createDataFrame([], "value string")
    present = {r[0] for r in pages.groupBy(_size_class(size).alias("c")).count().select("c").collect()}  # as many rows as classes
    for c, (_, captures) in enumerate(ARCHIVES):
        if c in present or not c:
            writer = head.unionAll(capture_records(pages.filter(_size_class(size) == c), **options)).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
            writer.option("maxRecordsPerFile", 3 * captures).text(f"{path}/size-{c}")


def _size_class(size: Column) -> Column:
    out = F.lit(len(ARCHIVES) - 1)
    for c, (most, _) in reversed(list(enumerate(ARCHIVES[:-1]))):
        out = F.when(size <= most, c).otherwise(out)
    return out


class _Bytes:
    """Reads of exact lengths and of header lines from the inflated bytes of an archive, of which a block is held at a time."""

    def __init__(self, packed: bytes, block: int = 1 << 20):
        self.packed, self.at, self.block = packed, 0, block
        self.ready, self.pos = b"", 0
        self.inflate = zlib.decompressobj(wbits=47)

    def more(self) -> bool:
        """Another block after what is ready; False at the end."""
        while True:
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                if not self.packed[self.at : self.at + 4096].strip(b"\0"):
                    return False
                self.inflate = zlib.decompressobj(wbits=47)
            fed = self.inflate.unconsumed_tail
            if not fed:
                fed = self.packed[self.at : self.at + self.block]
                self.at += len(fed)
                if not fed:
                    return False
            if out := self.inflate.decompress(fed, self.block):
                self.ready, self.pos = self.ready[self.pos :] + out, 0
                return True

    def take(self, n: int) -> bytes:
        parts = []
        while n > len(self.ready) - self.pos:
            parts.append(self.ready[self.pos :])
            n -= len(parts[-1])
            self.ready, self.pos = b"", 0
            if not self.more():
                raise ValueError("the archive ends within a record")
        self.pos += n
        parts.append(self.ready[self.pos - n : self.pos])
        return b"".join(parts) if len(parts) > 1 else parts[0]

    def head(self) -> bytes | None:
        while (cut := self.ready.find(b"\r\n\r\n", self.pos)) < 0:
            if not self.more():
                if self.ready[self.pos :].strip():
                    raise ValueError("the archive ends within a header")
                return None
        return self.take(cut + 4 - self.pos)[:-4]


def records_of(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a gzipped archive."""
    stream = _Bytes(packed)
    while (head := stream.head()) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


def _parse(with_payload: bool):
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]):
        for batch in it:
            for cell in batch.column("content"):
                rows, held = [], 0
                for f, block in records_of(cell.as_py()):
                    kind = f["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
                    digest, size = f.get("warc-payload-digest", "").removeprefix("sha1:") or None, len(payload)
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "revisit":
                        size = None  # the payload is in the record that this one refers to
                    named = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k] if kind == "metadata" else None
                    rows.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to"), digest, size, named, payload if with_payload and kind != "metadata" else None))
                    held += len(payload) * with_payload + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under `path`, one row each; the digest and length of a response are taken from its
    payload. A revisit has no payload of its own, so no length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata records concurrent to it.

    Captures without companions keep empty arrays; companions without a capture give no row.
    """
    companion = F.struct("record_id", "type", "fields", "payload")
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    is_capture = F.col("type").isin("response", "revisit")
    whole = keyed.groupBy("capture_id").agg(
        F.first(F.when(is_capture, F.struct("type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")), ignorenulls=True).alias("capture"),
        F.collect_list(F.when(F.col("type") == "request", companion)).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", companion)).alias("metadata"),
    )
    return whole.filter("capture is not null").select("capture_id", "capture.*", "requests", "metadata")


def warc_round_trip(pages: DataFrame, path: str, min_payload: int = 0, with_payload: bool = False) -> DataFrame:
    """Write archives of all rows of `pages`, read them back and return page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url gets a urn of the page. Of rows with equal payloads of at least
    `min_payload` bytes the one with the largest page_id is the response (of repeated rows one of them, a null id last);
    the others revisit it. Shorter ones are all responses. Repeated rows each give a capture. An empty table gives an
    empty result. Columns besides page_id, url and html are ignored.
    """
    write_archives(pages, path, min_payload=min_payload)
    page = F.expr("try_cast(nullif(metadata[0].fields['page-id'], '') as bigint)")
    assembled = assemble(read_archives(pages.sparkSession, path, with_payload)).filter("metadata[0] is not null")
    # Without payloads a capture is a short row, so the join of revisits with what they refer to is cheap.
    captures = written(assembled.select("capture_id", "type", "refers_to", "payload_digest", "payload_bytes", page.alias("page_id")), "captures")
    out = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    responses = captures.filter("type = 'response'")
    referred = responses.select(F.col("capture_id").alias("r_id"), F.col("page_id").alias("r_page"), F.col("payload_bytes").alias("r_bytes"))
    revisits = captures.filter("type = 'revisit'").join(referred.hint("merge"), F.col("refers_to") == F.col("r_id"), "left")
    return responses.select(*out, F.lit(None).cast("long").alias("refers_to")).unionAll(revisits.withColumn("payload_bytes", F.col("r_bytes")).select(*out, F.col("r_page").alias("refers_to")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
     d as (select page_id, octet_length(body) as payload_bytes, sha1(body) as hex from p),
     b as (select page_id, payload_bytes, hex, list_transform(range(0, 4), lambda k: ('0x' || substr(hex, 1 + 10 * k, 10))::bigint) as g from d),
     s as (select page_id, payload_bytes, hex,
                  list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g[1 + j // 8] >> (35 - 5 * (j % 8))) & 31)::int, 1)), 'string_agg', '') as payload_digest,
                  max(page_id) over (partition by hex) as top
           from b)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from s
"""
