"""WARC archives as a chunked record table, written and read by Spark's text source.

A record is a row of its identifier, a chunk number and at most ``chunk_bytes`` bytes. The first
chunk is the WARC record itself, further ones are ``continuation`` records (WARC segmentation), so
neither side holds a whole oversized payload. Archives are plain ``.warc`` files: every row ends in
the blank lines that end a WARC record, and the reader cuts at the version line that begins one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, map_rows, written

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

CHUNK_BYTES = 1 << 16
LEAST_REVISIT_BYTES = 100


def _header(*lines: F.Column) -> F.Column:
    return F.concat(F.lit(VERSION + CRLF), *lines, F.lit(CRLF))


def _field(name: str, value: F.Column) -> F.Column:
    return F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF))


def records(pages: DataFrame, least_revisit_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """One row per page: page_id, url, payload, its size, digest, type, refers_to and record_id.

    Payloads are the html in UTF-8 (null: empty). Of the records with equal payloads of at least
    ``least_revisit_bytes`` bytes, the one with the smallest page_id (null: largest) is the response
    and the others revisit it; smaller ones are all responses. Rows that repeat a page with the same
    payload are records of their own: where that page is the response, one of them is, and the
    others revisit it. An empty table gives no rows.
    """
    rows = columns_of(pages, page_id="long", url="string", html="string").select(
        "page_id",
        "url",
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2("payload", 256)
    )
    large = F.col("payload_bytes") >= least_revisit_bytes
    pages_of = rows.filter(large).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    last = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("n"))
    first = pages_of.groupBy(F.col("payload_digest").alias("_digest")).agg(
        F.min(last).alias("_first"), F.sum("n").alias("_n")
    )
    # Written, so that the join can split a payload that very many pages hold; without payloads.
    shared = written(first.filter("_n > 1").select("_digest", F.col("_first.id").alias("_id"), F.col("_first.n").alias("_same")), "shared")
    joined = rows.join(shared, F.col("payload_digest") == F.col("_digest"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("_id"))
    alone = (
        joined.filter(F.col("_digest").isNull() | ~is_first | (F.col("_same") == 1))
        .withColumn("record_type", F.when(F.col("_digest").isNull() | is_first, "response").otherwise("revisit"))
    )
    # The rare pages that repeat as a whole: counted, then told apart by number.
    repeated = (
        joined.filter(F.col("_digest").isNotNull() & is_first & (F.col("_same") > 1))
        .groupBy("page_id", "payload_digest", "_digest", "_id", "_same", "payload_bytes")
        .agg(F.first("payload").alias("payload"), F.min("url").alias("url"), F.count("*").alias("_n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("record_type", F.when(F.col("copy") == 0, "response").otherwise("revisit"))
    )
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "_id"]
    both = alone.select(names).unionByName(repeated.select(names))
    revisit = F.col("record_type") == "revisit"
    # A response that may be referred to is known by its page and payload; other records may repeat
    # in both, so a number that is unique in this pass tells them apart.
    own = F.when(revisit | ~large, F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string")))
    return both.select(
        "page_id", "url",
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", "record_type",
        F.when(revisit, F.col("_id")).alias("refers_to"),
        F.concat(
            F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"),
            F.substring("payload_digest", 1, 16), F.coalesce(own, F.lit("")),
        ).alias("record_id"),
    )


def _chunks(payload: F.Column, chunk_bytes: int) -> F.Column:
    """The payload as an array of binary chunks, at least one.

    Also cut inside every version line that the payload holds, as the reader cuts files there.
    """
    size = F.octet_length(payload)
    # Pieces between the cuts: text that repeats the version line is rare, so most rows have one.
    starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(chunk_bytes))
    return F.transform(starts, lambda s: F.substring(payload, s, F.lit(chunk_bytes)))


def record_chunks(recs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: one row per record_id and chunk_no with the bytes of that chunk."""
    marker = "(?<=WARC)(?=/1\\.1)"
    text = F.decode(F.col("payload"), "UTF-8")
    pieces = F.when(F.instr(text, VERSION) > 0, F.transform(F.split(text, marker), lambda t: F.encode(t, "UTF-8"))).otherwise(F.array("payload"))
    cut = F.flatten(F.transform(pieces, lambda p: _chunks(p, chunk_bytes)))
    return recs.withColumn("_cut", cut).select(
        *[c for c in recs.columns if c != "payload"],
        F.size("_cut").alias("n_chunks"),
        F.posexplode("_cut").alias("chunk_no", "chunk"),
    )


def write_archives(recs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one WARC file per task. Payload digests and sizes of the whole payload go in the headers.

    Header values have line breaks, other control characters and the version line percent-encoded.
    """
    rows = record_chunks(recs, chunk_bytes)
    first, last = F.col("chunk_no") == 0, F.col("chunk_no") == F.col("n_chunks") - 1
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20"), "WARC/1", "WARC%2F1")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(first, F.concat(F.encode(http, "UTF-8"), F.col("chunk"))).otherwise(F.col("chunk"))
    revisit = F.col("record_type") == "revisit"
    number = (F.col("chunk_no") + 1).cast("string")
    uri = F.concat(F.lit("<"), F.col("record_id"), F.when(first, F.lit("")).otherwise(F.concat(F.lit("#"), number)), F.lit(">"))
    nothing = F.lit("")
    head = _header(
        _field("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        _field("WARC-Record-ID", uri),
        F.when(first, F.concat(_field("WARC-Target-URI", url), _field("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), nothing)))).otherwise(nothing),
        F.when(first, _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))).otherwise(nothing),
        F.when(first & revisit, F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("none")), F.lit(":"), F.substring("payload_digest", 1, 16), F.lit(">"))))).otherwise(nothing),
        F.when(F.col("n_chunks") > 1, _field("WARC-Segment-Number", number)).otherwise(nothing),
        F.when(~first, _field("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">")))).otherwise(nothing),
        F.when(~first & last, _field("WARC-Segment-Total-Length", F.col("payload_bytes") + F.octet_length(http))).otherwise(nothing),
        F.when(first, _field("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(nothing),
        _field("Content-Length", F.octet_length(block)),
    )
    # Casting binary to string keeps the bytes; the text sink writes them as they are.
    line = F.concat(F.encode(head, "UTF-8"), block).cast("string").alias("value")
    rows.select(line).write.option("lineSep", CRLF + CRLF).text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives: headers, chunk number and the bytes of each chunk.

    Files are split freely, as each row of the text source is one WARC record.
    """
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).filter(F.length("value") > 0)
    head = F.substring_index("value", CRLF + CRLF, 1)
    rows = raw.select(head.alias("head"), F.col("value").cast("binary").alias("bytes"))

    def value(name: str) -> F.Column:
        found = F.regexp_extract("head", rf"(?m)^{name}: (.*?)\r?$", 1)
        return F.when(found != "", found)

    rows = rows.select(
        value("WARC-Type").alias("warc_type"),
        F.regexp_replace(value("WARC-Record-ID"), r"^<|(#\d+)?>$", "").alias("record_id"),
        value("X-Page-ID").cast("long").alias("page_id"),
        value("WARC-Target-URI").alias("url"),
        F.regexp_replace(value("WARC-Payload-Digest"), "^sha256:", "").alias("stated_digest"),
        F.regexp_extract(value("WARC-Refers-To"), r"^<urn:x-page:(\d+|-\d+):", 1).try_cast("long").alias("refers_to"),
        (F.coalesce(value("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        value("WARC-Segment-Number").isNotNull().alias("segmented"),
        F.substring("bytes", F.octet_length("head") + 5, value("Content-Length").cast("int")).alias("block"),
        value("Content-Length").cast("long").alias("length"),
    )
    whole = F.octet_length("block") == F.col("length")
    rows = rows.withColumn("block", F.when(whole, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("cut short: "), F.col("record_id"))).cast("binary")))
    # The first chunk of a record starts with the HTTP head.
    http = F.substring_index(F.col("block").cast("string"), CRLF + CRLF, 1)
    first = F.col("chunk_no") == 0
    rows = rows.withColumn("_http", F.when(first, http))
    return rows.select(
        "warc_type", "record_id", "page_id", "url", "stated_digest", "refers_to", "chunk_no", "segmented",
        F.regexp_extract("_http", r"(?m)^Content-Length: (\d+)", 1).try_cast("long").alias("stated_bytes"),
        F.when(first, F.expr("substring(block, octet_length(_http) + 5)")).otherwise(F.col("block")).alias("chunk"),
    )


def _digests(chunks: DataFrame) -> DataFrame:
    """(record_id, bytes, digest) of chunk rows that come record after record, in order.

    One running digest is carried from chunk to chunk and batch to batch; nothing is put together.
    """

    def rows(columns):
        yield from zip(columns["record_id"], columns["chunk"], strict=True)

    def run(batches):
        import pyarrow as pa

        now, size, sha = None, 0, None
        out: list[tuple] = []

        def batch(part):
            return pa.RecordBatch.from_pydict(
                {
                    "record_id": pa.array([p[0] for p in part], pa.string()),
                    "bytes": pa.array([p[1] for p in part], pa.int64()),
                    "digest": pa.array([p[2] for p in part], pa.string()),
                }
            )

        for b in batches:
            for key, chunk in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, size, sha.hexdigest()))
                    now, size, sha = key, 0, hashlib.sha256()
                data = chunk.as_buffer()
                sha.update(data)
                size += data.size
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if now is not None:
            out.append((now, size, sha.hexdigest()))
        yield batch(out)

    return chunks.select("record_id", "chunk").mapInArrow(run, "record_id string, bytes long, digest string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests of responses are taken from the payload read back, chunk by chunk; a revisit
    has those its header states, for it carries no payload. A record whose payload does not have the
    stated digest fails the job.
    """
    chunks = read_chunks(spark, path)
    heads = chunks.filter("chunk_no = 0")
    # Only records of several chunks move: by record, in chunk order.
    parts = chunks.filter("segmented").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    one = heads.filter("warc_type = 'response' and not segmented")
    seen = _digests(one).unionByName(_digests(parts))
    rows = heads.select("record_id", "page_id", "url", "warc_type", "stated_digest", "stated_bytes", "refers_to")
    joined = rows.join(seen, "record_id", "left")
    revisit = F.col("warc_type") == "revisit"
    digest = F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest"))
    wrong = ~revisit & ~F.col("digest").eqNullSafe(F.col("stated_digest"))
    return joined.select(
        "page_id", "url",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(wrong, F.raise_error(F.concat(F.lit("digest differs: "), F.col("record_id"))).cast("string")).otherwise(digest).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        "refers_to",
    )
