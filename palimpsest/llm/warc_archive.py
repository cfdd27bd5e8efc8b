"""A content-addressed web archive.

``payloads`` holds each distinct payload once, under its SHA-256, SHA-1 and length. ``headers`` holds the exact header bytes of
every record (WARC and HTTP headers) with the address of its payload. A record is rebuilt by joining the two.
Of records with equal payloads of ``least`` bytes or more, that with the largest page_id is the response and the others
revisit it; smaller ones are all responses. Both tables are written by Spark to any store it can write.

All work is DataFrame functions: digests are taken where the pages are read, and only narrow rows are grouped. Reading
verifies: a payload whose digests or length differ from its address, or a header without a payload, fails the read. A
payload that many records share is copied for each thousand of them, so that no task rebuilds them all.

Defined results: a null html is an empty payload, a null url an empty target. A null page_id is written as an
empty number and read back as null; it is never the response for others. Rows that repeat a page_id are records
of their own and of one type. Payloads may be as long as a Spark value may be. An empty table gives an empty archive. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checked, fresh_path, written

ADDRESS = ["sha256", "sha1", "size"]
DATE = "1970-01-01T00:00:00Z"
#: So many records of one payload are rebuilt in a task.
SPREAD = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def _addressed(pages: DataFrame) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    body = pages.select("page_id", "url", payload().alias("payload"), place.alias("place"))
    return body.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})


def _header() -> Column:
    """The exact bytes before the payload of a record, from page_id, url, sha1, size and refers (null for a response)."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("refers").isNull(), F.col("size")).otherwise(F.lit(0))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.concat(line("WARC-Refers-To", urn("refers")), line("WARC-Profile", F.lit(PROFILE)))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("sha1")))),
        F.when(F.col("refers").isNull(), F.lit("")).otherwise(revisit),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return F.encode(text, "UTF-8")


def write(pages: DataFrame, path: str, least: int = 1000) -> None:
    try:
        _addressed(pages)
    except AnalysisException:  # not read from files: rows have no places
        pages = written(pages.select("page_id", "url", "html"), "pages")
    spark = pages.sparkSession
    _addressed(pages).select("page_id", "url", "place", *ADDRESS).write.parquet(f"{path}/log")
    log = spark.read.parquet(f"{path}/log")
    shared = log.groupBy(*ADDRESS).agg(F.min("place").alias("stored"), F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared, "shared")
    rows = log.join(checked(shared.drop("stored")), ADDRESS, "left")
    refers = F.when((F.col("size") >= least) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    spread = F.ceil(F.coalesce("n", F.lit(1)) / SPREAD).cast("int").alias("spread")
    rows.withColumn("refers", refers).select("page_id", _header().alias("header"), "refers", *ADDRESS, spread).write.parquet(f"{path}/headers")
    # each payload once: not the rows that hold a payload that another place holds
    again = log.join(checked(shared.select(*ADDRESS, "stored")), ADDRESS).where("place <> stored").select("place")
    body = _addressed(pages).join(checked(written(again, "again")), "place", "left_anti")
    body.select(*ADDRESS, "payload").write.parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each hashed again; one that isn't what its address says fails the query."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.unhex(F.sha1("payload")) == F.col("sha1")) & (F.octet_length("payload") == F.col("size"))
    return stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its address")).cast("binary")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record: the whole records, headers and payloads joined. A revisit has no payload of its own."""
    headers = spark.read.parquet(f"{path}/headers")
    responses = headers.where("refers is null").withColumn("salt", F.pmod(F.hash("page_id", "header"), F.col("spread")))
    # the number of records of an address is known from its headers
    wide = responses.where("spread > 1").select(*ADDRESS, "spread").distinct()
    bodies = verified_payloads(spark, path).join(checked(wide), ADDRESS, "left")
    bodies = bodies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))).drop("spread")
    end = F.lit(b"\r\n\r\n")
    whole = responses.join(bodies, [*ADDRESS, "salt"], "left")
    body = F.coalesce("payload", F.raise_error(F.lit("a record has no payload")).cast("binary"))
    return whole.select("page_id", F.concat("header", body, end).alias("record")).unionByName(headers.where("refers is not null").select("page_id", F.concat("header", end).alias("record")))


def index(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: parsed from the rebuilt records, byte by byte.

    The payload of a response is what follows its two blocks of headers, and is measured and hashed again. A revisit has the
    measures of the response that it refers to."""
    latin = F.decode("record", "ISO-8859-1")  # a character for each byte
    parsed = records(spark, path).select("record", latin.alias("text")).withColumn("at", F.expr(r"locate('\r\n\r\n', text)"))
    parsed = parsed.withColumn("from", F.expr(r"locate('\r\n\r\n', text, at + 4) + 4")).withColumn("head", F.expr("substr(text, 1, at)"))
    body = F.expr("substr(record, from, octet_length(record) - from - 3)")
    field = lambda pattern: F.regexp_extract("head", pattern, 1)
    number = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract(head, '{pattern}', 1), '') as {kind})")
    told = parsed.select(
        number("WARC-Record-ID: <urn:page:([^>]*)>").alias("page_id"),
        field(r"WARC-Payload-Digest: sha1:(\w+)").alias("claimed"),
        field(r"WARC-Type: (\w+)").alias("record_type"),
        number("WARC-Refers-To: <urn:page:([^>]*)>").alias("refers_to"),
        body.alias("body"),
    )
    told = told.select("page_id", "claimed", "record_type", "refers_to", F.octet_length("body").cast("long").alias("own_bytes"), F.sha1("body").alias("own_digest"))
    told = written(told, "index")
    targets = told.where("refers_to is not null").select(F.col("refers_to").alias("page_id"), "claimed").distinct()
    measured = told.where("record_type = 'response'").join(checked(targets), ["page_id", "claimed"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "claimed").agg(F.min("own_bytes").alias("bytes"), F.min("own_digest").alias("digest"))
    joined = told.join(checked(measured), ["refers_to", "claimed"], "left")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("digest")).otherwise(F.col("own_digest"))
    digest = F.when(digest == F.col("claimed"), digest).otherwise(F.raise_error(F.lit("a record has no payload, or another than its header says")).cast("string"))
    return joined.select("page_id", F.when(revisit, F.col("bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path)
    return index(spark, path, pages.schema["page_id"].dataType.simpleString())
