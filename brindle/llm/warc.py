"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256; every record's exact header bytes (the WARC header and the
HTTP header) are kept apart, with the digest of its payload.  Records are put together again by a join.  Reading
digests the stored bytes anew and fails if a payload isn't what its name says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import fresh_path, lookup, written

#: Smaller payloads are stored with each record's header as responses, never as revisits.
LEAST_REVISIT = 1000
#: Copies of one row are told apart in arrays of so many.
RUN = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Two tables of Parquet files: records (record_id, header, payload_sha256, rows) and payloads."""

    spark: SparkSession
    path: str

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def payloads(self) -> DataFrame:
        """payload_sha256, payload; an error if the bytes don't have the digest."""
        stored = self.spark.read.parquet(f"{self.path}/payloads")
        wrong = F.raise_error(F.concat(F.lit("payload is not what its digest says: "), "payload_sha256"))
        return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload")).otherwise(wrong))


def _uuid(text: Column) -> Column:
    hex_ = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hex_, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null.  Line ends in a value would end the header."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def field(header: Column, name: str) -> Column:
    """A field of the WARC header; null if there is none."""
    head = F.substring_index(header, CRLF * 2, 1)
    return F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def write_archive(pages: DataFrame, path: str | None = None, *, id: str = "page_id", url: str = "url", body: str = "html", date: str = "2000-01-01T00:00:00Z") -> Archive:
    """Write a record for each row and return the archive.

    Of records with equal payloads of at least LEAST_REVISIT bytes the one with the largest id is the response and
    the others revisit it; of rows that repeat the largest id, all are responses.  Smaller payloads are always
    responses.  Repeated rows are records of their own, told apart by a number in what their record id is made of.  A
    null body is an empty payload, a null url or id has no header line, and an empty table makes an empty archive.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archive")
    own = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("payload_sha256", F.sha2("payload", 256))
    own.groupBy("payload_sha256").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")
    rows = written(own.select("id", "url", "payload_sha256", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")), "pages")
    groups = rows.groupBy("payload_sha256").agg(F.max("id").alias("first_id"), F.max_by("url", "id").alias("first_url"), F.count(F.lit(1)).alias("rows"))
    same = ["id", "url", "payload_sha256", "n", "sha1"]
    counted = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    single = written(runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("copies"), F.col("run") * RUN + RUN)))).drop("copies", "run"), "records")
    found = lookup(single, groups, "payload_sha256", "rows", single.count())
    revisit = (F.col("n") >= LEAST_REVISIT) & ~F.col("id").eqNullSafe(F.col("first_id"))
    # the first copy is the one that others refer to
    key = lambda id_, url_, copy=None: _uuid(F.concat_ws("|", F.coalesce(F.col(id_).cast("string"), F.lit("-")), F.coalesce(F.col(url_), F.lit("-")), "payload_sha256", copy))
    own_key = key("id", "url", F.when(F.col("copy") > 1, F.col("copy").cast("string")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    only = lambda c: F.when(revisit, c)
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", own_key),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", only(F.lit(PROFILE))),
        _line("WARC-Refers-To", only(key("first_id", "first_url", F.lit(None).cast("string")))),
        _line("WARC-Refers-To-Target-URI", only(F.col("first_url"))),
        _line("X-Page-ID", F.col("id").cast("string")),
        _line("X-Refers-To-Page-ID", only(F.col("first_id").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    found.select(own_key.alias("record_id"), header.alias("header"), "payload_sha256", "rows").write.parquet(f"{path}/records")
    return Archive(spark, path)


def read_records(archive: Archive) -> DataFrame:
    """A row for each record, from its header and the digested payload it names: record_id, page_id, url,
    record_type, refers_to, payload_bytes, payload_digest (SHA-1 of the stored bytes), header_digest (as the header has it)."""
    bytes_ = archive.payloads().select("payload_sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    records = archive.records()
    h = F.col("header")
    fields = records.select(
        "record_id",
        field(h, "X-Page-ID").cast("long").alias("page_id"),
        field(h, "WARC-Target-URI").alias("url"),
        field(h, "WARC-Type").alias("record_type"),
        field(h, "X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.substring_index(field(h, "WARC-Payload-Digest"), ":", -1).alias("header_digest"),
        "payload_sha256",
    )
    weights = written(bytes_.join(records.groupBy("payload_sha256").agg(F.max("rows").alias("rows")), "payload_sha256"), "payloads")
    return lookup(fields, weights, "payload_sha256", "rows", records.count()).drop("rows")


def rebuild(archive: Archive) -> DataFrame:
    """record_id and the original record's bytes: the header, the payload unless it is a revisit, two line ends.

    An empty payload is a record without bytes behind its header; an empty archive has no records.  Payloads that many
    small responses share go to the records, others meet them in a join by digest.
    """
    records = archive.records().withColumn("revisit", field(F.col("header"), "WARC-Type") == "revisit")
    end = F.lit(CRLF * 2).cast("binary")
    whole = records.filter(~F.col("revisit")).drop("rows", "revisit")
    weights = whole.groupBy("payload_sha256").agg(F.count(F.lit(1)).alias("rows"))
    # a payload under many responses is under LEAST_REVISIT bytes, or of rows that repeat one id
    stored = archive.payloads().join(weights, "payload_sha256").withColumn("rows", F.when(F.octet_length("payload") < LEAST_REVISIT, F.col("rows")).otherwise(F.lit(0)))
    joined = lookup(whole, stored, "payload_sha256", "rows", whole.count(), "inner")
    made = joined.select("record_id", F.concat(F.col("header").cast("binary"), "payload", end).alias("record"))
    bare = records.filter("revisit").select("record_id", F.concat(F.col("header").cast("binary"), end).alias("record"))
    return made.unionByName(bare)


def export_files(archive: Archive, path: str, records_a_file: int = 100_000) -> None:
    """Write the records as plain WARC files; two line ends close each record, as the format asks."""
    text = rebuild(archive).select(F.expr(f"cast(substring(record, 1, octet_length(record) - {len(CRLF * 2)}) as string)").alias("value"))
    text.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_a_file).text(path)
