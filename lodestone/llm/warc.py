"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256, in one table; the exact header text of each record is
kept in another, with the digest of its payload. Original records are rebuilt by a join of the two. The
digest is verified twice: on writing, rows under one SHA-256 must agree in length and SHA-1; on reading, a
payload must still have the digest it is stored under.

Of the records of one payload that with the largest id is a response; the others are revisits that refer to
it. Only ids and digests are shuffled to decide that; payload bytes move once, for those that are stored.

Null payloads are empty. Rows repeated under one id and payload are all responses of that id. Records
without an id are revisits of one that has it, if there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, stored
from .words import table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
HEX = "0123456789abcdef"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: 40 bits, ten and eight letters, at a time."""
    part = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digests(payload: str = "payload") -> list[Column]:
    return [F.sha2(F.col(payload), 256).alias("sha256"), base32(F.sha1(F.col(payload))).alias("sha1"), F.octet_length(F.col(payload)).cast("long").alias("n")]


def _urn(page: str) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))


def _http_header() -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))


@dataclass(frozen=True)
class Archive:
    """The two tables of an archive under one path."""

    spark: SparkSession
    path: str

    def records(self) -> DataFrame:
        return self.spark.read.schema("record_id long, warc_header string, http_header string, sha256 string").parquet(f"{self.path}/records")

    def payloads(self) -> DataFrame:
        return self.spark.read.schema("sha256 string, payload binary").parquet(f"{self.path}/payloads")

    def verified(self) -> DataFrame:
        """Facts of each stored payload, from its bytes as they are now."""
        facts = self.payloads().select(F.col("sha256").alias("named"), *digests())
        return facts.select("sha256", "sha1", "n", F.when(F.col("named") == F.col("sha256"), True).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("named")))).alias("sound")).filter("sound").drop("sound")

    def parsed(self) -> DataFrame:
        """The fields of each record's header."""

        def field(name: str) -> Column:
            return F.nullif(F.regexp_extract("warc_header", rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))

        def number(c: Column) -> Column:
            return F.regexp_extract(c, r"<urn:x-record:(-?[0-9]+)>", 1).try_cast("long")

        return self.records().select(
            number(field("WARC-Record-ID")).alias("record_id"), field("WARC-Type").alias("record_type"), number(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Target-URI").alias("uri"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), "sha256"
        )

    def originals(self) -> DataFrame:
        """Each record as it was captured: the HTTP header and the full payload, for revisits too."""
        return self.records().join(self.payloads(), "sha256").select("record_id", "warc_header", "http_header", "payload")

    def serialized(self) -> DataFrame:
        """Each record's bytes in a WARC file; revisits have no payload."""
        block = F.when(F.col("warc_header").contains(f"WARC-Type: response{CRLF}"), F.col("payload")).otherwise(F.lit(b""))
        return self.originals().select("record_id", F.concat(F.encode("warc_header", "UTF-8"), F.encode("http_header", "UTF-8"), block, F.lit(CRLF * 2).cast("binary")).alias("record"))

    def export(self, path: str, records_per_file: int = 10_000) -> None:
        """Standard .warc content, written by Spark's text sink: each line is a record, each line's end the record's."""
        body = self.serialized().select(F.expr("cast(substring(record, 1, length(record) - 4) as string)").alias("value"))
        body.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def write(pages: DataFrame, path: str, record_id: str = "page_id", uri: str = "url", payload: str = "html") -> Archive:
    """Archive a table of captures under ``path``."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[payload]
    raw = F.coalesce(F.col(payload), F.lit(b"")) if kind == "binary" else F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(record_id).cast("long").alias("record_id"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"), raw.alias("payload"))
    narrow = base.select("record_id", "uri", *digests())
    owners = stored(
        narrow.groupBy("sha256")
        .agg(F.max("record_id").alias("owner"), F.min("sha1").alias("sha1_a"), F.max("sha1").alias("sha1_b"), F.min("n").alias("n_a"), F.max("n").alias("n_b"))
        .select("sha256", "owner", F.when((F.col("sha1_a") == F.col("sha1_b")) & (F.col("n_a") == F.col("n_b")), True).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("sha256")))).alias("sound"))
        .filter("sound")
        .drop("sound"),
        "owners",
    )  # a table, and no aggregate, beside the rows: so adaptive execution splits those of a hot digest
    response = F.col("record_id").eqNullSafe(F.col("owner"))
    http = _http_header()
    length = F.octet_length(http) + F.when(response, F.col("n")).otherwise(F.lit(0))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn("record_id"),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(response, "").otherwise(F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _urn("owner"))),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2),
    )
    narrow.join(owners, "sha256").select("record_id", header.alias("warc_header"), http.alias("http_header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/records")
    none = F.lit(-(1 << 63))  # the join and the aggregate share one exchange only if both have plain keys
    bodies = base.select(F.sha2("payload", 256).alias("sha256"), F.coalesce("record_id", none).alias("slot"), "payload")
    kept = owners.select("sha256", F.coalesce("owner", none).alias("slot"))
    bodies.join(kept, ["sha256", "slot"], "left_semi").groupBy("sha256", "slot").agg(F.first("payload").alias("payload")).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return Archive(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    facts = archive.verified().withColumnRenamed("sha1", "read_digest")
    return archive.parsed().join(facts, "sha256").select(F.col("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", "refers_to", "uri")
