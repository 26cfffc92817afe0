"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, stored

# Smaller payloads are stored by digest too, but their records never refer to another one.
MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write ``path/payloads`` (each content once) and ``path/headers`` (one WARC header per page).

    Of records with equal payloads of at least ``min_bytes`` the smallest ``page_id``
    is the response and the others revisit it. A null payload is empty, a null url
    gives no target line, a null id gives ``<urn:page:null>`` and comes after all
    others. Rows that repeat an id with the same payload are all that id's
    response; with other payloads each goes with its own. An empty table gives an empty
    archive; other columns are ignored. Two payloads with one digest stop the job.
    """
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.encode(text, "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # A second, independent hash and the length tell different payloads of one digest.
    check = F.struct("bytes", F.xxhash64("payload"))
    counted = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min(check).alias("low"), F.max(check).alias("high"))
    pairs = stored(counted, "pages")
    owners = (
        pairs.groupBy("digest")
        .agg(F.min("page_id").alias("owner"), F.min("low").alias("low"), F.max("high").alias("high"))
        .select(
            F.when(F.col("low") == F.col("high"), F.col("digest"))
            .otherwise(F.raise_error(F.concat(F.lit("two payloads with the digest "), "digest")))
            .alias("owner_digest"),
            "owner",
        )
    )
    owns = F.col("page_id").eqNullSafe(F.col("owner"))
    placed = pairs.join(owners, F.col("digest") == F.col("owner_digest")).withColumn("owns", owns)
    copies = placed.filter("NOT owns OR n > 1").select(F.col("digest").alias("d"), F.col("page_id").alias("p"), "owns")
    copies = stored(copies, "copies")
    # Payloads stay in place but for those of copies: these leave, or one of an owner's equal rows is taken. The id is
    # part of the key, so where the copies are too many to broadcast a frequent payload still doesn't meet in one task.
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    single = rows.join(hinted(copies, 96), same, "left_anti").select("digest", "payload")
    repeated = rows.join(hinted(copies.filter("owns"), 96), same, "left_semi").select("digest", "payload").dropDuplicates(["digest"])
    single.unionByName(repeated).write.option("compression", "zstd").parquet(f"{path}/payloads")
    narrow = rows.select("page_id", "url", "digest", "bytes").join(owners, F.col("digest") == F.col("owner_digest"))
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull()
    header = _header(revisit, date)
    narrow.select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def _record_id(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.lit(">"))


def _header(revisit: Column, date: str) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))

    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(
            revisit,
            F.concat(line("WARC-Refers-To", _record_id("owner")), line("WARC-Profile", F.lit(PROFILE))),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit(_EOL),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest, payload, payload_bytes``; stored bytes that no longer have their digest stop the job."""
    rows = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    true = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "digest"))
    )
    return rows.select(true.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"))


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records: ``header``, ``digest``, ``payload_bytes`` and, unless left out, ``payload``.

    A record whose payload is missing, or whose header names another length, stops the job.
    """
    headers = spark.read.schema("header string, digest string").parquet(f"{path}/headers")
    kept = read_payloads(spark, path)
    kept = kept if with_payload else kept.drop("payload")
    named = F.col("header").contains(F.concat(F.lit(f"{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL)))
    joined = headers.join(kept, "digest", "left")
    whole = F.when(F.coalesce(named, F.lit(False)), F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("no payload for "), "digest"))
    )
    return joined.withColumn("payload_bytes", whole)


def record_bytes() -> Column:
    """The whole record as in a WARC file, with its payload put back."""
    return F.concat(F.encode("header", "UTF-8"), "payload", F.encode(F.lit(_EOL * 2), "UTF-8")).alias("record")


def record_fields(records: DataFrame, record: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as the headers say.

    With a column of whole records also ``record_bytes`` and ``record_digest``.
    """
    more = [F.octet_length(record).cast("long").alias("record_bytes"), F.sha2(record, 256).alias("record_digest")] if record else []

    def field(pattern: str) -> Column:
        return F.regexp_extract("header", pattern, 1)

    def number(value: Column) -> Column:
        return F.when(value.isin("", "null"), None).otherwise(value).cast("long")

    return records.select(
        number(field(r"\r\nWARC-Record-ID: <urn:page:([^>]*)>\r\n")).alias("page_id"),
        "payload_bytes",
        field(r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)\r\n").alias("payload_digest"),
        field(r"\r\nWARC-Type: (\w+)\r\n").alias("record_type"),
        number(field(r"\r\nWARC-Refers-To: <urn:page:([^>]*)>\r\n")).alias("refers_to"),
        *more,
    )
