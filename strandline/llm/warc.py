"""A content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins.

Everything is DataFrame expressions. A payload's address is its SHA-256 together with its SHA-1 and
its length; WARC headers carry the SHA-1 in base32, as the format's revisit profile asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.work import dropped, new_path, saved

#: Payloads smaller than this are stored with every record and never revisited.
MIN_DEDUP_BYTES = 0
#: Rows of keys or addresses that are broadcast at most.
BROADCAST_ROWS = 500_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
EOL = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 upper-case base32 characters: five hexadecimal digits are four of base32."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), _DIGITS, _BASE32)


def addressed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows with payload and address. A null html is an empty payload, a null url an empty target."""
    base = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    return base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256), "payload_digest": base32_sha1(F.col("payload"))})


def records(base: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Of addressed rows, one record each, without payload: its address, type and exact header block.

    Of rows with equal payloads of at least min_bytes, the smallest key is the response and the others
    revisit it. A row with a null key revisits too where another has a key. Rows that share a key share a type.
    """
    address = ["sha256", "payload_digest", "payload_bytes"]
    base = base.select("key", "url", *address)
    joined = base.join(base.groupBy(*address).agg(F.min("key").alias("first")), address)
    revisit = (F.col("payload_bytes") >= min_bytes) & F.coalesce(F.col("key") != F.col("first"), F.col("first").isNotNull())
    out = joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))})
    return out.withColumn("header", header(F.col("key"), F.col("url"), F.col("payload_bytes"), F.col("payload_digest"), F.col("record_type"), F.col("refers_to"))).drop("first")


def header(key: Column, url: Column, size: Column, digest: Column, kind: Column, refers_to: Column) -> Column:
    """The record's header block, up to and with its empty line. A revisit's own block is empty."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit(EOL))
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", name(key)),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("X-Payload-Length", size.cast("string")),
        F.when(kind == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(kind == "revisit", line("WARC-Refers-To", name(refers_to))).otherwise(""),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit(EOL),
    )


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_DEDUP_BYTES) -> None:
    """Writes the archive: ``path/payloads`` (sha256, payload) once per address, ``path/headers`` (key, header, sha256).

    Headers are settled from addresses alone. The payloads of responses are then written where they were read:
    the keys and addresses of revisits are broadcast if they are few enough, else joined. Only addresses that several
    responses share (repeated rows, null keys, payloads under min_bytes) carry payloads through a shuffle.
    """
    spark = pages.sparkSession
    base = addressed(pages, key, url, html)
    made = saved(records(base, min_bytes), "warc-records", path=f"{path}/records")
    made.select("key", "header", "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    revisits = made.where("record_type = 'revisit' and key is not null").select("key", "sha256").distinct()
    shared = saved(made.where("record_type = 'response' or key is null").groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256"), "warc-shared", path=f"{path}/shared")
    payloads = base.select("key", "sha256", "payload")
    own = payloads.join(small(revisits), ["key", "sha256"], "left_anti").join(small(shared), "sha256", "left_anti").select("sha256", "payload")
    if shared.head(1):
        own = own.union(payloads.join(small(shared), "sha256", "left_semi").groupBy("sha256").agg(F.first("payload").alias("payload")))
    own.write.option("compression", "zstd").parquet(f"{path}/payloads")
    dropped(spark, f"{path}/records")
    dropped(spark, f"{path}/shared")


def read(spark, path: str) -> DataFrame:
    """Reads an archive back: every record's header with its payload, rebuilt by a join on the address.

    Columns: key, header, record (the exact bytes as they stand in a WARC file; a revisit has none of the
    payload), payload (of the record it refers to), payload_bytes and payload_digest (both computed from the stored bytes), and
    record_type, url and refers as the rebuilt record's header block states them. Fails on a payload whose digest or length isn't what
    its address and its header state, and on a record without payload, whichever of these columns are asked for.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    stored = stored.withColumns({"intact": F.sha2("payload", 256) == F.col("sha256"), "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    out = spark.read.parquet(f"{path}/headers").join(stored, "sha256", "left")
    revisit = F.col("header").startswith(f"WARC/1.1{EOL}WARC-Type: revisit{EOL}")
    body = F.when(revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    out = out.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(EOL * 2), "UTF-8")))
    head = F.decode(F.substring(F.col("record"), F.lit(1), F.octet_length("header")), "UTF-8")
    field = lambda label: F.regexp_extract("_head", rf"(?md)^{label}: ([^\r\n]*)\r$", 1)
    out = out.withColumn("_head", head)
    good = F.col("intact") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (field("X-Payload-Length") == F.col("payload_bytes").cast("string"))
    damaged = F.raise_error(F.concat(F.lit("payload of record "), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(" is damaged")))
    checked = lambda c: F.when(F.coalesce(good, F.lit(False)), c).otherwise(damaged)
    return out.select("key", "header", "record", checked(F.col("payload")).alias("payload"), checked(F.col("payload_bytes")).alias("payload_bytes"), checked(F.col("payload_digest")).alias("payload_digest"), checked(field("WARC-Type")).alias("record_type"), field("WARC-Target-URI").alias("url"), F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1).alias("refers"))


def write_files(archive: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """Writes an archive that was read as WARC files; payloads are UTF-8, so a record is one text value ending in CR LF CR LF."""
    text = F.decode("record", "UTF-8")
    archive.select(F.substring(text, F.lit(1), F.length(text) - 1).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def archive_path(spark) -> str:
    return new_path(spark, "warc")
