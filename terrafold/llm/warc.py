"""A content-addressed WARC archive: payload bytes once, exact headers beside them, records again by joins.

``write_archive`` makes a record of every page, ``archive_records`` takes raw records; both store

* ``payloads``: each distinct payload once under its SHA-256, in a table bucketed by that digest. Payloads that share a
  digest are held against each other by length and SHA-1 before one of them is dropped; a difference is an error.
* ``headers``: every record's header block as it is, byte by byte, with the digest of its payload.

``read_archive`` joins both and gives the original records. Headers go to the payloads' buckets, so payloads aren't
shuffled; those that more than ``REFERENCES`` records share are dealt in as many copies as it takes, in the join only.
The digest of every payload that comes back is computed again; a wrong one is an error.

Of records with equal payloads the one with the smallest page_id is the response, the others are revisits of it. Rows
with the response's own page_id are responses as well, a null page_id counts as larger than all others, and payloads
of fewer than ``least`` bytes are always responses. Null html is an empty payload; a null url leaves its field out, control
characters in one are percent-encoded. An empty table gives an empty archive. Extra columns are ignored.
"""

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import shared_folder

#: Records that share a payload in one task of a join at most (on average).
REFERENCES = 500
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
#: Columns of the stored payloads.
STORED = "key binary, payload binary, first_id bigint, records bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_: Column) -> Column:
    """A hex string of 40 digits (SHA-1) in base 32: five digits make four letters."""
    letters = []
    for k in range(8):
        five = F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(five, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def field(header: Column, name: str) -> Column:
    """A header field's value, null where the header has none."""
    value = F.regexp_extract(header, f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(value != "", value)


def _key(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _store_payloads(rows: DataFrame, folder: str) -> DataFrame:
    """Stores the distinct payloads of rows (id, key, payload); gives key, first_id and records of each payload."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("id", "key", "payload", F.length("payload").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    one = rows.groupBy("key").agg(
        F.first("payload").alias("payload"), F.min("id").alias("first_id"), F.count("*").alias("records"),
        ((F.min("n_bytes") == F.max("n_bytes")) & (F.min("sha1") == F.max("sha1"))).alias("equal"),
    )
    one = one.withColumn("payload", F.when(F.col("equal"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one digest")))).drop("equal")
    at = f"{folder}/payloads"
    one.write.bucketBy(buckets, "key").option("path", at).saveAsTable(_name(folder))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/layout")
    return spark.read.schema(STORED).parquet(at).select("key", "first_id", "records")


def _name(folder: str) -> str:
    return f"payloads_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"


def _store_headers(rows: DataFrame, folder: str) -> None:
    """rows: id, key, header, records. Records that share a payload often are dealt into slots."""
    slots = F.greatest(F.lit(1), F.ceil(F.col("records") / REFERENCES)).cast("int")
    rows.select("id", "key", "header", slots.alias("slots"), F.floor(F.rand(7) * slots).cast("int").alias("slot")).write.parquet(f"{folder}/headers")


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, folder: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> str:
    """A record of every page (page_id, url, html) in a new folder; gives the folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), _bytes(F.coalesce("html", F.lit(""))).alias("payload")).withColumn("key", _key(F.col("payload")))
    stored = _store_payloads(rows.select("id", "key", "payload"), folder)
    thin = rows.select("id", "url", "key", F.length("payload").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    of = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    met = thin.join(stored, "key")
    revisit = (F.col("n_bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first_id"))
    url = F.col("url")
    for c in (*range(32), 127):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", of(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.when(revisit, of(F.col("first_id")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.col("n_bytes").cast("string")),
        F.lit(END),
    )
    _store_headers(met.select("id", "key", "records", _bytes(header).alias("header")), folder)
    return folder


def archive_records(records: DataFrame, folder: str) -> str:
    """Raw records (record_id long, record binary) in a new folder; gives the folder.

    The header ends with the first empty line; all that follows is the payload, so every record comes back as it was.
    A record without an empty line is a header only, a null one is empty.
    """
    raw = F.coalesce(F.col("record").cast("binary"), F.lit(b"").cast("binary"))
    end = F.locate(END * 2, F.decode("record", "ISO-8859-1"))
    head = F.when(end > 0, end + 3).otherwise(F.length("record"))
    rows = records.select(F.col("record_id").cast("long").alias("id"), raw.alias("record")).select("id", "record", head.alias("head"))
    rows = rows.select("id", F.substr("record", F.lit(1), F.col("head")).alias("header"), F.substr("record", F.col("head") + 1).alias("payload"))
    rows = rows.withColumn("key", _key(F.col("payload")))
    stored = _store_payloads(rows.select("id", "key", "payload"), folder)
    _store_headers(rows.select("id", "key", "header").join(stored, "key").select("id", "key", "records", "header"), folder)
    return folder


def _payload_table(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads with their buckets, also in a session that hasn't written them."""
    name = _name(folder)
    if not spark.catalog.tableExists(name):
        n = spark.read.parquet(f"{folder}/layout").first().buckets
        spark.sql(f"CREATE TABLE {name} ({STORED}) USING parquet OPTIONS (path '{folder}/payloads') CLUSTERED BY (key) INTO {n} BUCKETS")
    return spark.table(name).select("key", "payload", "records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """id, header, payload, record (binary) of every stored record."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), _payload_table(spark, folder)
    few = headers.filter("slots = 1").drop("slots", "slot").hint("shuffle_hash").join(payloads.filter(F.col("records") <= REFERENCES).drop("records"), "key")
    slots = F.sequence(F.lit(0), F.ceil(F.col("records") / REFERENCES).cast("int") - 1)
    dealt = payloads.filter(F.col("records") > REFERENCES).withColumn("slot", F.explode(slots)).drop("records")
    many = headers.filter("slots > 1").drop("slots").join(dealt, ["key", "slot"]).drop("slot")
    met = few.unionByName(many)
    whole = F.when(_key(F.col("payload")) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")))
    return met.select("id", "header", whole.alias("payload"))


def raw_record(records: DataFrame) -> DataFrame:
    """read_archive's rows with the whole record as one binary column."""
    return records.withColumn("record", F.concat("header", "payload"))


def archive_pages(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, out of the archive it was written to.

    Lengths and digests are those of the payloads that came back; types and references stand in the headers.
    """
    spark = pages.sparkSession
    folder = write_archive(pages, folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", least)
    back = read_archive(spark, folder).select("id", F.decode("header", "UTF-8").alias("header"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    refers = F.regexp_extract(field(F.col("header"), "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    back = back.select(F.col("id").alias("page_id"), "payload_bytes", base32(F.col("sha1")).alias("payload_digest"), field(F.col("header"), "WARC-Type").alias("record_type"), refers.cast("long").alias("refers_to"), field(F.col("header"), "WARC-Payload-Digest").alias("said"))
    right = F.when(F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header doesn't have its payload's digest")))
    return back.withColumn("payload_digest", right).drop("said")
