"""Pages into WARC archives, equal payloads once.

Of records with equal payloads of at least ``LEAST`` bytes that with the smallest id is the
response, the others are revisits that refer to it and carry no payload. Digests are counted
first, so payloads don't move: those of digests seen twice or more are looked up in a
broadcast table while that has at most ``BROADCAST_DIGESTS`` rows (of some 150 bytes), else
joined, a join adaptive execution can split; a payload that a third of all pages share is
one row of that table.

Edge cases: null html is an empty payload; a very long page is one record; null ids come
after all others and get record ids from their row's place; of repeated rows one is the
response; shorter payloads are responses each; an empty table makes an empty archive. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from ._common import bound_batches, new_path, numbered, written

#: Payloads from so many bytes on are stored once; what record ids begin with.
LEAST, URN, ROW_URN = 100, "urn:page:", "urn:row:"
BROADCAST_DIGESTS = 400_000


def _urn(id_: Column, row: Column) -> Column:
    return F.coalesce(F.concat(F.lit(URN), id_.cast("string")), F.concat(F.lit(ROW_URN), row["file"].cast("string"), F.lit(":"), row["at"].cast("string")))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """One WARC record per page, in the columns the data source writes."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    base = numbered(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias(html_col)), "warc-pages", "row").withColumn("payload", payload)
    base = base.select("id", "url", "payload", "row", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    first = base.where(F.col("length") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first"))
    first = written(first.where("n > 1").select("digest", "first"), "warc-digests")
    rows = base.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "digest", "left")
    again = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("id"), F.col("row")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(again, _urn(F.col("first.id"), F.col("first.row"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(record_id: Column) -> Column:
    """The page id in a record's id; null for pages without one."""
    return F.when(record_id.startswith(URN), F.substring(record_id, len(URN) + 1, 40).cast("long"))


def write(pages: DataFrame, path: str | None = None, mode: str = "append", **how) -> str:
    """Archive ``pages``; the folder's path. ``append`` adds to what is there."""
    spark = pages.sparkSession
    warc.register(spark)
    bound_batches(spark)
    path = path or new_path(spark, "warc")
    records(pages, **how).write.format("warc").mode(mode).save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    warc.register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
