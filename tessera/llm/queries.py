"""The thin contract queries of this subpackage's operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common, ann, archive, decontaminate, html, mixing, passages, periodic, pii, simhash, token_output, toxicity, urls, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL contract.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


#: For these queries alone: a key that is written down hides nothing.
EXAMPLE_KEY = "tessera-example-key"


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is that of the label with its id: good if its quality is 1
    and it isn't toxic."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    judged = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "reputation")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, threshold=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_output.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.checksums(token_output.read(spark, path))


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1: rows whose labels are never looked at."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, from which both fields are taken; revisits
    from headers alone. Each read pushes its record type down to the source."""
    path = archive.write(_table(spark, sf_dir, "pages"))
    full = archive.read(spark, path).where("record_type = 'response'")
    again = archive.read(spark, path, payload=False).where("record_type = 'revisit'")
    page = archive.page_of(F.col("record_id")).alias("page_id")
    responses = full.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = again.select(page, F.col("payload_length").alias("payload_bytes"), F.substring("payload_digest", len("sha256:") + 1, 64).alias("payload_digest"), "record_type", archive.page_of(F.col("refers_to")).alias("refers_to"))
    return responses.unionByName(revisits)


def drop_one(doc_id: str, run: str) -> str:
    """The contract's misspellings: one run in 31 of a document loses a letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 31 else run[:at] + run[at + 1 :]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(_table(spark, sf_dir, "documents"), least_length=7, least_count=2, edit=drop_one)
    return variants.group(words, ratio=10)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The contract's texts: of one document in ten, what follows word a repeats the words
    from a to a + p - 1. A null id leaves its text alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10).cast("long"))

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.call_function("div", n - a, 3 + g % 8)
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), _common.let(words, repeated)).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")), least=6, exponent=4)
    by_length = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    longest = F.get(F.array_sort(by_length), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length = -F.col("longest.less")
    return told.select("doc_id", "n_runs", F.col("longest.start").alias("start"), length.alias("length"), F.col("longest.period").alias("period"), F.call_function("div", length * 1000, F.col("longest.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.deduplicate(_table(spark, sf_dir, "documents"), window=35)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_reputation, op2_nearest, op3_pii, op4_mixing, op5_simhash, op6_html_text, op7_token_output, op8_toxicity, op9_decontaminate, op10_warc, op11_spelling_variants, op12_periodic_runs, op13_substring_dedup)}

#: What DuckDB can express.
ORACLES: dict[str, str] = {
    "op1_url_reputation": urls.oracle(URL_RULES, "pages", "select doc_id as id, (quality = 1 and toxic = 0)::int as good from labels where doc_id is not null and quality is not null and toxic is not null"),
    "op9_decontaminate": r"""
with d as (select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
s as (select item_id, ws, least(10, len(ws)) as size from i where len(ws) > 0),
windows as (select distinct item_id, size, array_to_string(list_slice(ws, p, p + size - 1), ' ') as w from (select *, unnest(range(1, len(ws) - size + 2)) as p from s)),
grams as (select row_id, p, size, array_to_string(list_slice(ws, p, p + size - 1), ' ') as w from (select row_id, ws, size, unnest(range(1, len(ws) - size + 2)) as p from d, (select distinct size from s) where len(ws) >= size)),
hits as (select row_id, p, g.size, item_id from grams g join windows x on x.w = g.w and x.size = g.size),
places as (select row_id, count(distinct p + k) as n_hit from (select row_id, p, unnest(range(0, size)) as k from hits) group by row_id),
named as (select row_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hits where item_id is not null group by row_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (row_id) left join named using (row_id)""",
    "op10_warc": """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as least from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, d.payload_digest, case when least < page_id then 'revisit' else 'response' end as record_type,
  case when least < page_id then least end as refers_to
from d left join f on d.payload_digest = f.payload_digest""",
}
