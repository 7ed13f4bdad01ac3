"""Inputs that Spark derives from the given tables, each with the same derivation as a SQL twin.

They stand in for the click log, request log, cache table, second crawl and chunk lineage that the
given tables do not hold directly; every one covers the whole table it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import load, load_spread

PROP_K = "cast(json_extract_string(props, '$.k') as bigint)"

CLICKS_SQL = f"""clicks as (select event_id, ts, 'topic ' || cast({PROP_K} // 10 as varchar) query, {PROP_K} chunk_id,
  cast({PROP_K} % 10 as integer) position, user_id session_id, value dwell_time from events where event_type = 'click')"""


def clicks(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").filter("event_type = 'click'").select(
        "event_id", "ts",
        F.concat(F.lit("topic "), F.floor(k / 10).cast("string")).alias("query"),
        k.alias("chunk_id"),
        (k % 10).cast("int").alias("position"),
        F.col("user_id").alias("session_id"),
        F.col("value").alias("dwell_time"),
    )


REQUESTS_SQL = """requests as (select event_id, ts, user_id, event_type endpoint,
  case when event_type = 'error' then 500 else 200 end status_code, value / 1000 response_time from events)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", "ts", "user_id",
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 1000).alias("response_time"),
    )


# second crawl: toxic documents are gone, low-quality ones were edited, benchmark texts are new
V2_SQL = """documents_v2 as (
  select d.doc_id, case when l.quality = 0 then text || ' rev' else text end text, lang, source
  from documents d left join labels l using (doc_id) where coalesce(l.toxic, 0) = 0
  union all select 1000000000 + item_id, text, 'en', 'benchmark' from benchmark)"""


def documents_v2(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels")
    edited = F.when(F.col("quality") == 0, F.concat("text", F.lit(" rev"))).otherwise(F.col("text"))
    kept = (
        load(spark, d, "documents").join(labels, "doc_id", "left")
        .filter(F.coalesce("toxic", F.lit(0)) == 0)
        .select("doc_id", edited.alias("text"), "lang", "source")
    )
    new = load(spark, d, "benchmark").select(
        (F.col("item_id") + 1000000000).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("benchmark").alias("source")
    )
    return kept.unionByName(new)


# stored documents with processing state: labelled ones were processed, by quality
STATE_SQL = """doc_state as (select doc_id, 'https://docs.example.org/' || source || '/' || doc_id url, source, lang, text,
  case quality when 1 then 'v2.0' when 0 then 'v1.0' end processing_version,
  case quality when 1 then timestamp '2024-01-01 12:00:00' when 0 then timestamp '2024-01-01 00:10:00' end last_processed_at
  from documents left join labels using (doc_id))"""


def document_state(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("https://docs.example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "source", "lang", "text",
        F.when(q == 1, "v2.0").when(q == 0, "v1.0").alias("processing_version"),
        F.when(q == 1, F.lit("2024-01-01 12:00:00")).when(q == 0, F.lit("2024-01-01 00:10:00"))
        .cast("timestamp_ntz").alias("last_processed_at"),
    )


# one chunk per line of a document; lineage from the line's length and the document's language
CHUNKS_SQL = """chunk_lines as (select doc_id, lang, n_chars, unnest(string_split(text, chr(10))) content,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 chunk_index from documents),
chunks as (select doc_id document_id, chunk_index, doc_id || '_' || lpad(cast(chunk_index as varchar), 4, '0') chunk_id, content,
  case when length(content) < 60 then null when length(content) < 120 then 'v0.9.0' else 'v1.0.0' end chunker_version,
  case lang when 'en' then 'all-MiniLM-L6-v2' when 'fr' then 'legacy-model' when 'de' then 'all-MiniLM-L6-v2' end embedding_model,
  case when lang = 'es' then null else timestamp '2024-01-01 00:00:00' + to_seconds(n_chars) end processing_timestamp,
  vec_id is not null has_embedding
  from chunk_lines left join embeddings on vec_id = doc_id)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    lang, size = F.col("lang"), F.length("content")
    vec = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_embedding"))
    lines = load(spark, d, "documents").join(vec, "doc_id", "left").select(
        "doc_id", "lang", "n_chars", "has_embedding", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")
    )
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=F.col("n_chars"))
    return lines.select(
        F.col("doc_id").alias("document_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"),
        "content",
        F.when(size < 60, None).when(size < 120, "v0.9.0").otherwise("v1.0.0").alias("chunker_version"),
        F.when(lang == "fr", "legacy-model").when(lang.isin("en", "de"), "all-MiniLM-L6-v2").alias("embedding_model"),
        F.when(lang != "es", stamp).alias("processing_timestamp"),
        F.coalesce("has_embedding", F.lit(False)).alias("has_embedding"),
    )


# Markdown rendering of every document: preamble, h1, h2 with the body, h3
MD_SQL = """md as (select doc_id, 'Imported from ' || source || chr(10) || chr(10) || '# Document ' || doc_id || chr(10) || chr(10)
  || '## ' || upper(lang) || ' text' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10)
  || '### Size' || chr(10) || chr(10) || n_chars || ' characters' || chr(10) body from documents)"""


def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        F.lit("Imported from "), "source", F.lit("\n\n# Document "), F.col("doc_id").cast("string"), F.lit("\n\n## "),
        F.upper("lang"), F.lit(" text\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n### Size\n\n"),
        F.col("n_chars").cast("string"), F.lit(" characters\n"),
    )
    return load_spread(spark, d, "documents", "doc_id").select("doc_id", body.alias("body"))


CACHE_SQL = f"""puts as (select 'search:' || user_id || ':' || {PROP_K} cache_key, event_id, ts, event_type, value from events),
cache as (select cache_key, ts accessed_at, ts + to_seconds(case when event_type in ('view', 'click') then 1800 else 3600 end * 24) expires_at, value
  from (select *, row_number() over (partition by cache_key order by ts desc, event_id desc) rn from puts) where rn = 1),
moment as (select max(ts) as_of from events)"""


def cache_puts(spark: SparkSession, d: str) -> DataFrame:
    """Writes to the result cache: views and clicks live 12 hours, other kinds 24 hours."""
    k = F.get_json_object("props", "$.k")
    ttl = F.when(F.col("event_type").isin("view", "click"), 1800 * 24).otherwise(3600 * 24)
    return load(spark, d, "events").select(
        F.concat_ws(":", F.lit("search"), F.col("user_id").cast("string"), k).alias("cache_key"),
        "event_id", F.col("ts").alias("accessed_at"),
        (F.col("ts") + F.make_interval(secs=ttl)).alias("expires_at"), "value",
    )
