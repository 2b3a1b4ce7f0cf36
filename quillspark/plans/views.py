"""Knowledge-shaped views over the supplied tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What tells a table's state from a later one: bytes, files and the folder's time."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        held = files.getContentSummary(path)
        out.append((name, held.getLength(), held.getFileCount(), files.getFileStatus(path).getModificationTime()))
    return tuple(out)


def spread(frame: DataFrame) -> DataFrame:
    """A frame read from one file, dealt out for heavy work on texts. A table of many files is left as it is: it is read
    in enough parts already."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if len(frame.inputFiles()) == 1 else frame


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.concat(F.lit("kb://corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("uri"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.col("lang").alias("type"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("body"),
        "doc_id",
    )


DOC_PAGES = """doc_pages AS (SELECT 'kb://corpus/' || source || '/' || doc_id || '.md' AS uri, source || '/' || doc_id || '.md' AS path,
  substr(split_part(text, chr(10), 1), 1, 60) AS title, lang AS type, [lang, source] AS tags, text AS body, doc_id, source FROM documents)"""


def doc_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust facts of the labelled documents."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rated = pages.join(table(spark, sf_dir, "labels"), "doc_id")
    at = lambda days: F.date_format(F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7 + days) % 700 * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rated.select(
        F.concat(F.lit("kb://corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("uri"),
        F.when(F.col("toxic") == 1, "retired").otherwise("active").alias("status"),
        F.col("quality").cast("double").alias("confidence"),
        F.col("lang").alias("type"),
        F.array("lang", "source").alias("tags"),
        "source",
        F.when(F.col("n_chars") > 2000, "core").otherwise("edge").alias("tier"),
        F.when(F.col("doc_id") % 3 == 0, at(0)).alias("valid_from"),
        F.when(F.col("doc_id") % 6 == 0, at(90)).alias("valid_until"),
        F.when(F.col("doc_id") % 3 == 1, at(30)).when(F.col("doc_id") % 5 == 2, F.lit("2024-05-01")).alias("observed_at"),
        F.lit(None).cast("string").alias("occurred_at"),
        F.lit(None).cast("string").alias("committed_at"),
        "doc_id",
        "n_chars",
    )


_AT = "strftime(to_timestamp(1704067200 + (doc_id * 7 + {d}) % 700 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"
DOC_TRUST = f"""doc_trust AS (SELECT 'kb://corpus/' || source || '/' || doc_id || '.md' AS uri, CASE WHEN toxic = 1 THEN 'retired' ELSE 'active' END AS status,
  quality::DOUBLE AS confidence, lang AS type, [lang, source] AS tags, source, CASE WHEN n_chars > 2000 THEN 'core' ELSE 'edge' END AS tier,
  CASE WHEN doc_id % 3 = 0 THEN {_AT.format(d=0)} END AS valid_from, CASE WHEN doc_id % 6 = 0 THEN {_AT.format(d=90)} END AS valid_until,
  CASE WHEN doc_id % 3 = 1 THEN {_AT.format(d=30)} WHEN doc_id % 5 = 2 THEN '2024-05-01' END AS observed_at, doc_id, n_chars
  FROM documents JOIN labels USING (doc_id))"""


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges along foreign keys: customers and suppliers to nations, nations to regions, orders to customers and parts."""
    parts = [
        ("nation", "nation:", "n_nationkey", "region:", "n_regionkey", "in_region"),
        ("customer", "customer:", "c_custkey", "nation:", "c_nationkey", "in_nation"),
        ("supplier", "supplier:", "s_suppkey", "nation:", "s_nationkey", "in_nation"),
        ("orders", "order:", "o_orderkey", "customer:", "o_custkey", "placed_by"),
        ("lineitem", "order:", "l_orderkey", "part:", "l_partkey", "contains"),
    ]
    out = None
    for name, a, x, b, y, relation in parts:
        own = table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("from_uri"), F.concat(F.lit(b), F.col(y).cast("string")).alias("to_uri"), F.lit(relation).alias("relation"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("raw", F.col("to_uri"))


FK_EDGES = """fk_edges AS (SELECT 'nation:' || n_nationkey AS from_uri, 'region:' || n_regionkey AS to_uri, 'in_region' AS relation FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem)"""


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by path, with their host's rank among sources as precedence."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = F.regexp_extract("url", r"^https?://([^/]+)/", 1), F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"), F.concat(F.lit("kb://"), host, F.lit("/"), path, F.lit("?"), F.col("page_id").cast("string")).alias("uri"), (F.col("page_id") % 7).alias("precedence"))


WEB_PAGES = r"""web_pages AS (SELECT *, 'kb://' || host || '/' || path || '?' || page_id AS uri, page_id % 7 AS precedence FROM
  (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^?]*)', 1) AS path FROM pages))"""


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-relative links of each page: (from_uri, to_uri), as paths on the page's host."""
    pages = spread(table(spark, sf_dir, "pages"))
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    links = pages.select("page_id", host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return links.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("from_uri"), F.concat("host", "href").alias("to_uri"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: an observed version of what a user did of a kind."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("source_id"), F.col("ts").alias("observed_at"), F.col("props").alias("raw_payload"), F.col("event_id").alias("key"), (F.col("event_id") % 10 == 0).alias("tombstone"), "value")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence"), F.col("role").alias("kind"), F.col("text").alias("content"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a revision of its user's page."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("string").alias("path"),
        F.col("event_id").alias("ordinal"),
        F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("revision"),
        F.when(F.col("event_id") % 11 == 0, "archived").when(F.col("event_id") % 13 == 0, "retired").otherwise("active").alias("status"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("kb://x/"), (F.col("event_id") % 4).cast("string"))).alias("successor"),
        (F.col("event_id") % 3).cast("string").alias("origin"),
    )


REVISIONS = """revisions AS (SELECT user_id::VARCHAR AS path, event_id AS ordinal, event_type || '/' || event_id AS revision,
  CASE WHEN event_id % 11 = 0 THEN 'archived' WHEN event_id % 13 = 0 THEN 'retired' ELSE 'active' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'kb://x/' || (event_id % 4) END AS successor, (event_id % 3)::VARCHAR AS origin FROM events)"""


def vec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("uri"), F.col("vec_id").alias("chunk"), "embedding")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("title"), F.lit(None).cast("array<string>").alias("aliases"), F.col("p_type").alias("type"), F.array("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(" ")))).alias("tags"))


IDENTITIES = "identities AS (SELECT 'part:' || p_partkey AS uri, p_name AS title, p_type AS type, [p_brand, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE replace(p_brand, '#', ' ') END] AS tags FROM part)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code symbols: named by the part, in a document by brand."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("document_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.when(F.col("p_size") % 2 == 0, "go").otherwise("python").alias("language"))


SYMBOLS = "symbols AS (SELECT 's' || p_partkey AS id, p_brand AS document_id, p_name AS name, p_brand || '.' || p_name AS qualified_name, CASE WHEN p_size % 2 = 0 THEN 'go' ELSE 'python' END AS language FROM part)"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types as what their symbols refer to: by name for some, by qualified name, or to nothing known."""
    part = table(spark, sf_dir, "part")
    target = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).when(F.col("p_partkey") % 5 == 1, F.concat("p_brand", F.lit("."), "p_name")).otherwise(F.concat(F.lit("none."), F.col("p_partkey").cast("string")))
    return part.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("doc"), F.col("p_partkey").cast("string")).alias("document_id"), F.concat("p_brand", F.lit("."), "p_name").alias("source"), target.alias("target"))


RELATIONS = "relations AS (SELECT 'r' || p_partkey AS id, 'doc' || p_partkey AS document_id, p_brand || '.' || p_name AS source, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 5 = 1 THEN p_brand || '.' || p_name ELSE 'none.' || p_partkey END AS target FROM part)"
