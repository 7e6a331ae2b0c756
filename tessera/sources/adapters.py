"""The generated tables in the roles of items, queries, events, places and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search
from tessera.sources.io import kept

TOK = r"regexp_extract_all(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[\p{{L}}\p{{N}}]+')"


def tok(c: str) -> str:
    return TOK.format(c=c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", "lang", "source", "n_chars")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of three fields: the first 80 characters, language and source, and the text."""
    return documents(spark, sf_dir).select("item_id", F.substring("text", 1, 80).alias("title"), F.concat_ws(" ", "lang", "source").alias("params"), F.col("text").alias("description"), F.col("source").alias("class"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item_id): documents that hold a whole passage.

    A substring test has no equi-key, so each document is offered the passages that share its rarest-looking, that is
    longest, inner word: an exact filter, for a document that holds the passage holds that word between separators.
    """
    inner = lambda c: F.slice(F.split(c, " "), F.lit(2), F.greatest(F.size(F.split(c, " ")) - 2, F.lit(0)))
    q = benchmark(spark, sf_dir).withColumn("w", inner(F.col("text")))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    q, few = search.small(q.select("query_id", F.col("text").alias("passage"), longest.alias("word")))
    d = documents(spark, sf_dir).select("item_id", "text")
    word = F.explode(F.array_distinct(F.split("text", " "))).alias("word")
    if few:  # they go to the documents, whose texts then needn't travel
        near = d.select("item_id", "text", word).join(q, "word")
    else:
        named = d.select("item_id", word).join(q.select("query_id", "word"), "word")
        near = named.select("query_id", "item_id").join(d, "item_id").join(q.select("query_id", "passage"), "query_id")
    short = d.join(q.where("word IS NULL"), F.contains(F.col("text"), F.col("passage"))).select("query_id", "item_id")
    return near.where(F.contains(F.col("text"), F.col("passage"))).select("query_id", "item_id").union(short)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))  # before the lines, which are many more
    j = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        F.col("p_name").alias("text"), F.col("c_nationkey").cast("long").alias("search_location"), F.col("s_nationkey").cast("long").alias("item_location"), F.col("l_partkey").alias("item_id"),
        F.col("p_brand").alias("class"), F.col("p_type").alias("category"), F.col("c_mktsegment").alias("filters"), F.col("p_retailprice").alias("price"), F.col("l_suppkey").alias("seller"),
    )


EVENTS = """ev AS (SELECT p_name AS text, c_nationkey::BIGINT AS search_location, s_nationkey::BIGINT AS item_location, l_partkey AS item_id, p_brand AS class, p_type AS category, c_mktsegment AS filters, p_retailprice AS price, l_suppkey AS seller
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def coordinates(rows: DataFrame) -> DataFrame:
    """Coordinates made from the place and the seller, for tables that have none."""
    return rows.withColumn("lat", F.lit(30.0) + F.col("item_location") * 1.5 + (F.col("seller") % 7) * 0.01).withColumn("lon", F.lit(5.0) + F.col("item_location") * 2.25 + (F.col("seller") % 5) * 0.02)


COORDINATES = "30e0 + item_location * 15e-1 + (seller % 7) * 1e-2 AS lat, 5e0 + item_location * 225e-2 + (seller % 5) * 2e-2 AS lon"


def scored(spark: SparkSession, sf_dir: str, of: tuple = ("source", "n_chars")) -> DataFrame:
    """(query_id, item_id, bm25, cov, source, n_chars): all documents that share a token with a passage, with token coverage;
    with an empty `of` the pairs don't meet the documents again.

    The terms that matched were counted with the score, so no document is tokenised again.
    """
    d, q = documents(spark, sf_dir), benchmark(spark, sf_dir)
    s = search.bm25_search(d, q).where("score > 0").withColumnRenamed("score", "bm25")
    qt = q.select("query_id", F.size(F.array_distinct(T.tokens(F.col("text")))).alias("asked"))
    j = s.join(qt, "query_id")
    j = j.join(d.select("item_id", *of), "item_id") if of else j
    return j.select("query_id", "item_id", "bm25", F.round(F.col("matched").cast("double") / F.greatest("asked", F.lit(1)), 6).alias("cov"), *of)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() with every document's rank, written once: queries that read it several times don't score again.

    For queries whose windows are over a passage's whole list; those that take the best of it start from scored(), which
    Spark cuts before it shuffles.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "item_id")).cast("long")
    return kept(scored(spark, sf_dir).withColumn("rank", rank).select("query_id", "item_id", "bm25", "cov", "rank", "source", "n_chars"))


POOL_CTE = rf"""d AS (SELECT doc_id AS item_id, source, n_chars, {tok('text')} AS tok FROM documents),
q AS (SELECT item_id AS query_id, list_distinct({tok('text')}) AS qt FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(tok)) AS mean FROM d),
qterm AS (SELECT query_id, unnest(qt) AS term FROM q),
tf AS (SELECT item_id, term, any_value(l) AS l, count(*) AS tf FROM (SELECT item_id, len(tok) AS l, unnest(tok) AS term FROM d) GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, item_id, ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 22e-1 / (tf + 12e-1 * ((1e0 - 75e-2) + 75e-2 * l / mean))) AS w FROM tf JOIN df USING (term), st),
bm AS (SELECT query_id, item_id, round(sum(w), 6) AS bm25 FROM qterm JOIN w USING (term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, item_id) AS rank FROM bm WHERE bm25 > 0),
pool AS (SELECT query_id, item_id, bm25, round(len(list_intersect(qt, list_distinct(tok)))::DOUBLE / greatest(len(qt), 1), 6) AS cov, rank, source, n_chars FROM top JOIN q USING (query_id) JOIN d USING (item_id)),
truth AS (SELECT b.item_id AS query_id, doc_id AS item_id FROM documents, benchmark b WHERE contains(documents.text, b.text))"""
