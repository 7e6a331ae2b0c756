"""Strict checks of answer tables, and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.io import kept

ITEM_ID = "^[0-9a-f]{16}$"
CODES = (
    "invalid_header", "wrong_column_count", "invalid_query_id_length", "unknown_query_id", "duplicate_query_id", "invalid_answer_separator",
    "too_many_candidates", "duplicate_item_id", "invalid_item_id_format", "item_not_in_corpus", "missing_query_id", "wrong_row_count",
)


def answer_errors(answers: DataFrame, expected: DataFrame, corpus: DataFrame, k: int = 50, id_length: int = 16, item_pattern: str = ITEM_ID) -> DataFrame:
    """(code, example): one row an error of a table (row, query_id, answer, n_columns), answers being ids joined by one space.

    Empty answers are legal. Ids are compared as they stand: case matters. `expected` must have unique ids and `corpus`
    rows, or a ValueError tells so.
    """
    if expected.groupBy("query_id").count().where("count > 1").limit(1).count():
        raise ValueError("expected queries repeat")
    if not corpus.limit(1).count():
        raise ValueError("the corpus is empty")
    a = answers.withColumn("answer", F.coalesce("answer", F.lit("")))
    out = []
    add = lambda d, code, what: out.append(d.select(F.lit(code).alias("code"), what.cast("string").alias("example")))
    add(a.where(F.col("n_columns") != 2), "wrong_column_count", F.col("row"))
    a = a.where(F.col("n_columns") == 2)
    add(a.where(F.length("query_id") != id_length), "invalid_query_id_length", F.col("query_id"))
    add(a.join(expected.select("query_id"), "query_id", "left_anti"), "unknown_query_id", F.col("query_id"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("row"))
    add(a.withColumn("r", nth).where("r > 1"), "duplicate_query_id", F.col("query_id"))
    bad = F.col("answer").rlike(r"(^ )|( $)|  |[\t\r\n\f\x0B]")
    add(a.where(bad), "invalid_answer_separator", F.col("query_id"))
    ids = F.filter(F.split("answer", r"\s+"), lambda x: x != "")
    a = a.withColumn("ids", ids)
    add(a.where(F.size("ids") > k), "too_many_candidates", F.col("query_id"))
    add(a.where(F.size(F.array_distinct("ids")) < F.size("ids")), "duplicate_item_id", F.col("query_id"))
    each = a.select("row", F.explode("ids").alias("item_id"))
    wrong = ~F.col("item_id").rlike(item_pattern)
    add(each.where(wrong), "invalid_item_id_format", F.col("item_id"))
    add(each.where(~wrong).join(corpus.select("item_id").distinct(), "item_id", "left_anti"), "item_not_in_corpus", F.col("item_id"))
    add(expected.join(a.select("query_id"), "query_id", "left_anti"), "missing_query_id", F.col("query_id"))
    n = answers.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(expected.agg(F.count(F.lit(1)).alias("m"))))
    add(n.where("n <> m"), "wrong_row_count", F.col("n"))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def error_counts(errors: DataFrame, examples: int = 30) -> DataFrame:
    """(code, n, examples): counts, and the first examples by value. The window stops at the examples in each task, before
    the shuffle, so no task sorts all errors of a code."""
    n = errors.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    first = errors.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("example"))).where(F.col("r") <= examples)
    return n.join(first.groupBy("code").agg(F.sort_array(F.collect_list("example")).alias("examples")), "code", "left")


def candidate_stats(answers: DataFrame) -> DataFrame:
    n = F.when(F.coalesce("answer", F.lit("")) == "", 0).otherwise(F.size(F.split("answer", " "))).cast("long")
    return answers.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.sum(F.when(n == 0, 1).otherwise(0)).cast("long").alias("empty"))


def read_answers(spark, path: str) -> tuple[DataFrame, list[str]]:
    """(row, query_id, answer, n_columns) of a CSV with a header, and the header. Ids are never read as numbers."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿|\r$", ""))
    head = lines.first()
    header = head[0].split(",") if head else []
    body = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=True, schema="query_id string, answer string, rest string", mode="PERMISSIVE", quote='"', escape='"')
    n = F.when(F.col("rest").isNotNull(), 3).when(F.col("answer").isNull() & F.col("query_id").isNull(), 0).otherwise(2)
    return body.select(F.monotonically_increasing_id().alias("row"), "query_id", "answer", n.alias("n_columns")), header


def validate_answer(spark, path: str, expected: DataFrame, corpus: DataFrame, k: int = 50, id_length: int = 16, item_pattern: str = ITEM_ID) -> DataFrame:
    """error_counts() of a CSV file; a wrong header or bytes that aren't UTF-8 are one error of their own."""
    answers, header = read_answers(spark, path)
    errors = answer_errors(answers, expected, corpus, k, id_length, item_pattern)
    if header != ["query_id", "answer"]:
        errors = errors.union(spark.createDataFrame([("invalid_header", ",".join(header))], "code string, example string"))
    text = spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string")) if hasattr(F, "is_valid_utf8") else F.lit(False))
    return error_counts(errors.union(text.select(F.lit("invalid_utf8_or_csv").alias("code"), F.col("path").alias("example"))))


def id_fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """One row: the number of ids and a fingerprint of the set with multiplicities, whatever the order.

    A sum of hashes instead of one joined string, so no task ever holds all ids.
    """
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_distinct"), F.sum(h).cast("string").alias("fingerprint"))


def ordered_digest(rows: DataFrame, key: str, order: str, run: int = 1000) -> DataFrame:
    """One row (n, fingerprint) of the ids in the order of a column, by a tree of hashes: row order matters.

    Rows are numbered by ranges, each range by its own task from where the ones before it end. The SHA-256 of `run` ids
    joined by newlines is a leaf, that of `run` digests the next level, until one is left; no task holds more than a run
    of them. Ties go by the id, null ids count as empty, and no rows give the digest of nothing.
    """
    spark = rows.sparkSession
    r = rows.select(F.col(order).alias("o"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"))
    r = kept(r.repartitionByRange("o", "k").select("o", "k", F.spark_partition_id().alias("p")))
    ends = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = r.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(ends), F.lit(0))).select("p", "start")
    at = F.row_number().over(Window.partitionBy("p").orderBy("o", "k")) - 1
    level = r.withColumn("i", at).join(F.broadcast(starts), "p").select((F.col("start") + F.col("i")).alias("i"), "k")
    n = r.count()
    if not n:
        return spark.range(1).select(F.lit(0).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("fingerprint"))
    left = n
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "k"))), lambda x: x["k"]), "\n")
        level = level.groupBy(F.floor(F.col("i") / run).alias("g")).agg(F.sha2(joined, 256).alias("k")).select(F.col("g").alias("i"), "k")
        left = -(-left // run)
        if left == 1:
            return level.select(F.lit(n).cast("long").alias("n"), F.col("k").alias("fingerprint"))
        level = kept(level)


def ordered_fingerprint(rows: DataFrame, key: str, order: str) -> DataFrame:
    """ordered_digest() in runs of 1,000."""
    return ordered_digest(rows, key, order)


def finite_check(rows: DataFrame, columns: list[str]) -> DataFrame:
    bad = [F.sum(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1).otherwise(0)).cast("long").alias(f"bad_{c}") for c in columns]
    return rows.agg(F.count(F.lit(1)).alias("n"), *bad)


def bounds_check(pool: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """One row: pool rows of unknown queries and items, and repeated pairs."""
    a = pool.join(queries.select("query_id"), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_queries"))
    b = pool.join(items.select("item_id"), "item_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_items"))
    c = pool.groupBy("query_id", "item_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_pairs"))
    return a.crossJoin(b).crossJoin(c)
