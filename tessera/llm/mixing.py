"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_names, parts, quoted, table

#: Shares of the mixture's characters; sources not named, and null ones, share OTHER.
WEIGHTS = {"src0": 2.0} | {f"src{i}": 1.0 for i in range(1, 20)}
OTHER = 1.0
SEED = 17
#: Copies that one task makes of a row.
SPLIT = 4096


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """(first, [P(X <= first), P(X <= first + 1), ...]) as far as doubles tell the values from 0 and 1."""
    spread = 12 * math.sqrt(rate) + 40
    first, last = max(0, math.floor(rate - spread)), math.ceil(rate + spread)
    total, out = 0.0, []
    for k in range(first, last + 1):
        total += math.exp(-rate + (k * math.log(rate) if k else 0) - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        out.append(total)
        if total >= 1.0:
            break
    return first, out


def repetition_rates(docs: DataFrame, weights: dict[str, float], other: float, source: str = "source", size=None) -> dict[str | None, float]:
    """Mean number of copies for each named source, and for all the rest under None; the mixture is as large as docs.

    Sources without any text get no share: the weights of the others are scaled up. The result has as many entries as
    the caller's weights and one more, so it may come to the driver.
    """
    bucket = F.when(F.col(source).isin(list(weights)), F.col(source))
    size = F.length("text") if size is None else size
    have = {r[0]: r[1] or 0 for r in docs.groupBy(bucket.alias("b")).agg(F.sum(size).alias("n")).collect()}
    total = sum(have.values())
    asked = {b: (other if b is None else weights[b]) for b, n in have.items() if n}
    scale = sum(asked.values())
    return {b: (asked[b] / scale * total / n if n and scale else 0.0) for b, n in have.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with every row repeated by a Poisson count whose mean is its source's repetition rate, in a global shuffle.

    The count inverts the Poisson distribution at a number in [0, 1) hashed from the key and the seed, so it's the same
    in every run and on every retry. Added columns: copy (from 1) and shuffle_key, a hash of key, copy and seed; rows
    go to partitions by that hash and are sorted by it inside. Rows with the same key get the same count. Null keys
    hash as the empty string, null sources count as not named, null texts have size 0. Columns copy and shuffle_key of
    the input are replaced, all others pass through, whatever their names. An empty table stays empty.
    """
    spark, weights = docs.sparkSession, WEIGHTS if weights is None else weights
    docs = docs.drop("copy", "shuffle_key")
    rates = repetition_rates(docs, weights, other, source)
    rest, bucket, u, first, cdf, n, start = free_names(docs, "rest", "bucket", "u", "first", "cdf", "n", "start")
    table_of = spark.createDataFrame([(b or "", b is None, *poisson_cdf(r)) for b, r in rates.items()], f"{bucket} string, {rest} boolean, {first} int, {cdf} array<double>")
    other_source = ~F.coalesce(F.col(quoted(source)).isin(list(weights)), F.lit(False))
    name = F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))
    at = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"|{seed}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    # At most len(weights) + 1 rows are broadcast.
    out = docs.withColumns({rest: other_source, bucket: F.when(other_source, F.lit("")).otherwise(F.col(quoted(source))), u: at}).join(F.broadcast(table_of), [rest, bucket])
    out = out.withColumn(n, F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))).where(F.col(n) > 0).drop(rest, bucket, u, first, cdf)
    few = out.where(F.col(n) <= SPLIT).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    # A row of a tiny source can have very many copies: several tasks make them.
    many = out.where(F.col(n) > SPLIT).withColumn(start, F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(SPLIT)))).repartition(parts(spark), start, quoted(key))
    many = many.withColumn("copy", F.explode(F.sequence(F.col(start) + 1, F.least(F.col(start) + SPLIT, F.col(n))))).drop(start)
    out = few.union(many).withColumn("shuffle_key", F.md5(F.concat(name, F.lit("|"), F.col("copy").cast("string"), F.lit(f"|{seed}"))))
    return out.select(*(F.col(quoted(c)) for c in docs.columns), "copy", "shuffle_key").repartition(parts(spark), "shuffle_key").sortWithinPartitions("shuffle_key")


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", "copy", "shuffle_key", "text")


def _sql() -> str:
    names = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())
    return f"""
WITH RECURSIVE w(b, w) AS (VALUES {names}, (NULL, {OTHER}::DOUBLE)),
d AS (SELECT d.*, w.b FROM documents d LEFT JOIN w ON d.source = w.b),
have AS (SELECT b, sum(coalesce(length(text), 0))::DOUBLE n FROM d GROUP BY b),
asked AS (SELECT have.b, n, w.w FROM have JOIN w ON have.b IS NOT DISTINCT FROM w.b WHERE n > 0),
rate AS (SELECT b, w / (SELECT sum(w) FROM asked) * (SELECT sum(n) FROM asked) / n r FROM asked),
term AS (SELECT b, k, exp(-r + k * ln(r) - lgamma(k + 1)) p FROM rate, range(0, 200) t(k)),
cdf AS (SELECT b, k, sum(p) OVER (PARTITION BY b ORDER BY k) c FROM term),
u AS (SELECT doc_id, source, text, b, ('0x' || substr(md5(concat(doc_id, '|{SEED}')), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE u FROM d),
n AS (SELECT u.doc_id, u.source, u.text, count(*) FILTER (WHERE c <= u) n FROM u JOIN cdf ON u.b IS NOT DISTINCT FROM cdf.b GROUP BY ALL)
SELECT doc_id, source, copy::INTEGER AS copy, md5(concat(doc_id, '|', copy, '|{SEED}')) AS shuffle_key, text
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) copy FROM n)"""


SQL = _sql()
