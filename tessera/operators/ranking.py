"""Per-query windows: pool features, standardisation, fusion, selection. All windows share one key, so one shuffle serves them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import finite, logit

Q, I = "query_id", "item_id"


def _w(q: str = Q):
    return Window.partitionBy(q)


def percentile(s: Column, q: str = Q) -> Column:
    """1 for the best score of the pool, ties sharing it, 0 for the last; 1 in a pool of one."""
    return F.lit(1.0) - F.percent_rank().over(_w(q).orderBy(s.desc()))


def gap_best(s: Column, q: str = Q) -> Column:
    return s - F.max(s).over(_w(q))


def gap_kth(s: Column, k: int = 50, q: str = Q) -> Column:
    """Against the k-th score, or the last of a smaller pool."""
    whole = _w(q).orderBy(s.desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return s - F.coalesce(F.nth_value(s, k).over(whole), F.min(s).over(_w(q)))


def augment(pool: DataFrame, sources: list[str], q: str = Q) -> DataFrame:
    """pool with pool_percentile_, pool_gap_best_ and pool_gap_50_ of every source; non-finite scores count as -1e20."""
    out = {}
    for c in sources:
        s = finite(F.col(c))
        out |= {f"pool_percentile_{c}": percentile(s, q), f"pool_gap_best_{c}": gap_best(s, q), f"pool_gap_50_{c}": gap_kth(s, 50, q)}
    return pool.withColumns(out)


#: Different scores of all queries, by source, up to which a table of them is broadcast.
SMALL_SCORES = 500_000


def augment_counted(pool: DataFrame, sources: list[str], q: str = Q) -> DataFrame:
    """augment() from how often a query has each score: these counts are put in order, and the pool's rows, which may be
    many more, meet what comes of them. No list of a query is sorted or sent unless its scores are nearly all different."""
    from tessera.operators.search import small
    from tessera.sources.io import kept

    c = F.col
    value = {x: finite(c(x)) for x in sources}
    each = F.array(*(F.struct(F.lit(x).alias("source"), v.alias("value")) for x, v in value.items()))
    n = kept(pool.select(q, F.explode(each).alias("x")).select(q, "x.*").groupBy(q, "source", "value").agg(F.count(F.lit(1)).alias("n")))
    one = Window.partitionBy(q, "source")
    before = F.coalesce(F.sum("n").over(one.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = n.withColumn("before", before).withColumn("all", F.sum("n").over(one))
    percentile = F.lit(1.0) - F.when(c("all") > 1, c("before").cast("double") / (c("all") - 1)).otherwise(F.lit(0.0))
    kth = F.coalesce(F.max(F.when(c("before") + c("n") >= 50, c("value"))).over(one), F.min("value").over(one))
    t = kept(t.select(q, "source", "value", percentile.alias("p"), (c("value") - F.max("value").over(one)).alias("b"), (c("value") - kth).alias("k")))
    for x, v in value.items():
        own = t.where(c("source") == x).select(F.col(q).alias("__q"), c("value").alias("__v"), c("p").alias(f"pool_percentile_{x}"), c("b").alias(f"pool_gap_best_{x}"), c("k").alias(f"pool_gap_50_{x}"))
        own, _ = small(own, SMALL_SCORES)
        pool = pool.join(own, (c(q) == c("__q")) & (v == c("__v"))).drop("__q", "__v")
    return pool


def zscore(s: Column, q: str = Q) -> Column:
    return (s - F.avg(s).over(_w(q))) / F.greatest(F.stddev_pop(s).over(_w(q)), F.lit(1e-6))


def reciprocal(s: Column, tie: Column, constant: int = 60, q: str = Q) -> Column:
    return F.lit(1.0) / (F.row_number().over(_w(q).orderBy(s.desc(), tie.asc())) + constant)


def relative(s: Column, q: str = Q) -> Column:
    """Against the query's best over the whole channel: compute it before pooling."""
    return s / F.greatest(F.max(s).over(_w(q)), F.lit(1e-6))


def max_normalize(s: Column, q: str = Q) -> Column:
    m = F.max(s).over(_w(q))
    return F.when(m > 0, s / m).otherwise(F.lit(0.0))


def min_rank(s: Column, q: str = Q) -> Column:
    """1 for the best score; equal scores share the least rank."""
    return F.rank().over(_w(q).orderBy(s.desc())).cast("long")


def softmax(s: Column, temperature: float = 1.0, q: str = Q) -> Column:
    e = F.exp((s - F.max(s).over(_w(q))) / temperature)
    return e / F.sum(e).over(_w(q))


def against_best(scores: DataFrame, out: str = "score", q: str = Q, score: str = "score") -> DataFrame:
    """scores with `out`: the share of the query's best score, 0 where that isn't positive. The best comes by an aggregate,
    so a query's whole list of matches never stands in one window."""
    best = scores.groupBy(q).agg(F.max(score).alias("__best"))
    return scores.join(best, q).withColumn(out, F.when(F.col("__best") > 0, F.col(score) / F.col("__best")).otherwise(F.lit(0.0))).drop("__best")


def ranks_of(scores: DataFrame, wanted: DataFrame, score: str = "score", q: str = Q, item: str = I, steps: int = 1024) -> DataFrame:
    """(query, item, rank) of the wanted pairs, few of each query: their places in the query's whole list of positive scores,
    ties to smaller ids. Rows are counted by steps of the query's best score, and only rows of a wanted pair's own step are
    put in order, so the whole list is neither sorted nor sent."""
    from tessera.operators.search import small

    best, _ = small(scores.groupBy(q).agg(F.max(score).alias("__best")))
    wanted, _ = small(wanted.select(q, item).distinct())
    s = scores.where(F.col(score) > 0).select(q, item, score).join(best, q).withColumn("__step", F.floor(F.col(score) / F.col("__best") * steps))
    counts = s.groupBy(q, "__step").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(_w(q).orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1))
    above, _ = small(counts.select(q, "__step", F.coalesce(before, F.lit(0)).alias("above")))
    own, _ = small(s.join(wanted, [q, item], "left_semi").select(q, "__step").distinct())
    place = F.row_number().over(Window.partitionBy(q, "__step").orderBy(F.desc(score), item))
    r = s.join(own, [q, "__step"], "left_semi").withColumn("__place", place).join(above, [q, "__step"])
    return r.select(q, item, (F.col("above") + F.col("__place")).cast("long").alias("rank")).join(wanted, [q, item], "left_semi")


def ranged_ranks(scores: DataFrame, columns: dict[str, str], q: str = Q, item: str = I, rows: int = 500_000) -> DataFrame:
    """scores with the place (long) of every row in its query's whole list, for each (name of the place: score column), ties to
    smaller items. Rows are dealt by ranges of that order, of about so many rows each; places are counted inside a range,
    from the sizes of those before it. No list stands in one task, however many rows a query or a score has."""
    from tessera.operators.search import small
    from tessera.sources.io import kept

    scores = kept(scores)
    n = max(scores.sparkSession.sparkContext.defaultParallelism, -(-scores.count() // rows))
    for name, c in columns.items():
        ranges = kept(scores.repartitionByRange(n, F.col(q), F.desc(c), F.col(item)).withColumn("__range", F.spark_partition_id()))
        before = F.sum("n").over(_w(q).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        above, _ = small(ranges.groupBy(q, "__range").agg(F.count(F.lit(1)).alias("n")).select(q, "__range", F.coalesce(before, F.lit(0)).alias("__above")))
        place = F.row_number().over(Window.partitionBy(q, "__range").orderBy(F.desc(c), item))
        scores = kept(ranges.withColumn(name, place).join(above, [q, "__range"]).withColumn(name, (F.col("__above") + F.col(name)).cast("long")).drop("__range", "__above"))
    return scores


def top_k(scores: DataFrame, k: int, score: str = "score", q: str = Q, tie: str = I, positive: bool = True) -> DataFrame:
    """The k best rows of each query with `rank` (long): ties to smaller ids; Spark limits before the shuffle."""
    s = scores.where(F.col(score) > 0) if positive else scores
    return s.withColumn("rank", F.row_number().over(_w(q).orderBy(F.desc(score), tie)).cast("long")).where(F.col("rank") <= k)


def assert_unique(df: DataFrame, keys: list[str], what: str = "candidates") -> None:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"Duplicate {what} by {', '.join(keys)}")


def legal_top(scores: DataFrame, legal: DataFrame, k: int = 50, score: str = "score", q: str = Q, item: str = I, check: bool = True) -> DataFrame:
    """The k best legal items of each query; legality is applied first. Duplicate candidates are an error."""
    if check:
        assert_unique(scores, [q, item])
    return top_k(scores.withColumn(score, finite(F.col(score))).join(legal.select(item).distinct(), item, "left_semi"), k, score, q, item, positive=False)


def answer_rows(ranked: DataFrame, q: str = Q, item: str = I) -> DataFrame:
    """(query_id, answer): ids by rank, joined by one space."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("i")))), lambda x: x["i"])
    return ranked.groupBy(q).agg(F.concat_ws(" ", ids).alias("answer"))


def zblend(a: Column, b: Column, weight: float, q: str = Q) -> Column:
    return zscore(a, q) * weight + zscore(b, q) * (1.0 - weight)


def rrf(a: Column, b: Column, tie: Column, weight: float = 0.5, constant: int = 60, q: str = Q) -> Column:
    return reciprocal(a, tie, constant, q) * weight + reciprocal(b, tie, constant, q) * (1.0 - weight)


def probability_average(a: Column, b: Column, weight: float = 0.5) -> Column:
    return a * weight + b * (1.0 - weight)


def logit_average(a: Column, b: Column, weight: float = 0.5) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit(a) * weight + logit(b) * (1.0 - weight))))


def reserve_history(base: DataFrame, context: DataFrame, text: DataFrame, most_context: int = 25, most: int = 10, k: int = 50, q: str = Q, item: str = I) -> DataFrame:
    """Known items first: up to most_context of the same context, then of the same text until `most` are reserved, then the base order.

    All three hold (query_id, item_id, rank). One window per query over their tagged union; an item keeps its first place.
    """
    c = context.withColumn("n", F.row_number().over(_w(q).orderBy("rank", item))).where(F.col("n") <= most_context)
    t = text.join(c.select(q, item), [q, item], "left_anti")
    have = c.groupBy(q).agg(F.count(F.lit(1)).alias("have"))
    t = t.withColumn("n", F.row_number().over(_w(q).orderBy("rank", item))).join(have, q, "left").where(F.col("n") <= F.greatest(F.lit(most) - F.coalesce("have", F.lit(0)), F.lit(0)))
    parts = [x.select(q, item, "rank", F.lit(i).alias("tier")) for i, x in enumerate((c, t, base))]
    first = parts[0].union(parts[1]).union(parts[2]).groupBy(q, item).agg(F.min(F.struct("tier", "rank")).alias("at"))
    out = first.withColumn("rank", F.row_number().over(_w(q).orderBy("at", item)).cast("long"))
    return out.where(F.col("rank") <= k).select(q, item, "rank", F.col("at.tier").cast("long").alias("tier"))


def within_quotas(scores: DataFrame, columns: dict[str, str], quotas: dict[str, int], q: str = Q, steps: int = 1024) -> DataFrame:
    """The rows of scores that a channel (name: column) may take for its quota: none of those is left out, and few others
    stay. Rows are counted by steps of the query's best score in each channel; nothing is sorted, and only counts travel."""
    from tessera.operators.search import small

    value = {n: F.col(c).cast("double") for n, c in columns.items()}
    best, _ = small(scores.groupBy(q).agg(*(F.max(v).alias(f"__best_{n}") for n, v in value.items())))
    s = scores.join(best, q).withColumns({f"__step_{n}": F.when(v > 0, F.floor(v / F.col(f"__best_{n}") * steps)) for n, v in value.items()})
    each = F.array(*(F.struct(F.lit(n).alias("channel"), F.col(f"__step_{n}").alias("step")) for n in columns))
    counts = s.select(q, F.explode(each).alias("x")).select(q, "x.*").where("step IS NOT NULL").groupBy(q, "channel", "step").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(q, "channel").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    open_ = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    cuts, _ = small(open_.groupBy(q).agg(*(F.min(F.when((F.col("channel") == n) & (F.col("before") < quotas[n]), F.col("step"))).alias(f"__cut_{n}") for n in columns)))
    taken = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"__step_{n}") >= F.col(f"__cut_{n}"), F.lit(False)) for n in columns))
    return s.join(cuts, q).where(taken).select(*scores.columns)


def union_channels(channels: DataFrame, quotas: dict[str, int], q: str = Q, item: str = I) -> DataFrame:
    """Candidates of a long table (query, item, channel, score): each channel's quota per query, then the distinct pairs with their channels."""
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    most = max(quotas.values())  # a literal bound, by which Spark limits before the shuffle
    r = F.row_number().over(Window.partitionBy(q, "channel").orderBy(F.desc("score"), item))
    s = channels.where(F.col("channel").isin(list(quotas)) & (F.col("score") > 0)).withColumn("r", r).where((F.col("r") <= most) & (F.col("r") <= quota[F.col("channel")]))
    return s.groupBy(q, item).agg(F.array_sort(F.collect_set("channel")).alias("channels"))
