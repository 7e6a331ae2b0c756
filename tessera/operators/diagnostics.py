"""Why relevant items were missed: tags, counts and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_tags() -> Column:
    """Tags of a missed item against the query's first distractor: rank, location, same, lexical, title_coverage, semantic
    and class of the item; d_location, d_same, d_lexical, d_semantic and d_class of the distractor (without one, null
    counts as 0, and classes aren't compared). Outside the pool (null rank) only that is said."""
    c = F.col
    zero = lambda n: F.coalesce(c(n).cast("double"), F.lit(0.0))
    tags = F.array(
        F.when((c("rank") > 50) & (c("rank") <= 100), F.lit("close_rank")),
        F.when(~c("location").eqNullSafe(c("d_location")) | (zero("same") != zero("d_same")), F.lit("location_difference")),
        F.when((c("lexical") < 0.20) | ((c("title_coverage") < 0.25) & (c("lexical") + 0.25 < zero("d_lexical"))), F.lit("low_lexical")),
        F.when((c("semantic") < 0.15) | (c("semantic") + 0.15 < zero("d_semantic")), F.lit("low_semantic")),
        F.when(c("class") != c("d_class"), F.lit("class_difference")),
    )
    found = F.filter(tags, lambda x: x.isNotNull())
    return F.when(c("rank").isNull(), F.array(F.lit("candidate_miss"))).when(F.size(found) == 0, F.array(F.lit("other_ranking"))).otherwise(found)


def missed(ranked: DataFrame, truth: DataFrame, k: int = 50, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """Relevant items not ranked k or better, with their rank (null outside the pool)."""
    j = truth.select(q, item).distinct().join(ranked.select(q, item, "rank"), [q, item], "left")
    return j.where(F.col("rank").isNull() | (F.col("rank") > k))


def missed_in_order(ranked: DataFrame, truth: DataFrame, k: int = 50, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """missed() with `place`: from 1 in each query, by rank, those outside the pool last, ties by id."""
    w = Window.partitionBy(q).orderBy(F.coalesce("rank", F.lit(10**9)), item)
    return missed(ranked, truth, k, q, item).withColumn("place", F.row_number().over(w).cast("long"))


def first_distractor(ranked: DataFrame, truth: DataFrame, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """The best ranked item of each query that isn't relevant."""
    w = Window.partitionBy(q).orderBy("rank")
    return ranked.join(truth.select(q, item).distinct(), [q, item], "left_anti").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def tag_counts(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    return tagged.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def mean_features(positives: DataFrame, distractors: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, positive, distractor): means of both groups."""
    rows = positives.select(F.lit("p").alias("g"), *columns).union(distractors.select(F.lit("d").alias("g"), *columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    e = rows.select("g", F.explode(pairs).alias("y")).select("g", "y.feature", "y.x")
    return e.groupBy("feature").agg(F.avg(F.when(F.col("g") == "p", F.col("x"))).alias("positive"), F.avg(F.when(F.col("g") == "d", F.col("x"))).alias("distractor"))


def feature_map(columns: list[str]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c).cast("double") for c in columns)))


def error_groups(tagged: DataFrame, subset: str = "subset", cls: str = "class", tags: str = "tags") -> DataFrame:
    """(subset, tag, class, n): missed items by subset and tag, by tag and class, by tag and by subset, from one pass; "all"
    stands where a column isn't grouped by, and null classes are "none". Items of several tags count in each, but once in
    the groups without a tag."""
    e = tagged.select(F.col(subset).alias("subset"), F.coalesce(F.col(cls).cast("string"), F.lit("none")).alias("class"), F.explode(F.concat(F.array(F.lit(None).cast("string")), tags)).alias("tag"))
    g = e.groupingSets([["subset", "tag"], ["tag", "class"], ["tag"], ["subset", "class", "tag"]], "subset", "class", "tag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set"))
    every = lambda c, bit: F.when(F.col("set").bitwiseAND(bit) > 0, F.lit("all")).otherwise(F.col(c)).alias(c)
    return g.select(every("subset", 4), F.coalesce("tag", F.lit("all")).alias("tag"), every("class", 2), "n")


def error_examples(tagged: DataFrame, per_tag: int = 3, q: str = "query_id", item: str = "item_id", tags: str = "tags") -> DataFrame:
    """The first missed items of each tag, by rank (those outside the pool last), then query and item: rows of tagged with
    `tag` and `place`."""
    w = Window.partitionBy("tag").orderBy(F.coalesce("rank", F.lit(10**9)), q, item)
    return tagged.withColumn("tag", F.explode(tags)).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= per_tag)


def report(counts: DataFrame, means: DataFrame, title: str = "Errors", metrics: DataFrame | None = None, groups: DataFrame | None = None, examples: DataFrame | None = None) -> str:
    """Markdown of small tables: tags, mean features, and if given the models' metrics (name, metric columns), the groups
    of error_groups() and the examples of error_examples()."""
    number = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    def lines(heading: str, columns: list[str], rows: list) -> list[str]:
        head = ["", f"## {heading}", ""] if heading else [""]
        return [*head, "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(number(r[c]) for c in columns) + " |" for r in rows)]

    out = [f"# {title}"]
    if metrics is not None:
        out += lines("Models", metrics.columns, metrics.orderBy(metrics.columns[0]).collect())
    out += lines("", ["tag", "n"], counts.orderBy(F.desc("n"), "tag").collect())
    out += lines("", ["feature", "positive", "distractor"], means.orderBy("feature").collect())
    if groups is not None:
        out += lines("Groups", ["subset", "tag", "class", "n"], groups.orderBy("subset", "tag", "class").collect())
    if examples is not None:
        out += lines("Examples", ["tag", "place", "query_id", "item_id", "rank"], examples.orderBy("tag", "place").collect())
    return "\n".join(out) + "\n"
