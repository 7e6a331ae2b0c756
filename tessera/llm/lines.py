"""Line dedup: an exact set-similarity join over lines that removes later matches. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SMALL_ROWS, discard, free_names, materialize, quoted, sized, table

K, PERCENT = 5, 80
#: Lines with more tokens than this are verified by a join of pairs instead of with their tokens beside each posting.
LONG = 512
#: Places of shingles from which on a line tries to make do with a part of its tokens.
MANY = 16
#: White space inside a line that isn't a blank.
OTHER_SPACE = "\t\x0b\f\r"


def _has_word(line):
    """Trimming the left side alone stops at the first character of a word."""
    return F.ltrim(line, F.lit(" \n" + OTHER_SPACE)) != ""


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, pos, line, h1, h2): lines with a word, with blanks for their white space (lines that are equal then
    have the same tokens); row tells texts of one key apart, h1 and h2 are the line's identity."""
    # Replacing goes through every byte once for each character; few texts have one of them.
    odd = reduce(Column.__or__, (F.contains(F.col(text), F.lit(c)) for c in OTHER_SPACE))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), OTHER_SPACE, F.col(text))
    d = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.posexplode(F.split(F.when(odd, plain).otherwise(F.col(text)), "\n")).alias("pos", "line"))
    d = d.where(F.ltrim("line") != "")
    return d.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def line_tokens(line, k: int = K):
    """Expressions (words, tokens of `words`) of a line whose white space is blanks: distinct hashes of the k-word
    shingles, or of all words where there are fewer."""
    words = F.array_remove(F.split(F.lower(line), " "), "")  # splitting at one character takes no regular expression

    def tokens(w):
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.array_distinct(F.when(F.size(w) >= k, each).otherwise(F.array(F.xxhash64(w))))

    return words, tokens


def _prefix(n, percent: int):
    """Tokens to index: two sets of that similarity share one of them, whatever the order."""
    return n - F.ceil(n * percent / 100.0 - 1e-9).cast("int") + 1


def _least(n):
    """Shared tokens that the screen asks of sets of that size; grows with n and is never above it."""
    return F.lit(1) + (n >= 8).cast("int") + (n >= 16).cast("int")


def _heads(lines: DataFrame, k: int, percent: int) -> DataFrame:
    """(h1, least, tok): the tokens of each line (h1, line) that the screen goes by, and how many of them another line
    has to have.

    Tokens are ordered by the sign of their first word's hash, then by their own. A line with enough of negative sign
    makes only these. Sets that match share their m first common tokens inside prefixes of _prefix() + m - 1, for any m
    up to their intersection; places of shingles are counted for the size, which is no less, and what a line sends for
    the size where it has to be no more.
    """
    sign = -(1 << 63)
    d = lines.select("h1", F.array_remove(F.split(F.lower("line"), " "), "").alias("w"))
    # A line of less than k words has no places: its words are hashed together.
    d = d.select("h1", F.when(F.size("w") >= k, F.transform("w", lambda x: F.xxhash64(x))).otherwise(F.array(F.xxhash64("w"))).alias("h"), F.greatest(F.size("w") - k + 1, F.lit(0)).alias("places"))
    size = F.greatest("places", F.lit(1))
    d = d.select("h1", "h", "places", (_prefix(size, percent) + _least(size) - 1).alias("p"))

    def shingle(i):
        return F.xxhash64(*(F.get("h", i + j) for j in range(k)))

    some = F.transform("h", lambda x, i: F.when((x < 0) & (i < F.col("places")), shingle(i).bitwiseOR(F.lit(sign))))
    every = F.transform(F.slice("h", F.lit(1), F.col("places")), lambda x, i: F.when(x < 0, shingle(i).bitwiseOR(F.lit(sign))).otherwise(shingle(i).bitwiseAND(F.lit(~sign))))
    d = d.select("h1", "h", "places", "p", F.when(F.col("places") >= MANY, F.array_distinct(F.array_compact(some))).alias("some"))
    full = F.when(F.col("places") == 0, F.col("h")).otherwise(F.array_distinct(every))
    d = d.select("h1", F.slice(F.sort_array(F.when(F.size("some") >= F.col("p"), F.col("some")).otherwise(full)), F.lit(1), F.col("p")).alias("t"))
    # From explode() Spark infers a filter, which makes all of the above once more.
    return d.select("h1", _least(F.ceil(F.size("t") * percent / 100.0 - 1e-9)).cast("byte").alias("least"), F.explode_outer("t").alias("tok"))


def _near(kept: DataFrame, percent: int) -> DataFrame:
    """(h1, h2) of the lines in `kept` (id, h1, h2, at, toks), all distinct, that match an earlier one; deletes `kept`.

    Tokens go in order of rarity among these lines, ties by hash; those of the prefix that occur twice are indexed. What
    occurs once stands first in that order and in no intersection, so it only counts: it never travels. Two lines that
    match share their first common token inside both prefixes; nothing before it is common, so the tokens after it
    decide, and only they stand beside a posting.
    """
    common = kept.select("id", F.explode("toks").alias("tok")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("tok"))).where("df > 1")
    g = common.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("t"))
    g = g.select("id", F.col("t.tok").alias("t")).join(kept.select("id", "h1", "h2", "at", F.size("toks").alias("n")), "id")
    g = materialize(g.where(F.size("t") * 100 >= F.col("n") * percent))  # an intersection has no other tokens
    discard(kept)
    posts = g.select("id", "at", "n", F.size("t").alias("m"), "t", F.posexplode("t").alias("i", "tok")).withColumn("p", F.col("n") - F.col("m") + F.col("i"))
    posts = posts.where(F.col("p") < _prefix(F.col("n"), percent))

    def fits(x, y):
        c = lambda t, n: F.col(f"{t}.{n}")
        n = c(x, "n") + c(y, "n")
        # What lies before and after the shared token can't add more than that to the intersection.
        most = F.least(c(x, "p"), c(y, "p")) + F.least(c(x, "n") - c(x, "p"), c(y, "n") - c(y, "p"))
        return (c(x, "tok") == c(y, "tok")) & (c(y, "at") < c(x, "at")) & (F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * percent) & (most * (100 + percent) >= n * percent)

    # A semi join stops at the first match and returns each posting once at most: no pairs of a group of copies.
    short = posts.where(F.col("m") <= LONG).select("id", "at", "n", "p", "tok", F.slice("t", F.col("i") + 2, F.col("m")).alias("tail"))
    x, y = short.alias("x"), short.alias("y")
    both = 1 + F.size(F.array_intersect("x.tail", "y.tail"))
    # The ids say nothing new, but with them both sides need the same columns, and so one shuffle.
    found = x.join(y, fits("x", "y") & (F.col("x.id") != F.col("y.id")) & (both * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent), "left_semi").select("id")
    # Lines with many common tokens would stand beside too many postings: their pairs meet first, then their tokens.
    thin = posts.select("id", "at", "n", "m", "p", "tok")
    x, y = thin.where(F.col("m") > LONG).alias("x"), thin.alias("y")
    one = x.join(y, fits("x", "y")).select(F.col("x.id").alias("id"), F.col("y.id").alias("other"))
    x, y = thin.where(F.col("m") <= LONG).alias("x"), thin.where(F.col("m") > LONG).alias("y")
    two = x.join(y, fits("x", "y")).select(F.col("x.id").alias("id"), F.col("y.id").alias("other"))
    full = g.select("id", "n", "t")
    pairs = one.union(two).distinct().join(full, "id").join(full.toDF("other", "on", "ot"), "other")
    alike = F.size(F.array_intersect("t", "ot")) * (100 + percent) >= (F.col("n") + F.col("on")) * percent
    out = materialize(g.select("id", "h1", "h2").join(found.union(pairs.where(alike).select("id")).distinct(), "id", "left_semi").select("h1", "h2").distinct())
    discard(g)
    return out


def removed_lines(docs: DataFrame, k: int = K, percent: int = PERCENT, key: str = "doc_id", text: str = "text", small_rows: int = SMALL_ROWS) -> DataFrame:
    """(doc, row, positions): the places (from 0) of the lines to remove; row is xxhash64 of the text.

    A line is removed if any line before it, in the order of key (null first), hash of the text and place, is similar:
    the Jaccard similarity of their token sets is at least percent / 100. Tokens are the line's distinct k-word shingles
    (lower case), or all of its words as one token where there are fewer than k; lines without a word are neither
    removed nor compared.

    Equal lines become one line first. Screening: every line's prefix under an order by hash goes by token; lines of
    which too few of these tokens stand in another line drop out, without loss. The join by rarity runs on the rest.
    """
    at = F.struct("doc", "row", "pos")
    lines = _lines(docs, key, text)
    places = materialize(lines.drop("line"))
    twice = materialize(places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    copies = materialize(places.join(sized(twice, small_rows), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(at).alias("first")))
    # Rows that repeat a key and its text repeat their lines at the same places, and no place comes before itself.
    once = lines.withColumn("at", at).join(sized(copies, small_rows), ["h1", "h2"], "left").where(F.col("first").isNull() | F.col("first").eqNullSafe(F.col("at")))
    by = Window.partitionBy("tok").orderBy("tok")  # any order does
    heads = _heads(once, k, percent).withColumn("before", F.lag("least").over(by)).withColumn("after", F.lead("least").over(by))
    hits = heads.where(F.coalesce("before", "after").isNotNull()).groupBy("h1").agg(F.count(F.lit(1)).alias("c"), F.min("least").alias("least"))
    alive = materialize(hits.where("c >= least").select("h1"))
    words, tokens = line_tokens(F.col("line"), k)
    kept = once.join(sized(alive, small_rows), "h1", "left_semi").select("h1", "h2", "at", words.alias("w")).select("h1", "h2", "at", tokens(F.col("w")).alias("toks"))
    kept = materialize(kept.withColumn("id", F.monotonically_increasing_id()))
    near = _near(kept, percent).withColumn("near", F.lit(True))
    gone = materialize(copies.join(near, ["h1", "h2"], "full").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    discard(twice, copies, alive)
    out = places.withColumn("at", at).join(sized(gone, small_rows), ["h1", "h2"]).where(F.col("near") | ~F.col("first").eqNullSafe(F.col("at")))
    return out.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def dedup_lines(docs: DataFrame, k: int = K, percent: int = PERCENT, key: str = "doc_id", text: str = "text", small_rows: int = SMALL_ROWS) -> DataFrame:
    """docs with `text` cut to the lines kept, and n_lines (with a word) and n_removed (long), as removed_lines() says.

    Null texts stay null with no lines; lines without a word stay; a text all of whose lines go becomes empty. Rows
    that repeat key and text lose the same lines. Other columns pass through, whatever their names; only columns
    n_lines and n_removed are replaced. An empty table stays empty.
    """
    gone = materialize(removed_lines(docs.select(key, text), k, percent, key, text, small_rows))
    d = docs.drop("n_lines", "n_removed")
    doc, row, cuts = free_names(d, "doc", "row", "cuts")
    g = sized(gone, small_rows).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("positions").alias(cuts))
    j = d.join(g, F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(row)), "left")
    every = F.split(F.col(text), "\n")
    cut = F.array_join(F.filter(every, lambda x, i: ~F.array_contains(cuts, i)), "\n")
    n = F.size(F.filter(every, _has_word))
    lines = F.when(F.col(text).isNull(), 0).otherwise(n).cast("long")
    changed = F.when(F.col(cuts).isNull(), F.col(text)).otherwise(cut)
    return j.select(*(changed.alias(c) if c == text else F.col(quoted(c)) for c in d.columns), lines.alias("n_lines"), F.coalesce(F.size(cuts), F.lit(0)).cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
one AS (SELECT w, min((doc_id, pos)) AS place FROM w WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT place, list_slice(w, i, i + {K - 1}) AS t FROM (SELECT place, w, unnest(range(1, greatest(len(w) - {K - 1}, 1) + 1)) AS i FROM one)),
n AS (SELECT place, count(*) AS n FROM s GROUP BY place),
shared AS (SELECT x.place AS a, y.place AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND y.place < x.place GROUP BY ALL),
near AS (SELECT DISTINCT a FROM shared JOIN n p ON p.place = a JOIN n q ON q.place = b WHERE c * {100 + PERCENT} >= (p.n + q.n) * {PERCENT}),
f AS (SELECT w.*, len(w.w) > 0 AS has, len(w.w) > 0 AND (one.place <> (doc_id, pos) OR near.a IS NOT NULL) AS gone FROM w LEFT JOIN one ON one.w = w.w LEFT JOIN near ON near.a = one.place)
SELECT doc_id, (count(*) FILTER (WHERE has))::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
FROM f GROUP BY doc_id"""
