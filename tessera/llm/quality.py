"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations read the bits. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, free_names, quoted, table

#: Name -> SQL condition of failure over the measurements; a rule's bit is its place. Rules are only ever appended.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 8 * word_chars",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "10 * word_chars < 15 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "exclaiming": "100 * n_marks > 40 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject a document.
POLICIES = {"v1": BASE, "v2": tuple(RULES)}
CURRENT = "v2"
WINDOW = 5


def mask_of(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of its whole texts (all long).

    n_words, word_chars, n_symbols (of `#*$%&|<>`), n_lines and n_dup_lines (lines with a word; equal to an earlier
    one), n_repeat_words (words in windows of WINDOW words that occur twice or more), n_marks (`!` and `?`). A null
    text measures as an empty one. All stays inside the row: nothing is shuffled, and rows that repeat are measured each.
    Columns of these names are replaced, all others pass through, whatever their names. An empty table stays empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks"]
    kept = docs.drop(*names)
    w, lines, grams, twice, m = free_names(kept, "words", "lines", "grams", "twice", "measured")
    blank = F.lit(" \t\n\x0b\f\r")
    d = kept.withColumn(w, F.array_remove(F.split(t, SPACE + "+"), ""))
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, blank)) > 0))
    # Windows by 64-bit hash with their places, sorted, so that equal ones are neighbours.
    each = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WINDOW))).alias("h"), i.alias("i")))
    d = d.withColumn(grams, F.when(F.size(w) > WINDOW, F.sort_array(each)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce(x["h"] == F.get(F.col(grams), k)["h"], F.lit(False))
    d = d.withColumn(twice, F.sort_array(F.transform(F.filter(grams, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # The words that sorted windows cover: each adds what lies beyond the window before it.
    covered = F.aggregate(F.transform(twice, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(s - F.get(F.col(twice), k - 1), F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    found = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(t, "[^!?]+", "")).cast("long").alias("n_marks"),
    )
    # A generator of one row: filters on measurements stay above it, and the optimizer can't copy the lambdas into them.
    d = d.withColumn(m, F.explode(F.array(found)))
    return d.select(*(F.col(quoted(c)) for c in kept.columns), *(F.col(f"{m}.{n}").alias(n) for n in names))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and `failed` (long): bit k is set where rule k of RULES fails. A column `failed` is replaced."""
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, cond in enumerate(RULES.values())]
    return measured(docs, text).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(led: DataFrame, policy: str = CURRENT, out: str = "kept") -> DataFrame:
    """The ledger with a boolean `out` (replaced, if there): no rule of the policy fails. Rules aren't evaluated again."""
    return led.withColumn(out, F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_alone): documents that each rule of a policy rejects, and those that no other rule of it rejects.

    The ledger shrinks to counts of its bit patterns first (at most 2^len(RULES) rows), which all rules then share.
    """
    mask = mask_of(POLICIES[policy])
    seen = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    e = seen.select("f", "n", F.explode(rules).alias("x"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return e.groupBy(F.col("x.rule").alias("rule")).agg(count(F.col("f").bitwiseAND(F.col("x.bit")) != 0).alias("n_failed"), count(F.col("f") == F.col("x.bit")).alias("n_alone"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE))) != 0
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


_BITS = " + ".join(f"CASE WHEN {cond} THEN {1 << k} ELSE 0 END" for k, cond in enumerate(RULES.values()))
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(i - p, 5))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^!?]+', '', 'g'))::BIGINT AS n_marks FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask_of(BASE)}) <> 0 AS base_failed, (failed & {mask_of(POLICIES[CURRENT])}) = 0 AS kept, failed FROM f"""
