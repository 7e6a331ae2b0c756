"""Metrics, comparisons, splits, validation and diagnostics."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diagnostics, features, metrics, ranking, split, validate
from tessera.operators.search import small
from tessera.plans import retrieval
from tessera.queries import query
from tessera.sources.adapters import EVENTS, POOL_CTE, documents, events, pool, scored, table, truth
from tessera.sources.io import kept

_RECALL = """pq AS (SELECT query_id, count(*) AS n_relevant, count(p.item_id) AS n_found, count(p.item_id)::DOUBLE / count(*) AS recall FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN (SELECT query_id, item_id FROM pool WHERE {0}) p USING (query_id, item_id) GROUP BY query_id)"""


@query(f"WITH {POOL_CTE}, {_RECALL.format('rank <= 50')} SELECT query_id, n_relevant::BIGINT AS n_relevant, n_found::BIGINT AS n_found, round(recall, 6) AS recall FROM pq")
def recall_at_50(spark, sf):
    best = ranking.top_k(scored(spark, sf), 50, "bm25")
    return metrics.recall_per_query(best, truth(spark, sf)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {POOL_CTE}, {_RECALL.format('rank <= 1')} SELECT count(*)::BIGINT AS n_queries, round(avg(recall), 6) AS recall, round(avg(recall) FILTER (WHERE query_id % 3 = 0), 6) AS recall_cold, round(avg(recall) FILTER (WHERE query_id % 3 <> 0), 6) AS recall_warm FROM pq""")
def recall_summary(spark, sf):
    m = metrics.summarize(metrics.recall_per_query(ranking.top_k(scored(spark, sf), 1, "bm25"), truth(spark, sf), 1).withColumn("cold", F.col("query_id") % 3 == 0))
    return m.select("n_queries", *(F.round(c, 6).alias(c) for c in ("recall", "recall_cold", "recall_warm")))


@query(f"""WITH {POOL_CTE}, {retrieval.UNION_CTE}, pq AS (SELECT query_id, count(u.item_id)::DOUBLE / count(*) AS recall FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN un u USING (query_id, item_id) GROUP BY query_id)
SELECT count(*)::BIGINT AS n_queries, round(avg(recall), 6) AS ceiling FROM pq""")
def candidate_ceiling(spark, sf):
    """Of the union of all channels."""
    u = retrieval.candidate_union(spark, sf)
    return metrics.ceiling(u, truth(spark, sf)).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("ceiling"))


@query(f"""WITH {POOL_CTE}, cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, item_id) AS r2 FROM pool), t AS (SELECT DISTINCT * FROM truth),
dl AS (SELECT query_id, (count(*) FILTER (WHERE r2 <= 10) - count(*) FILTER (WHERE rank <= 10))::DOUBLE / any_value(n) AS d FROM (SELECT t.*, count(*) OVER (PARTITION BY t.query_id) AS n, rank, r2 FROM t LEFT JOIN cr USING (query_id, item_id)) GROUP BY query_id)
SELECT count(*)::BIGINT AS n_queries, round(avg(d), 6) AS delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS standard_error, count(*) FILTER (WHERE d > 1e-12) AS improved, count(*) FILTER (WHERE d < -1e-12) AS worsened FROM dl""")
def paired_delta(spark, sf):
    t, p = kept(truth(spark, sf)), scored(spark, sf)
    a, b = (metrics.recall_per_query(ranking.top_k(p, 10, by, positive=False), t, 10) for by in ("bm25", "n_chars"))
    d = metrics.paired_delta(a, b)
    return d.select("n_queries", F.round("delta", 6).alias("delta"), F.round("standard_error", 6).alias("standard_error"), "improved", "worsened")


@query(f"""WITH {POOL_CTE}, ch AS (SELECT query_id, item_id, 'word' AS channel FROM pool WHERE rank <= 5 UNION ALL SELECT query_id, item_id, 'long' FROM pool WHERE n_chars > 2000), t AS (SELECT DISTINCT * FROM truth), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY query_id)
SELECT c.channel, round(avg(coalesce(h, 0)::DOUBLE / n), 6) AS recall FROM n CROSS JOIN (SELECT DISTINCT channel FROM ch) c LEFT JOIN (SELECT query_id, channel, count(*) AS h FROM (SELECT DISTINCT * FROM ch) JOIN t USING (query_id, item_id) GROUP BY ALL) x ON x.query_id = n.query_id AND x.channel = c.channel GROUP BY 1""")
def channel_recall(spark, sf):
    p = pool(spark, sf)
    ch = p.where("rank <= 5").select("query_id", "item_id", F.lit("word").alias("channel")).union(p.where("n_chars > 2000").select("query_id", "item_id", F.lit("long")))
    return metrics.channel_recall(ch, truth(spark, sf)).withColumn("recall", F.round("recall", 6))


_STRATA = "CASE WHEN n_chars <= 500 THEN 'a' WHEN n_chars <= 1500 THEN 'b' WHEN n_chars <= 5000 THEN 'c' ELSE 'd' END || '|' || lang"


def _strata(spark, sf):
    n = F.col("n_chars")
    size = F.when(n <= 500, "a").when(n <= 1500, "b").when(n <= 5000, "c").otherwise("d")
    return documents(spark, sf).select("item_id", "text", "lang", F.concat(size, F.lit("|"), "lang").alias("stratum"))


APPORTION = f"""sn AS (SELECT {_STRATA} AS stratum, count(*) AS n FROM documents GROUP BY 1), sh AS (SELECT stratum, n, n * 10e1 / (SELECT sum(n) FROM sn) AS share FROM sn),
ap AS (SELECT stratum, n, (floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, stratum) <= 100 - (SELECT sum(floor(share)) FROM sh) THEN 1 ELSE 0 END)::BIGINT AS quota FROM sh)"""


@query(f"WITH {APPORTION} SELECT stratum, n::BIGINT AS n, quota FROM ap")
def apportion(spark, sf):
    return split.apportion(_strata(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), 100)


@query(f"""WITH {APPORTION}, r AS (SELECT doc_id AS item_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(doc_id, '|3')), doc_id) AS r FROM (SELECT doc_id, {_STRATA} AS stratum FROM documents))
SELECT item_id, stratum FROM r JOIN ap USING (stratum) WHERE r <= quota""")
def stratified_sample(spark, sf):
    s = _strata(spark, sf)
    quotas = split.apportion(s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), 100)
    return split.stratified_sample(s, quotas, 3, "item_id").select("item_id", "stratum")


@query("""SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat(event_id, '|5')), event_id) AS r FROM events) WHERE r <= 5""")
def cap_per_query(spark, sf):
    return split.cap_per_group(table(spark, sf, "events").select("event_type", "user_id", "event_id"), "user_id", "event_id", 5, 5)


@query(f"WITH {EVENTS} SELECT p_partkey AS item_id, p_name AS text, p_name NOT IN (SELECT text FROM ev) AS cold FROM part")
def cold_flags(spark, sf):
    return split.cold_flags(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text")), events(spark, sf))


FIT = "held AS (SELECT DISTINCT p_partkey AS item_id, p_name AS text FROM part WHERE p_partkey % 10 = 0), ct AS (SELECT DISTINCT p_name AS text FROM part WHERE p_size = 7), fit AS (SELECT * FROM ev WHERE item_id NOT IN (SELECT item_id FROM held) AND text NOT IN (SELECT text FROM ct))"


def _fit(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"), "p_size")
    held, cold = p.where("item_id % 10 = 0"), p.where("p_size = 7")
    return split.fit_rows(events(spark, sf), held, cold), held, cold


@query(f"WITH {EVENTS}, {FIT} SELECT class, count(*)::BIGINT AS n, count(DISTINCT item_id)::BIGINT AS n_items FROM fit GROUP BY class")
def fit_antijoin(spark, sf):
    return _fit(spark, sf)[0].groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_items"))


@query(f"WITH {EVENTS}, {FIT} SELECT 'item_id' AS key, count(*)::BIGINT AS shared FROM (SELECT item_id FROM fit INTERSECT SELECT item_id FROM held) UNION ALL SELECT 'text', count(*)::BIGINT FROM (SELECT text FROM fit INTERSECT SELECT text FROM held)")
def leakage_audit(spark, sf):
    fit, held, _ = _fit(spark, sf)
    return split.leakage(fit, held, ["item_id", "text"])


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'second' ELSE 'first' END AS origin FROM (SELECT p_partkey AS k FROM part WHERE p_size < 20) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 10) b ON a.k = b.k""")
def union_first(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return split.union_first(p.where("p_size < 20").select("k", F.lit("first").alias("origin")), p.where("p_size > 10").select("k", F.lit("second").alias("origin")), "k")


_ANSWERS = """an AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END || lpad(((c_custkey * 7) % 1600)::VARCHAR, 16, '0') AS query_id,
  lpad((c_custkey % 900)::VARCHAR, 16, '0') || CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE ' ' END || lpad((c_custkey * 3 % 1100)::VARCHAR, 16, '0') || CASE WHEN c_custkey % 17 = 0 THEN ' ZZ' ELSE '' END AS answer FROM customer)"""


@query(f"""WITH {_ANSWERS}, ex AS (SELECT lpad(c_custkey::VARCHAR, 16, '0') AS query_id FROM customer), co AS (SELECT lpad(doc_id::VARCHAR, 16, '0') AS item_id FROM documents),
ids AS (SELECT row, query_id, list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '') AS ids FROM an), e AS (SELECT row, unnest(ids) AS item_id FROM ids)
SELECT code, count(*)::BIGINT AS n FROM (
  SELECT 'invalid_query_id_length' AS code FROM an WHERE length(query_id) <> 16 UNION ALL SELECT 'unknown_query_id' FROM an WHERE query_id NOT IN (SELECT query_id FROM ex)
  UNION ALL SELECT 'duplicate_query_id' FROM (SELECT row_number() OVER (PARTITION BY query_id ORDER BY row) AS r FROM an) WHERE r > 1 UNION ALL SELECT 'invalid_answer_separator' FROM an WHERE contains(answer, '  ')
  UNION ALL SELECT 'duplicate_item_id' FROM ids WHERE len(list_distinct(ids)) < len(ids) UNION ALL SELECT 'invalid_item_id_format' FROM e WHERE NOT regexp_matches(item_id, '^[0-9a-f]{{16}}$')
  UNION ALL SELECT 'item_not_in_corpus' FROM e WHERE regexp_matches(item_id, '^[0-9a-f]{{16}}$') AND item_id NOT IN (SELECT item_id FROM co) UNION ALL SELECT 'missing_query_id' FROM ex WHERE query_id NOT IN (SELECT query_id FROM an)) GROUP BY code""")
def validate_answer(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    pad = lambda x: F.lpad(x.cast("string"), 16, "0")
    k = F.col("k")
    answers = c.select(
        k.alias("row"), F.concat(F.when(k % 11 == 0, "x").otherwise(""), pad((k * 7) % 1600)).alias("query_id"),
        F.concat(pad(k % 900), F.when(k % 13 == 0, "  ").otherwise(" "), pad(k * 3 % 1100), F.when(k % 17 == 0, " ZZ").otherwise("")).alias("answer"), F.lit(2).alias("n_columns"),
    )
    errors = validate.answer_errors(answers, c.select(pad(k).alias("query_id")), documents(spark, sf).select(pad(F.col("item_id")).alias("item_id")))
    return validate.error_counts(errors).select("code", "n")


TAGS = f"""{POOL_CTE}, t AS (SELECT DISTINCT * FROM truth),
rel AS (SELECT pool.*, lang, bm25 / greatest(max(bm25) OVER (PARTITION BY query_id), 1e-6) AS lex, (pool.source = 'src' || (query_id % 5))::INT::DOUBLE AS same FROM pool JOIN (SELECT doc_id AS item_id, lang FROM documents) USING (item_id)),
dis AS (SELECT query_id, lex AS d_lex, cov AS d_cov, source AS d_source, same AS d_same, lang AS d_lang FROM rel WHERE (query_id, item_id) NOT IN (SELECT (query_id, item_id) FROM t) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
mi AS (SELECT t.query_id, t.item_id, rank, lex, cov, source, same, lang FROM t LEFT JOIN rel USING (query_id, item_id) WHERE rank IS NULL OR rank > 0),
tg AS (SELECT query_id, item_id, CASE WHEN rank IS NULL THEN ['candidate_miss'] ELSE list_filter([CASE WHEN rank > 50 AND rank <= 100 THEN 'close_rank' END,
  CASE WHEN source IS DISTINCT FROM d_source OR coalesce(same, 0e0) <> coalesce(d_same, 0e0) THEN 'location_difference' END,
  CASE WHEN lex < 2e-1 OR (cov < 25e-2 AND lex + 25e-2 < coalesce(d_lex, 0e0)) THEN 'low_lexical' END, CASE WHEN cov < 15e-2 OR cov + 15e-2 < coalesce(d_cov, 0e0) THEN 'low_semantic' END,
  CASE WHEN lang <> d_lang THEN 'class_difference' END], lambda x: x IS NOT NULL) END AS tags FROM mi LEFT JOIN dis USING (query_id))"""


def _tagged(spark, sf):
    """Relevant items with tags; of the others of a query's list only the best one, its first distractor, is needed."""
    c = F.col
    t, _ = small(truth(spark, sf).distinct())
    p = kept(scored(spark, sf))
    best, _ = small(p.groupBy("query_id").agg(F.max("bm25").alias("most")))
    others = p.join(t, ["query_id", "item_id"], "left_anti").select("query_id", "item_id", "bm25")
    first, _ = small(others.groupBy("query_id").agg(F.max("bm25").alias("first")))
    first = ranking.top_k(others.join(first, "query_id").where("bm25 = first"), 1, "bm25")
    asked, _ = small(t.union(first.select("query_id", "item_id")))
    ranks, _ = small(ranking.ranks_of(p, asked, "bm25"))
    rel, _ = small(p.join(ranks, ["query_id", "item_id"]).join(best, "query_id").withColumn("lexical", c("bm25") / F.greatest("most", F.lit(1e-6))))
    rel = documents(spark, sf).select("item_id", c("lang").alias("class")).join(rel, "item_id")
    rel = rel.withColumns({"location": c("source"), "same": (c("source") == F.concat(F.lit("src"), (c("query_id") % 5).cast("string"))).cast("double"), "title_coverage": c("cov"), "semantic": c("cov")})
    names = ("location", "same", "lexical", "title_coverage", "semantic", "class")
    dis = diagnostics.first_distractor(rel, t).select("query_id", *(c(n).alias(f"d_{n}") for n in names))
    m = diagnostics.missed(rel, t, 0).join(rel.select("query_id", "item_id", *names), ["query_id", "item_id"], "left").join(dis, "query_id", "left")
    return m.withColumn("tags", diagnostics.error_tags())


@query(f"WITH {TAGS} SELECT query_id, item_id, array_to_string(CASE WHEN len(tags) = 0 THEN ['other_ranking'] ELSE tags END, ',') AS tags FROM tg")
def error_tags(spark, sf):
    return _tagged(spark, sf).select("query_id", "item_id", F.concat_ws(",", "tags").alias("tags"))


@query(f"WITH {TAGS} SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN len(tags) = 0 THEN ['other_ranking'] ELSE tags END) AS tag FROM tg) GROUP BY tag")
def error_tag_counts(spark, sf):
    return diagnostics.tag_counts(_tagged(spark, sf))



_MISSED = f"{TAGS}, mm AS (SELECT query_id, item_id, rank, CASE WHEN query_id % 3 = 0 THEN 'cold' ELSE 'warm' END AS subset, coalesce(lang, 'none') AS class, CASE WHEN len(tags) = 0 THEN ['other_ranking'] ELSE tags END AS tags FROM tg LEFT JOIN (SELECT query_id, item_id, rank, lang FROM rel) USING (query_id, item_id))"


@query(f"""WITH {_MISSED}, e AS (SELECT subset, class, unnest(list_prepend('all', tags)) AS tag FROM mm)
SELECT coalesce(subset, 'all') AS subset, tag, coalesce(class, 'all') AS class, count(*)::BIGINT AS n FROM e GROUP BY GROUPING SETS ((subset, tag), (tag, class), (tag), (subset, class, tag))""")
def error_groups(spark, sf):
    """Missed items by subset (here queries whose id 3 divides, and the others), tag and class."""
    return diagnostics.error_groups(_tagged(spark, sf).withColumn("subset", F.when(F.col("query_id") % 3 == 0, "cold").otherwise("warm")))


@query(f"""WITH {_MISSED}, e AS (SELECT query_id, item_id, rank, unnest(tags) AS tag FROM mm) SELECT tag, row_number() OVER w AS place, query_id, item_id, rank FROM e WINDOW w AS (PARTITION BY tag ORDER BY coalesce(rank, 1000000000), query_id, item_id) QUALIFY place <= 3""")
def error_examples(spark, sf):
    return diagnostics.error_examples(_tagged(spark, sf)).select("tag", "place", "query_id", "item_id", "rank")


@query(f"""WITH {POOL_CTE}, t AS (SELECT DISTINCT * FROM truth), p AS (SELECT pool.* FROM pool JOIN t USING (query_id, item_id)), n AS (SELECT * FROM pool WHERE (query_id, item_id) NOT IN (SELECT (query_id, item_id) FROM t) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1)
SELECT 'bm25' AS feature, (SELECT round(avg(bm25), 4) FROM p) AS positive, (SELECT round(avg(bm25), 4) FROM n) AS distractor UNION ALL SELECT 'cov', (SELECT round(avg(cov), 4) FROM p), (SELECT round(avg(cov), 4) FROM n)""")
def positive_vs_distractor_means(spark, sf):
    t = truth(spark, sf).distinct()
    p = pool(spark, sf)
    m = diagnostics.mean_features(p.join(t, ["query_id", "item_id"], "left_semi"), diagnostics.first_distractor(p, t), ["bm25", "cov"])
    return m.select("feature", F.round("positive", 4).alias("positive"), F.round("distractor", 4).alias("distractor"))


@query(f"""WITH {POOL_CTE} SELECT pool.query_id, pool.item_id, (truth.item_id IS NOT NULL)::BIGINT AS label FROM pool LEFT JOIN (SELECT DISTINCT * FROM truth) truth USING (query_id, item_id)""")
def pool_labels(spark, sf):
    return features.label(pool(spark, sf), truth(spark, sf)).select("query_id", "item_id", "label")




def holdout(spark, sf):
    """The holdout of the events' queries (text, segment or none, place); strata are asked for as the parts' names are."""
    f = F.when(F.col("search_location") % 3 == 0, F.lit("")).otherwise(F.col("filters"))
    e = events(spark, sf).withColumn("filters", f)
    e = e.select(split.query_key(F.col("text"), F.col("filters"), F.col("search_location")).alias("qkey"), "text", "filters", "item_id", "class", T.stratum(F.col("text"), F.col("filters")).alias("stratum"))
    asked = table(spark, sf, "part").select(F.col("p_name").alias("text"), T.stratum(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("x"))).alias("stratum"))
    return split.build_holdout(e, asked, asked.where("text < 'm'"), most_items=15)


@query(f"""WITH {EVENTS}, g AS (SELECT text, search_location, CASE WHEN search_location % 3 = 0 THEN '' ELSE filters END AS f, count(DISTINCT item_id) AS n FROM ev GROUP BY ALL), t AS (SELECT least(6000, count(DISTINCT text)) AS n FROM g WHERE n BETWEEN 1 AND 15),
v AS (SELECT least(1500, n // 4) AS v, n FROM t), w AS (SELECT avg((NOT (p_name < 'm'))::INT) AS share FROM part)
SELECT split, size::BIGINT AS size, size::BIGINT AS n_texts, 0::BIGINT AS shared_items, 0::BIGINT AS cold_texts_in_fit, 0::BIGINT AS warm_texts_missing, true AS enough_cold FROM (SELECT 'validation' AS split, v AS size FROM v UNION ALL SELECT 'ranker_train', n - v FROM v)""")
def holdout_audit(spark, sf):
    """Sizes of the splits, and what must be 0: items that fit and holdout share, cold texts in fit, warm ones that fit lacks.
    A split that got no queries has a row too."""
    h = holdout(spark, sf)
    share = table(spark, sf, "part").agg(F.avg((~(F.col("p_name") < "m")).cast("double")).alias("share"))
    shared = split.leakage(h.fit, h.held, ["item_id"]).select(F.col("shared").alias("shared_items"))
    fit_texts = h.fit.select("text").distinct().withColumn("fit", F.lit(True))
    q = h.queries.join(fit_texts, "text", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("text").alias("n_texts"), F.sum((F.col("cold") & F.col("fit").isNotNull()).cast("long")).alias("cold_texts_in_fit"),
        F.sum((~F.col("cold") & F.col("fit").isNull()).cast("long")).alias("warm_texts_missing"), F.sum(F.col("cold").cast("long")).alias("n_cold"),
    )
    q = spark.createDataFrame([(x,) for x in split.SPLITS], "split string").join(q, "split", "left").fillna(0)
    j = q.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(share))  # one row each
    return j.select("split", "size", "n_texts", "shared_items", "cold_texts_in_fit", "warm_texts_missing", (F.col("n_cold") >= F.floor(F.col("size") * F.col("share"))).alias("enough_cold"))
