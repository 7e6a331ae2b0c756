"""Smaller operators, each over its whole table: predicates, groups, codes, checked joins, quotas, losses, the retriever."""

from pyspark.sql import functions as F

from tessera.operators import dense, diagnostics, features, learn, metrics, ranking, remote, search, split, validate
from tessera.plans.retrieval import FIELDED_CTE, _feats, _gram_cte, cut, cut_sql
from tessera.queries import query
from tessera.sources.adapters import EVENTS, POOL_CTE, benchmark, events, fields, pool, scored, table, tok, truth
from tessera.sources.io import kept


@query(f"WITH {POOL_CTE} SELECT query_id, count(DISTINCT item_id)::BIGINT AS n FROM truth GROUP BY query_id HAVING count(DISTINCT item_id) BETWEEN 1 AND 15")
def bounded_positives(spark, sf):
    return features.bounded_positives(truth(spark, sf))


@query(f"""WITH {POOL_CTE} SELECT query_id, (sum((truth.item_id IS NOT NULL)::INT))::BIGINT AS positives, count(*)::BIGINT AS size FROM pool LEFT JOIN (SELECT DISTINCT * FROM truth) truth USING (query_id, item_id) GROUP BY query_id""")
def pool_groups(spark, sf):
    return features.positives_per_pool(features.label(pool(spark, sf), truth(spark, sf)))


@query(f"WITH {POOL_CTE} SELECT query_id, item_id, rank() OVER (PARTITION BY query_id ORDER BY cov DESC)::BIGINT AS place FROM pool")
def min_ranks(spark, sf):
    return pool(spark, sf).select("query_id", "item_id", ranking.min_rank(F.col("cov")).alias("place"))


@query("SELECT p_partkey AS item_id, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code FROM part")
def dense_codes(spark, sf):
    return split.dense_codes(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand"), "p_brand")


_CLASSES = "SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS i FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 4)"


@query(f"SELECT p_partkey AS item_id, coalesce(i, -1)::BIGINT AS index FROM part LEFT JOIN ({_CLASSES}) USING (p_brand)")
def class_index(spark, sf):
    """Classes are those of the smallest parts; items of any other have none."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("class"), "p_size")
    classes = split.dense_codes(p.where("p_size < 4").select("class").distinct(), "class", "index")
    return features.class_index(p, classes)


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, p_brand, p_size::BIGINT AS p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def merge_many_to_one(spark, sf):
    left = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").alias("p_partkey"))
    return split.many_to_one(left, table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size")), "p_partkey").drop("p_partkey")


_CITY = "city AS (SELECT *, (search_location <> item_location)::INT::DOUBLE AS nonlocal FROM ev WHERE search_location IN (SELECT item_location FROM ev) AND search_location IS NOT NULL AND item_location IS NOT NULL AND class IS NOT NULL)"
_RATES = "pri AS (SELECT coalesce(avg(nonlocal), 1e-1) AS prior FROM city), rt AS (SELECT class, count(*) AS n, (sum(nonlocal) + 5e1 * any_value(prior)) / (count(*) + 5e1) AS rate FROM city, pri GROUP BY class)"


@query(f"WITH {EVENTS}, {_CITY}, {_RATES} SELECT class, n::BIGINT AS n, round(rate, 6) AS rate FROM rt")
def nonlocal_rates(spark, sf):
    e = events(spark, sf)
    return remote.smoothed_rate(remote.city_rows(e, e.select("item_location")), "class", "nonlocal").withColumn("rate", F.round("rate", 6))


@query(f"""WITH {EVENTS}, {_CITY}, {_RATES}, q AS (SELECT DISTINCT p_name AS text FROM part),
tm AS (SELECT text, avg(coalesce(rate, prior)) AS m FROM ev LEFT JOIN rt USING (class), pri GROUP BY text)
SELECT text AS query_id, round(least(greatest(coalesce(m, prior), 0e0), 1e0), 6) AS prior FROM q LEFT JOIN tm USING (text), pri""")
def remote_prior(spark, sf):
    """Every text's expected share of offers elsewhere: the mean over its own events, else the overall share."""
    e = events(spark, sf)
    city = remote.city_rows(e, e.select("item_location"))
    overall = city.agg(F.coalesce(F.avg("nonlocal"), F.lit(0.10)).alias("p"))
    rates = remote.smoothed_rate(city, "class", "nonlocal").select("class", "rate")
    known = e.select("text", "class").join(rates, "class", "left").crossJoin(F.broadcast(overall)).withColumn("rate", F.coalesce("rate", "p"))
    means = remote.text_mean(known, "text")
    q = table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct().withColumn("query_id", F.col("text"))
    prior = remote.openness(q, means, q.crossJoin(F.broadcast(overall)).select("query_id", F.col("p").alias("expected")))
    return prior.select("query_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prior")), 6).alias("prior"))


@query(f"""WITH {POOL_CTE}, t AS (SELECT DISTINCT * FROM truth), m AS (SELECT t.query_id, t.item_id, rank FROM t LEFT JOIN pool USING (query_id, item_id) WHERE rank IS NULL OR rank > 0)
SELECT query_id, item_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rank, 1000000000), item_id) AS place FROM m""")
def missed_order(spark, sf):
    t, _ = search.small(truth(spark, sf).distinct())
    return diagnostics.missed_in_order(ranking.ranks_of(kept(scored(spark, sf)), t, "bm25"), t, 0)


def _tree_sql(level: str, up: str) -> str:
    return f"{up} AS (SELECT i // 64 AS i, sha256(string_agg(k, chr(10) ORDER BY i)) AS k FROM {level} GROUP BY i // 64)"


@query(f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id::VARCHAR AS k FROM documents), {_tree_sql('l0', 'l1')}, {_tree_sql('l1', 'l2')}, {_tree_sql('l2', 'l3')}, {_tree_sql('l3', 'l4')},
n AS (SELECT count(*)::BIGINT AS n FROM documents), u AS (SELECT 1 AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3 UNION ALL SELECT 4, * FROM l4)
SELECT n, k AS fingerprint FROM u, n WHERE level = (SELECT min(level) FROM (SELECT level FROM u GROUP BY level HAVING count(*) = 1))""")
def ordered_fingerprint(spark, sf):
    """In runs of 64, so that small tables have several levels too."""
    return validate.ordered_digest(table(spark, sf, "documents"), "doc_id", "doc_id", 64)


_COLD = "q AS (SELECT p_partkey AS item_id, p_name NOT IN (SELECT text FROM ev) AS cold FROM part)"


@query(f"""WITH {EVENTS}, {_COLD}, n AS (SELECT greatest(ceil(count(*) * 30e-2) - count(*) FILTER (WHERE cold), 0) AS more FROM q),
w AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat(item_id, '|11')), item_id) AS r FROM q WHERE NOT cold)
SELECT q.item_id, cold, cold OR coalesce(r <= more, false) AS forced FROM q LEFT JOIN w USING (item_id), n""")
def cold_quota(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    return split.cold_quota(split.cold_flags(p, events(spark, sf)), 0.30, 11, "item_id").select("item_id", "cold", "forced")


@query("""WITH s AS (SELECT p_brand, count(DISTINCT p_name) AS n FROM part GROUP BY p_brand)
SELECT p_name AS text, p_brand AS stratum FROM part JOIN s USING (p_brand) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n, p_brand, md5(concat(p_name || '|' || p_brand, '|13'))) = 1""")
def assign_texts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("text"), F.col("p_brand").alias("stratum"))
    return split.assign_texts(p, "text", "stratum", 13).select("text", "stratum")


@query(f"""WITH {POOL_CTE}, r AS (SELECT *, bm25 / greatest(max(bm25) OVER (PARTITION BY query_id), 1e-6) AS rel FROM pool),
g AS (SELECT *, rel * (cov * 85e-2 + 15e-2) AS geo, 1e0 / (1 + length(source)) AS o FROM r)
SELECT query_id, item_id, {cut_sql('(rel * greatest(o, CASE WHEN rel > 0 THEN geo / rel ELSE 0e0 END))', 5)} AS remote_aware FROM g""")
def remote_aware(spark, sf):
    c = F.col
    p = pool(spark, sf).withColumn("bm25_rel", ranking.relative(c("bm25")))
    p = p.withColumns({"geo_bm25": c("bm25_rel") * (c("cov") * 0.85 + 0.15), "openness": F.lit(1.0) / (F.length("source") + 1)})
    return remote.remote_aware(p).select("query_id", "item_id", cut("remote_aware_bm25", 5).alias("remote_aware"))


@query(f"""WITH {POOL_CTE}, t AS (SELECT DISTINCT * FROM truth), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY query_id),
v AS (SELECT 'a_bm25' AS variant, query_id, item_id FROM pool WHERE rank <= 5 UNION ALL SELECT 'b_coverage', query_id, item_id FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cov DESC, item_id) <= 5),
h AS (SELECT variant, query_id, count(*) AS h FROM v JOIN t USING (query_id, item_id) GROUP BY ALL),
m AS (SELECT variant, avg(coalesce(h, 0)::DOUBLE / n) AS recall FROM (SELECT DISTINCT variant FROM v) x CROSS JOIN n LEFT JOIN h USING (variant, query_id) GROUP BY variant)
SELECT variant, round(recall, 6) AS recall FROM m WHERE variant = 'a_bm25' OR recall > (SELECT recall FROM m WHERE variant = 'a_bm25') + 1e-12 ORDER BY recall DESC, variant LIMIT 1""")
def best_variant(spark, sf):
    """Coverage replaces BM25 only if its recall at 5 is better by more than the margin."""
    p, t = scored(spark, sf), kept(truth(spark, sf))
    best = {n: ranking.top_k(p, 5, c, positive=False) for n, c in (("a_bm25", "bm25"), ("b_coverage", "cov"))}
    each = [metrics.recall_per_query(r, t, 5).agg(F.avg("recall").alias("recall")).select(F.lit(n).alias("variant"), "recall") for n, r in best.items()]
    return metrics.best_variant(each[0].union(each[1]), base="a_bm25").select("variant", F.round("recall", 6).alias("recall"))


_SAME = "x.vec_id <> y.vec_id AND (x.vec_id % 50 = y.vec_id % 50 OR x.vec_id // 9 = y.vec_id // 9)"


@query(f"""WITH e AS (SELECT vec_id, vec_id // 64 AS batch, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT x.batch, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / 5e-2 AS z FROM e x JOIN e y ON x.batch = y.batch AND NOT ({_SAME})),
l AS (SELECT batch, a, ln(sum(exp(z - m))) + any_value(m) - max(z) FILTER (WHERE a = b) AS l FROM (SELECT *, max(z) OVER (PARTITION BY batch, a) AS m FROM s) GROUP BY batch, a)
SELECT batch, round(avg(l), 4) AS loss FROM l GROUP BY batch""")
def contrastive_loss(spark, sf):
    """In-batch loss of 64 neighbouring rows, which are their own positives; a batch bounds the pairs."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 64).alias("batch"), F.col("embedding").alias("v"))
    pairs = e.select("batch", F.col("pos").alias("a"), F.col("v").alias("x")).join(e.select("batch", F.col("pos").alias("b"), F.col("v").alias("y")), "batch")
    scores = pairs.select("batch", "a", "b", dense.dot(F.col("x"), F.col("y")).alias("score"))
    mask = dense.contrastive_mask(e.select("batch", "pos", (F.col("pos") % 50).alias("query_id"), F.floor(F.col("pos") / 9).alias("item_id")))
    return learn.masked_cross_entropy(scores, mask).select("batch", F.round("loss", 4).alias("loss"))


@query(f"""WITH {POOL_CTE}, t AS (SELECT DISTINCT * FROM truth), p AS (SELECT pool.query_id, pool.item_id, bm25 AS s, t.item_id IS NOT NULL AS y, row_number() OVER (PARTITION BY pool.query_id ORDER BY bm25 DESC, pool.item_id) AS r FROM pool LEFT JOIN t USING (query_id, item_id)),
disc AS (SELECT *, CASE WHEN r <= 50 THEN 1e0 / log2(r + 1e0) ELSE 0e0 END AS d FROM p),
g AS (SELECT a.query_id, a.item_id AS i, b.item_id AS j, 1e0 / (1e0 + exp(a.s - b.s)) * abs(a.d - b.d) AS g FROM disc a JOIN disc b ON a.query_id = b.query_id AND a.y AND NOT b.y),
e AS (SELECT query_id, i AS item_id, g FROM g UNION ALL SELECT query_id, j, -g FROM g), s AS (SELECT query_id, item_id, sum(g) AS l FROM e GROUP BY ALL)
SELECT query_id, item_id, round(coalesce(l, 0e0), 5) AS lambda FROM p LEFT JOIN s USING (query_id, item_id)""")
def lambda_gradients(spark, sf):
    p = kept(features.label(scored(spark, sf).select("query_id", "item_id", "bm25"), truth(spark, sf)))
    return learn.lambdas(p, "bm25").select("query_id", "item_id", F.round("lambda", 5).alias("lambda"))


_PARAMS = f"""pi AS (SELECT doc_id AS item_id, {tok("lang || ' ' || source")} AS t FROM documents), pf AS (SELECT item_id, {_feats('t')} AS f FROM pi),
ps AS (SELECT count(*) AS n, avg(len(f)) AS m FROM pf), pp AS (SELECT term, item_id, any_value(l) AS l, count(*) AS tf FROM (SELECT item_id, len(f) AS l, unnest(f) AS term FROM pf) GROUP BY ALL),
pdf AS (SELECT term, count(*) AS df FROM pp GROUP BY term), pw AS (SELECT term, item_id, ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 22e-1 / (tf + 12e-1 * ((1e0 - 4e-1) + 4e-1 * l / m))) AS w FROM pp JOIN pdf USING (term), ps),
pqt AS (SELECT item_id AS query_id, {tok("'en src' || (item_id % 7)")} AS t FROM benchmark), pq AS (SELECT DISTINCT query_id, unnest({_feats('t')}) AS term FROM pqt)"""


@query(f"WITH {_PARAMS} SELECT query_id, item_id, {cut_sql('round(sum(w), 6)', 4)} AS score FROM pq JOIN pw USING (term) GROUP BY query_id, item_id")
def bm25_params(spark, sf):
    """The parameter channel: filter terms, each with weight 1, against the parameters' own index."""
    q = benchmark(spark, sf).select("query_id", F.lit("").alias("text"), F.concat(F.lit("en src"), (F.col("query_id") % 7).cast("string")).alias("filters"))
    index = search.fit_field_channel(fields(spark, sf), "params", b=0.40)
    return search.search(index, search.query_terms(q, filters="filters", filter_weight=1.0)).select("query_id", "item_id", cut("score", 4).alias("score"))


_CHARS = (
    _gram_cte("h", "(SELECT doc_id, substring(text, 1, 80) AS t FROM documents)", "doc_id") + ",\n" + _gram_cte("k", "(SELECT item_id, text AS t FROM benchmark)", "item_id")
    + """,
hn AS (SELECT count(*) AS n FROM documents), hd AS (SELECT term, ln((n + 1e0) / (count(*) + 1e0)) + 1e0 AS idf FROM hp, hn GROUP BY term, n HAVING count(*) >= 2),
hw AS (SELECT id, term, (1e0 + ln(tf::DOUBLE)) * idf AS w FROM hp JOIN hd USING (term)), hu AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM hw),
kw AS (SELECT id, term, (1e0 + ln(tf::DOUBLE)) * idf AS w FROM kp JOIN hd USING (term)), ku AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM kw),
hs AS (SELECT ku.id AS query_id, hu.id AS item_id, round(sum(ku.w * hu.w), 6) AS score FROM ku JOIN hu USING (term) GROUP BY ALL),
ha AS (SELECT query_id, item_id, score / max(score) OVER (PARTITION BY query_id) AS a FROM fsc), hb AS (SELECT query_id, item_id, score / max(score) OVER (PARTITION BY query_id) AS b FROM hs),"""
    + f"hh AS (SELECT query_id, item_id, {cut_sql('round(coalesce(a, 0e0) + coalesce(b, 0e0) * 35e-2, 6)', 3)} AS score FROM ha FULL JOIN hb USING (query_id, item_id))"
)


def _retriever(spark, sf):
    cfg = search.SparseConfig(max_features=None, description_chars=None)
    return search.SparseRetriever(fields(spark, sf), {"title": "title", "params": "params", "description": "description"}, cfg=cfg, queries=benchmark(spark, sf))


@query(f"WITH {FIELDED_CTE}, {_CHARS} SELECT query_id, item_id, {cut_sql('score', 3)} AS score FROM hs")
def char_scores(spark, sf):
    """The character channel of the retriever: cosines of titles and passages over n-grams inside words."""
    r = _retriever(spark, sf)
    return r.scores(benchmark(spark, sf), "char").select("query_id", "item_id", cut("score", 3).alias("score"))


@query(f"WITH {FIELDED_CTE}, {_CHARS} SELECT query_id, item_id, score FROM hh WHERE score > 0")
def hybrid_scores(spark, sf):
    """Words and characters, each against the query's best."""
    return _retriever(spark, sf).scores(benchmark(spark, sf), "hybrid").select("query_id", "item_id", cut("score", 3).alias("score")).where("score > 0")


@query()
def all_features(spark, sf):
    """The 41 features and the 21 pool windows over the events' world: see candidates.pairs. No SQL; tested on a fixture."""
    from tessera.plans import candidates

    return candidates.features_of(spark, sf)
