"""Rankers: gains and splits, stored trees, stages, the registry, refit and answers from stored models."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import boost, features, ranking
from tessera.operators.search import small
from tessera.plans.retrieval import UNION_CTE, candidate_union, within_quotas
from tessera.queries import query
from tessera.sources.adapters import POOL_CTE, table, truth
from tessera.sources.io import kept, kept_folder

BASE = ["bm25", "cov", "n_chars"]
WINDOWS = [f"pool_{k}_{c}" for c in ("bm25", "cov") for k in ("percentile", "gap_best", "gap_50")]
#: Edges of the bins that the reports on splits take.
EDGES = {"bm25": [1.0, 2.0, 4.0, 6.0, 8.0, 10.0, 13.0, 17.0], "cov": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], "n_chars": [250.0, 500.0, 1000.0, 2000.0, 4000.0, 9000.0]}
#: A stated ensemble: (tree, node, feature, threshold, left, right, value).
ENSEMBLE = [
    (0, 0, "bm25", 6.0, 1, 2, None), (0, 1, None, None, None, None, -0.5), (0, 2, "cov", 0.6, 3, 4, None), (0, 3, None, None, None, None, 0.25), (0, 4, None, None, None, None, 1.5),
    (1, 0, "n_chars", 900.0, 1, 2, None), (1, 1, "cov", 0.35, 3, 4, None), (1, 2, None, None, None, None, -0.125), (1, 3, None, None, None, None, 0.0), (1, 4, None, None, None, None, 0.75),
    (2, 0, "cov", 0.8, 1, 2, None), (2, 1, "bm25", 3.0, 3, 4, None), (2, 2, None, None, None, None, 2.0), (2, 3, None, None, None, None, -1.0), (2, 4, None, None, None, None, 0.5),
]
CANDIDATES_CTE = f"{POOL_CTE}, {UNION_CTE}, cand AS (SELECT pool.*, t.item_id IS NOT NULL AS label FROM pool JOIN un USING (query_id, item_id) LEFT JOIN (SELECT DISTINCT * FROM truth) t USING (query_id, item_id))"


def rank_pool(spark, sf, of=None):
    """The candidates of all channels, which their quotas bound, with labels, features and windows; written once."""
    p = within_quotas(spark, sf)
    u, _ = small(candidate_union(spark, sf, p).select("query_id", "item_id"))  # few pairs: the others needn't travel
    p = features.label(p.join(u, ["query_id", "item_id"], "left_semi"), truth(spark, sf) if of is None else of).withColumn("n_chars", F.col("n_chars").cast("double"))
    return kept(ranking.augment(p, ["bm25", "cov"]).select("query_id", "item_id", "label", *BASE, *WINDOWS))


def stated(trees=None) -> boost.Model:
    """The stated ensemble, or some of its trees."""
    rows = [n for n in ENSEMBLE if trees is None or n[0] in trees]
    return boost.Model(tuple((*n, None, 0) for n in rows), tuple(BASE), boost.Settings())


_BINS = "(SELECT query_id, item_id, f, CASE f " + " ".join(f"WHEN {i} THEN {' + '.join(f'({c} > {x!r})::INT' for x in e)}" for i, (c, e) in enumerate(EDGES.items())) + " END AS b FROM cand, (SELECT unnest([0, 1, 2]) AS f))"
_GRADIENTS = """o AS (SELECT query_id, item_id, label, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS r FROM cand),
dd AS (SELECT *, CASE WHEN r <= 50 THEN 1e0 / log2(r + 1e0) ELSE 0e0 END AS d FROM o),
pw AS (SELECT a.query_id, a.item_id AS i, b.item_id AS j, 5e-1 * abs(a.d - b.d) AS w FROM dd a JOIN dd b ON a.query_id = b.query_id AND a.label AND NOT b.label),
gr AS (SELECT query_id, item_id, sum(g) AS g, sum(h) AS h FROM (SELECT query_id, i AS item_id, w AS g, 5e-1 * w AS h FROM pw UNION ALL SELECT query_id, j, -w, 5e-1 * w FROM pw) GROUP BY ALL)"""


def _gains_sql(name: str, rows: str) -> str:
    """Gains of the splits of the nodes of `rows` (query_id, item_id, node)."""
    return f"""h{name} AS (SELECT node, f, b, count(*) AS n, sum(coalesce(g, 0e0)) AS g, sum(coalesce(h, 0e0)) AS h FROM {rows} JOIN bi USING (query_id, item_id) LEFT JOIN gr USING (query_id, item_id) GROUP BY node, f, b),
c{name} AS (SELECT node, f, b, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER p AS n, sum(g) OVER p AS g, sum(h) OVER p AS h FROM h{name} WINDOW w AS (PARTITION BY node, f ORDER BY b), p AS (PARTITION BY node, f)),
g{name} AS (SELECT node, f, b, n, ln, round(lg * lg / (lh + 5e0) + (g - lg) * (g - lg) / (h - lh + 5e0) - g * g / (h + 5e0), 9) AS gain FROM c{name} WHERE ln >= 30 AND n - ln >= 30)"""


SPLITS_CTE = f"{CANDIDATES_CTE}, bi AS {_BINS}, {_GRADIENTS}, {_gains_sql('0', '(SELECT query_id, item_id, 0 AS node FROM cand)')}"


def _first_state(spark, sf):
    s = boost.Settings()
    return boost._advance(boost.pack(rank_pool(spark, sf), EDGES), "query_id", s, len(EDGES), None)


@query(f"WITH {SPLITS_CTE} SELECT f AS feature, b AS bin, n::BIGINT AS n, ln::BIGINT AS left_n, round(gain, 4) AS gain FROM g0")
def split_gains(spark, sf):
    """What each first split of a ranking tree gains, from the gradients of equal scores."""
    h = boost.histograms(_first_state(spark, sf), boost._Tree.root(), [0], len(EDGES), 10)
    return boost.split_gains(h).select("feature", "bin", "n", "left_n", F.round("gain", 4).alias("gain"))


@query(f"""WITH {SPLITS_CTE}, b0 AS (SELECT * FROM g0 ORDER BY gain DESC, f, b LIMIT 1), side AS (SELECT query_id, item_id, (bi.b > b0.b)::INT + 1 AS node FROM bi JOIN b0 USING (f)), {_gains_sql('1', 'side')},
b1 AS (SELECT * FROM g1 WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)
SELECT CASE node WHEN 0 THEN '' WHEN 1 THEN 'L' ELSE 'R' END AS path, f::BIGINT AS feature, b::BIGINT AS bin, n::BIGINT AS n, round(gain, 4) AS gain FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1)""")
def first_tree(spark, sf):
    """The splits of the first two levels of a ranking tree."""
    s = boost.Settings(leaves=4, depth=2)
    tree, known = boost._grow(kept(_first_state(spark, sf)), s, len(EDGES), 10)
    paths, rows = {0: ""}, []
    for k, f in enumerate(tree.feature):
        if f >= 0:
            paths |= {tree.left[k]: paths[k] + "L", tree.right[k]: paths[k] + "R"}
    for k, f in enumerate(tree.feature):
        if f >= 0:
            rows.append((paths[k], f, tree.at[k], known[k][1], known[k][0]))
    return spark.createDataFrame(rows, "path string, feature long, bin long, n long, gain double").withColumn("gain", F.round("gain", 4))


_NODES_SQL = ", ".join(f"({t}, {n}, {'NULL' if f is None else repr(f)}, {'NULL' if c is None else c}::DOUBLE, {'NULL' if a is None else a}::INT, {'NULL' if b is None else b}::INT, {'NULL' if v is None else v}::DOUBLE)" for t, n, f, c, a, b, v in ENSEMBLE)
#: Every candidate walks down every tree of the node table.
DESCENT_CTE = f"""{CANDIDATES_CTE}, nd AS (SELECT * FROM (VALUES {_NODES_SQL}) v(tree, node, feature, threshold, l, r, value)),
walk AS (SELECT query_id, item_id, tree, 0 AS node, bm25, cov, n_chars::DOUBLE AS n_chars FROM cand, (SELECT DISTINCT tree FROM nd)
  UNION ALL SELECT query_id, item_id, tree, CASE WHEN CASE feature WHEN 'bm25' THEN bm25 WHEN 'cov' THEN cov ELSE n_chars END > threshold THEN r ELSE l END, bm25, cov, n_chars FROM walk JOIN nd USING (tree, node) WHERE feature IS NOT NULL),
leaf AS (SELECT query_id, item_id, tree, value FROM walk JOIN nd USING (tree, node) WHERE feature IS NULL)"""


@query(f"WITH RECURSIVE {DESCENT_CTE} SELECT query_id, item_id, sum(value)::DOUBLE AS score FROM leaf GROUP BY ALL")
def tree_scores(spark, sf):
    """The stated ensemble, from its node table."""
    return boost.score(rank_pool(spark, sf), stated()).select("query_id", "item_id", "score")


@query(f"""WITH RECURSIVE {DESCENT_CTE}, sg AS (SELECT query_id, item_id, tree, sum(value) OVER (PARTITION BY query_id, item_id ORDER BY tree) AS s FROM leaf),
rk AS (SELECT *, row_number() OVER (PARTITION BY tree, query_id ORDER BY s DESC, item_id) AS r FROM sg), tr AS (SELECT DISTINCT * FROM truth),
rc AS (SELECT g.tree, tr.query_id, count(rk.item_id)::DOUBLE / count(*) AS recall FROM tr CROSS JOIN (SELECT DISTINCT tree FROM nd) g LEFT JOIN rk ON rk.tree = g.tree AND rk.query_id = tr.query_id AND rk.item_id = tr.item_id AND r <= 3 GROUP BY g.tree, tr.query_id),
sr AS (SELECT tree + 1 AS stage, round(avg(recall), 6) AS recall FROM rc GROUP BY tree)
SELECT stage::BIGINT AS stage, recall, row_number() OVER (ORDER BY recall DESC, stage) = 1 AS best FROM sr""")
def staged_recalls(spark, sf):
    """Recall at 3 after each tree of the stated ensemble, and the earliest best stage."""
    t = kept(truth(spark, sf))
    s = boost.score(rank_pool(spark, sf, t), stated(), staged=True)
    r = kept(boost.staged_recall(s, t, 3).withColumn("recall", F.round("recall", 6)))
    best = boost.best_stage(r).select("stage", F.lit(True).alias("best"))
    return r.join(F.broadcast(best), "stage", "left").select("stage", "recall", F.coalesce("best", F.lit(False)).alias("best"))  # one row


def _z(c: str) -> str:
    return f"(({c} - avg({c}) OVER w) / greatest(stddev_pop({c}) OVER w, 1e-6))"


@query(f"""WITH RECURSIVE {DESCENT_CTE}, ab AS (SELECT query_id, item_id, sum(value) FILTER (WHERE tree < 2) AS a, sum(value) FILTER (WHERE tree = 2) AS b FROM leaf GROUP BY ALL),
bl AS (SELECT query_id, item_id, round({_z('a')} * 75e-2 + {_z('b')} * 25e-2, 9) AS s FROM ab WINDOW w AS (PARTITION BY query_id)),
tp AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM bl WHERE item_id IN (SELECT doc_id FROM labels) QUALIFY r <= 50)
SELECT query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY r) AS answer FROM tp GROUP BY query_id""")
def stored_answers(spark, sf):
    """From two stored models, each checked against its manifest, to answers: standardised per query, blended, the best legal ones."""
    at = f"{kept_folder(spark)}/bundle-{uuid.uuid4().hex}"
    for name, trees in (("first", {0, 1}), ("second", {2})):
        boost.save(spark, stated(trees), f"{at}/{name}")
    legal = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return blended_answers(rank_pool(spark, sf), boost.load(spark, f"{at}/first", BASE), boost.load(spark, f"{at}/second", BASE), legal, 0.75)


def blended_answers(candidates, first, second, legal, weight, k=50):
    """(query_id, answer) of the candidates by two models' blended scores."""
    p = boost.score(boost.score(candidates, first, "a"), second, "b")
    p = p.withColumn("score", F.round(ranking.zblend(F.col("a"), F.col("b"), weight), 9))
    return ranking.answer_rows(ranking.legal_top(p.select("query_id", "item_id", "score"), legal, k))


#: What the registered trainings take of the registry's settings, so that a query ends in minutes.
LAMBDA = boost.Settings(rounds=20, leaves=31)
LOGISTIC = boost.Settings("logistic", rounds=20, leaves=31, depth=6)


def _ranked(spark, sf, settings):
    p = rank_pool(spark, sf)
    s = boost.score(p, boost.train(p, BASE + WINDOWS, settings))
    return ranking.top_k(s.withColumn("score", F.round("score", 6)), 50, positive=False).select("query_id", "item_id", "rank", "score")


@query()
def gbt_rank(spark, sf):
    """Pointwise trees over the candidates' features; no SQL."""
    return _ranked(spark, sf, LOGISTIC)


@query()
def lambda_rank(spark, sf):
    """Trees of 31 leaves for ranking over the candidates' features; no SQL."""
    return _ranked(spark, sf, LAMBDA)


def fitted(candidates, answers, settings, feature_names, held, k=50):
    """A model trained on the queries that aren't held out, cut at its best stage on those that are, with its recalls there."""
    t = answers.select("query_id", "item_id").distinct()
    model = boost.train(candidates.where(~held), feature_names, settings)
    staged = kept(boost.score(candidates, model, staged=True).select("query_id", "item_id", "score", held.alias("held")))
    best = boost.best_stage(kept(boost.staged_recall(staged.where("held"), t.where(held), k))).first()
    trees = int(best["stage"]) if best and best["stage"] is not None else settings.rounds
    recalls = {}
    for name, rows, of in (("train", staged.where("NOT held"), t.where(~held)), ("validation", staged.where("held"), t.where(held))):
        r = boost.staged_recall(rows, of, k).where(F.col("stage") == trees).first()
        recalls[f"{name}_recall"] = float(r["recall"]) if r and r["recall"] is not None else 0.0
    cut = boost.truncated(model, trees)
    return boost.Model(cut.nodes, cut.features, settings, recalls | {"trees": trees})


def registry(candidates, answers, variants, feature_names, held):
    return {name: fitted(candidates, answers, s, feature_names, held) for name, s in variants.items()}


_VARIANTS = {"lambda15": boost.Settings(rounds=8, leaves=15), "logistic_depth3": boost.Settings("logistic", rounds=8, leaves=8, depth=3)}


@query()
def model_registry(spark, sf):
    """Models side by side: recall of their training and validation queries, and which is chosen; no SQL."""
    t = kept(truth(spark, sf))
    models = registry(rank_pool(spark, sf, t), t, _VARIANTS, BASE + WINDOWS, F.col("query_id") % 2 == 0)
    best = boost.choose(models)
    rows = [(n, m.metrics["train_recall"], m.metrics["validation_recall"], m.metrics["trees"], len(m.nodes), m.fingerprint(), n == best) for n, m in models.items()]
    return spark.createDataFrame(rows, "name string, train_recall double, validation_recall double, trees int, n_nodes int, fingerprint string, chosen boolean")


@query()
def refit_answers(spark, sf):
    """The chosen model refitted on all queries, stored, loaded, checked, and used for answers, known items first; no SQL."""
    t = kept(truth(spark, sf))
    p = rank_pool(spark, sf, t)
    models = registry(p, t, _VARIANTS, BASE + WINDOWS, F.col("query_id") % 2 == 0)
    best = models[boost.choose(models)]
    at = f"{kept_folder(spark)}/bundle-{uuid.uuid4().hex}"
    boost.save(spark, boost.train(p, list(best.features), boost.Settings(**(vars(best.settings) | {"rounds": best.metrics["trees"]}))), at)
    s = boost.score(p, boost.load(spark, at, BASE + WINDOWS)).withColumn("score", F.round("score", 9))
    legal = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    base = kept(ranking.legal_top(s.select("query_id", "item_id", "score"), legal, 50))
    known = base.join(t.distinct(), ["query_id", "item_id"], "left_semi")
    return ranking.answer_rows(ranking.reserve_history(base.select("query_id", "item_id", "rank"), known.select("query_id", "item_id", "rank"), known.select("query_id", "item_id", "rank").limit(0)))
