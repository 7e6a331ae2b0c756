"""The intent stage over the events: a vocabulary frozen on the events to fit, four models compared on the others, the chosen one refitted on all."""

from pyspark.sql import functions as F

from tessera.operators import intent
from tessera.operators.ranking import softmax
from tessera.queries import query
from tessera.sources.adapters import EVENTS, events, tok
from tessera.sources.io import kept


def _stage(spark, sf):
    """Events, those to fit (four items of five), the vocabulary, and the queries of the others with their classes."""
    e = kept(events(spark, sf).select("text", "filters", "class", "item_id"))
    fit = e.where("item_id % 5 <> 0")
    vocabulary = kept(intent.fit_vocabulary(fit, "v1"))
    asked = e.where("item_id % 5 = 0").withColumn("query_id", F.concat_ws("|", "text", "filters"))
    queries = asked.select("query_id", "text", "filters").distinct()
    return e, fit, vocabulary, queries, asked.select("query_id", "class").distinct()


def _words(column: str) -> str:
    t = f"list_filter({tok(column)}, lambda x: len(x) > 1)"
    return f"list_concat(list_transform({t}, lambda x: 'w:' || x), list_transform(range(1, len({t})), lambda i: 'b:' || ({t})[i] || '_' || ({t})[i + 1]))"


def _block(name: str, block: str, column: str, counts: str) -> str:
    """Counts of a block over all its texts, the vocabulary of those to fit, and unit vectors with the block's weight."""
    return f"""{name}c AS ({counts}), {name}n AS (SELECT count(DISTINCT {column}) AS n FROM fe),
{name}v AS (SELECT term, ln((n + 1e0) / (count(*) + 1e0)) + 1e0 AS idf FROM {name}c JOIN (SELECT DISTINCT {column} FROM fe) USING ({column}), {name}n GROUP BY term, n),
{name}w AS (SELECT {column}, '{block} ' || term AS term, (1e0 + ln(tf::DOUBLE)) * idf AS w FROM {name}c JOIN {name}v USING (term)),
{name}u AS (SELECT {column}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {column})) * {intent.BLOCKS[block]!r}::DOUBLE AS w FROM {name}w)"""


def _grams(column: str) -> str:
    return f"""SELECT {column}, substring(w, i::BIGINT, k) AS term, count(*) AS tf FROM (SELECT {column}, w, k, unnest(range(1, greatest(len(w) - k + 1, 1) + 1)) AS i FROM (SELECT {column}, ' ' || unnest({tok(column)}) || ' ' AS w FROM (SELECT DISTINCT {column} FROM ev)), (SELECT unnest([3, 4, 5]) AS k) WHERE k = 3 OR len(w) > k - 1) GROUP BY {column}, term"""


VOCABULARY_CTE = f"""{EVENTS}, fe AS (SELECT * FROM ev WHERE item_id % 5 <> 0),
{_block('w', 'word', 'text', f"SELECT text, term, count(*) AS tf FROM (SELECT text, unnest({_words('text')}) AS term FROM (SELECT DISTINCT text FROM ev)) GROUP BY ALL")},
{_block('g', 'char', 'text', _grams('text'))},
{_block('f', 'filter', 'filters', f"SELECT filters, term, count(*) AS tf FROM (SELECT filters, unnest({_words('filters')}) AS term FROM (SELECT DISTINCT filters FROM ev)) GROUP BY ALL")},
voc AS (SELECT 'word' AS block, * FROM wv UNION ALL SELECT 'char', * FROM gv UNION ALL SELECT 'filter', * FROM fv),
tu AS (SELECT text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM (SELECT * FROM wu UNION ALL SELECT * FROM gu)),
qs AS (SELECT DISTINCT text || '|' || filters AS query_id, text, filters FROM ev WHERE item_id % 5 = 0), tc AS (SELECT DISTINCT text || '|' || filters AS query_id, class FROM ev WHERE item_id % 5 = 0),
qv AS (SELECT query_id, term, w FROM qs JOIN tu USING (text) UNION ALL SELECT query_id, term, w FROM qs JOIN fu USING (filters))"""


def _fit(name: str, source: str) -> str:
    """Counts and priors of a set of events, and every weight of the four models."""
    return f"""{name}nc AS (SELECT class, term, sum(n * w) AS c FROM (SELECT class, text, count(*) AS n FROM {source} GROUP BY ALL) JOIN tu USING (text) GROUP BY ALL
  UNION ALL SELECT class, term, sum(n * w) FROM (SELECT class, filters, count(*) AS n FROM {source} GROUP BY ALL) JOIN fu USING (filters) GROUP BY ALL),
{name}pr AS (SELECT class, ln((count(*) + 1e0) / (sum(count(*)) OVER () + count(*) OVER ())) AS prior FROM {source} GROUP BY class),
{name}gr AS (SELECT class, term, coalesce(c, 0e0) AS c FROM (SELECT class FROM {name}pr) CROSS JOIN (SELECT block || ' ' || term AS term FROM voc) LEFT JOIN {name}nc USING (class, term)),
{name}al AS (SELECT class, term, a, c + a AS m, sum(c) OVER (PARTITION BY term, a) - c + a AS r FROM {name}gr, (SELECT unnest([1e-1, 1e0]) AS a)),
{name}wt AS (SELECT class, term, a, ln(m) - ln(sum(m) OVER (PARTITION BY class, a)) AS mw, ln(sum(r) OVER (PARTITION BY class, a)) - ln(r) AS cw FROM {name}al),
{name}sm AS (SELECT query_id, class, a, sum(w * mw) AS ms, sum(w * cw) AS cs FROM qv JOIN {name}wt USING (term) GROUP BY ALL),
{name}sc AS (SELECT query_id, class, CASE a WHEN 1e-1 THEN 0 ELSE 1 END AS model, prior + ms AS s FROM {name}sm JOIN {name}pr USING (class) UNION ALL SELECT query_id, class, CASE a WHEN 1e-1 THEN 2 ELSE 3 END, cs FROM {name}sm)"""


GRID_CTE = f"""{VOCABULARY_CTE}, {_fit('a', 'fe')}, rk AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY round(s, 9) DESC, class) AS r FROM asc_),
pq AS (SELECT model, query_id, avg((r <= 1)::INT) AS a, avg((r <= 5)::INT) AS b, avg((r <= 10)::INT) AS c FROM rk JOIN tc USING (query_id, class) GROUP BY ALL),
gm AS (SELECT model, round(avg(a), 9) AS recall_at_1, round(avg(b), 9) AS recall_at_5, round(avg(c), 9) AS recall_at_10 FROM pq GROUP BY model),
ch AS (SELECT *, row_number() OVER (ORDER BY recall_at_5 DESC, model) = 1 AS chosen FROM gm)""".replace("asc AS (", "asc_ AS (")


@query(f"WITH {VOCABULARY_CTE} SELECT 'v1' AS version, block, term, round(idf, 6) AS idf FROM voc")
def intent_vocabulary(spark, sf):
    return _stage(spark, sf)[2].withColumn("idf", F.round("idf", 6))


@query(f"WITH {GRID_CTE} SELECT CASE WHEN model < 2 THEN 'multinomial' ELSE 'complement' END AS kind, CASE WHEN model % 2 = 0 THEN 1e-1 ELSE 1e0 END AS alpha, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, chosen FROM ch")
def intent_grid(spark, sf):
    """Four models from one table of counts, compared on the queries of the events left out."""
    return _compared(*_stage(spark, sf)).select("kind", "alpha", *(F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in (1, 5, 10)), "chosen")


def _compared(_, fit, vocabulary, queries, truth):
    grid = intent.fit_grid(intent.intent_counts(fit, vocabulary), vocabulary, fit)
    return kept(intent.grid_recall(intent.predict_grid(intent.query_vectors(queries, vocabulary), queries, grid), truth))


@query(f"""WITH {GRID_CTE}, {_fit('b', 'ev')}, fin AS (SELECT query_id, class, s, max(s) OVER (PARTITION BY query_id) AS m FROM bsc WHERE model = (SELECT model FROM ch WHERE chosen))
SELECT query_id, class, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY query_id), 5) AS prob FROM fin""")
def intent_refit(spark, sf):
    """The chosen model counted on all events over the frozen vocabulary: probabilities of the queries' classes."""
    e, fit, vocabulary, queries, truth = _stage(spark, sf)
    best = _compared(e, fit, vocabulary, queries, truth).where("chosen").first()
    grid = intent.refit(e, vocabulary, (best["kind"], best["alpha"]))
    s = intent.predict_grid(intent.query_vectors(queries, vocabulary), queries, grid)
    return s.select("query_id", "class", F.round(softmax(F.col("score")), 5).alias("prob"))
