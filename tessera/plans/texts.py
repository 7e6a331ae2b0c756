"""Normalisers, tokens, n-grams, strata, flags and scans."""

from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import ranking, remote, search, split, validate
from tessera.queries import query
from tessera.sources.adapters import COORDINATES, EVENTS, benchmark, coordinates, documents, events, fields, table, tok

_SP = r"'\s+'"


@query(rf"""SELECT doc_id, substring(replace(lower(text), 'ё', 'е'), 1, 1800) AS cleaned, replace(lower(text), 'ё', 'е') AS cleaned_whole, array_to_string({tok('text')}, ' ') AS normalized, trim(regexp_replace(text, {_SP}, ' ', 'g')) AS collapsed,
  concat_ws('. ', nullif(trim(regexp_replace(substring(text, 1, 80), {_SP}, ' ', 'g')), ''), nullif(trim(regexp_replace(lang || ' ' || source, {_SP}, ' ', 'g')), ''), nullif(trim(regexp_replace(substring(text, 1, 600), {_SP}, ' ', 'g')), '')) AS item_text FROM documents""")
def norm_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.clean_text(F.col("text"), 1800).alias("cleaned"), T.clean_text(F.col("text"), None).alias("cleaned_whole"), T.normalize_query(F.col("text")).alias("normalized"), T.collapse(F.col("text")).alias("collapsed"), T.item_text(F.substring("text", 1, 80), F.concat_ws(" ", "lang", "source"), F.col("text")).alias("item_text"))


@query(rf"SELECT doc_id, len({tok('text')})::BIGINT AS n_tokens, array_to_string({tok('text')}, '|') AS tokens FROM documents")
def tokens(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.concat_ws("|", t).alias("tokens"))


@query(rf"""WITH t AS (SELECT item_id, {tok('text')} AS t FROM benchmark)
SELECT item_id, array_to_string(list_concat(list_transform(t, lambda x: 'w:' || x), list_transform(range(1, len(t)), lambda i: 'b:' || t[i] || '_' || t[i + 1])), ' ') AS features FROM t""")
def bigrams(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", T.word_features(T.tokens(F.col("text")))).alias("features"))


@query(rf"""WITH w AS (SELECT p_partkey, ' ' || unnest({tok('p_name')}) || ' ' AS w FROM part), n AS (SELECT unnest([3, 4, 5]) AS n)
SELECT p_partkey, substring(w, i::BIGINT, n) AS gram, count(*)::BIGINT AS n FROM (SELECT p_partkey, w, n, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) AS i FROM w, n WHERE n = 3 OR len(w) > n - 1) GROUP BY ALL""")
def char_ngrams(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    n = p.agg(F.sum(F.length("p_name")) * 3).first()[0] or 0  # at most so many n-grams, about
    return search.term_counts(search.by_item(p, n, "p_partkey"), "p_partkey", T.char_grams(T.tokens(F.col("p_name")))).select("p_partkey", F.col("term").alias("gram"), F.col("tf").alias("n"))


_BIN = "CASE WHEN length({c}) <= 14 THEN 0 WHEN length({c}) <= 21 THEN 1 WHEN length({c}) <= 29 THEN 2 WHEN length({c}) <= 39 THEN 3 ELSE 4 END"


@query(f"SELECT {_BIN.format(c='p_name')} || '|empty=' || CASE WHEN p_size % 3 = 0 THEN 'True' ELSE 'False' END AS stratum, count(*)::BIGINT AS n FROM part GROUP BY 1")
def length_strata(spark, sf):
    p = table(spark, sf, "part").select(T.stratum(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.lit("x"))).alias("stratum"))
    return p.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT page_id, array_to_string(regexp_extract_all(replace(lower(html), 'ё', 'е'), '[\p{{L}}\p{{N}}_]+'), ' ') AS k FROM pages")
def word_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.word_key(F.col("html")).alias("k"))


@query(rf"SELECT page_id, replace(substring(trim(regexp_replace(html, {_SP}, ' ', 'g')), 1, 220), '|', '\|') AS compact, replace(lower(substring(html, 1, 1000)), 'ё', 'е') AS cut FROM pages")
def compact_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.compact(F.col("html")).alias("compact"), T.prefix_then_lower(F.col("html"), 1000).alias("cut"))


#: Wording that the generated tables lack, and wording close to it that must not count.
WORDING = (
    "Урок он-лайн", "онлайн урок", "он лайн", "Онлайнер", "English online, daily", "удалённо", "Работаю УДАЛЕННО", "на удалёнке", "удаление зубов", "удаленный доступ", "дистанционное обучение", "дистанция",
    "помощь через интернет", "в интернете", "интернет провели", "По всей России", "во всей  России", "вся россия", "по России", "россия", "из любой точки России", "любой город россии", "все города в России", "все города", "remote zoom skype", "",
)


def _has(words: str) -> str:
    """Whole words, for an engine whose word boundaries know Latin letters only."""
    return rf"regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


_RU = r"росси[а-я]*"
_WORDING_SQL = ", ".join(f"({-1 - i}, '{w}')" for i, w in enumerate(WORDING))


@query(rf"""WITH c AS (SELECT conv_id, turn::BIGINT AS turn, text FROM conversations UNION ALL SELECT id, 0, text FROM (VALUES {_WORDING_SQL}) v(id, text)),
x AS (SELECT conv_id, turn, replace(lower(coalesce(text, '')), 'ё', 'е') AS t FROM c)
SELECT conv_id, turn, {_has(r"он[\s-]?лайн|online")} AS online, {_has(r"удаленн[а-я]*|удаленк[а-я]*|дистанцион[а-я]*|(?:по|через|в)\s+интернет[а-я]*")} AS remote,
  {_has(rf"(?:по\s+всей|во\s+всей|вся|всей|по)\s+{_RU}|(?:люб[а-я]*\s+(?:точк[а-я]*|город[а-я]*)|все\s+город[а-я]*)\s+(?:в\s+)?{_RU}")} AS nationwide FROM x""")
def remote_flags(spark, sf):
    rows = spark.createDataFrame([(-1 - i, 0, w) for i, w in enumerate(WORDING)], "conv_id long, turn long, text string")
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text").union(rows)
    return remote.query_flags(c).drop("text")


@query("""SELECT event_id, user_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, ln(1e0 + greatest(coalesce(value, 0e0), 0e0)) > 1e0 AS large FROM events""")
def json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"), (N.log_positive(F.col("value")) > 1.0).alias("large"))


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS sd, min(l_quantity) AS least, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(median(l_quantity), 4) AS q2, round(quantile_cont(l_quantity, 0.75), 4) AS q3, max(l_quantity) AS most FROM lineitem GROUP BY ALL""")
def summary_stats(spark, sf):
    x = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("least"), F.round(F.percentile(x, 0.25), 4).alias("q1"), F.round(F.percentile(x, 0.5), 4).alias("q2"), F.round(F.percentile(x, 0.75), 4).alias("q3"), F.max(x).alias("most"))


@query("""SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_distinct, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::HUGEINT)::VARCHAR AS fingerprint FROM documents""")
def id_fingerprint(spark, sf):
    return validate.id_fingerprint(table(spark, sf, "documents"), "doc_id")


@query(f"""WITH k AS (SELECT sha256(concat_ws(chr(1), p_name, p_brand, p_type)) AS qkey FROM part) SELECT qkey, count(*)::BIGINT AS n FROM k GROUP BY qkey""")
def query_keys(spark, sf):
    return table(spark, sf, "part").select(split.query_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("qkey")).groupBy("qkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, coalesce(text, '') AS text FROM documents WHERE lang IN ('en', 'fr')")
def pruned_scan(spark, sf):
    from tessera.sources.io import load_items

    return load_items(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "text"], text_columns=("text",), chars=None).where(F.col("lang").isin("en", "fr"))


@query(rf"""WITH t AS (SELECT item_id, len(q) AS n, unnest(q) AS term FROM (SELECT item_id, list_distinct({tok('text')}) AS q FROM benchmark)), d AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS term FROM documents)
SELECT item_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS coverage FROM t JOIN d USING (term) GROUP BY ALL""")
def feature_coverage(spark, sf):
    """Every passage and document that share a token."""
    q = T.once(benchmark(spark, sf), F.array_distinct(T.tokens(F.col("text"))).alias("q")).select(F.col("query_id").alias("item_id"), F.size("q").alias("n"), F.explode("q").alias("term"))
    d = T.once(documents(spark, sf), F.array_distinct(T.tokens(F.col("text"))).alias("d")).select(F.col("item_id").alias("doc_id"), F.explode("d").alias("term"))
    return q.join(d, "term").groupBy("item_id", "doc_id").agg(F.round(F.count(F.lit(1)).cast("double") / F.first("n"), 6).alias("coverage"))


@query(f"""WITH {EVENTS} SELECT DISTINCT item_id, {COORDINATES} FROM ev""")
def item_places(spark, sf):
    return coordinates(events(spark, sf)).select("item_id", "lat", "lon").distinct()


@query(rf"""WITH f AS (SELECT doc_id AS item_id, len({tok('substring(text, 1, 80)')}) AS title, len({tok("lang || ' ' || source")}) AS params, len({tok('text')}) AS description FROM documents)
SELECT item_id, title::BIGINT AS title, params::BIGINT AS params, description::BIGINT AS description, round(title / (SELECT avg(title) FROM f), 6) AS title_share FROM f""")
def field_length(spark, sf):
    f = fields(spark, sf).select("item_id", *(F.size(T.tokens(F.col(c))).cast("long").alias(c) for c in ("title", "params", "description")))
    return f.crossJoin(F.broadcast(f.agg(F.avg("title").alias("m")))).select("item_id", "title", "params", "description", F.round(F.col("title") / F.col("m"), 6).alias("title_share"))


@query(rf"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS total FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, sf):
    c = search.term_counts(documents(spark, sf), "item_id", T.tokens(F.col("text")))
    return c.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query("""SELECT event_type, user_id, event_id, round(value, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events WHERE value > 0) WHERE rank <= 50""")
def top_per_group(spark, sf):
    return ranking.top_k(table(spark, sf, "events").select("event_type", "user_id", "event_id", "value"), 50, "value", "event_type", "event_id").withColumn("value", F.round("value", 6))
