"""Naive Bayes intent models from counts: frozen vocabulary, fit, a grid of models scored in one pass, predict, recall, refit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ranking import softmax
from tessera.operators.search import document_frequency, small, term_counts
from tessera.sources.io import kept

#: Weights of a text's words, of its characters, and of the filters beside it.
BLOCKS = {"word": 0.8, "char": 0.6, "filter": 0.35}
#: The models that are compared, in order.
GRID = (("multinomial", 0.1), ("multinomial", 1.0), ("complement", 0.1), ("complement", 1.0))


def class_counts(events: DataFrame, terms: DataFrame, text: str = "text", cls: str = "class") -> DataFrame:
    """(class, term, c): events per class and text come first, and only then meet the texts' terms (term, w)."""
    n = events.groupBy(cls, text).agg(F.count(F.lit(1)).alias("n"))
    return n.join(terms, text).groupBy(cls, "term").agg(F.sum(F.col("n") * F.col("w")).alias("c"))


def token_class_counts(rows: DataFrame, tok: Column, cls: str = "class") -> DataFrame:
    """(class, term, c) of rows that each have a text of their own: a task sums up its tokens by class before any travels."""
    return rows.select(cls, F.explode(tok).alias("term")).groupBy(cls, "term").agg(F.count(F.lit(1)).cast("double").alias("c"))


def priors(events: DataFrame, cls: str = "class") -> DataFrame:
    """(class, n, prior): ln((n + 1) / (N + K))."""
    c = events.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(t)).select(cls, "n", F.log((F.col("n") + 1.0) / (F.col("all_n") + F.col("k"))).alias("prior"))


@dataclass(frozen=True)
class Weights:
    """Weights of classes and terms as sums of three parts, so that a class that never saw a term takes no row.

    classes (class, part), terms (term, part) for each term of the vocabulary, extra (class, term, part) where counts are.
    """

    classes: DataFrame
    terms: DataFrame
    extra: DataFrame
    cls: str = "class"

    def by_term(self) -> DataFrame:
        """(term, b, parts): a row a term, with the parts of the classes (k, p) that saw it; null if none did."""
        e = self.extra.where(F.col(self.cls).isNotNull()).groupBy("term").agg(F.collect_list(F.struct(F.col(self.cls).alias("k"), F.col("part").alias("p"))).alias("parts"))
        return self.terms.withColumnRenamed("part", "b").join(e, "term", "left")

    def table(self) -> DataFrame:
        """(class, term, weight) of every class and term: for reports, as large as that. Terms travel once, not once for each class."""
        c, _ = small(self.classes.withColumnRenamed("part", "a"))
        t = self.by_term().select("term", "b", F.map_from_entries("parts").alias("parts"))
        return t.crossJoin(c).select(self.cls, "term", (F.col("a") + F.col("b") + F.coalesce(F.col("parts")[F.col(self.cls)], F.lit(0.0))).alias("weight"))


def _counted(counts: DataFrame, vocabulary: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positive counts of the vocabulary's terms, those terms, and their number (one row)."""
    terms = (counts if vocabulary is None else vocabulary).select("term").distinct()
    c = counts if vocabulary is None else counts.join(terms, "term", "left_semi")
    return c.withColumn("c", F.col("c").cast("double")).where("c > 0"), terms, terms.agg(F.count(F.lit(1)).alias("v"))


def multinomial(counts: DataFrame, alpha: float = 0.1, vocabulary: DataFrame | None = None, cls: str = "class") -> Weights:
    """Weights ln((c + alpha) / sum(c + alpha)) over a fixed vocabulary."""
    c, terms, size = _counted(counts, vocabulary)
    total = counts.select(cls).distinct().join(c.groupBy(cls).agg(F.sum("c").alias("s")), cls, "left").crossJoin(F.broadcast(size))
    classes = total.select(cls, (F.log(F.lit(alpha)) - F.log(F.coalesce("s", F.lit(0.0)) + F.col("v") * alpha)).alias("part"))
    return Weights(classes, terms.withColumn("part", F.lit(0.0)), c.select(cls, "term", (F.log(F.col("c") + alpha) - F.log(F.lit(alpha))).alias("part")), cls)


def complement(counts: DataFrame, alpha: float = 0.1, vocabulary: DataFrame | None = None, cls: str = "class") -> Weights:
    """Weights -ln(rest + alpha) + ln sum(rest + alpha), rest being the other classes' count."""
    c, terms, size = _counted(counts, vocabulary)
    one = size.crossJoin(c.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("all")))
    total = counts.select(cls).distinct().join(c.groupBy(cls).agg(F.sum("c").alias("s")), cls, "left").crossJoin(F.broadcast(one))
    classes = total.select(cls, F.log(F.col("all") - F.coalesce("s", F.lit(0.0)) + F.col("v") * alpha).alias("part"))
    t = c.groupBy("term").agg(F.sum("c").alias("t"))
    parts = terms.join(t, "term", "left").select("term", (-F.log(F.coalesce("t", F.lit(0.0)) + alpha)).alias("part"))
    extra = c.join(t, "term").select(cls, "term", (F.log(F.col("t") + alpha) - F.log(F.col("t") - F.col("c") + alpha)).alias("part"))
    return Weights(classes, parts, extra, cls)


def predict(terms: DataFrame, weights: Weights, intercept: DataFrame, q: str = "query_id", temperature: float = 1.0) -> DataFrame:
    """(query, class, score, prob): terms (query, term, w) outside the vocabulary add nothing. They meet the weights once:
    a row a term holds the parts of all classes that saw it."""
    cls = weights.cls
    kind = weights.extra.schema[cls].dataType
    own = F.array(F.struct(F.lit(None).cast(kind).alias("k"), F.col("b").alias("p")))  # the term's part, under no class
    each = terms.join(weights.by_term(), "term", "left").select(q, "w", F.explode(F.concat(own, F.coalesce("parts", F.slice(own, 1, 0)))).alias("x"))
    sums = each.groupBy(q, F.col("x.k").alias("k")).agg(F.sum(F.when(F.col("x.p").isNotNull(), F.col("w"))).alias("n"), F.sum(F.col("w") * F.col("x.p")).alias("e"))
    of = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "e")))
    base = lambda c: F.max(F.when(F.col("k").isNull(), F.col(c)))
    per = sums.groupBy(q).agg(base("n").alias("n"), base("e").alias("tb"), F.map_from_entries(of).alias("es"))
    classes, _ = small(intercept.select(cls, "prior").join(weights.classes.withColumnRenamed("part", "a"), cls, "left"))
    s = per.crossJoin(classes).withColumn("e", F.col("es")[F.col(cls)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = s.withColumn("score", F.col("prior") + zero("a") * zero("n") + zero("tb") + zero("e"))
    return s.select(q, cls, "score", softmax(F.col("score"), temperature, q).alias("prob"))


def class_ranks(probs: DataFrame, q: str = "query_id", cls: str = "class") -> DataFrame:
    r = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("prob"), cls)).cast("long")
    return probs.withColumn("rank", r).withColumn("reciprocal", F.lit(1.0) / F.col("rank"))


def class_recall(ranks: DataFrame, truth: DataFrame, ks: tuple = (1, 5, 10), q: str = "query_id", cls: str = "class") -> DataFrame:
    """One row: for each k, the mean over queries of the share of true classes ranked k or better."""
    j = truth.select(q, cls).distinct().join(ranks.select(q, cls, "rank"), [q, cls], "left")
    per = j.groupBy(q).agg(*(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks))
    return per.agg(*(F.avg(f"recall_at_{k}").alias(f"recall_at_{k}") for k in ks))


def _block_counts(rows: DataFrame, column: str, block: str) -> DataFrame:
    """(column, term, tf) of different texts: words of two characters and more with their pairs, or n-grams inside words."""
    d = rows.select(column).where(F.col(column).isNotNull()).distinct()
    tok = T.tokens(F.col(column))
    return term_counts(d, column, T.char_grams(tok) if block == "char" else T.word_features(F.filter(tok, lambda x: F.length(x) > 1)))


def fit_vocabulary(events: DataFrame, version: str, text: str = "text", filters: str = "filters") -> DataFrame:
    """(version, block, term, idf): the terms of the events' texts and filters with their smoothed IDF.

    Written and read again it stays as it is, whatever later models count: a refit on more events has the same terms.
    """
    out = None
    for block in BLOCKS:
        column = filters if block == "filter" else text
        n = events.select(column).where(F.col(column).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n"))
        df = document_frequency(_block_counts(events, column, block)).crossJoin(F.broadcast(n))  # one row
        v = df.select(F.lit(version).alias("version"), F.lit(block).alias("block"), "term", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
        out = v if out is None else out.union(v)
    return out


def _unit(rows: DataFrame, column: str, weight: float = 1.0) -> DataFrame:
    norm = rows.groupBy(column).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, column).select(column, "term", (F.col("w") / F.col("norm") * weight).alias("w"))


def _block(rows: DataFrame, column: str, block: str, vocabulary: DataFrame) -> DataFrame:
    v = vocabulary.where(F.col("block") == block).select("term", "idf")
    c = _block_counts(rows, column, block).join(v, "term")
    w = c.select(column, F.concat(F.lit(f"{block} "), "term").alias("term"), ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    return _unit(w, column, BLOCKS[block])


def text_terms(rows: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(text, term, w) of different texts: words and characters, of unit length together; terms outside the vocabulary add nothing."""
    return _unit(_block(rows, text, "word", vocabulary).union(_block(rows, text, "char", vocabulary)), text)


def filter_terms(rows: DataFrame, vocabulary: DataFrame, filters: str = "filters") -> DataFrame:
    """(filters, term, w) of different filter texts, with the filters' weight."""
    return _block(rows, filters, "filter", vocabulary)


def query_vectors(queries: DataFrame, vocabulary: DataFrame, q: str = "query_id", text: str = "text", filters: str = "filters") -> DataFrame:
    """(query, term, w): the text's terms and the filters' beside them."""
    t = queries.select(q, text).join(text_terms(queries, vocabulary, text), text).select(q, "term", "w")
    return t.union(queries.select(q, filters).join(filter_terms(queries, vocabulary, filters), filters).select(q, "term", "w"))


def intent_counts(events: DataFrame, vocabulary: DataFrame, cls: str = "class", text: str = "text", filters: str = "filters") -> DataFrame:
    """(class, term, c): events are counted by class and text, and by class and filters, before they meet any term."""
    by_text = class_counts(events, text_terms(events, vocabulary, text), text, cls)
    return by_text.union(class_counts(events, filter_terms(events, vocabulary, filters), filters, cls))


@dataclass(frozen=True)
class Grid:
    """Several models' weights, each as an array in the order of `models`, in the three parts of Weights; and their intercepts."""

    models: tuple
    classes: DataFrame
    terms: DataFrame
    extra: DataFrame
    intercepts: DataFrame


def fit_grid(counts: DataFrame, vocabulary: DataFrame, events: DataFrame, models: tuple = GRID, cls: str = "class") -> Grid:
    """All models from one table of counts. Multinomial ones start from the classes' priors, complement ones from 0."""
    terms = vocabulary.select(F.concat("block", F.lit(" "), "term").alias("term")).distinct()
    c = counts.withColumn("c", F.col("c").cast("double")).where("c > 0").join(terms, "term", "left_semi")
    c = kept(c.select(cls, "term", "c"))
    one = terms.agg(F.count(F.lit(1)).alias("v")).crossJoin(c.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("all")))
    s = priors(events, cls).join(c.groupBy(cls).agg(F.sum("c").alias("s")), cls, "left").fillna(0.0, ["s"]).crossJoin(F.broadcast(one))
    t = terms.join(c.groupBy("term").agg(F.sum("c").alias("t")), "term", "left").fillna(0.0, ["t"])
    x = c.join(t, "term")
    col = F.col

    def each(multinomial, complement):
        return F.array(*((multinomial if kind == "multinomial" else complement)(float(alpha)) for kind, alpha in models))

    in_class = each(lambda a: F.log(F.lit(a)) - F.log(col("s") + col("v") * a), lambda a: F.log(col("all") - col("s") + col("v") * a))
    in_term = each(lambda _: F.lit(0.0), lambda a: -F.log(col("t") + a))
    in_both = each(lambda a: F.log(col("c") + a) - F.log(F.lit(a)), lambda a: F.log(col("t") + a) - F.log(col("t") - col("c") + a))
    start = each(lambda _: col("prior"), lambda _: F.lit(0.0))
    return Grid(tuple(models), s.select(cls, in_class.alias("part")), t.select("term", in_term.alias("part")), x.select(cls, "term", in_both.alias("part")), s.select(cls, start.alias("part")))


def predict_grid(terms: DataFrame, queries: DataFrame, grid: Grid, q: str = "query_id", cls: str = "class") -> DataFrame:
    """(query, class, model, score): every query and class by all models, from one pass over the terms. Queries without a
    known term get the intercepts. Few classes: they meet every query."""
    k = range(len(grid.models))
    sums = lambda to: [F.sum(F.col("w") * F.get("part", F.lit(i))).alias(f"{to}{i}") for i in k]
    known = terms.join(grid.terms, "term")
    per = known.groupBy(q).agg(F.sum("w").alias("n"), *sums("t"))
    extra = terms.join(grid.extra, "term").groupBy(q, cls).agg(*sums("e"))
    both = grid.classes.select(cls, F.col("part").alias("a")).join(grid.intercepts.select(cls, F.col("part").alias("b")), cls)
    s = queries.select(q).distinct().crossJoin(both).join(per, q, "left").join(extra, [q, cls], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scores = F.array(*(F.get("b", F.lit(i)) + F.get("a", F.lit(i)) * zero("n") + zero(f"t{i}") + zero(f"e{i}") for i in k))
    return s.select(q, cls, F.posexplode(scores).alias("model", "score"))


def grid_recall(scores: DataFrame, truth: DataFrame, models: tuple = GRID, ks: tuple = (1, 5, 10), q: str = "query_id", cls: str = "class") -> DataFrame:
    """(model, kind, alpha, recall_at_k ..., chosen): the best recall at 5 is chosen, the first of equal ones."""
    r = F.row_number().over(Window.partitionBy("model", q).orderBy(F.desc(F.round("score", 9)), cls))
    j = truth.select(q, cls).distinct().join(scores.withColumn("rank", r).select("model", q, cls, "rank"), [q, cls])
    per = j.groupBy("model", q).agg(*(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks))
    m = per.groupBy("model").agg(*(F.round(F.avg(f"recall_at_{k}"), 9).alias(f"recall_at_{k}") for k in ks))
    names = F.create_map(*(x for i, (kind, alpha) in enumerate(models) for x in (F.lit(i), F.struct(F.lit(kind).alias("kind"), F.lit(float(alpha)).alias("alpha")))))
    best = F.row_number().over(Window.orderBy(F.desc("recall_at_5"), "model")) == 1  # a row a model
    return m.select("model", names[F.col("model")]["kind"].alias("kind"), names[F.col("model")]["alpha"].alias("alpha"), *(f"recall_at_{k}" for k in ks), best.alias("chosen"))


def refit(events: DataFrame, vocabulary: DataFrame, model: tuple, cls: str = "class") -> Grid:
    """The chosen model counted on other (all) events, over the same vocabulary."""
    return fit_grid(intent_counts(events, vocabulary, cls), vocabulary, events, (model,), cls)
