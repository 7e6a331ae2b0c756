"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, table

#: Lengths that one window of the suffix sums covers.
SPAN = 1024
_loaded: dict = {}


def _encoding(path: str):
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encoded_lengths(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the column `out` (long): ids of the whole text, strings of special tokens being ordinary text. Null: 0."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    keep = [f for f in docs.drop(out).schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(np.array(n, np.int64))], [*(f.name for f in keep), out])

    return docs.select(*(f.name for f in keep), text).mapInArrow(run, T.StructType([*keep, T.StructField(out, T.LongType())]))


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs, docs_at_most, docs_at_least, tokens_at_least, truncated_total), one row for each length that occurs.

    truncated_total: tokens left when every document is cut at n_tokens. Sums run inside spans of SPAN lengths and over
    the totals of the spans, so no task ever holds more than a span, whatever the longest document is. Null lengths
    count as 0, rows that repeat count each, other columns don't matter. An empty table gives no rows. The counts are written
    once, so that no text is encoded twice.
    """
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    h = lengths.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    h = materialize(h)
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    up = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select("span", F.coalesce(F.sum("d").over(up), zero).alias("d_below"), F.coalesce(F.sum("t").over(up), zero).alias("t_below"), F.coalesce(F.sum("d").over(down), zero).alias("d_above"), F.coalesce(F.sum("t").over(down), zero).alias("t_above"))
    inside = Window.partitionBy("span").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    w = h.join(spans, "span").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d_below")).alias("docs_at_most"),
        (F.sum("n_docs").over(above) + F.col("d_above")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(above) + F.col("t_above")).alias("tokens_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_below")).alias("tokens_at_most"),
    )
    cut = F.col("tokens_at_most") + F.col("n_tokens") * (F.col("docs_at_least") - F.col("n_docs"))
    return w.select("n_tokens", "n_docs", "docs_at_most", "docs_at_least", "tokens_at_least", cut.alias("truncated_total"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated_total) for each context limit, from the histogram alone; no documents: zeros."""
    c = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    over = F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")))
    kept = F.sum(F.least("n_tokens", "context") * F.col("n_docs"))
    return F.broadcast(c).join(histogram, F.lit(True), "left").groupBy("context").agg(F.coalesce(over, F.lit(0)).alias("docs_over"), F.coalesce(kept, F.lit(0)).alias("truncated_total"))


def quantiles(histogram: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, n_tokens): the least length that at least this fraction of the documents doesn't exceed; none: null."""
    q = histogram.sparkSession.createDataFrame([(float(x),) for x in fractions], "fraction double")
    n = histogram.agg(F.sum("n_docs").alias("n"))
    hit = F.col("docs_at_most") >= F.col("fraction") * F.col("n")
    return F.broadcast(q).join(F.broadcast(n)).join(histogram, hit, "left").groupBy("fraction").agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents").select("text")))
