"""Chat formatting by prefix-target expansion: one training example for each assistant turn. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escape(text):
    """Puts one more backslash into every `<|`, `<\\|`, `<\\\\|`, ..., so that no text holds a `<|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text):
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, whole, text, loss_start, loss_end): every assistant turn with all turns before it.

    Each turn is `<|im_start|>role\\ntext<|im_end|>\\n`; only [loss_start, loss_end), in code points of the example's
    text, is trainable: the reply, without its marks. A conversation whose last turn isn't the assistant's ends with
    one more example that holds all of it and trains nothing (null bounds). whole: the example holds every turn. Turns
    go by turn number (null first), then role, then text; repeated rows stay. Null roles and texts are empty; a null
    conv_id is a conversation. An empty table gives no rows, other columns are ignored. One conversation's text is one
    value, so it has to fit in a row; offsets come from a window, which spills.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    t = t.withColumn("head", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("said")))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END + "\n"))).withColumn("n", F.length("piece").cast("long"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    t = t.withColumn("stop", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(w))
    t = t.withColumn("from", F.col("stop") - F.col("n") + F.length("head"))
    g = t.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("i", "stop", "from", (F.col("from") + F.length("body")).alias("to"))))).alias("targets"),
        F.max("i").alias("n_all"), F.sum("n").alias("length"),
    )
    tail = F.struct(F.col("n_all").alias("i"), F.col("length").alias("stop"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    none = F.coalesce(F.get(F.col("targets"), F.size("targets") - 1)["i"], F.lit(0)) < F.col("n_all")
    e = g.select("conv_id", "all", "n_all", F.posexplode(F.when(none, F.concat("targets", F.array(tail))).otherwise(F.col("targets"))).alias("example", "x"))
    return e.select(
        "conv_id", (F.col("example") + 1).cast("long").alias("example"), F.col("x.i").cast("long").alias("n_turns"), (F.col("x.i") == F.col("n_all")).alias("whole"),
        F.substring(F.col("all"), F.lit(1), F.col("x.stop").cast("int")).alias("text"), F.col("x.from").alias("loss_start"), F.col("x.to").alias("loss_end"),
    )


def read_turns(text):
    """Array of (role, text) structs that a formatted text holds."""
    each = F.slice(F.split(text, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(text, r"<\|im_start\|>")) - 1, F.lit(0)))

    def turn(x):
        head = F.substring_index(x, "\n", 1)
        n = F.length(head)
        return F.struct(unescape(F.replace(head, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(F.substring(x, n + 2, F.length(x) - n - 1 - len(END) - 1)).alias("text"))

    return F.transform(each, turn)


def read_loss(text, start, end):
    """The text under the loss mask, unescaped; empty where nothing is trained."""
    return F.coalesce(unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))), F.lit(""))


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL}'), (-1L, 1L, 'assistant', '{CONTROL}') AS t(conv_id, turn, role, text)")
    out = prefix_targets(turns.unionByName(own))
    said = F.array_join(F.transform(read_turns(F.col("text")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.select(
        "conv_id", "example", "n_turns", F.when(F.col("whole"), F.sha2(said, 256)).alias("turns"), F.length("text").cast("long").alias("n"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    g = out.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns").alias("turns_sha256"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("n").alias("formatted_chars"))
    return g.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS c,
    sum({len(START) + len(END) + 2} + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + {len(LINE) - 1} * (length(role) - length(replace(role, chr(10), ''))) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(stop) FILTER (WHERE role = 'assistant' OR i = c))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""
