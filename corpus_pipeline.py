"""A corpus pipeline of five operators; every stage is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, minhash, mixing, quality
from tessera.llm.common import materialize, quoted, sized, table


def _carried(docs: DataFrame) -> DataFrame:
    """docs as (row, doc_id, source, text): all columns but the text travel as one, so no name of the caller's can clash."""
    rest = F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text"))
    return docs.select(rest.alias("row"), "doc_id", "source", "text")


def _restored(out: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The documents' columns from carried rows, and in their place the changed ones."""
    own = {"text": F.col("text")} | changed
    return out.select(*((own[c] if c in own else F.col(f"row.{quoted(c)}")).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps; null texts go as empty ones, repeated rows alike."""
    return _restored(quality.apply_policy(quality.ledger(_carried(docs))).where("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; n_chars follows the text, and no document goes."""
    return _restored(lines.dedup_lines(_carried(docs)), docs.columns, n_chars=F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8). Rows of one id stay together."""
    gone = materialize(minhash.near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(*(F.col(quoted(c)) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return _restored(mixing.mix(_carried(docs)), docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their whole texts, and those decoded again (columns ids and decoded, replaced if there)."""
    return bpe.decode(bpe.encode(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]
#: No SQL for BPE ids; tests/llm holds all rows of run() against a plain version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
