"""What several of the operators share: reading tables, shared-folder tables, components."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words here; also what bytes.split() splits at.
SPACE = "[\\x20\\x09-\\x0D]"
NO_SPACE = "[^\\x20\\x09-\\x0D]"
#: What a broadcast side of a join may have; larger ones go by a shuffle.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20
#: Bytes of a batch of rows on their way to Python: the default of 64 MB, held several times over, is most of a worker.
BATCH_BYTES = 4 << 20
_own_dir: list[str] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in a local session without one a folder of our own.

    A cluster without the setting raises: its executors would each write to a disk of their own.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        set_to = _own_dir[0]
    return set_to.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder (one computation; checkpoint() takes two)."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark._jvm.System.gc()  # lets Spark delete the shuffle files that nothing reads any more
    time.sleep(0.3)  # what the last job held goes through finalizers first
    spark._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "kept_at", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(right: DataFrame, limit: int | None = None) -> DataFrame:
    """A side of a join, marked for broadcast if it was counted to have at most limit rows (SMALL_ROWS, if None) and, as
    a table of materialize(), takes at most SMALL_BYTES of files."""
    path, spark = getattr(right, "kept_at", None), right.sparkSession
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() > SMALL_BYTES:
            return right
    return F.broadcast(right) if right.count() <= (SMALL_ROWS if limit is None else limit) else right


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def trimmed() -> None:
    """Gives back what the last task of this worker freed; it would stay with the worker, beside the next task's memory.
    Within a task, freed arrays stay for the next ones: fresh pages for each cost time."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim(0)
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def quoted(name: str) -> str:
    """A column's name as F.col() takes it literally, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


#: Up to so many edges (16 bytes each) one task joins them; more take rounds of aggregations over all tasks.
SMALL_EDGES = 1_000_000


def _union_find(frames):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for f in frames:
        for u, v in zip(f["u"].tolist(), f["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pd.DataFrame({"id": ids, "component": [root(x) for x in ids]}, dtype="int64")


def components(edges: DataFrame, small_edges: int = SMALL_EDGES, loops: bool = False) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (id, component), the component being its smallest id.

    A counted set of at most small_edges edges is joined in one task. More take alternating large-star and small-star
    steps, each one aggregation over the edges, until one changes nothing; every round is written to the shared folder.
    Ids without an edge don't appear, but with `loops` those that have an edge to themselves do. Edges may repeat, loop,
    and stand in either direction. No edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e if loops else e.where("u <> v"))
    if e.count() <= small_edges:
        return e.coalesce(1).mapInPandas(_union_find, "id long, component long")
    alone = e.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    every, e, mark = e, e.where("u <> v"), None
    while True:
        # Large star: every neighbour above u hangs on the least of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour of u, and u, hang on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialize(small)
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(e)
        e = nxt
        if now == mark:
            break
        mark = now
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    if not loops:
        discard(every)
        return out
    return out.union(alone.join(out, "id", "left_anti"))
