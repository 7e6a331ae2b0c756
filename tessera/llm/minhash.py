"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, discard, materialize, parts, sized, table

#: A signature has CHUNKS * WIDTH components of 16 bits. With ERRORS allowed in a chunk, pigeonhole finds every pair whose
#: signatures differ in at most CHUNKS * (ERRORS + 1) - 1 components; of pairs with Jaccard 0.85, all but 3 in 10 million
#: have such a chunk (0.8: all but 2 in 100,000 with 10 chunks, 3 in a million with 12).
CHUNKS, WIDTH, ERRORS, SEED = 12, 6, 1, 1
#: Different pivots that the keys of one group can have in the stars that come before the remaining pairs.
PIVOTS = 8
#: Bytes of a block of nodes whose pairs are tested in place: their sets, and NODE_BYTES for each node besides.
BLOCK_BYTES, NODE_BYTES = 2 << 20, 2048
MEMO_WORDS = 400_000
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _M3
    return h ^ (h >> _U(29))


def word_hashes(words: list[bytes], memo: dict) -> np.ndarray:
    """64-bit hashes of the words; memo keeps those of words seen, up to MEMO_WORDS."""
    new = [w for w in set(words) if w not in memo]
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = set(words)
    for w in new:
        memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), _U, len(words))


def shingle_set(text: bytes | None, k: int, memo: dict) -> np.ndarray:
    """Hashes of the distinct k-word shingles, sorted; of fewer words, the whole sequence as one; of none, nothing."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U)
    h = word_hashes(words, memo)
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, _U)
    for i in range(width):
        out = _mix(out * _M1 + h[i : len(h) - width + 1 + i] * _M2)
    return np.unique(out)


class _Signer:
    def __init__(self, size: int, seed: int):
        r = np.random.Generator(np.random.PCG64(seed))
        self.a = (r.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = r.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]

    def sign(self, s: np.ndarray) -> np.ndarray:
        low = (s >> _U(32)).astype(np.uint32)[None, :]
        least = None
        for i in range(0, low.shape[1], 4096):
            m = (low[:, i : i + 4096] * self.a + self.b).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return (least & np.uint32(0xFFFF)).astype(np.uint16)


def signatures(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", chunks: int = CHUNKS, seed: int = SEED) -> DataFrame:
    """(id, n, d1, d2, sig): size of the shingle set, its 128-bit digest, and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, signer = {}, _Signer(chunks * WIDTH, seed)
        for batch in batches:
            n, d, sig = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, k, memo)
                n.append(len(s))
                d.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(signer.sign(s).tobytes() if len(s) else None)
            two = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(sig, pa.binary())], ["id", "n", "d1", "d2", "sig"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "id long, n long, d1 long, d2 long, sig binary")


def _keys(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, rep, n): for every chunk and every choice of ERRORS (1) of its components to leave out, a hash of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, chunks, WIDTH).astype(_U)
            keys = np.empty((batch.num_rows, chunks, WIDTH), _U)
            for w in range(WIDTH):
                h = np.broadcast_to((np.arange(chunks, dtype=_U) * _U(WIDTH) + _U(w))[None, :], sig.shape[:2]).copy()
                for i in range(WIDTH):
                    if i != w:
                        h = _mix(h * _M1 + (sig[:, :, i] + _U(1)) * _M2)
                keys[:, :, w] = h
            per = chunks * WIDTH
            rep, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 500].ravel().view(np.int64)), pa.array(np.repeat(rep[i : i + 500], per)), pa.array(np.repeat(n[i : i + 500], per))], ["key", "rep", "n"])

    return nodes.select("rep", "n", "sig").mapInArrow(run, "key long, rep long, n long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have a Jaccard similarity of at least percent / 100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    one = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, part: DataFrame) -> DataFrame:
    """members with their component, of the keys whose members lie in more than one."""
    m = members.select("key", "rep", "n").join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    keys = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return m.join(keys, "key", "left_semi")


_BLOCK = ["block", "reps", "families", "parts", "sigs", "sizes", "sets"]


def _placed(nodes: DataFrame) -> DataFrame:
    """(rep, family, component, block): nodes (rep, family, component, n) dealt to blocks of BLOCK_BYTES in order of family.

    Sorted by ranges; only the sizes of the ranges meet.
    """
    spark = nodes.sparkSession
    d = nodes.repartitionByRange(parts(spark), "family", "rep").sortWithinPartitions("family", "rep")
    d = materialize(d.select("rep", "family", "component", (8 * F.col("n") + NODE_BYTES).alias("w"), F.spark_partition_id().alias("p")))
    before, total = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in sorted(d.groupBy("p").agg(F.sum("w").alias("w")).collect(), key=lambda r: r["p"]):
        before += [F.lit(r["p"]), F.lit(total).cast("long")]
        total += r["w"]
    upto = F.sum("w").over(Window.partitionBy("p").orderBy("family", "rep")) + F.create_map(*before)[F.col("p")]
    out = materialize(d.select("rep", "family", "component", F.floor((upto - 1) / BLOCK_BYTES).alias("block")))
    discard(d)
    return out


def _packed(nodes: DataFrame) -> DataFrame:
    """One row of packed columns for each block of nodes (block, family, rep, component, sig, set)."""

    def run(t: pa.Table) -> pa.Table:
        ids = [t.column(c).to_numpy().tobytes() for c in ("rep", "family", "component")]
        sets = t.column("set").to_pylist()
        sizes = np.array([len(x) // 8 for x in sets], np.int64).tobytes()
        columns = [*ids, b"".join(t.column("sig").to_pylist()), sizes, b"".join(sets)]
        return pa.table({"block": t.column("block").slice(0, 1), **{c: pa.array([x], pa.binary()) for c, x in zip(_BLOCK[1:], columns, strict=True)}})

    return nodes.groupBy("block").applyInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in _BLOCK[1:]))


class _Block:
    def __init__(self, reps: bytes, families: bytes, parts: bytes, sigs: bytes, sizes: bytes, sets: bytes):
        self.reps, self.families, self.parts, self.sizes = (np.frombuffer(x, np.int64) for x in (reps, families, parts, sizes))
        self.sigs = np.frombuffer(sigs, np.uint16).reshape(len(self.reps), -1, WIDTH)
        self.values = np.frombuffer(sets, _U)
        self.start = np.cumsum(self.sizes) - self.sizes


def _links_between(x: _Block, y: _Block, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links of nodes of x to nodes of y in other components: as many as join these, so fewer than there are nodes.

    A node's set is marked in the table of y's elements, and all sets of y read their intersections off it.
    """
    known = np.unique(y.values)
    at = np.searchsorted(known, y.values)
    marks = np.zeros(len(known), np.int32)
    px, py, links = x.parts.copy(), y.parts.copy(), []
    for i in range(len(x.reps)):
        n = x.sizes[i]
        open_ = (y.families == x.families[i]) & (py != px[i]) & (100 * np.minimum(y.sizes, n) >= percent * np.maximum(y.sizes, n))
        if same:
            open_[: i + 1] = False
        js = np.flatnonzero(open_)
        if not len(js):
            continue
        mine = x.values[x.start[i] : x.start[i] + n]
        k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        k = k[known[k] == mine]
        marks[k] = 1
        if 4 * len(js) > len(y.reps):
            both = np.add.reduceat(marks[at], y.start)[js]
        else:
            both = np.array([marks[at[y.start[j] : y.start[j] + y.sizes[j]]].sum() for j in js])
        marks[k] = 0
        for j in js[100 * both >= percent * (n + y.sizes[js] - both)]:
            if px[i] != py[j] and ((x.sigs[i] != y.sigs[j]).sum(axis=1) <= ERRORS).any():
                links.append((int(x.reps[i]), int(y.reps[j])))
                old, new = py[j], px[i]
                px[px == old], py[py == old] = new, new
    return links


def _remaining_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links across components among members (key, rep, component) that share a key.

    Nodes stand in blocks, by families: what keys hold together. Blocks that share a key are tested in place, each pair
    of blocks by itself, and only links come back, fewer than nodes for each pair of blocks: rows follow the links found,
    not the pairs refuted. A family larger than a block is cut, so no task holds it whole.
    """
    least = members.groupBy("key").agg(F.min("rep").alias("b"))
    family = components(members.join(least, "key").select(F.col("rep").alias("a"), "b").distinct(), loops=True)
    who = members.groupBy("rep").agg(F.first("component").alias("component"), F.first("n").alias("n"))
    who = _placed(who.join(family.select(F.col("id").alias("rep"), F.col("component").alias("family")), "rep"))
    packed = materialize(_packed(who.join(nodes.select("rep", "sig"), "rep").join(sets, "rep")))
    together = members.select("key", "rep").join(who.select("rep", "block"), "rep").groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("s")).select("s").distinct()
    pairs = together.select("s", F.explode("s").alias("i")).select("i", F.explode(F.filter("s", lambda j: j >= F.col("i"))).alias("j")).distinct()
    columns = _BLOCK[1:]
    x = packed.select(F.col("block").alias("i"), *(F.col(c).alias(f"x_{c}") for c in columns))
    y = packed.select(F.col("block").alias("j"), *(F.col(c).alias(f"y_{c}") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                found = _links_between(_Block(*row[2:8]), _Block(*row[8:]), row[0] == row[1], percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], pa.int64()) for s in (0, 1)], ["a", "b"])

    return pairs.join(x, "i").join(y, "j").select("i", "j", *x.columns[1:], *y.columns[1:]).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", chunks: int = CHUNKS, seed: int = SEED) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row for each row of docs.

    Documents whose sets of distinct k-word shingles (A-Z lower-cased, words cut at ASCII white space) have a Jaccard
    similarity of at least percent / 100 are linked; component_id is the smallest key reachable, kept says it is the
    document's own. Equal sets are one node from the start, so exact copies cost nothing further. Nodes that agree on
    all but one component of some chunk of their signatures are candidates. Inside a group of candidates a pivot is tried
    against all others first, a star instead of all pairs; nodes that are then in different components are tried against
    each other in blocks (_remaining_links), so no link between components is lost. Every link is confirmed on the full
    sets, computed again for candidates only. Null texts and texts without words link with nothing. Rows that repeat a key share
    its component. Null keys link with nothing: component null, kept true. An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    spark = docs.sparkSession
    sig = materialize(signatures(docs, k, key, text, chunks, seed))
    wide = 2 * parts(spark)
    nodes = materialize(sig.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    keys = _keys(nodes, chunks)
    # Groups of one are nearly all; the first pass leaves only keys with company.
    shared = materialize(keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key"))
    members = materialize(keys.join(shared, "key"))
    sets = materialize(_sets_of(docs, members, k, key, text))
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    # One pivot a key, the same for many keys of a group of copies.
    order = F.struct(F.xxhash64("rep", F.pmod("key", F.lit(PIVOTS))).alias("o"), "rep", "n")
    pivot = members.groupBy("key").agg(F.min(order).alias("p"))
    stars = members.join(pivot, "key").where((F.col("rep") != F.col("p.rep")) & near(F.col("n"), F.col("p.n")))
    stars = stars.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()
    linked = materialize(_confirm(stars.repartition(wide, "a"), sets, percent))
    rest = materialize(_apart(members, materialize(components(linked))))
    final = materialize(components(linked.union(_remaining_links(rest, nodes, sets, percent))))
    discard(members, sets, rest)
    named = nodes.select("d1", "d2", "rep").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = sig.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    # A key that several texts share lies in one component: the least.
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _sets_of(docs: DataFrame, nodes: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(rep, set): the full sets of the nodes, from the documents they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            got = [shingle_set(t, k, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["rep", "set"])

    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("binary").alias("t")).where("t IS NOT NULL")
    return texts.join(sized(materialize(nodes.select("rep").distinct())), "rep", "left_semi").distinct().mapInArrow(run, "rep long, set binary")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS r FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
least_id AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r, w.doc_id) AS component_id, coalesce(r, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON least_id.id = w.doc_id"""
