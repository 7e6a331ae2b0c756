"""What the operators write and hold, on tables made for it."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import bpe, common, lines, lm, suffix


def _shuffled(spark) -> int:
    """Bytes that all stages so far wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, getattr(sc.statusStore(), "stageList$default$4")(), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_large_word_table_sends_rare_words_only(spark):
    r = random.Random(5)
    common = [f"w{i}" for i in range(300)]
    texts = {i: " ".join([*r.choices(common, k=2000), f"rare{i}x", "rare7x", f"Ünï{i}", f"rare{i}x"]) for i in range(400)} | {400: None, 401: "", 402: "only402 only402"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items() for _ in range(1 + (i == 7))], "doc_id long, text string").repartition(4)
    docs = docs.persist()
    docs.count()
    t = bpe.tokenizer(bpe.vocabulary_path())
    before = _shuffled(spark)
    got = bpe.encode(docs, packed_bytes=9000).collect()
    sent = _shuffled(spark) - before
    docs.unpersist()
    assert len(got) == 404
    assert all(x["ids"] == t.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids for x in got)
    # One row for each of 800,000 positions took 5 MB; the rare words take far less.
    assert sent < 1_000_000
    words = bpe.word_table(docs, bpe.vocabulary_path())
    spread, n, ids = bpe._spread(words, 9000)
    assert n >= 300 and bpe.WORD_BYTES * n + 2 * ids <= 9000 and spread > 1 and bpe._rare(words, spread).count() + n == words.agg(F.sum("n_words")).first()[0]


def test_suffix_passes_hold_little_at_a_time(spark, monkeypatch):
    r = random.Random(6)
    passages = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=900)) for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(r.sample(passages, 4)) + str(i)) for i in range(300)], "doc_id long, text string")
    size, held, most, packed = {}, [_shuffled(spark)], [0], []

    def kept(df):
        out = common.materialize(df)
        path = Path(out.kept_at.removeprefix("file://"))
        size[out.kept_at] = sum(p.stat().st_size for p in path.glob("*.parquet"))
        now = _shuffled(spark)
        most[0] = max(most[0], sum(size.values()) + now - held[0])
        held[0] = now
        if "phases" in out.columns:
            packed.append(size[out.kept_at])
        return out

    def gone(*tables):
        for df in tables:
            size.pop(getattr(df, "kept_at", None), None)
        common.discard(*tables)

    monkeypatch.setattr(suffix, "materialize", kept)
    monkeypatch.setattr(suffix, "discard", gone)
    monkeypatch.setattr(suffix, "CHUNK", 1 << 17)
    monkeypatch.setattr(suffix, "BUCKET_KEYS", 100_000)
    out = suffix.remove_repeats(docs).collect()
    seen, texts = {}, {x["doc_id"]: x["text"].encode() for x in docs.collect()}
    for i in sorted(texts):
        for a in range(len(texts[i]) - 49):
            seen.setdefault(texts[i][a : a + 50], i)
    for x in out:
        t, cut = texts[x["doc_id"]], set()
        for a in range(len(t) - 49):
            if seen[t[a : a + 50]] < x["doc_id"]:
                cut.update(range(a, a + 50))
        assert cut == {b for a, z in zip(x["spans"][::2], x["spans"][1::2], strict=True) for b in range(a, z)}
    # Replies that were dealt out again in each pass, and all suffixes at once, took 15.8 MB.
    assert packed and most[0] < 12_500_000


def test_suffix_passes_name_a_chunk_once(spark, monkeypatch):
    """The replies of the first sort end with the pass that names a chunk; passes after it read the numbers it left."""
    r = random.Random(8)
    passages = ["".join(r.choices("abcdefgh  ", k=200)) for _ in range(8)]
    docs = spark.createDataFrame([(i, " ".join(r.sample(passages, 3)) + str(i)) for i in range(24)], "doc_id long, text string")
    beside = []

    def kept(df):
        out = common.materialize(df)
        beside.extend([set(out.columns)] if "r2" in out.columns else [])
        return out

    monkeypatch.setattr(suffix, "materialize", kept)
    assert any(x["spans"] for x in suffix.remove_repeats(docs).collect())
    assert beside and all("r1" not in x and "no" in x for x in beside)


def test_anchors_of_many_pieces_are_those_of_each():
    r = random.Random(9)
    pieces = ["".join(r.choices("ab ", k=k)).encode() for k in (0, 49, 50, 51, 7, 300, 49, 2000, 50, 3)] + [b"x" * 120, b"x" * 120]
    lens, want, at = np.array([len(x) for x in pieces]), [], 0
    for x in pieces:
        places, hashes = suffix._anchors(x, np.array([len(x)]))
        want += zip((places + at).tolist(), hashes.tolist(), strict=True)
        at += len(x)
    places, hashes = suffix._anchors(b"".join(pieces), lens)
    assert list(zip(places.tolist(), hashes.tolist(), strict=True)) == want and len(want) > 100
    shared, ends = np.unique(hashes & ~np.uint64(1)), np.cumsum(lens)
    # Every window holds an anchor, so with all of them shared a piece is one stretch, unless it is too short.
    assert [(k, i, j) for k, i, j, _, _ in suffix._stretches(b"".join(pieces), lens, shared)] == [(k, e - n, e) for k, (e, n) in enumerate(zip(ends.tolist(), lens.tolist(), strict=True)) if n >= 50]


def test_order_is_lexicographic():
    r = np.random.default_rng(0)
    for n, most in ((0, 2), (1, 2), (2, 1), (500, 1), (500, 3), (500, 2**63)):
        c = [r.integers(0, most, n).astype(np.uint64) for _ in range(3)]
        got, want = suffix._order(*c), np.lexsort(c[::-1])
        assert sorted(got.tolist()) == list(range(n)) and all(np.array_equal(x[got], x[want]) for x in c)


def test_lines_that_differ_in_white_space_are_one(spark):
    """Such lines have the same tokens, so they are equal before the join, and no line is searched for white space."""
    rows = [(1, "one two three\none\ttwo\x0bthree\n\t \x0b\n\x0c\r\n x"), (2, "one two\rthree\nOne Two Three four five six"), (3, "one\ttwo three four five six\n\xa0\n"), (4, None), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines._lines(d, "doc_id", "text").where("line like 'one two three'").select("h1", "h2").distinct().count() == 1
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(d).collect()}
    assert got == {1: ("one two three\n\t \x0b\n\x0c\r\n x", 3, 1), 2: ("One Two Three four five six", 2, 1), 3: ("\xa0\n", 2, 1), 4: (None, 0, 0), 5: ("", 0, 0)}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With 64 bits that are the same for two words and a stranger, the other 32 decide."""
    real = bpe._hashes
    monkeypatch.setattr(bpe, "_hashes", lambda words: (np.where([w.startswith(b"same") for w in words], np.uint64(7), real(words)[0]), real(words)[1]))
    words = [b"same1", b"same2", b"other"]
    h, check = bpe._hashes(words)
    order = np.argsort(h, kind="stable")
    packed = bpe._Packed(h[order], check[order], np.arange(3, dtype=np.uint32)[order], np.ones(3, np.uint32), np.array([10, 11, 12], np.uint16))
    at = packed.places([b"same2", b"same3", b"other", b"same1", b"absent"])
    assert [int(packed.ids[packed.start[i]]) if i >= 0 else None for i in at] == [11, None, 12, 10, None]


def test_lm_texts_reach_a_worker_in_small_batches(spark):
    """Batches of 64 MB, held several times over by the JVM and the worker, took an executor beyond its memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 64 << 20)
    try:
        d = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" word ")), 1000).alias("text"))
        out = lm.score(d)
        sizes = d.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg(F.sum("n"), F.max("n")).first()
        assert out.where("n_tokens = 2001").count() == 2000
        assert sizes[0] > 20_000_000 and sizes[1] < 6_000_000
    finally:
        spark.conf.set(name, before)


def test_suffix_rows_to_buckets_share_batches_and_large_inputs_have_fewer(spark, monkeypatch):
    """A chunk's rows to its sorting tasks go many to a batch; beyond LARGE, chunks and tasks take twice as much."""
    bucket = np.repeat(np.arange(200), 5)
    columns = [np.arange(1000, dtype=np.uint64) * np.uint64(1 << 40), np.arange(1000, dtype=np.uint64)]
    batches = list(suffix._sent(bucket, columns, chunk=3))
    assert len(batches) == 1 and batches[0].num_rows == 200 and set(batches[0].column("chunk").to_pylist()) == {3}
    back = [suffix._unpack(x, 2) for x in batches[0].column("c").to_pylist()]
    assert all(np.array_equal(np.concatenate([b[i] for b in back]), c) for i, c in enumerate(columns))
    mixed = bucket[np.random.default_rng(1).permutation(1000)]
    assert all(np.array_equal(np.arange(1000)[part], np.flatnonzero(mixed == b)) for b, part in suffix._slices(mixed)) and not list(suffix._slices(bucket[:0]))

    r = random.Random(7)
    passages = ["".join(r.choices("abcdefgh  ", k=300)) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r.sample(passages, 3)) + str(i)) for i in range(120)], "doc_id long, text string")
    monkeypatch.setattr(suffix, "CHUNK", 1 << 14)
    monkeypatch.setattr(suffix, "BUCKET_KEYS", 10_000)
    sent, real = [], suffix.repeated_places

    def places(chunks, n_bytes):
        sent.append(chunks.count() * -(-n_bytes // (suffix.BUCKET_KEYS * suffix._share(n_bytes))))
        return real(chunks, n_bytes)

    monkeypatch.setattr(suffix, "repeated_places", places)
    plain = sorted(map(tuple, suffix.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix, "LARGE", 0)
    assert sorted(map(tuple, suffix.remove_repeats(docs).collect())) == plain and any(x[2] for x in plain)
    assert sent[1] < 0.5 * sent[0]


def test_lines_that_share_one_passage_are_screened_out(spark, monkeypatch):
    rows = []
    for i in range(40):
        for j in range(2):
            words = [f"w{i}x{j}x{n}" for n in range(60)]
            words[20:25] = [f"p{i}x{n}" for n in range(5)]  # one of 56 shingles
            rows.append((2 * i + j, " ".join(words)))
    seen, near = [], lines._near
    monkeypatch.setattr(lines, "_near", lambda kept, percent: seen.append(kept.count()) or near(kept, percent))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == [0] and not any(r["n_removed"] for r in got)


def test_the_screen_of_lines_loses_none(spark):
    r = random.Random(11)
    texts, few = [], [f"v{i}" for i in range(9)]
    for i in range(60):
        n = r.choice([3, 5, 9, 12, 15, 19, 20, 24, 40, 90])
        words = [r.choice(few) if i % 3 == 0 else f"W{r.randrange(10**6)}é" for _ in range(n)]  # some repeat their shingles
        texts.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            for _ in range(r.randrange(1, 2 + n // 20)):
                other[r.choice([0, n - 1, r.randrange(n)])] = f"new{r.randrange(10**6)}"
            cut = r.randrange(1 + n // 5)
            texts.append(" ".join(other[cut:]).upper())
    r.shuffle(texts)
    seen, want = [], {}
    for i, text in enumerate(texts):
        w = text.lower().split()
        s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        want[i] = int(any(len(s & t) * 100 >= 80 * len(s | t) for t in seen))
        seen.append(s)
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x["doc_id"]: x["n_removed"] for x in got.collect()} == want and 30 < sum(want.values()) < 270
