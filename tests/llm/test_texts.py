import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import bpe, chat, lines, lm, minhash, mixing, quality, suffix, token_counts
from tessera.llm.common import components


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_equals_the_library(docs, nothing):
    path = bpe.vocabulary_path()
    t = bpe.tokenizer(path)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ((r["doc_id"], r["text"]) for r in docs.collect()))
    for limit in (1 << 30, 0):  # packed, and by a join
        got = bpe.encode(docs.withColumn("ids", F.lit("clash")), path, packed_bytes=limit)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == want
    said = bpe.decode(bpe.encode(docs)).collect()
    assert all(r["decoded"] == t.decode(r["ids"], skip_special_tokens=False) for r in said)
    assert bpe.encode(nothing).count() == 0


def test_length_histogram(docs, nothing):
    n = [r["n_tokens"] for r in token_counts.encoded_lengths(docs).collect()]
    h = token_counts.length_histogram(token_counts.encoded_lengths(docs))
    for r in h.collect():
        x = r["n_tokens"]
        assert r["n_docs"] == n.count(x) and r["docs_at_least"] == sum(i >= x for i in n) and r["tokens_at_least"] == sum(i for i in n if i >= x)
        assert r["truncated_total"] == sum(min(i, x) for i in n) and r["docs_at_most"] == sum(i <= x for i in n)
    got = {r["context"]: (r["docs_over"], r["truncated_total"]) for r in token_counts.totals_at(h, [5, 10**6]).collect()}
    assert got == {5: (sum(i > 5 for i in n), sum(min(i, 5) for i in n)), 10**6: (0, sum(n))}
    assert token_counts.quantiles(h, [1.0]).first()["n_tokens"] == max(n)
    assert token_counts.length_histogram(token_counts.encoded_lengths(nothing)).count() == 0


def test_chat_reads_back_what_it_formatted(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n<\\|x"), (1, 1, "assistant", "<|im_start|>"), (1, 2, "user", None), (2, None, None, "a"), (2, 1, "as\nsistant", "b"), (None, 1, "assistant", ""), (3, 1, "assistant", "p"), (3, 1, "assistant", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    out = chat.prefix_targets(turns)
    loss = sorted((str(r["conv_id"]), r["example"], r["x"]) for r in out.select("conv_id", "example", chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("x")).collect())
    assert loss == [("1", 1, "<|im_start|>"), ("1", 2, ""), ("2", 1, ""), ("3", 1, "p"), ("3", 2, "q"), ("None", 1, "")]
    whole = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.where("whole").select("conv_id", chat.read_turns(F.col("text")).alias("t")).collect()}
    assert whole[1] == [("user", rows[0][3]), ("assistant", "<|im_start|>"), ("user", "")] and whole[2] == [("", "a"), ("as\nsistant", "b")]
    assert chat.prefix_targets(turns.limit(0)).count() == 0


def test_quality_measures(docs, nothing):
    led = quality.apply_policy(quality.ledger(docs.withColumn("n_words", F.lit("clash"))))
    for r in led.where("doc_id IS NOT NULL").collect():
        w = (r["text"] or "").encode().split()
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(cover), sum(len(x.decode()) for x in w))
    kept = {r["doc_id"]: r["kept"] for r in led.collect()}
    assert kept[1] and not kept[4] and not kept[5] and not kept[9]
    alone = {r["rule"]: r["n_alone"] for r in quality.ablation(led).collect()}
    assert alone["repeated_words"] == 1
    assert quality.ledger(nothing).count() == 0 and led.where("kept").count() == sum(r["kept"] for r in led.collect())


def brute_lines(rows, percent=80, k=5):
    seen, gone = [], Counter()
    for i, text in sorted(rows):
        for line in text.split("\n"):
            w = [x for x in line.lower().split()]
            if w:
                s = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
                gone[i] += any(len(s & t) * 100 >= percent * len(s | t) for t in seen)
                seen.append(s)
    return gone


def test_line_dedup_against_brute_force(spark, docs, nothing):
    base = [f"the quick fox number {i} jumps over the lazy dog near a river bank today with {i * i} friends" for i in range(12)]
    rows = [(i, "\n".join([base[i % 12], base[(i * 5) % 12] + " indeed", "short", "", f"only here {i}"])) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for small in (10**6, 0):
        got = by_id(lines.dedup_lines(d, small_rows=small))
        assert {i: r["n_removed"] for i, r in got.items()} == {i: want[i] for i, _ in rows}
    out = lines.dedup_lines(docs).collect()
    assert len(out) == docs.count() and all(r["text"] is None for r in out if r["doc_id"] == 5)
    assert lines.dedup_lines(nothing).count() == 0


def test_near_duplicates(spark, docs, nothing):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1] and got[4]["n_shingles"] == 0 and got[5]["kept"] and got[6]["kept"] and got[None]["kept"]
    assert minhash.near_duplicates(docs, 3, 85).count() == docs.count() and minhash.near_duplicates(nothing).count() == 0


def test_components_both_ways(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i % 7] + [(40, 41), (41, 40), (5, 5)], "a long, b long")
    one, two = (sorted((r["id"], r["component"]) for r in components(e, small_edges=s).collect()) for s in (10**6, 0))
    assert one == two and dict(one)[6] == 1 and dict(one)[41] == 40


def test_suffix_dedup_against_brute_force(spark, nothing):
    p = "a passage that several documents share, longer than fifty bytes, with ümlauts"
    rows = [(1, f"first {p} end"), (2, f"{p}"), (3, f"zz {p} yy {p} xx"), (4, f"first {p} end"), (5, None), (6, ""), (7, "x" * 60), (8, "x" * 200), (9, "short"), (10, "short")]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for q in range(len(b) - 49):
            first.setdefault(b[q : q + 50], i)
    got = by_id(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for q in range(len(b) - 49):
            if first[b[q : q + 50]] < i:
                gone |= set(range(q, q + 50))
        s = got[i]["spans"]
        assert {x for a, z in zip(s[::2], s[1::2], strict=True) for x in range(a, z)} == gone
    assert suffix.remove_repeats(nothing).count() == 0


def test_lm_scores(docs, nothing):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    c = Counter(w for i, t in rows if not lm.held_out(i) for w in lm.tokens(t))
    n, v = sum(c.values()), len(c)
    for limit in (1 << 30, 0):
        for r in lm.score(docs, word_bytes=limit).collect():
            w = next(lm.tokens(t) for i, t in rows if i == r["doc_id"])
            assert r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(x in c for x in w)
            assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r["score"] <= 1e-9
    assert lm.score(nothing).count() == 0


def test_lm_filter_grows_with_insertions_and_scores_alike_by_a_shuffle(spark, docs, nothing, monkeypatch):
    """Thousands of pairs that only held-out documents have: a capped filter says that it knows them."""
    monkeypatch.setattr(lm, "GROUP_BYTES", 1 << 12)
    train = [i for i in range(400) if not lm.held_out(i)]
    rows = [(i, " ".join(f"w{(i * 89 + j * 37) % 997} v{(i + j) % 61}" for j in range(120))) for i in train]
    rows += [(i, " ".join(f"w{j * 7 % 997} w{j * 11 % 997}" for j in range(500))) for i in range(400) if lm.held_out(i)]
    rows += [(None, "no key"), (500, None), (501, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seen = Counter(p for i, t in rows if not lm.held_out(i) for w in [lm.tokens((t or "").encode())] for p in zip(w, w[1:]))
    n = sum(len((t or "").split()) + 1 for i, t in rows if not lm.held_out(i))
    data, segments, _ = lm.build_filter(d.select(F.col("doc_id").alias("k"), F.col("text").cast("binary").alias("t")), n, 1 << 12)
    assert data.agg(F.sum("bits")).first()[0] >= lm.BITS * sum(c.bit_length() for c in seen.values()) > 1 << 12 and data.count() == segments
    for table, limit in ((d, 1 << 30), (docs, 0)):
        small, large = (sorted((tuple(map(str, r)) for r in lm.score(table, word_bytes=limit, most_bits=m).collect())) for m in (1 << 7, 1 << 31))
        assert small == large and len(large) == table.count()
    assert lm.score(nothing, most_bits=0).count() == 0


def test_poisson_mix(docs, nothing):
    first, cdf = mixing.poisson_cdf(2.0)
    assert first == 0 and abs(cdf[0] - math.exp(-2)) < 1e-12 and cdf[-1] > 1 - 1e-12
    a = sorted((str(r["doc_id"]), r["copy"], r["shuffle_key"]) for r in mixing.mix(docs.withColumn("copy", F.lit("clash"))).collect())
    assert a == sorted((str(r["doc_id"]), r["copy"], r["shuffle_key"]) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(nothing).count() == 0


def test_digest(docs):
    r = by_id(bpe.ids_digest(bpe.encode(docs)))
    assert r[4]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and r[4]["n_tokens"] == 0
