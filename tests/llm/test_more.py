"""Plain versions of what no SQL expresses, clashing names, and cases that the smaller tests miss."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, common, lines, lm, minhash, mixing, quality, suffix, token_counts

CLASHES = ["__w", "__words", "__l", "__doc", "__row", "__cuts", "__cdf", "__first", "__u", "__n", "__b", "__rest", "__bucket", "__key", "row", "first", "start", "words", "measured", "kept", "failed", "at"]


def clashing(docs):
    return docs.select("*", *(F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES))


def own(rows, replaced=()):
    """Every clashing column still says what the caller put there."""
    for r in rows:
        i = "none" if r["doc_id"] is None else r["doc_id"]
        assert all(r[c] == f"own {c} {i}" for c in CLASHES if c not in replaced), r


def test_names_of_the_caller_survive(spark, docs):
    d = clashing(docs)
    own(quality.measured(d).collect())
    own(quality.apply_policy(quality.ledger(d)).collect(), ("failed", "kept"))
    own(lines.dedup_lines(d).collect())
    own(mixing.mix(d).collect())
    for limit in (1 << 30, 0):
        own(bpe.decode(bpe.encode(d, packed_bytes=limit)).collect())
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "")
        assert out.columns[: len(d.columns)] == d.columns
        own(out.collect())
    assert token_counts.encoded_lengths(d).count() == docs.count() and minhash.near_duplicates(d).count() == docs.count()
    assert suffix.remove_repeats(d).count() == docs.count() and lm.score(d).count() == docs.count()


def test_token_counts_follow_the_library(docs):
    import public_tokenizers

    enc = token_counts._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = Counter(len(enc.encode_ordinary(r["text"] or "")) for r in docs.collect())
    got = {r["n_tokens"]: r["n_docs"] for r in token_counts.length_histogram(token_counts.encoded_lengths(docs)).collect()}
    assert got == dict(want)


def test_bpe_digests(docs):
    t = bpe.tokenizer(bpe.vocabulary_path())
    done = bpe.ids_digest(bpe.decode(bpe.encode(docs)).withColumn("decoded", F.sha2("decoded", 256)))
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded"]) for r in done.collect()) == want


@pytest.mark.parametrize("segment_tokens", [2_000_000, 300])
def test_lm_scores_against_exact_quantised_counts(spark, monkeypatch, segment_tokens):
    """Never below the model with exact counts, and above it only by false positives: few at 8 bits an insertion."""
    monkeypatch.setattr(lm, "SEGMENT_TOKENS", segment_tokens)
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(60))) for i in range(120)] + [(500, None), (501, ""), (None, "no key")]
    train = [lm.tokens((t or "").encode()) for i, t in rows if not lm.held_out(i)]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(c.values()), len(c)

    def exact(text):
        total, t = 0.0, lm.tokens((text or "").encode())
        for k, w in enumerate(t):
            p1 = (c[w] + 1) / (n + v + 1)
            if k and c[t[k - 1]]:
                both = pairs[t[k - 1], w]
                q = min(2 ** int(math.log2(both)) if both else 0, c[t[k - 1]])
                p1 = 0.6 * q / c[t[k - 1]] + 0.4 * p1
            total += math.log10(p1)
        return total

    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lm.score(d).collect()}
    over = [(got[i][0] - exact(t), got[i][1]) for i, t in rows]
    assert all(x > -1e-9 for x, _ in over)
    assert sum(x for x, _ in over) / sum(k for _, k in over) < 0.12


def test_suffix_dedup_of_repeated_ids_nulls_long_texts_and_a_passage_in_many(spark, monkeypatch):
    p = "a passage that very many documents share, longer than fifty bytes by some words"
    long_text = " ".join(f"{(i * 7919) % 10007}x" for i in range(6000))
    rows = [(1, "aa " + p), (2, "bb " + p + " one"), (2, "cc " + p + " two and " + p), (None, p), (3, None), (4, long_text), (5, "y" + long_text[1000:20000] + "z" + p), (2, "bb " + p + " one")]
    rows += [(100 + i, f"{i} " + p + f" {i * i}") for i in range(300)]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for q in range(len(b) - 49 if i is not None else 0):
            first[b[q : q + 50]] = min(first.get(b[q : q + 50], i), i)

    def removed(i, t):
        b, gone = (t or "").encode(), set()
        for q in range(len(b) - 49 if i is not None else 0):
            if first[b[q : q + 50]] < i:
                gone |= set(range(q, q + 50))
        return frozenset(gone)

    want = Counter((i, (t or "").encode(), removed(i, t)) for i, t in rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (False, True):
        if small:
            for name, n in (("PIECE", 3000), ("TEXT_CHUNK", 9000), ("CHUNK", 5000), ("BUCKET_KEYS", 2000)):
                monkeypatch.setattr(suffix, name, n)
        got = Counter((r["doc_id"], bytes(r["data"]), frozenset(x for a, z in zip(r["spans"][::2], r["spans"][1::2], strict=True) for x in range(a, z))) for r in suffix.remove_repeats(d).collect())
        assert got == want


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    """A large group around one text, whose members are often too far from the pivot and from each other, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 60_000)
    words = [f"base{i}" for i in range(60)]
    rows = []
    for i in range(160):
        w = list(words)
        for k in range(i % 5):
            w[(i * 7 + k * 13) % 60] = f"edit{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(900 + i, " ".join(f"far{i}_{j}" for j in range(30))) for i in range(20)] + [(990, None), (991, "one"), (992, "one"), (990, "one")]
    sets = {(i, t): {tuple(w[j : j + 3]) for j in range(max(len(w) - 2, min(len(w), 1)))} for i, t in rows for w in [(t or "").split()]}
    nodes, up = list(sets), {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a in range(len(nodes)):
        for b in range(a):
            x, y = sets[nodes[a]], sets[nodes[b]]
            if nodes[a][0] == nodes[b][0] or (x and y and 100 * len(x & y) >= 85 * len(x | y)):
                u, v = root(nodes[a][0]), root(nodes[b][0])
                up[max(u, v)] = min(u, v)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).where("doc_id <> 990").collect()}
    assert got == {i: root(i) for i, _ in rows if i != 990}


def test_components_of_a_long_chain_and_of_loops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 900)], "a long, b long")
    for small in (10**6, 0):
        got = {r["id"]: r["component"] for r in common.components(e, small, loops=True).collect()}
        assert got == {i: 0 for i in range(301)} | {900: 900}
        assert common.components(e, small).count() == 301


def test_long_lines_go_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines, "LONG", 20)
    base = [f"word{i}" for i in range(80)]
    near = [*base[:40], "changed", *base[41:]]
    rows = [(1, " ".join(base)), (2, "first\n" + " ".join(near)), (3, " ".join(base[:30])), (4, " ".join([*base[:12], "x", *base[13:30]])), (5, " ".join(f"other{i}" for i in range(50)))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    s = {i: shingles(t.split("\n")[-1].split()) for i, t in rows}
    assert got == {i: int(any(alike(s[i], s[j]) for j in s if j < i)) for i in s} and got[2] == 1


def test_a_tiny_source_is_made_by_several_tasks(spark):
    rows = [(i, "x" * 1000, "src1") for i in range(40)] + [(99, "y", "src2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(d, {"src1": 1.0, "src2": 1.0})
    n = m.where("doc_id = 99").agg(F.count("*"), F.min("copy"), F.max("copy"), F.count_distinct("copy")).first()
    assert n[0] > 3 * mixing.SPLIT and (n[1], n[2], n[3]) == (1, n[0], n[0])


def plain_pipeline(rows):
    """The five stages over (doc_id, text, source, n_chars), without Spark."""
    kept = []
    for i, t, source, _ in rows:
        w = (t or "").split()
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeated = len({j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)})
        ls = [x for x in (t or "").split("\n") if x.strip()]
        chars, dup = sum(map(len, w)), len(ls) - len(set(ls))
        bad = len(w) < 10 or 100 * repeated > 20 * len(w) or 100 * sum(x in "#*$%&|<>" for x in t or "") > 8 * chars or (len(ls) >= 4 and 100 * dup > 30 * len(ls))
        if not bad and 10 * chars >= 15 * len(w) and chars <= 25 * len(w) and 100 * sum(x in "!?" for x in t) <= 40 * len(w):
            kept.append((i, t, source))
    seen, cut = [], []
    for i, t, source in sorted(kept):
        left = []
        for line in t.split("\n"):
            w = line.lower().split()
            s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else None
            if s is None or not any(len(s & o) * 100 >= 80 * len(s | o) for o in seen):
                left.append(line)
            if s:
                seen.append(s)
        cut.append((i, "\n".join(left), source))
    sets, up = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, min(len(w), 1)))} for i, t, _ in cut for w in [t.lower().split()]}, {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = root(a), root(b)
                up[max(u, v)] = min(u, v)
    one = [r for r in cut if root(r[0]) == r[0]]
    have = Counter()
    for _, t, source in one:
        have[source if source in mixing.WEIGHTS else None] += len(t)
    asked = {b: mixing.OTHER if b is None else mixing.WEIGHTS[b] for b, n in have.items() if n}
    out, t = Counter(), bpe.tokenizer(bpe.vocabulary_path())
    for i, text, source in one:
        b = source if source in mixing.WEIGHTS else None
        first, cdf = mixing.poisson_cdf(asked[b] / sum(asked.values()) * sum(have.values()) / have[b] if have[b] else 0.0)
        u = int(hashlib.md5(f"{i}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / (1 << 52)
        n = first + sum(c <= u for c in cdf)
        ids = t.encode(text, add_special_tokens=False).ids
        if n:
            out[i, text, source, len(text), tuple(ids), t.decode(ids, skip_special_tokens=False)] += n
    return out


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    def text(i):
        base = [f"w{(i * 17 + j * 5) % 83}x{(i + j) % 29}" for j in range(30)]
        line = " ".join(base)
        return "\n".join([line, "a line that all of the documents share with one another, word for word", f"{line[::-1]} tail {i}", f"only {i} has this line of some words here"])

    rows = [(i, text(i), f"src{i % 4}" if i % 9 else None, 0) for i in range(40)]
    rows += [(100, text(3), "src1", 0), (101, text(4).replace("only", "just"), "src2", 0), (102, "too short", "src1", 0), (103, None, "src1", 0), (104, "same five words here again " * 20, "src2", 0), (105, "### $$$ " * 20 + text(50), "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["text"], r["source"], r["n_chars"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_pipeline(rows)
