"""The intent stage and the holdout build against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import intent, split

EVENTS = [
    ("red car", "new cars", "auto", 1), ("red car", "new cars", "auto", 1), ("red car", None, "toys", 1), ("blue boat", "old", "boats", 1), ("blue boat", "", "boats", 1), ("wooden toy car", "new toys", "toys", 1),
    ("a b", "old", "auto", 1), ("green boat", "old boats", "boats", 0), ("wooden horse", "new", "toys", 0), ("zebra", None, "toys", 0),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "text string, filters string, class string, fit int")


def words(t):
    w = [x for x in t.split() if len(x) > 1]
    return Counter([f"w:{x}" for x in w] + [f"b:{a}_{b}" for a, b in zip(w, w[1:], strict=False)])


def grams(t):
    out = Counter()
    for x in t.split():
        x = f" {x} "
        for n in (3, 4, 5):
            out.update([x[i : i + n] for i in range(max(1, len(x) - n + 1))] if n == 3 or len(x) > n - 1 else [])
    return out


class Plain:
    def __init__(self, fit):
        self.idf = {}
        for block, k, count in (("word", 0, words), ("char", 0, grams), ("filter", 1, words)):
            texts = {e[k] for e in fit if e[k] is not None}
            df = Counter(t for x in texts for t in count(x))
            self.idf[block] = {t: math.log((len(texts) + 1) / (d + 1)) + 1 for t, d in df.items()}

    def block(self, block, count, text, weight):
        v = {f"{block} {t}": (1 + math.log(n)) * self.idf[block][t] for t, n in count(text).items() if t in self.idf[block]}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size * weight for t, x in v.items()}

    def text(self, t):
        v = self.block("word", words, t, 0.8) | self.block("char", grams, t, 0.6)
        size = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / size for k, x in v.items()}

    def vector(self, text, filters):
        return Counter(self.text(text)) + Counter(self.block("filter", words, filters, 0.35) if filters is not None else {})

    def scores(self, fit, queries, kind, alpha):
        c = defaultdict(Counter)
        for text, filters, cls, _ in fit:
            c[cls].update(self.vector(text, filters))
        terms = [f"{b} {t}" for b, v in self.idf.items() for t in v]
        n, out = Counter(e[2] for e in fit), {}
        for cls in n:
            each = {t: (c[cls][t] if kind == "multinomial" else sum(c[o][t] for o in n if o != cls)) + alpha for t in terms}
            total = math.log(sum(each.values()))
            sign = 1 if kind == "multinomial" else -1
            for q in queries:
                start = math.log((n[cls] + 1) / (len(fit) + len(n))) if kind == "multinomial" else 0.0
                out[q, cls] = start + sum(w * sign * (math.log(each[t]) - total) for t, w in self.vector(*q).items())
        return out


def test_four_models_in_one_pass_and_a_refit_over_the_same_vocabulary(events):
    fit = events.where("fit = 1")
    v = intent.fit_vocabulary(fit, "v7").cache()
    plain = Plain([e for e in EVENTS if e[3]])
    assert {(r["block"], r["term"]): r["idf"] for r in v.collect()} == pytest.approx({(b, t): x for b, d in plain.idf.items() for t, x in d.items()})
    queries = [("red boat", "new"), ("zebra", None), ("wooden toy car", "old"), ("a b", "")]
    q = events.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(queries)], "query_id int, text string, filters string")
    vectors = intent.query_vectors(q, v)
    grid = intent.fit_grid(intent.intent_counts(fit, v), v, fit)
    got = {(r["model"], queries[r["query_id"]], r["class"]): r["score"] for r in intent.predict_grid(vectors, q, grid).collect()}
    want = {(m, *k): x for m, (kind, alpha) in enumerate(intent.GRID) for k, x in plain.scores([e for e in EVENTS if e[3]], queries, kind, alpha).items()}
    assert got == pytest.approx(want, abs=1e-9)
    again = intent.refit(events, v, ("complement", 1.0))
    got = {(queries[r["query_id"]], r["class"]): r["score"] for r in intent.predict_grid(vectors, q, again).collect()}
    assert got == pytest.approx(plain.scores(EVENTS, queries, "complement", 1.0), abs=1e-9)
    assert {r["term"] for r in again.terms.collect()} == {f"{b} {t}" for b, d in plain.idf.items() for t in d}  # zebra is none of them


def test_the_first_of_equal_models_is_chosen(spark):
    rows = [(1, c, m, s) for m, scores in enumerate([(1.0, 2.0, 3.0), (3.0, 1.0, 0.0), (9.0, 1.0, 0.0), (0.0, 0.0, 0.0)]) for c, s in zip("abc", scores, strict=True)]
    d = spark.createDataFrame(rows, "query_id int, class string, model int, score double")
    t = spark.createDataFrame([(1, "a")], "query_id int, class string")
    got = {r["model"]: (r["recall_at_1"], r["chosen"]) for r in intent.grid_recall(d, t).collect()}
    assert got == {0: (0.0, True), 1: (1.0, False), 2: (1.0, False), 3: (1.0, False)}  # all find it among five


def h(key, seed):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


def plain_sample(contexts, asked, sizes, seed):
    def shares(total):
        n = sum(asked.values())
        out = {s: math.floor(x * total / n) for s, x in asked.items()}
        for s in sorted(asked, key=lambda s: (-round(asked[s] * total / n - out[s], 9), s))[: total - sum(out.values())]:
            out[s] += 1
        return out

    quota = {name: shares(n) for name, n in sizes.items()}
    texts = defaultdict(set)
    for _, t, s in contexts:
        texts[s].add(t)
    want = {s: sum(q[s] for q in quota.values()) for s in asked}
    used, log = {}, {}
    first, second = sizes
    for s in sorted(asked, key=lambda s: (len(texts[s]) / max(1, want[s]), s)):
        got = sorted(texts[s] - used.keys(), key=lambda t: (h(t, seed), t))[: want[s]]
        ahead = math.floor(len(got) * quota[first][s] / max(1, want[s]) + 0.5)
        used |= {t: (s, first if i < ahead else second) for i, t in enumerate(got)}
        log[s] = (want[s], len(got), want[s] - len(got))
    for name, size in sizes.items():
        free = sorted({t for _, t, _ in contexts} - used.keys(), key=lambda t: (h(t, seed), t))
        used |= {t: (None, name) for t in free[: max(0, size - sum(v[1] == name for v in used.values()))]}
    out = {}
    for t, (s, name) in used.items():
        k, _, where = min((c for c in contexts if c[1] == t and s in (None, c[2])), key=lambda c: (h(c[0], seed + 1), c[0]))
        out[t] = (k, where, name)
    return out, log


def test_texts_are_drawn_as_one_after_the_other(spark):
    contexts = [(f"k{t}-{c}", f"text{t}", f"s{(t + c) % 4 if t % 3 else t % 4}") for t in range(40) for c in range(3)]
    asked = {"s0": 3, "s1": 30, "s2": 7, "s3": 10, "s9": 5}
    sizes = {"validation": 9, "ranker_train": 21}
    c = spark.createDataFrame(contexts, "qkey string, text string, stratum string")
    a = spark.createDataFrame(list(asked.items()), "stratum string, n long")
    picked, log = split.sample_texts(c, a, sizes, 5)
    want, told = plain_sample(contexts, asked, sizes, 5)
    assert {r["text"]: (r["qkey"], r["stratum"], r["split"]) for r in picked.collect()} == want
    assert {r["stratum"]: (r["wanted"], r["got"], r["short"]) for r in log.collect()} == told
    assert told["s9"][1] == 0 and Counter(v[2] for v in want.values()) == sizes  # nothing of s9; others filled its place


def test_a_holdout_leaks_nothing(spark):
    rows = [(f"k{t}-{p}", f"text{t}", f"s{t % 3}", 100 * t + i) for t in range(30) for p in range(4) for i in range(p * 2, p * 2 + 3)] + [("wide", "wide", "s0", i) for i in range(10_000, 10_020)]
    e = spark.createDataFrame(rows, "qkey string, text string, stratum string, item_id long")
    asked = e.select("text", "stratum").distinct()
    out = split.build_holdout(e, asked, asked.where("text < 'text2'"), sizes=(4, 8))
    q = out.queries.collect()
    assert Counter(r["split"] for r in q) == {"validation": 3, "ranker_train": 9}
    assert len({r["text"] for r in q}) == len(q) == 12 and "wide" not in {r["qkey"] for r in q}
    held, cold = {r[0] for r in out.held.collect()}, {r["text"] for r in q if r["cold"]}
    fit = out.fit.collect()
    assert not {r["item_id"] for r in fit} & held and not {r["text"] for r in fit} & cold
    assert {r["text"] for r in q if not r["cold"]} <= {r["text"] for r in fit}
    assert {(r["qkey"], r["item_id"]) for r in out.targets.collect()} == {(k, i) for k, _, _, i in rows if k in {r["qkey"] for r in q}}
    assert out.fit.where(F.col("text") == "wide").count() == 20
