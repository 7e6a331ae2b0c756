"""Conversation repair against Dijkstra over (cost, letters), and its SQL on the generated table."""

import binascii
import hashlib
import heapq
import random
import re
from collections import Counter

import duckdb

from tessera.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
BARE = re.compile(r"[\x20\x09-\x0D]+$")


def plain_damage(rows):
    for c, t, r, x in rows:
        r, x = (" " if r is None else r), (" " if x is None else x)
        k = binascii.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        yield from [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)


def plain(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)}: the least (cost, letters) first."""
    convs, out = {}, {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for c, d in convs.items():
        d.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        turns, seen, f = [t for t, _, _ in d if t is not None], set(), []
        for _, r, x in d:
            s = BARE.sub("", x)
            f.append(1 if not s else 2 if (r, x) in seen else 3 if s[-1] not in ".!?" else 0)
            seen.add((r, x))
        first = [r[:1] for _, r, _ in d]
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, said, i, state, text = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(d) and state in ("", "a"):
                break
            for role in ("user", "assistant"):
                if (state, role[0]) in NEXT:
                    heapq.heappush(heap, (cost + 3, said + "I", i, role[0], (*text, role + ":")))
            if i < len(d):
                heapq.heappush(heap, (cost + 4, said + "D", i + 1, state, text))
                if f[i] not in (1, 2):
                    more = 3 * (f[i] == 3)
                    if (state, first[i]) in NEXT:
                        heapq.heappush(heap, (cost + more, said + "K", i + 1, first[i], (*text, f"{d[i][1]}:{d[i][2]}")))
                    for role in ("user", "assistant"):
                        if (state, role[0]) in NEXT:
                            heapq.heappush(heap, (cost + more + 3, said + "R", i + 1, role[0], (*text, f"{role}:{d[i][2]}")))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, f.count(1), f.count(2), f.count(3), illegal, cost, said, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def spark_rows(done):
    sums = {r["conv"]: r["repaired_sha256"] for r in done.digests().collect()}
    return {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums[r["conv"]]) for r in done.summary().collect()}


def odd_rows():
    draw = random.Random(5)
    said = ["Yes.", "No!", "why", " \t\n", "", None, "Yes.", "A long one?\n", "é ok. ", "x" * 3000]
    rows = [(c, draw.choice([None, *range(9)]), draw.choice(["user", "assistant", "system", "tool", "", None, "User"]), draw.choice(said)) for c in [None, *range(60)] for _ in range(draw.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]  # one long conversation
    rows += [(101, 4, "user", "Same.")] * 40 + [(102, None, "assistant", "Hm.")] * 3 + [(103, 2**40, "system", "Only me.")]
    return rows


def test_every_segmenting_gives_the_cheapest_least_edits(spark):
    rows = odd_rows()
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS seg", "1 AS conv", "2 AS letters", "3 AS h")
    want = plain(rows)
    for size in (1, 3, repair.SEGMENT_ROWS):
        assert spark_rows(repair.repair(d, segment_rows=size)) == want


def test_rows_are_what_the_letters_say(spark):
    rows = odd_rows()
    done = repair.repair(spark.createDataFrame(rows, SCHEMA), segment_rows=5)
    told = {r["conv"]: Counter(r["audit"]) for r in done.summary().collect()}
    kept = sorted(done.rows().collect(), key=lambda r: (r["conv"] is not None, r["conv"] or 0, r["seg"], r["place"]))
    for conv, letters in told.items():
        mine = [r for r in kept if r["conv"] == conv]
        assert Counter(r["edit"] for r in mine) == Counter({k: v for k, v in letters.items() if k != "D"})
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))


def test_the_query_on_damage_and_all_nulls(spark, tmp_path):
    rows = [*odd_rows(), *((c, t, "user", "Hi.") for c, t in [(7000 + i, 0) for i in range(60)])]  # some lose their only row
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op11_tight_arc_repair(spark, str(tmp_path)).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = dict.fromkeys({r[0] for r in rows}, empty) | plain(plain_damage(rows))
    assert empty in want.values() and got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet' WHERE conv_id IS NOT NULL AND conv_id <> 100")
    told = {r[0]: r[1:] for r in con.execute(repair.SQL).fetchall()}
    assert told == {k: v for k, v in want.items() if k not in (None, 100)}


def test_no_conversations(spark):
    done = repair.repair(spark.createDataFrame([], SCHEMA))
    assert not done.summary().collect() and not done.digests().collect() and not done.rows().collect()
