"""Repair of conversations by cheapest edits: forward and backward costs leave a graph of tight arcs, whose least reading
is the audit. Conversations are cut into segments, and costs pass between them as (min, +) products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_SPACE, materialize, parts, quoted, sized, table

#: A segment ends at so many rows or code points of text.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
#: Costs of the edits, and of keeping a truncated row in any role.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
INF = 1 << 60
#: What a prefix of the output ends with: nothing yet, a system row, a user's row, an assistant's row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FAULTS = {"blank": 1, "duplicate": 2, "truncated": 3}
ROLES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

Costs = tuple[int, int, int, int]


@lru_cache(64)
def _arcs(code: int) -> tuple[tuple[int, int, str, int], ...]:
    """(from, to, letter, cost) of the edits that consume a row; code is its initial (0 to 3) and 4 * its fault."""
    initial, fault = code & 3, code >> 2
    arcs = [(s, s, "D", DELETE) for s in range(4)]
    if fault not in (FAULTS["blank"], FAULTS["duplicate"]):
        more = CUT_OFF if fault == FAULTS["truncated"] else 0
        steps = {0: [(EMPTY, SYSTEM)], 1: [(s, USER) for s in (EMPTY, SYSTEM, ASSISTANT)], 2: [(USER, ASSISTANT)]}
        arcs += [(s, t, "K", more) for s, t in steps.get(initial, [])]
        arcs += [(s, t, "R", REROLE + more) for s, t in steps[1] + steps[2]]
    return tuple(arcs)


#: Edits that consume no row.
_INSERTS = ((EMPTY, USER, "I", INSERT), (SYSTEM, USER, "I", INSERT), (USER, ASSISTANT, "I", INSERT), (ASSISTANT, USER, "I", INSERT))


def _with_inserts(f: list[int]) -> Costs:
    user = min(f[2], min(f[0], f[1], f[3]) + INSERT)
    return (f[0], f[1], user, min(f[3], user + INSERT))


def _before_inserts(b: list[int]) -> Costs:
    user = min(b[2], b[3] + INSERT)
    return (min(b[0], user + INSERT), min(b[1], user + INSERT), user, min(b[3], user + INSERT))


def _onward(f: Costs, code: int) -> Costs:
    """Least costs of the states after a row, inserts included, from those before it."""
    out = [INF] * 4
    for s, t, _, w in _arcs(code):
        out[t] = min(out[t], f[s] + w)
    return _with_inserts(out)


def _backward(b: Costs, code: int) -> Costs:
    """Least costs to the end from the states before a row, from those after it."""
    out = [INF] * 4
    for s, t, _, w in _arcs(code):
        out[s] = min(out[s], w + b[t])
    return _before_inserts(out)


#: Costs before the first row, and from after the last one.
FIRST: Costs = _with_inserts([0, INF, INF, INF])
LAST: Costs = _before_inserts([0, INF, INF, 0])


@lru_cache(1 << 14)
def product(codes: bytes) -> tuple[Costs, ...]:
    """Costs from each state before the rows to each one after them: one row a state."""
    out = []
    for s in range(4):
        f: Costs = tuple(0 if t == s else INF for t in range(4))
        for c in codes:
            f = _onward(f, c)
        out.append(f)
    return tuple(out)


def _through(f: Costs, m) -> Costs:
    return tuple(min(min(f[s] + m[s][t] for s in range(4)), INF) for t in range(4))


def _back_through(b: Costs, m) -> Costs:
    return _before_inserts([min(min(m[s][t] + b[t] for t in range(4)), INF) for s in range(4)])


@lru_cache(1 << 14)
def least(codes: bytes, forward: Costs, backward: Costs, frontier: frozenset, last: bool) -> tuple[str, frozenset]:
    """The least letters of a segment's tight arcs, and the states they end in.

    forward: costs before its rows, backward: costs after them. An arc is tight if cost before + its cost + cost after is
    the optimum. From the frontier, a set of states, the least letter of its tight arcs is taken, and all their targets
    are the next frontier. Inserts after a segment's last row belong to the next one, but for the last segment.
    """
    f, b = [forward], [backward]
    for c in codes:
        f.append(_onward(f[-1], c))
    for c in reversed(codes):
        b.append(_backward(b[-1], c))
    b.reverse()
    best = min(x + y for x, y in zip(f[0], b[0], strict=True))
    letters, i, n = [], 0, len(codes)
    while i < n or last:
        tight = [(letter, i, t) for s, t, letter, w in _INSERTS if s in frontier and f[i][s] + w + b[i][t] == best]
        if i < n:
            tight += [(letter, i + 1, t) for s, t, letter, w in _arcs(codes[i]) if s in frontier and f[i][s] + w + b[i + 1][t] == best]
        if not tight:
            break
        letter = min(tight)[0]
        i = min(x[1] for x in tight if x[0] == letter)
        frontier = frozenset(t for x, _, t in tight if x == letter)
        letters.append(letter)
    return "".join(letters), frontier


def edited(letters: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str, str]]:
    """(letter, role, text) of the rows that the edits leave; state is the one before the first of them."""
    out, i = [], 0
    for x in letters:
        if x == "D":
            i += 1
            continue
        if x == "K":
            role, text = roles[i], texts[i]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role, text = ROLES[state], texts[i] if x == "R" else ""
        i += x != "I"
        out.append((x, role, text))
    return out


_CUT = (
    "conv {conv}, seg long, codes binary, product array<long>, blank long, duplicate long, truncated long, illegal long, first int, last int, "
    "low {turn}, high {turn}, turns long, turn_first {turn}, turn_last {turn}, roles array<string>, texts array<string>"
)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments of up to `most` rows of one partition, which come in order: no segment spans two partitions."""
    from pyspark import TaskContext

    number, now, before, schema = TaskContext.get().partitionId() << 36, [], None, None

    def segment():
        nonlocal number
        conv = now[0][0]
        codes = bytes(x[4] for x in now)
        initials, turns = [c & 3 for c in codes], [x[1] for x in now if x[1] is not None]
        faults = [c >> 2 for c in codes]
        number += 1
        return (
            conv, number, codes, [w for row in product(codes) for w in row], faults.count(1), faults.count(2), faults.count(3),
            sum(p not in _LEGAL for p in zip(initials, initials[1:], strict=False)), initials[0], initials[-1],
            min(turns, default=None), max(turns, default=None), len(set(turns)), now[0][1], now[-1][1], [x[2] for x in now], [x[3] for x in now],
        )

    done, size, types = [], 0, None

    def flush():
        nonlocal done
        cols = list(zip(*done, strict=True))
        done = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)

    for b in batches:
        if types is None:
            conv_t, turn_t = b.schema.field(0).type, b.schema.field(1).type
            i64, i32, many = pa.int64(), pa.int32(), pa.list_(pa.string())
            types = [conv_t, i64, pa.binary(), pa.list_(i64), i64, i64, i64, i64, i32, i32, turn_t, turn_t, i64, turn_t, turn_t, many, many]
        for conv, turn, role, text, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = (conv, turn, role, text)
            if now and (now[0][0] != conv or len(now) >= most or size >= SEGMENT_CHARS):
                done.append(segment())
                now, size = [], 0
            if key == before and code >> 2 != FAULTS["blank"]:
                code = (code & 3) | FAULTS["duplicate"] << 2  # a copy of the row before it
            before = key
            now.append((conv, turn, role, text, code))
            size += len(text) + len(role)
        if done:
            yield flush()
    if now:
        done.append(segment())
        yield flush()


_NAMES = "conv seg codes product blank duplicate truncated illegal first last low high turns turn_first turn_last roles texts".split()


def _rows_of(m: list[int]) -> list[list[int]]:
    return [m[4 * s : 4 * s + 4] for s in range(4)]


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the costs from their end on and whether they are the last; they come by conversation, the last first."""
    conv, b, begun = None, LAST, False
    for batch in batches:
        after, last = [], []
        for c, m in zip(batch.column("conv").to_pylist(), batch.column("product").to_pylist(), strict=True):
            fresh = not begun or c != conv
            b = LAST if fresh else b
            conv, begun = c, True
            after.append(list(b))
            last.append(fresh)
            b = _back_through(b, _rows_of(m))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.list_(pa.int64())), pa.array(last)], names=[*batch.schema.names, "after", "is_last"])


def _read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their letters, the state before them and what joins them to the one before; they come by conversation, in order."""
    conv, f, frontier, tail, begun = None, FIRST, frozenset({EMPTY}), None, False
    for batch in batches:
        out = []
        for c, codes, m, after, last, a, z, t0, t1 in zip(*(batch.column(x).to_pylist() for x in ("conv", "codes", "product", "after", "is_last", "first", "last", "turn_first", "turn_last")), strict=True):
            fresh = not begun or c != conv
            if fresh:
                conv, f, frontier, tail, begun = c, FIRST, frozenset({EMPTY}), None, True
            state = min(frontier)  # a letter and a row lead from one state to one state, so there is one
            letters, frontier = least(codes, f, tuple(after), frontier, last)
            f = _through(f, _rows_of(m))
            cost = min(x + y for x, y in zip(f, after, strict=True)) if last else None
            out.append((letters, state, cost, int(tail is not None and (tail[0], a) not in _LEGAL), int(tail is not None and t0 is not None and tail[1] == t0)))
            tail = (z, t1)
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["conv", "seg", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, "letters", "state", "cost", "joint_illegal", "joint_turns"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [edited(*x) for x in zip(*(b.column(c).to_pylist() for c in ("letters", "roles", "texts", "state")), strict=True)]
        lists = [pa.array([[r[i] for r in x] for x in rows], pa.list_(pa.string())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), *lists], names=["conv", "seg", "edits", "roles", "texts"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) of rows `role:text`, a newline between two; one digest is in memory, not its text."""
    conv, h, begun, some = None, None, False, False
    for b in batches:
        convs, sums = [], []
        for c, roles, texts in zip(*(b.column(x).to_pylist() for x in ("conv", "roles", "texts")), strict=True):
            if not begun or c != conv:
                if begun:
                    convs.append(conv)
                    sums.append(h.hexdigest())
                conv, h, begun, some = c, hashlib.sha256(), True, False
            for r, t in zip(roles, texts, strict=True):
                h.update(f"{chr(10) if some else ''}{r}:{t}".encode())
                some = True
        kind = b.schema.field("conv").type
        if convs:
            yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


@dataclass(frozen=True)
class Repair:
    """Segments of the conversations (conv, seg, roles, texts, ...) and what was read out for them (conv, seg, letters, ...)."""

    segments: DataFrame
    read: DataFrame

    def _edited(self) -> DataFrame:
        j = self.segments.select("conv", "seg", "roles", "texts").join(sized(self.read).select("seg", "letters", "state"), "seg")
        kind = self.segments.schema["conv"].dataType.simpleString()
        return j.mapInArrow(_apply, f"conv {kind}, seg long, edits array<string>, roles array<string>, texts array<string>")

    def rows(self) -> DataFrame:
        """(conv, seg, place, edit, role, text): the repaired rows; a conversation's order is by seg, then place."""
        e = self._edited().select("conv", "seg", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "x"))
        return e.select("conv", "seg", "place", F.col("x.edits").alias("edit"), F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256): `role:text` of the repaired rows, joined by newlines. A digest is one after the other, so
        each conversation's text streams through one task."""
        d = self._edited().select("conv", "seg", "roles", "texts").repartition(parts(self.read.sparkSession), "conv").sortWithinPartitions("conv", "seg")
        return d.mapInArrow(_digests, f"conv {self.segments.schema['conv'].dataType.simpleString()}, repaired_sha256 string")

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation; an audit is a letter a row."""
        pieces = F.sort_array(F.collect_list(F.struct("seg", "letters")))
        gaps = F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("joint_turns"))
        return self.read.groupBy("conv").agg(
            F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in FAULTS), F.sum(F.col("illegal") + F.col("joint_illegal")).alias("illegal"),
            F.max("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["letters"]), "").alias("audit"),
        )


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_rows: int = SEGMENT_ROWS) -> Repair:
    """Cheapest edits that leave each conversation with role initials `(s?(ua)+)?`, ties to the least letters.

    A conversation's rows go by turn (null first), then role, then text. The first fault of a row counts: blank (no
    character but ASCII white space), duplicate (role and text of an earlier row), truncated (the last character that
    isn't white space is none of `.!?`). Keep (K) costs 0, Rerole (R) to user or assistant 3, Insert (I) of an empty
    user's or assistant's row 3, Delete (D) 4; blank and duplicate rows must go, truncated ones that stay cost 3 more.

    Rows are dealt by ranges of their order, so a conversation of any size spreads over tasks. A task cuts its rows into
    segments, and each is summed up as its 4 x 4 costs between states. Over the segments of a conversation, one row each,
    a stream from the last to the first gives backward costs, one from the first to the last forward costs and the least
    reading of the tight arcs. Its state is four numbers.

    Null roles and texts count as one space, null conversation keys are a conversation, repeated rows are duplicates, an
    empty table gives no conversations. Extra columns are left out. turn is a whole number.
    """
    spark = turns.sparkSession
    space = lambda c: F.coalesce(F.col(quoted(c)), F.lit(" "))
    r = turns.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    h = F.unhex(F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = r.groupBy("conv", "role", h.alias("h")).agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = sized(materialize(again.select(F.col("conv").alias("c"), F.col("role").alias("o"), "h", "at")))
    j = r.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("o")) & (h == F.col("h")), "left")
    keys = ["conv", "turn", "role", "text"]
    # What a row costs is worked out after the deal, whose sampling reads all rows once more.
    dealt = j.select(*keys, "at").repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys)
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(~F.col("text").rlike(NO_SPACE), 1).when(order > F.col("at"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.lit(3)
    for x, i in _INITIALS.items():
        letter = F.when(initial == x, i).otherwise(letter)
    dealt = dealt.select(*keys, (letter + fault * 4).cast("int").alias("code"))
    kinds = {c: r.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    segments = materialize(dealt.mapInArrow(lambda b: _cut(b, segment_rows), _CUT.format(**kinds)))
    thin = segments.drop("roles", "texts").repartition(parts(spark), "conv").sortWithinPartitions("conv", F.desc("seg"))
    back = thin.mapInArrow(_costs_after, thin.schema.simpleString()[7:-1] + ",after:array<bigint>,is_last:boolean")
    back = back.repartition(parts(spark), "conv").sortWithinPartitions("conv", "seg")
    turn_kind = kinds["turn"]
    read = back.mapInArrow(
        _read_out,
        f"conv {kinds['conv']}, seg long, blank long, duplicate long, truncated long, illegal long, low {turn_kind}, high {turn_kind}, turns long, letters string, state int, cost long, joint_illegal long, joint_turns long",
    )
    return Repair(segments, materialize(read))


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations' rows after the damage by crc32 of `conv_id:turn`, mod 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("k"))
    t = t.where("k <> 0").withColumn("text", F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    t = t.withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    return t.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op11_tight_arc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(turns))
    zeros = turns.select(F.col("conv_id").alias("conv")).distinct()
    s, d = done.summary().withColumnRenamed("conv", "a"), done.digests().withColumnRenamed("conv", "b")
    j = zeros.join(s, F.col("conv").eqNullSafe(F.col("a")), "left").join(d, F.col("conv").eqNullSafe(F.col("b")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select(
        F.col("conv").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _least(*of: str) -> str:
    return f"list_min([{', '.join(of)}])"


def _plus(x: str, cost: str, letter: str, said: str) -> str:
    out = f"concat({x}.o, CASE WHEN {x}.o = '' THEN '' ELSE chr(10) END, {said})" if said else f"{x}.o"
    return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {out}}}"


_NONE = "{'c': 1000000, 'a': '', 'o': ''}"
def _closed(inner: str) -> str:
    """The costs of a layer with its inserts."""
    user = _least("u0", *(_plus(x, "3", "I", "'user:'") for x in ("e", "s", "a0")))
    return f"SELECT conv_id, i, e, s, u, {_least('a0', _plus('u', '3', 'I', ASSISTANT_ROW))} AS a FROM (SELECT conv_id, i, e, s, {user} AS u, a0 FROM ({inner}))"


ASSISTANT_ROW, KEPT = "'assistant:'", "concat(role, ':', text)"


def _rows_sql() -> str:
    """The costs after one more row, without inserts: what it takes to keep, rerole or delete it."""
    keep = lambda x, initial: f"CASE WHEN f NOT IN (1, 2) AND i0 = '{initial}' THEN {_plus(x, '3 * (f = 3)::INT', 'K', KEPT)} ELSE {_NONE} END"
    rerole = lambda x, role: f"CASE WHEN f NOT IN (1, 2) THEN {_plus(x, '3 + 3 * (f = 3)::INT', 'R', f"concat('{role}:', text)")} ELSE {_NONE} END"
    drop = lambda x: _plus(x, "4", "D", "")
    user = [g(x, y) for x in ("e", "s", "a") for g, y in ((keep, "u"), (rerole, "user"))]
    return f"""SELECT conv_id, r.i, {drop('e')} AS e, {_least(drop('s'), keep('e', 's'))} AS s, {_least(drop('u'), *user)} AS u0, {_least(drop('a'), keep('u', 'a'), rerole('u', 'assistant'))} AS a0
    FROM w JOIN r USING (conv_id) WHERE r.i = w.i + 1"""


#: Least (cost, audit) of each state, row by row; null conversation keys don't join there and have none.
SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS x(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS m FROM k, crc),
g AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) FROM d WHERE m <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
r AS (SELECT *, left(role, 1) AS i0, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS f,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
w AS ({_closed(f"SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS e, {_NONE} AS s, {_NONE} AS u0, {_NONE} AS a0 FROM r")}
  UNION ALL {_closed(_rows_sql())}),
z AS (SELECT conv_id, {_least('e', 'a')} AS best FROM w JOIN (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id) USING (conv_id, i)),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN q USING (conv_id) LEFT JOIN z USING (conv_id)"""
