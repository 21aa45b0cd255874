"""Conversation repair by weighted finite-state composition.

Three machines are composed:

* the input acceptor, a chain with one arc for each row of a conversation;
* the edit transducer: Keep (0), Rerole to user or assistant (3), Delete (4; the only
  edit of a blank or duplicate row), Insert user or assistant (3, reads no row); a
  truncated row that stays costs 3 more;
* the acceptor of the role grammar ``(s?(ua)+)?`` over roles' initials.

A weight is a cost and a string of edit initials: costs are added and strings joined,
and of two weights the lower cost is better, then the string that is less in ASCII.
The composition is never built: states (row, grammar state) are reached from the start
on demand, and their shortest paths found in reverse topological order.  Every edit
costs at least as much as it can undo, and from any state each edit initial has one
successor, so that the first initial settles ties.

Rows are put in order by a range exchange over conversation, turn, role and text, which
splits a hot conversation as it splits any other range, and are written once.  Each run
of ``SEGMENT`` rows then gives a string of one sign for each row (its initial and its
fault); texts do not go with it.  A conversation in one segment is solved from its sign
string.  For one in several, each segment is solved by itself between all pairs of
grammar states (a 4 x 4 matrix of weights), and the matrices are multiplied in order.
The repaired rows follow from the stored rows and each segment's edits, segment by
segment.  Only ``digests`` reads a conversation's texts in one task, as a SHA-256 has
no parts; they stream through it in order and are not held.

Defined cases: a null in any column is read as one space, but a null turn stays null
and comes first; a null conversation is a conversation (with one whose id, as text, is
one space, where ids are strings); rows of equal turn come by role, then text, in code
point order, and equal rows count one after the other; a role that is empty has no
initial: kept, it adds nothing to the string of initials, but it never makes a legal
pair; texts are never cut; other columns are not read.  A conversation without rows has
zeros, no edits and no repaired rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import hot_join, materialize, trim_ascii

#: Rows of a segment, at most (a power of two).
SEGMENT = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Signs of rows by initial (system, user, assistant, another, none) and fault.
FINE, CUT, GONE = "suaoe", "SUAOE", "01234"
_INITIAL = str.maketrans(CUT + GONE, FINE + FINE)
#: The role grammar: start, after a leading system, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
_NEXT_ROLE = {state: (role, to) for (state, role), to in GRAMMAR.items() if role != "s"}

Weight = tuple[int, str]


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, told by CRC-32 of ``conv_id:turn``: dropped, emptied,
    unpunctuated, repeated, or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    times = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def sign(role: Column, fault: Column) -> Column:
    """A row's sign; ``fault`` is 0 for none, 1 for truncated, 2 for rows that must go."""
    initial = F.substring(role, 1, 1)
    at = F.when(role == "", 4).otherwise(F.coalesce(F.nullif(F.instr(F.lit("sua"), initial), F.lit(0)) - 1, F.lit(3)))
    return F.substring(F.lit(FINE + CUT + GONE), (fault * 5 + at + 1).cast("int"), F.lit(1))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows in order, written: ``key, conv_id, turn, role, text, n, place, signs`` and fault counts.

    Equal rows are one with their number ``n``.  ``place`` increases along a conversation.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(said("conv_id").alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    once = named.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"), F.first("conv_id").alias("conv_id"))
    once = once.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(7), "role")})
    once = materialize(once, "conversation-turns")
    seen = once.groupBy("key", "h1", "h2").agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"), F.count("*").alias("m"))
    seen = materialize(seen.where("m > 1"), "conversation-repeats")
    told = hot_join(once, seen, ["key", "h1", "h2"], "m", F.xxhash64("turn"), how="left")
    again = F.coalesce(F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))

    blank = trim_ascii(F.col("text")) == ""
    cut = ~F.right(trim_ascii(F.col("text")), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank | again, 2).when(cut, 1).otherwise(0)
    signs = F.concat(sign(F.col("role"), fault), F.repeat(sign(F.col("role"), F.lit(2)), (F.col("n") - 1).cast("int")))
    told = told.select(
        "key", "conv_id", "turn", "role", "text", "n", signs.alias("signs"),
        F.when(blank, F.col("n")).otherwise(0).alias("blank"),
        F.when(blank, 0).otherwise(F.col("n") - (~again).cast("int")).alias("duplicate"),
        F.when(fault == 1, 1).otherwise(0).alias("truncated"),
    )
    dealt = told.repartitionByRange("key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text")
    return materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "conversation-rows")


def _run() -> Column:
    return F.shiftright("place", SEGMENT.bit_length() - 1)


def segments(rows: DataFrame) -> DataFrame:
    """Of each conversation's part of a run of ``SEGMENT`` rows its signs and counts."""
    rows = rows.select("key", "conv_id", "turn", "place", "signs", "blank", "duplicate", "truncated", _run().alias("seg"))
    listed = F.array_sort(F.collect_list(F.struct("place", "signs", "turn")))
    found = rows.groupBy("key", "seg").agg(
        listed.alias("rows"), F.first("conv_id").alias("conv_id"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    turns = F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull()))
    return found.select(
        "key", "seg", "conv_id", F.array_join("rows.signs", "").alias("signs"),
        "blank", "duplicate", "truncated", "low", "high", F.size(turns).cast("long").alias("turns"),
    )


def arcs(state: int, one: str) -> Iterator[tuple[int, str, int]]:
    """Arcs of the composed machine that read one row: cost, edit initial, next state."""
    yield DELETE, "D", state
    if one in GONE:
        return
    late, initial = (TRUNCATED if one in CUT else 0), one.translate(_INITIAL)
    kept = state if initial == "e" else GRAMMAR.get((state, initial))
    if kept is not None:
        yield late, "K", kept
    if state in _NEXT_ROLE:
        yield late + REROLE, "R", _NEXT_ROLE[state][1]


def reached(signs: str, start: int) -> list[set[int]]:
    """The grammar states that can be met before each row and after the last."""
    out = []
    front = {start}
    for one in [*signs, ""]:
        todo = list(front)
        while todo:  # insertions read no row
            to = _NEXT_ROLE[todo.pop()][1]
            if to not in front:
                front.add(to)
                todo.append(to)
        out.append(front)
        front = {to for state in front for _, _, to in arcs(state, one)} if one else set()
    return out


def shortest(signs: str, start: int, ends: tuple[int, ...]) -> Weight | None:
    """The best weight of a path that reads ``signs`` from ``start`` to one of ``ends``."""
    levels = reached(signs, start)
    after: dict[int, int] = {}
    chosen: list[dict[int, tuple[str, int]]] = []
    for at in range(len(signs), -1, -1):
        own = {state: (0, "", state) for state in levels[at] if state in ends} if at == len(signs) else {}
        if at < len(signs):
            for state in levels[at]:
                ways = [(cost + after[to], edit, to) for cost, edit, to in arcs(state, signs[at]) if to in after]
                if ways:
                    own[state] = min(ways)
        for state in (ASSISTANT, USER):  # what insertions lead to; two in a row are never more than start or system to assistant
            for before in levels[at]:
                if state in own and _NEXT_ROLE[before][1] == state:
                    own[before] = min(own.get(before, (1 << 60, "", 0)), (INSERT + own[state][0], "I", state))
        after = {state: way[0] for state, way in own.items()}
        chosen.append({state: way[1:] for state, way in own.items()})
    if start not in after:
        return None
    chosen.reverse()
    state, at, edits = start, 0, []
    while True:
        edit, to = chosen[at][state]
        if not edit:
            return after[start], "".join(edits)
        edits.append(edit)
        state, at = to, at + (edit != "I")


def solve(signs: str) -> Weight:
    """Cost and edits of a whole conversation."""
    return shortest(signs, START, FINAL)


def matrix(signs: str) -> list[list[Weight | None]]:
    """Weights of a segment between all grammar states."""
    return [[shortest(signs, start, (end,)) for end in range(4)] for start in range(4)]


def multiply(row: dict[int, tuple[Weight, tuple[tuple[int, str], ...]]], m: list[list[Weight | None]]) -> dict:
    """One more segment: for each state the best weight and, by segment, where it began and its edits."""
    out: dict = {}
    for start, ((cost, edits), parts) in row.items():
        for end, weight in enumerate(m[start]):
            if weight is not None:
                way = ((cost + weight[0], edits + weight[1]), (*parts, (start, weight[1])))
                if end not in out or way[0] < out[end][0]:
                    out[end] = way
    return out


_PLAN = "key string, cost bigint, audit string, parts array<struct<seg: bigint, start: int, edits: string>>, illegal bigint"


def _illegal(signs: str) -> int:
    roles = signs.translate(_INITIAL)
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _solve_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Weight] = {}  # many conversations have the same signs
    for batch in batches:
        rows = []
        for key, seg, signs in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "signs")), strict=True):
            if len(known) >= 100_000:
                known.clear()
            cost, audit = known[signs] if signs in known else solve(signs)
            if len(signs) <= 64:
                known[signs] = cost, audit
            part = {"seg": seg, "start": START, "edits": audit}
            rows.append({"key": key, "cost": cost, "audit": audit, "parts": [part], "illegal": _illegal(signs)})
        yield _batch(rows)


_PARTS = pa.list_(pa.struct([("seg", pa.int64()), ("start", pa.int32()), ("edits", pa.string())]))
_PLAN_ARROW = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("parts", _PARTS), ("illegal", pa.int64())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_PLAN_ARROW)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's weights, by start and end state; a cost of -1 where there is no path."""
    for batch in batches:
        flat = [[w or (-1, "") for line in matrix(s) for w in line] for s in batch.column("signs").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "key": batch.column("key"), "seg": batch.column("seg"), "signs": batch.column("signs"),
            "costs": pa.array([[w[0] for w in m] for m in flat], pa.list_(pa.int64())),
            "edits": pa.array([[w[1] for w in m] for m in flat], pa.list_(pa.string())),
        })


def _solve_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for record in batch.to_pylist():
            row, signs = {START: ((0, ""), ())}, ""
            for part in record["list"]:
                flat = [None if c < 0 else (c, e) for c, e in zip(part["costs"], part["edits"], strict=True)]
                row = multiply(row, [flat[i : i + 4] for i in range(0, 16, 4)])
                signs += part["signs"]
            (cost, audit), parts = min(row[end] for end in FINAL if end in row)
            told = [{"seg": p["seg"], "start": start, "edits": edits} for p, (start, edits) in zip(record["list"], parts, strict=True)]
            yield _batch([{"key": record["key"], "cost": cost, "audit": audit, "parts": told, "illegal": _illegal(signs)}])


def edit_plan(parts: DataFrame) -> DataFrame:
    """``key, cost, audit, parts, illegal`` of each conversation with rows."""
    counts = parts.groupBy("key").agg(F.count("*").alias("m"))
    # runs hold SEGMENT rows, so at most two conversations a run are in several
    long = materialize(counts.where("m > 1"), "long-conversations")
    short = parts.join(long, "key", "left_anti").select("key", "seg", "signs").mapInArrow(_solve_short, _PLAN)
    weights = "key string, seg bigint, signs string, costs array<bigint>, edits array<string>"
    each = parts.join(long, "key", "left_semi").select("key", "seg", "signs").repartition("key", "seg").mapInArrow(_matrices, weights)
    lists = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "signs", "costs", "edits"))).alias("list"))
    return short.unionByName(lists.mapInArrow(_solve_long, _PLAN))


def walk(rows: Iterator[tuple[str, str, list[int]]], start: int, edits: str) -> Iterator[tuple[str, str, str]]:
    """Apply a segment's edits to its rows: role, text and edit of each repaired row.

    ``rows`` gives role, text and how many equal rows there are.
    """
    state, at = start, 0

    def placed() -> str:
        nonlocal state
        role, state = _NEXT_ROLE[state]
        return {"u": "user", "a": "assistant"}[role]

    for role, text, n in rows:
        for _ in range(n):
            while edits[at] == "I":
                yield placed(), "", "I"
                at += 1
            if edits[at] == "K":
                state = GRAMMAR[state, role[:1]] if role else state
                yield role, text, "K"
            elif edits[at] == "R":
                yield placed(), text, "R"
            at += 1
    for _ in edits[at:]:
        yield placed(), "", "I"


def _streams(rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their segment's edits before them, in order, keyed by ``by``."""
    edits = plan.select("key", F.explode("parts").alias("p")).select(
        "key", "p.seg", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.lit("").alias("role"), F.col("p.edits").alias("text"), "p.start",
    )
    own = rows.select("key", _run().alias("seg"), "place", "n", "role", "text", F.lit(0).alias("start"))
    return edits.unionByName(own).repartition(*by).sortWithinPartitions("key", "seg", "place")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[tuple[str, str, str]]]]:
    """For each segment met its key, its number and its repaired rows (to be used up at once)."""
    flat = (
        record for batch in batches
        for record in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "role", "text", "start")), strict=True)
    )
    head = next(flat, None)
    while head is not None:
        key, seg, _, _, edits, start = head
        head = None

        def own() -> Iterator[tuple[str, str, int]]:
            nonlocal head
            for record in flat:
                if record[2] == 0:  # the next segment's edits
                    head = record
                    return
                yield record[3], record[4], record[2]

        yield key, seg, walk(own(), start, edits)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``key, seg, position, role, text, edit`` of every repaired row; ``seg`` and ``position`` order a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(6)]
        for key, seg, turns in _walked(batches):
            for i, turn in enumerate(turns):
                for column, value in zip(columns, (key, seg, i, *turn), strict=True):
                    column.append(value)
                if len(columns[0]) >= 1000:
                    yield _turns(columns)
                    columns = [[] for _ in range(6)]
        yield _turns(columns)

    return _streams(rows, plan, ["key", "seg"]).mapInArrow(run, "key string, seg bigint, position bigint, role string, text string, edit string")


def _turns(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["key", "seg", "position", "role", "text", "edit"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``key, repaired_sha256``: of ``role:text`` of the repaired rows, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes = [], []
        for key, _, turns in _walked(batches):
            if not names or names[-1] != key:
                names.append(key)
                hashes.append((hashlib.sha256(), []))
            digest, some = hashes[-1]
            for role, text, _ in turns:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some[:] = [True]
        yield pa.RecordBatch.from_pydict({"key": pa.array(names, pa.string()), "repaired_sha256": pa.array([h.hexdigest() for h, _ in hashes], pa.string())})

    return _streams(rows, plan, ["key"]).mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ordered rows, the plan of edits, and a report of each conversation with rows
    (``key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``)."""
    ordered = ordered_rows(rows)
    parts = materialize(segments(ordered), "conversation-segments")
    plan = materialize(edit_plan(parts), "conversation-edits")
    stats = parts.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
        F.array_sort(F.collect_list(F.struct("seg", "low", "high"))).alias("spans"),
    )
    # a turn that one segment ends and the next begins is counted in both
    shared = F.aggregate(
        F.zip_with(F.slice("spans", 1, F.size("spans") - 1), F.slice("spans", F.lit(2), F.size("spans")), lambda a, b: (a["high"] == b["low"]).cast("long")),
        F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x, F.lit(0)),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - shared), F.lit(0))
    report = stats.join(plan, "key").select("key", "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return ordered, plan, report


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the contract's columns for every conversation of the undamaged table."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ordered, plan, report = repair(damaged(table))
    told = report.join(digests(ordered, plan), "key").drop("conv_id")
    every = table.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(told, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _sql() -> str:
    """A recursion over a conversation's rows that keeps for each grammar state the least
    ``{k: cost in nine digits and edits, t: repaired text}``."""

    def way(x: str, cost: str, edit: str, piece: str = "''") -> str:
        return (f"CASE WHEN {x} IS NOT NULL THEN {{'k': lpad((left({x}.k, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}.k, 10) || '{edit}',"
                f" 't': {x}.t || {piece}}} END")  # fmt: skip

    insert = lambda x, role: way(x, "3", "I", f"chr(10) || '{role}:'")
    users = "least(" + ", ".join(["u", *(insert(x, "user") for x in ("b", "s", "a"))]) + ")"
    closed = lambda source: (
        f"(SELECT * REPLACE (least(a, {insert('u', 'assistant')}) AS a) FROM (SELECT * REPLACE ({users} AS u) FROM {source}))"
    )
    before_user = "least(b, s, a)"
    keep = lambda x: way(x, "late", "K", "chr(10) || role || ':' || text")
    rerole = lambda x, role: way(x, "3 + late", "R", f"chr(10) || '{role}:' || text")
    stays = lambda x, *more: "least(" + ", ".join([way(x, "4", "D"), f"CASE WHEN fault < 2 AND role = '' THEN {keep(x)} END", *more]) + ")"
    kept = lambda x, initial: f"CASE WHEN fault < 2 AND left(role, 1) = '{initial}' THEN {keep(x)} END"
    given = lambda x, role: f"CASE WHEN fault < 2 THEN {rerole(x, role)} END"
    return f"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
), c AS (
  SELECT * EXCLUDE (bytes), xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda x, y:
    list_reduce(list_prepend(xor(x, y), range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 20 AS kind FROM h
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM c)
), o AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS g, *, row_number() OVER w AS i,
    lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS MATERIALIZED (
  SELECT *, CASE WHEN blank OR again THEN 2 WHEN cut THEN 1 ELSE 0 END AS fault, CASE WHEN cut THEN 3 ELSE 0 END AS late FROM (
    SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
      row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again FROM o)
), r AS (
  SELECT g, 0::BIGINT AS i, {{'k': '000000000', 't': ''}} AS b, NULL::STRUCT(k VARCHAR, t VARCHAR) AS s,
    NULL::STRUCT(k VARCHAR, t VARCHAR) AS u, NULL::STRUCT(k VARCHAR, t VARCHAR) AS a FROM (SELECT DISTINCT g FROM f)
  UNION ALL
  SELECT g, i, {stays("b")}, {stays("s", kept("b", "s"))}, {stays("u", kept(before_user, "u"), given(before_user, "user"))},
    {stays("a", kept("u", "a"), given("u", "assistant"))}
  FROM (SELECT x.g, f.i, x.b, x.s, x.u, x.a, f.role, f.text, f.fault, f.late FROM {closed("r")} AS x JOIN f ON f.g = x.g AND f.i = x.i + 1)
), e AS (
  SELECT g, least(b, a) AS e FROM {closed("(SELECT * FROM r QUALIFY i = max(i) OVER (PARTITION BY g))")}
), n AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND again) AS duplicate,
    count_if(fault = 1) AS truncated, count_if(odd) AS illegal FROM f GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(e.k, 9)::BIGINT, 0) AS cost,
  coalesce(substr(e.k, 10), '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g FROM conversations) LEFT JOIN n USING (g) LEFT JOIN e USING (g)
"""


SQL = _sql()
