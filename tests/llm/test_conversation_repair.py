"""Conversation repair against an exhaustive search and a plain version of the whole."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from cargolore.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, seg long, place long, n string, signs int"
WS = " \t\n\x0b\f\r"


def cheapest(rows):
    """Edits of (role, fault) rows by a best-first search over cost and audit, with the repaired (role, row)."""
    legal = re.compile(r"s?(ua)*u?")
    done, heap = set(), [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, out, kept = heapq.heappop(heap)
        if (at, out[:1] == "s", out[-1:]) in done:
            continue
        done.add((at, out[:1] == "s", out[-1:]))
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", out):
            return cost, audit, kept
        ways = [(3, "I", at, r, (r, None)) for r in ("user", "assistant")]
        if at < len(rows):
            role, fault = rows[at]
            ways.append((4, "D", at + 1, "", None))
            if fault < 2:
                ways.append((3 * fault, "K", at + 1, role, (role, at)))
                ways += [(3 + 3 * fault, "R", at + 1, r, (r, at)) for r in ("user", "assistant")]
        for more, edit, to, role, turn in ways:
            if legal.fullmatch(out + role[:1]):
                heapq.heappush(heap, (cost + more, audit + edit, to, out + role[:1], kept + ((turn,) if turn else ())))


def plain(table, damage=True):
    """The contract, row by row: results by conversation."""
    groups = {}
    for conv, turn, role, text in table:
        named = " " if conv is None else str(conv)
        kind = zlib.crc32(f"{named}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own = groups.setdefault(conv, [])
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(WS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            faults.append((role, {None: 0, 2: 1}.get(fault, 2)))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, kept = cheapest(faults)
        said = "\n".join(f"{role}:{'' if at is None else rows[at][2]}" for role, at in kept)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def table(seed, n, convs=12):
    r = random.Random(seed)
    texts = ["Fine.", "Fine too!", "cut off", "", " \t\n", None, "Ende?  \n", "é.", "a" * 50_000 + ".", "what ? no"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ufo"]
    rows = [(r.choice([None, *range(convs)]), r.choice([None, *range(8)]), r.choice(roles), r.choice(texts)) for _ in range(n)]
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 1, "n", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(300))
def test_shortest_paths(seed):
    r = random.Random(seed)
    rows = [(r.choice(["s", "u", "a", "o", ""]), r.choice([0, 0, 1, 2])) for _ in range(r.randrange(8))]
    signs = "".join((repair.FINE, repair.CUT, repair.GONE)[fault]["suao".find(role) if role else 4] for role, fault in rows)
    cost, audit, _ = cheapest(rows)
    assert repair.solve(signs) == (cost, audit)
    cut = r.randrange(len(signs) + 1)
    way = {repair.START: ((0, ""), ())}
    for part in (signs[:cut], signs[cut:]):
        way = repair.multiply(way, repair.matrix(part))
    assert min(way[end][0] for end in repair.FINAL if end in way) == (cost, audit)


@pytest.mark.parametrize(("seed", "segment"), [(1, 4096), (2, 4), (3, 1)])
def test_query_against_a_plain_version(spark, tmp_path, monkeypatch, seed, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = table(seed, 90)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in repair.query(spark, str(tmp_path)).collect()}
    assert got == plain(rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """A hot conversation is cut into segments, and its rows come out repaired and in order."""
    monkeypatch.setattr(repair, "SEGMENT", 64)
    r = random.Random(5)
    hot = [(7, i // 2, r.choice(["user", "assistant", "system"]), r.choice(["ok.", "cut", f"turn {i}."])) for i in range(1500)]
    rows = hot + [(i, 0, "user", "Hello?") for i in range(20, 60)]
    ordered, plan, report = repair.repair(frame(spark, rows))
    want = plain(rows, damage=False)
    assert {r.conv_id: (*tuple(r)[2:],) for r in report.collect()} == {k: v[:-1] for k, v in want.items()}
    assert len(plan.where("key = '7'").first().parts) > 10
    turns = repair.repaired(ordered, plan).where("key = '7'").orderBy("seg", "position").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == want[7][-1]
    assert "".join(t.edit for t in turns) == want[7][-2].replace("D", "")


def test_empty_conversations(spark, tmp_path):
    empty = frame(spark, [(1, 1, "user", "x")]).where("false")
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.query(spark, str(tmp_path)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame(spark, [(dropped, 0, "user", "gone.")]).write.parquet(f"{tmp_path}/one/conversations.parquet")
    (row,) = repair.query(spark, f"{tmp_path}/one").collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
