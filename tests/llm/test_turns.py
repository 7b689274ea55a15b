"""Conversation repair against a shortest path over every edit."""

import hashlib
import heapq
import random
import zlib

import pytest

from talentgrid.llm import turns
from talentgrid.llm.queries import QUERIES

SPACES = " \t\n\x0b\f\r"
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLES = (("u", "user"), ("a", "assistant"))
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows: list[tuple], faults: list[str | None]) -> tuple[int, str, list[tuple]]:
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        for c, name in ROLES:
            if c in STEP[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, STEP[state][c], (*out, (name, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if faults[i] not in ("blank", "duplicate"):
            extra = faults[i] == "truncated"
            if role[:1] in STEP[state]:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, STEP[state][role[:1]], (*out, (role, text))))
            for c, name in ROLES:
                if c in STEP[state]:
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, STEP[state][c], (*out, (name, text))))


def brute(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash and the rows that remain, of rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit, left = cheapest(rows, faults)
    told = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    lines = "\n".join(f"{r}:{t}" for r, t in left)
    return max(told) - min(told) + 1 - len(told) if told else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest(), left


def wanted(rows: list[tuple], hurt: bool) -> dict:
    kept: dict = {}
    for conv, turn, role, text in rows:
        told = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20 if hurt else 9
        text = "" if kind == 1 else told[3].translate({46: None, 33: None, 63: None}) if kind == 2 else told[3]
        kept.setdefault(conv, []).extend([(turn, "user" if kind == 4 else told[2], text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for own in kept.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return {c: brute(own) for c, own in kept.items()}


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(3)
    rows = []
    for conv in [*range(150), None]:
        for t in range(r.randint(1, 14)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            rows.append((conv, r.choice([t, t, t, t, t + r.randint(0, 3), None]), role, r.choice(["a.", "b!", "b!", " c? \n", "d", "", "  \t", None, f"e.{t}", f"f{t}", "é…"])))
    rows += rows[:30]  # repeated rows
    rows += [(5000, i, "user" if i % 3 else "assistant", r.choice(["hot.", f"x{i}.", f"y{i}"])) for i in range(600)]
    rows += [(5001, 7, "user", "same.")] * 300 + [(5002, i, "user", "long " * 20_000 + ".") for i in range(3)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("most", [turns.PIECE, 3])
def test_audits_and_rows(talks, most):
    rows, table = talks
    want = wanted(rows, False)
    got = {r.conv_id: tuple(r)[1:] for r in turns.audits(table, most).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    edits: dict = {}
    for r in turns.repair(table, most).orderBy("conv_id", "place").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, w in want.items():
        own = edits.get(conv, [])
        assert "".join(e.edit for e in own) == w[6] and [(e.role, e.text) for e in own if e.edit != "D"] == w[-1]


def test_query(spark, folder, talks):
    rows, table = talks
    table.selectExpr("*", "'x' as audit", "1 as copies", "2 as place").write.parquet(f"{folder}/conversations.parquet")
    want = {c: w[:-1] for c, w in wanted(rows, True).items()}
    got = QUERIES["op11_conversation_repair"](spark, folder).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    table.limit(0).write.parquet(f"{folder}/none/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, f"{folder}/none").count() == 0


def test_dropped_conversations_are_told(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a.", 0)], SCHEMA + ", copies int")
    (row,) = turns.audits(rows).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and turns.repair(rows).count() == 0


def test_powers_are_repeated_steps():
    for symbol in range(turns.GONE + 1):
        v = step = (5, 0, turns._FAR, 2)
        for n in range(1, 40):
            step = turns.ahead(turns.power(symbol, 0), step)
            assert turns.run_ahead(symbol, n, v) == step == turns.ahead(turns.transition([(symbol, n)]), v)
