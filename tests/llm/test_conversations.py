"""Repair of conversations against a search over all edits, one conversation at a time."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries
from quillspark.llm.conversation_repair import repair_conversations, repaired_hashes

SPACE = " \t\n\x0b\x0c\r"


def damaged_by_force(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 1:
            text = ""
        if lot == 2:
            text = "".join(c for c in text if c not in ".!?")
        if lot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def repaired_by_force(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.rstrip(SPACE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, added):
        """Cost and edits from row i on; edits as (letter, role)."""
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        nxt = "a" if state == "u" else "u"
        name = "user" if nxt == "u" else "assistant"
        if added < 3:
            c, audit, lines = best(i, nxt, added + 1)
            found.append((2 + c, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, audit, lines = best(i + 1, state, 0)
            found.append((3 + c, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                c, audit, lines = best(i + 1, nxt, 0)
                found.append((2 + more + c, "R" + audit, (f"{name}:{text}", *lines)))
                if initials[i] and initials[i] in follow[state]:
                    c, audit, lines = best(i + 1, initials[i], 0)
                    found.append((more + c, "K" + audit, (f"{role}:{text}", *lines)))
        return min(found, default=(1 << 30, "", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def odd_rows(n, longest):
    rng = random.Random(n)
    texts = ["Hello.", "Well?", "open end", "x! \n", " \t", "", "Sure.", "no stop ", "a.\u0085", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", "", " ", "Sam", "tool", "supervisor"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles if rng.random() < 0.5 else roles[:3]), f"{rng.choice(texts)}" if rng.random() < 0.3 else f"{rng.randint(0, 99)} {rng.choice(texts)}"))
    return rows


@pytest.mark.parametrize("segment", [3, 4096])
def test_repair_matches_search(spark, segment):
    rows = odd_rows(60, 14)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, repaired = repair_conversations(table, segment=segment)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in report.join(repaired_hashes(repaired), "c", "left").na.fill(hashlib.sha256(b"").hexdigest(), ["repaired_sha256"]).collect()}
    want = {c: repaired_by_force(own) for c, own in by_conversation(rows).items()}
    assert got == want


def test_query_matches_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = by_conversation(damaged_by_force(rows))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == {c: repaired_by_force(own.get(c, [])) for c in by_conversation(rows)}


def test_awkward_conversations(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, None, "x"), (1, None, None, "x"), (2, 5, "user", "y. " * 50_000), (2, 5, "user", "y. " * 50_000), (3, -(1 << 63), "user", "z."), (3, (1 << 63) - 1, "assistant", "z."), (4, 1, "user", "Ü."), *[(9, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(500)]]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, c int, g int, block int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    own = by_conversation(damaged_by_force(rows))
    want = {c: repaired_by_force(own.get(c, [])) for c in by_conversation(rows)}
    want[3] = ((1 << 63) - 1, *want[3][1:]) if want[3][0] > (1 << 63) - 1 else want[3]
    assert got == want
    report, repaired = repair_conversations(table.filter("false"))
    assert report.count() == 0 and repaired.count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert queries.damaged(none).count() == 0


def test_repaired_rows_alternate(spark):
    table = spark.createDataFrame(odd_rows(30, 20), "conv_id long, turn long, role string, text string")
    _, repaired = repair_conversations(table, segment=4)
    flow = repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("row", "sub", F.substring("role", 1, 1).alias("i")))).alias("x")).select(F.array_join(F.transform("x", lambda x: x["i"]), "").alias("x"))
    assert flow.filter(~F.col("x").rlike("^(s?(ua)+)?$")).isEmpty() and flow.count() > 20
