"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from check import compare, duck
from conftest import SMALL
from pyspark.sql import functions as F

from tillscope.llm import queries, repair
from tillscope.session import fresh_path

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def cheapest(rows, faults):
    """Least cost, audit and rows over all edits, at most three inserts before a row."""
    memo = {}

    def best(i, state, inserted):
        if (i, state, inserted) not in memo:
            options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
            steps = []
            if inserted < 3:
                steps += [("I", c[0], (c, ""), 3, i, inserted + 1) for c in ("user", "assistant")]
            if i < len(rows):
                role, text = rows[i][1:]
                extra = 3 if faults[i] == "t" else 0
                steps.append(("D", None, None, 4, i + 1, 0))
                if faults[i] not in ("b", "d"):
                    steps += [("K", role[:1], (role, text), extra, i + 1, 0)]
                    steps += [("R", c[0], (c, text), extra + 3, i + 1, 0) for c in ("user", "assistant")]
            for letter, symbol, row, cost, at, n in steps:
                to = NEXT.get((state, symbol)) if symbol else state
                if to is not None:
                    more, audit, rest = best(at, to, n)
                    options.append((cost + more, letter + audit, ((row,) if row else ()) + rest))
            memo[i, state, inserted] = min(options, default=(10**9, "~", ()))
        return memo[i, state, inserted]

    return best(0, 0, 0)


def brute(rows):
    out = []
    for conv, kept in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            core = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, audit, fixed = cheapest(kept, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        counts = [faults.count(c) for c in "bdt"]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: (r[0] is not None, r))


def hostile():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["a.", "b!", "c", "", "  ", None, "x?\n", "é.", "hi", "long " * 50]
    return [(c, rng.choice([None, i, i, i, 3 * i]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(300)] for i in range(rng.randint(0, 9))]


def test_repairs_of_hostile_conversations(spark):
    rows = hostile()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit(1), "fault": F.lit("x"), "_conv": F.lit(2)})
    assert found(repair.audited(df)) == brute(rows)
    assert found(repair.audited(df.limit(0))) == []


def test_backpointers_are_spilled_and_read_back_last_first(spark):
    folder = fresh_path(spark, "spill")
    back, numbers = repair.Backpointers(folder, 100), [i * 7 % 60_000 for i in range(1234)]
    for n in numbers:
        back.append(n)
    assert len(back.files) == 12 and list(back.backwards()) == numbers[::-1]


def test_a_giant_conversation_in_chunks(spark):
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"text {rng.randrange(900)}.") for i in range(3000)] + [(8, 0, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marked = repair.marked(repair.damaged(df))
    key = lambda r: r["_conv"]
    assert sorted(repair.solved(marked, spill_rows=64).collect(), key=key) == sorted(repair.solved(marked).collect(), key=key)


def test_repaired_rows_alternate(spark):
    rows = hostile()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fixed, summary = repair.repaired(repair.damaged(df))
    by_conv = defaultdict(list)
    for r in fixed.collect():
        by_conv[r["_conv"]].append((r.pos, r.edit, r.role))
    audits = {r["_conv"]: r.audit for r in summary.collect()}
    for conv, turns in by_conv.items():
        turns.sort()
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[2][:1] for t in turns))
        assert "".join(t[1] for t in turns) == audits[conv].replace("D", "")


def test_query_against_sql_and_brute_force(spark):
    assert compare(queries.op13_repair(spark, SMALL), duck(SMALL), queries.oracle_sql()["op13_repair"]) == ""
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(queries.op13_repair(spark, SMALL)) == brute([tuple(r) for r in turns])
