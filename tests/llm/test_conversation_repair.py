"""Repaired conversations against all edits of short ones, and against whole paths of long ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import groupby

from pyspark.sql import functions as F

from pagewright.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?$")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def whole_paths(rows):
    """Cheapest and first edits, by complete strings for each state of the roles so far."""
    legal_start = lambda r: re.match(r"(s?(ua)*u?)?$", r)
    tail = lambda r: "" if not r else "s" if r == "s" else r[-1]

    def closed(paths):
        grown = True
        while grown:
            grown = False
            for cost, edits, roles in list(paths.values()):
                for x in "ua":
                    if legal_start(roles + x):
                        new = (cost + 3, edits + "I", roles + x)
                        if new[:2] < paths.get(tail(new[2]), (1 << 60,))[:2]:
                            paths[tail(new[2])] = new
                            grown = True
        return paths

    now = closed({"": (0, "", "")})
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for cost, edits, roles in now.values():
            options = [(cost + 4, edits + "D", roles)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(cost + 3 + more, edits + "R", roles + x) for x in "ua"] + [(cost + more, edits + "K", roles + role[:1])] * bool(role)
            for o in options:
                if legal_start(o[2]) and o[:2] < new.get(tail(o[2]), (1 << 60,))[:2]:
                    new[tail(o[2])] = o
        now = closed(new)
    return min(p for p in now.values() if LEGAL.match(p[2]))


def every_edit(rows, most):
    """The same by trying all edits up to a cost."""
    best, marks = (most + 1, "", ""), faults(rows)

    def go(i, cost, edits, roles):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and LEGAL.match(roles):
            best = min(best, (cost, edits, roles))
        for x in "ua":
            go(i, cost + 3, edits + "I", roles + x)
        if i < len(rows):
            go(i + 1, cost + 4, edits + "D", roles)
            if marks[i] not in ("blank", "duplicate"):
                more = 3 * (marks[i] == "truncated")
                go(i + 1, cost + more, edits + "K", roles + (rows[i][0][:1] or "-"))
                for x in "ua":
                    go(i + 1, cost + 3 + more, edits + "R", roles + x)

    go(0, 0, "", "")
    return best


def searched(rows, cuts=()):
    """The search over (initial, fault) rows, in segments that begin at ``cuts``."""
    codes = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    marks = [(role[:1], codes[f]) for (role, _), f in zip(rows, faults(rows), strict=True)]
    if not cuts:
        s = cr.Survivors()
        for m in marks:
            s.step(*m)
        return cr.cheapest(s.paths())
    parts = []
    for lo, hi in zip([0, *cuts], [*cuts, len(marks)], strict=True):
        part = {e: cr.Survivors(e) for e in ((None,) if lo == 0 and len(cuts) % 2 else range(4))}
        for m in marks[lo:hi]:
            for s in part.values():
                s.step(*m)
        parts.append({e: s.paths() for e, s in part.items()})
    pieces = cr.chained(parts)
    return sum(c for _, c, _ in pieces), "".join(e for _, _, e in pieces)


def random_rows(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", ""], ["tool", "user"], ["system", "assistant"]])
    texts = ["a.", "b!", "", " \t", "cut", "a.", f"own {rng.random()}?", f"own {rng.random()}"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"{rng.random()}.") for _ in range(n)]


def test_all_edits_of_short_conversations():
    rng = random.Random(1)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(0, 4))
        got = whole_paths(rows)
        assert every_edit(rows, got[0])[:2] == got[:2]
        assert searched(rows) == got[:2]


def test_long_conversations_in_any_segments():
    rng = random.Random(2)
    for k in range(120):
        rows = random_rows(rng, rng.choice([5, 20, 60]))
        expected = whole_paths(rows)[:2]
        assert searched(rows) == expected
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randint(1, 4)))
        assert searched(rows, cuts) == expected


def test_little_is_held():
    rng = random.Random(3)
    for rows in ([("u", 0), ("a", 0)] * 20_000, [("t", 0)] * 20_000, [("a", 1)] * 20_000, [(rng.choice("uas"), rng.choice([0, 0, 0, 1, 3])) for _ in range(20_000)]):
        s, most = cr.Survivors(), 0
        for m in rows:
            s.step(*m)
            most = max(most, s.held())
        assert most < 120 and len(cr.cheapest(s.paths())[1]) >= 20_000
    s = cr.Survivors()
    s.step("u", 0, 10**6)
    assert s.held() < 10 and len(cr.cheapest(s.paths())[1]) == 10**6 + 1


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        pairs = [r[2:] for r in own]
        marks = faults(pairs)
        turns = {r[1] for r in own if r[1] is not None}
        cost, edits, roles = whole_paths(pairs)
        lines, at, given = [], 0, iter(pairs)
        for e in edits:
            role, text = ("", "") if e == "I" else next(given)
            if e != "D":
                role = role if e == "K" else {"u": "user", "a": "assistant"}[roles[at]]
                lines.append(f"{role}:{text}")
                at += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    got = cr.damage_report(df).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def made(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        turn = 0
        for role, text in random_rows(rng, rng.choice([0, 1, 4, 9, 30])):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((c, turn if rng.random() < 0.95 else None, role if rng.random() < 0.95 else None, text if rng.random() < 0.95 else None))
    return [*rows, (None, 1, "user", "a."), (None, 2, "assistant", "b."), (900, None, "user", "x."), (900, None, "user", "x."), *[(901, 5, "user", "same.")] * 50, (902, 1, "user", "long " * 200_000 + "."), (902, 2, "assistant", "é.")]


def test_report_equal_to_whole_paths(spark):
    rows = made(5, range(150))
    assert report(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_conversations_across_segments(spark):
    """A conversation of half of all rows, dealt to many ranges."""
    rows = made(6, [*range(30), *[77] * 60])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        seen = cr.arranged(df).where("conv_id = 77").select("seg").distinct().count()
        assert seen > 2 and report(df) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert report(df) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_repaired_rows_are_legal(spark):
    rows = made(7, range(40))
    got = cr.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "seg", "nth").collect()
    for _, own in groupby(got, key=lambda r: r.conv_id):
        own = list(own)
        assert LEGAL.match("".join(r.role[:1] for r in own)) and all(r.text == "" for r in own if r.edit == "I")


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", 9, "z"), (1, 2, "assistant", "b.", 9, "z")], "conv_id int, turn int, role string, text string, pos long, edits string")
    assert report(df.limit(0)) == {}
    assert set(report(df)) == {1}
    assert cr.repair(df).select("role", F.col("text").alias("t")).count() == 2
