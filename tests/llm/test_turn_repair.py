import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from protloom.llm import turn_repair as tr

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ENDS else ".")
        seen.add((role, text))
    return out


def by_trying(rows):
    """Cost, audit and repaired text of the best of all edits of a short conversation."""
    told, best = faults(rows), None
    for edits in itertools.product("KuaD", repeat=len(rows)):
        if any(e != "D" and f in "bd" for e, f in zip(edits, told, strict=True)):
            continue
        cost = sum(2 if e == "D" else (e != "K") + 5 * (f == "t") for e, f in zip(edits, told, strict=True))
        if best and cost > best[0]:
            continue
        for put in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            total = cost + 5 * len("".join(put))
            if best and total > best[0]:
                continue
            audit, turns = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(put[k])
                turns += [({"u": "user", "a": "assistant"}[x], "") for x in put[k]]
                if k < len(rows):
                    audit += edits[k] if edits[k] in "KD" else "R"
                    if edits[k] != "D":
                        turns.append((rows[k][0] if edits[k] == "K" else {"u": "user", "a": "assistant"}[edits[k]], rows[k][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                best = min(best, (total, audit, turns)) if best else (total, audit, turns)
    return best


def plain(rows):
    """All measures of one conversation, by a direct dynamic programme where trying takes too long."""
    told = faults(rows)
    ways = {0: (0, "", [])}
    inserted = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def put(ways):
        for _ in range(2):
            for state, (cost, audit, turns) in list(ways.items()):
                to, role = inserted[state]
                way = (cost + 5, audit + "I", [*turns, (role, "")])
                ways[to] = min(ways.get(to, way), way, key=lambda x: x[:2])
        return ways

    for (role, text), fault in zip(rows, told, strict=True):
        new = {}
        for state, (cost, audit, turns) in put(dict(ways)).items():
            options = [(state, (cost + 2, audit + "D", turns))]
            if fault not in "bd":
                more = 5 * (fault == "t")
                to, name = inserted[state]
                options.append((to, (cost + 1 + more, audit + "R", [*turns, (name, text)])))
                if (state, role[:1]) in kept:
                    options.append((kept[state, role[:1]], (cost + more, audit + "K", [*turns, (role, text)])))
            for to, way in options:
                new[to] = min(new.get(to, way), way, key=lambda x: x[:2])
        ways = new
    return min((w for s, w in put(dict(ways)).items() if s in (0, 3)), key=lambda x: x[:2])


def wanted(rows):
    """By conversation, for rows ``(conv, turn, role, text)`` that are damaged already."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        key = lambda r: hashlib.sha256(f"{' ' if conv is None else conv}:{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()  # noqa: B023, E731
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
        turns = [r[0] for r in own if r[0] is not None]
        said = [r[1:] for r in own]
        cost, audit, left = plain(said)
        told = faults(said)
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": told.count("b"), "duplicate": told.count("d"), "truncated": told.count("t"),
            "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False)), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        }
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in tr.digests(tr.applied(df, df, **kw)).collect()}


def some_conversations(n, longest, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "twice."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(c, rng.choice([t, t, None]), rng.choice(roles), rng.choice([*texts, f"number {t}.", f"other {t}.", None])) for c in range(n) for t in range(rng.randrange(1, longest))]


def test_plain_programme_finds_the_best_of_all_edits():
    rows = some_conversations(60, 5, 1)
    for c in {r[0] for r in rows}:
        said = [(r[2] or " ", r[3] or " ") for r in rows if r[0] == c]
        assert plain(said) == by_trying(said), said


@pytest.mark.parametrize("segment", [64, 3])
def test_equals_plain(spark, segment):
    rows = some_conversations(120, 14, 2)
    assert found(spark, rows, segment=segment) == wanted(rows)


def test_a_long_conversation_in_segments(spark):
    rows = [(1, t, "user" if t % 2 == 0 or t % 97 == 0 else "assistant", f"turn {t}." if t % 11 else "again.") for t in range(4000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    assert found(spark, rows, segment=5) == wanted(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "No id."), (None, None, None, None), (1, None, "system", "x" * 300_000 + "."), (1, 0, "user", "Ties."), (1, 0, "user", "Other."), (1, 0, "user", "Ties."), (1, 1, "assistant", "é ß 中文 🙂"),
        (2, None, "user", None), (2, None, "User", "\x0b\x0c\r"), (3, 5, "assistant", "<|end|>.\n"), (3, -5, "s", "Initial."),
    ]
    assert found(spark, rows) == wanted(rows)
    wide = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("part"), F.lit("x").alias("kind"), F.lit(2).alias("at"), F.lit(3).alias("cost"))
    told = {r["conv_id"]: r["audit"] for r in tr.digests(tr.applied(wide, wide)).collect()}
    assert told == {c: x["audit"] for c, x in wanted(rows).items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tr.digests(tr.applied(none, none)).collect() == []
    some = spark.createDataFrame([(7, 0, "user", "Hi.")], SCHEMA)
    (row,) = tr.digests(tr.applied(some, none)).collect()
    assert row.asDict() == {"conv_id": 7, "gaps": 0, "illegal": 0, "cost": 0, "audit": "", "blank": 0, "duplicate": 0, "truncated": 0, "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "Ho."), (2, 0, "user", "Alone.")], SCHEMA)
    turns, reports = tr.repaired(df)
    assert sorted((r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in turns.collect()) == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Ho.")]
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in reports.collect()} == {1: (3, "KDR"), 2: (2, "D")}
