"""Repairs against a search that holds all edits of every state, and against all edits there are."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(role, text, kind) of sorted rows."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def after(state, role):
    """Last initial of the turns so far ('' at the start); None if the role may not follow."""
    return role[:1] if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None


def cheapest(found):
    """Cost, edits and turns; every state with its whole history."""

    def inserted(states):
        for _ in range(3):
            for s, (c, e, t) in list(states.items()):
                for role in ("user", "assistant"):
                    if (n := after(s, role)) is not None:
                        states[n] = min(states.get(n, (9**9,)), (c + 3, e + "I", t + [(role, "")]))
        return states

    states = inserted({"": (0, "", [])})
    for role, text, kind in found:
        new = {}
        for s, (c, e, t) in states.items():
            ways = [(s, (c + 4, e + "D", t))]
            if kind not in ("blank", "duplicate"):
                extra = 3 * (kind == "truncated")
                ways.append((after(s, role), (c + extra, e + "K", t + [(role, text)])))
                ways += [(after(s, r), (c + extra + 3, e + "R", t + [(r, text)])) for r in ("user", "assistant")]
            for n, way in ways:
                if n is not None:
                    new[n] = min(new.get(n, (9**9,)), way)
        states = inserted(new)
    return min(states[s] for s in ("", "a") if s in states)


def every(found):
    """The same from all scripts with at most two inserts between rows."""
    best = (9**9,)
    gaps = [()] + [tuple(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    for inserts in itertools.product(gaps, repeat=len(found) + 1):
        for edits in itertools.product("DKua", repeat=len(found)):
            cost, audit, turns = 0, "", []
            for k, gap in enumerate(inserts):
                cost, audit, turns = cost + 3 * len(gap), audit + "I" * len(gap), turns + list(gap)
                if k < len(found):
                    role, _, kind = found[k]
                    if edits[k] == "D":
                        cost, audit = cost + 4, audit + "D"
                        continue
                    if kind in ("blank", "duplicate"):
                        cost = 10**6
                    cost += 3 * (kind == "truncated") + 3 * (edits[k] != "K")
                    audit += "K" if edits[k] == "K" else "R"
                    turns.append(role[:1] if edits[k] == "K" else edits[k])
            if (cost, audit) < best and all(turns) and GOOD.fullmatch("".join(turns)):
                best = (cost, audit)
    return best


def report(rows):
    """What the operator says of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found = faults(rows)
    kinds = [k for _, _, k in found]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, left = cheapest(found)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest), left


def conversations(seed, count, most):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown", "Ünder"]
    texts = ["a.", "b?", "c", "", None, " \n", "long " * 50 + "!", "日本。", "x\x1c.", "d. \t"]
    out = []
    for c in [None, *range(count)]:
        for k in range(rnd.randrange(0, most)):
            turn = rnd.choice([k, k, k, None, 3])
            role = ("user", "assistant")[k % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            out.append((c, turn, role, rnd.choice(texts) if rnd.random() < 0.7 else f"t{k}."))
    return out


def test_search_on_all_scripts():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range((1, 12, 30, 12)[n]):
            rows = [(k, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b", "", f"{k}!"])) for k in range(n)]
            found = faults(rows)
            assert cheapest(found)[:2] == every(found)


def test_search_is_bounded_and_right():
    """Long runs of every kind; what is not final stays small where the survivors meet."""
    rnd = random.Random(4)
    for trial in range(300):
        n, kinds = rnd.randrange(1, 60), rnd.choice(["uuaa", "ua", "us", "s", "x", "uas?", "u", "a"])
        run = cr.Run()
        rows = []
        for k in range(n):
            role = {"u": "user", "a": "assistant", "s": "system"}.get(rnd.choice(kinds), "x")
            rows.append((k, role, rnd.choice(["", "a.", "b", f"{k}."]) if trial % 3 else f"{k}."))
        for (k, role, text), (_, _, kind) in zip(rows, faults(rows)):
            run.add(k, cr.Row(role, text, kind == "duplicate"))
        cost, audit, codes = run.repaired()
        want = cheapest(faults(rows))
        left = [t for code, row in zip(codes, [None, *run.rows]) for t in cr.turns_left(code, row)]
        assert (cost, audit, left) == want
    search, most = cr.Survivors(), 0
    for k in range(5000):
        search.step(cr._WAYS["ua"[k % 2], k % 7 == 0, k % 5 == 0])
        most = max(most, *(leaf[1].deep - search.root.deep for leaf in search.leaves if leaf))
    assert most < 40 and len(search.final) > 4900


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repair(spark, block):
    rows = conversations(block, 40, 14) + [(900, k, "user" if k % 2 else "assistant", f"{k % 50}.") for k in range(300)]
    columns = "conv_id long, turn long, role string, text string"
    gone = spark.createDataFrame([(901, 1, "user", "x.", True), (902, None, None, None, True)], columns + ", absent boolean")
    df = spark.createDataFrame(rows, columns).withColumn("absent", F.lit(None).cast("boolean")).unionByName(gone).withColumn("same", F.lit(1)).withColumn("c", F.lit(2)).repartition(5)
    done = cr.repair(df, absent="absent", turns=True, block=block)
    want, left = {901: report([])[0], 902: report([])[0]}, {}
    for c in {r[0] for r in rows}:
        want[c], left[c] = report([r[1:] for r in rows if r[0] == c])
    got = {r.conv_id: tuple(r)[1:] for r in done.report.collect()}
    assert got == want
    turns = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r.run, r.place)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: x for c, x in left.items() if x}
    assert cr.repair(df.limit(0), absent="absent", turns=True).report.count() == 0


def test_damage(spark):
    rows = conversations(9, 60, 9)
    got = cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fate", F.lit(1)).withColumn("absent", F.lit(1)))
    want = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want += [(c, t, "user" if fate == 4 else role, text, fate == 0)] * (2 if fate == 3 else 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
