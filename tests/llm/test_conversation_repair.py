import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import conversation_repair as R

TURNS = "conv_id long, turn long, role string, text string, audit string, chunk long"


def brute(rows):
    """(cost, audit, repaired turns) of rows (role, text, gone, truncated): all ways, by whole audits."""
    best = {R.START: (0, "", [])}
    for role, text, gone, truncated in rows:
        new = {}
        for s, (cost, audit, told) in best.items():
            options = [(s, cost + 4, audit + "D", told)]
            state, c, a, t = s, cost, audit, told
            for _ in range(3):
                for after in R.FOLLOWS[state]:
                    if not gone and R.INITIALS.get(role[:1]) == after:
                        options.append((after, c + 3 * truncated, a + "K", [*t, (role, text)]))
                    if not gone and after != R.SYSTEM:
                        options.append((after, c + 3 + 3 * truncated, a + "R", [*t, (R.NAMES[after], text)]))
                state = R.FOLLOWS[state][-1]
                c, a, t = c + 3, a + "I", [*t, (R.NAMES[state], "")]
                options.append((None, 0, "", []))
            for after, *rest in options:
                if after is not None:
                    new[after] = min(new.get(after, (1 << 50, "", [])), tuple(rest))
        best = new
    ends = []
    for s, (cost, audit, told) in best.items():
        more = {R.SYSTEM: ["user", "assistant"], R.USER: ["assistant"]}.get(s, [])
        ends.append((cost + 3 * len(more), audit + "I" * len(more), told + [(m, "") for m in more]))
    return min(ends)


def judged(rows):
    """Rows by turn with their first faults: (role, text, gone, truncated) and the counts."""
    seen, out, counts = set(), [], [0, 0, 0]
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())):
        solid = text.strip(" \t\n\v\f\r")
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((role, text, fault in (0, 1), fault == 2))
    return out, counts


def conversations(rng, n, most):
    out = []
    for c in range(n):
        for k in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No", "Why?", "", " \t", "Long. ", f"{rng.random()}.", f"{rng.random()}!", f"{rng.random()}"])
            out.append((c if c else None, rng.choice([None, k, k, k, k // 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "superuser"]), text))
    return out


def report_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    turns, report = R.repair(df, **how)
    told = {}
    for t in sorted(turns.collect(), key=lambda t: (t["chunk"], t["at"], t["nth"])):
        told.setdefault(t["conv_id"], []).append((t["role"], t["text"]))
    return {r["conv_id"]: r for r in report.collect()}, told, turns


def check(spark, rows, **how):
    got, told, turns = report_of(spark, rows, **how)
    digests = {r["conv"]: r["repaired_sha256"] for r in R.repaired_digests(turns).collect()}
    of = {}
    for c, turn, role, text in rows:
        of.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(of)
    for c, own in of.items():
        row, (seq, counts) = got[c], judged(own)
        cost, audit, lines = brute(seq)
        assert (row["cost"], row["audit"]) == (cost, audit), (own, row)
        assert [row["blank"], row["duplicate"], row["truncated"]] == counts
        assert told.get(c, []) == lines
        known = [t for t, _, _ in own if t is not None]
        assert row["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert row["illegal"] == sum(a[0][:1] + b[0][:1] not in R.LEGAL for a, b in zip(seq, seq[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        assert digests.get("" if c is None else f"={c}", hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
    return got


def test_repairs_are_the_cheapest_and_least(spark):
    check(spark, conversations(random.Random(1), 150, 12))


@pytest.mark.parametrize("size", [1, 3])
def test_conversations_over_many_chunks(spark, size):
    """One conversation holds most rows; its chunks meet at borders chosen from their cost matrices."""
    rng = random.Random(2 + size)
    rows = [(7, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"{k}.", f"{k}", ""])) for k in range(90)]
    rows += conversations(rng, 12, 4)
    check(spark, rows, chunk=size)


def test_halves_meet_at_the_least_crossing():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 14))]
        elements = [R.ways(r[:1], g, t and not g) for r, _, g, t in rows]
        end, cost = R.last_state(elements, R.START)
        state, audit = R.START, ""
        for e, behind in zip(elements, R.states_between(elements, R.START, end), strict=True):
            audit += next(w[2] for w in e[state] if w[0] == behind)
            state = behind
        assert (cost, audit + "I" * R.MISSING[state]) == brute([(r, x, g, t and not g) for r, x, g, t in rows])[:2]
        cut = sorted(rng.sample(range(len(rows) + 1), min(2, len(rows))))
        parts = [elements[a:z] for a, z in zip([0, *cut], [*cut, len(rows)], strict=True)]
        assert R.last_state([R.summary(p) for p in parts], R.START) == (end, cost)


def test_long_conversations_and_repeated_rows(spark):
    many = [(1, 5, "user", "same.")] * 3000 + [(1, k, ("user", "assistant")[k % 2], f"{k}." * (200_000 if k == 8 else 1)) for k in range(6, 4006)]
    got, told, _ = report_of(spark, many)
    row = got[1]
    assert row["duplicate"] == 2999 and len(row["audit"]) == len(many) + row["audit"].count("I") and row["illegal"] == 3000
    assert len(told[1]) % 2 == 0 and max(len(t) for _, t in told[1]) == 400_000


def test_damage_and_empty_tables(spark):
    import zlib

    rows = [(c, t, "assistant" if t % 2 else None, f"Turn {t}. Ok?" if t % 5 else None, "", 0) for c in range(30) for t in range(6)] + [(None, None, "user", "Hi.", "", 0)]
    df = spark.createDataFrame(rows, TURNS)
    want = []
    for c, t, role, text, *_ in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        want += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    key = repr
    assert sorted((tuple(r) for r in R.damaged(df).collect()), key=key) == sorted(want, key=key)
    assert R.repaired_report(df).count() == 31
    turns, report = R.repair(df.limit(0))
    assert report.count() == turns.count() == 0 and R.repaired_report(df.limit(0)).count() == 0
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = R.repaired_report(df.limit(1).select(F.lit(gone).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "role", "text")).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
