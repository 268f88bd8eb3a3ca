"""Conversation repair against a plain table of least (cost, audit), alone, in blocks and over many tasks."""

import hashlib
import random

from pyspark.sql import functions as F

from busnet.llm import conversations

KEEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FILL = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(turns):
    """Cheapest (cost, audit) of turns (initial, fault), state by state, with up to two inserts everywhere."""

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                new = (cost + 3, audit + "I")
                best[FILL[state]] = min(best.get(FILL[state], new), new)
        return best

    best = inserted({"": (0, "")})
    for initial, fault in turns:
        after = {}
        for state, (cost, audit) in best.items():
            moves = [(state, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                moves.append((FILL[state], more + 3, "R"))
                if (state, initial) in KEEP:
                    moves.append((KEEP[state, initial], more, "K"))
            for to, spent, letter in moves:
                after[to] = min(after.get(to, (spent, audit + letter)), (spent, audit + letter))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def made(rng, n):
    return [(rng.choice("ssuuuaaat"), rng.choice([None] * 5 + ["blank", "duplicate", "truncated"])) for _ in range(n)]


def test_search_meets_in_the_middle():
    rng = random.Random(1)
    for n in [0, 1, 2] + [rng.randint(1, 14) for _ in range(400)]:
        turns = made(rng, n)
        assert conversations.repair_turns(turns) == plain(turns)


def test_blocks_equal_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        turns, blocks = made(rng, rng.randint(2, 24)), []
        at = 0
        while at < len(turns):
            size = rng.randint(1, 6)
            blocks.append(conversations.repair_block(turns[at : at + size]))
            at += size
        light = [(costs, [sorted(audits[4 * (i // 4) : 4 * (i // 4) + 4]).index(a) for i, a in enumerate(audits)]) for costs, audits in blocks]
        cost, states, inserts = conversations.repair_blocks(light)
        audit = "".join(audits[4 * s + t] for (_, audits), (s, t) in zip(blocks, states)) + "I" * inserts
        assert (cost, audit) == plain(turns)


def expected(rows):
    """Summary of one conversation's (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = plain(list(zip(initials, faults)))
    out, state, left = [], "", iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "K":
            state = KEEP[state, row[1][:1]]
            out.append(f"{row[1]}:{row[2]}")
        elif edit != "D":
            state = FILL[state]
            out.append(f"{'user' if state == 'u' else 'assistant'}:{row[2] if row else ''}")
    turns = {t for t, _, _ in rows if t is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())


def check(spark, rows, parts=8):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    df = df.withColumn("steps", F.lit(1)).withColumn("part", F.lit("x")).withColumn("n", F.lit(0))
    repaired = conversations.repair(df)
    found = {r.conv_id: tuple(r[1:]) for r in conversations.summary(repaired).collect()}
    wanted = {}
    for conv, turn, role, text in rows:
        wanted.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert found == {c: expected(sorted(r, key=order)) for c, r in wanted.items()}
    return repaired


def test_one_conversation_over_many_tasks(spark):
    """A conversation of 12,000 turns beside short ones; half of its turns say the same."""
    rng = random.Random(3)
    said = lambda i: rng.choice(["Yes.", "Yes.", f"Text {i}.", f"Cut off {i}", " \n"])
    rows = [(7, i, rng.choice(["user", "assistant"]), said(i)) for i in range(12000)]
    rows += [(100 + i // 5, i % 5, ["user", "assistant"][i % 2], said(i)) for i in range(600)]
    repaired = check(spark, rows)
    assert repaired.filter("conv_id = 7").count() > 2
    steps = conversations.rows(repaired).filter("conv_id = 7 AND role IS NOT NULL").orderBy("part", "seq", "pos").collect()
    assert [r.role for r in steps] == ["user", "assistant"] * (len(steps) // 2) and len(steps) > 1000


def test_edges(spark):
    long = "a very long turn. " * 200000
    rows = [
        (1, 0, "user", None), (1, 1, None, "Text."), (1, None, "system", "S."), (1, None, "system", "S."), (1, 3, "", "No role."),
        (2, 5, "tool", "Called."), (2, 5, "user", "Tied."), (2, 5, "user", "Tied."), (2, 9, "assistant", "End"),
        (3, None, "user", "All turns unknown?"), (None, 1, "user", "No id."), (None, 4, "assistant", "None!"),
        (4, 0, "user", long), (4, 1, "assistant", long), (4, 2, "user", long), (4, 3, "assistant", "x" * 9000000 + "."),
        (5, -4, "system", "Only a system turn."), (6, 1, "user", ""), (8, 2**62, "user", "Far."), (8, -3, "assistant", "Near?"),
        (9, 1, "user", "Space at the end. \t\n"), (9, 2, "assistant", " "),
    ]
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.summary(conversations.repair(empty)).count() == 0
    same = [(1, 1, "user", "The same.")] * 9000 + [(2, 1, "user", "Hello."), (2, 2, "assistant", "Hello.")]
    check(spark, same)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    found = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    import zlib

    wanted = []
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if lot == 4 else role or " ", "" if lot == 1 else "One Two" if lot == 2 and text else text or " ")
        wanted += [row] * {0: 0, 3: 2}.get(lot, 1)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
