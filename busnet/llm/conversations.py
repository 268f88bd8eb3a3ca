"""Repair of conversation structure by cheapest edits, found from both ends of the edit lattice.

A node of the lattice is (turns read, state of the role grammar `(s?(ua)+)?`); edges keep, rerole, delete or
insert a turn.  Two Dijkstra searches, from the beginning and from the accepted ends, meet; they go on until no
path of the same cost can be unsettled, so all equal-cost crossings are known, and the walk over these crossings
that always takes the least letter gives the least concatenated audit: at a node every letter has one edge, and no
cheapest path is the beginning of another.

Conversations are not gathered.  Turns are dealt by ranges of (conversation, turn), so one conversation may spread
over many tasks, and are cut into blocks of at most 4,096 turns or 8 MB.  A conversation that lies inside one
task's range and block is repaired there.  Of all others each block gives the cost of the cheapest audit from
every state to every state (inserts belong to the block of the turn after them), the same search runs over the
blocks as edges, and each block then gives the steps that were chosen.  A group of that second search holds
some 200 bytes for 4,096 turns.  Repeats are known from one row per (conversation, role, text) that is sorted in
before the first such turn, so the texts are shuffled twice: to fold equal rows, and by range.

Rows: a null role or text is one space, so the text is blank.  A null conv_id is a conversation of its own; null
turns come first.  Turns of one number go by role and text hash; fully equal rows are each a turn, all but the
first a duplicate.  A role that starts with none of the letters s, u and a, or is empty, cannot be kept.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from busnet.llm.arrow import blocks as slices
from busnet.session import keep

#: Largest block of one conversation.
TURNS, BYTES = 4096, 8 << 20

# States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FILL = (2, 2, 3, 2)
_STATES = range(4)
_ENDS = (0, 3)
_ROLE = {2: "user", 3: "assistant"}
#: What the edits cost, and a truncated turn that stays.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
_FAR = float("inf")
_NO_PATH = -1

Edge = tuple[tuple[int, int], int, str]


def search(
    start: tuple[int, int], goals: Iterable[tuple[int, int]],
    ahead: Callable[[tuple[int, int]], Iterable[Edge]], back: Callable[[tuple[int, int]], Iterable[Edge]],
) -> tuple[int, list[str], list[tuple[int, int]]] | None:
    """(cost, letters, nodes) of the cheapest path with the least letters, or None.

    `ahead` and `back` give (other node, cost, letter) of the edges out of and into a node.  Edges without cost
    lead to a greater first coordinate.
    """
    goals = set(goals)
    far: tuple[dict, dict] = ({start: 0}, dict.fromkeys(goals, 0))
    heaps = ([(0, start)], [(0, g) for g in sorted(goals)])
    done: tuple[set, set] = (set(), set())
    best = 0 if start in goals else _FAR
    # ends at the first sum of both heaps that no path of the least cost can have
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        at, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side].add(node)
        mine, other = far[side], far[1 - side]
        for next_node, cost, _ in (back if side else ahead)(node):
            reached = at + cost
            if reached < mine.get(next_node, _FAR):
                mine[next_node] = reached
                heapq.heappush(heaps[side], (reached, next_node))
                if next_node in other:
                    best = min(best, reached + other[next_node])
    if best == _FAR:
        return None
    forth, rest = far
    first, last = done[0] | {start}, done[1] | goals

    # nodes before the crossings that lie on a cheapest path
    useful = {
        v for v in first
        if v in last and forth[v] + rest[v] == best
        or any(w in last and forth[v] + c + rest[w] == best for w, c, _ in ahead(v))
    }
    todo = list(useful)
    while todo:
        v = todo.pop()
        for u, c, _ in back(v):
            if u in first and u not in useful and forth[u] + c == forth[v]:
                useful.add(u)
                todo.append(u)

    letters, nodes, spent, node = [], [start], 0, start
    while spent < best or node not in goals:
        letter, cost, node = min(
            (letter, c, w) for w, c, letter in ahead(node)
            if w in useful and forth[w] == spent + c or w in last and spent + c + rest[w] == best
        )
        spent += cost
        letters.append(letter)
        nodes.append(node)
    return best, letters, nodes


def _turn_edges(turns: list[tuple[str, str | None]], inserts_at_end: bool):
    """`ahead` and `back` of the lattice over turns (role initial, fault)."""
    n = len(turns)

    def ahead(node):
        i, state = node
        if i < n or inserts_at_end:
            yield (i, _FILL[state]), INSERT, "I"
        if i < n:
            initial, fault = turns[i]
            yield (i + 1, state), DELETE, "D"
            if fault not in ("blank", "duplicate"):
                more = CUT_OFF if fault else 0
                yield (i + 1, _FILL[state]), REROLE + more, "R"
                if (state, initial) in _KEEP:
                    yield (i + 1, _KEEP[state, initial]), more, "K"

    def back(node):
        i, state = node
        if i < n or inserts_at_end:
            for before in _STATES:
                if _FILL[before] == state:
                    yield (i, before), INSERT, "I"
        if i:
            initial, fault = turns[i - 1]
            yield (i - 1, state), DELETE, "D"
            if fault not in ("blank", "duplicate"):
                more = CUT_OFF if fault else 0
                for before in _STATES:
                    if _FILL[before] == state:
                        yield (i - 1, before), REROLE + more, "R"
                    if _KEEP.get((before, initial)) == state:
                        yield (i - 1, before), more, "K"

    return ahead, back


def repair_turns(turns: list[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    ahead, back = _turn_edges(turns, True)
    cost, letters, _ = search((0, 0), [(len(turns), s) for s in _ENDS], ahead, back)
    return cost, "".join(letters)


def repair_block(turns: list[tuple[str, str | None]]) -> tuple[list[int], list[str]]:
    """Cost and audit from each state to each state, 16 of each; a cost of -1 says there is no path."""
    ahead, back = _turn_edges(turns, False)
    costs, audits = [], []
    for s, t in itertools.product(_STATES, _STATES):
        found = search((0, s), [(len(turns), t)], ahead, back)
        costs.append(found[0] if found else _NO_PATH)
        audits.append("".join(found[1]) if found else "")
    return costs, audits


def repair_blocks(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """(cost, states before and after each block, inserts after the last) of a conversation in blocks.

    A block is its 16 costs and, for each state before it, the places of the audits in ASCII order.
    """
    n = len(blocks)

    def ahead(node):
        i, s = node
        if i == n:
            yield (n, _FILL[s]), INSERT, "I"
        else:
            costs, places = blocks[i]
            for t in _STATES:
                if costs[4 * s + t] != _NO_PATH:
                    yield (i + 1, t), costs[4 * s + t], str(places[4 * s + t])

    def back(node):
        i, t = node
        if i == n:
            for s in _STATES:
                if _FILL[s] == t:
                    yield (n, s), INSERT, "I"
        if i:
            costs, places = blocks[i - 1]
            for s in _STATES:
                if costs[4 * s + t] != _NO_PATH:
                    yield (i - 1, s), costs[4 * s + t], str(places[4 * s + t])

    cost, _, nodes = search((0, 0), [(n, s) for s in _ENDS], ahead, back)
    states = [s for _, s in nodes]
    return cost, list(zip(states[:n], states[1 : n + 1])), len(states) - n - 1


_STEP = T.StructType([T.StructField(n, t) for n, t in (
    ("edit", T.StringType()), ("fault", T.StringType()), ("turn", T.LongType()), ("was", T.StringType()),
    ("role", T.StringType()), ("text", T.StringType()),
)])
_ARROW_STEP = pa.struct([
    ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()),
])
_ARROW_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
#: Counts of a block; turns are its distinct numbers.
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_EDGES = ["first_turn", "last_turn", "first_role", "last_role"]


def _steps(turns: list[dict], audit: str, state: int) -> list[dict]:
    out, rows = [], iter(turns)
    for edit in audit:
        row = None if edit == "I" else next(rows)
        role = text = None
        if edit == "K":
            role, text = row["role"], row["text"]
            state = _KEEP[state, role[:1]]
        elif edit != "D":
            state = _FILL[state]
            role, text = _ROLE[state], row["text"] if row else ""
        out.append({
            "edit": edit, "fault": row and row["fault"], "turn": row and row["turn"], "was": row and row["role"], "role": role, "text": text,
        })
    return out


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _facts(turns: list[dict]) -> dict:
    faults, initials = [t["fault"] for t in turns], [t["role"][:1] for t in turns]
    return {
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(not _legal(a, b) for a, b in itertools.pairwise(initials)),
        "turns": len({t["turn"] for t in turns if t["turn"] is not None}),
        "first_turn": turns[0]["turn"], "last_turn": turns[-1]["turn"],
        "least": min((t["turn"] for t in turns if t["turn"] is not None), default=None),
        "greatest": turns[-1]["turn"], "first_role": initials[0], "last_role": initials[-1],
    }


def _fault(text: Column) -> Column:
    """Fault of a text that is no repeat; the last character that is no white space decides."""
    # white space at the end is cut by trimming, not by a pattern, so that a long run of it costs one pass
    shown = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(shown == "", F.lit("blank")).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), F.lit("truncated"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, with the marks of first turns among them -> blocks."""
    part, seq, started = TaskContext.get().partitionId(), 0, False
    turns: list[dict] = []
    size, cut, conv, at_edge, mark = 0, False, None, True, None
    ready: list[dict] = []
    ready_size = 0

    def block(whole: bool) -> None:
        nonlocal seq, turns, size, ready_size
        seen = [(t["role"][:1], t["fault"]) for t in turns]
        row = dict.fromkeys(("cost", "steps", "open", "costs", "audits")) | {"conv_id": conv, "part": part, "seq": seq, "whole": whole}
        if whole:
            row["cost"], audit = repair_turns(seen)
            row["steps"] = _steps(turns, audit, 0)
        else:
            row["open"] = turns
            row["costs"], row["audits"] = repair_block(seen)
        ready.append(row | _facts(turns))
        seq, turns, ready_size, size = seq + 1, [], ready_size + size, 0

    def batch() -> pa.RecordBatch:
        nonlocal ready, ready_size
        made, ready, ready_size = _record(ready, id_type), [], 0
        return made

    for some in (s for b in batches for s in slices(b)):
        id_type = some.schema.field("conv_id").type
        for row in some.to_pylist():
            if not started or row["conv_id"] != conv:
                if turns:
                    block(whole=not cut and not at_edge)
                # the first conversation of a range may have begun in the range before
                at_edge, started = not started, True
                conv, cut, mark = row["conv_id"], False, None
            key = (row["turn"], row["role"], row["hash"])
            if row["n"] is None:
                mark = key
                continue
            for i in range(row["n"]):
                fault = row["fault"]
                if fault != "blank" and (i or key != mark):
                    fault = "duplicate"
                if turns and (len(turns) == TURNS or size + len(row["text"]) > BYTES):
                    cut = True
                    block(whole=False)
                turns.append({"turn": row["turn"], "role": row["role"], "text": row["text"], "fault": fault})
                size += len(row["text"])
                if ready_size > BYTES or len(ready) >= 1024:
                    yield batch()
    if turns:  # the last one may go on in the next range
        block(whole=False)
    if ready:
        yield batch()


def _record(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    fields = _arrow_fields(id_type)
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])


def _arrow_fields(id_type: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [
        ("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("cost", pa.int64()),
        ("steps", pa.list_(_ARROW_STEP)), ("open", pa.list_(_ARROW_TURN)), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
        *[(n, pa.int64()) for n in _COUNTS], *[(n, pa.int64()) for n in ("first_turn", "last_turn", "least", "greatest")],
        *[(n, pa.string()) for n in ("first_role", "last_role")],
    ]


def _schema(id_type: T.DataType) -> T.StructType:
    turn = T.StructType([T.StructField(n, t) for n, t in (("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("fault", T.StringType()))])
    columns = [
        ("conv_id", id_type), ("part", T.IntegerType()), ("seq", T.LongType()), ("whole", T.BooleanType()), ("cost", T.LongType()),
        ("steps", T.ArrayType(_STEP)), ("open", T.ArrayType(turn)), ("costs", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType())),
        *[(n, T.LongType()) for n in _COUNTS], *[(n, T.LongType()) for n in ("first_turn", "last_turn", "least", "greatest")],
        *[(n, T.StringType()) for n in ("first_role", "last_role")],
    ]
    return T.StructType([T.StructField(n, t) for n, t in columns])


def _choose(group: pa.Table) -> pa.Table:
    """The states between the blocks of one conversation."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost, states, inserts = repair_blocks([(r["costs"], r["places"]) for r in rows])
    last = len(rows) - 1
    return pa.table({
        "part": pa.array([r["part"] for r in rows], pa.int32()), "seq": pa.array([r["seq"] for r in rows], pa.int64()),
        "state": pa.array([s for s, _ in states], pa.int32()), "next_state": pa.array([t for _, t in states], pa.int32()),
        "inserts": pa.array([inserts if i == last else 0 for i in range(len(rows))], pa.int32()),
    })


def _chosen_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # one block at a time
            row = batch.slice(at, 1).to_pylist()[0]
            place = 4 * row["state"] + row["next_state"]
            row["steps"] = _steps(row["open"], row["audits"][place] + "I" * row["inserts"], row["state"])
            row["cost"] = row["costs"][place] + INSERT * row["inserts"]
            row["open"] = row["costs"] = row["audits"] = None
            yield _record([row], batch.schema.field("conv_id").type)


def repair(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> the steps of the repair, in blocks.

    One row per block: conv_id, its place (part, seq) among the blocks of the conversation, whole (it is all of the
    conversation), the cost of its steps and steps: edit, fault, turn, the role it was, and role and text after the
    repair (null if deleted).  The other columns count what `summary` adds up.
    """
    id_type = turns.schema["conv_id"].dataType
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    digest = F.unhex(F.sha2("text", 256)).alias("hash")
    folded = clean.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select(
        "conv_id", "turn", "role", digest, "text", "n", _fault(F.col("text")).alias("fault")
    )
    # one mark before the first turn with each role and text; a null turn is the first
    firsts = clean.select("conv_id", "turn", "role", digest).groupBy("conv_id", "role", "hash").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none")
    )
    marks = firsts.select(
        "conv_id", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", "hash",
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("fault"),
    )
    order = ["conv_id", "turn", "role", "hash"]
    dealt = folded.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, F.col("n").asc_nulls_first())
    made = keep(dealt.mapInArrow(_blocks, _schema(id_type)), "conversation-blocks")

    several = made.filter(~F.col("whole"))
    # place of each audit among those with the same state before it
    def places(audits: Column) -> Column:
        return F.transform(audits, lambda a: (F.array_position(F.array_sort(audits), a) - 1).cast("int"))

    order_of_audits = F.flatten(F.array(*[places(F.slice("audits", 4 * s + 1, 4)) for s in _STATES]))
    chosen = several.select("conv_id", "part", "seq", "costs", order_of_audits.alias("places")).groupBy("conv_id").applyInArrow(
        _choose, "part int, seq long, state int, next_state int, inserts int"
    )
    solved = several.join(chosen, ["part", "seq"]).mapInArrow(_chosen_steps, _schema(id_type))
    return made.filter("whole").unionByName(solved).drop("open", "costs", "audits")


def _repaired_text(step: Column) -> Column:
    return F.concat(step["role"], F.lit(":"), step["text"])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order -> one row per conversation; the digest is fed block by block."""
    now, conv, started = None, None, False

    def finished() -> pa.RecordBatch:
        out = {n: now[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")}
        out["gaps"] = now["greatest"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
        out["audit"], out["repaired_sha256"] = "".join(now["audit"]), now["digest"].hexdigest()
        arrays = [pa.array([conv], id_type)] + [
            pa.array([out[n]], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in SUMMARY
        ]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *SUMMARY])

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if not started or row["conv_id"] != conv:
                if started:
                    yield finished()
                conv, started = row["conv_id"], True
                now = dict.fromkeys([*_COUNTS, "cost"], 0) | {
                    "least": None, "greatest": None, "last_turn": None, "last_role": None, "audit": [], "digest": hashlib.sha256(), "fed": False,
                }
            for name in (*_COUNTS, "cost"):
                now[name] += row[name]
            if now["last_role"] is not None:
                now["illegal"] += not _legal(now["last_role"], row["first_role"])
            if row["first_turn"] is not None and row["first_turn"] == now["last_turn"]:
                now["turns"] -= 1
            for name, pick in (("least", min), ("greatest", max)):
                if row[name] is not None:
                    now[name] = row[name] if now[name] is None else pick(now[name], row[name])
            now["last_turn"], now["last_role"] = row["last_turn"], row["last_role"]
            now["audit"].append("".join(s["edit"] for s in row["steps"]))
            for step in row["steps"]:
                if step["role"] is not None:
                    now["digest"].update(f"{chr(10) if now['fed'] else ''}{step['role']}:{step['text']}".encode())
                    now["fed"] = True
    if started:
        yield finished()


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def summary(repaired: DataFrame) -> DataFrame:
    """`repair`'s blocks -> one row per conversation: conv_id, gaps, faults, illegal, cost, audit, repaired_sha256.

    A conversation in one block needs no shuffle.  The blocks of a longer one stream through one task in order, as
    a sequential digest of all its text demands; that task holds one block and the audit.
    """
    stays = F.filter("steps", lambda s: s["role"].isNotNull())
    whole = repaired.filter("whole").select(
        "conv_id",
        F.when(F.col("turns") > 0, F.col("greatest") - F.col("least") + 1 - F.col("turns")).otherwise(0).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("steps", lambda s: s["edit"]), "").alias("audit"),
        F.sha2(F.array_join(F.transform(stays, _repaired_text), "\n"), 256).alias("repaired_sha256"),
    )
    blocks = repaired.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(blocks.mapInArrow(_conversations, whole.schema))


def rows(repaired: DataFrame) -> DataFrame:
    """The repaired turns in row form: conv_id, part, seq, pos (their order), edit, fault, turn, was, role, text."""
    return repaired.select("conv_id", "part", "seq", F.posexplode("steps").alias("pos", "s")).select("conv_id", "part", "seq", "pos", "s.*")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults of the contract put in by the checksum of `conv_id:turn`; nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    lot = F.crc32(name) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.filter(lot != 0).select(
        "conv_id", "turn", F.when(lot == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
