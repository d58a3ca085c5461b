"""Repair of conversations: the cheapest edits that make their roles alternate, by divide and conquer over four-state cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

#: What an edit costs; a truncated row that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. For each the states that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that a conversation's end needs after each state.
MISSING = (0, 2, 1, 0)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
#: A conversation's rows are taken in chunks of so many.
CHUNK = 1 << 16
_NEVER = 1 << 60

#: One element's ways: for each state before it those (state after, cost, key), where keys order the audits of one state before.
Ways = Sequence[Sequence[tuple[int, int, object]]]


@lru_cache(None)
def ways(initial: str, gone: bool, truncated: bool) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """The ways of one row, each the cheapest between two states; the key is its audit, of equal cost the least."""
    out = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {before: (DELETE, "D")}
        state, inserted = before, 0
        while not gone and inserted <= 2:
            for after in FOLLOWS[state]:
                for cost, edit, allowed in ((KEEP, "K", INITIALS.get(initial) == after), (REROLE, "R", after != SYSTEM)):
                    if allowed:
                        new = (cost + TRUNCATED * truncated + INSERT * inserted, "I" * inserted + edit)
                        best[after] = min(best.get(after, (_NEVER, "")), new)
            state, inserted = FOLLOWS[state][-1], inserted + 1
        out.append(tuple((after, cost, key) for after, (cost, key) in sorted(best.items())))
    return tuple(out)


def forward(elements: Sequence[Ways], before: int) -> tuple[list[int], list[int]]:
    """Least costs up to each state after the elements, and the order of their least audits.

    Audits of different states right behind an element differ before the shorter one ends, so what follows doesn't change
    their order.
    """
    cost, rank = [_NEVER] * 4, [0] * 4
    cost[before] = 0
    for element in elements:
        best: list = [(_NEVER, 0, "")] * 4
        for f in range(4):
            if cost[f] < _NEVER:
                for after, c, key in element[f]:
                    if cost[f] + c < best[after][0] or cost[f] + c == best[after][0] and (rank[f], key) < best[after][1:]:
                        best[after] = (cost[f] + c, rank[f], key)
        cost = [b[0] for b in best]
        reached = sorted((b[1:], t) for t, b in enumerate(best) if b[0] < _NEVER)
        for n, (_, t) in enumerate(reached):
            rank[t] = n
    return cost, rank


def backward(elements: Sequence[Ways], cost: list[int]) -> list[int]:
    """Least costs from each state before the elements, given those behind them."""
    for element in reversed(elements):
        cost = [min((c + cost[after] for after, c, _ in own), default=_NEVER) for own in element]
    return cost


def last_state(elements: Sequence[Ways], before: int) -> tuple[int, int]:
    """The state in which the cheapest conversation ends, of equal ones that of the least audit, and its cost with the inserts behind it."""
    cost, rank = forward(elements, before)
    _, _, state = min((cost[t] + INSERT * MISSING[t], rank[t], t) for t in range(4))
    return state, cost[state] + INSERT * MISSING[state]


def states_between(elements: Sequence[Ways], before: int, after: int) -> list[int]:
    """The states behind each element of the cheapest way from ``before`` to ``after``, of equal ones that of the least audit.

    Costs from the front and from the back meet in the middle; of the states there whose sum is least that of the least
    audit is taken, and both halves are solved alike, so no table of all elements is held.
    """
    out = [after] * len(elements)
    todo = [(0, len(elements), before, after)]
    while todo:
        lo, hi, f, t = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        front, rank = forward(elements[lo:mid], f)
        back = backward(elements[mid:hi], [0 if s == t else _NEVER for s in range(4)])
        _, _, state = min((front[s] + back[s], rank[s], s) for s in range(4))
        out[mid - 1] = state
        todo += [(lo, mid, f, state), (mid, hi, state, t)]
    return out


def summary(elements: Sequence[Ways]) -> list[list[list[int]]]:
    """A chunk as one element: for each state before it [state after, cost, rank of the audit]."""
    out = []
    for f in range(4):
        cost, rank = forward(elements, f)
        out.append([[t, cost[t], rank[t]] for t in range(4) if cost[t] < _NEVER])
    return out


def edits_of(audit: str, state: int) -> tuple[list[str], str | None]:
    """One row's edits from a state on: the roles inserted before it and the role it gets (empty: its own; None: deleted)."""
    inserted, role = [], None
    for edit in audit:
        if edit in "IR":
            state = FOLLOWS[state][-1]
        if edit == "I":
            inserted.append(NAMES[state])
        elif edit != "D":
            role = NAMES[state] if edit == "R" else ""
    return inserted, role


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to rows (conv_id, turn, role, text): some are lost, emptied, cut, repeated or given to the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), h.alias("h")).filter("h <> 0")
    return hit.select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


_ROW = "struct<turn:long,role:string,digest:string,gone:boolean,truncated:boolean,n:long>"
_ROW_ARROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("gone", pa.bool_()), ("truncated", pa.bool_()), ("n", pa.int64())])
_WAYS = pa.list_(pa.list_(pa.list_(pa.int64())))
_CHUNKS = f"conv string, chunk long, rows array<{_ROW}>, ways array<array<array<long>>>, extra long, first string, last string, illegal long"


def _elements(rows: list[dict]) -> list:
    return [ways(r["role"][:1], r["gone"], r["truncated"]) for r in rows]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One task's sorted rows as chunks of conversations. Those that may go on elsewhere get a summary of their ways."""
    number, held, opened, goes_on = TaskContext.get().partitionId() << 32, [], False, False

    def chunk(conv: str, rows: list[dict], edge: bool) -> pa.RecordBatch:
        first = [r["role"][:1] for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:], strict=False)) + sum((r["n"] - 1) * (i + i not in LEGAL) for r, i in zip(rows, first, strict=True))
        told = [[conv], [number], [rows], [summary(_elements(rows)) if edge else None], [sum(r["n"] - 1 for r in rows) * DELETE], first[:1], first[-1:], [illegal]]
        kinds = (pa.string(), pa.int64(), pa.list_(_ROW_ARROW), _WAYS, pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(told, kinds, strict=True)], names=["conv", "chunk", "rows", "ways", "extra", "first", "last", "illegal"])

    conv = None
    for b in batches:
        for r in b.to_pylist():
            own = r.pop("conv")
            if held and (own != conv or len(held) >= most):
                yield chunk(conv, held, not opened or goes_on or own == conv)
                number, opened, goes_on, held = number + 1, True, own == conv, []
            conv = own
            held.append(r)
    if held:
        yield chunk(conv, held, True)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of a conversation's chunks, and the illegal pairs across them."""
    for b in batches:
        out = []
        for c in b.to_pylist():
            own = c["chunks"]
            elements = [x["ways"] for x in own]
            end, _ = last_state(elements, START)
            behind = states_between(elements, START, end)
            for k, x in enumerate(own):
                pair = own[k - 1]["last"] + x["first"] if k else LEGAL[0]
                out.append((c["conv"], x["chunk"], behind[k - 1] if k else START, behind[k], k == len(own) - 1, int(pair not in LEGAL)))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["conv", "chunk", "before", "after", "ends", "across"])


_EDIT = "struct<at:int,turn:long,role:string,digest:string,inserted:array<string>,as_role:string>"
_EDIT_ARROW = pa.struct([("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("inserted", pa.list_(pa.string())), ("as_role", pa.string())])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edits, audit and cost. A chunk without border states is a whole conversation."""
    for b in batches:
        out = []
        for c in b.to_pylist():
            elements, before, ends = _elements(c["rows"]), c["before"] or START, c["ends"] is not False
            after = last_state(elements, before)[0] if c["after"] is None else c["after"]
            audit, edits, cost, state = [], [], c["extra"], before
            for at, (r, element, behind) in enumerate(zip(c["rows"], elements, states_between(elements, before, after), strict=True)):
                _, price, own = next(w for w in element[state] if w[0] == behind)
                inserted, role = edits_of(own, state)
                state = behind
                cost += price
                audit.append(own + "D" * (r["n"] - 1))
                if inserted or role is not None:
                    edits.append({"at": at, "turn": r["turn"], "role": r["role"], "digest": r["digest"], "inserted": inserted, "as_role": role})
            if ends and MISSING[state]:
                inserted, _ = edits_of("I" * MISSING[state], state)
                audit.append("I" * len(inserted))
                cost += INSERT * len(inserted)
                edits.append({"at": len(elements), "turn": None, "role": None, "digest": None, "inserted": inserted, "as_role": None})
            out.append((c["conv"], c["chunk"], "".join(audit), cost, c["illegal"] + (c["across"] or 0), edits))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(_EDIT_ARROW))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["conv", "chunk", "audit", "cost", "illegal", "edits"])


def _conv(c: Column) -> Column:
    """A conversation's key as text, null told from every id."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(turns, report) of repaired conversations. turns: conv_id, chunk, at, nth, role, text, inserted, ordered by (chunk, at, nth) in each conversation.

    report, one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows are taken by turn
    (nulls first), ties by role, then the text's SHA-256. A row's first fault counts: blank (nothing but ASCII blanks),
    duplicate (its role and text stood earlier), truncated (its last such character ends no sentence). Edits: Keep, Rerole
    to user or assistant, Delete (blank and duplicate rows always), Insert an empty user or assistant turn. The cheapest
    edits after which role initials are an optional s, then pairs ua, are taken; of equal ones those of the ASCII-least audit.

    Null roles and texts are one blank; rows with a null id are one conversation; repeated rows are one row with a number;
    an empty table gives no rows; other columns are ignored. Texts are read where they are and meet the edits of their rows
    at the end. A conversation's rows are dealt by range in chunks of ``chunk`` at most, each a four-by-four cost matrix to the others, so
    a conversation of any length is dealt over tasks; only its audit, a character or so a row, is put together in one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    plain = rows.select(
        F.col(conv_col).alias("conv_id"), _conv(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest")
    )
    solid = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    marked = plain.select(
        "conv_id", "conv", "turn", "role", "digest",
        (solid == "").alias("blank"),
        (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    keyed = stored(marked.groupBy("conv_id", "conv", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n")))
    same = ["conv", "role", "digest"]
    firsts = stored(keyed.groupBy(*same).agg(F.max(F.col("turn").isNull()).alias("any_null"), F.min("turn").alias("least"), F.count(F.lit(1)).alias("places")))
    early = F.col("turn").isNull() | ~F.col("any_null") & (F.col("turn") == F.col("least"))
    judged = spread_join(keyed, firsts, same, "places").select(
        "conv_id", "conv", "turn", "role", "digest", "n", "blank", early.alias("early"), (F.col("blank") | ~early).alias("gone"), (~F.col("blank") & early & F.col("cut")).alias("truncated")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    light = judged.select("conv", "turn", "role", "digest", "gone", "truncated", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = stored(light.mapInArrow(partial(_chunks, most=chunk), _CHUNKS))
    several = chunks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "ways", "first", "last"))).alias("chunks")).filter(F.size("chunks") > 1)
    borders = several.mapInArrow(_borders, "conv string, chunk long, before int, after int, ends boolean, across long")
    joined = chunks.join(borders, ["conv", "chunk"], "left").select("conv", "chunk", "rows", "extra", "illegal", "before", "after", "ends", "across")
    solved = stored(joined.mapInArrow(_solved, f"conv string, chunk long, audit string, cost long, illegal long, edits array<{_EDIT}>"))

    faults = judged.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("early"), F.col("n") - 1).otherwise(F.col("n"))).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    audits = solved.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    report = faults.join(audits, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = solved.select("conv", "chunk", F.explode("edits").alias("e")).select("conv", "chunk", "e.*")
    added = edits.select("conv", "chunk", "at", F.posexplode("inserted").alias("nth", "role"), F.lit("").alias("text"), F.lit(True).alias("inserted"))
    stays = edits.filter(F.col("as_role").isNotNull()).select("conv", "chunk", "at", F.size("inserted").alias("nth"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "digest", "as_role")
    key = ["conv", "turn", "no_turn", "role", "digest"]
    texts = plain.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "digest", "text").dropDuplicates(key)
    kept = stays.join(texts, key).select("conv", "chunk", "at", "nth", F.when(F.col("as_role") == "", F.col("role")).otherwise(F.col("as_role")).alias("role"), "text", F.lit(False).alias("inserted"))
    id_type = rows.schema[conv_col].dataType
    conv_id = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(id_type)
    turns = kept.unionByName(added).select(conv_id.alias("conv_id"), "chunk", "at", "nth", "role", "text", "inserted")
    return turns, report


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's lines ``role:text``; one state is held, whatever a conversation's length."""
    conv, state, done = None, None, []
    for b in batches:
        for own, role, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            if state is None or own != conv:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(role.as_buffer())
            state.update(b":")
            state.update(text.as_buffer())
        yield _digests(done)
        done = []
    if state is not None:
        yield _digests([(conv, state.hexdigest())])


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["conv", "repaired_sha256"])


def repaired_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``repair``'s turns. A digest is sequential: a conversation's lines stream, sorted, through one task, and none is held."""
    lines = turns.select(_conv(F.col("conv_id")).alias("conv"), "role", "text", "chunk", "at", "nth")
    return lines.repartition("conv").sortWithinPartitions("conv", "chunk", "at", "nth").select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")


def repaired_report(rows: DataFrame) -> DataFrame:
    """The contract's row for each conversation of ``rows``, those included of which the damage leaves nothing."""
    turns, report = repair(damaged(rows))
    told = report.withColumn("conv", _conv(F.col("conv_id"))).drop("conv_id").join(repaired_digests(turns), "conv", "left")
    every = rows.select("conv_id").distinct().withColumn("conv", _conv(F.col("conv_id")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(told, "conv", "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
