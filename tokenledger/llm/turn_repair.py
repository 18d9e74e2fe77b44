"""Conversation structure repair by a rank-compressed dynamic program over ordered, prefix-free edit codes.

A conversation becomes `(s?(ua)+)?` by keeping, reroling and deleting turns and by inserting empty ones. One layer of
the program takes a run of insertions and the edit of one turn as one macro edit. Its code, `I` so many times and then
`D`, `K` or `R`, is no prefix of another code, so the audits of a layer compare as (rank of the audit before, code),
and a state needs its cost, its rank in the layer and a pointer to its parent instead of an audit string. Audits are
read off the pointers afterwards.

Layers compose like matrices over (cost, rank). Turns are therefore numbered over the whole table and cut into chunks
of CHUNK turns, whatever conversations they belong to; a conversation that spans chunks is solved for all four
states at each cut, the cuts are chosen over those small tables, and its chunks then read off their own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import SPACES, salted_join, ship, stored

#: Turns of a chunk.
CHUNK = 2048
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, and what a truncated turn adds if it stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Codes of macro edits in ASCII order; two insertions reach any state.
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
#: The state and the line that an insertion gives, and the insertions that end in an accepted state.
NEXT = (USER, USER, ASSISTANT, USER)
LINES = {USER: "user:", ASSISTANT: "assistant:"}
TAIL = (0, 2, 1, 0)
FAR = 1 << 40


def _macros() -> tuple[np.ndarray, np.ndarray]:
    """(cost, code) of the best macro edit by class of turn, state before and state after; class = 2 * initial + truncated, 8: must go."""
    cost, code = np.full((9, 4, 4), FAR, np.int64), np.full((9, 4, 4), 15, np.int64)
    for c in range(9):
        initial, extra = c >> 1, CUT * (c & 1)
        for before in range(4):
            at = before
            for k in range(3):
                edits = [(DELETE, "D", at)]
                if c < 8:
                    edits.append((REROLE + extra, "R", NEXT[at]))
                    if initial == 0 and at == EMPTY:
                        edits.append((KEEP + extra, "K", SYSTEM))
                    elif initial in (1, 2) and NEXT[at] == (USER, ASSISTANT)[initial - 1]:
                        edits.append((KEEP + extra, "K", NEXT[at]))
                for price, letter, after in edits:
                    own = (INSERT * k + price, CODES.index("I" * k + letter))
                    if own < (cost[c, before, after], code[c, before, after]):
                        cost[c, before, after], code[c, before, after] = own
                at = NEXT[at]
    return cost, code


COST, CODE = _macros()


def _ranks(cost: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the states' audits among those of the layer: by rank of the parent, then code; states out of reach come last."""
    return np.where(cost >= FAR, 255, keys & 255).argsort(-1, kind="stable").argsort(-1, kind="stable")


def layers(classes: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(costs, ranks, parent pointers per layer, order of lanes), one lane for each stretch of classes and state before it.

    Lanes are handled longest first; layer t of the pointers holds `state << 4 | code` for those that reach it.
    """
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    cost, rank, back = np.full((len(order), 4), FAR, np.int64), np.zeros((len(order), 4), np.int64), []
    cost[np.arange(len(order)), state[order]] = 0
    open_ = len(order)
    for t in range(int(length[0]) if open_ else 0):
        open_ = int(np.searchsorted(-length, -t, side="left"))
        c = classes[begin[:open_] + t]
        keys = (np.minimum(cost[:open_, :, None] + COST[c], FAR) << 8) | (rank[:open_, :, None] << 4) | CODE[c]
        parent = keys.argmin(1)
        best = np.take_along_axis(keys, parent[:, None], 1)[:, 0]
        back.append((parent << 4 | best & 15).astype(np.uint8))
        cost[:open_] = best >> 8
        rank[:open_] = _ranks(cost[:open_], best)
    return cost, rank, back, order


def read_off(back: list[np.ndarray], order: np.ndarray, length: np.ndarray, begin: np.ndarray, end: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(state before, code) of each of `total` turns, from the pointers of lanes that end in states `end` (negative: leave out)."""
    before, code = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    state, length, begin = end[order].copy(), length[order], begin[order]
    for t in range(len(back) - 1, -1, -1):
        own = np.flatnonzero((length[: len(back[t])] > t) & (state[: len(back[t])] >= 0))
        step = back[t][own, state[own]]
        before[begin[own] + t], code[begin[own] + t] = step >> 4, step & 15
        state[own] = step >> 4
    return before, code


def last_state(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, whole cost) of the cheapest end of each lane, closing insertions included; ties by rank."""
    keys = (cost + INSERT * np.array(TAIL)) << 8 | rank
    return keys.argmin(1), keys.min(1) >> 8


def _numbers(x: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, null being one of them."""
    return x.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def _heads(before: int, code: int) -> tuple[str | None, str | None, str]:
    """(lines inserted before the turn, role it gets, letters); the role is empty if the turn keeps its own, null if it goes."""
    letters, lines, at = CODES[code], [], before
    for _ in range(len(letters) - 1):
        at = NEXT[at]
        lines.append(LINES[at])
    role = {"D": None, "K": "", "R": LINES[NEXT[at]][:-1]}[letters[-1]]
    return "\n".join(lines) or None, role, letters


_HEADS = [[_heads(q, c) for c in range(len(CODES))] for q in range(4)]
_EDITS = "pos long, head string, role_to string, tail string, letters string"
_PARTS = "conv {kind}, at long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, cost long, matrix binary, pointers binary"


def _edits(pos: np.ndarray, before: np.ndarray, code: np.ndarray, tail: np.ndarray) -> dict[str, pa.Array]:
    """Edits of turns at `pos`; tail: the state in which a conversation ends at the turn (one that needs no insertion elsewhere)."""
    rows = [_HEADS[q][c] for q, c in zip(before.tolist(), code.tolist(), strict=True)]
    closing, letters = [None, "user:\nassistant:", "assistant:", None], ["", "II", "I", ""]
    out = {"head": [r[0] for r in rows], "role_to": [r[1] for r in rows], "tail": [closing[t] for t in tail.tolist()], "letters": [r[2] + letters[t] for r, t in zip(rows, tail.tolist(), strict=True)]}
    return {"pos": pa.array(pos, pa.int64()), **{k: pa.array(v, pa.string()) for k, v in out.items()}}


def _solve(table: pa.Table, notes: pa.Table) -> dict[str, pa.Array]:
    """Rows of a chunk: one per part of a conversation, and the edits of turns in conversations that lie in it as a whole.

    Notes say which turns are duplicates (kind 0), and what precedes (1) and follows (2) the chunk.
    """
    table = table.sort_by("pos")
    n, base = table.num_rows, table.column("pos")[0].as_py()
    kind, at = notes.column("kind").to_numpy(), notes.column("at").to_numpy()
    late = np.zeros(n, bool)
    late[at[kind == 0] - base] = True
    name = _numbers(pa.chunked_array([*table.column("conv").chunks, *notes.column("conv").chunks], table.schema.field("conv").type))
    heads = np.flatnonzero(np.append(True, name[1:n] != name[: n - 1]))
    length, parts = np.diff(np.append(heads, n)), len(heads)
    prior, following = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    front = len(prior) > 0 and name[n + prior[0]] == name[0]
    whole = np.ones(parts, bool)
    whole[0] &= not front
    whole[-1] &= not (len(following) > 0 and name[n + following[0]] == name[n - 1])
    initial = table.column("initial").to_numpy().astype(np.int64)
    blank, cut = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "cut"))
    late &= ~blank
    cut = cut & ~blank & ~late
    classes = np.where(blank | late, 8, 2 * initial + cut)
    # lanes: whole conversations from the empty state, parts of others from all four
    own, others = np.flatnonzero(whole), np.flatnonzero(~whole)
    lane, state = np.concatenate([own, np.repeat(others, 4)]), np.concatenate([np.zeros(len(own), np.int64), np.tile(np.arange(4), len(others))])
    cost, rank, back, order = layers(classes, heads[lane], length[lane], state)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    end, price = last_state(cost[place], rank[place])
    end[len(own) :] = -1
    before, code = read_off(back, order, length[lane], heads[lane], end, n)
    tail = np.zeros(n, np.int64)
    tail[(heads + length - 1)[own]] = end[: len(own)]
    done = np.flatnonzero(code >= 0)
    prices, matrices, pointers = np.zeros(parts, np.int64), [None] * parts, [None] * parts
    prices[own] = price[: len(own)]
    for i, part in enumerate(others.tolist()):
        four = place[len(own) + 4 * i : len(own) + 4 * i + 4]
        matrices[part] = np.stack([cost[four], rank[four]]).tobytes()
        pointers[part] = np.stack([back[t][four] for t in range(length[part])]).tobytes()
    # what precedes each turn: in the chunk before, for its first one; nothing, for the first of a conversation
    turn, first = table.column("turn").combine_chunks(), np.zeros(n, bool)
    first[heads] = True
    first[0] &= not front
    beyond = notes.slice(prior[0], 1) if front else None
    initials = np.append(beyond.column("initial").to_numpy() if front else -1, initial[:-1]).astype(np.int64)
    turns = pa.concat_arrays([beyond.column("turn").combine_chunks() if front else pa.nulls(1, pa.int64()), turn.slice(0, n - 1)])
    legal = ((initials == 0) & (initial == 1)) | ((initials == 1) & (initial == 2)) | ((initials == 2) & (initial == 1))
    other = pc.fill_null(pc.not_equal(turn, turns), True).to_numpy(zero_copy_only=False)
    new = turn.is_valid().to_numpy(zero_copy_only=False) & (first | other)
    add = lambda v: pa.array(np.add.reduceat(v.astype(np.int64), heads))
    known = [turn.slice(a, m).drop_null() for a, m in zip(heads.tolist(), length.tolist(), strict=True)]
    out = {
        "conv": table.column("conv").combine_chunks().take(pa.array(heads)), "at": pa.array(base + heads), "blank": add(blank), "duplicate": add(late), "truncated": add(cut), "illegal": add(~first & ~legal), "turns": add(new),
        "low": pa.array([x[0].as_py() if len(x) else None for x in known], pa.int64()), "high": pa.array([x[-1].as_py() if len(x) else None for x in known], pa.int64()),
        "cost": pa.array(prices, pa.int64(), mask=~whole), "matrix": pa.array(matrices, pa.binary()), "pointers": pa.array(pointers, pa.binary()),
    }
    edits = _edits(base + done, before[done], code[done], tail[done])
    out = {k: pa.concat_arrays([v, pa.nulls(len(done), v.type)]) for k, v in out.items()}
    return {**out, **{k: pa.concat_arrays([pa.nulls(parts, v.type), v]) for k, v in edits.items()}}


def _choose(table: pa.Table) -> pa.Table:
    """States before and after each part of one conversation: rows (conv, at, start, end, last, cost)."""
    table = table.sort_by("at")
    cost, rank, back = np.array([0, FAR, FAR, FAR]), np.zeros(4, np.int64), []
    for m in table.column("matrix"):
        price, order = np.frombuffer(m.as_buffer(), np.int64).reshape(2, 4, 4)
        keys = np.minimum(cost[:, None] + price, FAR) << 8 | rank[:, None] << 4 | order
        parent = keys.argmin(0)
        best = keys[parent, np.arange(4)]
        back.append(parent.astype(np.uint8))
        cost = best >> 8
        rank = _ranks(cost, best)
    state, whole = (int(x[0]) for x in last_state(cost[None], rank[None]))
    n = table.num_rows
    states = np.zeros(n + 1, np.int32)
    states[n] = state
    for i in range(n - 1, -1, -1):
        states[i] = back[i][states[i + 1]]
    return pa.table({"conv": table.column("conv"), "at": table.column("at"), "start": states[:-1], "end": states[1:], "last": np.arange(n) == n - 1, "cost": np.full(n, whole, np.int64)})


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the turns of parts, from their pointers and the states at their ends."""
    for batch in batches:
        for r in batch.to_pylist():
            steps = np.frombuffer(r["pointers"], np.uint8).reshape(-1, 4, 4)[:, r["start"]].tolist()
            state, found = r["end"], []
            for step in reversed(steps):
                found.append(step[state])
                state = found[-1] >> 4
            found = np.array(found[::-1], np.int64)
            tail = np.zeros(len(found), np.int64)
            tail[-1] = r["end"] if r["last"] else 0
            edits = _edits(r["at"] + np.arange(len(found)), found >> 4, found & 15, tail)
            yield pa.RecordBatch.from_arrays(list(edits.values()), list(edits))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit, repaired_sha256) from turns in order; a conversation may go on over many batches."""
    held, sha, audit, some = None, None, [], False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held, pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv", "audit", "repaired_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv")
        name = conv.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        lines, letters = batch.column("lines").to_pylist(), batch.column("letters").to_pylist()
        for a, b in zip(heads.tolist(), np.append(heads[1:], batch.num_rows).tolist(), strict=True):
            if held is None or held[0] != conv[a] and (held[0].is_valid or conv[a].is_valid):
                if held is not None:
                    yield done()
                held, sha, audit, some = pa.concat_arrays([conv.slice(a, 1)]), hashlib.sha256(), [], False
            audit.append("".join(letters[a:b]))
            own = [x for x in lines[a:b] if x is not None]
            if own:
                sha.update((("\n" if some else "") + "\n".join(own)).encode())
                some = True
    if held is not None:
        yield done()


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their places in the order of conversations and turns, over the whole table."""
    body, name = F.coalesce(rows[text].cast("string"), F.lit(" ")), F.coalesce(rows[role].cast("string"), F.lit(" "))
    base = rows.select(rows[conv].alias("conv"), rows[turn].cast("long").alias("turn"), name.alias("role"), body.alias("text"))
    inner = F.btrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    base = base.withColumns({
        "initial": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3),
        "blank": inner == "",
        "cut": ~F.right(inner, F.lit(1)).isin(".", "!", "?"),
        "same": F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit("\0"), "role", F.lit("\0"), "text")),
        "row": F.monotonically_increasing_id(),
    })
    # a conversation of very many turns spreads over ranges, and so do rows that equal each other
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("same"), F.col("row")]
    placed = base.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("id", F.monotonically_increasing_id())
    placed = stored(placed, "turns").withColumn("part", F.shiftright("id", 33))
    bases, n = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        bases.append((r.part, n - (r.part << 33)))
        n += r.n
    frame = F.broadcast(rows.sparkSession.createDataFrame(bases, "part long, base long"))  # one row a range
    return placed.join(frame, "part").withColumn("pos", F.col("id") + F.col("base")).drop("part", "base", "id")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of a table of turns.

    conversations: one row for each conversation that has a turn (a null one too): conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. turns: one row for each turn: conv, pos (its place in the whole
    table), letters (its edits), lines (the repaired `role:text` lines that it gives, null if none).

    Turns are taken by turn, null first, ties by role, then by a digest of the text. A null role or text counts as one
    space. The first fault of a turn counts: blank (no character but white space), duplicate (role and text were seen
    earlier in the conversation; rows that repeat a turn are such), truncated (the last such character is none of
    `.!?`). Blank and duplicate turns are deleted; edits cost KEEP, REROLE, DELETE, INSERT, and a truncated turn that
    stays adds CUT. Of the cheapest sequences that end in `(s?(ua)+)?`, by role initials, the ASCII-least is taken.
    gaps: turn numbers missing between the least and the greatest, null ones ignored. Texts are handled whole and never
    enter the program, which sees one class a turn. An empty table gives no rows; other columns are ignored, whatever
    their names.

    No task holds a conversation: turns are numbered by ranges, duplicates meet by digest with often ones dealt by
    salt, the program runs on chunks, and audit and digest are gathered in a stream. The tables of one conversation's
    chunks (280 bytes a chunk of 2,048 turns) are one group.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[conv].dataType.simpleString()
    every = stored(_ordered(rows, conv, turn, role, text), "places")
    seen = every.groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    late = salted_join(every.select("pos", "same"), seen, "same", "n", ["pos"]).where("pos > first").select("pos")
    of = F.floor(F.col("pos") / CHUNK).cast("long")
    edge = every.select("pos", "conv", "turn", "initial")
    absent = [F.lit(None).cast(t).alias(c) for c, t in (("conv", kind), ("turn", "long"), ("initial", "int"))]
    notes = late.select(of.alias("chunk"), F.lit(0).alias("kind"), F.col("pos").alias("at"), *absent)
    for which, place, shift in ((1, CHUNK - 1, 1), (2, 0, -1)):
        notes = notes.unionByName(edge.where(F.col("pos") % CHUNK == place).select((of + shift).alias("chunk"), F.lit(which).alias("kind"), F.col("pos").alias("at"), "conv", "turn", "initial"))
    slim = every.select(of.alias("chunk"), "pos", "conv", "turn", "initial", "blank", "cut")
    shape = to_arrow_schema(StructType.fromDDL(_PARTS.format(kind=kind) + ", " + _EDITS))
    names = shape.names

    def solve(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:  # a note for a chunk before the first or after the last
            return shape.empty_table()
        out = _solve(table, given)
        return pa.table([out[c] for c in names], names)

    solved = stored(slim.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(solve, _PARTS.format(kind=kind) + ", " + _EDITS), "solved")
    parts = solved.where("letters IS NULL").select(*names[:12])
    cut = parts.where("matrix IS NOT NULL")
    chosen = stored(cut.select("conv", "at", "matrix").groupBy("conv").applyInArrow(_choose, f"conv {kind}, at long, start int, end int, last boolean, cost long"), "chosen")
    rest = chosen.select("at", "start", "end", "last").join(cut.select("at", "pointers"), "at").mapInArrow(_follow, _EDITS)
    edits = solved.where("letters IS NOT NULL").select(*names[12:]).unionByName(rest)
    own = F.when(F.col("role_to").isNotNull(), F.concat(F.when(F.col("role_to") == "", F.col("role")).otherwise(F.col("role_to")), F.lit(":"), "text"))
    some = F.coalesce("head", "role_to", "tail").isNotNull()
    turns = every.select("pos", "conv", "role", "text").join(edits, "pos").select("conv", "pos", "letters", F.when(some, F.concat_ws("\n", "head", own, "tail")).alias("lines"))
    told = turns.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_digests, f"conv {kind}, audit string, repaired_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    facts = parts.unionByName(chosen.where("last").select("conv", "cost"), allowMissingColumns=True)
    facts = facts.groupBy("conv").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.max("cost").alias("cost"))
    out = facts.join(told.withColumnRenamed("conv", "conv2"), facts.conv.eqNullSafe(F.col("conv2")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return out.select(F.col("conv").alias(conv), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), turns.withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with planted faults, by CRC-32 of `conv_id:turn` modulo 20.

    0 drops the turn, 1 empties its text, 2 removes `.!?` from it, 3 repeats it, 4 sets its role to user. A null counts as
    one space, in the key too, but stays null in conv_id and turn.
    """
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(what == 4, "user").otherwise(space("role"))
    out = rows.where(what != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")
