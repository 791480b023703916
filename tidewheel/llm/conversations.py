"""Conversation structure repair by shortest paths on an implicit edit lattice.

A node is (rows used, state of the grammar `(s?(ua)+)?`); edges keep, rerole or delete the next row or insert a turn.
Dijkstra's algorithm takes nodes by (cost, audit), so the first accepting end node that it pops is the cheapest repair
with the least audit; nodes are made as they are reached.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size spreads over as many tasks as its rows
need. Most conversations lie within one task and are finished there. Those at the borders of tasks are cut into pieces:
a piece's best repair from each state to each state is found on its own, as costs add and audits concatenate, and the
pieces of a conversation are put together from these tables of at most 16 entries.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewheel.llm.common import staged

#: States: before everything, after a system turn, after a user turn, after an assistant turn. The turn that each may go on with.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EXPECTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ACCEPTING = (START, ASSISTANT)
RIGHT_PAIRS = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of one run of the algorithm; longer conversations are put together from such blocks.
BLOCK = 128
#: Rows of a task.
ROWS = 200_000
BLANKS = " \t\n\v\f\r"

Row = tuple[str, bool, bool]  # role's initial, whether it must go, whether it is truncated
Path = tuple[int, str]


def shortest(rows: list[Row], state: int, ends: tuple[int, ...], first: bool) -> dict[int, Path]:
    """The best (cost, audit) from a state before the rows to the end states after them; only the first found, or all."""
    found: dict[int, Path] = {}
    done: set[tuple[int, int]] = set()
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, state)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in ends:
            found[s] = cost, audit
            if first or len(found) == len(ends):
                break
        goal = NEXT[s, EXPECTED[s][0]]
        if (i, goal) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, goal))
        if i == len(rows):
            continue
        initial, gone, cut = rows[i]
        if (i + 1, s) not in done:
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, s))
        if not gone:
            extra = TRUNCATED if cut else 0
            if (s, initial) in NEXT and (i + 1, NEXT[s, initial]) not in done:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[s, initial]))
            if (i + 1, goal) not in done:
                heapq.heappush(heap, (cost + extra + REROLE, audit + "R", i + 1, goal))
    return found


def joined(before: dict[int, Path], table: dict[int, dict[int, Path]]) -> dict[int, Path]:
    """The best way to each state through one more block. Of equal cost, no audit to the same state and row begins another, so
    the least audit before goes with the least after."""
    out: dict[int, Path] = {}
    for middle, (cost, audit) in before.items():
        for end, (more, then) in table[middle].items():
            path = cost + more, audit + then
            if end not in out or path < out[end]:
                out[end] = path
    return out


def tables(rows: list[Row], states: tuple[int, ...]) -> dict[int, dict[int, Path]]:
    """From each of the states, the best way to every state after the rows."""
    out = {s: {s: (0, "")} for s in states}
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        block = {s: shortest(part, s, tuple(range(4)), False) for s in range(4)}
        out = {s: joined(ways, block) for s, ways in out.items()}
    return out


def cheapest(rows: list[Row]) -> Path:
    """The best repair of a whole conversation."""
    if len(rows) <= BLOCK:
        return next(iter(shortest(rows, START, ACCEPTING, True).values()))
    return _accepted(tables(rows, (START,))[START])


def _accepted(ways: dict[int, Path]) -> Path:
    return min(ways[s] for s in ACCEPTING if s in ways)


def applied(turns: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves of these turns, from a state on."""
    left = iter(turns)
    for edit in audit:
        role, text = (EXPECTED[state], "") if edit == "I" else next(left)
        if edit == "D":
            continue
        role = EXPECTED[state] if edit == "R" else role
        state = NEXT[state, role[:1]]
        yield edit, role, text


class Piece:
    """Consecutive turns of a conversation: faults, counts, and what the neighbouring pieces must know."""

    def __init__(self, rows: list[dict], later: set[int] = frozenset()):
        """rows: in order; later: places whose role and text an earlier piece has."""
        there = [r for r in rows if r["present"]]
        self.turns = [(r["role"], r["text"]) for r in there]
        self.rows: list[Row] = []
        self.new: list[int] = []  # places whose role and text are new here
        self.blank = self.duplicate = self.truncated = 0
        seen: set[tuple[str, str]] = set()
        for k, (role, text) in enumerate(self.turns):
            repeated = (role, text) in seen
            if not repeated:
                seen.add((role, text))
                self.new.append(k)
            end = text.rstrip(BLANKS)[-1:]
            blank = not end
            duplicate = not blank and (repeated or k in later)
            cut = not blank and not duplicate and end not in ".!?"
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
            self.rows.append((role[:1], blank or duplicate, cut))
        self.illegal = sum(a[0] + b[0] not in RIGHT_PAIRS for a, b in zip(self.rows, self.rows[1:], strict=False))
        numbers = [r["turn"] for r in there if r["turn"] is not None]
        self.low, self.high = (numbers[0], numbers[-1]) if numbers else (None, None)
        self.distinct = len(set(numbers))

    def counts(self) -> dict:
        return {"low": self.low, "high": self.high, "distinct": self.distinct, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def _digest(turns: list[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest()


def _mark(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


_COUNTS = [(n, pa.int64()) for n in ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")]
_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_COUNTS_DDL = ", ".join(f"{n} bigint" for n, _ in _COUNTS)


def _named(turns: list[tuple[str, str, str]]) -> list[dict]:
    return [dict(zip(("edit", "role", "text"), t, strict=True)) for t in turns]


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = tuple(row[k] for k in keys)
            if held and here != key:
                yield key, held
                held = []
            key = here
            held.append(row)
    if held:
        yield key, held


def _range_sorted(turns: DataFrame, rows_each: int) -> DataFrame:
    """Rows in order of conversation and turn (nulls first), dealt by ranges of even size. Rows of one turn are in order of a hash of
    role and text. Equal rows may fall into two tasks, so a turn of any number of rows is spread as well."""
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() // rows_each + 1)
    order = ["conv_id", "turn", "mark", "at"]
    marked = turns.withColumns({"mark": F.xxhash64("role", "text"), "at": F.monotonically_increasing_id()})
    return marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def repaired(turns: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = True, rows_each: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The repairs of all conversations, and with texts the repaired turns.

    Repairs: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.
    Turns: (conv_id, piece, place, edit, role, text), in order of piece and place.

    A null role or text counts as one blank, a null conv_id as a conversation of its own, a null turn comes first. Rows where
    `present` is false only name their conversation: without other rows it has zeros, an empty audit and the hash of nothing.
    Equal rows are duplicates; rows of one turn are taken in order of a hash of role and text. Empty tables give empty results,
    further columns are ignored. As a conversation's audit is one cell and its hash a sequence, its audit and the stream of its
    repaired text go through one task at the end, in memory only the audit.
    """
    key, kind = turns[conv_col], turns.schema[conv_col].dataType.simpleString()
    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    rows = turns.select(key.alias("conv_id"), turns[turn_col].cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    arrow = pa.schema([("conv_id", to_arrow_type(turns.schema[conv_col].dataType)), ("piece", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("present", pa.bool_()), *_COUNTS, ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string()), ("turns", _TURNS)])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole conversations are finished; the rows of a task's first and last one are handed on."""

        def out() -> Iterator[dict]:
            piece, before, first = TaskContext.get().partitionId(), None, True
            for (conv,), held in _groups(batches, "conv_id"):
                if before is not None:
                    yield from (_handed(before, piece) if first else [_finished(*before, piece, texts)])
                    first = False
                before = conv, held
            if before is not None:
                yield from _handed(before, piece)

        return _batches(out(), arrow)

    ddl = f"conv_id {kind}, piece bigint, place bigint, turn bigint, role string, text string, present boolean, {_COUNTS_DDL}, cost bigint, audit string, digest string, turns array<struct<edit: string, role: string, text: string>>"
    made = staged(_range_sorted(rows, rows_each).select("conv_id", "turn", "role", "text", "present").mapInArrow(inner, ddl), "conversations")
    whole, rest = made.where("audit is not null"), made.where("audit is null")
    parts, streamed = _from_pieces(rest.select("conv_id", "piece", "place", "turn", "role", "text", "present"), kind, arrow.field("conv_id").type)
    columns = ["conv_id", *(n for n, _ in _COUNTS), "cost", "audit", "digest"]
    both = whole.select(columns).unionByName(parts.select(columns))
    gaps = F.when(F.col("distinct") > 0, F.col("high") - F.col("low") + 1 - F.col("distinct")).otherwise(0).alias("gaps")
    found = both.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    if not texts:
        return found, None
    shown = whole.select("conv_id", "piece", "turns").unionByName(streamed.select("conv_id", "piece", "turns"))
    return found, shown.select("conv_id", "piece", F.posexplode("turns").alias("place", "turn")).select("conv_id", "piece", "place", "turn.*")


def _handed(group: tuple, piece: int) -> Iterator[dict]:
    for place, row in enumerate(group[1]):
        yield row | {"piece": piece, "place": place}


def _finished(conv: object, held: list[dict], piece: int, texts: bool) -> dict:
    own = Piece(held)
    cost, audit = cheapest(own.rows)
    turns = list(applied(own.turns, audit, START))
    return {"conv_id": conv, "piece": piece, **own.counts(), "cost": cost, "audit": audit, "digest": _digest(turns), "turns": _named(turns) if texts else None}


def _from_pieces(rest: DataFrame, kind: str, id_type: pa.DataType) -> tuple[DataFrame, DataFrame]:
    """Repairs of conversations in pieces, and their repaired turns by piece.

    Which rows repeat those of an earlier piece is found by a hash of role and text of what is new in each piece: of one such
    hash there are as many rows as pieces at most.
    """
    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_piece = lambda df: df.repartition(n, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")

    def news(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", id_type), ("piece", pa.int64()), ("place", pa.int64()), ("hash", pa.string())])
        found = ((conv, piece, k, _mark(*own.turns[k])) for (conv, piece), held in _groups(batches, "conv_id", "piece") for own in [Piece(held)] for k in own.new)
        return _batches((dict(zip(schema.names, x, strict=True)) for x in found), schema)

    new = staged(by_piece(rest).mapInArrow(news, f"conv_id {kind}, piece bigint, place bigint, hash string"), "new")
    same = [F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), F.col("a.hash") == F.col("b.hash"), F.col("a.piece") > F.col("b.piece")]
    first = new.groupBy("conv_id", "hash").agg(F.min("piece").alias("piece"), F.count("*").alias("n")).where("n > 1")
    later = new.alias("a").join(first.alias("b"), same).select("a.conv_id", "a.piece", "a.place")
    # Of a repeated row all later ones go, not only the first of a piece: later rows of the piece are duplicates anyway.
    marked = rest.withColumn("later", F.lit(None).cast("bigint")).unionByName(later.withColumn("later", F.col("place")).drop("place"), allowMissingColumns=True)
    marked = staged(marked, "pieces")

    def read(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple[object, int, Piece, list[dict]]]:
        for (conv, piece), held in _groups(batches, "conv_id", "piece"):
            yield conv, piece, Piece([r for r in held if r["present"] is not None], {r["later"] for r in held if r["later"] is not None}), held

    step = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", id_type), ("piece", pa.int64()), *_COUNTS, ("left", pa.string()), ("right", pa.string()), ("ways", pa.list_(step))])
        found = (
            {"conv_id": conv, "piece": piece, **own.counts(), "left": own.rows[0][0] if own.rows else None, "right": own.rows[-1][0] if own.rows else None,
             "ways": [{"begin": s, "end": e, "cost": c, "audit": a} for s, to in tables(own.rows, tuple(range(4))).items() for e, (c, a) in to.items()]}
            for conv, piece, own, _ in read(batches)
        )
        return _batches(found, schema, 20)

    found = by_piece(marked).mapInArrow(ways, f"conv_id {kind}, piece bigint, {_COUNTS_DDL}, left string, right string, ways array<struct<begin: bigint, end: bigint, cost: bigint, audit: string>>")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each conversation its repair; of each piece the state it begins in and its part of the audit."""
        schema = pa.schema([("conv_id", id_type), ("piece", pa.int64()), *_COUNTS, ("cost", pa.int64()), ("audit", pa.string()), ("state", pa.int64()), ("part", pa.string())])

        def out() -> Iterator[dict]:
            for (conv,), held in _groups(batches, "conv_id"):
                best: dict[int, tuple[Path, list[tuple[int, int]]]] = {START: ((0, ""), [])}
                total = dict.fromkeys((n for n, _ in _COUNTS), 0) | {"low": None, "high": None}
                last = None
                for row in held:
                    if row["left"] is not None:
                        total["illegal"] += last is not None and last + row["left"] not in RIGHT_PAIRS
                        last = row["right"]
                    for n in ("blank", "duplicate", "truncated", "illegal", "distinct"):
                        total[n] += row[n]
                    if row["low"] is not None:
                        total["distinct"] -= total["high"] == row["low"]
                        total["low"] = row["low"] if total["low"] is None else total["low"]
                        total["high"] = row["high"]
                    new: dict[int, tuple[Path, list[tuple[int, int]]]] = {}
                    for w in row["ways"]:
                        if w["begin"] in best:
                            (cost, audit), trail = best[w["begin"]]
                            path = cost + w["cost"], audit + w["audit"]
                            if w["end"] not in new or path < new[w["end"]][0]:
                                new[w["end"]] = path, [*trail, (w["begin"], len(w["audit"]))]
                    best = new
                (cost, audit), trail = min((best[s] for s in ACCEPTING if s in best), key=lambda x: x[0])
                at = 0
                for row, (state, size) in zip(held, trail, strict=True):
                    yield {"conv_id": conv, "piece": row["piece"], "state": state, "part": audit[at : at + size]}
                    at += size
                yield {"conv_id": conv, **total, "cost": cost, "audit": audit}

        return _batches(out(), schema, 20)

    whole = staged(found.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(together, f"conv_id {kind}, piece bigint, {_COUNTS_DDL}, cost bigint, audit string, state bigint, part string"), "audits")
    chosen = whole.where("audit is null").select("conv_id", "piece", "state", "part")

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", id_type), ("piece", pa.int64()), ("turns", _TURNS)])

        def out() -> Iterator[dict]:
            for conv, piece, own, held in read(batches):
                state, part = next((r["state"], r["part"]) for r in held if r["part"] is not None)
                yield {"conv_id": conv, "piece": piece, "turns": _named(list(applied(own.turns, part, state)))}

        return _batches(out(), schema, 20)

    turns = staged(by_piece(marked.unionByName(chosen, allowMissingColumns=True)).mapInArrow(shown, f"conv_id {kind}, piece bigint, turns array<struct<edit: string, role: string, text: string>>"), "turns")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of each conversation's repaired text, piece by piece."""
        schema = pa.schema([("conv_id", id_type), ("digest", pa.string())])

        def out() -> Iterator[dict]:
            key, sha, begun = None, None, False
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    if sha is None or row["conv_id"] != key:
                        if sha is not None:
                            yield {"conv_id": key, "digest": sha.hexdigest()}
                        key, sha, begun = row["conv_id"], hashlib.sha256(), False
                    for turn in row["turns"]:
                        sha.update(f"{'\n' * begun}{turn['role']}:{turn['text']}".encode())
                        begun = True
            if sha is not None:
                yield {"conv_id": key, "digest": sha.hexdigest()}

        return _batches(out(), schema)

    digests = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(hashed, f"conv_id {kind}, digest string").withColumnRenamed("conv_id", "_conv")
    repairs = whole.where("audit is not null").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return repairs.drop("_conv"), turns
