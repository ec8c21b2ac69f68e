"""Conversation structure repair: the cheapest edits that make a conversation alternate, found in one stream per conversation.

Rows are repartitioned by conversation and sorted by turn. The dynamic program runs from the last turn to the first, so that
ties can be told by the least audit text: between two Arrow batches it carries four costs, those of the rest from each state
of the role pattern ``(s?(ua)+)?``. The best moves of each row are one small number, kept as 16-bit backpointers; those of a
giant conversation are spilled to the shared folder a chunk at a time and read back last chunk first. Only a conversation's
audit (a letter an edit, which the result holds anyway) is in memory as a whole, never its rows.
"""

from __future__ import annotations

import array
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ROW, open_store, tagged
from tillscope.session import fresh_path, settle

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK, DUPLICATE, TRUNCATED, SOUND = 1, 2, 3, 0
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 4, 3, 3, 3
SPILL_ROWS = 1 << 20

# States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)
END_MOVES = ("", "II", "I", "")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` after the damage that crc32(``conv_id:turn``) % 20 decides, nulls as one space.

    0 drops the row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats the row, 4 makes it the user's. ``_row`` and ``_copy`` tell equal rows apart.
    """
    narrow = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate(or_space("text"), ".!?", "")).otherwise(or_space("text"))
    rows = tagged(narrow).withColumn("_draw", draw).where("_draw != 0")
    copies = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    hit = rows.withColumns({"role": F.when(F.col("_draw") == 4, "user").otherwise(or_space("role")), "text": text})
    return hit.select("conv_id", "turn", "role", "text", ROW, copies.alias("_copy"))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, ``_row``, ``_copy``) with the first fault of each; written once.

    ``_conv`` names the conversation, a null id too; ``_place`` orders its rows by turn (nulls first), then role and text. Whether
    a role and text came earlier is told by the least place of each, an aggregate folded before the shuffle.
    """
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", F.col("_said").alias("said"), F.col(ROW).alias("row"), F.col("_copy").alias("copy"))
    keyed = rows.withColumns({
        "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_said": F.sha2(F.col("text"), 256),
        "_blank": core == "", "_cut": ~F.substring(core, -1, 1).isin(".", "!", "?"),
    }).withColumn("_place", place)
    kept = settle(keyed.select("_conv", "conv_id", "turn", "role", "text", "_place", "_said", "_blank", "_cut"))
    first = kept.where("not _blank").groupBy("_conv", "role", "_said").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    joined = kept.join(first.where("_n > 1").drop("_n"), ["_conv", "role", "_said"], "left")
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_first") < F.col("_place"), DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(SOUND)
    return settle(joined.withColumn("fault", fault).select("_conv", "conv_id", "turn", "role", "text", "_place", "fault"))


def after(state: int, initial: str) -> int:
    """The state after a kept role with this initial, -1 where the pattern does not allow it. An empty role adds nothing."""
    if not initial:
        return state
    if initial == "s":
        return 1 if state == 0 else -1
    if initial == "u":
        return 2 if state != 2 else -1
    return 3 if initial == "a" and state == 2 else -1


@lru_cache(maxsize=1 << 16)
def step(rest: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """One row of the dynamic program, backwards: costs by state less their least, that least, and the moves from each state.

    ``rest`` are the costs after the row. A move is its letters and the state it leads to; of equal costs the ASCII-least letter is taken.
    """
    extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
    must_go = fault in (BLANK, DUPLICATE)
    plain = []
    for s in range(4):
        options = {"D": (DELETE + rest[s], s)}
        if not must_go:
            if (kept := after(s, initial)) >= 0:
                options["K"] = (extra + rest[kept], kept)
            options["R"] = (REROLE + extra + rest[NEXT[s]], NEXT[s])
        plain.append(options)
    costs = [min(c for c, _ in options.values()) for options in plain]
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    moves = []
    for state in range(4):
        letters, s = "", state
        while True:
            best = [k for k, (c, _) in plain[s].items() if c == costs[s]]
            if best and (best[0] == "D" or INSERT + costs[NEXT[s]] != costs[s]):
                moves.append((letters + best[0], plain[s][best[0]][1]))
                break
            letters, s = letters + "I", NEXT[s]
    least = min(costs)
    return tuple(c - least for c in costs), least, tuple(moves)


class Backpointers:
    """16-bit numbers appended in order and read back last first; full chunks lie in the shared folder."""

    def __init__(self, folder: str, chunk: int = SPILL_ROWS):
        self.folder, self.chunk, self.files, self.held = folder, chunk, [], array.array("H")

    def append(self, number: int) -> None:
        self.held.append(number)
        if len(self.held) == self.chunk:
            store, base = open_store(self.folder)
            store.create_dir(base)
            self.files.append(f"{base}/{uuid.uuid4().hex}")
            with store.open_output_stream(self.files[-1], compression="zstd") as sink:
                sink.write(self.held.tobytes())
            self.held = array.array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        store, _ = open_store(self.folder)
        for name in reversed(self.files):
            part = array.array("H")
            with store.open_input_stream(name, compression="zstd") as source:
                part.frombytes(source.read())
            yield from reversed(part)
            store.delete_file(name)


class Moves:
    """A number for each distinct set of moves of this process."""

    def __init__(self):
        self.numbers, self.sets = {}, []

    def number(self, moves: tuple) -> int:
        if moves not in self.numbers:
            self.numbers[moves] = len(self.sets)
            self.sets.append(moves)
        return self.numbers[moves]


class Solver:
    """One conversation, its rows given from the last to the first."""

    def __init__(self, folder: str, moves: Moves, chunk: int = SPILL_ROWS):
        self.rest, self.cost, self.moves, self.back = AT_END, 0, moves, Backpointers(folder, chunk)
        self.faults, self.illegal, self.later = [0, 0, 0, 0], 0, None
        self.turns, self.high, self.low = 0, None, None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        self.rest, least, moves = step(self.rest, initial, fault)
        self.cost += least
        self.back.append(self.moves.number(moves))
        self.faults[fault] += 1
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = initial
        if turn is not None and turn != self.low:
            self.high = turn if self.high is None else self.high
            self.low, self.turns = turn, self.turns + 1

    def result(self) -> dict:
        state, letters = 0, []
        for number in self.back.backwards():
            found, state = self.moves.sets[number][state]
            letters.append(found)
        letters.append(END_MOVES[state])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {
            "gaps": min(gaps, (1 << 63) - 1), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
            "illegal": self.illegal, "cost": self.cost + self.rest[0], "audit": "".join(letters),
        }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def solved(rows: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """Per conversation of ``marked`` rows: counts of faults, cost of the cheapest edits and their audit. One stream each, last turn first."""
    folder = fresh_path(rows.sparkSession, "backpointers")
    kinds = pa.schema([("_conv", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, now, solver, done, held = Moves(), None, None, [], 0
        for batch in batches:
            for conv, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in ("_conv", "turn", "role", "fault"))):
                if conv != now:
                    if solver:
                        done.append({"_conv": now, **solver.result()})
                        held += len(done[-1]["audit"]) + 100
                    now, solver = conv, Solver(folder, moves, spill_rows)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_pylist(done, kinds)
                        done, held = [], 0
                solver.add(turn, role, fault)
        if solver:
            done.append({"_conv": now, **solver.result()})
        yield pa.RecordBatch.from_pylist(done, kinds)

    ordered = rows.select("_conv", "_place", "turn", "role", "fault").repartition("_conv").sortWithinPartitions("_conv", F.col("_place").desc())
    schema = "_conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
    return settle(ordered.select("_conv", "turn", "role", "fault").mapInArrow(solve, schema))


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row of the repaired conversation; deleted rows are left out."""
    state, at = 0, 0

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            yield "I", ROLES[state], ""

    for role, text in rows:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "K":
            state = after(state, role[:1])
            yield edit, role, text
        elif edit == "R":
            state = NEXT[state]
            yield edit, ROLES[state], text
    yield from inserted()


def apply_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows ``_conv, conv_id, pos, edit, role, text`` in order within each partition, a conversation in one.

    A conversation's audit comes as a row before its own, so the stream needs one batch and one audit in memory.
    """
    heads = found.select("_conv", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast(rows.schema["_place"].dataType).alias("_place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = rows.select("_conv", F.lit(1).alias("_kind"), "conv_id", "_place", "role", "text")
    ordered = heads.unionByName(body).repartition("_conv").sortWithinPartitions("_conv", "_kind", "_place")
    names = ["_conv", "conv_id", "pos", "edit", "role", "text"]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))))

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Every row of the partition as (_conv, _kind, conv_id, role, text)."""
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("_conv", "_kind", "conv_id", "role", "text")))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = conversations(batches)
        head, ids, done, held = next(stream, None), None, [], 0

        def body_of() -> Iterator[tuple[str, str]]:
            nonlocal head, ids
            for row in stream:
                if row[1] == 0:
                    head = row
                    return
                ids = row[2]
                yield row[3], row[4]
            head = None

        while head is not None:
            conv, audit = head[0], head[4]
            for pos, (edit, role, text) in enumerate(edited(audit, body_of())):
                done.append((conv, ids, pos, edit, role, text))
                held += len(text) + 50
                if held > 1 << 20:
                    yield _rows(done, kinds)
                    done, held = [], 0
        yield _rows(done, kinds)

    return ordered.select("_conv", "_kind", "conv_id", "role", "text").mapInArrow(repair, "_conv string, conv_id long, pos long, edit string, role string, text string")


def _rows(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 per conversation of its repaired ``role:text`` rows joined by line feeds; reads ``repaired`` in its own order."""
    kinds = pa.schema([("_conv", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("_conv", "role", "text"))):
                if conv != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if len(done) > 10_000:
                yield _rows(done, kinds)
                done = []
        if state:
            done.append((now, state.hexdigest()))
        yield _rows(done, kinds)

    return repaired.mapInArrow(digest, "_conv string, repaired_sha256 string")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and, per conversation, counts of faults, cost and audit.

    ``rows`` has ``conv_id, turn, role, text``, no null role or text, and ``_row``, ``_copy`` to tell equal rows apart; ``damaged`` gives
    such rows. Other columns are ignored. Rows of one turn are ordered by role and text. An empty table gives two empty ones.
    """
    found = marked(rows)
    summary = solved(found)
    return apply_edits(found, summary), summary


def audited(turns: DataFrame) -> DataFrame:
    """Damage ``turns``, repair them, and return a row for each conversation, one without rows after the damage too."""
    rows, summary = repaired(damaged(turns))
    ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    shown = ids.join(summary, "_conv", "left").join(digests(rows), "_conv", "left")
    nothing = hashlib.sha256().hexdigest()
    return shown.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
