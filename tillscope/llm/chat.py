"""Chat formatting in budgeted windows.

The tokens of a conversation's turns are summed in order; windows hold whole turns: the turns that start and end in the same stretch of
FRESH tokens form one window, a turn that crosses into the next stretch has a window of its own, so no window but that of a longer turn holds
more than FRESH new tokens. Later windows begin with the conversation's opening system turn and with up to HISTORY_TURNS turns from before, as
far as they hold HISTORY tokens and the window stays within BUDGET. A system turn of more than SYSTEM tokens takes the rest off its
conversation's stretches. Tokens are those of the turn as it is written. A window is above BUDGET, and marked ``over_budget``, only where the
system turn and a single new turn do not fit together, or the system turn alone does not. Repeated turns are masked: each assistant
text is a target once, in the window where it is new.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline. In roles and texts a backslash becomes two, ``<|`` becomes ``<``, backslash,
``|``, and in roles a newline becomes backslash ``n``; so control strings never stand in a text, and all texts come back as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ROW, join_small, running, tagged
from tillscope.llm.token_counts import token_count
from tillscope.session import settle

BUDGET, SYSTEM, HISTORY, HISTORY_TURNS = 2048, 256, 256, 2
FRESH = BUDGET - SYSTEM - HISTORY
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def written(role: Column, text: Column) -> Column:
    """A turn as ``formatted`` writes it."""

    def escaped(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))

    head = F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(OPEN), head, F.lit("\n"), escaped(text), F.lit(CLOSE))


def formatted(turns: list[tuple[str, str, bool]]) -> tuple[str, list[dict[str, int]], int]:
    """Text of a window, the spans (code points) of its targets, and how many leading turns are repeats."""
    out, spans, at = [], [], 0
    for role, text, repeated in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == TARGET and not repeated:
            spans.append({"from": at + len(head), "to": at + len(head) + len(body)})
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans, sum(r for _, _, r in turns)


def parse(text: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


def windows(
    conversations: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", fresh: int = FRESH, history: int = HISTORY, history_turns: int = HISTORY_TURNS, system: int = SYSTEM,
) -> DataFrame:
    """One row per window: ``conv_id, window, text, targets (spans), n_repeated, n_tokens, over_budget``, settled.

    Null roles and texts are empty, null turns come first, equal turn numbers stand in any fixed order; rows without a conversation id are one
    conversation. A conversation of any length is spread over the cluster; what is gathered is the turns of one window.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv"), F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
    )
    budget = system + history + fresh
    shown = written(F.col("role"), F.col("text"))
    rows = tagged(turns.withColumn("n", token_count(shown, tokenizer_path)).withColumn("one", F.lit(1)))
    narrow = rows.select("conv", "turn", ROW, "n", "one", (F.col("role") == "system").alias("system"))
    summed = settle(running(narrow, ["conv"], ["turn", ROW], {"before": "n", "pos": "one"}))
    opened = settle(summed.where("pos = 0 and system").select("conv", F.col(ROW).alias("system_row"), F.col("n").alias("system_n")))
    left = F.lit(budget) - F.col("system_n")
    room = F.when(left > 0, F.least(F.lit(fresh), F.greatest(left - history, F.ceil(left / 2)))).otherwise(fresh).cast("bigint")
    large = settle(opened.where(F.col("system_n") > system).select("conv", room.alias("room")))
    placed = join_small(summed, large, ["conv"]).withColumn("room", F.coalesce("room", F.lit(fresh).cast("bigint")))
    stretch = F.expr("before div room")
    crosses = F.expr("(before + n - 1) div room") > stretch
    placed = settle(placed.withColumn("window", 2 * stretch + crosses.cast("int")))
    begun = placed.groupBy("conv", "window").agg(F.min("pos").alias("first"), F.min("before").alias("at"), F.sum("n").alias("new")).where("first > 0")
    starts = settle(begun.join(opened, "conv", "left").withColumn("free", F.lit(budget) - F.coalesce("system_n", F.lit(0)) - F.col("new")))
    back = starts.withColumn("pos", F.explode(F.sequence(F.col("first") - F.least(F.lit(history_turns).cast("bigint"), F.col("first")), F.col("first") - 1)))
    earlier = (
        back.join(placed.select("conv", "pos", ROW, "before", "system"), ["conv", "pos"])
        .where((F.col("at") - F.col("before") <= F.least(F.lit(history), F.col("free"))) & ~((F.col("pos") == 0) & F.col("system")))
        .select("conv", "window", "pos", ROW, F.lit(True).alias("repeated"))
    )
    opening = starts.where("system_row is not null").select(
        "conv", "window", F.lit(0).cast("bigint").alias("pos"), F.col("system_row").alias(ROW), F.lit(True).alias("repeated")
    )
    new = placed.select("conv", "window", "pos", ROW, F.lit(False).alias("repeated"))
    members = new.unionByName(earlier).unionByName(opening).join(rows.select(ROW, "conv_id", "role", "text", "n"), ROW)
    gathered = members.groupBy("conv", "window").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("pos", "role", "text", "repeated"))).alias("turns"),
    )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            laid = [formatted([(t["role"], t["text"], t["repeated"]) for t in w.as_py()]) for w in batch.column("turns")]
            texts, targets, repeats = zip(*laid) if laid else ((), (), ())
            arrays = [pa.array(texts, pa.string()), pa.array(targets, spans), pa.array(repeats, pa.int32())]
            kept = [batch.column(c) for c in ("conv", "conv_id", "window", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["conv", "conv_id", "window", "n_tokens", "text", "targets", "n_repeated"])

    schema = "conv string, conv_id long, window long, n_tokens long, text string, targets array<struct<`from`:long,`to`:long>>, n_repeated int"
    typed = gathered.select("conv", F.col("conv_id").cast("bigint").alias("conv_id"), "window", "n_tokens", "turns")
    return settle(typed.mapInArrow(lay_out, schema).withColumn("over_budget", F.col("n_tokens") > budget))


def read_back(laid: DataFrame) -> DataFrame:
    """Per conversation, from the windows: turns, their digest, the text under the mask and its digest, formatted length.

    Windows are parsed where they lie. A digest needs its conversation's bytes in order, so they stream, sorted, through one
    hash per conversation, with one batch in memory.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, masked, counts, lengths = [], [], [], []
            for text, spans, repeats in zip(*(batch.column(c).to_pylist() for c in ("text", "targets", "n_repeated"))):
                own = parse(text)[repeats:]
                turns.append("".join(f"{r}\n{t}\n" for r, t in own).encode())
                masked.append("".join(unescape(text[s["from"] : s["to"]]) for s in spans))
                counts.append(len(own))
                lengths.append(len(text))
            arrays = [pa.array(turns, pa.binary()), pa.array(masked, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())]
            kept = [batch.column(c) for c in ("conv", "conv_id", "window")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["conv", "conv_id", "window", "turns", "masked", "n", "chars"])

    schema = "conv string, conv_id long, window long, turns binary, masked string, n long, chars long"
    ordered = laid.mapInArrow(parts, schema).repartition("conv").sortWithinPartitions("conv", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = pa.schema([(x, pa.string() if x.endswith("256") else pa.int64()) for x in names])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, state = None, [], None

        def close() -> None:
            if state:
                done.append(dict(zip(names, (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "turns", "masked", "n", "chars"))):
                if row[0] != now:
                    close()
                    now, state = row[0], [row[1], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += row[4]
                state[2].update(row[2])
                state[3] += len(row[3])
                state[4].update(row[3].encode())
                state[5] += row[5]
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist(done, kinds)
                done.clear()
        close()
        yield pa.RecordBatch.from_pylist(done, kinds)

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(digest, out)
