r"""Chat formatting in windows of a token budget.

Template: a turn is `<|role|>` and a line feed, the text, `|end|` and a line feed. In roles and texts a backslash is
written `\\` and a bar `\p`; so bars stand in control strings alone, whatever a text says, and reading undoes it.

A conversation longer than the budget becomes several windows. With the prefix sums of the turns' tokens, a window takes
as many whole new turns as fit beside the system turn (the first turn, if its role is system), which each window has,
and the last turns before, as far as the history's share of the budget allows. A turn that doesn't fit at all gets a
window of its own, over the budget and without history. Only the assistant turns that are new in a window are under the
loss mask; repeated ones aren't, so each is learned once.

A long conversation is no group: turns are numbered by ranges of (conversation, turn), then dealt out by
blocks of BLOCK turns, each with copies of the system turn and of as many turns before the block as the history has tokens (a turn has one at least, so
these are all that it can use). Windows end at the end of a block. Within a task, rows are read in order, one block at a time, and each turn is
tokenised there.

Turns are in order of turn (null first), then by the first FRONT characters of role and text, then by a hash of them; repeated rows are turns of their own. A null role or text
counts as empty; rows with a null conversation id are one conversation. No rows give no windows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.lineage import cut
from ..plans.ranks import with_row_index
from .token_counts import counter

BUDGET, HISTORY = 1024, 256
#: Turns dealt out together, and characters that take part in sorting.
BLOCK, FRONT = 256, 64
END = "|end|\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\p")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\p", "|") for part in text.split("\\\\"))


def turn_text(role: str, text: str) -> str:
    return f"<|{escape(role)}|>\n{escape(text)}{END}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn[2:].partition("|>\n")
        out.append((unescape(role), unescape(text)))
    return out


_WINDOW = T.StructType([T.StructField("block", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("formatted", T.StringType()),
                        T.StructField("n_repeated", T.IntegerType()), T.StructField("n_new", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])))])


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each window: conv_col, block and window (its place), formatted, n_repeated (turns at its start that were there
    before), n_new, n_tokens, loss (start and length, in characters, of the escaped texts under the loss mask). `path` names a tokenizer file."""
    kind = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("none", F.col("conv").isNull())
    order = ["none", "conv", "turn", F.substring("role", 1, FRONT), F.substring("text", 1, FRONT), F.xxhash64("role", "text")]
    numbered = with_row_index(rows, order, "place")
    # written first: a join with an aggregate of the same stage can't be split where one conversation has most turns
    begins = cut(numbered.groupBy("none", "conv").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("turns")), "begins")
    same = (F.col("l.none") == F.col("r.none")) & F.col("l.conv").eqNullSafe(F.col("r.conv"))
    placed = numbered.alias("l").join(begins.alias("r"), same).select("l.conv", "l.none", "role", "text", "turns", (F.col("place") - F.col("begin")).alias("at"))
    block, last = F.floor(F.col("at") / BLOCK).cast("bigint"), F.floor((F.col("turns") - 1) / BLOCK).cast("bigint")
    own = placed.withColumns({"block": block, "copy": F.lit(0)})
    reach = F.least(last, F.floor((F.col("at") + history) / BLOCK).cast("bigint"))  # the last block that may use the turn as history
    tail = placed.withColumns({"_from": block + 1, "_to": reach}).filter("_to >= _from").withColumns(
        {"block": F.explode(F.sequence("_from", "_to")), "copy": F.lit(1)}).drop("_from", "_to")
    system = placed.filter((F.col("at") == 0) & (F.col("role") == "system") & (F.col("turns") > BLOCK)).withColumns(
        {"block": F.explode(F.sequence(F.lit(1).cast("bigint"), last)), "copy": F.lit(2)})
    dealt = own.unionByName(tail).unionByName(system)
    dealt = dealt.repartition(F.xxhash64("conv", "block")).sortWithinPartitions("none", "conv", "block", "at", "copy")

    def window(batches):
        group, key = [], None
        for batch in batches:
            made = []
            rows = batch.select(["none", "conv", "block", "at", "copy", "role", "text"]).to_pylist()
            for row, tokens in zip(rows, counter(path).count([turn_text(r["role"], r["text"]) for r in rows])):
                row["tokens"] = tokens
                mine = row["none"], row["conv"], row["block"]
                if group and mine != key:
                    made += of_block(group)
                    group = []
                key = mine
                group.append(row)
            yield packed(made)
        yield packed(of_block(group) if group else [])

    def packed(rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    def of_block(group):
        head = [r for r in group if r["role"] == "system" and r["at"] == 0]
        system, before = head[:1], [r for r in group if r["copy"] == 1 and not (head and r["at"] == 0)]
        new = [r for r in group if r["copy"] == 0]
        turns = before + new
        first = len(before)
        own_system = bool(system) and system[0]["copy"] == 0
        size = sum(r["tokens"] for r in system)
        sizes = np.array([r["tokens"] for r in turns], np.int64)
        out = []
        for number, (back, start, end) in enumerate(spans(sizes, first, size, budget, history, own_system)):
            repeated = turns[back:start]
            if system and (not own_system or start > 0):
                repeated = system + [r for r in repeated if r is not system[0]]
            parts, loss, place = [], [], 0
            for i, r in enumerate(repeated + turns[start:end]):
                piece = turn_text(r["role"], r["text"])
                if i >= len(repeated) and r["role"] == "assistant":
                    body = escape(r["text"])
                    loss.append({"start": place + len(piece) - len(END) - len(body), "length": len(body)})
                parts.append(piece)
                place += len(piece)
            out.append({"conv": group[0]["conv"], "block": group[0]["block"], "window": number, "formatted": "".join(parts), "n_repeated": len(repeated),
                        "n_new": end - start, "n_tokens": sum(r["tokens"] for r in repeated) + int(sizes[start:end].sum()), "loss": loss})
        return out

    schema = T.StructType([T.StructField("conv", kind), *_WINDOW.fields])
    return dealt.mapInArrow(window, schema).withColumnRenamed("conv", conv_col)


def spans(sizes: np.ndarray, first: int, system: int, budget: int, history: int, own_system: bool) -> list[tuple[int, int, int]]:
    """(first history turn, first new turn, end) of each window over the turns from `first` on; those before are history.

    `system` tokens go first in each window; with own_system, the system turn is turn 0 itself and is new in the first window.
    """
    sums, out, start = np.concatenate([[0], np.cumsum(sizes)]), [], first
    while start < len(sizes):
        fixed = 0 if own_system and start == 0 else system
        room = budget - fixed
        share = min(history, max(0, room - int(sizes[start])))
        back = max(int(np.searchsorted(sums[: start + 1], sums[start] - share)), 1 if own_system and start else 0)
        end = max(start + 1, int(np.searchsorted(sums, sums[back] + room, "right")) - 1)
        out.append((min(back, start), start, end))
        start = end
    return out


def read_back(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation, from its windows alone: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a whole conversation has to see it in order, so a conversation's windows are read by one task, one after the other.
    """
    kind = made.schema[conv_col].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        to, key, state = to_arrow_schema(schema), None, None

        def closed():
            return {"conv": key[1], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                mine = row["conv"] is None, row["conv"]
                if mine != key:
                    if state:
                        done.append(closed())
                    key, state = mine, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_turns(text)[row["n_repeated"]:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in row["loss"]:
                    said = unescape(text[span["start"]:span["start"] + span["length"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=to)
        yield pa.RecordBatch.from_pylist([closed()] if state else [], schema=to)

    ordered = made.withColumnRenamed(conv_col, "conv").select("conv", "block", "window", "formatted", "n_repeated", "loss")
    return ordered.repartition("conv").sortWithinPartitions("conv", "block", "window").mapInArrow(read, schema).withColumnRenamed("conv", conv_col)
