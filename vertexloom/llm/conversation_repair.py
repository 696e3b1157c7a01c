"""Repair of conversations by the cheapest edits that make their roles a system turn, if any, and then user and assistant in turn.

Each turn is kept (0), given the other role (Rerole, 2) or deleted (3); an empty turn may be inserted anywhere (2). A blank turn and one that
repeats an earlier turn of its conversation must go, and a truncated turn that stays adds 1. The role initials of the result match `(s?(ua)+)?`.

A conversation is aligned to every length the result may have (Wagner-Fischer): B[i, r] is the least cost of turning the turns from i on into
the last r letters of the alternating string, so one table holds all lengths. Only a band of it is made (Ukkonen): a cell that is more than
cost / 2 insertions or cost / 3 deletions away from the diagonal can't belong to edits that are as cheap as a first, greedy repair. The tables'
lengths with the least cost are traced back, each to its ASCII-least audit (the initials D, I, K, R in order), and the least audit wins.
A band of more than CELLS cells isn't made: what is left to do depends on the remaining length only by its parity, and four states for each
turn, which are the least over all lengths, give the same cost and audit (tested against each other).

A conversation passes through a task as a stream in the order of its turns. Kept of it are some 30 bytes a turn (role, fault, digest of what was seen) and
the audit, never its texts: these meet the audit in a second stream.

Defined cases: turns go by number, a null one first, turns with the same number by role and then text; null roles and texts are one space; a null conv_id is
a conversation like others; repeated rows are repeated turns; extra columns are not read; an empty table gives none.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut

KEEP, DELETE, INSERT, REROLE = 0, 3, 2, 2
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
CELLS = 1 << 22
_FAR = 1 << 29
_WHITE = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}
_NAMES = {"u": "user", "a": "assistant"}


def damaged(told: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): turns with faults put in by a hash of conversation and turn; a dropped turn stays as a row that isn't live."""
    text, number = F.coalesce("text", F.lit(" ")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    rows = told.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_k"))
    spoilt = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"),
                        (F.col("_k") != 0).alias("live"), F.explode(F.sequence(F.lit(0), F.when(F.col("_k") == 3, 1).otherwise(0))).alias("_copy")).drop("_copy"))


def whole(told: DataFrame) -> DataFrame:
    """The turns as they are, in the form that `diagnosed` and `repaired` take."""
    return told.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(True).alias("live"))


def greedy(roles: str, must: list[bool], extra: list[int]) -> int:
    """Cost of some repair: an upper bound."""
    cost, need = 0, ""
    for role, gone, more in zip(roles, must, extra):
        if gone or (role not in "ua" and (role != "s" or need)):
            cost += DELETE
        elif role == "s":
            need, cost = "s", cost + more
        else:
            cost += more + (INSERT if role != ("a" if need == "a" else "u") else 0)
            need = "a" if role == "u" else "u"
    return min(cost + {"a": INSERT, "s": 2 * INSERT}.get(need, 0), DELETE * len(roles))


def align(roles: str, must: list[bool], extra: list[int], cells: int = CELLS) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns with these role initials; a turn without a role counts as a space."""
    n, bound = len(roles), greedy(roles, must, extra)
    below, width = bound // DELETE, bound // INSERT + bound // DELETE + 1
    if (n + 1) * width > cells:
        return align_states(roles, must, extra)
    # row i holds r = n - i - below + w, so that a step to the next turn keeps w (it takes a letter) or adds 1 to it (it doesn't)
    table = np.full((n + 1, width + 1), _FAR, np.int32)
    w = np.arange(width)
    left = w - below
    table[n, :width] = np.where(left >= 0, INSERT * left, _FAR)
    for i in range(n - 1, -1, -1):
        left = n - i - below + w
        best = table[i + 1, 1:] + DELETE
        if not must[i]:
            takes = np.full(width, REROLE + extra[i], np.int32)
            if roles[i] in "ua":
                takes[(left % 2 == 1) == (roles[i] == "a")] = extra[i]
            best = np.minimum(best, np.where(left >= 1, table[i + 1, :width] + takes, _FAR))
        best = np.where(left >= 0, best, _FAR)
        table[i, :width] = np.minimum(np.minimum.accumulate(best - INSERT * left) + INSERT * left, _FAR)

    def cell(i: int, r: int) -> int:
        at = r - (n - i) + below
        return int(table[i, at]) if r >= 0 and 0 <= at < width else _FAR

    def ends(i: int, least: int) -> list[int]:
        lo, hi = n - i - below, n - i - below + width
        return [r for r in range(max(lo, least), hi) if r % 2 == 0]

    options = [(cell(0, r), None, r) for r in ends(0, 0)]
    for i in range(min(n, below + 1)):
        if roles[i] == "s" and not must[i]:
            options += [(DELETE * i + extra[i] + cell(i + 1, r), i, r) for r in ends(i + 1, 2)]
    cost = min(o[0] for o in options)

    def traced(kept: int | None, r: int) -> str:
        audit, i = ([], 0) if kept is None else (["D"] * kept + ["K"], kept + 1)
        while i < n or r:
            now = cell(i, r)
            if i < n and DELETE + cell(i + 1, r) == now:
                audit.append("D")
                i += 1
            elif r and INSERT + cell(i, r - 1) == now:
                audit.append("I")
                r -= 1
            else:
                audit.append("K" if roles[i] == ("a" if r % 2 else "u") else "R")
                i, r = i + 1, r - 1
        return "".join(audit)

    return cost, min(traced(i, r) for c, i, r in options if c == cost)


#: Where the result stands: at the start, after a system turn, after an assistant turn, after a user turn; and where it stands after a user or assistant turn more.
_START, _TOLD, _U, _A = range(4)
_NEXT = (_A, _A, _A, _U)


def align_states(roles: str, must: list[bool], extra: list[int]) -> tuple[int, str]:
    """align() with the lengths' least costs only: linear in the turns."""
    n = len(roles)
    rows = np.zeros((n + 1, 4), np.int32)

    def takes(i, state):
        """(letter, cost, state) of the turn staying."""
        if must[i]:
            return None
        if state == _START and roles[i] == "s":
            return "K", extra[i], _TOLD
        fits = roles[i] == ("a" if state == _A else "u")
        return ("K", extra[i], _NEXT[state]) if fits else ("R", REROLE + extra[i], _NEXT[state])

    def closed(base):
        return [min(base[s], INSERT + base[_NEXT[s]], 2 * INSERT + base[_NEXT[_NEXT[s]]]) for s in range(4)]

    after = closed([0, _FAR, 0, _FAR])
    rows[n] = after
    for i in range(n - 1, -1, -1):
        base = []
        for s in range(4):
            stays = takes(i, s)
            options = [DELETE + after[s]] + ([stays[1] + after[stays[2]]] if stays else [])
            if s == _START and stays and stays[2] == _TOLD:
                options.append(REROLE + extra[i] + after[_A])
            base.append(min(options))
        after = closed(base)
        rows[i] = after
    audit, i, s = [], 0, _START
    while i < n or (rows[n][s] if i == n else 0):
        now = int(rows[i][s])
        if i < n and DELETE + int(rows[i + 1][s]) == now:
            audit.append("D")
            i += 1
        elif INSERT + int(rows[i][_NEXT[s]]) == now:
            audit.append("I")
            s = _NEXT[s]
        else:
            letter, cost, then = takes(i, s)
            if cost + int(rows[i + 1][then]) != now:
                letter, then = "R", _A
            audit.append(letter)
            i, s = i + 1, then
    return int(rows[0][_START]), "".join(audit)


class _Turns:
    """What is kept of the conversation that is passing through."""

    def __init__(self):
        self.roles, self.must, self.extra, self.seen = [], [], [], set()
        self.counts, self.illegal = [0, 0, 0, 0], 0
        self.least, self.last, self.distinct = None, None, 0

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.distinct = turn, self.distinct + 1
        shown, key = text.strip(_WHITE), hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = BLANK if not shown else DUPLICATE if key in self.seen else TRUNCATED if shown[-1] not in ".!?" else FINE
        self.seen.add(key)
        self.counts[fault] += 1
        initial = role[:1] or " "
        if self.roles and self.roles[-1] + initial not in _LEGAL:
            self.illegal += 1
        self.roles.append(initial)
        self.must.append(fault in (BLANK, DUPLICATE))
        self.extra.append(int(fault == TRUNCATED))

    def row(self) -> list:
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.distinct
        cost, audit = align("".join(self.roles), self.must, self.extra)
        return [gaps, *self.counts[1:], self.illegal, cost, audit]


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _streamed(rows: DataFrame, first: list) -> DataFrame:
    """Whole conversations, one after the other, in the order of their turns."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def diagnosed(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state, schema, out = None, None, None, []
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
            for conv, turn, role, text, live in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "live"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.row()))
                    now, state = conv, _Turns()
                if live:
                    state.add(turn, role, text)
            if len(out) > 5000:
                yield _out(out, schema)
                out = []
        if state is not None:
            yield _out([*out, (now, *state.row())], schema)

    return _streamed(rows.select("conv_id", "turn", "role", "text", "live"), []).mapInArrow(run, f"conv_id {kind}, {FOUND}")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations in order, within the partitions as well."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType
    told = found.select("conv_id", F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = told.unionByName(rows.filter("live").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit")))

    def run(batches):
        conv, audit, at, place, alone = None, "", 0, 0, ""
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            out = []

            def inserted():
                nonlocal at, place, alone
                while at < len(audit) and audit[at] == "I":
                    alone = "a" if alone == "u" else "u"
                    out.append((conv, place, "I", _NAMES[alone], ""))
                    at, place = at + 1, place + 1

            for conv_id, _, role, text, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit"))):
                if told is not None:
                    conv, audit, at, place, alone = conv_id, told, 0, 0, ""
                    inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    alone = role[0] if edit == "K" else "a" if alone == "u" else "u"
                    out.append((conv, place, edit, role if edit == "K" else _NAMES[alone], text))
                    place += 1
                inserted()
            yield _out(out, schema)

    return _streamed(both, [F.col("audit").isNull()]).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines `role:text` of `repaired`, which comes as streams of whole conversations."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, digest, out, schema = None, None, [], None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{'\n' if place else ''}{role}:{text}".encode())
            if len(out) > 5000:
                yield _out(out, schema)
                out = []
        if digest is not None:
            yield _out([*out, (now, digest.hexdigest())], schema)

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """`diagnosed` with the digest of each repaired conversation; no turns left: the digest of the empty string."""
    found = cut(diagnosed(rows), "diagnosed")
    made = digests(repaired(rows, found)).withColumnRenamed("conv_id", "_conv")
    return found.join(made, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
