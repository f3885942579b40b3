"""Conversation structure repair by iterative-deepening A*.

A conversation's roles have to read `(s?(ua)+)?` by their initials. Four edits lead there: Keep a row
(0), Rerole it to user or assistant (2), Delete it (3, the only choice for blank and duplicate rows) and
Insert an empty user or assistant turn (2); a truncated row that stays costs 1 more. The search goes
depth first in the order D, I, K, R under a cost bound that rises by one until a path is accepted, so the
first accepted path is the cheapest and, of equals, the least one in ASCII. Places that failed with some
cost left are remembered and not searched again with less. The estimate ahead counts forced deletions,
truncated rows and, of the rest, neighbours that don't follow each other: an edit mends two at most.

Conversations are read as a sorted stream, `STRETCH` rows at a time, so their length is not bounded by
memory: each stretch is searched from every state the stretches before it can end in to every state it can
end in, and the cheapest chain wins. One conversation of up to `STRETCH` rows is a single search. Rows are
put out as soon as all chains agree on them. The rows of one conversation are read by one task, since the
digest of a conversation runs over its text in order; sorting spills to disk, and only one stretch and what
chains still disagree on is held in Python.

Defined results: a null role or text counts as one space; rows with a null turn come first; rows of equal
turns are taken by role and then by text; a null conv_id is a conversation. A row found twice is a
duplicate. Conversations whose rows are all gone have a report with zeros. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pick

COLUMNS = ("conv_id", "turn", "role", "text")
SPACES = " \t\n\x0b\x0c\r"
#: Rows searched at a time and rows handed to Arrow at a time.
STRETCH, ROWS = 64, 1024

START, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
FOLLOWS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ADDED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
ACCEPTED = (START, ASSISTANT)
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: A chain dearer than another by more than this can't win: its rest fits the other for 5 more at most.
HOPELESS = 8


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, dealt by a hash of `conv_id:turn`; dropped rows stay, `there` is false."""
    rows = pick(rows, *COLUMNS)
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    text = F.coalesce("text", space)
    dealt = rows.withColumn("dealt", F.crc32(key.cast("binary")) % 20)
    faulty = dealt.select(
        "conv_id", "turn", (F.col("dealt") != 0).alias("there"),
        F.when(F.col("dealt") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("dealt").isin(0, 1), "").when(F.col("dealt") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("dealt") == 3, 2).otherwise(1))).alias("copy"),
    )
    return faulty.drop("copy")


def whole(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the columns `repair` reads."""
    rows = pick(rows, *COLUMNS)
    space = F.lit(" ")
    return rows.select(
        "conv_id", "turn", F.lit(True).alias("there"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their fault (blank, duplicate, truncated or null), by conversation and in order."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    seen = Window.partitionBy("conv_id", "there", "same").orderBy(F.col("turn").asc_nulls_first())
    said = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(said == "", "blank").when(F.col("nth") > 1, "duplicate")
        .when(~F.substring(said, -1, 1).isin(*".!?"), "truncated")
    )
    # one shuffle: the window's rows are already together
    placed = rows.withColumn("same", same).repartition("conv_id").withColumn("nth", F.row_number().over(seen))
    return (
        placed.select("conv_id", "turn", "there", "role", "text", fault.alias("fault"))
        .sortWithinPartitions(
            F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text",
            F.col("fault").asc_nulls_first(),
        )
    )


def symbol(role: str, fault: str | None) -> str:
    """x: has to go; s, u, a or o by the role's initial, a capital for a truncated row."""
    if fault in ("blank", "duplicate"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault else initial


@lru_cache(200_000)
def cheapest(rows: str, entry: str, exits: tuple[str, ...]) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then least, edits from a state to one of the exits; None if none."""
    if exits == (START,) and entry != START:
        return None
    if exits == (SYSTEM,) and not (entry == SYSTEM or entry == START and ("s" in rows or "S" in rows)):
        return None
    n = len(rows)
    ahead = estimates(rows, exits)
    failed: dict[tuple[int, str], int] = {}
    path: list[str] = []

    def search(i: int, state: str, left: int) -> bool:
        if i == n and state in exits:
            return True
        if failed.get((i, state), -1) >= left or ahead(i, state) > left:
            return False
        row = rows[i] if i < n else "x"
        stay = TRUNCATED if row.isupper() else 0
        ways = []
        if i < n:
            ways.append(("D", i + 1, state, DELETE))
        ways.append(("I", i, ADDED[state], INSERT))
        if row != "x":
            if row.lower() in FOLLOWS[state]:
                ways.append(("K", i + 1, row.lower(), stay))
            ways.append(("R", i + 1, ADDED[state], REROLE + stay))
        for edit, to, after, cost in ways:
            if cost <= left:
                path.append(edit)
                if search(to, after, left - cost):
                    return True
                path.pop()
        failed[i, state] = left
        return False

    bound = ahead(0, entry)
    while not search(0, entry, bound):
        bound += 1
    return bound, "".join(path)


def estimates(rows: str, exits: tuple[str, ...]):
    """A function (row, state) -> least cost still ahead.

    Neighbours that may not follow each other come in runs. Deleting, reroling or inserting a row changes
    two neighbourships at most, so a run of r takes at least r / 2 such edits, of 2 or more each.
    """
    n = len(rows)
    base, first = [0] * (n + 1), [""] * (n + 1)
    run, rest = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        base[i], first[i], run[i], rest[i] = base[i + 1], first[i + 1], run[i + 1], rest[i + 1]
        if rows[i] == "x":
            base[i] += DELETE
            continue
        base[i] += TRUNCATED if rows[i].isupper() else 0
        now, then = rows[i].lower(), first[i + 1]
        good = then in FOLLOWS.get(now, "") if then else now in exits
        first[i] = now
        run[i], rest[i] = (0, rest[i] + (run[i] + 1) // 2) if good else (run[i] + 1, rest[i])

    def ahead(i: int, state: str) -> int:
        then = first[i]
        good = then in FOLLOWS[state] if then else state in exits
        return base[i] + 2 * (rest[i] + (run[i] + (1 if good else 2)) // 2)

    return ahead


class Conversation:
    """The rows of one conversation, taken in order; counts its faults and finds its edits."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.chains: dict[str, tuple[int, tuple[str, ...]]] = {START: (0, ())}
        self.pending: list[list[tuple]] = []
        self.stretch: list[tuple] = []
        self.audit: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.least = self.most = None
        self.turns = 0
        self.digest, self.place, self.state = hashlib.sha256(), 0, START

    def add(self, turn, role, text, fault) -> list[tuple]:
        """Take a row; rows that are repaired by now."""
        if fault:
            self.faults[fault] += 1
        pair = (self.before, role[:1])
        self.illegal += self.before is not None and pair not in (("s", "u"), ("u", "a"), ("a", "u"))
        self.before = role[:1]
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        out = self.advance(False) if len(self.stretch) == STRETCH else []
        self.stretch.append((turn, role, text, symbol(role, fault)))
        return out

    def advance(self, last: bool) -> list[tuple]:
        rows = "".join(r[3] for r in self.stretch)
        found: dict[str, tuple[int, str, tuple[str, ...]]] = {}
        for entry, (cost, edits) in self.chains.items():
            for exits in (ACCEPTED,) if last else ((START,), (SYSTEM,), (USER,), (ASSISTANT,)):
                way = cheapest(rows, entry, exits)
                if way is None:
                    continue
                chain = (*edits, way[1])
                rank = (cost + way[0], "".join(chain), chain)
                if exits[0] not in found or rank < found[exits[0]]:
                    found[exits[0]] = rank
        least = min(f[0] for f in found.values())
        self.chains = {k: (f[0], f[2]) for k, f in found.items() if f[0] <= least + HOPELESS}
        self.pending.append(self.stretch)
        self.stretch = []
        return self.settle()

    def settle(self) -> list[tuple]:
        """Put out the stretches all chains agree on."""
        out, chains = [], [c[1] for c in self.chains.values()]
        agreed = 0
        while agreed < len(self.pending) and len({c[agreed] for c in chains}) == 1:
            out += self.apply(self.pending[agreed], chains[0][agreed])
            agreed += 1
        if agreed:
            self.audit += chains[0][:agreed]
            del self.pending[:agreed]
            self.chains = {k: (cost, c[agreed:]) for k, (cost, c) in self.chains.items()}
        return out

    def apply(self, rows: list[tuple], edits: str) -> list[tuple]:
        out, at = [], 0
        for edit in edits:
            turn, role, text, mark = (None, None, "", "") if edit == "I" else rows[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit == "K":
                self.state = mark.lower()
            else:
                self.state = ADDED[self.state]
                role = NAMES[self.state]
            self.digest.update((("\n" if self.place else "") + f"{role}:{text}").encode())
            out.append((self.conv_id, self.place, edit, turn, role, text))
            self.place += 1
        return out

    def close(self) -> list[tuple]:
        return self.advance(True)

    def report(self) -> tuple:
        (cost, _), = self.chains.values()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (
            self.conv_id, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest()
        )


def _streamed(rows: DataFrame, schema: str, reports: bool) -> DataFrame:
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                for conv_id, turn, there, role, text, fault in zip(*[c.to_pylist() for c in piece.columns]):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            done = now.close()
                            out += [now.report()] if reports else done
                        now = Conversation(conv_id)
                    if there:
                        done = now.add(turn, role, text, fault)
                        out += [] if reports else done
                if len(out) >= ROWS:
                    yield packed(out)
                    out = []
        if now is not None:
            done = now.close()
            out += [now.report()] if reports else done
        yield packed(out)

    return ordered(rows).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns of repaired conversations, of `damaged` or `whole`."""
    kind = dict(rows.dtypes)
    schema = f"conv_id {kind['conv_id']}, place long, edit string, turn {kind['turn']}, role string, text string"
    return _streamed(rows, schema, reports=False)


def repair_reports(rows: DataFrame) -> DataFrame:
    """One row per conversation: its gaps and faults, the cost and initials of its edits, and the SHA-256 of
    the repaired `role:text` lines."""
    schema = (
        f"conv_id {dict(rows.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, repaired_sha256 string"
    )
    return _streamed(rows, schema, reports=True)
