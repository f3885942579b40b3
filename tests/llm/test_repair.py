import hashlib
import random
import re
import zlib

import pytest

from wardflow.llm import repair

from .util import SMALL, rows, table

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?\Z")


def best(symbols):
    """Cheapest and least edits, by keeping the best of each state and place."""
    def closed(states):
        for _ in range(3):
            for state, (cost, edits) in list(states.items()):
                way = (cost + 2, edits + "I")
                to = repair.ADDED[state]
                states[to] = min(states.get(to, way), way)
        return states

    states = closed({"": (0, "")})
    for c in symbols:
        after = {}
        for state, (cost, edits) in states.items():
            ways = [("D", state, 3)]
            if c != "x":
                stay = int(c.isupper())
                if c.lower() in repair.FOLLOWS[state]:
                    ways.append(("K", c.lower(), stay))
                ways.append(("R", repair.ADDED[state], 2 + stay))
            for edit, to, more in ways:
                way = (cost + more, edits + edit)
                after[to] = min(after.get(to, way), way)
        states = closed(after)
    return min(states[s] for s in ("", "a") if s in states)


def expected(data, damage=True):
    """Reports by conversation, straight from the definition."""
    out = {}
    for conv_id, turn, role, text in data:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        dealt = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if dealt == 1:
            text = ""
        elif dealt == 2:
            text = re.sub("[.!?]", "", text)
        elif dealt == 4:
            role = "user"
        times = {0: 0, 3: 2}.get(dealt, 1)
        out.setdefault(conv_id, []).extend([(turn, role, text)] * times)
    return [report(conv_id, said) for conv_id, said in out.items()]


def report(conv_id, said):
    said = sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, symbols, seen = [0, 0, 0], [], set()
    for _, role, text in said:
        bare = text.strip(" \t\n\v\f\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols.append("x" if fault in (0, 1) else initial.upper() if fault == 2 else initial)
    initials = [r[1][:1] for r in said]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in said if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = best(symbols)
    lines, state, at = [], "", 0
    for edit in audit:
        if edit != "I":
            _, role, text = said[at]
            at += 1
        else:
            text = ""
        if edit == "D":
            continue
        state = role[:1] if edit == "K" else repair.ADDED[state]
        lines.append((role if edit == "K" else repair.NAMES[state]) + ":" + text)
    assert FORM.match("".join(line[:1] for line in lines)) and at == len(said)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv_id, gaps, *counts, illegal, cost, audit, sha)


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_least_cheapest_edits(seed):
    draw = random.Random(seed)
    for _ in range(400):
        symbols = "".join(draw.choice("suaosuaxUAuaua" if seed % 2 else "uauaAx") for _ in range(draw.randrange(14)))
        assert repair.cheapest(symbols, "", repair.ACCEPTED) == best(symbols), symbols


def test_estimate_never_exceeds_the_cost():
    draw = random.Random(9)
    for _ in range(300):
        symbols = "".join(draw.choice("suaoxUA") for _ in range(draw.randrange(8)))
        for entry in repair.FOLLOWS:
            for exits in (("",), ("s",), ("u",), ("a",), repair.ACCEPTED):
                way = repair.cheapest(symbols, entry, exits)
                assert way is None or repair.estimates(symbols, exits)(0, entry) <= way[0]


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_stretches_change_nothing(monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    draw = random.Random(stretch)
    for _ in range(150):
        size = draw.randrange(30)
        said = sorted(
            (i // 2, draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice([f"t{i}.", f"t{i}", " ", "a."]))
            for i in range(size)
        )
        talk, seen = repair.Conversation(7), set()
        out = []
        for turn, role, text in said:
            bare = text.strip()
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] == "." else "truncated"
            seen.add((role, text))
            out += talk.add(turn, role, text, fault)
        out += talk.close()
        assert talk.report() == report(7, said)
        assert hashlib.sha256("\n".join(f"{r[4]}:{r[5]}" for r in out).encode()).hexdigest() == talk.report()[-1]


HARD = [
    (None, None, None, None), (None, 1, "user", "Yes."), (1, None, "user", ""), (1, 1, "", "x."), (1, 1, "assistant", "b?"),
    (1, 1, "assistant", "b?"), (2, 5, "system", "Rules."), (2, 9, "user", "x" * 200_000 + " \n"), (2, 9, "assistant", "No!"),
    (3, 0, "user", " \t\x0b"), (4, 7, "Üser", "é."), (4, -3, "user", "One."),
] + [(5, i, "user" if i % 2 else "assistant", f"Line {i}.") for i in range(300)] + [(6, None, "user", f"{i}.") for i in range(90)]


def test_hard_cases(spark):
    base = spark.createDataFrame(HARD, SCHEMA)
    clash = base.selectExpr("*", "'x' AS ROLE", "1 AS fault", "'k' AS same", "2 AS copy", "true AS there", "3 AS nth", "4 AS dealt")
    for frame in (base, clash):
        assert rows(repair.repair_reports(repair.damaged(frame))) == sorted(
            expected(HARD), key=lambda r: (r[0] is not None, r[0] or 0)
        )
    assert rows(repair.repair_reports(repair.whole(base))) == sorted(
        expected(HARD, False), key=lambda r: (r[0] is not None, r[0] or 0)
    )


def test_turns_are_those_of_the_report(spark):
    frame = repair.damaged(spark.createDataFrame(HARD, SCHEMA))
    turns = {}
    for r in repair.repaired_turns(frame).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.repair_reports(frame).collect():
        assert hashlib.sha256("\n".join(turns.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_reports(repair.damaged(none)).count() == repair.repaired_turns(repair.damaged(none)).count() == 0


def test_conversations_by_definition(spark):
    data = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(SMALL, "conversations")]
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert rows(repair.repair_reports(repair.damaged(frame))) == sorted(expected(data))
