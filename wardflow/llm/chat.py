"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record (JSON text) is fingerprinted: the nested field paths it has, out of those the mappings
mention, are hashed. The hash selects a declarative mapping, which turns prompt, instruction and
message layouts into canonical turns (role, text). A record whose paths are no mapping's own, because
it has fields of several layouts, takes the first layout in the order of LAYOUTS whose required paths
are all there; fields that this layout does not name are left out. A template marks turns; control strings inside
texts are escaped reversibly, and `read_back` undoes both. Loss spans cover the assistant texts.

Defined results: a null text or role counts as empty; a record of no known layout (null, not JSON,
other fields) gives no turns and a null layout; rows without turns format to the empty string.
Repeated rows are turns of their own; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Strings that steer common chat models; inside texts they are escaped.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|begin_of_text|>",
    "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>",
)
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How one layout of records maps to turns. Paths are relative to the record or its list.

    turns: (role or path of the role, paths of the text's parts), in order; a turn whose parts are
    all absent is left out. lead: turns like these from the record itself, ahead of those of its list;
    one whose role the list has is left out.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    list_path: str | None = None
    lead: tuple[tuple[str, tuple[str, ...]], ...] = ()


_SYSTEM = ("system", ("$.system",))
#: In order of precedence for records that have the fields of several: whole lists first, one turn last.
LAYOUTS = (
    Layout("messages", (("$.role", ("$.content",)),), ("$.messages", "$.messages[0].role", "$.messages[0].content"),
           ("$.system",), list_path="$.messages", lead=(_SYSTEM,)),
    Layout("conversations", (("$.from", ("$.value",)),),
           ("$.conversations", "$.conversations[0].from", "$.conversations[0].value"), ("$.system",),
           list_path="$.conversations", lead=(_SYSTEM,)),
    Layout("instruction", (_SYSTEM, ("user", ("$.instruction", "$.context", "$.input")), ("assistant", ("$.output",))),
           ("$.instruction", "$.output"), ("$.context", "$.input", "$.system")),
    Layout("instruction_response",
           (_SYSTEM, ("user", ("$.instruction", "$.context", "$.input")), ("assistant", ("$.response",))),
           ("$.instruction", "$.response"), ("$.context", "$.input", "$.system")),
    Layout("question", (_SYSTEM, ("user", ("$.context", "$.question")), ("assistant", ("$.answer",))),
           ("$.question", "$.answer"), ("$.context", "$.system")),
    Layout("prompt", (_SYSTEM, ("user", ("$.context", "$.prompt", "$.input")), ("assistant", ("$.response",))),
           ("$.prompt", "$.response"), ("$.context", "$.input", "$.system")),
    Layout("completion", (_SYSTEM, ("user", ("$.context", "$.prompt", "$.input")), ("assistant", ("$.completion",))),
           ("$.prompt", "$.completion"), ("$.context", "$.input", "$.system")),
    Layout("turn", (("$.role", ("$.text",)),), ("$.role", "$.text")),
)
PATHS = sorted({p for x in LAYOUTS for p in x.required + x.optional})
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_fingerprints(layouts=LAYOUTS) -> dict[str, str]:
    """Fingerprint -> layout, for each layout with any of its optional paths."""
    return {
        fingerprint_of((*x.required, *some)): x.name
        for x in layouts for n in range(len(x.optional) + 1) for some in combinations(x.optional, n)
    }


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths, known to some mapping, that a variant record has."""
    present = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in PATHS]
    return F.sha2(F.concat_ws("\n", *present).cast("binary"), 256)  # absent ones are null and left out


def first_complete(record: Column, layouts=LAYOUTS) -> Column:
    """Name of the first layout whose required paths the record all has, or null."""
    name = F.lit(None).cast("string")
    for x in reversed(layouts):
        there = [F.try_variant_get(record, p, "variant").isNotNull() for p in x.required]
        name = F.when(reduce(Column.__and__, there), F.lit(x.name)).otherwise(name)
    return name


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _turns(turns: tuple[tuple[str, tuple[str, ...]], ...], record: Column) -> Column:
    made = []
    for role, parts in turns:
        name = F.coalesce(_text(record, role), F.lit("")) if role.startswith("$") else F.lit(role)
        there = F.lit(True) if role.startswith("$") else F.coalesce(*[_text(record, p) for p in parts]).isNotNull()
        filled = F.filter(F.array(*[_text(record, p) for p in parts]), lambda t: t.isNotNull() & (t != ""))
        turn = F.struct(name.alias("role"), F.concat_ws("\n", filled).alias("text"))
        made.append(F.when(there, turn))
    return F.array_compact(F.array(*made))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds `layout` and `turns` to rows with a JSON text or a variant."""
    found = F.create_map(*[F.lit(x) for pair in known_fingerprints().items() for x in pair])
    is_variant = dict(records.dtypes)[record] == "variant"
    parsed = records.withColumn("_v", F.col(record) if is_variant else F.try_parse_json(F.col(record)))
    exact = F.try_element_at(found, fingerprint(F.col("_v")))
    named = parsed.withColumn("layout", F.coalesce(exact, first_complete(F.col("_v"))))
    turns = F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        if x.list_path:
            items = F.try_variant_get("_v", x.list_path, "array<variant>")
            # roles of lists go by several names
            each = F.flatten(F.transform(items, partial(_turns, x.turns)))
            alias = F.create_map(*[F.lit(s) for pair in ROLES.items() for s in pair])
            each = F.transform(each, lambda t: F.struct(
                F.coalesce(F.try_element_at(alias, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))
            lead = _turns(x.lead, F.col("_v"))
            each = F.concat(F.filter(lead, lambda t: ~F.exists(each, lambda u: u["role"] == t["role"])), each)
        else:
            each = _turns(x.turns, F.col("_v"))
        turns = F.when(F.col("layout") == x.name, each).otherwise(turns)
    return named.withColumn("turns", F.coalesce(turns, F.array().cast(TURNS))).drop("_v")


def _inside() -> str:
    """A backslash, or the place after the first character of a control string."""
    by_first: dict[str, list[str]] = {}
    for c in CONTROL:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    places = [rf"(?<={re.escape(a)})(?=(?:{'|'.join(rest)}))" for a, rest in sorted(by_first.items())]
    return "|".join([r"\\", *places])


def escaped(text: Column) -> Column:
    """Each control string gets a backslash after its first character, each backslash a second one."""
    return F.regexp_replace(text, F.lit(_inside()), F.lit(r"\\$0"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"))


def format_turns(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per conversation from one row per turn (role, text): formatted text and loss spans.

    Turns are sorted by `order`, then role and text, so that ties have one result. The running length
    of the formatted turns places the loss spans; window and grouping share one shuffle.
    """
    piece = F.concat(head(F.col("role")), escaped(F.col("text")), F.lit(CLOSE))
    place = Window.partitionBy(*by).orderBy(*order, "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece").cast("long")).over(place)
    rows = turns.withColumn("piece", piece).withColumn("end", end).withColumn("at", F.row_number().over(
        Window.partitionBy(*by).orderBy(*order, "role", "text")))
    stop = F.col("end") - len(CLOSE)
    start = F.col("end") - F.length("piece") + F.length(head(F.col("role")))
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), stop.alias("end")))
    one = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("all"))
    return one.select(
        *by, F.concat_ws("", F.col("all.piece")).alias("formatted"),
        F.array_compact(F.col("all.span")).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    pieces = F.split(formatted, re.escape(CLOSE[:-1]) + "\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        first = F.substring_index(piece, "\n", 1)
        return F.struct(
            F.url_decode(F.substr(first, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(piece, F.length(first) + 2)).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    parts = F.transform(
        spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return F.concat_ws("", parts)


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """Format rows (conv_id, turn, role, text), then report what the output says when read back."""
    record = F.to_variant_object(F.struct("role", "text"))
    turns = canonical(rows.select("conv_id", "turn", record.alias("record")))
    turns = turns.select("conv_id", "turn", F.inline("turns"))
    done = format_turns(turns, ["conv_id"], ["turn"])
    back = done.withColumns({"said": read_back(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.concat_ws("", F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
