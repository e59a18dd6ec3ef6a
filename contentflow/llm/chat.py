"""Chat formatting from layouts recognised by a fingerprint of their fields.

A record's layout is the set of its nested field paths. The paths that any
mapping names are sorted and hashed, and the hash picks a declarative mapping
from the layout to canonical turns (conversation, turn, role, text). A frame is
recognised once from its schema, a JSON text row by row. Turns become one
formatted string per conversation, with the places of the assistant texts as
the loss mask, and can be read back exactly.

Everything is DataFrame functions. One exchange by conversation serves the
running offsets and the grouping.

Defined results: null text and null role are empty; null turns come first;
turns with equal numbers are ordered by role and text and all kept; a null
conversation id is a conversation of its own; records of no known layout are
returned by ``unrecognised``; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Characters that can start a control string, and what stands for them inside a text. The first escapes the escapes.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"))
ASSISTANT = "assistant"

#: Names of roles in other layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``paths`` recognise it; ``turns`` lists (role, field paths joined by a blank line), or ``each`` names an array with (role, text) fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    flat: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), flat=("turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout("prompt_messages", ("prompt[].content", "prompt[].role"), each=("prompt", "role", "content")),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", ("instruction", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({path for layout in layouts for path in layout.paths})


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths down to plain values; an array adds ``[]``."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.StructType):
        dot = prefix + "." if prefix else ""
        return [path for field in schema for path in schema_paths(field.dataType, dot + field.name)]
    return [prefix]


def _canonical(conv: Column, turn: Column, role: Column, text: Column) -> list[Column]:
    plain = F.coalesce(role, F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return [conv.alias("conv_id"), turn.cast("bigint").alias("turn"), F.coalesce(F.get(F.array(F.try_element_at(names, plain)), F.lit(0)), plain).alias("role"), F.coalesce(text, F.lit("")).alias("text")]


def _turns(layout: Layout, field, array) -> Column:
    """Array of (role, text) for a layout whose fields are read by ``field`` and whose array by ``array``."""
    if layout.each:
        name, role, text = layout.each
        return F.transform(array(name, role, text), lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.nullif(field(f), F.lit("")) for f in fields]).alias("text")) for role, fields in layout.turns])


def recognised(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout whose fingerprint the frame's known paths have."""
    known, own = set(known_paths(layouts)), set(schema_paths(schema))
    found = fingerprint(own & known)
    return {fingerprint(layout.paths): layout for layout in layouts}.get(found)


def canonical_turns(rows: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a frame in any known layout."""
    layout = recognised(rows.schema, layouts)
    if layout is None:
        raise ValueError(f"no layout has the fields {schema_paths(rows.schema)}")
    if layout.flat:
        turn, role, text = layout.flat
        return rows.select(*_canonical(F.col(key), F.col(turn), F.col(role), F.col(text)))
    pairs = rows.select(F.col(key).alias("_key"), F.posexplode(_turns(layout, F.col, lambda name, *_: F.col(name))).alias("_turn", "_pair"))
    return pairs.select(*_canonical(F.col("_key"), F.col("_turn"), F.col("_pair.role"), F.col("_pair.text")))


def json_fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Fingerprint of a JSON text: the known paths that occur in it, sorted and hashed."""

    def present(path: str) -> Column:
        name, _, inner = path.partition("[].")
        if inner:
            first = F.get_json_object(record, f"$.{name}[0]")
            return F.array_contains(F.json_object_keys(first), inner)
        value = F.get_json_object(record, f"$.{name}")
        return F.array_contains(F.json_object_keys(record), name) & ~F.coalesce(value.startswith("["), F.lit(False))

    nested = tuple(layout for layout in layouts if not layout.flat)
    found = F.array(*[F.when(F.coalesce(present(path), F.lit(False)), F.lit(path)) for path in known_paths(nested)])
    return F.sha2(F.array_join(found, "\n"), 256)


def canonical_json(rows: DataFrame, record: str, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records, each in a layout of its own."""
    marked = rows.withColumn("_mark", json_fingerprint(F.col(record), layouts))

    def array(name: str, role: str, text: str) -> Column:
        return F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")

    choice = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        if not layout.flat:
            turns = _turns(layout, lambda f: F.get_json_object(record, f"$.{f}"), array)
            choice = F.when(F.col("_mark") == fingerprint(layout.paths), turns).otherwise(choice)
    pairs = marked.select(F.col(key).alias("_key"), F.posexplode(choice).alias("_turn", "_pair"))
    return pairs.select(*_canonical(F.col("_key"), F.col("_turn"), F.col("_pair.role"), F.col("_pair.text")))


def unrecognised(rows: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """JSON records of no known layout, as they came."""
    marks = [fingerprint(layout.paths) for layout in layouts if not layout.flat]
    return rows.where(~F.coalesce(json_fingerprint(F.col(record), layouts).isin(marks), F.lit(False)))


def escaped(text: Column, line: bool = False) -> Column:
    for plain, code in ESCAPES + ((("\n", "&nl;"),) if line else ()):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, line: bool = False) -> Column:
    for plain, code in reversed(ESCAPES + ((("\n", "&nl;"),) if line else ())):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the conversation as one string and the places of its assistant texts in it."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), line=True), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = "coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    rows = rows.withColumn("at", F.expr(before).cast("bigint"))
    place = F.when(F.col("role") == ASSISTANT, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length")))
    pieces = F.array_sort(F.collect_list(F.struct("at", "piece", place.alias("place"))))
    return rows.groupBy("conv_id").agg(pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("pieces", lambda p: p["place"]), lambda p: p.isNotNull()).alias("loss_mask"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring(F.substring_index(p, "\n", 1), len(OPEN) + 1, 2147483647), line=True).alias("role"),
            unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_loss(text: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(mask, lambda m: unescaped(F.substr(text, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
