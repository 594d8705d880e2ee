"""Chat formatting by schema fingerprint.

Training conversations come as rows of turns, message arrays, or prompt and answer columns. The names
of a layout's nested fields identify it: their paths, sorted and hashed, are its fingerprint,
and the fingerprint selects a declarative mapping, an expression that gives the canonical
turns ``array<struct<role, text>>``. Only paths that some layout knows are hashed; of these a record may hold any, so
``LAYOUTS`` lists the fingerprint of every set of them that holds a whole layout. Tables carry their paths in their
schema, JSON records each their own, so one column may mix layouts.

Template: ``<|turn|>ROLE<|msg|>TEXT<|end|>`` per turn. Inside roles and texts every control string,
those of other well-known templates included, is broken by a backslash after its first
character; a backslash that already stands there is doubled up by one more, so that taking one
away gives the text back exactly.

Plan: functions of Spark only. Rows of turns move once, by conversation; all else is row-wise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.arrays import let, running_starts

TURN, MSG, END = "<|turn|>", "<|msg|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"
# Starts of control strings (fixed values): the template's own, and those of other chat templates.
CONTROL = "([<\\[])(\\\\*)(\\||/?s>|/?INST\\]|/?SYS>|/?think>)"
ESCAPED = "([<\\[])\\\\(\\\\*)(\\||/?s>|/?INST\\]|/?SYS>|/?think>)"


def field_paths(kind: T.DataType, above: str = "") -> list[str]:
    """Paths of all fields below a type; an array adds ``[]`` to the path of its elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{above}.{f.name}" if above else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, above + "[]")
    return [above]


def fingerprint(paths: list[str]) -> int:
    """XXH64 of the sorted paths, joined by line breaks."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(set(paths))), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _list_of(name: str, *names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(_strings(*names)))])


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes canonical turns: the record's fields and one SQL expression over them."""

    fields: T.StructType
    turns: str


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _pair(asked: str, answered: str) -> str:
    return f"array({_turn(repr('user'), asked)}, {_turn(repr('assistant'), answered)})"


# Roles by the names that other layouts use (fixed values).
ROLE = "CASE {0} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce({0}, '') END"


def _with_system(plain: Mapping) -> Mapping:
    said = f"filter(array({_turn(repr('system'), 'system')}), t -> system IS NOT NULL)"
    return Mapping(T.StructType([*_strings("system"), *plain.fields]), f"concat({said}, {plain.turns})")


# Layouts of one record per conversation, each also with a system text beside it.
_PLAIN = {
    "messages": Mapping(
        _list_of("messages", "role", "content"),
        f"transform(messages, m -> {_turn('coalesce(m.role, ' + repr('') + ')', 'm.content')})",
    ),
    "conversations": Mapping(
        _list_of("conversations", "from", "value"),
        f"transform(conversations, m -> {_turn(ROLE.format('m.`from`'), 'm.value')})",
    ),
    "prompt_completion": Mapping(_strings("prompt", "completion"), _pair("prompt", "completion")),
    "prompt_response": Mapping(_strings("prompt", "response"), _pair("prompt", "response")),
    "question_answer": Mapping(_strings("question", "answer"), _pair("question", "answer")),
    "instruction": Mapping(_strings("instruction", "output"), _pair("instruction", "output")),
    "instruction_input": Mapping(
        _strings("instruction", "input", "output"),
        _pair("concat(instruction, if(coalesce(input, '') = '', '', concat('\\n\\n', input)))", "output"),
    ),
}
MAPPINGS = _PLAIN | {f"system_{name}": _with_system(mapping) for name, mapping in _PLAIN.items()}
NEEDS = {name: sorted(set(field_paths(mapping.fields))) for name, mapping in MAPPINGS.items()}
# Layout of one row per turn.
ROWS = ["role", "text", "turn"]
# Families of layouts, by what they need and what else counts where that is there: the first that fits holds.
_LISTS = ("messages", "conversations")
_FLAT = sorted({path for name, needs in NEEDS.items() if not name.endswith(_LISTS) for path in needs})
FAMILIES = [*((NEEDS[name], ["system"]) for name in _LISTS), ([], _FLAT)]


def layout_of(paths: Iterable[str]) -> str | None:
    """The layout with the most paths among those whose paths are all there, of several the first of ``MAPPINGS``."""
    fits = [name for name, needs in NEEDS.items() if set(needs) <= set(paths)]
    return max(fits, key=lambda name: len(NEEDS[name]), default=None)


def layouts() -> dict[int, str]:
    """Layout by fingerprint, of every set of known paths that has one: some 300 of them."""
    found = {}
    for needs, others in FAMILIES:
        for size in range(len(others) + 1):
            for more in combinations(others, size):
                found[fingerprint([*needs, *more])] = layout_of([*needs, *more])
    return {value: name for value, name in found.items() if name}


LAYOUTS = layouts()


def table_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key`` and canonical ``turns`` of a table in any of the known layouts.

    Fields that no layout knows are ignored; a table whose fields hold no whole layout is an error that lists them.
    Rows of turns (``turn``, ``role`` and ``text``) are put together by ``key`` in the order of ``turn`` (nulls
    first), ties by role and text; repeated rows are repeated turns; null keys are one
    conversation. Null roles and texts are empty, a null system text is no turn.
    """
    paths = set(field_paths(rows.drop(key).schema))
    if paths.issuperset(ROWS):
        part = F.struct("turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
        together = rows.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        turns = F.transform("parts", lambda p: F.struct(p["role"], p["text"])).cast(TURNS)
        return together.select(key, turns.alias("turns"))
    known = next({*needs, *others} for needs, others in FAMILIES if paths.issuperset(needs))
    layout = LAYOUTS.get(fingerprint(sorted(paths & known)))
    if layout is None:
        raise ValueError(f"no mapping for fields {sorted(paths)}")
    return rows.select(key, F.expr(MAPPINGS[layout].turns).cast(TURNS).alias("turns"))


def json_paths(record: Column) -> Column:
    """Sorted distinct field paths of a JSON object, two levels deep: enough for every known layout.

    Arrays give the paths of all their elements that are objects.
    """
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def element_keys(path: str) -> Column:
        elements = F.from_json(F.get_json_object(record, path), "array<string>")
        found = F.filter(F.transform(elements, lambda e: F.json_object_keys(e)), lambda k: k.isNotNull())
        return F.array_distinct(F.flatten(found))

    def below(name: Column) -> Column:
        inner = F.when(name == "messages", element_keys("$.messages")).when(
            name == "conversations", element_keys("$.conversations")
        )
        return F.when(F.coalesce(F.size(inner), F.lit(0)) <= 0, F.array(name)).otherwise(
            F.transform(inner, lambda k: F.concat(name, F.lit("[]."), k))
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(keys, below))))


def layout_by_hash(paths: Column) -> Column:
    """The layout that the fingerprint of a record's known paths selects, if any."""

    def strings(values: list[str]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    counted = [
        F.when(F.size(F.array_except(strings(needs), paths)) == 0, F.array_intersect(paths, strings([*needs, *others])))
        for needs, others in FAMILIES
    ]
    found = F.xxhash64(F.array_join(F.array_sort(F.coalesce(*counted)), "\n"))
    own = {name: [value for value, layout in LAYOUTS.items() if layout == name] for name in MAPPINGS}
    return let(found, lambda value: F.coalesce(*[F.when(value.isin(own[name]), F.lit(name)) for name in MAPPINGS]))


def _said(value: Column) -> Column:
    """Text of a variant: a string or other scalar as it is; of a list, the texts of its parts by line."""

    def part(p: Column) -> Column:
        is_object = F.schema_of_variant(p).startswith("OBJECT")
        return F.when(is_object, F.try_variant_get(p, "$.text", "string")).otherwise(F.try_variant_get(p, "$", "string"))

    parts = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), lambda t: t.isNotNull())
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(is_list, F.array_join(parts, "\n")).otherwise(F.try_variant_get(value, "$", "string"))


def parsed(record: Column, fields: T.StructType) -> Column:
    """Struct of a JSON record's fields; in lists of messages every value may be a text or a list of parts."""
    loose = [
        T.StructField(f.name, T.ArrayType(T.StructType([T.StructField(m.name, T.VariantType()) for m in f.dataType.elementType])))
        if isinstance(f.dataType, T.ArrayType)
        else f
        for f in fields
    ]

    def messages(values: Column, names: list[str]) -> Column:
        return F.transform(values, lambda m: F.struct(*[_said(m[name]).alias(name) for name in names]))

    def strict(whole: Column) -> Column:
        return F.struct(
            *[
                (messages(whole[f.name], f.dataType.elementType.names) if isinstance(f.dataType, T.ArrayType) else whole[f.name]).alias(f.name)
                for f in fields
            ]
        )

    return let(F.from_json(record, T.StructType(loose)), strict)


def json_turns(rows: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``key``, ``layout`` and canonical ``turns`` of JSON records of mixed layouts.

    The hash of a record's known paths selects its layout; its other fields are ignored. Where it holds several
    layouts, lists of messages go before single fields, then more paths before fewer, then the first of ``MAPPINGS``. A system
    text beside any layout is the first turn. The text of a message may be a list of parts: their texts are joined by line
    breaks, parts without a text (images) left out. A record that is null, no object or of no known layout has the
    layout null and no turns; repeated rows give repeated rows. Other columns are not read.
    """
    turns, layout = F.lit(None).cast(TURNS), F.col("layout")
    marked = rows.select(key, F.col(record).alias("record"), json_paths(F.col(record)).alias("paths"))
    marked = marked.select(key, "record", layout_by_hash(F.col("paths")).alias("layout"))
    own = {f"as_{name}": F.when(layout == name, parsed(F.col("record"), m.fields)) for name, m in MAPPINGS.items()}
    marked = marked.withColumns(own)
    for name, mapping in MAPPINGS.items():
        mapped = F.expr(_inside(mapping.turns, mapping.fields.names, f"as_{name}")).cast(TURNS)
        turns = F.when(layout == name, mapped).otherwise(turns)
    return marked.select(key, layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def _inside(expression: str, fields: list[str], struct: str) -> str:
    """The expression with its fields read from a struct column."""
    for field in fields:
        expression = re.sub(rf"(?<![\w.'`]){field}(?![\w'`])", f"`{struct}`.`{field}`", expression)
    return expression


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1\\\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chat(turns: DataFrame, key: str = "conv_id", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``key``, ``formatted`` and ``loss_spans``: code points (start, length) of the trained turns' texts.

    A conversation without turns formats to an empty text.
    """

    def part(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), escaped(t["role"]).alias("shown"), escaped(t["text"]).alias("text"))

    parts = F.transform("turns", part)
    rows = turns.select(key, parts.alias("parts"))
    head = len(TURN) + len(MSG)

    def turn_size(p: Column) -> Column:
        return F.length(p["shown"]) + F.length(p["text"]) + head + len(END)

    rows = rows.withColumn("sizes", F.transform("parts", turn_size))
    rows = rows.withColumn("starts", running_starts(F.col("sizes")))
    written = F.transform("parts", lambda p: F.concat(F.lit(TURN), p["shown"], F.lit(MSG), p["text"], F.lit(END)))
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            (F.get(F.col("starts"), i) + F.length(p["shown"]) + head).alias("start"),
            F.length(p["text"]).cast("long").alias("length"),
            p["role"].isin(*trained).alias("is_trained"),
        ),
    )
    masked = F.transform(F.filter(spans, lambda s: s["is_trained"]), lambda s: F.struct(s["start"], s["length"]))
    return rows.select(key, F.array_join(written, "").alias("formatted"), masked.alias("loss_spans"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, ``turns`` and ``loss_text`` as read from formatted conversations and their spans."""
    pieces = F.filter(F.split("formatted", "<\\|end\\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, MSG)
        return F.struct(
            unescaped(F.substr(p, F.lit(len(TURN) + 1), at - 1 - len(TURN))).alias("role"),
            unescaped(F.substr(p, at + len(MSG))).alias("text"),
        )


    def under_mask(s: Column) -> Column:
        start, length = (s["start"] + 1).cast("int"), s["length"].cast("int")
        return unescaped(F.substr(F.col("formatted"), start, length))

    under = F.transform("loss_spans", under_mask)
    return formatted.select(
        key, F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted"
    )
