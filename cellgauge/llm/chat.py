"""Chat formatting: a fingerprint of the nested field paths selects a declarative mapping to turns.

Records reach one canonical form, `turns array<struct<role, text>>`, and are rendered with a
template whose control strings are escaped inside texts, so the output can be read back exactly.
Everything is a DataFrame expression.

Escapes: a backslash becomes backslash-s, `<|` becomes backslash-l and, in roles, a line end
becomes backslash-n. After that no text holds `<|`, and every backslash starts one escape.

Null roles and texts are empty. Turns are ordered by turn (nulls first), then role, then text,
so ties and repeated rows have one order. A null conversation id is a conversation of its own.
A conversation is one output row, so its rows do meet in one task.
An empty table gives an empty one. Columns that an operator adds (`layout`, `turns`, `formatted`,
`loss_spans`) replace those of the same name; others of the table stay as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """paths: the field paths that identify a layout; turns: (role, path) pairs, or the array that holds them."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    roles: dict = field(default_factory=dict, hash=False)

    @property
    def fingerprint(self) -> str:
        return paths_fingerprint(self.paths)


#: Layouts in common public use.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn")),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), array="messages", role="role", text="content"),
    Mapping("share", ("conversations", "conversations[].from", "conversations[].value"), array="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def paths_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; `[]` stands for an array's elements."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += [path, *schema_paths(f.dataType, path)]
    return out


def known_paths(mappings=MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in m.paths})


def schema_mapping(schema: T.StructType, mappings=MAPPINGS) -> Mapping | None:
    """The mapping with the most paths whose fingerprint the schema's paths among them have; other fields don't count."""
    paths = schema_paths(schema)
    return next((m for m in by_size(mappings) if paths_fingerprint([p for p in paths if p in m.paths]) == m.fingerprint), None)


def by_size(mappings) -> list[Mapping]:
    return sorted(mappings, key=lambda m: -len(m.paths))


def record_fingerprint(json: Column, mappings=MAPPINGS) -> Column:
    """The fingerprint of the mapping with the most paths that a JSON record has, else that of all its known paths."""
    top = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    arrays = sorted({m.array for m in mappings if m.array})
    nested = [_prefixed(f"{a}[].", F.json_object_keys(F.get_json_object(json, f"$.{a}[0]"))) for a in arrays]
    paths = F.array_distinct(F.concat(top, *nested))

    def among(wanted) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in wanted]))), "\n"), 256)

    out = among(known_paths(mappings))
    for m in reversed(by_size(mappings)):
        out = F.when(among(m.paths) == m.fingerprint, F.lit(m.fingerprint)).otherwise(out)
    return out


def record_turns(json: Column, fingerprint: Column, mappings=MAPPINGS) -> Column:
    """Canonical turns of one JSON record under the mapping that its fingerprint selects; null for an unknown layout."""
    out = F.lit(None).cast(TURNS)
    for m in mappings:
        if m.array:
            rows = F.from_json(F.get_json_object(json, f"$.{m.array}"), f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            turns = _from_array(rows, m)
        elif m.turns:
            turns = F.array(*[F.struct(F.lit(role).alias("role"), _joined([F.get_json_object(json, f"$.{p}") for p in paths]).alias("text")) for role, paths in m.turns])
        else:
            continue
        out = F.when(fingerprint == m.fingerprint, turns).otherwise(out)
    return out


def _prefixed(prefix: str, keys: Column) -> Column:
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(prefix), k))


def _from_array(rows: Column, m: Mapping) -> Column:
    return F.transform(rows, lambda r: F.struct(_renamed(r[m.role], m.roles).alias("role"), F.coalesce(r[m.text], F.lit("")).alias("text")))


def _renamed(role: Column, names: dict) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in names.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), "\n")


def turns_of_records(df: DataFrame, json: str, mappings=MAPPINGS) -> DataFrame:
    """df with `layout` (the fingerprint) and `turns` for a column of JSON records in mixed layouts."""
    return df.withColumn("layout", record_fingerprint(F.col(json), mappings)).withColumn("turns", record_turns(F.col(json), F.col("layout"), mappings))


def turns_of_rows(df: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """conv_id and `turns` for a table with one row per turn; its schema's fingerprint must select that layout."""
    m = schema_mapping(df.schema, mappings)
    if m is None or m.name != "turn_rows":
        raise ValueError("no mapping for this layout")
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return rows.select("conv_id", F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def render(df: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_spans`: (start, length) in code points of each assistant text, from 0."""
    pieces = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    held = free(df, "_pieces")
    df = df.withColumn(held, pieces)
    tail = len(END) + 1
    ends = F.aggregate(
        held,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + tail).alias("at"),
            F.when(p["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform(held, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return df.withColumn("formatted", text).withColumn("loss_spans", ends).drop(held)


def read_back(formatted: Column) -> Column:
    """Turns parsed from a rendered string."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s, i: i > 0)
    bodies = F.transform(parts, lambda s: F.substring_index(s, END, 1))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, one text after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_chats(df: DataFrame, mappings=MAPPINGS, json: str | None = None) -> DataFrame:
    """Canonical turns rendered as `formatted` with `loss_spans`, for rows by turn or for JSON records."""
    return render(turns_of_records(df, json, mappings) if json else turns_of_rows(df, mappings))
