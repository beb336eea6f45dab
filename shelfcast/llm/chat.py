"""Bring conversations of different layouts into one template, with a loss mask.

A row's layout is recognised by a fingerprint: the hash of the nested field paths
it fills, out of those some mapping knows. The fingerprint selects a declarative
mapping into canonical turns (role, text). The template marks turns with control
strings; a backslash breaks up control strings inside texts, so the formatted
text can be read back exactly. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
# Strings a text must not hold as they are.
CONTROL = (OPEN, MIDDLE, CLOSE, "<s>")
LEARNED_ROLES = ("assistant",)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS_TYPE = "array<struct<role:string,text:string>>"


def turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else F.coalesce(role.cast("string"), F.lit(""))
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def known_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLE_NAMES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


@dataclass(frozen=True)
class Layout:
    """The field paths of a layout and the turns they make."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column]


def _instruction(more: bool) -> Callable[[], Column]:
    def turns() -> Column:
        ask = F.coalesce(F.col("instruction"), F.lit(""))
        if more:
            ask = F.when(F.col("input") != "", F.concat_ws("\n\n", ask, F.col("input"))).otherwise(ask)
        return F.array(turn("user", ask), turn("assistant", F.col("output")))

    return turns


def _pair(ask: str, answer: str, system: bool = False) -> Callable[[], Column]:
    def turns() -> Column:
        first = [turn("system", F.col("system"))] if system else []
        return F.array(*first, turn("user", F.col(ask)), turn("assistant", F.col(answer)))

    return turns


LAYOUTS = (
    Layout(
        "messages",
        ("messages[].content", "messages[].role"),
        lambda: F.transform("messages", lambda m: turn(m["role"], m["content"])),
    ),
    Layout(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        lambda: F.transform("conversations", lambda m: turn(known_role(m["from"]), m["value"])),
    ),
    Layout(
        "numbered",
        ("turns[].role", "turns[].text", "turns[].turn"),
        lambda: F.transform(
            F.array_sort(F.transform("turns", lambda m: F.struct(m["turn"], m["role"], m["text"]))),
            lambda m: turn(m["role"], m["text"]),
        ),
    ),
    Layout("instruction", ("instruction", "output"), _instruction(False)),
    Layout("instruction_input", ("input", "instruction", "output"), _instruction(True)),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("system_prompt_response", ("prompt", "response", "system"), _pair("prompt", "response", True)),
)


def field_paths(schema: T.StructType) -> dict[str, Column]:
    """Each leaf path of a schema and whether a row fills it; [] stands for the elements of an array."""
    found: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, at: Column) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                name = f"{path}.{field.name}" if path else field.name
                walk(field.dataType, name, at[field.name] if path else F.col(f"`{field.name}`"))
        elif isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.StructType):
                for field in inner.fields:
                    found[f"{path}[].{field.name}"] = at.isNotNull()
            else:
                found[f"{path}[]"] = at.isNotNull()
        else:
            found[path] = at.isNotNull()

    walk(schema, "", F.lit(None))
    return found


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "|"))


def with_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` plus layout and canonical_turns (earlier columns of these names go).

    Only paths some layout knows count, so extra columns do not matter. A row
    that fills the paths of no layout has a null layout and no turns. Null texts
    and roles are empty.
    """
    df = df.drop("layout", "canonical_turns")
    filled = field_paths(df.schema)
    known = sorted({p for layout in layouts for p in layout.paths})
    present = F.array(*[F.when(filled[p], p) for p in known if p in filled]).cast("array<string>")
    print_of_row = fingerprint(F.filter(present, lambda p: p.isNotNull()))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS_TYPE)
    for layout in layouts:
        if all(p in filled for p in layout.paths):
            hit = F.col("__layout_print") == fingerprint(F.array(*[F.lit(p) for p in layout.paths]))
            name = F.when(hit, layout.name).otherwise(name)
            turns = F.when(hit, layout.turns().cast(TURNS_TYPE)).otherwise(turns)
    turns = F.coalesce(turns, F.array().cast(TURNS_TYPE))
    return df.withColumn("__layout_print", print_of_row).withColumns({"layout": name, "canonical_turns": turns}).drop("__layout_print")


def gather_rows(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows by turn as one row per conversation, in the numbered layout.

    Turns are ordered by (turn, role, text), nulls first; repeated rows are
    repeated turns. A conversation becomes one value, as its output is one text.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy(id_col).agg(F.collect_list(one).alias("turns"))


def escape(text: Column) -> Column:
    """A backslash before every backslash, and after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, learned: tuple[str, ...] = LEARNED_ROLES) -> DataFrame:
    """``df`` plus formatted and loss_spans (earlier columns of these names go).

    A turn is ``[INST]role[/INST]text</s>``. A loss span is (turn, start, length):
    the code points of a learned role's text, counted from the turn's beginning.
    """
    df = df.drop("formatted", "loss_spans")
    pieces = F.transform(
        "canonical_turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    )
    spans = F.transform(
        "canonical_turns",
        lambda t, i: F.when(
            t["role"].isin(*learned),
            F.struct(
                i.alias("turn"),
                (F.char_length(escape(t["role"])) + len(OPEN) + len(MIDDLE)).alias("start"),
                F.char_length(escape(t["text"])).alias("length"),
            ),
        ),
    )
    return df.withColumns(
        {"formatted": F.array_join(pieces, ""), "loss_spans": F.filter(spans, lambda s: s.isNotNull())}
    )


def read_back(df: DataFrame) -> DataFrame:
    """``df`` plus read_turns and read_loss (the texts under the mask), from formatted and loss_spans alone."""
    pieces = F.split("formatted", CLOSE, -1)
    df = df.withColumn("__turn_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    turns = F.transform(
        "__turn_pieces",
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.get(F.col("__turn_pieces"), s["turn"]), s["start"] + 1, s["length"]))
    )
    return df.withColumns({"read_turns": turns, "read_loss": loss}).drop("__turn_pieces")
