"""Chat formatting with DataFrame functions only.

A record's layout is recognised by a fingerprint: the hash of its nested field paths, as far as a layout
of ``LAYOUTS`` knows them, so additional fields don't matter.  The fingerprint selects a declarative mapping (a SQL
expression) to canonical turns, an ``array<struct<turn, role, text>>``.  Frames are recognised by their
schema (:func:`canonical_turns`), records in JSON one by one (:func:`canonical_json`).

Each canonical turn is then written between the marks of its role.  Where a text holds a control string,
a backslash is put before it (and before the backslashes that precede it), so marks are never ambiguous
and :func:`read_back` restores every turn exactly.  The loss mask is a list of character spans over the
formatted text, one for each assistant text.

Defined results: a null text or role is empty; roles other than user, assistant and system keep their name
in their mark; turns that tie are ordered by role and text and all stay; a null turn number comes first; an
empty table gives no conversations; records of an unknown layout give no turns and ``layout`` null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<turn:bigint,role:string,text:string>>"

#: Names that layouts use for the roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Field paths that identify a layout, and the SQL expression from it to turns (None: a row is a turn)."""

    name: str
    paths: tuple[str, ...]
    turns: str | None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def _pairs(*parts: tuple[str, str]) -> str:
    """Turns from single fields; a system or user field that is empty and not the first is left out by its mapping."""
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {e})" for r, e in parts) + ")"


def _with_input(instruction: str, given: str) -> str:
    return f"concat({instruction}, if(coalesce({given}, '') = '', '', concat('\\n\\n', {given})))"


LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), None),
    Layout("messages", ("messages[].role", "messages[].content"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), "transform(conversations, m -> named_struct('role', m.`from`, 'text', m.value))"),
    Layout("system_instruction", ("system", "instruction", "input", "output"), _pairs(("system", "system"), ("user", _with_input("instruction", "input")), ("assistant", "output"))),
    Layout("instruction_input", ("instruction", "input", "output"), _pairs(("user", _with_input("instruction", "input")), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), _pairs(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("prompt", "completion"), _pairs(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), _pairs(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), _pairs(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; elements of arrays are marked by []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(schema: T.StructType) -> Layout | None:
    """The first layout whose fingerprint is that of the paths which the schema shares with it."""
    found = set(field_paths(schema))
    return next((x for x in LAYOUTS if fingerprint(found & set(x.paths)) == x.fingerprint), None)


def _numbered(turns: Column) -> Column:
    """Canonical turns from an array of role and text."""
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))

    def one(t: Column, i: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        return F.struct(
            i.cast("long").alias("turn"),
            F.coalesce(F.try_element_at(names, role), role).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        )

    return F.transform(turns, one)


def canonical_turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, conv_id and turns, from a frame in any known layout."""
    layout = layout_of(records.schema)
    if layout is None:
        raise ValueError(f"no layout has these fields: {sorted(field_paths(records.schema))}")
    if layout.turns is not None:
        return records.select(F.col(id_col).cast("long").alias("conv_id"), _numbered(F.expr(layout.turns)).alias("turns"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return records.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _json_shape() -> str:
    """One schema with the fields of all layouts, every leaf a string."""
    fields: dict[str, list[str]] = {}
    for path in dict.fromkeys(p for x in LAYOUTS if x.turns is not None for p in x.paths):
        name, _, inner = path.partition("[].")
        fields.setdefault(name, []).extend([inner] if inner else [])
    shapes = []
    for name, inner in fields.items():
        struct = ",".join(f"`{i}`:string" for i in inner)
        shapes.append(f"`{name}` array<struct<{struct}>>" if inner else f"`{name}` string")
    return ", ".join(shapes)


def canonical_json(records: DataFrame, record_col: str = "record", id_col: str = "conv_id") -> DataFrame:
    """One row per record: conv_id, layout and turns, from JSON objects whose layouts differ from row to row."""
    record = F.col(record_col)
    found = F.coalesce(F.json_object_keys(record), F.array())
    for name in sorted({p.split("[].")[0] for x in LAYOUTS for p in x.paths if "[]." in p}):
        inner = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
        marked = F.split(F.concat(F.lit(f"{name}[]."), F.array_join(inner, f"\n{name}[].")), "\n")
        found = F.concat(found, F.coalesce(marked, F.array()))
    parsed = records.select(
        F.col(id_col).cast("long").alias("__id"), found.alias("__found"), F.from_json(record, _json_shape()).alias("__parsed")
    ).select("__id", "__found", "__parsed.*")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed([x for x in LAYOUTS if x.turns is not None]):
        shared = F.array_intersect("__found", F.array(*map(F.lit, x.paths)))
        same = F.sha2(F.array_join(F.array_sort(shared), "\n"), 256) == x.fingerprint
        layout = F.when(same, F.lit(x.name)).otherwise(layout)
        turns = F.when(same, _numbered(F.expr(x.turns))).otherwise(turns)
    none = F.array().cast(TURNS)
    return parsed.select(F.col("__id").alias("conv_id"), layout.alias("layout"), F.coalesce(turns, none).alias("turns"))


#: Marks of the roles; any other role's name goes into its mark in base 64.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE:", "] ", " [/ROLE]")
_CONTROL = r"(?:</?s>|\[/?INST\]|<</?SYS>>|\[ROLE:|\[/ROLE\])"
_ONE_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE:[A-Za-z0-9+/=]*\] .*? \[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{_CONTROL})", "$1")


def _open(role: Column) -> Column:
    mark = F.concat(F.lit(OTHER[0]), F.base64(F.encode(role, "utf-8")), F.lit(OTHER[1]))
    for name, (start, _) in MARKS.items():
        mark = F.when(role == name, F.lit(start)).otherwise(mark)
    return mark


def _close(role: Column) -> Column:
    mark = F.lit(OTHER[2])
    for name, (_, end) in MARKS.items():
        mark = F.when(role == name, F.lit(end)).otherwise(mark)
    return mark


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, the formatted text, and the loss mask as spans [start, stop) of its characters."""
    written = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("loss"),
            _open(t["role"]).alias("open"),
            escape(t["text"]).alias("body"),
            _close(t["role"]).alias("close"),
        ),
    )
    step = lambda acc, w: F.struct(
        (acc["at"] + F.length(w["open"]) + F.length(w["body"]) + F.length(w["close"])).alias("at"),
        F.when(
            w["loss"],
            F.array_append(
                acc["spans"],
                F.struct(
                    (acc["at"] + F.length(w["open"])).alias("start"),
                    (acc["at"] + F.length(w["open"]) + F.length(w["body"])).alias("stop"),
                ),
            ),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return (
        conversations.select("conv_id", written.alias("written"))
        .select(
            "conv_id",
            F.array_join(F.transform("written", lambda w: F.concat(w["open"], w["body"], w["close"])), "").alias("formatted"),
            F.aggregate("written", begin, step)["spans"].alias("loss_spans"),
        )
    )


def _turn_of(x: Column) -> Column:
    """Role and text of one formatted turn."""
    inner = F.split(x, r"\] ", 2)  # only used for other roles
    other_role = F.decode(F.unbase64(F.substr(inner[0], F.lit(len(OTHER[0]) + 1))), "utf-8")
    role, text = other_role, F.substr(inner[1], F.lit(1), F.length(inner[1]) - len(OTHER[2]))
    for name, (start, end) in MARKS.items():
        here = F.startswith(x, F.lit(start))
        role = F.when(here, F.lit(name)).otherwise(role)
        text = F.when(here, F.substr(x, F.lit(len(start) + 1), F.length(x) - (len(start) + len(end)))).otherwise(text)
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, the turns read from the formatted text, and the texts under the loss mask, unescaped."""
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(F.regexp_extract_all("formatted", F.lit(_ONE_TURN), F.lit(0)), _turn_of).alias("turns"),
        F.transform(
            "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))
        ).alias("loss_texts"),
    )


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Formats conversations of any known layouts and sums up what is read back from the output."""
    back = read_back(format_turns(conversations))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
