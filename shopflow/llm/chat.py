"""Chat formatting: heterogeneous layouts into one template, by schema fingerprint.

A layout is recognised by the fingerprint of its nested field paths: the shape of
a schema (sorted field names, objects and arrays nested, scalar types left out)
is hashed, and the hash selects a declarative mapping that says where turns,
roles and texts are. Tables are recognised by their schema, JSON records row by
row. All expressions are Spark's own.

The template writes a turn as ``<s>role NEWLINE text</s>``. Control strings inside
texts and roles are escaped by one character reference each (and references that
are already there likewise), which reading back undoes exactly. The loss mask is
a list of (start, length) in code points of the formatted string, one per
assistant text.

Defined results: null texts and roles are empty; turns of a conversation are in
order of turn, then role, then text; repeated rows are turns each; null
conversation ids form one conversation. JSON records that do not parse or have
no mapping come out with null turns. Other columns are ignored. A conversation is
one value, so one task formats it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "<s>", "</s>"
#: Strings that a template of this family gives a meaning to.
CONTROL = (BEGIN, END, "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Breaks every control string; ``unescape`` undoes it."""
    text = F.regexp_replace(text, "&(?=(amp|lt|#91|#10);)", "&amp;")
    text = F.regexp_replace(text, "<(?=/?s>|</?SYS>>)", "&lt;")
    return F.regexp_replace(text, r"\[(?=/?INST\])", "&#91;")


def escape_role(role: Column) -> Column:
    """As ``escape``, and keeps the role on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    for reference, plain in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return text


# ------------------------------------------------------------------ layouts --

@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    Either ``turns``: (role, paths whose non-empty texts are joined by a blank
    line), or ``items``: an array path with role and text fields; or ``rows``:
    one turn a row with key, order, role and text columns."""

    name: str
    shape: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


def _object(**fields: str) -> str:
    return "OBJECT<" + ", ".join(f"{k}: {fields[k]}" for k in sorted(fields)) + ">"


SPOKEN = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
LAYOUTS = (
    Layout("prompt", _object(prompt="_", completion="_"),
           turns=(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Layout("prompt-response", _object(prompt="_", response="_"),
           turns=(("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Layout("question", _object(question="_", answer="_"),
           turns=(("user", ("question",)), (ASSISTANT, ("answer",)))),
    Layout("instruction", _object(instruction="_", output="_"),
           turns=(("user", ("instruction",)), (ASSISTANT, ("output",)))),
    Layout("instruction-input", _object(instruction="_", input="_", output="_"),
           turns=(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
    Layout("instruction-system", _object(system="_", instruction="_", input="_", output="_"),
           turns=(("system", ("system",)), ("user", ("instruction", "input")),
                  (ASSISTANT, ("output",)))),
    Layout("messages", _object(messages="ARRAY<" + _object(role="_", content="_") + ">"),
           items=("messages", "role", "content")),
    Layout("conversations", _object(conversations="ARRAY<" + _object(**{"from": "_", "value": "_"})
                                    + ">"),
           items=("conversations", "from", "value"), roles=SPOKEN),
    Layout("turn-rows", _object(conv_id="_", turn="_", role="_", text="_"),
           rows=("conv_id", "turn", "role", "text")),
)


def shape_of(kind: T.DataType) -> str:
    """The nested field paths of a Spark type, in the notation of ``shape_column``."""
    if isinstance(kind, T.StructType):
        return _object(**{f.name: shape_of(f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{shape_of(kind.elementType)}>"
    return "_"


def shape_column(record: Column) -> Column:
    """The nested field paths of a JSON text; null if it does not parse."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r"(?<=: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "_")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def layout_of(table: DataFrame, columns: list[str], layouts=LAYOUTS) -> Layout:
    """The layout of a table's named columns, by the hash of its field paths."""
    spark = table.sparkSession
    shapes = [shape_of(table.select(*columns).schema), *[x.shape for x in layouts]]
    own, *known = spark.range(1).select(
        *[fingerprint(F.lit(s)).alias(f"f{i}") for i, s in enumerate(shapes)]).first()
    for layout, print_ in zip(layouts, known, strict=True):
        if print_ == own:
            return layout
    raise ValueError(f"no mapping for {shapes[0]}")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _role(role: Column, layout: Layout) -> Column:
    out = role
    for old, new in layout.roles.items():
        out = F.when(role == old, new).otherwise(out)
    return _text(out)


def _canonical(layout: Layout):
    """One item of a layout's list as a turn."""
    _, role, text = layout.items
    return lambda t: F.struct(_role(t[role], layout).alias("role"), _text(t[text]).alias("text"))


def record_turns(records: DataFrame, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """``records`` with layout (name) and turns (canonical) of a JSON text column."""
    layouts = [x for x in layouts if x.rows is None]
    found = records.withColumn("_shape", shape_column(F.col(record_col))) \
                   .withColumn("_print", fingerprint(F.col("_shape")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for x in reversed(layouts):
        hit = (F.col("_print") == fingerprint(F.lit(x.shape))) & F.col("_shape").isNotNull()
        if x.items:
            array, role, text = x.items
            parsed = F.from_json(record_col, f"`{array}` array<struct<`{role}`:string,`{text}`:string>>")
            made = F.transform(parsed[array], _canonical(x))
        else:
            paths = sorted({p for _, ps in x.turns for p in ps})
            parsed = F.from_json(record_col, ", ".join(f"`{p}` string" for p in paths))
            made = F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(
                F.filter(F.array(*[_text(parsed[p]) for p in ps]), lambda s: s != ""),
                "\n\n").alias("text")) for role, ps in x.turns])
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, made).otherwise(turns)
    return found.withColumn("layout", name).withColumn("turns", turns).drop("_shape", "_print")


def turn_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """(key, turn, role, text) of a table that holds one turn a row."""
    layout = layout_of(table, columns)
    if layout.rows is None:
        raise ValueError(f"layout {layout.name} has no turn rows")
    key, order, role, text = layout.rows
    return table.select(F.col(key).alias("key"), F.col(order).alias("turn"),
                        _role(F.col(role), layout).alias("role"), _text(F.col(text)).alias("text"))


# ----------------------------------------------------------------- template --

def format_turns(turns: DataFrame) -> DataFrame:
    """(key, formatted, loss_spans) from (key, turn, role, text)."""
    parts = turns.select("key", "turn", "role", "text", escape_role(F.col("role")).alias("r"),
                         escape(F.col("text")).alias("t"))
    parts = parts.withColumn("segment", F.concat(F.lit(BEGIN), "r", F.lit("\n"), "t", F.lit(END)))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    before = F.sum(F.length("segment").cast("long")).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.select(
        "key", F.row_number().over(order).alias("i"), "segment",
        F.when(F.col("role") == ASSISTANT, F.struct(
            (F.coalesce(before, F.lit(0)) + len(BEGIN) + F.length("r") + 1).alias("start"),
            F.length("t").alias("length"))).alias("loss"))
    grouped = placed.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("i", "segment", "loss"))).alias("parts"))
    return grouped.select(
        "key", F.array_join(F.col("parts.segment"), "").alias("formatted"),
        F.filter(F.col("parts.loss"), lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, turns, loss_texts) parsed from formatted strings and their masks."""
    segments = F.filter(F.split("formatted", END), lambda s: s != "")
    # Each segment is <s>role, a line end, text.
    turns = F.transform(segments, lambda s: F.struct(
        unescape(F.substring(F.substring_index(s, "\n", 1), len(BEGIN) + 1, 2**31 - 1)).alias("role"),
        unescape(s.substr(F.locate("\n", s) + 1, F.length(s))).alias("text")))
    losses = F.transform("loss_spans", lambda x: unescape(
        F.col("formatted").substr((x["start"] + 1).cast("int"), x["length"])))
    return formatted.select("key", "formatted", "loss_spans", turns.alias("turns"),
                            losses.alias("loss_texts"))
