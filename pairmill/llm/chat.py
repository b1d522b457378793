r"""Chat formatting: layouts found by a fingerprint of their field paths.

A record's nested field paths (``messages[].role``), reduced to known names
and sorted, are hashed; the hash selects a declarative mapping that turns the
record into canonical turns.  JSON records are fingerprinted row by row, typed
tables once by their schema.  The template then writes

    <|turn|>ROLE<|text|>TEXT<|end|>\n

with ``\`` written as ``\\`` and ``<|`` as ``<\|`` inside roles and texts, so a
control string can only come from the template, and reading back is exact.
Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


@dataclass(frozen=True)
class Layout:
    """How records with exactly these known field paths become turns.

    ``turns``: (list field, role field, text field); or ``parts``: (role, field)
    pairs in order, of which empty ones are left out if named in ``optional``;
    or ``pairs``: a list field of [user, assistant] lists before the parts.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    pairs: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("rows", ("turns[].role", "turns[].text", "turns[].turn"), turns=("turns", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"),
           turns=("conversations", "from", "value"), roles=SPEAKERS),
    Layout("from_value_system", ("conversations[].from", "conversations[].value", "system"),
           turns=("conversations", "from", "value"), parts=(("system", "system"),), optional=("system",),
           roles=SPEAKERS),
    Layout("instruction", ("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"),
           parts=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout("prompt_completion", ("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), parts=(("user", "question"), ("assistant", "answer"))),
    Layout("history", ("history[][]", "prompt", "response"), pairs="history",
           parts=(("user", "prompt"), ("assistant", "response"))),
)

KNOWN = tuple(sorted({p for x in LAYOUTS for p in x.paths}))


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint_of(x.paths): x for x in LAYOUTS}


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    """Leaf field paths of a typed record; ``[]`` stands for list items."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def json_paths(record: Column) -> Column:
    """Field paths of a JSON object; a list has the paths of all its items."""
    keys = lambda c: F.call_function("json_object_keys", c)
    none = F.array().cast("array<string>")

    def of(key: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))

        def listed(items: Column) -> Column:
            inner = F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(keys(x), none))))
            lists = F.exists(items, lambda x: x.startswith("[") & F.get_json_object(x, "$[0]").isNotNull())
            return (F.when(F.size(inner) > 0, F.transform(inner, lambda s: F.concat(key, F.lit("[]."), s)))
                    .when(lists, F.array(F.concat(key, F.lit("[][]"))))
                    .otherwise(F.array(F.concat(key, F.lit("[]")))))

        # the array around a list's items makes them a variable, which is read once
        items = F.array(F.coalesce(F.from_json(value, "array<string>"), none))
        return (F.when(value.startswith("["), F.flatten(F.transform(items, listed)))
                .when(keys(value).isNotNull(), F.transform(keys(value), lambda s: F.concat(key, F.lit("."), s)))
                .otherwise(F.array(key)))
    return F.flatten(F.transform(F.call_function("json_object_keys", record), of))


def json_fingerprint(record: Column) -> Column:
    known = F.array(*[F.lit(p) for p in KNOWN])
    paths = F.sort_array(F.array_intersect(json_paths(record), known))
    return F.sha2(F.array_join(paths, "\n"), 256)


def _role(c: Column, roles: dict[str, str]) -> Column:
    out = c
    for a, b in roles.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _parts(layout: Layout, get) -> Column:
    items = []
    for role, name in layout.parts:
        t = _turn(F.lit(role), get(name))
        if name in layout.optional:
            missing = F.coalesce(get(name), F.lit("")) == ""
            # an instruction without an input is what the user asked
            t = F.when(~missing, t)
        elif layout.name == "instruction_input" and name == "instruction":
            missing = F.coalesce(get("input"), F.lit("")) == ""
            t = _turn(F.when(missing, F.lit("user")).otherwise(F.lit(role)), get(name))
        items.append(t)
    return F.filter(F.array(*items), lambda x: x.isNotNull())


EMPTY = "array<struct<role:string,text:string>>"


def json_turns(record: Column, layout: Layout) -> Column:
    """The canonical turns of a JSON record of this layout."""
    get = lambda name: F.get_json_object(record, f"$['{name}']")
    parts = _parts(layout, get) if layout.parts else F.array().cast(EMPTY)
    if layout.turns:
        name, role, text = layout.turns
        items = F.from_json(get(name), f"array<struct<`{role}`:string,`{text}`:string>>")
        turns = F.transform(items, lambda x: _turn(_role(x[role], layout.roles), x[text]))
        return F.concat(parts, F.coalesce(turns, F.array().cast(EMPTY)))
    if layout.pairs:
        items = F.from_json(get(layout.pairs), "array<array<string>>")
        said = F.flatten(F.transform(items, lambda x: F.array(_turn(F.lit("user"), F.get(x, F.lit(0))),
                                                              _turn(F.lit("assistant"), F.get(x, F.lit(1))))))
        return F.concat(F.coalesce(said, F.array().cast(EMPTY)), parts)
    return parts


def canonical_from_json(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (array of role and text).

    A record whose fingerprint no layout has, a null and a text that is not a
    JSON object get a null layout and null turns; no row is dropped.  Columns
    of these names are replaced.  Null roles and texts become empty.
    """
    c = df[record].cast("string")
    out = df.withColumn("fingerprint", json_fingerprint(c))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(EMPTY)
    for mark, x in BY_FINGERPRINT.items():
        hit = F.col("fingerprint") == mark
        layout = F.when(hit, F.lit(x.name)).otherwise(layout)
        turns = F.when(hit, json_turns(F.col(record), x)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted text for each conversation of a table with a row for each turn.

    Returns ``conv_id``, ``formatted``, ``loss_spans`` (array of start and
    length, in code points of the formatted text, of the trained roles' texts)
    and ``layout``.  Turns are ordered by ``turn``, ties by role and text; null
    turns come first.  Null roles and texts are empty.  Repeated rows stay, as
    turns of their own.  Rows with a null id are one conversation.  Other
    columns are left out; an empty table gives no rows.
    """
    turns = rows.select(rows[id_col].alias("conv_id"), rows[turn_col].alias("turn"),
                        F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"),
                        F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"))
    typed = StructType().add("turns", ArrayType(StructType([f for f in turns.schema.fields if f.name != "conv_id"])))
    layout = BY_FINGERPRINT[fingerprint_of(schema_paths(typed))]
    _, role, text = layout.turns
    head = F.concat(F.lit(TURN), escape(_role(F.col(role), layout.roles)), F.lit(TEXT))
    body = escape(F.col(text))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    segs = turns.select(
        "conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"),
        (F.length(head) + F.length(body) + len(END)).alias("n"))
    segs = segs.select(
        "conv_id", F.row_number().over(by_turn).alias("at"), F.concat("head", "body", F.lit(END)).alias("seg"),
        (F.sum("n").over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + F.length("head")).alias("start"),
        F.length("body").cast("bigint").alias("length"), F.col("role").isin(*trained).alias("trained"))
    got = segs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "seg"))).alias("segs"),
                                      F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("start", "length")))).alias("loss_spans"))
    return got.select("conv_id", F.array_join(F.col("segs.seg"), "").alias("formatted"), "loss_spans",
                      F.lit(layout.name).alias("layout"))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped: the spans in order, nothing between.

    Spans count code points; four bytes each make a span's place known without
    counting from the start.
    """
    def cut(wide: Column) -> Column:
        piece = lambda s: F.decode(F.substring(wide, s["start"].cast("int") * 4 + 1, s["length"].cast("int") * 4), "UTF-32")
        return F.array_join(F.transform(loss_spans, lambda s: unescape(piece(s))), "")
    return F.get(F.transform(F.array(F.encode(formatted, "UTF-32")), cut), F.lit(0))


def read_back(formatted: Column) -> Column:
    """The turns (array of role and text) that a formatted text holds."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.split(piece, r"<\|text\|>", 2)
        return F.struct(unescape(F.substring(F.get(at, F.lit(0)), len(TURN) + 1, 2**31 - 1)).alias("role"),
                        unescape(F.get(at, F.lit(1))).alias("text"))
    return F.transform(whole, turn)
