"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A layout is told by hashes of nested field paths: it is chosen if its required fields, with any of its
optional ones, hash to one of its fingerprints; fields that it doesn't know, be they of other layouts,
don't count, and of several layouts the first in LAYOUTS is taken. The fingerprint selects a declared
mapping that turns a record into canonical turns (key, seq, role, text): `turns_of_rows` takes the
fingerprint of a DataFrame's schema, `turns_of_json` that of each JSON record (of all elements of its
arrays), so records of several layouts may lie in one column. A record of no known layout gives no turns;
`layout_of_json` names it null and `rejected_json` lists it.

`formatted` writes the turns of a key as `<|role|>`, line end, text, `<|end|>`, line end. In texts
`&` is written `&amp;` and `<` is written `&lt;`, in roles `|` also, so no text can hold a marker and
both can be read back exactly. The loss mask has the place and length of each assistant text.

Defined cases: a null text is empty, a null role is the empty role; turns go by (turn, role, text)
with null turns first, repeated rows are turns of their own; rows of a null key are one
conversation; an empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Role names of several layouts to canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """paths: the fields of the layout; optional: those that may be missing. pairs: (role, field) in order, or
    turns: (array, role field, text field), or row: (turn, role, text) where each turn is a row."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("turn_rows", ("turn", "role", "text"), row=("turn", "role", "text")),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("question", "answer"), ("system",), (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), ("system",), (("system", ("system",)),), ("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), ("system",), (("system", ("system",)),), ("conversations", "from", "value")),
)


def fingerprint(paths) -> str:
    """The hash of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def own_paths(x: Layout) -> tuple[str, ...]:
    return (*x.paths, *x.optional)


def fingerprints(x: Layout) -> set[str]:
    """What a layout's fields may hash to: the required ones with any of the optional ones."""
    return {fingerprint([*x.paths, *(p for i, p in enumerate(x.optional) if mask >> i & 1)]) for mask in range(1 << len(x.optional))}


FINGERPRINTS = {x.name: fingerprints(x) for x in LAYOUTS}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; an array's elements are `name[]`."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for path in [f"{at}.{f.name}" if at else f.name] for p in (path, *schema_paths(f.dataType, path))]
    return schema_paths(schema.elementType, f"{at}[]") if isinstance(schema, T.ArrayType) else []


def layout_of_schema(schema: T.StructType) -> Layout | None:
    """The first layout that has a fingerprint of its fields in the schema; fields of others don't matter."""
    paths = schema_paths(schema)
    return next((x for x in LAYOUTS if fingerprint(set(paths) & set(own_paths(x))) in FINGERPRINTS[x.name]), None)


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(role)), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(x: Layout, field, has) -> Column:
    """The turns of one record as an array; field(name) is a string column, has(name) whether a record may have it."""
    parts = []
    for role, names in x.pairs:
        own = [n for n in names if has(n)]
        if own:
            # An instruction and its input are one text, with an empty line between.
            text = F.concat_ws("\n\n", *[F.when(field(n) != "", field(n)) if n != names[0] else F.coalesce(field(n), F.lit("")) for n in own])
            turn = F.array(_turn(F.lit(role), text))
            parts.append(F.when(field(own[0]).isNotNull(), turn).otherwise(F.filter(turn, lambda _: F.lit(False))) if role == "system" else turn)
    if x.turns:
        name, role, text = x.turns
        parts.append(F.transform(F.coalesce(field(name), F.array()), lambda m: _turn(_role(m[role]), m[text])))
    return F.concat(*parts)


def turns_of_rows(df: DataFrame, key: str) -> DataFrame:
    """Canonical turns (key, seq, role, text) of a typed DataFrame. Raises ValueError when its schema has no known layout."""
    x = layout_of_schema(df.drop(key).schema)
    if x is None:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(df.drop(key).schema))}")
    if x.row:
        turn, role, text = x.row
        rows = df.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
        return rows.withColumn("seq", F.row_number().over(order) - 1).select("key", "seq", "role", "text")
    names = set(df.columns)
    return df.select(F.col(key).alias("key"), F.posexplode(_mapped(x, F.col, names.__contains__)).alias("seq", "t")).select("key", "seq", "t.role", "t.text")


_JSON_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("prompt", "completion", "response", "question", "answer", "instruction", "input", "output", "system")]
    + [T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))]
    + [T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])))]
)


def paths_of_json(record: Column) -> Column:
    """The nested field paths of a JSON text; those of arrays are of all their elements."""
    none = F.array().cast("array<string>")

    def elements(name: str) -> Column:
        each = F.coalesce(F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>"), none)
        keys = F.flatten(F.transform(each, lambda e: F.coalesce(F.json_object_keys(e), none)))
        return F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))

    return F.array_distinct(F.concat(F.coalesce(F.json_object_keys(record), none), *[elements(n) for n in ("messages", "conversations")]))


def _fingerprint_of(paths: Column, x: Layout) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, own_paths(x))))), "\n"), 256)


def layout_of_json(record: Column) -> Column:
    """The name of the first layout that has a fingerprint of its fields in the record, else null."""
    paths = paths_of_json(record)
    named = F.lit(None).cast("string")
    for x in reversed(LAYOUTS):
        if not x.row:
            named = F.when(_fingerprint_of(paths, x).isin(*sorted(FINGERPRINTS[x.name])), x.name).otherwise(named)
    return named


def rejected_json(df: DataFrame, key: str, record: str) -> DataFrame:
    """Rows (key, record, paths) of the records that turns_of_json leaves out, for they have no layout."""
    return df.select(F.col(key).alias("key"), F.col(record).alias("record"), paths_of_json(F.col(record)).alias("paths")).where(layout_of_json(F.col("record")).isNull())


def turns_of_json(df: DataFrame, key: str, record: str) -> DataFrame:
    """Canonical turns of JSON records, each by its own layout."""
    read = df.select(F.col(key).alias("key"), layout_of_json(F.col(record)).alias("layout"), F.from_json(F.col(record), _JSON_SCHEMA).alias("r")).where("layout is not null")
    turns = F.lit(None)
    for x in LAYOUTS:
        if not x.row:
            turns = F.when(F.col("layout") == x.name, _mapped(x, lambda n: F.col("r")[n], lambda _: True)).otherwise(turns)
    return read.select("key", F.posexplode(turns).alias("seq", "t")).select("key", "seq", "t.role", "t.text")


OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#124;"), F.lit("|")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def formatted(turns: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """Rows (key, formatted, loss): loss lists (start, length), in characters from 0, of each text of the role `trained`."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("|"), F.lit("&#124;")), F.lit(BETWEEN))
    parts = turns.select("key", "seq", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    # Running lengths, so that a mask costs no pass over the turns before.
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("start", F.sum(F.char_length("piece")).over(before) - F.char_length("piece") + F.char_length("head"))
    mask = F.when(F.col("role") == trained, F.struct(F.col("start").cast("int").alias("start"), F.char_length("body").alias("length")))
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("pieces"), F.array_sort(F.collect_list(mask)).alias("loss"))
    return whole.select("key", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def parsed(text: Column) -> Column:
    """The turns, as an array of (role, text), read back from a formatted text."""
    pieces = F.split(text, r"<\|end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, BETWEEN, 1)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.char_length(role) + len(BETWEEN) + 1)).alias("text"))

    return F.transform(pieces, turn)


def under_loss(text: Column, loss: Column) -> Column:
    """The text that the loss mask covers, unescaped."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(text, s["start"] + 1, s["length"])), ""))
