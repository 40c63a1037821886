"""Values of list settings in configuration files: a fold over lines with a bracket depth.

`list_values` does it in Catalyst expressions; `list_value` says the same for one text in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lines import BREAKS, bound

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
# Fixed value: a list's tokens: double-quoted, single-quoted or bare.
TOKEN = r""""([^"]*)"|'([^']*)'|([A-Za-z0-9_.\-/*]+)"""
_TOKEN = re.compile(TOKEN)


def tokens(block: str) -> list[str]:
    return sorted({a or b or c for a, b, c in _TOKEN.findall(block)} - {""})


def list_value(content: str, key: str) -> list[str] | None:
    """Items of the first setting named key: an array on its line or beginning on the next, else the rest of
    its line. None where there is no such key or its array never ends."""
    lines = _BREAK.split(content)
    named = re.compile(rf"""["']?\b{re.escape(key)}\b["']?\s*[:=]""")
    for i, line in enumerate(lines):
        found = named.search(line)
        if not found:
            continue
        rest = line[found.end() :]
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if "[" not in rest and not following.lstrip().startswith("["):
            return tokens(rest)
        block, depth = [], 0
        for part in [rest, *lines[i + 1 :]] if "[" in rest else lines[i + 1 :]:
            block.append(part)
            depth += part.count("[") - part.count("]")
            if depth <= 0:
                return tokens("\n".join(block))
        return None
    return None


# Fixed value: how a key is named, before its value.
NAMED = r"""["']?\b{}\b["']?\s*[:=]"""


def _balance(line: Column) -> Column:
    """Opened brackets less closed ones."""
    return F.length(F.translate(line, "]", "")) - F.length(F.translate(line, "[", ""))


def _value(lines: Column, key: str) -> Column:
    """The items of the first setting named key among lines; null where there is none or its array never ends. Every step is worked out once."""
    named = NAMED.format(re.escape(key))

    def step(state: Column, line: Column) -> Column:
        depth, n = state["depth"] + _balance(line), state["n"] + 1
        return F.struct(depth.alias("depth"), n.alias("n"), F.coalesce(state["end"], F.when(depth <= 0, n)).alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("end"))

    def array(block: Column) -> Column:
        end = F.aggregate(block, start, step, lambda state: state["end"])
        return token_array(F.array_join(F.slice(block, F.lit(1), end), "\n"))

    def of_rest(at: Column, rest: Column) -> Column:
        begins, after = F.contains(rest, F.lit("[")), F.slice(lines, at + 1, F.size(lines))
        opened = begins | F.coalesce(F.ltrim(F.get(lines, at)).startswith("["), F.lit(False))
        return F.when(opened, bound(F.when(begins, F.concat(F.array(rest), after)).otherwise(after), array)).otherwise(token_array(rest))

    def of_place(at: Column) -> Column:
        return F.when(at > 0, bound(F.regexp_extract(F.get(lines, at - 1), f"(?s){named}(.*)$", 1), lambda rest: of_rest(at, rest)))

    return bound(F.array_position(F.transform(lines, lambda x: x.rlike(named)), F.lit(True)).cast("int"), of_place)


def list_values(content: Column, keys: tuple[str, ...]) -> Column:
    """A map from each of keys to its items; a key without a value has null items. Each content is split once for all keys, and read for those alone whose name it holds."""

    def values(text: Column) -> Column:
        return bound(F.split(text, BREAKS, -1), lambda lines: F.create_map(*[x for k in keys for x in (F.lit(k), F.when(F.contains(text, F.lit(k)), _value(lines, k)))]))

    return F.when(content.isNotNull(), bound(content, values))


def token_array(block: Column) -> Column:
    """The tokens of a block as a sorted array, in Catalyst expressions."""
    raw = F.regexp_extract_all(block, F.lit(f"({TOKEN})"), F.lit(1))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, "^[\"']|[\"']$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda t: t != "")))


def locate(content_lines: Column, item: Column) -> Column:
    """The first line, from 1, that holds an item; null if none."""
    return F.nullif(F.array_position(F.transform(content_lines, lambda line: F.contains(line, item)), F.lit(True)).cast("int"), F.lit(0))
