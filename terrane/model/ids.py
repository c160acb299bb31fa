"""Identifiers of nodes: ``cart <repo> <lang> <path>`[<container>#]<name>().`` and ``cart . <kind> <name>``, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_id(repo: Column, lang: Column, path: Column, container: Column, name: Column, kind: Column) -> Column:
    """Functions end in ``().``, types in ``#``, others in ``.``; a file (null name) ends after the backtick."""
    tail = F.when(kind == "function", "().").when(kind.isin("class", "interface", "struct", "trait", "enum", "record"), "#").otherwise(".")
    inner = F.concat(F.when(container.isNotNull(), F.concat(container, F.lit("#"))).otherwise(""), name, tail)
    return F.concat(F.lit("cart "), repo, F.lit(" "), lang, F.lit(" "), path, F.lit("`"), F.coalesce(inner, F.lit("")))


def named_id(kind: Column | str, name: Column) -> Column:
    return F.concat(F.lit("cart . "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(" "), name)


def parts(node_id: Column) -> Column:
    """(scope, lang, rest, path, container, symbol); total: a text of another shape gives nulls, never an error."""
    word = lambda k: F.try_element_at(F.split(node_id, " ", 4), F.lit(k))
    rest = word(4)
    symbol = F.when(F.instr(rest, "`") > 0, F.substring_index(rest, "`", -1))
    own = F.when(F.instr(symbol, "#") > 0, F.element_at(F.split(symbol, "#"), 1))
    return F.struct(
        F.when(word(1) == "cart", word(2)).alias("scope"), F.when(word(1) == "cart", word(3)).alias("lang"), F.when(word(1) == "cart", rest).alias("rest"),
        F.when(F.instr(rest, "`") > 0, F.substring_index(rest, "`", 1)).alias("path"), own.alias("container"), symbol.alias("symbol"),
    )


def tail(node_id: Column) -> Column:
    """All after the third space: the name a person would say."""
    return F.coalesce(F.try_element_at(F.split(node_id, " ", 4), F.lit(4)), F.element_at(F.split(node_id, " ", 4), -1))
