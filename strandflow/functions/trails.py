"""Paths of oriented nodes as arrays of signed ids: +id enters a node at its start, -id at its end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def oriented(node_id: Column, forward: Column) -> Column:
    return F.when(forward, node_id).otherwise(-node_id)


def flip(path: Column) -> Column:
    """The path walked the other way: reversed, every node turned."""
    return F.transform(F.reverse(path), lambda x: -x)


def shorthand(path: Column) -> Column:
    """'9s,12s,7e'."""
    return F.array_join(F.transform(path, lambda x: F.concat(F.abs(x).cast("string"), F.when(x > 0, "s").otherwise("e"))), ",")


def parse_shorthand(text: Column) -> Column:
    """Signed ids of '9s,12s,7e'; spaces around commas are allowed; anything else raises."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))

    def one(p):
        ok = F.regexp_like(p, F.lit("^[0-9]+[se]$"))
        number = F.regexp_extract(p, "^([0-9]+)", 1)
        value = number.try_cast("int")
        return F.when(ok, F.when(p.endswith("s"), value).otherwise(-value)).otherwise(F.raise_error(F.concat(F.lit("not an oriented node: "), p)).cast("int"))

    return F.transform(parts, one)


def ids_only(path: Column) -> Column:
    """'9,12,7'."""
    return F.array_join(F.transform(path, lambda x: F.abs(x).cast("string")), ",")


def contains(path: Column, node: Column) -> Column:
    return F.array_contains(path, node)


def last(path: Column) -> Column:
    return F.element_at(path, -1)


def steps(path: Column) -> Column:
    """Consecutive pairs (src, dst)."""
    n = F.size(path)
    return F.when(n > 1, F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).otherwise(
        F.array().cast("array<struct<src:int,dst:int>>")
    )
