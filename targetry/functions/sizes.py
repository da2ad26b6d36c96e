"""Encoded sizes of response rows, for bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_size(x: Column) -> Column:
    """Bytes of a non-negative number in base 128; negative ones take ten."""
    out = F.when(x < 0, 10)
    for k in range(1, 9):
        out = out.when(x < F.lit(1 << 7 * k), k)
    return out.otherwise(9).cast("long")


def number_field(x: Column) -> Column:
    """Tag and value; zero and null cost nothing."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(1 + varint_size(x))


def bytes_field(length: Column) -> Column:
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(1 + varint_size(length) + length)


def packed_field(ids: Column) -> Column:
    return bytes_field(F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + varint_size(x)))


def target_size(id_: Column, hash_: Column, deps: Column, rule_type: Column, tags: Column, root: Column, external: Column) -> Column:
    flags = root.cast("long") * 2 + external.cast("long") * 2
    return number_field(id_) + bytes_field(F.octet_length(hash_)) + packed_field(deps) + number_field(rule_type) + packed_field(tags) + flags


def changed_size(change_type: Column, before: Column, after: Column, distance: Column) -> Column:
    """before, after: sizes of the encoded targets, null for none; change_type: the number of the type."""
    nested = lambda n: F.when(n.isNull(), F.lit(0).cast("long")).otherwise(1 + varint_size(n) + n)
    return number_field(change_type) + nested(before) + nested(after) + number_field(distance)


def map_entry_size(key: Column, length: Column) -> Column:
    """An entry of a dictionary from numbers to texts of length bytes: both fields are always there."""
    entry = 1 + varint_size(key) + 1 + varint_size(length) + length
    return 1 + varint_size(entry) + entry
