"""Stable ids of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what every key starts with before it is hashed; give an existing store's own to meet its ids
NAMESPACE = "chunk:"


def point_key(book: Column, index: Column, summary: Column) -> Column:
    return F.concat(F.when(F.coalesce(summary, F.lit(False)), "summary:").otherwise(""), book, F.lit(":"), index.cast("string"))


def _with_bits(digit: Column, choices: str) -> Column:
    """The hexadecimal digit with its upper bits set as in ``choices``, by its lower ones."""
    return F.substring(F.lit(choices), F.conv(digit, 16, 10).cast("int") + 1, F.lit(1))


def guid(key: Column, namespace: str = NAMESPACE) -> Column:
    """A GUID of the key's SHA-256; the first three groups print their bytes in reverse."""
    h = F.sha2(F.concat(F.lit(namespace), key), 256)

    def byte(i: int) -> Column:
        return F.substring(h, 2 * i + 1, 2)

    six = F.concat(F.lit("8"), F.substring(h, 14, 1))
    eight = F.concat(_with_bits(F.substring(h, 17, 1), "89ab" * 4), F.substring(h, 18, 1))
    groups = ([byte(3), byte(2), byte(1), byte(0)], [byte(5), byte(4)], [byte(7), six], [eight, byte(9)], [byte(i) for i in range(10, 16)])
    return F.concat_ws("-", *(F.concat(*g) for g in groups))
