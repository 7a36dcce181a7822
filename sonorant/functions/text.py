"""File-name and text expressions. Names read ``<species>_<5-digit sequence>_<call>.wav``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def species(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def group_id(name: Column) -> Column:
    """Species and sequence: the first two tokens."""
    return F.substring_index(name, "_", 2)


def call_index(name: Column) -> Column:
    """The last token without its extension as a number; null if it is none."""
    return F.replace(F.substring_index(name, "_", -1), F.lit(".wav"), F.lit("")).try_cast("int")


def base_name(name: Column) -> Column:
    """Without the call index."""
    return F.regexp_replace(name, r"_[0-9]+\.wav$", ".wav")


def five_digits(name: Column) -> Column:
    return F.regexp_extract(name, r"_([0-9]{5})_", 1)


def strict_parts(name: Column) -> Column:
    """(species, seq, idx) of a three-token name; null otherwise."""
    parts = F.split(F.regexp_replace(name, r"\.wav$", ""), "_")
    ok = (F.size(parts) == 3) & F.get(parts, 2).try_cast("int").isNotNull()
    return F.when(ok, F.struct(F.get(parts, 0).alias("species"), F.get(parts, 1).alias("seq"), F.get(parts, 2).try_cast("int").alias("idx")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def numbered(prefix: str, i: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), width, "0"))


def contains_any(label: Column, words: list[str]) -> Column:
    """Whether the label holds one of the words anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(label, w))


def capitalised(s: Column) -> Column:
    """First character in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))
