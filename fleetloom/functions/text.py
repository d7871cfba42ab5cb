"""Text helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"


def host_name(instance: Column) -> Column:
    """Host part of ``host\\instance``; the whole text when there is no instance part."""
    return F.substring_index(instance, BACKSLASH, 1)


def instance_name(instance: Column, default: str = "Default", length: int | None = None) -> Column:
    """Instance part of ``host\\instance`` cut to ``length`` if given, or ``default`` for a default instance."""
    at = F.instr(instance, BACKSLASH)
    return F.when(at == 0, F.lit(default)).otherwise(F.substring(instance, at + 1, F.length(instance) if length is None else F.lit(length)))


def file_name(path: Column, separator: str = BACKSLASH) -> Column:
    """Last component of a path; NULL when the path has no separator or ends with one."""
    name = F.substring_index(path, separator, -1)
    return F.when((F.instr(path, separator) > 0) & (name != ""), name)


def folder_name(path: Column, separator: str = BACKSLASH) -> Column:
    """Everything before the last separator; the path itself when it has none."""
    length = F.length(path) - F.length(F.substring_index(path, separator, -1)) - 1
    return F.when(F.instr(path, separator) > 0, F.substring(path, F.lit(1), length)).otherwise(path)


def one_line(text: Column) -> Column:
    """Line feeds and carriage returns become blanks."""
    return F.translate(text, "\n\r", "  ")


def ends_with_any(text: Column, suffixes: Sequence[str]) -> Column:
    return _any([F.endswith(text, F.lit(s)) for s in suffixes])


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def fold_case(text: Column, case_insensitive: bool) -> Column:
    """Compare text the way a case-insensitive server collation does, when asked to."""
    return F.lower(text) if case_insensitive else text


def collated(text: Column, case_insensitive: bool) -> Column:
    """Text whose comparisons, joins, groups and patterns do not see case, when asked to.

    Spark compares such text by itself, so keys need no column of folded text. Filters on it do not reach a Parquet scan.
    """
    return F.collate(text, "UTF8_LCASE") if case_insensitive else text


def xml_escape(text: Column) -> Column:
    escaped = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped
