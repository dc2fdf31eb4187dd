"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A regular expression for a whole-string shell pattern whose ``*`` and ``?`` also cross slashes. An empty pattern matches nothing."""
    if not pattern:
        return "(?!)"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            j = i + 1 if pattern[i : i + 1] in ("!", "^") else i
            end = pattern.find("]", j + 1)
            if end < 0:
                out.append("\\[")
            else:
                body = pattern[j:end].replace("\\", "\\\\").replace("[", "\\[")
                out.append("[" + ("^" if j > i else "") + body + "]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def matches_glob(value: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches the whole value; null values match none."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(value.rlike(glob_regex(p)), F.lit(False))
    return found


def leading_number(value: Column) -> Column:
    """The number that a text begins with (``352B``, ``42%``, ``-1.5e3``) as a double, 0 without one."""
    return F.coalesce(F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def evidence_text(evidence: Column) -> Column:
    """A map as ``k=v; k=v`` in order of its keys."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(evidence)),
            lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "; ")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def absolute(path: Column, base: Column) -> Column:
    """``path`` below ``base`` unless it is absolute already."""
    return F.when(path.startswith("/") | (F.coalesce(base, F.lit("")) == ""),
        path).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), path))


def absolute_arguments(arguments: Column, base: Column) -> Column:
    """Include paths among compiler arguments made absolute: ``-Ix``, and the argument after ``-I``, ``-isystem``, ``-iquote`` or ``-idirafter``; ``-include`` stays."""
    alone = ["-I", "-isystem", "-iquote", "-idirafter", "-isysroot"]
    before = F.concat(F.array(F.lit("")), F.slice(arguments, F.lit(1), F.greatest(F.size(arguments) - 1, F.lit(0))))
    fixed = lambda a, p: F.when(p.isin(alone), absolute(a, base)).when(a.startswith("-I") & (F.length(a) > 2),
        F.concat(F.lit("-I"), absolute(F.substring(a, 3, 1 << 30), base))).otherwise(a)
    return F.zip_with(arguments, before, fixed)
