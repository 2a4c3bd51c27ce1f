"""Python's regular expressions as Java's, so that rules written for one mean the same in the other."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

from pyspark.sql import Column, SparkSession

#: Classes that know all of Unicode in Python; Java needs a flag for that.
UNICODE_CLASSES = re.compile(r"\\[dDwWsSbB]|\(\?[a-z]*i")
REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")
NAMED = re.compile(r"\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?P>(\w+)\)")


class BadPattern(ValueError):
    """A pattern that does not compile, or that Java has no form of."""


def _escape(pattern: str, i: int) -> tuple[str, int]:
    """The escape at i, and where it ends."""
    c = pattern[i + 1 : i + 2]
    if c == "Z":
        return r"\z", i + 2
    if c == "U":
        return rf"\x{{{int(pattern[i + 2 : i + 10], 16):X}}}", i + 10
    if c == "0":
        digits = re.match("[0-7]{1,3}", pattern[i + 1 :])[0]
        return rf"\x{{{int(digits, 8):X}}}", i + 1 + len(digits)
    if c == "N":
        raise BadPattern("named characters are not supported")
    return pattern[i : i + 2], i + 2


@lru_cache(maxsize=1024)
def to_java(pattern: str) -> str:
    """The Java form of a Python pattern. BadPattern where Python refuses it, or where Java has no like (conditional groups, flags of bytes).

    Line ends are `\\n` alone, classes and case know all of Unicode, `\\Z` is the very end, names of groups go, brackets and ampersands in a class and
    braces that repeat nothing stand for themselves.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compiled = re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise BadPattern(f"not a pattern: {e}") from e
    names = compiled.groupindex
    out, i, inside, first = [], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            piece, i = _escape(pattern, i)
            out.append(piece)
            continue
        if inside:
            if c == "]" and i > first:
                inside = False
            elif c in "[&" or (c == "]" and i == first):
                c = "\\" + c
            out.append(c)
            i += 1
            continue
        if c == "[":
            inside, first = True, i + 1 + (pattern[i + 1 : i + 2] == "^")
            out.append(pattern[i:first])
            i = first
            continue
        if c == "{":
            m = REPEAT.match(pattern, i)
            if m and (m[1] or m[3] or m[2]) and i:
                out.append("{" + (m[1] or "0") + m[2] + m[3] + "}")
                i = m.end()
                continue
            c = "\\{"
        elif c == "}":
            c = "\\}"
        elif c == "(" and pattern.startswith("(?(", i):
            raise BadPattern("conditional groups are not supported")
        elif c == "(" and (m := NAMED.match(pattern, i)):
            # by number, as Java's names may not hold all that Python's may
            out.append("(" if m[1] else rf"(?:\{names[m[2] or m[3]]})")
            i = m.end()
            continue
        elif c == "(" and (m := re.match(r"\(\?([aiLmsux]+)(?=[):-])", pattern[i:])):
            if flags := set(m[1]) & {"a", "L"}:
                raise BadPattern(f"flags are not supported: {''.join(sorted(flags))}")
            c, i = "(?" + m[1].replace("u", ""), i + m.end() - 1
        out.append(c)
        i += 1
    return ("(?dU)" if UNICODE_CLASSES.search(pattern) else "(?d)") + "".join(out)


def checked(pattern: object, full: bool = False, search: bool = False) -> str:
    """The Java form of a pattern that is matched at the beginning, as a whole, or anywhere; compiled once on the driver."""
    if not isinstance(pattern, str):
        raise BadPattern(f"not a pattern: {pattern!r}")
    java = to_java(pattern)
    java = java if search else rf"\A(?:{java})\z" if full else rf"\A(?:{java})"
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:  # whatever the bridge raises
            raise BadPattern(f"no pattern in Java: {str(e).splitlines()[0]}") from e
    return java


def matches(text: Column, pattern: object, full: bool = False, search: bool = False) -> Column:
    return text.rlike(checked(pattern, full, search))
