"""Perl-style regular expressions: /re/flags and s/re/replacement/flags, compiled where the plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import function
from .character import text


@dataclass(frozen=True)
class Pattern:
    regex: str
    replacement: str | None = None


@function("PRXPARSE")
def prxparse(source: str) -> Pattern:
    sub = source.startswith("s")
    body = source[1:] if sub else source
    mark = body[0]
    parts = re.split(r"(?<!\\)" + re.escape(mark), body[1:])
    if len(parts) != 2 + sub:
        raise ValueError(f"{source} is no regular expression")
    flags = "".join(f for f in parts[-1] if f in "imsx")
    if any(f not in "imsxo" for f in parts[-1]):
        raise ValueError(f"unknown flag in {source}")
    regex = (f"(?{flags})" if flags else "") + parts[0].replace("\\" + mark, mark)
    return Pattern(regex, re.sub(r"\\(\d)", r"$\1", parts[1]) if sub else None)


def _pattern(p) -> Pattern:
    return p if isinstance(p, Pattern) else prxparse(p)


@function("PRXMATCH")
def prxmatch(p, x) -> Column:
    """1-based place of the first match, or 0."""
    return F.regexp_instr(text(x), F.lit(_pattern(p).regex))


@function("PRXCHANGE")
def prxchange(p, times: int, x) -> Column:
    """Replaces the first `times` matches, all for -1."""
    own = _pattern(p)
    if own.replacement is None:
        raise ValueError("a substitution is needed")
    s = text(x)
    if times < 0:
        return F.regexp_replace(s, own.regex, own.replacement)
    out, done = s, F.lit("")
    for _ in range(times):
        # the text before the first match stays, the match is replaced, the rest goes on
        found = F.regexp_extract(out, f"(?s)^(.*?)({own.regex})", 0)
        head = F.regexp_extract(out, f"(?s)^(.*?)(?:{own.regex})", 1)
        hit = F.length(found) > 0
        matched = F.substring(found, F.length(head) + 1, F.length(found))
        done = F.when(hit, F.concat(done, head, F.regexp_replace(matched, own.regex, own.replacement))).otherwise(done)
        out = F.when(hit, F.substring(out, F.length(found) + 1, F.length(out))).otherwise(out)
    return F.concat(done, out)


@function("PRXPOSN")
def prxposn(p, group: int, x) -> Column:
    """The text of a capture group of the first match."""
    return F.regexp_extract(text(x), _pattern(p).regex, group)


@function("PRXPAREN")
def prxparen(p, x) -> Column:
    """The last capture group that took part in the first match, or 0."""
    regex = _pattern(p).regex
    groups = re.compile(re.sub(r"\(\?<(\w)", r"(?P<\1", regex)).groups
    out = F.lit(0)
    for k in range(1, groups + 1):
        out = F.when(F.length(F.regexp_extract(text(x), regex, k)) > 0, k).otherwise(out)
    return out


def prxsubstr(p, x) -> tuple[Column, Column]:
    """CALL PRXSUBSTR: place and length of the first match."""
    own = _pattern(p)
    return prxmatch(own, x), F.coalesce(F.length(F.regexp_substr(text(x), F.lit(own.regex))), F.lit(0))


def prxnext(p, x) -> Column:
    """CALL PRXNEXT: all matches, as an array for explode."""
    return F.regexp_extract_all(text(x), F.lit(_pattern(p).regex), F.lit(0))


def prxposition(p, group: int, x) -> tuple[Column, Column]:
    """CALL PRXPOSN: place and length of a capture group."""
    own = _pattern(p)
    whole, part = F.regexp_extract(text(x), own.regex, 0), prxposn(own, group, x)
    at = prxmatch(own, x)
    return F.when(F.length(part) > 0, at + F.instr(whole, part) - 1).otherwise(0), F.length(part)


def prxreplace(p, times: int, x) -> tuple[Column, Column, Column]:
    """CALL PRXCHANGE: the new text, its length, and the number of changes."""
    own = _pattern(p)
    found = F.regexp_count(text(x), F.lit(own.regex))
    new = prxchange(own, times, x)
    return new, F.length(new), found if times < 0 else F.least(found, F.lit(times))
