"""Pattern dialects.

Rule patterns are kept in plain form (``\\w``, ``\\b``, ``\\s``) and compiled here for Java's regex engine.  Two
dialects exist.  ``intended`` reads ``\\w`` and ``\\b`` as letter-aware in every script, which is what rules about
Russian text mean; ``ascii`` keeps them ASCII-only.  Both fold case over Unicode and both count NBSP and the other
Unicode blanks as white space.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, as a regex class body and spelled out.  The class names Unicode's
# separators; listing them as ranges is several times slower.
WS_CHARS = r"\s\p{Z}\uFEFF"
WS = f"[{WS_CHARS}]"
WS_LIST = (
    "\u0009\u000A\u000B\u000C\u000D\u0020\u00A0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)

_WORD = {"intended": r"\p{L}\p{N}_", "ascii": "A-Za-z0-9_"}


def rx(pattern: str, dialect: str = "intended", ignore_case: bool = True) -> str:
    """Compile a plain rule pattern to a Java regex of the given dialect."""
    word = _WORD[dialect]
    either_edge = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"

    def edge(match: re.Match) -> str:
        """Beside a word character only the other side needs a look."""
        before, after = pattern[: match.start()], pattern[match.end() :]
        if re.match(r"\w|\\[dw]", after):
            return f"(?<![{word}])"
        if re.search(r"(?:^|[^\\])\w$|\\[dw]$", before):
            return f"(?![{word}])"
        return either_edge

    def expand(match: re.Match) -> str:
        token = match.group(0)
        if token.startswith("["):
            return token.replace(r"\s", WS_CHARS).replace(r"\w", word)
        if token == r"\b":
            return edge(match)
        return {r"\w": f"[{word}]", r"\s": WS}.get(token, token)

    body = re.sub(r"\[\^?(?:\\.|[^\]\\])*\]|\\.", expand, pattern)
    return ("(?iu)" if ignore_case else "") + body


def matches(text: Column, pattern: str, dialect: str = "intended", ignore_case: bool = True) -> Column:
    return text.rlike(rx(pattern, dialect, ignore_case))


def matches_any(text: Column, patterns: list[str], dialect: str = "intended") -> Column:
    """One pass over the text for a whole rule list."""
    return matches(text, "|".join(f"(?:{p})" for p in patterns), dialect)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def extract(text: Column, pattern: str, group: int = 1, dialect: str = "intended", ignore_case: bool = True) -> Column:
    """First match's group, NULL instead of '' when there is none."""
    return F.nullif(F.regexp_extract(text, rx(pattern, dialect, ignore_case), group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 0, dialect: str = "intended", ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, dialect, ignore_case)), F.lit(group))


def replace_all(text: Column, pattern: str, by: str, dialect: str = "intended", ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, rx(pattern, dialect, ignore_case), by)
