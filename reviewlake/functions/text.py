"""Column expressions over text, with offsets in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark that starts a line comment, by file suffix.
COMMENT_MARKS = {".py": "#", ".rb": "#", ".js": "//", ".jsx": "//", ".ts": "//", ".tsx": "//", ".java": "//", ".kt": "//", ".go": "//", ".php": "//", ".sql": "--"}
CJK = r"[\x{4e00}-\x{9fff}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unix_lines(c: Column) -> Column:
    """An array of lines; CRLF and CR end lines as LF does, a last empty line stays."""
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n", -1)


def suffix_of(path: Column) -> Column:
    """The last dot of the base name and what follows, in lower case; else ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def match_start(text: Column, regex: Column, flags: Column) -> Column:
    """Offset of the leftmost match; meaningful only where there is one."""
    return F.length(extract(text, F.concat(flags, F.lit(r"^([\s\S]*?)(?:"), regex, F.lit(")")), 1))


def extract(text: Column, regex: Column, group: int = 0) -> Column:
    """regexp_extract with a pattern that is a column."""
    return F.call_function("regexp_extract", text, regex, F.lit(group))


def comment_start(line: Column, suffix: Column) -> Column:
    """Offset of a line comment that no string hides; null without one.

    Up to it a line is escape pairs, closed strings and other characters.  The
    repetition is possessive, so that nothing before an unclosed quote is read
    again as if it weren't one.
    """
    found = F.lit(None).cast("int")
    for mark in sorted(set(COMMENT_MARKS.values())):
        first = mark[0]
        other = rf"[^'\"\\{first}]" if len(mark) == 1 else rf"[^'\"\\{first}]|{first}(?!{first})"
        regex = rf"(?s)^((?:\\.|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|{other})*+){mark}"
        at = F.when(line.rlike(regex), F.length(F.regexp_extract(line, regex, 1)))
        found = F.when(suffix.isin([k for k, v in COMMENT_MARKS.items() if v == mark]), at).otherwise(found)
    return found


def token_estimate(text: Column) -> Column:
    """Rough tokens: a CJK character is one, 3.5 others are one, plus one; 0 for ''."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.when(F.length(text) == 0, 0).otherwise(F.floor(cjk + (F.length(text) - cjk) / 3.5) + 1).cast("long")


def search_tokens(text: Column) -> Column:
    """Lower-case ASCII words, then pairs of neighbouring CJK characters (a lone one stays)."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0))
    pairs = F.transform(runs, lambda s: F.when(F.length(s) == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))))
    return F.concat(words, F.flatten(pairs))


def hash_features(text: Column) -> Column:
    """search_tokens, then `#` and three characters of each window of ASCII runs
    (3 or more) and CJK runs (2 or more, which give windows from 3 on)."""
    segments = F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9_]{{3,}}|{CJK}{{2,}}"), F.lit(0))
    grams = F.transform(F.filter(segments, lambda s: F.length(s) >= 3), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.concat(F.lit("#"), F.substring(s, i, F.lit(3)))))
    return F.concat(search_tokens(text), F.flatten(grams))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
