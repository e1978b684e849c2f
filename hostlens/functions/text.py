"""Text column helpers shared by parsing and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space in Unicode text handling (wider than SQL trim).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = "[" + WHITESPACE + "]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column) -> Column:
    """Trim Unicode white space.

    Trimming by a set of characters is slow, so text that begins and ends with a printable ASCII
    character (nearly all of it) is passed through after one linear match.
    """
    tidy = text.rlike(r"(?s)^[!-~](?:.*[!-~])?\z")
    return F.when(tidy, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def strip_dots(text: Column) -> Column:
    outer = F.startswith(text, F.lit(".")) | F.endswith(text, F.lit("."))
    return F.when(outer, F.btrim(text, F.lit("."))).otherwise(text)


def clean_text(c: Column | str) -> Column:
    """Null becomes empty text; surrounding white space goes."""
    return F.coalesce(strip(col(c).cast("string")), F.lit(""))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def after_first(text: Column, mark: str) -> Column:
    """Text behind the first `mark`, or empty."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(F.lit(""))


def parts_count(text: Column, sep_regex: str) -> Column:
    return F.size(F.filter(F.split(text, sep_regex), lambda p: p != ""))


def contains_any(text: Column, words) -> Column:
    """Plain substring tests, stopping at the first hit; faster than one regex alternation."""
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def count_present(text: Column, words) -> Column:
    """How many distinct words occur in the text."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def char_runs(text: Column) -> Column:
    """The characters of the text, sorted and cut into runs of equal ones.

    One sort and one regex pass; the size is the number of distinct characters and the lengths
    are their counts.
    """
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    return F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))


def shannon_entropy(text: Column, runs: Column | None = None) -> Column:
    """Shannon entropy in bits over the characters of the text; 0 for empty text."""
    n = F.length(text).cast("double")

    def step(acc: Column, run: Column) -> Column:
        count = F.length(run).cast("double")
        return acc + count * F.log2(count)

    spread = F.aggregate(char_runs(text) if runs is None else runs, F.lit(0.0), step)
    return F.when(F.length(text) > 0, F.log2(n) - spread / n).otherwise(F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den with an empty denominator counted as one."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")
