"""Text functions that several operators share, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case only: the folding of substring search."""
    return F.translate(text, _UPPER, _LOWER)


def tokens(text: Column) -> Column:
    """Array of lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


#: Words on which no context is centred.
CONTEXT_STOPWORDS = frozenset(
    """a an the is are was were be been have has had do does did will would could should to of in for on with at by from as
    and but or not no it this that how what when where why which who i we you he she they me my our your so if about up just""".split()
)


def context_lines(text: Column, query: str, around: int) -> Column:
    """Numbered lines around the first that holds a word of a query (any word if all are common), that one marked; without
    one, the leading lines as they are."""
    words = re.findall(r"\w+", query.lower())
    wanted = [w for w in words if w not in CONTEXT_STOPWORDS] or words
    lines = F.split(text, "\n", -1)
    holds = lambda line: reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(w)) for w in wanted], F.lit(False))
    at = F.array_position(F.transform(lines, holds), F.lit(True)).cast("int")
    begin = F.greatest(F.lit(1), at - around)
    shown = F.transform(
        F.slice(lines, begin, at + around - begin + 1),
        lambda line, i: F.concat(F.when(i + begin == at, ">>> ").otherwise("    "), (i + begin).cast("string"), F.lit(": "), line),
    )
    return F.array_join(F.when(at > 0, shown).otherwise(F.slice(lines, 1, 2 * around + 1)), "\n")


def digit_fold(text: Column) -> Column:
    """Runs of digits as one mark, so that numbered repeats are one content."""
    return F.regexp_replace(text, "[0-9]+", "#")


def term_pattern(term: str) -> str:
    """Pattern of a search term; terms of four characters or more also match with common endings."""
    quoted = r"\Q" + term.lower() + r"\E"
    return rf"(?U)\b{quoted}(?:s|es|ed|d|ing|ion|ions|ly)?\b" if len(term) >= 4 else rf"(?U)\b{quoted}\b"


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a glob whose * also crosses slashes."""
    out = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and ord(c) < 128 else c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"
