"""A user's query text: its mode, boolean expression, ranking terms and time bounds, all on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

OPERATORS = ("AND", "OR", "NOT")
#: Words that say nothing about what is searched for.
STOPWORDS = frozenset(
    """a an and are as at be but by did do does for from had has have how i in is it its me my of on or our so that the
    their then there these this to was we were what when where which who why will with you your""".split()
)
#: Characters at a term's edge that are no part of it.
EDGE = ",.;:!?*\"'()[]{}<>…“”‘’"
_SPAN = re.compile(r'"[^"]*"|\S+')
_WORDS = re.compile(r"[^\W_]+")


def _spans(query: str) -> list[str]:
    """Quoted spans and words, as typed."""
    return _SPAN.findall(query)


def classify(query: str) -> tuple[str, bool]:
    """(mode, whether it has operators): browse without text, tsquery with operators, or with a pipe, code with an
    identifier's marks, else tsquery."""
    spans = _spans(query or "")
    if not spans:
        return "browse", False
    if any(s in OPERATORS for s in spans):
        return "tsquery", True
    if "|" in query:
        return "or", False
    return ("code" if re.search(r"_|::|\w\.\w", query) else "tsquery"), False


@dataclass(frozen=True)
class Phrase:
    """Words that stand next to each other; no words match nothing."""

    words: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


def words_of(text: str) -> tuple[str, ...]:
    """Lower-case runs of letters and digits."""
    return tuple(_WORDS.findall(text.lower()))


def _all(phrases: list[Phrase]):
    """Phrases that must all be there; those without words are left out where others have some."""
    full = [p for p in phrases if p.words] or phrases[:1] or [Phrase(())]
    out = full[0]
    for p in full[1:]:
        out = Both(out, p)
    return out


def expression(query: str):
    """The boolean expression that a query means.

    Quoted spans and other words are phrases (a word with punctuation inside is a phrase of its parts); phrases side by
    side must all be there, which binds tightest, then NOT, AND, OR. Operators at an end or side by side, or an open
    quote, make every word a plain one.
    """
    spans = _spans((query or "").replace("\0", ""))
    ops = [s in OPERATORS for s in spans]
    broken = any(s[0] == '"' and (len(s) < 2 or s[-1] != '"') for s in spans)
    if broken or (ops and (ops[0] or ops[-1])) or any(a and b for a, b in zip(ops, ops[1:])):
        return _all([Phrase(words_of(w)) for w in re.findall(r"\S+", query) if w.strip('"')])
    groups, between = [[]], []
    for s, is_op in zip(spans, ops):
        if is_op:
            between.append(s)
            groups.append([])
        else:
            groups[-1].append(Phrase(words_of(s)))
    values = [_all(g) for g in groups]
    for op, made in (("NOT", Without), ("AND", Both), ("OR", Either)):
        i = 0
        while i < len(between):
            if between[i] == op:
                values[i : i + 2] = [made(values[i], values[i + 1])]
                del between[i]
            else:
                i += 1
    return values[0]


def phrases_of(tree) -> list[Phrase]:
    """All phrases of an expression that a match may hold: those to be left out aren't among them."""
    if isinstance(tree, Phrase):
        return [tree]
    return phrases_of(tree.left) + ([] if isinstance(tree, Without) else phrases_of(tree.right))


def any_of(terms: list[str]):
    """The expression of any term; of those without words none."""
    return reduce(Either, [Phrase(w) for w in map(words_of, terms) if w] or [Phrase(())])


def terms(query: str) -> list[str]:
    """Lower-case ranking terms: quoted spans whole, other words without operators, stopwords and marks at their edges.
    Stopwords stay where there is nothing else."""
    text = (query or "").replace("`", " ")
    bare = lambda words: [x for x in (w.lower().strip(EDGE) for w in words) if x]
    if re.search(r'\b(?:AND|OR|NOT)\b|".*?"|\*$', text):
        quoted = [x.strip().lower() for x in re.findall(r'"([^"]+)"', text) if x.strip()]
        rest = [w for w in re.sub(r'"[^"]*"', " ", text).split() if w not in (*OPERATORS, "|")]
        found = quoted + bare(rest) or bare(w for w in text.split() if w not in OPERATORS)
    else:
        text = re.sub(r"(?<=\w)-(?=\w)", " ", text)
        found = bare(re.sub(r"[:^()\[\]{}]", " ", text).split())
    return [t for t in found if " " in t or t not in STOPWORDS] or found


def cleaned(text: str) -> str:
    """A literal without quotes, operators and runs of spaces."""
    return re.sub(r"\s+", " ", re.sub(r"\b(?:AND|OR|NOT)\b", " ", re.sub("[\"']", "", text))).strip()


def alternatives(query: str) -> list[str]:
    """Distinct literal alternatives of a substring query, between pipes or an unquoted OR."""
    out: list[str] = []
    for part in (query or "").split("|"):
        spans = [*_spans(part), "OR"]
        at = 0
        for i, s in enumerate(spans):
            if s == "OR":
                out.append(cleaned(" ".join(spans[at:i])))
                at = i + 1
    return list(dict.fromkeys(x for x in out if x))


_AGE = re.compile(r"(\d+)([hdw])")
_UNIT = {"h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}


def time_bound(value: str, now: datetime, strict: bool = True) -> datetime | None:
    """A relative age (2h, 7d, 3w) before `now`, or an ISO time, in UTC; else an error, or None if not `strict`."""
    if age := _AGE.fullmatch(value.strip()):
        return now - int(age[1]) * _UNIT[age[2]]
    try:
        given = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        if strict:
            raise ValueError(f"not an age like 2h, 7d, 3w nor an ISO time: {value!r}") from None
        return None
    return given if given.tzinfo else given.replace(tzinfo=UTC)
