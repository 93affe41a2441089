"""Query planning: free text to progressively looser match stages.

A stage is a conjunction: quoted phrases, required tokens, and a group of
optional tokens of which one at least must match.  The first stage with a hit
answers the query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.session import workers

#: Words that never become search terms.
STOPWORDS = frozenset(
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its may might must my no not of on or our "
    "should so such than that the their them then there these they this to too use using was we were what when where which who why will with would you your".split()
)
#: Words that say little in a documentation corpus.
LOW_SIGNAL = frozenset("docs documentation documentations document documents example examples guide guides manual reference references tutorial tutorials".split())
MAX_REQUIRED, MAX_OPTIONAL, MAX_FALLBACK, FREE_FROM = 3, 20, 12, 5
_EDGES = "\"',.;:!?()[]"


@dataclass(frozen=True)
class Stage:
    """All of ``every`` and, if there are any, one of ``some`` must match."""

    every: tuple[str, ...] = ()
    some: tuple[str, ...] = ()

    def match(self) -> str:
        """The stage as a full-text match string."""
        quoted = lambda t: '"' + t.replace('"', '""') + '"'
        parts = [quoted(t) for t in self.every]
        if self.some:
            group = " OR ".join(map(quoted, self.some))
            parts.append(f"({group})" if self.every or len(self.some) == 1 else group)
        return " AND ".join(parts)


def pieces(text: str) -> tuple[list[str], list[str]]:
    """(phrases, tokens): closed quotes are phrases; the rest gives tokens, each once whatever its case."""
    parts = text.split('"')
    closed = len(parts) - 1 - (len(parts) - 1) % 2
    phrases = [p.strip() for p in parts[1:closed:2] if p.strip()]
    plain = [*parts[0:closed:2], '"'.join(parts[closed:])]
    words = (w.strip(_EDGES) for p in plain for w in p.split())
    tokens: dict[str, str] = {}
    for w in words:
        if len(w) > 1 and w.lower() not in STOPWORDS:
            tokens.setdefault(w.lower(), w)
    return phrases, list(tokens.values())


def needles(text: str) -> list[str]:
    """Lower-case words that mark a good line: the tokens, then the words of phrases."""
    phrases, tokens = pieces(text)
    words = [w.strip(_EDGES) for p in phrases for w in p.split()]
    return list(dict.fromkeys(w.lower() for w in [*tokens, *(w for w in words if len(w) > 1)]))


def _mixed(token: str) -> bool:
    return len(token) > 3 and not token.islower()


def is_strong(token: str) -> bool:
    """Long, dotted, underscored, numbered or mixed-case tokens."""
    return len(token) > 5 or bool(re.search(r"[_.]", token)) or any(c.isdigit() for c in token) or _mixed(token)


def ranked(tokens: list[str]) -> list[str]:
    """The most telling tokens first; equals keep their order."""
    key = lambda t: (t.lower() not in LOW_SIGNAL, "_" in t or "." in t, _mixed(t), any(c.isdigit() for c in t), len(t))
    return sorted(tokens, key=key, reverse=True)


def required_tokens(tokens: list[str], free: bool) -> list[str]:
    """Tokens that the first stage demands, in query order."""
    pool = ranked([t for t in tokens if is_strong(t)] or tokens)
    pool = [t for t in pool if t.lower() not in LOW_SIGNAL] or pool
    chosen = set(pool[: 2 if free else MAX_REQUIRED])
    return [t for t in tokens if t in chosen]


def stages(text: str) -> list[Stage]:
    """Match stages from strict to loose; none for a query without terms."""
    phrases, tokens = pieces(text)
    free = len(phrases) + len(tokens) >= FREE_FROM
    need = required_tokens(tokens, free)

    def rest(held: list[str]) -> tuple[str, ...]:
        return tuple(t for t in tokens if t not in held)[:MAX_OPTIONAL]

    out = [Stage((*phrases, *need), rest(need))]
    if need and rest(need):
        out.append(Stage((*phrases, need[0]), rest(need[:1])))
    loose = tuple(ranked(tokens)[:MAX_FALLBACK])
    if phrases:
        out.append(Stage(tuple(phrases), loose))
    elif free:
        out.append(Stage((), loose))
    return [s for s in dict.fromkeys(out) if s.every or s.some]


def primary_and_fallback(text: str) -> tuple[Stage | None, Stage | None]:
    found = stages(text)
    return (found[0] if found else None, found[-1] if len(found) > 1 else None)


def plans(queries: DataFrame, column: str) -> DataFrame:
    """The batch form: adds ``plan``, the match strings of each query's stages."""

    def planned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s.match() for s in stages(t or "")])

    workers(queries.sparkSession)
    return queries.withColumn("plan", F.pandas_udf(planned, T.ArrayType(T.StringType()))(F.col(f"`{column}`")))
