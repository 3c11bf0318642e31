"""The search syntax as a list of terms.

``alpha "exact phrase" -excluded``: terms are separated by white space of any script, a phrase
is quoted with ``""`` for a quote in it, and a leading ``-`` excludes.  Terms are normalised as
stored text is; what is left empty is an error, as is a query that only excludes.  Terms of
fewer than three characters cannot use a trigram index, which ``has_slow_path`` says.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from missive.functions.normalise import normalise

_TERM = re.compile(r'(?P<minus>-?)(?:"(?P<phrase>(?:[^"]|"")*)"|(?P<word>[^\s"]+))(?=\s|$)')
INDEXED = 3
_BLANK = re.compile(r"\s*")


class QuerySyntaxError(ValueError):
    """The query breaks the search syntax."""


@dataclass(frozen=True)
class SearchPlan:
    """Terms by how they are looked up.  Indexed terms keep quotes doubled inside quotes, the
    others have LIKE's special characters escaped; ``include`` and ``exclude`` are the plain
    normalised terms that the DataFrame predicates use."""

    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    mode: str = "and"

    @property
    def match_terms(self) -> tuple[str, ...]:
        return tuple(map(quoted, filter(_indexed, self.include)))

    @property
    def like_terms(self) -> tuple[str, ...]:
        return tuple(escaped(t) for t in self.include if not _indexed(t))

    @property
    def exclude_match_terms(self) -> tuple[str, ...]:
        return tuple(map(quoted, filter(_indexed, self.exclude)))

    @property
    def exclude_like_terms(self) -> tuple[str, ...]:
        return tuple(escaped(t) for t in self.exclude if not _indexed(t))

    @property
    def has_slow_path(self) -> bool:
        return not all(map(_indexed, self.include + self.exclude))


def _indexed(term: str) -> bool:
    return len(term) >= INDEXED


def quoted(term: str) -> str:
    return '"' + term.replace('"', '""') + '"'


def escaped(term: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", term)


def parse_query(text: str, mode: str = "and") -> SearchPlan:
    if mode not in ("and", "or"):
        raise QuerySyntaxError(f"mode must be 'and' or 'or', not {mode!r}")
    terms: dict[bool, list[str]] = {False: [], True: []}
    at = _BLANK.match(text).end()
    while at < len(text):
        found = _TERM.match(text, at)
        if not found:
            raise QuerySyntaxError(f"cannot read the query from place {at}")
        raw = found["word"] if found["phrase"] is None else found["phrase"].replace('""', '"')
        term = normalise(raw)
        if not term or (found["word"] == "-" and not found["minus"]):
            raise QuerySyntaxError(f"an empty term at place {at}")
        terms[bool(found["minus"])].append(term)
        at = _BLANK.match(text, found.end()).end()
    if not terms[False]:
        raise QuerySyntaxError("a query needs a term that is not excluded")
    return SearchPlan(tuple(terms[False]), tuple(terms[True]), mode)


_LISTS = ("match", "like", "not_match", "not_like")
#: What ``planned`` says of a query.
PLAN = T.StructType([*(T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS), T.StructField("slow", T.BooleanType()), T.StructField("error", T.BooleanType())])


def planned(query: Column) -> Column:
    """``PLAN`` of each query, as a table of saved searches has them; one that breaks the syntax has no terms."""
    kind = pa.struct([*((c, pa.list_(pa.string())) for c in _LISTS), ("slow", pa.bool_()), ("error", pa.bool_())])

    @F.arrow_udf(PLAN)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            try:
                p = parse_query(text or "")
                rows.append(dict(zip(_LISTS, (p.match_terms, p.like_terms, p.exclude_match_terms, p.exclude_like_terms), strict=True)) | {"slow": p.has_slow_path, "error": False})
            except QuerySyntaxError:
                rows.append(dict.fromkeys(_LISTS, []) | {"slow": False, "error": True})
        return pa.array(rows, kind)

    return run(query)
