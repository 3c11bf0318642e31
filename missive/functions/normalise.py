"""Text as search stores it: NFKC, case folded, white space as single blanks, none at the ends."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")
_LONE = re.compile("[\ud800-\udfff]")


def normalise(text: str) -> str:
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", without_surrogates(text)).casefold()).strip()


def without_surrogates(text: str) -> str:
    """Lone surrogates, which have no UTF-8 form, become question marks."""
    return _LONE.sub("?", text)


@F.arrow_udf(T.StringType())
def normalised(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalise(t) for t in text.to_pylist()], pa.string())


def folded(text: Column) -> Column:
    """The same for text in composed Latin letters, in the JVM: for such, NFKC changes nothing
    and case folding differs from lower case only in the sharp s."""
    lower = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(lower, r"(?U)\s+", " "))


def stored_form(text: Column) -> Column:
    """``normalise`` of any text: in the JVM where it is Latin-1 without the characters that have other forms there, and
    in Python for the others."""
    plain = text.rlike(r"^[\x00-\x1b\x20-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff]*$")
    return F.coalesce(normalised(F.when(~plain, text)), folded(text))
