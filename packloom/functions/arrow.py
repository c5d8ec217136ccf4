"""Scalar functions that have no built-in form, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import html
import posixpath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; not symmetric, the first text is the reference."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All entities, decoded again while that changes the text, up to 4 times."""

    def one(v):
        for _ in range(4):
            new = html.unescape(v)
            if new == v:
                break
            v = new
        return v

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def normal_path(s: pd.Series) -> pd.Series:
    """A decoded, normalised path; leading dots and slashes go, as a set of
    characters."""
    return s.map(lambda v: posixpath.normpath(unquote(v).replace("\\", "/")).lstrip("./"), na_action="ignore")


@F.pandas_udf(DoubleType())
def round_half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, which no built-in reproduces."""
    return pd.Series([None if v != v else round(v, int(d)) for v, d in zip(x, digits)])


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Letters after any other character in upper case, all others in lower case."""
    return s.map(lambda v: v.title(), na_action="ignore")
