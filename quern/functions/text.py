"""Column functions on texts and numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.session import WHITE, spark_python_white

_WHITE = spark_python_white()


def strip(c: Column) -> Column:
    """c without white space at both ends, as str.strip has it."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(c, f"[{_WHITE}]+", " ")


def is_blank(c: Column) -> Column:
    """Whether c is null or holds white space alone."""
    return F.coalesce(strip(c) == "", F.lit(True))


def is_english_hint(c: Column) -> Column:
    """en, or en- and more, in any case, _ read as -; null is not English."""
    hint = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-"))
    return (hint == "en") | hint.startswith("en-")


def join_lines(*parts: Column) -> Column:
    """The non-empty parts, one per line."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), "\n")


def rounded(c: Column, digits: int) -> Column:
    """c to so many digits, halves up; the form that engines agree on."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def rounded_even(c: Column, digits: int) -> Column:
    """c correctly rounded to so many digits (up to 7) from its binary value, true halves to the even digit.

    The product with the scale is not exact; what it lacks is found by splitting c in two halves whose products are.
    """
    scale = F.lit(float(10**digits))
    product = c * scale
    high = c * 134217729.0 - (c * 134217729.0 - c)
    lacking = (high * scale - product) + (c - high) * scale
    below = F.floor(product).cast("double")
    over = (product - below - 0.5) + lacking
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(below, F.lit(2.0)))
    return F.when(F.abs(product) < 4e15, (below + up) / scale).otherwise(c)


def is_probability(c: Column) -> Column:
    """Whether c is a finite number in [0, 1]; null and NaN are none."""
    return F.coalesce(~F.isnan(c) & c.between(0.0, 1.0), F.lit(False))


def _ascii_udf():  # noqa: ANN202
    """A pandas UDF: the ASCII letters of the compatibility decomposition, which the JVM functions lack."""
    import unicodedata

    @F.pandas_udf("string")
    def ascii_form(names: pd.Series) -> pd.Series:
        coded, distinct = pd.factorize(names)
        plain = [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in distinct]
        return pd.Series([None if k < 0 else plain[k] for k in coded], dtype=object)

    return ascii_form


def directory_name(name: Column, strict: bool = False) -> Column:
    """name as a path: ASCII, runs of other signs as -, none of . - _ at the ends. Null stays null.

    A name of which nothing is left gives null, or with strict an error.
    """
    path = F.regexp_replace(F.regexp_replace(_ascii_udf()(name), r"[^\w.\-]+", "-"), r"^[._\-]+|[._\-]+$", "")
    left = F.when(path != "", path)
    return F.when(name.isNotNull() & (path == ""), F.raise_error(F.concat(F.lit("no directory name is left of "), name))).otherwise(left) if strict else left
