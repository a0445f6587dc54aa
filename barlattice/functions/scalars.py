"""Scalar functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def near(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def trade_state(price: Column, volume: Column) -> Column:
    """TRADED, NO_TRADE or UNKNOWN; a missing value is never taken for no trade."""
    return F.when(price.isNull() | volume.isNull(), "UNKNOWN").when(volume == 0, "NO_TRADE").when((price > 0) & (volume > 0), "TRADED").otherwise("UNKNOWN")


def is_special_treatment(name: Column) -> Column:
    return F.upper(F.trim(name)).rlike(r"^\*?ST($|[^A-Z0-9])")


def code_only(text: Column) -> Column:
    """The six digits of a code with or without market prefix or suffix; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^(sh|sz|bj)\.?", ""), r"\.(sh|sz|bj|ss)$", "")
    return F.when(bare.rlike(r"^\d{1,6}$"), F.lpad(bare, 6, "0"))


def with_exchange(code: Column) -> Column:
    first = F.substring(code, 1, 1)
    return F.concat(code, F.when(first == "6", ".SH").when(first.isin("0", "3"), ".SZ").otherwise(".BJ"))


def canonical_date(text: Column) -> Column:
    """yyyy-MM-dd or yyyyMMdd, else null."""
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    plain = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(dashed, plain).cast("date")


def number(text: Column, positive: bool = False) -> Column:
    """A finite number, else null; with ``positive`` zero and below are null as well."""
    x = F.trim(text).try_cast("double")
    ok = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(ok & (x > 0) if positive else ok, x)


def ratio_with_reason(numerator: Column, denominator: Column) -> tuple[Column, Column]:
    reason = F.when(numerator.isNull(), "MISSING_NUMERATOR").when(denominator.isNull(), "MISSING_DENOMINATOR").when(denominator <= 0, "NON_POSITIVE_DENOMINATOR")
    return F.when(reason.isNull(), F.try_divide(numerator, denominator)), reason


@F.pandas_udf(StringType())
def display_name(names: pd.Series) -> pd.Series:
    """NFKC without zero-width characters; Spark has no function for it."""
    drop = dict.fromkeys(map(ord, "​‌‍﻿"))
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).translate(drop).strip())
