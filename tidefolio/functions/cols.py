"""Column expressions shared by the operators.

Missing is NULL everywhere (NaN is turned into NULL at the sources), and a
division by zero is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from tidefolio.functions import fixed as K


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive(c: Column) -> Column:
    """The value where it is above zero, else NULL."""
    return F.when(c > 0, c)


def flag(c: Column) -> Column:
    """0/1 column as a boolean; a missing flag is false."""
    return F.coalesce(c == 1, F.lit(False))


def flexible_date(c: Column) -> Column:
    """Date from a date, timestamp, ISO or slash text, or YYYYMMDD digits.

    Digits outside 10000101..99991231, or that name no day, give NULL.
    """
    text = F.trim(c.cast("string"))
    digits = F.regexp_extract(text, r"^(\d{8})(\.0+)?$", 1)
    return F.coalesce(
        F.when(
            digits.between("10000101", "99991231"), F.try_to_date(digits, "yyyyMMdd")
        ),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
        F.try_to_date(F.substring(text, 1, 10), "yyyy/MM/dd"),
    )


def is_member(index: str) -> Column:
    """Membership of an index on the row's date."""
    if index in K.WHOLE_MARKET:
        return F.lit(True)
    if index not in K.INDEX_FLAGS:
        raise ValueError(f"unknown index {index!r}; use one of {sorted(K.INDEX_FLAGS)} or 'all'")
    return flag(F.col(K.INDEX_FLAGS[index]))


def _at_limit(limit: str, tolerance: float) -> Column:
    price = positive(F.col(limit))
    return (F.col("trade_status") == K.TRADING) & (
        ratio(F.abs(F.col("close") - price), price) < tolerance
    )


def trading_status(new_days: int = K.NEW_LISTING_DAYS, tolerance: float = K.LIMIT_TOLERANCE) -> Column:
    """State of a name on a date.

    Special treatment and new listings come before suspension, suspension
    before limit-down, limit-down before limit-up. An unknown list_days is
    not new.
    """
    return (
        F.when(flag(F.col("is_st")), K.NEW_LISTING)
        .when(F.col("list_days") < new_days, K.NEW_LISTING)
        .when(F.col("trade_status") == K.HALTED, K.SUSPENDED)
        .when(_at_limit("limit_down", tolerance), K.LIMIT_DOWN)
        .when(_at_limit("limit_up", tolerance), K.LIMIT_UP)
        .otherwise(K.NORMAL)
    )


def is_banned(status: Column) -> Column:
    return status.isin(*K.BANNED)


def cannot_buy() -> Column:
    """Suspended, or closed within 0.1 % of the upper limit or above."""
    return F.coalesce(F.col("trade_status") == K.HALTED, F.lit(False)) | F.coalesce(
        F.col("close") >= F.col("limit_up") * K.BUY_LIMIT_RATIO, F.lit(False)
    )


def cannot_sell() -> Column:
    """Suspended, or closed within 0.1 % of the lower limit or below."""
    return F.coalesce(F.col("trade_status") == K.HALTED, F.lit(False)) | F.coalesce(
        F.col("close") <= F.col("limit_down") * K.SELL_LIMIT_RATIO, F.lit(False)
    )


def tier_factor(free_mv: Column, total_mv: Column) -> Column:
    """Free-float share rounded up to tenths: 1.0 above 80 %, at least 0.1.

    NULL where either value is missing or not positive.
    """
    share = ratio(positive(free_mv), positive(total_mv))
    # greatest() skips NULLs, so the missing case is left out first
    return F.when(share > 0.8, F.lit(1.0)).when(
        share.isNotNull(), F.greatest(F.ceil(share * 10) / F.lit(10.0), F.lit(0.1))
    )


def bounds_map(bound: float | Mapping[str, float]) -> Column:
    """Map factor -> bound; a single number becomes the default of all."""
    items = bound.items() if isinstance(bound, Mapping) else [("default", bound)]
    pairs = [F.lit(x) for k, v in items for x in (str(k), float(v))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")


def bound_for(bounds: Column, factor: Column) -> Column:
    """Bound of a factor: its own, else the default, else none (1e6)."""
    return F.coalesce(
        F.try_element_at(bounds, factor),
        F.try_element_at(bounds, F.lit("default")),
        F.lit(K.UNBOUNDED),
    )


def hash_uniform(first: int, *parts: Column) -> Column:
    """Number in (0, 1) from 12 hex digits of the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    number = F.conv(F.substring(digest, first, 12), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(2**48))


def hash_normal(*parts: Column) -> Column:
    """Standard normal draw that depends only on the parts."""
    u1, u2 = hash_uniform(1, *parts), hash_uniform(13, *parts)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
