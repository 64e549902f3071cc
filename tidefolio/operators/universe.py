"""The cross-section of names on each date: state, size, membership, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import flag, is_banned, is_member, trading_status
from tidefolio.operators.crosssection import share_of_total
from tidefolio.operators.groups import top_rows


def snapshot(panel: DataFrame, index: str = "zz500", new_days: int = K.NEW_LISTING_DAYS) -> DataFrame:
    """(date, code) rows with status, market_cap (yuan), industry, is_constituent, adv.

    ``panel`` may hold any number of dates and carries ``adv`` when liquidity
    is needed.
    """
    extra = [c for c in ("adv", "prev_weight", "is_st") if c in panel.columns]
    return panel.select(
        "date",
        "code",
        trading_status(new_days).alias("status"),
        (F.col("float_mv") * 1e4).alias("market_cap"),
        F.coalesce("industry_l1", F.lit(K.UNKNOWN_INDUSTRY)).alias("industry"),
        is_member(index).alias("is_constituent"),
        *extra,
    )


def status_masks(snap: DataFrame) -> DataFrame:
    """Add a boolean column for each state, and ``tradable``."""
    status = F.col("status")
    return snap.withColumns(
        {
            "suspended": status == K.SUSPENDED,
            "limit_up": status == K.LIMIT_UP,
            "limit_down": status == K.LIMIT_DOWN,
            "new_listing": status == K.NEW_LISTING,
            "tradable": ~is_banned(status),
        }
    )


def filter_universe(
    snap: DataFrame, exclude_bj: bool = True, exclude_st: bool = True, top_n: int | None = None
) -> DataFrame:
    """Drop Beijing listings and special treatment, then keep the largest names.

    An unknown market cap counts as 0; ties keep the first code.
    """
    if exclude_bj:
        snap = snap.where(~F.col("code").endswith(".BJ"))
    if exclude_st:
        snap = snap.where(~flag(F.col("is_st")))
    if top_n is not None:
        cap = F.coalesce("market_cap", F.lit(0.0))
        snap = top_rows(snap, ["date"], [cap.desc(), F.col("code")], top_n)
    return snap


def reduce_universe(
    snap: DataFrame, mode: str = "constituent_only", n_off_benchmark: int = 0, max_rows: int | None = None
) -> DataFrame:
    """Members only, or members and the most traded others; previous weights sum to 1 again."""
    members = snap.where("is_constituent")
    if mode == "constituent_only":
        kept = members
    elif mode == "constituent_plus":
        others = snap.where(~F.col("is_constituent"))
        kept = members.unionByName(
            top_rows(others, ["date"], [F.col("adv").desc(), F.col("code")], n_off_benchmark)
        )
    else:
        raise ValueError(f"unknown mode {mode!r}; use constituent_only or constituent_plus")
    return share_of_total(kept, "prev_weight", "prev_weight", tiny=1e-10, max_rows=max_rows)


def default_prev_weights(snap: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Add ``prev_weight``: equal over members that are not new listings, else 0."""
    chosen = F.col("is_constituent") & (F.col("status") != K.NEW_LISTING)
    rows = snap.withColumn("_chosen", F.when(chosen, 1.0).otherwise(0.0))
    return share_of_total(
        rows, "_chosen", "prev_weight", tiny=0.0, max_rows=max_rows
    ).drop("_chosen")


def index_union(panel: DataFrame) -> DataFrame:
    """Names of any of the three indices."""
    any_flag = flag(F.col("is_hs300")) | flag(F.col("is_zz500")) | flag(F.col("is_zz1000"))
    return panel.where(any_flag)


def fill_missing(df: DataFrame) -> DataFrame:
    """Fill the attributes an allocation needs: adv, alpha, weights, industry."""
    fills = {
        "adv": K.ADV_FILL, "alpha": 0.0, "x": 0.0, "bm_weight": 0.0, "prev_weight": 0.0,
        "industry": K.UNKNOWN_INDUSTRY,
    }
    return df.fillna({c: v for c, v in fills.items() if c in df.columns})


def without_cdr(panel: DataFrame) -> DataFrame:
    """Rows whose market value may be checked as shares times price."""
    return panel.where(~F.col("code").isin(*K.CDR_CODES))


def universe_counts(snap: DataFrame) -> DataFrame:
    """Names of each state per date."""
    states = (K.NORMAL, K.SUSPENDED, K.LIMIT_UP, K.LIMIT_DOWN, K.NEW_LISTING)
    return snap.groupBy("date").agg(
        F.count(F.lit(1)).alias("names"),
        *[F.count_if(F.col("status") == s).alias(s) for s in states],
        F.count_if("is_constituent").alias("members"),
    )
