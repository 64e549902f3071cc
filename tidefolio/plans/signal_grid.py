"""The calibration grid: every point and seed measured in one job.

Spark deals the series of the codes and then, packed, the sections of the
dates; within a task all points of many codes are smoothed and ranked as numpy
arrays, in which a day of one point and code is one number and not a row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import hash_normal
from tidefolio.operators import signals as sg
from tidefolio.operators.calendar import with_day
from tidefolio.operators.groups import fits_one_task
from tidefolio.session import cut_lineage

STATS = ["ic", "ic_std", "icir", "ir_theory", "ls_ir", "ls_ann", "autocorr", "turnover"]
HELD = 1 << 18  # rows of whole series that are smoothed at once, about, and numbers of one of their days over all cells
TOGETHER = 4  # cells whose sections share the codes and returns they are packed with
COMMON = 10  # codes that two dates must have more of in common
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors need not have this package


def _coefficients(forward: DataFrame, calendar: DataFrame, points: Sequence[tuple[float, float, float]], seeds: Sequence[int]) -> DataFrame:
    """(cell, in_ic, in_ic_std, decay, seed, days): per day of the calendar a, b, m with the standardised signal a z + b noise - m.

    A date's signal is linear in z and the noise, so its mean and deviation
    follow from moments of the two; no point is spread over the names for them.
    """
    of_seed = [F.get("noise", F.lit(i)) for i in range(len(seeds))]
    figures = [F.struct(F.avg(e).alias("me"), F.var_samp(e).alias("ve"), F.covar_samp("z", e).alias("c")).alias(f"_{i}") for i, e in enumerate(of_seed)]
    wide = _noisy(forward, seeds).groupBy("date").agg(F.avg("z").alias("mz"), F.var_samp("z").alias("vz"), *figures)
    by_seed = F.array(*[F.struct(F.lit(int(s)).alias("seed"), f"_{i}.me", f"_{i}.ve", f"_{i}.c") for i, s in enumerate(seeds)])
    moments = wide.select("date", "mz", "vz", F.explode(by_seed).alias("_m")).select("date", "mz", "vz", "_m.*")
    days = cut_lineage(calendar.select("date", "day").join(cut_lineage(moments), "date", "left").where("seed is not null"))
    cells = sg.with_points(days, points).withColumn("_zr", hash_normal(F.col("seed"), F.col("date")))
    rho = F.least(F.greatest(F.col("in_ic") + F.col("in_ic_std") * F.col("_zr"), F.lit(-0.95)), F.lit(0.95))
    x, y = F.col("_x"), F.col("_y")
    spread = F.sqrt(F.greatest(x * x * F.col("vz") + y * y * F.col("ve") + 2 * x * y * F.col("c"), F.lit(0.0))) + 1e-10
    at = cells.withColumn("_x", rho).withColumn("_y", F.sqrt(1 - x * x)).withColumn("_d", spread)
    row = F.struct("day", (x / F.col("_d")).alias("a"), (y / F.col("_d")).alias("b"), ((x * F.col("mz") + y * F.col("me")) / F.col("_d")).alias("m"))
    by_day = F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("int"), row))).alias("_by")
    held = at.groupBy("in_ic", "in_ic_std", "decay", "seed").agg(by_day).crossJoin(F.broadcast(calendar.agg(F.max("day").cast("int").alias("_last"))))
    dense = held.withColumn("days", F.transform(F.sequence(F.lit(0), "_last"), lambda i: F.try_element_at("_by", i))).drop("_by", "_last")
    return cut_lineage(dense.withColumn("cell", F.row_number().over(Window.orderBy("in_ic", "in_ic_std", "decay", "seed"))))


def _noisy(forward: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """The rows with ``noise``: per seed that of (seed, date, code) as in `calibration_signals`."""
    drawn = [hash_normal(F.lit(int(s)), F.col("date"), F.col("code")) for s in seeds]
    return forward if "noise" in forward.columns else forward.withColumn("noise", F.array(*drawn))


def _arrays(coefficients: DataFrame, seeds: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Of the cells by number: a, b, m per day of the calendar (NaN: none), the decay, and the place of the seed."""
    cells = coefficients.orderBy("cell").select("days", "decay", "seed").toArrow().combine_chunks()
    days = cells["days"].combine_chunks().flatten() if cells.num_rows else pa.array([], pa.struct([(c, pa.float64()) for c in "abm"]))
    lines = [pc.struct_field(days, c).to_numpy(zero_copy_only=False).reshape(cells.num_rows, -1 if len(days) else 0) for c in "abm"]
    return *lines, cells["decay"].to_numpy(), np.array([list(seeds).index(s) for s in cells["seed"].to_pylist()], np.int64)


def _series(batches: Iterator[pa.RecordBatch], codes: int) -> Iterator[pa.Table]:
    """The rows of batches sorted by code in tables of whole codes: about `HELD` rows and `codes` codes at most."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if not n or (batch is not None and n < HELD):
            continue
        rows = pa.Table.from_batches(held)
        code = rows["code"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        ends = [*first[codes::codes], n] if batch is None else [*first[:-1][codes::codes], first[-1]]
        for start, end in zip([0, *ends], ends, strict=False):
            if end > start:
                yield rows.slice(start, end - start).combine_chunks()
        held, n = rows.slice(ends[-1]).to_batches(), n - int(ends[-1])


def _smoothed(rows: pa.Table, lines: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """(place, rows, code numbers, f, before) per evaluated day of whole series: f by cell and row, as in `timeseries.smooth`.

    ``before``: f of the code on the place before, NaN and not ``there`` if it has none.
    """
    a, b, m, decay, of_seed = lines
    code = rows["code"].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    day, place, z = (rows[c].to_numpy() for c in ("day", "place", "z"))
    noise = np.ascontiguousarray(rows["noise"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).T)
    d = decay[:, None]
    root = np.sqrt(1 - d * d)
    codes = int(code.max()) + 1
    held, held_day = np.zeros((len(decay), codes)), np.full(codes, -2)
    shown, shown_place = np.zeros((len(decay), codes)), np.full(codes, -2)
    by_day = np.argsort(day, kind="stable")
    for at in np.split(by_day, np.flatnonzero(np.diff(day[by_day])) + 1):
        t, p, who = int(day[at[0]]), int(place[at[0]]), code[at]
        f = a[:, t, None] * z[at] + b[:, t, None] * noise[:, at][of_seed] - m[:, t, None]
        goes_on = held_day[who] == t - 1
        if goes_on.any():
            f = np.where(goes_on, d * held[:, who] + root * f, f)
        held[:, who], held_day[who] = f, t
        if p >= 0:
            there = shown_place[who] == p - 1
            yield p, at, who, f, np.where(there, shown[:, who], np.nan), there
            shown[:, who], shown_place[who] = f, p


def _dated(forward: DataFrame, calendar: DataFrame, places: DataFrame, seeds: Sequence[int]) -> DataFrame:
    rows = with_day(_noisy(forward, seeds).select("date", "code", "z", "fwd_ret", "noise"), calendar).join(F.broadcast(places), "date", "left")
    return rows.select("code", F.col("day").cast("int").alias("day"), F.coalesce("place", F.lit(-1)).alias("place"), "z", "fwd_ret", "noise")


def _point_rows(forward: DataFrame, calendar: DataFrame, places: DataFrame, coefficients: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(cell, place, code, f, before, fwd_ret) on the evaluated dates; ``before``: f of the place before, NULL if the code is not there."""
    lines = _arrays(coefficients, seeds)
    rows = _dated(forward, calendar, places, seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(lines[3])
        for part in _series(batches, max(1, HELD // max(1, cells))):
            for p, at, _, f, before, there in _smoothed(part, lines):
                columns = [np.repeat(np.arange(cells, dtype=np.int32) + 1, len(at)), np.full(f.size, p, np.int32), f.ravel(), before.ravel()]
                cell, place, f, before = (pa.array(c, mask=k) for c, k in zip(columns, (None, None, None, np.tile(~there, cells)), strict=True))
                named = [part[c].combine_chunks().take(pa.array(np.tile(at, cells))) for c in ("code", "fwd_ret")]
                yield pa.record_batch([cell, place, named[0], f, before, named[1]], ["cell", "place", "code", "f", "before", "fwd_ret"])

    schema = f"cell int, place int, code {rows.schema['code'].dataType.simpleString()}, f double, before double, fwd_ret double"
    return rows.repartition("code").sortWithinPartitions("code", "day").mapInArrow(work, schema)


def _packed(forward: DataFrame, calendar: DataFrame, places: DataFrame, coefficients: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(share, place, start, codes, who, fwd_ret, f): the sections of `TOGETHER` cells in parts, of codes that follow each other from ``start``.

    ``who`` numbers the part's ``codes`` codes in their order, the same on every place.
    """
    lines = _arrays(coefficients, seeds)
    rows = _dated(forward, calendar, places, seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = range(-(-len(lines[3]) // TOGETHER))
        for part in _series(batches, max(1, HELD // max(1, len(lines[3])))):
            ahead, codes = part["fwd_ret"].to_numpy(), pc.count_distinct(part["code"], "all").as_py()
            for p, at, who, f, _, _ in _smoothed(part, lines):
                start = pa.concat_arrays([part["code"].combine_chunks().slice(0, 1)] * len(shares))
                packed = [[who.astype(np.int32).tobytes()] * len(shares), [ahead[at].tobytes()] * len(shares), [f[i * TOGETHER : (i + 1) * TOGETHER].tobytes() for i in shares]]
                columns = [pa.array(shares, pa.int32()), pa.array([p] * len(shares), pa.int32()), start, pa.array([codes] * len(shares), pa.int32()), *[pa.array(c, pa.binary()) for c in packed]]
                yield pa.record_batch(columns, ["share", "place", "start", "codes", "who", "fwd_ret", "f"])

    schema = f"share int, place int, start {rows.schema['code'].dataType.simpleString()}, codes int, who binary, fwd_ret binary, f binary"
    return rows.repartitionByRange("code").sortWithinPartitions("code", "day").mapInArrow(work, schema)


def _ranks(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the values, sorted by ``order``: ranks from 1 with ties at their mean, and the number of each among the different ones."""
    up = values[order]
    new = np.concatenate(([True], (up[1:] != up[:-1]) & ~(np.isnan(up[1:]) & np.isnan(up[:-1]))))
    first = np.flatnonzero(new)
    ties = np.diff(np.concatenate((first, [len(up)])))
    which, rank, level = np.cumsum(new) - 1, np.zeros(len(values)), np.zeros(len(values), np.int64)
    rank[order], level[order] = (first + (ties + 1) / 2)[which], which
    return rank, level


def _corr(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation; None where one of them does not vary."""
    if not len(x):
        return None
    x, y = x - x.mean(), y - y.mean()
    both = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return float(x @ y) / both if both > 0 else None


def _first(level: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Whether a value is among the first k by level; of the last one's ties the first ones count."""
    last = level[order[k - 1]]
    chosen = np.zeros(len(level), bool)
    ahead = order[:k][level[order[:k]] != last]
    chosen[ahead] = True
    chosen[np.flatnonzero(level == last)[: k - len(ahead)]] = True
    return chosen


def _section(f: np.ndarray, ahead: np.ndarray, ranks: np.ndarray, q: float, at: np.ndarray, was: tuple | None) -> tuple[tuple, tuple]:
    """(ic, long_short, autocorr, turnover) of one cell and place, and what the next place needs of it.

    ``at``: the place of each code in ``was``, the f, order and top group of the place before, or -1.
    """
    order = np.argsort(f)
    rank, level = _ranks(f, order)
    k = max(int(np.floor(len(f) * q)), 1)
    top, bottom = _first(level, order[::-1], k), _first(level, order, k)
    auto = turnover = None
    if was is not None:
        f0, order0, top0 = was
        both = at >= 0
        met = np.zeros(len(f0), bool)
        met[at[both]] = True
        if both.sum() > COMMON:
            now, before = (_ranks_of(v, o, kept) for v, o, kept in ((f, order, both), (f0, order0, met)))
            auto = _corr(now[both], before[at[both]])
        turnover = 1 - int(np.count_nonzero(top0[at[both]] & top[both])) / k
    return (_corr(rank, ranks), float(ahead[top].mean() - ahead[bottom].mean()), auto, turnover), (f, order, top)


def _ranks_of(values: np.ndarray, order: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Ranks among the kept values, at their places; the others' are 0."""
    number = np.cumsum(kept) - 1
    out = np.zeros(len(values))
    out[kept] = _ranks(values[kept], number[order[kept[order]]])[0]
    return out


def _measured(packed: DataFrame, q: float) -> DataFrame:
    """(cell, place, ic, long_short, autocorr, turnover) of packed sections; a task holds one place of `TOGETHER` cells and the one before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, share, place, numbers, known, was, ids0 = [], None, None, {}, 0, {}, None
        for row in chain((r for b in batches for r in zip(*b.columns, strict=True)), [None]):
            key = None if row is None else (row[0].as_py(), row[1].as_py())
            if parts and key != (share, place):
                ids, ahead = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
                lines = np.concatenate([x[2] for x in parts], axis=1)
                at = np.full(known, -1)
                if ids0 is not None:
                    at[ids0] = np.arange(len(ids0))
                ranks = _ranks(ahead, np.argsort(ahead))[0]
                out = []
                for i, f in enumerate(lines):
                    figures, was[i] = _section(f, ahead, ranks, q, at[ids], was.get(i))
                    out.append((share * TOGETHER + i + 1, place, *figures))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                parts, ids0 = [], ids
            if row is None:
                return
            if key[0] != share:
                numbers, known, was, ids0 = {}, 0, {}, None
            share, place = key
            who, ahead, f = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row[4:], (np.int32, float, float), strict=True))
            start = row[2].as_py()
            if start not in numbers:
                numbers[start] = known
                known += row[3].as_py()
            parts.append((numbers[start] + who.astype(np.int64), ahead, f.reshape(-1, len(who))))

    names = ["cell", "place", "ic", "long_short", "autocorr", "turnover"]
    kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
    schema = "cell int, place int, ic double, long_short double, autocorr double, turnover double"
    return packed.repartition("share").sortWithinPartitions("share", "place", "start").mapInArrow(work, schema)


def _down(f: str) -> Column:
    """Orders the codes from the largest f, which is NaN."""
    return F.struct((~F.isnan(f)).alias("known"), (-F.col(f)).alias("f"), "code")


def _measured_apart(rows: DataFrame, q: float, max_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """(cell, place, ic, long_short, …) and (cell, place, autocorr, turnover) of the rows of `_point_rows`, none of whose sections one task need hold."""
    section = ["cell", "place"]
    rows = sg.top_and_bottom(rows, "f", q, section, max_rows).withColumn("both", F.col("before").isNotNull())
    rows = sg.average_ranks(rows, section, {"_rf": "f", "_rr": "fwd_ret"}, max_rows)
    rows = cut_lineage(sg.average_ranks(rows, [*section, "both"], {"_cf": "f", "_cb": "before"}, max_rows))
    mark = rows.groupBy(*section).agg(
        F.corr("_rf", "_rr").alias("ic"),
        (F.avg(F.when(F.col("top"), F.col("fwd_ret"))) - F.avg(F.when(F.col("bottom"), F.col("fwd_ret")))).alias("long_short"),
        F.corr(F.when(F.col("both"), F.col("_cf")), F.when(F.col("both"), F.col("_cb"))).alias("_auto"),
        F.count_if("both").alias("_common"),
        F.max("k").alias("k"),
        F.max(F.when(F.col("top"), _down("f"))).alias("_end"),
    )
    mark = cut_lineage(mark.withColumn("ic", F.when(~F.isnan("ic"), F.col("ic"))))
    again = rows.where(F.col("top") & F.col("both")).select(*section, _down("before").alias("_down"))
    ends = cut_lineage(mark.select("cell", (F.col("place") + 1).alias("place"), F.col("_end").alias("_was")))
    held = again.join(F.broadcast(ends), section).where(F.col("_down") <= F.col("_was"))
    stayed = held.groupBy(*section).agg(F.count(F.lit(1)).alias("_stayed"))
    auto = F.when((F.col("_common") > COMMON) & ~F.isnan("_auto"), F.col("_auto"))
    turnover = 1 - F.coalesce("_stayed", F.lit(0)) / F.col("k")
    moves = mark.join(ends, section, "left_semi").join(stayed, section, "left").select(*section, auto.alias("autocorr"), turnover.alias("turnover"))
    return mark, moves


def measure_points(
    panel: DataFrame,
    calendar: DataFrame,
    points: Sequence[tuple[float, float, float]],
    seeds: Sequence[int] = K.GRID_SEEDS,
    fwd_days: int = 5,
    every: int = 5,
    min_names: int = 50,
    q: float = 0.2,
    price: str = "adj_close",
    max_rows: int | None = None,
) -> DataFrame:
    """Statistics of each point, averaged over the seeds.

    The measures are those of `calibration_signals`, `measured_rows`,
    `information_coefficients` and `persistence`; the last scaling of a signal
    changes no rank and is left out. The sections of all points are dealt once.
    Those that one task may hold are packed and ranked there; the rows of larger
    ones are ranked over all tasks.
    """
    forward = cut_lineage(_noisy(sg.standard_forward_returns(panel, calendar, fwd_days, min_names, price, max_rows), seeds))
    dates = cut_lineage(sg.evaluation_dates(panel, calendar, fwd_days, every, min_names, price))
    counted = forward.join(F.broadcast(dates), "date", "left_semi").groupBy("date").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") >= min_names)
    places = cut_lineage(counted.select("date", F.row_number().over(Window.orderBy("date")).alias("place")))
    cells = _coefficients(forward, calendar, points, seeds)
    if fits_one_task(forward, max_rows):
        mark = cut_lineage(_measured(_packed(forward, calendar, places, cells, seeds), q))
        moves = mark.where(F.col("turnover").isNotNull())
    else:
        mark, moves = _measured_apart(_point_rows(forward, calendar, places, cells, seeds), q, max_rows)
    stats = sg.signal_statistics(mark, moves, ["cell"], fwd_days).join(F.broadcast(cells.drop("days")), "cell")
    return stats.groupBy("in_ic", "in_ic_std", "decay").agg(*[F.avg(c).alias(c) for c in STATS])


def run_grid(
    panel: DataFrame,
    calendar: DataFrame,
    points: Sequence[tuple[str, float, float, float]] | None = None,
    seeds: Sequence[int] = K.GRID_SEEDS,
    **options,
) -> DataFrame:
    """One row per (sweep, point) with inputs, measured statistics and seed count.

    Points of equal values after rounding to six places are measured once,
    with the values of the first; each of their sweeps has a row.
    """
    points = sg.grid_points() if points is None else list(points)
    first = {tuple(round(x, 6) for x in p[1:]): p[1:] for p in sg.distinct_points(points)}
    points = list(dict.fromkeys((s, *first[round(a, 6), round(b, 6), round(d, 6)]) for s, a, b, d in points))
    unique = list(first.values())
    stats = measure_points(panel, calendar, unique, seeds, **options)
    sweeps = F.create_map(
        *[
            x
            for key in unique
            for x in (
                F.concat_ws("|", *[F.lit(float(v)).cast("string") for v in key]),
                F.array(*[F.lit(s) for s, a, b, d in points if (a, b, d) == key]),
            )
        ]
    )
    at = F.concat_ws("|", *[F.col(c).cast("string") for c in ("in_ic", "in_ic_std", "decay")])
    return stats.select(
        F.explode(sweeps[at]).alias("sweep"),
        "in_ic",
        "in_ic_std",
        (F.col("in_ic") / F.col("in_ic_std")).alias("in_icir"),
        F.col("decay").alias("in_decay"),
        *STATS,
        F.lit(len(seeds)).alias("n_seeds"),
    )
