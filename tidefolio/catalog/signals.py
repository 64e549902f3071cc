"""Signal research queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.base import load, rounded, stored, with_panel
from tidefolio.catalog.registry import query
from tidefolio.catalog.series import FORWARD
from tidefolio.functions import fixed as K
from tidefolio.operators import signals as sg
from tidefolio.plans import signal_grid
from tidefolio.session import cut_lineage, new_table_path
from tidefolio.sources import sinks

MIN_NAMES = 8
STD_FORWARD = FORWARD.rstrip() + """,
ok AS (SELECT date FROM fwd GROUP BY 1 HAVING count(fwd_ret) > 8),
sf AS (SELECT * FROM (
  SELECT date, code, fwd_ret, avg(fwd_ret) OVER (PARTITION BY date) AS m, stddev_samp(fwd_ret) OVER (PARTITION BY date) AS s
  FROM fwd WHERE fwd_ret IS NOT NULL AND date IN (SELECT date FROM ok)) WHERE s >= 1e-9),
ev AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM ok) WHERE (rn - 1) % 3 = 0)
"""
# the month's reversal as a signal, measured every third valid date
REVERSAL = STD_FORWARD.rstrip() + """,
sig AS (SELECT date, code, 1 - close / pre_close AS f FROM panel WHERE pre_close IS NOT NULL),
"""
# rows(kk, date, code, f, fwd_ret) -> per-date and overall statistics; kk is the key
MEASURE = """
cnt AS (SELECT *, count(*) OVER (PARTITION BY kk, date) AS n FROM rows0),
rows1 AS (
  SELECT *, greatest(CAST(floor(n * 0.2) AS BIGINT), 1) AS k,
    row_number() OVER (PARTITION BY kk, date ORDER BY f DESC, code) AS dn,
    row_number() OVER (PARTITION BY kk, date ORDER BY f, code) AS up,
    rank() OVER (PARTITION BY kk, date ORDER BY f) + (count(*) OVER (PARTITION BY kk, date, f) - 1) / 2.0 AS rf,
    rank() OVER (PARTITION BY kk, date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY kk, date, fwd_ret) - 1) / 2.0 AS rr
  FROM cnt WHERE n >= 8),
ics AS (SELECT kk, date, corr(rf, rr) AS ic,
  avg(fwd_ret) FILTER (WHERE dn <= k) - avg(fwd_ret) FILTER (WHERE up <= k) AS long_short FROM rows1 GROUP BY 1, 2),
prevs AS (SELECT kk, date, lag(date) OVER (PARTITION BY kk ORDER BY date) AS pdate FROM (SELECT DISTINCT kk, date FROM rows1)),
pairs AS (SELECT a.kk, a.date, a.code, a.f, b.f AS g, a.dn <= a.k AS top, b.dn <= b.k AS was, a.k
  FROM rows1 a JOIN prevs p ON p.kk = a.kk AND p.date = a.date AND p.pdate IS NOT NULL
  LEFT JOIN rows1 b ON b.kk = a.kk AND b.date = p.pdate AND b.code = a.code),
turn AS (SELECT kk, date, 1 - count(*) FILTER (WHERE top AND was) / max(k)::DOUBLE AS turnover FROM pairs GROUP BY 1, 2),
rk AS (SELECT *, rank() OVER (PARTITION BY kk, date ORDER BY f) + (count(*) OVER (PARTITION BY kk, date, f) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY kk, date ORDER BY g) + (count(*) OVER (PARTITION BY kk, date, g) - 1) / 2.0 AS r2
  FROM pairs WHERE g IS NOT NULL),
auto AS (SELECT kk, date, CASE WHEN count(*) > 10 THEN corr(r1, r2) END AS autocorr FROM rk GROUP BY 1, 2),
moves AS (SELECT t.kk, t.date, a.autocorr, t.turnover FROM turn t LEFT JOIN auto a ON a.kk = t.kk AND a.date = t.date),
stats AS (
  SELECT i.*, m.autocorr, m.turnover FROM (
    SELECT kk, avg(ic) AS ic, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) + 1e-12) AS icir,
      avg(ic) / (stddev_samp(ic) + 1e-12) * sqrt(252.0 / 2) AS ir_theory,
      avg(long_short) / (stddev_samp(long_short) + 1e-12) * sqrt(252.0 / 2) AS ls_ir, avg(long_short) * (252.0 / 2) AS ls_ann
    FROM ics GROUP BY 1) i
  JOIN (SELECT kk, avg(autocorr) AS autocorr, avg(turnover) AS turnover FROM moves GROUP BY 1) m ON m.kk = i.kk)
"""
REV_ROWS = REVERSAL + """
rows0 AS (SELECT 1 AS kk, s.date, s.code, s.f, r.fwd_ret FROM sig s JOIN sf r ON r.date = s.date AND r.code = s.code
  WHERE s.date IN (SELECT date FROM ev)),
""" + MEASURE
STAT_COLS = ["ic", "ic_std", "icir", "ir_theory", "ls_ir", "ls_ann", "autocorr", "turnover"]
_STATS = ", ".join(f"round({c}, 6) AS {c}" for c in STAT_COLS)


@query(with_panel("SELECT date, code, round(fwd_ret, 6) AS fwd_ret, round((fwd_ret - m) / s, 6) AS z FROM sf", STD_FORWARD))
def standard_forward_returns(spark, sf):
    panel, days, n = load(spark, sf)
    return rounded(sg.standard_forward_returns(panel, days, 2, MIN_NAMES, max_rows=n), "fwd_ret", "z")


def _rows(spark, sf):
    panel, days, n = stored(spark, sf)
    forward = sg.standard_forward_returns(panel, days, 2, MIN_NAMES, max_rows=n)
    dates = sg.evaluation_dates(panel, days, 2, 3, MIN_NAMES)
    signal = panel.where(F.col("pre_close").isNotNull()).select("date", "code", (1 - F.col("close") / F.col("pre_close")).alias("f"))
    return cut_lineage(sg.measured_rows(signal, forward, dates, min_names=MIN_NAMES, max_rows=n)), n


@query(with_panel("SELECT date, round(ic, 6) AS ic, round(long_short, 6) AS long_short FROM ics", REV_ROWS))
def rank_ic_and_spread(spark, sf):
    rows, n = _rows(spark, sf)
    return rounded(sg.information_coefficients(rows, max_rows=n), "ic", "long_short")


@query(with_panel("SELECT date, round(autocorr, 6) AS autocorr, round(turnover, 6) AS turnover FROM moves", REV_ROWS))
def signal_persistence(spark, sf):
    rows, n = _rows(spark, sf)
    return rounded(sg.persistence(rows, max_rows=n), "autocorr", "turnover")


@query(with_panel(f"SELECT {_STATS} FROM stats", REV_ROWS))
def signal_statistics(spark, sf):
    rows, n = _rows(spark, sf)
    stats = sg.signal_statistics(sg.information_coefficients(rows, max_rows=n), sg.persistence(rows, max_rows=n), fwd_days=2)
    return rounded(stats, *STAT_COLS)


@query(with_panel("SELECT round(ls_ir / ir_theory, 6) AS transfer_coefficient FROM stats", REV_ROWS))
def transfer_coefficient(spark, sf):
    rows, n = _rows(spark, sf)
    stats = sg.signal_statistics(sg.information_coefficients(rows, max_rows=n), sg.persistence(rows, max_rows=n), fwd_days=2)
    return rounded(stats.select(sg.transfer_coefficient(F.col("ls_ir"), F.col("ir_theory")).alias("transfer_coefficient")), "transfer_coefficient")


def _uniform(first: int, parts: str) -> str:
    return f"((('0x' || substr(md5({parts}), {first}, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"


def _normal(parts: str) -> str:
    return f"sqrt(-2.0 * ln({_uniform(1, parts)})) * cos(2.0 * 3.141592653589793 * ({_uniform(13, parts)}))"


def _signals(points, seeds) -> str:
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for a, b, d in points)
    return STD_FORWARD.rstrip() + f""",
pts AS (SELECT * FROM (VALUES {values}) t(in_ic, in_ic_std, decay)),
seeds AS (SELECT unnest({list(seeds)}) AS seed),
draw AS (SELECT s.seed, f.date, f.code, (f.fwd_ret - f.m) / f.s AS z,
  {_normal("s.seed || '|' || f.date")} AS zr, {_normal("s.seed || '|' || f.date || '|' || f.code")} AS eps FROM sf f, seeds s),
mix AS (SELECT p.*, d.seed, d.date, d.code, d.z, d.eps, least(greatest(p.in_ic + p.in_ic_std * d.zr, -0.95), 0.95) AS rho FROM draw d, pts p),
raw AS (SELECT *, rho * z + sqrt(1 - rho * rho) * eps AS s0 FROM mix),
std AS (SELECT *, (s0 - avg(s0) OVER w) / (stddev_samp(s0) OVER w + 1e-10) AS s FROM raw
        WINDOW w AS (PARTITION BY in_ic, in_ic_std, decay, seed, date)),
dd AS (SELECT s.*, d.day, d.day - row_number() OVER (PARTITION BY in_ic, in_ic_std, decay, seed, code ORDER BY d.day) AS run
       FROM std s JOIN days d ON d.date = s.date),
dm AS (SELECT *, min(day) OVER (PARTITION BY in_ic, in_ic_std, decay, seed, code, run) AS day0 FROM dd),
smo AS (
  SELECT a.in_ic, a.in_ic_std, a.decay, a.seed, a.date, a.code,
         sum(b.s * pow(a.decay, a.day - b.day) * CASE WHEN b.day = b.day0 THEN 1.0 ELSE sqrt(1 - a.decay * a.decay) END) AS f0
  FROM dm a JOIN dm b ON b.in_ic = a.in_ic AND b.in_ic_std = a.in_ic_std AND b.decay = a.decay AND b.seed = a.seed
    AND b.code = a.code AND b.run = a.run AND b.day <= a.day GROUP BY ALL),
cal AS (SELECT *, (f0 - avg(f0) OVER w) / (stddev_samp(f0) OVER w + 1e-10) AS f FROM smo
        WINDOW w AS (PARTITION BY in_ic, in_ic_std, decay, seed, date))
"""


TWO_POINTS = [(0.05, 0.1, 0.0), (0.08, 0.1, 0.8)]


@query(with_panel("SELECT in_ic, in_ic_std, decay, seed, date, code, round(f, 6) AS f FROM cal", _signals(TWO_POINTS, [42])))
def calibration_signals(spark, sf):
    panel, days, n = load(spark, sf)
    forward = sg.standard_forward_returns(panel, days, 2, MIN_NAMES, max_rows=n)
    return rounded(sg.calibration_signals(forward, days, TWO_POINTS, [42], max_rows=n), "f")


SWEEP = sg.grid_points()
SWEEP_UNIQUE = list(dict.fromkeys((a, b, d) for _, a, b, d in SWEEP))
_SWEEP_VALUES = ", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for s, a, b, d in SWEEP)


@query(with_panel(f"""
SELECT w.sweep, w.ic AS in_ic, w.sd AS in_ic_std, round(w.ic / w.sd, 6) AS in_icir, w.decay AS in_decay,
  {', '.join(f'round(avg(s.{c}), 5) AS {c}' for c in STAT_COLS)}, {len(K.GRID_SEEDS)} AS n_seeds
FROM (VALUES {_SWEEP_VALUES}) w(sweep, ic, sd, decay)
JOIN stats s ON s.kk.ic = w.ic AND s.kk.sd = w.sd AND s.kk.decay = w.decay
GROUP BY w.sweep, w.ic, w.sd, w.decay""", _signals(SWEEP_UNIQUE, K.GRID_SEEDS).rstrip() + """,
rows0 AS (SELECT {'ic': c.in_ic, 'sd': c.in_ic_std, 'decay': c.decay, 'seed': c.seed} AS kk, c.date, c.code, c.f, r.fwd_ret
  FROM cal c JOIN sf r ON r.date = c.date AND r.code = c.code WHERE c.date IN (SELECT date FROM ev)),
""" + MEASURE))
def signal_grid_sweeps(spark, sf):
    panel, days, n = stored(spark, sf)
    out = signal_grid.run_grid(
        panel, days, fwd_days=2, every=3, min_names=MIN_NAMES, max_rows=n
    )
    out = rounded(out, *STAT_COLS, places=5)
    return rounded(out, "in_icir")


@query(with_panel("SELECT in_ic, in_ic_std, decay, date, code, round(f, 6) AS alpha FROM cal", _signals(TWO_POINTS, [42])))
def signal_store(spark, sf):
    panel, days, n = load(spark, sf)
    forward = sg.standard_forward_returns(panel, days, 2, MIN_NAMES, max_rows=n)
    signals = sg.calibration_signals(forward, days, TWO_POINTS, [42], max_rows=n)
    named = signals.select(
        F.concat_ws("_", F.col("in_ic").cast("string"), F.col("in_ic_std").cast("string"), F.col("decay").cast("string")).alias("param_id"),
        "in_ic", "in_ic_std", "decay", "date", "code", F.col("f").alias("alpha"),
    )
    path = new_table_path(spark, "signals")
    sinks.write_signals(named, path)
    return rounded(spark.read.parquet(path).drop("param_id"), "alpha")
