"""Histograms, box plots, densities, distribution curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import bin_sql, q, query, table
from starloom.functions import quantise
from starloom.operators import distributions as D
from starloom.operators import ordered


@query("histogram_fixed_edges", f"""
SELECT l_returnflag, {bin_sql('l_extendedprice', '8000.0::DOUBLE', '95000.0::DOUBLE', 69)} AS bin, count(*) AS n
FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem)
WHERE l_extendedprice >= 8000 AND l_extendedprice <= 95000 GROUP BY ALL""")
def histogram_fixed_edges(spark, sf):
    return D.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 69, 8000.0, 95000.0, ["l_returnflag"])


@query("histogram_data_range", f"""
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT {bin_sql('value', 'lo', 'hi', 60)} AS bin, count(*) AS n FROM events, r GROUP BY ALL""")
def histogram_data_range(spark, sf):
    return D.histogram(table(spark, sf, "events"), "value", 60)


@query("histogram_of_counts", f"""
WITH n AS (SELECT user_id, count(*)::DOUBLE AS n_events, user_id < 75 AS near FROM events GROUP BY user_id),
b AS (SELECT near, {bin_sql('n_events', '0.0::DOUBLE', '100.0::DOUBLE', 100)} AS bin, count(*) AS n
  FROM n WHERE n_events >= 0 AND n_events <= 100 GROUP BY ALL)
SELECT near, bin, n, {q('n / sum(n) OVER (PARTITION BY near)', 9)} AS density FROM b""")
def histogram_of_counts(spark, sf):
    """Whole-number values on whole-number edges."""
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n_events"))
    rows = counts.withColumn("near", F.col("user_id") < 75)
    out = D.histogram(rows, "n_events", 100, 0.0, 100.0, ["near"], density=True)
    return out.withColumn("density", quantise("density", 9))


@query("histogram_density", f"""
WITH b AS (SELECT event_type, {bin_sql('value', '0.0::DOUBLE', '200.0::DOUBLE', 59)} AS bin, count(*) AS n
  FROM events WHERE value >= 0 AND value <= 200 GROUP BY ALL)
SELECT event_type, bin, n, {q('n / (sum(n) OVER (PARTITION BY event_type) * (200.0::DOUBLE / 59))', 9)} AS density FROM b""")
def histogram_density(spark, sf):
    out = D.histogram(table(spark, sf, "events"), "value", 59, 0.0, 200.0, ["event_type"], density=True)
    return out.withColumn("density", quantise("density", 9))


@query("box_plot_events", f"""
WITH t AS (SELECT event_type, 'value' AS feature, value FROM events
  UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE FROM events),
s AS (SELECT event_type, feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
  quantile_cont(value, 0.75) AS q3 FROM t GROUP BY ALL)
SELECT t.event_type, t.feature, any_value(n) AS n, {q('any_value(q1)', 6)} AS q1, {q('any_value(med)', 6)} AS median,
  {q('any_value(q3)', 6)} AS q3,
  {q('least(min(value) FILTER (WHERE value >= q1 - 1.5::DOUBLE * (q3 - q1) AND value <= q3 + 1.5::DOUBLE * (q3 - q1)), any_value(q1))', 6)} AS whisker_low,
  {q('greatest(max(value) FILTER (WHERE value >= q1 - 1.5::DOUBLE * (q3 - q1) AND value <= q3 + 1.5::DOUBLE * (q3 - q1)), any_value(q3))', 6)} AS whisker_high,
  count(*) FILTER (WHERE NOT (value >= q1 - 1.5::DOUBLE * (q3 - q1) AND value <= q3 + 1.5::DOUBLE * (q3 - q1))) AS n_outliers
FROM t JOIN s USING (event_type, feature) GROUP BY t.event_type, t.feature""")
def box_plot_events(spark, sf):
    out = D.box_plot(table(spark, sf, "events"), ["value", "user_id"], ["event_type"])
    return out.withColumns({n: quantise(n, 6) for n in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query("exact_quantiles_price", f"""
SELECT l_returnflag, count(*) AS n, {q('quantile_cont(l_extendedprice, 0.05)', 4)} AS p05,
  {q('quantile_cont(l_extendedprice, 0.5)', 4)} AS median, {q('quantile_cont(l_extendedprice, 0.95)', 4)} AS p95
FROM lineitem GROUP BY l_returnflag""")
def exact_quantiles_price(spark, sf):
    out = ordered.exact_quantiles(
        table(spark, sf, "lineitem"), "l_extendedprice", {"p05": 0.05, "median": 0.5, "p95": 0.95}, ["l_returnflag"]
    )
    return out.withColumns({n: quantise(n, 4) for n in ("p05", "median", "p95")})


@query("distribution_curve", f"""
SELECT event_type, value, any_value(c) AS n, {q('any_value(f)', 9)} AS fraction FROM (
  SELECT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS c,
    count(*) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING)::DOUBLE
      / count(*) OVER (PARTITION BY event_type) AS f FROM events) GROUP BY event_type, value""")
def distribution_curve(spark, sf):
    out = ordered.distribution_curve(table(spark, sf, "events"), "value", ["event_type"])
    return out.withColumn("fraction", quantise("fraction", 9))


@query("distribution_curve_all", f"""
SELECT value, count(*) AS n, {q('sum(count(*)) OVER (ORDER BY value)::DOUBLE / sum(count(*)) OVER ()', 9)} AS fraction
FROM events GROUP BY value""")
def distribution_curve_all(spark, sf):
    out = ordered.distribution_curve(table(spark, sf, "events"), "value")
    return out.withColumn("fraction", quantise("fraction", 9))


def _violin_sql(source: str, points: int, factor: str) -> str:
    return f"""
WITH d AS ({source}),
s AS (SELECT g, count(*)::DOUBLE AS n, min(v) AS lo, max(v) AS hi, {factor} * stddev_samp(v) AS bw,
       quantile_cont(v, 0.5) AS median FROM d GROUP BY g),
k AS (SELECT g, n, lo, hi, bw, median, p.p::INTEGER AS point, lo + p.p * (hi - lo) / {points - 1}.0::DOUBLE AS x
      FROM s, range({points}) AS p(p) WHERE bw > 0)
SELECT k.g, point, {q('any_value(median)', 6)} AS median, {q('any_value(x)', 6)} AS x,
  {q("sum(exp(-0.5::DOUBLE * ((x - v) / bw) * ((x - v) / bw))) / (any_value(n) * any_value(bw) * sqrt(2.0::DOUBLE * pi()))", 8)} AS density
FROM k JOIN d USING (g) GROUP BY k.g, point
UNION ALL SELECT g, 0, {q('median', 6)}, {q('lo', 6)}, NULL FROM s WHERE bw IS NULL OR NOT bw > 0"""


@query("violin_sizes", _violin_sql(
    "SELECT p_type AS g, p_retailprice AS v FROM part", 100, "pow(count(*)::DOUBLE, -0.2::DOUBLE)"))
def violin_sizes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("g"), F.col("p_retailprice").alias("v"))
    out = D.violin(rows, "v", ["g"], points=100)
    return out.withColumns({c: quantise(c, n) for c, n in (("x", 6), ("density", 8), ("median", 6))})


@query("violin_log_values", _violin_sql(
    "SELECT event_type AS g, log10(value) AS v FROM events WHERE value > 0", 300, "0.35::DOUBLE"))
def violin_log_values(spark, sf):
    rows = table(spark, sf, "events").where(F.col("value") > 0).select(
        F.col("event_type").alias("g"), F.log10("value").alias("v")
    )
    out = D.violin(rows, "v", ["g"], points=300, bandwidth=0.35)
    return out.withColumns({c: quantise(c, n) for c, n in (("x", 6), ("density", 8), ("median", 6))})


def _grid_sql(bins: int, sigma: float) -> str:
    """Smoothing as two kernel joins on the counted cells, mirrored at the borders."""
    taps = " UNION ALL ".join(f"SELECT {k} AS k, {w!r}::DOUBLE AS w" for k, w in D.gaussian_taps(sigma))
    mirror = f"CASE WHEN {{0}} < 0 THEN -1 - {{0}} WHEN {{0}} >= {bins} THEN {2 * bins - 1} - {{0}} ELSE {{0}} END"
    return f"""
d AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
lim AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d),
cells AS (SELECT g, {bin_sql('x', 'x0', 'x1', bins)} AS bx,
   {bin_sql('y', 'y0', 'y1', bins)} AS by_, count(*)::DOUBLE AS v FROM d, lim GROUP BY ALL),
taps AS ({taps}),
ax AS (SELECT i.i::INTEGER AS i, k, w, {mirror.format('(i.i + k)')} AS src FROM range({bins}) AS i(i), taps),
sx AS (SELECT g, ax.i AS bx, by_, sum(v * w) AS v FROM cells JOIN ax ON ax.src = bx GROUP BY ALL),
sm AS (SELECT g, bx, ax.i AS by_, sum(v * w) AS v FROM sx JOIN ax ON ax.src = by_ GROUP BY ALL),
cum AS (SELECT *, sum(v) OVER (PARTITION BY g ORDER BY v DESC, bx, by_ ROWS UNBOUNDED PRECEDING) AS c,
   sum(v) OVER (PARTITION BY g) AS t FROM sm),
lev AS (SELECT g, max(v) FILTER (WHERE c >= 0.68::DOUBLE * t) AS level_68, max(v) FILTER (WHERE c >= 0.95::DOUBLE * t) AS level_95
   FROM cum GROUP BY g)"""


GRID_SQL = "WITH " + _grid_sql(D.GRID_BINS, D.SMOOTH_SIGMA)


def _plane(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )


@query("density_grid", GRID_SQL + f" SELECT g, bx::INTEGER AS bx, by_::INTEGER AS by, {q('v', 6)} AS v FROM sm")
def density_grid(spark, sf):
    return D.density_grid(_plane(spark, sf), "x", "y", ["g"]).withColumn("v", quantise("v", 6))


@query("containment_levels", GRID_SQL + f" SELECT g, {q('level_68', 5)} AS level_68, {q('level_95', 5)} AS level_95 FROM lev")
def containment_levels(spark, sf):
    grid = D.density_grid(_plane(spark, sf), "x", "y", ["g"])
    out = D.containment_levels(grid, {"level_68": 0.68, "level_95": 0.95}, ["g"])
    return out.withColumns({n: quantise(n, 5) for n in ("level_68", "level_95")})


@query("outside_contour", GRID_SQL + f"""
SELECT d.g, count(*) AS n, count(*) FILTER (WHERE sm.v < level_95) AS n_outside FROM d, lim
JOIN sm ON sm.g = d.g AND sm.bx = {bin_sql('x', 'x0', 'x1', D.GRID_BINS)}
       AND sm.by_ = {bin_sql('y', 'y0', 'y1', D.GRID_BINS)}
JOIN lev ON lev.g = d.g GROUP BY d.g""")
def outside_contour(spark, sf):
    out = D.outside_contour(_plane(spark, sf), "x", "y", 0.95, ["g"])
    return out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outside"))
