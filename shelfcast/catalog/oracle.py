"""Building blocks of the check SQL: shared WITH clauses and rounding texts."""

from __future__ import annotations

from .fixtures import TARGET_DATE

S = "store_id, product_id"
W = "PARTITION BY store_id, product_id ORDER BY date"


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def plain(expression: str, name: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name}"


def np2(x: str) -> str:
    """Two decimals by scaling and rounding half to even."""
    return f"(round_even(({x}) * 100, 0) / 100)"


def py2(x: str, digits: int = 2) -> str:
    """Decimals by exact binary value: at a tie the product's error decides."""
    scale = f"{10**digits}.0::DOUBLE"
    x = f"CAST(({x}) AS DOUBLE)"
    split = f"({x} * 134217729.0::DOUBLE)"
    high = f"({split} - ({split} - {x}))"
    error = f"(({high} * {scale} - {x} * {scale}) + ({x} - {high}) * {scale})"
    return (
        f"(CASE WHEN {x} * {scale} - floor({x} * {scale}) = 0.5 AND {error} > 0 "
        f"THEN floor({x} * {scale}) + 1 "
        f"WHEN {x} * {scale} - floor({x} * {scale}) = 0.5 AND {error} < 0 "
        f"THEN floor({x} * {scale}) ELSE round_even({x} * {scale}, 0) END / {scale})"
    )


PARTS = {
    "panel": (
        (),
        """
SELECT CAST(l.l_shipdate AS DATE) AS date,
  concat('S', lpad(CAST(l.l_suppkey AS VARCHAR), 5, '0')) AS store_id,
  p.p_type AS product_id,
  CASE WHEN p.p_type IN ('ECONOMY', 'STANDARD') THEN 'Core'
       WHEN p.p_type = 'PROMO' THEN 'Promo' ELSE 'Sized' END AS category,
  r.r_name AS region,
  CAST(sum(l.l_linenumber * 13 + l.l_partkey) % 151 AS INT) AS inventory_level,
  CAST(greatest(sum(l.l_quantity) - 20, 0) AS INT) AS units_sold,
  max(p.p_retailprice) AS price,
  max(l.l_discount) * 100 AS discount,
  CASE day(CAST(l.l_shipdate AS DATE)) % 4 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy'
       WHEN 2 THEN 'Cloudy' ELSE 'Snowy' END AS weather_condition,
  CASE WHEN max(l.l_discount) >= 0.08 THEN 1 ELSE 0 END AS holiday_promotion,
  max(p.p_retailprice) + max(p.p_size) - 25 AS competitor_pricing,
  CASE WHEN month(CAST(l.l_shipdate AS DATE)) IN (12, 1, 2) THEN 'Winter'
       WHEN month(CAST(l.l_shipdate AS DATE)) IN (3, 4, 5) THEN 'Spring'
       WHEN month(CAST(l.l_shipdate AS DATE)) IN (6, 7, 8) THEN 'Summer'
       ELSE 'Autumn' END AS seasonality
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY CAST(l.l_shipdate AS DATE), l.l_suppkey, p.p_type, r.r_name""",
    ),
    "demand": (
        ("panel",),
        f"SELECT *, CAST(sum(units_sold) OVER {rows(7)} AS DOUBLE) AS units_sold_7d FROM panel",
    ),
    "feats": (
        ("demand",),
        f"""
SELECT *, ln(1 + units_sold_7d) AS log_units_sold_7d,
  CAST(week(date) AS INT) AS week, CAST(month(date) AS INT) AS month,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  coalesce(lag(units_sold_7d, 7) OVER ({W}), 0) AS lag_7,
  coalesce(lag(units_sold_7d, 14) OVER ({W}), 0) AS lag_14,
  coalesce(lag(units_sold_7d, 30) OVER ({W}), 0) AS lag_30,
  coalesce(lag(units_sold_7d, 60) OVER ({W}), 0) AS lag_60,
  avg(units_sold_7d) OVER {rows(7)} AS rolling_mean_7,
  avg(units_sold_7d) OVER {rows(30)} AS rolling_mean_30
FROM demand""",
    ),
    "pred": (
        ("feats",),
        f"""
SELECT *, units_sold_7d AS actual,
  coalesce(lag(rolling_mean_7, 1) OVER ({W}), 0) AS predicted
FROM feats""",
    ),
    "split": (
        ("pred",),
        """
SELECT p.*, CASE WHEN date_diff('day', DATE '1970-01-01', p.date) <= q.day
  THEN 'train' ELSE 'valid' END AS split
FROM pred p, (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS day
              FROM panel) q""",
    ),
    "recent": (
        ("pred",),
        f"""
SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY date DESC) AS recency,
  CASE WHEN actual <> 0 THEN abs(predicted - actual) / actual * 100 END AS ape
FROM pred""",
    ),
    "series_error": (
        ("recent",),
        f"SELECT {S}, avg(ape) AS mean_error FROM recent WHERE recency <= 30 GROUP BY {S}",
    ),
    # The latest row of each series; its rolling mean is the baseline's forecast.
    "scenario": (
        ("recent", "series_error"),
        f"""
SELECT r.*, e.mean_error, r.rolling_mean_7 AS demand_raw,
  first_value(category) OVER (PARTITION BY r.store_id, r.product_id) AS any_category
FROM recent r JOIN series_error e USING ({S}) WHERE recency = 1""",
    ),
    "band": (
        ("scenario",),
        f"""
SELECT store_id, product_id, category, inventory_level AS stock, price, mean_error, demand_raw,
  {py2('demand_raw')} AS demand,
  {py2('demand_raw * (1 - mean_error / 100)')} AS low,
  {py2('demand_raw * (1 + mean_error / 100)')} AS high
FROM scenario""",
    ),
    "store": (
        (),
        """
SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "product": (
        (),
        "SELECT p_partkey AS id, p_name AS name, p_type AS category, p_retailprice AS price FROM part",
    ),
    "inventory": (
        (),
        """
SELECT l_suppkey * 10000000 + l_partkey AS id, CAST(l_suppkey AS INT) AS store_id,
  l_partkey AS product_id, CAST(sum(l_quantity) AS INT) AS stock,
  CAST(max(l_shipdate) AS DATE) AS updated_at
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    ),
    "sales": (
        (),
        """
SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_suppkey AS INT) AS store_id,
  l_partkey AS product_id, CAST(l_shipdate AS DATE) AS date,
  CAST(l_quantity AS INT) AS units_sold, l_discount AS discount, l_discount >= 0.08 AS holiday
FROM lineitem""",
    ),
    "sold": (
        ("sales",),
        "SELECT store_id, product_id, avg(units_sold) AS demand FROM sales GROUP BY store_id, product_id",
    ),
    "forecast": (
        ("sales",),
        """
SELECT store_id, product_id, CAST(date_trunc('week', date) AS DATE) AS week_start,
  avg(units_sold) AS demand
FROM sales GROUP BY store_id, product_id, CAST(date_trunc('week', date) AS DATE)""",
    ),
    "reorder": (
        ("sold", "inventory"),
        """
SELECT i.id, i.store_id, i.product_id, d.demand, d.demand * 3.0 AS reorder_point,
  CAST(round_even(d.demand * 3.0 - i.stock, 0) AS INT) AS order_qty,
  CASE WHEN i.stock < d.demand THEN 'CRITICAL' ELSE 'LOW' END AS risk_level,
  i.updated_at AS created_at
FROM inventory i JOIN sold d ON i.store_id = d.store_id AND i.product_id = d.product_id
WHERE i.stock < d.demand * 3.0""",
    ),
}


def with_parts(names: str, select: str) -> str:
    """``select`` under a WITH clause of the named parts and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = PARTS[name]
        for need in needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    clauses = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered)
    return f"WITH {clauses}\n{select}"


def metrics_sql(source: str, by: str = "", train: str | None = None, raw: bool = False) -> str:
    """All accuracy metrics from ``source`` with columns actual and predicted."""
    out = plain if raw else r6
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    mase = "CAST(NULL AS DOUBLE)"
    joined = ""
    if train is not None:
        mase = "CASE WHEN t.n > 0 THEN coalesce(m.mae / nullif(t.naive, 0), 0) ELSE m.mae END"
        joined = f", ({train}) t"
    return f"""
SELECT {head}{out('mae', 'mae')}, {out('rmse', 'rmse')},
  {out('CASE WHEN total_records < 2 THEN NULL WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1 ELSE 0 END ELSE 1 - sse / sst END', 'r2')},
  {out('mape', 'mape')}, {out('smape', 'smape')}, {out('wape', 'wape')},
  {out(mase, 'mase')},
  {out('greatest(0, least(100, 100 - mape))', 'mape_accuracy')},
  {out('greatest(0, least(100, 100 - smape))', 'smape_accuracy')},
  {out('greatest(0, least(100, 100 - wape))', 'wape_accuracy')},
  total_records, zero_records,
  {out('zero_records * 100.0 / total_records', 'zero_percentage')},
  total_records - zero_records AS mape_records,
  {out('mean_actual', 'mean_actual')}, {out('mean_predicted', 'mean_predicted')},
  {out('std_actual', 'std_actual')}, {out('std_predicted', 'std_predicted')},
  {out('min_actual', 'min_actual')}, {out('max_actual', 'max_actual')},
  {out('min_predicted', 'min_predicted')}, {out('max_predicted', 'max_predicted')}
FROM (
  SELECT {head}avg(abs(predicted - actual)) AS mae,
    sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
    sum((predicted - actual) * (predicted - actual)) AS sse,
    var_pop(actual) * count(*) AS sst,
    coalesce(100 * avg(abs(predicted - actual) / nullif(abs(actual), 0)), 0) AS mape,
    coalesce(100 * avg(abs(predicted - actual) / nullif(abs(actual) + abs(predicted), 0)), 0) AS smape,
    coalesce(100 * sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 0) AS wape,
    count(*) AS total_records,
    CAST(count(*) FILTER (WHERE actual = 0) AS BIGINT) AS zero_records,
    avg(actual) AS mean_actual, avg(predicted) AS mean_predicted,
    stddev_pop(actual) AS std_actual, stddev_pop(predicted) AS std_predicted,
    min(actual) AS min_actual, max(actual) AS max_actual,
    min(predicted) AS min_predicted, max(predicted) AS max_predicted
  FROM {source} {group}
) m{joined}"""


POOLED_NAIVE = f"""
SELECT count(d) AS n, avg(d) AS naive FROM (
  SELECT abs(actual - lag(actual) OVER (ORDER BY {S}, date)) AS d
  FROM split WHERE split = 'train')"""

SERIES_NAIVE = f"""
SELECT count(d) AS n, avg(d) AS naive FROM (
  SELECT abs(actual - lag(actual) OVER ({W})) AS d FROM split WHERE split = 'train')"""

__all__ = ["TARGET_DATE", "with_parts", "metrics_sql", "r6", "np2", "py2", "S", "W", "rows"]
