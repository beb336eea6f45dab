"""Stock policy, recommendations, history and relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, integrity, inventory, views
from ..operators.models import BaselineForecaster
from ..operators.resample import resample
from ..plans import recommend as plan
from ..plans.reorder import reorder_recommendations
from ..schema import SERIES
from . import fixtures
from .fixtures import TARGET_DATE
from .oracle import S, W, np2, py2, r6, with_parts
from .registry import query, rounded

BASELINE = BaselineForecaster()

# -- policy -----------------------------------------------------------------

STATS = f"""(SELECT *, avg(predicted) OVER (PARTITION BY {S}) AS avg_weekly_demand,
  coalesce(stddev_samp(predicted) OVER (PARTITION BY {S}), 0) AS demand_std FROM pred) s"""
POINT = "avg_weekly_demand * {lead} + {z} * demand_std * sqrt({lead})"


def policy_sql(lead: int = 1, z: float = 1.65, where: str = "") -> str:
    point = POINT.format(lead=lead, z=z)
    return f"""
SELECT date, {S}, inventory_level, {r6('predicted', 'predicted_weekly_demand')},
  {r6('avg_weekly_demand', 'avg_weekly_demand')}, {r6('demand_std', 'demand_std')},
  {r6(f'{z} * demand_std * sqrt({lead})', 'safety_stock')}, {r6(point, 'reorder_point')},
  round_even(greatest({point} - inventory_level, 0), 0) AS order_quantity,
  CASE WHEN inventory_level < {point} THEN 1 ELSE 0 END AS stockout_risk
FROM {STATS} {where}"""


POLICY_COLUMNS = (
    "inventory_level", "predicted_weekly_demand", "avg_weekly_demand", "demand_std",
    "safety_stock", "reorder_point", "order_quantity", "stockout_risk",
)
AT_RISK = (
    "date, store_id, product_id, inventory_level, predicted_weekly_demand, reorder_point, "
    "order_quantity, stockout_risk"
)


def demand(spark, sf_dir):
    return fixtures.panel_pred(spark, sf_dir).withColumnRenamed("predicted", inventory.DEMAND)


@query(
    "series_demand_stats",
    with_parts("pred", f"SELECT date, {S}, avg_weekly_demand, demand_std FROM ({policy_sql()})"),
)
def series_demand_stats(spark, sf_dir):
    stats = inventory.series_demand_stats(demand(spark, sf_dir))
    return rounded(stats.select("date", *SERIES, "avg_weekly_demand", "demand_std"))


@query("inventory_policy", with_parts("pred", policy_sql()))
def inventory_policy(spark, sf_dir):
    policy = inventory.inventory_policy(demand(spark, sf_dir))
    return rounded(policy.select("date", *SERIES, *POLICY_COLUMNS))


@query("inventory_policy_preaggregated", with_parts("pred", policy_sql(2, 2.05)))
def inventory_policy_preaggregated(spark, sf_dir):
    policy = inventory.inventory_policy(demand(spark, sf_dir), 2, 2.05, preaggregate=True)
    return rounded(policy.select("date", *SERIES, *POLICY_COLUMNS))


@query(
    "reorder_recommendations",
    with_parts("pred", f"SELECT {AT_RISK} FROM ({policy_sql()}) WHERE stockout_risk = 1"),
)
def reorder_all(spark, sf_dir):
    return rounded(reorder_recommendations(fixtures.retail_panel(spark, sf_dir), BASELINE))


@query(
    "reorder_recommendations_latest",
    with_parts(
        "pred",
        f"""SELECT {AT_RISK} FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY date DESC) AS rn
        FROM ({policy_sql()})) WHERE rn = 1 AND stockout_risk = 1""",
    ),
)
def reorder_latest(spark, sf_dir):
    panel = fixtures.retail_panel(spark, sf_dir)
    return rounded(reorder_recommendations(panel, BASELINE, scope="latest"))


@query(
    "top_reorders",
    with_parts(
        "pred",
        f"""SELECT {AT_RISK} FROM ({policy_sql()}) WHERE stockout_risk = 1
        ORDER BY {S}, date LIMIT 20""",
    ),
)
def top_reorders(spark, sf_dir):
    rows = reorder_recommendations(fixtures.retail_panel(spark, sf_dir), BASELINE)
    return rounded(inventory.top_reorders(rows))


# -- history ----------------------------------------------------------------


@query(
    "recent_error",
    with_parts("series_error", f"SELECT {S}, {r6('mean_error', 'mean_error')} FROM series_error"),
)
def recent_error(spark, sf_dir):
    return rounded(history.recent_error(fixtures.panel_pred(spark, sf_dir)))


@query(
    "latest_row",
    with_parts(
        "panel",
        f"""SELECT * EXCLUDE (rn) REPLACE (round(discount, 6) AS discount,
        round(competitor_pricing, 6) AS competitor_pricing) FROM (
        SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY date DESC) AS rn FROM panel) WHERE rn = 1""",
    ),
)
def latest_row(spark, sf_dir):
    return rounded(history.latest_row(fixtures.retail_panel(spark, sf_dir)))


def listing_sql(n: int) -> str:
    return f"""SELECT {S}, strftime(date, '%Y-%m-%d') AS date, {np2('predicted')} AS predicted,
    {np2('actual')} AS actual FROM recent WHERE recency <= {n}"""


def listing(rows, name: str):
    entry = F.explode(name).alias("entry")
    return rows.select(*SERIES, entry).select(*SERIES, "entry.*")


@query("last_7_rows", with_parts("recent", listing_sql(7)))
def last_7_rows(spark, sf_dir):
    return listing(history.last_n(fixtures.panel_pred(spark, sf_dir), 7, "days"), "days")


@query("last_4_rows", with_parts("recent", listing_sql(4)))
def last_4_rows(spark, sf_dir):
    return listing(history.last_n(fixtures.panel_pred(spark, sf_dir), 4, "weeks"), "weeks")


@query(
    "first_category",
    with_parts("panel", f"SELECT {S}, arg_min(category, date) AS category FROM panel GROUP BY {S}"),
)
def first_category(spark, sf_dir):
    return history.first_category(fixtures.retail_panel(spark, sf_dir))


HISTORY = f"""
SELECT {S}, strftime(date, '%Y-%m-%d') AS date, {np2('units_sold_7d')} AS units_sold_7d,
  {np2('predicted')} AS predicted, inventory_level, {np2('price')} AS price,
  {np2('discount')} AS discount FROM pred"""


@query("history_report", with_parts("pred", HISTORY))
def history_report(spark, sf_dir):
    return history.history_report(fixtures.panel_pred(spark, sf_dir))


def tail_sql(months: int) -> str:
    return f"""SELECT {S}, CAST(row_number() OVER ({W}) AS INT) AS week, {py2('predicted')} AS expected_demand
    FROM recent WHERE recency <= {months * 4}"""


@query("forecast_tail", with_parts("recent", tail_sql(3)))
def forecast_tail(spark, sf_dir):
    return history.forecast_tail(fixtures.panel_pred(spark, sf_dir), 3)


@query(
    "forecast_summary",
    with_parts(
        "recent",
        f"""SELECT {S}, {r6('sum(expected_demand)', 'total_demand')},
        {r6('avg(expected_demand)', 'avg_weekly')},
        min(week) FILTER (WHERE expected_demand = top) AS peak_week, max(top) AS peak_demand,
        count(*) AS weeks
        FROM (SELECT *, max(expected_demand) OVER (PARTITION BY {S}) AS top FROM ({tail_sql(6)}))
        GROUP BY {S}""",
    ),
)
def forecast_summary(spark, sf_dir):
    tail = history.forecast_tail(fixtures.panel_pred(spark, sf_dir), 6)
    return rounded(history.forecast_summary(tail))


@query(
    "dashboard_kpis",
    with_parts(
        "recent",
        f"""
SELECT {S}, h.avg_error, h.accuracy, f.total_demand FROM (
  SELECT {S}, CAST(floor(sum(CAST(round_even(abs(units_sold_7d - predicted) * 100, 0) AS BIGINT))
      / (count(*) * 100.0) + 0.5) AS BIGINT) AS avg_error,
    CAST(floor((1 - avg(abs(units_sold_7d - predicted) / units_sold_7d) FILTER (WHERE units_sold_7d <> 0))
      * 100 + 0.5) AS BIGINT) AS accuracy
  FROM ({HISTORY}) GROUP BY {S}) h
JOIN (SELECT {S}, CAST(floor(round(sum(expected_demand), 2) + 0.5) AS BIGINT) AS total_demand
  FROM ({tail_sql(3)}) GROUP BY {S}) f USING ({S})""",
    ),
)
def dashboard_kpis(spark, sf_dir):
    scored = fixtures.panel_pred(spark, sf_dir)
    return history.dashboard_kpis(
        history.history_report(scored), history.forecast_tail(scored, 3)
    )


# -- resampling -------------------------------------------------------------

WEEKS = """
, ev AS (SELECT CAST(ts AS DATE) AS date, user_id, event_type, CAST(count(*) AS INT) AS units_sold
  FROM events GROUP BY 1, 2, 3),
wk AS (SELECT user_id, event_type, CAST(date_trunc('week', date) AS DATE) + 6 AS period_end,
  avg(units_sold) AS units_sold FROM ev GROUP BY 1, 2, 3),
spine AS (SELECT user_id, event_type, CAST(unnest(generate_series(CAST(min(period_end) AS TIMESTAMP),
  CAST(max(period_end) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period_end FROM wk GROUP BY 1, 2)
SELECT user_id, event_type, period_end, round(units_sold, 6) AS units_sold FROM (
  SELECT s.*, w.units_sold, row_number() OVER (PARTITION BY s.user_id, s.event_type
    ORDER BY s.period_end DESC) AS rn
  FROM spine s LEFT JOIN wk w ON s.user_id = w.user_id AND s.event_type = w.event_type
    AND s.period_end = w.period_end) WHERE rn <= 6"""


@query("resample_week", "WITH " + WEEKS.lstrip("\n, "))
def resample_week(spark, sf_dir):
    events = fixtures.events_panel(spark, sf_dir)
    return rounded(resample(events, "week", ["units_sold"], keys=["user_id", "event_type"]))


def period_sql(freq: str, last: int) -> str:
    end = {
        "week": "CAST(date_trunc('week', date) AS DATE) + 6",
        "month": "last_day(date)",
    }[freq]
    spine = {
        "week": "CAST(unnest(generate_series(CAST(min(period_end) AS TIMESTAMP), "
        "CAST(max(period_end) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE)",
        "month": "last_day(CAST(unnest(generate_series(CAST(date_trunc('month', min(period_end)) AS TIMESTAMP), "
        "CAST(date_trunc('month', max(period_end)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE))",
    }[freq]
    return f"""(
SELECT store_id, product_id, period_end, predicted, actual FROM (
  SELECT s.*, m.predicted, m.actual, row_number() OVER (PARTITION BY s.store_id, s.product_id
    ORDER BY s.period_end DESC) AS rn
  FROM (SELECT {S}, {spine} AS period_end FROM (SELECT *, {end} AS period_end FROM pred) GROUP BY {S}) s
  LEFT JOIN (SELECT {S}, {end} AS period_end, avg(predicted) AS predicted, avg(actual) AS actual
    FROM pred GROUP BY {S}, {end}) m
  ON s.store_id = m.store_id AND s.product_id = m.product_id AND s.period_end = m.period_end)
WHERE rn <= {last})"""


def period_query(freq: str, last: int) -> str:
    return with_parts(
        "pred",
        f"""SELECT {S}, period_end, {r6('predicted', 'predicted')}, {r6('actual', 'actual')}
        FROM {period_sql(freq, last)}""",
    )


@query("resample_month", period_query("month", 3))
def resample_month(spark, sf_dir):
    return rounded(resample(fixtures.panel_pred(spark, sf_dir), "month"))


@query("resample_month_12", period_query("month", 12))
def resample_month_12(spark, sf_dir):
    return rounded(resample(fixtures.panel_pred(spark, sf_dir), "month", last=12))


# -- single recommendations -------------------------------------------------


@query(
    "predict_scenarios",
    with_parts(
        "scenario", f"SELECT {S}, {py2('demand_raw')} AS predicted_weekly_demand FROM scenario"
    ),
)
def predict_scenarios(spark, sf_dir):
    latest = history.latest_row(fixtures.panel_pred(spark, sf_dir))
    scored = plan.predict_scenarios(fixtures.scenarios(spark, sf_dir), BASELINE, latest=latest)
    return scored.select(*SERIES, "predicted_weekly_demand")


def documents(spark, sf_dir):
    return plan.recommend(
        fixtures.scenarios(spark, sf_dir), fixtures.retail_panel(spark, sf_dir), BASELINE
    )


def band_case(low: str, mid: str, between: str, rest: str, demand: str = "demand") -> str:
    return (
        f"CASE WHEN stock IS NULL OR {demand} IS NULL THEN NULL WHEN stock < low THEN {low} WHEN stock < {demand} THEN {mid} "
        f"WHEN stock < high THEN {between} ELSE {rest} END"
    )


ORDER = band_case(
    "round_even(high - stock + high * 0.2, 0)",
    "round_even(demand - stock + demand * 0.15, 0)",
    "round_even(greatest(high - stock, 0), 0)",
    "0",
)
# Every figure a document shows, one step after the other.
STEPS = f"""
b AS (SELECT *, greatest(demand - stock, 0) AS short, greatest(stock - demand, 0) AS extra,
  CAST({ORDER} AS BIGINT) AS ord FROM band),
d AS (SELECT *, {py2('short * price')} AS lost, {py2('short')} AS short2, {py2('extra')} AS extra2,
  {py2('low * 4.0')} AS month_low, {py2('demand * 4.0')} AS month_avg, {py2('high * 4.0')} AS month_high
  FROM b)"""
# Fixed texts: the messages and explanations that the decisions must carry.
MESSAGE = band_case(
    "'⚠️ URGENT: Stock critically low! You have ' || stock || ' units but need at least ' || low || ' units.'",
    "'⚡ Stock is low. You have ' || stock || ' units but predicted demand is ' || demand || ' units.'",
    "'✅ Stock is adequate. You have ' || stock || ' units for predicted demand of ' || demand || ' units.'",
    "'📦 Stock is high. You have ' || stock || ' units, which is ' || extra || ' units more than predicted demand.'",
)
EXPLANATION = """
'You currently have ' || stock || ' units in stock. Based on past sales, you will likely sell ' || demand
|| ' units this week. ' || CASE WHEN short > 0 THEN 'This means you are SHORT by ' || short2
  || ' units. Order at least ' || ord || ' units to avoid losing ₹' || lost || ' in sales.'
  WHEN extra > 0 THEN 'You have EXTRA ' || extra2 || ' units, which is good for safety stock.'
  ELSE 'Your stock level is PERFECT for this week''s demand.' END"""


def document_sql(select: str) -> str:
    head = with_parts("band", "")
    return f"{head.rstrip()},{STEPS}\nSELECT {S}, {select} FROM d"


@query(
    "recommend",
    document_sql(
        f"""'{TARGET_DATE}' AS prediction_for_date, demand AS predicted_demand,
  stock AS current_stock, demand AS predicted_sales_this_week,
  {band_case("'CRITICAL_LOW'", "'LOW'", "'ADEQUATE'", "'EXCESS'")} AS stock_status,
  {band_case("'ORDER_IMMEDIATELY'", "'ORDER_SOON'", "'MONITOR'", "'NO_ORDER_NEEDED'")} AS action_needed,
  ord AS recommended_order_quantity, short2 AS shortage_units, extra2 AS surplus_units,
  {py2('high - demand')} AS safety_stock_needed,
  low AS week_low, demand AS week_average, high AS week_high,
  printf('%.1f%%', {py2('100 - mean_error', 1)}) AS confidence,
  month_low, month_avg AS month_average, month_high,
  {py2('demand * price')} AS expected_revenue, lost AS potential_lost_revenue, '₹' AS currency,
  {py2('mean_error')} AS avg_error_percent"""
    ),
)
def recommend(spark, sf_dir):
    return documents(spark, sf_dir).select(
        *SERIES,
        "prediction_for_date",
        "predicted_demand",
        "summary.current_stock",
        "summary.predicted_sales_this_week",
        "summary.stock_status",
        "summary.action_needed",
        "stock_recommendation.*",
        F.col("demand_estimates.this_week.low").alias("week_low"),
        F.col("demand_estimates.this_week.average").alias("week_average"),
        F.col("demand_estimates.this_week.high").alias("week_high"),
        F.col("demand_estimates.this_week.confidence").alias("confidence"),
        F.col("demand_estimates.this_month.low").alias("month_low"),
        F.col("demand_estimates.this_month.average").alias("month_average"),
        F.col("demand_estimates.this_month.high").alias("month_high"),
        "financial_impact.*",
        "confidence_interval.avg_error_percent",
    )


@query(
    "recommend_texts",
    document_sql(
        f"""{MESSAGE} AS message, {EXPLANATION} AS simple_explanation,
  'Based on 4 weeks, you will sell between ' || month_low || ' to ' || month_high
  || ' units this month' AS explanation"""
    ),
)
def recommend_texts(spark, sf_dir):
    return documents(spark, sf_dir).select(
        *SERIES,
        "summary.message",
        "summary.simple_explanation",
        "demand_estimates.this_month.explanation",
    )


def context_sql(freq: str, last: int) -> str:
    return with_parts(
        "pred",
        f"""SELECT {S}, strftime(period_end, '%Y-%m-%d') AS date, {np2('predicted')} AS predicted,
        {np2('actual')} AS actual FROM {period_sql(freq, last)}""",
    )


def context(spark, sf_dir, name):
    nested = documents(spark, sf_dir).select(*SERIES, f"performance_context.{name}")
    return listing(nested, name)


@query(
    "recommend_without_history",
    with_parts(
        "panel",
        f"SELECT {S}, CAST(NULL AS DOUBLE) AS predicted_demand, CAST(NULL AS VARCHAR) AS stock_status, "
        "CAST(NULL AS BIGINT) AS recommended_order_quantity, CAST(0 AS INT) AS listed_days "
        "FROM (SELECT DISTINCT store_id, 'new-' || product_id AS product_id FROM panel)",
    ),
)
def recommend_without_history(spark, sf_dir):
    """Every product under a name that has no history: documents with empty figures."""
    asked = fixtures.scenarios(spark, sf_dir).withColumn("product_id", F.concat(F.lit("new-"), "product_id"))
    return plan.recommend(asked, fixtures.retail_panel(spark, sf_dir), BASELINE).select(
        *SERIES,
        "predicted_demand",
        "summary.stock_status",
        "stock_recommendation.recommended_order_quantity",
        F.size("performance_context.last_7_days").alias("listed_days"),
    )


@query("recommend_last_7_days", with_parts("recent", listing_sql(7)))
def recommend_last_7_days(spark, sf_dir):
    return context(spark, sf_dir, "last_7_days")


@query("recommend_last_6_weeks", context_sql("week", 6))
def recommend_last_6_weeks(spark, sf_dir):
    return context(spark, sf_dir, "last_6_weeks")


@query("recommend_last_3_months", context_sql("month", 3))
def recommend_last_3_months(spark, sf_dir):
    return context(spark, sf_dir, "last_3_months")


# -- bulk recommendations ---------------------------------------------------


def bulk(spark, sf_dir):
    return plan.bulk_recommend(fixtures.retail_panel(spark, sf_dir), TARGET_DATE, BASELINE)


BULK_ORDER = band_case(
    "round_even(high - stock + high * 0.2, 0)",
    "round_even(demand_raw - stock + demand_raw * 0.15, 0)",
    "round_even(greatest(high - stock, 0), 0)",
    "0",
    "demand_raw",
)
BULK = f"""
SELECT store_id, '{TARGET_DATE}' AS prediction_date, product_id, category, stock AS current_stock,
  demand AS predicted_demand, low AS low_estimate, high AS high_estimate,
  CAST({BULK_ORDER} AS BIGINT) AS recommended_order,
  {py2('greatest(demand_raw - stock, 0)')} AS shortage,
  {band_case("'CRITICAL'", "'LOW'", "'ADEQUATE'", "'EXCESS'", 'demand_raw')} AS status,
  {band_case('1', '2', '3', '4', 'demand_raw')} AS priority,
  printf('%.1f%%', {py2('100 - mean_error', 1)}) AS confidence, price,
  {r6(f'({BULK_ORDER}) * price', 'order_value')},
  {py2('demand_raw * price')} AS potential_revenue,
  {py2('greatest(demand_raw - stock, 0) * price')} AS lost_revenue_risk,
  CASE WHEN demand_raw IS NULL THEN '{plan.NO_PREDICTION}' END AS error
FROM band"""


@query("bulk_recommend", with_parts("band", BULK))
def bulk_recommend(spark, sf_dir):
    rows = bulk(spark, sf_dir).drop("last_4_weeks", "demand_breakdown")
    return plan.priority_sort(rows.withColumn("order_value", F.round("order_value", 6)))


HORIZONS = (("weekly", ""), ("daily_average", " / 7.0"), ("monthly", " * 4.33"), ("quarterly", " * 13.0"))


@query(
    "bulk_demand_breakdown",
    with_parts(
        "band",
        f"SELECT {S}, "
        + ", ".join(
            f"{py2(f'{column}{factor}')} AS {name}_{end}"
            for name, factor in HORIZONS
            for end, column in (("low", "low"), ("average", "demand_raw"), ("high", "high"))
        )
        + " FROM band",
    ),
)
def bulk_demand_breakdown(spark, sf_dir):
    return bulk(spark, sf_dir).select(
        *SERIES,
        *[
            F.col(f"demand_breakdown.{name}.{end}").alias(f"{name}_{end}")
            for name, _ in HORIZONS
            for end in ("low", "average", "high")
        ],
    )


@query(
    "bulk_last_4_weeks",
    with_parts(
        "recent",
        f"""SELECT *, CASE WHEN actual > 0 THEN {r6('(1 - abs(predicted - actual) / actual) * 100', 'x')[:-5]}
        END AS accuracy FROM ({listing_sql(4)})""",
    ),
)
def bulk_last_4_weeks(spark, sf_dir):
    weeks = plan.listing_accuracy(bulk(spark, sf_dir))
    return weeks.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "bulk_summary",
    with_parts(
        "band",
        f"""SELECT store_id, '{TARGET_DATE}' AS prediction_date, count(*) AS total_products,
  count(*) FILTER (WHERE status = 'CRITICAL') AS critical_stock,
  count(*) FILTER (WHERE status = 'LOW') AS low_stock,
  count(*) FILTER (WHERE status = 'ADEQUATE') AS adequate_stock,
  count(*) FILTER (WHERE status = 'EXCESS') AS excess_stock,
  count(*) FILTER (WHERE error IS NOT NULL) AS failed_products,
  round(sum(recommended_order * price), 2) AS total_order_value,
  round(sum(lost_revenue_risk), 2) AS total_revenue_at_risk, '₹' AS currency
FROM ({BULK}) GROUP BY store_id""",
    ),
)
def bulk_summary(spark, sf_dir):
    return plan.bulk_summary(bulk(spark, sf_dir))


# -- relational views -------------------------------------------------------

NESTED = (
    "s.name AS store_name, s.region AS store_region, p.name AS product_name, "
    "p.category AS product_category, p.price AS product_price"
)
JOINS = "f JOIN store s ON f.store_id = s.id JOIN product p ON f.product_id = p.id"


def flat(view):
    plain = [c for c in view.columns if c not in ("store", "product")]
    return view.select(
        *plain,
        *[F.col(f"store.{c}").alias(f"store_{c}") for c in ("name", "region")],
        *[F.col(f"product.{c}").alias(f"product_{c}") for c in ("name", "category", "price")],
    )


def dimensions(spark, sf_dir):
    return fixtures.store(spark, sf_dir), fixtures.product(spark, sf_dir)


@query(
    "inventory_view",
    with_parts("inventory store product", f"SELECT f.*, {NESTED} FROM inventory {JOINS}"),
)
def inventory_view(spark, sf_dir):
    stock = fixtures.inventory(spark, sf_dir)
    return flat(views.inventory_view(stock, *dimensions(spark, sf_dir)))


@query(
    "inventory_by_id",
    with_parts(
        "inventory store product",
        f"SELECT f.*, {NESTED} FROM inventory {JOINS} WHERE f.id = (SELECT min(id) FROM inventory)",
    ),
)
def inventory_by_id(spark, sf_dir):
    stock = fixtures.inventory(spark, sf_dir)
    first = stock.agg(F.min("id")).scalar()
    return flat(views.inventory_by_id(stock, *dimensions(spark, sf_dir), first))


@query("sales_view", with_parts("sales store product", f"SELECT f.*, {NESTED} FROM sales {JOINS}"))
def sales_view(spark, sf_dir):
    return flat(views.sales_view(fixtures.sales(spark, sf_dir), *dimensions(spark, sf_dir)))


@query(
    "forecast_view",
    with_parts(
        "forecast store product",
        f"SELECT f.* REPLACE (round(f.demand, 6) AS demand), {NESTED} FROM forecast {JOINS}",
    ),
)
def forecast_view(spark, sf_dir):
    rows = fixtures.forecast(spark, sf_dir)
    return rounded(flat(views.forecast_view(rows, *dimensions(spark, sf_dir))))


REORDER_ROUNDED = "f.* REPLACE (round(f.demand, 6) AS demand, round(f.reorder_point, 6) AS reorder_point)"


@query(
    "reorder_view",
    with_parts("reorder store product", f"SELECT {REORDER_ROUNDED}, {NESTED} FROM reorder {JOINS}"),
)
def reorder_view(spark, sf_dir):
    rows = fixtures.reorder(spark, sf_dir)
    return rounded(flat(views.reorder_view(rows, *dimensions(spark, sf_dir))))


@query(
    "recent_reorders",
    with_parts("reorder", f"SELECT {REORDER_ROUNDED} FROM reorder f ORDER BY created_at DESC, id"),
)
def recent_reorders(spark, sf_dir):
    return rounded(views.recent_reorders(fixtures.reorder(spark, sf_dir)))


@query(
    "check_foreign_keys",
    with_parts(
        "sales store product",
        """SELECT 'sales' AS "table", 'product_id' AS "key", product_id + 50 AS "value",
        count(*) AS "rows" FROM sales WHERE product_id + 50 NOT IN (SELECT id FROM product)
        GROUP BY product_id
        UNION ALL SELECT 'sales', 'store_id', store_id, count(*) FROM sales
        WHERE store_id NOT IN (SELECT id FROM store) GROUP BY store_id""",
    ),
)
def check_foreign_keys(spark, sf_dir):
    store, product = dimensions(spark, sf_dir)
    shifted = fixtures.sales(spark, sf_dir, shift=50)
    return integrity.check_foreign_keys("sales", shifted, {"store": store, "product": product})


@query(
    "orphan_rows",
    with_parts(
        "sales product",
        """SELECT * REPLACE (product_id + 50 AS product_id) FROM sales
        WHERE product_id + 50 NOT IN (SELECT id FROM product)""",
    ),
)
def orphan_rows(spark, sf_dir):
    shifted = fixtures.sales(spark, sf_dir, shift=50)
    rows = integrity.orphan_rows(shifted, "product_id", fixtures.product(spark, sf_dir))
    return rows.select(*shifted.columns)


@query(
    "longest_series",
    with_parts(
        "panel",
        f"""SELECT max(n) AS "rows", CAST(max(hi) - min(lo) + 1 AS INT) AS "days" FROM (
        SELECT count(*) AS n, min(date) AS lo, max(date) AS hi FROM panel GROUP BY {S})""",
    ),
)
def longest_series(spark, sf_dir):
    return integrity.longest_series(fixtures.retail_panel(spark, sf_dir))


@query(
    "check_unique",
    with_parts(
        "sales",
        """SELECT store_id, product_id, count(*) AS "rows" FROM sales
        GROUP BY store_id, product_id HAVING count(*) > 1""",
    ),
)
def check_unique(spark, sf_dir):
    return integrity.check_unique(fixtures.sales(spark, sf_dir), ["store_id", "product_id"])


