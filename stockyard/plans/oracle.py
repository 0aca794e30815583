"""Independent SQL for the named queries, over the base tables.

Written for DuckDB. Sums stay exact and become DOUBLE once; means of ratios are
rounded to 6 places, as in the DataFrame form.
"""

# The test input as SQL: staging rows, and one clean row per business key.
INPUT = """
WITH b AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
    'S' || REPEAT('0', 3 - LENGTH(CAST(s_nationkey + 1 AS VARCHAR))) || CAST(s_nationkey + 1 AS VARCHAR) AS store_id,
    'P' || REPEAT('0', 4 - LENGTH(REPLACE(p_brand, 'Brand#', ''))) || REPLACE(p_brand, 'Brand#', '') AS product_id,
    p_type AS category, r_name AS region,
    CAST((l_orderkey * 37 + l_partkey * 17 + l_linenumber * 5) % 451 + 50 AS INT) AS inventory_level,
    CAST(l_quantity AS INT) AS qty,
    CAST((l_partkey * 11 + l_orderkey * 3) % 181 + 20 AS INT) AS units_ordered,
    CAST((l_orderkey * 13 + l_linenumber * 101 + l_suppkey * 7) % 3001 - 1000 AS INT) AS noise,
    CAST(p_retailprice AS DECIMAL(10,2)) AS price,
    CAST(ROUND(l_discount * 100) AS INT) AS discount,
    CASE CONCAT(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Cloudy' WHEN 'AO' THEN 'Rainy'
      WHEN 'NF' THEN 'Snowy' ELSE 'Sunny' END AS weather_condition,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS holiday_promotion,
    CASE WHEN MONTH(l_shipdate) IN (3,4,5) THEN 'Spring' WHEN MONTH(l_shipdate) IN (6,7,8) THEN 'Summer'
      WHEN MONTH(l_shipdate) IN (9,10,11) THEN 'Autumn' ELSE 'Winter' END AS seasonality,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS ext
  FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
u AS (SELECT *, CAST(FLOOR(inventory_level * (qty - 1) / 50.0) AS INT) AS units_sold FROM b),
raw AS (
  SELECT date, store_id, product_id, category, region, inventory_level, units_sold, units_ordered,
    CAST(CAST(units_sold AS DECIMAL(10,2)) + CAST(noise AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS demand_forecast,
    price, discount, weather_condition, holiday_promotion,
    CAST(price + CAST(noise AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS competitor_pricing,
    seasonality, l_orderkey, l_linenumber, l_partkey, l_suppkey, ext, qty
  FROM u),
fact AS (
  SELECT date, store_id, product_id, category, region, inventory_level, units_sold, units_ordered,
    CASE WHEN demand_forecast < 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE demand_forecast END AS demand_forecast,
    price, discount, weather_condition, holiday_promotion, competitor_pricing, seasonality
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, store_id, product_id
          ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, ext, qty) AS rn FROM raw) t
  WHERE rn = 1)
"""

COLUMNS = (
    "date, store_id, product_id, category, region, inventory_level, units_sold, units_ordered, "
    "demand_forecast, price, discount, weather_condition, holiday_promotion, competitor_pricing, seasonality"
)
NUMBERS = [
    "inventory_level", "units_sold", "units_ordered", "demand_forecast", "price", "discount",
    "holiday_promotion", "competitor_pricing",
]
TEXTS = ["store_id", "product_id", "category", "region", "weather_condition", "seasonality"]
KEY = "date, store_id, product_id"


# Staging rows with some values missing.
HOLES = (
    "(SELECT * REPLACE (NULLIF(discount, 5) AS discount, NULLIF(category, 'PROMO') AS category, "
    "CASE WHEN units_sold <> 0 THEN competitor_pricing END AS competitor_pricing) FROM raw)"
)


# --- building blocks --------------------------------------------------------


def avg(x):
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def total(x):
    return f"CAST(SUM({x}) AS BIGINT)"


def ratio(a, b):
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(condition):
    return f"(CAST(100 AS DOUBLE) * COUNT(*) FILTER (WHERE {condition}) / NULLIF(COUNT(*), 0))"


def tier(low="1.0", mid="1.5", high="2.0"):
    return (
        f"CASE WHEN inventory_level < {low} * demand_forecast THEN 'Understocked' "
        f"WHEN inventory_level <= {mid} * demand_forecast THEN 'Balanced' "
        f"WHEN inventory_level <= {high} * demand_forecast THEN 'High Inventory' "
        "ELSE 'Excess Inventory' END"
    )


RANK = (
    "CASE inventory_risk WHEN 'Understocked' THEN 1 WHEN 'Balanced' THEN 2 "
    "WHEN 'High Inventory' THEN 3 ELSE 4 END"
)
NARROW = tier("0.75", "1.25", "1.50")
SHELF = (
    "CASE WHEN inventory_level = 0 THEN 'Out of Stock' "
    "WHEN inventory_level < 0.75 * demand_forecast THEN 'Below Reorder' "
    "WHEN inventory_level < demand_forecast THEN 'Near Reorder' ELSE 'Adequate Stock' END"
)
GAP = "(CAST(1.10 AS DECIMAL(3,2)) * demand_forecast - inventory_level)"
GATED = (
    f"CASE WHEN inventory_level < demand_forecast THEN CAST(GREATEST(ROUND({GAP}, 0), 0) AS BIGINT) "
    "ELSE CAST(0 AS BIGINT) END"
)
UNGATED = f"CAST(GREATEST(ROUND_EVEN(CAST({GAP} AS DOUBLE), 0), 0) AS BIGINT)"

TURNOVER = f"({avg('units_sold')} / NULLIF({avg('inventory_level')}, 0))"
ERROR = "(units_sold - demand_forecast)"
MAE = avg(f"ABS{ERROR}")
RMSE = f"SQRT({avg(f'{ERROR} * {ERROR}')})"
MAPE = (
    f"ROUND(AVG(CAST(ABS{ERROR} AS DOUBLE) / NULLIF(CAST(units_sold AS DOUBLE), 0)) * 100, 6)"
)
PERF = (
    f"{total('units_sold')} AS total_units_sold, {total('units_ordered')} AS total_units_ordered, "
    f"{avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast, "
    f"{TURNOVER} AS inventory_turnover_proxy"
)
LOW_RATE = pct("inventory_level < demand_forecast")
IS_TIER = [f"{tier()} = '{t}'" for t in ("Understocked", "Balanced", "High Inventory", "Excess Inventory")]
RISK = (
    f"COUNT(*) AS valid_observations, {pct(IS_TIER[0])} AS understocked_pct, {pct(IS_TIER[1])} AS balanced_pct, "
    f"{pct(IS_TIER[2])} AS high_inventory_pct, {pct(IS_TIER[3])} AS excess_inventory_pct"
)
SCORES = f"{MAE} AS mae, {RMSE} AS rmse, {MAPE} AS mape"
SELLING = "demand_forecast >= 0 AND units_sold > 0"


def grouped(by, measures, where="TRUE", table="fact"):
    return f"SELECT {by}, {measures} FROM {table} WHERE {where} GROUP BY {by}"


def unpivoted(columns, kind, table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS {kind}) AS v FROM {table}" for c in columns
    )


def describe(columns, table):
    return f"""
      SELECT column_name, COUNT(v) AS count, CAST(SUM(h) AS DOUBLE) / 100 / COUNT(v) AS mean,
        ROUND(SQRT(CAST(CAST(COUNT(v) AS HUGEINT) * SUM(h * h) - SUM(h) * SUM(h) AS DOUBLE)
          / NULLIF(CAST(COUNT(v) AS DOUBLE) * (CAST(COUNT(v) AS DOUBLE) - 1), 0) / 10000), 9) AS std,
        MIN(v) AS min, ROUND(QUANTILE_CONT(v, 0.25), 9) AS p25, ROUND(QUANTILE_CONT(v, 0.5), 9) AS p50,
        ROUND(QUANTILE_CONT(v, 0.75), 9) AS p75, MAX(v) AS max
      FROM (SELECT column_name, v, CAST(ROUND(v * 100) AS HUGEINT) AS h FROM ({unpivoted(columns, 'DOUBLE', table)}))
      GROUP BY column_name"""


def counted(column, table="fact"):
    return f"SELECT {column}, COUNT(*) AS observations FROM {table} GROUP BY {column}"


def surplus(columns, table):
    return f"SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {columns} FROM {table})) AS BIGINT) FROM {table}"


def checks(table):
    one = [
        ("Number of rows", f"SELECT COUNT(*) FROM {table}"),
        ("Number of columns", "SELECT 15"),
        ("Missing values", "SELECT " + " + ".join(f"COUNT(*) - COUNT({c})" for c in COLUMNS.split(", ")) + f" FROM {table}"),
        ("Duplicate rows", surplus(COLUMNS, table)),
        ("Duplicate business keys", surplus(KEY, table)),
        ("Invalid dates", f"SELECT COUNT(*) FROM {table} WHERE date IS NULL"),
        ("Negative inventory", f"SELECT COUNT(*) FROM {table} WHERE inventory_level < 0"),
        ("Negative units sold", f"SELECT COUNT(*) FROM {table} WHERE units_sold < 0"),
        ("Negative units ordered", f"SELECT COUNT(*) FROM {table} WHERE units_ordered < 0"),
        ("Negative demand forecasts", f"SELECT COUNT(*) FROM {table} WHERE demand_forecast < 0"),
        ("Unique stores", f"SELECT COUNT(DISTINCT store_id) FROM {table}"),
        ("Unique products", f"SELECT COUNT(DISTINCT product_id) FROM {table}"),
        ("Unique categories", f"SELECT COUNT(DISTINCT category) FROM {table}"),
        ("Unique regions", f"SELECT COUNT(DISTINCT region) FROM {table}"),
        ("Unique dates", f"SELECT COUNT(DISTINCT date) FROM {table}"),
    ]
    return " UNION ALL ".join(
        f'SELECT \'{name}\' AS "check", CAST(({sql}) AS BIGINT) AS result, {i} AS position'
        for i, (name, sql) in enumerate(one, 1)
    )


def segment_metrics(by):
    return (
        f"SELECT {by}, {total('units_sold')} AS total_units_sold, {avg('inventory_level')} AS avg_inventory, "
        f"{TURNOVER} AS inventory_turnover_proxy, {LOW_RATE} AS low_inventory_risk_rate FROM fact GROUP BY {by}"
    )


def by_ntile(by):
    return (
        f"SELECT *, CASE NTILE(3) OVER (ORDER BY inventory_turnover_proxy, {by}) WHEN 1 THEN 'Slow-moving' "
        f"WHEN 2 THEN 'Medium-moving' ELSE 'Fast-moving' END AS movement_segment FROM ({segment_metrics(by)})"
    )


def by_quantile(by):
    return f"""
      SELECT m.*, CASE WHEN inventory_turnover_proxy <= e1 THEN 'Slow-moving'
        WHEN inventory_turnover_proxy <= e2 THEN 'Medium-moving'
        WHEN inventory_turnover_proxy IS NOT NULL THEN 'Fast-moving' END AS movement_segment
      FROM ({segment_metrics(by)}) m, (SELECT QUANTILE_CONT(inventory_turnover_proxy, CAST(1 AS DOUBLE) / 3) AS e1,
        QUANTILE_CONT(inventory_turnover_proxy, CAST(2 AS DOUBLE) / 3) AS e2 FROM ({segment_metrics(by)}))"""


def segment_means(segments):
    return f"""
      SELECT movement_segment, COUNT(*) AS num_products, {avg('total_units_sold')} AS avg_total_units_sold,
        ROUND(AVG(avg_inventory), 6) AS avg_inventory, ROUND(AVG(inventory_turnover_proxy), 9) AS avg_turnover_proxy,
        ROUND(AVG(low_inventory_risk_rate), 6) AS avg_low_inventory_risk_rate
      FROM ({segments}) GROUP BY movement_segment"""


def snapshot(day="(SELECT MAX(date) FROM fact)"):
    return f"SELECT * FROM fact WHERE date = {day}"


def reorder(quantity, day="(SELECT MAX(date) FROM fact)"):
    return (
        f"SELECT store_id, product_id, category, region, inventory_level, demand_forecast, {tier()} AS risk_status, "
        f"inventory_level < demand_forecast AS reorder_trigger, {quantity} AS recommended_order_qty "
        f"FROM ({snapshot(day)})"
    )


ACTIONS = (
    "SELECT store_id, product_id, category, region, inventory_level, demand_forecast, risk_status, "
    f"recommended_order_qty FROM ({reorder(GATED)}) WHERE reorder_trigger"
)
DAILY = (
    f"SELECT date, store_id, product_id, category, region, inventory_level, demand_forecast, {tier()} AS risk_status, "
    f"{GATED} AS recommended_order_qty FROM fact WHERE inventory_level < demand_forecast"
)
# The stream: what comes first, then everything with more stock; dates up to LATE are late then.
FIRST_STORES = "store_id < 'S013'"
LATE = "(SELECT MAX(date) - 30 FROM {table} WHERE " + FIRST_STORES + ")"
MORE = "(SELECT * REPLACE (inventory_level + 60 AS inventory_level) FROM fact)"
ORDER_ROW = (
    f"date, store_id, product_id, category, region, inventory_level, demand_forecast, {tier()} AS risk_status, "
    f"{GATED} AS recommended_order_qty"
)
VERSIONS = f"""
  SELECT {ORDER_ROW}, FALSE AS withdrawn FROM (
    SELECT * FROM fact WHERE {FIRST_STORES} AND date <= {LATE.format(table='fact')}
    UNION ALL SELECT * FROM {MORE} WHERE date > {LATE.format(table='fact')})
  WHERE inventory_level < demand_forecast
  UNION ALL SELECT {ORDER_ROW}, TRUE FROM {MORE}
  WHERE date > {LATE.format(table='fact')} AND {FIRST_STORES} AND inventory_level >= demand_forecast
    AND inventory_level - 60 < demand_forecast"""
_KEYS_OF = f"SELECT COUNT(*) FROM (SELECT DISTINCT {KEY} FROM raw WHERE"
ACCOUNT = f"""
  SELECT arrival, arrived, kept, late, arrived - kept - late AS repeated FROM (
    SELECT 0 AS arrival, (SELECT COUNT(*) FROM raw WHERE {FIRST_STORES}) AS arrived,
      ({_KEYS_OF} {FIRST_STORES})) AS kept, CAST(0 AS BIGINT) AS late
    UNION ALL SELECT 1, (SELECT COUNT(*) FROM raw), ({_KEYS_OF} date > {LATE.format(table='raw')})),
      ({_KEYS_OF} date <= {LATE.format(table='raw')})))"""
DEVIATION = (
    "SQRT(CAST(COUNT(units_sold) * SUM(CAST(units_sold AS BIGINT) * units_sold) - SUM(units_sold) * SUM(units_sold) AS DOUBLE) "
    "/ (CAST(COUNT(units_sold) AS DOUBLE) * CAST(COUNT(units_sold) AS DOUBLE)))"
)


def sales_stats(day="(SELECT MAX(date) FROM fact)", days=90):
    return (
        f"SELECT store_id, product_id, {avg('units_sold')} AS avg_daily_sales, {DEVIATION} AS stddev_daily_sales, "
        f"COUNT(*) AS days_observed FROM fact WHERE date > CAST({day} - INTERVAL {days} DAY AS DATE) AND date <= {day} "
        "GROUP BY store_id, product_id"
    )


def latest_stats(day="(SELECT MAX(date) FROM fact)", days=90):
    return (
        "SELECT store_id, product_id, inventory_level, demand_forecast, avg_daily_sales, stddev_daily_sales, days_observed "
        f"FROM ({snapshot(day)}) JOIN ({sales_stats(day, days)}) USING (store_id, product_id)"
    )


def trend(day="(SELECT MAX(date) FROM fact)", days=90, lead="1", z="1.65"):
    demand = f"avg_daily_sales * CAST({lead} AS DOUBLE)"
    safety = f"CAST({z} AS DOUBLE) * COALESCE(stddev_daily_sales, 0) * SQRT(CAST({lead} AS DOUBLE))"
    return f"""
      SELECT *, CASE WHEN current_stock <= 0 THEN 'Out of Stock'
        WHEN current_stock < reorder_point_trend_based THEN 'Below Reorder Point' ELSE 'Adequate Stock' END AS stock_status
      FROM (SELECT store_id, product_id, inventory_level AS current_stock, avg_daily_sales AS avg_daily_sales_90d,
        stddev_daily_sales AS stddev_daily_sales_90d, days_observed, {demand} AS lead_time_demand,
        {safety} AS safety_stock, {demand} + {safety} AS reorder_point_trend_based,
        demand_forecast AS given_demand_forecast FROM ({latest_stats(day, days)}))"""


def reorder_history():
    """Trailing statistics of every row by a frame over dates."""
    squares = "SUM(CAST(units_sold AS BIGINT) * units_sold) OVER w"
    deviation = (
        f"SQRT(CAST(COUNT(units_sold) OVER w * {squares} - SUM(units_sold) OVER w * SUM(units_sold) OVER w AS DOUBLE) "
        "/ (CAST(COUNT(units_sold) OVER w AS DOUBLE) * CAST(COUNT(units_sold) OVER w AS DOUBLE)))"
    )
    return f"""
      SELECT *, CASE WHEN current_stock <= 0 THEN 'Out of Stock'
        WHEN current_stock < reorder_point_trend_based THEN 'Below Reorder Point' ELSE 'Adequate Stock' END AS stock_status
      FROM (SELECT *, lead_time_demand + safety_stock AS reorder_point_trend_based FROM (
        SELECT *, avg_daily_sales_90d * 1::DOUBLE AS lead_time_demand,
          1.65::DOUBLE * COALESCE(stddev_daily_sales_90d, 0) * SQRT(1::DOUBLE) AS safety_stock
        FROM (SELECT {KEY}, inventory_level AS current_stock, demand_forecast AS given_demand_forecast,
            CAST(SUM(units_sold) OVER w AS DOUBLE) / COUNT(units_sold) OVER w AS avg_daily_sales_90d,
            {deviation} AS stddev_daily_sales_90d, COUNT(*) OVER w AS days_observed
          FROM fact WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date
            RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW))))"""


def order_changes(later="(SELECT MAX(date) FROM fact)", earlier=None, all_rows=False):
    earlier = earlier or f"(SELECT MAX(date) FROM fact WHERE date < {later})"

    def orders(day):
        return f"(SELECT *, {GATED} AS qty FROM fact WHERE date = {day} AND inventory_level < demand_forecast)"

    change = "CASE WHEN b.qty IS NULL THEN 'New' WHEN a.qty IS NULL THEN 'Withdrawn' WHEN a.qty <> b.qty THEN 'Changed' ELSE 'Unchanged' END"
    latest = ", ".join(
        f"CASE WHEN a.qty IS NULL THEN b.{c} ELSE a.{c} END AS {c}" for c in ("store_id", "product_id", "category", "region")
    )
    return f"""
      SELECT * FROM (SELECT {latest}, {change} AS change, b.inventory_level AS inventory_before,
        a.inventory_level AS inventory_now, b.qty AS order_qty_before, a.qty AS order_qty_now,
        COALESCE(a.qty, 0) - COALESCE(b.qty, 0) AS order_qty_change
      FROM {orders(later)} a FULL JOIN {orders(earlier)} b
        ON a.store_id IS NOT DISTINCT FROM b.store_id AND a.product_id IS NOT DISTINCT FROM b.product_id)
      WHERE {'TRUE' if all_rows else "change <> 'Unchanged'"}"""


CHANGE_RANK = "CASE change WHEN 'New' THEN 1 WHEN 'Changed' THEN 2 WHEN 'Unchanged' THEN 3 ELSE 4 END"
CHANGE_ORDER = f"{CHANGE_RANK}, ABS(order_qty_change) DESC, store_id, product_id"


def cube(slices):
    """One grouping for each slice."""
    keys = list(dict.fromkeys(c for s in slices for c in s))
    valid = "COUNT(*) FILTER (WHERE demand_forecast > 0)"
    shares = ", ".join(
        f"CAST(100 AS DOUBLE) * COUNT(*) FILTER (WHERE demand_forecast > 0 AND {t}) / NULLIF({valid}, 0) AS {c}"
        for t, c in zip(IS_TIER, ("understocked_pct", "balanced_pct", "high_inventory_pct", "excess_inventory_pct"))
    )
    return " UNION ALL ".join(
        f"SELECT '{' x '.join(s) or 'network'}' AS slice, "
        + "".join(f"{c if c in s else 'CAST(NULL AS VARCHAR)'} AS {c}, " for c in keys)
        + f"{PERF}, {valid} AS valid_observations, {shares} FROM fact" + (f" GROUP BY {', '.join(s)}" if s else "")
        for s in slices
    )


def dated(by="store_id, product_id"):
    return f"SELECT *, LAG(date) OVER (PARTITION BY {by} ORDER BY date) AS before FROM (SELECT DISTINCT {by}, date FROM fact)"


def date_gaps(by="store_id, product_id"):
    return (
        f"SELECT {by}, CAST(before + 1 AS DATE) AS gap_start, CAST(date - 1 AS DATE) AS gap_end, "
        f"CAST(date - before - 1 AS INT) AS missing_days FROM ({dated(by)}) WHERE date - before > 1"
    )


LOOKUP = {
    "categories": ("category", "category_id"), "regions": ("region", "region_id"),
    "weather_conditions": ("weather_condition", "weather_id"), "seasons": ("seasonality", "season_id"),
}


def ids(column, table="fact"):
    return (
        f"SELECT {column}, CAST(ROW_NUMBER() OVER (ORDER BY {column}) AS INT) AS id "
        f"FROM (SELECT DISTINCT {column} FROM {table})"
    )


# A first load of some rows, then all: its names keep their ids, new ones come after them.
FIRST = "category >= 'LARGE' AND region > 'AMERICA' AND store_id > 'S005'"


def merged_ids(table, column):
    first = ids(column, f"fact WHERE {FIRST}")
    new = f"SELECT DISTINCT {column} FROM fact WHERE {column} NOT IN (SELECT {column} FROM ({first}))"
    return (
        f"SELECT '{table}' AS table_name, id, {column} AS name FROM ({first}) UNION ALL "
        f"SELECT '{table}', CAST((SELECT COUNT(*) FROM ({first})) + ROW_NUMBER() OVER (ORDER BY {column}) AS INT), {column} FROM ({new})"
    )


ENTITY_ROWS = [
    "SELECT 'stores' AS table_name, CAST(NULL AS INT) AS id, store_id AS name FROM (SELECT DISTINCT store_id FROM fact)",
    "SELECT 'products', CAST(NULL AS INT), product_id FROM (SELECT DISTINCT product_id FROM fact)",
]

STAR = f"""
  SELECT date, store_id, product_id, c.id AS category_id, r.id AS region_id, inventory_level, units_sold, units_ordered,
    demand_forecast, price, discount, w.id AS weather_id, holiday_promotion AS promotion_id, competitor_pricing, s.id AS season_id
  FROM fact JOIN ({ids('category')}) c USING (category) JOIN ({ids('region')}) r USING (region)
    JOIN ({ids('weather_condition')}) w USING (weather_condition) JOIN ({ids('seasonality')}) s USING (seasonality)"""

TABLE_ROWS = " UNION ALL ".join(
    [
        "SELECT 'stores' AS table_name, COUNT(DISTINCT store_id) AS row_count, 1 AS column_count FROM fact",
        "SELECT 'products', COUNT(DISTINCT product_id), 1 FROM fact",
    ]
    + [f"SELECT '{t}', COUNT(DISTINCT {c}), 2 FROM fact" for t, (c, _) in LOOKUP.items()]
    + ["SELECT 'promotions', 2, 3", "SELECT 'inventory_sales_normalized', COUNT(*), 15 FROM fact"]
)


def dependency(left, right, label):
    return f"""
      SELECT '{label}' AS determinant, '{right}' AS dependent, COUNT(*) AS groups,
        COUNT(*) FILTER (WHERE n > 1) AS violating_groups, MIN(n) AS min_values, MAX(n) AS max_values
      FROM (SELECT {left}, COUNT(DISTINCT {right}) AS n FROM fact GROUP BY {left})"""


def months(by, measures):
    group = "month" + (f", {by}" if by else "")
    inner = "SELECT *, CAST(DATE_TRUNC('month', date) AS DATE) AS month FROM fact"
    return f"SELECT {group}, {measures} FROM ({inner}) GROUP BY {group}"


def driver(column, *averages):
    measures = ", ".join(f"{avg(c)} AS {label}" for c, label in averages)
    return grouped(column, f"COUNT(*) AS observations, {measures}", "demand_forecast >= 0")


SOLD = ("units_sold", "avg_units_sold")
FORECAST = ("demand_forecast", "avg_demand_forecast")
STOCK = ("inventory_level", "avg_inventory")
ORDERED = ("units_ordered", "avg_units_ordered")


def overstocked(by):
    return grouped(
        by,
        "COUNT(*) AS observations, COUNT(*) FILTER (WHERE inventory_level > 1.5 * demand_forecast) AS overstock_observations, "
        f"{avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast, "
        f"{total('units_sold')} AS total_units_sold, {pct('inventory_level > 1.5 * demand_forecast')} AS overstock_pct",
        "demand_forecast > 0",
    )


def pivot(row, column, values):
    cells = ", ".join(
        f"CAST(SUM(units_sold) FILTER (WHERE {column} = '{v}') AS DOUBLE) "
        f"/ NULLIF(COUNT(units_sold) FILTER (WHERE {column} = '{v}'), 0) AS \"{v}\""
        for v in values
    )
    return f"SELECT {row}, {cells} FROM fact GROUP BY {row}"


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

MOVEMENT = (
    f"{total('units_sold')} AS total_units_sold, {avg('inventory_level')} AS avg_inventory, "
    f"{TURNOVER} AS inventory_turnover_proxy, COUNT(*) FILTER (WHERE units_sold > 0) AS active_selling_days, "
    f"{LOW_RATE} AS low_inventory_risk_rate"
)

EXTREMES = ", ".join(
    f"MIN({c}) AS min_{n}, MAX({c}) AS max_{n}, {avg(c)} AS avg_{n}"
    for c, n in [
        ("inventory_level", "inventory"), ("units_sold", "units_sold"), ("units_ordered", "units_ordered"),
        ("demand_forecast", "demand_forecast"), ("price", "price"), ("discount", "discount"),
    ]
)

NULL_NAMES = [
    "null_date", "null_store", "null_product", "null_category", "null_region", "null_inventory",
    "null_units_sold", "null_units_ordered", "null_forecast", "null_price", "null_discount",
    "null_weather", "null_holiday", "null_competitor_price", "null_seasonality",
]
NEGATIVE_NAMES = {
    "inventory_level": "negative_inventory", "units_sold": "negative_sales",
    "units_ordered": "negative_orders", "demand_forecast": "negative_forecasts", "price": "negative_price",
    "discount": "negative_discount", "competitor_pricing": "negative_competitor_price",
}
TYPE_ROWS = [
    ("date", "date", "other"), ("store_id", "string", "string"), ("product_id", "string", "string"),
    ("category", "string", "string"), ("region", "string", "string"), ("inventory_level", "int", "numeric"),
    ("units_sold", "int", "numeric"), ("units_ordered", "int", "numeric"),
    ("demand_forecast", "decimal(10,2)", "numeric"), ("price", "decimal(10,2)", "numeric"),
    ("discount", "int", "numeric"), ("weather_condition", "string", "string"),
    ("holiday_promotion", "int", "numeric"), ("competitor_pricing", "decimal(10,2)", "numeric"),
    ("seasonality", "string", "string"),
]

FACT_ROWS = f"SELECT {COLUMNS} FROM fact"
RAW_ROWS = f"SELECT {COLUMNS} FROM raw"
OUTLIERS = f"""
  SELECT column_name, ROUND(q1, 9) AS q1, ROUND(q3, 9) AS q3, ROUND(lower_bound, 9) AS lower_bound,
    ROUND(upper_bound, 9) AS upper_bound,
    COUNT(*) FILTER (WHERE v < lower_bound OR v > upper_bound) AS outlier_count,
    CAST(100 AS DOUBLE) * COUNT(*) FILTER (WHERE v < lower_bound OR v > upper_bound) / COUNT(*) AS outlier_pct
  FROM ({unpivoted(NUMBERS, 'DOUBLE', HOLES)}) JOIN (
    SELECT column_name, q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound
    FROM (SELECT column_name, QUANTILE_CONT(v, 0.25) AS q1, QUANTILE_CONT(v, 0.75) AS q3
          FROM ({unpivoted(NUMBERS, 'DOUBLE', HOLES)}) GROUP BY column_name)) USING (column_name)
  GROUP BY ALL"""

KPI_ROWS = [
    ("Total Observations", "CAST(COUNT(*) AS DOUBLE)"), ("Total Units Sold", "CAST(SUM(units_sold) AS DOUBLE)"),
    ("Total Units Ordered", "CAST(SUM(units_ordered) AS DOUBLE)"), ("Average Inventory", avg("inventory_level")),
    ("Average Demand Forecast", avg("demand_forecast")), ("Forecast MAE", MAE), ("Forecast RMSE", RMSE),
    ("Forecast MAPE", MAPE), ("Overstock %", pct("inventory_level > 1.5 * demand_forecast")),
    ("Balanced Inventory %", pct("inventory_level BETWEEN 0.75 * demand_forecast AND 1.25 * demand_forecast")),
]

BODIES = {
    # sources and sinks
    "read_csv": RAW_ROWS,
    "read_csv_dates": FACT_ROWS,
    "bulk_load_staging": f"SELECT {COLUMNS}, units_sold = 0 AS refused FROM (SELECT * REPLACE (CASE WHEN units_sold <> 0 THEN date END AS date) FROM raw)",
    "table_query": grouped(
        "region, seasonality", f"COUNT(*) AS observations, {total('units_sold')} AS units_sold", "units_sold > 0"
    ),
    "write_csv": FACT_ROWS,
    "load_fact": FACT_ROWS,
    "insert_select": STAR,
    "insert_values": "SELECT holiday_promotion AS promotion_id, holiday_promotion AS is_holiday_promotion, "
    "CASE holiday_promotion WHEN 0 THEN 'No Promotion' ELSE 'Holiday Promotion' END AS description, "
    "COUNT(*) AS observations FROM fact GROUP BY holiday_promotion",
    "create_tables": TABLE_ROWS,
    "check_input_shape": f"SELECT COUNT(*) AS rows, 15 AS columns, COUNT(*) = (SELECT COUNT(*) FROM (SELECT DISTINCT {KEY} FROM raw)) AS ok FROM fact",
    # scalar derivations
    "parse_date_strict": f"SELECT {KEY}, inventory_level FROM fact",
    "parse_date_coerce": "SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE units_sold = 0) AS invalid_dates FROM fact",
    "clip_negative_forecast": f"SELECT {KEY}, inventory_level, CASE WHEN demand_forecast < 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE demand_forecast END AS demand_forecast FROM raw",
    "clip_report": "SELECT COUNT(*) FILTER (WHERE demand_forecast < 0) AS negative_before, CAST(0 AS BIGINT) AS negative_after, COUNT(*) AS rows_before, COUNT(*) AS rows_after FROM raw",
    "format_date": "SELECT STRFTIME(date, '%Y-%m-%d') AS date, store_id, product_id FROM fact",
    "time_features": f"SELECT {KEY}, CAST(YEAR(date) AS INT) AS year, CAST(MONTH(date) AS INT) AS month, MONTHNAME(date) AS month_name, DAYNAME(date) AS day_of_week, CAST(WEEKOFYEAR(date) AS INT) AS week FROM fact",
    "forecast_error_columns": f"SELECT {KEY}, CAST({ERROR} AS DECIMAL(12,2)) AS forecast_error, CAST(ABS{ERROR} AS DECIMAL(12,2)) AS absolute_forecast_error, CASE WHEN demand_forecast > 0 THEN CAST(ABS{ERROR} AS DOUBLE) / CAST(demand_forecast AS DOUBLE) * 100 END AS forecast_error_pct FROM fact",
    "valid_forecast_split": "SELECT COUNT(*) AS total_observations, COUNT(*) FILTER (WHERE demand_forecast >= 0) AS valid_observations, COUNT(*) FILTER (WHERE demand_forecast < 0) AS invalid_observations FROM raw",
    "valid_forecast_rows": f"SELECT {KEY}, units_sold, demand_forecast FROM raw WHERE demand_forecast >= 0",
    "risk_tier": f"SELECT {KEY}, {tier()} AS inventory_risk FROM fact",
    "risk_tier_ratio": f"""SELECT {KEY}, CASE WHEN r < 1 THEN 'Understocked' WHEN r <= 1.5 THEN 'Balanced'
        WHEN r <= 2 THEN 'High Inventory' ELSE 'Excess Inventory' END AS inventory_risk
      FROM (SELECT {KEY}, CAST(inventory_level AS DOUBLE) / CAST(demand_forecast AS DOUBLE) AS r FROM fact WHERE demand_forecast > 0)""",
    "risk_tier_narrow": f"SELECT {KEY}, {NARROW} AS inventory_risk FROM fact",
    "overstock_flag": f"SELECT {KEY}, inventory_level > 1.5 * demand_forecast AS overstock_risk FROM fact",
    "balanced_band": f"SELECT COUNT(*) AS observations, {KPI_ROWS[-1][1]} AS balanced_pct FROM fact",
    "inventory_status": f"SELECT {KEY}, {SHELF} AS inventory_status FROM fact",
    "stock_status_trend": f"SELECT store_id, product_id, stock_status FROM ({trend()})",
    "reorder_trigger": f"SELECT {KEY}, inventory_level < demand_forecast AS reorder_trigger FROM fact",
    "recommended_qty": f"SELECT {KEY}, {GATED} AS recommended_order_qty FROM fact",
    "recommended_qty_ungated": f"SELECT {KEY}, {UNGATED} AS recommended_order_qty FROM fact",
    "predicates": f"""SELECT COUNT(*) FILTER (WHERE demand_forecast > 0) AS positive_forecast,
        COUNT(*) FILTER (WHERE demand_forecast >= 0) AS valid_forecast, COUNT(category) AS with_category,
        COUNT(*) FILTER (WHERE discount IN (0, 5, 10)) AS round_discount,
        COUNT(*) FILTER (WHERE inventory_level BETWEEN 100 AND 200) AS mid_inventory,
        COUNT(*) FILTER (WHERE date = (SELECT MAX(date) FROM fact)) AS on_latest_date,
        COUNT(*) FILTER (WHERE {SELLING}) AS scored FROM fact""",
    "filter_by_selection": f"SELECT {KEY}, category, {tier()} AS inventory_risk FROM fact WHERE category = 'PROMO'",
    "product_view": f"SELECT product_id, total_units_sold, avg_inventory, inventory_turnover_proxy, movement_segment FROM ({by_quantile('product_id')})",
    "distinct_values": "SELECT DISTINCT discount FROM fact",
    "distinct_promotions": "SELECT DISTINCT holiday_promotion FROM fact",
    "label_concat": f"SELECT date, store_id || ' · ' || product_id AS label, recommended_order_qty FROM ({DAILY})",
    "min_max_scale": f"""SELECT product_id, n AS total_units_sold, 200::DOUBLE + 1800::DOUBLE * (CAST(n - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE)) AS bubble_size
      FROM (SELECT product_id, {total('units_sold')} AS n FROM fact GROUP BY product_id),
        (SELECT MIN(n) AS lo, MAX(n) AS hi FROM (SELECT {total('units_sold')} AS n FROM fact GROUP BY product_id))""",
    "sample_n": f"SELECT {KEY}, demand_forecast, inventory_level, {tier()} AS inventory_risk FROM fact "
    f"ORDER BY MD5(CONCAT_WS('|', STRFTIME(date, '%Y-%m-%d'), store_id, product_id, '42')), {KEY} LIMIT 4000",
    "max_of_columns": "SELECT GREATEST(CAST(MAX(demand_forecast) AS DOUBLE), CAST(MAX(inventory_level) AS DOUBLE)) AS max_value FROM (SELECT * FROM fact "
    f"ORDER BY MD5(CONCAT_WS('|', STRFTIME(date, '%Y-%m-%d'), store_id, product_id, '42')), {KEY} LIMIT 4000)",
    "select_columns": f"SELECT {KEY}, category, inventory_level, units_sold, demand_forecast FROM fact",
    # joins and subqueries
    "equi_join_2key": latest_stats(),
    "latest_snapshot": f"SELECT {COLUMNS} FROM ({snapshot()})",
    "trailing_window_filter": FACT_ROWS + " WHERE date > CAST((SELECT MAX(date) FROM fact) - INTERVAL 90 DAY AS DATE)",
    "scalar_subquery_projection": f"SELECT {tier()} AS inventory_risk, COUNT(*) AS observations, CAST(100 AS DOUBLE) * COUNT(*) / (SELECT COUNT(*) FROM fact WHERE demand_forecast > 0) AS percentage FROM fact WHERE demand_forecast > 0 GROUP BY 1",
    "normalize_fact": STAR,
    "build_dimensions": " UNION ALL ".join(
        ENTITY_ROWS + [f"SELECT '{t}', id, {c} FROM ({ids(c)})" for t, (c, _) in LOOKUP.items()]
    ),
    "dimension_merge": " UNION ALL ".join(ENTITY_ROWS + [merged_ids(t, c) for t, (c, _) in LOOKUP.items()]),
    "denormalize_fact": FACT_ROWS,
    "aligned_assign": grouped("product_id", f"{total('units_sold')} AS total_units_sold, {avg('inventory_level')} AS avg_inventory, {LOW_RATE} AS low_inventory_risk_rate"),
    "fk_check": " UNION ALL ".join(
        f"SELECT '{key}' AS foreign_key, COUNT(*) AS checked_rows, COUNT(*) FILTER (WHERE {column} NOT IN (SELECT v FROM known_{i})) AS orphan_rows, "
        f"COUNT(DISTINCT {column}) FILTER (WHERE {column} NOT IN (SELECT v FROM known_{i})) AS orphan_values "
        f"FROM raw".replace(f"known_{i}", known)
        for i, (key, column, known) in enumerate(
            [(k, c, f"(SELECT DISTINCT {c} AS v FROM raw WHERE category <> 'PROMO' AND product_id < 'P0050')")
             for k, c in [("store_id", "store_id"), ("product_id", "product_id"), *((i, c) for c, i in LOOKUP.values())]]
            + [("promotion_id", "holiday_promotion", "(SELECT UNNEST([0, 1]) AS v)")]
        )
    ),
    "reindex_to_domain": f"""SELECT d.inventory_status, COALESCE(n, 0) AS observations
      FROM (VALUES ('Out of Stock'), ('Below Reorder'), ('Near Reorder'), ('Adequate Stock')) d(inventory_status)
        LEFT JOIN (SELECT {SHELF} AS inventory_status, COUNT(*) AS n FROM fact GROUP BY 1) USING (inventory_status)""",
    "load_reconciliation": """SELECT 'rows' AS "check", COUNT(*) AS expected, COUNT(*) AS actual, TRUE AS ok FROM raw
      UNION ALL SELECT 'categories', COUNT(DISTINCT category), COUNT(DISTINCT category), TRUE FROM raw""",
    # validation and profiling
    "row_count": "SELECT COUNT(*) AS total_rows FROM raw",
    "date_span": "SELECT MIN(date) AS earliest_date, MAX(date) AS latest_date, COUNT(DISTINCT date) AS unique_dates FROM raw",
    "cardinality": "SELECT COUNT(DISTINCT store_id) AS stores, COUNT(DISTINCT product_id) AS products, COUNT(DISTINCT category) AS categories, COUNT(DISTINCT region) AS regions FROM raw",
    "null_counts": "SELECT " + ", ".join(f"COUNT(*) - COUNT({c}) AS {n}" for c, n in zip(COLUMNS.split(", "), NULL_NAMES)) + f" FROM {HOLES}",
    "missing_report": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count, CAST(100 AS DOUBLE) * (COUNT(*) - COUNT({c})) / COUNT(*) AS missing_percentage FROM {HOLES}"
        for c in COLUMNS.split(", ")
    ),
    "duplicate_keys": f"SELECT {KEY}, COUNT(*) AS duplicate_count FROM raw GROUP BY {KEY} HAVING COUNT(*) > 1",
    "duplicate_key_rows": f"SELECT CAST(SUM(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_duplicated_keys, CAST(SUM(n - 1) AS BIGINT) AS surplus_key_rows FROM (SELECT COUNT(*) AS n FROM raw GROUP BY {KEY})",
    "duplicate_rows": f"SELECT ({surplus(COLUMNS, 'raw')}) AS duplicate_rows",
    "negative_counts": "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} < 0) AS {n}" for c, n in NEGATIVE_NAMES.items()) + " FROM raw",
    "zero_counts": " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} = 0) AS zero_count FROM raw" for c in NUMBERS),
    "value_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS column_value, COUNT(*) AS observations FROM raw GROUP BY {c}"
        for c in TEXTS
    ),
    "value_counts_category": counted("category"),
    "value_counts_region": counted("region"),
    "value_counts_weather_condition": counted("weather_condition"),
    "value_counts_seasonality": counted("seasonality"),
    "value_counts_store_id": counted("store_id"),
    "value_counts_product_id": counted("product_id"),
    "select_dtypes": " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, '{k}' AS kind, COUNT({c}) AS non_null_count FROM raw"
        for i, (c, t, k) in enumerate(TYPE_ROWS, 1)
    ),
    "describe_numeric": describe(NUMBERS, HOLES),
    "describe_strings": f"""SELECT column_name, CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS "unique",
        ARG_MIN(v, rk) AS top, MAX(n) AS freq
      FROM (SELECT column_name, v, n, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS rk
            FROM (SELECT column_name, v, COUNT(*) AS n FROM ({unpivoted(TEXTS, 'VARCHAR', HOLES)}) WHERE v IS NOT NULL GROUP BY column_name, v))
      GROUP BY column_name""",
    "numeric_summary": f"SELECT column_name, min, max, mean, p50 AS median FROM ({describe(NUMBERS, HOLES)})",
    "iqr_outliers": OUTLIERS,
    "descriptive_stats": f"SELECT {EXTREMES}, QUANTILE_CONT(CAST(inventory_level AS DOUBLE), 0.5) AS median_inventory FROM fact",
    "negative_forecast_diag": f"SELECT COUNT(*) AS negative_forecast_rows, {avg('demand_forecast')} AS avg_negative_forecast, MIN(demand_forecast) AS min_negative_forecast, MAX(demand_forecast) AS max_negative_forecast FROM raw WHERE demand_forecast < 0",
    "negative_forecast_by": grouped("category", "COUNT(*) AS negative_forecast_rows", "demand_forecast < 0", "raw"),
    "negative_forecast_by_season": grouped("seasonality", "COUNT(*) AS negative_forecast_rows", "demand_forecast < 0", "raw"),
    "negative_forecast_by_promotion": grouped("holiday_promotion", "COUNT(*) AS negative_forecast_rows", "demand_forecast < 0", "raw"),
    "negative_forecast_described": describe(["demand_forecast", "units_sold"], "(SELECT * FROM raw WHERE demand_forecast < 0)"),
    "negative_forecast_preview": f"SELECT {KEY}, category, inventory_level, units_sold, units_ordered, demand_forecast FROM raw WHERE demand_forecast < 0 ORDER BY {KEY}, demand_forecast, inventory_level, units_ordered LIMIT 20",
    "quality_summary": checks("raw"),
    "quality_summary_clean": checks("fact"),
    "functional_dependency": " UNION ALL ".join(
        [
            dependency("product_id", "category", "product_id"),
            dependency("store_id", "region", "store_id"),
            dependency("date, store_id", "weather_condition", "date+store_id"),
        ]
    ),
    "peek_dates": "SELECT DISTINCT date FROM fact ORDER BY date LIMIT 10",
    # KPIs
    "network_kpis": f"SELECT {total('units_sold')} AS total_units_sold, {total('units_ordered')} AS total_units_ordered, {avg('inventory_level')} AS avg_inventory_level, {avg('demand_forecast')} AS avg_demand_forecast FROM fact",
    "inventory_to_sales": f"SELECT {ratio('SUM(inventory_level)', 'SUM(units_sold)')} AS inventory_to_sales_ratio FROM fact",
    "turnover_proxy": f"SELECT {TURNOVER} AS inventory_turnover_proxy FROM fact",
    "store_performance": grouped("store_id", PERF),
    "store_order_efficiency": grouped("store_id", f"{total('units_sold')} AS total_units_sold, {total('units_ordered')} AS total_units_ordered, {ratio('SUM(units_ordered)', 'SUM(units_sold)')} AS order_to_sales_ratio, {ratio('100 * SUM(units_sold)', 'SUM(units_ordered)')} AS sales_to_order_pct"),
    "category_performance": grouped("category", PERF),
    "product_performance": grouped("product_id", PERF),
    "inventory_coverage": "SELECT ROUND(AVG(CAST(inventory_level AS DOUBLE) / CAST(demand_forecast AS DOUBLE)), 6) AS avg_inventory_coverage FROM fact WHERE demand_forecast > 0",
    "risk_distribution": f"SELECT inventory_risk, {RANK} AS risk_rank, observations, CAST(100 AS DOUBLE) * observations / SUM(observations) OVER () AS percentage FROM (SELECT {tier()} AS inventory_risk, COUNT(*) AS observations FROM fact WHERE demand_forecast > 0 GROUP BY 1)",
    "risk_distribution_all": f"""SELECT d.inventory_risk, d.risk_rank, COALESCE(n, 0) AS observations,
        CAST(100 AS DOUBLE) * COALESCE(n, 0) / SUM(COALESCE(n, 0)) OVER () AS percentage
      FROM (VALUES ('Understocked', 1), ('Balanced', 2), ('High Inventory', 3), ('Excess Inventory', 4)) d(inventory_risk, risk_rank)
        LEFT JOIN (SELECT {tier()} AS inventory_risk, COUNT(*) AS n FROM fact WHERE inventory_level <= 2 * demand_forecast GROUP BY 1) USING (inventory_risk)""",
    "risk_by_store": grouped("store_id", RISK, "demand_forecast > 0"),
    "risk_by_category": grouped("category", RISK, "demand_forecast > 0"),
    "risk_by_product": grouped("product_id", f"{RISK}, {avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast", "demand_forecast > 0"),
    "risk_by_region": grouped("region", RISK, "demand_forecast > 0"),
    "store_region_summary": grouped("store_id", f"{total('units_sold')} AS units_sold, {avg('inventory_level')} AS avg_inventory, {LOW_RATE} AS low_inventory_risk_rate"),
    "region_summary": grouped("region", f"{total('units_sold')} AS units_sold, {avg('inventory_level')} AS avg_inventory, {LOW_RATE} AS low_inventory_risk_rate"),
    "store_risk_composition": f"SELECT store_id, {tier()} AS inventory_risk, COUNT(*) AS observations FROM fact GROUP BY 1, 2",
    "overview_kpis": f"SELECT {avg('inventory_level')} AS avg_inventory, {total('units_sold')} AS total_units_sold, {total('units_ordered')} AS total_units_ordered, {pct(IS_TIER[0])} AS low_inventory_risk_rate, {pct(IS_TIER[3])} AS overstock_risk_rate FROM fact",
    "forecast_accuracy": f"SELECT {SCORES} FROM fact WHERE {SELLING}",
    "forecast_accuracy_all_rows": f"SELECT {SCORES} FROM fact",
    "accuracy_by_store": grouped("store_id", f"COUNT(*) AS observations, {SCORES}", SELLING),
    "accuracy_by_store_all_rows": grouped("store_id", f"COUNT(*) AS observations, {SCORES}"),
    "accuracy_by_category": grouped("category", f"COUNT(*) AS observations, {SCORES}", SELLING),
    "accuracy_by_category_all_rows": grouped("category", f"COUNT(*) AS observations, {SCORES}"),
    "accuracy_by_store_category": grouped("store_id, category", f"COUNT(*) AS observations, {SCORES}", SELLING),
    "accuracy_by_risk": f"SELECT {tier()} AS inventory_risk, COUNT(*) AS observations, {SCORES} FROM fact WHERE {SELLING} GROUP BY 1",
    "accuracy_by_risk_narrow": f"""SELECT d.inventory_risk, observations, mae, rmse, mape
      FROM (VALUES ('Understocked'), ('Balanced'), ('High Inventory'), ('Excess Inventory')) d(inventory_risk)
        LEFT JOIN (SELECT {NARROW} AS inventory_risk, COUNT(*) AS observations, {SCORES} FROM fact GROUP BY 1) USING (inventory_risk)""",
    "understocked_segments": grouped("store_id, category", f"COUNT(*) AS understocked_observations, {avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast, {avg('units_sold')} AS avg_units_sold, {avg('demand_forecast - inventory_level')} AS avg_inventory_gap", "demand_forecast >= 0 AND inventory_level < demand_forecast"),
    "excess_segments": grouped("store_id, category", f"COUNT(*) AS excess_inventory_observations, {avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast, {avg('inventory_level - demand_forecast')} AS avg_inventory_surplus", "demand_forecast >= 0 AND inventory_level > 2 * demand_forecast"),
    "drivers_discount": driver("discount", SOLD, FORECAST, STOCK, ("price", "avg_price")),
    "drivers_promotion": driver("holiday_promotion", SOLD, FORECAST, STOCK, ORDERED),
    "drivers_season": driver("seasonality", SOLD, FORECAST, STOCK, ORDERED),
    "drivers_weather": driver("weather_condition", SOLD, FORECAST, STOCK, ORDERED),
    "drivers_weather_all_rows": grouped(
        "weather_condition", f"COUNT(*) AS observations, {avg('units_sold')} AS avg_units_sold, "
        f"{avg('demand_forecast')} AS avg_demand_forecast, {avg('inventory_level')} AS avg_inventory, {avg('units_ordered')} AS avg_units_ordered",
        table="(SELECT * REPLACE (CASE WHEN discount > 0 THEN demand_forecast END AS demand_forecast) FROM fact)",
    ),
    "overstock_by_product": overstocked("product_id"),
    "overstock_by_category": overstocked("category"),
    "excess_by_product": grouped("product_id", f"COUNT(*) AS observations, COUNT(*) FILTER (WHERE {IS_TIER[3]}) AS overstock_observations, {pct(IS_TIER[3])} AS overstock_pct"),
    "store_efficiency": f"""SELECT store_id, total_units_sold, avg_inventory, avg_demand_forecast, CAST(total_units_sold AS DOUBLE) / (avg_inventory * (CAST(n AS DOUBLE) / stores)) AS inventory_efficiency
      FROM ({grouped('store_id', f"{total('units_sold')} AS total_units_sold, {avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast")}),
        (SELECT COUNT(*) AS n, COUNT(DISTINCT store_id) AS stores FROM fact)""",
    "store_efficiency_daily": f"""SELECT store_id, total_units_sold, avg_inventory, avg_demand_forecast, CAST(total_units_sold AS DOUBLE) / (avg_inventory * days) AS inventory_efficiency
      FROM ({grouped('store_id', f"{total('units_sold')} AS total_units_sold, {avg('inventory_level')} AS avg_inventory, {avg('demand_forecast')} AS avg_demand_forecast")}),
        (SELECT COUNT(DISTINCT date) AS days FROM fact)""",
    "monthly_units": months("", f"{total('units_sold')} AS units_sold, {total('units_ordered')} AS units_ordered"),
    "monthly_sell_through": months("region", f"{total('units_sold')} AS units_sold, {total('units_ordered')} AS units_ordered, {ratio('100 * SUM(units_sold)', 'SUM(units_sold) + SUM(units_ordered)')} AS sell_through_rate"),
    "monthly_region_inventory": months("region", f"{total('units_sold')} AS units_sold, {avg('inventory_level')} AS avg_inventory"),
    "kpi_summary": " UNION ALL ".join(f"SELECT '{n}' AS metric, {v} AS value, {i} AS position FROM fact" for i, (n, v) in enumerate(KPI_ROWS, 1)),
    "movement_metrics": grouped("product_id", f"{MOVEMENT}, {ratio('SUM(units_sold)', 'COUNT(DISTINCT date)')} AS avg_daily_units_sold"),
    "movement_metrics_rows": grouped("product_id", f"{MOVEMENT}, {avg('units_sold')} AS avg_daily_units_sold"),
    "turnover_by_store_product": grouped("store_id, product_id", f"{TURNOVER} AS inventory_turnover_proxy"),
    # windows and segments
    "median_rownumber": "SELECT AVG(CAST(inventory_level AS DOUBLE)) AS median_inventory FROM (SELECT inventory_level, ROW_NUMBER() OVER (ORDER BY inventory_level) AS k, COUNT(*) OVER () AS n FROM fact) WHERE k IN ((n + 1) // 2, (n + 2) // 2)",
    "movement_segments": by_ntile("product_id"),
    "movement_segments_pairs": by_ntile("store_id, product_id"),
    "movement_segments_qcut": by_quantile("product_id"),
    "movement_segments_qcut_pairs": by_quantile("store_id, product_id"),
    "segment_summary": segment_means(by_ntile("product_id")),
    "segment_summary_qcut": segment_means(by_quantile("product_id")),
    "replenishment_watchlist": f"SELECT * FROM ({by_quantile('product_id')}) WHERE movement_segment = 'Fast-moving' ORDER BY low_inventory_risk_rate DESC, product_id LIMIT 5",
    "tied_up_watchlist": f"SELECT * FROM ({by_quantile('product_id')}) WHERE movement_segment = 'Slow-moving' ORDER BY avg_inventory DESC, product_id LIMIT 5",
    "share_of_total": "SELECT region, COUNT(*) AS observations, CAST(100 AS DOUBLE) * COUNT(*) / SUM(COUNT(*)) OVER () AS percentage FROM fact GROUP BY region",
    # pivots
    "pivot_conditional": pivot("store_id", "category", TYPES),
    "pivot_dynamic": pivot("store_id", "category", TYPES),
    "pivot_season_category": pivot("seasonality", "category", TYPES),
    "crosstab_status": "SELECT store_id, " + ", ".join(f"COUNT(*) FILTER (WHERE {SHELF} = '{s}') AS {s.lower().replace(' ', '_')}" for s in ("Out of Stock", "Below Reorder", "Near Reorder", "Adequate Stock")) + " FROM fact GROUP BY store_id",
    # replenishment
    "reorder_recommendation": reorder(GATED),
    "reorder_recommendation_buffered": reorder(UNGATED),
    "reorder_recommendation_as_of": reorder(GATED, "DATE '1995-06-15'"),
    "reorder_actions": ACTIONS,
    "reorder_totals": f"SELECT COUNT(*) AS combinations, CAST(COALESCE(SUM(recommended_order_qty), 0) AS BIGINT) AS total_order_units FROM ({ACTIONS})",
    "reorder_stats": f"""SELECT COUNT(*) AS combinations, COUNT(*) FILTER (WHERE risk_status = 'Understocked') AS understocked,
        COUNT(*) FILTER (WHERE risk_status = 'Balanced') AS balanced, COUNT(*) FILTER (WHERE risk_status = 'High Inventory') AS high_inventory,
        COUNT(*) FILTER (WHERE risk_status = 'Excess Inventory') AS excess_inventory, COUNT(*) FILTER (WHERE reorder_trigger) AS triggered,
        COUNT(*) FILTER (WHERE recommended_order_qty > 0) AS with_order, CAST(COALESCE(SUM(recommended_order_qty), 0) AS BIGINT) AS total_order_units
      FROM ({reorder(UNGATED)})""",
    "trend_reorder_point": trend(),
    "trend_reorder_point_as_of": trend("DATE '1995-06-15'", 365, "2", "1.28"),
    "safety_stock": f"SELECT store_id, product_id, avg_daily_sales * 1::DOUBLE AS lead_time_demand, 1.65::DOUBLE * COALESCE(stddev_daily_sales, 0) * SQRT(1::DOUBLE) AS safety_stock FROM ({sales_stats()})",
    "daily_reorder_check": DAILY,
    "reorder_point_history": reorder_history(),
    "reorder_changes": order_changes(),
    "reorder_changes_between": order_changes("DATE '1996-03-02'", "DATE '1995-11-30'"),
    "reorder_change_totals": "SELECT change, COUNT(*) AS combinations, CAST(SUM(order_qty_change) AS BIGINT) AS units_change "
    f"FROM ({order_changes("DATE '1996-03-02'", all_rows=True)}) GROUP BY change",
    # stored summaries
    "describe_from_sketches": describe(NUMBERS, "fact"),
    "describe_period_from_sketches": describe(NUMBERS, "(SELECT * FROM fact WHERE date >= DATE '1994-03-01' AND date < DATE '1995-11-01')"),
    "distinct_from_sketches": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_values, TRUE AS within_error FROM fact" for c in TEXTS
    ),
    "frequent_values": " UNION ALL ".join(
        f"(SELECT '{c}' AS column_name, {c} AS column_value, COUNT(*) AS observations, "
        f"COUNT(*) > 3.5 * (SELECT COUNT(*) FROM fact) / 8192 AS certain FROM fact GROUP BY {c} ORDER BY observations DESC, {c} LIMIT 20)"
        for c in ("product_id", "category", "store_id", "weather_condition")
    ),
    # every slice, calendar
    "kpi_cube": cube([["store_id"], ["category"], ["product_id"], ["region"]]),
    "kpi_cube_crossed": cube([["store_id", "category"], ["region", "product_id"], ["region"], []]),
    "date_gaps": date_gaps(),
    "date_gaps_by_store": date_gaps("store_id"),
    "date_islands": "SELECT store_id, product_id, MIN(date) AS island_start, MAX(date) AS island_end, COUNT(*) AS days FROM ("
    "SELECT store_id, product_id, date, SUM(CASE WHEN date - before = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY store_id, product_id ORDER BY date) AS run "
    f"FROM ({dated()})) GROUP BY store_id, product_id, run",
    "date_coverage": "SELECT store_id, product_id, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS days_present, "
    "MAX(date) - MIN(date) + 1 - COUNT(*) AS days_missing, CAST(COALESCE(MAX(date - before - 1), 0) AS INT) AS longest_gap "
    f"FROM ({dated()}) GROUP BY store_id, product_id",
    # sorts, limits, reshaping
    "order_by_metric": grouped("region", f"{total('units_sold')} AS total_units_sold, {avg('inventory_level')} AS avg_inventory"),
    "order_by_domain": f"SELECT {tier()} AS inventory_risk, COUNT(*) AS observations FROM fact GROUP BY 1",
    "order_by_categorical": "SELECT seasonality, COUNT(*) AS observations, CASE seasonality WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 WHEN 'Autumn' THEN 3 ELSE 4 END AS season_rank FROM fact GROUP BY seasonality",
    "top_k": f"SELECT * FROM ({overstocked('product_id')}) ORDER BY overstock_pct DESC, product_id LIMIT 20",
    "preview": f"{FACT_ROWS} ORDER BY {KEY} LIMIT 10",
    "distinct": "SELECT DISTINCT category, region FROM fact",
    "wide_to_long": " UNION ALL ".join(
        f"SELECT region, '{n}' AS metric, {avg(c)} AS value FROM fact GROUP BY region" for c, n in (STOCK, SOLD, ORDERED)
    ),
    # streaming
    "stream_reorder_check": DAILY,
    "stream_withdrawals": VERSIONS,
    "stream_account": ACCOUNT,
}


def _fixed(sql, **digits):
    cells = ", ".join(
        f"CAST(ROUND(CAST({c} AS DECIMAL(30,12)), {d}) AS DOUBLE) AS {c}" for c, d in digits.items()
    )
    return f"SELECT * REPLACE ({cells}) FROM ({sql})"


BODIES |= {
    "store_performance_report": _fixed(
        BODIES["store_performance"], avg_inventory=2, avg_demand_forecast=2, inventory_turnover_proxy=3
    ),
    "risk_by_store_report": _fixed(
        BODIES["risk_by_store"], understocked_pct=2, balanced_pct=2, high_inventory_pct=2, excess_inventory_pct=2
    ),
    "segment_summary_report": _fixed(
        segment_means(
            _fixed(by_ntile("product_id"), avg_inventory=2, low_inventory_risk_rate=2)
        ),
        avg_total_units_sold=0, avg_inventory=2, avg_turnover_proxy=3, avg_low_inventory_risk_rate=2,
    ),
    "trend_reorder_report": _fixed(
        BODIES["trend_reorder_point"], avg_daily_sales_90d=2, stddev_daily_sales_90d=2, lead_time_demand=1,
        safety_stock=1, reorder_point_trend_based=0,
    ),
}


# Sort keys of the reports whose order is part of the answer; they are unique.
ORDERS = {
    "missing_report": "missing_count DESC, column_name",
    "duplicate_keys": f"duplicate_count DESC, {KEY}",
    **{f"value_counts_{c}": f"observations DESC, {c}" for c in TEXTS},
    "distinct_values": "discount",
    "describe_numeric": "column_name", "numeric_summary": "column_name", "iqr_outliers": "column_name",
    "describe_strings": "column_name", "negative_forecast_described": "column_name",
    "negative_forecast_by": "negative_forecast_rows DESC, category",
    "negative_forecast_by_season": "negative_forecast_rows DESC, seasonality",
    "negative_forecast_by_promotion": "negative_forecast_rows DESC, holiday_promotion",
    "quality_summary": "position", "quality_summary_clean": "position", "kpi_summary": "position",
    "negative_forecast_preview": f"{KEY}, demand_forecast, inventory_level, units_ordered",
    "peek_dates": "date", "preview": KEY,
    "describe_from_sketches": "column_name", "describe_period_from_sketches": "column_name",
    "frequent_values": "column_name, observations DESC, column_value",
    "reorder_changes": CHANGE_ORDER, "reorder_changes_between": CHANGE_ORDER, "reorder_change_totals": CHANGE_RANK,
    "kpi_cube": "slice, total_units_sold DESC, store_id NULLS FIRST, category NULLS FIRST, product_id NULLS FIRST, region NULLS FIRST",
    "kpi_cube_crossed": "slice, total_units_sold DESC, store_id NULLS FIRST, category NULLS FIRST, region NULLS FIRST, product_id NULLS FIRST",
    "date_gaps": "missing_days DESC, store_id, product_id, gap_start", "date_gaps_by_store": "missing_days DESC, store_id, gap_start",
    "date_islands": "days DESC, store_id, product_id, island_start", "date_coverage": "days_missing DESC, store_id, product_id",
    "store_performance": "total_units_sold DESC, store_id", "product_performance": "total_units_sold DESC, product_id",
    "category_performance": "total_units_sold DESC, category", "store_efficiency_daily": "store_id",
    "store_order_efficiency": "order_to_sales_ratio DESC, store_id",
    "excess_by_product": "overstock_pct DESC, product_id", "overstock_by_category": "overstock_pct DESC, category",
    "understocked_segments": "understocked_observations DESC, store_id, category",
    "excess_segments": "excess_inventory_observations DESC, store_id, category",
    "risk_distribution": "risk_rank", "risk_distribution_all": "risk_rank",
    **{f"risk_by_{c}": f"understocked_pct DESC, {k}" for c, k in
       [("store", "store_id"), ("category", "category"), ("product", "product_id"), ("region", "region")]},
    "drivers_season": "avg_units_sold DESC, seasonality", "drivers_weather": "avg_units_sold DESC, weather_condition",
    "drivers_weather_all_rows": "avg_units_sold DESC, weather_condition",
    "drivers_discount": "discount", "drivers_promotion": "holiday_promotion",
    "monthly_units": "month", "monthly_sell_through": "month, region", "monthly_region_inventory": "month, region",
    "movement_metrics": "total_units_sold DESC, product_id", "movement_metrics_rows": "total_units_sold DESC, product_id",
    "movement_segments": "inventory_turnover_proxy DESC, product_id",
    "movement_segments_qcut": "inventory_turnover_proxy DESC, product_id",
    "segment_summary": "movement_segment = 'Slow-moving', movement_segment = 'Medium-moving'",
    "replenishment_watchlist": "low_inventory_risk_rate DESC, product_id",
    "tied_up_watchlist": "avg_inventory DESC, product_id",
    "pivot_conditional": "store_id", "pivot_dynamic": "store_id", "crosstab_status": "store_id",
    "reorder_recommendation": "recommended_order_qty DESC, store_id, product_id",
    "reorder_recommendation_buffered": "recommended_order_qty DESC, store_id, product_id",
    "reorder_actions": "recommended_order_qty DESC, store_id, product_id",
    "order_by_metric": "total_units_sold DESC, region", "order_by_categorical": "season_rank",
    "top_k": "overstock_pct DESC, product_id", "overstock_by_product": "overstock_pct DESC, product_id",
}


def oracle_sql():
    bodies = {
        name: f"SELECT * FROM ({body}) ORDER BY {ORDERS[name]}" if name in ORDERS else body
        for name, body in BODIES.items()
    }
    return {name: f"{INPUT}{body}" for name, body in bodies.items()}
