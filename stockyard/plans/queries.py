"""Every named query: key -> function from a loaded ``Inventory`` to a DataFrame."""

from pyspark.sql import functions as F

from stockyard import params as P
from stockyard import schema as S
from stockyard.functions import classify as C
from stockyard.functions import measures as M
from stockyard.functions.present import report_view
from stockyard.operators import cleaning, gaps, kpi, movement, quality, replenishment, reshape, star
from stockyard.operators import ordering, sketches, snapshot
from stockyard.plans import jobs
from stockyard.session import work_path
from stockyard.sources import files, tables
from stockyard.streaming import reorder_stream

KEYS = S.KEYS
_queries = {}


def query(name=None):
    def register(function):
        _queries[name or function.__name__] = function
        return function

    return register


def catalog():
    return dict(_queries)


def _flat(inv):
    return inv.fact.select(*S.FACT_COLUMNS)


def _round9(df, *columns):
    """Interpolated and square-root values to 9 places: engines differ in the last bit."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


# Means of ratios depend on the order of addition in the last bits.
MEANS = {"mape": 6, "avg_inventory_coverage": 6}


def _settled(df, digits=MEANS):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


def _holes(df):
    """Staging rows with some values missing."""
    return df.withColumns({
        "discount": F.nullif(F.col("discount"), F.lit(5)),
        "competitor_pricing": F.when(F.col("units_sold") != 0, F.col("competitor_pricing")),
        "category": F.nullif(F.col("category"), F.lit("PROMO")),
    })


def _segment_means(df):
    return _settled(df, {"avg_inventory": 6, "avg_turnover_proxy": 9, "avg_low_inventory_risk_rate": 6})


def _keyed(df, *columns):
    return df.select(*KEYS, *columns)


# --- sources and sinks ------------------------------------------------------


@query()
def read_csv(inv):
    spark = inv.raw.sparkSession
    path = files.write_csv(inv.raw, work_path(spark, "csv"))
    return files.read_csv(spark, path)


@query()
def read_csv_dates(inv):
    spark = inv.raw.sparkSession
    path = files.write_csv(_flat(inv), work_path(spark, "csv"))
    return cleaning.parse_dates(files.read_csv(spark, path, text_dates=True))


@query()
def bulk_load_staging(inv):
    # Lines of rows without sales get a date that the parser refuses.
    spark = inv.raw.sparkSession
    date = F.when(F.col("units_sold") == 0, "no date").otherwise(F.col("date").cast("string"))
    path = files.write_csv(inv.raw.withColumn("date", date), work_path(spark, "csv"), titled=False)
    staged = files.bulk_load(spark, path)
    return staged.withColumn("refused", F.col(files.CORRUPT).isNotNull()).drop(files.CORRUPT)


@query()
def table_query(inv):
    text = (
        "SELECT region, seasonality, COUNT(*) AS observations, SUM(units_sold) AS units_sold "
        "FROM {fact} WHERE units_sold > 0 GROUP BY region, seasonality"
    )
    return tables.table_query(inv.fact.sparkSession, text, fact=inv.fact)


@query()
def write_csv(inv):
    spark = inv.raw.sparkSession
    path = files.write_csv(_flat(inv), work_path(spark, "csv"))
    return files.read_csv(spark, path)


@query()
def load_fact(inv):
    spark = inv.raw.sparkSession
    table = tables.create_tables(spark, [tables.FACT_TABLE], prefix="loaded_")[tables.FACT_TABLE]
    tables.load_fact(inv.fact, table, expected_rows=inv.fact.count())
    return spark.table(table).select(*S.FACT_COLUMNS)


@query()
def insert_select(inv):
    return jobs.store_star(_flat(inv), "star_", anew=True)["inventory_sales_normalized"].select(*S.NORMALIZED_COLUMNS)


@query()
def insert_values(inv):
    spark = inv.raw.sparkSession
    table = tables.create_tables(spark, ["promotions"], prefix="values_")["promotions"]
    tables.insert_values(spark, S.PROMOTIONS, table)
    used = inv.fact.groupBy("holiday_promotion").agg(M.rows().alias("observations"))
    return (
        spark.table(table)
        .join(used, F.col("promotion_id") == F.col("holiday_promotion"), "left")
        .select("promotion_id", "is_holiday_promotion", "description", "observations")
    )


@query()
def create_tables(inv):
    stored = jobs.store_star(_flat(inv), "typed_", anew=True)
    counts = star.row_counts(stored)
    widths = F.create_map(*[
        x for n, f in stored.items() for x in (F.lit(n), F.lit(len([c for c in f.columns if c not in S.GRAINS])))
    ])
    return counts.withColumn("column_count", widths[F.col("table_name")])


@query()
def check_input_shape(inv):
    keys = inv.raw.select(*KEYS).distinct().agg(M.rows()).scalar()
    return tables.shape_report(_flat(inv), keys, 15)


# --- scalar derivations -----------------------------------------------------


@query()
def parse_date_strict(inv):
    text = _keyed(cleaning.format_dates(inv.fact), "inventory_level")
    return cleaning.parse_dates(text)


@query()
def parse_date_coerce(inv):
    # Rows without sales get a date that cannot be parsed.
    text = F.when(F.col("units_sold") == 0, "not a date").otherwise(F.col("date").cast("string"))
    return cleaning.invalid_date_count(inv.fact.select(text.alias("date")))


@query()
def clip_negative_forecast(inv):
    return _keyed(cleaning.clip_negative_forecast(inv.raw), "inventory_level", "demand_forecast")


@query()
def clip_report(inv):
    return cleaning.clip_report(inv.raw)


@query()
def format_date(inv):
    return _keyed(cleaning.format_dates(inv.fact))


@query()
def time_features(inv):
    return _keyed(
        cleaning.with_time_features(inv.fact), "year", "month", "month_name", "day_of_week", "week"
    )


@query()
def forecast_error_columns(inv):
    scored = cleaning.with_forecast_error(inv.fact)
    return _keyed(
        scored,
        F.col("forecast_error").cast("decimal(12,2)"),
        F.col("absolute_forecast_error").cast("decimal(12,2)"),
        "forecast_error_pct",
    )


@query()
def valid_forecast_split(inv):
    return cleaning.valid_forecast_counts(inv.raw)


@query()
def valid_forecast_rows(inv):
    return _keyed(cleaning.valid_forecasts(inv.raw), "units_sold", "demand_forecast")


@query()
def risk_tier(inv):
    return _keyed(kpi.with_risk(inv.fact), "inventory_risk")


@query()
def risk_tier_ratio(inv):
    return _keyed(kpi.with_risk(inv.fact.filter("demand_forecast > 0")), "inventory_risk")


@query()
def risk_tier_narrow(inv):
    return _keyed(kpi.with_risk(inv.fact, P.NARROW_CUTS), "inventory_risk")


@query()
def overstock_flag(inv):
    return _keyed(inv.fact, C.overstocked().alias("overstock_risk"))


@query()
def balanced_band(inv):
    return inv.fact.agg(
        M.rows().alias("observations"), M.percent(C.in_balanced_band()).alias("balanced_pct")
    )


@query()
def inventory_status(inv):
    return _keyed(inv.fact, C.shelf_status().alias("inventory_status"))


@query()
def stock_status_trend(inv):
    return replenishment.trend_reorder_point(inv.fact).select("store_id", "product_id", "stock_status")


@query()
def reorder_trigger(inv):
    return _keyed(inv.fact, C.reorder_trigger().alias("reorder_trigger"))


@query()
def recommended_qty(inv):
    return _keyed(inv.fact, C.order_quantity().alias("recommended_order_qty"))


@query()
def recommended_qty_ungated(inv):
    quantity = C.order_quantity(gated=False, rounding="half_even")
    return _keyed(inv.fact, quantity.alias("recommended_order_qty"))


@query()
def predicates(inv):
    fact = inv.fact
    return fact.agg(
        F.count_if(F.col("demand_forecast") > 0).alias("positive_forecast"),
        F.count_if(F.col("demand_forecast") >= 0).alias("valid_forecast"),
        F.count_if(F.col("category").isNotNull()).alias("with_category"),
        F.count_if(F.col("discount").isin(0, 5, 10)).alias("round_discount"),
        F.count_if(F.col("inventory_level").between(100, 200)).alias("mid_inventory"),
        F.count_if(F.col("date") == fact.agg(F.max("date")).scalar()).alias("on_latest_date"),
        F.count_if((F.col("units_sold") > 0) & (F.col("demand_forecast") >= 0)).alias("scored"),
    )


@query()
def filter_by_selection(inv):
    chosen = reshape.select_where(inv.fact, category="PROMO", product_id="All")
    return _keyed(kpi.with_risk(chosen), "category", "inventory_risk")


@query()
def product_view(inv):
    view = movement.segments(inv.fact, method="quantile")
    return reshape.select_where(view, product_id="All").drop("low_inventory_risk_rate")


@query("distinct_values")
def distinct_values_(inv):
    return quality.distinct_values(inv.fact, "discount")


@query()
def distinct_promotions(inv):
    return quality.distinct_values(inv.fact, "holiday_promotion")


@query()
def label_concat(inv):
    actions = replenishment.daily_reorder(inv.fact)
    return reshape.with_label(actions).select("date", "label", "recommended_order_qty")


@query()
def min_max_scale(inv):
    return movement.bubble_sizes(inv.fact)


@query()
def sample_n(inv):
    sample = reshape.sample_rows(kpi.with_risk(inv.fact))
    return _keyed(sample, "demand_forecast", "inventory_level", "inventory_risk")


@query()
def max_of_columns(inv):
    return reshape.max_of_columns(reshape.sample_rows(inv.fact))


@query()
def select_columns(inv):
    return inv.fact.select(*KEYS, "category", "inventory_level", "units_sold", "demand_forecast")


# --- joins and subqueries ---------------------------------------------------


@query()
def equi_join_2key(inv):
    return replenishment.latest_with_stats(inv.fact)


@query()
def latest_snapshot(inv):
    return snapshot.latest_snapshot(inv.fact).select(*S.FACT_COLUMNS)


@query()
def trailing_window_filter(inv):
    return snapshot.trailing_window(inv.fact).select(*S.FACT_COLUMNS)


@query()
def scalar_subquery_projection(inv):
    valid = inv.fact.filter("demand_forecast > 0")
    total = valid.agg(M.rows()).scalar()
    return (
        kpi.with_risk(valid)
        .groupBy("inventory_risk")
        .agg(M.rows().alias("observations"))
        .withColumn("percentage", F.try_divide(F.lit(100.0) * F.col("observations"), total))
    )


@query()
def normalize_fact(inv):
    return star.normalize(_flat(inv), star.build_dimensions(inv.fact))


def _dimension_rows(dimensions):
    parts = [
        dimensions[t].select(
            F.lit(t).alias("table_name"), F.lit(None).cast("int").alias("id"), F.col(k).alias("name")
        )
        for t, k in S.ENTITIES.items()
    ] + [
        dimensions[t].select(F.lit(t).alias("table_name"), F.col(k).alias("id"), F.col(n).alias("name"))
        for t, (_, k, n) in S.LOOKUPS.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


@query()
def build_dimensions(inv):
    return _dimension_rows(star.build_dimensions(inv.fact))


@query()
def dimension_merge(inv):
    # A first load that lacks names which sort before the ones it has, then all rows.
    first = star.build_dimensions(inv.fact.filter("category >= 'LARGE' AND region > 'AMERICA' AND store_id > 'S005'"))
    return _dimension_rows(star.merge_dimensions(inv.fact, first))


@query()
def denormalize_fact(inv):
    dimensions = star.build_dimensions(inv.fact)
    return star.denormalize(star.normalize(_flat(inv), dimensions), dimensions)


@query()
def aligned_assign(inv):
    return M.summarize(
        inv.fact, ["product_id"], ["total_units_sold", "avg_inventory", "low_inventory_risk_rate"]
    )


@query()
def fk_check(inv):
    # All staging rows against dimensions that lack one category and the newest products.
    known = inv.raw.filter("category <> 'PROMO' AND product_id < 'P0050'")
    return star.staging_check(inv.raw, star.build_dimensions(known))


@query()
def reindex_to_domain(inv):
    status = inv.fact.select(C.shelf_status().alias("inventory_status"))
    counts = status.groupBy("inventory_status").agg(M.rows().alias("observations"))
    return reshape.reindex(counts, "inventory_status", P.SHELF_STATUSES, fill=0)


@query()
def load_reconciliation(inv):
    dimensions = star.build_dimensions(inv.raw)
    return star.load_reconciliation(inv.raw, star.normalize(inv.raw, dimensions))


# --- validation and profiling -----------------------------------------------


@query()
def row_count(inv):
    return quality.row_count(inv.raw)


@query()
def date_span(inv):
    return quality.date_span(inv.raw)


@query()
def cardinality(inv):
    return quality.cardinality(inv.raw)


@query()
def null_counts(inv):
    return quality.null_counts(_holes(inv.raw))


@query()
def missing_report(inv):
    return quality.missing_report(_holes(inv.raw))


@query()
def duplicate_keys(inv):
    return quality.duplicate_keys(inv.raw)


@query()
def duplicate_key_rows(inv):
    return quality.duplicate_key_rows(inv.raw)


@query()
def duplicate_rows(inv):
    return quality.duplicate_rows(inv.raw)


@query()
def negative_counts(inv):
    return quality.negative_counts(inv.raw)


@query()
def zero_counts(inv):
    return quality.zero_counts(inv.raw)


@query()
def value_counts(inv):
    return quality.value_counts_all(inv.raw, S.STRING_COLUMNS)


for _column in S.STRING_COLUMNS:
    query(f"value_counts_{_column}")(lambda inv, c=_column: quality.value_counts(inv.fact, c))


@query()
def select_dtypes(inv):
    return quality.column_types(inv.raw)


@query()
def describe_numeric(inv):
    return _round9(quality.describe_numeric(_holes(inv.raw)), "std", "p25", "p50", "p75")


@query()
def describe_strings(inv):
    return quality.describe_strings(_holes(inv.raw))


@query()
def numeric_summary(inv):
    return _round9(quality.numeric_summary(_holes(inv.raw)), "median")


@query()
def iqr_outliers(inv):
    return _round9(quality.iqr_outliers(_holes(inv.raw)), "q1", "q3", "lower_bound", "upper_bound")


@query()
def descriptive_stats(inv):
    return quality.descriptive_stats(inv.fact)


@query()
def negative_forecast_diag(inv):
    return quality.negative_forecast_diagnostics(inv.raw)


@query()
def negative_forecast_by(inv):
    return quality.negative_forecast_by(inv.raw, "category")


@query()
def negative_forecast_by_season(inv):
    return quality.negative_forecast_by(inv.raw, "seasonality")


@query()
def negative_forecast_by_promotion(inv):
    return quality.negative_forecast_by(inv.raw, "holiday_promotion")


@query()
def negative_forecast_described(inv):
    return _round9(quality.negative_forecast_described(inv.raw), "std", "p25", "p50", "p75")


@query()
def negative_forecast_preview(inv):
    below = inv.raw.filter("demand_forecast < 0")
    return ordering.top_k(
        below.select(*KEYS, "category", "inventory_level", "units_sold", "units_ordered", "demand_forecast"),
        [*KEYS, "demand_forecast", "inventory_level", "units_ordered"],
        20,
    )


@query()
def quality_summary(inv):
    return quality.quality_summary(inv.raw)


@query()
def quality_summary_clean(inv):
    return quality.quality_summary(inv.fact)


@query()
def functional_dependency(inv):
    return quality.functional_dependencies(inv.fact)


@query()
def peek_dates(inv):
    return quality.peek_dates(inv.fact)


# --- KPIs, risk, accuracy, drivers ------------------------------------------

_REPORTS = {
    "network_kpis": lambda f: kpi.network_kpis(f),
    "inventory_to_sales": lambda f: kpi.inventory_to_sales(f),
    "turnover_proxy": lambda f: kpi.turnover_proxy(f),
    "store_performance": lambda f: kpi.performance(f, ["store_id"]),
    "store_order_efficiency": lambda f: kpi.order_efficiency(f),
    "category_performance": lambda f: kpi.performance(f, ["category"]),
    "product_performance": lambda f: kpi.performance(f, ["product_id"]),
    "inventory_coverage": lambda f: kpi.inventory_coverage(f),
    "risk_distribution": lambda f: kpi.risk_distribution(f),
    "risk_distribution_all": lambda f: kpi.risk_distribution(  # one tier has no rows
        f.filter("inventory_level <= 2 * demand_forecast"), valid_only=False, all_tiers=True
    ),
    "risk_by_store": lambda f: kpi.risk_by(f, ["store_id"]),
    "risk_by_category": lambda f: kpi.risk_by(f, ["category"]),
    "risk_by_product": lambda f: kpi.risk_by(
        f, ["product_id"], extra=["avg_inventory", "avg_demand_forecast"]
    ),
    "risk_by_region": lambda f: kpi.risk_by(f, ["region"]),
    "store_region_summary": lambda f: kpi.store_region_summary(f, ["store_id"]),
    "region_summary": lambda f: kpi.store_region_summary(f, ["region"]),
    "store_risk_composition": lambda f: kpi.risk_composition(f),
    "overview_kpis": lambda f: kpi.overview_kpis(f),
    "forecast_accuracy": lambda f: kpi.forecast_accuracy(f),
    "forecast_accuracy_all_rows": lambda f: kpi.forecast_accuracy(f, selling_rows_only=False),
    "accuracy_by_store": lambda f: kpi.forecast_accuracy(f, ["store_id"]),
    "accuracy_by_store_all_rows": lambda f: kpi.forecast_accuracy(
        f, ["store_id"], selling_rows_only=False, worst_first=False
    ),
    "accuracy_by_category": lambda f: kpi.forecast_accuracy(f, ["category"]),
    "accuracy_by_category_all_rows": lambda f: kpi.forecast_accuracy(
        f, ["category"], selling_rows_only=False, worst_first=False
    ),
    "accuracy_by_store_category": lambda f: kpi.forecast_accuracy(f, ["store_id", "category"]),
    "accuracy_by_risk": lambda f: kpi.accuracy_by_risk(f),
    "accuracy_by_risk_narrow": lambda f: reshape.reindex(
        kpi.accuracy_by_risk(f, P.NARROW_CUTS, selling_rows_only=False),
        "inventory_risk",
        P.RISK_TIERS,
    ),
    "understocked_segments": lambda f: kpi.understocked_segments(f),
    "excess_segments": lambda f: kpi.excess_segments(f),
    "drivers_discount": lambda f: kpi.drivers(f, "discount"),
    "drivers_promotion": lambda f: kpi.drivers(f, "holiday_promotion"),
    "drivers_season": lambda f: kpi.drivers(f, "seasonality"),
    "drivers_weather": lambda f: kpi.drivers(f, "weather_condition"),
    "drivers_weather_all_rows": lambda f: kpi.drivers(
        f.withColumn("demand_forecast", F.when(F.col("discount") > 0, F.col("demand_forecast"))),
        "weather_condition", valid_only=False,
    ),
    "overstock_by_product": lambda f: kpi.overstock(f, ["product_id"]),
    "overstock_by_category": lambda f: kpi.overstock(f, ["category"]),
    "excess_by_product": lambda f: kpi.excess_by(f, ["product_id"]),
    "store_efficiency": lambda f: kpi.store_efficiency(f),
    "store_efficiency_daily": lambda f: kpi.store_efficiency_daily(f),
    "monthly_units": lambda f: kpi.monthly(f),
    "monthly_sell_through": lambda f: kpi.monthly_sell_through(f),
    "monthly_region_inventory": lambda f: kpi.monthly_region_inventory(f),
    "kpi_summary": lambda f: kpi.kpi_summary(f).withColumn(
        "value", F.when(F.col("metric") == "Forecast MAPE", F.round("value", 6)).otherwise(F.col("value"))
    ),
    "movement_metrics": lambda f: movement.movement_metrics(f),
    "movement_metrics_rows": lambda f: movement.movement_metrics(f, daily="rows"),
    "turnover_by_store_product": lambda f: kpi.turnover_proxy(f, ["store_id", "product_id"]),
    # windows and segments
    "median_rownumber": lambda f: quality.median(f, "inventory_level", "median_inventory"),
    "movement_segments": lambda f: movement.segment_table(f),
    "movement_segments_qcut": lambda f: movement.segment_table(f, method="quantile"),
    "movement_segments_qcut_pairs": lambda f: movement.segment_table(
        f, ["store_id", "product_id"], "quantile"
    ),
    "movement_segments_pairs": lambda f: movement.segment_table(f, ["store_id", "product_id"]),
    "segment_summary": lambda f: _segment_means(movement.segment_summary(movement.segments(f))),
    "segment_summary_qcut": lambda f: _segment_means(
        movement.segment_summary(movement.segments(f, method="quantile"))
    ),
    "replenishment_watchlist": lambda f: movement.watchlist(
        movement.segments(f, method="quantile"), "replenish"
    ),
    "tied_up_watchlist": lambda f: movement.watchlist(
        movement.segments(f, method="quantile"), "tied_up"
    ),
    # pivots
    "pivot_conditional": lambda f: reshape.pivot_mean(
        f, "store_id", "category", columns=["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    ),
    "pivot_dynamic": lambda f: reshape.pivot_mean(
        f, "store_id", "category", columns=f.select("category").distinct()
    ),
    "pivot_season_category": lambda f: reshape.pivot_season_category(f, f.select("category").distinct()),
    "crosstab_status": lambda f: reshape.crosstab_status(f),
    # replenishment
    "reorder_recommendation": lambda f: replenishment.reorder(f),
    "reorder_recommendation_buffered": lambda f: replenishment.reorder(
        f, gated=False, rounding="half_even"
    ),
    "reorder_recommendation_as_of": lambda f: replenishment.reorder(f, as_of="1995-06-15"),
    "reorder_actions": lambda f: replenishment.reorder_actions(f),
    "reorder_totals": lambda f: replenishment.reorder_totals(f),
    "reorder_stats": lambda f: replenishment.reorder_stats(f),
    "trend_reorder_point": lambda f: replenishment.trend_reorder_point(f),
    "trend_reorder_point_as_of": lambda f: replenishment.trend_reorder_point(
        f, as_of="1995-06-15", days=365, lead_time=2, z=1.28
    ),
    "daily_reorder_check": lambda f: replenishment.daily_reorder(f),
}
for _name, _report in _REPORTS.items():
    query(_name)(lambda inv, r=_report: _settled(r(inv.fact)))


@query()
def share_of_total(inv):
    counts = inv.fact.groupBy("region").agg(M.rows().alias("observations"))
    return quality.share_of_total(counts)


@query()
def safety_stock(inv):
    stats = replenishment.recent_sales_stats(inv.fact)
    return stats.select(
        "store_id",
        "product_id",
        replenishment.lead_time_demand().alias("lead_time_demand"),
        replenishment.safety_stock().alias("safety_stock"),
    )


# --- the same numbers as printed reports: fixed decimals --------------------


@query()
def store_performance_report(inv):
    return report_view(kpi.performance(inv.fact, ["store_id"]))


@query()
def risk_by_store_report(inv):
    return report_view(kpi.risk_by(inv.fact, ["store_id"]))


@query()
def segment_summary_report(inv):
    return report_view(_segment_means(movement.segment_summary(movement.segments(inv.fact), digits=2)))


@query()
def trend_reorder_report(inv):
    return report_view(replenishment.trend_reorder_point(inv.fact))


@query()
def reorder_point_history(inv):
    return replenishment.reorder_point_history(inv.fact)


@query()
def reorder_changes(inv):
    return replenishment.reorder_changes(inv.fact)


@query()
def reorder_changes_between(inv):
    return replenishment.reorder_changes(inv.fact, as_of="1996-03-02", since="1995-11-30")


@query()
def reorder_change_totals(inv):
    return replenishment.reorder_change_totals(inv.fact, as_of="1996-03-02")


# --- every slice, calendar --------------------------------------------------


@query()
def kpi_cube(inv):
    return kpi.cube(inv.fact)


@query()
def kpi_cube_crossed(inv):
    return kpi.cube(inv.fact, [("store_id", "category"), ("region", "product_id"), ("region",), ()])


@query()
def date_gaps(inv):
    return gaps.date_gaps(inv.fact)


@query()
def date_gaps_by_store(inv):
    return gaps.date_gaps(inv.fact, ["store_id"])


@query()
def date_islands(inv):
    return gaps.date_islands(inv.fact)


@query()
def date_coverage(inv):
    return gaps.date_coverage(inv.fact)


# --- stored summaries -------------------------------------------------------


def _summaries(inv):
    spark = inv.raw.sparkSession
    return sketches.read(spark, sketches.store(inv.fact, work_path(spark, "summaries")))


@query()
def describe_from_sketches(inv):
    return _round9(sketches.describe(inv.fact, _summaries(inv)), "std", "p25", "p50", "p75")


@query()
def describe_period_from_sketches(inv):
    span = ("1994-03-01", "1995-10-01")
    rows = sketches.of_periods(inv.fact, *span)
    return _round9(sketches.describe(rows, sketches.within(_summaries(inv), *span)), "std", "p25", "p50", "p75")


@query()
def distinct_from_sketches(inv):
    # The estimates beside the exact counts, and whether they are as near as four standard errors.
    exact = quality.to_long(quality.cardinality(inv.fact, {c: c for c in S.STRING_COLUMNS}), S.STRING_COLUMNS, "column_name", "distinct_values")
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_values")) <= F.ceil(
        F.lit(4 * sketches.HLL_ERROR) * F.col("distinct_values")
    )
    return sketches.distinct_estimates(_summaries(inv)).join(exact, "column_name").select(
        "column_name", "distinct_values", near.alias("within_error")
    )


@query()
def frequent_values(inv):
    return sketches.frequent_values(inv.fact, ["product_id", "category", "store_id", "weather_condition"])


# --- sorts, limits, reshaping -----------------------------------------------


@query()
def order_by_metric(inv):
    return kpi.report(
        inv.fact, ["region"], ["total_units_sold", "avg_inventory"], order=[("total_units_sold", "desc")]
    )


@query()
def order_by_domain(inv):
    counts = kpi.with_risk(inv.fact).groupBy("inventory_risk").agg(M.rows().alias("observations"))
    return counts.orderBy(C.rank_in("inventory_risk", P.RISK_TIERS))


@query()
def order_by_categorical(inv):
    counts = inv.fact.groupBy("seasonality").agg(M.rows().alias("observations"))
    rank = C.rank_in("seasonality", P.SEASONS)
    return counts.withColumn("season_rank", rank).orderBy("season_rank")


@query()
def top_k(inv):
    return kpi.overstock(inv.fact, ["product_id"]).limit(20)


@query()
def preview(inv):
    return reshape.preview(_flat(inv), 10)


@query()
def distinct(inv):
    return inv.fact.select("category", "region").distinct()


@query()
def wide_to_long(inv):
    totals = M.summarize(
        inv.fact, ["region"], ["avg_inventory", "avg_units_sold", "avg_units_ordered"]
    )
    return quality.to_long(
        totals, ["avg_inventory", "avg_units_sold", "avg_units_ordered"], "metric", "value"
    )


# --- streaming --------------------------------------------------------------


def _stream(spark, arrivals, **options):
    """Run the stream once for each frame that arrives; returns its output and its last runs."""
    arrived, output, state = (work_path(spark, f"stream_{x}") for x in ("arrived", "orders", "state"))
    runs = []
    for rows in arrivals:
        rows.write.option("maxRecordsPerFile", 1_000_000).mode("append").parquet(arrived)
        runs.append(reorder_stream.run(reorder_stream.read_fact_stream(spark, arrived), output, state, **options))
    return output, runs


@query()
def stream_reorder_check(inv):
    spark = inv.raw.sparkSession
    output, _ = _stream(spark, [_flat(inv)])
    return reorder_stream.read_orders(spark, output)


# What arrives first, and how far behind the newest of its dates a row may come.
FIRST_STORES = "store_id < 'S013'"
LATENESS = "30 days"


@query()
def stream_withdrawals(inv):
    # Then all rows come with more stock: old dates are late, the others may withdraw an order.
    spark, rows = inv.raw.sparkSession, _flat(inv)
    more = rows.withColumn("inventory_level", F.col("inventory_level") + 60)
    output, _ = _stream(spark, [rows.filter(FIRST_STORES), more], watermark=LATENESS)
    shown = reorder_stream.read_orders(spark, output).withColumn("withdrawn", F.lit(False))
    return shown.unionByName(
        reorder_stream.read_orders(spark, output, withdrawn=True).withColumn("withdrawn", F.lit(True))
    )


@query()
def stream_account(inv):
    spark = inv.raw.sparkSession
    _, runs = _stream(spark, [inv.raw.filter(FIRST_STORES), inv.raw], watermark=LATENESS)
    result = None
    for number, run in enumerate(runs):
        rows = reorder_stream.account(spark, run).select(
            F.lit(number).alias("arrival"), "arrived", "kept", "late", "repeated"
        )
        result = rows if result is None else result.unionAll(rows)
    return result
