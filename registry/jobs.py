"""One callable (spark, folder) -> DataFrame per registered query.

Doubles whose last digits depend on the order of summation (z-scores, plain
averages of them) are rounded here, the library itself does not round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.columns import RfmColumns
from clientele.functions import scoring
from clientele.functions.numbers import count_text, money_text
from clientele.operators import cleaning, cluster, dashboard, joins, recommend, rfm, sampling, services, visits
from clientele.plans import prepare, recommender
from clientele.plans import rfm as rfm_plan
from clientele.session import new_path, stage
from clientele.sources import exports, tables
from registry.views import BLOCKED, Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR = 1997
THRESHOLD = 0.75
ONE_CLIENT = "100"

# Centroids in standardised space for the assignment that SQL can check too.
GIVEN = cluster.Clustering(
    centroids=[[1.1, -0.8, -0.9], [-0.8, 0.9, 0.9], [0.7, 0.6, 0.5], [-0.4, -0.6, -0.5]],
    names=cluster.FIXED_NAMES,
)


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    # + 0.0 turns a rounded -0.0 into 0.0
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in cols})


# --- sources, cleaning -------------------------------------------------------


def _tickets(v: Views) -> DataFrame:
    return cleaning.with_integer_ids(cleaning.clean_tickets(v.tickets_raw(), BLOCKED))


def _dated_lines(v: Views) -> DataFrame:
    return cleaning.with_line_dates(cleaning.with_integer_ids(v.lines_raw()))


@query
def csv_latin1_roundtrip(v: Views) -> DataFrame:
    path = new_path(v.spark, "clients.csv")
    text = v.table("customer").select(
        F.col("c_custkey").cast("string").alias("ClientID"),
        F.concat(F.lit("Zoë ÀÿÖ "), "c_name").alias("FirstName"),
        F.col("c_acctbal").alias("Balance"),
    )
    # the file has its columns in another order, and one more
    exports.write_csv(text.select("Balance", F.lit("x").alias("Extra"), "FirstName", "ClientID"), path, encoding="ISO-8859-1")
    return tables.read_csv(v.spark, path, "ClientID string, FirstName string, Balance double")


@query
def csv_folder_by_header(v: Views) -> DataFrame:
    """A folder of two exports whose columns come in different orders, one with a column more."""
    path = new_path(v.spark, "clients")
    text = v.table("customer").select(F.col("c_custkey").cast("string").alias("ClientID"), F.col("c_name").alias("FirstName"), F.col("c_acctbal").alias("Balance"))
    even = F.col("ClientID").cast("bigint") % 2 == 0
    exports.write_csv(text.filter(even), f"{path}/even")
    exports.write_csv(text.filter(~even).select("Balance", F.lit("x").alias("Extra"), "ClientID", "FirstName"), f"{path}/odd")
    return tables.read_csv(v.spark, path, "ClientID string, FirstName string, Balance double")


@query
def clean_tickets(v: Views) -> DataFrame:
    return cleaning.clean_tickets(v.tickets_raw(), BLOCKED)


@query
def clean_clients(v: Views) -> DataFrame:
    return cleaning.clean_clients(v.clients_raw(), BLOCKED)


@query
def clean_ticket_status(v: Views) -> DataFrame:
    return cleaning.without_closed(v.tickets_raw())


@query
def clean_ticket_ids(v: Views) -> DataFrame:
    return cleaning.with_integer_ids(v.tickets_raw()).select("TicketID", "ClientID")


@query
def parse_bill_datetime(v: Views) -> DataFrame:
    return cleaning.with_line_dates(v.lines_raw()).select("TicketID", "Descr", "Bill_Date", "Bill_Time")


@query
def clean_sex(v: Views) -> DataFrame:
    return cleaning.with_clean_sex(v.clients_raw()).select("ClientID", "Sex")


@query
def available_years(v: Views) -> DataFrame:
    return cleaning.available_years(_tickets(v))


# --- joins and client features -----------------------------------------------


@query
def lines_left_tickets(v: Views) -> DataFrame:
    tickets = cleaning.with_integer_ids(v.tickets_raw()).select("TicketID", "ClientID", "Total")
    lines = v.lines().select("TicketID", "Type", "Descr", "Total")
    return joins.lines_with_tickets(lines, tickets)


@query
def lines_left_tickets_null_safe(v: Views) -> DataFrame:
    """Lines of ticket 0, which the raw tickets call 'Closed', have no id here either."""
    tickets = cleaning.with_integer_ids(v.tickets_raw()).select("TicketID", "ClientID", "Total")
    lines = v.lines().select(
        F.when(F.col("TicketID") != 0, F.col("TicketID")).alias("TicketID"), "Type", "Descr", "Total"
    )
    return joins.lines_with_tickets(lines, tickets, null_safe=True)


@query
def null_ticket_matches(v: Views) -> DataFrame:
    """The class row of the query before, without its pairs."""
    tickets = cleaning.with_integer_ids(v.tickets_raw())
    lines = v.lines().select(F.when(F.col("TicketID") % 5 != 0, F.col("TicketID")).alias("TicketID"))
    return joins.null_matches(lines, tickets)


@query
def booking_service_chain(v: Views) -> DataFrame:
    chain = joins.booking_service_chain(v.booking_services(), v.bookings(), v.services(), v.categories())
    return chain.select("booking_id", "user_id", "service_id", "service_name", "service_cat_id", "salon_id")


@query
def services_per_ticket(v: Views) -> DataFrame:
    return services.services_per_ticket(_dated_lines(v)).select("TicketID", "Type", "Descr", "Bill_Date", "NumServices")


@query
def services_per_year(v: Views) -> DataFrame:
    return services.services_per_year(_dated_lines(v), _tickets(v))


@query
def services_per_month(v: Views) -> DataFrame:
    return services.services_per_month(_dated_lines(v), _tickets(v))


@query
def client_service_avgs(v: Views) -> DataFrame:
    return services.client_service_avgs(_dated_lines(v), _tickets(v))


@query
def client_features(v: Views) -> DataFrame:
    return visits.client_features(_tickets(v))


@query
def client_sales(v: Views) -> DataFrame:
    return prepare.client_sales(_tickets(v), _dated_lines(v), cleaning.clean_clients(v.clients_raw(), BLOCKED))


# --- dashboard ----------------------------------------------------------------


@query
def kpi_totals(v: Views) -> DataFrame:
    return dashboard.kpi_totals(_tickets(v), v.lines())


@query
def kpi_texts(v: Views) -> DataFrame:
    totals = dashboard.kpi_totals(_tickets(v), v.lines())
    counts = ["total_services", "total_products", "total_customers"]
    return totals.select(
        money_text(F.col("total_sales")).alias("total_sales"), *[count_text(F.col(c)).alias(c) for c in counts]
    )


@query
def daily_revenue(v: Views) -> DataFrame:
    return dashboard.daily_revenue(_tickets(v), YEAR)


@query
def monthly_revenue(v: Views) -> DataFrame:
    return dashboard.monthly_revenue(dashboard.daily_revenue(_tickets(v), YEAR))


@query
def revenue_levels(v: Views) -> DataFrame:
    return dashboard.revenue_levels(_tickets(v), YEAR)


@query
def best_day(v: Views) -> DataFrame:
    return dashboard.best_day(dashboard.daily_revenue(_tickets(v), YEAR))


@query
def best_month(v: Views) -> DataFrame:
    return dashboard.best_month(dashboard.monthly_revenue(dashboard.daily_revenue(_tickets(v), YEAR)))


@query
def revenue_summary(v: Views) -> DataFrame:
    return dashboard.revenue_summary(_tickets(v), YEAR)


@query
def service_counts(v: Views) -> DataFrame:
    return dashboard.service_counts(v.lines(), YEAR)


@query
def product_counts(v: Views) -> DataFrame:
    return dashboard.product_counts(v.lines(), YEAR)


@query
def top_services(v: Views) -> DataFrame:
    return dashboard.top_items(dashboard.service_counts(v.lines(), YEAR))


@query
def top_products(v: Views) -> DataFrame:
    return dashboard.top_items(dashboard.product_counts(v.lines(), YEAR))


@query
def top_services_text(v: Views) -> DataFrame:
    top = dashboard.top_items(dashboard.service_counts(v.lines(), YEAR))
    return dashboard.top_items_text(top, dashboard.SERVICES_SENTENCE)


@query
def top_products_text(v: Views) -> DataFrame:
    top = dashboard.top_items(dashboard.product_counts(v.lines(), YEAR))
    return dashboard.top_items_text(top, dashboard.PRODUCTS_SENTENCE)


@query
def service_trend_day(v: Views) -> DataFrame:
    return dashboard.trend_by_day(v.lines(), "S", YEAR)


@query
def service_trend_month(v: Views) -> DataFrame:
    return dashboard.trend_by_month(v.lines(), "S", YEAR)


@query
def product_trend_day(v: Views) -> DataFrame:
    return dashboard.trend_by_day(v.lines(), "P", YEAR)


@query
def product_trend_month(v: Views) -> DataFrame:
    return dashboard.trend_by_month(v.lines(), "P", YEAR)


@query
def spend_by_sex(v: Views) -> DataFrame:
    return dashboard.spend_by_sex(client_sales(v))


@query
def clients_by_category(v: Views) -> DataFrame:
    return dashboard.clients_by_category(cleaning.clean_clients(v.clients_raw(), BLOCKED), YEAR)


# --- RFM -----------------------------------------------------------------------


def _features(v: Views) -> DataFrame:
    return rfm_plan.rfm_features(_tickets(v))


def _scored(v: Views) -> DataFrame:
    return rfm_plan.rfm_by_client(_tickets(v))


NOTEBOOK_COLUMNS = RfmColumns(client="ClientID", date="Bill_Date", spend="ticket_total")


def _notebook_inputs(v: Views) -> tuple[DataFrame, DataFrame]:
    """Dated lines and known tickets: the row-grain input of the RFM job."""
    tickets = cleaning.with_integer_ids(v.tickets_raw().na.drop(subset=["ClientID"]))
    lines = _dated_lines(v).withColumn("Bill_Date", F.col("Bill_Stamp"))
    return lines.select("TicketID", "Descr", "Total", "Bill_Date"), tickets


@query
def rfm_quantiles(v: Views) -> DataFrame:
    cuts = rfm.rfm_quantiles(_features(v))
    names = [("q20", 0), ("q40", 1), ("q60", 2), ("q80", 3)]
    rows = [
        F.struct(F.lit(f).alias("feature"), *[F.round(F.col(f)[i], 6).alias(n) for n, i in names]) for f in scoring.FEATURES
    ]
    return cuts.select(F.inline(F.array(*rows)))


@query
def rfm_scores(v: Views) -> DataFrame:
    return _scored(v).select("ClientID", "Recency", "Frequency", "Monetary", "R", "F", "M", "RFM_Segment", "RFM_Score")


@query
def rfm_segment(v: Views) -> DataFrame:
    return _scored(v).select("ClientID", "R", "F", "Segment", "Description")


@query
def rfm_tier(v: Views) -> DataFrame:
    return _scored(v).select("ClientID", "RFM_Score", "Tier", F.col("Tier_Description").alias("description"))


@query
def rfm_segment_share(v: Views) -> DataFrame:
    return rfm.share(_scored(v), "Segment")


@query
def rfm_tier_share(v: Views) -> DataFrame:
    return rfm.share(_scored(v), "Tier")


@query
def rfm_segment_profile(v: Views) -> DataFrame:
    return rfm.segment_profile(_scored(v))


@query
def rfm_tier_profile(v: Views) -> DataFrame:
    return rfm.tier_profile(_scored(v))


@query
def rfm_features_row(v: Views) -> DataFrame:
    lines, tickets = _notebook_inputs(v)
    rows = joins.lines_with_tickets(lines, tickets)
    complete = rfm_plan.rfm_features(rows, NOTEBOOK_COLUMNS).na.drop(subset=list(scoring.FEATURES))
    return rows.select("TicketID", "ClientID", "Descr").join(complete, "ClientID")


@query
def rfm_row_grain(v: Views) -> DataFrame:
    return rfm_plan.rfm_by_line(*_notebook_inputs(v)).select(
        "TicketID", "ClientID", "Descr", "Recency", "Frequency", "Monetary", "RFM_Segment", "Segment", "RFM_Score", "Tier"
    )


@query
def rfm_unpivot(v: Views) -> DataFrame:
    return visits.unpivot_features(_features(v), ["ClientID"])


@query
def tier_export(v: Views) -> DataFrame:
    return rfm.tier_export(_scored(v)).select(
        "ClientID", "Days since last visit", "Number of Visits", "Total Billed", "RFM_Score", "Segment", "Tier", "AVB"
    )


@query
def tier_export_full(v: Views) -> DataFrame:
    """All attributes of the exported clients, read back from the files of every tier."""
    features = _features(v)
    fitted = cluster.fit_scaler(cluster.with_cube_roots(features))
    path = new_path(v.spark, "tiers")
    exports.write_tiers(rfm_plan.rfm_of_sales(QUERIES["client_sales"](v.spark, v.folder), fitted, GIVEN), path)
    schema = (
        "`ClientID` string, `HomePhone` string, `Sex` string, `avg_yrly_services` double, `avg_mnthly_services` double, "
        "`Days since last visit` bigint, `Number of Visits` bigint, `Total Billed` double, `RFM_Score` int, `Segment` string, "
        "`Cluster Segment` string, `AVB` double, `Tier` string"
    )
    return tables.read_csv(v.spark, path, schema, encoding="UTF-8")


def _tier_files(v: Views, tier: str) -> DataFrame:
    """Rows read back from the files of one exported tier."""
    path = new_path(v.spark, "tiers")
    exports.write_tiers(
        _scored(v).select("ClientID", "Recency", "Frequency", "Monetary", "RFM_Score", "Tier"), path
    )
    schema = (
        "`ClientID` string, `Days since last visit` bigint, `Number of Visits` bigint, `Total Billed` double, "
        "`RFM_Score` int, `AVB` double"
    )
    return tables.read_csv(v.spark, f"{path}/Tier={tier}", schema, encoding="UTF-8")


@query
def tier_export_platinum(v: Views) -> DataFrame:
    return _tier_files(v, "Platinum")


@query
def tier_export_gold(v: Views) -> DataFrame:
    return _tier_files(v, "Gold")


@query
def tier_export_silver(v: Views) -> DataFrame:
    return _tier_files(v, "Silver")


@query
def tier_export_bronze(v: Views) -> DataFrame:
    return _tier_files(v, "Bronze")


@query
def tier_preview(v: Views) -> DataFrame:
    return sampling.preview(rfm.tier_export(_scored(v)), "Tier", "ClientID").select(
        "ClientID", "Days since last visit", "Number of Visits", "Total Billed", "Tier", "AVB"
    )


# --- clusters --------------------------------------------------------------------


@query
def rfm_cbrt_z(v: Views) -> DataFrame:
    rooted = cluster.with_cube_roots(_features(v))
    return _rounded(cluster.standardise(rooted, cluster.fit_scaler(rooted)), *scoring.FEATURES)


def _given_clusters(v: Views) -> DataFrame:
    features = _features(v)
    return cluster.assign_features(features, cluster.fit_scaler(cluster.with_cube_roots(features)), GIVEN)


@query
def cluster_assign(v: Views) -> DataFrame:
    return _given_clusters(v).select("ClientID", "Cluster", "Cluster Segment")


@query
def relative_importance(v: Views) -> DataFrame:
    return cluster.relative_importance(_given_clusters(v))


@query
def cluster_profile_given(v: Views) -> DataFrame:
    return cluster.cluster_profile(_given_clusters(v))


@query
def cluster_share_given(v: Views) -> DataFrame:
    return rfm.share(_given_clusters(v), "Cluster Segment")


@query
def cluster_snake_given(v: Views) -> DataFrame:
    rooted = cluster.with_cube_roots(_features(v))
    assigned = cluster.assign(cluster.standardise(rooted, cluster.fit_scaler(rooted)), GIVEN)
    return _rounded(cluster.cluster_snake(assigned), "Value")


@query
def cluster_fit_checks(v: Views) -> DataFrame:
    """What holds for any fit: everyone has one cluster, the nearest one, and clusters have names of their own."""
    features = _features(v)
    model = rfm_plan.fit_model(features)
    placed = rfm_plan.standardised_clusters(features, model)
    away = [sum((F.col(c) - float(x)) ** 2 for c, x in zip(scoring.FEATURES, centroid)) for centroid in model.clustering.centroids]
    own = F.element_at(F.array(*away), F.col("Cluster") + 1)
    return placed.agg(
        F.count("*").alias("clients"),
        F.count_distinct("Cluster").alias("clusters"),
        F.count_distinct("Cluster Segment").alias("names"),
        F.count_if(own > F.array_min(F.array(*away)) + 1e-9).alias("not_nearest"),
        (F.count("*") - F.count_distinct("ClientID")).alias("repeated"),
    )


@query
def cluster_fit(v: Views) -> DataFrame:
    """Fitted clusters with size, centroid and mean squared distance to it."""
    features = _features(v)
    model = rfm_plan.fit_model(features)
    rows = rfm_plan.standardised_clusters(features, model)
    return rows.groupBy("Cluster", "Cluster Segment").agg(
        F.count("*").alias("Count"), *[F.round(F.avg(c), 4).alias(f"Centre_{c}") for c in scoring.FEATURES]
    )


def _fitted_clusters(v: Views) -> DataFrame:
    features = _features(v)
    model = rfm_plan.fit_model(features)
    return cluster.assign_features(features, model.scaler, model.clustering)


@query
def cluster_profile(v: Views) -> DataFrame:
    return cluster.cluster_profile(_fitted_clusters(v))


@query
def cluster_share(v: Views) -> DataFrame:
    return rfm.share(_fitted_clusters(v), "Cluster Segment")


@query
def cluster_snake(v: Views) -> DataFrame:
    features = _features(v)
    return cluster.cluster_snake(rfm_plan.standardised_clusters(features, rfm_plan.fit_model(features)))


@query
def rfm_score_saved_model(v: Views) -> DataFrame:
    """Fit, save, load, predict: scores and clusters from the stored parameters."""
    features = _features(v)
    path = new_path(v.spark, "model")
    rfm_plan.fit_model(features).save(v.spark, path)
    scored = rfm_plan.load_model(v.spark, path).predict(features)
    return scored.select("ClientID", "RFM_Segment", "Segment", "Tier", "Cluster", "Cluster Segment")


@query
def rfm_score_saved_cuts(v: Views) -> DataFrame:
    features = _features(v)
    path = new_path(v.spark, "model")
    rfm_plan.fit_model(features).save(v.spark, path)
    return rfm_plan.load_model(v.spark, path).predict(features).select("ClientID", "RFM_Segment", "Segment", "Tier")


# --- recommender -------------------------------------------------------------------


def _ticket_freq(v: Views) -> DataFrame:
    return recommender.ticket_service_freq(v.lines(), v.tickets_raw())


def _booking_freq(v: Views) -> DataFrame:
    return recommender.booking_service_freq(v.booking_services(), v.bookings(), v.services(), v.categories())


def _tickets_fit(v: Views, sample_n: int | None = None) -> recommender.Recommender:
    return recommender.fit(_ticket_freq(v), sample_n)


def _bookings_fit(v: Views) -> recommender.Recommender:
    return recommender.fit(_booking_freq(v))


@query
def rec_client_service_freq(v: Views) -> DataFrame:
    return _ticket_freq(v)


@query
def rec_client_service_window(v: Views) -> DataFrame:
    rows = recommender.ticket_services(v.lines(), v.tickets_raw())
    return recommend.with_frequency(rows, "ClientID", "Descr").select("TicketID", "ClientID", "Descr", "Frequency")


@query
def client_service_pivot(v: Views) -> DataFrame:
    brands = v.table("part").select("p_brand").distinct().orderBy("p_brand").collect()
    return recommend.client_service_pivot(_ticket_freq(v), [r.p_brand for r in brands])


@query
def client_profiles(v: Views) -> DataFrame:
    return _tickets_fit(v).membership()


@query
def client_similarity(v: Views) -> DataFrame:
    """All similar profiles of each; the clients of a profile are in ``client_profiles``."""
    return _tickets_fit(v).nearest_profiles(THRESHOLD)


@query
def nearest_clients(v: Views) -> DataFrame:
    return _tickets_fit(v).nearest(THRESHOLD, k=10)


@query
def rec_candidates(v: Views) -> DataFrame:
    return _tickets_fit(v).candidates(THRESHOLD).select("client", "service", "supporters")


@query
def rec_scores(v: Views) -> DataFrame:
    return _bookings_fit(v).candidates(THRESHOLD).select("client", "service", "score")


@query
def rec_clients(v: Views) -> DataFrame:
    return _tickets_fit(v).clients(THRESHOLD)


@query
def rec_for_client(v: Views) -> DataFrame:
    return recommend.recommend_for(ONE_CLIENT, stage(_ticket_freq(v), "client_service_freq"), THRESHOLD)


@query
def rec_services_taken(v: Views) -> DataFrame:
    return _tickets_fit(v).taken()


@query
def rec_top5(v: Views) -> DataFrame:
    return _bookings_fit(v).top(THRESHOLD).select("client", "service", "score", "rank")


@query
def rec_top5_raw(v: Views) -> DataFrame:
    return _tickets_fit(v).top_raw(THRESHOLD)


@query
def rec_confidence_report(v: Views) -> DataFrame:
    return recommend.confidence_report(_tickets_fit(v).top_raw(THRESHOLD))


@query
def rec_message(v: Views) -> DataFrame:
    fitted = _tickets_fit(v)
    return recommend.messages(fitted.top_raw(THRESHOLD), fitted.taken())


@query
def rec_sampled(v: Views) -> DataFrame:
    return _tickets_fit(v, sample_n=100).candidates(0.5).select("client", "service", "score")


@query
def rec_from_saved(v: Views) -> DataFrame:
    """Fit and save at the lowest threshold, recommend from the files at a higher one."""
    path = new_path(v.spark, "recommender")
    _bookings_fit(v).save(path)
    return recommender.saved_scores(v.spark, path, THRESHOLD)
