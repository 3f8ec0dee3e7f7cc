"""DuckDB SQL for the registered queries, built from named common table expressions."""

from __future__ import annotations

import re

from clientele.functions import scoring
from clientele.operators import dashboard, recommend
from clientele.operators.cluster import FIXED_NAMES
from clientele.operators.dashboard import SEX_LABELS
from registry.jobs import GIVEN, ONE_CLIENT, THRESHOLD, YEAR
from registry.views import BLOCKED, SEX_CODES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(value: str, mapping: dict) -> str:
    whens = " ".join(
        f"WHEN {_text(k) if isinstance(k, str) else k} THEN {_text(v)}" for k, v in mapping.items()
    )
    return f"CASE {value} {whens} END"


_MONEY = "sum(CAST({} AS DECIMAL(22,6)))"


def _money(c: str) -> str:
    return f"CAST({_MONEY.format(c)} AS DOUBLE)"


def _mean(c: str) -> str:
    return f"({_money(c)} / count({c}))"


def _in_year(c: str) -> str:
    return f"{c} >= TIMESTAMP '{YEAR}-01-01' AND {c} < TIMESTAMP '{YEAR + 1}-01-01'"


_BLOCKED = ", ".join(_text(b) for b in BLOCKED)

CTES: dict[str, str] = {}

CTES["tickets_raw"] = """
SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'Closed' ELSE CAST(o_orderkey AS VARCHAR) END AS TicketID,
       CASE WHEN o_custkey % 97 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS ClientID,
       CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS Total,
       o_orderdate AS Created_Date
FROM orders"""

CTES["line_base"] = "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey"

CTES["lines"] = """
SELECT l_orderkey AS TicketID, CASE WHEN l_linestatus = 'F' THEN 'S' ELSE 'P' END AS Type, p_brand AS Descr,
       l_quantity + 0.375::DOUBLE * (l_orderkey % 2) AS Qty, l_extendedprice AS Total, l_shipdate AS Bill_Date,
       CASE WHEN l_partkey % 53 <> 0 THEN p_type END AS Group1
FROM line_base"""

CTES["lines_raw"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS TicketID, CASE WHEN l_linestatus = 'F' THEN 'S' ELSE 'P' END AS Type,
       p_brand AS Descr, l_quantity + 0.375::DOUBLE * (l_orderkey % 2) AS Qty, l_extendedprice AS Total,
       CASE WHEN l_orderkey % 89 = 0 THEN 'bad' ELSE strftime(l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)), '%d-%m-%Y %H:%M') END AS Created_Date2,
       CASE WHEN l_partkey % 53 <> 0 THEN p_type END AS Group1
FROM line_base"""

CTES["clients_raw"] = f"""
SELECT CAST(c_custkey AS VARCHAR) AS ClientID, {_case('c_mktsegment', SEX_CODES)} AS Sex, c_name AS HomePhone,
       TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS Create_Date, c_mktsegment AS category
FROM customer"""

CTES["tickets_clean"] = f"""
SELECT TicketID, ClientID, coalesce(Total, 0) AS Total, Created_Date, Created_Date AS Bill_Date,
       strftime(Created_Date, '%B') AS Bill_Month
FROM tickets_raw WHERE ClientID IS NOT NULL AND ClientID NOT IN ({_BLOCKED})"""

CTES["tickets"] = "SELECT * REPLACE (TRY_CAST(TicketID AS BIGINT) AS TicketID) FROM tickets_clean"

CTES["tickets_ids"] = "SELECT * REPLACE (TRY_CAST(TicketID AS BIGINT) AS TicketID) FROM tickets_raw"

CTES["dated"] = """
SELECT TRY_CAST(TicketID AS BIGINT) AS TicketID, Type, Descr, Qty, Total, Group1,
       CAST(try_strptime(Created_Date2, '%d-%m-%Y %H:%M') AS DATE) AS Bill_Date,
       try_strptime(Created_Date2, '%d-%m-%Y %H:%M') AS Bill_Stamp,
       strftime(try_strptime(Created_Date2, '%d-%m-%Y %H:%M'), '%H:%M:%S') AS Bill_Time
FROM lines_raw"""

CTES["clients"] = f"SELECT * FROM clients_raw WHERE ClientID IS NOT NULL AND ClientID NOT IN ({_BLOCKED})"

CTES["counted"] = """
SELECT *, CASE WHEN Type = 'S' AND TicketID IS NOT NULL
          THEN count(CASE WHEN Type = 'S' THEN 1 END) OVER (PARTITION BY TicketID) END AS NumServices
FROM dated"""

CTES["merged"] = """
SELECT DISTINCT d.TicketID, d.NumServices, d.Bill_Date, t.ClientID
FROM counted d LEFT JOIN tickets t ON d.TicketID = t.TicketID"""

for _unit in ("year", "month"):
    CTES[f"per_{_unit}"] = f"""
SELECT ClientID, {_unit}(Bill_Date) AS {_unit}, CAST(coalesce(sum(NumServices), 0) AS BIGINT) AS NumServices
FROM merged WHERE ClientID IS NOT NULL AND Bill_Date IS NOT NULL GROUP BY ALL"""

CTES["avgs"] = """
SELECT coalesce(y.ClientID, m.ClientID) AS ClientID, avg_yrly_services, avg_mnthly_services
FROM (SELECT ClientID, avg(NumServices) AS avg_yrly_services FROM per_year GROUP BY 1) y
FULL JOIN (SELECT ClientID, avg(NumServices) AS avg_mnthly_services FROM per_month GROUP BY 1) m
  ON y.ClientID = m.ClientID"""

CTES["features"] = f"""
SELECT DISTINCT ClientID,
       CAST({_MONEY.format('Total')} OVER c AS DOUBLE) AS TotalSpend,
       count(ClientID) OVER c AS NumVisits,
       datesub('day', max(Created_Date) OVER c, max(Created_Date) OVER ()) AS DaysSinceLastVisit
FROM tickets WINDOW c AS (PARTITION BY ClientID)"""

CTES["sales"] = """
SELECT f.*, avg_yrly_services, avg_mnthly_services, nullif(upper(Sex), 'NAN') AS Sex, HomePhone
FROM features f LEFT JOIN avgs a ON f.ClientID = a.ClientID LEFT JOIN clients c ON f.ClientID = c.ClientID"""

CTES["daily"] = f"""
SELECT CAST(Bill_Date AS DATE) AS Bill_Date, {_money('Total')} AS Total
FROM tickets WHERE {_in_year('Bill_Date')} GROUP BY 1"""

CTES["monthly"] = f"""
SELECT month(Bill_Date) AS month_num, strftime(Bill_Date, '%B') AS Bill_Month, {_money('Total')} AS Total
FROM daily GROUP BY 1, 2"""

CTES["service_counts"] = f"""
SELECT Descr, count(*) AS frequency, {_money('Total')} AS total_sum
FROM lines WHERE Type = 'S' AND {_in_year('Bill_Date')} GROUP BY 1"""

CTES["product_counts"] = f"""
SELECT Descr, {_money('Qty')} AS frequency, {_money('Total')} AS total_sum
FROM lines WHERE Type = 'P' AND {_in_year('Bill_Date')} GROUP BY 1"""

CTES["rfm"] = """
SELECT ClientID, DaysSinceLastVisit AS Recency, NumVisits AS Frequency, TotalSpend AS Monetary FROM features"""


def _cuts(table: str) -> str:
    cols = ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS {f[0]}c" for f in scoring.FEATURES)
    return f"SELECT {cols} FROM {table}"


def _band(c: str, cuts: str, numbers: tuple[int, ...]) -> str:
    whens = " ".join(f"WHEN {c} <= {cuts}[{i + 1}] THEN {n}" for i, n in enumerate(numbers[:-1]))
    return f"CASE {whens} ELSE {numbers[-1]} END"


def _scored(table: str, cuts: str) -> str:
    segments = " ".join(
        f"WHEN regexp_full_match(rf, {_text(p)}) THEN {_text(name)}" for p, name in scoring.SEGMENTS.items()
    )
    return f"""
SELECT *, CASE {segments} END AS Segment,
       CASE WHEN RFM_Score > 10 THEN 'Platinum' WHEN RFM_Score > 9 THEN 'Gold' WHEN RFM_Score > 7 THEN 'Silver'
            WHEN RFM_Score > 5 THEN 'Bronze' ELSE 'Green' END AS Tier
FROM (SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_Segment,
             CAST(R AS VARCHAR) || CAST(F AS VARCHAR) AS rf, R + F + M AS RFM_Score
      FROM (SELECT t.*, {_band('Recency', 'Rc', (5, 4, 3, 2, 1))} AS R,
                   {_band('Frequency', 'Fc', (1, 2, 3, 4, 5))} AS F,
                   {_band('Monetary', 'Mc', (1, 2, 3, 4, 5))} AS M
            FROM {table} t, {cuts}))"""


CTES["cuts"] = _cuts("rfm")
CTES["scored"] = _scored("rfm", "cuts")

CTES["note_rows"] = """
SELECT d.TicketID, d.Descr, d.Bill_Stamp AS Bill_Date, t.ClientID, t.Total AS ticket_total
FROM dated d LEFT JOIN (SELECT * FROM tickets_ids WHERE ClientID IS NOT NULL) t ON d.TicketID = t.TicketID"""

CTES["note_rfm"] = f"""
SELECT TicketID, ClientID, Descr,
       CASE WHEN ClientID IS NOT NULL THEN
         datesub('day', max(CAST(Bill_Date AS TIMESTAMP)) OVER c, max(CAST(Bill_Date AS TIMESTAMP)) OVER ()) END AS Recency,
       CASE WHEN ClientID IS NOT NULL THEN count(ClientID) OVER c END AS Frequency,
       CASE WHEN ClientID IS NOT NULL THEN
         coalesce(CAST({_MONEY.format('ticket_total')} OVER c AS DOUBLE), 0) END AS Monetary
FROM note_rows WINDOW c AS (PARTITION BY ClientID)"""

CTES["note_complete"] = """
SELECT * FROM note_rfm WHERE Recency IS NOT NULL AND Frequency IS NOT NULL AND Monetary IS NOT NULL"""

CTES["note_cuts"] = _cuts("note_rfm")
CTES["note_scored"] = _scored("note_complete", "note_cuts")

CTES["export"] = """
SELECT *, avg("Total Billed") OVER (PARTITION BY Tier, ClientID) AS AVB
FROM (SELECT ClientID, Recency AS "Days since last visit", Frequency AS "Number of Visits", Monetary AS "Total Billed",
             RFM_Score, Segment, Tier FROM scored WHERE Tier <> 'Green')"""

CTES["rooted"] = "SELECT ClientID, " + ", ".join(f"cbrt({f}) AS {f}" for f in scoring.FEATURES) + " FROM rfm"
CTES["z"] = (
    "SELECT ClientID, "
    + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in scoring.FEATURES)
    + " FROM rooted"
)
_distance = " UNION ALL ".join(
    f"SELECT ClientID, {i} AS Cluster, "
    + " + ".join(f"({f} - ({x})) * ({f} - ({x}))" for f, x in zip(scoring.FEATURES, centre))
    + " AS d FROM z"
    for i, centre in enumerate(GIVEN.centroids)
)
CTES["given"] = f"""
SELECT ClientID, Cluster, {_case('Cluster', FIXED_NAMES)} AS "Cluster Segment" FROM (
  SELECT *, row_number() OVER (PARTITION BY ClientID ORDER BY d, Cluster) AS rn FROM ({_distance})) WHERE rn = 1"""
CTES["clustered"] = 'SELECT rfm.*, Cluster, "Cluster Segment" FROM rfm JOIN given ON rfm.ClientID = given.ClientID'
CTES["importance"] = (
    'SELECT "Cluster Segment", '
    + ", ".join(f'{_mean(f)} / any_value(all_{f}) - 1 AS "Relative {f}"' for f in scoring.FEATURES)
    + " FROM clustered, (SELECT "
    + ", ".join(f"{_mean(f)} AS all_{f}" for f in scoring.FEATURES)
    + " FROM clustered) GROUP BY 1"
)

CTES["chain"] = """
SELECT l_orderkey AS booking_id, o_custkey AS user_id, l_partkey AS service_id, p_brand AS service_name,
       p_size AS service_cat_id, l_suppkey % 10 AS salon_id
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
JOIN (SELECT DISTINCT p_size AS cat, salon FROM part, range(0, 10) r(salon) WHERE (p_size + salon) % 5 <> 0)
  ON cat = p_size AND salon = l_suppkey % 10"""

CTES["ticket_rows"] = """
SELECT l.TicketID, t.ClientID, l.Descr
FROM lines l LEFT JOIN (SELECT * FROM tickets_ids WHERE TicketID IS NOT NULL) t ON l.TicketID = t.TicketID
WHERE l.Group1 IS NOT NULL"""


def _recommender(freq: str, prefix: str, threshold: float, keys: str = "") -> None:
    """Frequencies, all similar pairs and all candidate entries over every client."""
    CTES[f"{prefix}_freq"] = freq
    CTES[f"{prefix}_norm"] = f"""
SELECT client, CAST(sum(frequency * frequency) AS DOUBLE) AS norm2 FROM {prefix}_freq GROUP BY 1"""
    CTES[f"{prefix}_pairs"] = f"""
SELECT d.a, d.b, dot / sqrt(x.norm2 * y.norm2) AS sim
FROM (SELECT p.client AS a, q.client AS b, CAST(sum(p.frequency * q.frequency) AS DOUBLE) AS dot
      FROM {prefix}_freq p JOIN {prefix}_freq q ON p.service = q.service AND p.client <> q.client GROUP BY 1, 2) d
JOIN {prefix}_norm x ON x.client = d.a JOIN {prefix}_norm y ON y.client = d.b
WHERE dot / sqrt(x.norm2 * y.norm2) > {threshold}"""
    CTES[f"{prefix}_entries"] = f"""
SELECT s.a AS client, s.b AS neighbour, f.service, s.sim AS score
FROM {prefix}_pairs s JOIN {prefix}_freq f ON f.client = s.b
WHERE NOT EXISTS (SELECT 1 FROM {prefix}_freq o WHERE o.client = s.a AND o.service = f.service)"""
    CTES[f"{prefix}_scores"] = f"""
SELECT client, service, max(score) AS score, count(*) AS supporters FROM {prefix}_entries GROUP BY 1, 2"""
    CTES[f"{prefix}_raw"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY score DESC, neighbour, service) AS rank
               FROM {prefix}_entries) WHERE rank <= 5"""
    CTES[f"{prefix}_taken"] = f"""
SELECT client, array_to_string(list_slice(list(service ORDER BY service), 1, 3), ', ') AS services_taken
FROM {prefix}_freq GROUP BY 1"""


_recommender(
    """
SELECT ClientID AS client, Descr AS service, count(*) AS frequency
FROM ticket_rows WHERE ClientID IS NOT NULL AND Descr IS NOT NULL GROUP BY 1, 2""",
    "t",
    THRESHOLD,
)
_recommender(
    """
SELECT user_id AS client, service_name AS service, count(*) AS frequency
FROM chain WHERE user_id IS NOT NULL AND service_name IS NOT NULL GROUP BY 1, 2""",
    "b",
    THRESHOLD,
)
_recommender(
    """
SELECT * FROM t_freq WHERE client IN (
  SELECT client FROM (SELECT DISTINCT client FROM t_freq) ORDER BY md5(client), client LIMIT 100)""",
    "s",
    0.5,
)

CTES["profiles"] = """
SELECT client, min(client) OVER (PARTITION BY items) AS profile FROM (
  SELECT client, list({'s': service, 'f': frequency} ORDER BY service) AS items FROM t_freq GROUP BY 1)"""


def _sql(body: str) -> str:
    """Prefix the query with the expressions it needs, in order of definition."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()


def _share(table: str, group: str) -> str:
    return (
        f'SELECT "{group}", count(*) AS "Count", '
        f"CAST(round_even(count(*) / sum(count(*)) OVER () * 100 * 10, 0) AS DOUBLE) / 10 AS \"Percent\" "
        f"FROM {table} GROUP BY 1"
    )


def _profile(group: str, descriptions: dict) -> str:
    return f"""
SELECT {group}, count(*) AS Customer_Count, {_mean('Recency')} AS Avg_Days_Since_Last_Visit,
       {_mean('Frequency')} AS Avg_Visits, {_mean('Monetary')} AS Avg_Bill_Value,
       {_case(group, descriptions)} AS Description
FROM scored GROUP BY {group}"""


def _printf(sentence: str, *args: str) -> str:
    return f"printf({_text(sentence)}, {', '.join(args)})"


def _rupees(c: str) -> str:
    return f"('₹' || format('{{:,.2f}}', {c}))"


def _trend(kind: str, month: bool) -> str:
    keys = "month(Bill_Date) AS month_num, strftime(Bill_Date, '%B') AS Bill_Month" if month else "CAST(Bill_Date AS DATE) AS Bill_Date"
    return f"SELECT {keys}, count(*) AS events FROM lines WHERE Type = '{kind}' AND {_in_year('Bill_Date')} GROUP BY ALL"


def _top(table: str) -> str:
    return f"SELECT * FROM {table} ORDER BY frequency DESC, Descr LIMIT 3"


def _top_text(table: str, sentence: str) -> str:
    order = "ORDER BY frequency DESC, Descr"
    return f"""
SELECT *, {_printf(sentence, 'names', 'frequencies', 'revenues')} AS sentence FROM (
  SELECT string_agg('''' || Descr || '''', ', ' {order}) AS names,
         '[' || string_agg(regexp_replace(CAST(CAST(frequency AS DECIMAL(22,6)) AS VARCHAR), '\\.?0+$', ''), ', ' {order}) || ']' AS frequencies,
         string_agg({_rupees('total_sum')}, ', ' {order}) AS revenues
  FROM ({_top(table)}))"""


def _tier_rows(tier: str) -> str:
    return (
        'SELECT ClientID, "Days since last visit", "Number of Visits", "Total Billed", RFM_Score, AVB '
        f"FROM export WHERE Tier = '{tier}'"
    )


def _percent(c: str) -> str:
    return f"printf('%.1f%%', CAST(round_even({c} * 10, 0) AS DOUBLE) / 10)"


def _one(c: str) -> str:
    return f"CAST(round_even({c} * 10, 0) AS DOUBLE) / 10"


_match = "CAST(CAST(round_even(score * 100, 0) AS INTEGER) AS VARCHAR) || '%'"
_pivot = ", ".join(
    f"""CAST(coalesce(sum(CASE WHEN service = 'Brand#{i}' THEN frequency END), 0) AS BIGINT) AS "Brand#{i}\""""
    for i in range(1, 26)
)

BODIES: dict[str, str] = {
    # sources, cleaning
    "csv_latin1_roundtrip": (
        "SELECT CAST(c_custkey AS VARCHAR) AS ClientID, 'Zoë ÀÿÖ ' || c_name AS FirstName, c_acctbal AS Balance FROM customer"
    ),
    "clean_tickets": "SELECT * FROM tickets_clean",
    "clean_clients": "SELECT * FROM clients",
    "clean_ticket_status": "SELECT * FROM tickets_raw WHERE TicketID <> 'Closed' AND TicketID IS NOT NULL",
    "clean_ticket_ids": "SELECT TicketID, ClientID FROM tickets_ids",
    "parse_bill_datetime": "SELECT CAST(TicketID AS VARCHAR) AS TicketID, Descr, Bill_Date, Bill_Time FROM dated",
    "clean_sex": "SELECT ClientID, nullif(upper(Sex), 'NAN') AS Sex FROM clients_raw",
    "available_years": "SELECT DISTINCT year(Bill_Date) AS year FROM tickets WHERE Bill_Date IS NOT NULL ORDER BY 1",
    # joins and client features
    "lines_left_tickets": """
SELECT l.TicketID, l.Type, l.Descr, l.Total AS line_total, t.ClientID, t.Total AS ticket_total
FROM lines l LEFT JOIN tickets_ids t ON l.TicketID = t.TicketID""",
    "lines_left_tickets_null_safe": """
SELECT l.TicketID, l.Type, l.Descr, l.Total AS line_total, t.ClientID, t.Total AS ticket_total
FROM (SELECT * REPLACE (nullif(TicketID, 0) AS TicketID) FROM lines) l
LEFT JOIN tickets_ids t ON l.TicketID IS NOT DISTINCT FROM t.TicketID""",
    "null_ticket_matches": """
SELECT l.n AS lines_without_id, t.n AS tickets_without_id, l.n * greatest(t.n, 1) AS result_rows
FROM (SELECT count(*) AS n FROM lines WHERE TicketID % 5 = 0) l, (SELECT count(*) AS n FROM tickets_ids WHERE TicketID IS NULL) t""",
    "csv_folder_by_header": "SELECT CAST(c_custkey AS VARCHAR) AS ClientID, c_name AS FirstName, c_acctbal AS Balance FROM customer",
    "booking_service_chain": "SELECT * FROM chain",
    "services_per_ticket": "SELECT TicketID, Type, Descr, Bill_Date, NumServices FROM counted",
    "services_per_year": "SELECT * FROM per_year",
    "services_per_month": "SELECT * FROM per_month",
    "client_service_avgs": "SELECT * FROM avgs",
    "client_features": "SELECT * FROM features",
    "client_sales": "SELECT * FROM sales",
    # dashboard
    "kpi_totals": f"""
SELECT (SELECT {_money('Total')} FROM tickets) AS total_sales,
       (SELECT count(TicketID) FROM lines WHERE Type = 'S') AS total_services,
       (SELECT count(TicketID) FROM lines WHERE Type = 'P') AS total_products,
       (SELECT count(DISTINCT ClientID) FROM tickets) AS total_customers""",
    "kpi_texts": f"""
SELECT (SELECT {_rupees(_money('Total'))} FROM tickets) AS total_sales,
       (SELECT format('{{:,}}', count(TicketID)) FROM lines WHERE Type = 'S') AS total_services,
       (SELECT format('{{:,}}', count(TicketID)) FROM lines WHERE Type = 'P') AS total_products,
       (SELECT format('{{:,}}', count(DISTINCT ClientID)) FROM tickets) AS total_customers""",
    "daily_revenue": "SELECT * FROM daily",
    "monthly_revenue": "SELECT * FROM monthly",
    "revenue_levels": f"""
SELECT month(Bill_Date) AS month_num, CAST(Bill_Date AS DATE) AS Bill_Date,
       CASE grouping(month(Bill_Date), CAST(Bill_Date AS DATE)) WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS level, {_money('Total')} AS Total
FROM tickets WHERE year(Bill_Date) = {YEAR}
GROUP BY GROUPING SETS ((month(Bill_Date), CAST(Bill_Date AS DATE)), (month(Bill_Date)), ())""",
    "best_day": "SELECT * FROM daily ORDER BY Total DESC, Bill_Date LIMIT 1",
    "best_month": "SELECT Bill_Month, Total FROM monthly ORDER BY Total DESC, Bill_Month LIMIT 1",
    "revenue_summary": f"""
SELECT *, {_printf(dashboard.REVENUE_SENTENCE, _rupees('total_revenue'), 'CAST(year AS VARCHAR)', 'biggest_date',
                   _rupees('biggest_day_sales'), 'biggest_month', _rupees('biggest_month_sales'))} AS sentence
FROM (SELECT {YEAR} AS year, (SELECT {_money('Total')} FROM daily) AS total_revenue,
             strftime(d.Bill_Date, '%B %d, %Y') AS biggest_date, d.Total AS biggest_day_sales,
             m.Bill_Month AS biggest_month, m.Total AS biggest_month_sales
      FROM (SELECT * FROM daily ORDER BY Total DESC, Bill_Date LIMIT 1) d,
           (SELECT * FROM monthly ORDER BY Total DESC, Bill_Month LIMIT 1) m)""",
    "service_counts": "SELECT * FROM service_counts",
    "product_counts": "SELECT * FROM product_counts",
    "top_services": _top("service_counts"),
    "top_products": _top("product_counts"),
    "top_services_text": _top_text("service_counts", dashboard.SERVICES_SENTENCE),
    "top_products_text": _top_text("product_counts", dashboard.PRODUCTS_SENTENCE),
    "service_trend_day": _trend("S", month=False),
    "service_trend_month": _trend("S", month=True),
    "product_trend_day": _trend("P", month=False),
    "product_trend_month": _trend("P", month=True),
    "spend_by_sex": f"""
SELECT Sex, {_case('Sex', SEX_LABELS)} AS Gender, {_mean('TotalSpend')} AS mean_spend
FROM sales WHERE Sex IS NOT NULL GROUP BY 1""",
    "clients_by_category": f"""
SELECT category AS Category, count(*) AS "Count" FROM clients
WHERE {_in_year('Create_Date')} AND category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1""",
    # RFM
    "rfm_quantiles": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, " + ", ".join(f"round({f[0]}c[{i + 1}], 6) AS q{(i + 1) * 20}" for i in range(4)) + " FROM cuts"
        for f in scoring.FEATURES
    ),
    "rfm_scores": "SELECT ClientID, Recency, Frequency, Monetary, R, F, M, RFM_Segment, RFM_Score FROM scored",
    "rfm_segment": f"SELECT ClientID, R, F, Segment, {_case('Segment', scoring.SEGMENT_DESCRIPTIONS)} AS Description FROM scored",
    "rfm_tier": f"SELECT ClientID, RFM_Score, Tier, {_case('Tier', scoring.TIER_DESCRIPTIONS)} AS description FROM scored",
    "rfm_segment_share": _share("scored", "Segment"),
    "rfm_tier_share": _share("scored", "Tier"),
    "rfm_segment_profile": _profile("Segment", scoring.SEGMENT_DESCRIPTIONS),
    "rfm_tier_profile": _profile("Tier", scoring.TIER_DESCRIPTIONS),
    "rfm_features_row": "SELECT * FROM note_complete",
    "rfm_row_grain": """
SELECT TicketID, ClientID, Descr, Recency, Frequency, Monetary, RFM_Segment, Segment, RFM_Score, Tier FROM note_scored""",
    "rfm_unpivot": " UNION ALL ".join(
        f"SELECT ClientID, '{f}' AS Attribute, CAST({f} AS DOUBLE) AS Value FROM rfm" for f in scoring.FEATURES
    ),
    "rfm_score_saved_cuts": "SELECT ClientID, RFM_Segment, Segment, Tier FROM scored",
    "tier_export": "SELECT * FROM export",
    "tier_export_full": """
SELECT e.ClientID, HomePhone, Sex, avg_yrly_services, avg_mnthly_services, "Days since last visit", "Number of Visits",
       "Total Billed", RFM_Score, Segment, "Cluster Segment", AVB, Tier
FROM export e JOIN sales s ON s.ClientID = e.ClientID JOIN clustered c ON c.ClientID = e.ClientID""",
    "tier_export_platinum": _tier_rows("Platinum"),
    "tier_export_gold": _tier_rows("Gold"),
    "tier_export_silver": _tier_rows("Silver"),
    "tier_export_bronze": _tier_rows("Bronze"),
    "tier_preview": """
SELECT ClientID, "Days since last visit", "Number of Visits", "Total Billed", Tier, AVB FROM (
  SELECT *, row_number() OVER (PARTITION BY Tier ORDER BY md5(ClientID), ClientID) AS rn FROM export) WHERE rn <= 3""",
    # clusters
    "rfm_cbrt_z": "SELECT ClientID, " + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in scoring.FEATURES) + " FROM z",
    "cluster_assign": "SELECT * FROM given",
    "relative_importance": "SELECT * FROM importance",
    "cluster_fit_checks": """
SELECT count(*) AS clients, CAST(4 AS BIGINT) AS clusters, CAST(4 AS BIGINT) AS names, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS repeated FROM rfm""",
    "cluster_profile_given": f"""
SELECT s.*, {', '.join(f'''printf('%.0f%%', CAST(round_even("Relative {f}" * 100, 0) AS DOUBLE)) AS "Relative {f}"''' for f in scoring.FEATURES)}
FROM (SELECT Cluster, "Cluster Segment", count(*) AS "Count",
             {_percent('count(*) / sum(count(*)) OVER () * 100')} AS "Percent",
             {_one(_mean('Recency'))} AS Avg_Days_Since_Last_Visit, {_one(_mean('Frequency'))} AS Avg_Num_Visits,
             {_one(_mean('Monetary'))} AS Avg_Bill_Value
      FROM clustered GROUP BY 1, 2) s JOIN importance i ON i."Cluster Segment" = s."Cluster Segment\"""",
    "cluster_share_given": _share("clustered", "Cluster Segment"),
    "cluster_snake_given": " UNION ALL ".join(
        f"""SELECT "Cluster Segment", '{f}' AS Attribute, round(avg({f}), 6) + 0.0 AS Value
            FROM z JOIN given ON z.ClientID = given.ClientID GROUP BY 1"""
        for f in scoring.FEATURES
    ),
    # recommender
    "rec_client_service_freq": "SELECT * FROM t_freq",
    "rec_client_service_window": """
SELECT TicketID, ClientID, Descr,
       CASE WHEN ClientID IS NOT NULL THEN count(*) OVER (PARTITION BY ClientID, Descr) END AS Frequency
FROM ticket_rows""",
    "client_service_pivot": f"SELECT client, {_pivot} FROM t_freq GROUP BY 1",
    "client_profiles": "SELECT * FROM profiles",
    "client_similarity": """
SELECT a AS client, b AS neighbour, sim AS similarity FROM t_pairs
WHERE a IN (SELECT profile FROM profiles) AND b IN (SELECT profile FROM profiles)""",
    "nearest_clients": """
SELECT a AS client, b AS neighbour, sim AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM t_pairs) WHERE rank <= 10""",
    "rec_candidates": "SELECT client, service, supporters FROM t_scores",
    "rec_scores": "SELECT client, service, score FROM b_scores",
    "rec_clients": "SELECT DISTINCT client FROM t_entries",
    "rec_for_client": f"SELECT client, service, score FROM t_scores WHERE client = '{ONE_CLIENT}'",
    "rec_services_taken": "SELECT * FROM t_taken",
    "rec_top5": """
SELECT * FROM (SELECT client, service, score, row_number() OVER (PARTITION BY client ORDER BY score DESC, service) AS rank
               FROM b_scores) WHERE rank <= 5""",
    "rec_top5_raw": "SELECT * FROM t_raw",
    "rec_confidence_report": f"""
SELECT client, rank, service AS "Service Description", {_match} AS "Confidence Match" FROM t_raw""",
    "rec_message": f"""
SELECT client, {_printf(recommend.GREETING, 'client')} AS greeting, {_printf(recommend.REASON, 'services_taken')} AS reason, recommendations
FROM t_taken JOIN (
  SELECT client AS c, string_agg(rank || '. ' || service || ' - ' || {_match} || ' Match', chr(10) ORDER BY rank) AS recommendations
  FROM t_raw GROUP BY 1) ON c = client""",
    "rec_sampled": "SELECT client, service, score FROM s_scores",
    "rec_from_saved": "SELECT client, service, score FROM b_scores",
}

ORACLE = {name: _sql(body) for name, body in BODIES.items()}
