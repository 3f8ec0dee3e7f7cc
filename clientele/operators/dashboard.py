"""Business figures: totals, revenue by day and month, popular items, client mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.columns import ClientColumns, LineColumns, TicketColumns
from clientele.functions.dates import in_year, long_date, month_name
from clientele.functions.numbers import exact_mean, exact_sum, money_text, plain_text
from clientele.functions.rows import one_row
from clientele.functions.text import bracket_list, label, quoted_list

# Labels of the sex codes.
SEX_LABELS = {"F": "Female", "M": "Male"}

# The sentences of the report.
REVENUE_SENTENCE = (
    "You made a total revenue of **%s** in %s. Your biggest day of sales was on **%s** where you made **%s**. "
    "Your biggest month of sales was in **%s** when you made **%s**"
)
SERVICES_SENTENCE = (
    "Most popular services this year were **%s** as it was taken **%s** times respectively "
    "each bringing a revenue of **%s**."
)
PRODUCTS_SENTENCE = (
    "Most popular products this year were **%s** that were purchased at a quantity of **%s** respectively "
    "each bringing a total revenue of **%s**"
)


def kpi_totals(
    tickets: DataFrame, lines: DataFrame, ticket_cols: TicketColumns = TicketColumns(), cols: LineColumns = LineColumns()
) -> DataFrame:
    """All-time sales, services, products and clients, one row."""
    from_tickets = tickets.agg(
        exact_sum(F.col(ticket_cols.total)).alias("total_sales"),
        F.count_distinct(ticket_cols.client).alias("total_customers"),
    )
    from_lines = lines.agg(
        F.count(F.when(F.col(cols.kind) == cols.service_kind, F.col(cols.ticket))).alias("total_services"),
        F.count(F.when(F.col(cols.kind) == cols.product_kind, F.col(cols.ticket))).alias("total_products"),
    )
    counted = one_row(from_lines)
    items = [counted[c].alias(c) for c in from_lines.columns]
    return from_tickets.select("total_sales", *items, "total_customers")


def daily_revenue(tickets: DataFrame, year: int, total: str = "Total", date: str = "Bill_Date") -> DataFrame:
    """Revenue per bill date of one year."""
    return (
        tickets.filter(in_year(F.col(date), year))
        .groupBy(F.to_date(date).alias("Bill_Date"))
        .agg(exact_sum(F.col(total)).alias("Total"))
    )


def monthly_revenue(daily: DataFrame) -> DataFrame:
    """Revenue per month name from the daily rows, with the month number to sort by."""
    return daily.groupBy(F.month("Bill_Date").alias("month_num"), month_name(F.col("Bill_Date")).alias("Bill_Month")).agg(
        exact_sum(F.col("Total")).alias("Total")
    )


def revenue_levels(tickets: DataFrame, year: int, total: str = "Total", date: str = "Bill_Date") -> DataFrame:
    """Revenue of one year by day, by month and as a whole, from one scan and one shuffle.

    ``level`` says what a row sums; ``month_num`` is null for the year, ``Bill_Date`` for month and year.
    """
    day, month = F.to_date(date).alias("Bill_Date"), F.month(date).alias("month_num")
    rows = tickets.filter(in_year(F.col(date), year)).select(day, month, F.col(total).alias("Total"))
    levels = rows.groupingSets([["month_num", "Bill_Date"], ["month_num"], []], "month_num", "Bill_Date")
    named = F.when(F.grouping_id() == 0, "day").when(F.grouping_id() == 1, "month").otherwise("year")
    return levels.agg(named.alias("level"), exact_sum(F.col("Total")).alias("Total"))


def best_day(daily: DataFrame) -> DataFrame:
    """The day with the highest revenue; the earliest one on a tie."""
    return daily.orderBy(F.desc("Total"), "Bill_Date").limit(1)


def best_month(monthly: DataFrame) -> DataFrame:
    """The month with the highest revenue; the alphabetically first one on a tie."""
    return monthly.select("Bill_Month", "Total").orderBy(F.desc("Total"), "Bill_Month").limit(1)


def revenue_summary(tickets: DataFrame, year: int, total: str = "Total", date: str = "Bill_Date") -> DataFrame:
    """The year's revenue, its best day and best month, and the sentence that tells them.

    One chain of days, months, year: the tickets are scanned once, and what follows
    the first aggregation has a row per day at most.
    """

    def best(amount: str, name: str) -> Column:
        return F.struct((-F.col(amount)).alias("neg"), F.col(name).alias("name"))

    months = (
        daily_revenue(tickets, year, total, date)
        .groupBy(month_name(F.col("Bill_Date")).alias("Bill_Month"))
        .agg(exact_sum(F.col("Total")).alias("Total"), F.min(best("Total", "Bill_Date")).alias("d"))
    )
    return (
        months.groupBy()
        .agg(exact_sum(F.col("Total")).alias("total_revenue"), F.min("d").alias("d"), F.min(best("Total", "Bill_Month")).alias("m"))
        .select(
            F.lit(year).alias("year"),
            "total_revenue",
            long_date(F.col("d.name")).alias("biggest_date"),
            (-F.col("d.neg")).alias("biggest_day_sales"),
            F.col("m.name").alias("biggest_month"),
            (-F.col("m.neg")).alias("biggest_month_sales"),
        )
        .withColumn(
            "sentence",
            F.format_string(
                REVENUE_SENTENCE,
                money_text(F.col("total_revenue")),
                F.col("year").cast("string"),
                "biggest_date",
                money_text(F.col("biggest_day_sales")),
                "biggest_month",
                money_text(F.col("biggest_month_sales")),
            ),
        )
    )


def _lines_of(lines: DataFrame, kind: str, year: int, cols: LineColumns) -> DataFrame:
    return lines.filter((F.col(cols.kind) == kind) & in_year(F.col(cols.date), year))


def service_counts(lines: DataFrame, year: int, cols: LineColumns = LineColumns()) -> DataFrame:
    """Times taken and revenue per service of a year."""
    return (
        _lines_of(lines, cols.service_kind, year, cols)
        .filter(F.col(cols.item).isNotNull())
        .groupBy(F.col(cols.item).alias("Descr"))
        .agg(F.count("*").alias("frequency"), exact_sum(F.col(cols.total)).alias("total_sum"))
    )


def product_counts(lines: DataFrame, year: int, cols: LineColumns = LineColumns()) -> DataFrame:
    """Quantity sold and revenue per product of a year."""
    return (
        _lines_of(lines, cols.product_kind, year, cols)
        .filter(F.col(cols.item).isNotNull())
        .groupBy(F.col(cols.item).alias("Descr"))
        .agg(exact_sum(F.col(cols.quantity)).alias("frequency"), exact_sum(F.col(cols.total)).alias("total_sum"))
    )


def top_items(counts: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent items; names decide ties."""
    return counts.orderBy(F.desc("frequency"), "Descr").limit(n)


def top_items_text(top: DataFrame, sentence: str) -> DataFrame:
    """Names, frequencies and revenues of the top items as texts, and the sentence."""
    rows = F.array_sort(
        F.collect_list(F.struct((-F.col("frequency")).alias("neg"), F.col("Descr").alias("name"), F.col("total_sum")))
    )
    return (
        top.agg(rows.alias("rows"))
        .select(
            quoted_list(F.col("rows.name")).alias("names"),
            bracket_list(F.transform("rows", lambda r: plain_text(-r["neg"]))).alias("frequencies"),
            F.array_join(F.transform("rows", lambda r: money_text(r["total_sum"])), ", ").alias("revenues"),
        )
        .withColumn("sentence", F.format_string(sentence, "names", "frequencies", "revenues"))
    )


def trend_by_day(lines: DataFrame, kind: str, year: int, cols: LineColumns = LineColumns()) -> DataFrame:
    return _lines_of(lines, kind, year, cols).groupBy(F.to_date(cols.date).alias("Bill_Date")).agg(F.count("*").alias("events"))


def trend_by_month(lines: DataFrame, kind: str, year: int, cols: LineColumns = LineColumns()) -> DataFrame:
    date = F.col(cols.date)
    return (
        _lines_of(lines, kind, year, cols)
        .groupBy(F.month(date).alias("month_num"), month_name(date).alias("Bill_Month"))
        .agg(F.count("*").alias("events"))
    )


def spend_by_sex(sales: DataFrame, sex: str = "Sex", spend: str = "TotalSpend") -> DataFrame:
    """Mean spend per sex, over all years."""
    return (
        sales.filter(F.col(sex).isNotNull())
        .groupBy(F.col(sex).alias("Sex"))
        .agg(exact_mean(F.col(spend)).alias("mean_spend"))
        .select("Sex", label(F.col("Sex"), SEX_LABELS).alias("Gender"), "mean_spend")
    )


def clients_by_category(clients: DataFrame, year: int, cols: ClientColumns = ClientColumns()) -> DataFrame:
    """New clients of a year per category, most frequent first."""
    return (
        clients.filter(in_year(F.col(cols.created), year) & F.col(cols.category).isNotNull())
        .groupBy(F.col(cols.category).alias("Category"))
        .agg(F.count("*").alias("Count"))
        .orderBy(F.desc("Count"), "Category")
    )
