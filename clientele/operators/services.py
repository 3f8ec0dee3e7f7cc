"""How many services clients take per ticket, year and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.columns import LineColumns, TicketColumns
from clientele.operators.joins import with_group_values


def services_per_ticket(lines: DataFrame, cols: LineColumns = LineColumns()) -> DataFrame:
    """Service lines of the ticket, on its service lines; null on all others."""
    is_service = F.col(cols.kind) == cols.service_kind
    counted = with_group_values(lines, [cols.ticket], _services=F.count_if(is_service))
    return counted.withColumn("NumServices", F.when(is_service, F.col("_services"))).drop("_services")


def _ticket_days(lines: DataFrame, tickets: DataFrame, cols: LineColumns, ticket_cols: TicketColumns) -> DataFrame:
    """One row per client, ticket and bill date with the services of the whole ticket.

    Days on which a ticket has no service line carry 0: they make the period count,
    but add nothing to it. The lines are combined per ticket to one count and two sets of dates,
    before their only shuffle, so a ticket with very many lines is as small as its dates.
    """
    is_service = F.col(cols.kind) == cols.service_kind
    per_ticket = (
        lines.filter(F.col(cols.ticket).isNotNull())
        .groupBy(cols.ticket)
        .agg(
            F.count_if(is_service).alias("_services"),
            F.collect_set(cols.date).alias("_days"),
            F.collect_set(F.when(is_service, F.col(cols.date))).alias("_service_days"),
        )
    )
    owners = (
        tickets.filter(F.col(ticket_cols.ticket).isNotNull() & F.col(ticket_cols.client).isNotNull())
        .select(F.col(ticket_cols.ticket).alias(cols.ticket), ticket_cols.client)
        .distinct()
    )
    served = F.when(F.array_contains("_service_days", F.col(cols.date)), F.col("_services")).otherwise(F.lit(0))
    per_day = per_ticket.select("*", F.explode("_days").alias(cols.date)).select(cols.ticket, cols.date, served.alias("NumServices"))
    return per_day.join(owners, cols.ticket)


def _per_period(days: DataFrame, client: str, period: Column, name: str) -> DataFrame:
    return days.groupBy(client, period.alias(name)).agg(F.sum("NumServices").alias("NumServices"))


def services_per_year(
    lines: DataFrame, tickets: DataFrame, cols: LineColumns = LineColumns(), ticket_cols: TicketColumns = TicketColumns()
) -> DataFrame:
    days = _ticket_days(lines, tickets, cols, ticket_cols)
    return _per_period(days, ticket_cols.client, F.year(cols.date), "year")


def services_per_month(
    lines: DataFrame, tickets: DataFrame, cols: LineColumns = LineColumns(), ticket_cols: TicketColumns = TicketColumns()
) -> DataFrame:
    """By month of the year, all years together."""
    days = _ticket_days(lines, tickets, cols, ticket_cols)
    return _per_period(days, ticket_cols.client, F.month(cols.date), "month")


def client_service_avgs(
    lines: DataFrame, tickets: DataFrame, cols: LineColumns = LineColumns(), ticket_cols: TicketColumns = TicketColumns()
) -> DataFrame:
    """Mean services per observed year and per observed month of the year.

    Both means are the client's total over a number of periods, so one aggregation gives
    both: the sum, the few distinct years and a bit mask of months. Each
    dated day has a year and a month, which makes the two sides of the outer join
    the same set of clients.
    """
    days = _ticket_days(lines, tickets, cols, ticket_cols)
    total = F.sum("NumServices").cast("double")
    return days.groupBy(ticket_cols.client).agg(
        (total / F.size(F.collect_set(F.year(cols.date)))).alias("avg_yrly_services"),
        (total / F.bit_count(F.bit_or(F.expr(f"shiftleft(1, month({cols.date}))")))).alias("avg_mnthly_services"),
    )
