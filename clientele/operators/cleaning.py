"""Cleaning of the three input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clientele.columns import ClientColumns, LineColumns, TicketColumns
from clientele.functions.dates import month_name, parse_datetime, time_of_day
from clientele.functions.numbers import safe_bigint
from clientele.functions.text import upper_or_null


def without_clients(df: DataFrame, client: str, blocked: Sequence[str] | DataFrame) -> DataFrame:
    """Drop rows without a client and rows of blocked clients.

    A short list becomes a pushed-down filter; a table of any size an anti join.
    """
    kept = df.na.drop(subset=[client])
    if isinstance(blocked, DataFrame):
        known = blocked.select(F.col(blocked.columns[0]).alias(client))
        return kept.join(known, client, "left_anti").select(*df.columns)
    return kept.filter(~F.col(client).isin(*blocked)) if blocked else kept


def clean_tickets(
    tickets: DataFrame,
    blocked: Sequence[str] | DataFrame = (),
    cols: TicketColumns = TicketColumns(),
    pattern: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """Tickets of known, unblocked clients; a missing total counts as 0.

    ``pattern`` reads the date if it is still text.
    """
    created = F.col(cols.created)
    if dict(tickets.dtypes)[cols.created] == "string":
        created = parse_datetime(created, pattern)
    return (
        without_clients(tickets, cols.client, blocked)
        .na.fill(0.0, [cols.total])
        .withColumn(cols.created, created)
        .withColumn("Bill_Date", F.col(cols.created))
        .withColumn("Bill_Month", month_name(F.col("Bill_Date")))
    )


def without_closed(tickets: DataFrame, ticket: str = "TicketID") -> DataFrame:
    """Drop the status rows that carry the text 'Closed' (or nothing) as their id."""
    return tickets.filter(F.col(ticket).isNotNull() & (F.col(ticket) != "Closed"))


def with_integer_ids(df: DataFrame, ticket: str = "TicketID") -> DataFrame:
    if dict(df.dtypes)[ticket] == "bigint":
        return df
    return df.withColumn(ticket, safe_bigint(F.col(ticket).cast("string")))


def with_line_dates(lines: DataFrame, cols: LineColumns = LineColumns(), pattern: str = "dd-MM-yyyy HH:mm") -> DataFrame:
    """Bill date, full stamp and time of day from the text column, which is dropped."""
    stamp = parse_datetime(F.col(cols.created), pattern)
    return (
        lines.withColumn(cols.stamp, stamp)
        .withColumn(cols.date, F.to_date(cols.stamp))
        .withColumn("Bill_Time", time_of_day(F.col(cols.stamp)))
        .drop(cols.created)
    )


def clean_clients(
    clients: DataFrame,
    blocked: Sequence[str] | DataFrame = (),
    cols: ClientColumns = ClientColumns(),
    patterns: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyy-MM-dd"),
) -> DataFrame:
    """Known, unblocked clients. A creation date that is still text is read by the first
    of ``patterns`` that fits; text that fits none becomes null."""
    known = without_clients(clients, cols.client, blocked)
    if dict(clients.dtypes).get(cols.created) != "string":
        return known
    return known.withColumn(cols.created, F.coalesce(*[parse_datetime(F.col(cols.created), p) for p in patterns]))


def with_clean_sex(df: DataFrame, sex: str = "Sex") -> DataFrame:
    return df.withColumn(sex, upper_or_null(F.col(sex)))


def available_years(tickets: DataFrame, date: str = "Bill_Date") -> DataFrame:
    """The years that have tickets, ascending."""
    return tickets.filter(F.col(date).isNotNull()).select(F.year(date).alias("year")).distinct().orderBy("year")
