"""Joins between tickets, lines and the booking tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clientele.columns import BookingColumns, LineColumns, TicketColumns
from clientele.functions.dates import parse_datetime
from clientele.functions.rows import one_row
from clientele.operators.cleaning import with_integer_ids

#: Patterns of booking dates that are still text, in the order they are tried.
DATES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
#: Tasks that rows with a null key are spread over.
NULL_SALTS = 1024


def lines_with_tickets(
    lines: DataFrame,
    tickets: DataFrame,
    line_cols: LineColumns = LineColumns(),
    ticket_cols: TicketColumns = TicketColumns(),
    null_safe: bool = False,
) -> DataFrame:
    """Every line with its ticket, if there is one.

    The two totals become ``line_total`` and ``ticket_total``. Lines without an id
    match nothing unless ``null_safe`` asks for null ids to match each other.
    """
    left = lines.withColumnRenamed(line_cols.total, "line_total")
    right = tickets.withColumnRenamed(ticket_cols.total, "ticket_total").withColumnRenamed(ticket_cols.ticket, "_ticket")
    left_key, right_key = left[line_cols.ticket], right["_ticket"]
    on = left_key.eqNullSafe(right_key) if null_safe else left_key == right_key
    return left.join(right, on, "left").drop("_ticket")


def null_matches(
    lines: DataFrame, tickets: DataFrame, line_cols: LineColumns = LineColumns(), ticket_cols: TicketColumns = TicketColumns()
) -> DataFrame:
    """What ``null_safe`` matching adds for rows without an id, as one class row: how many there are on either
    side and how many pairs they make. The pairs themselves are every line with every ticket; none is built."""
    left = lines.agg(F.count_if(F.col(line_cols.ticket).isNull()).alias("lines_without_id"))
    right = tickets.agg(F.count_if(F.col(ticket_cols.ticket).isNull()).alias("tickets_without_id"))
    found = left.withColumn("tickets_without_id", one_row(right)["tickets_without_id"])
    pairs = F.col("lines_without_id").cast("decimal(38,0)") * F.greatest("tickets_without_id", F.lit(1)).cast("decimal(38,0)")
    return found.withColumn("result_rows", pairs.cast("bigint"))


def lines_of_clients(
    lines: DataFrame,
    tickets: DataFrame,
    clients: DataFrame,
    line_cols: LineColumns = LineColumns(),
    ticket_cols: TicketColumns = TicketColumns(),
) -> DataFrame:
    """Lines whose ticket belongs to one of ``clients``, with that client's columns.

    Clients meet the tickets before the lines do, the smaller join first.
    """
    owned = tickets.select(ticket_cols.ticket, ticket_cols.client, ticket_cols.total).join(clients, ticket_cols.client)
    return lines_with_tickets(lines, owned, line_cols, ticket_cols).filter(F.col(ticket_cols.client).isNotNull())


def with_group_values(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Add per-group aggregates to every row; rows with a null key get null.

    The aggregate is combined before its shuffle and joined back, so a hot key
    never gathers its rows in one window partition; the join is an ordinary one
    that adaptive execution may broadcast or split. Rows with a null key match nothing;
    a salt spreads them over ``NULL_SALTS`` tasks instead of the one of the null key.
    """
    missing = reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    salt = F.when(missing, F.pmod(F.monotonically_increasing_id(), F.lit(NULL_SALTS)).cast("int")).otherwise(0)
    known = df
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    per_group = known.groupBy(*keys).agg(*[c.alias(name) for name, c in values.items()])
    salted, groups = df.withColumn("_salt", salt), per_group.withColumn("_salt", F.lit(0))
    return salted.join(groups, [*keys, "_salt"], "left").select(*df.columns, *values)


def booking_service_chain(
    booking_services: DataFrame,
    bookings: DataFrame,
    services: DataFrame,
    categories: DataFrame,
    cols: BookingColumns = BookingColumns(),
) -> DataFrame:
    """Booking lines with booking, service and category.

    Bookings and services may be missing; the category must exist for the salon of
    the line, so lines without one drop out. The ``id``/``type_id`` columns of the
    inputs are bound here, booking ids become whole numbers and booking dates timestamps.
    """
    bookings = bookings.withColumnsRenamed({"id": cols.booking})
    bookings = with_integer_ids(bookings, cols.booking)
    if dict(bookings.dtypes).get(cols.date) == "string":
        bookings = bookings.withColumn(cols.date, F.coalesce(*[parse_datetime(F.col(cols.date), p) for p in DATES]))
    booking_services = with_integer_ids(booking_services, cols.booking)
    services = services.withColumnsRenamed({"id": cols.service, "type_id": cols.category})
    categories = categories.withColumnsRenamed({"id": cols.category})
    return (
        booking_services.join(bookings, cols.booking, "left")
        .join(services, cols.service, "left")
        .join(categories, [cols.category, cols.salon], "inner")
    )
