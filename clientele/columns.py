"""Column bindings: which column of an input table plays which role.

Every job takes its input tables plus one of these, so tables with other
column names need a binding, not a rename.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TicketColumns:
    """Tickets (bills), one row per bill."""

    ticket: str = "TicketID"
    client: str = "ClientID"
    total: str = "Total"
    created: str = "Created_Date"


@dataclass(frozen=True)
class LineColumns:
    """Ticket lines, one row per service or product on a bill."""

    ticket: str = "TicketID"
    kind: str = "Type"
    item: str = "Descr"
    quantity: str = "Qty"
    total: str = "Total"
    created: str = "Created_Date2"
    date: str = "Bill_Date"
    stamp: str = "Bill_Stamp"
    group: str = "Group1"
    service_kind: str = "S"
    product_kind: str = "P"


@dataclass(frozen=True)
class ClientColumns:
    """Client master data."""

    client: str = "ClientID"
    sex: str = "Sex"
    phone: str = "HomePhone"
    created: str = "Create_Date"
    category: str = "category"


@dataclass(frozen=True)
class RfmColumns:
    """Input of the RFM job: any table with a client, a date and an amount."""

    client: str = "ClientID"
    date: str = "Created_Date"
    spend: str = "Total"


@dataclass(frozen=True)
class BookingColumns:
    """Input of the four-table recommender."""

    booking: str = "booking_id"
    client: str = "user_id"
    service: str = "service_id"
    category: str = "service_cat_id"
    service_name: str = "service_name"
    salon: str = "salon_id"
    date: str = "date"
