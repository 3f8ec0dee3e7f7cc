"""Preparation: clean the three tables and build the client sales table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.columns import ClientColumns, LineColumns, RfmColumns, TicketColumns
from clientele.operators import cleaning
from clientele.operators.services import client_service_avgs, services_per_ticket
from clientele.operators.visits import client_features
from clientele.sources.artefacts import load_tables, save_tables

NAMES = ["tickets", "lines", "clients", "sales"]


@dataclass(frozen=True)
class Prepared:
    tickets: DataFrame
    lines: DataFrame
    clients: DataFrame
    sales: DataFrame

    def save(self, path: str) -> Prepared:
        """Write the four tables and return them as stored.

        Tickets and lines are laid out by date, so jobs for one year skip most files;
        the id in the range key splits busy dates. Sales are computed from the stored
        tables, so the raw exports are parsed once.
        """
        by_date = {
            "tickets": self.tickets.repartitionByRange("Bill_Date", TicketColumns().ticket),
            "lines": self.lines.repartitionByRange(LineColumns().date, LineColumns().ticket),
        }
        save_tables({**by_date, "clients": self.clients}, path)
        spark = self.tickets.sparkSession
        stored = load_tables(spark, ["tickets", "lines", "clients"], path)
        save_tables({"sales": client_sales(**stored)}, path)
        return load(spark, path)

    def register(self) -> None:
        """Make the tables available to SQL as temporary views."""
        for name in NAMES:
            getattr(self, name).createOrReplaceTempView(name)


def load(spark: SparkSession, path: str) -> Prepared:
    return Prepared(**load_tables(spark, NAMES, path))


def client_sales(
    tickets: DataFrame,
    lines: DataFrame,
    clients: DataFrame,
    unique_clients: bool = False,
    ticket_cols: TicketColumns = TicketColumns(),
    line_cols: LineColumns = LineColumns(),
    client_cols: ClientColumns = ClientColumns(),
) -> DataFrame:
    """Visit features, service averages and client attributes, one row per client.

    A client id that occurs twice in ``clients`` gives two rows, unless
    ``unique_clients`` keeps one of them (the greatest, so that a known sex wins).
    """
    rfm_cols = RfmColumns(ticket_cols.client, ticket_cols.created, ticket_cols.total)
    attributes = clients.select(client_cols.client, client_cols.sex, client_cols.phone)
    if unique_clients:
        kept = F.max(F.struct(client_cols.sex, client_cols.phone)).alias("kept")
        attributes = attributes.groupBy(client_cols.client).agg(kept).select(client_cols.client, "kept.*")
    sales = (
        client_features(tickets, rfm_cols)
        .join(client_service_avgs(lines, tickets, line_cols, ticket_cols), ticket_cols.client, "left")
        .join(attributes.withColumnRenamed(client_cols.client, ticket_cols.client), ticket_cols.client, "left")
    )
    return cleaning.with_clean_sex(sales, client_cols.sex)


def prepare_tables(
    tickets: DataFrame, lines: DataFrame, clients: DataFrame, blocked: Sequence[str] | DataFrame = ()
) -> Prepared:
    """From the raw exports to the four tables the other jobs read.

    Lazy: ``save`` computes each table once.
    """
    clean = cleaning.with_integer_ids(cleaning.clean_tickets(tickets, blocked))
    dated = cleaning.with_line_dates(cleaning.with_integer_ids(lines))
    known = cleaning.clean_clients(clients, blocked)
    return Prepared(clean, services_per_ticket(dated), known, client_sales(clean, dated, known))
