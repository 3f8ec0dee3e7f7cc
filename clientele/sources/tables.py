"""Readers with declared schemas, bound by column name.

Columns whose exports mix types (ids, dates) are read as text and converted by the
cleaning operators. Of a CSV only the header lines are read beforehand; no types are inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TICKETS = "TicketID string, ClientID string, Total double, Created_Date string"
LINES = (
    "TicketID string, Type string, Descr string, Qty double, Total double, Created_Date2 string, Group1 string"
)
CLIENTS = (
    "ClientID string, FirstName string, LastName string, Sex string, HomePhone string, DOB string, "
    "category string, survey string, MembershipCardNo string, Membership_Date string, Create_Date string"
)


def by_name(df: DataFrame, schema: str) -> DataFrame:
    """The declared columns in their types, wherever they are in ``df``; others are left out.

    A value that does not fit its type becomes null; a column that is not there is an error.
    """
    fields = StructType.fromDDL(schema).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def files_by_header(spark: SparkSession, path: str, encoding: str) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` by their header line. Contents are not read; files without a line are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    found: dict[tuple[str, ...], list[str]] = {}
    for row in listed.load(path).select("path").orderBy("path").collect():
        header = tuple(spark.read.option("header", True).option("encoding", encoding).csv(row.path).columns)
        if header:
            found.setdefault(header, []).append(row.path)
    return found


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """CSV with a header line, Latin-1 by default; every file of a folder is bound by its own header.

    Files of one header are read together, so there is one scan for each order of columns. Exports are few files:
    the driver reads one line of each.
    """
    one = spark.read.option("header", True).option("encoding", encoding)
    headers = files_by_header(spark, path, encoding)
    if len(headers) <= 1:  # also a file with another ending, and a folder partitioned by its names
        return by_name(one.csv(path), schema)
    parts = [by_name(one.csv(files), schema) for _, files in sorted(headers.items())]
    return reduce(DataFrame.unionByName, parts)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TICKETS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The ticket lines, delivered as Parquet or as CSV."""
    if path.endswith(".csv"):
        return read_csv(spark, path, LINES)
    return by_name(spark.read.parquet(path), LINES)


def read_clients(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CLIENTS)


def client_contacts(clients: DataFrame) -> DataFrame:
    """The contact columns that accompany an export."""
    return clients.select(
        "ClientID", "FirstName", "LastName", "HomePhone", "Sex", "DOB", "survey", "MembershipCardNo", "Membership_Date"
    )
