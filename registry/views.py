"""The business tables as views over the star-schema Parquet tables.

The raw views carry dirt by fixed rules (missing clients, 'Closed' ids, unreadable
dates, missing groups), so that cleaning has something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCKED = ("7", "13")
SEX_CODES = {"BUILDING": "f", "HOUSEHOLD": "F", "MACHINERY": "m", "FURNITURE": "M", "AUTOMOBILE": "nan"}


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tickets_raw(self) -> DataFrame:
        key, client = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            F.when(key % 101 == 0, "Closed").otherwise(key.cast("string")).alias("TicketID"),
            F.when(client % 97 != 0, client.cast("string")).alias("ClientID"),
            F.when(key % 50 != 0, F.col("o_totalprice")).alias("Total"),
            F.col("o_orderdate").alias("Created_Date"),
        )

    def _lines(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def lines(self) -> DataFrame:
        """Prepared lines: integer ids and dates."""
        return self._lines().select(
            F.col("l_orderkey").alias("TicketID"),
            F.when(F.col("l_linestatus") == "F", "S").otherwise("P").alias("Type"),
            F.col("p_brand").alias("Descr"),
            (F.col("l_quantity") + 0.375 * (F.col("l_orderkey") % 2)).alias("Qty"),
            F.col("l_extendedprice").alias("Total"),
            F.col("l_shipdate").alias("Bill_Date"),
            F.when(F.col("l_partkey") % 53 != 0, F.col("p_type")).alias("Group1"),
        )

    def lines_raw(self) -> DataFrame:
        hours = F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
        shipped = F.date_format(F.col("l_shipdate") + hours, "dd-MM-yyyy HH:mm")
        return self._lines().select(
            F.col("l_orderkey").cast("string").alias("TicketID"),
            F.when(F.col("l_linestatus") == "F", "S").otherwise("P").alias("Type"),
            F.col("p_brand").alias("Descr"),
            (F.col("l_quantity") + 0.375 * (F.col("l_orderkey") % 2)).alias("Qty"),
            F.col("l_extendedprice").alias("Total"),
            F.when(F.col("l_orderkey") % 89 == 0, "bad").otherwise(shipped).alias("Created_Date2"),
            F.when(F.col("l_partkey") % 53 != 0, F.col("p_type")).alias("Group1"),
        )

    def clients_raw(self) -> DataFrame:
        sex = F.create_map(*[F.lit(x) for item in SEX_CODES.items() for x in item])
        start = F.expr("timestamp_ntz'1995-01-01 00:00:00'")
        days = F.make_dt_interval((F.col("c_custkey") % 2000).cast("int"))
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("ClientID"),
            F.try_element_at(sex, F.col("c_mktsegment")).alias("Sex"),
            F.col("c_name").alias("HomePhone"),
            F.date_format(start + days, "dd-MM-yyyy HH:mm").alias("Create_Date"),
            F.col("c_mktsegment").alias("category"),
        )

    def bookings(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        )

    def booking_services(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("booking_id"),
            F.col("l_partkey").alias("service_id"),
            (F.col("l_suppkey") % 10).alias("salon_id"),
            F.col("l_shipdate").alias("service_date"),
        )

    def services(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_size").alias("type_id"), F.col("p_brand").alias("service_name")
        )

    def categories(self) -> DataFrame:
        sizes = self.table("part").select(F.col("p_size").alias("id")).distinct()
        salons = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))
        return sizes.select("id", salons.alias("salon_id")).filter((F.col("id") + F.col("salon_id")) % 5 != 0)
