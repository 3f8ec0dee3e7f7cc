"""Cleaning, joins, service counts, dashboard figures and files on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clientele.columns import LineColumns
from clientele.functions import numbers
from clientele.operators import cleaning, dashboard, joins, recommend, services
from clientele.plans import prepare, recommender
from clientele.sources import exports, tables


def day(text):
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M") if " " in text else dt.datetime.strptime(text, "%Y-%m-%d")


@pytest.fixture(scope="module")
def raw(spark):
    tickets = spark.createDataFrame(
        [
            ("1", "ann", 10.0, "2022-12-31 10:00:00"),
            ("2", "ann", None, "2023-01-05 09:00:00"),
            ("3.0", "bob", 7.5, "2023-01-05 18:00:00"),
            ("Closed", "bob", 99.0, "2023-02-01 08:00:00"),
            ("4", None, 5.0, "2023-03-01 08:00:00"),
            ("5", "junk", 6.0, "2023-03-01 08:00:00"),
            (None, "eve", 1.0, "2023-02-03 07:00:00"),
        ],
        tables.TICKETS,
    )
    lines = spark.createDataFrame(
        [
            ("1", "S", "cut", 1.0, 6.0, "31-12-2022 10:00", "hair"),
            ("1", "S", "dye", 1.0, 4.0, "31-12-2022 10:05", "hair"),
            ("1", "P", "soap", 2.0, 3.0, "01-01-2023 10:05", None),
            ("2", "P", "soap", 1.0, 1.5, "05-01-2023 09:00", None),
            ("3", "S", "cut", 1.0, 7.5, "05-01-2023 18:00", "hair"),
            ("3", "S", "cut", 1.0, 7.5, "bad", "hair"),
            ("Closed", "S", "cut", 1.0, 1.0, "01-02-2023 08:00", "hair"),
            ("77", "S", "cut", 1.0, 1.0, "01-02-2023 08:00", "hair"),
        ],
        tables.LINES,
    )
    clients = spark.createDataFrame(
        [("ann", "f", "1"), ("bob", "nan", "2"), ("bob", "M", "3"), (None, "m", "4"), ("junk", "m", "5")],
        "ClientID string, Sex string, HomePhone string",
    )
    return tickets, lines, clients


def test_clean_tickets(raw, rows, spark):
    cleaned = cleaning.clean_tickets(raw[0], ["junk"])
    assert rows(cleaned, "ClientID", "Total", "Bill_Month") == [
        ("ann", 0.0, "January"),
        ("ann", 10.0, "December"),
        ("bob", 7.5, "January"),
        ("bob", 99.0, "February"),
        ("eve", 1.0, "February"),
    ]
    by_table = cleaning.clean_tickets(raw[0], spark.createDataFrame([("junk",)], "id string"))
    assert rows(by_table) == rows(cleaned)
    assert rows(cleaning.available_years(cleaned)) == [(2022,), (2023,)]


def test_ids_and_status_rows(raw, rows):
    assert raw[0].count() - cleaning.without_closed(raw[0]).count() == 2
    ids = rows(cleaning.with_integer_ids(raw[0]), "TicketID")
    assert ids == [(1,), (2,), (3,), (4,), (5,), (None,), (None,)]


def test_line_dates(raw, rows):
    dated = cleaning.with_line_dates(raw[1]).filter("TicketID = '3'")
    assert rows(dated, "Bill_Date", "Bill_Time") == [(dt.date(2023, 1, 5), "18:00:00"), (None, None)]


def test_null_ids_match_only_on_request(raw):
    tickets, lines = (cleaning.with_integer_ids(d) for d in raw[:2])
    plain = joins.lines_with_tickets(lines, tickets)
    assert plain.count() == lines.count()
    assert plain.filter("TicketID is null and ClientID is not null").count() == 0
    safe = joins.lines_with_tickets(lines, tickets, null_safe=True)
    assert safe.filter("TicketID is null").count() == 2  # the one line meets both tickets without an id
    assert {"line_total", "ticket_total"} <= set(safe.columns)


def test_services_per_ticket(raw, rows):
    counted = services.services_per_ticket(cleaning.with_line_dates(cleaning.with_integer_ids(raw[1])))
    assert rows(counted.filter("TicketID <= 3"), "TicketID", "Descr", "NumServices") == [
        (1, "cut", 2),
        (1, "dye", 2),
        (1, "soap", None),
        (2, "soap", None),
        (3, "cut", 2),
        (3, "cut", 2),
    ]
    assert rows(counted.filter("TicketID is null"), "NumServices") == [(None,)]


def test_service_averages(raw, rows):
    tickets = cleaning.with_integer_ids(cleaning.clean_tickets(raw[0], ["junk"]))
    lines = cleaning.with_line_dates(cleaning.with_integer_ids(raw[1]))
    assert rows(services.services_per_year(lines, tickets)) == [("ann", 2022, 2), ("ann", 2023, 0), ("bob", 2023, 2)]
    assert rows(services.services_per_month(lines, tickets)) == [("ann", 1, 0), ("ann", 12, 2), ("bob", 1, 2)]
    assert rows(services.client_service_avgs(lines, tickets)) == [("ann", 1.0, 1.0), ("bob", 2.0, 2.0)]
    twice = tickets.union(tickets)
    assert rows(services.client_service_avgs(lines, twice)) == [("ann", 1.0, 1.0), ("bob", 2.0, 2.0)]


def test_prepared_tables(spark, raw, rows, tmp_path):
    prepared = prepare.prepare_tables(*raw, blocked=["junk"])
    saved = prepared.save(str(tmp_path))
    loaded = prepare.load(spark, str(tmp_path))
    assert rows(saved.sales) == rows(loaded.sales) == rows(prepared.sales)
    loaded.register()
    columns = ["ClientID", "TotalSpend", "NumVisits", "DaysSinceLastVisit", "Sex", "HomePhone"]
    assert rows(spark.table("sales"), *columns) == [
        ("ann", 10.0, 2, 28, "F", "1"),
        ("bob", 106.5, 2, 1, "M", "3"),
        ("bob", 106.5, 2, 1, None, "2"),
        ("eve", 1.0, 1, 0, None, None),
    ]
    one_each = prepare.client_sales(loaded.tickets, loaded.lines, loaded.clients, unique_clients=True)
    assert one_each.count() == 3
    assert loaded.lines.count() == raw[1].count()


def test_best_day_and_month_ties(spark):
    data = [("2023-03-02", 5.0), ("2023-03-01", 5.0), ("2023-04-01", 10.0), ("2022-01-01", 99.0)]
    tickets = spark.createDataFrame([(day(d), t) for d, t in data], "Bill_Date timestamp_ntz, Total double")
    daily = dashboard.daily_revenue(tickets.filter("Total < 10"), 2023)
    assert dashboard.best_day(daily).first()["Bill_Date"] == dt.date(2023, 3, 1)
    monthly = dashboard.monthly_revenue(dashboard.daily_revenue(tickets, 2023))
    assert tuple(dashboard.best_month(monthly).first()) == ("April", 10.0)
    summary = dashboard.revenue_summary(tickets, 2023).first()
    assert summary["sentence"] == (
        "You made a total revenue of **₹20.00** in 2023. Your biggest day of sales was on **April 01, 2023** where you "
        "made **₹10.00**. Your biggest month of sales was in **April** when you made **₹10.00**"
    )


def test_top_items_ties_and_text(spark, rows):
    data = [("S", s, 1.0, 2.0) for s in "bbaaccd"] + [("P", "soap", 7.0, 3.0), ("S", None, 1.0, 1.0)]
    lines = spark.createDataFrame(
        [(1, k, i, q, t, day("2023-05-01")) for k, i, q, t in data],
        "TicketID bigint, Type string, Descr string, Qty double, Total double, Bill_Date timestamp_ntz",
    )
    top = dashboard.top_items(dashboard.service_counts(lines, 2023))
    assert [tuple(r) for r in top.collect()] == [("a", 2, 4.0), ("b", 2, 4.0), ("c", 2, 4.0)]
    text = dashboard.top_items_text(top, dashboard.SERVICES_SENTENCE).first()
    assert (text["names"], text["frequencies"], text["revenues"]) == ("'a', 'b', 'c'", "[2, 2, 2]", "₹4.00, ₹4.00, ₹4.00")
    assert rows(dashboard.product_counts(lines, 2023)) == [("soap", 7.0, 3.0)]
    assert rows(dashboard.trend_by_month(lines, "S", 2023)) == [(5, "May", 8)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date"])
def test_year_filter_reaches_the_scan(spark, tmp_path, kind):
    frame = spark.createDataFrame([(day("2023-05-01"), 1.0)], "Bill_Date timestamp_ntz, Total double")
    frame.withColumn("Bill_Date", F.col("Bill_Date").cast(kind)).write.parquet(str(tmp_path / "t"))
    plan = dashboard.daily_revenue(spark.read.parquet(str(tmp_path / "t")), 2023)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(Bill_Date" in pushed and "LessThan(Bill_Date" in pushed


def test_latin1_files(spark, tmp_path, rows):
    people = spark.createDataFrame([("1", "Zoë, \"ÀÿÖ\""), ("2", None)], "ClientID string, FirstName string")
    exports.write_csv(people, str(tmp_path / "latin"), encoding="ISO-8859-1")
    assert rows(tables.read_csv(spark, str(tmp_path / "latin"), "ClientID string, FirstName string")) == rows(people)
    raw_bytes = b"".join(p.read_bytes() for p in (tmp_path / "latin").glob("part-*"))
    assert "Zoë".encode("latin-1") in raw_bytes
    (tmp_path / "clients.csv").write_text(
        "ClientID,FirstName,LastName,Sex,HomePhone,DOB,category,survey,MembershipCardNo,Membership_Date,Create_Date\n"
        "7,Zoë,X,f,1,,VIP,,,,2023-01-01 00:00:00\n",
        encoding="latin-1",
    )
    clients = tables.read_clients(spark, str(tmp_path / "clients.csv"))
    assert clients.first()["FirstName"] == "Zoë"
    assert tables.client_contacts(clients).columns[0] == "ClientID"


def test_readers_of_tickets_and_lines(spark, raw, rows, tmp_path):
    exports.write_csv(raw[0], str(tmp_path / "t.csv"), "ISO-8859-1")
    assert rows(tables.read_tickets(spark, str(tmp_path / "t.csv"))) == rows(raw[0])
    exports.write_csv(raw[1], str(tmp_path / "l.csv"), "ISO-8859-1")
    raw[1].write.parquet(str(tmp_path / "l.parquet"))
    assert rows(tables.read_lines(spark, str(tmp_path / "l.csv"))) == rows(raw[1])
    assert rows(tables.read_lines(spark, str(tmp_path / "l.parquet"))) == rows(raw[1])


def test_ticket_frequencies_and_wide_export(raw, rows):
    freq = recommender.ticket_service_freq(raw[1], raw[0])
    assert rows(freq) == [("ann", "cut", 1), ("ann", "dye", 1), ("bob", "cut", 2)]
    wide = recommend.client_service_pivot(freq)
    assert wide.columns == ["client", "cut", "dye"]
    assert rows(wide) == [("ann", 1, 1), ("bob", 2, 0)]
    counted = recommend.with_frequency(recommender.ticket_services(raw[1], raw[0]), "ClientID", "Descr")
    assert counted.filter("ClientID is null and Frequency is not null").count() == 0


def test_booking_chain_needs_the_category(spark, rows):
    lines = spark.createDataFrame([(1, 10, 0), (1, 11, 0), (2, 10, 1), (3, 99, 0)], "booking_id int, service_id int, salon_id int")
    bookings = spark.createDataFrame([(1, "ann")], "id int, user_id string")
    details = spark.createDataFrame([(10, 5, "cut"), (11, 6, "dye")], "id int, type_id int, service_name string")
    categories = spark.createDataFrame([(5, 0), (5, 1)], "id int, salon_id int")
    chain = joins.booking_service_chain(lines, bookings, details, categories)
    assert rows(chain, "booking_id", "user_id", "service_name", "salon_id") == [(1, "ann", "cut", 0), (2, None, "cut", 1)]


def test_messages(spark):
    top = spark.createDataFrame([("ann", "dye", 0.845, 1), ("ann", "wax", 0.835, 2)], "client string, service string, score double, rank int")
    taken = spark.createDataFrame([("ann", "cut, nails")], "client string, services_taken string")
    row = recommend.messages(top, taken).first()
    assert row["greeting"] == "Dear ann,"
    assert row["reason"].startswith("Because you've taken: cut, nails in the past, we recommend")
    assert row["recommendations"] == "1. dye - 84% Match\n2. wax - 84% Match"
    report = recommend.confidence_report(top).orderBy("rank").collect()
    assert [r["Confidence Match"] for r in report] == ["84%", "84%"]


def test_other_column_names(spark, rows):
    cols = LineColumns(ticket="bill", kind="sort", item="what", service_kind="service")
    lines = spark.createDataFrame([(1, "service", "cut"), (1, "good", "soap")], "bill bigint, sort string, what string")
    assert rows(services.services_per_ticket(lines, cols), "what", "NumServices") == [("cut", 1), ("soap", None)]


def test_group_values_leave_null_keys_alone(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    got = joins.with_group_values(df, ["k"], n=F.count("*"), top=F.max("v"))
    assert rows(got, "v", "n", "top") == [(1, 2, 2), (2, 2, 2), (3, None, None)]


def test_columns_are_bound_by_name(spark, tmp_path):
    path = str(tmp_path / "tickets.csv")
    spark.createDataFrame([("new", "2023-01-05 09:00:00", "ann", "7", "12.5"), (None, "bad", None, "8", "no number")], "Note string, Created_Date string, ClientID string, TicketID string, Total string").write.option("header", True).csv(path)
    read = tables.read_tickets(spark, path)
    assert read.columns == ["TicketID", "ClientID", "Total", "Created_Date"]
    assert sorted(tuple(r) for r in read.collect()) == [("7", "ann", 12.5, "2023-01-05 09:00:00"), ("8", None, None, "bad")]
    with pytest.raises(ValueError, match="FirstName"):
        tables.read_clients(spark, path)


def test_parquet_lines_with_whole_numbers_as_ids(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(5, "S", "cut", 1, 2.5, "05-01-2023 09:00", None)], "TicketID long, Type string, Descr string, Qty int, Total double, Created_Date2 string, Group1 string").write.parquet(path)
    assert tuple(tables.read_lines(spark, path).first()) == ("5", "S", "cut", 1.0, 2.5, "05-01-2023 09:00", None)


def test_quantities_and_small_amounts_are_not_rounded(spark):
    lines = [("1", "P", "soap", 1.255, 0.004, dt.datetime(2023, 1, 5))] * 2 + [("1", "P", "comb", 0.75, 1.0, dt.datetime(2023, 1, 5))]
    counts = dashboard.product_counts(spark.createDataFrame(lines, "TicketID string, Type string, Descr string, Qty double, Total double, Bill_Date timestamp"), 2023)
    assert {r.Descr: (r.frequency, r.total_sum) for r in counts.collect()} == {"soap": (2.51, 0.008), "comb": (0.75, 1.0)}
    assert dashboard.top_items_text(counts, "%s %s %s").first().frequencies == "[2.51, 0.75]"


def test_time_of_day_counts_for_recency(spark):
    from clientele.plans import rfm

    lines = cleaning.with_line_dates(spark.createDataFrame([("1", "01-01-2023 23:00"), ("2", "03-01-2023 01:00")], "TicketID string, Created_Date2 string"))
    tickets = spark.createDataFrame([("1", "ann", 1.0), ("2", "bob", 2.0)], "TicketID string, ClientID string, Total double")
    assert {r.ClientID: r.Recency for r in rfm.line_features(lines, tickets).collect()} == {"ann": 1, "bob": 0}


def test_client_dates_as_text(spark):
    clients = spark.createDataFrame([("a", "05-01-2023 10:00"), ("b", "2023-02-03 07:00:00"), ("c", "2023-02-04"), ("d", "soon")], "ClientID string, Create_Date string")
    read = {r.ClientID: r.Create_Date for r in cleaning.clean_clients(clients).collect()}
    assert read == {"a": dt.datetime(2023, 1, 5, 10), "b": dt.datetime(2023, 2, 3, 7), "c": dt.datetime(2023, 2, 4), "d": None}


def test_each_file_of_a_folder_is_bound_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "clients"
    folder.mkdir()
    (folder / "a.csv").write_bytes("ClientID,FirstName\n1,Zoë\n".encode("latin-1"))
    (folder / "b.csv").write_bytes(b"FirstName,Extra,ClientID\nBob,x,2\n")
    (folder / "c.csv").write_bytes(b"ClientID,FirstName\n3,Ann\n")
    found = tables.read_csv(spark, str(folder), "ClientID string, FirstName string")
    assert sorted(tuple(r) for r in found.collect()) == [("1", "Zoë"), ("2", "Bob"), ("3", "Ann")]
    (folder / "d.csv").write_bytes(b"FirstName\nno id\n")
    with pytest.raises(ValueError, match="no column ClientID"):
        tables.read_csv(spark, str(folder), "ClientID string, FirstName string")


def test_a_million_null_rows_on_each_side_are_one_class_row(spark):
    lines = spark.range(1_000_000).select(F.lit(None).cast("bigint").alias("TicketID"))
    found = joins.null_matches(lines, lines.withColumn("Total", F.lit(1.0))).collect()
    assert [tuple(r) for r in found] == [(1_000_000, 1_000_000, 10**12)]
    alone = joins.null_matches(lines, lines.limit(0)).first()
    assert tuple(alone) == (1_000_000, 0, 1_000_000)


def test_rows_with_a_null_key_are_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id") % 50).alias("TicketID"), F.lit("S").alias("Type"))
    found = joins.with_group_values(rows, ["TicketID"], n=F.count("*"))
    assert found.columns == ["TicketID", "Type", "n"]
    assert found.filter("TicketID IS NULL AND n IS NULL").count() == 10_000
    salted = rows.select(F.when(F.col("TicketID").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(joins.NULL_SALTS))).alias("s")).filter("s IS NOT NULL")
    assert salted.groupBy("s").count().agg(F.max("count")).first()[0] < 100
    assert found.filter("TicketID = 7").select("n").distinct().collect()[0].n == rows.filter("TicketID = 7").count()


@pytest.mark.parametrize("text,want", [("12", 12), ("12.0", 12), ("12.", 12), ("+7", 7), ("-7.00", -7), (" 12 ", 12), ("1e3", 1000), ("9007199254740993", 9007199254740993),
                                       ("9223372036854775807", 9223372036854775807), ("99999999999999999999", None), ("12.5", None), ("Closed", None), ("", None), (None, None), ("12a", None), (".0", 0)])
def test_ids_from_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(numbers.safe_bigint(F.col("c"))).first()[0] == want
