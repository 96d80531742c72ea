"""Calendars and cards of wire text made from the tables of orders, customers and suppliers, as input for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import columns, text

EOL = "\r\n"


def lines(*parts: Column | str) -> Column:
    """Lines of wire text, each ended; a null one is left out."""
    each = [F.coalesce(F.concat(F.lit(p) if isinstance(p, str) else p, F.lit(EOL)), F.lit("")) for p in parts]
    return F.concat(*each)


def prop(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), value)


def calendar(body: Column) -> Column:
    return F.concat(F.lit(f"BEGIN:VCALENDAR{EOL}VERSION:2.0{EOL}PRODID:-//orders//EN{EOL}"), body, F.lit(f"END:VCALENDAR{EOL}"))


def component(name: str, *parts: Column | str) -> Column:
    return lines(f"BEGIN:{name}", *parts, f"END:{name}")


def order_event(*more: Column | str) -> Column:
    """An event for an order; its key is its UID, its date its start."""
    start = prop("DTSTART", columns.format_datetime(F.col("o_orderdate")))
    return component("VEVENT", prop("UID", F.col("o_orderkey").cast("string")), start, prop("SUMMARY", text.escape_text(F.concat_ws(", ", "o_orderpriority", "o_orderstatus"))), *more)


def calendars_of_customers(orders: DataFrame, event: Column | None = None) -> DataFrame:
    """doc_id (the customer) and content: one calendar for each customer's orders."""
    rows = orders.select("o_custkey", F.struct("o_orderkey", (event if event is not None else order_event()).alias("event")).alias("e"))
    held = rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list("e")).alias("es"))
    return held.select("doc_id", calendar(F.array_join(F.transform("es", lambda e: e["event"]), "")).alias("content"))


def calendars_of_orders(orders: DataFrame, *more: Column | str) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("doc_id"), calendar(order_event(*more)).alias("content"))


def cards(customers: DataFrame) -> DataFrame:
    """A card for each customer."""
    key = F.col("c_custkey").cast("string")
    name = text.escape_text(F.col("c_name"))
    body = [
        "VERSION:4.0",
        prop("FN", name),
        F.concat(F.lit("N:"), name, F.lit(";Given,Second;;Dr.;")),
        F.concat(F.lit("TEL;TYPE=work,voice;TYPE=x"), (F.col("c_nationkey")).cast("string"), F.lit(":+"), key),
        F.concat(F.lit('item1.EMAIL;TYPE="home":'), key, F.lit("@example.com")),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("EMAIL:"), key, F.lit("@example.org"))),
        prop("CATEGORIES", F.concat(F.lower("c_mktsegment"), F.lit(",a\\,b"))),
        F.concat(F.lit("NOTE;X-P=\"semi;colon\",^'quoted^':balance "), F.col("c_acctbal").cast("decimal(12,2)").cast("string")),
    ]
    return customers.select(F.col("c_custkey").alias("doc_id"), component("VCARD", *body).alias("content"))
