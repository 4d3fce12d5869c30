"""Relational question library over the logistics views.

Each function takes a :class:`Warehouse` and returns a lazy DataFrame. Joins
carry no broadcast hints: Spark's size-checked auto-broadcast and AQE choose
the strategy from plan statistics, so a dimension that grows past the
threshold falls back to a shuffle join by itself. Measures are pre-aggregated
per key before joins that would fan out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions import mean_of_decimal, month_bucket, quarter_label, rate_pct


def _between(column: str, start: str, end: str) -> Column:
    """Half-open date bounds, which reach the scan."""
    return (F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date"))


# ---------------------------------------------------------------- 2.2 filters


def b1_projection(wh) -> DataFrame:
    s = wh.shipments
    return s.select(F.col("shipment_id").alias("shipment"), F.col("origin_country").alias("origin"),
                    F.col("destination_country").alias("destination"), F.col("mode").alias("transport_mode"))


def b2_delayed_shipments(wh) -> DataFrame:
    return (wh.shipments.filter(F.col("status") == "delayed")
            .select("shipment_id", "origin_country", "destination_country", "delay_days", "delay_reason"))


def b3_heavy_shipments(wh) -> DataFrame:
    return wh.shipments.filter(F.col("weight_kg") > 20000).select("shipment_id", "mode", "weight_kg")


def b4_delivered_air(wh) -> DataFrame:
    s = wh.shipments
    return (s.filter((F.col("status") == "delivered") & (F.col("mode") == "air") & (F.col("delay_days") > 0))
            .select("shipment_id", "carrier_id", "delay_days"))


def b5_null_checks(wh) -> DataFrame:
    c = wh.carriers.filter(F.col("headquarters_country").isNull()).agg(F.count("*").alias("n"))
    s = wh.shipments.filter(F.col("delay_reason").isNotNull()).agg(F.count("*").alias("n"))
    return (c.select(F.lit("carriers_without_hq").alias("check_name"), F.col("n").alias("row_count"))
            .unionByName(s.select(F.lit("shipments_with_delay_reason").alias("check_name"),
                                  F.col("n").alias("row_count"))))


def b6_invoices_not_cancelled(wh) -> DataFrame:
    i = wh.invoices.filter(F.col("payment_status") != "cancelled")
    return i.groupBy("payment_status").agg(F.count("*").alias("invoice_count"))


def b7_milestone_events(wh) -> DataFrame:
    return (wh.tracking_events.filter(F.col("is_milestone"))
            .groupBy("event_type").agg(F.count("*").alias("event_count")))


def b8_booked_in_month(wh, start: str = "1998-01-01", end: str = "1998-02-01") -> DataFrame:
    s = wh.shipments
    return (s.filter((F.col("booking_date") >= F.lit(start).cast("date"))
                     & (F.col("booking_date") < F.lit(end).cast("date")))
            .select("shipment_id", "mode", "status", "booking_date"))


def b9_calendar_periods(wh) -> DataFrame:
    periods = {"year_1998": ("1998-01-01", "1999-01-01"), "q3_1999": ("1999-07-01", "1999-10-01"),
               "h1_2000": ("2000-01-01", "2000-07-01"), "mar_may_1996": ("1996-03-01", "1996-06-01")}
    inside = {name: _between("booking_date", *bounds) for name, bounds in periods.items()}
    s = wh.shipments.filter(reduce(Column.__or__, inside.values()))  # pushed: row groups of other dates are skipped
    return s.agg(*[F.count_if(cond).alias(name) for name, cond in inside.items()])


def b10_relative_periods(wh, as_of: str = SETTINGS.as_of) -> DataFrame:
    d, a = F.col("booking_date"), F.lit(as_of).cast("date")
    q_start = F.trunc(a, "quarter")
    # the last quarter begins before any of the other periods
    s = wh.shipments.filter((d >= F.least(F.add_months(q_start, -3), F.date_sub(a, 29))) & (d <= a))
    return s.agg(
        F.count_if((d > F.date_sub(a, 30)) & (d <= a)).alias("last_30_days"),
        F.count_if((d > F.date_sub(a, 7)) & (d <= a)).alias("past_week"),
        F.count_if((d >= F.add_months(q_start, -3)) & (d < q_start)).alias("last_quarter"))


def b11_past_due_pending(wh, as_of: str = SETTINGS.as_of) -> DataFrame:
    i = wh.invoices.filter((F.col("due_date") < F.lit(as_of).cast("date")) & (F.col("payment_status") == "pending"))
    return i.agg(F.count("*").alias("past_due_count"), F.sum("total_usd").alias("past_due_amount"))


def b12_paid_within_30(wh) -> DataFrame:
    i = wh.invoices.filter(F.col("payment_status") == "paid")
    return i.agg(F.count_if(F.datediff("payment_date", "invoice_date") <= 30).alias("paid_within_30"),
                 F.count("*").alias("paid_total"))


def b13_early_arrivals(wh) -> DataFrame:
    s = wh.shipments.filter(F.col("actual_arrival") < F.col("estimated_arrival"))
    return s.select("shipment_id", "estimated_arrival", "actual_arrival")


def b14_distinct_routes(wh) -> DataFrame:
    return wh.shipments.select("origin_country", "destination_country").distinct()


def b15_in_list(wh) -> DataFrame:
    s = wh.shipments.filter(F.col("mode").isin("ocean", "air"))
    return s.groupBy("mode").agg(F.count("*").alias("shipment_count"))


def b16_in_subquery(wh) -> DataFrame:
    gold = wh.customers.filter(F.col("tier") == "gold").select(F.col("id").alias("customer_id"))
    s = wh.shipments.join(gold, "customer_id", "left_semi")
    return s.groupBy("mode").agg(F.count("*").alias("shipment_count"))


def b17_name_match(wh, needle: str = "maersk") -> DataFrame:
    c = wh.carriers.filter(F.col("carrier_name").ilike(f"%{needle}%"))
    s = wh.shipments.join(c.select(F.col("id").alias("carrier_id"), "carrier_name"), "carrier_id")
    return s.groupBy("carrier_name").agg(F.count("*").alias("shipment_count"))


def b18_point_hit(wh) -> DataFrame:
    """A point lookup whose id comes from the table: the shipment booked last."""
    last = wh.shipments.agg(F.max_by("shipment_id", F.struct("booking_date", "shipment_id")).alias("shipment_id"))
    return wh.shipments.join(last, "shipment_id").select("shipment_id", "status", "mode")


def b18_point_lookup(wh, shipment_id: str = "SHP-00100") -> DataFrame:
    return wh.shipments.filter(F.col("shipment_id") == shipment_id).select("shipment_id", "status", "mode")


def b19_json_field_filter(wh, prefix: str = "BL-1998-") -> DataFrame:
    e = wh.extracted_documents
    bl = F.get_json_object("extracted_fields", "$.bl_number")
    return (e.filter(bl.startswith(prefix))
            .select("document_id", "document_type", "overall_confidence", "review_status",
                    bl.alias("bl_number"),
                    F.get_json_object("extracted_fields", "$.shipper_name").alias("shipper_name"),
                    F.get_json_object("extracted_fields", "$.vessel_name").alias("vessel_name")))


# ---------------------------------------------------------------- 2.3 joins


def _carrier_dim(wh) -> DataFrame:
    return wh.carriers.select(F.col("id").alias("carrier_id"), "carrier_name", "carrier_type",
                              "reliability_score")


def c1_shipments_per_carrier(wh) -> DataFrame:
    per = wh.shipments.groupBy("carrier_id").agg(F.count("*").alias("shipment_count"))
    return per.join(_carrier_dim(wh), "carrier_id").select("carrier_name", "carrier_type", "shipment_count")


def c2_avg_freight_by_carrier(wh) -> DataFrame:
    fr = wh.shipment_charges.filter(F.col("charge_type") == "freight")
    j = fr.join(wh.shipments.select(F.col("id").alias("shipment_id"), "carrier_id"), "shipment_id")
    per = j.groupBy("carrier_id").agg(F.sum("amount_usd").alias("s"), F.count("amount_usd").alias("n"))
    return (per.join(_carrier_dim(wh), "carrier_id")
            .select("carrier_name", F.round(F.col("s").cast("double") / F.col("n"), 2).alias("avg_freight")))


def c3_four_table(wh) -> DataFrame:
    ev = (wh.tracking_events.filter(F.col("event_type") == "delivered")
          .groupBy("shipment_id").agg(F.count("*").alias("n_delivered")))
    s = wh.shipments.select(F.col("id").alias("shipment_id"), "customer_id")
    inv = wh.invoices.select("shipment_id", "total_usd")
    cu = wh.customers.select(F.col("id").alias("customer_id"), "tier")
    j = ev.join(s, "shipment_id").join(inv, "shipment_id").join(cu, "customer_id")
    return j.groupBy("tier").agg(F.count("*").alias("delivered_shipments"),
                                 F.sum("total_usd").alias("invoiced_usd"))


def carrier_performance(wh) -> DataFrame:
    """C4 / flagship: on-time rate and mean cost per carrier, top 10 by volume."""
    cost = wh.shipment_charges.groupBy("shipment_id").agg(F.sum("amount_usd").alias("total_cost"))
    s = wh.shipments.select(F.col("id").alias("shipment_id"), "carrier_id", "status", "delay_days")
    j = s.join(cost, "shipment_id", "left")
    delivered = F.col("status") == "delivered"
    per = j.groupBy("carrier_id").agg(
        F.count("*").alias("total_shipments"),
        F.sum(F.when((F.col("delay_days") == 0) & delivered, 1).otherwise(0)).alias("on_time"),
        F.sum(F.when(delivered, 1).otherwise(0)).alias("delivered"),
        mean_of_decimal("total_cost").alias("mean_cost"))
    out = per.join(_carrier_dim(wh), "carrier_id").select(
        "carrier_name", "carrier_type", "total_shipments",
        rate_pct("on_time", "delivered").alias("ontime_pct"),
        F.round("mean_cost", 2).alias("avg_cost"))
    return out.orderBy(F.desc("total_shipments"), F.asc("carrier_name")).limit(10)


def c5_shipments_without_invoice(wh) -> DataFrame:
    inv = wh.invoices.select(F.col("shipment_id").alias("id"))
    return wh.shipments.join(inv, "id", "left_anti").select("shipment_id", "status")


def c5_shipments_without_events(wh) -> DataFrame:
    seen = wh.tracking_events.select(F.col("shipment_id").alias("id"))
    return wh.shipments.join(seen, "id", "left_anti").select("shipment_id", "status")


def c5_customers_without_shipments(wh) -> DataFrame:
    seen = wh.shipments.select(F.col("customer_id").alias("id"))
    return wh.customers.join(seen, "id", "left_anti").select("customer_code", "company_name")


def c6_customers_with_cancellations(wh) -> DataFrame:
    canc = wh.shipments.filter(F.col("status") == "cancelled").select(F.col("customer_id").alias("id"))
    return wh.customers.join(canc, "id", "left_semi").select("customer_code", "company_name", "tier")


def _linked_docs(wh) -> DataFrame:
    e = wh.extracted_documents.filter(F.col("linked_shipment_id").isNotNull())
    s = wh.shipments.withColumnRenamed("shipment_id", "linked_shipment_id").withColumnRenamed("id", "sid")
    return e.join(s, "linked_shipment_id")


def c7_documents_with_shipments(wh) -> DataFrame:
    return _linked_docs(wh).select(F.col("linked_shipment_id").alias("shipment_id"), "status", "mode",
                                   "origin_country", "destination_country", "document_type",
                                   "overall_confidence")


def c8_extracted_vs_actual(wh) -> DataFrame:
    e = (wh.extracted_documents.filter(F.col("document_type") == "invoice")
         .select("document_id", "linked_shipment_id",
                 F.get_json_object("extracted_fields", "$.invoice_number").alias("invoice_number"),
                 F.get_json_object("extracted_fields", "$.total_amount").alias("extracted_amount")))
    s = wh.shipments.select(F.col("id"), F.col("shipment_id").alias("linked_shipment_id"))
    linked = e.join(s, "linked_shipment_id")
    # the charges meet the few invoiced shipments, and are summed by document: one join, one shuffle
    ch = wh.shipment_charges.select(F.col("shipment_id").alias("id"), "amount_usd")
    keys = ["document_id", "invoice_number", "extracted_amount", "linked_shipment_id"]
    j = linked.join(ch, "id").groupBy(*keys).agg(F.sum("amount_usd").alias("amt"))
    return j.select("invoice_number", "extracted_amount", F.col("linked_shipment_id").alias("shipment_id"),
                    F.col("amt").cast("decimal(18,2)").alias("actual_charges"))


def c9_document_timeline(wh) -> DataFrame:
    d = _linked_docs(wh).select("document_type", F.col("linked_shipment_id").alias("shipment_id"), "sid")
    t = wh.tracking_events.select(F.col("shipment_id").alias("sid"), "event_type", "event_timestamp", "location")
    return d.join(t, "sid").select("document_type", "shipment_id", "event_type", "event_timestamp", "location")


def c10_document_carrier(wh) -> DataFrame:
    d = _linked_docs(wh).select(
        "document_type", F.col("linked_shipment_id").alias("shipment_id"), "carrier_id",
        F.get_json_object("extracted_fields", "$.bl_number").alias("bl_number"),
        F.get_json_object("extracted_fields", "$.invoice_number").alias("invoice_number"))
    return d.join(_carrier_dim(wh), "carrier_id").select(
        "document_type", "bl_number", "invoice_number", "shipment_id", "carrier_name", "carrier_type")


def c11_documents_of_delayed(wh) -> DataFrame:
    return (_linked_docs(wh).filter(F.col("status") == "delayed")
            .select("document_id", "document_type", F.col("linked_shipment_id").alias("shipment_id"),
                    "delay_days"))


def c12_customer_fanout(wh) -> DataFrame:
    ships = wh.shipments.groupBy(F.col("customer_id").alias("id")).agg(F.count("*").alias("shipment_count"))
    spend = wh.invoices.groupBy(F.col("customer_id").alias("id")).agg(F.sum("total_usd").alias("total_spend"))
    return (wh.customers.select("id", "company_name", "tier").join(ships, "id").join(spend, "id", "left")
            .select("company_name", "tier", "shipment_count", "total_spend"))


# ---------------------------------------------------------------- 2.4 aggregates


def d1_count_all(wh) -> DataFrame:
    return wh.shipments.agg(F.count("*").alias("total_shipments"))


def d2_count_by_status(wh) -> DataFrame:
    return wh.shipments.groupBy("status").agg(F.count("*").alias("shipment_count"))


def d3_invoice_stats(wh) -> DataFrame:
    return wh.invoices.agg(F.sum("total_usd").alias("total"), F.min("total_usd").alias("min_total"),
                           F.max("total_usd").alias("max_total"),
                           F.round(mean_of_decimal("total_usd"), 2).alias("avg_total"))


def d4_cost_breakdown(wh) -> DataFrame:
    return wh.shipment_charges.groupBy("charge_type").agg(
        F.count("*").alias("charge_count"), F.round(mean_of_decimal("amount_usd"), 2).alias("avg_amount"),
        F.sum("amount_usd").alias("total_amount"))


def d5_commodity_mode(wh) -> DataFrame:
    return wh.shipments.groupBy("commodity", "mode").agg(F.count("*").alias("shipment_count"))


def d6_count_distinct(wh) -> DataFrame:
    j = wh.shipments.join(_carrier_dim(wh), "carrier_id")
    return j.groupBy("carrier_type").agg(F.countDistinct("customer_id").alias("distinct_customers"),
                                         F.countDistinct("destination_country").alias("distinct_destinations"))


def d7_delay_rate_by_carrier(wh) -> DataFrame:
    per = wh.shipments.groupBy("carrier_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("delay_days") > 0).alias("delayed"))
    return (per.join(_carrier_dim(wh), "carrier_id")
            .select("carrier_name", "total", "delayed", rate_pct("delayed", "total").alias("delay_rate_pct")))


def d8_ontime_by_mode(wh) -> DataFrame:
    s = wh.shipments
    delivered = F.col("status") == "delivered"
    return s.groupBy("mode").agg(rate_pct(F.count_if(delivered & (F.col("delay_days") == 0)),
                                          F.count_if(delivered)).alias("ontime_pct"))


def d9_cost_per_kg(wh) -> DataFrame:
    # weight is per shipment; charges fan out, so pre-aggregate before the join
    fr = (wh.shipment_charges.filter(F.col("charge_type") == "freight")
          .groupBy(F.col("shipment_id").alias("id")).agg(F.sum("amount_usd").alias("freight")))
    j = fr.join(wh.shipments.select("id", "mode", "weight_kg"), "id")
    per = j.groupBy("mode").agg(F.sum("freight").alias("f"), F.sum("weight_kg").alias("w"))
    return per.select("mode", F.round(F.col("f").cast("double") / F.col("w"), 4).alias("cost_per_kg"))


def d10_route_delay_having(wh, min_total: int = 5) -> DataFrame:
    s = wh.shipments.filter(F.col("delay_days") > 0)
    g = s.groupBy("origin_country", "destination_country").agg(
        F.round(F.sum("delay_days").cast("double") / F.count("*"), 1).alias("avg_delay"),
        F.count("*").alias("total"))
    return g.filter(F.col("total") >= min_total)


def d11_monthly_and_quarterly(wh) -> DataFrame:
    m = wh.shipments.groupBy(month_bucket("booking_date").alias("period")).agg(F.count("*").alias("n"))
    q = (wh.invoices.filter(F.col("payment_status") != "cancelled")
         .groupBy(quarter_label("invoice_date").alias("period")).agg(F.sum("total_usd").cast("double").alias("n")))
    return (m.select(F.lit("month").alias("grain"), "period", F.col("n").cast("double").alias("value"))
            .unionByName(q.select(F.lit("quarter_revenue").alias("grain"), "period", F.col("n").alias("value"))))


def d13_two_level(wh) -> DataFrame:
    per_ship = wh.shipment_charges.groupBy("shipment_id").agg(
        F.count("*").alias("n_charges"), F.sum("amount_usd").alias("amount"))
    j = per_ship.join(wh.shipments.select(F.col("id").alias("shipment_id"), "mode"), "shipment_id")
    return j.groupBy("mode").agg(F.round(F.sum("n_charges").cast("double") / F.count("*"), 4).alias("avg_charges"),
                                 F.round(mean_of_decimal("amount"), 2).alias("avg_amount"))


def d14_pct_delayed(wh) -> DataFrame:
    s = wh.shipments
    return s.agg(rate_pct(F.count_if(F.col("status") == "delayed"), F.count("*"), 2).alias("pct_delayed"))


def d15_cancellation_by_priority(wh) -> DataFrame:
    s = wh.shipments
    return s.groupBy("priority").agg(
        rate_pct(F.count_if(F.col("status") == "cancelled"), F.count("*"), 2).alias("cancel_pct"))


def d16_ocean_vs_air(wh) -> DataFrame:
    s = wh.shipments.filter(F.col("mode").isin("ocean", "air"))
    return s.groupBy("mode").agg(F.count("*").alias("shipments"),
                                 F.round(F.avg("weight_kg"), 2).alias("avg_weight"),
                                 F.round(F.sum("delay_days").cast("double") / F.count("*"), 3).alias("avg_delay"))


def d17_year_over_year(wh) -> DataFrame:
    y = wh.shipments.groupBy(F.year("booking_date").alias("year")).agg(F.count("*").alias("shipments"))
    w = W.orderBy("year")  # one row per year: a tiny, bounded window
    return y.select("year", "shipments", (F.col("shipments") - F.lag("shipments").over(w)).alias("change"))


def d18_monthly_avg_in_year(wh, year: int = 1998) -> DataFrame:
    i = wh.invoices.filter(_between("invoice_date", f"{year}-01-01", f"{year + 1}-01-01"))
    return i.groupBy(month_bucket("invoice_date").alias("month")).agg(
        F.round(mean_of_decimal("total_usd"), 2).alias("avg_invoice"))


def d19_empty_average(wh) -> DataFrame:
    s = wh.shipments.filter((F.col("status") == "booked") & (F.col("delay_days") > 0))
    return s.agg(F.avg("delay_days").alias("avg_delay"), F.count("*").alias("n"))


def d20_spend_by_industry(wh) -> DataFrame:
    i = wh.invoices.groupBy("customer_id").agg(F.sum("total_usd").alias("spend"), F.count("*").alias("n"))
    j = i.join(wh.customers.select(F.col("id").alias("customer_id"), "industry"), "customer_id")
    return j.groupBy("industry").agg(F.sum("n").alias("invoices"), F.sum("spend").alias("total_spend"))


def d21_gold_freight_by_carrier_type(wh) -> DataFrame:
    fr = (wh.shipment_charges.filter(F.col("charge_type") == "freight")
          .groupBy(F.col("shipment_id").alias("id")).agg(F.sum("amount_usd").alias("freight")))
    gold = wh.customers.filter(F.col("tier") == "gold").select(F.col("id").alias("customer_id"))
    s = wh.shipments.select("id", "customer_id", "carrier_id").join(gold, "customer_id", "left_semi")
    j = fr.join(s, "id").join(_carrier_dim(wh), "carrier_id")
    return j.groupBy("carrier_type").agg(F.round(mean_of_decimal("freight"), 2).alias("avg_freight"),
                                         F.count("*").alias("shipments"))


# ---------------------------------------------------------------- 2.5 windows


def e1_latest_event(wh) -> DataFrame:
    t = wh.tracking_events
    latest = t.groupBy("shipment_id").agg(
        F.max_by(F.struct("event_type", "event_timestamp", "location"),
                 F.struct("event_timestamp", "id")).alias("e"))
    return latest.select("shipment_id", "e.event_type", "e.event_timestamp", "e.location")


def e2_transit_hours(wh) -> DataFrame:
    t = wh.tracking_events.filter(F.col("event_type").isin("departed_origin", "delivered"))
    g = t.groupBy("shipment_id").agg(
        F.min(F.when(F.col("event_type") == "departed_origin", F.col("event_timestamp"))).alias("dep"),
        F.max(F.when(F.col("event_type") == "delivered", F.col("event_timestamp"))).alias("dlv"))
    return (g.filter(F.col("dep").isNotNull() & F.col("dlv").isNotNull())
            # interval of two naive timestamps: no session time zone (and no DST) involved
            .withColumn("gap", F.col("dlv") - F.col("dep"))
            .select("shipment_id", (F.expr("extract(DAY FROM gap)").cast("bigint") * 24
                                    + F.expr("extract(HOUR FROM gap)").cast("bigint")).alias("transit_hours")))


def e3_recent_turns(wh, max_turns: int = SETTINGS.max_conversation_history,
                    max_chars: int = SETTINGS.max_history_chars) -> DataFrame:
    """Prompt history per conversation: last N turns, each cut, joined in turn order."""
    c = wh.conversations
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = c.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_turns)
    line = F.concat(F.upper("role"), F.lit(": "),
                    F.when(F.length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("...")))
                    .otherwise(F.col("text")))
    g = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"),
                                      F.count("*").alias("turns_kept"))
    return g.select("conv_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("history"),
                    "turns_kept")


# ---------------------------------------------------------------- 2.6 top-k


def f1_top_carriers(wh, n: int = 10) -> DataFrame:
    return c1_shipments_per_carrier(wh).orderBy(F.desc("shipment_count"), F.asc("carrier_name")).limit(n)


def f2_heaviest(wh, n: int = 10) -> DataFrame:
    return wh.shipments.select("shipment_id", "weight_kg").orderBy(F.desc("weight_kg"), F.asc("shipment_id")).limit(n)


def f3_arg_extremes(wh) -> DataFrame:
    per = c2_avg_freight_by_carrier(wh)
    cheapest = per.agg(F.min_by(F.struct("carrier_name", "avg_freight"),
                                F.struct("avg_freight", "carrier_name")).alias("x"))
    busiest = (wh.shipments.groupBy(month_bucket("booking_date").alias("month")).agg(F.count("*").alias("n"))
               .agg(F.max_by(F.struct("month", "n"), F.struct("n", "month")).alias("x")))
    return (cheapest.select(F.lit("cheapest_carrier").alias("question"), F.col("x.carrier_name").alias("answer"),
                            F.col("x.avg_freight").cast("double").alias("value"))
            .unionByName(busiest.select(F.lit("busiest_month").alias("question"), F.col("x.month").alias("answer"),
                                        F.col("x.n").cast("double").alias("value"))))


def f3_cheapest_carrier_type(wh) -> DataFrame:
    """The carrier type with the lowest mean cost per kg."""
    per = wh.carriers.groupBy("carrier_type").agg(F.avg(F.col("cost_per_kg_usd").cast("double")).alias("mean_cost"))
    best = per.agg(F.min_by(F.struct("carrier_type", "mean_cost"), F.struct("mean_cost", "carrier_type")).alias("x"))
    return best.select("x.carrier_type", F.round("x.mean_cost", 6).alias("mean_cost"))


def f4_monthly_trend(wh) -> DataFrame:
    return (wh.shipments.groupBy(month_bucket("booking_date").alias("month")).agg(F.count("*").alias("shipments"))
            .orderBy("month"))


def f5_default_cap(wh, limit: int = SETTINGS.default_row_limit) -> DataFrame:
    """the reference's default row cap on an uncapped result, with a total order."""
    return (wh.shipments.select("shipment_id", "booking_date", "status")
            .orderBy(F.desc("booking_date"), F.asc("shipment_id")).limit(limit))


# ---------------------------------------------------------------- 2.8 scalar functions


def h6_json_extract(wh) -> DataFrame:
    """H6: typed JSON field extraction (``props`` like ``{"k": 87}``) aggregated per event type."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return wh.events.groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"),
                                               F.max(k).alias("max_k"))


def h_scalar_functions(wh) -> DataFrame:
    """H1, H2, H7, H13, H14, H15 on every shipment."""
    from tidewater.functions import business_key, clamp01, to_number
    s = wh.shipments
    return s.select(
        "id", month_bucket("booking_date").alias("month"), quarter_label("booking_date").alias("quarter"),
        F.datediff("estimated_arrival", "booking_date").alias("planned_days"),
        F.date_sub(F.col("booking_date"), 30).alias("window_start"),
        to_number(F.col("volume_cbm")).alias("volume_or_zero"),
        clamp01(F.col("delay_days") / 20.0).alias("delay_score"),
        business_key("INV", F.year("booking_date"), F.col("id")).alias("invoice_key"))


def h12_cut_text(wh, n: int = 80) -> DataFrame:
    """H12 + H10/H11: titles cut with an ellipsis, loose comparisons, on every question."""
    from tidewater.functions import cut_with_ellipsis, loose_contains, loose_equal
    q = wh.questions
    return q.select("question_id", cut_with_ellipsis(F.col("text"), n).alias("title"),
                    loose_equal(F.col("text"), F.lit("hi")).alias("is_hi"),
                    loose_contains(F.col("text"), F.lit("DROP TABLE")).alias("mentions_drop"))


def d12_bare_columns(wh) -> DataFrame:
    """The grouped query with non-grouped columns, written the Spark way.

    The JSON fields are constant per document, so ``first()`` is exact here;
    the charge rows are summed in the same aggregate (one shuffle on the key).
    """
    e = wh.extracted_documents.filter(F.col("document_type") == "invoice")
    s = wh.shipments.select(F.col("id").alias("sid"), F.col("shipment_id").alias("linked_shipment_id"))
    ch = wh.shipment_charges.select(F.col("shipment_id").alias("sid"), "amount_usd")
    j = e.join(s, "linked_shipment_id").join(ch, "sid")
    return j.groupBy("document_id", F.col("linked_shipment_id").alias("shipment_id")).agg(
        F.first(F.get_json_object("extracted_fields", "$.invoice_number")).alias("invoice_number"),
        F.first(F.get_json_object("extracted_fields", "$.total_amount")).alias("extracted_amount"),
        F.sum("amount_usd").alias("actual_charges"))
