"""Hospital feeds and tables derived from the driver tables.

Nations play trusts, part types specialties, regions regions; every line item is one admission.
The derived activity has one row per day, trust and specialty, however many line items there are.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions.calendar import year_month
from wardflow.functions.codes import site_id, site_name
from wardflow.functions.numbers import percent
from wardflow.plans import risk, star
from wardflow.sources.layers import store

from .tables import SCHEMAS

ROLES = ("Admin", "Medical", "Nursing", "Therapy")
SPECIALTIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
BEDS_PER_SUPPLIER = 8


def trust(key: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(key.cast("string"), 2, "0"))


def region(key: Column) -> Column:
    return F.concat(F.lit("R"), key.cast("string"))


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Domain:
    """Lazy frames for one data folder. The stored_* tables are written once per instance."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    # feeds --------------------------------------------------------------------------------------

    def _line_places(self) -> DataFrame:
        """Line items with nation and part type; only the needed columns reach the scans."""
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        return self.table("lineitem").join(supplier, "l_suppkey").join(part, "l_partkey")

    @staticmethod
    def _activity_counts() -> list[Column]:
        return [
            F.count(F.lit(1)).alias("admissions"),
            F.count_if(F.col("l_linestatus") == "F").alias("discharges"),
            F.sum(F.col("l_quantity").cast("long")).alias("bed_occupancy_count"),
            F.count_if(F.col("l_returnflag") == "R").alias("ae_attendances"),
            F.count_if(F.col("l_returnflag") == "A").alias("referrals"),
        ]

    def _by_day(self, lines: DataFrame, aggs: list[Column]) -> DataFrame:
        daily = lines.groupBy(
            "s_nationkey", F.col("p_type").alias("specialty_id"),
            F.col("l_shipdate").cast("date").alias("date"),
        ).agg(*aggs)
        return daily.withColumn("trust_code", trust(F.col("s_nationkey"))).drop("s_nationkey")

    def activity(self) -> DataFrame:
        return self._by_day(self._line_places(), self._activity_counts())

    @cached_property
    def _daily(self) -> DataFrame:
        """Activity with the waiting days of each day, from one pass over the line items."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("ordered")
        )
        days = F.datediff(F.col("l_shipdate").cast("date"), F.col("ordered"))
        waits = [F.sum(days).alias("days"), F.count(days).alias("waits")]
        lines = self._line_places().join(orders, "l_orderkey", "left")
        return store(self._by_day(lines, self._activity_counts() + waits), "daily")

    def stored_activity(self) -> DataFrame:
        return self._daily.drop("days", "waits")

    def waiting(self) -> DataFrame:
        """Monthly backlog and mean wait by shipping month."""
        rows = (
            self._daily.filter(F.col("waits") > 0)
            .groupBy("trust_code", "specialty_id", year_month(F.col("date")).alias("period"))
            .agg(F.sum("waits").alias("waiting_list_size"), F.sum("days").alias("days"))
        )
        return rows.select(
            "trust_code", "specialty_id", "period", "waiting_list_size",
            (F.col("days") / F.col("waiting_list_size")).alias("median_wait_days"),
        )

    def workforce(self) -> DataFrame:
        rows = self.table("supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 4).alias("r")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("s_acctbal") < 3000).alias("low")
        )
        return rows.select(
            trust(F.col("s_nationkey")).alias("trust_code"), pick(ROLES, F.col("r")).alias("role"),
            (F.col("n") * 100).alias("staff_count"), (F.col("low") * 30).alias("vacancies"),
            percent(F.col("low") * 30, F.col("n") * 100).cast("double").alias("vacancy_rate"),
        )

    def illness(self) -> DataFrame:
        price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        return self.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            (price / F.count(F.lit(1)) / 10000).alias("flu_index"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("covid_index"),
        )

    def weather(self) -> DataFrame:
        """Balances are summed per day and customer nation before the (tiny) nation join."""
        orders = self.table("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"))
        customer = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey",
            F.col("c_acctbal").cast("decimal(18,2)").alias("balance"),
        )
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        return (
            orders.join(customer, "o_custkey")
            .groupBy("date", "c_nationkey")
            .agg(F.sum("balance").alias("s"), F.count(F.lit(1)).alias("n"))
            .join(nation, "c_nationkey")
            .groupBy("date", region(F.col("n_regionkey")).alias("region_id"))
            .agg((F.sum("s").cast("double") / F.sum("n") / 500).alias("avg_temp_c"))
        )

    # dimensions ---------------------------------------------------------------------------------

    def hospitals(self) -> DataFrame:
        beds = self.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
            (F.count(F.lit(1)) * BEDS_PER_SUPPLIER).cast("int").alias("beds")
        )
        code, site = trust(F.col("n_nationkey")), F.lit(0)
        name = F.concat("n_name", F.lit(" NHS Trust"))
        return self.table("nation").join(beds, "n_nationkey", "left").select(
            site_id(code, site).alias("hospital_id"),
            site_name(name, site).alias("hospital_name"),
            code.alias("trust_code"),
            name.alias("trust_name"),
            region(F.col("n_regionkey")).alias("region_id"),
            F.lit("Acute").alias("hospital_type"),
            F.coalesce("beds", F.lit(0)).alias("bed_capacity"),
        )

    def specialties(self) -> DataFrame:
        return self.table("part").select("p_type").distinct().select(
            F.col("p_type").alias("specialty_id"),
            F.concat(F.lit("Specialty "), F.initcap("p_type")).alias("specialty_name"),
            F.lit("Medicine").alias("category"),
            (F.col("p_type") == "SMALL").alias("is_emergency"),
        )

    def regions(self) -> DataFrame:
        return self.table("region").select(
            region(F.col("r_regionkey")).alias("region_id"), F.col("r_name").alias("region_name"),
            F.lit(None).cast("string").alias("icb_code"), F.lit("England").alias("country"),
            F.lit(None).cast("int").alias("population"),
        )

    def dim_date(self) -> DataFrame:
        from wardflow.functions.calendar import date_dimension

        bounds = self.table("lineitem").agg(
            F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end")
        )
        return date_dimension(bounds)

    # star schema --------------------------------------------------------------------------------

    def fact(self, waiting: bool = True) -> DataFrame:
        """Fact over the raw feeds. Without the waiting list it is one lazy plan that reads the
        line items directly; with it, line items are read once into a stored daily table."""
        return star.build_fact(
            self.stored_activity() if waiting else self.activity(),
            self.waiting() if waiting else None,
            self.workforce(), self.illness(), self.weather(), self.hospitals(), with_ids=False,
        )

    def columns(self, *cols: str) -> DataFrame:
        """Some columns of the fact; feeds they do not need are not read."""
        return self.fact(waiting=bool({"waiting_list_size", "median_wait_days"} & {*cols})).select(*cols)

    @cached_property
    def stored_fact(self) -> DataFrame:
        """The fact as a written table, for queries that read it several times."""
        return store(self.fact(), "fact")

    def stored_columns(self, *cols: str) -> DataFrame:
        return store(self.columns(*cols), "fact_columns")

    @cached_property
    def stored_risk(self) -> DataFrame:
        return store(risk.risk_table(risk.compute_risk(self.stored_fact)), "risk")

    def forecast(self) -> DataFrame:
        """Forecast points: one per order."""
        p, k = F.col("o_orderpriority"), F.col("o_orderkey")
        target = (
            F.when(p == "1-URGENT", "ae_demand").when(p == "2-HIGH", "bed_occupancy")
            .when(p == "4-NOT SPECIFIED", "workforce_demand").otherwise("waiting_time")
        )
        yhat = F.col("o_totalprice").cast("decimal(14,2)")
        rows = self.table("orders").select(
            k.alias("forecast_id"), F.col("o_orderdate").cast("date").alias("date_key"),
            target.alias("target"), F.col("o_custkey"), k.alias("k"),
            ((k % 3 + 1) * 30).cast("int").alias("horizon_days"), yhat.alias("yhat"),
            F.when(k % 50 != 0, yhat - 10).cast("decimal(14,2)").alias("yhat_lower"),
            F.when(k % 50 != 0, yhat + 10).cast("decimal(14,2)").alias("yhat_upper"),
        )
        t = F.col("target")
        local = t.isin("waiting_time", "workforce_demand")
        return rows.select(
            "forecast_id", "date_key",
            F.when(local, site_id(trust(F.col("o_custkey") % 25), F.lit(0))).alias("hospital_id"),
            F.when(t == "waiting_time", pick(SPECIALTIES, F.col("k") % 6)).alias("specialty_id"),
            "target", "horizon_days", "yhat", "yhat_lower", "yhat_upper",
            F.when(t == "ae_demand", "trend").otherwise("gbt").alias("model"),
        )

    # stream -------------------------------------------------------------------------------------

    def attendances(self, events: DataFrame | None = None) -> DataFrame:
        """Attendance events from the driver's events (a batch or a stream of them)."""
        events = self.table("events") if events is None else events
        k = F.get_json_object("props", "$.k").cast("int")
        u = F.col("user_id")
        return events.select(
            F.col("event_id").cast("string").alias("event_id"),
            F.concat(F.lit("H"), (u % 8).cast("string")).alias("hospital_id"),
            region(u % 8 % 3).alias("region_id"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("event_ts"),
            (k / 20 + 1).cast("int").alias("acuity"),
            F.when(F.col("event_type") == "purchase", "ambulance")
            .when(F.col("event_type") == "click", "referral").otherwise("walk_in").alias("arrival_mode"),
            (F.col("value") > 50).alias("is_breach_risk"),
        )

    def department(self) -> DataFrame:
        """Department state per minute and hospital."""
        k = F.get_json_object("props", "$.k").cast("long")
        kind = F.col("event_type")
        return self.table("events").groupBy(
            F.date_trunc("MINUTE", F.col("ts").cast("timestamp")).alias("minute_ts"),
            F.concat(F.lit("H"), (F.col("user_id") % 8).cast("string")).alias("hospital_id"),
        ).agg(
            F.count(F.lit(1)).alias("arrivals"),
            F.count_if(kind == "click").alias("admissions"),
            F.count_if(kind == "view").alias("discharges"),
            F.sum(k).alias("available_beds"),
            F.count_if(kind == "error").alias("queue_length"),
            F.count_if(kind == "purchase").alias("ambulances_waiting"),
            (F.sum(k) % 41 + 60).cast("double").alias("occupancy_pct"),
            F.count_if(F.col("value") > 50).alias("breach_risk"),
        )


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Types both engines share: long, double, string, boolean, date. Optionally round doubles."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            exact = isinstance(f.dataType, T.DecimalType)
            c = c.cast("double")
            c = c if digits is None or exact else F.round(c, digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(",", c)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)
