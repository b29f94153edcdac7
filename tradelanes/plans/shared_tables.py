"""The engine's inputs derived from the order, line-item and party tables.

Lines sold between countries become trade, orders with returned lines become
alert notifications, and quantities sold become production and consumption.
Every derivation is a plain DataFrame over the whole tables; sizes of joins
are left to the optimizer, which knows the files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelanes.dimensions import CountryBook
from tradelanes.functions.text import normalise_hs
from tradelanes.operators import alerts, flows
from tradelanes.plans import runs
from tradelanes.session import materialise

# ---------------------------------------------------------------- fixed values
#: Commodity code of each part type.
CODES = {
    "STANDARD": "100630",
    "ECONOMY": "090421",
    "MEDIUM": "110220",
    "PROMO": "080211",
    "LARGE": "190532",
    "SMALL": "230990",
}
#: Hazard token by part size modulo their number.
TOKENS = [
    "pathogenic micro-organisms",
    "pesticide residues",
    "heavy metals",
    "mycotoxins",
    "Migration",
    "composition",
    "unauthorised novel food extract",
    "mystery agent",
]
CLASSES = {
    "1-URGENT": "alert notification",
    "2-HIGH": "Border Rejection",
    "3-MEDIUM": "information for follow-up",
    "4-NOT SPECIFIED": "information notification for attention",
    "5-LOW": "news",
}
DECISIONS = {"F": "serious", "O": "Potentially Serious", "P": "undecided"}
UNION_REGION = "EUROPE"
# ------------------------------------------------------------------------------

COMMODITY_NAMES = [f"Goods; of {kind.lower()} (other)" for kind in CODES]
COUNTRY_NAMES = [f"NATION_{i}" for i in range(25)]


def _choose(column: Column, options: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in options.items()])


def nation(number: Column) -> Column:
    return F.concat(F.lit("NATION_"), number.cast("string"))


class SharedTables:
    """The inputs over one folder of tables. Frames are built once and stay lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def countries(self) -> DataFrame:
        """(ord, name, m49, is_eu27); codes start at 1 because 0 means none."""
        region = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        return self.table("nation").join(region, "n_regionkey").select(
            F.col("n_nationkey").alias("ord"),
            F.col("n_name").alias("name"),
            (F.col("n_nationkey") + 1).alias("m49"),
            (F.col("r_name") == UNION_REGION).alias("is_eu27"),
        )

    @cached_property
    def book(self) -> CountryBook:
        return CountryBook.from_frame(self.countries)

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with commodity, both countries and the year of the order."""
        item = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
        )
        order = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("period")
        )
        buyer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        seller = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
        sold = order.join(buyer, "o_custkey")
        return item.join(seller, "l_suppkey").join(part, "l_partkey").join(sold, "l_orderkey")

    @cached_property
    def trade(self) -> DataFrame:
        """Both sides' reports of every line between two countries, from one pass over the lines.

        The exporter does not report returned lines, so the sides differ.
        """
        told = F.when(F.col("l_returnflag") == "R", F.array(F.lit("M")))
        flow = F.explode(told.otherwise(F.array(F.lit("M"), F.lit("X")))).alias("flowCode")
        between = self.lines.where("c_nationkey <> s_nationkey").select("*", flow)
        imported = F.col("flowCode") == "M"
        buyer, seller = F.col("c_nationkey") + 1, F.col("s_nationkey") + 1
        reporter = F.when(imported, buyer).otherwise(seller)
        partner = F.when(imported, seller).otherwise(buyer)
        return between.select(
            "period",
            reporter.alias("reporterCode"),
            self.book.name_of(reporter).alias("reporterDesc"),
            partner.alias("partnerCode"),
            self.book.name_of(partner).alias("partnerDesc"),
            _choose(F.col("p_type"), CODES).alias("cmdCode"),
            F.concat(F.lit("Goods; of "), F.lower("p_type"), F.lit(" (other)")).alias("cmdDesc"),
            "flowCode",
            F.when(imported, "Import").otherwise("Export").alias("flowDesc"),
            F.col("l_extendedprice").alias("primaryValue"),
            F.when(F.col("l_orderkey") % 101 != 7, F.col("l_quantity")).alias("netWgt"),
            F.col("l_quantity").alias("qty"),
            F.when(F.col("l_linenumber") == 1, "N/A").otherwise("kg").alias("qtyUnitAbbr"),
        )

    @cached_property
    def exports(self) -> DataFrame:
        return flows.filter_flow(self.trade, "X")

    @cached_property
    def population(self) -> DataFrame:
        return self.table("customer").groupBy((F.col("c_nationkey") + 1).alias("country_m49")).agg(
            F.count("*").cast("double").alias("population")
        )

    @cached_property
    def sold(self) -> DataFrame:
        """Quantities by commodity, both countries and year; production and consumption start here."""
        return materialise(
            self.lines.groupBy("p_type", "s_nationkey", "c_nationkey", "period").agg(
                F.sum("l_quantity").alias("kg")
            )
        )

    def _sold_by(self, country: str, out: str) -> DataFrame:
        sums = self.sold.groupBy(
            _choose(F.col("p_type"), CODES).alias("commodity_hs"),
            (F.col(country) + 1).alias("country_m49"),
            "period",
        ).agg(F.sum("kg").alias(out))
        return sums.join(self.population, "country_m49", "left")

    @cached_property
    def production(self) -> DataFrame:
        """Sales of a country's suppliers. Domestic supply is unknown or 0 for some countries."""
        made = self._sold_by("s_nationkey", "production_kg")
        kind = F.col("country_m49") % 3
        supply = F.when(kind == 2, F.col("production_kg") * 2).when(kind == 1, F.lit(0.0))
        return made.select(
            "commodity_hs", "country_m49", "period", "production_kg",
            supply.alias("domestic_supply_kg"), "population",
        )

    @cached_property
    def balance(self) -> DataFrame:
        """Purchases of a country's customers."""
        bought = self._sold_by("c_nationkey", "domestic_supply_food_kg")
        return bought.select(
            "commodity_hs", "country_m49", "period", "domestic_supply_food_kg", "population"
        )

    @cached_property
    def commodities(self) -> DataFrame:
        """Distinct part names with the code of their type; names of size 13 have no code."""
        code = F.when(F.col("p_size") != 13, _choose(F.col("p_type"), CODES))
        return self.table("part").groupBy(F.col("p_name").alias("commodity"), code.alias("hs_code")).agg(
            F.min("p_partkey").alias("pos")
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Raw notifications: one per order with returned lines, in the layout alerts arrive in."""
        returned = self.table("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey")
        seller = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
        token = F.get(F.array(*[F.lit(t) for t in TOKENS]), F.col("p_size") % len(TOKENS))
        # partial sums per order; the country set is bounded by the dimension
        found = returned.join(seller, "l_suppkey").join(part, "l_partkey").groupBy("l_orderkey").agg(
            F.sort_array(F.collect_set("s_nationkey")).alias("sellers"),
            F.max(_choose(F.col("p_type"), CODES)).alias("code"),
            F.max("p_type").alias("kind"),
            F.min(token).alias("token_a"),
            F.max(token).alias("token_b"),
        )
        order = self.table("orders").join(
            self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
        )
        rows = found.join(order, found["l_orderkey"] == order["o_orderkey"])
        key = F.col("o_orderkey")

        def every(divisor: int, rest: int = 0) -> Column:
            return key % divisor == rest

        sellers = F.array_join(F.transform("sellers", nation), ", ")
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        return rows.select(
            key.alias("row_id"),
            F.concat(F.lit("R"), F.floor(key / 2).cast("string")).alias("reference"),
            F.when(~every(17), day).alias("date"),
            F.when(every(34), day).alias("notification_date"),
            F.when(every(97), "Atlantis")
            .when(every(89), F.lit(None))
            .when(every(29), F.concat(sellers, F.lit(", Atlantis")))
            .when(every(13), F.concat(F.lit("Republic of "), sellers))
            .otherwise(sellers)
            .alias("origin"),
            F.when(every(4, 1), F.lower(nation(F.col("c_nationkey"))))
            .otherwise(nation(F.col("c_nationkey")))
            .alias("notifying_country"),
            F.when(every(5, 2), F.lit(None))
            .when(every(6), F.concat(nation(key % 25), F.lit(", Elsewhere")))
            .otherwise(nation(key % 25))
            .alias("distribution"),
            F.when(
                ~every(7, 3),
                F.concat(nation(F.col("o_custkey") % 25), F.lit(","), nation((key * 7 + 3) % 25)),
            ).alias("for_followUp"),
            F.when(every(9), " nan").when(every(3, 1), nation(key % 23)).alias("for_attention"),
            F.when(every(31), F.lit(None))
            .when(every(3), F.concat("code", F.lit(".0")))
            .otherwise(F.col("code"))
            .alias("hs_code"),
            F.when(~every(37), F.concat(F.lit("goods "), F.lower("kind"))).alias("commodities"),
            _choose(F.col("o_orderpriority"), CLASSES).alias("classification"),
            F.when(every(11), "not serious")
            .otherwise(_choose(F.col("o_orderstatus"), DECISIONS))
            .alias("risk_decision"),
            F.when(every(19), F.lit(None))
            .when(every(23), F.col("token_a"))
            .otherwise(
                F.concat(F.lit("a - {"), "token_a", F.lit("},b - { "), "token_b", F.lit(" }"))
            )
            .alias("hazards"),
        )

    # ------------------------------------------------------------------ derived

    @cached_property
    def events(self) -> DataFrame:
        return alerts.extract_corridors(self.raw, self.book)

    @cached_property
    def hazard(self) -> runs.HazardRun:
        return runs.run_hazard(self.raw, self.book)

    @cached_property
    def notifications(self) -> DataFrame:
        return alerts.build_notifications(self.events)

    @cached_property
    def metrics(self) -> DataFrame:
        return self.hazard.metrics

    @cached_property
    def cube(self) -> DataFrame:
        """The trade cube with the commodity codes of the notifications."""
        return materialise(flows.trade_cube(self.trade, normalise=True))

    @staticmethod
    def renamed(table: DataFrame) -> DataFrame:
        """Commodity codes in the form notifications use."""
        return table.withColumn("commodity_hs", normalise_hs(F.col("commodity_hs")))

    @cached_property
    def enriched(self) -> DataFrame:
        return runs.corridor_enrich(
            self.metrics, self.cube, self.renamed(self.production), self.renamed(self.balance)
        )

    @cached_property
    def scored(self) -> DataFrame:
        return runs.scoring.score(materialise(self.enriched))
