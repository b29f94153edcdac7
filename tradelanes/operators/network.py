"""The exposure network. Only one-hop sums are computed, so edges are a plain table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelanes.dimensions import CountryBook
from tradelanes.functions.formulas import hazard_probability
from tradelanes.functions.guards import stable, total, zero_if_null

EDGE = ["origin_m49", "destination_m49", "commodity_hs"]


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def exposure_edges(corridors: DataFrame) -> DataFrame:
    """Edges from corridor metrics. Dependency is BDI, or severity where BDI is missing."""
    dep = F.coalesce(_given(corridors, "bdi"), _given(corridors, "severity_total"), F.lit(0.0))
    return corridors.select(
        *EDGE,
        zero_if_null(_given(corridors, "bilateral_import_kg")).alias("trade_weight"),
        zero_if_null(_given(corridors, "his")).alias("hazard_weight"),
        dep.alias("dep_weight"),
    )


def edges_from(edges: DataFrame, country: int) -> DataFrame:
    return edges.where(F.col("origin_m49") == country)


def edges_to(edges: DataFrame, country: int) -> DataFrame:
    return edges.where(F.col("destination_m49") == country)


def _endpoints(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge once per endpoint, in one pass."""
    return edges.select(F.explode(F.array("origin_m49", "destination_m49")).alias("m49"), *extra)


def all_nodes(edges: DataFrame) -> DataFrame:
    return _endpoints(edges).distinct()


def origin_risk_propagation(edges: DataFrame, pcc: DataFrame | None = None) -> DataFrame:
    """ORPS per origin and commodity. Without ``pcc`` every destination counts 1.0.

    ``pcc`` has one row per destination and commodity; a missing one counts 0.
    """
    weight = F.lit(1.0)
    if pcc is not None:
        demand = pcc.select(F.col("country_m49").alias("destination_m49"), "commodity_hs", "pcc")
        edges = edges.join(demand, ["destination_m49", "commodity_hs"], "left")
        weight = zero_if_null(F.col("pcc"))
    score = F.col("dep_weight") * F.col("hazard_weight") * weight
    return edges.groupBy("origin_m49", "commodity_hs").agg(F.sum(score).alias("orps"))


def attention_exposure(edges: DataFrame, crs: DataFrame | None = None) -> DataFrame:
    """ACEP per destination. Without ``crs`` every commodity counts 1.0; a missing one counts 0."""
    weight = F.lit(1.0)
    if crs is not None:
        ranks = crs.select(F.col("country_m49").alias("destination_m49"), "commodity_hs", "crs")
        edges = edges.join(ranks, ["destination_m49", "commodity_hs"], "left")
        weight = zero_if_null(F.col("crs"))
    score = F.col("dep_weight") * F.col("hazard_weight") * weight
    return edges.groupBy("destination_m49").agg(F.sum(score).alias("acep"))


def shipment_probability(counts: DataFrame, lanes: DataFrame) -> DataFrame:
    """Notifications per estimated shipment of a corridor, over all its periods.

    ``lanes`` carries ``bilateral_import_kg`` and the number of shipment rows.
    """
    keys = ["commodity_hs", "destination_m49", "origin_m49"]
    bulk = lanes.groupBy(keys).agg(
        total(F.col("bilateral_import_kg")).alias("import_kg"), F.sum("shipments").alias("shipments")
    )
    joined = bulk.join(counts, keys, "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    mean = F.when(F.col("shipments") > 0, F.col("import_kg") / F.col("shipments"))
    return joined.withColumn(
        "hazard_probability", hazard_probability(F.col("alerts"), F.col("import_kg"), mean)
    )


def network_nodes(corridors: DataFrame, book: CountryBook, commodity: str | None = None) -> DataFrame:
    """Corridor count and hazard of each country as either endpoint."""
    if commodity is not None:
        corridors = corridors.where(F.col("commodity_hs") == commodity)
    nodes = _endpoints(corridors, "his").groupBy("m49").agg(
        F.count("*").alias("corridor_count"), F.sum("his").alias("total_his")
    )
    name = F.coalesce(book.name_of(F.col("m49")), F.col("m49").cast("string"))
    return nodes.select(
        "m49", name.alias("name"), book.is_eu(F.col("m49")).alias("is_eu27"), "corridor_count", "total_his"
    )


def network_edges(corridors: DataFrame, commodity: str | None = None) -> DataFrame:
    if commodity is not None:
        corridors = corridors.where(F.col("commodity_hs") == commodity)
    return corridors.select(*EDGE, "his", "severity_total")


def network_summary(edges: DataFrame) -> DataFrame:
    """Node and edge counts and density, from one aggregation by country pair."""
    pairs = edges.groupBy("origin_m49", "destination_m49").agg(F.count("*").alias("edges"))
    ends = F.array(
        F.struct(F.col("origin_m49").alias("m49"), F.col("edges").alias("edges")),
        F.struct(F.col("destination_m49").alias("m49"), F.lit(0).cast("bigint").alias("edges")),
    )
    sums = pairs.select(F.inline(ends)).agg(
        F.count_distinct("m49").alias("node_count"),
        F.coalesce(F.sum("edges"), F.lit(0)).alias("edge_count"),
    )
    nodes = F.col("node_count")
    density = F.when(nodes > 0, F.col("edge_count") / (nodes * nodes)).otherwise(F.lit(0.0))
    return sums.withColumn("density", density)


def origin_risk(corridors: DataFrame, book: CountryBook, limit: int | None = None) -> DataFrame:
    """Origins by total hazard; all of them unless ``limit`` is given."""
    sums = corridors.groupBy("origin_m49").agg(
        F.sum("his").alias("total_his"),
        F.sum("severity_total").alias("total_severity"),
        F.count("*").alias("corridor_count"),
    )
    named = sums.withColumn("name", book.name_of(F.col("origin_m49")))
    ordered = named.orderBy(stable(F.col("total_his")).desc(), "origin_m49")
    return ordered if limit is None else ordered.limit(limit)


#: Floor of the strongest link, so that a network without hazard divides by something.
LEAST_MAXIMUM = 0.001


def merge_links(edges: DataFrame) -> DataFrame:
    """Links merged per country pair, with their strength relative to the strongest single edge."""
    pairs = edges.groupBy("origin_m49", "destination_m49").agg(
        F.sum("his").alias("his"), F.count("*").alias("corridor_count"), F.max("his").alias("_largest")
    )
    # the pairs number at most the countries squared; their maximum is one value
    strongest = F.greatest(pairs.agg(F.max("_largest")).scalar(), F.lit(LEAST_MAXIMUM))
    return pairs.withColumn("rel_his", F.col("his") / strongest).drop("_largest")


def edge_floor(links: DataFrame, percent: float) -> DataFrame:
    if percent <= 0:
        return links
    return links.where(stable(F.col("rel_his")) >= percent / 100)
