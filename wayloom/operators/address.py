"""House-number ranges: building them, and interpolating along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import text


def valid_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges with a street and an ascending pair of numbers, with street_norm."""
    return ranges.where("street <> '' and num_start < num_end").withColumn("street_norm", text.normalize(F.col("street")))


def resolved_ends(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Interpolation ways (way_id, node_ids, street, interp_type) whose two ends are nodes (osm_id, lat, lon, house_number) with a number."""
    number = F.regexp_extract("house_number", r"^\s*(\d+)", 1).try_cast("int")
    end = lambda c: nodes.select(F.col("osm_id").alias(f"n_{c}"), number.alias(f"num_{c}"), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    ends = ways.where(F.size("node_ids") >= 2).select(F.col("way_id").alias("id"), "street", "interp_type", F.element_at("node_ids", 1).alias("n_start"), F.element_at("node_ids", -1).alias("n_end"))
    return ends.join(end("start"), "n_start").join(end("end"), "n_end").where("num_start is not null and num_end is not null")


def resolve_ranges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranges from interpolation ways: both ends joined to their nodes, the smaller number first."""
    return ascending_ranges(resolved_ends(ways, nodes))


def ascending_ranges(both: DataFrame) -> DataFrame:
    """Ranges of a result of :func:`resolved_ends`."""
    turned = F.col("num_start") > F.col("num_end")
    swap = {f"{a}_{b}": F.when(turned, F.col(f"{a}_{c}")).otherwise(F.col(f"{a}_{b}")) for a in ("num", "lat", "lon") for b, c in (("start", "end"), ("end", "start"))}
    return valid_ranges(both.select("id", "street", "interp_type", *[v.alias(k) for k, v in swap.items()]))


def interpolate(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """req_id, lat, lon of house numbers (req_id, street_norm, number, and optionally interp_type 'even' or 'odd').

    The range whose middle is nearest to the number wins, then the smallest id; (0, 0) where no range covers it.
    """
    if "interp_type" not in requests.columns:
        requests = requests.withColumn("interp_type", F.lit("all"))
    label = F.when(F.col("interp_type").isin("even", "odd"), F.col("interp_type")).when(F.col("interp_type").isNotNull(), "all")
    # a number asked more than once is answered once; of ranges of the same numbers and label the smallest id wins for every number
    keys = ["street_norm", "number", "label"]
    requests = requests.withColumn("label", label)
    q = requests.where("street_norm is not null and number is not null").select(*keys).distinct().alias("q")
    ends = ["lat_start", "lon_start", "lat_end", "lon_end"]
    r = ranges.groupBy("street_norm", "interp_type", "num_start", "num_end").agg(F.min(F.struct("id", *ends)).alias("v")).alias("r")
    on = (F.col("q.street_norm") == F.col("r.street_norm")) & F.col("q.number").between(F.col("r.num_start"), F.col("r.num_end"))
    on = on & ((F.col("q.label") == "all") | (F.col("q.label") == F.col("r.interp_type")))
    key = F.struct(F.abs(F.col("r.num_start") + F.col("r.num_end") - 2 * F.col("q.number")).alias("k"), F.col("r.v.id").alias("id"), F.col("r.num_start").alias("num_start"), F.col("r.num_end").alias("num_end"), *[F.col(f"r.v.{c}").alias(c) for c in ends], F.col("q.number").alias("number"))
    best = q.join(r, on).groupBy(*[F.col(f"q.{c}").alias(c) for c in keys]).agg(F.min(key).alias("b"))
    t = F.when(F.col("b.num_start") == F.col("b.num_end"), 0.0).otherwise((F.col("b.number") - F.col("b.num_start")) / (F.col("b.num_end") - F.col("b.num_start")))
    along = lambda c: (F.col(f"b.{c}_start") + t * (F.col(f"b.{c}_end") - F.col(f"b.{c}_start"))).alias(c)
    got = best.select(*keys, along("lat"), along("lon"))
    return requests.select("req_id", *keys).join(got, keys, "left").select("req_id", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"))
