"""Place search: prefix terms, all required, ranked by BM25, optionally damped by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import text

# BM25 parameters and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def postings(places: DataFrame) -> DataFrame:
    """term, place_id, tf over name, name_norm and type."""
    words = F.concat(*[text.tokens(F.coalesce(c, F.lit(""))) for c in ("name", "name_norm", "type")])
    return places.select(F.col("id").alias("place_id"), F.explode(words).alias("term")).groupBy("term", "place_id").agg(F.count("*").alias("tf"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """One row: n_docs with a term, avg_len, n_terms."""
    lengths = post.groupBy("place_id").agg(F.sum("tf").alias("dl"))
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len")).join(post.agg(F.count_distinct("term").alias("n_terms")))


def search(places: DataFrame, queries: DataFrame, limit: int = 10, post: DataFrame | None = None) -> DataFrame:
    """query_id, rank, place_id, name, type, lat, lon, score of the best places of each query.

    ``queries`` has query_id, q and, to damp by distance, user_lat and user_lon. A query is its
    tokens, each a prefix that must match; a query without tokens finds nothing. Prefixes are
    resolved against the distinct terms, a table far smaller than the postings.
    """
    post = postings(places) if post is None else post
    lengths = post.groupBy("place_id").agg(F.sum("tf").alias("dl"))
    whole = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))
    near = "user_lat" in queries.columns
    asked = queries.select("query_id", F.posexplode(text.tokens(text.normalize(F.col("q")))).alias("pos", "tok"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("n_tok"))
    # a prefix and a term share their first letter: an equi-join with a residual test
    first = lambda c: F.substring(c, 1, 1)
    terms = post.select("term").distinct()
    match = asked.withColumn("a", first("tok")).join(terms.withColumn("a", first("term")), "a").where(F.col("term").startswith(F.col("tok"))).select("query_id", "pos", "term")
    f = match.join(post, "term").groupBy("query_id", "pos", "place_id").agg(F.sum("tf").alias("f"))
    df = f.groupBy("query_id", "pos").agg(F.count("*").alias("df"))
    one = f.join(df, ["query_id", "pos"]).join(lengths, "place_id").join(F.broadcast(whole))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    hits = one.groupBy("query_id", "place_id").agg(F.sum(part).alias("score"), F.count("*").alias("n_hit")).join(needed, "query_id").where("n_hit = n_tok")
    rows = hits.join(places.select(F.col("id").alias("place_id"), "name", "type", "lat", "lon"), "place_id")
    if near:
        rows = rows.join(queries.select("query_id", "user_lat", "user_lon"), "query_id")
        dy, dx = F.col("lat") - F.col("user_lat"), F.col("lon") - F.col("user_lon")
        rows = rows.withColumn("score", F.when(F.col("user_lat").isNull() | F.col("user_lon").isNull(), F.col("score")).otherwise(F.col("score") / (1 + dy * dy + dx * dx)))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "place_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("query_id", "rank", "place_id", "name", "type", "lat", "lon", "score")


def node_places(nodes: DataFrame) -> DataFrame:
    """Places from tagged nodes: named ones, and those with amenity, shop or tourism; labelled boxes rename all their nodes."""
    from wayloom.functions import tags

    label = tags.box_label(F.col("lat"), F.col("lon"))
    name, name_vi = F.coalesce(label, F.col("name"), F.lit("")), F.coalesce(label, F.col("name_vi"), F.lit(""))
    kept = nodes.withColumns({"name": name, "name_vi": name_vi}).where("name <> '' or amenity is not null or shop is not null or tourism is not null")
    return kept.select("osm_id", "name", "name_vi", text.normalize(F.when(F.col("name_vi") == "", F.col("name")).otherwise(F.col("name_vi"))).alias("name_norm"), tags.place_type(F.col("amenity"), F.col("shop"), F.col("tourism")).alias("type"), "lat", "lon")


def street_places(ways: DataFrame) -> DataFrame:
    """Places from named roads of a known kind, without coordinates (0, 0)."""
    from wayloom.functions import tags

    named = ways.where(tags.accepted(F.col("highway")) & (F.coalesce("name", F.lit("")) != ""))
    vi = F.coalesce("name_vi", F.lit(""))
    return named.select(F.col("way_id").alias("osm_id"), "name", vi.alias("name_vi"), text.normalize(F.when(vi == "", F.col("name")).otherwise(vi)).alias("name_norm"), F.concat(F.lit("street:"), "highway").alias("type"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))


def storable(places: DataFrame) -> DataFrame:
    """Places with a name in either language; the others aren't stored."""
    return places.where("name <> '' or name_vi <> ''")
