import pytest
from pyspark.sql import functions as F

from wayloom.functions import geo, tags, text

ADDRESSES = {
    "75 Phố A": (75, "", "pho a", "", "", "", False),
    "Phố A 75": (-1, "", "pho a 75", "", "", "", False),
    "75A Đường Láng": (75, "a", "duong lang", "", "", "", False),
    "Số 12 Ngõ 45 Đường Láng, P. Láng Thượng, Q. Đống Đa, HN": (12, "", "duong lang", "lang thuong", "dong da", "ha noi", False),
    "cafe đường láng": (-1, "", "cafe duong lang", "", "", "", False),
    "Trường THPT Chu Văn An": (-1, "", "truong thpt chu van an", "", "", "", False),
    "21.0278, 105.8342": (-1, "", "", "", "", "", True),
    "21.0278 105.8342": (-1, "", "", "", "", "", True),
    "12 Đường Láng tphcm": (12, "", "12 duong lang", "", "", "ho chi minh", False),
    "1, quang ninh": (1, "", "", "", "g ninh", "", False),
    "99999999999999 Phố A": (-1, "", "99999999999999 pho a", "", "", "", False),
    "": (-1, "", "", "", "", "", False),
}


@pytest.mark.parametrize("address", ADDRESSES)
def test_addresses(spark, address):
    a = spark.createDataFrame([(address,)], "s string").select(text.parse_address(F.col("s")).alias("a")).first()["a"]
    assert (a.house_number, a.house_suffix, a.street, a.ward, a.district, a.city, a.is_coord) == ADDRESSES[address]
    if a.is_coord:
        assert (a.coord_lat, a.coord_lon) == (21.0278, 105.8342)


def test_whole_documents_are_normalized(spark):
    import re

    import duckdb

    from wayloom import catalog

    sf, table = "/root/testdata/sf0.001", str.maketrans(dict(zip(text.NORM_FROM, text.NORM_TO, strict=True)))
    want = {i: re.sub(r"^ | +$", "", re.sub(r"[ \t]+", " ", t.translate(table))) if t is not None else None for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    got = {r.doc_id: r.norm for r in catalog.QUERIES["normalize_text"](spark, sf).collect()}
    assert got == want and max(len(t or "") for t in got.values()) > 1000


def test_normalize(spark):
    pairs = {"Hồ Gươm": "ho guom", "Đường Láng": "duong lang", "  A\t\tB ": "a b", "ÇÖß": "ÇÖß", "": ""}
    got = spark.createDataFrame([(k,) for k in pairs], "s string").select("s", text.normalize(F.col("s")).alias("n"), text.normalize(text.normalize(F.col("s"))).alias("twice")).collect()
    assert {r.s: r.n for r in got} == pairs
    assert all(r.n == r.twice for r in got)
    assert len(text.VIETNAMESE) == 134


def test_tags(spark):
    rows = spark.createDataFrame([(h,) for h in [*tags.SPEED, "construction", None]], "h string").select("h", tags.mode_mask(F.col("h")).alias("m"), tags.speed_kmh(F.col("h")).alias("s"), tags.accepted(F.col("h")).alias("a")).collect()
    by = {r.h: (r.m, r.s, r.a) for r in rows}
    assert by["motorway"] == (1, 100.0, True) and by["steps"] == (8, 3.0, True) and by["path"] == (12, 5.0, True) and by["track"] == (15, 20.0, True)
    assert by["construction"] == (3, 30.0, False) and by[None] == (3, 30.0, False)
    oneway = spark.createDataFrame([("primary", "no", None), ("motorway", "no", None), ("primary", None, "roundabout"), ("primary", "-1", None)], "h string, o string, j string")
    assert [r[0] for r in oneway.select(tags.is_oneway(F.col("h"), F.col("o"), F.col("j"))).collect()] == [False, True, True, True]


def test_time_and_projection(spark):
    got = spark.createDataFrame([(59.4,), (59.7,), (60.0,), (119.8,), (3599.0,), (3600.0,), (7384.0,)], "s double").select(text.format_time(F.col("s"))).collect()
    assert [r[0] for r in got] == ["59 seconds", "60 seconds", "1 minutes", "1 minutes 60 seconds", "59 minutes 59 seconds", "1 hours 0 minutes", "2 hours 3 minutes"]
    t, _, _ = geo.project(*(F.lit(float(x)) for x in (1, 5, 0, 0, 0, 0)))
    assert spark.range(1).select(t).first()[0] == 0.0


def test_times_of_prices_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb
    from wayloom import catalog

    # a seventh of the first three prints as x.x5, but the doubles times ten are halves or not as SQL sees them
    prices = ", ".join(f"({i}::bigint, 1, {i}::bigint, 1::bigint, {p}::double)" for i, p in enumerate((32838.18, 43140.74, 96599.65, 6296.15, 6534.15, 0.0, 419.65)))
    duckdb.sql(f"copy (select * from (values {prices}) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = catalog.QUERIES["format_time"](spark, str(tmp_path)).toPandas().sort_values("l_orderkey")["spelled"].tolist()
    want = duckdb.sql(catalog.ORACLE_SQL["format_time"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet'") + " order by l_orderkey").fetchall()
    assert got == [r[4] for r in want]
    values = spark.createDataFrame([(2.25,), (-2.25,), (0.5,), (1e300,), (None,)], "v double").select(geo.rounded(F.col("v"), 1)).collect()
    assert [r[0] for r in values] == [2.3, -2.3, 0.5, 1e300, None]
