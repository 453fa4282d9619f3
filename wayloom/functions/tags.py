"""Map tags: modes, speeds, directions and kinds of place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAR, MOTORBIKE, BICYCLE, PEDESTRIAN = 1, 2, 4, 8
MODES = {"car": CAR, "motorbike": MOTORBIKE, "bicycle": BICYCLE, "pedestrian": PEDESTRIAN}
# Accepted highway values with their speed in km/h.
SPEED = {
    "motorway": 100.0, "motorway_link": 60.0, "trunk": 80.0, "trunk_link": 50.0, "primary": 60.0, "primary_link": 40.0, "secondary": 50.0, "secondary_link": 35.0, "tertiary": 40.0, "tertiary_link": 30.0,
    "residential": 30.0, "unclassified": 30.0, "service": 20.0, "living_street": 20.0, "footway": 5.0, "pedestrian": 5.0, "cycleway": 15.0, "path": 5.0, "steps": 3.0, "track": 20.0,
}
DEFAULT_SPEED = 30.0
# Labelled boxes as lat min, lat max, lon min, lon max (ends included).
BOXES = {"Quần đảo Hoàng Sa": (15.0, 17.5, 111.0, 113.0), "Quần đảo Trường Sa": (7.0, 12.0, 111.0, 118.0)}


def accepted(highway: Column) -> Column:
    return F.coalesce(highway.isin(*SPEED), F.lit(False))


def mode_mask(highway: Column) -> Column:
    """Bit mask of the modes that may use a road."""
    return (
        F.when(highway.isin("motorway", "motorway_link"), CAR)
        .when(highway.isin("footway", "pedestrian", "steps"), PEDESTRIAN)
        .when(highway.isin("cycleway", "path"), BICYCLE | PEDESTRIAN)
        .when(highway == "track", CAR | MOTORBIKE | BICYCLE | PEDESTRIAN)
        .otherwise(CAR | MOTORBIKE)
    )


def allows(mask: Column, mode: int) -> Column:
    return mask.bitwiseAND(F.lit(mode)) != 0


def speed_kmh(highway: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SPEED.items() for x in kv])
    return F.coalesce(F.try_element_at(table, highway), F.lit(DEFAULT_SPEED))


def is_reversed(oneway: Column) -> Column:
    return F.coalesce(oneway.isin("-1", "reverse"), F.lit(False))


def is_oneway(highway: Column, oneway: Column, junction: Column) -> Column:
    tagged = F.coalesce(oneway.isin("-1", "reverse", "yes", "1", "true"), F.lit(False))
    return tagged | F.coalesce(junction == "roundabout", F.lit(False)) | F.coalesce(highway.isin("motorway", "motorway_link"), F.lit(False))


def box_label(lat: Column, lon: Column) -> Column:
    """The label of the box a point lies in, or null."""
    out = F.lit(None).cast("string")
    for name, (a, b, c, d) in reversed(BOXES.items()):
        out = F.when(lat.between(a, b) & lon.between(c, d), F.lit(name)).otherwise(out)
    return out


def place_type(amenity: Column, shop: Column, tourism: Column) -> Column:
    return F.coalesce(amenity, F.concat(F.lit("shop:"), shop), F.concat(F.lit("tourism:"), tourism), F.lit("place"))
