"""Vietnamese address text and search tokens as Column expressions."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = "aeiouy"


def _vietnamese() -> dict[str, str]:
    """Accented Vietnamese letters to their base, by rule: vowels with quality and tone marks, and the barred d."""
    quality = {"": "", "̆": "a", "̂": "aeo", "̛": "ou"}
    tones = ("", "̀", "́", "̉", "̃", "̣")
    out = {"đ": "d", "Đ": "d"}
    for base in _BASES:
        for mark, bases in quality.items():
            if mark and base not in bases:
                continue
            for tone in tones:
                if mark or tone:
                    for letter in (base, base.upper()):
                        out[unicodedata.normalize("NFC", letter + mark + tone)] = base
    return out


VIETNAMESE = _vietnamese()


def _folds() -> dict[str, str]:
    """Letters that are one ASCII letter and one mark, to that letter in lower case."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0] in string.ascii_letters and unicodedata.combining(parts[1]):
            out[chr(code)] = parts[0].lower()
    return out


FOLDS = _folds()
#: Source and target letters for ``translate``.
NORM_FROM, NORM_TO = "".join(VIETNAMESE) + string.ascii_uppercase, "".join(VIETNAMESE.values()) + string.ascii_lowercase
FOLD_FROM, FOLD_TO = "".join(FOLDS), "".join(FOLDS.values())

# City aliases, administrative prefixes with their level, road words.
CITIES = {"hn": "ha noi", "ha noi": "ha noi", "hanoi": "ha noi", "hcm": "ho chi minh", "tphcm": "ho chi minh", "ho chi minh": "ho chi minh", "saigon": "ho chi minh", "dn": "da nang", "da nang": "da nang", "hp": "hai phong", "hai phong": "hai phong", "ct": "can tho", "can tho": "can tho"}
ADMIN = {"phuong": "ward", "p.": "ward", "p ": "ward", "xa": "ward", "quan": "district", "q.": "district", "q ": "district", "huyen": "district", "h.": "district", "thi xa": "district", "thanh pho": "city", "tp.": "city", "tp ": "city", "tinh": "city", "t.": "city", "thi tran": "district"}
ROAD_WORDS = ("duong", "pho", "ngo", "hem", "ngach", "lo", "dai lo", "quoc lo", "tinh lo", "huong", "d.", "p.", "ng.")
LAT_RANGE, LON_RANGE = (7.0, 24.0), (100.0, 115.0)
COORD = r"^\s*([+-]?\d+\.?\d*)\s*[,\s]\s*([+-]?\d+\.?\d*)\s*$"
HOUSE = r"^(?:so |s\. )?([0-9]+)([a-z]?)(?: |$)"
ALLEY = r"^(ngo|hem|ngach|lo)\s+([0-9]+[a-z]?)\s+(.+)$"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def normalize(text: Column) -> Column:
    """Without Vietnamese marks, A-Z lower-cased, runs of blanks collapsed; other letters stay as they are."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, NORM_FROM, NORM_TO), r"[ \t]+", " "), r"^ | +$", "")


def segments(text: Column, by: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, by), trim), lambda s: s != "")


def let(value: Column, made) -> Column:
    """``made(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), made), 1)


def coordinates(text: Column) -> Column:
    """struct<lat, lon> of a text that is a pair of numbers in either order, or null."""
    ok = lambda x, y: x.between(*LAT_RANGE) & y.between(*LON_RANGE)
    made = lambda x, y: F.struct(x.alias("lat"), y.alias("lon"))
    pair = F.array(*[F.nullif(F.regexp_extract(text, COORD, i), F.lit("")).try_cast("double") for i in (1, 2)])
    return let(pair, lambda p: F.when(ok(p[0], p[1]), made(p[0], p[1])).when(ok(p[1], p[0]), made(p[1], p[0])))


def house_number(norm: Column) -> Column:
    """struct<number, suffix, rest> of a leading house number; null numbers where there is none."""
    number = F.nullif(F.regexp_extract(norm, HOUSE, 1), F.lit("")).try_cast("int")
    has = number.isNotNull()
    return F.struct(number.alias("number"), F.when(has, F.regexp_extract(norm, HOUSE, 2)).otherwise("").alias("suffix"), F.when(has, F.regexp_replace(F.regexp_replace(norm, HOUSE, ""), "^ +", "")).otherwise(norm).alias("rest"))


def without_alley(street: Column) -> Column:
    return F.when(street.rlike(ALLEY), trim(F.regexp_extract(street, ALLEY, 3))).otherwise(street)


def city_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CITIES.items() for x in kv]), name)


def admin_part(segment: Column) -> Column:
    """struct<level, value> of a normalised segment: a city alias, or an administrative prefix and what follows."""
    out = F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("value"))
    for prefix, level in reversed(ADMIN.items()):
        value = trim(F.substring(segment, len(prefix) + 1, 1 << 30))
        named = F.coalesce(city_of(value), value) if level == "city" else value
        out = F.when(segment.startswith(prefix) & (value != ""), F.struct(F.lit(level).alias("level"), named.alias("value"))).otherwise(out)
    return F.when(city_of(segment).isNotNull(), F.struct(F.lit("city").alias("level"), city_of(segment).alias("value"))).otherwise(out)


def trailing_city(main: Column) -> Column:
    """struct<city, street>: the longest city alias that ends a text, or nulls."""
    out = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("street"))
    for alias in sorted(CITIES, key=lambda a: (len(a), a)):
        cut = trim(F.substring(main, F.lit(1), F.length(main) - F.lit(len(alias))))
        out = F.when(main.endswith(alias), F.struct(F.lit(CITIES[alias]).alias("city"), cut.alias("street"))).otherwise(out)
    return out


def parse_address(text: Column) -> Column:
    """struct of house_number, house_suffix, street, ward, district, city, is_coord, coord_lat, coord_lon.

    Absent values are -1, '' and 0.0, as callers of the single-request interface expect.
    """
    return let(trim(text), lambda s: let(F.struct(s.alias("s"), coordinates(s).alias("coord"), segments(s).alias("parts")), _parsed))


def _parsed(a: Column) -> Column:
    coord, parts = a["coord"], a["parts"]
    is_coord = coord.isNotNull()
    main = normalize(F.coalesce(F.try_element_at(parts, F.lit(1)), a["s"]))
    rest = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    more = F.transform(F.transform(rest, normalize), admin_part)
    last = lambda more, level: F.try_element_at(F.transform(F.filter(more, lambda x: x["level"] == level), lambda x: x["value"]), F.lit(-1))
    blank = lambda c: F.when(is_coord, "").otherwise(F.coalesce(c, F.lit("")))

    def whole(x: Column) -> Column:
        tail, house, more = F.when(F.size(parts) == 1, x["tail"]), x["house"], x["more"]
        return F.struct(
            F.when(is_coord, -1).otherwise(F.coalesce(house["number"], F.lit(-1))).alias("house_number"),
            blank(house["suffix"]).alias("house_suffix"),
            blank(F.coalesce(tail["street"], without_alley(trim(house["rest"])))).alias("street"),
            blank(last(more, "ward")).alias("ward"),
            blank(last(more, "district")).alias("district"),
            blank(F.coalesce(last(more, "city"), tail["city"])).alias("city"),
            F.coalesce(is_coord, F.lit(False)).alias("is_coord"),
            F.coalesce(coord["lat"], F.lit(0.0)).alias("coord_lat"),
            F.coalesce(coord["lon"], F.lit(0.0)).alias("coord_lon"),
        )

    return let(main, lambda m: let(F.struct(house_number(m).alias("house"), trailing_city(m).alias("tail"), more.alias("more")), whole))


def can_interpolate(address: Column) -> Column:
    return (address["house_number"] >= 0) & (address["street"] != "")


def without_road_word(norm: Column) -> Column:
    out = norm
    for word in reversed(ROAD_WORDS):
        out = F.when(norm.startswith(f"{word} ") & (F.length(norm) > len(word) + 1), F.substring(norm, len(word) + 2, 1 << 30)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits, single marks folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def format_time(seconds: Column) -> Column:
    """Seconds as words; seconds are rounded by themselves, so '60 seconds' can appear."""
    number = lambda c: F.floor(c).cast("long").cast("string")
    rest = F.floor(seconds % 60 + 0.5).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    middle = F.concat(number(minutes), F.lit(" minutes"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" seconds"))).otherwise(""))
    long_ = F.concat(number(minutes / 60), F.lit(" hours "), (minutes % 60).cast("string"), F.lit(" minutes"))
    return F.when(seconds < 60, F.concat(number(seconds + 0.5), F.lit(" seconds"))).when(minutes < 60, middle).otherwise(long_)
