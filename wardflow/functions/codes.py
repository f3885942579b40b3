"""Identifiers, organisation attributes and region lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Postcode area to region code.
POSTCODE_REGION = {
    "E": "LON", "EC": "LON", "N": "LON", "NW": "LON", "SE": "LON", "SW": "LON", "W": "LON",
    "WC": "LON", "EN": "LON", "HA": "LON", "IG": "LON", "RM": "LON", "UB": "LON", "TW": "LON",
    "KT": "LON", "SM": "LON", "CR": "LON", "BR": "LON", "DA": "LON",
    "M": "NW", "L": "NW", "BL": "NW", "BB": "NW", "PR": "NW", "FY": "NW", "LA": "NW", "CA": "NW",
    "WA": "NW", "WN": "NW", "SK": "NW", "OL": "NW", "CH": "NW", "CW": "NW",
    "LS": "YOR", "BD": "YOR", "HX": "YOR", "HD": "YOR", "WF": "YOR", "S": "YOR", "DN": "YOR",
    "HU": "YOR", "YO": "YOR", "HG": "YOR",
    "NE": "NE", "SR": "NE", "DH": "NE", "TS": "NE", "DL": "NE",
    "B": "MDL", "CV": "MDL", "WV": "MDL", "WS": "MDL", "DY": "MDL", "ST": "MDL", "TF": "MDL",
    "DE": "MDL", "NG": "MDL", "LE": "MDL", "LN": "MDL", "NN": "MDL", "WR": "MDL", "HR": "MDL",
    "CB": "EST", "CO": "EST", "CM": "EST", "SS": "EST", "IP": "EST", "NR": "EST", "AL": "EST",
    "LU": "EST", "SG": "EST", "HP": "EST", "MK": "EST", "PE": "EST",
    "OX": "SE", "RG": "SE", "SL": "SE", "GU": "SE", "ME": "SE", "CT": "SE", "TN": "SE",
    "BN": "SE", "RH": "SE", "PO": "SE", "SO": "SE",
    "BS": "SW", "BA": "SW", "TA": "SW", "EX": "SW", "PL": "SW", "TQ": "SW", "TR": "SW",
    "DT": "SW", "GL": "SW", "SN": "SW", "SP": "SW", "BH": "SW",
}
DEFAULT_REGION = "MDL"

# Informal region label to region code.
REGION_BY_LABEL = {
    "London": "LON",
    "Yorkshire": "YOR",
    "Midlands": "MDL",
    "North West": "NW",
    "South East": "SE",
    "South West": "SW",
    "East": "EST",
    "North East": "NE",
}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def trust_code(c: Column) -> Column:
    """Upper-case alphanumerics only; anything not 3-5 characters long becomes NULL."""
    code = F.regexp_replace(F.upper(F.trim(c.cast("string"))), "[^A-Z0-9]", "")
    return F.when(code.rlike("^[A-Z0-9]{3,5}$"), code)


def region_for_label(label: Column) -> Column:
    """Known labels map to a code, unknown ones pass through."""
    return F.coalesce(F.try_element_at(_literal_map(REGION_BY_LABEL), label), label)


def region_for_postcode(postcode: Column) -> Column:
    """Leading letters of the postcode: two-letter area first, then one letter, then a default."""
    letters = F.regexp_extract(F.upper(F.coalesce(postcode, F.lit(""))), "^([A-Z]+)", 1)
    areas = _literal_map(POSTCODE_REGION)
    return F.coalesce(
        F.try_element_at(areas, F.substring(letters, 1, 2)),
        F.try_element_at(areas, F.substring(letters, 1, 1)),
        F.lit(DEFAULT_REGION),
    )


def organisation_type(name: Column) -> Column:
    n = F.upper(name)
    return (
        F.when(n.contains("MENTAL HEALTH") | n.contains("WELLBEING"), "Mental Health")
        .when(n.contains("COMMUNITY"), "Community")
        .when(n.contains("AMBULANCE"), "Ambulance")
        .otherwise("Acute")
    )


def organisation_name(name: Column) -> Column:
    """Capital after every non-letter, with the service acronym kept in capitals.

    initcap() only breaks words at spaces, so a marked space goes in after each non-letter first.
    """
    spaced = F.regexp_replace(F.lower(name), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(
        F.replace(F.initcap(spaced), F.lit("\u0001 "), F.lit("")), F.lit("Nhs"), F.lit("NHS")
    )


def modelled_beds(code: Column) -> Column:
    """Capacity 300..1500 in steps of 50 from a hash that is the same in every process."""
    bucket = F.conv(F.substring(F.md5(code.cast("binary")), 1, 8), 16, 10).cast("long")
    return (F.lit(300) + (bucket % 25) * 50).cast("int")


def site_id(code: Column, index: Column) -> Column:
    return F.concat(F.lit("H_"), code, F.lit("_"), F.format_string("%02d", index))


def site_name(name: Column, index: Column) -> Column:
    return F.format_string("%s – Site %d", name, index + 1)


def short_name(name: Column) -> Column:
    """Hospital name up to the service acronym, for chart labels."""
    return F.regexp_replace(name, " NHS.*$", "")
