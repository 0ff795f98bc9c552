"""Parsing and matching of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_of_iso(text: Column) -> Column:
    """Unix seconds of an ISO-8601 text with an offset or Z; null if malformed."""
    return F.unix_seconds(F.try_to_timestamp(text))


def lat_lon(text: Column) -> Column:
    """struct(lat, lon) of '52.1°, -0.4°'; null parts if malformed."""
    parts = F.split(F.regexp_replace(text, "[°\\s]|geo:", ""), ",")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon"))


def slug(text: Column) -> Column:
    """Lower-case runs of letters and digits joined by dashes; 'unknown' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def plain_letters(text: Column) -> Column:
    """Without the diacritics of Latin letters."""
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


#: Words of names that tell nothing.
STOP_WORDS = "the and of in at on for de la le el an a".split()


def significant_words(text: Column) -> Column:
    """Different words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(plain_letters(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP_WORDS)))


def plausible_match(a: Column, b: Column) -> Column:
    """Whether two names share a significant word."""
    return F.arrays_overlap(significant_words(a), significant_words(b))


def trip_days(start: Column, end: Column) -> Column:
    """Inclusive days of a trip."""
    return F.greatest(F.lit(1), F.floor((end - start) / 86400) + 1).cast("long")


def trip_name(folder: Column) -> Column:
    """A folder's name without the year at its end; null if nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(folder, r"\s*\d{4}\s*$", "")), F.lit(""))


def without_parentheses(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, r"\([^)]*\)", ""))


def dates_of_folder(folder: Column) -> Column:
    """struct(first, last) of the days in `name (dd-MM-yyyy)` or `name (dd-MM-yyyy - dd-MM-yyyy)`; null parts without (valid) ones."""
    form = r"\((\d{2}-\d{2}-\d{4})(?:\s*-\s*(\d{2}-\d{2}-\d{4}))?\)"
    first, last = (F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(folder, form, i), F.lit("")), F.lit("dd-MM-yyyy"))) for i in (1, 2))
    return F.struct(first.alias("first"), F.coalesce(last, first).alias("last"))


#: What else in a description stands for a country.
COUNTRY_ALIASES = {
    "united kingdom": ["united kingdom", "england", "scotland", "wales", "northern ireland", "great britain", " uk"],
    "united states": ["united states", " usa", "u.s.a", "u.s."],
    "netherlands": ["netherlands", "holland"],
    "czechia": ["czechia", "czech republic"],
    "myanmar": ["myanmar", "burma"],
}


def about_a_country(description: Column) -> Column:
    """Whether an article's short description is that of a country itself."""
    return F.coalesce(description, F.lit("")).rlike(r"(?i)\bcountry\b")


def names_country(description: Column, country: Column) -> Column:
    """Whether a description names the country, by its own name or an alias (in any case)."""
    said, own = F.lower(F.coalesce(description, F.lit(""))), F.lower(country)
    known = F.create_map(*[x for name, others in COUNTRY_ALIASES.items() for x in (F.lit(name), F.array(*map(F.lit, others)))])
    return F.exists(F.coalesce(F.try_element_at(known, own), F.array(own)), lambda a: F.contains(said, a))


def locality(city: Column, town: Column, village: Column, municipality: Column) -> Column:
    """The first part of an address that is there and not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (city, town, village, municipality)])
