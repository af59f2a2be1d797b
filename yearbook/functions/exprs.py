"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(column: Column, term: str) -> Column:
    """Case-insensitive match of a user's term anywhere; % and _ in it are wildcards, a backslash is not."""
    return column.ilike("%" + term.replace("\\", "\\\\") + "%")


def any_contains(names: Column, term: str) -> Column:
    """Whether any element matches; false, not null, where elements are null."""
    return F.coalesce(F.exists(names, lambda x: F.coalesce(contains(x, term), F.lit(False))), F.lit(False))


def year_span(first: Column, last: Column) -> Column:
    """All years from first to last; empty where they are reversed or unknown."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def share(part: Column, whole: Column, places: int = 3) -> Column:
    """part / whole, rounded half up as decimals are; null for a whole of 0."""
    exact = part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(exact, places)


def bsl_class(text: Column) -> Column:
    """The highest of the levels 4, 3, 2, 1 that the text names, else unknown."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F.when(upper.contains("4"), "BSL-4")
    for level in "321":
        out = out.when(upper.contains(level), f"BSL-{level}")
    return out.otherwise("unknown")


def rate_bucket(rate: Column) -> Column:
    """Classes of a rate: over 0.8, 0.6, 0.4, 0.2, 0, or none."""
    out = F.when(rate > 0.8, 5)
    for level, least in ((4, 0.6), (3, 0.4), (2, 0.2), (1, 0.0)):
        out = out.when(rate > least, level)
    return out.otherwise(0)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(9)


def change_percent(old: Column, new: Column) -> Column:
    """Percent change between decimals, exact to the decimals that Spark keeps; null if old is 0, negative or unknown."""
    a, b = old.cast("decimal(20,2)"), new.cast("decimal(20,2)")
    return F.when(a > 0, (b - a) * 100 / a)


# --- coercion of text fields -------------------------------------------------


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def to_bool(text: Column) -> Column:
    """As a loader of text reads it; other spellings are unknown."""
    return F.when(text.isin("True", "true", "1", "yes"), True).when(text.isin("False", "false", "0", "no"), False)


def to_int(text: Column) -> Column:
    """Whole numbers only: '1.0' is none."""
    own = blank_to_null(text)
    return F.when(own.rlike(r"^[+-]?\d+$"), own.try_cast("int"))


def to_double(text: Column) -> Column:
    return blank_to_null(text).try_cast("double")


def split_list(text: Column, mark: str = ";") -> Column:
    """Trimmed, non-empty elements; an empty array for a null or blank text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda x: F.trim(x)), lambda x: x != "")


def join_list(items: Column, mark: str = "; ") -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), mark)


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def iso3(text: Column) -> Column:
    """Upper-cased code of three letters, else null."""
    up = F.upper(F.trim(text))
    return F.when(up.rlike("^[A-Z]{3}$"), up)


def clamp(year: Column, low: int = 1988, high: int = 2030) -> Column:
    return F.when(year.isNotNull(), F.least(F.greatest(year, F.lit(low)), F.lit(high)))


def organism_tokens(text: Column, most: int = 12) -> Column:
    """Distinct parts of over three characters, the first `most`."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,/]"), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 3)), 1, most)


def address_variants(address: Column, city: Column) -> Column:
    """(address, city) pairs to look up, the most specific first: leading parts go
    one by one until one holds a digit; the city alone comes last."""
    parts = split_list(address, ",")
    texts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.struct(F.array_join(F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(1))), ", ").alias("address"), i.alias("i")))
    until = F.coalesce(F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"\d"), i)), lambda i: i.isNotNull())), F.lit(2**31 - 1))
    some = F.when(F.size(parts) > 0, F.transform(F.filter(texts, lambda t: t.getField("i") <= until), lambda t: F.struct(t.getField("address").alias("address"), city.alias("city")))).otherwise(F.array())
    alone = F.when(F.coalesce(F.length(city), F.lit(0)) > 0, F.array(F.struct(F.lit(None).cast("string").alias("address"), city.alias("city")))).otherwise(F.array())
    return F.array_distinct(F.concat(some, alone))


def geocode_query(address: Column, city: Column, code: Column) -> Column:
    """Address, city and two-letter country code, as far as there are; null without the first two."""
    parts = F.concat_ws(", ", F.nullif(address, F.lit("")), F.nullif(city, F.lit("")))
    return F.when(parts != "", F.concat_ws(", ", parts, F.upper(F.nullif(code, F.lit("")))))


def geocode_confidence(importance: Column) -> Column:
    return F.when(importance >= 0.6, "high").when(importance >= 0.3, "medium").otherwise("low")


def year_runs(years: Column) -> Column:
    """Ascending years as runs: '2012–2014, 2016'. A repeated year breaks a run."""
    marked = F.transform(years, lambda y, i: F.struct(y.alias("y"), F.when((i > 0) & (F.get(years, i - 1) == y - 1), 0).otherwise(1).alias("new"), F.when(F.get(years, i + 1) == y + 1, 0).otherwise(1).alias("end")))
    starts = F.transform(F.filter(marked, lambda m: m.getField("new") == 1), lambda m: m.getField("y"))
    ends = F.transform(F.filter(marked, lambda m: m.getField("end") == 1), lambda m: m.getField("y"))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(b > a, F.concat(a.cast("string"), F.lit("–"), b.cast("string"))).otherwise(a.cast("string")))
    return F.array_join(runs, ", ")
