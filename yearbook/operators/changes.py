"""Changes from year to year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import change_percent, severity_rank, year_runs
from .latest import with_country_name

_NEVER = ("type string, label string, severity string, delta_pct double, from_m2 double, to_m2 double, from_level string, to_level string, place int")


def _in_order(key: str = "canonical_facility_id") -> W:
    return W.partitionBy(key).orderBy("year", "document_id", "id")


def _change(when: Column, kind: str | Column, label: Column, severity: str | Column, place: int, **values: Column) -> Column:
    """One change as a struct, null where it did not happen."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("double")
    text = F.lit(None).cast("string")
    made = F.struct(
        as_column(kind).alias("type"), label.alias("label"), as_column(severity).alias("severity"), values.get("delta_pct", none).cast("double").alias("delta_pct"), values.get("from_m2", none).cast("double").alias("from_m2"),
        values.get("to_m2", none).cast("double").alias("to_m2"), values.get("from_level", text).alias("from_level"), values.get("to_level", text).alias("to_level"), F.lit(place).alias("place"),
    )
    return F.when(when, made)


def _whole(x: Column) -> Column:
    """A decimal to the nearest whole number, ties to even, as text."""
    return F.bround(x, 0).cast("decimal(20,0)").cast("string")


def _area_change(level: int, least: int, severity: Column, place: int) -> Column:
    old, new = F.col(f"old.bsl{level}_area_m2"), F.col(f"bsl{level}_area_m2")
    percent = change_percent(old, new)
    label = F.concat(F.lit(f"BSL-{level} area "), F.when(percent > 0, "increased").otherwise("decreased"), F.lit(" "), _whole(F.abs(percent)), F.lit("% ("), _whole(old), F.lit("→"), _whole(new), F.lit(" m²)"))
    return _change((F.abs(percent) >= least) & (new != 0), f"bsl{level}_area_change", label, F.when(F.abs(percent) >= 50, "high").otherwise("medium") if level == 4 else severity, place, delta_pct=F.bround(percent, 1), from_m2=old, to_m2=new)


def notable_changes(t, min_years: int = 3, most: int = 200) -> DataFrame:
    """The most severe changes between neighbouring records of a facility.

    Facilities with fewer than min_years records, and gaps of over 3 years, do
    not count. Unknown values never make a change. Name and country are those
    of the latest record. Three windows share one sort of each facility."""
    cols = ("canonical_facility_id", "id", "document_id", "year", "country_iso3", "facility_name", "has_bsl4", "bsl4_area_m2", "bsl3_area_m2", "highest_containment")
    records = t.facility_years.where("year is not null").select(*cols)
    order = _in_order()
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = F.struct("year", "has_bsl4", "bsl4_area_m2", "bsl3_area_m2", "highest_containment")
    paired = records.withColumns({"old": F.lag(kept).over(order), "years_on_record": F.count("*").over(whole), "last": F.last(F.struct("facility_name", "country_iso3")).over(whole)})
    paired = paired.where((F.col("years_on_record") >= min_years) & F.col("old").isNotNull() & (F.col("year") - F.col("old.year") <= 3))
    level, old_level = F.col("highest_containment"), F.col("old.highest_containment")
    changes = F.array_compact(F.array(
        _change(~F.col("old.has_bsl4") & F.col("has_bsl4"), "bsl4_gained", F.lit("BSL-4 status gained"), "high", 0),
        _change(F.col("old.has_bsl4") & ~F.col("has_bsl4"), "bsl4_lost", F.lit("BSL-4 status lost"), "medium", 1),
        _area_change(4, 20, F.lit("high"), 2),
        _area_change(3, 30, F.lit("medium"), 3),
        _change((old_level != "") & (level != "") & (old_level != level), "containment_change", F.concat(F.lit("Containment level changed: "), old_level, F.lit(" → "), level), "high", 4, from_level=old_level, to_level=level),
    ))
    found = paired.select("canonical_facility_id", F.col("last.facility_name").alias("record_name"), F.col("last.country_iso3").alias("country_iso3"), F.col("old.year").alias("from_year"), F.col("year").alias("to_year"), "years_on_record", "document_id", "id", F.explode(changes).alias("c"))
    ranking = (severity_rank(F.col("c.severity")), F.desc("to_year"), "canonical_facility_id", "from_year", "document_id", "id", "c.place")
    top = found.orderBy(*ranking).limit(most)
    named = with_country_name(top.join(t.facilities.select("canonical_facility_id", "canonical_name"), "canonical_facility_id"), t.documents)
    return named.orderBy(*ranking).select("canonical_facility_id", F.coalesce("canonical_name", "record_name").alias("facility_name"), "country_iso3", "country_name", "from_year", "to_year", "years_on_record", "c.type", "c.label", "c.severity", "c.delta_pct", "c.from_m2", "c.to_m2", "c.from_level", "c.to_level")


def facility_diffs(t, facility_id: str) -> DataFrame:
    """All differences between neighbouring records up to 4 years apart, the latest first."""
    records = t.facility_years.where(F.col("canonical_facility_id") == facility_id)
    kept = F.struct("year", "highest_containment", "bsl4_area_m2", "bsl3_area_m2", "mod_funded")
    paired = records.withColumn("old", F.lag(kept).over(_in_order())).where((F.col("year") - F.col("old.year") <= 4) & F.col("old").isNotNull())

    def text(c: Column) -> Column:
        return c.cast("double").cast("decimal(20,2)").cast("string")

    def item(when: Column, key: str, old: Column, new: Column, way: Column, percent: Column, place: int) -> Column:
        return F.when(when, F.struct(F.lit(key).alias("key"), old.alias("from_value"), new.alias("to_value"), way.alias("dir"), percent.alias("pct"), F.lit(place).alias("place")))

    def area(level: int, place: int) -> list[Column]:
        old, new = F.col(f"old.bsl{level}_area_m2"), F.col(f"bsl{level}_area_m2")
        key, way = f"BSL-{level} area", F.when(new > old, "up").otherwise("down")
        none, percent = F.lit(None).cast("string"), F.round(change_percent(old, new), 0).cast("decimal(20,0)").cast("string")
        out = [item(old != new, key, text(old), text(new), way, percent, place)]
        if level == 4:
            both = old.isNotNull() & new.isNotNull()
            set_ = lambda c: F.coalesce(c != 0, F.lit(False))
            out += [item(~both & ~set_(old) & set_(new), key, F.lit("none"), text(new), F.lit("up"), none, place), item(~both & set_(old) & ~set_(new), key, text(old), F.lit("none declared"), F.lit("down"), none, place)]
        return out

    empty = F.lit(None).cast("string")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    level, old_level = F.col("highest_containment"), F.col("old.highest_containment")
    items = F.array_compact(F.array(
        item((old_level != level) & (old_level != "") & (level != ""), "Containment", old_level, level, F.lit(""), empty, 0), *area(4, 1), *area(3, 2),
        item(F.col("old.mod_funded") != F.col("mod_funded"), "MoD funded", yes(F.col("old.mod_funded")), yes(F.col("mod_funded")), F.lit(""), empty, 3),
    ))
    return paired.select("document_id", "id", F.col("old.year").alias("from_year"), F.col("year").alias("to_year"), F.explode(items).alias("i")).select("document_id", "from_year", "to_year", "i.key", "i.from_value", "i.to_value", "i.dir", "i.pct").orderBy(F.desc("to_year"), "document_id", "key")


def timeline_events(t, gap: int = 4, least: int = 25) -> DataFrame:
    """Per facility: level 4 up or down, unknown counting as no, and areas changing by `least` percent."""
    kept = F.struct("year", "has_bsl4", "bsl4_area_m2")
    paired = t.facility_years.withColumn("old", F.lag(kept).over(_in_order())).where(F.col("old").isNotNull() & (F.col("year") - F.col("old.year") <= gap))
    now, was = (F.coalesce(c, F.lit(False)) for c in (F.col("has_bsl4"), F.col("old.has_bsl4")))
    percent = change_percent(F.col("old.bsl4_area_m2"), F.col("bsl4_area_m2"))
    events = F.array_compact(F.array(F.when(now & ~was, "bsl4_up"), F.when(~now & was, "bsl4_down"), F.when((F.abs(percent) >= least) & (F.col("bsl4_area_m2") > 0), F.when(percent > 0, "area_up").otherwise("area_down"))))
    return paired.select("canonical_facility_id", "year", F.explode(events).alias("event"))


def year_ranges(t) -> DataFrame:
    """A facility's declared years as runs."""
    return t.facilities.select("canonical_facility_id", year_runs(F.col("years_declared")).alias("years"))


def gap_segments(years: DataFrame, key: str) -> DataFrame:
    """Runs of neighbouring years with their first and last: a gap begins a new one."""
    order = W.partitionBy(key).orderBy("year")
    marked = years.select(key, "year").distinct().withColumn("new", F.coalesce(F.col("year") - F.lag("year").over(order) > 1, F.lit(False)).cast("int"))
    placed = marked.withColumn("segment", F.sum("new").over(order))
    return placed.groupBy(key, "segment").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
