"""Text of submissions: pages, form sections, chunks, and model output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import forms

#: Phrases by which a section says that there is nothing to declare.
NOTHING = r"(?i)nothing\s+(new\s+)?to\s+declare|nothing\s+to\s+report|no\s+declaration\s+(is\s+)?required|no\s+activities\s+to\s+report"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def nothing_to_declare(text: Column, below: int = 2000) -> Column:
    """Whether a section says so, and is short: page marks and white space at its ends do not count."""
    content = stripped(F.regexp_replace(text, r"(?m)^--- PAGE \d+ ---$", ""))
    return F.coalesce(content.rlike(NOTHING) & (F.length(content) < below), F.lit(False))


def pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """A row a page of texts that mark pages by '--- PAGE n ---'; what comes before the first mark is no page."""
    numbers = F.regexp_extract_all(text, F.lit(r"--- PAGE (\d+) ---"), 1)
    bodies = F.split(F.coalesce(F.col(text), F.lit("")), r"--- PAGE \d+ ---\n?")
    rows = F.zip_with(numbers, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda n, b: F.struct(n.cast("int").alias("page"), b.alias("page_text")))
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(rows).alias("place", "p")).select(*others, "place", "p.page", "p.page_text")


def _lines(text: Column) -> Column:
    """Non-empty lines, trimmed, with their places."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("line"), i.alias("i")))
    return F.filter(every, lambda x: x.getField("line") != "")


def _first_form(line: Column, anchors: list[tuple[str, str]], at_start: bool) -> Column:
    """The form of the first pattern that a line matches; most lines match none, which one pattern tells."""
    out = F.lit(None).cast("string")
    own = [(form, f"^(?:{pattern})" if at_start else f"(?:{pattern})") for form, pattern in anchors]
    for form, pattern in reversed(own):
        out = F.when(line.rlike(pattern), form).otherwise(out)
    return F.when(line.rlike("|".join(pattern for _, pattern in own)), out) if own else out


def _first_hit(items: Column, form_of) -> Column:
    return F.get(F.filter(F.transform(items, form_of), lambda f: f.isNotNull()), F.lit(0))


def page_form(text: Column, anchors: list[tuple[str, str]] = forms.FORM_ANCHORS, pairs: list[tuple[str, str]] = forms.FORM_PAIRS) -> Column:
    """The form that a page begins: by one of its first five lines, else by two lines in a row."""
    head = F.slice(F.transform(_lines(text), lambda x: x.getField("line")), 1, 6)
    single = _first_hit(F.slice(head, 1, 5), lambda x: _first_form(x, list(anchors), True))
    if not pairs:
        return single
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.size(head) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(head, i), F.get(head, i + 1)))
    return F.coalesce(single, F.when(F.size(head) > 1, _first_hit(F.slice(two, 1, 5), lambda x: _first_form(x, list(pairs), False))))


def later_anchor(text: Column, anchors: list[tuple[str, str]] = forms.FORM_ANCHORS) -> Column:
    """(form, line) of the first anchor after the first five lines, or null."""
    rest = _lines(text)
    hits = F.filter(F.transform(F.slice(rest, 6, F.greatest(F.size(rest), F.lit(1))), lambda x: F.struct(_first_form(x.getField("line"), list(anchors), True).alias("form"), x.getField("i").alias("i"))), lambda h: h.getField("form").isNotNull())
    return F.get(hits, F.lit(0))


def segments(pages_df: DataFrame, anchors: list[tuple[str, str]] = forms.FORM_ANCHORS, pairs: list[tuple[str, str]] = forms.FORM_PAIRS, key: str = "id") -> DataFrame:
    """A row a document and form: its text, and confidence high for three forms or more in the document.

    A page belongs to the form that it begins, or else to the form before it; a
    page with an anchor further down is divided there. Pages before any form
    are left out."""
    found = pages_df.withColumns({"own": page_form(F.col("page_text"), anchors, pairs), "later": later_anchor(F.col("page_text"), anchors)})
    lines = F.split("page_text", "\n")
    cut = F.col("later.i")
    upper, lower = F.array_join(F.slice(lines, 1, F.greatest(cut, F.lit(1))), "\n"), F.array_join(F.slice(lines, cut + 1, F.size(lines)), "\n")
    part = lambda form, text, n: F.struct(form.alias("form"), text.alias("text"), F.lit(n).alias("part"))
    none = F.lit(None).cast("string")
    parts = F.when(F.col("own").isNotNull() | F.col("later").isNull(), F.array(part(F.col("own"), F.col("page_text"), 0))).otherwise(F.array(part(none, upper, 0), part(F.col("later.form"), lower, 1)))
    rows = found.select(key, "place", "page", F.explode(parts).alias("p")).select(key, "place", "page", "p.*")
    before = W.partitionBy(key).orderBy("place", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = rows.withColumn("in_form", F.last("form", ignorenulls=True).over(before)).where(F.col("in_form").isNotNull() & (F.col("form").isNotNull() | (F.trim("text") != "")))
    text = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    whole = filled.groupBy(key, F.col("in_form").alias("form")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part", text.alias("t")))), lambda x: x.getField("t")), "").alias("text"))
    return whole.withColumn("confidence", F.when(F.count("*").over(W.partitionBy(key)) >= 3, "high").otherwise("medium"))


def form_coverage(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("form").agg(F.count("*").alias("documents"))


def sections(text: Column, marker: str = forms.FACILITY, whole: bool = True) -> Column:
    """The parts that begin with a line that matches marker, trimmed; without one, the whole text if asked for, or nothing."""
    parts = F.split(F.coalesce(text, F.lit("")), f"(?m)(?={marker})")
    begins = F.filter(parts, lambda p: p.rlike(f"(?m)\\A(?:{marker})"))
    out, rest = F.when(F.size(begins) > 0, F.transform(begins, stripped)), stripped(F.coalesce(text, F.lit("")))
    return (out.when(rest != "", F.array(rest)) if whole else out).otherwise(F.array().cast("array<string>"))


def programme_sections(text: Column) -> Column:
    """(preamble, sections) of a second part of form A.

    A section begins at a programme's or a facility's first field; a programme's
    own heading lies before it, so it reaches back some characters. Programmes
    lose what lies between the beginning of their objectives and the funding,
    facilities their list of publications."""
    begin = f"(?:{forms.PROGRAMME})|(?:{forms.DEFENCE_FACILITY})"
    parts = F.split(F.coalesce(text, F.lit("")), f"(?m)(?={begin})")
    none = F.array().cast("array<struct<at:int,programme:boolean>>")

    def add(acc, part):
        programme = part.rlike(f"(?m)\\A(?:{forms.PROGRAMME})")
        here = F.struct(F.when(programme, F.greatest(acc["at"] - forms.PROGRAMME_LOOKBACK, F.lit(0))).otherwise(acc["at"]).cast("int").alias("at"), programme.alias("programme"))
        found = F.when(part.rlike(f"(?m)\\A(?:{begin})"), F.concat(acc["found"], F.array(here))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(part)).cast("int").alias("at"), found.alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("int").alias("at"), none.alias("found")), add, lambda acc: acc["found"])
    places = F.array_sort(F.array_distinct(F.transform(found, lambda f: f.getField("at"))))
    programmes = F.transform(F.filter(found, lambda f: f.getField("programme")), lambda f: f.getField("at"))

    def section(at, i):
        own = stripped(F.substring(text, at + 1, F.coalesce(F.get(places, i + 1), F.length(text)) - at))
        return F.when(F.array_contains(programmes, at), shortened(own, forms.FUNDING, forms.OBJECTIVES_MOST)).otherwise(without_list(own, forms.PUBLICATIONS, forms.WORK, forms.WORK_MOST))

    first = F.coalesce(F.get(places, F.lit(0)), F.lit(0))
    return F.struct(stripped(F.substring(text, F.lit(1), first)).alias("preamble"), F.transform(places, section).alias("sections"))


def programme_chunks(text: Column, most: int = forms.A2_CHUNK) -> Column:
    """Chunks of a second part of form A: the end of its preamble, then its sections; without any, pieces of its text."""
    made = programme_sections(text)
    before, some = made.getField("preamble"), made.getField("sections")
    preamble = F.when(before != "", F.array(F.right(before, F.lit(most)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(some) > 0, F.concat(preamble, chunks(some, most))).otherwise(fixed_chunks(stripped(F.coalesce(text, F.lit(""))), most))


def chunks(parts: Column, most: int) -> Column:
    """Parts in order, joined by an empty line into chunks of up to `most` characters of parts; a longer part is one alone.

    Each chunk depends on the one before, so this is a fold over the array."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def add(acc, x):
        over = acc["now"].isNotNull() & (acc["n"] + F.length(x) > most)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(over | acc["now"].isNull(), x).otherwise(F.concat(acc["now"], F.lit("\n\n"), x)).alias("now"),
            F.when(over, F.length(x)).otherwise(acc["n"] + F.length(x)).alias("n"),
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def fixed_chunks(text: Column, width: int) -> Column:
    """Pieces of `width` characters; nothing for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(width)), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def shortened(text: Column, marker: str, most: int) -> Column:
    """The first `most` characters and what follows marker's first match, if that lies beyond them."""
    at = F.regexp_instr(text, F.lit(marker))
    cut = F.concat(F.substring(text, 1, most), F.lit("\n[...objectives truncated...]\n\n"), F.substring(text, at, F.length(text)))
    return F.when(at - 1 > most, cut).otherwise(text)


def without_list(text: Column, list_marker: str, field_marker: str, most: int) -> Column:
    """What comes before the list, and `most` characters of the field after it."""
    at, after = F.regexp_instr(text, F.lit(list_marker)), F.regexp_instr(text, F.lit(field_marker))
    tail = F.when(after > 0, F.concat(F.lit("\n\n"), F.substring(text, after, F.lit(most)))).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), tail)).otherwise(text)


def table_text(rows: Column) -> Column:
    """An array of arrays of cells as lines of tab-separated text; line breaks in cells become spaces."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " ")), "\t")), "\n")


def json_object(text: Column) -> Column:
    """The first reading that is JSON, as its text: the whole, a fenced block, the outermost braces, those with doubled quotes repaired."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    repaired = F.regexp_replace(outer, r'(?<=[^\s:,\[\{])""', '"')
    readings = (F.trim(text), fenced, outer, repaired)
    return F.coalesce(*(F.when(F.try_parse_json(F.nullif(r, F.lit(""))).isNotNull(), r) for r in readings))


def pattern_of(expression: re.Pattern) -> str:
    """A compiled pattern for the columns above: case flags go inline."""
    return ("(?i)" if expression.flags & re.I else "") + expression.pattern
