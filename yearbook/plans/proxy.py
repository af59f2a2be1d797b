"""The declaration tables, played by the supplied test tables.

Declarations are not supplied, so orders stand for submitted documents,
suppliers for facilities, and line items for what a document declares. Each
table is one SELECT that both Spark and DuckDB run; where their words for the
same thing differ, the text has a placeholder. The operators under test never
see this text: they get DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import written

BASE = ("nation", "customer", "supplier", "part", "orders", "lineitem")
FORMS = ("A1", "A2", "B", "C", "E", "F", "G")
CATEGORIES = ("prohibitions", "exports", "imports", "biosafety")
MEASURES = ("legislation", "regulations", "other_measures", "amended")

_WORDS = {
    "spark": {"set": lambda x: f"array_sort(collect_set({x}))", "list": lambda *x: f"array({', '.join(x)})", "split": lambda x: f"split({x}, ' ')"},
    "duckdb": {"set": lambda x: f"coalesce(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL)), [])", "list": lambda *x: f"[{', '.join(x)}]", "split": lambda x: f"string_split({x}, ' ')"},
}


def _iso(k: str) -> str:
    return f"concat('X', chr(CAST(65 + floor({k} / 26.0) AS INT)), chr(CAST(65 + {k} % 26 AS INT)))"


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _flag(x: str) -> str:
    """Three-valued: true, false, unknown."""
    return f"CASE {x} % 3 WHEN 0 THEN true WHEN 1 THEN false END"


def _selects(words) -> dict[str, str]:
    flags = ",\n  ".join(f"{_flag(f'CAST(floor(k / {2**i}.0) AS BIGINT)')} AS {c}_{m}" for i, (c, m) in enumerate((c, m) for c in CATEGORIES for m in MEASURES))
    forms = " ".join(f"WHEN {i + 1} THEN '{f}'" for i, f in enumerate(FORMS))
    return {
        "r_orders": f"""
SELECT o_orderkey AS k, {_iso('c_nationkey')} AS country_iso3, n_name, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus, o_totalprice, o_orderpriority,
  concat({_iso('c_nationkey')}, '_', {_text('CAST(year(o_orderdate) AS INT)')}, '_', {_text('o_orderkey')}) AS id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
        "r_documents": """
SELECT id, country_iso3, CASE WHEN k % 11 <> 0 THEN concat(n_name, CASE WHEN k % 5 = 0 THEN ' (Rep.)' ELSE '' END) END AS country_name, year,
  CASE k % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'es' ELSE 'en' END AS language, CASE WHEN k % 7 <> 0 THEN concat('https://example.org/', CAST(k AS STRING)) END AS source_url,
  o_orderstatus = 'P' AS is_amendment
FROM r_orders""",
        "r_lines": f"""
SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS id, l_orderkey, l_linenumber, l_suppkey, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity,
  max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus,
  max(CAST(year(l_shipdate) AS INT)) AS year
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey""",
        "r_facility_years": f"""
SELECT l.id, concat({_iso('s_nationkey')}, '_', lpad({_text('l_suppkey')}, 3, '0')) AS canonical_facility_id, o.id AS document_id, {_iso('s_nationkey')} AS country_iso3, l.year,
  CASE WHEN l_linenumber <> 7 THEN concat(s_name, CASE WHEN l_quantity > 45 THEN ' Annex' ELSE '' END) END AS facility_name, p_brand AS responsible_org,
  CASE WHEN l_linenumber <> 6 THEN concat('City ', {_text('CAST(l_linenumber AS INT)')}) END AS city, concat({_text('p_size')}, ' Main St') AS address, p_type AS funding_sources,
  {_flag('l_suppkey + l_linenumber')} AS mod_funded, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS has_bsl4,
  CASE WHEN l_quantity > 10 THEN CAST(l_extendedprice AS DECIMAL(10,2)) WHEN l_quantity > 5 THEN CAST(0 AS DECIMAL(10,2)) END AS bsl4_area_m2,
  l_linestatus = 'O' AS has_bsl3, CASE WHEN l_quantity <> 13 THEN CAST(l_quantity * 10 AS DECIMAL(10,2)) END AS bsl3_area_m2,
  CASE p_size % 5 WHEN 0 THEN 'BSL-4' WHEN 1 THEN 'Enhanced BSL-3' WHEN 2 THEN 'BSL-2+' WHEN 3 THEN '' END AS highest_containment,
  CASE WHEN l_linenumber <> 5 THEN concat(p_name, ' ', p_type) END AS agents_summary, l_discount > 0.09 AS agents_redacted, CAST(l_discount * 10 AS DECIMAL(4,3)) AS confidence,
  l_linenumber % 2 = 0 AS translated, CASE WHEN l_linenumber <> 3 THEN CAST(l_suppkey % 180 AS DOUBLE) END AS lon, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber * 10 AS DOUBLE) END AS lat,
  CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END AS geocode_confidence, l_quantity = 50 AS flagged_for_review, CASE WHEN l_quantity = 50 THEN p_brand END AS flag_note
FROM r_lines l JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN r_orders o ON l_orderkey = o.k""",
        "r_facilities": f"""
SELECT canonical_facility_id, max(country_iso3) AS country_iso3, CASE WHEN canonical_facility_id NOT LIKE '%3' THEN min(facility_name) END AS canonical_name,
  {words['set']('facility_name')} AS all_names, {words['set']('year')} AS years_declared, max(highest_containment) AS latest_containment, CAST(max(bsl4_area_m2) AS DECIMAL(10,2)) AS latest_area_m2
FROM r_facility_years GROUP BY canonical_facility_id""",
        "r_vaccine_facility_years": f"""
SELECT l.id, CASE WHEN l_partkey % 17 <> 0 THEN concat(o.country_iso3, '_V', lpad({_text('l_partkey % 20')}, 3, '0')) END AS canonical_vaccine_facility_id, o.id AS document_id, o.country_iso3, l.year,
  p_name AS facility_name, concat('City ', {_text('p_size')}) AS city, concat({_text('p_size')}, ' Side St') AS address, p_type AS diseases_covered, concat(p_name, ' vaccine') AS vaccines_summary,
  CAST(l_tax * 10 AS DECIMAL(4,3)) AS confidence, CASE WHEN l_quantity > 20 THEN CAST(l_partkey % 180 AS DOUBLE) END AS lon, CASE WHEN l_quantity > 20 THEN CAST(p_size AS DOUBLE) END AS lat, 'high' AS geocode_confidence
FROM r_lines l JOIN part ON l_partkey = p_partkey JOIN r_orders o ON l_orderkey = o.k WHERE l_linenumber IN (1, 2)""",
        "r_vaccine_facilities": """
SELECT canonical_vaccine_facility_id AS id, max(country_iso3) AS country_iso3, CASE WHEN canonical_vaccine_facility_id NOT LIKE '%7' THEN min(facility_name) END AS canonical_name,
  CASE WHEN canonical_vaccine_facility_id LIKE '%5' THEN max(year) ELSE min(year) END AS first_year, CASE WHEN canonical_vaccine_facility_id LIKE '%5' THEN min(year) ELSE max(year) END AS last_year
FROM r_vaccine_facility_years WHERE canonical_vaccine_facility_id IS NOT NULL GROUP BY canonical_vaccine_facility_id""",
        "r_defence_facilities": f"""
SELECT l.id, CASE WHEN l_partkey % 19 <> 0 THEN concat(o.country_iso3, '_D', lpad({_text('l_partkey % 15')}, 3, '0')) END AS canonical_defence_facility_id, o.id AS document_id, o.country_iso3, l.year,
  CASE WHEN l_partkey % 23 <> 0 THEN p_name END AS facility_name, concat('City ', {_text('p_size')}) AS city, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS DECIMAL(10,2)) END AS bsl4_area_m2,
  CASE WHEN l_quantity < 40 THEN CAST(l_quantity * 2 AS DECIMAL(10,2)) END AS bsl3_area_m2, CAST(l_quantity AS INT) AS personnel_total, {_flag('l_partkey')} AS mod_funded,
  CAST(l_extendedprice AS DECIMAL(15,2)) AS funding_research, p_type AS work_description, CAST(l_tax * 10 AS DECIMAL(4,3)) AS confidence,
  CASE WHEN l_quantity > 15 THEN CAST(l_partkey % 180 AS DOUBLE) END AS lon, CASE WHEN l_quantity > 15 THEN CAST(p_size AS DOUBLE) END AS lat, 'medium' AS geocode_confidence
FROM r_lines l JOIN part ON l_partkey = p_partkey JOIN r_orders o ON l_orderkey = o.k WHERE l_linenumber IN (3, 4)""",
        "r_defence_entities": f"""
SELECT canonical_defence_facility_id, max(country_iso3) AS country_iso3, min(facility_name) AS canonical_name, min(year) AS first_year, max(year) AS last_year, {words['set']('facility_name')} AS all_names
FROM r_defence_facilities WHERE canonical_defence_facility_id IS NOT NULL GROUP BY canonical_defence_facility_id""",
        "r_defence_programmes": f"""
SELECT l.id, o.id AS document_id, o.country_iso3, l.year, p_name AS programme_name, p_brand AS responsible_org, concat(p_type, ' research') AS objectives_summary, {words['split']('p_name')} AS research_areas,
  CAST(l_extendedprice AS DECIMAL(15,2)) AS total_funding_amount, CASE WHEN l_quantity > 5 THEN 'USD' END AS total_funding_currency, {_flag('l_partkey')} AS uses_contractors,
  CAST(l_discount * 100 AS DECIMAL(5,2)) AS contractor_proportion_pct, CAST(l_tax * 10 AS DECIMAL(4,3)) AS confidence
FROM r_lines l JOIN part ON l_partkey = p_partkey JOIN r_orders o ON l_orderkey = o.k WHERE l_linenumber = 5""",
        "r_past_programmes": f"""
SELECT id AS document_id, country_iso3, year, concat('c. ', {_text('year')}) AS convention_entry_date, {_flag('k')} AS has_offensive_programme, CASE WHEN k % 9 = 0 THEN '1940-1969' END AS offensive_period,
  CASE WHEN k % 9 = 0 THEN o_orderpriority END AS offensive_summary, {_flag('k + 1')} AS has_defensive_programme, CASE WHEN k % 2 = 0 THEN '1950-' END AS defensive_period, o_orderpriority AS defensive_summary,
  CAST(0.875 AS DECIMAL(4,3)) AS confidence, CASE WHEN k % 10 = 0 THEN 'see annex' END AS notes
FROM r_orders WHERE k % 4 <> 1""",
        "r_legislation": f"""
SELECT id AS document_id, country_iso3, year,
  {flags},
  {words['list']("o_orderpriority", "concat('Act ', CAST(k % 5 AS STRING))")} AS key_laws, CAST(0.5 AS DECIMAL(4,3)) AS confidence, CASE WHEN k % 10 = 0 THEN 'draft' END AS notes
FROM r_orders WHERE k % 4 <> 2""",
        "r_form_compliance": f"""
SELECT o.id AS document_id, CASE l_linenumber {forms} END AS form,
  CASE max(l_returnflag) WHEN 'R' THEN 'substantive' WHEN 'A' THEN 'nothing_to_declare' ELSE CASE WHEN l_linenumber = 1 THEN 'limited' ELSE 'absent' END END AS status
FROM r_lines JOIN r_orders o ON l_orderkey = o.k GROUP BY o.id, l_linenumber""",
    }


TABLES = tuple(_selects(_WORDS["duckdb"]))


def oracle_prelude(sql: str) -> str:
    """A WITH clause for the tables that sql names, directly or through others."""
    selects = _selects(_WORDS["duckdb"])
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in selects:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(selects[name])
    return ",\n".join(f"{name} AS ({selects[name]})" for name in selects if name in needed)


def with_prelude(sql: str) -> str:
    """sql, which may begin with a WITH clause of its own, over the tables."""
    own = sql.strip()
    prelude = oracle_prelude(own)
    if not prelude:
        return own
    return f"WITH {prelude},\n{own[4:].strip()}" if own[:5].upper() == "WITH " else f"WITH {prelude}\n{own}"


class Declarations:
    """The declaration tables as attributes; a table's plan is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._made = spark, sf_dir, {}

    def _base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    def _table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self._base(name)
            else:
                text = _selects(_WORDS["spark"])[name]
                uses = {n: self._table(n) for n in (*BASE, *TABLES) if n != name and re.search(rf"\b{n}\b", text)}
                for n in uses:
                    text = re.sub(rf"(?<=FROM |JOIN ){n}\b(?! AS)", f"{{{n}}}", text)
                    # a table read under its own name is called by it in the rest of the text
                self._made[name] = self.spark.sql(text, **uses)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._table(f"r_{name}")


class Stored(Declarations):
    """The same, each table written to the shared folder when first asked for, as declarations are in use."""

    def _table(self, name: str) -> DataFrame:
        if name not in self._made and name not in BASE:
            self._made[name] = written(super()._table(name))
        return super()._table(name)
