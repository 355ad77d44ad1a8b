"""Queries on loading: assertion rows, mapping, vocabulary, JSON fields, captures and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.functions.text import has_word
from kernelweave.operators import assertions as A
from kernelweave.operators.malformed import load_assertions
from kernelweave.plans.graph_queries import _L, _N, links_of
from kernelweave.plans.mentions import nodes_of
from kernelweave.plans.refinery import _CONCEPT, _FIELD, _LINES
from kernelweave.runtime import table
from kernelweave.sources.writers import as_json, network


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_assertions(table(spark, d, "conceptnet_line").select("line_id", "raw_line"))[0]


def compact_relations(spark: SparkSession, d: str) -> DataFrame:
    """Compact relations of all lines that can be loaded."""
    return A.compact(_loaded(spark, d)).select("line_id", "lang", "surface_start", "rel", "surface_end")


def full_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations with both addresses cut into their parts."""
    return A.full(_loaded(spark, d)).select("line_id", "rel", "start_lang", "start_term", "start_sense", "end_lang", "end_term", "end_sense")


def external_links(spark: SparkSession, d: str) -> DataFrame:
    """English concepts with an address outside, from the assertion table."""
    rows = table(spark, d, "conceptnet_edge").where("relation_id = '/r/ExternalURL' AND startswith(start_id, '/c/en/')")
    return rows.select("start_id", "end_id").distinct()


def language_triples(spark: SparkSession, d: str) -> DataFrame:
    """Distinct triples in English."""
    return A.of_language(table(spark, d, "compact_relation"), "en").where("surface_start IS NOT NULL AND rel IS NOT NULL AND surface_end IS NOT NULL")


def surface_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms in which every concept is written."""
    return A.surface_forms(table(spark, d, "compact_relation"), F.lower(F.regexp_replace(F.trim("surface_start"), " +", "_")))


def non_word_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces that no mention is written like."""
    rows = table(spark, d, "compact_relation").select(F.explode(F.array("surface_start", "surface_end")).alias("surface"))
    return A.outside_vocabulary(rows, table(spark, d, "mention").select(F.col("text").alias("word")).where("word IS NOT NULL"))


def relation_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Relations by mapped label and negation, with the number of rows and of unmapped ones."""
    mapped = A.map_relations(A.without_identifiers(table(spark, d, "compact_relation").where("rel IS NOT NULL")).select("rel", "weight"), table(spark, d, "relation_map"))
    return mapped.groupBy("relation", "negated").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("unmapped").cast("int")).alias("n_unmapped"))


def unmapped_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that occur but are not mapped."""
    known = table(spark, d, "relation_map").select(F.col("label").alias("rel"))
    return table(spark, d, "compact_relation").where("rel IS NOT NULL").join(F.broadcast(known), "rel", "left_anti").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def jsonpath_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sum and number of a JSON field of the events by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def json_contributors(spark: SparkSession, d: str) -> DataFrame:
    """Contributor and step names at their JSON paths in the data of assertions."""
    rows = table(spark, d, "conceptnet_edge").where("startswith(data, '{')")
    path = lambda p: F.get_json_object("data", p)
    return rows.select("edge_id", path("$.rel").alias("rel"), path("$.sources[0].contributor").alias("contributor"), path("$.sources[0].process.name").alias("process"))


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phrase in their first line as a word, else in the rest; the two kinds of hits are disjoint."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    title = F.get(F.split("text", "\n", 2), F.lit(0))
    found = has_word(title, "traffic", "ferry", "tram")
    body = has_word(F.col("text"), "traffic", "ferry", "tram")
    return docs.select("doc_id", F.when(found, "title").when(body, "body").alias("place")).where("place IS NOT NULL")


def one_capture_per_day(spark: SparkSession, d: str) -> DataFrame:
    """First document of every source and day within a window of dates.

    The first is a minimum, so a source with a third of the rows is aggregated on the map side.
    """
    docs = table(spark, d, "documents").where("published_at >= TIMESTAMP '2024-03-01' AND published_at < TIMESTAMP '2025-03-01' AND source IS NOT NULL")
    first = docs.groupBy("source", F.to_date("published_at").alias("day")).agg(F.min(F.struct("published_at", "doc_id")).alias("f"))
    return first.select("source", F.col("day").cast("string").alias("day"), F.col("f.doc_id").alias("doc_id"))


def resume_gap(spark: SparkSession, d: str) -> DataFrame:
    """Longest pause between days with documents of every source, and the day it begins."""
    days = table(spark, d, "documents").where("published_at IS NOT NULL AND source IS NOT NULL").select("source", F.to_date("published_at").alias("day")).distinct()
    gaps = days.withColumn("next", F.lead("day").over(Window.partitionBy("source").orderBy("day"))).where("next IS NOT NULL")
    best = gaps.groupBy("source").agg(F.max(F.struct(F.datediff("next", "day").alias("gap"), (-F.unix_date("day")).alias("neg"))).alias("b"))
    return best.select("source", F.col("b.gap").alias("gap"), F.date_from_unix_date(-F.col("b.neg")).cast("string").alias("since"))


def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of the longer documents of two languages: filter and columns reach the scan."""
    return table(spark, d, "documents").where("n_chars >= 200 AND lang IN ('en', 'de')").select("doc_id", "source")


def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """Every graph node as JSON text, measured and digested."""
    node = as_json(nodes_of(spark, d).select("id", "kind", "name", "pos"), "id")
    return node.select("id", "json")


def network_json(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the graphs as a network viewer takes them."""
    shown = nodes_of(spark, d).select("id", F.coalesce("name", F.lit("?")).alias("label"))
    return network(shown, links_of(spark, d).where("label IS NOT NULL").select("src", "label", "dst").distinct())


_LOAD = _LINES + f""", seg AS (SELECT line_id, s, e, d, CASE WHEN r0[1] = '"' THEN replace(r0[2:-2], '""', '"') ELSE r0 END AS r FROM (
  SELECT *, regexp_extract(t, '^(?:{_FIELD}\\t){{2}}({_FIELD})\\t', 1) AS r0 FROM judged WHERE ok AND regexp_full_match(s, '{_CONCEPT}') AND regexp_full_match(e, '{_CONCEPT}|https?://[^\\s\\p{{Z}}]+')))"""
_SURFACE = "coalesce(nullif(trim(json_extract_string(d, '$.{k}')), ''), replace(split_part({c}, '/', 4), '_', ' '))"

QUERIES = {
    f.__name__: f
    for f in (compact_relations, full_relations, external_links, language_triples, surface_forms, non_word_surfaces, relation_mapping, unmapped_labels, jsonpath_extract, json_contributors, phrase_search, one_capture_per_day, resume_gap, scan_project_filter, graph_json, network_json)
}
_PH = r"regexp_matches({t}, '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:traffic|ferry|tram)(?:[^\p{{L}}\p{{N}}]|$)')"
ORACLES = {
    "compact_relations": f"""{_LOAD} SELECT line_id, split_part(s, '/', 3) AS lang, {_SURFACE.format(k='surfaceStart', c='s')} AS surface_start, replace(r, '/r/', '') AS rel,
      CASE WHEN e LIKE '/c/%' THEN {_SURFACE.format(k='surfaceEnd', c='e')} ELSE coalesce(nullif(trim(json_extract_string(d, '$.surfaceEnd')), ''), split_part(e, '/', 4)) END AS surface_end FROM seg""",
    "full_relations": f"""{_LOAD} SELECT line_id, replace(r, '/r/', '') AS rel, split_part(s, '/', 3) AS start_lang, split_part(s, '/', 4) AS start_term, CASE WHEN len(string_split(s, '/')) > 4 THEN split_part(s, '/', 5) END AS start_sense,
      CASE WHEN e LIKE '/c/%' THEN split_part(e, '/', 3) END AS end_lang, CASE WHEN e LIKE '/c/%' THEN split_part(e, '/', 4) END AS end_term, CASE WHEN e LIKE '/c/%' AND len(string_split(e, '/')) > 4 THEN split_part(e, '/', 5) END AS end_sense FROM seg""",
    "external_links": "SELECT DISTINCT start_id, end_id FROM conceptnet_edge WHERE relation_id = '/r/ExternalURL' AND start_id LIKE '/c/en/%'",
    "language_triples": "SELECT DISTINCT surface_start, rel, surface_end FROM compact_relation WHERE lang = 'en' AND surface_start IS NOT NULL AND rel IS NOT NULL AND surface_end IS NOT NULL",
    "surface_forms": "SELECT lower(regexp_replace(trim(surface_start), ' +', '_', 'g')) AS key, count(DISTINCT surface_start) AS n_forms, min(surface_start) AS first FROM compact_relation WHERE surface_start IS NOT NULL GROUP BY 1",
    "non_word_surfaces": "SELECT DISTINCT lower(s) AS surface FROM (SELECT surface_start AS s FROM compact_relation UNION ALL SELECT surface_end FROM compact_relation) WHERE s IS NOT NULL AND lower(s) NOT IN (SELECT lower(text) FROM mention WHERE text IS NOT NULL)",
    "relation_mapping": """SELECT coalesce(m.rel, c.rel) AS relation, coalesce(m.rel_negated, FALSE) AS negated, count(*) AS n, (count(*) FILTER (WHERE m.rel IS NULL))::BIGINT AS n_unmapped FROM compact_relation c LEFT JOIN relation_map m ON m.label = c.rel
      WHERE c.rel IS NOT NULL AND NOT coalesce(regexp_matches(surface_start, '^Q[0-9]+$'), FALSE) AND NOT coalesce(regexp_matches(surface_end, '^Q[0-9]+$'), FALSE) GROUP BY 1, 2""",
    "unmapped_labels": "SELECT rel, count(*) AS n FROM compact_relation WHERE rel IS NOT NULL AND rel NOT IN (SELECT label FROM relation_map) GROUP BY 1",
    "jsonpath_extract": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "json_contributors": "SELECT edge_id, json_extract_string(data, '$.rel') AS rel, json_extract_string(data, '$.sources[0].contributor') AS contributor, json_extract_string(data, '$.sources[0].process.name') AS process FROM conceptnet_edge WHERE starts_with(data, '{')",
    "phrase_search": f"SELECT doc_id, CASE WHEN {_PH.format(t='t')} THEN 'title' ELSE 'body' END AS place FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS t FROM documents WHERE text IS NOT NULL) WHERE {_PH.format(t='text')}",
    "one_capture_per_day": "SELECT source, published_at::DATE::VARCHAR AS day, arg_min(doc_id, (published_at, doc_id)) AS doc_id FROM documents WHERE published_at >= TIMESTAMP '2024-03-01' AND published_at < TIMESTAMP '2025-03-01' AND source IS NOT NULL GROUP BY 1, 2",
    "resume_gap": """WITH a AS (SELECT DISTINCT source, published_at::DATE AS day FROM documents WHERE published_at IS NOT NULL AND source IS NOT NULL), g AS (SELECT source, day, lead(day) OVER (PARTITION BY source ORDER BY day) - day AS gap FROM a)
      SELECT source, gap, day::VARCHAR AS since FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap DESC, day) AS k FROM g WHERE gap IS NOT NULL) WHERE k = 1""",
    "scan_project_filter": "SELECT doc_id, source FROM documents WHERE n_chars >= 200 AND lang IN ('en', 'de')",
    "graph_json": f"""WITH {_N} SELECT id, '{{"id":' || id || ',"kind":' || coalesce('"' || kind || '"', 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"pos":' || coalesce(pos::VARCHAR, 'null') || '}}' AS json FROM n""",
    "network_json": f"""WITH {_N}, {_L} SELECT 'node' AS kind, '{{"id":' || id || ',"label":"' || coalesce(name, '?') || '"}}' AS json FROM n UNION ALL SELECT DISTINCT 'edge', '{{"from":' || src || ',"to":' || dst || ',"label":"' || label || '"}}' FROM l WHERE label IS NOT NULL""",
}
