"""Queries on raw records: rejected lines, hierarchies, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.operators.hierarchy import containment_links, descendant_rows, resolve_hierarchy
from kernelweave.operators.malformed import load_assertions
from kernelweave.operators.shredding import number_leaves, shred_list, shred_objects, whole_number
from kernelweave.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line that cannot be loaded, with the first reason."""
    return load_assertions(table(spark, d, "conceptnet_line").select("line_id", "raw_line"))[1].select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows."""
    return load_assertions(table(spark, d, "conceptnet_line").select("line_id", "raw_line"))[0].drop("warnings")


def _gsm(spark: SparkSession, d: str, intervals: bool) -> DataFrame:
    gsm = table(spark, d, "gsm").select("id", "phi")
    return resolve_hierarchy(gsm.select("id"), containment_links(gsm, table(spark, d, "containment_kind")), intervals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, path and status of every graph node."""
    return _gsm(spark, d, False)


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants of every node that is in a tree, from its interval."""
    found = _gsm(spark, d, True).where(F.col("status") == "tree")
    return found.select("node_id", "root_id", (F.col("last") - F.col("first")).alias("n_below"))


def p2_below(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its descendants."""
    return descendant_rows(_gsm(spark, d, True).where(F.col("status") == "tree"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of nested scores and items of nested sources as flat rows."""
    record = table(spark, d, "gsm_record").select("record_id", "payload")
    leaves = number_leaves(shred_objects(record, "record_id", "payload")["score"], "ProvPhi")
    gsm = leaves.select(F.lit("gsm").alias("origin"), "rec_id", "obj_id", F.col("item_no").cast("long").alias("item_no"), F.col("leaf_no").cast("long").alias("leaf_no"), F.col("f.label").alias("label"), whole_number(F.col("f.child")).alias("child"))
    zero = F.lit(0).cast("long")
    sources = shred_list(table(spark, d, "conceptnet_edge").select("edge_id", "data"), "edge_id", "data", "sources")
    data = sources.select(F.lit("data").alias("origin"), "rec_id", zero.alias("obj_id"), F.col("item_no").cast("long").alias("item_no"), zero.alias("leaf_no"), F.coalesce("f.contributor", F.lit("")).alias("label"), zero.alias("child"))
    return gsm.unionByName(data)


_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_LINES = f"""
WITH line AS (
  SELECT line_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS t FROM conceptnet_line
), shape AS (
  SELECT *, regexp_full_match(t, '{_FIELD}(?:\\t{_FIELD})*') AS sound, regexp_full_match(t, '{_FIELD}(?:\\t{_FIELD}){{6}}') AS seven FROM line
), cut AS (
  SELECT *, CASE WHEN seven THEN regexp_extract(t, '^(?:{_FIELD}\\t){{3}}({_FIELD})\\t', 1) END AS s0,
    CASE WHEN seven THEN regexp_extract(t, '^(?:{_FIELD}\\t){{4}}({_FIELD})\\t', 1) END AS e0,
    CASE WHEN seven THEN regexp_extract(t, '^(?:{_FIELD}\\t){{6}}({_FIELD})$', 1) END AS d0 FROM shape
), plain AS (
  SELECT *, CASE WHEN s0[1] = '"' THEN replace(s0[2:-2], '""', '"') ELSE s0 END AS s, CASE WHEN e0[1] = '"' THEN replace(e0[2:-2], '""', '"') ELSE e0 END AS e,
    CASE WHEN d0[1] = '"' THEN replace(d0[2:-2], '""', '"') ELSE d0 END AS d FROM cut
), judged AS (
  SELECT *, coalesce(json_valid(d) AND json_type(CASE WHEN json_valid(d) THEN d END) = 'OBJECT'
      AND NOT regexp_matches(regexp_replace(d, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]|(?i)nan|inf|/'), FALSE) AS ok FROM plain
)
"""
_CONCEPT = r"/c/[a-z]{2,3}/[^/\s\p{Z}]+(?:/[^\s\p{Z}]*)?"
P1_SQL = _LINES + f"""
SELECT line_id, reason FROM (SELECT line_id, CASE WHEN t IS NULL THEN 'columns' WHEN NOT sound THEN 'quoting' WHEN NOT seven THEN 'columns' WHEN NOT ok THEN 'bad_data'
  WHEN NOT regexp_full_match(s, '{_CONCEPT}') THEN 'bad_start'
  WHEN NOT regexp_full_match(e, '{_CONCEPT}|https?://[^\\s\\p{{Z}}]+') THEN 'bad_end' END AS reason FROM judged) WHERE reason IS NOT NULL
"""

_PART = "CASE WHEN f{k}[1] = '\"' THEN replace(f{k}[2:-2], '\"\"', '\"') ELSE f{k} END"
_CUTS = ", ".join(f"regexp_extract(t, '^(?:{_FIELD}\\t){{{{{k}}}}}({_FIELD})(?:\\t|$)', 1) AS f{k}".replace("{{", "{").replace("}}", "}") for k in range(7))
P1_LOADED_SQL = _LINES + f"""
SELECT line_id, {", ".join(f"{_PART.format(k=k)} AS {n}" for k, n in enumerate(("id", "uri", "relation_id", "start_id", "end_id")))}, {_PART.format(k=6)} AS data, TRY_CAST({_PART.format(k=5)} AS DOUBLE) AS weight
FROM (SELECT line_id, {_CUTS} FROM judged WHERE ok AND regexp_full_match(s, '{_CONCEPT}') AND regexp_full_match(e, '{_CONCEPT}|https?://[^\\s\\p{{Z}}]+'))
"""

P2_SQL = r"""
WITH RECURSIVE node AS (SELECT DISTINCT id FROM gsm WHERE id IS NOT NULL),
item AS (SELECT id AS parent, unnest(phi) AS p FROM gsm),
link AS (SELECT p.content AS child, min(parent) AS parent FROM item
  WHERE regexp_replace(lower(p.containment), '^\s+|\s+$', '', 'g') IN (SELECT containment FROM containment_kind WHERE is_tree)
    AND p.content IN (SELECT id FROM node) GROUP BY 1),
tree AS (
  SELECT id AS node_id, id AS root_id, 0::BIGINT AS depth, id::VARCHAR AS path FROM node WHERE id NOT IN (SELECT child FROM link)
  UNION ALL SELECT l.child, t.root_id, t.depth + 1, t.path || '/' || l.child FROM tree t JOIN link l ON l.parent = t.node_id),
bad AS (SELECT id FROM node WHERE id NOT IN (SELECT node_id FROM tree)),
up AS (SELECT b.id, l.parent AS anc FROM bad b JOIN link l ON l.child = b.id
  UNION SELECT u.id, l.parent FROM up u JOIN link l ON l.child = u.anc)
SELECT node_id, root_id, depth, path, 'tree' AS status FROM tree
UNION ALL SELECT id, -1, -1, '', CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.id = bad.id AND up.anc = bad.id) THEN 'on_cycle' ELSE 'under_cycle' END FROM bad
"""

_BELOW = P2_SQL.partition("bad AS")[0].rstrip().rstrip(",") + """, pair AS (SELECT node_id, node_id AS anc FROM tree UNION ALL SELECT p.node_id, l.parent FROM pair p JOIN link l ON l.child = p.anc)
"""
P2_BELOW_SQL = _BELOW + "SELECT anc AS node_id, node_id AS below FROM pair WHERE anc <> node_id"
P2_DESCENDANTS_SQL = _BELOW + "SELECT anc AS node_id, any_value(t.root_id) AS root_id, count(*) - 1 AS n_below FROM pair JOIN tree t ON t.node_id = pair.anc GROUP BY 1"

_DECODE = "CASE WHEN {x} IS NOT NULL AND json_type({x}) = 'VARCHAR' AND json_valid(json_extract_string({x}, '$')) THEN json_extract_string({x}, '$')::JSON ELSE {x} END"
_LISTED = "CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{x}] END"
P5_SQL = f"""
WITH RECURSIVE rec AS (SELECT record_id AS rec_id, {_DECODE.format(x="payload::JSON")} AS p FROM gsm_record WHERE json_valid(payload)),
top AS (SELECT rec_id, {_DECODE.format(x="o")} AS o FROM (SELECT rec_id, CASE WHEN json_type(p) = 'OBJECT' AND json_exists(p, '$.objects') THEN json_extract(p, '$.objects') ELSE p END AS o FROM rec)),
obj AS (SELECT rec_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS obj_pos FROM (SELECT rec_id, {_LISTED.format(x="o")} AS l FROM top)),
obj2 AS (SELECT rec_id, obj_pos, {_DECODE.format(x="o")} AS o FROM obj),
phi AS (SELECT rec_id, obj_pos, json_extract_string(o, '$.id')::BIGINT AS obj_id, {_DECODE.format(x="json_extract(o, '$.phi')")} AS p FROM obj2),
item AS (SELECT rec_id, obj_pos, obj_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS item_no FROM (SELECT *, {_LISTED.format(x="p")} AS l FROM phi)),
score AS (SELECT rec_id, obj_pos, obj_id, item_no, {_DECODE.format(x="json_extract(p, '$.score')")} AS s FROM (SELECT rec_id, obj_pos, obj_id, item_no, {_DECODE.format(x="p")} AS p FROM item)),
walk AS (
  SELECT rec_id, obj_pos, obj_id, item_no, s, []::BIGINT[] AS path FROM score WHERE json_type(s) = 'OBJECT'
  UNION ALL
  SELECT rec_id, obj_pos, obj_id, item_no, {_DECODE.format(x="c")}, list_append(path, k) FROM (
    SELECT rec_id, obj_pos, obj_id, item_no, path, unnest(l) AS c, generate_subscripts(l, 1) AS k FROM (
      SELECT *, {_LISTED.format(x="v")} AS l FROM (SELECT *, {_DECODE.format(x="coalesce(json_extract(s, '$.sum_operands'), json_extract(s, '$.prod_operands'))")} AS v FROM walk)))
),
src AS (SELECT edge_id, {_DECODE.format(x="json_extract(d, '$.sources')")} AS s FROM (SELECT edge_id, {_DECODE.format(x="data::JSON")} AS d FROM conceptnet_edge WHERE json_valid(data))),
one AS (SELECT edge_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS k FROM (SELECT edge_id, {_LISTED.format(x="s")} AS l FROM src))
SELECT 'gsm' AS origin, rec_id, obj_id, item_no, row_number() OVER (PARTITION BY rec_id, obj_pos, item_no ORDER BY path) - 1 AS leaf_no, json_extract_string(s, '$.label') AS label, json_extract_string(s, '$.child')::BIGINT AS child
FROM walk WHERE json_extract_string(s, '$.type') = 'ProvPhi'
UNION ALL SELECT 'data', edge_id, 0, k, 0, coalesce(json_extract_string({_DECODE.format(x="s")}, '$.contributor'), ''), 0 FROM one
"""

QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p2_found": p2_found, "p2_descendants": p2_descendants, "p2_below": p2_below, "p5_found": p5_found}
ORACLES = {"p1_found": P1_SQL, "p1_loaded": P1_LOADED_SQL, "p2_found": P2_SQL, "p2_descendants": P2_DESCENDANTS_SQL, "p2_below": P2_BELOW_SQL, "p5_found": P5_SQL}
