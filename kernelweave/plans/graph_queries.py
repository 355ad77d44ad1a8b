"""Queries on graphs and triples: closure, components, levels, removal, order, patterns, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kernelweave.functions.text import connector, negated
from kernelweave.operators import graphs as G
from kernelweave.operators import triples as R
from kernelweave.plans.mentions import _N, nodes_of, sentences_of
from kernelweave.runtime import table

HIERARCHY = ("IsA", "PartOf", "HasPiece")


def kind_of(label: Column) -> Column:
    """A containment as its kind is written."""
    return F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def links_of(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links between the graphs' nodes: sent_id, src, label, dst, negated; both ends exist."""
    gsm = table(spark, d, "gsm").dropDuplicates(["id"])
    flat = gsm.select("sent_id", F.col("id").alias("src"), F.explode("phi").alias("p"))
    flat = flat.select("sent_id", "src", kind_of(F.col("p.containment")).alias("label"), F.col("p.content").alias("dst"), F.coalesce(negated(F.col("p.properties")["kernel"]), F.lit(False)).alias("negated"))
    return flat.where("dst IS NOT NULL").distinct().join(gsm.select(F.col("id").alias("dst")), "dst", "left_semi").select("sent_id", "src", "label", "dst", "negated")


def assertions_of(spark: SparkSession, d: str) -> DataFrame:
    """s, p, o of the assertion table: concepts and short relation names."""
    return table(spark, d, "conceptnet_edge").select(F.col("start_id").alias("s"), F.regexp_replace("relation_id", "^/r/", "").alias("p"), F.col("end_id").alias("o")).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def surfaces_of(spark: SparkSession, d: str) -> DataFrame:
    """s, p, o of the compact relations, surfaces in lower case."""
    return table(spark, d, "compact_relation").select(F.lower("surface_start").alias("s"), F.col("rel").alias("p"), F.lower("surface_end").alias("o")).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def node_store(spark: SparkSession, d: str) -> DataFrame:
    """s, p, o of the graphs' nodes: kind, name and links."""
    node = nodes_of(spark, d)
    text = lambda c: F.col(c).cast("string")
    parts = [node.where("kind IS NOT NULL").select(text("id").alias("s"), F.lit("kind").alias("p"), F.col("kind").alias("o")), node.where("name IS NOT NULL").select(text("id").alias("s"), F.lit("name").alias("p"), F.col("name").alias("o"))]
    return parts[0].unionByName(parts[1]).unionByName(links_of(spark, d).where("label IS NOT NULL").select(text("src").alias("s"), F.col("label").alias("p"), text("dst").alias("o")).distinct())


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Labelled edges of the graphs, negation split off; edges between versions of a node are left out."""
    return links_of(spark, d).where(F.col("label").isNull() | ~F.contains("label", F.lit("orig")))


def graph_triples(spark: SparkSession, d: str) -> DataFrame:
    """Distinct triples of names that the edges of the graphs connect."""
    node = nodes_of(spark, d).where("name IS NOT NULL").select("id", "name")
    met = links_of(spark, d).join(node.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(node.select(F.col("id").alias("dst"), F.col("name").alias("o")), "dst")
    return met.select("s", F.col("label").alias("p"), "o").distinct()


def sense_triples(spark: SparkSession, d: str) -> DataFrame:
    """Typed triples of the nodes: labels, values, lemma and links, symmetric kinds in both directions."""
    gsm = table(spark, d, "gsm").dropDuplicates(["id"])
    text = F.col("id").cast("string")
    flat = lambda c, p: gsm.select(text.alias("s"), F.lit(p).alias("p"), F.explode(c).alias("o"))
    own = flat("ell", "label").unionByName(flat("xi", "value")).unionByName(gsm.select(text.alias("s"), F.lit("lemma").alias("p"), F.col("properties")["lemma"].alias("o")))
    links = links_of(spark, d).select(F.col("src").cast("string").alias("s"), F.col("label").alias("p"), F.col("dst").cast("string").alias("o"))
    back = links.where(F.col("p").isin("same_as", "coref")).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return own.where("o IS NOT NULL").unionByName(links.where("p IS NOT NULL")).unionByName(back).distinct()


def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    """Closure of the hierarchy of the assertions: IsA upwards, PartOf upwards, HasPiece turned round."""
    rows = assertions_of(spark, d)
    up = rows.where(F.col("p").isin("IsA", "PartOf")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return G.transitive_closure(up.unionByName(rows.where("p = 'HasPiece'").select(F.col("o").alias("src"), F.col("s").alias("dst"))))


def _alike(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "relation_map").where("is_symmetric AND NOT rel_negated").select(F.col("label").alias("p"))
    return rows.join(F.broadcast(kinds), "p", "left_semi").select(F.col("s").alias("src"), F.col("o").alias("dst"))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of concepts that symmetric relations connect."""
    return G.connected_components(_alike(assertions_of(spark, d), spark, d))


def component_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and representative of every component."""
    return connected_components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("last"))


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Assertions with both ends replaced by the representative of their component, or left as they are."""
    rows = assertions_of(spark, d)
    rep = G.connected_components(_alike(rows, spark, d))
    out = rows.join(rep.select(F.col("node").alias("s"), F.col("component").alias("rs")), "s", "left").join(rep.select(F.col("node").alias("o"), F.col("component").alias("ro")), "o", "left")
    return out.select(F.coalesce("rs", "s").alias("s"), "p", F.coalesce("ro", "o").alias("o")).distinct()


def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """Fewest steps to every concept from the concepts that nothing points at."""
    edges = G.clean(assertions_of(spark, d).select(F.col("s").alias("src"), F.col("o").alias("dst")))
    seeds = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return G.bfs_levels(edges, seeds)


def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    """Topological rank and longest path from a source of every node in its sentence's graph."""
    node = nodes_of(spark, d).select("sent_id", F.col("id").alias("src"))
    inner = links_of(spark, d).select("sent_id", "src", "dst").join(node.select("sent_id", F.col("src").alias("dst")), ["sent_id", "dst"], "left_semi").select("sent_id", "src", "dst")
    return G.group_order(node.withColumn("dst", F.lit(None).cast("long")).unionByName(inner), "sent_id", G.topological("sent_id"))


def path_levels(spark: SparkSession, d: str) -> DataFrame:
    """Longest path from a source to every node that is neither on a cycle nor after one."""
    return topo_levels(spark, d).where("level IS NOT NULL").select("node", "level")


def reconnect_removed_node(spark: SparkSession, d: str) -> DataFrame:
    """Links of the graphs after the nodes labelled IN are removed, their parents tied to their children."""
    gone = nodes_of(spark, d).where("kind = 'IN'").select(F.col("id").alias("node"))
    return G.remove_nodes(links_of(spark, d).select("src", "dst"), gone)


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Links out of and into every node, with its role: isolated, root, leaf or inner."""
    found = G.degrees(nodes_of(spark, d).select(F.col("id").alias("node")), links_of(spark, d).select("src", "dst"))
    role = F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "isolated").when(F.col("n_in") == 0, "root").when(F.col("n_out") == 0, "leaf").otherwise("inner")
    return found.select("node", "n_out", "n_in", role.alias("role"))


def node_parents(spark: SparkSession, d: str) -> DataFrame:
    """Number of parents and first parent of every node by label of the link."""
    return links_of(spark, d).where("label IS NOT NULL").groupBy(F.col("dst").alias("node"), "label").agg(F.count_distinct("src").alias("n"), F.min("src").alias("first"))


def negated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a child by `neg`, their name wrapped in NOT."""
    marked = links_of(spark, d).where("label = 'neg'").select(F.col("src").alias("id")).distinct()
    return nodes_of(spark, d).join(marked, "id", "left_semi").select("id", F.concat(F.lit("NOT("), F.coalesce("name", F.lit("?")), F.lit(")")).alias("name"))


def contract_groups(spark: SparkSession, d: str) -> DataFrame:
    """Members of the set that the children by `conj` or `compound` of a node make, in order of position; the sentence's connector names the set's kind."""
    links = links_of(spark, d).where(F.col("label").isin("conj", "compound")).select("sent_id", "src", "label", "dst").distinct()
    node = nodes_of(spark, d).select(F.col("id").alias("dst"), "pos")
    kind = sentences_of(spark, d).select("sent_id", connector(F.col("text")).alias("connector")).groupBy("sent_id").agg(F.min("connector").alias("connector"))
    order = Window.partitionBy("src", "label").orderBy("pos", "dst")
    rows = links.join(node, "dst").join(kind, "sent_id", "left")
    grouping = F.when(F.col("label") == "compound", "GROUPING").otherwise(F.coalesce("connector", F.lit("NONE")))
    return rows.select("src", "label", F.col("dst").alias("member"), F.row_number().over(order).alias("ordinal"), grouping.alias("kind"))


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one type of event of a user, with their length and span of ids."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    marked = G.runs(rows, "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"), "event_type")
    return marked.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def bgp_label_edge(spark: SparkSession, d: str) -> DataFrame:
    """Verbs with a subject that is a noun, with both names."""
    return R.bgp(node_store(spark, d), [("?v", "nsubj", "?n"), ("?v", "kind", "verb"), ("?n", "kind", "noun"), ("?v", "name", "?verb"), ("?n", "name", "?noun")])


def bgp_capability(spark: SparkSession, d: str) -> DataFrame:
    """Verbs with subject and object, with all names."""
    return R.bgp(node_store(spark, d), [("?v", "nsubj", "?x"), ("?v", "dobj", "?y"), ("?v", "name", "?verb"), ("?x", "name", "?subject"), ("?y", "name", "?object")])


def bgp_adjective(spark: SparkSession, d: str) -> DataFrame:
    """Nodes qualified by an adjective, with what they are part of where there is such a link, unless they are negated."""
    return R.bgp(node_store(spark, d), [("?n", "amod", "?a"), ("?n", "name", "?noun"), ("?a", "name", "?adjective")], optional=[[("?n", "nmod:of", "?w"), ("?w", "name", "?whole")]], negative=[[("?n", "neg", "?z")]])


def bgp_optional_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that are something, with the first object and number of objects of their other relations."""
    return R.pivot(surfaces_of(spark, d), ["IsA", "PartOf", "UsedFor", "FoundAt", "HasTrait"], "IsA")


def bgp_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Pairs lower, upper: IsA as it stands united with HasPiece turned round and PartOf."""
    rows = surfaces_of(spark, d)
    up = R.match(rows, ("?lower", "IsA", "?upper"))
    return R.union(up, R.match(rows, ("?lower", "PartOf", "?upper")), R.match(rows, ("?upper", "HasPiece", "?lower")))


def neighbour_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Concepts next to every concept by UsedFor, along and against the relation."""
    rows = surfaces_of(spark, d)
    return R.neighbours(rows, "UsedFor").withColumn("way", F.lit("out")).unionByName(R.neighbours(rows, "UsedFor", False).withColumn("way", F.lit("in")))


def supertypes_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every class of every customer: nation, region and the class of all."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    instances = table(spark, d, "customer").select(key("customer/", "c_custkey").alias("node"), key("nation/", "c_nationkey").alias("type"))
    classes = nation.select(key("nation/", "n_nationkey").alias("type"), key("region/", "n_regionkey").alias("above")).unionByName(region.select(key("region/", "r_regionkey").alias("type"), F.lit("world").alias("above")))
    return R.super_types(instances, classes)


def qa_union_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that answer all parts of a question: they are something or a piece of something, and they are used for or found at something.

    Answers are united within a part and intersected across parts, in one aggregation over flags.
    """
    rows = surfaces_of(spark, d)
    sides = rows.select(F.explode(F.array(F.struct(F.col("s").alias("x"), F.concat(F.col("p"), F.lit(">")).alias("p")), F.struct(F.col("o").alias("x"), F.concat(F.lit("<"), F.col("p")).alias("p")))).alias("e")).select("e.*")
    flags = sides.groupBy("x").agg(F.bool_or(F.col("p").isin("IsA>", "<HasPiece")).alias("is"), F.bool_or(F.col("p").isin("UsedFor>", "FoundAt>")).alias("does"))
    return flags.where("is AND does").select(F.col("x").alias("answer"))


def qa_negated_edges(spark: SparkSession, d: str) -> DataFrame:
    """Answers of `x RelatedTo y` after all pairs that a negated relation names, in either direction, are taken from the graph."""
    rows = surfaces_of(spark, d)
    denied = table(spark, d, "relation_map").where("rel_negated").select(F.col("label").alias("p"))
    bad = rows.join(F.broadcast(denied), "p", "left_semi").select("s", "o")
    bad = bad.unionByName(bad.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()
    return rows.where("p = 'RelatedTo'").select("s", "o").distinct().join(bad, ["s", "o"], "left_anti")


_L = r"""l AS (SELECT DISTINCT sent_id, src, label, dst, negated FROM (SELECT sent_id, id AS src, regexp_replace(lower(p.containment), '^\s+|\s+$', '', 'g') AS label, p.content AS dst,
  coalesce(regexp_matches(p.properties['kernel'], '(?i)(?:^|[^\p{L}\p{N}])(?:not|no)(?:[^\p{L}\p{N}]|$)'), FALSE) AS negated FROM (SELECT DISTINCT ON (id) sent_id, id, unnest(phi) AS p FROM (SELECT * FROM gsm)))
  WHERE dst IN (SELECT id FROM gsm))"""
_L = _L.replace("(SELECT DISTINCT ON (id) sent_id, id, unnest(phi) AS p FROM (SELECT * FROM gsm))", "(SELECT sent_id, id, unnest(phi) AS p FROM (SELECT DISTINCT ON (id) * FROM gsm))")
_A = "a AS (SELECT DISTINCT start_id AS s, replace(relation_id, '/r/', '') AS p, end_id AS o FROM conceptnet_edge WHERE start_id IS NOT NULL AND relation_id IS NOT NULL AND end_id IS NOT NULL)"
_C = "c AS (SELECT lower(surface_start) AS s, rel AS p, lower(surface_end) AS o FROM compact_relation WHERE surface_start IS NOT NULL AND rel IS NOT NULL AND surface_end IS NOT NULL)"
_COMP = """e0 AS (SELECT DISTINCT s AS src, o AS dst FROM a WHERE s <> o AND p IN (SELECT label FROM relation_map WHERE is_symmetric AND NOT rel_negated)),
  e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0),
  r AS (SELECT src AS node, src AS reach FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach),
  comp AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)"""
_T = f"""{_N}, {_L}, t AS (SELECT id::VARCHAR AS s, 'kind' AS p, kind AS o FROM n WHERE kind IS NOT NULL UNION ALL SELECT id::VARCHAR, 'name', name FROM n WHERE name IS NOT NULL
  UNION ALL SELECT DISTINCT src::VARCHAR, label, dst::VARCHAR FROM l WHERE label IS NOT NULL)"""
_HAS = r"regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{w})(?:[^\p{{L}}\p{{N}}]|$)')"
_CONN = f"CASE WHEN {_HAS.format(w='neither|nor')} THEN 'NEITHER' WHEN {_HAS.format(w='or')} THEN 'OR' WHEN {_HAS.format(w='and|but')} THEN 'AND' ELSE 'NONE' END"

QUERIES = {
    f.__name__: f
    for f in (graph_edges, graph_triples, sense_triples, transitive_closure, connected_components, component_clusters, cluster_representatives, bfs_depth, topo_levels, path_levels, reconnect_removed_node, node_degrees, node_parents, negated_nodes, contract_groups, event_runs, bgp_label_edge, bgp_capability, bgp_adjective, bgp_optional_pivot, bgp_union_distinct, neighbour_nodes, supertypes_closure, qa_union_intersect, qa_negated_edges)
}
ORACLES = {
    "graph_edges": f"WITH {_L} SELECT * FROM l WHERE label IS NULL OR NOT contains(label, 'orig')",
    "graph_triples": f"WITH {_N}, {_L} SELECT DISTINCT x.name AS s, l.label AS p, y.name AS o FROM l JOIN n x ON x.id = l.src JOIN n y ON y.id = l.dst WHERE x.name IS NOT NULL AND y.name IS NOT NULL",
    "sense_triples": f"""WITH {_L}, g AS (SELECT DISTINCT ON (id) * FROM gsm), t AS (SELECT id::VARCHAR AS s, 'label' AS p, unnest(ell) AS o FROM g UNION ALL SELECT id::VARCHAR, 'value', unnest(xi) FROM g UNION ALL SELECT id::VARCHAR, 'lemma', properties['lemma'] FROM g
      UNION ALL SELECT src::VARCHAR, label, dst::VARCHAR FROM l WHERE label IS NOT NULL UNION ALL SELECT dst::VARCHAR, label, src::VARCHAR FROM l WHERE label IN ('same_as', 'coref')) SELECT DISTINCT s, p, o FROM t WHERE o IS NOT NULL""",
    "transitive_closure": f"""WITH RECURSIVE {_A}, e AS (SELECT s AS src, o AS dst FROM a WHERE p IN ('IsA', 'PartOf') UNION SELECT o, s FROM a WHERE p = 'HasPiece'),
      r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r WHERE src <> dst""",
    "connected_components": f"WITH RECURSIVE {_A}, {_COMP} SELECT node, component FROM comp",
    "component_clusters": f"WITH RECURSIVE {_A}, {_COMP} SELECT component, count(*) AS n, max(node) AS last FROM comp GROUP BY 1",
    "cluster_representatives": f"WITH RECURSIVE {_A}, {_COMP} SELECT DISTINCT coalesce(x.component, a.s) AS s, a.p, coalesce(y.component, a.o) AS o FROM a LEFT JOIN comp x ON x.node = a.s LEFT JOIN comp y ON y.node = a.o",
    "bfs_depth": f"""WITH RECURSIVE {_A}, e AS (SELECT DISTINCT s AS src, o AS dst FROM a WHERE s <> o), w AS (SELECT DISTINCT src AS node, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e)
      UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 40) SELECT node, min(depth) AS depth FROM w GROUP BY 1""",
    "path_levels": f"""WITH RECURSIVE {_N}, {_L}, e AS (SELECT DISTINCT l.src, l.dst FROM l JOIN n x ON x.id = l.src JOIN n y ON y.id = l.dst WHERE l.src <> l.dst AND x.sent_id = y.sent_id),
      up AS (SELECT dst AS id, src AS anc FROM e UNION SELECT up.id, e.src FROM up JOIN e ON e.dst = up.anc), ring AS (SELECT DISTINCT id FROM up WHERE id = anc),
      bad AS (SELECT id FROM ring UNION SELECT id FROM up WHERE anc IN (SELECT id FROM ring)),
      w AS (SELECT id AS node, 0::BIGINT AS level FROM n WHERE id NOT IN (SELECT id FROM bad) AND id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node WHERE e.dst NOT IN (SELECT id FROM bad))
      SELECT node, max(level) AS level FROM w GROUP BY 1""",
    "reconnect_removed_node": f"""WITH RECURSIVE {_N}, {_L}, e AS (SELECT DISTINCT src, dst FROM l WHERE src <> dst), g AS (SELECT id FROM n WHERE kind = 'IN'),
      w AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM g) UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst WHERE w.dst IN (SELECT id FROM g))
      SELECT DISTINCT src, dst FROM w WHERE dst NOT IN (SELECT id FROM g) AND src <> dst""",
    "node_degrees": f"""WITH {_N}, {_L}, e AS (SELECT DISTINCT src, dst FROM l WHERE src <> dst), k AS (SELECT id AS node, (SELECT count(*) FROM e WHERE e.src = n.id) AS n_out, (SELECT count(*) FROM e WHERE e.dst = n.id) AS n_in FROM n)
      SELECT *, CASE WHEN n_in = 0 AND n_out = 0 THEN 'isolated' WHEN n_in = 0 THEN 'root' WHEN n_out = 0 THEN 'leaf' ELSE 'inner' END AS role FROM k""",
    "node_parents": f"WITH {_L} SELECT dst AS node, label, count(DISTINCT src) AS n, min(src) AS first FROM l WHERE label IS NOT NULL GROUP BY 1, 2",
    "negated_nodes": f"WITH {_N}, {_L} SELECT id, 'NOT(' || coalesce(name, '?') || ')' AS name FROM n WHERE id IN (SELECT src FROM l WHERE label = 'neg')",
    "contract_groups": f"""WITH {_N}, {_L}, k AS (SELECT sent_id, min({_CONN}) AS connector FROM sentence WHERE text IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT sent_id, src, label, dst FROM l WHERE label IN ('conj', 'compound'))
      SELECT m.src, m.label, m.dst AS member, row_number() OVER (PARTITION BY m.src, m.label ORDER BY n.pos NULLS FIRST, m.dst) AS ordinal, CASE WHEN m.label = 'compound' THEN 'GROUPING' ELSE coalesce(k.connector, 'NONE') END AS kind
      FROM m JOIN n ON n.id = m.dst LEFT JOIN k ON k.sent_id = m.sent_id""",
    "event_runs": """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY 1, 2, 3""",
    "bgp_label_edge": f"""WITH {_T} SELECT DISTINCT e.s AS v, e.o AS n, x.o AS verb, y.o AS noun FROM t e JOIN t a ON a.s = e.s AND a.p = 'kind' AND a.o = 'verb' JOIN t b ON b.s = e.o AND b.p = 'kind' AND b.o = 'noun'
      JOIN t x ON x.s = e.s AND x.p = 'name' JOIN t y ON y.s = e.o AND y.p = 'name' WHERE e.p = 'nsubj'""",
    "bgp_capability": f"""WITH {_T} SELECT DISTINCT e.s AS v, e.o AS x, f.o AS y, v.o AS verb, a.o AS subject, b.o AS object FROM t e JOIN t f ON f.s = e.s AND f.p = 'dobj' JOIN t v ON v.s = e.s AND v.p = 'name'
      JOIN t a ON a.s = e.o AND a.p = 'name' JOIN t b ON b.s = f.o AND b.p = 'name' WHERE e.p = 'nsubj'""",
    "bgp_adjective": f"""WITH {_T}, k AS (SELECT DISTINCT e.s AS n, e.o AS a, x.o AS noun, y.o AS adjective FROM t e JOIN t x ON x.s = e.s AND x.p = 'name' JOIN t y ON y.s = e.o AND y.p = 'name' WHERE e.p = 'amod'),
      o AS (SELECT e.s AS n, e.o AS w, x.o AS whole FROM t e JOIN t x ON x.s = e.o AND x.p = 'name' WHERE e.p = 'nmod:of')
      SELECT DISTINCT k.n, k.a, k.noun, k.adjective, o.w, o.whole FROM k LEFT JOIN o ON o.n = k.n WHERE k.n NOT IN (SELECT s FROM t WHERE p = 'neg')""",
    "bgp_optional_pivot": "WITH " + _C + " SELECT s, " + ", ".join(f"min(o) FILTER (WHERE p = '{p}') AS {p.lower()}, count(DISTINCT o) FILTER (WHERE p = '{p}') AS n_{p.lower()}" for p in ("IsA", "PartOf", "UsedFor", "FoundAt", "HasTrait")) + " FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE p = 'IsA') > 0",
    "bgp_union_distinct": f"WITH {_C} SELECT s AS lower, o AS upper FROM c WHERE p = 'IsA' UNION SELECT s, o FROM c WHERE p = 'PartOf' UNION SELECT o, s FROM c WHERE p = 'HasPiece'",
    "neighbour_nodes": f"WITH {_C} SELECT DISTINCT s AS node, p AS label, o AS neighbour, 'out' AS way FROM c WHERE p = 'UsedFor' UNION ALL SELECT DISTINCT o, p, s, 'in' FROM c WHERE p = 'UsedFor'",
    "supertypes_closure": """WITH RECURSIVE up AS (SELECT 'nation/' || n_nationkey AS type, 'region/' || n_regionkey AS above FROM nation UNION SELECT 'region/' || r_regionkey, 'world' FROM region),
      w AS (SELECT 'customer/' || c_custkey AS node, 'nation/' || c_nationkey AS type, 0 AS steps FROM customer UNION SELECT w.node, up.above, w.steps + 1 FROM w JOIN up ON up.type = w.type) SELECT node, type, min(steps) AS steps FROM w GROUP BY 1, 2""",
    "qa_union_intersect": f"""WITH {_C} SELECT x AS answer FROM (SELECT s AS x FROM c WHERE p = 'IsA' UNION SELECT o FROM c WHERE p = 'HasPiece') INTERSECT SELECT s FROM c WHERE p IN ('UsedFor', 'FoundAt')""",
    "qa_negated_edges": f"""WITH {_C}, b AS (SELECT s, o FROM c WHERE p IN (SELECT label FROM relation_map WHERE rel_negated)) SELECT s, o FROM c WHERE p = 'RelatedTo' EXCEPT (SELECT s, o FROM b UNION SELECT o, s FROM b)""",
}
