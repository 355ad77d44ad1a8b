"""Queries on rules, verdicts and possible worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.functions.text import connector
from kernelweave.operators import rules as U
from kernelweave.operators import verdicts as V
from kernelweave.operators import worlds as W
from kernelweave.plans.graph_queries import _A, _CONN, _L, assertions_of, links_of, surfaces_of
from kernelweave.plans.mentions import _N, nodes_of, sentences_of
from kernelweave.runtime import cut, table

#: Roles of a node in its sentence: order, role, what it needs, what it must not have.
ROLES = (
    U.Rule(1, "space", {"kind": ["GPE"], "into": ["nmod:in", "case", "obl"]}),
    U.Rule(2, "specification", {"into": ["nmod:of"]}, {"kind": ["verb"]}),
    U.Rule(3, "negated action", {"kind": ["verb"], "out": ["neg"]}),
    U.Rule(4, "action", {"kind": ["verb"]}, {"into": ["amod"]}),
    U.Rule(5, "quality", {"into": ["amod", "advmod", "acl"]}),
    U.Rule(6, "participant", {"kind": ["noun", "NNP", "GPE"], "into": ["nsubj", "dobj"]}),
    U.Rule(7, "relation", {"kind": ["IN"]}, {"out": ["neg"]}),
    U.Rule(8, "member", {"into": ["conj", "compound", "appos"]}),
)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the labels of the links into and out of them."""
    link = links_of(spark, d).where("label IS NOT NULL")
    into = link.groupBy(F.col("dst").alias("id")).agg(F.collect_set("label").alias("into"))
    out = link.groupBy(F.col("src").alias("id")).agg(F.collect_set("label").alias("out"))
    return nodes_of(spark, d).join(into, "id", "left").join(out, "id", "left")


def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Role that the first matching rule gives to every node of the graphs."""
    features = {"kind": F.array("kind"), "into": F.col("into"), "out": F.col("out")}
    found = _features(spark, d).withColumn("m", U.first_match(ROLES, features))
    return found.select("id", F.col("m.order").alias("rule_order"), F.coalesce("m.result", F.lit("none")).alias("role"))


def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    """Number of nodes that each rule matches, whether or not an earlier one did."""
    features = {"kind": F.array("kind"), "into": F.col("into"), "out": F.col("out")}
    return _features(spark, d).select(F.explode(U.all_matches(ROLES, features)).alias("rule_order")).groupBy("rule_order").agg(F.count(F.lit(1)).alias("n"))


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conceptnet_edge").where("start_id IS NOT NULL AND relation_id IS NOT NULL AND end_id IS NOT NULL")
    return ids.groupBy(F.regexp_replace("relation_id", "^/r/", "").alias("p"), F.col("start_id").alias("s"), F.col("end_id").alias("o")).agg(F.min("edge_id").alias("origin"))


def _expansion(spark: SparkSession, d: str) -> U.Expansion:
    rows = cut(_atoms(spark, d))
    ends = lambda p: rows.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b"))
    renamed = table(spark, d, "relation_map").select(F.col("label").alias("p"), F.col("rel").alias("q"), F.col("rel_negated").alias("flips"))
    return U.expansion(rows, ends("SameAs"), ends("OppositeOf"), renamed)


def rule_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Every assertion with all that equal objects, opposites and renamed relations make of it."""
    return U.expand_atoms(_expansion(spark, d))


def expansion_compare(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on pairs of assertions of which one is among the other's expansion, as it stands or negated."""
    return U.compare_expansions(_expansion(spark, d))


def expansion_members(spark: SparkSession, d: str) -> DataFrame:
    """How many assertions expand to each member and how many to its negation."""
    return U.shared_members(_expansion(spark, d))


def relation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of the relations between two concepts: folded over a start's ends (all) and over the relations of one pair (any)."""
    rows = surfaces_of(spark, d)
    kind = F.when(F.col("p") == "SameAs", V.EQ).when(F.col("p") == "OppositeOf", V.EX).when(F.col("p") == "IsA", V.GE).when(F.col("p") == "PartOf", "INSTANTIATION").when(F.col("p") == "FormOf", "LOSE_SPEC").otherwise(V.IN)
    pairs = rows.groupBy("s", "o").agg(V.fold_any(F.collect_set(kind)).alias("v"))
    return pairs.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.collect_set("v").alias("kinds")).select("s", "n", V.fold_all(F.col("kinds")).alias("all_ends"), V.coarse(V.fold_any(F.col("kinds"))).alias("any_end"))


def name_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on the two concepts of every assertion that relates them."""
    rows = assertions_of(spark, d)
    ends = lambda *p: rows.where(F.col("p").isin(*p)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    pairs = rows.select(F.col("s").alias("a"), F.col("o").alias("b"))
    same = ends("SameAs", "SimilarTo")
    same = same.unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    names = rows.select(F.explode(F.array("s", "o")).alias("name")).distinct()
    types = names.select("name", F.regexp_extract("name", "^/c/([a-z]+)/", 1).alias("type")).where("type <> ''")
    return V.name_verdicts(pairs, types, same, ends("OppositeOf", "NotSameAs").distinct(), ends("IsA", "PartOf").distinct())


#: Terms of the verdict table: key, name, specification, whether all of it is meant.
TERMS = (("N", "n", None, False), ("aN", "n", None, True), ("NCC", "n", "cc", False), ("aNCC", "n", "cc", True), ("CC", "cc", None, False), ("aCC", "cc", None, True))


def term_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts between a place, its centre and the place by its centre, each meant in part or whole."""
    term = "name string, spec string, cop string, as_all boolean, spec_negation boolean"
    made = [(x[0], y[0], (x[1], x[2], None, x[3], False), (y[1], y[2], None, y[3], False)) for x in TERMS for y in TERMS]
    pairs = spark.createDataFrame(made, f"lhs string, rhs string, l struct<{', '.join(c.replace(' ', ': ', 1) for c in term.split(', '))}>, r struct<{', '.join(c.replace(' ', ': ', 1) for c in term.split(', '))}>")
    sides = {"name": ("l.name", "r.name"), "flip": ("r.name", "l.name"), "spec": ("l.spec", "r.spec"), "spec_inv": ("r.spec", "l.spec"), "cop_inv": ("r.cop", "l.cop"), "name_in_spec": ("l.name", "r.spec"), "spec_in_name": ("r.name", "l.spec")}
    asked = pairs.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in sides.values()])).alias("e")).select("e.*")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = V.name_verdicts(asked, frame([("n", "place"), ("cc", "place")], "name string, type string"), frame([], "a string, b string"), frame([], "a string, b string"), frame([("cc", "n")], "a string, b string"))
    for key, (a, b) in sides.items():
        named = F.broadcast(found.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), F.col("verdict").alias(key)))
        pairs = pairs.join(named, F.col(a).eqNullSafe(F.col(f"{key}_a")) & F.col(b).eqNullSafe(F.col(f"{key}_b")))
    return pairs.select("lhs", "rhs", V.term_verdict({k: F.col(k) for k in sides}, F.col("l"), F.col("r")).alias("verdict"))


_P, _Q, _D = W.Atom("p"), W.Atom("q"), W.Atom("r")
FORMULAE = [_P, _Q, W.And((_P, _Q)), W.Or((_P, _Q)), W.Not(_P), W.Not(_Q), _D, W.And((W.Not(_P), W.Not(_Q)))]


def worlds_enumerate(spark: SparkSession, d: str) -> DataFrame:
    """Worlds of three atoms and two negations that their constraints allow, where the first implies the third."""
    return W.enumerate_worlds(spark, [_P, _Q, _D, W.Not(_P), W.Not(_Q)], {(_P, _D): "Implying"})


def natural_join_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Worlds of four atoms under one constraint of each kind."""
    a, b, c, e = (W.Atom(x) for x in "abce")
    return W.enumerate_worlds(spark, [a, b, c, e], {(a, b): "Implying", (b, c): "Equivalent", (a, e): "Conflicting", (c, e): "Indifferent"})


def entailment_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores between eight formulae over three independent atoms."""
    return W.score_formulae(spark, FORMULAE, {}).select("i", "j", F.round("score", 6).alias("score"))


def entailment_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts between the same formulae."""
    return W.score_formulae(spark, FORMULAE, {}).select("i", "j", "verdict")


def _formulae(spark: SparkSession, d: str) -> DataFrame:
    """sent_id, kind, atoms: the sentence's connector over the persons it mentions."""
    people = table(spark, d, "mention").where("type = 'PERSON' AND text IS NOT NULL").select("sent_id", "text").distinct()
    kind = sentences_of(spark, d).groupBy("sent_id").agg(F.min(connector(F.col("text"))).alias("k"))
    atoms = people.groupBy("sent_id").agg(F.array_sort(F.collect_set("text")).alias("atoms"))
    return atoms.join(kind, "sent_id").select("sent_id", F.when(F.col("k") == "NONE", "AND").otherwise(F.col("k")).alias("kind"), "atoms")


def formula_classes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct formulae with the number of sentences that state them."""
    return _formulae(spark, d).groupBy("kind", F.array_join("atoms", "|").alias("atoms")).agg(F.count(F.lit(1)).alias("n"), F.min("sent_id").alias("first"))


def sentence_entailment(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of every hundredth sentence's formula towards every class of formulae that shares an atom with it.

    Conclusions are classes, represented by their first sentence; sentences of one class have one score.
    """
    every = _formulae(spark, d)
    classes = every.groupBy("kind", "atoms").agg(F.min("sent_id").alias("conclusion"))
    asked = every.where("sent_id % 100 = 0").select(F.col("sent_id").alias("premise"), F.col("kind").alias("kind_i"), F.col("atoms").alias("atoms_i"))
    left = asked.select("premise", "kind_i", "atoms_i", F.explode("atoms_i").alias("atom"))
    right = classes.select("conclusion", "kind", "atoms", F.explode("atoms").alias("atom"))
    met = left.join(right, "atom").groupBy("premise", "conclusion").agg(F.count(F.lit(1)).alias("shared"), F.first("kind_i").alias("ki"), F.first("kind").alias("kj"), F.first(F.size("atoms_i")).alias("ni"), F.first(F.size("atoms")).alias("nj"))
    score = W.connective_scores(F.col("ki"), F.col("kj"), F.col("shared"), F.col("ni") - F.col("shared"), F.col("nj") - F.col("shared"))
    return met.select("premise", "conclusion", F.round(score, 6).alias("score"), W.verdict(score).alias("verdict"))


def _role_case() -> str:
    cols = {"kind": "CASE WHEN kind IS NULL THEN [] ELSE [kind] END", "into": "coalesce(i.x, [])", "out": "coalesce(o.x, [])"}
    test = lambda n, vs: f"list_has_any({cols[n]}, [{', '.join(repr(v) for v in vs)}])"
    return [(r.order, r.result, " AND ".join([test(n, v) for n, v in r.premises.items()] + [f"NOT {test(n, v)}" for n, v in r.excluded.items()])) for r in ROLES]


_FEAT = f"{_N}, {_L}, i AS (SELECT dst AS id, list(DISTINCT label) AS x FROM l WHERE label IS NOT NULL GROUP BY 1), o AS (SELECT src AS id, list(DISTINCT label) AS x FROM l WHERE label IS NOT NULL GROUP BY 1)"
_EXP = f"""{_A}, atm AS (SELECT replace(relation_id, '/r/', '') AS p, start_id AS s, end_id AS o, min(edge_id) AS origin FROM conceptnet_edge WHERE start_id IS NOT NULL AND relation_id IS NOT NULL AND end_id IS NOT NULL GROUP BY 1, 2, 3),
  eq AS (SELECT s AS a, o AS b FROM a WHERE p = 'SameAs' AND s <> o UNION SELECT o, s FROM a WHERE p = 'SameAs' AND s <> o), ne AS (SELECT DISTINCT s AS a, o AS b FROM a WHERE p = 'OppositeOf' AND s <> o),
  x AS (SELECT origin, p, s, o, FALSE AS negated FROM atm UNION SELECT origin, r.p, r.s, r.o, r.negated FROM (
    SELECT x.origin, x.p, x.s, eq.b AS o, x.negated FROM x JOIN eq ON eq.a = x.o UNION ALL SELECT x.origin, x.p, x.s, ne.b, TRUE FROM x JOIN ne ON ne.a = x.o WHERE NOT x.negated
    UNION ALL SELECT x.origin, m.rel, x.s, x.o, x.negated <> m.rel_negated FROM x JOIN relation_map m ON m.label = x.p AND m.rel <> x.p) r)"""
_FOLD_ANY = """CASE WHEN list_contains({k}, 'EXCLUSIVES') THEN 'EXCLUSIVES' WHEN list_contains({k}, 'EQUIVALENT') THEN 'EQUIVALENT' WHEN len(list_filter({k}, lambda z: z IN ('GENERAL', 'LOSE_SPEC', 'INSTANTIATION', 'MISSING_1ST'))) = 1
  THEN list_filter({k}, lambda z: z IN ('GENERAL', 'LOSE_SPEC', 'INSTANTIATION', 'MISSING_1ST'))[1] WHEN len(list_filter({k}, lambda z: z IN ('GENERAL', 'LOSE_SPEC', 'INSTANTIATION', 'MISSING_1ST'))) > 1 THEN 'GENERAL' ELSE 'INDIFFERENT' END"""
_FOLD_ALL = """CASE WHEN list_contains({k}, 'INDIFFERENT') THEN 'INDIFFERENT' WHEN list_contains({k}, 'EXCLUSIVES') THEN 'EXCLUSIVES' WHEN len(list_filter({k}, lambda z: z IN ('GENERAL', 'LOSE_SPEC', 'INSTANTIATION', 'MISSING_1ST'))) = 1
  THEN list_filter({k}, lambda z: z IN ('GENERAL', 'LOSE_SPEC', 'INSTANTIATION', 'MISSING_1ST'))[1] WHEN len(list_filter({k}, lambda z: z IN ('GENERAL', 'LOSE_SPEC', 'INSTANTIATION', 'MISSING_1ST'))) > 1 THEN 'GENERAL' WHEN list_contains({k}, 'EQUIVALENT') THEN 'EQUIVALENT' ELSE 'INDIFFERENT' END"""
_FORM = f"""k AS (SELECT sent_id, min({_CONN}) AS k FROM sentence WHERE text IS NOT NULL GROUP BY 1),
  atm AS (SELECT sent_id, list_sort(list(DISTINCT text)) AS atoms FROM mention WHERE type = 'PERSON' AND text IS NOT NULL GROUP BY 1), f AS (SELECT sent_id, CASE WHEN k = 'NONE' THEN 'AND' ELSE k END AS kind, atoms FROM atm JOIN k USING (sent_id))"""
_TABLE = {"N": "EQUIVALENT INDIFFERENT INDIFFERENT INDIFFERENT INDIFFERENT INDIFFERENT", "aN": "EQUIVALENT EQUIVALENT INSTANTIATION INSTANTIATION GENERAL INDIFFERENT", "NCC": "MISSING_1ST INDIFFERENT EQUIVALENT INDIFFERENT INSTANTIATION INDIFFERENT", "aNCC": "MISSING_1ST INDIFFERENT EQUIVALENT EQUIVALENT INSTANTIATION INDIFFERENT", "CC": "INDIFFERENT INDIFFERENT INDIFFERENT INDIFFERENT EQUIVALENT INDIFFERENT", "aCC": "GENERAL INDIFFERENT INSTANTIATION INSTANTIATION EQUIVALENT EQUIVALENT"}
_BITS = ("p", "q", "r", "not_p", "not_q")
_WORLD = "w AS (SELECT p, q, r FROM (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(q), (VALUES (0), (1)) c(r)), f AS (SELECT p, q, r, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([p, q, least(p, q), greatest(p, q), 1 - p, 1 - q, r, least(1 - p, 1 - q)]) AS v FROM w), s AS (SELECT x.i, y.i AS j, avg(y.v) AS score FROM f x JOIN f y USING (p, q, r) WHERE x.v = 1 GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (rule_first_match, rule_matches, rule_fixpoint, expansion_compare, expansion_members, relation_verdicts, name_verdicts, term_verdict, worlds_enumerate, natural_join_constraints, entailment_score, entailment_verdict, formula_classes, sentence_entailment)}
ORACLES = {
    "rule_first_match": f"WITH {_FEAT} SELECT n.id, CASE " + " ".join(f"WHEN {c} THEN {k}" for k, _, c in _role_case()) + " END AS rule_order, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in _role_case()) + " ELSE 'none' END AS role FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)",
    "rule_matches": f"WITH {_FEAT} " + " UNION ALL ".join(f"SELECT {k} AS rule_order, count(*) AS n FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) WHERE {c} HAVING count(*) > 0" for k, _, c in _role_case()),
    "rule_fixpoint": f"WITH RECURSIVE {_EXP} SELECT * FROM x",
    "expansion_compare": f"""WITH RECURSIVE {_EXP}, t AS (SELECT atm.origin AS x, x.origin AS y, CASE WHEN x.negated THEN 1 ELSE 2 END AS t FROM x JOIN atm USING (p, s, o) WHERE atm.origin <> x.origin
      UNION ALL SELECT x.origin, atm.origin, 1 FROM x JOIN atm USING (p, s, o) WHERE atm.origin <> x.origin AND x.negated) SELECT x, y, CASE WHEN min(t) = 1 THEN 'EXCLUSIVES' ELSE 'GENERAL' END AS verdict FROM t GROUP BY 1, 2""",
    "expansion_members": f"WITH RECURSIVE {_EXP} SELECT p, s, o, count(*) FILTER (WHERE NOT negated) AS n_hold, count(*) FILTER (WHERE negated) AS n_deny FROM x GROUP BY 1, 2, 3",
    "relation_verdicts": f"""WITH v AS (SELECT lower(surface_start) AS s, lower(surface_end) AS o, CASE rel WHEN 'SameAs' THEN 'EQUIVALENT' WHEN 'OppositeOf' THEN 'EXCLUSIVES' WHEN 'IsA' THEN 'GENERAL' WHEN 'PartOf' THEN 'INSTANTIATION' WHEN 'FormOf' THEN 'LOSE_SPEC' ELSE 'INDIFFERENT' END AS v
      FROM compact_relation WHERE surface_start IS NOT NULL AND rel IS NOT NULL AND surface_end IS NOT NULL), pr AS (SELECT s, o, list(DISTINCT v) AS k FROM v GROUP BY 1, 2), pv AS (SELECT s, {_FOLD_ANY.format(k='k')} AS v FROM pr), g AS (SELECT s, count(*) AS n, list(DISTINCT v) AS k FROM pv GROUP BY 1),
      h AS (SELECT s, n, {_FOLD_ALL.format(k='k')} AS all_ends, {_FOLD_ANY.format(k='k')} AS av FROM g) SELECT s, n, all_ends, CASE av WHEN 'EQUIVALENT' THEN 'Equivalent' WHEN 'EXCLUSIVES' THEN 'Conflicting' WHEN 'INDIFFERENT' THEN 'Indifferent' ELSE 'Implying' END AS any_end FROM h""",
    "name_verdicts": f"""WITH {_A}, pr AS (SELECT DISTINCT s AS a, o AS b FROM a), nm AS (SELECT s AS name FROM a UNION SELECT o FROM a), ty AS (SELECT name, regexp_extract(name, '^/c/([a-z]+)/', 1) AS type FROM nm WHERE regexp_extract(name, '^/c/([a-z]+)/', 1) <> ''),
      sy AS (SELECT s AS a, o AS b FROM a WHERE p IN ('SameAs', 'SimilarTo') UNION SELECT o, s FROM a WHERE p IN ('SameAs', 'SimilarTo')), un AS (SELECT s AS a, o AS b FROM a WHERE p IN ('OppositeOf', 'NotSameAs')), ab AS (SELECT s AS a, o AS b FROM a WHERE p IN ('IsA', 'PartOf')),
      sx AS (SELECT * FROM sy UNION SELECT name, name FROM nm)
      SELECT a, b, CASE WHEN a = b THEN 'EQUIVALENT' WHEN a = '' THEN 'MISSING_1ST' WHEN b = '' THEN 'INDIFFERENT' WHEN NOT EXISTS (SELECT 1 FROM ty x JOIN ty y ON x.type = y.type WHERE x.name = pr.a AND y.name = pr.b) THEN 'INDIFFERENT'
        WHEN EXISTS (SELECT 1 FROM un WHERE un.a = pr.a AND un.b = pr.b) THEN 'EXCLUSIVES' WHEN EXISTS (SELECT 1 FROM sy WHERE sy.a = pr.a AND sy.b = pr.b) OR EXISTS (SELECT 1 FROM sy x JOIN sy y ON x.b = y.b WHERE x.a = pr.a AND y.a = pr.b) THEN 'EQUIVALENT'
        WHEN EXISTS (SELECT 1 FROM sx x JOIN ab ON ab.a = x.b JOIN sx y ON y.b = ab.b WHERE x.a = pr.a AND y.a = pr.b) THEN 'GENERAL' ELSE 'INDIFFERENT' END AS verdict FROM pr""",
    "term_verdict": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b[0]}', '{v}')" for a, row in _TABLE.items() for b, v in zip(TERMS, row.split(), strict=True)) + ") t(lhs, rhs, verdict)",
    "worlds_enumerate": "SELECT w AS world, " + ", ".join(f"((w >> {k}) & 1)::INT AS {b}" for k, b in enumerate(_BITS)) + " FROM range(32) t(w) WHERE ((w >> 3) & 1) <> (w & 1) AND ((w >> 4) & 1) <> ((w >> 1) & 1) AND (w & 1) <= ((w >> 2) & 1)",
    "natural_join_constraints": """WITH i(x, y) AS (VALUES (0, 0), (0, 1), (1, 1)), q(x, y) AS (VALUES (0, 0), (1, 1)), c(x, y) AS (VALUES (0, 1), (1, 0)), n(x, y) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
      ab AS (SELECT x AS a, y AS b FROM i), bc AS (SELECT x AS b, y AS c FROM q), ae AS (SELECT x AS a, y AS e FROM c), ce AS (SELECT x AS c, y AS e FROM n)
      SELECT (a + 2 * b + 4 * c + 8 * e)::BIGINT AS world, a, b, c, e FROM ab NATURAL JOIN bc NATURAL JOIN ae NATURAL JOIN ce""",
    "entailment_score": f"WITH {_WORLD} SELECT i, j, round(score, 6) AS score FROM s",
    "entailment_verdict": f"WITH {_WORLD} SELECT i, j, CASE WHEN score = 1 THEN 'Implying' WHEN score = 0 THEN 'Conflicting' ELSE 'Indifferent' END AS verdict FROM s",
    "formula_classes": f"WITH {_FORM} SELECT kind, array_to_string(atoms, '|') AS atoms, count(*) AS n, min(sent_id) AS first FROM f GROUP BY 1, 2",
    "sentence_entailment": f"""WITH {_FORM}, c AS (SELECT kind, atoms, min(sent_id) AS conclusion FROM f GROUP BY 1, 2),
      m AS (SELECT f.sent_id AS premise, c.conclusion, f.kind AS ki, c.kind AS kj, len(list_intersect(f.atoms, c.atoms)) AS s, len(f.atoms) - len(list_intersect(f.atoms, c.atoms)) AS a, len(c.atoms) - len(list_intersect(f.atoms, c.atoms)) AS b FROM f JOIN c ON list_has_any(f.atoms, c.atoms) WHERE f.sent_id % 100 = 0),
      v AS (SELECT premise, conclusion, CASE ki WHEN 'AND' THEN CASE kj WHEN 'AND' THEN 1 / pow(2, b) WHEN 'OR' THEN 1.0 ELSE 0.0 END WHEN 'NEITHER' THEN CASE kj WHEN 'NEITHER' THEN 1 / pow(2, b) WHEN 'OR' THEN 1 - 1 / pow(2, b) ELSE 0.0 END
        ELSE CASE kj WHEN 'AND' THEN pow(2, a) / (pow(2, s + a) - 1) / pow(2, b) WHEN 'OR' THEN 1 - (pow(2, a) - 1) / (pow(2, s + a) - 1) / pow(2, b) ELSE (pow(2, a) - 1) / (pow(2, s + a) - 1) / pow(2, b) END END AS score FROM m)
      SELECT premise, conclusion, round(score, 6) AS score, CASE WHEN score = 1 THEN 'Implying' WHEN score = 0 THEN 'Conflicting' ELSE 'Indifferent' END AS verdict FROM v""",
}
