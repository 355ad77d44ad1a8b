"""Queries on kernels, atoms and formulae of the sentences' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.functions.text import connector
from kernelweave.operators import kernels as K
from kernelweave.plans.graph_queries import _CONN, _L, links_of
from kernelweave.plans.mentions import _N, nodes_of, sentences_of


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, links = nodes_of(spark, d), links_of(spark, d)
    return nodes, links, K.clauses(nodes, links)


def clause_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Relation, ends and negation of every verb."""
    return _parts(spark, d)[2].select("sent_id", "verb", "rel", "negated", "src", "dst", "existential")


def node_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties that modifying links give to their heads."""
    nodes, links, _ = _parts(spark, d)
    return K.fold_modifiers(nodes, links)[0]


def links_left(spark: SparkSession, d: str) -> DataFrame:
    """Links that stay once the modifying ones are properties."""
    nodes, links, _ = _parts(spark, d)
    return K.fold_modifiers(nodes, links)[1].select("src", "label", "dst", "negated")


def action_marks(spark: SparkSession, d: str) -> DataFrame:
    """What subjects, objects and verbs are marked with."""
    return K.mark_actions(_parts(spark, d)[2])


def indirect_groups(spark: SparkSession, d: str) -> DataFrame:
    """Several indirect objects of one verb as a group."""
    nodes, links, _ = _parts(spark, d)
    return K.indirect_groups(nodes, links)


def kernel_strings(spark: SparkSession, d: str) -> DataFrame:
    """Every kernel as text."""
    nodes, links, found = _parts(spark, d)
    return K.kernel_text(K.named_kernels(found, nodes), K.fold_modifiers(nodes, links)[0])


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    nodes, links, found = _parts(spark, d)
    said = sentences_of(spark, d).select("sent_id", connector(F.col("text")).alias("connector")).groupBy("sent_id").agg(F.min("connector").alias("connector"))
    return K.distribute(found, nodes, links, said)


def kernel_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the kernels, one for every member of their source."""
    return _atoms(spark, d).select("verb", "connective", "rel", "source", "target", "negated")


def formula_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms in normal form with their identity."""
    return K.normalise(_atoms(spark, d)).select("verb", "connective", "form", "rel", "arg", "other", "space", "negated", "fid")


def atom_statements(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences state every atom."""
    return K.normalise(_atoms(spark, d)).groupBy("fid").agg(F.count_distinct("sent_id").alias("n_sentences"), F.min("sent_id").alias("first"))


_KEY = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.KEYS.items()) + " END"
_MODS = ", ".join(f"'{m}'" for m in K.MODIFIERS)
_ARG = "(SELECT src AS verb, min_by(dst, (coalesce(pos, -1), dst)) AS {out} FROM (SELECT DISTINCT src, dst FROM l WHERE label = '{label}') e JOIN (SELECT id AS dst, pos FROM n) c USING (dst) GROUP BY 1)"
_K = f"""{_N}, {_L}, v AS (SELECT sent_id, id AS verb, pos, lower(coalesce(name, '?')) AS rel FROM n WHERE kind = 'verb'),
  k0 AS (SELECT v.sent_id, v.verb, v.pos, v.rel, v.verb IN (SELECT src FROM l WHERE label = 'neg') AS negated, s.src, t.dst FROM v LEFT JOIN {_ARG.format(out='src', label='nsubj')} s USING (verb) LEFT JOIN {_ARG.format(out='dst', label='dobj')} t USING (verb)),
  k AS (SELECT *, CASE WHEN src IS NULL THEN (row_number() OVER (PARTITION BY sent_id, src IS NULL ORDER BY pos NULLS FIRST, verb))::INT END AS existential FROM k0),
  p AS (SELECT head, key, value, member, row_number() OVER (PARTITION BY head, key ORDER BY pos NULLS FIRST, member) AS ordinal FROM (SELECT DISTINCT l.src AS head, {_KEY} AS key, coalesce(n.name, '?') AS value, l.dst AS member, n.pos FROM l JOIN n ON n.id = l.dst WHERE label IN ({_MODS}))),
  nm AS (SELECT id, coalesce(CASE WHEN kind = 'GPE' THEN name ELSE lower(name) END, '?') AS term, kind FROM n),
  cn AS (SELECT sent_id, min({_CONN}) AS connector FROM sentence WHERE text IS NOT NULL GROUP BY 1),
  mb AS (SELECT sent_id, verb, rel, negated, src, dst, existential FROM k UNION SELECT k.sent_id, k.verb, k.rel, k.negated, l.dst, k.dst, k.existential FROM k JOIN l ON l.src = k.src AND l.label = 'conj'),
  a AS (SELECT mb.sent_id, mb.verb, CASE WHEN count(*) OVER w = 1 THEN 'ATOM' WHEN cn.connector = 'OR' THEN 'OR' ELSE 'AND' END AS connective, mb.rel, coalesce(s.term, '?' || mb.existential) AS source, t.term AS target, s.kind AS source_kind,
    mb.negated <> (count(*) OVER w > 1 AND coalesce(cn.connector = 'NEITHER', FALSE)) AS negated FROM mb LEFT JOIN cn USING (sent_id) LEFT JOIN nm s ON s.id = mb.src LEFT JOIN nm t ON t.id = mb.dst WINDOW w AS (PARTITION BY mb.verb)),
  f0 AS (SELECT sent_id, verb, connective, negated, CASE WHEN source_kind IS NOT DISTINCT FROM 'GPE' OR target IS NULL THEN 'unary' ELSE 'binary' END AS form, CASE WHEN source_kind IS NOT DISTINCT FROM 'GPE' THEN 'be' ELSE rel END AS rel,
    CASE WHEN source_kind IS NOT DISTINCT FROM 'GPE' THEN coalesce(target, rel) ELSE source END AS arg, CASE WHEN source_kind IS DISTINCT FROM 'GPE' THEN target END AS other, CASE WHEN source_kind IS NOT DISTINCT FROM 'GPE' THEN source END AS space FROM a),
  f AS (SELECT *, md5(concat_ws('|', form, rel, regexp_replace(arg, '^\\?[0-9]+$', '?'), coalesce(other, '-'), coalesce(space, '-'), negated::VARCHAR)) AS fid FROM f0)"""

QUERIES = {f.__name__: f for f in (clause_kernels, node_properties, links_left, action_marks, indirect_groups, kernel_strings, kernel_atoms, formula_atoms, atom_statements)}
ORACLES = {
    "clause_kernels": f"WITH {_K} SELECT sent_id, verb, rel, negated, src, dst, existential FROM k",
    "node_properties": f"WITH {_K} SELECT head, key, value, member, ordinal FROM p",
    "links_left": f"WITH {_K} SELECT src, label, dst, negated FROM l WHERE label IS NULL OR label NOT IN ({_MODS})",
    "action_marks": f"WITH {_K} SELECT src AS node, 'action' AS key, rel AS value FROM k WHERE src IS NOT NULL UNION SELECT dst, 'actioned', rel FROM k WHERE dst IS NOT NULL UNION SELECT verb, 'root', 'true' FROM k",
    "indirect_groups": f"WITH {_K}, o AS (SELECT DISTINCT l.src AS verb, l.dst AS member, n.pos FROM l JOIN n ON n.id = l.dst WHERE l.label = 'obl') SELECT * FROM (SELECT verb, member, row_number() OVER (PARTITION BY verb ORDER BY pos NULLS FIRST, member) AS ordinal, count(*) OVER (PARTITION BY verb) AS size FROM o) WHERE size > 1",
    "kernel_strings": f"""WITH {_K}, h AS (SELECT head AS verb, string_agg('(' || key || ':' || value || ')', ', ' ORDER BY key, ordinal) AS props FROM p GROUP BY 1),
      b AS (SELECT k.verb, k.negated, k.rel || '(' || coalesce(s.term, '?' || k.existential) || coalesce(', ' || t.term, '') || ')' || coalesce('[' || h.props || ']', '') AS body FROM k LEFT JOIN nm s ON s.id = k.src LEFT JOIN nm t ON t.id = k.dst LEFT JOIN h USING (verb))
      SELECT verb, CASE WHEN negated THEN 'NOT(' || body || ')' ELSE body END AS kernel FROM b""",
    "kernel_atoms": f"WITH {_K} SELECT verb, connective, rel, source, target, negated FROM a",
    "formula_atoms": f"WITH {_K} SELECT verb, connective, form, rel, arg, other, space, negated, fid FROM f",
    "atom_statements": f"WITH {_K} SELECT fid, count(DISTINCT sent_id) AS n_sentences, min(sent_id) AS first FROM f GROUP BY 1",
}
