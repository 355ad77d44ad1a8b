"""Queries on mentions, spans and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.functions.text import chunks, entity_dimension
from kernelweave.operators import spans as S
from kernelweave.runtime import table


def mentions_of(spark: SparkSession, d: str) -> DataFrame:
    """Mentions without repeated deliveries."""
    return table(spark, d, "mention").drop("loaded_at").distinct()


def sentences_of(spark: SparkSession, d: str) -> DataFrame:
    """Sentences without repeated deliveries."""
    return table(spark, d, "sentence").where("text IS NOT NULL").select("sent_id", "text", "lang", "corpus").distinct()


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes with their span, without repeated deliveries: sent_id, id, kind, name, n_begin, n_end, pos."""
    number = lambda k: F.col("properties")[k].try_cast("int")
    gsm = table(spark, d, "gsm").dropDuplicates(["id"])
    return gsm.select("sent_id", "id", F.get("ell", F.lit(0)).alias("kind"), F.get(F.filter("xi", lambda x: x.isNotNull()), F.lit(0)).alias("name"), number("begin").alias("n_begin"), number("end").alias("n_end"), number("pos").alias("pos"))


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose span overlaps that of a node of the same sentence."""
    mention = mentions_of(spark, d).select("mention_id", "sent_id", "start_char", "end_char")
    met = S.overlap_join(nodes_of(spark, d).select("sent_id", "id", "n_begin", "n_end"), mention, "sent_id", ("n_begin", "n_end"), ("start_char", "end_char"))
    return met.select("sent_id", "id", "mention_id")


def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For every node the overlapping mention of best confidence."""
    mention = mentions_of(spark, d).where("confidence IS NOT NULL").select("mention_id", "sent_id", "start_char", "end_char", "type", "confidence")
    met = S.overlap_join(nodes_of(spark, d).select("sent_id", "id", "n_begin", "n_end"), mention, "sent_id", ("n_begin", "n_end"), ("start_char", "end_char"))
    best = S.best_per_node(met, ["id"], [F.desc("confidence"), F.col("mention_id")])
    return best.select("id", "mention_id", "type", "confidence")


def span_exact_best(spark: SparkSession, d: str) -> DataFrame:
    """Best confidence and most specific type of the mentions on exactly the same span."""
    spans = mentions_of(spark, d).where("start_char IS NOT NULL AND end_char IS NOT NULL")
    best = S.best_at_span(spans, ["sent_id", "start_char", "end_char"])
    return best.select("sent_id", "start_char", "end_char", "confidence", S.most_specific(F.col("kinds")).alias("kind"), "n")


def type_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Most specific type of every text that is mentioned."""
    kinds = mentions_of(spark, d).where("text IS NOT NULL").groupBy("text").agg(F.collect_set("type").alias("kinds"))
    return kinds.select("text", S.most_specific(F.col("kinds")).alias("kind"), F.size("kinds").alias("n_kinds"))


def type_lca(spark: SparkSession, d: str) -> DataFrame:
    """Most general type, by the tree of types, of every text that is mentioned."""
    kinds = mentions_of(spark, d).where("text IS NOT NULL AND type IS NOT NULL").groupBy("text").agg(F.array_sort(F.collect_set("type")).alias("kinds"))
    return kinds.select("text", S.most_general(F.col("kinds")).alias("kind"))


def type_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by source and dimension of their type."""
    return mentions_of(spark, d).groupBy("source", entity_dimension(F.col("type")).alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def hyphen_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Words that hyphens join in the surfaces of the relations, with their place."""
    rows = table(spark, d, "compact_relation").where(F.contains("surface_start", F.lit("-"))).select("rel_id", F.col("surface_start").alias("text"))
    return S.stitch_hyphens(S.token_spans(rows, "rel_id", "text"), "rel_id")


def segment_text(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence cut at the ends of its mentions."""
    spans = mentions_of(spark, d).select("sent_id", F.col("start_char").alias("begin"), F.col("end_char").alias("end"))
    return S.segments(sentences_of(spark, d).select("sent_id", "text"), spans, "sent_id")


def node_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Span and first position that the nodes of a sentence take together."""
    return nodes_of(spark, d).groupBy("sent_id").agg(F.min("n_begin").alias("begin"), F.max("n_end").alias("end"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))


def property_merge(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the nodes of a sentence merged: begin and pos least, end greatest, of others the first node's value and all distinct values."""
    each = table(spark, d, "gsm").dropDuplicates(["id"]).select("sent_id", "id", F.explode("properties").alias("key", "value"))
    number = F.col("value").try_cast("int")
    first = F.min_by("value", "id")
    merged = each.groupBy("sent_id", "key").agg(F.min(number).alias("low"), F.max(number).alias("high"), first.alias("first"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"))
    value = F.when(F.col("key").isin("begin", "pos"), F.col("low").cast("string")).when(F.col("key") == "end", F.col("high").cast("string")).otherwise(F.col("first"))
    return merged.select("sent_id", "key", value.alias("value"), "values")


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more nodes of a sentence in order of position, as used to resolve names of several words."""
    named = nodes_of(spark, d).where("name IS NOT NULL").groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "name"))), lambda x: x["name"]).alias("names"))
    return named.select("sent_id", F.explode(chunks(F.col("names"))).alias("run")).select("sent_id", F.array_join("run", " ").alias("chunk"), F.size("run").alias("n")).groupBy("sent_id", "chunk", "n").agg(F.count(F.lit(1)).alias("times"))


def time_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Months, weekdays and numeric dates named in the sentences."""
    named = r"^(?:january|february|march|april|may|june|july|august|september|october|november|december|(?:mon|tues|wednes|thurs|fri|satur|sun)day|[0-9]{1,2}/[0-9]{1,2})$"
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}/]+"), F.lit(0))
    found = sentences_of(spark, d).select("sent_id", F.explode(F.filter(tokens, lambda t: t.rlike(named))).alias("expression"))
    return found.groupBy("sent_id", "expression").agg(F.count(F.lit(1)).alias("n"))


_M = "m AS (SELECT DISTINCT mention_id, sent_id, text, type, start_char, end_char, monad, confidence, id, source FROM mention)"
_S = "s AS (SELECT DISTINCT sent_id, text, lang, corpus FROM sentence WHERE text IS NOT NULL)"
_N = "n AS (SELECT DISTINCT ON (id) sent_id, id, ell[1] AS kind, list_filter(xi, lambda x: x IS NOT NULL)[1] AS name, TRY_CAST(properties['begin'] AS INT) AS n_begin, TRY_CAST(properties['end'] AS INT) AS n_end, TRY_CAST(properties['pos'] AS INT) AS pos, properties FROM gsm)"
_SPECIFIC = """CASE WHEN len(list_filter(k, lambda x: contains(lower(x), 'verb'))) > 0 THEN 'verb' WHEN list_contains(k, 'GPE') THEN 'GPE' WHEN list_contains(k, 'LOC') THEN 'LOC' WHEN list_contains(k, 'ORG') THEN 'ORG'
  WHEN list_contains(k, 'NOUN') THEN 'noun' WHEN list_contains(k, 'ENTITY') THEN 'ENTITY' WHEN list_contains(k, 'ADJECTIVE') THEN 'JJ' ELSE 'None' END"""
_OVER = "n_begin <= end_char AND start_char <= n_end AND n_begin <= n_end AND start_char <= end_char"

QUERIES = {f.__name__: f for f in (span_overlap, best_overlap, span_exact_best, type_precedence, type_lca, type_dimension, hyphen_stitch, segment_text, node_envelope, property_merge, sentence_chunks, time_expressions)}
ORACLES = {
    "span_overlap": f"WITH {_M}, {_N} SELECT n.sent_id, n.id, m.mention_id FROM n JOIN m ON n.sent_id = m.sent_id AND {_OVER}",
    "best_overlap": f"""WITH {_M}, {_N} SELECT id, mention_id, type, confidence FROM (SELECT n.id, m.mention_id, m.type, m.confidence, row_number() OVER (PARTITION BY n.id ORDER BY m.confidence DESC, m.mention_id) AS r
      FROM n JOIN m ON n.sent_id = m.sent_id AND {_OVER} WHERE m.confidence IS NOT NULL) WHERE r = 1""",
    "span_exact_best": f"""WITH {_M}, b AS (SELECT *, max(confidence) OVER (PARTITION BY sent_id, start_char, end_char) AS best FROM m WHERE start_char IS NOT NULL AND end_char IS NOT NULL),
      g AS (SELECT sent_id, start_char, end_char, max(best) AS confidence, coalesce(list(DISTINCT type) FILTER (WHERE type IS NOT NULL AND confidence IS NOT DISTINCT FROM best), []) AS k, count(*) AS n FROM b GROUP BY 1, 2, 3)
      SELECT sent_id, start_char, end_char, confidence, {_SPECIFIC} AS kind, n FROM g""",
    "type_precedence": f"WITH {_M}, g AS (SELECT text, coalesce(list(DISTINCT type) FILTER (WHERE type IS NOT NULL), []) AS k FROM m WHERE text IS NOT NULL GROUP BY 1) SELECT text, {_SPECIFIC} AS kind, len(k) AS n_kinds FROM g",
    "type_lca": f"""WITH {_M}, tree(kind, path) AS (VALUES ('ENTITY', ['ENTITY']), ('NOUN', ['ENTITY', 'NOUN']), ('JJ', ['ENTITY', 'JJ']), ('ORG', ['ENTITY', 'NOUN', 'ORG']), ('PERSON', ['ENTITY', 'NOUN', 'PERSON']), ('LOC', ['ENTITY', 'NOUN', 'LOC']), ('GPE', ['ENTITY', 'NOUN', 'LOC', 'GPE'])),
      k AS (SELECT DISTINCT text, type FROM m WHERE text IS NOT NULL AND type IS NOT NULL), c AS (SELECT text, count(*) AS n, min(type) AS one, count(path) AS known FROM k LEFT JOIN tree ON kind = type GROUP BY 1),
      a AS (SELECT text, anc, count(*) AS n FROM (SELECT text, unnest(path) AS anc FROM k JOIN tree ON kind = type) GROUP BY 1, 2),
      l AS (SELECT a.text, max_by(a.anc, len(t.path)) AS anc FROM a JOIN c ON c.text = a.text AND a.n = c.n JOIN tree t ON t.kind = a.anc GROUP BY 1)
      SELECT c.text, CASE WHEN c.n = 1 THEN c.one WHEN c.known = c.n THEN l.anc END AS kind FROM c LEFT JOIN l ON l.text = c.text""",
    "type_dimension": f"WITH {_M} SELECT source, CASE WHEN type IN ('GPE', 'LOC') THEN 'SPACE' WHEN type = 'DATE' THEN 'TIME' ELSE type END AS dimension, count(*) AS n, round(avg(confidence), 6) AS confidence FROM m GROUP BY 1, 2",
    "hyphen_stitch": r"""WITH p AS (SELECT rel_id, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM (SELECT rel_id, regexp_extract_all(surface_start, '[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS t FROM compact_relation WHERE surface_start IS NOT NULL)),
      o AS (SELECT rel_id, token, k, sum(length(token)) OVER (PARTITION BY rel_id ORDER BY k)::BIGINT AS e FROM p),
      w AS (SELECT rel_id, token, e - length(token) AS b, e, regexp_full_match(token, '[\p{L}\p{N}]+') AS is_word FROM o)
      SELECT h.rel_id, l.token || '-' || r.token AS text, l.b AS begin, r.e AS "end" FROM w h JOIN w l ON l.rel_id = h.rel_id AND l.e = h.b AND l.is_word JOIN w r ON r.rel_id = h.rel_id AND r.b = h.e AND r.is_word WHERE h.token = '-'""",
    "segment_text": f"""WITH {_M}, {_S}, sp AS (SELECT s.sent_id, s.text, least(length(text), greatest(start_char, 0)) AS b, least(length(text), end_char) AS e FROM s JOIN (SELECT sent_id, start_char, end_char FROM m) m USING (sent_id) WHERE start_char < end_char),
      c AS (SELECT sent_id, b AS x FROM sp UNION SELECT sent_id, e FROM sp UNION SELECT sent_id, 0 FROM s UNION SELECT sent_id, length(text) FROM s),
      g AS (SELECT sent_id, x AS b, lead(x) OVER (PARTITION BY sent_id ORDER BY x) AS e FROM c),
      r AS (SELECT DISTINCT sent_id, b, e FROM sp)
      SELECT g.sent_id, g.b AS begin, g.e AS "end", substring(s.text, g.b::INT + 1, (g.e - g.b)::INT) AS piece, EXISTS (SELECT 1 FROM r WHERE r.sent_id = g.sent_id AND r.b <= g.b AND r.e >= g.e) AS covered FROM g JOIN s USING (sent_id) WHERE g.e IS NOT NULL""",
    "node_envelope": f'WITH {_N} SELECT sent_id, min(n_begin) AS begin, max(n_end) AS "end", min(pos) AS pos, count(*) AS n FROM n GROUP BY 1',
    "property_merge": f"""WITH {_N}, p AS (SELECT sent_id, id, u.key AS key, u.value AS value FROM (SELECT sent_id, id, unnest(map_entries(properties)) AS u FROM n))
      SELECT sent_id, key, CASE WHEN key IN ('begin', 'pos') THEN min(TRY_CAST(value AS INT))::VARCHAR WHEN key = 'end' THEN max(TRY_CAST(value AS INT))::VARCHAR ELSE min_by(value, id) END AS value, string_agg(DISTINCT value, '|' ORDER BY value) AS values FROM p GROUP BY 1, 2""",
    "sentence_chunks": f"""WITH {_N}, o AS (SELECT sent_id, name, row_number() OVER (PARTITION BY sent_id ORDER BY pos NULLS FIRST, id) AS k FROM n WHERE name IS NOT NULL),
      r AS (SELECT a.sent_id, a.k, b.k - a.k + 1 AS n, (SELECT string_agg(c.name, ' ' ORDER BY c.k) FROM o c WHERE c.sent_id = a.sent_id AND c.k BETWEEN a.k AND b.k) AS chunk FROM o a JOIN o b ON a.sent_id = b.sent_id AND b.k > a.k)
      SELECT sent_id, chunk, n, count(*) AS times FROM r GROUP BY 1, 2, 3""",
    "time_expressions": rf"""WITH {_S}, t AS (SELECT sent_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}/]+')) AS expression FROM s)
      SELECT sent_id, expression, count(*) AS n FROM t WHERE regexp_full_match(expression, 'january|february|march|april|may|june|july|august|september|october|november|december|(?:mon|tues|wednes|thurs|fri|satur|sun)day|[0-9]{{1,2}}/[0-9]{{1,2}}') GROUP BY 1, 2""",
}
