"""Queries on string kernels, similarity joins and growing phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.functions import text as T
from kernelweave.operators.simjoin import extend_phrases, ranked_matches, trigram_join
from kernelweave.runtime import table

SIMILAR = 0.45
RECALL, PRECISION = 0.3, 0.8


def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs x, y of surfaces that a relation connects, in lower case and ASCII."""
    fold = lambda c: F.lower(T.plain_ascii(F.col(c)))
    rows = table(spark, d, "compact_relation").where("surface_start IS NOT NULL AND surface_end IS NOT NULL")
    return rows.select(fold("surface_start").alias("x"), fold("surface_end").alias("y")).distinct()


def _r(value: Column) -> Column:
    return F.round(value, 6)


def _ends() -> tuple[Column, Column]:
    return F.col("x"), F.col("y")


def lev_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Edits and edit similarity of the two surfaces of every relation."""
    x, y = _ends()
    return _surfaces(spark, d).select("x", "y", F.levenshtein("x", "y").alias("edits"), _r(T.edit_similarity(x, y)).alias("similarity"))


def wordwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Product over the words of x of the best similarity to a word of y."""
    x, y = _ends()
    return _surfaces(spark, d).select("x", "y", _r(T.wordwise_similarity(T.words(x), T.words(y))).alias("similarity"))


def bigram_set_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the sets of character pairs."""
    x, y = _ends()
    return _surfaces(spark, d).select("x", "y", _r(T.bigram_set_similarity(x, y)).alias("similarity"))


def bigram_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Kernel of character pairs and its normal form."""
    x, y = _ends()
    k = T.bigram_kernel(x, y)
    return _surfaces(spark, d).select("x", "y", k.alias("kernel"), _r(T.normal_kernel(k, T.bigram_kernel(x, x), T.bigram_kernel(y, y))).alias("normal"))


def dice_multiset(spark: SparkSession, d: str) -> DataFrame:
    """Dice coefficient of the multisets of character pairs."""
    x, y = _ends()
    return _surfaces(spark, d).select("x", "y", _r(T.multiset_dice(T.bigrams(x), T.bigrams(y))).alias("similarity"))


def prevailing_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Literal similarity where it prevails, else that of the trigrams."""
    x, y = _ends()
    literal = F.greatest(T.edit_similarity(x, y), T.bigram_set_similarity(x, y))
    return _surfaces(spark, d).select("x", "y", _r(T.prevailing(literal, T.set_similarity(T.trigrams(x), T.trigrams(y)))).alias("similarity"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Typed names of mentions with every similar name of the gazetteer."""
    left = table(spark, d, "mention").select(F.lower(T.plain_ascii(F.col("text"))).alias("a"))
    right = table(spark, d, "gazetteer").select(F.lower(T.plain_ascii(F.col("t"))).alias("b"))
    return trigram_join(left, right, SIMILAR)


def trigram_simjoin(spark: SparkSession, d: str) -> DataFrame:
    """Every text of a mention with the gazetteer names that are similar to it, best first."""
    return ranked_matches(_matches(spark, d)).select("a", "b", _r(F.col("score")).alias("score"), "rank")


def typed_simjoin(spark: SparkSession, d: str) -> DataFrame:
    """The same with the types that the gazetteer gives to the name."""
    kinds = table(spark, d, "gazetteer").groupBy(F.lower(T.plain_ascii(F.col("t"))).alias("b")).agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    return _matches(spark, d).join(kinds, "b").select("a", "b", "types", _r(F.col("score")).alias("score"))


def suffix_morph(spark: SparkSession, d: str) -> DataFrame:
    """Similar names that end in the text's own last two letters."""
    return _matches(spark, d).where(F.endswith("b", F.right("a", F.lit(2)))).select("a", "b", _r(F.col("score")).alias("score"))


def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Number of names and first name at each score of a text."""
    return _matches(spark, d).groupBy("a", _r(F.col("score")).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("first"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often every character pair occurs in every name of the gazetteer."""
    names = table(spark, d, "gazetteer").select(F.lower("t").alias("name")).distinct()
    return names.select("name", F.explode(T.bigrams(F.col("name"))).alias("gram")).groupBy("name", "gram").agg(F.count(F.lit(1)).alias("n"))


def phrase_extension(spark: SparkSession, d: str) -> DataFrame:
    """Runs of tokens of the sentences that grow towards a name of the gazetteer."""
    fold = lambda c: F.lower(T.plain_ascii(F.col(c)))
    sentences = table(spark, d, "sentence").where("text IS NOT NULL").select("sent_id", "text").distinct()
    tokens = sentences.select(F.col("sent_id").alias("text_id"), F.regexp_extract_all(fold("text"), F.lit("[a-z0-9#]+"), F.lit(0)).alias("tokens"))
    names = table(spark, d, "gazetteer").select(fold("t").alias("name")).distinct()
    found = extend_phrases(tokens, names, RECALL, PRECISION)
    return found.select(F.col("text_id").alias("sent_id"), F.col("pos").cast("long").alias("pos"), F.col("n_tokens").cast("long").alias("n_tokens"), "phrase", "name", _r(F.col("score")).alias("score"))


def label_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Connector, negation and slug of every sentence."""
    text = F.col("text")
    rows = table(spark, d, "sentence").where("text IS NOT NULL").select("sent_id", "text").distinct()
    return rows.select("sent_id", T.connector(text).alias("connector"), T.negated(text).alias("negated"), F.length(T.urlify(T.plain_ascii(text))).alias("slug_length"), T.concept_key(T.plain_ascii(text)).alias("key"))


def existential_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Existentials without numbers and contents of inner brackets, of kernels written for the nodes of the graphs."""
    node = table(spark, d, "gsm").dropDuplicates(["id"])
    name = F.coalesce(F.get(F.filter("xi", lambda x: x.isNotNull()), F.lit(0)), F.concat(F.lit("?"), F.col("id").cast("string")))
    kernel = F.concat(F.lit("be("), name, F.lit(", ?"), F.col("id").cast("string"), F.lit(")[pos:"), F.coalesce(F.col("properties")["pos"], F.lit("-")), F.lit("[x]]"))
    made = node.select("id", kernel.alias("kernel"))
    return made.select("id", T.erase_existentials(F.col("kernel")).alias("kernel"), F.array_join(T.innermost_brackets(F.col("kernel")), "|").alias("inner"))


_ASCII = r"lower(regexp_replace({x}, '[^\x00-\x7F]', '#', 'g'))"
_SURF = f"""surf AS (SELECT DISTINCT {_ASCII.format(x="surface_start")} AS x, {_ASCII.format(x="surface_end")} AS y FROM compact_relation
  WHERE surface_start IS NOT NULL AND surface_end IS NOT NULL)"""
_LEV = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b})) END"
_BI = "CASE WHEN length({a}) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, greatest(length({a}) - 1, 1) + 1), lambda i: substring({a}, i, 2)) END"
_TRI = r"list_distinct(flatten(list_transform(list_transform(regexp_extract_all(lower({a}), '[\p{{L}}\p{{N}}]+'), lambda w: '  ' || w || ' '), lambda w: list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)))))"
_COS = "CASE WHEN x = y THEN 1.0 WHEN length(x) = 0 OR length(y) = 0 THEN 0.0 ELSE len(list_intersect(g, h)) / sqrt(len(g) * len(h)) END"
_SETS = f"sets AS (SELECT x, y, list_distinct({_BI.format(a='x')}) AS g, list_distinct({_BI.format(a='y')}) AS h FROM surf)"
_OCC = "((length({t}) - length(replace({t}, {g}, ''))) // length({g}))"
_KER = "coalesce(list_sum(list_transform(list_intersect({g}, {h}), lambda z: " + _OCC.format(t="{a}", g="z") + " * " + _OCC.format(t="{b}", g="z") + ")), 0)::BIGINT"

_MATCH = rf"""
l AS (SELECT DISTINCT {_ASCII.format(x="text")} AS a FROM mention WHERE text IS NOT NULL), r AS (SELECT DISTINCT {_ASCII.format(x="t")} AS b FROM gazetteer WHERE t IS NOT NULL),
lg AS (SELECT a, g FROM (SELECT a, unnest({_TRI.format(a="a")}) AS g FROM l)), rg AS (SELECT b, g FROM (SELECT b, unnest({_TRI.format(a="b")}) AS g FROM r)),
ln AS (SELECT a, count(*) AS n FROM lg GROUP BY 1), rn AS (SELECT b, count(*) AS m FROM rg GROUP BY 1),
met AS (SELECT a, b, count(*) AS c FROM lg JOIN rg USING (g) GROUP BY 1, 2),
pair AS (SELECT a, b, c / (n + m - c) AS score FROM met JOIN ln USING (a) JOIN rn USING (b) WHERE c / (n + m - c) >= {SIMILAR})
"""

PHRASE_SQL = rf"""
WITH name AS (SELECT DISTINCT {_ASCII.format(x="t")} AS v FROM gazetteer WHERE t IS NOT NULL),
tok AS (SELECT sent_id, unnest(w) AS a, generate_subscripts(w, 1) AS p, w FROM (SELECT DISTINCT sent_id, regexp_extract_all({_ASCII.format(x="text")}, '[a-z0-9#]+') AS w FROM sentence WHERE text IS NOT NULL)),
word AS (SELECT DISTINCT a FROM tok), lg AS (SELECT a, unnest({_TRI.format(a="a")}) AS g FROM word), rg AS (SELECT v, unnest({_TRI.format(a="v")}) AS g FROM name),
ln AS (SELECT a, count(*) AS n FROM lg GROUP BY 1), rn AS (SELECT v, count(*) AS m FROM rg GROUP BY 1),
near AS (SELECT a, v, {_LEV.format(a="a", b="v")} AS k FROM (SELECT a, v, count(*) AS c FROM lg JOIN rg USING (g) GROUP BY 1, 2) JOIN ln USING (a) JOIN rn USING (v)
  WHERE c / (n + m - c) >= {RECALL} AND {_LEV.format(a="a", b="v")} >= {RECALL}),
hit AS (SELECT sent_id, p, v, k, w, unnest(range(1, least(len(w) - p + 1, ceil(length(v) / k)::INT + 2) + 1)) AS q FROM tok JOIN near USING (a)),
run AS (SELECT sent_id, p, v, q, array_to_string(w[p:p + q - 1], ' ') AS phrase FROM hit),
scored AS (SELECT *, {_LEV.format(a="phrase", b="v")} AS s FROM run),
drop_at AS (SELECT *, s < lag(s) OVER (PARTITION BY sent_id, p, v ORDER BY q) AS falls FROM scored),
upto AS (SELECT *, sum(CASE WHEN falls THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id, p, v ORDER BY q) AS fallen FROM drop_at),
last AS (SELECT *, row_number() OVER (PARTITION BY sent_id, p, v ORDER BY q DESC) AS z FROM upto WHERE fallen = 0)
SELECT sent_id, p - 1 AS pos, q AS n_tokens, phrase, v AS name, round(s, 6) AS score FROM last WHERE z = 1 AND s >= {PRECISION}
"""

_HAS = r"regexp_matches({t}, '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{w})(?:[^\p{{L}}\p{{N}}]|$)')"

QUERIES = {f.__name__: f for f in (lev_similarity, wordwise_similarity, bigram_set_similarity, bigram_kernel, dice_multiset, prevailing_similarity, trigram_simjoin, typed_simjoin, suffix_morph, score_buckets, bigram_counts, phrase_extension, label_predicates, existential_normalise)}
ORACLES = {
    "lev_similarity": f"WITH {_SURF} SELECT x, y, levenshtein(x, y) AS edits, round({_LEV.format(a='x', b='y')}, 6) AS similarity FROM surf",
    "wordwise_similarity": rf"""WITH {_SURF}, w AS (SELECT x, y, regexp_extract_all(x, '[\p{{L}}\p{{N}}]+') AS p, regexp_extract_all(y, '[\p{{L}}\p{{N}}]+') AS q FROM surf)
      SELECT x, y, round(coalesce(list_product(list_transform(p, lambda a: coalesce(list_max(list_transform(q, lambda b: {_LEV.format(a='a', b='b')})), 0.0))), 1.0), 6) AS similarity FROM w""",
    "bigram_set_similarity": f"WITH {_SURF}, {_SETS} SELECT x, y, round({_COS}, 6) AS similarity FROM sets",
    "bigram_kernel": f"""WITH {_SURF}, {_SETS} SELECT x, y, {_KER.format(a='x', b='y', g='g', h='h')} AS kernel,
      round({_KER.format(a='x', b='y', g='g', h='h')} / nullif(sqrt({_KER.format(a='x', b='x', g='g', h='g')} * {_KER.format(a='y', b='y', g='h', h='h')}), 0), 6) AS normal FROM sets""",
    "dice_multiset": f"""WITH {_SURF}, gx AS (SELECT x, g, count(*) AS n FROM (SELECT x, unnest({_BI.format(a='x')}) AS g FROM (SELECT DISTINCT x FROM surf)) GROUP BY 1, 2),
      gy AS (SELECT y, g, count(*) AS n FROM (SELECT y, unnest({_BI.format(a='y')}) AS g FROM (SELECT DISTINCT y FROM surf)) GROUP BY 1, 2),
      nx AS (SELECT x, sum(n) AS n FROM gx GROUP BY 1), ny AS (SELECT y, sum(n) AS n FROM gy GROUP BY 1),
      e AS (SELECT s.x, s.y, sum(least(gx.n, gy.n)) AS e FROM surf s JOIN gx ON gx.x = s.x JOIN gy ON gy.y = s.y AND gy.g = gx.g GROUP BY 1, 2)
      SELECT s.x, s.y, round(CASE WHEN coalesce(nx.n, 0) + coalesce(ny.n, 0) = 0 THEN 1.0 ELSE 2.0 * coalesce(e.e, 0) / (coalesce(nx.n, 0) + coalesce(ny.n, 0)) END, 6) AS similarity
      FROM surf s LEFT JOIN e USING (x, y) LEFT JOIN nx ON nx.x = s.x LEFT JOIN ny ON ny.y = s.y""",
    "prevailing_similarity": f"""WITH {_SURF}, {_SETS}, t AS (SELECT x, y, greatest({_LEV.format(a='x', b='y')}, {_COS}) AS lit, {_TRI.format(a='x')} AS p, {_TRI.format(a='y')} AS q FROM sets)
      SELECT x, y, round(CASE WHEN lit > 0.85 THEN lit WHEN len(p) + len(q) = 0 THEN 1.0 ELSE len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q))) END, 6) AS similarity FROM t""",
    "trigram_simjoin": f"WITH {_MATCH} SELECT a, b, round(score, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM pair",
    "typed_simjoin": f"""WITH {_MATCH}, k AS (SELECT {_ASCII.format(x="t")} AS b, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM gazetteer GROUP BY 1)
      SELECT a, b, types, round(score, 6) AS score FROM pair JOIN k USING (b)""",
    "suffix_morph": f"WITH {_MATCH} SELECT a, b, round(score, 6) AS score FROM pair WHERE ends_with(b, right(a, 2))",
    "score_buckets": f"WITH {_MATCH} SELECT a, round(score, 6) AS score, count(*) AS n, min(b) AS first FROM pair GROUP BY 1, 2",
    "bigram_counts": f"SELECT name, gram, count(*) AS n FROM (SELECT name, unnest({_BI.format(a='name')}) AS gram FROM (SELECT DISTINCT lower(t) AS name FROM gazetteer WHERE t IS NOT NULL)) GROUP BY 1, 2",
    "phrase_extension": PHRASE_SQL,
    "label_predicates": rf"""SELECT DISTINCT sent_id, CASE WHEN {_HAS.format(t='text', w='neither|nor')} THEN 'NEITHER' WHEN {_HAS.format(t='text', w='or')} THEN 'OR' WHEN {_HAS.format(t='text', w='and|but')} THEN 'AND' ELSE 'NONE' END AS connector,
      {_HAS.format(t='text', w='not|no')} AS negated, length(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '#', 'g'), '[^\w\s]', '', 'g'), '\s+', '-', 'g')) AS slug_length,
      lower(replace(regexp_replace(text, '[^\x00-\x7F]', '#', 'g'), ' ', '_')) AS key FROM sentence WHERE text IS NOT NULL""",
    "existential_normalise": r"""WITH n AS (SELECT DISTINCT ON (id) id, xi, properties FROM gsm WHERE id IS NOT NULL),
      k AS (SELECT id, 'be(' || coalesce(list_filter(xi, lambda x: x IS NOT NULL)[1], '?' || id) || ', ?' || id || ')[pos:' || coalesce(properties['pos'], '-') || '[x]]' AS kernel FROM n)
      SELECT id, regexp_replace(kernel, '\?[0-9]+', '?', 'g') AS kernel, array_to_string(regexp_extract_all(kernel, '\[([^\[\]]*)\]', 1), '|') AS inner FROM k""",
}
