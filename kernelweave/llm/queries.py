"""Queries on text corpora and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.duplicates import duplicate_members
from kernelweave.llm.frequency import mark_extremes, terms, value_counts
from kernelweave.llm.fuzzy import match_names
from kernelweave.llm.packing import containers, fill
from kernelweave.llm.tokens import encode_column
from kernelweave.llm.topn import top_n
from kernelweave.llm.truncation import share_by_source, truncated
from kernelweave.runtime import cut, table

CAPACITY = 2048


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The gazetteer entry meant by every name typed by hand, or none."""
    manual = table(spark, d, "mention").where("source = 'manual'").dropDuplicates(["mention_id"])
    name = F.when(F.regexp_replace(F.coalesce("monad", F.lit("")), r"[\s\p{Z}]+", "") != "", F.col("monad")).otherwise(F.coalesce("text", F.lit("")))
    typed = manual.select(F.col("mention_id").alias("item"), F.col("type").alias("kind"), name.alias("name"))
    names = table(spark, d, "gazetteer").select(F.col("type").alias("kind"), F.col("idx").alias("entry"), F.col("t").alias("name"))
    return match_names(typed, names).select(F.col("item").alias("mention_id"), F.col("entry").alias("idx"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of terms, rel and lang that occur in very few or very many rows."""
    rows = table(spark, d, "compact_relation")
    counts = value_counts(rows, "rel_id", {"term": terms(F.col("surface_start")), "rel": F.array("rel"), "lang": F.array("lang")})
    return mark_extremes(counts, rows.count()).where(F.col("mark").isNotNull()).select("field", "value", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The two best mentions of every sentence and type."""
    rows = table(spark, d, "mention").where(F.col("type").isNotNull())
    order = [(F.col("confidence"), True), (F.col("end_char") - F.col("start_char"), True), (F.col("start_char"), False)]
    return top_n(rows, ["sent_id", "type"], order, "mention_id", 2).select("mention_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The smallest rel_id of every fact with each other row of the fact."""
    return duplicate_members(table(spark, d, "compact_relation"), table(spark, d, "relation_map"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return containers(cut(encode_column(table(spark, d, "documents"), "doc_id", "text", only_count=True)), CAPACITY)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text or piece."""
    return _placed(spark, d)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and tokens of every container."""
    return fill(_placed(spark, d), CAPACITY)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose text was cut."""
    return truncated(table(spark, d, "documents").select("doc_id", "source", "text"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    """Documents, cut ones and their share for every source."""
    return share_by_source(table(spark, d, "documents").select("doc_id", "source", "text"))


P3_SQL = r"""
WITH typed AS (
  SELECT DISTINCT mention_id, type, CASE WHEN regexp_replace(coalesce(monad, ''), '[\s\p{Z}]+', '', 'g') <> '' THEN monad ELSE coalesce(text, '') END AS name FROM mention WHERE source = 'manual'
), plain AS (
  SELECT mention_id, type, trim(regexp_replace(lower(strip_accents(name)), '[^\p{L}\p{N}]+', ' ', 'g')) AS f FROM typed
), folded AS (SELECT mention_id, type, CASE WHEN regexp_full_match(f, '\p{L}(?: \p{L})+') THEN replace(f, ' ', '') ELSE f END AS f FROM plain),
word AS (SELECT DISTINCT type, f, string_split(f, ' ') AS w FROM folded),
turned AS (SELECT DISTINCT type, f, array_to_string(list_concat(w[k + 1:], w[:k]), ' ') AS t FROM (SELECT *, unnest(range(len(w))) AS k FROM word)),
entry AS (SELECT type, idx, trim(regexp_replace(lower(strip_accents(t)), '[^\p{L}\p{N}]+', ' ', 'g')) AS g FROM gazetteer),
near AS (SELECT t.type, t.f, e.idx, min(levenshtein(t.t, e.g)) AS n FROM turned t JOIN entry e ON t.type = e.type AND abs(length(t.t) - length(e.g)) <= 2
  WHERE t.f <> '' AND levenshtein(t.t, e.g) <= CASE WHEN length(e.g) <= 5 THEN 0 ELSE 2 END GROUP BY 1, 2, 3),
best AS (SELECT type, f, min_by(idx, n) AS idx FROM (SELECT *, min(n) OVER (PARTITION BY type, f) AS least FROM near) WHERE n = least GROUP BY 1, 2 HAVING count(*) = 1)
SELECT mention_id, coalesce(b.idx, 'none') AS idx FROM folded LEFT JOIN best b USING (type, f)
"""

P4_SQL = r"""
WITH item AS (
  SELECT rel_id, 'term' AS field, unnest(list_transform(regexp_extract_all(surface_start, '[\p{L}\p{Nd}]+'), lambda x: lower(x))) AS value FROM compact_relation
  UNION ALL SELECT rel_id, 'rel', rel FROM compact_relation UNION ALL SELECT rel_id, 'lang', lang FROM compact_relation
), counted AS (SELECT field, value, count(DISTINCT rel_id) AS r FROM item WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT field, value, CASE WHEN r <= 2 THEN 'rare' ELSE 'common' END AS mark FROM counted WHERE r <= 2 OR r > 0.05 * (SELECT count(*) FROM compact_relation)
"""

P6_SQL = """
SELECT mention_id FROM (
  SELECT mention_id, row_number() OVER (PARTITION BY sent_id, type ORDER BY confidence DESC NULLS LAST, end_char - start_char DESC NULLS LAST, start_char NULLS LAST, mention_id) AS k
  FROM (SELECT DISTINCT mention_id, sent_id, type, confidence, start_char, end_char FROM mention WHERE type IS NOT NULL)) WHERE k <= 2
"""

_CANONICAL = r"regexp_replace(lower(upper({x})), '[\s\p{{Z}}\p{{C}}\p{{P}}]+', '', 'g')"
P7_SQL = f"""
WITH plain AS (
  SELECT rel_id, lang, rel, {_CANONICAL.format(x="surface_start")} AS x, {_CANONICAL.format(x="surface_end")} AS y,
    rel IN (SELECT label FROM relation_map WHERE is_symmetric) AS either FROM compact_relation
  WHERE lang IS NOT NULL AND rel IS NOT NULL AND surface_start IS NOT NULL AND surface_end IS NOT NULL
), fact AS (
  SELECT rel_id, min(rel_id) OVER (PARTITION BY lang, rel, CASE WHEN either THEN least(x, y) ELSE x END, CASE WHEN either THEN greatest(x, y) ELSE y END) AS rel_id_a FROM plain
)
SELECT rel_id_a, rel_id AS rel_id_b FROM fact WHERE rel_id <> rel_id_a
"""

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_share": p10_share}
ORACLES = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p6_found": P6_SQL, "p7_found": P7_SQL}
