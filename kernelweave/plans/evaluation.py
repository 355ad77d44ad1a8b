"""Queries on vectors, alignments, clusterings and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.functions.vectors import cosine, dot, positive_dot
from kernelweave.operators import similarity as E
from kernelweave.plans.mentions import sentences_of
from kernelweave.runtime import table

EVERY = 100
GROUPS = 4


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _scores(spark: SparkSession, d: str, score) -> DataFrame:
    """Every hundredth vector against all others."""
    every = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", "embedding")
    asked = every.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), F.col("label").alias("q_group"), F.col("embedding").alias("qv"))
    rows = every.select(F.col("vec_id").alias("r"), F.col("label").alias("r_group"), F.col("embedding").alias("rv"))
    return E.against_all(asked, rows, score).where("q <> r")


def embedding_relu_dot(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of stated queries with all vectors, negative ones as 0."""
    return _scores(spark, d, positive_dot).select("q", "r", F.round("score", 4).alias("score"))


def embedding_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Normal kernel of stated queries with all vectors."""
    return _scores(spark, d, cosine).select("q", "r", F.round("score", 4).alias("score"))


def maxsim_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Late interaction: groups of queries against groups of vectors by the sum of best inner products, scaled to 0..1."""
    best = _scores(spark, d, dot).groupBy("q", "q_group", "r_group").agg(F.max("score").alias("score"))
    sums = best.groupBy(F.col("q_group").alias("i"), F.col("r_group").alias("j")).agg(F.sum(F.round("score", 6)).alias("score"))
    return E.scaled(sums, "score").select("i", "j", F.round("score", 4).alias("score"))


def retrieval_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best vectors of every query, by rank."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 6)), "r"))
    return _scores(spark, d, cosine).withColumn("rank", rank).where("rank <= 10").select("q", "r", "rank")


def nearest_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vector of every group to every query, and the mean distance of that alignment by pair of groups."""
    best = E.nearest(_scores(spark, d, cosine).withColumn("score", F.round("score", 6)), ["q", "q_group", "r_group"])
    return best.groupBy("q_group", "r_group").agg(F.round(F.avg(1 - F.col("score")), 4).alias("distance"), F.count(F.lit(1)).alias("n"), F.min("r").alias("first"))


def unaligned(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of a group are nobody's nearest, by group."""
    every = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("r"), F.col("label").alias("r_group"))
    used = E.nearest(_scores(spark, d, cosine).withColumn("score", F.round("score", 6)), ["q", "r_group"]).select("r").distinct()
    return every.join(used, "r", "left_anti").groupBy("r_group").agg(F.count(F.lit(1)).alias("n"))


def _group_scores(spark: SparkSession, d: str) -> DataFrame:
    """i, j, score: mean kernel of the queries of group i with the vectors of group j."""
    means = _scores(spark, d, cosine).groupBy(F.col("q_group").alias("i"), F.col("r_group").alias("j"))
    return means.agg((F.sum(F.round("score", 6).cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("score"))


def symmetrised_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances between groups, the mean of both directions."""
    return E.symmetrised(_group_scores(spark, d)).select("i", "j", F.round("distance", 4).alias("distance"))


def silhouette_precomputed(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette of every query in its group, from distances to all vectors."""
    sums = _scores(spark, d, cosine).groupBy("q", "q_group", "r_group").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.sum(F.round("score", 6).cast("decimal(20,6)")).cast("double")).alias("total"))
    found = E.silhouette(sums.select("q", (F.col("q_group") == F.col("r_group")).alias("own"), "n", "total"))
    return found.select("q", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("silhouette", 4).alias("silhouette"))


def matrix_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Scores between groups over the sum of their row, and over the greatest of their column."""
    pos = _group_scores(spark, d).withColumn("score", F.greatest(F.col("score"), F.lit(0.0)))
    row, col = F.sum("score").over(Window.partitionBy("i")), F.max("score").over(Window.partitionBy("j"))
    return pos.select("i", "j", F.round(F.col("score") / F.nullif(row, F.lit(0.0)), 4).alias("by_row"), F.round(F.col("score") / F.nullif(col, F.lit(0.0)), 4).alias("by_column"))


def threshold_labels(spark: SparkSession, d: str) -> DataFrame:
    """1, 0 or -1 for every pair of groups by thresholds: least score within a group, greatest between groups ten apart in parity."""
    s = _group_scores(spark, d)
    known = s.select("score", (F.col("i") == F.col("j")).alias("same"), (F.abs(F.col("i") - F.col("j")) == 5).alias("conflicts"))
    met = s.join(F.broadcast(E.label_thresholds(known)), F.lit(True))
    return met.select("i", "j", F.when(F.col("score") >= F.col("upper"), 1).when(F.col("score") <= F.col("lower"), -1).otherwise(0).alias("label"))


def _clustered(spark: SparkSession, d: str, label) -> DataFrame:
    names, m = E.matrix(E.symmetrised(_group_scores(spark, d)))
    return spark.createDataFrame([(int(n), int(c)) for n, c in zip(names, label(m), strict=True)], "item long, cluster long")


def agglomerative_complete(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors merged by complete linkage."""
    return _clustered(spark, d, lambda m: E.complete_linkage(m, GROUPS))


def k_medoids(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors around medoids."""
    return _clustered(spark, d, lambda m: E.k_medoids(m, GROUPS))


def markov_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors by Markov flow."""
    return _clustered(spark, d, lambda m: E.markov_clusters((m.max() - m) ** 2, 2.0))


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with their language and the one that their small words suggest."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    hits = lambda *ws: F.size(F.filter(tokens, lambda t: t.isin(*ws)))
    rows = sentences_of(spark, d).where("lang IS NOT NULL").select("sent_id", "lang", hits("the", "is", "of", "near").alias("en"), hits("der", "die", "das", "ist", "und").alias("de"), hits("le", "la", "les", "de", "et").alias("fr"), hits("el", "los", "cerca", "y", "en").alias("es"))
    top = F.greatest("en", "de", "fr", "es")
    return rows.select("sent_id", "lang", F.when(top == 0, "none").when(F.col("en") == top, "en").when(F.col("de") == top, "de").when(F.col("fr") == top, "fr").otherwise("es").alias("guess"))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of every language."""
    m = E.class_metrics(E.confusion(_guessed(spark, d), "lang", "guess"))
    return m.select("class", "support", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"), _r(F.col("f1")).alias("f1"))


def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with macro and weighted means."""
    m = E.overall(E.class_metrics(E.confusion(_guessed(spark, d), "lang", "guess")))
    return m.select(*[_r(F.col(c)).alias(c) for c in m.columns])


def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Purity and adjusted Rand index of guessed against given languages."""
    m = E.partition_agreement(E.confusion(_guessed(spark, d), "lang", "guess"))
    return m.select(*[_r(F.col(c)).alias(c) for c in m.columns])


def cluster_set_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance between sources and corpora of the documents as sets, where they share documents."""
    docs = table(spark, d, "documents").where("source IS NOT NULL AND corpus IS NOT NULL")
    return E.cluster_distances(E.confusion(docs, "source", "corpus")).select("expected", "predicted", _r(F.col("distance")).alias("distance"))


def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    """Twenty bins of equal width over the values of events."""
    ends = table(spark, d, "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = table(spark, d, "events").where("value IS NOT NULL").join(F.broadcast(ends), F.lit(True))
    bin_no = F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 20), F.lit(19))
    return rows.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def melt_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of every measure of the line items by return flag, one measure a row."""
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.count(c)).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    long = wide.unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "measure", "mean")
    return long.select("l_returnflag", "measure", _r(F.col("mean")).alias("mean"))


def phase_table(spark: SparkSession, d: str) -> DataFrame:
    """Value by user and type of event as one row per user, 0 where there is none."""
    kinds = ["click", "error", "purchase", "view"]
    rows = table(spark, d, "events").groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value").cast("decimal(20,4)"))), F.lit(0)).cast("double").alias(k) for k in kinds])
    return rows.select("user_id", *[F.round(k, 4).alias(k) for k in kinds])


def shortest_topn(spark: SparkSession, d: str) -> DataFrame:
    """The fifty shortest sentences."""
    rows = sentences_of(spark, d).select("sent_id", F.length("text").alias("n")).distinct()
    return rows.orderBy("n", "sent_id").limit(50)


_E = f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
  s AS (SELECT a.vec_id AS q, a.label AS q_group, b.vec_id AS r, b.label AS r_group, list_dot_product(a.v, b.v) AS dp, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cs FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)"""
_GS = _E + ", g AS (SELECT q_group AS i, r_group AS j, sum(round(cs, 6)::DECIMAL(20,6))::DOUBLE / count(*) AS score FROM s GROUP BY 1, 2)"
_HITS = "len(list_filter(w, lambda t: t IN ({x})))"
_G = rf"""t AS (SELECT DISTINCT sent_id, lang, text, corpus FROM sentence WHERE text IS NOT NULL AND lang IS NOT NULL), h AS (SELECT sent_id, lang, regexp_extract_all(lower(text), '[\p{{L}}]+') AS w FROM t),
  k AS (SELECT sent_id, lang, {_HITS.format(x="'the', 'is', 'of', 'near'")} AS en, {_HITS.format(x="'der', 'die', 'das', 'ist', 'und'")} AS de, {_HITS.format(x="'le', 'la', 'les', 'de', 'et'")} AS fr, {_HITS.format(x="'el', 'los', 'cerca', 'y', 'en'")} AS es FROM h),
  x AS (SELECT lang AS expected, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'none' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS predicted FROM k),
  m AS (SELECT c AS class, count(*) FILTER (WHERE expected = c) AS support, count(*) FILTER (WHERE predicted = c) AS asserted, count(*) FILTER (WHERE expected = c AND predicted = c) AS hits FROM x, (SELECT expected AS c FROM x UNION SELECT predicted FROM x) GROUP BY 1),
  pr AS (SELECT *, CASE WHEN asserted = 0 THEN 0.0 ELSE hits / asserted END AS p, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS rc FROM m), f AS (SELECT *, CASE WHEN p + rc = 0 THEN 0.0 ELSE 2 * p * rc / (p + rc) END AS f1 FROM pr)"""

QUERIES = {
    f.__name__: f
    for f in (embedding_relu_dot, embedding_kernel, maxsim_retrieval, retrieval_top, nearest_alignment, unaligned, symmetrised_distance, silhouette_precomputed, matrix_normalised, threshold_labels, agglomerative_complete, k_medoids, markov_clusters, confusion_metrics, overall_metrics, partition_agreement, cluster_set_distance, histogram_bins, melt_mean, phase_table, shortest_topn)
}
ORACLES = {
    "embedding_relu_dot": f"WITH {_E} SELECT q, r, round(greatest(dp, 0), 4) AS score FROM s",
    "embedding_kernel": f"WITH {_E} SELECT q, r, round(cs, 4) AS score FROM s",
    "maxsim_retrieval": f"WITH {_E}, b AS (SELECT q, q_group, r_group, max(dp) AS z FROM s GROUP BY 1, 2, 3), u AS (SELECT q_group AS i, r_group AS j, sum(round(z, 6)) AS z FROM b GROUP BY 1, 2) SELECT i, j, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 4) AS score FROM u",
    "retrieval_top": f"WITH {_E} SELECT q, r, rank FROM (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY round(cs, 6) DESC, r) AS rank FROM s) WHERE rank <= 10",
    "nearest_alignment": f"WITH {_E}, b AS (SELECT q, q_group, r_group, r, round(cs, 6) AS c, row_number() OVER (PARTITION BY q, r_group ORDER BY round(cs, 6) DESC, r) AS k FROM s) SELECT q_group, r_group, round(avg(1 - c), 4) AS distance, count(*) AS n, min(r) AS first FROM b WHERE k = 1 GROUP BY 1, 2",
    "unaligned": f"WITH {_E}, b AS (SELECT q, r_group, r, row_number() OVER (PARTITION BY q, r_group ORDER BY round(cs, 6) DESC, r) AS k FROM s) SELECT label AS r_group, count(*) AS n FROM e WHERE vec_id NOT IN (SELECT r FROM b WHERE k = 1) GROUP BY 1",
    "symmetrised_distance": f"WITH {_GS}, u AS (SELECT i, j, score FROM g UNION ALL SELECT j, i, score FROM g) SELECT i, j, round(1 - sum(score) / 2, 4) AS distance FROM u GROUP BY 1, 2",
    "silhouette_precomputed": f"""WITH {_E}, u AS (SELECT q, q_group = r_group AS own, r_group, (count(*) - sum(round(cs, 6)::DECIMAL(20,6))::DOUBLE) / count(*) AS m FROM s GROUP BY 1, 2, 3), v AS (SELECT q, max(m) FILTER (WHERE own) AS a, min(m) FILTER (WHERE NOT own) AS b FROM u GROUP BY 1)
      SELECT q, round(a, 4) AS a, round(b, 4) AS b, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 4) AS silhouette FROM v""",
    "matrix_normalised": f"WITH {_GS}, p AS (SELECT i, j, greatest(score, 0.0) AS z FROM g) SELECT i, j, round(z / nullif(sum(z) OVER (PARTITION BY i), 0), 4) AS by_row, round(z / nullif(max(z) OVER (PARTITION BY j), 0), 4) AS by_column FROM p",
    "threshold_labels": f"WITH {_GS}, t AS (SELECT min(score) FILTER (WHERE i = j) AS u, max(score) FILTER (WHERE abs(i - j) = 5) AS l FROM g) SELECT i, j, CASE WHEN score >= greatest(l, u) THEN 1 WHEN score <= least(l, u) THEN -1 ELSE 0 END AS label FROM g, t",
    "confusion_metrics": f"WITH {_G} SELECT class, support, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "overall_metrics": f"""WITH {_G} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(p) FILTER (WHERE support > 0), 6) AS macro_precision, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(avg(rc) FILTER (WHERE support > 0), 6) AS macro_recall,
      round(sum(rc * support) / sum(support), 6) AS weighted_recall, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""",
    "partition_agreement": f"""WITH {_G}, c AS (SELECT expected, predicted, count(*) AS n FROM x GROUP BY 1, 2), a AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM c GROUP BY expected)), b AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM c GROUP BY predicted)),
      w AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS z FROM c), tp AS (SELECT sum(z) AS top FROM (SELECT max(n) AS z FROM c GROUP BY predicted))
      SELECT round(top / n, 6) AS purity, round((z - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM a, b, w, tp""",
    "cluster_set_distance": "WITH c AS (SELECT source AS expected, corpus AS predicted, count(*) AS n FROM documents WHERE source IS NOT NULL AND corpus IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY expected) AS a, sum(n) OVER (PARTITION BY predicted) AS b FROM c) SELECT expected, predicted, round((a + b - 2 * n) / (a + b - n), 6) AS distance FROM w",
    "histogram_bins": "WITH z AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / nullif(hi - lo, 0) * 20), 19)::BIGINT AS bin, count(*) AS n FROM events, z WHERE value IS NOT NULL GROUP BY 1",
    "melt_mean": "WITH w AS (SELECT l_returnflag, sum(l_quantity::DECIMAL(20,4))::DOUBLE / count(l_quantity) AS l_quantity, sum(l_discount::DECIMAL(20,4))::DOUBLE / count(l_discount) AS l_discount, sum(l_tax::DECIMAL(20,4))::DOUBLE / count(l_tax) AS l_tax FROM lineitem GROUP BY 1) SELECT l_returnflag, measure, round(mean, 6) AS mean FROM (UNPIVOT w ON l_quantity, l_discount, l_tax INTO NAME measure VALUE mean)",
    "phase_table": "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value::DECIMAL(20,4)) FILTER (WHERE event_type = '{k}'), 0)::DOUBLE, 4) AS {k}" for k in ("click", "error", "purchase", "view")) + " FROM events GROUP BY 1",
    "shortest_topn": "SELECT DISTINCT sent_id, length(text) AS n FROM sentence WHERE text IS NOT NULL ORDER BY n, sent_id LIMIT 50",
}
