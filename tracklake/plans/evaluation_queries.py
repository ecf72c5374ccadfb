"""Queries that evaluate, sample and group, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import aggregates, evaluation, index
from tracklake.plans.common import CUSTOMERS, EVENTS, customers, events, rounded, table


def price_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return rounded(evaluation.image_agreement(li, ["l_returnflag", "l_linenumber"], "guess", "l_extendedprice"), "pcc", "nrmse", "psnr")


def flag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("guess", F.when(F.col("l_quantity") > 33, "R").when(F.col("l_quantity") > 16, "A").otherwise("X"))
    return rounded(evaluation.classification_report(li, "l_returnflag", "guess"), "precision", "recall", "f1")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / table(spark, sf_dir, "labels").count(), 6))


def temporal_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC in ten bins of each track's normalised time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = events(spark, sf_dir).withColumns({"last": F.max("t").over(w), "p": F.col("event_type") == "error"})
    b = e.withColumn("bin", F.least(F.lit(9), F.floor(10 * F.col("t") / F.greatest(F.col("last"), F.lit(1)))))
    return rounded(aggregates.roc_auc(b, ["bin"], "value", "p"), "auc")


def branch_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first"))
    return evaluation.branch_onsets(index.branches(customers(spark, sf_dir), "c_custkey", "parent"), first, "c_custkey", "first")


def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.crop_windows(events(spark, sf_dir), ["user_id"], "t", F.col("value") > 80, 2, 20)


def positive_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.positive_picks(events(spark, sf_dir), ["user_id"], "t", "event_id", "event_type", 1, 4)


def source_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.group_folds(table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source"), "source", 5, "f1")


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "hours")
    return evaluation.enriched_sample(e, ["user_id"], "hours", "event_id", 240.0, 48.0, 4, 2, "e1").select("event_id", "user_id", "part")


def cycled_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cycled(table(spark, sf_dir, "customer").withColumn("region", F.expr("c_nationkey div 9")), "region", "c_custkey")


def grouped_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = n.select(F.concat(F.lit("d"), (F.col("s_suppkey") % 12).cast("string")).alias("dataset"), F.when(F.col("s_suppkey") % 12 > 5, F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("s_suppkey") % 2 + 1).cast("int"))).otherwise(F.lit("a")).alias("marker"), F.col("n_name").alias("well"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("title"), "s_suppkey")
    return evaluation.grouped_records(r, "dataset", "marker", "well", ["title"], "s_suppkey")


def retrieval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 100, ranking all others."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(evaluation.retrieval_precision(e.where("vec_id % 100 = 0"), e, "vec_id", "label", "embedding"), "ap")


def left_out_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test each source on the others, and once more without each of these."""
    s = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct()
    t, x = s.withColumnRenamed("source", "test"), s.withColumnRenamed("source", "excluded")
    jobs = t.join(x, F.col("test") != F.col("excluded"))  # sources are a small dimension
    return jobs.union(t.withColumn("excluded", F.lit(None).cast("string")))


def longest_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the ten deepest branches."""
    b = index.branches(customers(spark, sf_dir), "c_custkey", "parent").groupBy("leaf").agg(F.count("*").alias("n"))
    return b.orderBy(F.desc("n"), "leaf").limit(10)


QUERIES = {f.__name__: f for f in (
    price_agreement, flag_report, label_counts, temporal_auc, branch_onsets, crop_windows, positive_picks, source_folds, enriched_events, cycled_nations, grouped_suppliers, retrieval_precision, left_out_jobs, longest_lineages,
)}

_BRANCHES = f"RECURSIVE {CUSTOMERS}, walk(leaf, node, up, depth) AS (SELECT c_custkey, c_custkey, parent, 0 FROM c WHERE c_custkey NOT IN (SELECT parent FROM c WHERE parent IS NOT NULL) UNION ALL SELECT leaf, c_custkey, parent, depth + 1 FROM walk JOIN c ON c_custkey = up)"

SQL = {
    "price_agreement": """WITH l AS (SELECT l_returnflag, l_linenumber, l_quantity * 1500 AS p, l_extendedprice AS t FROM lineitem), a AS (SELECT l_returnflag, l_linenumber, corr(p, t) AS c, avg((p - t) * (p - t)) AS m, max(t) - min(t) AS r FROM l GROUP BY 1, 2)
      SELECT l_returnflag, l_linenumber, round(c, 6) AS pcc, round(sqrt(m) / nullif(r, 0), 6) AS nrmse, round(10 * log10(r * r / nullif(m, 0)), 6) AS psnr FROM a""",
    "flag_report": """WITH l AS (SELECT l_returnflag AS t, CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'A' ELSE 'X' END AS p FROM lineitem), k AS (SELECT DISTINCT t AS label FROM l UNION SELECT DISTINCT p FROM l),
      c AS (SELECT label, (SELECT count(*) FROM l WHERE t = label) AS support, (SELECT count(*) FROM l WHERE p = label) AS claimed, (SELECT count(*) FROM l WHERE t = label AND p = label) AS hit FROM k), r AS (SELECT *, coalesce(hit / nullif(claimed, 0)::DOUBLE, 0) AS pr, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS re FROM c)
      SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support FROM r""",
    "label_counts": "SELECT quality, toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM labels GROUP BY 1, 2",
    "temporal_auc": f"""WITH {EVENTS}, d AS (SELECT least(9, floor(10 * t / greatest(max(t) OVER (PARTITION BY user_id), 1))::BIGINT) AS bin, value, event_type = 'error' AS p FROM e), r AS (SELECT *, rank() OVER (PARTITION BY bin ORDER BY value) + (count(*) OVER (PARTITION BY bin, value) - 1) / 2.0 AS r FROM d),
      g AS (SELECT bin, count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n0, sum(r) FILTER (p) AS s FROM r GROUP BY 1) SELECT bin, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) END AS auc FROM g""",
    "branch_onsets": f"""WITH {_BRANCHES}, f AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT leaf, node, min(o) OVER (PARTITION BY leaf) AS m FROM walk LEFT JOIN f ON o_custkey = node) SELECT node, arg_max(m, leaf) AS t_perturb FROM b WHERE m IS NOT NULL GROUP BY 1""",
    "crop_windows": f"WITH {EVENTS}, a AS (SELECT user_id, min(t) FILTER (value > 80) AS onset, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1) SELECT user_id, onset, onset - 2 AS start, onset + 20 AS stop FROM a WHERE onset - 2 >= lo AND onset + 20 <= hi",
    "positive_picks": f"WITH {EVENTS}, p AS (SELECT a.event_id AS anchor, b.event_id AS positive, row_number() OVER (PARTITION BY a.event_id ORDER BY (a.event_type IS DISTINCT FROM b.event_type)::INT, b.t) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t + 1 AND a.t + 4) SELECT anchor, positive FROM p WHERE r = 1",
    "source_folds": "WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('f1|' || source), source) % 5 AS fold FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT doc_id, source, fold FROM documents JOIN g USING (source)",
    "enriched_events": f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, CASE WHEN abs(hours - 240) <= 48 THEN 'focal' ELSE 'other' END AS part FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY md5('e1|' || event_id), event_id) AS n FROM p)
      SELECT event_id, user_id, part FROM r WHERE n <= CASE WHEN part = 'focal' THEN 4 ELSE 2 END""",
    "cycled_nations": """WITH r AS (SELECT c_nationkey // 9 AS region, c_custkey, row_number() OVER (PARTITION BY c_nationkey // 9 ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey // 9) AS n FROM customer), m AS (SELECT max(n) AS m FROM r), p AS (SELECT region, c_custkey, i, n, unnest(range((m - 1 - i) // n + 1)) AS k FROM r, m)
      SELECT region, k * n + i AS place, c_custkey FROM p""",
    "grouped_suppliers": """WITH r AS (SELECT 'd' || (s_suppkey % 12) AS dataset, CASE WHEN s_suppkey % 12 > 5 THEN ['a', 'b'][s_suppkey % 2 + 1] ELSE 'a' END AS marker, n_name, CASE WHEN s_acctbal > 0 THEN s_name END AS title, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      k AS (SELECT dataset, count(DISTINCT marker) AS k FROM r GROUP BY 1), m AS (SELECT CASE WHEN k > 1 AND marker IS NOT NULL THEN dataset || '_' || marker ELSE dataset END AS name, r.* FROM r JOIN k USING (dataset))
      SELECT name, arg_min(title, s_suppkey) FILTER (title IS NOT NULL) AS title, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS wells, count(*) AS n FROM m GROUP BY 1""",
    "retrieval_precision": """WITH e AS (SELECT * FROM embeddings), p AS (SELECT a.vec_id, -list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS score, a.label = b.label AS ok FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
      g AS (SELECT vec_id, score, count(*) FILTER (ok) AS p, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS cum, sum(p) OVER (PARTITION BY vec_id) AS total FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC)) SELECT vec_id, round(sum(p / nullif(total, 0) * tp / cum), 6) AS ap FROM c GROUP BY 1""",
    "left_out_jobs": "WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT a.source AS test, b.source AS excluded FROM s a JOIN s b ON a.source <> b.source UNION ALL SELECT source, NULL FROM s",
    "longest_lineages": f"WITH {_BRANCHES} SELECT leaf, count(*) AS n FROM walk GROUP BY 1 ORDER BY n DESC, leaf LIMIT 10",
}
