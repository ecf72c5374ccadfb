"""Queries that aggregate, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import aggregates
from tracklake.plans.common import EVENTS, events, rounded, table

_STATS = ["min", "max", "mean", "std", "median", "iqr", "p1", "p5", "p95", "p99", "p95_p5", "p99_p1"]


def value_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.groupBy("l_returnflag", "l_linestatus").agg(*aggregates.stats(F.col("l_extendedprice"))), *_STATS, digits=4)


def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.level_stats(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus"), "mean", "std")


def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.otsu(table(spark, sf_dir, "events"), ["event_type"], "value", 64), "threshold")


def label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("p", F.col("event_type") == "error")
    return rounded(aggregates.roc_auc(e, ["user_id"], "value", "p"), "auc")


def document_quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", F.col("quality") == 1)
    return rounded(aggregates.roc_auc(d, ["lang"], "n_chars", "p"), "auc")


def label_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("p", F.col("event_type") == "error").withColumn("score", F.round("value", 1))
    return rounded(aggregates.average_precision(e, ["user_id"], "score", "p"), "ap")


def onset_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First error against first value above the user's median, over users of one remainder class."""
    e = events(spark, sf_dir)
    m = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    o = e.join(m, "user_id").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("t"))).alias("a"), F.min(F.when(F.col("value") > F.col("m"), F.col("t"))).alias("b"))
    return rounded(aggregates.agreement(o.withColumn("cohort", F.col("user_id") % 3), ["cohort"], "a", "b"), "pearson", "spearman", "mae", "within_1", "within_2")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"))
    return li.select("l_returnflag", F.format_string("%.4f +/- %.4f", "m", "s").alias("summary"))


def shipping_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.groupBy("l_suppkey").agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("mean")), "mean")


def state_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    kinds = ["click", "error", "signup", "purchase", "view"]
    return e.groupBy("d").pivot("event_type", kinds).agg(F.count_distinct("user_id")).na.fill(0).select(F.col("d").cast("string").alias("day"), *[F.col(k).alias(f"n_{k}") for k in kinds])


def threshold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumns({"region": F.expr("c_nationkey div 5"), "nation": F.col("c_nationkey")})
    return rounded(aggregates.fallback_threshold(c, "c_acctbal", "nation", "region", 0.95, 60), "threshold")


def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").withColumn("p", F.when(F.col("s_suppkey") % 10 != 0, F.abs(F.col("s_acctbal")) / 12000))
    return rounded(aggregates.benjamini_hochberg(p, "p").select("s_suppkey", "p", "q"), "p", "q")


def price_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_quantity") > 25, "b": F.col("l_extendedprice") > 40000})
    return rounded(aggregates.confusion(li, ["l_returnflag"], "a", "b"), "precision", "recall", "accuracy", "dice", "iou")


def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.expr("cast(l_quantity as int) % 6").alias("b"))
    return rounded(aggregates.overlap_iou(li, "a", "b"), "iou")


def fold_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("score"))
    return rounded(aggregates.impact(s, "l_returnflag", "fold", "score", "N"), "delta", "sem")


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = d.groupBy("source", "quality").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.bool_and(F.col("n") >= 10).alias("safe"), F.min("n").alias("least"), F.sum("n").alias("rows"))


def binned_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-right bins, the lowest bound included, of at least three rows."""
    e = events(spark, sf_dir).withColumn("bin", F.greatest(F.lit(0), F.ceil(F.col("hours") / 48) - 1))
    p = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = e.groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.element_at(p, 2).alias("median"), (F.element_at(p, 3) - F.element_at(p, 1)).alias("iqr")).where("n >= 3")
    return rounded(g, "median", "iqr")


def dominant_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent state of each track, the least of ties."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("state"), F.max("n").alias("n"))


def source_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"))


def priority_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.lit(0.75)).alias("p75"), F.percentile("o_totalprice", F.lit(0.5)).alias("median"))
    return rounded(o, "p75", "median", digits=4)


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_disc_price"), F.sum(price * (1 + F.col("l_tax"))).alias("sum_charge"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("count_order"))
    return rounded(g, "sum_qty", "sum_disc_price", "sum_charge", "avg_disc", digits=2)


QUERIES = {f.__name__: f for f in (
    value_stats, level_stats, otsu_thresholds, label_auc, document_quality_auc, label_average_precision, onset_concordance, metric_summary, shipping_weighted_mean, state_funnel, threshold_fallback,
    false_discovery, price_confusion, label_overlap, fold_impact, class_counts, binned_medians, dominant_state, source_compositions, priority_quantiles, pricing_summary,
)}

_Q = ", ".join(f"quantile_cont(l_extendedprice, {q}) AS {n}" for n, q in (("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
_AGREE = "count(*) AS n, corr(a, b) AS pearson, corr(ra::DOUBLE, rb::DOUBLE) AS spearman, avg(abs(a - b)) AS mae, avg((abs(a - b) <= 1)::INT) AS w1, avg((abs(a - b) <= 2)::INT) AS w2"
_AUC = """r AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {s}) + (count(*) OVER (PARTITION BY {k}, {s}) - 1) / 2.0 AS r FROM d WHERE {s} IS NOT NULL AND p IS NOT NULL),
  g AS (SELECT {k}, count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n0, sum(r) FILTER (p) AS s FROM r GROUP BY 1) SELECT {k}, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) END AS auc FROM g"""

SQL = {
    "value_stats": f"""WITH a AS (SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS min, max(l_extendedprice) AS max, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, {_Q} FROM lineitem GROUP BY 1, 2)
      SELECT l_returnflag, l_linestatus, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median, round(p75 - p25, 4) AS iqr, round(p1, 4) AS p1, round(p5, 4) AS p5, round(p95, 4) AS p95, round(p99, 4) AS p99,
      round(p95 - p5, 4) AS p95_p5, round(p99 - p1, 4) AS p99_p1 FROM a""",
    "level_stats": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, count(l_quantity) AS n FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))",
    "otsu_thresholds": """WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
      h AS (SELECT event_type, lo, hi, least(63, floor((value - lo) / (hi - lo) * 64)::BIGINT) AS bin, count(*) AS n FROM events JOIN b USING (event_type) GROUP BY 1, 2, 3, 4), k AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 64 AS centre FROM h),
      s AS (SELECT *, sum(n) OVER w AS c, sum(n * centre) OVER w AS m, sum(n) OVER a AS total, sum(n * centre) OVER a AS mean FROM k WINDOW w AS (PARTITION BY event_type ORDER BY bin), a AS (PARTITION BY event_type)),
      v AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pow(mean * c - m * total, 2) / (c * (total - c) + 1e-10) DESC, bin) AS r FROM s) SELECT event_type, round(centre, 6) AS threshold FROM v WHERE r = 1""",
    "label_auc": f"WITH {EVENTS}, d AS (SELECT *, event_type = 'error' AS p FROM e), {_AUC.format(k='user_id', s='value')}",
    "document_quality_auc": f"WITH d AS (SELECT d.*, quality = 1 AS p FROM documents d JOIN labels USING (doc_id)), {_AUC.format(k='lang', s='n_chars')}",
    "label_average_precision": f"""WITH {EVENTS}, g AS (SELECT user_id, round(value, 1) AS score, count(*) FILTER (event_type = 'error') AS p, count(*) AS n FROM e GROUP BY 1, 2),
      c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS cum, sum(p) OVER (PARTITION BY user_id) AS total FROM g WINDOW w AS (PARTITION BY user_id ORDER BY score DESC)) SELECT user_id, round(sum(p / nullif(total, 0) * tp / cum), 6) AS ap FROM c GROUP BY 1""",
    "onset_concordance": f"""WITH {EVENTS}, m AS (SELECT user_id, quantile_cont(value, 0.5) AS m FROM e GROUP BY 1), o AS (SELECT user_id % 3 AS cohort, user_id, min(t) FILTER (event_type = 'error') AS a, min(t) FILTER (value > m) AS b FROM e JOIN m USING (user_id) GROUP BY 1, 2),
      r AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY a) + (count(*) OVER (PARTITION BY cohort, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort ORDER BY b) + (count(*) OVER (PARTITION BY cohort, b) - 1) / 2.0 AS rb FROM o WHERE a IS NOT NULL AND b IS NOT NULL),
      g AS (SELECT cohort, {_AGREE} FROM r GROUP BY 1) SELECT cohort, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mae, 6) AS mae, round(w1, 6) AS within_1, round(w2, 6) AS within_2 FROM g""",
    "metric_summary": "SELECT l_returnflag, printf('%.4f +/- %.4f', avg(l_discount), stddev_samp(l_discount)) AS summary FROM lineitem GROUP BY 1",
    "shipping_weighted_mean": "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "state_funnel": "SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"count(DISTINCT user_id) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "error", "signup", "purchase", "view")) + " FROM events GROUP BY 1",
    "threshold_fallback": """WITH c AS (SELECT *, c_nationkey AS nation, c_nationkey // 5 AS region FROM customer), f AS (SELECT nation, region, quantile_cont(c_acctbal, 0.95) AS q, count(c_acctbal) AS n FROM c GROUP BY 1, 2),
      g AS (SELECT region, quantile_cont(c_acctbal, 0.95) AS q, count(c_acctbal) AS n FROM c GROUP BY 1), a AS (SELECT quantile_cont(c_acctbal, 0.95) AS q FROM c)
      SELECT nation, f.region, round(CASE WHEN f.n >= 60 THEN f.q WHEN g.n >= 60 THEN g.q ELSE a.q END, 6) AS threshold, CASE WHEN f.n >= 60 THEN 'fine' WHEN g.n >= 60 THEN 'coarse' ELSE 'all' END AS level FROM f JOIN g ON f.region = g.region, a""",
    "false_discovery": """WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN abs(s_acctbal) / 12000 END AS p FROM supplier), r AS (SELECT *, coalesce(p, 1.0) AS k, row_number() OVER (ORDER BY coalesce(p, 1.0)) AS r, count(*) OVER () AS n FROM p),
      q AS (SELECT *, least(1.0, min(k * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT s_suppkey, round(p, 6) AS p, CASE WHEN p IS NOT NULL THEN round(q, 6) END AS q FROM q""",
    "price_confusion": """WITH c AS (SELECT l_returnflag, l_quantity > 25 AS a, l_extendedprice > 40000 AS b FROM lineitem), n AS (SELECT l_returnflag, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn FROM c GROUP BY 1)
      SELECT l_returnflag, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS accuracy,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS dice, round(coalesce(tp / nullif(tp + fp + fn, 0)::DOUBLE, 0), 6) AS iou FROM n""",
    "label_overlap": """WITH l AS (SELECT l_linenumber AS a, floor(l_quantity)::INT % 6 AS b FROM lineitem), c AS (SELECT a, b, count(*) AS common FROM l WHERE a > 0 AND b > 0 GROUP BY 1, 2), x AS (SELECT a, count(*) AS n FROM l WHERE a > 0 GROUP BY 1), y AS (SELECT b, count(*) AS n FROM l WHERE b > 0 GROUP BY 1)
      SELECT c.a, c.b, common, round(common / (x.n + y.n - common)::DOUBLE, 6) AS iou FROM c JOIN x ON c.a = x.a JOIN y ON c.b = y.b""",
    "fold_impact": """WITH s AS (SELECT l_returnflag, l_linenumber AS fold, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2), d AS (SELECT s.l_returnflag, avg(s.score - b.score) AS delta, stddev_samp(s.score - b.score) / sqrt(count(*)) AS sem, count(*) AS folds FROM s JOIN s b ON b.fold = s.fold AND b.l_returnflag = 'N' WHERE s.l_returnflag <> 'N' GROUP BY 1)
      SELECT l_returnflag, round(delta, 6) AS delta, round(sem, 6) AS sem, folds, CASE WHEN folds < 2 OR sem IS NULL OR sem = 0 THEN 'uncertain' WHEN delta > sem THEN 'hurts' WHEN delta < -sem THEN 'helps' ELSE 'uncertain' END AS impact FROM d""",
    "class_counts": "WITH c AS (SELECT source, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT source, bool_and(n >= 10) AS safe, min(n) AS least, sum(n)::BIGINT AS rows FROM c GROUP BY 1",
    "binned_medians": f"""WITH {EVENTS}, b AS (SELECT event_type, greatest(0, ceil(hours / 48)::BIGINT - 1) AS bin, value FROM e) SELECT event_type, bin, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM b GROUP BY 1, 2 HAVING count(*) >= 3""",
    "dominant_state": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, event_type AS state, n FROM r WHERE r = 1",
    "source_compositions": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS chars FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1",
    "priority_quantiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY 1",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 2) AS avg_disc, count(*) AS count_order
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
}
