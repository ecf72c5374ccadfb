"""Signals, cohorts and group indexes on the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import signals
from tracklake.operators.batches import STRIDES
from tracklake.plans.common import EVENTS, events, rounded, table


def baseline_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tracks of twenty, a frame each ten minutes from an hour before: distance from the mean of the first frames; tracks with too few of them (those of odd number lose some) take label 0's mean."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id div 20 AS track", "cast((vec_id % 20) * 10 - 60 AS double) AS minutes", "label", "embedding").where("track % 2 = 0 OR minutes > -30")
    return rounded(signals.baseline_distance(e, ["track"], "minutes", "embedding", (-60.0, -20.0), 3, F.col("label") == 0), "signal").select("vec_id", "track", "signal")


def probability_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over 100 as the probabilities that a classifier of errors would give."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    p = e.select("event_id", F.when(F.col("value").isNotNull(), F.array(F.col("value") / 100, 1 - F.col("value") / 100)).alias("ps"))
    return rounded(signals.label_signal(e, p, ["event_id"], "event_type", "error", ["error", "other"], "ps").select("event_id", "signal"), "signal")


def study_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tracks: errors are annotated for every third user, purchases are predictions, every eleventh user is a control."""
    e = events(spark, sf_dir).withColumns({"a": F.when(F.col("user_id") % 3 == 0, F.when(F.col("event_type") == "error", "yes").otherwise("no")), "p": F.when(F.col("event_type") == "purchase", "yes").otherwise("no")})
    return signals.assembled_cohorts(e, ["user_id"], "t", "a", "p", "yes", F.col("user_id") % 11 == 0, 30.0, 60.0, 300.0, 1800.0, 2, 0.8, 12)


def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.group_index(table(spark, sf_dir, "documents"), ["lang"], "source")


def rank_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority whether prices and days go together."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority", "round(o_totalprice / 1000) AS price", "datediff(o_orderdate, date'1990-01-01') % 400 AS day")
    return rounded(signals.rank_correlation_test(o, ["o_orderpriority"], "price", "day", "o_orderkey", 50), "rho", "p")


def merged_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' fields, of which every second nation's name is replaced and a region added."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string")).alias("fields"))
    u = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.create_map(F.lit("name"), F.lower("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("fields"))
    m = signals.merged_fields(n, u, ["n_nationkey"], "fields")
    return m.select("n_nationkey", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("key", "name", "region")], F.size("fields").alias("n"))


def large_part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("(0, "), F.col("p_partkey") % 7, F.lit(", "), F.col("p_size"), F.lit(", "), F.col("p_size") + 3, F.lit(")")).alias("box"))
    return signals.large_boxes(p, "box", 20).select("p_partkey", "min_side")


QUERIES = {f.__name__: f for f in (baseline_signals, probability_signals, study_cohorts, document_groups, rank_permutations, merged_properties, large_part_boxes)}

_N = "('0x' || substr(md5('42|' || k || '|{}'), 1, 12))::BIGINT"

SQL = {
    "baseline_signals": """WITH e AS (SELECT vec_id, vec_id // 20 AS track, (vec_id % 20) * 10 - 60 AS minutes, label, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT * FROM e WHERE track % 2 = 0 OR minutes > -30), w AS (SELECT * FROM f WHERE minutes BETWEEN -60 AND -20), k AS (SELECT track FROM w GROUP BY 1 HAVING count(*) >= 3),
      u AS (SELECT track, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM w WHERE track IN (SELECT track FROM k)), o AS (SELECT track, list(m ORDER BY i) AS b FROM (SELECT track, i, avg(v) AS m FROM u GROUP BY 1, 2) GROUP BY 1), c AS (SELECT list(m ORDER BY i) AS b FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS i FROM f WHERE label = 0) GROUP BY 1))
      SELECT vec_id, f.track, round(1 - list_cosine_similarity(e, coalesce(o.b, c.b)), 6) AS signal FROM f LEFT JOIN o ON o.track = f.track, c""",
    "probability_signals": "SELECT event_id, round(value / 100, 6) AS signal FROM events",
    "study_cohorts": f"""WITH {EVENTS}, x AS (SELECT user_id, t, CASE WHEN user_id % 3 = 0 THEN event_type = 'error' END AS a, event_type = 'purchase' AS p, user_id % 11 = 0 AS c FROM e),
      r AS (SELECT *, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM x WHERE p), rr AS (SELECT user_id, g, min(t) AS s, count(*) AS n FROM r GROUP BY 1, 2), f AS (SELECT user_id, min(s) AS t_run FROM rr WHERE n >= 2 GROUP BY 1),
      per AS (SELECT user_id, bool_or(c) AS c, min(t) AS lo, max(t) AS hi, count(*) AS n, min(t) FILTER (a) AS onset, count(*) FILTER (p) AS np FROM x GROUP BY 1), q AS (SELECT *, NOT c AND coalesce(onset - lo >= 2 AND hi - onset >= 10, false) AS manual FROM per),
      k AS (SELECT q.*, t_run, CASE WHEN c THEN 'mock' WHEN manual THEN 'productive' WHEN np = 0 THEN 'bystander' WHEN t_run IS NOT NULL THEN 'unannotated_productive' WHEN (n - np) / n::DOUBLE >= 0.8 THEN 'bystander' ELSE 'abortive' END AS cohort FROM q LEFT JOIN f USING (user_id) WHERE manual OR n * 30 >= 1800),
      z AS (SELECT *, CASE cohort WHEN 'productive' THEN onset WHEN 'unannotated_productive' THEN t_run END AS t_zero FROM k), o AS (SELECT x.user_id, x.t, cohort, x.user_id::VARCHAR AS lineage, t_zero, (x.t - t_zero) * 30.0 AS minutes FROM x JOIN z USING (user_id) WHERE t_zero IS NULL OR x.t BETWEEN t_zero - 2 AND t_zero + 10),
      s AS (SELECT cohort, lineage FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, lineage) <= 12)
      SELECT user_id, t, cohort, lineage, t_zero, minutes::DOUBLE AS minutes FROM o SEMI JOIN s USING (cohort, lineage)""",
    "document_groups": "SELECT lang, count(*) AS rows, count(DISTINCT source) AS units, coalesce(string_agg(DISTINCT source, ';' ORDER BY source), '') AS members, coalesce(lang, '') || ': ' || count(*) || ' rows, ' || count(DISTINCT source) || ' units' AS summary FROM documents GROUP BY lang",
    "rank_permutations": f"""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS g, round(o_totalprice / 1000) AS x, date_diff('day', DATE '1990-01-01', o_orderdate) % 400 AS y FROM orders),
      r AS (SELECT g, id, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS b, row_number() OVER (PARTITION BY g ORDER BY md5('42|' || id)) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM o),
      k AS (SELECT k, [{", ".join(map(str, STRIDES))}][{_N.format("stride")} % {len(STRIDES)} + 1] AS stride, {_N.format("start")} AS start FROM (SELECT unnest(range(51)) AS k)),
      m AS (SELECT g, n, k, a, CASE WHEN k = 0 THEN place ELSE (place * (stride % n) + start % n) % n END AS place FROM r, k), c AS (SELECT m.g, m.n, m.k, corr(m.a::DOUBLE, r.b::DOUBLE) AS rho FROM m JOIN r ON r.g = m.g AND r.place = m.place GROUP BY 1, 2, 3)
      SELECT s.g AS o_orderpriority, s.n, round(s.rho, 6) AS rho, round(avg((abs(c.rho) >= abs(s.rho) - 1e-12)::INT), 6) AS p FROM c s JOIN c ON c.g = s.g AND c.k > 0 WHERE s.k = 0 GROUP BY s.g, s.n, s.rho""",
    "merged_properties": "SELECT n_nationkey, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END AS region, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM nation",
    "large_part_boxes": "SELECT p_partkey, least(p_size, p_size + 3 - p_partkey % 7)::DOUBLE AS min_side FROM part WHERE least(p_size, p_size + 3 - p_partkey % 7) >= 20",
}
