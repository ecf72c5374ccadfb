"""Templates of users' days around their first error, and alignments with them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import templates
from tracklake.plans.common import EVENTS, events, rounded, table

K = ["user_id"]
DAY = 1440.0


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days since the first event: mean value and number of events as a vector, and whether there was an error."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("hours") / 24).cast("int"))
    return e.groupBy("user_id", "day").agg(F.array(F.avg("value") / 100, F.count("*") / 10).alias("v"), F.when(F.max(F.col("event_type") == "error"), "error").otherwise("none").alias("state"))


def learnt(spark: SparkSession, sf_dir: str) -> templates.Template:
    """From the days 3 before to 6 after each user's first day with an error."""
    d = days(spark, sf_dir)
    onset = d.where("state = 'error'").groupBy("user_id").agg(F.min("day").alias("onset"))
    near = d.join(onset, "user_id").withColumn("minutes", (F.col("day") - F.col("onset")) * DAY).where("day BETWEEN onset - 3 AND onset + 6")
    return templates.learn_template(near, K, "day", "v", "state", "minutes", least=4)


def dtw_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learnt template: a row for each place."""
    t = learnt(spark, sf_dir)
    low, high = templates.event_band(t)
    rows = [(p, v.tolist(), t.minutes[p], t.fractions.get("error", [0.0] * len(t.vectors))[p], low <= p / max(len(t.vectors) - 1, 1) <= high) for p, v in enumerate(t.vectors)]
    return rounded(spark.createDataFrame(rows, "place int, vector array<double>, minutes double, error_share double, in_event_band boolean"), "minutes", "error_share").withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, templates.Template]:
    t = learnt(spark, sf_dir)
    return templates.align_tracks(days(spark, sf_dir), K, "day", "v", t), t


def dtw_pseudotime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of all users, aligned with the learnt template."""
    a = _aligned(spark, sf_dir)[0].withColumn("error_share", F.col("labels")["error"]).drop("labels")
    return rounded(a, "pseudotime", "speed", "minutes", "cost", "mean_cost", "skew", "error_share")


def dtw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(templates.response_groups(_aligned(spark, sf_dir)[0], K), "cost", "speed")


def alignment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users each gate of the alignment drops."""
    a, t = _aligned(spark, sf_dir)
    return templates.gated(a, K, "day", len(t.vectors), DAY, max_skew=0.2, match_minutes=3 * DAY, before_minutes=2 * DAY, after_minutes=2 * DAY)[1]


def dtw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of each user's days that fits the first eight days of the first user best: its cost, first and last day and days before and after it, with those users left out that have fewer than 8 days, 2 days
    in the match, or no day on either side."""
    d = days(spark, sf_dir)
    first = d.join(F.broadcast(d.agg(F.min("user_id").alias("user_id"))), "user_id").orderBy("day").limit(8).select("v").collect()
    t = templates.Template(np.array([r.v for r in first]), 1)
    a = templates.align_tracks(d, K, "day", "v", t, least=8)
    kept, _ = templates.gated(a, K, "day", 8, DAY, max_skew=1.0, match_ratio=0.2, before_minutes=DAY, after_minutes=DAY)
    return rounded(kept.groupBy(*K).agg(F.first("cost").alias("cost"), F.first("match_start").alias("match_start"), F.first("match_stop").alias("match_stop"), F.count_if(F.col("region") == "aligned").alias("matched")), "cost")


QUERIES = {f.__name__: f for f in (dtw_template, dtw_pseudotime, dtw_responses, alignment_gates, dtw_segments)}

SQL = {
    # one cell of the table of sums at each step: rows are places of the template, columns the days of a user; each sum has the column its path starts in
    "dtw_segments": f"""WITH RECURSIVE {EVENTS},
      d AS (SELECT user_id, floor(hours / 24)::INT AS day, avg(value) / 100 AS a, count(*) / 10 AS b FROM e GROUP BY 1, 2),
      p AS (SELECT list([a, b] ORDER BY day) AS p FROM (SELECT * FROM d WHERE user_id = (SELECT min(user_id) FROM d) ORDER BY day LIMIT 8)),
      f AS (SELECT user_id, list([a, b] ORDER BY day) AS f, list(day ORDER BY day) AS days FROM d GROUP BY 1 HAVING count(*) >= 8),
      g AS (SELECT user_id, days, p, f, len(f) AS m, len(p) AS n FROM f, p),
      s AS (SELECT user_id, 0 AS k, list_transform(range(m + 1), lambda x: 0::DOUBLE) AS before, list_transform(range(m + 1), lambda x: x) AS before_at, ['infinity'::DOUBLE] AS own, [0::BIGINT] AS own_at FROM g
        UNION ALL
        SELECT user_id, k + 1, CASE WHEN last THEN own ELSE before END, CASE WHEN last THEN own_at ELSE before_at END, CASE WHEN last THEN ['infinity'::DOUBLE] ELSE own END, CASE WHEN last THEN [0::BIGINT] ELSE own_at END
        FROM (SELECT user_id, k, before, before_at, (k + 1) % m = 0 AND k + 1 < n * m AS last,
            list_append(own, gap + least(before[j], before[j + 1], own[j])) AS own,
            list_append(own_at, CASE WHEN before[j] <= before[j + 1] AND before[j] <= own[j] THEN before_at[j] WHEN before[j + 1] <= own[j] THEN before_at[j + 1] ELSE own_at[j] END) AS own_at
          FROM (SELECT s.*, m, n, (k % m + 1)::INT AS j, pow(p[k // m + 1][1] - f[k % m + 1][1], 2) + pow(p[k // m + 1][2] - f[k % m + 1][2], 2) AS gap FROM s JOIN g USING (user_id) WHERE k < n * m))),
      r AS (SELECT user_id, days, n, m, own[2:] AS own, own_at[2:] AS own_at FROM s JOIN g USING (user_id) WHERE k = n * m),
      z AS (SELECT user_id, days, m, sqrt(list_min(own)) / n AS cost, list_position(own, list_min(own)) AS stop, own_at[list_position(own, list_min(own))] + 1 AS start FROM r)
      SELECT user_id, round(cost, 6) AS cost, days[start] AS match_start, days[stop] AS match_stop, (stop - start + 1)::BIGINT AS matched FROM z
      WHERE stop - start + 1 >= 2 AND days[start] - days[1] >= 1 AND days[m] - days[stop] >= 1""",
}
