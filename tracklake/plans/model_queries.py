"""Queries with tests and streams; those that SQL can express have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.lineage import new_path
from tracklake.operators import kernel_tests, significance, vectors
from tracklake.operators.batches import STRIDES
from tracklake.plans.common import EVENTS, events, rounded, table
from tracklake.streaming import tracks as stream


def error_rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("f", F.col("event_type") == "error")
    return significance.mann_whitney(e, ["user_id"], "value", "f").drop("p")


def error_rank_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("f", F.col("event_type") == "error")
    return rounded(significance.mann_whitney(e, ["user_id"], "value", "f"), "p")


def step_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = events(spark, sf_dir).withColumn("d", F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("t")))
    return significance.wilcoxon(e, ["user_id"], "d").drop("p")


def high_value_exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"t_": F.col("event_type") == "error", "p_": F.col("value") > 50})
    return rounded(significance.fisher(e, ["user_id"], "t_", "p_"), "p")


def label_mmd_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five labels against the others, all rows."""
    e = table(spark, sf_dir, "embeddings").withColumn("side", F.when(F.col("label") < 5, "low").otherwise("high"))
    found = kernel_tests.mmd_tests(e, [], "side", [("low-high", "low", "high")], "embedding", "vec_id", permutations=50)
    return rounded(found, "bandwidth", "mmd2", "p", "z", "effect", "q")


def mmd_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the rows as batches whose means are taken off; labels mod 3 as conditions, 0 against 1 and 2; two time bins. One bandwidth for a batch and bin, q over all."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "cast(vec_id % 2 AS int) AS half", "cast(label % 3 AS string) AS kind", "cast(vec_id % 50 AS double) AS hours")
    found = kernel_tests.mmd_tests(e, ["half"], "kind", [("0-1", "zero", "1"), ("0-2", "zero", "2")], "embedding", "vec_id", "hours", [0.0, 20.0, 45.0], centre=["half"], aliases={"0": "zero"}, permutations=20)
    return rounded(found, "bandwidth", "mmd2", "p", "z", "effect", "q")


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return rounded(c.select("label", F.posexplode("centre").alias("i", "v")), "v")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream to its present end, counted in windows of a day. A stream takes a folder or a pattern, not a file."""
    schema, out = table(spark, sf_dir, "events").schema, new_path(spark, "windows")
    live = stream.window_counts(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"), "ts", "event_type", "value", "1 day", "30 days")
    q = live.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}-state")
    q.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return rounded(spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "total")


QUERIES = {f.__name__: f for f in (error_rank_tests, error_rank_significance, step_signed_ranks, high_value_exact_tests, label_mmd_significance, mmd_drivers, label_centres, streamed_windows)}



def _mmd_sql(rows: str, scope: str, permutations: int) -> str:
    """rows: x (scope columns, id, first, e), already in comparisons. The labels of a permutation are worked out for each row, the kernel for each pair of rows."""
    number = "('0x' || substr(md5('42|' || b || '|{}'), 1, 12))::BIGINT"
    s = f"{scope}, " * bool(scope) + "comparison"
    return f"""WITH {rows},
      n AS (SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY md5('42|' || id)) - 1 AS pos, count(*) OVER (PARTITION BY {s}) AS total, count(*) FILTER (first) OVER (PARTITION BY {s}) AS n_a FROM x),
      d AS (SELECT {", ".join(f"i.{c}" for c in s.split(", "))}, i.id AS i, j.id AS j, i.pos AS pi, j.pos AS pj, pow(list_distance(i.e, j.e), 2) AS d2 FROM n i JOIN n j USING ({s}) WHERE i.pos < j.pos),
      h AS (SELECT {s}, quantile_cont(d2, 0.5) AS h FROM d WHERE pi < 1000 AND pj < 1000 GROUP BY ALL),
      b AS (SELECT b, [{", ".join(map(str, STRIDES))}][{number.format("stride")} % {len(STRIDES)} + 1] AS stride, {number.format("start")} AS start FROM (SELECT unnest(range({permutations + 1})) AS b)),
      w AS (SELECT {s}, id, b, n_a, total, CASE WHEN b = 0 THEN first ELSE (pos * (stride % total) + start % total) % total < n_a END AS w FROM n, b),
      k AS (SELECT {s}, i, j, exp(-d2 / (2 * h)) AS k FROM d JOIN h USING ({s})),
      m AS (SELECT {s}, wi.b, 2 * sum(CASE WHEN wi.w AND wj.w THEN k ELSE 0 END) / any_value(wi.n_a * (wi.n_a - 1)) + 2 * sum(CASE WHEN NOT wi.w AND NOT wj.w THEN k ELSE 0 END) / any_value((wi.total - wi.n_a) * (wi.total - wi.n_a - 1)) - 2 * sum(CASE WHEN wi.w <> wj.w THEN k ELSE 0 END) / any_value(wi.n_a * (wi.total - wi.n_a)) AS m
        FROM k JOIN w wi USING ({s}) JOIN w wj USING ({s}) WHERE wi.id = k.i AND wj.id = k.j AND wi.b = wj.b GROUP BY {s}, wi.b),
      o AS (SELECT {s}, max(m) FILTER (b = 0) AS o FROM m GROUP BY ALL),
      r AS (SELECT {s}, o AS mmd2, (count(*) FILTER (b > 0 AND m >= o) + 1) / {permutations + 1}::DOUBLE AS p, (o - avg(m) FILTER (b > 0)) / (stddev_pop(m) FILTER (b > 0) + 1e-12) AS z FROM m JOIN o USING ({s}) GROUP BY {s}, o),
      f AS (SELECT *, count(*) OVER (ORDER BY p) AS upto, count(*) OVER () AS of FROM r),
      z AS (SELECT DISTINCT {s}, n_a, total - n_a AS n_b FROM n)
      SELECT {s}, n_a, n_b, round(h, 6) AS bandwidth, round(mmd2, 6) AS mmd2, round(p, 6) AS p, round(z, 6) AS z, round(mmd2 / h, 6) AS effect, round(least(1.0, (SELECT min(g.p * g.of / g.upto) FROM f g WHERE g.p >= f.p)), 6) AS q FROM f JOIN h USING ({s}) JOIN z USING ({s})"""


SQL = {
    "high_value_exact_tests": f"""WITH {EVENTS}, c AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 50) AS a, count(*) FILTER (event_type = 'error' AND value <= 50) AS b, count(*) FILTER (event_type <> 'error' AND value > 50) AS c, count(*) FILTER (event_type <> 'error' AND value <= 50) AS d FROM e GROUP BY 1),
      k AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS k FROM c), l AS (SELECT user_id, a, b, c, d, sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))) AS p FROM k GROUP BY ALL)
      SELECT user_id, a, b, c, d, round(least(1, p), 6) AS p FROM l""",
    "label_mmd_significance": _mmd_sql("x AS (SELECT 'low-high' AS comparison, vec_id AS id, label < 5 AS first, embedding::DOUBLE[] AS e FROM embeddings)", "", 50),
    "mmd_drivers": _mmd_sql("""a AS (SELECT vec_id, vec_id % 2 AS half, label % 3 AS kind, CASE WHEN vec_id % 50 < 20 THEN 0.0 ELSE 20.0 END::DOUBLE AS bin, vec_id % 50 AS hours, embedding::DOUBLE[] AS e FROM embeddings),
      u AS (SELECT vec_id, half, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM a), c AS (SELECT half, i, avg(v) AS c FROM u GROUP BY 1, 2), y AS (SELECT vec_id, list(v - c ORDER BY i) AS e FROM u JOIN c USING (half, i) GROUP BY 1),
      x AS (SELECT half::INT AS half, bin, p AS comparison, vec_id AS id, kind = 0 AS first, y.e FROM a JOIN y USING (vec_id), (VALUES ('0-1', 1), ('0-2', 2)) q(p, other) WHERE hours < 45 AND (kind = 0 OR kind = other))""", "half, bin", 20),
    "error_rank_tests": f"""WITH {EVENTS}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS r FROM e), g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n1, count(*) FILTER (event_type <> 'error') AS n0, sum(r) FILTER (event_type = 'error') AS s FROM r GROUP BY 1)
      SELECT user_id, n1, n0, (s - n1 * (n1 + 1) / 2)::DOUBLE AS u FROM g""",
    "step_signed_ranks": f"""WITH {EVENTS}, d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e), r AS (SELECT user_id, d, rank() OVER (PARTITION BY user_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY user_id, abs(d)) - 1) / 2.0 AS r FROM d WHERE d IS NOT NULL AND d <> 0)
      SELECT user_id, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w FROM r GROUP BY 1""",
    "label_centres": "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, i, round(avg(v), 6) AS v FROM u GROUP BY 1, 2",
    "streamed_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
