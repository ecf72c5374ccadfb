"""Queries on the index, samples, vectors and scalars, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import text
from tracklake.operators import index, vectors
from tracklake.plans.common import CUSTOMERS, customers, rounded, table


def clamped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 300 - 5).alias("y"), (F.col("p_size") * 6.0).alias("x"))
    return rounded(index.clamp_borders(p, "y", "x", F.lit(280.0), F.lit(290.0), (64, 48)), "y", "x", "y_clamp", "x_clamp")


def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.roots(customers(spark, sf_dir), "c_custkey", "parent")


def lineage_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.branches(customers(spark, sf_dir), "c_custkey", "parent")


def stitched_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a branch's customers in one row of time; shared ancestors come again in each branch."""
    from pyspark.sql import Window

    b = index.branches(customers(spark, sf_dir), "c_custkey", "parent")
    o = b.join(table(spark, sf_dir, "orders"), F.col("node") == F.col("o_custkey"))
    w = Window.partitionBy("leaf").orderBy("position", "o_orderdate", "o_orderkey")
    return o.select("leaf", "o_orderkey", (F.row_number().over(w) - 1).alias("t"))


def index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("empty", F.lit(None).cast("string"))
    return index.problems(rows, ["l_orderkey", "l_partkey", "empty", "absent"], ["l_orderkey", "l_linenumber"])


def capped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.capped_sample(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3, "s1")


def stratified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stratified_sample(table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang"), "lang", "doc_id", 401, "s2")


def split_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", "n_nationkey")
    return index.split_units(n, ["n_regionkey"], "n_nationkey", 0.6, "s3")


def tau_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "region").select("r_regionkey", F.explode(index.tau_weights(1, 6, 2.0)).alias("x"))
    return rounded(t.select("r_regionkey", "x.tau", "x.p"), "p")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 7 + 1).cast("int").alias("t_size"), (F.col("n_regionkey") + 2).cast("int").alias("z_size"))
    return index.windows(n, "t_size", "z_size", 3, 2)


def encoded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.encode_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.component_stats(table(spark, sf_dir, "embeddings"), "embedding"), "mean", "std", "median", "mad")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vectors.standardised(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(z.select("vec_id", vectors.norm("embedding").alias("length"), F.get("embedding", F.lit(0)).alias("first")), "length", "first")


def vector_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.step_distances(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return rounded(s.select("vec_id", "label", "distance"), "distance")


def embedding_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.step_distances(vectors.standardised(table(spark, sf_dir, "embeddings"), "embedding"), ["label"], "vec_id", "embedding")
    return rounded(s.groupBy("label").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.count("*").alias("n")), "mean", "std")


def baseline_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors.distance_from_group(table(spark, sf_dir, "embeddings"), "label", 0, "embedding")
    return rounded(d.select("vec_id", "distance"), "distance")


def knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 100: how many of its three nearest among all vectors share its label."""
    e = table(spark, sf_dir, "embeddings")
    k = vectors.nearest_neighbours(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 3)
    labels = e.select("vec_id", "label")
    j = k.join(labels, "vec_id").join(labels.toDF("neighbour", "n_label"), "neighbour")
    return rounded(j.groupBy("vec_id").agg(F.avg((F.col("label") == F.col("n_label")).cast("double")).alias("accuracy"), F.count("*").alias("n")), "accuracy")


def label_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.mmd2(table(spark, sf_dir, "embeddings"), "label", 1, 2, "vec_id", "embedding"), "bandwidth", "xx", "yy", "xy", "mmd2")


def channel_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("GFP", "Phase3D", "virtual stain", "EX488 EM520", "other"))), (F.col("p_partkey") % 5 + 1).cast("int")), "p_brand").alias("name"))
    return p.select("p_partkey", text.channel_kind(F.col("name")).alias("kind"), text.slug(F.col("name")).alias("slug"), text.digest12(F.col("name")).alias("digest"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", r"^[a-z]+://[^/]*", ""))
    return p.select("page_id", *text.position_parts(F.col("path")), F.size(F.split("url", "/")).alias("n_parts"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.avg(text.safe_ratio(F.col("value"), F.col("k"))).alias("ratio")), "ratio")


def given_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("name", text.first_given(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")), F.col("source")))
    return d.groupBy("name").agg(F.count("*").alias("n"))


def scaled_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return rounded(c.select("c_custkey", text.min_max(F.col("c_acctbal"), F.lit(0.0), F.lit(9000.0)).alias("scaled")), "scaled")


def box_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("box", F.format_string("(%d, %d, %d, %d)", F.col("p_size"), F.col("p_partkey") % 7, F.col("p_size") + 9, F.col("p_partkey") % 11 + 8))
    return p.select("p_partkey", text.bbox_centre(F.col("box")).alias("c")).select("p_partkey", "c.y", "c.x")


QUERIES = {f.__name__: f for f in (
    clamped_parts, lineage_roots, lineage_branches, stitched_lineages, index_problems, capped_orders, stratified_documents, split_nations, tau_probabilities, sliding_windows, encoded_segments, vector_stats,
    vector_norms, vector_steps, embedding_smoothness, baseline_distances, knn_accuracy, label_mmd, channel_kinds, url_parts, event_properties, given_languages, scaled_balances, box_centres,
)}

_BRANCHES = f"RECURSIVE {CUSTOMERS}, walk(leaf, node, up, depth) AS (SELECT c_custkey, c_custkey, parent, 0 FROM c WHERE c_custkey NOT IN (SELECT parent FROM c WHERE parent IS NOT NULL) UNION ALL SELECT leaf, c_custkey, parent, depth + 1 FROM walk JOIN c ON c_custkey = up), b AS (SELECT leaf, max(depth) OVER (PARTITION BY leaf) - depth AS position, node FROM walk)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = "1 - " + _DOT + " / ((sqrt(" + _DOT.format("{0}", "{0}") + ") + 1e-12) * (sqrt(" + _DOT.format("{1}", "{1}") + ") + 1e-12))"
_COMPONENTS = "u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT i, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-10 THEN 1 ELSE stddev_pop(v) END AS std, quantile_cont(v, 0.5) AS median FROM u GROUP BY 1)"
_Z = _COMPONENTS + ", z AS (SELECT vec_id, any_value(label) AS label, list((v - mean) / std ORDER BY u.i) AS e FROM u JOIN s USING (i) GROUP BY 1)"
_STEP = "d AS (SELECT vec_id, label, e, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM {0})"

SQL = {
    "clamped_parts": """WITH p AS (SELECT p_partkey, fmod(p_retailprice, 300) - 5 AS y, p_size * 6.0::DOUBLE AS x FROM part), c AS (SELECT *, greatest(32, least(y, 280 - 32)) AS yc, greatest(24, least(x, 290 - 24)) AS xc FROM p WHERE y >= 0 AND y < 280 AND x >= 0 AND x < 290)
      SELECT p_partkey, round(y, 6) AS y, round(x, 6) AS x, round(yc, 6) AS y_clamp, round(xc, 6) AS x_clamp FROM c WHERE greatest(abs(y - yc), abs(x - xc)) <= 16""",
    "lineage_roots": f"""WITH RECURSIVE {CUSTOMERS}, k AS (SELECT c_custkey, CASE WHEN parent IN (SELECT c_custkey FROM c) THEN parent END AS p FROM c), w(n, root, depth) AS (SELECT c_custkey, c_custkey, 0 FROM k WHERE p IS NULL UNION ALL SELECT c_custkey, root, depth + 1 FROM w JOIN k ON p = n)
      SELECT n AS c_custkey, root, depth FROM w""",
    "lineage_branches": f"WITH {_BRANCHES} SELECT * FROM b",
    "stitched_lineages": f"WITH {_BRANCHES} SELECT leaf, o_orderkey, row_number() OVER (PARTITION BY leaf ORDER BY position, o_orderdate, o_orderkey) - 1 AS t FROM b JOIN orders ON node = o_custkey",
    "index_problems": "SELECT 'missing column' AS problem, 'absent' AS detail UNION ALL SELECT 'all null', 'empty' UNION ALL SELECT 'duplicate key', l_orderkey || '|' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "capped_orders": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('s1|' || o_orderkey), o_orderkey) <= 3",
    "stratified_documents": """WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), q AS (SELECT lang, 401 // k + CASE WHEN i = k THEN 401 - (401 // k) * k ELSE 0 END AS quota FROM l),
      r AS (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY md5('s2|' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents JOIN q USING (lang))
      SELECT lang, doc_id, quota // c + CASE WHEN n <= quota % c THEN 1 ELSE 0 END AS copies FROM r WHERE quota // c + CASE WHEN n <= quota % c THEN 1 ELSE 0 END > 0""",
    "split_nations": """WITH u AS (SELECT DISTINCT n_regionkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('s3|' || n_nationkey), n_nationkey) <= greatest(1, floor(count(*) OVER (PARTITION BY n_regionkey) * 0.6)) THEN 'train' ELSE 'val' END AS split FROM u)
      SELECT n_regionkey, n_nationkey, c_custkey, split FROM customer JOIN s ON c_nationkey = n_nationkey""",
    "tau_probabilities": "WITH t AS (SELECT r_regionkey, tau, exp(-2.0 * (tau - 1) / 5) AS w FROM region, range(1, 7) t(tau)) SELECT r_regionkey, tau, round(w / sum(w) OVER (PARTITION BY r_regionkey), 6) AS p FROM t",
    "sliding_windows": "WITH n AS (SELECT n_nationkey, n_nationkey % 7 + 1 AS t_size, n_regionkey + 2 AS z_size FROM nation), t AS (SELECT *, unnest(range(t_size - 2)) AS t FROM n WHERE t_size >= 3 AND z_size >= 2) SELECT n_nationkey, t_size, z_size, t, unnest(range(z_size - 1)) AS z FROM t",
    "encoded_segments": "SELECT c_mktsegment, c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer",
    "vector_stats": f"WITH {_COMPONENTS} SELECT i, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(any_value(median), 6) AS median, round(quantile_cont(abs(v - median), 0.5), 6) AS mad FROM u JOIN s USING (i) GROUP BY 1",
    "vector_norms": f"WITH {_Z} SELECT vec_id, round(sqrt({_DOT.format('e', 'e')}), 6) AS length, round(e[1], 6) AS first FROM z",
    "vector_steps": f"WITH x AS (SELECT vec_id, label, embedding AS e FROM embeddings), {_STEP.format('x')} SELECT vec_id, label, round({_COS.format('e', 'b')}, 6) AS distance FROM d WHERE b IS NOT NULL",
    "embedding_smoothness": f"WITH {_Z}, {_STEP.format('z')}, c AS (SELECT label, {_COS.format('e', 'b')} AS d FROM d WHERE b IS NOT NULL) SELECT label, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, count(*) AS n FROM c GROUP BY 1",
    "baseline_distances": f"WITH {_COMPONENTS}, m AS (SELECT i, avg(v) AS m FROM u WHERE label = 0 GROUP BY 1), b AS (SELECT list(m ORDER BY i) AS b FROM m) SELECT vec_id, round({_COS.format('embedding', 'b')}, 6) AS distance FROM embeddings, b",
    "knn_accuracy": """WITH p AS (SELECT a.vec_id, a.label, b.label AS n_label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), b.vec_id) AS r
      FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, round(avg((label = n_label)::INT), 6) AS accuracy, count(*) AS n FROM p WHERE r <= 3 GROUP BY 1""",
    "label_mmd": """WITH x AS (SELECT * FROM embeddings WHERE label IN (1, 2)), y AS (SELECT * FROM x ORDER BY md5('h|' || vec_id), vec_id LIMIT 1000),
      h AS (SELECT median(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS h FROM y a JOIN y b ON a.vec_id < b.vec_id), k AS (SELECT a.label AS p, b.label AS q, exp(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / (2 * h)) AS k FROM x a JOIN x b ON a.vec_id <> b.vec_id, h),
      s AS (SELECT avg(k) FILTER (p = 1 AND q = 1) AS xx, avg(k) FILTER (p = 2 AND q = 2) AS yy, avg(k) FILTER (p = 1 AND q = 2) AS xy FROM k) SELECT round(h, 6) AS bandwidth, round(xx, 6) AS xx, round(yy, 6) AS yy, round(xy, 6) AS xy, round(xx + yy - 2 * xy, 6) AS mmd2 FROM s, h""",
    "channel_kinds": """WITH p AS (SELECT p_partkey, ['GFP', 'Phase3D', 'virtual stain', 'EX488 EM520', 'other'][p_partkey % 5 + 1] || ' ' || p_brand AS name FROM part)
      SELECT p_partkey, ['fluorescent', 'label_free', 'virtual', 'filter', 'unknown'][p_partkey % 5 + 1] AS kind, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS slug, left(sha256(name), 12) AS digest FROM p""",
    "url_parts": """WITH p AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/+|/+$', '', 'g'), '/') AS s FROM pages) SELECT page_id, s[1] AS row, s[2] AS col, s[3] AS field, len(string_split(url, '/')) AS n_parts FROM p""",
    "event_properties": "WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, round(avg(CASE WHEN k IS NULL OR k = 0 OR value IS NULL THEN 0 ELSE value / k END), 6) AS ratio FROM e GROUP BY 1",
    "given_languages": "SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'unknown') AS name, count(*) AS n FROM documents GROUP BY 1",
    "scaled_balances": "SELECT c_custkey, round(2 * greatest(0, least(9000, c_acctbal)) / (9000 + 1e-8) - 1, 6) AS scaled FROM customer",
    "box_centres": "SELECT p_partkey, (p_size + p_size + 9) / 2.0 AS y, (p_partkey % 7 + p_partkey % 11 + 8) / 2.0 AS x FROM part",
}
