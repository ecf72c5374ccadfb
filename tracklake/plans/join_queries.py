"""Queries that join, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import joins
from tracklake.plans.common import EVENTS, events, rounded, table


def annotated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return joins.enrich(d, table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"], ["quality", "toxic", "lang"])


def annotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated_documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("matched"), 1)).alias("n_matched"), F.count("toxic").alias("n_toxic_known"))


def nearest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part the other-brand part of equal size that is nearest in price and key order, within 50."""
    p = table(spark, sf_dir, "part")
    a = p.select("p_size", "p_partkey", F.col("p_retailprice").alias("y"), (F.col("p_partkey") / 10.0).alias("x"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50 + 1).cast("int").alias("p_size"), (F.col("s_acctbal") / 5 + 1000).alias("y"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_suppkey").alias("supplier"))
    return rounded(joins.nearest(a, s, ["p_size"], "p_partkey", "y", "x", "supplier", 200.0).select("p_partkey", "distance", "supplier"), "distance")


def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "t", "event_id", "value")
    return joins.temporal_pairs(e, ["user_id"], "t", 3, ["event_id", "value"])


def valid_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_type", "t", "event_id")
    return joins.valid_anchors(e, ["user_id", "event_type"], "t", -1, 2)


def group_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return joins.group_anchors(o, ["o_custkey", "o_orderpriority"])


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("scope", F.col("user_id") % 4).select("scope", "user_id", "t")
    return joins.negatives(e, e, ["scope"], "user_id", "t", 2, "n1")


def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("o"))
    return joins.first_match(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), lookup, "c_custkey", "label", "o")


def channels_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("scope"), F.col("n_name").alias("well"))
    channels = spark.createDataFrame([(s, c, w) for s in range(5) for c, w in (("phase", []), ("gfp", ["NATION_1", "NATION_7", "NATION_13"]))], "scope int, channel string, wells array<string>")
    return joins.per_channel(rows, channels, "scope", "well", "wells")


def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_quantity > 49").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n_large"))
    b = li.where("l_discount > 0.09").groupBy("l_partkey", "l_linenumber").agg(F.max("l_tax").alias("top_tax"))
    return joins.merge_metrics(a, b, ["l_partkey", "l_linenumber"])


def folded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_type")
    return joins.folded_lookup(table(spark, sf_dir, "customer").select("c_custkey"), seen, "c_custkey", "event_type", "states")


def part_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("brass", "metal", 1), ("steel", "metal", 2), ("PROMO", "offer", 3), ("small", "size", 4), ("standard", "plain", 5)], "alias string, marker string, ord int")
    return joins.alias_match(table(spark, sf_dir, "part").select("p_partkey", "p_type"), aliases, "p_type", "alias", "marker", "ord")


def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as positions: known ones are the shipped, wells are customers, templates are customers with a positive balance."""
    paths = table(spark, sf_dir, "orders").select(F.lit("d").alias("dataset"), F.col("o_custkey").alias("well"), F.col("o_orderkey").alias("fov"))
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 48").groupBy(F.col("l_orderkey").alias("fov")).agg(F.min("l_returnflag").alias("state")).withColumn("dataset", F.lit("d"))
    base = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit("d").alias("dataset"), F.col("c_custkey").alias("well"), F.col("c_mktsegment").alias("state"))
    return joins.register(paths, known, base, "dataset", "fov", "well", ["state"])


def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    spans = e.groupBy("user_id").agg(F.min("t").alias("before"), F.max("t").alias("after"))
    on = e.where("event_type = 'error' AND value > 60").select("user_id", F.col("t").alias("t_on"), (F.col("t") + 2).alias("t_off"))
    return joins.spine_labels(spans, on, ["user_id"], "before", "after")


def pairwise_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return joins.pairwise(g, ["lang"], "source", ["n"])


def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_quantity > 45").select("l_partkey"))


def unsold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey").exceptAll(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct())


def all_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(joins.matches_any("source", ["src1", "src7"]))
    return joins.labelled(d, "lang", ("", "unknown", "de")).select("doc_id", "lang", "source")


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(j.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count_distinct("o_orderkey").alias("orders")), "revenue", digits=2)


def latest_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event the last error of the same track before it (an as-of join, as a window)."""
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, sf_dir)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), True).over(w).alias("error_id"))


QUERIES = {f.__name__: f for f in (
    annotated_documents, annotation_coverage, nearest_price, temporal_pairs, valid_anchors, group_anchors, negatives, first_matches, channels_per_track, merged_metrics, folded_states, part_markers,
    registration, interval_labels, pairwise_sources, missing_labels, shared_parts, unsold_parts, all_actors, labelled_documents, nation_revenue, latest_error,
)}

_ENRICHED = "j AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS r FROM labels) WHERE r = 1) l USING (doc_id))"

SQL = {
    "annotated_documents": f"WITH {_ENRICHED} SELECT * FROM j",
    "annotation_coverage": f"WITH {_ENRICHED} SELECT source, count(*) AS n, count(*) FILTER (matched) AS n_matched, count(toxic) AS n_toxic_known FROM j GROUP BY 1",
    "nearest_price": """WITH s AS (SELECT s_suppkey % 50 + 1 AS z, s_acctbal / 5 + 1000 AS y, s_suppkey::DOUBLE AS x, s_suppkey FROM supplier), d AS (SELECT p_partkey, s_suppkey, greatest(abs(p_retailprice - y), abs(p_partkey / 10.0::DOUBLE - x)) AS d FROM part JOIN s ON p_size = z),
      r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, s_suppkey) AS r FROM d WHERE d <= 200) SELECT p_partkey, round(d, 6) AS distance, s_suppkey AS supplier FROM part LEFT JOIN r USING (p_partkey) WHERE r IS NULL OR r = 1""",
    "temporal_pairs": f"WITH {EVENTS} SELECT a.user_id, a.t, a.event_id, a.value, b.event_id AS next_event_id, b.value AS next_value FROM e a JOIN e b ON a.user_id = b.user_id AND b.t = a.t + 3",
    "valid_anchors": f"WITH {EVENTS} SELECT user_id, event_type, t, event_id FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.t BETWEEN a.t - 1 AND a.t + 2 AND b.t <> a.t)",
    "group_anchors": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) >= 2",
    "negatives": f"""WITH {EVENTS}, r AS (SELECT user_id % 4 AS scope, user_id, t, row_number() OVER (PARTITION BY user_id % 4, t ORDER BY md5('n1' || user_id::VARCHAR), user_id) AS i, count(*) OVER (PARTITION BY user_id % 4, t) AS n FROM e),
      a AS (SELECT x.scope, x.user_id, x.t, CASE WHEN r.i IS NULL THEN 1 ELSE r.i % r.n + 1 END AS pick FROM r x LEFT JOIN r ON r.scope = x.scope AND r.t = x.t + 2 AND r.user_id = x.user_id)
      SELECT a.scope, a.user_id, a.t, r.user_id AS negative FROM a JOIN r ON r.scope = a.scope AND r.t = a.t + 2 AND r.i = a.pick WHERE r.user_id <> a.user_id""",
    "first_matches": "SELECT c_custkey, c_mktsegment, coalesce((SELECT arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'unknown') AS label FROM customer",
    "channels_per_track": """SELECT c_custkey, n_regionkey AS scope, n_name AS well, channel FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('phase'), ('gfp')) t(channel) WHERE channel = 'phase' OR n_name IN ('NATION_1', 'NATION_7', 'NATION_13')""",
    "merged_metrics": """WITH a AS (SELECT l_partkey, l_linenumber, count(*) AS n_large FROM lineitem WHERE l_quantity > 49 GROUP BY 1, 2), b AS (SELECT l_partkey, l_linenumber, max(l_tax) AS top_tax FROM lineitem WHERE l_discount > 0.09 GROUP BY 1, 2)
      SELECT l_partkey, l_linenumber, n_large, top_tax FROM a FULL JOIN b USING (l_partkey, l_linenumber)""",
    "folded_states": "WITH f AS (SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS s FROM events GROUP BY 1) SELECT c_custkey, coalesce(s, '') AS states, s IS NOT NULL AS has_states FROM customer LEFT JOIN f ON user_id = c_custkey",
    "part_markers": """SELECT p_partkey, p_type, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'promo') THEN 'offer' WHEN contains(lower(p_type), 'small') THEN 'size' WHEN contains(lower(p_type), 'standard') THEN 'plain' END AS marker FROM part""",
    "registration": """WITH k AS (SELECT l_orderkey, min(l_returnflag) AS s FROM lineitem WHERE l_quantity > 48 GROUP BY 1) SELECT 'd' AS dataset, o_custkey AS well, o_orderkey AS fov, CASE WHEN k.l_orderkey IS NOT NULL THEN 'updated' WHEN c_custkey IS NOT NULL THEN 'created' ELSE 'unmatched' END AS action,
      coalesce(k.s, CASE WHEN k.l_orderkey IS NULL THEN c_mktsegment END) AS state FROM orders LEFT JOIN k ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
    "interval_labels": f"""WITH {EVENTS}, i AS (SELECT user_id, t AS t_on, t + 2 AS t_off FROM e WHERE event_type = 'error' AND value > 60), s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1), p AS (SELECT user_id, unnest(range(a, b + 1)) AS t FROM s)
      SELECT user_id, t, CASE WHEN NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = p.user_id) THEN '' WHEN EXISTS (SELECT 1 FROM i WHERE i.user_id = p.user_id AND p.t BETWEEN t_on AND t_off) THEN 'positive' ELSE 'negative' END AS label FROM p""",
    "pairwise_sources": "WITH g AS (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2) SELECT a.lang, a.source AS source_a, a.n AS n_a, b.source AS source_b, b.n AS n_b FROM g a JOIN g b ON a.lang = b.lang AND a.source < b.source",
    "missing_labels": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "shared_parts": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "unsold_parts": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40",
    "all_actors": "SELECT c_custkey AS key, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    "labelled_documents": "SELECT doc_id, lang, source FROM documents WHERE (contains(source, 'src1') OR contains(source, 'src7')) AND lang IS NOT NULL AND lang NOT IN ('', 'unknown', 'de')",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "latest_error": f"WITH {EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_id FROM e",
}
