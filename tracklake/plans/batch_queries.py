"""Epochs of batches over customers and events, one for each way to draw, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklake.operators.batches import STRIDES, sampled_batches
from tracklake.plans.common import EVENTS, events, table


def leaky_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one market segment each, by the segments' shares, with a fifth from the others."""
    return sampled_batches(table(spark, sf_dir, "customer"), "c_custkey", 16, ["c_mktsegment"], leak=0.2, seed="l", epoch=1, replicas=2)


def weighted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one kind of event each, by given weights, with equal numbers from each stratum: user_id mod 3."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(user_id % 3 AS string) AS third")
    return sampled_batches(e, "event_id", 32, ["event_type"], weights={"error": 3.0, "click": 1.0, "none such": 5.0, "view": 0.5}, stratum=["third"], seed="w")


def focal_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one kind of event each, around a drawn day, with a quarter from its other days and a tenth from other kinds."""
    e = events(spark, sf_dir).selectExpr("event_id", "event_type", "cast(floor(hours / 24) AS double) AS day")
    return sampled_batches(e, "event_id", 40, ["event_type"], leak=0.1, hours="day", window=2.0, everywhere=0.25, seed="f", epoch=3)


def balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches from all customers with equal numbers from each market segment."""
    return sampled_batches(table(spark, sf_dir, "customer"), "c_custkey", 60, stratum=["c_mktsegment"], seed="b", replicas=3)


QUERIES = {f.__name__: f for f in (leaky_batches, weighted_batches, focal_batches, balanced_batches)}


def _draw(seed: str, *of: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(f'({c})::VARCHAR' for c in of)}), 1, 12))::BIGINT"


def _sql(base: str, named: str, size: int, replicas: int, key: str, chosen: str, asked: str, order: str = "s, ") -> str:
    """base: rows (key, g, s). chosen: batches with their groups (batch, g). asked: pools (batch, part, first, count, n, gap_at, gap) of the batches c, groups and pools."""
    strides = ", ".join(map(str, STRIDES))
    return f"""WITH {base},
      a AS (SELECT *, row_number() OVER (ORDER BY g, {order}md5('{named}|' || k), k) - 1 AS pos FROM r),
      pools AS (SELECT g, s, min(pos) AS first, count(*) AS n FROM a GROUP BY g, s),
      groups AS (SELECT g, min(first) AS g_first, sum(n)::BIGINT AS g_n FROM pools GROUP BY g),
      tot AS (SELECT count(*) AS total FROM a),
      b AS (SELECT unnest(range(total // {size})) AS batch FROM tot),
      c AS (SELECT batch, g, g_first, g_n FROM ({chosen}) JOIN groups USING (g)),
      asked AS (SELECT * FROM ({asked}) WHERE count > 0 AND n > 0),
      d AS (SELECT *, {_draw(named + "|start", "batch", "part")} % n AS start, [{strides}][{_draw(named + "|stride", "batch", "part")} % {len(STRIDES)} + 1] AS stride, unnest(range(count)) AS slot FROM asked),
      e_ AS (SELECT *, first + CASE WHEN count <= n THEN (start + stride * slot) % n ELSE {_draw(named + "|again", "batch", "part", "slot")} % n END AS p FROM d)
      SELECT batch, (batch % {replicas})::INT AS replica, e_.g AS "group", part, slot, k AS {key} FROM e_ JOIN a ON a.pos = e_.p + CASE WHEN e_.p >= gap_at THEN gap ELSE 0 END"""


def _by_share(named: str) -> str:
    return f"SELECT batch, a.g FROM b, tot JOIN a ON a.pos = {_draw(named + '|group', 'batch')} % total"


def _leaks(size: int, leak: float) -> str:
    return f"SELECT batch, g, 'leak' AS part, 0 AS first, least({int(size * leak)}, total - g_n) AS count, total - g_n AS n, g_first AS gap_at, g_n AS gap FROM c, tot"


SQL = {
    "leaky_batches": _sql("r AS (SELECT c_custkey AS k, coalesce(c_mktsegment, '') AS g, '' AS s FROM customer)", "l|1", 16, 2, "c_custkey", _by_share("l|1"), f"SELECT batch, g, 'primary' AS part, g_first AS first, 13 AS count, g_n AS n, 0 AS gap_at, 0 AS gap FROM c UNION ALL {_leaks(16, 0.2)}"),
    "weighted_batches": _sql(
        "r AS (SELECT event_id AS k, coalesce(event_type, '') AS g, coalesce((user_id % 3)::VARCHAR, '') AS s FROM events)", "w|0", 32, 1, "event_id",
        f"""WITH w AS (SELECT g, w, sum(w) OVER (ORDER BY g) AS upto, sum(w) OVER () AS whole FROM (VALUES ('error', 6::HUGEINT), ('click', 2::HUGEINT), ('view', 1::HUGEINT)) w(g, w) WHERE g IN (SELECT g FROM groups)),
        t AS (SELECT g, ((upto - w) * 281474976710656) // whole AS lo, (upto * 281474976710656) // whole AS hi FROM w)
        SELECT batch, g FROM b JOIN t ON {_draw("w|0|group", "batch")} >= lo AND {_draw("w|0|group", "batch")} < hi""",
        """SELECT batch, c.g, s AS part, first, (CASE WHEN turn < k THEN floor(32 * (1.0::DOUBLE / k)) ELSE 32 - floor(32 * (1.0::DOUBLE / k)) * (k - 1) END)::BIGINT AS count, n, 0 AS gap_at, 0 AS gap
        FROM c JOIN (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) AS turn, count(*) OVER (PARTITION BY g) AS k FROM pools) p ON p.g = c.g""",
    ),
    "focal_batches": _sql(
        f"{EVENTS}, r AS (SELECT event_id AS k, coalesce(event_type, '') AS g, floor(hours / 24)::DOUBLE AS s FROM e)", "f|3", 40, 1, "event_id", _by_share("f|3"),
        f"""WITH h AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY s) AS turn, count(*) OVER (PARTITION BY g) AS k, min(first) OVER w AS f_first, (sum(n) OVER w)::BIGINT AS f_n FROM pools WINDOW w AS (PARTITION BY g ORDER BY s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        f AS (SELECT c.*, f_first, f_n FROM c JOIN h ON h.g = c.g AND h.turn = {_draw("f|3|focal", "batch")} % k + 1)
        SELECT batch, g, 'focal' AS part, f_first AS first, 27 AS count, f_n AS n, 0 AS gap_at, 0 AS gap FROM f
        UNION ALL SELECT batch, g, 'global', g_first, 9, CASE WHEN g_n > f_n THEN g_n - f_n ELSE g_n END, CASE WHEN g_n > f_n THEN f_first ELSE 0 END, CASE WHEN g_n > f_n THEN f_n ELSE 0 END FROM f
        UNION ALL {_leaks(40, 0.1)}""",
    ),
    "balanced_batches": _sql(
        "r AS (SELECT c_custkey AS k, '' AS g, coalesce(c_mktsegment, '') AS s FROM customer)", "b|0", 60, 3, "c_custkey", "SELECT batch, '' AS g FROM b",
        """SELECT batch, c.g, s AS part, first, (CASE WHEN turn < k THEN floor(60 * (1.0::DOUBLE / k)) ELSE 60 - floor(60 * (1.0::DOUBLE / k)) * (k - 1) END)::BIGINT AS count, n, 0 AS gap_at, 0 AS gap
        FROM c JOIN (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) AS turn, count(*) OVER (PARTITION BY g) AS k FROM pools) p ON p.g = c.g""",
    ),
}
