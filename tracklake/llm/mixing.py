"""Mixing sources to target weights by Pfair scheduling (operator 2), in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import running
from tracklake.llm.common import if_few, materialize, table

#: Jobs that one array holds at most while slots are given out.
_LEAF = 1024
#: Blocks of a source whose slots and positions are one row.
_CHUNK = 4096

#: A period, or a part of it, slot by slot: of the blocks that are released, the one of the least rank (the earliest deadline) gets the slot.
_EDF = """
aggregate(
  slots,
  struct(jobs AS left, cast(array() AS array<struct<place: bigint, i: bigint, turn: bigint>>) AS done),
  (s, t) -> aggregate(
    array(filter(s.left, x -> x.pos <= t)[0]),
    s,
    (u, p) -> struct(filter(u.left, x -> x.rank <> p.rank) AS left, concat(u.done, array(struct(t AS place, p.i AS i, p.turn AS turn))) AS done)),
  s -> s.done)
"""


def schedule(sources: DataFrame, period: int, leaf: int = _LEAF) -> DataFrame:
    """The slots of one period, earliest deadline first: i, turn, place for sources (i, k), the k adding up to the period.

    Turn j of a source is released at floor(j * period / k) and due by ceil((j + 1) * period / k); equal deadlines go to the lesser i.

    Slots that blocks of earlier deadlines take don't depend on blocks of later ones. So the blocks are halved by deadline, and the
    slots at which the first half has a block waiting are its own; the rest are the second half's. Halves are halved in turn, each
    round in one window over all of them, until at most `leaf` blocks are left together; their slots are given out one by one.
    The first round sorts 2 * period narrow rows in one task; period is some rows for each source, whatever the sources' sizes.
    """
    spark = sources.sparkSession
    jobs = sources.select("i", "k", F.explode(F.expr("sequence(0L, k - 1)")).alias("turn"))
    jobs = jobs.withColumn("rank", F.row_number().over(Window.orderBy(F.expr(f"((turn + 1) * {period} + k - 1) div k"), "i")).cast("long") - 1)
    jobs = jobs.selectExpr("0L AS node", "0 AS is_slot", f"(turn * {period}) div k AS pos", "rank", "i", "turn")
    parts = jobs.union(spark.range(period).selectExpr("0L", "1", "id", "NULL", "NULL", "NULL"))
    size = leaf
    while size < period:
        size *= 2
    while size > leaf:
        size //= 2
        second = F.expr(f"(rank div {size}) % 2")
        # blocks released at a slot come before it; what is served is the slots so far, less those at which none of the first half waited
        w = Window.partitionBy("node").orderBy("pos", "is_slot", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        r = materialize(parts, "mix-halves").withColumn("arrived", F.sum(F.when(second == 0, 1).otherwise(0)).over(w)).withColumn("slots", F.sum("is_slot").over(w))
        r = r.withColumn("served", F.col("slots") + F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("is_slot") == 1, F.col("arrived") - F.col("slots"))).over(w), F.lit(0))))
        taken = F.col("served") - F.lag("served", 1, 0).over(Window.partitionBy("node").orderBy("pos", "is_slot", "rank"))
        parts = r.withColumn("node", F.col("node") * 2 + F.when(F.col("is_slot") == 1, 1 - taken).otherwise(second)).select(*parts.columns)
    whole = parts.groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("is_slot") == 0, F.struct("rank", "pos", "i", "turn")))).alias("jobs"), F.sort_array(F.collect_list(F.when(F.col("is_slot") == 1, F.col("pos")))).alias("slots"))
    # without sources there are slots and no blocks
    return whole.where("size(jobs) > 0").selectExpr(f"inline({_EDF})").select("i", "turn", "place")


def _slots_of_sources(sources: DataFrame, period: int) -> DataFrame:
    """Adds i, the place of a source by its name, and k, its slots in the period, to sources with source_key and share.

    At least one slot each. If lifting the small ones to it asks for more slots than there are, they get theirs first and the others
    share what remains by their weights: from the smallest up, a source whose part of the remaining slots is below one has just one.
    What is left over goes to the largest remainders. The sources, a narrow row each, are sorted in one task.
    """
    everyone = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumns({"i": F.row_number().over(Window.orderBy("source_key")).cast("long") - 1, "total": F.sum("share").over(everyone), "sources": F.count("*").over(everyone)})
    s = s.withColumn("ideal", F.expr(f"if(total > 0, share / total, 1D / sources) * {period}"))
    s = s.withColumn("over", F.sum(F.expr("greatest(1L, cast(floor(ideal) AS bigint))")).over(everyone) > period)
    upwards = Window.orderBy("ideal", "i")
    s = s.withColumns({"ones": F.row_number().over(upwards) - 1, "rest": period - F.coalesce(F.sum("ideal").over(upwards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    s = s.withColumn("small", F.min(F.expr(f"({period} - ones) * ideal < rest")).over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    s = s.withColumns({"ones": F.sum(F.expr("if(small, 1, 0)")).over(everyone), "largest": F.max(F.expr("if(small, ideal, NULL)")).over(everyone), "rest": F.min(F.expr("if(small, rest - ideal, NULL)")).over(everyone)})
    s = s.withColumn("ideal", F.expr(f"CASE WHEN NOT over THEN ideal WHEN ideal <= largest THEN 1D ELSE ({period} - ones) * ideal / coalesce(rest, {period}) END"))
    s = s.withColumn("low", F.expr("greatest(1L, cast(floor(ideal) AS bigint))"))
    s = s.withColumns({"left": period - F.sum("low").over(everyone), "by_rest": F.row_number().over(Window.orderBy(F.floor("ideal") - F.col("ideal"), "i"))})
    s = s.withColumn("k", F.expr("low + if(by_rest <= left, 1, 0)"))
    return s.withColumn("k", F.when(F.sum("k").over(everyone) == period, F.col("k")).otherwise(F.raise_error(F.lit("slots do not add up to the period")).cast("long"))).select(*sources.columns, "i", "k")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block: int = 16, period: int = 1000, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = 100_000) -> DataFrame:
    """Every row of docs with source_key, seq, block, release, deadline, slot, position and on_target.

    A source's rows are put in the order of md5(seed + id), then cut into blocks of `block` rows. Its weight is
    `weights[source]` over their sum (a source without one: 0, so it gets the least share there is), or, without weights, its row count to the
    given power over the sum of these. Weights are rounded to k of `period` slots by largest remainder, at least one slot each;
    if these minimum slots ask for more than the period, they are given first, and the other sources share the rest by their weights.
    Block j of a source is released at slot floor(j * period / k) and due by slot ceil((j + 1) * period / k); each slot
    takes the released block with the earliest deadline. So after any number of slots a source has had less than one
    block more or less than its weight asks for. The schedule repeats itself after `period` slots, so one period is
    computed, and each row finds its slot in it by itself.

    No row is dropped. A source that has run out leaves its later slots empty; position counts the rows before a row and
    closes those gaps. on_target holds as long as no source has run out, that is before the first empty slot, or in it.
    Null sources are a source of their own. Repeated rows and ids each get their own place. Rows with a null id come with the id text ''.
    An empty table gives no rows. Columns of docs that have the name of a new column are replaced; other names are free. A source is sorted in
    buckets of about `bucket_rows` rows, however large it is.
    There may be any number of sources: the period grows with them (four slots a source), its slots are found by halving, and the rows before
    each block are a running sum over ranges of slots. Slots are broadcast only where they are counted as few.
    """
    spark = docs.sparkSession
    new = ["source_key", "seq", "block", "release", "deadline", "slot", "position", "on_target"]
    # the caller's row goes along in one column, so that none of its names can meet one of those below
    own_id, own_source = F.col("row").getField(id_col), F.col("row").getField(source_col)
    key = F.when(own_source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), own_source.cast("string")))
    base = docs.select(F.struct(*docs.columns).alias("row")).select("row", own_id.alias("id"), key.alias("source_key")).withColumn("_order", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))))

    # Places within a source, without sorting a source in one task: rows of the buckets before, then a row's place in its bucket.
    most = base.groupBy("source_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 2
    while most / 16**digits > bucket_rows:
        digits += 1
    base = base.withColumn("_bucket", F.substring("_order", 1, digits))
    counts = base.groupBy("source_key", "_bucket").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("_before", F.sum("n").over(Window.partitionBy("source_key").orderBy("_bucket")) - F.col("n")), "mix-counts")
    sources = counts.groupBy("source_key").agg(F.sum("n").alias("n"))
    period = max(period, 4 * sources.count())
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        given = spark.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in weights.items()], "source_key string, share double")
        sources, share = sources.join(if_few(given), "source_key", "left"), F.coalesce(F.col("share"), F.lit(0.0))
    sources = _slots_of_sources(sources.select("source_key", "n", share.alias("share")), period)
    # the slot at which the first source has run out
    dry = F.min(F.expr(f"((n + {block - 1}) div {block} * {period}) div k")).over(Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sources = materialize(sources.withColumn("dry", dry), "mix-sources")
    slots = materialize(schedule(sources.select("i", "k"), period), "mix-slots")

    # each block's slot, and the rows before it: sources are cut into chunks of blocks first, so that a large one is spread
    blocks = sources.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {block * _CHUNK})"))).repartition("i", "chunk")
    blocks = blocks.withColumn("block", F.explode(F.expr(f"sequence(chunk * {_CHUNK}, least((n - 1) div {block}, (chunk + 1) * {_CHUNK} - 1))")))
    blocks = blocks.withColumns({"turn": F.expr("block % k"), "size": F.expr(f"least({block}, n - block * {block})")}).join(if_few(slots), ["i", "turn"])
    blocks = running(blocks.selectExpr("source_key", "chunk", "k", "dry", "block", f"block div k * {period} + place AS slot", "size"), [], "slot", {"upto": "size"})
    places = blocks.groupBy("source_key", "chunk").agg(F.first("k").alias("k"), F.first("dry").alias("dry"), F.sort_array(F.collect_list(F.struct("block", "slot", (F.col("upto") - F.col("size")).alias("start")))).alias("blocks"))
    places = materialize(places, "mix-places")

    own = Window.partitionBy("source_key", "_bucket").orderBy("_order", "id")
    rows = base.join(counts.select("source_key", "_bucket", "_before"), ["source_key", "_bucket"]).withColumn("seq", F.col("_before") + F.row_number().over(own) - 1)
    rows = rows.withColumn("block", F.expr(f"seq div {block}")).withColumn("chunk", F.expr(f"block div {_CHUNK}")).join(places, ["source_key", "chunk"])
    rows = rows.withColumn("_place", F.expr(f"blocks[cast(block % {_CHUNK} AS int)]")).withColumns({
        "release": F.expr(f"(block * {period}) div k"),
        "deadline": F.expr(f"((block + 1) * {period} + k - 1) div k"),
        "slot": F.col("_place.slot"),
        "position": F.expr(f"_place.start + seq % {block}"),
    }).withColumn("on_target", F.col("slot") <= F.col("dry"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all documents, mixed to the square roots of their sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "seq", "block", "release", "deadline", "slot", "position", "on_target")


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS sk, md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY o, doc_id) - 1 AS seq FROM d),
s AS (SELECT sk, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS share FROM d GROUP BY sk),
c AS (SELECT greatest(1000, 4 * count(*)) AS period, sum(share) AS total FROM s),
w AS (SELECT sk, n, share / total * period AS ideal, row_number() OVER (ORDER BY sk) AS i, period FROM s, c),
v AS (SELECT *, sum(greatest(1, floor(ideal))) OVER () > period AS too_many, row_number() OVER (ORDER BY ideal, i) AS place, coalesce(sum(ideal) OVER (ORDER BY ideal, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
x AS (SELECT *, bool_and((period - place + 1) * ideal < period - before) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS small FROM v),
y AS (SELECT count(*) FILTER (small) AS ones, coalesce(sum(ideal) FILTER (small), 0) AS taken, max(ideal) FILTER (small) AS largest FROM x),
u AS (SELECT sk, n, i, period, CASE WHEN NOT too_many THEN ideal WHEN ones > 0 AND ideal <= largest THEN 1.0 ELSE (period - ones) * ideal / (period - taken) END AS ideal FROM x, y),
l AS (SELECT *, greatest(1, floor(ideal)::BIGINT) AS low, row_number() OVER (ORDER BY -(ideal - floor(ideal)), i) AS by_rest FROM u),
f AS (SELECT *, period - sum(low) OVER () AS rest FROM l),
k AS (SELECT sk, n, i, period, (low + (by_rest <= rest)::INT)::BIGINT AS k FROM f),
a AS (SELECT list(k ORDER BY i) AS ks, any_value(period) AS period FROM k),
sim(t, given, pick) AS (
  SELECT -1::BIGINT, list_transform(ks, lambda x: 0::BIGINT), 0::BIGINT FROM a
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, j: CASE WHEN j = p THEN g + 1 ELSE g END), p
  FROM (SELECT t, given, list_min(list_transform(list_filter(
          list_transform(list_zip(given, ks), lambda x, j: {'j': j, 'r': (x[1] * period) // x[2], 'd': ((x[1] + 1) * period + x[2] - 1) // x[2]}),
          lambda x: x.r <= t + 1), lambda x: x.d * 1000000 + x.j)) % 1000000 AS p
        FROM sim, a WHERE t + 1 < period)),
z AS (SELECT t AS place, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sim WHERE t >= 0),
b AS (SELECT q.*, k.i, k.k, k.n, k.period, q.seq // 16 AS block FROM q JOIN k USING (sk)),
e AS (SELECT b.*, (block * b.period) // b.k AS release, ((block + 1) * b.period + b.k - 1) // b.k AS deadline, (block // b.k) * b.period + place AS slot FROM b JOIN z ON z.i = b.i AND z.turn = b.block % b.k),
dry AS (SELECT min(((n + 15) // 16 * period) // k) AS dry FROM k)
SELECT doc_id, source, seq, block, release::BIGINT AS release, deadline::BIGINT AS deadline, slot, row_number() OVER (ORDER BY slot, seq) - 1 AS position, slot <= dry AS on_target FROM e, dry
"""
