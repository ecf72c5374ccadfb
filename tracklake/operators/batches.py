"""Training batches drawn from groups, with leaks, strata or a focal time, as one job.

All rows are numbered once, in the order of group, then stratum or hour, then a seeded hash. So what a batch may draw from (a group, a stratum of it, the hours around a
focal one, or all but these) is an interval of numbers, or all but an interval. A batch asks for so many rows of such a pool; each draw is a number, worked out from the seed, the epoch
and the batch alone, and one join on the number brings the rows. No batch or group is held by a task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut, if_few
from tracklake.operators.index import hashed_order


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that are enough for all n below 3e24."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


#: Strides of draws without replacement: the 16 largest primes below 2 ** 40. A prime divides no smaller pool, so its multiples meet every row of the pool once.
STRIDES = [n for n in range(2**40 - 1, 2**40 - 2000, -2) if _is_prime(n)][:16]


def draw(seed: str, *of: Column | str) -> Column:
    """A number below 2 ** 48 that looks random: the first 12 hexadecimal digits of a seeded digest."""
    text = F.concat_ws("|", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in of])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place, from 0, in an order over the whole table. Each range of the order is sorted by itself; what is gathered is one count for each range."""
    r = rows.withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("tie")))
    r = cut(r.repartitionByRange("_o").withColumn("_part", F.spark_partition_id()))
    counts = r.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_o")) - 1
    return r.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_o", "_part", "_before")


def _joined(columns: list[str] | None) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]) if columns else F.lit("")


def sampled_batches(rows: DataFrame, key: str, size: int, group: list[str] | None = None, weights: dict[str, float] | None = None, leak: float = 0.0, stratum: list[str] | None = None, hours: str | None = None, window: float = 2.0, everywhere: float = 0.3, seed: str = "0", epoch: int = 0, replicas: int = 1) -> DataFrame:
    """An epoch of batches: batch, replica, group, part, slot, and the drawn row's key. There are as many batches as whole ones fit the table.

    Each batch draws a group, with replacement: by `weights` (by the group columns' values, joined by /; groups without one are not drawn) or else by its share of the rows.
    int(size * leak) rows come from all other groups (part leak; fewer if there are fewer). The others come from the group:
    with `hours`, from around one of its distinct hours, drawn evenly (part focal: within `window` of it), but for int(n * everywhere) of them from its other hours (part global; from the whole
    group if it has none); else with `stratum` in equal numbers from its strata, the last of which takes what rounding leaves (part: the stratum); else plainly (part primary).
    Without group columns all rows are one group and nothing leaks. A pool that is smaller than what is asked for is drawn from with replacement, others without.

    Seed and epoch decide everything; the replica of a batch is its number modulo replicas. Null values of columns are the text ''; null hours are never focal. A table
    smaller than a batch gives none. Rows with the same key are rows of their own.
    """
    base = rows.select(F.col(key).alias("_key"), _joined(group).alias("_g"), (F.col(hours).cast("double") if hours else _joined(stratum)).alias("_s"))
    named = f"{seed}|{epoch}"
    all_rows = cut(numbered(base, [F.col("_g"), F.col("_s"), hashed_order(named, "_key"), F.col("_key")], "_at"))
    pools = cut(all_rows.groupBy("_g", "_s").agg(F.min("_at").alias("first"), F.count("*").alias("n")))
    groups = pools.groupBy("_g").agg(F.min("first").alias("g_first"), F.sum("n").alias("g_n"))
    total = all_rows.count()
    batches = rows.sparkSession.range(total // size).toDF("batch")

    if not group:
        batches = batches.join(F.broadcast(groups), F.lit(True), "left") if total else batches.withColumns({"_g": F.lit(""), "g_first": F.lit(0), "g_n": F.lit(0)})  # one row
    elif weights is None:
        # a row that is drawn evenly names its group
        batches = batches.withColumn("_at", draw(f"{named}|group", "batch") % total).join(all_rows.select("_at", "_g"), "_at").drop("_at").join(if_few(groups), "_g")
    else:
        there = sorted(r._g for r in groups.where(F.col("_g").isin([g for g, w in weights.items() if w > 0])).select("_g").collect())
        whole, upto, ends = sum(Fraction(weights[g]) for g in there), Fraction(0), []
        for g in there:
            upto += Fraction(weights[g])
            ends.append(int(upto / whole * 2**48))
        u = draw(f"{named}|group", "batch")
        place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= u))
        batches = batches.withColumn("_g", F.element_at(F.array(*map(F.lit, there)), place + 1)).join(if_few(groups), "_g")

    n_leak = int(size * leak) if group else 0
    n = size - n_leak
    pool = lambda part, first, count, n, gap_at=F.lit(0), gap=F.lit(0): F.struct(*[c.cast(t).alias(a) for c, t, a in ((part, "string", "part"), (first, "long", "first"), (count, "long", "count"), (n, "long", "n"), (gap_at, "long", "gap_at"), (gap, "long", "gap"))])
    g_first, g_n = F.col("g_first"), F.col("g_n")
    if hours:
        times = Window.partitionBy("_g").orderBy("_s")
        around = f"OVER (PARTITION BY _g ORDER BY _s RANGE BETWEEN {float(window)!r}D PRECEDING AND {float(window)!r}D FOLLOWING)"
        known = pools.where("_s IS NOT NULL").select("_g", F.row_number().over(times).alias("turn"), F.count("*").over(Window.partitionBy("_g")).alias("of"), F.expr(f"min(first) {around}").alias("f_first"), F.expr(f"sum(n) {around}").alias("f_n"))
        counts = known.groupBy("_g").agg(F.max("of").alias("of"))
        batches = batches.join(if_few(counts), "_g").withColumn("turn", draw(f"{named}|focal", "batch") % F.col("of") + 1).drop("of").join(if_few(known.drop("of")), ["_g", "turn"])
        n_all = int(n * everywhere)
        other = g_n - F.col("f_n")
        asked = F.array(
            pool(F.lit("focal"), F.col("f_first"), F.lit(n - n_all), F.col("f_n")),
            F.when(other > 0, pool(F.lit("global"), g_first, F.lit(n_all), other, F.col("f_first"), F.col("f_n"))).otherwise(pool(F.lit("global"), g_first, F.lit(n_all), g_n)),
        )
        batches = batches.select("batch", "_g", "g_first", "g_n", F.explode(asked).alias("p"))
    elif stratum:
        of = Window.partitionBy("_g")
        strata = pools.select("_g", "_s", "first", "n", F.row_number().over(of.orderBy("_s")).alias("turn"), F.count("*").over(of).alias("of"))
        each = F.floor(F.lit(n) * (1.0 / F.col("of")))
        strata = strata.withColumn("count", F.when(F.col("turn") < F.col("of"), each).otherwise(n - each * (F.col("of") - 1)))
        batches = batches.join(if_few(strata), "_g").select("batch", "_g", "g_first", "g_n", pool(F.col("_s"), F.col("first"), F.col("count"), F.col("n")).alias("p"))
    else:
        batches = batches.select("batch", "_g", "g_first", "g_n", pool(F.lit("primary"), g_first, F.lit(n), g_n).alias("p"))
    if n_leak:
        others = F.lit(total) - g_n
        one = batches.dropDuplicates(["batch"]).select("batch", "_g", "g_first", "g_n", pool(F.lit("leak"), F.lit(0), F.least(F.lit(n_leak), others), others, g_first, g_n).alias("p"))
        batches = batches.unionByName(one)

    asked = batches.select("batch", "_g", "p.*").where("count > 0 AND n > 0")
    who = lambda of: draw(f"{named}|{of}", "batch", "part")
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (who("stride") % len(STRIDES)).cast("int") + 1)
    draws = asked.withColumns({"start": who("start") % F.col("n"), "stride": stride}).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    again = draw(f"{named}|again", "batch", "part", "slot") % F.col("n")
    draws = draws.withColumn("_r", F.when(F.col("count") <= F.col("n"), (F.col("start") + F.col("stride") * F.col("slot")) % F.col("n")).otherwise(again))
    draws = draws.withColumn("_at", F.col("first") + F.col("_r") + F.when(F.col("first") + F.col("_r") >= F.col("gap_at"), F.col("gap")).otherwise(0))
    out = draws.join(all_rows.select("_at", "_key"), "_at")
    return out.select("batch", (F.col("batch") % replicas).cast("int").alias("replica"), F.col("_g").alias("group"), "part", "slot", F.col("_key").alias(key))
