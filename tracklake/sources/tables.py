"""Reading and writing the library's tables."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.index import CELL_INDEX, conform

#: Fixed columns of a tracking table.
TRACKING = "track_id int, t int, id int, parent_track_id double, parent_id double, z int, y double, x double"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The observation index with its fixed schema; no inference, so columns are pruned and filters reach the files."""
    return spark.read.schema(CELL_INDEX).parquet(path)


def write_index(rows: DataFrame, path: str, partition_by: str | None = "experiment") -> None:
    """Missing columns become null, the others are cast."""
    w = conform(rows).write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def read_tracking(spark: SparkSession, pattern: str) -> DataFrame:
    """Tracking CSVs below folders of one field of view each, with the folder as fov; a folder with several files is an error."""
    rows = spark.read.schema(TRACKING).option("header", True).csv(pattern)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("fov", F.regexp_extract("_file", r"([^/]+/[^/]+/[^/]+)/[^/]+$", 1))
    twice = rows.select("fov", "_file").distinct().groupBy("fov").count().where("count > 1").select("fov").take(3)
    if twice:
        raise ValueError(f"several tracking files in {', '.join(r.fov for r in twice)}")
    return rows.drop("_file").withColumn("parent_track_id", F.when(~F.isnan("parent_track_id"), F.col("parent_track_id")).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_well_labels(spark: SparkSession, folder: str, wells: list[str], suffix: str = "labels") -> DataFrame | None:
    """Tables <well>_<suffix> of the wells that have one, Parquet before CSV, united by name with a well column; None if there are none."""
    out = None
    for well in wells:
        name = f"{folder}/{well.replace('/', '_')}_{suffix}"
        if _exists(spark, f"{name}.parquet"):
            rows = spark.read.parquet(f"{name}.parquet")
        elif _exists(spark, f"{name}.csv"):
            rows = spark.read.option("header", True).csv(f"{name}.csv")
        else:
            continue
        rows = rows.withColumn("well", F.lit(well))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_results(spark: SparkSession, models: dict[str, str], schema: str) -> DataFrame:
    """CSV tables of several models, one after the other, with a model column."""
    out = None
    for model, path in models.items():
        rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no models")
    return out


def available_tasks(spark: SparkSession, path: str, tasks: list[str]) -> list[str]:
    """Which task columns an annotation CSV has, from its header alone."""
    have = set(spark.read.option("header", True).csv(path).columns)
    return [t for t in tasks if t in have]


def collection_tables(spark: SparkSession, collection: dict) -> dict[str, DataFrame]:
    """Experiments, channels and wells of a collection as tables. Names must be unique, intervals not negative."""
    experiments = collection["experiments"]
    names = [e["name"] for e in experiments]
    if len(set(names)) < len(names):
        raise ValueError("experiment names must be unique")
    for e in experiments:
        if e.get("interval_minutes", 0) < 0 or any(not w for w in e.get("perturbation_wells", {}).values()):
            raise ValueError(f"{e['name']}: negative interval or empty list of wells")
    return {
        "experiment": spark.createDataFrame([(e["name"], e["data_path"], float(e.get("interval_minutes", 30)), float(e.get("start_hpi", 0))) for e in experiments], "experiment string, store_path string, interval_minutes double, start_hpi double"),
        "channel": spark.createDataFrame([(e["name"], c["name"], c.get("marker"), c.get("wells", [])) for e in experiments for c in e["channels"]], "experiment string, channel_name string, marker string, wells array<string>"),
        "well": spark.createDataFrame([(e["name"], label, well, i) for e in experiments for i, (label, wells) in enumerate(e.get("perturbation_wells", {}).items()) for well in wells], "experiment string, perturbation string, well string, ord int"),
    }


def merged_config(path: str, _seen: tuple[str, ...] = ()) -> dict:
    """A JSON configuration over its `base`; nested keys are merged, keys with a leading _ dropped, cycles are errors."""
    own = str(PurePosixPath(path))
    if own in _seen:
        raise ValueError(f"{own} is its own base")
    with open(own) as f:
        config = json.load(f)

    def merge(base: dict, over: dict) -> dict:
        return {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in (base | over).items()}

    base = config.pop("base", None)
    if base:
        config = merge(merged_config(str(PurePosixPath(own).parent / base), (*_seen, own)), config)
    return {k: v for k, v in config.items() if not k.startswith("_")}


def upsert_columns(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Replaces or adds new's columns in a stored table, by key; written beside it, then swapped, so a reader sees either."""
    old = spark.read.parquet(path)
    columns = [c for c in new.columns if c not in keys]
    merged = old.drop(*columns).join(new.dropDuplicates(keys), keys, "left")
    staged = f"{path.rstrip('/')}.staged"
    merged.write.mode("overwrite").parquet(staged)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    to, src = jvm.Path(path), jvm.Path(staged)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(src, to):
        raise OSError(f"{staged} can't take the place of {path}")
    spark.catalog.refreshByPath(path)


def markdown(rows: DataFrame, best: dict[str, bool], title: str = "") -> str:
    """A small result table as Markdown; best: metric columns, True where low is good, whose best value is bold."""
    data = rows.collect()  # a report: a row for each model or group
    top = {c: (min if low else max)([r[c] for r in data if r[c] is not None], default=None) for c, low in best.items()}
    cell = lambda r, c: "" if r[c] is None else f"**{r[c]}**" if c in top and r[c] == top[c] else str(r[c])
    lines = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}", *(f"| {' | '.join(cell(r, c) for c in rows.columns)} |" for r in data)]
    return "\n".join([f"## {title}", ""] * bool(title) + lines)
