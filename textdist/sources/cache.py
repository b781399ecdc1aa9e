"""Results kept under a key of all their parameters, and the metrics table."""

import hashlib
import json

from pyspark.sql import functions as F

METRIC_SCHEMA = "run_id string, step int, name string, value double, note string"
HPARAM_SCHEMA = "run_id string, hparams map<string,string>"


def parameter_key(params):
    """Hash of every parameter, so no two settings share a cache entry."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]


def _stored(spark, path):
    """The table at ``path`` if a finished write is there: Spark leaves ``_SUCCESS`` last."""
    sc = spark.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark)
    return spark.read.parquet(path) if done else None


def materialize(build, spark, root, params, recompute=False):
    """Read the stored result of ``params``; else build, store and read it."""
    path = f"{root}/{parameter_key(params)}"
    stored = None if recompute else _stored(spark, path)
    if stored is None:
        build().write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    return stored


def fill_missing(rows, compute, root, params, keys):
    """Compute only rows whose key the store lacks, append them, return the whole store."""
    spark = rows.sparkSession
    path = f"{root}/{parameter_key(params)}"
    stored = _stored(spark, path)
    rows = rows.dropDuplicates(list(keys))
    todo = rows if stored is None else rows.join(stored.select(*keys), list(keys), "left_anti")
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def metric_rows(spark, run_id, metrics, step=None, note=None):
    rows = [(run_id, step, name, None if value is None else float(value), note) for name, value in metrics.items()]
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def append_metrics(df, path):
    """Add long rows ``(run_id, step, name, value, note)`` to the metrics table."""
    have = set(df.columns)
    full = df
    for field, kind in (("step", "int"), ("note", "string")):
        if field not in have:
            full = full.withColumn(field, F.lit(None).cast(kind))
    full.select("run_id", "step", "name", F.col("value").cast("double"), "note").write.mode("append").parquet(path)


def append_hparams(df, path):
    df.select("run_id", "hparams").write.mode("append").parquet(path)


def read_metrics(spark, path):
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


def metric_maps(metrics):
    """Metrics as one map per run and step."""
    return metrics.where("value is not null").groupBy("run_id", "step").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("metrics"))
