"""File sinks. Every write is a distributed write into a folder."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from motifspark import constants as K


def save_csv(df, path, mode="error"):
    path = path if path.endswith(".csv") else path + ".csv"
    df.write.mode(mode).option("header", True).csv(path)
    return path


def save_parquet(df, path, partition_by=(), mode="error"):
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def save_pairs(df, key, value, path):
    """``key: value`` lines."""
    df.select(F.concat_ws(": ", F.col(key).cast("string"), F.col(value).cast("string")).alias("line")).write.text(path)
    return path


def wide_matrix(matrix, value, n=K.MOTIF_LENGTH, keys=()):
    """Residue rows in alphabet order, one column per position."""
    g = matrix.groupBy(*keys, "aa").agg(*[F.max(F.when(F.col("pos") == i, F.col(value))).alias(f"#{i}") for i in range(1, n + 1)])
    return g.withColumn("aa_no", F.expr(f"instr('{K.RESIDUES_PHOSPHO}', aa)"))


def save_matrices(pwm, path, kinds=("positive", "suboptimal", "forbidden"), mode="error"):
    """One folder per kind and rule, each with the wide matrix."""
    keys = ["rule_class", "rule_pos"]
    long = pwm.select(*keys, "pos", "aa", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("value")) for k in kinds])).alias("v")).select(*keys, "pos", "aa", "v.*")
    wide = wide_matrix(long, "value", keys=("kind", *keys))
    wide.write.mode(mode).option("header", True).partitionBy("kind", *keys).csv(path)
    return path


def save_model(path, pwm, weights, params, mode="error"):
    """Matrices, position weights and parameters, numbers or texts, as three tables."""
    spark = pwm.sparkSession
    pwm.write.mode(mode).parquet(f"{path}/pwm")
    rows = [(kind, i, float(w)) for kind, ws in weights.items() for i, w in enumerate(ws, start=1)]
    spark.createDataFrame(rows, "kind string, pos int, w double").write.mode(mode).parquet(f"{path}/position_weight")
    rows = [(k, None, v) if isinstance(v, str) else (k, float(v), None) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, value double, text string").write.mode(mode).parquet(f"{path}/model_param")
    return path


def load_model(spark, path):
    """(pwm, weights, params) as written by ``save_model``."""
    weights = {}
    for r in spark.read.parquet(f"{path}/position_weight").orderBy("kind", "pos").collect():
        weights.setdefault(r["kind"], []).append(r["w"])
    params = {r["name"]: r["value"] if r["text"] is None else r["text"] for r in spark.read.parquet(f"{path}/model_param").collect()}
    return spark.read.parquet(f"{path}/pwm"), weights, params


def table_digest(df):
    """Text that stands for the rows of a table, whatever their order and partitions; equal rows count each time."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    whole = [F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
    return "|".join([kinds, *map(str, df.agg(F.count("*"), *whole).first())])


def published(spark, folder, key):
    """Where the model of a key is, or null. A manifest is written after its model, so a listed model is whole."""
    try:
        found = spark.read.schema("key string, model string").json(f"{folder}/manifests/{key}").filter(F.col("key") == key).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found[0]["model"] if found else None


def publish(spark, folder, key, write):
    """Calls ``write`` with a folder of its own for a new model and lists it under the key when it is written."""
    model = f"{folder}/models/{uuid.uuid4().hex}"
    write(model)
    spark.createDataFrame([(key, model)], "key string, model string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifests/{key}")
    return model
