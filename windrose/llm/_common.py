"""Shared plumbing: shared-folder checkpoints, collision-free column names, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StructType

#: Members of one group that a single output row may list; a larger group takes several rows.
PART_ROWS = 100_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The session names it in ``spark.checkpoint.dir``; where nobody did and all runs on one machine (tests), a temporary folder is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="windrose-checkpoint-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``discard`` deletes its files."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of ``df`` that an operator making the columns ``made`` passes on: all but those it replaces."""
    gone = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in gone]


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_ids(df: DataFrame, name: str) -> None:
    """A ``TypeError`` where the ids in ``name`` aren't whole numbers, such as URLs: number them first."""
    kind = df.select(col(name)).schema[0].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")


def mapped(df: DataFrame, run, made: list[tuple[str, str]]) -> DataFrame:
    """``df`` through ``run`` in Arrow batches, which keep its columns in their order and are followed by ``made`` (name, type).

    Columns travel under numbers, so that any names will do, dots included.
    """
    numbers = [f"c{i}" for i in range(len(df.columns))]
    source = df.select(*(col(c).alias(n) for c, n in zip(df.columns, numbers)))
    schema = StructType([*source.schema.fields])
    for name, kind in made:
        schema = schema.add(f"made_{name}", kind)
    return source.mapInArrow(run, schema).toDF(*df.columns, *(name for name, _ in made))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of every node in ``edges`` (u, v: bigint).

    Alternating large-star and small-star steps, which need a number of rounds logarithmic in the
    component's size; every round is a distributed aggregation and a join whose lineage a checkpoint cuts.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
