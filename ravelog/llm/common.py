"""Helpers that the corpus operators share: reading, cutting lineage, connected groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; one of our own only where that is unset, as in local tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, plain: Sequence[str] = ()) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: like ``cut``, in less room for wide or repetitive rows.

    ``plain`` names columns whose values hardly repeat; no dictionary is tried on them.
    """
    place = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def free(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64


def small_side(df: DataFrame, size: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most`` bytes, else as it is (a shuffled join, split by AQE where skewed).

    ``size`` is the bytes of a row; narrow rows without arrays are taken for ``ROW_BYTES``
    each. For tables that are cut already, so that the sum reads no more than them.
    """
    total = df.agg(F.coalesce(F.sum(F.lit(ROW_BYTES) if size is None else size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


EDGES_A_TASK = 200_000


def connected(edges: DataFrame) -> DataFrame:
    """``graph.connected`` with ``EDGES_A_TASK`` edges as one task's share."""
    return graph.connected(edges, EDGES_A_TASK)
