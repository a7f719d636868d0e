"""Settled intermediate results, and the index as Parquet tables."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyze
from ..operators import lexical, scoring


def settled(df: DataFrame) -> DataFrame:
    """Computed once, with lineage cut: providers must not be asked again by later branches. Uses spark.checkpoint.dir where it is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="evigrain-"))
    return df.checkpoint()


def work_folder(spark: SparkSession) -> str:
    """A new name in the folder of the checkpoints, which the driver and all executors share."""
    settled(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"


Analyser = Callable[[Column], Column]


@dataclass(frozen=True)
class Index:
    """``chunks``: chunk records, plus ``terms`` unless the analyser's are those of ``text``; ``vectors`` (chunk_id, source_id, vector) or None; ``analyser``: how their terms were made, and a query's are; ``lexical``: stored postings, or None."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    analyser: Analyser = lexical.plain_terms
    lexical: lexical.Postings | None = None


class BuildError(ValueError):
    """The index can't be built from these chunks."""


#: Analysers that a stored index can name.
ANALYSERS: dict[str, Analyser] = {"plain": lexical.plain_terms, "porter": analyze.analyze}
SHELVES = 64


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions under ``path``, the newest last. A version is complete when its last table is."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().startswith("v"))
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/about/_SUCCESS"))
    return [n for n in names if done(n)]


def write_index(index: Index, path: str) -> dict[str, int | str]:
    """Writes a new version of the index beside the older ones, which readers keep until it is complete.

    Tables are partitioned by source so that a source filter prunes files; postings (term, chunk, count, length) and
    the number of chunks that hold each term, by a hash of the term, so that a query's terms do.
    """
    spark = index.chunks.sparkSession
    n = index.chunks.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids")).first()
    if not n["n"] or n["n"] != n["ids"]:
        raise BuildError("an index needs chunks, each with an id of its own")
    name = next((k for k, f in ANALYSERS.items() if f is index.analyser), None)
    if name is None:
        raise BuildError(f"a stored index names its analyser, one of {', '.join(ANALYSERS)}")
    mode = "lexical" if index.vectors is None else "hybrid"
    own = f"{path}/v{time.time_ns():020d}"
    index.chunks.write.partitionBy("source_id").parquet(f"{own}/chunks")
    if index.vectors is not None:
        index.vectors.write.partitionBy("source_id").parquet(f"{own}/vectors")
    made = scoring.counted(spark.read.schema(index.chunks.schema).parquet(f"{own}/chunks"), "chunk_id", index.analyser)
    shelf = F.pmod(F.xxhash64("term"), F.lit(SHELVES)).cast("int").alias("shelf")
    # Rebalanced: tasks and files of an even size, however large the corpus, and few files for each shelf.
    made.select("*", shelf).hint("rebalance", F.col("shelf")).sortWithinPartitions("shelf", "term").write.partitionBy("shelf").parquet(f"{own}/postings")
    # df and lengths from the stored postings: the texts are cut once
    stored = spark.read.parquet(f"{own}/postings")
    stored.groupBy("shelf", "term").agg(F.count("*").alias("df")).hint("rebalance", F.col("shelf")).sortWithinPartitions("shelf").write.partitionBy("shelf").parquet(f"{own}/terms")
    stats = stored.agg((F.coalesce(F.sum("tf"), F.lit(0)) / n["n"]).alias("avgdl")).select(F.lit(n["n"]).cast("long").alias("n_docs"), "avgdl")
    about = stats.select("n_docs", "avgdl", F.lit(name).alias("analyser"), F.lit(mode).alias("mode"))
    about.coalesce(1).write.parquet(f"{own}/about")
    return {"chunk_count": n["n"], "mode": mode}


def read_index(spark: SparkSession, path: str, with_vectors: bool = False) -> Index:
    """The newest complete version."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no complete index under {path}")
    own = f"{path}/{found[-1]}"
    about = spark.read.parquet(f"{own}/about")
    stored = lexical.Postings(spark.read.parquet(f"{own}/postings"), spark.read.parquet(f"{own}/terms"), about.select("n_docs", "avgdl"), SHELVES)
    vectors = spark.read.parquet(f"{own}/vectors") if with_vectors else None
    return Index(spark.read.parquet(f"{own}/chunks"), vectors, ANALYSERS[about.first()["analyser"]], stored)
