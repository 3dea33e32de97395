"""Graphs as tables: nodes, edges, report, parameters."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fit import Fitted


def nodes_frame(spark: SparkSession, g: Graph) -> DataFrame:
    rows = [(i, [float(v) for v in y], float(m), bool(a)) for i, (y, m, a) in enumerate(zip(g.y, g.mu, g.adjusted))]
    return spark.createDataFrame(rows, "node_id int, y array<double>, mu double, adjusted boolean")


def edges_frame(spark: SparkSession, g: Graph) -> DataFrame:
    rows = [(i, int(a), int(b), float(v), float(n)) for i, ((a, b), v, n) in enumerate(zip(g.edges, g.lam, g.edge_lengths()))]
    return spark.createDataFrame(rows, "edge_id int, src int, dst int, lambda double, len double")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(u, v)`` and ``len`` if there is one, in both directions."""
    more = [c for c in ("len", "lambda") if c in edges.columns]
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), *more).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), *more))


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Writes a fit as four Parquet tables under ``path``."""
    nodes_frame(spark, fitted.graph).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    edges_frame(spark, fitted.graph).coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
    fitted.report_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/report")
    o = {k: v for k, v in asdict(fitted.options).items() if not callable(v)}
    spark.createDataFrame([(json.dumps(o, default=str),)], "params string").write.mode("overwrite").parquet(f"{path}/params")


def load(spark: SparkSession, path: str) -> Graph:
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("node_id").collect()
    edges = spark.read.parquet(f"{path}/edges").orderBy("edge_id").collect()
    return Graph(np.array([r["y"] for r in nodes]), np.array([(r["src"], r["dst"]) for r in edges]), np.array([r["lambda"] for r in edges]), np.array([r["mu"] for r in nodes]), np.array([r["adjusted"] for r in nodes]))
