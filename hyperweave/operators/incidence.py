"""Incidence, degrees, matrix-free Laplacian products, and explicit Laplacians in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperweave import functions as fn


def incidence(edges: DataFrame) -> DataFrame:
    """(edge_id, v, h, w, de) for edges of two members or more."""
    return edges.where(F.size("members") >= 2).select("edge_id", F.explode("members").alias("v"), F.lit(1.0).alias("h"), "w", F.size("members").cast("double").alias("de"))


def edge_table(edges: DataFrame) -> DataFrame:
    return edges.where(F.size("members") >= 2).select("edge_id", "w", F.size("members").cast("double").alias("de"))


def vertex_degrees(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, dv) of every vertex of ``vertices(v)``; isolated ones have 0."""
    return vertices.join(inc.groupBy("v").agg(F.sum(F.col("h") * F.col("w")).alias("dv")), "v", "left").select("v", F.coalesce("dv", F.lit(0.0)).alias("dv"))


def stats(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    of_edges = edge_table(edges).agg(F.count("*").alias("n_hyperedges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("sum_w"))
    return degrees.agg(F.count("*").alias("n_vertices"), F.avg("dv").alias("mean_degree_v")).join(of_edges)


def matvec(inc: DataFrame, degrees: DataFrame, x: DataFrame) -> DataFrame:
    """y = x - Dv^-1/2 H W De^-1 H' Dv^-1/2 x for ``x(v, x)`` as (v, y)."""
    scaled = x.join(degrees, "v").withColumn("root", fn.inverse_root(F.col("dv")))
    sums = inc.join(scaled, "v").groupBy("edge_id").agg(F.sum(F.col("h") * F.col("x") * F.col("root")).alias("s"))
    back = inc.join(sums, "edge_id").groupBy("v").agg(F.sum(F.col("h") * F.col("s") * F.col("w") / F.col("de")).alias("acc"))
    return scaled.join(back, "v", "left").select("v", (F.col("x") - F.coalesce("acc", F.lit(0.0)) * F.col("root")).alias("y"))


def laplacian(inc: DataFrame, degrees: DataFrame) -> DataFrame:
    """(i, j, val) without zeros off the diagonal; pairs within an edge, so for inspection of small inputs."""
    a = inc.select("edge_id", F.col("v").alias("i"), (F.col("h") * F.col("w") / F.col("de")).alias("left"))
    b = inc.select("edge_id", F.col("v").alias("j"), F.col("h").alias("right"))
    product = a.join(b, "edge_id").groupBy("i", "j").agg(F.sum(F.col("left") * F.col("right")).alias("val"))
    root = lambda c: degrees.select(F.col("v").alias(c), fn.inverse_root(F.col("dv")).alias(f"root_{c}"))
    scaled = product.join(root("i"), "i").join(root("j"), "j").select("i", "j", (-F.col("val") * F.col("root_i") * F.col("root_j")).alias("val"))
    return scaled.unionByName(degrees.select(F.col("v").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("val"))).groupBy("i", "j").agg(F.sum("val").alias("val"))


def multiply_coo(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) of a matrix (i, j, val) times ``x(v, x)``; every row of ``x`` has a y, 0 where the matrix has nothing."""
    found = matrix.join(x.select(F.col("v").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    return x.select(F.col("v").alias("i")).join(found, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))


def numbered(vertices: DataFrame) -> DataFrame:
    """(v, idx): each vertex with its place from 0 in order of v. Ranks within ranges of ``v`` plus the sizes of the
    ranges before, a row for each, so no task sorts all."""
    ranged = vertices.select("v", F.floor(F.col("v") / 65536).alias("range"))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    ranked = ranged.select("v", "range", F.row_number().over(Window.partitionBy("range").orderBy("v")).alias("rank"))
    return ranked.join(before, "range").select("v", (F.col("before") + F.col("rank") - 1).cast("long").alias("idx"))


def dense(inc: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidence over vertices 0 .. n-1, (v, idx)): for vertices whose numbers have gaps."""
    numbers = numbered(vertices)
    return inc.join(numbers, "v").drop("v").withColumnRenamed("idx", "v"), numbers


def knn_incidence(mutual: DataFrame) -> DataFrame:
    """Hyperedges around each centre of a mutual neighbour graph (center, neighbor, h): weights in h, w = 1."""
    inc = mutual.select(F.col("center").alias("edge_id"), F.col("neighbor").alias("v"), "h", F.lit(1.0).alias("w"))
    return inc.join(inc.groupBy("edge_id").agg(F.sum("h").alias("de")), "edge_id")


def supra_laplacian(first: DataFrame, second: DataFrame, vertices: DataFrame, n: int, beta: float = 0.5) -> DataFrame:
    """[[L1 + beta I, -beta I], [-beta I, L2 + beta I]] of two layers over vertices 0 .. n-1."""
    v, b, o = F.col("v"), F.lit(float(beta)), F.lit(n)
    entry = lambda i, j, val: vertices.select(i.alias("i"), j.alias("j"), val.alias("val"))
    parts = [first, second.select((F.col("i") + o).alias("i"), (F.col("j") + o).alias("j"), "val"), entry(v, v, b), entry(v + o, v + o, b), entry(v, v + o, -b), entry(v + o, v, -b)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j").agg(F.sum("val").alias("val"))
