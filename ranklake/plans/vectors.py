"""Embedding-space operators over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import latent as L
from .registry import query, table

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_LONG = f"{_E}, x AS (SELECT vec_id, label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM e)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with two measured targets: their first entry, and a bend of the first two beside the third (all have length 1)."""
    rows = table(spark, d, "embeddings")
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return rows.withColumn("first", x(0)).withColumn("bend", 10 * x(0) * x(1) + x(2))


@query("e24_centroids", f"WITH {_LONG} SELECT label, i - 1 AS dimension, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = L.centroid(vectors(spark, d), ["label"], "embedding")
    return rows.select("label", F.posexplode("centroid").alias("dimension", "mean")).select("label", F.col("dimension").cast("long").alias("dimension"), F.round("mean", 6).alias("mean"))


@query(
    "e19_e28_projection",
    f"WITH {_E} SELECT vec_id, round(e[1], 6) AS axis_0, round((e[1] + e[2]) / sqrt(2), 6) AS axis_1, round(sqrt(pow(e[1] - 0.5, 2) + pow((e[1] + e[2]) / sqrt(2) - 0.5, 2)), 6) AS distance FROM e",
)
def projection(spark: SparkSession, d: str) -> DataFrame:
    axes = np.zeros((2, 64))
    axes[0, 0] = axes[1, 0] = axes[1, 1] = 1
    rows = L.project(vectors(spark, d), "embedding", {"axis_0": axes[0], "axis_1": axes[1]})
    far = F.sqrt(F.pow(F.col("axis_0") - 0.5, 2) + F.pow(F.col("axis_1") - 0.5, 2))
    return rows.select("vec_id", F.round("axis_0", 6).alias("axis_0"), F.round("axis_1", 6).alias("axis_1"), F.round(far, 6).alias("distance"))


@query("e1_e3_ridge_map")
def ridge(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("target", F.col("label").cast("double"))
    fit = rows.where("vec_id % 5 != 0")
    out = L.predict(rows.where("vec_id % 5 = 0"), "embedding", L.ridge(fit, "embedding", ["target"], 1.0), ["predicted"])
    return out.select("vec_id", "target", F.round("predicted", 6).alias("predicted"))


@query("e2_e12_map_metrics")
def map_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = L.metrics(ridge(spark, d), "target", "predicted")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query(
    "e12_metrics",
    """WITH r AS (SELECT o_orderstatus, o_totalprice AS t, o_totalprice * 0.9 + o_custkey AS p FROM orders), m AS (SELECT *, avg(t) OVER (PARTITION BY o_orderstatus) AS m FROM r)
SELECT o_orderstatus, count(*) AS n, round(corr(t, p), 6) AS pearson, round((var_pop(t) - avg((t - p) * (t - p))) / var_pop(t), 6) AS r2, round(avg(abs(t - p)), 4) AS mae, round(avg(abs(t - m)), 4) AS baseline_mae FROM m GROUP BY ALL HAVING count(*) >= 3""",
)
def metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").alias("t"), (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("p"))
    return L.metrics(rows, "t", "p", ["o_orderstatus"]).select("o_orderstatus", "n", F.round("pearson", 6).alias("pearson"), F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("baseline_mae", 4).alias("baseline_mae"))


@query("e5_principal_axes")
def axes(spark: SparkSession, d: str) -> DataFrame:
    a, share = L.principal_axes(vectors(spark, d), "embedding", 3)
    return spark.createDataFrame([(i, j, round(float(a[i, j]), 6), round(float(share[i]), 6)) for i in range(len(a)) for j in range(a.shape[1])], "axis int, dimension int, weight double, share double")


@query("e6_e7_procrustes")
def procrustes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)])
    fit = L.procrustes(rows.where("vec_id % 2 = 0"), ["x0", "x1"], ["x2", "x3"])
    out = L.aligned(rows.where("vec_id % 2 = 1"), ["x0", "x1"], fit, ["y0", "y1"])
    return out.select("vec_id", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query(
    "e18_e20_paired_axis",
    f"WITH {_LONG}, p AS (SELECT a.i, avg(b.x - a.x) AS m FROM x a JOIN x b ON a.vec_id + 1 = b.vec_id AND a.i = b.i AND a.vec_id % 2 = 0 GROUP BY a.i) SELECT i - 1 AS dimension, round(m / sqrt((SELECT sum(m * m) FROM p)), 6) AS weight FROM p",
)
def paired_axis(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("end"), "embedding")
    axis = L.paired_axis(rows, "pair", "end", "embedding")
    return axis.select(F.posexplode("axis").alias("dimension", "weight")).select(F.col("dimension").cast("long").alias("dimension"), F.round("weight", 6).alias("weight"))


@query(
    "e22_block_slopes",
    f"""WITH {_LONG}, a AS (SELECT vec_id, label, vec_id % 7 - avg(vec_id % 7) OVER (PARTITION BY label) AS a FROM embeddings), z AS (SELECT x.*, x - avg(x) OVER (PARTITION BY label, i) AS z FROM x)
SELECT i - 1 AS dimension, round(sum(a * z) / sum(a * a), 6) AS slope FROM z JOIN a USING (vec_id) GROUP BY i""",
)
def slopes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("level", F.col("vec_id") % 7)
    return L.block_slopes(rows, "label", "level", "embedding").select(F.col("dimension").cast("long").alias("dimension"), F.round("slope", 6).alias("slope"))


@query(
    "e23_step_geometry",
    f"""WITH {_E}, s AS (SELECT label, vec_id, e, lead(e) OVER w AS n FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)), l AS (SELECT label, sqrt(list_sum(list_transform(list_zip(e, n), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS step FROM s WHERE n IS NOT NULL)
SELECT label, count(*) AS n_steps, round(sum(step), 4) AS path, round(median(step), 6) AS median_step FROM l GROUP BY label""",
)
def geometry(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = vectors(spark, d).withColumn("next", F.lead("embedding").over(w)).where("next is not null")
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = rows.withColumn("step", A.norm(A.minus(wide("next"), wide("embedding"))))
    return rows.groupBy("label").agg(F.count("*").alias("n_steps"), F.round(F.sum("step"), 4).alias("path"), F.round(F.median("step"), 6).alias("median_step"))


@query("e26_quantile_bounds", f"WITH {_E} SELECT label, round(quantile_cont(e[1], 0.05), 6) AS low, round(quantile_cont(e[1], 0.95), 6) AS high FROM e GROUP BY label HAVING count(*) >= 10")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).groupBy("label").agg(F.round(F.percentile("first", F.lit(0.05)), 6).alias("low"), F.round(F.percentile("first", F.lit(0.95)), 6).alias("high"), F.count("*").alias("n")).where("n >= 10").drop("n")


@query("e34_duplicate_groups", "SELECT sha256(lower(trim(text))) AS sha, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.sha2(F.lower(F.trim("text")), 256).alias("sha")).groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "e36_exemplars",
    f"WITH {_E}, r AS (SELECT vec_id, label, round(e[1], 6) AS x, row_number() OVER (PARTITION BY label ORDER BY e[1], vec_id) AS lo, row_number() OVER (PARTITION BY label ORDER BY e[1] DESC, vec_id) AS hi FROM e) SELECT label, vec_id, x, CASE WHEN lo <= 3 THEN 'bottom' ELSE 'top' END AS side FROM r WHERE lo <= 3 OR hi <= 3",
)
def exemplars(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    rows = vectors(spark, d).withColumns({"lo": F.row_number().over(w.orderBy("first", "vec_id")), "hi": F.row_number().over(w.orderBy(F.desc("first"), "vec_id"))})
    return rows.where("lo <= 3 or hi <= 3").select("label", "vec_id", F.round("first", 6).alias("x"), F.when(F.col("lo") <= 3, "bottom").otherwise("top").alias("side"))


@query("e13_e14_bradley_terry")
def strengths(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers compared by the quantities of neighbouring lines of an order, for each flag."""
    a = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("item"), "l_quantity")
    b = a.withColumn("l_linenumber", F.col("l_linenumber") - 1)
    pairs = a.alias("a").join(b.alias("b"), ["l_orderkey", "l_returnflag", "l_linenumber"]).where("a.item != b.item").select("l_returnflag", F.col("a.item").alias("left_id"), F.col("b.item").alias("right_id"), F.when(F.col("a.l_quantity") > F.col("b.l_quantity"), 1.0).when(F.col("a.l_quantity") < F.col("b.l_quantity"), 0.0).otherwise(0.5).alias("score"))
    out = L.calibrated(L.bradley_terry(pairs, ["l_returnflag"], "left_id", "right_id", "score"), ["l_returnflag"], "strength")
    return out.select("l_returnflag", "item", F.round("strength", 6).alias("strength"), F.round("position", 6).alias("position"))


@query(
    "e15_comparison_pairs",
    """WITH g AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS l FROM embeddings), p AS (SELECT a.label, a.vec_id AS left_id, b.vec_id AS right_id, CASE WHEN b.l - a.l = 1 THEN 'neighbour' ELSE 'distant' END AS kind FROM g a JOIN g b ON a.label = b.label AND b.l - a.l IN (1, 3))
SELECT *, false AS swapped FROM p UNION ALL SELECT label, right_id, left_id, kind, true FROM p""",
)
def comparison_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = vectors(spark, d).select("label", "vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("level"))
    return L.comparisons(rows, ["label"], "vec_id", "level")


@query("e9_leave_one_label_out")
def leave_one(spark: SparkSession, d: str) -> DataFrame:
    """A ridge map for each label left out."""
    out = L.metrics(L.leave_one_group_out(vectors(spark, d), "label", "embedding", "bend", 1.0), "bend", "p", ["label"])
    return out.select("label", "n", F.round("mae", 6).alias("mae"))


@query("d34_logistic_probe")
def probe(spark: SparkSession, d: str) -> DataFrame:
    """A logistic probe of a median split on a held-out fifth."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    from ..operators.sampling import median_split

    rows = median_split(vectors(spark, d).drop("label"), "bend").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = LogisticRegression(regParam=0.1, maxIter=50).fit(rows.where("vec_id % 5 != 0"))
    scored = model.transform(rows.where("vec_id % 5 = 0"))
    auc = BinaryClassificationEvaluator().evaluate(scored)
    return scored.agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n")).withColumn("auc", F.lit(round(auc, 6)))
