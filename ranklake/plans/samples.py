"""Deterministic samples, splits and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as S
from .registry import query, table

_HASH = "sha256('42:' || {k}::VARCHAR)"


@query("t5_bottom_hash", f"SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format(k='doc_id')}, doc_id) AS n FROM documents) WHERE n <= 5")
def bottom(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_per_group(table(spark, d, "documents").select("source", "doc_id"), ["source"], 5, 42, "doc_id")


@query("t6_sample", f"SELECT o_orderkey FROM orders ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey LIMIT 100")
def sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample(table(spark, d, "orders").select("o_orderkey"), 100, 42, "o_orderkey")


@query(
    "f15_t7_t8_balanced",
    f"WITH l AS (SELECT o_orderkey, (o_totalprice > (SELECT median(o_totalprice) FROM orders))::INT AS label FROM orders) SELECT o_orderkey, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) AS n FROM l) WHERE n <= 50",
)
def balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = S.median_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return S.balanced(rows, "label", 100, 42, "o_orderkey").select("o_orderkey", "label")


@query("t10_w17_hash_order", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) AS place FROM lineitem WHERE l_orderkey % 3 = 0")
def permuted(spark: SparkSession, d: str) -> DataFrame:
    return _permuted(table(spark, d, "lineitem").where("l_orderkey % 3 = 0"))


@query("t10_hash_order_all", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) AS place FROM lineitem")
def permuted_all(spark: SparkSession, d: str) -> DataFrame:
    """Every line's place; ``t10_w17_hash_order`` has a third of the orders."""
    return _permuted(table(spark, d, "lineitem"))


def _permuted(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return lines.select(*keys).withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(S.hash_order(42, *keys))))


@query(
    "w14_interleaved",
    f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_HASH.format(k='doc_id')}, doc_id) AS "round" FROM documents), f AS (SELECT * FROM r ORDER BY "round", lang, source LIMIT 200)
SELECT doc_id, lang, source, "round", row_number() OVER (ORDER BY "round", lang, source) AS turn FROM f""",
)
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    return S.interleaved(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 200, 42, "doc_id")


@query("w15_serpentine", "SELECT i, CASE WHEN i % 2 = 0 THEN j ELSE 4 - j END AS j, i * 5 + j AS place FROM range(4) a(i), range(5) b(j)")
def serpentine(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, j, n) for n, (i, j) in enumerate(S.serpentine(4, 5))], "i long, j long, place long")


@query("w16_cyclic_assignment", f"SELECT n_nationkey, place, ['plain', 'formal', 'brief'][(place % 3 + 1)::BIGINT] AS style FROM (SELECT n_nationkey, row_number() OVER (ORDER BY {_HASH.format(k='n_nationkey')}, n_nationkey) - 1 AS place FROM nation)")
def cyclic(spark: SparkSession, d: str) -> DataFrame:
    return S.assigned_cycle(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", ["plain", "formal", "brief"], 42)


@query(
    "h34_family_split",
    f"""WITH f AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(k='source')}, source) AS n, count(*) OVER (PARTITION BY lang) AS size FROM f)
SELECT doc_id, lang, source, CASE WHEN n <= greatest(1, least(size - 1, round_even(size * 0.7, 0))) THEN 'development' ELSE 'confirmation' END AS split FROM documents JOIN r USING (lang, source)""",
)
def split(spark: SparkSession, d: str) -> DataFrame:
    return S.split_by_hash(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"], "source", 0.7, 42)


@query("w12_turn_index", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations")
def turns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, d, "conversations").select("conv_id", "turn", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("place"))


@query("w13_first_user_turn", "SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_turn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("turn"))


@query(
    "t12_increasing_selection",
    """WITH q AS (SELECT o_custkey, quantile_cont(o_totalprice, 0.271) AS q1, quantile_cont(o_totalprice, 0.533) AS q2, quantile_cont(o_totalprice, 0.787) AS q3 FROM orders GROUP BY o_custkey),
 t AS (SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, c.o_orderkey AS c, abs(a.o_totalprice - q1) + abs(b.o_totalprice - q2) + abs(c.o_totalprice - q3) AS cost FROM orders a JOIN q USING (o_custkey)
 JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice JOIN orders c ON a.o_custkey = c.o_custkey AND b.o_totalprice < c.o_totalprice),
 m AS (SELECT o_custkey, arg_min([a, b, c], cost) AS l FROM t GROUP BY o_custkey) SELECT o_custkey, i - 1 AS step, l[i] AS o_orderkey FROM m, (SELECT unnest([1, 2, 3]) AS i)""",
)
def increasing(spark: SparkSession, d: str) -> DataFrame:
    """For each customer with five orders or more, three of them at increasing prices near three quantiles of the customer (which no two orders are equally near).

    The dynamic programme runs on one customer's orders at a time."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")

    def pick(key, rows):
        import pandas as pd

        rows = rows.sort_values("o_orderkey")
        prices = rows["o_totalprice"].tolist()
        if len(set(prices)) < 3:
            return pd.DataFrame({"o_custkey": [], "step": [], "o_orderkey": []}).astype("int64")
        chosen = S.increasing_selection(prices, rows["o_totalprice"].quantile([0.271, 0.533, 0.787]).tolist())
        return pd.DataFrame({"o_custkey": [key[0]] * 3, "step": range(3), "o_orderkey": rows["o_orderkey"].iloc[chosen].to_numpy()})

    return orders.groupBy("o_custkey").applyInPandas(pick, "o_custkey long, step long, o_orderkey long")


@query("t13_diverse_selection")
def diverse(spark: SparkSession, d: str) -> DataFrame:
    """Ten vectors of each label, near their centroid and far from each other."""
    rows = table(spark, d, "embeddings")

    def pick(key, group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("vec_id").reset_index(drop=True)
        x = np.array(group["embedding"].tolist(), float)
        chosen = S.diverse_selection(np.linalg.norm(x - x.mean(axis=0), axis=1), x, 10)
        return pd.DataFrame({"label": key[0], "place": range(len(chosen)), "vec_id": group["vec_id"].iloc[chosen].to_numpy()})

    return rows.groupBy("label").applyInPandas(pick, "label int, place int, vec_id long")


@query("t14_matched_selection")
def matched(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's lines matched one to one to evenly spaced quantity targets at the least total distance."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")

    def pick(key, rows):
        import pandas as pd

        rows = rows.sort_values(["l_orderkey", "l_partkey", "l_quantity"])
        q = rows["l_quantity"].tolist()
        targets = [50 * (i + 1) / (min(3, len(q)) + 1) for i in range(min(3, len(q)))]
        chosen = S.assignment([[abs(t - x) for x in q] for t in targets])
        return pd.DataFrame({"l_suppkey": key[0], "target": targets, "l_orderkey": rows["l_orderkey"].iloc[chosen].to_numpy()})

    return lines.groupBy("l_suppkey").applyInPandas(pick, "l_suppkey long, target double, l_orderkey long")
