"""Label tasks, strict judgment parsing, audits and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The categories, scales and keys of a judgment.
CATEGORIES = ("information", "criteria", "comparison", "selection", "action", "mixed", "not_applicable")
SCALES = ("information_seeking_1_7", "evaluation_1_7", "selection_commitment_1_7", "action_implementation_1_7")
JUDGMENT = "answer_type string, overall_readiness_0_100 int, " + ", ".join(f"{s} int" for s in SCALES) + ", category string, ambiguity_1_7 int, confidence_0_1 double, brief_reason string"
KEYS = ("answer_type", "overall_readiness_0_100", *SCALES, "category", "ambiguity_1_7", "confidence_0_1", "brief_reason")


def tasks(items: DataFrame, item: str, judges: Sequence[str], version: str = "v1") -> DataFrame:
    """One task for each item and judge slot, with a hashed id and alternating presentation. Judges are a short list."""
    slots = F.explode(F.array(*[F.struct(F.lit(j).alias("judge_slot"), F.lit(i).alias("__i")) for i, j in enumerate(judges)]))
    rows = items.select(F.col(item).alias("item_id"), slots.alias("__s")).select("item_id", "__s.*")
    digest = F.sha2(F.concat_ws(":", F.lit(version), F.col("item_id").cast("string"), "judge_slot"), 256)
    odd = F.conv(F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 1), 16, 10).cast("int")
    return rows.withColumn("task_id", F.concat(F.lit("task:"), F.substring(digest, 1, 24))).withColumn("presentation_variant", F.when((odd + F.col("__i")) % 2 == 0, "low-first").otherwise("high-first")).drop("__i")


def first_object(text: Column) -> Column:
    """The text from the first to the last brace, null without one."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def judgments(df: DataFrame, raw: str, words: int = 25) -> DataFrame:
    """Parses answers to JUDGMENT columns and lists everything that is wrong in ``problems``."""
    out = df.withColumn("__j", first_object(F.col(raw)))
    out = out.withColumn("__p", F.from_json("__j", JUDGMENT)).withColumn("__k", F.json_object_keys("__j"))
    c = {k: F.col(f"__p.{k}") for k in KEYS}
    rating = c["answer_type"] == "rating"
    scores = ("overall_readiness_0_100", *SCALES)
    outside = lambda k, lo, hi: c[k].isNotNull() & ~c[k].between(lo, hi)
    rules = {
        "no-object": F.col("__j").isNull() | F.col("__k").isNull(),
        "wrong-keys": F.col("__k").isNotNull() & (F.array_sort("__k") != F.array(*[F.lit(k) for k in sorted(KEYS)])),
        "answer-type": ~F.coalesce(c["answer_type"].isin("rating", "not_applicable", "dont_know"), F.lit(False)),
        "missing-score": rating & F.greatest(*[c[k].isNull().cast("int") for k in scores]).cast("boolean"),
        "score-of-abstention": ~rating & F.greatest(*[c[k].isNotNull().cast("int") for k in scores]).cast("boolean"),
        "readiness-range": outside("overall_readiness_0_100", 0, 100),
        "scale-range": F.greatest(*[F.coalesce(outside(k, 1, 7), F.lit(False)).cast("int") for k in (*SCALES, "ambiguity_1_7")]).cast("boolean"),
        "confidence-range": ~F.coalesce(c["confidence_0_1"].between(0, 1), F.lit(False)),
        "category": rating & ~F.coalesce(c["category"].isin(*CATEGORIES), F.lit(False)),
        "reason-length": ~F.coalesce(F.size(F.split(F.trim(c["brief_reason"]), r"\s+")).between(1, words) & (F.trim(c["brief_reason"]) != ""), F.lit(False)),
    }
    problems = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]))
    return out.select(*df.columns, *[c[k].alias(k) for k in KEYS], F.when(rules["no-object"], F.array(F.lit("no-object"))).otherwise(problems).alias("problems"))


def collected(tasks_: DataFrame, answers: DataFrame, failures: DataFrame) -> DataFrame:
    """State of each task: answered, failed or missing."""
    a = answers.select("task_id").distinct().withColumn("__a", F.lit(True))
    f = failures.select("task_id").distinct().withColumn("__f", F.lit(True))
    return tasks_.join(a, "task_id", "left").join(f, "task_id", "left").withColumn("state", F.when(F.col("__a"), "answered").when(F.col("__f"), "failed").otherwise("missing")).drop("__a", "__f")


def freeze_audit(items: DataFrame, text: str, digest: str, split: str, group: str, eligible: Column, license_: str) -> DataFrame:
    """One row for each check with its number of offending rows or groups."""
    sums = items.agg(F.count_if(F.sha2(F.coalesce(F.col(text), F.lit("")), 256) != F.col(digest)).alias("digest-differs"), F.count_if(~F.coalesce(eligible, F.lit(False))).alias("not-eligible"), F.count_if(F.coalesce(F.col(license_), F.lit("")) == "").alias("no-license"))
    repeated = items.groupBy(digest).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated-text"))
    leaking = items.groupBy(group).agg(F.countDistinct(split).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("split-group"))
    wide = sums.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(leaking))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in wide.columns])).alias("x")).select("x.*")


def clause_checks(text: Column, low: int = 20, high: int = 400, required: Sequence[str] = (), forbidden: Sequence[str] = ()) -> Column:
    """Labels of the structural rules a clause breaks."""
    n = F.char_length(text)
    rules = [F.when(n < low, F.lit("short")), F.when(n > high, F.lit("long")), F.when(text.rlike(r"(?<![\w.])0?\.\d+|\b\d{1,3}%"), F.lit("leaked-number"))]
    rules += [F.when(~text.rlike(p), F.lit(f"lacks:{p}")) for p in required] + [F.when(text.rlike(p), F.lit(f"has:{p}")) for p in forbidden]
    return F.array_compact(F.array(*rules))


def candidate_binding(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Candidate codes C001.. in order, and the digest of the whole binding."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("candidate", F.concat(F.lit("C"), F.lpad(n.cast("string"), 3, "0")))


def sharded(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Round robin over workers without a global order: the shard of a digest."""
    digest = F.conv(F.substring(F.md5(F.col(order).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("shard", digest % shards)


def panel(queries: DataFrame, styles: Sequence[str], levels: Sequence[float], seed: int) -> DataFrame:
    """Query x style x level rows in a seeded order. Styles and levels are short lists."""
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.lit(float(l)).alias("level")) for s in styles for l in levels]))
    rows = queries.withColumn("__g", grid).select(*queries.columns, "__g.*")
    return rows.withColumn("order_key", F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in rows.columns]), 256))


def first_user_turns(df: DataFrame, turns: str, roles: Sequence[str]) -> Column:
    """Text of the first turn of one of the roles in an array of (role, text)."""
    return F.get(F.filter(turns, lambda t: F.lower(t["role"]).isin(*roles)), F.lit(0))["text"]


def export(items: DataFrame, annotations: DataFrame, policy: DataFrame, item: str = "item_id", source: str = "source_name") -> tuple[DataFrame, DataFrame]:
    """(local, redistributable) label tables: the second only of sources whose policy row allows it. Policies are a list."""
    whole = items.join(annotations, item)
    allowed = whole.join(F.broadcast(policy.select(source, "redistributable")), source, "left").where(F.coalesce("redistributable", F.lit(False))).drop("redistributable")
    return whole, allowed


def batch_responses(requests: DataFrame, responses: DataFrame, digest: str = "prompt_sha256") -> DataFrame:
    """Requests with their response and what is wrong: missing, unknown, repeated, or answered for another prompt."""
    r = responses.groupBy("task_id").agg(F.count(F.lit(1)).alias("__n"), F.first("response").alias("response"), F.first(digest).alias("__d"))
    q = requests.select("task_id", F.col(digest).alias("__q"), F.lit(True).alias("__asked"))
    out = q.join(r, "task_id", "full_outer")
    problem = F.when(F.col("__asked").isNull(), "unknown").when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated").when(~F.col("__q").eqNullSafe(F.col("__d")), "other-prompt")
    return out.select("task_id", "response", problem.alias("problem"))


def calibration_audit(prompts: DataFrame, text: str, key: str, required: Sequence[str] = ()) -> DataFrame:
    """One row: prompts, repeated texts, keys with several texts, extreme lengths, and texts that lack a required pattern."""
    digest = F.sha2(text, 256)
    lacks = [F.count_if(~F.col(text).rlike(p)).alias(f"lacks_{i}") for i, p in enumerate(required)]
    whole = prompts.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(digest).alias("n_texts"), F.min(F.char_length(text)).alias("shortest"), F.max(F.char_length(text)).alias("longest"), *lacks)
    several = prompts.groupBy(key).agg(F.countDistinct(digest).alias("__n")).agg(F.count_if(F.col("__n") > 1).alias("n_keys_with_several"))
    return whole.crossJoin(F.broadcast(several))
