"""Readers and writers of the library's file formats. Paths go to Spark's readers alone, so any store works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SERP = "keyword string, position int, title string, url string, snippet string, engines string, score double, engine string, pool int"
RERANK = (
    "run_id string, keyword string, prompt_variant string, llm_model string, engine string, pool int, top_n int, ranked_domains array<string>, "
    "ranked_results array<struct<domain:string,url:string>>, rank_changes array<struct<domain:string,pre_rank:int,post_rank:int,rank_delta:int>>, "
    "used_fallback boolean, error string, llm_parameters struct<max_tokens:int,temperature:double,backend:string,precision:string>"
)
#: Which files of a published data set make up a component.
COMPONENTS = {"main": ("main/*.parquet",), "serp": ("serp/**/*.parquet",), "features": ("features/*.parquet",), "rag": ("rag/chunks/*.parquet", "rag/vectors/*.parquet")}


def read_serp(spark: SparkSession, root: str, engine: str | None = None, pool: int | None = None) -> DataFrame:
    """Result pages partitioned by engine and pool; given values prune partitions."""
    df = spark.read.schema(SERP).parquet(root)
    if engine is not None:
        df = df.where(F.col("engine") == engine)
    return df if pool is None else df.where(F.col("pool") == pool)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | StructType, strict: bool = True) -> DataFrame:
    """Line-wise JSON: strict raises on a broken line, otherwise it is dropped. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_rerank(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return read_jsonl(spark, path, RERANK, strict)


def rank_change_rows(records: DataFrame) -> DataFrame:
    """One row for each ranked domain of the records."""
    return records.select("run_id", "keyword", F.explode_outer("rank_changes").alias("__c")).select("run_id", "keyword", "__c.*")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {serp_results: {keyword: {raw_results: [...], error}}} as rows; a keyword without results but with
    an error gives one error row."""
    result = "struct<position:int,title:string,url:string,snippet:string,engines:array<string>,score:double>"
    schema = f"serp_results map<string, struct<raw_results:array<{result}>,error:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = doc.select(F.explode("serp_results").alias("keyword", "__v"))
    out = rows.select("keyword", F.explode_outer("__v.raw_results").alias("__r"), F.col("__v.error").alias("error")).select("keyword", "__r.*", "error")
    return out.where("url is not null or error is not null").withColumn("engines", F.array_join("engines", "|"))


def read_api_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Organic items of successful tasks of an API's nested answers."""
    item = "struct<type:string,rank_group:int,rank_absolute:int,domain:string,url:string,title:string>"
    schema = f"tasks array<struct<status_code:int,result:array<struct<keyword:string,se_results_count:bigint,items:array<{item}>>>>>"
    tasks = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("tasks").alias("t")).where("t.status_code = 20000")
    results = tasks.select(F.explode("t.result").alias("r"))
    return results.select("r.keyword", "r.se_results_count", F.explode("r.items").alias("i")).select("keyword", "se_results_count", "i.*").where("type = 'organic'").drop("type")


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_instructions(spark: SparkSession, path: str, prefix: str = "row") -> DataFrame:
    """Instruction lines with an id by input order, and whether a context is attached; answers are not read."""
    df = spark.read.schema("instruction string, context string, category string").json(path)
    at = F.row_number().over(_whole().orderBy("__file", "__block"))
    rows = df.withColumns({"__file": F.input_file_name(), "__block": F.monotonically_increasing_id()})
    return rows.select(F.concat(F.lit(f"{prefix}:"), F.lpad((at - 1).cast("string"), 6, "0")).alias("source_record_id"), F.col("instruction").alias("text"), F.col("category").alias("source_category"), (F.trim(F.coalesce("context", F.lit(""))) != "").alias("has_attached_context"))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Different human turns of each pair of dialogues (plain or gzip lines), with their place."""
    df = spark.read.schema("chosen string, rejected string").json(path).withColumn("pair", F.xxhash64("chosen", "rejected"))
    turns = lambda c: F.regexp_extract_all(c, F.lit(r"(?s)Human:\s*(.*?)(?=\s*(?:Assistant:|Human:|$(?!\n)))"), 1)
    both = F.array_distinct(F.filter(F.transform(F.concat(turns("chosen"), turns("rejected")), F.trim), lambda t: t != ""))
    return df.select("pair", F.posexplode(both).alias("turn", "text"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = 1_000_000, mode: str = "overwrite") -> None:
    """zstd Parquet below one folder for each value; Spark's commit protocol makes it appear at once."""
    df.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str | StructType | None = None) -> None:
    write_parquet(read_csv(spark, source, schema), target)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def html_from_files(spark: SparkSession, root: str, urls: DataFrame, url: str = "url", name: str = r"([^/]+)$") -> DataFrame:
    """Page sources from files named by their address's digest; pages without a file have null. ``name`` finds the digest
    in a file's path."""
    from ..functions.urls import page_key

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(F.regexp_extract("path", name, 1).alias("__k"), F.decode("content", "UTF-8").alias("html"))
    return urls.withColumn("__k", page_key(F.col(url))).join(files, "__k", "left").drop("__k")


def dictionary(spark: SparkSession, registry: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """One row for each documented column."""
    return spark.createDataFrame(list(registry), "column string, type string, category string, description string")


def component_of(path):
    """The component a remote file belongs to, null for none."""
    out = F.lit(None).cast("string")
    for name, patterns in COMPONENTS.items():
        for p in patterns:
            regex = "^" + p.replace(".", r"\.").replace("**/", "\0").replace("*", "[^/]*").replace("\0", "(?:.*/)?") + "$"
            out = F.when(path.rlike(regex), name).otherwise(out)
    return out


def read_questions(spark: SparkSession, path: str, probe: str) -> DataFrame:
    """Questions of a payload {items: [...]} with unescaped titles; items without id, title or link are skipped."""
    import html

    owner = "struct<display_name:string,link:string>"
    item = f"struct<question_id:bigint,title:string,link:string,tags:array<string>,creation_date:bigint,score:bigint,content_license:string,owner:{owner}>"
    rows = spark.read.schema(f"items array<{item}>").option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")
    unescape = F.pandas_udf(lambda s: s.map(html.unescape, na_action="ignore"), "string")
    kept = rows.where("question_id is not null and coalesce(title, '') != '' and coalesce(link, '') != ''")
    return kept.withColumn("title", unescape("title")).withColumn("probe_ids", F.array(F.lit(probe)))


def read_strict_objects(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Line-wise JSON in which every line must be an object: any other value raises."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = F.when(F.json_object_keys("value").isNull(), F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))).cast("string")).otherwise(F.col("value"))
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return lines.select(F.from_json(checked, fields, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_run_folders(spark: SparkSession, root: str, schema: str | StructType) -> DataFrame:
    """CSV files of runs below folders named by their run, with the run and its parts as columns."""
    from ..functions.urls import run_parts

    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    run = F.regexp_extract(F.input_file_name(), r"([^/=]+)/[^/]+$", 1)
    return rows.withColumn("run_id", run).withColumns({k: v for k, v in run_parts(F.col("run_id")).items() if k in ("engine", "pool", "top_n")})


def read_snapshots(spark: SparkSession, json_root: str, tsv_root: str, schema: str) -> DataFrame:
    """Rows of JSON lines and of tab-separated files as one table."""
    a = spark.read.schema(schema).json(json_root)
    b = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(tsv_root)
    return a.unionByName(b)


def pack_shards(df: DataFrame, key: str, vector: str, shards: int) -> DataFrame:
    """(shard, npz): compressed NumPy archives of keys and matrix rows, one for each shard of a digest of the key."""
    import pyarrow as pa

    def pack(t: pa.Table) -> pa.Table:
        import io

        import numpy as np

        t = t.sort_by("k")
        out = io.BytesIO()
        np.savez_compressed(out, keys=np.array(t.column("k").to_pylist()), rows=np.array(t.column("v").to_pylist(), np.float64))
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "npz": pa.array([out.getvalue()], pa.binary())})

    rows = df.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.groupBy("shard").applyInArrow(pack, "shard int, npz binary")


def unpack_shards(df: DataFrame, npz: str = "npz") -> DataFrame:
    """(key, vector) of NumPy archives in a binary column; ``binaryFile`` reads such files into ``content``."""
    import pyarrow as pa

    def unpack(batches):
        import io

        import numpy as np

        for b in batches:
            for x in b.column(0):
                z = np.load(io.BytesIO(x.as_py()))
                rows = z["rows"]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(z["keys"], pa.int64()), lists], names=["key", "vector"])

    return df.select(npz).mapInArrow(unpack, "key long, vector array<double>")


def complete_shards(df: DataFrame, shards: int) -> DataFrame:
    """The shards, if all of them are there; otherwise it raises with their number."""
    n = F.countDistinct("shard")
    whole = df.agg(F.when(n != shards, F.raise_error(F.concat(n.cast("string"), F.lit(f" of {shards} shards"))).cast("boolean")).otherwise(F.lit(True)).alias("__whole"))
    return df.crossJoin(F.broadcast(whole)).where("__whole").drop("__whole")


def aligned_matrix(keys: DataFrame, npy: bytes, place: str) -> DataFrame:
    """Rows of a NumPy matrix beside the keys at their places. The matrix is a small fitted object, not a table."""
    import io

    import numpy as np

    m = np.load(io.BytesIO(npy))
    rows = keys.sparkSession.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{place} long, vector array<double>")
    return keys.join(F.broadcast(rows), place)
