"""Record kinds with explicit schemas, scans, and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import strip

#: Record kinds; never inferred.
SCHEMAS = {
    "pair": "instruction string, input string, output string, metadata map<string,string>",
    "synthetic_pair": "instruction string, input string, output string, metadata struct<synthetic:boolean,mode:string,replacement_ratio:double>",
    "entry": "word string, character string, GX string, GHC string, LFW string, explanationEN string, explanationCN string",
    "prediction": "input string, reference string, prediction string, method string, glosses string, model string, prompt_variant string, raw_response string, notes string",
    "nbest": "input string, reference string, candidates array<string>, method string",
    "preference": "prompt string, chosen string, rejected string, chosen_reward double, rejected_reward double",
    "judged": "input string, reference string, prediction string, method string, reference_agreement int, source_faithfulness int, title_style_fitness int, overall int, reasoning string",
    "inscription": "RubbingName string, RecordUtilSentenceGroupVoList array<struct<GroupCategory:string,RecordUtilOracleCharVoList:array<struct<OrderNumber:long,Label:string>>>>",
    "embedding": "id long, key string, embedding array<float>",
    "metrics": "lexical_coverage struct<mean:double,min:double,max:double>, perplexity struct<mean:double,min:double,max:double>, chrf struct<corpus:double,mean:double>, llm_judge struct<overall:double>, num_examples long",
}


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of several places that exists, in any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def jsonl(spark: SparkSession, path: str | Sequence[str], kind: str, strict: bool = False) -> DataFrame:
    """One record a line. Blank lines are skipped, or, if strict, an error."""
    if not strict:
        return spark.read.schema(SCHEMAS[kind]).json(path)
    lines = spark.read.text(path)
    checked = lines.select(F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", SCHEMAS[kind], {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str, kind: str, strict: bool = False) -> DataFrame:
    """A file that is one array of records. If strict, a file that is none, or holds a record of another shape, is an error."""
    if not strict:
        return spark.read.schema(SCHEMAS[kind]).json(path, multiLine=True)
    whole = spark.read.text(path, wholetext=True)
    checked = F.when(F.col("value").rlike(r"^\s*\[") & F.col("value").rlike(r"\]\s*$"), F.col("value")).otherwise(F.raise_error(F.lit("the file is no array of records")))
    records = F.from_json(checked, f"array<struct<{SCHEMAS[kind]}>>", {"mode": "FAILFAST"})
    return whole.select(F.explode(records).alias("r")).select("r.*")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a file that is one object."""
    return entries_of(spark.read.text(path, wholetext=True), "value")


def entries_of(df: DataFrame, column: str, *keep: str, values: str = "string") -> DataFrame:
    """keep, key, value of a column that holds a JSON object."""
    return df.select(*keep, F.explode(F.from_json(column, f"map<string,{values}>")).alias("key", "value"))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with row_idx from 0 by order, ties in any order: files have no rows' order in Spark, so it is made once, at ingest.

    Rows are dealt into ranges of order, written once, and numbered within each; what the ranges before hold is a row a partition.
    """
    ranges = materialised(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(F.lit(0)).orderBy("__range")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", (F.sum("__n").over(before) - F.col("__n")).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(sizes), "__range").withColumn("row_idx", F.col("__base") + place - 1).drop("__range", "__base")


def systems(frames: dict[str, DataFrame]) -> DataFrame:
    """Several systems' rows as one frame with system."""
    out = None
    for name, df in frames.items():
        own = df.withColumn("system", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def discovered(spark: SparkSession, pattern: str, kind: str = "metrics") -> DataFrame:
    """Records of all files of a glob, with experiment: the folder's name."""
    df = spark.read.schema(SCHEMAS[kind]).json(pattern, multiLine=True)
    return df.withColumn("experiment", F.element_at(F.split("_metadata.file_path", "/"), -2))


def mismatches(left: DataFrame, right: DataFrame, key: str = "row_idx", column: str = "input") -> DataFrame:
    """Rows that keep two aligned files from being joined: a missing partner or another input. Must be empty."""
    joined = left.select(key, F.col(column).alias("l")).join(right.select(key, F.col(column).alias("r")), key, "full")
    return joined.where(~F.col("l").eqNullSafe(F.col("r")))


def rows_of_html(html: Column | str) -> Column:
    """Texts of the fixed shape <p class="...">...</p>, or <p>...</p>, entities kept."""
    found = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")


def records_of_html(html: Column | str, cells: Mapping[str, tuple[str, bool]], row: str = "tr") -> Column:
    """array<struct> of the rows of a page: each cell is the text of the row's first <p> of a class, (class, required); a row that lacks a
    required one, or has it empty, is none; others are empty strings. Tags inside are dropped, entities kept."""
    rows = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(rf"(?is)<{row}\b[^>]*>(.*?)</{row}>"), F.lit(1))
    text = lambda r, c: strip(F.regexp_replace(F.regexp_extract(r, rf'(?is)<p\b[^>]*class="(?:[^"]*\s)?{c}(?:\s[^"]*)?"[^>]*>(.*?)</p>', 1), "<[^>]+>", ""))
    found = F.transform(rows, lambda r: F.struct(*(text(r, c).alias(name) for name, (c, _) in cells.items())))
    needed = [name for name, (_, required) in cells.items() if required]
    return F.filter(found, lambda s: reduce(lambda a, b: a & b, [s[n] != "" for n in needed], F.lit(True)))


def inscriptions(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, category, pos, label of a column with JSON of kind inscription: groups, then their characters in order."""
    groups = df.select(key, F.explode(F.from_json(column, SCHEMAS["inscription"])["RecordUtilSentenceGroupVoList"]).alias("g"))
    return groups.select(key, F.col("g.GroupCategory").alias("category"), F.explode("g.RecordUtilOracleCharVoList").alias("c")).select(key, "category", F.col("c.OrderNumber").alias("pos"), F.col("c.Label").alias("label"))


def registered(spark: SparkSession, specs: Sequence[str], kind: str) -> DataFrame:
    """Several NAME=PATH sources of JSON lines as one frame with system; a later one of a name replaces an earlier one."""
    paths: dict[str, str] = {}
    for spec in specs:
        name, eq, path = spec.partition("=")
        if not (name and eq and path):
            raise ValueError(f"not NAME=PATH: {spec}")
        paths[name] = path
    return systems({name: jsonl(spark, path, kind) for name, path in paths.items()})


def write_vectors(df: DataFrame, path: str) -> None:
    """A vector index as a table (id, key, embedding), in the order of ids within files."""
    df.selectExpr("CAST(id AS bigint) AS id", "CAST(key AS string) AS key", "CAST(embedding AS array<float>) AS embedding").sortWithinPartitions("id").write.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """With a header; nothing is written, and the answer is false, if there are no rows."""
    if df.isEmpty():
        return False
    df.write.csv(path, header=True)
    return True


def document(df: DataFrame) -> DataFrame:
    """All rows as one JSON array, for small result tables."""
    return df.select(F.struct("*").alias("r")).agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("json"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, gone when the driver ends; with a local master and none set, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/loomspark-files"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return place.toString()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to a folder that all executors share: what follows starts from the files, not from df's lineage."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unfinished(df: DataFrame, done: DataFrame, key: str = "input") -> DataFrame:
    """What an append-only sink lacks."""
    return df.join(done.select(key).distinct(), key, "left_anti")
