"""Evaluation inputs: nested JSON files, and sets derived from the test tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.settings import JUDGED_METRICS, SCORE_GATES
from packlens.sources.passages import passages, vector_queries
from packlens.sources.replies import question_rows

GOLDEN_SCHEMA = (
    "corpus string, description string, items array<struct<id:string,category:string,answerable:boolean,"
    "query:string,expected_chunks:array<struct<source:string,must_contain:array<string>>>,reference_answer:string>>"
)
TRAJECTORY_SCHEMA = (
    "items array<struct<id:string,query:string,category:string,expected_tools:array<string>,"
    "forbidden_tools:array<string>,note:string>>"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of a golden set file."""
    return spark.read.schema(GOLDEN_SCHEMA).json(path, multiLine=True).select(F.inline("items"))


def expected_of(items: DataFrame) -> DataFrame:
    """One row per expected chunk of each item: (id, position, source, must_contain)."""
    return items.select("id", F.posexplode("expected_chunks").alias("position", "e")).select(
        "id", "position", "e.source", F.coalesce("e.must_contain", F.array().cast("array<string>")).alias("must_contain")
    )


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled question, with its expected and forbidden tools."""
    return spark.read.schema(TRAJECTORY_SCHEMA).json(path, multiLine=True).select(F.inline("items"))


#: Items in one file of a written set.
ITEMS_PER_FILE = 500


def write_items(items: DataFrame, path: str, key: str, schema: str, **header: str) -> None:
    """Write a set of items as files of the form the readers take: an object with the header and an ``items`` list.

    ``items`` has the item's columns and ``key``, a whole number that numbers the rows about evenly; each file
    holds the rows of ``ITEMS_PER_FILE`` consecutive keys, so no list grows with the set.
    """
    names = items.sparkSession.createDataFrame([], schema).schema["items"].dataType.elementType.names
    item = F.struct(*[n if n in items.columns else F.lit(None).cast("string").alias(n) for n in names])
    lists = items.groupBy(F.floor(F.col(key) / ITEMS_PER_FILE).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("_key"), item.alias("item")))).alias("rows"))
    text = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()], F.transform("rows", lambda r: r["item"]).alias("items")))
    lists.select("part", text.alias("value")).repartition("part").write.partitionBy("part").mode("overwrite").text(path)


def report_of(rolled: DataFrame) -> DataFrame:
    """A roll-up of metrics as one report row: maps of scores and of coverage, and the counts. The metrics are few."""
    counts = [F.first(c).alias(c) for c in rolled.columns if c.startswith("n_")]
    pairs = lambda value, cond=None: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.lit(True) if cond is None else cond, F.struct("metric", value)))))
    return rolled.agg(pairs("score").alias("scores"), pairs("scored", F.col("scored").isNotNull()).alias("coverage"), *counts)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """(metric, score, coverage, n_answerable) of an evaluation report; None where there is none.

    A report is an object with a ``scores`` object, or the scores themselves.
    """
    try:
        text = spark.read.text(path, wholetext=True).where("length(trim(value)) > 0")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    whole = text.select(F.from_json("value", "map<string,string>").alias("top"))
    nested = F.from_json(F.try_element_at("top", F.lit("scores")), "map<string,double>")
    bare = F.transform_values("top", lambda k, v: v.try_cast("double"))
    coverage = F.from_json(F.try_element_at("top", F.lit("coverage")), "map<string,bigint>")
    answerable = F.coalesce(F.try_element_at("top", F.lit("n_answerable")).try_cast("bigint"), F.lit(0))
    return whole.select(
        F.coalesce(nested, bare).alias("scores"),
        F.coalesce(coverage, F.create_map().cast("map<string,bigint>")).alias("coverage"),
        answerable.alias("n_answerable"),
    )


def golden_items(spark: SparkSession, folder: str) -> DataFrame:
    """An item per vector query, its class from the label; every fiftieth id is a repeat."""
    label = F.col("label")
    category = (
        F.when(F.col("answerable"), F.when(label % 2 == 0, "factual").otherwise("synthesis"))
        .when(label % 9 == 0, "vague")
        .when(label % 9 == 3, "out_of_scope")
        .otherwise("insufficient_context")
    )
    number = F.when((F.col("qid") % 50 == 0) & (F.col("qid") > 0), F.col("qid") - 1).otherwise(F.col("qid"))
    return vector_queries(spark, folder).select(
        "qid",
        F.concat(F.lit("g"), number.cast("string")).alias("id"),
        category.alias("category"),
        "answerable",
    )


def expected_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, position, source, must_contain): an answerable item expects its own passage and,
    for synthesis items, the next one as well."""
    wanted = golden_items(spark, folder).where("answerable").select(
        "qid",
        F.posexplode(
            F.when(F.col("category") == "synthesis", F.array(F.col("qid"), F.col("qid") + 1)).otherwise(
                F.array("qid")
            )
        ).alias("position", "chunk_id"),
    )
    texts = passages(spark, folder).select(
        "chunk_id",
        "source",
        F.array(F.substring("text", 1, 30), F.lower(F.substring("text", 41, 20))).alias("must_contain"),
    )
    return wanted.join(texts, "chunk_id").select("qid", "position", "source", "must_contain")


def rotting_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, must_contain) over the labelled documents: passages from the middle in capitals and
    from the head; some no longer hold, some name none."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    quoted = labels.join(passages(spark, folder).withColumnRenamed("chunk_id", "doc_id"), "doc_id")
    said = F.translate(
        F.substring("text", F.expr("length(text) div 2 + 1").cast("int"), F.lit(60)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    )
    said = F.when(F.col("quality") == 0, F.concat(said, F.lit(" (revised)"))).otherwise(said)
    return quoted.select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.concat(F.lit("gone/"), "source")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 31 == 3, F.array().cast("array<string>")).otherwise(F.array(said, F.substring("text", 1, 20))).alias("must_contain"),
    )


def judged_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, metric, value) as a judge would log them; some are NaN, some absent."""
    asked = question_rows(spark, folder).select("conv_id", "turn")
    rows = []
    for i, metric in enumerate(JUDGED_METRICS):
        value = F.when(
            F.expr(f"(conv_id*3+turn+{i})%7 = 0"), F.lit(float("nan"))
        ).otherwise(F.expr(f"((conv_id*13+turn*5+{i})%11)/1e1"))
        rows.append(F.when(F.expr(f"(conv_id+turn*2+{i})%13 <> 0"), F.struct(F.lit(metric).alias("metric"), value.alias("value"))))
    return asked.select("conv_id", "turn", F.explode(F.array_compact(F.array(*rows))).alias("s")).select(
        "conv_id", "turn", "s.metric", "s.value"
    )


def gates(spark: SparkSession, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The (metric, threshold) table; one row per gate."""
    rows = list((SCORE_GATES if thresholds is None else thresholds).items())
    return spark.createDataFrame(rows, "metric string, threshold double")
