"""Five stages from raw documents to a training order; each calls one text operator.

Every stage takes the documents that its predecessor kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixweave.llm.arrow import given_back, small_batches
from fixweave.llm.decontaminate import benchmark_hits
from fixweave.llm.exact_dedup import exact_duplicates
from fixweave.llm.language import UNDETERMINED, identify
from fixweave.llm.mixing import mix_plan, training_order
from fixweave.llm.ngram_join import ngram_components
from fixweave.llm.scale import without
from fixweave.session import staged

# Rows are decided in SQL nowhere: the language model is trained.
ORACLE_SQL = None


def _placed(docs: DataFrame) -> DataFrame:
    """Documents with a key of their own for each row, as ids may repeat or be null.

    Stored documents go by their file and their place in it, so no copy is made.
    """
    try:
        return docs.withColumn("_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return _numbered(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """A stored copy of the documents with a key for each row, in the order of the rows."""
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")


# Ids below the first bound keep their order in a key; the bits below them tell rows that share an id apart.
_ORDERED, _APART = 1 << 34, 28


def _by_id(keyed: DataFrame) -> DataFrame:
    """Keys in the order of the ids; rows without an id, or with one out of bounds, come last."""
    mark, doc_id = F.xxhash64("_row"), F.col("doc_id").cast("long")
    apart = mark.bitwiseAND(F.lit((1 << _APART) - 1))
    ordered = F.shiftleft(doc_id, _APART).bitwiseOR(apart)
    last = F.shiftrightunsigned(mark, 2).bitwiseOR(F.lit(1 << 62))
    return keyed.withColumn("_row", F.when((doc_id >= 0) & (doc_id < _ORDERED), ordered).otherwise(last))


def _without(keyed: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents whose row is not among the rows (_row) that ``find`` names, each of them once.

    These are stored first; then what the search shared with the executors is given back.
    """
    with given_back(), small_batches(keyed.sparkSession):
        dropped = staged(find(keyed).select("_row"), "dropped")
    return without(keyed, "_row", dropped).select(*[c for c in keyed.columns if c != "_row"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: those without a letter.

    Where no document says its language nothing is learnt, and nothing is told of
    any other; these stay.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def find(keyed: DataFrame) -> DataFrame:
        found = identify(keyed.withColumn("_letters", letters), F.col("lang").isNotNull(), keep=("_row", "_letters"))
        return found.where((F.col("lang_pred") == UNDETERMINED) & ~F.col("_letters"))

    return _without(_placed(docs), find)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return _without(_placed(docs), lambda keyed: exact_duplicates(keyed, row_col="_row").where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked texts.

    The join looks first at the least key of a group of candidates, so keys keep
    the order of the ids.
    """

    def find(keyed: DataFrame) -> DataFrame:
        found = ngram_components(keyed, id_col="_row")
        found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
        linked = staged(found.where("_row <> group"), "linked")
        members = linked.unionByName(linked.select(F.col("group").alias("_row"), "group").distinct())
        members = members.join(keyed.select("_row", "doc_id"), "_row")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"]
        kept = members.groupBy("group").agg(first.alias("_row"))
        return members.select("_row").join(kept.select("_row"), "_row", "left_anti")

    return _without(_by_id(_placed(docs)), find)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")

    def find(keyed: DataFrame) -> DataFrame:
        found = benchmark_hits(keyed, items, id_col="_row").where(F.size("starts") > 0)
        return found.select(F.col("doc_id").alias("_row"))

    return _without(_placed(docs), find)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in training order, with their words and positions."""
    order = training_order(mix_plan(docs)).where("taken > 0")
    return order.select(
        "doc_id", "source", "size", "source_size", "target", "taken", "first_position",
        F.transform("passes", lambda p: p["position"]).alias("positions"),
    )


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
