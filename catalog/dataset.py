"""Queries of the training side: labels, features, split, model, reports; and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.fixtures import base, fixture
from catalog.registry import query, register
from fixweave.functions.features import FEATURES, feature
from fixweave.operators import dataset as D
from fixweave.operators import model as M
from fixweave.plans.train import train, training_rows
from fixweave.session import scratch_folder, staged
from fixweave.sources.store import TableStore
from fixweave.streaming import ingest as stream

PAIR = ["fx_function_pair"]


def pairs(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_function_pair")


@query("SELECT ord FROM fx_function_pair WHERE vuln_function IS NOT NULL OR patch_function IS NOT NULL", PAIR)
def drop_empty_pairs(spark, sf_dir):
    return D.drop_empty_pairs(pairs(spark, sf_dir)).select("ord")


_LABELLED = "lab AS (SELECT ord, vuln_function AS code, 1 AS label FROM fx_function_pair UNION ALL SELECT ord, patch_function, 0 FROM fx_function_pair)"
_CLEAN = f"{_LABELLED},\nclean AS (SELECT * FROM lab WHERE regexp_matches(code, '{S.NOT_WS}'))"


@query(f"{_LABELLED}\nSELECT * FROM lab", PAIR)
def label_pairs(spark, sf_dir):
    return D.label_pairs(pairs(spark, sf_dir), "ord")


@query(f"{_CLEAN}\nSELECT * FROM clean", PAIR)
def drop_blank_code(spark, sf_dir):
    return D.drop_blank_code(D.label_pairs(pairs(spark, sf_dir), "ord"))


def _any(*patterns: str) -> str:
    return f"CASE WHEN {' OR '.join(f'''regexp_matches(code, '{p}')''' for p in patterns)} THEN 1 ELSE 0 END"


_FEATURE_SQL = {
    "has_null_check": _any(S.word("null", "None"), f"[=!]={S.WS}*null", f"is{S.WS}+(?:not{S.WS}+)?None"),
    "has_if_statement": _any(S.word("if")),
    "has_try_catch": _any(S.word("try", "catch", "except")),
    "has_throw_or_raise": _any(S.word("throw", "raise")),
    "has_return": _any(S.word("return")),
    "has_length_check": _any(r"\.length", rf"(?:^|{S.NOT_WORD})len{S.WS}*\(", S.word("size", "byteLength")),
    "has_regex": _any("RegExp", rf"\.(?:exec|match){S.WS}*\(", r"/[^\n]+/"),
    "line_count": f"CASE WHEN regexp_matches(code, '{S.NOT_WS}') THEN CAST(len({S.lines('code')}) AS INTEGER) ELSE 0 END",
    "char_count": "CAST(coalesce(length(code), 0) AS INTEGER)",
}
# Features run over the code pairs and over the prose and pages, which are long.
_CODES = """codes AS (SELECT 'v' AS kind, ord AS id, vuln_function AS code FROM fx_function_pair UNION ALL SELECT 'p', ord, patch_function FROM fx_function_pair
 UNION ALL SELECT 'd', doc_id, text FROM documents UNION ALL SELECT 'h', page_id, html FROM pages UNION ALL SELECT 't', conv_id * 1000 + turn, text FROM conversations)"""


def codes(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return (
        p.select(F.lit("v").alias("kind"), F.col("ord").alias("id"), F.col("vuln_function").alias("code"))
        .unionByName(p.select(F.lit("p").alias("kind"), F.col("ord").alias("id"), F.col("patch_function").alias("code")))
        .unionByName(base(spark, sf_dir, "documents").selectExpr("'d' AS kind", "doc_id AS id", "text AS code"))
        .unionByName(base(spark, sf_dir, "pages").selectExpr("'h' AS kind", "page_id AS id", "html AS code"))
        .unionByName(base(spark, sf_dir, "conversations").selectExpr("'t' AS kind", "conv_id * 1000 + turn AS id", "text AS code"))
    )


def _register_feature(name: str) -> None:
    def run(spark, sf_dir):
        return codes(spark, sf_dir).select("kind", "id", feature(name, F.col("code")).alias(name))

    register(name, run, f"{_CODES}\nSELECT kind, id, {_FEATURE_SQL[name]} AS {name} FROM codes", PAIR)


for _name in FEATURES:
    _register_feature(_name)

_ALL_FEATURES = ", ".join(f"{sql} AS {name}" for name, sql in _FEATURE_SQL.items())


@query(f"{_CODES}\nSELECT kind, id, {_ALL_FEATURES} FROM codes", PAIR)
def build_features(spark, sf_dir):
    return D.build_features(codes(spark, sf_dir)).drop("code")


# ---- split ------------------------------------------------------------------------------
def _split_sql(table: str, label: str, key: str) -> str:
    return f"""n AS (SELECT {label} AS y, count(*) AS n FROM {table} GROUP BY 1),
t AS (SELECT y, n, sum(n) OVER () AS total, sum(n) OVER () - ceil(sum(n) OVER () * 0.2) AS train FROM n),
f AS (SELECT y, n, floor(n * train / total) AS base, (n * train) % total AS rest, train FROM t),
q AS (SELECT y, n - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= train - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5({key})) AS rn FROM {table})"""


@query(
    "WITH "
    + _split_sql("labels", "quality", "'42|' || CAST(doc_id AS VARCHAR)")
    + " SELECT doc_id, quality, rn <= n_test AS is_test FROM r JOIN q ON r.quality = q.y"
)
def stratified_split(spark, sf_dir):
    rows = base(spark, sf_dir, "labels").select("doc_id", "quality")
    return D.stratified_split(rows, "quality", ["doc_id"])


@query(
    "WITH "
    + _split_sql("lineitem", "l_returnflag", "'42|' || concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)")
    + " SELECT l_returnflag, count(*) FILTER (WHERE rn <= n_test) AS test_rows, count(*) FILTER (WHERE rn > n_test) AS train_rows,"
    " CAST(sum(CASE WHEN rn <= n_test THEN l_partkey END) AS BIGINT) AS test_keys FROM r JOIN q ON r.l_returnflag = q.y GROUP BY 1"
)
def stratified_split_large(spark, sf_dir):
    """Three labels over the largest table, checked by a sum over the drawn keys."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = base(spark, sf_dir, "lineitem").select("l_returnflag", *key)
    split = D.stratified_split(rows, "l_returnflag", key)
    return split.groupBy("l_returnflag").agg(
        F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"),
        F.sum(F.when(F.col("is_test"), F.col("l_partkey"))).alias("test_keys"),
    )


@query(
    f"{_CLEAN}\nSELECT count(*) AS rows, '{','.join(FEATURES)}' AS features FROM clean", PAIR
)
def dataset_summary(spark, sf_dir):
    return D.dataset_summary(D.drop_blank_code(D.label_pairs(pairs(spark, sf_dir), "ord")))


# ---- model ---------------------------------------------------------------------------------
def _run(spark, sf_dir):
    return train(pairs(spark, sf_dir), ["ord"])


@query()
def train_forest(spark, sf_dir):
    """Fit with the default forest on all pairs; one row per tree."""
    rows = staged(training_rows(pairs(spark, sf_dir), "ord").drop("code"), "features")
    forest = M.train_forest(rows).stages[-1]
    return spark.createDataFrame(
        [(i, t.numNodes, t.depth) for i, t in enumerate(forest.trees)], "tree int, nodes int, depth int"
    )


@query()
def predict(spark, sf_dir):
    return _run(spark, sf_dir).predicted.select("ord", "label", "prediction")


@query()
def feature_importance(spark, sf_dir):
    return _run(spark, sf_dir).importance


# The reports are checked on given labels, where SQL can tell the right answer:
# ``toxic`` is taken as a prediction of ``quality``.
@query("SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels")
def accuracy(spark, sf_dir):
    return M.accuracy(base(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    """WITH c AS (SELECT class, count(*) FILTER (WHERE quality = class) AS support, count(*) FILTER (WHERE toxic = class) AS predicted, count(*) FILTER (WHERE quality = class AND toxic = class) AS hits
 FROM labels CROSS JOIN (SELECT 0 AS class UNION ALL SELECT 1) GROUP BY class),
m AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / support END AS recall FROM c),
s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM s
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s"""
)
def classification_report(spark, sf_dir):
    return M.classification_report(base(spark, sf_dir, "labels"), "quality", "toxic")


# ---- streams ---------------------------------------------------------------------------------
_LAST = f"""{S.RECORDS},
{S.CVSS},
{S.CWE}
SELECT {S.CVE_ID} AS cve_id, {S.TITLE} AS title, v->>'$.cveMetadata.datePublished' AS published, severity, score AS cvss_score, cwe, {S.STATE} AS state
FROM j LEFT JOIN best USING (ord) LEFT JOIN w USING (ord) WHERE {S.STATE} <> 'REJECTED'"""


@query(_LAST, ["fx_cve_raw"])
def incremental_ingest(spark, sf_dir):
    """Two releases land one after the other; the second start sees new files only."""
    raw = fixture(spark, sf_dir, "fx_cve_raw")
    landing, checkpoint = scratch_folder(spark, "landing"), scratch_folder(spark, "checkpoint")
    store = TableStore(spark, scratch_folder(spark, "store"))
    for release in (0, 1):
        raw.where(F.col("ord") % 2 == release).select("value").write.mode("append").text(landing)
        records = stream.read_record_stream(spark, landing)
        stream.start_ingest(records, store, checkpoint).awaitTermination()
    return store.read("cve")


@query("SELECT 4 AS batches, count(*) AS input_rows FROM fx_cve_raw", ["fx_cve_raw"])
def batched_progress(spark, sf_dir):
    """Four files at one file per batch; progress is read from the store."""
    landing, checkpoint = scratch_folder(spark, "landing"), scratch_folder(spark, "checkpoint")
    fixture(spark, sf_dir, "fx_cve_raw").select("value").repartition(4).write.text(landing)
    records = stream.read_record_stream(spark, landing, max_files_per_trigger=1)
    store = TableStore(spark, scratch_folder(spark, "store"))
    stream.start_ingest(records, store, checkpoint).awaitTermination()
    rows = stream.progress_rows(store).where("input_rows > 0")
    return rows.agg(F.count("*").cast("int").alias("batches"), F.sum("input_rows").alias("input_rows"))
