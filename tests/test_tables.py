"""Merges, stores, sources, splits, models and streams."""

from __future__ import annotations

import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from fixweave import schemas
from fixweave.functions.urls import commit_key
from fixweave.operators import audit, dataset, fetch, links, merge, methods, model
from fixweave.plans.ingest import ingest_release
from fixweave.plans.train import train
from fixweave.operators.records import parse_records
from fixweave.session import scratch_folder
from fixweave.sources import records as scans
from fixweave.sources.store import TableStore, should_run
from fixweave.streaming import ingest as stream


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def record_text(number: int, title: str = "t", state: str = "PUBLISHED", url: str | None = None) -> str:
    cna = {"title": title, "references": [{"url": url or f"https://github.com/o/r/commit/{number:07x}"}]}
    return json.dumps({"cveMetadata": {"cveId": f"CVE-2024-{number:04d}", "state": state}, "containers": {"cna": cna}})


# ---- merges ---------------------------------------------------------------------------
KV = "k int, ord int, a string, b double"


@pytest.fixture
def upserts(spark):
    existing = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, a string, b double")
    batch = spark.createDataFrame([(1, 1, "p", None), (1, 2, None, 5.0), (3, 3, None, None), (3, 4, "q", None)], KV)
    return existing, batch


def test_merge_rules(upserts):
    existing, batch = upserts
    whole = merge.merge_overwrite(existing, batch, ["k"], F.col("ord"))
    assert sorted(map(str, whole.collect())) == sorted(
        ["Row(k=1, a=None, b=5.0)", "Row(k=2, a='y', b=2.0)", "Row(k=3, a='q', b=None)"]
    )
    filled = merge.merge_coalesce(existing, batch, ["k"], F.col("ord"))
    assert sorted(map(str, filled.collect())) == sorted(
        ["Row(k=1, a='p', b=5.0)", "Row(k=2, a='y', b=2.0)", "Row(k=3, a='q', b=None)"]
    )


@pytest.mark.parametrize("rule", [merge.merge_overwrite, merge.merge_coalesce])
def test_merging_twice_changes_nothing(upserts, rule):
    existing, batch = upserts
    once = rule(existing, batch, ["k"], F.col("ord"))
    twice = rule(once, batch, ["k"], F.col("ord"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_append_functions(spark):
    columns = "repo_url string, commit_sha string, file_path string, method_name string, vuln_start_line int, vuln_end_line int, patched_start_line int, patched_end_line int"
    batch = spark.createDataFrame([("r", "s", "f", "m", 1, 2, 1, 3)] * 2 + [("", "s", "f", "m", 1, 2, 1, 3), (None,) + ("s", "f", "m", 1, 2, 1, 3)], columns)
    empty = spark.createDataFrame([], "function_id string, " + columns)
    assert merge.append_functions(empty, batch).count() == 2
    once = merge.append_functions(empty, batch, dedupe=True)
    assert once.count() == 1
    assert merge.append_functions(once, batch, dedupe=True).count() == 1
    assert merge.rejected_functions(batch).count() == 2


# ---- links and fetches ------------------------------------------------------------------
def test_backlog(spark):
    link = spark.createDataFrame(
        [("c1", "r", "s1", "u1"), ("c2", "r", "s1", "u1"), ("c3", "r", "s1", "u1#x"), ("c4", "r", "S1", "u"), ("c5", "r", "s2", "v")],
        "cve_id string, repo_url string, commit_sha string, commit_url string",
    )
    stored = spark.createDataFrame([("r", "s2")], "repo_url string, sha string")
    assert rows(links.backlog(link, stored), "commit_sha", "commit_url") == [("S1", "u"), ("s1", "u1"), ("s1", "u1#x")]
    assert rows(links.backlog(link, stored, unique_commit=True), "commit_sha", "commit_url") == [("S1", "u"), ("s1", "u1")]
    assert links.backlog(link, stored, limit=2, seed=1).count() == 2


def test_fetch_rules(spark):
    log = spark.createDataFrame(
        [
            (1, "https://github.com/a/b", "access", False, "Fatal: could not resolve"), (2, "https://github.com/a/b", "access", True, ""),
            (3, "https://github.com/a/b", "fetch", False, "Access denied"), (4, "https://x.org/a", "fetch", True, ""), (5, "https://github.com/a/b", "fetch", True, ""),
        ],
        schemas.FETCH_LOG,
    )
    strict = rows(fetch.classify_fetch(log), "seq", "skip_reason", "is_private")
    assert strict[:3] == [(1, "repo_inaccessible", True), (2, None, False), (3, "commit_fetch_failed", False)]
    lax = rows(fetch.classify_fetch(log, lax=True), "seq", "skip_reason")
    assert lax[2:] == [(3, "repo_inaccessible"), (4, "unsupported_platform"), (5, None)]
    assert rows(fetch.repo_access_table(log), "repo_url", "accessible") == [("https://github.com/a/b", False)]


def test_commit_key(spark):
    key = spark.range(1).select(commit_key(F.lit("https://github.com/a/b"), F.lit("abc"))).head()[0]
    assert key == __import__("hashlib").sha256(b"https://github.com/a/b#abc").hexdigest()[:16]


# ---- function rules ------------------------------------------------------------------------
def test_bulk_rule_needs_more_than_ten(spark):
    def commit(name, n):
        return [("r", name, i, "ab", "cd") for i in range(n)] + [("r", name, 99, "ab", "longer")]

    df = spark.createDataFrame(
        commit("ten", 10) + commit("eleven", 11), "repo_url string, commit_sha string, ord int, vuln_function string, patch_function string"
    )
    left = methods.drop_bulk_refactor(df).groupBy("commit_sha").count()
    assert rows(left, "commit_sha", "count") == [("eleven", 1), ("ten", 11)]


def test_rank_filter_runs_before_the_shuffle(spark):
    df = spark.range(10).selectExpr(
        "'r' AS repo_url", "concat('s', id % 2) AS commit_sha", "'f' AS file_path", "'m' AS method_name", "1L AS vuln_start_line",
        "id AS file_ord", "id AS ord"
    )
    plan = methods.dedup_functions(df)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert rows(methods.dedup_functions(df), "ord") == [(0,), (1,)]


def test_blocks_are_cut_in_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(1, 51))
    files = spark.createDataFrame([("r", "s", 1, text, text + "\r\nlast"), ("r", "s", 2, None, "")], "repo_url string, commit_sha string, file_ord long, source_before string, source_after string")
    spans = spark.range(1, 51).selectExpr("'r' AS repo_url", "'s' AS commit_sha", "1L AS file_ord", "id AS ord", "id AS vuln_start_line", "id + 1 AS vuln_end_line", "id AS patched_start_line", "99L AS patched_end_line")
    other = spans.limit(1).withColumn("file_ord", F.lit(2).cast("long"))
    cut = methods.cut_blocks(spans.unionByName(other), files, per_chunk=7)
    assert cut.count() == 51
    found = {r["ord"]: (r["vuln_text"], r["patch_text"]) for r in cut.where("file_ord = 1").collect()}
    assert found[3] == ("line 3\nline 4", "\n".join([f"line {i}" for i in range(3, 51)] + ["last"]))
    assert found[50] == ("line 50", "line 50\nlast")
    assert cut.where("file_ord = 2 AND vuln_text IS NULL AND patch_text IS NULL").count() == 1


def test_cascade_of_commits(spark):
    tables = {
        "commits": spark.createDataFrame([("r", "a", "u"), ("r", "b", "v")], "repo_url string, sha string, commit_url string"),
        "patch": spark.createDataFrame([("r", "a", "f"), ("r", "b", "g")], "repo_url string, commit_sha string, file_path string"),
        "functions": spark.createDataFrame([("r", "a"), ("r", "b")], "repo_url string, commit_sha string"),
    }
    left = audit.cascade_delete(tables, "commits", tables["commits"].where("sha = 'a'"))
    assert [left[t].count() for t in ("commits", "patch", "functions")] == [1, 1, 1]
    renames = spark.createDataFrame([("r", "a", "q", "z")], "old_repo_url string, old_sha string, new_repo_url string, new_sha string")
    moved = audit.cascade_update(tables, "commits", renames)
    assert rows(moved["commits"], "repo_url", "sha") == [("q", "z"), ("r", "b")]
    assert rows(moved["patch"], "repo_url", "commit_sha", "file_path") == [("q", "z", "f"), ("r", "b", "g")]
    assert rows(moved["functions"], "commit_sha") == [("a",), ("b",)]
    # The function row of the renamed commit is an orphan now, and the audit says so.
    assert rows(audit.integrity_audit(moved), "check", "table", "key") == [("foreign_key", "functions", "r|a")]


# ---- sources ---------------------------------------------------------------------------------
ENTRIES = {
    "cves/2024/0xxx/CVE-2024-0001.json": record_text(1), "CVES/x/CVE-2024-0002.JSON": record_text(2), "cves/delta.json": "{}",
    "other/CVE-2024-0003.json": record_text(3), "cves/cve-2024-0004.json": record_text(4), "cves/CVE-2024-0005.txt": record_text(5),
    "cves/a b+c/CVE-2024-0006.json": record_text(6), "cves/CVE-2024-0007.json": "not json",
}


def test_scan_folder(spark, tmp_path):
    for name, text in ENTRIES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = rows(scans.scan_cve_json(spark, str(tmp_path)), "entry")
    assert [f[0] for f in found] == [
        "CVES/x/CVE-2024-0002.JSON", "cves/2024/0xxx/CVE-2024-0001.json", "cves/CVE-2024-0007.json", "cves/a b+c/CVE-2024-0006.json",
    ]


def zipped(members: dict[str, str | bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return buffer.getvalue()


def test_scan_archives_opens_one_nested_level(spark, tmp_path):
    deep = zipped({"cves/CVE-2024-9999.json": "{}"})
    inner = zipped({"cves/CVE-2024-0100.json": record_text(100), "deep.zip": deep})
    (tmp_path / "release.zip").write_bytes(zipped({**ENTRIES, "nested.ZIP": inner}))
    (tmp_path / "more.zip").write_bytes(zipped({"cves/CVE-2024-0200.json": b'{"a": "\xff"}'}))
    (tmp_path / "notes.txt").write_text("no archive")
    found = scans.scan_cve_archives(spark, str(tmp_path), partitions=2)
    names = [e[0].rsplit("/", 1)[-1] for e in rows(found, "entry")]
    assert sorted(names) == sorted(
        ["CVE-2024-0002.JSON", "CVE-2024-0001.json", "CVE-2024-0006.json", "CVE-2024-0007.json", "CVE-2024-0100.json", "CVE-2024-0200.json"]
    )


def test_scan_pairs_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('"int f() {\n return ""a"";\n}",patched\n,only patch\n')
    assert [tuple(r) for r in scans.scan_pairs(spark, str(tmp_path), "csv").collect()] == [
        ('int f() {\n return "a";\n}', "patched"), (None, "only patch"),
    ]


# ---- store and ingest --------------------------------------------------------------------------
def test_ingest_is_gated_limited_and_repeatable(spark):
    store = TableStore(spark, scratch_folder(spark, "test-store"))
    assert store.read("cve").count() == 0
    raw = spark.createDataFrame(
        [(0, record_text(1, state="REJECTED")), (1, record_text(2)), (2, "broken"), (3, record_text(3)), (4, record_text(2, title="newer"))],
        "ord int, value string",
    )
    counters = ingest_release(store, raw, "v1", ["ord"])
    assert counters.first().asDict() == {"processed": 3, "rejected": 1, "skipped": 0, "unread": 1, "commits": 0, "patches": 0}
    first = rows(store.read("cve"), "cve_id", "title")
    assert first == [("CVE-2024-0002", "newer"), ("CVE-2024-0003", "t")]
    assert ingest_release(store, raw, "v1", ["ord"]) is None
    assert not should_run(store.read("sync_state"), "official_cvelist", "v1")
    ingest_release(store, raw, "v1", ["ord"], force=True)
    assert rows(store.read("cve"), "cve_id", "title") == first
    assert store.read("cve_commit").count() == 2

    limited = TableStore(spark, scratch_folder(spark, "test-store"))
    counters = ingest_release(limited, raw, "v1", ["ord"], limit=1)
    # Reading stopped at the first accepted record, after one rejected.
    assert counters.first().asDict() == {"processed": 1, "rejected": 1, "skipped": 0, "unread": 0, "commits": 0, "patches": 0}
    assert rows(limited.read("cve"), "cve_id", "title") == [("CVE-2024-0002", "t")]
    assert limited.read("sync_state").count() == 1


def test_stream_reads_new_files_only(spark, tmp_path):
    store = TableStore(spark, scratch_folder(spark, "test-stream"))
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    landing.mkdir()

    def start():
        stream.start_ingest(stream.read_record_stream(spark, str(landing)), store, checkpoint).awaitTermination()
        return sum(r["input_rows"] for r in stream.progress_rows(store).collect())

    (landing / "a.jsonl").write_text(record_text(1) + "\n" + record_text(2, state="REJECTED") + "\n")
    assert start() == 2
    (landing / "b.jsonl").write_text(record_text(1, title="newer") + "\n")
    assert start() == 3
    assert start() == 3
    assert rows(store.read("cve"), "cve_id", "title") == [("CVE-2024-0001", "newer")]
    assert store.read("cve_commit").count() == 1


# ---- dataset and model ----------------------------------------------------------------------------
@pytest.mark.parametrize("counts", [(5, 5), (7, 3), (1, 9), (101, 57), (1000, 333), (3, 3, 3)])
def test_split_is_exact_and_stratified(spark, counts):
    data = [(f"{label}-{i}", label) for label, n in enumerate(counts) for i in range(n)]
    random.Random(0).shuffle(data)
    df = spark.createDataFrame(data, "key string, label int")
    split = dataset.stratified_split(df, "label", ["key"])
    again = dataset.stratified_split(df.repartition(3), "label", ["key"])
    assert rows(split, "key", "is_test") == rows(again, "key", "is_test")
    assert split.count() == sum(counts)
    assert split.where("is_test").count() == math.ceil(sum(counts) * 0.2)
    per_label = dict(rows(split.where("is_test").groupBy("label").count(), "label", "count"))
    for label, n in enumerate(counts):
        assert abs(per_label.get(label, 0) - 0.2 * n) <= 1


def test_model_learns_and_reports(spark):
    good, bad = "int f(int a) {\n  if (a == null) throw e;\n  return a;\n}", "int f(int a) {\n  g(a);\n}"
    pairs = spark.createDataFrame([(i, bad + " " * (i % 3), good + " " * (i % 3)) for i in range(60)] + [(99, None, None), (100, " ", good)], "id int, vuln_function string, patch_function string")
    run = train(pairs, ["id"], num_trees=10, max_depth=5)
    assert run.summary.first()["rows"] == 121
    assert run.accuracy.first()["accuracy"] == 1.0
    report = {r["class"]: r for r in run.report.collect()}
    assert set(report) == {"0", "1", "macro avg", "weighted avg"}
    assert report["macro avg"]["support"] == 25 and report["1"]["f1"] == 1.0
    weights = run.importance.collect()
    assert abs(sum(w["importance"] for w in weights) - 1) < 1e-9
    assert [w["importance"] for w in weights] == sorted((w["importance"] for w in weights), reverse=True)


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (0, 0.0), (0, 0.0)], "label int, prediction double")
    report = {r["class"]: r.asDict() for r in model.classification_report(df).collect()}
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["f1"], report["1"]["support"]) == (0.0, 0.0, 0.0, 2)
    assert (report["0"]["precision"], report["0"]["recall"]) == (0.5, 1.0)


def test_last_line_of_a_file_wins_and_all_progress_stays(spark, tmp_path):
    store = TableStore(spark, scratch_folder(spark, "test-stream"))
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    landing.mkdir()
    (landing / "a.jsonl").write_text("".join(record_text(1, title=f"v{n}") + "\n" for n in range(6)))
    for number in (2, 3):
        (landing / f"b{number}.jsonl").write_text(record_text(number, state="REJECTED" if number == 2 else "PUBLISHED"))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        records = stream.read_record_stream(spark, str(landing), max_files_per_trigger=1)
        stream.start_ingest(records, store, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert store.read("cve").where("cve_id = 'CVE-2024-0001'").first()["title"] == "v5"
    progress = stream.progress_rows(store).collect()
    assert len(progress) == 3 and sum(r["input_rows"] for r in progress) == 8
    assert sum(r["processed"] for r in progress) == 7 and sum(r["rejected"] for r in progress) == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

        def getConf(self):
            return self

    class Cluster:
        conf = Conf()
        sparkContext = Conf()

    Cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Cluster(), "x")


def test_text_after_a_record_is_refused(spark):
    values = [record_text(1), record_text(1) + " " + record_text(2), '{"a":1},{"b":2}', record_text(1) + "}"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    found = [r["status"] for r in parse_records(df).orderBy("i").collect()]
    assert found == ["ok", "not_json", "not_json", "not_json"]
