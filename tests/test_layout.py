"""Stored tables: folders that a read opens, parts that a merge copies, batches that come again; plans of one pass."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from fixweave import schemas
from fixweave.frames import large, pruned
from fixweave.operators import audit, dataset, lookups, merge, methods, model
from fixweave.plans.enrich import BAD_DIFF, BAD_SOURCE, Landed, enrich_commits
from fixweave.plans.ingest import ingest_release
from fixweave.session import scratch_folder, staged, staged_buckets, staged_with_counts
from fixweave.sources.store import TableStore
from fixweave.streaming import ingest as stream
from test_tables import record_text, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scan of a read without an exchange opens."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def cve_rows(spark, numbers, title="t"):
    return spark.createDataFrame(
        [(f"CVE-{2000 + n % 10}-{n:05d}", title, f"{2000 + n % 10}-03-0{1 + n % 9}T00:00:00Z" if n % 11 else None, ["LOW", "HIGH"][n % 2]) for n in numbers],
        "cve_id string, title string, published string, severity string",
    )


@pytest.fixture
def store(spark):
    return TableStore(spark, scratch_folder(spark, "test-layout"), buckets=4)


# ---- layout ------------------------------------------------------------------------------
def test_a_year_opens_its_own_folders_only(spark, store):
    store.publish({"cve": cve_rows(spark, range(1, 400))})
    whole, year = files_read(store.read("cve")), store.read("cve", "2003-01-01", "2003-12-31T23:59:59Z")
    # Ten years and the rows without a date, in four buckets at most; a year, and those rows.
    assert 40 < whole <= 44 and files_read(year) <= 8
    plain = lookups.cve_by_published(store.read("cve"), "2003-01-01", "2003-12-31T23:59:59Z")
    assert rows(year, "cve_id") == rows(plain, "cve_id") != []
    assert rows(store.read("cve", last="2001"), "cve_id") == rows(store.read("cve").where("published <= '2001'"), "cve_id")
    with pytest.raises(ValueError, match="by a date"):
        store.read("patch", "2003")


def test_functions_of_a_commit_lie_together(spark, store):
    functions = spark.range(4000).selectExpr(
        "CAST(id AS STRING) AS function_id", "'r' AS repo_url", "md5(CAST(id % 400 AS STRING)) AS commit_sha", "'f' AS file_path"
    )
    # Small ranges would be put together into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.publish({"functions": functions.repartition(4)})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folder = glob.glob(f"{store.root}/functions/part=*")[0]
    ranges = [spark.read.parquet(f).agg(F.min("commit_sha"), F.max("commit_sha")).first() for f in glob.glob(f"{folder}/*.parquet")]
    ranges = sorted(tuple(r) for r in ranges if r[0])
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    sha = functions.first()["commit_sha"]
    assert lookups.functions_of_commit(store.read("functions"), "r", sha).count() == 10


# ---- merges ------------------------------------------------------------------------------
def test_merges_read_the_stored_table_once_and_leave_it_in_place(spark):
    stored = spark.range(1000).selectExpr("id AS k", "CAST(id AS STRING) AS a", "CAST(NULL AS STRING) AS b")
    existing = staged_buckets(stored, "test-buckets", ["k"], 4)
    batch = staged(spark.range(990, 1010).selectExpr("id AS k", "0 AS ord", "CAST(NULL AS STRING) AS a", "'new' AS b"), "test-batch")
    for rule in (merge.merge_overwrite, merge.merge_coalesce):
        merged = rule(existing, batch, ["k"], F.col("ord"))
        text = plan(merged)
        stored_side, batch_side = text[text.index("FullOuter"):].split("FileScan parquet")[1:]
        assert "Bucketed: true" in stored_side and "Exchange" not in text[text.index("FullOuter"):text.index("FileScan parquet")]
        assert text.count("Bucketed: true") == 1 and merged.count() == 1010
        assert rows(merged.where("k = 995"), "a") == ([(None,)] if rule is merge.merge_overwrite else [("995",)])


def test_upserts_copy_only_the_parts_they_meet(spark, store):
    def parts():
        return store._current()["cve"][1]

    store.upsert({"cve": (cve_rows(spark, range(1, 50)), F.col("cve_id"))})
    store.upsert({"cve": (cve_rows(spark, range(50, 90)), F.col("cve_id"))})
    first, second = parts()
    store.upsert({"cve": (cve_rows(spark, range(85, 95), "late"), F.col("cve_id"))})
    assert len(parts()) == 2 and parts()[0] == first and second not in parts()
    assert store.read("cve").count() == 94 and store.read("cve").where("title = 'late'").count() == 10
    # A session that has not seen the folders yet reads them by bucket as well.
    other = TableStore(spark, store.root, buckets=2)
    spark.sql(f"DROP TABLE {store._bucketed('cve', 4)}")
    other.upsert({"cve": (cve_rows(spark, range(1, 95), "again"), F.col("cve_id"))})
    assert len(other._current()["cve"][1]) == 1 and other.read("cve").where("title = 'again'").count() == 94
    assert other._current()["cve"][2] == 2
    other.upsert({"cve": (cve_rows(spark, [7], "once more"), F.col("cve_id"))})
    assert other.read("cve").where("title = 'again'").count() == 93
    other.upsert({"cve": (cve_rows(spark, []), F.col("cve_id"))})
    assert other.read("cve").count() == 94


# ---- streams -----------------------------------------------------------------------------
def test_a_line_file_is_read_by_many_tasks_and_its_last_line_wins(spark, tmp_path, store):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.jsonl").write_text("".join(record_text(n % 50, title=f"v{n}") + "\n" for n in range(3000)))
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    seen = []
    try:
        records = stream.read_record_stream(spark, str(landing))
        look = records.writeStream.foreachBatch(lambda df, i: seen.append((df.rdd.getNumPartitions(), df.select("split_start").distinct().count())))
        look.option("checkpointLocation", str(tmp_path / "look")).trigger(availableNow=True).start().awaitTermination()
        stream.start_ingest(records, store, str(tmp_path / "checkpoint")).awaitTermination()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert seen[0][0] > 5 and seen[0][1] > 5
    assert rows(store.read("cve"), "cve_id", "title") == [(f"CVE-2024-{n:04d}", f"v{2950 + n}") for n in range(50)]


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path, store):
    landing, checkpoint = tmp_path / "landing", tmp_path / "checkpoint"
    landing.mkdir()

    def start():
        stream.start_ingest(stream.read_record_stream(spark, str(landing)), store, str(checkpoint)).awaitTermination()
        return store._current()["cve"], rows(stream.progress_rows(store), "batch_id", "input_rows", "processed")

    (landing / "a.jsonl").write_text(record_text(1) + "\n" + record_text(2) + "\n")
    first = start()
    assert first[1] == [(0, 2, 2)]
    # The run died after its rows were published and before the checkpoint knew.
    os.remove(checkpoint / "commits" / "0")
    for crc in glob.glob(str(checkpoint / "commits" / ".0*")):
        os.remove(crc)
    assert start() == first
    (landing / "b.jsonl").write_text(record_text(3) + "\n")
    assert start()[1] == [(0, 2, 2), (1, 1, 1)]
    # A new checkpoint is another stream: its first batch is not taken for the old one.
    again = stream.start_ingest(stream.read_record_stream(spark, str(landing)), store, str(tmp_path / "other"))
    again.awaitTermination()
    assert len(rows(stream.progress_rows(store), "stream")) == 3 and store.read("cve").count() == 3


def test_one_record_files(spark, tmp_path, store):
    landing = tmp_path / "landing"
    landing.mkdir()
    for n in range(4):
        (landing / f"{n}.json").write_text(json.dumps(json.loads(record_text(n)), indent=1))
    records = stream.read_record_stream(spark, str(landing), whole_files=True, max_files_per_trigger=3)
    stream.start_ingest(records, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read("cve").count() == 4 and rows(stream.progress_rows(store), "input_rows") == [(1,), (3,)]


# ---- one pass ----------------------------------------------------------------------------
def test_audit_reads_every_table_once(spark, tmp_path):
    names = {"cve": schemas.CVE, "cve_commit": schemas.CVE_COMMIT, "commits": schemas.COMMITS, "patch": schemas.PATCH, "functions": schemas.FUNCTIONS}
    tables = {name: staged(spark.createDataFrame([], schema), f"audit-{name}") for name, schema in names.items()}
    found = audit.integrity_audit(tables)
    assert plan(found).count("FileScan parquet") == 5 and "Join" not in plan(found)
    assert found.collect() == []


def test_split_scans_its_input_twice_and_marks_rows_in_place(spark):
    df = staged(spark.range(5000).selectExpr("id", "CAST(id % 3 AS INT) AS label", "repeat('x', 50) AS wide"), "split-input")
    split = dataset.stratified_split(df, "label", ["id"])
    text = plan(split)
    assert "Window" not in text and "Exchange hashpartitioning" not in text
    assert split.where("is_test").count() == 1000
    odd = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "b")], "id int, label string")
    assert dataset.stratified_split(odd, "label", ["id"]).where("label IS NULL AND is_test").count() == 0
    assert dataset.stratified_split(odd.limit(0), "label", ["id"]).count() == 0


def test_counts_are_taken_along(spark):
    stored, counts = staged_with_counts(spark.range(10), "counts", n=F.count("*"), even=F.count_if(F.expr("id % 2 = 0")), none=F.sum(F.lit(None).cast("int")))
    assert stored.count() == 10 and counts == {"n": 10, "even": 5, "none": 0}
    assert staged_with_counts(spark.range(0), "counts", n=F.count("*"))[1] == {"n": 0}


def test_forests_predict_after_counts_were_observed(spark):
    staged_with_counts(spark.range(3), "counts", n=F.count("*"))
    df = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS label", "CAST(id % 2 AS DOUBLE) AS f")
    fitted = model.train_forest(df, ["f"], num_trees=3, max_depth=2)
    assert model.predict(fitted, df).where("prediction = label").count() == 40


def test_pruning_loses_no_wanted_row(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 3 THEN NULL ELSE id END AS a", "CAST(id AS STRING) AS b")
    wanted = staged(df.where("a % 50 = 0"), "wanted")
    kept = pruned(df, ["a", "b"], wanted)
    assert kept.join(wanted, ["a", "b"], "left_semi").count() == 400
    assert kept.count() < 800 and kept.columns == ["a", "b"]
    assert pruned(df, ["a"], staged(df.limit(0), "wanted")).count() == 0


def test_texts_of_other_files_do_not_move(spark):
    text = "int f() {\n  return 1;\n}\n"
    files = spark.range(3000).selectExpr("'r' AS repo_url", "'s' AS commit_sha", "id AS file_ord", f"concat('{text}', id) AS source_before", f"concat('{text}', id, 'x') AS source_after")
    pairs = staged(spark.range(0, 3000, 100).selectExpr("'r' AS repo_url", "'s' AS commit_sha", "id AS file_ord", "1 AS ord"), "pairs")
    sourced = methods.attach_source(pairs, staged(files, "files"))
    assert sourced.count() == 30
    text = plan(sourced)
    assert text.count("FileScan parquet") == 3 and "_bits" in text


# ---- errors and access -------------------------------------------------------------------
def test_broken_texts_cost_a_commit_no_more_than_they_must(spark, store):
    code = "int alpha(char *p) {\\n  return p;\\n}\\n"
    files = spark.sql(
        f"""SELECT 'https://github.com/o/r' || c AS repo_url, repeat(CAST(c AS STRING), 40) AS commit_sha, f AS file_ord, 'src/f' || f || '.c' AS old_path, CAST(NULL AS STRING) AS new_path,
        CASE WHEN c = 1 AND f = 2 THEN CAST(unhex('2BFF') AS STRING) ELSE '+a' END AS diff,
        CASE WHEN c = 2 AND f = 1 THEN CAST(unhex('696E74FF') AS STRING) ELSE '{code}' END AS source_before, replace('{code}', 'return p', 'return q' ) AS source_after
        FROM (SELECT explode(array(1, 2, 3, 4)) AS c) CROSS JOIN (SELECT explode(array(1L, 2L)) AS f)"""
    )
    spans = files.selectExpr("repo_url", "commit_sha", "file_ord", "explode(array('changed', 'before', 'after')) AS side", "1 AS ord", "'alpha' AS name", "1L AS start_line", "3L AS end_line")
    wanted = files.select("repo_url", "commit_sha").distinct().withColumns({"cve_id": F.lit("CVE-1"), "commit_url": F.concat(F.lit("u/"), "commit_sha")})
    fetched = wanted.selectExpr("repo_url", "commit_sha", "commit_sha AS full_sha", "'m' AS message", "'a' AS author", "'2024' AS commit_date", "CAST(NULL AS STRING) AS error")
    log = spark.createDataFrame([(1, "https://github.com/o/r3", "access", False, "timeout"), (2, "https://github.com/o/r3", "access", True, ""), (1, "https://github.com/o/r4", "access", True, "")], schemas.FETCH_LOG)
    store.publish({"cve_commit": wanted})
    run = enrich_commits(store, fetched, files, spans, log)
    assert run.counts == {"commits_found": 4, "commits_saved": 3, "commits_failed": 1, "patches_saved": 4}
    assert run.counters().first().asDict() == run.counts
    assert rows(run.outcomes.where("skip_reason IS NOT NULL"), "repo_url", "skip_reason") == [("https://github.com/o/r3", "repo_inaccessible")]
    assert [r[-1] for r in rows(store.read("commits"), "repo_url")] == [f"https://github.com/o/r{c}" for c in (1, 2, 4)]
    assert rows(store.read("patch").groupBy("repo_url").count(), "repo_url", "count") == [("https://github.com/o/r2", 2), ("https://github.com/o/r4", 2)]
    assert rows(store.read("functions").groupBy("repo_url").count(), "repo_url", "count") == [
        ("https://github.com/o/r1", 2), ("https://github.com/o/r2", 1), ("https://github.com/o/r4", 2),
    ]
    assert rows(run.errors.fillna(""), "repo_url", "patch_error", "function_error") == [
        ("https://github.com/o/r1", BAD_DIFF, ""), ("https://github.com/o/r2", "", BAD_SOURCE),
    ]


def test_a_run_counts_commits_and_patches(spark, store):
    raw = spark.createDataFrame([(n, record_text(n)) for n in range(1, 6)], "ord int, value string")
    shas = [f"{n:07x}" for n in range(1, 6)]
    fetched = spark.createDataFrame([("https://github.com/o/r", s, s if s != shas[0] else "other", "m", None, None, None) for s in shas], schemas.COMMIT_RAW)
    files = spark.createDataFrame([("https://github.com/o/r", s, f, f"src/{f}.c", None, None, "+a", None, None) for s in shas for f in (1, 2)], schemas.FILE_CHANGE)
    landed = Landed(fetched, files, spark.createDataFrame([], schemas.METHOD_SPAN))
    found = ingest_release(store, raw, "v1", ["ord"], landed=landed).first().asDict()
    assert found == {"processed": 5, "rejected": 0, "skipped": 0, "unread": 0, "commits": 4, "patches": 8}
    assert store.read("patch").count() == 8 and store.read("sync_state").count() == 1


# ---- landing -----------------------------------------------------------------------------
def test_landing_goes_on_where_it_stopped(spark, tmp_path):
    from fixweave.sources import landing

    root, target = tmp_path / "records", str(tmp_path / "landed")
    names = [f"cves/2024/{n}xxx/CVE-2024-{n}.json" for n in range(9)]
    names += ["CVES/a b+c/CVE-2024-[1]*{a}%25.JSON", "cves/delta.json", "other/CVE-2024-1.json", "cves/CVE-2024-9.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text('{\n "name": "' + name + '"\n}\n')
    (root / "cves/CVE-2024-77.json").write_bytes(b'{"a": "\xff"}')
    wanted = sorted(names[:10] + ["cves/CVE-2024-77.json"])

    # A run that dies after two slices of four.
    written, plain = [], type(spark.range(1).write).json

    def dying(writer, path, *args, **kw):
        if len(written) == 2:
            raise RuntimeError("lost")
        written.append(path)
        return plain(writer, path, *args, **kw)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(1).write), "json", dying)
        with pytest.raises(RuntimeError, match="lost"):
            landing.land_records(spark, str(root), target, slice_files=3)
    before = landing.scan_landed(spark, target).count()
    assert 0 < before < len(wanted)
    assert landing.land_records(spark, str(root), target, slice_files=3) == len(wanted) - before
    assert [r[0] for r in rows(landing.scan_landed(spark, target), "entry")] == wanted
    assert landing.land_records(spark, str(root), target) == 0
    texts = dict(rows(landing.scan_landed(spark, target).selectExpr("entry", "hex(value) AS value"), "entry", "value"))
    assert all(bytes.fromhex(texts[name]) == (root / name).read_bytes() for name in wanted)
    (root / names[0]).write_text("changed since")
    os.utime(root / names[0], (2_000_000_000, 2_000_000_000))
    assert landing.land_records(spark, str(root), target) == 1
    newest = landing.scan_landed(spark, target).where(F.col("entry") == names[0]).orderBy(F.desc("modified")).first()
    assert newest["value"] == "changed since"


def test_no_names_of_records_reach_the_driver(spark, tmp_path, monkeypatch):
    from fixweave.sources import landing

    root, target = tmp_path / "records", str(tmp_path / "landed")
    names = [f"cves/{n % 3}/{n % 2}/CVE-{n}.json" for n in range(40)]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    collected, loaded, frame, reader = [], [], type(spark.range(1)), type(spark.read)
    collect, load, text = frame.collect, reader.load, reader.text
    monkeypatch.setattr(frame, "collect", lambda df: collected.append(collect(df)) or collected[-1])
    monkeypatch.setattr(reader, "load", lambda *args, **kw: loaded.append("load") or load(*args, **kw))
    monkeypatch.setattr(reader, "text", lambda *args, **kw: loaded.append("text") or text(*args, **kw))
    assert landing.land_records(spark, str(root), target, slice_files=20) == 40
    # Spark's readers list the files they are pointed at on the driver.
    assert not loaded
    assert sum(map(len, collected)) <= 2 and not any("CVE" in str(row) for found in collected for row in found)
    found = collect(landing.scan_landed(spark, target))
    assert sorted((r["entry"], r["value"], r["length"]) for r in found) == sorted((n, n, len(n)) for n in names)


def test_odd_files_of_records(spark, tmp_path):
    from fixweave.sources import landing

    kept = ["cves/_a=1/CVE-1.json", "cves/x/y/z/CVE-2.JsOn", "CVES\\x\\CVE-3.JSON", "cves/CVE-\u00e9%41 +.json", "cves/_metadata/CVE-4.json", "cves/CVE-link.json"]
    left = ["cves/_h/CVE-5.json", "cves/.h/CVE-6.json", "cves/.CVE-7.json", "cves/_CVE-8.json", "cves/CVE-9.json._COPYING_", "cves/CVE-10.txt", "_h\\cves\\CVE-11.json"]
    for name in [*kept[:-1], *left]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    (tmp_path / "cves/CVE-12.json").write_text("")
    os.symlink(tmp_path / kept[0], tmp_path / kept[-1])
    os.symlink(tmp_path / "none", tmp_path / "cves/CVE-13.json")
    os.utime(tmp_path / kept[1], ns=(10**18 + 123_456_789,) * 2)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = landing.list_records(spark, root).selectExpr("entry", "length", "unix_micros(modified) AS micros").collect()
        assert sorted(r["entry"] for r in found) == sorted(kept) and {r["length"] for r in found} == {2}
        assert [r["micros"] for r in found if r["entry"] == kept[1]] == [10**15 + 123_000]


def _broadcasts(df):
    """What the joins of a plan send through the driver, as the planner would have it before any row is read."""
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "BroadcastExchange" in line]


def test_packed_spans_are_not_broadcast(spark):
    # 200,000 rows in a few KB of files: the planner takes them for a small table.
    file = ["'r' AS repo_url", "'s' AS commit_sha"]
    spans = staged(spark.range(200_000).selectExpr(*file, "id div 50000 AS file_ord", "'before' AS side", "1L AS ord"), "spans")
    files = staged(spark.range(4).selectExpr(*file, "id AS file_ord", "'a' AS source_before", "'b' AS source_after"), "files")
    sourced = methods.attach_source(spans, files)
    assert len(_broadcasts(sourced)) == 1, "more than the bitmap of the files"
    assert sourced.count() == 200_000
    assert not _broadcasts(spans.join(large(files), ["repo_url", "commit_sha", "file_ord"]))
    assert _broadcasts(spans.join(files, ["repo_url", "commit_sha", "file_ord"]))


def test_landed_texts_are_packed(spark, tmp_path):
    import random

    from catalog.fixtures import fixture

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    made = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(30)), "en", f"s{i % 7}") for i in range(600)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def size(files):
        return sum(os.path.getsize(f.removeprefix("file://")) for f in files)

    landed = fixture(spark, str(tmp_path), "fx_source_file")
    assert landed.count() == 600 and all(".zstd." in f for f in landed.inputFiles())
    # Three texts a file, one of them a diff; the join moves two of them once more.
    assert size(landed.inputFiles()) < 2.4 * size(spark.read.parquet(f"{tmp_path}/documents.parquet").inputFiles())


def test_bitmap_of_wanted_keys_is_bounded():
    from fixweave import frames

    assert 1 << frames._MOST_BITS <= 8 * 256 * 1024


def test_lookup_meets_commits_before_records(spark):
    cve = spark.createDataFrame([("CVE-1", f"t{i}") for i in range(3)], "cve_id string, title string")
    links = spark.createDataFrame([("CVE-1", "r", f"s{i % 2}", f"u{i}") for i in range(3)], "cve_id string, repo_url string, commit_sha string, commit_url string")
    commits = spark.createDataFrame([("r", "s0", "d", "a", "m")], "repo_url string, sha string, commit_date string, author string, message string")
    found = lookups.cve_commit_lookup(cve, links, commits)
    assert found.columns == ["repo_url", "commit_sha", "cve_id", "title", "commit_url", "commit_date", "author", "message"]
    assert sorted(r["title"] + r["commit_url"] for r in found.collect()) == sorted(f"t{i}u{j}" for i in range(3) for j in (0, 2))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "cve_id" in joins[0]
