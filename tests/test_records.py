"""Field extraction from record texts, one row per case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fixweave.operators import links, records


def record(**changes) -> dict:
    data = {
        "dataType": "CVE_RECORD",
        "dataVersion": "5.0",
        "cveMetadata": {"cveId": "CVE-2023-12345", "state": "PUBLISHED", "datePublished": "2023-05-01T00:00:00Z"},
        "containers": {
            "cna": {
                "title": "A title",
                "affected": [{"product": "nginx"}],
                "descriptions": [{"lang": "en", "value": "A text."}],
                "problemTypes": [],
                "metrics": [],
                "references": [],
            }
        },
    }
    data["containers"]["cna"].update(changes)
    return data


@pytest.fixture
def parse(spark):
    def run(*documents):
        texts = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)]
        return records.parse_records(spark.createDataFrame(texts, "ord int, value string"))

    return run


def values(df, column):
    return [r["out"] for r in df.select("ord", column.alias("out")).orderBy("ord").collect()]


R = "record"


def test_status_of_broken_texts(parse):
    df = parse(
        record(), "not json", "[1]", '{"containers": "text"}', "", None, '{"cveMetadata": null}', "{'a': 1}", '{"a": 1} x', " {} \n"
    )
    assert values(df, F.col("status")) == [
        "ok", "not_json", "not_object", "bad_structure", "not_json", "not_json", "ok", "not_json", "not_object", "ok",
    ]


def test_each_field_of_the_wrong_type_once(parse):
    link = {"url": "https://github.com/o/r/commit/abcdef1"}
    fine = record(references=[link])
    harmless = [record(references=[link], affected=a) for a in ({"product": "x"}, "x", 3, ["x"], [None])]
    unlinked = [record(references=r) for r in ("x", link, 3, ["x"], [link, None], [link, [link]])]
    none = [record(references=r) for r in ("", {}, [], None)]
    lost = [record(**{name: "x"}) for name in ("descriptions", "problemTypes", "metrics")]
    lost += [{**fine, "cveMetadata": "x"}, {**fine, "containers": "x"}, {**fine, "containers": {"cna": "x"}}]
    lost.append(record(references="x", metrics="x"))
    df = parse(fine, *harmless, *unlinked, *none, *lost)
    kept = 1 + len(harmless) + len(unlinked) + len(none)
    assert values(df, F.col("status")) == ["ok"] * kept + ["bad_structure"] * len(lost)
    assert values(records.outcome(df), F.col("outcome")) == (
        ["processed"] * (1 + len(harmless)) + ["skipped"] * len(unlinked) + ["processed"] * len(none) + ["skipped"] * len(lost)
    )
    flat = records.flatten_cve(records.good_records(df), "ord")
    assert flat.where("cve_id = 'CVE-2023-12345' and title = 'A title'").count() == kept
    linked = links.commit_references(records.good_records(df), "ord")
    assert sorted(r["ord"] for r in linked.collect()) == list(range(1 + len(harmless)))
    assert values(records.good_records(df), records.products(F.col(R))) == [["nginx"]] + [[]] * len(harmless) + [["nginx"]] * (kept - 1 - len(harmless))


def test_bad_encoding(spark):
    raw = spark.createDataFrame([(0, bytearray(b'{"a": "\xff"}'))], "ord int, raw binary")
    df = records.parse_records(raw.select("ord", F.col("raw").cast("string").alias("value")))
    assert values(df, F.col("status")) == ["bad_encoding"]


def test_id_title_state(parse):
    no_title = record()
    del no_title["containers"]["cna"]["title"]
    foreign = record(title="", descriptions=[{"lang": "fr", "value": "texte"}, {"lang": "en", "value": "text"}])
    nothing = record(title=None, descriptions=[])
    valueless = record(title="", descriptions=[{"lang": "en"}])
    df = parse(record(), no_title, foreign, nothing, valueless, {})
    assert values(df, records.cve_id(F.col(R))) == ["CVE-2023-12345"] * 5 + ["UNKNOWN"]
    assert values(df, records.title(F.col(R))) == [
        "A title", "A text.", "texte", "No title available", "No title available", "No title available",
    ]
    assert values(df, records.state(F.col(R))) == ["PUBLISHED"] * 5 + ["UNKNOWN"]


def test_products_and_description(parse):
    several = record(affected=[{"product": "a"}, {"product": ""}, {"vendor": "v"}, {"product": "a"}, {"product": "b"}])
    french = record(descriptions=[{"lang": "fr", "value": "x"}, {"lang": "en"}])
    df = parse(several, record(affected=[]), french, record(descriptions=[]), {})
    assert values(df, records.products(F.col(R))) == [["a", "a", "b"], [], ["nginx"], ["nginx"], []]
    assert values(df, records.description(F.col(R))) == [
        "A text.", "A text.", "Description not available", "Description not collected", "Description not collected",
    ]
    assert values(df, records.description(F.col(R), "fr"))[2] == "x"


def test_cwe(parse):
    types = [
        {"descriptions": [{"type": "CWE", "cweId": "CWE-79"}, {"type": "text", "cweId": "CWE-1"}, {"type": "CWE", "cweId": ""}]},
        {"other": 1},
        {"descriptions": [{"type": "CWE", "cweId": "CWE-22"}, {"type": "CWE", "cweId": "CWE-79"}, {"type": "CWE"}]},
    ]
    df = parse(record(problemTypes=types), record(), {})
    ids = records.cwe_ids(F.col(R))
    assert values(df, ids) == [["CWE-22", "CWE-79"], [], []]
    assert values(df, records.cwe_join(ids)) == ["CWE-22,CWE-79", None, None]


def test_best_cvss(parse):
    def vector(version, score=1.0, severity="LOW"):
        return {"version": version, "baseScore": score, "baseSeverity": severity, "vectorString": "x"}

    df = parse(
        record(metrics=[{"cvssV2_0": vector("2.0", 6.0)}, {"cvssV3_1": vector("3.1", 9.8, "CRITICAL")}]),
        record(metrics=[{"cvssV3_1": vector("3.1", 9.8), "cvssV3_0": vector("3.1", 1.0)}, {"cvssV9": vector("n/a")}]),
        record(metrics=[{"other": vector("9.0")}, {"cvssV3_1": "text"}, {"cvssV4_0": vector("0")}]),
        record(metrics=[{"cvssV4_0": vector(4.0, "7.5")}, {"cvssV3": vector("3.1d")}, {"cvssV3": vector("nan")}]),
        record(metrics=[]),
        record(metrics=[{"cvssV3_1": {"version": " 3.1 "}}]),
    )
    best = records.best_cvss(F.col(R))
    assert values(df, best["score"]) == [9.8, 9.8, None, 7.5, None, None]
    assert values(df, best["severity"])[0] == "CRITICAL"
    assert values(df, best["version"]) == ["3.1", "3.1", None, "4.0", None, " 3.1 "]


def test_group_references(parse):
    urls = [
        "https://github.com/o/r/commit/abc123", "https://github.com/o/r/PULL/42", "https://h/security/advisories/G",
        "https://nvd.nist.gov/x?u=/commit/", "https://h/a;b/commit/c", "https://h/a;/commit/", "",
        " https://h/x/com\tmit/1",
    ]
    df = parse(record(references=[{"url": u} for u in urls] + [{"name": "n"}]), record())
    grouped = records.group_references(F.col(R))
    assert values(df, grouped["commit"])[0] == [urls[0], urls[4], urls[5], urls[7]]
    assert values(df, grouped["pull"])[0] == [urls[1]]
    assert values(df, grouped["security-advisories"])[0] == [urls[2]]
    assert values(df, grouped["other"])[0] == [urls[3]]
    assert [values(df, grouped[k])[1] for k in ("commit", "pull", "security-advisories", "other")] == [[]] * 4


def test_malformed_url_loses_links_but_not_the_row(parse):
    refs = [{"url": "https://github.com/o/r/commit/abcdef1"}, {"url": "https://[bad/commit/"}]
    df = parse(record(references=refs), record(references=refs[:1]))
    assert [r["ord"] for r in links.commit_references(df, "ord").collect()] == [1]
    assert records.flatten_cve(df).count() == 2
    assert values(records.outcome(df), F.col("outcome")) == ["skipped", "processed"]


def test_validate(parse):
    def without(*path):
        data = record()
        inner = data
        for step in path[:-1]:
            inner = inner[step]
        del inner[path[-1]]
        return data

    bad_id = record()
    bad_id["cveMetadata"]["cveId"] = "NOT-AN-ID"
    df = parse(
        record(), '"text"', without("containers"), without("dataVersion"), bad_id, without("containers", "cna"),
        without("cveMetadata", "cveId"),
    )
    checked = records.validate(F.col("value"), F.col(R))
    assert values(df, checked["reason"]) == [
        "Validation passed", "CVE data must be a dictionary", "Missing top-level field: containers",
        "Missing top-level field: dataVersion", "Invalid CVE ID format", "Missing containers.cna section",
        "Invalid CVE ID format",
    ]
    assert values(df, checked["valid"]) == [True] + [False] * 6


def test_nested_get(parse):
    df = parse({"a": {"b": "x"}}, {"a": None}, {"a": {"b": None}}, {}, "broken")
    assert values(df, records.nested_get(F.col("value"), "$.a.b", "d")) == ["x", "d", None, "d", "d"]


def test_rejected_limit_and_counters(parse):
    rejected = record()
    rejected["cveMetadata"]["state"] = "REJECTED"
    lower = record()
    lower["cveMetadata"]["state"] = "rejected"
    df = parse(rejected, record(), "broken", lower, '{"containers": 5}', record())
    accepted = records.drop_rejected(records.good_records(df))
    assert sorted(r["ord"] for r in accepted.select("ord").collect()) == [1, 3, 5]
    assert [r["ord"] for r in records.limit_processed(accepted, 2, "ord").select("ord").collect()] == [1, 3]
    assert records.ingest_counters(records.outcome(df)).first().asDict() == {
        "processed": 3, "rejected": 1, "skipped": 1, "unread": 1,
    }


def test_one_parse_per_record(spark):
    from fixweave.operators import records as R
    from fixweave.session import staged

    raw = staged(spark.createDataFrame([(1, '{"a": {"b": 1}, "c": null}'), (2, "no json")], "i int, value string"), "raw")
    paths = {"b": ("$.a.b", "0", "int"), "c": ("$.c", "x"), "d": ("$.d", "none")}
    found = R.nested_values(raw, paths)
    assert sorted(tuple(r)[2:] for r in found.collect()) == [(0, "x", "none"), (1, None, "none")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    plan = R.parse_records(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(records") == 1


def test_text_that_closes_the_frame_is_refused(spark):
    from fixweave.operators.records import parse_records

    values = ['{"a":1}]}', '{"a":1}', ' {"containers":null}\n', '[{"a":1}]', "{}", '{"a":1},', '{"a":1}]']
    assert len(values) == 7
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    found = [r["status"] for r in parse_records(df).orderBy("i").collect()]
    assert found[:6] == ["not_json", "ok", "ok", "not_object", "ok", "not_object"] and found[6] != "ok"


def test_bracketed_hosts_follow_the_url_parser(evaluate):
    import random
    from urllib.parse import urlsplit

    from fixweave.functions.urls import url_is_malformed

    def refused(url):
        try:
            urlsplit(url)
        except ValueError:
            return True
        return False

    rng = random.Random(4)
    hosts = ["::1", "1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::", ":::", "1::2::3", "12345::", "g::", "::1.2.3.4",
             "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::256.1.1.1", "::01.2.3.4", "1.2.3.4", "example.org", "v1.x", "v.x", "vz.x", "V1.x", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "", "1:2", "::ffff:1.2.3"]
    urls = [f"https://{a}{o}{h}{c}{b}/x" for h in hosts for a, o, c, b in
            [("", "[", "]", ""), ("", "[", "]", ":80"), ("", "[", "]", "x"), ("u@", "[", "]", ""), ("a", "[", "]", ""), ("[u]@", "", "", ""), ("", "[", "", ""), ("", "]", "[", "")]]
    urls += ["https://[" + ":".join(rng.choice(["", "1", "ab", "ffff"]) for _ in range(rng.randint(1, 9))) + "]/" for _ in range(300)]
    assert evaluate(url_is_malformed, urls) == [refused(u) for u in urls]
