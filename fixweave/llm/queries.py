"""The queries of this folder, over whole tables, and their SQL where it can tell the rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folder of the public vocabulary files; a parameter of the machine.
VOCABULARY = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")

RANKS = os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.tiktoken")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def decorate(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return decorate


@query()
def op1_ngram_join(spark, sf_dir):
    from fixweave.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


@query()
def op4_language_id(spark, sf_dir):
    from fixweave.llm.language import held_out, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, ~held_out("doc_id", 0))
    return found.select("doc_id", held_out("doc_id", 0).alias("held_out"), "lang_pred", "score")


@query(
    r"""WITH n AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
 r AS (SELECT doc_id, body, count(*) OVER w AS group_size, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(coalesce(text, '')) DESC, doc_id) AS keep_id FROM n WINDOW w AS (PARTITION BY body))
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r"""
)
def op6_exact_dedup(spark, sf_dir):
    from fixweave.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
 w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
 l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
   / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
 t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
 c AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
   CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)) AS BIGINT) AS taken FROM c"""
)
def op7_mixing(spark, sf_dir):
    from fixweave.llm.mixing import mix_plan, training_order

    ordered = training_order(mix_plan(table(spark, sf_dir, "documents")))
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


@query(
    r"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS window FROM bs),
 lens AS (SELECT DISTINCT n FROM win),
 ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw CROSS JOIN lens WHERE len(w) >= n),
 hits AS (SELECT ds.doc_id, ds.p, ds.n, win.item_id FROM ds JOIN win ON ds.n = win.n AND array_to_string(list_slice(ds.w, ds.p, ds.p + ds.n - 1), ' ') = win.window),
 words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
 items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
 SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
)
def op8_decontamination(spark, sf_dir):
    from fixweave.llm.decontaminate import benchmark_hits

    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits_digest(hits)


def hits_digest(hits):
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, n: a + n)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query(
    r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '[\\:\n]|</turn>|### ', 'x\0', 'g')) + length(regexp_replace(text, '\\|</turn>|### ', 'x\0', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
 SELECT * FROM a"""
)
def op10_chat_format(spark, sf_dir):
    from fixweave.llm.chat import format_conversations, read_back

    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(talks))


@query()
def op5_token_counts(spark, sf_dir):
    from fixweave.llm.wordpiece import token_counts, vocabulary

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


@query()
def op9_license_scan(spark, sf_dir):
    from fixweave.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op2_personal_data(spark, sf_dir):
    from fixweave.llm.pii import find_personal_data

    return spans_digest(find_personal_data(table(spark, sf_dir, "documents")))


def spans_digest(found):
    from fixweave.llm.pii import KINDS

    spans = F.arrays_zip("kinds", "starts", "ends", "base")
    named = F.array(*[F.lit(k) for k in KINDS])

    def said(s):
        return F.concat_ws(":", F.get(named, s["kinds"]), s["starts"].cast("string"), s["ends"].cast("string"))

    def of_kind(number):
        return lambda s: s["kinds"] == number

    base = F.filter(spans, lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, said), ",").alias("spans"), F.size(spans).cast("long").alias("n_spans"),
    )


@query()
def op3_lm_scoring(spark, sf_dir):
    from fixweave.llm.lm_scoring import score_texts

    return score_texts(table(spark, sf_dir, "documents"), RANKS)


@query()
def op11_toxicity(spark, sf_dir):
    from fixweave.llm.language import held_out
    from fixweave.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 0))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", "predicted")


@query()
def op12_whitening(spark, sf_dir):
    from fixweave.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_periodic_runs(spark, sf_dir):
    from fixweave.llm.periodic import periodic_runs, with_planted_repeats

    return runs_digest(periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents"))))


def runs_digest(found):
    runs = F.arrays_zip("starts", "lengths", "periods")
    least = F.struct(F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("period"))
    ranked = F.transform(runs, lambda r: F.struct(r["lengths"].alias("length"), (-r["starts"]).alias("start"), (-r["periods"]).alias("period")))
    best = F.coalesce(F.array_max(ranked), least)
    said = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("starts", "lengths", "periods")]))
    lines = F.array_join(F.transform(said, lambda line: F.concat(line, F.lit("\n"))), "")
    df = found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return df.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
