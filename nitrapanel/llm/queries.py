"""The registered queries of the thirteen operators and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.llm import (
    fingerprints, hardneg, langid, linecrf, linededup, mixing, packing, rules, secrets, sharding, simhash, tokens, whitening,
)
from nitrapanel.llm.coder import tokenizer_path
from nitrapanel.llm.frames import fold
from nitrapanel.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
SHARDS = 24


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(_documents(spark, sf_dir), path, tokenizer_path(TOKENIZER), end_id=2)
    return tokens.read_digests(spark, path)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 4) == 2)
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(_documents(spark, sf_dir), keep=["doc_id"])
    judged = rules.apply_policy(rows, rules.POLICIES["prose", 1])
    base = F.lit(rules.POLICIES["base", 1].mask).cast("long")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("rule_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "rule_bits", "policy",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(TOKENIZER), end_id=1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fingerprints.with_next(_documents(spark, sf_dir), parts).withColumn("n_chars", F.char_length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    kept = (F.col("n_chars") - moved).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), kept), F.substr("next_text", F.lit(1), moved))
    rows = rows.withColumn("edited", edited)
    for text, name in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = fingerprints.add_sketch(rows, F.col(text), name)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text("own").alias("fingerprint"), fingerprints.as_text("changed").alias("edited_fingerprint"),
        fingerprints.resemblance("own", "changed").alias("near_edited"),
        fingerprints.resemblance("own", "following").alias("near_next"),
        fingerprints.containment("own", "changed").alias("contained_in_edited"),
        fingerprints.distinct_shingles("own").alias("distinct_shingles"),
    )


#: Shares of the tokens that each domain is to have; the domains come from the table of labels.
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}


def domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of labelled documents; a document labelled twice has the worse domain."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("domain")).where("domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = mixing.fit(docs.join(domains(_labels(spark, sf_dir)), "doc_id"))
    members = mixing.memberships(docs, model, tokenizer_path(TOKENIZER))
    plan = mixing.fit_rates(members, model.domains, TARGETS)
    names = F.array(*map(F.lit, model.domains))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return mixing.with_rates(members, plan).select(
        "doc_id", "tokens", F.element_at(names, best).alias("domain"), "posterior", "rate", "copies",
    )


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 3) == 1)
    model = linecrf.fit(docs, _labels(spark, sf_dir).where(fold("doc_id", 3) != 1))
    return linecrf.score(docs, model, keep=["doc_id", "held_out"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_documents(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _spans_of(kind: int) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"] < len(secrets.BASE))
    counts = [_spans_of(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return rows.select(
        "doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secret_spans")).alias("spans"),
    )


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_documents(spark, sf_dir), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.drop_lines(_documents(spark, sf_dir), least=10, keep=["doc_id"])
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_embeddings(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_embeddings(spark, sf_dir), label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT r, doc_id, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines FROM w),
g AS (SELECT r, unnest(range(1, n_words - 1)) AS i, ws FROM m WHERE n_words >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY r),
f AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 AS b0, 100 * n_repeat_words > 50 * n_words AS b1, 100 * n_symbols > 5 * word_chars AS b2,
        10 * word_chars < 20 * n_words AS b3, word_chars > 20 * n_words AS b4, 100 * n_dup_lines > 50 * n_lines AS b5 FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, b0 OR b1 AS base_failed,
  NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS kept,
  CAST(b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT AS BIGINT) AS rule_bits, 'prose/1' AS policy
FROM b
"""


def _op9_sql() -> str:
    """Spans of every rule from the lengths between and of its matches."""
    parts = []
    for i, rule in enumerate(secrets.RULES):
        quoted = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {i} AS k, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, o, g FROM (SELECT r, "
            f"regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {rule.group}) AS o, "
            f"string_split_regex(t, '{quoted}') AS g FROM d)"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(parts)}),
s AS (SELECT r, k, kind, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS b, length(m[i]) AS n
      FROM a WHERE length(o[i]) >= CASE k {least} END),
p AS (SELECT r, k, b, kind || ':' || b || ':' || (b + n) AS one FROM s),
q AS (SELECT r, {counts}, coalesce(string_agg(one, ',' ORDER BY b, k) FILTER (k < {len(secrets.BASE)}), '') AS base,
      string_agg(one, ',' ORDER BY b, k) AS spans FROM p GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN q USING (r)
"""


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY r
"""

OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, coalesce(vec_id, 9223372036854775807) AS id, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS ar, a.id AS aid, b.r, b.id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, r) <= 5),
m AS (SELECT p.aid, p.vec_id AS pid, n.vec_id AS nid, p.score AS ps, n.score AS ns,
    row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.score DESC, n.id, n.r) AS rank
  FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, nid AS negative_id, ps AS positive_score, ns AS negative_score
FROM m WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_token_files, op2_language, op3_quality_rules, op4_packing, op5_fingerprints,
        op6_mixing, op7_line_quality, op8_simhash, op9_secrets, op10_shards,
        op11_line_dedup, op12_whitening, op13_hard_negatives, pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op9_secrets": _op9_sql(), "op11_line_dedup": OP11_SQL, "op13_hard_negatives": OP13_SQL}
