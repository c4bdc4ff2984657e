"""A training corpus from raw documents: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes each stage's result to the shared folder
and reads it again for the next.

1. quality: the line field scores every text; what it predicts to be bad goes.
2. near_dedup: components of texts whose SimHash fingerprints over four-word shingles differ
   in four bits or fewer; the smallest id of each stays.
3. secrets: every secret is replaced by the name of its kind; no document goes.
4. mixing: documents are repeated or left out so that the domains' tokens meet their
   targets; toxic text is never raised, what is certain to be clean stays at least once.
5. packing: token sequences of 2048 with hierarchical tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.llm import linecrf, mixing, packing, secrets, simhash
from nitrapanel.llm.coder import tokenizer_path
from nitrapanel.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_WORDS, NEAR_BITS = 4, 4
MOST_TOXIC = 0.005  # of the tokens; less where the table has less
TOKENIZER = "word_bpe_49k.json"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line field predicts to be good."""
    model = linecrf.fit(docs, _labels(spark, sf_dir))
    return linecrf.score(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; rows without an id stay only where no row of theirs has one."""
    return simhash.one_of_each(docs, NEAR_WORDS, NEAR_BITS).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced by the name of their kind."""
    rows = secrets.scan(docs)
    rows = rows.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_targets(present: dict[str, float]) -> dict[str, float]:
    """Toxic text is cut to its bound or left at its present share."""
    toxic = min(MOST_TOXIC, present.get("toxic", 0.0))
    return {"clean": 1 - toxic, "toxic": toxic} if "toxic" in present else present


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out by their fitted rates; domains are toxic and clean."""
    kinds = _labels(spark, sf_dir).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    labelled = docs.select("doc_id", "text").join(kinds.select("doc_id", domain.alias("domain")), "doc_id")
    model = mixing.fit(labelled)
    members = mixing.memberships(docs, model, tokenizer_path(TOKENIZER))
    plan = mixing.fit_rates(members, model.domains, mix_targets(mixing.shares(members, model.domains)))
    return mixing.apply_rates(docs, mixing.with_rates(members, plan)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path(TOKENIZER), end_id=1)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

# Trained models, XXH64 and a tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
