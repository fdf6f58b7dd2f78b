"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. It sets a small Arrow
batch for the session, as its lazy part runs after it has returned. All but the
last return the columns of ``documents``. Results that depend on a text alone
are joined by the text's digest, so null and repeated ids need no care.

Defined cases: a document without letters, or whose language stays unlikely, is
rejected; a document with a null id is never a copy of another; rows that share
an id are one document, of which the smallest text stays, and of equal texts the
row whose other columns come first as JSON; a null text is rejected by the first
stage; extra columns are kept under their own names; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import langid
from tidelake.llm.bpe import encode, text_key
from tidelake.llm.decontaminate import contamination
from tidelake.llm.jaccard import similar_groups
from tidelake.llm.q_bpe import TOKENIZER
from tidelake.llm.q_langid import held_out
from tidelake.llm.secrets import find_secrets, redacted
from tidelake.session import materialize

#: A document goes if no language is at least this likely.
LEAST_LIKELY = 0.4
_KEY = "_pipeline_text_key"
#: Rows of an Arrow batch; a row is a whole text here, so Spark's default of 10,000 fills a worker.
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for the session; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones are written in."""
    _small_batches(spark)
    model = langid.train(docs, ~held_out())
    # own names, so that no column of the documents can clash with a result
    names = {c: "text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = langid.predict(renamed, model, *names.values())
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LIKELY))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of linked ones."""
    _small_batches(spark)
    groups = similar_groups(docs)
    heads = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # rows that share an id and a text are told apart by the rest of the row, as text
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    order = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*rest)) if rest else F.lit(""))
    once = kept.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("_least"))
    least = F.col("_least")
    return once.select(*[least[c].alias(c) for c in docs.columns]).union(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    _small_batches(spark)
    keyed = docs.withColumn(_KEY, text_key(F.col("text")))
    found = contamination(keyed.select(F.col(_KEY).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter(F.size("runs") > 0).select(F.col("doc_id").alias(_KEY)).distinct()
    return keyed.join(hit, _KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars follows the text."""
    _small_batches(spark)
    keyed = docs.withColumn(_KEY, text_key(F.col("text")))
    found = find_secrets(keyed.select(F.col(_KEY).alias("doc_id"), "text")).filter(F.size("spans") > 0)
    spans = found.groupBy(F.col("doc_id").alias(_KEY)).agg(F.first("spans").alias("_pipeline_spans"))
    joined = keyed.join(spans, _KEY, "left")
    has = F.col("_pipeline_spans").isNotNull()
    text = F.when(has, redacted(F.col("text"), F.col("_pipeline_spans"))).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(has, F.length(text).cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return joined.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids, as little-endian unsigned 32-bit integers."""
    _small_batches(spark)
    ids = encode(docs, TOKENIZER, "doc_id")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("tokenize", tokenize),
]

#: A fitted model and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
