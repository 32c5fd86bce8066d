"""A training corpus from raw documents, in five stages; each works on all that the stage before it kept.

1. quality: documents that the classifier rejects go.
2. near_dedup: one document of each group of near-duplicates stays.
3. pii: personal data in the texts are replaced with surrogates.
4. mixing: documents are repeated or left out so that tones match their target weights.
5. bpe: the texts are encoded; the last stage returns counts and digests.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm import bpe, mixing, near_dedup, pii, quality
from vantidal.llm.common import asked_for, without
from vantidal.session import forget, through_store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates of the pipeline: five words, similarity of 0.8 or more (0.85 is the rule of op1 alone). A pair at 0.8
#: shares no bucket with a probability of 5e-6; the sketch's cut is 5 deviations below 0.8.
LINKING = near_dedup.Linking(percent=80, cut=0.66)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score reaches the threshold. Fitted on labelled rows of `docs` that aren't held out.

    Null and empty texts have no word: their score is the labels' prior. A very long text is read in runs. Rows that
    repeat an id are scored each by its own text; a null id counts as held out. Further columns are left out.
    """
    m = quality.Model()
    table, net = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), m)
    out = quality.score(docs.select(*COLUMNS), table, net, m, keep=COLUMNS)
    return out.filter(F.col("__score") >= m.threshold).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, linking: near_dedup.Linking | None = None) -> DataFrame:
    """Keeps the document of least id of each component; rows with a null id all stay, and so do texts without a word.

    Rows that repeat an id with different texts are documents of their own: one goes by the id, the others come after all
    ids, and each goes only if it is linked with a kept document. Of identical rows a single one stays (the least in the
    order of the further columns).
    Only texts that a map of the dropped ids points at are shuffled. Further columns are left out.
    STAGES runs it with LINKING; without one it links as op1 does.
    """
    docs = docs.select(*COLUMNS)
    again = through_store(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    keyed = docs.withColumn("__key", F.col("doc_id"))
    if not again.isEmpty():
        h = F.xxhash64("doc_id", "text")
        rows = docs.join(again, "doc_id", "left_semi").withColumn("__h", h).groupBy("doc_id", "text", "__h").agg(F.min(F.struct("lang", "source", "n_chars")).alias("__row"))
        rows = through_store(rows, "repeats")
        least = through_store(rows.groupBy("doc_id").agg(F.min("__h").alias("__least")), "least")
        # One text of an id goes by the id, others by numbers beyond those that tables use.
        other = F.shiftrightunsigned("__h", 2).bitwiseOR(F.lit(1 << 62))
        key = F.when(F.col("__h") == F.col("__least"), F.col("doc_id")).otherwise(other)
        rows = rows.join(least, "doc_id").select("doc_id", "text", "__row.*", key.alias("__key")).select(*keyed.columns)
        keyed = through_store(keyed.join(again, "doc_id", "left_anti").unionByName(rows), "keyed")
    found = near_dedup.near_duplicates(keyed, linking, id_col="__key")
    gone = through_store(found.filter(~F.col("kept")).select("__key"), "gone")
    forget(found, again)
    return without(keyed, gone, "__key").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and n_chars counted anew.

    A null text stays null (its n_chars too) and an empty one empty. Rows that repeat an id, null ids included, are
    rewritten each, with the same surrogates. Further columns are left out.
    """
    out = pii.replace_entities(docs, pii.key_of(spark), keep=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says: 0 copies leave it out.

    Null and empty texts have the rate of the domains' shares. Rows that repeat an id, null ids included, are dealt
    with each by its own text. Further columns are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))  # what the rounding draws from too
    rates = mixing.mix(keyed, mixing.tones(labels), mixing.TARGETS, keep=("__key",))
    other = through_store(rates.filter("copies <> 1").groupBy("__key").agg(F.max("copies").alias("copies")), "copies")
    forget(rates)
    ids = other.select("__key")
    again = asked_for(keyed, ids, "__key").join(other.filter("copies > 0"), "__key")
    again = again.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return without(keyed, ids, "__key").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text for every row, repeated ones and null ids included.

    A null text counts as empty. A very long text is encoded in parts that no piece crosses.
    """
    return bpe.digests(docs, bpe.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", partial(near_dedup_stage, linking=LINKING)),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: No stage but the last is SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = through_store(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
