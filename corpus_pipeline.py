"""The corpus pipeline: documents in, training sequences out.

``STAGES`` are applied in order, each to all that the one before kept: toxic
documents go, one document of each group of near duplicates stays, documents
that overlap a benchmark item go, secrets are masked in the texts, and what is
left is packed into sequences. Every stage's result is written and read again,
so a lost executor costs the tasks of one stage.

Stages keep every column of the documents, whatever its name. Rows are told
apart by id and text, null ids included; blank texts are nobody's duplicates;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm import toxicity
from shopflow.llm.decontaminate import contamination
from shopflow.llm.ngram_join import ngram_classes
from shopflow.llm.packing import pack
from shopflow.llm.secret_scan import redact_secrets
from shopflow.llm.store import Store
from shopflow.sources.tables import read_table

#: Near duplicates: shingles of five words, Jaccard similarity of at least 0.8.
WORDS, SIMILAR = 5, (80, 100)
#: Keys of rejected rows (16 bytes each) that are broadcast at most.
BROADCAST_KEYS = 500_000


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Columns named by position, so that no name can clash; the id's and text's."""
    names = docs.columns
    return (docs.toDF(*[f"c{i}" for i in range(len(names))]),
            f"c{names.index('doc_id')}", f"c{names.index('text')}")


def _without(docs: DataFrame, id_col: str, text_col: str, rejected: DataFrame) -> DataFrame:
    """Rows whose (id, xxhash64 of the text) is not among ``rejected``."""
    keys = rejected.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, docs[id_col].eqNullSafe(keys["_id"])
                     & (F.xxhash64(docs[text_col]) == keys["_key"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, id_col, text_col = _plain(docs)
    texts = plain.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = toxicity.fit(texts, read_table(spark, sf_dir, "labels"))
    kept = toxicity.toxicity_scores(plain, model, text_col).where("toxic_score < 0.5")
    return kept.select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id (then text hash) of each group stays."""
    plain, id_col, text_col = _plain(docs)
    store = Store(spark, "near-duplicates")
    rows = store.save(ngram_classes(plain, WORDS, *SIMILAR, id_col, text_col)
                      .where("class_id is not null"), "classes")
    # Written, so that the join below has two plain sides and a hot class is split.
    stays = store.save(rows.groupBy("class_id").agg(F.min(F.struct(
        F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("k")).select(
        "class_id", F.col("k.id").alias("kept_id"), F.col("k.text_key").alias("kept_key")), "stays")
    judged = rows.join(stays, "class_id").withColumn(
        "stays", F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")))
    rejected = store.save(judged.where("not stays").select("id", "text_key").distinct(), "rejected")
    left = _without(plain, id_col, text_col, rejected)
    if judged.where("stays").count() > stays.count():
        # The same row several times: one of them stays; blank texts all do.
        again = store.save(rows.select("id", "text_key").distinct(), "keys")
        keyed = left.withColumn("_key", F.xxhash64(text_col))
        on = keyed[id_col].eqNullSafe(again["id"]) & (keyed["_key"] == again["text_key"])
        left = keyed.join(again, on, "left_semi").dropDuplicates([id_col, "_key"]).unionByName(
            keyed.join(again, on, "left_anti")).drop("_key")
    return left.toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, id_col, text_col = _plain(docs)
    found = contamination(plain, read_table(spark, sf_dir, "benchmark"), id_col, text_col)
    rejected = Store(spark, "contaminated").save(
        found.select(F.col(id_col).alias("id"), "text_key").distinct(), "rejected")
    return _without(plain, id_col, text_col, rejected).toDF(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; n_chars, where known, follows the text."""
    plain, _, text_col = _plain(docs)
    masked = redact_secrets(plain, text_col)
    if "n_chars" in docs.columns:
        own = f"c{docs.columns.index('n_chars')}"
        masked = masked.withColumn(own, F.when(
            F.col(own).isNotNull() & F.col(text_col).isNotNull(),
            F.length(text_col).cast(dict(plain.dtypes)[own])).otherwise(F.col(own)))
    return masked.toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, id_col, text_col = _plain(docs)
    return pack(plain, id_col, text_col).withColumnRenamed(id_col, "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Fitting, growing overlaps and tokenizing are beyond SQL; tests/llm compares the
#: pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name)
        store.drop(before)
        before = docs
    return docs
