"""Corpus pipeline: stages over documents, each written as Parquet and read by the next.

Language identification drops documents without a language, near-duplicate search keeps
the smallest doc_id of each group (a document is a doc_id with a text), personal data is
replaced by marks, sources are mixed to their target weights and the result is encoded.

Defined cases, by stage:

* language: a null or empty text, or one without a letter, goes; so does a text of which
  no language has MIN_SHARE.  Without any labelled row nothing else goes.
* near_duplicates: a null doc_id is larger than any other; different texts under one
  doc_id, or under none, are different documents; rows equal in doc_id and text are one
  document, and the first by their other columns stays; a null text counts as empty, and
  texts without words are near no other, so one for each doc_id stays.
* personal_data: null stays null; n_chars, if there, is counted anew.
* mixing: rows without words are taken never, a null source is a source; rows equal in
  doc_id, text and source are taken equally often; a document taken twice has two rows.
* encoding: null text has no ids; the other columns stay, and a column ids is replaced.

Repeated rows go through every stage one by one but for near_duplicates; very long texts
are read in steps; an empty table gives an empty one; columns beyond those of documents
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import fresh, join_counted, shared_path, sieved, stored
from auditlake.llm.op1_pii import find_personal_data, train_tagger
from auditlake.llm.op4_bpe import encode
from auditlake.llm.op6_langid import UNKNOWN, learn, predict
from auditlake.llm.op7_minhash import near_duplicates
from auditlake.llm.op8_mixing import mixed

#: Documents whose largest language has a smaller share are rejected, as are those without a letter.
MIN_SHARE = 0.4
#: Near duplicates share so many percent of their shingles of so many words.
SHINGLE_WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    langs, table = learn(docs.select("doc_id", "text", "lang"))
    pred, share = fresh(docs, "_lang_pred"), fresh(docs, "_lang_share")
    found = predict(docs, langs, table, (pred, share))
    # without labelled rows nothing can be told apart, and only texts without a letter go
    keep = (F.col(pred) != UNKNOWN) & (F.col(share) >= MIN_SHARE) if langs else F.col("text").rlike(r"\p{L}")
    return found.where(keep).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows that repeat a doc_id and its text are one document
    key, kept_id, kept_key, row, mark = (fresh(docs, c) for c in ("_key", "_kept_id", "_kept_key", "_row", "_mark"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE_WORDS, PERCENT)
    found = found.select(F.col("doc_id").alias(key), "component_id").distinct()
    each = stored(keyed.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("copies")).join(found, key), "each")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))
    least = each.groupBy("component_id").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"))
    kept = stored(least.select("component_id", F.col("x.doc_id").alias(kept_id), F.col("x.key").alias(kept_key), "n", "rows"), "kept")
    same = (F.col(key) == F.col(kept_key)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    # only documents that go, or that have several rows, are joined with those kept; all others stay where they lie
    judged = join_counted(each, kept.where("rows > 1"), ["component_id"], "n").where(~same | (F.col("copies") > 1))
    marked = sieved(keyed, key, stored(judged.select(key), "judged"), mark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.to_json(F.struct(*others)) if others else F.lit("")
    picked = marked.where(mark).join(kept.select(kept_id, kept_key), same, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), first).alias(row))
    return marked.where(~F.col(mark)).select(*docs.columns).union(picked.select(f"{row}.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = find_personal_data(docs, train_tagger(docs), redact=True)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]

#: Trained models, seeded draws and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
