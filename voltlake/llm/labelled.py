"""A bounded, labelled sample for fitting, and folds by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is in no fold (null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, use: Column, per_class: int, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each label (key, text, label), and how many rows each label has.

    Only label rows where ``use`` holds are looked at; a key labelled twice counts as 1 if any row says so;
    null labels are left out. The rows are the first by hash of the key, so any run takes the same. Their
    keys (2 * ``per_class`` at most) are broadcast; the documents are read once and not shuffled.
    """
    one = (
        labels.where(use & F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("sample_key")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    )
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("sample_key", F.lit("sample")), "sample_key")
    chosen = one.where("label = 0").orderBy(*order).limit(per_class).unionByName(
        one.where("label = 1").orderBy(*order).limit(per_class)
    )
    rows = docs.join(F.broadcast(chosen), docs[key] == chosen["sample_key"])
    return rows.select(F.col("sample_key").alias(key), F.coalesce(docs[text], F.lit("")).alias("text"), "label"), counts
