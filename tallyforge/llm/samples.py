"""Bounded samples of labelled rows for fitting; everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a sample brings to the driver at most: bytes of texts in all, and of one text (longer ones are scored, but not learned from).
SAMPLE_BYTES = 48 << 20
TEXT_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_sample(rows: DataFrame, label: str, each: int, *key: str) -> tuple[DataFrame, int]:
    """About ``each`` rows of every label value, chosen by a hash of ``key``, and the most rows to use."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n")).collect()  # a row for each label value
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(label) == r[0], F.lit(min(1.0, 1.15 * each / r["n"]))).otherwise(share)
    at = F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(at < share), int(1.3 * each * max(1, len(sizes)))


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of documents to learn from: not held out, with one label; contradictory ones aren't used."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    return rows.where("label = other").select("doc_id", "label")


def sample_by_class(rows: DataFrame, label: str, id_col: str, each: int) -> DataFrame:
    """About ``each`` rows of every label value, the same ones on every run, not more than 1.3 times."""
    chosen, most = in_sample(rows, label, each, id_col)
    return chosen.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), F.col(id_col)).limit(most)


def texts_to_fit(rows: DataFrame, most: int, total: int = SAMPLE_BYTES, longest: int = TEXT_BYTES) -> list[tuple[str, object]]:
    """(text, label) of rows (doc_id, text, label), equal rows once, in the order of a hash: ``most`` rows and ``total`` bytes at most.

    Sizes are gathered first, so that no more texts than fit leave the executors.
    """
    rows = rows.where(F.octet_length("text") <= longest).select("text", "label", F.xxhash64(F.lit("fit"), "doc_id", "text").alias("h"))
    sizes = rows.groupBy("h").agg(F.max(F.octet_length("text")).alias("n")).orderBy("h").limit(most).collect()
    last, used = None, 0
    for r in sizes:
        used += r["n"]
        if used > total:
            break
        last = r["h"]
    if last is None:
        return []
    got = rows.where(F.col("h") <= last).groupBy("h").agg(F.any_value("text").alias("text"), F.min("label").alias("label")).collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: r["h"])]
