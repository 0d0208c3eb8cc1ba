"""The corpus pipeline: documents through language ID, near-dedup, decontamination, mixing and token output.

Each stage works on all that the one before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bagminhash, langid, mixing, tokens, wumanber
from tallyforge.llm.common import table, unused, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the machines know; rows are judged one by one, whatever their ids.

    Null and empty texts and those without letters go, as do texts of which the machines know too
    little. Very long texts are judged whole. Repeated rows share a verdict, an empty
    table stays empty, and extra columns stay, whatever their names.
    """
    return langid.known(docs, langid.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the least id, null ids last.

    Of different texts under that id (or without id) the least by MD5 stays; of rows equal in id and text, one.
    Rows whose text has no words all stay. Null ids and repeated ids are no reason to
    go. Very long texts are compared whole; an empty table stays empty, extra columns stay.
    """
    return bagminhash.without_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows.

    Rows are judged one by one: null and empty texts stay, as do null and repeated ids; a very long text is
    searched whole; an empty table or benchmark removes nothing; extra columns stay.
    """
    return wumanber.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: no time to three times each.

    Every row is a document, null and repeated ids included; a null source is a source. A text without
    words has size 0 and isn't taken. The one document that the budget cuts counts if half of it
    is taken. An empty table stays empty; extra columns stay.
    """
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token file of all rows, in ascending id order (null ids first, ties by text).

    A null or empty text has the end id alone; every repeat of a row is written;
    an empty table gives an empty file; other columns aren't read.
    """
    return tokens.token_digest(docs)


STAGES = [("language ID", known_language), ("MinHash near-dedup", without_copies), ("benchmark decontamination", decontaminated), ("mixing sources to target weights", mixed), ("token-ID output", token_output)]

#: The stages are models, sketches and a codec, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
