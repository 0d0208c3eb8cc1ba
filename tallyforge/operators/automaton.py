"""Many tokens in many texts: one automaton over bare texts, shipped once and built once a worker.

A bare text is in lower case and without separators; a token that a text holds in any spelling is held by
the bare text in its bare spelling, so that one pass finds all candidates, whatever their number, and a plan
stays the same size.  Texts come in Arrow batches; what comes back is the bare tokens found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyforge.functions import text as X

_built: dict[str, object] = {}


def _automaton(key: str, tokens: list[str]):
    """The automaton of a registry; a worker keeps the last one."""
    if key not in _built:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for token in tokens:
            machine.add_word(token, token)
        machine.make_automaton()
        _built.clear()
        _built[key] = machine
    return _built[key]


def holder(spark: SparkSession, tokens: list[str]) -> Callable[[Column], Column]:
    """A function of a bare text's column: the distinct tokens it holds, in order. Tokens are bare; empty ones aren't looked for."""
    wanted = sorted({t for t in tokens if t})
    shipped = spark.sparkContext.broadcast(wanted)
    key = f"{spark.sparkContext.applicationId}/{shipped._jbroadcast.id()}"

    @pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(key, shipped.value) if shipped.value else None
        for own in texts:
            yield pd.Series([sorted({t for _, t in machine.iter(x)}) if machine is not None and x else [] for x in own], dtype=object)

    return found


def bare(text: Column) -> Column:
    return X.strip_separators(F.coalesce(text, F.lit("")))


def with_tokens(texts: DataFrame, cards: DataFrame, text: str = "text", name: str = "held") -> DataFrame:
    """``texts`` with the bare tokens of the cards (a registry, read at the driver) that each holds."""
    tokens = [r[0] for r in cards.where("token is not null").select(bare(F.col("token"))).distinct().collect()]
    return texts.withColumn(name, holder(texts.sparkSession, tokens)(bare(F.col(text))))
