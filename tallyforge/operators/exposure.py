"""Tokens in regions of text: which region holds which fact, in which form, and where.

Regions: run_id, region_idx, seq, channel, text.  Cards: fact_id, token, pattern
(a paraphrase, or null).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions import tools as T
from tallyforge.operators.automaton import bare, with_tokens
from tallyforge.operators.prefix import running_sum

#: Cards that are looked for one by one in each text; more are one automaton.
BLOCK = 500


def bytes_before(regions: DataFrame) -> DataFrame:
    """Visible bytes of the run ahead of each region."""
    size = F.when(T.model_visible(F.col("channel")), F.octet_length(F.coalesce("text", F.lit("")))).otherwise(0).cast("long")
    rows = running_sum(regions.withColumn("_bytes", size), ["run_id"], "seq", ["region_idx"], "_bytes", "bytes_before")
    return rows.withColumn("bytes_before", F.col("bytes_before") - F.col("_bytes")).drop("_bytes")


def channel_histogram(regions: DataFrame) -> DataFrame:
    return regions.groupBy("channel").agg(F.count("*").alias("n"))


def scan(regions: DataFrame, cards: DataFrame) -> DataFrame:
    """One row a region and fact that it holds, with the strictest form, its place and its count.

    Cards are a registry, read at the driver. A small one, and all patterns, become expressions over each
    region's text, in blocks; the tokens of a large one are one automaton. Regions are neither shuffled nor
    multiplied before a match.
    """
    cards = cards.select("fact_id", "token", "pattern").where("token is not null and token <> ''")
    told = F.coalesce("pattern", F.lit("")) != ""
    plain, rest = cards.where(~told & (bare(F.col("token")) != "")), cards.where(told | (bare(F.col("token")) == ""))
    large = plain.limit(BLOCK + 1).count() > BLOCK
    listed = (rest if large else cards).orderBy("fact_id").collect()
    blocks = [listed[k : k + BLOCK] for k in range(0, len(listed), BLOCK)] or ([] if large else [[]])
    parts = [_scan_block(regions, b) for b in blocks] + ([_scan_held(regions, plain)] if large else [])
    return reduce(DataFrame.unionByName, parts)


def _hit(text: Column, fact: Column, token: Column, loose: Column, pattern: str | None = None) -> Column:
    """The strictest form in which a text holds a token, its place and its count; null where it doesn't."""
    low, lowtoken = F.lower(text), F.lower(token)
    bare, baretoken = X.strip_separators(text), X.strip_separators(token)
    form = F.when(F.contains(text, token), "exact").when(F.contains(low, lowtoken), "lower").when(F.contains(bare, baretoken), "nohyphen")
    form = form.when(text.rlike(pattern), "regex") if pattern else form
    at = F.when(form == "exact", F.instr(text, token)).when(form == "lower", F.instr(low, lowtoken)).when(form == "nohyphen", F.nullif(F.regexp_instr(text, loose), F.lit(0)))
    at = at.when(form == "regex", F.regexp_instr(text, F.lit(pattern))) if pattern else at
    n = F.when(form == "exact", F.regexp_count(text, _quoted(token))).when(form == "lower", F.regexp_count(low, _quoted(lowtoken))).when(form == "nohyphen", F.greatest(F.regexp_count(text, loose), F.lit(1)))
    n = n.when(form == "regex", F.regexp_count(text, F.lit(pattern))) if pattern else n
    return F.when(form.isNotNull(), F.struct(fact.alias("fact_id"), form.alias("match_form"), at.cast("int").alias("char_at"), n.cast("long").alias("n_hits")))


def _quoted(token: Column) -> Column:
    return F.concat(F.lit("\\Q"), token, F.lit("\\E"))


def _scan_block(regions: DataFrame, cards: list) -> DataFrame:
    if not cards:
        hits = F.array().cast("array<struct<fact_id:string,match_form:string,char_at:int,n_hits:bigint>>")
    else:
        text = F.coalesce("text", F.lit(""))
        each = (_hit(text, F.lit(c["fact_id"]), F.lit(c["token"]), F.lit(X.loose_pattern([c["token"]])), c["pattern"]) for c in cards)
        hits = F.filter(F.array(*each), lambda x: x.isNotNull())
        # one cheap look for any token's characters before the forms are told apart
        some = X.loose_pattern([c["token"] for c in cards])
        wide = "|".join([some, *(f"(?:{c['pattern']})" for c in cards if c["pattern"])])
        regions = regions.where(F.coalesce("text", F.lit("")).rlike(wide) | X.strip_separators(F.coalesce("text", F.lit(""))).rlike(some))
    return _told(regions.where(T.model_visible(F.col("channel"))).withColumn("hit", F.explode(hits)))


def _scan_held(regions: DataFrame, cards: DataFrame) -> DataFrame:
    """The same for many tokens without patterns: an automaton names those a text holds, and only they are told apart."""
    rows = with_tokens(regions.where(T.model_visible(F.col("channel"))), cards).where(F.size("held") > 0).withColumn("held", F.explode("held"))
    # a token's characters with up to two separators between them, in any case: as loose_pattern writes it
    characters = F.regexp_replace("token", "[-_ ]", "")
    loose = F.concat(F.lit("(?i)(?:"), F.array_join(F.transform(F.split(characters, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "[-_ ]{0,2}"), F.lit(")"))
    registry = cards.select(F.col("fact_id").alias("of_fact"), F.col("token").alias("of_token"), bare(F.col("token")).alias("of_bare"), loose.alias("of_loose"))
    rows = rows.join(registry, F.col("held") == F.col("of_bare"))
    rows = rows.withColumn("hit", _hit(F.coalesce("text", F.lit("")), F.col("of_fact"), F.col("of_token"), F.col("of_loose"))).where("hit is not null")
    return _told(rows)


def _told(rows: DataFrame) -> DataFrame:
    """Hits of regions as rows."""
    offset = F.coalesce(X.byte_offset(F.col("text"), F.col("hit.char_at")), F.lit(0)).cast("long")
    return rows.select("run_id", "hit.fact_id", "seq", "region_idx", "channel", "hit.match_form", offset.alias("offset"), "hit.n_hits", T.inbound(F.col("channel")).alias("inbound"), T.counts_toward_read(F.col("channel")).alias("counts_toward_read"), (T.inbound(F.col("channel")) & (F.col("hit.match_form") == "exact")).alias("sets_first_exposure"))


def first_exposure(rows: DataFrame) -> DataFrame:
    """The first row of each run and fact that sets exposure."""
    at = F.struct("seq", "region_idx")
    return rows.where("sets_first_exposure").groupBy("run_id", "fact_id").agg(F.min_by(F.struct("seq", "region_idx", "channel", "offset"), at).alias("f")).select("run_id", "fact_id", "f.*")


def loose_clashes(cards: DataFrame) -> DataFrame:
    """Pairs of tokens of which one holds the other in loose spelling.

    Each token's parts of the lengths that tokens have are looked up as whole tokens: a token of n characters
    makes at most n parts a length, and nothing is paired.
    """
    c = cards.select("fact_id", X.strip_separators(F.col("token")).alias("bare")).where("bare <> ''")
    sizes = c.agg(F.collect_set(F.length("bare")).alias("sizes"))  # one row of distinct lengths
    size = c.crossJoin(F.broadcast(sizes)).select("fact_id", "bare", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("bare"))
    parts = size.select("fact_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("bare") - F.col("size") + 1), lambda k: F.substring(F.col("bare"), k, F.col("size"))))).alias("part"))
    held = c.select(F.col("fact_id").alias("other"), F.col("bare").alias("other_bare"))
    both = parts.join(held, (F.col("part") == F.col("other_bare")) & (F.col("fact_id") != F.col("other")))
    return both.select(F.least("fact_id", "other").alias("fact_id"), F.greatest("fact_id", "other").alias("other")).distinct()


def events_with_hits(events: DataFrame, exposure: DataFrame) -> DataFrame:
    """Events with the list of facts that their regions hold."""
    hits = exposure.groupBy(F.col("run_id").alias("_run"), F.col("seq").alias("_seq")).agg(F.array_sort(F.collect_list(F.struct("region_idx", "fact_id", "channel", "offset", "match_form", "inbound"))).alias("nonce_hits"))
    return events.join(hits, (F.col("run_id") == F.col("_run")) & (F.col("seq") == F.col("_seq")), "left").drop("_run", "_seq")


def flattened_hits(events: DataFrame) -> DataFrame:
    """Counts and joined lists of an event's hits; null where there are none."""
    known = F.filter(F.col("nonce_hits"), lambda h: F.coalesce(h["inbound"], T.inbound(h["channel"])))
    joined = lambda f: F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform("nonce_hits", lambda h: h[f]))), "|"), F.lit(""))
    return events.select("run_id", "seq", F.coalesce(F.nullif(F.size("nonce_hits"), F.lit(-1)), F.lit(0)).cast("long").alias("n_hits"), F.coalesce(F.nullif(F.size(known), F.lit(-1)), F.lit(0)).cast("long").alias("n_inbound"), joined("fact_id").alias("fact_ids"), joined("channel").alias("channels"))
