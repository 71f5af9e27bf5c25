"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Targets: the sources, by code point with null last, weigh 1, 2, 3, repeating, and share all sizes; a target stops
at MAX_EPOCHS times its source's size, and what it cannot take goes to the others by weight (water filling).
The mix is dealt out in blocks of ``block`` words: seats go to the sources by the highest quotients
target / (2k - 1), and a source's seats in the same way to groups of GROUP shards and a group's seats to its shards.
A shard is a seeded hash bucket of about ``shard_words`` words, however large the source; its documents lie in seeded
order on one axis, and its quota is a cyclic run of blocks that begins at a seeded block, so whole passes first and
then part of one.

A source of any share of the rows is spread over its shards, and only sums travel before that. One task ranks the
sources, a row each, one the groups of a source (a row for GROUP * shard_words words of it), and one a group's shards.

Defined results: a null or wordless text has size 0 and takes 0; null is a source of its own, as is the empty
string; repeated rows are separate documents; rows that share id and size are ordered by all their values; of equal
quotients the first source or shard wins; very long texts count whole; nothing is taken from an empty table; columns
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import WORD, stash

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Shards that share in the seats of one group; only the number of groups grows with a source.
GROUP = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (__null, __src, __total) with the target of each: one row a source, so one small window."""
    by_name = sources.withColumn("__w", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.row_number().over(Window.orderBy("__null", "__src")) - 1) % len(WEIGHTS) + 1).cast("int")))
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("__total") * MAX_EPOCHS
    upto = Window.orderBy(F.col("__total") / F.col("__w"), "__null", "__src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # With the sources by the level at which they fill up: the level at which the rest meets what is left.
    filled = by_name.withColumn("__before", F.sum(cap).over(upto) - cap).withColumn("__rest", F.sum("__w").over(all_) - F.sum("__w").over(upto) + F.col("__w"))
    filled = filled.withColumn("__level", (F.sum("__total").over(all_) - F.col("__before")) / F.col("__rest"))
    open_ = F.max(F.when(F.col("__level") * F.col("__w") <= cap, F.col("__level"))).over(all_)
    return filled.withColumn("__target", F.least(cap.cast("double"), F.coalesce(F.col("__w") * open_, cap.cast("double")))).select("__null", "__src", "__total", "__target")


def seats(votes: DataFrame, by: list[str], order: list[str], vote: str, total: str, out: str) -> DataFrame:
    """Sainte-Lague: column out holds the seats of each row of a group ``by``, out of ``total`` seats.

    The final divisor differs from sum(vote) / total so little that a row's seats differ from its rounded share by
    at most vote / sum(vote) * (n / 2 + 1) + 1, n being the rows of the group. So only those few quotients are
    ranked, about four a row, never all seats. Ties go to the first in ``order``.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    v = votes.withColumn("__sum", F.sum(vote).over(group)).withColumn("__n", F.count(F.lit(1)).over(group))
    share = F.when(F.col("__sum") > 0, F.col(vote) / F.col("__sum")).otherwise(F.lit(0.0))
    near = F.floor(share * F.col(total) + 0.5)
    slack = F.ceil(share * (F.col("__n") / 2 + 1)) + 1
    v = v.withColumn("__low", F.greatest(F.lit(0).cast("long"), near - slack)).withColumn("__high", F.when(F.col(vote) > 0, near + slack).otherwise(F.lit(0).cast("long")))
    v = v.withColumn("__left", F.col(total) - F.sum("__low").over(group))
    k = v.where("__high > __low").withColumn("__k", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))))
    rank = F.row_number().over(group.orderBy(F.desc(F.col(vote) / (2 * F.col("__k") - 1)), *order, "__k"))
    keys = [*by, *order]
    won = k.withColumn("__rank", rank).where("__rank <= __left").groupBy(*keys).agg(F.count("*").alias("__won"))
    return v.join(won, keys, "left").withColumn(out, F.col("__low") + F.coalesce("__won", F.lit(0).cast("long"))).drop("__sum", "__n", "__low", "__high", "__left", "__won")


def mix(docs: DataFrame, *, size_col: str = "size", source_col: str = "source", id_col: str = "doc_id", block: int = 16, shard_words: int = 65_536, group: int = GROUP, seed: int = 42) -> DataFrame:
    """docs with source_size, target and taken (words the mix takes of the row, repeats counted).

    docs is read three times; give a written table where its size column is dear. Any further columns are carried.
    """
    own = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    rows = docs.select(*own).withColumn("__null", F.col(source_col).isNull()).withColumn("__src", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    key = ["__null", "__src"]
    sources = rows.groupBy(*key).agg(F.sum(size_col).alias("__total"))
    aimed = targets(sources).withColumn("__blocks", F.floor(F.sum("__target").over(Window.partitionBy()) / block))
    aimed = seats(aimed, [], key, "__target", "__blocks", "__seats").withColumn("__shards", F.greatest(F.lit(1), F.ceil(F.col("__total") / shard_words)).cast("long"))
    # Written first, so that the planner knows its size: no row of docs moves for a short list of sources.
    dealt = rows.join(stash(aimed.select(*key, "__total", "__target", "__seats", "__shards"), "mix-sources"), key)
    dealt = dealt.withColumn("__seed", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("__shard", F.pmod(F.xxhash64("__seed", F.lit(1)), F.col("__shards")))
    shard = [*key, "__shard"]
    held = dealt.groupBy(*shard).agg(F.sum(size_col).alias("__words"), F.first("__seats").alias("__all")).withColumn("__group", F.floor(F.col("__shard") / group))
    groups = seats(held.groupBy(*key, "__group").agg(F.sum("__words").alias("__sum_words"), F.first("__all").alias("__all")), key, ["__group"], "__sum_words", "__all", "__part").select(*key, "__group", "__part")
    quota = stash(seats(held.join(groups, [*key, "__group"]), [*key, "__group"], ["__shard"], "__words", "__part", "__quota").select(*shard, "__words", "__quota"), "mix-quotas")
    axis = Window.partitionBy(*shard).orderBy("__seed", id_col, size_col, F.xxhash64(*own)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Dealt by shard at any rate: were the join's partitioning by source kept, a large source would be one task.
    laid = dealt.repartition(*shard).withColumn("__end", F.sum(size_col).over(axis)).join(quota, shard)
    take = F.least(F.col("__quota") * block, F.col("__words") * MAX_EPOCHS)
    laid = laid.withColumn("__run", F.when(F.col("__words") > 0, take % F.col("__words")).otherwise(0)).withColumn("__full", F.when(F.col("__words") > 0, F.floor(take / F.col("__words"))).otherwise(0).cast("long"))
    blocks = F.ceil(F.col("__words") / block)
    laid = laid.withColumn("__from", F.when(F.col("__words") > 0, F.pmod(F.xxhash64(*shard, F.lit(seed)), blocks) * block).otherwise(0))
    start, end = F.col("__end") - F.col(size_col), F.col("__end")
    upto = F.col("__from") + F.col("__run")
    zero = F.lit(0).cast("long")
    part = F.greatest(zero, F.least(end, upto) - F.greatest(start, F.col("__from"))) + F.greatest(zero, F.least(end, upto - F.col("__words")) - start)
    taken = (F.col("__full") * F.col(size_col) + part).cast("long")
    return laid.withColumn("taken", taken).withColumn("source_size", F.col("__total").cast("long")).withColumn("target", F.col("__target")).select(*own, "source_size", "target", "taken")


def materialize(mixed: DataFrame, *, size_col: str = "size") -> DataFrame:
    """The mix as rows: each document as often as its taken words, rounded to whole copies, ask for.

    Only the two documents at the ends of a shard's run are taken in part, so rounding moves few words.
    """
    copies = F.when(F.col(size_col) > 0, F.floor((2 * F.col("taken") + F.col(size_col)) / (2 * F.col(size_col)))).otherwise(0).cast("int")
    return mixed.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).drop("__copy")
