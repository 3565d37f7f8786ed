"""Mixing sources to target weights by subset-sum budget fitting.

Each source's budget is met by whole passes over its documents, and the rest by a subset of them:
documents are counted by exact length; each length gives its share, rounded down; a bounded knapsack
over the lengths' remaining counts fills what is left; then so many documents of each length are
picked in a seeded order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from heddle.llm.common import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: A document is taken at most so often, and no source gets more than so many times its size.
MAX_REPEATS = 3
#: Words of a source's budget that are left to the knapsack, at least.
KNAPSACK_WORDS = 1 << 16
#: Documents of each length that the knapsack may decide anew.
GIVEN_BACK = 8
#: Documents of one source and length that are ordered together.
GROUP_ROWS = 10_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, weigh `weights`, repeating. They share the sum of all
    sizes; a target stops at `max_repeats` times its source's size and the excess is shared again by
    weight until none is above. The level at which that ends is found by sorting the sources by
    where they stop: windows over one row a source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    capped = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_repeats).alias("cap"))
    up = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    run = capped.select("*", F.coalesce(F.sum("cap").over(up), F.lit(0)).alias("caps"), F.coalesce(F.sum("w").over(up), F.lit(0)).alias("ws"), F.sum("source_size").over(all_).alias("total"), F.sum("w").over(all_).alias("w_all"))
    # the first source, in that order, that isn't stopped sets the level of all that follow
    level = (F.col("total") - F.col("caps")) / (F.col("w_all") - F.col("ws"))
    run = run.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("w") * F.col("level"))
    reached = F.max(F.when(~F.col("stops"), F.col("level"))).over(all_)
    return run.withColumn("reached", reached).select("source", "source_size", F.when(F.col("stops") | F.col("reached").isNull(), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("reached")).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, knapsack_words: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near `budget` as they can, not above.

    Every length gives its share first, but for a few documents. Long lengths then fill down to
    `knapsack_words`, and bounded knapsack dynamic programming over the counts left finds the best
    sum below that.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    took = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    rest = budget - sum(n * t for n, t in zip(lengths, took, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    for i in order:
        if rest > knapsack_words:
            more = min(counts[i] - took[i], (rest - knapsack_words) // lengths[i])
            took[i] += more
            rest -= more * lengths[i]
    for i in reversed(order):  # a few short documents of each length back, so that the knapsack has room
        back = max(0, min(took[i], GIVEN_BACK, (knapsack_words - rest) // lengths[i]))
        took[i] -= back
        rest += back * lengths[i]
    # bit w of reach: a sum of w words can be had; grown[k]: the bits that the k-th item added
    reach, mask, grown = 1, (1 << (rest + 1)) - 1, []
    for i in order:
        left = min(counts[i] - took[i], rest // lengths[i])
        size = 1
        while left > 0 and not reach >> rest & 1:
            k = min(size, left)
            new = (reach << (k * lengths[i])) & mask & ~reach
            if new:
                grown.append((i, k, new))
                reach |= new
            left -= k
            size *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, k, new in reversed(grown):
        if new >> at & 1:
            took[i] += k
            at -= k * lengths[i]
    return took


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size, source_size, target, passes, extra, n) by source and length, from (source, size) rows.

    `passes` times every document is taken, and `extra` of the length's `n` documents once more. The
    knapsack runs for each source on its counts by length, not on its documents.
    """
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats)
    joined = hist.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        size, target = int(pdf.source_size[0]), float(pdf.target[0])
        passes = min(int(target // size), max_repeats) if size else 0
        budget = round(target - passes * size) if passes < max_repeats else 0
        return pdf.assign(passes=passes, extra=fit(pdf["size"].tolist(), pdf["n"].tolist(), budget) if budget > 0 else 0)

    return joined.groupBy("source").applyInPandas(solve, "source string, size long, n long, source_size long, target double, passes long, extra long")


def taken(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`sized` (id, source, size, perhaps mark) with source_size, target and `copies`, how often the mix takes the row.

    Within a source and length documents are ordered by a seeded hash, then by id and mark. A length of many documents is
    parted by hash into groups of about GROUP_ROWS; the groups before the one where the wanted number
    ends are taken whole, so that only one group needs its rows ordered, however many copies share a length.
    """
    named = [c for c in ("id", "mark") if c in sized.columns]
    plans = materialise(plan(sized, weights, max_repeats), "mix-plan")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_ROWS))
    p = plans.select(F.col("source").alias("__s"), F.col("size").alias("__n"), "n", "source_size", "target", "passes", "extra")
    rows = sized.join(p, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__n"))).drop("__s", "__n")
    rows = materialise(rows.withColumn("u", F.xxhash64(*named, F.lit(seed))).withColumn("g", F.pmod(F.shiftright("u", 20), parts)), "mix-rows")
    groups = rows.groupBy("source", "size", "g", "extra").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("source", "size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("g").alias("__g"), "c", (F.col("extra") - before).alias("left"))
    rows = rows.join(groups, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__n")) & (F.col("g") == F.col("__g"))).drop("__s", "__n", "__g")
    whole = rows.where("left <= 0 or left >= c").withColumn("more", (F.col("left") > 0).cast("long"))
    ordered = F.row_number().over(Window.partitionBy("source", "size", "g").orderBy("u", *named))
    split = rows.where("left > 0 and left < c").withColumn("more", (ordered <= F.col("left")).cast("long"))
    return whole.unionByName(split).select(*named, "source", "size", "source_size", "target", (F.col("passes") + F.col("more")).alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """One row a row of `docs`: doc_id, size, source_size, target, taken (words that the mix takes of it).

    Null and empty texts have size 0 and are taken with 0 words; null sources form one source, the
    last; rows with equal ids are ordered by id only and stay apart; an empty table gives an empty
    result; other columns are ignored. Runs agree, as the order comes from ids and the seed.
    """
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    out = taken(sized, weights, seed)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix itself: every row of `docs`, with its columns, as often as it is taken.

    Rows without words, null texts among them, add nothing to a budget and are taken as often as their
    source's whole passes. Copies are looked up by id, source and the text's hash, so rows that share
    an id are told apart by their texts; of rows equal in all three each gets its even share, and where
    that leaves a rest the hash of their plain columns tells who gets it. Null sources form one source.
    An empty table stays empty; columns may have any names. Texts are shuffled once.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text, source = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col, source_col))
    rows = docs.toDF(*names).withColumn("mark", F.xxhash64(text))
    sized = materialise(rows.select(id_.alias("id"), source.alias("source"), word_count(text).alias("size"), "mark"), "mix-sizes")
    keys = taken(sized, weights, seed).groupBy(F.col("id").alias("__i"), F.col("source").alias("__s"), F.col("mark").alias("__m")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    keys = materialise(keys.where("copies > 0"), "mix-copies")
    met = rows.join(keys, id_.eqNullSafe(F.col("__i")) & source.eqNullSafe(F.col("__s")) & (F.col("mark") == F.col("__m")))
    even = met.where("copies % n = 0").withColumn("times", F.expr("copies div n"))
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    place = F.row_number().over(Window.partitionBy("__i", "__s", "__m").orderBy(F.xxhash64(*plain)))
    rest = met.where("copies % n <> 0").withColumn("place", place).withColumn("times", F.expr("copies div n + if(place <= copies % n, 1, 0)")).drop("place")
    out = even.unionByName(rest).where("times > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*names).toDF(*docs.columns)


def op2_mix_sources(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
