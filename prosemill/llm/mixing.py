"""Mixing sources to target weights (problem 1).

Each configuration asks for a pool of so many records with a target share per
source. Records get a hash-random key per configuration and are ordered by it
within their source; exact prefix sums of size over hash ranges say where a
source's budget ends. A source that is too small is repeated in whole epochs,
up to the cap, and the last epoch is cut at the exact budget.

The size of a record is 1 (shares of records, as the project's pools are sized)
or a token count (``size="tokens"``; the record that crosses the budget is
left out).

Shares: null and negative shares count as 0 and the rest are scaled to add up
to 1. What a source can't supply within the cap goes to the others in
proportion to their shares, as far as they have records left; sources of share
0 stay out. If all together can't fill the pool it comes out smaller. Sources
and configurations are few, so the budgets are a window over a small table.

Records delivered again (same id) count once, the last loaded; records with the
same words under several ids count as one, the smallest id, so the cap holds
for texts; blank texts are left out, as are texts under min_words; longer ones
count max_words. All copies of a record are in the same split, so nothing
leaks from training to test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.ranks import hash_key, prefix_sums, spread_sums
from prosemill.session import durable

RANGES = 256


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def unique_records(df: DataFrame, key: str, text: str, newest: str) -> DataFrame:
    """(key, source, words): one row per distinct text of the last delivery of each key.

    Texts are reduced to a digest in the map stage; only digests are shuffled.
    """
    norm = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    d = df.select(
        F.col(key).alias("__id"), F.col(newest).alias("__at"), word_count(F.col(text)).alias("__words"),
        F.xxhash64(F.lit(3), norm).alias("__h1"), F.xxhash64(F.lit(5), norm).alias("__h2"),
    ).filter("__id IS NOT NULL")
    last = d.groupBy("__id").agg(F.max_by(F.struct("__words", "__h1", "__h2"), F.struct("__at", "__h1", "__h2")).alias("r"))
    last = last.filter("r.__words > 0")
    return last.groupBy("r.__h1", "r.__h2").agg(F.min("__id").alias(key), F.max("r.__words").alias("words")).select(key, "words")


def budgets(targets: DataFrame, group: str, source: str, rounds: int) -> DataFrame:
    """(group, source, budget) from (group, source, share, capacity, total).

    ``rounds`` water-filling steps, at least the number of sources: each gives
    the unplaced rest to sources with room, by share.
    """
    share = F.greatest(F.coalesce(F.col("share"), F.lit(0.0)), F.lit(0.0))
    d = targets.withColumn("__share", share).withColumn("budget", F.lit(0.0))
    w = Window.partitionBy(group)
    for _ in range(rounds):
        room = F.when(F.col("budget") < F.col("capacity"), F.col("__share")).otherwise(0.0)
        d = d.withColumn("__open", room)
        d = d.withColumn("__all", F.sum("__open").over(w)).withColumn("__rest", F.col("total") - F.sum("budget").over(w))
        more = F.when(F.col("__all") > 0, F.col("__rest") * F.col("__open") / F.col("__all")).otherwise(0.0)
        d = d.withColumn("budget", F.least(F.col("capacity").cast("double"), F.col("budget") + more))
    # whole records: largest remainders, never above capacity
    d = d.withColumn("__floor", F.floor(F.col("budget") + 1e-6)).withColumn("__part", F.col("budget") - F.col("__floor"))
    d = d.withColumn("__short", F.round(F.sum("budget").over(w)) - F.sum("__floor").over(w))
    d = d.withColumn("__rank", F.row_number().over(w.orderBy(F.desc("__part"), source)))
    up = (F.col("__rank") <= F.col("__short")) & (F.col("__floor") < F.col("capacity"))
    return d.withColumn("budget", (F.col("__floor") + F.when(up, 1).otherwise(0)).cast("long"))


class Mix:
    """A mixture of ``records`` (key, source, words) by ``configs``.

    configs: config, total, max_repeats, min_words, max_words, seed and
    ``shares``, an array of struct(source, share). Few rows; one per pool.
    """

    def __init__(self, records: DataFrame, configs: DataFrame, key: str, size: str = "records", sources: int = 8) -> None:
        self.key, self.size = key, size
        conf = configs.select("config", "total", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"), "min_words", "max_words", "seed")
        d = records.join(F.broadcast(conf), (F.col("words") >= F.coalesce("min_words", F.lit(0))), "inner")  # one row per pool: bounded by the configurations
        d = d.withColumn("tokens", F.least("words", F.coalesce("max_words", "words")).cast("long"))
        d = d.withColumn("weight", F.lit(1).cast("long") if size == "records" else F.col("tokens"))
        d = d.withColumn("__key", hash_key(F.col("seed"), F.col(key)))
        self.candidates = d.select("config", "source", key, "tokens", "weight", "__key")
        have = self.candidates.groupBy("config", "source").agg(F.sum("weight").alias("supply"))
        asked = configs.select("config", "total", "max_repeats", F.explode("shares").alias("s")).select("config", "total", "max_repeats", "s.source", "s.share")
        self.targets = (
            asked.join(have, ["config", "source"], "left")
            .withColumn("supply", F.coalesce("supply", F.lit(0)))
            .withColumn("capacity", F.col("supply") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)))
        )
        # a few rows that every later step uses: written once, so that plans stay small
        self.budgets = durable(budgets(self.targets, "config", "source", sources))

    def repeats(self) -> DataFrame:
        """(config, source, key, tokens, weight, repeats) of the records in each pool."""
        rows, offsets = spread_sums(self.candidates, ["config", "source"], "__key", [self.key], "weight", RANGES)
        cut = offsets.join(self.budgets.select("config", "source", "supply", "budget"), ["config", "source"])
        d = rows.join(cut, ["config", "source", "__range"])
        end = F.col("__offset") + F.col("__before") + F.col("weight")
        whole = F.expr("budget div greatest(supply, 1)")
        left = F.expr("budget % greatest(supply, 1)")
        d = d.withColumn("repeats", (whole + F.when(end <= left, 1).otherwise(0)).cast("int"))
        return d.filter("repeats > 0").select("config", "source", self.key, "tokens", "weight", "repeats")

    def report(self, repeats: DataFrame) -> DataFrame:
        """(config, source, target_share, reached_share, reached_token_share, records, copies, tokens, budget)."""
        got = repeats.groupBy("config", "source").agg(
            F.count("*").alias("records"), F.sum("repeats").alias("copies"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens")
        )
        w = Window.partitionBy("config")
        d = self.budgets.select("config", "source", "__share", "budget", "supply", "total").join(got, ["config", "source"], "left")
        for c in ("records", "copies", "tokens"):
            d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0)), 6)
        return d.select(
            "config", "source", share("__share").alias("target_share"), share("copies").alias("reached_share"),
            share("tokens").alias("reached_token_share"), "supply", "records", "copies", "tokens", "budget", "total",
        )


def assign_splits(repeats: DataFrame, configs: DataFrame, key: str) -> DataFrame:
    """repeats with ``split``: test first, then val, the rest train, in a second hash order.

    Sizes scale with the pool if it came out smaller than asked. Copies of a
    record are never separated: a record that would straddle a boundary stays
    in train, and single records fill the place it leaves, so sizes are exact
    as long as there are single records. ``repeats`` is read twice; pass a
    durable table.
    """
    sizes = repeats.groupBy("config").agg(F.sum("repeats").alias("__got"))
    ratio = F.least(F.lit(1.0), F.col("__got") / F.col("total"))
    cuts = configs.join(sizes, "config").select(
        "config", F.round(F.col("test_size") * ratio).alias("__test"), F.round((F.col("test_size") + F.col("val_size")) * ratio).alias("__val"), "seed"
    )
    cuts = F.broadcast(cuts)  # a row per pool
    d = repeats.join(cuts, "config").withColumn("__key", hash_key(F.col("seed") + 1, F.col(key)))
    d = prefix_sums(d, ["config"], "__key", [key], "repeats", "__at", 1024)
    end = F.col("__at") + F.col("repeats")
    whole = F.when(end <= F.col("__test"), "test").when((F.col("__at") >= F.col("__test")) & (end <= F.col("__val")), "val").otherwise("train")
    d = durable(d.withColumn("split", whole))
    part = lambda name: F.sum(F.when(F.col("split") == name, F.col("repeats")).otherwise(0))
    got = d.groupBy("config").agg(part("test").alias("t"), part("val").alias("v"), F.first("__test").alias("a"), F.first("__val").alias("b"))
    gaps = F.broadcast(got.select("config", (F.col("a") - F.col("t")).alias("__gap_t"), (F.col("b") - F.col("t") - F.col("v")).alias("__gaps")))
    single = (F.col("split") == "train") & (F.col("repeats") == 1)
    fill = prefix_sums(d.filter(single), ["config"], "__key", [key], "repeats", "__i", 1024).join(gaps, "config")
    fill = fill.withColumn("split", F.when(F.col("__i") < F.col("__gap_t"), "test").when(F.col("__i") < F.col("__gaps"), "val").otherwise("train"))
    columns = [*repeats.columns, "split"]
    return d.filter(~single).select(*columns).unionByName(fill.select(*columns))
