"""Filling fixed-capacity containers with items (problem 7).

Planning works on the histogram of item lengths, whose size is bounded by the
capacity, never by the number of documents. Best fit in decreasing length runs
over the counts: containers with the same space left form runs of consecutive
container numbers, and one planning step puts one item into each container of a
run. The plan is a table (length, first rank, last rank, first container,
offset); documents take their planned slot by joining on their rank within
their length. Ranks are exact and computed over hash ranges, so a length that a
third of all documents share is spread over many tasks.

Defined results: a document larger than a container is divided into full
containers and one remainder, which is packed like any item; a document without
tokens (null, empty) needs no space and gets one row with null container and
size 0; a null capacity plans nothing. Repeated keys are separate items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.ranks import hash_key, prefix_sums

PLAN = "capacity int, length int, from_rank long, to_rank long, first_container long, item_offset int, full_containers long"


def plan_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: steps (length, from_rank, to_rank, first_container, offset)."""
    runs: dict[int, list[list[int]]] = defaultdict(list)  # space left -> runs [first container, count]
    spaces: list[int] = []  # sorted spaces that have runs
    steps, opened = [], 0

    def put(space: int, first: int, n: int) -> None:
        if not space:
            return
        if not runs[space]:
            insort(spaces, space)
        elif runs[space][-1][0] + runs[space][-1][1] == first:
            runs[space][-1][1] += n
            return
        runs[space].append([first, n])

    for length in sorted((x for x, n in counts.items() if n > 0 and 0 < x <= capacity), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):  # none fits: open containers that take as many of this length as they can
                each = capacity // length
                n, placed = max(1, left // each), min(each, left)
                for k in range(placed):
                    steps.append((length, rank, rank + n, opened, k * length))
                    rank, left = rank + n, left - n
                put(capacity - placed * length, opened, n)
                opened += n
                continue
            space = spaces[at]
            first, n = runs[space].pop()
            if not runs[space]:
                spaces.pop(at)
            take = min(n, left)
            steps.append((length, rank, rank + take, first, capacity - space))
            rank, left = rank + take, left - take
            if take < n:
                put(space, first + take, n - take)
            put(space - length, first, take)
    return steps


RANGE_ROWS = 100_000  # rows of a length or capacity that a hash range should hold


def ranges_for(rows: int) -> int:
    """A power of two of hash ranges, so that none holds many more than RANGE_ROWS of the rows."""
    return 1 << max(6, (rows // RANGE_ROWS).bit_length())


def plan_table(spark: SparkSession, histogram: DataFrame) -> tuple[DataFrame, int, int]:
    """(plan for a histogram (capacity, length, n, full_pieces) of remainders, most rows of a length, rows of a capacity).

    The histogram is collected: it has at most one row for each length up to
    each capacity, however many documents there are.
    """
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    full: dict[int, int] = defaultdict(int)
    most, every = 0, defaultdict(int)
    for r in histogram.collect():
        most, every[r.capacity] = max(most, r.n), every[r.capacity] + r.n
        if r.length:
            counts[r.capacity][r.length] = r.n
        full[r.capacity] += r.full_pieces
    rows = []
    for capacity in sorted(full):
        for length, a, b, first, offset in plan_counts(counts[capacity], capacity):
            rows.append((capacity, length, a, b, full[capacity] + first, offset, full[capacity]))
    return spark.createDataFrame(rows, PLAN), most, max(every.values(), default=0)


def pack(sizes: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """(capacity, key, piece, container, item_offset, piece_size) for every record and capacity.

    ``sizes`` is read twice (histogram, then assignment); pass a durable table
    if it is dear to compute.
    """
    spark = sizes.sparkSession
    caps = sorted({c for c in capacities if c and c > 0})
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = sizes.select(key, n.alias("__n"), F.explode(F.array(*[F.lit(c) for c in caps]) if caps else F.array().cast("array<int>")).alias("capacity"))
    items = items.withColumn("__full", F.expr("__n div capacity")).withColumn("length", (F.col("__n") % F.col("capacity")).cast("int"))
    plan, most, every = plan_table(spark, items.groupBy("capacity", "length").agg(F.count("*").alias("n"), F.sum("__full").alias("full_pieces")))

    # slots of remainders: one narrow shuffle on (capacity, length, range)
    rest = items.filter("length > 0").withColumn("__key", hash_key(F.lit(17), F.col(key))).withColumn("__one", F.lit(1))
    rest = prefix_sums(rest, ["capacity", "length"], "__key", [key], "__one", "__rank", ranges=ranges_for(most))
    slots = F.broadcast(plan)  # at most a few rows for each length up to the capacity
    c = rest.join(slots, ["capacity", "length"]).filter("__rank >= from_rank AND __rank < to_rank")
    packed = c.select(
        "capacity", key, F.col("__full").cast("int").alias("piece"),
        (F.col("first_container") + F.col("__rank") - F.col("from_rank")).alias("container"),
        "item_offset", F.col("length").alias("piece_size"),
    )

    # full pieces fill containers 0..full-1 of their capacity, numbered by prefix sums of pieces
    big = items.filter("__full > 0").withColumn("__key", hash_key(F.lit(23), F.col(key)))
    big = prefix_sums(big, ["capacity"], "__key", [key], "__full", "__first", ranges=ranges_for(every))
    whole = big.select("capacity", key, "__first", F.posexplode(F.sequence(F.lit(0), (F.col("__full") - 1).cast("int"))).alias("piece", "__p"))
    whole = whole.select("capacity", key, "piece", (F.col("__first") + F.col("piece")).alias("container"), F.lit(0).alias("item_offset"), F.col("capacity").alias("piece_size"))

    none = items.filter("__n = 0").select("capacity", key, F.lit(0).alias("piece"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("item_offset"), F.lit(0).alias("piece_size"))
    return packed.unionByName(whole).unionByName(none)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, share of unused space, and the least number of containers possible."""
    got = packed.groupBy("capacity").agg(
        F.max("container").alias("__last"), F.sum("piece_size").alias("tokens"), F.count("container").alias("pieces")
    )
    containers = F.coalesce(F.col("__last") + 1, F.lit(0))
    return got.select(
        "capacity", containers.alias("containers"), "pieces", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        F.round(1 - F.try_divide(F.col("tokens"), containers * F.col("capacity")), 6).alias("unused_share"),
    )
