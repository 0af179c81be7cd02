"""Near-duplicate records with small edits (problem 2).

Parity-sketch join. A record is its set of distinct words. Two kinds of XOR
sketches are taken of it.

* Block sketches find candidates. The words of a record stand in the order of
  their hashes, and each two neighbours are a block, whose sketch is the XOR of
  the two word hashes. A word that only one of two records has breaks at most one
  block of the words they share, so records of sizes a and b that share o words
  have at least 3o - 1 - (a + b) equal block sketches (pigeonhole). Both sides
  rank their blocks by one global order, rarest first, and store only as many
  that equal blocks can't all lie behind them. The order comes from counts of
  block sketches over all records, in ``BUCKETS`` buckets; whatever the counts,
  no pair is lost, rare blocks only meet fewer records.
* 128 parity bits of all words ride along. Their Hamming distance is a lower
  bound of the symmetric difference, which the threshold bounds for the two
  sizes; pairs beyond it are dropped inside the join, before they become rows.

Survivors are verified exactly on their word sets. Pairs too small or too far
apart for blocks of two words are found by blocks of one word in the same index.

Sizes are banded (``band_tops``): a record is stored in its own band and, where
larger partners may lie in the next one, there too. A cell that more than
``HOT`` records are counted for is split into a triangle of sub-cells, in which
every two of its records still meet once, so no task gets a hot cell whole.

Exact copies are one class with one representative throughout, so a text that
a third of all records share is joined once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.session import durable

BUCKETS = 1 << 17  # of the block counts: a fixed size, collected and shipped to the tasks
HOT = 50_000  # counted records of a cell before it is split, or a few times the mean of the buckets, if that is more
BAND_RATIO = 4
# meta: part (15 bits), in the band above its own, block of one word, rank (23 bits), size (24 bits)
KEYS = "cell long, id long, meta long, bits0 long, bits1 long"


def distinct_words(text: Column) -> Column:
    """Distinct maximal runs of letters or digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def least_shared(total: np.ndarray, similarity: float) -> np.ndarray:
    """Least number of shared words of two sets whose sizes add up to total."""
    return np.ceil(total * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)


def band_tops(size: int) -> list[int]:
    """The largest size of each band, up to the band that holds size."""
    tops = [32]
    while tops[-1] < size:
        tops.append(tops[-1] * BAND_RATIO)
    return tops


def prefixes(size: int, low: int, high: int, similarity: float) -> tuple[int, int]:
    """(blocks of two words, blocks of one word) that a set must store for partners of low to high words.

    Two words where every such partner shares a block of two; one word for the partners that may not.
    """
    low, high = max(low, int(np.ceil(size * similarity - 1e-9)), 1), min(high, int(size / similarity + 1e-9))
    if low > high:
        return 0, 0
    # the bounds move with the sum of the sizes but for rounding, so the ends of the range decide
    partner = np.unique(np.concatenate([np.arange(low, min(high, low + 64) + 1), np.arange(max(low, high - 64), high + 1)]))
    shared = least_shared(size + partner, similarity)
    equal = 3 * shared - 1 - (size + partner)
    two = (equal >= 1) & (similarity >= 0.55)  # below, the bound on equal blocks doesn't grow with the sets
    one = ~two
    return int((size - equal[two]).max(initial=0)), int((size - shared[one] + 1).max(initial=0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def parity_bits(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each record's word hashes, in two halves; start is where each record begins."""
    h = _mix(words)
    bit, high = np.uint64(1) << (h >> np.uint64(58)), (h & np.uint64(1)).astype(bool)
    return tuple(np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), start) for half in (~high, high))


def _blocks(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, sketch) of the blocks of two neighbouring words."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = row[1:] == row[:-1]
    return row[1:][inside], _mix((words[1:] ^ words[:-1])[inside])


def _bucket(sketches: np.ndarray) -> np.ndarray:
    return (_mix(sketches) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _singles(words: np.ndarray) -> np.ndarray:
    return _mix(words ^ np.uint64(0x5851F42D4C957F2D))


def block_counts(words: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Number of blocks in each bucket: of two neighbouring words, and behind them of one word where sets need those."""
    alone = np.array([prefixes(n, 1, 2**24, similarity)[1] > 0 for n in range(min(int(sizes.max(initial=0)), 200) + 1)])
    few = np.repeat(alone[np.minimum(sizes, len(alone) - 1)], sizes)
    return np.concatenate([np.bincount(_bucket(x), minlength=BUCKETS) for x in (_blocks(words, sizes)[1], _singles(words[few]))])


def sketch_keys(ids: np.ndarray, parts: np.ndarray, words: np.ndarray, sizes: np.ndarray, similarity: float, counts: np.ndarray, least_hot: int = HOT) -> dict[str, np.ndarray]:
    """Index rows of a batch without empty sets: words are the sorted 64-bit hashes of all rows, one after another."""
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    bits = parity_bits(words, start)
    largest = np.unique(sizes)
    tops = np.array(band_tops(int(largest.max() / similarity) + 1))
    band = np.searchsorted(tops, largest)
    # (two, one) blocks to store for each size in its own band and in the one above
    need = {}
    for n, b in zip(largest.tolist(), band.tolist()):
        above = prefixes(n, int(tops[b]) + 1, int(n / similarity) + 1, similarity)
        need[n] = (prefixes(n, 1, int(tops[b]), similarity), above)
    keep = np.zeros((int(largest.max()) + 1, 2, 2), dtype=np.int64)
    for n, x in need.items():
        keep[n] = x
    own = np.searchsorted(tops, sizes)
    out: dict[str, list[np.ndarray]] = {"row": [], "cell": [], "meta": []}
    hot = max(least_hot, int(8 * counts.mean()))
    for width, (row, sketch) in ((2, _blocks(words, sizes)), (1, (np.repeat(np.arange(len(sizes)), sizes), _singles(words)))):
        if not len(row) or not keep[sizes, :, 2 - width].any():
            continue
        count = counts[_bucket(sketch) + (2 - width) * BUCKETS]
        order = np.lexsort((sketch, count, row))
        row, sketch, count = row[order], sketch[order], count[order]
        first = np.searchsorted(row, np.arange(len(sizes)))
        rank = np.arange(len(row)) - first[row]
        for up in (0, 1):
            pick = rank < keep[sizes[row], up, 2 - width]
            r, k = row[pick], rank[pick]
            tag = (parts[r].astype(np.uint64) << np.uint64(32)) + ((own[r] + up) * 4 + width).astype(np.uint64)
            cell = _mix(sketch[pick] ^ _mix(tag))
            meta = (parts[r].astype(np.int64) << 49) + (up << 48) + ((width == 1) << 47) + (np.minimum(k, (1 << 23) - 1) << 24) + sizes[r]
            split = np.maximum(1, -(-count[pick] // hot))
            if split.max(initial=1) > 1:  # sub-cell (x, y) for every y, x being the record's own
                again = np.repeat(np.arange(len(r)), split)
                r, cell, meta, s = r[again], cell[again], meta[again], split[again]
                y = np.arange(len(again)) - np.repeat(np.cumsum(split) - split, split)
                x = (_mix(ids[r].view(np.uint64) + np.uint64(11)) % s.astype(np.uint64)).astype(np.int64)
                sub = np.minimum(x, y) * s + np.maximum(x, y)
                cell = np.where(s > 1, _mix(cell + sub.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), cell)
            for name, value in (("row", r), ("cell", cell), ("meta", meta)):
                out[name].append(value)
    r = np.concatenate([np.zeros(0, dtype=np.int64), *out["row"]])
    cell, meta = np.concatenate([np.zeros(0, dtype=np.uint64), *out["cell"]]), np.concatenate([np.zeros(0, dtype=np.int64), *out["meta"]])
    return {"cell": cell.view(np.int64), "id": ids[r], "meta": meta, "bits0": bits[0][r].view(np.int64), "bits1": bits[1][r].view(np.int64)}


def prepare(df: DataFrame, part: str, key: str, text: str, least_words: int) -> DataFrame:
    """(part, key, words, h): the sorted word hashes and set digest of each record.

    The one pass over the texts. Records with fewer than least_words distinct
    words are left out, as are null texts. Reused by every later step, so pass
    the result through a durable table.
    """
    hashes = F.array_sort(F.transform(distinct_words(F.col(text)), lambda w: F.xxhash64(w)))
    d = df.select(F.col(part).cast("int").alias("part"), F.col(key).cast("long").alias("key"), hashes.alias("words"))
    d = d.filter((F.size("words") >= least_words) & F.col("key").isNotNull())
    return d.withColumn("h", F.struct(F.xxhash64(F.lit(7), "words").alias("a"), F.xxhash64(F.lit(13), "words").alias("b")))


def classes(prepared: DataFrame) -> DataFrame:
    """(part, key, class_id): records with the same word set share a class, whose id is its smallest key.

    A key that is delivered again counts once.
    """
    d = prepared.select("part", "key", "h").distinct()
    least = d.groupBy("part", "h").agg(F.min("key").alias("class_id"))
    return d.join(least.hint("merge"), ["part", "h"]).select("part", "key", "class_id")


def _slices(batches):
    """(ids, parts, words, sizes) of a thousand sets at a time, empty sets left out."""
    for batch in batches:
        words = batch.column("words")
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for lo in range(0, len(ids), 1000):
            hi = min(lo + 1000, len(ids))
            some = sizes[lo:hi] > 0
            if some.any():
                yield ids[lo:hi][some], parts[lo:hi][some], flat[ends[lo] : ends[hi]], sizes[lo:hi][some]


def count_blocks(sets: DataFrame, similarity: float) -> np.ndarray:
    """The block counts of all sets: twice BUCKETS numbers, whatever the number of records."""

    def run(batches):
        total = np.zeros(2 * BUCKETS, dtype=np.int64)
        for _, _, words, sizes in _slices(batches):
            total += block_counts(words, sizes, similarity)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    got = sets.select("part", "id", "words").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(2 * BUCKETS, dtype=np.int64)
    for bucket, n in got:
        counts[bucket] = n
    return counts


def near_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(part, a, b), a < b: all pairs of ``sets`` (part, id, sorted words) of at least that similarity.

    ``sets`` is read several times; pass a durable table.
    """
    counts = count_blocks(sets, similarity)

    def run(batches):
        for ids, parts, words, sizes in _slices(batches):
            yield pa.RecordBatch.from_pydict(sketch_keys(ids, parts, words, sizes, similarity, counts))

    index = sets.select("part", "id", "words").mapInArrow(run, KEYS)
    side = lambda i, m, x: index.select("cell", F.col("id").alias(i), F.col("meta").alias(m), F.col("bits0").alias(f"{x}0"), F.col("bits1").alias(f"{x}1"))
    size = lambda m: f"({m} & {(1 << 24) - 1}L)"
    rank = lambda m: f"(shiftright({m}, 24) & {(1 << 23) - 1}L)"
    total = f"({size('m')} + {size('n')})"
    shared = f"cast(ceil({total} * {similarity / (1 + similarity)!r}D - 1e-9D) as long)"
    # a pair in the band above needs one set of that band; equal blocks lie among the first size - (3 * shared - 1 - total)
    near = f"""i < j AND (m & n & {1 << 48}L) = 0 AND {shared} <= least({size("m")}, {size("n")})
        AND bit_count(x0 ^ y0) + bit_count(x1 ^ y1) <= {total} - 2 * {shared}
        AND ((m & {1 << 47}L) <> 0 OR ({rank("m")} < {size("m")} - (3 * {shared} - 1 - {total}) AND {rank("n")} < {size("n")} - (3 * {shared} - 1 - {total})))"""
    # both sides ask the same of their rows (cells hold the part, and coalesce lets no filter be inferred), so one shuffle serves both
    met = side("i", "m", "x").join(side("j", "n", "y").hint("merge"), "cell").filter(near)
    candidates = met.select(F.expr("coalesce(cast(shiftright(m, 49) as int), 0)").alias("part"), F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    left = sets.select("part", F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sets.select("part", F.col("id").alias("b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - both
    d = candidates.join(left.hint("merge"), ["part", "a"]).join(right.hint("merge"), ["part", "b"])
    return d.filter(both >= either * similarity - 1e-9).select("part", "a", "b")


def near_duplicates(df: DataFrame, part: str, key: str, text: str, similarity: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(members (part, key, class_id), links (part, a, b) between class ids); parts (small ints) are kept apart.

    Empty input gives empty results; ties and repeated rows don't matter, since
    classes and links are sets.
    """
    prepared = durable(prepare(df, part, key, text, least_words))
    members = durable(classes(prepared))
    reps = members.filter("key = class_id").select("part", "key")
    sets = prepared.join(reps.hint("merge"), ["part", "key"], "left_semi").select("part", F.col("key").alias("id"), "words").dropDuplicates(["part", "id"])
    return members, near_pairs(durable(sets), similarity)


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(part, key_a, key_b) of every two records in one class or in linked classes."""
    a = members.select("part", F.col("class_id").alias("a"), F.col("key").alias("ka"))
    b = members.select("part", F.col("class_id").alias("b"), F.col("key").alias("kb"))
    same = a.join(b.withColumnRenamed("b", "a").hint("merge"), ["part", "a"]).filter("ka < kb").select("part", F.col("ka").alias("key_a"), F.col("kb").alias("key_b"))
    cross = links.join(a.hint("merge"), ["part", "a"]).join(b.hint("merge"), ["part", "b"]).select("part", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return same.unionByName(cross)
