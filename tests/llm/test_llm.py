"""Operators of the llm subpackage against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import itertools
import os
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosemill.llm import abuse, canonical, mixing, neardup, packing, pairs, ranks, tokens, truncation
from prosemill.llm.queries import p5_tags

HAVE_TOKENIZERS = os.path.exists(tokens.vocabulary_path())
LONG = "word " * 60_000


# ---- ranks -------------------------------------------------------------------------------------


def test_prefix_sums_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), "id", (F.col("id") % 5).alias("w"))
    df = df.withColumn("h", ranks.hash_key(F.lit(1), F.col("id")))
    rows = ranks.prefix_sums(df, ["g"], "h", ["id"], "w", "before").collect()
    for g in ("hot", "cold"):
        total = 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"])):
            assert r["before"] == total
            total += r["w"]


# ---- mixing ------------------------------------------------------------------------------------

POOL = "id string, text string, loaded_at timestamp, source string, words int, total int"
CONF = "config int, total long, val_size int, test_size int, max_repeats int, min_words int, max_words int, seed int, shares array<struct<source:string,share:double>>"


def shares(a, b, c):
    return [("a", a), ("b", b), ("c", c)]


def records(spark, sizes):
    rows = [(f"{s}-{i}", s, 10 + i % 7) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, source string, words int")


@pytest.mark.parametrize("size", ["records", "tokens"])
def test_mix_reaches_budgets_exactly(spark, size):
    total = 400 if size == "records" else 4000
    conf = spark.createDataFrame(
        [(1, total, 40, 40, 3, 1, 100, 5, shares(0.5, 0.3, 0.2)), (2, total, 40, 40, 1, 1, 100, 6, shares(0.5, 0.3, None)), (3, total, 4, 4, 2, 1, None, 7, shares(1.0, 0.6, 0.4)), (4, 10**6, 10, 10, 2, 1, 100, 8, shares(0.5, 0.3, 0.2))], CONF
    )
    recs = records(spark, {"a": 1000, "b": 60, "c": 30})
    mix = mixing.Mix(recs, conf, "id", size=size, sources=3)
    got = mix.repeats()
    report = {(r["config"], r["source"]): r for r in mix.report(got).collect()}
    per = {(r["config"], r["id"]): r["repeats"] for r in got.collect()}
    assert max(v for (c, _), v in per.items() if c == 1) <= 3 and max(v for (c, _), v in per.items() if c == 2) == 1
    if size == "records":
        assert sum(report[1, s]["copies"] for s in "abc") == 400
        assert report[1, "a"]["copies"] == pytest.approx(200, abs=50) and report[1, "b"]["copies"] == 120 and report[1, "c"]["copies"] == 80
        assert report[2, "c"]["copies"] == 0 and report[2, "b"]["copies"] == 60  # null share stays out; the cap holds
        assert sum(report[4, s]["copies"] for s in "abc") == 2 * 1090  # a pool larger than everything
        assert report[3, "a"]["target_share"] == pytest.approx(0.5)  # shares that add up to 2 are scaled
    else:
        for s in "ab":
            assert 0 <= report[1, s]["budget"] - report[1, s]["tokens"] < 17
    split = mixing.assign_splits(got, conf.select("config", "total", "val_size", "test_size", "seed"), "id")
    if size == "records":
        c = {(r["config"], r["split"]): r["n"] for r in split.groupBy("config", "split").agg(F.sum("repeats").alias("n")).collect()}
        assert c[1, "test"] == c[1, "val"] == 40 and c[1, "train"] == 320
        assert split.groupBy("config", "id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_unique_records(spark):
    t = lambda n: f"2024-01-0{n} 00:00:00"
    rows = [("a-1", "one two", t(1), "x", 9, 9), ("a-1", "one  two three", t(2), None, None, None), ("a-2", "one two three ", t(1), "y", 1, 1), ("a-3", None, t(1), "z", 1, 1), ("a-4", "  ", t(1), "z", 1, 1), (None, "x", None, None, None, None)]
    df = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], POOL).drop("loaded_at")
    stamps = spark.createDataFrame([(r[0], r[2], r[1]) for r in rows], "id string, s string, text string").select("id", "text", F.to_timestamp("s").alias("loaded_at"))
    got = mixing.unique_records(stamps, "id", "text", "loaded_at").collect()
    assert [(r["id"], r["words"]) for r in got] == [("a-1", 3)]
    assert mixing.unique_records(stamps.limit(0), "id", "text", "loaded_at").count() == 0
    assert df.count() == 6


def test_mix_of_nothing(spark):
    conf = spark.createDataFrame([(1, 10, 1, 1, 3, 1, 100, 5, shares(0.5, 0.5, 0.0))], CONF)
    mix = mixing.Mix(records(spark, {"a": 1}).limit(0), conf, "id", sources=3)
    assert mix.repeats().count() == 0
    assert all(r["copies"] == 0 for r in mix.report(mix.repeats()).collect())


# ---- near duplicates ---------------------------------------------------------------------------


def edited(rng, base, vocabulary):
    w = list(base)
    for _ in range(rng.randint(0, 14)):
        k = rng.randrange(len(w))
        op = rng.random()
        if op < 0.4:
            w[k] = rng.choice(vocabulary)
        elif op < 0.7 and len(w) > 26:
            del w[k]
        else:
            w.insert(k, rng.choice(vocabulary))
    rng.shuffle(w)
    return w


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(60):
        base = rng.sample(vocabulary, rng.choice([27, 34, 45, 60, 85]))
        for _ in range(4):
            rows.append((len(rows), " ".join(edited(rng, base, vocabulary))))
    rows += [(len(rows) + i, rows[0][1]) for i in range(30)]  # a hot group of exact copies
    rows += [(900, None), (901, ""), (902, "too few words"), (903, LONG), (904, LONG)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("part", F.lit(0)).withColumn("words", F.lit("clash")).withColumn("id", F.lit(1))
    df = df.unionByName(df)  # everything delivered twice
    members, links = neardup.near_duplicates(df, "part", "k", "t", 0.7, 25)
    got = {(r["key_a"], r["key_b"]) for r in neardup.expand_pairs(members, links).collect()}
    sets = {k: set(re.findall(r"[^\W_]+", (t or "").lower())) for k, t in rows}
    sets = {k: s for k, s in sets.items() if len(s) >= 25}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}


def test_near_duplicates_of_large_sets_at_the_threshold(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for n in (70, 80, 90, 110, 130, 150, 400):
        for _ in range(20):
            k, words = len(rows), rng.sample(range(10**6), 2 * n)
            both = next(b for b in range(n + 1) if b >= 0.7 * (2 * n - b) - 1e-9)
            rows.append((k, " ".join(f"w{x}" for x in words[:n])))
            rows.append((k + 1, " ".join(f"w{x}" for x in words[n - both : 2 * n - both])))  # as many as may differ at equal size
            rows.append((k + 2, " ".join(f"w{x}" for x in words[: -(-n * 7 // 10)])))  # the smallest set that may pair with the first
            want |= {(k, k + 1), (k, k + 2)}
    df = spark.createDataFrame(rows, "k long, t string").withColumn("part", F.lit(1))
    members, links = neardup.near_duplicates(df, "part", "k", "t", 0.7, 25)
    assert {(r["key_a"], r["key_b"]) for r in neardup.expand_pairs(members, links).collect()} == want


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "k long, t string").withColumn("part", F.lit(0))
    members, links = neardup.near_duplicates(df, "part", "k", "t", 0.7, 25)
    assert members.count() == 0 and links.count() == 0


def _indexed_pairs(sets, similarity, hot=neardup.HOT):
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    words = np.concatenate([np.sort(np.array(list(x), dtype=np.uint64).view(np.int64)).view(np.uint64) for x in sets])
    counts = neardup.block_counts(words, sizes, similarity)
    rows = neardup.sketch_keys(np.arange(len(sets)), np.zeros(len(sets), dtype=np.int32), words, sizes, similarity, counts, hot)
    cells = {}
    for cell, i in zip(rows["cell"].tolist(), rows["id"].tolist()):
        cells.setdefault(cell, set()).add(i)
    return cells, {p for ids in cells.values() for p in itertools.combinations(sorted(ids), 2)}


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.54, 0.6, 0.7, 0.8, 0.95])
@pytest.mark.parametrize("n", [1, 2, 5, 9, 25, 43, 63, 90, 120, 200, 700])
def test_index_finds_every_pair_at_the_threshold(n, similarity):
    """Recall 1 for sets of every size, equal or unequal, whether blocks are split or not."""
    rng = np.random.default_rng(n)
    sets, want = [], set()
    for k in range(40):
        words = rng.integers(1, 2**63, 3 * n + 3, dtype=np.uint64).tolist()
        m = int(rng.integers(int(np.ceil(n * similarity)), n + 1))
        both = int(np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))
        sets += [words[:n], words[n - both : n - both + m]]
        want.add((2 * k, 2 * k + 1))
    for hot in (neardup.HOT, 1):
        assert want <= _indexed_pairs(sets, similarity, hot)[1]


def test_hot_blocks_are_split_and_lose_no_pair():
    rng = np.random.default_rng(4)
    same = rng.integers(1, 2**63, 40, dtype=np.uint64).tolist()
    sets = [[*same, *rng.integers(1, 2**63, 4, dtype=np.uint64).tolist()] for _ in range(300)]
    whole, pairs_whole = _indexed_pairs(sets, 0.7)
    parts, pairs_split = _indexed_pairs(sets, 0.7, 60)
    assert pairs_whole == pairs_split and max(map(len, parts.values())) < 0.7 * max(map(len, whole.values()))


# ---- truncation --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "empty"), ("", "empty"), ("  \n", "empty"), ("N/A", "empty"), ("[]", "empty"), ("...", "empty"), ("(no output)", "empty"), ("-", "empty"),
        ("It ran. The dog was", "cut"), ("It ran. The dog was...", "cut"), ("It ran. The do…", "cut"), ("It ran. The dog [...]", "cut"), ("It ran. The dog, (", "cut"),
        ("It ran. The dog**", "cut"), ("It ran. The dog,", "cut"), ("It ran. The dog &amp;", "cut"), ("It ran. The d�", "cut"),
        ("It ran. The dog was here.", "marked"), ('He said, "It ran."', "marked"), ("It ran! 🙂", "marked"), ("**It ran.**", "marked"), ("(It ran!)", "marked"),
        ("It ran.\n\n- red roofs\n- old walls", "closed"), ("It ran.\n\n#one #two", "closed"), ("It ran.\n\nWord count: 82", "closed"), ("It ran.\n\n— written in York", "closed"),
        ("It ran.\n\nTHE END", "closed"), ("It ran.\n\nTopic: the life of bees", "closed"), ("It ran.\n\nTopic: the life of b", "cut"), ("彼は走った。", "marked"),
    ],
)
def test_endings(text, state):
    assert truncation.ending(text, "the life of bees")[0] == state


def test_unfinished_by_copies_and_closing_words(spark):
    rng = random.Random(1)
    vocabulary = [f"term{i}" for i in range(400)]
    sentence = lambda: " ".join(rng.sample(vocabulary, 12)).capitalize() + "."
    whole = " ".join(sentence() for _ in range(20))
    ws = whole.split()
    measure = "The hall held approx. half of them. We met at 5 p.m. today near it. They packed all, etc. So we left. " * 3
    rows = [(1, whole), (2, " ".join(ws[:-5])), (3, " ".join(ws[:-12])), (4, whole + " It took approx."), (5, "They packed ropes, etc."), (6, measure), (7, None), (8, ""), (9, LONG), (10, whole)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("word", F.lit(1)).withColumn("state", F.lit(2))
    closed = truncation.closings(df, "k", "t").cache()
    got = {r["k"]: r for r in truncation.judge(closed, "k").collect()}
    assert len(got) == 10
    assert [k for k, r in got.items() if r["unfinished"]] and {k for k, r in got.items() if r["unfinished"]} == {2, 4, 9}
    assert got[2]["aligned"] == "cut" and got[3]["aligned"] == "whole"
    none = truncation.closings(df.limit(0), "k", "t")
    assert truncation.judge(none, "k").count() == 0


def test_aligned_end_inside_a_word():
    long = " ".join(f"word{i}" for i in range(100)) + "."
    assert truncation.aligned_end(long[: long.index("word95") + 5], long) == "cut"
    assert truncation.aligned_end("nothing of it at all here and there", long) is None


def test_alignment_decides_planted_cuts(spark):
    """Texts that close like finished ones are found out by a copy that goes on, though it is neither alone nor the longest."""
    rng = random.Random(9)
    rows, want = [], {}
    for g in range(12):
        body = " ".join(f"Word{rng.randrange(10**6)} is {rng.choice(['near', 'by'])} mill{rng.randrange(10**6)}." for _ in range(30))
        tail = f" It costs approx. {g} coins and the bridge stands."
        more = " The river was wide. Nobody knew it."
        k = g * 10
        rows += [(k, body + tail), (k + 1, body + " It costs approx."), (k + 2, body), (k + 3, body + tail + more), (k + 4, body + tail[: tail.index("coins") + 2])]
        rows += [(k + 5, body + " Another closing was written here, and it is longer than the others by some words of its own.")]
        rows += [(k + 6, body + " It costs approx.")]  # an exact copy
        want |= {k: "whole", k + 1: "cut", k + 2: "whole", k + 3: None, k + 4: "cut", k + 5: None, k + 6: "cut"}
    base = " ".join(f"Tree{i} grew." for i in range(60))
    hot = [(1000 + i, f"{base} Leaf{i} fell. Then came the end of all.") for i in range(150)]  # near-copies of each other, all finished
    hot += [(1200 + i, f"{base} Leaf{i} fell. Then came the") for i in range(20)]
    df = spark.createDataFrame(rows + hot, "k long, t string").withColumn("digest", F.lit("clash"))
    closed = truncation.closings(df.drop("digest"), "k", "t").cache()
    got = {r["k"]: r for r in truncation.judge(closed, "k").collect()}
    assert {k: got[k]["aligned"] for k in want} == want
    assert all(got[k]["unfinished"] and got[k]["decider"] == "alignment" for k, v in want.items() if v == "cut")
    assert all(not got[k]["unfinished"] for k, v in want.items() if v != "cut")
    assert all(got[k]["aligned"] == ("cut" if k >= 1200 else None) for k, _ in hot)


def test_alignment_equals_that_of_every_pair(spark):
    """Groups with many partners of which few are near-copies, moved and repeated parts, cuts inside words: as brute force over all pairs."""
    rng = random.Random(31)
    texts = set()
    for g in range(6):
        end = f"So the long road of group{g} ran"
        bodies = []
        for _ in range(14):  # bodies of one key that share a third of their words, so that buckets are shared without similarity
            common = [f"g{g}w{i}" for i in range(14)]
            bodies.append(common + [f"x{rng.randrange(10**6)}" for _ in range(26)])
        for b in bodies:
            stop = rng.choice([" on", " onwar", "", " onward."])
            texts.add(" ".join(b) + f" {end}{stop}")
            for tail in (" onward to town", " onward. Nobody knew", "", " on", " onward. 7 knew"):
                if rng.random() < 0.5:
                    mine = list(b)
                    for _ in range(rng.choice([0, 0, 1, 3])):
                        mine[rng.randrange(len(mine))] = f"y{rng.randrange(100)}"
                    texts.add(" ".join(mine) + f" {end}{tail}")
        moved = bodies[0][:20] + f"{end} onward".split() + bodies[0][20:]  # the shorter text's end in the middle: no text that goes on behind it
        assert truncation.aligned_end(" ".join(bodies[0] + f"{end} on".split()), " ".join(moved)) is None
        texts.add(" ".join(bodies[0] + f"{end} on".split()))
        texts.add(" ".join(moved))
        once = [f"r{g}q{i}" for i in range(30)]
        texts.add(" ".join(once))
        texts.add(" ".join(once + ["na"] * 60))  # few shingles more, but many words
        assert truncation.aligned_end(" ".join(once), " ".join(once + ["na"] * 60)) == "cut"
    for n in range(5, 9):
        texts |= {" ".join(["la"] * n), " ".join(["la"] * n + ["lamp"]), " ".join(["la"] * n + ["l"])}
    texts = sorted(texts)
    best: dict[str, str] = {}
    for x in texts:
        shown = [a for y in texts if y != x and (a := truncation.aligned_end(x, y))]
        if shown:
            best[x] = min(shown)
    assert {"cut", "whole"} <= set(best.values())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "d long, t string")
    got = {texts[r["d"]]: r["aligned"] for r in truncation.aligned_ends(df, "d", "t").collect()}
    assert got == best


def test_alignment_finds_the_one_copy_among_many_partners(spark):
    """One near-copy whose digest is neither the smallest nor the largest of those that share its end and most of its buckets."""
    rng = random.Random(8)
    base = [f"oak{i}" for i in range(150)]
    end = "and then they all went down to the"
    others = []  # of a similarity a little below, each for another reason
    for _ in range(120):
        spots = rng.sample(range(0, 150, 6), 5)
        others.append(" ".join(f"elm{rng.randrange(10**6)}" if i in spots else w for i, w in enumerate(base)) + f" {end} market{len(others)}")
    short = " ".join(base) + f" {end}"
    df = spark.createDataFrame([(1000, short), (500, f"{short} harbour"), *[(i if i < 60 else 5000 + i, t) for i, t in enumerate(others)]], "d long, t string")
    assert all(truncation.aligned_end(short, t) is None for t in others) and truncation.aligned_end(short, f"{short} harbour") == "cut"
    got = {r["d"]: r["aligned"] for r in truncation.aligned_ends(df, "d", "t").collect()}
    assert got.get(1000) == "cut"


def test_p5_answers_cut_before_a_copy_that_goes_on(spark, tmp_path):
    """An answer that closes like a finished one, shown to be cut by a copy whose end repeats words."""
    rng = random.Random(2)
    base = " ".join(f"The {w} of the town was near stone {rng.randrange(10**6)}." for w in "mill bridge tower house church school market garden harbour wall".split())
    ask = "Write about the old houses of a village and who lived there."
    rows = [(1, None, ask, f"{base} They walked over the bri."), (2, None, ask, f"{base} They walked over the bridge " + "so " * 60 + "far.")]
    rows += [(10 + i, None, ask, f"The road {i} is long and the trees are old. We walked on it with {i} friends. It was a warm day in the year. Every house has a garden.") for i in range(20)]
    df = spark.createDataFrame([(k, t, "Ask for a text on the town.", q, a) for k, t, q, a in rows], "pair_id long, topic string, input_prompt string, output_prompt string, best_essay string")
    df.write.parquet(str(tmp_path / "prompt_pairs.parquet"))
    got = {(r["pair_id"], r["field_name"]): r["defect"] for r in p5_tags(spark, str(tmp_path)).collect()}
    assert got[1, "best_essay"] == "truncated" and got[2, "best_essay"] != "truncated"


def test_word_hashes_are_those_of_split_words():
    """In the middle of a column, with nulls, blanks and every kind of space: one hash a word, equal for equal words only."""
    rng = random.Random(4)
    pieces = ["mill", "mil", "Mill", "ü", "über", "слово", "水", "é.", "x" * 300, "a", *map(chr, truncation.SPACES)]
    texts = [None, "", " ", *["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1500)], None]
    words, sizes = truncation.word_hashes(pa.array(["left out", *texts])[1:])
    split = [(t or "").split() for t in texts]
    assert sizes.tolist() == [len(ws) for ws in split]
    found = set(zip((w for ws in split for w in ws), words.tolist()))
    assert len(found) == len({w for w, _ in found}) == len({h for _, h in found})
    assert all(h & 255 == w.encode()[0] for w, h in found)


def test_closing_counts_by_definition():
    got = truncation.closing_counts(["It took approx. 5 days.\nThey met Mr. Low (at no. 7). \"Why?\" etc. and so on.", "No. It ended. \nso it did"])
    assert got == {("approx", False): 1, ("days", True): 1, ("mr", True): 1, ("at no", False): 1, ("<number>", True): 1, ("etc", False): 1, ("no", True): 1, ("ended", True): 1}


def test_bloom_filter_passes_every_cell(spark):
    """Also in several parts, and when it is over-full."""
    cells = np.random.default_rng(3).integers(-(2**63), 2**63, 30_000)
    df = spark.createDataFrame([(int(c),) for c in cells], "cell long")
    others = np.random.default_rng(4).integers(-(2**63), 2**63, 30_000)
    for part, most in ((2**23, 2**29), (2**14, 2**29), (2**12, 2**14)):
        bits = truncation.bloom_filter(df, "cell", part, most)
        assert len(truncation.passing(bits, cells, part)) == len(cells)
        assert most < 2**29 or len(truncation.passing(bits, others, part)) < 300


def test_placeholders_of_any_length():
    for n in (0, 20, 220, 3000):
        assert truncation.is_placeholder("null" + "-" * n) and truncation.is_placeholder("-" * n + " n/a ")
    assert not truncation.is_placeholder("-" * 300 + "a sentence that is longer than any placeholder is")


# ---- canonical text ----------------------------------------------------------------------------


def test_composition_is_nfc():
    rng = random.Random(0)
    chars = [chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0x131), *range(0x300, 0x345), *range(0x1E00, 0x1F00), *range(0xAC00, 0xAC40), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]]
    texts = ["x" + "".join(rng.choice(chars) for _ in range(rng.randrange(14))) for _ in range(4000)]
    out = canonical.canonicalize(pa.array(texts), False).to_pylist()
    assert out == [unicodedata.normalize("NFC", t).replace("͏", "") for t in texts]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("The cat", "Ｔｈｅ　ｃａｔ", True), ("The cat", "Тhe сat", True), ("café", "café", True), ("ệ", "ệ", True), ("the​ cat", "the cat", True), ("the cat", "the cat", True),
        ("ﬁeld", "field", True), ("a\r\nb", "a\nb", True), ("a  b ", "a b", True), ("Ångstrom", "Ångstrom", True), ("co­op", "coop", True), ("x y", "x y", True),
        ("cafe", "café", False), ("The", "the", False), ("a.", "a!", False), ("a\nb", "a b", False), ("a’b", "a'b", False), ("x²", "x2", False), ("👨‍👩", "👨👩", False),
    ],
)
def test_screen_key(a, b, same):
    x, y = canonical.canonicalize(pa.array([a, b]), True).to_pylist()
    assert (x == y) is same


def test_canonical_keeps_other_scripts():
    t = ["привет мир", "καλημέρα", "日本語", "שלום", None, ""]
    assert canonical.canonicalize(pa.array(t), False).to_pylist() == [unicodedata.normalize("NFC", x) if x else x for x in t]


def test_lookalike_pairs(spark):
    rows = [(1, "The cat sat."), (2, "Тhe cat sat."), (3, "The cat sat."), (4, "the cat sat."), (5, None), (6, ""), (7, "​"), (8, LONG), (9, LONG.replace(" ", " ")), (2, "Тhe cat sat.")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("f", F.lit("x")).withColumn("screen_id", F.lit(0))
    c = canonical.screen_classes(df, "k", "t", ["f"])
    assert {(r["key_a"], r["key_b"]) for r in canonical.lookalike_pairs(c, "k", ["f"]).collect()} == {(1, 2), (2, 3), (8, 9)}
    got = {r["k"]: (r["class_id"], r["spellings"]) for r in canonical.lookalike_classes(c, "k", ["f"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 1), 8: (8, 2), 9: (8, 2)}
    assert canonical.lookalike_pairs(canonical.screen_classes(df.limit(0), "k", "t", ["f"]), "k", ["f"]).count() == 0


# ---- pairs -------------------------------------------------------------------------------------

QUESTION = "Write an essay about the old bridge that pleases a reader. Keep the tone plain but never cold. Name one mill near the river."
ANSWER = "The bridge is old and the river is wide. A mill stood there, and the miller was kind. We walked over it in the evening, and nobody spoke of the flood."
GERMAN = "Die Brücke ist alt und der Fluss ist breit. Dort stand eine Mühle, und der Müller war freundlich. Wir gingen am Abend über sie, und niemand sprach von der Flut."


@pytest.mark.parametrize(
    ("question", "answer", "broken", "defect"),
    [
        (QUESTION, ANSWER, False, None), (QUESTION, None, False, "empty"), (QUESTION, " ", False, "empty"), (QUESTION, "N/A", False, "empty"), (QUESTION, ANSWER[:-20], True, "truncated"),
        (QUESTION, "I'm sorry, but I can't help with this.", False, "refusal"), (QUESTION, "I must decline.\n\nIf you like, I can write about a garden and its trees. If you like, I can name a second mill.", False, "refusal"),
        (QUESTION, "Es tut mir leid, dabei kann ich nicht helfen.", False, "refusal"), (QUESTION, "Lo siento, no puedo escribir ese texto.", False, "refusal"),
        (QUESTION, QUESTION, False, "copy"), (QUESTION, "Sure!\n\n" + QUESTION.lower(), False, "copy"), (QUESTION, GERMAN, False, "language"), (QUESTION + " Answer in German only.", GERMAN, False, None),
        (None, GERMAN, False, None), ("", GERMAN, False, None), (QUESTION, "I cannot remember a bridge like it. " + ANSWER, False, None), (QUESTION, "The council declined to help the miller. " + ANSWER, False, None),
    ],
)
def test_pair_defects(question, answer, broken, defect):
    got = pairs.tag_batch(model(), [(question, answer, broken)])[0][0]
    assert got == defect


_model = []


def model():
    if not _model:
        rng = random.Random(2)
        words = "bridge river mill tower garden road field house boat wind stone light".split()
        make = lambda: " ".join(f"The {rng.choice(words)} is near the {rng.choice(words)}, and it was {rng.choice(['old', 'wide', 'kind'])}." for _ in range(rng.randint(4, 9)))
        ask = lambda: f"Write an essay about the {rng.choice(words)} that pleases a {rng.choice(words)}. Keep the tone plain but never cold. Name one {rng.choice(words)} that would help. Ask how a {rng.choice(words)} meets the {rng.choice(words)}."
        _model.append(pairs.train([(ask(), make()) for _ in range(200)]))
    return _model[0]


def test_pair_table_edges(spark):
    rows = [(1, QUESTION, ANSWER, ANSWER, False), (2, None, None, None, None), (3, "", "", "", False), (4, QUESTION, LONG, None, False)]
    df = spark.createDataFrame(rows, "k long, q string, a string, b string, cut boolean").withColumn("field", F.lit("clash"))
    got = {(r["k"], r["field"]): r["defect"] for r in pairs.pair_defects(df, "k", ["q", "a", "b"], ["cut", "cut"]).collect()}
    assert all(got[k, f] == "empty" for k in (2, 3) for f in "ab") and got[4, "b"] == "empty" and len(got) == 8
    assert pairs.pair_defects(df.limit(0), "k", ["q", "a", "b"], ["cut", "cut"]).count() == 0


def test_question_that_declines_whatever_its_length():
    """An answer in another language is no defect behind a refusal, read by the field and not by its length."""
    no = "I'm sorry, but I can't write this essay. " + " ".join(f"If you like, I can write about the {w} and the mill by the river instead." for w in ("garden", "bridge", "tower", "field", "road", "house"))
    german = "Der Fluss ist breit und die Brücke ist alt. Wir gingen am Abend an ihm entlang. Jedes Haus hat einen Garten und man sieht es."
    first, second = (r[0] for r in pairs.tag_chain(model(), [[pairs.Reading(QUESTION)], [pairs.Reading(no)], [pairs.Reading(german)]], [[False], [False]]))
    assert first[0] == "refusal" and second[0] is None
    assert pairs.tag_batch(model(), [(no, german, False)])[0][0] is None
    assert pairs.tag_batch(model(), [(QUESTION, QUESTION, False)])[0][0] == "copy"
    assert pairs.tag_batch(model(), [(QUESTION, german, False)])[0][0] == "language"


def test_plain_prose_needs_no_search_for_cues(monkeypatch):
    """Single words of cues aren't enough to look a clause through."""
    text = "The topic of my essay is a mill. I like its text and the answer. No bridge is as plain. A place to turn to, if it rains! Happy is the task's end."
    searched = []
    monkeypatch.setattr(pairs.Reading, "raw", lambda self, i: searched.append(i) or "")
    reading = pairs.Reading(text)
    assert not any(reading.cues) and not any(reading.offers) and not searched


@pytest.mark.parametrize(
    ("text", "cues", "offers"),
    [
        ("I'm not able to help. This topic is off limits'x. The topic can't be one.", [1, 2, 1], [0, 0, 0]), ("I must decline. I mustdecline. My answer is no", [1, 1, 1], [0, 0, 0]),
        ("I don’t write it. Ich kann das nicht. Mühle und i entschuldigungen!", [1, 1, 1], [0, 0, 0]), ("There is no way to do that. Let's talk about anything else.", [1, 1], [0, 0]),
        ("If you like, I can go. You could turn to it. It stood a'place à la place. Que'instead'", [0, 0, 0, 0], [1, 1, 1, 0]),
        ("A mill!\nno essay will be.\"\n\n'Tis 3.5 m… I cannot answer", [0, 1, 1], [0, 0, 0]),
    ],
)
def test_cues_of_clauses(text, cues, offers):
    reading = pairs.Reading(text)
    assert (reading.cues, reading.offers) == (cues, offers)


def test_words_of_clauses_by_definition():
    """Plain and other texts, read by different ways, and a clause's features as one number."""
    rng = random.Random(3)
    pieces = ["mill", "don't", "'tis'", "3.5", ".", "?!\"", ")", " ", " ", " ", "\n", "_", "I'm", "the", "…"]
    last = pairs.Reading(None)
    for i in range(2000):
        text = "".join(rng.choice([*pieces, *(["é", "’", "。"] if i % 2 else [])]) for _ in range(rng.randrange(1, 30)))
        want = [ws for ws in map(pairs.WORD.findall, re.split(r"[.!?。！？]+[\"'”’»)\]*]*(?=\s|$)|\n", text.lower())) if ws] or [[]]
        now = pairs.Reading(text)
        assert now.each == want and len(now.each) == len(now.cues)
        f = pairs.features(last, now, bool(i % 3))
        assert len(f) == len(want) and all(len(x) == len(set(x)) == pairs.WIDTH and max(x) < pairs.FEATURES for x in f)
        assert (pairs.OFFSET["broken"] + 1 in f[-1]) == bool(i % 3)
        last = now


def test_clauses_far_into_a_text_are_learned():
    f = [[0, 1]] * 60
    x, lengths = pairs.pad([f[:24], f[24:48], f[48:]], pairs.WIDTH)
    x[x < 0] = pairs.FEATURES
    fitted = pairs.CRF(pairs.FEATURES, 2).fit(x, lengths, np.zeros(x.shape[:2], dtype=np.int32), np.array([True, False, False]))
    assert (fitted.decode(x, lengths)[0] == 0).all()


# ---- tokens ------------------------------------------------------------------------------------


@pytest.mark.skipif(not HAVE_TOKENIZERS, reason="no vocabulary files here")
class TestTokens:
    @pytest.fixture()
    def reference(self):
        import tiktoken

        path = tokens.vocabulary_path(name="byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranked = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = tokens.SPLIT.removeprefix("(?U)")
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranked, special_tokens={})

    def texts(self):
        rng = random.Random(5)
        bits = ["a", "aa", "the", " ", "ing", "er", "th", "\n", "\t", "0", "12", "é", "—", "🙂", "日本", "'s", "'re", "!", "..", "=", "-", "x", "ll", " ", "　", "<|endoftext|>", "ß", "\r\n"]
        return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]

    def test_table_stays_bounded_and_ids_the_same(self, reference, monkeypatch):
        monkeypatch.setattr(tokens, "MAX_STATES", 300)
        run = tokens.runner(tokens.vocabulary_path())
        run.reset()
        texts = self.texts()[:400]
        got = tokens.encode_words(pa.array([[t] for t in texts]), tokens.vocabulary_path()).to_pylist()
        assert len(run.emits) + len(run.arcs) + run.held < 300 + 2000
        run.reset()
        monkeypatch.undo()
        assert got == tokens.encode_words(pa.array([[t] for t in texts]), tokens.vocabulary_path()).to_pylist()

    def test_same_ids_and_round_trip(self, spark, reference):
        texts = [*self.texts(), LONG, "a" * 5000, "", None]
        df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("ids", F.lit("clash"))
        got = {r["k"]: r["ids"] for r in tokens.encode_corpus(df, "k", "text").collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            assert got[k] == reference.encode_ordinary(t or ""), repr(t)
        for k in range(0, 500, 5):
            assert tokens.decode_ids(got[k], tokens.vocabulary_path()) == texts[k]

    def test_counts_and_empty_table(self, spark):
        df = spark.createDataFrame([(1, "hello world"), (2, None)], "k long, text string")
        assert [r["n"] for r in df.select(tokens.token_counts(F.col("text")).alias("n")).collect()] == [2, 0]
        assert tokens.encode_corpus(df.limit(0), "k", "text").count() == 0


# ---- packing -----------------------------------------------------------------------------------


def test_plan_fills_and_never_overfills():
    rng = random.Random(4)
    for capacity in (1, 7, 64, 512):
        counts = {length: rng.randrange(0, 40) for length in range(1, capacity + 1)}
        used, seen = {}, {length: 0 for length in counts}
        for length, a, b, first, offset in packing.plan_counts(counts, capacity):
            assert a == seen[length] and b > a
            seen[length] = b
            for c in range(first, first + b - a):
                assert used.get(c, 0) == offset
                used[c] = offset + length
        assert seen == counts and all(v <= capacity for v in used.values())
        total = sum(k * v for k, v in counts.items())
        assert len(used) <= -(-total // capacity) * 11 / 9 + 1


def test_pack(spark):
    rng = random.Random(9)
    sizes = [(i, 40 if i % 3 == 0 else rng.randrange(0, 260)) for i in range(3000)] + [(5000, None), (5001, 0)]
    df = spark.createDataFrame(sizes, "k long, n int").withColumn("length", F.lit("clash")).withColumn("capacity", F.lit(1))
    out = packing.pack(df, "k", "n", [100, 64, 100, None])
    rows = out.collect()
    for capacity in (100, 64):
        mine = [r for r in rows if r["capacity"] == capacity]
        per: dict = {}
        for r in mine:
            per.setdefault(r["k"], []).append(r["piece_size"])
            assert (r["container"] is None) == (r["piece_size"] == 0)
        assert {k: sum(v) for k, v in per.items()} == {k: n or 0 for k, n in sizes}
        assert all(len(v) == max(1, -(-s // capacity)) for (k, s), v in ((x, per[x[0]]) for x in sizes if x[1]))
        spans: dict = {}
        for r in mine:
            if r["container"] is not None:
                spans.setdefault(r["container"], []).append((r["item_offset"], r["item_offset"] + r["piece_size"]))
        for s in spans.values():
            s.sort()
            assert s[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        assert sorted(spans) == list(range(len(spans)))
    report = {r["capacity"]: r for r in packing.packing_report(out).collect()}
    assert report[100]["containers"] <= report[100]["least_containers"] * 1.05  # the 1,000 items of 40 leave gaps of 20
    assert packing.pack(df.limit(0), "k", "n", [100]).count() == 0
    assert packing.pack(df, "k", "n", []).count() == 0


# ---- abuse -------------------------------------------------------------------------------------


def corpus(n, seed):
    rng = random.Random(seed)
    things = "river mill tower garden road field house boat wind stone light kettle painter".split()
    calm = lambda: f"The {rng.choice(things)} of the {rng.choice(things)} follows a {rng.choice(things)} by noon."
    bad = lambda: rng.choice([f"You are a worthless idiot and your {rng.choice(things)} is trash.", f"Shut up, you pathetic moron, nobody wants your {rng.choice(things)}.", f"Those foreigners near the {rng.choice(things)} are vermin and must be thrown out.", f"He fucked her behind the {rng.choice(things)} all night."])
    decoy = lambda: rng.choice([f"The word idiot once named a private person, says the {rng.choice(things)}.", f"Vermin lived in the {rng.choice(things)} until it was sealed.", f"The foreigners were welcomed at the {rng.choice(things)}."])
    texts, truth, label = [], [], []
    for _ in range(n):
        s = [calm() for _ in range(rng.randint(1, 6))]
        y = rng.random() < 0.1
        if y:
            s.insert(rng.randrange(len(s) + 1), bad())
        elif rng.random() < 0.3:
            s.append(decoy())
        texts.append(" ".join(s))
        truth.append(int(y))
        label.append(int(y) if rng.random() > 0.01 else 1 - int(y))
    return texts, truth, label


def test_machine_on_held_out_documents():
    texts, _, label = corpus(1500, 1)
    machine = abuse.train(texts, label)
    held, truth, _ = corpus(800, 2)
    flagged = abuse.score_texts(machine, pa.array(held)) >= machine.cut
    truth = np.array(truth, dtype=bool)
    assert (flagged & truth).sum() >= 0.95 * truth.sum()
    assert (flagged & ~truth).sum() <= 0.02 * len(truth)
    plain = "You are a worthless idiot and your mill is trash."
    disguised = ["You are a w0rthl€ss 1d10t and your mill is tr@sh.", "You are a worthless i.d.i.o.t and your mill is trash.", "Yоu are а worthless idiot and your mill is trash.", "You are a woooorthless idiot and your mill is traaaash."]
    scores = abuse.score_texts(machine, pa.array([plain, *disguised]))
    assert (scores >= machine.cut).all()


def test_readings():
    assert "idiot" in abuse.readings("1d10t")[0] and "idiot" in abuse.readings("i.d.i.o.t")[0] and "idiot" in abuse.readings("idiooooot")[0]
    assert abuse.readings("i***t")[1] and abuse.readings("house") == ([], False)


def test_disguises_of_any_length():
    def terms(text):
        s = abuse.Sentences(pa.array([text]))
        return set(s.terms[s.of == 0].tolist())

    want = lambda w: int(abuse.hash_word(w) % np.uint64(abuse.DIM))
    assert want("connard") in terms("c o n n a r d, dit il") and want("idiot") in terms("so i d i o t. Then")
    assert want("idiot") in terms("1d1ooo" + "o" * 200 + "t")
    assert len(abuse.readings("1mbec11e")[0]) == 8 and "imbecile" in abuse.readings("1mbec1|e")[0] and "assholes" in abuse.readings("@$$ho1e$")[0]
    many = abuse.readings("1|1|1dio1")[0]  # too many ambiguous signs to spell out
    assert {"iiiiidioi", "llllldiol"} <= set(many) and len(many) < 40


def test_word_hash_is_that_of_the_arrays():
    s = abuse.Sentences(pa.array(["Idiot ÄRGER"]))
    assert s.terms[0] == int(abuse.hash_word("idiot") % np.uint64(abuse.DIM)) and s.terms[1] == int(abuse.hash_word("arger") % np.uint64(abuse.DIM))


def test_score_documents_edges(spark):
    texts, _, label = corpus(300, 3)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "?!"), (903, LONG), (904, texts[0]), (904, texts[0])]
    docs = spark.createDataFrame(rows, "k long, t string").withColumn("toxic", F.lit(7)).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([*enumerate(label), (1, None), (None, 1)], "k long, y int")
    got = abuse.score_documents(docs, labels, "k", "t", "y").collect()
    assert len(got) == len(rows)
    by = {r["k"]: r for r in got}
    assert by[900]["score"] == by[901]["score"] == by[902]["score"] == 0 and not by[900]["flagged"]
    assert by[904]["score"] == by[0]["score"]
    assert abuse.score_documents(docs.limit(0), labels, "k", "t", "y").count() == 0
    assert abuse.score_documents(docs, labels.limit(0), "k", "t", "y").count() == len(rows)
