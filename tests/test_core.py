"""Exact values of metrics and operators, edge strings, goldens."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosemill.functions import arrays as A
from prosemill.functions import text as X
from prosemill.functions import udfs as U
from prosemill.operators import evaluate as E
from prosemill.operators import models as M
from prosemill.operators import ranks as R
from prosemill.operators import relational as J
from prosemill.operators import sampling as S
from prosemill.operators import search, synth
from prosemill.sources import io
from prosemill.streaming import logs

EDGES = ["", "   ", "one", "a b\u0085c", "größer über été", "🙂 🙂", "?!...", "—", "a a a a a a", "- x\n* y\n1) z\n1. w", "a b c", "a b c d", None]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs])


@pytest.mark.parametrize(
    ("probs", "mask", "reduction", "fraction", "expected"),
    [
        ((0.1, 0.2, 0.3), (1, 1, 1), "mean", 0.1, 0.2), ((0.5, 0.5, 0.5), (1, 1, 0), "mean", 0.1, 0.5), ((0.1, 0.2, 0.3), None, "mean", 0.1, 0.2),
        ((0.1, 0.2, 0.3), None, "sum", 0.1, 0.6), ((0.1, 0.9, 0.2), (1, 1, 1), "max", 0.1, 0.9), ((0.3, 0.3, 0.0), (1, 1, 0), "max", 0.1, 0.3),
        ((0.1, 0.2, 0.3, 0.4), None, "topk", 0.5, 0.35),
    ],
)
def test_pooling(spark, probs, mask, reduction, fraction, expected):
    got = one(spark, A.pool(doubles(*probs), reduction, fraction, ints(*mask) if mask else None))
    assert got == pytest.approx(expected)


def test_reward_is_one_minus_mean(spark):
    assert one(spark, 1 - A.mean(doubles(*[0.1] * 10))) == pytest.approx(0.9)


def test_diagnostics_values(spark):
    assert one(spark, X.repetition_ratio(X.words(F.lit("the the the cat")))) == pytest.approx(0.5)
    assert one(spark, X.length_penalty(F.lit(2), 5, 100)) == pytest.approx(0.6)
    assert one(spark, X.length_penalty(F.lit(5), 5, 100)) == 0
    assert one(spark, X.repeated_dash_ratio(F.lit("—"))) == 1.0
    assert one(spark, X.repeated_dash_ratio(F.lit("-"))) == 0.0
    assert one(spark, X.repetition_ratio(X.words(F.lit("a a a a a a")))) > 1


def test_every_metric_takes_edge_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, text string")
    t = F.col("text")
    w, tok, ls = X.words(t), X.tokens(t), X.lines(t)
    metrics = {
        **X.structural(t, ls), "rep": X.repetition_ratio(w), "caps": X.caps_ratio(t), "info": X.information_density(tok), "filler": X.filler_loop_score(t),
        "clear": X.clarity(t, F.lit(0.0), F.lit(0.0), F.lit(0.0)), "style": X.lightweight_style(t, tok), "rep3": X.ngram_repetition(tok), "d2": X.distinct_n(tok),
        "zip": U.compression_ratio(t), "punct": X.punct_density(t),
    }
    rows = df.select("i", *[c.cast("double").alias(n) for n, c in metrics.items()]).collect()
    assert len(rows) == len(EDGES)
    assert all(r[n] is not None for r in rows for n in metrics)


def test_self_bleu_takes_all_texts(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(rng.choices(["the", "a", "mill", "near", "ran", "it", "of", "Mill,", "a-b"], k=rng.choice([0, 2, 3, 9, 30])))) for i in range(150)]
    rows += [(200, "single", "one text"), (201, "a", None), (202, "a", "none shared"), (203, "far", "x y"), (204, "far", "z")]
    got = {r["g"]: r["self_bleu"] for r in U.self_bleu(spark.createDataFrame(rows, "k long, g string, t string"), "g", "t", "k").collect()}
    for g in ("a", "b", None):
        ws = [re.findall(r"\w+", t.lower()) for _, x, t in rows if x == g and t is not None]
        values = [U.bleu(c, ws[:i] + ws[i + 1 :]) for i, c in enumerate(ws)]
        assert got[g] == pytest.approx(sum(values) / len(values))
    assert got["single"] != got["single"] and got["far"] == 0


@pytest.mark.parametrize("name", ["ml_02_tfidf", "ml_03_regression", "win_35_top_features"])
def test_tfidf_queries_keep_the_whole_vocabulary(spark, monkeypatch, tmp_path, name):
    import __spark_entry__ as entry_module

    rows = [(i, " ".join(f"w{i % 50 * 60 + j}" for j in range(60)), i / 200) for i in range(200)]  # 3,000 words in four documents each
    spark.createDataFrame(rows, "pair_id long, input_prompt string, input_slop_score double").write.parquet(str(tmp_path / "prompt_pairs.parquet"))
    sizes, tfidf = [], M.tfidf

    def watched(*args, **kw):
        made = tfidf(*args, **kw)
        sizes.append(len(made[1]))
        return made

    monkeypatch.setattr(M, "tfidf", watched)
    entry_module.queries()[name](spark, str(tmp_path))
    assert sizes == [3000 + 50 * 59]


def test_logged_prefix_takes_500_characters(spark, tmp_path):
    import __spark_entry__ as entry_module

    same, long = "An opening that many essays share, word for word, for sixty characters. ", "x" * 480
    pairs = [(1, same + "One."), (2, same + "Two."), (3, long + "a" * 40), (4, long + "a" * 10 + "b" * 30), (5, ""), (6, None), (7, " ")]
    log = [(1, same + "One."), (2, same), (3, long + "a" * 20 + "z"), (4, ""), (5, " "), (6, None), (7, "A")]
    spark.createDataFrame(pairs, "pair_id long, best_essay string").write.parquet(str(tmp_path / "prompt_pairs.parquet"))
    spark.createDataFrame(log, "log_id long, essay string").write.parquet(str(tmp_path / "essay_log.parquet"))
    got = {tuple(r) for r in entry_module.queries()["join_10_logged_prefix"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 3), (7, 1), (7, 2)}


def test_label_chunks_keep_all_labels(spark, tmp_path):
    import __spark_entry__ as entry_module

    lengths = {1: 0, 2: 1, 3: 64, 4: 65, 5: 96, 6: 97, 7: 300}
    rows = [(k, list(range(n))) for k, n in lengths.items()] + [(8, None)]
    spark.createDataFrame(rows, "example_id long, labels array<int>").write.parquet(str(tmp_path / "slop_examples.parquet"))
    kept = {k: set() for k in lengths}
    for r in entry_module.queries()["arr_02_padded_label_chunks"](spark, str(tmp_path)).collect():
        labels = r["labels"].split(" ")
        assert len(labels) == len(r["mask"]) == 64 and all((x == "-100") == (m == "0") for x, m in zip(labels, r["mask"]))
        kept[r["example_id"]] |= {int(x) for x, m in zip(labels, r["mask"]) if m == "1"}
    assert kept == {k: set(range(n)) for k, n in lengths.items()}


def test_python_agrees_with_columns(spark):
    texts = [t for t in EDGES if t is not None] + ["The the quick brown fox, the quick brown fox. It ran; it ran!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["x"] for r in df.select("text", X.repetition_ratio(X.words(F.col("text"), X.WHITE_UNICODE)).alias("x")).collect()}
    for t in texts:
        ws = t.split()
        grams = list(zip(ws, ws[1:]))
        want = 2 * (len(grams) - len(set(grams))) / max(len(ws), 1) if len(ws) >= 4 else 0.0
        assert got[t] == pytest.approx(want)


def test_spans():
    assert (3, 11) in U.find_spans("So you know what I mean", ["you know"])
    assert (0, 7) in U.find_spans("The the quick brown fox", ["zzz"])
    assert U.find_spans("") == []


def test_label_examples(spark):
    human, slop = " ".join(f"h{i}" for i in range(80)), " ".join(f"s{i}" for i in range(80))
    df = spark.createDataFrame([(1, human, slop), (2, None, "x y")], "k int, a string, b string")
    rows = U.label_examples(df, "k", "a", "b", 32, 16).collect()
    assert sum(r["k"] == 1 for r in rows) >= 8
    for r in rows:
        assert len(r["mask"]) == len(r["labels"]) == 32
        assert all(label == -100 for m, label in zip(r["mask"], r["labels"]) if m == 0)
        assert {label for m, label in zip(r["mask"], r["labels"]) if m} == {int(r["source"] == "slop")}


def test_clean_output():
    body = " ".join(["word"] * 60)
    assert U.clean_output(f"Sure! {body} 🙂\nLet me know if you like it.") == body
    assert U.clean_output("too short") is None and U.clean_output(None) is None


def _spans_by_definition(text, phrases, window=10, least=0.5):
    """Every start and end tried one by one."""
    ws, low = text.split(), text.lower()
    joined = [len(" ".join(ws[:k])) for k in range(len(ws) + 1)]
    want = {(i, i + len(p)) for p in phrases for i in range(len(low)) if low[i : i + len(p)] == p.lower()}
    for i in range(len(ws)):
        for j in range(i + 2, len(ws) + 1):
            run = {w.lower() for w in ws[i:j]}
            wider = (i > 0 and ws[i - 1].lower() in run) or (j < len(ws) and ws[j].lower() in run)
            if len(run) == 1 and not wider:
                want.add((joined[i], min(joined[j], len(text))))
    for i in range(len(ws) - window + 1):
        part = [w.lower() for w in ws[i : i + window]]
        if len(set(zip(part, part[1:]))) / (window - 1) < least:
            want.add((joined[i + 1], min(joined[i + window], len(text))))
    return sorted(want)


def test_spans_by_definition():
    import random

    rng = random.Random(8)
    pool = ["like", "um", "the", "The", "Kind", "of", "kind of", "a", "mill", "you", "know", "aaaa", "É", "日本"]
    texts = ["", " ", "x", *("".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", " "]) for _ in range(rng.randrange(40))) for _ in range(300))]
    texts += [" ".join(rng.choice(["ha", "ho"]) for _ in range(60)) for _ in range(30)]
    phrases = [*U.SLOP_PHRASES, "aa", "the mill"]
    assert U.batch_spans(texts, phrases) == [_spans_by_definition(t, phrases) for t in texts]


def test_entropy_of_batches():
    from collections import Counter
    from math import log2

    texts = ["", None, "a", "abab", "日本日", "aé日\U0001f642" * 7, " ", *("x" * k + "y" for k in range(1200))]
    got = U.char_entropy.func(pa.array(texts)).to_pylist() if hasattr(U.char_entropy, "func") else None
    for t, x in zip(texts, got or []):
        want = -sum(c / len(t) * log2(c / len(t)) for c in Counter(t).values()) if t else None
        assert x is None if want is None else x == pytest.approx(want, abs=1e-9)
    assert got is not None


def test_fluency_and_greedy_match(spark):
    from math import exp

    df = spark.createDataFrame([([-1.0, -3.0], [[1.0, 0.0], [0.0, 1.0]], [[0.0, 2.0]]), ([], [[1.0, 0.0]], [[0.0, 0.0]])], "p array<double>, a array<array<double>>, b array<array<double>>")
    x, y = df.select(A.fluency(F.col("p")).alias("f"), A.perplexity(F.col("p")).alias("ppl"), *[c.alias(n) for n, c in A.greedy_match(F.col("a"), F.col("b")).items()]).collect()
    assert x["f"] == -2 and x["ppl"] == pytest.approx(exp(2)) and x["precision"] == 0.5 and x["recall"] == 1 and x["f1"] == pytest.approx(2 / 3)
    assert y["f"] is None and y["ppl"] is None and y["f1"] is None


def test_rouge_and_bleu():
    assert U.bleu(["x"], [["y"]]) == 0
    assert U.rouge_l("a b c d", "a x c d") == pytest.approx(0.75)
    assert U.rouge_l("", "a") == 0
    ws = "one two three four five".split()
    assert U.bleu(ws, [ws]) == pytest.approx(1.0)


def test_ranks_of_hot_groups_and_ties(spark):
    import random

    rng = random.Random(6)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([0.5, 0.5, 0.5, None, rng.random()])) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, s double").withColumn("__n", F.lit(1))
    ranked = R.ranks(df, ["g"], F.col("s"), "k", "n")
    assert R.score_ranges(df.filter("g = 'hot'"), F.col("s"), "k").groupBy("__range").count().agg(F.max("count")).first()[0] < 100  # no task gets the group or the tie whole
    got = {r["k"]: r["n"] for r in ranked.collect()}
    for g in ("hot", "b", None):
        mine = sorted((k for k, x, _ in rows if x == g), key=lambda k: (rows[k][2] is not None, rows[k][2] or 0, k))
        assert [got[k] for k in mine] == list(range(1, len(mine) + 1))
    best = {r["k"]: r["m"] for r in R.prefix(R.score_ranges(df, F.col("k")), ["g"], ["k"], F.col("s"), "m", least=True).collect()}
    for g in ("hot", None):
        least = None
        for k, x, s in rows:
            if x == g:
                assert best[k] == least
                least = s if least is None else least if s is None else min(least, s)
    assert R.ranks(df.limit(0), ["g"], F.col("s"), "k", "n").count() == 0


def test_auc_and_spearman(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, y boolean")
    assert E.roc_auc(E.by_score(df, "s", F.col("y"))).first()["auc"] == pytest.approx(0.875)
    assert E.roc_auc(E.by_score(df.filter("y"), "s", F.col("y"))).first()["auc"] == 0.0
    assert E.roc_auc(E.by_score(df.filter("y"), "s", F.col("y")), None).first()["auc"] is None
    pairs = spark.createDataFrame([(1.0, 10.0), (2.0, 30.0), (3.0, 20.0), (4.0, None)], "a double, b double")
    assert E.spearman(pairs, "a", "b").first()["spearman"] == pytest.approx(0.5)


def test_gate_summary_of_nothing(spark):
    df = spark.createDataFrame([], "s double, r double, i boolean")
    r = df.agg(*[c.alias(n) for n, c in E.gate_summary("s", "r", "i").items()]).first()
    assert tuple(r) == (0.0, 0.0, 1.0)


GOLDEN = [  # run, pass rate, mean delta, output, similarity, gap
    ("m1", 0.08, -0.06514743949829911, 0.10742400253672774, 0.9639634232521057, 0.4127918033087963),
    ("m2", 0.092, -0.06510171852059041, 0.10737828155901905, 0.960959770321846, 0.41284252078699946),
    ("m3", 0.104, -0.06519348890303324, 0.10747005194146186, 0.9628328394889831, 0.40975934552006466),
    ("m4", 0.16, 0.0003484229327489932, 0.041928140105679634, 0.8486262445896864, 0.3560099810200955),
    ("m5", 0.096, -0.0630797404802094, 0.10535630351863802, 0.9662863523960113, 0.41041118038809604),
    ("m6", 0.076, -0.06464808373572305, 0.10692464677415167, 0.9618501968383789, 0.4126639295984994),
    ("m7", 0.128, -0.029084322011408707, 0.07136088504983734, 0.898132761478424, 0.3800553532553416),
]


def test_leaderboard_golden(spark):
    df = spark.createDataFrame(GOLDEN, "run string, rate double, delta double, output double, similarity double, gap double")
    order = [F.desc("rate"), F.desc("delta"), "output", F.desc("similarity"), "gap"]
    got = S.leaderboard(df, order, "delta", "rate").orderBy("rank").collect()
    assert [r["run"] for r in got] == ["m4", "m7", "m3", "m5", "m2", "m1", "m6"]
    assert got[1]["delta_from_leader"] == pytest.approx(-0.0294327449441577)
    assert got[6]["pass_rate_from_leader"] == pytest.approx(-0.084)


def test_progression_golden(spark):
    df = spark.createDataFrame([(0, 0.9990, 0.0), (50, 0.7677072914871192, 0.397158203125), (500, 0.66999, 0.5183)], "step int, score double, kl double")
    r = df.agg((F.max_by("score", "step") - F.min_by("score", "step")).alias("d")).first()
    assert round(r["d"], 4) == -0.3290


def test_keyed_overwrite_and_backfill(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert {(r["k"], r["v"]) for r in J.keyed_overwrite([a, b], "k").collect()} == {(1, "a"), (2, "b"), (3, "b")}
    assert {(r["k"], r["v"]) for r in J.backfill(a, b, "k", 5, ["k"]).collect()} == {(1, "a"), (2, "a"), (3, "b")}


def test_nearest_checks_its_centers(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    c = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.1, 1.0])], "g int, centroid array<double>")
    assert {(r["k"], r["g"]) for r in J.nearest(e, "k", "v", c, "g").collect()} == {(1, 7), (2, 8)}
    with pytest.raises(ValueError):
        J.nearest(e, "k", "v", c, "g", most_centers=1)


def test_ranked_without_one_sort(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    got = {r["v"]: r["n"] for r in S.ranked(df, "v", "n").collect()}
    assert got == {v: v + 1 for v in range(500)}


def test_split_manifest_sizes(spark):
    for n, want in ((1, (1, 0)), (2, (1, 1)), (50, (40, 5))):
        df = spark.createDataFrame([(str(i), "x") for i in range(n)], "a string, b string")
        got = [r["split"] for r in S.split_manifest(df, ["a", "b"], 1, 0.8, 0.1).collect()]
        assert (got.count("train"), got.count("val")) == want and len(got) == n


def test_sloppify_labels():
    text = "The doctor saw the problem. The company had an idea. It was good."
    for mode in synth.PRESETS:
        out, labels = synth.sloppify(text, f"7|{mode}", mode)
        assert len(out.split()) == len(labels)
        assert synth.sloppify(text, f"7|{mode}", mode) == (out, labels)
    assert synth.sloppify("", "1", "easy") == ("", [])


def test_corrupt_number():
    assert synth.corrupt_number("in 1999 there were 12 cats", "1") != "in 1999 there were 12 cats"
    assert synth.corrupt_number("none", "1") == "none"


def test_scorer_adapters(spark):
    df = spark.createDataFrame([(1, "a a a a"), (2, "one two three"), (3, None), (4, "")], "k int, t string")
    got = {r["k"]: r["s"] for r in M.with_scores(df, "t", "s", M.heuristic_scorer).collect()}
    assert got[1] > got[2] and got[3] is None and got[4] == 0
    made = M.reuse_or_generate(df, "t", "t", "o", lambda: lambda ps: ["made"] * len(ps)).collect()
    assert {r["k"]: r["o"] for r in made} == {1: "a a a a", 2: "one two three", 3: "made", 4: "made"}


def test_prompt_search_finds_the_best_slot(spark):
    score = lambda df: df.withColumn("fitness", F.when(F.col("spec")["tone"] == "direct", 1.0).otherwise(0.0))
    found = search.prompt_search(spark, [{"tone": "warm"}], score, rounds=4, size=8, seed=1)
    assert found[0].fitness == 1.0 and found[0].spec["tone"] == "direct"


def test_bandit_prefers_the_better():
    b = search.Bandit(["a", "b"], epsilon=0.0)
    for _ in range(6):
        o = b.choose()
        b.update(o, 1.0 if o == "b" else 0.0)
    assert b.choose() == "b"


def test_moving_baseline(spark):
    values, b = [float(i % 7) for i in range(900)], 0.0
    for v in values:
        b = 0.9 * b + 0.1 * v
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    assert search.moving_baseline(df, "g", "i", "v").first()["baseline"] == pytest.approx(b, abs=1e-12)


def test_io_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "t string, n int")
    io.write_jsonl(df, str(tmp_path / "j"))
    io.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert io.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 4
    assert io.read_jsonl(spark, str(tmp_path / "none"), df.schema).count() == 0
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "none"), df.schema, missing_ok=False).count()
    io.write_csv(df, str(tmp_path / "c"), ["n", "t", "zz"])
    assert io.read_csv(spark, str(tmp_path / "c"), ["n"]).columns == ["n", "t"]
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "c"), ["missing"])
    (tmp_path / "a.json").write_text(json.dumps([{"t": "x", "n": 3}]))
    assert io.read_json_array(spark, str(tmp_path / "a.json"), df.schema).first()["n"] == 3
    (tmp_path / "l.txt").write_text("# note\nAlpha\nalpha\n\nBeta gamma\n")
    assert {r["keyword"] for r in io.read_keywords(spark, str(tmp_path / "l.txt")).collect()} == {"alpha", "beta gamma"}
    assert io.read_clean_lines(spark, str(tmp_path / "l.txt"), 2).count() == 2
    made = io.write_manifest(df.agg(F.count("*").alias("n")), str(tmp_path / "m.json"))
    assert made == {"n": 2} and json.loads((tmp_path / "m.json").read_text()) == made
    sha = io.fingerprints(spark, str(tmp_path / "l.txt")).first()["sha256"]
    assert io.manifest_matches(spark, {"source_sha256": sha}, str(tmp_path / "l.txt"))
    assert "| a | 1.00 |" in io.markdown_table(df, {"n": 2})
    for n in ("run-1", "run-3", "step-20", "step-100"):
        (tmp_path / "runs" / n).mkdir(parents=True)
    assert io.latest_run(spark, str(tmp_path / "runs"), r"run-\d").endswith("run-3")
    assert io.latest_checkpoint(spark, str(tmp_path / "runs")).endswith("step-100")
    (tmp_path / "t.yaml").write_text("topics:\n  - 'one'\n  - two\n")
    assert [r["topic"] for r in io.read_topics(spark, str(tmp_path / "t.yaml")).collect()] == ["one", "two"]


def test_stream_resumes_and_ratchets(spark, tmp_path):
    schema = "topic string, score double, log_id long"
    put = lambda rows, mode="append": spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).json(str(tmp_path / "in"))
    run = lambda: logs.merge_best(logs.tail(spark, str(tmp_path / "in"), schema), str(tmp_path / "best"), str(tmp_path / "cp"), "topic", ["score", "log_id"], compact_every=2).awaitTermination()
    put([("a", 0.5, 1), ("b", 0.7, 2)])
    run()
    put([("a", 0.6, 3), ("b", 0.2, 4)])
    run()
    assert {(r["topic"], r["log_id"]) for r in logs.ratchet_table(spark, str(tmp_path / "best"), "topic", ["score", "log_id"]).collect()} == {("a", 1), ("b", 4)}
    assert {k: sorted(v) for k, v in logs._complete(spark, str(tmp_path / "best")).items()} == {"v": [0, 1], "base": [1]}  # the second batch folded all
    put([("a", 0.1, 5)])
    run()
    assert {(r["topic"], r["log_id"]) for r in logs.ratchet_table(spark, str(tmp_path / "best"), "topic", ["score", "log_id"]).collect()} == {("a", 5), ("b", 4)}
    logs.drain(logs.tail(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
