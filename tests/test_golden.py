"""Golden inline tables for the scalar traps (FIXTURES.md part 3)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlab.functions import lexicon as L
from textlab.functions.parse import parse_json_reply, parse_two_line_reply
from textlab.functions.text import cast_label, compose_sentence, is_blank, null_to_empty


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("id").collect()]


def test_two_line_replies(spark):
    cases = [
        (1, "Explanation here\r\n1", 1, "Explanation here"),
        (2, "1", 1, ""),
        (3, "I think 1 is right", 1, "I think  is right"),
        (4, "both 0 and 1", 0, "both  and 1"),
        (5, "10", None, None),
        (6, "no digit here", None, None),
        (7, "Reason\n0   \n\n", 0, "Reason"),
        (8, "", None, None),
        (9, None, None, None),
        (10, "Line one\n  line two \n1", 1, "Line one line two"),
    ]
    df = spark.createDataFrame([(i, r) for i, r, _, _ in cases], "id int, reply string")
    lab, expl = parse_two_line_reply("reply")
    got = _rows(df.select("id", lab.alias("label"), expl.alias("expl")), "label", "expl")
    assert got == [(l, e) for _, _, l, e in cases]


def test_json_reply_cases(spark):
    cases = [
        (1, '{"DM": "hi", "Sentiment": "pos"}', "hi", "pos", "ok"),
        (2, '```json\n{"DM": "a", "Sentiment": "b"}\n```', "a", "b", "ok"),
        (3, '\n```json\n{"DM": "a"}\n```', "a", "", "ok"),
        (4, '{"DM": broken', "Error: invalid JSON", "Unknown", "error"),
        (5, '```\n{"DM": "x", "Sentiment": "y"}```', "x", "y", "ok"),
        (6, "Error: max retries reached.", "Error: invalid JSON", "Unknown", "error"),
        (7, '{"DM": "j{s}o$n\\\\"}', "j{s}o$n\\", "", "ok"),
    ]
    df = spark.createDataFrame([(i, r) for i, r, *_ in cases], "id int, reply string")
    dm, se, st = parse_json_reply("reply")
    got = _rows(df.select("id", dm.alias("dm"), se.alias("se"), st.alias("st")), "dm", "se", "st")
    assert got == [tuple(c[2:]) for c in cases]


def test_lexicon_cases(spark):
    rows = [(1, "I feel LONELY today"), (2, "LONELINESS"), (3, "unlonelyness"),
            (4, "lonely and miserable in solitude"), (5, "happy"), (6, "I'm not lonely, lol"),
            (7, "this song is lonely"), (8, "haha lonely"), (9, "I am alone and want friends"),
            (10, "so sad")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = df.select("id", F.array_join(L.keyword_hits("text"), ",").alias("hits"),
                    L.tone("text").alias("tone"), L.context_indicators("text").alias("ind"),
                    L.exception_reason("text").alias("reason"))
    got = {r["id"]: (r["hits"], r["tone"], r["ind"], r["reason"]) for r in out.collect()}
    assert got[1][0] == "lonely"
    assert got[2][0] == "loneliness"
    assert got[3][0] == "lonely"                     # substring, not word
    assert got[4][0] == "lonely,solitude,miserable"  # lexicon order
    assert got[4][1] == "negative"
    assert got[5] == ("", "neutral", "none", "neutral/positive context")
    assert got[6][3] == "explicit negation"          # first reason wins over humour
    assert got[7][3] == "referencing media/art"
    assert got[8][3] == "humorous context"
    assert got[9][2] == "social isolation, desire for connection"
    assert got[10][1] == "negative" and got[10][2] == "negative emotions"


def test_paraphrase_cases(spark):
    df = spark.createDataFrame([(1, "Lonely days"), (2, "sad and lonely"), (3, "nothing here"),
                                (4, "home alone, lonely at home")], "id int, text string")
    got = {r["id"]: r["o"] for r in df.select("id", L.paraphrase_one("text", "id").alias("o")).collect()}
    assert got[1] == "Lonely days"  # matched in lower case, replaced case-sensitively: unchanged
    assert got[2].startswith("sad and ") and got[2].split()[-1] in ("isolated", "alone", "solitary")
    assert got[3] == "nothing here"
    assert "lonely" not in got[4] and got[4].count("home") == 2  # first entry wins, then stop


def test_blank_and_cast_cases(spark):
    df = spark.createDataFrame([(1, None), (2, "   "), (3, "\t\n"), (4, "\u00a0"), (5, "abcde"),
                                (6, "abcdef")], "id int, text string")
    kept = [r["id"] for r in df.where(~is_blank("text")).orderBy("id").collect()]
    assert kept == [5, 6]
    casts = spark.createDataFrame([(1, "1.0"), (2, "0"), (3, "1.9"), (4, ""), (5, "x"), (6, "-0.5"), (7, "-1.9")], "id int, raw string")
    got = _rows(casts.select("id", cast_label("raw").alias("l")), "l")
    assert got == [(1,), (0,), (1,), (None,), (None,), (0,), (-1,)]
    e = spark.createDataFrame([(1, None), (2, 3)], "id int, v int")
    assert _rows(e.select("id", null_to_empty("v").alias("s")), "s") == [("",), ("3",)]


def test_compose_sentence_nulls(spark):
    df = spark.createDataFrame([(1, "Title ", None), (2, None, " body"), (3, None, None)],
                               "id int, title string, body string")
    got = _rows(df.select("id", compose_sentence("title", "body").alias("s")), "s")
    assert got == [("Title. ",), (". body",), (". ",)]


def test_metrics_cases(spark):
    from textlab.operators.metrics import binary_metrics, best_threshold
    rows = ([("all_right", y, y) for y in (1, 0, 1, 0)] + [("all_wrong", 1, 0), ("all_wrong", 0, 1)]
            + [("one_class", 1, 1), ("one_class", 1, 1)]
            + [("no_pred_pos", 1, 0), ("no_pred_pos", 0, 0), ("no_pred_pos", 0, 0)])
    df = spark.createDataFrame(rows, "model string, label int, prediction int")
    m = {r["model"]: r for r in binary_metrics(df).collect()}
    assert (m["all_right"]["accuracy"], m["all_right"]["f1"], m["all_right"]["specificity"]) == (1.0, 1.0, 1.0)
    assert (m["all_wrong"]["accuracy"], m["all_wrong"]["f1"], m["all_wrong"]["sensitivity"]) == (0.0, 0.0, 0.0)
    assert (m["one_class"]["f1"], m["one_class"]["specificity"], m["one_class"]["sensitivity"]) == (1.0, 0.0, 0.0)
    r = m["no_pred_pos"]
    assert (r["precision"], r["recall"], r["f1"], r["specificity"]) == (0.0, 0.0, 0.0, 1.0)
    assert r["accuracy"] == round(2 / 3, 6)
    probs = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.3), ("a", 1, 0.35), ("b", 1, 0.05), ("b", 0, 0.02)],
                                  "model string, label int, prob double")
    bt = {r["model"]: (r["best_threshold"], r["best_f1"]) for r in best_threshold(probs).collect()}
    assert bt["a"] == (0.3, 1.0)      # lowest cut-off wins the tie (0.30 and 0.30 < 0.35)
    assert bt["b"] == (0.5, 0.0)      # no F1 above 0: default


def test_early_stop_cases(spark):
    from textlab.operators.trials import early_stop
    seqs = {1: [0.50, 0.505, 0.508], 2: [0.50, 0.515, 0.52, 0.526], 3: [0.5, None, 0.501, None, 0.502],
            4: [0.1, 0.2, 0.3]}
    rows = [(t, s + 1, v) for t, vals in seqs.items() for s, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "trial int, step long, eval_f1 double")
    res = {r["trial"]: (r["stop_step"], r["best_at_stop"]) for r in early_stop(df, patience=2, threshold=0.01).collect()}
    assert {t: v[0] for t, v in res.items()} == {1: 3, 2: None, 3: 5, 4: None}  # trial 2: a running max stops at 4
    assert res[1][1] == 0.5 and res[2][1] == 0.526


def test_tiny_vectors_kmeans(spark):
    from textlab.operators.cluster import seeded_kmeans
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [10.0, 0.0]), (4, [5.0, 0.0])],
                               "id int, embedding array<double>")
    r = seeded_kmeans(df, init_centroids=[[0.0, 0.0], [10.0, 0.0]], max_iter=1)
    # point 4 is equidistant at the first assignment -> cluster 0
    assert r.centroids[0] == pytest.approx([5.0 / 3, 0.0])
    r2 = seeded_kmeans(df, init_centroids=[[0.0, 0.0], [1000.0, 1000.0]], max_iter=3)
    assert r2.centroids[1] == [1000.0, 1000.0]  # empty cluster keeps its centroid
    assert {x["cluster"] for x in r2.assignments.collect()} == {0}


def test_topk_and_semantic_cases(spark):
    from textlab.operators.fewshot import semantic_balanced
    from textlab.operators.knn import knn
    pool = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 0), (3, [0.9, 0.1], 1),
                                  (4, [0.0, 1.0], 0), (5, [-1.0, 0.0], 1)], "id long, embedding array<double>, label int")
    tgt = spark.createDataFrame([(100, [1.0, 0.0])], "id long, embedding array<double>")
    nb = knn(tgt, pool, 2, pool_extra=["label"])
    assert [r["neighbor_id"] for r in nb.orderBy("rank").collect()] == [1, 2]  # tie -> smaller id
    nb6 = knn(tgt, pool, 6, pool_extra=["label"])
    sel = semantic_balanced(nb6, 3)
    assert sorted(r["neighbor_id"] for r in sel.collect()) == [1, 2, 3]  # odd k: 1 per class + fill
    # the target itself is excluded from its own neighbours
    self_nb = knn(pool, pool, 4)
    assert self_nb.where("target_id = neighbor_id").count() == 0


def test_quadrant_cases(spark):
    from textlab.operators.fewshot import quadrant_few_shot
    rows = ([(i, 0, 1, [float(i), 0.0]) for i in range(5)] + [(10, 1, 0, [1.0, 1.0])]
            + [(20 + i, 1, 1, [0.0, float(i)]) for i in range(3)])
    pool = spark.createDataFrame(rows, "id long, cluster int, original_label int, embedding array<double>")

    def pick(k, **kw):
        out = quadrant_few_shot(pool, k, 3, **kw).collect()
        return sorted((r["quadrant"], r["id"]) for r in out)

    got = pick(2)
    q01 = [i for q, i in got if q == "0_1"]
    assert q01 == [1, 2]                      # oversample 1: exactly the 2 nearest to the centroid (2, 0)
    assert [i for q, i in got if q == "1_0"] == [10]   # smaller than its quota
    assert not [i for q, i in got if q == "0_0"]       # empty quadrant
    assert len([i for q, i in got if q == "1_1"]) == 1  # max(1, 2 // 3)
    assert not [q for q, _ in pick(2, no_exceptions=True) if q in ("0_0", "1_1")]
    assert [i for q, i in pick(1) if q == "0_1"] == [2]


def test_two_line_reply_unicode_line_breaks(spark):
    # Python's splitlines also breaks on U+2028 and vertical tab; so does \R
    df = spark.createDataFrame([(1, "Because of tone\u20281"), (2, "Short note\x0b0"), (3, "a\u0085b\r\n1")],
                               "id int, reply string")
    lab, expl = parse_two_line_reply("reply")
    got = _rows(df.select("id", lab.alias("label"), expl.alias("expl")), "label", "expl")
    assert got == [(1, "Because of tone"), (0, "Short note"), (1, "a b")]


def test_few_shot_prompt_options(spark):
    """A target never sees itself; without reasoning there is no worked example; sections keep their order."""
    from textlab.functions import prompts as P
    rows = [(1, "so lonely and sad", 1, 1), (2, "nice day", 0, 2), (3, "all alone, I wish", 1, 3), (4, "a lonely song", 0, 4)]
    df = spark.createDataFrame(rows, "id long, text string, label int, g int")
    rates = F.struct(F.lit(0.79).alias("p_pos_given_kw"), F.lit(0.21).alias("p_neg_given_kw"),
                     F.lit(0.8).alias("p_neg_given_nokw"), F.lit(0.2).alias("p_pos_given_nokw"))
    one = P.example("id", "id", "text", "label", F.col("g"), P.quadrant_reasoning("text", F.col("g"), rates),
                    P.quadrant_lead("text", F.col("g"), rates))
    arr = df.agg(F.array_sort(F.collect_list(one)).alias("ex"))
    t = df.crossJoin(arr)
    make = lambda **kw: {r["id"]: r["p"] for r in t.select(
        "id", P.few_shot_prompt("text", F.col("ex"), F.lit("R"), P.SECTIONS, **kw).alias("p")).collect()}
    full = make(target_id="id")
    assert '### Worked example\nMessage: "all alone, I wish"' in full[1] and 'Message: "so lonely' not in full[1].split("### Target")[0]
    assert '### Worked example\nMessage: "so lonely and sad"\nReasoning: cue words present: lonely; tone: negative; follows the pattern (79%)' in full[2]
    heads = [full[2].find(h) for _, h in P.SECTIONS]
    assert heads[1] == -1 and 0 < heads[0] < heads[2] < heads[3]
    assert "reason: referencing media/art" in full[2] and "indicators: social isolation, desire for connection" in full[2]
    plain = make(chain_of_thought=False)
    assert "Reasoning" not in plain[1] and "Worked" not in plain[1] and 'Message: "so lonely' in plain[1].split("### Target")[0]


def test_rank_auc_counts_pairs(spark):
    import itertools
    import random
    from textlab.operators.metrics import rank_auc
    rng = random.Random(1)
    rows = [(g, rng.choice([0, 1]), rng.choice([0.1, 0.2, 0.5, 0.5, rng.random()])) for g in ("a", "b", None) for _ in range(60)]
    rows += [("a", None, 0.3), ("a", 1, None), ("one", 1, 0.5), ("sep", 0, 0.1), ("sep", 1, 0.9), ("sep", 1, 0.8)]
    got = {r["g"]: r for r in rank_auc(spark.createDataFrame(rows, "g string, label int, prob double"), ["g"]).collect()}
    for g in ("a", "b", None, "sep"):
        pos = [p for h, y, p in rows if h == g and y == 1 and p is not None]
        neg = [p for h, y, p in rows if h == g and y == 0 and p is not None]
        wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
        assert (got[g]["positives"], got[g]["negatives"]) == (len(pos), len(neg))
        assert abs(got[g]["auc"] - wins / (len(pos) * len(neg))) < 1e-12
    assert got["one"]["auc"] is None and got["sep"]["auc"] == 1.0


def test_median_by_radix_selection(spark):
    import math
    import random
    import statistics
    from textlab.operators.vectors import exact_median, median_flag, order_statistic
    rng = random.Random(2)
    for values in ([3], [1, 2], [5] * 9 + [6], [rng.randrange(10 ** 6) for _ in range(501)], [rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9) for _ in range(400)],
                   [-1e308, 1e308, 0.0, 1.5], [float("-inf"), 1.0, 2.0, float("inf")], [2.0, 2.0000000000000004]):
        kind = "long" if isinstance(values[0], int) else "double"
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
        assert exact_median(df, "v") == statistics.median(values)
    assert exact_median(df.where("v > 9"), "v") is None
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    assert order_statistic(nan, "v", 1) == float("inf") and math.isnan(order_statistic(nan, "v", 2))
    assert [r.long_text for r in median_flag(df.where("v > 9"), "v").collect()] == []


def test_silhouette_closed_form(spark):
    import numpy as np
    from textlab.operators.knn import silhouette_closed, silhouette_squared
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) + 1000 + np.repeat(np.arange(3), 20)[:, None]
    rows = [(int(i % 3 if i % 7 else i // 20), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "cluster int, embedding array<double>")
    want = silhouette_squared(df)
    for at_once in (1 << 20, 150):
        r = silhouette_closed(df, at_once=at_once).first()
        assert abs(r["silhouette"] - want) < 1e-5 and (r["n_points"], r["n_clusters"]) == (60, 3)
    alone = silhouette_closed(df.unionByName(spark.createDataFrame([(9, [0.0] * 5), (None, [0.0] * 5)], df.schema))).first()
    assert (alone["n_points"], alone["n_clusters"]) == (61, 4)


def test_submission_with_missing_columns(spark):
    from textlab.functions.text import submission_of
    df = spark.createDataFrame([("a", None), (None, "b")], "title string, content string")
    got = lambda x: [r[0] for r in x.select(submission_of(x)).collect()]
    assert got(df) == ["Title: a\nContent: No content", "Title: No title\nContent: b"]
    assert got(df.drop("title")) == ["Title: No title\nContent: No content", "Title: No title\nContent: b"]
    assert got(df.select("title")) == ["Title: a\nContent: No content", "Title: No title\nContent: No content"]


def test_random_sample_without_balance(spark):
    from textlab.operators.sampling import random_balanced
    df = spark.range(100).selectExpr("id", "cast(id < 95 as int) AS label")
    plain = {r.id for r in random_balanced(df, 20, "id", balanced=False).collect()}
    assert len(plain) == 20 and plain == {r.id for r in random_balanced(df.repartition(7), 20, "id", balanced=False).collect()}
    assert df.where("label = 0").join(random_balanced(df, 20, "id"), "id").count() == 5


def test_hashed_vectors_hold_the_terms(spark):
    """H1's vector has, at each term's hashed place, the weights of the terms (no two of these collide)."""
    from pyspark.ml.feature import HashingTF
    from textlab.operators.models import hashed_features, tfidf_terms
    df = spark.createDataFrame([(1, "a b b c"), (2, "b d"), (3, ""), (4, "A e! e")], "doc_id long, text string")
    place = HashingTF(numFeatures=1 << 18)
    want = {(r.doc_id, place.indexOf(r.term)): round(r.weight, 9) for r in tfidf_terms(df).collect()}
    got = {(r.doc_id, r["index"]): round(r.weight, 9) for r in hashed_features(df).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and len(want) == 7
