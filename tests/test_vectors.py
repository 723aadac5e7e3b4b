"""Hand-derived vectors of the written semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandweave.functions import numbers, texts, times
from strandweave.operators import discrepancies, pairs, ranks, scoring, windows
from strandweave.plans.models import endpoints


def col(spark, values, kind, f):
    return [r[1] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "pred,actual,f",
    [
        (["post", "reply", "reply", "like", "not interested"], ["post", "post", "reply", "like", "repost"], 0.583333),
        (["post", "reply", "repost", "like"], ["post", "reply", "repost", "like"], 1.0),
        (["post"] * 3, ["post"] * 3, 0.35),
        (["x"], ["post"], 0.0),
    ],
)
def test_weighted_f1(spark, pred, actual, f):
    df = spark.createDataFrame(list(zip(pred, actual, strict=True)), "p string, a string")
    assert round(df.agg(scoring.decision_f1(F.col("p"), F.col("a"))).first()[0], 6) == f


def test_quality_and_empty_l(spark):
    r = spark.range(1).select(numbers.quality(F.lit(0.8), F.lit(1.0)).alias("q"), numbers.quality(F.lit(0.8), F.lit(1.0), unit=True).alias("u")).first()
    assert round(r["q"], 9) == 0.88 and round(r["u"], 9) == 0.88
    df = spark.createDataFrame([(0.5, "a", "like", "t"), (float("nan"), "a", "post", "t"), (0.7, "", "post", "t")], "s double, p string, k string, t string")
    assert df.agg(scoring.content_similarity(F.col("s"), F.col("p"), F.col("k"), F.col("t"))).first()[0] == 0.0


def test_labels(spark):
    raw = ["repost", " Repost.", "unlikely", "I would like to reply", "Not interested", "", None]
    assert col(spark, raw, "string", texts.parse_action_type) == ["post", "post", "like", "reply", "not interested", "not interested", "not interested"]
    assert col(spark, ["RePost ", "re-post", "unlikely"], "string", texts.exact_action_type) == ["repost", "repost", "not interested"]


@pytest.mark.parametrize("m,n,want", [(6, 3, [0, 2, 5]), (8, 5, [0, 2, 4, 5, 7]), (7, 1, [3]), (5, 5, [0, 1, 2, 3, 4]), (10, 4, [0, 3, 6, 9]), (2, 3, None)])
def test_even_indexes(spark, m, n, want):
    assert spark.range(1).select(windows.even_indexes(F.lit(m), n)).first()[0] == want


@pytest.mark.parametrize("t,n,want", [([0, 1, 2, 10], 3, [0, 2, 3]), ([0, 4, 6, 10], 3, [0, 1, 3]), ([0, 1, 2, 3, 100], 4, [0, 2, 3, 4]), ([0, 50, 51, 100], 1, [0])])
def test_greedy_time_sample(spark, t, n, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "g int, tpos bigint, t_us bigint")
    got = windows.even_time_sample(df, ["g"], n, order=["tpos"]).collect()
    assert sorted(r["tpos"] for r in got) == want


def test_greedy_same_for_large_groups(spark):
    import random

    rng = random.Random(1)
    rows = [(g, i, rng.randrange(0, 200)) for g in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, tpos bigint, t_us bigint")
    got = {(r["g"], r["tpos"]) for r in windows.even_time_sample(df, ["g"], 7, order=["t_us", "tpos"]).collect()}
    want = set()
    for g in range(4):
        mine = sorted((t, i) for h, i, t in rows if h == g)
        lo, hi = mine[0][0], mine[-1][0]
        want |= {(g, mine[k][1]) for k in windows._greedy([t for t, _ in mine], [lo + i * (hi - lo) / 6.0 for i in range(7)])}
    assert got == want and len(got) == 28


def test_contiguous_windows(spark):
    rows = [(1, 1, s) for s in reversed(range(53))] + [(1, 2, s) for s in range(100, 149)]
    got = windows.contiguous_windows(spark.createDataFrame(rows, "community_id bigint, user_id bigint, ingest_seq bigint")).collect()
    assert sorted((r["window_idx"] * 10 + r["wpos"], r["ingest_seq"]) for r in got) == [(i, i) for i in range(50)]
    assert {r["user_id"] for r in got} == {1}
    stats = windows.split_stats(spark.createDataFrame(rows, "community_id bigint, user_id bigint, ingest_seq bigint")).first()
    assert tuple(stats) == (2, 1, 1)


@pytest.mark.parametrize(
    "months,start",
    [
        ({"2024-01": 2, "2024-02": 2, "2024-03": 2, "2024-04": 9}, "2024-01"),
        ({"2024-01": 2, "2024-02": 1, "2024-03": 2, "2024-04": 2, "2024-05": 2}, "2024-03"),
        ({"2023-11": 2, "2023-12": 3, "2024-01": 2}, "2023-11"),
        ({"2024-01": 5, "2024-03": 5, "2024-05": 5}, None),
    ],
)
def test_month_chain(spark, months, start):
    rows = [(7, f"{m.replace('-', '')}{d + 1:02d}1200", None) for m, n in months.items() for d in range(n)]
    df = windows.timed(spark.createDataFrame(rows, "user_id bigint, date string, timestamp string"))
    got = windows.month_chain(df, per_window=2, months=3).select(times.month_text(F.col("month_start")).alias("m")).collect()
    assert [r["m"] for r in got] == ([start] if start else [])


def test_month_with_unreadable_time_breaks_only_its_starts(spark):
    rows = [(7, "20240110", None), (7, "20240111", None), (7, "202401", None)] + [(7, f"2024{m:02d}1{d}", None) for m in (2, 3, 4) for d in (0, 1)]
    df = windows.timed(spark.createDataFrame(rows, "user_id bigint, date string, timestamp string"))
    assert windows.month_chain(df, per_window=2, months=3).select(times.month_text(F.col("month_start"))).first()[0] == "2024-02"


def test_pairs_and_best(spark):
    r = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.08, -0.03, 0.04, -0.07, 0.01])], "user_id bigint, cand int, r_all double")
    got = sorted((x["pair_rule"], x["chosen"], x["rejected"], round(x["margin"], 9)) for x in pairs.preference_pairs(r, ["user_id"]).collect())
    assert got == [("abs_delta", 2, 3, 0.11), ("tau_delta", 0, 1, 0.11), ("tau_delta", 0, 3, 0.15)]
    assert scoring.best_candidate(r, ["user_id"]).first()["best_cand"] == 0
    tie = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "user_id bigint, cand int, r_all double")
    assert scoring.best_candidate(tie, ["user_id"]).first()["best_cand"] == 0


def test_rewards_count_missing_windows_as_zero(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 1, 0.75)], "user_id bigint, cand int, w int, q double")
    r = scoring.rewards(s, ["user_id"]).first()
    assert (r["r_pre"], r["r_cur"], r["r_fut"], r["r_all"]) == (-0.5, 0.25, 0.0, -0.25)


def test_commercial_share(spark):
    assert col(spark, [10, 5, 3, 2, 1], "int", lambda n: numbers.commercial_count(n)) == [4, 2, 1, 1, 0]
    assert col(spark, list(range(10)), "int", lambda i: numbers.candidate_source(i, F.lit(10))) == ["base"] * 6 + ["commercial"] * 4


@pytest.mark.parametrize("n,budget,head,tail,omitted", [(7000, 6000, 3920, 1960, 1120), (4000, 3500, 2253, 1127, 620), (900, 600, 400, 400, 100)])
def test_truncation(spark, n, budget, head, tail, omitted):
    s = "".join(chr(97 + i % 26) for i in range(n))
    (got,) = col(spark, [s], "string", lambda c: texts.truncate_head_tail(c, budget))
    assert got == s[:head] + f"\n\n... [{omitted} characters omitted for context limit] ...\n\n" + s[-tail:]


def test_truncation_short(spark):
    assert col(spark, ["a" * 700], "string", lambda c: texts.truncate_head_tail(c, 600)) == ["a" * 600]
    assert col(spark, ["a" * 6000], "string", lambda c: texts.truncate_head_tail(c, 6000)) == ["a" * 6000]
    assert col(spark, ["a" * 10], "string", lambda c: texts.truncate_head_tail(c, 0)) == ["a" * 10]


def test_budgets_and_rounds(spark):
    for chars, wanted, want in ((9000, 2048, 1032), (300, 128, 128), (20000, 512, 1)):
        assert spark.range(1).select(numbers.completion_budget(F.lit(chars), F.lit(wanted))).first()[0] == want
    error = "This model's maximum context length is 4096 tokens and your request has 2148 input tokens."
    assert col(spark, [error, "nothing"], "string", numbers.allowed_tokens) == [1932, None]
    assert col(spark, [1, 2, 3, 4, 5, 6], "int", lambda w: numbers.effective_rounds(w)) == [0, 0, 1, 2, 2, 2]


def test_token_estimate(spark):
    assert col(spark, ["ab 漢字 c!", "", None], "string", texts.token_estimate) == [5, 0, 0]


def test_lenient_times(spark):
    d = dt.datetime
    cases = [
        ("202403051230", None, d(2024, 3, 5, 12, 30)), ("20240305", None, d(2024, 3, 5)), ("2024030512", None, d(2024, 3, 5)), ("20241345", "2024-03-05 12:30:10", d(2024, 3, 5, 12, 30, 10)),
        (None, "2024/03/05 12:30", d(2024, 3, 5, 12, 30)), (None, "2024-03-05T12:30:00", d(2024, 3, 5)), (None, None, None), ("20240101xx30", None, None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, date string, timestamp string")
    got = [r[0] for r in df.orderBy("i").select(times.action_time(F.col("date"), F.col("timestamp"))).collect()]
    assert got == [c[2] for c in cases]


def test_discrepancies(spark):
    rows = [
        (1, 0, "like", None, None, "post", "hello", None),
        (1, 1, "reply", "yes", 0.25, "reply", "no", "the original"),
        (1, 2, "reply", "yes", 0.5, "reply", "no", "another original"),
        (2, 0, "like", None, None, "like", None, "t"),
    ]
    df = spark.createDataFrame(rows, "user_id bigint, wpos int, pred_type string, pred_content string, semantic_similarity double, action_type string, action_text string, target string")
    got = {r["user_id"]: r["discrepancies"] for r in discrepancies.discrepancy_blocks(df, ["user_id"]).collect()}
    assert got[2] == "No significant discrepancies detected."
    # the two replies with a similarity differ in their first line only, which is dropped for comparison
    assert got[1] == (
        'Scenario [1]: [TEXT_GENERATION] Generate post content\nPredicted action: "(empty)"\nActual action: "hello"\n\n'
        'Scenario [2]: [DECISION_ONLY] Predict action type for post scenario\nContent: "hello"\nPredicted action: like\nActual action: post\n\n'
        'Scenario [3]: [TEXT_GENERATION] Generate reply to: "the original" [Similarity: 0.250]\nPredicted action: "yes"\nActual action: "no"\n'
    )


def test_first_per_key_and_trim(spark):
    df = spark.createDataFrame([(k, s) for k in (1, 2) for s in range(40)], "user_id bigint, ingest_seq bigint")
    got = ranks.first_per_key(df, ["user_id"], [F.col("ingest_seq").desc()], 3).collect()
    assert sorted((r["user_id"], r["rn"], r["ingest_seq"]) for r in got) == [(k, i, 39 - i) for k in (1, 2) for i in range(3)]
    assert [r["ingest_seq"] for r in ranks.trim_tails(df.where("user_id = 1"), "ingest_seq", sides="lower").orderBy("ingest_seq").collect()] == list(range(2, 40))


def test_group_ranks_of_a_large_group(spark):
    rows = [(None if i % 7 == 0 else "a" if i % 3 else "b", (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {r["i"]: (r["rn"], r["n"]) for r in ranks.group_ranks(df, ["g"], [F.col("v"), F.col("i")]).collect()}
    for g in (None, "a", "b"):
        mine = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in mine] == [(k + 1, len(mine)) for k in range(len(mine))]


def test_even_sample_of_equal_times(spark):
    df = spark.createDataFrame([(1, i, 5) for i in range(6)] + [(2, i, 5) for i in range(2)], "g int, tpos bigint, t_us bigint")
    assert sorted((r["g"], r["tpos"]) for r in windows.even_time_sample(df, ["g"], 3, order=["tpos"]).collect()) == [(1, 0), (1, 2), (1, 5)]


def test_cap_orders(spark):
    u = spark.createDataFrame([(i, i % 2, i) for i in range(10)], "user_id bigint, community_id bigint, first_seq bigint")
    a = {r["user_id"] for r in ranks.cap_users(u, per_community=2, max_users=3).collect()}
    b = {r["user_id"] for r in ranks.cap_users(u, per_community=1, max_users=3, cap_order="total_first").collect()}
    assert a == {0, 1, 2} and b == {0, 1}


def test_endpoints():
    assert endpoints("http://a:1/", "http://b:2/v1, http://a:1") == ("http://a:1/v1", "http://b:2/v1")


def test_windows_of_a_skewed_user(spark):
    """A user with a third of all rows gets the same windows as the others would."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).cast("bigint").alias("user_id"), F.lit(1).cast("bigint").alias("community_id"), F.col("id").alias("ingest_seq"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 200), "yyyyMMddHHmm").alias("date"), F.lit(None).cast("string").alias("timestamp"),
    )
    first = windows.contiguous_windows(rows).where("user_id = 1").collect()
    assert sorted((r["window_idx"] * 10 + r["wpos"], r["ingest_seq"]) for r in first) == [(i, 3 * i) for i in range(50)]
    got = windows.month_chain_windows(rows, per_window=5, months=3).where("user_id = 1").collect()
    assert {(r["window_idx"], r["wpos"]) for r in got} == {(w, p) for w in range(3) for p in range(5)}
    for w in range(3):
        at = [r["ingest_seq"] for r in sorted(got, key=lambda r: (r["window_idx"], r["wpos"])) if r["window_idx"] == w]
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        # evenly in time: all gaps alike but for the rounding to whole rows
        assert max(gaps) - min(gaps) <= 6
