from pyspark.sql import functions as F

from strandweave.functions import texts
from strandweave.operators import pairs, reports, windows
from strandweave.sources import jdbc, sinks


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_keys(spark):
    assert one(spark, texts.cache_key(F.lit(7), F.lit(3))) == "3:7" and one(spark, texts.cache_key(F.lit(7), F.lit(None))) == "7"
    assert one(spark, texts.store_key(F.lit(" a/b:c\\d "), F.lit(9))) == "uid_a_b_c_d__cid_9"
    assert one(spark, texts.store_key(F.lit(""), F.lit("x" * 100))) == "uid_unknown__cid_" + "x" * 80
    assert one(spark, texts.user_key(F.lit(7), F.lit(3))) == "7\t3"


def test_prompts(spark):
    acts = F.array(F.struct(F.lit("2024-01-01 10:00").alias("timestamp"), F.lit("post").alias("action_type"), F.lit("hi").alias("action_text"), F.lit(None).cast("string").alias("target")))
    line = '[2024-01-01 10:00] User posted: "hi"'
    assert one(spark, texts.observed_suffix(acts, F.lit("W0"))) == f"### Recent behaviors (observed window W0)\n{line}"
    assert one(spark, texts.with_suffix(F.lit(" p "), F.lit("\n"))) == "p"
    assert one(spark, texts.history_block(F.slice(acts, 1, 0))) == "(No recent actions in this window.)"
    assert "(1 records)" in one(spark, texts.persona_prompt(acts)) and line in one(spark, texts.persona_prompt(acts))
    system, user = one(spark, texts.refinement_messages(F.lit("old"), F.lit("diff")))
    assert (system["role"], user["role"]) == ("system", "user") and user["content"].startswith("Old persona:\nold\n\nObserved")
    assert one(spark, texts.fill("a {x} b {y} {x}", x=F.lit("1"), y=F.lit("{x}"))) == "a 1 b {x} 1"


def test_time_order(spark):
    rows = [(1, None, "unknown"), (2, "20240102", None), (3, "202401011200", None), (4, None, "2024/01/01 11:00")]
    df = windows.timed(spark.createDataFrame(rows, "ingest_seq int, date string, timestamp string"))
    assert [r["ingest_seq"] for r in df.orderBy(*windows.time_order()).collect()] == [4, 3, 2, 1]


def test_pair_distribution_and_first_step(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "user_id bigint, round_idx int")
    got = {r["user_id"]: (r["num_pairs"], r["round_pair_distribution"]) for r in pairs.pair_distribution(df).collect()}
    assert got == {1: (3, {"round_1": 2, "round_2": 1}), 2: (1, {"round_1": 1})}
    steps = spark.createDataFrame([([(0, "W1"), (1, "W2"), (1, "W9")],), ([],)], "steps array<struct<step_index:int,target_window:string>>")
    assert [r["label"] for r in reports.first_step(steps, "steps", 1).collect()] == ["W2", None]


def test_details_and_pairs(spark, tmp_path):
    rounds = spark.createDataFrame([(1, 5, 1, None, True), (1, 5, 2, None, False), (2, 5, 1, "boom", None)], "user_id bigint, community_id bigint, round_idx int, error string, improved boolean")
    found = spark.createDataFrame([(1, 0, 1, None), (1, 2, 3, 2)], "user_id bigint, chosen int, rejected int, round_idx int")
    sinks.write_details_and_pairs(rounds, found, str(tmp_path))
    got = spark.read.json(str(tmp_path / "pairs")).orderBy("chosen").collect()
    assert [(r["user_id"], r["community_id"], r["round_idx"], r["round_tag"]) for r in got] == [(1, 5, 1, "round_1"), (1, 5, 2, "round_2")]
    details = {r["user_id"]: r for r in spark.read.json(str(tmp_path / "details")).collect()}
    assert (details[1]["num_pairs"], len(details[1]["rounds"])) == (2, 2) and (details[2]["num_pairs"], details[2]["error"]) == (0, "boom")


def test_jdbc_round_trip(spark):
    """Against the embedded database that comes with Spark."""
    options = {"url": "jdbc:derby:memory:strandweave;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(u, "reply" if u % 2 else "post", u * 10, "t" if u % 3 else "", "o", "202403051230") for u in range(20)], "user_id bigint, action_type string, post_id bigint, action_text string, original_text string, date string")
    jdbc.append_rows(rows, "acts", createTableColumnTypes="action_type VARCHAR(20), action_text VARCHAR(500), original_text VARCHAR(500), date VARCHAR(14)", **options)
    back = jdbc.read_table(spark, "acts", partition_by='"user_id"', bounds=(0, 20), partitions=4, **options)
    got = {r["user_id"]: (r["target"], r["timestamp"]) for r in jdbc.normalise_rows(back).collect()}
    assert len(got) == 20 and got[1] == ("o", "2024-03-05 12:30") and got[2] == ("t", "2024-03-05 12:30") and got[6] == ("o", "2024-03-05 12:30")
    stats = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "user_id bigint, community_id int")
    mine = jdbc.user_actions(back, stats, 9, spark.createDataFrame([(1,), (3,)], "user_id bigint"))
    assert [r["user_id"] for r in mine.collect()] == [1]
