import json

import pytest
from pyspark.sql import functions as F

from strandweave.operators import samples, windows
from strandweave.plans import pipelines
from strandweave.plans.models import CallError, HttpClient, Models, StubClient
from strandweave.sources import jsonl, schemas, sinks, stores, table


def _raw(tmp_path, users=3, n=12):
    f = tmp_path / "community_1.jsonl"
    with f.open("w") as out:
        for u in range(users):
            acts = [{"action_type": "post", "action_text": f"é {i}", "date": f"202401{i + 1:02d}1200"} for i in range(n if u else 3)]
            out.write(json.dumps({"community_id": 1, "user_id": u, "actions": acts}, ensure_ascii=False) + "\n\n{broken\n")
    return str(f)


def test_prepare_windows(spark, tmp_path):
    out = str(tmp_path / "out")
    stats = pipelines.prepare_windows(spark, _raw(tmp_path), out, size=3, number=4).collect()
    assert [tuple(r) for r in stats] == [("community_1.jsonl", 3, 2, 1)]
    back = jsonl.read_windowed(spark, out)
    long = windows.unmap(back)
    assert long.count() == 8 and {r["window_idx"] for r in long.collect()} == {0, 1, 2, 3}
    text = [r["t"] for r in long.where("user_id = 1").orderBy("window_idx").select(F.transform("actions", lambda a: a["action_text"]).alias("t")).collect()]
    assert sum(text, []) == [f"é {i}" for i in range(12)]


def test_monthly_windows_of_files(spark, tmp_path):
    users = jsonl.read_users(spark, _raw(tmp_path))
    got = pipelines.windowed_records(users, size=4, mode="monthly_chain", months=1).collect()
    assert {r["user_id"] for r in got} == {1, 2} and all(r["split_mode"] == "monthly_chain" and '"2024-01"' in r["split_meta"] for r in got)


def test_stores(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "user_id bigint, community_id bigint, text string"
    new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 1, "b")], schema)
    assert stores.insert_if_absent(new, path, ["user_id", "community_id"], schema) == (2, 0)
    assert stores.insert_if_absent(new, path, ["user_id", "community_id"], schema) == (0, 2)
    stores.upsert_latest(spark.createDataFrame([(2, 1, "c")], schema), path, ["user_id", "community_id"], schema)
    assert {(r["user_id"], r["text"]) for r in stores.read_or_empty(spark, path, schema).collect()} == {(1, "a"), (2, "c")}
    both = stores.merge_caches(spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string"), ["k"], "v")
    assert {tuple(r) for r in both.collect()} == {(1, "x"), (2, "z")}


def test_resume_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, "m", None), (2, "m", "boom")], "user_id bigint, method string, error string")
    sinks.write_rows(rows, path)
    done = stores.completed(spark.read.parquet(path), ["user_id", "method"])
    todo = stores.open_work(rows.select("user_id", "method"), done, ["user_id", "method"])
    assert [r["user_id"] for r in todo.collect()] == [2]
    assert jsonl.output_stem("/a/community_1.jsonl", "chain") == "community_1_chain" == jsonl.output_stem("community_1_chain.jsonl", "chain")
    assert jsonl.input_list(["b", "a"], ["c", "a"]) == ["b", "a", "c"]


def test_samples_have_history_and_personas(spark, data):
    got = samples.sft_samples(table(spark, data, "actions"), table(spark, data, "user_stats"), table(spark, data, "user_profile_cache"))
    counts = samples.sample_counts(got).first()
    assert counts["samples"] == counts["content"] + counts["decision"] > 0
    row = got.where("sample_kind = 'decision'").first()
    assert row["input"].count("\n[") + row["input"].count("sequence: [") >= 10 and "Available actions" in row["input"]


def test_rounds_chain_and_slice_with_stand_ins(spark, data):
    nested = windows.nest(windows.contiguous_windows(table(spark, data, "actions"), size=3, number=4))
    found, log = pipelines.mine_pairs(nested, Models(), n=3)
    rows = found.collect()
    assert len({(r["user_id"], r["round_idx"], r["chosen"], r["rejected"]) for r in rows}) == len(rows)
    assert all(r["margin"] > 0 and r["chosen_profile"] and r["discrepancies"] for r in rows)
    assert log.where("round_idx = 1").count() == nested.select("user_id").distinct().count()
    chain = pipelines.evaluate_chain(nested, pipelines.METHODS[0], Models(), steps=2).rows.collect()
    assert all(0 <= r["f"] <= 1 and abs(r["q"] - (0.6 * r["f"] + 0.4 * r["l"])) < 1e-9 for r in chain)
    short = pipelines.evaluate_slice(nested.where("window_idx < 2"), "tuned", Models()).collect()
    assert {r["error"] for r in short} == {"need_W0_W1_W2"}


def test_failed_calls_are_error_rows(spark, data):
    nested = windows.nest(windows.contiguous_windows(table(spark, data, "actions"), size=3, number=4))
    users = nested.select("user_id").distinct().count()
    methods = (pipelines.METHODS[0], pipelines.METHODS[3], pipelines.METHODS[4])
    # every call fails, or some do
    for failing in (256, 6):
        bad = StubClient(failing=failing)
        models = Models(base=bad, commercial=bad, action=bad)
        chain = pipelines.evaluate_chain(nested, methods, models, steps=3, three_windows=True).rows.collect()
        assert len(chain) == users * len(methods) * 3 == len({(r["user_id"], r["method"], r["step_index"]) for r in chain})
        assert all((r["error"] is None) == (r["q"] is not None) == (r["f"] is not None) for r in chain)
        by = {}
        for r in chain:
            by.setdefault((r["user_id"], r["method"]), set()).add(r["error"])
        assert all(len(e) == 1 for e in by.values()) and any(e != {None} for e in by.values())
        rows = pipelines.evaluate_slice(nested, ("tuned", "commercial"), models).collect()
        assert len(rows) == 2 * users and all((r["error"] is None) == (r["W1_Q"] is not None) == (r["W2_Q"] is not None) for r in rows)
        found, log = pipelines.mine_pairs(nested, models, n=3)
        failed = {r["user_id"] for r in log.where("error is not null").collect()}
        assert failed and not failed & {r["user_id"] for r in found.collect()} and {r["user_id"] for r in stores.completed(log, ["user_id"]).collect()}.isdisjoint(failed)
        assert log.where("round_idx = 1").select("user_id").distinct().count() == users
        if failing == 256:
            assert len(failed) == users and all(r["error"] for r in chain) and all(r["error"] for r in rows)


def test_missing_windows_are_error_rows(spark, data):
    nested = windows.nest(windows.contiguous_windows(table(spark, data, "actions"), size=3, number=3))
    some = nested.where("window_idx < 2 OR user_id % 2 = 0")
    rows = pipelines.evaluate_chain(some, pipelines.METHODS[0], Models(), steps=2).rows.collect()
    assert len(rows) == 2 * nested.select("user_id").distinct().count()
    assert all(r["error"] == (None if r["step_index"] == 0 or r["user_id"] % 2 == 0 else "no_window_W2") for r in rows)


def test_shared_personas_are_stored(spark, data, tmp_path):
    nested = windows.nest(windows.contiguous_windows(table(spark, data, "actions"), size=3, number=4))
    store = str(tmp_path / "p0")
    bad = pipelines.shared_personas(nested, Models(commercial=StubClient(failing=256)), store).collect()
    assert all(r["error"] for r in bad) and stores.read_or_empty(spark, store, schemas.PERSONA_STORE).count() == 0
    first = {tuple(r) for r in pipelines.shared_personas(nested, Models(), store).collect()}
    again = {tuple(r) for r in pipelines.shared_personas(nested, Models(commercial=StubClient(failing=256)), store).collect()}
    assert first == again and all(r[2] is None for r in first)


def test_table_versions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string"
    frame = lambda *r: spark.createDataFrame(r, schema)
    stores.upsert_latest(frame((1, "a")), path, ["k"], schema)
    old = stores.read_or_empty(spark, path, schema)
    stores.upsert_latest(frame((1, "b"), (2, "c")), path, ["k"], schema)
    # who reads the version before still finds it
    assert [tuple(r) for r in old.collect()] == [(1, "a")]
    assert {tuple(r) for r in stores.read_or_empty(spark, path, schema).collect()} == {(1, "b"), (2, "c")}
    with stores.locked(spark, path), pytest.raises(TimeoutError), stores.locked(spark, path, wait_s=0.1):
        pass


def test_client_retries(monkeypatch):
    said = []

    def answers(*got):
        left = list(got)

        def post(self, base, body):
            said.append((base, body["max_tokens"]))
            g = left.pop(0)
            if isinstance(g, Exception):
                raise g
            return g

        monkeypatch.setattr(HttpClient, "_post", post)
        said.clear()

    client = HttpClient(("a", "b"), pause_s=0.0)
    answers(CallError("maximum context length is 4096 tokens and your request has 4000 input tokens", 400), "ok")
    assert client.complete("m", "s", "p", 512, 0.0) == "ok" and said == [("a", 512), ("b", 80)]
    answers(CallError("busy", 503), CallError("", 0), "ok")
    assert client.complete("m", "s", "p", 5, 0.0) == "ok" and len(said) == 3
    answers(CallError("no such model", 404), "never")
    with pytest.raises(CallError):
        client.complete("m", "s", "p", 5, 0.0)
    assert len(said) == 1
    with pytest.raises(ValueError):
        HttpClient(())


def test_record_numbers_are_unique(spark):
    from strandweave.sources.schemas import RAW_USER

    act = ("post", "x", None, None, None, None)
    users = spark.createDataFrame([(1, u, [act] * (u % 3)) for u in range(2000)], RAW_USER).repartition(600).withColumn("source_file", F.lit("f"))
    users.write.mode("overwrite").parquet(f"/tmp/strandweave-test-{spark.sparkContext.applicationId}")
    users = spark.read.parquet(f"/tmp/strandweave-test-{spark.sparkContext.applicationId}")
    got = jsonl.long_actions(users)
    n = sum(u % 3 for u in range(2000))
    assert got.count() == n == got.select("ingest_seq").distinct().count()
    two = [r["ingest_seq"] for r in got.where("user_id = 2").orderBy("pos").collect()]
    assert two[1] == two[0] + 1


def test_schemas_parse(spark):
    for s in (schemas.RAW_USER, schemas.WINDOWED_USER, schemas.PREDICTIONS, schemas.SCORES, schemas.PERSONA_CACHE, schemas.PERSONA_STORE, schemas.SAMPLE, schemas.ROW_ACTIONS):
        spark.createDataFrame([], s)


def test_personas_are_generated_once(spark, data, tmp_path):
    args = (table(spark, data, "actions"), table(spark, data, "user_stats"), str(tmp_path / "cache"), Models())
    first = {(r["user_id"], r["profile"]) for r in pipelines.generate_personas(*args).collect()}
    n = stores.read_or_empty(spark, str(tmp_path / "cache"), schemas.PERSONA_CACHE).count()
    again = {(r["user_id"], r["profile"]) for r in pipelines.generate_personas(*args).collect()}
    assert first == again and n == len(first) == stores.read_or_empty(spark, str(tmp_path / "cache"), schemas.PERSONA_CACHE).count()


def test_shared_persona_serves_variants(spark, data):
    nested = windows.nest(windows.contiguous_windows(table(spark, data, "actions"), size=3, number=4))
    p0 = nested.select("user_id").distinct().withColumn("profile", F.lit("likes boats"))
    a, b = (pipelines.evaluate_slice(nested, v, Models(), shared_p0=p0).select("user_id", "W1_Q").collect() for v in ("tuned", "incremental_persona"))
    assert sorted(a) == sorted(b) and a


def test_stored_personas(spark):
    users = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "user_id bigint, community_id bigint")
    store = spark.createDataFrame([(1, 1, "new"), (2, 1, "")], "user_id bigint, community_id bigint, p0_text string")
    old = spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], "user_id bigint, community_id bigint, p0_text string")
    assert {r["user_id"]: r["p0_text"] for r in stores.stored_personas(users, store, old).collect()} == {1: "new", 2: "old", 3: None}


def test_streaming_windows_equal_batch(spark, data, tmp_path):
    from strandweave.streaming.count_windows import streaming_windows

    rows = table(spark, data, "actions").select("user_id", "ingest_seq", "community_id")
    src = str(tmp_path / "in")
    for lo, hi in ((0, 400), (400, 800), (800, 10**9)):
        rows.where((F.col("ingest_seq") >= lo) & (F.col("ingest_seq") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming_windows(stream, size=5, number=3).writeStream.format("memory").queryName("sw").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user_id"], r["ingest_seq"], r["window_idx"], r["wpos"]) for r in spark.sql("SELECT * FROM sw").collect()}
    batch = {(r["user_id"], r["ingest_seq"], r["window_idx"], r["wpos"]) for r in windows.contiguous_windows(rows, size=5, number=3).collect()}
    assert batch <= got


def test_mean_pool():
    import numpy as np

    from strandweave.plans.models import mean_pool

    v = mean_pool(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert np.allclose(v, [[0.6, 0.8]])


def test_streaming_windows_of_many_frames(spark, tmp_path):
    """A key whose batch spans several Arrow frames is numbered in the order of the whole batch."""
    from strandweave.streaming.count_windows import streaming_windows

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        src = str(tmp_path / "in")
        spark.createDataFrame([(1, s) for s in reversed(range(100))], "user_id bigint, ingest_seq bigint").coalesce(1).write.parquet(src)
        stream = spark.readStream.schema("user_id bigint, ingest_seq bigint").parquet(src)
        q = streaming_windows(stream, size=5, number=4).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((r["window_idx"] * 5 + r["wpos"], r["ingest_seq"]) for r in spark.sql("SELECT * FROM frames").collect())
        assert got == [(i, i) for i in range(20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
