"""Queries that run whole jobs with the stand-in models, or go through files and stores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import windows
from ..session import ensure_checkpoint_dir
from ..sources import jsonl, schemas, sinks, stores, table
from . import pipelines, twins
from .models import Models, StubClient
from .reference import _W, _actions, _samples_sql, _windows, query
from .text_queries import _HUNDRED

FAILING = 1  # of 256 calls fail in the queries about failures


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}/{name}"


def _failing() -> Models:
    bad = StubClient(failing=FAILING)
    return Models(base=bad, commercial=bad, action=bad)


def _nested(spark: SparkSession, d: str, number: int = C.NUM_WINDOWS) -> DataFrame:
    return windows.nest(windows.contiguous_windows(_actions(spark, d), number=number))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c in cols})


STEPS = C.NUM_WINDOWS_CHAIN - 1


@query(twins.chain_rows(STEPS))
def r_chain_evaluation(spark, d):
    """All methods and steps."""
    return _rounded(pipelines.evaluate_chain(_nested(spark, d, C.NUM_WINDOWS_CHAIN), pipelines.METHODS, Models()).rows, "f", "l", "q")


@query(twins.chain_rows(STEPS, FAILING))
def r_chain_failures(spark, d):
    """All methods and steps while some calls fail: error rows with null scores."""
    return _rounded(pipelines.evaluate_chain(_nested(spark, d, C.NUM_WINDOWS_CHAIN), pipelines.METHODS, _failing()).rows, "f", "l", "q")


@query(twins.chain_personas(STEPS))
def r_chain_personas(spark, d):
    """The personas that each method had before every step."""
    return pipelines.evaluate_chain(_nested(spark, d, C.NUM_WINDOWS_CHAIN), pipelines.METHODS, Models()).personas


@query(twins.chain_three(STEPS))
def r_chain_three_windows(spark, d):
    """The last persona before and after its update in the last three windows."""
    got = pipelines.evaluate_chain(_nested(spark, d, C.NUM_WINDOWS_CHAIN), pipelines.METHODS, Models(), three_windows=True).three
    return _rounded(got.drop("error"), "f", "l", "q")


_EVERY = tuple(v[0] for v in pipelines.VARIANTS)
_KEEP = ["user_id", "profile_variant", "persona_backend", "error", "slice_eval_mode"]


def _slice(spark, d, mode: str, models: Models):
    got = pipelines.evaluate_slice(_nested(spark, d), _EVERY, models, mode=mode)
    known = [c for c in got.columns if c[0] in "PW" and c[-2:] in ("_F", "_L", "_Q")]
    return _rounded(got, *known).select(*_KEEP, *known)


@query(twins.slice_rows("w1_w2"))
def r_slice_evaluation(spark, d):
    """All variants: the persona of W0 on W1, refined, on W2."""
    return _slice(spark, d, "w1_w2", Models())


@query(twins.slice_rows("w2_w3"))
def r_slice_two_refinements(spark, d):
    return _slice(spark, d, "w2_w3", Models())


@query(twins.slice_rows("w0_w1_w2_p0p1"))
def r_slice_both_personas(spark, d):
    return _slice(spark, d, "w0_w1_w2_p0p1", Models())


@query(twins.slice_rows("w1_w2", FAILING))
def r_slice_failures(spark, d):
    return _slice(spark, d, "w1_w2", _failing())


@query(f"WITH {twins.pair_rounds()} SELECT * REPLACE (round(margin, 10) AS margin, round(chosen_r_all, 10) AS chosen_r_all, round(rejected_r_all, 10) AS rejected_r_all) FROM found")
def r_pair_rounds(spark, d):
    """Two rolling rounds of pair mining with ten candidates."""
    found, _ = pipelines.mine_pairs(_nested(spark, d), Models())
    cols = ["user_id", "round_idx", "chosen", "rejected", "margin", "pair_rule", "chosen_source", "rejected_source", "baseline_source", "chosen_profile", "rejected_profile", "baseline_profile", "discrepancies", "chosen_r_all", "rejected_r_all"]
    return _rounded(found.select(*cols), "margin", "chosen_r_all", "rejected_r_all")


@query(f"WITH {twins.pair_rounds()} SELECT * FROM log")
def r_pair_log(spark, d):
    """One row per user and round of pair mining."""
    _, log = pipelines.mine_pairs(_nested(spark, d), Models())
    return _rounded(log.select("user_id", "round_idx", "improved", "best_cand", "best_r_all", "n_pairs", "skip_reason"), "best_r_all")


_P0 = twins.answer(twins.digest("'commercial'", twins.lit(C.SYSTEM_PROFILE), twins.persona_prompt(str(C.WINDOW_SIZE), "shown")))


@query(f"WITH {twins.windows(C.NUM_WINDOWS)} SELECT user_id, {_P0} AS profile FROM win WHERE window_idx = 0")
def r_shared_personas(spark, d):
    """First personas made once and stored; the second run takes all of them from the store, with a model that always fails."""
    path, nested = _scratch(spark, "p0"), _nested(spark, d)
    pipelines.shared_personas(nested, Models(), path)
    return pipelines.shared_personas(nested, Models(commercial=StubClient(failing=256)), path).where("error is null").select("user_id", "profile")


_MADE = twins.answer(twins.digest("'persona'", twins.lit(C.SYSTEM_PROFILE), twins.fill(C.FREE_FORM, action_count="CAST(n AS VARCHAR)", behavior_data="said")))


@query(f"""WITH {_HUNDRED}, u AS (SELECT user_id, community, coalesce(nullif(c.profile_text, ''), {_MADE}) AS profile FROM ll LEFT JOIN user_profile_cache c USING (user_id) WHERE c.user_id IS NULL OR c.community_id = community)
           SELECT user_id, CAST(community AS BIGINT) AS community, profile FROM u""")
def r_generated_personas(spark, d):
    """Personas of all users: those of the cache, and new ones for the rest, which go into it."""
    path = _scratch(spark, "cache")
    have = table(spark, d, "user_profile_cache")
    stores.insert_if_absent(have, path, ["community_id", "user_id"], schemas.PERSONA_CACHE)
    return pipelines.generate_personas(_actions(spark, d), table(spark, d, "user_stats"), path, Models())


@query("""SELECT user_id, community_id, list(ingest_seq ORDER BY ingest_seq) AS seqs, list(action_text ORDER BY ingest_seq) AS said FROM actions WHERE community_id IS NOT NULL GROUP BY ALL""")
def r_json_round_trip(spark, d):
    """Users as JSON lines in folders by split and files, read back by a glob, in their long form, in order."""
    fields = ["action_type", "action_text", "original_text", "target", "date", "timestamp"]
    act = F.struct("ingest_seq", F.struct(F.concat(F.lit("n"), F.col("ingest_seq").cast("string")).alias("action_type"), *fields[1:]).alias("a"))
    users = _actions(spark, d).where("community_id is not null").groupBy("user_id", "community_id").agg(F.transform(F.array_sort(F.collect_list(act)), lambda x: x["a"]).alias("actions"))
    path = _scratch(spark, "raw")
    sinks.write_json(users, jsonl.split_path(path, "train"))
    long = jsonl.long_actions(jsonl.read_users(spark, jsonl.input_list([jsonl.split_path(path, "train")]), "part-*.json"))
    # the numbers of the reader keep the order of a user's record
    back = long.groupBy("user_id", "community_id").agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "action_type", "action_text"))).alias("a"))
    return back.select("user_id", "community_id", F.transform("a", lambda x: F.substring(x["action_type"], 2, 20).cast("bigint")).alias("seqs"), F.transform("a", lambda x: x["action_text"]).alias("said"))


@query(f"WITH {_W} SELECT user_id, window_idx, list(ingest_seq ORDER BY wpos) AS seqs FROM w GROUP BY ALL")
def r_windowed_files(spark, d):
    """Windowed users written by source file and read back in their long form."""
    path = _scratch(spark, "windowed")
    nested = windows.nest(_windows(spark, d).withColumn("action_type", F.concat(F.lit("n"), F.col("ingest_seq").cast("string"))))
    sinks.write_json(windows.window_map(nested).withColumn("source_file", F.concat(F.lit("community_"), F.coalesce(F.col("community_id").cast("string"), F.lit("none")))), path, by=["source_file"])
    back = windows.unmap(jsonl.read_windowed(spark, path))
    return back.select("user_id", "window_idx", F.transform("actions", lambda a: F.substring(a["action_type"], 2, 20).cast("bigint")).alias("seqs"))


@query("""WITH f AS (SELECT * FROM scores WHERE window_idx < 2), o AS (SELECT user_id, method, bool_or(q IS NOT NULL) AS done FROM f GROUP BY ALL)
          SELECT s.user_id, s.method, count(*) AS n, round(avg(s.q), 10) AS q FROM scores s LEFT JOIN o USING (user_id, method) WHERE s.window_idx < 2 OR NOT coalesce(o.done, false) GROUP BY ALL""")
def r_resumed_rows(spark, d):
    """Result rows by method; a second run adds the rows of users and methods that have none without an error."""
    path, keys = _scratch(spark, "rows"), ["user_id", "method"]
    rows = table(spark, d, "scores").withColumn("error", F.when(F.col("q").isNull(), F.lit("no score")))
    first = rows.where("window_idx < 2")
    sinks.write_rows(first, path)
    done = stores.completed(spark.read.parquet(path), keys)
    sinks.write_rows(stores.open_work(rows.where("window_idx >= 2"), done, keys), path, resume=True)
    return spark.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 10).alias("q"))


@query("""SELECT 'inserted' AS what, count(*) AS n FROM user_profile_cache WHERE user_id % 2 = 0 UNION ALL SELECT 'inserted again', count(*) FILTER (user_id % 2 <> 0) FROM user_profile_cache
          UNION ALL SELECT 'skipped', count(*) FILTER (user_id % 2 = 0) FROM user_profile_cache UNION ALL SELECT 'rows', count(*) FROM user_profile_cache UNION ALL SELECT 'changed', count(*) FILTER (user_id % 3 = 0) FROM user_profile_cache""")
def r_cache_table(spark, d):
    """Insert what is absent, twice, then put new personas over some."""
    path, keys, cache = _scratch(spark, "cache"), ["community_id", "user_id"], table(spark, d, "user_profile_cache")
    inserted, _ = stores.insert_if_absent(cache.where("user_id % 2 = 0"), path, keys, schemas.PERSONA_CACHE)
    again, skipped = stores.insert_if_absent(cache, path, keys, schemas.PERSONA_CACHE)
    stores.upsert_latest(cache.where("user_id % 3 = 0").withColumn("profile_text", F.lit("new")), path, keys, schemas.PERSONA_CACHE)
    kept = stores.read_or_empty(spark, path, schemas.PERSONA_CACHE)
    counts = [("inserted", inserted), ("inserted again", again), ("skipped", skipped)]
    told = spark.createDataFrame(counts, "what string, n bigint")
    return told.unionByName(kept.agg(F.lit("rows").alias("what"), F.count(F.lit(1)).alias("n"))).unionByName(kept.agg(F.lit("changed").alias("what"), F.count_if(F.col("profile_text") == "new").alias("n")))


@query(f'WITH {_samples_sql()} SELECT user_id, community, "input", "output" FROM t')
def r_sample_files(spark, d):
    """Instruction samples as JSON lines by community, read back as one set."""
    path = _scratch(spark, "sft")
    pipelines.sft_files(spark, _actions(spark, d), table(spark, d, "user_stats"), table(spark, d, "user_profile_cache"), path)
    back = spark.read.schema(f"{schemas.SAMPLE}, community bigint").json(path)
    return back.select("user_id", "community", "input", "output")

