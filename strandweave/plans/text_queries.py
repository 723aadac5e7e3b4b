"""Queries of texts, keys, budgets and orders over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers, texts, times
from ..operators import pairs, reports, samples, scoring, windows
from ..sources import jdbc, stores, table
from . import twins
from .reference import _CAND, _TS, _actions, _candidate_scores, _windows, query
_WIN = twins.windows(C.NUM_WINDOWS)
_ONE = "ingest_seq"


@query(f"SELECT ingest_seq, {twins.decision_scenario()} AS decision, {twins.content_scenario()} AS content FROM actions")
def r_long_scenarios(spark, d):
    a = F.struct("action_type", "action_text", "target")
    return _actions(spark, d).select(_ONE, texts.decision_scenario(a).alias("decision"), texts.content_scenario(a).alias("content"))


@query(f"WITH {_WIN} SELECT user_id, window_idx, block, observed FROM hist")
def r_history_blocks(spark, d):
    """The history that a window's prompts show (or the fixed sentence), and the block of the window before."""
    from .pipelines import _history

    h = _history(windows.nest(_windows(spark, d)))
    return h.select("user_id", "window_idx", texts.history_block(F.col("history")).alias("block"), "observed")


@query(f"""WITH {_WIN}, p AS (SELECT user_id, window_idx, string_agg(shown, E'\\n') OVER (PARTITION BY user_id ORDER BY window_idx) AS so_far, (window_idx + 1) * {C.WINDOW_SIZE} AS n, shown FROM win)
           SELECT user_id, window_idx, {twins.persona_prompt('n', 'so_far')} AS persona, {twins.refinement_prompt("'old persona'", 'shown')} AS refinement,
             {twins.truncated(f"({twins.lit('(Incremental persona update: no predicted-vs-actual errors.)' + chr(10) + 'Align the persona with these **actual behaviors in ')} || 'W' || window_idx || {twins.lit('**:' + chr(10) * 2)} || shown)", C.PROFILE_CHARS)} AS observed,
             length({twins.strip("('P' || user_id || E'\\n\\n' || shown)")}) AS chars FROM p""")
def r_persona_prompts(spark, d):
    """Persona and refinement prompts after every window, the block of an update without errors, and a persona with its suffix."""
    w = windows.cumulative(windows.nest(_windows(spark, d)))
    shown = texts.history_text(F.col("actions"))
    return w.select(
        "user_id", "window_idx", texts.persona_prompt(F.col("so_far")).alias("persona"), texts.refinement_prompt(F.lit("old persona"), shown).alias("refinement"),
        texts.truncate_head_tail(texts.refine_block(F.col("actions"), F.concat(F.lit("W"), F.col("window_idx").cast("string"))), C.PROFILE_CHARS).alias("observed"),
        F.length(texts.with_suffix(F.concat(F.lit("P"), F.col("user_id").cast("string")), shown)).cast("bigint").alias("chars"),
    )


@query(f"""SELECT user_id, community_id, {twins.lit(C.SYSTEM_REFINEMENT)} AS system, {twins.fill(C.REFINEMENT, old_persona='profile_text', behavior_discrepancies=twins.lit(C.NO_DISCREPANCY))} AS said,
           CAST(length(profile_text) AS INTEGER) AS chars FROM user_profile_cache""")
def r_refinement_messages(spark, d):
    p = table(spark, d, "user_profile_cache")
    m = p.withColumn("m", texts.refinement_messages(F.col("profile_text"), F.lit(C.NO_DISCREPANCY)))
    of = lambda role: F.filter("m", lambda x: x["role"] == role)[0]["content"]
    return m.select("user_id", "community_id", of("system").alias("system"), of("user").alias("said"), F.length("profile_text").alias("chars"))


@query("""SELECT ingest_seq, 'uid_' || coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(feed || '/' || user_id, '[/\\\\:]', '_', 'g'), '^\\s+', ''), '\\s+$', ''), 1, 220), ''), 'unknown')
            || '__cid_' || coalesce(nullif(substring(community_id::VARCHAR, 1, 80), ''), 'unknown') AS store_key, user_id || E'\\t' || community_id AS user_key FROM actions WHERE community_id IS NOT NULL""")
def r_store_keys(spark, d):
    a = _actions(spark, d).where("community_id is not null")
    return a.select(_ONE, texts.store_key(F.concat_ws("/", "feed", F.col("user_id").cast("string")), F.col("community_id")).alias("store_key"), texts.user_key(F.col("user_id"), F.col("community_id")).alias("user_key"))


@query("SELECT ingest_seq, substring(date, 1, 4) || '-' || substring(date, 5, 2) || '-' || substring(date, 7, 2) || ' ' || substring(date, 9, 2) || ':' || substring(date, 11, 2) AS stamp FROM actions")
def r_date_texts(spark, d):
    return _actions(spark, d).select(_ONE, times.date_text(F.col("date")).alias("stamp"))


def _profile_line() -> str:
    kind, cut = "coalesce(action_type, '')", lambda c: f"substring(coalesce({c}, ''), 1, 200)"
    return f"""'[' || coalesce(timestamp, '') || '] ' || CASE WHEN {kind} = 'reply' THEN 'User commented on "' || {twins.first_of(cut('original_text'), cut('target'))} || '": "' || {cut('action_text')} || '"'
        WHEN {kind} = 'post' THEN 'User posted: "' || {twins.first_of(cut('action_text'), cut('target'))} || '"' WHEN {kind} = 'like' THEN 'User liked: "' || {cut('target')} || '"'
        WHEN {kind} = 'repost' THEN 'User reposted: "' || {cut('target')} || '"' ELSE {kind} || ': ' || {cut('target')} END"""


_HUNDRED = f"""z AS (SELECT a.*, s.community_id AS community, row_number() OVER (PARTITION BY a.user_id ORDER BY a.date DESC NULLS LAST, a.ingest_seq DESC) AS k
    FROM actions a JOIN user_stats s ON a.user_id = s.user_id WHERE s.community_id IS NOT NULL QUALIFY k <= {C.SFT_PROFILE_ACTIONS}),
    ll AS (SELECT user_id, community, count(*) AS n, string_agg({_profile_line()}, E'\\n' ORDER BY k DESC) AS said FROM z GROUP BY ALL)"""


@query(f"WITH {_HUNDRED} SELECT user_id, CAST(community AS BIGINT) AS community, CAST(n AS INTEGER) AS n, said FROM ll")
def r_profile_lines(spark, d):
    """The last hundred actions of every user as the lines that a persona is made from."""
    rows = samples.recent_actions(_actions(spark, d), table(spark, d, "user_stats"))
    act = F.struct("apos", "action_type", "action_text", "original_text", "target", "timestamp")
    g = rows.groupBy("user_id", "community").agg(F.array_sort(F.collect_list(act)).alias("a"))
    return g.select("user_id", "community", F.size("a").alias("n"), texts.profile_lines(F.col("a")).alias("said"))


@query(f"""SELECT doc_id, CAST(greatest(1, coalesce(n_chars, 0) // 3) AS INTEGER) AS tokens, CAST(greatest(1, least({C.MAX_TOKENS_PROFILE}, {C.CONTEXT_TOKENS} - greatest(1, coalesce(n_chars, 0) // 3) - {C.COMPLETION_MARGIN})) AS INTEGER) AS room,
           CAST(greatest(1, 4096 - coalesce(n_chars, 0) - 16) AS INTEGER) AS allowed FROM documents""")
def r_budgets(spark, d):
    """Tokens of a prompt and what they leave, and what a context-limit message leaves."""
    n = F.coalesce("n_chars", F.lit(0)).cast("int")
    said = F.concat(F.lit("This model's maximum context length is 4096 tokens and your request has "), n.cast("string"), F.lit(" input tokens (shorten it)."))
    return table(spark, d, "documents").select("doc_id", numbers.prompt_tokens(n).alias("tokens"), numbers.completion_budget(n, F.lit(C.MAX_TOKENS_PROFILE)).alias("room"), numbers.allowed_tokens(said).alias("allowed"))


@query(f"SELECT user_id, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n >= 3 THEN greatest(1, least({C.ROUNDS}, n - 2)) ELSE 0 END AS INTEGER) AS rounds FROM (SELECT user_id, count(*) // {C.WINDOW_SIZE} AS n FROM actions GROUP BY user_id)")
def r_effective_rounds(spark, d):
    n = _actions(spark, d).groupBy("user_id").agg(F.floor(F.count(F.lit(1)) / C.WINDOW_SIZE).cast("int").alias("n"))
    return n.withColumn("rounds", numbers.effective_rounds(F.col("n")))


_PAIRS = f"""p AS (SELECT h.community_id AS user_id, h.cand AS chosen, CAST(1 + h.cand % {C.ROUNDS} AS INTEGER) AS round_idx FROM r h JOIN r l ON h.community_id = l.community_id AND h.r_all > 0 AND l.r_all < 0
    WHERE (h.r_all > {C.TAU_PLUS} AND l.r_all < {C.TAU_MINUS} AND h.r_all - l.r_all > {C.DELTA}) OR h.r_all - l.r_all > {C.ABS_DELTA})"""


def _found(spark, d):
    got = pairs.preference_pairs(scoring.rewards(_candidate_scores(spark, d), ["community_id"]), ["community_id"])
    return got.select(F.col("community_id").alias("user_id"), "chosen", (1 + F.col("chosen") % C.ROUNDS).cast("int").alias("round_idx"))


@query(f"""WITH {_CAND}, {_PAIRS}, g AS (SELECT user_id, round_idx, count(*) AS n FROM p GROUP BY ALL)
           SELECT user_id, CAST(sum(n) AS BIGINT) AS num_pairs, string_agg('round_' || round_idx || '=' || n, ' ' ORDER BY round_idx) AS by_round FROM g GROUP BY user_id""")
def r_pair_distribution(spark, d):
    """Pairs by round (here a community's pairs, in two rounds by the chosen candidate)."""
    got = pairs.pair_distribution(_found(spark, d))
    entries = F.array_sort(F.map_entries("round_pair_distribution"))
    return got.select("user_id", "num_pairs", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("by_round"))


@query(f"""WITH {_CAND}, {_PAIRS}, u AS (SELECT DISTINCT community_id AS user_id FROM scores WHERE community_id IS NOT NULL)
           SELECT (SELECT count(*) FROM u) AS total_users, (SELECT count(*) FROM p) AS total_pairs, (SELECT count(DISTINCT user_id) FROM p) AS users_with_pairs, 12.5::DOUBLE AS elapsed_seconds, 12.5::DOUBLE / (SELECT count(*) FROM u) AS avg_user_elapsed_seconds""")
def r_run_summary(spark, d):
    users = table(spark, d, "scores").where("community_id is not null").select(F.col("community_id").alias("user_id"))
    return reports.run_summary(users, _found(spark, d), 12.5)


@query("""SELECT user_id, method, CASE WHEN count(*) = count(q) AND count(*) = 3 THEN round((sum(q)) / 3, 10) END AS mean FROM (
            SELECT DISTINCT s.user_id, s.method, g.w, (SELECT max(q) FROM scores t WHERE t.user_id = s.user_id AND t.method = s.method AND t.window_idx = g.w) AS q FROM scores s, range(3) g(w)) GROUP BY ALL""")
def r_mean_of_three(spark, d):
    """The mean over three windows, null unless all are known."""
    s = table(spark, d, "scores").groupBy("user_id", "method").agg(*[F.max(F.when(F.col("window_idx") == i, F.col("q"))).alias(f"q{i}") for i in range(3)])
    return s.select("user_id", "method", F.round(numbers.mean_three(F.col("q0"), F.col("q1"), F.col("q2")), 10).alias("mean"))


@query(f"""WITH {_TS} SELECT user_id, list(ingest_seq ORDER BY action_ts ASC NULLS LAST, date ASC NULLS FIRST, timestamp ASC NULLS FIRST, ingest_seq)[:{C.WINDOW_SIZE}] AS first_ten FROM v GROUP BY user_id""")
def r_time_order(spark, d):
    """The first ten actions of every user in time order."""
    from ..operators.ranks import first_per_key

    first = first_per_key(windows.timed(_actions(spark, d).select("user_id", _ONE, "date", "timestamp")), ["user_id"], windows.time_order(), C.WINDOW_SIZE, salt_by=[_ONE])
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", _ONE))), lambda x: x[_ONE]).alias("first_ten"))


@query("""SELECT user_id, method, (SELECT 'W' || (s.window_idx + 1) || ':' || s.persona_id FROM scores s WHERE s.user_id = g.user_id AND s.method = g.method AND s.window_idx = 1 ORDER BY s.persona_id LIMIT 1) AS label
          FROM (SELECT DISTINCT user_id, method FROM scores) g""")
def r_first_steps(spark, d):
    """The label of the first step with index 1 of each user and method."""
    step = F.struct(F.col("window_idx").alias("step_index"), F.col("persona_id").alias("_p"), F.concat(F.lit("W"), (F.col("window_idx") + 1).cast("string"), F.lit(":"), F.col("persona_id").cast("string")).alias("target_window"))
    s = table(spark, d, "scores").groupBy("user_id", "method").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return reports.first_step(s, "steps", 1).select("user_id", "method", "label")


@query("""WITH a AS (SELECT user_id, community_id, profile_text AS v FROM user_profile_cache WHERE user_id % 3 <> 0), b AS (SELECT user_id, community_id, 'doc' AS v FROM user_stats WHERE community_id IS NOT NULL)
          SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.community_id, b.community_id) AS community_id, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.user_id = b.user_id AND a.community_id = b.community_id""")
def r_merged_caches(spark, d):
    first = table(spark, d, "user_profile_cache").where("user_id % 3 <> 0").select("user_id", "community_id", F.col("profile_text").alias("v"))
    second = table(spark, d, "user_stats").where("community_id is not null").select("user_id", "community_id", F.lit("doc").alias("v"))
    return stores.merge_caches(first, second, ["user_id", "community_id"], "v")


@query("""WITH l AS (SELECT user_id, 'old ' || max(sample_size) AS v FROM user_profile_cache GROUP BY user_id)
          SELECT s.user_id, CAST(s.community_id AS BIGINT) AS community, coalesce(nullif(c.profile_text, ''), l.v, 'UserID ' || s.user_id || ', Community ' || s.community_id) AS profile
          FROM user_stats s LEFT JOIN user_profile_cache c ON c.user_id = s.user_id AND c.community_id = s.community_id AND c.user_id % 2 = 0 LEFT JOIN l ON l.user_id = s.user_id""")
def r_legacy_personas(spark, d):
    """Personas by the exact key, else by the older key of the user alone, else a placeholder."""
    users = table(spark, d, "user_stats").select("user_id", F.col("community_id").cast("bigint").alias("community"))
    cache = table(spark, d, "user_profile_cache")
    old = cache.groupBy("user_id").agg(F.concat(F.lit("old "), F.max("sample_size").cast("string")).alias("profile_text"))
    return samples.lookup_personas(users, cache.where("user_id % 2 = 0"), old).select("user_id", "community", "profile")


@query("""SELECT user_id, community_id FROM user_stats s WHERE NOT EXISTS (SELECT 1 FROM user_profile_cache c WHERE c.user_id = s.user_id AND c.community_id = s.community_id AND c.user_id % 2 = 0)
            AND NOT EXISTS (SELECT 1 FROM user_profile_cache c WHERE c.user_id = s.user_id AND c.sample_size > 50)""")
def r_missing_by_both_keys(spark, d):
    """Users who need a persona: in the cache under neither key."""
    cache, users = table(spark, d, "user_profile_cache"), table(spark, d, "user_stats").select("user_id", "community_id")
    left = stores.open_work(users, cache.where("user_id % 2 = 0").select("user_id", "community_id"), ["user_id", "community_id"])
    return stores.open_work(left, cache.where("sample_size > 50").select("user_id"), ["user_id"])


@query(f"""SELECT a.ingest_seq, CASE WHEN action_type = 'reply' THEN coalesce(nullif(substring(coalesce(original_text, ''), 1, {C.TEXT_LONG}), ''), nullif(substring(coalesce(action_text, ''), 1, {C.TEXT_LONG}), ''), 'post_' || a.ingest_seq)
             ELSE coalesce(nullif(substring(coalesce(action_text, ''), 1, {C.TEXT_LONG}), ''), nullif(substring(coalesce(original_text, ''), 1, {C.TEXT_LONG}), ''), 'post_' || a.ingest_seq) END AS target,
             substring(date, 1, 4) || '-' || substring(date, 5, 2) || '-' || substring(date, 7, 2) || ' ' || substring(date, 9, 2) || ':' || substring(date, 11, 2) AS timestamp
           FROM actions a JOIN user_stats s ON a.user_id = s.user_id WHERE s.community_id = 1 AND a.user_id IN (SELECT user_id FROM user_profile_cache)""")
def r_user_actions(spark, d):
    """Rows of the action table as actions, of the users of one community who are on a list (a semi-join)."""
    mine = jdbc.user_actions(_actions(spark, d).withColumn("post_id", F.col(_ONE)), table(spark, d, "user_stats"), 1, table(spark, d, "user_profile_cache"))
    rows = jdbc.normalise_rows(mine.withColumn("user_id", F.col(_ONE)))
    return rows.select(F.col("user_id").alias(_ONE), "target", "timestamp")


@query("SELECT DISTINCT a.user_id FROM actions a JOIN user_stats s ON a.user_id = s.user_id WHERE s.community_id = 2")
def r_community_users(spark, d):
    return jdbc.user_actions(_actions(spark, d), table(spark, d, "user_stats"), 2).select("user_id").distinct()


@query("""WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
          n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT m.label, list(round(m.x / n.n, 4) ORDER BY i) AS pooled FROM m JOIN n USING (label) GROUP BY m.label""")
def r_pooled(spark, d):
    """Mean pooling and unit length, with the vectors of a label as the tokens of a text."""
    import numpy as np
    import pandas as pd

    from .models import mean_pool

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack(pdf["embedding"]).astype(np.float64)[None]
        v = mean_pool(stack, np.ones(stack.shape[:2], int))[0]
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "pooled": [np.round(v, 4).tolist()]})

    # a label of the embeddings has few vectors, as a text has few tokens
    return table(spark, d, "embeddings").select("label", "embedding").groupBy("label").applyInPandas(pool, "label int, pooled array<double>")

