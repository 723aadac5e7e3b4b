"""Queries of the sequence operators over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers, texts, times
from ..operators import discrepancies, pairs, ranks, reports, samples, scoring, windows
from ..sources import stores, table
from . import twins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "actions")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.contiguous_windows(_actions(spark, d))


_W = f"""w AS (
    SELECT *, CAST(rn // {C.WINDOW_SIZE} AS INTEGER) AS window_idx, CAST(rn % {C.WINDOW_SIZE} AS INTEGER) AS wpos FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ingest_seq) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM actions
    ) WHERE n >= {C.WINDOW_SIZE * C.NUM_WINDOWS} AND rn < {C.WINDOW_SIZE * C.NUM_WINDOWS})"""


@query(f"WITH {_W} SELECT user_id, window_idx, wpos, ingest_seq FROM w")
def r_contiguous_windows(spark, d):
    return _windows(spark, d).select("user_id", "window_idx", "wpos", "ingest_seq")


@query(f"""SELECT count(*) AS total_users, count(*) FILTER (n >= {C.WINDOW_SIZE * C.NUM_WINDOWS}) AS kept_users, count(*) FILTER (n < {C.WINDOW_SIZE * C.NUM_WINDOWS}) AS skipped_users
           FROM (SELECT count(*) AS n FROM actions GROUP BY user_id)""")
def r_split_stats(spark, d):
    return windows.split_stats(_actions(spark, d))


_TS = r"""t AS (
    SELECT *, replace(regexp_replace(coalesce(timestamp, ''), '^ +| +$', '', 'g'), '/', '-') AS tt,
           regexp_matches(coalesce(date, ''), '^[0-9]{8}') AS d8, length(date) >= 12 AS dc FROM actions),
u AS (
    SELECT *, d8 AND dc AND NOT regexp_matches(substring(date, 9, 4), '^[0-9]{4}$') AS bad,
        CASE WHEN d8 THEN try_strptime(substring(date, 1, 8) || CASE WHEN dc THEN substring(date, 9, 4) ELSE '0000' END, '%Y%m%d%H%M') END AS t1,
        coalesce(
            CASE WHEN regexp_full_match(tt, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN try_strptime(tt, '%Y-%m-%d %H:%M:%S') END,
            CASE WHEN regexp_full_match(tt, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}') THEN try_strptime(tt, '%Y-%m-%d %H:%M') END,
            CASE WHEN regexp_matches(tt, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_strptime(substring(tt, 1, 10), '%Y-%m-%d') END) AS t2 FROM t),
v AS (
    SELECT *, CASE WHEN NOT bad THEN coalesce(t1, t2) END AS action_ts,
        CASE WHEN regexp_matches(coalesce(date, ''), '^[0-9]{6}')
             THEN CASE WHEN CAST(substring(date, 5, 2) AS INTEGER) BETWEEN 1 AND 12 THEN CAST(substring(date, 1, 4) AS INTEGER) * 12 + CAST(substring(date, 5, 2) AS INTEGER) END
             ELSE CAST(year(t2) * 12 + month(t2) AS INTEGER) END AS month_idx FROM u)"""


@query(f"""WITH {_TS} SELECT ingest_seq, strftime(action_ts, '%Y-%m-%d %H:%M:%S') AS action_ts, month_idx,
           printf('%04d-%02d', (month_idx - 1) // 12, (month_idx - 1) % 12 + 1) AS month FROM v""")
def r_action_times(spark, d):
    df = windows.timed(_actions(spark, d).select("ingest_seq", "date", "timestamp"))
    return df.select("ingest_seq", F.date_format("action_ts", "yyyy-MM-dd HH:mm:ss").alias("action_ts"), "month_idx", F.when(F.col("month_idx").isNotNull(), times.month_text(F.col("month_idx"))).alias("month"))


_HALF = """hs AS (SELECT user_id, month_idx, (min(epoch_us(action_ts)) + max(epoch_us(action_ts))) / 2.0 AS mid FROM v WHERE month_idx IS NOT NULL AND action_ts IS NOT NULL GROUP BY ALL),
        hv AS (SELECT v.*, CASE WHEN epoch_us(action_ts) <= mid THEN 0 ELSE 1 END AS half FROM v JOIN hs USING (user_id, month_idx) WHERE action_ts IS NOT NULL)"""


def _chain_sql(per_window: int, months: int, per_month: int = 1) -> str:
    both = f"AND (user_id, month_idx) IN (SELECT (user_id, month_idx) FROM hv GROUP BY user_id, month_idx HAVING count(*) FILTER (half = 0) >= {per_window} AND count(*) FILTER (half = 1) >= {per_window})" if per_month == 2 else ""
    return f"""{_TS}, {_HALF}, m AS (SELECT user_id, month_idx, count(*) AS n, count(action_ts) AS k FROM v WHERE month_idx IS NOT NULL GROUP BY ALL),
        g AS (SELECT user_id, month_idx, month_idx - row_number() OVER (PARTITION BY user_id ORDER BY month_idx) AS island FROM m WHERE n >= {per_window * per_month} AND n = k {both}),
        e AS (SELECT user_id, month_idx, max(month_idx) OVER (PARTITION BY user_id, island) AS last FROM g),
        c AS (SELECT user_id, CAST(min(month_idx) AS INTEGER) AS month_start FROM e WHERE month_idx + {months} - 1 <= last GROUP BY user_id)"""


@query(f"WITH {_chain_sql(C.WINDOW_SIZE, C.CHAIN_MONTHS)} SELECT * FROM c")
def r_month_chain(spark, d):
    return windows.month_chain(windows.timed(_actions(spark, d)))


@query(f"WITH {_chain_sql(C.WINDOW_SIZE, C.CHAIN_MONTHS, 2)} SELECT * FROM c")
def r_month_chain_halves(spark, d):
    return windows.month_chain(windows.timed(_actions(spark, d)), per_month=2)


@query(f"WITH {_chain_sql(5, 3)} SELECT * FROM c")
def r_month_chain_short(spark, d):
    return windows.month_chain(windows.timed(_actions(spark, d)), per_window=5, months=3)


@query(f"""WITH {_TS}, s AS (SELECT user_id, month_idx, (min(epoch_us(action_ts)) + max(epoch_us(action_ts))) / 2.0 AS mid FROM v WHERE month_idx IS NOT NULL AND action_ts IS NOT NULL GROUP BY ALL)
           SELECT ingest_seq, CASE WHEN epoch_us(action_ts) <= mid THEN 0 ELSE 1 END AS half FROM v JOIN s USING (user_id, month_idx) WHERE action_ts IS NOT NULL""")
def r_half_months(spark, d):
    return windows.half_months(windows.timed(_actions(spark, d))).select("ingest_seq", "half")


def _even_sql(per_window: int, months: int, per_month: int) -> str:
    """Even sampling with the greedy choice unrolled: one step for each point, without the rows chosen before."""
    rows = "hv" if per_month == 2 else "(SELECT *, 0 AS half FROM v)"
    picks = []
    for i in range(per_window):
        used = "".join(f" AND seq NOT IN (SELECT seq FROM k{j})" for j in range(i))
        point = f"lo::DOUBLE + {i}::DOUBLE * (hi - lo)::DOUBLE / {float(max(per_window - 1, 1))}::DOUBLE"
        picks.append(f"k{i} AS MATERIALIZED (SELECT seq FROM o WHERE lo < hi{used} QUALIFY row_number() OVER (PARTITION BY user_id, window_idx ORDER BY abs(t_us::DOUBLE - ({point})), place) = 1)")
    chosen = " UNION ALL ".join(f"SELECT seq FROM k{i}" for i in range(per_window))
    flat = f"SELECT seq FROM o WHERE lo = hi AND place - 1 IN (SELECT round_even(i * (o.m - 1) / {float(max(per_window - 1, 1))}, 0) FROM range({per_window}) r(i))"
    return f"""WITH {_chain_sql(per_window, months, per_month)},
        i AS (SELECT r.user_id, (r.month_idx - c.month_start) * {per_month} + r.half AS window_idx, r.ingest_seq AS seq, epoch_us(r.action_ts) AS t_us, coalesce(r.date, '') AS dt, coalesce(r.timestamp, '') AS st
            FROM {rows} r JOIN c USING (user_id) WHERE r.month_idx >= c.month_start AND r.month_idx < c.month_start + {months}),
        o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, window_idx ORDER BY t_us, dt, st, seq) AS place, count(*) OVER (PARTITION BY user_id, window_idx) AS m,
            min(t_us) OVER (PARTITION BY user_id, window_idx) AS lo, max(t_us) OVER (PARTITION BY user_id, window_idx) AS hi FROM i QUALIFY m >= {per_window}),
        {', '.join(picks)}
        SELECT user_id, CAST(window_idx AS INTEGER) AS window_idx, CAST(row_number() OVER (PARTITION BY user_id, window_idx ORDER BY place) - 1 AS INTEGER) AS wpos, seq AS ingest_seq FROM o WHERE seq IN ({chosen} UNION ALL {flat})"""


@query(_even_sql(C.WINDOW_SIZE, C.CHAIN_MONTHS, 1))
def r_month_chain_windows(spark, d):
    return windows.month_chain_windows(_actions(spark, d)).select("user_id", "window_idx", "wpos", "ingest_seq")


@query(_even_sql(C.WINDOW_SIZE, C.CHAIN_MONTHS, 2))
def r_month_chain_half_windows(spark, d):
    return windows.month_chain_windows(_actions(spark, d), per_month=2).select("user_id", "window_idx", "wpos", "ingest_seq")


@query(_even_sql(5, 3, 1))
def r_month_chain_short_windows(spark, d):
    return windows.month_chain_windows(_actions(spark, d), per_window=5, months=3).select("user_id", "window_idx", "wpos", "ingest_seq")


@query("""WITH u AS (SELECT user_id, CAST(count(*) AS INTEGER) AS m FROM actions GROUP BY user_id HAVING count(*) >= 4)
          SELECT user_id, CAST(round_even(i * (m - 1) / 3.0, 0) AS INTEGER) AS idx FROM u, range(4) AS r(i)""")
def r_even_indexes(spark, d):
    m = _actions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("m"))
    return m.select("user_id", F.explode(windows.even_indexes(F.col("m"), 4)).alias("idx"))


_TARGET = "substring(coalesce(target, ''), 1, 500)"
_BODY = "substring(coalesce(action_text, ''), 1, 500)"
_KIND = "coalesce(action_type, '')"


@query(f"""SELECT ingest_seq, '[' || coalesce(timestamp, '') || '] ' || CASE
             WHEN {_KIND} = 'reply' AND {_TARGET} <> '' THEN 'Reply to original: "' || {_TARGET} || '" | reply text: "' || {_BODY} || '"'
             WHEN {_KIND} = 'reply' THEN 'User commented (context unknown): "' || {_BODY} || '"'
             WHEN {_KIND} = 'post' THEN 'User posted: "' || {_BODY} || '"'
             WHEN {_KIND} = 'like' THEN 'User liked: "' || {_TARGET} || '..."'
             WHEN {_KIND} = 'repost' THEN 'User reposted: "' || {_TARGET} || '..."'
             ELSE 'User performed ' || {_KIND} || ' on: "' || {_TARGET} || '..."' END AS line FROM actions""")
def r_action_lines(spark, d):
    a = F.struct("action_type", "action_text", "target", "timestamp")
    return _actions(spark, d).select("ingest_seq", texts.format_action(a).alias("line"))


_ORIG = "substring(coalesce(original_text, ''), 1, 500)"


@query(f"""SELECT ingest_seq, '[' || coalesce(timestamp, '') || '] ' || CASE
             WHEN {_KIND} = 'reply' THEN 'User commented on "' || CASE WHEN {_ORIG} <> '' THEN {_ORIG} ELSE {_TARGET} END || '": "' || {_BODY} || '"'
             WHEN {_KIND} = 'post' THEN 'User posted: "' || CASE WHEN {_BODY} <> '' THEN {_BODY} ELSE {_TARGET} END || '"'
             WHEN {_KIND} = 'like' THEN 'User liked: "' || {_TARGET} || '..."'
             WHEN {_KIND} = 'repost' THEN 'User reposted: "' || {_TARGET} || '..."'
             ELSE 'User performed ' || {_KIND} || ' on: "' || {_TARGET} || '..."' END AS line FROM actions""")
def r_sample_lines(spark, d):
    a = F.struct("action_type", "action_text", "original_text", "target", "timestamp")
    return _actions(spark, d).select("ingest_seq", texts.sft_line(a).alias("line"))


@query(f"""SELECT ingest_seq, CASE WHEN action_type = 'reply' THEN coalesce(nullif({_ORIG}, ''), nullif({_BODY}, ''), 'post_' || ingest_seq)
             ELSE coalesce(nullif({_BODY}, ''), nullif({_ORIG}, ''), 'post_' || ingest_seq) END AS derived FROM actions""")
def r_targets(spark, d):
    return _actions(spark, d).select("ingest_seq", texts.derive_target(F.col("action_type"), F.col("action_text"), F.col("original_text"), F.col("ingest_seq")).alias("derived"))


@query("""SELECT user_id, window_idx, wpos, persona_id, method, count(*) AS copies, CASE WHEN l LIKE '%post%' THEN 'post' WHEN l LIKE '%reply%' THEN 'reply' WHEN l LIKE '%repost%' THEN 'repost' WHEN l LIKE '%like%' THEN 'like' ELSE 'not interested' END AS label
          FROM (SELECT *, lower(coalesce(pred_type, '')) AS l FROM predictions) GROUP BY ALL""")
def r_labels(spark, d):
    p = table(spark, d, "predictions").withColumn("label", texts.parse_action_type(F.col("pred_type")))
    return p.groupBy("user_id", "window_idx", "wpos", "persona_id", "method", "label").agg(F.count(F.lit(1)).alias("copies"))


@query(r"""SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_]+')), 0) + coalesce(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')), 0)
             + coalesce(len(regexp_extract_all(text, '[^ \t\n\x{0b}\f\rA-Za-z0-9_\x{4e00}-\x{9fff}]')), 0) AS INTEGER) AS tokens FROM documents""")
def r_token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text ELSE substring(text, 1, 920) || E'\\n\\n... [' || (length(text) - 920 - 460) || E' characters omitted for context limit] ...\\n\\n' || right(text, 460) END AS cut
          FROM documents""")
def r_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.truncate_head_tail(F.col("text"), 1500).alias("cut"))


@query("SELECT user_id, community_id, CASE WHEN community_id IS NULL THEN user_id::VARCHAR ELSE community_id || ':' || user_id END AS cache_key FROM user_stats")
def r_cache_keys(spark, d):
    return table(spark, d, "user_stats").select("user_id", "community_id", texts.cache_key(F.col("user_id"), F.col("community_id")).alias("cache_key"))


_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


@query(f"""SELECT ingest_seq, CASE WHEN {_KIND} IN ('post', 'reply', 'repost', 'like') THEN 'Predict action type for ' || {_KIND} || ' scenario' ELSE 'Predict action type' END AS decision,
           CASE WHEN {_KIND} = 'post' THEN 'Generate post content' WHEN {_KIND} = 'reply' THEN 'Generate reply to: "' || coalesce(nullif(substring({_STRIP("coalesce(target, '')")}, 1, 500), ''), '(original post missing)') || '"' ELSE 'Generate content' END AS content FROM actions""")
def r_scenarios(spark, d):
    a = F.struct("action_type", "action_text", "target")
    return _actions(spark, d).select("ingest_seq", texts.decision_scenario_short(a).alias("decision"), texts.content_scenario_short(a).alias("content"))


_STAND_IN = "coalesce(nullif(c.profile_text, ''), 'UserID ' || {u}.user_id || ', Community ' || {u}.community_id)"


@query(f"""WITH {twins.windows(C.NUM_WINDOWS)}, x AS (SELECT w.*, h.block, {twins.strip(f"coalesce({_STAND_IN.format(u='u')}, '') || E'\n\n'")} AS profile
             FROM w JOIN hist h ON h.user_id = w.user_id AND h.window_idx = w.window_idx JOIN (SELECT user_id, window_idx, min(community_id) AS community_id FROM w GROUP BY ALL) u ON u.user_id = w.user_id AND u.window_idx = w.window_idx
             LEFT JOIN user_profile_cache c ON c.user_id = u.user_id AND c.community_id = u.community_id),
           y AS (SELECT user_id, window_idx, wpos, {twins.decision_prompt('profile', 'block')} AS decision, CASE WHEN action_type IN ('post', 'reply') THEN {twins.content_prompt('profile', 'block')} END AS content FROM x)
           SELECT *, CAST(greatest(1, least(128, {C.CONTEXT_TOKENS} - greatest(1, length(decision) // {int(C.CHARS_PER_TOKEN)}) - {C.COMPLETION_MARGIN})) AS INTEGER) AS max_tokens FROM y""")
def r_prompts(spark, d):
    """Decision and content prompts of every windowed action, with the completion budget."""
    rows = windows.fixed_history(windows.nest(_windows(spark, d))).select("user_id", F.col("community_id").alias("community"), "window_idx", "history", F.posexplode("actions").alias("wpos", "a"))
    rows = samples.lookup_personas(rows, table(spark, d, "user_profile_cache"))
    profile = texts.with_suffix(F.col("profile"), F.lit(""))
    out = rows.select("user_id", "window_idx", "wpos", texts.decision_prompt(profile, F.col("history"), F.col("a")).alias("decision"), F.when(F.col("a.action_type").isin("post", "reply"), texts.content_prompt(profile, F.col("history"), F.col("a"))).alias("content"))
    return out.withColumn("max_tokens", numbers.completion_budget(F.length("decision"), F.lit(128)))


@query(f"WITH {_W} SELECT user_id, window_idx, wpos, coalesce(list(ingest_seq) OVER (PARTITION BY user_id ORDER BY window_idx, wpos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS history FROM w")
def r_sliding_history(spark, d):
    return windows.sliding_history(_windows(spark, d)).select("user_id", "window_idx", "wpos", "history")


@query(f"""WITH {_W}, p AS (SELECT user_id, window_idx + 1 AS window_idx, list(ingest_seq ORDER BY wpos) FILTER (wpos >= 5) AS history FROM w GROUP BY ALL)
           SELECT w.user_id, w.window_idx, coalesce(p.history, []) AS history FROM (SELECT DISTINCT user_id, window_idx FROM w) w LEFT JOIN p USING (user_id, window_idx)""")
def r_fixed_history(spark, d):
    return windows.fixed_history(windows.nest(_windows(spark, d))).select("user_id", "window_idx", F.transform("history", lambda a: a["ingest_seq"]).alias("history"))


@query(f"WITH {_W} SELECT DISTINCT user_id, window_idx AS round_idx, window_idx AS pre, window_idx + 1 AS cur, window_idx + 2 AS fut FROM w WHERE window_idx < {C.ROUNDS}")
def r_triplets(spark, d):
    return windows.triplets(windows.nest(_windows(spark, d)))


@query(f"""WITH {_W}, k AS (SELECT user_id, window_idx, list(ingest_seq ORDER BY wpos) AS seqs FROM w GROUP BY ALL)
           SELECT user_id, window_idx, flatten(list(seqs) OVER (PARTITION BY user_id ORDER BY window_idx)) AS so_far FROM k""")
def r_cumulative(spark, d):
    return windows.cumulative(windows.nest(_windows(spark, d))).select("user_id", "window_idx", F.transform("so_far", lambda a: a["ingest_seq"]).alias("so_far"))


@query(f"""WITH {_W} SELECT user_id, community_id, window_idx, list(ingest_seq ORDER BY wpos) AS seqs, list(action_text ORDER BY wpos) AS said, CAST({C.WINDOW_SIZE * C.NUM_WINDOWS} AS INTEGER) AS used_actions
           FROM (SELECT w.* EXCLUDE (community_id), min(community_id) OVER (PARTITION BY user_id) AS community_id FROM w) GROUP BY ALL""")
def r_windowed_records(spark, d):
    """The nested form of windowed files as JSON and back: one row per user, then one per window."""
    m = windows.window_map(windows.nest(_windows(spark, d)))
    text = m.select("user_id", "community_id", "used_actions", F.to_json("windows").alias("j"))
    back = text.withColumn("windows", F.from_json("j", m.schema["windows"].dataType))
    long = windows.unmap(back).join(back.select("user_id", "used_actions"), "user_id")
    return long.select("user_id", "community_id", "window_idx", F.transform("actions", lambda a: a["ingest_seq"]).alias("seqs"), F.transform("actions", lambda a: a["action_text"]).alias("said"), "used_actions")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return scoring.match(table(spark, d, "predictions"), _windows(spark, d))


_PRED = "SELECT DISTINCT * FROM predictions"
_F1 = " + ".join(
    f"{w} * coalesce(2.0 * count(*) FILTER (ok AND p = '{c}' AND a = '{c}') / nullif(2.0 * count(*) FILTER (ok AND p = '{c}' AND a = '{c}') + count(*) FILTER (ok AND p = '{c}' AND a <> '{c}') + count(*) FILTER (ok AND p <> '{c}' AND a = '{c}'), 0), 0)"
    for c, w in C.ACTION_WEIGHTS.items()
)
_LABEL = lambda c: f"CASE WHEN lower({_STRIP(f"coalesce({c}, '')")}) IN ('post', 'reply', 'repost', 'like') THEN lower({_STRIP(f"coalesce({c}, '')")}) WHEN lower({_STRIP(f"coalesce({c}, '')")}) = 're-post' THEN 'repost' ELSE 'not interested' END"
_SCORES = f"""{_W}, x AS (
    SELECT p.user_id, p.method, p.persona_id, p.window_idx, {_LABEL('p.pred_type')} AS p, {_LABEL('w.action_type')} AS a, p.semantic_similarity AS s, p.pred_content AS c, w.action_text AS t
    FROM ({_PRED}) p JOIN w ON p.user_id = w.user_id AND p.window_idx = w.window_idx AND p.wpos = w.wpos),
y AS (SELECT *, p <> 'not interested' AND a <> 'not interested' AS ok FROM x),
z AS (SELECT user_id, method, persona_id, window_idx, count(*) AS n, {_F1} AS f,
        coalesce(avg(s) FILTER (a IN ('post', 'reply') AND coalesce(c, '') <> '' AND coalesce(t, '') <> '' AND NOT isnan(s)), 0) AS l FROM y GROUP BY ALL)"""


@query(f"WITH {_SCORES} SELECT user_id, method, persona_id, window_idx, n, round(f, 10) AS f, round(l, 10) AS l, round({C.ALPHA} * f + (1 - {C.ALPHA}) * l, 10) AS q FROM z")
def r_scores(spark, d):
    s = scoring.score(_matched(spark, d), ["user_id", "method", "persona_id", "window_idx"])
    return s.select("user_id", "method", "persona_id", "window_idx", "n", *[F.round(c, 10).alias(c) for c in ("f", "l", "q")])


@query(f"""WITH {_W}, x AS (SELECT p.user_id, p.method, p.persona_id, p.window_idx, p.wpos, p.pred_type AS pred, p.pred_content AS said, p.semantic_similarity AS sim, w.action_type, w.action_text, w.target
             FROM ({_PRED}) p JOIN w ON p.user_id = w.user_id AND p.window_idx = w.window_idx AND p.wpos = w.wpos), {twins.discrepancies('t', 'x', 'user_id, method, persona_id, window_idx')}
           SELECT * RENAME (block AS discrepancies) FROM t""")
def r_discrepancies(spark, d):
    return discrepancies.discrepancy_blocks(_matched(spark, d), ["user_id", "method", "persona_id", "window_idx"])


def _candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality of every persona of a community in three windows as candidates, and of all personas as the baseline (candidate 0)."""
    s = table(spark, d, "scores").where(F.col("community_id").isNotNull() & F.col("window_idx").between(0, 2) & F.col("q").isNotNull())
    of = lambda cand: s.groupBy("community_id", cand.alias("cand"), F.col("window_idx").alias("w")).agg(F.avg("q").alias("q"))
    return of(F.col("persona_id").cast("int")).unionByName(of(F.lit(0)))


_CAND = """b AS (SELECT community_id, 0 AS cand, window_idx AS w, avg(q) AS q FROM scores WHERE community_id IS NOT NULL AND window_idx BETWEEN 0 AND 2 AND q IS NOT NULL GROUP BY ALL),
s AS (SELECT community_id, CAST(persona_id AS INTEGER) AS cand, window_idx AS w, avg(q) AS q FROM scores WHERE community_id IS NOT NULL AND window_idx BETWEEN 0 AND 2 AND q IS NOT NULL GROUP BY ALL UNION ALL SELECT * FROM b),
c AS (SELECT DISTINCT community_id, cand FROM s WHERE cand > 0),
rr AS (SELECT c.community_id, CAST(c.cand - 1 AS INTEGER) AS cand, {}),
r AS (SELECT *, r_pre + r_cur + r_fut AS r_all FROM rr)""".format(
    ", ".join(f"coalesce((SELECT q FROM s WHERE s.community_id = c.community_id AND s.cand = c.cand AND s.w = {w}), 0) - coalesce((SELECT q FROM b WHERE b.community_id = c.community_id AND b.w = {w}), 0) AS {n}" for w, n in enumerate(("r_pre", "r_cur", "r_fut"))) + " FROM c"
)


@query(f"WITH {_CAND} SELECT community_id, cand, round(r_pre, 10) AS r_pre, round(r_cur, 10) AS r_cur, round(r_fut, 10) AS r_fut, round(r_all, 10) AS r_all FROM r")
def r_rewards(spark, d):
    return scoring.rewards(_candidate_scores(spark, d), ["community_id"]).select("community_id", "cand", *[F.round(c, 10).alias(c) for c in ("r_pre", "r_cur", "r_fut", "r_all")])


@query(f"""WITH {_CAND} SELECT h.community_id, h.cand AS chosen, l.cand AS rejected, round(h.r_all - l.r_all, 10) AS margin,
             CASE WHEN h.r_all > {C.TAU_PLUS} AND l.r_all < {C.TAU_MINUS} AND h.r_all - l.r_all > {C.DELTA} THEN 'tau_delta' ELSE 'abs_delta' END AS pair_rule,
             CASE WHEN h.cand >= 6 THEN 'commercial' ELSE 'base' END AS chosen_source, CASE WHEN l.cand >= 6 THEN 'commercial' ELSE 'base' END AS rejected_source
           FROM r h JOIN r l ON h.community_id = l.community_id AND h.r_all > 0 AND l.r_all < 0
           WHERE (h.r_all > {C.TAU_PLUS} AND l.r_all < {C.TAU_MINUS} AND h.r_all - l.r_all > {C.DELTA}) OR h.r_all - l.r_all > {C.ABS_DELTA}""")
def r_pairs(spark, d):
    found = pairs.preference_pairs(scoring.rewards(_candidate_scores(spark, d), ["community_id"]), ["community_id"])
    return found.withColumn("margin", F.round("margin", 10))


@query(f"WITH {_CAND} SELECT community_id, cand AS best_cand, round(r_all, 10) AS best_r_all FROM r QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY r_all DESC, cand) = 1")
def r_best_candidates(spark, d):
    return scoring.best_candidate(scoring.rewards(_candidate_scores(spark, d), ["community_id"]), ["community_id"]).withColumn("best_r_all", F.round("best_r_all", 10))


@query(f"WITH {_CAND} SELECT community_id, max(q) FILTER (cand > 0) > max(q) FILTER (cand = 0) AS improved FROM s WHERE w = 1 GROUP BY community_id")
def r_gate(spark, d):
    return scoring.gate(_candidate_scores(spark, d), ["community_id"])


@query("SELECT community_id, method, window_idx, count(*) AS n, round(avg(q) FILTER (NOT isnan(q)), 10) AS mean_q FROM scores GROUP BY ALL")
def r_community_report(spark, d):
    return reports.by_community(table(spark, d, "scores")).withColumn("mean_q", F.round("mean_q", 10))


@query("""WITH p AS (SELECT method, user_id, avg(q) AS mq, avg(q) FILTER (window_idx > 0) AS mc FROM scores GROUP BY ALL)
          SELECT method, count(*) AS users, round(coalesce(avg(mq), 0), 10) AS mean_q, round(coalesce(avg(mc), 0), 10) AS mean_q_chain FROM p GROUP BY method""")
def r_method_report(spark, d):
    return reports.by_method(table(spark, d, "scores")).select("method", "users", F.round("mean_q", 10).alias("mean_q"), F.round("mean_q_chain", 10).alias("mean_q_chain"))


@query("SELECT method, window_idx AS step_index, count(*) AS n, round(avg(f), 10) AS f, round(avg(l), 10) AS l, round(avg(q), 10) AS q FROM scores GROUP BY ALL")
def r_step_report(spark, d):
    return reports.by_step(table(spark, d, "scores")).select("method", "step_index", "n", *[F.round(c, 10).alias(c) for c in ("f", "l", "q")])


def _trim_sql(side: str) -> str:
    low, high = side in ("both", "lower"), side in ("both", "upper")
    return f"SELECT '{side}' AS sides, method, count(*) AS kept, round(avg(q), 10) AS q FROM o WHERE {'r > floor(n * 0.05)' if low else 'true'} AND {'r <= n - floor(n * 0.05)' if high else 'true'} GROUP BY method"


_BY = "user_id, community_id, method, persona_id, window_idx"


@query(f"""WITH o AS (SELECT method, q, row_number() OVER (PARTITION BY method ORDER BY q, {_BY}) AS r, count(*) OVER (PARTITION BY method) AS n FROM scores WHERE q IS NOT NULL)
           {" UNION ALL ".join(_trim_sql(x) for x in ("both", "lower", "upper"))}""")
def r_trimmed_report(spark, d):
    out = None
    for sides in ("both", "lower", "upper"):
        kept = ranks.trim_tails(table(spark, d, "scores"), "q", group=["method"], sides=sides)
        part = kept.groupBy(F.lit(sides).alias("sides"), "method").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("q"), 10).alias("q"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH m AS (SELECT *, avg(q) OVER (PARTITION BY method, window_idx) AS mean, count(*) OVER (PARTITION BY method, window_idx) AS n FROM scores WHERE q IS NOT NULL),
             o AS (SELECT *, row_number() OVER (PARTITION BY method, window_idx, q < mean ORDER BY round(abs(q - mean), 12) DESC, {_BY}) AS r FROM m)
           SELECT method, window_idx, count(*) AS kept, round(avg(q), 10) AS q FROM o WHERE r > floor(n * 0.05) GROUP BY ALL""")
def r_trimmed_steps(spark, d):
    kept = ranks.trim_tails(table(spark, d, "scores"), "q", group=["method", "window_idx"], by="deviation")
    return kept.groupBy("method", "window_idx").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("q"), 10).alias("q"))


_RECENT = f"""r AS (SELECT a.user_id, s.community_id AS community, a.ingest_seq, a.action_type, row_number() OVER (PARTITION BY a.user_id ORDER BY a.date DESC NULLS LAST, a.ingest_seq DESC) AS k,
    count(*) OVER (PARTITION BY a.user_id) AS n FROM actions a JOIN user_stats s ON a.user_id = s.user_id WHERE s.community_id IS NOT NULL),
q AS (SELECT *, least(n, {C.SFT_ACTIONS}) - k AS apos FROM r WHERE k <= {C.SFT_ACTIONS} AND least(n, {C.SFT_ACTIONS}) > {C.SFT_T})"""


@query(f"""WITH {_RECENT} SELECT user_id, CAST(community AS BIGINT) AS community, ingest_seq,
           CASE WHEN action_type IN ('post', 'reply') AND NOT (((user_id % 1000003) * 7919 + (ingest_seq % 1000003) * 104729) % 1000 < 300) THEN 'content' ELSE 'decision' END AS sample_kind FROM q WHERE apos >= {C.SFT_T}""")
def r_samples(spark, d):
    return samples.sft_samples(_actions(spark, d), table(spark, d, "user_stats"), table(spark, d, "user_profile_cache")).select("user_id", "community", "ingest_seq", "sample_kind")


def _sample_line(a: str) -> str:
    kind, target, body, orig = (f"coalesce({a}.{c}, '')" for c in ("action_type", "target", "action_text", "original_text"))
    c = lambda x: f"substring({x}, 1, {C.TEXT_LONG})"
    return f"""'[' || coalesce({a}.timestamp, '') || '] ' || CASE WHEN {kind} = 'reply' THEN 'User commented on "' || {twins.first_of(c(orig), c(target))} || '": "' || {c(body)} || '"'
        WHEN {kind} = 'post' THEN 'User posted: "' || {twins.first_of(c(body), c(target))} || '"' WHEN {kind} = 'like' THEN 'User liked: "' || {c(target)} || '..."'
        WHEN {kind} = 'repost' THEN 'User reposted: "' || {c(target)} || '..."' ELSE 'User performed ' || {kind} || ' on: "' || {c(target)} || '..."' END"""


def _samples_sql() -> str:
    """Samples as text: the last actions of each user, their derived targets, ten lines of history and the scenario."""
    own, orig = f"substring(coalesce(action_text, ''), 1, {C.TEXT_LONG})", f"substring(coalesce(original_text, ''), 1, {C.TEXT_LONG})"
    derived = f"CASE WHEN action_type = 'reply' THEN coalesce(nullif({orig}, ''), nullif({own}, ''), 'post_' || ingest_seq) ELSE coalesce(nullif({own}, ''), nullif({orig}, ''), 'post_' || ingest_seq) END"
    longer = lambda c: f"(CASE WHEN length({c}) > {C.TEXT_LONG} THEN substring({c}, 1, {C.TEXT_LONG}) || '...' ELSE {c} END)"
    given = lambda c: f"'Given that the user''s behavior contains the following content: ' || {c} || E'\\nWhich type of user behavior is this most likely generated from?'"
    t, o = "coalesce(target, '')", "coalesce(original_text, '')"
    say = f"CASE WHEN action_type = 'post' THEN 'Write a post, what content?' ELSE 'Comment on \"' || {twins.first_of(twins.cut(o), twins.cut(t))} || '...\", what is the comment content?' END"
    choose = f"CASE WHEN action_type = 'post' THEN {given(longer(t))} WHEN action_type IN ('reply', 'repost', 'like') THEN {given(twins.first_of(longer(o), longer(t)))} ELSE 'What action to take' END"
    return f"""{_RECENT}, z AS (SELECT a.* EXCLUDE (target), {derived} AS target, q.apos, q.community FROM (SELECT ingest_seq AS seq, apos, community FROM q) q JOIN actions a ON a.ingest_seq = q.seq),
        l AS (SELECT *, {_sample_line('z')} AS line, action_type IN ('post', 'reply') AND NOT (((user_id % 1000003) * 7919 + (ingest_seq % 1000003) * 104729) % 1000 < 300) AS is_content FROM z),
        h AS (SELECT *, string_agg(line, E'\\n') OVER (PARTITION BY user_id ORDER BY apos ROWS BETWEEN {C.SFT_T} PRECEDING AND 1 PRECEDING) AS history FROM l),
        t AS (SELECT h.user_id, CAST(h.community AS BIGINT) AS community, h.ingest_seq, CASE WHEN coalesce(is_content, false) THEN 'content' ELSE 'decision' END AS sample_kind,
            CASE WHEN coalesce(is_content, false) THEN {twins.lit(C.SFT_CONTENT_INSTRUCTION)} ELSE {twins.lit(C.SFT_DECISION_INSTRUCTION)} END AS "Instruction",
            'Target user profile: ' || coalesce(nullif(c.profile_text, ''), 'UserID ' || h.user_id || ', Community ' || h.community) || E'\\nUser historical behavior sequence: ' || history
                || E'\\nCurrent scenario: After completing the above historical behaviors, ' || CASE WHEN coalesce(is_content, false) THEN {say} ELSE {choose} || E'\\nAvailable actions: {C.SFT_AVAILABLE}' END AS "input",
            CASE WHEN coalesce(is_content, false) AND action_type = 'post' THEN {twins.first_of('action_text', 'target')} WHEN coalesce(is_content, false) THEN coalesce(action_text, '') ELSE coalesce(action_type, '') END AS "output"
            FROM h LEFT JOIN user_profile_cache c ON c.user_id = h.user_id AND c.community_id = h.community WHERE apos >= {C.SFT_T})"""


@query(f"WITH {_samples_sql()} SELECT * FROM t")
def r_sample_texts(spark, d):
    return samples.sft_samples(_actions(spark, d), table(spark, d, "user_stats"), table(spark, d, "user_profile_cache"))


@query(f"""WITH {_samples_sql()} SELECT count(*) AS samples, count(*) FILTER (sample_kind = 'content') AS content, count(*) FILTER (sample_kind = 'decision') AS decision,
           count(*) FILTER (contains("input", 'Write a post') OR contains("input", 'Comment on')) AS content_by_text FROM t""")
def r_sample_counts(spark, d):
    return samples.sample_counts(r_sample_texts(spark, d))


@query("SELECT a.user_id, count(*) AS n FROM actions a JOIN user_stats s ON a.user_id = s.user_id GROUP BY a.user_id HAVING count(*) > 10")
def r_users_with_actions(spark, d):
    stats = table(spark, d, "user_stats").select("user_id")
    return _actions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 10").join(stats, "user_id", "left_semi")


def _users(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d).where("community_id is not null").groupBy("user_id").agg(F.min("community_id").alias("community_id"), F.min("ingest_seq").alias("first_seq"))


_USERS = "u AS (SELECT user_id, min(community_id) AS community_id, min(ingest_seq) AS first_seq FROM actions WHERE community_id IS NOT NULL GROUP BY user_id)"


@query(f"""WITH {_USERS}, c AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY first_seq, user_id) AS k FROM u), t AS (SELECT * FROM u ORDER BY first_seq, user_id LIMIT 30)
           SELECT 'community_first' AS cap_order, user_id, community_id FROM (SELECT * FROM c WHERE k <= 3 ORDER BY first_seq, user_id LIMIT 30)
           UNION ALL SELECT 'total_first', user_id, community_id FROM t QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY first_seq, user_id) <= 3""")
def r_capped_users(spark, d):
    """Three users of a community and thirty in all, in both orders of the caps."""
    capped = [ranks.cap_users(_users(spark, d), per_community=3, max_users=30, cap_order=o).select(F.lit(o).alias("cap_order"), "user_id", "community_id") for o in ("community_first", "total_first")]
    return capped[0].unionByName(capped[1])


@query(f"WITH {_USERS} SELECT user_id, community_id FROM u ORDER BY ((user_id % 1000003) * (7919 + 14) + 7 * 104729) % 1000003, user_id LIMIT 20")
def r_sampled_users(spark, d):
    return ranks.sample_users(_users(spark, d), 20, seed=7).select("user_id", "community_id")


@query("""SELECT s.user_id, CAST(s.community_id AS BIGINT) AS community, coalesce(nullif(c.profile_text, ''), 'UserID ' || s.user_id || ', Community ' || s.community_id) AS profile
          FROM user_stats s LEFT JOIN user_profile_cache c ON c.user_id = s.user_id AND c.community_id = s.community_id""")
def r_persona_lookup(spark, d):
    users = table(spark, d, "user_stats").select("user_id", F.col("community_id").cast("bigint").alias("community"))
    return samples.lookup_personas(users, table(spark, d, "user_profile_cache")).select("user_id", "community", "profile")


@query("SELECT user_id, community_id FROM user_stats s WHERE NOT EXISTS (SELECT 1 FROM user_profile_cache c WHERE c.user_id = s.user_id AND c.community_id = s.community_id)")
def r_missing_personas(spark, d):
    return table(spark, d, "user_stats").join(table(spark, d, "user_profile_cache").select("user_id", "community_id"), ["user_id", "community_id"], "left_anti").select("user_id", "community_id")


@query("""WITH m AS (SELECT DISTINCT method FROM scores), u AS (SELECT DISTINCT user_id FROM user_stats)
          SELECT user_id, method FROM u, m WHERE (user_id, method) NOT IN (SELECT DISTINCT user_id, method FROM scores WHERE q IS NOT NULL)""")
def r_open_work(spark, d):
    """User and method pairs without a finished row: expansion by the methods of the sink, then an anti-join on it."""
    rows = table(spark, d, "scores").withColumn("error", F.when(F.col("q").isNull(), F.lit("no score")))
    methods = rows.groupBy(F.lit(1).alias("one")).agg(F.collect_set("method").alias("methods"))
    users = table(spark, d, "user_stats").select("user_id").distinct().withColumn("one", F.lit(1))
    todo = users.join(methods, "one").select("user_id", F.explode("methods").alias("method"))
    return stores.open_work(todo, stores.completed(rows, ["user_id", "method"]), ["user_id", "method"])


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS next FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r_cosine(spark, d):
    """Each vector with the next one."""
    e = table(spark, d, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(following, "vec_id").select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.col("b")), 5).alias("next"))


@query("""SELECT s_.l_suppkey AS user_id, CAST(min(m) AS INTEGER) AS month_start FROM (
            SELECT l_suppkey, m, max(m) OVER (PARTITION BY l_suppkey, island) AS last FROM (
              SELECT l_suppkey, m, m - row_number() OVER (PARTITION BY l_suppkey ORDER BY m) AS island FROM (
                SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem GROUP BY ALL HAVING count(*) >= 5))) s_
          WHERE m + 5 <= last GROUP BY l_suppkey""")
def r_supplier_chain(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("action_ts"))
    rows = rows.withColumn("month_idx", (F.year("action_ts") * 12 + F.month("action_ts")).cast("int"))
    return windows.month_chain(rows, per_window=5, months=6)


@query("""SELECT o_custkey, n_orders, total FROM (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey HAVING count(*) > 10)
          WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o_custkey AND p.o_orderstatus = 'X')""")
def r_customers_with_orders(spark, d):
    o = table(spark, d, "orders")
    big = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n_orders > 10")
    return big.join(o.where("o_orderstatus = 'X'").select("o_custkey").distinct(), "o_custkey", "left_anti")
