"""Composite jobs: windowing of files, preference pairs over rounds, slice and chain evaluation, samples.

Every model stage is materialised (``session.cut``) before it is read twice, so lazy
evaluation never asks a model again. Driver loops run over rounds (2) or chain steps (5),
never over users.
"""

from __future__ import annotations

from dataclasses import dataclass, replace  # noqa: F401  (replace is for callers)

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers, texts, times
from ..operators import discrepancies, pairs, scoring, windows
from ..session import cut
from ..sources import jsonl
from .models import ModelClient, Models, ask, similarity


def windowed_records(users: DataFrame, *, size: int = C.WINDOW_SIZE, number: int = C.NUM_WINDOWS, mode: str = "contiguous", per_month: int = 1, months: int = C.CHAIN_MONTHS) -> DataFrame:
    """Windowed records of raw user records (``jsonl.read_users``), with ``source_file``."""
    rows = jsonl.long_actions(users)
    total = rows.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("total_actions"), F.min("source_file").alias("source_file"))
    if mode == "contiguous":
        w = windows.contiguous_windows(rows, size=size, number=number)
        out = windows.window_map(windows.nest(w)).withColumn("split_mode", F.lit(mode)).withColumn("split_meta", F.lit(None).cast("string"))
    else:
        w = windows.month_chain_windows(rows, per_window=size, months=months, per_month=per_month)
        keys = w.groupBy("user_id").agg(F.min("month_start").alias("m"))
        sampling = "equal_time_span_halves" if per_month == 2 else "single_window_even_time_per_month"
        span = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: times.month_text(F.col("m") + i))
        meta = F.to_json(F.struct(times.month_text(F.col("m")).alias("month_block_start"), span.alias("month_keys_used"), F.lit(months).alias("num_months"), F.lit(per_month).alias("windows_per_month"), F.lit(size).alias("actions_per_window"), F.lit(sampling).alias("month_sampling")))
        out = windows.window_map(windows.nest(w)).join(keys.select("user_id", meta.alias("split_meta")), "user_id").withColumn("split_mode", F.lit(mode))
    return out.join(total, "user_id").withColumn("window_size_effective", F.lit(size))


def prepare_windows(spark: SparkSession, paths: str | list[str], out: str, *, glob: str | None = None, **options) -> DataFrame:
    """Read raw users, write windowed users by community and source file, return the statistics of each file."""
    users = jsonl.read_users(spark, paths, glob)
    kept = cut(windowed_records(users, **options))
    kept.write.mode("overwrite").partitionBy("source_file").json(out)
    have = kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("kept_users"))
    return users.groupBy("source_file").agg(F.countDistinct("user_id").alias("total_users")).join(have, "source_file", "left").select("source_file", "total_users", F.coalesce("kept_users", F.lit(0)).alias("kept_users"), (F.col("total_users") - F.coalesce("kept_users", F.lit(0))).alias("skipped_users"))


def predict(
    targets: DataFrame, keys: list[str], models: Models, *, action_model: Column | None = None, content_gate: str = "actual", parser: str = "substring_ordered", sliding: bool = False
) -> DataFrame:
    """Predicted actions of ``targets`` (keys, profile, history, actions), one row an action, with ``error``.

    ``content_gate`` says whose type decides that a text is asked for: ``actual`` or ``predicted``.
    With ``sliding`` the history of an action goes on with the real actions before it in its
    window. ``action_model`` names the model by row. A target that brings an ``error`` is not
    asked about and keeps it.
    """
    given = F.col("error") if "error" in targets.columns else F.lit(None).cast("string")
    model = F.lit(models.action_model) if action_model is None else action_model
    rows = targets.select(*keys, "profile", "history", "actions", model.alias("_model"), given.alias("_given"), F.posexplode("actions").alias("wpos", "a"))
    if sliding:
        so_far = F.concat("history", F.slice("actions", F.lit(1), F.col("wpos")))
        rows = rows.withColumn("history", F.when(F.size(so_far) > C.HISTORY, F.slice(so_far, -C.HISTORY, C.HISTORY)).otherwise(so_far))
    rows = rows.drop("actions").withColumn("_decision", F.when(F.col("_given").isNull(), texts.decision_prompt(F.col("profile"), F.col("history"), F.col("a"))))
    rows = ask(rows, "_decision", "_said", models.action, F.col("_model"), system=C.DECISION_INSTRUCTION, max_tokens=C.MAX_TOKENS_DECISION, temperature=C.TEMPERATURE_ACTION)
    read = texts.parse_action_type if parser == "substring_ordered" else texts.exact_action_type
    rows = rows.withColumn("pred_type", F.when(F.col("_said").isNotNull(), read(F.col("_said"))))
    gate = texts.text(F.col("a.action_type")) if content_gate == "actual" else F.col("pred_type")
    rows = rows.withColumn("_content", F.when(gate.isin("post", "reply") & F.col("_said").isNotNull(), texts.content_prompt(F.col("profile"), F.col("history"), F.col("a"))))
    rows = ask(rows, "_content", "pred_content", models.action, F.col("_model"), system=C.CONTENT_INSTRUCTION, max_tokens=C.MAX_TOKENS_ACTION, temperature=C.TEMPERATURE_ACTION)
    actual = F.when(texts.text(F.col("a.action_type")) == "reply", texts.text(F.col("a.action_text"))).otherwise(texts.first_of(F.col("a.action_text"), F.col("a.target")))
    rows = rows.withColumn("semantic_similarity", similarity(models.embedder)(F.col("pred_content"), actual))
    return rows.select(*keys, "wpos", "pred_type", "pred_content", "semantic_similarity", "a.action_type", "a.action_text", "a.target", F.coalesce("_given", "_said_error", "pred_content_error").alias("error"))


def _history(w: DataFrame) -> DataFrame:
    """Windows with ``history``, and with ``observed``, the block of the window before as text."""
    before = F.lag("actions").over(Window.partitionBy("user_id").orderBy("window_idx"))
    shown = texts.observed_suffix(F.col("_before"), F.concat(F.lit("W"), (F.col("window_idx") - 1).cast("string")))
    rows = windows.fixed_history(w.select("user_id", "community_id", "window_idx", "actions")).withColumn("_before", before)
    return rows.withColumn("observed", F.when(F.col("_before").isNotNull(), shown)).drop("_before")


def _words(answer: str, otherwise: Column) -> Column:
    """An answer, or ``otherwise`` where it is null or blank."""
    return F.coalesce(F.nullif(texts.strip(texts.text(answer)), F.lit("")), otherwise)


def first_personas(nested: DataFrame, models: Models, *, window_idx: int = 0, budget: int = C.BEHAVIOR_CHARS) -> DataFrame:
    """(user_id, profile, error) from the actions of one window; empty actions give an empty persona, a budget of 0 cuts nothing."""
    w0 = nested.where(F.col("window_idx") == window_idx).select("user_id", F.when(F.size("actions") > 0, texts.persona_prompt(F.col("actions"), budget)).alias("_p"))
    return _made(w0, models.base, models.persona_model).select("user_id", "profile", "error")


def _made(rows: DataFrame, client: ModelClient, model: str | Column, temperature: float = C.TEMPERATURE_PROFILE) -> DataFrame:
    """``rows`` with the persona made from the prompt ``_p``, and ``error``."""
    got = ask(rows, "_p", "profile", client, model, system=C.SYSTEM_PROFILE, max_tokens=C.MAX_TOKENS_PROFILE, temperature=temperature)
    return got.withColumn("profile", texts.text("profile")).withColumnRenamed("profile_error", "error").drop("_p")


def generate_personas(actions: DataFrame, stats: DataFrame, cache_path: str, models: Models, *, communities: list[int] | None = None) -> DataFrame:
    """(user_id, community, profile) of all users: cached personas, new ones for the rest, a placeholder where the model failed.

    New personas of a model are put into the cache table (placeholders are not), with their
    sample size, token estimate and length; a second run asks for nothing.
    """
    from ..operators import samples
    from ..sources import schemas, stores

    spark = actions.sparkSession
    rows = samples.recent_actions(actions, stats, communities=communities)
    users = rows.select("user_id", "community").distinct()
    cache = stores.read_or_empty(spark, cache_path, schemas.PERSONA_CACHE)
    have = cache.select("user_id", F.col("community_id").cast("bigint").alias("community"))
    todo = rows.join(have, ["user_id", "community"], "left_anti")
    act = F.struct("apos", "action_type", "action_text", "original_text", "target", "timestamp")
    todo = todo.groupBy("user_id", "community").agg(F.array_sort(F.collect_list(act)).alias("a"))
    todo = todo.select("user_id", "community", F.size("a").alias("n"), texts.fill(C.FREE_FORM, action_count=F.size("a").cast("string"), behavior_data=texts.profile_lines(F.col("a"))).alias("_p"))
    new = cut(ask(todo, "_p", "text", models.base, models.persona_model, system=C.SYSTEM_PROFILE, max_tokens=C.MAX_TOKENS_PROFILE, temperature=C.TEMPERATURE_PROFILE))
    good = new.where(texts.text("text") != "").select(
        F.col("community").cast("int").alias("community_id"), "user_id", F.col("text").alias("profile_text"), F.col("n").alias("sample_size"),
        texts.token_estimate(F.col("text")).alias("profile_tokens"), F.length("text").alias("profile_chars"), F.current_timestamp().alias("updated_at"),
    )
    stores.insert_if_absent(good, cache_path, ["community_id", "user_id"], schemas.PERSONA_CACHE)
    return samples.lookup_personas(users, stores.read_or_empty(spark, cache_path, schemas.PERSONA_CACHE))


def candidates(personas: DataFrame, blocks: DataFrame, models: Models, n: int = C.CANDIDATES) -> DataFrame:
    """(user_id, cand, source, profile, error): ``n`` refinements of each persona, the first from the base model, the rest from the commercial one.

    All are asked with one prompt and their number as seed; a blank answer is a blank persona.
    """
    rows = personas.join(blocks, "user_id").withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("source", numbers.candidate_source(F.col("cand"), F.lit(n))).withColumn("_p", texts.refinement_prompt(F.col("profile"), F.col("discrepancies")))
    done = None
    for source, client, model in (("base", models.base, models.persona_model), ("commercial", models.commercial, models.commercial_model)):
        part = ask(rows.where(F.col("source") == source), "_p", "_new", client, model, system=C.SYSTEM_REFINEMENT, max_tokens=C.MAX_TOKENS_PROFILE, temperature=C.TEMPERATURE_PROFILE, seed=F.col("cand"))
        done = part if done is None else done.unionByName(part)
    return done.select("user_id", "cand", "source", texts.text("_new").alias("profile"), F.col("_new_error").alias("error"))


def _evaluate(personas: DataFrame, w: DataFrame, extra: list[str], models: Models) -> DataFrame:
    """Scores of personas (user_id, *extra, profile) on windows with history (user_id, w, history, actions)."""
    keys = ["user_id", *extra, "w"]
    return scoring.score(predict(personas.join(w, "user_id"), keys, models), keys, parser="exact")


def _errors(*parts: DataFrame) -> DataFrame:
    """(user_id, error): the users of whom any part has an error."""
    every = None
    for p in parts:
        p = p.where("error is not null").select("user_id", "error")
        every = p if every is None else every.unionByName(p)
    return every.groupBy("user_id").agg(F.min("error").alias("error"))


@dataclass(frozen=True)
class RoundResult:
    """``pairs``, ``rewards`` of candidates, ``rounds`` (one row per user), the next ``personas`` and the users with ``errors``."""

    pairs: DataFrame
    rewards: DataFrame
    rounds: DataFrame
    personas: DataFrame
    errors: DataFrame


def _scores_map(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scores): F, L and Q by window (three at most) as a map."""
    entry = F.struct(F.concat(F.lit("W"), F.col("w").cast("string")), F.struct(F.col("f").alias("F"), F.col("l").alias("L"), F.col("q").alias("Q")))
    return scores.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scores"))


def pair_round(personas: DataFrame, history: DataFrame, round_idx: int, models: Models, n: int = C.CANDIDATES) -> RoundResult:
    """One rolling round for all users (user_id, profile, source) at once: windows r, r+1, r+2.

    Candidates are scored on the middle window first; only users for whom one of them is
    better go on to the outer windows. The baseline's prediction of the middle window is
    made once and serves both its score and the block of differences. A user with a failed
    call has an error row in ``rounds`` and nothing else.
    """
    trip = history.where(F.col("window_idx").between(round_idx, round_idx + 2)).withColumn("w", F.col("window_idx") - round_idx)
    full = trip.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 3").select("user_id")
    empty = F.slice("actions", 1, 0)
    trip = trip.join(full, "user_id", "left_semi").withColumn("history", F.when(F.col("w") == 0, empty).otherwise(F.col("history"))).select("user_id", "w", "history", "actions")
    personas = personas.select("user_id", "profile", "source")
    base_pred = cut(predict(personas.join(trip, "user_id"), ["user_id", "w"], models))
    base = cut(scoring.score(base_pred, ["user_id", "w"])).withColumn("cand", F.lit(0))
    well = personas.join(full, "user_id", "left_semi").join(_errors(base), "user_id", "left_anti")
    blocks = discrepancies.discrepancy_blocks(base_pred.where("w = 1"), ["user_id"])
    cands = cut(candidates(well, blocks, models, n))
    mid = cut(_evaluate(cands, trip.where("w = 1"), ["cand"], models)).withColumn("cand", F.col("cand") + 1)
    cols = ["user_id", "cand", "w", "f", "l", "q"]
    early = _errors(base, mid)
    improved = scoring.gate(base.select(*cols).unionByName(mid.select(*cols)).join(early, "user_id", "left_anti"), ["user_id"])
    go = improved.where("improved").select("user_id")
    outer = cut(_evaluate(cands.join(go, "user_id", "left_semi"), trip.where("w <> 1"), ["cand"], models)).withColumn("cand", F.col("cand") + 1)
    errors = cut(_errors(base, mid, outer))
    go = go.join(errors, "user_id", "left_anti")
    scores = base.select(*cols).unionByName(mid.select(*cols)).unionByName(outer.select(*cols)).join(go, "user_id", "left_semi")
    reward = cut(scoring.rewards(scores, ["user_id"]))
    best = scoring.best_candidate(reward, ["user_id"])
    found = pairs.preference_pairs(reward, ["user_id"], n_candidates=n)
    known = reward.join(cands.select("user_id", "cand", "profile"), ["user_id", "cand"]).join(_scores_map(scores.where("cand > 0"), ["user_id", "cand"]).withColumn("cand", F.col("cand") - 1), ["user_id", "cand"])
    for side in ("chosen", "rejected"):
        mine = known.select("user_id", F.col("cand").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("profile", "r_pre", "r_cur", "r_fut", "r_all", "scores")])
        found = found.join(mine, ["user_id", side])
    start = personas.select("user_id", F.col("profile").alias("baseline_profile"), F.col("source").alias("baseline_source"))
    at_start = _scores_map(scores.where("cand = 0"), ["user_id"]).withColumnRenamed("scores", "baseline_scores")
    triplet = F.array(*[F.lit(f"W{round_idx + i}") for i in range(3)])
    found = cut(found.join(start, "user_id").join(at_start, "user_id").join(blocks, "user_id").withColumn("round_idx", F.lit(round_idx + 1)).withColumn("window_triplet", triplet))
    count = found.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n_pairs"))
    log = personas.join(full, "user_id", "left_semi").select("user_id").join(errors, "user_id", "left").join(improved, "user_id", "left").join(best, "user_id", "left").join(count, "user_id", "left")
    log = log.withColumn("improved", F.when(F.col("error").isNull(), F.col("improved"))).withColumn("n_pairs", F.when(F.col("error").isNull(), F.coalesce("n_pairs", F.lit(0))))
    log = log.withColumns({"round_idx": F.lit(round_idx + 1), "window_triplet": triplet, "n_candidates": F.lit(n), "skip_reason": F.when(~F.col("improved"), F.lit("no_candidate_improves_w1_over_baseline"))})
    nxt = best.join(cands, "user_id").where("cand = best_cand").select("user_id", "profile", "source")
    # users whose candidates did not help keep their persona
    kept = personas.join(nxt.select("user_id"), "user_id", "left_anti")
    return RoundResult(found, reward, log, cut(nxt.unionByName(kept).join(errors, "user_id", "left_anti")), errors)


def mine_pairs(nested: DataFrame, models: Models, *, rounds: int = C.ROUNDS, n: int = C.CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(pairs, round log) of all users over rolling rounds.

    A user whose first round has no better candidate, or gives no pair, stops; in later
    rounds such a round is skipped and the persona kept. A user with a failed call in any
    round gives no pair, and every row of the log has the error.
    """
    history = cut(_history(nested))
    first = cut(first_personas(nested, models))
    errors = first.where("error is not null").select("user_id", "error")
    logs = errors.withColumn("round_idx", F.lit(1))
    enough = nested.groupBy("user_id").agg(numbers.effective_rounds(F.count(F.lit(1)).cast("int"), rounds).alias("_rounds"))
    personas = first.where("error is null").select("user_id", "profile", F.lit("base").alias("source")).join(enough.where("_rounds > 0").select("user_id"), "user_id", "left_semi")
    all_pairs = None
    for r in range(rounds):
        got = pair_round(personas.join(enough.where(F.col("_rounds") > r), "user_id", "left_semi"), history, r, models, n)
        log = cut(got.rounds)
        all_pairs = got.pairs if all_pairs is None else all_pairs.unionByName(got.pairs)
        logs = logs.unionByName(log, allowMissingColumns=True)
        errors = errors.unionByName(got.errors)
        personas = got.personas
        if r == 0:
            personas = personas.join(got.pairs.select("user_id").distinct(), "user_id", "left_semi")
    errors = errors.groupBy("user_id").agg(F.min("error").alias("_error"))
    logs = logs.join(errors, "user_id", "left").withColumn("error", F.coalesce("error", "_error")).drop("_error")
    return all_pairs.join(errors, "user_id", "left_anti"), logs


@dataclass(frozen=True)
class Method:
    """A chain method: how the persona is updated, and which models and history it uses."""

    name: str
    update: str = "none"  # none | rebuild | incremental | error
    persona_model: str = "baseline"
    action_model: str = "baseline"
    history: bool = True
    persona: bool = True
    accept: str = "improve"  # improve | always


# The methods of the chain evaluation by what they do.
METHODS = (
    Method("static_s0"), Method("prefix_refresh", "rebuild"), Method("incremental_persona", "incremental"), Method("history_only", persona=False),
    Method("online", "error", "tuned", "tuned"), Method("online_no_hist", "error", "tuned", "tuned", history=False),
    Method("online_ablate_action_base", "error", "tuned", "baseline"), Method("online_ablate_profile_base", "error", "baseline", "tuned"),
    Method("online_ablate_profile_stage1", "error", "stage1", "tuned"),
)


@dataclass(frozen=True)
class ChainResult:
    """``rows`` per user, method and step; ``personas`` before the first step and after every one; ``three`` the old and the new persona in the last three windows."""

    rows: DataFrame
    personas: DataFrame
    three: DataFrame | None


def evaluate_chain(nested: DataFrame, methods: Method | tuple[Method, ...], models: Models, *, steps: int = C.NUM_WINDOWS_CHAIN - 1, three_windows: bool = False) -> ChainResult:
    """(user_id, community_id, method, step_index, target_window, f, l, q, error): persona k predicts window k + 1.

    All methods run side by side: the method, its models and its history are values of a row.
    After each step the persona is updated by the method; an error-driven update is kept if
    it does better on the window it was made from, unless ``accept`` is ``always``. Every
    user has a row for every method and step: a missing window is an error of its step, and
    after a failed call all rows of the user and method have null scores and the error.
    """
    methods = (methods,) if isinstance(methods, Method) else methods
    hist = cut(_history(nested))
    so_far = windows.cumulative(nested.select("user_id", "community_id", "window_idx", "actions")).select("user_id", "window_idx", "so_far")
    name = lambda lead, m: F.lit(f"{lead}-{m}")
    settings = F.explode(F.array(*[
        F.struct(F.lit(m.name).alias("method"), F.lit(m.update).alias("update"), name(models.persona_model, m.persona_model).alias("persona_model"), name(models.action_model, m.action_model).alias("action_model"),
                 F.lit(m.history).alias("shown"), F.lit(m.persona).alias("has_persona"), F.lit(m.accept).alias("accept"))
        for m in methods
    ]))
    state = nested.groupBy("user_id").agg(F.min("community_id").alias("community_id")).select("user_id", "community_id", settings.alias("m")).select("user_id", "community_id", "m.*")
    # methods with the same persona model share the first persona
    w0 = nested.where("window_idx = 0").select("user_id", F.when(F.size("actions") > 0, texts.persona_prompt(F.col("actions"))).alias("_p"))
    start = cut(_made(state.where("has_persona").select("user_id", "persona_model").distinct().join(w0, "user_id"), models.base, F.col("persona_model")))
    state = cut(state.join(start, ["user_id", "persona_model"], "left").withColumn("profile", F.when(F.col("has_persona"), texts.text("profile")).otherwise(F.lit(""))).withColumn("error", F.when(F.col("has_persona"), F.col("error"))))
    keys = ["user_id", "method"]
    saved = state.where("has_persona AND error is null").select(*keys, F.lit(0).alias("step_index"), "profile")
    out = before_last = None

    def predicted(rows: DataFrame, w: int) -> DataFrame:
        """Predictions of window ``w`` by the personas of ``rows``."""
        target = hist.where(F.col("window_idx") == w).select("user_id", "history", "actions")
        shown = F.when(F.col("shown"), F.col("history")).otherwise(F.slice("actions", 1, 0))
        return predict(rows.select(*keys, "action_model", "shown", "profile").join(target, "user_id").withColumn("history", shown), keys, models, action_model=F.col("action_model"))

    for step in range(steps):
        w = step + 1
        pred = cut(predicted(state.where("error is null"), w))
        got = scoring.score(pred, keys).select(*keys, "f", "l", "q", F.col("error").alias("_failed"), F.lit(True).alias("_there"))
        rows = state.join(got, keys, "left")
        missing = F.when(F.col("_there").isNull(), F.lit(f"no_window_W{w}"))
        rows = cut(rows.withColumn("error", F.coalesce("error", "_failed")).withColumn("_gap", F.coalesce("error", missing)))
        part = rows.select("user_id", "community_id", "method", F.lit(step).alias("step_index"), F.lit(f"W{w}").alias("target_window"), "f", "l", "q", F.col("_gap").alias("error"))
        out = part if out is None else out.unionByName(part)
        if step + 1 == steps and not three_windows:
            break
        state = rows.drop("f", "l", "_failed", "_there", "_gap")
        due = rows.where("_gap is null AND update <> 'none'").select(*keys, "persona_model", "action_model", "update", "accept", "shown", "profile", F.col("q").alias("_old"))
        blocks = discrepancies.discrepancy_blocks(pred.join(due.where("update = 'error'").select(*keys), keys, "left_semi"), keys)
        seen = nested.where(F.col("window_idx") == w).select("user_id", "actions").join(so_far.where(F.col("window_idx") == w).select("user_id", "so_far"), "user_id")
        due = due.join(seen, "user_id").join(blocks, keys, "left")
        old = F.col("profile")
        prompt = (
            F.when(F.col("update") == "rebuild", texts.persona_prompt(F.col("so_far")))
            .when(F.col("update") == "incremental", texts.refinement_prompt(old, texts.refine_block(F.col("actions"), F.lit(f"W{w}"))))
            .otherwise(texts.refinement_prompt(old, F.col("discrepancies")))
        )
        system = F.when(F.col("update") == "rebuild", F.lit(C.SYSTEM_PROFILE)).otherwise(F.lit(C.SYSTEM_REFINEMENT))
        new = ask(due.withColumn("_p", prompt).drop("actions", "so_far", "discrepancies"), "_p", "_new", models.base, F.col("persona_model"), system=system, max_tokens=C.MAX_TOKENS_PROFILE, temperature=C.TEMPERATURE_PROFILE)
        new = cut(new.select(*keys, "action_model", "update", "accept", "shown", "_old", _words("_new", old).alias("profile"), F.col("_new_error").alias("_failed")))
        judged = new.where("update = 'error' AND accept = 'improve' AND _failed is null")
        again = scoring.score(predicted(judged, w), keys).select(*keys, F.col("q").alias("_q"), F.col("error").alias("_again"), F.lit(True).alias("_judged"))
        new = new.join(again, keys, "left").select(*keys, F.col("profile").alias("_new"), F.coalesce("_failed", "_again").alias("_failed"), (F.col("_judged").isNull() | (F.col("_q") > F.col("_old"))).alias("_take"))
        before_last = state.select(*keys, F.col("profile").alias("_before"))
        state = cut(state.drop("q").join(new, keys, "left").withColumn("profile", F.when(F.col("_take"), F.col("_new")).otherwise(F.col("profile"))).withColumn("error", F.coalesce("error", "_failed")).drop("_new", "_failed", "_take"))
        saved = saved.unionByName(state.where("has_persona AND error is null").select(*keys, F.lit(w).alias("step_index"), "profile"))
    # the error of a failed call belongs to the whole chain of a user and method
    failed = cut(out.unionByName(state.select("user_id", "community_id", "method", F.lit(steps).alias("step_index"), F.lit(None).cast("string").alias("target_window"), *[F.lit(None).cast("double").alias(c) for c in "flq"], "error")))
    failed = failed.where("error is not null AND NOT error LIKE 'no_window_%'").groupBy(*keys).agg(F.min("error").alias("_failed"))
    rows = out.join(failed, keys, "left").withColumns({c: F.when(F.col("_failed").isNull(), F.col(c)) for c in ("f", "l", "q")}).withColumn("error", F.coalesce("_failed", "error")).drop("_failed")
    three = None
    if three_windows:
        # the last update is judged where it comes from, before and after: three windows with the old and the new persona
        parts = []
        for which, who in (("old", state.join(before_last, keys).withColumn("profile", F.col("_before"))), ("new", state)):
            for place, w in (("past", steps - 2), ("current", steps - 1), ("future", steps)):
                got = scoring.score(predicted(who.where("error is null AND update <> 'none'"), w), keys)
                parts.append(got.select(*keys, F.lit(which).alias("persona"), F.lit(place).alias("place"), F.lit(f"W{w}").alias("target_window"), "f", "l", "q", "error"))
        three = parts[0]
        for p in parts[1:]:
            three = three.unionByName(p)
    return ChainResult(rows, saved, three)


# Slice variants as (name, what drives the refinement, whose model makes the persona).
VARIANTS = (
    ("tuned", "error", "tuned"), ("baseline", "error", "baseline"), ("commercial", "error", "commercial"),
    ("incremental_persona", "incremental", "baseline"), ("regeneration_persona", "regeneration", "baseline"),
)
SLICE_MODES = ("w1_w2", "w2_w3", "w0_w1_w2_p0p1")


def evaluate_slice(nested: DataFrame, variants: str | tuple[str, ...], models: Models, *, mode: str = "w1_w2", inject_history: bool = True, shared_p0: DataFrame | None = None) -> DataFrame:
    """One row per user and variant of a fixed slice: scores before and after one refinement.

    ``mode``: w1_w2 (persona from W0 scored on W1, refined, scored on W2), w2_w3 (two
    refinements; the columns W1_* and W2_* hold the windows W2 and W3), w0_w1_w2_p0p1 (both
    personas on W0, W1, W2, and their means). All variants run side by side; all predict with
    the tuned action model. ``shared_p0`` (user_id, profile[, error]) serves every variant.
    Users with too few windows, and those with a failed call, have a row with ``error`` and null scores.
    """
    wanted = [v for v in VARIANTS if v[0] in ((variants,) if isinstance(variants, str) else variants)]
    need = 4 if mode == "w2_w3" else 3
    state = windows.enough_windows(nested, need)
    ok = nested.join(state.where("error is null").select("user_id"), "user_id", "left_semi")
    hist = cut(_history(ok))
    keys = ["user_id", "profile_variant"]
    which = F.explode(F.array(*[F.struct(F.lit(n).alias("profile_variant"), F.lit(d).alias("drive"), F.lit(m).alias("maker")) for n, d, m in wanted]))
    users = ok.select("user_id").distinct().select("user_id", which.alias("v")).select("user_id", "v.*")
    model_of = F.when(F.col("maker") == "commercial", F.lit(models.commercial_model)).otherwise(F.concat(F.lit(f"{models.persona_model}-"), F.col("maker")))

    def by_maker(rows: DataFrame, make) -> DataFrame:
        """``make`` applied with the commercial client to the rows of its maker, with the base client to the others."""
        return make(rows.where("maker <> 'commercial'"), models.base).unionByName(make(rows.where("maker = 'commercial'"), models.commercial))

    if shared_p0 is None:
        w0 = ok.where("window_idx = 0").select("user_id", F.when(F.size("actions") > 0, texts.persona_prompt(F.col("actions"))).alias("_p"))
        makers = users.select("user_id", "maker").distinct().join(w0, "user_id")
        made = by_maker(makers, lambda r, c: _made(r, c, model_of, C.TEMPERATURE_COMMERCIAL if c is models.commercial else C.TEMPERATURE_PROFILE))
        p0 = cut(users.join(made, ["user_id", "maker"], "left"))
    else:
        given = shared_p0 if "error" in shared_p0.columns else shared_p0.withColumn("error", F.lit(None).cast("string"))
        p0 = users.join(given.select("user_id", "profile", "error"), "user_id").withColumn("error", F.when(F.col("error").isNotNull(), F.concat(F.lit("shared_p0_failed:"), "error")))

    def predicted(who: DataFrame, i: int) -> DataFrame:
        target = hist.where(F.col("window_idx") == i).select("user_id", "history", "actions", "observed")
        rows = who.where("error is null").join(target, "user_id")
        shown = inject_history and i > 0
        # with history, the window before also stands behind the persona
        rows = rows.withColumn("profile", texts.with_suffix(F.col("profile"), F.col("observed"))) if shown else rows.withColumn("history", F.slice("actions", 1, 0))
        return predict(rows, keys, models, action_model=F.lit(f"{models.action_model}-tuned"))

    def refine(who: DataFrame, pred: DataFrame, i: int) -> DataFrame:
        """The personas after window ``i``, by what drives each variant."""
        blocks = discrepancies.discrepancy_blocks(pred.where("error is null"), keys)
        seen = hist.where(F.col("window_idx") == i).select("user_id", "actions")
        upto = windows.cumulative(ok.select("user_id", "community_id", "window_idx", "actions")).where(F.col("window_idx") == i).select("user_id", "so_far")
        rows = who.where("error is null").join(seen, "user_id").join(upto, "user_id").join(blocks, keys, "left")
        drive = F.col("drive")
        block = F.when(drive == "incremental", texts.refine_block(F.col("actions"), F.lit(f"W{i}"))).otherwise(F.col("discrepancies"))
        rows = rows.withColumn("_p", F.when(drive == "regeneration", texts.persona_prompt(F.col("so_far"))).otherwise(texts.refinement_prompt(F.col("profile"), block)))
        system = F.when(drive == "regeneration", F.lit(C.SYSTEM_PROFILE)).otherwise(F.lit(C.SYSTEM_REFINEMENT))
        rows = rows.select(*keys, "drive", "maker", "profile", "_p")
        got = by_maker(rows, lambda r, c: ask(r, "_p", "_new", c, model_of, system=system, max_tokens=C.MAX_TOKENS_PROFILE, temperature=C.TEMPERATURE_PROFILE))
        # base refinements fall back to the old persona, commercial and regenerated ones stay as they are
        text = F.when((drive == "regeneration") | (F.col("maker") == "commercial"), texts.text("_new")).otherwise(_words("_new", F.col("profile")))
        got = got.select(*keys, text.alias("_text"), F.col("_new_error").alias("_failed"))
        return cut(who.join(got, keys, "left").withColumn("profile", F.col("_text")).withColumn("error", F.coalesce("error", "_failed")).drop("_text", "_failed"))

    def scored(pred: DataFrame, lead: str) -> DataFrame:
        s = scoring.score(pred, keys)
        return s.select(*keys, *[F.col(c).alias(f"{lead}_{c.upper()}") for c in ("f", "l", "q")], F.col("error").alias(f"_e_{lead}"))

    if mode == "w0_w1_w2_p0p1":
        preds = [cut(predicted(p0, i)) for i in range(3)]
        p1 = refine(p0, preds[1], 1)
        parts = [scored(preds[i], f"P0_W{i}") for i in range(3)] + [scored(cut(predicted(p1, i)), f"P1_W{i}") for i in range(3)]
        personas = [p0, p1]
    else:
        pred = cut(predicted(p0, 1))
        p1 = refine(p0, pred, 1)
        second = cut(predicted(p1, 2))
        personas = [p0, p1]
        if mode == "w1_w2":
            parts = [scored(pred, "W1"), scored(second, "W2")]
        else:
            p2 = refine(p1, second, 2)
            parts = [scored(pred, "_W1"), scored(second, "W1"), scored(cut(predicted(p2, 3)), "W2")]
            personas.append(p2)
    rows = users
    for p in parts:
        rows = rows.join(p, keys, "left")
    for k, p in enumerate(personas):
        rows = rows.join(p.select(*keys, F.length("profile").alias(f"profile_p{k}_chars"), F.col("error").alias(f"_p{k}")), keys, "left")
    errors = [c for c in rows.columns if c.startswith(("_e_", "_p"))]
    rows = rows.withColumn("_error", F.coalesce(*errors)).drop(*errors, "_W1_F", "_W1_L", "_W1_Q")
    if mode == "w0_w1_w2_p0p1":
        for lead, col in (("P0", "W1"), ("P1", "W2")):
            rows = rows.withColumns({f"{col}_{c}": numbers.mean_three(*[F.col(f"{lead}_W{i}_{c}") for i in range(3)]) for c in "FLQ"})
    known = [c for c in rows.columns if c[0] in "PW" and c[-2:] in ("_F", "_L", "_Q")]
    rows = rows.withColumns({c: F.when(F.col("_error").isNull(), F.col(c)) for c in known}).drop("drive").withColumnRenamed("maker", "persona_backend")
    head = state.join(nested.groupBy("user_id").agg(F.min("community_id").alias("community_id")), "user_id").select("*", F.explode(F.array(*[F.lit(n) for n, _, _ in wanted])).alias("profile_variant"))
    return head.join(rows, keys, "left").withColumn("error", F.coalesce("error", "_error")).drop("_error").withColumn("slice_eval_mode", F.lit(mode))


def shared_personas(nested: DataFrame, models: Models, store_path: str) -> DataFrame:
    """(user_id, profile, error): the commercial first persona of each user, from the store where it is there, else made and stored.

    A failed call gives an error and is not stored.
    """
    from ..sources import schemas, stores

    spark = nested.sparkSession
    users = nested.groupBy("user_id").agg(F.min("community_id").alias("community_id"))
    # the store is replaced below, so what is read of it is cut off before
    have = cut(stores.stored_personas(users, stores.read_or_empty(spark, store_path, schemas.PERSONA_STORE).where("p0_text <> ''")))
    w0 = nested.where("window_idx = 0").select("user_id", F.when(F.size("actions") > 0, texts.persona_prompt(F.col("actions"))).alias("_p"))
    new = cut(_made(have.where("p0_text is null").select("user_id", "community_id").join(w0, "user_id"), models.commercial, models.commercial_model, C.TEMPERATURE_COMMERCIAL))
    good = new.where("error is null").select("user_id", "community_id", F.array(F.lit("W0")).alias("window_keys_used"), F.col("profile").alias("p0_text"))
    stores.upsert_latest(good, store_path, ["user_id", "community_id"], schemas.PERSONA_STORE)
    return have.where("p0_text is not null").select("user_id", F.col("p0_text").alias("profile"), F.lit(None).cast("string").alias("error")).unionByName(new.select("user_id", "profile", "error"))


def sft_files(spark: SparkSession, actions: DataFrame, stats: DataFrame, cache: DataFrame, out: str, *, communities: list[int] | None = None, seed: int = 0) -> None:
    """Instruction samples as JSON lines in folders by community; reading the parent folder gives the merged set."""
    from ..operators.samples import sft_samples

    rows = sft_samples(actions, stats, cache, communities=communities, seed=seed)
    rows.select("community", "Instruction", "input", "output", "user_id").write.mode("overwrite").partitionBy("community").json(out)
