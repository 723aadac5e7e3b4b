"""Command lines: python -m strandweave.cli {windows,pairs,samples,chain,slice} ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .operators import ranks, reports, windows
from .plans import pipelines
from .plans.models import EncoderEmbedder, HttpClient, LocalClient, Models, endpoints
from .session import cut
from .sources import jsonl, sinks, stores, table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandweave", description=__doc__)
    p.add_argument("--models", choices=("stand-in", "http"), default="stand-in")
    p.add_argument("--action-bases", default="", help="endpoints of the action model, by comma")
    p.add_argument("--persona-bases", default="")
    p.add_argument("--commercial-bases", default="")
    p.add_argument("--persona-path", default="", help="a local text-generation model in the place of the persona endpoints")
    p.add_argument("--action-path", default="", help="a local text-generation model in the place of the action endpoints")
    p.add_argument("--encoder-path", default="", help="a local encoder for similarities; without it the stand-in encoder")
    p.add_argument("--test", action="store_true", help="a small run: two users, two candidates, one round")
    sub = p.add_subparsers(dest="job", required=True)

    w = sub.add_parser("windows", help="split raw users into windows")
    w.add_argument("--input", required=True)
    w.add_argument("--output", required=True)
    w.add_argument("--split", default=None)
    w.add_argument("--file-glob", default=None, help="names of the files to read; all files without it")
    w.add_argument("--window-size", type=int, default=C.WINDOW_SIZE)
    w.add_argument("--num-windows", type=int, default=C.NUM_WINDOWS)
    w.add_argument("--split-mode", choices=("contiguous", "monthly_chain"), default="contiguous")
    w.add_argument("--actions-per-month", type=int, default=C.WINDOW_SIZE)
    w.add_argument("--windows-per-month", type=int, default=C.WINDOWS_PER_MONTH)

    def windowed(s: argparse.ArgumentParser) -> None:
        s.add_argument("--input", nargs="*", default=[])
        s.add_argument("--input-dir", default=None)
        s.add_argument("--input-glob", default=None, help="names of the files in --input-dir; by --dataset without it")
        s.add_argument("--dataset", choices=tuple(jsonl.WINDOWED_GLOBS), default=None, help="which windowed data set to read from --input-dir")
        s.add_argument("--output-dir", required=True)
        s.add_argument("--max-users", type=int, default=None)
        s.add_argument("--max-users-per-community", type=int, default=0)
        s.add_argument("--cap-order", choices=("community_first", "total_first"), default="community_first")
        s.add_argument("--seed", type=int, default=None, help="take users in a seeded order")
        s.add_argument("--resume", action="store_true")

    d = sub.add_parser("pairs", help="preference pairs over rolling rounds")
    windowed(d)
    d.add_argument("--rounds", type=int, default=C.ROUNDS)
    d.add_argument("--num-candidates", type=int, default=C.CANDIDATES)

    s = sub.add_parser("samples", help="instruction samples from tables")
    s.add_argument("--tables", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--communities", type=lambda x: [int(i) for i in x.split(",")], default=None)
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--max-users", type=int, default=None)
    s.add_argument("--no-real-profile", action="store_true", help="placeholders instead of cached personas")

    c = sub.add_parser("chain", help="evaluate chain methods")
    windowed(c)
    c.add_argument("--methods", default=",".join(m.name for m in pipelines.METHODS))
    c.add_argument("--num-windows", type=int, default=C.NUM_WINDOWS_CHAIN)
    c.add_argument("--always-accept-refinement", action="store_true")
    c.add_argument("--no-action-prompt-observed-history", action="store_true")
    c.add_argument("--no-three-window-evaluation", action="store_true")
    c.add_argument("--plot-trim-each-tail", type=float, default=C.TRIM_TAIL)
    c.add_argument("--plot-trim-sides", choices=("both", "lower", "upper"), default="both")

    e = sub.add_parser("slice", help="evaluate personas before and after a refinement")
    windowed(e)
    e.add_argument("--variants", default=",".join(v[0] for v in pipelines.VARIANTS))
    e.add_argument("--slice-eval-mode", choices=pipelines.SLICE_MODES, default="w1_w2")
    e.add_argument("--initial-p0", choices=("per_variant", "shared"), default="per_variant")
    e.add_argument("--p0-cache-dir", default=None, help="the store of shared first personas")
    e.add_argument("--no-action-prompt-observed-history", action="store_true")
    return p


def _models(a: argparse.Namespace) -> Models:
    if a.models == "stand-in":
        return Models()
    http = lambda bases: HttpClient(endpoints(*bases.split(",", 1)))
    persona = LocalClient(a.persona_path) if a.persona_path else http(a.persona_bases)
    m = Models(
        base=persona, commercial=http(a.commercial_bases) if a.commercial_bases else persona, action=LocalClient(a.action_path) if a.action_path else http(a.action_bases),
        **({"embedder": EncoderEmbedder(a.encoder_path)} if a.encoder_path else {}),
    )
    bad = [k for k, ok in m.preflight().items() if not ok]
    if bad:
        raise SystemExit(f"not reachable: {', '.join(bad)}")
    return m


def _nested(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Windowed users of the inputs, after the caps."""
    paths = jsonl.input_list(a.input, [a.input_dir] if a.input_dir else [])
    if not paths:
        raise SystemExit("give --input or --input-dir")
    glob = a.input_glob or (jsonl.WINDOWED_GLOBS[a.dataset] if a.dataset else None)
    rows = jsonl.read_windowed(spark, paths, glob if a.input_dir else None)
    users = rows.select("user_id", "community_id", F.monotonically_increasing_id().alias("first_seq"))
    most = 2 if a.test else a.max_users
    if a.seed is not None and most:
        keep = ranks.sample_users(users, most, a.seed)
    else:
        keep = ranks.cap_users(users, per_community=a.max_users_per_community or None, max_users=most, cap_order=a.cap_order)
    nested = windows.unmap(rows)
    limited = most or a.max_users_per_community
    return cut(nested.join(keep.select("user_id").distinct(), "user_id", "left_semi") if limited else nested)


def _todo(spark: SparkSession, nested: DataFrame, path: str, resume: bool, keys: list[str], **values: str) -> DataFrame:
    """``nested`` without the users that the sink holds already."""
    if not (resume and stores.exists(spark, path)):
        return nested
    done = spark.read.parquet(path)
    for k, v in values.items():
        if k in done.columns:
            done = done.where(F.col(k) == v)
    return stores.open_work(nested, stores.completed(done, keys), keys)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"strandweave-{a.job}").getOrCreate()
    began = time.monotonic()
    if a.job == "windows":
        src = jsonl.split_path(a.input, a.split)
        size = a.window_size if a.split_mode == "contiguous" else a.actions_per_month
        stats = pipelines.prepare_windows(spark, src, jsonl.split_path(a.output, a.split), glob=a.file_glob, size=size, number=a.num_windows, mode=a.split_mode, per_month=a.windows_per_month)
        stats.show(1000, truncate=False)
        return
    if a.job == "samples":
        cache = table(spark, a.tables, "user_profile_cache")
        stats = table(spark, a.tables, "user_stats")
        most = 2 if a.test else a.max_users
        if most:
            stats = ranks.sample_users(stats.where("community_id is not null"), most, a.seed)
        pipelines.sft_files(spark, table(spark, a.tables, "actions"), stats, cache.limit(0) if a.no_real_profile else cache, a.output, communities=a.communities, seed=a.seed)
        return
    models, nested = _models(a), _nested(spark, a)
    stem = jsonl.output_stem(a.output_dir, a.dataset)
    if a.job == "pairs":
        todo = _todo(spark, nested, f"{a.output_dir}/rounds", a.resume, ["user_id"])
        found, log = pipelines.mine_pairs(todo, models, rounds=1 if a.test else a.rounds, n=2 if a.test else a.num_candidates)
        users = nested.groupBy("user_id").agg(F.min("community_id").alias("community_id"))
        found, log = cut(found.join(users, "user_id")), cut(log.join(users, "user_id"))
        sinks.write_details_and_pairs(log, found, a.output_dir, resume=a.resume)
        sinks.write_rows(log, f"{a.output_dir}/rounds", resume=a.resume, by=None)
        sinks.write_summary(reports.run_summary(nested, found, time.monotonic() - began), a.output_dir, stem)
    elif a.job == "chain":
        known = {m.name: m for m in pipelines.METHODS}
        names = [n for n in a.methods.split(",") if n]
        if set(names) - set(known):
            raise SystemExit(f"unknown methods: {sorted(set(names) - set(known))}; known: {', '.join(known)}")
        out = f"{a.output_dir}/rows"
        # methods with the same users to do run side by side; with --resume each has its own
        groups = [(n,) for n in names] if a.resume else [tuple(names)]
        for i, group in enumerate(groups):
            chosen = tuple(known[n] for n in group)
            if a.always_accept_refinement:
                chosen = tuple(pipelines.replace(m, accept="always") for m in chosen)
            if a.no_action_prompt_observed_history:
                chosen = tuple(pipelines.replace(m, history=False) for m in chosen)
            todo = _todo(spark, nested, out, a.resume, ["user_id"], method=group[0])
            got = pipelines.evaluate_chain(todo, chosen, models, steps=a.num_windows - 1, three_windows=not a.no_three_window_evaluation)
            more = a.resume or i > 0
            sinks.write_rows(cut(got.rows), out, resume=more)
            sinks.write_personas(got.personas, a.output_dir, resume=more)
            if got.three is not None:
                sinks.write_rows(cut(got.three), f"{a.output_dir}/three_windows", resume=more)
        rows = spark.read.parquet(out).withColumn("window_idx", F.col("step_index") + 1)
        kept = ranks.trim_tails(reports.without_errors(rows), "q", group=["method"], tail=a.plot_trim_each_tail, sides=a.plot_trim_sides)
        reports.by_method(rows).show(truncate=False)
        reports.by_step(kept).orderBy("method", "step_index").show(1000, truncate=False)
    else:
        out = f"{a.output_dir}/rows"
        names = [v for v in a.variants.split(",") if v]
        unknown = set(names) - {v[0] for v in pipelines.VARIANTS}
        if unknown:
            raise SystemExit(f"unknown variants: {sorted(unknown)}")
        shared = None
        if a.initial_p0 == "shared":
            shared = cut(pipelines.shared_personas(nested, models, a.p0_cache_dir or f"{a.output_dir}/first_personas"))
        for i, group in enumerate([(n,) for n in names] if a.resume else [tuple(names)]):
            todo = _todo(spark, nested, out, a.resume, ["user_id"], profile_variant=group[0])
            rows = cut(pipelines.evaluate_slice(todo, group, models, mode=a.slice_eval_mode, inject_history=not a.no_action_prompt_observed_history, shared_p0=shared))
            sinks.write_rows(rows, out, resume=a.resume or i > 0, by="profile_variant")
        rows = spark.read.parquet(out)
        long = rows.select("community_id", F.col("profile_variant").alias("method"), "error", F.expr("stack(2, 1, W1_Q, 2, W2_Q) as (window_idx, q)"))
        reports.by_community(long).orderBy("community_id", "method", "window_idx").show(1000, truncate=False)


if __name__ == "__main__":
    main()
