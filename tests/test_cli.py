import json

import pytest

from strandweave import cli


@pytest.fixture(scope="module")
def windowed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    raw = root / "raw"
    raw.mkdir()
    for c in (1, 2):
        with (raw / f"community_{c}.jsonl").open("w") as out:
            for u in range(3):
                acts = [{"action_type": ("post", "reply", "like", "repost")[(i + u) % 4], "action_text": f"text {i} of {u}", "target": f"target {i}", "date": f"202401{i + 1:02d}1200"} for i in range(16)]
                out.write(json.dumps({"community_id": c, "user_id": 10 * c + u, "actions": acts}) + "\n")
    cli.main(["windows", "--input", str(raw), "--output", str(root / "w"), "--window-size", "4", "--num-windows", "4"], spark)
    return root


def test_pairs_and_resume(spark, windowed):
    args = ["pairs", "--input", str(windowed / "w"), "--output-dir", str(windowed / "pairs"), "--rounds", "1", "--num-candidates", "3"]
    cli.main(args, spark)
    n = spark.read.parquet(str(windowed / "pairs" / "rounds")).count()
    assert n == 6
    cli.main([*args, "--resume"], spark)
    assert spark.read.parquet(str(windowed / "pairs" / "rounds")).count() == n
    assert spark.read.json(str(windowed / "pairs" / "details")).count() == n
    summary = spark.read.json(str(windowed / "pairs" / "summary_pairs")).first()
    assert summary["total_users"] == 6 and summary["elapsed_seconds"] > 0


def test_chain_and_slice(spark, windowed):
    cli.main(["chain", "--input", str(windowed / "w"), "--output-dir", str(windowed / "chain"), "--methods", "static_s0,online", "--num-windows", "3", "--max-users-per-community", "1"], spark)
    rows = spark.read.parquet(str(windowed / "chain" / "rows")).collect()
    assert {r["method"] for r in rows} == {"static_s0", "online"} and len({r["user_id"] for r in rows}) == 2
    assert {r["method"] for r in spark.read.json(str(windowed / "chain" / "personas")).collect()} == {"static_s0", "online"}
    assert spark.read.parquet(str(windowed / "chain" / "three_windows")).count() == 2 * 6
    cli.main(["slice", "--input", str(windowed / "w"), "--output-dir", str(windowed / "slice"), "--variants", "incremental_persona", "--initial-p0", "shared", "--slice-eval-mode", "w2_w3"], spark)
    assert spark.read.parquet(str(windowed / "slice" / "rows")).count() == 6
    with pytest.raises(SystemExit):
        cli.main(["chain", "--input", str(windowed / "w"), "--output-dir", "x", "--methods", "nothing"], spark)


def test_samples(spark, data, tmp_path):
    cli.main(["samples", "--tables", data, "--output", str(tmp_path / "s"), "--communities", "1,2"], spark)
    got = spark.read.json(str(tmp_path / "s"))
    assert {"Instruction", "input", "output", "user_id", "community"} == set(got.columns) and got.count() > 0
