import random
from collections import Counter, defaultdict

import pytest

from strandweave.operators.entity_features import NULL_TYPE, entity_features, type_vocabulary
from strandweave.operators.tree_aggregate import key_positions, key_totals


def test_features_match_brute_force(spark):
    rng = random.Random(3)
    types = [f"t{i:03d}" for i in range(40)] + [None, ""]
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 700), rng.choice(types), rng.choice([None, rng.randrange(1000, 9000)])) for _ in range(6000)]
    rows += [(None, "t001", 5), (9999, "t001", None)]
    got = entity_features(spark.createDataFrame(rows, "u bigint, k string, m bigint"), entity="u", type_="k", moment="m").collect()
    order = sorted({NULL_TYPE if k is None else k for _, k, _ in rows})
    n, last = Counter(), {}
    for u, k, m in rows:
        k = NULL_TYPE if k is None else k
        n[u, k] += 1
        if m is not None:
            last[u, k] = max(last.get((u, k), -1), m)
    as_of = max(last.values())
    by = defaultdict(list)
    for r in got:
        by[r["u"]].append(r)
    assert set(by) == {u for u, _, _ in rows if u is not None} and all(len(v) == 1 for v in by.values())
    for u, (r,) in by.items():
        assert r["n"] == [n[u, k] for k in order]
        assert r["since"] == [as_of - last[u, k] if (u, k) in last else None for k in order]
        assert r["n_total"] == sum(r["n"]) and r["n_types"] == sum(x > 0 for x in r["n"])
        known = [last[u, k] for k in order if (u, k) in last]
        assert r["last_min"] == (max(known) if known else None)


def test_features_empty_and_bound(spark):
    none = spark.createDataFrame([], "u bigint, k string, m bigint")
    assert entity_features(none, entity="u", type_="k", moment="m").count() == 0
    many = spark.createDataFrame([(f"t{i}",) for i in range(30)], "type string")
    with pytest.raises(ValueError):
        type_vocabulary(many, max_types=20)


@pytest.mark.parametrize("chunk,fan_in", [(64, 2), (100, 3), (7, 16), (1 << 16, 16)])
def test_tree_matches_brute_force(spark, chunk, fan_in):
    rng = random.Random(chunk)
    seqs = rng.sample(range(10_000), 3000)
    rows = [(s, 1 if rng.random() < 0.5 else rng.randrange(300), rng.choice([None, 1, 1, 1, 2, 3]), "x") for s in seqs]
    df = spark.createDataFrame(rows, "ingest_seq bigint, user_id bigint, community_id bigint, node string")
    seen: dict = {"user_id": Counter(), "community_id": Counter()}
    want = {}
    for s, u, c, _ in sorted(rows):
        want[s] = (seen["user_id"][u], None if c is None else seen["community_id"][c])
        seen["user_id"][u] += 1
        seen["community_id"][c] += 1
    got = {r["ingest_seq"]: r for r in key_positions(df, ["user_id", "community_id"], chunk=chunk, fan_in=fan_in).collect()}
    assert {s: (r["user_id_pos"], r["community_id_pos"]) for s, r in got.items()} == want
    assert all(r["user_id_n"] == seen["user_id"][r["user_id"]] for r in got.values())
    totals = {(r["kind"], r["key"]): (r["n"], r["first_seq"], r["last_seq"]) for r in key_totals(df, ["user_id", "community_id"], chunk=chunk, fan_in=fan_in).collect()}
    for (kind, key), (n, first, last) in totals.items():
        mine = [r[0] for r in rows if r[1 if kind == "user_id" else 2] == key]
        assert (n, first, last) == (len(mine), min(mine), max(mine))
    assert len(totals) == len(seen["user_id"]) + 3


def test_features_of_text_ids_and_hot_entities(spark, monkeypatch):
    from strandweave.operators import entity_features as ef

    monkeypatch.setattr(ef, "HELD", 50)
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", f"e{rng.randrange(2000)}"]), f"t{rng.randrange(9)}", rng.randrange(100)) for _ in range(9000)]
    df = spark.createDataFrame(rows, "u string, k string, m bigint").repartition(40)
    got = {r["u"]: r for r in ef.entity_features(df, entity="u", type_="k", moment="m").collect()}
    n = Counter((u, k) for u, k, _ in rows)
    assert set(got) == {u for u, _, _ in rows}
    assert all(r["n"] == [n[u, f"t{i}"] for i in range(9)] for u, r in got.items())
    places = [tuple(r) for r in ef.vocabulary_table(df, "k").orderBy("place").collect()]
    assert places == [(i, f"t{i}") for i in range(9)]


@pytest.mark.parametrize("orders", ["null", "repeated", "sparse"])
def test_tree_with_odd_orders(spark, orders):
    """Rows with null, repeated or far-apart orders all count, and no chunk has more rows than asked for."""
    n = 500
    at = {"null": lambda i: None if i % 3 else i, "repeated": lambda i: i // 250, "sparse": lambda i: i * 10**15}[orders]
    rows = [(at(i), i % 2 if i % 7 else 9, None if i % 11 == 0 else 1) for i in range(n)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, user_id bigint, community_id bigint").repartition(5)
    totals = {(r["kind"], r["key"]): (r["n"], r["first_seq"]) for r in key_totals(df, ["user_id", "community_id"], chunk=16, fan_in=4).collect()}
    for kind, col in (("user_id", 1), ("community_id", 2)):
        for key, count in Counter(r[col] for r in rows if r[col] is not None).items():
            known = [r[0] for r in rows if r[col] == key and r[0] is not None]
            assert totals[kind, key] == (count, min(known))
    got = key_positions(df, ["user_id", "community_id"], chunk=16, fan_in=4).collect()
    assert len(got) == n
    low = lambda x: -1 if x is None else x
    for key in {r[1] for r in rows}:
        mine = sorted((r["user_id_pos"], low(r["ingest_seq"])) for r in got if r["user_id"] == key)
        assert [p for p, _ in mine] == list(range(len(mine))) and [o for _, o in mine] == sorted(o for _, o in mine)
        assert all(r["user_id_n"] == len(mine) for r in got if r["user_id"] == key)


def test_tree_empty(spark):
    df = spark.createDataFrame([], "ingest_seq bigint, user_id bigint, community_id bigint")
    assert key_totals(df, ["user_id", "community_id"]).count() == 0
    assert key_positions(df, ["user_id", "community_id"]).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, None, 5)], "ingest_seq bigint, user_id bigint, community_id bigint")
    assert sorted((r["ingest_seq"], r["user_id_pos"], r["community_id_pos"]) for r in key_positions(nulls, ["user_id", "community_id"]).collect()) == [(1, None, None), (2, None, 0)]
