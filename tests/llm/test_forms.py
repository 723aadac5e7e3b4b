import unicodedata

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import charforms
from strandweave.llm.same_form import consistent_form, find_copies
from strandweave.sources import table

CHARS = st.characters(codec="utf-8", exclude_characters="\0") | st.sampled_from("аеорсухіﬁﬃⅢ㎏Ａｂ１ｶﾞ　​­́̈éЁ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(CHARS, max_size=30), min_size=1, max_size=20))
def test_sql_fold_equals_python_and_is_stable(texts):
    con = duckdb.connect()
    charforms.duckdb_setup(con)
    src = pa.table({"i": pa.array(range(len(texts)), pa.int64()), "s": pa.array(texts)})
    con.register("src", src)
    got = dict(con.execute(f"SELECT i, sk FROM ({charforms.fold_sql('src')})").fetchall())
    for i, t in enumerate(texts):
        assert got[i] == unicodedata.normalize("NFC", charforms.skeleton(t))


def test_reads_the_same_or_not():
    same = [("five", "ﬁve"), ("office", "oﬃce"), ("Ⅲ", "III"), ("12 kg", "12 ㎏"), ("scope", "ѕсоре"), ("a b", "a b"), ("día", "día"), ("hello", "he​llo"), ("ガ", "ｶﾞ"), ("ABC", "ＡＢＣ"), ("хор", "xop"), ("ë", "ё")]
    other = [("resume", "résumé"), ("Us", "us"), ("x2", "x²"), ("o", "º"), ("a!", "a"), ("l", "I"), ("0", "O")]
    assert all(charforms.skeleton(a) == charforms.skeleton(b) for a, b in same)
    assert all(charforms.skeleton(a) != charforms.skeleton(b) for a, b in other)


def test_copies_equal_brute_force(spark, data):
    rows, posts = table(spark, data, "actions"), table(spark, data, "pinned_posts")
    known: dict = {}
    for p in posts.collect():
        known.setdefault(unicodedata.normalize("NFC", charforms.skeleton(p["post_text"])), []).append((p["item_id"], p["post_text"]))
    want = set()
    for r in rows.select("ingest_seq", "action_text", "target").collect():
        for f in ("action_text", "target"):
            if r[f] is not None:
                for item, text in known.get(unicodedata.normalize("NFC", charforms.skeleton(r[f])), []):
                    if text != r[f]:
                        want.add((r["ingest_seq"], f, item))
    got = [tuple(r) for r in find_copies(rows, "ingest_seq", ["action_text", "target"], posts).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_form_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "​", "x"), (4, "Плaн нa", "x"), (5, "a" * 200_000 + "ﬁ", "x"), (4, "Плaн нa", "x")], "ingest_seq bigint, t string, s string")
    got = consistent_form(df, ["t"]).collect()
    assert [r["t_form"] for r in got[:4]] == [None, "", "", "План на"] and got[4]["t_form"].endswith("afi") and got[5]["t_form"] == "План на"
    assert consistent_form(df.limit(0), ["t"]).count() == 0
    assert consistent_form(consistent_form(df, ["t"]), ["t"]).columns == ["ingest_seq", "t", "s", "t_form"]
    assert find_copies(df, "ingest_seq", ["t"], spark.createDataFrame([], "item_id bigint, post_text string")).count() == 0


def test_many_posts_are_joined(spark):
    """Posts beyond the bounds give the same rows by a join on the skeleton."""
    posts = spark.createDataFrame([(1, "Café at noon"), (2, "plain post"), (3, None), (4, "Café at noon")], "item_id bigint, post_text string")
    rows = spark.createDataFrame([(1, "Cafе́ at noon", "plain post"), (2, "ｐlain post", None), (3, "", "Café at noon"), (3, "", "Café at noon"), (4, "ᏟᎪFÉ", "CAFÉ")], "ingest_seq bigint, action_text string, target string")
    few = sorted(tuple(r) for r in find_copies(rows, "ingest_seq", ["action_text", "target"], posts).collect())
    for bound in ({"max_posts": 1}, {"max_chars": 3}):
        assert sorted(tuple(r) for r in find_copies(rows, "ingest_seq", ["action_text", "target"], posts, **bound).collect()) == few
    assert (2, "action_text", 2) in few and few.count((3, "target", 1)) == 2
    assert charforms.skeleton("ᏟᎪFÉ") == charforms.skeleton("CAFÉ") and charforms.skeleton("ꓓꓳꓖ") == "DOG"
