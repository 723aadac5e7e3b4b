import base64

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandweave.llm.bpe_ids import PrefixEncoder, encode_corpus
from strandweave.sources import table


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def test_documents(spark, data, reference):
    docs = table(spark, data, "documents")
    want = {r["doc_id"]: reference(r["text"]) if r["text"] else [] for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in encode_corpus(docs, "doc_id", "text").collect()} == want


def test_cases(spark, reference):
    texts = [None, "", " ", "<|endoftext|> and more", "a" * 5000, "どうして" * 2000, "😂‍👩\U0010ffff", "\r\n\t \n", "é" * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "", 1)], "doc_id bigint, text string, ids int")
    got = encode_corpus(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: r["ids"] for r in got} == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, encoder, text):
    import regex

    assert [i for p in regex.findall(P.PATTERN, text) for i in encoder.encode(p.encode())] == reference(text)
