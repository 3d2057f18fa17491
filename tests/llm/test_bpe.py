import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, documents
from veilwork.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t", "<|endoftext|> a <|startoftext|>x", "<|endoftext", "ΑΣ ΣΑΣ İI ß", "a\x1cb\x1d c\x85d", "é x́",
    " a　b", "日本語 12345 ½", "a" * 5000, "it's we'll I'd x'y ''s", "😀😀👍🏽", "...!!?? .", "x" * 70 + ",",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def test_documents_equal_the_library(spark, sf_dir, library):
    from veilwork.llm.queries import queries

    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[row.doc_id] = (len(ids), digest(" ".join(map(str, ids))), digest(text))
    found = queries()["op1_bpe"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == expected


def test_odd_texts_and_round_trip(spark, library):
    docs = clashing(documents(spark, [*enumerate(ODD), (0, None), (None, "abc")]))
    tokenizer = bpe.Tokenizer(spark, PATH)
    once = tokenizer.encode(docs, "text", decoded="again")
    twice = tokenizer.decode(once, text="later")
    for row in twice.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.again == row.later == library.decode(ids, skip_special_tokens=False)
    assert twice.count() == len(ODD) + 2
    assert tokenizer.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == ""
    assert tokenizer.encode(docs.limit(0), "text").count() == 0


def test_random_words_equal_the_library(own, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshrdlu"[: rng.randint(1, 12)]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.ids(t).tolist() for t in texts] == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=60))
def test_any_text_equals_the_library(text):
    library, own = _both()
    assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


_made = []


def _both():
    if not _made:
        with open(PATH, encoding="utf-8") as file:
            _made.extend([Tokenizer.from_file(PATH), bpe.Encoder(file.read())])
    return _made


def test_a_vocabulary_out_of_order_is_refused():
    source = (
        '{"model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "b": 1, "abb": 2, "ab": 3},'
        ' "merges": ["ab b", "a b"]}, "added_tokens": []}'
    )
    with pytest.raises(ValueError, match="out of order"):
        bpe.Vocabulary(source)


def test_a_column_of_the_same_name_is_replaced(spark):
    docs = documents(spark, [(1, "the cat")]).withColumn("ids", F.lit("old"))
    assert bpe.Tokenizer(spark, PATH).encode(docs, "text").first().ids == [518, 2368]
