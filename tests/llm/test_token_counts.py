import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vexel.llm.token_counts import count_tokens, counter

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def n(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_character(library):
    mine = counter(PATH)
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"Î{c}1{c}{c} th{c}" for c in chars]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    odd = [hex(ord(c)) for c, t, w in zip(chars, texts, want) if mine.count(t) != w]
    assert not odd, (len(odd), odd[:20])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abeinorst'<|>endoftext ΣσςİÉß́̀\n\t\x1c9٣木、!?…")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(text):
    assert counter(PATH).count(text) == n(Tokenizer.from_file(PATH) if not hasattr(test_random_texts, "t") else test_random_texts.t, text)


test_random_texts.t = Tokenizer.from_file(PATH)


def test_special_strings_and_long_words(library):
    for t in ["<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "x" * 5000, "ab" * 3000 + "!" * 500, "don't we'll I'M", "<|endoftext|><|endoftext|> "]:
        assert counter(PATH).count(t) == n(library, t), t


def test_rows(spark, library):
    rows = [(1, "Hello World", 9, "x"), (1, "Hello World", 9, "x"), (2, None, 1, None), (3, "", 2, "y"), (None, "é" * 30, 3, "z"), (4, "word " * 3000, 4, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, k string")
    got = sorted(map(tuple, count_tokens(df, PATH).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), n(library, t or ""), n(library, t or "") > 2048) for d, t, *_ in rows), key=str)
    assert got == want
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_sample(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    assert got == {r.doc_id: n(library, r.text or "") for r in docs.collect()}
