import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import pretokens
from riskloom.llm.common import text_bytes, tokenizer_path
from riskloom.llm.token_counts import VOCABULARY, TokenCounter, op7_token_counts, token_counts

LIBRARY = Tokenizer.from_file(tokenizer_path(VOCABULARY))
COUNTER = TokenCounter(tokenizer_path(VOCABULARY))
PIECES = ["a", "aaa", "The", " ", "  ", "\n", "\t\r", "'s", "'re", "'", "it's", "'LL", "12", "!?", "é", "É", "ß", "×", "÷", "é",
          "日本", "Привет", "Σς", "İ", " ", " ", "\x1c", "\x00", "٣", "½", "<|endoftext|>", "<|startoftext|>", "<|", "😀", "İ", "ǅ", "fi", "Å"]
TEXT = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=12).map("".join)


def library_count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def ours(texts):
    return COUNTER.count(*text_bytes(pa.array(texts, pa.string()))).tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_counts_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ours(texts) == [library_count(t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(TEXT.map(lambda t: t.encode("utf-8", "ignore").decode()))
def test_spaced_spans_equal_the_pattern(text):
    spans = pretokens.pretokenize(*text_bytes(pa.array([text, text])), pretokens.SPACED)
    got = [spans.data[a:b].decode() for a, b in zip(spans.starts, spans.ends)]
    wanted = []
    for part in regex.split(r"(<\|endoftext\|>)", text):
        wanted += [part] if part == "<|endoftext|>" else regex.findall(pretokens.SPACED_PATTERN, part)
    assert got == wanted * 2
    assert spans.first.tolist() == [0, len(wanted), 2 * len(wanted)]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "word " * 20_000, "\n" * 3000, "x" + " y'll" * 700_000])
def test_long_texts(text):
    assert ours([text, "a", text]) == [library_count(text), library_count("a"), library_count(text)]


def swapped(size, letters):
    """Letters in the order of the parity of ones in binary: sums modulo powers of two meet for such words."""
    return "".join(letters[k.bit_count() % 2] for k in range(size))


@pytest.mark.parametrize("limit", [pretokens.LONG_SPAN, 1 << 30])
@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_with_equal_sums(size, limit, monkeypatch):
    """With the long hash and without it, when only the bytes tell them apart."""
    from riskloom.llm.packing import Encoder
    from riskloom.llm.packing import VOCABULARY as SPACED_VOCABULARY

    monkeypatch.setattr(pretokens, "LONG_SPAN", limit)
    texts = [swapped(size, pair) for pair in ("ex", "xe", "th", "ht")]
    counter = TokenCounter(tokenizer_path(VOCABULARY))
    assert counter.count(*text_bytes(pa.array(texts))).tolist() == [library_count(t) for t in texts]
    path = tokenizer_path(SPACED_VOCABULARY)
    ids, at = Encoder(path).encode(*text_bytes(pa.array(texts)))
    wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted


def test_memo_may_be_dropped():
    small = TokenCounter(tokenizer_path(VOCABULARY), memo_words=3)
    texts = ["one two three four five", "one six", "seven one"]
    for text in texts * 2:
        assert small.count(*text_bytes(pa.array([text]))).tolist() == [library_count(text)]


def test_hash_index():
    rng = np.random.default_rng(1)
    index, keys = pretokens.HashIndex(3), np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for part in np.array_split(keys, 7):
        index.add(part, np.searchsorted(keys, part))
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(rng.integers(0, 2**63, 500).astype(np.uint64)) == -1).all()


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "it's", None), (3, "it's", None), (4, "x " * 3000, 1)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), tokenizer_path(VOCABULARY)).collect()
    assert [tuple(r) for r in got] == [
        (i, len((t or "").encode()), library_count(t), library_count(t) > 2048) for i, t, _ in rows
    ]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(VOCABULARY)).collect() == []


def test_query_against_the_library(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op7_token_counts(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {
        i: (len(t.encode()), library_count(t)) for i, t in texts.items()
    }
    assert len(got) == len(texts)
