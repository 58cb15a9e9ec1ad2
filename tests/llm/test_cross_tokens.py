import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import cross_tokens as ct
from riskloom.llm.common import text_bytes, tokenizer_path
from riskloom.llm.fragments import EMPTY, KEY_BITS, START, Stream, compose, composed, fragment

PATHS = tokenizer_path(ct.VOCABULARY_A), tokenizer_path(ct.VOCABULARY_B)
SCHEMA = "doc_id long, text string"
PAIR = ct.Pair(*PATHS)


def tokens(text):
    """Ids and byte ends of both libraries for the whole text, or None."""
    if not text:
        return None
    a = PAIR.a.encode(" " + text, add_special_tokens=False).ids
    b = PAIR.b.encode(text)
    if not PAIR.gives_back((" " + text).encode(), a, b):
        return None
    return a, b, np.cumsum([len(PAIR.bytes_a[k]) for k in a]).tolist(), np.cumsum([len(PAIR.bytes_b[k]) for k in b]).tolist()


def brute_groups(text):
    made = tokens(text)
    if made is None:
        return []
    a, b, ends_a, ends_b = made
    groups, one, other, j = [], [], [], 0
    for k, end in zip(a, ends_a):
        one.append(k)
        while j < len(b) and ends_b[j] <= end:
            other.append(b[j])
            j += 1
        if j and ends_b[j - 1] == end:
            groups.append((one, other))
            one, other = [], []
    assert not one and not other
    return groups


def brute(rows):
    docs = [(d, brute_groups(t)) for d, t in rows]
    links = [Counter((a, b) for one, other in groups for a in one for b in other) for _, groups in docs]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (d, groups), own in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
            sum(m for (a, b), m in own.items() if count[a, b] == best[a]), sum(m * count[p] for p, m in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def ours(df):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def streams(rng, size):
    def ends():
        return np.unique(np.r_[rng.integers(1, size + 1, rng.integers(0, size)), size])

    a, b = ends(), ends()
    return Stream(rng.integers(0, 9, len(a)), a), Stream(rng.integers(0, 9, len(b)), b)


def cut(stream, low, high):
    inside = (stream.ends > low) & (stream.ends <= high)
    return Stream(stream.ids[inside], stream.ends[inside])


def same(x, y):
    return all(np.array_equal(p, q) if isinstance(p, np.ndarray) else p == q for p, q in zip(x, y))


@pytest.mark.parametrize("seed", range(60))
def test_fragments_are_a_monoid(seed):
    """Any byte ranges, put together in any order, give the fragment of the whole."""
    rng = np.random.default_rng(seed)
    a, b = streams(rng, 40)
    borders = np.unique(np.r_[0, rng.integers(0, 41, rng.integers(0, 9)), 40])
    parts = [fragment(cut(a, x, y), cut(b, x, y)) for x, y in zip(borders[:-1], borders[1:])]
    whole = fragment(a, b)
    assert same(composed(parts), whole) and same(compose(EMPTY, whole), whole) and same(compose(whole, EMPTY), whole)
    while len(parts) > 1:
        k = int(rng.integers(0, len(parts) - 1))
        parts[k : k + 2] = [compose(parts[k], parts[k + 1])]
    assert same(parts[0], whole)
    finished = compose(START, whole)
    assert finished.links == finished.times.sum() and not len(finished.tail_a) and not len(finished.tail_b)


PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "it's", "12", "!?", "é", "日本", "日", "Привет", "▁", "　", "\xa0", " ", "\x85", "<s>", "<|endoftext|>", "<0x0A>", "\x00", "😀", "\r\n", "ﬁ", "ǅ", "\x1c", "xq", "_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=14).map("".join), max_size=4))
def test_stretches_equal_the_libraries(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for got, text in zip(ALIGNER.rows(*text_bytes(pa.array(texts, pa.string()))), texts):
        groups = brute_groups(text)
        wanted = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert (got[4] or b"").decode() == wanted
        own = Counter((a << KEY_BITS) | b for one, other in groups for a in one for b in other)
        assert dict(zip(got[5].tolist(), got[6].tolist())) == own and got[3] == sum(own.values())


ALIGNER = ct.Aligner(*PATHS)


def test_words_with_one_hash(monkeypatch):
    """Only the bytes tell words apart when all hashes are equal."""
    monkeypatch.setattr(ct, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two three", "two one", "four"]
    for got, text in zip(ct.Aligner(*PATHS).rows(*text_bytes(pa.array(texts))), texts):
        assert got[2] == len(brute_groups(text))


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 9))) for _ in range(150)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, line(rng.randint(0, 60)) + rng.choice(["", "\n", " ", "  x", "▁"])) for k in range(60)]
    rows += [(None, None), (None, line(9)), (7, ""), (7, " "), (8, line(4000)), (8, rows[3][1]), (9, "日本語" * 3000), (10, "xq" * 12_000), (11, line(3000) + " ▁ " + line(10))]
    return rows + [(12, rows[64][1])] * 3


@pytest.mark.parametrize("hot_pairs", [1 << 18, 40, 0])
@pytest.mark.parametrize("long_bytes", [1 << 16, 500])
def test_against_brute_force(spark, hot_pairs, long_bytes):
    """With 300 bytes a part, the longest texts are put together in three levels."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_a int")
    assert ours(ct.cross_tokens(docs, *PATHS, long_bytes, 300, hot_pairs)) == brute(rows)


def test_empty_table(spark):
    assert ours(ct.cross_tokens(spark.createDataFrame([], SCHEMA), *PATHS)) == []


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert ours(ct.op11_cross_tokens(spark, small)) == brute(rows)
