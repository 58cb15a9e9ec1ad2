import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import fill_middle as fim
from riskloom.llm.wavelet import WaveletMatrix

SCHEMA = "doc_id long, text string"
PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+",
    "sentence": r"(?:(?![.!?](?=[ \t-\r]|\Z))[^\n])*(?:[.!?](?=[ \t-\r]|\Z)|\n)|[^\n]+",
    "char": r"(?s:.)",
}


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 3000])
def test_ranks_and_places(size):
    rng = np.random.default_rng(size)
    symbols = rng.integers(0, 5, size).astype(np.uint8)
    made = WaveletMatrix(symbols, 3)
    at = np.r_[0, size, rng.integers(0, size + 1, 50)]
    for s in range(6):
        assert made.rank(s, at).tolist() == [(symbols[:k] == s).sum() for k in at]
    places = np.flatnonzero((symbols == 2) | (symbols == 4)) + 1
    k = np.arange(1, len(places) + 2)
    zero = np.zeros(len(k), np.int64)
    assert made.select((2, 4), k, zero, zero + size).tolist() == [*places.tolist(), size]


def brute(doc_id, text, unit="line", rate=100, share=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = re.findall(PATTERNS[unit], text)
    assert "".join(parts) == text
    n = len(parts)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(parts[:i]), "".join(parts[i:j]), "".join(parts[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < share:
        return doc_id, n, "spm", len(a), len(a) + len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(a) + len(b), f"<P>{a}<S>{c}<M>{b}"


ROWS = [
    (1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\nb\n"), (5, "a\nb\n"), (None, "no id\nhere. Is it? Yes!\nend."), (None, "é\n日本 語\n😀"),
    (7, "has <M> in it\nx"), (8, "<P\n>\n<S\n<M"), (9, "\n" * 500), (10, "long line " * 60_000 + "\n" + "x\n" * 100_000), (11, "\r\n\x0b a.b .  c\x85 \n\n"),
    *((k, "".join(f"line {j} of {k}. more\n" for j in range(k % 17))) for k in range(20, 90)),
]


@pytest.mark.parametrize("unit", sorted(PATTERNS))
@pytest.mark.parametrize("rate", [100, 40])
def test_against_brute_force(spark, unit, rate):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", form string")
    made = fim.restore(fim.fill_in_middle(docs, unit, rate=rate)).collect()
    assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted((brute(*r, unit, rate) for r in ROWS), key=repr)
    assert sorted(r.restored for r in made) == sorted(t or "" for _, t in ROWS)
    assert all(fim.restored(r.output, r.form) == r.restored for r in made)


def test_empty_table(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], SCHEMA), "page")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>ab\n", max_size=30).filter(lambda t: not any(m in t for m in ("<P>", "<S>", "<M>"))), st.integers(0, 30), st.integers(0, 30))
def test_round_trip(text, i, j):
    i, j = sorted((min(i, len(text)), min(j, len(text))))
    for form in ("psm", "spm"):
        assert fim.restored(fim.transformed(text, form, i, j), form) == text
