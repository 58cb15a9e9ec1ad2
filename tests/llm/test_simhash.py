import random

import numpy as np
import pytest
import xxhash

from riskloom.llm.components import components
from riskloom.llm.gray_index import close_pairs, gray_rank, link_groups, smallest_linked
from riskloom.llm.simhash import close_links, fingerprint, one_per_group, op5_simhash_dedup, simhash_groups

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """(doc, fingerprint) to the smallest doc reachable, by comparing all distinct fingerprints."""
    fps = np.array(sorted({f for _, f in pairs}), np.uint64)
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    at = {int(f): find(i) for i, f in enumerate(fps)}
    names = {}
    for d, f in pairs:
        names.setdefault(at[f], []).append(d)
    return {d: min(names[at[f]]) for d, f in pairs}


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "a b c d a b c d " * 50, "É é x y \x1cz Ü " * 9])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_very_long_text():
    text = " ".join(str(i % 9000) for i in range(100_000))
    assert fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("n,bits", [(2, 64), (50, 8), (700, 12), (3000, 64)])
def test_tree_finds_all_pairs_once(n, bits):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 2**bits - 1, n, dtype=np.uint64))
    values = values[np.argsort(gray_rank(values))]
    found = [(int(a), int(b)) for i, j in close_pairs(values, 2) for a, b in zip(i, j)]
    wanted = {
        (i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2) + i + 1
    }
    assert len(found) == len(set(found)) and set(found) == wanted


def test_gray_rank_order():
    assert [int(x) for x in gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))] == list(range(8))


@pytest.mark.parametrize("limit", [2, 10_000])
def test_links_span_all_close_pairs(spark, limit):
    rng = random.Random(limit)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.add(seed)
            seed ^= 1 << rng.randrange(64)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in sorted(fps)]
    links = close_links(spark.createDataFrame(signed, "fp long"), node_limit=limit)
    roots = {r.node: r.root for r in components(links).collect()}
    expected = brute_components([(s, f) for (s,), f in zip(signed, sorted(fps))])
    same = {}
    for (s,) in signed:
        same.setdefault(expected[s], set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)]
    links += [(5000, x) for x in range(5001, 5100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for p in links for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \t"), (None, base), (5, base), (9, base + " end"), (7, "other text here now"), (7, "other text here now")]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [g[1] for g in got if g[2] == 1] == ["0" * 16] * 3
    pairs = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    expected = brute_components(pairs)
    assert all(c == expected[int(d)] for d, _, c in got if d != "None")
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = one_per_group(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert {r.doc_id for r in kept.collect()} == set(expected.values())


def test_query_against_all_pairs(spark, small):
    got = op5_simhash_dedup(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pairs = [(d, brute_fingerprint(t)) for d, t in texts.items()]
    expected = brute_components(pairs)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (d, f"{f:016x}", expected[d]) for d, f in pairs
    )


def test_links_over_several_calls():
    labels = smallest_linked(np.array([0, 1, 2, 2]), np.array([0, 1]), np.array([2, 3]))
    assert labels.tolist() == [0, 0, 0, 0]
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 60))
        links = rng.integers(0, n, (int(rng.integers(1, 80)), 2))
        labels, truth = np.arange(n), list(range(n))
        for part in np.array_split(links, 5):
            labels = smallest_linked(labels, part[:, 0], part[:, 1])
        for a, b in links.tolist():
            low, high = sorted((truth[a], truth[b]))
            truth = [low if x == high else x for x in truth]
        assert labels.tolist() == truth


def test_four_fingerprints_of_one_node():
    values = np.array([sum(1 << b for b in bits) for bits in ((2, 3, 20), (25,), (3, 20, 31), (31,))], np.uint64)
    a, b = link_groups(np.zeros(4, np.int64), values, 2)
    assert set(a.tolist()) | set(b.tolist()) == set(values.tolist()) and len(set(b.tolist())) == 1


def test_one_of_each_null_and_repeated_ids(spark):
    far = [" ".join(f"{name}{k}" for k in range(80)) for name in "abcd"]
    rows = [(None, far[0]), (None, far[1]), (1, far[1]), (7, far[2]), (7, far[3]), (3, far[3])]
    kept = one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, far[0]), (1, far[1]), (7, far[2]), (3, far[3])}
