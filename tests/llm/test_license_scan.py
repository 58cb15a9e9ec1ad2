import random
import re

import pyarrow as pa
import pytest

from riskloom.llm.common import text_bytes
from riskloom.llm.license_scan import TEMPLATES, Scanner, license_scan, op10_license_scan, patience
from riskloom.llm.words import words_of

SCHEMA = "doc_id long, text string"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def slow_patience(a, b):
    """The same rule, written with plain recursion and all ascending runs of anchors by dynamic programming."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + slow_patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + slow_patience(a[:-1], b[:-1])
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not anchors:
        return 0
    runs = []
    for k, (_, j) in enumerate(anchors):
        runs.append(max([r for r, (_, y) in zip(runs, anchors) if y < j], key=len, default=[]) + [anchors[k]])
    best = max(runs, key=len)
    edges = [(-1, -1), *best, (len(a), len(b))]
    return len(best) + sum(slow_patience(a[x + 1 : u], b[y + 1 : v]) for (x, y), (u, v) in zip(edges, edges[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    rng = random.Random(seed)
    a = [rng.randrange(rng.choice([3, 12, 60])) for _ in range(rng.randrange(1, 40))]
    b = [x if rng.random() > 0.2 else rng.randrange(60) for x in a]
    del b[: rng.randrange(3)]
    if rng.random() < 0.5:
        b = b[len(b) // 2 :] + b[: len(b) // 2]
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    assert len(pairs) <= common(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == slow_patience(a, b)
    assert len(patience(a, a)) == len(a) and patience(a, []) == [] == patience([], b)


def test_edge_rows(spark):
    filler = "\n".join(f"line {k} of nothing special" for k in range(5000))
    mit = TEMPLATES["MIT-text"].replace("\n", " ")
    wrapped = "\n".join(" ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9))
    changed = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    rows = [
        (1, None), (2, ""), (3, "All rights reserved."), (None, "Released under the MIT License."),
        (4, filler + "\n// " + wrapped.replace("\n", "\n// ") + "\n" + filler), (5, changed), (6, filler),
        (7, "Licensed under CC BY-NC 4.0.\n" * 5), (7, "Licensed under CC BY-NC 4.0.\n" * 5), (8, "All of the rights are reserved, license or not"),
        (9, "x Licensed under the apache license, version 2.0. y"),
    ]
    got = license_scan(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", license int")).collect()
    found = sorted(((str(r.doc_id), r.license, round(r.coverage, 2), r.places) for r in got))
    assert found == [
        ("3", "proprietary", 1.0, 1), ("4", "MIT-text", 1.0, 1), ("5", "MIT-text", 0.91, 1), ("7", "CC-BY-NC-4.0", 1.0, 5),
        ("7", "CC-BY-NC-4.0", 1.0, 5), ("9", "Apache-2.0", 1.0, 1), ("None", "MIT", 1.0, 1),
    ]
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []
    assert license_scan(spark.createDataFrame(rows, SCHEMA), {"empty": "!"}).collect() == []


def test_query_against_plain_search(spark, small):
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
    wanted = {
        (r.doc_id, name)
        for r in spark.read.parquet(f"{small}/documents.parquet").collect()
        for name, text in TEMPLATES.items()
        if any(f" {plain(text)} " in f" {plain(line)} " for line in r.text.split("\n"))
    }
    got = {(r.doc_id, r.license): r.coverage for r in op10_license_scan(spark, small).collect()}
    assert wanted and wanted == {k for k, c in got.items() if c == 1}
    assert set(got) == wanted


def scanned(text):
    words = words_of(*text_bytes(pa.array([text])))
    scanner = Scanner(TEMPLATES)
    return {scanner.names[k]: v for k, v in scanner.scan(text.encode(), words.hashes, words.starts).items()}


def test_copies_in_one_region():
    line = "x Released under the MIT License. y Released under the MIT License. z"
    assert scanned(line) == {"MIT": (1.0, 2)}
    words = TEMPLATES["MIT-text"].split()
    wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    owner = "Copyright notice of the authors or copyright holders\n"
    assert scanned(owner + wrapped + "\n" + owner + wrapped + "\n" + TEMPLATES["BSD-text"]) == {"MIT-text": (1.0, 2), "BSD-text": (1.0, 1)}
    for copies in (2, 3, 7):
        for name in ("MIT-text", "GPL-header", "ISC-text", "CC-BY-4.0", "Apache-2.0-header"):
            assert scanned((TEMPLATES[name] + " ") * copies)[name] == (1.0, copies), name


def test_short_notice_in_a_long_line():
    rng = random.Random(3)
    others = ["released", "under", "the", "mit", "license", *(f"w{k}" for k in range(40))]
    noise = lambda n: " ".join(x for k in range(n) for x in (rng.choice(others), f"v{k % 50}", f"u{k % 70}"))
    assert scanned(f"{noise(3000)} Released under the MIT License. {noise(3000)}") == {"MIT": (1.0, 1)}
