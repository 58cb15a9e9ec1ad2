import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.chat_format import chosen_paths, format_trees, format_turns, linear_replies, read_back, read_turns, unescaped

PIECES = st.lists(st.one_of(st.sampled_from(["\\", "###", "#", "</turn>", "<", "/turn>", "### assistant: ", ":", "\n", "ok"]), st.text(max_size=3)))
TEXT = PIECES.map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    formatted, spans = format_turns(turns)
    assert read_turns(formatted) == turns
    assert [unescaped(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


SHAPE = "tree long, node long, parent long, role string, text string, score double"


def brute_paths(rows, branches):
    """All root-to-leaf paths by walking up, ranked by mean score."""
    trees = {}
    for tree, node, parent, *_, score in rows:
        trees.setdefault(tree, {})[node] = (parent, score or 0.0)
    out = {}
    for tree, nodes in trees.items():
        inner = {p for n, (p, _) in nodes.items() if p in nodes and p != n}
        paths = []
        for leaf in set(nodes) - inner:
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                parent = nodes[at][0]
                at = parent if parent in nodes and parent != at else None
            paths.append((-sum(nodes[n][1] for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:branches], 1):
            out[tree, leaf] = (rank, path)
    return out


@pytest.mark.parametrize("branches", [1, 3])
def test_paths_against_brute_force(spark, branches):
    rng = random.Random(branches)
    rows = []
    for tree in range(12):
        for node in range(rng.randint(1, 40)):
            parent = rng.randrange(max(0, node - 4), node) if node else rng.choice([None, 0, 999])
            rows.append((tree, node, parent, "user", f"t{node}", float(rng.randrange(8))))
    rows += [(50, k, k - 1 if k else None, "user", "x", None) for k in range(130)]
    df = spark.createDataFrame(rows, SHAPE)
    got = {}
    for r in chosen_paths(df.select("tree", "node", "parent", "score"), branches).collect():
        got.setdefault((r.tree, r.leaf), (r["rank"], []))[1].append((r.depth, r.node))
    assert {k: (rank, [n for _, n in sorted(path)]) for k, (rank, path) in got.items()} == brute_paths(rows, branches)


def test_edge_rows(spark):
    rows = [
        (1, 0, None, None, None, None), (1, 1, 0, "assistant", "a" * 100_000, 1.0), (1, 1, 0, "assistant", "a" * 100_000, 1.0),
        (2, 5, 6, "user", "cycle", 1.0), (2, 6, 5, "user", "cycle", 1.0), (3, 7, 7, "user", "own parent", 1.0),
    ]
    got = {r.tree: read_turns(r.formatted) for r in format_trees(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {1: [("", ""), ("assistant", "a" * 100_000)], 3: [("user", "own parent")]}
    assert format_trees(spark.createDataFrame([], SHAPE)).collect() == []


def test_conversation_edges(spark):
    shape = "conv_id long, turn long, role string, text string, node int, tree string"
    rows = [(1, 2, "assistant", None, 1, "x"), (1, 0, None, "q", 2, "y"), (4, 0, "assistant", "a", 3, "z"), (4, 0, "assistant", "a", 3, "z")]
    got = {r.conv_id: r for r in read_back(format_trees(linear_replies(spark.createDataFrame(rows, shape)))).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (2, 0) and (got[4].n_turns, got[4].loss_chars) == (2, 2)


def test_null_conversation_and_node(spark):
    shape = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "abc"), (None, 2, "user", "z"), (0, 0, "user", "other")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in read_back(format_trees(linear_replies(spark.createDataFrame(rows, shape)))).collect()}
    assert got == {None: (3, 3), 0: (1, 0)}
    rows = [(None, 0, None, "user", "q", 1.0), (None, None, 0, "assistant", "a", 1.0), (2, None, None, "user", "alone", 1.0)]
    made = format_trees(spark.createDataFrame(rows, SHAPE)).collect()
    assert {(r.tree, r.leaf): read_turns(r.formatted) for r in made} == {
        (None, None): [("user", "q"), ("assistant", "a")], (2, None): [("user", "alone")],
    }
