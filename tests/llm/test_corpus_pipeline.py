import re

import corpus_pipeline
from test_decontamination import plain_words
from test_packing import check_rows
from test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, small):
    """Every stage on what its predecessor kept, next to plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [plain_words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.stored(stage(spark, docs, small), "test")
        if name == "best_fit_packing":
            check_rows(made.collect(), list(left.items()))
            continue
        assert made.columns == COLUMNS
        if name == "language_id":
            left = {d: t for d, t in left.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "exact_dedup":
            first = {}
            for d in sorted(left):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[d]), d)
            left = {d: left[d] for d in first.values()}
        elif name == "simhash_dedup":
            groups = brute_components([(d, brute_fingerprint(t)) for d, t in left.items()])
            left = {d: left[d] for d in set(groups.values())}
        else:
            own = {d: grams(plain_words(t)) for d, t in left.items()}
            left = {d: t for d, t in left.items() if not any(len(g & own[d]) >= 0.5 * len(g) for g in map(grams, items))}
        assert {r.doc_id: r.text for r in made.collect()} == left, name
        docs = made


def test_run_equals_the_stages(spark, small):
    got = corpus_pipeline.run(spark, small).collect()
    assert len({r.doc_id for r in got}) < 200 and len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_edge_rows(spark, small):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", None, 0), (2, "12 34", "en", "s", 5), (3, "a few words here", None, "s", 1), (3, "a few words here", None, "s", 1), (None, "a  few words here", "en", "s", 1), (5, "other words " * 9000, "en", "s", 1)]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, small), "test")
        assert {r.doc_id for r in docs.collect()} == ({3, 5} if rows else set())
