"""The pipeline, stage by stage, against brute force on a small fixture."""

import corpus_pipeline
from ledgerloom.llm.common import save

from ..conftest import SMALL
from .test_dedup_and_rules import base, components, leaks, sets


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "secrets", "pieces"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = save(stage(spark, docs, SMALL), name)
        if name == "pieces":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "near_dedup":
            c = components(sets(before.items()), 80)
            assert after.keys() == {i for i, r in c.items() if i == r}
        elif name == "decontaminate":
            assert after.keys() == {i for i, x in leaks(list(before.items()), items).items() if not x[4]}
        elif name == "secrets":
            assert after.keys() == before.keys()
            assert all(after[i] == t or sum(base(t)[0]) for i, t in before.items())
            assert not any(sum(base(t)[0]) for t in after.values())
        docs, before = out, after


def test_odd_rows(spark):
    """Null texts and ids, repeated rows and ids, empty texts, columns called as the operators' own."""
    good = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(1, None), (2, ""), (None, good + " one two"), (3, good), (3, good), (4, good), (5, other), (5, other + " more"), (6, f"{other} AKIA{'Q' * 16} {' '.join(f'third{i}' for i in range(90))}"), (7, "short")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 7, "b", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, rules int, found int")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SMALL), name)
        if name != "pieces":
            assert docs.columns[5:] == ["node", "bucket", "rules", "found"]
            kept.append(sorted((r.doc_id or 0) for r in docs.collect()))
    assert kept == [[0, 3, 3, 4, 5, 5, 6], [0, 3, 5, 6], [0, 3, 5, 6], [0, 3, 5, 6]]
    assert docs.count() == 4


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SMALL), name)
    assert docs.count() == 0
