"""The corpus pipeline, stage by stage, against brute force on what each stage got."""

import corpus_pipeline
from logloom.llm.common import stored, table

from .test_operators import SCHEMA, brute_spans
from .test_shingles import brute_survivors

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[f"after {name}"] = docs
    rows = lambda n: [(r.doc_id, r.text) for r in seen[n].select("doc_id", "text").collect()]
    assert len(rows("after language")) == 200  # every document has letters
    # The stage links five-word shingles of similarity 0.8 or more; fingerprints of three words bind op10's own query alone.
    assert {i for i, _ in rows("after near_duplicates")} == brute_survivors(rows("near_duplicates"))
    cut = brute_spans([(i, (t or "").encode()) for i, t in rows("repeated_passages")], 200)
    left = dict(rows("after repeated_passages"))
    before = dict(rows("repeated_passages"))
    for i, _, n_removed, _, _ in cut:
        if n_removed == 0:
            assert left[i] == before[i]
        elif i in left:
            assert len(left[i].encode()) <= len(before[i].encode()) - n_removed
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    gone = set(dict(rows("benchmark"))) - set(dict(rows("after benchmark")))
    assert gone == {i for i, t in rows("benchmark") if any(x in t for x in items)}
    last = seen["after mixture"].collect()
    assert all(r.copies > 0 and r.taken == r["size"] * r.copies for r in last)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in last)


def test_awkward_tables(spark):
    rows = [(1, "Aa b", "en", "s", 4, 7, "x"), (1, "Aa b", "en", "s", 4, 7, "x"), (None, None, None, None, None, 1, None), (2, "", "en", "t", 0, 1, "q"), (None, "bb cc dd", "en", None, 8, 1, "r"), (3, "ééé " * 200, "fr", "u", 800, 1, "z")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), f"awkward-{name}")
        assert (docs.count() > 0) == bool(some)
