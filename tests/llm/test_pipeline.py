from collections import Counter

import corpus_pipeline
from logarc.llm.common import table

from .fixtures import awkward, doc, empty, frame, prose
from .test_near_duplicates import jaccard
from .test_text_ops import brute_lines, tokens

BENCHMARK = [(0, prose(9000, 30)), (1, prose(9001, 20))]


def write(spark, folder, rows):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_decides_on_what_is_left(spark, tmp_path):
    rows = awkward()
    for i in range(60):
        rows.append(doc(100 + i, f"{prose(100 + i, 60)}\nshared footer of every site", "en", f"s{i % 15}"))
    rows.append(doc(300, rows[-1][1].replace("footer", "foot"), "en", "s1"))
    rows.append(doc(301, f"{prose(301, 30)} {BENCHMARK[0][1]} {prose(302, 30)}"))
    folder = str(tmp_path)
    write(spark, folder, rows)
    docs, seen = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == frame(spark, rows).columns
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {4, 5, 6, 10, None}
    assert not [r for r in after if not any(c.isalpha() for c in r.text or "")]
    before, after = seen["lines"]
    plain = [(r.doc_id, r.text, r.lang, r.source) for r in before]
    assert Counter((r.doc_id, r.text) for r in after) == Counter((d, t) for d, t, _, _ in brute_lines(plain, 10).elements())
    assert not any("shared footer" in (r.text or "") for r in after)
    before, after = seen["near_duplicates"]
    kept = [r.text for r in after]
    assert not [1 for i, a in enumerate(kept) for b in kept[:i] if jaccard(a, b) >= 0.8]
    assert all(any(jaccard(r.text, k) >= 0.8 for k in kept) for r in before)
    before, after = seen["benchmark"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {301}
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_gives_the_last_stage(spark, tmp_path):
    write(spark, str(tmp_path), awkward())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).collect() == []


def test_words_are_those_of_the_contract():
    assert tokens("a\x0bb\x1cc") == ["a", "b\x1cc"]
