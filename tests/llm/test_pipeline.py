"""The pipeline's stages, each against brute force or what its operator says of its own input."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from quarry.llm import common
from quarry.llm.mixing import mix
from quarry.llm.quality import fit_references, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, kept string, key int, size int"


def near_brute(rows):
    """Rows (doc_id, text) that stay: of each component at five-word Jaccard 0.8, the one with the smallest id, then the first."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, i)), (doc is None, doc or 0, i))
    return [rows[i] for _, _, i in best.values()]


def exact_brute(rows):
    best = {}
    for i, (doc, text) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        own = (-len(text or ""), doc is not None, doc or 0, i)
        best[key] = min(best.get(key, own), own)
    return [rows[i] for *_, i in best.values()]


def check_stages(spark, docs, sf):
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.materialize(docs, "test-input")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        after = common.materialize(stage(spark, docs, sf), "test-stage")
        assert after.dtypes == docs.dtypes
        if name == "quality_rules":
            keyed = common.numbered(docs, "__n")
            numbers = quality(keyed.withColumn("doc_id", keyed["__n"]), fit_references(docs, common.table(spark, sf, "labels"))).where("kept").collect()
            numbers = {r.doc_id for r in numbers}
            want = Counter((r.doc_id, r.text) for r in keyed.collect() if r["__n"] in numbers)
        elif name == "mixing":
            found = mix(docs).collect()
            got = Counter(r.doc_id for r in after.collect())
            if len({d for d, _ in rows}) == len(rows):
                assert got == Counter({r.doc_id: r.copies for r in found if r.copies})
            assert sum(got.values()) == sum(r.copies for r in found)
            want = None
        else:
            want = Counter(exact_brute(rows) if name == "exact_dedup" else near_brute(rows))
        assert want is None or pairs(after) == want
        docs = after
    packed = pipeline.packing(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    return docs


def test_stages(spark, sf):
    check_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)


def test_awkward_documents(spark, sf):
    """Null and repeated ids, nulls elsewhere, short texts, copies, and columns with names used inside."""
    body = lambda k: " ".join(f"the word{i} of{k}" for i in range(60))
    rows = [(1, body(0), "en", "a"), (1, body(0), "en", "a"), (None, body(0) + " x", "en", None), (None, body(1), None, "b"), (None, body(2), "en", "b"), (2, None, None, "b")]
    rows += [(3, "", "en", "b"), (4, body(0).replace("word1 ", "term "), "en", "b"), (5, body(3), "en", "a"), (5, body(4), "xx", "a"), (5, body(4) + "\n", "xx", "a"), (None, body(5), "de", "a")]
    docs = spark.createDataFrame([(*r, None, 1, "k", 2, 3) for r in rows], SCHEMA)
    check_stages(spark, docs, sf)
    once = common.materialize(pipeline.exact_dedup(spark, docs, sf), "test-once")
    assert sum(r.doc_id == 1 for r in once.collect()) == 1 and sum(r.doc_id == 5 for r in once.collect()) == 2
    df = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == docs.columns and df.count() == 0
    assert pipeline.packing(spark, df, sf).count() == 0


def test_numbered(spark, sf, tmp_path):
    docs = spark.range(1000).repartition(7)
    docs.write.parquet(f"{tmp_path}/x")
    read = common.numbered(spark.read.parquet(f"{tmp_path}/x"), "n")
    first, again = ({r.id: r.n for r in read.repartition(k).collect()} for k in (1, 3))
    assert first == again and len(set(first.values())) == 1000
    assert common.numbered(spark.range(5).union(spark.range(5)), "n").select("n").distinct().count() == 10
