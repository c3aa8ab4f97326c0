"""Operators on small frames: the edge cases of the fixtures."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import Settings, checked_search, parse_filters
from quarry.functions import embedding, stemming
from quarry.functions import personal as P
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators.index import KeywordIndex
from quarry.operators import chunking, context, fusion, graph, keyword, profile, reports, store, tables, vector_search


def test_fusion_labels(spark):
    kw = spark.createDataFrame([(1, 1.0), (2, 0.4)], "chunk_id long, score double")
    sem = spark.createDataFrame([(2, 0.9), (3, 0.0)], "chunk_id long, score double")
    got = {r.chunk_id: (round(r.score, 4), r.source) for r in fusion.fuse_sum(kw, sem, "chunk_id").collect()}
    assert got == {1: (0.3, "keyword"), 2: (0.75, "both"), 3: (0.0, "semantic")}
    got = {r.chunk_id: (round(r.score, 4), r.source) for r in fusion.fuse_average(kw, sem, "chunk_id").collect()}
    assert got == {1: (0.3, "keyword"), 2: (0.375, "both"), 3: (0.0, "semantic")}


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple tart"), (3, "plum"), (4, None)], "id long, text string")
    got = {r.id: r.bm25 for r in keyword.bm25(docs, "id", ["apple"]).collect()}
    idf, avg = 1e-6, 6 / 4
    for i, tf, dl in ((1, 1, 2), (2, 2, 3)):
        assert got[i] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)))
    assert keyword.keyword_search(docs, "id", []).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.distance for r in vector_search.nearest(df, "id", [1.0, 0.0], 10).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0, 4: 1.0}
    sims = {r.id: r.score for r in vector_search.semantic_search(df, "id", [1.0, 0.0]).collect()}
    assert sims[3] == 0.0 and sims[1] == 1.0
    assert df.select(V.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).where("c is null").count() == 1


def test_approximate_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    hits = 0
    for i in (0, 7, 31):
        q = [float(x) for x in e.where(f"vec_id = {i}").first().embedding]
        exact = {r.vec_id for r in vector_search.nearest(e, "vec_id", q, 5).collect()}
        near = {r.vec_id for r in vector_search.approximate_nearest(e, "vec_id", q, 5, tables=24, bits=3).collect()}
        hits += len(exact & near)
    assert hits >= 0.9 * 15


def pack_plain(rows, budget, reserve=100):
    total, taken = 0, []
    for i, (key, cost) in enumerate(rows):
        price = cost + (1 if i else 0)
        if total + price <= budget - reserve:
            total, taken = total + price, [*taken, key]
    return total, taken


def test_token_budget(spark):
    rng = random.Random(3)
    for budget in (150, 400, 4000):
        rows = [(0, k, float(100 - k), rng.randint(1, 120)) for k in range(40)]
        df = spark.createDataFrame(rows, "q long, chunk_id long, score double, cost long")
        got = context.within_budget(df, ["q"], "chunk_id", "score", "cost", budget).orderBy("position").collect()
        total, taken = pack_plain([(r[1], r[3]) for r in rows], budget)
        assert [r.chunk_id for r in got] == taken and (not got or got[0].total_tokens == total)


def test_context_rules(spark):
    rows = [(0, 1, 7, 0.9), (0, 1, 7, 0.8), (0, 2, 7, 0.7), (0, 3, 7, 0.6), (0, 4, 7, 0.5), (0, 5, None, 0.4), (0, 6, None, 0.3), (0, None, 8, 0.99)]
    df = spark.createDataFrame([(*r, "some words here") for r in rows], "q long, chunk_id long, doc_id long, score double, text string")
    assert sorted(r.chunk_id for r in context.assemble(df, ["q"]).collect()) == [1, 2, 3, 5, 6]


@given(st.lists(st.text(alphabet="ab .", min_size=1, max_size=60).filter(lambda s: s.strip()), max_size=30), st.integers(5, 40), st.integers(0, 30))
@settings(max_examples=60, deadline=None)
def test_chunks_keep_all_words(parts, target, overlap):
    target, overlap = chunking.repaired(target, overlap)
    chunks = chunking.pack_sentences(parts, target, overlap)
    words = [w for s in parts for w in s.split()]
    if overlap == 0:
        assert [w for c, _ in chunks for w in c.split()] == words
    else:
        assert set(words) == {w for c, _ in chunks for w in c.split()}
    assert all(n <= max(target + overlap, chunking.tokens_in("w " * target)) for _, n in chunks)


def test_chunk_parameters():
    assert chunking.repaired(0, 200) == (800, 200) and chunking.repaired(800, -1) == (800, 200) and chunking.repaired(100, 100) == (100, 50)
    assert chunking.pack_sentences([]) == []


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", "1", "embedded"), ("b", "1", "embedded"), ("c", "1", "deleted"), ("d", "1", "error"), ("e", "1", "embedded"), ("f", "1", "deleted")], "path string, hash string, status string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("g", "1")], "path string, hash string")
    got = {r.path: r.outcome for r in tables.snapshot_diff(now, before, status="status").collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "modified", "d": "modified", "e": "deleted", "g": "new"}
    paths = spark.createDataFrame([("/a/doc/x",), ("/a/docs/x",)], "path string")
    assert [r.path for r in paths.where(tables.under(F.col("path"), "/a/doc")).collect()] == ["/a/doc/x"]


def test_quota(spark):
    log = spark.createDataFrame([("d1", 1, 60), ("d1", 2, 40), ("d1", 3, 1), ("d2", 4, 100)], "day string, at long, n long")
    got = {r["at"]: r.accepted for r in tables.running_quota(log, "day", ["at"], "n", 100).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def brute_betweenness(edges):
    nodes = sorted({x for e in edges for x in e})
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in nodes}

    def paths(s, t):
        layer, found = [[s]], []
        while layer and not found:
            found = [p for p in layer if p[-1] == t]
            layer = [p + [w] for p in layer for w in near[p[-1]] if w not in p]
        return found

    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            if s != t and (ps := paths(s, t)):
                for v in nodes:
                    if v not in (s, t):
                        score[v] += sum(v in p for p in ps) / len(ps)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_graph(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source long, target long, weight double")
    got = {r.node: r.betweenness for r in graph.betweenness(df).collect()}
    assert got == pytest.approx(brute_betweenness(edges))
    found = {r.node: r.community for r in graph.communities(df).collect()}
    assert found[0] == found[1] == found[2] != found[4] and found == {r.node: r.community for r in graph.communities(df).collect()}
    near = graph._adjacency(df, 100)
    spread = {r.node: r.community for r in graph.label_propagation(df).collect()}
    assert graph.modularity(near, found) >= graph.modularity(near, spread) - 1e-9
    assert graph.top_nodes(df, 3).count() >= 1
    with pytest.raises(ValueError):
        graph._adjacency(df, 3)


def test_pairs_beyond_all_pairs(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    rows = [(10 * i + j, [x + rng.gauss(0, 0.02) for x in b]) for i, b in enumerate(base) for j in range(4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact = {(r.source, r.target) for r in graph.similar_pairs(df, "id", 0.95).collect()}
    bucketed = {(r.source, r.target) for r in graph.similar_pairs(df, "id", 0.95, all_pairs=5).collect()}
    assert bucketed <= exact and len(bucketed) >= 0.9 * len(exact)


def test_profile(spark):
    rows = [("1", "0", "yes", "2024-01-01", "x", None), ("2.5", "1", "no", "2024-02-03", "y z", None), (None, "1", None, "2024-03-04", None, None)]
    names = ["num", "bit", "truth", "day", "words", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert {r.column_name: r.inferred_type for r in profile.column_types(df, names).collect()} == dict(zip(names, ["numeric", "boolean", "boolean", "datetime", "text", "unknown"]))
    counts = {r.column_name: (r.non_null, r.nulls, r.distinct_values) for r in profile.column_counts(df, names).collect()}
    assert counts["num"] == (2, 1, 2) and counts["none"] == (0, 3, 0)
    assert df.select(profile.row_text(names).alias("t")).first().t == "1 | 0 | yes | 2024-01-01 | x | "


TEXT = "Call 555-123-4567 or 1-555-123-4567, mail a.b@c.org, SSN 123-45-6789, card 4111-1111-1111-1111 and 4111111111111111, host 10.0.0.1."


def test_personal_data(spark):
    df = spark.createDataFrame([(TEXT,), ("nothing here",)], "t string")
    got = df.select(*[c.alias(k) for k, c in P.counts(F.col("t")).items()], P.has_any(F.col("t")).alias("any"), P.redact(F.col("t")).alias("clean")).collect()
    assert (got[0].email, got[0].ssn, got[0].credit_card, got[0].ip_address, got[0]["any"]) == (1, 1, 2, 1, True) and got[0].phone >= 2
    assert "[REDACTED]:EMAIL" in got[0].clean and "[REDACTED]:SSN" in got[0].clean and "10.0.0.1" in got[0].clean
    assert not got[1]["any"] and got[1].clean == "nothing here"


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first().x
    assert one(T.normalize_text("t"), "é a\r\n\tb​  c\n\n\n\nd ") == "é a\n b c\n\nd"
    assert one(T.truncate_text("t", 12), "hello wide world") == "hello..." and one(T.truncate_text("t", 20), "short") == "short"
    assert one(T.sentences("t"), "Dr. Who left. Mr. Smith e.g. stayed? Yes! And more") == ["Dr. Who left.", "Mr. Smith e.g. stayed?", "Yes!", "And more"]
    assert one(T.topic_keywords("t"), "The meeting_notes and Budget REPORT") == ["budget", "report"]
    for json, want in (('["a", " b "]', ["a", "b"]), ("[]", []), ("nope", []), ('{"a": 1}', []), (None, [])):
        assert one(T.tags("t"), json) == want
    assert one(T.squeeze_whitespace("t"), " a  b\n\n \n\nc\td ") == "a b\n\nc d"


def test_token_estimates(spark):
    r = spark.createDataFrame([("one two three",), ("",), (None,)], "t string").select(*[c.alias(n) for n, c in T.token_estimates("t").items()]).collect()
    assert tuple(r[0]) == (3, 4, 3, 3) and tuple(r[1]) == tuple(r[2]) == (0, 1, 0, 1)


def test_stemming():
    for word, want in {"running": "run", "caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "happy": "happi", "controlling": "control", "sky": "sky", "adjustable": "adjust"}.items():
        assert stemming.stem(word) == want
    assert stemming.fold("Café") == "cafe"


def test_index_terms(spark):
    df = spark.createDataFrame([("running",), ("runs",), ("café",)], "term string")
    assert {r.index_term for r in stemming.with_index_terms(df).collect()} == {"run", "cafe"}


def test_embedding(spark):
    by = embedding.provider("hashing", dimensions=16)
    chunks = spark.createDataFrame([(1, "Hello world"), (2, "hello WORLD "), (3, "other"), (4, "")], "id long, text string")
    cache = spark.createDataFrame([], "cache_key string, embedding array<double>")
    vectors, fresh = embedding.embed_chunks(chunks, cache, by, "id")
    got = {r.id: r for r in vectors.collect()}
    assert len(got) == 4 and got[1].embedding == got[2].embedding and fresh.count() == 3
    assert math.isclose(sum(x * x for x in got[3].embedding), 1.0)
    again, more = embedding.embed_chunks(chunks, fresh, by, "id")
    assert again.count() == 4 and more.count() == 0
    few, _ = embedding.embed_chunks(chunks, cache, by, "id", quota=3)
    assert few.count() < 4
    with pytest.raises(ValueError):
        embedding.provider("none")


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert embedding.retried(flaky, first=0.0) == "ok" and len(calls) == 3


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, status string")
    s.write("documents", rows)
    s.write("chunks", spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, seq long"))
    s.upsert("documents", spark.createDataFrame([(2, "c"), (3, "d"), (4, None)], "doc_id long, status string"), ["doc_id"], ["status"])
    assert {tuple(r) for r in s.read("documents").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    gone = spark.createDataFrame([(1,)], "doc_id long")
    s.delete_documents(gone, soft=True)
    assert {tuple(r) for r in s.read("documents").collect()} == {(1, "deleted"), (2, "c"), (3, "d")} and s.read("chunks").count() == 1
    s.delete_documents(gone)
    assert s.read("documents").count() == 2
    s.append("documents", rows.limit(1))
    s.compact("documents")
    s.reset("chunks")
    assert s.read("documents").count() == 3 and s.read("chunks").count() == 0
    version, reader = s.version("documents"), s.read("documents")
    s.append("documents", rows)
    assert s.read("documents").count() == 5 and s.read("documents", version=version).count() == 3 and reader.count() == 3
    assert set(s._folders("documents", version)) < set(s._folders("documents", version + 1))  # nothing was written again
    for _ in range(4):
        s.write("documents", rows)
    assert len(s.versions("documents")) == s.kept and len([p for p in (tmp_path / "documents").iterdir() if p.name != "_versions"]) == s.kept
    other = store.Store(spark, f"file://{tmp_path}")
    other.version = lambda name: s.version(name) - 1  # a writer that began before the last one ended
    with pytest.raises(OSError):
        other.write("documents", rows.limit(0))
    assert s.read("documents").count() == 2
    with pytest.raises(LookupError):
        s.read("none")


def test_reports(spark):
    docs = spark.createDataFrame([("my_notes", "Budget review")] * 3 + [("my_notes", "x")] * 2 + [("pdf", "y")], "kind string, title string")
    got = {r.topic: r.n_docs for r in reports.digest(docs, "kind", "title", most=4).collect()}
    assert got == {"My Notes - Budget": 3, "My Notes - Other": 2, "Pdf": 1}
    assert "No documents" in reports.digest_markdown("2024-W02", []) and "1 document in 1 group" in reports.digest_markdown("w", [("A", 1)])
    assert reports.trend_text(5, 2, 14, {"pdf": 2}, ["a"], ["t"]).count("\n") == 4
    assert store.sse_frame("chunk", text="é") == 'data: {"type": "chunk", "text": "é"}\n\n'
    assert store.log_line("INFO", "two words", n=1) == 'level=INFO message="two words" n=1'


def test_keyword_index(spark, tmp_path):
    """Added, changed by remove and ensure, and asked: always as a search over the texts."""
    rows = [(i, f"alpha {'beta ' * (i % 4)} gamma{i % 3} delta") for i in range(60)]
    docs = spark.createDataFrame(rows, "k long, text string")
    index = KeywordIndex(store.Store(spark, f"file://{tmp_path}"), "docs", "k")
    for current in (docs.where("k < 20"), docs, docs.where("k > 10")):
        index.ensure(current)
        for asked in (["beta"], ["alpha", "beta", "gamma1"], ["beta", "beta"], ["none"]):
            want = {r.k: round(r.bm25, 9) for r in keyword.bm25(current, "k", asked).collect()}
            assert {r.k: round(r.bm25, 9) for r in index.bm25(asked).collect()} == want
    version = index.store.version(index.postings)
    index.ensure(docs.where("k > 10"))
    assert index.store.version(index.postings) == version


def test_graph_cache(spark):
    built, cache = [], graph.GraphCache(Settings().graph_cache_seconds)

    def build():
        built.append(1)
        return spark.createDataFrame([(1, 2, 0.5)], "source long, target long, weight double")

    for now, threshold in ((0, 0.5), (3599, 0.5), (10, 0.6), (3600, 0.5), (3700, 0.5)):
        assert cache.get(("docs", threshold), now, build).count() == 1
    assert len(built) == 3
    cache.clear()
    cache.get(("docs", 0.5), 3701, build)
    assert len(built) == 4


def test_report_file(spark, tmp_path):
    path = store.write_report(spark, f"file://{tmp_path}", 2024, 7, "# é")
    assert path.endswith("/weekly-2024-07.md") and (tmp_path / "weekly-2024-07.md").read_text() == "# é"


def test_best_of_equal_scores(spark):
    rows = [(1, 0.5, "b"), (1, 0.5, "a"), (1, 0.4, "c"), (None, 0.9, "z"), (2, 0.1, "q")]
    for n in (1, 3):
        found = context.dedup_best(spark.createDataFrame(rows, "k long, s double, t string").repartition(n), [], "k", "s").collect()
        assert sorted((r.k, r.t) for r in found) == [(1, "a"), (2, "q")]


def test_settings(monkeypatch):
    assert Settings().chunk_tokens == 800
    monkeypatch.setenv("QUARRY_CHUNK_TOKENS", "500")
    assert Settings.load().chunk_tokens == 500
    with pytest.raises(ValueError):
        Settings(semantic_weight=0.9)
    with pytest.raises(ValueError):
        parse_filters("[1]")
    assert parse_filters('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        checked_search("", 5)
