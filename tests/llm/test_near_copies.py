"""Near copies against brute force over five-word shingles."""

import numpy as np
import pytest

from quarry.llm import near_copies
from quarry.llm.simhash import GrayForest


def brute(rows):
    """doc_id to the smallest id of its component, by exact Jaccard similarity of all pairs."""
    words = [t.encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def edited(rng, groups, copies, most):
    """Texts of 150 words in groups around a common one, up to ``most`` words changed."""
    rows = []
    for _ in range(groups):
        body = [f"w{i}" for i in rng.integers(0, 5000, 150)]
        for _ in range(copies):
            copy = list(body)
            for i in rng.integers(0, 150, int(rng.integers(0, most))):
                copy[i] = f"changed{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("bucket_rows", [near_copies.BUCKET_ROWS, 4])
def test_links_by_five_word_jaccard(spark, bucket_rows):
    """Copies near 0.8 on both sides of it, also when buckets are dealt in blocks."""
    rows = edited(np.random.default_rng(3), 25, 6, 6) + [(1000, ""), (1001, " \n"), (1002, "one two"), (1003, "One two"), (1004, "one two three four five six")]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.near_copies(docs, bucket_rows=bucket_rows).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert sorted(r.doc_id for r in found if r.kept) == [d for d, c in sorted(want.items()) if d == c]


def test_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == brute(rows)


def test_recall_just_above_the_limit(spark):
    """Of 2,000 pairs between 0.8 and 0.85, at least 97 % are linked; and no pair under 0.8 is."""
    rng = np.random.default_rng(11)
    rows, above = [], set()
    while len(above) < 2000:
        n = int(rng.integers(60, 400))
        body = [f"w{i}" for i in rng.integers(0, 100_000, n)]
        copy = list(body)
        for i in rng.choice(n, max(1, round(n / 48)), replace=False):
            copy[i] = f"changed{rng.integers(0, 10**9)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (body, copy))
        similarity = len(a & b) / len(a | b)
        if similarity < 0.85:
            if similarity >= 0.8:
                above.add(len(rows))
            rows += [(len(rows), " ".join(body)), (len(rows) + 1, " ".join(copy))]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i for i in range(0, len(rows), 2) if found[i + 1] == i}
    assert all(found[i] == i for i in range(0, len(rows), 2))
    assert linked <= above and len(linked & above) >= 0.97 * len(above)


def test_repeated_and_missing_ids(spark):
    body = " ".join(f"w{i}" for i in range(100))
    rows = [(None, body), (7, body), (7, body + " more"), (3, body), (3, "another text"), (None, "another text"), (5, None), (4, "")]
    found = near_copies.near_copies(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row long"), key="row").collect()
    assert {r.key: (r.component_id, r.kept) for r in found} == {0: (3, False), 1: (3, False), 2: (3, False), 3: (3, True), 4: (3, True), 5: (3, False), 6: (4, False), 7: (4, True)}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_passes_over_its_own_label():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 6).astype(np.uint64)) for _ in range(30)]))
    bucket, labels = rng.integers(0, 3, len(fps)), rng.integers(0, 2, len(fps))
    forest = GrayForest(bucket, fps)
    forest.label(labels[forest.order])
    a, b = forest.search(np.arange(len(fps)), 5, other_labels=True)
    got = {(int(forest.order[i]), int(forest.order[j])) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bucket[i] == bucket[j] and labels[i] != labels[j] and int(fps[i] ^ fps[j]).bit_count() <= 5}
    assert got == want
