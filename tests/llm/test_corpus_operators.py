"""The corpus operators against brute force, on whole small tables and on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import common
from quarry.llm.exact_dedup import exact_duplicates, radix_classes
from quarry.llm.mixing import meet, mix, source_targets
from quarry.llm.packing import CapacityTree, best_fit_decreasing, pack
from quarry.llm.quality import CLASSES, COMMON_WORDS, features, fit_references, fitting_half, passing, quality, repeated_lines, repeated_words
from quarry.llm.sharding import measured, shard_by_bytes
from quarry.llm.simhash import GrayForest, fingerprint, fingerprints, gray_rank, near_duplicates
from quarry.llm.tokens import WordEncoder, byte_batches, default_path

WHITE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, rid int, rep int, fp int, shard int, unit int, copies int, component_id int, task int, key int, `__range` int"


def words(text):
    return [w for w in WHITE.split(text or "") if w]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in each column, empty and very long texts, repeated rows, and columns with the names used inside."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [
        (1, "", "en", "a"), (2, None, "de", "a"), (3, long, "en", "b"), (4, "one two three", None, "b"), (4, "one two three", None, "b"), (5, "one two\tthree", "en", None),
        (None, "no id here at all", "en", "a"), (None, "no id here at all", "en", "a"), (6, " \n\t ", "xx", "c"), (7, "Grüße 日本語 é", "de", "c"), (8, "<|endoftext|> a", "en", ""), (9, "same\nsame\nsame", "en", "b"),
    ]
    return spark.createDataFrame([(*t, None, *["x"], *[7] * 11) for t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


# Exact dedup ---------------------------------------------------------------------------------------------------------


def exact_brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is not None, doc or 0, doc))
    out = Counter()
    for norm, members in groups.items():
        keep = min(members)[3]
        out.update((m[3], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members)
    return out


def test_exact_dedup(docs, rows):
    found = exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == exact_brute([r[:2] for r in rows])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_exact_dedup_awkward(awkward):
    found = exact_duplicates(awkward).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == exact_brute([(r.doc_id, r.text) for r in awkward.collect()])
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})


def test_exact_dedup_across_tasks(spark):
    """Copies in many partitions, and texts that differ only late or in length."""
    base = "x" * 5000
    texts = [base] * 40 + [base + "a"] * 3 + [base[:-1] + "y"] * 5 + ["z" * 17, "z" * 16, "z" * 16 + "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_duplicates(df).collect()) == exact_brute(list(enumerate(texts)))


def test_radix_classes():
    keys = [b"", b"a", b"", b"ab", b"a" * 300, b"a" * 300, b"a" * 299 + b"b"]
    assert sorted(sorted(g) for g in radix_classes(keys)) == [[0, 2], [1], [3], [4, 5], [6]]


# SimHash -------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, most=2):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= most):
            p, q = find(i), find(int(j))
            root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(a))]


def test_fingerprints(rows):
    for _, text, _ in rows[:60]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    (h,) = spark.sql("SELECT xxhash64('a b c')").first()
    assert xxhash.xxh64_intdigest(b"a b c", seed=42) == h % (1 << 64)


def test_components(docs, rows):
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect()}
    order = sorted(rows)
    fps = [fingerprint(t.encode()) for _, t, _ in order]
    assert [found[d][0] for d, *_ in order] == fps
    assert [found[d][1] for d, *_ in order] == [order[i][0] for i in linked(fps)]


@pytest.mark.parametrize("bucket_rows", [1 << 16, 20])
def test_components_of_clusters(spark, monkeypatch, bucket_rows):
    """Dense clusters and chains of fingerprints, also when buckets are dealt again."""
    from quarry.llm import simhash

    rng = np.random.default_rng(5)
    fps = []
    for _ in range(6):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            fps.append(at)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                at ^= 1 << int(b)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    texts = spark.createDataFrame([(i, str(f)) for i, f in enumerate(signed)], "doc_id long, text string")
    monkeypatch.setattr(simhash.common, "map_arrow", _stub_fingerprints(common.map_arrow))
    found = {r.doc_id: r.component_id for r in near_duplicates(texts, bucket_rows=bucket_rows).collect()}
    assert [found[i] for i in range(len(fps))] == linked(fps)


def _stub_fingerprints(real):
    from pyspark.sql import functions as F

    return lambda df, f, schema: df.select("doc_id", F.col("text").cast("long").alias("fp"), F.array().cast("array<long>").alias("more")) if "fp" in schema else real(df, f, schema)


def test_further_draws(spark):
    """Each draw links as brute force over its fingerprints does."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(30):
        body = [f"w{i}" for i in rng.integers(0, 5000, 150)]
        for _ in range(3):
            copy = list(body)
            for i in rng.integers(0, 150, int(rng.integers(0, 4))):
                copy[i] = "changed"
            texts.append(" ".join(copy))
    every = [fingerprints(t.encode(), 4) for t in texts]
    assert [f[0] for f in every] == [fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 2 for a, b in zip(every[i], every[j])):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(df, draws=4).collect()}
    assert [found[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    once = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert len(set(found.values())) < len(set(once.values()))


def test_gray_forest_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(20)] + [base]))
    bucket = rng.integers(0, 3, len(fps))
    forest = GrayForest(bucket, fps)
    got = {(int(forest.fps[i]), int(forest.fps[j])) for a, b in forest.pairs(rows=50) for i, j in zip(a, b)}
    got = {tuple(sorted(p)) for p in got}
    want = {tuple(sorted((int(fps[i]), int(fps[j])))) for i in range(len(fps)) for j in range(i) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64)
    assert (gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


def test_simhash_awkward(awkward):
    found = near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    by = defaultdict(set)
    for r in found:
        by[r.fp].add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    assert {r.component_id for r in found if r.fp == 0} == {1}


# Mixing --------------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        if not open_:
            break
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * rate > most * sizes[s]}
        if not over:
            break
        full |= over
    return {s: float(most * sizes[s]) if s in full else w[s] * rate for s in names}


def test_mix(docs, rows):
    found = mix(docs).collect()
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    targets = water_fill(sizes)
    size = {d: len(words(t)) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    largest = defaultdict(int)
    for d, s in source.items():
        largest[s] = max(largest[s], size[d])
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 0.05 * targets[s] for s in targets)


def test_mix_is_unbiased():
    rng = np.random.default_rng(0)
    for p, q in ((0.3, 0.4), (0.7, 0.8), (0.5, 0.5), (0.2, 0.9)):
        got = np.array([meet(p, q, u) for u in rng.random(20000)])
        assert np.allclose(got.mean(axis=0), [p, q], atol=0.02) and np.allclose(got.sum(axis=1), p + q)


def test_mix_tree(spark, monkeypatch):
    """Many groups, so that residual units meet on several levels."""
    from quarry.llm import mixing

    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), "ab"[i % 7 == 0]) for i in range(1200)], "doc_id long, text string, source string")
    found = mix(df).collect()
    assert len(found) == 1200
    for s in ("a", "b"):
        own = [r for r in found if "ab"[r.doc_id % 7 == 0] == s]
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) <= 1
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.05 * own[0].target


def test_mix_awkward(awkward):
    found = mix(awkward).collect()
    assert len(found) == awkward.count()
    assert all(r.taken <= 3 * r.size for r in found)


def test_targets_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 3000, None: 5}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(water_fill(sizes))


# Quality -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def references(spark):
    sf = "/root/testdata/sf0.01"
    return fit_references(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))


def slow_js(p, q):
    """Jensen-Shannon distance of two lists of shares, as entropies."""
    h = lambda x: -sum(v * np.log2(v) for v in x if v > 0)
    return max(0.0, h([(a + b) / 2 for a, b in zip(p, q)]) - (h(p) + h(q)) / 2) ** 0.5


def slow_class(c):
    if c in "#*$%&|<>":
        return "symbol"
    if c.isascii():
        if c.isalpha():
            return "upper" if c.isupper() else "vowel" if c in "aeiou" else "consonant"
        kinds = {"0123456789": "digit", " \t\x0b\x0c\r": "white", "\n": "line", ".,;:!?": "stop", "'\"-_`": "quote", "()[]{}": "bracket"}
        return next((k for own, k in kinds.items() if c in own), "other_ascii")
    return "latin" if "\u00c0" <= c <= "\u027f" else "beyond"


def test_quality(docs, rows, references):
    langs = {r.doc_id: r.lang for r in docs.collect()}
    found = {r.doc_id: r for r in quality(docs, references).collect()}
    for doc, text, _ in rows:
        w = words(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        repeated = len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})
        lines = [x for x in text.split("\n") if words(x)]
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w))
        # the distances and the verdict, by plain histograms
        classes, reference = Counter(map(slow_class, text)), references[langs[doc]]
        by_class = slow_js([classes[c] / len(text) for c in CLASSES], reference[0]) if r.word_chars >= 400 else None
        own = [sum(x in (c, c.capitalize()) for x in w) for c in COMMON_WORDS[langs[doc]]]
        by_word = slow_js([x / len(w) for x in [*own, len(w) - sum(own)]], reference[1]) if len(w) >= 100 else None
        assert r.class_distance == (None if by_class is None else pytest.approx(by_class, abs=1e-6))
        assert r.word_distance == (None if by_word is None else pytest.approx(by_word, abs=1e-6))
        assert r.kept == (not r.base_failed and (by_class or 0) <= 0.21 and (by_word or 0) <= 0.26)


def test_references(spark, references):
    """Means over the labelled documents of one half, and the same however rows lie."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    half = {r.doc_id for r in labels.where(fitting_half()).collect() if r.quality == 1}
    own = [features(r.text.encode(), "fr") for r in docs.where("lang = 'fr'").collect() if r.doc_id in half]
    own = [np.array(f[5]) / sum(f[5]) for f in own if f[0] >= 50 and 2 * f[4] <= f[0]]
    assert len(own) > 5 and references["fr"][0] == pytest.approx(np.mean(own, axis=0))
    again = fit_references(docs.repartition(5), labels.repartition(3))
    assert all((a == b).all() for lang in references for a, b in zip(references[lang], again[lang]))
    few = fit_references(docs, labels, most=10)
    assert set(few) <= set(references) and (few["en"][0] != references["en"][0]).any()
    assert fit_references(docs, labels.limit(0)) == {}


def test_verdicts_depend_on_the_document_alone(docs, references):
    whole = {r.doc_id: r.kept for r in quality(docs, references).collect()}
    for part in (docs.where("doc_id % 10 = 3"), docs.where("lang = 'fr'").limit(5)):
        assert all(whole[r.doc_id] == r.kept for r in quality(part, references).collect())


def test_quality_tells_held_out_labels(spark):
    """On sf0.1, of the half of the labels that neither references nor limits were set on."""
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    held_out = {r.doc_id: r.quality for r in labels.where(~fitting_half()).collect()}
    kept = {r.doc_id: r.kept for r in quality(docs, fit_references(docs, labels)).collect() if not r.base_failed}
    good = [kept[d] for d, q in held_out.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in held_out.items() if q == 0 and d in kept]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.12


def test_quality_awkward(awkward, references):
    found = quality(awkward, references).collect()
    assert len(found) == awkward.count()
    assert {r.n_words for r in found if r.doc_id in (1, 2, 6)} == {0} and repeated_words([b"a"] * 3) == 0 and repeated_lines(b"x\n\nx") == 1
    assert sorted((str(r.doc_id), r.text) for r in passing(awkward, references).collect()) == [("3", awkward.where("doc_id = 3").first().text)] * any(r.kept for r in found)


# Packing -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return WordEncoder(default_path()).library


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for most in (10, 37, 2048):
        for _ in range(30):
            lengths = rng.integers(1, most + 1, int(rng.integers(0, 200))).tolist()
            room = []
            for n in sorted(lengths, reverse=True):
                fit = [c for c in room if c >= n]
                if fit:
                    room[room.index(min(fit))] -= n
                else:
                    room.append(most - n)
            made, used = best_fit_decreasing(dict(Counter(lengths)), most)
            assert used == len(room)
            placed = Counter()
            for length, _, pieces, *_ in made:
                placed[length] += pieces
            assert placed == Counter(lengths)


def test_capacity_tree():
    tree = CapacityTree(20)
    tree.add(7, 2)
    tree.add(12, 1)
    assert [tree.tightest(n) for n in (1, 7, 8, 12, 13)] == [7, 7, 12, 12, None]


def check_packing(found, texts, library, most=2048):
    wanted = Counter()
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), most)):
            part = ids[start : start + most]
            wanted[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= most
    assert len(bins) <= 11 / 9 * -(-sum(r.length for r in found) // most) + 1


def test_pack(docs, rows, library):
    check_packing(pack(docs).collect(), [r[:2] for r in rows], library)


def test_pack_awkward(awkward, library):
    check_packing(pack(awkward).collect(), [(r.doc_id, r.text) for r in awkward.collect()], library)


TRICKY = [
    "a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ΑΣ. x.y, it's. he'll, 3.5 don't.", "\x1ca\x85b c d", "é ́x Straße, ẞ. 한국어 글. ﬁ ½ Ⅷ.", "", ".,", "a.. b.,", "K. Ω,",
    "x’s don’t it’s á é́ ΑΣΑΣ ñandú, É. 1.5kg #tag a_b <| |> < |x| can't", "\x01a \x7f b​c  d ١٢ ²", "Ωmega. ǅ ŉ ß.",
]


def test_word_encoder(rows, library):
    encoder = WordEncoder(default_path())
    for at in range(0, len(rows), 32):
        texts = [t for _, t, _ in rows[at : at + 32]] + TRICKY
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts)
        for text, part in zip(texts, np.split(ids, ends[:-1])):
            assert part.tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_encoder_on_random_characters(library):
    rng, encoder = random.Random(1), WordEncoder(default_path())
    for _ in range(100):
        texts = ["".join(rng.choices("aZ÷é'.,!<|>#1 \t\n’ΑΣσßǅ́한İıſK½5€-_×ÿŉ\x01", k=rng.randint(0, 40))) for _ in range(50)]
        ids, counts = encoder.encode(texts)
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_batches():
    texts = ["a" * n for n in (3, 0, 5, 100, 1, 1, 9)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    parts = [b.column(0).to_pylist() for b in byte_batches(batch.slice(1), most=10)]
    assert parts == [[1, 2], [3], [4, 5], [6, 7]]


# Sharding ------------------------------------------------------------------------------------------------------------


def check_shards(found, texts, n, order_key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / n) <= 2 * largest
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [order_key(r) for r in ordered] == sorted(order_key(r) for r in found)


def test_shards(docs, rows):
    check_shards(shard_by_bytes(measured(docs), 40, ["doc_id", "size", "text_crc32"]).collect(), [r[:2] for r in rows], 40)


def test_shards_awkward(awkward):
    check_shards(shard_by_bytes(measured(awkward), 3, ["doc_id", "size", "text_crc32"]).collect(), [(r.doc_id, r.text) for r in awkward.collect()], 3)


def test_shards_stay_in_the_jvm(docs):
    plan = shard_by_bytes(measured(docs), 40, ["doc_id", "size", "text_crc32"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_selected(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", None) for i in range(500)], "id long, text string, x int").repartition(6)
    keyed = common.numbered(common.materialize(rows, "test-rows"), "n")
    every = {r.id: r.n for r in keyed.collect()}
    wanted = Counter({i: 1 + i % 3 for i in range(0, 500, 7)})
    marks = spark.createDataFrame([(every[i],) for i in wanted.elements()], "m long").repartition(3)
    found = common.selected(keyed, marks, "n")
    assert Counter(r.id for r in found.collect()) == wanted and found.columns == ["id", "text", "x", "n"]
    assert common.selected(keyed, marks.limit(0), "n").count() == 0


# Empty tables --------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, awkward):
    empty = awkward.limit(0)
    for operator in (exact_duplicates, near_duplicates, mix, pack, lambda d: quality(d, {}), lambda d: passing(d, {})):
        assert operator(empty).count() == 0
    assert shard_by_bytes(measured(empty), 40, ["doc_id", "size", "text_crc32"]).count() == 0


def test_base32():
    from quarry.llm.warc import sha1_base32

    assert sha1_base32(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()
