import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import common, exact_dedup, golomb, simhash, suffixes, wide_simhash
from tests.llm.fixtures import corpus, documents, words


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=300))
def test_golomb_round_trip(values):
    given_ = np.array(sorted(values), np.uint64)
    data, width = golomb.encode(given_, 2**40)
    assert (golomb.decode(data, width, len(given_)) == given_).all()


def groups(rows, near):
    """Smallest id reachable, by comparing all pairs."""
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near(a, b) and part[a] != part[b]:
                part = [part[b] if p == part[a] else p for p in part]
    low = {}
    for p, (i, *_) in zip(part, rows):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return [low.get(p) for p in part]


def by_row(found, *columns):
    return sorted([tuple(r[c] for c in columns) for r in found.collect()], key=repr)


@pytest.mark.parametrize("limit", [2000, 1])
def test_simhash_components(spark, limit):
    rng = np.random.default_rng(3)
    prints = [simhash.fingerprint_of(r[1] or "") for r in corpus()]
    want = groups(corpus(), lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3)
    got = by_row(simhash.near_duplicates(documents(spark), bucket_limit=limit), "doc_id", "fp", "component_id")
    assert got == sorted(zip([r[0] for r in corpus()], prints, want), key=repr)
    # a dense cloud around two centres, and chains
    fps = {int(c ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in (2**62 - 12345, 987654321) for k in (0, 1, 2, 3, 4) for _ in range(12)}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), limit)
    found = {r.node: r.component for r in simhash.connected_components(pairs).collect()}
    want = groups([(f,) for f in fps], lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3)
    assert [found.get(f, f) for f in fps] == want


def test_simhash_words():
    assert simhash.fingerprint_of("") == simhash.fingerprint_of(" \n") == 0
    assert simhash.fingerprint_of("A b C") == simhash.fingerprint_of("a\tB  c") != simhash.fingerprint_of("a b")
    assert simhash.fingerprint_of("É b") != simhash.fingerprint_of("é b")


@pytest.mark.parametrize("owner_rows", [1_000_000, 3])
def test_exact_duplicates(spark, owner_rows):
    rows = [(i, exact_dedup.normalised(t or ""), len(t or "")) for i, t, *_ in corpus()]
    found = exact_dedup.exact_duplicates(documents(spark).repartition(4), owner_rows=owner_rows)
    want = []
    for i, body, n in rows:
        same = sorted((-m, j is None, j or 0) for j, other, m in rows if other == body)
        want.append((i, None if same[0][1] else same[0][2], len(same), hashlib.sha256(body).hexdigest()))
    got = by_row(found.selectExpr("doc_id", "keep_id", "group_size", "lower(hex(sha)) AS sha"), "doc_id", "keep_id", "group_size", "sha")
    assert got == sorted(want, key=repr)
    assert found.where("kept").count() == len({b for _, b, _ in rows})
    kept = exact_dedup.distinct_documents(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len({b for _, b, _ in rows})


def test_passages(spark):
    texts = {i: (t or "").encode().split() for i, t, *_ in corpus() if i is not None}
    n, held = suffixes.MIN_WORDS, {}
    for i, w in texts.items():
        for k in range(len(w) - n + 1):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for i, w in texts.items():
        spans = []
        for k in range(len(w) - n + 1):
            if len(held[tuple(w[k : k + n])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + n
                else:
                    spans.append([k, k + n])
        want += [(i, a, b) for a, b in spans]
    found = suffixes.passages(documents(spark))
    assert by_row(found, "doc_id", "start", "end") == sorted(want, key=repr)
    assert {8: {9, 10}, 9: {8, 10}}.items() <= {r.doc_id: set(r.other_docs) | ({8, 9, 10} - {r.doc_id}) for r in found.collect()}.items()


def test_passages_of_a_frequent_run_over_many_ranges(spark):
    # every text holds the frequent run, each shares 50 words with one other: 42 before the run for half of them
    # (a run of small hash, so that it is the minimiser of nearly all windows that hold it)
    own = suffixes.word_hashes(" ".join(words(600, 20_000)))
    place, gram = suffixes.anchors(own)
    at = int(place[gram.argmin()])
    line, rows = words(600, 20_000)[at : at + 8], []
    for k in range(400):
        left, right = words(10_000 + k, 42), words(20_000 + k, 42)
        for j in (0, 1):
            at = 30_000 + 2 * k + j
            before = left if k % 2 else words(40_000 + at, 42)
            after = words(at, 42) if k % 2 else right
            rows.append((2 * k + j, " ".join(before + line + after)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.doc_id, r.start, r.end) for r in suffixes.passages(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {(i, 0, 50) if i // 2 % 2 else (i, 42, 92) for i, _ in rows}


def test_passages_of_a_common_passage_over_many_ranges(spark, monkeypatch):
    # every suffix is one row in every step, not one for each window around it
    line, saved = words(700, 60), []
    rows = [(k, " ".join([f"b{k}x{j}" for j in range(42)] + line + [f"a{k}x{j}" for j in range(42)])) for k in range(300)]
    keep = suffixes.materialise
    monkeypatch.setattr(suffixes, "materialise", lambda df: saved.append(keep(df)) or saved[-1])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffixes.passages(spark.createDataFrame(rows, "doc_id long, text string"))
        # codes of 16 bits: a word beside the passage may match by chance
        got = [(r.doc_id, r.start, r.end) for r in found.collect()]
        assert sorted((k, max(a, 42), min(b, 102)) for k, a, b in got) == [(k, 42, 102) for k, _ in rows] and all(a >= 40 and b <= 104 for _, a, b in got)
        ordered, turned, matched = [f.count() for f in saved]
        assert ordered >= turned >= matched >= 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_similar_documents(spark):
    rows = [(i, t) for i, t, *_ in corpus()]
    sets = [set(wide_simhash.shingle_set(t or "").tolist()) for _, t in rows]
    want = groups(rows, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert by_row(wide_simhash.near_documents(documents(spark)), "doc_id", "component_id") == sorted(zip([r[0] for r in rows], want), key=repr)


def test_similar_short_and_long_documents(spark):
    # pairs at the similarity itself, of few shingles and of many, and a common line
    rows, line = [], words(77, 12)
    for k in range(150):
        own = words(1000 + k, 9)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:8]))]
    for k in range(60):
        own = words(3000 + k, 130) + line
        a, b = own + words(4000 + k, 18), own + words(5000 + k, 12)
        rows += [(1000 + 2 * k, " ".join(a)), (1001 + 2 * k, " ".join(b))]
    sets = [set(wide_simhash.shingle_set(t).tolist()) for _, t in rows]
    want = groups(rows, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(i != c for (i, _), c in zip(rows, want)) == 210
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(wide_simhash.near_documents(docs), "doc_id", "component_id") == sorted(zip([r[0] for r in rows], want), key=repr)


def test_near_documents_by_fingerprint(spark, monkeypatch):
    # close copies are linked by their SimHash: they are there when the join that completes them makes no candidate
    own = [words(7000 + k, 400) for k in range(6)]
    rows = [(10 * k + j, " ".join(w[:-1] + words(8000 + 10 * k + j, 1))) for k, w in enumerate(own) for j in range(3)]
    prints = [wide_simhash.fingerprint(wide_simhash.shingle_set(t)) for _, t in rows]
    want = groups(list(zip([i for i, _ in rows], prints)), lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= simhash.MAX_BITS)
    assert len(set(want)) < len(rows)
    monkeypatch.setattr(wide_simhash, "_shared", lambda cells: np.zeros(1 << (wide_simhash.FILTER_BITS - 6), np.uint64))
    found = wide_simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(found, "doc_id", "component_id") == sorted(zip([i for i, _ in rows], want), key=repr)


def near_copies_of_one_text(n, changed):
    own = words(9000, 150)
    rows = []
    for k in range(n):
        rng = np.random.default_rng(k)
        w = list(own)
        for at in rng.choice(150, changed + k % 3, replace=False):
            w[at] = words(9100 + 200 * k + int(at), 1)[0]
        rows.append((k, " ".join(w)))
    return rows


def test_pairs_of_a_crowded_shingle_leave_once():
    # a group of copies that are more or less alike: far pairs stay in the task, the others come once, not once a shingle
    sets = [wide_simhash.shingle_set(t) for _, t in near_copies_of_one_text(120, 1)]
    prefixes = [wide_simhash.prefix(s, np.zeros(1 << wide_simhash.BUCKET_BITS, bool), 0.8) for s in sets]
    held = [(int(c), p, len(s), k, k) for k, (s, x) in enumerate(zip(sets, prefixes)) for p, c in enumerate(x.view(np.int64))]
    columns = [np.array(x, np.int64) for x in zip(*held)]
    sketches = np.frombuffer(b"".join(wide_simhash.sketch(sets[k]) for k in columns[3]), np.uint64).reshape(len(held), -1)
    crowds = [frozenset(prefixes[k].view(np.int64).tolist()) for k in columns[3]]
    found = [(int(a), int(b), int(n)) for part in wide_simhash.candidates(*columns, 0.8, sketches, crowds) for a, b, n, _ in zip(*part)]
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(120) for b in range(a + 1, 120)}
    near = {(a, b) for (a, b), c in common.items() if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c)}
    assert len({x[:2] for x in found}) == len(found) and near <= {x[:2] for x in found}
    assert 100 < len(near) and len(found) < 0.6 * len(common)
    assert all(n == len(np.intersect1d(prefixes[a], prefixes[b])) for a, b, n in found)


def test_similar_documents_of_a_crowded_shingle(spark, monkeypatch):
    monkeypatch.setattr(wide_simhash, "CROWD_ROWS", 3)
    rows = near_copies_of_one_text(60, 1) + [(100 + i, t) for i, t, *_ in corpus()[:15] if i is not None]
    sets = [set(wide_simhash.shingle_set(t or "").tolist()) for _, t in rows]
    want = groups(rows, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(wide_simhash.near_documents(docs), "doc_id", "component_id") == sorted(zip([r[0] for r in rows], want), key=repr)


def test_crowded_cells_are_compared_without_an_object_each():
    # 719,400 near pairs that share 12 crowded cells: they are compared in arrays, a bounded part at a time
    nodes, cells = 1200, frozenset(range(-4, 8))
    column = lambda v: np.full(nodes, v, np.int64)
    sketches = np.zeros((nodes, wide_simhash.SKETCH_BITS // 64), np.uint64)
    for cell, pairs in ((-4, nodes * (nodes - 1) // 2), (3, 0)):
        tracemalloc.start()
        found = sum((n == 12).sum() for _, _, n, _ in wide_simhash.candidates(column(cell), column(5), column(300), np.arange(nodes), np.arange(nodes), 0.8, sketches, [cells] * nodes))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == pairs and peak < 150e6


@pytest.mark.parametrize("held", [250_000, 7])
def test_shared_crowded_cells(monkeypatch, held):
    monkeypatch.setattr(wide_simhash, "HELD_PAIRS", held)
    rng = np.random.default_rng(1)
    rows = [{99, *(rng.choice(40, rng.integers(1, 12), replace=False) - 20).tolist()} for _ in range(60)]
    a, b = rng.integers(0, 60, (2, 500))
    n, least = wide_simhash.Crowds(pa.array(map(list, rows), pa.list_(pa.int64()))).shared(a, b)
    assert n.tolist() == [len(rows[x] & rows[y]) for x, y in zip(a, b)] and least.tolist() == [min(rows[x] & rows[y]) for x, y in zip(a, b)]


def test_similar_documents_when_little_is_held(spark, monkeypatch):
    # every batch is worked on as it comes; the rows of its last cell wait for the next one
    monkeypatch.setattr(wide_simhash, "CROWD_ROWS", 3)
    monkeypatch.setattr(wide_simhash, "HELD_BYTES", 1)
    rows = near_copies_of_one_text(60, 1)
    sets = [set(wide_simhash.shingle_set(t).tolist()) for _, t in rows]
    want = groups(rows, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    old = spark.conf.get(common.BATCH_SETTING)
    spark.conf.set(common.BATCH_SETTING, "20")
    try:
        assert by_row(wide_simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id") == sorted(zip([i for i, _ in rows], want), key=repr)
    finally:
        spark.conf.set(common.BATCH_SETTING, old)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(none).count() == exact_dedup.exact_duplicates(none).count() == suffixes.passages(none).count() == 0
    assert wide_simhash.representatives(none).count() == exact_dedup.distinct_documents(none).count() == 0
