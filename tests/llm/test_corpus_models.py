"""The manifest, the phrases and the language model against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import hmm, merkle, midstate, phrases, registered
from ledgerlight.llm import words as W
from tests.llm.fixtures import SCHEMA, corpus, documents, words

LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_midstates_are_sha256():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(40)]
    blocks = midstate.hex_blocks(midstate.unpack(b"".join(digests)))
    state = midstate.fresh(40)
    assert midstate.pack(midstate.finish(state, np.zeros(40))) == hashlib.sha256(b"").digest() * 40
    for k in range(1, 10):
        state = midstate.compress(state, np.roll(blocks, k, axis=0))
        want = [hashlib.sha256("".join(digests[(i - j) % 40].hex() for j in range(1, k + 1)).encode()).digest() for i in range(40)]
        assert midstate.pack(midstate.finish(state, np.full(40, k))) == b"".join(want)


def plain_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        by[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in by[k]])
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for place, k in enumerate(names):
        for i, r in enumerate(by[k]):
            now, others = leaf(r), []
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                now = leaf({**r, "text": r["text"].translate(LOW)})
            for tree, at in ((trees[k], i), (top, place)):
                for level in tree[:-1]:
                    run = level[at - at % 8 :][:8]
                    others += run[: at % 8] + run[at % 8 + 1 :]
                    now = sha("".join([*run[: at % 8], now, *run[at % 8 + 1 :]]))
                    at //= 8
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], sha("".join(others)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_of_hard_rows(spark):
    got = merkle.manifest(documents(spark)).collect()
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in corpus()]
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)
    assert merkle.manifest(documents(spark, [])).count() == 0


def test_manifest_over_several_rounds(spark):
    rows = [(i, f"Text {i % 90}" if i % 7 else None, ("en", "xx", None, "")[0 if i < 1200 else i % 4], "s", i, 0, 0) for i in range(1230)]
    frame = documents(spark, rows).repartition(7)
    got = merkle.manifest(frame).collect()
    want = plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.verified for r in got} == {True, False}


def plain_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        kept = []
        for p, a in found.items():
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            worth, k = min(cuts)
            inside = any(len(q) > len(p) and n >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in found.items())
            if not inside:
                kept.append((-worth, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -worth) for i, (worth, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def speech(seed, n):
    rng = random.Random(seed)
    pool = ["The", "of", "and", "größe", "to", "new", "york", "😀", "in", "x-y", "café"]
    return "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", " , ", ";"]) for _ in range(n))


@pytest.mark.parametrize("least,top", [(3, 2000), (9, 25)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = [(i, speech(i, 90), "en" if i % 3 else None, "s", 0, 0, 0) for i in range(40)] + corpus()
    rows += [(99, "new york new york. " * 60, "en", "s", 0, 0, 0)] * 3
    got = phrases.collocations(documents(spark, rows).repartition(5), least, top).collect()
    want = plain_phrases([(r[1], r[2]) for r in rows], least, top)
    assert sorted(map(tuple, got)) == want and len(want) > 30
    assert phrases.collocations(documents(spark, []), least, top).count() == 0


def test_phrases_with_a_full_table_and_shared_hashes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 1 << 16)
    monkeypatch.setattr(phrases, "SLICE", 1 << 12)
    rows = [(i, speech(i + 50, 60), "de", "s", 0, 0, 0) for i in range(20)]
    got = phrases.collocations(documents(spark, rows), 4, 500).collect()
    assert sorted(map(tuple, got)) == plain_phrases([(r[1], r[2]) for r in rows], 4, 500)
    one = np.array([5, 5, 5, 7], np.uint64)
    at, counts = phrases._distinct(one, np.array([1, 2, 1, 9], np.uint64))
    assert sorted(zip(at.tolist(), counts.tolist())) == [(0, 2), (1, 1), (3, 1)]


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9_000_000_000, 16_000_000_000_000, 9_000_000_001, 31_000_000_007
    row = spark.range(1).select(phrases.score(F.lit(a), F.lit(n), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


def test_words_of_any_text():
    texts = ["Größe  x\tY", "", " \n", "😀a 😀a A", "q"]
    found = W.words(texts, hmm.TABLE)
    data = found.data.tobytes()
    got = [[data[found.start[i] : found.end[i]].decode() for i in range(found.first[t], found.first[t + 1])] for t in range(len(texts))]
    assert got == [t.translate(LOW).split() for t in texts]
    h = found.hashed()
    assert h[3] == h[4] != h[1] and len(set(h.tolist())) == 6


def chain(seed):
    rng = np.random.default_rng(seed)
    part = lambda *shape: rng.random(shape) + 0.05
    start, move, emit = part(hmm.STATES), part(hmm.STATES, hmm.STATES), part(hmm.CLASSES, hmm.STATES)
    return hmm.Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_equals_all_state_paths():
    model, rng = chain(1), np.random.default_rng(2)
    codes = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (3, 1, 4, 1)]
    found = hmm.Sequences(codes)
    _, logs = found.forward(model, model.emit[found.codes])
    for c, got in zip(codes, logs):
        total = 0.0
        for way in itertools.product(range(hmm.STATES), repeat=len(c)):
            p = model.start[way[0]] * model.emit[c[0], way[0]]
            for t in range(1, len(c)):
                p *= model.move[way[t - 1], way[t]] * model.emit[c[t], way[t]]
            total += p
        assert got == pytest.approx(math.log(total), rel=1e-9)


def test_expected_counts_and_long_sequences():
    model, rng = chain(3), np.random.default_rng(4)
    codes = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (70, 1, 33, 400, 33)]
    start, moves, seen, logs = hmm.Sequences(codes).expected(model)
    want_start, want_moves, want_seen, want_logs = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.CLASSES, hmm.STATES)), 0.0
    for c in codes:
        a = [model.start * model.emit[c[0]]]
        scale = [a[0].sum()]
        a[0] = a[0] / scale[0]
        for t in range(1, len(c)):
            x = (a[-1] @ model.move) * model.emit[c[t]]
            scale.append(x.sum())
            a.append(x / x.sum())
        b = [np.ones(hmm.STATES)]
        for t in range(len(c) - 2, -1, -1):
            b.insert(0, model.move @ (model.emit[c[t + 1]] * b[0]) / scale[t + 1])
        want_start += a[0] * b[0]
        for t in range(len(c)):
            want_seen[c[t]] += a[t] * b[t]
            if t:
                want_moves += np.outer(a[t - 1], model.emit[c[t]] * b[t]) * model.move / scale[t]
        want_logs += np.log(scale).sum()
    assert np.allclose(start, want_start) and np.allclose(moves, want_moves) and np.allclose(seen, want_seen)
    assert logs == pytest.approx(want_logs)
    assert seen.sum() == pytest.approx(sum(map(len, codes)))


def plain_base(rows):
    tokens = [re.findall("[^ \t-\r]+", (t or "").translate(LOW)) + [None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, o in zip(tokens, out) if not o for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, o, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t, o in zip(rows, tokens, out)), key=repr)


@pytest.mark.parametrize("hot", [3, 100_000])
def test_base_scores_and_a_better_model(spark, hot):
    rows = corpus() + [(100 + i, " ".join(random.Random(i).choices(words(i % 2, 12), k=60)), None, None, 0, 0, 0) for i in range(60)]
    got = hmm.score_texts(documents(spark, rows).repartition(3), hot_words=hot).collect()
    keep = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
    assert sorted(map(keep, got), key=repr) == plain_base([(r[0], r[1]) for r in rows])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 100]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_training_does_not_lose_likelihood(spark):
    rows = [(i, " ".join(random.Random(i).choices(words(i % 3, 9), k=50)), None, None, 0, 0, 0) for i in range(50)]
    docs = documents(spark, rows)
    frame = spark.createDataFrame([(bytes(np.random.default_rng(i).integers(0, 40, 60).astype(np.uint16).tobytes()),) for i in range(30)], "codes binary")
    model = hmm.first_chain(np.ones((hmm.CLASSES, 2)))
    logs = []
    for _ in range(4):
        model, found = hmm.improved(frame, model)
        logs.append(found)
    assert logs == sorted(logs) and np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    assert docs.count() == 50


def test_model_without_training_rows(spark):
    assert hmm.score_texts(documents(spark, [])).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score_texts(spark.createDataFrame([(out, "a b", None, None, 0, 0, 0)], SCHEMA)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(row.score)


def test_registered_columns(spark, sf):
    found = registered.op11_merkle_manifest(spark, sf)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows)
    found = registered.op12_collocations(spark, sf)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_phrases([(r["text"], r["lang"]) for r in rows], 100, 2000)
