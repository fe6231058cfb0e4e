import hashlib
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from ledgerlight.llm import bpe, mixing, wide_simhash
from tests.llm.fixtures import SCHEMA, corpus, documents, words


def goals(sizes: dict, share=1.5, cap=2.0, weights=(3.0, 1.0, 2.0)) -> dict:
    """Targets by repeated resharing of what is above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), None, ["a", "b", "é", None, "c"][min(4, int(rng.integers(0, 9)))], 0, 1, 2) for i in range(900)]
    rows += [(None, "no id", None, "a", 0, 1, 2), (5, None, None, None, 0, 1, 2)] + rows[:3]
    docs = documents(spark, rows)
    found = mixing.mix(docs, block=block).collect()
    assert len(found) == len(rows)
    sizes: dict = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = goals(sizes), dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.times <= 2
        taken[r.source] += r.size * r.times
    assert all(taken[s] == pytest.approx(want[s], rel=0.005) for s in sizes)
    again = mixing.mix(docs.repartition(7), block=block).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    out = mixing.mixed_documents(docs, block=block)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in found)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, chance = rng.integers(1, 500, 800), np.full(800, 0.37)
    out = mixing.flight(size, chance, rng, land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(800 * 0.37) and (out * size).sum() == pytest.approx((chance * size).sum())
    landed = mixing.flight(size, chance, rng, land=True)
    assert set(landed) <= {0.0, 1.0} and (landed * size).sum() == pytest.approx((chance * size).sum(), rel=0.002)


def test_inclusion_probabilities():
    size = np.array([3, 8, 20, 1, 5, 9, 2, 40, 7, 6] * 4)
    share = np.mean([mixing.flight(size, np.full(40, 0.3), np.random.default_rng(k), True) for k in range(600)], 0)
    # landing twelve of so few units favours those that fit; the flight alone does not
    assert np.abs(share - 0.3).max() < 0.2 and share.mean() == pytest.approx(0.3, abs=0.02)
    share = np.mean([mixing.flight(size, np.full(40, 0.3), np.random.default_rng(k), False) for k in range(2000)], 0)
    assert np.abs(share - 0.3).max() < 0.05


def test_mix_edges(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    only = mixing.mix(documents(spark, [(1, None, None, None, 0, 0, 0), (2, " ", None, "a", 0, 0, 0)])).collect()
    assert {(r.size, r.target, r.times) for r in only} == {(0, 0.0, 0)}


def test_pipeline(spark, tmp_path):
    lines = [" ".join(words(100 + i, 40)) for i in range(60)]
    extra = [(100 + i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t), 0, 0) for i, t in enumerate(lines)]
    rows = corpus() + extra + [(300, lines[0] + " tail", "en", "s1", 0, 0, 0), (301, "  " + lines[1], "de", "s1", 0, 0, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents(spark, rows)
    # the model is trained on the documents; the stage keeps what it calls known
    kept = [tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect()]
    assert all(any(c.isalpha() for c in r[1]) for r in kept)
    lost = {r[0] for r in rows} - {r[0] for r in kept}
    assert {5, 6, 7, 17} <= lost
    # brute force: exact copies, then near copies, then what the mix takes
    first: dict = {}
    for r in sorted(kept, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)):
        first.setdefault("".join(re.split(r"[\x20\x09-\x0D]", r[1])), r)
    unique = sorted(first.values(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [set(wide_simhash.shingle_set(r[1]).tolist()) for r in unique]
    part = list(range(len(unique)))
    for a in range(len(unique)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    single = [r for k, r in enumerate(unique) if part[k] == k]
    assert 300 not in {r[0] for r in single} and len(single) < len(unique) < len(kept)
    stage = docs
    for name, work in corpus_pipeline.STAGES[:3]:
        path = str(tmp_path / name)
        work(spark, stage, "").write.parquet(path)
        stage = spark.read.parquet(path)
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id or -1, r.text) for r in stage.collect()) == sorted((r[0] or -1, r[1]) for r in single)
    times = {(r.doc_id, r.text_key): r.times for r in mixing.mix(stage).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == sum(times.values())
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    texts = {r[0]: r[1] for r in single}
    for r in out:
        assert r.ids == peer.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
