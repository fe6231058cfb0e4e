import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, chat, langid, lz, secrets, toxicity
from tests.llm.fixtures import corpus, documents, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(codec, peer, text):
    (ids,) = codec.encode([text])
    assert ids.tolist() == peer.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_long_pieces(codec, peer):
    for text in ("a" * 3000, "ab" * 700, " " * 600, "é" * 400, "日本語" * 200, "".join(words(9, 400)), "don't we'll 12"):
        assert codec.encode([text])[0].tolist() == peer.encode_ordinary(text)


def test_bpe_table(spark, peer):
    tokens = bpe.encode(documents(spark).drop("row"), PATH, public_tokenizers.PATTERN)
    assert tokens.columns == ["doc_id", "lang", "source", "n_chars", "size", "ids"]
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.decode(tokens, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    assert got == sorted(((i, peer.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in corpus()), key=repr)
    assert bpe.decode(bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</part>", "#", "\\", "<", "</", "a\nb", "", None, "</turn>\n### user: x", "\\#\\</\\/", "😀 #"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "od:d#", None]), rng.choice(nasty)) for c in (1, 2, 3, None) for t in (0, 0, 1, None, 5, 6, 7, 8, 9)]
    rows += [rows[0]] * 2
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    out = chat.read_back(chat.format_chats(frame)).collect()
    assert len(out) == 4
    for r in out:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert list(r.learnt) == [x[3] for x in own if x[2] == "assistant"]
        blocks = sum(1 for a, b in zip([None, *own], own) if a is None or a[2] != b[2])
        assert r.formatted.count("</turn>\n") == blocks
    assert chat.format_chats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_lz_neighbours(spark, parts):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        a, b, c = map(lz.fingerprint_of, (t, edited, after))
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), lz.printed(a), lz.printed(b), lz.likeness(a, b), lz.likeness(a, c)))
    got = [tuple(r) for r in lz.neighbour_fingerprints(documents(spark), parts).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lz.neighbour_fingerprints(documents(spark, [])).count() == 0
    one = lz.neighbour_fingerprints(documents(spark, corpus()[:1]), parts).first()
    assert one.near_next == 1.0 and lz.fingerprints(documents(spark, corpus()[:1])).first().fingerprint == one.fingerprint


def test_lz_likeness():
    a, b = (" ".join(words(s, 400)) for s in (20, 21))
    f = lz.fingerprint_of
    assert lz.likeness(f(a), f(a)) == 1 and lz.likeness(f(""), f("")) == 1 and lz.likeness(f(""), f(a)) == 0
    assert lz.likeness(f(a), f(a + " more")) > 0.8 > lz.likeness(f(a), f(a[:1200] + b)) > lz.likeness(f(a), f(b))


def test_secrets(spark):
    key, own = "AKIA" + "A1B2C3D4E5F6G7H8", "tokEN: 'abcDEF123456'"
    mixed = "aB3" + "x9Yz" * 6
    rows = [(1, f"é {own} {key}", "a"), (2, f"{key} api_key=short", "b"), (3, f"{key} x", "c"), (4, "0123456789abcdef" * 2 + f" {mixed}", "a"), (5, None, None),
            (6, f"{mixed}", "b"), (7, f"{mixed}", "c"), (8, "Qw3" + "e5Rt" * 6, None), (None, "passwd = = x", "a")]
    frame = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, spans int")
    got = {r.doc_id: [(s.start, s.end, s.kind, s.n_owners, s.live) for s in r.spans] for r in secrets.find_secrets(frame).collect()}
    assert got[1] == [(2, 1 + len(own), 0, 1, True), (3 + len(own), 3 + len(own) + len(key), 1, 3, False)]
    assert [s[2:] for s in got[2]] == [(1, 3, False)] and got[5] == got[None] == []
    assert [s[2] for s in got[4]] == [2] and got[6] == [] and got[8] == [(0, 27, 3, 1, True)]
    for i, t, _ in rows:
        for s, e, kind, *_ in got[i]:
            assert (t[s:e].lower().startswith("tok"), t[s:e] == key, re.fullmatch("[0-9a-f]+", t[s:e]) is not None, kind == 3)[kind]
    assert secrets.find_secrets(frame.limit(0)).count() == 0
    # one owner, many repositories: a copied example; few repositories: live
    frame = spark.createDataFrame([(i, f"x {key}", "a") for i in range(12)] + [(20 + i, f"x {key}9", "a") for i in range(9)], "doc_id long, text string, source string")
    got = {r.doc_id: [(s.n_owners, s.n_repos, s.live) for s in r.spans] for r in secrets.find_secrets(frame).collect()}
    assert all(v == ([(1, 12, False)] if i < 20 else [(1, 9, True)]) for i, v in got.items()) and len(got) == 21


def languages(n: int):
    rng = random.Random(5)
    stock = {"aa": "the of and ing tion er", "bb": "el de la cion ñez os", "cc": "der die und ung ßen ich"}
    return [(i, " ".join(rng.choice(stock[lang].split()) + rng.choice("aeiou") for _ in range(rng.randint(3, 60))), lang) for i, lang in ((i, rng.choice(list(stock))) for i in range(n))]


def test_language_id(spark):
    rows = [*languages(400), (400, None, "aa"), (401, "123 ?!", "bb"), (402, "the ending", None), (None, "de la ciones", None)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    found = langid.identify(frame).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (400, 401)} == {400: "und", 401: "und"}
    kept = langid.known_language(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r[0] or -1) for r in rows if r[0] not in (400, 401))
    assert langid.identify(frame.limit(0)).count() == 0
    assert {r.doc_id for r in langid.known_language(frame.where("doc_id >= 398").withColumn("lang", F.lit(None).cast("string"))).collect()} == {398, 399, 402}
    assert {r.lang_pred for r in langid.identify(frame.withColumn("lang", frame.lang.substr(9, 1)).where("lang = 'x' OR doc_id < 3")).collect()} <= {"und", ""}


def test_deobfuscation():
    total = toxicity.trigram_counts(["stinker " * 50, "rotten, " * 40, "the " * 500 + "AND " * 400, "house " * 80 + "letter 1 " * 60])
    table = (total + 0.05).reshape(-1, toxicity.ALPHABET)
    model = np.log(table / table.sum(1, keepdims=True)).ravel().tolist()
    for hidden, plain in (("st1nker", "stinker"), ("$t!nk3r", "stinker"), ("s.t.i.n.k.e.r", "stinker"), ("stiiiinkerrr", "stinker"), ("r0tt3n", "rotten"), ("hou5e", "house")):
        assert toxicity.restored(hidden, model) == plain
    assert toxicity.forms("$tinker,", model) == ("tinker", "stinker") and toxicity.forms("letter!!", model) == ("letter",)
    reader = toxicity.Reader(np.array(model), lambda words: words)
    assert reader.read("The s t. i n k e r house")[-1] == ("stinker",)
    assert reader.read("x y") == [(), ()] and reader.read("") == []


def plain_model(*texts):
    table = (toxicity.trigram_counts(list(texts)) + 0.05).reshape(-1, toxicity.ALPHABET)
    return np.log(table / table.sum(1, keepdims=True)).ravel().tolist()


def test_signs_at_edges():
    model = plain_model("idiot cretin the house " * 80)
    for hidden, plain in (("!diot", "idiot"), ("(retin", "cretin"), ("*diot", "idiot"), ("\"!diot\",", "idiot")):
        assert plain in toxicity.forms(hidden, model)
    assert toxicity.forms("(house)!", model)[0] == "house"


def test_long_and_doubled():
    model = plain_model("stinker letter the house " * 80)
    for hidden in ("st" + 45 * "i" + "nker", "stiinker", ".".join("stinker") + 40 * ".", "-" * 45 + "st1nker"):
        assert "stinker" in toxicity.forms(hidden, model)
    assert toxicity.forms("letter", model) == ("letter",)
    long = toxicity.forms(".".join("thehousestinkerthehousestinker"), model)
    assert len(long) > 1 and all(long)


def test_toxicity(spark):
    rng = random.Random(8)
    plain, bad = words(30, 300), ["stinker", "rotten", "villain"]
    hide = lambda w: w.replace("i", "1").replace("o", "0") if rng.random() < 0.5 else w
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice(plain) for _ in range(30)]
        for _ in range(2 * toxic):
            text[rng.randrange(30)] = hide(rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(600, None), (None, "stinker rotten"), (601, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(found) == len(rows)
    held = [(found[i].predicted, y) for i, y in labels if found[i].held_out]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.97
    assert found[600].predicted == found[601].predicted == 0 and found[None].predicted == 1
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
