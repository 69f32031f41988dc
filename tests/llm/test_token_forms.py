"""Byte-level BPE, fill-in-middle and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from motifspark.llm import byte_bpe as B
from motifspark.llm import fill_middle as M
from motifspark.llm import spelling_variants as S

sha = lambda raw: hashlib.sha256(raw).hexdigest()

# ---- byte-level BPE ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(B.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(B.read_ranks(B.RANKS))


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    tokens = list(vocabulary.ranks)
    assert sorted(vocabulary.hash.slots(tokens)) == list(range(len(tokens)))
    assert [vocabulary.tokens[s] for s in vocabulary.hash.slots(tokens)] == tokens
    for n in (0, 1, 2, 5):
        small = B.PerfectHash([b"%d" % i for i in range(n)])
        assert sorted(small.slots([b"%d" % i for i in range(n)])) == list(range(n))
        assert all(0 <= s < max(n, 1) for s in small.slots([b"other", b""]))


def test_encoding_equals_the_library(docs, texts, library):
    rows = B.encode(docs).collect()
    assert len(rows) == len(texts)
    by = dict(texts)
    for r in rows:
        assert r.ids == library.encode_ordinary(by[r.doc_id] or ""), r.doc_id
    back = {r.doc_id: bytes(r.decoded) for r in B.decode(B.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in texts}


def test_every_character_is_cut_like_the_library(vocabulary, library):
    encoder = B.Encoder(vocabulary)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    text = ["".join(f"a{chr(c)}{chr(c)}1 {chr(c)}  x'{chr(c)}" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    ids, bounds = encoder.encode([t.encode() for t in text])
    assert all(ids[a:b].tolist() == library.encode_ordinary(t) for a, b, t in zip(bounds, bounds[1:], text))


def test_merges_of_random_and_long_pre_tokens(vocabulary, library, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(B, "CACHE", 3)
    encoder = B.Encoder(vocabulary)
    text = ["".join(rng.choices("aab" if k % 2 else "etaoinsh.=é漢", k=rng.randint(1, 60))) for k in range(400)]
    text += ["a" * 60_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "=" * 5000 + "\n" * 5000, "I'll we've 'S"]
    ids, bounds = encoder.encode([t.encode() for t in text])
    assert all(ids[a:b].tolist() == library.encode_ordinary(t) for a, b, t in zip(bounds, bounds[1:], text))


def test_bpe_digest_and_edges(spark, docs, none, texts, library):
    by = dict(texts)
    for r in B.digest(B.encode(docs)).collect():
        raw, ids = (by[r.doc_id] or "").encode(), library.encode_ordinary(by[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(raw))
    assert B.digest(B.encode(none)).count() == 0
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in B.digest(B.encode(rows)).collect()) == [0, 0, 0, 2, 2]
    lost = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in B.decode(lost).collect()} == {1: None, 2: bytearray()}


def test_ranks_must_be_whole(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        B.read_ranks(tmp_path / "few")


# ---- fill-in-middle ------------------------------------------------------------------------------------------


def plain_middle(doc, text, unit, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    hx = sha(f"{seed}:{'' if doc is None else doc}".encode())
    h = [int(hx[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


ODD = [(900 + i, t) for i, t in enumerate(["\n", "\n\n", "a", "é", "a\n", "\na", "é\n漢\n\U0001F600", "x<P>y\nz", "<\nS>\n<M", "<M>", "\U0001F600" * 9, "a\r\nb\r\n", "<<\n<P\n<S\nM>\n>" * 7])]


@pytest.mark.parametrize("unit,size", [("line", 8 << 20), ("char", 8 << 20), ("line", 50), ("char", 50)])
def test_middles_equal_a_plain_version(spark, docs, texts, unit, size, monkeypatch):
    monkeypatch.setattr(M, "SLICE", size)
    more = spark.createDataFrame(ODD + [(None, "no\nid"), (None, None), (901, "\n\n")], "doc_id long, text string")
    rows = docs.select("doc_id", "text", "n").unionByName(more.withColumn("n", F.lit("extra")))
    for options in ({}, {"seed": 3, "rate": 60, "spm": 20}):
        got = M.transform(rows, unit=unit, **options).withColumn("restored", M.restored()).collect()
        assert len(got) == len(texts) + len(ODD) + 3
        want = Counter((i, *plain_middle(i, t, unit, **options), t or "") for i, t in [*texts, *ODD, (None, "no\nid"), (None, None), (901, "\n\n")])
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    forms = {r.form for r in got}
    assert forms == {"plain", "psm", "spm"}


def test_exceptions_turn_places_both_ways():
    text = "aé漢\U0001F600b" * 50 + "plain" * 20
    raw = np.frombuffer(text.encode(), np.uint8)
    index = M.Exceptions(raw)
    places = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert (index.characters(places) == np.arange(len(places))).all() and (index.bytes(np.arange(len(places))) == places).all()
    assert len(index.at) == 150


def test_middle_edges(spark, none):
    assert M.digest(M.transform(none)).count() == 0
    with pytest.raises(Exception):
        M.transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), unit="word").collect()


# ---- spelling variants ---------------------------------------------------------------------------------------


def plain_words(rows, shortest=5, least=3, every=97):
    total = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_groups(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and distance(v, w) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def variant_rows():
    rng = random.Random(21)
    base = ["".join(rng.choices("etaoinshré", k=rng.randint(5, 9))) for _ in range(25)] + ["ÀÉßöüÿ", "x" * 40, "ab" * 3, "×÷×÷×"]
    pool = []
    for w in base:
        for k in range(rng.randint(1, 12)):
            v = list(w)
            for _ in range(k and rng.choice((1, 1, 2))):
                at = rng.randrange(len(v))
                how = rng.random()
                v[at : at + 1] = [] if how < 0.3 else [rng.choice("etaoé")] if how < 0.6 else [v[at], rng.choice("etaoé")]
            pool += ["".join(v)] * rng.choice((1, 3, 3, 7, 15, 40))
    rng.shuffle(pool)
    cut = [pool[k : k + 13] for k in range(0, len(pool), 13)]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in ws) + "1,") for i, ws in enumerate(cut)]
    return rows + [(None, "no id " * 4 + "hello hello hello"), (None, None), (5000, ""), (5001, "abcde abcde abcde"), (5001, "abcde abcde abcde"), (5002, "a" * 30_000)]


@pytest.mark.parametrize("block,node,states,pairs", [(8192, 32_768, 1 << 20, 1 << 19), (4, 3, 7, 5)])
def test_variants_equal_a_plain_version(spark, block, node, states, pairs, monkeypatch):
    for name, value in (("BLOCK", block), ("NODE", node), ("STATES", states), ("PAIRS", pairs)):
        monkeypatch.setattr(S, name, value)
    rows = variant_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("word", "n", "node", "part", "root")}).repartition(3)
    got = S.group(frame).collect()
    want = plain_groups(plain_words(rows))
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert sum(w[3] is not None for w in want) > 20 and any(w[3] and w[5] != w[3] for w in want)


def test_words_in_blocks_are_met_once(spark, monkeypatch):
    """Every pair of near words lies in one pair of blocks, however the words are dealt."""
    words = sorted({"".join(w) for w in (random.Random(i).choices("etaon", k=random.Random(i + 1).randint(1, 4)) for i in range(400))})
    frame = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    near = {w: sum(distance(w, v) == 1 for v in words) for w in words}
    for block, deal in ((8192, 8), (10, 8), (10, 1), (1, 3)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "NODE", 1)
        monkeypatch.setattr(S, "DEAL", deal)
        assert {r.word: r.n_near for r in S.near(frame).collect()} == {w: k for w, k in near.items() if k}


def test_long_words_are_compared_too(spark):
    w = "étaoin" * 30
    rows = [(w, 10), (w + "x", 4), (w[1:], 3), ("a" + w[1:], 4), (w + "xy", 3), (w[::-1], 9)]
    got = {r.word: (r.n_near, r.best_n, r.best) for r in S.near(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {w: (3, 4, min(w + "x", "a" + w[1:])), w + "x": (2, 10, w), w[1:]: (2, 10, w), "a" + w[1:]: (2, 10, w), w + "xy": (1, 4, w + "x")}


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w3") for i in range(50)]
    got = {r.word: r.root for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "w37" for a, _ in chain}


def test_variant_edges(none, spark):
    assert S.group(none).count() == 0
    assert S.group(spark.createDataFrame([(1, "few words here"), (2, None)], "doc_id long, text string")).count() == 0
