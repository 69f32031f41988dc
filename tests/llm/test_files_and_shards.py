"""Archives, media, shards and the pipeline against plain versions."""

import hashlib
import io
import itertools
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motifspark.llm import fm_decontaminate, hilbert_shards as H, language_id, media_columns as M, secret_scan, sentencepiece_array, warc_zip as W
from motifspark.session import scratch_path

# ---- archives ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "x" * 200
    rows = [(i, f"http://a.example/{i}", long if i % 3 == 0 else f"<p>page {i} " + "é" * i) for i in range(120)]
    rows += [(200, "http://a b/ü\r\nX: y", long + "\r\n\r\nWARC/1.1\r\n"), (201, None, None), (202, "http://c", ""), (203, "http://c", "short"), (204, "http://c", "short"), (205, None, "y" * 300_000), (206, "u", "y" * 99), (207, "u", "y" * 99)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("extra")).withColumn("payload", F.lit("extra")).repartition(4), rows


def expected(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h, i)
        out.add((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    return out


@pytest.mark.parametrize("package,piece", [(256 << 20, 8 << 20), (2000, 300)])
def test_round_trip_of_archives(pages, package, piece, monkeypatch):
    monkeypatch.setattr(W, "PACKAGE", package)
    monkeypatch.setattr(W, "SLICE", piece)
    frame, rows = pages
    got = W.round_trip(frame).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected(rows)


def test_archives_are_zip_and_warc(spark, pages):
    frame, rows = pages
    folder = scratch_path(spark, "packages")
    packages = [r.package for r in W.write(frame, folder).collect()]
    found = {}
    for uri in packages:
        with W.opened(uri) as file, zipfile.ZipFile(io.BytesIO(open(uri, "rb").read())) as zipped:
            inside = W.members(file)
            assert sorted(inside) == sorted(zipped.namelist()) and zipped.testzip() is None
            for name, (method, offset, size) in inside.items():
                file.seek(offset)
                assert method == 0 and file.read(size) == zipped.read(name)
            raw = zipped.read(W.DATA)
            while raw:  # the members one after another
                gz = zlib.decompressobj(31)
                fields, payload = W.parse(gz.decompress(raw))
                raw = gz.unused_data
                found[fields["WARC-Record-ID"]] = fields["WARC-Type"], payload
    assert len(found) == len(rows)
    by = {f"<urn:page:{i}>": (h or "").encode() for i, _, h in rows}
    assert all(p == (by[i] if kind == "response" else b"") for i, (kind, p) in found.items())


def test_zip64_directories():
    """A package with the 64-bit fields that large ones have."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("b", b"world" * 9)
    raw = bytearray(raw.getvalue())
    end = raw.rfind(b"PK\5\6")
    count, size, start = int.from_bytes(raw[end + 10 : end + 12], "little"), int.from_bytes(raw[end + 12 : end + 16], "little"), int.from_bytes(raw[end + 16 : end + 20], "little")
    directory = raw[start : start + size]
    offset = directory[42:46]  # of the first entry, which goes to an extra field
    directory[42:46] = b"\xff" * 4
    extra = b"\1\0\x08\0" + bytes(offset) + bytes(4)
    name = 46 + int.from_bytes(directory[28:30], "little")
    directory[30:32] = (int.from_bytes(directory[30:32], "little") + len(extra)).to_bytes(2, "little")
    directory[name:name] = extra
    wide = b"PK\6\6" + (44).to_bytes(8, "little") + bytes(12) + b"".join(x.to_bytes(8, "little") for x in (count, count, len(directory), start))
    locator = b"PK\6\7" + bytes(4) + (start + len(directory)).to_bytes(8, "little") + (1).to_bytes(4, "little")
    last = b"PK\5\6" + bytes(4) + b"\xff" * 12 + bytes(2)
    whole = bytes(raw[:start]) + bytes(directory) + wide + locator + last
    inside = W.members(pa.BufferReader(whole))
    assert {n: whole[o : o + s] for n, (_, o, s) in inside.items()} == {"a": b"hello", "b": b"world" * 9}
    with pytest.raises(ValueError):
        W.members(pa.BufferReader(b"no archive"))


def test_archive_edges(spark, pages):
    frame, _ = pages
    assert W.round_trip(frame.where("false")).count() == 0
    rows = spark.createDataFrame([(None, None, "z" * 200), (1, "u", "z" * 200), (1, "u", "z" * 200)], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.record_type) for r in W.round_trip(rows).collect()), key=str) == [(1, "response"), (1, "response"), (None, "response")]


# ---- media ---------------------------------------------------------------------------------------------------


def test_media_values(spark, docs, texts):
    got = {r.doc_id: r for r in M.documents_as_media(docs).collect()}
    assert len(got) == len({i for i, _ in texts})
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        r = got[i]
        stored = M.image(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), M.feature(payload)) and M.samples(stored) == (len(raw), payload)


def test_media_edges(spark, docs, none, texts):
    assert M.documents_as_media(none).count() == 0
    assert M.documents_as_media(docs).count() == len(texts)
    rows = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.n_bytes for r in M.documents_as_media(rows).collect()) == [0, 1, 1, 1]


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><nav>menu</nav><!-- <p>no</p> --><p>One &amp; <b>two</b>
three</p><script>var t="</p><img src='no'>";</script><figure><img src="m1" alt="old"><figcaption>A <i>fine</i> caption</figcaption></figure>
<p>four <img src=m2 alt='a > b'> five</p><img><video src="gone"></video>six"""


def test_sequences_stay_aligned(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    media = spark.createDataFrame([("m1", 10), ("m2", 20), ("m2", 20), (None, 5)], "ref string, size long")
    got = {r.page_id: r for r in M.interleave(pages, media, "page_id").collect()}
    texts, found = got[1].texts, got[1].media
    assert texts == ["menu", "One & two three", None, "four", None, "five", None, "six"] and len(found) == len(texts)
    assert [(m.ref, m.caption, m.payload and m.payload["size"]) if m else None for m in found] == [
        None, None, ("m1", "A fine caption", 10), None, ("m2", "a > b", 20), None, ("gone", None, None), None]
    assert got[2].texts == got[3].texts == [] and got[4].texts == ["plain"] and got[4].media == [None]


# ---- shards --------------------------------------------------------------------------------------------------


def test_curve_is_a_path_through_all_cells(spark):
    n = 8
    cells = spark.createDataFrame(list(itertools.product(range(n), repeat=3)), "x int, y int, z int")
    path = [tuple(r)[:3] for r in cells.withColumn("at", H.hilbert("x", "y", "z", 3)).orderBy("at").collect()]
    assert len(path) == n**3 and all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("part", [50_000, 7])
def test_shards(docs, texts, part, monkeypatch):
    monkeypatch.setattr(H, "PART", part)
    got = H.shard(docs).collect()
    assert len(got) == len(texts)
    by = dict(texts)
    slots = {}
    for r in got:
        raw = (by[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(order, order[1:]))


def test_shard_edges(spark, none):
    assert H.shard(none).count() == 0
    few = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.shard for r in H.shard(few).collect()) == [0, 1, 2]


# ---- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_equals_a_plain_version(spark, sf, tmp_path):
    from test_ngram_jaccard import brute

    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out()))
    scores = language_id.Scores(model[2], len(model[0]))
    kept = {i: r.text for i, r in rows.items() if (lambda lang, s: lang != "und" and s >= 0.4)(*language_id.decide(r.text, scores, model[0], model[1]))}
    kept = {i: kept[i] for i, (_, c) in brute(list(kept.items()))[0].items() if i == c}
    from test_text_operators import plain_hits

    bench = [(r.item_id, r.text) for r in items.collect()]
    clean = {}
    for i, t in kept.items():
        n, hit, _ = plain_hits(t, bench)
        if hit and len(hit) == n:
            continue
        spans = [(k, k + 1) for k in hit]
        merged = []
        for s, e in spans:
            if merged and merged[-1]["end"] == s:
                merged[-1]["end"] = e
            else:
                merged.append({"start": s, "end": e})
        clean[i] = fm_decontaminate.strip_words(t, merged)
    ratio = secret_scan.train(spark.createDataFrame(list(clean.items()), "doc_id long, text string"))
    random_ = lambda x: (lambda t, e: t >= secret_scan.TOTAL and e >= secret_scan.EACH)(*secret_scan.judge(x, ratio))
    with open(sentencepiece_array.MODEL, "rb") as file:
        encoder = sentencepiece_array.Encoder(sentencepiece_array.Vocabulary(file.read()))
    want = {}
    for i, t in clean.items():
        flags = [0] * (len(t) + 1)
        for s, _, e in secret_scan.scan_text(t, random_):
            flags[s:e] = [1] * (e - s)
        out = "".join("[SECRET]" if f and not flags[k - 1] else "" if f else c for k, (c, f) in enumerate(zip(t, flags)))
        want[i] = encoder.encode([out])[0].tolist()
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
