"""Documents as sequences of texts and media in the order of their HTML, with payloads resolved by digest."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.text import as_batch, raw_column
from motifspark.session import scratch_path

#: Payloads are padded to a multiple of this: frames of 24 x 24 samples.
FRAME = 576
SIDE = 24
#: Bytes at the end of a payload that its checksum is of.
TAIL = 32

TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!?[^a-zA-Z/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = {"script", "style", "head", "template", "noscript"}
INLINE = {"a", "b", "i", "em", "strong", "span", "small", "u", "code", "sub", "sup", "abbr", "mark", "q", "s", "cite", "font"}
MEDIA = {"img", "video", "audio", "source"}
ELEMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "text", "ref", "caption")])


def elements(page):
    """(kind, text, ref, caption) of a page in order: texts between block tags, and media with their source and caption.

    The caption is the figure's figcaption, else the alternative text. Scripts, styles and the head are left out. Tags
    that are not closed end with the page.
    """
    out, text, hidden, figure, caption = [], [], [], None, None

    def end_text():
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            out.append(["text", words, None, None])

    last = 0
    for m in TAG.finditer(page):
        if not hidden:
            (text if caption is None else caption).append(page[last : m.start()])
        last = m.end()
        close, name, attributes = m[1], (m[2] or "").lower(), m[3]
        if not name:
            continue
        if hidden:
            if close and name == hidden[-1]:
                hidden.pop()
            continue
        if name in HIDDEN and not close:
            if not attributes.endswith("/"):
                hidden.append(name)
        elif name in MEDIA and not close:
            values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
            if values.get("src"):
                end_text()
                out.append(["media", None, values["src"], values.get("alt")])
        elif name == "figure":
            end_text()
            figure = None if close else len(out)
        elif name == "figcaption":
            if not close:
                end_text()
                caption = []
            elif caption is not None:
                words = " ".join(html.unescape("".join(caption)).split())
                for x in out[figure or 0 :] if figure is not None else []:
                    if x[0] == "media":
                        x[3] = words
                caption = None
        elif name not in INLINE and caption is None:
            end_text()
    if not hidden:
        (text if caption is None else caption).append(page[last:])
    end_text()
    return out


def parse(batches):
    for batch in batches:
        found = [elements(x or "") for x in raw_column(batch, "html")]
        flat = [e for x in found for e in x]
        parts = [pa.array([e[k] for e in flat], pa.string()) for k in range(4)]
        ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
        yield as_batch(row=batch.column(0), elements=pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["kind", "text", "ref", "caption"])))


def interleave(pages, media, key):
    """`key` and two arrays of equal length for every row of `pages` (key, html): texts and media, null where the other is.

    A media entry has ref, caption and `payload`, the struct of the other columns of `media` (ref, ...), null if the ref is not
    there. References meet the media table by ref alone, and go back to their place by key and position; text is not
    moved. Null html is an empty sequence. Keys must differ between rows. Refs that `media` has more than once are taken once.
    """
    rows = pages.select(F.struct(key).alias("row"), F.col("html").cast("string").alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("elements", T.ArrayType(ELEMENT))])
    parsed = rows.mapInArrow(parse, schema).select(F.col("row")[key].alias(key), "elements")
    names = [c for c in media.columns if c != "ref"]
    known = media.where("ref is not null").groupBy("ref").agg(F.first(F.struct(*names)).alias("payload"))
    refs = parsed.select(key, F.posexplode("elements").alias("at", "e")).where("e.kind = 'media'").select(key, "at", F.col("e.ref").alias("ref"), F.col("e.caption").alias("caption"))
    found = refs.join(known, "ref", "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("ref", "caption", "payload")))).alias("found"))
    texts = parsed.select(key, F.transform("elements", lambda e: e["text"]).alias("texts"))
    return texts.join(found, key, "left").select(key, "texts", F.transform("texts", lambda t, i: F.col("found")[i]).alias("media"))


def padded(raw):
    """`raw` with bytes 255 up to a positive multiple of a frame."""
    return raw + b"\xff" * (-len(raw) % FRAME or FRAME * (not raw))


def image(raw):
    """A payload as an 8-bit grey image (PGM), 24 samples wide, with its unpadded length as comment."""
    payload = padded(raw)
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(raw), SIDE, len(payload) // SIDE) + payload


def samples(stored):
    """(unpadded length, samples) of an image."""
    kind, note, size, most, data = stored.split(b"\n", 4)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit PGM image as stored here")
    return int(note.split()[2]), data


def feature(data):
    """Means of 4 x 4 blocks of the mean frame, two hexadecimal digits each."""
    mean = np.frombuffer(data, np.uint8).reshape(-1, 4, SIDE // 4, 4, SIDE // 4).mean(axis=(0, 2, 4))
    return np.floor(mean).astype(np.uint8).tobytes().hex()


def store(docs, path):
    """Writes the whole text of every row as an image to a table of media, and reads it back as (ref, media)."""

    def run(batches):
        for batch in batches:
            raws = batch.column(0).to_pylist()
            seen = {hashlib.sha256(padded(r)).hexdigest(): r for r in raws}  # copies within a batch are stored once
            for at in range(0, len(seen), 1000):
                some = dict(list(seen.items())[at : at + 1000])
                yield as_batch(ref=pa.array(some, pa.string()), media=pa.array([image(r) for r in some.values()], pa.binary()))

    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(raw.alias("text")).mapInArrow(run, "ref string, media binary")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def describe(batches):
    """What is stored, from the bytes that were read; ref is the digest of the samples."""
    for batch in batches:
        out = []
        for stored in raw_column(batch, "media"):
            n, data = samples(stored)
            out.append((hashlib.sha256(data).hexdigest(), n, len(data), zlib.crc32(data[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
        if out:
            ref, *rest = zip(*out)
            yield as_batch(**{k: pa.array(v) for k, v in zip(("ref", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"), (ref, *rest))})


DESCRIBED = "ref string, n_bytes long, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def documents_as_media(docs):
    """Payload and media values of every row of `docs` (doc_id, text).

    The text is stored as an image and referred to by its digest from a page with one figure; the page's sequence brings
    the values back. Null text is empty and padded to one frame. Rows with equal ids and texts, and rows without an id, are
    answered one by one. An empty table gives no rows.
    """
    media = store(docs, scratch_path(docs.sparkSession, "media")).select("media").mapInArrow(describe, DESCRIBED)
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    size = F.octet_length(raw)
    length = F.greatest(F.lit(1), F.ceil(size / FRAME)) * FRAME
    ref = F.sha2(F.rpad(raw, length, F.lit(b"\xff")), 256)
    page = F.concat(F.lit('<article><figure><img src="'), "ref", F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"))
    ids = docs.select("doc_id", ref.alias("ref"))
    pages = ids.distinct().select(F.struct("doc_id", "ref").alias("id"), page.alias("html"))
    found = interleave(pages, media, "id").select(F.inline(F.array(F.struct("id.doc_id", "id.ref", F.col("media")[0]["payload"].alias("p")))))
    values = found.select(F.col("doc_id").alias("id"), "ref", "p.*")
    joined = ids.join(values, ids["doc_id"].eqNullSafe(values["id"]) & (ids["ref"] == values["ref"]))
    return joined.select(ids["doc_id"], "n_bytes", "payload_bytes", ids["ref"].alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
