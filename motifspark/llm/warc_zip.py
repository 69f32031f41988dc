"""WARC records in ZIP packages: written per task, found by their directories, read by range.

A package holds `archive/data.warc.gz`, one gzip member per record, and `indexes/index.cdxj` with the place of each
record, both stored and not compressed again, so that the bytes of a record are at a known place of the package.
"""

import gzip
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from motifspark.llm.text import as_batch, raw_column
from motifspark.session import materialize, scratch_path

#: Payloads from this length on are stored once.
REVISIT = 100
#: Bytes of records after which a task begins another package, and of one range-reading task.
PACKAGE = 256 << 20
SLICE = 8 << 20
#: Bytes of records that one task reads.
TASK = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def roles(pages):
    """Columns of `pages` with payload, payload_digest and `first`: the smallest page_id with the same payload of at least 100 bytes.

    Only digests are grouped. Those that occur once need no partner, so what is joined back is as small as the copies.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    small = rows.where(F.octet_length("payload") >= REVISIT).select("page_id", "payload_digest")
    copies = small.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(materialize(copies.drop("n"), "copies"), "payload_digest", "left")


def urn(page):
    return f"<urn:page:{page}>"


def record(page, url, payload, digest, refers):
    """One record as bytes; a revisit has the digest and length of the payload but not the payload."""
    head = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", urn(page)), ("WARC-Date", "2020-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if refers is not None:
        head += [("WARC-Refers-To", urn(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def packed(data):
    """A gzip member whose bytes depend on the data alone."""
    return gzip.compress(data, 1, mtime=0)


class Package:
    """A ZIP package that is written in one pass and appears under its name when it is closed."""

    def __init__(self, folder, name):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.path, self.draft = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.uri = f"{folder}/{name}"
        self.files.create_dir(base, recursive=True)
        self.stream = self.files.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page, url, payload, digest, refers):
        raw = packed(record(page, url, payload, digest, refers))
        self.data.write(raw)
        key = json.dumps({"offset": str(self.at), "length": str(len(raw)), "digest": f"sha256:{digest}", "filename": DATA.split("/")[1], "url": url})
        self.lines.append(f"{quote(url or '-', safe='')} 20200101000000 {key}\n")
        self.at += len(raw)

    def close(self):
        self.data.close()
        self.zip.writestr(INDEX, "".join(sorted(self.lines)))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        self.files.move(self.draft, self.path)
        return self.uri, len(self.lines), self.at


def write(pages, folder):
    """(package, records, bytes) of the packages written below `folder`, a folder that all executors share.

    A task writes its rows to packages of its own, named by its partition, under a draft name until they are complete. A
    repeated task replaces them by packages of the same name.
    """

    def run(batches):
        package, number = None, 0
        for batch in batches:
            for row in zip(*(raw_column(batch, c) for c in ("page_id", "url", "payload", "payload_digest", "refers"))):
                if package is None:
                    package = Package(folder, f"part-{TaskContext.get().partitionId():06d}-{number:04d}.wacz")
                package.add(*row)
                if package.at >= PACKAGE:
                    done = package.close()
                    package, number = None, number + 1
                    yield closed(done)
        if package is not None:
            yield closed(package.close())

    def closed(done):
        return as_batch(**{k: pa.array([v]) for k, v in zip(("package", "records", "bytes"), done)})

    rows = roles(pages)
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return rows.select("page_id", F.col("url").cast("string").alias("url"), "payload", "payload_digest", refers.alias("refers")).mapInArrow(run, "package string, records long, bytes long")


def members(file):
    """{name: (method, offset of the stored bytes, size)} of a ZIP file from its directories, ZIP64 or not."""
    size = file.size()
    tail_at = max(0, size - 65557 - 76)
    file.seek(tail_at)
    tail = file.read()
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("not a ZIP file: it has no end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if tail[end - 20 : end - 16] != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        file.seek(at)
        count, length, start = struct.unpack_from("<QQQ", file.read(56), 32)
    file.seek(start)
    directory, at, found = file.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, stored, plain = struct.unpack_from("<H", directory, at + 10) + struct.unpack_from("<II", directory, at + 20)
        name_n, extra_n, note_n = struct.unpack_from("<HHH", directory, at + 28)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the fields that did not fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        found[name] = method, offset, stored
        at += 46 + name_n + extra_n + note_n
    for name, (method, offset, stored) in found.items():
        file.seek(offset)
        local = file.read(30)
        found[name] = method, offset + 30 + sum(struct.unpack_from("<HH", local, 26)), stored
    return found


def opened(uri):
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def slices(batches):
    """Pieces of each package's index: the ranges of some records, near each other and of about `SLICE` bytes together."""
    for batch in batches:
        for uri in raw_column(batch, "package"):
            with opened(uri) as file:
                inside = members(file)
                for name in (DATA, INDEX):
                    if inside[name][0] != zipfile.ZIP_STORED:
                        raise ValueError(f"{uri}: {name} is compressed and can't be read by range")
                file.seek(inside[INDEX][1])
                lines = file.read(inside[INDEX][2]).decode().splitlines()
            places = sorted((int(x["offset"]), int(x["length"])) for x in (json.loads(line.split(" ", 2)[2]) for line in lines))
            base, piece, size = inside[DATA][1], [], 0
            pieces = []
            for offset, length in places:
                piece.append((base + offset, length))
                size += length
                if size >= SLICE:
                    pieces.append(piece)
                    piece, size = [], 0
            pieces += [piece] * bool(piece)
            yield as_batch(package=[uri] * len(pieces), offsets=pa.array([[o for o, _ in p] for p in pieces], pa.list_(pa.int64())),
                           lengths=pa.array([[n for _, n in p] for p in pieces], pa.list_(pa.int64())))


def parse(raw):
    """(headers, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["Payload-Length"] = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, payload


def page_of(value):
    page = value and value.removeprefix("<urn:page:").removesuffix(">")
    return None if page == "None" else page


def fetch(batches):
    for batch in batches:
        for uri, offsets, lengths in zip(*(raw_column(batch, c) for c in ("package", "offsets", "lengths"))):
            out = []
            with opened(uri) as file:
                for offset, length in zip(offsets, lengths):
                    file.seek(offset)
                    fields, payload = parse(zlib.decompress(file.read(length), wbits=31))
                    kind = fields["WARC-Type"]
                    out.append((uri, offset, length, kind, page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), page_of(fields.get("WARC-Refers-To")),
                                fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["Payload-Length"], payload if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), ARROW)], names=NAMES)


NAMES = ["package", "offset", "length", "record_type", "page", "target_uri", "refers_page", "payload_digest", "payload_bytes", "payload"]
ARROW = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
RECORDS = ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if n in ('offset', 'length', 'payload_bytes') else 'string'}" for n in NAMES)


def read(packages):
    """Every record of the packages, read by range: place, type, ids, digest, length of the full payload, payload of responses."""
    n = max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(packages.agg(F.sum("bytes")).first()[0] or 0) // TASK))
    parts = packages.select("package").repartition("package").mapInArrow(slices, "package string, offsets array<long>, lengths array<long>")
    # a number of tasks by what is read: the ranges themselves are small, and would be put together in one
    return parts.repartition(n, F.col("package"), F.col("offsets")[0]).mapInArrow(fetch, RECORDS)


def round_trip(pages):
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row, read back from packages.

    Null html is an empty payload; null url leaves out the target. Payloads under 100 bytes are always responses. Rows
    that repeat the smallest page_id of a payload are responses, other copies are revisits of it. A null page_id stays null.
    An empty table writes no packages and gives no rows. The digest of a response is taken from the bytes that were read.
    """
    packages = materialize(write(pages, scratch_path(pages.sparkSession, "packages")), "packages")
    records = read(packages)
    kind = pages.schema["page_id"].dataType
    whole = F.col("record_type") == "response"
    return records.select(
        F.col("page").cast(kind).alias("page_id"), F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.col("refers_page").cast(kind).alias("refers_to"))
