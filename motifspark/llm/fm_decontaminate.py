"""Benchmark decontamination with an FM-index per training shard.

Each Arrow batch of documents is a shard. Its text, as benchmark word numbers, is suffix-sorted; the Burrows-Wheeler
transform is kept in a wavelet matrix. All test phrases are searched backwards together, a step for all phrases at a
time with common endings searched once. Occurrences are located by walking to the next sampled suffix position, and the
words they cover become removal spans. Words that no phrase holds separate the indexed runs, and runs shorter than the
shortest phrase cannot hold one and are not indexed.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.text import as_batch, binary, raw_column, tidy

WINDOW = 10
#: Every so many text positions a suffix keeps its position.
SAMPLE = 16
#: Bytes of benchmark text searched in one pass; larger benchmarks take more passes over the documents.
BLOCK = 4 << 20
#: Words of one benchmark row; longer items are cut with `WINDOW` - 1 words of overlap.
PIECE = 4096

#: A-Z to a-z; every other ASCII byte outside 0-9 and a-z to a space. Bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def words_of(raw):
    return raw.translate(FOLD).split() if raw else []


class Phrases:
    """Distinct windows of benchmark items as a tree of reversed words, one layer per step of the backward search."""

    def __init__(self, items, window=WINDOW):
        self.vocabulary = {}
        owners = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window][::-1]), set()).update(() if item is None else (item,))
        self.shortest = min(map(len, owners), default=window)
        self.owners = [sorted(x) for x in owners.values()]
        layers = [({}, []) for _ in range(window)]
        for number, phrase in enumerate(owners):
            node = 0
            for (known, _), word in zip(layers, phrase):
                node = known.setdefault((node, word), len(known))
            layers[len(phrase) - 1][1].append((node, number))
        self.layers = [(np.array(list(known), np.int64).reshape(-1, 2).T, np.array(ends, np.int64).reshape(-1, 2).T) for known, ends in layers]


def suffix_array(text):
    """Positions of the suffixes of `text` in order; its last symbol must be the least and occur once."""
    n = len(text)
    bits = int(text.max()).bit_length()
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(step, np.int64)])
    for k in range(step):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        step *= 2


class Index:
    """FM-index: wavelet matrix over the transform, first row of each symbol, sampled positions."""

    def __init__(self, text):
        order = suffix_array(text)
        symbols = text[order - 1]
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = []
        for bit in range(int(text.max()).bit_length() - 1, -1, -1):
            ones = symbols >> bit & 1
            count = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((bit, count, self.size - int(count[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        self.sampled = order % SAMPLE == 0
        self.kept = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def rank(self, symbol, row):
        """How often each symbol occurs in the transform before each row."""
        start = np.zeros_like(row)
        for bit, count, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            row = np.where(one, zeros + count[row], row - count[row])
            start = np.where(one, zeros + count[start], start - count[start])
        return row - start

    def before(self, row):
        """Row of the suffix that starts one position earlier."""
        symbol, at = np.zeros_like(row), row
        for bit, count, zeros in self.levels:
            one = count[at + 1] > count[at]
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + count[at], at - count[at])
        return self.first[symbol] + self.rank(symbol, row)

    def locate(self, row):
        """Text positions of rows."""
        row, steps, open_ = row.copy(), np.zeros_like(row), np.arange(len(row))
        while len(open_ := open_[~self.sampled[row[open_]]]):
            row[open_] = self.before(row[open_])
            steps[open_] += 1
        return self.positions[self.kept[row]] + steps

    def search(self, phrases):
        """(position, length, phrase number) of every occurrence."""
        low, high = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        found = []
        for length, ((parent, symbol), (node, number)) in enumerate(phrases.layers, 1):
            if not len(parent):
                break
            live = np.flatnonzero((high > low)[parent] & (symbol < len(self.first) - 1))
            lo, hi = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
            s = symbol[live]
            lo[live] = self.first[s] + self.rank(s, low[parent[live]])
            hi[live] = self.first[s] + self.rank(s, high[parent[live]])
            low, high = lo, hi
            hits = (high - low)[node]
            if hits.any():
                number, node, hits = (x[hits > 0] for x in (number, node, hits))
                start = np.repeat(low[node] - np.cumsum(hits) + hits, hits)
                found.append((self.locate(start + np.arange(hits.sum())), np.full(hits.sum(), length), np.repeat(number, hits)))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found)))


def runs(ids, shortest):
    """Indexes of tokens in stretches without 0 that are at least `shortest` long, and the text to index: each stretch with a separator."""
    inside = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= shortest
    start, size = start[long], (end - start)[long] + 1
    where = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    last = np.cumsum(size) - 1
    text = ids[np.minimum(where, len(ids) - 1)].astype(np.int64)
    text[last] = 1
    return where, np.concatenate([text, [0]])


def joined(flags):
    """[start, end) of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def search_shards(broadcast, keep):
    @tidy
    def run(batches):
        phrases = broadcast.value
        get = phrases.vocabulary.get
        for batch in batches:
            known, sizes = [], []
            for raw in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                sizes.append(len(words))
                known.append(np.array([get(w, 0) for w in words], np.int32))
            bounds = np.cumsum([0] + [n + 1 for n in sizes])  # one empty place after each document
            ids = np.zeros(bounds[-1] + 1, np.int32)
            for start, mine in zip(bounds, known):
                ids[start : start + len(mine)] = mine
            del known
            where, text = runs(ids, phrases.shortest)
            change = np.zeros(len(ids) + 1, np.int32)
            items = [set(x or ()) for x in raw_column(batch, "items")]
            if len(where):
                at, length, number = Index(text).search(phrases)
                begin = where[at]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length, -1)
                document = np.searchsorted(bounds, begin, "right") - 1
                for d, n in np.unique(np.stack([document, number]), axis=1).T:
                    items[d].update(phrases.owners[n])
            for d, spans in enumerate(raw_column(batch, "spans")):
                for s in spans or ():
                    change[bounds[d] + s["start"]] += 1
                    change[bounds[d] + s["end"]] -= 1
            start, end = joined(np.cumsum(change)[: len(ids)] > 0)
            document = np.searchsorted(bounds, start, "right") - 1
            spans = pa.ListArray.from_arrays(
                np.searchsorted(document, np.arange(len(sizes) + 1)).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(start - bounds[document]), pa.array(end - bounds[document])], ["start", "end"]))
            rest = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield as_batch(**rest, n_words=np.array(sizes, np.int64), items=pa.array([sorted(x) for x in items], pa.list_(pa.string())), spans=spans)

    return run


def chained(one, other):
    return lambda batches: other(one(batches))


@tidy
def cut(batches):
    for batch in batches:
        out = []
        for item, raw in zip(raw_column(batch, "item_id"), raw_column(batch, "text")):
            words = words_of(raw)
            for i in range(0, max(1, len(words) - WINDOW + 1), PIECE - WINDOW + 1):
                if words[i:]:
                    piece = b" ".join(words[i : i + PIECE])
                    out.append((item, piece, len(piece)))
        if out:
            item, piece, size = zip(*out)
            yield as_batch(item_id=pa.array(item, pa.string()), piece=list(piece), size=list(size))


def decontaminate(docs, benchmark, keep=("doc_id",), then=None):
    """`keep` columns of every row with n_words, items (ids of benchmark items found, as sorted strings) and spans.

    Spans are [start, end) word ranges, merged where they overlap or touch, of words inside any occurrence of ten
    consecutive words of an item, or of all words of a shorter item. Null and empty texts have no words. Items without
    words find nothing, the words of items with a null id are found but no id reported; items with equal texts are all reported. Repeated rows are answered one by
    one, an empty benchmark finds nothing, and extra columns are neither read nor changed. `then`, an Arrow map of these rows
    and the schema of its own, is run by the worker that searches, so a task needs no second one for it.
    """
    spark = docs.sparkSession
    pieces = benchmark.select(F.col("item_id").cast("string").alias("item_id"), binary()).mapInArrow(cut, "item_id string, piece binary, size long")
    blocks = -(-(pieces.agg(F.sum("size")).first()[0] or 0) // BLOCK)
    keep = list(keep)
    found = docs.select(*keep, *[binary()] * ("text" not in keep), F.lit(0).cast("long").alias("n_words"),
                        F.array().cast("array<string>").alias("items"), F.array().cast(SCHEMA["spans"].dataType).alias("spans"))
    for b in range(max(1, blocks)):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(1, blocks))) == b).select("item_id", "piece").collect()
        phrases = spark.sparkContext.broadcast(Phrases((r.item_id, bytes(r.piece).split()) for r in mine))
        passed = keep if b >= blocks - 1 or "text" in keep else [*keep, "text"]
        search, schema = search_shards(phrases, passed), T.StructType([found.schema[c] for c in passed] + SCHEMA.fields)
        if then and b >= blocks - 1:
            search, schema = chained(search, then[0]), then[1]
        found = found.mapInArrow(search, schema)
    return found


def digest(found):
    """The counts and digest that stand for a result of `decontaminate`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def strip_words(text, spans):
    """The text without the words of the spans and what stands between them; the rest is left as it is."""
    if not spans:
        return text
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    start, end = joined(folded)
    out, last = [], 0
    for s in spans:
        out.append(raw[last : start[s["start"]]])
        last = int(end[s["end"] - 1])
    return b"".join([*out, raw[last:]]).decode()


def removed(docs, benchmark):
    """All rows and columns of `docs` with the removal spans cut from `text`; rows with nothing but benchmark words go.

    Rows without a hit are unchanged, also where their text is null. `n_chars` is counted anew where text changed.
    """
    columns = docs.columns
    texts = docs.withColumn("text", F.col("text").cast("string"))
    other = [c for c in columns if c not in ("text", "n_words", "items", "spans")]
    packed = texts.select(F.struct(*[c for c in columns if c != "text"]).alias("row"), "text")

    def strip(batches):
        for batch in batches:
            texts, spans, sizes = (raw_column(batch, c) for c in ("text", "spans", "n_words"))
            stay = [not s or n > sum(x["end"] - x["start"] for x in s) for s, n in zip(spans, sizes)]
            out = [t and strip_words(t, s) for t, s, k in zip(texts, spans, stay) if k]
            yield as_batch(row=batch.column(0).filter(pa.array(stay, pa.bool_())), text=pa.array(out, pa.string()), changed=[bool(s) for s, k in zip(spans, stay) if k])

    schema = T.StructType([packed.schema["row"], packed.schema["text"], T.StructField("changed", T.BooleanType())])
    done = decontaminate(packed, benchmark, keep=("row", "text"), then=(strip, schema))
    count = F.when(F.col("changed"), F.char_length("text")).otherwise(F.col("row")["n_chars"]) if "n_chars" in other else None
    value = {"text": F.col("text"), **({"n_chars": count.cast(docs.schema["n_chars"].dataType)} if count is not None else {})}
    return done.select(*[value[c].alias(c) if c in value else F.col("row")[c].alias(c) for c in columns])
