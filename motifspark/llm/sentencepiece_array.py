"""SentencePiece encoding with a suffix array over each batch.

Pieces never reach over the end of a stretch of spaces and the characters behind it, so the distinct stretches of a batch
are encoded once. Their concatenation is indexed by a suffix array, every piece of the vocabulary is found in it by binary
search, and the occurrences are the edges of a graph over positions. Edges are sorted by position and relaxed in that
order: a position is reached by the one edge whose piece stands next to the piece before it, that is, by the last piece
of the encoding up to there. Two pieces stand next to each other if merging their characters, best score first and
leftmost among equals, ends in these two; an encoding is the one sequence in which all neighbours do.

Characters without a piece become one byte piece per UTF-8 byte. The vocabulary is read from a model file; nothing is
trained here.
"""

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.text import as_batch, raw_column, tidy, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches a worker remembers in each of two generations, pairs of neighbours it remembers one by one, and characters
#: indexed together.
CACHE, PAIRS, INDEXED = 120_000, 400_000, 1 << 17
#: Pairs looked up together have places in a table, by so many bits of their hash; the last one with a place keeps it.
PLACES = 18
#: Texts that leave an Arrow batch at once.
TEXTS = 500
#: Stretches of at most so many bytes are relaxed together.
TOGETHER = 256
SCATTER = np.uint64(0x9E3779B97F4A7C15)
#: Stretches are found by their first bytes; longer pieces are compared in full.
HEAD = 16

STRETCH = re.compile(r" *[^ \n]+|\n| +")


class Vocabulary:
    """Pieces, scores and special ids of a model, with a space for the space sign; sent to the tasks as plain data."""

    def __init__(self, file):
        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        ids = range(model.get_piece_size())
        self.byte = {}
        self.pieces, self.scores = {}, {}
        self.texts = []
        for i in ids:
            piece = model.id_to_piece(i)
            self.texts.append(piece.replace(SPACE, " ").encode())
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece.replace(SPACE, " ")] = i
                self.scores[i] = model.get_score(i)
        self.unknown = model.unk_id()
        if any("\n" in p or re.search("[^ ] ", p) for p in self.pieces):
            raise ValueError("this vocabulary has pieces that reach over the end of a stretch")
        self.splits = self.last_merges()
        self.bytes_of = {i: bytes([b]) for b, i in self.byte.items()}

    def merge(self, text, least=1):
        """Ids of a text's pieces by merging characters until `least` are left; unknown characters stay as None."""
        symbols = list(text)
        while True:
            best, at = None, None
            for i in range(len(symbols) - 1):
                piece = self.pieces.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at is None or len(symbols) <= least:
                return [self.pieces.get(s) for s in symbols]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def last_merges(self):
        """(time, left, right, odd) by id: when a piece is merged, by rank of its score, and the two pieces that it is merged from.

        Characters have the time 0. A piece is odd if it is not what its characters are merged to, if it is not merged after
        its parts, as runs of spaces are not, or if a part of it is odd.
        """
        size = len(self.texts)
        time, left, right = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        odd = np.zeros(size, bool)
        rank = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True), 1)}
        for piece, i in sorted(self.pieces.items(), key=lambda x: len(x[0])):
            if len(piece) == 1:
                continue
            time[i], parts = rank[self.scores[i]], self.merge(piece, 2)
            odd[i] = len(parts) != 2 or None in parts or odd[parts].any() or time[parts].max() >= time[i]
            if not odd[i]:
                left[i], right[i] = parts
        return time, left, right, odd

    def encoder(self):
        """The worker's encoder; a broadcast vocabulary keeps it, with what it has learned, from task to task."""
        if not hasattr(self, "kept"):
            self.kept = Encoder(self)
        return self.kept

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def fallback(self, character):
        """Byte pieces of a character without a piece of its own."""
        return [self.byte.get(b, self.unknown) for b in character.encode()]


def suffix_order(text):
    """Order of the suffixes of a byte array by their first `HEAD` bytes, and these as two sorted columns of integers."""
    padded = np.concatenate([text, np.zeros(HEAD, np.uint8)])
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + len(text)]
    late = np.concatenate([words[8:], np.zeros(min(8, len(text)), np.uint64)])[: len(text)]
    order = np.argsort(words)
    first = words[order]
    same = np.concatenate([[False], first[1:] == first[:-1], [False]])
    tied = np.flatnonzero(same[1:] | same[:-1])  # within equal first halves, by the second
    order[tied] = order[tied][np.lexsort((late[order[tied]], first[tied]))]
    return order, first, late[order]


def ends(sorted_words, late, low, high, length):
    """First and last place between the bounds, (early, late) each, by binary search for all pieces at once."""
    first, last = np.searchsorted(sorted_words, low[0], "left"), np.searchsorted(sorted_words, high[0], "right")
    more = np.flatnonzero((length > HEAD // 2) & (first < last))  # within equal first halves, by the second
    out = []
    for rest, right in ((low[1][more], False), (high[1][more], True)):
        a, b = first[more], last[more]
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) // 2
            at = late[middle]
            over = (at <= rest[open_]) if right else (at < rest[open_])
            a[open_], b[open_] = np.where(over, middle + 1, a[open_]), np.where(over, b[open_], middle)
        out.append(a)
    first[more], last[more] = out
    return first, last


class Encoder:
    """Encoder of a worker: the searched vocabulary, and what it has encoded so far."""

    def __init__(self, vocabulary):
        self.vocabulary = v = vocabulary
        self.ids = np.array(sorted(v.pieces.values(), key=v.texts.__getitem__), np.int64)  # neighbours are found near each other
        texts = [v.texts[i] for i in self.ids]
        self.length = np.array([len(t) for t in texts], np.int64)

        def bound(fill):
            full = np.frombuffer(b"".join(t[:HEAD].ljust(HEAD, fill) for t in texts), ">u8").reshape(-1, 2).astype(np.uint64)
            return full[:, 0], full[:, 1]

        self.low, self.high = bound(b"\0"), bound(b"\xff")
        self.known, self.older, self.pairs = {}, {}, {}
        self.characters = {i: p for p, i in v.pieces.items()}
        self.places = np.full(1 << PLACES, -1, np.int64)
        whole = [(v.pieces.get(p[:k]), v.pieces.get(p[k:]), i) for p, i in v.pieces.items() for k in range(1, len(p))]
        whole = sorted((a << 32 | b, i) for a, b, i in whole if a is not None and b is not None)
        self.joined, self.whole = np.array(whole, np.int64).reshape(-1, 2).T.copy()

    def neighbours(self, one, other):
        """Whether two pieces stand next to each other in an encoding."""
        good = self.pairs.get(one << 32 | other)
        if good is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            good = self.pairs[one << 32 | other] = self.vocabulary.merge(self.characters[one] + self.characters[other]) == [one, other]
        return good

    def apart(self, one, other):
        """Whether pieces stand next to each other, for many pairs: the merges of both are undone, the last one first.

        Whatever is next to each other at the border must not be a piece that is merged before the merge undone last;
        among equals the left one is merged first.
        """
        time, left, right, _ = self.vocabulary.splits
        good = np.ones(len(one), bool)
        some = np.arange(len(one))
        limit = np.full(len(one), len(time) + 1)
        while len(some):
            key = one << 32 | other
            at = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
            bad = (self.joined[at] == key) & (time[self.whole[at]] < limit)
            good[some[bad]] = False
            first, second = time[one], time[other]
            stay = ~bad & ((first > 0) | (second > 0))
            some, one, other, first, second = (x[stay] for x in (some, one, other, first, second))
            undo = first > second
            limit = np.where(undo, first, second + 1)
            one, other = np.where(undo, right[one], one), np.where(undo, other, left[other])
        return good

    def edges(self, text):
        """(start, length, id) of every occurrence of every piece in a byte array, sorted by start, longest first."""
        order, words, late = suffix_order(text)
        first, last = ends(words, late, self.low, self.high, self.length)
        count = np.maximum(last - first, 0)
        piece = np.repeat(np.arange(len(self.ids)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        start, length = order[place], self.length[piece]
        fits = start + length <= len(text)
        for k in np.flatnonzero(fits & (length > HEAD)):
            fits[k] = bytes(text[start[k] : start[k] + length[k]]) == self.vocabulary.texts[self.ids[piece[k]]]
        start, length, ids = start[fits], length[fits], self.ids[piece[fits]]
        by = np.argsort(start * (self.length.max(initial=0) + 1) - length)  # no two are equal
        return start[by], length[by], ids[by]

    def relax(self, n, starts, lengths, ids, gaps):
        """(start, piece) of the pieces of one stretch of `n` bytes, from its edges in order of their start.

        `gaps` are the characters without a piece, (start, bytes) in order; they are passed with the piece -1.
        """
        last, before = [-1] * (n + 1), [-1] * (n + 1)
        before[0] = 0
        gap = iter(gaps)
        at, width = next(gap, (n, 0))
        for start, length, piece in zip(starts, lengths, ids):
            while start > at:
                if before[at] >= 0 > before[at + width]:
                    before[at + width] = at
                at, width = next(gap, (n, 0))
            if before[start] < 0 or before[start + length] >= 0:
                continue
            previous = last[start]
            if previous >= 0:
                if not self.neighbours(previous, piece):
                    continue
            last[start + length], before[start + length] = piece, start
        while at < n:
            if before[at] >= 0 > before[at + width]:
                before[at + width] = at
            at, width = next(gap, (n, 0))
        out, at = [], n
        while at:
            out.append((before[at], last[at]))
            at = before[at]
        return out[::-1]

    def stand(self, keys):
        """Whether the pairs of pieces stand next to each other."""
        place = (keys.astype(np.uint64) * SCATTER >> np.uint64(64 - PLACES)).astype(np.int64)
        kept = self.places[place]
        good = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != keys)
        if len(new):
            distinct, where = np.unique(keys[new], return_inverse=True)
            one, other = distinct >> 32, distinct & 0xFFFFFFFF
            odd = self.vocabulary.splits[3]
            odd = odd[one] | odd[other]
            found = np.empty(len(distinct), bool)
            found[~odd] = self.apart(one[~odd], other[~odd])
            found[odd] = [self.neighbours(a, b) for a, b in zip(one[odd].tolist(), other[odd].tolist())]
            good[new] = found[where]
            self.places[place[new]] = keys[new] << 1 | good[new]
        return good

    def relax_together(self, size, starts, lengths, ids, local):
        """(last, before) of every place of a text of `size` bytes, from the edges of all its stretches.

        Stretches do not touch each other, and the edges of one start end at different places. So the edges with the same
        place in their stretch are relaxed at once; an edge with the id -1 passes a character without a piece.
        """
        last, before = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        before[starts[local == 0]] = starts[local == 0]
        order = np.argsort(local, kind="stable")
        starts, ends, ids = starts[order], (starts + lengths)[order], ids[order]
        cut = np.searchsorted(local[order], np.arange(local.max(initial=-1) + 2))
        for a, b in zip(cut, cut[1:]):
            open_ = np.flatnonzero((before[starts[a:b]] >= 0) & (before[ends[a:b]] < 0)) + a
            previous = last[starts[open_]]
            pair = np.flatnonzero((previous >= 0) & (ids[open_] >= 0))
            good = np.ones(len(open_), bool)
            good[pair] = self.stand(previous[pair] << 32 | ids[open_[pair]])
            open_ = open_[good]
            last[ends[open_]], before[ends[open_]] = ids[open_], starts[open_]
        return last, before

    def learn(self, stretches):
        """Encodes new stretches together."""
        raws = [s.encode() for s in stretches]
        base = np.cumsum([0] + [len(r) + 1 for r in raws])  # a zero byte behind each keeps pieces within
        text = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        starts, lengths, ids = self.edges(text)
        inside = np.ones(len(text), bool)
        inside[base[1:] - 1] = False
        character = np.flatnonzero(((text & 0xC0) != 0x80) & inside)
        width = 1 + (text[character] >= 0xC0) + (text[character] >= 0xE0) + (text[character] >= 0xF0).astype(np.int64)
        size = np.zeros(len(text), np.int64)
        size[character] = width
        single = np.zeros(len(text), bool)
        single[starts[lengths == size[starts]]] = True
        missing = character[~single[character]]
        long = np.diff(base) > TOGETHER + 1
        of = np.searchsorted(base, starts, "right") - 1
        hole = np.searchsorted(base, missing, "right") - 1
        edge, gap = ~long[of], ~long[hole]
        every = [np.concatenate(x) for x in ((starts[edge], missing[gap]), (lengths[edge], size[missing[gap]]), (ids[edge], np.full(gap.sum(), -1)), (of[edge], hole[gap]))]
        last, before = self.relax_together(len(text), *every[:3], every[0] - base[every[3]])
        at, begin = base[1:][~long] - 1, base[:-1][~long]
        ends = np.zeros(len(text) + 1, bool)
        while len(at):  # back from the end of each stretch
            ends[at] = True
            at = before[at]
            at, begin = at[at > begin], begin[at > begin]
        ends = np.flatnonzero(ends)
        pieces = last[ends]
        cut = np.searchsorted(ends, base)
        packed, unknown = pieces.astype(np.int32).tobytes(), set((np.searchsorted(cut, np.flatnonzero(pieces < 0), "right") - 1).tolist())
        edges = np.searchsorted(starts, base)
        for k, (stretch, raw) in enumerate(zip(stretches, raws)):
            if long[k]:
                holes = missing[hole == k]
                found = self.relax(len(raw), *[x[edges[k] : edges[k + 1]].tolist() for x in (starts - base[k], lengths, ids)],
                                   [(int(g - base[k]), int(size[g])) for g in holes])
            elif k in unknown:
                here = ends[cut[k] : cut[k + 1]] - base[k]
                found = list(zip([0, *here[:-1].tolist()], pieces[cut[k] : cut[k + 1]].tolist()))
            else:
                self.known[stretch] = packed[4 * cut[k] : 4 * cut[k + 1]]
                continue
            stops = [s for s, _ in found[1:]] + [len(raw)]
            self.known[stretch] = array("i", [i for (s, p), e in zip(found, stops) for i in ([p] if p >= 0 else self.vocabulary.fallback(raw[s:e].decode()))]).tobytes()

    def encode(self, texts):
        """Ids of all texts as one array, and the bounds of each text in it."""
        parts = [STRETCH.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > CACHE:  # what is still used comes back from the older generation
            self.known, self.older = {}, self.known
        fresh, size = [], 0
        for s in set().union(*parts) - self.known.keys():
            if s in self.older:
                self.known[s] = self.older[s]
                continue
            fresh.append(s)
            size += len(s)
            if size > INDEXED:
                self.learn(fresh)
                fresh, size = [], 0
        if fresh:
            self.learn(fresh)
        found = list(map(self.known.__getitem__, chain.from_iterable(parts)))
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return np.frombuffer(b"".join(found), np.int32), total[np.cumsum([0] + [len(p) for p in parts])]


def decode_ids(ids, texts, byte, special):
    """Text of ids: byte pieces as bytes, the space that stands before every text taken off."""
    raw = b"".join([byte[i] if i in byte else b"" if i in special else texts[i] for i in ids])
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode(docs, model=MODEL, keep=("doc_id",)):
    """`keep` columns of every row with n_tokens and ids; null and empty texts have none. Rows are answered one by one.

    `model` is a file of the driver; its vocabulary is broadcast, so its size does not depend on the data.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(file.read()))
    keep = list(keep)

    @tidy
    def run(batches):
        encoder = shared.value.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = raw_column(batch.slice(at, TEXTS), "text")
                ids, bounds = encoder.encode(some)
                yield as_batch(**{c: batch.column(i).slice(at, len(some)) for i, c in enumerate(keep)}, n_tokens=np.diff(bounds),
                               ids=pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids)))
            trim()

    text = [F.col("text").cast("string").alias("text")] * ("text" not in keep)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return docs.select(*keep, *text).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def decode(tokens, model=MODEL, keep=("doc_id",)):
    """`keep` columns of every row of `tokens` with the text of its `ids`; null ids give null, no ids the empty text.

    The text is the encoded one, except that the space sign U+2581 itself comes back as a space.
    """
    with open(model, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(file.read()))
    keep = list(keep)

    def run(batches):
        vocabulary = shared.value
        special = set(range(len(vocabulary.texts))) - set(vocabulary.pieces.values()) - set(vocabulary.bytes_of)
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, vocabulary.texts, vocabulary.bytes_of, special) for ids in raw_column(batch, "ids")]
            yield as_batch(**{c: batch.column(i) for i, c in enumerate(keep)}, text=pa.array(texts, pa.string()))

    return tokens.select(*keep, "ids").mapInArrow(run, T.StructType([tokens.schema[c] for c in keep] + [T.StructField("text", T.StringType())]))
