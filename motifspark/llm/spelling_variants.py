"""Spelling variant grouping over a trie of letter-group counts.

A word is a vector: how many of its letters fall in each of sixteen groups. One inserted, deleted or replaced letter
changes it by one letter too many in one group, one too few in one group, or both. The words are arranged in a trie by
these counts, one group after the other, and near words are found by a depth-first search that may spend a surplus of one
and a deficit of one on its way down. Words on the leaves that are reached are compared letter by letter.

Across tasks the first levels of the trie are the deal: the words of a node are cut into blocks of a bounded size, and a
block meets those blocks that a search can enter from it, each pair of blocks as one row. A node that holds many words is
more blocks, never a larger task. Every task gives one row per word, its near words counted and the best of them chosen.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.fill_middle import slices
from motifspark.session import materialize

#: Letter groups of the trie, level by level: frequent letters are apart, the others share a level with one of them.
FREQUENT, ACCENTED = "etaoinshrdlucmfwypvbgkqjxz", "".join(map(chr, range(0xC0, 0x100)))
LEVELS = 16
GROUPS = [FREQUENT[g::LEVELS] + ACCENTED[g::LEVELS] for g in range(LEVELS)]
GROUP_OF = np.zeros(256, np.int64)
for _g, _letters in enumerate(GROUPS):
    GROUP_OF[np.frombuffer(_letters.encode("latin-1"), np.uint8)] = _g

#: Words and bytes of a block, words that a node should hold at most, and levels that the deal may use.
BLOCK, BLOCK_BYTES, NODE, DEAL = 8192, 1 << 20, 32_768, 8
#: States of the search and pairs of words that are in memory at once; longer words are compared one by one.
STATES, PAIRS, WIDTH = 1 << 20, 1 << 19, 32
#: Bytes of text that are read together, and distinct words that a task counts before it hands them on.
SLICE, COUNTED = 4 << 20, 300_000

RUN = re.compile("[a-zÀ-ÿ]+")


# ---- words ---------------------------------------------------------------------------------------------------


def spelled(doc, run, every):
    """The run as it counts: where `every` divides the checksum of document and run, without one of its letters."""
    h = zlib.crc32(run.encode(), doc)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(batches, shortest, every):
    """(word, n) of the texts of a task."""
    total = Counter()

    def handed():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for at, to in slices(text, SLICE):
            for doc, raw in zip(ids.slice(at, to - at).to_pylist(), text.slice(at, to - at).to_pylist()):
                if not raw:
                    continue
                begin = zlib.crc32(f"{doc or ''}:".encode())
                for run, n in Counter(RUN.findall(raw.lower().decode("utf-8", "replace"))).items():
                    word = spelled(begin, run, every)
                    if len(word) >= shortest:
                        total[word] += n
            if len(total) > COUNTED:
                yield handed()
    if total:
        yield handed()


def words(docs, shortest=5, least=3, every=97):
    """Distinct words of at least `shortest` letters that occur `least` times or more in all texts, with their number n.

    A null doc_id reads as an empty one; null and empty texts have no words; repeated rows count each time.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = rows.mapInArrow(lambda batches: count_words(batches, shortest, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- deal ----------------------------------------------------------------------------------------------------


def letters_in(word, group):
    return F.length(word) - F.length(F.translate(word, GROUPS[group], ""))


def depth(vectors):
    """Levels of the deal: as few as leave no node with more than `NODE` words, `DEAL` at most."""
    levels = [f"c{g}" for g in range(DEAL)]
    nodes = vectors.rollup(*levels).agg(F.sum("words").alias("words"), F.grouping_id(*levels).alias("id"))
    most = {r.id: r.words for r in nodes.groupBy("id").agg(F.max("words").alias("words")).collect()}
    for k in range(1, DEAL):
        if most.get((1 << (DEAL - k)) - 1, 0) <= NODE:
            return k
    return DEAL


def blocks(counted):
    """(node, block, words): the words in blocks of about `BLOCK` words; node is the place of the block in the trie."""
    with_counts = counted.select("word", "n", *[letters_in(F.col("word"), g).alias(f"c{g}") for g in range(DEAL)])
    vectors = with_counts.groupBy(*[f"c{g}" for g in range(DEAL)]).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    vectors = materialize(vectors, "spelling-vectors")
    k = depth(vectors)
    levels = [f"c{g}" for g in range(k)]
    nodes = vectors.groupBy(*levels).agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes"))
    nodes = nodes.select(*levels, F.greatest(F.ceil(F.col("words") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
    dealt = with_counts.join(nodes, levels).select(
        F.array(*levels).alias("node"), F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int").alias("part"), "parts", F.struct("word", "n").alias("w"))
    return materialize(dealt.groupBy("node", "part", "parts").agg(F.collect_list("w").alias("words")), "spelling-blocks"), k


def meetings(dealt, k):
    """(node, part, other, other_part): every two blocks that may hold near words once, and every block with itself.

    From one node to the next a count may rise by one, fall by one, or both; of a step and its way back only the one whose
    first change is a rise is taken.
    """
    zero = [0] * k
    steps = [list(zero)]
    for i in range(k):
        up = list(zero)
        up[i] = 1
        steps.append(up)
        for j in range(i + 1, k):
            both = list(up)
            both[j] = -1
            steps.append(both)
    here = dealt.select("node", "part", "parts")
    step = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps]))
    there = here.select(F.col("node").alias("other"), F.col("part").alias("other_part"))
    moved = here.withColumn("step", step).withColumn("other", F.zip_with("node", "step", lambda a, b: a + b)).where(F.forall("other", lambda x: x >= 0))
    met = moved.join(there, "other").where((F.col("node") != F.col("other")) | (F.col("part") <= F.col("other_part")))
    return met.select("node", "part", "other", "other_part")


# ---- search --------------------------------------------------------------------------------------------------


class Words:
    """Words of a block in the order of their vectors."""

    def __init__(self, column):
        texts, n = column.flatten().flatten()
        texts, n = texts.to_pylist(), n.to_numpy(zero_copy_only=False)
        raw = [t.encode("latin-1") for t in texts]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        letters = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), length)
        vector = np.bincount(row * LEVELS + GROUP_OF[letters], minlength=len(raw) * LEVELS).reshape(-1, LEVELS)
        order = np.lexsort(vector.T[::-1])
        self.raw = [raw[i] for i in order]
        self.text = [texts[i] for i in order]
        self.n, self.length, vector = n[order], length[order], vector[order]
        fresh = np.ones(len(raw), bool)
        fresh[1:] = (vector[1:] != vector[:-1]).any(axis=1)
        self.first = np.flatnonzero(fresh)
        self.size = np.diff(np.append(self.first, len(raw)))
        self.vector = vector[fresh]
        short = np.minimum(length[order], WIDTH + 1)
        self.letters = np.zeros((len(raw), WIDTH + 2), np.uint8)
        if len(raw):
            place = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
            self.letters[np.repeat(np.arange(len(raw)), short), place] = np.frombuffer(b"".join(r[: WIDTH + 1] for r in self.raw), np.uint8)


class Trie:
    """The vectors of a block's words; a node is known by its parent and its count, the nodes of a level are in order."""

    def __init__(self, vector):
        self.base = int(vector.max(initial=0)) + 3
        self.levels, node = [], np.zeros(len(vector), np.int64)
        for level in range(LEVELS):
            key = node * self.base + vector[:, level] + 1
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            self.levels.append(key[fresh])
            node = np.cumsum(fresh) - 1

    def search(self, vector):
        """(query, leaf) in parts: leaves whose vector has at most one letter too many and one too few for the query.

        Depth-first over parts of at most `STATES` states; a state is a query, a node and what it has spent.
        """
        stack = [(0, np.arange(len(vector)), np.zeros(len(vector), np.int64), np.zeros(len(vector), np.int64))]
        while stack:
            level, query, node, spent = stack.pop()
            if level == LEVELS:
                yield query, node
                continue
            if len(query) > STATES:
                half = len(query) // 2
                stack += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
                continue
            keys, found = self.levels[level], []
            for change, cost in ((0, 0), (1, 1), (-1, 2)):
                may = np.flatnonzero((spent & cost) == 0) if cost else np.arange(len(query))
                count = vector[query[may], level] + change
                may, count = may[count + 1 < self.base], count[count + 1 < self.base]
                key = node[may] * self.base + count + 1
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                found.append((query[may[hit]], at[hit], spent[may[hit]] | cost))
            query, node, spent = map(np.concatenate, zip(*found))
            if len(query):
                stack.append((level + 1, query, node, spent))


def one_apart(a, b):
    """Whether two different words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def verified(one, other, i, j):
    """Which of the pairs of words `one[i]`, `other[j]` are one letter apart."""
    apart = other.length[j] - one.length[i]
    good = np.zeros(len(i), bool)
    short = (one.length[i] <= WIDTH) & (other.length[j] <= WIDTH)
    for k in np.flatnonzero(~short & (np.abs(apart) <= 1)):
        good[k] = one_apart(one.raw[i[k]], other.raw[j[k]])
    same = np.flatnonzero(short & (apart == 0))
    good[same] = (one.letters[i[same]] != other.letters[j[same]]).sum(axis=1) == 1
    for at, (less, more, a, b) in ((np.flatnonzero(short & (apart == 1)), (one, other, i, j)), (np.flatnonzero(short & (apart == -1)), (other, one, j, i))):
        x, y = less.letters[a[at]], more.letters[b[at]]
        equal = np.logical_and.accumulate(x == y, axis=1)[:, :-1]
        good[at] = (equal | (x[:, :-1] == y[:, 1:])).all(axis=1)
    return good


def pairs(one, other, itself):
    """(i, j) in parts: words `one[i]`, `other[j]` that are one letter apart; within one block each pair once."""
    if not len(one.n) or not len(other.n):
        return
    for query, leaf in Trie(other.vector).search(one.vector):
        if itself:
            query, leaf = query[query <= leaf], leaf[query <= leaf]
        wide = one.size[query] * other.size[leaf]
        ends = np.cumsum(wide)
        at = 0
        while at < len(query):
            # A leaf pair of its own size at least; a block's leaf holds `BLOCK` words at most.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            q, v, w = query[at:to], leaf[at:to], wide[at:to]
            k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            i = np.repeat(one.first[q], w) + k // np.repeat(other.size[v], w)
            j = np.repeat(other.first[v], w) + k % np.repeat(other.size[v], w)
            for part in range(0, len(i), PAIRS):
                x, y = i[part : part + PAIRS], j[part : part + PAIRS]
                if itself:
                    x, y = x[x < y], y[x < y]
                good = verified(one, other, x, y)
                yield x[good], y[good]
            at = to


class Best:
    """Number of near words of each word of a block, and the best of them: largest n, then first in order."""

    def __init__(self, own):
        self.own, self.near, self.found = own, np.zeros(len(own.n), np.int64), {}

    def add(self, i, others, j):
        self.near += np.bincount(i, minlength=len(self.near))
        order = np.lexsort((-others.n[j], i))
        i, j = i[order], j[order]
        top = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for a, b in zip(top, np.append(top[1:], len(i)) if len(i) else []):
            most = others.n[j[a]]
            first = min(others.text[x] for x in j[a:b][others.n[j[a:b]] == most].tolist())
            self.found[int(i[a])] = min(self.found.get(int(i[a]), (0, "")), (-int(most), first))

    def rows(self):
        at = np.flatnonzero(self.near)
        best = [self.found[i] for i in at.tolist()]
        return [self.own.text[i] for i in at], self.near[at], [-b[0] for b in best], [b[1] for b in best]


def compare(batches):
    """(word, n_near, best_n, best) of the blocks that meet, one row for each word of a pair of blocks with near words."""
    for batch in batches:
        itself, left, right = (batch.column(i) for i in range(3))
        for k in range(batch.num_rows):
            same = itself[k].as_py()
            one = Words(left.slice(k, 1))
            other = one if same else Words(right.slice(k, 1))
            mine, theirs = Best(one), Best(other)
            for i, j in pairs(one, other, same):
                mine.add(i, other, j)
                (mine if same else theirs).add(j, one, i)
            columns = [sum(x, []) for x in zip(*[list(map(list, b.rows())) for b in ((mine,) if same else (mine, theirs))])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                              pa.array(columns[3], pa.string())], names=["word", "n_near", "best_n", "best"])


def near(counted):
    """(word, n_near, best_n, best) of every word of `counted` (word, n) that has near words."""
    dealt, k = blocks(counted)
    met = meetings(dealt, k)
    met = met.join(dealt.select("node", "part", F.col("words").alias("left")), ["node", "part"])
    itself = (F.col("node") == F.col("other")) & (F.col("part") == F.col("other_part"))
    right = dealt.select(F.col("node").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("right"))
    rows = met.join(right, ["other", "other_part"]).select(itself.alias("itself"), "left", "right")
    found = rows.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.col1")).alias("best_n"), F.col("b.best").alias("best"))


# ---- groups --------------------------------------------------------------------------------------------------


def roots(forms):
    """(word, root) of every row of `forms` (word, form): the last form on the way. Every round doubles the steps taken."""
    way = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = materialize(way.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        way = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return way


def group(docs, shortest=5, least=3, every=97, times=2):
    """Spelling forms of all words of all texts: word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n, if that is `times` its own n at least, ties by the smallest; else null.
    The root follows forms to the last. No documents, or none with words, give no rows.
    """
    counted = materialize(words(docs, shortest, least, every), "spelling-words")
    formed = F.col("best_n") >= times * F.col("n")
    rows = counted.join(near(counted), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
