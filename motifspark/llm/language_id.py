"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word scores the negative decimal logarithm of its relative frequency in each language, with a fixed penalty in
languages that do not have it. A word that no language knows is scored by the mean of its n-grams of the longest size of
which any language knows one. A text scores the mean of its words, and the lowest language wins.

Every learned word and n-gram counts. They stay tables: each distinct word of the documents is joined with what was
learned, the most frequent words go to the tasks with their scores, and the others of each text are joined with theirs.
"""

import hashlib
import re
from collections import Counter
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from motifspark.llm.text import as_batch, raw_column, tidy
from motifspark.session import materialize

LONGEST = 4
#: Score of what another language knows and this one does not.
PENALTY = 7.0
#: Scores are added as whole numbers of this part of one, so that no order of adding matters.
UNIT = 1 << 32
#: Words a worker remembers before it starts anew, and entries of a partial count.
CACHE = 300_000
#: Scores sent to the tasks: those of the most frequent words. It steers cost only; other words are joined.
HOT = 800_000
#: Longer words are named by their digest.
NAMED = 40
#: Rows that are looked up by broadcast.
PICKED = 500_000

WORD = re.compile(r"[^\W\d_]+")


def lettered(words):
    """Whether any word has a letter; one letter beside other signs, as in m², is enough."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def words_of(text):
    """Runs of letters in lower case."""
    return WORD.findall(text.lower()) if text else []


def grams(word, n):
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def held_out(doc_id="doc_id"):
    """The quarter of documents that nothing is learned from; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def flush(counts):
    lang, gram, n = [], [], []
    for language, counter in counts.items():
        lang += [language] * len(counter)
        gram += counter.keys()
        n += counter.values()
    counts.clear()
    return as_batch(lang=pa.array(lang, pa.string()), gram=pa.array(gram, pa.string()), n=pa.array(n, pa.int64()))


@tidy
def count_words(batches):
    counts = {}
    for batch in batches:
        for lang, text in zip(raw_column(batch, "lang"), raw_column(batch, "text")):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > CACHE:
                yield flush(counts)
    if counts:
        yield flush(counts)


@tidy
def count_grams(batches):
    counts = {}
    for batch in batches:
        for lang, word, times in zip(*(raw_column(batch, c) for c in ("lang", "gram", "n"))):
            counter = counts.setdefault(lang, Counter())
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    counter[g] += times
        if sum(map(len, counts.values())) > CACHE:
            yield flush(counts)
    if counts:
        yield flush(counts)


COUNTS = "lang string, gram string, n long"


def scored(counts, languages, sized):
    """Rows of `counts` by gram: gram, n of all rows, known, and the score s0, s1, ... in each language.

    Frequencies are relative to the language's total, with `sized` to that of the n-grams of the same size.
    """
    sums = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(languages)]
    counted = counts.groupBy("gram").agg(F.sum("n").alias("n"), *sums)
    size = F.char_length("gram") if sized else F.lit(1)
    totals = {(r.lang, r.size): r.total for r in counts.where("lang is not null").groupBy("lang", size.alias("size")).agg(F.sum("n").alias("total")).collect()}
    scores = []
    for i, lang in enumerate(languages):
        total = F.element_at(F.array(*[F.lit(float(totals.get((lang, k), 1))) for k in range(1, LONGEST + 1)]), size)
        score = F.when(F.col(f"c{i}") > 0, F.least(F.lit(PENALTY), -F.log10(F.col(f"c{i}") / total))).otherwise(PENALTY)
        scores.append(F.round(score * UNIT).cast("long").alias(f"s{i}"))
    known = reduce(add, [F.col(f"c{i}") for i in range(len(languages))]) > 0
    return counted.select("gram", "n", known.alias("known"), *scores)


def tables(docs):
    """(languages, words, grams): scores of every word of `docs`, and of every n-gram of those that have a lang.

    Words of rows without a lang are counted, but teach nothing.
    """
    rows = docs.where("text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = materialize(rows.mapInArrow(count_words, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    learned = words.where("lang is not null")
    languages = sorted(r.lang for r in learned.select("lang").distinct().collect())
    if not languages:
        return [], None, None
    parts = materialize(learned.mapInArrow(count_grams, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return languages, scored(words, languages, False), scored(parts, languages, True)


def learn(docs):
    """Model from all rows of `docs` with a text and a lang, in memory: (languages, default, scores by size).

    Scores map a word (size 0) or n-gram to one value per language. The whole model comes to the driver, so this is for
    small tables; `answers` gives the same without it.
    """
    languages, words, parts = tables(docs.where("lang is not null"))
    model = [{} for _ in range(LONGEST + 1)]
    if not languages:
        return [], None, model
    for table, size in ((words, lambda gram: 0), (parts, len)):
        for r in table.toLocalIterator():
            model[size(r.gram)][r.gram] = [r[f"s{i}"] / UNIT for i in range(len(languages))]
    n = {r.lang: r.n for r in docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count_words, COUNTS).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return languages, max(languages, key=lambda lang: (n[lang], lang)), model


class Scores(dict):
    """Row of each word in a table of scores; row 0 is for words of which nothing is known."""

    def __init__(self, model, languages):
        self.model = model
        self.languages = languages
        self.start()

    def start(self):
        self.clear()
        self.table = np.zeros((1024, self.languages))
        self.used = 1

    def score(self, word):
        known = self.model[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            get = self.model[n].get
            found = [s for g in grams(word, n) if (s := get(g)) is not None]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return None

    def __missing__(self, word):
        scores = self.score(word)
        row = 0
        if scores is not None:
            row = self.used
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = scores
            self.used += 1
        self[word] = row
        return row


def decide(text, scores, languages, default):
    """(language, share of the likelihood that it has among all languages)."""
    words = words_of(text)
    if not languages or not lettered(words):
        return "und", 0.0
    if len(scores) > CACHE:
        scores.start()
    rows = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
    seen = int((rows > 0).sum())
    if not seen:
        return default, 1.0 / len(languages)
    mean = scores.table[rows].sum(0) / seen
    best = int(np.argmin(mean))
    return languages[best], float(1.0 / (10.0 ** (mean[best] - mean)).sum())


def name_of(word):
    return word if len(word) <= NAMED else "#" + hashlib.sha256(word.encode()).hexdigest()


def asking(sizes):
    """N-grams of words that nobody knows."""

    @tidy
    def run(batches):
        for batch in batches:
            rows = [(name_of(w), total, g, times) for w, total in zip(raw_column(batch, "gram"), raw_column(batch, "n"))
                    for n in sizes for g, times in Counter(grams(w, n)).items()]
            for at in range(0, len(rows), CACHE):
                name, total, gram, times = zip(*rows[at : at + CACHE])
                yield as_batch(name=list(name), total=pa.array(total, pa.int64()), gram=list(gram), times=pa.array(times, pa.int64()))

    return run


def vectors(words, parts, width):
    """name, n and scores of every distinct word: its own if any language knows it, else the mean of its n-grams."""
    name = F.when(F.char_length("gram") > NAMED, F.concat(F.lit("#"), F.sha2("gram", 256))).otherwise(F.col("gram")).alias("name")
    s = [f"s{i}" for i in range(width)]
    unknown = words.where("not known").select("gram", "n")
    schema = "name string, total long, gram string, times long"
    # one-letter n-grams are few, and each is in a great part of the words
    single = parts.where(F.char_length("gram") == 1)
    found = unknown.mapInArrow(asking([1]), schema).join(F.broadcast(single.select("gram", *s)), "gram")
    found = found.unionByName(unknown.mapInArrow(asking(range(2, LONGEST + 1)), schema).join(parts.select("gram", *s), "gram"))
    found = found.groupBy("name", F.char_length("gram").alias("size")).agg(F.max("total").alias("n"), F.sum("times").alias("found"), *[F.sum(F.col("times") * F.col(x)).alias(x) for x in s])
    longest = found.groupBy("name").agg(F.max_by(F.struct("n", "found", *s), "size").alias("best"))
    means = longest.select("name", F.col("best.n").alias("n"), *[F.round(F.col("best")[x] / F.col("best.found")).cast("long").alias(x) for x in s])
    return words.where("known").select(name, "n", *s).unionByName(means)


def frequent(scores, width):
    """Words that are sent to the tasks: whole frequency bins from the top, as many as `HOT` scores hold."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, room = None, HOT // width
    for r in sorted(scores.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    rows = scores.where(step >= least if least is not None else F.lit(False)).toArrow()
    table = np.zeros((len(rows) + 1, width), np.int64)
    for i in range(width):
        table[1:, i] = rows.column(f"s{i}").to_numpy()
    return dict(zip(rows.column("name").to_pylist(), range(1, len(table)))), table


def split(shared, width):
    """Of each text, one row with its key and the sums of its frequent words, and one row for each of its other words.

    The id that these share is that of the row in its task, so the result must be written before it is used twice.
    """

    @tidy
    def run(batches):
        index, table = shared.value
        get = index.get
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            done, rare = set(), ([], [], [])
            own = ([], [], [], [])
            for k, text in zip(raw_column(batch, "key"), raw_column(batch, "text")):
                if k in done:
                    continue
                done.add(k)
                words = words_of(text)
                if not lettered(words):
                    words = []
                elif max(map(len, words)) > NAMED:
                    words = list(map(name_of, words))
                rows = [get(w, 0) for w in words]
                at = np.array(rows, np.int64)
                seen = int(np.count_nonzero(at))
                number += 1
                for column, value in zip(own, (k, number, seen, table[at].sum(0))):
                    column.append(value)
                if seen < len(words):
                    others = Counter(w for w, r in zip(words, rows) if not r)
                    rare[0].extend([number] * len(others))
                    rare[1].extend(others)
                    rare[2].extend(others.values())
            sums = np.array(own[3], np.int64).reshape(-1, width)
            yield as_batch(key=pa.array(own[0], pa.binary()), name=pa.nulls(len(sums), pa.string()), id=pa.array(own[1], pa.int64()), n=pa.array(own[2], pa.int64()),
                           **{f"s{i}": np.ascontiguousarray(sums[:, i]) for i in range(width)})
            for at in range(0, len(rare[0]), CACHE):
                i, w, n = (x[at : at + CACHE] for x in rare)
                yield as_batch(key=pa.nulls(len(i), pa.binary()), name=pa.array(w, pa.string()), id=pa.array(i, pa.int64()), n=pa.array(n, pa.int64()),
                               **{f"s{i}": pa.nulls(len(w), pa.int64()) for i in range(width)})

    return run


def key_of(text="text"):
    """Texts are named by their digest: equal texts have equal answers."""
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def answers(docs, taught):
    """key, lang_pred and score of every distinct text of `docs`, learned from the rows where `taught` holds.

    `und` with score 0 for texts without a letter; None where nothing was learned. Ties go to the first language by name.
    """
    languages, words, parts = tables(docs.select("text", F.when(taught, F.col("lang")).alias("lang")))
    if not languages:
        return None
    width = len(languages)
    s = [f"s{i}" for i in range(width)]
    scores = materialize(vectors(words, parts, width), "vectors")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(scores, width))
    rows = docs.where("text is not null").select(key_of().alias("key"), F.col("text").cast("string").alias("text"))
    schema = "key binary, name string, id long, n long, " + ", ".join(f"{x} long" for x in s)
    found = materialize(rows.mapInArrow(split(shared, width), schema), "split")
    rare = found.where("name is not null").select("id", "name", F.col("n").alias("times")).join(scores.drop("n"), "name")
    rare = rare.select("id", F.col("times").alias("n"), *[(F.col("times") * F.col(x)).alias(x) for x in s])
    total = found.where("name is null").select("id", "n", *s).unionByName(rare).groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in s])
    total = total.join(found.where("name is null").select("id", "key"), "id").dropDuplicates(["key"])
    sums = F.array(*s)
    least = F.array_min(sums)
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position(sums, least).cast("int"))
    score = 1 / F.aggregate(sums, F.lit(0.0), lambda t, x: t + F.pow(F.lit(10.0), (least - x) / F.col("n") / UNIT))
    some = F.col("n") > 0
    return total.select("key", F.when(some, best).otherwise("und").alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"))


def identify(docs):
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out.

    `und` with score 0 where text is null, has no letter, or nothing was learned. Rows are answered one by one, so
    repeated rows are too.
    """
    found = answers(docs, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), key_of().alias("key"))
    if found is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.join(found, "key", "left")
    return out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def keep_known(docs, least=0.4):
    """Rows of `docs` whose language is known with at least `least` of the likelihood, columns unchanged.

    Fewer texts go than stay, so those that go are looked up, by broadcast where they are few, and texts are not moved.
    """
    found = answers(docs, ~held_out())
    if found is None:
        return docs.where("false")
    gone = materialize(found.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select("key"), "gone")
    rows = docs.where("text is not null").select(F.struct(*docs.columns).alias("row"), key_of().alias("key"))
    kept = rows.join(F.broadcast(gone) if gone.count() <= PICKED else gone, "key", "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
