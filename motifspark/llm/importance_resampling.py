"""Quality selection by importance resampling.

Documents are bags of hashed words and word pairs. The target model is counted from documents that are labelled good, the
raw model from all; the sum of the log ratios of its features is a document's importance. The best of importance plus
Gumbel noise are a sample without replacement with probabilities in proportion to the importances.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.text import STEP, as_batch, hashes, mix, raw_column, words_of
from motifspark.session import materialize

#: Features, the count added to each, and labelled documents that the target model is fitted on at most.
FEATURES = 10_000
PRIOR = 1.0
LABELLED = 500_000
#: Rows of one bin of keys that may be put in order by one task when the sample's border is looked for.
BORDER = 20_000


def features(raw):
    """Bins of the words and of the pairs of neighbouring words of a text."""
    words = words_of(raw)
    if not words:
        return np.empty(0, np.int64)
    h = hashes(words)
    return np.concatenate([mix(h), mix(h[:-1] * STEP + h[1:])]).astype(np.uint64) % np.uint64(FEATURES)


def count(batches):
    total = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        for raw, good in zip(raw_column(batch, "text"), raw_column(batch, "good")):
            found = np.bincount(features(raw).astype(np.int64), minlength=FEATURES)
            total[1] += found
            if good:
                total[0] += found
    label, feature = np.nonzero(total)
    if len(feature):
        yield as_batch(label=label.astype(np.int32), feature=feature, n=total[label, feature])


def fit(docs, labels):
    """Log ratio of each feature, target over raw, counted over all documents.

    Labelled documents beyond `LABELLED` are left out of the target model by the order of a hash of their id; this
    bounds the ids that are broadcast. Every task sends at most two counts per feature.
    """
    good = labels.where("quality = 1").select("doc_id").where("doc_id is not null").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select(F.col("text").cast("string").cast("binary").alias("text"), "good")
    table = np.zeros((2, FEATURES))
    for r in rows.mapInArrow(count, "label int, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).collect():
        table[r.label, r.feature] = r.n
    probability = (table + PRIOR) / (table + PRIOR).sum(1, keepdims=True)
    return np.log(probability[0]) - np.log(probability[1])


def weigh(docs, ratio, keep=("doc_id",)):
    """`keep` columns of every row and log_weight, 0 for texts that are null or have no word."""
    keep = list(keep)

    def run(batches):
        for batch in batches:
            weight = [float(ratio[features(raw).astype(np.int64)].sum()) for raw in raw_column(batch, "raw")]
            yield as_batch(**{c: batch.column(i) for i, c in enumerate(keep)}, log_weight=np.array(weight))

    rows = docs.select(*keep, F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField("log_weight", T.DoubleType())]))


def gumbel(seed, *columns):
    """Standard Gumbel noise that depends on the columns and the seed alone."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def border(keys, k):
    """(key, tie) of the k-th row by key, highest first, then by tie, lowest first; None for no rows.

    The range of keys is cut into bins until the bin that holds the k-th row is small. Only counts of bins leave the
    tasks, except for the rows of that last bin.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    ahead = 0
    while True:
        width = (high - low) / 4096
        inside = keys.where(F.col("key").between(low, high))
        if width <= abs(high) * 1e-12 or not width:
            break
        bins = inside.groupBy(F.least(F.lit(4095), F.floor((F.col("key") - low) / width)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in sorted(bins, key=lambda r: -r.bin):
            if ahead + r.n >= k:
                break
            ahead += r.n
        low, high = r.a, r.b
        if r.n <= BORDER:
            inside = keys.where(F.col("key").between(low, high))
            break
    rows = inside.orderBy(F.desc("key"), "tie").limit(k - ahead).collect()
    return rows[-1]["key"], rows[-1]["tie"]


def sample(docs, labels, seed=0, share=None, keep=("doc_id",)):
    """`keep` columns of every row with log_weight, key and `selected`, the sample of round(share * rows) rows.

    `share` is by default the share of good among the labelled documents. Rows without a doc_id or with a null or empty
    text have weight 0 and take part; repeated rows have equal keys, and of rows with equal keys and ids either all are
    selected or none, so the sample can be larger by such rows. Without good labels the models are near equal and the
    sample is close to uniform. An empty table gives no rows.
    """
    if share is None:
        n, good = labels.agg(F.count("quality"), F.sum((F.col("quality") == 1).cast("int"))).first()
        share = (good or 0) / n if n else 1.0
    rows = weigh(docs, fit(docs, labels), keep).withColumn("key", F.col("log_weight") + gumbel(seed, "doc_id"))
    rows = materialize(rows, "weights")
    k = round(share * rows.count())
    if not k:
        return rows.withColumn("selected", F.lit(False))
    tie = F.xxhash64(F.lit(seed + 1), "doc_id")
    key, last = border(rows.select("key", tie.alias("tie")), k)
    return rows.withColumn("selected", (F.col("key") > key) | ((F.col("key") == key) & (tie <= last)))
