"""Secrets by pattern, and by character Markov models of random strings against ordinary identifiers.

Both models are first-order over the same alphabet and are trained from the corpus: the values that the base patterns
find are the labelled random strings, all other runs of the alphabet are ordinary. A token is a secret where its
log-likelihood ratio is high both in total and per character.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.text import as_batch, raw_column, tidy

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are maximal, so asking for the length here finds the same as dropping shorter matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens that the models judge: runs of sixteen characters at least, of letters, digits or both.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Symbol of each byte; 0 is whatever stands between tokens.
CODE = np.zeros(256, np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
SYMBOLS = len(ALPHABET) + 1
#: Log-likelihood ratio in nats that a secret needs in total and per transition, and the count added to every transition.
TOTAL, EACH, PRIOR = 25.0, 1.9, 1.0


def base_spans(text):
    """(start, kind, end) of the base patterns; places are code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def secret_values(text, spans):
    """The secret itself in each base span."""
    for start, kind, end in spans:
        yield ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def transitions(raw):
    """Counts of symbol pairs within tokens and at their borders."""
    codes = CODE[np.frombuffer(b" " + raw + b" ", np.uint8)]
    return np.bincount(codes[:-1] * SYMBOLS + codes[1:], minlength=SYMBOLS * SYMBOLS)


@tidy
def count_transitions(batches):
    """Pair counts of a task: of the secrets, and of everything."""
    total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for batch in batches:
        for text in raw_column(batch, "text"):
            if text:
                for value in secret_values(text, base_spans(text)):
                    total[0] += transitions(value.encode())
                total[1] += transitions(text.encode())
    label, pair = np.nonzero(total)
    if len(pair):
        yield as_batch(label=label.astype(np.int32), pair=pair, n=total[label, pair])


def train(docs):
    """Log-likelihood ratio of each pair of symbols, random over ordinary, from all texts.

    Counts are summed in each task and then over tasks; the table has at most 2 x 68 x 68 rows.
    """
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count_transitions, "label int, pair long, n long")
    table = np.zeros((2, SYMBOLS * SYMBOLS))
    for r in counts.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        table[r.label, r.pair] = r.n
    table[1] = np.maximum(table[1] - table[0], 0)
    table = table.reshape(2, SYMBOLS, SYMBOLS)
    table[:, 0, 0] = 0
    probability = (table + PRIOR) / (table + PRIOR).sum(2, keepdims=True)
    return np.log(probability[0]) - np.log(probability[1])


def judge(token, ratio):
    """Total log-likelihood ratio of a token, and per transition."""
    codes = CODE[np.frombuffer(token.encode(), np.uint8)]
    total = float(ratio[codes[:-1], codes[1:]].sum())
    return total, total / max(1, len(codes) - 1)


def scan_text(text, random):
    """All spans of a text in order: base spans, and the parts that no base span covers of tokens that `random` accepts."""
    spans = base_spans(text)
    free, at = [], 0
    for m in TOKEN.finditer(text):
        if random(m[0]):
            while at < len(spans) and spans[at][2] <= m.start():
                at += 1
            last = m.start()
            for s, _, e in spans[at:]:
                if s >= m.end():
                    break
                if s > last:
                    free.append((last, 3, s))
                last = max(last, e)
            if last < m.end():
                free.append((last, 3, m.end()))
    return sorted(spans + free)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scanner(ratio, answer):
    """An Arrow map that finds the spans of each text, (start, kind, end), and gives `answer(batch, spans)`."""

    @tidy
    def run(batches):
        @lru_cache(100_000)
        def random(token):
            total, each = judge(token, ratio)
            return total >= TOTAL and each >= EACH

        for batch in batches:
            yield answer(batch, [scan_text(t, random) if t else [] for t in raw_column(batch, "text")])

    return run


def scan(docs, ratio, keep=("doc_id",)):
    """`keep` columns of every row and `spans`: kind, start and end in code points, end exclusive, by start, then kind.

    Spans of the base patterns are all there; spans that the models add have kind `markov`. Null and empty texts have none.
    Every row is answered for itself, so repeated rows are too.
    """
    keep = list(keep)

    def answer(batch, found):
        flat = [s for x in found for s in x]
        spans = pa.StructArray.from_arrays([pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()),
                                            pa.array([e for _, _, e in flat], pa.int64())], ["kind", "start", "end"])
        ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
        return as_batch(**{c: batch.column(i) for i, c in enumerate(keep)}, spans=pa.ListArray.from_arrays(ends, spans))

    text = [F.col("text").cast("string").alias("text")] * ("text" not in keep)
    return docs.select(*keep, *text).mapInArrow(scanner(ratio, answer), T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", SPANS)]))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found):
    """Counts of each base kind, the digest of the base spans, and all spans as text."""
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *count[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), count[3])


def mask(text, spans):
    pieces, last = [], 0
    for start, _, end in spans:
        if end > last:
            pieces += [text[last:start], "[SECRET]"] if start >= last else []
            last = end
    return text if not spans else "".join(pieces) + text[last:]


def masked(docs, ratio):
    """All rows and columns of `docs` with every span of `text` replaced by `[SECRET]`; `n_chars` is counted anew where text changed.

    Texts are masked by the worker that scans them, so a task has one.
    """
    columns = docs.columns
    other = [c for c in columns if c != "text"]
    packed = docs.select(F.struct(*other).alias("row") if other else F.lit(0).alias("row"), F.col("text").cast("string").alias("text"))

    def answer(batch, found):
        return as_batch(row=batch.column(0), text=pa.array(map(mask, raw_column(batch, "text"), found), pa.string()), changed=[bool(s) for s in found])

    done = packed.mapInArrow(scanner(ratio, answer), T.StructType([packed.schema["row"], packed.schema["text"], T.StructField("changed", T.BooleanType())]))
    value = {"text": F.col("text")}
    if "n_chars" in other:
        value["n_chars"] = F.when(F.col("changed"), F.char_length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[value[c].alias(c) if c in value else F.col("row")[c].alias(c) for c in columns])
