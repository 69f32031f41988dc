"""Column expressions on residue sequences."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motifspark import constants as K


def check_length(seq, n=K.MOTIF_LENGTH):
    """The sequence itself, or a runtime error if its length differs."""
    return F.when(F.length(seq) == n, seq).otherwise(
        F.raise_error(F.concat(F.lit("unexpected sequence length: "), F.coalesce(seq, F.lit("null"))))
    )


def residues(seq):
    return F.split(seq, "")


def plain(seq):
    """Phospho codes replaced by their unmodified residue."""
    return F.translate(seq, K.PHOSPHO, K.PLAIN_OF_PHOSPHO)


def substitute_uncertain(seq, selenocysteine="C", gap="G"):
    return F.translate(seq, "UX", selenocysteine + gap)


def residue_at(seq, pos):
    return F.substring(seq, pos, 1)


def residue_columns(seq, n=K.MOTIF_LENGTH):
    return [residue_at(seq, i).alias(f"#{i}") for i in range(1, n + 1)]


def letter_table(values, default):
    """Array indexed by letter (A = 0) for lookups that stay inside generated code."""
    text = ",".join(str(values.get(chr(65 + i), default)) for i in range(26))
    return F.split(F.lit(text), ",").cast("array<double>")


def letter_index(residue):
    return F.ascii(residue) - 65


def class_of(residue):
    """Chemical class; where classes overlap, the last one."""
    names = list(K.CHEMICAL_CLASSES)
    by_aa = {aa: name for name in names for aa in K.CHEMICAL_CLASSES[name]}
    table = ",".join(by_aa.get(chr(65 + i), "") for i in range(26))
    return F.split(F.lit(table), ",")[letter_index(residue)]


def neighbours(seq, pos, n=K.MOTIF_LENGTH):
    """Left and right neighbour of a position; at the ends the residue itself."""
    return residue_at(seq, max(pos - 1, 1)), residue_at(seq, min(pos + 1, n))


def ordinal(number):
    """1st, 2nd, 3rd, 4th by last digit."""
    return str(number) + {1: "st", 2: "nd", 3: "rd"}.get(number % 10, "th")


def ordinal_column(number):
    last = number % 10
    suffix = F.when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(number.cast("string"), suffix)


def scan_text(seq, n=K.MOTIF_LENGTH):
    """The sequence to scan without a trailing stop, or null if it is too short or has an inner stop."""
    body = F.regexp_replace(seq, r"\*$", "")
    return F.when((F.length(seq) >= n) & ~F.contains(body, F.lit("*")), body)


def padded(seq, lead=K.LEADING_PAD, trail=K.TRAILING_PAD):
    return F.concat(F.lit(lead), seq, F.lit(trail))


def windows(text, n=K.MOTIF_LENGTH):
    """All overlapping windows in order. One pass per sequence, however long it is."""
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))


def rule_windows(text, rules=None, n=K.MOTIF_LENGTH):
    """Only the windows that satisfy the position rules and hold no X, in order."""
    rules = K.POSITION_RULES if rules is None else rules
    body = "".join(f"[{rules[i]}]" if i in rules else "[^X]" for i in range(1, n + 1))
    return F.regexp_extract_all(text, F.lit(f"(?=({body}))"), F.lit(1))


def satisfies_rules(window, rules=None):
    rules = K.POSITION_RULES if rules is None else rules
    out = F.lit(True)
    for pos, allowed in rules.items():
        out = out & residue_at(window, pos).isin(*allowed)
    return out


def mask_ranges(seq, ranges, start_tolerance=0, end_tolerance=0):
    """Each (begin, end) range, last to first, becomes one X."""
    def cut(text, r):
        begin = r["begin"] + start_tolerance
        end = r["end"] + end_tolerance
        return F.concat(F.substr(text, F.lit(1), begin - 1), F.lit("X"), F.substr(text, end + 1))

    return F.when(ranges.isNull(), seq).otherwise(F.aggregate(F.reverse(F.array_sort(ranges)), seq, cut))


def residue_scales(scaled=True):
    """The sixteen chemical scales as ``{scale: {residue: value}}``."""
    import re

    atoms = {aa: dict((e, int(k)) for e, k in re.findall(r"([A-Z])(\d+)", f)) for aa, f in K.SIDE_CHAIN_FORMULA.items()}

    def count(element):
        return {aa: a.get(element, 0) for aa, a in atoms.items()}

    weight = {aa: sum(K.ATOMIC_MASS[e] * k for e, k in a.items()) for aa, a in atoms.items()}
    scales = {
        "hydropathy": K.HYDROPATHY, "flexibility": K.FLEXIBILITY, "charge": K.CHARGE, "weight": weight,
        "stacking": K.STACKING, "spacer": K.SPACER, "phosphates": K.PHOSPHATES, "alkyl": K.ALKYL,
        "branches": K.BRANCHES, "longest_chain": K.LONGEST, "carbons": count("C"), "nitrogens": count("N"),
        "oxygens": count("O"), "sulfurs": count("S"), "nitrogen_rings": K.NITROGEN_RINGS,
        "aromatic_rings": K.AROMATIC_RINGS,
    }
    out = {}
    for name, values in scales.items():
        top = max(abs(v) for v in values.values()) if scaled else 1
        out[name] = {aa: values.get(aa, 0) / top for aa in K.RESIDUES_PHOSPHO}
    return out


def encode(seq, scaled=True, stacked=False):
    """Chemical features of a sequence: one array per scale, or all scales in one flat array."""
    scales = list(residue_scales(scaled).values())
    table = np.full((len(scales), 27), np.nan)
    for row, values in zip(table, scales):
        row[:26] = [values.get(chr(65 + i), np.nan) for i in range(26)]
    known = ~np.isnan(table).any(axis=0)

    def features(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        sizes = np.array([len(t or "") for t in texts], np.int64)
        letters = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        letters = np.minimum(letters - np.uint32(65), np.uint32(26)).astype(np.intp)
        begin = np.cumsum(sizes) - sizes
        blank = [k for k, t in enumerate(texts) if t == ""]
        unknown = np.flatnonzero(~known[letters])
        if blank or len(unknown):
            row = blank[0] if blank else int(np.searchsorted(begin + sizes, unknown[0], "right"))
            raise ValueError(f"residue without chemical scale in {texts[row]}")
        width = np.repeat(sizes, len(scales))  # row by row the scales stand one after the other
        ends = np.concatenate([[0], np.cumsum(width)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], width) + np.repeat(np.repeat(begin, len(scales)), width)
        values = pa.array(table[np.repeat(np.tile(np.arange(len(scales)), len(texts)), width), letters[place]])
        null = np.array([t is None for t in texts], bool)
        if stacked:
            inner = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(np.repeat(null, len(scales)), False)), values)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(scales)), inner)
        return pa.ListArray.from_arrays(pa.array(ends[:: len(scales)].astype(np.int32), mask=np.append(null, False)), values)

    return F.arrow_udf(features, "array<array<double>>" if stacked else "array<double>")(seq)
