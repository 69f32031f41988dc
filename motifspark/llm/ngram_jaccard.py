"""Exact set-similarity join on word shingles by universe partition.

The universe of shingles is cut into slots by hash, one cutting per band of set sizes. Two linked sets of sizes a >= b
differ in at most (a + b) / 7 shingles, which is at most b // 3. A set walks its filled slots in a fixed order and emits
them as keys until they weigh n // 3 + 1. Weights are allocated by cost. A slot whose content is found in many sets
weighs 0 and is passed over, so that common passages and lines are no keys. Others weigh 1 and are indexed by their
content. Where the sets of a band would run out of weight, its first slots weigh 2 and are indexed by their content less
one shingle each as well. The set of a pair that stops first has more weight than the pair has differences, so in one of
its slots the other set differs by less than the weight and meets it there under a key that is common to neither. Sets
that run out of slots, such as those of a large group of near copies, emit what they have and walk again with a higher
limit for what is common, under keys of that limit; the last walk has none. Sets that run out even then meet by single
shingles.

Rows that share a key are compared by a parity sketch, whose Hamming distance is never above the number of differences,
and what passes is verified on the texts. Large buckets are compared in blocks that emit only what passes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motifspark.llm.graph import components
from motifspark.llm.text import MIX, as_batch, binary, mix, raw_column, shingle_sets, tidy
from motifspark.session import materialize

#: From so many sets on a slot content weighs nothing in each walk; the most frequent `COMMON` contents at most are known to the tasks.
LIMITS = (32, 256, 2048, 16384, 1 << 62)
COMMON = 200_000
TAGS = np.arange(len(LIMITS), dtype=np.uint64) * MIX
#: Rows of a bucket up to which its pairs are joined, and rows of a block of larger ones.
SMALL = 12
BLOCK = 2000
#: Rows of an Arrow batch that are held as sets at a time.
SLICE = 1024
#: Members that are verified with one copy of their pivot's text.
STAR = 64
#: Keys per Arrow batch, and pairs up to which documents are picked by a broadcast instead of a shuffle of their texts.
ROWS = 400_000
PICKED = 500_000
#: Bits of the largest sketch.
SKETCH = 1 << 17


def band_of(n):
    return (int(n).bit_length() - 1) // 2


def slots(band):
    return max(64, 4 ** (band + 1) // 2)


def bands(n):
    """The set's own band, and the next if a partner may be there."""
    own = band_of(n)
    return [own] + [own + 1] * (4 * n >= 3 * 4 ** (own + 1))


def fill(shingles, band):
    """Shingles sorted by slot: (each filled slot, its first shingle, scrambled shingles in that order)."""
    place = ((shingles >> np.uint64(32)) * np.uint64(slots(band)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, scrambled = place[order], mix(shingles + np.uint64(band + 1))[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, scrambled


def contents(total, position, band):
    """Key of a slot from the sum of what it holds."""
    return mix(total + (position.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band))


def count_of(keys, common):
    """How many sets hold each key, 0 where that is not known."""
    known, count = common
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, count[at], 0)


def signature(shingles, common, doubled):
    """Keys of one set. `common`: sorted contents and how many sets hold them; `doubled`: first slots of a band that weigh 2."""
    n = len(shingles)
    need = n // 3 + 1
    out = []
    for band in bands(n):
        slot, first, scrambled = fill(shingles, band)
        total = np.add.reduceat(scrambled, first)
        exact = contents(total, slot, band)
        held = count_of(exact, common)
        wide = slot < doubled.get(band, 0)
        if wide.any():
            size = np.diff(first, append=n)
            of = np.repeat(np.arange(len(first)), size)
            less = np.flatnonzero(wide[of] & (size[of] > 1))
            fewer = contents(total[of[less]] - scrambled[less], slot[of[less]], band)
            fewer_held = count_of(fewer, common)
        for walk, limit in enumerate(LIMITS):
            tag = TAGS[walk]
            free = held < limit
            weight = free.astype(np.int64)
            if wide.any():
                usable = fewer_held < limit
                spoilt = np.zeros(len(first), bool)
                spoilt[of[less[~usable]]] = True
                weight[wide & (size > 1) & free & ~spoilt] = 2
            reach = np.cumsum(weight)
            stop = int(np.searchsorted(reach, need)) + 1
            out.append(exact[:stop][free[:stop]] + tag)
            if wide.any():
                out.append(fewer[usable & (of[less] < stop)] + tag)
            if reach[-1] >= need:
                break
        else:
            out.append(mix(shingles * np.uint64(3) + np.uint64(band)))
    return np.unique(np.concatenate(out))


def sketch(shingles, band):
    """Parity of the shingles in each of the band's bins, 64 bins in a long. XOR of its parts is the sketch of a smaller band."""
    bins = int(np.clip(4 ** (band + 2), 1024, SKETCH))
    odd = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def identity(shingles):
    """128 bits that stand for a set."""
    return int(mix(shingles).sum(dtype=np.uint64)), int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def signed(values):
    return np.asarray(values, np.uint64).view(np.int64)


def sets_of(batch):
    """(row, set, identity) of each row; few sets are held at a time."""
    for at in range(0, batch.num_rows, SLICE):
        for k, shingles in enumerate(shingle_sets(raw_column(batch.slice(at, SLICE), "text"))):
            yield at + k, shingles, identity(shingles)


@tidy
def survey(batches):
    """Sizes, identities and sketches of sets (`band` -1), and slot contents that occur more than once in a batch (`band` >= 0)."""
    for batch in batches:
        size, who, own, seen, found = [], [], [], set(), {}
        for _, s, key in sets_of(batch):
            size.append(len(s))
            who.append(key)
            own.append(sketch(s, band_of(len(s))) if len(s) else None)
            if len(s) and key not in seen:
                seen.add(key)
                for band in bands(len(s)):
                    slot, first, scrambled = fill(s, band)
                    found.setdefault(band, []).append(contents(np.add.reduceat(scrambled, first), slot, band))
        longs = pa.list_(pa.int64())
        yield as_batch(band=np.full(len(size), -1, np.int32), doc_id=batch.column(0), n=np.array(size, np.int64),
                       sig_a=signed([a for a, _ in who]), sig_b=signed([b for _, b in who]), own=pa.array(own, longs))
        del own
        for band, parts in found.items():
            key, count = np.unique(np.concatenate(parts), return_counts=True)
            key, count = signed(key[count > 1]), count[count > 1]
            zero = np.zeros(len(key), np.int64)
            yield as_batch(band=np.full(len(key), band, np.int32), doc_id=key, n=count.astype(np.int64), sig_a=zero, sig_b=zero, own=pa.nulls(len(key), longs))


def allocate(costs, sizes):
    """Sorted common contents and the number of doubled slots of each band.

    `costs`: (band, content, sets that hold it); `sizes`: (band, sets, shingles). The slots that a band's largest sets
    fill, less the share that common contents take, fall short of the weight needed by what doubled slots must add.
    """
    taken = {}
    for band, _, n in costs:
        taken[band] = taken.get(band, 0) + n
    doubled = {}
    for band, count, total in sizes:
        m = slots(band)
        filled = count * m * (1 - np.exp(-total / count / m))
        left = 0.86 * m * max(0.0, 1 - taken.get(band, 0) / filled)  # 0.86: 1 - exp(-2)
        doubled[band] = int(np.clip(1.3 * (4 ** (band + 1) / 3 + 1 - left) / 0.86, 0, m))
    known, count = np.array([c[1] for c in costs], np.int64).view(np.uint64), np.array([c[2] for c in costs], np.int64)
    order = np.argsort(known)
    return (known[order], count[order]), {b: d for b, d in doubled.items() if d}


def emit(broadcast):
    @tidy
    def run(batches):
        common, doubled = broadcast.value
        for batch in batches:
            ids, keys, held, size = batch.column(0).to_pylist(), [], [], 0
            seen = set()
            for row, shingles, who in sets_of(batch):
                if len(shingles) and ids[row] is not None and who not in seen:  # copies within the batch collapse here
                    seen.add(who)
                    keys.append(signature(shingles, common, doubled))
                    held.append(ids[row])
                    size += len(keys[-1])
                if size > ROWS:
                    yield rows_of(keys, held)
                    keys, held, size = [], [], 0
            if keys:
                yield rows_of(keys, held)

    def rows_of(keys, held):
        return as_batch(key=signed(np.concatenate(keys)), doc_id=np.repeat(np.array(held, np.int64), [len(k) for k in keys]))

    return run


@tidy
def compare(batches):
    """Shared shingles of each member with the pivot that precedes it in its star."""
    star = pivot = None
    for batch in batches:
        out = []
        sets = (s for at in range(0, batch.num_rows, SLICE) for s in shingle_sets(raw_column(batch.slice(at, SLICE), "text")))
        for p, salt, member, mine in zip(*(raw_column(batch, c) for c in ("p", "salt", "a")), sets):
            if member is None:
                star, pivot = (p, salt), mine
            elif (p, salt) == star:
                shared = len(pivot) + len(mine) - len(np.union1d(pivot, mine))
                out.append((member, p, shared, len(pivot) + len(mine) - shared))
        if out:
            a, b, shared, union = map(np.array, zip(*out))
            yield as_batch(a=a, b=b, shared=shared, union=union)


def verify(docs, pairs):
    """Links (a, b) of pairs (a, p) with the exact sizes of intersection and union, where 100 * shared >= 75 * union.

    Members go to their pivot in pieces of about `STAR`, so that a pivot with many members is spread and its text is sent
    once per piece. Texts are sent, which are smaller than their shingles.
    """
    pieces = pairs.groupBy("p").agg(F.ceil(F.count("*") / STAR).alias("pieces"))
    cut = pairs.join(pieces, "p").select("a", "p", F.pmod(F.hash("a"), F.col("pieces")).cast("int").alias("salt"))
    wanted = cut.select("a", "p", "salt", F.col("a").alias("doc_id")).union(cut.select(F.lit(None).cast("long"), "p", "salt", F.col("p")).distinct())
    if pairs.count() <= PICKED:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", binary()).where("text is not null")
    rows = texts.join(wanted, "doc_id").select("p", "salt", "a", "text")
    rows = rows.repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("a").asc_nulls_first())
    return rows.mapInArrow(compare, "a long, b long, shared long, union long").where("100 * shared >= 75 * union")


def buckets(docs, allocation):
    """Rows (key, doc_id, pivot) of the keys that two or more rows share; pivot is the smallest of them."""
    known = docs.sparkSession.sparkContext.broadcast(allocation)
    rows = docs.select("doc_id", binary()).mapInArrow(emit(known), "key long, doc_id long").repartition("key")
    ends = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    return rows.join(ends.select("key", "pivot"), "key")


def sized(pairs, classes):
    """Pairs (a, p) of rows as pairs of class representatives whose sizes allow a link."""
    to = classes.select(F.col("doc_id").alias("a"), F.col("class").alias("ca"), F.col("n").alias("na"))
    at = classes.select(F.col("doc_id").alias("p"), F.col("class").alias("cp"), F.col("n").alias("np"))
    pairs = pairs.join(to, "a").join(at, "p").where("ca <> cp and 4 * least(na, np) >= 3 * greatest(na, np)")
    return pairs.select(F.greatest("ca", "cp").alias("a"), F.least("ca", "cp").alias("p")).distinct()


def near(pairs, sketches):
    """Pairs (a, p) of classes whose sketches allow a link: Hamming distance at most (a + b) / 7."""
    x, y = (sketches.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("own").alias(f"own{c}")) for c in "ap")
    width = "least(size(owna), size(ownp))"
    short = [f"if(size(own{c}) = {width}, own{c}, transform(sequence(0, {width} - 1), i -> aggregate("
             f"sequence(0, cast(size(own{c}) / {width} as int) - 1), 0L, (s, k) -> s ^ own{c}[i + k * {width}])))" for c in "ap"]
    bits = F.expr(f"aggregate(zip_with({short[0]}, {short[1]}, (i, j) -> bit_count(i ^ j)), 0, (s, d) -> s + d)")
    return pairs.join(x, "a").join(y, "p").where(F.expr("na + np") >= 7 * bits).select("a", "p")


def groups(batches, names):
    """Runs of rows that are equal in `names` from a stream that is sorted by them; only the last run of a batch is held."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for name in names:
            values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        start = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(start, start[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(start[-1])
    if rest is not None:
        yield rest


def sketches_of(column):
    """{words: (rows, sketches of these rows as unsigned words)}, and all sketches folded to the shortest."""
    words = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().view(np.uint64)  # unsigned, since NumPy counts the bits of absolute values
    ends = np.cumsum(words)
    full = {}
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        full[w] = rows, flat[(ends[rows] - w)[:, None] + np.arange(w)]
    w = min(full)
    least = np.empty((len(words), w), np.uint64)
    for rows, own in full.values():
        least[rows] = folded(own, w)
    return full, least


def folded(own, words):
    """Sketches, one in each row, folded to so many words."""
    return np.bitwise_xor.reduce(own.reshape(len(own), -1, words), axis=1)


def compare_block(rows):
    """Pairs of one block pair of a bucket, in different components, whose sizes and sketches allow a link."""
    kind, n, root, side, minor = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("class", "n", "root", "side", "minor"))
    if len(kind) < 2:
        return []
    full, least = sketches_of(rows.column(rows.schema.get_field_index("own")))
    alone = (side == side[0]).all()
    count, out = len(kind), []
    step = max(1, 100_000 // count)
    for at in range(0, count, step):
        i = np.repeat(np.arange(at, min(at + step, count)), count)
        j = np.tile(np.arange(count), min(at + step, count) - at)
        fits = (j > i) & (root[i] != root[j]) & (minor[i] | minor[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
        if not alone:
            fits &= side[i] != side[j]
        i, j = i[fits], j[fits]
        near = n[i] + n[j] >= 7 * np.bitwise_count(least[i] ^ least[j]).sum(1, dtype=np.int64)
        i, j = i[near], j[near]
        for w, (mine, own) in full.items():
            if w > least.shape[1]:  # both are of a longer sketch, which tells them apart better
                both = np.isin(i, mine) & np.isin(j, mine)
                a, b = np.searchsorted(mine, i[both]), np.searchsorted(mine, j[both])
                far = n[i[both]] + n[j[both]] < 7 * np.bitwise_count(own[a] ^ own[b]).sum(1, dtype=np.int64)
                keep = np.ones(len(i), bool)
                keep[np.flatnonzero(both)[far]] = False
                i, j = i[keep], j[keep]
        out.append((np.maximum(kind[i], kind[j]), np.minimum(kind[i], kind[j])))
    return out


@tidy
def compare_blocks(batches):
    """`compare_block` of every bucket of a task."""
    out, size = [], 0
    for rows in groups(batches, ("key", "i", "j")):
        for pair in compare_block(rows):
            out.append(pair)
            size += len(pair[0])
        if size > 10_000:
            yield as_batch(a=np.concatenate([a for a, _ in out]), p=np.concatenate([p for _, p in out]))
            out, size = [], 0
    if size:
        yield as_batch(a=np.concatenate([a for a, _ in out]), p=np.concatenate([p for _, p in out]))


def across(rows, sketches):
    """Candidate pairs (a, p) between components within large buckets, from rows (key, class, n, root, minor).

    The rows of a bucket are dealt to blocks by hash, and every two blocks meet in a task of their own. Only pairs that
    pass the sketch leave it, so a group of near copies takes time but no room that grows with its square.
    """
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").withColumn("own_block", F.pmod(F.hash("class"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "own_block").alias("i"), F.greatest(b, "own_block").alias("j")))
    rows = rows.select("key", "class", "n", "root", "minor", F.col("own_block").alias("side"), F.explode(meets).alias("m")).select("*", "m.i", "m.j").drop("m")
    rows = rows.join(sketches.select("class", "own"), "class")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(compare_blocks, "a long, p long")


def linked(docs, all_links=False):
    """(one row per input row: doc_id, n_shingles, class_id, component_id; links a, b, shared, union between classes).

    Texts with equal shingle sets are one class, named by its smallest doc_id. Without `all_links` the links are a
    subset that has the same components: first each bucket's rows are compared with its smallest row, then only pairs
    that are still in different components are. With `all_links` every pair of a bucket is compared, so that every link
    between classes is returned. No pair that could change the result is left out in either case.

    Null or empty texts and texts without words have no shingles and no links. Rows with a null doc_id link nothing and
    keep a null component. Rows repeated with their doc_id stay repeated. An empty table gives empty results. Columns
    other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = docs.select("doc_id", binary()).mapInArrow(survey, "band int, doc_id long, n long, sig_a long, sig_b long, own array<long>")
    seen = materialize(seen, "survey")
    rows = seen.where("band = -1")
    band = F.floor((F.length(F.bin("n")) - 1) / 2).cast("int")
    sizes = rows.where("n > 0").groupBy(band.alias("band")).agg(F.count("*"), F.sum("n")).collect()
    costs = seen.where("band >= 0").groupBy("band", "doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= LIMITS[0])
    costs = costs.orderBy(F.desc("n"), "doc_id").limit(COMMON).collect()
    signs = ["n", "sig_a", "sig_b"]
    named = rows.where("n > 0").groupBy(*signs).agg(F.min("doc_id").alias("class"))
    named = materialize(rows.select("doc_id", *signs).join(named, signs, "left").select("doc_id", "n", "class"), "classes")
    classes = named.where("class is not null and doc_id is not null").dropDuplicates(["doc_id"])
    sketches = rows.where("n > 0").withColumn("band", band).withColumnRenamed("doc_id", "class")
    sketches = sketches.join(named.where("doc_id = class").select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])

    members = materialize(buckets(docs, allocate([tuple(c) for c in costs], [tuple(c) for c in sizes])), "buckets")
    stars = members.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("p")).distinct()
    stars = materialize(near(sized(stars, classes), sketches), "stars")
    links = materialize(verify(docs, stars), "links")
    grown = components(links)

    here = members.select("key", "doc_id").join(classes, "doc_id").select("key", "class", "n").distinct()
    here = here.join(grown.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    if all_links:
        mixed = here.withColumn("root", F.col("class")).withColumn("minor", F.lit(True))
    else:  # in each bucket, rows outside the largest component against all rows of other components
        counts = here.groupBy("key", "root").agg(F.count("*").alias("c"))
        major = counts.groupBy("key").agg(F.max_by("root", "c").alias("major"), F.count("*").alias("roots")).where("roots > 1")
        mixed = here.join(major, "key").withColumn("minor", F.col("root") != F.col("major"))
    sizes_of = here.groupBy("key").agg(F.count("*").alias("rows"))
    mixed = materialize(mixed.join(sizes_of, "key").select("key", "class", "n", "root", "minor", "rows"), "mixed")
    small = mixed.where(F.col("rows") <= SMALL)
    one, two = small.where("minor").alias("x"), small.alias("y")
    left = one.join(two, F.expr("x.key = y.key and x.root <> y.root and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)"))
    left = left.select(F.expr("greatest(x.class, y.class)").alias("a"), F.expr("least(x.class, y.class)").alias("p")).distinct()
    large = across(mixed.where(F.col("rows") > SMALL), sketches).distinct()
    left = near(left, sketches).union(large).distinct().join(stars, ["a", "p"], "left_anti")
    left = materialize(left, "left")
    links = links.union(materialize(verify(docs, left), "more"))
    roots = components(links).withColumnRenamed("node", "class")
    out = named.join(roots, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("root", "class", "doc_id").alias("component_id"))
    return out, links


def components_of(docs):
    """Class and component of every row; see `linked`."""
    return linked(docs)[0]


def keep_one(docs):
    """Rows that stand for their component: every document whose doc_id is its component's smallest, all columns kept.

    Of rows repeated with one doc_id one stays. Rows with a null doc_id stay. What goes is less than what stays, so the
    rows to drop are looked up, by broadcast where they are few, and texts are not moved for it.
    """
    found = materialize(components_of(docs).select("doc_id", "component_id"), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(F.broadcast(gone) if gone.count() <= PICKED else gone, "doc_id", "left_anti").select(docs.columns)
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return stay
    return stay.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(stay.where("doc_id is null"))
