"""MinHash near-duplicate detection with HyperMinHash registers.

A document's set is its distinct word k-gram hashes (64 bits). Steps:

1. Signatures. ``PASSES`` hash functions each deal the set to ``BUCKETS`` buckets
   and keep the least value of each; a register stores that value's count of
   leading zeros and its next ``MANTISSA`` bits. Empty buckets copy a bucket
   chosen by a fixed permutation, so equal sets have equal registers. One
   register of each pass makes a band; 32 bands of four miss a pair at a
   similarity of 0.8 with a probability of about 5e-8.
2. Sets below ``SMALL`` elements would leave buckets empty; they are indexed by
   the prefix filter instead (the first n - ceil(t n) + 1 elements of one order for
   all), which misses nothing whatever the order is. Rare elements come first, by a
   table of rough counts of fixed size, so that passages and lines that many
   documents share make no keys. Sets that can pair with them are indexed both ways.
3. Equal sets are one class. Within a key only pairs with the key's hub are
   candidates (no all-pairs lists); a later round takes another hub for keys whose
   members are in several components still. A pair whose members are connected
   already can't change the result.
4. What is left are groups with members near the threshold, where no hub can tell.
   Such a key's full sets meet in one task as long as they fit a block, else in one
   task for each pair of its blocks. There, columns of a member-by-element matrix give
   all intersections at once, and only links that join components come out: rows grow
   with the members, not with their pairs.
5. Hub candidates pass the collision-corrected Jaccard estimate (a wide margin below
   the threshold), then are confirmed on the full sets, which are made again from
   the texts of candidate documents only.

Odd cases: null, empty and wordless texts have an empty set and link with
nothing; fewer words than k make one shingle; repeated rows are one class; rows
with the same doc_id are one document; a null doc_id takes part as a text but is
never kept; a very long text has its whole set, which is compared only with sets of
a size that can reach the threshold; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, SPACE_WORDS, U64, cache, doc_frame, grams, mix, released, slices, stored, trim, words
from .components import components

PASSES, BUCKETS, MANTISSA = 4, 32, 10
SMALL = 64
MARGIN = 0.25  # 7 standard deviations of the estimate over 128 registers
HUB_ROUNDS = 2
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20  # members and bytes of full sets in one block of a key
LONG_BYTES = 256 << 10  # full sets from here on are blocked by size class
HUB_ROWS = 256  # members that one copy of a hub's full set is compared with
DENSE = 32  # an element that more members have is a column of the matrix product
ID_BYTES = 32 << 20  # candidate ids in one broadcast
COUNT_BITS = 20  # the table of rough counts has 2**20 numbers, whatever the input
SHORT_TEXT = 8192  # bytes; longer texts don't count in the table


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    _, _, h, per = words(data, offs, SPACE_WORDS)
    first = np.concatenate([[0], np.cumsum(per)])
    g, at = grams(h, per, k)
    cut = np.searchsorted(at, first)
    out = []
    for r in range(len(per)):
        if per[r] >= k:
            out.append(np.unique(g[cut[r] : cut[r + 1]]))
        elif per[r]:
            own = h[first[r] : first[r + 1]]
            out.append(grams(own, np.array([len(own)]), len(own))[0])
        else:
            out.append(np.zeros(0, U64))
    return out


def _spare() -> np.ndarray:
    c = cache()
    if "spare_buckets" not in c:
        order = mix(np.arange(BUCKETS * BUCKETS, dtype=U64) * MULT + U64(7)).reshape(BUCKETS, BUCKETS)
        c["spare_buckets"] = order.argsort(axis=1)
    return c["spare_buckets"]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PASSES, BUCKETS) uint16 registers; no set may be empty."""
    n = len(sets)
    flat = np.concatenate(sets) if n else np.zeros(0, U64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.empty((n, PASSES, BUCKETS), np.uint16)
    for j in range(PASSES):
        x = mix(flat + U64((j + 1) * int(MULT) & 0xFFFFFFFFFFFFFFFF))
        least = np.full(n * BUCKETS, ~U64(0))
        np.minimum.at(least, owner * BUCKETS + (x >> U64(59)).astype(np.int64), x << U64(5))
        empty = np.ones(n * BUCKETS, bool)
        empty[owner * BUCKETS + (x >> U64(59)).astype(np.int64)] = False
        exponent = np.frexp(least.astype(np.float64))[1]
        # float64 rounds up near powers of two; the shift below puts that right
        zeros = np.clip(64 - exponent, 0, 62)
        zeros += (least << zeros.astype(U64)) >> U64(63) == 0
        zeros = np.minimum(zeros, 62)
        mantissa = (least << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
        r = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
        r, e = r.reshape(n, BUCKETS), empty.reshape(n, BUCKETS)
        for i in np.flatnonzero(e.any(axis=1)):
            full = ~e[i]
            pick = _spare()[np.flatnonzero(e[i])]
            r[i, e[i]] = r[i][pick[np.arange(len(pick)), full[pick].argmax(axis=1)]]
        out[:, j] = r
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    packed = np.zeros((len(reg), BUCKETS), U64)
    for j in range(PASSES):
        packed |= reg[:, j].astype(U64) << U64(16 * j)
    return mix(mix(packed) + np.arange(1, BUCKETS + 1, dtype=U64) * MULT)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, less the registers expected to agree by chance (Yu and Weber 2017)."""
    same = (a == b).mean(axis=1)
    ratio = na / nb
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _places(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - COUNT_BITS)).astype(np.int64)


def rough_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of short texts fall on each of 2**COUNT_BITS places; only repeats inside a task count.

    It only orders elements, so it may be rough but must be the same for all: it is made once and broadcast (4 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << COUNT_BITS, np.int32)
        for b in batches:
            for _, _, data, offs in slices(b.column(0)):
                sets = shingle_sets(data, offs, k)
                np.add.at(own, _places(np.concatenate(sets)), 1)
        at = np.flatnonzero(own > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], ["place", "n"])

    short = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= SHORT_TEXT)
    got = short.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int32)
    out[got.column("place").to_numpy()] = np.minimum(got.column("n").to_numpy(), (1 << 31) - 1)
    return out


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set in the order of (rough count, hash)."""
    keep = len(s) - (percent * len(s) + 99) // 100 + 1
    return s[np.lexsort((s, counts[_places(s)]))[:keep]]


def _describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, set_key (16 bytes, null for an empty set), keys, sig."""
    counts = docs.sparkSession.sparkContext.broadcast(rough_counts(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                sets = shingle_sets(data, offs, k)
                size = np.array([len(s) for s in sets], np.int64)
                large = np.flatnonzero(size >= SMALL)
                reg = registers([sets[r] for r in large])
                bands = band_keys(reg).view(np.int64)
                row_of = dict(zip(large.tolist(), range(len(large)), strict=True))
                keys, sigs, names = [], [], []
                for r, s in enumerate(sets):
                    own = []
                    if len(s) and len(s) * percent < SMALL * 100 + percent:
                        own.append(mix(prefix(s, counts.value, percent) ^ MULT).view(np.int64))
                    if r in row_of:
                        own.append(bands[row_of[r]])
                    keys.append(np.concatenate(own) if own else np.zeros(0, np.int64))
                    sigs.append(reg[row_of[r]].tobytes() if r in row_of else b"")
                    names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), pa.array(sigs, pa.binary())], ["doc_id", "n", "set_key", "keys", "sig"])
        trim()

    return doc_frame(docs).mapInArrow(run, "doc_id long, n long, set_key binary, keys array<long>, sig binary")


def _full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, full) for the documents in ``ids``: sorted 8-byte hashes."""
    text = doc_frame(docs)
    count = ids.count()
    if count * 8 <= ID_BYTES:
        few = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = pa.array(np.isin(b.column(0).fill_null(-1 << 63).to_numpy(), few.value))
                yield from made(iter([b.filter(own)]))
    else:
        text = text.join(ids.withColumnRenamed(ids.columns[0], "doc_id"), "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return made(batches)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(data, offs, k)], pa.binary())], ["id", "full"])

    return text.mapInArrow(run, "id long, full binary")


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, made: list[str]) -> DataFrame:
    """The pairs (a, b) that reach the threshold on full sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                sa, sb = b.column("sig_a").to_pylist(), b.column("sig_b").to_pylist()
                na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
                ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                both = np.array([bool(x) and bool(y) for x, y in zip(sa, sb, strict=True)]) & ok
                if both.any():
                    at_both = np.flatnonzero(both)
                    ra = np.frombuffer(b"".join(sa[i] for i in at_both), np.uint16).reshape(len(at_both), -1)
                    rb = np.frombuffer(b"".join(sb[i] for i in at_both), np.uint16).reshape(len(at_both), -1)
                    ok[at_both] &= estimate(ra, rb, na[both], nb[both]) >= percent / 100 - MARGIN
                yield b.select(["a", "b"]).filter(pa.array(ok))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: the set of ``a`` (null ``b``), then those of the ``b`` to compare it with."""
        hub, now = np.zeros(0, U64), None
        for b in batches:
            mates, ok = b.column("b").to_pylist(), []
            for a, mate, full in zip(b.column("a").to_pylist(), mates, b.column("full"), strict=True):
                own = np.frombuffer(full.as_buffer(), U64)
                if mate is None:
                    hub, now = own.copy(), a
                    ok.append(False)
                    continue
                if now != a:
                    raise ValueError("a member came without its hub")
                x, y = (own, hub) if len(own) <= len(hub) else (hub, own)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                common = int((y[at] == x).sum()) if len(x) else 0
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        trim()

    for side in "ab":
        own = sigs.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(own, side)
    pairs = pairs.mapInArrow(near, "a long, b long")
    pairs = stored(pairs, made)
    # The set of ``a``, often a hub, goes once to each HUB_ROWS of its members, and never with a member's row.
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    members = pairs.join(salts, "a").select("a", salt, "b").join(sets, F.col("b") == F.col("id")).select("a", "salt", "b", "full")
    hubs = salts.join(sets, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "full")
    both = hubs.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.select("a", "b", "full").mapInArrow(same, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    made: list[str] = []  # folders that the result doesn't read
    held: list[str] = []  # those of labels; it reads the last
    found = stored(_describe(docs, k, percent), made)
    least = found.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = stored(found.select("doc_id", "n", "set_key").join(least, "set_key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    reps = least.where(F.col("rep").isNotNull()).select(F.col("rep").alias("id"), "set_key")
    classes = found.join(reps, (found.doc_id == reps.id) & (found.set_key == reps.set_key)).select("id", "n", "keys", "sig").dropDuplicates(["id", "n"])
    keyed = classes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1").select("key", "hub")
    # What shares a key with another class: the only rows that later steps read.
    rows = stored(keyed.join(stored(shared, made), "key").select("key", "id", "hub"), made)
    ids = stored(rows.select("id").distinct(), made)
    labels = ids.select("id", F.col("id").alias("label"))
    edges = tried = None
    if not ids.isEmpty():
        sigs = stored(found.join(ids, found.doc_id == ids.id).select("id", "n", "sig").dropDuplicates(["id"]), made)
        sets = stored(_full_sets(docs, ids, k), made)
        for step in range(HUB_ROUNDS + 1):
            if step == 0:
                now = rows.select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a <> b")
            else:
                labelled = rows.select("key", "id").join(labels, "id")
                split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(step))).alias("hub")).where("lo <> hi")
                split = stored(split.select("key", "lo", "hub.*").toDF("key", "lo", "hub", "hub_label"), made)
                if split.isEmpty():
                    break
                if step == HUB_ROUNDS:
                    more = stored(_linked_in_groups(labelled.join(split.select("key"), "key"), sets, percent), made)
                    if not more.isEmpty():
                        edges = more if edges is None else edges.union(more)
                        labels = stored(ids.join(components(edges, made), "id", "left").select("id", F.coalesce("label", "id").alias("label")), held)
                    break
                now = labelled.join(split, "key").where("label <> hub_label").select(F.col("id").alias("a"), F.col("hub").alias("b"))
            now = now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            now = stored(now.join(tried, ["a", "b"], "left_anti") if tried is not None else now, made)
            tried = now if tried is None else tried.union(now)
            if now.isEmpty():
                continue
            more = stored(_confirmed(now, sigs, sets, percent, made), made)
            if more.isEmpty():
                continue
            edges = more if edges is None else edges.union(more)
            labels = stored(ids.join(components(edges, made), "id", "left").select("id", F.coalesce("label", "id").alias("label")), held)
    if edges is None:
        labels = docs.sparkSession.createDataFrame([], "id long, label long")
    for path in made + held[:-1]:
        released(docs.sparkSession, path)
    out = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: rare elements by their few pairs, frequent ones by a product of 0/1 columns."""
    g = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    owner, first = owner[order], np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0])) if len(flat) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(flat)))
    out = np.zeros((g, g), np.float32)
    wide = np.flatnonzero(many > DENSE)
    for k in range(0, len(wide), 1024):
        part = wide[k : k + 1024]
        x = np.zeros((g, len(part)), np.float32)
        x[owner[np.repeat(first[part] - np.concatenate([[0], np.cumsum(many[part])[:-1]]), many[part]) + np.arange(many[part].sum())], np.repeat(np.arange(len(part)), many[part])] = 1
        out += x @ x.T
    for c in range(2, DENSE + 1):
        at = first[many == c]
        for k in range(0, len(at), 16384 // c):
            own = owner[at[k : k + 16384 // c, None] + np.arange(c)]
            code = (own[:, :, None] * g + own[:, None, :]).ravel()
            where, n = np.unique(code, return_counts=True)
            out.reshape(-1)[where] += n
    return out


def joining(label: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``near`` members that connect different labels, at most one a member and round."""
    label, out = np.unique(label, return_inverse=True)[1].astype(np.int64), []
    g = len(label)
    while True:
        to = np.where(near & (label[:, None] > label[None, :]), label[None, :], g).argmin(axis=1)
        rows = np.flatnonzero(near[np.arange(g), to] & (label > label[to]))
        if not len(rows):
            return out
        # One link for each label that has a smaller neighbour; the label then takes the neighbour's.
        _, pick = np.unique(label[rows], return_index=True)
        jump = np.arange(g)
        for i in rows[pick].tolist():
            out.append((i, int(to[i])))
            jump[label[i]] = label[to[i]]
        while (jump[jump] != jump).any():
            jump = jump[jump]
        label = jump[label]


def _linked_in_groups(rows: DataFrame, sets: DataFrame, percent: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (key, id, label): links (a, b) between members of one key with different labels, enough to join all that are near."""
    full = rows.join(sets.withColumnsRenamed({"id": "_id"}), F.col("id") == F.col("_id")).select("key", "id", "label", "full")
    # Long sets go by size: a class and the next one below it hold all that can be near (a little more than the ratio guards the rounding).
    size, long = F.octet_length("full"), F.lit(LONG_BYTES)
    step = F.floor(F.log(size / long) / float(np.log(101 / percent))).cast("int") + 1
    short = F.when(size * 101 >= long * percent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    full = full.withColumn("_class", F.explode(F.when(size < long, short).otherwise(F.array(step, step + 1))))
    full = full.withColumn("key", F.struct("key", "_class")).drop("_class")
    size = full.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("full")) / block_bytes)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = full.join(size, "key").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "id", "label", "full")

    def link(group: pa.Table) -> pa.Table:
        made = [np.frombuffer(x.as_buffer(), U64) for x in group.column("full")]
        n = np.array([len(x) for x in made])
        both = common(made)
        near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        ids = group.column("id").to_numpy()
        found = joining(group.column("label").to_numpy(), near)
        del both, near
        trim()
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(link, "a long, b long")


def first_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document of least doc_id of each component, with all columns; rows without an id stay."""
    keep = near_duplicates(docs, k, percent).where("kept").select("doc_id").distinct().toDF("kept_id")
    out = docs.where(docs["doc_id"].isNotNull()).join(keep, docs["doc_id"] == keep["kept_id"], "left_semi")
    return out.dropDuplicates(["doc_id"]).unionByName(docs.where(docs["doc_id"].isNull()))
