"""N-gram Jaccard join: components of documents whose shingle sets are similar, found exactly.

Sets are dealt into bands by size, so that similar ones are in the same band or the next. For each band b there is an
instance with the sets of b and b - 1, in which similar sets differ in at most H shingles. Hashing partitions the
universe of shingles into m segments, which cuts each set into m subsets; which keys a set gives to the index is
allocated by cost for each instance:
  exact: m > H segments. A set gives each of its subsets that isn't empty; its H + 1 largest are its probes. Of a
    similar pair, one of the probes must be equal in both, and a match counts if either side probes. A set with fewer
    than H + 1 subsets that aren't empty gives the empty ones too.
  one deletion: m > H / 2 segments. A set gives each subset (the probes) and each subset without one of its shingles,
    so subsets that differ in one shingle meet: of a similar pair, one of m subsets differs in one at most.
Small sets, whose subsets would be few shingles and meet by chance, take the second way; others the first.

Keys travel as packed arrays dealt by key; what meets another set's key becomes a row (key, set). Sets that share a
key aren't paired with each other. First each set is verified against one set only: of the least probing sets of its
keys, the one it shares most keys with. Verified links are made components. Keys whose sets are then in several
components are gone through again, in blocks of bounded size: two sets of different components are compared by their
parity sketches (each shingle flips one bit, so sketches never differ in more bits than the sets in shingles). In the
first rounds a set goes to a few of its keys only, those of least hash, which sets that share many have in common, and
there to one block, another at each key: it offers so many partners at most, whatever the size of its group. Then for a
few rounds each set offers its nearest partner of each key and block; the last round offers every pair that the sketches
leave open. No pair that could join two components is left out. Keys whose sets are in one component stay so, and are
dropped for good.
Equal sets are one set from the start, so a group of copies is one row to all of this."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U64, byte_table, cleaned, distinct_sets, dropped, mix, saved, shingle_hashes, slices, text_buffer, tidy, word_hashes
from .components import components

#: Cost model: the share of its shingles that a document has in common with another by chance, and how many index
#: entries one verification is worth.
COMMON, VERIFY = 0.01, 20.0
#: Spare segments of the exact way, as a share of H + 1.
SPARE = 0.3
#: Index entries that travel together, and sets of one key that meet in one block.
BATCH_ENTRIES, BLOCK_SETS = 200_000, 512
#: Shingles of distinct sets whose index entries one part of the index is meant to hold.
PART_SHINGLES = 500_000
#: Bits of a sketch at most: long sets meet by chance so seldom that they need no closer bound.
SKETCH_BITS = 4_096
#: Sets of a group up to which all its pairs are made at once with those of other groups.
SMALL_GROUP = 24
#: Rows of groups that are gone through at once.
HELD_ROWS = 8_000
#: Rounds in which a set goes to so many keys only, at most, and rounds of nearest partners after them.
FIRST_ROUNDS, FIRST_KEYS = 2, 4
ROUNDS = 3
#: Pairs that are verified at once, and shares that they are cut to at most while their names fit a broadcast.
PAIRS_AT_ONCE, SHARES = 250_000, 8
#: A round that finds less than one link for so many known ones is the last of them.
FEW = 50


def bands(similarity: Fraction, most: int) -> np.ndarray:
    """Least size of each band: sets of sizes from l to l / similarity are one band."""
    out = [1]
    while out[-1] <= most:
        out.append(math.floor(out[-1] / similarity) + 1)
    return np.array(out, np.int64)


def allocation(low: np.ndarray, similarity: Fraction, documents: int) -> list[tuple[int, int, bool]]:
    """(H, m, one deletion) of each band's instance, by least expected cost."""
    out = []
    for b in range(len(low) - 1):
        u = int(low[b + 1]) - 1
        h = math.floor((1 - similarity) / (1 + similarity) * 2 * u)
        exact = h + 1 + math.ceil(SPARE * (h + 1)) if h else 1
        single = h // 2 + 1
        cost_exact = exact + VERIFY * documents * (h + 1) * COMMON ** min(u / exact, 100)
        cost_single = single + u + VERIFY * documents * single * (1 + u / single) * COMMON ** min(u / single - 1, 100)
        out.append((h, single, True) if h and cost_single < cost_exact else (h, exact, False))
    return out


def document_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*shingle_hashes(*word_hashes(raw, at, byte_table()), k))


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by group, modulo 2^64 (halves are exact in doubles up to 2^21 values a group)."""
    low = np.bincount(group, (values & U64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (values >> U64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << U64(32))


def set_names(h: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names. 0 only for the empty set."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    salt = U64(mix(np.array([seed + 1], np.uint64))[0])
    name = mix(_sums(mix(h ^ salt), doc, n) + np.diff(at).astype(np.uint64))
    return np.where(np.diff(at) > 0, np.maximum(name, U64(1)), U64(0))


def index_keys(h: np.ndarray, at: np.ndarray, low: np.ndarray, plan: list[tuple[int, int, bool]], similarity: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set's place, probe) of all sets in both of their instances."""
    n, sizes = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n), sizes)
    band = np.searchsorted(low, sizes, "right") - 1
    limits = np.array([p[0] for p in plan] + [0], np.int64)
    segments = np.array([p[1] for p in plan] + [1], np.int64)
    single = np.array([p[2] for p in plan] + [False])
    own_limit = sizes * (1 - similarity).numerator * similarity.denominator // ((1 - similarity).denominator * similarity.numerator)
    keys, places, probes = [], [], []
    for step in (0, 1):
        inst = np.minimum(band + step, len(plan) - 1)
        use = (sizes > 0) & (band + step < len(plan)) & (limits[inst] > 0) & (own_limit > 0)
        m = np.where(use, segments[inst], 0)
        off = np.concatenate([[0], np.cumsum(m)])
        salt = mix(inst.astype(np.uint64) + U64(0x51))
        mine = use[doc]
        hs, ds = h[mine], doc[mine]
        turned = mix(hs ^ salt[ds])
        seg = ((turned >> U64(32)) * m[ds].astype(np.uint64) >> U64(32)).astype(np.int64)
        cell = off[ds] + seg
        total = int(off[-1])
        sums, counts = _sums(turned, cell, total), np.bincount(cell, minlength=total)
        owner = np.repeat(np.arange(n), m)
        inner = np.arange(total) - off[owner]
        tag = mix(salt[owner] + inner.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        need = np.minimum(limits[inst], own_limit) + 1
        order = np.lexsort((inner, -counts, owner))
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total) - off[owner[order]]
        one = single[inst][owner]
        filled = np.bincount(owner, counts > 0, n)
        short = (filled < need)[owner]
        give = one | (counts > 0) | short
        keys.append(mix(sums[give] + tag[give]))
        places.append(owner[give])
        probes.append(one[give] | (rank[give] < need[owner[give]]))
        cut = one[cell]
        keys.append(mix(sums[cell[cut]] - turned[cut] + tag[cell[cut]]))
        places.append(ds[cut])
        probes.append(np.zeros(int(cut.sum()), bool))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(probes)


def _packed(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, place: np.ndarray, probe: np.ndarray, parts: int):
    """Rows of packed entries: to each part its keys. Of a key that several sets here share, the first set travels with
    the key, marked as shared; the others are known to share it and go to any part, as they are."""
    order = np.lexsort((~probe, place, keys))
    keys, place, probe = keys[order], place[order], probe[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
    keys, place, probe = keys[fresh], place[fresh], probe[fresh]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    shared = np.zeros(len(keys), bool)
    shared[:-1] = ~first[1:]
    shared &= first
    part = np.where(first, (keys >> U64(40)) % U64(parts), mix(names[place]) % U64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[bounds[p] : bounds[p + 1]]
        if len(own):
            used, local = np.unique(place[own], return_inverse=True)
            flags = probe[own].astype(np.uint8) | (shared[own].astype(np.uint8) << 1) | ((~first[own]).astype(np.uint8) << 2)
            yield p, keys[own].tobytes(), local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), flags.tobytes(), names[used].tobytes(), sizes[used].astype(np.uint32).tobytes()


_PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("place", pa.binary()), ("flags", pa.binary()), ("names", pa.binary()), ("sizes", pa.binary())])
_ROW = "part int, keys binary, place binary, flags binary, names binary, sizes binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name, size, probe) of the keys of one part that two sets or more have."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for r in batch.to_pylist():
            names = np.frombuffer(r["names"], np.uint64)
            local = np.frombuffer(r["place"], np.uint16 if len(names) <= 1 << 16 else np.uint32)
            cols[0].append(np.frombuffer(r["keys"], np.uint64))
            cols[1].append(names[local])
            cols[2].append(np.frombuffer(r["sizes"], np.uint32)[local])
            cols[3].append(np.frombuffer(r["flags"], np.uint8))
    if not cols[0]:
        return
    key, name, size, flag = (np.concatenate(c) for c in cols)
    loose = flag & 4 != 0
    order = np.lexsort((name, key))
    key, name, size, flag, loose = key[order], name[order], size[order], flag[order], loose[order]
    tied = np.flatnonzero(~loose)
    k = key[tied]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    keep = loose.copy()
    if len(start):
        group = np.cumsum(new) - 1
        several = np.minimum.reduceat(name[tied], start) != np.maximum.reduceat(name[tied], start)
        several |= np.maximum.reduceat(flag[tied] & 2, start) > 0
        keep[tied] = several[group]
    at = np.flatnonzero(keep)
    for low in range(0, len(at), 200_000):
        i = at[low : low + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[i].view(np.int64)), pa.array(name[i].view(np.int64)), pa.array(size[i].astype(np.int32)), pa.array(flag[i] & 1 == 1)], ["key", "name", "size", "probe"])


def named_sets(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, name and check (a second name) of every row; docs has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = document_sets(*text_buffer(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(set_names(h, at, seed).view(np.int64)), pa.array(set_names(h, at, seed + 1000).view(np.int64))], ["doc_id", "n_shingles", "name", "check"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, name long, check long")


def members(docs: DataFrame, k: int, similarity: Fraction, seed: int, documents: int, most: int, parts: int) -> DataFrame:
    """key, name, size, probe: the sets of every key that two sets or more share."""
    low = bands(similarity, most)
    plan = allocation(low, similarity, documents)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *(len(x[3]) for x in held)])
            key, place, probe, names, sizes = (np.concatenate([x[i] + base[j] if i == 1 else x[i] for j, x in enumerate(held)]) for i in range(5))
            held.clear()
            rows = list(_packed(key, names, sizes, place, probe, parts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                h, at = document_sets(*text_buffer(part.column(0)), k)
                names = set_names(h, at, seed)
                sizes = np.diff(at)
                _, one = np.unique(names, return_index=True)  # copies of a set give its keys once
                one = np.sort(one[names[one] != 0])
                chosen = np.zeros(len(names), bool)
                chosen[one] = True
                h = h[np.repeat(chosen, sizes)]
                held.append((*index_keys(h, np.concatenate([[0], np.cumsum(sizes[one])]), low, plan, similarity), names[one], sizes[one]))
                if sum(len(x[0]) for x in held) >= BATCH_ENTRIES:
                    yield from packed()
        if held:
            yield from packed()

    packed = docs.select("text").mapInArrow(tidy(emit), _ROW)
    return packed.repartitionById(parts, F.col("part")).mapInArrow(tidy(_gathered), "key long, name long, size int, probe boolean")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough, counted exactly. Pairs are gone through by shares, of which
    each deals only its own sets and frees what it dealt before the next."""
    p, q = similarity.numerator, similarity.denominator
    pairs = saved(pairs)
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    n = pairs.count()
    shares = max(1, -(-n // max(1, min(BROADCAST_IDS // 2, max(PAIRS_AT_ONCE, -(-n // SHARES))))))
    found = []
    for share in range(shares):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(shares)) == share) if shares > 1 else pairs
        names = some.select(F.col("a").alias("name")).union(some.select("b")).distinct()
        own = sets.join(F.broadcast(names), "name", "left_semi")
        a, b = own.select(F.col("name").alias("a"), F.col("h").alias("ha")), own.select(F.col("name").alias("b"), F.col("h").alias("hb"))
        rows = some.join(a, "a").join(b, "b")
        found.append(saved(rows.where(both * q >= (F.size("ha") + F.size("hb") - both) * p).select(F.col("a").alias("u"), F.col("b").alias("v"))))
        cleaned(pairs.sparkSession)
    dropped(pairs.sparkSession, pairs)
    return saved(_union(found)) if shares > 1 else found[0]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: Fraction = Fraction(4, 5), seed: int = 0) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links reach) of every row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its distinct k-word
    shingles (of fewer words one, of all). Two documents link when the intersection is at least `similarity` of the
    union. Null, empty and wordless texts have no set and link with nothing: component_id is their own id. Rows that
    repeat an id or a text are linked like others and returned one by one; a null id counts for no least id, and a
    component of null ids alone has a null component_id. Shingles are compared as 64-bit hashes; equal names of sets
    that differ are noticed by a second name, and the names are then drawn anew."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    while True:
        named = saved(named_sets(rows, k, seed))
        classes = saved(named.where("name <> 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2")))
        if classes.where("c1 <> c2").isEmpty():
            break
        seed += 1
    documents, most, total = classes.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    if not documents:
        return named.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SHINGLES))
    shared = saved(members(rows, k, similarity, seed, documents, most, parts))
    linked = _links(rows, shared, classes, k, similarity, seed)
    labels = components(linked)
    root = classes.join(labels.select(F.col("u").alias("name"), F.col("v").alias("root")), "name", "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component"))
    final = root.join(least, "root").select("name", "component")
    out = named.join(final, "name", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("name") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _links(rows: DataFrame, shared: DataFrame, classes: DataFrame, k: int, similarity: Fraction, seed: int) -> DataFrame:
    """Verified links (u, v) of set names, enough of them to join every component."""
    p, q = similarity.numerator, similarity.denominator
    near = (F.col("size") * q >= F.col("size2") * p) & (F.col("size2") * q >= F.col("size") * p)
    sets = _set_table(rows, shared.select("name").distinct(), classes, k, seed)
    pivots = shared.where("probe").groupBy("key").agg(F.min(F.struct("name", "size")).alias("m")).select("key", F.col("m.name").alias("name2"), F.col("m.size").alias("size2"))
    first = shared.join(pivots, "key").where(F.col("name") != F.col("name2")).where(near).groupBy("name", "name2").agg(F.count("*").alias("n"))
    first = first.groupBy("name").agg(F.max(F.struct("n", "name2")).alias("m")).select(F.least("name", "m.name2").alias("a"), F.greatest("name", "m.name2").alias("b")).distinct()
    links = _similar(first, sets, similarity)
    n = links.count()
    for few in (True, False):
        for turn in range(FIRST_ROUNDS if few else ROUNDS):
            shared = _open_keys(shared, links)
            new = _similar(_open_pairs(shared, sets, similarity, nearest_only=True, turn=turn if few else None), sets, similarity)
            links, found = links.union(new), new.count()
            if found * FEW <= n:
                break
            n += found
    shared = _open_keys(shared, links)
    links = links.union(_similar(_open_pairs(shared, sets, similarity, nearest_only=False), sets, similarity))
    for done in (shared, sets):
        dropped(rows.sparkSession, done)
    return links


def _open_keys(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of those keys whose sets are in several components, with label (the component) and blocks (of the key). They
    take the place of `shared`, whose files go, and the shuffle files of finding them are free before the next step."""
    labels = components(links)
    rest = shared.select("key", "name", "size", "probe").join(labels.select(F.col("u").alias("name"), F.col("v").alias("label")), "name", "left").withColumn("label", F.coalesce("label", "name"))
    several = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), F.max(F.col("probe").cast("int")).alias("p"))
    several = several.where("x <> y AND p = 1").select("key", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("blocks"))
    met = saved(rest.join(several, "key"))
    dropped(shared.sparkSession, shared)
    cleaned(shared.sparkSession)
    return met


def _open_pairs(met: DataFrame, sets: DataFrame, similarity: Fraction, nearest_only: bool, turn: int | None = None) -> DataFrame:
    """Pairs (a, b) of one key and different components that may be links; or of each set in a block only its nearest.
    With a turn each set goes to FIRST_KEYS keys at most and to one block of each, others at each turn."""
    if turn is None:
        met = met.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    else:
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("key", F.lit(turn)), "key"))
        met = met.withColumn("place", place).where(F.col("place") <= FIRST_KEYS)
        met = met.withColumn("own", F.pmod(F.xxhash64("name", "key"), F.col("blocks")).cast("int")).withColumn("bi", F.col("own")).withColumn("bj", F.col("own"))
    met = met.join(sets.select("name", "sketch"), "name").select("key", "bi", "bj", "own", "name", "size", "label", "probe", "sketch")
    met = met.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return met.mapInArrow(tidy(_close(similarity, nearest_only)), "a long, b long").distinct()


def sketch_bits(size: int) -> int:
    """Bits of the parity sketch of a set of this size: a power of two, at least 2.5 times the size."""
    return max(64, 1 << math.ceil(math.log2(max(1, 2.5 * size))))


def sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles of each cell. A sketch of 2n bits folds to that of n bits: its halves' exclusive or."""
    bits = min(sketch_bits(len(h)), SKETCH_BITS)
    return np.packbits(np.bincount((mix(h) % U64(bits)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def folded(bits: list[bytes], rows: np.ndarray, width: int) -> np.ndarray:
    """The sketches of these rows (all of one length, or longer than width) at `width` bytes, as 64-bit words."""
    out = np.zeros((len(rows), width), np.uint8)
    wide: dict[int, list[int]] = {}
    for at, r in enumerate(rows.tolist()):
        wide.setdefault(len(bits[r]), []).append(at)
    for length, own in wide.items():
        s = np.frombuffer(b"".join([bits[r] for r in rows[own].tolist()]), np.uint8).reshape(len(own), length)
        while s.shape[1] > width:
            s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
        out[own] = s
    return out.view(np.uint64)


def _close(similarity: Fraction, nearest_only: bool):
    ratio = (1 - similarity) / (1 + similarity)

    def among(start: np.ndarray, stop: np.ndarray, name: np.ndarray, size: np.ndarray, label: np.ndarray, probe: np.ndarray, bits: list[bytes]):
        """Open pairs of all these small groups: made at once, each compared once however many keys the two share."""
        reach = np.repeat(stop, stop - start)
        at = np.concatenate([np.arange(a, b) for a, b in zip(start, stop, strict=True)]) if len(start) else np.zeros(0, np.int64)
        lefts, rights = [], []
        step = 1
        while len(at):
            some = at + step < reach
            at, reach = at[some], reach[some]
            j = at + step
            most = (size[j] + size[at]) * ratio.numerator // ratio.denominator
            ok = (label[j] != label[at]) & (probe[j] | probe[at]) & (np.abs(size[j] - size[at]) <= most)
            lefts.append(at[ok])
            rights.append(j[ok])
            step += 1
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
        low, high = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
        order = np.lexsort((high, low))
        i, j, low, high = i[order], j[order], low[order], high[order]
        fresh = np.ones(len(i), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        i, j, low, high = i[fresh], j[fresh], low[fresh], high[fresh]
        width = np.array([len(b) for b in bits])
        apart = np.zeros(len(i), np.int64)
        for w in np.unique(width):  # powers of two up to SKETCH_BITS
            for v in np.unique(width[width >= w]):
                own = np.flatnonzero((np.minimum(width[i], width[j]) == w) & (np.maximum(width[i], width[j]) == v))
                for cut in range(0, len(own), 20_000):
                    o = own[cut : cut + 20_000]
                    apart[o] = np.bitwise_count(folded(bits, i[o], w) ^ folded(bits, j[o], w)).sum(axis=1)
        ok = apart <= (size[i] + size[j]) * ratio.numerator // ratio.denominator
        low, high, apart = low[ok], high[ok], apart[ok]
        if nearest_only and len(low):
            best = np.zeros(len(low), bool)
            for end in (low, high):
                order = np.lexsort((apart, end))
                best[order[np.r_[True, end[order][1:] != end[order][:-1]]]] = True
            low, high = low[best], high[best]
        return low, high

    def group(own: np.ndarray, name: np.ndarray, size: np.ndarray, label: np.ndarray, probe: np.ndarray, bits: list[bytes], bi: int, bj: int):
        """Open pairs of one block of a large group."""
        rows = folded(bits, np.arange(len(bits)), min(map(len, bits)))
        left, right = (np.flatnonzero(own == bi), np.flatnonzero(own == bj))
        for i in left:
            j = right[right > i] if bi == bj else right
            j = j[(label[j] != label[i]) & (probe[j] | probe[i])]
            if len(j):
                most = (size[j] + size[i]) * ratio.numerator // ratio.denominator
                j = j[np.abs(size[j] - size[i]) <= most]
                most = (size[j] + size[i]) * ratio.numerator // ratio.denominator
                apart = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1)
                j = j[apart <= most]
                if nearest_only and len(j):
                    j = j[[apart[apart <= most].argmin()]] if len(j) > 1 else j
                yield np.full(len(j), name[i]), name[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows < HELD_ROWS:
                    continue
            if held is None or not held.num_rows:
                continue
            key, bi, bj, own, name, size, label = (held.column(i).to_numpy() for i in range(7))
            probe, bits = held.column(7).to_numpy(), held.column(8).to_pylist()
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            stop = np.append(start[1:], len(key))
            if batch is not None:  # the last group may go on
                start, stop = start[:-1], stop[:-1]
            size = size.astype(np.int64)
            small = (stop - start <= SMALL_GROUP) & (bi[start] == bj[start])
            found: list[tuple[np.ndarray, np.ndarray]] = [among(start[small], stop[small], name, size, label, probe, bits)]
            for a, b in zip(start[~small].tolist(), stop[~small].tolist(), strict=True):
                found += group(own[a:b], name[a:b], size[a:b], label[a:b], probe[a:b], bits[a:b], int(bi[a]), int(bj[a]))
            held = held.slice(int(stop[-1])) if len(stop) else held
            if found:
                x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                x, y = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                fresh = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(x[fresh]), pa.array(y[fresh])], ["a", "b"])

    return run


def _set_table(rows: DataFrame, names: DataFrame, classes: DataFrame, k: int, seed: int) -> DataFrame:
    """name, distinct shingle hashes (h) and sketch of the sets named, from one document of each. Texts stay where they
    are: ids that don't fit a broadcast are met by several, each with its pass over the texts. Documents with a null id
    are all looked at."""
    wanted = saved(names.join(classes, "name").select(F.col("least").alias("id__")))
    passes = max(1, -(-wanted.count() // BROADCAST_IDS))
    parts = [rows.join(F.broadcast(wanted.where(F.pmod(F.xxhash64("id__"), F.lit(passes)) == i)), rows["doc_id"] == F.col("id__"), "left_semi") for i in range(passes)]
    picked = _union([*parts, rows.where("doc_id IS NULL")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = document_sets(*text_buffer(part.column(0)), k)
                name = set_names(h, at, seed)
                _, one = np.unique(name, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(name[one].view(np.int64)), pa.array([h[at[i] : at[i + 1]].view(np.int64) for i in one], pa.list_(pa.int64())), pa.array([sketch(h[at[i] : at[i + 1]]) for i in one], pa.binary())], ["name", "h", "sketch"])

    sets = saved(picked.select("text").mapInArrow(tidy(run), "name long, h array<long>, sketch binary"))
    again = sets.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():  # no id is repeated, so each wanted set came once: nothing is dealt
        return sets
    one = saved(sets.join(names, "name", "left_semi").dropDuplicates(["name"]))
    dropped(sets.sparkSession, sets)
    return one
