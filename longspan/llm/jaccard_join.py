"""Exact set-similarity join of texts on word shingles, by universe partition.

Two sets of Jaccard similarity t or more differ in few elements: at most D = floor((1 - t) / (1 + t) * (|x| + |y|)).
Sizes fall into bands, each with a bound D of its own. In a band all elements are hashed to segments; D + 1 + extra
units of tolerance are allocated to them: a segment with one unit agrees if it is equal, one with two units (and twice
the width) if it differs by at most one element. By the pigeonhole principle a similar pair agrees in 1 + extra units.
Equal segments meet by their hash; two-unit segments also publish the hash without each of their elements, so segments
that are one deletion apart meet. A segment of which nothing is left would meet all others of its kind; as a similar
pair that meets nowhere else does so in several such segments, they are published only as subsets of that many. Each
band takes the allocation (units by one or by two, extra) of least cost, counted from its number of sets: hashes
published plus chance meetings expected. A set publishes in its own band and in those above that partners may lie in.

Equal sets are one node. A bucket's head is the set that meets most others; the rest of the bucket is verified against
it, exactly. Components of these links are contracted; what is left, pairs of a set outside its head's component with
sets of other components in the bucket, is verified pair by pair. So a group of near copies costs about one pair a copy,
and no link is lost. Before whole sets are compared, sketches bound the difference from below: folds in the join itself,
of large sets then full sketches in Arrow batches, so pairs that can't be similar are never written. Sets are compared
as 64-bit hashes of their shingles.

Defined results: null and empty texts have no shingles and are linked with nothing; texts shorter than a shingle are
one shingle; rows that repeat, and rows of one id with different texts, are each returned, linked by their texts; null
ids are returned and never name a component that has another id; an empty table stays empty; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspan.llm.common import broadcast_if_small, lean, sliced, table, text_key, written

RATIO = 1.5
#: Cost of a chance meeting of two sets (a comparison of sketches, about a microsecond) against that of a published hash (about 8, and
#: 45 bytes of disk, which are the scarcer).
MEETING_COST = 0.02
#: Segments in a subset at most; allocations of larger ones are not tried.
LARGEST_SUBSET = 6
#: Ids up to which candidates' texts are found by a broadcast; beyond, by a shuffle.
BROADCAST_ROWS = 500_000
GOLD = 0x9E3779B97F4A7C15
#: Bits of a folded sketch, and of the largest one, which tells unlike sets of up to some 36,000 shingles apart at 80 %; larger ones are verified whole.
SKETCH = 1024
LARGEST_SKETCH = 1 << 14
WORDS = [f"fold{k}_" for k in range(SKETCH // 64)]
#: Words of the fold by which large sets (over 2,048 shingles) are compared in the join too: 64 of them tell unlike sets of up to some 8,000 apart.
MIDDLE = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct width-word shingles, A-Z lower-cased; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        out = mixed(out * np.uint64(GOLD) + h[k : k + n])
    return np.unique(out)


def node_of(key: bytes, shared: frozenset[int] = frozenset()) -> int:
    """64 bits that name a set; for those that several sets of the corpus share, others of its key."""
    for lo in (0, 8):
        node = int.from_bytes(key[lo : lo + 8], "little", signed=True)
        if node not in shared:
            break
    return node


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of elements in each of SKETCH parts of the universe, or of a power of two times as many for larger sets, to LARGEST_SKETCH.

    Two sets differ in at least as many elements as their sketches in bits. A sketch folds in half by exclusive or.
    """
    bits = SKETCH
    while bits < min(len(hashes), LARGEST_SKETCH):
        bits *= 2
    parts = np.bincount((mixed(hashes ^ np.uint64(GOLD)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parts.astype(np.uint8)).view(np.int64)


def folded(full: np.ndarray) -> np.ndarray:
    """A sketch folded to SKETCH bits; the sketch itself follows if it is larger."""
    fold = np.bitwise_xor.reduce(full.reshape(-1, SKETCH // 64), axis=0)
    return fold if len(full) == len(fold) else np.concatenate([fold, full])


def middle(full: Column) -> Column:
    """A full sketch folded to MIDDLE words; null if it has fewer, or is null."""
    out = F.when(F.size(full) == MIDDLE, full)
    words = LARGEST_SKETCH // 64
    while words > MIDDLE:  # a sketch of 2^k times as many words is folded k times
        folds, size = full, words
        while size > MIDDLE:
            size //= 2
            folds = F.zip_with(F.slice(folds, 1, size), F.slice(folds, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        out, words = out.when(F.size(full) == words, folds), words // 2
    return out


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@dataclass
class Band:
    """Sizes from low to high, whose similar pairs differ in at most tolerance elements, and the segments of the universe for them.

    A set publishes low-information hashes (of segments of which nothing is left) only as subsets of ``subset`` segments.
    """

    low: int
    high: int
    tolerance: int
    extra: int = 0
    single: int = 0
    double: int = 0

    @property
    def subset(self) -> int:
        return self.extra // 2 + 1 if self.double else self.extra + 1


def _used(band: Band, size: int, percent: int) -> tuple[int, int]:
    """Segments in which a set publishes: those of two units, and all. With partners of the band it differs in at most so many elements."""
    differ = (100 - percent) * (size + min(band.high, size * 100 // percent)) // (100 + percent)
    doubles = min(band.double, (differ + 2 + band.extra) // 2)
    return doubles, doubles + max(0, differ + 1 + band.extra - 2 * band.double)


def _cost(band: Band, sets: int, percent: int) -> float:
    """Hashes that a set publishes and, times MEETING_COST, its chance meetings with others of its size; the mean of three sizes."""
    parts, ways, cost = band.single + band.double, math.factorial(band.subset), 0.0
    for size in (-(-band.low * percent // 100), (band.low + band.high) // 2, band.high):
        doubles, used = _used(band, size, percent)
        width = size / parts
        nothing = math.exp(-width) * (1 + width if band.double else 1)  # is left of a segment, after one deletion
        cost += used + doubles * width + (used * nothing) ** band.subset / ways
        cost += MEETING_COST * sets * min(1.0, (used * nothing**2) ** band.subset / ways)
    return cost / 3


class Bands:
    """Size bands and their allocation for similarity of at least percent / 100."""

    def __init__(self, percent: int, counts: dict[int, int]):
        self.percent = percent
        self.bands: list[Band] = []
        low = 1
        while low < 1 << 31:
            high = max(low, int(low * RATIO))
            tolerance = (100 - percent) * 2 * high // (100 + percent)
            sets = sum(c for n, c in counts.items() if low * percent // 100 <= n <= high)
            forms = [Band(low, high, tolerance, extra, tolerance + 1 + extra) for extra in range(LARGEST_SUBSET)]
            forms += [Band(low, high, tolerance, extra, (tolerance + 1 + extra) % 2, (tolerance + 1 + extra) // 2) for extra in range(2 * LARGEST_SUBSET)]
            self.bands.append(min(forms, key=lambda x: _cost(x, sets, percent)))
            low = high + 1

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size publishes; none if only equal sets can be similar there."""
        most = size * 100 // self.percent
        return [k for k, b in enumerate(self.bands) if b.low <= most and b.high >= size and b.tolerance]

    def signatures(self, hashes: np.ndarray, k: int) -> np.ndarray:
        band = self.bands[k]
        units = band.single + 2 * band.double
        doubles, used = _used(band, len(hashes), self.percent)
        h = mixed(hashes + np.uint64(k + 1))
        unit = (h % np.uint64(units)).astype(np.int64)
        segment = np.where(unit < 2 * band.double, unit // 2, unit - band.double)  # those of two units come first
        order = np.argsort(segment, kind="stable")
        part, values = segment[order], mixed(h[order] ^ np.uint64(GOLD))
        total = np.zeros(band.single + band.double, np.uint64)
        if len(part):
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total[part[begin]] = np.add.reduceat(values, begin)
        many = np.bincount(part, minlength=len(total))[:used]
        name = lambda s, seg: mixed(s ^ mixed(np.uint64(k << 32) + seg.astype(np.uint64)))
        full = np.flatnonzero(many)
        out = [name(total[full], full)]
        if doubles:
            some = (part < doubles) & (many[np.minimum(part, used - 1)] > 1)
            out.append(name(total[part[some]] - values[some], part[some]))
        nothing = np.flatnonzero(np.where(np.arange(used) < doubles, many <= 1, many == 0))
        if len(nothing) >= band.subset:
            joint = np.full(1, k + 1, np.uint64)
            for some in zip(*combinations(nothing.tolist(), band.subset)):
                joint = mixed(joint * np.uint64(GOLD) + np.array(some, np.uint64))
            out.append(joint)
        return np.concatenate(out).view(np.int64)


PARTS = "doc_id long, n_shingles long, set_key binary, sketch array<long>, text_key binary, node long, sig long"


def _parts(width: int, bands: Bands, shared: frozenset[int]):
    """A row per document (its id, size, set_key, sketch, text_key and node) and one per signature (node and sig)."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def table(about: list[list], node: np.ndarray, sig: np.ndarray | None) -> pa.RecordBatch:
        n = len(node)
        cells = [pa.array(c, t) for c, t in zip(about, types)] if sig is None else [pa.nulls(n, t) for t in types]
        return pa.RecordBatch.from_arrays([*cells, pa.array(node), pa.nulls(n, pa.int64()) if sig is None else pa.array(sig)], [x.split()[0] for x in PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sizes, keys, sketches, names = [], [], [], []
            held: list[np.ndarray] = []
            owner: list[np.ndarray] = []
            size = 0
            for t in b.column(1).to_pylist():
                x = shingles(t, width)
                keys.append(set_key(x))
                sizes.append(len(x))
                sketches.append(folded(sketch(x)))
                names.append(node_of(keys[-1], shared))
                for k in bands.of(len(x)) if len(x) else []:
                    held.append(bands.signatures(x, k))
                    owner.append(np.full(len(held[-1]), names[-1]))
                    size += len(held[-1])
                if size > 250_000:
                    yield table([], np.concatenate(owner), np.concatenate(held))
                    held, owner, size = [], [], 0
            if size:
                yield table([], np.concatenate(owner), np.concatenate(held))
            yield table([b.column(0).to_pylist(), sizes, keys, sketches, b.column(2).to_pylist()], np.array(names, np.int64), None)

    return run


def _sets(width: int, shared: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                sets = [shingles(t, width) for t in b.column(0).slice(lo, 64).to_pylist()]
                node = [node_of(set_key(x), shared) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    return run


def _near(percent: int):
    """Of rows a, b, both sizes and two full sketches (null: none) those that may be similar; sketches have LARGEST_SKETCH bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            both, sizes, starts, words = b.column(2).to_numpy(), [], [], []
            for c in (b.column(3), b.column(4)):
                sizes.append(np.diff(c.offsets.to_numpy()) * ~c.is_null().to_numpy(zero_copy_only=False))
                starts.append(c.offsets.to_numpy()[:-1])
                words.append(c.values.to_numpy())
            keep = np.ones(b.num_rows, bool)
            for n, m in {*zip(*(x.tolist() for x in sizes))}:
                if not n or not m:
                    continue
                rows, k = np.flatnonzero((sizes[0] == n) & (sizes[1] == m)), min(n, m)
                x, y = (np.bitwise_xor.reduce(w[s[rows, None] + np.arange(z)].reshape(len(rows), -1, k), axis=1) for w, s, z in zip(words, starts, (n, m)))
                apart = np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)
                keep[rows] = apart * (100 + percent) <= both[rows] * (100 - percent)
            yield b.select([0, 1]).filter(pa.array(keep))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b): the graph is contracted onto each node's smallest neighbour until no edge is left."""
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not edges.isEmpty():
        down = written(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        left = edges.join(down, "a").select(F.col("m").alias("x"), F.col("b").alias("a"))
        edges = written(left.join(down, "a").select("x", F.col("m").alias("y")).where("x != y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b")))
        labels = written(labels.join(down, labels["root"] == down["a"], "left").select("node", F.coalesce("m", "root").alias("root")))
    return labels


class Join:
    """The similarity join of docs (doc_id, text) at percent / 100 on width-word shingles."""

    def __init__(self, docs: DataFrame, percent: int, width: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), text_key(F.col("text")).alias("text_key"))
        self.percent, self.width = percent, width
        # The allocation needs only the order of magnitude of sizes, so lengths stand for them: six bytes a shingle.
        size = F.floor(F.log2(F.octet_length(F.coalesce("text", F.lit(""))) / F.lit(6.0) + 1) * 2).cast("int")
        counts = {int(2 ** (r["s"] / 2)): r["count"] for r in self.docs.groupBy(size.alias("s")).count().collect()}  # a row per half octave
        self.bands = Bands(percent, counts)
        self.shared: frozenset[int] = frozenset()
        while True:  # again only if different sets share a node, a chance of n^2 / 2^65 with n sets
            parts = written(self.docs.mapInArrow(lean(_parts(width, self.bands, self.shared)), PARTS))
            self.rows = parts.where("sig is null").select("doc_id", "n_shingles", "set_key", "node", "sketch", "text_key")
            self.published = parts.where("sig is not null").select("sig", "node")
            several = self.rows.groupBy("node").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x != y")
            found = frozenset(r["node"] for r in several.select("node").collect())
            if not found - self.shared:
                break
            self.shared |= found

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, hashes of nodes, each once, from the text of its first row."""
        order = ("nameless", "doc_id", "text_key", "n")
        rows = self.rows.join(nodes, "node", "left_semi").groupBy("node", F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
        firsts = written(rows.groupBy("node").agg(F.min(F.struct(*order)).alias("row")).select(F.col("row.doc_id").alias("first_id"), F.col("row.text_key").alias("first_key"), "row.n"))
        total, repeated = firsts.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()

        def texts(some: DataFrame) -> DataFrame:
            some = broadcast_if_small(some, total, BROADCAST_ROWS)
            return self.docs.join(some, self.docs["doc_id"].eqNullSafe(some["first_id"]) & (self.docs["text_key"] == some["first_key"]), "left_semi")

        named = texts(firsts.where("n = 1") if repeated else firsts)
        if repeated:
            named = named.unionByName(texts(firsts.where("n > 1")).dropDuplicates(["text_key"]))
        return written(named.select("text").mapInArrow(lean(_sets(self.width, self.shared)), "node long, hashes array<long>"))

    def possible(self, a: str, b: str) -> Column:
        """Sizes and folded sketches of a and b (suffixes) that a similar pair may have.

        The words of a fold are columns of their own, which keeps this small enough to run compiled. Sets whose folds are too
        full to tell them apart are compared by their middle folds as well.
        """
        least, most, both = F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}"), F.col(f"n{a}") + F.col(f"n{b}")
        apart = reduce(add, (F.bit_count(F.col(w + a).bitwiseXOR(F.col(w + b))) for w in WORDS))
        further = F.aggregate(F.zip_with(f"middle{a}", f"middle{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), add)
        few = lambda bits: bits * (100 + self.percent) <= both * (100 - self.percent)
        return (least * 100 >= most * self.percent) & few(apart) & (F.col(f"middle{a}").isNull() | F.col(f"middle{b}").isNull() | few(further))

    def near(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """a, b of pairs (node, n and full of suffixes 1 and 2) that a and b name, without those whose full sketches differ too much."""
        cells = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n1") + F.col("n2")).alias("both"), "full1", "full2")
        return cells.mapInArrow(lean(_near(self.percent)), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs that are similar, by their whole sets."""
        pairs = written(pairs.distinct())
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        good = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s")).where(F.col("c") * 100 >= (F.col("s") - F.col("c")) * self.percent)
        return written(good.select("a", "b").distinct())

    def edges(self) -> DataFrame:
        """a, b: links between nodes whose components are those of all links."""
        # A bucket's members: the rows of signatures on which different sets meet, by one shuffle. Its head is the set that meets most others.
        bucket = Window.partitionBy("sig")
        met = self.published.withColumns({"lo": F.min("node").over(bucket), "hi": F.max("node").over(bucket)}).where("lo != hi")
        members = written(met.select("sig", "node").distinct())
        sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
        fame = members.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("fame"))
        info = written(self.rows.join(fame, "node").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("fame").alias("fame")))
        full = F.when(F.size("sketch") > len(WORDS), F.slice("sketch", len(WORDS) + 1, F.size("sketch") - len(WORDS)))
        info = info.select("node", "n", "fame", full.alias("full"), middle(full).alias("middle"), *(F.get("sketch", k).alias(w) for k, w in enumerate(WORDS)))
        heads = members.join(info.select("node", "fame"), "node").groupBy("sig").agg(F.max_by("node", F.struct("fame", "node")).alias("head"))
        placed = written(members.join(heads, "sig"))
        star = placed.where("node != head").select("head", "node").distinct()
        one, two = (info.select(*(F.col(c).alias(f"{c}{k}") for c in ("node", "n", "full", "middle", *WORDS))) for k in (1, 2))
        spokes = star.join(one, F.col("head") == F.col("node1")).join(two, F.col("node") == F.col("node2")).where(self.possible("1", "2"))
        linked = self.verified(self.near(spokes, "node1", "node2"))
        # What is left: pairs of a set that isn't in its head's component with the bucket's sets in other components.
        roots = components(linked)
        rooted = placed.join(roots, "node", "left").join(roots.select(F.col("node").alias("head"), F.col("root").alias("head_root")), "head", "left")
        rooted = rooted.select("sig", "node", "head", F.coalesce("root", "node").alias("root"), F.coalesce("head_root", "head").alias("head_root"))
        apart = rooted.where("root != head_root").select("sig").distinct()
        rest = written(rooted.join(apart, "sig", "left_semi").where("node != head").join(info.drop("fame", "full"), "node"))
        one, two = (rest.select("sig", *(F.col(c).alias(f"{c}{k}") for c in ("node", "root", "head_root", "n", "middle", *WORDS))) for k in (1, 2))
        once = (F.col("root2") == F.col("head_root2")) | (F.col("node1") < F.col("node2"))
        pairs = one.where("root1 != head_root1").join(two, (one["sig"] == two["sig"]) & (F.col("root1") != F.col("root2")) & once & self.possible("1", "2"))
        pairs = pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
        for node, k in (("a", 1), ("b", 2)):  # full sketches only now, of the pairs that are left
            pairs = pairs.join(info.select(F.col("node").alias(node), F.col("n").alias(f"n{k}"), F.col("full").alias(f"full{k}")), node)
        more = self.verified(self.near(pairs, "a", "b"))
        return linked.unionByName(more)

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        roots = components(self.edges())
        placed = self.rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        by_node = placed.join(smallest, "root").select("node", "component_id")
        return self.rows.join(by_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def copies(self) -> DataFrame:
        """doc_id, text_key of the rows whose component has an earlier one: by doc_id, null last, then by text_key."""
        roots = components(self.edges())
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
        rows = self.rows.where("n_shingles > 0").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), order.alias("row"))
        rows = written(rows.distinct())
        firsts = rows.groupBy("root").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
        return rows.join(firsts, "root").where(~F.col("row").eqNullSafe(F.col("first"))).select("row.doc_id", "row.text_key")


def similar_classes(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    return Join(docs, percent, width).classes()


def later_copies(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    return Join(docs, percent, width).copies()


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), percent=90, width=3)


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE_SQL = {
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON r.a = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.a = s.doc_id) AS component_id FROM s"""
}
