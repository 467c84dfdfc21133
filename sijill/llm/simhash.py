"""SimHash near-dedup with BK-trees.

Every text gets a 64-bit fingerprint: a bit is 1 where over half of its shingles' XXH64 hashes have it set. Fingerprints
link when they differ in ``radius`` bits or fewer; documents connected by links form a component.

The distinct fingerprints are dealt to shards so that any two that link share one: of ``radius`` + 1 blocks of bits one is
equal, and of the remaining bits, cut likewise, one block again (two levels keep shards small where one block is common).
Each shard is a BK-tree: children keyed by their integer Hamming distance to the parent, and a search follows only the edges
within the radius. A tree is bounded by its shard, and the shard's queries are sent to it rather than the trees to every
executor, since trees of all fingerprints have no size bound. A shard gives one link for each fingerprint at most (to the
root of its group in the shard), so copies are never expanded into pairs. Shards over ``LARGE`` fingerprints are dealt anew
by a third level of blocks; neither ``LARGE`` nor ``PART`` changes what is found. Components come from large-star and small-star
rounds over the links.

``keep_one`` deduplicates near copies proper: texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or
more. Wide fingerprints of ``WIDE`` bits, whose Hamming distance estimates it, are searched within a radius that such texts
hardly ever exceed; the whole sets of shingle hashes of the texts that this finds are then made and compared exactly. No blocks
of bits could shard so wide a radius; there a shard is an anchor, one of the text's ``ANCHORS`` least shingle hashes, of which two
such texts share one almost surely. A shard over ``PART`` fingerprints is cut into parts, and every two parts meet in a group of
their own: one part makes the tree, the other sends the queries. A pair that shares several anchors counts in the least alone.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; repeated rows give a row each; a null id takes part but cannot name a component (null if all are);
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Sieve, arrow_schema, map_rows, read_table, write_table

SHINGLE, RADIUS, SEED = 3, 2, 42
LARGE = 2000
#: Rounds after which an unfinished star contraction is an error; each at least halves the longest path.
MOST_ROUNDS = 60


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned; 0 for a text without words. bytes.lower() and bytes.split() know ASCII only, as the contract asks."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in parts]), dtype=np.uint8)
    n = len(raw) // 8
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 255):
        votes += np.unpackbits(raw[8 * k : 8 * (k + 255)]).reshape(-1, 64).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def make():
        return lambda ids, texts: [ids, [signed(fingerprint(t, shingle)) for t in texts]]

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fp long")


def masks(radius: int, levels: int) -> list[int]:
    """Bit masks of which any two fingerprints within the radius agree on at least one."""

    def cut(bits: list[int]) -> list[list[int]]:
        n = radius + 1
        return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]

    out = [([], list(range(64)))]
    for _ in range(levels):
        out = [(own + b, [x for x in rest if x not in set(b)]) for own, rest in out for b in cut(rest)]
    return [sum(1 << b for b in own) for own, _ in out]


class BKTree:
    """Nodes are indices into parallel lists; children[i] maps a distance to the child at that distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        i, new = 0, len(self.values) - 1
        while new:
            d = (self.values[i] ^ value).bit_count()
            child = self.children[i].get(d)
            if child is None:
                self.children[i][d] = new
                return
            i = child

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within the radius, by following the edges d - radius .. d + radius only."""
        out, todo = [], [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= radius:
                out.append(i)
            kids = self.children[i]
            if len(kids) <= 2 * radius + 1:
                todo += [c for e, c in kids.items() if -radius <= e - d <= radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return out


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, least fingerprint of its group in the shard) for those that aren't their group's least."""
    up = list(range(len(values)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tree = BKTree()
    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[r]) for i, v in enumerate(values) if (r := top(i)) != i]


def _shards(x: DataFrame, which: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: the shard's key is the mask's number and the masked bits."""
    keys = F.array(*(F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(v)).cast("long")).alias("bits")) for k, v in enumerate(which)))
    return x.select("fp", F.explode(keys).alias("key")).select("key.m", "key.bits", "fp")


def _link_shards(shards: DataFrame, radius: int) -> DataFrame:
    """Streams shards, sorted by key and fingerprint, and links each."""
    mask64 = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m0, bits0, held = None, None, []

        def emit(groups: list[list[int]]):
            got = [p for g in groups for p in shard_links([v & mask64 for v in g], radius)]
            return pa.RecordBatch.from_arrays([pa.array([signed(p[k]) for p in got], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m, bits, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[m[0] != m0 or bits[0] != bits0], (m[1:] != m[:-1]) | (bits[1:] != bits[:-1])]))
            ends = np.concatenate([starts, [len(m)]])
            groups = []
            held += fp[: ends[0]].tolist()
            if len(starts):
                if len(held) > 1:
                    groups.append(held)
                sizes = np.diff(ends)
                groups += [fp[a : a + n].tolist() for a, n in zip(starts[:-1][sizes[:-1] > 1], sizes[:-1][sizes[:-1] > 1], strict=True)]
                held = fp[starts[-1] :].tolist()
            m0, bits0 = m[-1], bits[-1]
            if groups:
                yield emit(groups)
        if len(held) > 1:
            yield emit([held])

    return shards.mapInArrow(run, "u long, v long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links between distinct fingerprints (column fp) that keep the components of all pairs within the radius."""
    two, three = masks(radius, 2), masks(radius, 3)
    sized = write_table(_shards(classes, two).groupBy("m", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1), "shards")
    shards = _shards(classes, two).join(sized, ["m", "bits"])
    small = shards.where(F.col("n") <= LARGE).select("m", "bits", "fp")
    out = _link_shards(small.repartition("m", "bits").sortWithinPartitions("m", "bits", "fp"), radius)
    if sized.where(F.col("n") > LARGE).limit(1).count():
        deeper = shards.where(F.col("n") > LARGE).select("fp").distinct()
        out = out.unionByName(_link_shards(_shards(deeper, three).repartition("m", "bits").sortWithinPartitions("m", "bits", "fp"), radius))
    return write_table(out.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's least node, for the nodes of edges (u > v as unsigned or not: any two distinct longs)."""
    e = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(x: DataFrame):
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = state(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_table(large.where("u <> v").distinct(), "large")
        least = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        e = write_table(small.where("u <> v").distinct(), "small")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of each row."""
    prints = write_table(fingerprints(docs, shingle), "prints")
    classes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, radius))
    rooted = write_table(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = write_table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    joined = write_table(rooted.join(named, "root").select("fp", "component_id"), "member")
    return prints.join(joined, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


WIDE, WIDE_SHINGLE, ANCHORS, PART = 1024, 5, 4, 256
#: Bits that fingerprints of similarity 0.8 differ in on average (0.151 of WIDE), and four standard errors more.
WIDE_RADIUS = 200
#: Columns of the product that counts what sets share, and elements of sets, at once.
COLUMNS, HASHES = 4096, 250_000


def shingle_hashes(text: str | None) -> np.ndarray:
    """The hashes of the set of shingles, in order."""
    w, n = (text or "").encode().lower().split(), WIDE_SHINGLE
    parts = ([b" ".join(w)] if w else []) if len(w) < n else map(b" ".join, zip(*(w[k:] for k in range(n)), strict=False))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in parts]), dtype=">u8").astype(np.uint64))


def set_node(h: np.ndarray) -> int:
    """A set's name: signed."""
    return signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint of a set of shingle hashes, and its anchors (signed). Each hash is spread to WIDE bits by a mixing function."""
    if not len(h):
        return bytes(WIDE // 8), [0]
    votes = np.zeros(WIDE, dtype=np.int64)
    lanes = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(h), 255):
        z = h[k : k + 255, None] + lanes
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        votes += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(h)).tobytes(), [signed(int(x)) for x in h[:ANCHORS]]


Member = tuple[int, int, list[int]]  # node, fingerprint, anchors


def candidates(tree: list[Member], queries: list[Member] | None, anchor: int, radius: int) -> set[int]:
    """Nodes of the tree's members and the queries that have one within the radius, in pairs whose least common anchor this is.

    Without queries the tree's members are looked up as the tree grows.
    """
    grown, found = BKTree(), set()
    for _, v, _ in tree if queries is not None else ():
        grown.add(v)
    for node, v, anchors in tree if queries is None else queries:
        for i in grown.within(v, radius):
            other, _, its = tree[i]
            if not (node in found and other in found) and anchor == min(x for x in anchors if x in its):
                found |= {node, other}
        if queries is None:
            grown.add(v)
    return found


def similar(xs: list[bytes], ys: list[bytes] | None = None) -> np.ndarray:
    """Whether the similarity of each of xs with each of ys (of xs), sets of hashes, is 0.8 or more: exact at any size."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in (*xs, *(ys or ()))]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = times[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    at = 0 if ys is None else len(xs)
    shared = np.zeros((len(xs), len(sets) - at), dtype=np.int64)
    for k in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, width - k)), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - k] = 1
        shared += (m[: len(xs)] @ m[at:].T).astype(np.int64)
    return 9 * shared >= 4 * (sizes[: len(xs), None] + sizes[None, at:])


def similar_links(xs: list[tuple[int, bytes]], ys: list[tuple[int, bytes]] | None = None) -> list[tuple[int, int]]:
    """Links (node, node) that connect what the pairs of similar ones of xs and ys (of xs) connect; members are (node, set)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out, others = [], xs if ys is None else ys
    left, right = _blocks(xs), _blocks(others)
    for p, (a0, a1) in enumerate(left):
        for b0, b1 in right[p if ys is None else 0 :]:
            one = ys is None and a0 == b0
            for k, i in np.argwhere(similar([x for _, x in xs[a0:a1]], None if one else [y for _, y in others[b0:b1]])).tolist():
                a, b = top(xs[a0 + k][0]), top(others[b0 + i][0])
                if a != b:
                    up[a] = b
                    out.append((xs[a0 + k][0], others[b0 + i][0]))
    return out


def _blocks(members: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Runs of members whose sets have about HASHES elements together, one member at least."""
    out, start, size = [], 0, 0
    for k, (_, x) in enumerate(members):
        if k > start and size + len(x) // 8 > HASHES:
            out.append((start, k))
            start, size = k, 0
        size += len(x) // 8
    return [*out, (start, len(members))] if members else []


def _each_meeting(dealt: DataFrame, f: Callable[[tuple, list[tuple], list[tuple] | None], list[tuple]], schema: str) -> DataFrame:
    """f over the shard parts that meet: (anchor, i, j) and the rest of the rows of part i and part j (none if they are one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), arrow_schema(schema)

        def emit():
            got = f(key, sides[0], None if key[1] == key[2] else sides[1])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], type=t) for k, t in enumerate(out.types)], schema=out)

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for anchor, i, j, part, *rest in zip(*(c.to_pylist() for c in batch.slice(k, SLICE).columns), strict=True):
                    if key != (anchor, i, j):
                        if key and len(sides[0]) + len(sides[1]) > 1:
                            yield emit()
                        key, sides = (anchor, i, j), ([], [])
                    sides[0 if part == i else 1].append(tuple(rest))
        if key and len(sides[0]) + len(sides[1]) > 1:
            yield emit()

    return dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(run, schema)


def _found(dealt: DataFrame, radius: int) -> DataFrame:
    """The rows of dealt (anchor, i, j, part, node, fp, anchors) that the search finds, without fingerprints."""

    def search(key, xs, ys):
        xs, ys = ([(n, int.from_bytes(v, "big"), a) for n, v, a in side] if side is not None else None for side in (xs, ys))
        got = candidates(xs, ys, key[0], radius)
        return [(*key, part, n) for part, side in zip(key[1:], (xs, ys or []), strict=True) for n, _, _ in side if n in got]

    return _each_meeting(dealt, search, "anchor long, i int, j int, part int, node long")


def similar_groups(docs: DataFrame, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and root (the group) of each row of docs: texts of similarity 0.8 or more share a root."""

    def make():
        def f(ids, hashes, texts):
            sets = [shingle_hashes(t) for t in texts]
            got = [wide_fingerprint(h) for h in sets]
            return [ids, hashes, [set_node(h) for h in sets], [g[0] for g in got], [g[1] for g in got]]

        return f

    def make_sets():
        def f(texts):
            sets = [shingle_hashes(t) for t in texts]
            return [[set_node(h) for h in sets], [h.tobytes() for h in sets]]

        return f

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    prints = write_table(map_rows(x, make, "doc_id long, text_hash long, node long, fp binary, anchors array<long>"), "wide")
    classes = write_table(prints.groupBy("node").agg(F.min(F.struct("fp", "anchors", "text_hash")).alias("c")).select("node", "c.*"), "classes")
    shards = classes.select(F.explode("anchors").alias("anchor"), "node", "fp", "anchors")
    sized = write_table(shards.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = shards.join(sized, "anchor").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), parts).cast("int"))
    met = own.select("anchor", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"), "part", "node", "fp", "anchors")
    found = write_table(_found(met.select("anchor", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "fp", "anchors"), radius), "found")
    texts = write_table(classes.join(found.select("node").distinct(), "node", "left_semi").select("text_hash"), "found-texts")
    told = Sieve(texts, "text_hash").marked(x.select("text_hash", "text"), "text_hash", "_found").where("_found")
    sets = map_rows(told.join(texts, "text_hash", "left_semi").select("text"), make_sets, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    dealt = found.join(sets, "node").select("anchor", "i", "j", "part", "node", "hashes")
    links = _each_meeting(dealt, lambda _, xs, ys: similar_links(xs, ys), "u long, v long")
    found = components(write_table(links.distinct(), "links"))
    root = write_table(classes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "rooted")
    return prints.select("doc_id", "text_hash", "node").join(root, "node").select("doc_id", "text_hash", "root")


def keep_one(docs: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """docs with one row of each group of near copies: the one of the least doc_id (null first), then of the least text hash.

    The rows that go are joined to docs, as they are the fewer; rows that are equal in id and text count as one.
    """
    groups = write_table(similar_groups(docs, radius), "groups")
    keepers = write_table(groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("root", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")), "keepers")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    gone = write_table(groups.join(keepers, "root").where(~same).select("doc_id", "text_hash").distinct().select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "gone")
    again = write_table(groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "again")
    x = docs.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_h"), F.col("doc_id").cast("long").alias("_d")).withColumn("_k", F.xxhash64("_d", "_h"))
    x = Sieve(gone.unionByName(again.select("_id", "_hash")).select(F.xxhash64("_id", "_hash").alias("_k")), "_k").marked(x, "_k", "_touched")
    named = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    out = x.where("not _touched").select("_row")
    left = x.where("_touched").join(gone, named, "left_anti")
    if not again.limit(1).count():
        return out.unionByName(left.select("_row")).select("_row.*")
    once = left.join(again, named, "left_anti").select("_row")
    more = left.join(again, named, "left_semi").groupBy("_d", "_h").agg(F.first("_row").alias("_row")).select("_row")
    return out.unionByName(once).unionByName(more).select("_row.*")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
