"""SimHash fingerprints, and links between near ones by pivot distance tables.

Fingerprints are computed in Arrow batches.  Equal fingerprints are one point from then on, so groups of copies never meet as
pairs.  Points are dealt out by pigeonhole: of `parts` bit ranges, two points that differ in at most `radius` bits agree in
`parts - radius`, so they meet under at least one choice of these.  Inside such a bucket the pivot tables do the work: every point has
its Hamming distances to the reference fingerprints; a pair whose coordinates differ by more than the radius anywhere cannot be
near (triangle inequality) and is discarded; only survivors are compared bit by bit.  A table of pivots alone would have to
look at every pair of points, as the coordinates of unlike texts crowd around 32; the buckets keep the work near-linear and lose no link.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import connected_components
from .shared import exists, map_array, pack, remove, resolve, tidy, unpack, workspace, write_array

#: Reference fingerprints.
PIVOTS = np.random.Generator(np.random.PCG64(64)).integers(0, 2**64, size=24, dtype=np.uint64)
#: Points of a bucket that one task compares; a larger bucket is dealt out as pairs of blocks.
BLOCK = 8192
#: Points from which on a bucket's points are first compared with a few of them, and how many these are.
HUB, HUBS = 256, 4


def fingerprint_words(w: tv.Words, shingle: int, seed: int = 42, salts: tuple[np.uint64, ...] = (np.uint64(0),)) -> np.ndarray:
    """A fingerprint per salt (row) and text (column): bit set where over half of the shingles' XXH64, mixed with the salt if there is one, have it."""
    at, each = w.runs(shingle)
    count = np.diff(w.doc)
    first, last = w.start[at], w.start[np.minimum(at + shingle, w.n)] - 1
    short = np.flatnonzero((count > 0) & (count < shingle))
    out = np.zeros((len(salts), len(count)), np.uint64)
    if len(at):
        h = tv.xxh64(w.text, first, last - first, seed)
        out = majority(h, each, salts)
    if len(short):
        a = w.start[w.doc[short]]
        h = tv.xxh64(w.text, a, w.start[w.doc[short + 1]] - 1 - a, seed)
        for k, salt in enumerate(salts):
            out[k, short] = salted(h, salt)
    return out


def salted(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    return tv.mix(h ^ salt) if salt else h


def majority(h: np.ndarray, each: np.ndarray, salts: tuple[np.uint64, ...]) -> np.ndarray:
    """For each salt (row) and text (column; each[i] of the hashes are its own): the bits that over half of its salted hashes have."""
    out = np.zeros((len(salts), len(each)), np.uint64)
    full = np.flatnonzero(each)
    edges = np.concatenate(([0], np.cumsum(each[full])))
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for lo, hi in tv.blocks(edges, 1 << 17):
        own = h[edges[lo] : edges[hi]]
        for k, salt in enumerate(salts):
            bits = np.unpackbits(salted(own, salt).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, edges[lo:hi] - edges[lo], axis=0, dtype=np.int32)
            out[k, full[lo:hi]] = ((ones * 2 > each[full[lo:hi], None]) * weight).sum(1, dtype=np.uint64)
    return out


def shingle_sets(w: tv.Words, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles' XXH64, ascending, one text after another, and their number in each text; fewer words than a shingle are one."""
    at, each = w.runs(shingle)
    count = np.diff(w.doc)
    short = np.flatnonzero((count > 0) & (count < shingle))
    doc = np.concatenate((np.repeat(np.arange(len(each)), each), short))
    first = np.concatenate((w.start[at], w.start[w.doc[short]]))
    last = np.concatenate((w.start[np.minimum(at + shingle, w.n)], w.start[w.doc[short + 1]])) - 1
    h = tv.xxh64(w.text, first, last - first, seed)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(each))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long): fp is the fingerprint's bits as a signed number.  Null or wordless text: 0."""

    @tidy
    def run(batches):
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, w in tv.words_of(batch.column(1), tv.LOWER):
                fps[lo:hi] = fingerprint_words(w, shingle)[0]
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


def merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Joins the sets of each pair; label[i] is the smallest member of i's set."""
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        left, right = left[open_], right[open_]
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def near_sets(points: np.ndarray, group: np.ndarray, radius: int, pivots: np.ndarray = PIVOTS[:, None], most: int = 1 << 17, confirm: Callable | None = None) -> np.ndarray:
    """For points (rows of 64-bit words) in buckets (equal group, ascending), the smallest index each is linked to through links inside its bucket.

    confirm: which of the pairs (two arrays of indices) that are within the radius are links (default: all).  Pairs whose points are linked already are not asked for.
    """
    lanes = points.shape[1]
    count = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)
    table = np.stack([count(points, p) for p in pivots], 1)
    key = group.astype(np.int64) * (64 * lanes + radius + 1) + table[:, 0]
    order = np.argsort(key, kind="stable")
    key, coords, point, group = key[order], table[order], points[order], group[order]
    label = np.arange(len(key))

    def settle(left: np.ndarray, right: np.ndarray, step: int) -> None:
        """Joins the sets of the pairs that are near."""
        nonlocal label
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        for p in range(len(pivots)):
            if not len(left):
                return
            keep = np.abs(coords[left, p] - coords[right, p]) <= radius
            left, right = left[keep], right[keep]
        keep = count(point[left], point[right]) <= radius
        left, right = left[keep], right[keep]
        if confirm is None:
            label = merge(label, left, right)
            return
        while len(left):
            sure = confirm(order[left[:step]], order[right[:step]])
            label = merge(label, left[:step][sure], right[:step][sure])
            left, right = left[step:], right[step:]
            apart = label[left] != label[right]
            left, right, step = left[apart], right[apart], min(2 * step, 4096)

    # In a large bucket most points are often near one: what a few of them gather need not be compared with each other.
    inside = np.zeros(len(key), bool)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < HUB:
            continue
        left_out = np.arange(a, b)
        for _ in range(HUBS):
            hub = left_out[len(left_out) // 2]
            settle(np.full(b - a, hub), np.arange(a, b), 4096)
            top = np.bincount(label[a:b] - label[a:b].min()).argmax() + label[a:b].min()
            left_out = np.flatnonzero(label[a:b] != top) + a
            if not len(left_out):
                break
        if b - a > 2 * len(left_out):
            inside[a:b] = label[a:b] == top
    own = np.flatnonzero(~inside)
    upto = np.searchsorted(key, key[own] + radius, side="right")
    # What is gathered is met from the other side only.
    since = np.where(np.concatenate(([0], np.cumsum(inside)))[own] > 0, np.searchsorted(key, key[own] - radius), own)
    total = np.concatenate(([0], np.cumsum(upto - since)))
    for lo, hi in tv.blocks(total, most):
        each = upto[lo:hi] - since[lo:hi]
        left = np.repeat(own[lo:hi], each)
        right = np.arange(total[lo], total[hi]) - np.repeat(total[lo:hi] - since[lo:hi], each)
        once = (right > left) | inside[right]
        settle(left[once], right[once], 64)
    out = np.empty(len(key), np.int64)
    out[order] = order[label]
    return out


def _scheme(points: int, radius: int) -> list[int]:
    """Masks of the bit choices: the number of ranges that makes rows and expected comparisons cheapest for so many points."""

    def cost(parts: int) -> float:
        keys = len(list(combinations(range(parts), radius)))
        return keys * (40.0 * points + points * (points / 2 ** (64 * (parts - radius) / parts)))

    parts = min(range(radius + 1, radius + 5), key=cost)
    edges = [64 * i // parts for i in range(parts + 1)]
    ranges = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(parts)]
    return [sum(ranges[i] for i in range(parts) if i not in left_out) for left_out in combinations(range(parts), radius)]


def _compare(keyed: DataFrame, names: list[str], radius: int, pivots: np.ndarray, points_of: Callable[..., np.ndarray], confirm: Callable | None = None, large: DataFrame | None = None) -> DataFrame:
    """keyed: key long, and what a point carries (long; the first names it), each key and point once.  (a, b): the first columns of linked points of a bucket.

    points_of: the points' fingerprints, from the carried columns.  confirm: gives, for these columns, near_sets' confirm.  large: the keys (key, held long: their points)
    of over BLOCK points, if they are known beforehand.

    A bucket of over BLOCK points is dealt out as pairs of blocks, so no task holds more than two blocks of one bucket.  Each task
    returns at most one row a point: the link to one of its set.
    """
    if large is None:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
        dealt = keyed.join(sizes, "key")
    else:
        dealt = keyed.join(large, "key", "left").withColumn("held", F.coalesce("held", F.lit(1)))
    dealt = dealt.withColumn("parts", F.ceil(F.col("held") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).select("key", *names, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"), "own")
    dealt = dealt.select("key", *names, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    groups = ("key", "i", "j")

    @tidy
    def run(batches):
        held: pa.Table | None = None

        def solve(t: pa.Table):
            new = np.ones(t.num_rows, bool)
            for i, c in enumerate(t.column(c).to_numpy() for c in groups):
                new[1:] = (c[1:] != c[:-1]) | (new[1:] if i else False)
            # A point alone in its bucket has nothing to be compared with.
            some = np.flatnonzero(~(new & np.append(new[1:], True)))
            cols = [t.column(c).to_numpy()[some] for c in names]
            group = np.cumsum(new)[some]
            root = near_sets(points_of(*cols), group, radius, pivots, confirm=confirm and confirm(*cols)) if len(some) else some
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.record_batch([pa.array(cols[0][far]), pa.array(cols[0][root[far]])], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4 * BLOCK:
                continue
            same = np.ones(held.num_rows, bool)
            for c in groups:
                same &= held.column(c).to_numpy() == held.column(c)[-1].as_py()
            cut = int(np.argmax(same))
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, "a long, b long")


def links(points: DataFrame, radius: int = 4) -> DataFrame:
    """points: (fp long), distinct.  (a, b) such that their components are those of all pairs within the radius."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(m) for m in _scheme(max(points.count(), 1), radius)]
    # The choice of ranges is mixed into the key: ranges of different choices never meet, as a key of theirs differs in the mask's own bits.
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return _compare(points.select(F.explode(keys).alias("key"), "fp"), ["fp"], radius, PIVOTS[:, None], lambda fp: fp.view(np.uint64)[:, None])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    fingerprint: 16 hex digits; component_id: the smallest id reachable over links of `radius` bits or fewer, through copies too.
    Null, empty or wordless texts have fingerprint zero and are linked like any other.  Repeated rows give repeated rows; a null id counts
    in its component but is never its smallest id (a component of null ids alone has component_id null).  An empty table gives none.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "simhash")
    fingerprints(docs, id_col, text_col, shingle).write.parquet(f"{folder}/points")
    rows = spark.read.schema("id long, fp long").parquet(f"{folder}/points")
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(least.select("fp"), radius))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")).checkpoint()
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(tops, "root").select("fp", "component_id")
    return rows.join(final, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit words of a wide fingerprint, with what each mixes into a shingle's hash; reference fingerprints for it.
LANES = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
WIDE_PIVOTS = np.random.Generator(np.random.PCG64(256)).integers(0, 2**64, size=(4, len(LANES)), dtype=np.uint64)
#: Standard deviations that the radius goes beyond the expected distance of a pair of just the similarity asked for.
DEVIATIONS = 6
#: Sets of fewer shingles are compared without fingerprints, as the binomial law says too little about so few.
FEW = 64
_FEW_SALT = np.uint64(0x2545F4914F6CDD1D)
#: Cells of the table of how common shingles are: about one for so many shingles, within these powers of two; slices that it is summed and stored in.
PER_CELL, CELLS, SLICES = 16, (16, 26), 64
#: Large buckets that are broadcast (16 bytes each); more are joined.
BROADCAST = 100_000


#: Words of sets and fingerprints that a task keeps at once; bits of a set's place that say where in its file it starts.
KEPT, WITHIN = 4 << 20, 40


class Sets:
    """Sets of shingle hashes in files below a folder, one for each attempt of a task; a set's place is the attempt and where it starts, behind its fingerprint."""

    def __init__(self, folder: str):
        self.filesystem, self.path = resolve(folder)
        self.files: dict[int, pa.NativeFile] = {}
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.size = 0

    def read(self, place: int, n: int) -> np.ndarray:
        """n words from this place on, or those before it."""
        if (own := place >> WITHIN) not in self.files:
            if len(self.files) >= 256:
                self.files.popitem()[1].close()
            self.files[own] = self.filesystem.open_input_file(f"{self.path}/{own}.bin")
        at = place & ((1 << WITHIN) - 1)
        return np.frombuffer(self.files[own].read_at(8 * abs(n), 8 * (at + min(n, 0))), "<u8")

    def get(self, place: int, n: int) -> np.ndarray:
        """The same words, kept for when they are asked for again."""
        if (found := self.held.get((place, n))) is None:
            if self.size + abs(n) > KEPT:
                self.held.clear()
                self.size = 0
            self.held[place, n] = found = self.read(place, n)
            self.size += abs(n)
        return found

    def fingerprints(self, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The fingerprints of the sets at these places; all alike where n is negative, which says that the set is compared without."""
        out = np.zeros((len(place), len(LANES)), np.uint64)
        for i in np.flatnonzero(n > 0).tolist():
            out[i] = self.get(int(place[i]), -len(LANES))
        return out

    def similar(self, similarity: float) -> Callable:
        """For the places and sizes of points: which pairs of them (two arrays of indices) have a Jaccard similarity of so much or more."""

        def of(place: np.ndarray, n: np.ndarray) -> Callable:
            n = np.abs(n)

            def confirm(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                out = np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right])
                if len(left) > 8 and (left == left[0]).all():
                    some = np.flatnonzero(out)
                    hub, sets = self.get(int(place[left[0]]), int(n[left[0]])), [self.get(int(place[i]), int(n[i])) for i in right[some]]
                    if sets:
                        words, size = np.concatenate(sets), n[right[some]]
                        at = np.minimum(np.searchsorted(hub, words), len(hub) - 1)
                        common = np.add.reduceat((hub[at] == words).astype(np.int64), np.cumsum(size) - size)
                        out[some] = common >= similarity * (len(hub) + size - common)
                    return out
                for i in np.flatnonzero(out):
                    a, b = int(left[i]), int(right[i])
                    x, y = self.get(int(place[a]), int(n[a])), self.get(int(place[b]), int(n[b]))
                    both = np.sort(np.concatenate((x, y)))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    out[i] = common >= similarity * (len(both) - common)
                return out

            return confirm

        return of


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, folder: str) -> DataFrame:
    """(id, text_hash, node, n, place): of a text's set of word shingles a hash, size and place in `folder`, where its fingerprint of 256 bits is, too.  n is 0 without words."""

    @tidy
    def run(batches):
        filesystem, path = resolve(folder)
        own, at, out, lanes = TaskContext.get().taskAttemptId(), 0, None, len(LANES)
        try:
            for batch in batches:
                node, n, place = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for lo, hi, w in tv.words_of(batch.column(1), tv.LOWER):
                    h, each = shingle_sets(w, shingle)
                    full = np.flatnonzero(each)
                    if not len(full):
                        continue
                    starts = (np.cumsum(each) - each)[full]
                    begin = starts + lanes * np.arange(1, len(full) + 1)
                    n[lo:hi], place[lo + full] = each, (own << WITHIN) + at + begin
                    node[lo + full] = tv.mix(np.add.reduceat(tv.mix(h), starts) + each[full].astype(np.uint64))
                    words = np.empty(len(h) + lanes * len(full), "<u8")
                    words[np.arange(len(h)) + np.repeat(begin - starts, each[full])] = h
                    words[begin[:, None] + np.arange(-lanes, 0)] = majority(h, each, LANES)[:, full].T
                    out = out or filesystem.open_output_stream(f"{path}/{own}.bin")
                    out.write(words.tobytes())
                    at += len(words)
                yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(c.view(np.int64)) for c in (node, n, place))], names=["id", "text_hash", "node", "n", "place"])
        finally:
            if out:
                out.close()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    return texts.mapInArrow(run, "id long, text_hash long, node long, n long, place long")


def _common(points: DataFrame, sets: str, folder: str, cells: int) -> None:
    """Stores how many sets have a shingle of each cell (the hash's lowest bits), at most 65535, in slices.  points: (place, n).  It is an order of shingles, not a result."""
    width = cells // SLICES

    @tidy
    def count(batches):
        held, total = Sets(sets), np.zeros(cells, np.uint32)
        for batch in batches:
            for place, n in zip(*(c.to_pylist() for c in batch.columns)):
                np.add.at(total, (held.read(place, n) & np.uint64(cells - 1)).astype(np.int64), 1)
        for k in range(SLICES):
            own = total[k * width : (k + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                n = np.minimum(own[at], 65535).astype(np.uint16)
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack(np.diff(at, prepend=0).astype(np.uint32))], pa.binary()), pa.array([pack(n)], pa.binary())], names=["slice", "at", "n"])

    @tidy
    def gather(batches):
        now, total = -1, np.zeros(width, np.uint32)

        def store():
            if now >= 0:
                write_array(f"{folder}/common-{now}.npy", np.minimum(total, 65535).astype(np.uint16))

        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    store()
                    now, total = k, np.zeros(width, np.uint32)
                total[np.cumsum(unpack(at, np.uint32))] += unpack(n, np.uint16)
        store()
        yield pa.record_batch([pa.array([now], pa.int32())], names=["last"])

    rows = points.mapInArrow(count, "slice int, at binary, n binary")
    rows.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(gather, "last int").agg(F.count("*")).collect()


def _level(folder: str, cells: int) -> np.ndarray:
    parts = [f"{folder}/common-{k}.npy" for k in range(SLICES)]
    return np.concatenate([map_array(x) if exists(x) else np.zeros(cells // SLICES, np.uint16) for x in parts])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, group, least), one row per row of docs: its group of texts whose shingle sets are that similar or more, and the group's smallest id.

    Points (equal sets are one) meet in buckets of equal shingles.  Two sets of a Jaccard similarity s have a shingle in common among the (1 - s) n + 1 first of each, in any
    one order of all shingles; the order is by how many sets have them, the rarest first, so what a third of all texts share puts nobody together, and no pair is lost.  The
    rows grow with the text and with nothing else.  In a bucket the pivot tables do the work: a pair goes if its distances to a reference fingerprint differ by more than the
    radius, or its fingerprints do; only the exact similarity of the two sets makes a link of what is left.  A Jaccard similarity s is a cosine of 2 s / (1 + s),
    so an expected share of differing fingerprint bits, arccos of it over pi; the radius is this share of 256 bits and DEVIATIONS standard deviations more, which by the binomial law
    parts two in 10**8 pairs of just that similarity.  Sets of fewer than FEW shingles are compared without fingerprints, exactly.

    Null, empty and wordless texts are left alone: each id is a group.  Texts of fewer words than a shingle are one shingle.  Texts of any length are taken whole.  Repeated rows
    are one group; null ids count last.  An empty table gives none.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "similar")
    sets = workspace(spark, "sets")
    wide_fingerprints(docs, id_col, text_col, shingle, sets).write.parquet(f"{folder}/points")
    rows = spark.read.schema("id long, text_hash long, node long, n long, place long").parquet(f"{folder}/points")
    distinct = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("place").alias("place"))
    # In the order of their places, so that each task reads the sets' files from front to back.
    distinct.repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{folder}/named")
    named = spark.read.schema("least long, node long, n long, place long").parquet(f"{folder}/named")
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    width = 64 * len(LANES)
    radius = int(width * share + DEVIATIONS * (width * share * (1 - share)) ** 0.5)
    shingles = named.agg(F.sum("n")).first()[0] or 0
    cells = 1 << int(np.clip(np.ceil(np.log2(max(shingles / PER_CELL, 1))), *CELLS))
    _common(named.select("place", "n"), sets, folder, cells)

    def spread(batches, over=False):
        """Each point with each of its first shingles, n negative where it is compared without fingerprint; with `over`, only the keys that may have over BLOCK points."""
        held, level = Sets(sets), _level(folder, cells)
        if over and not (level > BLOCK).any():
            return
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                place, n = (part.column(i).to_numpy() for i in range(2))
                h = np.concatenate([held.read(a, b) for a, b in zip(place.tolist(), n.tolist())])
                own = np.repeat(np.arange(len(n)), n)
                common = level[(h & np.uint64(cells - 1)).astype(np.int64)]
                order = np.lexsort((h, common, own))
                begin = np.cumsum(n) - n
                first = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                order = order[np.arange(len(h)) - begin[own] < first[own]]
                own, h, common = own[order], h[order], common[order]
                for few in (False, True):
                    take = n[own] < FEW / similarity if few else n[own] >= FEW
                    take = np.flatnonzero(take & (common > BLOCK) if over else take)
                    key = pa.array((tv.mix(h[take] ^ _FEW_SALT) if few else h[take]).view(np.int64))
                    if over:
                        yield pa.record_batch([key], names=["key"])
                        continue
                    yield pa.record_batch([key, pa.array(place[own[take]]), pa.array(n[own[take]] * (-1 if few else 1))], names=["key", "place", "n"])

    points = named.select("place", "n")
    keyed = points.mapInArrow(tidy(spread), "key long, place long, n long")
    over = points.mapInArrow(tidy(lambda batches: spread(batches, True)), "key long")
    over.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK).write.parquet(f"{folder}/large")
    large = spark.read.schema("key long, held long").parquet(f"{folder}/large")
    large = F.broadcast(large) if large.count() <= BROADCAST else large

    own: list[Sets] = []  # a task's

    def reader() -> Sets:
        if not own:
            own.append(Sets(sets))
        return own[0]

    def prints(place, n):
        return reader().fingerprints(place, n)

    def confirm(place, n):
        return reader().similar(similarity)(place, n)

    roots = connected_components(_compare(keyed, ["place", "n"], radius, WIDE_PIVOTS, prints, confirm, large)).where("node <> root").withColumnRenamed("node", "place")
    remove(sets)
    joined = named.select("node", "place", "least").join(roots, "place", "left").select("node", "least", F.coalesce("root", "place").alias("root")).checkpoint()
    tops = joined.groupBy("root").agg(F.min("least").alias("top"))
    final = joined.join(tops, "root").select("node", "top", "root")
    wordless = F.col("n") == 0
    named_rows = rows.join(final, "node", "left").withColumn("group", F.when(wordless, F.xxhash64("id", "text_hash")).otherwise(F.col("root")))
    return named_rows.select(F.col("id").alias("doc_id"), "text_hash", "group", F.when(wordless, F.col("id")).otherwise(F.col("top")).alias("least"))
