"""N-gram Jaccard join: count vectors in an R-tree, and verification of what its bound lets through.

Sets of word shingles are hashed into groups. Documents that link differ in few shingles, so in most groups they
hold the very same ones: by the pigeonhole principle they share one of a few signatures (group and what it holds),
and no link is lost, in whatever order all sets look at their signatures. They look at those of rarely used hash
buckets first, so a passage that many documents share is no meeting point. Sets that share signatures meet in
blocks. There the counts of shingles in groups are points of an R-tree, whose boxes bound the overlap by the summed
minima of coordinates; pairs within the bound are verified on the whole sets, for which only their texts are read again. Where a block has many such pairs, a
spanning forest of them is verified first, and then only pairs that are still in different components: near copies
by the thousand don't make all their pairs. Equal sets are one class from the start.
"""


from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import discard, materialize, release, slices

#: Coordinates of a count vector, at most.
COORDINATES = 8192
#: Largest set whose shingles are groups of their own.
SINGLES = 16
#: Bytes of text hashed at a time, rows handled at a time, and members of a group that are compared in one block.
BLOCK, ROWS, MEMBERS = 1 << 18, 256, 1024
#: Sons of a node; groups up to this size are compared without a tree; 64-bit words compared at a time.
FANOUT, SMALL, CELLS = 32, 16, 1 << 18
#: Buckets of the signature counts; rows above the mean from which a bucket is hot; parts of a hot signature.
BUCKETS, HOT, SALTS = 1 << 16, 20_000, 64
SEEDS = 8
#: Bits of the mask of wanted documents: a broadcast of 65,536 rows of two numbers at most.
MASK = 1 << 22
#: Bits of a signature, below the salt in `place`, and bits below a set's name that hold the tag in `who`.
SIG, TAG = 48, 7

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(256, dtype=_U), 5)


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words in lower-cased bytes; a word also ends at each of `cuts`."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    starts = np.flatnonzero(first[at])
    sizes = np.diff(np.append(starts, len(at)))
    powers = np.full(int(sizes.max()), 0x5851F42D4C957F2D, _U)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        sums = np.add.reduceat(_BYTES[data[at]] * powers[np.arange(len(at)) - np.repeat(starts, sizes)], starts)
        return _mix(sums + sizes.astype(_U)), at[starts]


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, in blocks cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # cut behind the last white space, or read on
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + BLOCK)
        out.append(_words(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of an Arrow column, read from its buffer; none for null."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        j = min(j, len(texts))
        if j == i + 1:
            yield _long(data[offsets[i] : offsets[j]])
        else:
            bounds = offsets[i : j + 1] - offsets[i]
            hashes, places = _words(data[offsets[i] : offsets[j]], bounds[:-1])
            yield from np.split(hashes, np.searchsorted(places, bounds[1:-1]))
        i = j


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        if len(words) < n:
            return _mix(np.array([(words * _mix(np.arange(1, len(words) + 1, dtype=_U), 77)).sum()], _U), len(words))
        m = len(words) - n + 1
        total = np.zeros(m, _U)
        for k in range(n):
            total += words[k : k + m] * _U(2 * k + 0x51ED27 + k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
        return np.unique(_mix(total))


def _differ(n: int, m: int, least: tuple[int, int]) -> int:
    """In how many shingles sets of n and m elements that link can differ."""
    t, of = least
    return ((of - t) * (n + m)) // (of + t)


def _levels(n: int, least: tuple[int, int]) -> list[tuple[int, int]]:
    """The size classes in which a set of n elements meets others, and in how many elements a partner there can differ.

    A pair meets in the class of its larger set. Class 0 ends at SINGLES; each later one at twice the one before.
    """
    t, of = least
    level, end = 0, SINGLES
    while n > end:
        level, end = level + 1, 2 * end
    most = n * of // t
    out = [(level, _differ(n, min(most, end), least))]
    while most > end:  # larger partners are in a later class
        level, end = level + 1, 2 * end
        out.append((level, _differ(n, min(most, end), least)))
    return out


def _groups(level: int, least: tuple[int, int]) -> int:
    """How many groups a class has; 0: each shingle is one. Enough that differences can't reach all that hold something."""
    t, of = least
    load = 5.0
    while load > 0.5 and (1 - math.exp(-load)) / load < 1.35 * (of - t) / t:
        load -= 0.1
    return 0 if level == 0 or load <= 0.5 else max(32, math.ceil((SINGLES << level) / load))


def _level(n: int) -> int:
    """The size class of a set: class 0 ends at SINGLES, each later one at twice the one before."""
    return max(0, (n - 1) // SINGLES).bit_length()


def signatures(s: np.ndarray, least: tuple[int, int], seed: int) -> list[tuple[int, int, np.ndarray]]:
    """(size class, how many signatures must be looked at, all signatures) of a set, for each class where it meets others."""
    out = []
    with np.errstate(over="ignore"):
        mixed = _mix(s, 100 + seed)
        for level, differ in _levels(len(s), least):
            groups = _groups(level, least)
            if groups:
                g = (mixed >> _U(20)) % _U(groups)
                order = np.argsort(g, kind="stable")
                g, x = g[order], mixed[order]
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                sigs = _mix(np.add.reduceat(_mix(x, 9), starts) + g[starts] * _U(0x9E3779B97F4A7C15), level)
            else:
                sigs = _mix(mixed, level)
            out.append((level, differ + 1, sigs))
    return out


SKETCH = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("own", pa.int32()), ("need0", pa.int32()), ("need1", pa.int32()), ("sigs", pa.list_(pa.int64())), ("enough", pa.bool_()), ("bits0", pa.binary()), ("excess0", pa.int64()), ("bits1", pa.binary()), ("excess1", pa.int64())])


def _names(s: np.ndarray) -> tuple[int, int]:
    """121 bits that name a set, as two signed numbers; the last TAG bits of the first are 0."""
    with np.errstate(over="ignore"):
        a, b = np.array([_mix(s, 1).sum(dtype=_U), _mix(s, 2).sum(dtype=_U)], _U).view(np.int64).tolist()
        return a >> TAG << TAG, b


def _sketched(df: DataFrame, text: str, doc_id: str, n: int, least: tuple[int, int], seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, ROWS):
            rows: list[tuple] = []
            for w in word_hashes(batch.column(1)):
                s = shingle_set(w, n)
                made = signatures(s, least, seed) if len(s) else []
                need = [x[1] for x in made] + [0, 0]
                sigs = (np.concatenate([x[2] for x in made]) >> _U(64 - SIG)).view(np.int64) if made else np.zeros(0, np.int64)
                vectors = [count_vector(s, x[0]) for x in made[:2]] + [(None, None)] * 2
                rows.append((len(s), *_names(s), len(made[0][2]) if made else 0, need[0], need[1], sigs, all(len(x[2]) >= x[1] for x in made), *vectors[0], *vectors[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), list(SKETCH)[1:], strict=True))], schema=SKETCH)

    return df.select(F.col(doc_id).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n long, h1 long, h2 long, own int, need0 int, need1 int, sigs array<long>, enough boolean, bits0 binary, excess0 long, bits1 binary, excess1 long")


def _bucket_counts(sketches: DataFrame) -> np.ndarray:
    """Signatures of the whole corpus in each of BUCKETS hash buckets; combined on the map side, fixed in size."""
    got = sketches.where("n > 0").select(F.explode("sigs").alias("s")).groupBy(F.expr(f"cast(s & {BUCKETS - 1} as int)").alias("b")).count().collect()
    out = np.zeros(BUCKETS, np.int64)
    for b, count in got:
        out[b] = count
    return out


def _prefixes(sketches: DataFrame, counts: np.ndarray) -> DataFrame:
    """(place, who): of each set and size class the signatures that must be looked at, those of rare buckets first.

    place is the signature, and above it a salt that splits those of hot buckets; who is h1 and the tag: twice the size
    class, plus one where that isn't the set's own. This is by far the largest shuffle, so a row is two numbers.
    """
    mean = counts.mean()
    hot = counts > mean + 8 * np.sqrt(mean) + HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            h1, n, own, need0, need1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            lists = batch.column(5)
            sigs, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            slot = (np.arange(len(sigs)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= own[row]).astype(np.int64)
            part, bucket = 2 * row + slot, sigs & (BUCKETS - 1)
            order = np.lexsort((sigs, counts[bucket], part))
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            rank = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
            order = order[rank < np.where(slot, need1[row], need0[row])[order]]
            level = np.array([_level(int(x)) for x in n], np.int64)
            row, slot, sigs = row[order], slot[order], sigs[order]
            salt = np.where(hot[bucket[order]], 1 + (h1[row] >> 8 & (SALTS - 1)), 0)
            yield pa.RecordBatch.from_arrays([pa.array(sigs | salt << SIG), pa.array(h1[row] | 2 * (level[row] + slot) + slot)], ["place", "who"])

    return sketches.where("n > 0").select("h1", "n", "own", "need0", "need1", "sigs").mapInArrow(run, "place long, who long")


def _groups_that_meet(sketches: DataFrame) -> DataFrame:
    """(key, tag, h1): the sets that share a signature, one key for all signatures that the very same sets share.

    A signature of a hot bucket is split by salt and stays a key of its own, without a look at who shares it.
    """
    rows = _prefixes(sketches, _bucket_counts(sketches)).repartition("place")
    rows = rows.select("place", F.expr(f"who >> {TAG} << {TAG}").alias("h1"), F.expr(f"cast(who & {(1 << TAG) - 1} as int)").alias("tag"), (F.col("place") >= 1 << SIG).alias("salted"))
    of = Window.partitionBy("place")
    met = rows.withColumn("low", F.min("h1").over(of)).withColumn("high", F.max("h1").over(of)).where("salted OR low < high")
    met = met.groupBy("place", "salted", "tag", "h1").agg(F.lit(1).alias("one"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "h1")).over(of) for k in (1, 2)]
    key = F.when(F.col("salted"), F.expr(f"place & {(1 << SIG) - 1}")).otherwise(F.xxhash64(*same, F.shiftright("tag", 1)))
    # sets that are all smaller than the class meet in their own
    met = met.withColumn("least", F.min(F.col("tag") % 2).over(of)).withColumn("key", key).where("salted OR least = 0")
    return met.select("key", "tag", "h1").distinct()


def _coordinates(level: int) -> tuple[int, int]:
    """Coordinates of the count vectors of a size class, and to what count each is written.

    Two bits a shingle: the bound of sets that have nothing in common is near half their size.
    """
    end = SINGLES << level
    size = max(64, min(2 * end, COORDINATES))
    load = end / size
    return size, 1 if load <= 0.5 else min(32, math.ceil(load + 2.5 * math.sqrt(load)) + 1)


def count_vector(s: np.ndarray, level: int) -> tuple[bytes, int]:
    """Group counts of a set in unary, bit by bit, so that the summed minima of two are the bits of their AND; and what is beyond."""
    size, depth = _coordinates(level)
    counts = np.bincount((s >> _U(11)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits(counts > np.arange(depth)[:, None]).tobytes(), int((counts - depth).clip(0).sum())


def _sets(df: DataFrame, n: int) -> DataFrame:
    """(rep, set) of (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            sets = [shingle_set(w, n).view(np.int64) for w in word_hashes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "set"])

    return df.mapInArrow(run, "rep long, set array<long>")


class RTree:
    """Static R-tree over count vectors in unary bits, packed by size: a box has the OR of its points and their range of sizes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, excess: np.ndarray):
        self.order = np.lexsort((np.bitwise_count(bits).argmax(axis=1), sizes))
        node = (bits[self.order], sizes[self.order], sizes[self.order], excess[self.order])
        self.levels = [node]
        while len(node[0]) > FANOUT:
            at = np.arange(0, len(node[0]), FANOUT)
            node = tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), node))
            self.levels.append(node)

    def search(self, bits: np.ndarray, sizes: np.ndarray, excess: np.ndarray, least: tuple[int, int]) -> np.ndarray:
        """Matrix (queries, points) of whether the overlap can be enough: t * (a + b) <= (t + of) * overlap."""
        out = np.zeros((len(bits), len(self.order)), bool)
        step = max(1, CELLS // (FANOUT * bits.shape[1]))
        for at in range(0, len(bits), step):
            self._descend(len(self.levels) - 1, 0, len(self.levels[-1][0]), np.arange(at, min(len(bits), at + step)), bits, sizes, excess, least, out)
        return out

    def _descend(self, depth: int, start: int, end: int, q: np.ndarray, bits: np.ndarray, sizes: np.ndarray, excess: np.ndarray, least: tuple[int, int], out: np.ndarray) -> None:
        t, of = least
        high, low, top, more = (x[start:end] for x in self.levels[depth])
        bound = np.bitwise_count(bits[q][:, None] & high).sum(axis=2, dtype=np.int64) + np.minimum(excess[q][:, None], more)
        bound = np.minimum(bound, np.minimum(sizes[q][:, None], top))
        fits = t * (sizes[q][:, None] + low) <= (t + of) * bound
        if depth == 0:
            out[q[:, None], self.order[start:end]] = fits
            return
        below = len(self.levels[depth - 1][0])
        for k in np.flatnonzero(fits.any(axis=0)).tolist():
            first = (start + k) * FANOUT
            self._descend(depth - 1, first, min(below, first + FANOUT), q[fits[:, k]], bits, sizes, excess, least, out)


def _forest(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a breadth-first forest of a symmetric matrix, from vertices of many neighbours on."""
    left, degree = adjacent.any(axis=0), adjacent.sum(axis=0)
    a, b = [], []
    for root in np.argsort(-degree, kind="stable").tolist():
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(adjacent[front].any(axis=0) & left)
            a.append(front[adjacent[np.ix_(front, new)].argmax(axis=0)])
            b.append(new)
            left[new] = False
            front = new
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compared(members: DataFrame, least: tuple[int, int], whole: bool) -> DataFrame:
    """(a, b, key) of members (key, x, y, mine, rep, component, slot, n, excess, bits), dealt and sorted by key, x, y.

    Pairs of different components whose count vectors pass the bound. Of a block with many of them a spanning forest
    unless `whole`, and a row (null, null, key) that says so.
    """

    def block(p: dict[str, np.ndarray], bits: np.ndarray, i: np.ndarray) -> Iterator[tuple]:
        x, y = p["x"][i[0]], p["y"][i[0]]
        left, right = i[p["mine"][i] == x], i[p["mine"][i] == y]
        if not len(left) or not len(right):
            return
        tree = RTree(bits[right], p["n"][right], p["excess"][right])
        hits = tree.search(bits[left], p["n"][left], p["excess"][left], least)
        hits &= (p["component"][left][:, None] != p["component"][right]) & ((p["slot"][left] == 0)[:, None] | (p["slot"][right] == 0))
        if x == y:
            hits &= np.arange(len(left))[:, None] < np.arange(len(right))
        if whole or hits.sum() <= 2 * len(i):
            a, b = np.nonzero(hits)
            yield p["rep"][left[a]], p["rep"][right[b]], None
            return
        if x == y:
            a, b = _forest(hits | hits.T)
            yield p["rep"][left[a]], p["rep"][left[b]], p["key"][i[0]]
        else:
            both, k = np.zeros((len(left) + len(right),) * 2, bool), len(left)
            both[:k, k:] = hits
            both[k:, :k] = hits.T
            a, b = _forest(both)
            at = np.append(left, right)
            yield p["rep"][at[a]], p["rep"][at[b]], p["key"][i[0]]

    def small(p: dict[str, np.ndarray], bits: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple]:
        """All groups of the same small size at once; no tree is needed."""
        t, of = least
        u, v = np.triu_indices(size, 1)
        step = max(1, CELLS // (len(u) * bits.shape[1]))
        for at in range(0, len(starts), step):
            a, b = ((starts[at : at + step, None] + w).ravel() for w in (u, v))
            bound = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(p["excess"][a], p["excess"][b])
            bound = np.minimum(bound, np.minimum(p["n"][a], p["n"][b]))
            ok = (t * (p["n"][a] + p["n"][b]) <= (t + of) * bound) & (p["component"][a] != p["component"][b]) & ((p["slot"][a] == 0) | (p["slot"][b] == 0))
            yield p["rep"][a[ok]], p["rep"][b[ok]], None

    def groups(batch: pa.RecordBatch) -> Iterator[tuple]:
        p = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "x", "y", "mine", "rep", "component", "slot", "n", "excess")}
        change = np.append(True, (p["key"][1:] != p["key"][:-1]) | (p["x"][1:] != p["x"][:-1]) | (p["y"][1:] != p["y"][:-1]))
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(change)))
        raw = batch.column("bits")
        width = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
        for w in np.unique(width[starts]).tolist():
            of_width = np.flatnonzero(width == w)
            place = np.full(len(width), -1)
            place[of_width] = np.arange(len(of_width))
            bits = np.frombuffer(b"".join(raw.take(pa.array(of_width)).to_pylist()), np.uint64).reshape(len(of_width), -1)
            q = {name: x[of_width] for name, x in p.items()}
            mine = width[starts] == w
            first, many = place[starts[mine]], sizes[mine]
            for size in np.unique(many).tolist():
                at = first[many == size]
                if 2 <= size <= SMALL:
                    alone = q["x"][at] == q["y"][at]
                    yield from small(q, bits, at[alone], size)
                    at = at[~alone]
                for s in at.tolist() if size > 1 else ():
                    yield from block(q, bits, np.arange(s, s + size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, key in groups(batch):
                a, b = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64())], ["a", "b", "key"])

        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            k, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y"))
            last = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[-1]
            rest = batch.slice(int(last))
            if last:
                yield from made(batch.slice(0, int(last)))
        if rest is not None:
            yield from made(rest)

    return members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long, key long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the least node reachable.

    Least labels spread over the edges and then to the labels' labels, so chains halve; minima combine on the map
    side, whatever a node's degree. Each round is written to the shared folder, and the one before is dropped.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = materialize(step.join(jump, "next").select("node", F.least("next", "far").alias("component"), "was"), "labels")
        discard(labels)
        if new.where("component < was").isEmpty():
            discard(both)
            return new.select("node", "component")
        labels = new


def _may_hold(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of `df` whose key may be a `doc` of `wanted`: all that are, and those that share a bit of MASK with one.

    The mask is a broadcast of MASK / 64 rows at most, whatever the tables' size; it keeps rows out of the shuffle.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MASK))
    masks = wanted.select(bit(F.col("doc")).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    own = df.withColumn("bit", bit(F.col(key)))
    return own.join(F.broadcast(masks), F.shiftright("bit", 6).cast("int") == F.col("word")).where(F.expr("shiftrightunsigned(mask, cast(bit & 63 as int)) & 1 = 1")).select(*df.columns)


def link(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4, least: tuple[int, int] = (85, 100)) -> DataFrame:
    """(doc, n, component) of each row: size of its set of n-word shingles, and the smallest doc_id it is linked to.

    Two documents link when of * intersection >= t * union for least = (t, of). Null and empty texts have an empty
    set and link with nothing; fewer than n words are one shingle. doc_id is an integer; rows without one keep a
    null component. Rows that repeat a doc_id are one document, and all its texts' links are its own. Texts of any
    length are read whole. An empty table gives an empty result; other columns are not read.
    """
    for seed in range(SEEDS):
        docs = materialize(_sketched(df, text, doc_id, n, least, seed), "sketches", "zstd")
        if docs.where("NOT enough").isEmpty():  # else a set's shingles fell into too few groups: below 1e-11 a document
            break
        discard(docs)
    else:
        raise RuntimeError("a set has too few groups under every seed")
    known = docs.where("doc IS NOT NULL")
    groups = materialize(_groups_that_meet(known), "groups")
    named = materialize(known.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("rep")), "classes")
    labelled = materialize(docs.select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc", "n", "h1", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep")), "labelled")
    reps = labelled.where("doc = rep AND n > 0").select("h1", "rep").distinct()
    groups = materialize(groups.join(reps, "h1").select("key", "tag", "rep", "h1"), "members")

    # the count vectors of those that meet; their texts stay where they are
    wanted = groups.select(F.col("rep").alias("doc")).distinct()
    vectors = known.where("n > 0").select(F.col("doc").alias("rep"), "h1", "n", "bits0", "excess0", "bits1", "excess1")
    vectors = materialize(_may_hold(vectors, "rep", wanted), "vectors")
    discard(docs)

    def candidates(groups: DataFrame, vectors: DataFrame, whole: bool) -> DataFrame:
        sizes = groups.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"), F.count("*").alias("all")).where("all > 1")
        slot = F.col("tag") % 2
        dealt = groups.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = Window.partitionBy("rep", "h1").orderBy(F.lit(0))  # repeated rows
        dealt = dealt.join(vectors.withColumn("copy", F.row_number().over(own)).where("copy = 1").drop("copy"), ["rep", "h1"]).select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep", "component", slot.alias("slot"), "n", F.when(slot == 0, F.col("excess0")).otherwise(F.col("excess1")).alias("excess"), F.when(slot == 0, F.col("bits0")).otherwise(F.col("bits1")).alias("bits"))
        return _compared(dealt, least, whole)

    def verified(pairs: DataFrame, *others: DataFrame) -> DataFrame:
        """Those of the pairs that link, and others."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids")
        texts = df.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).where("text IS NOT NULL")
        # not a semi-join: that would be pushed below the mask
        texts = _may_hold(texts, "rep", ids.withColumnRenamed("rep", "doc")).join(ids, "rep")
        own = Window.partitionBy("rep", F.xxhash64("text")).orderBy(F.lit(0))
        sets = materialize(_sets(texts.withColumn("copy", F.row_number().over(own)).where("copy = 1").select("rep", "text"), n), "sets")
        x = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
        common = F.size(F.array_intersect("set_a", "set_b"))
        t, of = least
        out = x.where((t + of) * common.cast("long") >= t * (F.size("set_a") + F.size("set_b")).cast("long")).select("a", "b").distinct()
        for other in others:
            out = out.unionByName(other)
        out = materialize(out, "links")
        discard(sets)
        discard(ids)
        return out

    found = materialize(candidates(groups.withColumn("component", F.col("rep")), vectors, False), "candidates")
    # texts of one document belong together
    of_doc = labelled.where("n > 0 AND doc IS NOT NULL").groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc", "a")
    of_doc = of_doc.join(labelled.where("n > 0"), "doc").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    edges = verified(materialize(found.where("a < b").select("a", "b").distinct(), "pairs"), of_doc)
    linked = components(edges)

    # blocks with more pairs than were looked at: all their pairs that are still apart
    open_groups = groups.join(found.where("key IS NOT NULL").select("key").distinct(), "key", "left_semi")
    if not open_groups.isEmpty():
        apart = materialize(open_groups.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "open")
        many = apart.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        apart = materialize(apart.join(many, "key"), "apart")
        near = _may_hold(vectors, "rep", apart.select(F.col("rep").alias("doc")))
        rest = materialize(candidates(apart, near, True).select("a", "b").where("a < b").distinct().join(found.select("a", "b").distinct(), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty() and not (more := verified(rest)).isEmpty():
            linked = components(edges.unionByName(more))
    out = labelled.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc", "n", F.coalesce("component", "rep").alias("component"))
