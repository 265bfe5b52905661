"""Near-duplicate classes (operator 8): Order MinHash proposes pairs, banded alignment confirms them.

Each text is reduced to its five-word k-mers, labelled by how often the k-mer occurred before in the text.
A hash lays them on a circle; from each of 16 points on it the next two are taken, and the pair, in the order in
which they stand in the text, is a sketch key. Five such circles give up to 80 keys, two
more up to 112 where a text has at most 128 k-mers. Texts that agree in a key
share a bucket. Two texts with a share J of common labelled k-mers agree at a point with probability about J^2:
of pairs whose words differ at random in 5, 10 and 15 % of places fewer than one in a hundred shares no bucket,
at 20 %, the limit, about one in twenty (a test measures it).

Two texts are linked if they share a bucket and 1 - d / (words of the longer text) is at least 0.8, d being
the edit distance over words. The alignment is banded: its half width doubles until the distance fits into
it or exceeds the limit, so close copies are cheap. Classes are the connected parts.

Equal texts are one node from the start, whatever their number. Buckets with the same members are one bucket: a
group of near copies mostly shares all its keys. Every node is first aligned with one node only, the least of all its
buckets, then with the least nodes of those buckets whose class it is not yet in, so the work is linear in the
size of a bucket. A bucket may also hold texts that are alike in a small part, such
as a common passage; there the least node can be unlike two texts that are like each other.

What is still of several classes in a bucket is compared exactly. It goes in blocks of at most about `BLOCK` nodes,
every two blocks of a bucket once, and inside a block all nodes of different classes meet. A pair is listed only
if its lengths and its word counts in `BINS` bins leave room for a link: an edit changes one count up, one down or
both, so the counts that one text has more than the other are a lower bound of the distance. The listed
pairs are aligned in the block of the least bucket they share, as long as they are not in one class there, and only the
links that join two classes leave it. So every two texts that share a bucket and are alike end in one class; comparing
counts takes time with the square of what is mixed in a bucket, but no rows: a pair is a number beside its node.

All steps are joins and grouped sums on narrow rows; AQE splits a bucket that holds very many nodes. Words
of texts are read again only for texts that share a bucket.

Defined cases: a null text counts as an empty one; texts without words are alike only if they are equal;
a text of fewer than five words has one k-mer, all its words; the class id is the least id among its
documents, rows without an id not counting, and null if there is none; repeated rows get a row each; an
empty table gives an empty result. Only the two columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotweave.llm.memory import returns_memory
from plotweave.llm.textarrays import Texts, mix, occurrence, slices, span_hashes
from plotweave.operators.components import components
from plotweave.session import cut, parallelism, ship

WIDTH = 5
# Circles, and how many more for texts of at most SHORT k-mers; points per circle, a power of two.
CIRCLES = 5
MORE = 2
SHORT = 128
POINTS = 16
SHARE = 0.8
# Rows of 64-bit hashes that may be broadcast: 32 MB as a hashed relation.
BROADCAST_ROWS = 2_000_000
# Nodes of a mixed bucket that are compared at a time, and bins of the word counts, a byte each.
BLOCK = 2048
BINS = 256
# Words a text of such a block has on average at most, and places of a side of the squares in which its pairs are aligned.
LONG = 2048
SQUARE = 512

_U = np.uint64
_SEEDS = mix(np.arange(1, CIRCLES + MORE + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kmers(words: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """K-mer hashes of all texts in text order, and the index of each text's first one."""
    sizes = np.diff(first)
    count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    border = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(border[-1]) - np.repeat(border[:-1], count) + np.repeat(first[:-1], count)
    length = np.repeat(np.minimum(sizes, width), count)
    h = mix(length.astype(np.uint64))
    for k in range(width):
        more = k < length
        if more.all():
            h = mix(h ^ words[at + k])
        elif more.any():
            h[more] = mix(h[more] ^ words[at[more] + k])
    return h, border


def sketch_keys(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the different keys of all texts, and the index of each text's first key."""
    start, end, first = t.words()
    grams, border = kmers(span_hashes(t.data, start, end), first)
    count = np.diff(border)
    owner = np.repeat(np.arange(t.n), count)
    label = mix(grams + mix(owner.astype(np.uint64)))
    labelled = mix(grams + occurrence(label).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    some, short = count > 0, count[owner] <= SHORT
    found = []
    for k, seed in enumerate(_SEEDS):
        # the later circles are for short texts only
        use = np.flatnonzero(short) if k >= CIRCLES else np.arange(len(grams))
        texts = np.flatnonzero(some & (count <= SHORT)) if k >= CIRCLES else np.flatnonzero(some)
        v = mix(labelled[use] ^ seed)
        order = np.argsort((owner[use].astype(np.uint64) << _U(40)) | (v >> _U(24)))
        arc = owner[use] * POINTS + (v // _U(2**64 // POINTS)).astype(np.int64)
        at = np.cumsum(np.bincount(arc, minlength=t.n * POINTS))
        # the first k-mer behind each point, around the circle, and the one after it
        one = np.concatenate([[0], at[:-1]]).reshape(t.n, POINTS)[texts]
        low, past = one[:, :1], at.reshape(t.n, POINTS)[texts, -1:]
        one = np.where(one == past, low, one)
        two = np.where(one + 1 == past, low, one + 1)
        one, two = use[order[one]], use[order[two]]
        found.append((np.repeat(texts, POINTS), mix(mix(grams[np.minimum(one, two)] + _U(0x51ED2701)) ^ grams[np.maximum(one, two)]).ravel()))
    texts, keys = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    return np.diff(first), keys[new], np.concatenate([[0], np.cumsum(np.bincount(texts[new], minlength=t.n))])


def signatures(docs: DataFrame) -> DataFrame:
    """`(doc_id, node, hash, n_words, keys)` per row; equal texts have equal nodes."""
    rows = docs.select(F.col("doc_id"), _digest(F.col("text")).alias("node"), _hash(F.col("text")).alias("hash"), F.col("text").alias("text"))

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, past, t in slices(b.column(3)):
                n, keys, border = sketch_keys(t)
                lists = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[c[first:past] for c in b.columns[:3]], pa.array(n, pa.int64()), lists], ["doc_id", "node", "hash", "n_words", "keys"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, hash long, n_words long, keys array<long>")


def _word_rows(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """`(node, words)` of the texts whose hash is listed, packed as 32-bit word hashes."""
    listed = F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes
    rows = docs.select(_hash(F.col("text")).alias("hash"), F.col("text")).join(listed, "hash", "left_semi").select(_digest(F.col("text")).alias("node"), "text")

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, past, t in slices(b.column(1)):
                start, end, at = t.words()
                words = (span_hashes(t.data, start, end) >> _U(32)).astype("<u4")
                packed = [words[at[k] : at[k + 1]].tobytes() for k in range(t.n)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first:past], pa.array(packed, pa.binary())], ["node", "words"])

    return rows.mapInArrow(run, "node binary, words binary").groupBy("node").agg(F.min("words").alias("words"))


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], share: float = SHARE) -> np.ndarray:
    """Word edit distance of each pair, or -1 where it exceeds (1 - share) of the longer text."""
    out = np.full(len(pairs), -1, np.int64)
    open_pairs = []
    for k, (a, b) in enumerate(pairs):
        limit = int((1 - share) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > limit:
            continue
        a, b = _trimmed(a, b)
        if not len(a) or not len(b):
            out[k] = max(len(a), len(b))
            continue
        # words that have no partner in the other text must be edited
        if max(len(a), len(b)) - _shared(a, b) <= limit:
            open_pairs.append((k, a, b, limit))
    band = 8
    while open_pairs:
        todo, later = [], []
        for p in open_pairs:
            (todo if abs(len(p[1]) - len(p[2])) <= band else later).append(p)
        for part in _portions(todo, band):
            for p, d in zip(part, _banded([(a, b) for _, a, b, _ in part], band)):
                if d <= min(band, p[3]):
                    out[p[0]] = d
                elif band < p[3]:
                    later.append(p)
        open_pairs = later
        band *= 2
    return out


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, with repeats."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _portions(pairs: list, band: int, cells: int = 1 << 16) -> Iterator[list]:
    """Pairs of similar length, as many at once as keep a row of all bands small."""
    pairs = sorted(pairs, key=lambda p: -len(p[1]))
    step = max(1, cells // (2 * band + 1))
    for lo in range(0, len(pairs), step):
        yield pairs[lo : lo + step]


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances along a diagonal band, exact up to `band`; larger values only say "more".

    Pairs come by falling length of the first text. Row i holds, for each pair, the columns from
    i - band to i + band.
    """
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    many = 1 << 29
    out = np.full(len(pairs), many)
    side = 2 * band + 1
    a = np.zeros((n.max(), len(pairs)), np.int64)
    b = np.full((len(pairs), int(n.max()) + side), -2, np.int64)
    for k, (x, y) in enumerate(pairs):
        a[: len(x), k] = x
        b[k, band : band + min(len(y), b.shape[1] - band)] = y[: b.shape[1] - band]
    ramp = np.arange(side, dtype=np.int32)
    row = np.where(ramp >= band, ramp - band, many).astype(np.int32)[None, :].repeat(len(pairs), 0)
    active, ended = np.arange(len(pairs)), np.zeros(len(pairs), bool)
    for i in range(1, int(n.max()) + 1):
        # columns i - band .. i + band are the places i - 1 .. i - 1 + side of the padded second text
        best = row + (b[:, i - 1 : i - 1 + side] != a[i - 1][:, None])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        if i <= band:
            best[:, : band - i] = many
            best[:, band - i] = i
        best -= ramp
        np.minimum.accumulate(best, axis=1, out=best)
        best += ramp
        row = best
        now = np.flatnonzero(n[active] == i)
        out[active[now]] = row[now, m[active[now]] - i + band]
        ended[now] = True
        if i % 16 == 0:
            # a row whose least value exceeds the band only grows from there
            ended |= row.min(axis=1) > band
        if 4 * ended.sum() > len(active):
            keep = ~ended
            active, row, a, b, ended = active[keep], row[keep], a[:, keep], b[keep], ended[keep]
            if not len(active):
                break
    return out


def _verified(pairs: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """Pairs `(a, b)` that are linked."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("_aw"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("_bw"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "_aw", "_bw")

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # some pairs at a time, so that long texts are never unpacked all at once
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                both = [(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(part.column(2), part.column(3))]
                linked = pa.array(edit_distances(both, share) >= 0)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(linked)

    return rows.mapInArrow(run, "a binary, b binary")


def profiles(packed: list[bytes]) -> np.ndarray:
    """How many words of each text fall into each bin, 255 standing for more."""
    sizes = np.array([len(p) // 4 for p in packed], np.int64)
    words = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(packed)), sizes)
    counts = np.bincount(owner * BINS + words % BINS, minlength=len(packed) * BINS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, BINS)


def near_enough(n: np.ndarray, kind: np.ndarray, side: np.ndarray, counts: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different kinds that may be linked; with two sides, only pairs between them."""
    order = np.argsort(n, kind="stable")
    n, kind, side, counts = n[order], kind[order], side[order], counts[order]
    total = counts.sum(axis=1, dtype=np.int64)
    between = (side != side[0]).any()
    # by rising length a text meets those behind it up to the last length that fits
    fits = lambda a, b: b - a <= b * (1 - share) + 1e-9
    past = np.searchsorted(n, n / share + 2, side="right")
    ones, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i = 0
    while i < len(n):
        # as many texts at once as keep their pairs few
        k = i + 1
        while k < len(n) and (past[i : k + 1] - np.arange(i, k + 1)).sum() <= 1 << 14:
            k += 1
        many = past[i:k] - np.arange(i, k) - 1
        a = np.repeat(np.arange(i, k), many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + a + 1
        apart = (kind[a] != kind[b]) & fits(n[a], n[b])
        if between:
            apart &= side[a] != side[b]
        a, b = a[apart], b[apart]
        limit = ((1 - share) * n[b] + 1e-9).astype(np.int64)
        more = (np.maximum(counts[a], counts[b]) - counts[b]).sum(axis=1, dtype=np.int64)
        near = np.maximum(more, more - total[a] + total[b]) <= limit
        ones.append(order[a[near]])
        others.append(order[b[near]])
        i = k
    return np.concatenate(ones), np.concatenate(others)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have `width` bytes, a row each."""
    border = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[border[0] : border[-1]].reshape(-1, width)


def _owned(one: np.ndarray, other: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which pairs of places share none of the `keys`, which stand beside the place `owner` that has them."""
    key, at, many = np.unique(keys, return_inverse=True, return_counts=True)
    some = many[at] > 1
    number = np.cumsum(many > 1) - 1
    width = -(-int((many > 1).sum()) // 8)
    out = np.ones(len(one), bool)
    if not width:
        return out
    at, owner = number[at[some]], owner[some]
    bits = np.zeros((int(max(one.max(initial=0), other.max(initial=0), owner.max(initial=0))) + 1, width), np.uint8)
    np.bitwise_or.at(bits, (owner, at // 8), np.left_shift(1, at % 8).astype(np.uint8))
    step = max(1, (1 << 22) // width)
    for lo in range(0, len(one), step):
        out[lo : lo + step] = ~(bits[one[lo : lo + step]] & bits[other[lo : lo + step]]).any(axis=1)
    return out


def spanning(words: list[np.ndarray], kind: np.ndarray, one: np.ndarray, other: np.ndarray, share: float = SHARE) -> list[tuple[int, int]]:
    """Pairs of `one` and `other` that are linked, as many as it takes to join what they join; places of a kind are joined already."""

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    # a kind is named by its first place
    first: dict[int, int] = {}
    root = [first.setdefault(r, k) for k, r in enumerate(kind.tolist())]
    links, todo = [], list(zip(one.tolist(), other.tolist()))
    for lo in range(0, len(todo), 512):
        part = [(a, b) for a, b in todo[lo : lo + 512] if top(a) != top(b)]
        for (a, b), d in zip(part, edit_distances([(words[a], words[b]) for a, b in part], share)):
            if d >= 0 and top(a) != top(b):
                root[top(b)] = top(a)
                links.append((a, b))
    return links


def _rest(members: DataFrame, words: DataFrame, share: float, block: int) -> DataFrame:
    """Links `(a, b)` between nodes of different classes in a bucket, as many as it takes to join them.

    Pairs that word counts leave room for are noted beside their nodes and aligned where the nodes meet, in the least
    of the buckets they share: there is no row per pair.
    """

    @returns_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = [r.tobytes() for r in profiles(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["node", "counts"])

    nodes = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    counted = words.select("node", "words").join(members.select("node").distinct(), "node", "left_semi").mapInArrow(count, "node binary, counts binary")
    # long texts go in smaller blocks, so that the words of a block stay few
    blocks = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / (block * LONG))).cast("int").alias("_blocks"))
    dealt = members.join(blocks, "key").join(counted.join(nodes, "node"), "node").withColumn("side", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    before = F.filter("keys", lambda k: k < F.col("key"))
    entry = F.struct("node", F.col("n").cast("long").alias("n"), F.xxhash64("class").alias("kind"), "side", "counts", before.alias("keys"))
    pair_of_blocks = ["key", F.least("side", "_other").alias("_lo"), F.greatest("side", "_other").alias("_hi")]
    grouped = met.groupBy(*pair_of_blocks).agg(F.collect_list(entry).alias("m"))

    @returns_memory
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                node, n, kind, side, counts, keys = b.column(3)[k].values.flatten()
                n, kind, side = n.to_numpy(), kind.to_numpy(), side.to_numpy()
                one, other = near_enough(n, kind, side, _bytes(counts, BINS), share)
                if not len(one):
                    continue
                own = _owned(one, other, keys.flatten().to_numpy(), np.repeat(np.arange(len(n)), keys.value_lengths().to_numpy()))
                one, other = one[own], other[own]
                if not len(one):
                    continue
                # dealt by squares of places; in each the nodes that are left, with the numbers of those they meet
                edge = -(-len(n) // SQUARE)
                square = one // SQUARE * edge + other // SQUARE
                for at in np.unique(square):
                    x, y = one[square == at], other[square == at]
                    used = np.unique(np.concatenate([x, y]))
                    x, y = np.searchsorted(used, x), np.searchsorted(used, y)
                    starts = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(used)))]).astype(np.int32)
                    meets = pa.ListArray.from_arrays(pa.array(starts), pa.array(y[np.argsort(x, kind="stable")].astype(np.int32)))
                    same = [b.column(c).slice(k, 1).take(pa.array(np.zeros(len(used), np.int64))) for c in range(3)]
                    numbers = [pa.array(np.full(len(used), at, np.int32)), node.take(pa.array(used)), pa.array(kind[used]), pa.array(np.arange(len(used), dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays([*same, *numbers, meets], ["key", "_lo", "_hi", "_square", "node", "kind", "at", "meets"])

    def align(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        own = [np.frombuffer(v.as_buffer(), "<u4") for v in table["words"].combine_chunks()]
        meets = table["meets"].combine_chunks()
        one = np.repeat(np.arange(len(own)), meets.value_lengths().to_numpy())
        found = spanning(own, table["kind"].to_numpy(), one, meets.flatten().to_numpy(), share)
        node = table["node"].combine_chunks()
        return pa.table({"a": node.take(pa.array([a for a, _ in found], pa.int64())), "b": node.take(pa.array([b for _, b in found], pa.int64()))})

    listed = cut(grouped.mapInArrow(near, "key long, _lo int, _hi int, _square int, node binary, kind long, at int, meets array<int>"), "near")
    group = ["key", "_lo", "_hi", "_square"]
    # light in bytes and heavy in work: the number of tasks is fixed
    spark = members.sparkSession
    tasks = max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.join(words.select("node", "words"), "node").repartition(tasks, *group).groupBy(*group).applyInArrow(align, "a binary, b binary")


def near_copies(docs: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """`(doc_id, node, class, class_id)`: a row per document; a class is named by its least node and least id."""
    ship(docs.sparkSession)
    signed = cut(signatures(docs), "signatures")
    nodes = signed.filter("n_words > 0").groupBy("node").agg(F.min("n_words").alias("n"), F.min("keys").alias("keys"))
    entries = nodes.select("node", "n", F.explode("keys").alias("key"))
    # a bucket is known by its size and two sums over its members; of those that agree one is kept
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    buckets = entries.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size"), mark(1).alias("x"), mark(2).alias("y")).filter("size > 1")
    single = buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.min("least").alias("least"))
    members = cut(entries.join(single.select("key", "least"), "key"), "members")

    names = cut(members.select("node").distinct(), "names")
    hashes = cut(signed.join(names, "node", "left_semi").select("hash").distinct(), "hashes")
    words = cut(_word_rows(docs, hashes).join(names, "node", "left_semi"), "words")

    def fits(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.greatest(a, b) * (1 - share) + 1e-9

    sizes = members.select(F.col("node").alias("least"), F.col("n").alias("_ln")).distinct()
    stars = members.filter("node <> least").select("node", "least", "n").distinct().join(sizes, "least").filter(fits(F.col("n"), F.col("_ln")))
    stars = cut(stars.select(F.col("least").alias("a"), F.col("node").alias("b")), "stars")
    # a large group mostly falls together by a pair per node; the other pairs are aligned where it does not
    pairs = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut(_verified(pairs, words, share), "links")
    roots = cut(components(links), "classes")
    kind = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
    apart = stars.join(pairs, ["a", "b"], "left_anti").join(kind("a"), "a", "left").join(kind("b"), "b", "left")
    apart = apart.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    more = cut(_verified(apart, words, share), "links")
    if not more.isEmpty():
        links = links.union(more)
        roots = cut(components(links), "classes")
    classed = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("class"))
    mixed = classed.groupBy("key").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi")).filter(F.col("_lo") != F.col("_hi"))
    left = cut(classed.join(mixed.select("key"), "key", "left_semi"), "mixed")
    found = cut(_rest(left, words, share, block), "links")
    if not found.isEmpty():
        roots = cut(components(links.union(found)), "classes")
    rows = signed.select("doc_id", "node").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    named = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(named, "class").select("doc_id", "node", "class", "class_id")


def op8_near_copies(spark, folder: str) -> DataFrame:
    """The class of every document."""
    return near_copies(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "class_id")


def near_copy_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one of least id, then least text and values."""
    found = near_copies(docs)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("_kept"))
    kept = cut(first.select(F.coalesce(F.col("_kept.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("_kept.node").alias("_node")), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), _digest(F.col("text")).alias("_node"))
    chosen = rows.join(kept, ["_id", "_node"], "left_semi")
    # rows equal in id and text are one document
    one = chosen.groupBy("_id", "_node").agg(F.min("_doc").alias("_doc"))
    return one.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
