"""Exact n-gram Jaccard join by parity sketches.

A document's set is that of its word n-grams, as 64-bit hashes.  Documents with
one set are one node.  In a size band at most ``d`` elements can differ between
two linked sets.  Each set is XOR-ed into a sketch of parts of 64 bits; an
element changes one part (all of its bits, by its hash, so that parts of
different elements don't agree by chance), hence, by the pigeonhole principle,
of ``d + 1 + light + common`` parts at least ``1 + light + common`` of linked
sets are equal.  Sets are joined on (band, part, value).

Parts that collide by chance or stem from passages that many documents share
are left out: each set leaves out its ``light`` parts with the fewest elements and
then its ``common`` parts whose values most sets have.  Both orders depend on
the part alone, so among the parts that two linked sets have in common the last
in order has so many before it, in either set, that neither leaves it out.

Each set keeps ``more`` of these common parts, so linked sets have ``1 + more``
parts left in common.  Keys of a few sets are expanded into pairs and a pair
counts if it comes up so often; keys of many go another way (below), so a pair
that has one of them in common needn't be counted.

Candidates are compared by a bit sketch first (an element flips one bit, so the
Hamming distance bounds the difference from below) and by their texts then.

A key of many sets isn't expanded into pairs.  Its smallest member, the
pivot, meets all others first; most groups are one component then and done.  In
the others the outlines of members of different components are compared as
matrices, which send on only the pairs that are close: a group at a time, up to
a bounded size.  The members of all larger groups of a band are packed into
blocks of that size, once, however many keys they share; pairs of blocks are
compared, but not two of one and the same component.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.store import discard, materialize, n_partitions

#: Keys of so many sets at most are expanded into pairs, which count if they come up 1 + MORE times.
FEW, MORE = 8, 2
#: Groups of so many members at most are compared one by one; the members of larger ones in blocks of so many outlines.
GROUP, BLOCK = 128, 1024
#: Ids up to which the documents to verify are found by broadcast; more are found by a shuffle join.
BROADCAST_IDS = 100_000
#: Word hashes kept by each Python worker.
CACHE_WORDS = 150_000
U = np.uint64
#: The published SplitMix64 finalizer, and an odd multiplier.
MIX1, MIX2, ODD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX1
    h = (h ^ (h >> U(27))) * MIX2
    return h ^ (h >> U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 100:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; of a shorter text the whole sequence is one; of none there are none.

    A-Z are lower-cased; words are parted by space and the controls from tab to
    carriage return (which is what bytes.lower and bytes.split do).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], U)
    w = np.fromiter(map(_hashes.__getitem__, words), U, n)
    h = w[: n - width + 1].copy()
    for k in range(1, width):
        h = h * ODD + w[k : n - width + 1 + k]
    return np.unique(mix(h))


@dataclass(frozen=True)
class Similarity:
    """Linked: ``of * |intersection| >= least * |union|``."""

    least: int = 85
    of: int = 100

    def linked(self, a: int, b: int, common: int) -> bool:
        return self.of * common >= self.least * (a + b - common)

    def largest(self, n: int) -> int:
        """The largest size that can be linked with size n."""
        return self.of * n // self.least

    def apart(self, a: int, b: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return (a + b) * (self.of - self.least) // (self.of + self.least)

    def parts(self, d: int) -> tuple[int, int, int]:
        """(parts, light, common) where at most d elements differ."""
        spare = -(-3 * d // 20)
        return d + 1 + 2 * spare, spare, spare


@lru_cache(64)
def bands(sim: Similarity, upto: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(starts, [(parts, light, common, largest size that meets the band)]): a set meets those of its own band and of the next."""
    starts, rest, lo = [], [], 1
    while lo <= upto:
        hi = sim.largest(lo)  # the last size of the band
        most = sim.largest(hi)
        starts.append(lo)
        rest.append((*sim.parts(sim.apart(hi, most)), most))
        lo = hi + 1
    return np.array(starts), rest


def sketch(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, elements) of each part of a set's parity sketch: a part is the XOR of its elements' 64-bit hashes."""
    part = ((h >> U(8)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    elements = np.bincount(part, minlength=parts)
    words = np.zeros(parts, U)
    full = np.flatnonzero(elements)
    starts = np.cumsum(elements)[full] - elements[full]
    words[full] = np.bitwise_xor.reduceat(mix(h + ODD)[order], starts)
    return words, elements


def keys_of(h: np.ndarray, sim: Similarity) -> list[tuple[np.ndarray, int]]:
    """[(join keys, marks)]: for the set's own band and, as the larger partner, for the one below.

    Marks hold the band and how many keys may be left out as common in it.
    """
    n = len(h)
    starts, rest = bands(sim, 1 << max(10, int(n).bit_length()))
    own = int(np.searchsorted(starts, n, "right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0 or n > rest[band][3]:
            continue
        parts, light, common, _ = rest[band]
        words, elements = sketch(h, parts)
        keys = mix(words + ODD * np.arange(1, parts + 1, dtype=U))
        keys = keys[np.lexsort((keys, elements))[light:]]
        out.append((mix(keys ^ U((band + 1) * int(MIX1) & 0xFFFFFFFFFFFFFFFF)), band << 32 | common))
    return out


def outline(h: np.ndarray, sim: Similarity) -> bytes:
    """Wider sketch for comparing two sets: a power of two of bits, some sixteen for each element that may differ."""
    bits = 64
    while bits < 16 * sim.apart(len(h), sim.largest(len(h))):
        bits *= 2
    odd = (np.bincount((h >> U(20) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def outlines_apart(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer outline is folded to the shorter's width first, which keeps it a parity sketch."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _node(h: np.ndarray, seed: int) -> tuple[int, int]:
    data = h.tobytes()
    return xxhash.xxh3_64_intdigest(data, seed=seed) - (1 << 63), xxhash.xxh3_64_intdigest(data, seed=seed + 1000) - (1 << 63)


def _sets(docs: DataFrame, width: int, sim: Similarity, seed: int) -> DataFrame:
    """doc_id, t (the text's hash), n, node, check, outline: the size of each document's set, two hashes and the outline of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check, lines = [], [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), width)
                x, y = _node(h, seed)
                n.append(len(h))
                node.append(x)
                check.append(y)
                lines.append(outline(h, sim))
            made = [*(pa.array(v, pa.int64()) for v in (n, node, check)), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], names=["doc_id", "tx", "ty", "n", "node", "check", "outline"])

    out = docs.select("doc_id", "text", "t.tx", "t.ty").mapInArrow(run, "doc_id long, tx long, ty long, n long, node long, check long, outline binary")
    return out.select("doc_id", F.struct("tx", "ty").alias("t"), "n", "node", "check", "outline")


def _keyed(docs: DataFrame, width: int, sim: Similarity, seed: int) -> DataFrame:
    """key, node, marks: a row for each join key of each distinct set (repeats within a task are left out)."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("marks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            keys, nodes, size = [], [], 0
            for text in batch.column(1):
                h = shingles(text.as_py(), width)
                if not len(h):
                    continue
                x, _ = _node(h, seed)
                if x in met:
                    continue
                if len(met) >= 200_000:
                    met.clear()
                met.add(x)
                for k, marks in keys_of(h, sim):
                    keys.append(k)
                    nodes.append((x, marks, len(k)))
                    size += len(k)
                if size >= 200_000:
                    yield _batch(keys, nodes, schema)
                    keys, nodes, size = [], [], 0
            if keys:
                yield _batch(keys, nodes, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "key long, node long, marks long")


def _batch(keys: list[np.ndarray], nodes: list[tuple[int, int, int]], schema: pa.Schema) -> pa.RecordBatch:
    node, marks, times = zip(*nodes, strict=True)
    columns = np.repeat(np.array(node, np.int64), times), np.repeat(np.array(marks, np.int64), times)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, columns)], schema=schema)


def _packed_texts(docs: DataFrame) -> DataFrame:
    """t, z: texts' hashes and the texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(0)], pa.binary())], names=["tx", "ty", "z"])

    return docs.select("text", "t.tx", "t.ty").mapInArrow(run, "tx long, ty long, z binary").select(F.struct("tx", "ty").alias("t"), "z")


def _close(pairs: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """Of the pairs (a, b) those that sizes and outlines don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for x, y, i, j in zip(m, n, batch.column(4), batch.column(5), strict=True):
                lo, hi = (x, y) if x < y else (y, x)
                keep.append(sim.largest(lo) >= hi and outlines_apart(i.as_py(), j.as_py()) <= sim.apart(lo, hi))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, n, o: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("outline").alias(o))
    rows = pairs.join(side("a", "m", "o"), "a").join(side("b", "n", "q"), "b").select("a", "b", "m", "n", "o", "q")
    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, sim: Similarity) -> DataFrame:
    """Of the pairs (a, b) those whose sets are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}
        held = 0

        def of(node: int, z) -> np.ndarray:
            nonlocal held
            h = known.get(node)
            if h is None:
                h = shingles(unpress(z.as_py()).decode("utf-8", "surrogatepass"), width)
                if held > 2_000_000:
                    known.clear()
                    held = 0
                known[node] = h
                held += len(h)
            return h

        for batch in batches:
            out = []
            for a, b, za, zb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = of(a, za), of(b, zb)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if sim.linked(len(x), len(y), int((y[at] == x).sum())):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return rows.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _folded(lines: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(lines.reshape(len(lines), -1, words), axis=1)


def _close_pairs(one: tuple, two: tuple, sim: Similarity, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots that sizes and outlines don't rule out.  Each side: nodes, roots, sizes, outlines (a row each)."""
    (a, ra, na, x), (b, rb, nb, y) = one, two
    words = min(x.shape[1], y.shape[1])
    x, y = _folded(x, words), _folded(y, words)
    apart = np.zeros((len(a), len(b)), np.uint32)
    for k in range(words):
        apart += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    lo, hi = np.minimum(na[:, None], nb[None]), np.maximum(na[:, None], nb[None])
    close = (apart <= (lo + hi) * (sim.of - sim.least) // (sim.of + sim.least)) & (sim.of * lo >= sim.least * hi) & (ra[:, None] != rb[None])
    i, j = np.nonzero(np.triu(close, 1) if same else close)
    return np.minimum(a[i], b[j]), np.maximum(a[i], b[j])


def _side(nodes: list[int], roots: list[int], sizes: list[int], lines: list[bytes]) -> tuple:
    """Outlines of several widths are folded to the shortest."""
    words = min(map(len, lines)) // 8
    rows = np.stack([_folded(np.frombuffer(x, "<u8")[None], words)[0] for x in lines])
    return np.array(nodes, np.int64), np.array(roots, np.int64), np.array(sizes, np.int64), rows


def _group_pairs(groups: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """Close pairs (a, b) of different roots within each key.  ``groups``: key, node, root; at most GROUP rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found, count = None, [], [], 0

        def compared() -> list[tuple[np.ndarray, np.ndarray]]:
            _, node, root, size, lines = zip(*held, strict=True)
            side = _side(node, root, size, lines)
            return [_close_pairs(side, side, sim, True)]

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != key:
                    found += compared()
                    count += len(found[-1][0])
                    held = []
                    if count > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])
                        found, count = [], 0
                key = row[0]
                held.append(row)
        if held:
            found += compared()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    rows = groups.join(nodes.select("node", "n", "outline"), "node").select("key", "node", "root", "n", "outline")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long").distinct()


def _block_pairs(members: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """Close pairs (a, b) of different roots within a band.  ``members``: band, node, root.

    Members are laid in order of band and root and packed into blocks, and pairs
    of blocks are joined by band.
    """
    fields = [("band", pa.int64()), ("block", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("nodes", pa.binary()), ("roots", pa.binary()), ("sizes", pa.binary()), ("words", pa.int64()), ("outlines", pa.binary())]
    schema, ddl = pa.schema(fields), ", ".join(f"{k} {'binary' if t == pa.binary() else 'long'}" for k, t in fields)

    def block(part: int, number: int, rows: list[tuple]) -> pa.RecordBatch:
        band, node, root, size, lines = zip(*rows, strict=True)
        *packed, outlines = _side(node, root, size, lines)
        values = band[0], part << 32 | number, min(root), max(root), *(v.tobytes() for v in packed), outlines.shape[1], outlines.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) == BLOCK):
                    yield block(part, number, held)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield block(part, number, held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                one, two = ((*(np.frombuffer(row[c + t], np.int64) for c in ("nodes", "roots", "sizes")), np.frombuffer(row["outlines" + t], "<u8").reshape(-1, row["words" + t])) for t in ("", "_2"))
                a, b = _close_pairs(one, two, sim, row["block"] == row["block_2"])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = members.distinct().join(nodes.select("node", "n", "outline"), "node").select("band", "node", "root", "n", "outline")
    blocks = rows.repartitionByRange(n_partitions(members.sparkSession), "band", "root", "node").sortWithinPartitions("band", "root", "node").mapInArrow(pack, ddl)
    blocks = materialize(blocks, "blocks")
    other = blocks.select("band", *[F.col(k).alias(f"{k}_2") for k, _ in fields[1:]])
    pairs = blocks.join(other, "band").filter("block <= block_2 and not (lo = hi and lo = lo_2 and lo_2 = hi_2)")
    return pairs.mapInArrow(compare, "a long, b long").distinct()


def _texts_of(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, z: a packed text of each node of the pairs, found by the text's hash (128 bits) and not by an id."""
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(met.join(nodes, "node").select("t", "node"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        found = _packed_texts(rows.join(F.broadcast(wanted.select("t")), "t", "left_semi")).join(F.broadcast(wanted), "t")
    else:
        found = wanted.join(_packed_texts(rows), "t")
    return materialize(found.dropDuplicates(["node"]).select("node", "z"), "texts")


def _several(groups: DataFrame, value: str) -> DataFrame:
    """Rows of the keys under which more than one ``value`` stands."""
    key = Window.partitionBy("key")
    return groups.withColumn("_lo", F.min(value).over(key)).withColumn("_hi", F.max(value).over(key)).filter("_lo != _hi").drop("_lo", "_hi")


def _candidate_groups(rows: DataFrame, width: int, sim: Similarity, seed: int) -> DataFrame:
    """key, node, band, need, members: keys of several sets, without those that their sets leave out.

    ``need``: how many keys of the band a pair of linked sets has in common at least.
    """
    seen, key = Window.partitionBy("key").orderBy("node"), Window.partitionBy("key")
    # a set met by several tasks counts once
    once = _keyed(rows, width, sim, seed).withColumn("_last", F.lag("node").over(seen)).filter("_last is null or _last != node").drop("_last")
    shared = materialize(once.withColumn("sets", F.count("*").over(key)).filter("sets > 1"), "shared")
    band, common = F.shiftright("marks", 32), F.col("marks").bitwiseAND(0xFFFFFFFF)
    more = F.least(common, F.lit(MORE))
    order = Window.partitionBy("node", "marks").orderBy(F.desc("sets"), "key")
    kept = shared.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") > common - more).select("key", "node", band.alias("band"), (more + 1).alias("need"))
    groups = materialize(kept.withColumn("members", F.count("*").over(key)).filter("members > 1"), "groups")
    discard(shared)
    return groups


def _frequent_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) that have as many keys of a few sets in common as their band needs."""
    before = F.collect_list("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(-FEW, -1))
    rows = groups.filter(F.col("members") <= FEW).withColumn("before", before).withColumn("a", F.explode("before"))
    return rows.groupBy("a", F.col("node").alias("b"), "band").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b")


def ngram_components(docs: DataFrame, width: int = 5, sim: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (long), component_id: the smallest id reachable by links, itself included.

    One row for each input row; other columns are not read.  Null and empty
    texts have an empty set and are linked with nothing.  Rows of equal sets are
    linked with each other.  Rows that share an id are compared by their own
    texts; a component without any id has a null one.  Very long texts are taken
    whole; an empty table gives none.  Defaults: five words, a similarity of 0.8
    or more.
    """
    sim = sim or Similarity(80, 100)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(F.xxhash64(text).alias("tx"), F.xxhash64(F.lit("t"), text).alias("ty")).alias("t"))
    for seed in range(1, 100):
        sets = materialize(_sets(rows, width, sim, seed), "sets")
        one = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("t").alias("t"), F.first("n").alias("n"), F.first("outline").alias("outline"), F.min("check").alias("x"), F.max("check").alias("y"))
        nodes = materialize(one, "nodes")
        if nodes.filter("x != y").isEmpty():  # no two sets share a node
            break
    groups = _candidate_groups(rows, width, sim, seed)
    # keys of a few sets: pairs that come up often; keys of many: the pivot meets all others
    pivot = F.min("node").over(Window.partitionBy("key"))
    star = groups.filter(F.col("members") > FEW).select("key", "node", "band", pivot.alias("a")).filter("a != node")
    pairs = _frequent_pairs(groups).unionByName(star.select("a", F.col("node").alias("b"))).distinct()
    close = materialize(_close(pairs, nodes, sim), "close")
    links = materialize(_verified(close, _texts_of(close, nodes, rows), width, sim), "found")
    components = connected_components(links)
    left = star.drop("a").join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = materialize(_several(left, "root").withColumn("members", F.count("*").over(Window.partitionBy("key"))), "left")
    if not left.isEmpty():
        few = left.filter(F.col("members") <= GROUP).select("key", "node", "root")
        many = left.filter(F.col("members") > GROUP).select("band", "node", "root")
        pairs = _group_pairs(few, nodes, sim)
        if not many.isEmpty():
            pairs = pairs.unionByName(_block_pairs(many, nodes, sim)).distinct()
        close = materialize(pairs, "close")
        found = materialize(_verified(close, _texts_of(close, nodes, rows), width, sim), "found")
        components = connected_components(links.unionByName(found))
    named = nodes.join(components, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(smallest, "root").select("node", "component_id")
    full = sets.filter("n > 0").join(labels, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, width: int = 5, sim: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps the document with the smallest id.

    Rows that repeat that id stay too, if they do in the input.  Rows with a
    null id can't be named and all stay, near copies or not.
    """
    kept = ngram_components(docs, width, sim, id_col, text_col).filter("component_id = doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, docs[id_col] == kept["_kept"], "left").filter(kept["_kept"].isNotNull() | docs[id_col].isNull())
    return rows.select(*[docs[f"`{c}`"] for c in docs.columns])
