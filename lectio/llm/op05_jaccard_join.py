"""N-gram Jaccard join by universe partition and pigeonhole.

A document is the set of its distinct five-word shingles. Two sets of sizes a <= b whose Jaccard
similarity reaches 80/100 differ in at most (a + b) / 9 shingles. Sizes fall into bands; the
shingle universe is cut, by hash range, into segments for each band. If more segments exist than
shingles can differ, one segment is equal in both sets: its content is indexed. A segment indexed
with its one-deletion neighbourhood tolerates one difference and so counts twice. How many
segments of either kind a band gets is allocated by cost: signatures a set, and the false
candidates expected from segments that stay empty, given the band's population. Spare segments
let sets skip empty segments: only the rare set that has too few non-empty ones indexes those too.

Work on Spark:

1. One pass over the texts makes sets and signatures in NumPy, combined inside a task (copies
   collapse to the hash of their set; a signature that repeats is sent once) and sent in packed
   blocks by signature range. A block task sorts its signatures and gives (signature, member,
   leader) rows for those with two sets or more.
2. Members are compared with their leaders by a parity sketch that never overestimates how much
   two sets differ; what it allows is verified exactly, and the links give components.
3. A signature whose members still lie in several components has its members compared across
   components, in tiles of bounded size, by their sketches; all that pass are verified exactly. Pairs inside a component need no check.

So no pairs of a group of copies are emitted, and no link between different components is lost.

Defined cases: null or blank text: no shingles, linked with nothing, its own component; fewer
words than five: the whole sequence is one shingle; equal rows: each keeps its row; a null
doc_id takes no part in links and has a null component; an empty table gives no rows; other
columns are ignored. Shingles are named by 53 bits of a hash."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectio.llm.components import components, written
from lectio.llm.words import U64, Tokens, mix, slices

WORDS = 5
PERCENT = 80
#: Texts are taken in slices of this many bytes and documents (the latter fits in 11 bits).
SLICE_BYTES, SLICE_DOCS = 2 << 20, 2000
#: Signatures a block task sorts at once, and members a tile of step 3 holds.
BLOCK_SIGNATURES, TILE = 1 << 20, 1024
#: Bits of the smallest and the largest sketch; between them a set has as many bits as shingles, or up to twice.
SKETCH_LEAST, SKETCH_MOST = 1024, 1 << 17
#: Pairs of one node that are verified together.
STAR = 256
#: Hash cells of document ids: the most rows that step 1's broadcast can have.
CELLS = 1 << 18
#: Ids that may be broadcast: 16 MB in memory.
FEW_IDS = 1 << 20


# ---- bands and allocation -----------------------------------------------------------------
def bands(percent: int = PERCENT, top: int = 1 << 31) -> list[tuple[int, int]]:
    """(smallest, largest) sizes: a set links only within its band and with its neighbours."""
    out, low = [], 1
    while low < top:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def differ(total: int, percent: int = PERCENT) -> int:
    """The most shingles in which two sets of ``total`` elements together can differ."""
    return total * (100 - percent) // (100 + percent)


def allocate(low: int, high: int, population: float, percent: int = PERCENT) -> tuple[int, int, int]:
    """(exact segments, one-deletion segments, budget to meet) of a band by least cost. The
    budget is one more than the differences that a pair whose smaller set is in the band can have."""
    budget = differ(high + high * 100 // percent, percent) + 1
    if budget == 1:
        return 0, 0, 1  # only equal sets, which share a hash already
    best = None
    for spare in range(0, budget // 2 + 8, 1 + budget // 64):
        total = budget + spare
        for exact, pairs in ((total, 0), (0, (total + 1) // 2)):
            segments = exact + pairs
            each = low / segments
            weak = math.exp(-each) * (1 if exact else 1 + each)
            room = (exact + 2 * pairs - budget) / (1 if exact else 2)
            mean = segments * weak
            lacking = 0.5 * math.erfc((room + 0.5 - mean) / math.sqrt(2 * max(mean, 1e-9)))
            cost = exact + pairs * (1 + high / segments) + lacking * lacking * population * segments * weak * 0.02 + lacking * 20
            if best is None or cost < best[0]:
                best = (cost, exact, pairs)
    return best[1], best[2], budget


# ---- sets ---------------------------------------------------------------------------------
_LOW53 = U64((1 << 53) - 1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, first, node): text i has the ascending distinct ``shingles[first[i]:first[i+1]]``
    and its set has the hash ``node[i]`` (0 for an empty set)."""
    tokens = Tokens(texts)
    n = len(texts)
    count = np.diff(tokens.first)
    h = tokens.hash
    k = U64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(n, dtype=np.uint64), count)
    made, owner = [], []
    with np.errstate(over="ignore"):
        if len(h) >= words:
            s = h[: len(h) - words + 1].copy()
            for j in range(1, words):
                s = s * k + h[j: len(h) - words + 1 + j]
            whole = doc[: len(s)] == doc[words - 1:]
            made.append(mix(s[whole], 1))
            owner.append(doc[: len(s)][whole])
        for size in range(1, words):
            few = np.flatnonzero(count == size)
            if len(few):
                at = tokens.first[few]
                s = h[at].copy()
                for j in range(1, size):
                    s = s * k + h[at + j]
                made.append(mix(s, 10 + size))
                owner.append(few.astype(np.uint64))
        if not made:
            return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n, np.uint64)
        key = (np.concatenate(owner) << U64(53)) | (np.concatenate(made) >> U64(11))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U64(53))
    shingles = key & _LOW53
    node = np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            node[full] = mix(np.add.reduceat(mix(shingles, 2), first[full]) + np.diff(first)[full].astype(np.uint64), 3)
    return shingles, first, node


def signatures(shingles: np.ndarray, first: np.ndarray, rows: np.ndarray, band: int, plan: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) for the sets ``rows`` in one band."""
    exact, pairs, budget = plan
    segments = exact + pairs
    size = np.diff(first)[rows]
    if not segments or not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    local = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(local)) - np.repeat(np.cumsum(size) - size, size) + first[rows][local]
    h = shingles[at]
    segment = np.minimum((h.astype(np.float64) * (segments / 2.0**53)).astype(np.int64), segments - 1)
    value = mix(h, 4)
    key = local * segments + segment
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = np.diff(np.append(begin, len(key)))
    with np.errstate(over="ignore"):
        content = np.add.reduceat(value, begin)
        cell = key[begin]
        name = lambda c: mix((c % segments).astype(np.uint64) * U64(64) + U64(band), 5)
        out, owner = [mix(content + name(cell), 6)], [cell // segments]
        if pairs:
            of = np.repeat(np.arange(len(begin)), held)
            more = held[of] >= 2
            out.append(mix((content[of] - value + name(cell[of]))[more], 6))
            owner.append(local[more])
        met = np.bincount(cell // segments, weights=np.where(held >= 1 + bool(pairs), 1 + bool(pairs), 0), minlength=len(rows))
        lacking = np.flatnonzero(met < budget)
        if len(lacking):  # these index their empty (or, less one shingle, empty) segments too
            strong = np.zeros(len(rows) * segments, bool) if len(rows) * segments < 1 << 24 else None
            if strong is not None:
                strong[cell[held >= 1 + bool(pairs)]] = True
                bare = np.flatnonzero(~strong.reshape(len(rows), segments)[lacking].ravel())
                cells = lacking[bare // segments] * segments + bare % segments
            else:
                full = set(cell[held >= 1 + bool(pairs)].tolist())
                cells = np.array([c for x in lacking.tolist() for c in range(x * segments, (x + 1) * segments) if c not in full], np.int64)
            out.append(mix(name(cells), 6))
            owner.append(cells // segments)
    return np.concatenate(out), rows[np.concatenate(owner)]


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """The bits of a set's sketch: a power of two, so that a wider one folds to a narrower."""
    exponent = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    return np.clip(np.left_shift(np.int64(1), exponent), SKETCH_LEAST, SKETCH_MOST)


def sketches(shingles: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity bits: those of two sets differ in no more places than the sets do."""
    out = []
    for a, b, bits in zip(first[:-1], first[1:], sketch_bits(np.diff(first)).tolist()):
        parity = np.bincount((shingles[a:b] % U64(bits)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(parity.astype(np.uint8)).tobytes())
    return out


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would have been drawn at a narrower width."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many places the sketches of each pair differ, at the narrower one's width."""
    out = np.zeros(len(x), np.int64)
    widths = np.array([(len(a), len(b)) for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    for wide in np.unique(widths, axis=0).tolist():
        rows = np.flatnonzero((widths == wide).all(axis=1))
        a, b = (np.frombuffer(b"".join(side[i] for i in rows), np.uint64).reshape(len(rows), -1) for side in (x, y))
        words = min(a.shape[1], b.shape[1])
        out[rows] = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(1)
    return out


# ---- Spark --------------------------------------------------------------------------------
BLOCKS = "part long, kind int, one binary, two binary, three binary, four binary"
MEMBERS = "kind int, one long, two long, three long, sketch binary"


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            for at in range(0, piece.num_rows, SLICE_DOCS):
                yield piece.slice(at, SLICE_DOCS)


def _signature_blocks(limits: list[tuple[int, int]], plans: list[tuple[int, int, int]], parts: int):
    lows = np.array([a for a, _ in limits])
    reach = np.array([b * 100 // PERCENT for _, b in limits])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = 0
        for piece in _slices(batches):
            shingles, first, node = shingle_sets(piece.column("text"))
            size = np.diff(first)
            ids = piece.column("doc_id")
            known = np.array(ids.is_valid())
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            drawn = b"".join(sketch for sketch, there in zip(sketches(shingles, first), known) if there)
            rows: list[tuple] = [(spread % parts, 0, doc[known].tobytes(), size[known].astype(np.int64).tobytes(), node[known].tobytes(), drawn)]
            some = np.flatnonzero((size > 0) & known)
            some = some[np.unique(node[some], return_index=True)[1]]
            band = np.searchsorted(lows, size[some], side="right") - 1
            sent, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for b in np.unique(np.concatenate([band, np.maximum(band - 1, 0)])).tolist():
                here = some[(band == b) | ((band == b + 1) & (size[some] <= reach[b]))]
                s, o = signatures(shingles, first, here, b, plans[b])
                sent.append(s)
                owner.append(o)
            sig = np.concatenate(sent) >> U64(8)
            who = node[np.concatenate(owner)]
            order = np.argsort(sig)
            sig, who = sig[order], who[order]
            fresh = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
            start = np.flatnonzero(fresh)
            if len(start) < len(sig):  # repeats inside the slice: sent once, the members told apart from it
                run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(sig))))
                twin = np.bincount(run)[run] > 1
                rows.append(((spread + 1) % parts, 2, sig[twin].tobytes(), who[twin].tobytes(), who[start][run][twin].tobytes(), b""))
                sig, who = sig[fresh], who[fresh]
            part = (sig.astype(np.float64) * (parts / 2.0**56)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                rows.append((int(part[a]), 1, sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes(), who[a:b].tobytes(), b"", b""))
            spread += 2
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])], ["part", "kind", "one", "two", "three", "four"])

    return make


def _unpack_signatures(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :7] = planes.T
    return out.reshape(-1).view("<u8")


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows (kind 0: id, size, node) and bucket rows (kind 1: signature, member, leader)."""
    def out(kind: int, *columns: np.ndarray, drawn: bytes = b"") -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([[0], np.cumsum(sketch_bits(columns[1].view(np.int64)) // 8)]).tolist() if drawn else []
        for at in range(0, len(columns[0]), 1 << 16):
            cut = [np.ascontiguousarray(c[at: at + (1 << 16)]).view(np.int64) for c in columns]
            n = len(cut[0])
            last = [drawn[ends[at + k]: ends[at + k + 1]] for k in range(n)] if drawn else [None] * n
            yield pa.record_batch([pa.array(np.full(n, kind, np.int32)), *map(pa.array, cut), pa.array(last, pa.binary())], ["kind", "one", "two", "three", "sketch"])

    signature, node = [], []
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        for i, kind in enumerate(kinds):
            one, two, three = (batch.column(c)[i].as_py() for c in ("one", "two", "three"))
            if kind == 1:
                signature.append(_unpack_signatures(one))
                node.append(np.frombuffer(two, np.uint64))
            else:
                yield from out(kind // 2, *(np.frombuffer(x, np.uint64) for x in (one, two, three)), drawn=batch.column("four")[i].as_py())
    if not signature:
        return
    sig, who = np.concatenate(signature), np.concatenate(node)
    signature.clear()
    node.clear()
    order = np.argsort(sig)
    ranked = sig[order]
    same = ranked[1:] == ranked[:-1]
    twin = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(ranked) else np.zeros(0, bool)
    sig, who = ranked[twin], who[order[twin]]
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    if len(sig):
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])])
        sig, who = sig[keep], who[keep]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        held = np.diff(np.append(start, len(sig)))
        several = np.repeat(held > 1, held)
        yield from out(1, sig[several], who[several], np.repeat(who[start], held)[several])


SETS = "cell long, salt int, own int, node long, shingles binary"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's set for every cell that it is compared in."""
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()])], ["cell", "salt", "own", "node", "shingles"])

    for piece in _slices(batches):
        shingles, first, node = shingle_sets(piece.column("text"))
        rows, held = [], 0
        for i in np.flatnonzero(node.view(np.int64) == piece.column("node").to_numpy(zero_copy_only=False)).tolist():
            data = shingles[first[i]: first[i + 1]].tobytes()
            for c in piece.column("cells")[i].as_py():
                rows.append((c["cell"], c["salt"], c["own"], int(node[i].view(np.int64)), data))
                held += len(data) + 64
                if held > SLICE_BYTES:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)


def _possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow a link."""
    for batch in batches:
        if batch.num_rows:
            total = batch.column("total").to_numpy()
            keep = apart(batch.column("x").to_pylist(), batch.column("y").to_pylist()) <= total * (100 - PERCENT) // (100 + PERCENT)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a cell come together, its own set first; the others are compared with it."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for cell, first, node, data in zip(*(batch.column(c) for c in ("cell", "own", "node", "shingles"))):
            mine = np.frombuffer(data.as_buffer(), np.uint64)
            if first.as_py():
                hub, own = cell.as_py(), mine.copy()
            elif cell.as_py() == hub:
                both = len(np.intersect1d(own, mine, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(mine) - both):
                    a.append(min(hub, node.as_py()))
                    b.append(max(hub, node.as_py()))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow; no linked pair is lost."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    near = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
    both = pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "x", "y")
    return both.mapInArrow(_possible, "a long, b long")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity, by exact intersection. Each pair is
    decided in the cell of its end with more pairs, where that end's set is kept while the others
    pass by, so each set is made once and sent once for each of its pairs. A cell of many pairs is
    cut into parts of ``STAR``, each with a copy of its own set."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    side = lambda c: ends.select(F.col("node").alias(c), F.col("degree").alias("degree_" + c))
    major = F.col("degree_a") >= F.col("degree_b")
    met = pairs.join(side("a"), "a").join(side("b"), "b").select(F.when(major, F.col("a")).otherwise(F.col("b")).alias("cell"), F.when(major, F.col("b")).otherwise(F.col("a")).alias("node"))
    met = written(met, "jaccard-cells")
    held = met.groupBy("cell").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    others = met.join(held, "cell").select("node", "cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), F.lit(0).alias("own"))
    own = held.select(F.col("cell").alias("node"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(1).alias("own"))
    cells = others.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("cell", "salt", "own")).alias("cells"))
    chosen = written(nodes.select("node", "doc_id").join(cells, "node"), "jaccard-chosen")
    # Texts that cannot be wanted leave before the shuffle: a broadcast of hash cells, of which
    # there are at most CELLS, then the exact join.
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    near = docs.join(F.broadcast(chosen.select(cell.alias("of")).distinct()), cell == F.col("of"), "left_semi")
    sets = near.join(chosen, "doc_id").select("text", "node", "cells").mapInArrow(_sets, SETS)
    return sets.repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("own"), "node").mapInArrow(_verified, "a long, b long")


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile in different components whose sketches allow a link."""
    for batch in batches:
        for i in range(batch.num_rows):
            nodes, comps, sizes, drawn, mine = (batch.column(c)[i].values for c in ("nodes", "comps", "sizes", "drawn", "mine"))
            nodes, comps, sizes, mine = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in (nodes, comps, sizes, mine))
            drawn = drawn.to_pylist()
            words = np.array([len(d) // 8 for d in drawn], np.int64)
            place = np.zeros(len(drawn), np.int64)  # of each member among those of its width
            tables = {}
            for w in np.unique(words).tolist():
                rows = np.flatnonzero(words == w)
                place[rows] = np.arange(len(rows))
                tables[w] = np.frombuffer(b"".join(drawn[k] for k in rows), np.uint64).reshape(len(rows), w)
            a, b = [], []
            for j in range(len(nodes)):
                if mine[j] == 2:  # of the tile's second side only
                    continue
                other = (comps != comps[j]) & ((nodes > nodes[j]) | (mine == 2))
                low, high = np.minimum(sizes, sizes[j]), np.maximum(sizes, sizes[j])
                other &= 100 * low >= PERCENT * high
                other = np.flatnonzero(other & (mine != 1) if mine[j] == 1 else other)
                if len(other):
                    off, mine_j = np.zeros(len(other), np.int64), tables[int(words[j])][place[j]]
                    for w in np.unique(words[other]).tolist():
                        those, least = words[other] == w, min(w, int(words[j]))
                        off[those] = np.bitwise_count(folded(tables[w][place[other[those]]], least) ^ folded(mine_j, least)).sum(1)
                    hit = other[off <= (low + high)[other] * (100 - PERCENT) // (100 + PERCENT)]
                    a += [nodes[j]] * len(hit)
                    b += nodes[hit].tolist()
            if a:
                a, b = np.array(a), np.array(b)
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = docs.filter("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long")
    return _classes(documents).select("doc_id", "n_shingles", "component_id").unionByName(nameless)


def _classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node (the hash of the set, 0 if it is empty) and comp (the
    smallest node of its class, null if it is empty) of each row with an id."""
    spark: SparkSession = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # Populations for the allocation, from byte lengths of all texts (about six bytes a word):
    # they steer cost only. A few dozen rows reach the driver.
    lows = F.lit([a for a, _ in bands()]).cast("array<long>")
    words = F.greatest(F.lit(1), (F.octet_length("text") / 6).cast("long"))
    census = docs.filter("text is not null").groupBy(F.size(F.filter(lows, lambda x: x <= words)).alias("band")).agg(F.count("*").alias("n"), F.sum(words).alias("words"), F.max(F.octet_length("text")).alias("longest")).collect()
    population = {r["band"] - 1: r["n"] for r in census}
    limits = bands(top=max((r["longest"] for r in census), default=0) // 2 + 2)  # a word and its space take two bytes
    plans = [allocate(a, b, population.get(k, 0) + population.get(k + 1, 0)) for k, (a, b) in enumerate(limits)]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, math.ceil(sum(r["words"] for r in census) * 0.7 / BLOCK_SIGNATURES))

    blocks = docs.mapInArrow(_signature_blocks(limits, plans, parts), BLOCKS)
    rows = written(blocks.repartition(parts, "part").mapInArrow(_members, MEMBERS), "jaccard-members")
    found = rows.filter("kind = 0").select(F.col("one").alias("doc_id"), F.col("two").alias("n"), F.col("three").alias("node"), "sketch")
    buckets = rows.filter("kind = 1").select(F.col("one").alias("sig"), F.col("two").alias("node"), F.col("three").alias("leader"))
    nodes = written(found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "jaccard-nodes")

    pairs = buckets.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = written(possible(pairs, nodes), "jaccard-pairs")
    links = written(verify(pairs, nodes, docs), "jaccard-links")
    classes = components(links)
    within = classes.select(F.col("vertex").alias("node"), F.col("component").alias("comp"))
    placed = buckets.select("sig", "node").join(within, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = written(placed, "jaccard-placed")
    open_sigs = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).filter("lo <> hi")
    tiled = (
        placed.join(open_sigs.select("sig", F.ceil(F.col("held") / TILE).cast("int").alias("tiles")), "sig")
        .dropDuplicates(["sig", "node"])
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")))
        .join(nodes.select("node", F.col("n").alias("size"), "sketch"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("lo", F.least("mine", "other").cast("int"))
        .withColumn("hi", F.greatest("mine", "other").cast("int"))
        .withColumn("side", F.when(F.col("lo") == F.col("hi"), 0).when(F.col("mine") == F.col("lo"), 1).otherwise(2))
        .groupBy("sig", "lo", "hi")
        .agg(F.collect_list(F.struct("node", "comp", "size", "sketch", "side")).alias("all"))
        .select(*(F.col(f"all.{a}").alias(b) for a, b in (("node", "nodes"), ("comp", "comps"), ("size", "sizes"), ("sketch", "drawn"), ("side", "mine"))))
    )
    more = written(tiled.mapInArrow(_across, "a long, b long").distinct(), "jaccard-across")
    if not more.isEmpty():
        again = written(verify(more, nodes, docs), "jaccard-links")
        classes = components(links.union(again))

    member = classes.select(F.col("vertex").alias("node"), F.col("component").alias("comp"))
    placed_docs = found.join(member, "node", "left").select("doc_id", "n", "node", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))
    smallest = placed_docs.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    return placed_docs.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), "node", "comp")


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``frame`` has them."""
    taken = {c.lower() for c in frame.columns}
    return [next(x for x in (name + "_" * i for i in range(99)) if x not in taken) for name in names]


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` less all but one of each class of near copies: a text with the smallest
    doc_id stays. Rows without id, and texts without words, stay; of equal rows one stays. Where
    different texts share an id, each is judged by its own class. Ids that go are broadcast if
    they are few (their number is checked), else joined."""
    classes = written(_classes(documents), "jaccard-classes")
    id_ = F.col("doc_id").cast("long")
    gone_, twice_, node_, text_ = unused(documents, "gone", "twice", "set_hash", "first_text")
    sets = classes.filter("n_shingles > 0").select("doc_id", "node", "comp").distinct()
    # A class is named by its smallest set, as one id can be in several; one set of its smallest id stays.
    kept = sets.groupBy(F.col("comp").alias("of")).agg(F.min(F.struct("doc_id", "node")).alias("first"))
    gone = sets.join(kept, F.col("comp") == F.col("of")).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("node") != F.col("first.node")))
    gone = written(gone.select(F.col("doc_id").alias(gone_), F.col("node").alias(node_)), "jaccard-gone")
    twice = written(classes.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias(twice_)), "jaccard-twice")

    def sized(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids

    once = gone.join(sized(twice), F.col(gone_) == F.col(twice_), "left_anti").select(gone_)
    out = documents.join(sized(once), id_ == F.col(gone_), "left_anti")
    if twice.isEmpty():
        return out
    again = sized(twice)
    shared = documents.join(again, id_ == F.col(twice_), "left_semi")
    schema = StructType([*documents.schema.fields, StructField(node_, LongType())])
    shared = shared.mapInArrow(_with_node(node_), schema)
    shared = shared.join(gone.withColumnRenamed(node_, node_ + "_of"), (id_ == F.col(gone_)) & (F.col(node_) == F.col(node_ + "_of")), "left_anti")
    # Equal rows, and texts of one set: the smallest text stays. Texts without words differ by themselves.
    first = shared.filter(F.col(node_) != 0).groupBy(id_.alias(twice_), F.col(node_).alias(gone_)).agg(F.min("text").alias(text_))
    full = shared.join(first, (id_ == F.col(twice_)) & (F.col(node_) == F.col(gone_)) & (F.col("text") == F.col(text_))).select(*shared.columns)
    shared = full.unionByName(shared.filter(F.col(node_) == 0)).dropDuplicates(["doc_id", "text"]).drop(node_)
    return out.join(again, id_ == F.col(twice_), "left_anti").unionByName(shared)


def _with_node(name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _slices(batches):
            _, _, node = shingle_sets(piece.column("text").cast(pa.string()))
            yield pa.record_batch([*piece.columns, pa.array(node.view(np.int64))], [*piece.schema.names, name])

    return run


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _slices(batches):
        _, first, _ = shingle_sets(piece.column("text"))
        nulls = pa.nulls(piece.num_rows, pa.int64())
        yield pa.record_batch([nulls, pa.array(np.diff(first).astype(np.int64)), nulls], ["doc_id", "n_shingles", "component_id"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, whole texts."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive t as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from t),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
r as (
  select distinct a, a as root from l
  union
  select l.b, r.root from r join l on l.a = r.a where r.root < l.b)
select t.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.root, t.doc_id) as component_id
from t left join n on n.doc_id = t.doc_id left join (select a, min(root) as root from r group by a) k on k.a = t.doc_id
"""
