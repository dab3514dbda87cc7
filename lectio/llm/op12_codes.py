"""Vector code compression by ball k-means: one codebook for each of ``PARTS`` consecutive parts.

An entry and the vector parts assigned to it make a ball. From the pass before, the radius of each
ball is known (its farthest part, plus how far the entry has moved), so only entries nearer than
twice that radius are neighbours. Sorted by distance, the neighbours cut a ball into rings: a part
at distance d of its entry can only change to neighbours within 2d of the entry. Parts nearer than
half the way to the first neighbour (the stable core) need no comparison at all, the others compare
with the neighbours of their ring exactly. A ball whose entry and neighbours have not moved is
left as it is. All comparisons are of whole numbers, so the codes are those of plain k-means.

A pass reads the vectors once, as blocks of bounded size, and writes them with their new codes to
the shared folder, beside one row of sums, counts and radius for each entry that a task met. The
sums of all tasks are added by Spark; only the codebooks (``ENTRIES`` rows a part) reach the driver.

Defined cases: null vectors and ones with null or non-finite components are dropped. The width is
that of the smallest kept vec_id (of its least vector, if that id repeats); vectors of other widths,
or with a component of 2^90 or more, and all vectors if the width is no multiple of ``PARTS`` (0
included), keep their row with null code and error. Fewer than ``ENTRIES`` distinct vec_ids start a
smaller codebook; a null vec_id starts no entry, but is coded. Repeated rows each count. Errors beyond
a long are the largest long. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.components import written

# Scale of the components, parts, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Components from here on are not coded; to this size, distances fit 64 bits.
MOST, SMALL = 2.0**90, 1 << 24
#: Rows of a block, and pairs (part, entry) that are compared at once.
ROWS, PAIRS = 2048, 1 << 19
LONG = 2**63 - 1

#: The codebooks: (entry, component) whole numbers of each part.
Books = list[np.ndarray]


def _floors(values: list[float]) -> np.ndarray:
    """floor(SCALE * x) as whole numbers of any size."""
    x = np.floor(np.asarray(values, np.float64) * SCALE)
    return x.astype(np.int64) if not len(x) or np.abs(x).max() < 2**62 else np.array([int(v) for v in x], object)


def _whole(values: pa.Array) -> Iterator[tuple[bool, bool, np.ndarray]]:
    """(kept, codable, floors) of each vector of an array."""
    flat = values.flatten().cast(pa.float64())
    holes = np.asarray(flat.is_null())
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    size = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)])
    valid = np.asarray(values.is_valid())
    bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(x))])
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(x * SCALE)
    for i in range(len(values)):
        at = slice(first[i], first[i + 1])
        kept = bool(valid[i]) and bad[first[i]] == bad[first[i + 1]]
        most = np.abs(scaled[at]).max(initial=0) if kept else 0
        if not kept or most >= MOST:
            yield kept, False, np.zeros(0, np.int64)
        elif most < 2**62:
            yield True, True, scaled[at].astype(np.int64)
        else:
            yield True, True, np.array([int(v) for v in scaled[at]], object)


def _packed(x: np.ndarray) -> bytes:
    """Rows of whole numbers as bytes: 64-bit, or decimal text where they are larger."""
    return b"i" + x.astype("<i8").tobytes() if x.dtype != object else b"t" + ",".join(str(v) for v in x.ravel()).encode()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, "<i8", offset=1) if raw[:1] == b"i" else np.array([int(v) for v in raw[1:].split(b",")], object)
    return x.reshape(-1, width)


def _stacked(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    return x if x.dtype != object or any(abs(int(v)) >= 2**62 for v in x.ravel()) else x.astype(np.int64)


def _squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def _exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if no distance can leave them, else as numbers of any size."""
    width = max(1, x.shape[1])
    least = SMALL if width <= 1 << 12 else 0
    if x.dtype != object and book.dtype != object and max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < least:
        return x, book
    return x.astype(object), book.astype(object)


class Balls:
    """Entries of one part, with each one's neighbours from near to far, in their new places."""

    def __init__(self, book: np.ndarray, moved: np.ndarray, radius: np.ndarray):
        self.book, n = book, len(book)
        # A distance in doubles is off by far less than the slack; neighbours may be too many, never too few.
        wide, _ = _exact(book, book)
        self.apart = _squares(wide[:, None, :] - wide[None, :, :])
        self.order = np.zeros((n, n), np.int64)
        for i in range(n):
            self.order[i] = np.array(sorted(range(n), key=lambda j: (j != i, self.apart[i, j], j)), np.int64)
        distance = np.sqrt(np.array(self.apart, np.float64))
        self.reach = (distance <= 2 * radius[:, None] * (1 + 1e-9) + 1e-9).sum(axis=1)
        self.still = np.array([not moved[i] and not moved[self.order[i, : self.reach[i]]].any() for i in range(n)], bool)


def assign(x: np.ndarray, home: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, pairs compared) of each row of ``x``, a part whose entry was
    ``home``: the nearest entry, of equals the lowest."""
    x, book = _exact(x, balls.book)
    own = _squares(x - book[home])
    entry, best, compared = home.copy(), own.copy(), 0
    # Rings: the neighbours within twice the part's distance of its entry, its entry being the first.
    ring = np.ones(len(x), np.int64)
    for i in np.unique(home[~balls.still[home]]).tolist():
        mine = np.flatnonzero(home == i)
        near = balls.apart[i][balls.order[i, : max(1, balls.reach[i])]]
        ring[mine] = np.maximum(1, np.searchsorted(near[1:], 4 * own[mine], side="right") + 1)
    rows = np.flatnonzero(ring > 1)
    ends = np.cumsum(ring[rows])
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, PAIRS), side="left")
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        some = rows[a:b]
        if not len(some):
            continue
        count = ring[some]
        first = np.cumsum(count) - count
        of = np.repeat(np.arange(len(some)), count)
        candidate = balls.order[home[some][of], np.arange(len(of)) - first[of]]
        distance = _squares(x[some][of] - book[candidate])
        low = np.minimum.reduceat(distance, first)
        entry[some] = np.minimum.reduceat(np.where(distance == low[of], candidate, len(book)), first)
        best[some] = low
        compared += len(of)
    return entry, best, compared


# A row is a block of coded vectors (kind 0), an entry's statistics of a task (kind 1), or a vector without code (kind 2).
PASS = "kind int, ids binary, labels binary, x binary, codes binary, errors array<decimal(38,0)>, part int, entry int, n long, sums array<decimal(38,0)>, far double, compared long"
_SUMS = pa.list_(pa.decimal128(38, 0))


def _read(width: int):
    """Vectors into blocks. Ids and labels travel as Arrow columns in bytes, nulls included."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, floors, plain = [], [], []
                for i, (kept, codable, x) in enumerate(_whole(part.column("embedding"))):
                    if kept and codable and len(x) == width and width and width % PARTS == 0:
                        rows.append(i)
                        floors.append(x)
                    elif kept:
                        plain.append(i)
                for kind, chosen in ((0, rows), (2, plain)):
                    if chosen:
                        took = part.select(["vec_id", "label"]).take(pa.array(chosen))
                        yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([_column(took.column(0))]), pa.array([_column(took.column(1))]), pa.array([_packed(_stacked(floors)) if kind == 0 else None], pa.binary())], ["kind", "ids", "labels", "x"])

    return read


def _column(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([values], ["v"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _restored(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_next_batch().column(0)


def _pass(width: int, books: Books, balls: list[Balls], last: bool):
    """Assigns every part anew. The last pass gives errors, the others statistics."""
    size = width // PARTS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, len(books[0])), np.int64)
        far = np.zeros((PARTS, len(books[0])))
        sums = [np.zeros(b.shape, object) for b in books]
        total = 0
        for batch in batches:
            for row in range(batch.num_rows):
                raw, old = batch.column("x")[row].as_py(), batch.column("codes")[row].as_py()
                x = _unpacked(raw, width)
                home = np.frombuffer(old, np.uint8).reshape(-1, PARTS) if old is not None else np.zeros((len(x), PARTS), np.uint8)
                codes = np.empty((len(x), PARTS), np.uint8)
                errors = np.zeros(len(x), object)
                for p in range(PARTS):
                    mine = x[:, p * size: (p + 1) * size]
                    entry, best, compared = assign(mine, home[:, p].astype(np.int64), balls[p])
                    codes[:, p] = entry
                    total += compared
                    if last:
                        errors = errors + best.astype(object)
                        continue
                    n[p] += np.bincount(entry, minlength=len(books[p]))
                    np.maximum.at(far[p], entry, best.astype(np.float64))
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    sums[p][used] += np.add.reduceat(mine[order], first, axis=0).astype(object)
                yield pa.record_batch([
                    pa.array([0], pa.int32()), batch.column("ids").slice(row, 1), batch.column("labels").slice(row, 1),
                    pa.array([None if last else raw], pa.binary()), pa.array([codes.tobytes()]), pa.array([[int(e) for e in errors] if last else None], _SUMS),
                    *_blank(1)], _NAMES)
        met = [(p, e) for p in range(PARTS) for e in np.flatnonzero(n[p]).tolist()]
        # A task without entries (the last pass) still tells what it compared.
        for a in range(0, max(1, len(met)), 256):
            some = met[a: a + 256] or [(0, 0)]
            yield pa.record_batch([
                pa.array([1] * len(some), pa.int32()), *(pa.nulls(len(some), pa.binary()) for _ in range(4)), pa.nulls(len(some), _SUMS),
                pa.array([p for p, _ in some], pa.int32()), pa.array([e for _, e in some], pa.int32()), pa.array([int(n[p][e]) for p, e in some], pa.int64()),
                pa.array([[int(v) for v in sums[p][e]] for p, e in some], _SUMS), pa.array([float(far[p][e]) for p, e in some]),
                pa.array([total if not a and not k else 0 for k in range(len(some))], pa.int64())], _NAMES)

    return run


_NAMES = ["kind", "ids", "labels", "x", "codes", "errors", "part", "entry", "n", "sums", "far", "compared"]


def _blank(n: int) -> list[pa.Array]:
    return [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), _SUMS, pa.float64(), pa.int64())]


def _unblocked(id_type: str, label_type: str):
    """Blocks back to rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (_restored(batch.column(c)[row].as_py()) for c in ("ids", "labels"))
                raw = batch.column("codes")[row].as_py()
                if raw is None:
                    code, error = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
                else:
                    text = raw.hex()
                    code = pa.array([text[i: i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string())
                    error = pa.array([min(int(e), LONG) for e in batch.column("errors")[row].as_py()], pa.int64())
                yield pa.record_batch([ids, labels, code, error], ["vec_id", "label", "code", "error"])

    return run, f"vec_id {id_type}, label {label_type}, code string, error long"


def _seeds(vectors: DataFrame) -> tuple[int, Books]:
    """The width, and the parts of the vectors of the ``ENTRIES`` smallest vec_ids."""
    kept = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.filter("vec_id is not null").filter(kept).groupBy("vec_id").agg(F.min("embedding").alias("e")).orderBy("vec_id")
    first = rows.limit(1).collect()
    width = len(first[0]["e"]) if first else 0
    if not width or width % PARTS:
        return width, []
    small = F.forall("e", lambda x: F.abs(x) * SCALE < MOST)
    chosen = [r["e"] for r in rows.filter(F.size("e") == width).filter(small).limit(ENTRIES).collect()]
    size = width // PARTS
    whole = [_floors(e) for e in chosen]
    return width, [_stacked([w[p * size: (p + 1) * size] for w in whole]) for p in range(PARTS)] if whole else []


def _moved(books: Books, statistics: list, size: int) -> tuple[Books, list[np.ndarray], list[np.ndarray]]:
    """New entries, whether each moved, and an upper bound of each ball's radius about its new place."""
    fresh = [b.astype(object) for b in books]
    far = [np.zeros(len(b)) for b in books]
    for r in statistics:
        if r["n"]:
            fresh[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
            far[r["part"]][r["entry"]] = r["far"]
    moved = [(f != b).any(axis=1) for f, b in zip(fresh, books)]
    radius = [np.sqrt(v) * (1 + 1e-12) + np.sqrt(np.array(_squares(f - b.astype(object)), np.float64)) for f, b, v in zip(fresh, books, far)]
    return [_stacked(list(f)) for f in fresh], moved, radius


def vector_codes(embeddings: DataFrame) -> tuple[DataFrame, Books, list[int]]:
    """(vec_id, label, code, error) for every kept vector, the final codebooks, and how many pairs
    of a part and an entry each pass compared."""
    vectors = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    width, books = _seeds(vectors)
    usable = width if books else 0
    state = written(vectors.mapInArrow(_read(usable), "kind int, ids binary, labels binary, x binary"), "codes-vectors")
    plain = state.filter("kind = 2").select("ids", "labels", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<decimal(38,0)>").alias("errors"))
    run, schema = _unblocked(types["vec_id"], types["label"])
    if not books:
        return plain.mapInArrow(run, schema), books, []
    blocks = state.filter("kind = 0").select("ids", "labels", "x", F.lit(None).cast("binary").alias("codes"))
    moved, radius = [np.ones(len(b), bool) for b in books], [np.full(len(b), np.inf) for b in books]
    compared = []
    for k in range(ROUNDS + 1):
        balls = [Balls(b, m, r) for b, m, r in zip(books, moved, radius)]
        state = written(blocks.mapInArrow(_pass(width, books, balls, k == ROUNDS), PASS), "codes-pass")
        told = state.filter("kind = 1")
        compared.append(told.agg(F.sum("compared")).first()[0] or 0)
        blocks = state.filter("kind = 0").select("ids", "labels", "x", "codes")
        if k < ROUNDS:
            sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width // PARTS)))
            statistics = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums"), F.max("far").alias("far")).collect()
            books, moved, radius = _moved(books, statistics, width // PARTS)
    coded = state.filter("kind = 0").select("ids", "labels", "codes", "errors")
    return coded.unionByName(plain).mapInArrow(run, schema), books, compared


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all embeddings."""
    coded, books, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = written(coded, "codes")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("all"))
    total = total.select("of", F.least("all", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain k-means in SQL: every part against every entry."""
    steps, book = [], "b0"
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} as materialized (
  select row, p, arg_min(e, (d, e)) as e, min(d) as d from (
    select x.row, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from x join {book} b on b.p = x.p) group by row, p)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} as (
  select p, e, i, sum(v) as s, count(*) as n from (
    select a.p, a.e, unnest(x.v) as v, unnest(range(len(x.v))) as i from a{k} a join x on x.row = a.row and x.p = a.p) group by p, e, i),
b{k + 1} as materialized (
  select o.p, o.e, coalesce(m.v, o.v) as v from {book} o left join (
    select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{k} group by p, e) m on m.p = o.p and m.e = o.e)""")
            book = f"b{k + 1}"
    return f"""
with kept as materialized (
  select row_number() over () as row, vec_id, label, list_transform(embedding, lambda y: cast(floor(256 * cast(y as double)) as bigint)) as f from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
x as materialized (select row, p, f[p * len(f) // {PARTS} + 1:(p + 1) * len(f) // {PARTS}] as v from kept, unnest(range({PARTS})) as t(p)),
seed as (select row, row_number() over (order by vec_id) - 1 as e from kept qualify e < {ENTRIES}),
b0 as materialized (select x.p, seed.e, x.v from seed join x on x.row = seed.row),{','.join(steps)},
code as (select row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by row),
sha as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as h from {book})
select k.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, sha.h as codebooks_sha256
from kept k join code c on c.row = k.row, sha
"""


ORACLE = _oracle()
