"""V2 exact k-NN (and J2, the query x corpus similarity theta join) over a grid of blocks.

Vectors of both sides are packed into numbered blocks of at most ``BLOCK_ROWS`` unit vectors.
A corpus block and a query block make a tile: one matrix product in a task, whose top-k per
query is all that leaves it. Blocks are dealt to the rows and columns of a grid, and an equality
join on the cell (i, j) lets every corpus block meet every query block once; a query side of
proven small bytes is broadcast, and the corpus then isn't shuffled at all. No vector passes
through Python on the driver and neither side has a size limit.

A task merges the tiles of a query block as they come and ships its top-k per query; these
meet in a tree: first by (query, branch of tasks), then by query, each level a partial and a final
``WindowGroupLimit``. So no task reads the candidates of all tasks for one query at once.

Widths are part of the join: vectors of different widths never meet. A vector index is a corpus
packed and written once (``sources.vectors.write_index``); a plain table is packed on the fly."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import unit
from ..session import scratch_path

BLOCK_ROWS = 2048                # vectors of a block
CELL_BYTES = 32 << 20            # bytes of one side's blocks in a grid cell
BROADCAST_BYTES = 32 << 20       # bytes of query blocks that are broadcast; beyond it, the grid
STATE_BYTES = 64 << 20           # bytes of top-k rows that a task holds before it ships them
SCORE_BYTES = 32 << 20           # bytes of one product of a tile
FAN = 64                         # corpus blocks whose candidates meet in a branch of the merge tree
SCORE_TIE_DIGITS = 12            # order by round(score, 12) desc, then ord asc

CAND_SCHEMA = "qid long, ord long, score double, branch int"
RULE_COLS = ["scope_type", "scope_books", "scope_testament"]
ATTRIBUTES = ["book_short", "testament"]


def pack(rows: DataFrame, id_col: str, vec_col: str, by: list[str] | None = None, carry: list[str] | None = None,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Numbered blocks of unit vectors: ``(*by, width, block, n, ids, units, *carry)``; ``units``
    holds the vectors one after the other, each ``carry`` column becomes an array. Rows without
    a vector (null or empty) are left out. A block's rows are neighbours in their input
    partition, so blocks never grow with the data and one shuffle makes them."""
    by, carry = by or [], carry or []
    at = F.monotonically_increasing_id()
    named = rows.select(*by, F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), *carry)
    named = named.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull()).withColumn("at", at)
    whole = named.select(*by, F.size("v").alias("width"), (F.col("at") / block_rows).cast("long").alias("block"),
                         F.struct("id", unit("v").alias("unit"), *carry).alias("r"))
    return (whole.groupBy(*by, "width", "block").agg(F.collect_list("r").alias("rows"))
            .select(*by, "width", "block", F.size("rows").alias("n"), F.col("rows.id").alias("ids"),
                    F.flatten(F.col("rows.unit")).alias("units"), *(F.col(f"rows.{c}").alias(c) for c in carry)))


def is_packed(corpus: DataFrame) -> bool:
    return {"width", "block", "ids", "units"} <= set(corpus.columns)


def _topk(qidx: np.ndarray, ords: np.ndarray, scores: np.ndarray, k: int):
    """Exact top-k per query by (round(score) desc, ord asc)."""
    order = np.lexsort((ords, -np.round(scores, SCORE_TIE_DIGITS), qidx))
    qs = qidx[order]
    starts = np.r_[0, np.flatnonzero(qs[1:] != qs[:-1]) + 1] if len(qs) else np.zeros(0, np.int64)
    rank = np.arange(len(qs)) - np.repeat(starts, np.diff(np.r_[starts, len(qs)]))
    keep = order[rank < k]
    return qidx[keep], ords[keep], scores[keep]


def _in_scope(books: list, testaments: list, rules: list) -> np.ndarray:
    """(corpus row, query) mask of F3: NONE passes, a testament or a list of books must match."""
    book = np.array([(b or "").lower() for b in books], object)
    side = np.array([-1 if t is None else t for t in testaments])
    out = np.ones((len(book), len(rules)), bool)
    for j, (kind, wanted, testament) in enumerate(rules):
        if kind == "TESTAMENT":
            out[:, j] = side == testament
        elif kind != "NONE":
            out[:, j] = np.isin(book, [w.lower() for w in wanted or []])
    return out


def _doubles(column, row: int) -> np.ndarray:
    """One row of a list<double> column, without a Python object for each number."""
    at = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(at[0], at[1] - at[0]).to_numpy(zero_copy_only=False)


def _tile_kernel(k: int | None, min_score: float, relevance: bool, scoped: bool):
    """Tiles to candidates. The state holds each query block's best rows, of bounded bytes."""
    def kernel(batches):
        import pyarrow as pa
        state: dict[int, tuple] = {}
        held = 0

        def ship():
            nonlocal held
            for qids, found, branch in state.values():
                q, o, s = (np.concatenate(x) for x in zip(*found))
                if k is not None:
                    q, o, s = _topk(q, o, s, k)
                for at in range(0, len(q), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.record_batch([pa.array(qids[q[part]]), pa.array(o[part]), pa.array(s[part]),
                                           pa.array(np.full(len(q[part]), branch, np.int32))], ["qid", "ord", "score", "branch"])
            state.clear()
            held = 0

        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                width, key = col["width"][row].as_py(), col["q_block"][row].as_py()
                ids, qids = _doubles(col["ids"], row), _doubles(col["q_ids"], row)
                corpus = _doubles(col["units"], row).reshape(-1, width)
                queries = _doubles(col["q_units"], row).reshape(-1, width)
                rules = list(zip(*(col["q_" + c][row].as_py() for c in RULE_COLS))) if scoped else None
                step = max(1, SCORE_BYTES // (8 * max(1, len(ids))))
                found = []
                for j in range(0, len(qids), step):
                    score = corpus @ queries[j:j + step].T
                    if relevance:
                        score = (1.0 + score) / 2.0
                    if scoped:
                        score = np.where(_in_scope(col["book_short"][row].as_py(), col["testament"][row].as_py(), rules[j:j + step]), score, -np.inf)
                    mask = score >= min_score
                    if k is not None and len(ids) > k:      # ties of the k-th are kept
                        rounded = np.round(score, SCORE_TIE_DIGITS)
                        mask &= rounded >= np.partition(rounded, len(ids) - k, axis=0)[len(ids) - k]
                    r, c = np.nonzero(mask)
                    found.append((c.astype(np.int64) + j, ids[r], score[r, c]))
                q, o, s = (np.concatenate(x) for x in zip(*found))
                if not len(q):
                    continue
                if (width, key) not in state:
                    state[width, key] = (qids, [], col["branch"][row].as_py())
                kept = state[width, key][1]
                kept.append((q, o, s))
                held += 24 * len(q)
                if k is not None and sum(len(x[0]) for x in kept) > 4 * k * len(qids):
                    before = sum(len(x[0]) for x in kept)
                    best = _topk(*(np.concatenate(x) for x in zip(*kept)), k)
                    kept[:] = [best]
                    held -= 24 * (before - len(best[0]))
                if held > STATE_BYTES or k is None:
                    yield from ship()
        yield from ship()
    return kernel


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def tiles(corpus: DataFrame, queries: DataFrame, by: list[str], wanted: int, broadcast_bytes: int = BROADCAST_BYTES,
          cell_bytes: int = CELL_BYTES) -> tuple[DataFrame, int]:
    """Every corpus block beside every query block of its width (and ``by`` columns), and the number
    of corpus blocks. ``wanted`` bounds the bytes of the query blocks; only sizes reach the driver."""
    keys = [*by, "width"]
    stored = corpus.agg(F.coalesce(F.sum(F.col("n") * F.col("width") * 8), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("blocks")).first()
    named = lambda q: q.select(*keys, *(F.col(c).alias(f"q_{c}") for c in q.columns if c not in (*keys, "n")))
    corpus = corpus.withColumn("branch", F.pmod(F.xxhash64("block"), F.lit(max(1, math.ceil(stored["blocks"] / FAN)))).cast("int"))
    if wanted <= broadcast_bytes:
        return corpus.join(F.broadcast(named(queries)), keys), stored["blocks"]
    down, across = (max(1, math.ceil(x / cell_bytes)) for x in (stored["bytes"], wanted))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = corpus.withColumn("i", place("block", down)).withColumn("j", every(across))
    right = named(_written(queries, "query-blocks")).withColumn("j", place("q_block", across)).withColumn("i", every(down))
    return left.join(right, [*keys, "i", "j"]), stored["blocks"]


def scored_pairs(corpus: DataFrame, queries: DataFrame, k: int | None, min_score: float,
                 id_col: str = "ord", vec_col: str = "embedding",
                 qid_col: str = "qid", qvec_col: str = "qvec", score_mode: str = "cosine",
                 prefilter: bool = False, block_rows: int = BLOCK_ROWS,
                 broadcast_bytes: int = BROADCAST_BYTES, cell_bytes: int = CELL_BYTES) -> tuple[DataFrame, int]:
    """``(qid, ord, score, branch)`` of every tile: each task's top-k per query (all pairs that
    pass ``min_score`` when ``k`` is None), and the number of corpus blocks.
    ``score_mode='relevance'`` scores ``(1 + cos) / 2`` instead of the raw cosine (thresholds then
    mean that). ``prefilter=True`` takes an ``allowed_version`` row per query and version and the
    scope rules (``RULE_COLS``) on the query side, ``version`` and ``ATTRIBUTES`` on the corpus
    side: blocks are of one version each and meet only the queries that allow it, the scope is
    masked in the kernel, both before the top-k cut."""
    if score_mode not in ("cosine", "relevance"):
        raise ValueError(score_mode)
    by = ["version"] if prefilter else []
    if not is_packed(corpus):
        corpus = _written(pack(corpus, id_col, vec_col, by, ATTRIBUTES if prefilter else [], block_rows), "corpus-blocks")
    corpus = corpus.select(*by, "width", "block", "n", "ids", "units", *(ATTRIBUTES if prefilter else []))
    if prefilter:
        queries = queries.withColumnRenamed("allowed_version", "version")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(qvec_col)), F.lit(0)).alias("width"),
                       *([F.collect_set("version").alias("versions")] if prefilter else [])).first()
    if prefilter:   # versions that nobody asks for aren't read: folders of the index are pruned
        corpus = corpus.filter(F.col("version").isin(size["versions"]))
    asked = pack(queries, qid_col, qvec_col, by, RULE_COLS if prefilter else [], block_rows)
    met, blocks = tiles(corpus, asked, by, size["n"] * (max(size["width"], 0) * 8 + 64), broadcast_bytes, cell_bytes)
    keep = ["width", "ids", "units", "branch", "q_block", "q_ids", "q_units"]
    if prefilter:
        # A block number is unique within a version only, and so is the state of a query block.
        met = met.withColumn("q_block", F.xxhash64("version", "q_block"))
        keep += ATTRIBUTES + [f"q_{c}" for c in RULE_COLS]
    return met.select(*keep).mapInArrow(_tile_kernel(k, min_score, score_mode == "relevance", prefilter), CAND_SCHEMA), blocks


def knn_candidates(corpus: DataFrame, queries: DataFrame, k: int = 50, min_score: float = 0.1,
                   id_col: str = "ord", fan: int = FAN, **kw) -> DataFrame:
    """Exact cosine top-k per query over the whole corpus.

    Returns ``(qid, ord, score, cand_rank)`` with ``cand_rank`` in 1..k, ordered by
    ``round(score, 12) desc, ord asc``; only ``score >= min_score`` survives."""
    found, blocks = scored_pairs(corpus, queries, k, min_score, id_col=id_col, **kw)
    order = [F.round("score", SCORE_TIE_DIGITS).desc(), F.col("ord").asc()]
    levels = [["qid", "branch"]] if blocks > fan else []
    for key in [*levels, ["qid"]]:
        found = found.withColumn("cand_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("int"))
        found = found.filter(F.col("cand_rank") <= k)
    out = found.select("qid", "ord", "score", "cand_rank")
    return out if id_col == "ord" else out.withColumnRenamed("ord", id_col)


def cosine_pairs(corpus: DataFrame, queries: DataFrame, min_score: float = 0.1, **kw) -> DataFrame:
    """Every (query, vector) pair with cosine >= min_score (no top-k cut): the same tiles
    without the cut; only the pairs that pass the theta condition leave a tile."""
    return scored_pairs(corpus, queries, None, min_score, **kw)[0].select("qid", "ord", "score")
