"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found by patterns in every text. The hash of each candidate's value is counted
over the corpus by distinct repositories and distinct owners (two grouping steps, the first of
which combines equal pairs before the shuffle). A value that several owners hold is a widely
copied example; one that few owners hold and that looks random is a live-looking credential.

Base spans (``assign``, ``access``, ``hex``) are always reported. The method adds the spans of
further kinds (provider tokens, JSON web tokens, private keys as whole PEM blocks) whose value is
live-looking. A private key's value is its body as written, so ownership is counted by key.

Defined cases: null text: empty, no spans; null owner: an owner of its own; null repository:
counts as one repository; equal rows each keep their row, and count as one repository; an empty
table gives no rows; columns of the input keep their values, whatever their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.components import written
from lectio.llm.running import running

# Kinds in order, pattern, number of the group that holds the value, and the
# fewest characters of it. Hex and access runs are maximal, so their bounds stand in the pattern.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 0),
    ("hex", r"[0-9a-f]{16,}", 0, 0),
]
MORE_KINDS = [
    ("provider", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-)[A-Za-z0-9_-]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    # Head, header lines, body (the value) and, if it is there, the END line. The body begins with 16
    # signs of base64: a head that is only spoken of holds no key. Line ends may be escaped or quoted.
    ("keyhead", r"""-----BEGIN [A-Z0-9 ]{0,200}PRIVATE KEY-----[\x20\x09-\x0D\\"',#*>|]*(?:[A-Za-z][A-Za-z-]*:[^\x0A\x0D\\]*[\x0A\x0D\\][\x20\x09-\x0D\\"',#*>|]*){0,200}(?:[nr][\x20\x09-\x0D\\"',#*>|]+){0,4}([A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\x20\x09-\x0D\\"',#*>|]*)(?:[^-]*(?:-{1,4}[^-]+){0,40}-----END [A-Z0-9 ]{0,200}PRIVATE KEY-----)?""", 1, 16),
]
KINDS = BASE_KINDS + MORE_KINDS
#: Held by so many owners, a value is an example.
EXAMPLE_OWNERS = 3
#: A live-looking value has so many distinct characters.
LIVE_SIGNS = 8
#: What stands in place of a live-looking secret.
MARK = "<SECRET>"

SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def spans_of(text: Column, kind: int) -> Column:
    """(start, end, kind, value) for the leftmost non-overlapping matches of one kind, in code
    points. The text between matches and the matches themselves give all places."""
    _, pattern, group, least = KINDS[kind]
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("whole"), values.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(x["whole"])
        return end, F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    spans = running(parts, F.lit(0).cast("bigint"), SPAN[len("array<"):-1], step)
    kept = F.filter(spans, lambda s: F.char_length(s["value"]) >= least) if least else spans
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All spans of all kinds, by start, then kind."""
    return F.array_sort(F.concat(*(spans_of(text, k) for k in range(len(KINDS)))))


def live_looking(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= LIVE_SIGNS


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) from rows (hash, repo, owner)."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    # A repository belongs to the owners that hold it; one held by two counts for each.
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(documents: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: array of (start, end, kind, value_hash, repositories, owners, live),
    by start then kind; base spans all, the method's own only if live. One row per input row.

    The texts are read once; the spans, without values, are written to the shared folder."""
    row = documents.select(
        F.struct(*(F.col(c) for c in keep)).alias("kept"),
        F.col(repo).cast("string").alias("repo"),
        F.col(owner).cast("string").alias("owner"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    row = row.select("kept", "repo", "owner", candidates(F.col("text")).alias("all"))
    row = row.select(
        F.monotonically_increasing_id().alias("row"), "kept", "repo", "owner",
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), live_looking(s["value"]).alias("random"))).alias("all"),
    )
    row = written(row, "secrets")
    single = row.filter("size(all) > 0").select("row", "repo", "owner", F.explode("all").alias("s")).select("row", "repo", "owner", "s.*")
    counts = ownership(single.select("hash", "repo", "owner"))
    judged = single.join(counts, "hash").withColumn("live", F.col("random") & (F.col("owners") < EXAMPLE_OWNERS))
    judged = judged.filter((F.col("kind") < len(BASE_KINDS)) | F.col("live"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "hash", "repositories", "owners", "live"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,hash:string,repositories:bigint,owners:bigint,live:boolean>>")
    plain = row.filter("size(all) = 0").select("kept.*", none.alias("spans"))
    rest = row.filter("size(all) > 0").join(spans, "row", "left").select("kept.*", F.coalesce("spans", none).alias("spans"))
    return plain.unionByName(rest)


def labelled(spans: Column) -> Column:
    """"kind:start:end" of spans by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """``documents`` with every live-looking span replaced by ``MARK``; overlapping spans are
    replaced as one. Only texts with a candidate are shuffled, to meet their spans."""
    spans_, cut_, hash_ = (next(x for x in (name + "_" * i for i in range(1, 99)) if x not in documents.columns) for name in ("spans", "cut", "hash"))
    rows = documents.withColumn(hash_, F.xxhash64(F.col(text)))
    found = scan_secrets(rows, text, repo, owner, keep=(repo, hash_))
    live = found.select(F.col(repo).alias(spans_), F.col(hash_).alias(cut_ + "h"), F.filter("spans", lambda s: s["live"]).alias(cut_)).filter(F.size(cut_) > 0).dropDuplicates([spans_, cut_ + "h"])
    gate = F.coalesce(reduce(lambda a, b: a | b, (F.col(text).rlike(k[1]) for k in KINDS)), F.lit(False))
    joined = rows.filter(gate).join(live, F.col(repo).eqNullSafe(F.col(spans_)) & (F.col(hash_) == F.col(cut_ + "h")), "left")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        before = F.substr(F.col(text), (at + 1).cast("int"), (x["start"] - at).cast("int"))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.concat(before, F.lit(MARK))).otherwise(F.lit(""))

    done = F.array_join(running(F.col(cut_), F.lit(0).cast("bigint"), "string", step), "")
    clean = F.concat(done, F.substr(F.col(text), (F.array_max(F.transform(cut_, lambda x: x["end"])) + 1).cast("int")))
    changed = joined.withColumn(text, F.when(F.col(cut_).isNull(), F.col(text)).otherwise(clean))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col(cut_).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(kind)))
    return documents.filter(~gate).unionByName(changed.select(*documents.columns))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, whole texts."""
    rows = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE_KINDS))),
        F.sha2(labelled(base).cast("binary"), 256).alias("base_sha256"),
        labelled(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["owners"] >= EXAMPLE_OWNERS)).cast("long").alias("n_examples"),
    )


def _oracle() -> str:
    """DuckDB text of the contract query: the same patterns, places by splitting, plain counts."""
    names = ", ".join(f"'{k[0]}'" for k in KINDS)
    found = " union all ".join(
        "select row, doc_id, source, {k} as kind, regexp_extract_all(text, '{re}', 0) as w, regexp_extract_all(text, '{re}', {g}) as v, "
        "string_split_regex(text, '{re}') as p from d where regexp_matches(text, '{re}')".format(k=k, re=pattern.replace("'", "''"), g=group)
        for k, (_, pattern, group, _) in enumerate(KINDS)
    )
    least = " ".join(f"when {k} then {n}" for k, (_, _, _, n) in enumerate(KINDS))
    counts = ",\n       ".join(f"count(*) filter (kind = {k}) as n_{name}" for k, (name, *_) in enumerate(BASE_KINDS))
    said = "[{}][kind + 1] || ':' || begin_at || ':' || (begin_at + n)".format(names)
    return f"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
m as ({found}),
s as (
  select row, doc_id, source, kind, v[i] as value, length(w[i]) as n,
         cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as bigint) as begin_at
  from m, unnest(range(1, len(w) + 1)) as t(i) where length(v[i]) >= case kind {least} end),
o as (select value, count(distinct source) + count(distinct case when source is null then 1 end) as owners from s group by value),
j as (
  select s.*, owners, owners < {EXAMPLE_OWNERS} and len(list_distinct(string_split(value, ''))) >= {LIVE_SIGNS} as live
  from s join o using (value)),
c as (
  select row, {counts},
       string_agg({said}, ',' order by begin_at, kind) filter (kind < {len(BASE_KINDS)}) as base,
       string_agg({said}, ',' order by begin_at, kind) filter (kind < {len(BASE_KINDS)} or live) as spans,
       count(*) filter (live) as n_live, count(*) filter (owners >= {EXAMPLE_OWNERS} and kind < {len(BASE_KINDS)}) as n_examples
  from j group by row)
select d.doc_id, {', '.join(f'coalesce(n_{k[0]}, 0) as n_{k[0]}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_examples, 0) as n_examples
from d left join c on c.row = d.row
"""


ORACLE = _oracle()
