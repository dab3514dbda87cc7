"""Query-log classification (C1-C10, F6, V3) as column expressions and small joins.

Every function takes a DataFrame of queries and returns it with columns added; nothing
is evaluated per row in Python. Regex patterns run on Spark's Java regex engine, the
same engine (and so the same semantics) as the reference service.

Dictionary containment (scope resolution) runs against the fixed-size dictionaries
inlined as literal arrays (the same work as a broadcast nested-loop join, without the
join): a per-row projection whose cost grows linearly with the number of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, java_split_ws, java_trim, lit_value, not_blank, null_if_empty, percent0
from ..functions.vector import dot, norm, unit
from ..sources.dictionaries import Dictionaries

# ---------------------------------------------------------------------------
# Patterns, thresholds and labels that must equal the reference's.
# ---------------------------------------------------------------------------

KEYWORD_PATTERNS = [
    "[\"'](.+?)[\"']",
    "(.+?)(?:라는|이라는)\\s*(?:단어|말|지명|이름|인물|사람|곳|장소)",
    "(.+?)(?:가|이)\\s*(?:나오는|나온|등장하는|언급된|포함된)",
    "(.+?)(?:을|를)\\s*(?:포함한|포함하는|담은|담고)",
    "(?i)(?:containing|with|mentions?)\\s+(?:the\\s+word\\s+)?[\"']?([\\w가-힣]+)[\"']?",
    "(?i)(?:the word|the name|the place)\\s+[\"']?([\\w가-힣]+)[\"']?",
]
KEYWORD_MAX_CHARS = 20
FALLBACK_MAX_WORDS = 3
FALLBACK_MIN_CHARS = 2
SHORT_WORD_MAX_CHARS = 6

KOREAN_SCOPE_PATTERN = "^(.+?)(?:에서|에|의|에서 나오는|에 있는|에 나오는)\\s+(.+)$"
ENGLISH_SCOPE_PATTERN = "(?i)^(?:in|from|in the|from the)\\s+(.+?)\\s+(?:about|on|concerning|regarding)?\\s*(.+)$"
KOREAN_OT_PATTERN = "(?i)구약(?:성경|성서)?"
KOREAN_NT_PATTERN = "(?i)신약(?:성경|성서)?"
ENGLISH_OT_PATTERN = "(?i)(?:old testament|OT)"
ENGLISH_NT_PATTERN = "(?i)(?:new testament|NT)"
MULTI_BOOK_SPLIT = "[,과와]|\\s+and\\s+|\\s*&\\s*"
# scope_match="phrase": the whole phrase up to a word-bounded connective, and word-bounded
# testament abbreviations (fixes the first-word capture and the 'nt'/'ot' inside names)
ENGLISH_SCOPE_PHRASE = ("(?i)^(?:in|from)\\s+(?:the\\s+)?(.+?)\\s+(?:about|on|concerning|regarding)\\b\\s*(.+)$")
ENGLISH_OT_PHRASE = "(?i)\\b(?:old testament|OT)\\b"
ENGLISH_NT_PHRASE = "(?i)\\b(?:new testament|NT)\\b"
TESTAMENT_LABELS = {("ko", 1): "구약 (Old Testament)", ("ko", 2): "신약 (New Testament)",
                    ("en", 1): "Old Testament", ("en", 2): "New Testament"}

REASON_EMPTY = "Empty query defaults to semantic"
REASON_SHORT = "Single short word (%d chars): using hybrid search"
REASON_KEYWORD = "Keyword intent detected (score: %.0f%% vs %.0f%%)"
REASON_SEMANTIC = "Semantic intent detected (score: %.0f%% vs %.0f%%)"
REASON_AMBIGUOUS = "Ambiguous intent (keyword: %.0f%%, semantic: %.0f%%): using hybrid"
ERROR_EMPTY_QUERY = "Query cannot be empty"


@dataclass(frozen=True)
class Thresholds:
    """Decision thresholds. Defaults are the reference service's; tests on the supplied
    near-random vectors use ``Thresholds.fixture()``."""
    keyword_floor: float = 0.45
    semantic_floor: float = 0.45
    intent_difference: float = 0.05
    scope_difference: float = 0.08

    @staticmethod
    def fixture() -> "Thresholds":
        return Thresholds(0.0, 0.0, 0.01, 0.01)


# ---------------------------------------------------------------------------
# F6 validation
# ---------------------------------------------------------------------------

def validate_queries(q: DataFrame, query_col: str = "query") -> DataFrame:
    """adds ``valid`` and ``error`` (null for valid rows)."""
    ok = not_blank(query_col)
    return q.withColumn("valid", ok).withColumn(
        "error", F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(ERROR_EMPTY_QUERY)))


# ---------------------------------------------------------------------------
# V3 prototype similarity
# ---------------------------------------------------------------------------

def prototype_centroids(protos: DataFrame) -> DataFrame:
    """Mean of the *unit* prototype vectors per (set, class): ``avg_i cos(q, p_i)`` equals
    ``q . centroid / |q|``, so one dot product per query replaces one per prototype.
    One grouped aggregate (ML ``Summarizer``, partial aggregation before the shuffle)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    u = protos.select("set", "class", array_to_vector(unit("embedding")).alias("u"))
    return (u.groupBy("set", "class").agg(Summarizer.mean(F.col("u")).alias("m"))
            .select("set", "class", vector_to_array("m").alias("centroid")))


MAX_CLASSES = 64
MAX_DICTIONARY_ROWS = 10_000


def centroid_literals(centroids: DataFrame) -> dict[str, list[float]]:
    """Bring the per-class centroids to the driver: one small vector per class (the
    size is bounded by classes x dim and checked), to be inlined as literals."""
    rows = centroids.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} prototype classes")
    return {r["class"]: [float(x) for x in r["centroid"]] for r in rows}


def with_class_similarity(q: DataFrame, centroids: DataFrame | dict, classes: dict[str, str],
                          vec_col: str = "qvec") -> DataFrame:
    """Adds one column per class: mean cosine of the query vector to that class's
    prototypes (0 for an empty class or a zero query vector): one dot product per class
    against the inlined centroid, a pure projection with no join or shuffle."""
    lit = centroids if isinstance(centroids, dict) else centroid_literals(centroids)
    q = q.select("*", norm(vec_col).alias("__qn"))
    qn = F.col("__qn")
    cols = []
    for out_col, cls in classes.items():
        c = lit.get(cls)
        if not c:
            cols.append(F.lit(0.0).alias(out_col))
            continue
        carr = lit_value([float(x) for x in c])
        sim = F.when((qn == 0) | F.col(vec_col).isNull() | (F.size(vec_col) != len(c)), F.lit(0.0)) \
            .otherwise(dot(vec_col, carr) / qn)
        cols.append(sim.alias(out_col))
    return q.select("*", *cols).drop("__qn")


# ---------------------------------------------------------------------------
# C2 / C3 keyword extraction
# ---------------------------------------------------------------------------

def extract_keyword(t: str | Column, stop_words: list[str]) -> Column:
    """C2 on an already trimmed query: the first pattern whose group 1, trimmed and
    stripped of trailing quotes/space, has 1..20 chars; else for <= 3 words the first
    word of >= 2 chars that is not a stop word (C3); else null."""
    t = col_(t)
    lt = F.lower(t)
    # exact necessary conditions (literal markers every match must contain), checked with
    # a cheap substring test before a pattern's backtracking regex runs
    guards = [
        t.contains('"') | t.contains("'"),
        t.contains("라는"),
        t.contains("나오는") | t.contains("나온") | t.contains("등장하는") | t.contains("언급된") | t.contains("포함된"),
        t.contains("포함한") | t.contains("포함하는") | t.contains("담은") | t.contains("담고"),
        lt.contains("containing") | lt.contains("with") | lt.contains("mention"),
        lt.contains("the word") | lt.contains("the name") | lt.contains("the place"),
    ]
    tries = []
    for p, guard in zip(KEYWORD_PATTERNS, guards):
        g = java_trim(F.regexp_replace(java_trim(F.regexp_extract(t, p, 1)), "[\"'\\s]+$", ""))
        tries.append(F.when(guard, F.when(t.rlike(p) & (F.length(g) >= 1) & (F.length(g) <= KEYWORD_MAX_CHARS), g)))
    words = java_split_ws(t)
    stops = lit_value(list(stop_words))
    cand = F.filter(words, lambda w: (F.length(w) >= FALLBACK_MIN_CHARS) & ~F.array_contains(stops, F.lower(w)))
    fallback = F.when(F.size(words) <= FALLBACK_MAX_WORDS, F.try_element_at(cand, F.lit(1)))
    return F.coalesce(*tries, fallback)


# ---------------------------------------------------------------------------
# C1 / C10 intent
# ---------------------------------------------------------------------------

def classify_intent(q: DataFrame, centroids: DataFrame | dict, stop_words: list[str],
                    th: Thresholds = Thresholds(), text_col: str = "search_query",
                    vec_col: str = "qvec") -> DataFrame:
    """Adds intent, extracted_keyword, intent_reason, kw_sim, sem_sim and the C10
    flags needs_keyword / needs_semantic."""
    q = with_class_similarity(q.withColumn("__t", java_trim(text_col)), centroids,
                              {"kw_sim": "KEYWORD", "sem_sim": "SEMANTIC"}, vec_col)
    t, kw, sem = F.col("__t"), F.col("kw_sim"), F.col("sem_sim")
    diff = kw - sem
    q = q.select("*",
                 (~not_blank(text_col)).alias("__blank"),
                 ((F.size(java_split_ws(t)) == 1) & (F.length(t) <= SHORT_WORD_MAX_CHARS)).alias("__short"),
                 ((kw > th.keyword_floor) & (diff > th.intent_difference)).alias("__kw"),
                 ((sem > th.semantic_floor) & (-diff > th.intent_difference)).alias("__sem"))
    blank, short, is_kw, is_sem = F.col("__blank"), F.col("__short"), F.col("__kw"), F.col("__sem")
    # C2 runs only where the intent needs a keyword (KEYWORD or ambiguous), as in the reference
    q = q.select("*", F.when(~blank & ~short & (is_kw | ~is_sem), extract_keyword(t, stop_words)).alias("__kwx"))
    intent = (F.when(blank, "SEMANTIC").when(short, "HYBRID").when(is_kw, "KEYWORD")
              .when(is_sem, "SEMANTIC").otherwise("HYBRID"))
    keyword = (F.when(blank, F.lit(None).cast("string")).when(short, t)
               .when(is_kw, F.col("__kwx")).when(is_sem, F.lit(None).cast("string"))
               .otherwise(F.col("__kwx")))
    pk, ps = percent0(kw * 100), percent0(sem * 100)
    reason = (F.when(blank, F.lit(REASON_EMPTY))
              .when(short, F.format_string(REASON_SHORT, F.length(t)))
              .when(is_kw, F.format_string(REASON_KEYWORD.replace("%.0f", "%s"), pk, ps))
              .when(is_sem, F.format_string(REASON_SEMANTIC.replace("%.0f", "%s"), ps, pk))
              .otherwise(F.format_string(REASON_AMBIGUOUS.replace("%.0f", "%s"), pk, ps)))
    keep = [c for c in q.columns if not c.startswith("__")]
    q = q.select(*keep, intent.alias("intent"), keyword.alias("extracted_keyword"), reason.alias("intent_reason"))
    return q.select("*", F.col("intent").isin("KEYWORD", "HYBRID").alias("needs_keyword"),
                    F.col("intent").isin("SEMANTIC", "HYBRID").alias("needs_semantic"))


# ---------------------------------------------------------------------------
# C5 scope split, C6 / C7 scope resolve, C4 gate
# ---------------------------------------------------------------------------

def split_scope(q: DataFrame, text_col: str = "trimmed", scope_match: str = "reference") -> DataFrame:
    """Adds ko_scope/ko_search and en_scope/en_search (null when the pattern does
    not match the whole trimmed query)."""
    t = F.col(text_col)
    cols = []
    en = ENGLISH_SCOPE_PHRASE if scope_match == "phrase" else ENGLISH_SCOPE_PATTERN
    for lang, p in (("ko", KOREAN_SCOPE_PATTERN), ("en", en)):
        hit = t.rlike(p)
        cols += [F.when(hit, java_trim(F.regexp_extract(t, p, 1))).alias(f"{lang}_scope"),
                 F.when(hit, java_trim(F.regexp_extract(t, p, 2))).alias(f"{lang}_search")]
    return q.select("*", *cols)


def _entries(df: DataFrame, literal: dict | None, value_col: str) -> list[tuple]:
    """Dictionary rows ``(lang, key, value)`` sorted by (lang, -len(key), key): the first
    hit in this order is the longest key, then the lexically smallest (deterministic
    where the reference iterates an unordered map)."""
    if literal is not None:
        rows = [(lang, k, v) for lang, d in literal.items() for k, v in d.items()]
    else:
        got = df.limit(MAX_DICTIONARY_ROWS + 1).collect()
        if len(got) > MAX_DICTIONARY_ROWS:
            raise ValueError("dictionary too large to inline")
        rows = [(r["lang"], r["key"], r[value_col]) for r in got]
    return sorted(rows, key=lambda r: (r[0], -len(r[1]), r[1]))


def _dict_array(rows: list[tuple]) -> Column:
    return lit_value([{"lang": lang, "key": k, "v": v} for lang, k, v in rows])


def _first_contained(phrase: Column, lang: Column, arr: Column) -> Column:
    """First dictionary entry of ``lang`` whose key occurs in ``lower(phrase)``."""
    lp = F.lower(phrase)
    return F.try_element_at(F.filter(arr, lambda d: (d["lang"] == lang) & lp.contains(F.lower(d["key"]))), F.lit(1))


def dictionary_columns(dicts: Dictionaries) -> tuple[Column, Column]:
    """The group and book-name dictionaries as literal arrays of structs (sorted so the
    first hit wins); fixed-size tables, checked when they come from a DataFrame."""
    groups = _dict_array(_entries(dicts.book_group, dicts.groups_by_lang, "codes"))
    names = _dict_array(_entries(dicts.book_name, dicts.names_by_lang, "code"))
    return groups, names


def resolve_scope(scope: Column, lang: Column, groups: Column, names: Column, scope_match: str = "reference") -> Column:
    """C6/C7 for one (scope phrase, language): in order testament, book group, several
    books (> 1 resolved part), one book. Returns a struct (scope_type, scope_books,
    scope_testament, scope_desc), or null when nothing matches. The fixed-size
    dictionaries are inlined, so this is a projection: no join, no shuffle."""
    is_ko = lang == "ko"
    en_ot, en_nt = ((ENGLISH_OT_PHRASE, ENGLISH_NT_PHRASE) if scope_match == "phrase"
                    else (ENGLISH_OT_PATTERN, ENGLISH_NT_PATTERN))
    ot = F.when(is_ko, scope.rlike(KOREAN_OT_PATTERN)).otherwise(scope.rlike(en_ot))
    nt = F.when(is_ko, scope.rlike(KOREAN_NT_PATTERN)).otherwise(scope.rlike(en_nt))
    g = _first_contained(scope, lang, groups)
    b = _first_contained(scope, lang, names)
    pieces = F.filter(F.transform(F.split(scope, MULTI_BOOK_SPLIT), lambda x: java_trim(x)), lambda x: F.length(x) > 0)
    codes = F.filter(F.transform(pieces, lambda x: _first_contained(x, lang, names)["v"]), lambda c: c.isNotNull())
    multi_ok = F.size(codes) > 1
    label = lambda lg, n: F.lit(TESTAMENT_LABELS[(lg, n)])
    t_desc = F.when(ot, F.when(is_ko, label("ko", 1)).otherwise(label("en", 1))) \
        .when(nt, F.when(is_ko, label("ko", 2)).otherwise(label("en", 2)))
    no_books = F.lit(None).cast("array<string>")
    stype = (F.when(ot | nt, "TESTAMENT").when(g.isNotNull(), "BOOK_GROUP")
             .when(multi_ok, "MULTIPLE_BOOKS").when(b.isNotNull(), "SINGLE_BOOK"))
    books = (F.when(ot | nt, no_books).when(g.isNotNull(), g["v"]).when(multi_ok, codes)
             .when(b.isNotNull(), F.array(b["v"])))
    testament = F.when(ot, 1).when(nt, 2).cast("int")
    desc = (F.when(ot | nt, t_desc).when(g.isNotNull(), g["key"]).when(multi_ok, F.array_join(codes, ", "))
            .when(b.isNotNull(), b["key"]))
    res = F.struct(stype.alias("scope_type"), books.alias("scope_books"), testament.alias("scope_testament"),
                   desc.alias("scope_desc"))
    return F.when(scope.isNotNull() & stype.isNotNull(), res)


def scope_skipped(th: Thresholds = Thresholds()) -> Column:
    """C4: no scope is looked for when the query is clearly nearer to the prototypes without one."""
    return (F.col("noctx_sim") > F.col("ctx_sim")) & (-(F.col("ctx_sim") - F.col("noctx_sim")) > th.scope_difference)


def detect_scope(q: DataFrame, centroids: DataFrame | dict, dicts: Dictionaries, th: Thresholds = Thresholds(),
                 query_col: str = "query", vec_col: str = "qvec", scope_match: str = "reference") -> DataFrame:
    """Adds trimmed, ctx_sim, noctx_sim, scope_type (NONE when no scope),
    scope_books, scope_testament, scope_desc, confidence, cleaned_query, search_query.
    The Korean form is tried first, then the English one; all per-row projections."""
    q = with_class_similarity(q.withColumn("trimmed", java_trim(query_col)), centroids,
                              {"ctx_sim": "CONTEXT", "noctx_sim": "NO_CONTEXT"}, vec_col)
    gate_off = scope_skipped(th) | ~not_blank(query_col)
    q = split_scope(q, scope_match=scope_match)
    groups, names = dictionary_columns(dicts)
    q = q.select("*", groups.alias("__groups"), names.alias("__names"), gate_off.alias("__off"))
    g, n = F.col("__groups"), F.col("__names")
    q = q.select("*", F.when(~F.col("__off"), resolve_scope(F.col("ko_scope"), F.lit("ko"), g, n, scope_match)).alias("__ko"),
                 F.when(~F.col("__off"), resolve_scope(F.col("en_scope"), F.lit("en"), g, n, scope_match)).alias("__en"))
    q = q.select("*", F.coalesce(F.col("__ko"), F.col("__en")).alias("__r"),
                 F.when(F.col("__ko").isNotNull(), F.col("ko_search"))
                  .when(F.col("__en").isNotNull(), F.col("en_search")).alias("__part"))
    has = F.col("__r").isNotNull()
    q = q.select("*", F.when(has, F.col("__part")).otherwise(F.col("trimmed")).alias("cleaned_query"))
    keep = [c for c in q.columns if not c.startswith("__") and c not in
            ("ko_scope", "ko_search", "en_scope", "en_search")]
    return q.select(
        *keep,
        F.coalesce(F.col("__r.scope_type"), F.lit("NONE")).alias("scope_type"),
        F.col("__r.scope_books").alias("scope_books"),
        F.col("__r.scope_testament").alias("scope_testament"),
        F.col("__r.scope_desc").alias("scope_desc"),
        F.when(has, F.col("ctx_sim")).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(not_blank("cleaned_query"), F.col("cleaned_query")).otherwise(F.col("trimmed")).alias("search_query"))


# ---------------------------------------------------------------------------
# C8 / C9 reference parsing (reader shortcut)
# ---------------------------------------------------------------------------

REFERENCE_PATTERN = ("(?i)^((?:\\d\\s*)?[a-zA-Z\\x{3131}-\\x{318E}\\x{AC00}-\\x{D7A3}]+"
                     "(?:\\s+[a-zA-Z\\x{3131}-\\x{318E}\\x{AC00}-\\x{D7A3}]+)*)\\s*(\\d+)(?:장|편)?"
                     "(?:\\s*[:\\.]\\s*(\\d+)절?|\\s*(\\d+)절)?$")


def parse_reference(q: DataFrame, dicts: Dictionaries, query_col: str = "query") -> DataFrame:
    """``John 3:16``, ``시편 23편``, ``요한복음 3장 16절`` -> book code, version,
    chapter, verse; ``route`` is READ when a known book parses, else SEARCH. A number too
    long for an int is no number: a chapter so long makes no reference."""
    t = java_trim(query_col)
    hit = t.rlike(REFERENCE_PATTERN)
    g = lambda i: F.regexp_extract(t, REFERENCE_PATTERN, i)
    name = F.lower(java_trim(g(1)))
    name = F.regexp_replace(F.regexp_replace(name, "^(\\d)\\s*", "$1 "), "\\s+", " ")
    name = java_trim(name)
    out = (q.withColumn("__hit", hit).withColumn("__name", F.when(hit, name))
           .withColumn("__name2", F.regexp_replace("__name", "\\s+", ""))
           .withColumn("ref_chapter", F.when(hit, g(2).try_cast("int")))
           .withColumn("ref_verse", F.when(hit, F.coalesce(null_if_empty(g(3)), null_if_empty(g(4))).try_cast("int"))))
    rb = dicts.ref_book
    a = rb.select(F.col("name").alias("__n1"), F.col("code").alias("__c1"), F.col("version").alias("__v1"))
    b = rb.select(F.col("name").alias("__n2"), F.col("code").alias("__c2"), F.col("version").alias("__v2"))
    out = out.join(a, F.col("__name") == F.col("__n1"), "left").join(b, F.col("__name2") == F.col("__n2"), "left")
    code = F.when(F.col("ref_chapter").isNotNull(), F.coalesce("__c1", "__c2"))
    return (out.withColumn("ref_book", code).withColumn("ref_version", F.when(code.isNotNull(), F.coalesce("__v1", "__v2")))
            .withColumn("ref_chapter", F.when(code.isNotNull(), F.col("ref_chapter")))
            .withColumn("ref_verse", F.when(code.isNotNull(), F.col("ref_verse")))
            .withColumn("route", F.when(code.isNotNull(), "READ").otherwise("SEARCH"))
            .drop("__hit", "__name", "__name2", "__n1", "__c1", "__v1", "__n2", "__c2", "__v2"))
