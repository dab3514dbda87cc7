"""DuckDB oracle SQL for the registered queries.

Each text runs on the raw tables (pre-registered views ``documents``, ``embeddings``,
``benchmark``, ``conversations`` ...) and re-derives the fixture views itself. Regexes are
rewritten for RE2 where Java and RE2 differ: ``\\s`` (Java includes \\x0B) and ``.``
(Java also stops at \\r, U+0085, U+2028, U+2029)."""

from __future__ import annotations

from lectio.sources.dictionaries import REF_PROTOTYPES

WS = r"[ \t\n\x0B\f\r]"
DOT = r"[^\n\r\x{85}\x{2028}\x{2029}]"
JWS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"

STOPS = ["the", "a", "an", "is", "are", "was", "were", "be", "been",
         "find", "search", "show", "get", "verses", "verse", "passages",
         "containing", "with", "about", "for", "in", "on", "at",
         "를", "을", "이", "가", "에", "의", "와", "과", "로", "으로",
         "구절", "말씀", "성경", "찾아", "줘", "주세요"]

KW_PATTERNS = [
    f"[\"']({DOT}+?)[\"']",
    f"({DOT}+?)(?:라는|이라는){WS}*(?:단어|말|지명|이름|인물|사람|곳|장소)",
    f"({DOT}+?)(?:가|이){WS}*(?:나오는|나온|등장하는|언급된|포함된)",
    f"({DOT}+?)(?:을|를){WS}*(?:포함한|포함하는|담은|담고)",
    f"(?i)(?:containing|with|mentions?){WS}+(?:the{WS}+word{WS}+)?[\"']?([\\w가-힣]+)[\"']?",
    f"(?i)(?:the word|the name|the place){WS}+[\"']?([\\w가-힣]+)[\"']?",
]
KO_SCOPE = f"^({DOT}+?)(?:에서|에|의|에서 나오는|에 있는|에 나오는){WS}+({DOT}+)$"
EN_SCOPE = f"(?i)^(?:in|from|in the|from the){WS}+({DOT}+?){WS}+(?:about|on|concerning|regarding)?{WS}*({DOT}+)$"
MULTI_SPLIT = f"[,과와]|{WS}+and{WS}+|{WS}*&{WS}*"
TRAIL_QUOTES = r"[\"' \t\n\x0B\f\r]+$"

TH_FLOOR, TH_DIFF, TH_SCOPE = 0.0, 0.01, 0.01


QV = "qv AS (SELECT q.qid, q.query, e.embedding AS qvec FROM queries q LEFT JOIN embeddings e ON e.vec_id = q.qid)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def jtrim(e: str) -> str:
    return f"regexp_replace({e}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def not_blank(e: str) -> str:
    return f"regexp_matches(coalesce({e}, ''), '[^{JWS_CLASS}]')"


def pct(e: str) -> str:
    """Java %.0f: HALF_UP, and '-0' for small negatives."""
    return (f"CASE WHEN round(({e}) * 100) = 0 AND ({e}) < 0 THEN '-0' "
            f"ELSE CAST(CAST(round(({e}) * 100) AS BIGINT) AS VARCHAR) END")


def cos(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


VERSES = """verses AS (
  SELECT d.doc_id AS ord, upper(d.lang) AS version, d.source AS book_short,
    concat('Book ', substr(d.source, 4)) AS book_name,
    CASE WHEN CAST(substr(d.source,4) AS INT) < 10 THEN 1 ELSE 2 END AS testament,
    CAST(substr(d.source,4) AS INT) + 1 AS book_number,
    CAST(floor(d.doc_id / 200.0) AS INT) + 1 AS chapter,
    CAST(row_number() OVER (PARTITION BY d.lang, d.source, floor(d.doc_id / 200.0) ORDER BY d.doc_id) AS INT) AS verse,
    CASE WHEN d.doc_id % 7 = 0 THEN concat('T', CAST(d.doc_id AS VARCHAR)) END AS title,
    d.text AS text
  FROM documents d),
verses_x AS (
  SELECT *, concat(book_name, ' ', CAST(chapter AS VARCHAR), ':', CAST(verse AS VARCHAR)) AS reference,
    concat_ws(':', version, book_short, CAST(chapter AS VARCHAR), CAST(verse AS VARCHAR)) AS key
  FROM verses)"""

QUERIES = """queries AS (
  SELECT item_id AS qid, CASE item_id % 16
    WHEN 0 THEN concat('"', w1, '" appears')
    WHEN 1 THEN concat('documents containing ', w2)
    WHEN 2 THEN concat('in src3 about ', w1, ' ', w2)
    WHEN 3 THEN substr(w1, 1, 6)
    WHEN 4 THEN concat('from grpa on ', w2, ' ', w3)
    WHEN 5 THEN concat(w1, '라는 단어')
    WHEN 6 THEN concat(w1, ' ', w2, ' ', w3)
    WHEN 8 THEN text
    WHEN 9 THEN concat('in OT about ', w1, ' ', w2)
    WHEN 10 THEN concat('in src1,src2 about ', w1)
    WHEN 11 THEN concat('book', chr(CAST(97 + item_id % 20 AS INT)), ' 3:16')
    WHEN 12 THEN concat('book', chr(CAST(97 + item_id % 20 AS INT)), ' 99999999999')
    WHEN 13 THEN concat('src3에서 ', w1, ' ', w2)
    WHEN 14 THEN concat('from src4 on ', text)
    ELSE '  ' END AS query
  FROM (SELECT item_id, text, list_max(list_transform(ws, lambda w: {'n': length(w), 'w': w})).w AS w1, list_min(ws) AS w2, list_max(ws) AS w3
        FROM (SELECT item_id, text, string_split(text, ' ') AS ws FROM benchmark)) b)"""

#: Request fields of the benchmark's queries and of a log without any: k, min_score, version filter.
REQUEST = ("CAST(CASE WHEN qid % 5 = 2 THEN 3 ELSE 5 END AS INT) AS k, CAST(CASE WHEN qid % 11 = 4 THEN 0.15 ELSE 0.3 END AS DOUBLE) AS min_score, "
           "CASE qid % 7 WHEN 3 THEN 'english' WHEN 5 THEN 'fr' WHEN 6 THEN 'Latin' END AS vfilter")
NO_REQUEST = "5 AS k, 0.3 AS min_score, CAST(NULL AS VARCHAR) AS vfilter"

PROTOS = """protos AS (
  SELECT CASE WHEN vec_id % 10 = 0 THEN 'intent' ELSE 'scope' END AS "set",
    CASE WHEN vec_id % 10 = 0 THEN (CASE WHEN label < 5 THEN 'KEYWORD' ELSE 'SEMANTIC' END)
         ELSE (CASE WHEN label < 5 THEN 'CONTEXT' ELSE 'NO_CONTEXT' END) END AS class,
    vec_id, embedding
  FROM embeddings WHERE vec_id % 10 IN (0, 1))"""


def _dict_ctes() -> str:
    groups = {"grpa": [f"src{i}" for i in range(0, 5)], "grpb": [f"src{i}" for i in range(5, 10)],
              "biggrpa": ["src0", "src1"]}
    g_rows = ", ".join(f"('en', {q(k)}, [{', '.join(q(c) for c in v)}])" for k, v in groups.items())
    n_rows = ", ".join(f"('en', 'src{i}', 'src{i}')" for i in range(20))
    aliases = {"EN": ["EN", "english", "eng"], "FR": ["FR", "french"], "DE": ["DE"], "ES": ["ES"]}
    a_rows = ", ".join(f"({q(k)}, {q(a)})" for k, v in aliases.items() for a in v)
    return (f"book_group(lang, key, codes) AS (VALUES {g_rows}),\n"
            f"book_name(lang, key, code) AS (VALUES {n_rows}),\n"
            f"version_alias(key, alias) AS (VALUES {a_rows})")


def extract_keyword(t: str) -> str:
    tries = []
    for p in KW_PATTERNS:
        inner = jtrim(f"regexp_extract({t}, {q(p)}, 1)")
        g = jtrim(f"regexp_replace({inner}, {q(TRAIL_QUOTES)}, '')")
        tries.append(f"CASE WHEN regexp_matches({t}, {q(p)}) AND length({g}) BETWEEN 1 AND 20 THEN {g} END")
    stops = "[" + ", ".join(q(s) for s in STOPS) + "]"
    words = f"string_split_regex({t}, {q(WS + '+')})"
    fb = (f"CASE WHEN len({words}) <= 3 THEN "
          f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({stops}, lower(w)))[1] END")
    return "coalesce(" + ", ".join(tries + [fb]) + ")"


def context_ctes(queries_cte: str | None = None, qv_cte: str | None = None, sv_cte: str | None = None, request: str = REQUEST) -> str:
    """CTEs up to ``ctx``: one row per valid query with scope, intent and keyword.
    ``queries_cte`` / ``qv_cte`` replace the benchmark query log and its vectors, ``sv_cte`` the
    vectors of the cleaned queries (else the query's own stands in)."""
    ko1 = f"regexp_extract(trimmed, {q(KO_SCOPE)}, 1)"
    ko2 = f"regexp_extract(trimmed, {q(KO_SCOPE)}, 2)"
    en1 = f"regexp_extract(trimmed, {q(EN_SCOPE)}, 1)"
    en2 = f"regexp_extract(trimmed, {q(EN_SCOPE)}, 2)"
    t = "st"
    short = f"(len(string_split_regex({t}, {q(WS + '+')})) = 1 AND length({t}) <= 6)"
    is_kw = f"(kw_sim > {TH_FLOOR} AND (kw_sim - sem_sim) > {TH_DIFF})"
    is_sem = f"(sem_sim > {TH_FLOOR} AND -(kw_sim - sem_sim) > {TH_DIFF})"
    kwx = extract_keyword(t)
    return f"""{VERSES},
{queries_cte or QUERIES},
{PROTOS},
{_dict_ctes()},
{qv_cte or QV},
valid AS (SELECT qid, query, qvec, {jtrim('query')} AS trimmed FROM qv WHERE {not_blank('query')}),
sims AS (
  SELECT v.qid,
    coalesce(avg({cos('v.qvec', 'p.embedding')}) FILTER (WHERE p.class = 'CONTEXT'), 0) AS ctx_sim,
    coalesce(avg({cos('v.qvec', 'p.embedding')}) FILTER (WHERE p.class = 'NO_CONTEXT'), 0) AS noctx_sim
  FROM valid v, protos p GROUP BY v.qid),
sc0 AS (
  SELECT v.*, s.ctx_sim, s.noctx_sim,
    (s.noctx_sim > s.ctx_sim AND -(s.ctx_sim - s.noctx_sim) > {TH_SCOPE}) AS gate_off,
    CASE WHEN regexp_matches(trimmed, {q(KO_SCOPE)}) THEN {jtrim(ko1)} END AS ko_scope,
    CASE WHEN regexp_matches(trimmed, {q(KO_SCOPE)}) THEN {jtrim(ko2)} END AS ko_search,
    CASE WHEN regexp_matches(trimmed, {q(EN_SCOPE)}) THEN {jtrim(en1)} END AS en_scope,
    CASE WHEN regexp_matches(trimmed, {q(EN_SCOPE)}) THEN {jtrim(en2)} END AS en_search
  FROM valid v JOIN sims s USING (qid)),
attempts AS (
  SELECT qid, 0 AS attempt, 'ko' AS lang, ko_scope AS scope, ko_search AS search_part FROM sc0
    WHERE NOT gate_off AND ko_scope IS NOT NULL
  UNION ALL
  SELECT qid, 1 AS attempt, 'en' AS lang, en_scope AS scope, en_search AS search_part FROM sc0
    WHERE NOT gate_off AND en_scope IS NOT NULL),
{resolve_ctes('attempts')},
best AS (
  SELECT * FROM (
    SELECT a.qid, a.search_part, r.scope_type, r.scope_books, r.scope_testament, r.scope_desc,
      row_number() OVER (PARTITION BY a.qid ORDER BY a.attempt) AS rn
    FROM attempts a JOIN resolved r ON r.lang = a.lang AND r.scope = a.scope
    WHERE r.scope_type IS NOT NULL) WHERE rn = 1),
sc1 AS (
  SELECT s.*, coalesce(b.scope_type, 'NONE') AS scope_type, b.scope_books, b.scope_testament, b.scope_desc,
    CASE WHEN b.qid IS NOT NULL THEN s.ctx_sim ELSE 1.0 END AS confidence,
    CASE WHEN b.qid IS NOT NULL THEN b.search_part ELSE s.trimmed END AS cleaned_query
  FROM sc0 s LEFT JOIN best b USING (qid)),
sc2 AS (
  SELECT *, CASE WHEN {not_blank('cleaned_query')} THEN cleaned_query ELSE trimmed END AS search_query FROM sc1),
{sv_cte or 'sv AS (SELECT qid, qvec AS svec FROM sc2)'},
intent_sims AS (
  SELECT v.qid,
    coalesce(avg({cos('v.svec', 'p.embedding')}) FILTER (WHERE p.class = 'KEYWORD'), 0) AS kw_sim,
    coalesce(avg({cos('v.svec', 'p.embedding')}) FILTER (WHERE p.class = 'SEMANTIC'), 0) AS sem_sim
  FROM sv v, protos p GROUP BY v.qid),
sc3 AS (SELECT s.*, sv.svec, i.kw_sim, i.sem_sim, {jtrim('search_query')} AS st
        FROM sc2 s JOIN sv ON sv.qid = s.qid JOIN intent_sims i ON i.qid = s.qid),
ctx0 AS (
  SELECT *,
    CASE WHEN NOT {not_blank('search_query')} THEN 'SEMANTIC' WHEN {short} THEN 'HYBRID'
         WHEN {is_kw} THEN 'KEYWORD' WHEN {is_sem} THEN 'SEMANTIC' ELSE 'HYBRID' END AS intent,
    CASE WHEN NOT {not_blank('search_query')} THEN NULL WHEN {short} THEN st
         WHEN {is_kw} THEN {kwx} WHEN {is_sem} THEN NULL ELSE {kwx} END AS extracted_keyword,
    CASE WHEN NOT {not_blank('search_query')} THEN 'Empty query defaults to semantic'
         WHEN {short} THEN printf('Single short word (%d chars): using hybrid search', length(st))
         WHEN {is_kw} THEN concat('Keyword intent detected (score: ', {pct('kw_sim')}, '% vs ', {pct('sem_sim')}, '%)')
         WHEN {is_sem} THEN concat('Semantic intent detected (score: ', {pct('sem_sim')}, '% vs ', {pct('kw_sim')}, '%)')
         ELSE concat('Ambiguous intent (keyword: ', {pct('kw_sim')}, '%, semantic: ', {pct('sem_sim')}, '%): using hybrid')
    END AS intent_reason
  FROM sc3),
ctx AS (
  SELECT *, CASE WHEN NOT {not_blank('extracted_keyword')} THEN search_query ELSE extracted_keyword END AS search_keyword,
    {request}
  FROM ctx0)"""


def resolve_ctes(src: str) -> str:
    """CTEs ``parts`` .. ``resolved`` over the distinct (lang, scope) of ``src``."""
    return f"""parts AS (SELECT DISTINCT lang, scope FROM {src}),
grp AS (
  SELECT lang, scope, g_key, g_codes FROM (
    SELECT p.lang, p.scope, g.key AS g_key, g.codes AS g_codes,
      row_number() OVER (PARTITION BY p.lang, p.scope ORDER BY length(g.key) DESC, g.key) AS rn
    FROM parts p JOIN book_group g ON g.lang = p.lang AND contains(lower(p.scope), lower(g.key))) WHERE rn = 1),
one AS (
  SELECT lang, scope, b_key, b_code FROM (
    SELECT p.lang, p.scope, n.key AS b_key, n.code AS b_code,
      row_number() OVER (PARTITION BY p.lang, p.scope ORDER BY length(n.key) DESC, n.key) AS rn
    FROM parts p JOIN book_name n ON n.lang = p.lang AND contains(lower(p.scope), lower(n.key))) WHERE rn = 1),
pieces0 AS (
  SELECT lang, scope, unnest(regexp_split_to_array(scope, {q(MULTI_SPLIT)})) AS piece,
    unnest(range(0, len(regexp_split_to_array(scope, {q(MULTI_SPLIT)})))) AS pos
  FROM parts),
pieces AS (SELECT lang, scope, pos, {jtrim('piece')} AS piece FROM pieces0 WHERE length({jtrim('piece')}) > 0),
piece_best AS (
  SELECT lang, scope, pos, code FROM (
    SELECT p.lang, p.scope, p.pos, n.code,
      row_number() OVER (PARTITION BY p.lang, p.scope, p.pos ORDER BY length(n.key) DESC, n.key) AS rn
    FROM pieces p JOIN book_name n ON n.lang = p.lang AND contains(lower(p.piece), lower(n.key))) WHERE rn = 1),
multi AS (SELECT lang, scope, list(code ORDER BY pos) AS m_codes FROM piece_best GROUP BY lang, scope),
resolved AS (
  SELECT p.lang, p.scope,
    (CASE WHEN p.lang = 'ko' THEN regexp_matches(p.scope, '(?i)구약(?:성경|성서)?')
          ELSE regexp_matches(p.scope, '(?i)(?:old testament|OT)') END) AS ot,
    (CASE WHEN p.lang = 'ko' THEN regexp_matches(p.scope, '(?i)신약(?:성경|성서)?')
          ELSE regexp_matches(p.scope, '(?i)(?:new testament|NT)') END) AS nt,
    g.g_key, g.g_codes, m.m_codes, o.b_key, o.b_code,
    CASE WHEN ot OR nt THEN 'TESTAMENT' WHEN g.g_key IS NOT NULL THEN 'BOOK_GROUP'
         WHEN coalesce(len(m.m_codes), 0) > 1 THEN 'MULTIPLE_BOOKS' WHEN o.b_key IS NOT NULL THEN 'SINGLE_BOOK' END AS scope_type,
    CASE WHEN ot OR nt THEN NULL WHEN g.g_key IS NOT NULL THEN g.g_codes
         WHEN coalesce(len(m.m_codes), 0) > 1 THEN m.m_codes WHEN o.b_key IS NOT NULL THEN [o.b_code] END AS scope_books,
    CASE WHEN ot THEN 1 WHEN nt THEN 2 END AS scope_testament,
    CASE WHEN ot THEN (CASE WHEN p.lang = 'ko' THEN '구약 (Old Testament)' ELSE 'Old Testament' END)
         WHEN nt THEN (CASE WHEN p.lang = 'ko' THEN '신약 (New Testament)' ELSE 'New Testament' END)
         WHEN g.g_key IS NOT NULL THEN g.g_key
         WHEN coalesce(len(m.m_codes), 0) > 1 THEN array_to_string(m.m_codes, ', ')
         WHEN o.b_key IS NOT NULL THEN o.b_key END AS scope_desc
  FROM parts p LEFT JOIN grp g USING (lang, scope) LEFT JOIN multi m USING (lang, scope)
    LEFT JOIN one o USING (lang, scope))"""


SCOPE_OK = ("(CASE c.scope_type WHEN 'NONE' THEN true WHEN 'TESTAMENT' THEN coalesce(c.scope_testament = v.testament, false) "
            "ELSE coalesce(list_contains(list_transform(c.scope_books, lambda x: lower(x)), lower(v.book_short)), false) END)")
ALIASES = "CASE {} WHEN 'EN' THEN ['en', 'english', 'eng'] WHEN 'FR' THEN ['fr', 'french'] WHEN 'DE' THEN ['de'] WHEN 'ES' THEN ['es'] ELSE [] END"
VERSION_OK = (f"(c.vfilter IS NULL OR lower(c.vfilter) = lower(v.version) OR list_contains({ALIASES.format('upper(c.vfilter)')}, lower(v.version)) "
              f"OR list_contains({ALIASES.format('v.version')}, lower(c.vfilter)))")
RESULT_COLS = ("qid, CAST(rank AS INT) AS rank, key, reference, book_name, book_short, chapter, verse, title, text, "
               "version, round(score, 6) AS score, round(reranked_score, 6) AS reranked_score")


def rerank(score: str, text: str, query: str) -> str:
    n = (f"len(list_filter(string_split_regex(lower({query}), {q(WS + '+')}), "
         f"lambda w: length(w) > 2 AND contains(lower(coalesce({text}, '')), w)))")
    return (f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({score} + least(0.05::DOUBLE * {n}, 0.2::DOUBLE)) * "
            f"CASE WHEN length(coalesce({text}, '')) > 300 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END))")


def semantic_ctes(ctx_filter: str = "true", exclude_keyword: bool = False, vectors: str = "embeddings") -> str:
    excl = "AND NOT contains(v.text, c.search_keyword)" if exclude_keyword else ""
    return f"""cand0 AS (
  SELECT c.qid, e.vec_id AS ord, {cos('c.svec', 'e.embedding')} AS score
  FROM ctx c, {vectors} e WHERE {ctx_filter}),
cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ord) AS cand_rank
                 FROM cand0 WHERE score >= 0.1) WHERE cand_rank <= 50),
sem AS (
  SELECT t.qid, t.ord, t.score, t.cand_rank, v.key, v.reference, v.book_name, v.book_short, v.chapter, v.verse,
    v.title, v.text, v.version, c.k, c.min_score, {rerank('t.score', 'v.text', 'c.search_query')} AS reranked_score
  FROM cand t JOIN verses_x v ON v.ord = t.ord JOIN ctx c ON c.qid = t.qid
  WHERE {SCOPE_OK} AND {VERSION_OK} {excl})"""


def keyword_ctes(ctx_filter: str = "true") -> str:
    return f"""kwh AS (
  SELECT * FROM (
    SELECT c.qid, v.ord, v.key, v.reference, v.book_name, v.book_short, v.chapter, v.verse, v.title, v.text, v.version,
      1.0::DOUBLE AS score, 1.0::DOUBLE AS reranked_score, c.k,
      row_number() OVER (PARTITION BY c.qid ORDER BY v.ord) AS rank
    FROM ctx c JOIN verses_x v ON v.text IS NOT NULL AND contains(v.text, c.search_keyword)
    WHERE ({ctx_filter}) AND {SCOPE_OK} AND {VERSION_OK}) WHERE rank <= k)"""


def semantic_prefilter_sql() -> str:
    """Scope and version filters before the cut."""
    return f"""WITH {context_ctes()},
pc0 AS (
  SELECT c.qid, v.ord, {cos('c.svec', 'e.embedding')} AS score
  FROM ctx c, embeddings e JOIN verses v ON v.ord = e.vec_id WHERE {SCOPE_OK} AND {VERSION_OK}),
pcand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ord) AS cand_rank
                 FROM pc0 WHERE score >= 0.1) WHERE cand_rank <= 50),
psem AS (
  SELECT t.qid, t.score, t.cand_rank, v.key, v.reference, v.book_name, v.book_short, v.chapter, v.verse,
    v.title, v.text, v.version, c.k, c.min_score, {rerank('t.score', 'v.text', 'c.search_query')} AS reranked_score
  FROM pcand t JOIN verses_x v ON v.ord = t.ord JOIN ctx c ON c.qid = t.qid)
SELECT {RESULT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(reranked_score, 12) DESC, cand_rank) AS rank
  FROM psem WHERE reranked_score >= min_score) WHERE rank <= k"""


def semantic_search_sql(ctx_filter: str = "true") -> str:
    return f"""WITH {context_ctes()},
{semantic_ctes(ctx_filter)}
SELECT {RESULT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(reranked_score, 12) DESC, cand_rank) AS rank
  FROM sem WHERE reranked_score >= min_score) WHERE rank <= k"""


def keyword_search_sql(ctx_filter: str = "true") -> str:
    return f"""WITH {context_ctes()},
{keyword_ctes(ctx_filter)}
SELECT {RESULT_COLS} FROM kwh"""


def hybrid_body(ctx_filter: str = "true", vectors: str = "embeddings") -> str:
    return f"""{keyword_ctes(ctx_filter)},
{semantic_ctes(ctx_filter, exclude_keyword=True, vectors=vectors)},
merged AS (
  SELECT qid, key, reference, book_name, book_short, chapter, verse, title, text, version, score, reranked_score, k,
    0 AS prio, 0.0::DOUBLE AS sk1, ord AS sk2 FROM kwh
  UNION ALL
  SELECT qid, key, reference, book_name, book_short, chapter, verse, title, text, version, score, reranked_score, k,
    1 AS prio, -round(reranked_score, 12) AS sk1, cand_rank AS sk2 FROM sem WHERE reranked_score >= min_score),
hyb AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prio, sk1, sk2) AS rank FROM merged)
  WHERE rank <= k)"""


def hybrid_search_sql() -> str:
    return f"""WITH {context_ctes()},
{hybrid_body()}
SELECT {RESULT_COLS} FROM hyb"""


def routed_ctes(vectors: str = "embeddings") -> str:
    kw, sem, hy = "c.intent = 'KEYWORD'", "c.intent = 'SEMANTIC'", "c.intent = 'HYBRID'"
    hyb = (hybrid_body(hy, vectors).replace('kwh AS', 'hkw AS').replace('FROM kwh', 'FROM hkw')
           .replace('sem AS (', 'hsem AS (').replace('FROM sem WHERE', 'FROM hsem WHERE')
           .replace('cand0 AS', 'hcand0 AS').replace('FROM cand0', 'FROM hcand0')
           .replace('cand AS (', 'hcand AS (').replace('FROM cand t', 'FROM hcand t'))
    return f"""{keyword_ctes(kw)},
{semantic_ctes(sem, vectors=vectors)},
semr AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(reranked_score, 12) DESC, cand_rank) AS rank
    FROM sem WHERE reranked_score >= min_score) WHERE rank <= k),
{hyb},
routed AS (
  SELECT {RESULT_COLS}, 'KEYWORD' AS search_method FROM kwh
  UNION ALL SELECT {RESULT_COLS}, 'SEMANTIC' AS search_method FROM semr
  UNION ALL SELECT {RESULT_COLS}, 'HYBRID' AS search_method FROM hyb)"""


def routed_search_sql() -> str:
    return f"""WITH {context_ctes()},
{routed_ctes()}
SELECT * FROM routed"""


def semres_ctes() -> str:
    return f"""{semantic_ctes()},
semres AS (
  SELECT {RESULT_COLS} FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(reranked_score, 12) DESC, cand_rank) AS rank
    FROM sem WHERE reranked_score >= min_score) WHERE rank <= k)"""


# ---------------------------------------------------------------------------
# Corpus jobs
# ---------------------------------------------------------------------------

CROSSWALK = "crosswalk(code_a, code_b) AS (VALUES " + ", ".join(f"('src{i}', 'src{i + 10}')" for i in range(5)) + ")"
PAIRS = """codes AS (SELECT DISTINCT book_short AS code FROM verses),
code_pairs AS (
  SELECT c.code,
    CASE WHEN f.code_a IS NOT NULL THEN c.code ELSE coalesce(b.code_a, c.code) END AS code_a,
    CASE WHEN b.code_b IS NOT NULL THEN c.code ELSE coalesce(f.code_b, c.code) END AS code_b
  FROM codes c LEFT JOIN crosswalk f ON f.code_a = c.code LEFT JOIN crosswalk b ON b.code_b = c.code)"""
PARALLEL = """pairs AS (SELECT DISTINCT code_a, code_b FROM code_pairs),
pa AS (SELECT p.code_a, p.code_b, v.chapter, v.verse, v.text AS text_a FROM verses v JOIN pairs p ON p.code_a = v.book_short
       WHERE v.version = 'EN'),
pb AS (SELECT p.code_a, p.code_b, v.chapter, v.verse, v.text AS text_b FROM verses v JOIN pairs p ON p.code_b = v.book_short
       WHERE v.version = 'FR'),
ta AS (SELECT code_a, max(chapter) AS ta FROM pa GROUP BY code_a),
tb AS (SELECT code_b, max(chapter) AS tb FROM pb GROUP BY code_b),
pj AS (
  SELECT coalesce(pa.code_a, pb.code_a) AS code_a, coalesce(pa.code_b, pb.code_b) AS code_b,
    coalesce(pa.chapter, pb.chapter) AS chapter, coalesce(pa.verse, pb.verse) AS verse, pa.text_a, pb.text_b
  FROM pa FULL OUTER JOIN pb ON pa.code_a = pb.code_a AND pa.code_b = pb.code_b AND pa.chapter = pb.chapter
    AND pa.verse = pb.verse),
parallel AS (
  SELECT pj.*, CAST(greatest(coalesce(ta.ta, 0), coalesce(tb.tb, 0)) AS INT) AS total_chapters
  FROM pj LEFT JOIN ta USING (code_a) LEFT JOIN tb USING (code_b))"""
VOK = ("(r.req_version IS NULL OR r.req_version = '' OR lower(v.version) = lower(r.req_version) "
       "OR (lower(r.req_version) = 'krv' AND v.version = '개역개정'))")


def book_info_ctes(req: str) -> str:
    return f"""bj AS (SELECT r.req_book, r.req_version, v.* FROM {req} r JOIN verses v
              ON lower(v.book_short) = lower(r.req_book) AND {VOK}),
binfo AS (
  SELECT req_book, req_version, arg_min(book_name, ord) AS book_name, arg_min(book_short, ord) AS book_short,
    arg_min(version, ord) AS version, CAST(max(chapter) AS INT) AS total_chapters
  FROM bj GROUP BY req_book, req_version)"""


CORPUS_FLATTEN = """WITH c AS (
  SELECT conv_id, turn, CASE WHEN conv_id = 0 AND turn = 0 THEN NULL ELSE text END AS text FROM conversations),
r AS (
  SELECT conv_id, turn, text, CAST(conv_id % 5 AS BIGINT) AS part,
    CAST(dense_rank() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) - 1 AS BIGINT) AS cpos,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS vpos
  FROM c),
f AS (
  SELECT CAST(row_number() OVER (ORDER BY part, cpos, vpos) - 1 AS BIGINT) AS ord,
    CASE WHEN part = 2 THEN 'DEF' ELSE 'CONV' END AS version,
    concat('c', CAST(part AS VARCHAR)) AS book_short, concat('Conv ', CAST(part AS VARCHAR)) AS book_name,
    CAST(CASE WHEN part = 3 THEN 0 ELSE part % 2 + 1 END AS INT) AS testament,
    CAST(CASE WHEN part = 4 THEN 0 ELSE part + 1 END AS INT) AS book_number,
    CAST(conv_id AS INT) AS chapter, CAST(turn AS INT) AS verse, CAST(NULL AS VARCHAR) AS title,
    coalesce(text, '') AS text
  FROM r)
SELECT *, concat(book_name, ' ', CAST(chapter AS VARCHAR), ':', CAST(verse AS VARCHAR)) AS reference,
  concat_ws(':', version, book_short, CAST(chapter AS VARCHAR), CAST(verse AS VARCHAR)) AS key
FROM f"""

BACKREF1 = "\\1 "
_LETTERS = r"a-zA-Z\x{3131}-\x{318E}\x{AC00}-\x{D7A3}"
REFERENCE_PATTERN = (f"(?i)^((?:[0-9]{WS}*)?[{_LETTERS}]+"
                     f"(?:{WS}+[{_LETTERS}]+)*){WS}*([0-9]+)(?:장|편)?"
                     f"(?:{WS}*[:.]{WS}*([0-9]+)절?|{WS}*([0-9]+)절)?$")


def reference_parse_sql() -> str:
    t = jtrim("query")
    name0 = jtrim(f"lower({jtrim(f'regexp_extract({t}, {q(REFERENCE_PATTERN)}, 1)')})")
    name1 = f"regexp_replace(regexp_replace({name0}, '^([0-9]){WS}*', '\\1 '), '{WS}+', ' ', 'g')"
    rows = ", ".join(f"('{name}', 'src{i}', 'EN')" for i in range(20) for name in (f"src{i}", f"book{chr(97 + i)}"))
    return f"""WITH {QUERIES},
ref_book(name, code, version) AS (VALUES {rows}),
p AS (
  SELECT qid, regexp_matches({t}, {q(REFERENCE_PATTERN)}) AS hit,
    {jtrim(name1)} AS nm,
    regexp_extract({t}, {q(REFERENCE_PATTERN)}, 2) AS g2,
    regexp_extract({t}, {q(REFERENCE_PATTERN)}, 3) AS g3,
    regexp_extract({t}, {q(REFERENCE_PATTERN)}, 4) AS g4
  FROM queries WHERE {not_blank('query')}),
j AS (
  SELECT p.*, CASE WHEN TRY_CAST(g2 AS INT) IS NOT NULL THEN coalesce(a.code, b.code) END AS code,
    CASE WHEN TRY_CAST(g2 AS INT) IS NOT NULL THEN coalesce(a.version, b.version) END AS ver
  FROM p LEFT JOIN ref_book a ON p.hit AND a.name = p.nm
    LEFT JOIN ref_book b ON p.hit AND b.name = regexp_replace(p.nm, '{WS}+', '', 'g'))
SELECT qid, CASE WHEN code IS NOT NULL THEN 'READ' ELSE 'SEARCH' END AS route, code AS ref_book, ver AS ref_version,
  CASE WHEN code IS NOT NULL THEN TRY_CAST(g2 AS INT) END AS ref_chapter,
  CASE WHEN code IS NOT NULL THEN TRY_CAST(coalesce(nullif(g3, ''), nullif(g4, '')) AS INT) END AS ref_verse
FROM j"""


def with_ctx(body: str) -> str:
    return f"WITH {context_ctes()},\n{body}"


SIM_COLS = "round(kw_sim, 6) AS kw_sim, round(sem_sim, 6) AS sem_sim, round(ctx_sim, 6) AS ctx_sim, round(noctx_sim, 6) AS noctx_sim"

TOP50 = f"""c0 AS (SELECT v.qid, e.vec_id AS ord, {cos('v.qvec', 'e.embedding')} AS score FROM valid v, embeddings e),
top50 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ord) AS cand_rank
                 FROM c0 WHERE score >= 0.1) WHERE cand_rank <= 50)"""

HEX = "'0123456789abcdef'"
P1_TEXTS = """p1_texts AS (
  SELECT ord AS doc_id, concat('[', version, '] ', book_name, ' ', CAST(chapter AS VARCHAR), ':', CAST(verse AS VARCHAR),
    CASE WHEN length(title) > 0 THEN concat(' <', title, '>') ELSE '' END, ' ', coalesce(text, 'null')) AS text
  FROM verses)"""
EMBED = f"""WITH {VERSES},
{P1_TEXTS},
toks AS (SELECT doc_id, unnest(string_split_regex(lower(text), {q(WS + '+')})) AS tok FROM p1_texts),
h AS (SELECT doc_id, md5(tok) AS h FROM toks WHERE length(tok) > 0),
c AS (
  SELECT doc_id,
    CAST(((instr({HEX}, substr(h, 7, 1)) - 1) * 16 + (instr({HEX}, substr(h, 8, 1)) - 1)) % 64 AS INT) AS bucket,
    CASE WHEN (instr({HEX}, substr(h, 9, 1)) - 1) % 2 = 0 THEN 1 ELSE -1 END AS s
  FROM h),
cells AS (SELECT doc_id, bucket, CAST(sum(s) AS DOUBLE) AS v FROM c GROUP BY doc_id, bucket HAVING sum(s) <> 0),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM cells GROUP BY doc_id)
SELECT doc_id, bucket, round(v / n, 6) AS weight FROM cells JOIN n USING (doc_id)"""

VSUM = ("SELECT vec_id, CAST(len(embedding) AS INT) AS dim, "
        "round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm "
        "FROM embeddings")

ENVELOPE = f"""WITH {context_ctes()},
{routed_ctes()},
agg AS (SELECT qid, CAST(count(*) AS INT) AS total_results, string_agg(key, ',' ORDER BY rank) AS result_keys
        FROM routed GROUP BY qid),
qs AS (SELECT qid, query, {not_blank('query')} AS valid FROM queries)
SELECT qs.qid, CASE WHEN qs.valid THEN qs.query END AS query, qs.valid AS success,
  CASE WHEN qs.valid THEN NULL ELSE 'Query cannot be empty' END AS error,
  CAST(coalesce(agg.total_results, 0) AS INT) AS total_results, c.intent AS search_method, c.extracted_keyword,
  c.intent_reason, CASE WHEN c.scope_type <> 'NONE' THEN c.scope_type END AS detected_context_type,
  CASE WHEN c.scope_type <> 'NONE' THEN c.scope_desc END AS detected_context,
  CASE WHEN c.scope_type <> 'NONE' THEN array_to_string(c.scope_books, ',') END AS context_books,
  c.search_query, agg.result_keys
FROM qs LEFT JOIN ctx c ON c.qid = qs.qid LEFT JOIN agg ON agg.qid = qs.qid"""

SERVICE_STATS = f"""WITH {VERSES},
{PROTOS},
seg AS (SELECT concat('[', version, '] ', book_name, ' ', CAST(chapter AS VARCHAR), ':', CAST(verse AS VARCHAR),
          CASE WHEN length(title) > 0 THEN concat(' <', title, '>') ELSE '' END, ' ', coalesce(text, 'null')) AS t
        FROM verses v JOIN embeddings e ON e.vec_id = v.ord)
SELECT 50 AS candidate_count, 5 AS result_count, 0.3::DOUBLE AS min_score,
  (SELECT count(DISTINCT t) FROM seg) AS indexed_segments,
  (SELECT count(*) FROM embeddings) AS store_size,
  (SELECT count(*) > 0 FROM embeddings) AS store_non_empty,
  (SELECT count(*) FILTER (WHERE class = 'KEYWORD') FROM protos) AS n_keyword_prototypes,
  (SELECT count(*) FILTER (WHERE class = 'SEMANTIC') FROM protos) AS n_semantic_prototypes,
  (SELECT count(*) FILTER (WHERE class = 'CONTEXT') FROM protos) AS n_context_prototypes,
  (SELECT count(*) FILTER (WHERE class = 'NO_CONTEXT') FROM protos) AS n_no_context_prototypes,
  (SELECT count(*) FROM verses) AS total_verses,
  (SELECT count(*) FILTER (WHERE version = 'KRV') FROM verses) AS krv_verses,
  (SELECT count(*) FILTER (WHERE version = 'ASV') FROM verses) AS asv_verses"""


def corpus_oracles() -> dict[str, str]:
    v = f"WITH {VERSES}"
    return {
        "corpus_flatten": CORPUS_FLATTEN,
        "corpus_union": f"""{v}
SELECT CASE version WHEN 'EN' THEN 0 WHEN 'FR' THEN 1 WHEN 'DE' THEN 2 WHEN 'ES' THEN 3 END AS part, ord, key
FROM verses_x WHERE version IN ('EN', 'FR', 'DE', 'ES')""",
        "dedup_last": f"""{v},
u AS (SELECT ord, key, version FROM verses_x UNION ALL SELECT ord + 1000000, key, version FROM verses_x WHERE ord % 5 = 0)
SELECT key, ord, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS rn FROM u) WHERE rn = 1""",
        "corpus_stats": f"""{v}
SELECT count(*) AS total_verses, count(*) FILTER (WHERE version = 'KRV') AS krv_verses,
  count(*) FILTER (WHERE version = 'ASV') AS asv_verses FROM verses""",
        "load_counts": f"""{v}
SELECT version, count(DISTINCT book_short) AS books, count(*) AS verses FROM verses GROUP BY version""",
        "embedding_text": f"""{v}
SELECT ord, concat('[', version, '] ', book_name, ' ', CAST(chapter AS VARCHAR), ':', CAST(verse AS VARCHAR),
  CASE WHEN length(title) > 0 THEN concat(' <', title, '>') ELSE '' END, ' ', coalesce(text, 'null')) AS embedding_text
FROM verses""",
        "verse_key": f"{v}\nSELECT ord, key, reference FROM verses_x",
        "book_info": f"""{v},
req AS (SELECT DISTINCT book_short AS req_book, lower(version) AS req_version FROM verses
        UNION SELECT DISTINCT book_short, CAST(NULL AS VARCHAR) FROM verses),
{book_info_ctes('req')}
SELECT * FROM binfo""",
        "read_chapter": f"""{v},
req AS (SELECT DISTINCT book_short AS req_book, chapter AS req_chapter, lower(version) AS req_version FROM verses),
breq AS (SELECT DISTINCT req_book, req_version FROM req),
{book_info_ctes('breq')},
hits AS (
  SELECT r.req_book, r.req_chapter, r.req_version, v.ord, v.verse, v.version
  FROM req r JOIN verses v ON lower(v.book_short) = lower(r.req_book) AND v.chapter = r.req_chapter AND {VOK})
SELECT h.req_book, h.req_chapter, h.req_version, h.ord, h.verse, h.version,
  CAST(coalesce(b.total_chapters, 0) AS INT) AS total_chapters
FROM hits h LEFT JOIN binfo b ON b.req_book = h.req_book AND b.req_version IS NOT DISTINCT FROM h.req_version""",
        "chapter_neighbors": f"""{v},
ch AS (SELECT DISTINCT version, book_short, chapter FROM verses)
SELECT version, book_short, chapter,
  lag(chapter) OVER (PARTITION BY version, book_short ORDER BY chapter) AS prev_chapter,
  lead(chapter) OVER (PARTITION BY version, book_short ORDER BY chapter) AS next_chapter
FROM ch""",
        "code_crosswalk": f"{v},\n{CROSSWALK},\n{PAIRS}\nSELECT code, code_a, code_b FROM code_pairs",
        "parallel_chapter": f"{v},\n{CROSSWALK},\n{PAIRS},\n{PARALLEL}\nSELECT * FROM parallel",
        "hits_in_context": f"""WITH {context_ctes()},
{semres_ctes()},
{CROSSWALK},
{PAIRS},
{PARALLEL},
hp AS (
  SELECT s.qid, s.rank, s.chapter, s.verse AS hit_verse,
    CASE WHEN f.code_a IS NOT NULL THEN s.book_short ELSE coalesce(b.code_a, s.book_short) END AS code_a,
    CASE WHEN b.code_b IS NOT NULL THEN s.book_short ELSE coalesce(f.code_b, s.book_short) END AS code_b
  FROM semres s LEFT JOIN crosswalk f ON f.code_a = s.book_short LEFT JOIN crosswalk b ON b.code_b = s.book_short)
SELECT hp.qid, hp.rank, hp.code_a, hp.code_b, hp.chapter, p.verse, p.verse = hp.hit_verse AS highlight
FROM hp JOIN parallel p ON p.code_a = hp.code_a AND p.code_b = hp.code_b AND p.chapter = hp.chapter""",
    }


def querylog_oracles() -> dict[str, str]:
    return {
        "keyword_filter": f"WITH {VERSES}\nSELECT ord, key FROM verses_x WHERE text IS NOT NULL AND contains(text, 'the')",
        "keyword_topk": with_ctx("""kt AS (SELECT c.qid, v.ord, row_number() OVER (PARTITION BY c.qid ORDER BY v.ord) AS rank
       FROM ctx c JOIN verses v ON v.text IS NOT NULL AND contains(v.text, c.search_keyword))
SELECT qid, CAST(rank AS INT) AS rank, ord FROM kt WHERE rank <= 5"""),
        "keyword_join": with_ctx("""kws AS (SELECT DISTINCT search_keyword AS keyword FROM ctx)
SELECT k.keyword, v.ord FROM kws k JOIN verses v ON v.text IS NOT NULL AND contains(v.text, k.keyword)"""),
        "version_alias_filter": f"""WITH {VERSES},
{_dict_ctes()},
filters AS (SELECT alias AS f FROM version_alias UNION SELECT key FROM version_alias UNION SELECT lower(version) FROM verses),
pv AS (SELECT version, count(*) AS n FROM verses GROUP BY version),
m AS (
  SELECT f.f, pv.n FROM filters f JOIN pv ON NOT {not_blank('f.f')} OR lower(f.f) = lower(pv.version)
    OR EXISTS (SELECT 1 FROM version_alias a WHERE a.key = upper(f.f) AND lower(a.alias) = lower(pv.version))
    OR EXISTS (SELECT 1 FROM version_alias a WHERE a.key = pv.version AND lower(a.alias) = lower(f.f)))
SELECT f.f AS filter, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS n_match FROM filters f LEFT JOIN m ON m.f = f.f GROUP BY f.f""",
        "scope_filter": with_ctx(f"""sf AS (SELECT c.qid, c.scope_type, v.ord FROM ctx c LEFT JOIN verses v ON {SCOPE_OK}
       WHERE c.scope_type <> 'NONE')
SELECT qid, scope_type, CAST(count(ord) AS BIGINT) AS n_passages FROM sf GROUP BY qid, scope_type"""),
        "validate_queries": f"""WITH {QUERIES}
SELECT qid, {not_blank('query')} AS valid, CASE WHEN {not_blank('query')} THEN NULL ELSE 'Query cannot be empty' END AS error
FROM queries""",
        "query_tokens": f"""WITH {QUERIES},
t AS (SELECT qid, string_split_regex(lower({jtrim('query')}), {q(WS + '+')}) AS toks FROM queries WHERE {not_blank('query')}),
u AS (SELECT qid, unnest(toks) AS token, unnest(range(0, len(toks))) AS pos FROM t)
SELECT qid, CAST(pos AS INT) AS pos, token FROM u""",
        "keyword_extract": f"""WITH {QUERIES},
t AS (SELECT qid, {jtrim('query')} AS st FROM queries WHERE {not_blank('query')})
SELECT qid, {extract_keyword('st')} AS keyword FROM t""",
        "reference_parse": reference_parse_sql(),
        "scope_split": with_ctx("x AS (SELECT 1)\nSELECT qid, ko_scope, ko_search, en_scope, en_search FROM sc0"),
        "scope_resolve": with_ctx("""x AS (SELECT 1)
SELECT qid, scope_type, array_to_string(scope_books, ',') AS scope_books, scope_testament, scope_desc, cleaned_query,
  search_query FROM ctx"""),
        "prototype_similarity": with_ctx(f"x AS (SELECT 1)\nSELECT qid, {SIM_COLS} FROM ctx"),
        "intent_classify": with_ctx("""x AS (SELECT 1)
SELECT qid, intent, extracted_keyword, intent_reason, intent IN ('KEYWORD', 'HYBRID') AS needs_keyword,
  intent IN ('SEMANTIC', 'HYBRID') AS needs_semantic FROM ctx"""),
        "scope_gate": with_ctx("x AS (SELECT 1)\nSELECT qid, gate_off AS skip_scope, round(confidence, 6) AS confidence FROM ctx"),
    }


def vector_oracles() -> dict[str, str]:
    return {
        "cosine_pairs": with_ctx(f"""x AS (SELECT 1)
SELECT v.qid, e.vec_id AS ord, round({cos('v.qvec', 'e.embedding')}, 6) AS score FROM valid v, embeddings e
WHERE {cos('v.qvec', 'e.embedding')} >= 0.1"""),
        "knn_topk": with_ctx(f"{TOP50}\nSELECT qid, ord, round(score, 6) AS score, CAST(cand_rank AS INT) AS cand_rank FROM top50"),
        "hydrate_candidates": with_ctx(f"""{TOP50}
SELECT t.qid, CAST(t.cand_rank AS INT) AS cand_rank, v.key FROM top50 t JOIN verses_x v ON v.ord = t.ord"""),
        "rerank_scores": with_ctx(f"""{TOP50}
SELECT t.qid, t.ord, round(t.score, 6) AS score, round({rerank('t.score', 'v.text', 'c.search_query')}, 6) AS reranked_score
FROM top50 t JOIN verses v ON v.ord = t.ord JOIN ctx c ON c.qid = t.qid"""),
        "score_band": with_ctx(f"""{semres_ctes()},
sb AS (SELECT qid, rank, CASE WHEN reranked_score <> 0 THEN reranked_score ELSE score END AS d FROM semres)
SELECT qid, rank, round(d, 6) AS shown_score,
  CASE WHEN d >= 0.5 THEN 'high' WHEN d >= 0.35 THEN 'mid' ELSE 'low' END AS band,
  CAST(floor(d * 100 + 0.5) AS BIGINT) AS percent FROM sb"""),
        "hybrid_anti": with_ctx(f"""{semantic_ctes()}
SELECT s.qid, s.ord FROM sem s JOIN ctx c ON c.qid = s.qid
WHERE s.reranked_score >= s.min_score AND NOT contains(s.text, c.search_keyword)"""),
        "response_envelope": ENVELOPE,
        "service_stats": SERVICE_STATS,
        "vector_scan": VSUM,
        "vector_upsert": """WITH u AS (
  SELECT vec_id AS id, embedding, 0 AS batch FROM embeddings
  UNION ALL SELECT vec_id, list_reverse(embedding), 1 FROM embeddings WHERE label < 3)
SELECT id AS vec_id, batch, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC) AS rn FROM u) WHERE rn = 1""",
        "vector_append": """SELECT '' AS text, CAST(len(embedding) AS INT) AS dim,
  round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm,
  (SELECT 2 * count(*) FROM embeddings) AS n_ids FROM embeddings, range(2)""",
        "vector_codec_roundtrip": """SELECT vec_id, CAST(4 * len(embedding) AS INT) AS n_bytes, CAST(len(embedding) AS INT) AS dim,
  true AS same FROM embeddings""",
        "vector_snapshot_roundtrip": VSUM,
        "embed_corpus": EMBED,
        "build_report": """SELECT count(*) AS n_passages, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes,
  CAST(sum(length(text)) AS BIGINT) AS text_chars FROM documents""",
    }


def _hash_dense(src: str, id_expr: str, text_expr: str, name: str) -> str:
    """CTEs ``{name}`` (vec_id, embedding FLOAT[64]) by the hash-embedder rule."""
    return f"""{name}_tok AS (SELECT {id_expr} AS id, unnest(string_split_regex(lower({text_expr}), {q(WS + '+')})) AS tok
  FROM {src}),
{name}_c AS (
  SELECT id,
    CAST(((instr({HEX}, substr(md5(tok), 7, 1)) - 1) * 16 + (instr({HEX}, substr(md5(tok), 8, 1)) - 1)) % 64 AS INT) AS b,
    CASE WHEN (instr({HEX}, substr(md5(tok), 9, 1)) - 1) % 2 = 0 THEN 1 ELSE -1 END AS s
  FROM {name}_tok WHERE length(tok) > 0),
{name}_cells AS (SELECT id, b, CAST(sum(s) AS DOUBLE) AS v FROM {name}_c GROUP BY id, b HAVING sum(s) <> 0),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}_cells GROUP BY id),
{name}_w AS (SELECT c.id, c.b, CAST(CAST(c.v / n.n AS FLOAT) AS DOUBLE) AS w FROM {name}_cells c JOIN {name}_n n USING (id)),
{name} AS (
  SELECT id AS vec_id, list_transform(range(64), lambda i: coalesce(list_sum(list_transform(
      list_filter(cells, lambda c: c.b = i), lambda c: c.w)), 0.0)) AS embedding
  FROM (SELECT id, list(struct_pack(b := b, w := w)) AS cells FROM {name}_w GROUP BY id))"""


CONV_QUERIES = """queries AS (
  SELECT conv_id * 4294967296 + turn AS qid, text AS query FROM conversations)"""


def conversation_search_sql() -> str:
    qv = f"""{_hash_dense('queries', 'qid', 'query', 'qhv')},
qv AS (SELECT q.qid, q.query, h.embedding AS qvec FROM queries q LEFT JOIN qhv h ON h.vec_id = q.qid)"""
    sv = f"""{_hash_dense('sc2', 'qid', 'search_query', 'shv')},
sv AS (SELECT s.qid, h.embedding AS svec FROM sc2 s LEFT JOIN shv h ON h.vec_id = s.qid)"""
    ctx = context_ctes(CONV_QUERIES, qv, sv, NO_REQUEST)
    return f"""WITH {ctx},
{P1_TEXTS},
{_hash_dense('p1_texts', 'doc_id', 'text', 'hvec')},
{routed_ctes('hvec')}
SELECT * FROM routed"""


ORACLE: dict[str, str] = {
    "semantic_search": semantic_search_sql(),
    "semantic_search_prefilter": semantic_prefilter_sql(),
    "keyword_search": keyword_search_sql(),
    "hybrid_search": hybrid_search_sql(),
    "routed_search": routed_search_sql(),
}
ORACLE.update(corpus_oracles())
ORACLE.update(querylog_oracles())
ORACLE.update(vector_oracles())
ORACLE["conversation_search"] = conversation_search_sql()
_PHRASES = ", ".join(f"({i}, {q(c)}, {q(x)})" for i, (c, x) in enumerate((c, x) for c, xs in REF_PROTOTYPES.items() for x in xs))
ORACLE["phrase_prototypes"] = f"""WITH turns AS (SELECT conv_id * 4294967296 + turn AS qid, text FROM conversations),
phrases AS (SELECT * FROM (VALUES {_PHRASES}) t(id, class, phrase)),
{_hash_dense('turns', 'qid', 'text', 'tv')},
{_hash_dense('phrases', 'id', 'phrase', 'pv')},
sims AS (SELECT t.vec_id AS qid, p.class, avg({cos('t.embedding', 'v.embedding')}) AS s
  FROM tv t, pv v JOIN phrases p ON p.id = v.vec_id GROUP BY ALL),
wide AS (SELECT qid, max(s) FILTER (class = 'KEYWORD') AS kw, max(s) FILTER (class = 'SEMANTIC') AS sem,
  max(s) FILTER (class = 'CONTEXT') AS ctx, max(s) FILTER (class = 'NO_CONTEXT') AS noctx FROM sims GROUP BY qid)
SELECT t.qid, round(coalesce(kw, 0), 6) AS kw_sim, round(coalesce(sem, 0), 6) AS sem_sim, round(coalesce(ctx, 0), 6) AS ctx_sim,
  round(coalesce(noctx, 0), 6) AS noctx_sim, coalesce(noctx > ctx AND noctx - ctx > 0.08, false) AS skip_scope
FROM turns t LEFT JOIN wide USING (qid)"""
ORACLE["text_key_map"] = f"""WITH {VERSES},
{P1_TEXTS},
loaded AS (
  SELECT t.text, v.key, v.ord FROM p1_texts t JOIN verses_x v ON v.ord = t.doc_id
  UNION ALL SELECT t.text, v.key || '#2', v.ord + 1000000 FROM p1_texts t JOIN verses_x v ON v.ord = t.doc_id WHERE v.ord % 5 = 0)
SELECT sha256(text) AS digest, key, ord FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord DESC) AS rn FROM loaded) WHERE rn = 1"""
ORACLE["search_stream"] = ORACLE["routed_search"]
ORACLE["index_bootstrap"] = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_hash_dense('texts', 'doc_id', 'text', 'hv')}
SELECT r.run, r.source, d.doc_id, 64 AS dim, CAST(coalesce(len(list_filter(h.embedding, lambda x: x <> 0)), 0) AS INT) AS n_cells
FROM documents d LEFT JOIN hv h ON h.vec_id = d.doc_id, (VALUES (0, 'generated'), (1, 'store'), (2, 'snapshot')) r(run, source)"""
ORACLE["corpus_flatten_split"] = ORACLE["corpus_flatten"]
ORACLE["corpus_strict"] = """WITH c AS (
  SELECT conv_id, turn, CASE WHEN conv_id = 0 AND turn = 0 THEN 'null' ELSE coalesce(text, 'null') END AS text, conv_id % 5 AS part FROM conversations)
SELECT CAST(row_number() OVER (ORDER BY part, conv_id, turn) - 1 AS BIGINT) AS ord, CASE WHEN part <> 2 THEN 'CONV' END AS version,
  'c' || part AS book_short, CAST(CASE WHEN part <> 3 THEN part % 2 + 1 END AS INT) AS testament,
  CAST(CASE WHEN part <> 4 THEN part + 1 END AS INT) AS book_number, CAST(conv_id AS INT) AS chapter, CAST(turn AS INT) AS verse, text
FROM c"""
ORACLE["response_results"] = f"""WITH {context_ctes()},
{routed_ctes()},
n AS (SELECT qid, count(*) AS n FROM routed GROUP BY qid),
books AS (SELECT qid, CASE WHEN scope_type <> 'NONE' THEN unnest(scope_books) END AS book, unnest(range(len(scope_books))) AS pos FROM ctx WHERE scope_type <> 'NONE')
SELECT q.qid, {not_blank('q.query')} AS success, CAST(coalesce(n.n, 0) AS INT) AS n_results, 'result' AS part, CAST(r.rank - 1 AS INT) AS pos,
  r.key AS item, r.reranked_score, r.search_method
FROM queries q LEFT JOIN n USING (qid) LEFT JOIN routed r USING (qid)
UNION ALL
SELECT b.qid, true, CAST(coalesce(n.n, 0) AS INT), 'context book', CAST(b.pos AS INT), b.book, NULL, NULL FROM books b LEFT JOIN n USING (qid)"""
_CHAPTER_REQUESTS = f"""req AS (
  SELECT DISTINCT book_short AS req_book, chapter AS req_chapter, lower(version) AS req_version FROM verses
  UNION SELECT DISTINCT book_short, chapter + 1, lower(version) FROM verses
  UNION SELECT DISTINCT upper(book_short), chapter, NULL FROM verses
  UNION SELECT DISTINCT 'no ' || book_short, chapter, version FROM verses)"""
ORACLE["chapter_response"] = f"""WITH {VERSES},
{_CHAPTER_REQUESTS},
hits AS (SELECT r.*, v.ord, v.verse, v.version, v.book_short, v.book_name, v.text FROM req r JOIN verses v
         ON lower(v.book_short) = lower(r.req_book) AND v.chapter = r.req_chapter AND {VOK}),
info AS (SELECT r.req_book, r.req_chapter, r.req_version, max(v.chapter) AS total FROM req r JOIN verses v
         ON lower(v.book_short) = lower(r.req_book) AND {VOK} GROUP BY ALL),
heads AS (SELECT req_book, req_chapter, req_version, arg_min(book_name, (verse, ord)) AS book_name, arg_min(version, (verse, ord)) AS version, count(*) AS n_verses
          FROM hits GROUP BY ALL)
SELECT r.req_book, r.req_chapter, r.req_version, h.n_verses IS NOT NULL AS found, CASE WHEN h.n_verses IS NULL THEN 'Not found' END AS error,
  h.book_name, h.version, CAST(CASE WHEN h.n_verses IS NOT NULL THEN i.total END AS INT) AS total_chapters, coalesce(h.n_verses, 0) AS n_verses,
  CAST(row_number() OVER (PARTITION BY r.req_book, r.req_chapter, r.req_version ORDER BY x.verse, x.ord) - 1 AS INT) AS position, x.verse, x.ord
FROM req r LEFT JOIN heads h ON h.req_book = r.req_book AND h.req_chapter = r.req_chapter AND h.req_version IS NOT DISTINCT FROM r.req_version
  LEFT JOIN info i ON i.req_book = r.req_book AND i.req_chapter = r.req_chapter AND i.req_version IS NOT DISTINCT FROM r.req_version
  LEFT JOIN hits x ON x.req_book = r.req_book AND x.req_chapter = r.req_chapter AND x.req_version IS NOT DISTINCT FROM r.req_version"""
ORACLE["book_info_response"] = f"""WITH {VERSES},
req AS (SELECT DISTINCT book_short AS req_book, lower(version) AS req_version FROM verses
        UNION SELECT DISTINCT 'no ' || book_short, version FROM verses UNION SELECT DISTINCT book_short, 'Latin' FROM verses),
{book_info_ctes('req')}
SELECT r.req_book, r.req_version, b.book_short IS NOT NULL AS found, CASE WHEN b.book_short IS NULL THEN 'Not found' END AS error,
  b.book_name, b.book_short, b.version, b.total_chapters
FROM req r LEFT JOIN binfo b ON b.req_book = r.req_book AND b.req_version IS NOT DISTINCT FROM r.req_version"""
