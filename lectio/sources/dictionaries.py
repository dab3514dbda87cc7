"""Lookup dictionaries as small DataFrames.

Each dictionary is an input table, not logic: the reference service's own values are
listed below as fixed values, and ``synthetic_*`` builds the dictionaries that fit the
supplied test corpus (versions EN/FR/DE/ES, books src0..src19). Both are bounded, fixed
-size tables, so joins against them may broadcast them.

Schemas:
  version_alias(key string, alias string)          a version and the names that select it
  book_group(lang string, key string, codes array<string>)
  book_name(lang string, key string, code string)
  crosswalk(code_a string, code_b string)          same book under two versions' codes
  ref_book(name string, code string, version string)   reader shortcuts (C8)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# They must equal the reference service's tables for equal results.
# ---------------------------------------------------------------------------

# Phrases that stand for the classes of a query: intent (KEYWORD, SEMANTIC) and scope (CONTEXT, NO_CONTEXT).
REF_PROTOTYPES = {
    "KEYWORD": [
        "가사라는 지명이 나오는 구절", "모세가 등장하는 구절을 찾아줘", "다윗이라는 이름이 나오는 성경 구절",
        "아브라함이 언급된 부분", "예루살렘이 나오는 곳", "바울이라는 단어가 포함된 구절", "베드로가 나오는 성경",
        "시온이라는 지명", "갈릴리가 언급되는 구절", "여리고가 등장하는",
        "verses containing the word shepherd", "find verses that mention Moses", "passages where David appears",
        "verses with the name Abraham", "scriptures mentioning Jerusalem", "verses that contain the word love",
        "find where Paul is mentioned", "passages with the word faith", "verses including the term righteousness",
        "scriptures containing Galilee",
    ],
    "SEMANTIC": [
        "사랑에 대한 말씀", "용서에 관한 구절", "믿음의 의미를 알려주는 성경", "힘든 시간에 위로가 되는 말씀",
        "하나님의 사랑을 느낄 수 있는 구절", "소망과 희망에 대해", "감사에 관련된 성경 구절", "평안을 주는 말씀",
        "지혜로운 삶에 대한 가르침", "겸손함에 대해 말하는 구절",
        "verses about God's love", "what does the Bible say about forgiveness", "comfort in times of suffering",
        "passages about faith and trust", "scriptures on hope and encouragement", "teachings about wisdom",
        "verses related to peace and rest", "passages concerning eternal life", "what the Bible teaches about humility",
        "scriptures about gratitude and thanksgiving",
    ],
    "CONTEXT": [
        "신약에서 나오는 구절", "구약에서 언급된 말씀", "신약성경에서 사랑에 대한", "구약성서에서 예언된",
        "verses from the new testament", "passages in the old testament", "in the NT about love", "OT prophecies about",
        "사복음서에서 사랑이 나온 구절", "복음서에서 예수님의 말씀", "모세오경에서 율법에 대한", "바울서신에서 믿음에 관한",
        "시가서에서 찬양에 대해", "대선지서에서 예언", "소선지서에서 심판", "선지서에서 구원에 대한", "예언서에서 메시아",
        "in the four gospels about", "from the pentateuch about", "pauline epistles on faith", "wisdom books about",
        "로마서에서 복음의 정의", "창세기에서 창조에 대한", "요한복음에서 영생에 관한", "시편에서 위로의 말씀",
        "잠언에서 지혜에 대해", "이사야에서 메시아 예언",
        "in Romans about justification", "in Genesis about creation", "from John about eternal life", "in Psalms about comfort",
        "이사야, 예레미야에서 구원이 언급된", "마태복음과 요한복음에서 기적", "고린도전서와 후서에서 교회에 대해",
        "에베소서, 빌립보서에서 기쁨",
    ],
    "NO_CONTEXT": [
        "사랑에 대한 말씀", "용서에 관한 구절", "하나님의 은혜", "믿음의 의미", "소망에 대해", "평안을 주는 말씀",
        "위로의 구절", "verses about love", "what does the Bible say about forgiveness", "comfort in suffering",
        "faith and trust", "모세가 나오는 구절", "다윗이 언급된", "예루살렘이 나오는",
    ],
}

REF_VERSION_ALIASES = {
    "KRV": ["KRV", "개역개정", "개역한글", "krv"],
    "ASV": ["ASV", "asv", "American Standard Version"],
    "개역개정": ["KRV", "개역개정", "개역한글", "krv"],
}

REF_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "find", "search", "show", "get", "verses", "verse", "passages",
    "containing", "with", "about", "for", "in", "on", "at",
    "를", "을", "이", "가", "에", "의", "와", "과", "로", "으로",
    "구절", "말씀", "성경", "찾아", "줘", "주세요",
]

REF_BOOK_GROUPS_KR = {
    "사복음서": ["마", "막", "눅", "요"],
    "복음서": ["마", "막", "눅", "요"],
    "모세오경": ["창", "출", "레", "민", "신"],
    "율법서": ["창", "출", "레", "민", "신"],
    "역사서": ["수", "삿", "룻", "삼상", "삼하", "왕상", "왕하", "대상", "대하", "스", "느", "에"],
    "시가서": ["욥", "시", "잠", "전", "아"],
    "지혜서": ["욥", "시", "잠", "전", "아"],
    "대선지서": ["사", "렘", "애", "겔", "단"],
    "소선지서": ["호", "욜", "암", "옵", "욘", "미", "나", "합", "습", "학", "슥", "말"],
    "선지서": ["사", "렘", "애", "겔", "단", "호", "욜", "암", "옵", "욘", "미", "나", "합", "습", "학", "슥", "말"],
    "예언서": ["사", "렘", "애", "겔", "단", "호", "욜", "암", "옵", "욘", "미", "나", "합", "습", "학", "슥", "말"],
    "바울서신": ["롬", "고전", "고후", "갈", "엡", "빌", "골", "살전", "살후", "딤전", "딤후", "딛", "몬"],
    "일반서신": ["히", "약", "벧전", "벧후", "요일", "요이", "요삼", "유"],
    "공동서신": ["히", "약", "벧전", "벧후", "요일", "요이", "요삼", "유"],
}

REF_BOOK_GROUPS_EN = {
    "four gospels": ["Matt", "Mark", "Luke", "John"],
    "gospels": ["Matt", "Mark", "Luke", "John"],
    "pentateuch": ["Gen", "Ex", "Lev", "Num", "Deut"],
    "torah": ["Gen", "Ex", "Lev", "Num", "Deut"],
    "wisdom books": ["Job", "Ps", "Prov", "Eccl", "Song"],
    "major prophets": ["Isa", "Jer", "Lam", "Ezek", "Dan"],
    "minor prophets": ["Hos", "Joel", "Amos", "Obad", "Jonah", "Mic", "Nah", "Hab", "Zeph", "Hag", "Zech", "Mal"],
    "prophets": ["Isa", "Jer", "Lam", "Ezek", "Dan", "Hos", "Joel", "Amos", "Obad", "Jonah", "Mic", "Nah", "Hab",
                 "Zeph", "Hag", "Zech", "Mal"],
    "prophetic books": ["Isa", "Jer", "Lam", "Ezek", "Dan", "Hos", "Joel", "Amos", "Obad", "Jonah", "Mic", "Nah",
                        "Hab", "Zeph", "Hag", "Zech", "Mal"],
    "pauline epistles": ["Rom", "1Cor", "2Cor", "Gal", "Eph", "Phil", "Col", "1Thess", "2Thess", "1Tim", "2Tim",
                         "Titus", "Philem"],
    "general epistles": ["Heb", "Jas", "1Pet", "2Pet", "1John", "2John", "3John", "Jude"],
}

REF_BOOK_NAMES_KR = {
    "창세기": "창", "출애굽기": "출", "레위기": "레", "민수기": "민", "신명기": "신", "여호수아": "수",
    "사사기": "삿", "룻기": "룻", "사무엘상": "삼상", "사무엘하": "삼하", "열왕기상": "왕상", "열왕기하": "왕하",
    "역대상": "대상", "역대하": "대하", "에스라": "스", "느헤미야": "느", "에스더": "에", "욥기": "욥",
    "시편": "시", "잠언": "잠", "전도서": "전", "아가": "아", "이사야": "사", "예레미야": "렘",
    "예레미아": "렘", "애가": "애", "에스겔": "겔", "다니엘": "단", "호세아": "호", "요엘": "욜",
    "아모스": "암", "오바댜": "옵", "요나": "욘", "미가": "미", "나훔": "나", "하박국": "합",
    "스바냐": "습", "학개": "학", "스가랴": "슥", "말라기": "말",
    "마태복음": "마", "마가복음": "막", "누가복음": "눅", "요한복음": "요", "사도행전": "행", "로마서": "롬",
    "고린도전서": "고전", "고린도후서": "고후", "갈라디아서": "갈", "에베소서": "엡", "빌립보서": "빌",
    "골로새서": "골", "데살로니가전서": "살전", "데살로니가후서": "살후", "디모데전서": "딤전",
    "디모데후서": "딤후", "디도서": "딛", "빌레몬서": "몬", "히브리서": "히", "야고보서": "약",
    "베드로전서": "벧전", "베드로후서": "벧후", "요한일서": "요일", "요한이서": "요이", "요한삼서": "요삼",
    "유다서": "유", "요한계시록": "계", "계시록": "계",
}

REF_BOOK_NAMES_EN = {
    "genesis": "Gen", "exodus": "Ex", "leviticus": "Lev", "numbers": "Num", "deuteronomy": "Deut",
    "joshua": "Josh", "judges": "Judg", "ruth": "Ruth", "1 samuel": "1Sam", "2 samuel": "2Sam",
    "1 kings": "1Kgs", "2 kings": "2Kgs", "1 chronicles": "1Chr", "2 chronicles": "2Chr", "ezra": "Ezra",
    "nehemiah": "Neh", "esther": "Esth", "job": "Job", "psalms": "Ps", "proverbs": "Prov",
    "ecclesiastes": "Eccl", "song of solomon": "Song", "isaiah": "Isa", "jeremiah": "Jer",
    "lamentations": "Lam", "ezekiel": "Ezek", "daniel": "Dan", "hosea": "Hos", "joel": "Joel",
    "amos": "Amos", "obadiah": "Obad", "jonah": "Jonah", "micah": "Mic", "nahum": "Nah",
    "habakkuk": "Hab", "zephaniah": "Zeph", "haggai": "Hag", "zechariah": "Zech", "malachi": "Mal",
    "matthew": "Matt", "mark": "Mark", "luke": "Luke", "john": "John", "acts": "Acts", "romans": "Rom",
    "1 corinthians": "1Cor", "2 corinthians": "2Cor", "galatians": "Gal", "ephesians": "Eph",
    "philippians": "Phil", "colossians": "Col", "1 thessalonians": "1Thess", "2 thessalonians": "2Thess",
    "1 timothy": "1Tim", "2 timothy": "2Tim", "titus": "Titus", "philemon": "Philem", "hebrews": "Heb",
    "james": "Jas", "1 peter": "1Pet", "2 peter": "2Pet", "1 john": "1John", "2 john": "2John",
    "3 john": "3John", "jude": "Jude", "revelation": "Rev",
}

# Reader shortcuts of the web page: typed name -> (code, version).
REF_READER_BOOKS = {
    "genesis": ("Gen", "ASV"), "exodus": ("Ex", "ASV"), "john": ("John", "ASV"), "matthew": ("Matt", "ASV"),
    "mark": ("Mark", "ASV"), "luke": ("Luke", "ASV"), "romans": ("Rom", "ASV"), "psalms": ("Ps", "ASV"),
    "psalm": ("Ps", "ASV"), "ps": ("Ps", "ASV"), "gen": ("Gen", "ASV"), "ex": ("Ex", "ASV"),
    "jn": ("John", "ASV"), "matt": ("Matt", "ASV"), "rom": ("Rom", "ASV"), "rev": ("Rev", "ASV"),
    "1 cor": ("1 Cor", "ASV"), "1cor": ("1 Cor", "ASV"),
    "창세기": ("창", "KRV"), "출애굽기": ("출", "KRV"), "요한복음": ("요", "KRV"), "마태복음": ("마", "KRV"),
    "로마서": ("롬", "KRV"), "시편": ("시", "KRV"), "창": ("창", "KRV"), "출": ("출", "KRV"),
    "요": ("요", "KRV"), "마": ("마", "KRV"), "막": ("막", "KRV"), "눅": ("눅", "KRV"),
    "롬": ("롬", "KRV"), "시": ("시", "KRV"),
}

# Web page crosswalk between the two versions' book codes.
REF_CROSSWALK = {
    "Gen": "창", "Ex": "출", "Ps": "시", "Matt": "마", "Mark": "막",
    "Luke": "눅", "John": "요", "Rom": "롬", "Rev": "계", "1 Cor": "고전",
}

# ---------------------------------------------------------------------------
# Synthetic dictionaries for the supplied test corpus (FIXTURES.md section 3).
# ---------------------------------------------------------------------------

SYN_VERSION_ALIASES = {
    "EN": ["EN", "english", "eng"],
    "FR": ["FR", "french"],
    "DE": ["DE"],
    "ES": ["ES"],
}
SYN_BOOK_GROUPS = {
    "grpa": [f"src{i}" for i in range(0, 5)],
    "grpb": [f"src{i}" for i in range(5, 10)],
    "biggrpa": ["src0", "src1"],
}
SYN_BOOK_NAMES = {f"src{i}": f"src{i}" for i in range(20)}
SYN_CROSSWALK = {f"src{i}": f"src{i + 10}" for i in range(5)}
SYN_READER_BOOKS = {name: (f"src{i}", "EN") for i in range(20) for name in (f"src{i}", f"book{chr(97 + i)}")}


@dataclass
class Dictionaries:
    version_alias: DataFrame
    book_group: DataFrame
    book_name: DataFrame
    crosswalk: DataFrame
    ref_book: DataFrame
    stop_words: list[str]
    # The same fixed-size tables as plain values, for plans that inline them as literals.
    groups_by_lang: dict = None
    names_by_lang: dict = None


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table built JVM-side (LocalRelation via inline), no Python scan."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) if not isinstance(v, list) else
                          F.array(*[F.lit(x) for x in v]).cast(t).alias(n)
                          for (n, t), v in zip(fields, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _build(spark: SparkSession, aliases, groups_by_lang, names_by_lang, crosswalk, reader, stop_words) -> Dictionaries:
    va = _values(spark, [(k, a) for k, v in aliases.items() for a in v], "key string, alias string")
    bg = _values(spark, [(lang, k, v) for lang, g in groups_by_lang.items() for k, v in g.items()],
                 "lang string, key string, codes array<string>")
    bn = _values(spark, [(lang, k, v) for lang, g in names_by_lang.items() for k, v in g.items()],
                 "lang string, key string, code string")
    cw = _values(spark, list(crosswalk.items()), "code_a string, code_b string")
    rb = _values(spark, [(k, c, v) for k, (c, v) in reader.items()], "name string, code string, version string")
    return Dictionaries(va, bg, bn, cw, rb, list(stop_words), groups_by_lang, names_by_lang)


def reference_dictionaries(spark: SparkSession) -> Dictionaries:
    return _build(spark, REF_VERSION_ALIASES, {"ko": REF_BOOK_GROUPS_KR, "en": REF_BOOK_GROUPS_EN},
                  {"ko": REF_BOOK_NAMES_KR, "en": REF_BOOK_NAMES_EN}, REF_CROSSWALK, REF_READER_BOOKS,
                  REF_STOP_WORDS)


def synthetic_dictionaries(spark: SparkSession) -> Dictionaries:
    return _build(spark, SYN_VERSION_ALIASES, {"en": SYN_BOOK_GROUPS}, {"en": SYN_BOOK_NAMES},
                  SYN_CROSSWALK, SYN_READER_BOOKS, REF_STOP_WORDS)


def reference_prototypes(spark: SparkSession) -> DataFrame:
    """``(set, class, vec_id, phrase)``: the phrases that an embedder turns into V3's prototypes."""
    sets = {"KEYWORD": "intent", "SEMANTIC": "intent", "CONTEXT": "scope", "NO_CONTEXT": "scope"}
    rows = [(sets[c], c, phrase) for c, phrases in REF_PROTOTYPES.items() for phrase in phrases]
    return _values(spark, [(s, c, i, phrase) for i, (s, c, phrase) in enumerate(rows)], "set string, class string, vec_id long, phrase string")
