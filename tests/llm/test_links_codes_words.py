"""op11, op12 and op13 against plain Python over small and awkward inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lectio.llm import op11_link_filter, op12_codes, op13_spelling
from llm_documents import documents  # noqa: F401

RULES = op11_link_filter.RULES


# --- op11 ------------------------------------------------------------------

def pages_of(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "rule", "rules", "said", "trust", "score", "verdict", "kind", "mass"):
        frame = frame.selectExpr("*", f"'x' as {name}")
    return frame


def judged(rows):
    """(host, path, rule, verdict) of every page, by dense matrices."""
    parts, lower = [], str.maketrans(op11_link_filter.UPPER, op11_link_filter.LOWER)
    for _, url, _ in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        parts.append((m[1].translate(lower), m[2]) if m else ("", ""))
    said = []
    for host, path in parts:
        fits = [(len(d + p), v, d + p) for d, p, v in RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        said.append(max(fits) if fits else None)
    links = collections.Counter()
    for (host, _), (_, _, html) in zip(parts, rows):
        for target in {t.translate(lower) for t in re.findall(op11_link_filter.LINK, html or "")}:
            if host and target != host:
                links[host, target] += 1
    names = sorted({h for h, _ in parts} | {h for link in links for h in link})
    at = {h: i for i, h in enumerate(names)}
    out = []
    for what, turned in (("allow", False), ("block", True)):
        seed, step = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for h in names:
            own = [s[1] for (host, _), s in zip(parts, said) if host == h and s]
            seed[at[h]] = own.count(what) / len(own) if own else 0
        for (a, b), n in links.items():
            a, b = (b, a) if turned else (a, b)
            step[at[b], at[a]] += n
        step = step / np.maximum(step.sum(0), 1e-300)
        rank = seed
        if links:
            for _ in range(op11_link_filter.ROUNDS):
                rank = (1 - op11_link_filter.DAMPING) * seed + op11_link_filter.DAMPING * (step @ rank)
        out.append(rank)
    verdicts = []
    for (host, path), s in zip(parts, said):
        trust, distrust = out[0][at[host]], out[1][at[host]]
        own = "allow" if trust + distrust == 0 or round((trust - distrust) / (trust + distrust), 6) >= 0 else "block"
        verdicts.append((host, path, s[2] if s else None, s[1] if s else own))
    return verdicts


def test_links_spread_verdicts(spark):
    draw = random.Random(3)
    hosts = [f"{h}.example.{t}" for h in "abcdefghij" for t in ("org", "com", "net")]
    rows = []
    for i in range(250):
        links = "".join(f"<a {draw.choice(['href', 'HREF '])}= {draw.choice(chr(34) + chr(39))}{draw.choice(['https:', 'HTTP:', ''])}//{draw.choice(hosts[:20]).title()}{draw.choice(['/x', '', '?q'])}' >" for _ in range(draw.choice([0, 1, 3])))
        rows.append((i, f"http://{draw.choice(hosts)}/{draw.choice(['en', 'fr', 'de', 'es'])}/{draw.randrange(300)}?u=1", links + '<a href="/z">'))
    rows += [(None, None, None), (5, "nourl", ""), (6, "x://", None), (7, "http://A.Example.ORG", ""), (8, "http://a.com/fr/", "<a href=//b.example.net>"),
             (9, "http://notorg/", ""), (10, "http://b.example.net?x=://c.org/", "<a href='//" + "q" * 5000 + ".org'>" * 50), (11, "ftp://org/#://", "")] + rows[:4]
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op11_link_filter.filter_urls(pages_of(spark, rows), spark.createDataFrame(RULES, "host string, path string, verdict string")).collect())
    want = collections.Counter((row[0], *v) for row, v in zip(rows, judged(rows)))
    assert got == want
    assert len({v[-1] for v in want if v[3] is None}) == 2  # both verdicts by links alone


def test_links_without_pages_or_links(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert op11_link_filter.filter_urls(pages_of(spark, []), rules).count() == 0
    rows = [(1, "http://x.net/a", None), (2, "http://x.com/de/", ""), (3, "http://x.com/en/", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in op11_link_filter.filter_urls(pages_of(spark, rows), rules).collect()}
    assert got == {1: (None, "allow"), 2: ("com/de/", "block"), 3: (None, "block")}
    assert {r.verdict for r in op11_link_filter.filter_urls(pages_of(spark, rows), rules.limit(0)).collect()} == {"allow"}


# --- op12 ------------------------------------------------------------------

def plain_codes(rows):
    """codes, errors and books of (id, vector) by plain k-means in Python numbers."""
    kept = [(i, [int(np.floor(float(x) * 256)) if abs(x) < 2**40 else int(x) * 256 for x in v]) for i, v in rows]
    size = len(kept[0][1]) // 16
    seeds, books = sorted({i: v for i, v in reversed(kept) if i is not None}.items())[:64], []
    for p in range(16):
        books.append([v[p * size: (p + 1) * size] for _, v in seeds])
    for k in range(3):
        codes, errors = [], []
        for _, v in kept:
            near = [min((sum((a - b) ** 2 for a, b in zip(v[p * size: (p + 1) * size], e)), j) for j, e in enumerate(books[p])) for p in range(16)]
            codes.append([j for _, j in near])
            errors.append(sum(d for d, _ in near))
        if k < 2:
            for p in range(16):
                for j in range(len(books[p])):
                    mine = [v[p * size: (p + 1) * size] for (_, v), c in zip(kept, codes) if c[p] == j]
                    if mine:
                        books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{j:02x}" for j in c) for c in codes], errors, sha


def vectors_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("code", "error", "codes", "kind", "x", "n"):
        frame = frame.selectExpr("*", f"'x' as {name}")
    return frame.repartition(3)


@pytest.mark.parametrize("scale", [0.02, 1.0, 3e8])
def test_codes_are_those_of_plain_k_means(spark, tmp_path, scale):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(12, 32)) * scale
    rows = [(int(i), [float(np.round(x, 3)) for x in centres[draw.integers(12)] + draw.normal(size=32) * scale / 5], None if i % 7 == 0 else int(i % 3)) for i in draw.permutation(300)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1)]  # repeated rows and one without id
    want, errors, sha = plain_codes([(i, v) for i, v, _ in rows])
    odd = [(1000, None, 1), (1001, [1.0] * 31 + [None], 1), (1002, [float("nan")] + [0.0] * 31, None), (1003, [float("-inf")] + [0.0] * 31, 2)]
    other = [(1004, [0.5] * 16, 1), (1005, [], None), (1006, [1e300] + [0.0] * 31, 2)]
    vectors_of(spark, rows + odd + other).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    sums = collections.Counter()
    for (_, _, label), e in zip(rows, errors):
        sums[label] += e
    most = 2**63 - 1
    mine = collections.Counter((i, c, min(e, most), min(sums[label], most)) for (i, _, label), c, e in zip(rows, want, errors))
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got if (r.vec_id or 0) < 1000) == mine
    assert {(r.vec_id, r.code, r.error) for r in got if (r.vec_id or 0) >= 1000} == {(i, None, None) for i in (1004, 1005, 1006)}
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_rings_and_cores_skip_most_pairs(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(64, 64)) * 4
    rows = [(i, (centres[i % 64] + draw.normal(size=64) / 50).tolist(), 0) for i in range(640)]
    coded, books, compared = op12_codes.vector_codes(vectors_of(spark, rows))
    pairs = 640 * op12_codes.PARTS * op12_codes.ENTRIES
    assert max(compared[1:]) < pairs / 100 and coded.count() == 640


def test_ball_assignment_keeps_ties_low():
    book = np.array([[4, 0], [0, 0], [4, 0], [2, 2]])
    x = np.array([[2, 0], [4, 0], [0, 0], [3, 1], [2, 1]])
    for home in range(4):
        balls = op12_codes.Balls(book, np.ones(4, bool), np.full(4, np.inf))
        entry, best, _ = op12_codes.assign(x, np.full(5, home), balls)
        apart = ((x[:, None] - book) ** 2).sum(-1)
        assert entry.tolist() == apart.argmin(1).tolist() and best.tolist() == apart.min(1).tolist()


def test_codes_of_empty_and_narrow_tables(spark, tmp_path):
    vectors_of(spark, []).write.parquet(str(tmp_path / "a/embeddings.parquet"))
    assert op12_codes.op12_vector_codes(spark, str(tmp_path / "a")).count() == 0
    vectors_of(spark, [(1, [0.1] * 17, 0), (2, [], None)]).write.parquet(str(tmp_path / "b/embeddings.parquet"))
    assert sorted((r.vec_id, r.code) for r in op12_codes.op12_vector_codes(spark, str(tmp_path / "b")).collect()) == [(1, None), (2, None)]


# --- op13 ------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(texts):
    counts = collections.Counter()
    for i, text in enumerate(texts):
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, form = {}, {}
    for w, n in words.items():
        met = sorted(((-words[v], v) for v in words if near(v, w)))
        form[w] = met[0][1] if met and -met[0][0] >= 10 * n else None
        out[w] = (form[w], n, len(met), -met[0][0] if form[w] else None)
    for w in words:
        last = w
        while form[last]:
            last = form[last]
        out[w] += (last,)
    return out


def test_spelling_against_all_pairs(spark, documents):
    draw = random.Random(11)
    stems = ["abcdefgh", "abcdefghi", "Étranger", "straßen", "aaaaaaaa", "bananabanana", "x" * 40, "commoner", "comm\u00d7ner"]
    texts = [None, "", "short words only", "ÀÉÎÕÜàé " * 3, "y" * 30_000 + " " + "y" * 30_000 + " " + "y" * 29_999 + " " + "y" * 29_999]
    for _ in range(60):
        words = []
        for _ in range(60):
            w = draw.choice(stems)
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                i = draw.randrange(len(w))
                w = draw.choice([w[:i] + w[i + 1:], w[:i] + draw.choice("abxéÿ") + w[i:], w[:i] + draw.choice("abxéÿ") + w[i + 1:]])
            words.append(w)
        texts.append(draw.choice([" ", "-", "1"]).join(words))
    texts += ["commoner " * 50 + "commonr " * 4 + "commnr "] * 12  # chains of forms; equal texts
    texts += ["chaining " * 300 + "chainingg " * 22 + "chaininggg " * 2]
    want = grouped(texts)
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in op13_spelling.spelling_variants(documents(texts)).collect()}
    assert got == want
    assert any(form and root != form for form, *_, root in got.values())


def test_spelling_of_empty_tables(spark, documents):
    assert op13_spelling.spelling_variants(documents([])).count() == 0
    assert op13_spelling.spelling_variants(documents([None, "a b c"])).count() == 0


def test_neighbourhood_is_full_and_distinct():
    size = 5
    reduced = np.array(np.meshgrid(*[range(3)] * size)).reshape(size, -1).T.astype(np.uint8)

    def named(word):
        value = sum((s + 1) * pow(op13_spelling.BASE, i, 2**64) for i, s in enumerate(word)) % 2**64
        return int(op13_spelling.mix(np.array([value], np.uint64), 1)[0])

    made = collections.defaultdict(list)
    for row, key in op13_spelling.neighbours(reduced):
        for r, k in zip(row.tolist(), key.tolist()):
            made[r].append(k)
    for r, word in enumerate(map(tuple, reduced.tolist())):
        want = {word[:i] + word[i + 1:] for i in range(size)}
        for c in range(op13_spelling.SYMBOLS):
            want |= {word[:i] + (c,) + word[i + 1:] for i in range(size)} | {word[:i] + (c,) + word[i:] for i in range(size + 1)}
        want.discard(word)
        assert sorted(made[r]) == sorted(map(named, want))
