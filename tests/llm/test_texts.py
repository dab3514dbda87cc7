"""op2, op3, op4, op8 and op9 on small and awkward inputs, and the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectio.llm import op02_warc, op03_quality, op04_decontamination, op08_lattice, op09_chat
from lectio.llm.words import Tokens
from llm_documents import documents  # noqa: F401

LOWER = {c: c + 32 for c in range(65, 91)}
PAGES = "page_id long, url string, html string"


def test_tokens_equal_regex():
    texts = ["Ab c  d", "", None, "ab\nAB é\x0bx", "  ", "\x00a b", "ab"]
    t = Tokens(pa.array(texts).slice(0))
    words = [re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOWER)) for x in texts]
    assert [[t.text(k) for k in range(t.first[i], t.first[i + 1])] for i in range(len(texts))] == words
    names = {}
    for w, h in zip((w for ws in words for w in ws), t.hash.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    s = Tokens(pa.array(texts).slice(3, 2))
    assert [s.text(k) for k in range(len(s.start))] == words[3]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 200
    rows = [(3, "http://a/x y?q=1#é", big), (1, None, big), (2, "http://b", None), (5, "u", ""), (4, "http://c\r\nX: y", "short"), (6, "http://d", "short"), (7, "v", "z" * 5_000_000), (1, None, big), (9, "w", "z" * 5_000_000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "1 as capture").repartition(3)
    op02_warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=1000)
    records = op02_warc.read_records(spark, str(tmp_path / "a"))
    out = {r.metadata.page_id: r for r in op02_warc.assemble(records).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6, 7, 9}
    for page, _, html in rows:
        r, payload = out[page], (html or "").encode()
        assert r.response.payload_bytes == len(payload) and r.response.payload_digest == hashlib.sha256(payload).hexdigest()
        if r.response.record_type == "response":
            assert bytes(r.response.payload) == payload and r.response.sound
        assert r.request.request.startswith("GET ")
    assert {i: r.metadata.refers_to for i, r in out.items() if r.response.record_type == "revisit"} == {3: 1, 9: 7}
    assert out[3].response.refers_to_record == out[1].response.record_id
    op02_warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert op02_warc.assemble(op02_warc.read_records(spark, str(tmp_path / "b"))).count() == 0


def test_quality_held_out(spark, documents):
    r = random.Random(2)
    good, bad, rude = [f"g{i}" for i in range(400)], [f"%%{i}$$" for i in range(60)], ["idiot", "scum", "moron"]
    texts, kinds = [], []
    for i in range(900):
        w = r.choices(good, k=r.randint(20, 120))
        kind = r.choice([0, 0, 0, 1, 2])
        if kind == 1:
            w = w[:5] + r.choices(bad, k=40)
        if kind == 2:
            w = [x if r.random() > 0.08 else r.choice(rude) for x in w] + [r.choice(rude)]
        texts.append(" ".join(w))
        kinds.append(kind)
    texts += [None, "", "   ", "..."]
    docs = documents(texts).drop("id", "n")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x.id: x for x in op03_quality.classify(docs, labels).collect()}
    held = [i for i in range(900) if i % 2 == 0]
    clean = [got[i].kept for i in held if kinds[i] == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(got[i].kept for i in held if kinds[i]) <= 0.03 * sum(kinds[i] > 0 for i in held)
    assert not any(got[i].kept for i in (900, 901, 902)) and got[900].log_weight == -math.inf
    kept = op03_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.kept}
    assert op03_quality.classify(docs, labels.limit(0)).filter("kept").count() == 901
    assert op03_quality.classify(docs.limit(0), labels).count() == 0


def _grams(text):
    """Counts of a text's n-grams by name, one counter for each family."""
    tokens = re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\x20\t-\r]+", (text or "").encode().translate(bytes(LOWER.get(i, i) for i in range(256))))
    beside = list(zip(tokens, tokens[1:]))
    repeats = sum(a == b for a, b in beside)
    return [collections.Counter(tokens) + collections.Counter({"repeat": repeats}), collections.Counter(t[:5] for t in tokens if len(t) > 5),
            collections.Counter(x for x in beside if x[0] != x[1])]


def test_quality_weights_equal_brute_force(spark, documents):
    """log_weight again in plain Python, with n-grams by name instead of by bucket."""
    r = random.Random(3)
    words, bad = [f"word{i}" for i in range(60)], ["idiot", "scum", "%%", "click here", "click click"]
    texts, kinds = [], []
    for i in range(300):
        kind = r.choice([0, 0, 1, 2])
        w = r.choices(words, k=r.randint(1, 40)) + [x for x in r.choices(bad[:2] if kind == 2 else bad[2:], k=9) if kind]
        texts.append(" ".join(r.sample(w, len(w))))
        kinds.append(kind)
    texts += ["", None, "Word1 word1", texts[0]]
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i % 3], "doc_id long, quality int, toxic int")
    got = {x.id: x for x in op03_quality.classify(documents(texts).drop("id", "n"), labels).collect()}
    grams = [_grams(t) for t in texts]
    of_kind = [[i for i, k in enumerate(kinds) if i % 3 and k == kind] for kind in range(3)]
    tables = []
    for kind in (1, 2):
        ratio = []
        for f in range(3):
            (n, d), (m, e) = ((sum((grams[i][f] for i in of_kind[k]), collections.Counter()), collections.Counter(g for i in of_kind[k] for g in grams[i][f])) for k in (0, kind))
            nt, no = len(of_kind[0]), len(of_kind[kind])
            all_n, all_m = sum(n.values()) + 1, sum(m.values()) + 1
            rates = {g: math.log((n[g] + 0.5) / all_n) - math.log((m[g] + 0.5) / all_m) for g in {**n, **m}}
            chance = {g: abs(2 * (math.sqrt(e[g] + 0.375) - math.sqrt(no * (d[g] + e[g]) / (nt + no) + 0.375)) / math.sqrt(nt / (nt + no))) for g in rates}
            told = {g for g in rates if (chance[g] >= 3 or g == "repeat") and abs(rates[g]) >= 1}
            rest = math.log((sum(c for g, c in n.items() if g not in told) + 0.5) / all_n) - math.log((sum(c for g, c in m.items() if g not in told) + 0.5) / all_m)
            ratio.append(({g: rates[g] for g in told}, rest))
        tables.append(ratio)
    deltas = [[sum(c * told.get(g, rest) for f, (told, rest) in enumerate(ratio) for g, c in grams[i][f].items()) for ratio in tables] for i in range(len(texts))]
    share = [len(x) / sum(map(len, of_kind)) for x in of_kind]
    real = [i for i, g in enumerate(grams) if g[0]]

    def weight(i):
        return -math.log(share[0] + sum(s * math.exp(-x) for s, x in zip(share[1:], deltas[i])))
    for _ in range(op03_quality.ROUNDS):
        of = [[math.exp(weight(i)) * s * math.exp(-x) for s, x in zip(share, (0, *deltas[i]))] for i in real]
        share = [sum(x) / len(of) for x in zip(*of)]
    for i in real:
        assert got[i].n_grams == sum(sum(f.values()) for f in grams[i])
        assert got[i].log_weight == pytest.approx(weight(i), rel=1e-4, abs=1e-4)
    assert {i for i in got if not got[i].n_grams} == {300, 301}


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 5000])
def test_gumbel_cut_is_exact(spark, k):
    r = random.Random(k)
    rows = [(i, float(r.choice([1.0, 2.0, 2.0, r.random(), -50.0]))) for i in range(1000)] + [(None, None)]
    cut, last = op03_quality.gumbel_cut(spark.createDataFrame(rows, "id long, gumbel double"), k)
    got = {i for i, g in rows if g is not None and (g > cut or (g == cut and i <= last))}
    ranked = sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[1], x[0]))
    assert got == {i for i, _ in ranked[:k]}


def test_leaks_equal_brute_force(spark, documents):
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    items = [" ".join(r.choices(words, k=r.randint(12, 60))).capitalize() + "." for _ in range(60)] + ["too short", None, ""]
    texts, want = [None, "", "w1 w2 w3"], set()
    for i in range(3, 240):
        w = r.choices(words, k=r.choice([10, 200, 900]))
        for item in r.sample(range(60), r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(w))
            w[at:at] = r.choice([items[item], items[item].upper(), items[item].replace(" ", ",  ")]).split(" ")
            want.add((i, item))
        texts.append(" ".join(w))
    # an insertion may cut an earlier one in two: brute force over the final texts decides
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    sure = {(i, j) for i, t in enumerate(texts) for j in range(60) if plain(items[j]) in plain(t)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 as score")
    docs = documents(texts)
    got = {(x.doc_id, x.item_id) for x in op04_decontamination.find_leaks(docs, bench).collect()}
    assert sure <= got <= want
    clean = op04_decontamination.without_leaks(docs, bench)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert op04_decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and op04_decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_short_items_and_scripts_without_spaces_leak(spark, documents):
    items = ["What is two plus two? Four.", "Paris", "法国的首都是哪里？巴黎。", "日本の首都はどこですか。東京です。それは関東地方にあります。", "?!"]
    texts = [
        "a b c what is TWO, plus two? four. d e f", "two plus two is four, what", "in paris, once", "parisian streets",
        "问：法国的首都是哪里？巴黎。答", "法国的首都不是巴黎，哪里？", "これは日本の首都はどこですか。東京です。それは関東地方にあります。など", "日本の夏", None, "?!",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in op04_decontamination.find_leaks(documents(texts), bench).collect()}
    assert got == {(0, 0), (2, 1), (4, 2), (6, 3)}
    assert {x.doc_id for x in op04_decontamination.without_leaks(documents(texts), bench).collect()} == {1, 3, 5, 7, 8, 9}


def test_signs_beyond_ascii_separate_words(spark, documents):
    bench = spark.createDataFrame([(0, "Who wrote Hamlet? Shakespeare.")], "item_id long, text string")
    texts = ["x \u201cWho wrote Hamlet? Shakespeare.\u201d y", "who\u00a0wrote\u2014Hamlet\u2026Shakespeare\u2019", "whowrote hamlet shakespeare", "\u00abwho wrote\u00bb hamlet\u2003shakespeare\u20ac"]
    assert {x.doc_id for x in op04_decontamination.find_leaks(documents(texts), bench).collect()} == {0, 1, 3}


def test_wand_retrieves_all_above_threshold():
    r = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    index = op04_decontamination.Index(list(range(50)), [" ".join(r.choices(words, k=r.randint(8, 30))) for _ in range(50)])
    for _ in range(200):
        terms = np.unique(np.array(r.sample(range(len(index.terms)), r.randint(1, 60))))
        score = np.zeros(50)
        for t in terms:
            score[index.item[index.first[t]: index.first[t + 1]]] += index.weight[index.first[t]: index.first[t + 1]]
        windows, items, share = index.retrieve(np.zeros(len(terms), np.int64), terms, 1)
        assert not windows.any() and set(items.tolist()) == set(np.flatnonzero(score >= 1 - 1e-9).tolist()) and np.allclose(share, score[items])


def all_segmentations(lattice, text):
    """Probability of a text by enumeration."""
    if not text:
        return 1.0
    total = sum(10 ** lattice.piece[text[:k]] * all_segmentations(lattice, text[k:]) for k in range(1, len(text) + 1) if text[:k] in lattice.piece)
    return total + (10 ** lattice.spell(text[0]) * all_segmentations(lattice, text[1:]) if text[0] not in lattice.piece else 0)


def test_lattice_sums_all_segmentations():
    _, pieces, prior, byte = op08_lattice.read_vocabulary(op08_lattice.VOCABULARY)
    with np.errstate(divide="ignore"):
        lattice = op08_lattice.Lattice(pieces, np.log10(prior), byte)
    for word in ["the", "thntion", "éauoi", "a", "xqzj", "日本語", "\U0001F600b"]:
        assert math.isclose(lattice.log10(word), math.log10(all_segmentations(lattice, "▁" + word)), rel_tol=1e-9)
    assert math.isfinite(lattice.log10("é" * 20000))


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_scores(spark, documents, held):
    texts = [None, "", "the THE cat", "x " * 3000, "the dog é日本", "cat\x0bdog", "w" * 5000, "the dog é日本"] + [f"the w{i % 9}" for i in range(40)]
    docs = documents(texts)
    rows = {r.doc_id: r for r in op08_lattice.score_texts(docs, held=held).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"] for t in texts]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = collections.Counter(w for ws, o in zip(words, out) if not o for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in enumerate(words):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert rows[4].score == rows[7].score
    assert op08_lattice.score_texts(docs.limit(0)).count() == 0


def test_chat_folding_and_sandbox():
    tree = op09_chat.fold(op09_chat.parse("{% control '<' %}a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% else %}d{% endif %}{% if true and not false %}e{% endif %}").body)
    assert tree == [op09_chat.Text("abcde")]
    for bad in ["{{ m.__class__ }}", "{{ f() }}", "{% import os %}", "{{ m['x'] }}", "{{ 1 }}", "{% for x in y %}{% endfor %}", "{{ m.text | nope }}", "no controls", "{% if true %}"]:
        with pytest.raises(op09_chat.TemplateError):
            op09_chat.compile_template(("" if bad == "no controls" else "{% control '<' %}") + bad)
    render = op09_chat.compile_template("{% control '<' %}{% for m in messages %}{{ loop.index == loop.index }}{% if loop.first %}^{% endif %}{% generation %}{{ m.text | upper }}{% endgeneration %}{{ m.text | raw }}{% if loop.last %}${% endif %}{% endfor %}")
    parts = list(render([{"role": "u", "text": "<a"}, {"role": "u", "text": "b"}], 1))
    assert "".join(p for p, _ in parts) == "True^\\<A<aTrueBb$" and [s for _, x in parts for s in x] == [(5, 8), (14, 15)]


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "\\\\", "[", "<", "ok", "é", "\U0001F600", "\n", " ", "[ROLE]", "[TEXT]", "[/ROLE]", "[OUT]", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, "[TEXT]"]), r.choice([None, "".join(r.choices(bits, k=r.randint(0, 9)))])) for c in range(60) for t in r.sample(range(20), r.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", "x" * 5000) for t in range(400)] + [(None, 0, "user", "hi"), (7, None, "user", "first"), (7, 3, "a", "same"), (7, 3, "a", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as formatted").repartition(4)
    formatted = op09_chat.format_conversations(frame, part_chars=3000)
    direct = {x.conv_id: x for x in op09_chat.conversation_digests(formatted, in_order=True).collect()}
    stored = {x.conv_id: x for x in op09_chat.conversation_digests(formatted.repartition(3)).collect()}
    assert direct == stored
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role is not None, role or "", text is not None, text or ""))
    assert set(direct) == set(by)
    for c, turns in by.items():
        turns.sort()
        x = direct[c]
        said = [(role, text) for _, _, role, _, text in turns]
        loss = "".join(t for role, t in said if role == "assistant")
        assert x.n_turns == len(turns)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), c
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert op09_chat.format_conversations(frame.limit(0)).count() == 0


def test_pipeline(spark, documents):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows.columns[: len(docs.columns)] == docs.columns
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert len(set(ids)) == len(ids) and 100 < len(ids) < docs.count()
    assert {n for n, _ in corpus_pipeline.STAGES} == {"quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"}


def test_pipeline_over_awkward_rows(spark, documents, tmp_path):
    """Null, empty and repeated rows, ids of several texts and clashing columns, stage by stage."""
    import re

    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{source}/documents.parquet").collect()]
    rows = real + [(10_000, None, "src1"), (10_001, "", None), (10_001, "", None), (None, real[3][1], "src2"), (10_002, "password = 'abcdefgh12345678XYZ' and more words here", "src1")]
    rows += [real[3], (real[3][0], real[4][1] + " other", "src9"), (10_003, real[3][1], "src1"), (10_004, "word " * 30_000, "src0")]
    docs = documents([t for _, t, _ in rows], sources=[s for *_, s in rows], ids=[i for i, *_ in rows])
    docs = docs.selectExpr("*", "'x' as gone", "'x' as of_key", "'x' as shards", "'x' as gumbel", "'x' as log_weight", "'x' as n_grams", "'x' as set_hash")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    kept, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, kept, str(tmp_path)), "awkward")
        before, after = [(r.doc_id, r.text) for r in kept.collect()], [(r.doc_id, r.text) for r in out.collect()]
        if name.startswith("n-gram"):
            sets = {}
            for i, t in before:
                w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
                sets[i, t] = frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
            near = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
            named = sorted({r for r in before if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
            root = {r: r for r in named}
            for k, x in enumerate(named):     # the classes, each named by its smallest id
                for y in named[:k]:
                    if near(sets[x], sets[y]) and root[x] != root[y]:
                        low, high = sorted((root[x], root[y]), key=lambda r: r[0])
                        root = {r: low if top == high else top for r, top in root.items()}
            stay = [r for r in after if r[0] is not None]
            assert all(r[0] == root[r][0] for r in stay) and {root[r] for r in stay if sets[r]} == {root[r] for r in named if sets[r]}
            assert sum(bool(sets[r]) for r in stay) == len({root[r] for r in named if sets[r]})
            assert {r for r in stay if not sets[r]} == {r for r in named if not sets[r]}
        elif name.startswith("secret"):
            assert len(after) == len(before) and not any("abcdefgh12345678XYZ" in (t or "") for _, t in after)
        elif name.startswith("mixing"):
            assert sorted(map(str, after)) == sorted(map(str, before))
            assert all(0 <= r.taken <= 3 * r.size and len(r.shards) * r.size == r.taken for r in out.collect() if r.size)
        else:
            assert set(after) <= set(before)
        assert out.columns[: len(kept.columns)] == kept.columns or name.startswith("mixing")
        seen[name], kept = len(after), out
    assert seen["mixing sources to target weights"] > 50
