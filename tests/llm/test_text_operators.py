"""Each text operator against brute force on small tables, with nulls, empty and long texts, repeats and extra columns."""

import gzip
import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlake.llm import components, decontaminate, fixity, html_extract, jaccard, linear, packing, quality_model, quality_rules, textops, token_files, tokens, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, code long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(120, 1)
    texts = [None, "", " \n\t", "one", "a b c", " ".join(base), " ".join(base), "X " + " ".join(base[1:]), " ".join(base[:60] + words(60, 2)), " ".join(words(30000, 3, 5000)), "é ü\u3000ß " * 30, "the same line\nthe same line\nother # $ line\n\n" * 8, "a <|endoftext|> b"]
    texts += [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in (5, 50, 90)] + [" ".join(words(random.Random(i).randrange(4, 90), i)) for i in range(10, 40)]
    rows = [(i, t, "en", "s", 0, "x", 7) for i, t in enumerate(texts)] + [(6, texts[6], "en", "s", 0, "x", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_word_hashes_tell_words_apart_and_long_texts_are_cut_at_words(monkeypatch):
    data = pa.array(["Ab c", None, "ab\tC", "x" * 50 + " " + "y " * 40])
    before = [f[e[k] : e[k + 1]].tolist() for a, b, f, e in textops.word_hashes(data) for k in range(b - a)]
    assert before[0] == before[2] and before[1] == [] and len(before[3]) == 41
    monkeypatch.setattr(textops, "SLICE_BYTES", 16)
    assert before == [f[e[k] : e[k + 1]].tolist() for a, b, f, e in textops.word_hashes(data) for k in range(b - a)]


def test_quality_rules_counts(docs, none):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.measure(docs).collect())
    want = []
    for i, t in texts_of(docs):
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want)
    assert quality_rules.measure(none).count() == 0


def test_quality_rules_is_free_of_python(docs):
    plan = quality_rules.measure(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_packing(docs, none):
    got = packing.pack_documents(docs, capacity=256).collect()
    encode = library_ids()
    ids = {i: encode(t or "") + b"\0\0\0\0" for i, t in texts_of(docs)}
    places = defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(ids[i]) // 4 for i, _ in texts_of(docs))
    assert sum(r.length for r in got) == total and len(places) <= -(-total // 256) + 2
    assert packing.pack_documents(none).count() == 0


def test_plan_places_every_document_once(spark):
    """Rounds on stripes and a last step over what they leave, as the tasks run them; then the same through Spark."""

    def check(rows, counts, capacity, stride):
        fill, seen = defaultdict(list), defaultdict(list)
        for length, first, n, sequence, offset in rows:
            seen[length] += range(first, first + n)
            for k in range(n):
                fill[sequence + k * stride].append((offset, length))
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
        for p in fill.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= capacity
        return len(fill)

    for seed in range(40):
        r = random.Random(seed)
        counts = Counter(r.randint(1, r.choice([5, 64, 64])) for _ in range(r.randint(0, 200)))
        rows, docs, gaps = [], defaultdict(list), defaultdict(list)
        for part in range(3):
            own = {k: [(n * part // 3, n * (part + 1) // 3 - n * part // 3)] for k, n in counts.items() if n * (part + 1) // 3 > n * part // 3}
            placed, left, free = packing.settle(own, {}, 64, part, 4, False)
            rows += placed
            for total, some in ((docs, left), (gaps, free)):
                for k, runs in some.items():
                    total[k] += runs
        placed, left, _ = packing.settle(dict(docs), dict(gaps), 64, 3, 4, True)
        assert not left
        check(rows + placed, counts, 64, 4)
    r = random.Random(1)
    counts = Counter(min(64, int(r.expovariate(0.1)) + 1) for _ in range(20000))
    got = [tuple(x) for x in packing.plan(spark.createDataFrame(list(counts.items()), "length int, n long"), 64).collect()]
    assert check(got, counts, 64, packing.PARTS + 1) == -(-sum(k * n for k, n in counts.items()) // 64)


def library_ids(path=None):
    """The library's own encoding of whole texts, by a tokenizer loaded afresh."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path or tokens.default_tokenizer())
    return lambda t: np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_library():
    e, ids = tokens.encoder(tokens.default_tokenizer()), library_ids()
    assert np.frombuffer(e.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice([*" \n\tab1!'.,é<|", "<|endoftext|>", "word", "\u3000", "\x1c"]) for _ in range(r.randrange(14)))
        assert e.encode(t) == ids(t)


def test_other_vocabularies_are_encoded_whole():
    folder = os.path.dirname(tokens.default_tokenizer())
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json"):
            try:
                ids = library_ids(f"{folder}/{name}")
            except Exception:  # noqa: BLE001, S112 - not a file of this library
                continue
            e = tokens.Encoder(f"{folder}/{name}")
            for t in ("Two words, and  more.", "", " ß x1 don't\n\nstop", "a b c d é"):
                assert e.encode(t) == ids(t)


def test_fixity_finds_the_damage(spark):
    pages = spark.createDataFrame([(i, f"u{i}" if i % 7 else None, None if i % 11 == 0 else f"<p>{i}</p>", "x") for i in range(9000)] + [(None, "u", "h", "x"), (5, "u5", "<p>5</p>", "x")], "page_id long, url string, html string, status string")
    index = fixity.archive_index(pages)
    assert fixity.audit(index, index).count() == 0
    copy = pages.where("page_id is null or page_id <> 4100").withColumn("html", F.when(F.col("page_id") == 77, "changed").otherwise(F.col("html")))
    copy = copy.union(spark.createDataFrame([(8999, "u8999x", "extra", "x")], pages.schema))
    got = sorted((r.key, r.status) for r in fixity.audit(index, fixity.archive_index(copy)).collect())
    assert got == [(77, "changed"), (4100, "missing"), (8999, "extra")]
    empty = fixity.archive_index(pages.limit(0))
    assert fixity.audit(empty, empty).count() == 0


def test_archives_are_warc_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixity, "VOLUME_BYTES", 2000)
    rows = [(1, "http://a/\r\nb", "x\r\n\r\ny é"), (None, None, None), (None, "u", "WARC/1.1\r\n")] + [(5, "u", "same")] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1)).withColumn("volume", F.lit(1))
    fixity.write_archives(pages, str(tmp_path / "w"))
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").rglob("*.gz")]
    assert len(files) > 2 and all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for f in files)
    assert "WARC-Target-URI: http://a/b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 9\r\n\r\nx\r\n\r\ny é\r\n\r\n".encode() in b"".join(files)
    index = fixity.read_index(spark, str(tmp_path / "w")).collect()
    assert Counter(r.key for r in index) == Counter(r[0] for r in rows) and max(r.volume for r in index) > 0
    with pytest.raises(ValueError):
        list(fixity.records_of(files[0][:-1]))


def test_fixity_sees_offsets(spark):
    rows = [(0, v, k, k, 10 * k, 10, f"s{k}") for v in range(2) for k in range(300)]
    schema = "archive long, volume int, nth long, key long, offset long, length long, sha256 string"
    index = spark.createDataFrame(rows, schema)
    moved = index.withColumn("offset", F.when(F.col("nth") == 77, 0).otherwise(F.col("offset")))
    assert {(r.key, r.status) for r in fixity.audit(index, moved, True).collect()} == {(77, "moved")}
    less = index.where("not (volume = 1 and nth = 5)")
    assert {(r.key, r.status, r.offset) for r in fixity.audit(index, less).collect()} == {(5, "missing", 50)}
    assert fixity.audit(index, index, True).count() == 0


def test_offsets_are_gapless(spark, sf):
    rows = fixity.archive_index(spark.read.parquet(f"{sf}/pages.parquet")).orderBy("key").collect()
    at = 0
    for r in rows:
        assert r.offset == at
        at += r.length


def test_url_filter(spark):
    urls = ["http://a.EXAMPLE.net/en/x?y", "https://b.net", "http://b.net/", "http://x.org/fr/a#b", "http://m.spam-farm.example.com/q", "http://notspam-farm.example.com/q", None, "nothing", "x://h?://z/", "http://a.example.com/de/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("b.net", "", None, "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2:] == (None, "block") and got[5][2:] == (None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][0] == "h" and got[9][3] == "block"


def test_cascade_is_exact_for_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)  # many false positives, so many levels
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 7 = 0")
    cascade = url_filter.BloomCascade.fit(listed, universe)
    assert len(cascade.levels) > 3
    wrong = universe.where(cascade.listed(F.col("key")) != (F.expr("cast(substring(key, 2) as int) % 7 = 0")))
    assert wrong.count() == 0


def test_long_lists_are_dealt_to_several_cascades(spark, monkeypatch):
    hosts = [f"h{i % 900}.bad{i % 700}.com" for i in range(1500)]
    rows = [(i, f"http://{h}/x", "e", "v") for i, h in enumerate(hosts)] + [(7, "http://h7.bad7.com/x", "e", "v"), (None, None, "e", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _hit string")
    listed = spark.createDataFrame([(f"bad{i}.com",) for i in range(0, 700, 3)] + [("h10.bad10.com",), (None,), ("bad3.com",), ("not.there",)], "key string")
    monkeypatch.setattr(url_filter, "LEVEL_BYTES", 200)
    got = url_filter.judge(pages, listed)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and "Python" not in got._jdf.queryExecution().toString()
    got = got.collect()
    assert len(got) == len(rows) and Counter(r.page_id for r in got)[7] == 2
    for r in got:
        i = r.page_id
        assert r.verdict == ("block" if i is not None and (i % 700 % 3 == 0 or hosts[i] == "h10.bad10.com") else "allow")
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    base = words(120, 1)
    items = [(1, "W" + " ".join(base[20:45])[1:]), (2, "a,b;C"), (3, None), (4, "..."), (10, "a b c"), (5, " ".join(words(25, 99))), (None, " ".join(words(30000, 3, 5000)[200:215])), (3, "a,b;C"), (3, "a,b;C")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in texts_of(docs):
        w = norm(t)
        hit, found = set(), set()
        for item, text in items:
            q = norm(text)
            for win in [q[k : k + 10] for k in range(max(1, len(q) - 9))] if q else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for size in (1 << 22, 60):
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", size)
        got = sorted(tuple(r) for r in decontaminate.report(decontaminate.scan_documents(docs, bench)).collect())
        assert got == sorted(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.scan_documents(none, bench).count() == 0
    assert decontaminate.scan_documents(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_spans_are_offsets_of_the_original():
    text = "é, ONE--Two\x00three! four".encode()
    normal = text.translate(decontaminate._NORMAL)
    n, found, items = decontaminate.Automaton([("1", b"one two three")], 10).hits(normal)
    assert (n, items) == (5, {"1"}) and [text[x:y] for x, y in decontaminate._offsets(normal, found)] == [b"ONE--Two\x00three"]


def test_large_items_and_benchmarks_are_cut_and_automata_made_once(spark, monkeypatch):
    whole = words(4000, 11, 3000)
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 1600)
    pieces = list(decontaminate.pieces_of(" ".join(whole).encode(), 10))
    windows = lambda w: [tuple(w[i : i + 10]) for i in range(len(w) - 9)]
    assert len(pieces) > 100 and all(len(p.split()) >= 10 for p in pieces)
    assert [x for p in pieces for x in windows(p.decode().split())] == windows(whole)
    assert list(decontaminate.pieces_of(b"few " * 3, 10)) == [b"few " * 3]
    bench = spark.createDataFrame([(i, " ".join(words(12, i, 4000))) for i in range(200)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 1200)
    assert len(decontaminate.build(bench)) >= 20
    texts = [(0, "x " + " ".join(words(12, 7, 4000)) + " " + " ".join(words(12, 8, 4000)[1:])), (1, " ".join(words(11, 7, 4000)[2:])), (None, None), (0, "é " + " ".join(words(12, 150, 4000)[:10]))]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, _row int")
    got = sorted(tuple(r) for r in decontaminate.scan_documents(docs, bench).select("doc_id", "n_words", "n_hit", "items", F.expr("transform(spans, s -> s.start)")).collect() if r.doc_id is not None)
    assert got == [(0, 11, 10, ["150"], [3]), (0, 24, 23, ["7", "8"], [2]), (1, 9, 0, [], [])]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]
    made = []
    monkeypatch.setattr(decontaminate, "Automaton", lambda items, n: made.append(n) or len(made))
    assert [decontaminate._automaton(k, [], 10) for k in ("a", "a", "a", "b", "b")] == [1, 1, 1, 2, 2]


def test_many_words_have_symbols():
    words_ = [f"v{i}".encode() for i in range(70000)]
    a = decontaminate.Automaton([("x", b" ".join(words_))], 10)
    assert len(set(a.symbols.values())) == 70000
    assert [f[0] for f in a.scan([b"v65000", *words_[55290:55302], b"no"])] == [1, 2, 3]


def test_html():
    page = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav>
<div class="ad">buy</div><div class="sidebar"><p>side text, long enough, with commas, and words</p></div><article><h1>Head &amp; line</h1><p><b>First,
 para <i>one</i><br><p>Second&nbsp;para, it goes on, and on, for a while.</p><ul><li>item a<li>item b</ul><form><p>form</p></form><div id="comments"><p>nice, post, indeed</p></div></article>
<footer>&copy; foot</footer></body>"""
    assert html_extract.extract(page) == "Head & line\nFirst, para one\nSecond para, it goes on, and on, for a while.\nitem a\nitem b"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.extract("<p>plain <b>text") == "plain text"
    assert html_extract.extract("<div>" * 3000 + "deep, text" + "</p>" * 10) == "deep, text"


def test_html_names_and_hidden_parts():
    long = "A paragraph of some length, with commas, and words, so that it is read as text of an article, not as a menu."
    page = lambda inner, body="": f"<html><body {body}>{inner}</body></html>"
    x = html_extract.extract
    assert x(page(f"<article class='overflow-hidden'><p>{long}</p></article>", "class='overflow-hidden'")) == long
    assert x(page(f"<article><p>{long}</p><div id='related-work'><h2>Related work</h2><p>More.</p></div><div class='related-posts'><p>Other posts</p></div></article>")) == f"{long}\nRelated work\nMore."
    assert x(page(f"<div class='content with-sidebar'><article><p>{long}</p></article><div class='site-sidebar'><p>{long}</p></div></div>")) == long
    assert x(page(f"<div class='sidebar'><article><p>{long}</p></article></div>")) == long
    assert x(page(f"<form id=aspnet><article><p>{long}</p></article></form>")) == long
    assert x(page(f"<form id=aspnet><div><p>{long}</p><p>{long}</p></div></form>")) == f"{long}\n{long}"
    assert x(page(f"<main><article><p>Short one.</p></article><article><p>{long}</p><p>{long}</p></article><article class='card'><p><a href=x>only links</a></p></article></main>")).startswith(f"Short one.\n{long}")
    assert x(page(f"<article><p>Short one.</p></article><article><p>{long}</p></article>")) == f"Short one.\n{long}"
    assert x(page(f"<article><p>{long}</p><p hidden>no</p><p style='display: none'>no</p><div class='comment-list'><p>no</p></div></article>")) == long
    assert x(page(f"<h1>Title</h1><p>Lead.</p><div class='text'><p>{long}</p><p>{long}</p></div><h2>End</h2><p>Bye.</p><p><a href=x>next</a></p>")) == f"Title\nLead.\n{long}\n{long}\nEnd\nBye."
    assert x(page(f"<article><p title='a > b' data-x=\"<p>\">{long}</p></article>")) == long
    assert x(page("<div class=menu><a href=x>a</a> <a href=y>b</a></div>")) == ""


@pytest.mark.parametrize("part", ["<a ", "<p class='", '<a x="><b y=\'>', "<svg>", "<!--", "<!", "<div>", "</p>", "<b>", "</b", "<header>", "<li>", "<td><p>", "&amp", "<a b=c ", "<textarea></textarea "])
def test_html_takes_time_in_proportion(part):
    began = time.time()
    html_extract.extract("<article><div><b>" + part * ((1 << 20) // len(part)))
    assert time.time() - began < 20
    if part == "<a ":
        assert time.time() - began < 1


def test_html_tables(spark):
    schema = "page_id string, url string, html string, text string, n_chars int"
    rows = [("a", None, None, "x", 1), ("b", "u", "", "x", 1), ("b", "u", "", "x", 1), (None, "u", "<p>Hi <b>you", "x", 1)]
    got = sorted((tuple(r) for r in html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([("a", None, "", 0), ("b", "u", "", 0), ("b", "u", "", 0), (None, "u", "Hi you", 6)], key=str)
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_html_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_extract.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html_extract.html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?p>|</?h1>|<br>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_ids_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        for high in (1, 2, 50257, 2**32 - 1):
            x = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            data = token_files.encode_ids(x)
            assert (token_files.decode_ids(data) == x).all()
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (token_files.decode_ids(data, a, b) == x[a:b]).all()


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path)
    got = sorted(tuple(r) for r in token_files.read_tokens(spark, path).collect())
    encode, at, want = library_ids(), 0, []
    for i, t in sorted(texts_of(docs), key=lambda x: x[0]):
        ids = encode(t or "") + b"\2\0\0\0"
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == sorted(want)
    token_files.write_tokens(none, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def linked(docs, percent=75):
    sets = {}
    for i, t in texts_of(docs):
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return sorted((i, len(sets[i]), root[i]) for i, _ in texts_of(docs))


@pytest.mark.parametrize("frequent", [24, 2])
def test_jaccard_join(docs, none, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", frequent)
    assert sorted(tuple(r) for r in jaccard.similar_components(docs).collect()) == linked(docs)
    assert jaccard.similar_components(none).count() == 0
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({i for i, _, c in linked(docs) if i == c})


def test_jaccard_join_of_templates(spark, monkeypatch):
    """Many documents around one passage and chains of near copies, with every bucket compared in tiles."""
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    monkeypatch.setattr(jaccard, "TILE", 8)
    base = words(60, 5)
    r = random.Random(2)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(60)] = f"q{r.randrange(10**6)}"
        rows.append((i, " ".join(w + words(r.randrange(12), 100 + i)), "", "", 0, "", 0))
    d = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(x) for x in jaccard.similar_components(d).collect()) == linked(d)


def test_jaccard_join_with_null_and_repeated_ids(spark):
    a, b = words(40, 7), words(40, 8)
    bridge = a[:-4] + ["q1", "q2", "q3", "q4"]
    far = bridge[4:] + ["r1", "r2", "r3", "r4"]
    rows = [(1, " ".join(a)), (2, " ".join(far)), (None, " ".join(bridge)), (5, " ".join(b)), (5, " ".join(a)), (5, " ".join(b)), (8, " ".join(b)), (None, ""), (None, None), (9, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("m")).withColumn("_i", F.lit(1))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(d).collect())
    assert got == Counter([(1, 36, 1), (2, 36, 1), (None, 36, 1), (5, 36, 1), (5, 36, 5), (5, 36, 5), (8, 36, 5), (None, 0, None), (None, 0, None), (9, 1, 9)])
    kept = jaccard.drop_near_copies(d)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, " ".join(a)), (5, " ".join(b)), (None, ""), (None, None), (9, "x")])


def test_turns_share_the_keys_of_all_documents():
    texts = pa.array([" ".join(words(n, n)) for n in (3, 40, 300)])
    keys = lambda *turn: [k for b in jaccard._keys_pass(5, 75, np.zeros(0, np.uint64), *turn)(iter([pa.record_batch([texts], ["text"])])) for k in b.column(0).to_pylist()]
    parts = [keys(turn, jaccard.TURNS) for turn in range(jaccard.TURNS)]
    assert jaccard.TURNS > 1 and sorted(sum(parts, [])) == sorted(keys()) and max(map(len, parts)) < 0.8 * len(keys())


def test_near_copies_are_looked_up_once(spark, tmp_path):
    texts = [" ".join(words(60, max(i, 2))) for i in range(9)]
    spark.createDataFrame([(i, texts[i]) for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    kept = jaccard.drop_near_copies(spark.read.parquet(str(tmp_path / "docs")))
    assert kept._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/docs") == 1  # the filter's literal is in no plan twice
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(3, 9)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def test_classifiers_learn_and_keep_clean_documents(spark):
    r = random.Random(3)
    bad = ["idiot", "scumbag", "trashy"]
    rows, labels = [], []
    for i in range(500):
        w = words(60, 1000 + i, 3000)
        toxic, junk = i % 5 == 0, i % 4 == 1
        if toxic:
            w[r.randrange(60)] = r.choice(bad)
            w[r.randrange(60)] = r.choice(bad)
        if junk:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0, "x", 7))
        labels.append((i, int(not junk), int(toxic)))
    d = spark.createDataFrame([*rows, (900, None, "", "", 0, "", 0), (901, "", "", "", 0, "", 0)], DOCS)
    lab = spark.createDataFrame([*labels, (902, None, None)], "doc_id long, quality int, toxic int")
    for found, column, mod, rest in ((quality_model.score_documents(d, lab), 1, 5, 0), (toxicity.score_documents(d, lab), 2, 3, 1)):
        got = {x.doc_id: x for x in found.collect()}
        assert len(got) == 502 and all(0 <= x.score <= 1 for x in got.values())
        assert all(x.held_out == (zlib.crc32(str(i).encode()) % mod == rest) for i, x in got.items())
        held = [x for i, x in got.items() if x.held_out and i < 500]
        right = sum(x.predicted == labels[x.doc_id][column] for x in held)
        assert right >= 0.95 * len(held)
    assert toxicity.drop_toxic(d, lab).columns == d.columns
    assert quality_model.drop_low_quality(d, lab).count() > 300
    assert toxicity.score_documents(d, lab.limit(0)).where("predicted = 1").count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    d = spark.createDataFrame([(i, " ".join(words(20, i)), "", "", 0, "", 0) for i in range(60)], DOCS)
    lab = [(i, i % 2, i % 2) for i in range(60)]
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in lab]
    for f in (quality_model.score_documents, toxicity.score_documents):
        x, y = (sorted((r.doc_id, r.score) for r in f(d, spark.createDataFrame(p, "doc_id long, quality int, toxic int")).collect()) for p in (lab, flip))
        assert x == y


def test_label_model_trusts_agreeing_voters():
    p = toxicity.label_model({0: 900, 1: 30, 2: 30, 3: 40}, [0.9, 0.9])
    assert p[0] < 0.1 < 0.8 < p[1] <= p[3]


def test_features_do_not_depend_on_slices(monkeypatch):
    t = pa.array(["a b c a b", None, "x " * 100, "Z!! Z!!"])
    whole = [(i.tolist(), v.tolist()) for i, v in linear.feature_rows(t)]
    monkeypatch.setattr(linear, "SLICE_BYTES", 4096)
    assert whole == [(i.tolist(), v.tolist()) for i, v in linear.feature_rows(t)]


def test_pipeline_keeps_columns_and_runs(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    counts = [d.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.materialize(stage(spark, d, sf), name)
        assert d.columns == columns
        counts.append(d.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_more_voters_than_sixteen_of_both_sides(spark):
    r = random.Random(3)
    rude, polite = [f"rude{c}{d}" for c in "abcdefgh" for d in "xyzuv"], [f"kind{c}" for c in "abc"]
    rows = []
    for i in range(1800):
        w = words(20, 2000 + i, 900)
        toxic = i % 6 == 0
        w[r.randrange(20)] = rude[i // 6 % len(rude)] if toxic else polite[i % 3]
        rows.append((i, " ".join(w), float(toxic)))
    sample = spark.createDataFrame(rows, "_id long, text string, y double")
    voters, prior = toxicity.lexicon(sample)
    assert sum(v[2] > prior for v in voters) > 40 and any(v[2] < prior for v in voters)
    model = toxicity.fit_voters(sample, voters, prior, "text")
    votes = toxicity._flat(toxicity._votes(pa.array([*(f"w1 {x} w2" for x in rude), "w1 kinda w2", "nothing here", "w1 RUUUDE4X w2"]), voters))
    p = model.posterior(*votes)
    assert (p[:40] > 0.7).all() and p[40] < p[41] and 0 < p[41] <= prior and p[42] > 0.7


def plain_ftrl(rows, passes, alpha, beta, l1, l2):
    """Follow-the-regularised-leader as published, one coordinate at a time; coordinate 0 is the bias and has no l1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        limit = 0.0 if i == 0 else l1
        return 0.0 if abs(z[i]) <= limit else -(z[i] - (limit if z[i] > 0 else -limit)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for k in range(passes):
        for r in np.random.default_rng(k).permutation(len(rows)):
            index, value, label = rows[r]
            x = {0: 1.0, **{int(i) + 1: float(v) for i, v in zip(index, value, strict=True)}}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_the_plain_form():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(50, 6, replace=False)).astype(np.int32), rng.random(6).astype(np.float32), float(rng.integers(2))) for _ in range(60)]
    got = linear.Ftrl(alpha=0.3, l1=0.2).fit(rows, 2).weights()
    want = plain_ftrl(rows, 2, 0.3, 1.0, 0.2, 0.1)
    assert np.abs(got[: len(want)] - [want.get(i, 0.0) for i in range(len(want))]).max() < 1e-6 and (got[60:] == 0).all()


def test_scores_look_only_at_terms_with_weights():
    texts = pa.array([" ".join(words(200, 1)), None, "twice twice", "", " ".join(words(900, 2))])
    everything = [np.concatenate(x) for x in list(zip(*toxicity._hashed(texts), strict=True))[2:]]
    weights = np.zeros((1 << linear.BITS) + 1, np.float32)
    weights[0], weights[np.unique(everything[1])[::40] + 1] = -1, 0.25
    once = weights[1:] != 0
    useful = once | once[np.arange(1 << linear.BITS) ^ int(toxicity._TWICE & np.uint64((1 << linear.BITS) - 1))]
    looked_at = sum(len(x[3]) for x in toxicity._hashed(texts, useful))
    assert 0 < looked_at < len(everything[1]) / 8
    total = np.bincount(everything[0], weights[everything[1] + 1] * everything[2], 5) + weights[0]
    assert np.array_equal(toxicity.term_score(texts, weights), 1 / (1 + np.exp(-total)))


def test_scores_are_sparse_dot_products():
    texts = pa.array(["a b c a b", None, "", "Z!! z!! z", "a b c a b"])
    weights = np.random.default_rng(2).normal(size=(1 << linear.BITS) + 1).astype(np.float32)
    want = [1 / (1 + math.exp(-(float(weights[0]) + sum(float(weights[i + 1]) * float(v) for i, v in zip(index, value, strict=True))))) for index, value in linear.feature_rows(texts)]
    got = linear.score(texts, weights)
    assert np.abs(got - want).max() < 1e-4 and got[0] == got[4] and got[1] == got[2]


def test_label_model_equals_plain_expectation_maximisation():
    """Two voters of one side and one of the other, over rows with their counts; every sum written out."""
    rows = [((0,), 30), ((1,), 25), ((0, 1), 20), ((2,), 60), ((0, 2), 4), ((), 300)]
    first, prior = [0.8, 0.7, 0.02], 0.2
    model = toxicity.LabelModel(first, prior)
    at, ends, n = np.array([v for votes, _ in rows for v in votes]), np.cumsum([0, *[len(v) for v, _ in rows]]), np.array([float(c) for _, c in rows])
    base = math.log(prior / (1 - prior))
    share, corr, shift = list(first), {}, 0.0
    toxic = [s >= prior for s in first]
    for _ in range(3):
        post = []
        for votes, _c in rows:
            total = sum((math.log(share[i] / (1 - share[i])) - base) / (1 + sum(corr.get((min(i, j), max(i, j)), 0.0) for j in votes if j != i)) for i in votes)
            post.append(1 / (1 + math.exp(-(base + shift + total))))
        assert np.abs(model.posterior(at, ends) - post).max() < 1e-9
        model.update(*model.sums(at, ends, n))
        counts = [c for _, c in rows]
        seen = [sum(c for (v, _), c in zip(rows, counts, strict=True) if i in v) for i in range(3)]
        right = [sum(c * p for (v, _), c, p in zip(rows, counts, post, strict=True) if i in v) for i in range(3)]
        everyone, weight = sum(counts), sum(c * p for c, p in zip(counts, post, strict=True))
        share = [min(max((right[i] + toxicity.DAMP * first[i]) / (seen[i] + toxicity.DAMP), prior if toxic[i] else 1e-3), 0.999 if toxic[i] else prior) for i in range(3)]
        both = sum(c * p for (v, _), c, p in zip(rows, counts, post, strict=True) if 0 in v and 1 in v)
        rate = [right[i] / weight for i in (0, 1)]
        corr = {(0, 1): min(max((both / weight - rate[0] * rate[1]) / math.sqrt(rate[0] * (1 - rate[0]) * rate[1] * (1 - rate[1])), 0), 1)}
        mean = weight / everyone
        shift += base - math.log(mean / (1 - mean))
    assert corr[0, 1] > 0


def test_votes_that_speak_together_are_taken_in_bounded_runs(monkeypatch):
    r = np.random.default_rng(5)
    sizes = [0, 1, 300, 2, 0, 40, 1, 7]
    ends = np.cumsum([0, *sizes])
    at = np.concatenate([np.sort(r.permutation(400)[:k]) for k in sizes])
    n = r.integers(1, 9, len(sizes)).astype(float)
    want = [(int(i), int(j)) for x, y in zip(ends[:-1], ends[1:], strict=True) for i in range(x, y) for j in range(x, y) if i != j]
    found = []
    for size in (1 << 30, 1000, 1):
        monkeypatch.setattr(toxicity, "PAIRS", size, raising=False)
        runs = list(toxicity._together(ends))
        assert [p for _, _, a, b in runs for p in zip(a.tolist(), b.tolist(), strict=True)] == want
        assert all(len(a) <= max(size, max(sizes)) for _, _, a, _ in runs)
        model = toxicity.LabelModel(r.permutation(400) / 400 if not found else shares, 0.2)
        shares = model.first
        for _ in range(2):
            model.update(*model.sums(at, ends, n))
        found.append(model.posterior(at, ends))
    assert all(np.abs(p - found[0]).max() < 1e-9 for p in found) and len(model.pairs)


def test_terms_take_little_memory_beside_the_texts():
    texts = pa.array([" ".join(f"Word{i * k % 9973} l0ud" for i in range(500)) for k in range(1, 300)])  # some 2 MB
    list(toxicity._terms(texts.slice(0, 1)))
    tracemalloc.start()
    for _ in toxicity._terms(texts):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6


def test_workers_let_go_of_what_earlier_stages_kept():
    """Workers outlive a stage of the pipeline; what they keep for its tasks must not stay during the next ones."""
    texts = pa.array(["some words", None])
    for kernel in (toxicity.term_features, linear.feature_rows, textops.word_hashes):
        tokens.encoder(tokens.default_tokenizer()).encode("some words")
        assert tokens.encoder(tokens.default_tokenizer()) is tokens.encoder(tokens.default_tokenizer())
        list(kernel(texts))
        assert not tokens._loaded
        decontaminate._automaton("part", [("a", b"some words")], 2)
        assert decontaminate._automaton("part", [], 2).hits(b"some words")[2] == {"a"}
        list(kernel(texts))
        assert not decontaminate._kept
    decontaminate._automaton("part", [("a", b"some words")], 2)
    tokens.encoder(tokens.default_tokenizer())
    assert tokens._loaded and not decontaminate._kept
    decontaminate._automaton("part", [("a", b"some words")], 2)
    assert decontaminate._kept and not tokens._loaded


def test_classifiers_of_empty_and_repeated_rows(spark, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("fine words here " if i % 2 else "awful things there ") + f"n{i}", "", "", 0, "kept", 0) for i in range(40)]
    d = spark.createDataFrame([*rows, rows[3], (None, None, "", "", 0, "kept", 0), (77, "", "", "", 0, "kept", 0), (78, rows[5][1], "", "", 0, "kept", 0)], DOCS).withColumn("_score", F.lit(5))
    for score, drop in ((quality_model.score_documents, quality_model.drop_low_quality), (toxicity.score_documents, toxicity.drop_toxic)):
        assert score(none, labels).count() == 0 and drop(none, labels).count() == 0
        got = score(d, labels).collect()
        assert len(got) == 44 and len({r.score for r in got if r.doc_id == 3}) == 1
        by = {r.doc_id: r.score for r in got}
        assert by[5] == by[78] and by[77] == by[None]
        kept = drop(d, labels)
        assert kept.columns == d.columns and {r["_score"] for r in kept.select("_score").distinct().collect()} <= {5}


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Null and empty texts, repeats, extra columns and an empty table pass every stage; each stage against its rule."""
    import corpus_pipeline

    base = words(60, 1)
    rows = [(1, " ".join(base), "x"), (2, " ".join(base[:-1] + ["zz"]), "x"), (3, None, "x"), (4, "", "x"), (None, "some other words stand here", "x"), (5, " ".join(words(50, 9) + words(12, 33)), "x"), (1, " ".join(base), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _score string").withColumn("mark", F.lit(1))
    spark.createDataFrame([("b", " ".join(words(12, 33)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {"toxicity": 7, "quality_classifier": 7, "ngram_jaccard_join": 5, "benchmark_decontamination": 4}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d2 = corpus_pipeline.materialize(stage(spark, d, str(tmp_path)), name)
        assert d2.columns == d.columns and d2.count() == want[name], name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
        d = d2
    assert Counter(r.doc_id for r in d.collect()) == Counter([1, 3, 4, None])
    packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter([1, 3, 4, None]) and len({r.sequence_id for r in packed}) == 1


def test_keys_are_dealt_to_parts_that_grow_with_the_sets(spark, monkeypatch):
    texts = [" ".join(words(60, max(i, 2))) for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, given, bucketed = sorted(jaccard.similar_components(docs).collect()), [], jaccard._bucketed
    monkeypatch.setattr(jaccard, "_bucketed", lambda keys: given.append(keys.rdd.getNumPartitions()) or bucketed(keys))
    monkeypatch.setattr(jaccard, "KEYS_A_TASK", 8)
    assert sorted(jaccard.similar_components(docs).collect()) == want
    shingles = sum(r.n_shingles for r in want)
    assert given == [-(-shingles // (2 * jaccard.TURNS * 8))] * jaccard.TURNS and given[0] > 4  # the session shuffles into 4
