"""Fingerprints, manifests and vector codes against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlake.llm import fingerprints, fixity, linear, merkle_manifest, quality_model, toxicity, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, idx int, guest string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(("alpha", "béta", "gamma", "delta", "xi", "𝛑𝛒")) + str(r.randrange(90)) for _ in range(n))
    out = [None, "", "a", "ab\n\nc", "same text here " * 9, "same text here " * 9, " \n ", "x" * 400, prose(30000)]
    return out + [prose(r.randrange(1, 400)) + "\n" * (i % 3) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 71, t, "en" if i % 5 else None, None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "h", 1, "g") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[12], (None, "no id " * 20, "en", "s1", 3, "h", 1, "g"), (None, None, None, None, None, "h", 1, "g"), (5, "twice", "de", "lone", 1, "h", 1, "g")]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text)
    return {x[i : i + 12] for i in range(max(1, len(x) - 11))} if x else set()


def test_sketches_hold_all_small_hashes_whatever_is_hashed_together(texts, monkeypatch):
    texts = [t or "" for t in texts]
    hashes, offsets = fingerprints.sketches(texts)
    own = [hashes[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for t, s in zip(texts, own, strict=True):
        every = {s: int(fingerprints._hashes(np.array([ord(c) for c in s.ljust(12, chr(0x10FFFF))], np.uint32))[0]) for s in shingles(t)}
        small = sorted(h for h in every.values() if h < fingerprints.LIMIT)
        assert s == (small if len(small) >= fingerprints.LEAST else sorted(every.values())[: fingerprints.LEAST])
    assert [fingerprints.read(w.as_py()).tolist() for w in fingerprints.written(hashes, offsets)] == own
    monkeypatch.setattr(fingerprints, "SLICE_CHARS", 100)
    again, cuts = fingerprints.sketches(texts)
    assert again.tolist() == hashes.tolist() and cuts.tolist() == offsets.tolist()


def test_containment_of_unequal_texts_and_merging():
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(100000)}" for _ in range(60000))
    other = " ".join(f"w{r.randrange(100000)}" for _ in range(6000))
    part = long[1000:9000] + other[:8000]
    one = lambda t: fingerprints.sketches([t])[0]
    a, b = one(part), one(long)
    in_long, in_part, jaccard = fingerprints.containment(a, b)
    assert abs(in_long - 0.5) < 0.1 and abs(in_part - 8000 / len(long)) < 0.01 and jaccard < 0.03
    assert fingerprints.containment(a, a) == (1.0, 1.0, 1.0) and fingerprints.containment(one(""), one("")) == (1.0, 1.0, 1.0)
    assert fingerprints.containment(one(""), a) == (0.0, 0.0, 0.0)
    for x, y in ((part, long), ("few words", "other words of few"), (part, "few words"), ("", part)):
        apart = set(one(x).tolist()) | set(one(y).tolist())
        whole = fingerprints.merged(one(x), one(y)).tolist()
        assert set(whole) <= apart and whole == sorted(whole) and (len(whole) >= fingerprints.LEAST or set(whole) == apart)
        assert fingerprints.merged(one(y), one(x)).tolist() == whole


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours_against_brute_force(spark, docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = fingerprints.compare_neighbours(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    rows = [(r.doc_id, r.text or "", h.h) for r, h in zip(docs.collect(), docs.selectExpr("xxhash64(coalesce(text, '')) h").collect(), strict=True)]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = []
    for (i, t, _), (_, n, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        f, e, x = (fingerprints.sketches([v])[0] for v in (t, edited, n))
        shown = [w.as_py() for v in (f, e) for w in fingerprints.written(v, np.array([0, len(v)]))]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *shown, max(fingerprints.containment(f, e)[:2]), max(fingerprints.containment(f, x)[:2])))
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r)[:7] for r in got) == order(want)
    assert all(r.near_edited == 1 for r in got if r.n_chars < 3)


def test_neighbours_of_few_rows_and_fingerprints_of_rows(spark, docs):
    assert fingerprints.compare_neighbours(docs.limit(0)).collect() == []
    (one,) = fingerprints.compare_neighbours(docs.where("text like 'no id%'")).collect()
    assert one.doc_id is None and one.near_next == 1.0 and one.n_chars == 120
    same = spark.createDataFrame([(7, "equal rows " * 30)] * 40, "doc_id long, text string")
    assert {r.near_next for r in fingerprints.compare_neighbours(same).collect()} == {1.0} and fingerprints.compare_neighbours(same).count() == 40
    found = fingerprints.fingerprint_documents(docs)
    assert found.columns == [*docs.columns, "fingerprint"] and found.count() == docs.count()
    pairs = found.selectExpr("fingerprint a", "lag(fingerprint) over (order by doc_id, n_chars, text) b").select(fingerprints.contained("a", "b").alias("c"), "a", "b").collect()
    assert all((r.c.a_in_b, r.c.b_in_a, r.c.jaccard) == fingerprints.containment(fingerprints.read(r.a), fingerprints.read(r.b or "")) for r in pairs)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(leaves, arity):
    """(root, proofs): of each leaf, the (left, right) of every level."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k - k % arity
            proofs[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + arity])))
        level = [digest(*level[k : k + arity]) for k in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], proofs


def leaf_of(row, text):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*map(shown, (row.doc_id, row.source, row.lang, row.n_chars, text)))


def test_manifest_against_brute_force(docs):
    got = sorted(tuple(r) for r in merkle_manifest.audit(docs).collect() if r.doc_id is not None)
    rows, groups = docs.collect(), defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], 3) for s in names}
    root, above = grown([trees[s][0] for s in names], 3)
    want = []
    for s, up in zip(names, above, strict=True):
        for (_, _, leaf, r), own in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            lost = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            folded = leaf_of(r, r.text.replace("\n", "")) if lost else leaf
            for left, right in own + up:
                folded = digest(left, folded, right)
            if r.doc_id is not None:
                want.append((r.doc_id, leaf, trees[s][0], root, digest(*(x for pair in own + up for x in pair)), folded, folded == root))
    assert got == sorted(want) and any(not x[-1] for x in got) and any(x[-1] for x in got)


def test_manifests_of_any_arity_and_of_few_rows(spark, docs):
    assert merkle_manifest.audit(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(1, "a\nb", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle_manifest.audit(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest()
    rows = spark.createDataFrame([(i, digest(str(i)), "g" if i % 3 else "other") for i in range(37)], "k int, leaf string, name string")
    for arity in (2, 4):
        found = merkle_manifest.manifest(rows, "name", ["k"], arity).collect()
        parts = {n: [digest(str(i)) for i in range(37) if ("g" if i % 3 else "other") == n] for n in ("g", "other")}
        subroots = [grown(parts[n], arity)[0] for n in ("g", "other")]
        assert len(found) == 37 and {r.root for r in found} == {grown(subroots, arity)[0]} and {r.subroot for r in found} == set(subroots)
        for r in found:
            assert [tuple(s) for s in r.steps[:-1]] == grown(parts[r.name], arity)[1][parts[r.name].index(digest(str(r.k)))]


def coded(rows):
    """Codes by plain nearest entries: rows of (key, vector, label)."""
    rows = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(first[0][1])
    rows, per = [r for r in rows if len(r[1]) == width], -(-width // 4)
    cut = lambda v: [(v + [0] * (4 * per - width))[p * per : p * per + per] for p in range(4)]
    x = np.array([cut(r[1]) for r in rows], dtype=object).astype(np.int64)
    books = np.array([cut(r[1]) for r in first if len(r[1]) == width][:256], np.int64).transpose(1, 0, 2).copy()

    def assign(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        new = books.copy()
        for p in range(4):
            at = assign(p)[0]
            for e in set(at.tolist()):
                new[p, e] = x[at == e, p].sum(axis=0) // (at == e).sum()
        books = new
    found = [assign(p) for p in range(4)]
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    errors = sum(f[1] for f in found)
    totals = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        totals[r[2]] += int(e)
    return sorted(((r[0], bytes(int(f[0][i]) for f in found).hex(), int(errors[i]), totals[r[2]], sha) for i, r in enumerate(rows)), key=repr)


def vectors(n, width, seed, far=0.3):
    r = np.random.default_rng(seed)
    middle = r.normal(0, far, (9, width))
    return (middle[r.integers(0, 9, n)] + r.normal(0, 0.08, (n, width))).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize(("n", "width"), [(900, 16), (40, 8), (300, 10)])
def test_vector_codes_against_brute_force(spark, n, width):
    rows = [(i, v, i % 5 if i % 11 else None) for i, v in enumerate(vectors(n, width, n))]
    rows += [(n + 1, None, 1), (n + 2, [None] * width, 1), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] + [0.0] * (width - 1), None), (None, rows[3][1], 2), rows[5], (n + 5, [0.5], 1), (n + 6, [], 1), (5, [9.0] * width, 3)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, ints int")
    got = sorted((tuple(r) for r in vector_codes.compress(table).collect()), key=repr)
    assert got == coded([r for r in rows if r[1] != []])


def test_nearest_entries_are_exact_with_ties_and_far_points(monkeypatch):
    monkeypatch.setattr(vector_codes, "PAIRS", 50)
    r = np.random.default_rng(0)
    for m in (1, 3, 64, 65, 256):
        entries = r.integers(-6, 7, (m, 5))
        x = np.concatenate([r.integers(-9, 10, (300, 5)), [[vector_codes.LIMIT] * 5, [-vector_codes.LIMIT] * 5]])
        least, entry = vector_codes.Slices(entries).nearest(x)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert entry.tolist() == d.argmin(axis=1).tolist() and least.tolist() == d.min(axis=1).tolist()
        inside = (np.abs(x[:, None, :] - entries[None]) <= 4).all(axis=2)
        masks = vector_codes.Slices(entries).candidates(x, np.full(len(x), 4))
        assert (np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool) == inside).all()


def test_vector_codes_of_an_empty_table_and_many_labels(spark, monkeypatch):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty).collect() == [] and vector_codes.compress(spark.createDataFrame([(1, [], 2)], empty.schema)).collect() == []
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.2)
    rows = [(i, v, 0 if i % 3 else i) for i, v in enumerate(vectors(90, 4, 2))]
    got = sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, empty.schema)).collect()), key=repr)
    assert got == coded(rows)


def test_features_of_long_texts_do_not_see_where_they_are_cut(monkeypatch):
    r = random.Random(4)
    words = ["stop", "stop", "ab", "sooooo", "b4d", "LOUD", "é", "naïve", "don't", "x!y", "--", "w" * 30]
    texts = [" ".join(r.choice(words) + ("\n" if r.random() < 0.1 else "") for _ in range(n)) for n in (3, 400, 900)] + ["", "no", "y " * 300]
    sets = lambda rows: [dict(zip(i.tolist(), v.tolist(), strict=True)) for i, v in rows]
    whole = [sets(f(pa.array(texts))) for f in (linear.feature_rows, toxicity.term_features)]
    trigrams = [sorted(zip(o.tolist(), i.tolist(), v.tolist(), strict=True)) for _, _, o, i, v in linear.features(pa.array(texts[1:2]), 3)]
    for size in (16, 37, 64):
        monkeypatch.setattr(linear, "SLICE_BYTES", size)
        monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
        assert [sets(f(pa.array(texts))) for f in (linear.feature_rows, toxicity.term_features)] == whole
        assert [sorted(zip(o.tolist(), i.tolist(), v.tolist(), strict=True)) for _, _, o, i, v in linear.features(pa.array(texts[1:2]), 3)] == trigrams


def test_raised_features_and_the_bytes_of_samples(spark, monkeypatch):
    rows = [(i, ("bad " if i % 4 == 0 else "good ") + f"w{i} common " * 3, 1.0 if i % 4 == 0 else 0.0) for i in range(60)] + [(3, "another text", 0.0)]
    sample = quality_model.within_bytes(spark.createDataFrame(rows, "_id long, text string, y double"))
    assert sample.count() == 60
    weights = quality_model.fit(sample, raised_in=3)
    kept = np.flatnonzero(weights[1:])
    bad = next(linear.feature_rows(pa.array(["bad"])))[0]
    common = next(linear.feature_rows(pa.array(["common"])))[0]
    assert bad[0] in kept and common[0] not in kept and len(kept) <= 4
    monkeypatch.setattr(quality_model, "SAMPLE_BYTES", 500)
    few = quality_model.within_bytes(spark.createDataFrame(rows, "_id long, text string, y double")).collect()
    assert 0 < sum(len(r.text) for r in few) <= 500


def test_fixity_compares_only_the_branches_of_the_damage(spark, monkeypatch):
    for name, value in (("FANOUT", 4), ("PER_ARCHIVE", 64)):
        monkeypatch.setattr(fixity, name, value)
    shape = "page_id long, url string, html string"
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * (i % 5)) for i in range(3200)], shape)
    levels = lambda rows: fixity.tree(fixity.archive_index(rows))
    ours = levels(pages)
    for copy in (pages.where("page_id <> 1000"), pages.withColumn("html", F.when(F.col("page_id") == 1000, "longer than it was before").otherwise(F.col("html")))):
        roots, middle, leaves = (x.count() for x in fixity.descend(ours, levels(copy)))
        # 50 roots, 4 and 4 children were compared, of 800 leaves
        assert (roots, middle, leaves) == (1, 1, 1)
    hot = spark.createDataFrame([(7, f"u{i % 900}", f"{i % 900}") for i in range(1000)] + [(8, "same", "same")] * 300, shape)
    before, after = fixity.archive_index(hot), fixity.archive_index(hot.where("url <> 'u500'"))
    assert before.select("volume").distinct().count() == 32
    one = fixity.descend(fixity.tree(before), fixity.tree(after))[-1]
    assert one.count() <= 32 and [(r.key, r.status) for r in fixity.audit(before, after).collect()] == [(7, "missing")]
    few = spark.createDataFrame([(7, f"u{i}", f"{i}") for i in range(1000)], shape)
    assert fixity.descend(levels(few), levels(few.where("url <> 'u500'")))[-1].count() == 1


def test_stretches_are_kept_by_words_and_give_the_ids_of_whole_texts():
    import random

    from barlake.llm import tokens

    e = tokens.Encoder(tokens.default_tokenizer())
    draw, parts = random.Random(3), ["the", "Word", "é", "ßa", "œuvre", "×", "ª", ",", ".", "!?;", "....", "%%%", "'s", "don't", "\n", "\n\n", " ", "\t", "\r\n", "\xa0", "12", "a1", "<|", "日本", "\x1c", "😀", "A.\nB", "x\n's"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) + draw.choice([" ", "", "\n"]) for _ in range(draw.randint(1, 9)))
        assert e.encode(text) == e._whole(text), text
    fresh = tokens.Encoder(tokens.default_tokenizer())
    assert fresh.encode("go onward.\nBeyond, words") == fresh._whole("go onward.\nBeyond, words")
    assert {"onward", "words"} == set(fresh.stretches) and "Beyond" in fresh.stretches.after_line


def test_release_deletes_shuffle_files_of_finished_steps(spark):
    import glob
    import time

    from barlake.llm import shared

    files = lambda: set(glob.glob("/tmp/blockmgr-*/*/shuffle_*.data"))
    before = files()
    shared.materialize(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count(), "released")
    made = files() - before
    assert made
    shared.release(spark)
    for _ in range(100):
        if not made & files():
            break
        time.sleep(0.1)
    assert not made & files()
