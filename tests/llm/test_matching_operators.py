"""Language, near duplicates, decontamination and licenses against brute force; the pipeline."""

import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canasta.llm import decontamination, language, licenses, near
from canasta.llm.words import word_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def classes_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(g) for g in groups.values()}


# --- language -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 20 and right / n >= 0.95


def longest_matches(text, train):
    """Phrases of a greedy parse by plain substring search."""
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in train:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


def test_automaton_counts_the_phrases_of_a_greedy_parse():
    samples = {"a": "the cat sat on the mat and the hat", "b": "der hut und die katze auf der matte"}
    model = language.Model(samples)
    texts = ["the hat and the cat", "die matte und der hut", "zzz", "q", "katze the mat" * 60]
    got = model.phrases([language._folded(t) for t in texts])
    for i, text in enumerate(texts):
        for j, lang in enumerate("ab"):
            cut = [text[k : k + language.PIECE] for k in range(0, len(text), language.PIECE)]
            assert got[i, j] == sum(longest_matches(c, samples[lang]) for c in cut)


def test_texts_without_letters_are_unknown(spark, corpus, odd, empty):
    rows = {r["doc_id"]: r for r in language.identify(corpus, language.fit(corpus)).collect()}
    assert {d for d, r in rows.items() if r["lang_pred"] == "und"} == {80, 81, 82, 88}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    model = language.fit(odd)
    assert language.identify(odd, model).count() == odd.count()
    assert language.known_language(odd, model).columns == odd.columns
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identify(corpus, language.fit(empty)).collect()} == {"und"}


def test_the_stage_drops_texts_without_letters_alone(spark, corpus, empty):
    """Also with nothing to learn from, with held-out labels only, and with a language named as the unknown one."""
    letters = corpus.where(F.col("text").rlike(r"\p{L}")).count()
    named = corpus.withColumn("lang", F.lit("und"))
    held = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "en"))
    for docs in (corpus, corpus.withColumn("lang", F.lit(None).cast("string")), named, held):
        assert language.known_language(docs, language.fit(docs)).count() == letters
    assert language.known_language(empty, language.fit(empty)).count() == 0


# --- near duplicates ------------------------------------------------------------------------------


def brute_classes(corpus, idf):
    """Components of all pairs at the threshold."""
    import pyarrow as pa

    rows = sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()))
    vectors = {}
    for at, _, words in word_chunks(pa.array([t for _, t in rows])):
        doc, value, weight = near.weighted_shingles(words, idf)
        for d, v, w in zip(doc.tolist(), value.tolist(), weight.tolist(), strict=True):
            vectors.setdefault(rows[at + d][0], {})[v] = w
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    text = dict(rows)
    for a, b in combinations(parent, 2):
        linked = text[a] == text[b]
        if not linked and a in vectors and b in vectors:
            va, vb = vectors[a], vectors[b]
            low = sum(min(va[k], vb[k]) for k in va.keys() & vb.keys())
            linked = low >= 0.8 * (sum(va.values()) + sum(vb.values()) - low) - 1e-9
        if linked:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for d in parent:
        groups.setdefault(root(d), set()).add(d)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("small, leaders", [(1000, 16), (1, 16), (1, 0)])
def test_classes_are_those_of_all_pairs(corpus, small, leaders, monkeypatch):
    """All pairs of a bucket, leaders and the prefix filter, and the prefix filter alone."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "LEADERS", leaders)
    idf, total = near.document_frequencies(corpus)
    assert total == corpus.count()
    got = near.near_duplicates(corpus).collect()
    assert classes_of(got) == brute_classes(corpus, idf)
    assert all(r["class_id"] == min(g) for g in classes_of(got) for r in got if r["doc_id"] in g)


def test_prefix_filter_loses_no_pair(spark):
    """A large group of edited copies around the threshold: candidates hold every link and few other pairs."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(60)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf, _ = near.document_frequencies(docs)
    signed = near.signatures(docs, idf)
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text").dropDuplicates(["node"])
    found = near.prefix_pairs(signed.select("node", F.col("node").alias("class")), texts, idf, 0.8)
    got = {(bytes(r["a"]), bytes(r["b"])) for r in found.collect()}
    nodes = [bytes(r["node"]) for r in texts.select("node").orderBy("node").collect()]
    every = spark.createDataFrame(list(combinations(nodes, 2)), "a binary, b binary")
    links = {(bytes(r["a"]), bytes(r["b"])) for r in near.similar_pairs(every, texts, idf, 0.8).collect()}
    assert links and links <= got
    assert len(got) < 0.5 * len(nodes) * (len(nodes) - 1) / 2


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(5)
    value = rng.integers(1, 2**63, 300).astype(np.uint64)
    weight = rng.uniform(0.5, 4, 300)
    other = weight * np.where(rng.random(300) < 0.3, 0.2, 1)
    expected = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    hits = 0
    for turn in range(60):
        shifted = value + np.uint64(turn * 7919)
        a = near.bands_of(np.zeros(300, int), shifted, weight, 1)
        b = near.bands_of(np.zeros(300, int), shifted, other, 1)
        hits += int((a == b).sum())
    share = hits / (60 * near.BANDS)
    assert share == pytest.approx(expected**near.ROWS, abs=0.08)


def test_one_of_each_class_stays(odd, empty):
    kept = near.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = near.near_duplicates(odd)
    assert rows.count() == odd.count()
    assert kept.count() == rows.select("class_no").distinct().count()
    assert near.one_of_each(empty).count() == 0


# --- decontamination ------------------------------------------------------------------------------


def plain(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_leaks(docs, items, threshold=0.8):
    found = set()
    for item, item_text in items:
        words = plain(item_text)
        if not words:
            continue
        k = min(5, len(words))
        own = shingles(words, k)
        for doc, text in docs:
            body = plain(text)
            for at in range(max(1, len(body) - len(words) + 1)):
                part = shingles(body[at : at + len(words)], k)
                low = sum((own & part).values())
                if low and low >= threshold * sum((own | part).values()) - 1e-9:
                    found.add((doc, item))
    return found


def test_leaks_are_those_of_all_windows(spark, corpus, benchmark):
    docs = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    text = dict(docs)[5].split()[:20]
    edited = " ".join([*text[:8], "changed", *text[9:]]).upper() + " tail of other words"
    more = corpus.union(spark.createDataFrame([(200, "lead " + edited, "en", "s", 1), (201, " ".join(text[:10]), "en", "s", 1)], corpus.schema))
    docs = [(r["doc_id"], r["text"]) for r in more.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(more, benchmark).collect()}
    expected = brute_leaks(docs, [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert got == expected and (5, 0) in got and (83, 4) in got


def best_window(text, item_text):
    """(similarity, first word) of the best of all windows, the first of equally good ones."""
    words, body = plain(item_text), plain(text)
    k = min(5, len(words))
    own, best = shingles(words, k), (0.0, 0)
    for at in range(max(1, len(body) - len(words) + 1)):
        part = shingles(body[at : at + len(words)], k)
        best = max(best, (sum((own & part).values()) / sum((own | part).values()), -at))
    return best[0], -best[1]


def test_leaks_in_another_order_are_found(spark):
    """Displaced halves, and repeats whose counts outweigh the shared shingles' squares."""
    a, b = [f"a{i}" for i in range(22)], [f"b{i}" for i in range(22)]
    lead, tail = [f"l{i}" for i in range(60)], [f"t{i}" for i in range(60)]
    common = [f"c{i}" for i in range(164)]
    items = [(0, a + b), (1, common + ["x"] * 16)]
    docs = [
        (0, lead + b + a + tail),
        (1, b + a),
        (2, lead + b[:20] + ["new"] + a + tail),
        (3, lead + b + tail + a),
        (4, lead + common + ["y"] * 16 + tail),
        (5, lead + b + a + a[:9] + b + a + tail),
    ]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    rows = decontamination.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["first_word"]) for r in rows}
    every = {(d, i): best_window(" ".join(w), " ".join(v)) for d, w in docs for i, v in items}
    assert got == {pair: best for pair, best in every.items() if best[0] >= 0.8 - 1e-9}
    assert {(0, 0), (1, 0), (4, 1), (5, 0)} <= got.keys() and (3, 0) not in got


def test_fingerprints_within_the_radius_meet(spark):
    a, b = 0x0123456789ABCDEF, 0x0123456789ABCDEF
    for bit in (0, 1, 9, 10, 17, 18, 25, 26, 33, 34, 41, 42, 49, 50, 57, 58, 2, 11, 19, 27, 35, 43, 51):
        b ^= 1 << bit
    df = spark.createDataFrame([(a, b)], "a long, b long")
    blocks = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: decontamination._block(c, n))
    near_by = F.exists(
        F.arrays_zip(blocks("a").alias("x"), blocks("b").alias("y")),
        lambda z: F.bit_count(z["x"].bitwiseXOR(z["y"])) <= decontamination.RADIUS // decontamination.BLOCKS,
    )
    assert df.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("n"), near_by.alias("met")).first().asDict() == {"n": 23, "met": True}


def test_clean_rows_stay_with_all_columns(spark, odd, empty, benchmark):
    kept = decontamination.without_benchmark(odd, benchmark)
    assert kept.columns == odd.columns
    leaked = decontamination.contaminated(odd, benchmark)
    assert kept.count() == odd.count() - leaked.select("doc_id", "mark").join(odd.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")), "mark", "left").select("mark").distinct().count()
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(odd, benchmark.limit(0)).count() == 0


# --- licenses -------------------------------------------------------------------------------------


def folded(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def test_licenses_in_texts(spark):
    rng = np.random.default_rng(1)
    filler = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    docs, expected = [], set()
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        docs.append((i, f"{filler(30)}\n{text.upper()} {filler(3)}"))
        docs.append((100 + i, text))
        expected |= {(i, name), (100 + i, name)}
    docs += [(300, filler(500)), (301, None), (302, ""), (303, "Licensed under")]
    got = {(r["doc_id"], r["license"]) for r in licenses.find_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert expected <= got
    for doc, name in got - expected:  # a template inside another one's words
        words = folded(licenses.TEMPLATES[name])
        pairs = set(zip(words, words[1:]))
        own = folded(dict(docs)[doc])
        assert len(pairs & set(zip(own, own[1:]))) >= 0.8 * len(pairs)
    assert not {d for d, _ in got} & {300, 301, 302, 303}


def brute_licenses(text, templates, threshold=0.8):
    """license -> (containment, first word) over all windows of the definition."""
    found, body = {}, folded(text)
    pairs = list(zip(body, body[1:]))
    for name, template in templates.items():
        words = folded(template)
        own, width = set(zip(words, words[1:])), len(words) + 2 * (len(words) // 4) - 1
        for at in range(len(pairs)):
            share = len(own & set(pairs[at : at + width])) / len(own)
            if share >= threshold - 1e-9 and share > found.get(name, (0.0, 0))[0]:
                found[name] = share, next(i for i in range(at, len(pairs)) if pairs[i] in own)
    return found


def test_edited_and_truncated_notices_are_those_of_all_windows(spark):
    rng = np.random.default_rng(3)
    filler = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    docs = ["Licensed under the Apache License, Version 2.", "Licensed under", "all rights reserved", "x"]
    for text in licenses.TEMPLATES.values():
        words = folded(text)
        for turn in range(24):
            edited = list(words)
            for _ in range(turn % 5):
                at = int(rng.integers(0, len(edited) + 1))
                edited[at : at + int(rng.integers(0, 2))] = filler(int(rng.integers(0, 3)))
            cut = edited[turn % 3 : len(edited) - turn % 2]
            half = len(cut) // 2
            cut = cut[half:] + cut[:half] if turn % 6 == 5 else cut
            docs.append(" ".join(cut if turn % 4 == 0 else [*filler(turn), *cut, *filler(9), *(words if turn == 23 else [])]))
    rows = licenses.find_licenses(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]): (pytest.approx(r["containment"]), r["first_word"]) for r in rows}
    expected = {(i, name): best for i, text in enumerate(docs) for name, best in brute_licenses(text, licenses.TEMPLATES).items()}
    assert got == expected and (0, "Apache-2.0") in got and len(got) == len(rows)


def test_license_edge_cases(odd, empty):
    assert licenses.find_licenses(odd).count() == 0
    assert licenses.find_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.Index({"x": "word"})


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() == out.select("doc_id").distinct().count() > 0.8 * docs.count()
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_of_odd_and_unlabelled_tables(spark, odd, empty):
    """Null ids, repeated rows and clashing columns go through all stages; labels are not needed."""
    import corpus_pipeline

    for docs, some in ((odd, True), (odd.withColumn("lang", F.lit(None).cast("string")), True), (empty, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "token_output":
                assert out.columns == odd.columns, name
                docs = materialized(out)
            assert (out.count() > 0) == some, name


def materialized(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_many_copies_of_an_item_in_one_document(spark):
    """A long document that repeats an item costs little more than one that holds it once."""
    rng = np.random.default_rng(3)
    item = " ".join(f"w{i}" for i in rng.permutation(300))
    docs = spark.createDataFrame(
        [(1, " ".join([item] * 60)), (2, f"before {item} after"), (3, "ha " * 9000), (4, "clean words only")], "doc_id long, text string"
    )
    bench = spark.createDataFrame([(7, item), (8, "ha " * 250)], "item_id long, text string")
    start = time.monotonic()
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["similarity"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 7, 0, 1.0), (2, 7, 1, 1.0), (3, 8, 0, 1.0)}
    assert time.monotonic() - start < 90
