"""Sharding, token files, mixing, substring dedup and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from canasta.llm import mixing, recompression, repeats, sharding, suffixes, syncmers, tokens
from canasta.llm.shared import folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- sharding -------------------------------------------------------------------------------------


def test_shards_are_gapless_and_only_the_new_shard_gains(corpus):
    rows = rows_of(sharding.shard_documents(corpus, sharding.balanced(5, 2, 2)))
    assert len(rows) == corpus.count()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    moved = {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]}
    assert moved <= {5}
    texts = {r["doc_id"]: r["text"] or "" for r in corpus.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_weights_decide_shares_and_moves_stay_in_the_changed_region(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = [sharding.Shard(0, 0, 0, 1.0), sharding.Shard(0, 1, 1, 2.0), sharding.Shard(1, 2, 2, 3.0)]
    heavier = [*tree[:2], sharding.Shard(1, 2, 2, 5.0)]
    both = sharding.place(sharding.place(ids, "doc_id", tree), "doc_id", heavier, "after")
    counts = {(r["shard"], r["after"]): r["count"] for r in both.groupBy("shard", "after").count().collect()}
    before = Counter()
    for (s, _), n in counts.items():
        before[s] += n
    assert [round(before[s] / 20000, 2) for s in range(3)] == pytest.approx([1 / 6, 2 / 6, 3 / 6], abs=0.02)
    assert all(s == a or a == 2 for s, a in counts)


@pytest.mark.parametrize("bad", [[], [sharding.Shard(0, 0, 0, 0.0)]])
def test_bad_trees_are_refused(corpus, bad):
    with pytest.raises(ValueError):
        sharding.place(corpus, "doc_id", bad)


# --- token files ----------------------------------------------------------------------------------


def test_token_files_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    path = folder(spark, "sequences")
    manifest = tokens.write_sequences(corpus, path, VOCABULARY, length=64)
    got = sorted(rows_of(tokens.read_documents(manifest, path)), key=lambda r: r["doc_id"])
    tokenizer = Tokenizer.from_file(VOCABULARY)
    at, every = 0, {}
    for row, have in zip(corpus.orderBy("doc_id").collect(), got, strict=True):
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        every[row["doc_id"]] = ids
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert have == {"doc_id": row["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": crc}
        at += len(ids)
    first = manifest.orderBy("part").first()["part"]
    reader = tokens.open_sequences(path, first)
    ids, mask = tokens.sequence(path, first, 0)
    assert len(ids) == len(mask) == 64 and str(reader.schema.field("ids").type).startswith("fixed_size_list")
    lead = [i for d in sorted(every) for i in every[d]][: int(mask.sum())]
    assert ids[: int(mask.sum())].tolist() == lead


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "a <| endoftext|> b, c."]


def test_special_strings_as_the_library_takes_them(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    for as_text in (False, True):
        tokenizer = Tokenizer.from_file(VOCABULARY)
        tokenizer.encode_special_tokens = as_text
        want = {}
        for i, text in enumerate(SPECIAL):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        got = tokens.encoded_documents(docs, VOCABULARY, special_as_text=as_text).collect()
        assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_encoders_remember_and_take_at_once_a_bounded_part(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encode = tokens.Encoder(VOCABULARY, 0)
    texts = [f"word{i} other{i}, and{i}" for i in range(400)] + ["long " * 50_000, None, ""]
    whole = [x.tobytes() for x in tokens.Encoder(VOCABULARY, 0)(texts)]
    at_once = []

    def counted(part):
        at_once.append(sum(len(t or "") for t in part))
        return encode(part)

    assert [x.tobytes() for x in tokens._by_parts(counted, pa.array(texts, pa.string()))] == whole
    assert max(sorted(at_once)[:-1]) <= tokens.TOGETHER and len(at_once) >= 2
    for i in range(200):
        encode([f"first{i} x"])
    assert len(encode.known) + len(encode.first) <= 50


def test_a_vocabulary_that_does_not_cut_at_blanks(tmp_path):
    """A tokenizer whose words run over blanks is used on whole texts."""
    from tokenizers import Tokenizer, models

    letters = {c: i for i, c in enumerate("#abc ")}
    path = str(tmp_path / "blanks.json")
    Tokenizer(models.BPE({**letters, "a ": 5, "a b": 6}, [("a", " "), ("a ", "b")], unk_token="#")).save(path)
    encode, whole = tokens.Encoder(path, 0), Tokenizer.from_file(path)
    for text in ("a b a b c", "c a b", "a  b"):
        assert encode([text])[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]
    assert not encode.cuts and tokens.Encoder(VOCABULARY, 0).cuts


# --- mixing ---------------------------------------------------------------------------------------


def water_filled(sizes, weights, passes):
    """Targets by resharing the excess again and again."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > passes * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: passes * sizes[i] for i in over}


def test_mix_meets_targets_and_repeats_itself(corpus):
    rows = rows_of(mixing.mix(corpus, block=4))
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in corpus.collect()}
    source = {r["doc_id"]: r["source"] for r in corpus.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(words)
    names = [*sorted({s for s in source.values() if s is not None}), None]
    sizes = [sum(words[d] for d in words if source[d] == s) for s in names]
    targets = water_filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for name, size, target in zip(names, sizes, targets, strict=True):
        own = [r for r in rows if source[r["doc_id"]] == name]
        assert {r["source_size"] for r in own} == {size}
        assert {round(r["target"], 6) for r in own} == {round(target, 6)}
        assert sum(r["taken"] for r in own) == pytest.approx(target, rel=0.02, abs=8)
    assert all(r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    again = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix(corpus.repartition(5), block=4))}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


@pytest.mark.parametrize(
    "sizes",
    [
        {f"s{i:02d}": 30 + i % 7 for i in range(60)},
        {"large": 90_000, "small": 40, "tiny": 30, "one": 1},
        {"a": 3000, "b": 20_000, "c": 70, "d": 129, "e": 500},
    ],
)
def test_small_sources_come_near_their_targets(spark, sizes):
    """With the default block: within 2 % of the target, or one word."""
    rows = []
    for name, size in sizes.items():
        while size:
            n = min(size, 1 + len(rows) * 7 % 400)
            rows.append((len(rows), " ".join(["w"] * n), name))
            size -= n
    got = rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    source = {i: name for i, _, name in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    for name in sizes:
        assert abs(taken[name] - target[name]) <= max(1.0, 0.02 * target[name]), name


def test_schedule_spreads_a_source(spark):
    sources = spark.createDataFrame([(0, 10, 0.75), (1, 10, 0.25)], "source_no int, blocks long, share double")
    rows = sorted(rows_of(mixing.schedule(sources, 40)), key=lambda r: r["slot"])
    assert Counter(r["source_no"] for r in rows) == {0: 30, 1: 10}
    for at in range(0, 40, 8):
        assert Counter(r["source_no"] for r in rows[at : at + 8]) == {0: 6, 1: 2}
    taken = [(r["pass"], r["block_no"]) for r in rows if r["source_no"] == 0]
    assert taken == [(i // 10, i % 10) for i in range(30)]


def test_mixed_documents_keep_columns_and_copies(odd):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    taken = mixing.mix(odd)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    assert mixed.count() == taken.agg(F.sum(copies)).first()[0]


# --- substring dedup ------------------------------------------------------------------------------


def brute_bytes(docs, window=100):
    seen, out = set(), {}
    for doc, text in docs:
        raw, gone = text.encode(), bytearray(len(text.encode()))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(raw[i : i + window])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


def brute_words(docs, window=50):
    seen, out = set(), {}
    for doc, text in docs:
        words, new = WORD.findall(text), set()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone[i : i + window] = [True] * window
            new.add(own)
        seen |= new
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def test_repeated_bytes(corpus):
    docs = [(r["doc_id"], r["text"] or "") for r in corpus.orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.kept_bytes(corpus).collect()}
    assert got == brute_bytes(docs)


def test_repeated_words(corpus):
    docs = [(r["doc_id"], r["text"] or "") for r in corpus.orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in recompression.kept_words(corpus).collect()}
    assert got == brute_words(docs)


def test_kins_of_many_rows_list_their_windows(corpus, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", 0)
    docs = [(r["doc_id"], r["text"] or "") for r in corpus.orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.kept_bytes(corpus).collect()}
    assert got == brute_bytes(docs)


def test_windows_of_a_kin_are_compared_whole(spark):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 99, 6)) + b"x" * 96 + bytes(rng.integers(97, 99, 5)) for _ in range(60)]
    rows = [(i % 3, i, 0, t) for i, t in enumerate(texts)]
    expected, seen = set(), set()
    for kin, doc, _, t in rows:
        for at in range(len(t) - 99):
            if (kin, t[at : at + 100]) in seen:
                expected.add((doc, at))
            seen.add((kin, t[at : at + 100]))
    bodies = spark.createDataFrame([(k, d, lo, bytearray(t)) for k, d, lo, t in rows], "kin long, doc long, low int, body binary")
    for together in (1, 7, 5000):
        found = repeats.late_windows(bodies, suffixes.METHOD, together).collect()
        assert {(r["doc"], r["low"] + i) for r in found for i in range(r["n"])} == expected and expected


def test_rows_of_windows_are_few(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghij klmnop", k=5000)) for _ in range(40)]
    rows = repeats.window_rows(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), suffixes.METHOD)
    assert rows.agg(F.sum("n")).first()[0] == 40 * 4901
    assert rows.count() < 40 * 4901 / 28  # about 1 of 24 when the first anchor of least hash nearby owned a window


def test_equal_stretches_carry_equal_anchors():
    rng = np.random.default_rng(3)
    for method, size in ((recompression.METHOD, 400), (suffixes.METHOD, 900)):
        from canasta.llm.repeats import Units
        from canasta.llm.words import Ranges, mixed

        shared = mixed(rng.integers(1, 40, size).astype(np.uint64))
        found = []
        for lead in (37, 91):
            values = np.concatenate([mixed(rng.integers(1, 40, lead).astype(np.uint64)), shared, mixed(rng.integers(1, 40, 80).astype(np.uint64))])
            units = Units(values, np.array([0, len(values)]))
            places = method.anchors(units, Ranges(values)) - lead
            found.append(places[(places >= method.left) & (places <= size - method.right)].tolist())
        assert found[0] == found[1] and len(found[0]) > 10


# --- fingerprints ---------------------------------------------------------------------------------


def signed(x, bits=64):
    return x - (1 << bits) if x >= 1 << (bits - 1) else x


def word_hashes(text):
    return [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in WORD.findall(text)]


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(int(v).to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return signed(seed)


def brute_syncmers(text, k=5, s=2):
    """Places of the closed syncmers among the k-mers of words."""
    h = word_hashes(text)
    smers = [chained(*h[i : i + s]) if s > 1 else h[i] for i in range(len(h) - s + 1)]
    inner = k - s + 1
    return [i for i in range(len(h) - k + 1) if min(smers[i : i + inner]) in (smers[i], smers[i + inner - 1])]


def test_syncmers_are_those_of_the_definition(corpus):
    rows = syncmers.fingerprints(corpus).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in corpus.collect()}
    for r in rows:
        n = len(WORD.findall(texts[r["doc_id"]]))
        expected = len(brute_syncmers(texts[r["doc_id"]])) if n >= 5 else min(n, 1)
        assert len(r["fingerprint"]) == 8 * expected


def test_short_texts_and_texts_without_blanks_keep_their_anchors(spark):
    short = [" ".join(f"w{i}x{j}" for j in range(5 + i % 2)) for i in range(60)]
    glyphs = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(300))
    thai = "".join(chr(0x0E01 + i * i * i % 46) for i in random.Random(2).sample(range(9000), 300))
    code = "".join(f"f{i}(a,b{i % 7});" for i in range(200))
    key = "".join(f"{chr(97 + i % 26)}{chr(65 + i * 3 % 26)}{i}" for i in range(200))
    docs = list(enumerate([*short, glyphs, thai, code, key, "一二三四五六七八"]))
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = [rows[i]["fingerprint"] for i in range(len(docs))]
    assert all(prints) and len(set(prints)) == len(docs)
    for i in range(60):
        assert len(prints[i]) == 8 * max(1, len(brute_syncmers(short[i])))
    assert all(rows[i]["near_next"] == 0.0 for i in range(60))
    assert all(0.3 < rows[i]["near_edited"] < 1 for i in range(60, 64)), [rows[i]["near_edited"] for i in range(60, 64)]


def test_edited_texts_and_likeness(corpus):
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(corpus).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()), reverse=True)
    cut = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (doc, text) in enumerate(docs):
        after, following = docs[(i + 1) % len(docs)]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = rows[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(cut(r["fingerprint"]), cut(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(like(cut(r["fingerprint"]), cut(rows[after]["fingerprint"])))
    assert len({r["fingerprint"] for r in rows.values()}) >= len({t for _, t in docs if WORD.search(t)})


def test_far_off_ids_are_neighbours(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in [-(2**62), -5, 0, 1, 2, 3, 2**62]], "doc_id long, text string")
    got = {r["doc_id"]: r["next_body"] for r in syncmers.with_next(docs, block=2).collect()}
    ids = sorted(got, reverse=True)
    assert [got[i] for i in ids] == [f"text {i}" for i in [*ids[1:], ids[0]]]


# --- edge cases -----------------------------------------------------------------------------------

RUNS = {
    "shards": lambda d: sharding.shard_documents(d, sharding.balanced(3)),
    "tokens": lambda d: tokens.encoded_documents(d, VOCABULARY),
    "mix": lambda d: mixing.mix(d),
    "bytes": suffixes.kept_bytes,
    "words": recompression.kept_words,
    "syncmers": syncmers.fingerprints,
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_of_odd_tables_has_a_result(odd, empty, name):
    assert RUNS[name](odd).count() == odd.count()
    assert RUNS[name](empty).count() == 0
