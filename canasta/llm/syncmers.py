"""Document fingerprints of closed syncmers.

The alphabet is words; a long word or one of a script without blanks is cut into units (``units``), so that
texts without blanks have local anchors too. A word is cut or not by itself alone. Among the k-mers of a text (k words), those are anchors whose smallest inner
s-mer, by hash, lies at the first or last place. Whether a k-mer is an anchor depends on its own words
alone, so an edit only touches the anchors that overlap it, and equal passages carry equal anchors.

The fingerprint lists the anchors' 32-bit hashes in text order, as hexadecimal digits, whole. The
likeness of two fingerprints is the Jaccard index of their anchor sets; two empty ones are alike (1).
A text without a closed syncmer, such as one of fewer than k words, has one anchor, the hash of all its words;
one without words has none.
A null text is an empty one. Words are maximal runs of anything but blank, tab and line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import written
from canasta.session import broadcast_if_small

K = 5
S = 2
#: Documents of one block of neighbours.
BLOCK = 2000
#: Ranges that ids are first split into.
RANGES = 32
#: Scripts written without blanks between words.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
#: Words of more characters than this are cut.
LONGEST = 24
#: Code points below those of all these scripts, and the bytes of the shortest word that is cut.
PLAIN, LEAST_BYTES = r"[^\x00-\u0DFF]", 9
#: A word that is cut, and its units: code points of those scripts and of signs, runs of letters and of digits.
CUT = rf"[{UNSPACED}]{{3}}|[^\x20\x09-\x0D]{{{LONGEST + 1}}}"
UNIT = rf"(?s)[{UNSPACED}]|\p{{Lu}}*[\p{{L}}\p{{M}}&&[^\p{{Lu}}{UNSPACED}]]+|\p{{Lu}}+|\p{{N}}+|."


def units(text: str) -> Column:
    """The words of a text, of which long ones and those of scripts without blanks are cut.

    A run of lower-case letters of other scripts is one unit, however long. Texts whose words are short
    and of other scripts are only split: tests of bytes and of a range of code points go before the patterns.
    """
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    cut = lambda w: (F.octet_length(w) >= LEAST_BYTES) & w.rlike(CUT)
    parts = lambda w: F.when(cut(w), F.regexp_extract_all(w, F.lit(UNIT), F.lit(0))).otherwise(F.array(w))
    some = F.col(text).rlike(PLAIN) | F.exists(words, lambda w: F.octet_length(w) > LONGEST)
    return F.when(some, F.flatten(F.transform(words, parts))).otherwise(words)


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the anchors of column ``text`` in ``out``, an array of ints.

    Each step is a column of its own, so that no array is computed again per element.
    """
    inner = k - s + 1
    h, m, low = f"{out}_h", f"{out}_s", f"{out}_low"
    df = df.withColumn(h, F.transform(units(text), lambda w: F.xxhash64(w)))
    smer = F.col(h)
    for i in range(1, s):
        tail = F.slice(F.col(h), i + 1, F.greatest(F.lit(0), F.size(h) - s + 1))
        head = F.slice(smer, 1, F.greatest(F.lit(0), F.size(h) - s + 1))
        smer = F.zip_with(head, tail, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(m, smer)
    # the sliding minimum over `inner` s-mers, its width doubled step by step
    df, width = df.withColumn(low, F.col(m)), 1
    while width < inner:
        step = min(width, inner - width)
        count = F.greatest(F.lit(0), F.size(low) - step)
        paired = F.zip_with(F.slice(low, 1, count), F.slice(F.col(low), step + 1, count), lambda a, b: F.least(a, b))
        df, width = df.withColumn(low, paired), width + step
    chosen = F.transform(
        low,
        lambda x, i: F.when(
            (F.get(m, i) == x) | (F.get(m, i + inner - 1) == x),
            F.hash(*(F.get(m, i + j) for j in range(0, inner, s)), F.get(m, i + inner - 1)),
        ),
    )
    whole = F.when(F.size(h) > 0, F.array(F.hash(h))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(out, F.array_compact(chosen))
    return df.withColumn(out, F.when((F.size(h) < k) | (F.size(out) == 0), whole).otherwise(F.col(out))).drop(h, m, low)


def fingerprint(anchors: str) -> Column:
    digits = F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(a.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: str, b: str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _blocks(docs: DataFrame, doc_id: str, block: int) -> Column:
    """A number that rises with the id, the same for about ``block`` neighbours; null for null.

    Ids are split at ``RANGES`` approximate quantiles, and each range evenly: far-off ids only coarsen
    their own range.
    """
    ids = docs.agg(
        F.count(doc_id).alias("n"),
        F.percentile_approx(doc_id, [i / RANGES for i in range(RANGES + 1)], 1000).alias("cuts"),
        F.min(doc_id).alias("least"),
        F.max(doc_id).alias("most"),
    ).first()
    if not ids["n"]:
        return F.when(F.lit(False), F.array(F.lit(0.0), F.lit(0.0)))
    cuts = sorted({ids["least"], *ids["cuts"], ids["most"] + 1})
    per = max(1, round(ids["n"] / max(1, len(cuts) - 1) / block))
    known = F.array(*(F.lit(float(c)) for c in cuts))
    outer = F.size(F.filter(known, lambda c: c <= F.col(doc_id))) - 1
    low, high = F.get(known, outer), F.get(known, outer + 1)
    part = F.coalesce(F.floor((F.col(doc_id) - low) / (high - low) * per), F.lit(0))
    return F.when(F.col(doc_id).isNotNull(), F.array(outer.cast("double"), part.cast("double")))


def with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, k: int = K, s: int = S
) -> DataFrame:
    """doc_id, body, own (its anchors), next_body and ahead, its anchors: the next document by descending id;
    the first after the last.

    Equal ids are ordered by text, null ids come last. Neighbours meet in blocks of ids; the last row of
    a block takes the first text of the block below, found by a window over one narrow row per block. First
    ids are found without texts, so that only the first texts themselves travel a second time.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
        F.coalesce(_blocks(docs, doc_id, block), F.array(F.lit(-1.0), F.lit(-1.0))).alias("block"),
    )
    named = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    tops = rows.select("block", named.alias("name")).groupBy("block").agg(F.max("name").alias("name"))
    first = broadcast_if_small(written(tops, "tops"))
    heads = rows.withColumn("name", named).join(first, ["block", "name"]).groupBy("block").agg(F.max("body").alias("head"))
    heads = written(with_anchors(heads, "head", "head_own", k, s), "heads")
    order = Window.orderBy(F.col("block").desc())
    every = Window.partitionBy()
    links = heads.select("block").select(
        F.coalesce(F.lead("block").over(order), F.max("block").over(every)).alias("block"),
        F.col("block").alias("above"),
    )
    after = heads.join(links, "block").select(F.col("above").alias("block"), F.col("head").alias("wrap"), F.col("head_own").alias("wrap_own"))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), F.col("body").desc())
    # anchors are found once per text, before the texts meet their neighbours
    marked = with_anchors(rows, "body", "own", k, s)
    following = F.lead(F.struct("body", "own")).over(inside)
    met = marked.withColumn("following", following).join(after, "block")
    return met.select(
        "doc_id",
        "body",
        "own",
        F.coalesce("following.body", "wrap").alias("next_body"),
        F.coalesce("following.own", "wrap_own").alias("ahead"),
    )


def fingerprints(docs: DataFrame, k: int = K, s: int = S, **columns) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and likenesses.

    The edited text swaps the last third of the characters for the beginning of the next document.
    """
    pairs = with_next(docs, k=k, s=s, **columns)
    n = F.length("body")
    cut = F.floor(n / 3).cast("int")
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("body", F.lit(1), n - cut), F.substring("next_body", F.lit(1), cut))
    )
    pairs = with_anchors(pairs, "edited", "other", k, s)
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "ahead").alias("near_next"),
    )


def positional_matches(left: DataFrame, right: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Anchors that two tables (doc_id, text) share, with their running numbers in either text.

    A join on the anchor's hash; as it lists every pair of places, the right table is meant to be a
    stated set of queries.
    """

    def places(df, name):
        found = with_anchors(df.select("doc_id", F.coalesce("text", F.lit("")).alias("body")), "body", "own", k, s)
        return found.select(F.col("doc_id").alias(name), F.posexplode("own").alias(f"{name}_place", "anchor"))

    return places(left, "left").join(places(right, "right"), "anchor")
