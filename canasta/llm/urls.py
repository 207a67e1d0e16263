"""URL filter by rules and, where none fits, by the ratio of two character language models.

A rule is (verdict, host, path); it fits its host and all subdomains if the URL's path starts with the rule's.
The longest fitting rule decides. URLs that rules accept and reject train two smoothed variable-order Markov
models of characters: the probability of a character after its last ``ORDER`` ones mixes all shorter contexts,
each weighted by how often and how variedly it occurred (Witten-Bell). A URL without a rule is accepted if its
mean log-likelihood difference per character reaches a threshold, chosen on labelled URLs that did not
train (``HELD_OUT``) as the one of least balanced error.

All counts are over all distinct URL texts, with A-Z in lower case and digits as 0; scores are whole
millionths, so sums are exact whatever the order of rows. Differences are put into steps of ``STEP``.

Defined cases: a null URL, or one without ``://``, has empty host and path and no rule; a null URL's text
is empty. A text is judged by its characters and its end, so an empty one is too. Where no URL is accepted, or
none rejected, the models are alike, the difference is 0 and so is the threshold: URLs without a rule are allowed.
Repeated rows and null ids are rows of their own; all columns but id and URL are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.llm.shared import written
from canasta.session import broadcast_if_small

Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Characters of context.
ORDER = 4
#: First hexadecimal digits of a text's MD5 that choose the threshold and do not train.
HELD_OUT = ["0", "1", "2"]
#: Millionths of a nat per character that make one step; thresholds are whole steps.
STEP = 10_000
#: Steps beyond which differences are alike; bounds the table of steps.
MOST_STEPS = 2000
_BEGIN, _END = "\x02", "\x03"
#: Rows of the score table that are broadcast: of at most ORDER + 1 characters, so under 25 MB.
BROADCAST_GRAMS = 400_000


def host_and_path(url: str) -> tuple[Column, Column]:
    found = F.instr(F.col(url), "://")
    rest = F.when(found > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[Rule]) -> Column:
    """verdict and name of the longest rule that fits columns host and path; null without one.

    ``rules`` is a list of the caller's, one expression each.
    """
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path),
            F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("name")),
        )
        for verdict, host, path in longest
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<verdict:string,name:string>"))


def folded(url: str) -> Column:
    signs = string.ascii_uppercase + "123456789"
    return F.translate(F.coalesce(F.col(url), F.lit("")), signs, string.ascii_lowercase + "0" * 9)


def grams(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``gram`` for every character of column ``text`` and its end, with the ``ORDER`` characters before."""
    signs = texts.select(
        *keep, F.split(F.concat(F.lit(_BEGIN * ORDER), F.col("text"), F.lit(_END)), "").alias("_signs")
    )
    own = F.transform(
        F.sequence(F.lit(0), F.size("_signs") - ORDER - 1),
        lambda i: F.concat(*[F.get("_signs", i + j) for j in range(ORDER + 1)]),
    )
    return signs.select(*keep, F.explode(own).alias("gram"))


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram and score: the log ratio, in millionths, of its last character's two probabilities.

    ``counts`` has gram, good and bad: how often each model has seen it, of all grams to be scored. One
    grouping per order and side; nothing but the single row of order 0 is forced to be broadcast.
    """
    lower = None
    for k in range(ORDER + 1):
        own = counts if k == ORDER else counts.groupBy(F.substring("gram", -k - 1, k + 1).alias("gram")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")
        )
        own = own.withColumn("context", F.substring("gram", 1, k))
        contexts = own.groupBy("context").agg(
            *[F.sum(side).alias(f"{side}_all") for side in ("good", "bad")],
            *[F.count_if(F.col(side) > 0).alias(f"{side}_kinds") for side in ("good", "bad")],
            F.count(F.lit(1)).alias("kinds"),
        )
        rows = own.join(contexts if k else F.broadcast(contexts), "context")
        if k:
            rows = rows.withColumn("tail", F.substring("gram", 2, k)).join(lower, "tail")
        else:
            even = F.lit(1.0) / (F.col("kinds") + 1)
            rows = rows.withColumns({"good_lower": even, "bad_lower": even})
        lower = rows.select(
            F.col("gram").alias("tail"),
            *[
                F.when(
                    F.col(f"{side}_all") > 0,
                    (F.col(side) + F.col(f"{side}_kinds") * F.col(f"{side}_lower"))
                    / (F.col(f"{side}_all") + F.col(f"{side}_kinds")),
                )
                .otherwise(F.col(f"{side}_lower"))
                .alias(f"{side}_lower")
                for side in ("good", "bad")
            ],
        )
    ratio = F.round(F.lit(1e6) * F.ln(F.col("good_lower") / F.col("bad_lower"))).cast("long")
    return lower.select(F.col("tail").alias("gram"), ratio.alias("score"))


def steps_of(texts: DataFrame) -> DataFrame:
    """name (MD5 of the text) and step, the scaled difference per character, of every row of ``texts``.

    ``texts`` has distinct text, and good and bad: whether a rule accepts or rejects it.
    """
    trains = ~F.col("held_out")
    every = grams(texts, "name", "good", "bad", "held_out")
    counts = every.groupBy("gram").agg(
        F.count_if(trains & F.col("good")).alias("good"), F.count_if(trains & F.col("bad")).alias("bad")
    )
    scores = written(gram_scores(written(counts, "url-grams")), "url-scores")
    sums = grams(texts, "name").join(broadcast_if_small(scores, BROADCAST_GRAMS), "gram").groupBy("name").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")
    )
    step = F.floor(F.col("score") / (F.col("n") * STEP))
    return sums.select("name", F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), step)).alias("step"))


def threshold(steps: DataFrame) -> DataFrame:
    """One row: the least step that is accepted, with the least sum of both error rates; ties to the one nearest 0.

    ``steps`` has step, good and bad of held-out texts. There are at most 2 * MOST_STEPS + 1 different steps,
    so the running counts are over a bounded table.
    """
    counts = steps.groupBy("step").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
    ends = F.array_sort(F.collect_list(F.struct("step", "good", "bad"))).alias("all")
    table = counts.agg(ends, F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    lost = lambda s: F.aggregate(F.filter("all", lambda x: x["step"] < s), F.lit(0).cast("long"), lambda t, x: t + x["good"])
    let = lambda s: F.aggregate(F.filter("all", lambda x: x["step"] >= s), F.lit(0).cast("long"), lambda t, x: t + x["bad"])
    tries = F.array_union(F.transform("all", lambda x: x["step"]), F.array(F.lit(0).cast("long")))
    rated = F.transform(
        tries,
        lambda s: F.struct((lost(s) / F.col("goods") + let(s) / F.col("bads")).alias("error"), F.abs(s).alias("far"), s.alias("step")),
    )
    best = F.when((F.col("goods") > 0) & (F.col("bads") > 0), F.array_min(rated)["step"]).otherwise(0)
    return table.select(F.coalesce(best, F.lit(0)).cast("long").alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (its name or null), step (null where a rule decides) and verdict of every row."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), folded(url).alias("text"))
    rows = rows.withColumn("found", rule_of(rules))
    text = F.col("text")
    texts = rows.groupBy("text").agg(
        F.coalesce(F.bool_or(F.col("found.verdict") == "allow"), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("found.verdict") == "block"), F.lit(False)).alias("bad"),
    )
    name = F.md5(text.cast("binary"))
    texts = texts.withColumn("name", name).withColumn("held_out", F.substring("name", 1, 1).isin(HELD_OUT))
    texts = written(texts, "url-texts")
    steps = written(steps_of(texts), "url-steps")
    labelled = texts.where("held_out AND (good OR bad)").select("name", "good", "bad").join(steps, "name")
    least = threshold(labelled).scalar()
    left = rows.withColumn("name", F.when(F.col("found").isNull(), name))
    told = left.join(steps, "name", "left")
    return told.select(
        "page_id",
        "host",
        "path",
        F.col("found.name").alias("rule"),
        "step",
        F.coalesce(F.col("found.verdict"), F.when(F.col("step") >= least, "allow").otherwise("block")).alias("verdict"),
    )
