"""Allow or block URLs: rules by host and path, and a character model of those the rules decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.session import stored

#: (verdict, rule): a rule is a host and the beginning of a path
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
#: characters of the longest context
ORDER = 4
#: probability of any character before anything is known
FLOOR = 1.0 / 256
#: the threshold is looked for in steps of 1 / STEPS between -LIMIT and LIMIT
STEPS, LIMIT = 200, 5.0
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, else nulls: its host is the host or a parent
    domain of it, and the path starts with the rule's path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/") if "/" in text else len(text)
        own = F.lit(text[:cut])
        fits = ((host == own) | F.endswith(host, F.concat(F.lit("."), own))) & F.startswith(path, F.lit(text[cut:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _letters(url: Column) -> Column:
    """The URL behind its scheme in lower case, with marks before its first and behind its last character."""
    rest = F.regexp_replace(F.lower(url), r"(?s)^.*?://", "")
    return F.concat(F.lit("\x02" * ORDER), rest, F.lit("\x03"))


def _windows(s: Column) -> Column:
    """Each character behind the first marks, with the ``ORDER`` characters before it."""
    return F.transform(F.sequence(F.lit(1), F.length(s) - ORDER), lambda i: F.substring(s, i, F.lit(ORDER + 1)))


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict") -> DataFrame:
    """``(x, allow, block)``: how often each window of ``ORDER + 1`` characters stands in the URLs of either
    verdict, exactly. Windows are added up per task before the shuffle; the table grows with the input.
    """
    whole = labelled.select((F.col(verdict) == "block").alias("blocked"), _letters(F.col(url)).alias("s"))
    windows = whole.select("blocked", F.explode(_windows(F.col("s"))).alias("x"))
    return windows.groupBy("x").agg(F.count_if(~F.col("blocked")).alias("allow"), F.count_if("blocked").alias("block"))


def _window_ratios(model: DataFrame, asked: DataFrame) -> DataFrame:
    """``(x, ratio)`` of each of the ``asked`` windows, which must be distinct: the log-probability of its
    last character after those before it under the allowed model less that under the blocked one.

    Both are smoothed variable-order Markov models. The probability of a character after a
    context is ``(n + T * p) / (N + T)`` (n: how often it follows, N: how often the context
    stands, T: how many different characters follow it, p: its probability after the context
    without its first character); a context never seen passes on ``p``. Every order joins
    different n-grams to their contexts and to their ends, so no key has more rows than there
    are different characters.
    """
    every = model.withColumn("asked", F.lit(False)).unionByName(
        asked.select("x", F.lit(0).cast("bigint").alias("allow"), F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("asked"))
    )
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda i: F.substring(F.col("x"), i, F.lit(ORDER + 1)))
    grams = every.select(F.explode(ends).alias("g"), "allow", "block", "asked").groupBy("g")
    grams = grams.agg(*[F.sum(k).alias(k) for k in ("allow", "block")], F.max("asked").alias("asked"))
    grams = stored(grams.select("*", F.expr("substring(g, 1, length(g) - 1)").alias("c")))
    contexts = grams.groupBy("c").agg(*[
        f.alias(f"{k}_{n}") for k in ("allow", "block") for n, f in (("stands", F.sum(k)), ("kinds", F.count_if(F.col(k) > 0)))
    ])

    def shares(kind: str) -> list[Column]:
        total = F.col(f"{kind}_stands") + F.col(f"{kind}_kinds")
        own = F.when(total > 0, F.col(kind) / total).otherwise(F.lit(0.0))
        return [own.alias(f"{kind}_own"), F.when(total > 0, F.col(f"{kind}_kinds") / total).otherwise(F.lit(1.0)).alias(f"{kind}_pass")]

    terms = stored(grams.filter("asked").join(contexts, "c").select("g", *shares("allow"), *shares("block")))
    level = None
    for o in range(ORDER + 1):
        here = terms.filter(F.length("g") == o + 1)
        if level is None:
            here = here.withColumns({f"{k}_less": F.lit(FLOOR) for k in ("allow", "block")})
        else:
            here = here.withColumn("end", F.substring("g", 2, ORDER)).join(level, "end")
        p = {k: F.col(f"{k}_own") + F.col(f"{k}_pass") * F.col(f"{k}_less") for k in ("allow", "block")}
        level = here.select(F.col("g").alias("end"), *[c.alias(f"{k}_less") for k, c in p.items()])
    # a decimal, so that a sum does not depend on its order
    value = F.round(F.log("allow_less") - F.log("block_less"), 12).cast("decimal(18,12)")
    return level.select(F.col("end").alias("x"), value.alias("ratio"))


def _key(text: Column) -> list[Column]:
    """Two XXH64 of a text: 128 bits that stand for it."""
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(7), text).alias("__k2")]


def _scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """``(__k1, __k2, __score)`` of each different ``t`` that is not null: its windows' ratios, per window."""
    different = stored(texts.filter("t IS NOT NULL").groupBy("t").agg(F.lit(1).alias("one")).select("t", *_key(F.col("t"))))
    windows = different.select("__k1", "__k2", F.explode(_windows(_letters(F.col("t")))).alias("x"))
    ratios = stored(_window_ratios(model, windows.select("x").distinct()))
    total = windows.join(ratios, "x").groupBy("__k1", "__k2").agg(F.sum("ratio").cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    return total.select("__k1", "__k2", (F.col("s") / F.col("n")).alias("__score"))


def ratio(df: DataFrame, url: Column, model: DataFrame, name: str = "score") -> DataFrame:
    """Add the log-likelihood under the allowed model less that under the blocked one, per character;
    null for a null URL. Different URLs are scored once, by joins with the counts of ``model``."""
    scores = _scores(df.select(url.alias("t")), model)
    k1, k2 = _key(url)
    kept = [c for c in df.columns if c.lower() != name.lower()]
    keyed = df.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(kept)], F.when(url.isNotNull(), k1).alias("__k1"), k2)
    joined = keyed.join(scores, ["__k1", "__k2"], "left")
    return joined.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], F.col("__score").alias(name))


def threshold(scored: DataFrame, verdict: str = "verdict", score: str = "score") -> float:
    """The score from which on to allow: the one that gets the largest sum of both classes' shares right.

    Scores are counted in steps, at most ``2 * STEPS * LIMIT + 1`` of them, so the search is
    over a small table. The middle of equally good steps is taken; 0 if a class is missing.
    """
    step = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col(score))) * STEPS).cast("int")
    bins = scored.groupBy(step.alias("step")).agg(F.count_if(F.col(verdict) == "allow").alias("a"), F.count_if(F.col(verdict) == "block").alias("b"))
    from_here, before = W.orderBy("step").rowsBetween(W.currentRow, W.unboundedFollowing), W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    right = F.sum("a").over(from_here) / F.sum("a").over(whole) + F.coalesce(F.sum("b").over(before), F.lit(0)) / F.sum("b").over(whole)
    previous = F.coalesce(F.lag("step").over(W.orderBy("step")), F.col("step"))
    both = (F.sum("a").over(whole) > 0) & (F.sum("b").over(whole) > 0)
    judged = bins.select("step", both.alias("both"), previous.alias("previous"), F.when(both, right).alias("right"))
    best = judged.filter("both").agg(F.max_by(F.struct("step", "previous"), F.struct(F.round("right", 9), -F.col("step"))).alias("m")).first()["m"]
    return 0.0 if best is None else (best["step"] + best["previous"]) / 2 / STEPS


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``df`` plus ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (columns of these names are replaced).

    The longest fitting rule decides; URLs without one are allowed if their score reaches the
    threshold. Both models learn the URLs that rules allow and block, but for a fifth of them
    by hash, on which the threshold is set. ``score`` is null where a rule decides. Null URLs,
    URLs without ``://`` and empty ones have empty host and path and are scored as the text
    they are. Where no rule fits any row, every score is 0 and all are allowed. No rows give no
    rows. The model is a table of exact counts that grows with the URLs; different URLs are
    scored once, and rows meet their scores in a join.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    rule, verdict = rule_of(host, path, rules)
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "score") or c == url]
    text = F.coalesce(F.col(url), F.lit(""))
    # names that no helper column has
    own = df.select(
        *[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(kept)], host.alias("__host"), path.alias("__path"), rule.alias("__rule"), verdict.alias("__verdict"),
        *_key(text), text.alias("__text"),
    )
    slim = stored(own.select(F.col("__text").alias("t"), F.col("__verdict").alias("verdict"), "__k1", "__k2"))
    known = slim.filter("verdict IS NOT NULL")
    aside = F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(5)) == 0
    model = stored(train(known.filter(~aside), "t"))
    # nothing else is to be scored where a rule decides
    scores = stored(_scores(slim.filter(F.col("verdict").isNull() | aside).select("t"), model))
    least = threshold(known.filter(aside).join(scores, ["__k1", "__k2"]), score="__score")
    scored = own.drop("__text").join(scores, ["__k1", "__k2"], "left")
    score = F.when(F.col("__rule").isNull(), F.col("__score"))
    decided = F.coalesce("__verdict", F.when(score >= F.lit(least), F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(
        *[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        decided.alias("verdict"), score.alias("score"),
    )


def keep_allowed(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The rows of ``df`` whose URL is allowed, with their columns, whatever their names. Null URLs are judged
    as empty ones, copies alike. No rows give no rows."""
    named = df.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(df.columns)], F.col(url).alias("__url"))
    kept = judge(named, "__url", rules).filter(F.col("verdict") == "allow")
    return kept.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(df.columns)])
