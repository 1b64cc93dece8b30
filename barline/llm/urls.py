"""URL filter: host and path rules first, then two character language models.

Everything is a DataFrame expression. One variable-order Markov model is fitted to accepted
URLs and one to rejected ones; a URL's score is the mean over its characters of the
difference in log-likelihood, and the cut lies where both training groups are equally many
standard deviations away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0123456789./?=&#%_-~"  # what is not listed becomes ~
STARTS, END = "^", "$"
TARGETS = list(SYMBOLS + END)
CONTEXTS = list(SYMBOLS + STARTS)

# Production parameters of the filter: rules, and parts of host names that mark known rejects.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
REJECTED = ("casino", "pills", "bets", "spam", "adult", "ads", "porn", "viagra", "poker", "loan")
MIN_COUNT = 4


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(rules: tuple[tuple[str, str], ...], what: int) -> Column:
    """Text (0) or verdict (1) of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]))):
        host, slash, path = rule[0].partition("/")
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        out = F.when(fits & F.startswith(F.col("path"), F.lit(slash + path)), rule[what]).otherwise(out)
    return out


def _grams(df: DataFrame) -> DataFrame:
    """One row per character: ``gram`` is the character after its two predecessors."""
    return df.withColumn("gram", F.explode(F.expr("transform(sequence(1, length(chars) - 2), i -> substring(chars, i, 3))")))


def _dense(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ctx, next, diff) for contexts of two characters that were seen, and for all of one.

    Witten-Bell smoothing from order 0 up; a context of two characters counts for a model
    only from MIN_COUNT occurrences on, else its last character alone is the context. Both
    tables are bounded by the alphabet: 48**3 and 48**2 rows.
    """
    targets = F.array(*map(F.lit, TARGETS))
    side = F.when(F.col("rejected"), "r").otherwise("a")

    def as_map(keys: list[Column], value: str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(F.concat(*keys), F.col(value).cast("double"))))

    uni = counts.groupBy(side.alias("s"), F.substring("gram", 3, 1).alias("c")).agg(F.sum("n").alias("n"))
    p0 = uni.agg(as_map([F.col("s"), F.col("c")], "n").alias("m"), F.sum(F.when(F.col("s") == "a", F.col("n"))).alias("na"), F.sum(F.when(F.col("s") == "r", F.col("n"))).alias("nr"))
    p0 = p0.select("m", "na", "nr", F.explode(targets).alias("c"))

    def zero(s: str) -> Column:
        return (F.coalesce(F.element_at("m", F.concat(F.lit(s), F.col("c"))), F.lit(0.0)) + 1) / (F.coalesce(F.col("n" + s), F.lit(0)) + len(TARGETS))

    p0 = p0.select("c", zero("a").alias("p0a"), zero("r").alias("p0r"))
    bi = counts.groupBy(side.alias("s"), F.substring("gram", 2, 1).alias("b"), F.substring("gram", 3, 1).alias("c")).agg(F.sum("n").alias("n"))

    def wide(df: DataFrame, ctx: str) -> DataFrame:
        """Per context and character: count, total and number of followers in both models."""
        cols = []
        for s in "ar":
            mine = F.col("s") == s
            cols += [F.map_from_entries(F.collect_list(F.when(mine, F.struct("c", "n")))).alias("m" + s), F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("n" + s), F.count(F.when(mine, F.col("n"))).alias("t" + s)]
        return df.groupBy(ctx).agg(*cols)

    def smooth(s: str, below: Column) -> Column:
        seen = F.coalesce(F.element_at("m" + s, F.col("c")), F.lit(0))
        return F.when(F.col("n" + s) == 0, below).otherwise((seen + F.col("t" + s) * below) / (F.col("n" + s) + F.col("t" + s)))

    every = p0.select("c", "p0a", "p0r", F.explode(F.array(*map(F.lit, CONTEXTS))).alias("b"))
    p1 = every.join(F.broadcast(wide(bi, "b")), "b", "left")
    for s in "ar":
        p1 = p1.withColumns({"n" + s: F.coalesce("n" + s, F.lit(0)), "t" + s: F.coalesce("t" + s, F.lit(0))})
    p1 = p1.select("b", "c", smooth("a", F.col("p0a")).alias("p1a"), smooth("r", F.col("p0r")).alias("p1r"))
    tri = counts.select(side.alias("s"), F.substring("gram", 1, 2).alias("ctx"), F.substring("gram", 3, 1).alias("c"), "n")
    p2 = wide(tri, "ctx").withColumns({"b": F.substring("ctx", 2, 1), "c": F.explode(targets)}).join(F.broadcast(p1), ["b", "c"])

    def deep(s: str) -> Column:
        return F.when(F.col("n" + s) >= MIN_COUNT, smooth(s, F.col("p1" + s))).otherwise(F.col("p1" + s))

    two = p2.select(F.concat("ctx", "c").alias("gram"), (F.log(deep("a")) - F.log(deep("r"))).alias("two"))
    one = p1.select(F.concat("b", "c").alias("last"), (F.log("p1a") - F.log("p1r")).alias("one"))
    return two, one


def judge(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, rejected: tuple[str, ...] = REJECTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row.

    A fitting rule decides; else the models do. Rejected URLs for training are those whose
    host holds one of ``rejected``; accepted ones are all others that no rule blocks. A URL
    is blocked if its score lies under the cut. A null URL is judged as an empty one. If
    either group is empty or its scores do not vary, no cut exists and the URL is allowed.
    Repeated URLs count as often as they occur and get the same verdict; null ids and
    repeated ids keep their rows; other columns of ``df`` are left out, whatever their names.
    """
    df = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    host, path = split(F.col("url"))
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.coalesce("url", F.lit("")))
    chars = F.regexp_replace(F.translate(rest, UPPER, LOWER), r"[^a-z0-9./?=&#%_~-]", "~")
    df = df.withColumns({"host": host, "path": path})
    df = df.withColumns({"rule": matched(rules, 0), "by_rule": matched(rules, 1), "chars": F.concat(F.lit(STARTS * 2), chars, F.lit(END))})
    marked = F.lit(False)
    for part in rejected:
        marked = marked | F.contains(F.col("host"), F.lit(part))
    known = F.when(marked, True).when(F.coalesce(F.col("by_rule") != "block", F.lit(True)), False)
    texts = df.groupBy("chars").agg(F.count(F.when(known, 1)).alias("bad"), F.count(F.when(~known, 1)).alias("good"))
    sides = F.array(F.struct(F.lit(True).alias("rejected"), F.col("bad").alias("w")), F.struct(F.lit(False).alias("rejected"), F.col("good").alias("w")))
    train = _grams(texts.where("bad + good > 0")).groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = train.select("gram", F.inline(sides)).where("w > 0").select("gram", "rejected", F.col("w").alias("n"))
    two, one = _dense(counts)
    each = _grams(texts).join(F.broadcast(two), "gram", "left")
    each = each.withColumn("last", F.substring("gram", 2, 2)).join(F.broadcast(one), "last", "left")
    scored = each.groupBy("chars", "bad", "good").agg(F.avg(F.coalesce("two", "one")).alias("score"))

    def moments(weight: str) -> tuple[Column, Column]:
        n, x = F.nullif(F.sum(weight), F.lit(0)), F.col("score")
        mean = F.sum(F.col(weight) * x) / n
        return mean, F.sqrt(F.greatest(F.sum(F.col(weight) * x * x) / n - mean * mean, F.lit(0.0)))

    (mg, sg), (mb, sb) = moments("good"), moments("bad")
    cut = scored.agg(((mg * sb + mb * sg) / F.nullif(sg + sb, F.lit(0.0))).alias("cut"))
    verdicts = scored.select("chars", F.when(F.col("score") < cut.scalar(), "block").otherwise("allow").alias("by_model"))
    out = df.join(verdicts, "chars", "left")
    return out.select("id", "host", "path", "rule", F.coalesce("by_rule", "by_model").alias("verdict"))
