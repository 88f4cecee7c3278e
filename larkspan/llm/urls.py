"""Operator 10: URL filters by association rules, DataFrame operations only."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import by_share, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path) of the fixed rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: -log of the chance below which a rule's counts are no accident: 1e-9.
SURE = 9 * math.log(10)
#: Intervals of a rule's share of bad rows; more make a closer bound.
BARS = 12
#: Digits of a token's number of rows in its key.
RANK = 12
#: A key with this share of all rows or more is joined by broadcast; there are at most as many as its inverse.
OFTEN = 1 / 1000


def parts(url: Column) -> dict[str, Column]:
    """host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (from there up
    to `?`, `#` or the end); both empty for a null url or one without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def fixed_rule(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null where none does."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for says, what in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = what.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = rule.when(fits, F.lit(what)), verdict.when(fits, F.lit(says))
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, sorted: h:label for the host's labels, p:word and q:word for the rest.
    Runs of digits count as one token, so that page numbers don't make words of their own."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    own = parts(plain)
    tail = F.substring(plain, F.locate("://", plain) + 3 + F.length(own["host"]) + F.length(own["path"]), F.length(plain))
    pick = lambda text, tag: F.transform(F.filter(F.split(F.regexp_replace(text, "[0-9]+", "0"), "[^a-z0-9-]+"), lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    return F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(F.split(own["host"], r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)), pick(own["path"], "p:"), pick(tail, "q:"))))


def passes(b: Column, n: Column, rate: float, min_confidence: float) -> Column:
    """Whether b bad rows of n are a rule: at least min_confidence of them, and by Chernoff's bound so many by
    chance, at this rate, with at most 1e-9."""
    share = b / n
    gain = share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return (share >= min_confidence) & (share > rate) & (n * gain >= SURE - 1e-9)


def _reach(rate: float, min_confidence: float, full: Column | None = None) -> Column:
    """The most that n * gain of passes() can be for a combination whose rows are some of a group's rows (b, g: bad
    and good ones of a token set), all of those marked full among them.

    With share p, n * gain is b * log(p / rate) - g * log((1 - rate) / (1 - p)), a sum over the sets taken. For p in an
    interval the first factor is at most its upper end's, the second at least its lower end's, so no sum exceeds
    that of the sets that add to it. The intervals go from the least share to 1; the largest sum counts."""
    low = min(max(min_confidence, rate), 1.0)
    ends = [low + (1 - low) * i / BARS for i in range(BARS + 1)]
    sums = []
    for p, q in itertools.pairwise(ends):
        worth = F.col("b") * math.log(q / rate) - F.col("g") * math.log((1 - rate) / max(1 - p, 1e-12))
        taken = F.greatest(worth, F.lit(0.0))
        sums.append(F.sum(taken if full is None else F.when(full, worth).otherwise(taken)))
    return F.greatest(*sums)


def _children(base: DataFrame) -> DataFrame:
    """(x, tail, b, g) of each row's combinations longer by one token, with the tokens after it, if there are any."""
    longer = lambda t, i: F.struct(F.concat("x", F.array(t)).alias("x"), F.slice("tail", i + 2, F.size("tail")).alias("tail"))
    rows = base.select(F.explode(F.transform("tail", longer)).alias("_to"), "b", "g").select("_to.*", "b", "g")
    return rows.where(F.size("tail") > 0).groupBy("x", "tail").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))


def mined(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (tokens array, n) that predict the label block, from rows (_tokens array, bad boolean).

    One criterion for tables of any size: of the rows with the rule's tokens at least min_confidence are bad,
    and by Chernoff's bound on the rule's own counts so many would be bad by chance, at the rate of all rows
    (or a half, if that is less), with at most 1e-9. So a rule has a number of bad rows at least (and
    min_support of the rows, if given). All combinations of any length that meet it are found. A rule that contains
    another is left out: the shorter one matches wherever it does.

    Rows are kept as distinct token sets with their counts. Combinations grow by a token a round, as in FP-growth over
    the sets that hold a combination (its base), of which only the tokens after its last one matter, rarest first. What
    is given up on can be in no rule that is asked for:
    - a combination with too few bad rows, or one that holds a rule;
    - one in which a token takes no good row away: without it, it and whatever holds it have the same good rows and no
      fewer bad ones, so that is a rule already (a token that all good rows hold is the simplest case);
    - one whose sets, whichever are taken of them, don't reach the bound (_reach); those that hold all its further
      tokens are always taken.
    Time and disk grow with the combinations that remain, which can be as many as subsets of the tokens.
    """
    spark = labelled.sparkSession
    rows, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    none = spark.createDataFrame([], "tokens array<string>, n int")
    if not bad:
        return none
    rate = min(bad / rows, 0.5)
    least = max(math.ceil(SURE / -math.log(rate)), math.ceil(min_support * rows))
    if bad < least:
        return none
    sure = passes(F.col("b"), F.col("b") + F.col("g"), rate, min_confidence)
    within = F.col("reach") >= SURE - 1e-3
    sums = [F.sum("b").alias("b"), F.sum("g").alias("g")]

    sets = labelled.groupBy("_tokens").agg(F.count_if("bad").alias("b"), (F.count("*") - F.count_if("bad")).alias("g"))
    sets = written(sets.withColumn("_id", F.monotonically_increasing_id()), "url-labelled")
    singles = written(sets.select(F.explode("_tokens").alias("token"), "b", "g").groupBy("token").agg(*sums).where(F.col("b") >= least), "url-tokens")
    alone = singles.where(sure).select(F.array("token").alias("tokens"), F.lit(1).alias("n"))
    # a token is known by its number of rows and its name, so that arrays of them sort by rarity
    key = F.concat(F.lpad(F.hex(F.col("b") + F.col("g")), RANK, "0"), "token")
    open_ = written(singles.where(~sure & (F.col("g") < rows - bad)).select(key.alias("t"), "token", F.col("g").alias("gx")), "url-open")

    def projected(kept: DataFrame) -> DataFrame:
        """The sets' kept tokens: (tail, b, g)."""
        held = sets.select("_id", "b", "g", F.explode("_tokens").alias("token")).join(kept.select("token", "t"), "token")
        return held.groupBy("_id", "b", "g").agg(F.array_sort(F.collect_list("t")).alias("tail")).groupBy("tail").agg(*sums)

    reach = projected(open_).select(F.explode("tail").alias("t"), "b", "g").groupBy("t").agg(_reach(rate, min_confidence).alias("reach"))
    open_ = written(open_.join(reach.where(within).select("t"), "t", "left_semi"), "url-open")
    base = written(projected(open_), "url-base")
    if not base.agg(_reach(rate, min_confidence, F.size("tail") == open_.count()).alias("reach")).where(within).count():
        return alone
    base = written(_children(base.withColumn("x", F.array().cast("array<string>"))), "url-base")
    nodes = open_.select(F.array("t").alias("x"), "gx")
    shut, found = spark.createDataFrame([], "c array<string>"), []
    while not base.isEmpty():
        seen = base.select("x", F.explode("tail").alias("t"), "b", "g").groupBy("x", "t").agg(*sums, _reach(rate, min_confidence).alias("reach")).where(F.col("b") >= least)
        seen = written(seen.join(nodes, "x").withColumn("c", F.concat("x", F.array("t"))), "url-seen")
        without = F.transform("x", lambda e: F.concat(F.filter("x", lambda y: y != e), F.array("t")))
        holds = seen.select(F.col("c").alias("_c"), F.explode(without).alias("c")).join(shut, "c", "left_semi").select(F.col("_c").alias("c")).distinct()
        seen = written(seen.join(holds.withColumn("_holds", F.lit(True)), "c", "left").withColumn("_holds", F.col("_holds").isNotNull()).withColumn("_rule", sure), "url-seen")
        found.append(seen.where("_rule AND NOT _holds").select("c"))
        shut = seen.where("_rule OR _holds OR g = gx").select("c")
        open_ = seen.where("NOT _rule AND NOT _holds AND g < gx").where(within)
        nodes = open_.select(F.col("c").alias("x"), F.col("g").alias("gx"))
        tails = open_.groupBy("x").agg(F.collect_list("t").alias("_open"))
        base = base.join(tails, "x").select("x", F.filter("tail", lambda t: F.array_contains("_open", t)).alias("tail"), F.size("_open").alias("width"), "b", "g")
        base = written(base.where(F.size("tail") > 0).groupBy("x", "width", "tail").agg(*sums), "url-base")
        alive = base.where("width > 1").groupBy("x").agg(_reach(rate, min_confidence, F.size("tail") == F.col("width")).alias("reach")).where(within)
        base = written(_children(base.join(alive.select("x"), "x", "left_semi")), "url-base")
    if not found:
        return alone
    # those that hold a shorter rule go, which is looked up by its rarest token
    keys = written(functools.reduce(DataFrame.unionByName, found), "url-rules")
    shorter = keys.select(F.col("c").alias("_short"), F.col("c")[0].alias("t"))
    inside = keys.withColumn("t", F.explode("c")).join(shorter, "t").where((F.size("_short") < F.size("c")) & (F.size(F.array_except("_short", "c")) == 0))
    longer = keys.join(inside.select("c").distinct(), "c", "left_anti").select(F.array_sort(F.transform("c", lambda t: F.substring(t, RANK + 1, F.length(t)))).alias("tokens"))
    return alone.unionByName(longer.withColumn("n", F.size("tokens")))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Of rows (_set string, _tokens array) those _set that hold all tokens of some rule, found through an
    inverted index that has each rule at its rarest token; what has that token is held against the rule."""
    seen = sets.select("_set", "_tokens", F.explode("_tokens").alias("_token"))
    often = seen.groupBy("_token").agg(F.count("*").alias("n"))
    by_token = rules.select("tokens", F.explode("tokens").alias("_token")).join(often, "_token", "left")
    rarest = by_token.groupBy("tokens").agg(F.min_by("_token", F.struct(F.coalesce("n", F.lit(0)), "_token")).alias("_token"))
    index = rarest.groupBy("_token").agg(F.collect_list("tokens").alias("_rules")).join(often, "_token")
    hits = by_share(seen, written(index, "url-index"), "_token", OFTEN)
    return hits.where(F.exists("_rules", lambda r: F.forall(r, lambda t: F.array_contains("_tokens", t)))).select("_set").distinct()


def url_filter(pages: DataFrame, labelled: DataFrame, min_support: float = 0.0, min_confidence: float = 0.6) -> DataFrame:
    """pages (page_id, url, others) with host, path, rule and verdict; columns of these names are replaced.

    labelled: rows (url, bad boolean) from which rules are mined. A page's fixed rule decides; without
    one, the mined rules block it if one matches, else it is allowed. Null urls, and urls without `://`,
    have empty parts and follow the mined rules like any other. Each row gives a row, repeats too; an empty table
    gives none. Matching works on distinct token sets, so a host with a third of the pages is matched once, and
    sets that many pages share stay where they are. A very long url takes time by the square of its frequent
    tokens in mining, where it is labelled, and more where their combinations stay open (mined()), and in proportion
    to its length elsewhere.
    """
    rules = written(mined(labelled.select(tokens(F.col("url")).alias("_tokens"), F.coalesce("bad", F.lit(False)).alias("bad")), min_support, min_confidence), "url-kept-rules")
    rows = pages.drop("host", "path", "rule", "verdict").withColumns(parts(F.col("url")))
    rule, verdict = fixed_rule()
    rows = rows.withColumn("rule", rule).withColumn("_says", verdict).withColumn("_tokens", tokens(F.col("url"))).withColumn("_set", F.concat_ws(" ", "_tokens"))
    unsaid = rows.where(F.col("rule").isNull())
    sets = written(unsaid.groupBy("_set").agg(F.any_value("_tokens").alias("_tokens"), F.count("*").alias("n")), "url-sets")
    blocked = matched(sets.select("_set", "_tokens"), rules).withColumn("_hit", F.lit(True))
    told = written(sets.select("_set", "n").join(blocked, "_set", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))), "url-told")
    judged = by_share(unsaid, told, "_set", OFTEN)
    said = F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow"))
    drop = ("_says", "_tokens", "_set", "_hit")
    fixed = rows.where(F.col("rule").isNotNull()).withColumn("verdict", F.col("_says")).drop(*drop)
    return fixed.unionByName(judged.withColumn("verdict", said).drop(*drop))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    judged = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter(pages, pages.join(judged, "page_id").select("url", "bad")).select("page_id", "host", "path", "rule", "verdict")
