"""URL verdicts: a fixed list of host and path rules first, then association rules over URL tokens.

Frequent token sets of the pages labelled bad are mined by Spark's FP-growth, or level by level where pages have many
tokens; their support among all labelled pages
gives each rule "these tokens -> block" its confidence. Rules of little support or confidence, and rules that a shorter
one of at least their confidence covers, are pruned. The others are matched through an inverted index: every rule is
posted under its rarest token, a URL meets only the postings of its own tokens, and then the whole rule is tested.
Everything is a DataFrame or Spark ML step; no row passes through Python.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import BROADCAST_KEYS
from cadenza.session import materialize

# The listed rules as (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: A mined rule holds on this share of the pages labelled bad, and on MIN_PAGES of them, and is right this often.
MIN_SUPPORT = 0.01
MIN_PAGES = 5
MIN_CONFIDENCE = 0.6
#: FP-growth lists every frequent set, of which a page with more frequent tokens than this has exponentially many. If
#: there is such a page, the sets that can become rules are searched level by level instead; no token is left out.
MINED_TOKENS = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://"


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, _AFTER + r"([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _AFTER + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str = "url") -> Column:
    """Distinct parts of a URL: host labels, path segments and query parts, each marked with its place."""
    query = F.coalesce(F.regexp_extract(url, _AFTER + r"[^?#]*\?([^#]*)", 1), F.lit(""))

    def parts(text: Column, cut: str, mark: str) -> Column:
        whole = F.filter(F.split(text, cut), lambda part: part != "")
        return F.transform(whole, lambda part: F.concat(F.lit(mark), part))

    return F.array_distinct(
        F.concat(parts(host(url), r"\.", "host:"), parts(path(url), "/", "path:"), parts(query, "[&=]", "query:"))
    )


def listed(rules: list[tuple[str, str]], host_name: str = "host", path_name: str = "path") -> tuple[Column, Column]:
    """The longest listed rule that fits (null if none does), and its verdict."""
    rule, verdict = [], []
    for decision, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = text.partition("/")
        here = (F.col(host_name) == name) | F.col(host_name).endswith(f".{name}")
        fits = here & F.col(path_name).startswith(slash + start)
        rule.append(F.when(fits, F.lit(text)))
        verdict.append(F.when(fits, F.lit(decision)))
    none = F.lit(None).cast("string")
    return F.coalesce(*rule, none), F.coalesce(*verdict, none)


def covering(baskets: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of a basket and a rule whose tokens the basket holds: all columns of both.

    ``baskets`` has ``items``; ``index`` has ``rule_items`` and ``posted``, the token that the rule stands under. The
    index goes to all executors only if it is counted small.
    """
    small = index.count() <= BROADCAST_KEYS
    met = baskets.withColumn("posted", F.explode("items")).join(F.broadcast(index) if small else index, "posted")
    return met.where(F.forall("rule_items", lambda item: F.array_contains("items", item)))


def posted(rules: DataFrame, often: DataFrame) -> DataFrame:
    """Rules with the rarest of their tokens as ``posted``; ``often`` has token and seen."""
    each = rules.withColumn("token", F.explode("rule_items")).join(often, "token")
    return each.groupBy(*rules.columns).agg(F.min(F.struct("seen", "token")).alias("_rare")).select(
        *rules.columns, F.col("_rare.token").alias("posted")
    )


def telling_sets(bad_pages: DataFrame, baskets: DataFrame, often: DataFrame, least: int) -> DataFrame:
    """All token sets on ``least`` bad pages that can make a rule no shorter one covers: rule_items, level by level.

    A token that all pages of the other tokens hold changes no confidence, and nothing beats a set that is on bad pages
    alone. So a set goes on only if each of its tokens narrows it and it is on some good page too, which holds for all
    parts of such a set as well: a candidate of one more token needs all its parts in the level before.
    """
    level = often.where(F.col("bad_seen") >= least).select(
        F.array("token").alias("rule_items"), "seen", F.col("bad_seen").alias("support")
    )
    found, size = level.select("rule_items"), 1
    while True:
        level = materialize(level.where("seen > support").select("rule_items", "seen"), "url-level")
        start, last = F.slice("rule_items", 1, size - 1), F.element_at("rule_items", -1)
        left = level.select(F.col("rule_items").alias("own"), start.alias("start"), last.alias("last"))
        right = level.select(start.alias("start"), last.alias("more"))
        joined = left.join(right, "start").where(F.col("last") < F.col("more")).select(F.concat("own", F.array("more")).alias("rule_items"))
        without = F.transform(
            F.sequence(F.lit(0), F.lit(size)), lambda i: F.filter("rule_items", lambda t, at: at != i)
        )
        parts = joined.withColumn("part", F.explode(without)).join(
            level.select(F.col("rule_items").alias("part"), F.col("seen").alias("part_seen")), "part"
        )
        parts = parts.groupBy("rule_items").agg(F.count("*").alias("n"), F.min("part_seen").alias("fewest"))
        candidates = materialize(parts.where(F.col("n") == size + 1).select("rule_items", "fewest"), "url-candidates")
        if candidates.isEmpty():
            return found
        index = materialize(posted(candidates, often.select("token", "seen")), "url-sets")
        support = covering(bad_pages.select("items"), index).groupBy("rule_items", "fewest", "posted").agg(F.count("*").alias("support"))
        support = materialize(support.where(F.col("support") >= least), "url-sets")
        level = covering(baskets.select("items"), support).groupBy("rule_items", "fewest", "support").agg(F.count("*").alias("seen"))
        level = materialize(level.where("seen < fewest"), "url-level")
        found, size = found.unionByName(level.select("rule_items")), size + 1


def mine(
    baskets: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_pages: int = MIN_PAGES,
    min_confidence: float = MIN_CONFIDENCE,
    mined_tokens: int = MINED_TOKENS,
) -> DataFrame:
    """Rules from labelled token sets (``items``, boolean ``bad``): rule_items, support, confidence, posted.

    ``support`` counts the bad pages that hold the tokens, ``confidence`` is their share of all labelled pages that do.
    Without labelled bad pages there are no rules. ``mined_tokens`` chooses the way of the search, not its result.
    """
    baskets = materialize(baskets.withColumn("page", F.monotonically_increasing_id()), "url-baskets")
    each = baskets.select("page", "bad", F.explode("items").alias("token"))
    often = materialize(
        each.groupBy("token").agg(F.count("*").alias("seen"), F.count_if("bad").alias("bad_seen")), "url-tokens"
    )
    n_bad = baskets.where("bad").count()
    least = max(min_pages, -int(-min_support * n_bad // 1))
    kept = (
        each.where("bad")
        .join(often.where(F.col("bad_seen") >= least), "token")
        .groupBy("page")
        .agg(F.collect_list("token").alias("items"))
        .select("items")
    )
    kept = materialize(kept, "url-transactions")
    n_kept, longest = kept.agg(F.count("*"), F.max(F.size("items"))).first()
    if not n_kept:
        return baskets.limit(0).select(
            F.col("items").alias("rule_items"),
            F.lit(0).cast("long").alias("support"),
            F.lit(0.0).alias("confidence"),
            F.lit("").alias("posted"),
        )
    if longest > mined_tokens:
        sets = telling_sets(kept, baskets, often, least)
    else:
        # Spark takes a share and rounds the count up; half a page less keeps that at ``least``.
        grown = FPGrowth(itemsCol="items", minSupport=max(0.0, least - 0.5) / n_kept, minConfidence=1.0).fit(kept)
        sets = grown.freqItemsets.select(F.sort_array("items").alias("rule_items"))
    index = materialize(posted(sets, often.select("token", "seen")), "url-sets")
    counted = covering(baskets.select("items", "bad"), index).groupBy("rule_items", "posted").agg(
        F.count_if("bad").alias("support"), F.count("*").alias("_seen")
    )
    rules = counted.select("rule_items", "support", (F.col("support") / F.col("_seen")).alias("confidence"), "posted")
    rules = materialize(rules.where((F.col("support") >= least) & (F.col("confidence") >= min_confidence)), "url-rules")
    # A rule is idle if fewer of its tokens already make a rule of at least its confidence. Rules are matched as baskets.
    longer = rules.select(F.col("rule_items").alias("items"), F.col("confidence").alias("_confidence"))
    idle = (
        covering(longer, rules.select("rule_items", "confidence", "posted"))
        .where((F.size("rule_items") < F.size("items")) & (F.col("confidence") >= F.col("_confidence")))
        .select(F.col("items").alias("rule_items"))
        .distinct()
    )
    return materialize(rules.join(idle, "rule_items", "left_anti"), "url-rules")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the pages that ``labels`` covers (page_id = doc_id): bad if toxic or of no quality."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(
        (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("_toxic"), (F.coalesce(F.min("quality"), F.lit(1)) == 0).alias("_poor")
    )
    rows = pages.select("page_id", tokens().alias("items")).join(marks, "page_id")
    return rows.select("items", (F.col("_toxic") | F.col("_poor")).alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, **fit: float) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and what the mined rules say.

    A URL that a listed rule fits gets the verdict of the longest one. Any other is blocked if a mined rule's tokens are
    all in it, else allowed; ``mined_tokens`` and ``mined_confidence`` show the best such rule (highest confidence, then
    support, then fewest tokens, then tokens in order), null if none matches. ``fit`` goes to ``mine``.

    Null URLs and URLs without ``://`` have empty host and path, no tokens, and are allowed. Repeated and null page_ids
    are rows of their own; labels of a null id are left out, and a page labelled twice is bad if either label is. Empty
    tables give no rules, or no rows. Other columns are not looked at.
    """
    own = pages.select("page_id", "url")
    found = mine(labelled(own, labels), **fit)
    rows = materialize(
        own.select(F.monotonically_increasing_id().alias("row"), "page_id", host().alias("host"), path().alias("path"), tokens().alias("items")),
        "url-rows",
    )
    better = F.struct(-F.col("confidence"), -F.col("support"), F.size("rule_items"), F.col("rule_items"))
    best = (
        covering(rows.select("row", "items"), found)
        .groupBy("row")
        .agg(F.min(better).alias("_best"))
        .select("row", F.col("_best.rule_items").alias("mined_tokens"), (-F.col("_best.col1")).alias("mined_confidence"))
    )
    rule, verdict = listed(RULES if rules is None else rules)
    mined = F.when(F.col("mined_tokens").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"),
        F.array_join("mined_tokens", " ").alias("mined_tokens"), "mined_confidence",
    )
