"""URL filter by association rules: FP-growth mines token combinations of labelled urls, an index matches them.

A url becomes a set of tokens that carry their kind: ``p:`` scheme, ``h1:``, ``h2:`` ... host labels from the
right, ``s:`` path segments, ``q:`` query keys (runs of digits in both read ``#``), ``f:`` for a fragment. Labels are verdicts that are known already:
here those of a short list of host and path rules (``POLICY``), so the mined rules carry the policy's
intent over to urls that no rule of it covers. Spark's FP-growth finds the combinations held by at
least ``MIN_SUPPORT`` of the labelled urls; those of which at least ``MIN_CONFIDENCE`` have one label become rules. A rule goes if one
token less gives a rule of the same verdict that is at least as confident.

FP-growth sees a url's distinct tokens in runs of ``RUN`` (in the order above), so that one url with very many tokens cannot
blow up the combinations: there are at most 2 ** RUN / MIN_SUPPORT of them per label. Short urls are one run. All counts that decide
about a rule are taken again over whole urls, by the same match that applies the rules.

Labels come in blocks: all urls of one policy rule have the same verdict, and whatever else they share would look like its
cause (if the only labels below ``com`` are those of a rule for ``/de/``, ``com`` itself seems to be blocked). So a combination becomes
a rule only if its verdict comes from at least two ``source`` values, here two policy rules.

The index holds each rule under its rarest token: a url looks up its own tokens, and only rules found there are
tested in full. Of the rules that fit, the most confident decides, then the one of more urls, then the one of more
tokens, then the least by text; a url that no rule fits is allowed.

Nulls, empty texts and texts without ``://`` have an empty host and path, no tokens and the verdict ``allow``. Repeated rows count and are judged each;
an empty table, or one without labelled urls, gives no rules. Very long urls are read whole. Further columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.storage import stage
from sheafspark.session import attach

MIN_SUPPORT, MIN_CONFIDENCE, RUN = 1 / 128, 0.75, 12
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Holds for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The given rules: block net/, allow example.net/en/, block example.com/de/, allow org/fr/.
POLICY = (
    HostRule("net", "/", BLOCK),
    HostRule("example.net", "/en/", ALLOW),
    HostRule("example.com", "/de/", BLOCK),
    HostRule("org", "/fr/", ALLOW),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def policy_rule(host: Column, path: Column, policy: tuple[HostRule, ...] = POLICY) -> Column:
    """(rule, verdict) of the longest rule of a short list that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(policy, key=lambda r: (len(r.text), r.text)):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = inside & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url; none without ``://``."""

    def kind(mark: str, parts: Column) -> Column:
        named = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))
        return F.regexp_replace(F.array_join(named, "\n"), r"[0-9]+", "#") if mark in ("s:", "q:") else F.array_join(named, "\n")

    # One line per token; a line break inside a url, which no valid one has, parts its token.
    rest = _after_scheme(url)
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    labels = F.reverse(F.split(host_of(url), r"\."))
    placed = F.array_join(
        F.filter(F.transform(labels, lambda p, i: F.when(p != "", F.concat(F.lit("h"), i + 1, F.lit(":"), p)).otherwise("")), lambda p: p != ""),
        "\n",
    )
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("p:"), scheme),
        placed,
        kind("s:", F.split(path_of(url), "/")),
        kind("q:", keys),
        F.when(F.instr(rest, "#") > 0, F.lit("f:")),
    )
    known = F.array_distinct(F.filter(F.split(lines, "\n"), lambda line: line != ""))
    return F.when(F.instr(url, "://") > 0, known).otherwise(F.array().cast("array<string>"))


def _fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` (with ``tokens``) once per rule that fits, found by the rule's rarest token."""
    looked_up = urls.withColumn("token", F.explode("tokens"))
    return looked_up.join(rules, F.col("token") == F.col("rarest")).where(F.forall("items", lambda item: F.array_contains("tokens", item)))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    run: int = RUN,
) -> DataFrame:
    """Rules learnt from rows (url, verdict, source); rows without a verdict teach nothing.

    Columns: items (sorted tokens), rarest (the one of the fewest urls), verdict, n (labelled urls that hold all items), n_verdict
    (those of them with this verdict), confidence.
    """
    spark = labelled.sparkSession
    counted = labelled.where("verdict IS NOT NULL").groupBy("url", "verdict", "source").agg(F.count("*").alias("n_rows"))
    # Few bytes but much work per url: spread over all tasks, which an adaptive plan would not do by size.
    spread = attach(counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), tokens=url_tokens(F.col("url")))
    known = stage(spread.where(F.size("tokens") > 0))
    runs = F.expr(f"transform(sequence(0, (size(tokens) - 1) div {run}), i -> slice(tokens, i * {run} + 1, {run}))")
    # One row per labelled url again: repeated urls count as often as they occur.
    rows = known.withColumn("again", F.explode(F.expr("array_repeat(0, CAST(n_rows AS INT))")))
    label = F.concat(F.lit("label:"), "verdict")
    groups = rows.select(F.explode(runs).alias("part"), label.alias("label")).select(F.array_append("part", F.col("label")).alias("items"))
    total = known.agg(F.sum("n_rows").alias("urls"), F.sum(F.col("n_rows") * F.size(runs)).alias("runs")).first()
    empty = "items array<string>, rarest string, verdict string, n long, n_verdict long, confidence double"
    if not total.urls:
        return spark.createDataFrame([], empty)
    # A verdict of two sources has two urls at least; single urls would be all their combinations.
    least = max(2, math.ceil(min_support * total.urls))
    # Half a row below the least count, so that rounding cannot move it.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total.runs, minConfidence=min_confidence).fit(groups)
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("item"), "freq")
    mined = (
        model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("label:")))
        .select(F.array_sort("antecedent").alias("items"))
        .distinct()
    )
    rarest = (
        mined.select("items", F.explode("items").alias("item"))
        .join(single, "item")
        .groupBy("items")
        .agg(F.min(F.struct("freq", "item")).alias("least"))
        .select("items", F.col("least.item").alias("rarest"))
    )
    candidates = stage(rarest)
    counts = _fitting(known.select("tokens", "verdict", "source", "n_rows"), candidates).groupBy("items", "rarest", "verdict")
    counts = stage(counts.agg(F.sum("n_rows").alias("n_verdict"), (F.min("source") < F.max("source")).alias("several")))
    whole = counts.groupBy("items").agg(F.sum("n_verdict").alias("n"))
    confidence = F.col("n_verdict") / F.col("n")
    rules = counts.join(whole, "items").withColumn("confidence", confidence)
    rules = stage(rules.where((F.col("confidence") >= min_confidence) & (F.col("n_verdict") >= least) & F.col("several")))
    less = rules.select("items", "verdict", "confidence", F.explode("items").alias("left_out"))
    less = less.withColumn("rest", F.array_remove("items", F.col("left_out")))
    simple = rules.select(F.col("items").alias("rest"), "verdict", F.col("confidence").alias("simpler"))
    needless = less.join(simple, ["rest", "verdict"]).where("simpler >= confidence").select("items", "verdict").distinct()
    return rules.join(needless, ["items", "verdict"], "left_anti").select(*[part.split()[0] for part in empty.split(", ")])


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct ``url`` that some rule fits: mined_verdict, pattern (the deciding rule's items), confidence.

    Urls are made distinct first, so a very frequent one is matched once.
    """
    known = attach(urls.select("url").distinct(), tokens=url_tokens(F.col("url")))
    hits = _fitting(known, rules)
    best = F.min(
        F.struct(
            (-F.col("confidence")).alias("doubt"),
            (-F.col("n_verdict")).alias("fewness"),
            (-F.size("items")).alias("shortness"),
            F.array_join("items", " ").alias("pattern"),
            "verdict",
        )
    )
    chosen = hits.groupBy("url").agg(best.alias("best"))
    return chosen.select("url", F.col("best.verdict").alias("mined_verdict"), F.col("best.pattern").alias("pattern"), (-F.col("best.doubt")).alias("confidence"))


def judge_urls(pages: DataFrame, policy: tuple[HostRule, ...] = POLICY, rules: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, pattern.

    The policy decides where one of its rules fits (``rule``); elsewhere the mined rules (``pattern``), else ``allow``. Without
    ``rules`` they are mined from the urls that the policy decides.
    """
    parsed = attach(pages.select("page_id", "url"), host=host_of(F.col("url")), path=path_of(F.col("url")))
    parsed = parsed.withColumns({name: F.coalesce(name, F.lit("")) for name in ("host", "path")})
    ruled = stage(parsed.withColumn("given", policy_rule(F.col("host"), F.col("path"), policy)))
    if rules is None:
        rules = stage(mine_rules(ruled.where("given IS NOT NULL").select("url", F.col("given.verdict").alias("verdict"), F.col("given.rule").alias("source"))))
    open_urls = ruled.where("given IS NULL AND url IS NOT NULL")
    matched = match_rules(open_urls, rules).withColumnRenamed("url", "matched_url")
    found = ruled.join(matched, (F.col("url") == F.col("matched_url")) & F.col("given").isNull(), "left")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined_verdict", F.lit(ALLOW)).alias("verdict"),
        "pattern",
    )
