"""URL filters: pattern rules indexed by their rarest literal token.

A rule is text with `||` (start of the host or of one of its parent domains), `*`
(anything) and `^` (a separator or the end); all else is literal.  It is matched
against host + path.  Each rule is filed under the one of its whole literal tokens
that the fewest URLs hold; rules without such a token are filed under the empty
token, which every URL has.  A URL's tokens fetch its candidates, and only those run
their regular expression.

DataFrame functions only.  URLs are judged once per distinct host + path, so that a
very common one costs a row; the rows of one are dealt out to get its verdict, and URLs
without host and path get theirs without a join.  The rule index is broadcast if it has at most
`BROADCAST_RULES` rows and joined by token otherwise.

Null URLs and URLs without `://` have an empty host and path, which no rule fits.
Among fitting rules the highest tier wins, then the longest, then the least text.
Repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 50_000
#: Parts into which the rows of a URL are dealt.
SALTS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_regex(rule: Column) -> Column:
    body = F.regexp_replace(rule, r"^\|\|", "")
    body = F.regexp_replace(body, r"([\\.+?$(){}\[\]|])", r"\\$1")
    body = F.replace(body, F.lit("^"), F.lit("(?:[^A-Za-z0-9_.%-]|$)"))
    body = F.replace(body, F.lit("*"), F.lit(".*"))
    return F.concat(F.when(rule.startswith("||"), r"^(?:[^/]*\.)?").otherwise(""), body)


def rule_tokens(rule: Column) -> Column:
    """Literal tokens that are whole in every URL the rule fits: no `*` or open end beside them."""
    return F.array_distinct(F.regexp_extract_all(rule, F.lit(r"(?:(?<=^\|\|)|(?<=[^A-Za-z0-9*|]))[A-Za-z0-9]+(?=[^A-Za-z0-9*])"), F.lit(0)))


def url_tokens(key: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(key, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.array(F.lit(""))))


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """rules (rule, action, tier) with `regex` and `token`, the rarest among `tokens` (token: one row for each URL that holds it)."""
    own = rules.select("*", F.explode_outer(rule_tokens(F.col("rule"))).alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    wanted = own.select("token").distinct()
    wanted = F.broadcast(wanted) if rules.count() <= BROADCAST_RULES else wanted
    held = tokens.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    ranked = own.join(held, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    rarest = ranked.groupBy("rule", "action", "tier").agg(F.min_by("token", F.struct("urls", "token")).alias("token"))
    return rarest.withColumn("regex", rule_regex(F.col("rule")))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, tier, action of the winning rule (null if none fits) for every row of `pages`.

    rules: rule string, action string, tier int.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keys = urls.select(F.concat("host", "path").alias("key")).distinct()
    tokens = keys.select("key", F.explode(url_tokens(F.col("key"))).alias("token"))
    rules = rules.select("rule", "action", F.col("tier").cast("int").alias("tier")).distinct()
    index = index_rules(rules, tokens.select("token"))
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index
    fits = tokens.join(index, "token").where(F.rlike(F.col("key"), F.col("regex")))
    order = F.struct("tier", F.length("rule"), F.struct("action"))
    best = fits.groupBy("key").agg(F.max_by(F.struct("rule", "tier", "action"), order).alias("best"))
    keyed = urls.withColumn("key", F.concat("host", "path"))
    dealt = keyed.where("key <> ''").withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)))
    judged = dealt.join(best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left").select("id", "host", "path", "best")
    judged = judged.union(keyed.where("key = ''").select("id", "host", "path", F.lit(None).cast(best.schema["best"].dataType)))
    return judged.select(F.col("id").alias(id_col), "host", "path", "best.rule", "best.tier", "best.action")
