"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path`` with a verdict.  Its literal tokens are
the alphanumeric runs that must stand whole in every url it fits; they are read off the parsed
expression (``literal_tokens``).  The rarest of them in the
urls at hand (counted by Spark) indexes the rule; a url's tokens fetch the rules indexed by
one of them, and only those run their regular expressions.  A rule without such a token is a
candidate for every url.

Prefix rules (``example.org/es/``: the host, its subdomains, and paths that start so) decide
first, the longest wins, ties by the smaller rule.  Then the pattern rules of the method
(``PATTERNS``) block; what is left is allowed.
"""

from __future__ import annotations

import re
from re import _constants as _re
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, partitions, table
from cohortlens.plans.joins import broadcast_if_small, fits_broadcast

# Fixed values of the query: host and path of each rule.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
# The method's own rules: words that block where they stand alone in the host.
WORDS = ["adult", "casino", "gambling", "malware", "phishing", "porn", "torrent", "viagra", "xxx"]
PATTERNS = [(w, rf"^[^/]*\b{w}\b[^/]*(/|$)") for w in WORDS]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[^A-Za-z0-9]+"


def prefix_rule(rule: str) -> tuple[str, str, list[str]]:
    """(rule, pattern, literal tokens) of a host and path prefix.

    The last run of the path may go on in the url, so it is a token only if the rule goes on
    behind it.
    """
    host, slash, path = rule.partition("/")
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", rule)
    whole = re.split(_TOKEN, host) + re.split(_TOKEN, path)[:-1]
    return rule, rf"^([^/]*\.)?{quoted}", sorted({t for t in whole if t})


def literal_tokens(pattern: str) -> list[str]:
    """Alphanumeric ASCII runs that stand whole in every text the expression fits.

    A run counts if its letters are literals that must appear, with a word boundary, an end of
    the text or another literal on either side.  What may be left out, repeated or chosen ends a
    run without being such a side, so some tokens may be missed but none is wrong.  Flags and
    syntax that the parser does not know give no tokens.
    """
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE | re.MULTILINE):
        return []
    side, open_ = "side", "open"  # a certain end of a token; anything
    sides = (_re.AT_BEGINNING, _re.AT_BEGINNING_STRING, _re.AT_END, _re.AT_END_STRING, _re.AT_BOUNDARY)

    def flat(items):
        for op, value in items:
            if op is _re.LITERAL:
                c = chr(value)
                yield c if c.isascii() and c.isalnum() else side
            elif op is _re.AT and value in sides:
                yield side
            elif op is _re.SUBPATTERN and not value[1] and not value[2]:
                yield from flat(value[3])
            else:
                yield open_

    out, run, left = set(), "", open_
    for x in [*flat(tree), open_]:
        if x in (side, open_):
            if run and left is side and x is side:
                out.add(run)
            run, left = "", x
        else:
            run += x
    return sorted(out)


def rule_table(spark, rules: list[tuple[str, str]] | None = None, patterns=None) -> DataFrame:
    """rule, pattern, tokens, verdict, rank: higher ranks decide first."""
    rows = []
    for verdict, rule in RULES if rules is None else rules:
        name, pattern, tokens = prefix_rule(rule)
        rows.append((name, pattern, tokens, verdict, len(name) + 1))
    for name, pattern, *_ in PATTERNS if patterns is None else patterns:
        rows.append((name, pattern, literal_tokens(pattern), "block", 0))
    return spark.createDataFrame(rows, "rule string, pattern string, tokens array<string>, verdict string, rank int")


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))


def _met(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Urls with the rules that their tokens fetch.

    A rule index beyond the broadcast bound is shuffled.  Some tokens, the empty one first,
    stand in very many urls: each token's urls are cut into slices, and its rules go to all.
    """
    if fits_broadcast(index):
        return tokens.join(F.broadcast(index), "token")
    slices = partitions(tokens.sparkSession)
    return (tokens.withColumn("slice", F.pmod(F.xxhash64("url"), F.lit(slices)).cast("int"))
            .join(index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["token", "slice"]))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    Null urls and urls without ``://`` have an empty host and path, fit no rule and are
    allowed.  ``rule`` names the prefix rule that decided, else it is null.  Repeated urls
    are judged once and share the answer.  Other columns are ignored; no rows give none.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct().select("url", F.concat(host, path).alias("subject"))
    # every url has the empty token, which indexes the rules that have no literal of their own
    named = urls.select("url", "subject", F.array_distinct(
        F.concat(F.array(F.lit("")), F.split("subject", _TOKEN))).alias("tokens"))
    literals = rules.select("rule", "rank", F.explode_outer("tokens").alias("token"))
    wanted = broadcast_if_small(literals.select("token").where("token is not null").distinct())
    counts = (named.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
              .groupBy("token").agg(F.count(F.lit(1)).alias("urls")))
    rarest = (literals.join(counts, "token", "left")
              .groupBy("rule", "rank").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("r"))
              .select("rule", "rank", F.coalesce("r.token", F.lit("")).alias("token")))
    index = materialize(rarest.join(rules.select("rule", "rank", "pattern", "verdict"), ["rule", "rank"]), "rule_index")
    tokens = named.select("url", "subject", F.explode("tokens").alias("token"))
    hits = _met(tokens, index).where(F.expr("subject rlike pattern"))
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("rank")).alias("order"), "rule", "verdict")).alias("best"))
    return (pages.select("page_id", "url").join(best, "url", "left")
            .select("page_id", host.alias("host"), path.alias("path"),
                    F.when(F.col("best.order") < 0, F.col("best.rule")).alias("rule"),
                    F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


OP7_SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS n
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}
), fits AS (
  SELECT n, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '\\b({"|".join(WORDS)})\\b') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""
