"""URL verdicts by pattern rules that are indexed by their rarest literal token.

Every rule is a regular expression over host and path (or the whole URL) and has literal tokens that any URL it
fits must hold as whole runs of [a-z0-9]. Spark counts how many URLs hold each of the rules' tokens; a rule is
filed under its rarest. A URL's tokens fetch the rules filed under them, and only those expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES, LITERALS = 200_000, 2_000  #: a list of more rules is joined by shuffle; one of more is local data, not constants


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  #: allow or block
    regex: str
    tokens: tuple[str, ...]  #: whole tokens of every URL that fits
    on: str = "place"  #: host and path, or url: the lower-cased URL


def place_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits the host and its subdomains, if the URL's path starts with path."""
    ends = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path)  # the last token may go on in a URL
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*re.findall("[a-z0-9]+", host), *ends))


#: Fixed values.
PLACES = (place_rule("block", "net"), place_rule("allow", "example.net", "/en/"), place_rule("block", "example.com", "/de/"), place_rule("allow", "org", "/fr/"))


def word_rule(*words: str) -> Rule:
    """Blocks URLs that hold the words side by side as whole tokens, whatever separates them."""
    inner = "[^a-z0-9]+".join(words)
    return Rule(" ".join(words), "block", rf"(?:^|[^a-z0-9]){inner}(?:[^a-z0-9]|$)", words, "url")


#: Words of hosts and paths that stand for gambling, adult content, pharmacy spam, piracy and lures.
WORDS = """
casino; poker; roulette; slots; jackpot; sportsbook; bets; betting; bingo; lottery; gambling
porn; xxx; sex; nude; escort; camgirls; hentai
viagra; cialis; pills; pharmacy online; cheap meds; steroids
warez; torrent; keygen; crack download; cracked; free download; mp3 download
win prize; free gift; free money; get rich; payday loan; work from home; click here; hot deals; replica watches
"""
PATTERNS = tuple(word_rule(*words.split()) for line in WORDS.strip().split("\n") for words in line.split("; "))


def rules_of(table: DataFrame, most: int = BROADCAST_RULES) -> tuple[Rule, ...]:
    """Word rules from a table with a column `words`: tokens of [a-z0-9], separated by spaces; `most` rows at most, else an error."""
    rows = table.select(F.lower(F.trim("words")).alias("words")).where("words rlike '^[a-z0-9]+( [a-z0-9]+)*$'").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return tuple(word_rule(*x.words.split()) for x in sorted(rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda x: x != ""))


def _table(spark, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A list of rules as a table: constants, without Python workers; a list too long for that as local data."""
    if len(rows) > LITERALS:
        return spark.createDataFrame(rows, list(names))
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows])))


def index(rows: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[str, Rule]]:
    """(token, rule): each rule under the token of it that fewest of the rows' URLs hold."""
    known = sorted({t for r in rules for t in r.tokens})
    table = _table(rows.sparkSession, [(t,) for t in known], ("token",))
    table = F.broadcast(table) if len(known) <= BROADCAST_RULES else table.hint("merge")
    counts = {t: n for t, n in rows.select(F.explode("tokens").alias("token")).join(table, "token").groupBy("token").count().collect()}  # a row for each token of the rules
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r) for r in rules]


def judge_urls(pages: DataFrame, *, places: tuple[Rule, ...] = PLACES, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row.

    The place rule with the longest name that fits gives rule and verdict; without one, rule is null and the
    verdict is block if a pattern fits (pattern: the first by name), else allow. A null URL, or one without ://, has empty host
    and path; page_id may be null; repeated rows each give one; other columns are ignored; an empty table gives no rows;
    a URL of any length is judged whole.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.coalesce(F.col("url").cast("string"), F.lit("")), UPPER, LOWER).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"place": F.concat("host", "path"), "row": F.monotonically_increasing_id()}).withColumn("tokens", tokens(F.concat_ws(" ", "url", F.translate("place", UPPER, LOWER))))
    filed = [(t, r.name, r.verdict, r.regex, r.on, r.on == "place") for t, r in index(rows, (*places, *patterns))]
    rules = _table(spark, filed, ("token", "name", "rule_verdict", "regex", "over", "is_place"))
    rules = F.broadcast(rules) if len(filed) <= BROADCAST_RULES else rules.hint("merge")
    over = F.when(F.col("over") == "url", F.col("url")).otherwise(F.col("place"))
    fits = rows.select("page_id", "row", "host", "path", "url", "place", F.explode_outer("tokens").alias("token")).join(rules, "token", "left")
    fits = fits.withColumn("fit", F.when(F.col("regex").isNotNull(), F.rlike(over, F.col("regex"))).otherwise(False))
    name = F.when(F.col("fit") & F.col("is_place"), F.struct(F.length("name").alias("size"), "name", "rule_verdict"))
    found = fits.groupBy("page_id", "row", "host", "path").agg(F.max(name).alias("best"), F.min(F.when(F.col("fit") & ~F.col("is_place"), F.col("name"))).alias("pattern"))
    verdict = F.coalesce(F.col("best.rule_verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), "pattern")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("pattern")


_ANY = "|".join(r.regex for r in PATTERNS)
_CASES = " ".join(f"WHEN regexp_matches(place, '{r.regex}') THEN '{r.name}'" for r in sorted(PLACES, key=lambda r: -len(r.name)))
_VERDICTS = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in PLACES)
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
q AS (SELECT page_id, url, translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, host || path AS place FROM q),
s AS (SELECT *, CASE {_CASES} END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE rule {_VERDICTS} ELSE CASE WHEN regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{_ANY}') THEN 'block' ELSE 'allow' END END AS verdict
FROM s
"""
