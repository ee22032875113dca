"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host`` followed by ``path`` with an
action.  Its literal tokens (runs of letters and digits that every matching url
holds whole) are known; the rule is filed under the one that the fewest urls
hold.  The tokens of a url fetch the rules filed under them, and only those run
their regular expression.  Rules without any literal token are filed under the
empty token, which every url holds.

Each distinct url is judged once per distinct (page_id, url) row group.  Exploded
tokens are joined with the rule index: rules up to ``INDEX_BYTES`` are broadcast, so
no token is shuffled; beyond it every rule stands once for each of ``SALTS`` salts
and a url's tokens take one of them by its hash, so a token that a third of all
urls hold is dealt to that many keys.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the task: (action, host and path prefix).
TASK_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
              ("allow", "com/fr/"), ("block", "com/de/"))
#: The method's own patterns: a host label that holds such a word as a whole
#: part (parts are cut at hyphens and dots) is blocked unless a rule fits.
BAD_HOST_WORDS = ("adult", "ads", "adserver", "betting", "casino", "cheap", "clickbait", "doubleclick", "gambling",
                  "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "tracker", "viagra", "warez", "xxx")
#: Bytes of rules up to which the index is broadcast, and salts of a token beyond it.
INDEX_BYTES = 8_000_000
SALTS = 64
#: What a url without any fitting rule or pattern gets.
DEFAULT = "allow"
_TOKEN = r"[a-z0-9]+"


class Rule(NamedTuple):
    """``priority`` decides between matching rules: the largest, then the name."""

    name: str | None
    action: str
    pattern: str
    tokens: tuple[str, ...]
    priority: int


def _literal(text: str) -> str:
    """``text`` as a regular expression that both Java and RE2 read."""
    return re.sub(r"([.^$|?*+()\[\]{}\\])", r"\\\1", text)


def prefix_rule(action: str, text: str) -> Rule:
    """Rule of a host and its subdomains and a path prefix, like ``net/a/b``.

    Tokens that end the prefix may go on in a url and aren't literal tokens."""
    host, _, path = text.partition("/")
    path = "/" + path
    tokens = re.findall(_TOKEN, host.lower())
    inner = path[:len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]
    tokens += re.findall(_TOKEN, inner.lower())
    return Rule(text, action, rf"^([^/]*\.)?{_literal(host)}{_literal(path)}", tuple(tokens), 1_000_000 + len(text))


def host_word_rule(word: str) -> Rule:
    return Rule(None, "block", rf"^([^/]*[.\-])?{_literal(word)}([.\-:][^/]*)?(/|$)", (word,), 0)


DEFAULT_RULES = tuple(prefix_rule(*r) for r in TASK_RULES) + tuple(host_word_rule(w) for w in BAD_HOST_WORDS)


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; then up to ``?``, ``#`` or the end.  Both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(host: F.Column, path: F.Column) -> F.Column:
    """Distinct literal tokens of a url, and the empty token."""
    lower = F.translate(F.concat(host, path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lower, F.lit(_TOKEN), 0)))


def index(urls: DataFrame, rules: DataFrame, size: int = 0) -> DataFrame:
    """Rules (no, tokens, ...) with ``token``: the literal token that the fewest
    rows of ``urls`` (tokens) hold, counted over all of them; ``size``: bytes of the
    rules.  Tokens are counted map-side, before any shuffle."""
    wanted = rules.select("no", F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    held = urls.select(F.explode("tokens").alias("token"))
    if size <= INDEX_BYTES:
        held = held.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (wanted.join(counts, "token", "left").groupBy("no")
              .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token")))
    return rules.drop("tokens").join(rarest, "no")


def with_rules(urls: DataFrame, filed: DataFrame, size: int) -> DataFrame:
    """(page_id, url, host, path, rule columns): urls with the rules filed under
    one of their tokens; ``size``: bytes of the rules."""
    held = urls.select("page_id", "url", "host", "path", F.explode("tokens").alias("token"))
    if size <= INDEX_BYTES:
        return held.join(F.broadcast(filed), "token")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return held.withColumn("salt", salt).join(salted, ["token", "salt"]).drop("salt")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    A null url or one without ``://`` has empty host and path and gets the
    default.  Repeated rows are judged once and given back as often as they
    stood.  Of several matching rules the one of highest priority decides
    (prefix rules before host words, longer before shorter), then the name, then
    the action, then the pattern.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    urls = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
            .groupBy("page_id", "url").agg(F.count("*").alias("copies"))
            .select("page_id", "copies", F.xxhash64("url").alias("uh"), F.col("url"), host.alias("host"), path.alias("path"))
            .withColumn("tokens", tokens(F.col("host"), F.col("path"))))
    urls = common.staged(urls, "urls")
    rows = spark.createDataFrame([(i, r.name, r.action, r.pattern, list(r.tokens), r.priority) for i, r in enumerate(rules)],
                                 "no long, name string, action string, pattern string, tokens array<string>, priority long")
    size = sum(len(r.pattern) + len(r.name or "") + 64 for r in rules)
    found = (with_rules(urls, index(urls, rows, size), size)
             .filter(F.expr("regexp_like(concat(host, path), pattern)"))
             .groupBy("page_id", "url")
             .agg(F.min(F.struct((-F.col("priority")).alias("p"), "name", "action", "pattern")).alias("hit")))
    u, f = urls.alias("u"), found.alias("f")
    out = u.join(f, F.col("u.page_id").eqNullSafe(F.col("f.page_id")) & F.col("u.url").eqNullSafe(F.col("f.url")), "left")
    return (out.select("u.page_id", "u.host", "u.path", F.col("f.hit.name").alias("rule"),
                       F.coalesce("f.hit.action", F.lit(default)).alias("verdict"),
                       F.explode(F.sequence(F.lit(1), F.col("u.copies"))).alias("copy")).drop("copy"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url: page_id, host, path, rule, verdict."""
    return judge(common.table(spark, sf_dir, "pages"))


def oracle(rules: tuple[Rule, ...] = DEFAULT_RULES, default: str = DEFAULT) -> str:
    """DuckDB SQL: every rule against every url."""
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(r.name)}, {quoted(r.action)}, {quoted(r.pattern)}, {r.priority})" for r in rules)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rules(name, action, pattern, priority) AS (VALUES {values}),
rest AS (SELECT row_number() OVER () AS row_no, page_id,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT row_no, page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS host, rest FROM rest),
urls AS (SELECT row_no, page_id, translate(host, '{upper}', '{lower}') AS host,
                regexp_extract(substr(rest, length(host) + 1), '^([^?#]*)', 1) AS path FROM split),
hits AS (SELECT row_no, name, action, row_number() OVER (PARTITION BY row_no ORDER BY priority DESC, name NULLS FIRST, action, pattern) AS place
         FROM urls JOIN rules ON regexp_matches(host || path, pattern))
SELECT page_id, host, path, name AS rule, coalesce(action, '{default}') AS verdict
FROM urls LEFT JOIN hits ON urls.row_no = hits.row_no AND place = 1
"""
