"""URL rules, then a blocked Bloom filter of listed URLs with an exact join behind it.

A listed URL covers its host with all subdomains, and all paths below its own. Each page
asks for the keys that could cover it: a suffix of its host with the first folders of its
path, for every pair of numbers of labels and folders that the list has. A key longer than
all listed ones is not asked for, so that a url costs time in proportion to its length. The
keys pass a blocked Bloom filter, kept as a table of 256-bit blocks; the few that pass meet
the list in an exact hash join, which removes the false positives.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed; urls of any length are judged whole; slashes in a row count as one
between folders; repeated rows are judged alike and all returned; an empty table or an empty
list work; null and unusable lines of a list cover nothing; only the id and the url are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path); a rule is named by its host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Listed sites.
LISTED = tuple(f"http://{name}.example.{zone}/" for name in (
    "ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"
) for zone in ("com", "net", "org"))

#: A filter up to this size is broadcast; a larger one is joined by shuffling both sides.
MOST_BROADCAST_BYTES = 16 << 20
#: Copies of a block or list row when both sides are shuffled, so that one hot key is dealt to as many tasks.
SALTS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(below))
        name, verdict = F.when(fits, at + below).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def canonical(url: Column) -> Column:
    """``host/path/`` of a url without scheme, query and fragment; slashes in a row are one."""
    host, path = host_and_path(url)
    return F.concat(host, F.regexp_replace(F.concat(path, F.lit("/")), r"/+", "/"))


def shape(key: Column) -> tuple[Column, Column]:
    """Numbers of labels of the host and of folders of a canonical key."""
    count = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    return count(F.substring_index(key, "/", 1), ".") + 1, count(key, "/") - 1


def lookup_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]], longest: int) -> Column:
    """The keys of a page that have one of the list's ``shapes`` (labels, folders) and are no longer than ``longest``."""
    if not shapes:
        return F.array().cast("array<string>")
    most = max(folders for _, folders in shapes)
    # Only as many folders as the list has are split off; a last part holds the rest.
    parts = F.split(F.regexp_replace(path, r"^/+|/+(?=/)|/+$", ""), "/", most + 1)
    folders = F.when(F.length(F.replace(path, F.lit("/"), F.lit(""))) > 0, F.size(parts)).otherwise(0)
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = []
    for n, depth in shapes:
        below = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/")) if depth else F.lit("/")
        key = F.concat(F.substring_index(host, ".", -n), below)
        keys.append(F.when((labels >= n) & (folders >= depth), key))
    return F.when(host != "", F.filter(F.array(*keys), lambda k: k.isNotNull() & (F.length(k) <= longest))).otherwise(F.array().cast("array<string>"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Eight bits of a 256-bit block, two in each of its four words."""
    bits = F.xxhash64(key, F.lit(17))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, at).bitwiseAND(63).cast("int"))
    return [one(12 * i).bitwiseOR(one(12 * i + 6)) for i in range(4)]


def blocked_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter of ``keys`` as rows ``(block, w0, w1, w2, w3)``; empty blocks have no row."""
    rows = keys.select(_block(F.col(column), blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(column)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)))


def _join(left: DataFrame, right: DataFrame, on: str, broadcast: bool) -> DataFrame:
    """An inner join with a right side whose rows are few for each key; a hot key is dealt to ``SALTS`` tasks."""
    if broadcast:
        return left.join(F.broadcast(right), on)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64("__url"), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"]).drop("__salt")


def listed_urls(
    urls: DataFrame, listed: DataFrame, url_column: str = "url", listed_column: str = "url", bits_per_key: int = 24,
) -> DataFrame:
    """The distinct ``__url`` of ``urls`` that the list covers."""
    keys = listed.select(canonical(F.col(listed_column).cast("string")).alias("key")).where(F.col("key") != "/").distinct()
    labels, folders = shape(F.col("key"))
    shaped = keys.groupBy(labels.alias("labels"), folders.alias("folders")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("key")).alias("longest")
    ).collect()
    count, longest = sum(r["n"] for r in shaped), max((r["longest"] for r in shaped), default=0)
    blocks = max(1, -(-count * bits_per_key // 256))
    small = blocks * 48 <= MOST_BROADCAST_BYTES and count * (longest + 64) <= MOST_BROADCAST_BYTES
    distinct = urls.select(F.col(url_column).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    host, path = host_and_path(F.col("__url"))
    asked = distinct.select("__url", host.alias("host"), path.alias("path"))
    wanted = lookup_keys(F.col("host"), F.col("path"), sorted((r["labels"], r["folders"]) for r in shaped), longest)
    asked = asked.select("__url", F.explode(wanted).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    probed = _join(asked, blocked_filter(keys, "key", blocks), "block", small)
    passes = [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("key")))]
    hits = probed.where(passes[0] & passes[1] & passes[2] & passes[3]).select("__url", "key")
    return _join(hits, keys, "key", small).select("__url").distinct()


def judge(
    pages: DataFrame, listed: DataFrame, id_column: str = "page_id", url_column: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``id, host, path, rule, verdict`` of every row of ``pages``."""
    own = pages.select(F.col(id_column), F.col(url_column).cast("string").alias("__url"))
    parsed = own.select(id_column, "__url", *(c.alias(n) for c, n in zip(host_and_path(F.coalesce(F.col("__url"), F.lit(""))), ("host", "path"))))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"))
    # Only urls that no rule decides are looked up.
    found = materialise(listed_urls(parsed.where(F.col("rule").isNull()), listed, "__url").withColumn("listed", F.lit(True)))
    if (found.agg(F.sum(F.octet_length("__url") + 64)).first()[0] or 0) <= MOST_BROADCAST_BYTES:
        out = parsed.join(F.broadcast(found), "__url", "left")
    else:  # a url that very many rows repeat is dealt to as many tasks as there are salts
        salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = parsed.withColumn("__salt", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int")).join(salted, ["__url", "__salt"], "left")
    return out.select(id_column, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of urls from text files, one a line; empty lines and lines that begin with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def default_list(spark: SparkSession) -> DataFrame:
    """The listed sites as a table."""
    return spark.createDataFrame([(x,) for x in LISTED], "url string")
