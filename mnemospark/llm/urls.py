"""URL filter: a blocked Bloom filter before an exact hash join with the listed keys.

Two lists can be given. Entries are a host and a path prefix; those that can fit a url are
known from the url alone: a suffix of its host at a dot together with a prefix of its path
of a length that some entry of that host has. Canonical urls must equal the url's own
canonical form. All keys are tested in a Bloom filter, which touches one 256-bit block
for a key; what passes meets the listed keys in an exact hash join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import spare

#: Default ports by scheme, which a canonical url leaves out (fixed values).
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}
LANES = 4
PROBES = 6
KEYS_PER_BLOCK = 16
#: A filter or a list of at most this many rows is broadcast; larger ones are joined by shuffling.
BROADCAST_BLOCKS = 65_536
BROADCAST_ENTRIES = 100_000
BROADCAST_BYTES = 32 << 20

ENTRY = "host:string,path:string,verdict:string"


def entries(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Listed entries (host, path prefix that starts with a slash, verdict)."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(rule, ("host", "path", "verdict"), strict=True)]) for rule in rules]) if rules else F.array().cast(f"array<struct<{ENTRY}>>")
    return spark.range(1).select(F.inline(rows))


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """Places 0 to 255 of a key inside its block."""
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(64 * LANES)) for i in range(PROBES)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, lanes): the filter's non-empty blocks as four longs each, from a column `key`."""
    place = F.explode(F.array(*_bits(F.col("key")))).alias("place")
    set_bits = keys.select(_block(F.col("key"), blocks).alias("block"), place)
    bit = "shiftleft(cast(1 as bigint), cast(place % 64 as int))"
    lanes = [F.expr(f"bit_or(if(place div 64 = {i}, {bit}, cast(0 as bigint)))") for i in range(LANES)]
    return set_bits.groupBy("block").agg(F.array(*lanes).alias("lanes"))


def passes(key: Column, lanes: Column) -> Column:
    """Whether all bits of the key are set in its block."""
    ok = F.lit(True)
    for place in _bits(key):
        word = F.element_at(lanes, (F.floor(place / 64) + 1).cast("int"))
        ok = ok & (F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return ok


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without repeated or last slashes, and the query; null without `://`.

    The scheme, the fragment, user names and an empty query are left out; A-Z of the host is lower-cased.
    """
    scheme = _lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    authority = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    host = F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r"\.?(:[0-9]*)?$", "$1")
    for name, port in DEFAULT_PORTS.items():
        host = F.when((scheme == name) & host.endswith(f":{port}"), F.regexp_replace(host, ":[0-9]*$", "")).otherwise(host)
    tail = F.regexp_replace(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"#[\s\S]*$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(tail, r"^[^?]*", 0), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(tail, r"\?([\s\S]*)$", 1)
    return F.when(F.locate("://", url) > 0, F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _blocks(count: int) -> int:
    return max(1, -(-count // KEYS_PER_BLOCK))


def possible(rows: DataFrame, keys: DataFrame, count: int, key: str) -> DataFrame:
    """The rows whose `key` may be among the `count` keys (column `key`): those that pass their Bloom filter."""
    blocks, at, lanes = _blocks(count), spare(rows, "block"), spare(rows, "lanes")
    made = bloom(keys.select("key"), blocks).select(F.col("block").alias(at), F.col("lanes").alias(lanes))
    made = F.broadcast(made) if blocks <= BROADCAST_BLOCKS else made
    return rows.withColumn(at, _block(F.col(key), blocks)).join(made, at).where(passes(F.col(key), F.col(lanes))).drop(at, lanes)


def _measured(df: DataFrame, *columns: str) -> tuple[int, bool]:
    """The number of rows, and whether rows and bytes of the columns are few enough to broadcast."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.octet_length(c) for c in columns), F.lit(0))), F.lit(0))).first()
    return rows, rows <= BROADCAST_ENTRIES and size <= BROADCAST_BYTES


def _bounded(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def listed_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """(canonical): the canonical urls of `urls` that are among those of `listed`, both with a url column.

    Two urls are the same if their canonical forms are equal. Null urls and those without `://` are never listed.
    """
    keys = listed.select(canonical(F.col(f"`{url_col}`")).alias("key")).where("key is not null").distinct()
    n, few = _measured(keys, "key")
    rows = urls.select(canonical(F.col(f"`{url_col}`")).alias("canonical")).where("canonical is not null").distinct()
    return possible(rows, keys, n, "canonical").join(_bounded(keys.withColumnRenamed("key", "canonical"), few), "canonical")


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", blocked: DataFrame | None = None) -> DataFrame:
    """keep plus host, path, rule (the longest listed entry that fits, or null) and verdict.

    An entry fits its host and all subdomains if the path starts with the entry's path. Longest is by host and path
    together, then by host; of equal entries with several verdicts the smallest verdict counts. A url that no
    entry fits gets `block` if its canonical form is one of `blocked` (a table with the url column), else `default`. A
    null url, or one without `://`, has an empty host and path. Repeated rows stay; an empty list or table is allowed.
    keep must not name host, path, rule or verdict; other columns of pages are not read.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    listed = listed.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    n, few = _measured(listed, "host", "path")
    best = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("hosts"), F.concat("host", "path").alias("rule"), "verdict").alias("best")
    keyed = listed.select(_key(F.col("host"), F.col("path")).alias("key"), best)
    cuts = listed.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("cuts"))
    kept = [f"kept_{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{url_col}`").alias("given"), host.alias("host"), path.alias("path"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    hosts = rows.select("host").distinct().withColumn("suffix", F.explode(suffixes))
    hosts = possible(hosts, cuts.select(F.col("suffix").alias("key")), n, "suffix").join(_bounded(cuts, few), "suffix")
    tries = rows.select("host", "path").distinct().join(hosts, "host").withColumn("cut", F.explode("cuts")).where(F.length("path") >= F.col("cut"))
    tries = tries.select("host", "path", _key(F.col("suffix"), F.expr("substring(path, 1, cut)")).alias("key"))
    exact = possible(tries, keyed, n, "key").join(_bounded(keyed, few), "key")
    found = exact.groupBy("host", "path").agg(F.max("best").alias("best"))
    out = rows.join(found, ["host", "path"], "left")
    verdict = F.col("best.verdict")
    if blocked is not None:
        hits = listed_urls(pages, blocked, url_col).withColumn("hit", F.lit("block"))
        out = out.withColumn("canonical", canonical(F.col("given"))).join(hits, "canonical", "left")
        verdict = F.coalesce(verdict, "hit")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
