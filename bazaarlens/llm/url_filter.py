"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list has rules (host, path, verdict). A rule fits its host and all subdomains of it, if the
path starts with the rule's; of several the longest wins. All rules that could fit a URL are its
candidates: the host's last labels with the path's first characters, in the shapes (number of
labels, length of path) that occur in the list. The Bloom filter passes the few candidates that
may be listed to a join that removes the false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import column, fresh
from bazaarlens.session import written

#: Bits of the filter per listed URL; a block is four longs (256 bits), a key sets two bits in each.
BITS_PER_KEY = 16
BLOCK_BITS = 256
#: A filter of up to this size is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 8 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


# --- the filter -------------------------------------------------------------------------------


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in the four longs of its block."""
    bits = F.xxhash64(key, F.lit(1))

    def bit(i: int) -> Column:
        at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def blocked_bloom(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """The blocks (block, w0..w3) that have a bit set, and the number of blocks in all."""
    blocks = max(1, math.ceil(count * BITS_PER_KEY / BLOCK_BITS))
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))]
    each = keys.select(_block(F.col(key), blocks).alias("block"), *masks)
    return each.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def may_contain(keys: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed: all that are, and few others."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))]
    probe = keys.select("*", _block(F.col(key), blocks).alias("block"), *masks)
    if blocks * 48 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    hit = probe["block"] == bloom["block"]
    for i in range(4):
        hit = hit & (bloom[f"w{i}"].bitwiseAND(probe[f"m{i}"]) == probe[f"m{i}"])
    return probe.join(bloom, hit, "left_semi").select(*keys.columns)


# --- rules ------------------------------------------------------------------------------------


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url_column: str = "url",
    unlisted: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (``unlisted`` if none fits).

    ``rules`` has (host, path, verdict). Where a rule is listed twice with several verdicts, the
    last by name counts; rules with a null host or path are ignored. Of fitting rules that are
    equally long the one with the longer host wins. A null URL, or one without ``://``, has an
    empty host and path, which no rule fits. Columns of ``pages`` that have one of the new names
    are replaced.

    The distinct (host, path) are judged, and so are the distinct candidates, so that a site with
    a third of all pages counts once per task. The shapes are the only thing taken to the driver:
    at most the distinct lengths of paths times those of hosts, not the list.
    """
    listed = written(
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(F.concat(lower_ascii(F.col("host")), "path").alias("key"), lower_ascii(F.col("host")).alias("h"), "path", "verdict")
        .groupBy("key")
        .agg(F.max("verdict").alias("verdict"), F.max(F.length("h")).alias("host_length"),
             F.max(F.size(F.split("h", r"\."))).alias("labels"), F.max(F.length("path")).alias("prefix")),
        "rules",
    )
    shapes = [tuple(r) for r in listed.select("labels", "prefix").distinct().collect()]
    host, path = host_of(column(url_column)), path_of(column(url_column))
    own = pages.select(*[column(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    h, p = fresh(own, "url_host"), fresh(own, "url_path")
    own = own.withColumns({h: host, p: path}) if url_column in own.columns else pages.select(
        *[column(c) for c in own.columns], host.alias(h), path.alias(p)
    )
    if not shapes:
        none = F.lit(None).cast("string")
        return own.withColumnsRenamed({h: "host", p: "path"}).withColumns({"rule": none, "verdict": F.lit(unlisted)})

    urls = own.select(column(h).alias("host"), column(p).alias("path")).distinct()
    known = ", ".join(f"struct({n} AS n, {m} AS m)" for n, m in sorted(shapes))
    candidates = urls.withColumn("labels", F.split("host", r"\.")).select(
        "host",
        "path",
        F.explode(
            F.expr(
                f"transform(filter(array({known}), x -> x.n <= size(labels) AND x.m <= length(path)),"
                " x -> concat(array_join(slice(labels, -x.n, x.n), '.'), left(path, x.m)))"
            )
        ).alias("key"),
    )
    bloom, blocks = blocked_bloom(listed, "key", listed.count())
    possible = may_contain(candidates.select("key").distinct(), "key", bloom, blocks)
    hits = written(
        possible.join(listed.hint("shuffle_hash"), "key").select("key", "verdict", "host_length"), "hits"
    )
    best = (
        candidates.join(hits, "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "host_length")).alias("best"))
        .select(F.col("host").alias("u_host"), F.col("path").alias("u_path"), "best")
    )
    joined = own.join(best, (own[h] == best["u_host"]) & (own[p] == best["u_path"]), "left")
    kept = [own[c] for c in own.columns if c not in (h, p)]
    return joined.select(
        *kept,
        own[h].alias("host"),
        own[p].alias("path"),
        F.col("best.key").alias("rule"),
        F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"),
    )
