"""URL filters: host and path rules, and a list behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.runtime import Scratch, ship

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: query parameters that only track a visit
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: words in a block, bits set of each key; a block is 512 bits, as a cache line
WORDS, BITS = 8, 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; null or without ://: empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; null or without ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for addresses of one page.

    Host in lower case without user, port 80 or 443, a leading www. or m. and
    a closing dot; path without a closing slash, index page or .html; query
    without tracking parameters, the rest in order; no scheme and no fragment.
    Null where there is no ://.
    """
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r":(80|443)$", ""), r"^(www|m)\.|\.$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.[a-z]+$|\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(*TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit(""))))


def rule_verdicts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) with `rule` and `rule_verdict`: of the rules that fit, the longest; null if none does.

    rules: (verdict, host, path). Those of one host are an array, long ones
    first, and a row looks up its host and each of the domains above it: a join
    on the host, whatever the number of rules. Of rules equal in host and path
    the least verdict counts.
    """
    text = F.concat("host", "path")
    best = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    of_host = best.groupBy(F.col("host").alias("at")).agg(F.sort_array(F.collect_list(F.struct(F.length(text).alias("size"), text.alias("rule"), "path", "verdict")), False).alias("own"))
    labels = F.split("host", r"\.")
    # the host itself, then without its first label, and so on
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host").distinct().withColumn("at", F.explode(names)).join(of_host, "at")
    # written, so that the join below shuffles both sides and Spark can split a host that holds most rows
    found = Scratch(rows.sparkSession, "rules").write(asked.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("own")), False).alias("fits")), "found")
    first = F.element_at(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), 1)
    out = rows.join(found, "host", "left").withColumn("first", F.when(F.size(F.filter("fits", lambda r: F.col("path").startswith(r["path"]))) > 0, first))
    return out.withColumn("rule", F.col("first.rule")).withColumn("rule_verdict", F.col("first.verdict")).drop("first", "fits")


def _bits(hashes: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a 64-bit key, and 8 positions of its 512 bits from a second mix."""
    return F.pmod(hashes, F.lit(blocks)).cast("int"), F.xxhash64(hashes)


def _positions(second: np.ndarray) -> np.ndarray:
    """BITS bit numbers below 64, one in each word of the block."""
    u = second.astype(np.int64).view(np.uint64)
    return np.stack([(u >> np.uint64(6 * i)) & np.uint64(63) for i in range(WORDS)], 1)


class BlockedBloom:
    """A Bloom filter whose every key touches one 512-bit block (Putze, Sanders and Singler 2007)."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, keys: DataFrame, column: str, bits_per_key: int = 12, max_bytes: int = 64 << 20) -> BlockedBloom:
        """From the distinct 64-bit hashes in a column.

        The filter never exceeds max_bytes, whatever the number of keys; past
        that the share of false positives rises and the exact join drops more.
        """
        n = keys.count()
        blocks = int(min(max(1, -(-n * bits_per_key // 512)), max_bytes // 64))
        block, second = _bits(F.col(column), blocks)

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = np.zeros((blocks, WORDS), np.uint64)
            for pdf in batches:
                pos = _positions(pdf["second"].to_numpy())
                for i in range(WORDS):
                    np.bitwise_or.at(words[:, i], pdf["block"].to_numpy(), np.uint64(1) << pos[:, i])
            used = np.flatnonzero(words.any(1))
            yield pd.DataFrame({"block": used, **{f"w{i}": words[used, i].view(np.int64) for i in range(WORDS)}})

        parts = keys.select(block.alias("block"), second.alias("second")).mapInPandas(merge, "block int, " + ", ".join(f"w{i} long" for i in range(WORDS)))
        rows = parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))).toPandas()
        words = np.zeros((blocks, WORDS), np.uint64)
        words[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(WORDS)]].to_numpy(np.int64).view(np.uint64)
        return cls(words)

    def may_contain(self, hashes: Column) -> Column:
        """False means that the key isn't listed."""
        words = self.words
        block, second = _bits(hashes, len(words))

        @pandas_udf("boolean")
        def probe(b: pd.Series, s: pd.Series) -> pd.Series:
            rows, pos = words[b.to_numpy()], _positions(s.to_numpy())
            return pd.Series(((rows >> pos) & np.uint64(1)).astype(bool).all(1))

        return probe(block, second)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """A verdict for each row's url: its longest rule's, else block if its canonical form is listed, else allow.

    Returns id, host, path, rule, verdict, canonical and listed (boolean). A
    null url, or one without ://, has empty host and path and no canonical
    form, and is allowed unless a rule fits. Null and repeated list entries are
    harmless; an empty list blocks nothing; an empty table gives no rows. Every
    row of pages is judged, repeated ids and urls too; other columns are not
    read.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "urls")
    forms = listed.select(canonical(F.col(listed_col).cast("string")).alias("listed_form")).where("listed_form is not null").distinct()
    forms = scratch.write(forms.withColumn("listed_hash", F.xxhash64("listed_form")), "listed")
    bloom = BlockedBloom.build(forms, "listed_hash")

    url = F.col("url")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    rows = rows.select("id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("hash", F.xxhash64("canonical")).withColumn("maybe", F.col("canonical").isNotNull() & bloom.may_contain(F.col("hash")))
    rows = scratch.write(rule_verdicts(rows, spark.createDataFrame(list(rules), "verdict string, host string, path string")), "rows")
    # only what the filter lets pass is joined
    hit = rows.where("maybe").join(forms.select("listed_form"), F.col("canonical") == F.col("listed_form"), "left").withColumn("listed", F.col("listed_form").isNotNull())
    out = hit.drop("listed_form").unionByName(rows.where("not maybe").withColumn("listed", F.lit(False)))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "canonical", "listed")
