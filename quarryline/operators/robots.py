"""robots.txt rules and the check of addresses against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PROD, Config
from .skew import lookup_join

#: The lines that matter, and the agents that obey.
AGENT = "User-agent: "
OBEYED = ["User-agent: *", "User-agent: Rustbot"]
DISALLOW = r"^Disallow: (\S+)"


def disallowed(body: Column) -> Column:
    """The disallowed prefixes of a file, in order.

    The last agent line before a line decides whether it counts. A file is
    folded inside its row: no window over its lines, no shuffle.
    """
    lines = F.split(body, "\r?\n")
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("prefixes"))

    def step(acc: Column, line: Column) -> Column:
        agent = line.startswith(AGENT)
        on = F.when(agent, line.startswith(OBEYED[0]) | line.startswith(OBEYED[1])).otherwise(acc["on"])
        prefix = F.regexp_extract(line, DISALLOW, 1)
        more = F.when(~agent & acc["on"] & (prefix != ""), F.concat(acc["prefixes"], F.array(prefix))).otherwise(acc["prefixes"])
        return F.struct(on.alias("on"), more.alias("prefixes"))

    return F.aggregate(lines, start, step, lambda a: a["prefixes"])


def robots_rules(files: DataFrame, host: str, body: str) -> DataFrame:
    """(host, prefix), distinct; several files of a host add up."""
    rows = files.where(F.col(host).isNotNull() & F.col(body).isNotNull())
    return rows.select(F.col(host).alias("host"), F.explode(disallowed(F.col(body))).alias("prefix")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """``urls`` (with host and path) plus ``allowed``: no prefix of the host's rules begins the path.

    A host's rules travel as one array to its urls, so a url is one row all
    along; hosts without rules allow everything. ``urls`` is read to count
    hosts and again to join: hand over a stored table.
    """
    packed = rules.groupBy("host").agg(F.collect_set("prefix").alias("__prefixes"))
    joined = lookup_join(urls, packed, "host", hot_rows, "left")
    blocked = F.exists("__prefixes", lambda p: F.col("path").startswith(p))
    return joined.withColumn("allowed", ~F.coalesce(blocked, F.lit(False))).drop("__prefixes")


def legacy_rules(files: DataFrame, host: str, body: str, cfg: Config = PROD) -> DataFrame:
    """``robots_rules`` without the files that the legacy crawler ignores: those too long or not valid UTF-8."""
    fit = (F.octet_length(body) <= cfg.max_robots_len) & F.is_valid_utf8(body)
    return robots_rules(files.where(fit), host, body)
