"""Capping records per dominant contributor, best records first.

A limit may be a number of records, a share of the output, or both. A share
depends on the output it limits, so the level (the most records of one
contributor) is found by water-filling over contributor counts until the
output's shares are consistent with it. Counts are sorted by how they fall into
a fixed number of buckets, again and again inside the bucket that holds the
level, so that no list of counts ever reaches the driver. Contributors above
the level then keep their best records.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import best, ranked
from ..session import cut
from ..sources import read_table

PER_DAY = 20
MAX_SHARE = "0.05"
_RADIX = 10


def counted(df: DataFrame, contributor: list[str]) -> DataFrame:
    """(contributor, n) of rows with all parts of their contributor, written once."""
    return cut(df.select(*contributor).dropna().groupBy(*contributor).agg(F.count(F.lit(1)).alias("n")))


def water_level(counts: DataFrame, share: Fraction = Fraction(1), most: int | None = None) -> int:
    """The largest level L with L <= share * sum(min(n, L)), at most ``most``.

    ``counts``: a column n, read once for every 2^10 times that the largest
    count holds. share * sum(min(n, L)) - L is concave in L and 0 at 0, so the
    consistent levels are an interval from 0, and what is consistent at a
    bucket's edge tells which bucket holds its end. A share that no output can
    meet, as there are fewer contributors than 1/share, has the level of the
    smallest contributor: the most even output with records of all of them. 0
    for an empty table.
    """
    least, high, total = counts.agg(F.min("n"), F.max("n"), F.sum("n")).first()
    if not high:
        return 0
    if high <= share * total:
        level = high
    else:
        # n up to low are summed up in ``below``; ``above`` is the number of contributors beyond high
        low, below, above = 0, 0, 0
        while high - low > 1:
            shift = max(0, (high - low - 1).bit_length() - _RADIX)
            inside = counts.where((F.col("n") > low) & (F.col("n") <= high))
            bucket = F.shiftright(F.col("n") - low - 1, shift).alias("b")
            got = {r.b: (r.k, r.s) for r in inside.groupBy(bucket).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).collect()}
            waiting = above + sum(k for k, _ in got.values())
            last, step = 0, 1 << shift
            best_at = (low, below, above)
            for j in range((high - low - 1) // step + 1):
                k, s = got.get(j, (0, 0))
                edge = low + (j + 1) * step
                now = below + s + edge * (waiting - k)
                if edge > share * now:
                    best_at = (edge - step, below, waiting - k)
                    break
                below, waiting, last = below + s, waiting - k, edge
            else:
                best_at = (last, below, waiting)
            low, below, above = best_at
            high = min(high, low + step)
            if not shift:
                break
        level = low or least
    return level if most is None else min(level, most)


def _order(quality: str, id_col: str) -> list:
    return [F.col(quality).desc_nulls_last(), F.col(id_col).asc()]


def best_k(df: DataFrame, contributor: list[str], quality: str, id_col: str, k: int) -> DataFrame:
    """The ``k`` best rows of each contributor: highest quality, null last, ties by smaller id.

    A small ``k`` drops most rows before they move; for a large one rows are
    numbered by a range shuffle. Either way a contributor of any size is spread
    over many tasks.
    """
    return best(df, contributor, _order(quality, id_col), k, "__rk").drop("__rk")


def over_cap(df: DataFrame, contributor: list[str], quality: str, id_col: str, most: int, share: Fraction = Fraction(1)) -> DataFrame:
    """Ids of the rows that a cap drops: of ``most`` records a contributor, or fewer if ``share`` of the output asks for it.

    Defined cases: rows with a null contributor part belong to no contributor
    and are never dropped; null quality ranks last; ids are unique; an empty
    table drops nothing; other columns are not read.
    """
    rows, level = _leveled(df, contributor, quality, id_col, most, share)
    kept = best_k(rows, contributor, quality, id_col, level).select(id_col)
    return rows.select(id_col).join(kept, id_col, "left_anti")


def _leveled(df: DataFrame, contributor: list[str], quality: str, id_col: str, most: int, share: Fraction) -> tuple[DataFrame, int]:
    """Rows that have a contributor, and the level that water-filling finds for them."""
    cols = list(dict.fromkeys([*contributor, quality, id_col]))
    return df.select(*cols).dropna(subset=contributor), water_level(counted(df, contributor), share, most)


def cap_share(df: DataFrame, contributor: str, quality: str, id_col: str, share: str = MAX_SHARE) -> DataFrame:
    """``df`` without the rows that exceed ``share`` of the output for their contributor.

    At most 1/share contributors can be capped, so they and their cutoffs, the
    last row that each keeps, are few whatever the data. Rows of capped
    contributors are numbered by a range shuffle of (contributor, quality, id)
    alone; all others are neither shuffled nor ranked. Every contributor's share
    of the rows that have a contributor is at most ``share``.

    Defined cases: rows with a null contributor stay; null quality ranks last
    and ties go to the smaller id; ids are unique; if there are fewer
    contributors than 1/share, no output meets it and each keeps as many rows as
    the smallest has; an empty table stays empty; other columns pass through.
    """
    counts = counted(df, [contributor])
    level = water_level(counts, Fraction(share))
    big = F.broadcast(counts.where(F.col("n") > level).select(contributor))
    rows = df.select(F.col(contributor), F.col(quality).alias("__q"), F.col(id_col).alias("__id")).join(big, contributor, "left_semi")
    last = ranked(rows, [contributor], _order("__q", "__id"), "__rk", few=True).where(F.col("__rk") == level - 1)
    cutoffs = F.broadcast(last.select(F.col(contributor).alias("__c"), "__q", "__id"))
    better = F.col(quality).isNotNull() & (F.col("__q").isNull() | (F.col(quality) > F.col("__q")))
    kept = F.col("__c").isNull() | better | (F.col(quality).eqNullSafe(F.col("__q")) & (F.col(id_col) <= F.col("__id")))
    return df.join(cutoffs, F.col(contributor) == F.col("__c"), "left").where(kept).drop("__c", "__q", "__id")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """jobs with the calendar day of enqueued_at (stored without a zone)."""
    return read_table(spark, sf, "jobs").withColumn("day", F.to_date("enqueued_at"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs beyond the 20 best of their host and day."""
    return over_cap(_jobs(spark, sf), ["host", "day"], "priority", "job_id", PER_DAY)


def p5_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs that stay; those without host or time are never capped."""
    jobs = _jobs(spark, sf).select("job_id", "host", "day", "priority")
    none = jobs.where(F.col("host").isNull() | F.col("day").isNull())
    rows, level = _leveled(jobs, ["host", "day"], "priority", "job_id", PER_DAY, Fraction(1))
    return best_k(rows, ["host", "day"], "priority", "job_id", level).select("job_id", "host", "day", "priority").unionByName(none)


def p5_share(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with a host, such that no host has over 5 % of them; best priorities stay."""
    jobs = read_table(spark, sf, "jobs").select("job_id", "host", "priority").where(F.col("host").isNotNull())
    return cap_share(jobs, "host", "priority", "job_id")


QUERIES = {"p5_found": p5_found, "p5_kept": p5_kept, "p5_share": p5_share}

_RANKED = """
    r AS (SELECT job_id, host, CAST(enqueued_at AS DATE) AS day, priority,
                 row_number() OVER (PARTITION BY host, CAST(enqueued_at AS DATE) ORDER BY priority DESC NULLS LAST, job_id) AS rk
          FROM jobs)"""

SQL = {
    "p5_found": f"WITH {_RANKED} SELECT job_id FROM r WHERE rk > 20 AND host IS NOT NULL AND day IS NOT NULL",
    "p5_kept": f"WITH {_RANKED} SELECT job_id, host, day, priority FROM r WHERE rk <= 20 OR host IS NULL OR day IS NULL",
    "p5_share": """
        WITH RECURSIVE n AS (SELECT host, count(*) AS n FROM jobs WHERE host IS NOT NULL GROUP BY host),
             level(l, step) AS (SELECT max(n), 0 FROM n
                UNION ALL
                SELECT (SELECT sum(least(n, l)) FROM n) // 20, step + 1 FROM level
                WHERE l > (SELECT sum(least(n, l)) FROM n) // 20 AND step < 10000),
             r AS (SELECT job_id, host, priority, row_number() OVER (PARTITION BY host ORDER BY priority DESC NULLS LAST, job_id) AS rk
                   FROM jobs WHERE host IS NOT NULL)
        SELECT job_id, host, priority FROM r WHERE rk <= (SELECT CASE WHEN min(l) > 0 THEN min(l) ELSE (SELECT min(n) FROM n) END FROM level)""",
}
