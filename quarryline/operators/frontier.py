"""The frontier in batch: priorities, pop order, pages of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROD, Config
from ..functions.hashing import hashed
from ..session import cut, width
from .links import page_links
from .ordering import best, ranked


def priorities(links: DataFrame) -> DataFrame:
    """(url, priority): weighted inbound links, repeats on a page included."""
    return links.groupBy("url").agg(F.sum("inc").alias("priority"))


def queue_of(url: Column, n_queues: int) -> Column:
    """The queue of a url (P14, D01), from its MD5 so that any engine agrees."""
    return hashed(url, n_queues)


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """``urls`` that are not in ``seen``."""
    return urls.join(seen.select("url").where("url is not null").distinct(), "url", "left_anti")


def waiting(frontier: DataFrame) -> DataFrame:
    """Rows that were not popped (F13); a frontier without ``popped`` waits as a whole, a null waits too."""
    return frontier.where(~F.coalesce("popped", F.lit(False))) if "popped" in frontier.columns else frontier


def _queued(frontier: DataFrame, cfg: Config) -> DataFrame:
    return waiting(frontier).select(queue_of(F.col("url"), cfg.n_queues).alias("queue"), "url", "priority")


def pop_order(frontier: DataFrame, cfg: Config = PROD, first: int | None = None) -> DataFrame:
    """(queue, rk, url, priority): highest priority first, then the greatest url.

    Queues are numbered by one range shuffle, so a queue may hold any share of
    the frontier. With ``first``, only the best so many of each queue are.
    Rows with a true ``popped`` column are passed over.
    """
    order = [F.col("priority").desc(), F.col("url").desc()]
    rows = cut(_queued(frontier, cfg))
    if first is not None:
        return best(rows, ["queue"], order, first, few=True)
    return ranked(rows, ["queue"], order, "rk", few=True).withColumn("rk", (F.col("rk") + 1).cast("int"))


def round_robin(popped: DataFrame, limit: int | None = None) -> DataFrame:
    """(rk, queue, url, priority): one job of each queue in turn (W04), in that order; with ``limit``, only the first so many."""
    turns = popped.orderBy("rk", "queue")
    return (turns if limit is None else turns.limit(limit)).select("rk", "queue", "url", "priority")


def url_pages(frontier: DataFrame, ranges: DataFrame) -> DataFrame:
    """``frontier`` with the page that contains each url.

    ``ranges``: (queue, page, lower, upper), half open, null is unbounded;
    pages of a queue don't overlap. Lower bounds and urls are put in one order
    by a range shuffle, and each url takes the last bound before it: inside
    its partition, or the last one of an earlier partition. No url meets any
    other page, so this is a sort and no inequality join. Urls outside all
    pages have no row.
    """
    spark = frontier.sparkSession
    bound = F.struct("page", "upper")
    bounds = ranges.select("queue", F.coalesce("lower", F.lit("")).alias("at"), F.lit(0).alias("kind"), bound.alias("bound"), F.lit(None).cast("long").alias("priority"))
    urls = frontier.select("queue", F.col("url").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(bounds.schema["bound"].dataType).alias("bound"), "priority")
    order = ["queue", "at", "kind"]
    rows = bounds.unionByName(urls).repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33).cast("int"))
    # the last bound of each piece, carried on over pieces without one; a piece is one queue's rows in one partition
    last = rows.groupBy("queue", "part").agg(F.max_by("bound", F.when(F.col("kind") == 0, F.col("place"))).alias("last"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("queue").alias("q"), F.col("part").alias("p"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("queue", "part").orderBy("place")
    rows = rows.withColumn("mine", F.last("bound", ignorenulls=True).over(inside)).where("kind = 1")
    rows = rows.join(carried, (F.col("queue") == F.col("q")) & (F.col("part") == F.col("p"))).withColumn("found", F.coalesce("mine", "carried"))
    hit = F.col("found").isNotNull() & (F.col("found.upper").isNull() | (F.col("at") < F.col("found.upper")))
    return rows.where(hit).select("queue", F.col("at").alias("url"), "priority", F.col("found.page").alias("page"))


def split_pages(frontier: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(queue, url, priority, popped, page): a queue's urls in order, cut into pages of ``page_capacity``.

    Popped urls keep their place in a page; ``popped`` is false where the
    frontier has no such column.
    """
    popped = F.coalesce("popped", F.lit(False)) if "popped" in frontier.columns else F.lit(False)
    rows = cut(frontier.select(queue_of(F.col("url"), cfg.n_queues).alias("queue"), "url", "priority", popped.alias("popped")))
    numbered = ranked(rows, ["queue"], [F.col("url").asc()], "n", few=True)
    return numbered.withColumn("page", F.expr(f"n div {cfg.page_capacity}")).drop("n")


def write_pages(pages: DataFrame, path: str) -> None:
    """A snapshot of the frontier's pages (S09): a folder a queue, pages in order, so one page is a few row groups."""
    pages.repartitionByRange("queue", "page").sortWithinPartitions("queue", "page", "url").write.mode("overwrite").partitionBy("queue").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, priority, popped, page, queue) of a snapshot; filters on queue and page prune what is read."""
    return spark.read.schema("url string, priority long, popped boolean, page long, queue int").parquet(path)


def page_values(pages: DataFrame) -> DataFrame:
    """(queue, page, lower, n, value): a page's first url, size and highest waiting priority, 0 if none waits."""
    top = F.coalesce(F.max(F.when(~F.col("popped"), F.col("priority"))), F.lit(0))
    return pages.groupBy("queue", "page").agg(F.min("url").alias("lower"), F.count(F.lit(1)).alias("n"), top.alias("value"))


def incremented(frontier: DataFrame, increments: DataFrame) -> DataFrame:
    """(url, priority, popped) after increments (url, inc): a popped url still counts but stays popped."""
    have = frontier.select("url", "priority", "popped")
    more = increments.select("url", F.col("inc").alias("priority"), F.lit(False).alias("popped"))
    return have.unionByName(more).groupBy("url").agg(F.sum("priority").alias("priority"), F.bool_or("popped").alias("popped"))


def popped_now(frontier: DataFrame, per_queue: int, cfg: Config = PROD) -> DataFrame:
    """The ``per_queue`` best waiting urls of each queue."""
    return best(_queued(frontier, cfg), ["queue"], [F.col("priority").desc(), F.col("url").desc()], per_queue, few=True).drop("rk")


def crawl(pages: DataFrame, roots: DataFrame, rounds: int, per_queue: int, cfg: Config = PROD) -> tuple[DataFrame, DataFrame]:
    """(jobs, frontier) after so many rounds of the crawl loop.

    A round pops each queue's best urls, takes their pages for fetched, and
    puts the links of those that were indexed back as increments; a url is
    popped once, and its page's links count in the round it is popped in.
    Pages are found by their address without query. ``pages``: (page_id, url, html), ``roots``: (url, inc). jobs: (round, queue,
    url, priority). State is written to the shared folder each round, so the
    lineage stays short.
    """
    spark = pages.sparkSession
    links = cut(page_links(pages, cfg).select("source", "url", "inc"))
    none = spark.createDataFrame([], "url string, priority long, popped boolean")
    frontier = cut(incremented(none, roots))
    done = []
    for n in range(rounds):
        jobs = cut(popped_now(frontier, per_queue, cfg).withColumn("round", F.lit(n)))
        done.append(jobs)
        follow = links.join(jobs.select(F.col("url").alias("source")), "source", "left_semi").select("url", "inc")
        marks = jobs.select("url", F.lit(0).cast("long").alias("priority"), F.lit(True).alias("popped"))
        frontier = cut(incremented(frontier.unionByName(marks), follow))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("round", "queue", "url", "priority"), frontier
