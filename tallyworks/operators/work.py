"""Work queues, usage reports, evidence and scoreboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.operators import rules
from tallyworks.store import materialise

NEVER_DAYS = 90


def build_queue(
    registry: DataFrame, key: str, last_look: DataFrame, demand: DataFrame, accuracy: DataFrame, skips: list[tuple[str, DataFrame]], today: Column, name: str
) -> tuple[DataFrame, DataFrame]:
    """(entries by priority, skipped with the first reason): all key rows with staleness, demand and accuracy.

    ``skips`` are (reason, keys) in order of precedence. A key never looked at is NEVER_DAYS old.
    """
    skipped = None
    rest = registry
    for reason, keys in skips:
        hit = rest.join(keys.select(key).distinct(), key, "left_semi").select(key, F.lit(reason).alias("reason"))
        skipped = hit if skipped is None else skipped.unionByName(hit)
        rest = rest.join(keys.select(key), key, "left_anti")
    queue = rest.join(last_look, key, "left").join(demand, key, "left").join(accuracy, key, "left")
    stale = F.coalesce(F.datediff(today, "looked_on"), F.lit(NEVER_DAYS))
    queue = queue.withColumn("staleness_days", stale).withColumn("demand", F.coalesce("demand", F.lit(0)))
    queue = queue.withColumn("priority", rules.priority(F.col("staleness_days"), F.col("demand"), F.col("accuracy")))
    return queue.orderBy(F.col("priority").desc(), name, key), skipped


def within_budget(queue: DataFrame, order: list[Column], cost: Column, budget: float, parts: int = 64) -> DataFrame:
    """The entries, in order, for which the money lasts, with ``spent`` up to and including each.

    A cost may not be negative, and ``order`` should end in a tie-breaker. The queue is cut into ranges of the order;
    their sums are put in front of one another, and the running sum is taken within each, so no task sees it all.
    """
    ranged = materialise(queue.withColumn("__cost", cost).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__cost").alias("__sum"))  # one row a range from here on
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")))
    running = F.sum("__cost").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # ranges that begin beyond the budget aren't sorted
    kept = ranged.join(bases, "__part").where(F.col("__base") <= budget)
    return kept.withColumn("spent", F.col("__base") + running).where(F.col("spent") <= budget).drop("__part", "__cost", "__base")


def usage_by_day(events: DataFrame, day: Column, amount: Column, start: str, end: str) -> DataFrame:
    """(day, amount) of every day from start to end, zero where nothing was used."""
    sums = events.groupBy(day.alias("day")).agg(F.sum(amount).alias("used"))
    calendar = events.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    return calendar.join(sums, "day", "left").select("day", F.coalesce("used", F.lit(0)).alias("used"))


def usage_totals(events: DataFrame, provider: str, units: Column, money: Column) -> DataFrame:
    return events.groupBy(provider).agg(F.sum(units).alias("units"), F.sum(money).alias("usd"), F.count("*").alias("events"))


def support(evidence: DataFrame, keys: list[str], case: str) -> DataFrame:
    """How many different cases report each value, and what that allows."""
    counted = evidence.groupBy(*keys).agg(F.count_distinct(case).alias("cases"))
    return counted.withColumn("level", rules.flag_level(F.col("cases")))


def add_evidence(stored: DataFrame, new: DataFrame, keys: list[str], allowed: DataFrame, field: str) -> DataFrame:
    """New rows with an allowed field that are not stored yet, each once."""
    return new.join(allowed.select(field), field, "left_semi").dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def scoreboard(outcomes: DataFrame, key: str, matched: str) -> DataFrame:
    """(key, outcomes, matched, accuracy, needs_recheck); an outcome that tests nothing is not counted."""
    tested = outcomes.where(F.col(matched).isNotNull())
    board = tested.groupBy(key).agg(F.count("*").alias("outcomes"), F.sum(F.col(matched).cast("int")).alias("matched"))
    board = board.withColumn("accuracy", F.col("matched") / F.col("outcomes"))
    return board.withColumn("needs_recheck", (F.col("outcomes") >= 3) & (F.col("accuracy") < 0.8))


def read_quota(reads: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` reads of each key are granted, the others refused."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return reads.withColumn("granted", n <= limit)


def refetch_plan(wanted: DataFrame, have: DataFrame, url: str, owner: str, per_call: int, rate: int) -> tuple[DataFrame, DataFrame]:
    """(addresses with their owners, cost by batch key): those that have no text yet, each address once.

    Calls take ``per_call`` addresses of one batch key and cost ``rate`` each.
    """
    missing = wanted.join(have.select(url).distinct(), url, "left_anti")
    urls = missing.groupBy(url).agg(F.sort_array(F.collect_set(owner)).alias("owners"), F.min("batch").alias("batch"))
    cost = urls.groupBy("batch").agg(F.count("*").alias("urls")).withColumn("cost", F.ceil(F.col("urls") / per_call) * rate)
    return urls, cost
