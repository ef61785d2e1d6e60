"""Policy versions: numbering, duplicates, validity, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_key():
    return Window.partitionBy("policy_key").orderBy("uploaded", "policy_id")


def assign_versions(uploads: DataFrame) -> DataFrame:
    """Adds ``version``, and ``status``: superseded unless the last of its key."""
    return uploads.withColumn("version", F.row_number().over(_by_key())).withColumn("status", F.when(F.lead("policy_id").over(_by_key()).isNull(), "active").otherwise("superseded"))


def dedup_uploads(uploads: DataFrame) -> DataFrame:
    """Adds ``duplicate_of``: the first upload of the same key and checksum."""
    first = F.first("policy_id").over(Window.partitionBy("policy_key", "checksum").orderBy("uploaded", "policy_id"))
    return uploads.withColumn("duplicate_of", F.when(first != F.col("policy_id"), first))


def category_changes(uploads: DataFrame) -> DataFrame:
    """Adds ``previous_category`` and whether the category differs from it."""
    return uploads.withColumn("previous_category", F.lag("category").over(_by_key())).withColumn("changed", F.coalesce(F.col("category") != F.col("previous_category"), F.lit(False)))


#: A stretch of the greatest size, 2 ** 21 days, from 1900-01-01 on; with smaller ones it makes up any days of the years 1 to 9999.
_LEVELS = 21


def _cover(first: Column, last: Column) -> Column:
    """The fewest whole stretches of 1, 2, 4, ... days that make up the days from ``first`` to ``last``, as (level, place)."""

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("long")
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        odd = low % 2 != 0  # negative before 1900
        left = F.when(odd & (low < high), low)
        right = F.when((high % 2 != 0) & (low + odd.cast("long") < high), high - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda x: F.struct(k.cast("int").alias("level"), x.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at))


def overlaps(policies: DataFrame, block: int = 4096) -> DataFrame:
    """Pairs of active policies of one category and different keys whose closed
    intervals meet; open ends are null.

    Of two intervals that meet, one begins within the other (on equal days the
    smaller id counts as the earlier).  An interval is made up of at most 42
    dyadic stretches of days, of which exactly one holds a given beginning, and
    a beginning lies in one stretch of each of 22 sizes.  The two meet by an
    equality on category and stretch, so every pair that meets is a result (but
    for equal keys and days) and comes once, whatever the intervals' lengths.

    The result may be quadratic, so a stretch is cut into cells: its beginnings
    into blocks of about ``block``, each one array, its intervals into chunks
    of as many.  An interval goes to each block and meets one array at a time,
    which bounds what a task holds, and the cells of a stretch are spread over
    tasks, however many intervals share it.  A cell's intervals and its array
    are in order of dates, so the pairs take about 2 bytes each in files.
    """
    first, last = F.to_date(F.lit("1900-01-01")), F.to_date(F.lit("2200-12-31"))
    # not coalesced by size: a cell's work is far more than its bytes tell
    tasks = max(32, 4 * policies.sparkSession.sparkContext.defaultParallelism)
    p = policies.where("status = 'active'").select("policy_id", "policy_key", "category", "effective_date", "expiry_date", F.coalesce("effective_date", first).alias("lo"), F.coalesce("expiry_date", last).alias("hi"))
    p = p.where("lo <= hi and category is not null").withColumn("day", F.datediff("lo", first).cast("long")).withColumn("end", F.datediff("hi", first).cast("long")).repartition(tasks, "policy_id")
    fields = ["day", "expiry_date", "policy_id", "policy_key", "effective_date"]
    dealt = F.xxhash64(*fields)
    a = p.select("category", *fields, F.explode(_cover(F.col("day"), F.col("end"))).alias("s")).select("category", *fields, "s.level", "s.place")
    steps = F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(F.col("day") / F.pow(F.lit(2), k)).cast("long").alias("place")))
    b = p.select("category", *fields, F.explode(steps).alias("s")).select("category", *fields, "s.level", "s.place")
    stretch = ["category", "level", "place"]
    cell = [*stretch, "block", "chunk"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cuts = lambda df, name: df.groupBy(stretch).agg(F.ceil(F.count("*") / block).alias(name))
    sizes = cuts(a, "chunks").join(cuts(b, "blocks").hint("shuffle_merge"), stretch)
    blocks = b.join(sizes.hint("shuffle_merge"), stretch).groupBy(*stretch, "chunks", F.pmod(dealt, F.col("blocks")).alias("block")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("bs"))
    blocks = blocks.withColumn("chunk", numbers(F.col("chunks"))).select(*cell, "bs").repartition(tasks, *cell)
    chunks = a.join(sizes.hint("shuffle_merge"), stretch).withColumn("chunk", F.pmod(dealt, F.col("chunks"))).repartition(tasks, *stretch, "chunk")
    chunks = chunks.withColumn("block", numbers(F.col("blocks"))).select(*cell, *fields).repartition(tasks, *cell).sortWithinPartitions(*cell, *fields)
    met = chunks.join(blocks.hint("shuffle_merge"), cell).select("category", *fields, F.explode("bs").alias("b"))
    earlier = (F.col("day") < F.col("b.day")) | (F.col("day") == F.col("b.day")) & (F.col("policy_id") < F.col("b.policy_id"))
    ids = F.col("policy_id"), F.col("b.policy_id")
    # greatest and least pass over the open ends
    start, end = F.greatest("effective_date", "b.effective_date"), F.least("expiry_date", "b.expiry_date")
    return met.where(earlier & (F.col("policy_key") != F.col("b.policy_key"))).select(F.least(*ids).alias("policy_a"), F.greatest(*ids).alias("policy_b"), "category", start.alias("overlap_start"), end.alias("overlap_end"))


def check_uploads(uploads: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Adds ``errors``: missing fields, expiry before effect."""
    missing = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing {c}")) for c in required]
    return uploads.withColumn("errors", F.array_compact(F.array(*missing, F.when(F.col("expiry_date") < F.col("effective_date"), F.lit("expiry before effective")))))


def access_metadata(company: Column, scope: Column, effective_date: Column, required_permission: Column) -> Column:
    """The access fields of a policy as strings; dates in ISO form, absent ones without a key."""
    fields = {"company": company, "scope": scope, "effective_date": effective_date, "required_permission": required_permission}
    return F.map_filter(F.create_map(*[x for name, v in fields.items() for x in (F.lit(name), v.cast("string"))]), lambda k, v: v.isNotNull())


def access_decisions(items: DataFrame, contexts: DataFrame, max_askers: int = 10_000) -> DataFrame:
    """Items for each asker with the first failing reason (null: visible).

    Every pair is an answer.  Askers are counted and broadcast in blocks of at
    most ``max_askers``; the items are read once for each block.
    """
    blocks = max(1, -(-contexts.count() // max_askers))
    block = F.pmod(F.xxhash64("asker"), F.lit(blocks))
    # a block by hash holds about max_askers
    met = items.join(F.broadcast(contexts.where(block == 0)))
    for i in range(1, blocks):
        met = met.unionByName(items.join(F.broadcast(contexts.where(block == i))))
    reason = (
        F.when(F.col("item_company").isNotNull() & (F.col("item_company") != F.col("company")), "company")
        .when(F.col("item_scopes").isNotNull() & ~F.arrays_overlap("item_scopes", "scopes"), "scope")
        .when(F.col("effective_date") > F.col("as_of"), "not_effective")
        .when(F.col("expiry_date") < F.col("as_of"), "expired")
        .when(F.col("permission") < F.coalesce("required_permission", F.lit(0)), "permission")
    )
    return met.withColumn("reason", reason)


def listing(uploads: DataFrame) -> DataFrame:
    """Adds positions: versions ascending within their key, newest first overall of the category."""
    newest = Window.partitionBy("category").orderBy(F.desc("uploaded"), F.desc("policy_id"))
    return uploads.withColumn("version_place", F.row_number().over(_by_key())).withColumn("newest_place", F.row_number().over(newest))
