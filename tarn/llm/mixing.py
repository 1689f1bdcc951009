"""Mix sources towards target weights by Sainte-Laguë apportionment.

1. Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share
   the size of everything; a target stops at ``ceiling`` times its source's size and the
   excess is reshared by weight until none is above (water filling).
2. Every source is cut into shards of about ``shard_words`` by a seeded hash of the
   document id.  Seats, blocks of ``block_words`` each, go to sources by the highest
   quotients target / (2k + 1), and a source's seats to its shards in the same way.
3. In a shard, documents in seeded order form one line of words cut into blocks.  A
   quota of q blocks takes every block as often as it goes in and then the blocks with
   the smallest seeded hashes, so no word is taken more than ``ceiling`` times.

Everything is DataFrame operations.  Windows run within a shard (bounded by
``shard_words``), within a source over its shards, or over one row per source.
Null or blank texts have size 0 and are never taken; rows that share an id are separate
rows of the mix; a null id hashes as such; other columns are kept by ``mix_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, tidied


def n_words(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """``source, source_size`` -> the same with ``weight, target`` (double).

    Water filling in closed form: with sources by cap / weight, the level is that of
    the first prefix whose capped part leaves a level below the next source's ratio."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("weight", F.element_at(picks, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    ascending = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(ascending), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ascending), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))  # the first that fits is the smallest level above all caps
    first = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("water", F.first(fits, ignorenulls=True).over(first))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("water", F.lit(float("inf"))))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(rows: DataFrame, seats: Column, claim: str, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``quota``: seats by the highest quotients ``claim`` / (2k + 1) within each group ``by``.

    Rounding each exact share gives all but a few seats.  Only the quotients around it
    are listed (about 6 a row), enough that the true cut lies among them: with S rows and
    N seats, rounding is off by S / 2 at most and moves a row's count by its share of it."""
    group = Window.partitionBy(*by)
    rows = rows.withColumn("_seats", seats).withColumn("_s", F.count(F.lit(1)).over(group)).withColumn("_t", F.sum(claim).over(group))
    exact = F.when(F.col("_t") > 0, F.col(claim) * F.col("_seats") / F.col("_t")).otherwise(0.0)
    rows = rows.withColumn("_x", exact)
    reach = (F.ceil(F.col("_x") * F.col("_s") / F.greatest(F.col("_seats"), F.lit(1))) + 2).cast("long")
    rows = rows.withColumn("_base", F.greatest(F.lit(0), F.round("_x").cast("long") - reach))
    rows = rows.withColumn("_top", F.round("_x").cast("long") + reach).withColumn("_id", F.struct(*order))
    listed = rows.select(*by, "_id", "_seats", "_base", F.col(claim).alias("_c"), F.explode(F.sequence("_base", "_top")).alias("_k"))
    listed = listed.withColumn("_q", F.col("_c") / (2 * F.col("_k") + 1))
    base = rows.groupBy(*by).agg(F.sum("_base").alias("_given"))
    listed = listed.join(base, [listed[c].eqNullSafe(base[c]) for c in by], "inner").drop(*[base[c] for c in by]) if by else listed.crossJoin(F.broadcast(base))
    rank = F.row_number().over(Window.partitionBy(*[listed[c] for c in by]).orderBy(F.desc("_q"), F.asc_nulls_last("_id"), "_k"))
    won = listed.withColumn("_r", rank).filter((F.col("_r") <= F.col("_seats") - F.col("_given")) & (F.col("_c") > 0))
    won = won.groupBy("_id").agg(F.count(F.lit(1)).alias("_won"))
    out = rows.join(won, rows["_id"].eqNullSafe(won["_id"]), "left")
    keep = [c for c in rows.columns if not c.startswith("_")]
    return out.select(*[rows[c] for c in keep], (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


@tidied
def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row: ``doc_id, size, source, source_size, target, taken`` (words taken, repeats counted)."""
    return _taken(docs, **options).select("doc_id", "size", "source", "source_size", "target", "taken")


def _counted(sizes: DataFrame) -> DataFrame:
    """Adds ``copy``: rows equal in id, source and text are numbered from 0, so that they can be told apart.  They are counted by the
    partition they came from, so however many there are, no task has more of them than a partition."""
    keys = ["doc_id", "source", "size", "tie"]
    n = sizes.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = n.withColumn("before", before).filter("before > 0").drop("n").withColumnsRenamed({k: f"_{k}" for k in [*keys, "part"]})
    rows = sizes.withColumn("copy", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row")) - 1)
    same = [rows[k].eqNullSafe(later[f"_{k}"]) for k in keys]
    rows = rows.join(later, [rows["part"] == later["_part"], *same], "left")
    return rows.select(*keys, "row", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"))


def _taken(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
    ceiling: int = 3, block_words: int = 64, shard_words: int = 400_000, seed: str = "mix-1",
    row: str | None = None,
) -> DataFrame:
    """What :func:`mix` gives, and each row's ``shard`` and ``row``, its number: that of the column ``row`` or a new one."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie"), number.alias("row"), F.spark_partition_id().alias("part"))
    sizes = _counted(materialize(sizes, "mix-sizes"))
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    total_seats = F.ceil(F.sum("source_size").over(Window.partitionBy()) / block_words)
    goals = sainte_lague(goals, total_seats, "target", [], [F.col("source")])
    goals = goals.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    goals = materialize(goals.withColumnRenamed("quota", "source_quota"), "mix-goals")

    key = F.xxhash64(F.lit(seed), "doc_id", "tie", "copy")
    lines = _with_goals(sizes, goals).withColumn("shard", F.pmod(key, F.col("shards")))
    shards = lines.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("source_size").alias("source_size"))
    shards = sainte_lague(shards, F.col("source_quota"), "shard_size", ["source"], [F.col("source"), F.col("shard")])
    shards = materialize(shards.select("source", "shard", "shard_size", "quota"), "mix-shards")

    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("line"), "doc_id", "tie", "copy"), "doc_id", "size", "tie", "copy")
    lines = lines.withColumn("line_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # blocks that get one more turn than the others: the quota's rest by seeded hash
    blocks = F.ceil(F.col("shard_size") / block_words)
    words = F.least(F.col("quota") * block_words, F.lit(ceiling) * F.col("shard_size"))
    turns = shards.filter("shard_size > 0").withColumn("words", words).withColumn("rounds", F.floor(F.col("words") / F.col("shard_size")))
    turns = turns.withColumn("rest", F.ceil((F.col("words") - F.col("rounds") * F.col("shard_size")) / block_words)).withColumn("blocks", blocks)
    listed = turns.filter("rest > 0").select("source", "shard", "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pick = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "source", "shard", "block"), "block")
    picked = listed.withColumn("r", F.row_number().over(pick)).filter("r <= rest").select("source", "shard", "block")

    lines = materialize(lines, "mix-lines")
    parts = lines.filter("size > 0").select(
        "row", "source", "shard", (F.col("line_end") - F.col("size")).alias("a"), F.col("line_end").alias("b"),
        F.explode(F.sequence(F.floor((F.col("line_end") - F.col("size")) / block_words), F.floor((F.col("line_end") - 1) / block_words))).alias("block"),
    )
    inside = F.least("b", (F.col("block") + 1) * block_words) - F.greatest("a", F.col("block") * block_words)
    same = parts["source"].eqNullSafe(picked["source"]) & (parts["shard"] == picked["shard"]) & (parts["block"] == picked["block"])
    extra = parts.withColumn("inside", inside).join(picked.hint("merge"), same)  # as many blocks as words allow, never broadcast
    extra = extra.groupBy("row").agg(F.sum("inside").alias("extra"))
    out = lines.join(extra, "row", "left")
    r = turns.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "rounds")
    out = out.join(r, out["source"].eqNullSafe(r["_source"]) & (out["shard"] == r["_shard"]), "left")
    taken = F.coalesce("rounds", F.lit(0)) * F.col("size") + F.coalesce("extra", F.lit(0))
    return out.select("row", "doc_id", "size", lines["source"], "source_size", "target", lines["shard"], "tie", taken.cast("long").alias("taken"))


def _with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    g = goals.withColumnRenamed("source", "_source")
    return rows.join(g, rows["source"].eqNullSafe(g["_source"])).drop("_source")


def _copies(plan: DataFrame, seed: str) -> DataFrame:
    """Adds ``copies``: taken / size whole copies, the remainders rounded without bias.

    Along a shard's documents by size the remainders add up from a seeded start in [0, 1),
    and a document whose sum passes a whole number gets one copy more: each with the
    chance of its remainder, whatever its length.  As neighbours in this line are of like
    size, a shard's words differ from those taken by less than its longest document.
    Remainders are whole billionths, so their sums do not depend on the order of adding."""
    unit = 10**9
    line = Window.partitionBy("source", "shard").orderBy("size", F.xxhash64(F.lit(seed), F.lit("copy"), "doc_id"), "doc_id", "tie", "taken")
    part = F.round((F.col("taken") % F.col("size")) * F.lit(float(unit)) / F.col("size")).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), "source", "shard"), F.lit(unit))
    rows = plan.filter("size > 0").withColumn("_part", part)
    rows = rows.withColumn("_to", start + F.sum("_part").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    more = F.floor(F.col("_to") / unit) - F.floor((F.col("_to") - F.col("_part")) / unit)
    return rows.withColumn("copies", (F.floor(F.col("taken") / F.col("size")) + more).cast("int")).drop("_part", "_to")


@tidied
def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row whole, as often as the words taken from it make it up, by
    :func:`_copies` (no words taken: left out).  Keeps all columns; rows are numbered and written
    first, so rows that share an id or have none are told apart and no join key repeats."""
    number = "_mix_row"
    while number in docs.columns:
        number += "_"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    copies = _copies(_taken(rows, row=number, **options), options.get("seed", "mix-1"))
    copies = copies.filter("copies > 0").select(F.col("row").alias(number), F.array_repeat(F.lit(0), F.col("copies")).alias(number + "_copies"))
    return rows.join(copies, number).select(*docs.columns, F.explode(number + "_copies").alias(number)).drop(number)
