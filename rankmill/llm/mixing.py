"""Mixing lists of articles to target weights, in DataFrame functions only.

Every article gets a hash-random key. Words are summed per (list, key range)
where the rows are, the few sums become prefix sums, and the range that holds
the end of a list's budget is looked at row by row. The result of the search is
one row per list, so texts are never shuffled and no list is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import settle

#: words are runs of anything but these
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
RANGE_DIGITS = 4  # hex digits of the key that name a range: 65,536 ranges per list


def n_words(content: Column) -> Column:
    return F.coalesce(F.regexp_count(content, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_key(id: Column, content: Column) -> Column:
    """Hash-random, equal for equal rows, the same in every run."""
    parts = [F.coalesce(x.cast("string"), F.lit("-")) for x in (id, content)]
    return F.md5(F.concat(parts[0], F.lit(":"), parts[1]))


def list_targets(list_words: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """list_key, list_words -> target: shares by weight, none above `repeats` times the list, the excess reshared.

    Resharing until nothing is above its cap ends at min(cap, level * weight)
    with one level for all. With lists ordered by cap / weight, the level that
    holds when all lists before one are capped rises up to the right one and
    falls after it, so it is the largest of these. The window is over one row per list.
    """
    by_name = Window.orderBy(F.col("list_key").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("list_words") * repeats
    lists = list_words.withColumn("weight", w.cast("bigint")).withColumn("cap", cap.cast("bigint"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("list_key").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    total = F.sum("list_words").over(everything) * F.lit(share)
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / open_weight
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return lists.withColumn("level", level).select("list_key", "list_words", target.alias("target"))


def list_cuts(sizes: DataFrame, **options) -> DataFrame:
    """list_key, size, mix_key -> one row per list: target, whole rounds, and the key where the last round ends.

    `rest` is what each row with that key still gives (rows that are equal in
    everything share it alike). Lists whose last round is empty have no key.
    """
    ranged = sizes.withColumn("slice", F.substring("mix_key", 1, RANGE_DIGITS))
    slices = settle(ranged.groupBy("list_key", "slice").agg(F.sum("size").alias("words")))
    lists = list_targets(slices.groupBy("list_key").agg(F.sum("words").alias("list_words")), **options)
    rounds = F.when(F.col("list_words") > 0, F.floor(F.col("target") / F.col("list_words"))).otherwise(0)
    lists = lists.withColumn("rounds", rounds.cast("bigint"))
    last = F.floor("target") - F.col("rounds") * F.col("list_words")
    lists = settle(lists.withColumn("last", last.cast("bigint")))

    def reached(frame: DataFrame, order: str) -> DataFrame:
        """The row of each list in which `last` words end."""
        run = Window.partitionBy("list_key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        frame = frame.withColumn("upto", F.sum("words").over(run))
        return frame.where((F.col("upto") > F.col("last")) & (F.col("upto") - F.col("words") <= F.col("last")))

    some = lists.where("last > 0").select("list_key", "last")
    same = F.col("a.list_key").eqNullSafe(F.col("b.list_key"))
    cut = reached(slices.alias("a").join(some.alias("b"), same).select("a.*", "last"), "slice")
    cut = cut.select("list_key", "slice", (F.col("last") - F.col("upto") + F.col("words")).alias("last"))
    inside = (
        ranged.alias("a")
        .join(cut.alias("b"), same & (F.col("a.slice") == F.col("b.slice")))
        .groupBy("a.list_key", "mix_key", "last")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    )
    at = reached(inside, "mix_key").select(
        "list_key",
        F.col("mix_key").alias("cut_key"),
        F.floor((F.col("last") - F.col("upto") + F.col("words")) / F.col("rows")).cast("bigint").alias("rest"),
    )
    return settle(
        lists.alias("a")
        .join(at.alias("b"), same, "left")
        .select("a.list_key", "list_words", "target", "rounds", "cut_key", "rest")
    )


def taken(size: Column, key: Column, whole: bool) -> Column:
    """Words the mix takes of an article, given its list's cut."""
    part = F.least(size, F.col("rest"))
    if whole:
        part = F.when(part * 2 >= size, size).otherwise(0)
    last = F.when(F.col("cut_key").isNull() | (key > F.col("cut_key")), 0).when(key < F.col("cut_key"), size)
    return (F.col("rounds") * size + last.otherwise(part)).cast("bigint")


def mix_lists(articles: DataFrame, *, whole: bool = False, **options) -> DataFrame:
    """Which words of which articles a mix takes.

    articles: `id`, `content`, `list_key`. Returns one row per article, repeated
    rows included: id, list_key, size, list_words, target, taken. A list's
    articles are taken in the order of a hash, whole rounds first, and the last
    round ends at the budget exactly: the article there is taken in part, or with
    `whole` entirely or not at all, whichever is nearer. Null content has size 0,
    a null list is a list of its own and the last one. Equal rows are cut alike.
    An empty table gives an empty result. Other columns are not read.
    """
    sizes = settle(
        articles.select("id", "list_key", n_words(F.col("content")).alias("size"), mix_key(F.col("id"), F.col("content")).alias("mix_key"))
    )
    cuts = list_cuts(sizes, **options)
    joined = sizes.alias("a").join(cuts.alias("b"), F.col("a.list_key").eqNullSafe(F.col("b.list_key")))
    return joined.select(
        "id", "a.list_key", "size", "list_words", "target", taken(F.col("size"), F.col("mix_key"), whole).alias("taken")
    )


def mixed_rows(articles: DataFrame, id: str, content: str, list_key: str, **options) -> DataFrame:
    """The rows of the mix itself: an article is there as often as the mix takes it, always whole.

    Keeps the given columns. Articles without words are of no size, so they are
    there once per round and once more before the cut.
    """
    key = mix_key(F.col(id), F.col(content))
    sizes = settle(articles.select(F.col(list_key).alias("list_key"), n_words(F.col(content)).alias("size"), key.alias("mix_key")))
    cuts = list_cuts(sizes, **options)
    # the given columns are in one struct, so names made here can't be theirs
    given = F.struct(*[F.col(f"`{c}`") for c in articles.columns]).alias("given")
    rows = articles.select(given, F.col(list_key).alias("list_key"), n_words(F.col(content)).alias("size"), key.alias("mix_key"))
    joined = rows.alias("a").join(cuts.alias("b"), F.col("a.list_key").eqNullSafe(F.col("b.list_key")))
    part = F.least(F.col("size"), F.col("rest"))
    nearer = F.when(part * 2 >= F.col("size"), 1).otherwise(0)
    cut = F.col("cut_key")
    last = F.when(cut.isNull() | (F.col("mix_key") > cut), 0).when(F.col("mix_key") < cut, 1).otherwise(nearer)
    times = (F.col("rounds") + last).cast("int")
    return joined.where(times > 0).select("given", F.explode(F.sequence(F.lit(1), times))).select("given.*")
