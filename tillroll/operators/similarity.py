"""Cosine similarity of customers by the items they share, and each customer's nearest others.

With 0/1 baskets the cosine of two customers is shared / sqrt(size_a * size_b).
A customer by customer matrix cannot be built at scale, and a plain self join on
the item makes buyers x buyers pairs for a best-seller. `nearest_customers`
gives the exact nearest n for everybody in these steps, the same for all items:

1. Customers with the same basket form one class. Only the n+1 smallest ids of
   a class can be anyone's neighbour, since they tie with the rest of it.
2. Items are ordered by steps, rare ones first. A class knows at each step how
   many of its items are left from there on.
3. Every class meets the n+2 smallest baskets of each of its items. The n+1 it
   meets best are compared in full, and the worst of these is a bar that every
   neighbour must reach.
4. Classes whose first common item has step s share at most the smaller of the
   two counts left at s. A class therefore stops asking about an item when the
   items left cannot reach its bar, and skips holders whose baskets are too
   large for it. Best-sellers come last, so few classes still ask about them.
5. Pairs that still can reach the bar after the items they met over are counted
   over the rest of the smaller basket.

The holders of an item are cut into blocks of `pair_block`, so that an item with
many holders is many tasks. Where bars stay low, because all baskets are made of
best-sellers and few are alike, the pairs over those are still compared: that is
the price of an exact answer.

Ties go to the smaller customer id. The order uses shared^2 / (size_a * size_b),
one division of whole numbers, so equal cosines compare equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.session import stage

#: Steps of the item order: so many for each doubling of the holders, each cut by a hash.
STEPS_PER_DOUBLING = 4
STEP_PARTS = 8
#: Bars are compared with a margin far below the gap between two cosines.
MARGIN = 1 - 1e-12
CLASS_KEY = ["print_a", "print_b", "size"]


def user_items(sales: DataFrame) -> DataFrame:
    """The 1-cells of the customer by item matrix: who bought what at all."""
    bought = sales.filter(F.col("quantity") > 0)
    return bought.select("customer_id", "stock_code").distinct()


def cosine(shared: Column, size_a: Column, size_b: Column) -> Column:
    return shared / F.sqrt((size_a * size_b).cast("double"))


def closeness(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Square of the cosine as one division, exact enough to keep ties as ties."""
    return (shared * shared).cast("double") / (size_a * size_b).cast("double")


def similarity_to(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole similarity rows of the target customers: every other customer with cosine above 0.

    Work is the number of buyers of the targets' items. For all customers at
    once use nearest_customers.
    """
    sizes = pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("size"))
    wanted = pairs.join(targets.select("customer_id").distinct(), "customer_id", "left_semi")
    other = pairs.withColumnRenamed("customer_id", "neighbour_id")
    shared = (
        wanted.join(other, "stock_code")
        .filter(F.col("customer_id") != F.col("neighbour_id"))
        .groupBy("customer_id", "neighbour_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        shared.join(sizes, "customer_id")
        .withColumnRenamed("size", "size_a")
        .join(sizes.toDF("neighbour_id", "size_b"), "neighbour_id")
        .select(
            "customer_id",
            "neighbour_id",
            cosine(F.col("shared"), F.col("size_a"), F.col("size_b")).alias("similarity"),
        )
    )


@dataclass(frozen=True)
class Baskets:
    """Customers grouped by equal baskets. A class is named after its smallest customer id."""

    members: DataFrame  # customer_id, class_id, slot
    items: DataFrame  # class_id, size, stock_code
    classes: DataFrame  # class_id, size, ids: the n+1 smallest, in order
    n: int


def group_baskets(pairs: DataFrame, n: int) -> Baskets:
    """Baskets are compared by size and two 64-bit prints of the item set, not by a list of items.

    The prints fold in the shuffle, so a customer holding a third of all lines
    still ends as one short row. slot is a member's place among the n+1
    smallest ids of its class, and n+1 for all others.
    """
    pairs = stage(pairs, "pairs")
    prints = pairs.groupBy("customer_id").agg(
        F.bit_xor(F.xxhash64("stock_code")).alias("print_a"),
        F.bit_xor(F.xxhash64("stock_code", F.lit(1))).alias("print_b"),
        F.count(F.lit(1)).alias("size"),
    )
    prints = stage(prints, "prints")

    smallest = Window.partitionBy(*CLASS_KEY).orderBy("customer_id")
    first_ids = prints.withColumn("_at", F.row_number().over(smallest)).filter(
        F.col("_at") <= n + 1
    )
    classes = first_ids.groupBy(*CLASS_KEY).agg(
        F.sort_array(F.collect_list("customer_id")).alias("ids")  # n+1 ids at most
    )
    classes = stage(classes.withColumn("class_id", F.col("ids")[0]), "classes")

    at = F.array_position("ids", F.col("customer_id"))
    members = prints.join(classes, CLASS_KEY).select(
        "customer_id", "class_id", F.when(at > 0, at).otherwise(n + 1).cast("int").alias("slot")
    )
    items = pairs.join(
        classes.select(F.col("class_id").alias("customer_id"), "size"), "customer_id"
    ).withColumnRenamed("customer_id", "class_id")
    return Baskets(
        members=members,
        items=stage(items.select("class_id", "size", "stock_code"), "class-items"),
        classes=classes.select("class_id", "size", "ids"),
        n=n,
    )


def _best(candidates: DataFrame, key: str, keep: int) -> DataFrame:
    """The `keep` closest per key. The limit also applies before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("closeness"), "other_id")
    ranked = candidates.withColumn("_at", F.row_number().over(order))
    return ranked.filter(F.col("_at") <= keep).drop("_at")


def ranked_items(items: DataFrame) -> DataFrame:
    """items with step, left and after: how many items its class has from this step on, and behind it.

    Steps grow with the holders of an item. A class has few of them however many
    items it holds, so the running sums never see a whole basket.
    """
    holders = items.groupBy("stock_code").agg(F.count(F.lit(1)).alias("holders"))
    level = F.floor(F.log2("holders") * STEPS_PER_DOUBLING) * STEP_PARTS
    holders = holders.withColumn(
        "step", (level + F.pmod(F.xxhash64("stock_code"), F.lit(STEP_PARTS))).cast("int")
    )
    placed = items.join(holders, "stock_code")
    behind = Window.partitionBy("class_id").orderBy(F.desc("step"))
    reach = placed.groupBy("class_id", "step").agg(F.count(F.lit(1)).alias("held"))
    reach = reach.withColumn("left", F.sum("held").over(behind))
    reach = reach.withColumn("after", F.col("left") - F.col("held")).drop("held")
    return placed.join(reach, ["class_id", "step"])


def bars(ranked: DataFrame, n: int) -> DataFrame:
    """class_id, bar: a closeness that the n+1 nearest other classes all reach.

    A class without a row has fewer than n+1 others among the baskets it met here.
    """
    by_size = Window.partitionBy("stock_code").orderBy("size", "class_id")
    small = (
        ranked.select("stock_code", "size", "class_id")
        .withColumn("_at", F.row_number().over(by_size))
        .filter(F.col("_at") <= n + 2)
        .select("stock_code", F.col("class_id").alias("other_id"), F.col("size").alias("size_b"))
    )
    met = (
        ranked.select("class_id", "size", "stock_code")
        .join(small, "stock_code")
        .filter(F.col("class_id") != F.col("other_id"))
        .groupBy("class_id", "other_id", "size", "size_b")
        .agg(F.count(F.lit(1)).alias("met"))
        .withColumn("closeness", closeness(F.col("met"), F.col("size"), F.col("size_b")))
    )
    best = stage(_best(met, "class_id", n + 1).select("class_id", "other_id", "size", "size_b"), "met-first")
    whole = best.withColumns({"last": F.lit(-1), "rest": F.lit(1)})
    exact = best.join(_shared_behind(whole, ranked), ["class_id", "other_id"])
    return (
        exact.groupBy("class_id")
        .agg(
            F.min(closeness(F.col("more"), F.col("size"), F.col("size_b"))).alias("bar"),
            F.count(F.lit(1)).alias("found"),
        )
        .filter(F.col("found") == n + 1)
        .drop("found")
    )


def candidate_pairs(ranked: DataFrame, bar: DataFrame, block: int) -> DataFrame:
    """Pairs that can reach the bar of class_id, from its side.

    class_id, other_id, size, size_b, met: the items shared up to step `last`, and
    rest: the most they can share behind it. The condition on a pair holds at
    every step before one where it holds, so met leaves out no item up to last.
    """
    asking = (
        ranked.join(bar, "class_id", "left")
        .withColumn("bar", F.coalesce("bar", F.lit(0.0)) * MARGIN)
        # A basket shares no more than it holds, so the closeness is left / size at most.
        .filter((F.col("left") >= F.col("bar") * F.col("size")) & (F.col("holders") > 1))
    )
    blocks = F.ceil(F.col("holders") / block)
    a = asking.withColumn("i", F.pmod(F.xxhash64("class_id"), blocks)).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    b = ranked.select(
        "stock_code",
        F.pmod(F.xxhash64("class_id"), blocks).alias("j"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i"),
        *[F.col(x).alias(y) for x, y in (
            ("class_id", "other_id"), ("size", "size_b"), ("left", "left_b"), ("after", "after_b"))],
    )
    most = F.least("left", "left_b").cast("double")
    pairs = (
        a.join(b, ["stock_code", "i", "j"])
        .filter(
            (F.col("class_id") != F.col("other_id"))
            & (most * most >= F.col("bar") * F.col("size") * F.col("size_b"))
        )
        .groupBy("class_id", "other_id", "size", "size_b", "bar")
        .agg(
            F.count(F.lit(1)).alias("met"),
            F.max("step").alias("last"),
            F.min(F.least("after", "after_b")).alias("rest"),
        )
    )
    shared = (F.col("met") + F.col("rest")).cast("double")
    return pairs.filter(shared * shared >= F.col("bar") * F.col("size") * F.col("size_b")).drop("bar")


def _shared_behind(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """class_id, other_id, more: items shared behind step `last`, by the smaller basket."""
    swap = F.col("size") > F.col("size_b")
    asked = pairs.filter(F.col("rest") > 0).select(
        "class_id",
        "other_id",
        "last",
        F.when(swap, F.col("other_id")).otherwise(F.col("class_id")).alias("small_id"),
        F.when(swap, F.col("class_id")).otherwise(F.col("other_id")).alias("large_id"),
    )
    small = ranked.select(F.col("class_id").alias("small_id"), "stock_code", "step")
    large = ranked.select(F.col("class_id").alias("large_id"), "stock_code")
    return (
        asked.join(small, "small_id")
        .filter(F.col("step") > F.col("last"))
        .join(large, ["large_id", "stock_code"])
        .groupBy("class_id", "other_id")
        .agg(F.count(F.lit(1)).alias("more"))
    )


def class_neighbours(baskets: Baskets, settings: Settings) -> DataFrame:
    """The n+1 nearest customers of each class, its own members included at 1.

    class_id, place (1 = nearest), neighbour_id, similarity.
    """
    n = baskets.n
    ranked = stage(ranked_items(baskets.items), "ranked-items")
    pairs = candidate_pairs(ranked, bars(ranked, n), settings.pair_block)
    pairs = stage(pairs, "pairs-in-reach")
    counted = pairs.join(_shared_behind(pairs, ranked), ["class_id", "other_id"], "left")
    shared = F.col("met") + F.coalesce("more", F.lit(0).cast("long"))
    nearest = _best(
        counted.select(
            "class_id",
            "other_id",
            closeness(shared, F.col("size"), F.col("size_b")).alias("closeness"),
            cosine(shared, F.col("size"), F.col("size_b")).alias("similarity"),
        ),
        "class_id",
        n + 1,
    )

    others = nearest.join(
        baskets.classes.select(F.col("class_id").alias("other_id"), "ids"), "other_id"
    ).select("class_id", "ids", "closeness", "similarity")
    own = baskets.classes.select(
        "class_id", "ids", F.lit(1.0).alias("closeness"), F.lit(1.0).alias("similarity")
    )
    people = others.unionByName(own).withColumn("neighbour_id", F.explode("ids"))
    order = Window.partitionBy("class_id").orderBy(F.desc("closeness"), "neighbour_id")
    return (
        people.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n + 1)
        .select("class_id", "place", "neighbour_id", "similarity")
    )


def slot_neighbours(baskets: Baskets, near: DataFrame) -> DataFrame:
    """The n nearest of each (class, slot): all members of a slot share one list.

    The member at slot s finds itself at place s of the class list; it is taken
    out and later places move up. Slot n+1 stands for everyone not on the list.
    """
    slots = baskets.members.select("class_id", "slot").distinct()
    moved = F.col("place") - (F.col("place") > F.col("slot")).cast("int")
    return (
        slots.join(near, "class_id")
        .filter(F.col("place") != F.col("slot"))
        .withColumn("rank", moved)
        .filter(F.col("rank") <= baskets.n)
        .select("class_id", "slot", "rank", "neighbour_id", "similarity")
    )


def nearest_customers(pairs: DataFrame, settings: Settings) -> DataFrame:
    """customer_id, neighbour_id, similarity, rank: the n nearest of every customer."""
    baskets = group_baskets(pairs, settings.n_closest)
    lists = slot_neighbours(baskets, class_neighbours(baskets, settings))
    return baskets.members.join(lists, ["class_id", "slot"]).select(
        "customer_id", "neighbour_id", "similarity", "rank"
    )


def nearest_items(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The same between items, by the customers they share."""
    turned = pairs.select(
        F.col("stock_code").alias("customer_id"), F.col("customer_id").alias("stock_code")
    )
    return nearest_customers(turned, settings).select(
        F.col("customer_id").alias("stock_code"),
        F.col("neighbour_id").alias("similar_code"),
        "similarity",
        "rank",
    )
