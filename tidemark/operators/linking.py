"""Connected components and ordered chains from links between rows, in rounds that halve what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import checkpoint_dir


def smallest_linked(links: DataFrame) -> DataFrame:
    """(local, label): the smallest number that each number in links (a, b) is linked with. Labels spread along links and jump
    to their own labels; numbers whose label is its own label don't take part in the jump, so the label of a large component
    is no hot key. The rounds grow with the logarithm of the longest way; each is a checkpoint."""
    checkpoint_dir(links.sparkSession)
    pairs = links.where(F.col("a") != F.col("b")).select("a", "b")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = pairs.select(F.col("a").alias("local"), F.col("a").alias("label")).distinct()
    changed = not pairs.isEmpty()
    while changed:
        near = pairs.join(labels, pairs["b"] == labels["local"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["local"] == near["a"]).select("local", "label", F.least("label", "near").alias("new"))
        moving = labels.where(F.col("local") != F.col("label")).select(F.col("local").alias("new"), F.col("label").alias("further"))
        after = spread.join(moving, "new", "left").select("local", "label", F.least("new", F.coalesce("further", "new")).alias("new")).checkpoint()
        changed = not after.where(F.col("new") != F.col("label")).isEmpty()
        labels = after.select("local", F.col("new").alias("label"))
    return labels


def ring_order(parts: DataFrame) -> DataFrame:
    """(head, ring, at) of the parts (head, next, n) of rings: next names the part that follows, the last is followed by the
    first; n is a part's length. ring is the smallest head of the ring, at the length of the parts from there to this one. Each
    round doubles the reach of every part, so a ring of k parts takes about the logarithm of k; each is a checkpoint."""
    checkpoint_dir(parts.sparkSession)
    own = parts.select("head", "next", "n").checkpoint()
    reach = own.select("head", "next", F.col("head").alias("ring"))
    while True:
        further = reach.select(F.col("head").alias("next"), F.col("next").alias("then"), F.col("ring").alias("there"))
        new = reach.join(further, "next").select("head", F.col("then").alias("next"), "ring", F.least("ring", "there").alias("new")).checkpoint()
        changed = not new.where(F.col("new") != F.col("ring")).isEmpty()
        reach = new.select("head", "next", F.col("new").alias("ring"))
        if not changed:
            break
    named = reach.select("head", "ring")
    # Backwards from each part to the first of its ring, which has nothing before it.
    before = own.select(F.col("next").alias("head"), F.col("head").alias("back"), F.col("n").alias("at")).join(named, "head")
    first = F.col("head") == F.col("ring")
    back = before.select("head", "ring", F.when(~first, F.col("back")).alias("back"), F.when(first, 0).otherwise(F.col("at")).cast("long").alias("at")).checkpoint()
    while not back.where(F.col("back").isNotNull()).isEmpty():
        done, open_ = back.where(F.col("back").isNull()), back.where(F.col("back").isNotNull())
        further = back.select(F.col("head").alias("back"), F.col("back").alias("then"), F.col("at").alias("more"))
        moved = open_.join(further, "back").select("head", "ring", F.col("then").alias("back"), (F.col("at") + F.col("more")).alias("at"))
        back = done.unionByName(moved).checkpoint()
    return back.select("head", "ring", "at")
