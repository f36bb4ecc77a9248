"""Consistent placement of rows on shards through a permutation-filled lookup table, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slots of the table: a prime of at least a hundred times the shards, so that shares differ by a hundredth at most.
TABLE_SIZE = 4099


def key_hash(text: Column) -> Column:
    """First 60 bits of the MD5 of a text, a value that any SQL engine can derive."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def placement_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``slot`` (0 to size - 1) and ``shard``: the lookup table.

    Every shard walks all slots in an order of its own: slot = (offset + j * skip) mod size for j = 0, 1, ...  Shards, by
    name, take turns; in its turn a shard claims the first slot of its order that is still free, until the table is full.
    When a shard leaves, the others keep nearly all their slots.  The hash gives the inverse of skip, which runs over the
    same 1 to size - 1, so that the place of a slot in an order is j = (slot - offset) * inverse mod size and a claim is a
    minimum over the free slots.  Filling takes size^2 steps on one row: a cost of the parameters, never of the data.
    Names must be distinct and at least one.
    """
    names = sorted(set(shards), key=str)
    if not names or None in names or len(names) != len(shards) or len(names) > size:
        raise ValueError("shard names must be distinct, not null, and between one and the table's size")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    orders = F.array(*(
        F.struct((key_hash(F.lit(f"offset:{n}")) % size).alias("start"), (key_hash(F.lit(f"skip:{n}")) % (size - 1) + 1).alias("inverse")) for n in names
    ))
    taken = F.expr(f"""aggregate(
        sequence(0, {size - 1}), array_repeat(-1, {size}),
        (taken, turn) -> transform(array(orders[turn % {len(names)}]), p -> transform(
            array(cast(array_min(transform(taken, (owner, slot) ->
                if(owner < 0, pmod((slot - p.start) * p.inverse, {size}) * {size} + slot, null))) % {size} as int)),
            claimed -> transform(taken, (owner, slot) -> if(slot = claimed, turn % {len(names)}, owner)))[0])[0])""")
    table = spark.range(1).select(orders.alias("orders")).select(F.posexplode(taken).alias("slot", "owner"))
    return table.select("slot", F.element_at(F.array(*map(F.lit, names)), F.col("owner") + 1).alias("shard"))


def place(docs: DataFrame, key: str, table: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``: one lookup a row in the broadcast table (``size`` rows).

    No row is moved, whatever its key; rows of one key meet on one shard.  A null key is placed as the empty text.  Own
    columns replace columns of the same names.  An empty ``docs`` gives no rows.
    """
    rows = docs.drop("slot", "shard").withColumn(
        "slot", (key_hash(F.coalesce(F.col(key).cast("string"), F.lit(""))) % size).cast("int"))
    return rows.join(F.broadcast(table), "slot", "left")
