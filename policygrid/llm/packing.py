"""Filling fixed-capacity containers with items, balanced by linear plus quadratic attention cost."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.session import durable, require_columns, spread

CAPACITY = 2048
#: Items that one task packs; shards are drawn by hash, so they hold about so many of every size.
SHARD_ITEMS = 8192
#: Tokens at which the quadratic cost of attention equals the linear cost.
QUADRATIC_AT = 1024


def cost(n: np.ndarray | float, quadratic_at: float = QUADRATIC_AT) -> np.ndarray | float:
    """Linear plus quadratic cost of one item of n tokens; items of a container don't attend to each other."""
    return n + n * n / quadratic_at


def pack_sizes(sizes: np.ndarray, capacity: int, quadratic_at: float = QUADRATIC_AT) -> np.ndarray:
    """Container number of each item (all at most `capacity`).

    Items go in descending order to the container of lowest cost among those with
    room. The number of containers begins at the least possible and grows only when
    an item fits nowhere; it is then tried whether starting with more containers
    needs fewer in the end.
    """
    n = len(sizes)
    order = np.lexsort((np.arange(n), -sizes))
    costs = cost(sizes.astype(np.float64), quadratic_at)

    def run(start: int) -> tuple[np.ndarray, int]:
        where = np.empty(n, np.int64)
        room = np.full(start, capacity, np.int64)
        load = np.zeros(start)
        for i in order:
            s = sizes[i]
            fit = np.where(room >= s, load, np.inf)
            b = int(fit.argmin()) if len(fit) else 0
            if not len(fit) or fit[b] == np.inf:
                room, load, b = np.append(room, capacity), np.append(load, 0.0), len(room)
            room[b] -= s
            load[b] += costs[i]
            where[i] = b
        return where, len(room)

    least = max(1, math.ceil(sizes.sum() / capacity)) if n else 0
    best, used = run(least)
    if used > least + 1:
        other, fewer = run((least + used) // 2)
        if fewer < used:
            best = other
    return best


def _pack(capacity: int, quadratic_at: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "piece_no"], ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        return pdf.drop(columns="shard").assign(container=[f"{key[0]}-{b}" for b in pack_sizes(sizes, capacity, quadratic_at)])

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, quadratic_at: float = QUADRATIC_AT) -> DataFrame:
    """item_id, piece_no, n_pieces, start, n_tokens, container of every item.

    An item larger than `capacity` is split into full pieces and a rest, no other
    is. Pieces are dealt by hash to shards of about `shard_items`; no shard can grow
    with a hot key, as the hash is of the item and its piece. Each shard is packed
    by pack_sizes(). Items of size 0 or null take no room and go along in a
    container as size 0; repeated ids are items of their own; an empty table gives
    no rows. Only the number of pieces reaches the driver.
    """
    require_columns(items, key, size)
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    sized = durable(items.select(F.col(key).alias("item_id"), n.alias("total")), "sizes")
    pieces = sized.select("item_id", "total", F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("int").alias("n_pieces"))
    count = pieces.agg(F.coalesce(F.sum("n_pieces"), F.lit(0))).first()[0]
    shards = max(1, round(count / shard_items))
    each = pieces.select("item_id", "total", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no")).select(
        "item_id", "piece_no", "n_pieces", ((F.col("piece_no") - 1).cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - (F.col("piece_no") - 1) * capacity).alias("n_tokens"),
        F.pmod(F.xxhash64("item_id", "piece_no", "total"), F.lit(shards)).alias("shard"),
    )
    id_type = items.schema[key].dataType.simpleString()
    full = each.where(F.col("n_tokens") == capacity).select(
        "item_id", "piece_no", "n_pieces", "start", "n_tokens", F.concat(F.lit("full-"), F.hex(F.xxhash64("item_id", "piece_no")), F.lit("-"), F.monotonically_increasing_id()).alias("container"))
    packed = spread(each.where(F.col("n_tokens") < capacity), shards, "shard").groupBy("shard").applyInPandas(_pack(capacity, quadratic_at), f"item_id {id_type}, piece_no int, n_pieces int, start long, n_tokens long, container string")
    return full.unionByName(packed)
