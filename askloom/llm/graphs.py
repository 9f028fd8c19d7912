"""Connected components, inside a task and over a table of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import land


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes can reach by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def sorted_groups(
    df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Bring each group together and hand ``work`` whole groups, many at a time:
    the rows in order of the keys, and each row's group number. For groups of
    bounded size; one task call holds an Arrow batch and one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            group = _group_numbers(table, keys)
            last = int(np.searchsorted(group, group[-1]))
            held = table.slice(last)
            if last and (made := work(table.slice(0, last), group[:last])) is not None:
                yield made
        if held is not None and (made := work(held, _group_numbers(held, keys))) is not None:
            yield made

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def in_blocks(members: DataFrame, group: str, blocks: str, member: str) -> DataFrame:
    """Send each member of a large group to every pair of blocks that holds its
    own: adds ``_mine, _i, _j``. Any two members of a group meet in a pair of
    blocks; a group of one block stays one group."""
    mine = F.pmod(F.xxhash64(F.lit(17), member), F.col(blocks)).cast("int")
    return (
        members.withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
        .withColumn("_i", F.least("_mine", "_other"))
        .withColumn("_j", F.greatest("_mine", "_other"))
        .drop("_other", blocks)
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of all ids in ``u, v``.

    Each round every node moves to the neighbour of least random priority and the
    links are renamed, which removes a constant share of the nodes on average; no
    round holds more than the links. Runs jobs and stores every round.
    """
    links = land(
        links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "links",
    )
    rounds: list[DataFrame] = []
    while True:
        seed = F.lit(len(rounds))
        both = links.union(links.select("v", "u"))
        best = both.groupBy("u").agg(
            F.min(F.struct(F.xxhash64(seed, "v").alias("p"), F.col("v").alias("to"))).alias("best")
        )
        own = F.struct(F.xxhash64(seed, "u").alias("p"), F.col("u").alias("to"))
        moved = land(best.select("u", F.least("best", own)["to"].alias("to")), "moves")
        rounds.append(moved)
        links = land(
            links.join(moved, "u").select(F.col("to").alias("a"), "v")
            .join(moved.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct(),
            "links",
        )
        if links.isEmpty():
            break
    roots = rounds[-1]
    for moved in reversed(rounds[:-1]):
        roots = moved.join(
            roots.select(F.col("u").alias("to"), F.col("to").alias("root")), "to", "left"
        ).select("u", F.coalesce("root", "to").alias("to"))
    roots = land(roots, "roots")
    least = roots.groupBy("to").agg(F.least(F.min("u"), F.col("to")).alias("component"))
    return roots.join(least, "to").select(F.col("u").alias("id"), "component")
