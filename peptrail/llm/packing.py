"""Filling fixed-capacity containers: conflict-constrained best fit on shards of bounded size.

Every document is cut only if it exceeds the capacity: its full pieces are containers of their own, the rest is an item like any other.
Items are spread over shards by a hash, so that a shard holds about SHARD_ITEMS whatever the skew of sources or clusters, and each shard
is packed on its own. Within a shard, items come in decreasing size; open bins are ordered by what is left in them and carry a bitmap of
their sources and one of their duplicate clusters. An item goes to the first bin, from the tightest on, that has room and no conflict:
the search takes one successor after the other until it finds it, and opens a new bin only if there is none.

Conflicts (two of one duplicate cluster, or two sources that must not meet) cost space if a cluster is large. One is accepted only where it
saves a container: if the poorly filled bins of a shard would need fewer without conflicts in mind, they are packed again, compatibly as
before, but once as many bins are open as are needed at least, an item that fits no compatible bin goes to the tightest one with room. Every
such piece is marked in the result, and counted in the usage.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.tokens import TOKENIZER, sized_documents
from peptrail.session import cut_lineage

#: Items that a shard holds on average; each shard leaves about one container that isn't full.
SHARD_ITEMS = 8_192
#: A bin with a larger share of its capacity left is packed again.
SLACK = 0.01
#: Rows that pack_capacities may have.
MOST_CAPACITIES = 1_000


class Bins:
    """Open bins ordered by what is left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (left, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []
        self.items: list[list[int]] = []

    def place(self, item: int, size: int, source: int, forbidden: int, cluster: int, most: int | None = None) -> bool:
        """Put an item into the tightest compatible bin, or a new one; source and cluster are bits, forbidden a mask of sources.

        With ``most`` bins open already, an incompatible bin with room comes before a new one; True if one was taken.
        """
        first = at = bisect_left(self.order, (size, -1))
        order, sources, clusters = self.order, self.sources, self.clusters
        while at < len(order):
            b = order[at][1]
            if not (clusters[b] & cluster or sources[b] & forbidden):
                break
            at += 1
        forced = at == len(order) and first < at and most is not None and len(self.items) >= most
        if forced:
            at = first
        if at == len(order):
            b = len(self.items)
            self.items.append([])
            sources.append(0)
            clusters.append(0)
            self.left.append(self.capacity)
        else:
            b = order[at][1]
            del order[at]
        self.items[b].append(item)
        sources[b] |= source
        clusters[b] |= cluster
        self.left[b] -= size
        if self.left[b]:
            insort(order, (self.left[b], b))
        return forced


def pack(sizes: Sequence[int], capacity: int, sources: Sequence[str | None], clusters: Sequence[int], apart: Sequence[tuple[str, str]] = ()) -> tuple[list[list[int]], set[int]]:
    """Items (by place) of each bin, and those that meet one they shouldn't; no size exceeds the capacity. Equal items keep their order."""
    names = {s: k for k, s in enumerate(sorted({s for s in sources if s is not None} | {x for p in apart for x in p}))}
    forbidden = Counter()
    for a, b in apart:
        forbidden[a] |= 1 << names[b]
        forbidden[b] |= 1 << names[a]
    often = {c: k for k, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    bits = [(0 if s is None else 1 << names[s], forbidden[s], 0 if (k := often.get(c)) is None else 1 << k) for s, c in zip(sources, clusters)]
    falling = lambda items: sorted(items, key=lambda i: (-sizes[i], i))
    bins = Bins(capacity)
    for i in falling(range(len(sizes))):
        bins.place(i, sizes[i], *bits[i])
    poor = {b for b, left in enumerate(bins.left) if left > SLACK * capacity}
    again = falling(i for b in poor for i in bins.items[b])
    free, mixed, met = Bins(capacity), Bins(capacity), set()
    for i in again:
        free.place(i, sizes[i], 0, 0, 0)
    if len(free.items) < len(poor):
        met = {i for i in again if mixed.place(i, sizes[i], *bits[i], len(free.items))}
    if 0 < len(mixed.items) < len(poor):
        return [x for b, x in enumerate(bins.items) if b not in poor] + mixed.items, met
    return bins.items, set()


def packed(docs: DataFrame, capacities: DataFrame, apart: Sequence[tuple[str, str]] = (), tokenizer: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(capacity_id, capacity_tokens, container, doc_id, piece_no, start_token, n_tokens, conflict): where every token of every document lies.

    docs: doc_id, text, source and, if there, family_id (the duplicate clusters); capacities: capacity_id, capacity_tokens, each a task of
    its own. A document of at most the capacity is one piece; a longer one has full pieces, then the rest. Null and empty texts have no
    tokens and no piece; equal texts and repeated rows are pieces each; null or non-positive capacities are passed over. ``apart``: pairs
    of sources that should not share a container. ``conflict``: the piece was added to a container with one that it should not meet.
    """
    # the row number, fixed by the checkpoint, tells repeated documents apart
    sized = cut_lineage(sized_documents(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    wanted = capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").limit(MOST_CAPACITIES + 1).collect()
    if len(wanted) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    shards = max(1, -(-sized.count() // shard_items))
    kinds = F.array(*[F.struct(F.lit(int(r[0])).alias("capacity_id"), F.lit(int(r[1])).alias("capacity_tokens")) for r in wanted]) if wanted else F.expr("cast(array() as array<struct<capacity_id:int,capacity_tokens:int>>)")
    each = sized.select("*", F.inline(kinds))
    cap, n = F.col("capacity_tokens").cast("long"), F.col("n_tokens")
    full = each.where(n >= cap).select(
        "capacity_id", "capacity_tokens", "doc_id", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(n / cap))).alias("piece_no")
    ).select(
        F.col("capacity_id").cast("int"), F.col("capacity_tokens").cast("int"), F.concat_ws("-", F.lit("full"), "row", "piece_no").alias("container"), "doc_id", F.col("piece_no").cast("int"),
        ((F.col("piece_no") - 1) * cap).alias("start_token"), cap.alias("n_tokens"), F.lit(False).alias("conflict"),
    )
    items = each.where(n % cap > 0).select(
        F.col("capacity_id").cast("int"), F.col("capacity_tokens").cast("int"), "doc_id", "source", "cluster", (F.floor(n / cap) + 1).cast("int").alias("piece_no"), (F.floor(n / cap) * cap).alias("start_token"), (n % cap).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "row", F.lit(7)), F.lit(shards)).alias("shard"),
    )
    out = "capacity_id int, capacity_tokens int, container string, doc_id long, piece_no int, start_token long, n_tokens long, conflict boolean"

    def one_shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "doc_id", "start_token"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source = [None if s is None or s != s else s for s in g["source"]]
        bins, met = pack(g["n_tokens"].tolist(), int(g["capacity_tokens"].iloc[0]), source, g["cluster"].tolist(), apart)
        name = np.empty(len(g), dtype=object)
        for k, b in enumerate(bins):
            name[b] = f"{g['shard'].iloc[0]}-{k}"
        return g.assign(container=name, conflict=[i in met for i in range(len(g))])[["capacity_id", "capacity_tokens", "container", "doc_id", "piece_no", "start_token", "n_tokens", "conflict"]]

    return full.unionByName(items.groupBy("capacity_id", "shard").applyInPandas(one_shard, out))


def usage(pieces: DataFrame) -> DataFrame:
    """(capacity_id, capacity_tokens, containers, pieces, tokens, conflicts, unused_share): how full the containers are."""
    per = pieces.groupBy("capacity_id", "capacity_tokens", "container").agg(F.count(F.lit(1)).alias("p"), F.sum("n_tokens").alias("t"), F.count_if("conflict").alias("c"))
    total = per.groupBy("capacity_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), F.sum("c").alias("conflicts"))
    return total.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
