"""Connected components of an edge table, and links among the members of shared
keys, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rugosa.llm.common import release, store

#: The largest count of a block.
FULL = (1 << 16) - 1


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``; the root is the
    smallest node of its component.

    Alternating large-star and small-star steps (every node hands its larger,
    then its smaller neighbours to the smallest neighbour) until the edges stay
    as they are. Minima are pre-aggregated before they are shuffled; the join
    that hands them on is one that adaptive execution splits at hot nodes. Each
    step is written to the shared folder. Self-loops and repeated edges do no
    harm; an edge with a null end is ignored; no edges give an empty table.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = store(pairs.where("u is not null and v is not null and u > v").distinct(), label)
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u > v")
            .distinct()
        )
        last, current = current, store(small, label)
        release(last)
        now = _mark(current)
        if now == mark:
            break
        mark = now
    # stars by now: every node but the roots has one edge, to its root
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def shared_members(keys: DataFrame, label: str) -> DataFrame:
    """The different ``key, id`` rows of keys that hold two ids or more. The rows are
    shuffled once: a window hands each key's least and largest id to its rows."""
    own = Window.partitionBy("key")
    both = keys.select("key", "id", F.min("id").over(own).alias("lo"), F.max("id").over(own).alias("hi"))
    return store(both.where("lo < hi").select("key", "id").distinct(), f"{label}-members")


def packed(counts: list[Column]) -> list[Column]:
    """Columns ``w0, w1, ...`` of counts of 16 bits, four in a word; larger counts
    become FULL."""
    out = []
    for at in range(0, len(counts), 4):
        word = F.lit(0).cast("long")
        for i, c in enumerate(counts[at : at + 4]):
            word = word.bitwiseOR(F.shiftleft(F.least(c, F.lit(FULL)).cast("long"), 16 * i))
        out.append(word.alias(f"w{at // 4}"))
    return out


#: Most rows that are compared at once with others of a key, about.
CHUNK = 512
#: Members of a key from which on the pairs are not written down (see ``crowded``).
CROWD = 32


def joined_pairs(left: DataFrame, right: DataFrame, n_words: int, least: int) -> DataFrame:
    """Members of other components that ``left`` may be similar to, by a join on the key."""
    words = [f"w{i}" for i in range(n_words)]
    counts = lambda w: [F.shiftrightunsigned(w, 16 * i).bitwiseAND(FULL) for i in range(4)]
    shared = [F.least(x, y) for w in words for x, y in zip(counts(w), counts("p" + w), strict=True)]
    shared = sum(shared[1:], shared[0])
    # counts are exact unless both sets are larger than a count can be
    possible = ((F.col("size") > FULL) & (F.col("psize") > FULL)) | (
        (100 + least) * shared >= least * (F.col("size") + F.col("psize"))
    )
    other = right.select("key", *[F.col(c).alias("p" + c) for c in ("id", "component", "size", *words)])
    both = left.join(other, "key").where("component <> pcomponent").where(possible)
    return both.select("id", "component", "pid", "pcomponent")


def link_members(
    members: DataFrame,
    profile: DataFrame,
    n_words: int,
    least: int,
    confirm: Callable[[DataFrame], DataFrame],
    label: str,
    compare: Callable[[DataFrame, DataFrame, int, int], DataFrame] = joined_pairs,
    crowded: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``id, component`` of every id of ``profile``, where ids that share a key are
    linked if ``confirm`` says so; the component is its smallest id.

    ``profile`` has ``id, size`` and ``w0, w1, ...`` (``n_words`` of them): the size
    of the id's set, and counts of 16 bits, four in a word, by hash block of the
    elements, of those that another set may hold too (see :func:`packed`). Two sets
    share at most ``m``, the sum over blocks of the smaller count, so their
    similarity is at most ``m / (size + size - m)``; pairs that cannot reach
    ``least`` hundredths are never made (``compare``).

    ``confirm`` gets distinct pairs ``a < b`` with their components ``ca, cb``
    and returns an edge ``u, v`` between the components of each confirmed pair.

    ``crowded``, where there is one, gets the members (``key, id, component``, the
    component ``main`` of the key's representative, ``n`` members of ``total`` elements)
    of keys of more than CROWD members, and returns component edges that link all similar
    ones of a key: there pairs would grow with the square of the members.

    First, one representative of each key, the one with the smallest share of
    elements of its own (the text that others are copies of), is compared with the
    key's members, and components are formed. Then the members of a key that are
    not in its representative's component are compared with all of the key, but
    for their own component. Two members that both are in the representative's
    component need no comparison, so every confirmed link has been found or joins
    what is joined already, and a group of copies costs rows in proportion to its
    size. Tables between steps are deleted when they have been read.
    """
    words = [f"w{i}" for i in range(n_words)]
    labels = profile.select("id", F.col("id").alias("component"), "size", *words)
    counts = [F.shiftrightunsigned(w, 16 * i).bitwiseAND(FULL) for w in words for i in range(4)]
    common = sum(counts[1:], counts[0])
    # without enough elements that others hold, no other can be similar
    able = labels.where((F.col("size") > FULL) | (100 * common >= least * F.col("size"))).select("id")
    members = store(members.join(able, "id", "left_semi").select("key", "id"), f"{label}-able")
    for turn in range(2):
        placed = members.join(labels, "id")
        active = store(
            placed.groupBy("key")
            .agg(
                F.min("component").alias("lo"),
                F.max("component").alias("hi"),
                F.count(F.lit(1)).alias("n"),
                F.sum("size").alias("total"),
                F.min(F.struct((-common / F.col("size")).alias("share"), F.xxhash64("id").alias("h"), "id", "component")).alias("first"),
            )
            .where("lo < hi")
            .select("key", "n", "total", F.col("first.id").alias("first"), F.col("first.component").alias("main")),
            f"{label}-active",
        )
        if active.isEmpty():
            break
        placed = store(placed.join(active, "key"), f"{label}-placed")
        if turn == 0:
            found = joined_pairs(placed.where("id = first"), placed, n_words, least)
        else:
            few = placed if crowded is None else placed.where(F.col("n") <= CROWD)
            found = compare(few.where("component <> main"), few, n_words, least)
        first = F.col("id") < F.col("pid")
        pairs = found.select(
            F.when(first, F.col("id")).otherwise(F.col("pid")).alias("a"),
            F.when(first, F.col("pid")).otherwise(F.col("id")).alias("b"),
            F.when(first, F.col("component")).otherwise(F.col("pcomponent")).alias("ca"),
            F.when(first, F.col("pcomponent")).otherwise(F.col("component")).alias("cb"),
        ).distinct()
        edges = confirm(pairs)
        if turn and crowded is not None:
            edges = edges.unionByName(crowded(placed.where(F.col("n") > CROWD)))
        edges = store(edges, f"{label}-edges")
        merged = components(edges, f"{label}-components").select(F.col("node").alias("component"), "root")
        labels = store(
            labels.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component"), "size", *words),
            f"{label}-labels",
        )
        for done in (active, placed, edges):
            release(done)
    release(members)
    return labels.select("id", "component")
