"""Problem 1: pairwise matches consolidated into groups.

Method: low-diameter decomposition. Every vertex draws an exponential shift from a hash of its name; clusters grow
along edges from these shifted start times, each vertex joining the cluster that reaches it first. Clusters contract
to super-vertices, the edges between clusters go on to the next level, and the assignments of all levels are composed.

A vertex's start time is a function of its name and the level, so a growth round needs no vertex table: a message is
dropped where it is made if its receiver starts earlier by itself. Only captured vertices are ever stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import drop, durable
from ..operators.skew import lookup_join

#: Ticks of one hop; start times are whole ticks, so arrival times are exact.
TICKS = 1 << 40


def uuid_key(c: Column) -> Column:
    """16 bytes for any way of writing a uuid (case, braces, prefix, missing dashes), else 17 zero bytes and the lower-case trimmed text.

    Null for null or blank text. The byte order of uuids is the order of their plain lower-case forms.
    """
    text = F.trim(F.lower(c))

    def hexed(digits: Column) -> Column:  # null where a character is no hex digit
        return F.unhex(F.when(F.length(digits) == 32, digits))

    usual = hexed(F.replace(text, F.lit("-"), F.lit("")))
    other = hexed(F.translate(F.regexp_replace(text, "^urn:uuid:", ""), "-{}() \t\r\n", ""))
    return F.coalesce(usual, other, F.concat(F.unhex(F.lit("00" * 17)), F.encode(F.nullif(text, F.lit("")), "UTF-8")))


def uuid_text(c: Column) -> Column:
    """The plain lower-case form of a uuid_key."""
    h = F.lower(F.hex(c))
    plain = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.length(c) == 16, plain).otherwise(F.decode(F.substring(c, 18, 1 << 30), "UTF-8"))


def pair_edges(pairs: DataFrame, a: str = "record_a_uuid", b: str = "record_b_uuid", key: str = "pair_key") -> DataFrame:
    """(u, v), u <= v, distinct: the links of each row among the records that its two sides and its pair key name.

    A row that names one record gives (u, u); a row that names none gives nothing.
    """
    parts = (F.split_part(F.col(key), F.lit("|"), F.lit(n)) for n in (1, 2))
    named = [f"k{i}" for i in range(4)]
    keys = pairs.select(*(uuid_key(x).alias(k) for k, x in zip(named, (F.col(a), F.col(b), *parts))))
    links = keys.select(F.coalesce(*named).alias("a"), F.least(*named).eqNullSafe(F.greatest(*named)).alias("one"), F.explode(F.array(*named)).alias("b"))
    return links.where("b is not null and (a <> b or one)").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _start(c: Column, level: int, beta: float, rounds: int) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(c, F.lit(level)), 11).cast("double") + 0.5) / float(1 << 53)
    shift = F.least(F.lit(float(rounds)), -F.log(uniform) / beta)
    return F.round((F.lit(float(rounds)) - shift) * TICKS).cast("long")


def _grow(edges: DataFrame, level: int, beta: float, rounds: int) -> DataFrame:
    """(v, c): each vertex that another vertex's cluster reached before its own start, with that cluster's centre."""
    both = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    both = both.withColumn("dst_start", _start(F.col("dst"), level, beta, rounds))
    best = F.min(F.struct("t", "c", "h")).alias("s")
    state = (
        both.select(F.col("dst").alias("v"), "dst_start", (_start(F.col("src"), level, beta, rounds) + TICKS).alias("t"), F.col("src").alias("c"), F.lit(1).alias("h"))
        .where("t < dst_start")
        .groupBy("v")
        .agg(best)
        .select("v", "s.*")
    )
    for r in range(2, rounds + 1):
        # One pass: a captured vertex keeps its own row and, if it was captured in the last round, sends along its edges.
        sent = state.join(both, (F.col("v") == F.col("src")) & (F.col("h") == r - 1), "left")
        keep = F.struct("v", "t", "c", "h")
        go = F.struct(F.col("dst").alias("v"), (F.col("t") + TICKS).alias("t"), "c", F.lit(r).alias("h"))
        rows = sent.select(F.explode(F.when(F.col("t") + TICKS < F.col("dst_start"), F.array(keep, go)).otherwise(F.array(keep))).alias("x")).select("x.*")
        state = rows.groupBy("v").agg(best).select("v", "s.*")
    return state.select("v", "c")


def connected_groups(edges: DataFrame, beta: float = 0.5, rounds: int = 4, max_levels: int = 200) -> DataFrame:
    """(node, root): one row per vertex of edges(u, v), root being one vertex of its component (not the smallest).

    ``beta`` is the rate of the shifts: about ``beta`` of the edges run between clusters and go on to the next level.
    ``rounds`` bounds a shift and with it a cluster's radius; any bound of 2 or more gives right components (within one
    round nothing starts a whole hop later than its neighbour, so nothing would be captured). An empty table gives
    an empty one; repeated edges and loops are harmless; a null end is not allowed.
    """
    if rounds < 2 or beta <= 0:
        raise ValueError("rounds must be 2 or more and beta positive")
    empty = edges.select(F.col("u").alias("v"), F.col("u").alias("c")).limit(0)
    loops = edges.where("u = v").select(F.col("u").alias("node"))
    current, maps = durable(edges.where("u <> v"), "edges-0"), []
    for level in range(max_levels):
        if not current.count():  # answered from the files' footers
            break
        state = durable(_grow(current, level, beta, rounds), f"clusters-{level}")
        maps.append(state)
        by_u, by_v = (state.select(F.col("v").alias(x), F.col("c").alias("c" + x)) for x in "uv")
        moved = current.join(by_u, "u", "left").join(by_v, "v", "left").select(F.coalesce("cu", "u").alias("a"), F.coalesce("cv", "v").alias("b"))
        following = durable(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"edges-{level + 1}")
        drop(current)
        current = following
    else:
        raise RuntimeError(f"no end after {max_levels} levels")
    drop(current)
    composed = empty
    for state in reversed(maps):
        above = composed.select(F.col("v").alias("c"), F.col("c").alias("root"))
        composed = lookup_join(state, above, "c").select("v", F.coalesce("root", "c").alias("c")).unionByName(composed)
        composed = durable(composed, "composed")
    captured = composed.select(F.col("v").alias("node"), F.col("c").alias("root"))
    roots = captured.select(F.col("root").alias("node"), "root").distinct()
    alone = loops.join(captured.select("node").unionByName(roots.select("node")), "node", "left_anti").distinct()
    return captured.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("root")))


def match_groups(pairs: DataFrame, a: str = "record_a_uuid", b: str = "record_b_uuid", key: str = "pair_key", beta: float = 0.5, rounds: int = 4) -> DataFrame:
    """(group_uuid, internal_uuid): one row per record named in a table of pairs.

    Records are compared by the plain form of their uuid; group_uuid is the smallest of its group. Null and blank
    fields name nothing; a pair key without a separator names one record; an empty table gives no rows; other columns
    of ``pairs`` are ignored.
    """
    found = durable(connected_groups(durable(pair_edges(pairs, a, b, key), "links"), beta, rounds), "roots")
    smallest = found.groupBy("root").agg(F.min("node").alias("least"))
    return lookup_join(found, smallest, "root").select(uuid_text(F.col("least")).alias("group_uuid"), uuid_text(F.col("node")).alias("internal_uuid"))
