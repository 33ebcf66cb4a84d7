"""Ranks, running sums and exact quantiles over whole groups without a group in one task: rows are cut into pieces of an order,
treated within these, and moved by what the pieces before hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

#: Rows that a piece should have, and how many pieces an order is cut into at most.
PIECE_ROWS, MAX_PIECES = 100_000, 4096
#: Percentiles that are looked up at once; pieces are cut at as many of them as the number of rows asks for.
PERCENTILES = 1024


def _below(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """The number of edges that lie below a value, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(value <= F.lit(edges[mid]), _below(value, edges[:mid], first)).otherwise(_below(value, edges[mid + 1 :], first + mid + 1))


def _place(value: Column, edges: Sequence[float]) -> Column:
    """A number that rises with a value: even between edges, odd at an edge itself, whose rows are a piece of their own."""
    below = _below(value, edges)
    if not edges:
        return F.lit(0).cast("int")
    at = F.element_at(F.array(*map(F.lit, edges)), F.least(below + 1, F.lit(len(edges))).cast("int"))
    return (below * 2 + F.coalesce((value == at).cast("int"), F.lit(0))).cast("int")


def _thinned(percentiles: Sequence[float] | None, n: int) -> list[float]:
    """As many of the percentiles as n rows need, values that come again left in once."""
    pieces = min(MAX_PIECES, -(-n // PIECE_ROWS))
    step = max(1, -(-PERCENTILES // max(1, pieces)))
    return sorted(set((percentiles or [])[step - 1 :: step])) if pieces > 1 else []


def edges_of(rows: DataFrame, *columns: str) -> list[list[float]]:
    """For each of some numeric columns the values at which its order is cut: approximate percentiles, at most PERCENTILES."""
    points = [k / PERCENTILES for k in range(1, PERCENTILES)]
    found = rows.agg(F.count("*"), *(F.percentile_approx(c, points, 10_000) for c in columns)).first()
    return [_thinned(found[k + 1], found[0]) for k in range(len(columns))]


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of columns in which null is a value."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def numbered(rows: DataFrame, by: list[str], order: str, tie: str, descending: bool = False, sums: Mapping[str, Column] | None = None, piece: Column | None = None, keep_null_groups: bool = False, rank: str = "rank", size: str = "group_n") -> DataFrame:
    """rows with rank (from 1) and group_n, and, for each of `sums`, its running sum up to the row, within groups and in the
    order of a column, ties by another.

    The order is cut at approximate percentiles, as many as the number of rows needs, or as `piece` says, which must rise with
    it. A value at which it is cut is a piece of its own, cut further by the tie where that is a number, so that values shared
    by many rows do not meet in one task. Rows whose order is null are left out, and, unless `keep_null_groups`, those whose
    group is. Columns of rows keep their names and values; the new ones are named by `rank` and `size`, which rows must not
    have.
    """
    taken = {c.lower() for c in rows.columns} & {rank.lower(), size.lower(), *(n.lower() for n in sums or {})}
    if taken:
        raise ValueError(f"rows already have {sorted(taken)}; give other names")
    kept = rows.filter(F.col(order).isNotNull())
    if not keep_null_groups:
        for c in by:
            kept = kept.filter(F.col(c).isNotNull())
    within_value = F.lit(0)
    if piece is None:
        numeric = isinstance(rows.schema[tie].dataType, NumericType) and tie != order
        cuts = edges_of(kept, order, tie) if numeric else edges_of(kept, order)
        place = _place(F.col(order), cuts[0])
        if numeric and cuts[0]:
            within_value = F.when(place % 2 == 1, _below(F.col(tie), cuts[1])).otherwise(F.lit(0))
        piece = place
    sums = dict(sums or {})
    keys = [f"k{i}" for i in range(len(by))]
    one = kept.select(
        F.struct(*kept.columns).alias("row"), *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(order).alias("o"), F.col(tie).alias("t"),
        (-piece if descending else piece).alias("p"), within_value.alias("q"), *(c.alias(f"x_{n}") for n, c in sums.items()),
    )
    counts = one.groupBy(*keys, "p", "q").agg(F.count("*").alias("n"), *(F.sum(f"x_{n}").alias(f"s_{n}") for n in sums))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1)
    started = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = counts.select(*keys, "p", "q", F.sum("n").over(whole).alias("total"), started("n").alias("at"), *(started(f"s_{n}").alias(f"at_{n}") for n in sums))
    within = Window.partitionBy(*keys, "p", "q").orderBy(F.desc("o") if descending else F.asc("o"), "t")
    run = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = one.withColumns({"r": F.row_number().over(within), **{f"r_{n}": F.sum(f"x_{n}").over(run) for n in sums}})
    moved = ranked.alias("a").join(starts.alias("b"), _same("a", "b", [*keys, "p", "q"]))
    more = (((F.col(f"r_{n}") + F.col(f"at_{n}")).alias(n)) for n in sums)
    return moved.select("a.row.*", (F.col("r") + F.col("at")).alias(rank), F.col("total").alias(size), *more)


def upto(counts: DataFrame, by: list[str], value: str, of: Mapping[str, str]) -> DataFrame:
    """counts (a row a group and value) with, for each name in `of`, the sum of a column over the group's smaller values."""
    summed = numbered(counts, by, value, value, sums={f"{name}_": F.col(c) for name, c in of.items()}, keep_null_groups=True, rank="rank_", size="group_n_")
    return summed.select(*counts.columns, *((F.col(f"{name}_") - F.col(c)).alias(name) for name, c in of.items()))


def exact_quantiles(rows: DataFrame, by: list[str], columns: Sequence[str], wanted: Mapping[str, tuple[float, bool]]) -> DataFrame:
    """by, and for each column c and name in `wanted` a column c_name: the quantile of a fraction, between the two nearest values
    if its flag is set (as a median is), else the least value that reaches it. Nulls take no part; a group without values
    has null.

    Each column is cut into pieces and counted; only the pieces that hold a wanted rank are looked at again, by distinct
    values. Neither step sorts or keeps a group.
    """
    keys = [f"k{i}" for i in range(len(by))]
    named = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    edges = edges_of(named, *(f"v{i}" for i in range(len(columns))))
    long = named.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v"), _place(F.col(f"v{i}"), e).alias("p")) for i, e in enumerate(edges)))).alias("x"))
    values = long.select(*keys, "x.*").filter("v is not null")
    pieces = values.groupBy(*keys, "c", "p").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys, "c")
    before = group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(group)})

    def ranks(name: str, fraction: float, between: bool) -> Column:
        """The one or two ranks that a quantile is made of, from 1, and the weight of each."""
        if between:
            place = F.lit(fraction) * (F.col("total") - 1)
            low = F.floor(place)
            return F.array(
                F.struct(F.lit(name).alias("name"), (low + 1).cast("long").alias("r"), (1 - (place - low)).alias("w")),
                F.struct(F.lit(name).alias("name"), (F.ceil(place) + 1).cast("long").alias("r"), (place - low).alias("w")),
            )
        return F.array(F.struct(F.lit(name).alias("name"), F.greatest(F.col("total") - F.floor(F.col("total") - F.lit(fraction) * F.col("total")), F.lit(1)).cast("long").alias("r"), F.lit(1.0).alias("w")))

    asked = placed.withColumn("ask", F.explode(F.concat(*(ranks(name, *how) for name, how in wanted.items())))).select(*keys, "c", "p", "at", "ask.*")
    asked = asked.join(placed.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("c").alias("c_"), F.col("p").alias("p_"), "n"), reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"{x}_")) for x in [*keys, "c", "p"])))
    asked = asked.filter((F.col("r") > F.col("at")) & (F.col("r") <= F.col("at") + F.col("n"))).select(*keys, "c", "p", "at", "name", "r", "w")
    looked = asked.select(*keys, "c", "p").distinct()
    inside = values.alias("a").join(looked.alias("b"), _same("a", "b", [*keys, "c", "p"]), "left_semi").groupBy(*keys, "c", "p", "v").agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys, "c", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = inside.withColumn("end", F.sum("n").over(run))
    hits = asked.alias("a").join(ended.alias("b"), _same("a", "b", [*keys, "c", "p"]))
    hits = hits.filter((F.col("r") <= F.col("at") + F.col("end")) & (F.col("r") > F.col("at") + F.col("end") - F.col("b.n")))
    found = hits.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.c").alias("c"), "name", "w", "v")
    total = lambda i, name: F.sum(F.when((F.col("c") == i) & (F.col("name") == name), F.col("v") * F.col("w")))
    out = found.groupBy(*keys).agg(*(total(i, name).alias(f"{c}_{name}") for i, c in enumerate(columns) for name in wanted))
    every = named.select(*keys).distinct()
    joined = every.alias("a").join(out.alias("b"), _same("a", "b", keys), "left") if keys else out
    return joined.select(*(F.col(f"a.{k}").alias(c) for c, k in zip(by, keys, strict=True)), *(F.col(f"{c}_{name}") for c in columns for name in wanted))
