"""Windows over an order, for keys that may hold any share of the rows.

Rows are range-partitioned by key and order and stored; a partition is a part. A window then runs
inside (key, part), so a hot key is many tasks' work, and what a part hands on to the next ones (a sum,
the last value, how long a run was) is one row for each key and part, combined by a window over these.
Rows equal in key and order may stand in either order. Null keys are a key.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import stored

PART, PLACE = "_part", "_place"
FIRST, HERE = Window.unboundedPreceding, Window.currentRow


class Ordered:
    """Rows in parts, with ``_part`` and their place in it from 1."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str]):
        self.key, self.order = key, order
        cut = rows.repartitionByRange(*[F.col(c) for c in (*key, *order)]).sortWithinPartitions(*key, *order)
        cut = stored(cut.withColumn(PART, F.spark_partition_id()), "ordered")
        self.sorted = Window.partitionBy(*key, PART).orderBy(*order)
        self.inside = self.sorted.rowsBetween(FIRST, HERE)
        self.parts = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(PART)
        self.before = self.parts.rowsBetween(FIRST, -1)
        self.rows = cut.withColumn(PLACE, F.row_number().over(self.sorted))

    def carried(self, rows: DataFrame, summary: list[Column], carry: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with the columns that ``carry`` adds to the parts' summaries."""
        own = carry(rows.groupBy(*self.key, PART).agg(*summary))
        names = {c: f"{c}_of_part" for c in (*self.key, PART)}
        own = own.withColumnsRenamed(names)
        same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()])
        return rows.join(own, same).drop(*names.values())

    def running(self, rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Adds each name: the sum of its column over the key's rows up to this one."""
        rows = rows.withColumns({n: F.sum(c).over(self.inside) for n, c in sums.items()})
        ends = [F.max_by(n, PLACE).alias(f"_end_{n}") for n in sums]
        rows = self.carried(rows, ends, lambda p: p.select(*self.key, PART, *[F.coalesce(F.sum(f"_end_{n}").over(self.before), F.lit(0)).alias(f"_in_{n}") for n in sums]))
        return rows.withColumns({n: F.col(n) + F.col(f"_in_{n}") for n in sums}).drop(*[f"_in_{n}" for n in sums])

    def runs(self, rows: DataFrame, hot: dict[str, Column]) -> DataFrame:
        """Adds each name: how many rows in a row, this one included, satisfy its condition; 0 where it fails or is null."""
        rows = rows.withColumns({f"_cold_{n}": F.last(F.when(~F.coalesce(c, F.lit(False)), F.col(PLACE)), True).over(self.inside) for n, c in hot.items()})
        ends = [F.max(PLACE).alias("_rows"), *[F.max(f"_cold_{n}").alias(f"_cold_{n}") for n in hot]]

        def carry(p: DataFrame) -> DataFrame:
            for n in hot:  # a part that is hot throughout lengthens the run before it
                tail = F.col("_rows") - F.coalesce(f"_cold_{n}", F.lit(0))
                p = p.withColumn("_island", F.sum(F.col(f"_cold_{n}").isNotNull().cast("long")).over(self.parts.rowsBetween(FIRST, HERE)))
                out = F.sum(tail).over(Window.partitionBy(*self.key, "_island").orderBy(PART).rowsBetween(FIRST, HERE))
                p = p.withColumn("_out", out).withColumn(f"_in_{n}", F.coalesce(F.lag("_out").over(self.parts), F.lit(0))).drop("_island", "_out")
            return p.select(*self.key, PART, *[f"_in_{n}" for n in hot])

        rows = self.carried(rows, ends, carry)
        own = {n: F.col(PLACE) - F.coalesce(f"_cold_{n}", F.lit(0)) + F.when(F.col(f"_cold_{n}").isNull(), F.col(f"_in_{n}")).otherwise(0) for n in hot}
        return rows.withColumns(own).drop(*[f"_{x}_{n}" for n in hot for x in ("cold", "in")])

    def latest(self, rows: DataFrame, name: str, value: Column, default: Column) -> DataFrame:
        """Adds ``name``, the last value up to this row that is not null, and ``<name>_before``, the same for the row before."""
        rows = rows.withColumn("_own", F.last(value, True).over(self.inside))
        rows = self.carried(rows, [F.max_by("_own", PLACE).alias("_end")], lambda p: p.select(*self.key, PART, F.last("_end", True).over(self.before).alias("_in")))
        rows = rows.withColumn(name, F.coalesce("_own", "_in", default))
        return rows.withColumn(f"{name}_before", F.coalesce(F.lag("_own").over(self.sorted), "_in", default)).drop("_own", "_in")

    def upcoming(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """Adds ``name``, the first value from this row on that is not null."""
        backward = Window.partitionBy(*self.key, PART).orderBy(F.desc(PLACE)).rowsBetween(FIRST, HERE)  # a frame open at its far end would be read anew for each row
        behind = (Window.partitionBy(*self.key) if self.key else Window.partitionBy(F.lit(0))).orderBy(F.desc(PART)).rowsBetween(FIRST, -1)
        rows = rows.withColumn("_own", F.last(value, True).over(backward))
        rows = self.carried(rows, [F.min_by("_own", PLACE).alias("_end")], lambda p: p.select(*self.key, PART, F.last("_end", True).over(behind).alias("_in")))
        return rows.withColumn(name, F.coalesce("_own", "_in")).drop("_own", "_in")

    def lagged(self, rows: DataFrame, value: str, back: dict[str, int]) -> DataFrame:
        """Adds each name: ``value`` so many rows back, or the key's first one where there are fewer."""
        most = max(max(back.values()), 1)
        rows = rows.withColumn("_left", F.count(F.lit(1)).over(Window.partitionBy(*self.key, PART)) - F.col(PLACE))
        near = F.array_sort(F.collect_list(F.when(F.col("_left") < most, F.struct(PLACE, F.col(value).alias("v")))))
        ends = [F.transform(near, lambda x: x["v"]).alias("_tail"), F.min_by(value, PLACE).alias("_head")]
        halo = self.parts.rowsBetween(-most, -1)
        rows = self.carried(rows, ends, lambda p: p.select(*self.key, PART, F.flatten(F.collect_list("_tail").over(halo)).alias("_tails"), F.first("_head").over(self.parts.rowsBetween(FIRST, HERE)).alias("_head")))
        for name, k in back.items():
            short = k - F.col(PLACE) + 1
            far = F.when(F.size("_tails") >= short, F.element_at("_tails", -F.greatest(short, F.lit(1)).cast("int"))).otherwise(F.col("_head"))
            rows = rows.withColumn(name, F.when(F.col(PLACE) > k, F.lag(value, k).over(self.sorted)).otherwise(far))
        return rows.drop("_left", "_tails", "_head")


def medians(rows: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """(key, each name): the exact median of its column's values that are not null, as a double; null where there are none.

    Equal values are counted first and counts added up in order of value; the two counts
    in the middle name the median. So no buffer holds a key's values.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()])).alias("_x")
    counts = rows.select(*key, each).select(*key, "_x.*").groupBy(*key, "_name", "_v").agg(F.count("_v").alias("_c"))
    o = Ordered(counts, [*key, "_name"], ["_v"])
    upto = o.running(o.rows, {"_upto": F.col("_c")})
    all_ = counts.groupBy(*key, "_name").agg(F.sum("_c").alias("_n")).withColumnsRenamed({c: f"{c}_all" for c in (*key, "_name")})
    met = upto.join(all_, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_all")) for c in (*key, "_name")]))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))

    middle = met.groupBy(*key, "_name").agg(at(F.expr("(_n - 1) div 2")).alias("_a"), at(F.expr("_n div 2")).alias("_b"))
    return middle.groupBy(*key).agg(*[F.max(F.when(F.col("_name") == n, (F.col("_a") + F.col("_b")) / 2)).alias(n) for n in values])


SPAN = 8192


def sliding(rows: DataFrame, key: list[str], order: list[str], value: str, history: int, name: str, kind: DataType, pick: Callable[[list[float]], float | None]) -> DataFrame:
    """Adds ``name``: what ``pick`` takes from the sorted values of the last ``history`` rows, nulls left out, NaN as the greatest.

    A key's rows are cut into spans of ``SPAN`` by their number; the last rows of a span go to the
    next one as well. A span's window is a sorted list with one value put in and one taken out for each row.
    """
    span = max(SPAN, history)
    o = Ordered(rows, key, order)
    n = o.running(o.rows.withColumn("_one", F.lit(1)), {"_n": F.col("_one")}).drop("_one", PART, PLACE).withColumn("_n", F.col("_n") - 1)
    own = n.withColumn("_span", F.expr(f"_n div {span}")).withColumn("_own", F.lit(True))
    halo = own.where(F.col("_n") % span > span - history).withColumn("_span", F.col("_span") + 1).withColumn("_own", F.lit(False))
    arrow = pa.float64() if kind.typeName() == "double" else pa.int64()

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("_n", "ascending")]))
        known = pc.is_valid(t["_value"]).to_numpy()
        values = np.nan_to_num(pc.cast(t["_value"], pa.float64()).to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf).tolist()
        window: list[float] = []
        out = []
        for i, v in enumerate(values):
            if known[i]:
                insort(window, v)
            if i >= history and known[i - history]:
                del window[bisect_left(window, values[i - history])]
            out.append(pick(window))
        t = t.append_column(name, pa.array(out, arrow)).filter(t["_own"])
        return t.select([*columns, name])

    columns = [c for c in rows.columns if c != name]
    schema = StructType([*[f for f in rows.schema.fields if f.name != name]]).add(name, kind)
    both = own.unionByName(halo).withColumn("_value", F.col(value))
    return both.groupBy(*key, "_span").applyInArrow(run, schema)
