"""Estimates first, then the exact answer: shares of the rows drawn in ranges within strata.

A range is a run of neighbouring rows of a file; strata are runs of neighbouring ranges, and
each draws at least two.  Counts and sums are scaled up by stratum, means are ratios of the two;
margins are half-widths of 95 % intervals from how much the drawn ranges differ.  Each tier
holds the ranges of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedError
from ..functions.predicates import FLOATS
from ..operators.scan import FILE, ROW, Scan

#: Two-sided 95 % points of Student's t by degrees of freedom.
STUDENT = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042, 60: 2.000, 120: 1.980}
NORMAL = 1.960


@dataclass(frozen=True)
class Tier:
    share: float
    exact: bool
    answers: DataFrame


def student(freedom: Column) -> Column:
    out = F.lit(NORMAL)
    for degrees in sorted(STUDENT, reverse=True):
        out = F.when(freedom <= degrees, F.lit(STUDENT[degrees])).otherwise(out)
    return out


def estimate(scan: Scan, keys: dict[str, object], sums: dict[str, object], shares: tuple[float, ...] = (0.001, 0.01, 0.1), range_rows: int = 8192, stratum_ranges: int = 64, seed: int = 0, exact: bool = True, exact_under_s: float | None = None) -> Iterator[Tier]:
    """Tiers of answers: keys, rows, rows_margin, and for each sum its total, mean and their margins.

    exact_under_s: when the exact answer's reads cost less, it comes at once."""
    if scan._order != (FILE, ROW):
        raise UnsupportedError("estimates draw from files")
    symbols = {n: scan._symbol(c) for n, c in sums.items()}
    for n, s in symbols.items():
        if isinstance(s.kind, T.DecimalType):
            raise UnsupportedError(f"{n}: a decimal sum has no estimate")
    at_once = exact_under_s is not None and scan.cost() < exact_under_s
    columns = {}
    for n, s in symbols.items():
        x = s.column.cast("double")
        columns[f"__x{n}"] = F.when(~F.isnan(x), x) if isinstance(s.kind, FLOATS) else x
    df = scan._df.withColumns({**{f"__k{i}": scan._symbol(k).column for i, k in enumerate(keys.values())}, **columns, "__range": F.floor(F.col(ROW) / range_rows)})
    names = [f"__k{i}" for i in range(len(keys))]
    values = ["__n", *(f"__s{n}" for n in sums), *(f"__c{n}" for n in sums)]

    def finish(out: DataFrame, margin) -> DataFrame:
        picked = [F.col(a).alias(b) for a, b in zip(names, keys, strict=True)]
        picked += [F.col("t__n").alias("rows"), margin("__n", None).alias("rows_margin")]
        for n in sums:
            mean = F.when(F.col(f"t__c{n}") > 0, F.col(f"t__s{n}") / F.col(f"t__c{n}"))
            picked += [F.col(f"t__s{n}").alias(n), margin(f"__s{n}", None).alias(f"{n}_margin"), mean.alias(f"{n}_mean"), margin(f"__s{n}", f"__c{n}").alias(f"{n}_mean_margin")]
        return out.select(*picked)

    def whole() -> DataFrame:
        asked = [F.count("*").cast("double").alias("t__n")]
        for n in sums:
            asked += [F.coalesce(F.sum(f"__x{n}"), F.lit(0.0)).alias(f"t__s{n}"), F.count(f"__x{n}").cast("double").alias(f"t__c{n}")]
        return finish(df.groupBy(*names).agg(*asked), lambda a, b: F.lit(0.0))

    if not at_once and shares:
        # every range that there is, also those that the filter empties: from the numbers of rows of the files
        files = _row_counts(scan)
        ranges = files.select(FILE, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / range_rows))).alias("__range"))
        ranges = ranges.withColumn("__stratum", F.floor(F.col("__range") / stratum_ranges)).withColumn("__u", F.xxhash64(FILE, "__range", F.lit(seed)))
        stratum = Window.partitionBy(FILE, "__stratum")
        ranges = ranges.withColumn("__of", F.count("*").over(stratum)).withColumn("__rank", F.row_number().over(stratum.orderBy("__u", "__range")))
        for share in shares:
            wanted = F.least(F.col("__of"), F.greatest(F.lit(2), F.ceil(F.col("__of") * share)))
            drawn = ranges.withColumn("__m", wanted).where(F.col("__rank") <= F.col("__m"))
            sizes = drawn.groupBy(FILE, "__stratum").agg(F.first("__of").alias("__of"), F.first("__m").alias("__m"))
            by_range = df.join(drawn.select(FILE, "__range", "__stratum"), [FILE, "__range"]).groupBy(*names, FILE, "__stratum", "__range")
            asked = [F.count("*").cast("double").alias("__n")]
            for n in sums:
                asked += [F.coalesce(F.sum(f"__x{n}"), F.lit(0.0)).alias(f"__s{n}"), F.count(f"__x{n}").cast("double").alias(f"__c{n}")]
            per = by_range.agg(*asked)
            moments = [F.sum(v).alias(f"a{v}") for v in values] + [F.sum(F.col(v) * F.col(v)).alias(f"q{v}") for v in values] + [F.sum(F.col(f"__s{n}") * F.col(f"__c{n}")).alias(f"p{n}") for n in sums]
            strata = per.groupBy(*names, FILE, "__stratum").agg(*moments).join(sizes, [FILE, "__stratum"])
            of, m = F.col("__of"), F.col("__m")
            scale = of / m

            def spread(cross: Column, a: Column, b: Column, of=of, m=m) -> Column:
                """A stratum's share of the (co)variance of scaled totals; ranges without the group count as zeros."""
                return F.when((m > 1) & (of > m), of * of * (1 - m / of) / m * (cross - a * b / m) / (m - 1)).otherwise(0.0)

            totals = [F.sum(scale * F.col(f"a{v}")).alias(f"t{v}") for v in values]
            variances = [F.sum(spread(F.col(f"q{v}"), F.col(f"a{v}"), F.col(f"a{v}"))).alias(f"v{v}") for v in values]
            cross = [F.sum(spread(F.col(f"p{n}"), F.col(f"a__s{n}"), F.col(f"a__c{n}"))).alias(f"w{n}") for n in sums]
            out = strata.groupBy(*names).agg(*totals, *variances, *cross, F.sum(F.when(of > m, m - 1).otherwise(0)).alias("__freedom"))
            t = student(F.col("__freedom"))

            def margin(a: str, b: str | None, t=t) -> Column:
                if b is None:
                    return t * F.sqrt(F.greatest(F.col(f"v{a}"), F.lit(0.0)))
                r = F.col(f"t{a}") / F.col(f"t{b}")
                v = F.col(f"v{a}") - 2 * r * F.col(f"w{a[3:]}") + r * r * F.col(f"v{b}")
                return F.when(F.col(f"t{b}") > 0, t * F.sqrt(F.greatest(v, F.lit(0.0))) / F.col(f"t{b}"))

            yield Tier(share, False, finish(out, margin))
    if exact or at_once:
        yield Tier(1.0, True, whole())


def _row_counts(scan: Scan) -> DataFrame:
    """Rows of each file, filters aside."""
    df = scan.spark.read.parquet(*scan._df.inputFiles())
    return df.groupBy(F.col("_metadata.file_path").alias(FILE)).agg(F.count("*").alias("rows"))
