"""Statistics of neighbour sets, sparse products, and sizes of set blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut


def set_table(graph: Graph) -> DataFrame:
    """(id, card, span, density): size, largest less smallest member, and card / (span + 1), null for single members."""
    sets = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("card"), (F.max("dst") - F.min("dst")).alias("span"))
    density = F.least(F.col("card") / (F.col("span") + 1), F.lit(1.0))
    return sets.withColumn("density", F.when(F.col("card") > 1, density))


#: Classes of values that come to the driver at a time; classes of densities.
CLASSES, DENSITIES = 1024, 10_000


def _kth(rows: DataFrame, value: str, k: int, low: float, high: float):
    """The value that k others come before, by counts in classes of equal width that get narrower."""
    v = F.col(value)
    while low < high:
        at = F.least(F.floor((v - F.lit(low)) * (CLASSES / (high - low))), F.lit(CLASSES - 1))
        found = rows.where((v >= low) & (v <= high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        for r in sorted(found.collect(), key=lambda r: r.at):  # CLASSES rows at most
            if k < r.n:
                break
            k -= r.n
        low, high = r.low, r.high
    return low


def dataset_stats(graph: Graph, n_nodes: int | None = None) -> DataFrame:
    """One row. Means and variances are over all nodes (`n_nodes`, or those with neighbours); a median is the
    upper one; a mode is the most frequent value, of equals the smallest; densities count from two members on,
    and as 0 below, and their mode is over 10,000 equal classes. An empty graph gives zeros.

    The table of sets is written once; sums, modes and medians read its three numbers.
    """
    spark = graph.edges.sparkSession
    rows = cut(set_table(graph).select("card", "span", F.coalesce("density", F.lit(0.0)).alias("density")))
    names = "n_sets bigint, avg_card double, max_card bigint, avg_span double, max_span bigint, avg_density double, median_card double, median_density double, mode_card bigint, mode_density double, var_card double, var_density double, skew1_card double, skew2_card double, skew1_density double, skew2_density double, dense_sets bigint"
    dense = (F.col("card") > 1) & (F.col("span") > 0) & (F.col("card") * 256 > F.col("span"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("card", "density") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("var", F.var_pop))]
    got = rows.agg(F.count("*").alias("n"), *ends, F.sum("span").alias("span"), F.max("span").alias("max_span"), F.count(F.when(dense, 1)).alias("dense")).first()
    if not got.n:
        return spark.createDataFrame([(0, 0.0, 0, 0.0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)], names)
    n = n_nodes or got.n
    card, density = got.sum_card / n, got.sum_density / n
    mode = lambda c: rows.groupBy(c.alias("v")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "v").first().v
    mode_card, mode_density = mode(F.col("card")), mode(F.floor(F.col("density") * DENSITIES)) / DENSITIES
    med_card, med_density = (_kth(rows, c, got.n // 2, got[f"min_{c}"], got[f"max_{c}"]) for c in ("card", "density"))
    # squares around the mean over n, from those around the mean over the rows
    vc, vd = ((got[f"var_{c}"] + (got[f"sum_{c}"] / got.n - mean) ** 2) * got.n / n for c, mean in (("card", card), ("density", density)))
    skew = lambda mean, other, v: 3 * (mean - other) / v**0.5 if v > 0 else 0.0
    r = lambda x: round(float(x), 6)
    row = (
        got.n, r(card), got.max_card, r(got.span / n), got.max_span, r(density), r(med_card), r(med_density), mode_card, r(mode_density), r(vc), r(vd),
        r(skew(card, mode_card, vc)), r(skew(card, med_card, vc)), r(skew(density, mode_density, vd)), r(skew(density, med_density, vd)), got.dense,
    )
    return spark.createDataFrame([row], names)


def multiply(edges: DataFrame, vector: DataFrame, weight: str = "attr") -> DataFrame:
    """(id, value): the matrix of (src, dst, weight) times the vector (id, value); rows without any product are left out."""
    each = edges.join(vector.select(F.col("id").alias("dst"), F.col("value").alias("x")), "dst")
    return each.groupBy(F.col("src").alias("id")).agg(F.sum(F.col(weight) * F.col("x")).alias("value"))


def block_counts(graph: Graph, bits: int = 16) -> DataFrame:
    """(id, blocks): blocks of 2**bits values that each node's neighbours fall into."""
    return graph.edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct(F.shiftright("dst", bits)).alias("blocks"))

