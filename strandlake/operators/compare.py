"""Comparison of methods, and relational steps of data analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frequency import earlier
from .pairs import cut, running


def compare_methods(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows that both have, each value with both names as suffix, and its difference."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_{names[0]}") for v in values])
    b = right.select(*keys, *[F.col(v).alias(f"{v}_{names[1]}") for v in values])
    out = a.join(b, keys)
    return out.withColumns({f"{v}_delta": F.col(f"{v}_{names[0]}") - F.col(f"{v}_{names[1]}") for v in values})


def having_all(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Relational division: keys that occur with every part that occurs."""
    every = rows.agg(F.count_distinct(part).alias("_all"))
    has = rows.groupBy(key).agg(F.count_distinct(part).alias("_has"))
    return has.crossJoin(F.broadcast(every)).where("_has = _all").select(key)  # one row


def epistasis(a: Column, b: Column, double: Column, wild: Column) -> dict[str, Column]:
    """Deviation of a double change from what the single changes predict, by model."""
    return {
        "product": double - a * b,
        "additive": (double + wild) - (a + b),
        "log": double - F.log2((F.pow(F.lit(2.0), a) - wild) * (F.pow(F.lit(2.0), b) - wild) + wild),
        "min": double - F.least(a, b),
    }


def combine_clusters(scores: DataFrame, keys: list[str], how: str) -> DataFrame:
    """branch..., score from clusters with score, size and evidence; undefined is 0."""
    s, size, evidence = F.col("score"), F.col("size"), F.col("evidence")
    ways = {
        "sum": F.sum(s),
        "average": F.avg(s),
        "size_weighted": F.try_divide(F.sum(s * size), F.sum(size)),
        "evidence_weighted": F.try_divide(F.sum(s * evidence), F.sum(evidence)),
        "evidence_vs_size": F.try_divide(F.sum(s * evidence), F.sum(size)),
    }
    if how not in ways:
        raise ValueError(f"how must be one of {sorted(ways)}")
    return scores.groupBy(*keys).agg(F.coalesce(ways[how], F.lit(0.0)).alias("score"))


def prefix_scores(scores: DataFrame, keys: list[str], branch: str, average: bool = False) -> DataFrame:
    """Running sum of scores over branches; averaged, it is divided by the branch's place + 1."""
    run = Window.partitionBy(*keys).orderBy(branch)
    total = F.sum("score").over(run.rowsBetween(Window.unboundedPreceding, 0))
    value = total / (F.row_number().over(run) + 1) if average else total
    return scores.select(*keys, branch, value.alias("score"))


def top_labels(rows: DataFrame, key: str, order: list[Column], label: str, n: int = 3) -> DataFrame:
    """label, cnt: how often a label is among the first ``n`` of its key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).groupBy(label).agg(F.count("*").alias("cnt"))


#: Rows of a partition that is sorted to be joined, about.
JOINED = 500_000


def dense_positions(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Both columns re-numbered by the sorted union of their values.

    Rows are dealt to more partitions the more they are, so that no task holds more of a larger table."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // JOINED))
    used = rows.select(F.explode(F.array(first, second)).alias("v")).distinct()
    numbered = running(cut(used).withColumn("_one", F.lit(1)), "v", [], {"n": "_one"})
    number = numbered.select("v", (F.col("n") - 1).cast("int").alias("n"))
    a = number.select(F.col("v").alias(first), F.col("n").alias(f"{first}_index"))
    b = number.select(F.col("v").alias(second), F.col("n").alias(f"{second}_index"))
    return rows.repartition(parts, first).join(a, first).repartition(parts, second).join(b, second)


def with_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of the value by key, and a row 'Total'."""
    got = rows.rollup(key).agg(F.sum(value).alias(value), F.grouping(key).alias("_g"))
    return got.select(F.when(F.col("_g") == 1, "Total").otherwise(F.col(key).cast("string")).alias(key), value)


def relative_to(rows: DataFrame, value: str, reference: Column) -> DataFrame:
    """Add the ratio of the value to that of the (single) reference row."""
    wild = rows.where(reference).agg(F.max(value).alias("_wild"))
    return rows.crossJoin(F.broadcast(wild)).withColumn(f"{value}_ratio", F.try_divide(value, "_wild")).drop("_wild")  # one row


def percentile_cuts(rows: DataFrame, cuts: list[float], coverage: str, value: str, order: str) -> DataFrame:
    """cut, n, the last value at or below each coverage cut, and the mean separation column if there."""
    limits = F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut")
    within = rows.select("*", limits).where(F.col(coverage) <= F.col("cut"))
    return within.groupBy("cut").agg(F.count("*").alias("n"), F.max_by(value, order).alias(f"last_{value}"))


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of undirected links (a, b): root is the least node that is reached.

    Each round, a node takes the least root among its neighbours and then its root's root; rounds are
    written to the checkpoint folder, so lineage does not grow.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node")
    now = cut(now)
    for _ in range(max_rounds):
        near = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = now.join(near, now["node"] == near["a"]).select("node", F.least("root", "r").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = cut(step.join(jump, "root").select("node", F.least("root", "far").alias("root")))
        moved = after.join(now.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty()
        now = after
        if moved:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def cluster_mapping(members: DataFrame) -> DataFrame:
    """(branch, cluster, first_branch, first_cluster): each cluster with the first one, in order, that has the same members.

    members: (branch, cluster, seq_idx).
    """
    sets = members.groupBy("branch", "cluster").agg(F.array_sort(F.collect_set("seq_idx")).alias("_m")).withColumn("_d", F.sha2(F.to_json("_m"), 256))
    first = sets.groupBy("_d").agg(F.min(F.struct("branch", "cluster")).alias("f"))
    return sets.join(first, "_d").select("branch", "cluster", F.col("f.branch").alias("first_branch"), F.col("f.cluster").alias("first_cluster"))


def largest_members(components: DataFrame, size: str) -> DataFrame:
    """The node of largest ``size`` of each component (root, node), the largest first; the smaller name on a tie."""
    best = F.min_by("node", F.struct((-F.col(size)).alias("s"), "node")).alias("node")
    return components.groupBy("root").agg(best, F.max(size).alias(size)).orderBy(F.desc(size), "node")


def repeated_rows(rows: DataFrame, count: str) -> DataFrame:
    """Each row as often as its ``count`` says, numbered from 0."""
    return rows.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))


def string_entropies(strings: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, kind, letter, n, share, term): counts of a string's letters (kind letter) and of its ordered pairs of letters at any
    distance, equal (match) or different (mismatch), each with its share and entropy term; letter null is the total.
    """
    letters = strings.select(key, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("i", "c"))
    single = letters.groupBy(key, F.col("c").alias("letter")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("letter"))
    places = letters.groupBy(key, "c").agg(F.array_sort(F.collect_list("i")).alias("first"))
    later = places.select(key, F.col("c").alias("d"), F.col("first").alias("second"))
    met = places.join(later, key).withColumn("n", earlier(F.col("first"), F.col("second"))).where("n > 0")
    pairs = met.select(key, F.concat("c", "d").alias("letter"), "n", F.when(F.col("c") == F.col("d"), "match").otherwise("mismatch").alias("kind"))
    both = single.select(key, "letter", "n", "kind").unionByName(pairs)
    depth = F.when(F.col("kind") == "letter", F.sum(F.when(F.col("kind") == "letter", F.col("n"))).over(Window.partitionBy(key)))
    depth = depth.otherwise(F.sum(F.when(F.col("kind") != "letter", F.col("n"))).over(Window.partitionBy(key)))
    share = F.col("n") / F.col("_depth")
    rows = both.withColumn("_depth", depth).select(key, "kind", "letter", "n", share.alias("share"), (-share * F.ln(share)).alias("term"))
    total = rows.groupBy(key, "kind").agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.sum("term").alias("term")).withColumn("letter", F.lit(None).cast("string"))
    return rows.unionByName(total)


def optimum_angle(values: list[Column], best: list[Column]) -> Column:
    """Angle between a vector of metrics and the best one: acos of the cosine, which is kept within -1..1; null for a zero vector."""
    dot = sum(v * b for v, b in zip(values, best, strict=True))
    size = F.sqrt(sum(v * v for v in values)) * F.sqrt(sum(b * b for b in best))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, size))))


def wide_annotations(rows: DataFrame, key: str, level: str, value: str) -> DataFrame:
    """One row for each key with a column for each level that occurs anywhere; levels that a key lacks are null.

    Levels are few (those of an annotation); they are read first, so that the columns are known.
    """
    levels = sorted(r[0] for r in rows.select(level).where(F.col(level).isNotNull()).distinct().limit(1001).collect())
    if len(levels) > 1000:
        raise ValueError("more than 1000 levels: keep the table long")
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(level) == x, F.col(value))).alias(str(x)) for x in levels])


def group_statistics(rows: DataFrame, group: str, distinct: str, value: str) -> DataFrame:
    """For each group the number of distinct entries and the range of a value."""
    return rows.groupBy(group).agg(F.count_distinct(distinct).alias("types"), F.min(value).alias("first"), F.max(value).alias("last"))


def timings(rows: DataFrame, key: str, seconds: str) -> DataFrame:
    """The distinct times of each key in minutes and hours."""
    return rows.select(key, (F.col(seconds) / 60).alias("minutes"), (F.col(seconds) / 3600).alias("hours")).dropDuplicates()
