"""Relational operators around documents: links, islands, grids, splits, samples, resume, sweeps, checks, profiles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_links(df: DataFrame, scope: list[str], order: str, id_col: str, before: str, after: str) -> DataFrame:
    """``df`` with the ids of the row before and after within ``scope``."""
    window = Window.partitionBy(*scope).orderBy(order)
    return df.withColumns({before: F.lag(id_col).over(window), after: F.lead(id_col).over(window)})


def with_sibling_sections(sections: DataFrame) -> DataFrame:
    """Sections with sibling links under one parent; top-level sections have none."""
    linked = with_links(sections, ["doc_id", "parent_id"], "order", "section_id", "prev_sibling_id", "next_sibling_id")
    only = F.col("parent_id").isNotNull()
    return linked.withColumns({c: F.when(only, F.col(c)) for c in ("prev_sibling_id", "next_sibling_id")})


def child_ids(df: DataFrame, parent: str, order: str, child: str, scope: list[str]) -> DataFrame:
    """The ids below each parent within ``scope``, in order, as the array ``children``; rows without a parent are nobody's."""
    rows = df.filter(F.col(parent).isNotNull()).groupBy(*scope, parent)
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(child).alias("c")))), lambda x: x["c"]).alias("children"))


def tag_spans(df: DataFrame, scope: list[str], order: str, tag: str, token: str, start: str = "B", inside: str = "I", alone: str = "DISEASE") -> DataFrame:
    """Spans of a tagged token stream: ``start`` opens one, ``inside`` extends an open one, ``alone`` is one by itself.

    A lone token does not close an open span; any other tag does.
    """
    window = Window.partitionBy(*scope).orderBy(order)
    rows = df.filter(F.col(tag) != alone)
    ends = F.when(F.col(tag) == start, 1).when(F.col(tag) == inside, 0).otherwise(1)
    island = F.sum(ends).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opened = rows.withColumn("_island", island).withColumn("_first", F.first(F.col(tag)).over(Window.partitionBy(*scope, "_island").orderBy(order)))
    spans = (
        opened.filter((F.col("_first") == start) & F.col(tag).isin(start, inside))
        .groupBy(*scope, "_island")
        .agg(F.min(order).alias("begin_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(token).alias("t")))), lambda x: x["t"]), " ").alias("span"))
        .drop("_island")
    )
    single = df.filter(F.col(tag) == alone).select(*scope, F.col(order).alias("begin_at"), F.col(token).alias("span"))
    return spans.unionByName(single)


def first_per_key(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def label_grid(df: DataFrame, a: str, b: str, labels: tuple[str, ...]) -> DataFrame:
    """Counts of all ordered pairs of different labels, 0 where none, with their percentage of all disagreements."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels if x != y], f"{a} string, {b} string")
    valid = df.filter(F.col(a).isin(*labels) & F.col(b).isin(*labels) & (F.col(a) != F.col(b)))
    counts = valid.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    joined = grid.join(counts, [a, b], "left").fillna(0, ["count"])
    total = F.sum("count").over(Window.partitionBy())  # len(labels) squared rows
    share = F.when(total > 0, F.bround(F.col("count") / total * 100, 2)).otherwise(F.lit(0.0))
    return joined.select(
        F.concat(F.col(a), F.lit(" → "), F.col(b)).alias("combination"), a, b, F.col("count").cast("long").alias("count"), share.alias("percentage_of_disagreements")
    )


def group_split(df: DataFrame, group: str, seed: int = 42, train: float = 0.8, validation: float = 0.5) -> DataFrame:
    """``df`` with ``split``: whole groups go to train, validation or test by exact quotas of groups.

    Groups are ordered by a seeded hash. Ranks come from counts of hash buckets, so no task sees all groups. Rows without a
    group are a group of their own.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit("\0"))
    groups = df.select(group).distinct().withColumn("_h", F.md5(F.concat(name, F.lit(f":{seed}"))))
    groups = groups.withColumn("_bucket", F.substring("_h", 1, 3))
    sizes = groups.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )  # at most 4096 rows
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", group)) + F.col("_shift")
    n_train = F.floor(F.lit(train) * F.col("_all"))
    n_validation = F.floor(F.lit(validation) * (F.col("_all") - n_train))
    split = F.when(rank <= n_train, "train").when(rank <= n_train + n_validation, "validation").otherwise("test")
    dealt = groups.join(F.broadcast(shifts), "_bucket").select(F.col(group).alias("_group"), split.alias("split"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def split_summary(df: DataFrame, group: str, sums: tuple[str, ...]) -> DataFrame:
    """Rows, distinct groups and sums of each split, in the order train, validation, test."""
    order = df.sparkSession.createDataFrame([(0, "train"), (1, "validation"), (2, "test")], "_o int, split string")
    found = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), *[F.sum(c).cast("long").alias(c) for c in sums])
    return F.broadcast(order).join(found, "split", "left").orderBy("_o").drop("_o")


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups in more than one split."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def _share(spark: SparkSession) -> None:
    """Lets Spark write to the folder of ``spark.checkpoint.dir``; where that is unset, as in tests, to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textquarry-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder."""
    _share(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    _share(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df``, written once to the shared folder as a compressed table; its rows keep no order."""
    path = path or shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Frees a path of the shared folder that no later step reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in the whole order, without a task that sees all rows.

    Rows are dealt to ranges of the order; each row's place is its rank in its range and the number of rows before it.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once, as a second run could draw the ranges otherwise.
    ranged = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    # The upper bits of the number are the range, the lower ones the rank within it; ties in the order are one range's.
    ranged = ranged.withColumns({"_range": F.shiftright("_id", 33), "_rank": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # a row a range
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_rank") + F.col("_shift") + 1).cast("long")).drop("_id", "_range", "_rank", "_shift")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the smallest by seeded hash of the key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def resumed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together; columns that one side lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``df`` with the columns it lacks."""
    return df.withColumns({name: value for name, value in defaults.items() if name not in df.columns})


def chosen_columns(df: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*required, *[c for c in optional if c in df.columns])


def threshold_sweep(df: DataFrame, group: str, answer: str, score: str, gold: str, thresholds: tuple[float, ...], otherwise: str) -> DataFrame:
    """The accuracy of each group at each threshold: a row answers if its score is greater, else ``otherwise``."""
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    said = F.when(F.col(score) > F.col("threshold"), F.col(answer)).otherwise(F.lit(otherwise))
    return df.join(F.broadcast(grid)).groupBy(group, "threshold").agg(F.avg((said == F.col(gold)).cast("double")).alias("accuracy"))


def best_threshold(sweep: DataFrame, group: str) -> DataFrame:
    """The threshold with the highest accuracy, the lowest of equals."""
    return sweep.groupBy(group).agg(F.max(F.struct(F.col("accuracy"), (-F.col("threshold")).alias("t"))).alias("_b")).select(
        group, (-F.col("_b.t")).alias("threshold"), F.col("_b.accuracy").alias("accuracy")
    )


def profile(df: DataFrame, value: str, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, mean, extremes and interpolated percentiles of a column, one row."""
    found = F.percentile(value, F.array(*[F.lit(p) for p in percentiles]))
    out = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), found.alias("_p"))
    return out.select("n", "mean", "least", "most", *[F.col("_p")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(percentiles)])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes: bin, low, high, count; the last bin holds the greatest value."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    placed = df.filter(F.col(value).isNotNull()).join(F.broadcast(ends)).withColumn("bin", at.cast("int"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    edge = lambda k: F.col("lo") + k * width
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


class CheckFailed(ValueError):
    """Rows break a rule; the message shows a few."""


def check_columns(df: DataFrame, required: tuple[str, ...]) -> None:
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise CheckFailed(f"columns are missing: {', '.join(lacking)}")


def violations(df: DataFrame, key: str, not_null: tuple[str, ...] = (), allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(rule, detail, count) of every broken rule: nulls, values outside an enumeration, repeated keys."""
    rules = [df.filter(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("count")).select(F.lit(f"null {c}").alias("rule"), F.lit("").alias("detail"), "count") for c in not_null]
    for c, values in (allowed or {}).items():
        bad = df.filter(~F.coalesce(F.col(c).isin(*values), F.lit(False)))
        rules.append(bad.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("detail")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(f"invalid {c}").alias("rule"), "detail", "count"))
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    rules.append(repeated.select(F.lit(f"repeated {key}").alias("rule"), F.col(key).cast("string").alias("detail"), "count"))
    out = rules[0]
    for more in rules[1:]:
        out = out.union(more)
    return out.filter("count > 0")


def check(df: DataFrame, key: str, required: tuple[str, ...], not_null: tuple[str, ...] = (), allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``df`` if it keeps all rules; else ``CheckFailed`` with up to ten examples."""
    check_columns(df, required)
    found = violations(df, key, not_null, allowed).orderBy("rule", "detail").limit(10).collect()
    if found:
        raise CheckFailed("; ".join(f"{r['rule']} {r['detail']} ({r['count']})" for r in found))
    return df


def row_split(df: DataFrame, held: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows dealt at random to a larger and a smaller part."""
    kept, out = df.randomSplit([1 - held, held], seed)
    return kept, out


def classification_report(df: DataFrame, said: str, truth: str) -> DataFrame:
    """Accuracy and F1 weighted by the truth's counts, one row; classes are few, rows are counted by pair first."""
    pairs = df.groupBy(F.col(said).alias("p"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    by_said, by_truth = pairs.groupBy("p").agg(F.sum("n").alias("said")), pairs.groupBy("t").agg(F.sum("n").alias("true"))
    hits = pairs.filter(F.col("p").eqNullSafe(F.col("t"))).select(F.col("t").alias("c"), F.col("n").alias("hit"))
    each = by_truth.join(hits, by_truth["t"].eqNullSafe(hits["c"]), "left").join(by_said, by_truth["t"].eqNullSafe(by_said["p"]), "left").fillna(0, ["hit", "said"])
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("said") + F.col("true"))).otherwise(0.0)
    return each.agg((F.sum("hit") / F.sum("true")).alias("accuracy"), (F.sum(f1 * F.col("true")) / F.sum("true")).alias("weighted_f1"))


def hit_rate(df: DataFrame, found: str) -> DataFrame:
    """The share of rows for which ``found`` is not null, such as a cached vector; 0 of nothing."""
    return df.agg(F.coalesce(F.avg(F.col(found).isNotNull().cast("double")), F.lit(0.0)).alias("hit_rate"))
