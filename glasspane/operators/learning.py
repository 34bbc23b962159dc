"""Pixel classifiers and clustering of slides."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def gaussian_moments(training: DataFrame, features: list[str], label: str = "label") -> list:
    """Per class: its share, and mean and population variance of each feature (a row a class)."""
    aggregates = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))]
    return training.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggregates).orderBy(label).collect()


def gaussian_bayes(training: DataFrame, features: list[str], label: str = "label", smoothing: float = 1e-9) -> Column:
    """Probability of the second class as a column of the features: the closed form, evaluated where the pixels are."""
    classes = gaussian_moments(training, features, label)
    if len(classes) != 2:
        raise ValueError("two classes are needed")
    n = sum(r["n"] for r in classes)
    whole = training.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    extra = smoothing * max(whole[f] for f in features)
    scores = []
    for r in classes:
        z = F.lit(0.0) + F.log(F.lit(r["n"] / n))
        for f in features:
            v = r[f"v_{f}"] + extra
            z = z - F.lit(0.5) * F.log(F.lit(6.283185307179586 * v)) - (F.col(f) - F.lit(r[f"m_{f}"])) * (F.col(f) - F.lit(r[f"m_{f}"])) / F.lit(2 * v)
        scores.append(z)
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), scores[0] - scores[1])))


def sampled(examples: DataFrame, size: float, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement: a share up to 1, a count above; a negative size takes all."""
    if size < 0:
        return examples
    share = size if size <= 1 else size / max(1, examples.count())
    return examples.sample(withReplacement=True, fraction=share, seed=seed)


def forest(examples: DataFrame, features: list[str], label: str = "label", trees: int = 20, seed: int = 0):
    """A random forest fitted once; its model is shared by all tasks."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(examples)
    return RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed).fit(assembled)


def probability(model, df: DataFrame, features: list[str], name: str = "probability") -> DataFrame:
    """Adds the model's probability of the second class."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    second = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(assembled).withColumn("__p", second).select(*df.columns, F.col("__p").alias(name))


def cohort_clusters(df: DataFrame, key: str, features: list[str], k: int, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """key, embed_x, embed_y, groupid, testind: scaled features, two principal axes, clusters, a test share per group."""
    assembled = VectorAssembler(inputCols=features, outputCol="__raw").transform(df)
    scaled = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(assembled).transform(assembled)
    placed = PCA(k=2, inputCol="__scaled", outputCol="__axes").fit(scaled).transform(scaled)
    grouped = KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="groupid").fit(placed).transform(placed)
    axes = vector_to_array("__axes")
    placed = stored(grouped.select(key, F.get(axes, F.lit(0)).alias("embed_x"), F.get(axes, F.lit(1)).alias("embed_y"), "groupid"))
    return drawn_share(placed, key, "groupid", test_share, seed, "testind")


#: Rows of a group that one task may put in order at the end of a draw.
FEW = 100_000


def drawn_share(df: DataFrame, key: str, group: str, share: float, seed: int = 0, name: str = "drawn") -> DataFrame:
    """df with 1 for round(share * n) rows of each group of n, drawn by hashes of the key, and 0 for the others.

    The last row that is drawn is found by counts: of all first four digits of the hashes, then of the next four
    among those that share the decisive ones, until few rows are left. No group is put in order whole.
    """
    digits, width = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 4
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), digits.alias("h"))
    need = rows.groupBy("g").agg(F.floor(F.count(F.lit(1)) * F.lit(share) + 0.5).cast("long").alias("need")).where("need > 0")
    left = rows.join(need, "g")
    for turn in range(32 // width):
        counts = left.groupBy("g", F.substring("h", turn * width + 1, width).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("d")) - F.col("n"))  # 65,536 rows a group at most
        decisive = stored(before.where("before < need and need <= before + n").select("g", "d", "n", (F.col("need") - F.col("before")).alias("need")))
        left = left.drop("need").join(decisive.drop("n"), "g").where(F.substring("h", turn * width + 1, width) == F.col("d")).drop("d")
        if not (decisive.agg(F.max("n")).first()[0] or 0) > FEW:
            break
    last = left.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "k"))).where("r = need")
    limits = last.select(F.col("g").alias("__g"), F.struct("h", "k").alias("__limit"))
    own = F.struct(digits.alias("h"), F.col(key).alias("k"))
    return df.join(limits, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn(name, F.coalesce((own <= F.col("__limit")).cast("int"), F.lit(0))).drop("__g", "__limit")


def cluster_scores(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """davies_bouldin and calinski_harabasz of a grouping of array-valued points."""
    parts = df.select(key, group, F.posexplode(vector).alias("d", "x"))
    centres = parts.groupBy(group, "d").agg(F.avg("x").alias("m"))
    whole = parts.groupBy("d").agg(F.avg("x").alias("w"))
    spread = parts.join(centres, [group, "d"]).groupBy(key, group).agg(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("q"))
    inner = spread.groupBy(group).agg(F.avg(F.sqrt("q")).alias("s"), F.sum("q").alias("w"), F.count(F.lit(1)).alias("n"))
    a, b = centres.alias("a"), centres.alias("b")
    apart = a.join(b, (F.col("a.d") == F.col("b.d")) & (F.col(f"a.{group}") != F.col(f"b.{group}")))
    distance = apart.groupBy(F.col(f"a.{group}").alias("g"), F.col(f"b.{group}").alias("h")).agg(F.sqrt(F.sum((F.col("a.m") - F.col("b.m")) * (F.col("a.m") - F.col("b.m")))).alias("d"))
    one, two = inner.select(F.col(group).alias("g"), F.col("s").alias("sg")), inner.select(F.col(group).alias("h"), F.col("s").alias("sh"))
    worst = distance.join(one, "g").join(two, "h").groupBy("g").agg(F.max(F.try_divide(F.col("sg") + F.col("sh"), F.col("d"))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    between = centres.join(whole, "d").groupBy(group).agg(F.sum((F.col("m") - F.col("w")) * (F.col("m") - F.col("w"))).alias("b")).join(inner.select(group, "n", F.col("w").alias("inner")), group)
    ch = between.agg(F.try_divide(F.sum(F.col("b") * F.col("n")) / (F.count(F.lit(1)) - 1), F.sum("inner") / (F.sum("n") - F.count(F.lit(1)))).alias("calinski_harabasz"))
    return db.join(ch)  # a row each


def silhouette(df: DataFrame, group: str, vector: str) -> float:
    """Mean silhouette with squared Euclidean distances, by Spark's evaluator."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    return ClusteringEvaluator(predictionCol=group, featuresCol="__v").evaluate(df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))))
