"""Labels, splits and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T
from claimweave.scale import global_rank, lookup_join

FEW_ROWS = 2_000


def _mapped(values: dict[str, float], key: Column) -> Column:
    entries = []
    for k, v in values.items():
        entries += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*entries), key)


def label_score(label: Column | str, dataset: Column | str) -> Column:
    label, dataset = T._col(label), T._col(dataset)
    own = F.when(dataset == "liar", _mapped(fixed.LIAR_LABELS, label))
    return F.coalesce(own, _mapped(fixed.GENERAL_LABELS, label), F.lit(0.5))


def standardize_labels(df: DataFrame) -> DataFrame:
    score = label_score("label", "dataset_source")
    return df.withColumn("fine_grained_label", F.col("label")).withColumn("binary_label", (score >= 0.5).cast("int"))


def class_balance(df: DataFrame, label_col: str = "binary_label") -> DataFrame:
    """Size of the largest class and the minority class (1 on a tie)."""
    counts = df.agg(F.count_if(F.col(label_col) == 0).alias("n0"), F.count_if(F.col(label_col) == 1).alias("n1"))
    minority = F.when(F.col("n0") < F.col("n1"), 0).otherwise(1)
    return counts.select("n0", "n1", F.greatest("n0", "n1").alias("target_count"), minority.alias("minority_class"))


def keyed_digest(seed: int, *cols: Column | str) -> Column:
    """md5 of the seed and the columns: a repeatable random key, the same on every engine."""
    parts = [T._col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def stratified_split(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "binary_label",
    seed: int = 42,
    train: float = 0.7,
    validation: float = 0.15,
) -> DataFrame:
    """Adds ``split``: the stated shares of every label, drawn by digest.

    The position of a row within its label is exact; digests are uniform, so their
    first three hex digits cut a label into 4096 even pieces that are numbered apart.
    """
    keyed = df.withColumn("_digest", keyed_digest(seed, id_col)).withColumn("_bucket", F.substring("_digest", 1, 3))
    out = global_rank(keyed, [label_col], "_bucket", [F.col("_digest"), F.col(id_col)], "_rank", "_size")
    share = F.col("_rank") / F.col("_size")
    split = F.when(share <= train, "train").when(share <= train + validation, "val").otherwise("test")
    return out.withColumn("split", split).drop("_digest", "_bucket", "_rank", "_size")


def augment_minority(
    df: DataFrame, id_col: str = "id", text_col: str = "text", seed: int = 42, share: float = 0.1
) -> DataFrame:
    """Originals plus, for texts of more than ten words, a copy without a tenth of the words."""
    n = F.size("_words")
    drop = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    prepared = df.withColumn("_words", T.words(text_col)).filter(n > 10)
    drawn = F.array_sort(
        F.transform(
            "_words",
            lambda w, i: F.struct(keyed_digest(seed, F.col(id_col), i).alias("k"), i.alias("pos"), w.alias("w")),
        )
    )
    # the kept words are brought back into order; looking positions up per word would be quadratic
    kept = F.array_sort(F.transform(F.slice(drawn, drop + 1, n), lambda s: F.struct(s["pos"], s["w"])))
    copies = prepared.withColumn(text_col, F.array_join(F.transform(kept, lambda s: s["w"]), " "))
    copies = copies.drop("_words").withColumn("augmented", F.lit(True))
    return df.withColumn("augmented", F.lit(False)).unionByName(copies)


def oversample_minority(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "binary_label",
    vector_cols: list[str] | None = None,
    seed: int = 42,
    noise: float = 0.0,
) -> DataFrame:
    """Repeats minority rows, drawn with replacement, up to the size of the other class.

    The class sizes are one row of counts; the draws are a range split over the cluster and
    meet the numbered minority rows in an equi-join.  A minority of few rows, each of which is drawn often, is sent to the draws; of
    a larger one the numbers that are drawn most are spread.
    """
    spark = df.sparkSession
    sizes = class_balance(df, label_col).head()
    minority, n_minority = sizes["minority_class"], sizes[f"n{sizes['minority_class']}"]
    need = sizes["target_count"] - n_minority
    originals = df.withColumns({"copy_no": F.lit(None).cast("long"), "oversampled": F.lit(False)})
    if need <= 0 or n_minority == 0:
        return originals
    rows = df.filter(F.col(label_col) == minority)
    keyed = rows.withColumn("_digest", keyed_digest(seed, id_col)).withColumn("_bucket", F.substring("_digest", 1, 3))
    numbered = global_rank(keyed, [label_col], "_bucket", [F.col("_digest"), F.col(id_col)], "_rank", "_size")
    numbered = numbered.withColumn("_index", F.col("_rank") - 1).drop("_digest", "_bucket", "_rank", "_size")
    drawn = F.conv(F.substring(keyed_digest(seed, F.lit("draw"), F.col("copy_no")), 1, 12), 16, 10).cast("long")
    draws = spark.range(need).withColumnRenamed("id", "copy_no")
    draws = draws.withColumn("_index", F.pmod(drawn, F.lit(n_minority)))
    copies = lookup_join(draws, numbered, ["_index"], small=n_minority <= FEW_ROWS).drop("_index").withColumn("oversampled", F.lit(True))
    for c in vector_cols or []:
        if noise:
            copies = _with_noise(copies, c, noise, seed)
    return originals.unionByName(copies.select(originals.columns))


def _with_noise(df: DataFrame, vector_col: str, sd: float, seed: int) -> DataFrame:
    """Normal noise on every element, from digests so that a retried task repeats it (Box-Muller)."""

    def uniform(tag: str, i: Column) -> Column:
        hexed = F.substring(keyed_digest(seed, F.lit(tag), F.col("copy_no"), i), 1, 12)
        return (F.conv(hexed, 16, 10).cast("double") + 1) / float(16**12 + 1)

    def normal(i: Column) -> Column:
        return F.sqrt(-2 * F.log(uniform("u", i))) * F.cos(2 * 3.141592653589793 * uniform("v", i))

    return df.withColumn(vector_col, F.transform(vector_col, lambda v, i: v.cast("double") + sd * normal(i)))


def label_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first (ties by value); only the first k when asked."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)
