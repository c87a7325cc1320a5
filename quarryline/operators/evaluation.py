"""Classification and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X


def truth_of(record, key: str = "predicted_code", below: str = "_meta"):
    """The true code of a JSON record: its own field if it is there (a null stays one), else the field below ``below``."""
    r = F.col(record) if isinstance(record, str) else record
    own = F.array_contains(F.json_object_keys(r), key)
    return F.when(own, F.get_json_object(r, f"$.{key}")).otherwise(F.get_json_object(r, f"$.{below}.{key}"))


def score_outputs(df: DataFrame, codes: tuple[str, ...], raw_col: str = "raw_output", truth_col: str = "truth") -> DataFrame:
    """``df`` with predicted, status and correct; unparseable outputs are wrong and keep their status."""
    p = X.parse_action(raw_col, codes)
    scored = df.withColumn("__p", p)
    return scored.withColumn("predicted", F.col("__p.code")).withColumn("status", F.col("__p.status")).withColumn("correct", (F.col("status") == "ok") & F.col("predicted").eqNullSafe(F.col(truth_col))).drop("__p")


def classification_report(df: DataFrame, codes: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """code, precision, recall, f1, support over rows with a prediction and a known truth; 0 where undefined."""
    seen = df.filter(F.col(predicted).isNotNull() & F.col(truth).isin(*codes)).groupBy(truth, predicted).count()
    code = df.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    t, p = F.col(truth), F.col(predicted)
    cells = code.join(F.broadcast(seen), (F.col("code") == t) | (F.col("code") == p), "left").groupBy("code").agg(n((t == F.col("code")) & (p == F.col("code"))).alias("tp"), n(t == F.col("code")).alias("support"), n(p == F.col("code")).alias("named"))
    precision, recall = F.coalesce(F.try_divide("tp", "named"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return cells.select("code", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def confusion_matrix(df: DataFrame, codes: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(truth).pivot(predicted, codes).count().na.fill(0, codes)


def top_confusions(df: DataFrame, truth: str, predicted: str, n: int = 10) -> DataFrame:
    return df.filter(~F.col(truth).eqNullSafe(F.col(predicted))).groupBy(truth, predicted).count().orderBy(F.desc("count"), truth, predicted).limit(n)


def correctness(df: DataFrame, by: str, correct: str = "correct") -> DataFrame:
    """Share of correct rows for each value of ``by`` (level ``group``) and in all (level ``total``, value null)."""
    level = F.when(F.grouping(by) == 1, "total").otherwise("group").alias("level")
    return df.groupingSets([[by], []], by).agg(level, F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col(correct).cast("int")), F.lit(0.0)), 6).alias("accuracy"))


def token_f1(a: str, b: str):
    """Share of common distinct words of two text columns (F1): the offline judge."""
    words = lambda c: F.array_distinct(F.filter(F.split(X.squeeze(c), " "), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double")), F.lit(0.0))


def coverage(df: DataFrame, key: str, value: str, expected: int) -> DataFrame:
    """Sorted distinct values of each key and whether there are as many as expected."""
    vals = F.sort_array(F.collect_set(value))
    return df.groupBy(key).agg(F.array_join(vals, ",").alias("vals"), (F.size(vals) != expected).alias("flagged"))


def crosstab(df: DataFrame, row: str, col: str, cols: list[str], pos: str) -> DataFrame:
    """Counts by row and column, rows in order of first appearance (``first_pos``)."""
    return df.groupBy(row).agg(F.min(pos).alias("first_pos"), *(F.count_if(F.col(col) == c).alias(c) for c in cols))
