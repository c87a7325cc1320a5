"""Training sets: deduplication, overrides, stratified splits and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X

SPLITS = ("train", "val", "test")


def _free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    while stem in held:
        stem += "_"
    return stem


def keep_first(df: DataFrame, by: list[str], text_col: str, order: str) -> DataFrame:
    """The first row of each (by, normalised text); the text itself stays as it was.

    Nulls in ``by`` are a group of their own and a null text is empty.  Of rows with equal
    ``order`` the one of least row hash stays, of wholly equal rows one; a null order comes first.  A row
    for each key is carried by an aggregation, which combines before the shuffle, so that one very frequent
    text is no hot partition.
    """
    key = _free(df, "text_key")
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = df.withColumn(key, F.md5(X.squeeze(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))
    first = F.min_by(F.struct(*df.columns), F.struct(F.col(order).alias("a"), F.xxhash64(*plain).alias("b"))).alias("row")
    return keyed.groupBy(*(F.col(c).alias(f"by_{i}") for i, c in enumerate(by)), key).agg(first).select("row.*")


def stable_order(key: Column | str, seed: int = 42) -> Column:
    """A reproducible shuffle: rows sort by the hash of seed and key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def stratified_split(df: DataFrame, stratum: str, key: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first int(n * train) rows of each stratum in hash order, then int(n * val), the rest.

    Positions come from counts of hash prefixes: rows are counted in 4096
    ranges of the hash for each stratum, and a window inside a (stratum, range)
    adds to the running count of the ranges before, so that one large stratum
    spreads over as many tasks as it has ranges.
    """
    h = df.withColumn("__h", stable_order(key, seed)).withColumn("__r", F.substring("__h", 1, 3))
    sizes = h.groupBy(stratum, "__r").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(stratum)
    before = w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(stratum).alias("__s"), F.col("__r").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__total"))
    joined = h.join(sizes, h[stratum].eqNullSafe(sizes["__s"]) & (h["__r"] == sizes["__q"])).drop("__s", "__q")
    place = F.col("__before") + F.row_number().over(Window.partitionBy(stratum, "__r").orderBy("__h", key))
    n = F.col("__total")
    n_train, n_val = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    split = F.when(place <= n_train, "train").when(place <= n_train + n_val, "val").otherwise("test")
    return joined.withColumn("split", split).drop("__h", "__r", "__before", "__total")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """ceil(n / strata) rows of each stratum in hash order, then the first n of all; a sampling operator."""
    strata = max(df.select(stratum).distinct().count(), 1)
    each = -(-n // strata)
    picked = df.withColumn("__h", stable_order(key, seed))
    w = Window.partitionBy(stratum).orderBy("__h", key)
    return picked.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= each).orderBy("__h", key).limit(n).drop("__h", "__n")


def apply_overrides(labels: DataFrame, overrides: DataFrame, text_col: str = "query", code_col: str = "predicted_code", new_col: str = "new_code") -> DataFrame:
    """Rewrite the code where the normalised text has an override (norm, new_code) and differs from it.

    Of several overrides of one text the least code holds, so that no label is repeated.  Overrides are written by hand;
    Spark broadcasts them as long as they are small, and splits frequent texts otherwise.
    """
    norm = _free(labels, "norm")
    one = overrides.groupBy(F.col("norm").alias(norm)).agg(F.min(new_col).alias(_free(labels, new_col)))
    new = F.col(_free(labels, new_col))
    joined = labels.withColumn(norm, X.squeeze(text_col)).join(one, norm, "left")
    changed = new.isNotNull() & ~new.eqNullSafe(F.col(code_col))
    return joined.select(*(F.coalesce(F.when(changed, new), F.col(c)).alias(c) if c == code_col else F.col(c) for c in labels.columns), changed.alias("override_applied"))


def unmatched_overrides(labels: DataFrame, overrides: DataFrame, text_col: str = "query") -> DataFrame:
    return overrides.join(labels.select(X.squeeze(text_col).alias("norm")).distinct(), "norm", "left_anti")


def split_gates(rows: DataFrame, total: int, codes: list[str], stratum: str, text_col: str, targets: tuple[float, ...] = (0.70, 0.15, 0.15), tolerance: float = 0.05, least: int = 2) -> DataFrame:
    """One row for each gate (check, issues); zero issues pass.

    preserved: rows lost or gained; leakage: texts that occur twice, in one
    split or across; stratification: shares further than ``tolerance`` from the
    target (empty codes are skipped); min_per_class: (code, split) below ``least``.
    """
    spark = rows.sparkSession
    preserved = rows.agg(F.abs(F.count("*") - total).alias("issues")).select(F.lit("preserved").alias("check"), "issues")
    leak = rows.groupBy(text_col).count().filter("count > 1").agg(F.count("*").alias("issues")).select(F.lit("leakage").alias("check"), "issues")
    per = rows.groupBy(stratum, "split").count()
    grid = spark.createDataFrame([(c, s, t) for c in codes for s, t in zip(SPLITS, targets, strict=True)], f"{stratum} string, split string, target double")
    full = grid.join(per, [stratum, "split"], "left").withColumn("n", F.coalesce("count", F.lit(0)))
    shares = full.withColumn("all", F.sum("n").over(Window.partitionBy(stratum))).filter("all > 0").withColumn("off", F.abs(F.col("n") / F.col("all") - F.col("target")) > tolerance)
    strat = shares.agg(F.count_if("off").alias("issues")).select(F.lit("stratification").alias("check"), "issues")
    small = full.agg(F.count_if(F.col("n") < least).alias("issues")).select(F.lit("min_per_class").alias("check"), "issues")
    return preserved.unionAll(leak).unionAll(strat).unionAll(small)


def write_if_clean(rows: DataFrame, gates: DataFrame, path: str) -> None:
    """Write the splits, or refuse with the failing gates."""
    failed = gates.filter("issues > 0").collect()  # four rows at most
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['issues']}" for r in failed))
    rows.write.mode("overwrite").partitionBy("split").json(path)


def instruction_record(df: DataFrame, instruction: str, text_col: str = "query", *more: str) -> DataFrame:
    """instruction, input, output (JSON string) and _meta of labelled rows, and the columns ``more``."""
    out = F.to_json(F.struct(F.col("predicted_code").alias("action_code"), F.try_parse_json("params").alias("params"), "reasoning"))
    return df.select(F.lit(instruction).alias("instruction"), F.col(text_col).alias("input"), out.alias("output"), F.struct("intended_code", "predicted_code", "agrees").alias("_meta"), *more)


def sft_messages(df: DataFrame) -> DataFrame:
    """messages: system, user and assistant turns of instruction records."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return df.select(F.array(turn("system", F.col("instruction")), turn("user", F.col("input")), turn("assistant", F.col("output"))).alias("messages"))


def duplicate_rates(df: DataFrame, by: str, text_col: str) -> DataFrame:
    """Rows, distinct normalised texts and duplicate rate for each group (level ``group``) and in all (level ``total``, group null)."""
    per = df.select(by, F.md5(X.squeeze(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")).alias("k")).groupBy(by, "k").agg(F.count("*").alias("c"))
    rate = F.round(1 - F.col("n_unique") / F.col("n_rows"), 6).alias("dup_rate")
    groups = per.groupBy(by).agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_unique")).select(by, F.lit("group").alias("level"), "n_rows", "n_unique", rate)
    total = groups.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_unique").alias("n_unique"))
    return groups.unionByName(total.select(F.lit(None).cast(df.schema[by].dataType).alias(by), F.lit("total").alias("level"), "n_rows", "n_unique", rate))


def quarantine(df: DataFrame, codes: tuple[str, ...], code_col: str = "predicted_code") -> tuple[DataFrame, DataFrame]:
    """(rows with a code of the taxonomy, the others): parse failures must not become a stratum of their own."""
    ok = F.coalesce(F.col(code_col).isin(*codes), F.lit(False))
    return df.filter(ok), df.filter(~ok)
