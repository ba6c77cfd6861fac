"""Features of search hits and functions that derive them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the mass of a proton in dalton.
PROTON = 1.00727646677


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def insert_modifications(peptide: Column, modifications: Column) -> Column:
    """A peptide with [mass] behind each modified residue; modifications: an array of (position from 1, mass text) in any order."""
    ordered = F.array_sort(modifications, lambda a, b: F.when(a["position"] > b["position"], -1).when(a["position"] < b["position"], 1).otherwise(0))
    return F.aggregate(
        ordered, peptide, lambda p, m: F.concat(F.substring(p, F.lit(1), m["position"]), F.lit("["), m["mass"], F.lit("]"), F.substring(p, m["position"] + 1, F.length(p)))
    )


def open_modification_bin(delta: Column, low: Column | float, size: float) -> Column:
    """The centre, rounded to 4 places, of a mass difference's bin of the given size from ``low`` on."""
    low = F.lit(low) if isinstance(low, (int, float)) else low
    return F.round(low + (F.floor((delta - low) / size) + 0.5) * size, 4)


def with_open_modifications(df: DataFrame, peptide: str, delta: str, size: float) -> DataFrame:
    """df with the bin of the mass difference appended to the peptide, which makes variants distinct peptides."""
    low = df.agg(F.min(delta).alias("_low")).withColumn("_all", F.lit(0))
    joined = df.withColumn("_all", F.lit(0)).join(F.broadcast(low), "_all")
    bin_text = F.concat(F.lit("["), F.format_string("%.4f", open_modification_bin(F.col(delta), F.col("_low"), size)), F.lit("]"))
    return joined.withColumn(peptide, F.concat(F.col(peptide), F.coalesce(bin_text, F.lit("")))).drop("_low", "_all")


def mz_error(expmass: Column, calcmass: Column, charge: Column) -> Column:
    """Absolute difference of the mass-to-charge ratios; null without a charge."""
    return F.abs((F.try_divide(expmass, charge) + PROTON) - (F.try_divide(calcmass, charge) + PROTON))


def log_candidates(n: Column) -> Column:
    return F.when(n > 0, F.log10(n))


#: Values of a column that become columns of their own.
MOST_VALUES = 1_000


def one_hot(df: DataFrame, column: str, prefix: str, values: list | None = None) -> DataFrame:
    """df with a 0/1 column for each value; the values are found unless given. ValueError if there are more than MOST_VALUES."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_VALUES + 1).collect())
        if len(values) > MOST_VALUES:
            raise ValueError(f"{column} has more than {MOST_VALUES} values; give those that are to be columns")
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values])


def any_target(proteins: Column, decoy_prefix: str) -> Column:
    """Whether any protein of an array lacks the decoy prefix; false for none."""
    return F.coalesce(F.exists(proteins, lambda p: ~p.startswith(decoy_prefix)), F.lit(False))


def log_of_text(v: Column) -> Column:
    """log10 of a number written in scientific notation, also where it is too small or too large for a double; null if it isn't above zero."""
    root = F.substring_index(F.lower(v), "e", 1).try_cast("double")
    power = F.when(F.contains(F.lower(v), F.lit("e")), F.substring_index(F.lower(v), "e", -1).try_cast("double")).otherwise(0.0)
    return F.when(root > 0, F.log10(root) + power)


def auto_log(df: DataFrame, features: list[str], span: float = 1e4) -> DataFrame:
    """df with log10 of each non-negative feature whose greatest value is at least ``span`` times its least positive one.

    Zeros become the least logarithm minus 1. Features with negative values or of only 0 and 1 stay. Features that are still text are
    compared by their logarithms, so that values too small for a double count too, and become numbers either way. One pass of statistics.
    """
    texts = [f for f in features if df.schema[f].dataType.simpleString() == "string"]
    if texts:
        logs = {f: log_of_text(F.col(f)) for f in texts}
        facts = df.agg(*[x for f in texts for x in (F.min(logs[f]).alias(f"lo_{f}"), F.max(logs[f]).alias(f"hi_{f}"), F.coalesce(F.bool_or(F.ltrim(F.col(f)).startswith("-")), F.lit(False)).alias(f"neg_{f}"))]).first()
        wide = {f: facts[f"lo_{f}"] is not None and not facts[f"neg_{f}"] and facts[f"hi_{f}"] - facts[f"lo_{f}"] >= math.log10(span) for f in texts}
        value = lambda f: F.when(F.col(f).isNotNull(), F.coalesce(logs[f], F.lit(facts[f"lo_{f}"] - 1))) if wide[f] else F.col(f).try_cast("double")
        df, features = df.withColumns({f: value(f) for f in texts}), [f for f in features if f not in texts]
    if not features:
        return df
    stats = df.agg(*[x for f in features for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"), F.min(F.when(F.col(f) > 0, F.col(f))).alias(f"pos_{f}"))]).first()
    out = {}
    for f in features:
        lo, hi, pos = (stats[f"{p}_{f}"] for p in ("lo", "hi", "pos"))
        if lo is not None and pos is not None and lo >= 0 and hi / pos >= span:
            least = F.log10(F.lit(float(pos)))
            out[f] = F.when(F.col(f) > 0, F.log10(F.col(f).cast("double"))).when(F.col(f) == 0, least - 1)
    return df.withColumns(out) if out else df


def nan_features(df: DataFrame, features: list[str]) -> list[str]:
    """The features with a null or NaN anywhere, by one aggregate."""
    if not features:
        return []
    wrong = lambda f: F.col(f"`{f}`").isNull() | (F.isnan(F.col(f"`{f}`")) if df.schema[f].dataType.simpleString() in ("float", "double") else F.lit(False))
    row = df.agg(*[F.coalesce(F.bool_or(wrong(f)), F.lit(False)).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if row[f"c{i}"]]


def zscore(df: DataFrame, features: list[str]) -> DataFrame:
    """df with each feature minus its mean over its population standard deviation (over 1 if that is 0)."""
    row = df.agg(*[x for i, f in enumerate(features) for x in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}"))]).first()
    return df.withColumns({f: (F.col(f) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, f in enumerate(features)})
