"""Schema work and missing data: aligning tables, dropping, filling and restoring nulls."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical, or_missing
from tabulith.operators.profile import exact_quantiles, null_count, null_profile

#: Sentinels of exported tables. Inside the library a missing value is always null.
NUMBER_SENTINEL, CATEGORY_SENTINEL = -9999999.0, "empty"


@dataclass(frozen=True)
class TableSpec:
    """Roles of a table's columns. Never changed in place: operators that learn something return a new one."""

    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    log: tuple[str, ...] = ()
    integer: tuple[str, ...] = ()
    mixed: dict[str, tuple[float, ...]] = field(default_factory=dict)
    target: str | None = None


def align(real: DataFrame, syn: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with the same columns in one order, and the names that were dropped or added.

    strict: the same set, else an error; require: real's columns must be in syn; shared: the
    intersection; fill0 and fill_null: real's columns, those that syn lacks filled.
    """
    ours, theirs = set(real.columns), set(syn.columns)
    if mode == "strict" and ours != theirs:
        raise ValueError(f"columns differ: {sorted(ours ^ theirs)}")
    if mode in ("strict", "require") and (lack := ours - theirs):
        raise ValueError(f"missing columns: {sorted(lack)}")
    if mode not in ("strict", "require", "shared", "fill0", "fill_null"):
        raise ValueError(f"unknown mode {mode}")
    names = [c for c in real.columns if mode != "shared" or c in theirs]
    kinds = dict(real.dtypes)
    filler = lambda c: F.lit(0 if mode == "fill0" else None).cast(kinds[c]).alias(c)
    return real.select(*names), syn.select(*(F.col(c) if c in theirs else filler(c) for c in names)), sorted((ours | theirs) - set(names) | (set(names) - theirs))


def target_last(df: DataFrame, target: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != target), target)


def code_to_string(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric codes as categories; 1 and 1.0 are the same one."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: canonical(F.col(c), kinds[c]) for c in columns})


def filter_by_null_count(df: DataFrame, columns: list[str], *, max_null: int | None = None, min_present: int | None = None) -> DataFrame:
    """Rows with at most ``max_null`` missing cells, or at least ``min_present`` others."""
    most = max_null if min_present is None else len(columns) - min_present
    if most is None:
        raise ValueError("give max_null or min_present")
    return df.filter(null_count(df, columns) <= most)


def drop_sparse_columns(df: DataFrame, pct: float, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The table without columns that miss more than ``pct`` percent, and their names."""
    dropped = [r.feature for r in null_profile(df, columns).filter(F.col("pct") > pct).collect()]  # a row for each column
    return df.drop(*dropped), dropped


def clean(df: DataFrame, columns: list[str], *, pct: float, max_null: int, rows_first: bool) -> DataFrame:
    """Both filters; they don't commute, so their order is a choice."""
    if rows_first:
        return drop_sparse_columns(filter_by_null_count(df, columns, max_null=max_null), pct, columns)[0]
    rest, dropped = drop_sparse_columns(df, pct, columns)
    return filter_by_null_count(rest, [c for c in columns if c not in dropped], max_null=max_null)


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that are exactly one space become null."""
    return df.withColumns({c: F.when(F.col(c) == " ", None).otherwise(F.col(c)) for c in columns})


def null_to_sentinel(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, TableSpec]:
    """Sentinels for nulls; the number sentinel is registered once as a point mass in a new spec."""
    out = df.withColumns({c: F.coalesce(c, F.lit(NUMBER_SENTINEL)) for c in spec.numeric} |
                         {c: F.coalesce(c, F.lit(CATEGORY_SENTINEL)) for c in spec.categorical})
    mixed = {c: tuple(dict.fromkeys((*spec.mixed.get(c, ()), NUMBER_SENTINEL))) for c in spec.numeric}
    return out, replace(spec, mixed={**spec.mixed, **mixed})


def sentinel_to_null(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NUMBER_SENTINEL)) for c in spec.numeric} |
                          {c: F.nullif(F.col(c), F.lit(CATEGORY_SENTINEL)) for c in spec.categorical})


def missing_category(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: or_missing(F.col(c)) for c in columns})


def impute_values(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, object]:
    """Medians and most frequent categories (ties: the smaller) of the training rows."""
    medians = exact_quantiles(train, numeric, [0.5]).collect() if numeric else []  # a row for each column
    out: dict[str, object] = {r["feature"]: r["quantiles"][0] if r["quantiles"] else None for r in medians}
    for c in categorical:  # one row comes back
        top = train.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = top[0] if top else None
    return out


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.na.fill({c: v for c, v in values.items() if v is not None})
