"""Whole rows as one sparse vector each, with a layout, and back.

A column becomes a block of entries, in one of four kinds. ``mode``: a value within a mode of its mixture, and which mode. ``mixed``:
the same with slots for point masses before those of the modes. ``general``: the value by its range, in [-1, 1]. ``category``: a slot
for each category. Modes are few and stand in the plan as literals, so a table is encoded in one compiled stage; categories may be many
and are joined from their dictionary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical, or_missing, uniform
from tabulith.operators.encode import category_slots, join_dictionary, mixed_fit, mode_fit, range_invert, range_scale

#: (weight, mean, std) of a mode.
Mode = tuple[float, float, float]


@dataclass(frozen=True)
class Block:
    """How one column is encoded. A mixed column scales its point masses by the nearest mode of ``whole``, the mixture over all its values."""

    column: str
    kind: str
    modes: tuple[Mode, ...] = ()
    points: tuple[float, ...] = ()
    whole: tuple[Mode, ...] = ()
    lo: float = 0.0
    hi: float = 0.0
    categories: int = 0

    @property
    def width(self) -> int:
        return {"general": 1, "category": self.categories}.get(self.kind, 1 + len(self.points) + len(self.modes))


@dataclass(frozen=True)
class RowEncoder:
    """Blocks in the order of their entries, and the dictionary (feature, category, slot) of the categorical columns."""

    blocks: tuple[Block, ...]
    slots: DataFrame | None = field(default=None)

    @property
    def starts(self) -> dict[str, int]:
        out, at = {}, 0
        for b in self.blocks:
            out[b.column] = at
            at += b.width
        return out

    @property
    def size(self) -> int:
        return sum(b.width for b in self.blocks)

    def layout(self, spark: SparkSession) -> DataFrame:
        """(column, role, start, width, kind): the parts of the vector. A value is 'tanh' (in [-1, 1]), one-hot slots are 'softmax'."""
        rows = []
        for b in self.blocks:
            at = self.starts[b.column]
            if b.kind != "category":
                rows.append((b.column, "value", at, 1, "tanh"))
            if b.kind != "general":
                rows.append((b.column, b.kind, at + (b.kind != "category"), b.width - (b.kind != "category"), "softmax"))
        return spark.createDataFrame(rows, "column string, role string, start int, width int, kind string")


def fit_rows(df: DataFrame, *, modes: list[str], mixed: dict[str, tuple[float, ...]], general: list[str], categorical: list[str], k: int = 10) -> RowEncoder:
    """An encoder fitted on ``df``: mixtures of ``modes`` and of ``mixed`` without their point masses, ranges, and categories by frequency."""
    of: dict[tuple[str, str], list] = {}
    numeric = [*modes, *mixed]
    for name, fitted in (("all", mode_fit(df, numeric, k=k) if numeric else None), ("rest", mixed_fit(df, mixed, k=k) if mixed else None)):
        for r in fitted.orderBy("feature", "mode").collect() if fitted is not None else []:  # k rows a column
            of.setdefault((name, r.feature), []).append((r.weight, r["mean"], r.std))
    get = lambda name, c: tuple(of.get((name, c), ()))
    ranges = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(general) for n, f in (("lo", F.min), ("hi", F.max)))).first() if general else {}
    slots = category_slots(df, categorical) if categorical else None
    sizes = {r.feature: r["count"] for r in slots.groupBy("feature").count().collect()} if categorical else {}  # a row for each column
    return RowEncoder((*(Block(c, "mode", get("all", c)) for c in modes), *(Block(c, "mixed", get("rest", c), tuple(map(float, p)), get("all", c)) for c, p in mixed.items()),
                       *(Block(c, "general", lo=ranges[f"lo{i}"] or 0.0, hi=ranges[f"hi{i}"] or 0.0) for i, c in enumerate(general)),
                       *(Block(c, "category", categories=sizes.get(c, 0)) for c in categorical)), slots)


def _clip(u: Column) -> Column:
    return F.greatest(F.lit(-0.99), F.least(F.lit(0.99), u))


def _between(first: int, end: int) -> Callable[[Column], Column]:
    return lambda x: (x >= first) & (x < end)


def _by_slot(slot: Column, values: list[float]) -> Column:
    out = F.lit(None).cast("double")
    for i, v in enumerate(values):
        out = F.when(slot == i, F.lit(float(v))).otherwise(out)
    return out


def _mode_entries(df: DataFrame, b: Block, i: int, key: str, seed: int) -> DataFrame:
    """Adds ``_s{i}``, the slot, and ``_u{i}``, the value within it; both null for a null value, or one without modes.

    A mode is drawn by its responsibility plus 1e-6, by a hash of key and column.
    """
    x, k = F.col(f"_x{i}"), len(b.modes)
    slot = u = F.lit(None)
    if k:
        df = df.withColumns({f"_d{j}": F.lit(w / sd) * F.exp(-0.5 * F.pow((x - mu) / sd, F.lit(2))) for j, (w, mu, sd) in enumerate(b.modes)})
        df = df.withColumn("_all", sum((F.col(f"_d{j}") for j in range(k)), F.lit(0.0)))
        df = df.withColumns({f"_d{j}": F.when(F.col("_all") > 0, F.col(f"_d{j}") / F.col("_all")).otherwise(0.0) + 1e-6 for j in range(k)})
        df = df.withColumns({"_all": sum((F.col(f"_d{j}") for j in range(k)), F.lit(0.0)), "_draw": uniform(seed, F.concat_ws("|", F.col(key), F.lit(b.column)))})
        passed, upto = F.lit(0), F.lit(0.0)
        for j in range(k):
            upto = upto + F.col(f"_d{j}")
            passed = passed + (upto <= F.col("_draw") * F.col("_all")).cast("int")
        df = df.withColumn("_m", F.least(passed, F.lit(k - 1))).drop(*(f"_d{j}" for j in range(k)), "_all", "_draw")
        slot, u = F.col("_m") + len(b.points), _clip((x - _by_slot(F.col("_m"), [m[1] for m in b.modes])) / (4 * _by_slot(F.col("_m"), [m[2] for m in b.modes])))
    for j, p in reversed(list(enumerate(b.points))):
        near = min(b.whole, key=lambda m: abs(p - m[1]), default=None)
        at = max(-0.99, min(0.99, (p - near[1]) / (4 * near[2]))) if near else 0.0
        slot, u = F.when(x == p, j).otherwise(slot), F.when(x == p, F.lit(at)).otherwise(u)
    return df.withColumns({f"_s{i}": F.when(x.isNotNull(), slot).cast("int"), f"_u{i}": F.when(x.isNotNull(), u).cast("double")}).drop("_m")


def encode_rows(df: DataFrame, encoder: RowEncoder, *, key: str = "row_key", seed: int = 0) -> DataFrame:
    """(key, size, indices, values): each row as a sparse vector. Nulls in numbers and unknown categories have no entries; a null category is a category."""
    kinds, entries, starts = dict(df.dtypes), [], encoder.starts
    text = lambda c: or_missing(canonical(F.col(c), kinds[c]))
    out = df.select(key, *((text(b.column) if b.kind == "category" else F.col(b.column).cast("double")).alias(f"_x{i}") for i, b in enumerate(encoder.blocks)))
    entry = lambda at, v: F.struct(at.cast("int").alias("i"), v.cast("double").alias("v"))
    for i, b in enumerate(encoder.blocks):
        at = starts[b.column]
        if b.kind == "category":
            own = encoder.slots.filter(F.col("feature") == b.column).select(F.col("category").alias(f"_x{i}"), F.col("slot").alias(f"_s{i}"))
            out = join_dictionary(out, own, [f"_x{i}"], f"_s{i}", b.categories)
            entries.append(entry(F.col(f"_s{i}") + at, F.lit(1.0)))
        elif b.kind == "general":
            entries.append(entry(F.when(F.col(f"_x{i}").isNotNull(), at), range_scale(F.col(f"_x{i}"), F.lit(b.lo), F.lit(b.hi))))
        else:
            out = _mode_entries(out, b, i, key, seed)
            entries += [entry(F.when(F.col(f"_s{i}").isNotNull(), at), F.col(f"_u{i}")), entry(F.col(f"_s{i}") + (at + 1), F.lit(1.0))]
    out = out.select(key, F.filter(F.array(*entries), lambda e: e["i"].isNotNull()).alias("e"))
    return out.select(key, F.lit(encoder.size).alias("size"), F.col("e.i").alias("indices"), F.col("e.v").alias("values"))


def decode_rows(encoded: DataFrame, encoder: RowEncoder, *, key: str = "row_key") -> DataFrame:
    """The key and the columns again: point masses and categories as they were, other numbers up to clipping and rounding. Blocks without entries are null."""
    starts = encoder.starts
    out = encoded.select(key, "indices", F.map_from_arrays("indices", "values").alias("m"))
    columns = []
    for i, b in enumerate(encoder.blocks):
        at = starts[b.column]
        first = at if b.kind == "category" else at + 1
        slot = F.get(F.filter("indices", _between(first, at + b.width)), F.lit(0)) - first
        u = F.try_element_at("m", F.lit(at))
        if b.kind == "category":
            own = encoder.slots.filter(F.col("feature") == b.column).select(F.col("slot").alias(f"_s{i}"), F.col("category").alias(f"_c{i}"))
            out = join_dictionary(out.withColumn(f"_s{i}", slot), own, [f"_s{i}"], f"_s{i}", b.categories)
            columns.append(F.col(f"_c{i}").alias(b.column))
        elif b.kind == "general":
            columns.append(range_invert(u, F.lit(b.lo), F.lit(b.hi)).alias(b.column))
        else:
            out = out.withColumn(f"_s{i}", slot)
            mode, s = F.col(f"_s{i}") - len(b.points), F.col(f"_s{i}")
            value = u * 4 * _by_slot(mode, [m[2] for m in b.modes]) + _by_slot(mode, [m[1] for m in b.modes])
            columns.append(F.coalesce(_by_slot(s, list(b.points)), value).alias(b.column))
    return out.select(key, *columns)
