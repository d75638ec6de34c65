"""Frame and Table: a DataFrame with the verbs of an analyst's table, and a geometry column if it has one.

Everything but the few methods that return plain values stays lazy and distributed. Verbs that depend on the order of rows take
that order from the columns named in order; without any they raise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import geometry as geo
from lodestone.operators import expression, ordered, spatial, table
from lodestone.scratch import checked_broadcast

_TYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean", "date": "date", "datetime": "timestamp"}


def _listed(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


class Table:
    """A DataFrame and the columns that order its rows."""

    def __init__(self, df: DataFrame, order: str | Sequence[str] = (), index: str | None = None):
        self.df, self.order, self.index = df, _listed(order), index

    def _new(self, df: DataFrame, **changed: Any):
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.__dict__.update(df=df, **changed)
        return out

    def _ordering(self, back: bool = False) -> list[Column]:
        if not self.order:
            raise ValueError("name the columns that order the rows")
        return [F.col(c).desc_nulls_first() if back else F.col(c).asc_nulls_last() for c in self.order]

    def _require(self, columns: Sequence[str]) -> None:
        for c in columns:
            if c not in self.df.columns:
                raise KeyError(f"column '{c}' is not present")

    def _values(self) -> list[str]:
        """Columns but the geometry."""
        return [c for c in self.df.columns if c != getattr(self, "geometry", None)]

    def _numeric(self, columns: Sequence[str] | None = None) -> list[str]:
        return list(columns) if columns is not None else [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)]

    # Columns and rows.

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def select_columns(self, columns: Sequence[str]):
        self._require(columns)
        kept = [getattr(self, "geometry", None)] if getattr(self, "geometry", None) not in (None, *columns) else []
        return self._new(self.df.select(*columns, *kept))

    def where(self, predicate: Column | Callable[[dict], bool] | None = None, **equals: Any):
        """Rows whose columns equal the values given (None equals null) and for which predicate holds; a callable gets each row as a dict."""
        df = self.df
        for c, v in equals.items():
            self._require([c])
            df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
        if callable(predicate) and not isinstance(predicate, Column):
            df = df.filter(F.udf(lambda r: bool(predicate(r.asDict(True))), "boolean")(F.struct(*df.columns)))
        elif predicate is not None:
            df = df.filter(predicate)
        return self._new(df)

    def query(self, text: str):
        """Rows for which an expression over columns holds."""
        return self._new(self.df.filter(expression.compile_expression(text, self.df.columns)))

    def eval(self, text: str, name: str = "result"):
        """With the expression's value as a column; what can't be worked out is null."""
        return self._new(self.df.withColumn(name, expression.compile_expression(text, self.df.columns)))

    def mask(self, condition: Column, other: Any = None):
        """With every cell but the geometry's replaced where condition holds."""
        own = set(self._values())
        return self._new(self.df.select(*[F.when(~F.coalesce(condition, F.lit(False)), F.col(c)).otherwise(F.lit(other)).alias(c) if c in own else F.col(c) for c in self.df.columns]))

    def clip_values(self, columns: str | Sequence[str], least: float | None = None, most: float | None = None):
        changed = {}
        for c in _listed(columns):
            v = F.col(c)
            v = v if least is None else F.greatest(v, F.lit(least))
            v = v if most is None else F.least(v, F.lit(most))
            changed[c] = F.when(F.col(c).isNotNull(), v)
        return self._new(self.df.withColumns(changed))

    def isin(self, column: str, values: Sequence[Any]) -> Column:
        found = F.col(column).isin([v for v in values if v is not None])
        return F.coalesce(found, F.lit(None in values)) if None in values else F.coalesce(found, F.lit(False))

    def between(self, column: str, left: Any, right: Any, inclusive: str = "both") -> Column:
        c = F.col(column).try_cast("double")
        low = c >= left if inclusive in ("both", "left") else c > left
        high = c <= right if inclusive in ("both", "right") else c < right
        return low & high

    def isna(self):
        return self._new(self.df.select(*[F.col(c).isNull().alias(c) for c in self.df.columns]))

    def notna(self):
        return self._new(self.df.select(*[F.col(c).isNotNull().alias(c) for c in self.df.columns]))

    def with_column(self, name: str, value: Column | Any):
        return self._new(self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value)))

    def assign(self, **columns: Any):
        """One after the other; a callable gets the table so far and gives a Column."""
        out = self
        for name, value in columns.items():
            out = out.with_column(name, value(out) if callable(value) and not isinstance(value, Column) else value)
        return out

    add_field = with_column

    def rename_columns(self, mapping: dict[str, str]):
        self._require(list(mapping))
        changed = {"order": [mapping.get(c, c) for c in self.order]}
        if getattr(self, "geometry", None) in mapping:
            changed["geometry"] = mapping[self.geometry]
        return self._new(self.df.withColumnsRenamed(mapping), **changed)

    def drop_columns(self, columns: Sequence[str]):
        if getattr(self, "geometry", None) in columns:
            raise ValueError("the geometry column can't be dropped")
        self._require(columns)
        return self._new(self.df.drop(*columns))

    def delete_field(self, *names: str):
        return self.drop_columns(list(names))

    def reorder_columns(self, columns: Sequence[str]):
        self._require(columns)
        return self._new(self.df.select(*columns, *[c for c in self.df.columns if c not in columns]))

    def astype(self, column: str, kind: str):
        """int, float, str, bool, date or datetime; raises at run time on text that isn't one."""
        c = F.col(column)
        if kind == "bool" and isinstance(self.df.schema[column].dataType, T.StringType):
            low = F.lower(F.trim(c))
            return self._new(self.df.withColumn(column, F.when(low.isin("true", "1", "yes", "y", "t"), True).when(low.isin("false", "0", "no", "n", "f"), False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a bool: "), c)).cast("boolean"))))
        return self._new(self.df.withColumn(column, c.cast(_TYPES[kind])))

    def replace(self, column: str, mapping: dict[Any, Any]):
        out = F.col(column)
        for old, new in reversed(mapping.items()):
            out = F.when(F.col(column).eqNullSafe(F.lit(old)), F.lit(new)).otherwise(out)
        return self._new(self.df.withColumn(column, out))

    def map_column(self, column: str, f: Callable[[Column], Column], new_column: str | None = None):
        """f gets the Column and gives a Column; a pandas_udf will do for what SQL can't say."""
        return self._new(self.df.withColumn(new_column or column, f(F.col(column))))

    transform = map_column

    def applymap(self, f: Callable[[Column], Column], columns: Sequence[str] | None = None):
        """f on every column but the geometry, or on those given."""
        return self._new(self.df.withColumns({c: f(F.col(c)) for c in columns or self._values()}))

    map = applymap

    def apply_rows(self, f: Callable[[dict], dict], schema: str):
        """f on every row as a dict, in batches."""

        names = T.StructType.fromDDL(schema).names

        def go(batches):
            import pandas as pd

            for b in batches:
                yield pd.DataFrame([f(r) for r in b.to_dict("records")], columns=names)

        return self._new(self.df.mapInPandas(go, schema))

    def pipe(self, f: Callable, *args: Any, **kwargs: Any) -> Any:
        return f(self, *args, **kwargs)

    def fillna(self, value: Any = None, column: str | None = None, method: str | None = None):
        """With nulls replaced by value, a value for each column, or the row before ("ffill") or after ("bfill") in order."""
        if method:
            return self._new(ordered.filled(self.df, [column] if column else [c for c in self._values() if c not in self.order], self._ordering(method == "bfill")))
        if isinstance(value, dict):
            return self._new(self.df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in value.items()}))
        return self._new(self.df.withColumns({c: F.coalesce(c, F.lit(value)) for c in ([column] if column else self._values())}))

    def dropna(self, subset: Sequence[str] | None = None, how: str = "any"):
        return self._new(self.df.dropna(how, subset=list(subset or self._values())))

    def unique(self, column: str):
        return self._new(self.df.select(column).distinct())

    def set_index(self, column: str):
        self._require([column])
        return self._new(self.df, index=column)

    def reset_index(self, drop: bool = False):
        """With the rows' number in order as index, unless drop."""
        return self._new(self.df if drop else ordered.numbered(self.df, self._ordering(), "index"), index=None)

    def loc(self, key: Any):
        if isinstance(key, Column):
            return self._new(self.df.filter(key))
        return self._new(self.df.filter(F.col(self.index).isin(list(key) if isinstance(key, (list, tuple)) else [key])))

    def iloc(self, at: int) -> dict:
        rows = self._new(self.df.orderBy(*self._ordering()).offset(at) if at >= 0 else self.df.orderBy(*[F.col(c).desc() for c in self.order]).offset(-at - 1)).df.limit(1).collect()
        if not rows:
            raise IndexError(at)
        return rows[0].asDict(True)

    def _paired(self, other: Table) -> DataFrame:
        a = ordered.numbered(self.df, self._ordering()).select("_rn", F.struct(*self.df.columns).alias("a"))
        b = ordered.numbered(other.df, other._ordering()).select("_rn", F.struct(*other.df.columns).alias("b"))
        return a.join(b, "_rn")

    def combine_first(self, other: Table):
        """Row by row in order: own values, or the other's where they are null."""
        names = [*self.df.columns, *[c for c in other.df.columns if c not in self.df.columns]]
        pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, t in (("a", self), ("b", other)) if c in t.df.columns]).alias(c)
        return self._new(self._paired(other).select(*[pick(c) for c in names]))

    def update(self, other: Table, overwrite: bool = True):
        """Row by row in order: the other's values, or only where own ones are null."""
        names = [*self.df.columns, *[c for c in other.df.columns if c not in self.df.columns]]

        def pick(c: str) -> Column:
            if c not in other.df.columns:
                return F.col(f"a.{c}")
            if c not in self.df.columns or overwrite:
                return F.col(f"b.{c}").alias(c)
            return F.coalesce(f"a.{c}", f"b.{c}").alias(c)

        return self._new(self._paired(other).select(*[pick(c) for c in names]))

    def compare(self, other: Table, columns: Sequence[str] | None = None):
        """row, column, self and other of every cell that differs, as text, rows paired in order."""
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("self"), F.col(f"b.{c}").cast("string").alias("other"), (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias("differ")) for c in columns or self._values()])
        return Table(self._paired(other).select(F.col("_rn").alias("row"), F.explode(cells).alias("x")).filter("x.differ").select("row", "x.column", "x.self", "x.other"), ["row", "column"])

    # Sorting, picking, sets.

    def sort_values(self, by: str, descending: bool = False):
        """Nulls last either way; ties by the order columns, the other way round when descending."""
        flip = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
        return self._new(self.df.orderBy(*[flip(c) for c in [by, *[o for o in self.order if o != by]]]))

    def nlargest(self, n: int, columns: str | Sequence[str]):
        by = _listed(columns)
        return self._new(self.df.dropna(subset=by).orderBy(*[F.col(c).desc() for c in by], *[c for c in self.order if c not in by]).limit(max(n, 0)))

    def nsmallest(self, n: int, columns: str | Sequence[str]):
        by = _listed(columns)
        return self._new(self.df.dropna(subset=by).orderBy(*by, *[c for c in self.order if c not in by]).limit(max(n, 0)))

    def head(self, n: int = 5):
        return self._new(self.df.orderBy(*self._ordering()).limit(n))

    def tail(self, n: int = 5):
        return self._new(self.df.orderBy(*[F.col(c).desc_nulls_first() for c in self.order]).limit(n))

    def sample(self, n: int, seed: int = 0):
        """n rows, those of least hash of all columns and seed; reruns agree."""
        return self._new(self.df.withColumn("_h", F.xxhash64(F.lit(seed), *self._values())).orderBy("_h").limit(n).drop("_h"))

    def drop_duplicates(self, subset: Sequence[str] | None = None, keep: str = "first"):
        return self._new(table.drop_duplicates(self.df, list(subset or self._values()), self._ordering(keep == "last")))

    def concat(self, others: Sequence[Table]):
        """Rows of all, columns that one lacks being null."""
        out = self.df
        for o in others:
            out = out.unionByName(o.df, allowMissingColumns=True)
        return self._new(out)

    append_records = concat

    def truncate_records(self):
        return self._new(self.df.limit(0))

    def overwrite_records(self, source: Table):
        return self._new(source.df)

    def find_identical(self, fields: Sequence[str]):
        """Groups of rows (arrays of their numbers in order) that are alike in fields."""
        rows = ordered.numbered(self.df, self._ordering(), "row")
        return Table(rows.groupBy(*fields).agg(F.sort_array(F.collect_list("row")).alias("rows")).filter(F.size("rows") > 1).select(*fields, "rows"))

    def split_by_attribute(self, field: str, path: str) -> None:
        """Writes a folder for each value of field."""
        self.df.write.mode("overwrite").partitionBy(field).parquet(path)

    # Aggregation.

    def groupby(self, by: str | Sequence[str]) -> Grouped:
        names = _listed(by)
        if not names:
            raise ValueError("groupby requires at least one column")
        self._require(names)
        return Grouped(self, names)

    def agg(self, spec: dict[str, str | Sequence[str]]):
        return Table(table.group_agg(self.df, [], {c: _listed(o) for c, o in spec.items()}))

    aggregate = agg

    def summarize(self, by: str, spec: dict[str, str] | None = None):
        return self.groupby(by).agg(spec or {})

    def value_counts(self, column: str, normalize: bool = False, dropna: bool = True):
        counts = (self.df.filter(F.col(column).isNotNull()) if dropna else self.df).groupBy(column).agg(F.count("*").alias("count"))
        total = counts.agg(F.sum("count").alias("_total"))
        out = counts.join(F.broadcast(total)).withColumn("share", F.col("count") / F.col("_total")).drop("_total")
        return Table(out.drop("count") if normalize else out)

    def describe(self, columns: Sequence[str] | None = None):
        """A row for each column: row_count, non_null_count, null_count, unique_count, sum, mean, median, min, max (numbers only)."""
        names = self._numeric(columns)
        one = lambda c: F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("row_count"), F.count(c).alias("non_null_count"), (F.count(F.lit(1)) - F.count(c)).alias("null_count"), F.countDistinct(c).alias("unique_count"),
            F.sum(F.col(c).cast("double")).alias("sum"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        )
        return Table(self.df.agg(F.array(*[one(c) for c in names]).alias("s")).select(F.explode("s").alias("s")).select("s.*"))

    def pivot(self, index: str, columns: str, values: str, agg: str = "sum", names: Sequence[Any] | None = None):
        """names: the values that become columns; found by a job of its own if not given."""
        return Table(table.pivot(self.df, index, columns, list(names), values, agg) if names else self.df.groupBy(index).pivot(columns).agg(table.AGGREGATES[agg](values)))

    def crosstab(self, index: str, columns: str, values: str | None = None, agg: str = "count", names: Sequence[Any] | None = None):
        grouped = self.df.groupBy(index).pivot(columns, list(names)) if names else self.df.groupBy(index).pivot(columns)
        out = grouped.agg(F.count(F.lit(1)) if values is None else table.AGGREGATES[agg](values))
        return Table(out.fillna(0) if agg == "count" else out)

    def unstack(self, index: str, columns: str, values: str, agg: str = "first", names: Sequence[Any] | None = None):
        return self.pivot(index, columns, values, agg, names)

    def nunique(self, columns: Sequence[str] | None = None):
        """column and nunique."""
        return self._long({c: F.countDistinct(c) for c in columns or self._values()}, "nunique")

    def _long(self, found: dict[str, Column], name: str, column: str = "column"):
        return Table(self.df.agg(F.array(*[F.struct(F.lit(k).alias(column), v.alias(name)) for k, v in found.items()]).alias("s")).select(F.explode("s").alias("s")).select("s.*"))

    def mode(self, column: str):
        """The most frequent values."""
        counts = self.df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n").alias("_n"))
        return Table(counts.join(F.broadcast(most), "_n", "left_semi").select(column))

    def _extreme(self, column: str, least: bool) -> int | None:
        rows = ordered.numbered(self.df.filter(F.col(column).isNotNull() | F.lit(True)), self._ordering()).filter(F.col(column).isNotNull())
        found = rows.orderBy(F.col(column) if least else F.col(column).desc(), "_rn").select("_rn").head()
        return None if found is None else found[0]

    def idxmin(self, column: str) -> int | None:
        """Number of the first row in order that holds the least value."""
        return self._extreme(column, True)

    def idxmax(self, column: str) -> int | None:
        return self._extreme(column, False)

    def moments(self, column: str):
        """sem, skew and kurtosis of the population's shape (the sample's standard error); null where there are too few values."""
        c, n = F.col(column).cast("double"), F.count(column)
        return Table(self.df.agg(F.when(n > 1, F.stddev_samp(c) / F.sqrt(n)).alias("sem"), F.when(n > 2, F.skewness(c)).alias("skew"), F.when(n > 3, F.kurtosis(c)).alias("kurtosis")))

    def sem(self, column: str) -> float | None:
        return self.moments(column).df.head()["sem"]

    def skew(self, column: str) -> float | None:
        return self.moments(column).df.head()["skew"]

    def kurtosis(self, column: str) -> float | None:
        return self.moments(column).df.head()["kurtosis"]

    def _pairs(self, columns: Sequence[str] | None, sample: bool, name: str):
        """Of each pair of columns over the rows that hold both; the first one's mean and spread are over all its values."""
        names = self._numeric(columns)
        own = self.df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(names)])
        rows = self.df.select(*[F.col(c).cast("double").alias(f"c_{i}") for i, c in enumerate(names)]).join(F.broadcast(own))
        cells = {}
        for i in range(len(names)):
            for j in range(len(names)):
                a, b = F.col(f"c_{i}"), F.col(f"c_{j}")
                both = a.isNotNull() & b.isNotNull()
                n = F.count(F.when(both, 1))
                mean_b = F.avg(F.when(both, b))
                top = F.sum(F.when(both, (a - F.col(f"m_{i}")) * b)) - F.sum(F.when(both, a - F.col(f"m_{i}"))) * mean_b
                spread = F.first(F.col(f"s_{i}")) * F.stddev_pop(F.when(both, b))
                cells[i, j] = F.when(n > 1, top / (n - 1)) if sample else F.when((n > 0) & (spread != 0), top / n / spread)
        s = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), v.alias(name)) for (i, j), v in cells.items()])
        return Table(rows.agg(s.alias("s")).select(F.explode("s").alias("s")).select("s.*"))

    def corr(self, columns: Sequence[str] | None = None):
        return self._pairs(columns, False, "corr")

    def cov(self, columns: Sequence[str] | None = None):
        return self._pairs(columns, True, "cov")

    def info(self):
        """column, dtype and non_null of each column."""
        kinds = dict(self.df.dtypes)
        counts = self.df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count(c).alias("non_null")) for c in self.df.columns]).alias("s"))
        return Table(counts.select(F.explode("s").alias("s")).select("s.*"))

    list_fields = info

    def memory_usage(self):
        """column and about how many bytes its values take."""
        size = lambda f: F.sum(F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))) if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else F.count(f.name) * 8
        return self._long({f.name: size(f) for f in self.df.schema if f.name in self._values()}, "bytes")

    def summary(self):
        """row_count, column_count, and for each column its nulls and distinct values."""
        return self._long({c: F.struct(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.countDistinct(c).alias("distinct")) for c in self._values()}, "s").flat("s")

    profile = summary

    def flat(self, column: str):
        return self._new(self.df.select(*[c for c in self.df.columns if c != column], f"{column}.*"))

    def get_count(self) -> int:
        return self.df.count()

    def resample(self, freq: str, on: str, spec: dict[str, str | Sequence[str]]):
        """Aggregates by hour, day, week, month or year of a time column."""
        return Table(table.group_agg(self.df.withColumn("period", F.date_trunc(freq, on)), ["period"], {c: _listed(o) for c, o in spec.items()}))

    # Ordered functions.

    def cumsum(self, column: str):
        return self._new(ordered.running(self.df, column, self._ordering(), "sum", f"{column}_cumsum"))

    def cumprod(self, column: str):
        return self._new(ordered.running(self.df, column, self._ordering(), "prod", f"{column}_cumprod"))

    def cummax(self, column: str):
        return self._new(ordered.running(self.df, column, self._ordering(), "max", f"{column}_cummax"))

    def cummin(self, column: str):
        return self._new(ordered.running(self.df, column, self._ordering(), "min", f"{column}_cummin"))

    def expanding(self, column: str, how: str = "mean"):
        return self._new(ordered.running(self.df, column, self._ordering(), how, f"{column}_expanding_{how}"))

    def rolling(self, column: str, size: int, how: str = "mean"):
        return self._new(ordered.rolling(self.df, column, self._ordering(), size, how, f"{column}_rolling_{how}"))

    def diff(self, column: str, periods: int = 1):
        return self._new(ordered.difference(self.df, column, self._ordering(), periods))

    def pct_change(self, column: str, periods: int = 1):
        return self._new(ordered.difference(self.df, column, self._ordering(), periods, True))

    def rank(self, column: str, ascending: bool = True, method: str = "average"):
        return self._new(ordered.ranked(self.df, column, method, ascending))

    # Shapes.

    def melt(self, id_vars: Sequence[str] | None = None, value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value"):
        ids = list(id_vars or [])
        ids += [g] if (g := getattr(self, "geometry", None)) not in (None, *ids) else []
        values = list(value_vars) if value_vars is not None else [c for c in self.df.columns if c not in ids]
        return self._new(self.df.unpivot(ids, values, var_name, value_name), order=[c for c in self.order if c in ids])

    def stack(self, columns: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value"):
        values = list(columns) if columns is not None else self._values()
        return self.melt([c for c in self._values() if c not in values], values, var_name, value_name)

    def wide_to_long(self, stubnames: Sequence[str], i: str | Sequence[str], j: str, sep: str = "_"):
        """A row for each suffix that any stub has."""
        ids = _listed(i) + ([self.geometry] if getattr(self, "geometry", None) else [])
        suffixes = sorted({c[len(s + sep) :] for c in self.df.columns for s in stubnames if c.startswith(s + sep)})
        rows = F.array(*[F.struct(F.lit(x).alias(j), *[(F.col(f"{s}{sep}{x}") if f"{s}{sep}{x}" in self.df.columns else F.lit(None)).alias(s) for s in stubnames]) for x in suffixes])
        return self._new(self.df.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.*"))

    def transpose(self, id_field: str, ids: Sequence[Any]):
        """A row for each other column, with the value that each of the rows of ids holds as text."""
        values = [c for c in self._values() if c != id_field]
        long = self.df.select(id_field, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in values])).alias("x")).select(id_field, "x.*")
        return Table(long.groupBy("field").pivot(id_field, list(ids)).agg(F.first("v")))

    # Joins on keys.

    def merge(self, other: Table, on: str | Sequence[str], how: str = "inner", lsuffix: str = "left", rsuffix: str = "right", indicator: bool = False, validate: str | None = None):
        keys = _listed(on)
        for side, name in ((self, ("one_to_one", "one_to_many")), (other, ("one_to_one", "many_to_one"))):
            if validate in name and side.df.groupBy(*keys).count().filter("count > 1").limit(1).count():
                raise ValueError(f"join validation failed: expected {validate.replace('_', '-')} keys")
        return self._new(table.merge(self.df, other.df, keys, how, (lsuffix, rsuffix), indicator))

    def join(self, other: Table, on: str, how: str = "inner", rsuffix: str = "right", indicator: bool = False, validate: str | None = None):
        """As merge, but only columns of the other side get a suffix."""
        clash = {c: f"{c}_{rsuffix}" for c in other.df.columns if c != on and c in self.df.columns}
        return self.merge(other._new(other.df.withColumnsRenamed(clash)), on, how, indicator=indicator, validate=validate)

    # Text and time.

    def strip(self, column: str, new_column: str | None = None):
        return self.map_column(column, lambda c: F.trim(c, F.lit(" \t\n\r\x0b\x0c")), new_column)

    def upper(self, column: str, new_column: str | None = None):
        return self.map_column(column, F.upper, new_column)

    def lower(self, column: str, new_column: str | None = None):
        return self.map_column(column, F.lower, new_column)

    def title(self, column: str, new_column: str | None = None):
        return self.map_column(column, lambda c: F.initcap(F.lower(c)), new_column)

    def contains(self, column: str, pattern: str, case: bool = True) -> Column:
        return F.contains(F.col(column) if case else F.lower(column), F.lit(pattern if case else pattern.lower()))

    def to_datetime(self, column: str, new_column: str | None = None):
        return self.map_column(column, lambda c: F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c.cast("string"), F.lit("MM/dd/yyyy")), F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd"))), new_column)

    def year(self, column: str, new_column: str | None = None):
        return self.map_column(column, F.year, new_column or f"{column}_year")

    def month(self, column: str, new_column: str | None = None):
        return self.map_column(column, F.month, new_column or f"{column}_month")

    def day(self, column: str, new_column: str | None = None):
        return self.map_column(column, F.dayofmonth, new_column or f"{column}_day")

    def weekday(self, column: str, new_column: str | None = None):
        """Monday is 0."""
        return self.map_column(column, F.weekday, new_column or f"{column}_weekday")

    # Sinks.

    def to_markdown(self, most: int = 1000) -> str:
        """The first rows as text."""
        rows = self.df.limit(most).collect()
        lines = ["| " + " | ".join(self.df.columns) + " |", "|" + " --- |" * len(self.df.columns)]
        return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]])

    def to_html(self, most: int = 1000) -> str:
        return self.df.limit(most).toPandas().to_html(index=False)

    def to_csv(self, path: str) -> None:
        self.df.write.mode("overwrite").option("header", True).csv(path)

    def to_json(self, path: str) -> None:
        self.df.write.mode("overwrite").json(path)

    def to_parquet(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)


class Grouped:
    """A table's rows by columns. func arguments of transform and filter get a window over the group and give a Column."""

    def __init__(self, of: Table, by: list[str]):
        self.of, self.by = of, by

    def _window(self):
        return Window.partitionBy(*self.by)

    def _at(self, reverse: bool = False):
        return self._window().orderBy(*([F.col(c).desc_nulls_first() for c in self.of.order] if reverse else self.of._ordering()))

    def agg(self, spec: dict[str, str | Sequence[str]]):
        """row_count, the first geometry in order if there is one, and column_operation for each."""
        df, found = self.of.df, [F.count(F.lit(1)).alias("row_count")]
        if g := getattr(self.of, "geometry", None):
            found.append(F.min_by(g, F.struct(*self.of.order)).alias(g) if self.of.order else F.first(g).alias(g))
        found += [table.AGGREGATES[op](c).alias(f"{c}_{op}") for c, ops in spec.items() for op in _listed(ops)]
        return self.of._new(df.groupBy(*self.by).agg(*found), order=list(self.by))

    def apply(self, f: Callable, schema: str):
        """f gets each group as a pandas DataFrame; groups have to fit a worker."""
        return self.of._new(self.of.df.groupBy(*self.by).applyInPandas(f, schema))

    def transform(self, column: str, f: Callable[[Column, Any], Column], new_column: str | None = None):
        return self.of._new(self.of.df.withColumn(new_column or column, f(F.col(column), self._window())))

    def filter(self, f: Callable[[Any], Column]):
        return self.of._new(self.of.df.withColumn("_keep", f(self._window())).filter("_keep").drop("_keep"))

    def nth(self, n: int):
        w = self._at(n < 0)
        return self.of._new(self.of.df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == (n + 1 if n >= 0 else -n)).drop("_n"))

    def first(self):
        return self.nth(0)

    def last(self):
        return self.nth(-1)

    def cumcount(self):
        return self.of._new(self.of.df.withColumn("cumcount", F.row_number().over(self._at()) - 1))

    def ngroup(self):
        """Groups are numbered by their first row in order."""
        firsts = self.of.df.groupBy(*self.by).agg(F.min(F.struct(*self.of.order)).alias("_first"))
        numbers = ordered.numbered(firsts, [F.col("_first")], "ngroup").drop("_first").withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(self.by)})
        match = F.lit(True)
        for i, c in enumerate(self.by):
            match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        return self.of._new(self.of.df.join(checked_broadcast(numbers, 64), match).drop(*[f"_k{i}" for i in range(len(self.by))]))


class Frame(Table):
    """A table with a geometry column, as functions.geometry builds it."""

    def __init__(self, df: DataFrame, geometry: str = "geometry", order: str | Sequence[str] = (), index: str | None = None, crs: str | None = None):
        super().__init__(df, order, index)
        self.geometry, self.crs = geometry, crs

    @classmethod
    def from_points(cls, df: DataFrame, x: str, y: str, **kwargs: Any) -> Frame:
        return cls(df.withColumn("geometry", geo.point(F.col(x), F.col(y))), **kwargs)

    @classmethod
    def from_wkt(cls, df: DataFrame, column: str, **kwargs: Any) -> Frame:
        return cls(df.withColumn("geometry", geo.from_wkt(F.col(column))), **kwargs)

    def _g(self) -> Column:
        return F.col(self.geometry)

    def metrics(self) -> Frame:
        """With area, length, type, centroid and bounds of each geometry."""
        g = self._g()
        return self._new(self.df.withColumns({"area": geo.area(g), "length": geo.length(g), "geometry_type": geo.kind(g), "centroid": geo.centroid(g), "bounds": geo.bounds(g)}))

    def bounds(self) -> Table:
        """min_x, min_y, max_x, max_y of all geometries."""
        b = self.df.select(geo.bounds(self._g()).alias("b"))
        return Table(b.agg(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y")))

    def total_bounds(self) -> tuple[float, float, float, float]:
        r = self.bounds().df.head()
        return tuple(0.0 if v is None else v for v in r)

    def centroid(self) -> Table:
        """Mean of the centroids."""
        c = self.df.select(geo.centroid(self._g()).alias("c"))
        return Table(c.agg(F.avg("c.x").alias("x"), F.avg("c.y").alias("y")))

    def query_bounds(self, min_x: float, min_y: float, max_x: float, max_y: float, mode: str = "intersects") -> Frame:
        """By the geometry's bounds: intersects, within or centroid."""
        g, box = self._g(), [F.lit(float(v)) for v in (min_x, min_y, max_x, max_y)]
        test = {"intersects": geo.intersects_bounds(g, *box), "within": geo.within_bounds(g, *box), "centroid": geo.centroid(g)["x"].between(min_x, max_x) & geo.centroid(g)["y"].between(min_y, max_y)}[mode]
        return self._new(self.df.filter(test))

    def query_radius(self, x: float, y: float, radius: float, name: str = "distance") -> Frame:
        """Rows whose centroid lies within radius of a place."""
        c = geo.centroid(self._g())
        return self._new(self.df.withColumn(name, F.sqrt(F.pow(c["x"] - x, 2) + F.pow(c["y"] - y, 2))).filter(F.col(name) <= radius))

    def within_distance(self, x: float, y: float, radius: float) -> Column:
        c = geo.centroid(self._g())
        return F.sqrt(F.pow(c["x"] - x, 2) + F.pow(c["y"] - y, 2)) <= radius

    def explode(self) -> Frame:
        """A row for each part of a geometry."""
        return self._new(self.df.withColumn(self.geometry, F.explode(geo.parts(self._g()))))

    multipart_to_singlepart = explode

    def dissolve_parts(self, by: str) -> Frame:
        """One multi-part geometry for each value of by, of all its rows' parts (singlepart_to_multipart)."""
        g = self._g()
        kind = F.first(F.regexp_replace(g["type"], "^Multi", ""))
        out = self.df.groupBy(by).agg(F.flatten(F.collect_list(g["parts"])).alias("_p"), kind.alias("_t"))
        return self._new(out.select(by, F.struct(F.concat(F.lit("Multi"), "_t").alias("type"), F.col("_p").alias("parts")).alias(self.geometry)), order=[by])

    singlepart_to_multipart = dissolve_parts

    def vertices_to_points(self) -> Frame:
        v = F.explode(geo.vertices(self._g()))
        out = self.df.withColumn("_v", v)
        return self._new(out.withColumn(self.geometry, geo.point(F.col("_v.x"), F.col("_v.y"))).drop("_v"))

    def spatial_join(self, other: Frame, predicate: str = "intersects", how: str = "inner", cell: float | None = None, lsuffix: str = "left", rsuffix: str = "right") -> Frame:
        """Rows of both whose geometries meet the predicate (intersects, within, contains); see operators.spatial.geometry_join."""
        return self._new(spatial.geometry_join(self.df, other.df, self.geometry, other.geometry, predicate, how, cell, lsuffix, rsuffix))
