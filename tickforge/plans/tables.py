"""Operators whose result is a table or a figure of a whole series rather than a column of it."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tos_stdevall(df: DataFrame, keys: list[str], order: list[str], close: str = "close", length: int | None = None, stds: tuple[int, ...] = (1, 2, 3), ddof: int = 1) -> DataFrame:
    """Each series' least-squares line over all rows (or its last `length`), with bands of its standard deviation. It
    looks ahead: every row sees the whole series. The fit is one aggregate for each series, joined back."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w).cast("double"))
    if length is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("_n") <= length).drop("_n")
    x = F.col(close).cast("double")
    dev = (F.stddev_samp if ddof else F.stddev_pop)(x)
    fit = rows.groupBy(*keys).agg(F.regr_slope(x, F.col("_i")).alias("_m"), F.regr_intercept(x, F.col("_i")).alias("_b"), dev.alias("_d"))
    out = rows.join(fit, keys)
    name = f"TOS_STDEVALL{f'_{length}' if length else ''}"
    line = F.col("_b") + F.col("_m") * F.col("_i")
    cols = {f"{name}_LR": line} | {f"{name}_{side}_{i}": line + sign * i * F.col("_d") for i in stds for side, sign in (("L", -1), ("U", 1))}
    return out.select(*df.columns, *[v.alias(k) for k, v in cols.items()])


def ifisher(df: DataFrame, keys: list[str], column: str, amp: float = 1.0) -> DataFrame:
    """The inverse Fisher transform of a column, INVFISHER: series with values beyond -1 to 1 are first mapped there from
    their least and greatest. It looks ahead then: one aggregate for each series."""
    x = F.col(column).cast("double")
    ends = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    mapped = F.when((F.col("_lo") < -1) | (F.col("_hi") > 1), F.try_divide(2 * (x - F.col("_lo")), F.col("_hi") - F.col("_lo")) - 1).otherwise(x)
    z = F.exp(amp * mapped)
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(ends, on).select(*[F.col(f"`{c}`") for c in df.columns], ((z - 1) / (z + 1)).alias(f"INVFISHER_{float(amp)}"))


def zigzag(
    df: DataFrame, keys: list[str], order: str, high: str = "high", low: str = "low", legs: int = 10, deviation: float = 5.0
) -> DataFrame:
    """Zigzag with hindsight: points stand at their pivots and only final ones are given. It looks ahead: from the last
    pivot back, a pivot is the next point if it turns by more than `deviation` percent, and takes the point's place if
    it goes further the same way. Pivots are native; a series' pivots, not its bars, meet in one task."""
    half = legs // 2
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(around) == 2 * half + 1
    dip, peak = F.col(low) <= F.min(low).over(around), F.col(high) >= F.max(high).over(around)
    # The last bar with a whole window counts as not known yet.
    left = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())) - 1
    pivots = df.withColumns({"_dip": full & dip & (left > half), "_peak": full & peak & (left > half)})
    kinds = F.array(
        F.when(F.col("_dip"), F.struct(F.lit(0).alias("turn"), F.lit(-1.0).alias("swing"), F.col(low).cast("double").alias("value"))),
        F.when(F.col("_peak"), F.struct(F.lit(1).alias("turn"), F.lit(1.0).alias("swing"), F.col(high).cast("double").alias("value"))),
    )
    rows = pivots.filter("_dip or _peak").select(*keys, order, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("p")).select(*keys, order, "p.*")
    tail = f"_{deviation}%_{legs}"
    names = [f"ZIGZAG{k}{tail}" for k in ("s", "v", "d")]

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "turn"], kind="stable").reset_index(drop=True)
        points: list[list] = []  # from the last: row, swing, value, deviation of the point after it
        for at in range(len(pdf) - 1, -1, -1):
            swing, value = float(pdf["swing"][at]), float(pdf["value"][at])
            if not points:
                points.append([at, swing, value, 0.0])
                continue
            if value == 0:
                continue
            last = points[-1]
            if swing == last[1]:
                if len(points) > 1 and (value - last[2]) * swing > 0:
                    last[0], last[2] = at, value
                    points[-2][3] = 100 * swing * (value - points[-2][2]) / value
            else:
                change = swing * (value - last[2]) / value
                if change > deviation / 100 and pdf[order][at] != pdf[order][last[0]]:
                    last[3] = 100 * change
                    points.append([at, swing, value, 0.0])
        out = pdf.loc[[p[0] for p in points], [*keys, order]].reset_index(drop=True)
        for i in range(len(names)):
            out[f"_point_{i}"] = [p[i + 1] for p in points]
        return out.drop_duplicates(order, keep="last").rename(columns={c: f"_at_{c}" for c in (*keys, order)})

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`_at_{c}` {types[c]}" for c in (*keys, order)], *[f"`_point_{i}` double" for i in range(len(names))]])
    found = rows.groupBy(*keys).applyInPandas(back, schema)
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_at_{c}`")) for c in (*keys, order)]
    return df.join(found, on, "left").select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_point_{i}").alias(c) for i, c in enumerate(names)])


def vp(
    df: DataFrame, keys: list[str], order: list[str], close: str = "close", volume: str = "volume", width: int = 10, sort: bool = False
) -> DataFrame:
    """Volume profile: `width` rows for each series, of consecutive rows (as even as can be, the first ones longer) or,
    with sort, of equal price ranges: low, mean and high price, and volume on rising, falling and unchanged closes. The
    total is that of the rising and falling ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x, v = F.col(close).cast("double"), F.col(volume).cast("double")
    whole = Window.partitionBy(*keys)
    rows = df.select(*keys, x.alias("_x"), v.alias("_v"), F.coalesce(F.signum(x - F.lag(x).over(w)), F.lit(1.0)).alias("_s"), (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n"), F.min(x).over(whole).alias("_lo"), F.max(x).over(whole).alias("_hi"))
    if sort:
        bucket = F.least(F.lit(width - 1), F.greatest(F.lit(0), F.ceil(F.try_divide((F.col("_x") - F.col("_lo")) * width, F.col("_hi") - F.col("_lo"))) - 1))
        bucket = F.coalesce(bucket, F.lit(0))
    else:
        size, more = F.floor(F.col("_n") / width), F.col("_n") % width
        long = more * (size + 1)
        bucket = F.when(F.col("_i") < long, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor(F.try_divide(F.col("_i") - long, size)))
    part = lambda s: F.sum(F.when(F.col("_s") == s, F.col("_v")).otherwise(0.0))
    return rows.groupBy(*keys, bucket.cast("int").alias("bucket")).agg(
        F.min("_x").alias(f"low_{close}"), F.avg("_x").alias(f"mean_{close}"), F.max("_x").alias(f"high_{close}"), part(1).alias(f"pos_{volume}"), part(-1).alias(f"neg_{volume}"), part(0).alias(f"neut_{volume}"), (part(1) + part(-1)).alias(f"total_{volume}"),
    )


def ichimoku_forward(df: DataFrame, keys: list[str], order: str, high: str = "high", low: str = "low", tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> DataFrame:
    """The spans of the `kijun` - 1 business days after each series' end, which its last bars project."""
    w = Window.partitionBy(*keys).orderBy(order)
    mid = lambda n: (F.max(high).over(w.rowsBetween(1 - n, 0)) + F.min(low).over(w.rowsBetween(1 - n, 0))) / 2
    full = lambda n: F.count(F.lit(1)).over(w.rowsBetween(1 - n, 0)) == n
    rows = df.withColumns({"_a": F.when(full(kijun), (mid(tenkan) + mid(kijun)) / 2), "_b": F.when(full(senkou), mid(senkou)), "_r": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))})
    last = rows.filter(F.col("_r") < kijun).groupBy(*keys).agg(F.max(order).alias("_end"), F.collect_list(F.struct("_r", "_a", "_b")).alias("_rows"))
    ends = F.to_date("_end")
    days = F.slice(F.filter(F.sequence(F.date_add(ends, 1), F.date_add(ends, 2 * kijun)), lambda d: F.weekday(d) < 5), 1, kijun - 1)
    future = last.select(*keys, F.posexplode(days).alias("_k", "date"), F.sort_array("_rows", asc=False).alias("_rows"))
    item = F.get("_rows", F.col("_k"))
    return future.select(*keys, "date", item["_a"].alias(f"ISA_{tenkan}"), item["_b"].alias(f"ISB_{kijun}"))
