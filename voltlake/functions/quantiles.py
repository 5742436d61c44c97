"""Exact quantiles of columns with any number of distinct values.

``percentile`` keeps every distinct value of the column in the state of one task.
Here a rank is found by counting, the same way for all data:

* :func:`quantiles` selects by radix. A value becomes a whole number of 64 bits in the same order: integers are
  one, a DOUBLE has its exponent and mantissa in the order of its bits. Four steps of 16 bits
  each count, among the values whose bits so far are those of the wanted rank, the next 16 bits, and go on with
  those that hold the rank. A step is one aggregate with map-side combine, and no more than 65,536 rows
  for each rank leave it, however the values are spread. Nothing is estimated, and no integer is rounded.
* :func:`integer_quantiles`, for 32-bit columns such as minutes, counts by value
  and sums the counts in two steps of at most 65,536 rows each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits that each step looks at; they end at these places of the 64.
DIGIT = 16
PLACES = (48, 32, 16, 0)

_MANTISSA = 1 << 52


def _whole(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return kind.scale == 0 and kind.precision <= 19
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def images(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``x0``, ``x1``, ...: each column as BIGINT in the order of its values; NULL and NaN are NULL.

    A DOUBLE is its exponent and mantissa as one number, negative values the negative one. The logarithm
    only guesses the exponent; comparing with both powers of two around corrects it.
    """
    # In the order of df, so that this reader and others of df share its shuffles.
    rows = df.select(*[c for c in df.columns if c in columns])
    inner = [c for c in columns if not _whole(df, c)]
    at = {c: columns.index(c) for c in columns}
    number = "nullif(CAST({0} AS DOUBLE), double('NaN'))"
    rows = rows.select("*", *[F.expr(number.format(c)).alias(f"_d{at[c]}") for c in inner])
    guess = "CAST(greatest(least(floor(log2(abs(_d{0}))), 1023D), -1022D) AS INT)"
    finite = "CASE WHEN abs(_d{0}) > 0 AND abs(_d{0}) < double('Infinity') THEN {1} END"
    rows = rows.select("*", *[F.expr(finite.format(at[c], guess.format(at[c]))).alias(f"_g{at[c]}") for c in inner])
    right = (
        "CASE WHEN _g{0} > -1022 AND abs(_d{0}) < pow(2D, _g{0}) THEN _g{0} - 1 "
        "WHEN _g{0} < 1023 AND abs(_d{0}) >= pow(2D, _g{0} + 1) THEN _g{0} + 1 ELSE _g{0} END"
    )
    rows = rows.select("*", *[F.expr(right.format(at[c])).alias(f"_e{at[c]}") for c in inner])
    bits = (
        f"CAST(signum(_d{{0}}) AS BIGINT) * CASE WHEN _d{{0}} = 0 THEN 0 WHEN _e{{0}} IS NULL THEN 2047 * {_MANTISSA} "
        f"ELSE (_e{{0}} + 1022) * {_MANTISSA} + CAST(abs(_d{{0}}) / pow(2D, _e{{0}}) * {_MANTISSA}D AS BIGINT) END"
    )
    return rows.select(*[
        (F.expr(bits.format(k)) if c in inner else F.col(c).cast("long")).alias(f"x{k}") for c, k in at.items()
    ])


def value_sql(x: str) -> str:
    """The DOUBLE whose image is the SQL expression ``x``."""
    exponent, mantissa = f"shiftright(abs({x}), 52)", f"(abs({x}) & {_MANTISSA - 1})"
    return (
        f"signum({x}) * CASE WHEN {exponent} = 2047 THEN double('Infinity') "
        f"WHEN {exponent} = 0 THEN {mantissa} * pow(2D, -1074) "
        f"ELSE (1D + {mantissa} / {float(_MANTISSA)}D) * pow(2D, {exponent} - 1023) END"
    )


def _upto(counts: DataFrame, key: str) -> DataFrame:
    """Counts with their running sum; one task sees them, 65,536 rows at most for each key."""
    ordered = Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return counts.repartition(1).withColumn("upto", F.sum("n").over(ordered))


def _gathered(rows: DataFrame, conditions: Sequence[str], fields: str) -> Column:
    """One struct per target as an array, as a scalar subquery."""
    each = ", ".join(f"max(CASE WHEN {condition} THEN named_struct({fields}) END)" for condition in conditions)
    return rows.agg(F.expr(f"array({each})").alias("found")).scalar()


def _first_counts(values: DataFrame) -> DataFrame:
    """(c, p, n): how many values of each column (by number) have these first bits."""
    each = ", ".join(f"named_struct('c', {k}, 'x', {x})" for k, x in enumerate(values.columns))
    return (
        values.select(F.expr(f"explode(array({each}))").alias("o")).filter("o.x IS NOT NULL")
        .groupBy("o.c", F.shiftright("o.x", PLACES[0]).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    )


def _next_counts(values: DataFrame, state: Column, columns: Sequence[int], place: int) -> DataFrame:
    """(target, rank, total, p, n): how many values that share a target's bits so far have these next ones."""
    each = ", ".join(f"named_struct('target', {i}, 'x', x{c}, 's', state[{i}])" for i, c in enumerate(columns))
    placed = values.select("*", state.alias("state")).select(F.expr(f"explode(array({each}))").alias("o"))
    same = placed.filter(f"shiftright(o.x, {place + DIGIT}) = o.s.prefix")
    return (
        same.groupBy("o.target", "o.s.rank", "o.s.total", F.shiftright("o.x", place).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _at_ranks(df: DataFrame, targets: Sequence[tuple[str, str]]) -> Column:
    """For each (column, 0-based rank as SQL over the number of values ``total``) the value at that rank and the next.

    An array of structs (low, high, total) in the order of the targets; high is low where no value
    follows. NULL where the column has no value. low and high are BIGINT for integer columns only if all
    columns are such; else DOUBLE.
    """
    names = list(dict.fromkeys(c for c, _ in targets))
    values = images(df, names)
    ranks = [(names.index(c), r) for c, rank in targets for r in (rank, f"least({rank} + 1, {{total}} - 1)")]
    columns = [c for c, _ in ranks]
    counted = _upto(_first_counts(values), "c").withColumn("total", F.sum("n").over(Window.partitionBy("c")))
    # The wanted rank of a column is a number only where there are values; it is never below 0.
    wanted = [f"CAST({rank.format(total='total')} AS BIGINT)" for _, rank in ranks]
    state = None
    hits = [f"c = {c} AND upto > {w} AND upto - n <= {w}" for (c, _), w in zip(ranks, wanted)]
    each = ", ".join(
        f"max(CASE WHEN {hit} THEN named_struct('prefix', p, 'rank', {w} - (upto - n), 'total', total) END)"
        for hit, w in zip(hits, wanted)
    )
    state = counted.agg(F.expr(f"array({each})").alias("found")).scalar()
    for place in PLACES[1:]:
        ranked = _upto(_next_counts(values, state, columns, place), "target")
        inside = [f"target = {i} AND upto > rank AND upto - n <= rank" for i in range(len(columns))]
        state = _gathered(ranked, inside, "'prefix', p, 'rank', rank - (upto - n), 'total', total")
    whole = [_whole(df, c) for c, _ in targets]

    def value(i: int, k: int) -> str:
        return f"s[{i}].prefix" if all(whole) else f"CAST(s[{i}].prefix AS DOUBLE)" if whole[k] else value_sql(f"s[{i}].prefix")

    pairs = ", ".join(
        f"CASE WHEN s[{2 * k}].total IS NOT NULL THEN named_struct('low', {value(2 * k, k)}, 'high', {value(2 * k + 1, k)}, 'total', s[{2 * k}].total) END"
        for k in range(len(targets))
    )
    return df.sparkSession.range(1).select(state.alias("s")).select(F.expr(f"array({pairs})").alias("found")).scalar()


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> Column:
    """Linearly interpolated quantiles of several columns, as one scalar subquery.

    The struct has an array of quantiles per column. Attach it with
    ``withColumn`` and read its fields, so that it stays one subquery. NULL and NaN
    are left out; a column without values gives NULLs. Between two infinite
    neighbours the answer is theirs.
    """
    targets = [(c, p) for c, probs in wanted.items() for p in probs]
    found = _at_ranks(df, [(c, f"floor(({{total}} - 1) * {float(p)!r}D)") for c, p in targets])
    columns, at = [], 0
    for c, probs in wanted.items():
        values = []
        for p in probs:
            low, high = f"CAST(f[{at}].low AS DOUBLE)", f"CAST(f[{at}].high AS DOUBLE)"
            place = f"((f[{at}].total - 1) * {float(p)!r}D)"
            weight = f"({place} - floor({place}))"
            values.append(f"CASE WHEN {low} = {high} OR {weight} = 0 THEN {low} ELSE {low} + ({high} - {low}) * {weight} END")
            at += 1
        columns.append(f"'{c}', array({', '.join(values)})")
    one = df.sparkSession.range(1).select(found.alias("f"))
    return one.select(F.expr(f"named_struct({', '.join(columns)})").alias("q")).scalar()


def integer_quantiles(df: DataFrame, column: str, probs: Sequence[float], rows: Column | None = None) -> Column:
    """Linearly interpolated quantiles of a 32-bit integer column, as one scalar subquery (an array).

    One pass over ``df`` counts by value; hot values combine before the shuffle. Where ``df`` is a rollup,
    ``rows`` says how many values a row stands for.
    """
    counts = (
        # wider values raise: the bound needs 32 bits
        df.select(F.col(column).cast("int").cast("long").alias("key"), (F.lit(1) if rows is None else rows).cast("long").alias("rows"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        # The value again as an aggregate: conditions on it stay above the shuffle, which
        # both readers of the counts then share.
        .agg(F.sum("rows").alias("n"), F.max("key").alias("v"))
        .select("v", "n", F.shiftright("v", 16).alias("high_bits"))
    )
    # At most 65,536 rows, whatever the data: small enough for one window and a broadcast.
    ordered = Window.orderBy("high_bits")
    ranges = counts.groupBy("high_bits").agg(F.sum("n").alias("range_n"))
    ranges = ranges.select(
        F.col("high_bits").alias("range"),
        (F.sum("range_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_n")).alias("before"),
        F.sum("range_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("high_bits").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("running", F.sum("n").over(within))
        .join(F.broadcast(ranges), F.col("high_bits") == F.col("range"))
        .select("v", "n", "total", (F.col("before") + F.col("running")).alias("upto"))
    )

    def value(rank: Column) -> Column:
        hit = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        return F.max(F.when(hit, F.col("v"))).cast("double")

    values = []
    for p in probs:
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = value(F.floor(at)), value(F.ceil(at))
        values.append(low + (high - low) * F.max(at - F.floor(at)))
    return ranked.agg(F.array(*values).alias("q")).scalar()


def top_share(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row: how many values the largest ``share`` is (at least one), their sum, the total.

    For an integer column, or a DECIMAL(19, 0) of values within BIGINT whose sums are not; sums are of the column's kind. Ties at the cut do not matter for the sum: the cut
    value is counted as often as there are places left.
    """
    places = f"greatest(1, CAST(floor({{total}} * {float(share)!r}D) AS BIGINT))"
    found = _at_ranks(df, [(column, f"{{total}} - {places}")])
    one = df.sparkSession.range(1).select(found.alias("f"))
    cut = one.select(F.expr(
        f"named_struct('cut', CAST(f[0].low AS BIGINT), 'top', {places.format(total='f[0].total')})"
    ).alias("c")).scalar()
    kind = df.schema[column].dataType
    above, wide = F.col("v") > F.col("cut"), kind if isinstance(kind, T.DecimalType) else "long"
    return (
        df.select(F.col(column).cast("long").alias("v"), cut.alias("c"))
        .select("v", "c.cut", "c.top")
        .agg(
            F.max("top").cast("long").alias("top_count"),
            F.max("cut").alias("cut"),
            F.count_if(above).alias("above_count"),
            F.coalesce(F.sum(F.when(above, F.col("v").cast(wide))), F.lit(0).cast(wide)).alias("above_sum"),
            F.sum(F.col("v").cast(wide)).alias("total_sum"),
        )
        .select(
            "top_count",
            (
                F.col("above_sum") + (F.col("top_count") - F.col("above_count")) * F.col("cut").cast(wide)
            ).alias("top_sum"),
            "total_sum",
        )
    )
