"""Panels from files, date detection, and saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast.functions.columns import finite

# Separators, decimal signs and encodings to try, in this order.
SEPARATORS = [",", ";", "\t", "|"]
DECIMALS = [".", ","]
ENCODINGS = ["UTF-8", "ISO-8859-1", "windows-1252"]
# A first column is a date when its values pass all three.
DATE_SHARE, DATE_PARSED, DATE_DISTINCT = 0.8, 5, 3
#: Ways to write a date, the first wins a tie; None stands for the ISO forms.
DATE_PATTERNS = [None, "d.M.yyyy[ H:mm[:ss]]", "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "yyyy.M.d[ H:mm[:ss]]", "d MMM yyyy"]


def sniff_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str, str]:
    """Separator and decimal sign by one aggregate over all lines.

    A separator must cut most lines into the same number of fields, two or more, and the first line into
    as many; of several, the one that most lines agree with is taken. Quoted text is left out of that
    count. The decimal sign is the one that more numeric cells carry, quoted ones included, so that a file
    separated by commas may hold "1,5".
    """
    line = F.regexp_replace("value", r'"[^"]*"', "q")
    evidence = [F.count(F.lit(1)).alias("lines")]
    sizes = [F.size(F.split(line, "[" + sep + "]")) for sep in SEPARATORS]
    for i, sep in enumerate(SEPARATORS):
        fields = F.split(line, "[" + sep + "]")
        cells = F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))
        evidence.append(F.mode(sizes[i], deterministic=True).alias(f"most{i}"))
        evidence += [F.sum(F.size(F.filter(cells, _matches(rf"^\s*[-+]?\d*[{sign}]\d+\s*$")))).alias(f"n{i}{j}") for j, sign in enumerate(DECIMALS)]
    for j, sign in enumerate(DECIMALS):
        evidence.append(F.sum(F.size(F.regexp_extract_all("value", F.lit(rf'"\s*([-+]?\d*[{sign}]\d+)\s*"'), 1))).alias(f"quoted{j}"))
    lines = spark.read.option("encoding", encoding).text(path).where("length(trim(value)) > 0")
    seen = lines.agg(*evidence).first()
    if seen["lines"]:
        head = lines.select(*sizes).head()
        agree = lines.agg(*[F.count(F.when(size == seen[f"most{i}"], 1)) for i, size in enumerate(sizes)]).first()
        fit = [(-agree[i], i) for i in range(len(SEPARATORS)) if seen[f"most{i}"] == head[i] >= 2 and 2 * agree[i] > seen["lines"]]
        if fit:
            i = min(fit)[1]
            carry = lambda j: (seen[f"n{i}{j}"] if DECIMALS[j] != SEPARATORS[i] else 0) + seen[f"quoted{j}"]
            return SEPARATORS[i], DECIMALS[min((-carry(j), j) for j in range(len(DECIMALS)))[1]]
    raise ValueError(f"no separator splits {path} into two or more columns")


def _matches(pattern: str):
    return lambda cell: cell.rlike(pattern)


def pick_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding under which no line holds a replacement character."""
    for encoding in ENCODINGS:
        if spark.read.option("encoding", encoding).text(path).where(F.contains("value", F.lit("\ufffd"))).isEmpty():
            return encoding
    return ENCODINGS[-1]


def read_wide_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Wide CSV: first column the index, one column per series; every cell still text.

    Lines with fewer fields than the header are filled up with NULL; fields beyond the header's belong to
    no series and go.
    """
    encoding = encoding or pick_encoding(spark, path)
    sep, decimal = sniff_csv(spark, path, encoding)
    wide = spark.read.csv(path, sep=sep, header=True, encoding=encoding)
    if decimal == ",":
        wide = wide.select(wide.columns[0], *[F.regexp_replace(F.col(f"`{c}`"), ",", ".").alias(c) for c in wide.columns[1:]])
    return wide


def to_number(col: Column | str) -> Column:
    """Text to a finite double, anything else NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return finite(c.try_cast("double"))


def to_timestamp(col: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(col, *([F.lit(pattern)] if pattern else [])).cast("timestamp_ntz")


def date_pattern(df: DataFrame, column: str) -> str | None:
    """The pattern that most values of a text column keep; None for the ISO forms, also where none fits.

    A column is read by one pattern only: 03/04/2020 is the third of April where another value of the same
    column cannot be read with the month first.
    """
    text = F.col(column).cast("string")
    counts = df.agg(*[F.count(to_timestamp(F.trim(text), p)) for p in DATE_PATTERNS]).first()
    return DATE_PATTERNS[min((-n, i) for i, n in enumerate(counts))[1]]


def date_stats(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Evidence on whether a text column holds dates, from all its values; one row."""
    text = F.col(column).cast("string")
    stamp = to_timestamp(F.trim(text) if pattern else text, pattern)
    return df.agg(
        F.count(text).alias("n"),
        F.count(F.when(text.try_cast("double").isNotNull(), 1)).alias("n_numeric"),
        F.count(stamp).alias("n_parsed"),
        F.count_distinct(stamp).alias("n_distinct"),
    ).withColumn(
        "is_date",
        (F.col("n_numeric") < F.col("n"))
        & (F.col("n_parsed") >= DATE_SHARE * F.col("n"))
        & (F.col("n_parsed") >= DATE_PARSED)
        & (F.col("n_distinct") >= DATE_DISTINCT),
    )


def date_index(df: DataFrame, column: str) -> DataFrame:
    """Index by date when the column is one (rows that do not parse are dropped), else by number."""
    pattern = date_pattern(df, column)
    if date_stats(df, column, pattern).first()["is_date"]:
        return df.withColumn("ts", to_timestamp(F.trim(F.col(column).cast("string")) if pattern else F.col(column), pattern)).where(F.col("ts").isNotNull())
    return df.withColumn("ts", to_number(column))


def unpivot_panel(wide: DataFrame, index: str, order: str = "ts", keep: list[str] | None = None) -> DataFrame:
    """Wide → long, one row per (series, index value); ``keep`` names further columns to carry along."""
    ids = [index, *(keep or [])]
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], "series_id", "y").withColumnRenamed(index, order)


def pivot_panel(panel: DataFrame, index: str = "ts", series: list[str] | None = None) -> DataFrame:
    """Long → wide. The column list is the list of series, so it is for panels that fit a header line."""
    ids = series or [r.series_id for r in panel.select("series_id").distinct().orderBy("series_id").collect()]
    return panel.groupBy(index).pivot("series_id", ids).agg(F.first("y"))


def write_wide_csv(panel: DataFrame, path: str, sep: str = ",", decimal: str = ".") -> None:
    wide = pivot_panel(panel)
    if decimal == ",":
        wide = wide.select(
            F.col("ts").cast("string").alias("ts"),
            *[F.regexp_replace(F.col(f"`{c}`").cast("decimal(38,2)").cast("string"), r"\.", ",").alias(c) for c in wide.columns[1:]],
        )
    wide.write.csv(path, sep=sep, header=True)


def read_panel_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """CSV of a wide panel → long panel ``series_id, ts, y`` (``y`` double, NULL where a cell is no number).

    ``ts`` is a timestamp when the first column holds dates, a number when all its values are numbers,
    and its text otherwise. Of rows that share an index value the last in the file stays; series without
    any number are left out, and a file without any series of numbers is refused.
    """
    wide = read_wide_csv(spark, path, encoding)
    index = wide.columns[0]
    pattern = date_pattern(wide, f"`{index}`")
    stats = date_stats(wide, f"`{index}`", pattern).first()
    label = F.col("ts")
    if stats["is_date"]:
        label = to_timestamp(F.trim(label), pattern)
    elif stats["n_numeric"] == stats["n"]:
        label = to_number(label)
    # ids grow with the place in the file
    long = unpivot_panel(wide.withColumn("_line", F.monotonically_increasing_id()).withColumnRenamed(index, "_index"), "_index", "ts", keep=["_line"])
    rows = long.select("series_id", label.alias("ts"), to_number("y").alias("y"), "_line").where(F.col("ts").isNotNull())
    last = rows.groupBy("series_id", "ts").agg(F.max_by("y", "_line").alias("y"))
    filled = last.groupBy("series_id").agg(F.count("y").alias("n")).where("n > 0").select("series_id")
    if filled.isEmpty():
        raise ValueError(f"no column of {path} but the first holds numbers")
    return last.join(filled, "series_id", "left_semi")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack several panels, each row naming its source; columns a source lacks are NULL."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def persist_run(tables: dict[str, DataFrame], path: str) -> None:
    """Save the tables of a run; those with a ``split`` column are partitioned by it for pruning."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "split" in df.columns:
            writer = writer.partitionBy("split")
        writer.parquet(f"{path}/{name}")


def load_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
