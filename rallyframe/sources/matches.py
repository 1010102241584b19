"""Reading, cleaning and writing of match tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parallel import concurrently

DATE_COLUMNS = ("match_date", "tourney_date", "date", "tourney_date_raw")
FILLS = {"surface": "Unknown", "tourney_level": "U"}
UNUSED = ("winner_entry", "loser_entry")

# How winner/loser columns are named side by side.
RENAMES = {
    "winner_id": "player_1_id", "loser_id": "player_2_id", "winner_name": "player_1", "loser_name": "player_2",
    "winner_hand": "player_1_hand", "loser_hand": "player_2_hand", "winner_rank": "p1_rank", "loser_rank": "p2_rank",
    "winner": "player_1", "loser": "player_2", "player1": "player_1", "player2": "player_2", "y": "target",
}
PREFIXES = (("w_", "p1_"), ("l_", "p2_"), ("winner_", "p1_"), ("loser_", "p2_"))


def _files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of a folder's files with the ending, by Spark's own file systems, sorted; FileNotFoundError if there is no such folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().endswith(ending))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _headers(spark: SparkSession, paths: Sequence[str]) -> list[str | None]:
    """Each file's first line, by Spark's own file systems (None where there is none or it can't be read): so much of each file is read here, no job is run."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first(path: str) -> str | None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        try:
            stream = where.getFileSystem(conf).open(where)
            try:
                line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
            finally:
                stream.close()
        except Py4JJavaError:
            return None
        return line.lstrip("\ufeff") if line and line.strip() else None

    return concurrently(first, paths)


def load_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """The union of a folder's CSV files by column name, and the files that can't be read, which are skipped.

    Files of equal headers are read together: one scan (and one inference of types) for each distinct header, however many
    files there are; headers may differ in columns and in their order. ValueError if no file is left.
    """
    paths = _files(spark, folder, ".csv")
    by_header: dict[str, list[str]] = {}
    skipped = []
    for path, header in zip(paths, _headers(spark, paths), strict=True):
        skipped.append(path) if header is None else by_header.setdefault(header, []).append(path)
    frames = []
    for files in by_header.values():
        try:
            own = spark.read.csv(files, header=True, inferSchema=schema is None)
            if schema is not None:
                types = {f.name: f.dataType for f in schema}
                own = own.select([F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in own.columns])
            frames.append(own)
        except (AnalysisException, ValueError):
            skipped += files
    if not frames:
        raise ValueError(f"no readable CSV file in {folder}")
    return union_by_name(_same_types(frames)), sorted(skipped)


def _same_types(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns whose inferred types differ between files become strings, or doubles if all are numbers."""
    seen: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            seen.setdefault(c, set()).add(t)
    numeric = {"int", "bigint", "double", "float", "smallint"}
    to = {c: "double" if types <= numeric else "string" for c, types in seen.items() if len(types) > 1}
    return [f.withColumns({c: F.col(f"`{c}`").cast(to[c]) for c in f.columns if c in to}) if to else f for f in frames]


def parse_date(column: Column) -> Column:
    """A date from yyyymmdd text or numbers; null where it is none."""
    return F.try_to_timestamp(column.cast("string"), F.lit("yyyyMMdd")).cast("date")


def clean(df: DataFrame) -> DataFrame:
    """Unused columns go, dates are parsed, equal rows go, and then nulls of known columns are filled."""
    df = df.drop(*UNUSED)
    if "tourney_date" in df.columns and not isinstance(df.schema["tourney_date"].dataType, T.DateType):
        df = df.withColumn("tourney_date", parse_date(F.col("tourney_date")))
    return df.dropDuplicates().fillna({c: v for c, v in FILLS.items() if c in df.columns})


def load_train_test(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The cleaned sides base/train and base/test. FileNotFoundError for a missing folder, ValueError for a side without rows."""
    sides = tuple(clean(load_folder(spark, f"{base}/{side}")[0]) for side in ("train", "test"))
    for name, side in zip(("train", "test"), sides, strict=True):
        if side.isEmpty():
            raise ValueError(f"no rows are left of {name}")
    return sides


def save_outputs(base: str, format: str = "parquet", **frames: DataFrame) -> None:
    """Writes each frame to base/<name>."""
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite")
        writer.option("header", True).csv(f"{base}/{name}") if format == "csv" else writer.format(format).save(f"{base}/{name}")


def load_processed(spark: SparkSession, base: str, format: str = "parquet") -> tuple[DataFrame, DataFrame] | None:
    """(train_final, test_final), or None if either is missing or can't be read."""
    try:
        read = spark.read.option("header", True).option("inferSchema", True) if format == "csv" else spark.read
        train, test = (read.format(format).load(f"{base}/{name}") for name in ("train_final", "test_final"))
        return train, test
    except AnalysisException:
        return None


def rename_sides(df: DataFrame) -> DataFrame:
    """winner/loser columns as player_1/player_2 and p1_/p2_ columns; ValueError if two would share a name."""
    to: dict[str, str] = {}
    for c in df.columns:
        new = RENAMES.get(c)
        if new is None:
            found = next(((a, b) for a, b in PREFIXES if c.startswith(a)), None)
            new = found[1] + c[len(found[0]) :] if found else c
        to[c] = new
    if len(set(to.values())) < len(to):
        raise ValueError(f"columns would share a name: {sorted(x for x in set(to.values()) if list(to.values()).count(x) > 1)}")
    return with_players(df.withColumnsRenamed({a: b for a, b in to.items() if a != b}))


def with_players(df: DataFrame) -> DataFrame:
    """player_1 and player_2, taken from the id or else the name columns where they are missing; ValueError if there are none."""
    for side in ("player_1", "player_2"):
        if side not in df.columns:
            source = next((f"{side}_{x}" for x in ("id", "name") if f"{side}_{x}" in df.columns), None)
            if source is None:
                raise ValueError(f"no column tells {side}")
            df = df.withColumn(side, F.col(source))
    return df


def date_column(df: DataFrame) -> str | None:
    """The first known date column with a value that is a date; one action for all of them."""
    there = [c for c in DATE_COLUMNS if c in df.columns]
    if not there:
        return None
    as_date = lambda c: F.col(c).cast("date") if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.coalesce(parse_date(F.col(c)), F.col(c).cast("string").try_cast("date"))
    seen = df.agg(*(F.count(as_date(c)).alias(c) for c in there)).first()
    return next((c for c in there if seen[c]), None)
