"""Sources: events and matches as JSON or a partitioned table, tracking and its event feed as CSV, result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files (a JSON array each) with the explicit schema; columns that no event has are null."""
    return spark.read.schema(schemas.EVENT).json(path, multiLine=True)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MATCH).json(path, multiLine=True)


def ensure_columns(events: DataFrame) -> DataFrame:
    """Add the event columns that are missing, as nulls."""
    missing = [f for f in schemas.EVENT if f.name not in events.columns]
    return events.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def write_by_match(events: DataFrame, path: str, keys: tuple[str, ...] = ("match_id",)) -> None:
    """The cache table: a folder per key, so that a filter on a key reads its files only. Rows are dealt by key; Spark splits a key of very many rows at run time."""
    events.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def season(matches: DataFrame, competition_id: int, season_id: int) -> DataFrame:
    return matches.where((F.col("competition_id") == competition_id) & (F.col("season_id") == season_id))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_match_keys(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Attach competition and season; Spark broadcasts the matches if they are small."""
    return events.drop("competition_id", "season_id").join(matches.select("match_id", "competition_id", "season_id"), "match_id")


def nicknames(lineups: DataFrame) -> DataFrame:
    """(match_id, nicknames): a map from full name to nickname; empty nicknames are left out, the last team's by name wins."""
    named = lineups.where(F.col("player_nickname").isNotNull() & (F.col("player_nickname") != ""))
    last = named.groupBy("match_id", "player_name").agg(F.max_by("player_nickname", F.struct("team", "player_nickname")).alias("nick"))
    return last.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("player_name", "nick"))).alias("nicknames"))


def read_tracking(spark: SparkSession, path: str, keep_missing: bool = False) -> DataFrame:
    """A tracking file in long form: period, frame, time_s, player (Ball included), x, y.

    The third line names every other column; a nameless one behind it is the y. NaN is null, and so
    is a player who isn't on the pitch: those rows are left out, the frame stays through the others, unless they are kept.
    """
    lines = spark.read.text(path)
    names = [n.strip() for n in lines.where(F.col("value").startswith("Period,")).first()["value"].split(",")]
    number = lambda i: F.get("cells", F.lit(i)).try_cast("double")
    rows = lines.select(F.split("value", ",").alias("cells")).where(F.get("cells", F.lit(0)).try_cast("int").isNotNull())
    pairs = [F.struct(F.lit(n).alias("player"), number(i).alias("x"), number(i + 1).alias("y")) for i, n in enumerate(names) if i > 2 and n]
    long = rows.select(number(0).cast("long").alias("period"), number(1).cast("long").alias("frame"), number(2).alias("time_s"), F.explode(F.array(*pairs)).alias("p"))
    placed = long.select("period", "frame", "time_s", "p.player", F.nanvl("p.x", F.lit(None)).alias("x"), F.nanvl("p.y", F.lit(None)).alias("y"))
    return placed if keep_missing else placed.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def read_trackings(spark: SparkSession, path: str) -> DataFrame:
    """The tracking files of many games in long form, lost places as nulls; ``path`` has a folder game=g/team=t for each side, with any number of files.

    As ``read_tracking``, but each side's names come from its own header by a join, so that all files are one pass whatever their players.
    """
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith("Period,")).select(F.col("game").alias("__game"), F.col("team").alias("__team"), F.transform(F.split("value", ","), lambda n: F.trim(n)).alias("__names")).distinct()
    cells = lines.withColumn("cells", F.split("value", ",")).where(F.get("cells", F.lit(0)).try_cast("int").isNotNull())
    number = lambda i: F.get("cells", i).try_cast("double")
    named = F.transform("__names", lambda n, i: F.struct(n.alias("player"), i.alias("i"), number(i).alias("x"), number(i + 1).alias("y")))
    long = cells.join(heads, (F.col("game") == F.col("__game")) & (F.col("team") == F.col("__team"))).select(
        "game", "team", number(F.lit(0)).cast("long").alias("period"), number(F.lit(1)).cast("long").alias("frame"), number(F.lit(2)).alias("time_s"), F.explode(F.filter(named, lambda e: (e["i"] > 2) & (e["player"] != ""))).alias("p")
    )
    return long.select("game", "period", "frame", "time_s", "team", "p.player", F.nanvl("p.x", F.lit(None)).alias("x"), F.nanvl("p.y", F.lit(None)).alias("y"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The tracking provider's events with our column names and lower-case teams."""
    feed = spark.read.schema(schemas.FEED).csv(path, header=True, nullValue="NaN")
    return feed.withColumnsRenamed(schemas.FEED_NAMES).withColumn("team", F.lower("team"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_document(df: DataFrame, path: str) -> None:
    """A small result as one JSON document, an array of its rows."""
    df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.mode("overwrite").text(path)
