"""Subscriptions, report history and keyed latest state as relational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.keys import Keys


def subscriptions(toggles: DataFrame) -> DataFrame:
    """(user_id, url, created_at): a pair toggled an odd number of times is subscribed."""
    state = toggles.groupBy("user_id", "url").agg(F.count("*").alias("n"), F.max("ts").alias("created_at"))
    return state.where("n % 2 = 1").drop("n")


def fan_out(subs: DataFrame, width: int = 1000) -> DataFrame:
    """(url, part, users): the users of each url, sorted, in parts of at most ``width`` ids.

    A part is a range of user ids, so even a url that a third of all users follow never gathers
    more than ``width`` of them in one group.
    """
    part = F.floor(F.col("user_id") / width).cast("bigint")
    return subs.groupBy("url", part.alias("part")).agg(F.sort_array(F.collect_set("user_id")).alias("users"))


def due_urls(subs: DataFrame) -> DataFrame:
    """(url, n_users): every subscribed url once."""
    return subs.groupBy("url").agg(F.count("*").alias("n_users"))


def fan_in(reports: DataFrame, subs: DataFrame) -> DataFrame:
    """A copy of each successful report for every subscriber; failed urls are skipped."""
    return reports.where("status = 'ok'").join(subs.select("url", "user_id"), "url")


def owned(rows: DataFrame, override: str = "override_user_id", current: str = "current_user_id") -> DataFrame:
    """Rows with their owner: the override, else the current user; rows without one are dropped."""
    return rows.withColumn("user_id", F.coalesce(override, current)).where(F.col("user_id").isNotNull())


def latest(history: DataFrame, by: Keys = ("user_id",)) -> DataFrame:
    """The newest row per key; equal times go to the higher id. One map-side aggregate."""
    others = [c for c in history.columns if c not in by]
    return history.groupBy(*by).agg(
        F.max_by(F.struct(*others), F.struct("ts", "id")).alias("_row")
    ).select(*by, "_row.*")


def by_id(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows asked for as (id, user_id); a row of another owner does not come back."""
    return history.join(wanted, ["id", "user_id"], "left_semi")


def listing(history: DataFrame) -> DataFrame:
    """A user's history, newest first, with the shown date. Rows are dealt by ranges of (user, time,
    id), so a user with much of the table spans tasks, and the order holds from one to the next."""
    shown = history.select(
        "user_id", "id", "url", "total_items", F.date_format(F.col("ts").cast("timestamp"), "MMMM dd, yyyy 'at' hh:mm a").alias("shown"), "ts"
    )
    return shown.orderBy("user_id", F.col("ts").desc(), F.col("id").desc())


def series(history: DataFrame) -> DataFrame:
    """Points per (user, url) in time order: label and mean subjectivity. Dealt by ranges, as
    ``listing`` is."""
    points = history.select(
        "user_id", "url", "id", "ts", F.date_format(F.col("ts").cast("timestamp"), "MM-dd HH:mm").alias("label"), "avg_subjectivity"
    )
    return points.orderBy("user_id", "url", "ts", "id")


def with_subscribed(rows: DataFrame, subs: DataFrame) -> DataFrame:
    """Add ``is_subscribed`` for the row's user and url."""
    flags = subs.select("user_id", "url").distinct().withColumn("_hit", F.lit(True))
    return rows.join(flags, ["user_id", "url"], "left").withColumn(
        "is_subscribed", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def new_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """(email, name) to add: first login of every address that is not known yet; of equal times, the
    lower id."""
    first = logins.groupBy("email").agg(F.min_by("name", F.struct("ts", "id")).alias("name"))
    return first.join(users, "email", "left_anti")


def reading_minutes(n_segments: Column) -> Column:
    """Five seconds per segment, in minutes to one place, half-even."""
    return F.bround(n_segments * 5 / 60, 1)


def segment_counts(segments: DataFrame, by: Keys) -> DataFrame:
    return segments.groupBy(*by).agg(
        F.count("*").alias("n_segments"), reading_minutes(F.count("*")).alias("minutes")
    )


def latest_value(rows: DataFrame, by: Keys, value: str, ts: str = "ts") -> DataFrame:
    """The last value per key; last write wins, of equal times the greater value."""
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")))
    return rows.groupBy(*by).agg(last.alias("_last")).select(
        *by, F.col("_last.value").alias(value), F.col("_last.ts").alias(ts)
    )
