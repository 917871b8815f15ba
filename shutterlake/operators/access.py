"""Users: activity, directory, groups, access levels and write decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.scalars import clock
from shutterlake.operators.keyed import upsert
from shutterlake.operators.people import for_parents, preferred_name

ADMIN_LEVEL = 5
SYSADMIN = "SysAdmin"
SHORTEST_BAR = 4.0


# --- activity ---------------------------------------------------------------------------------

def activity_counts(events: DataFrame, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user_id, hour, minute, count): the time of day only, days are added up (UTC)."""
    return events.groupBy(
        F.col(user).alias("user_id"),
        F.hour(ts).cast("int").alias("hour"),
        F.minute(ts).cast("int").alias("minute"),
    ).agg(F.count("*").alias("count"))


def activity_merge(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts plus new ones."""
    keys = ["user_id", "hour", "minute"]
    return (
        stored.select(*keys, "count").unionByName(delta.select(*keys, "count"))
        .groupBy(*keys).agg(F.sum("count").alias("count"))
    )


def activity_of_user(activity: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Rows of the users; order listings by user_id, hour, minute."""
    return for_parents(activity, "user_id", users).select("user_id", "hour", "minute", "count")


def hourly_histogram(activity: DataFrame) -> DataFrame:
    """(user_id, hour, count, total, height): 24 bars per user with activity, zero hours included.

    The 24 sums are conditional aggregates of one group, so the hours need no join.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("count"))), F.lit(0)) for h in range(24)
    ]
    per_user = activity.groupBy("user_id").agg(F.array(*sums).alias("bars"))
    shaped = per_user.select(
        "user_id",
        F.aggregate("bars", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("total"),
        F.array_max("bars").alias("highest"),
        F.posexplode("bars").alias("hour", "count"),
    )
    share = F.col("count") / F.col("highest") * 100
    floor = F.when(F.col("count") > 0, F.lit(SHORTEST_BAR)).otherwise(F.lit(0.0))
    height = F.when(F.col("highest") > 0, F.greatest(share, floor)).otherwise(F.lit(0.0))
    return shaped.select("user_id", "hour", "count", "total", height.alias("height"))


def last_access(activity: DataFrame) -> DataFrame:
    """(user_id, last_access): the latest time of day, HH:MM."""
    latest = activity.groupBy("user_id").agg(F.max(F.struct("hour", "minute")).alias("t"))
    return latest.select("user_id", clock(F.col("t.hour"), F.col("t.minute")).alias("last_access"))


def user_directory(users: DataFrame, names: DataFrame, activity: DataFrame) -> DataFrame:
    """(id, person_id, name, last_access); nulls where unknown."""
    return (
        users.select("id", "person_id")
        .join(preferred_name(names), "person_id", "left")
        .join(last_access(activity).withColumnRenamed("user_id", "id"), "id", "left")
        .select("id", "person_id", "name", "last_access")
    )


# --- groups -----------------------------------------------------------------------------------

def group_members(members: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    return for_parents(members, "user_group_id", groups).select(
        "user_group_id", "user_id", "is_admin"
    )


def apply_memberships(members: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds, updates and removes members.

    ``batch`` has user_group_id, user_id, is_admin, removed. Removal wins within a batch.
    """
    keys = ["user_group_id", "user_id"]
    kept = upsert(members, batch.filter(~F.col("removed")).select(*keys, "is_admin"), keys)
    return kept.join(batch.filter("removed").select(*keys), keys, "left_anti")


# --- access -----------------------------------------------------------------------------------

def access_level(asked: DataFrame, access: DataFrame, components: DataFrame) -> DataFrame:
    """(user_id, key, level) for asked (user_id, key) pairs; 0 without a record."""
    held = (
        access.join(components.select(F.col("id").alias("component_id"), "key"), "component_id")
        .groupBy("user_id", "key").agg(F.min_by("level", "id").alias("level"))
    )
    return asked.select("user_id", "key").join(held, ["user_id", "key"], "left").select(
        "user_id", "key", F.coalesce("level", F.lit(0)).alias("level")
    )


def admin_counts(access: DataFrame, components: DataFrame,
                 except_user: Column | int | None = None) -> DataFrame:
    """(component_id, key, admins): users of admin level, optionally leaving one out."""
    is_admin = F.col("level") >= ADMIN_LEVEL
    if except_user is not None:
        is_admin = is_admin & (F.col("user_id") != except_user)
    counts = access.groupBy("component_id").agg(F.count_if(is_admin).alias("admins"))
    return components.select(F.col("id").alias("component_id"), "key").join(
        counts, "component_id", "left"
    ).select("component_id", "key", F.coalesce("admins", F.lit(0)).alias("admins"))


def last_admin_violations(changes: DataFrame, access: DataFrame) -> DataFrame:
    """Changes (user_id, component_id, level) that must be refused, or a component has no admin left.

    Level null means removal. The batch is applied in the order of user ids: where it lowers every
    admin of a component, the one with the highest id stays. Users raised in the same batch do not
    count yet. Lowering anyone in a component that has no admin is refused too. Aggregates and
    equi-joins only, so a component of any size is split over tasks.
    """
    admins = access.filter(F.col("level") >= ADMIN_LEVEL).select("component_id", "user_id").distinct()
    total = admins.groupBy("component_id").agg(F.count("*").alias("_all"))
    lowered = changes.filter(F.coalesce("level", F.lit(0)) < ADMIN_LEVEL)
    hit = (
        lowered.select("component_id", "user_id").distinct()
        .join(admins, ["component_id", "user_id"], "left_semi")
        .groupBy("component_id").agg(F.count("*").alias("_lowered"), F.max("user_id").alias("_last"))
    )
    judged = lowered.join(total, "component_id", "left").join(hit, "component_id", "left")
    refused = F.col("_all").isNull() | ((F.col("_lowered") == F.col("_all")) & (F.col("user_id") == F.col("_last")))
    return judged.filter(refused).select("user_id", "component_id", "level")


def group_write_decision(requests: DataFrame, access: DataFrame, components: DataFrame,
                         members: DataFrame) -> DataFrame:
    """Adds allowed and reason to requests (user_id, group_id, read_only) to group-shared rows.

    System admins may; others must be members of the group and the row must not be read-only; a
    request without a group is allowed.
    """
    admins = (
        access.join(
            components.filter(F.col("key") == SYSADMIN).select(F.col("id").alias("component_id")),
            "component_id", "left_semi",
        )
        .groupBy("user_id").agg(F.min_by("level", "id").alias("_level"))
    )
    inside = members.select(
        "user_id", F.col("user_group_id").alias("group_id"), F.lit(True).alias("_member")
    ).distinct()
    reason = (
        F.when(F.coalesce("_level", F.lit(0)) >= ADMIN_LEVEL, F.lit(None))
        .when(F.col("group_id").isNull(), F.lit(None))
        .when(F.col("_member").isNull(), "not_member")
        .when(F.col("read_only"), "read_only")
    )
    return (
        requests.join(admins, "user_id", "left")
        .join(inside, ["user_id", "group_id"], "left")
        .withColumn("reason", reason)
        .select(*requests.columns, F.col("reason").isNull().alias("allowed"), "reason")
    )
