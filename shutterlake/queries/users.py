"""Activity, directory, groups, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import access
from shutterlake.operators.browse import with_total
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query


def _activity(lib: Library):
    return access.activity_counts(lib.event)


@query("SELECT user_id, hour, minute, count FROM activity")
def activity_counts(lib: Library):
    return _activity(lib)


@query("""SELECT user_id, hour, minute, CAST(sum(count) AS BIGINT) AS count FROM (
          SELECT * FROM activity UNION ALL SELECT o_custkey % 150, 12, o_orderkey % 60, 2 FROM orders) GROUP BY ALL""")
def activity_merge(lib: Library):
    delta = lib.raw("orders").select(
        (F.col("o_custkey") % 150).alias("user_id"), F.lit(12).alias("hour"),
        (F.col("o_orderkey") % 60).cast("int").alias("minute"), F.lit(2).cast("bigint").alias("count"))
    return access.activity_merge(_activity(lib), delta)


@query("SELECT user_id, hour, minute, count FROM activity")
def activity_of_user(lib: Library):
    return access.activity_of_user(_activity(lib))


@query("""
    SELECT u.user_id, h.hour, coalesce(c, 0) AS count, total, round(greatest(coalesce(c, 0) * 100.0 / highest,
      CASE WHEN coalesce(c, 0) > 0 THEN 4 ELSE 0 END), 6) AS height
    FROM (SELECT user_id, max(c) AS highest, CAST(sum(c) AS BIGINT) AS total FROM per_hour GROUP BY ALL) u
    CROSS JOIN (SELECT unnest(range(0, 24)) AS hour) h
    LEFT JOIN per_hour p ON p.user_id = u.user_id AND p.hour = h.hour""",
       {"per_hour": "SELECT user_id, hour, CAST(sum(count) AS BIGINT) AS c FROM activity GROUP BY ALL"})
def hourly_histogram(lib: Library):
    return access.hourly_histogram(_activity(lib)).withColumn("height", F.round("height", 6))


@query("""SELECT user_id, lpad(CAST(t // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS last_access
          FROM (SELECT user_id, max(hour * 60 + minute) AS t FROM activity GROUP BY ALL)""")
def last_access(lib: Library):
    return access.last_access(_activity(lib))


@query("""SELECT u.id, u.person_id, n.name, lpad(CAST(t // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS last_access,
            count(*) OVER () AS total
          FROM "user" u LEFT JOIN (SELECT person_id, name FROM person_name WHERE preferred) n ON n.person_id = u.person_id
          LEFT JOIN (SELECT user_id, max(hour * 60 + minute) AS t FROM activity GROUP BY ALL) a ON a.user_id = u.id""")
def user_directory(lib: Library):
    total = lib.user.agg(F.count("*")).scalar()
    return access.user_directory(lib.user, lib.person_name, _activity(lib)).withColumn("total", total)


@query("SELECT user_group_id, user_id, is_admin, count(*) OVER (PARTITION BY user_group_id) AS total FROM user_group_user")
def group_members(lib: Library):
    return with_total(access.group_members(lib.user_group_user), "user_group_id")


@query("""
    SELECT user_group_id, user_id, CASE WHEN b.c_custkey IS NOT NULL THEN c_acctbal > 8000 ELSE is_admin END AS is_admin
    FROM (SELECT * FROM user_group_user UNION SELECT c_nationkey, c_custkey, true FROM customer WHERE false) m
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') b ON b.c_custkey = m.user_id
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 100, c_custkey, c_acctbal > 8000 FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal >= 0""")
def apply_memberships(lib: Library):
    customer = lib.raw("customer")
    flag = (F.col("c_acctbal") > 8000).alias("is_admin")
    edit = customer.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_nationkey").cast("bigint").alias("user_group_id"), F.col("c_custkey").alias("user_id"), flag,
        F.lit(False).alias("removed"))
    join = customer.filter("c_mktsegment = 'MACHINERY'").select(
        F.lit(100).cast("bigint").alias("user_group_id"), F.col("c_custkey").alias("user_id"), flag,
        F.lit(False).alias("removed"))
    leave = customer.filter("c_acctbal < 0").select(
        F.explode(F.array(F.col("c_nationkey").cast("bigint"), F.lit(100).cast("bigint"))).alias("user_group_id"),
        F.col("c_custkey").alias("user_id"), flag, F.lit(True).alias("removed"))
    return access.apply_memberships(lib.user_group_user, edit.unionByName(join).unionByName(leave))


@query("""SELECT u.id AS user_id, k.key, coalesce(a.level, 0) AS level FROM "user" u
          JOIN customer ON c_custkey = u.id
          JOIN component k ON k.key IN (c_mktsegment, 'BUILDING')
          LEFT JOIN user_access a ON a.user_id = u.id AND a.component_id = k.id""")
def access_level(lib: Library):
    asked = lib.raw("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.array_distinct(F.array(F.col("c_mktsegment"), F.lit("BUILDING")))).alias("key"))
    return access.access_level(asked, lib.user_access, lib.component)


@query("""SELECT k.id AS component_id, k.key, count(*) FILTER (a.level >= 5 AND a.user_id <> 5) AS admins FROM component k
          LEFT JOIN user_access a ON a.component_id = k.id GROUP BY ALL""")
def admin_counts(lib: Library):
    return access.admin_counts(lib.user_access, lib.component, except_user=5)


GRANTS = {
    "granted": """SELECT c_custkey AS id, c_custkey AS user_id, CAST(c_nationkey * 100 + c_custkey // 200 AS BIGINT) AS component_id,
                    CAST(c_custkey % 6 AS INTEGER) AS level FROM customer""",
}


@query("""SELECT g.user_id, g.component_id, g.level - 1 AS level FROM granted g
          LEFT JOIN (SELECT component_id, max(user_id) AS last FROM granted WHERE level >= 5 GROUP BY ALL) a USING (component_id)
          WHERE last IS NULL OR g.user_id = last""", GRANTS)
def last_admin_violations(lib: Library):
    """Everyone one level down, over many small components, so that all admins of each are lowered together."""
    granted = lib.raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"),
        (F.col("c_nationkey") * 100 + F.floor(F.col("c_custkey") / 200)).cast("bigint").alias("component_id"),
        (F.col("c_custkey") % 6).cast("int").alias("level"))
    return access.last_admin_violations(granted.withColumn("level", F.col("level") - 1), granted)


@query("""
    SELECT o_orderkey AS id, o_custkey AS user_id, r.group_id, r.read_only, reason IS NULL AS allowed, reason FROM (
      SELECT o_orderkey, o_custkey, o_orderkey % 25 AS group_id, o_orderstatus = 'P' AS read_only,
        CASE WHEN EXISTS (SELECT 1 FROM user_access a JOIN component k ON k.id = a.component_id WHERE k.key = 'MACHINERY' AND a.user_id = o_custkey AND a.level >= 5) THEN NULL
             WHEN NOT EXISTS (SELECT 1 FROM user_group_user g WHERE g.user_id = o_custkey AND g.user_group_id = o_orderkey % 25) THEN 'not_member'
             WHEN o_orderstatus = 'P' THEN 'read_only' END AS reason
      FROM orders) r""")
def group_write_decision(lib: Library):
    requests = lib.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 25).alias("group_id"), (F.col("o_orderstatus") == "P").alias("read_only"))
    components = lib.component.withColumn(
        "key", F.when(F.col("key") == "MACHINERY", access.SYSADMIN).otherwise(F.col("key")))
    return access.group_write_decision(requests, lib.user_access, components, lib.user_group_user)
