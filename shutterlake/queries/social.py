"""People, places, addresses, contacts, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import people
from shutterlake.operators.browse import with_total
from shutterlake.operators.keyed import one_per_key
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query

SUMMARY = {
    "name_sum": """SELECT person_id, arg_min(name, CASE WHEN preferred THEN id ELSE id + 1e12 END) AS name, count(*) AS name_count
                   FROM person_name GROUP BY ALL""",
    "face_sum": """SELECT person_id, arg_min(feature_id, p.id) AS first_feature_id, arg_min(item_id, p.id) AS first_item_id, count(*) AS photo_count
                   FROM person_feature p JOIN feature f ON f.id = p.feature_id GROUP BY ALL""",
}


MERGES = {
    "nation_target": "SELECT c_nationkey, min(c_custkey) AS target_id FROM customer WHERE c_acctbal >= 2000 GROUP BY ALL",
    "merge_pair": """SELECT c_custkey AS source_id,
          CASE WHEN c_nationkey <= 12 THEN (SELECT min(target_id) FROM nation_target) ELSE target_id END AS target_id
        FROM customer JOIN nation_target USING (c_nationkey) WHERE c_acctbal < 2000
        UNION ALL SELECT target_id, (SELECT min(target_id) FROM nation_target) FROM nation_target
        WHERE c_nationkey <= 12 AND target_id <> (SELECT min(target_id) FROM nation_target)""",
}


def _merges(lib: Library):
    """Persons with a low balance fold into the first of their nation with a higher one, and half of those
    into the first of all: chains of two."""
    customer = lib.raw("customer")
    targets = customer.filter("c_acctbal >= 2000").groupBy("c_nationkey").agg(F.min("c_custkey").alias("target_id"))
    low = customer.filter("c_acctbal < 2000").join(targets, "c_nationkey").select(
        F.col("c_custkey").alias("source_id"), "target_id")
    first = targets.agg(F.min("target_id")).scalar()
    return low.unionByName(targets.filter("c_nationkey <= 12").select(
        F.col("target_id").alias("source_id"), first.alias("target_id")))


@query("""SELECT DISTINCT person_id FROM person_name WHERE name ILIKE '%build%'""")
def search_people(lib: Library):
    return people.search_people(lib.person_name, "Build")


@query("""SELECT p.id AS person_id, name, coalesce(name_count, 0) AS name_count, first_feature_id, first_item_id, coalesce(photo_count, 0) AS photo_count
          FROM person p LEFT JOIN name_sum n ON n.person_id = p.id LEFT JOIN face_sum f ON f.person_id = p.id""", SUMMARY)
def people_summary(lib: Library):
    ids = lib.person.select(F.col("id").alias("person_id"))
    return people.people_summary(ids, lib.person_name, lib.person_feature, lib.feature)


@query("""SELECT q.person_id, name, name_count, first_feature_id, first_item_id, coalesce(photo_count, 0) AS photo_count
          FROM (SELECT DISTINCT person_id FROM person_name WHERE name ILIKE '%0_3%' ORDER BY 1 LIMIT 50) q
          LEFT JOIN name_sum n USING (person_id) LEFT JOIN face_sum f USING (person_id)""", SUMMARY)
def people_page(lib: Library):
    return people.people_page(lib.person_name, lib.person_feature, lib.feature, "0_3")


@query("""
    SELECT coalesce(m.target_id, f.person_id) AS person_id, f.feature_id, min(f.id) AS id
    FROM person_feature f LEFT JOIN merge_pair m ON m.source_id = f.person_id GROUP BY ALL""",
       MERGES)
def merge_people(lib: Library):
    merges = _merges(lib)
    tables = {"person": lib.person, "person_name": lib.person_name, "person_feature": lib.person_feature,
              "person_contact": lib.person_contact, "person_address": lib.person_address}
    merged, _ = people.merge_people(tables, merges)
    return merged["person_feature"].select("id", "person_id", "feature_id")


@query("""
    SELECT target_id, count(DISTINCT feature_id) AS reassigned, count(DISTINCT name_id) AS names_moved FROM (
      SELECT target_id, f.feature_id, NULL AS name_id FROM merge_pair m JOIN person_feature f ON f.person_id = m.source_id
      UNION ALL SELECT target_id, NULL, n.id FROM merge_pair m JOIN person_name n ON n.person_id = m.source_id)
    GROUP BY ALL""", MERGES)
def merge_people_report(lib: Library):
    merges = _merges(lib)
    tables = {"person": lib.person, "person_name": lib.person_name, "person_feature": lib.person_feature}
    return people.merge_people(tables, merges)[1]


@query("""SELECT id, person_id, name, preferred, count(*) OVER (PARTITION BY person_id) AS total FROM person_name""")
def names_of(lib: Library):
    return with_total(people.names_of(lib.person_name), "person_id")


@query("""
    SELECT person_id, name, preferred AND person_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 12) AS preferred FROM person_name
    UNION ALL SELECT c_custkey, 'alias ' || c_custkey, c_nationkey > 12 FROM customer""")
def apply_names(lib: Library):
    batch = lib.raw("customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("person_id"),
        F.concat(F.lit("alias "), "c_custkey").alias("name"), (F.col("c_nationkey") > 12).alias("preferred"))
    return people.apply_names(lib.person_name, batch).select("person_id", "name", "preferred")


@query("""SELECT id, person_id, contact, type, count(*) OVER (PARTITION BY person_id) AS total FROM person_contact""")
def contacts_of(lib: Library):
    return with_total(people.contacts_of(lib.person_contact), "person_id")


@query("""
    SELECT person_id, contact, type FROM person_contact WHERE type <> '1-URGENT'
    UNION ALL SELECT c_custkey, 'mail:' || c_name, NULL FROM customer""")
def apply_contacts(lib: Library):
    batch = lib.raw("customer").select(
        F.col("c_custkey").alias("person_id"), F.concat(F.lit("mail:"), "c_name").alias("contact"),
        F.lit(None).cast("string").alias("type"))
    gone = lib.person_contact.filter("type = '1-URGENT'").select("id", "person_id")
    done = people.apply_contacts(people.remove_children(lib.person_contact, gone, "person_id"), batch)
    return done.select("person_id", "contact", "type")


@query("""SELECT l.id, l.person_id, l.address_id, l.type, l.preferred, a.street, a.city
          FROM person_address l JOIN address a ON a.id = l.address_id""")
def addresses_of(lib: Library):
    return people.addresses_of(lib.person_address, lib.address)


@query("""
    SELECT person_id, address_id, preferred AND person_id NOT IN (SELECT person_id FROM fresh WHERE preferred) AS preferred FROM person_address
    UNION ALL SELECT person_id, address_id, preferred FROM fresh""",
       {"fresh": """SELECT c_custkey AS person_id, s_suppkey AS address_id, c_acctbal > 5000 AS preferred
          FROM customer JOIN supplier ON s_suppkey = c_custkey // 12
          WHERE (c_custkey, s_suppkey) NOT IN (SELECT person_id, address_id FROM person_address)"""})
def apply_address_links(lib: Library):
    batch = lib.raw("customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("person_id"),
        F.floor(F.col("c_custkey") / 12).alias("address_id"), F.lit("work").alias("type"),
        (F.col("c_acctbal") > 5000).alias("preferred"))
    done = people.apply_address_links(lib.person_address, lib.address, batch)
    return done.select("person_id", "address_id", "preferred")


@query("""SELECT p.id, p.person_id, p.feature_id, f.item_id, f.label, count(*) OVER (PARTITION BY p.person_id) AS total
          FROM person_feature p JOIN feature f ON f.id = p.feature_id""")
def features_of_person(lib: Library):
    return with_total(people.features_of_person(lib.person_feature, lib.feature), "person_id")


@query("""SELECT person_id, feature_id FROM person_feature UNION SELECT CAST(label AS BIGINT), vec_id FROM embeddings WHERE label < 6""")
def apply_face_links(lib: Library):
    """Faces of six persons, and as many that do not exist."""
    real = lib.feature.filter("CAST(label AS INT) < 6").select(
        F.col("label").cast("bigint").alias("person_id"), F.col("id").alias("feature_id"))
    ghosts = real.withColumn("feature_id", -F.col("feature_id") - 1)
    done = people.apply_face_links(lib.person_feature, real.unionByName(ghosts), lib.feature)
    return done.select("person_id", "feature_id")


@query("""SELECT count(*) AS removed FROM person_feature WHERE person_id = 4""")
def apply_unlinks(lib: Library):
    """Ids paired with the right person for one person, with a wrong one for all others."""
    batch = lib.person_feature.select(
        "id", F.when(F.col("person_id") == 4, F.col("person_id")).otherwise(F.lit(-1)).alias("person_id"))
    return people.apply_unlinks(lib.person_feature, batch)[1]


@query("""SELECT p.feature_id, p.person_id, n.name FROM person_feature p LEFT JOIN person_name n ON n.person_id = p.person_id""")
def person_of_feature(lib: Library):
    return people.person_of_feature(lib.person_feature, lib.person_name)


@query("""SELECT CAST(label AS BIGINT) AS person_id, count(*) AS assigned FROM embeddings
          WHERE vec_id NOT IN (SELECT feature_id FROM person_feature) GROUP BY ALL""")
def apply_assignments(lib: Library):
    batch = lib.feature.select(F.col("label").cast("bigint").alias("person_id"), F.col("id").alias("feature_id"))
    nobody = batch.withColumn("person_id", -F.col("feature_id") - 5)
    return people.apply_assignments(lib.person_feature, lib.person, batch.unionByName(nobody))[1]


@query("""SELECT (SELECT max(id) FROM person) + row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) AS person_id, name, assigned
          FROM (SELECT 'person ' || label AS name, count(*) AS assigned FROM feature GROUP BY ALL)""")
def create_people(lib: Library):
    batch = lib.feature.select(F.concat(F.lit("person "), "label").alias("name"), F.col("id").alias("feature_id"))
    ghosts = batch.withColumn("feature_id", F.col("feature_id") + 1_000_000)
    tables = {"person": lib.person, "person_name": lib.person_name, "person_feature": lib.person_feature, "feature": lib.feature}
    return people.create_people(tables, batch.unionByName(ghosts))[1]


@query("""SELECT person_id, arg_min(name, id) AS name FROM person_name WHERE preferred GROUP BY ALL""")
def preferred_name(lib: Library):
    return people.preferred_name(lib.person_name)


@query("""SELECT count(*) AS removed FROM person_feature""")
def reset_assignments(lib: Library):
    return people.reset_assignments(lib.person_feature)[1]


# --- places ---

@query("""SELECT p.id AS place_id, n.name, 1 AS name_count, coalesce(m.media_count, 0) AS media_count FROM place p
          LEFT JOIN place_name n ON n.place_id = p.id
          LEFT JOIN (SELECT place_id, count(*) AS media_count FROM place_media GROUP BY ALL) m ON m.place_id = p.id""")
def places_summary(lib: Library):
    return people.places_summary(lib.place, lib.place_name, lib.place_media)


@query("""SELECT m.id, m.place_id, m.media_id, i.name, i.type, i.start_date FROM place_media m JOIN media_item i ON i.id = m.media_id""")
def media_of_place(lib: Library):
    return people.media_of_place(lib.place_media, lib.media_item)


@query("""SELECT place_id, media_id FROM place_media UNION SELECT CAST(s_nationkey AS BIGINT), s_suppkey FROM supplier""")
def apply_place_links(lib: Library):
    batch = lib.raw("supplier").select(F.col("s_nationkey").cast("bigint").alias("place_id"), F.col("s_suppkey").alias("media_id"))
    return people.apply_place_links(lib.place_media, batch).select("place_id", "media_id")


@query("""SELECT id, street, city, place_id, count(*) OVER (PARTITION BY place_id) AS total FROM address""")
def addresses_of_place(lib: Library):
    return with_total(people.addresses_of_place(lib.address), "place_id")


@query("""SELECT street, city, place_id FROM address UNION ALL SELECT n_name || ' st', NULL, n_nationkey FROM nation""")
def apply_place_addresses(lib: Library):
    batch = lib.raw("nation").select(
        F.col("n_nationkey").cast("bigint").alias("place_id"), F.concat("n_name", F.lit(" st")).alias("street"))
    return people.apply_place_addresses(lib.address, batch).select("street", "city", "place_id")


# --- ratings ---

@query("""SELECT id, user_id, item_id, rating, date, count(*) OVER (PARTITION BY item_id) AS total FROM user_rating""")
def ratings_of_item(lib: Library):
    return with_total(people.ratings_of_item(lib.user_rating), "item_id")


@query("""
    SELECT user_id, item_id, rating, date FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY is_new DESC, date DESC, id DESC) AS n
      FROM (SELECT r.*, o_orderstatus <> 'F' AS is_new FROM user_rating r JOIN orders ON o_orderkey = r.id)) WHERE n = 1""")
def apply_ratings(lib: Library):
    """Ratings of finished orders are stored; the others arrive, with invalid ones among them."""
    done = lib.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    first = one_per_key(lib.user_rating.join(done, "id", "left_semi"), ["user_id", "item_id"], ["date", "id"], last=True)
    stored = first.withColumn("comment", F.lit("old"))
    good = lib.user_rating.join(done, "id", "left_anti").withColumnRenamed("id", "seq")
    bad = good.withColumns({"rating": F.lit(9), "date": F.lit("2999-01-01")})
    ratings, _ = people.apply_ratings(stored, good.unionByName(bad))
    return ratings.select("user_id", "item_id", "rating", "date")


@query("""SELECT id, user_id, item_id FROM user_rating WHERE (user_id, item_id) NOT IN (
          SELECT o_custkey, o_orderkey % 20 FROM orders WHERE o_orderpriority = '1-URGENT')""")
def drop_ratings(lib: Library):
    batch = lib.raw("orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 20).alias("item_id"))
    return people.drop_ratings(lib.user_rating, batch).select("id", "user_id", "item_id")
