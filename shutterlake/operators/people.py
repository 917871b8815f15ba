"""People, places, addresses, contacts and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.scalars import contains_ignore_case
from shutterlake.operators.graph import MAX_ROUNDS
from shutterlake.operators.keyed import assign_ids, cascade_delete, new_rows, page
from shutterlake.session import cut_lineage

RATING_RANGE = (1, 5)


def for_parents(rows: DataFrame, parent_col: str, parents: DataFrame | None) -> DataFrame:
    """Rows of the given parents (all by default): the set form of "list the X of Y"."""
    if parents is None:
        return rows
    return rows.join(parents.select(F.col("id").alias(parent_col)), parent_col, "left_semi")


# --- people -----------------------------------------------------------------------------------

def search_people(names: DataFrame, q: str = "") -> DataFrame:
    """Distinct person ids with a matching name (any name for an empty search)."""
    found = names.filter(contains_ignore_case(F.col("name"), q)) if q else names
    return found.select("person_id").distinct()


def people_summary(ids: DataFrame, names: DataFrame, links: DataFrame,
                   features: DataFrame) -> DataFrame:
    """(person_id, name, name_count, first_feature_id, first_item_id, photo_count).

    ``name`` is the preferred (else oldest) one; ``names_of`` lists them all. Links to faces that do
    not exist are not counted. Both sides are aggregated before they are joined.
    """
    wanted = ids.select("person_id").distinct()
    known = names.join(wanted, "person_id", "left_semi").groupBy("person_id").agg(
        F.min_by("name", F.struct(~F.col("preferred"), F.col("id"))).alias("name"),
        F.count("*").alias("name_count"),
    )
    faces = (
        links.join(wanted, "person_id", "left_semi")
        .join(features.select(F.col("id").alias("feature_id"), "item_id"), "feature_id")
        .groupBy("person_id")
        .agg(
            F.min_by(F.struct("feature_id", "item_id"), "id").alias("first"),
            F.count("*").alias("photo_count"),
        )
    )
    return (
        wanted.join(known, "person_id", "left")
        .join(faces, "person_id", "left")
        .select(
            "person_id", "name",
            F.coalesce("name_count", F.lit(0)).alias("name_count"),
            F.col("first.feature_id").alias("first_feature_id"),
            F.col("first.item_id").alias("first_item_id"),
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
        )
    )


def people_page(names: DataFrame, links: DataFrame, features: DataFrame, q: str = "",
                limit: int = 50) -> DataFrame:
    """First people by id that match, summarised."""
    return people_summary(page(search_people(names, q), ["person_id"], 0, limit),
                          names, links, features)


def final_targets(merges: DataFrame) -> DataFrame:
    """(source_id, target_id) with every chain followed to its end, by pointer doubling."""
    move = cut_lineage(merges.filter("source_id <> target_id").groupBy("source_id").agg(
        F.min("target_id").alias("target_id")
    ))
    for _ in range(MAX_ROUNDS):
        onward = move.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        if move.join(onward, "target_id", "left_semi").isEmpty():
            return move
        move = cut_lineage(move.join(onward, "target_id", "left").select(
            "source_id", F.coalesce("_next", "target_id").alias("target_id")))
        if not move.filter("source_id = target_id").isEmpty():
            break
    raise ValueError("the merges form a cycle")


def merge_people(t: dict[str, DataFrame], merges: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): ``merges(source_id, target_id)`` folds each source into its target.

    Faces move unless the target has them (the oldest link wins among several sources), names move
    as not preferred, contacts and addresses go with the source. A target that is a source itself
    passes on to its own target; a cycle is an error. The lowest target of a repeated source counts.
    """
    move = final_targets(merges)
    by_person = move.select(F.col("source_id").alias("person_id"), "target_id")
    links = t["person_feature"]
    tagged = links.join(by_person, "person_id", "left")
    stay = tagged.filter("target_id IS NULL").select(*links.columns)
    moving = (
        tagged.filter("target_id IS NOT NULL")
        .groupBy(F.col("target_id").alias("_t"), F.col("feature_id").alias("_f"))
        .agg(F.min_by(F.struct(*links.columns), "id").alias("_row"))
        .select(*[
            F.col("_t").alias(c) if c == "person_id" else F.col(f"_row.{c}").alias(c)
            for c in links.columns
        ])
    )
    moved = new_rows(stay, moving, ["person_id", "feature_id"])
    names = t["person_name"]
    renamed = names.join(by_person, "person_id", "left").withColumns({
        "preferred": F.when(F.col("target_id").isNull(), F.col("preferred")).otherwise(False),
        "person_id": F.coalesce("target_id", "person_id"),
    })
    out = dict(t)
    out["person_feature"] = stay.unionByName(moved)
    out["person_name"] = renamed.select(*names.columns)
    out = cascade_delete(out, "person", move.select(F.col("source_id").alias("id")))
    report = (
        moved.select(F.col("person_id").alias("target_id"), F.lit(1).alias("f"), F.lit(0).alias("n"))
        .unionByName(
            renamed.filter("target_id IS NOT NULL").select(
                "target_id", F.lit(0).alias("f"), F.lit(1).alias("n")
            )
        )
        .groupBy("target_id")
        .agg(F.sum("f").alias("reassigned"), F.sum("n").alias("names_moved"))
    )
    return out, report


def names_of(names: DataFrame, owner: str = "person_id", owners: DataFrame | None = None) -> DataFrame:
    return for_parents(names, owner, owners).select("id", owner, "name", "preferred")


def add_preferred(rows: DataFrame, batch: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Adds child rows; a new preferred row clears the flag on the owner's other rows.

    When one batch has several preferred rows for an owner, the one with the highest ``seq`` stays.
    ``batch`` has seq next to the table's columns without id.
    """
    winner = batch.filter("preferred").groupBy(owner).agg(F.max("seq").alias("_seq"))
    cleared = (
        rows.join(winner.select(owner, F.lit(True).alias("_clear")), owner, "left")
        .withColumn("preferred", F.when(F.col("_clear"), F.lit(False)).otherwise(F.col("preferred")))
        .select(*rows.columns)
    )
    fresh = batch.join(winner, owner, "left").withColumn(
        "preferred", F.col("preferred") & (F.col("seq") == F.col("_seq"))
    )
    fresh = fresh.withColumn("preferred", F.coalesce("preferred", F.lit(False))).drop("_seq")
    numbered = assign_ids(rows, fresh, ["seq", *keys]).drop("seq")
    return cleared.unionByName(
        numbered.select(*[c for c in rows.columns if c in numbered.columns]),
        allowMissingColumns=True,
    )


def apply_names(names: DataFrame, batch: DataFrame, owner: str = "person_id") -> DataFrame:
    """New names (seq, owner, name, preferred) of people or places."""
    return add_preferred(names, batch, owner, [owner, "name"])


def remove_children(rows: DataFrame, batch: DataFrame, owner: str) -> DataFrame:
    """Deletes (id, owner) pairs; an id under another owner is left alone."""
    return rows.join(batch.select("id", owner), ["id", owner], "left_anti")


def contacts_of(contacts: DataFrame, people: DataFrame | None = None) -> DataFrame:
    return for_parents(contacts, "person_id", people).select("id", "person_id", "contact", "type")


def apply_contacts(contacts: DataFrame, batch: DataFrame) -> DataFrame:
    """New contacts (person_id, contact, type)."""
    numbered = assign_ids(contacts, batch, ["person_id", "contact", "type"])
    return contacts.unionByName(numbered, allowMissingColumns=True)


def addresses_of(links: DataFrame, addresses: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(id, person_id, address_id, type, preferred, street, city)."""
    place = addresses.select(F.col("id").alias("address_id"), "street", "city")
    return for_parents(links, "person_id", people).join(place, "address_id").select(
        "id", "person_id", "address_id", "type", "preferred", "street", "city"
    )


def apply_address_links(links: DataFrame, addresses: DataFrame, batch: DataFrame) -> DataFrame:
    """New (seq, person_id, address_id, type, preferred) links to existing addresses, idempotent."""
    real = batch.join(addresses.select(F.col("id").alias("address_id")), "address_id", "left_semi")
    keys = ["person_id", "address_id"]
    first = real.groupBy(*keys).agg(
        F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), "seq").alias("_r")
    ).select(*keys, "_r.*")
    return add_preferred(links, new_rows(links, first, keys), "person_id", keys)


def features_of_person(links: DataFrame, features: DataFrame,
                       people: DataFrame | None = None) -> DataFrame:
    """(id, person_id, feature_id, item_id, label)."""
    faces = features.select(F.col("id").alias("feature_id"), "item_id", "label")
    return for_parents(links, "person_id", people).join(faces, "feature_id").select(
        "id", "person_id", "feature_id", "item_id", "label"
    )


def _link(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new_rows(rows, batch.select(*keys).distinct(), keys)
    return rows.unionByName(assign_ids(rows, fresh, keys), allowMissingColumns=True)


def apply_face_links(links: DataFrame, batch: DataFrame,
                     features: DataFrame | None = None) -> DataFrame:
    """Links (person_id, feature_id), idempotent; with ``features`` only to faces that exist."""
    if features is not None:
        batch = batch.join(
            features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi"
        )
    return _link(links, batch, ["person_id", "feature_id"])


def apply_unlinks(links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, removed count): deletes link ids that belong to the person named with them."""
    keys = ["id", "person_id"]
    removed = links.join(batch.select(*keys), keys, "left_semi").agg(F.count("*").alias("removed"))
    return links.join(batch.select(*keys), keys, "left_anti"), removed


def person_of_feature(links: DataFrame, names: DataFrame,
                      features: DataFrame | None = None) -> DataFrame:
    """(feature_id, person_id, name): every name of the person each face is linked to."""
    rows = for_parents(links, "feature_id", features)
    return rows.select("feature_id", "person_id").join(
        names.select("person_id", "name"), "person_id", "left"
    )


def apply_assignments(links: DataFrame, people: DataFrame,
                      batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, assigned per person): many faces to existing people, known links skipped.

    Faces are not checked for existence, people are.
    """
    real = batch.join(people.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    keys = ["person_id", "feature_id"]
    fresh = new_rows(links, real.select(*keys).distinct(), keys)
    assigned = fresh.groupBy("person_id").agg(F.count("*").alias("assigned"))
    return links.unionByName(assign_ids(links, fresh, keys), allowMissingColumns=True), assigned


def create_people(t: dict[str, DataFrame], batch: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, created): one person per ``name`` of ``batch(name, feature_id)``.

    The name becomes preferred; links are made to faces that exist. ``created`` has (person_id,
    name, assigned).
    """
    people = assign_ids(t["person"], batch.select("name").distinct(), ["name"])
    named = people.select(F.col("id").alias("person_id"), "name")
    wanted = (
        batch.join(t["feature"].select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
        .join(named, "name").select("person_id", "feature_id").distinct()
    )
    out = dict(t)
    out["person"] = t["person"].unionByName(people.select("id"), allowMissingColumns=True)
    new_names = assign_ids(t["person_name"], named, ["person_id"])
    out["person_name"] = t["person_name"].unionByName(
        new_names.withColumn("preferred", F.lit(True)), allowMissingColumns=True
    )
    out["person_feature"] = _link(t["person_feature"], wanted, ["person_id", "feature_id"])
    counts = wanted.groupBy("person_id").agg(F.count("*").alias("assigned"))
    created = named.join(counts, "person_id", "left").select(
        "person_id", "name", F.coalesce("assigned", F.lit(0)).alias("assigned")
    )
    return out, created


def preferred_name(names: DataFrame, owner: str = "person_id") -> DataFrame:
    """(owner, name): the lowest-id preferred name."""
    return names.filter("preferred").groupBy(owner).agg(F.min_by("name", "id").alias("name"))


def reset_assignments(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(empty link table, number of links removed)."""
    return links.limit(0), links.agg(F.count("*").alias("removed"))


# --- places -----------------------------------------------------------------------------------

def places_summary(places: DataFrame, names: DataFrame, media: DataFrame) -> DataFrame:
    """(place_id, name, name_count, media_count)."""
    known = names.groupBy("place_id").agg(
        F.min_by("name", F.struct(~F.col("preferred"), F.col("id"))).alias("name"),
        F.count("*").alias("name_count"),
    )
    counts = media.groupBy("place_id").agg(F.count("*").alias("media_count"))
    return (
        places.select(F.col("id").alias("place_id"))
        .join(known, "place_id", "left").join(counts, "place_id", "left")
        .select(
            "place_id", "name",
            F.coalesce("name_count", F.lit(0)).alias("name_count"),
            F.coalesce("media_count", F.lit(0)).alias("media_count"),
        )
    )


def media_of_place(media: DataFrame, items: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(id, place_id, media_id, name, type, start_date)."""
    item = items.select(F.col("id").alias("media_id"), "name", "type", "start_date")
    return for_parents(media, "place_id", places).select("id", "place_id", "media_id").join(
        item, "media_id"
    )


def apply_place_links(media: DataFrame, batch: DataFrame) -> DataFrame:
    return _link(media, batch, ["place_id", "media_id"])


def addresses_of_place(addresses: DataFrame, places: DataFrame | None = None) -> DataFrame:
    rows = addresses.filter("place_id IS NOT NULL")
    return for_parents(rows, "place_id", places)


def apply_place_addresses(addresses: DataFrame, batch: DataFrame) -> DataFrame:
    """New address rows of places; absent fields are null."""
    fields = [c for c in addresses.columns if c != "id"]
    full = batch.select(*[
        F.col(c) if c in batch.columns else F.lit(None).cast(addresses.schema[c].dataType).alias(c)
        for c in fields
    ])
    return addresses.unionByName(assign_ids(addresses, full, fields), allowMissingColumns=True)


# --- ratings ----------------------------------------------------------------------------------

def ratings_of_item(ratings: DataFrame, items: DataFrame | None = None) -> DataFrame:
    return for_parents(ratings, "item_id", items)


def valid_rating(rating: Column) -> Column:
    low, high = RATING_RANGE
    return F.coalesce(rating.between(low, high), F.lit(False))


def apply_ratings(ratings: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings, refused): one rating per (user, item); later rows of a batch win.

    ``batch`` has user_id, item_id, rating, date, seq and may have comment (null when absent: a new
    rating replaces the old comment). Ratings outside 1..5 are returned as refused.
    """
    if "comment" not in batch.columns:
        batch = batch.withColumn("comment", F.lit(None).cast("string"))
    good = batch.filter(valid_rating(F.col("rating")))
    refused = batch.filter(~valid_rating(F.col("rating")))
    keys = ["user_id", "item_id"]
    latest = (
        good.groupBy(*keys)
        .agg(F.max_by(F.struct("rating", "date", "comment"), F.struct("date", "seq")).alias("r"))
        .select(*keys, "r.*", F.lit(True).alias("_new"))
    )
    stored = ratings.withColumnsRenamed(
        {"rating": "_rating", "date": "_date", "comment": "_comment"}
    )
    both = stored.join(latest, keys, "full_outer")

    def value(name: str) -> Column:
        return F.when(F.col("_new"), F.col(name)).otherwise(F.col(f"_{name}")).alias(name)

    merged = both.select("id", *keys, value("rating"), value("date"), value("comment"))
    new = merged.filter("id IS NULL").drop("id")
    kept = merged.filter("id IS NOT NULL")
    return kept.unionByName(assign_ids(ratings, new, keys)), refused


def drop_ratings(ratings: DataFrame, batch: DataFrame) -> DataFrame:
    """Deletes (user_id, item_id): each user's own rating only."""
    keys = ["user_id", "item_id"]
    return ratings.join(batch.select(*keys), keys, "left_anti")
