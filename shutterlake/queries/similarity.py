"""Perceptual hashes, near-duplicates, vectors, face matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import hashing, vectors
from shutterlake.operators import browse, facegraph, neardup
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query

WIDE = 18          # thresholds that give rows on the benchmark vectors
PAIRS = 0.3
EDGES = 0.35

HASHES = {
    "hash_group": "SELECT hash, min(id) AS rep FROM hash_item GROUP BY hash",
    "hash_pair": f"""
        SELECT * FROM (
          SELECT a.rep AS media_item_id, b.rep AS matching_item_id,
            bit_count(xor(CAST(a.hash AS BIT), CAST(b.hash AS BIT))) AS hamming_distance
          FROM hash_group a JOIN hash_group b ON a.rep < b.rep)
        WHERE hamming_distance <= {WIDE}
        UNION ALL SELECT g.rep, h.id, 0 FROM hash_item h JOIN hash_group g USING (hash) WHERE h.id <> g.rep""",
}


def _pairs(threshold: float) -> dict[str, str]:
    return {
        "vector_group": "SELECT embedding, min(id) AS rep FROM feature GROUP BY embedding",
        "face_pair": f"""
            SELECT * FROM (
              SELECT a.rep AS feature_id, b.rep AS matching_feature_id,
                list_inner_product(a.embedding, b.embedding) AS similarity
              FROM vector_group a JOIN vector_group b ON a.rep < b.rep)
            WHERE similarity >= {threshold}
            UNION ALL SELECT g.rep, f.id, list_inner_product(f.embedding, f.embedding)
              FROM feature f JOIN vector_group g USING (embedding) WHERE f.id <> g.rep""",
    }


COPIES = {
    "face": """SELECT id, item_id, embedding, label FROM feature
               UNION ALL SELECT id + 1000000, item_id + 1000000, embedding, label FROM feature WHERE id % 9 = 0""",
    "face_link": f"""
        SELECT * FROM (SELECT a.id AS a, b.id AS b, list_inner_product(a.embedding, b.embedding) AS similarity
          FROM face a JOIN face b ON a.id <> b.id) WHERE similarity >= {EDGES}""",
}
WALK = {**COPIES, "walk": """SELECT min(id) AS source, min(id) AS node, 0 AS hops FROM face GROUP BY label
                             UNION SELECT source, b, hops + 1 FROM walk JOIN face_link ON a = node WHERE hops < 10"""}


def _with_copies(lib: Library):
    """The faces, and a second face in another item for some."""
    faces = lib.feature.select("id", "item_id", "embedding", "label")
    second = faces.filter("id % 9 = 0").withColumns({
        "id": F.col("id") + 1_000_000, "item_id": F.col("item_id") + 1_000_000})
    return faces.unionByName(second)


def _transitive(lib: Library):
    """What is reached from the first face of every person."""
    faces = _with_copies(lib)
    first = faces.groupBy("label").agg(F.min("id").alias("id"))
    return facegraph.transitive_matches(facegraph.similarity_join(faces, EDGES), faces, first)


def pixel_images(lib: Library):
    """Grey images made of the whole text of each document, 32 pixels wide; the last row is filled up with black.

    A null text is an empty one: a black row.
    """
    text = F.coalesce("text", F.lit(""))
    height = F.greatest(F.ceil(F.octet_length(text) / 32).cast("int"), F.lit(1))
    data = F.rpad(F.encode(text, "UTF-8"), height * 32, F.lit(b"\0"))
    return lib.raw("documents").select(
        F.col("doc_id").alias("id"), F.lit(32).alias("width"), height.alias("height"),
        F.lit(1).alias("channels"), data.alias("data"))


@query()
def phash(lib: Library):
    return neardup.phash(pixel_images(lib))


@query("SELECT id, hash FROM hash_item")
def hash_bits(lib: Library):
    return lib.hash_item


@query("""
    SELECT a.id, bit_count(xor(CAST(a.hash AS BIT), CAST(b.hash AS BIT))) AS distance
    FROM hash_item a JOIN hash_item b ON b.id = a.id + 1""")
def hamming(lib: Library):
    following = lib.hash_item.select((F.col("id") - 1).alias("id"), F.col("hash").alias("other"))
    return lib.hash_item.join(following, "id").select(
        "id", hashing.hamming(F.col("hash"), F.col("other")).alias("distance"))


@query("SELECT media_item_id, matching_item_id, hamming_distance FROM hash_pair", HASHES)
def near_duplicate_join(lib: Library):
    return neardup.near_duplicate_join(lib.hash_item, WIDE)


TEXT_HASHES = {"text_hash": """
          SELECT doc_id AS id, array_to_string(list_transform(
            string_split(substr(md5(lang || '|' || source || '|' || n_chars), 1, 12) || substr(md5(text), 1, 4), ''),
            lambda d: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101',
              '1110','1111'][instr('0123456789abcdef', d)]), '') AS hash
          FROM documents"""}


def text_hashes(lib: Library):
    """(id, hash): hashes that share three of four bands between texts of one source, language and length."""
    kind = F.substring(F.md5(F.concat_ws("|", "lang", "source", "n_chars")), 1, 12)
    digits = F.concat(kind, F.substring(F.md5("text"), 1, 4))
    bits = F.lpad(F.conv(digits, 16, 2), 64, "0")
    return lib.raw("documents").select(F.col("doc_id").alias("id"), bits.alias("hash"))


@query("""
    SELECT * FROM (
      SELECT a.rep AS media_item_id, b.rep AS matching_item_id,
        bit_count(xor(CAST(a.hash AS BIT), CAST(b.hash AS BIT))) AS hamming_distance
      FROM text_group a JOIN text_group b ON a.rep < b.rep) WHERE hamming_distance <= 10
    UNION ALL SELECT g.rep, h.id, 0 FROM text_hash h JOIN text_group g USING (hash) WHERE h.id <> g.rep""",
       TEXT_HASHES | {"text_group": "SELECT hash, min(id) AS rep FROM text_hash GROUP BY hash"})
def near_duplicate_join_banded(lib: Library):
    return neardup.near_duplicate_join(text_hashes(lib), 10)


@query("""SELECT media_item_id, matching_item_id, hamming_distance FROM hash_pair
          WHERE hamming_distance > 16""", HASHES)
def canonical_match_insert(lib: Library):
    found = neardup.near_duplicate_join(lib.hash_item, WIDE)
    flipped = found.select(
        F.col("matching_item_id").alias("media_item_id"), F.col("media_item_id").alias("matching_item_id"),
        "hamming_distance")
    existing = flipped.filter("hamming_distance <= 16")
    return neardup.canonical_match_insert(
        existing, found.unionByName(flipped), "media_item_id", "matching_item_id")


@query("""
    SELECT item_id, other_id, hamming_distance, count(*) OVER (PARTITION BY item_id) AS total FROM (
      SELECT a.id AS item_id, b.id AS other_id, bit_count(xor(CAST(a.hash AS BIT), CAST(b.hash AS BIT))) AS hamming_distance
      FROM item_copy a JOIN item_copy b ON a.id <> b.id) WHERE hamming_distance <= 18""",
       {"item_copy": "SELECT id, hash FROM hash_item UNION ALL SELECT id + 1000000, hash FROM hash_item WHERE id % 9 = 0"})
def matches_of_item(lib: Library):
    """Matches of every item, some of which have copies."""
    items = lib.hash_item.select("id", "hash")
    items = items.unionByName(items.filter("id % 9 = 0").withColumn("id", F.col("id") + 1_000_000))
    return browse.with_total(neardup.near_duplicates_of(items, items.select("id"), WIDE), "item_id")


# --- vectors ---

@query("""
    SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN NULL ELSE len(embedding) END AS size FROM feature""")
def valid_embedding(lib: Library):
    """Info documents whose embedding is fine, absent, or holds a word among the numbers."""
    numbers = F.to_json(F.struct("embedding"))
    info = (
        F.when(F.col("id") % 4 == 0, F.lit('{"score": 1}'))
        .when(F.col("id") % 4 == 1, F.regexp_replace(numbers, r"\[", '["x",'))
        .otherwise(numbers)
    )
    parsed = lib.feature.select("id", vectors.embedding_from_info(info).alias("e"))
    return parsed.select("id", F.size("e").cast("bigint").alias("size")).withColumn(
        "size", F.when(F.col("size") > 0, F.col("size")))


@query("""SELECT doc_id AS id, round(n_chars / sqrt(n_chars * n_chars + 9.0 * doc_id * doc_id), 9) AS first,
          round(3 * doc_id / sqrt(n_chars * n_chars + 9.0 * doc_id * doc_id), 9) AS second FROM documents""")
def l2_normalise(lib: Library):
    unit = vectors.l2_normalise(F.array(F.col("n_chars"), F.col("doc_id") * 3))
    return lib.raw("documents").select(
        F.col("doc_id").alias("id"), unit.alias("u")
    ).select("id", F.round(F.col("u")[0], 9).alias("first"), F.round(F.col("u")[1], 9).alias("second"))


@query("""SELECT a.id, round(list_inner_product(a.embedding, b.embedding), 6) AS similarity,
            list_inner_product(a.embedding, b.embedding) >= 0.2 AS matches
          FROM feature a JOIN feature b ON b.id = a.id + 1""")
def cosine_of_neighbours(lib: Library):
    following = lib.feature.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    pair = F.col("embedding"), F.col("other")
    return lib.feature.join(following, "id").select(
        "id", F.round(vectors.cosine(*pair), 6).alias("similarity"),
        vectors.is_match(*pair, threshold=0.2).alias("matches"))


@query("SELECT feature_id, matching_feature_id, round(similarity, 6) AS similarity FROM face_pair", _pairs(PAIRS))
def similarity_join(lib: Library):
    return facegraph.similarity_join(lib.feature, PAIRS).withColumn("similarity", F.round("similarity", 6))


@query("SELECT feature_id, matching_feature_id, round(similarity, 6) AS similarity FROM face_pair", _pairs(PAIRS))
def similarity_join_approx(lib: Library):
    """With so high a recall that no pair of the benchmark tables is missed."""
    found = facegraph.similarity_join(lib.feature, PAIRS, approx=True, recall=0.999999)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""
    SELECT q.id AS query_id, f.id AS feature_id, round(list_inner_product(q.embedding, f.embedding), 6) AS similarity
    FROM (SELECT min(id) AS id FROM feature GROUP BY label) m JOIN feature q USING (id)
    JOIN feature f ON f.id <> q.id
    WHERE list_inner_product(q.embedding, f.embedding) >= 0.25""")
def similarity_search(lib: Library):
    first = lib.feature.groupBy("label").agg(F.min_by(F.struct("id", "embedding"), "id").alias("q"))
    found = facegraph.similarity_search(first.select("q.*"), lib.feature, 0.25)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""
    SELECT (SELECT count(*) FROM feature) AS processed,
      (SELECT count(*) FROM face_pair WHERE similarity < 0.4) AS new_matches,
      (SELECT count(*) FROM face_pair) AS total_matches""", _pairs(EDGES))
def backfill_matches(lib: Library):
    stored = facegraph.similarity_join(lib.feature, 0.4)
    _, report = facegraph.backfill_matches(lib.feature, stored, EDGES)
    return report


@query("""
    SELECT a AS node, b AS neighbour FROM face_link WHERE similarity < 0.45 OR similarity > 0.9""", COPIES)
def neighbours(lib: Library):
    """Matches of every face, some of which have copies; those of middle similarity are ignored."""
    faces = _with_copies(lib)
    edges = facegraph.similarity_join(faces, EDGES).withColumn("ignore_match", F.col("similarity").between(0.45, 0.9))
    return facegraph.neighbours(edges, facegraph.vector_members(faces))


@query("""
    SELECT w.source, f.item_id, min(f.id) AS feature_id FROM (
      SELECT source, node, min(hops) AS hops FROM walk GROUP BY ALL) w
    JOIN face f ON f.id = w.node WHERE w.node <> w.source GROUP BY ALL""", WALK)
def transitive_matches(lib: Library):
    return _transitive(lib)


@query("""
    SELECT source, item_id, feature_id, count(*) OVER (PARTITION BY source) AS total FROM (
      SELECT w.source, f.item_id, min(f.id) AS feature_id FROM (SELECT DISTINCT source, node FROM walk) w
      JOIN face f ON f.id = w.node WHERE w.node <> w.source GROUP BY ALL)
    ORDER BY source, item_id, feature_id LIMIT 50 OFFSET 10""", WALK)
def matching_faces_page(lib: Library):
    return facegraph.matching_faces_page(_transitive(lib), 10, 50)


@query("""SELECT feature_id, matching_feature_id, similarity >= 0.4 AS ignore_match FROM face_pair""", _pairs(EDGES))
def apply_match_ignores(lib: Library):
    edges = facegraph.similarity_join(lib.feature, EDGES)
    flipped = edges.filter("similarity >= 0.4").select(
        F.col("matching_feature_id").alias("feature_id"), F.col("feature_id").alias("matching_feature_id"))
    table = edges.withColumn("ignore_match", F.lit(False))
    return facegraph.apply_match_ignores(table, flipped).drop("similarity")


@query("""SELECT id, CASE WHEN label = '3' THEN true WHEN label = '4' THEN false ELSE ignored END AS ignored FROM feature""")
def apply_face_ignores(lib: Library):
    batch = lib.feature.filter("label IN ('3', '4')").select("id", (F.col("label") == "3").alias("ignored"))
    return facegraph.apply_face_ignores(lib.feature, batch).select("id", "ignored")


@query("""SELECT id, item_id, (SELECT count(*) FROM feature WHERE ignored) AS total FROM feature WHERE ignored
          ORDER BY id LIMIT 20""")
def ignored_faces(lib: Library):
    faces = facegraph.ignored_faces(lib.feature)
    return faces.select("*", faces.agg(F.count("*")).scalar().alias("total")).orderBy("id").limit(20)


@query("""
    SELECT feature_id, person_id FROM (
      SELECT feature_id, person_id FROM face_rejection UNION SELECT vec_id, CAST(label AS BIGINT) FROM embeddings WHERE label < 5)
    WHERE (feature_id, person_id) NOT IN (SELECT feature_id, person_id FROM face_rejection WHERE person_id = 7)""")
def apply_rejections(lib: Library):
    add = lib.feature.filter("CAST(label AS INT) < 5").select(
        F.col("id").alias("feature_id"), F.col("label").cast("bigint").alias("person_id"),
        F.lit(True).alias("rejected"), F.lit("2024-02-02").alias("created_at"))
    drop = lib.face_rejection.filter("person_id = 7").select(
        "feature_id", "person_id", F.lit(False).alias("rejected"), "created_at")
    done = facegraph.apply_rejections(lib.face_rejection, add.unionByName(drop))
    return done.select("feature_id", "person_id")


@query("""
    SELECT f.id AS feature_id, f.item_id, p.dir || '/' || x.name || '.' || x.extension AS path, f.label <> '9' AS usable
    FROM feature f JOIN media_item m ON m.id = f.item_id JOIN media_item_file l ON l.media_item_id = m.id AND l.is_primary
    JOIN file x ON x.id = l.file_id JOIN path p ON p.id = x.path_id""")
def reembed_worklist(lib: Library):
    return facegraph.reembed_worklist(
        lib.feature, lib.media_item, lib.media_item_file, lib.file, lib.path, F.col("label") != "9")


@query("""
    SELECT count(*) AS total, count(*) FILTER (located AND label <> '9') AS updated,
      count(*) FILTER (NOT located OR label = '9') AS skipped
    FROM (SELECT f.label, f.item_id IN (SELECT l.media_item_id FROM media_item_file l JOIN file x ON x.id = l.file_id
        JOIN path p ON p.id = x.path_id JOIN media_item m ON m.id = l.media_item_id WHERE l.is_primary) AS located FROM feature f)""")
def reembed_counts(lib: Library):
    usable = F.col("label") != "9"
    worklist = facegraph.reembed_worklist(
        lib.feature, lib.media_item, lib.media_item_file, lib.file, lib.path, usable)
    return facegraph.reembed_counts(lib.feature, worklist)
