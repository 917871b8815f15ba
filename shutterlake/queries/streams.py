"""Streams run to the end of the benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shutterlake.plans.library import Library, changes_from_events
from shutterlake.queries.registry import query
from shutterlake.queries.similarity import PAIRS, TEXT_HASHES, _pairs, text_hashes
from shutterlake.session import shared_dir
from shutterlake.streaming import flows
from shutterlake.streaming.matching import face_pairs_for_batch


def _folders(lib: Library, name: str) -> tuple[str, str]:
    """(output, checkpoint) of one run, in the folder all executors share."""
    root = f"{shared_dir(lib.spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _stream(lib: Library, name: str):
    return lib.spark.readStream.schema(lib.raw(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(lib.sf_dir)


def _change_stream(lib: Library):
    kind = (
        F.when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "create")
        .when(F.col("event_type") == "error", "delete").otherwise("update"))
    events = _stream(lib, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes_from_events(events, kind)


@query("SELECT user_id, hour, minute, count FROM activity")
def stream_activity(lib: Library):
    out, checkpoint = _folders(lib, "activity")
    flows.stream_activity(_stream(lib, "events"), out, checkpoint, once=True).awaitTermination()
    return flows.stream_activity_state(lib.spark.read.parquet(out))


@query("""SELECT action, CASE WHEN action = 'progress' THEN 'progress,mediaItem,indexing:' || processed || '/' || total || ','
            ELSE action || ',mediaItem,' || id || ',' || user_id END AS message FROM change""")
def stream_changes(lib: Library):
    out, checkpoint = _folders(lib, "changes")
    flows.stream_changes(_change_stream(lib), out, checkpoint, once=True).awaitTermination()
    return lib.spark.read.parquet(out).select("action", "message")


@query("""SELECT source, 'indexing' AS phase, max_by(processed, (ts, processed)) AS processed, max_by(total, (ts, processed)) AS total
          FROM change WHERE action = 'progress' GROUP BY ALL""")
def stream_progress(lib: Library):
    out, checkpoint = _folders(lib, "progress")
    flows.stream_progress(_change_stream(lib), out, checkpoint, once=True).awaitTermination()
    return flows.latest_per_window(lib.spark.read.parquet(out), ["source"])


@query("""
    SELECT feature_id, matching_feature_id, round(similarity, 6) AS similarity FROM face_pair
    WHERE feature_id IN (SELECT id FROM feature WHERE label IN ('7', '8', '9'))
      OR matching_feature_id IN (SELECT id FROM feature WHERE label IN ('7', '8', '9'))""", _pairs(PAIRS))
def stream_match(lib: Library):
    """Faces of three labels arrive in several batches, the others are catalogued."""
    out, checkpoint = _folders(lib, "match")
    faces = lib.raw("embeddings").filter("label IN (7, 8, 9)").select(
        F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 3).alias("part"))
    faces.repartition(3, "part").drop("part").write.parquet(f"{out}-in")
    arrivals = (lib.spark.readStream.schema("id BIGINT, embedding ARRAY<FLOAT>")
                .option("maxFilesPerTrigger", 1).parquet(f"{out}-in"))
    catalogued = lib.feature.filter("label NOT IN ('7', '8', '9')").select("id", "embedding")
    flows.stream_match(
        arrivals, lambda batch, known: face_pairs_for_batch(batch, known, PAIRS), out, f"{out}-pool",
        checkpoint, once=True, catalogued=catalogued,
    ).awaitTermination()
    return lib.spark.read.parquet(out).select(
        "feature_id", "matching_feature_id", F.round("similarity", 6).alias("similarity"))


@query("""
    SELECT hash, other, distance, 1 AS n_links FROM (
      SELECT a.hash AS hash, b.hash AS other, bit_count(xor(CAST(a.hash AS BIT), CAST(b.hash AS BIT))) AS distance
      FROM hash_seen a JOIN hash_seen b ON a.hash < b.hash AND NOT (a.old AND b.old)) WHERE distance <= 10
    UNION ALL SELECT hash, hash, 0, copies FROM hash_seen WHERE copies > 0""",
       TEXT_HASHES | {"hash_seen": """
          SELECT hash, bool_or(lang = 'en') AS old,
            count(*) FILTER (lang <> 'en') - CASE WHEN bool_or(lang = 'en') THEN 0 ELSE 1 END AS copies
          FROM text_hash JOIN documents ON doc_id = id GROUP BY hash"""})
def stream_item_match(lib: Library):
    """Texts of one language are catalogued, the others arrive in several batches: stored links by their hashes."""
    root, checkpoint = _folders(lib, "item-match")
    hashes = text_hashes(lib)
    old = lib.raw("documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    hashes.join(old, "id", "left_anti").withColumn("part", F.col("id") % 3).repartition(3, "part").drop(
        "part").write.parquet(f"{root}-in")
    arrivals = (lib.spark.readStream.schema("id BIGINT, hash STRING")
                .option("maxFilesPerTrigger", 1).parquet(f"{root}-in"))
    flows.stream_item_match(
        arrivals, root, checkpoint, 10, once=True, catalogued=hashes.join(old, "id", "left_semi")).awaitTermination()
    links = flows.stored_matches(lib.spark, root)
    left = hashes.select(F.col("id").alias("media_item_id"), F.col("hash").alias("a"))
    right = hashes.select(F.col("id").alias("matching_item_id"), F.col("hash").alias("b"))
    return (links.join(left, "media_item_id").join(right, "matching_item_id")
            .groupBy(F.least("a", "b").alias("hash"), F.greatest("a", "b").alias("other"),
                     F.col("hamming_distance").alias("distance"))
            .agg(F.count("*").alias("n_links")))
