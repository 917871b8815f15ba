"""A media library derived from the benchmark tables, as DataFrames and as SQL text.

``Library`` builds every catalogue table from the parquet files (tables with assigned ids are
written once, as stored tables are); ``CTES`` has the same definitions
in DuckDB SQL for the result checks. Each table covers all rows of its source.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.files import file_class
from shutterlake.functions.hashing import hash_bits
from shutterlake.operators.catalogue import build_folder_tree
from shutterlake.operators.keyed import dense_number
from shutterlake.session import cut_lineage


class Library:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- items, files, paths (documents) ---

    @cached_property
    def media_item(self) -> DataFrame:
        day = F.date_format(
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")),
            "yyyy-MM-dd",
        )
        stamp = F.when(F.col("doc_id") % 3 == 0, F.concat(day, F.lit("T10:20:30.000Z"))).otherwise(day)
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.concat_ws("_", "source", "lang").alias("name"),
            F.when(F.col("doc_id") % 5 == 0, "video").otherwise("image").alias("type"),
            F.when(F.col("doc_id") % 11 != 0, stamp).alias("start_date"),
            F.when(
                F.col("doc_id") % 7 != 0, F.md5(F.concat_ws("|", "lang", "source", "n_chars"))
            ).alias("hash"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """Files as a directory scan would list them."""
        base = F.floor(F.col("doc_id") / 4)
        kinds = F.array(*[F.lit(e) for e in ("heic", "jpg", "mov", "aae")])
        prefix = F.when(F.col("doc_id") % 4 == 1, "IMG_E").otherwise("IMG_")
        return self.raw("documents").select(
            F.col("doc_id"),
            F.concat(
                F.lit("/lib/a"), (base % 5).cast("string"), F.lit("/b"), (base % 11).cast("string")
            ).alias("dir"),
            F.concat(prefix, F.lpad(base.cast("string"), 6, "0")).alias("name"),
            F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("extension"),
            (F.col("n_chars") * 1000).alias("size"),
            F.md5("text").alias("hash"),
        )

    @cached_property
    def path(self) -> DataFrame:
        dirs = self.listing.select("dir").distinct()
        return cut_lineage(dense_number(dirs, ["dir"], "id").select(
            "id", "dir", F.lit(1).cast("bigint").alias("host_id")
        ))

    @cached_property
    def file(self) -> DataFrame:
        ids = self.path.select(F.col("id").alias("path_id"), "dir")
        return self.listing.join(ids, "dir").select(
            F.col("doc_id").alias("id"), "name", "extension", "path_id",
            file_class(F.col("extension")).alias("type"), "size", "hash",
        )

    @cached_property
    def media_item_file(self) -> DataFrame:
        return self.raw("documents").select(
            (F.col("doc_id") - F.col("doc_id") % 4).alias("media_item_id"),
            F.col("doc_id").alias("file_id"),
            (F.col("doc_id") % 4 == 0).alias("is_primary"),
        )

    # --- folders (pages) ---

    @cached_property
    def page_dirs(self) -> DataFrame:
        """(page_id, dir): each page's address without scheme, query and last segment."""
        clean = F.regexp_replace("url", "^[a-z]+://", "")
        clean = F.regexp_replace(clean, "[?#].*$", "")
        clean = F.regexp_replace(clean, "/$", "")
        return self.raw("pages").select(
            "page_id", F.regexp_replace(clean, "/[^/]*$", "").alias("dir")
        )

    @cached_property
    def folder(self) -> DataFrame:
        return cut_lineage(build_folder_tree(self.page_dirs))

    @cached_property
    def folder_entry(self) -> DataFrame:
        paths = self.folder.select(F.col("id").alias("folder_id"), F.col("path").alias("dir"))
        return self.page_dirs.join(paths, "dir").select(
            F.col("page_id").alias("id"), "folder_id", F.col("page_id").alias("item_id"),
            F.col("page_id").alias("index"),
        )

    # --- keywords (part) ---

    @cached_property
    def part_words(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("media_item_id"),
            F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"),
        )

    @cached_property
    def keyword(self) -> DataFrame:
        words = self.part_words.select("word").distinct()
        return cut_lineage(dense_number(words, ["word"], "id").select("id", "word"))

    @cached_property
    def media_item_keyword(self) -> DataFrame:
        ids = self.keyword.select(F.col("id").alias("keyword_id"), "word")
        return self.part_words.join(ids, "word").select("media_item_id", "keyword_id")

    @cached_property
    def image_size(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            (F.col("p_size") * 60).cast("bigint").alias("width"),
            (F.col("p_size") * 40).cast("bigint").alias("height"),
        )

    # --- faces (embeddings) ---

    @cached_property
    def feature(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"),
            F.floor(F.col("vec_id") / 2).alias("item_id"),
            F.col("label").cast("string").alias("label"),
            "embedding",
            (F.col("vec_id") % 17 == 0).alias("ignored"),
        )

    @cached_property
    def person_feature(self) -> DataFrame:
        """A face is linked to the person of its label when its first value is above 0.05."""
        return self.raw("embeddings").filter(F.col("embedding")[0].cast("double") > 0.05).select(
            F.col("vec_id").alias("id"), F.col("vec_id").alias("feature_id"),
            F.col("label").cast("bigint").alias("person_id"),
        )

    @cached_property
    def face_rejection(self) -> DataFrame:
        return self.raw("embeddings").filter(F.col("embedding")[1].cast("double") > 0.1).select(
            F.col("vec_id").alias("id"), F.col("vec_id").alias("feature_id"),
            ((F.col("label") + 1) % 10).cast("bigint").alias("person_id"),
            F.lit("2024-01-01").alias("created_at"),
        )

    @cached_property
    def hash_item(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"),
            hash_bits(F.col("embedding").cast("array<double>")).alias("hash"),
        )

    @cached_property
    def located_face(self) -> DataFrame:
        """Faces with coordinates text, several per item and often repeated (events)."""
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("item_id"),
            F.when(
                F.col("event_type") != "error",
                F.to_json(F.struct(F.col("event_type").alias("x"), F.hour("ts").alias("y"))),
            ).alias("coordinates"),
        )

    # --- people, users (customer) ---

    @cached_property
    def person(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"))

    @cached_property
    def person_name(self) -> DataFrame:
        base = self.raw("customer")
        own = base.filter("c_acctbal >= 0").select(
            (F.col("c_custkey") * 2).alias("id"), F.col("c_custkey").alias("person_id"),
            F.col("c_name").alias("name"), F.lit(True).alias("preferred"),
        )
        second = base.filter("c_acctbal >= 5000").select(
            (F.col("c_custkey") * 2 + 1).alias("id"), F.col("c_custkey").alias("person_id"),
            F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string")).alias("name"),
            F.lit(False).alias("preferred"),
        )
        return own.unionByName(second)

    @cached_property
    def person_contact(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"),
            F.concat(F.lit("tel:"), F.col("o_orderkey").cast("string")).alias("contact"),
            F.col("o_orderpriority").alias("type"),
        )

    @cached_property
    def person_address(self) -> DataFrame:
        """Fifteen people share an address."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 15).alias("address_id"),
            F.col("c_custkey").alias("person_id"), F.lit("home").alias("type"),
            (F.col("c_nationkey") < 20).alias("preferred"),
        )

    @cached_property
    def user(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("person_id"),
        )

    @cached_property
    def component(self) -> DataFrame:
        segments = self.raw("customer").select(F.col("c_mktsegment").alias("key")).distinct()
        return cut_lineage(dense_number(segments, ["key"], "id").select("id", "key"))

    @cached_property
    def user_access(self) -> DataFrame:
        ids = self.component.select(F.col("id").alias("component_id"), F.col("key").alias("c_mktsegment"))
        return self.raw("customer").join(ids, "c_mktsegment").select(
            F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"), "component_id",
            (F.col("c_custkey") % 6).cast("int").alias("level"),
        )

    @cached_property
    def user_group_user(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_nationkey").cast("bigint").alias("user_group_id"),
            F.col("c_custkey").alias("user_id"),
            (F.col("c_custkey") % 10 == 0).alias("is_admin"),
        )

    @cached_property
    def user_rating(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
            (F.col("o_orderkey") % 20).alias("item_id"),
            (F.col("o_orderkey") % 5 + 1).cast("int").alias("rating"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        )

    # --- places (nation, customer, supplier) ---

    @cached_property
    def place(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("id"))

    @cached_property
    def place_name(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_nationkey").cast("bigint").alias("place_id"), F.col("n_name").alias("name"),
            F.lit(True).alias("preferred"),
        )

    @cached_property
    def place_media(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_custkey").alias("media_id"),
            F.col("c_nationkey").cast("bigint").alias("place_id"),
        )

    @cached_property
    def address(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("street"),
            F.concat(F.lit("city"), (F.col("s_suppkey") % 17).cast("string")).alias("city"),
            F.col("s_nationkey").cast("bigint").alias("place_id"),
        )

    # --- events ---

    @cached_property
    def event(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def change(self) -> DataFrame:
        """Change events: 'view' rows are progress reports."""
        kind = (
            F.when(F.col("event_type") == "view", "progress")
            .when(F.col("event_type") == "purchase", "create")
            .when(F.col("event_type") == "error", "delete")
            .otherwise("update")
        )
        return changes_from_events(self.event, kind)

    # --- detector boxes (lineitem) ---

    @cached_property
    def box(self) -> DataFrame:
        return self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount")).alias("r")
        ).select(
            F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("bigint").alias("box_id"),
            (F.col("r.l_partkey") % 50).cast("double").alias("x"),
            (F.col("r.l_suppkey") % 50).cast("double").alias("y"),
            F.col("r.l_quantity").alias("width"), F.col("r.l_quantity").alias("height"),
            (F.col("r.l_discount") * 5 + 0.5).alias("score"),
        )


def changes_from_events(events: DataFrame, kind) -> DataFrame:
    return events.select(
        "event_id", "ts", kind.alias("action"), F.lit("mediaItem").alias("source"),
        F.col("event_id").alias("id"), F.col("user_id"),
        F.when(kind == "progress", F.lit("indexing")).alias("phase"),
        F.when(kind == "progress", F.col("event_id")).alias("processed"),
        F.when(kind == "progress", F.floor(F.col("value")).cast("bigint")).alias("total"),
    )


# --- the same tables in DuckDB SQL ------------------------------------------------------------

def _number(source: str, key: str) -> str:
    return f"row_number() OVER (ORDER BY substr(md5({key}), 1, 3), {key}) AS id FROM (SELECT DISTINCT {key} FROM {source})"


CTES: dict[str, str] = {
    "media_item": """
        SELECT doc_id AS id, source || '_' || lang AS name,
          CASE WHEN doc_id % 5 = 0 THEN 'video' ELSE 'image' END AS type,
          CASE WHEN doc_id % 11 <> 0 THEN
            strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d')
            || CASE WHEN doc_id % 3 = 0 THEN 'T10:20:30.000Z' ELSE '' END END AS start_date,
          CASE WHEN doc_id % 7 <> 0 THEN md5(lang || '|' || source || '|' || n_chars) END AS hash
        FROM documents""",
    "listing": """
        SELECT doc_id,
          '/lib/a' || ((doc_id // 4) % 5) || '/b' || ((doc_id // 4) % 11) AS dir,
          CASE WHEN doc_id % 4 = 1 THEN 'IMG_E' ELSE 'IMG_' END
            || lpad(CAST(doc_id // 4 AS VARCHAR), 6, '0') AS name,
          ['heic', 'jpg', 'mov', 'aae'][doc_id % 4 + 1] AS extension,
          n_chars * 1000 AS size, md5(text) AS hash
        FROM documents""",
    "path": f"SELECT dir, 1 AS host_id, {_number('listing', 'dir')}",
    "file": """
        SELECT l.doc_id AS id, l.name, l.extension, p.id AS path_id,
          CASE l.extension WHEN 'mov' THEN 'video' WHEN 'aae' THEN 'other' ELSE 'image' END AS type,
          l.size, l.hash
        FROM listing l JOIN path p USING (dir)""",
    "media_item_file": """
        SELECT doc_id - doc_id % 4 AS media_item_id, doc_id AS file_id, doc_id % 4 = 0 AS is_primary
        FROM documents""",
    "page_dirs": r"""
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', ''), '/[^/]*$', '') AS dir FROM pages""",
    "folder_path": """
        SELECT DISTINCT array_to_string(parts[1:n], '/') AS path, parts[n] AS name,
          CASE WHEN n > 1 THEN array_to_string(parts[1:n - 1], '/') END AS parent_path
        FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n
              FROM (SELECT DISTINCT string_split(dir, '/') AS parts FROM page_dirs))""",
    "folder_id": f"SELECT path, {_number('folder_path', 'path')}",
    "folder": """
        SELECT i.id, f.name, q.id AS parent_id, f.path
        FROM folder_path f JOIN folder_id i USING (path)
        LEFT JOIN folder_id q ON q.path = f.parent_path""",
    "folder_entry": """
        SELECT page_id AS id, f.id AS folder_id, page_id AS item_id, page_id AS index
        FROM page_dirs d JOIN folder f ON f.path = d.dir""",
    "part_words": """
        SELECT p_partkey AS media_item_id, unnest(list_distinct(string_split(p_name, ' '))) AS word
        FROM part""",
    "keyword": f"SELECT word, {_number('part_words', 'word')}",
    "media_item_keyword": """
        SELECT media_item_id, k.id AS keyword_id FROM part_words JOIN keyword k USING (word)""",
    "image_size": "SELECT p_partkey AS id, p_size * 60 AS width, p_size * 40 AS height FROM part",
    "feature": """
        SELECT vec_id AS id, vec_id // 2 AS item_id, CAST(label AS VARCHAR) AS label,
          CAST(embedding AS DOUBLE[]) AS embedding, vec_id % 17 = 0 AS ignored FROM embeddings""",
    "person_feature": """
        SELECT vec_id AS id, vec_id AS feature_id, CAST(label AS BIGINT) AS person_id
        FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) > 0.05""",
    "face_rejection": """
        SELECT vec_id AS id, vec_id AS feature_id, CAST((label + 1) % 10 AS BIGINT) AS person_id
        FROM embeddings WHERE CAST(embedding[2] AS DOUBLE) > 0.1""",
    "hash_item": """
        SELECT vec_id AS id,
          array_to_string(list_transform(embedding, lambda x: CASE WHEN x >
            list_sort(embedding[2:64])[32] THEN '1' ELSE '0' END), '') AS hash
        FROM embeddings""",
    "located_face": """
        SELECT event_id AS id, user_id AS item_id,
          CASE WHEN event_type <> 'error' THEN event_type || hour(ts) END AS coordinates
        FROM events""",
    "person": "SELECT c_custkey AS id FROM customer",
    "person_name": """
        SELECT c_custkey * 2 AS id, c_custkey AS person_id, c_name AS name, true AS preferred
        FROM customer WHERE c_acctbal >= 0
        UNION ALL
        SELECT c_custkey * 2 + 1, c_custkey, c_mktsegment || ' ' || c_nationkey, false
        FROM customer WHERE c_acctbal >= 5000""",
    "person_contact": """
        SELECT o_orderkey AS id, o_custkey AS person_id, 'tel:' || o_orderkey AS contact,
          o_orderpriority AS type FROM orders""",
    "person_address": """
        SELECT c_custkey AS id, c_custkey // 15 AS address_id,
          c_custkey AS person_id, 'home' AS type, c_nationkey < 20 AS preferred FROM customer""",
    "user": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS person_id
        FROM customer""",
    "component": f"SELECT key, {_number('(SELECT c_mktsegment AS key FROM customer)', 'key')}",
    "user_access": """
        SELECT c_custkey AS id, c_custkey AS user_id, k.id AS component_id, c_custkey % 6 AS level
        FROM customer JOIN component k ON k.key = c_mktsegment""",
    "user_group_user": """
        SELECT CAST(c_nationkey AS BIGINT) AS user_group_id, c_custkey AS user_id,
          c_custkey % 10 = 0 AS is_admin FROM customer""",
    "user_rating": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 20 AS item_id,
          o_orderkey % 5 + 1 AS rating, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""",
    "place": "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation",
    "place_name": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS place_id,
          n_name AS name, true AS preferred FROM nation""",
    "place_media": """
        SELECT c_custkey AS id, c_custkey AS media_id, CAST(c_nationkey AS BIGINT) AS place_id
        FROM customer""",
    "address": """
        SELECT s_suppkey AS id, s_name AS street, 'city' || (s_suppkey % 17) AS city,
          CAST(s_nationkey AS BIGINT) AS place_id FROM supplier""",
    "activity": """
        SELECT user_id, hour(ts) AS hour, minute(ts) AS minute, count(*) AS count
        FROM events GROUP BY ALL""",
    "change": """
        SELECT event_id, ts, event_type, action, 'mediaItem' AS source, event_id AS id, user_id,
          CASE WHEN action = 'progress' THEN 'indexing' END AS phase,
          CASE WHEN action = 'progress' THEN event_id END AS processed,
          CASE WHEN action = 'progress' THEN CAST(floor(value) AS BIGINT) END AS total
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'create'
          WHEN 'error' THEN 'delete' ELSE 'update' END AS action FROM events)""",
    "box": """
        SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS box_id,
          CAST(r.p % 50 AS DOUBLE) AS x, CAST(r.s % 50 AS DOUBLE) AS y, r.q AS width, r.q AS height,
          r.d * 5 + 0.5 AS score
        FROM (SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 's': l_suppkey,
          'q': l_quantity, 'd': l_discount}) AS r FROM lineitem GROUP BY ALL)""",
}

_ORDER = list(CTES)


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefixes a query with the definitions it needs, in dependency order."""
    known = {**CTES, **(extra or {})}
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in wanted and re.search(rf'(?<![\w.]){name}(?![\w])', text):
                wanted.add(name)
                visit(known[name])

    visit(body)
    ordered = [n for n in [*_ORDER, *(extra or {})] if n in wanted]
    if not ordered:
        return body
    parts = ",\n".join(f'"{n}" AS ({known[n].strip()})' for n in ordered)
    return f"WITH RECURSIVE {parts}\n{body.strip()}"
