"""The registered queries of this subpackage, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with the DuckDB SQL that gives the same rows."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return run

    return register


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _url_sql() -> str:
    from shutterlake.llm.url_filters import SOFT_TERMS, STRICT_TERMS

    def hits(terms):
        listed = ", ".join(f"'{t}'" for t in terms)
        return (f"len(list_filter([{listed}], "
                "lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')))::INT")

    fits = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(fits.format(h=h, p=p, v=h + p) for _, h, p in ordered)
    verdict = " ".join(fits.format(h=h, p=p, v=v) for v, h, p in ordered)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{upper.lower()}') AS low,
            CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
          FROM pages),
        p AS (SELECT page_id, low,
            translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        n AS (SELECT *, {hits(STRICT_TERMS)} AS n_strict, {hits(SOFT_TERMS)} AS n_soft FROM p)
        SELECT page_id, host, path, CASE {rule} END AS rule,
          CASE {verdict} WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
          n_strict, n_soft FROM n"""


@query(_url_sql())
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.url_filters import Rule, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


@query("""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
        FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
        FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM win),
    pos AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
        FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
    occ AS (SELECT doc_id, i, win.size, item_id FROM pos JOIN win USING (g, size)),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM occ) GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.decontamination import mark_contamination

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contamination(documents, table(spark, sf_dir, "benchmark")).drop("text")


def _licence_sql() -> str:
    from shutterlake.llm.licences import default_templates

    listed = ", ".join("('{}', [{}])".format(t.licence, ", ".join(f"'{b}'" for b in t.bigrams))
                       for t in default_templates())
    return rf"""
        WITH t(licence, bigrams) AS (VALUES {listed}),
        low AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g'),
            ' *\n *', chr(10), 'g') AS s FROM documents),
        cut AS (SELECT doc_id, list_distinct(list_concat(string_split_regex(s, '\n+'),
            list_transform(string_split_regex(s, '\n{{2,}}'), lambda p: replace(p, chr(10), ' ')))) AS us FROM low),
        unit AS (SELECT doc_id, i, string_split(trim(us[i]), ' ') AS w FROM cut, unnest(range(1, len(us) + 1)) AS r(i)),
        own AS (SELECT doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS own
            FROM unit WHERE len(w) >= 2),
        scored AS (SELECT doc_id, i, licence, 2.0 * len(list_intersect(bigrams, own)) / (len(bigrams) + len(own)) AS dice
            FROM own JOIN t ON len(bigrams) <= len(own) * 1.5 + 1e-9 AND len(own) <= len(bigrams) * 1.5 + 1e-9),
        best AS (SELECT doc_id, i, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence FROM scored
            GROUP BY ALL HAVING max(dice) >= 0.8 - 1e-9),
        report AS (SELECT doc_id, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice, count(*) AS n_matches,
            array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences FROM best GROUP BY ALL)
        SELECT doc_id, licence, dice, coalesce(licences, '') AS licences, coalesce(n_matches, 0) AS n_matches
        FROM documents LEFT JOIN report USING (doc_id)"""


@query(_licence_sql())
def op1_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.licences import licence_report, scan_licences

    return licence_report(scan_licences(table(spark, sf_dir, "documents")))


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.pii import digest_columns, find_pii

    return digest_columns(find_pii(table(spark, sf_dir, "documents")))


@query()
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.secrets import digest_columns, find_secrets, learn_formats

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_columns(find_secrets(documents, formats=learn_formats(documents)))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.toxicity import held_out, score_texts, train

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score_texts(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.nearest import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
        FROM d, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
    size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (SELECT x, y FROM inter JOIN size AS p ON p.doc_id = x JOIN size AS q ON q.doc_id = y
        WHERE 100 * c >= 90 * (p.n + q.n - c)),
    way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach AS (WITH RECURSIVE t(a, b) AS (SELECT x, y FROM way UNION SELECT t.a, way.y FROM t JOIN way ON t.b = way.x)
        SELECT a, min(b) AS low FROM t GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
      coalesce(n_links, 0)::BIGINT AS n_links
    FROM d LEFT JOIN size USING (doc_id) LEFT JOIN reach ON a = doc_id
      LEFT JOIN (SELECT x, count(*) AS n_links FROM way GROUP BY 1) ON x = doc_id""")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90, count_links=True)


@query()
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query("""
    WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.row <> c.row)
    SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank, vec_id, score
    FROM s QUALIFY rank <= 5""")
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ \\t]+') AS w
        FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM documents)),
    total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
    f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
        FROM p, unnest([1, 2, 3, 4, 5]) AS s(size), unnest(range(1, len(w) - size + 2)) AS r(i)
        GROUP BY ALL HAVING count(*) >= 100),
    cut AS (SELECT c.lang, c.phrase, c.size, c.f AS a, k, h.f AS l, t.f AS r, n,
          1000::HUGEINT * c.f * n // (h.f::HUGEINT * t.f) AS score
        FROM f AS c JOIN total USING (lang), unnest(range(1, c.size)) AS u(k),
          f AS h, f AS t
        WHERE c.size > 1 AND h.lang = c.lang AND t.lang = c.lang
          AND h.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
          AND t.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (SELECT * FROM best AS b WHERE NOT EXISTS (SELECT 1 FROM f AS x WHERE x.lang = b.lang AND x.size > b.size
          AND 100 * x.f >= 100 * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
      a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM kept QUALIFY rank <= 2000""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query()
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.llm.alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
