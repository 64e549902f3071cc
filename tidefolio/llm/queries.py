"""Registered queries of the operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_align,
    url_filter,
    warc,
)
from tidefolio.llm.text import LOWER, UPPER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

#: fixed values: rules of the URL query, as (verdict, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def fold(parts: int) -> Column:
    """Remainder of crc32 of the doc_id's text, which deals documents to training and held-out rows."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    f"""
    WITH rows AS (SELECT doc_id, {LOWERED} AS content FROM documents),
    marked AS (SELECT doc_id, content, max(doc_id) OVER (PARTITION BY content) AS keep_id,
                      count(*) OVER (PARTITION BY content) AS group_size FROM rows)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
           doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
    FROM marked"""
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    lower = f"'{UPPER}', '{LOWER}'"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    parts = url_filter.URL_PARTS
    ctes = [
        f"rules(v, h, p) AS (VALUES {rules})",
        f"""urls AS (SELECT page_id, html, row_number() OVER () AS r,
            translate(coalesce(regexp_extract(url, '{parts}', 1), ''), {lower}) AS host,
            coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages)""",
        """fit AS (SELECT r, first(h || p ORDER BY length(h || p) DESC) AS rule, first(v ORDER BY length(h || p) DESC) AS v
            FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)""",
        f"""links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{url_filter.LINK.replace("'", "''")}', 1)), {lower}) AS dst FROM urls)""",
        "edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY ALL)",
        """lone AS (SELECT DISTINCT host FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges) WHERE host NOT IN (SELECT host FROM urls)),
        lone_fit AS (SELECT host, first(v ORDER BY length(h || p) DESC) AS v FROM lone JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND p = '/' GROUP BY host)""",
        """seeds AS (SELECT host, avg((v IS NOT DISTINCT FROM 'allow')::INT) AS trust, avg((v IS NOT DISTINCT FROM 'block')::INT) AS distrust
            FROM (SELECT host, v FROM urls LEFT JOIN fit USING (r) UNION ALL SELECT host, v FROM lone LEFT JOIN lone_fit USING (host)) GROUP BY host)""",
        f"parts AS (SELECT src, dst, {url_filter.DAMPING} * n / sum(n) OVER (PARTITION BY src) AS part FROM edges)",
        "steps AS (SELECT src AS a, dst AS b, part, 1.0::DOUBLE AS passed, 't' AS kind FROM parts UNION ALL SELECT dst, src, part, 1 - coalesce(distrust, 0), 'd' FROM parts LEFT JOIN seeds ON host = src)",
        "m0 AS (SELECT 't' AS kind, host, trust AS mass, trust AS on_way FROM seeds WHERE trust > 0 UNION ALL SELECT 'd', host, distrust, distrust FROM seeds WHERE distrust > 0)",
    ]
    n = url_filter.rounds()
    ctes += [
        f"m{k} AS MATERIALIZED (SELECT kind, b AS host, sum(part * on_way) AS mass, sum(part * on_way) * any_value(passed) AS on_way FROM steps JOIN m{k - 1} USING (kind) WHERE a = host GROUP BY kind, b)"
        for k in range(1, n)
    ]
    union = " UNION ALL ".join(f"SELECT kind, host, mass FROM m{k}" for k in range(1, n))
    ctes.append(f"got AS (SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 'd'), 0) - coalesce(sum(mass) FILTER (WHERE kind = 't'), 0) AS more FROM ({union}) GROUP BY host)")
    return (
        "WITH "
        + ", ".join(ctes)
        + f""" SELECT page_id, host, path, rule, coalesce(v, CASE WHEN round(more - coalesce(trust, 0), 9) >= {url_filter.THRESHOLD} THEN 'block' END, 'allow') AS verdict
        FROM urls LEFT JOIN fit USING (r) LEFT JOIN got USING (host) LEFT JOIN seeds USING (host)"""
    )


@query(_url_sql())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs.select("doc_id", "text"), labels, "quality", fold(3) != 1)
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, byte_bpe.public_vocabulary()).select("doc_id", *byte_bpe.digests())


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language_id.train(docs, fold(5) != 0)
    return language_id.predict(docs.select("doc_id", "text"), known).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query(
    rf"""
    WITH doc AS (SELECT doc_id, row_number() OVER () AS r,
                        regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT CAST(item_id AS VARCHAR) AS item,
                    regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    size AS (SELECT *, least(len(w), {decontaminate.WINDOW}) AS n FROM item WHERE len(w) > 0),
    win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
    cut AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    met AS (SELECT r, i, n, item FROM cut JOIN win USING (n, g)),
    hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM met) GROUP BY r),
    its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM doc LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    rf"""
    WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT r, i, array_to_string(list_slice(w, i, i + {substring_dedup.LENGTH - 1}), ' ') AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - {substring_dedup.LENGTH - 2})) AS i FROM doc WHERE len(w) >= {substring_dedup.LENGTH})),
    rep AS (SELECT r, i FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + {substring_dedup.LENGTH})) AS k FROM rep),
    lost AS (SELECT r, count(*) AS n, list(k) AS ks FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END, ' ')) AS kept_sha256
    FROM doc LEFT JOIN lost USING (r)"""
)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def _base32_sql(hex_digest: str) -> str:
    """Base32 of 40 hex digits: five of them make four characters."""
    parts = []
    for i in range(8):
        number = f"CAST('0x' || substr({hex_digest}, {5 * i + 1}, 5) AS INTEGER)"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({number} >> {shift}) & 31), 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


@query(
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    q AS (SELECT page_id, strlen(body) AS n, sha1(body) AS d,
                 min(page_id) OVER (PARTITION BY body) AS least FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32_sql("d")} AS payload_digest,
           CASE WHEN page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
    FROM q"""
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query(
    rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
    gram AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
             FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM word, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k) WHERE len(w) >= k)),
    freq AS (SELECT lang, k, phrase, count(*) AS c FROM gram GROUP BY ALL),
    total AS (SELECT lang, sum(c) AS n FROM freq WHERE k = 1 GROUP BY lang),
    cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM freq WHERE k > 1 AND c >= {collocations.LEAST}),
    cut AS (SELECT *, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2
            FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
    part AS (SELECT lang, phrase AS p, c FROM freq),
    cost AS (SELECT cut.lang, cut.phrase, a, j, x.c AS l, y.c AS r, (CAST({collocations.SCALE} AS HUGEINT) * a) // (x.c + y.c) AS score
             FROM cut JOIN part x ON x.lang = cut.lang AND x.p = p1 JOIN part y ON y.lang = cut.lang AND y.p = p2),
    low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cost),
    inner_part AS (SELECT lang, a AS longer, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
                   FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))),
    most AS (SELECT lang, phrase, max(longer) AS longer FROM inner_part GROUP BY ALL),
    kept AS (SELECT lang, phrase, a, l, r, score FROM low LEFT JOIN most USING (lang, phrase)
             WHERE nth = 1 AND NOT coalesce(100 * CAST(longer AS HUGEINT) >= {collocations.SHARE} * CAST(a AS HUGEINT), FALSE)),
    rated AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM rated JOIN total USING (lang) WHERE rank <= {collocations.TOP}"""
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _shard_sql() -> str:
    """CRC-32 byte by byte from a table that follows from its polynomial, then two numberings."""
    polynomial, top, n = 0xEDB88320, 0xFFFFFFFF, sharding.SHARDS

    def hashed(*parts: str) -> str:
        return f"CAST('0x' || substr(md5(concat_ws('|', '{sharding.SEED}', {', '.join(parts)})), 1, {sharding.DIGITS}) AS BIGINT)"

    table_ctes = ["s0 AS (SELECT k, CAST(k AS BIGINT) AS v FROM range(256) AS t(k))"]
    for i in range(8):
        table_ctes.append(f"s{i + 1} AS (SELECT k, xor(v >> 1, {polynomial} * (v & 1)) AS v FROM s{i})")
    return (
        "WITH "
        + ", ".join(table_ctes)
        + f""", lookup AS (SELECT list(v ORDER BY k) AS t FROM s8),
    doc AS (SELECT doc_id, source, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
    crc AS (SELECT doc_id, source, r, strlen(x) + 8 AS size,
                   xor({top}, list_reduce(list_prepend(CAST({top} AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS text_crc32
            FROM doc, lookup),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {hashed("doc_id", "text_crc32")}, r) AS k,
                      count(*) OVER (PARTITION BY source) AS n FROM crc),
    spread AS (SELECT *, (k - 1 + {hashed("source")} / CAST(16 AS DOUBLE) ** {sharding.DIGITS}) / n AS place FROM ranked),
    placed AS (SELECT *, row_number() OVER (ORDER BY place, source NULLS FIRST, k) - 1 AS p, count(*) OVER () AS total FROM spread),
    dealt AS (SELECT *, p * {n} // total AS shard FROM placed)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
           CAST(p - (shard * total + {n - 1}) // {n} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""
    )


@query(_shard_sql())
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = token_align.score_links(table(spark, sf_dir, "documents"), token_align.public_pair())
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
