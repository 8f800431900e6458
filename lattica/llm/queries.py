"""The operators' queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, fingerprint, html_text, langid, linededup, packing, resample, setjoin, tokens, toxicity, trie, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    common.tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int):
    """The remainder of the CRC-32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (see :func:`html_text.extract`): page_id, url, text, n_chars. A null or text-less html gives an empty text."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by its 4-word shingles at 85 hundredths (see :func:`setjoin.join`). A document without words is its own."""
    return setjoin.join(_read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash of every text and of its edited text (see :func:`fingerprint.edited_fingerprints`). A null text is empty."""
    return fingerprint.edited_fingerprints(_read(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Trained on a bounded sample of the labelled rows whose fold is not held out."""
    labels = _read(spark, sf_dir, "labels").filter(_fold(3) != 1)
    return toxicity.learned(toxicity.sample(docs.filter(_fold(3) != 1), labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by a network trained on labelled rows that are not held out (see :func:`toxicity.score`); an empty text has the model's score for none."""
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_windows")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every text (see :func:`decontaminate.matches`): one row a text and item, none for a clean text."""
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by words learned from rows that are not held out (see :func:`langid.detect`); `und` without a letter."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(*langid.sample(docs.filter(_fold(5) != 0)))
    found = langid.detect(docs, model, with_spans=False)
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that an earlier line resembles (see :func:`linededup.dedup`)."""
    return linededup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens in sequences of at most 1024 (see :func:`packing.pack`); a null or empty text is the end id alone."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokens.public_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back (see :func:`warc.write_archives`, :func:`warc.resolve`); a null html is an empty payload."""
    pages = _read(spark, sf_dir, "pages")
    path = common.new_path(spark, "warc")
    warc.write_archives(pages, path)
    return warc.resolve(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text (see :func:`tokens.attribute_tokens`); a text without lines has one section of none."""
    return tokens.attribute_tokens(_read(spark, sf_dir, "documents"), tokens.public_path())


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every text towards the benchmark, and the rank of those drawn (see :func:`resample.resample`); a null text has no features."""
    out = resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations (see :func:`trie.trie`); a null role or text is empty."""
    return trie.trie(_read(spark, sf_dir, "conversations"))


#: Rules of op13_url_filters: verdict and key.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the rules and, beyond them, by the list of the corpus's junk hosts (see :func:`urls.judge`); a null url is allowed."""
    pages = _read(spark, sf_dir, "pages")
    rules = spark.createDataFrame([(key, urls.BLOCK if verdict == "block" else urls.ALLOW) for verdict, key in URL_RULES], "key string, kind int")
    return urls.judge(pages, rules.unionByName(urls.junk_hosts(pages)))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_ngram_join, op3_fingerprints, op4_toxicity, op5_decontamination, op6_language_id, op7_line_dedup, op8_packing, op9_warc, op10_token_counts, op11_importance_resampling, op12_prefix_trie, op13_url_filters)}

SQL = {
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
        ), f AS (
            SELECT payload_digest, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.original IS NULL OR f.original = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.original <> d.page_id THEN f.original END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
    # the checksum's table is made by its rule, its steps are folded over the bytes of every distinct feature
    "op11_importance_resampling": r"""
        WITH steps AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)
            )
        ), texts AS (
            SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark
        ), worded AS (
            SELECT row_number() OVER () AS rid, doc, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
        ), each AS (
            SELECT rid, doc, unnest(range(1, len(w) + 1)) AS i, w FROM worded
        ), feats AS (
            SELECT rid, doc, unnest([w[i], w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]][:len(w) + 1 - i]) AS f FROM each
        ), uses AS (
            SELECT rid, doc, f, count(*) AS n FROM feats GROUP BY ALL
        ), hashed AS (
            SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(f)), lambda k: CAST('0x' || substr(hex(encode(f)), 2 * k + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM uses), steps
        ), sums AS (
            SELECT bucket, CAST(sum(n) FILTER (doc) AS DOUBLE) AS s, CAST(sum(n) FILTER (NOT doc) AS DOUBLE) AS t FROM uses JOIN hashed USING (f) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM sums), 0) + 10000)))) AS BIGINT) AS gain FROM sums
        ), weighed AS (
            SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM uses JOIN hashed USING (f) JOIN gains USING (bucket) WHERE doc GROUP BY rid
        ), scored AS (
            SELECT id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(id AS VARCHAR), ''))[:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
            FROM worded LEFT JOIN weighed USING (rid) WHERE doc
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS most FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM placed
    """,
    "op12_prefix_trie": """
        WITH steps AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)
            )
        ), own AS (
            SELECT conv_id, k, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM (
                SELECT conv_id, turn, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL
            )
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(c)), lambda k: CAST(ord(c[k + 1]) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM conversations WHERE conv_id IS NOT NULL), steps
        ), heads AS (
            SELECT c.conv_id, o.pos, o.k, o.n FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
        ), whole AS (
            SELECT * FROM heads
            UNION ALL
            SELECT c.conv_id, o.pos - c.h + (SELECT count(*) FROM heads x WHERE x.conv_id = c.conv_id), o.k, o.n FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
        ), begun AS (
            SELECT conv_id, pos, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS p, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS at_end FROM whole
            UNION ALL
            SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM whole) FROM convs
        ), node AS (
            SELECT pos AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '') AS ends FROM begun GROUP BY pos, p
        ), below AS (
            SELECT parent.depth, parent.p, count(child.p) AS n_children FROM node parent LEFT JOIN node child ON child.depth = parent.depth + 1 AND starts_with(child.p, parent.p) GROUP BY ALL
        ), subtree AS (
            SELECT left(x.p, 64 * d) AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
            FROM (SELECT node.*, n_children, unnest(range(0, depth + 1)) AS d FROM node JOIN below USING (depth, p)) x GROUP BY 1
        )
        SELECT node.conv_id, CAST(depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
        FROM node JOIN below USING (depth, p) JOIN subtree USING (p) LEFT JOIN (SELECT depth + 1 AS depth, p AS up_p, conv_id FROM node) up USING (depth) WHERE up.up_p IS NULL AND depth = 0 OR up.up_p = left(node.p, 64 * (CAST(depth AS BIGINT) - 1))
    """,
    "op13_url_filters": r"""
        WITH split AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), place AS (
            SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM split
        ), rules(verdict, on_host, on_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), ruled AS (
            SELECT place.*, (
                SELECT arg_max([on_host || on_path, verdict], length(on_host || on_path)) FROM rules
                WHERE (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path)
            ) AS r FROM place
        )
        SELECT page_id, host, path, r[1] AS rule,
               coalesce(r[2], CASE WHEN regexp_matches(host, '(^|[.-])(spam|pills|casino|viagra|porn|xxx|warez|phish)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled
    """,
}
