"""One query per operator, with production parameters over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight.llm.duck_bpe import round_trip
from foldlight.llm.line_cleaning import clean_lines
from foldlight.llm.mixing import mix
from foldlight.llm.near_dedup import near_duplicates
from foldlight.llm.packing import pack, token_pieces
from foldlight.llm.pii import KINDS, fit_spans
from foldlight.llm.quality import fit_quality, held_out
from foldlight.llm.registry import ORACLE, QUERIES, query, table
from foldlight.llm.spelling import altered_runs, spelling_forms, vocabulary
from foldlight.llm.substring_dedup import remove_repeats
from foldlight.llm.syncmers import as_text, fingerprints
from foldlight.llm.token_alignment import alignment_totals
from foldlight.llm.token_counts import count_tokens
from foldlight.llm.url_filter import fit_url_filter, hosts_with_words

__all__ = ["ORACLE", "QUERIES"]


@query("op8_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query(
    "op10_near_dedup",
    r"""
    WITH RECURSIVE low AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    shingle AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM low WHERE len(words) > 0)),
    size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
    pair AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS MATERIALIZED (
      SELECT x, y FROM pair JOIN size p ON x = p.doc_id JOIN size q ON y = q.doc_id WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
    edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION
      SELECT r.doc_id, e.y FROM reach r JOIN edge e ON r.other = e.x),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM least LEFT JOIN size USING (doc_id)""",
)
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op2_line_cleaning")
def line_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    return clean_lines(table(spark, folder, "documents"), with_text=False)


@query(
    "op4_substring_dedup",
    r"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    starts AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
    windows AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS run FROM starts),
    again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY run) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
    spread AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM spread ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (r)""",
)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_quality(docs, table(spark, folder, "labels"))
    return model.score(docs).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query("op7_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    packed = pack(pieces, 2048, carry=("start", "ids_crc32"))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op3_syncmers")
def syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op1_pii")
def pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = fit_spans(docs).spans(docs)

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.withColumn("base", base).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


ALLOW_RULES = ["org/", "com/fr/"]
BLOCK_RULES = ["example.org/es/", "example.org/en/1", "com/de/"]
HOST_WORDS = ["casino", "bets", "pills", "ads"]

SQL_RULES = ", ".join(
    f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')"
    for rules, v in ((ALLOW_RULES, "allow"), (BLOCK_RULES, "block"))
    for r in rules
)


@query(
    "op6_url_filter",
    f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    split AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut),
    places AS (
      SELECT page_id, coalesce(host, '') AS host, CASE WHEN host IS NULL THEN '' ELSE path END AS path
      FROM split),
    rules(rule, rule_host, rule_path, verdict) AS (VALUES {SQL_RULES}),
    fitting AS (
      SELECT p.*, r.rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS n
      FROM places p LEFT JOIN rules r
        ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict,
           CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(HOST_WORDS)})([.-]|$)') THEN 'block'
                ELSE 'allow' END) AS verdict
    FROM fitting WHERE n = 1""",
)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    listed = hosts_with_words(pages, HOST_WORDS)
    return fit_url_filter(pages, ALLOW_RULES, BLOCK_RULES, listed).judge(pages)


@query("op5_duckdb_bpe")
def duckdb_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op12_source_mix",
    r"""
    WITH d AS MATERIALIZED (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS id FROM s),
    v AS (SELECT *, CAST(CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             CAST(2 * source_size AS DOUBLE) AS capacity FROM n),
    r AS (
      SELECT *, sum(capacity) OVER o - capacity AS capacity_before, sum(weight) OVER () - (sum(weight) OVER o - weight) AS weight_left,
             1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted
      FROM v WINDOW o AS (ORDER BY capacity / weight, id ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, capacity * weight_left <= weight * (wanted - capacity_before) AS stopped FROM r),
    l AS (
      SELECT *, wanted - coalesce(sum(CASE WHEN stopped THEN capacity END) OVER (), 0) AS shared,
             sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS weight_all FROM f),
    t AS (SELECT source, source_size, CASE WHEN stopped THEN capacity ELSE weight * shared / weight_all END AS target FROM l),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
    x AS (
      SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) AS after
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, size, source_size, target,
      CAST(size * (whole + CASE WHEN after < budget OR (after - size < budget AND after - budget <= budget - (after - size))
                           THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM x""",
)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, repeat=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    totals = alignment_totals(table(spark, folder, "documents"), a, b)
    return totals.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    "op11_spelling_forms",
    r"""
    WITH RECURSIVE run AS MATERIALIZED (
      SELECT doc_id, translate(u.run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) u
      GROUP BY ALL),
    crc AS MATERIALIZED (  -- one step of CRC-32 for each byte
      SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
      FROM range(256) r(i)),
    hashed AS MATERIALIZED (
      SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
          string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
          lambda l: CASE WHEN unicode(l) < 128 THEN [unicode(l)::BIGINT] ELSE [192 + unicode(l)::BIGINT // 64, 128 + unicode(l)::BIGINT % 64] END))),
          lambda c, b: xor(c >> 8, step[xor(c, b) % 256 + 1]))) AS h
      FROM run, crc),
    altered AS (
      SELECT CASE WHEN h % 97 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    shorter AS MATERIALIZED (
      SELECT word, i, left(word, i) || substr(word, i + 2) AS rest, substr(word, i + 1, 1) AS letter
      FROM (SELECT word, unnest(range(len(word))) AS i FROM words)),
    near AS MATERIALIZED (
      SELECT DISTINCT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.letter <> b.letter
      UNION SELECT s.word, s.rest FROM shorter s JOIN words w ON s.rest = w.word
      UNION SELECT s.rest, s.word FROM shorter s JOIN words w ON s.rest = w.word),
    best AS (
      SELECT a AS word, count(*) AS n_near, min(struct_pack(minus := -n, near := b)) AS top
      FROM near JOIN words w ON w.word = b GROUP BY a),
    forms AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN -top.minus >= 2 * w.n THEN top.near END AS form, CASE WHEN -top.minus >= 2 * w.n THEN -top.minus END AS form_n
      FROM words w LEFT JOIN best USING (word)),
    climb AS (
      SELECT word, form AS root FROM forms WHERE form IS NOT NULL
      UNION SELECT c.word, f.form FROM climb c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
    tops AS (SELECT c.word, c.root FROM climb c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
    SELECT f.word, f.form, coalesce(t.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
    FROM forms f LEFT JOIN tops t USING (word)""",
)
def spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = vocabulary(altered_runs(table(spark, folder, "documents"), one_in=97), min_length=5, min_count=3)
    return spelling_forms(words, factor=2).select("word", "form", "root", "n", "n_near", "form_n")
