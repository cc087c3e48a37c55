"""The registered queries of this package and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.llm import language, toxicity
from remap.llm.collocations import mine_collocations
from remap.llm.decontamination import find_overlaps
from remap.llm.digest import compare_with_next
from remap.llm.jaccard_join import join_near
from remap.llm.language import held_out
from remap.llm.line_dedup import dedup_lines
from remap.llm.merkle import manifest
from remap.llm.preference import preference_examples, swapped_replies
from remap.llm.secrets import ASSIGN, BASE_RULES, scan_secrets, span_text
from remap.llm.texts import table
from remap.llm.token_matrix import pack_matrix
from remap.llm.tokens import tokenizer_spec
from remap.llm.url_filter import SiteRule, judge_urls
from remap.llm.vector_packing import pack_documents

# Site rules of the url contract, and the globs of this library.
SITE_RULES = [
    SiteRule("net/", "block"),
    SiteRule("example.net/en/", "allow"),
    SiteRule("example.com/de/", "block"),
    SiteRule("org/fr/", "allow"),
]
BLOCK_GLOBS = ["*.ads-track.*#*", "*.spam-farm.*#*", "*#*/ads/*", "*#*.exe"]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from two thirds of the labelled ids."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    model = toxicity.train(documents.where(~F.col("held_out")), labels)
    return toxicity.score(documents, model, "text", ["doc_id", "held_out"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal and nearly equal lines over all texts of ``documents``."""
    return dedup_lines(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
    WITH RECURSIVE line AS (
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
             unnest(generate_series(1, len(parts))) AS t(i)
        WHERE length(parts[i]) >= 30),
    kind AS (SELECT line, min((doc_id, line_no)) AS place, count(*) AS n_copies FROM line GROUP BY line),
    half AS (
        SELECT line, length(line) AS n, 0 AS side, left(line, 8) AS part FROM kind
        UNION ALL SELECT line, length(line), 1, right(line, 8) FROM kind
        UNION ALL SELECT line, length(line), 2, substr(line, length(line) // 2 - 6 + i, 8)
        FROM kind, unnest(generate_series(0, 6)) AS t(i)),
    link AS (
        SELECT DISTINCT a.line AS x, b.line AS y
        FROM half AS a JOIN half AS b ON a.side = b.side AND a.part = b.part AND a.line <> b.line AND abs(a.n - b.n) <= 2
        WHERE levenshtein(a.line, b.line) <= 2),
    reach AS (
        SELECT line AS x, line AS y FROM (SELECT DISTINCT x AS line FROM link)
        UNION SELECT r.x, l.y FROM reach AS r JOIN link AS l ON r.y = l.x),
    class AS (SELECT x AS line, min(place) AS first FROM reach JOIN kind ON kind.line = y GROUP BY x),
    linked AS (SELECT x AS line, count(*) AS n_links FROM link GROUP BY x)
    SELECT doc_id, line_no, coalesce(first, place)[1] AS class_doc, coalesce(first, place)[2] AS class_line,
           n_copies, coalesce(n_links, 0) AS n_links, coalesce(first, place) = (doc_id, line_no) AS is_first
    FROM line JOIN kind USING (line) LEFT JOIN class USING (line) LEFT JOIN linked USING (line)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learned from three quarters of the ids."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language.train(documents.where(~F.col("held_out")).drop("source"))
    return language.identify(documents, model, "text", ["doc_id", "held_out"])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, "url", "page_id", SITE_RULES, BLOCK_GLOBS).drop("globs")


OP4_SQL = r"""
    WITH parts AS (
        SELECT page_id,
               CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    split AS (
        SELECT page_id,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM parts),
    ruled AS (
        SELECT *, CASE
            WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM split)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
                WHEN rule IS NOT NULL THEN 'allow'
                WHEN '.' || host LIKE '%.ads-track.%' OR '.' || host LIKE '%.spam-farm.%'
                     OR path LIKE '%/ads/%' OR path LIKE '%.exe' THEN 'block'
                ELSE 'allow' END AS verdict
    FROM ruled
"""

def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text of ``documents`` that lie in a window of ``benchmark``."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_overlaps(documents, benchmark, ["doc_id"]).drop("items", "spans")


OP5_SQL = r"""
    WITH doc AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents),
    item AS (
        SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark),
    item_window AS (
        SELECT DISTINCT item_id, least(10, len(words)) AS size,
               array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS gram
        FROM item, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS t(i)
        WHERE len(words) > 0),
    doc_window AS (
        SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS gram
        FROM doc, (SELECT DISTINCT size FROM item_window), unnest(generate_series(1, len(words) - size + 1)) AS t(i)),
    hit AS (SELECT doc_id, item_id, i, size FROM doc_window JOIN item_window USING (size, gram)),
    covered AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM hit, unnest(generate_series(i, i + size - 1)) AS t(place) GROUP BY doc_id),
    listed AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies, near copies and links of every text of ``documents``."""
    return join_near(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents),
    kind AS (
        SELECT words, min(doc_id) AS rep, count(*) AS n_copies FROM doc WHERE len(words) > 0 GROUP BY words),
    gram AS (
        SELECT DISTINCT rep, array_to_string(words[i : i + 4], ' ') AS gram
        FROM kind, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS t(i)),
    size AS (SELECT rep, count(*) AS n FROM gram GROUP BY rep),
    common AS (
        SELECT a.rep AS x, b.rep AS y, count(*) AS n
        FROM gram AS a JOIN gram AS b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
    link AS (
        SELECT x, y FROM common AS c JOIN size AS a ON a.rep = x JOIN size AS b ON b.rep = y
        WHERE c.n * 5 >= (a.n + b.n - c.n) * 4),
    reach AS (
        SELECT rep AS x, rep AS y FROM kind
        UNION SELECT r.x, l.y FROM reach AS r JOIN link AS l ON r.y = l.x),
    class AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x),
    linked AS (SELECT x AS rep, count(*) AS n_links FROM link GROUP BY x)
    SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(k.rep, doc_id) AS copy_of,
           coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
    FROM doc LEFT JOIN kind AS k USING (words) LEFT JOIN class USING (rep) LEFT JOIN linked USING (rep)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text of ``documents`` in sequences of at most 1024 tokens."""
    tokenizer = tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer)


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the next conversation's last reply.

    The loss ranges are written as ``start:end``, comma-joined.
    """
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    pairs = preference_examples(turns, swapped_replies(turns))
    ranges = {
        c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
        for c in ("chosen_loss", "rejected_loss")
    }
    return pairs.withColumns(ranges).withColumnRenamed("pair_id", "conv_id")


OP8_SQL = r"""
    WITH final AS (
        SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    reply AS (
        SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations
        JOIN final USING (conv_id, turn) WHERE role = 'assistant'),
    swap AS (
        SELECT conv_id, turn, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS other
        FROM reply),
    turns AS (
        SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS place, c.role,
               coalesce(c.text, '') AS text, coalesce(s.other, c.text, '') AS other
        FROM conversations AS c LEFT JOIN swap AS s ON c.conv_id = s.conv_id AND c.turn = s.turn),
    cut AS (
        SELECT conv_id, coalesce(min(place) FILTER (text <> other) - 1, count(*)) AS common, count(*) AS size
        FROM turns GROUP BY conv_id),
    sides AS (
        SELECT conv_id, place, role, common, size,
               '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS mine,
               '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS theirs
        FROM turns JOIN cut USING (conv_id)),
    placed AS (
        SELECT *, coalesce(sum(length(mine)) FILTER (place > common) OVER w, 0) AS mine_end,
                  coalesce(sum(length(theirs)) FILTER (place > common) OVER w, 0) AS theirs_end
        FROM sides WINDOW w AS (PARTITION BY conv_id ORDER BY place))
    SELECT conv_id,
           coalesce(string_agg(mine, '' ORDER BY place) FILTER (place <= common), '') AS prompt,
           coalesce(string_agg(mine, '' ORDER BY place) FILTER (place > common), '') AS chosen,
           coalesce(string_agg(theirs, '' ORDER BY place) FILTER (place > common), '') AS rejected,
           CAST(max(common) AS INTEGER) AS prompt_turns,
           coalesce(string_agg((mine_end - length(mine) + 5 + length(role)) || ':' || (mine_end - 1), ',' ORDER BY place)
                    FILTER (place > common AND role = 'assistant'), '') AS chosen_loss,
           coalesce(string_agg((theirs_end - length(theirs) + 5 + length(role)) || ':' || (theirs_end - 1), ',' ORDER BY place)
                    FILTER (place > common AND role = 'assistant'), '') AS rejected_loss,
           max(common) < max(size) AS differs
    FROM placed GROUP BY conv_id
"""


def op9_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as rows of a packed token-id matrix."""
    tokenizer = tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_matrix(table(spark, sf_dir, "documents"), tokenizer)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text of ``documents``, of its edited text, and their likeness."""
    return compare_with_next(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``, scanned once per distinct text."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = tuple(r.kind for r in BASE_RULES)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(span_text(F.col("spans"), base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def _scan_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return (f"SELECT doc_id, '{kind}' AS kind, {order} AS ord, {least} AS least, "
            f"regexp_extract_all(t, '{quoted}', 0) AS found, regexp_extract_all(t, '{quoted}', {group}) AS grp, "
            f"string_split_regex(t, '{quoted}') AS gaps FROM doc")


# The SQL takes the contract's patterns as written (runs of any length, then the test).
OP11_SQL = f"""
    WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    scan AS (
        {_scan_sql("assign", 0, ASSIGN.pattern, 2, 12)}
        UNION ALL {_scan_sql("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
        UNION ALL {_scan_sql("hex", 2, "[0-9a-f]+", 0, 16)}
        UNION ALL {_scan_sql("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0)}
        UNION ALL {_scan_sql("personal_token", 4, "gh[pousr]_[A-Za-z0-9]{{36,}}", 0, 36)}),
    each AS (
        SELECT doc_id, kind, ord, least, i, length(found[i]) AS m_len, length(grp[i]) AS g_len,
               length(gaps[i]) AS p_len
        FROM scan, unnest(generate_series(1, len(found))) AS u(i)),
    placed AS (
        SELECT *, sum(p_len + m_len) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM each),
    span AS (SELECT doc_id, kind, ord, e - m_len AS s, e FROM placed WHERE g_len >= least),
    per_doc AS (
        SELECT doc_id,
               count(*) FILTER (WHERE kind = 'assign') AS n_assign,
               count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)
                   FILTER (WHERE ord < 3) AS base,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
        FROM span GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign,
           CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM doc LEFT JOIN per_doc USING (doc_id)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents``, and the check of texts whose line breaks were deleted."""
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, F.when(touched, F.translate("text", "\n", "")).otherwise(F.col("text")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 5 words of ``documents`` texts."""
    return mine_collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
    WITH doc AS (
        SELECT coalesce(lang, 'und') AS lang,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
        FROM documents),
    piece AS (
        SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS ws
        FROM doc, unnest(ps) AS u(p)),
    total AS (SELECT lang, sum(len(ws)) AS n FROM piece GROUP BY lang),
    gram AS (
        SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
        FROM piece, range(1, 6) AS kk(k), unnest(generate_series(1, len(ws) - k + 1)) AS u(i)),
    freq AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL),
    cand AS (SELECT * FROM freq WHERE k >= 2 AND f >= 100),
    cut AS (
        SELECT c.lang, c.phrase, c.f AS a, j,
               array_to_string(string_split(c.phrase, ' ')[1 : j], ' ') AS lp,
               array_to_string(string_split(c.phrase, ' ')[j + 1 :], ' ') AS rp
        FROM cand AS c, range(1, 5) AS jj(j) WHERE j < c.k),
    scored AS (
        SELECT cut.lang, cut.phrase, a, j, fl.f AS l, fr.f AS r, n,
               (CAST(1000 AS HUGEINT) * a * n) // (CAST(fl.f AS HUGEINT) * fr.f) AS score
        FROM cut JOIN freq AS fl ON fl.lang = cut.lang AND fl.phrase = lp
                 JOIN freq AS fr ON fr.lang = cut.lang AND fr.phrase = rp JOIN total ON total.lang = cut.lang),
    best AS (
        SELECT * FROM scored
        QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inner_ AS (
        SELECT lang, array_to_string(string_split(phrase, ' ')[1 : k - 1], ' ') AS part, f FROM freq WHERE k >= 3
        UNION ALL
        SELECT lang, array_to_string(string_split(phrase, ' ')[2 :], ' '), f FROM freq WHERE k >= 3),
    kept AS (
        SELECT * FROM best AS b
        WHERE NOT EXISTS (SELECT 1 FROM inner_ AS i WHERE i.lang = b.lang AND i.part = b.phrase AND i.f >= b.a)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM kept)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
           CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked WHERE rank <= 2000
"""


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_preference_format": op8_preference_format,
    "op9_token_matrix": op9_token_matrix,
    "op10_fingerprint": op10_fingerprint,
    "op11_secrets": op11_secrets,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}
_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op4_url_filter": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_jaccard_join": OP6_SQL,
    "op8_preference_format": OP8_SQL, "op11_secrets": OP11_SQL,
    "op13_collocations": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
