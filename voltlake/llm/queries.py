"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, decontaminate, fuzzy_lines, hard_negatives, html_layout, quality, reply_trees, secrets, sentencepiece_lattice, simhash,
    spotsigs, token_prefixes, toxicity,
)
from .common import table
from .labelled import fold


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation of every document, scores and edits of the two next ones, and whether decoding gives it back."""
    return sentencepiece_lattice.encode_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by compression, with dictionaries and calibration from labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "good_bytes", "bad_bytes")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links within three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document and its offending sentences, trained from document labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "offending")


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out in lines."""
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item's words or more, with the item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines, short ones too, that are near copies of a line kept elsewhere."""
    return fuzzy_lines.line_report(table(spark, sf_dir, "documents"), min_chars=1)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature set of every document and of its edited text, their likenesses, and the documents of near-equal sets."""
    return spotsigs.full_report(table(spark, sf_dir, "documents"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once into the ledger."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    own = "named_struct('conv_id', -7L, 'turn', {0}L, 'role', '{1}', 'text', '</s>[INST] ok [/INST]')"
    made = f"inline(array({own.format(0, 'user')}, {own.format(1, 'assistant')}))"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.range(1).selectExpr(made))
    return reply_trees.digests(reply_trees.conversations(reply_trees.linear(turns)))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector of 64 components: 40 centroids, five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), centroids=40, rounds=5, dims=64, scale=256, seed="2:")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth vector, with some labels moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(vectors, every=50, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of its prefixes, against a budget of 512."""
    return token_prefixes.report(table(spark, sf_dir, "documents"), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_quality, op3_spotsigs, op4_secret_ledger, op5_simhash, op6_toxicity, op7_html_layout,
        op8_decontamination, op9_fuzzy_lines, op10_reply_trees, op11_centroids, op12_hard_negatives, op13_token_prefixes,
    )
}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _secret_sql() -> str:
    """Matches and the pieces between them alternate; running sums of their lengths are the places."""
    scans = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS rk, {str(version == 'base-1').lower()} AS base, "
        f"regexp_extract_all(t, {_sql_text(pattern)}) AS m, regexp_extract_all(t, {_sql_text(pattern)}, {group}) AS v, "
        f"string_split_regex(t, {_sql_text(pattern)}) AS s, {least} AS least FROM d"
        for version, rules in secrets.RULES.items() for kind, pattern, group, least in rules
    )
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        scans AS ({scans}),
        matches AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM scans WHERE len(m) > 0),
        spans AS (
            SELECT doc_id, kind, rk, base,
                list_sum(list_transform(s[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b, length(m[i]) AS n
            FROM matches WHERE length(v[i]) >= least),
        named AS (SELECT doc_id, kind, rk, base, b, kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT AS span FROM spans),
        sums AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
                count(*) FILTER (kind = 'hex') AS h, string_agg(span, ',' ORDER BY b, rk) FILTER (base) AS base_spans,
                string_agg(span, ',' ORDER BY b, rk) AS spans
            FROM named GROUP BY doc_id)
        SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
            sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN sums USING (doc_id)"""


_REPLY_SQL = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    marked AS (
        SELECT *, length(role) + 1 + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
            + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS n FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(n)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id"""

def _centroid_sql() -> str:
    """The rounds one after the other; sums of whole numbers below 2^53 are exact in DOUBLE."""
    square = "list_inner_product({0}, {0})"
    parts = ["""
        k AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS cluster, v AS c
            FROM k QUALIFY cluster < 40)"""]
    for r in range(6):
        parts.append(f"""
        a{r} AS MATERIALIZED (
            SELECT vec_id, v, cluster, d FROM (
                SELECT vec_id, v, cluster, {square.format("v")} - 2 * list_inner_product(v, c) + {square.format("c")} AS d FROM k, c{r})
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)""")
        if r < 5:
            parts.append(f"""
        m{r} AS MATERIALIZED (
            SELECT cluster, list(floor((s - ((s % n) + n) % n) / n) ORDER BY pos) AS c FROM (
                SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (
                    SELECT cluster, unnest(v) AS x, unnest(generate_series(1, 64)) AS pos FROM a{r})
                GROUP BY cluster, pos) GROUP BY cluster),
        c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return f"""
        WITH {','.join(parts)}
        SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance,
            (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a5 JOIN c5 USING (cluster)"""


_NEGATIVE_SQL = """
    WITH k AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, k.vec_id, a.label = k.label AS same, list_inner_product(a.v, k.v)::BIGINT AS score
        FROM k AS a JOIN k ON a.vec_id % 50 = 0 AND a.vec_id <> k.vec_id),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
        (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {
    "op4_secret_ledger": _secret_sql(), "op10_reply_trees": _REPLY_SQL, "op11_centroids": _centroid_sql(),
    "op12_hard_negatives": _NEGATIVE_SQL,
}
