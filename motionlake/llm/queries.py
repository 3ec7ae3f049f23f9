"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, toxicity
from .ann import search
from .common import remove, scratch, table
from .decontamination import contaminated
from .infill import fill_in_middle, restore
from .licenses import find_licenses
from .merkle import leaf, prove
from .minhash import near_duplicates
from .secrets_scan import find_secrets
from .sentencepieces import encode_documents
from .tokencounts import section_tokens
from .urlfilter import judge
from .warc import archived_pages


def piece_model() -> str:
    """Where the public SentencePiece model is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on labels whose ids are not held out."""
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.learnable)
    found = toxicity.score_documents(docs, scorer)
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token on a boundary goes where most of its bytes are."""
    import public_tokenizers as public

    found = section_tokens(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, rule="most")
    return found.withColumnRenamed("id", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through WARC archives and back, with revisits of equal payloads."""
    path = scratch(spark, "warc")
    found = archived_pages(table(spark, sf_dir, "pages"), path)
    remove(spark, path)  # what was read back is in a table of its own
    revisit = F.col("response.type") == "revisit"
    return found.select(
        F.col("metadata.fields")["page-id"][0].cast("long").alias("page_id"),
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, F.col("original.fields")["page-id"][0].cast("long")).alias("refers_to"),
    )


#: The rules (host, path, verdict) of the query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the longest rule for every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in every document, with coverage and span."""
    return find_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, 100 * intersection >= 80 * union; one row per document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items, with score and span."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, spans and decoded text of every document, as digests."""
    found = encode_documents(table(spark, sf_dir, "documents"), piece_model(), outputs=("n_tokens", "id_text", "covered", "decoded"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", digest("id_text").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"), F.col("covered").alias("span_bytes"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector among all others."""
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


#: The fields of a leaf, in their order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document; a third of them claim a text with lower-case letters."""
    tampered = leaf(*(F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in LEAF_FIELDS))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)
    return prove(table(spark, sf_dir, "documents"), LEAF_FIELDS, "lang", "doc_id", claimed).withColumnRenamed("id", "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt from that, as digests."""
    found = fill_in_middle(table(spark, sf_dir, "documents"), units="code_points", seed="1")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restore(F.col("output"), F.col("form"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_warc, op4_url_filter, op5_secret_scan, op6_license_scan, op7_minhash_near_dedup, op8_ann, op9_decontamination, op10_sentencepiece, op11_exact_topk, op12_merkle_manifest, op13_fill_in_middle)}

_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"

#: crc32 of a decimal id in DuckDB: bit by bit over its characters.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


def _merkle_sql(levels: int = 9, top_levels: int = 4) -> str:
    """Level by level, for groups of up to 8 ** levels rows and up to 8 ** top_levels groups."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    made = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in LEAF_FIELDS) + ")"
    parts = [
        f"""d AS (SELECT doc_id, lang, {made("text")} AS leaf,
            CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {made(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents)""",
        """r0 AS (SELECT doc_id, lang AS g, leaf, coalesce(other, leaf) AS folded, '' AS proof,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS k FROM d)""",
        "n0 AS (SELECT g, k, leaf AS h, count(*) OVER (PARTITION BY g) AS total FROM r0)",
    ]

    def climb(nodes: str, rows: str, count: int, own: str) -> None:
        for j in range(count):
            run = "PARTITION BY g, k // 8 ORDER BY k ROWS BETWEEN"
            parts.append(f"""{nodes}a{j} AS (SELECT g, k, total, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {nodes}{j})""")
            parts.append(f"""{rows}{j + 1} AS (SELECT {own}, r.g, r.k // 8 AS k, CASE WHEN total = 1 THEN folded ELSE sha256(before || folded || after) END AS folded, proof || before || after AS proof
                FROM {rows}{j} r JOIN {nodes}a{j} n ON r.g IS NOT DISTINCT FROM n.g AND r.k = n.k)""")
            parts.append(f"{nodes}{j + 1} AS (SELECT g, k // 8 AS k, CASE WHEN total = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h, (total + 7) // 8 AS total FROM {nodes}{j} GROUP BY g, k // 8, total)")

    climb("n", "r", levels, "doc_id, leaf")
    parts.append(f"t AS (SELECT g AS of, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS k, count(*) OVER () AS total FROM n{levels})")
    parts.append("m0 AS (SELECT '' AS g, k, h, total FROM t)")
    parts.append(f"s0 AS (SELECT doc_id, leaf, t.h AS subroot, '' AS g, t.k, folded, proof FROM r{levels} r JOIN t ON r.g IS NOT DISTINCT FROM t.of)")
    climb("m", "s", top_levels, "doc_id, leaf, subroot")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM s{top_levels}, (SELECT h FROM m{top_levels})"


ORACLES: dict[str, str] = {
    "op11_exact_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score::BIGINT AS score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op12_merkle_manifest": _merkle_sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op4_url_filter": f"""
        WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        r(rh, rp, rv) AS (VALUES {", ".join(repr(r) for r in URL_RULES)}),
        h AS (SELECT page_id, arg_max(rh || rp, len(string_split(rh, '.')) * 1000 + len(rp)) AS rule, arg_max(rv, len(string_split(rh, '.')) * 1000 + len(rp)) AS verdict
              FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN h USING (page_id)""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        n AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
