"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import bpe, merkle, mixing, packing, quality, rolling, secrets, simhash, substrings, toxicity, warc, winnowing, wordpieces
from basalt.llm.store import new_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wordpieces.count_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(_table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.train(spark))
    return found.select("doc_id", "word_at", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "probability", "is_secret")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.id_digest().alias("ids_sha256"), "ids")
    return bpe.decode(told, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, when = merkle.tampered()
    got = merkle.manifest(_table(spark, sf_dir, "documents"), changed=changed, when=when)
    proof = F.sha2(F.array_join("proof.siblings", ""), 256).alias("proof_sha256")
    return got.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


#: CRC-32 of the digits of x, with the table of one byte's steps.
_CRC_STEP = "list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC_TABLE = f"crc AS (SELECT list_transform(range(256), lambda i: {_CRC_STEP}) AS tab)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda k: ascii(substr({x}, k, 1))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _op12_sql(levels: int = 5, top_levels: int = 3) -> str:
    """Trees by levels: up to 16 ** levels rows a source and 16 ** top_levels sources."""
    told = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(told, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        _CRC_TABLE,
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC.format(x='CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS copy FROM documents, crc)",
        "s0 AS (SELECT source AS g, doc_id, leaf, copy, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "a0 AS (SELECT g, i, n, leaf AS node FROM s0)",
    ]

    def tree(t: str, height: int) -> None:
        for k in range(height):
            ctes.append(f"{t}{k + 1} AS (SELECT g, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node FROM {t}{k} GROUP BY g, i // 16)")

    def path(t: str, height: int, rows: str, keep: str, start: str) -> str:
        """CTEs that walk each of rows up the tree t, with the siblings so far and the folded node; the last one's name."""
        ctes.append(f"{t}p0 AS (SELECT {keep}, g, i, n, '' AS proof, {start} AS f FROM {rows})")
        for k in range(height):
            others = lambda cmp: f"coalesce((SELECT string_agg(x.node, '' ORDER BY x.i) FROM {t}{k} x WHERE x.g IS NOT DISTINCT FROM r.g AND x.i // 16 = r.i // 16 AND x.i {cmp} r.i), '')"
            ctes.append(f"{t}q{k} AS (SELECT r.*, CASE WHEN n > 1 THEN {others('<')} ELSE '' END AS lo, CASE WHEN n > 1 THEN {others('>')} ELSE '' END AS hi FROM {t}p{k} r)")
            ctes.append(f"{t}p{k + 1} AS (SELECT {keep}, g, i // 16 AS i, (n + 15) // 16 AS n, proof || lo || hi AS proof, CASE WHEN n > 1 THEN sha256(lo || f || hi) ELSE f END AS f FROM {t}q{k})")
        return f"{t}p{height}"

    tree("a", levels)
    ctes.append(f"b0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, node FROM a{levels})")
    tree("b", top_levels)
    end = path("a", levels, "s0", "doc_id, leaf", "copy")
    ctes.append(f"u AS (SELECT e.doc_id, e.leaf, b.name, b.node AS subroot, b.g, b.i, b.n, e.proof AS before, e.f AS part FROM {end} e JOIN b0 b ON e.g IS NOT DISTINCT FROM b.name)")
    end = path("b", top_levels, "u", "doc_id, leaf, subroot, before", "part")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT node FROM b{top_levels}) AS root, sha256(before || proof) AS proof_sha256, f AS folded_root, f = (SELECT node FROM b{top_levels}) AS verified FROM {end}"


OP12_SQL = _op12_sql()


def op13_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.document_windows(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


OP13_SQL = f"""
WITH {_CRC_TABLE}, t AS (SELECT doc_id, source, lang, length(text) AS n, CAST(60 * ((doc_id + {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 1000) // 6) AS BIGINT) AS event_s FROM documents, crc),
  w AS (SELECT doc_id, source, event_s, CAST(unnest([1800, 86400]) AS BIGINT) AS window_s FROM t),
  g AS (SELECT w.doc_id, w.window_s, w.event_s, count(t.doc_id) AS n_events, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS sum_chars, count(DISTINCT t.lang) AS n_langs,
    list_sort(coalesce(list(t.n) FILTER (WHERE t.n IS NOT NULL), [])) AS x
    FROM w LEFT JOIN t ON w.source IS NOT DISTINCT FROM t.source AND t.event_s >= w.event_s - w.window_s AND t.event_s < w.event_s GROUP BY ALL)
SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, x[(len(x) + 1) // 2] AS median_chars, x[(99 * len(x) + 99) // 100] AS high_chars FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_warc": op4_warc,
        "op5_toxicity": op5_toxicity,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_source_mixing": op7_source_mixing,
        "op8_token_counts": op8_token_counts,
        "op9_secret_scans": op9_secret_scans,
        "op10_document_fingerprints": op10_document_fingerprints,
        "op11_bpe_encoding": op11_bpe_encoding,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_rolling_windows": op13_rolling_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op12_merkle_manifest": OP12_SQL, "op13_rolling_windows": OP13_SQL}
