"""The queries of this subpackage: each applies one operator to its whole table.

``queries()`` maps names to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` holds the
DuckDB SQL of those that SQL can state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkpul.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    fingerprints,
    huffman,
    infill,
    lm,
    merkle,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    urls,
)
from sparkpul.llm.common import table
from sparkpul.session import scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log10 probabilities of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a network trained on the labelled ones."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to, as digests."""
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without its bytes in 400-byte strings that start elsewhere too."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.digests(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))


#: the rules of operator 7: host, path, verdict
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the listed rules on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parsed AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p) AS k
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with what their ownership frequency adds."""
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def _matches_sql(kind: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT n, owner, repository, {kind} AS kind, {least} AS least, regexp_extract_all(t, '{p}', 0) AS hits,
       regexp_extract_all(t, '{p}', {group}) AS found, string_split_regex(t, '{p}') AS gaps FROM docs"""


#: a match starts after the pieces and the matches before it
OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repository FROM documents),
hits AS ({" UNION ALL ".join(_matches_sql(i, *k[1:]) for i, k in enumerate([*secrets.KINDS, secrets.OPAQUE]))}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hits WHERE len(hits) > 0),
spans AS (
  SELECT n, owner, repository, kind, found[i] AS v,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS w
  FROM each WHERE length(found[i]) >= least),
placed AS (SELECT n, owner, repository, kind, v, a::BIGINT AS a, (a + w)::BIGINT AS b FROM spans),
kept AS (
  SELECT * FROM placed WHERE kind < 3
  UNION ALL
  SELECT o.* FROM placed o WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT regexp_matches(v, '{secrets.UUID}')
    AND len(list_filter(string_split_regex(v, '{secrets.SEPARATORS}'), lambda x: NOT regexp_matches(x, '{secrets.PLAIN_PART}'))) > 0
    AND NOT EXISTS (SELECT 1 FROM placed x WHERE x.n = o.n AND x.kind < 3 AND x.a < o.b AND o.a < x.b)),
owners AS (
  SELECT v, count(DISTINCT owner) <= {secrets.MAX_OWNERS} AND count(DISTINCT (owner, repository)) <= {secrets.MAX_REPOSITORIES} AS live
  FROM kept GROUP BY v),
judged AS (
  SELECT kept.*, live,
         ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || a || ':' || b AS said
  FROM kept JOIN owners USING (v) WHERE kind < 3 OR live),
told AS (
  SELECT n, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(said, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base,
         string_agg(said, ',' ORDER BY a, kind) AS spans,
         count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM judged GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN told USING (n)
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Huffman-coded files and read back."""
    path = scratch_path(spark, "op9-files")
    huffman.write_token_files(table(spark, sf_dir, "documents"), path)
    return huffman.digests(huffman.read_token_files(spark, path))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents: every pair at containment 0.8 or more."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')
  FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS item_shingles FROM shingles WHERE kind = 'b')
SELECT d.id AS doc_id, item_id, count(*) AS matched, any_value(item_shingles) AS item_shingles,
       count(*) / any_value(item_shingles) AS containment
FROM (SELECT id, s FROM shingles WHERE kind = 'd') d JOIN items USING (s)
GROUP BY ALL HAVING count(*) >= 0.8 * any_value(item_shingles)
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf digest, subroot, root and proof of every document, and what tampering breaks."""
    return merkle.digests(merkle.document_manifest(table(spark, sf_dir, "documents")))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda acc, _: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS crc_table),
said AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, doc_id, lang, n_chars,
         concat_ws('', coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'),
                coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS front,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS back,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
           lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda acc, c: xor(acc >> 8, crc_table[xor(acc & 255, c) + 1]))) AS crc
  FROM documents, crc),
leaves AS (
  SELECT pos, doc_id, lang, sha256(front || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
         CASE WHEN crc % 7 = 0
              THEN sha256(front || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || back) END AS altered
  FROM said),
lower_nodes AS (
  SELECT lang, 0 AS lvl, pos AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
  FROM lower_nodes WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM lower_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS lvl, g AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
  FROM upper_nodes WHERE n > 1 GROUP BY lvl, i // 2, n),
all_nodes AS (
  SELECT g, lvl, i, h, n FROM lower_nodes JOIN subroots ON lower_nodes.lang IS NOT DISTINCT FROM subroots.lang
  UNION ALL
  SELECT -1, lvl, i, h, n FROM upper_nodes),
heights AS (SELECT g, max(lvl) AS height FROM all_nodes GROUP BY g),
steps AS (
  SELECT leaves.pos, s.g, w.lvl, 0 AS part, (leaves.pos >> w.lvl) AS at, s.g AS tree
  FROM leaves JOIN subroots s ON leaves.lang IS NOT DISTINCT FROM s.lang
  JOIN heights ON heights.g = s.g, unnest(range(heights.height)) AS w(lvl)
  UNION ALL
  SELECT leaves.pos, s.g, w.lvl, 1, (s.g >> w.lvl), -1
  FROM leaves JOIN subroots s ON leaves.lang IS NOT DISTINCT FROM s.lang
  JOIN heights ON heights.g = -1, unnest(range(heights.height)) AS w(lvl)),
proofs AS (
  SELECT steps.pos, steps.g, list({'odd': steps.at % 2, 'h': coalesce(x.h, '')} ORDER BY part, steps.lvl) AS proof
  FROM steps LEFT JOIN all_nodes x ON x.g = steps.tree AND x.lvl = steps.lvl AND x.i = xor(steps.at, 1)
  GROUP BY ALL),
rooted AS (
  SELECT leaves.doc_id, leaves.leaf, s.subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, coalesce(proof, []) AS proof,
         coalesce(altered, leaf) AS start
  FROM leaves JOIN subroots s ON leaves.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN proofs ON proofs.pos = leaves.pos AND proofs.g = s.g),
folded AS (
  SELECT * EXCLUDE (proof, start), sha256(list_aggregate(list_prepend('', list_transform(proof, lambda x: x.h)), 'string_agg', '')) AS proof_sha256,
         list_reduce(list_prepend({'odd': 0::BIGINT, 'h': start}, proof), lambda acc, x:
           {'odd': 0::BIGINT, 'h': sha256(CASE WHEN x.odd = 1 THEN x.h || acc.h ELSE acc.h || x.h END)}).h AS folded_root
  FROM rooted)
SELECT *, folded_root = root AS verified FROM folded
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt from that."""
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH said AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         list_transform(range(4), lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 8 * i + 1, 8))::BIGINT) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a,
         greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM said),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
         array_to_string(u[b + 1:], '') AS s
  FROM drawn),
done AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
         CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
         CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o
  FROM parts)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o
         WHEN 'psm' THEN substr(o, 4, instr(o, '<S>') - 4) || substr(o, instr(o, '<M>') + 3)
              || substr(o, instr(o, '<S>') + 3, instr(o, '<M>') - instr(o, '<S>') - 3)
         ELSE substr(o, instr(o, '<P>') + 3, instr(o, '<M>') - instr(o, '<P>') - 3) || substr(o, instr(o, '<M>') + 3)
              || substr(o, 4, instr(o, '<P>') - 4) END) AS restored_sha256
FROM done
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts, taken into a fresh digest index."""
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "op13-index"))
    exact_dedup.load(index, table(spark, sf_dir, "documents"))
    return exact_dedup.digests(index.decisions())


OP13_SQL = """
WITH said AS (
  SELECT doc_id, row_number() OVER () AS n,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, n) = 1 AS kept, text_sha256
FROM said
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_lm_scores": op2_lm_scores,
        "op3_quality": op3_quality,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_url_filter": op7_url_filter,
        "op8_secret_scan": op8_secret_scan,
        "op9_token_files": op9_token_files,
        "op10_decontamination": op10_decontamination,
        "op11_merkle": op11_merkle,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filter": OP7_SQL,
        "op8_secret_scan": OP8_SQL,
        "op10_decontamination": OP10_SQL,
        "op11_merkle": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
        "op13_exact_dedup": OP13_SQL,
    }
