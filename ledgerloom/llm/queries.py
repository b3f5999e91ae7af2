"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, fim, htmltext, langid, licenses, linejoin, media, merkle, sharding, simhash, spotsigs, toxicity
from .common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbours(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_line_dedup,
        op3_toxicity,
        op4_benchmark_decontamination,
        op5_html_extraction,
        op6_sharding,
        op7_media_columns,
        op8_byte_bpe,
        op9_language_id,
        op10_license_scan,
        op11_merkle_manifest,
        op12_spotsigs,
        op13_fill_in_middle,
    )
}

OP4_SQL = r"""
WITH folded AS (
  SELECT doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, row, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT row, i, n, item_id FROM places JOIN windows USING (n, words)),
hits AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY row),
names AS (SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, item_id::VARCHAR AS name FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN names USING (row)
"""


def h_sql(text: str) -> str:
    """The leaf digest of merkle.leaf over a text expression."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    return "sha256(concat(" + ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def up_sql(name: str, base: str) -> str:
    """Nodes (grp, level, pos, h, n) over a table of the lowest ones."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, pos, h, n FROM {base}
  UNION ALL SELECT grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 3, n)"""


def beside_sql(first: int, leaves: str, nodes: str) -> str:
    """Per document and level the hashes before and after its node."""
    return f"""SELECT row, {first} + level AS l, coalesce(string_agg(h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM (SELECT row, grp, level, place // CAST(3 ** level AS BIGINT) AS pos FROM {leaves} JOIN (SELECT DISTINCT grp, level FROM {nodes} WHERE n > 1) USING (grp)) a
  JOIN {nodes} b USING (grp, level) WHERE a.pos // 3 = b.pos // 3 GROUP BY ALL"""


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, '') AS grp, {h_sql("text")} AS leaf, {h_sql("replace(text, chr(10), '')")} AS other, row_number() OVER () AS row,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM d),
base AS (SELECT grp, place AS pos, leaf AS h, n FROM leaves),
{up_sql("low", "base")},
subroots AS (SELECT grp AS source, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
tops AS (SELECT 0 AS grp, pos, h, n FROM subroots),
{up_sql("high", "tops")},
heads AS (SELECT row, 0 AS grp, s.pos AS place FROM leaves JOIN subroots s ON source = leaves.grp),
steps AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY l) AS i FROM ({beside_sql(0, "leaves", "low")} UNION ALL {beside_sql(100, "heads", "high")})),
folds AS (
  SELECT row, 0 AS i, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN other ELSE leaf END AS h FROM leaves
  UNION ALL SELECT row, f.i + 1, sha256(before || h || after) FROM folds f JOIN steps USING (row) WHERE steps.i = f.i + 1),
proofs AS (SELECT row, count(*) AS n_steps, string_agg(before || after, '' ORDER BY i) AS beside FROM steps GROUP BY row),
folded AS (SELECT row, arg_max(h, i) AS folded_root FROM folds GROUP BY row)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(coalesce(beside, '')) AS proof_sha256, folded_root, CAST(coalesce(n_steps, 0) AS INT) AS n_steps, folded_root = r.h AS verified
FROM leaves JOIN subroots s ON source = leaves.grp CROSS JOIN (SELECT h FROM high WHERE n = 1) r JOIN folded USING (row) LEFT JOIN proofs USING (row)
"""

WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS row FROM documents),
pairs AS (SELECT doc_id, row, text, coalesce(lead(row) OVER (ORDER BY row), 1) AS following, coalesce(lead(text) OVER (ORDER BY row), first_value(text) OVER (ORDER BY row)) AS after FROM d),
texts AS (
  SELECT row, 0 AS kind, text FROM pairs
  UNION ALL SELECT row, 1, left(text, length(text) - length(text) // 2) || left(after, length(text) // 2) FROM pairs),
words AS (SELECT row, kind, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT row, kind, {WORDS_SQL} AS w FROM texts) WHERE len(w) > 0),
kinds AS (SELECT *, word IN ({", ".join(f"'{w.decode()}'" for w in sorted(spotsigs.ANCHORS))}) OR sha256(word)[1] = '0' AS anchor FROM words),
content AS (SELECT row, kind, list(word ORDER BY i) AS c FROM kinds WHERE NOT anchor GROUP BY ALL),
places AS (SELECT row, kind, word, anchor, sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY row, kind ORDER BY i)::BIGINT AS k FROM kinds),
found AS (SELECT DISTINCT row, kind, concat_ws(' ', word, c[k + 1], c[k + 2]) AS mark FROM places JOIN content USING (row, kind) WHERE anchor AND k + 2 <= len(c)),
marks AS (SELECT * FROM found UNION ALL SELECT DISTINCT row, kind, '^ ' || array_to_string(w[1:2], ' ') FROM words ANTI JOIN found USING (row, kind)),
prints AS (SELECT row, kind, count(m.mark) AS n, count(m.mark) || ':' || sha256(coalesce(string_agg(m.mark, chr(10) ORDER BY m.mark), '')) AS fp FROM texts LEFT JOIN marks m USING (row, kind) GROUP BY ALL),
near AS (
  SELECT p.row, 1 AS kind, count(*) AS hits FROM pairs p JOIN marks a ON a.row = p.row AND a.kind = 0 JOIN marks b ON b.row = p.row AND b.kind = 1 AND a.mark = b.mark GROUP BY ALL
  UNION ALL SELECT p.row, 0, count(*) FROM pairs p JOIN marks a ON a.row = p.row AND a.kind = 0 JOIN marks b ON b.row = p.following AND b.kind = 0 AND a.mark = b.mark GROUP BY ALL),
alike AS (
  SELECT p.row, b.kind, CASE WHEN a.n = 0 OR b.n = 0 THEN CAST(a.n = b.n AS DOUBLE) WHEN coalesce(hits, 0) / CAST(a.n + b.n - coalesce(hits, 0) AS DOUBLE) >= {spotsigs.LEAST} THEN hits / CAST(a.n + b.n - hits AS DOUBLE) ELSE 0.0 END AS j
  FROM pairs p JOIN prints a ON a.row = p.row AND a.kind = 0 JOIN prints b ON (b.kind = 1 AND b.row = p.row) OR (b.kind = 0 AND b.row = p.following) LEFT JOIN near h ON h.row = p.row AND h.kind = b.kind)
SELECT p.doc_id, CAST(length(p.text) AS BIGINT) AS n_chars, sha256(t.text) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, x.j AS near_edited, y.j AS near_next
FROM pairs p JOIN texts t ON t.row = p.row AND t.kind = 1 JOIN prints a ON a.row = p.row AND a.kind = 0 JOIN prints b ON b.row = p.row AND b.kind = 1
JOIN alike x ON x.row = p.row AND x.kind = 1 JOIN alike y ON y.row = p.row AND y.kind = 0
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '-')) AS x FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op6_sql() -> str:
    names = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]
    owners = ",".join(map(str, sharding.lookup(names)))
    return f"""
WITH owners AS (SELECT string_split('{owners}', ',') AS o),
placed AS (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(o[slot + 1], 3, '0') AS shard FROM placed, owners
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": OP4_SQL, "op6_sharding": op6_sql(), "op11_merkle_manifest": OP11_SQL, "op12_spotsigs": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
