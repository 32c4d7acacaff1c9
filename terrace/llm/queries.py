"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, collocations, decontaminate, fill_middle, license_scan, line_dedup, main_text, near_dedup, packing, quality, suffix_dedup, toxicity, url_filter
from .tables import on_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_path(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), percent=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"), "n_unmatched"
    )


#: Bytes of the smallest chunk that op8 takes out: shorter ones are often single sentences that clean documents share.
CHUNK_LEAST = 80


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.remove_chunks(table(spark, sf_dir, "documents"), least=CHUNK_LEAST).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    dealt = (
        op1_packing, op2_url_filter, op3_near_dedup, op4_suffix_dedup, op5_main_text, op6_quality, op7_license_scan, op8_chunk_dedup, op9_decontamination, op10_line_dedup, op11_fill_middle,
        op12_collocations, op13_toxicity,
    )
    return {f.__name__: f for f in dealt}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT e.b, r FROM reach JOIN e ON e.a = reach.id),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.id LEFT JOIN n ON d.doc_id = n.doc_id
"""

_OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 THEN 1 ELSE 0 END AS cut FROM w SEMI JOIN t ON w.m = t.m),
g AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
o AS (SELECT d.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM d JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""

_OP9 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

_OP10 = f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
s AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, s.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_MARKS, _SEPARATORS = "!#$%&*|<>?~^=_+", "|>-/*=_~#"


def _quoted(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _op6(r: quality.Rules = quality.Rules()) -> str:
    """The counts and the line rules of op6; marks at the ends of words are ASCII ones, as for the operator."""
    split = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {split.format("t")} AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, l, {split.format("l")} AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
k AS (SELECT doc_id, l, len(w) AS n, len(list_distinct(w)) AS u, translate(l, '{_UPPER}', '{_LOWER}') AS low,
  len(list_filter(w, lambda x: regexp_matches(x, '[{quality.STOPS}](?:[\\x00-\\x7F]|[{re.escape(quality.CLOSING).replace("'", "''")}]{{0,3}})$'))) AS stops,
  len(list_filter(w, lambda x: length(x) > 2 AND right(x, 2) IN ({_quoted(2 * m for m in _MARKS)}))) AS marked,
  len(list_filter(w, lambda x: x IN ({_quoted(_SEPARATORS)}))) AS separators,
  length(regexp_replace(l, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(l, '[^a-z]', '', 'g')) AS lower FROM l WHERE len(w) > 0),
f AS (SELECT *, (n >= {r.sentence_words} AND stops = 0) OR marked > CAST({r.max_marked} AS DOUBLE) * n OR separators > CAST({r.max_separators} AS DOUBLE) * n
  OR (n >= {r.sentence_words} AND upper > CAST({r.max_capitals} AS DOUBLE) * (upper + lower)) OR (n >= 30 AND u < CAST({r.min_distinct} AS DOUBLE) * n)
  OR (n <= {r.boilerplate_words} AND len(list_filter([{_quoted(quality.BOILERPLATE)}], lambda p: contains(low, p))) > 0) AS fails FROM k),
s AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, CAST(coalesce(sum(n) FILTER (fails), 0) AS BIGINT) AS lost FROM f GROUP BY doc_id),
o AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN s ON w.doc_id = s.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND n_lost_words <= CAST({r.max_lost} AS DOUBLE) * n_words AS kept FROM b
"""


def _op7() -> str:
    """Sentences, identifiers and rules of op7; the rules are tried one after another by a recursion over their numbers."""
    space = "[\\x20\\x09-\\x0D]"
    steps = [("'https?://[^\\x20\\x09-\\x0D]+'", "' '"), ("'\\b([vV])\\.'", "'\\1' || chr(2)"), (f"'([.!?;]){space}+'", "'\\1' || chr(1)"), (f"'\\n{space}*\\n'", "chr(1)")]
    cut = "text"
    for pattern, by in steps:
        cut = f"regexp_replace({cut}, {pattern}, {by}, 'g')"
    trigger, words = license_scan.TRIGGER.replace("(?iu)", "(?i)"), license_scan.TRIGGER.replace("(?iu)", "(?i)").replace(" ", "[^\\p{L}\\p{N}]+")
    known = ", ".join(f"{{'key': '{key}', 'phrase': ' {phrase} '}}" for key, phrase in license_scan.SENTENCES)
    rules = ", ".join(f"({i}, '{name}', '{''.join(f'<{x}>' for x in ids)}')" for i, (name, ids) in enumerate(license_scan.RULES, 1))
    return f"""
WITH RECURSIVE known AS (SELECT [{known}] AS t),
rules AS (SELECT * FROM (VALUES {rules}) AS r(i, name, ids)),
c AS (SELECT doc_id, replace(unnest(string_split({cut}, chr(1))), chr(2), '.') AS s FROM documents WHERE regexp_matches(text, '{words}')),
p AS (SELECT doc_id, row_number() OVER () AS pos, s FROM c),
n AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.+( |$)', '\\1', 'g')) AS s FROM p),
m AS (SELECT doc_id, pos, coalesce(list_filter(t, lambda k: contains(' ' || s || ' ', k.phrase))[1].key, CASE WHEN regexp_matches(s, '\\blicen[cs]ed?\\b') THEN 'UNKNOWN' END) AS id FROM n, known WHERE regexp_matches(s, '{trigger}')),
q AS (SELECT doc_id, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY pos) AS ids FROM m WHERE id IS NOT NULL GROUP BY doc_id),
a AS (SELECT doc_id, 0 AS i, ids AS rest, CAST([] AS VARCHAR[]) AS found FROM q
  UNION ALL SELECT doc_id, r.i, replace(rest, r.ids, ''), CASE WHEN contains(rest, r.ids) THEN list_append(found, r.name) ELSE found END FROM a JOIN rules r ON r.i = a.i + 1),
z AS (SELECT doc_id, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, length(rest) - length(replace(rest, '<', '')) AS n_unmatched FROM a WHERE i = {len(license_scan.RULES)})
SELECT d.doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_unmatched, 0) AS BIGINT) AS n_unmatched
FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN z ON d.doc_id = z.doc_id
"""


def _op8(bits: int = 5, least: int = CHUNK_LEAST, most: int = 1024) -> str:
    """Gear hashes, chunks and first occurrences of op8; one step of the recursion cuts the next chunk of each text."""
    table = ", ".join(f"('{b:02X}', {g})" for b, g in enumerate(chunk_dedup.GEAR.tolist()))
    hashed = " + ".join(f"((lag(g, {k}) OVER w & {(1 << (32 - k)) - 1}) << {k})" for k in range(chunk_dedup.WINDOW))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
gear AS (SELECT * FROM (VALUES {table}) AS x(b, g)),
b AS (SELECT doc_id, i, g FROM (SELECT doc_id, i, substring(h, 2 * i - 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d)) JOIN gear USING (b)),
p AS (SELECT doc_id, list(i ORDER BY i) AS places FROM (SELECT doc_id, i, {hashed} AS v FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE i >= {chunk_dedup.WINDOW} AND ((v >> {32 - bits}) & {(1 << bits) - 1}) = 0 GROUP BY doc_id),
c AS (SELECT d.doc_id, length(h) // 2 AS size, CAST(NULL AS BIGINT) AS a, CAST(0 AS BIGINT) AS e, coalesce(places, CAST([] AS BIGINT[])) AS places FROM d LEFT JOIN p ON d.doc_id = p.doc_id
  UNION ALL SELECT doc_id, size, e, coalesce(CASE WHEN later[1] - e <= {most} THEN later[1] END, least(size, e + {most})), later
  FROM (SELECT doc_id, size, e, list_filter(places, lambda x: x >= e + {least}) AS later FROM c WHERE e < size)),
k AS (SELECT c.doc_id, a, e, md5(substring(h, 2 * a + 1, 2 * (e - a))) AS m FROM c JOIN d ON c.doc_id = d.doc_id WHERE a IS NOT NULL),
f AS (SELECT *, e - a >= {least} AND row_number() OVER (PARTITION BY m ORDER BY doc_id, a) > 1 AS gone FROM k),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY a), FALSE) AS opens FROM f),
o AS (SELECT r.doc_id, sum(e - a) FILTER (gone) AS removed, count(*) FILTER (opens) AS spans, string_agg(substring(h, 2 * a + 1, 2 * (e - a)), '' ORDER BY a) FILTER (NOT gone) AS kept FROM r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""


_OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substring(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substring(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || substring(h, 17, 8) AS BIGINT) % 100 AS k, CAST('0x' || substring(h, 25, 8) AS BIGINT) % 100 AS s FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS z FROM r)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""


_OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, string_split(g, ' ') AS w, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT * FROM f WHERE f >= 10),
c AS (SELECT lang, k, g, f AS a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM o WHERE k > 1)),
s AS (SELECT c.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c JOIN o x ON c.lang = x.lang AND c.x = x.g JOIN o y ON c.lang = y.lang AND c.y = y.g),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
m AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM o WHERE k = 3) GROUP BY lang, g),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM b LEFT JOIN m ON b.lang = m.lang AND b.g = m.g WHERE m.f IS NULL OR 100 * m.f < 50 * a)
SELECT t.lang, rank, g AS phrase, a, l, r, n, score FROM t JOIN n ON t.lang = n.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_dedup": _OP3, "op4_suffix_dedup": _OP4, "op6_quality": _op6(), "op7_license_scan": _op7(), "op8_chunk_dedup": _op8(), "op9_decontamination": _OP9, "op10_line_dedup": _OP10, "op11_fill_middle": _OP11,
        "op12_collocations": _OP12,
    }
