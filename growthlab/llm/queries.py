"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlab.llm import align, ctw, fim, licenses, linkgraph, mixing, neardup, packing, quality, quotes, search, shards, tokens
from growthlab.llm.store import written

TOKENIZER, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SHARDS, GROWN = [1.0] * 16, [1.0] * 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False, added_tokens=True)


def op2_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    vectors = written(search.quantised(_table(spark, sf_dir, "embeddings")), "vectors")
    return search.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, in its thread."""
    return quotes.link(_table(spark, sf_dir, "conversations"))


def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return ctw.score(_table(spark, sf_dir, "documents"))


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 16, and among 17."""
    return shards.assign(_table(spark, sf_dir, "documents"), SHARDS, GROWN)


def op7_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates of every document."""
    return neardup.groups(_table(spark, sf_dir, "documents"), size=2)


def op8_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return linkgraph.judge(_table(spark, sf_dir, "pages"))


def op9_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.deal(_table(spark, sf_dir, "documents"))


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license labels of every document."""
    return licenses.label(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its form, and the text that the form gives back, as digests."""
    made = fim.transform(_table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens of every document."""
    return align.align(_table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


_ALL = (op1_best_two_fit_packing, op2_robust_quality_rules, op3_exact_top_k_search, op4_quotation_linking, op5_context_tree_scores, op6_hash_tree_shards, op7_hyperminhash_near_dedup, op8_link_graph_filter, op9_splitting_tree_mix, op10_license_diagonals, op11_token_counts, op12_fill_in_middle, op13_cross_tokenizer_alignment)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 20
"""

_OP4 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM m),
v AS (SELECT *, len(regexp_replace(regexp_extract(line, '^(?:\s*>)+'), '[^>]', '', 'g')) AS level FROM l),
o AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY r ORDER BY place), 0) AS below FROM v),
own AS (
  SELECT r, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (level = 0 AND NOT (regexp_matches(line, '(?i)\bwrote:\s*$') AND below > 0)), ''), '^\s+|\s+$', '', 'g') AS own_text,
    count(*) FILTER (level > 0) AS quoted_lines, max(level) AS max_level
  FROM o GROUP BY r
),
units AS (
  SELECT conv_id, turn, unnest(list_distinct(list_concat([replace(own_text, chr(10), ' ')], string_split(own_text, chr(10))))) AS text FROM m JOIN own USING (r) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
first AS (SELECT conv_id, n AS text, min(turn) AS turn FROM (SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '^(?:\s*>)+', '')), '\s+', ' ', 'g')) AS n FROM units) WHERE n <> '' GROUP BY 1, 2),
ever AS (SELECT text, min({'conv_id': conv_id, 'turn': turn}) AS ever FROM first GROUP BY 1),
q AS (SELECT r, conv_id, turn, level, place, place - row_number() OVER (PARTITION BY r, level ORDER BY place) AS run, trim(regexp_replace(lower(regexp_replace(line, '^(?:\s*>)+', '')), '\s+', ' ', 'g')) AS text FROM v WHERE level > 0),
asked AS (
  SELECT conv_id, turn, level, false AS whole, text FROM q
  UNION ALL SELECT conv_id, turn, level, true, trim(regexp_replace(string_agg(text, ' ' ORDER BY place), '\s+', ' ', 'g')) FROM q GROUP BY r, conv_id, turn, level, run
),
found AS (
  SELECT a.conv_id, a.turn, level, coalesce(f.turn < a.turn, false) AS same, whole, len(string_split(a.text, ' ')) AS words,
    CASE WHEN f.turn < a.turn THEN {'conv_id': a.conv_id, 'turn': f.turn} WHEN ever < {'conv_id': a.conv_id, 'turn': a.turn} THEN ever END AS answered
  FROM asked a LEFT JOIN first f ON f.conv_id = a.conv_id AND f.text = a.text LEFT JOIN ever e ON e.text = a.text WHERE a.text <> ''
),
best AS (
  SELECT conv_id, turn, answered FROM (SELECT conv_id, turn, level, same, whole, answered, sum(words) AS words FROM found WHERE answered IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, same DESC, whole DESC, words DESC, answered.conv_id, answered.turn) = 1
),
nodes AS (SELECT DISTINCT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS opens FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
replies AS (
  SELECT n.conv_id, n.turn, answered IS NOT NULL AS linked, CASE WHEN answered IS NOT NULL THEN answered.conv_id WHEN n.turn <> opens THEN n.conv_id END AS reply_conv,
    CASE WHEN answered IS NOT NULL THEN answered.turn WHEN n.turn <> opens THEN opens END AS reply_turn
  FROM nodes n LEFT JOIN best b ON b.conv_id = n.conv_id AND b.turn = n.turn
),
tree AS (
  SELECT conv_id, turn, conv_id AS thread_conv, turn AS thread_turn, CAST(0 AS BIGINT) AS reply_level, [{'conv_id': conv_id, 'turn': turn}] AS path FROM replies WHERE reply_conv IS NULL
  UNION ALL SELECT c.conv_id, c.turn, thread_conv, thread_turn, reply_level + 1, list_append(path, {'conv_id': c.conv_id, 'turn': c.turn}) FROM replies c JOIN tree t ON c.reply_conv = t.conv_id AND c.reply_turn = t.turn
)
SELECT m.conv_id, m.turn, role, own_text, CAST(quoted_lines AS INTEGER) AS quoted_lines, CAST(max_level AS INTEGER) AS max_level, linked, reply_conv, reply_turn, thread_conv, thread_turn, reply_level,
  CASE WHEN thread_conv IS NOT NULL THEN row_number() OVER (PARTITION BY thread_conv, thread_turn ORDER BY path, r) - 1 END AS position
FROM m JOIN own USING (r) LEFT JOIN replies p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN tree t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""

_OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = w.doc_id
"""


def _op10() -> str:
    k = licenses.K
    templates = ", ".join(f"({n}, '{name}', {str(n < len(licenses.PHRASES)).lower()}, string_split('{text}', ' '))" for n, (name, text) in enumerate((*licenses.PHRASES, *licenses.NOTICES)))
    window = lambda words, i: f"array_to_string({words}[{i} + 1:{i} + {k}], ' ')"
    return rf"""
WITH templates(template, label, base, words) AS (VALUES {templates}),
tw AS (SELECT template, label, base, len(words) - {k - 1} AS grams, t, {window("words", "t")} AS g FROM (SELECT *, unnest(range(len(words) - {k - 1})) AS t FROM templates)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, template, label, base, grams, t, p, p - t AS diagonal FROM (SELECT doc_id, p, {window("w", "p")} AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {k - 1})) AS p FROM d)) JOIN tw USING (g)),
diagonals AS (SELECT DISTINCT doc_id, template, base, diagonal FROM h),
starts AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.MAX_SHIFT}, true) THEN 1 ELSE 0 END AS starts FROM diagonals),
spans AS (SELECT doc_id, template, diagonal, sum(starts) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM starts),
judged AS (SELECT doc_id, template, span, label, base, min(p) AS first, max(p) + {k} - min(p) AS length, count(DISTINCT t) AS hits, count(DISTINCT t) / grams AS share, grams FROM h JOIN spans USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, base, grams, span),
verified AS (SELECT * FROM judged WHERE CASE WHEN base THEN share = 1 ELSE share >= {licenses.LEAST_SHARE} AND length <= {licenses.MAX_STRETCH} * (grams + {k - 1}) END),
good AS (
  SELECT * FROM verified n WHERE base OR NOT EXISTS (
    SELECT 1 FROM verified r WHERE NOT r.base AND r.doc_id = n.doc_id AND r.label <> n.label AND n.first < r.first + r.length AND r.first < n.first + n.length AND (r.share > n.share OR r.share = n.share AND r.hits > n.hits)
  )
),
own AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, max(share) AS score,
    array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (base), []))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM good GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN own USING (doc_id)
"""


def _op6() -> str:
    def tree(history: list[list[float]]) -> str:
        return ", ".join(f"({n.level}, {n.place}, {n.parent}, {n.number}, '{n.name}', {n.weight})" for n in shards.nodes(history))

    draw = f"-ln((CAST('0x' || substr(md5(name || '|' || key), 1, {shards.DIGITS}) AS BIGINT) + 0.5) / {16**shards.DIGITS}) / weight"

    def descent(tree: str) -> str:
        steps = [f"{tree}0 AS (SELECT r, key, arg_min(place, {draw}) AS found FROM d, {tree} WHERE level = 0 GROUP BY r, key)"]
        steps += [f"{tree}{k} AS (SELECT r, key, arg_min(place, {draw}) AS found FROM (SELECT r, key, found AS above FROM {tree}{k - 1}) JOIN {tree} ON level = {k} AND parent = above GROUP BY r, key)" for k in (1, 2)]
        return ",\n".join(steps)

    number = lambda tree, k: f"(SELECT number FROM {tree} WHERE level = {k} AND place = {tree}{k}.found)"
    columns = "(level, place, parent, number, name, weight)"
    # the checksum, byte by byte, with a table of 256 remainders made by rule
    return rf"""
WITH a{columns} AS (VALUES {tree([SHARDS])}), b{columns} AS (VALUES {tree([SHARDS, GROWN])}),
c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
{descent("a")},
{descent("b")},
placed AS (
  SELECT doc_id, len(bytes) // 2 + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
    {number("a", 0)} AS region, {number("a", 1)} AS rack, {number("a", 2)} AS shard, {number("b", 2)} AS grown_shard
  FROM d JOIN a0 USING (r) JOIN a1 USING (r) JOIN a2 USING (r) JOIN b2 USING (r), c
)
SELECT doc_id, size, text_crc32, 'key' AS law, region, rack, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""


_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    list_transform(range(4), lambda k: CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * k + 1, 8) AS BIGINT)) AS h
  FROM documents
),
c AS (SELECT *, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS low, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS high FROM d),
p AS (
  SELECT *, array_to_string(lines[:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle, array_to_string(lines[high + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


# as in the operator, for a library whose time is linear anyway
_LINK = r"""(?i)<a\s(?:[^<>]*?[\s"'])?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'\s>/?#]+)"""


def _op8() -> str:
    lit = lambda text: "'" + text.replace("'", "''") + "'"
    rules = ", ".join(f"({lit(rule)}, {lit(verdict)})" for rule, verdict in linkgraph.RULES)
    d, rounds = linkgraph.DAMPING, 150  # 0.85**150 is 3e-11
    host = r"translate(regexp_extract({}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, html, {host.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fits AS (
  SELECT r, arg_max(rule, len(rule)) AS rule FROM p JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY r
),
judged AS (SELECT p.*, f.rule, verdict FROM p LEFT JOIN fits f USING (r) LEFT JOIN rules x ON x.rule = f.rule),
links AS (
  SELECT source, target, count(*) AS n FROM (
    SELECT host AS source, translate(unnest(regexp_extract_all(regexp_replace(html, {lit(linkgraph._COMMENT)}, '', 'g'), {lit(_LINK)}, 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM p
  ) WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2
),
hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT source FROM links UNION SELECT target FROM links),
steps AS (
  SELECT 'trust' AS kind, source AS away, target AS host, n / sum(n) OVER (PARTITION BY source) AS share FROM links
  UNION ALL SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY target) FROM links
),
start AS (
  SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM (
    SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY 1, 2
  )
),
walk AS (
  SELECT 0 AS k, kind, host, seed AS rank FROM start
  UNION ALL
  SELECT k + 1, kind, host, sum(rank) FROM (
    SELECT k, s.kind, s.host, {d} * share * rank AS rank FROM walk w JOIN steps s ON s.kind = w.kind AND s.away = w.host
    UNION ALL SELECT k, s.kind, s.host, (1 - {d}) * seed FROM (SELECT DISTINCT k FROM walk) CROSS JOIN start s
  ) WHERE k < {rounds} GROUP BY k, kind, host
),
ranks AS (
  SELECT host, coalesce(max(part) FILTER (kind = 'trust'), 0.0) AS trust, coalesce(max(part) FILTER (kind = 'distrust'), 0.0) AS distrust
  FROM (SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) * (SELECT count(*) FROM hosts) AS part FROM walk WHERE k = {rounds}) GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust > trust AND distrust >= {linkgraph.LEAST_DISTRUST} THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0.0), 4) AS trust, round(coalesce(distrust, 0.0), 4) AS distrust
FROM judged LEFT JOIN ranks USING (host)
"""


ORACLE_SQL = {
    "op3_exact_top_k_search": _OP3,
    "op4_quotation_linking": _OP4,
    "op7_hyperminhash_near_dedup": _OP7,
    "op6_hash_tree_shards": _op6(),
    "op8_link_graph_filter": _op8(),
    "op10_license_diagonals": _op10(),
    "op12_fill_in_middle": _OP12,
}
