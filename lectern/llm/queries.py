"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import (
    byte_bpe, chat, exact_dedup, licenses, merkle, mixing, quality_model, quality_rules,
    rank_profiles, sharding, simhash, tokenizer_spans, url_filter,
)
from lectern.llm.columns import GAP, UPPER
from lectern.llm.registry import query, table

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{GAP}', ' ', 'g') AS norm
  FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)"""


@query("op1_exact_dedup", OP1)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, folder, "documents"))


RATES_SQL = ", ".join(
    f"{{'r': '{name}', 'v': CASE WHEN {bottom} = 0 THEN 0 ELSE {top} * 10000 // {bottom} END}}"
    for name, top, bottom, _ in quality_rules.RATES)
LEAST_SPREAD = " ".join(
    f"WHEN '{name}' THEN {least}" for name, *_, least in quality_rules.RATES)
OP10 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source FROM documents),
w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '{GAP}') IF x <> ''] AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')]
      AS lines FROM d),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2])
    AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1)
  GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars,
    length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(translate(text, '{UPPER}', '')) AS n_capitals
  FROM d JOIN w USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
rates AS (
  SELECT doc_id, lang, source, base_failed, x.r AS rate, x.v AS value
  FROM (SELECT *, unnest([{RATES_SQL}]) AS x FROM based)),
bucketed AS (
  SELECT *, (value >> greatest(length(bin(value)) - 7, 0))
    << greatest(length(bin(value)) - 7, 0) AS bucket FROM rates WHERE NOT base_failed),
levels AS (
  SELECT 0 AS level, lang, source, rate, bucket FROM bucketed
  UNION ALL SELECT 1, lang, '', rate, bucket FROM bucketed
  UNION ALL SELECT 2, '', '', rate, bucket FROM bucketed),
bounds AS (
  SELECT level, lang, source, rate, count(*) AS n,
    quantile_disc(bucket, 0.25) AS low, quantile_disc(bucket, 0.75) AS high
  FROM levels GROUP BY ALL),
fences AS (
  SELECT *, {quality_rules.REACH} * greatest(high - low, CASE rate {LEAST_SPREAD} END) AS spread
  FROM bounds),
chosen AS (
  SELECT o.lang, o.source, o.rate,
    CASE WHEN o.n >= {quality_rules.LEAST_ROWS} THEN o.high + o.spread
      WHEN l.n >= {quality_rules.LEAST_ROWS} THEN l.high + l.spread
      ELSE t.high + t.spread END AS most,
    CASE WHEN o.n >= {quality_rules.LEAST_ROWS} THEN o.low - o.spread
      WHEN l.n >= {quality_rules.LEAST_ROWS} THEN l.low - l.spread
      ELSE t.low - t.spread END AS least
  FROM fences o JOIN fences l ON l.level = 1 AND l.lang = o.lang AND l.rate = o.rate
  JOIN fences t ON t.level = 2 AND t.rate = o.rate WHERE o.level = 0),
outside AS (
  SELECT doc_id, bool_or(value > most OR (rate = 'length' AND value < least)) AS bad
  FROM rates JOIN chosen USING (lang, source, rate) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM based LEFT JOIN outside USING (doc_id)"""


@query("op10_quality_rules", OP10)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_report(table(spark, folder, "documents"))


#: Production mix: large sources give way to small ones (a source's share is its tokens to
#: the power 0.7), while languages and topics keep the shares that they have.
TARGETS = mixing.Targets(
    every=("source", "lang"), topic={"legal": None, "contact": None}, temper={"source": 0.7},
    marks={"legal": ("license", "licensed", "copyright", "all rights reserved"),
           "contact": ("@", "http://", "https://", "www.")})


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"), TARGETS)


@query("op9_quality_model")
def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels"))


SHARDS = 16


@query("op3_sharding")
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(table(spark, folder, "documents"), [1.0] * SHARDS)


RULES = [url_filter.Rule.parse(verdict, text) for verdict, text in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"))]


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), RULES)


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


#: A conversation whose texts hold the template's own marks.
TRICKY = r"\### Assistant: </turn> ok"
OP7 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
m AS (
  SELECT *, 6 + length(role) + length(text) + 8
    + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum([length(x) - 2 FOR x IN regexp_extract_all(text, '#{{3,}}')]), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(length(loss)) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256,
  sum(chars) AS formatted_chars FROM m GROUP BY conv_id"""


@query("op7_chat_format", OP7)
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)],
        "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(chat.event_log(rows.union(tricky))))


@query("op11_tokenizer_spans")
def op11_tokenizer_spans(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer_spans.alignment_report(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


#: The table of CRC-32, and that of doc_id as text.
CRC_TABLE = """
crc_table AS (
  SELECT b, 0 AS k, b::UBIGINT AS v FROM range(256) AS r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM crc_table WHERE k < 8),
crc_list AS (SELECT list(v ORDER BY b) AS t FROM crc_table WHERE k = 8)"""
CRC = """xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda crc, c: xor(crc >> 8, t[(xor(crc, c) & 255)::INT + 1])))"""
OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
    {CRC} % {rank_profiles.FOLDS} = {rank_profiles.HELD_OUT} AS held_out
  FROM documents, crc_list),
w AS (
  SELECT doc_id, any_value(lang) AS lang, held_out, ' ' || word || ' ' AS p, count(*) AS n
  FROM (SELECT doc_id, lang, held_out,
    unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM d)
  GROUP BY doc_id, held_out, word),
g AS (
  SELECT doc_id, any_value(lang) AS lang, held_out, gram, sum(n) AS n FROM (
    SELECT doc_id, lang, held_out, n, unnest(list_concat(
      p[2:-2].string_split(''),
      {", ".join(f"[p[i:i + {n - 1}] FOR i IN range(1, length(p) - {n - 2})]"
                 for n in range(2, rank_profiles.LONGEST + 1))})) AS gram FROM w)
  GROUP BY doc_id, held_out, gram),
learned AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place
  FROM (SELECT lang, gram, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL
    GROUP BY lang, gram)
  QUALIFY place < {rank_profiles.PROFILE}),
own AS (
  SELECT doc_id, gram, rank() OVER (PARTITION BY doc_id ORDER BY n DESC) - 1 AS place FROM g
  QUALIFY place < {rank_profiles.PROFILE}),
sizes AS (SELECT doc_id, count(*) * {rank_profiles.PROFILE} AS most FROM own GROUP BY doc_id),
nearer AS (
  SELECT doc_id, lang, sum({rank_profiles.PROFILE}
    - least(abs(own.place - learned.place), {rank_profiles.PROFILE})) AS n
  FROM own JOIN learned USING (gram) GROUP BY doc_id, lang),
distances AS (
  SELECT s.doc_id, l.lang, most - coalesce(n, 0) AS away
  FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM learned) l
  LEFT JOIN nearer USING (doc_id, lang)),
best AS (
  SELECT doc_id, list(lang ORDER BY away, lang) AS names, list(away ORDER BY away, lang) AS away
  FROM distances GROUP BY doc_id)
SELECT d.doc_id, held_out, coalesce(names[1], '{rank_profiles.UNKNOWN}') AS lang_pred,
  coalesce(CASE WHEN coalesce(away[2], most) > 0
    THEN 1.0::DOUBLE - away[1]::DOUBLE / coalesce(away[2], most)::DOUBLE ELSE 0 END, 0)::DOUBLE
    AS score
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


@query("op12_rank_profiles", OP12)
def op12_rank_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return rank_profiles.language_report(table(spark, folder, "documents"))


def _fields(n_chars: str) -> str:
    return " || ".join(
        f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"
        for value in ("doc_id", "source", "lang", n_chars, "text"))


def _tree(name: str, leaves: str) -> str:
    """Levels (g, lvl, pos, node, n) over leaves (g, pos, node, n)."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, pos, node, n FROM ({leaves})
  UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2)"""


def _steps(name: str, levels: str, leaves: str) -> str:
    """The siblings (id, k, step) of leaves (id, g, pos)."""
    return f"""
{name} AS (
  SELECT id, own.lvl AS k, CASE WHEN other.node IS NULL THEN ''
    WHEN other.pos < own.pos THEN 'L' || other.node ELSE 'R' || other.node END AS step
  FROM ({leaves}) p JOIN {levels} own ON own.g = p.g AND own.n > 1 AND own.pos = p.pos >> own.lvl
  LEFT JOIN {levels} other ON other.g = p.g AND other.lvl = own.lvl
    AND other.pos = xor(own.pos, 1::BIGINT))"""


OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_fields("n_chars")}) AS leaf,
    CASE WHEN {CRC} % {merkle.TAMPER} = 0 THEN sha256({_fields("(n_chars + 1)")}) END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crc_list),
{_tree("low", "SELECT g, pos, leaf AS node, n FROM d")},
tops AS (
  SELECT g AS lang, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
  FROM low WHERE n = 1),
{_tree("high", "SELECT 0 AS g, pos, node, n FROM tops")},
{_steps("inner_steps", "low", "SELECT doc_id AS id, g, pos FROM d")},
{_steps("outer_steps", "high", "SELECT lang AS id, 0 AS g, pos FROM tops")},
steps AS (
  SELECT id AS doc_id, k, step FROM inner_steps
  UNION ALL SELECT doc_id, 1000 + k, step FROM outer_steps JOIN d ON d.g = id),
paths AS (SELECT doc_id, list(step ORDER BY k) AS path FROM steps GROUP BY doc_id),
f AS (
  SELECT d.doc_id, leaf, tops.node AS subroot, high.node AS root,
    sha256(array_to_string([s[2:] FOR s IN path], '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), path), lambda a, s:
      CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM d JOIN tops ON tops.lang = d.g JOIN high ON high.n = 1
  LEFT JOIN (SELECT doc_id, path FROM paths) p ON p.doc_id = d.doc_id)
SELECT *, folded_root = root AS verified FROM f"""


@query("op13_merkle_manifest", OP13)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.proof_report(table(spark, folder, "documents"))
