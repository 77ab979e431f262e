"""Common table expressions of the check SQL, one per production entity."""

FRAGMENTS = """fragments AS (
  SELECT l_orderkey AS job_id, l_linenumber AS chapter_number,
    'Chapter ' || l_linenumber AS chapter_title,
    CASE WHEN l_returnflag = 'A' THEN 'ready'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed'
         WHEN l_returnflag = 'R' THEN 'warning'
         WHEN l_linestatus = 'F' THEN 'generating' ELSE 'pending' END AS status,
    CAST(l_quantity * 1000 AS BIGINT) AS duration_ms,
    CAST(l_quantity * 1000 AS BIGINT) * 24 AS samples,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
      l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
      l_linestatus, l_shipdate) AS ordinal,
    l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
      l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
      l_linestatus, l_shipdate) AS id
  FROM lineitem)"""

JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS book_id,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running'
      ELSE 'completed' END AS status,
    o_orderdate AS created_at,
    o_custkey % (SELECT count(*) FROM supplier) AS voice_id
  FROM orders)"""

ATTEMPTS = """attempts AS (
  SELECT user_id AS fragment_id, event_id, ts AS completed_at,
    CASE event_type WHEN 'click' THEN 'transcript_mismatch' WHEN 'view' THEN 'audio_warning'
      WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready'
      WHEN 'signup' THEN 'text_edited' END AS code,
    CAST(round(value * 1000) AS BIGINT) AS processing_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
  FROM events)"""

ACTIONS = """actions AS (
  SELECT user_id AS fragment_id, event_id, ts AS happened_at,
    CASE event_type WHEN 'view' THEN 'start'
      WHEN 'purchase' THEN ['complete', 'approve', 'auto_retry', 'manual_retry'][event_id % 4 + 1]
      WHEN 'click' THEN ['complete_with_warning', 'complete_with_audio_warning'][event_id % 2 + 1]
      WHEN 'error' THEN ['fail', 'manual_edit', 'cancel_retry'][event_id % 3 + 1]
      WHEN 'signup' THEN ['manual_retry', 'restore', 'ai_rewrite', 'ai_rewrite_same',
        'cancel_retry'][event_id % 5 + 1] END AS action
  FROM events)"""

REVISIONS = """revisions AS (
  SELECT conv_id || ':' || (turn + 1) AS id, conv_id AS fragment_id,
    turn + 1 AS revision_number,
    CASE WHEN turn = 0 THEN 'original' WHEN role = 'user' THEN 'manual'
         WHEN role = 'assistant' THEN 'ai' ELSE 'restore' END AS source,
    text, CASE WHEN turn > 0 THEN conv_id || ':' || turn END AS parent_id
  FROM conversations)"""

REWRITES = r"""rewrites AS (
  SELECT item_id, text AS original, 'punctuation' AS reason,
    CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN upper(text)
      WHEN 2 THEN regexp_replace(text, '\.$', '!')
      ELSE regexp_replace(text, '^\S+ ', '') END AS rewritten
  FROM benchmark)"""

SPACE = r"[\s\x0b\x{85}\p{Z}]+"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}', ' ', 'g'))"


def folded(text: str) -> str:
    return f"replace(lower(nfc_normalize({text})), 'ß', 'ss')"


def comparison_form(text: str) -> str:
    return rf"trim(regexp_replace({folded(text)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


PLAIN_WORD = r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+[^\p{L}\p{N}]*$"

TRANSCRIPTS = f"""doc_words AS (
  SELECT doc_id, lang, text, string_split({collapsed('text')}, ' ') AS words FROM documents),
transcripts AS (
  SELECT doc_id, lang, text AS expected,
    CASE doc_id % 4 WHEN 0 THEN text
      WHEN 1 THEN translate(upper(text), '.!,', '   ')
      WHEN 2 THEN array_to_string(list_filter(words, lambda w, i: i % 17 <> 0
        OR NOT regexp_matches(w, '{PLAIN_WORD}')), ' ')
      ELSE array_to_string(list_transform(words, lambda w, i: CASE WHEN i % 23 = 0
        AND regexp_matches(w, '{PLAIN_WORD}') THEN 'zz' ELSE w END), ' ') END AS transcript,
    CASE WHEN doc_id % 4 = 2 THEN len(list_filter(words, lambda w, i: i % 17 = 0
        AND regexp_matches(w, '{PLAIN_WORD}'))) ELSE 0 END AS dropped,
    CASE WHEN doc_id % 4 = 3 THEN len(list_filter(words, lambda w, i: i % 23 = 0
        AND regexp_matches(w, '{PLAIN_WORD}'))) ELSE 0 END AS replaced
  FROM doc_words)"""

# Lines of a document as blocks, with the section each belongs to.
BLOCKS = """blocks AS (
  SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no
  FROM documents),
owned AS (
  SELECT *, CASE WHEN block_no > 0 THEN block_no // 4 END AS section_id FROM blocks),
sections AS (
  SELECT *, coalesce(
    first_value(section_id IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY block_no
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(section_id IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY block_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS owner
  FROM owned),
drafts AS (
  SELECT book_id, owner, min(block_no) AS first_block,
    string_agg(text, chr(10) ORDER BY block_no) AS text,
    CASE WHEN owner IS NULL THEN 'Book ' || book_id
      ELSE 'Part ' || (owner // 3) || ' — Section ' || owner END AS title
  FROM sections GROUP BY book_id, owner)"""


def packed(source: str, keys: str, text: str, limit: int = 60) -> str:
    """CTEs ``chunked`` and ``packed``: the keys and ``segs``, a list of segments."""
    return rf"""marked AS (
  SELECT {keys}, list_transform(string_split(translate({text}, chr(1) || chr(2) || chr(3), ''),
    chr(10)), lambda x: replace(trim(regexp_replace(x, '{SPACE}', ' ', 'g')), '* * *',
    chr(1) || chr(2) || chr(1))) AS ls
  FROM {source}),
phrased AS (
  SELECT {keys}, list_filter(list_transform(flatten(list_transform(ls, lambda x: string_split(
    regexp_replace(x, '([.!?…。！？]["''»”’)\]}}]*) ', '\1' || chr(1), 'g'), chr(1)))),
    lambda p: trim(p)), lambda p: p <> '') AS phrases
  FROM marked),
chunked AS (
  SELECT {keys}, flatten(list_transform(phrases, lambda p: list_transform(
    range(0, len(string_split(p, ' ')), {limit}),
    lambda i: array_to_string(string_split(p, ' ')[i + 1 : i + {limit}], ' ')))) AS chunks
  FROM phrased),
packed AS (
  SELECT {keys}, list_filter(string_split(list_reduce(list_prepend('', chunks),
    lambda acc, x: CASE
      WHEN x = chr(2) THEN acc || chr(3)
      WHEN split_part(acc, chr(3), -1) = '' THEN acc || x
      WHEN len(string_split(split_part(acc, chr(3), -1), ' '))
         + len(string_split(x, ' ')) > {limit} THEN acc || chr(3) || x
      ELSE acc || ' ' || x END), chr(3)), lambda s: s <> '') AS segs
  FROM chunked)"""


CHAPTERS = f"""{BLOCKS},
{packed('drafts', 'book_id, first_block, title', 'text')},
chapters AS (
  SELECT book_id, title, segs,
    row_number() OVER (PARTITION BY book_id ORDER BY first_block) AS chapter_number
  FROM packed WHERE len(segs) > 0)"""

BOOK_FRAGMENTS = f"""{CHAPTERS},
exploded AS (
  SELECT book_id, chapter_number, unnest(segs) AS text,
    generate_subscripts(segs, 1) AS ordinal_in_chapter
  FROM chapters),
book_fragments AS (
  SELECT *, row_number() OVER (PARTITION BY book_id
    ORDER BY chapter_number, ordinal_in_chapter) AS ordinal,
    len(string_split(text, ' ')) AS words
  FROM exploded)"""
