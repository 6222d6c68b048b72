"""Pieces of DuckDB SQL that the queries' oracles share; common table expressions, without WITH."""

from __future__ import annotations

from quernel.functions.text import ANY_TAG, BLOCK_TAG, COMMENT, ENTITIES, PREFIXES, SCRIPT, STOPWORDS
from quernel.plans import fixtures as X


def _lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + ")"


STOP = "[" + ", ".join(map(_lit, STOPWORDS)) + "]"

# A copy of the text with a filler for each further byte of a character, so that cutting by characters cuts by bytes.
_SHADOW = r"""regexp_replace(regexp_replace(regexp_replace(text, '([\x{80}-\x{7FF}])', '\1' || chr(1), 'g'), '([\x{800}-\x{FFFF}])', '\1' || chr(1) || chr(1), 'g'), '([\x{10000}-\x{10FFFF}])', '\1' || chr(1) || chr(1) || chr(1), 'g')"""
_WHITE_HEX = "(?:20|0A|0D|09|0B|0C)+"
PASSAGES = rf"""
sized AS (SELECT doc_id, strlen(text) AS size, CASE WHEN strlen(text) <= 2000 THEN 0 ELSE CAST(ceil((strlen(text) - 2000) / 850.0) AS BIGINT) END AS n, {_SHADOW} AS shadow, hex(encode(text)) AS hexed FROM documents),
cuts AS (SELECT doc_id, CAST(i AS INT) AS chunk_no, 850 * i AS start, CASE WHEN i < n THEN 1000 ELSE size - 850 * n END AS length, shadow, hexed FROM sized, unnest(range(0, n + 1)) AS u(i)),
pieces AS (SELECT doc_id, chunk_no, substring(shadow, CAST(start + 1 AS BIGINT), CAST(length AS BIGINT)) AS piece FROM cuts),
passages AS (SELECT doc_id, chunk_no, replace(regexp_replace(regexp_replace(piece, '([\x{{80}}-\x{{7FF}}]|[\x{{800}}-\x{{FFFF}}]\x01?|[\x{{10000}}-\x{{10FFFF}}]\x01{{0,2}})$', chr(65533)), '^\x01+', chr(65533)), chr(1), '') AS text FROM pieces),
blobs AS (SELECT doc_id, chunk_no, unhex(regexp_replace(regexp_replace(substring(hexed, CAST(2 * start + 1 AS BIGINT), CAST(2 * length AS BIGINT)), '^{_WHITE_HEX}', ''), '{_WHITE_HEX}$', '')) AS blob FROM cuts),
hashed AS (SELECT doc_id, chunk_no, blob, substring(sha256(blob), 1, 32) AS chunk_hash FROM blobs)"""


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: strlen(x) >= 2 AND NOT list_contains({STOP}, x))"


TOKENS = f"tokens AS (SELECT doc_id, chunk_no, {tokens('text')} AS toks FROM passages)"
WORDS = f"{TOKENS}, words AS (SELECT doc_id, chunk_no, unnest(toks) AS term, len(toks) AS n_tokens FROM tokens)"
POSTINGS = f"{WORDS}, postings AS (SELECT term, doc_id, chunk_no, CAST(count(*) AS INT) AS tf, CAST(n_tokens AS INT) AS n_tokens FROM words GROUP BY term, doc_id, chunk_no, n_tokens)"


def asked(text: str) -> str:
    return f"qt AS (SELECT 'q' AS query_id, unnest({tokens(_lit(text))}) AS term, unnest(range(1, len({tokens(_lit(text))}) + 1)) AS pos)"


BATCH = f"bt AS (SELECT item_id AS query_id, {tokens('text')} AS toks FROM benchmark), qt AS (SELECT query_id, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM bt)"
BM25 = """
stats AS (SELECT count(*) AS np, avg(len(toks)) AS avg_len FROM tokens),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
parts AS (SELECT query_id, pos, doc_id, chunk_no, ln(1 + (np - df + 0.5) / (df + 0.5)) * CAST(tf AS DOUBLE) * 2.2 / (CAST(tf AS DOUBLE) + 1.2 * (1 - 0.75 + 0.75 * n_tokens / avg_len)) AS part FROM qt JOIN postings USING (term) JOIN df USING (term), stats),
bm25 AS (SELECT query_id, doc_id, chunk_no, sum(part ORDER BY pos) AS score FROM parts GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS INT) AS rank FROM bm25) WHERE rank <= 50)"""


def cap(rows: str, k: int) -> str:
    return f"""few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY fused DESC, chunk_no) AS n_doc FROM ({rows})) WHERE n_doc <= 2),
capped AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id, chunk_no) AS INT) AS rank FROM few) WHERE rank <= {k})"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


COSINES = f"""cosines AS (SELECT e.vec_id AS doc_id, {_dot('e.embedding', 'q.embedding')} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
ranked_cosines AS (SELECT *, CAST(row_number() OVER (ORDER BY cosine DESC, doc_id) AS INT) AS rank FROM cosines)"""
SAMPLE = """numbered AS (SELECT vec_id AS doc_id, embedding AS vec, row_number() OVER (ORDER BY vec_id) - 1 AS pos, greatest(1, count(*) OVER () // 96) AS step FROM embeddings),
sample AS (SELECT pos // step AS i, doc_id, vec FROM numbered WHERE pos % step = 0 AND pos // step < 96)"""
BASELINE = f"""pairs AS (SELECT {_dot('a.vec', 'b.vec')} AS cosine FROM sample a, sample b WHERE a.i < b.i AND a.doc_id <> b.doc_id),
base AS (SELECT avg(cosine) AS mean, stddev_pop(cosine) AS sd, count(*) AS pairs FROM pairs)"""
DENSE = """semantic AS (SELECT 'q' AS query_id, c.doc_id, 0 AS chunk_no, cosine, CAST(row_number() OVER (ORDER BY cosine DESC, c.doc_id) AS INT) AS rank FROM cosines c, base WHERE cosine >= mean + 2 * sd QUALIFY rank <= 50)"""
FUSED = """fused AS (SELECT 'q' AS query_id, doc_id, chunk_no, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS fused,
  CASE WHEN l.rank IS NOT NULL AND s.rank IS NOT NULL THEN 'both' WHEN l.rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS via, s.cosine
  FROM lexical l FULL JOIN semantic s USING (doc_id, chunk_no))"""
CACHE = "cache AS (SELECT chunk_hash, arg_min(embedding, doc_id) AS vec FROM hashed JOIN embeddings ON doc_id = vec_id WHERE chunk_no = 0 GROUP BY chunk_hash)"

_SPACE = "\\t\\n\\x0b\\x0c\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_BLANK = _SPACE.replace("\\n", "")


def squeeze(text: str) -> str:
    x = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t\\x{{a0}}]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?m)^[{_BLANK}]+', '', 'g'), '(?m)[{_BLANK}]+$', '', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


def strip_html(page: str) -> str:
    x = page
    for pattern, to in ((COMMENT, "' '"), (SCRIPT, "' '"), (BLOCK_TAG, "chr(10)"), (ANY_TAG, "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    for name, char in ENTITIES:
        x = f"replace({x}, {_lit(name)}, {_lit(char)})"
    return squeeze(x)


TITLES = f"""firsts AS (SELECT conv_id AS chat_id, arg_min(text, turn) FILTER (role = 'user' AND regexp_replace(text, '[{_SPACE}]+', '', 'g') <> '') AS content FROM conversations GROUP BY conv_id),
ones AS (SELECT chat_id, trim(regexp_replace(content, '[{_SPACE}]+', ' ', 'g')) AS one FROM firsts),
titles AS (SELECT chat_id, CASE WHEN one IS NULL OR one = '' THEN 'New conversation' WHEN length(one) > 60 THEN trim(substring(one, 1, 60)) || '…' ELSE one END AS title FROM ones)"""
METAS = f"metas AS (SELECT chat_id AS id, title, (SELECT count(*) FROM conversations WHERE conv_id = chat_id) AS count, TIMESTAMP '{X.NOW}' - to_hours(CAST(chat_id % 1500 AS INT)) AS updated FROM titles)"


def bucket(updated: str, now: str) -> str:
    age = f"date_diff('day', CAST({updated} AS DATE), DATE '{now[:10]}')"
    return f"CASE WHEN {age} <= 0 THEN 'Today' WHEN {age} <= 1 THEN 'Yesterday' WHEN {age} <= 7 THEN 'Previous 7 days' WHEN {age} <= 30 THEN 'Previous 30 days' ELSE 'Earlier' END"


_LOCK_ROWS = [x.split() for x in X.LOCK if x and not x.startswith("#")]
LOCK = values("raw", "line", [(x,) for x in X.LOCK]) + """,
split AS (SELECT string_split(line, ' ') AS p FROM raw WHERE line <> '' AND line NOT LIKE '#%'),
lock AS (SELECT p[1] AS kind, CASE WHEN p[1] IN ('model', 'embed') THEN p[2] WHEN p[1] = 'release' THEN p[3] END AS repo, CASE WHEN p[1] IN ('model', 'embed') THEN p[3] WHEN p[1] <> 'binary' THEN p[2] END AS rev,
  CASE WHEN p[1] IN ('model', 'embed') THEN p[4] WHEN p[1] = 'binary' THEN p[2] END AS file, TRY_CAST(CASE WHEN p[1] IN ('model', 'embed') THEN p[5] WHEN p[1] = 'binary' THEN p[3] END AS BIGINT) AS bytes,
  CASE WHEN p[1] IN ('model', 'embed') THEN p[6] WHEN p[1] = 'binary' THEN p[4] END AS sha256, TRY_CAST(CASE WHEN p[1] IN ('model', 'embed') THEN p[7] END AS INT) AS profile FROM split)"""
FILES = values("files", "dir, file, bytes, sha256", X.FILES)
DIR = "CASE l.kind WHEN 'embed' THEN 'embed' WHEN 'binary' THEN 'bin' ELSE 'models' END"
VERIFY = f"""SELECT l.file, l.kind, CASE WHEN f.bytes IS NULL THEN 'MISSING' WHEN f.bytes < l.bytes THEN 'INCOMPLETE' WHEN f.bytes > l.bytes THEN 'TOO LARGE' WHEN f.sha256 <> l.sha256 THEN 'SHA MISMATCH' ELSE 'OK' END AS status,
  coalesce(CAST(f.bytes * 100 // l.bytes AS BIGINT), -1) AS percent FROM lock l LEFT JOIN files f ON f.dir = {DIR} AND f.file = l.file WHERE l.kind IN ('model', 'embed', 'binary')"""
MODELS = values("models", "id, bytes", X.MODELS)
RAM = "WITH " + values("r", "ram, encoder", X.RAM) + ", b AS (SELECT *, least(CAST(ram AS BIGINT) * 7 // 10, ram - 4294967296) AS least FROM r) SELECT ram, coalesce(encoder, 0) AS encoder, CAST(CASE WHEN encoder IS NOT NULL AND least - encoder > 0 THEN least - encoder ELSE least END AS BIGINT) AS budget FROM b"
PICKER = (
    f"WITH {MODELS}, "
    + r"""m AS (SELECT id, bytes, regexp_matches(id, '-\d{5}-of-\d{5}$') AS part, list_max(list_transform(regexp_extract_all(id, '(?i)(\d+(?:\.\d+)?)\s*B\b', 1), lambda x: CAST(x AS DOUBLE))) AS params FROM models),
b AS (SELECT *, CASE WHEN part THEN -1 WHEN bytes IS NOT NULL THEN CASE WHEN bytes < 8589934592 THEN 0 WHEN bytes < 26843545600 THEN 1 ELSE 2 END WHEN params IS NULL THEN -1 WHEN params < 14 THEN 0 WHEN params < 44 THEN 1 ELSE 2 END AS k FROM m),
d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(id, '(?i)[-_](UD[-_])?I?Q\d+(_[A-Z0-9]+)*$', ''), '(?i)[-_](Instruct|it|qat|chat|hf)\b', '', 'g'), '[-_]\d{4}$', ''), '[-_]+', ' ', 'g') AS shown FROM b)
SELECT id, CASE WHEN part THEN id ELSE upper(shown[1]) || shown[2:] END AS label, CASE WHEN part THEN '' WHEN regexp_matches(id, '(?i)[-_]A\d+B\b') THEN 'MoE' WHEN regexp_matches(id, '(?i)(^|[-_])R1([-_]|$)') THEN 'reasoning' ELSE '' END AS tag,
CASE k WHEN 0 THEN 'Fast' WHEN 1 THEN 'Balanced' WHEN 2 THEN 'Best quality' ELSE '' END AS band, NOT part AND coalesce(bytes <= """
    + str(X.BUDGET)
    + r""", TRUE) AS usable, CAST(round(coalesce(CAST(bytes AS DOUBLE), coalesce(params, 0) * 0.57 * 1073741824)) AS BIGINT) AS weight FROM d"""
)


def _prefix(at: int) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(m, {_lit(p)})' for p in row[0])} THEN {_lit(row[at])}" for row in PREFIXES)
    return f"CASE {cases} ELSE '' END"


NAMES = "WITH " + values("ids", "id", [(x,) for x in X.MODEL_IDS]) + rf", n AS (SELECT id, regexp_replace(string_split(replace(id, '\', '/'), '/')[-1], '(?i)\.gguf$', '') AS name FROM ids), l AS (SELECT *, lower(name) AS m FROM n) SELECT id, name, {_prefix(1)} AS query_prefix, {_prefix(2)} AS doc_prefix FROM l"
SIZES = "WITH " + values("s", "n", [(x,) for x in X.SIZES]) + " SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.1fGB', n / 1073741824.0) ELSE CAST(CAST(floor(n / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) || 'MB' END AS shown FROM s"
