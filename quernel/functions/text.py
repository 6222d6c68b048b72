"""Text functions, Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal.
STOPWORDS = (
    "the and for are but not you all can her was one our out his has had how its who did yes she him they them this that with "
    "from have were what when your will would there their about which been into than then also does each such"
).split()


def raw_terms(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits; may hold empty strings."""
    return F.split(F.lower(F.translate(text, "İΣ", "iσ")), r"[^\p{L}\p{Nd}]+")


def is_term(word: Column) -> Column:
    """At least two bytes, and no stopword."""
    return (F.octet_length(word) >= 2) & ~word.isin(STOPWORDS)


def tokenize(text: Column) -> Column:
    return F.filter(raw_terms(text), is_term)


def unicode_trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def is_blank(text: Column) -> Column:
    return unicode_trim(text) == ""


def squeeze(text: Column) -> Column:
    """Line ends become \\n, runs of blanks one space, lines are trimmed, three or more line ends become two."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t ]+", " ")
    edge = r"[\p{IsWhite_Space}&&[^\n]]+"
    text = F.regexp_replace(text, rf"(?m)^{edge}|{edge}$", "")
    return unicode_trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


# Named character references that pages use most, in the order they are decoded; &amp; comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&")]


def decode_common_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


# Patterns of the four markup passes.
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<(script|style)\b[^>]*>.*?</\s*(script|style)\s*>"
BLOCK_TAG = r"(?i)<\s*/?\s*(p|div|br|li|tr|h[1-6]|section|article|blockquote|pre|td|th)\b[^>]*>"
ANY_TAG = r"(?s)<[^>]*>"


def strip_tags(page: Column) -> Column:
    """Without comments, scripts, styles and tags; block tags leave a line end. References stay encoded."""
    page = F.regexp_replace(page, COMMENT, " ")
    page = F.regexp_replace(page, SCRIPT, " ")
    page = F.regexp_replace(page, BLOCK_TAG, "\n")
    return F.regexp_replace(page, ANY_TAG, "")


def strip_html(page: Column) -> Column:
    """Text of a page, with the common character references decoded natively (sources.extract decodes all)."""
    return squeeze(decode_common_entities(strip_tags(page)))


def truncate(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, "").otherwise(F.substring(text, F.lit(1), n))


def title_from(content: Column) -> Column:
    """Title of a conversation from its first message that isn't blank."""
    one = unicode_trim(F.regexp_replace(content, r"\p{IsWhite_Space}+", " "))
    return F.when(content.isNull() | (one == ""), "New conversation").when(F.char_length(one) > 60, F.concat(unicode_trim(F.substring(one, 1, 60)), F.lit("…"))).otherwise(one)


def base_name(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.substring_index(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/", -1)


def model_name(model_id: Column) -> Column:
    return F.regexp_replace(base_name(model_id), r"(?i)\.gguf$", "")


def stored_name(name: Column) -> Column:
    """Base name, trimmed, else untitled.txt."""
    got = unicode_trim(F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1))
    return F.when(got.isNull() | got.isin("", ".", "/"), "untitled.txt").otherwise(got)


# Prefixes by what a model's name contains, the first that fits.
PREFIXES = [
    (("embeddinggemma", "embedding-gemma"), "task: search result | query: ", "title: none | text: "),
    (("nomic-embed",), "search_query: ", "search_document: "),
    (("e5",), "query: ", "passage: "),
    (("bge", "mxbai", "gte"), "Represent this sentence for searching relevant passages: ", ""),
    (("qwen3-embedding",), "Instruct: Given a question, retrieve passages that answer it\nQuery: ", ""),
]


def prefixes(model_id: Column) -> tuple[Column, Column]:
    """Prefix of a query and of a passage for a model."""
    name = F.lower(model_name(model_id))
    query, passage = F.lit(""), F.lit("")
    for parts, q, p in reversed(PREFIXES):
        hit = F.lit(False)
        for part in parts:
            hit = hit | name.contains(part)
        query, passage = F.when(hit, q).otherwise(query), F.when(hit, p).otherwise(passage)
    return query, passage


def prefix_pair(model_id: str) -> tuple[str, str]:
    """prefixes() of one name outside a plan."""
    name = model_id.lower()
    return next(((q, p) for parts, q, p in PREFIXES if any(x in name for x in parts)), ("", ""))


def max_chars(n_ctx: Column, prefix: Column) -> Column:
    """Characters of an input that fit beside a prefix: three a token, 1536 where the context is unknown."""
    return F.when(n_ctx > 0, 3 * n_ctx).otherwise(F.lit(1536)) - F.octet_length(prefix)


def pretty_bytes(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.format_string("%.1fGB", n / (1 << 30))).otherwise(F.concat(F.floor(n / (1 << 20) + 0.5).cast("string"), F.lit("MB")))


# Patterns of model files' names.
SPLIT_PART = r"-\d{5}-of-\d{5}$"


def is_split_part(name: Column) -> Column:
    return name.rlike(SPLIT_PART)


def display_name(name: Column) -> Column:
    name = F.regexp_replace(name, r"(?i)[-_](UD[-_])?I?Q\d+(_[A-Z0-9]+)*$", "")
    name = F.regexp_replace(name, r"(?i)[-_](Instruct|it|qat|chat|hf)\b", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[-_]\d{4}$", ""), "[-_]+", " ")
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def model_tag(name: Column) -> Column:
    return F.when(name.rlike(r"(?i)[-_]A\d+B\b"), "MoE").when(name.rlike(r"(?i)(^|[-_])R1([-_]|$)"), "reasoning").otherwise("")


# Bytes of a billion parameters, and bands by bytes and by billions of parameters.
BYTES_PER_BILLION = 0.57 * (1 << 30)
BANDS = [("Fast", 8 << 30, 14.0), ("Balanced", 25 << 30, 44.0), ("Best quality", None, None)]


def params_of(name: Column) -> Column:
    """Billions of parameters: the largest number before a B."""
    found = F.regexp_extract_all(name, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*B\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("double")))


def weight_of(name: Column, size: Column) -> Column:
    return F.coalesce(size.cast("double"), F.coalesce(params_of(name), F.lit(0.0)) * BYTES_PER_BILLION)


def band_of(name: Column, size: Column) -> Column:
    """Index of the band, -1 where neither size nor name says it."""
    by_size, by_params = F.lit(2), F.lit(2)
    for i, (_, most, params) in reversed(list(enumerate(BANDS[:2]))):
        by_size = F.when(size < most, i).otherwise(by_size)
        by_params = F.when(params_of(name) < params, i).otherwise(by_params)
    return F.when(size.isNotNull(), by_size).when(params_of(name).isNull(), -1).otherwise(by_params)


def age_bucket(day: Column, today: Column) -> Column:
    """Bucket of a date (or null) seen from today."""
    age = F.datediff(today, day)
    return F.when(day.isNull(), "Earlier").when(age <= 0, "Today").when(age <= 1, "Yesterday").when(age <= 7, "Previous 7 days").when(age <= 30, "Previous 30 days").otherwise("Earlier")


def looks_binary(content: Column) -> Column:
    """A NUL in the first 8000 bytes, or control characters from six in a hundred on (integer division)."""
    head = F.decode(F.substring(content, 1, 8000), "ISO-8859-1")
    n = F.char_length(head)
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0e-\x1f]"))
    return F.when(n == 0, False).otherwise(head.contains("\x00") | (F.floor(control * 100 / n) > 5))


def valid_id(name: Column) -> Column:
    return name.rlike(r"^[0-9]{8}-[0-9]{6}-[a-z0-9]{4}$")


def new_id(when: Column | None = None, suffix: Column | None = None) -> Column:
    """Id from a time and four random characters; both can be given, for tests."""
    when = F.current_timestamp() if when is None else when
    suffix = F.lower(F.randstr(F.lit(4))) if suffix is None else suffix
    return F.concat(F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyyMMdd-HHmmss"), F.lit("-"), suffix)


def junk_member(name: Column) -> Column:
    """Archive members that are no documents."""
    return name.startswith("__MACOSX/") | base_name(name).startswith(".") | name.endswith("/")
