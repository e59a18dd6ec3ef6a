"""Text, date, hash, redaction and formula rules as Column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow.functions.binding import let, remembered

# --- fixed values -----------------------------------------------------------
WHITESPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
ELLIPSIS = "…"
ISO_DATE = r"\b(20\d{2})[./-](\d{1,2})[./-](\d{1,2})(?=$|[Tt\s])"
CHINESE_DATE = r"(20\d{2})年(\d{1,2})月(\d{1,2})"
MONTH_NAME = (
    r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    r"|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_FIRST = r"(?i)\b(\d{1,2})\s+" + MONTH_NAME + r"\.?\s*,?\s*(20\d{2})(?!\d)"
MONTH_FIRST = r"(?i)\b" + MONTH_NAME + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s*(20\d{2})(?!\d)"
NUMERIC_DATE = r"^(\d{1,2})[./-](\d{1,2})[./-](20\d{2})(?:\s+(.*))?$"
REDACT_BEARER = r"(?i)Bearer\s+\S+"
REDACT_URL = r"(?i)https?://[^\s'\"<>]+"
REDACT_SECRET = (
    r"(?i)\b(access[_-]?token|api[_-]?key|client[_-]?secret|token|secret|signature|sig)\s*[=:]\s*[^\s,;]+"
)
MATH_PAIR = r"(?<!\\)\$([^$\r\n]+)\$"
MATH_COMMAND = r"\\[A-Za-z]+"
MATH_SCRIPT = r"[A-Za-zα-ωΑ-Ω0-9)}\]]\s*[_^]\s*(?:\{[^}\r\n]+\}|[A-Za-zα-ωΑ-Ω0-9])"
MATH_OPERATOR = r"[=<>±÷]"
MATH_SYMBOL = r"^[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]*$"
SENTENCE_LIKE = r"(?:^|[.!?])\s+(?:@|https?://|[A-Z])"
RAW_TEX = r"\\(?:[A-Za-z]+|[{}\[\]\\])[^\s<]*"
DOI = r"^10\.\d{4,9}/.+"
ORCID = r"(?i)^\d{4}-\d{4}-\d{4}-[\dX]{4}$"
EXCERPT_LENGTH = 18_000
SELECTION_LENGTH = 2_000
ENTITY = "&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});"
# ---------------------------------------------------------------------------

DAY_MS = 86_400_000


def collapse(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def compact(text: Column) -> Column:
    """Collapsed text, null when empty. Stored texts are kept whole; ``shortened`` cuts one for display."""
    return blank_to_null(collapse(text))


@remembered
def shortened(text: Column, limit: int) -> Column:
    """Collapsed text for display: null when empty, cut to ``limit`` code points with an ellipsis."""

    def cut(clean: Column) -> Column:
        short = F.concat(F.substring(clean, 1, limit - 1), F.lit(ELLIPSIS))
        return F.when(F.length(clean) > limit, short).when(clean != "", clean)

    return let(collapse(text), cut)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def non_blank(text: Column) -> Column:
    """The text itself when it holds more than whitespace."""
    return F.when(collapse(text) != "", text)


def day_ms(year: Column, month: Column, day: Column) -> Column:
    """UTC midnight of a calendar date in epoch ms; null when there is no such day."""
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    return F.unix_date(date).cast("bigint") * F.lit(DAY_MS)


def _month_number(name: Column) -> Column:
    key = F.lower(F.substring(name, 1, 3))
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), key).cast("string")


@remembered
def published_day(value: Column) -> Column:
    """Publication instant (epoch ms) of a date label, day precision in UTC.

    The first form that matches decides, so an impossible ISO date yields null
    instead of being tried as another form.
    """
    return let(collapse(value), _day_of_label)


def _clock_ms(text: Column) -> Column:
    """Milliseconds of ``h:mm[:ss] [am|pm]``; empty text is midnight, anything else null."""
    shape = r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?$"
    hour, minute = F.regexp_extract(text, shape, 1).try_cast("int"), F.regexp_extract(text, shape, 2).try_cast("int")
    second = F.coalesce(F.regexp_extract(text, shape, 3).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(text, shape, 4))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    valid = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(text == "", F.lit(0)).when(valid, ((hour * 60 + minute) * 60 + second) * 1000)


def _day_of_label(text: Column) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def date(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        number = part(pattern, month)
        return day_ms(part(pattern, year), _month_number(number) if named else number, part(pattern, day))

    return (
        F.when(text.rlike(ISO_DATE), date(ISO_DATE, 1, 2, 3))
        .when(text.rlike(CHINESE_DATE), date(CHINESE_DATE, 1, 2, 3))
        .when(text.rlike(DAY_FIRST), date(DAY_FIRST, 3, 2, 1, named=True))
        .when(text.rlike(MONTH_FIRST), date(MONTH_FIRST, 3, 1, 2, named=True))
        .when(text.rlike(NUMERIC_DATE), date(NUMERIC_DATE, 3, 1, 2) + let(part(NUMERIC_DATE, 4), _clock_ms))
    )


def instant_ms(value: Column) -> Column:
    """Epoch ms of an ISO date or date-time; a missing offset means UTC."""
    text = F.trim(value)
    day = day_ms(F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})$", 1), F.substring(text, 6, 2), F.substring(text, 9, 2))
    zoned = F.when(text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.unix_millis(zoned.try_cast("timestamp"))
    )


@remembered
def rfc822_utc_day(value: Column) -> Column:
    """ISO day text (UTC) of an RFC 822 date such as ``Tue, 02 Jan 2024 23:30:00 -0500``."""
    shape = r"(?i)(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(\S*)"

    def part(group: int) -> Column:
        return F.regexp_extract(value, shape, group)

    zone = F.upper(part(7))
    offset_text = (
        F.when(zone.rlike(r"^[+-]\d{2}:?\d{2}$"), zone)
        .when(zone == "EST", F.lit("-0500"))
        .when(zone == "EDT", F.lit("-0400"))
        .when(zone == "CST", F.lit("-0600"))
        .when(zone == "CDT", F.lit("-0500"))
        .when(zone == "MST", F.lit("-0700"))
        .when(zone == "MDT", F.lit("-0600"))
        .when(zone == "PST", F.lit("-0800"))
        .when(zone == "PDT", F.lit("-0700"))
        .otherwise(F.lit("+0000"))
    )
    digits = F.regexp_replace(offset_text, r"[^\d]", "")
    offset = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(
        offset_text.startswith("-"), F.lit(-1)
    ).otherwise(F.lit(1))
    midnight = day_ms(part(3), _month_number(part(2)), part(1))
    minutes = part(4).try_cast("bigint") * 60 + part(5).try_cast("bigint") - offset
    instant = midnight + minutes * 60_000 + F.coalesce(part(6).try_cast("bigint"), F.lit(0)) * 1000
    return F.when(value.rlike(shape), F.date_from_unix_date(F.floor(instant / DAY_MS).cast("int")).cast("string"))


def unix_ms(value: Column) -> Column:
    """Epoch ms of a 10 to 13 digit number text; ten digits are seconds."""
    text = F.trim(value)
    number = text.try_cast("bigint")
    return F.when(text.rlike(r"^\d{10,13}$"), F.when(F.length(text) == 10, number * 1000).otherwise(number))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", " ")


def entity_table() -> Column:
    """Character of every named entity that ends in a semicolon, as a map literal made from the standard library's table."""
    named = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(named)), "map<string,string>")


def character(code: Column) -> Column:
    """The character a numeric reference stands for; 128 to 159 mean the Windows letters, numbers that are no character the replacement."""
    windows = [bytes([n]).decode("cp1252", "replace") for n in range(128, 160)]
    letters = F.array(*[F.lit(c) for c in windows])
    invalid = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    coded = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(invalid, F.lit("\ufffd")).when(code.between(128, 159), F.get(letters, (code - 128).cast("int"))).otherwise(coded)


def unescape_entities(text: Column) -> Column:
    """Named and numeric references as their characters, in one pass: what a reference yields is not read again.

    A name nobody defined, and an ampersand that begins no reference, stay.
    """

    def decoded(token: Column) -> Column:
        body = F.substr(token, F.lit(2), F.length(token) - 2)
        hexadecimal = F.conv(F.substr(body, F.lit(3)), 16, 10).cast("bigint")
        return (
            F.when(~token.startswith("&") | (F.length(token) < 3), token)
            .when(body.rlike("^#[xX]"), character(hexadecimal))
            .when(body.startswith("#"), character(F.substr(body, F.lit(2)).cast("bigint")))
            .otherwise(F.coalesce(F.try_element_at(entity_table(), body), token))
        )

    tokens = F.regexp_extract_all(text, F.lit(f"({ENTITY}|[^&]+|&)"), F.lit(1))
    return F.when(text.rlike(ENTITY), F.array_join(F.transform(tokens, decoded), "")).otherwise(text)


def content_hash(title: Column, published_at: Column, summary: Column) -> Column:
    nul = F.char(F.lit(0))

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")

    joined = F.concat(
        trimmed(title), nul, F.coalesce(published_at.cast("string"), F.lit("")), nul, F.coalesce(trimmed(summary), F.lit(""))
    )
    return F.sha2(joined, 256)


def identity_hash(identity: Column, title: Column, summary: Column) -> Column:
    return F.sha2(F.concat_ws("\n", identity, title, F.coalesce(summary, F.lit(""))), 256)


@remembered
def redact_url(url: Column) -> Column:
    """Address without credentials, query text or fragment; a removed query leaves ``?…``."""
    shape = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    path = F.regexp_extract(url, shape, 3)
    rebuilt = F.concat(
        F.lower(F.regexp_extract(url, shape, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(url, shape, 2)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query != "", F.lit("?…")).otherwise(F.lit("")),
    )
    return F.when(url.rlike(shape), rebuilt).otherwise(F.lit("[redacted URL]"))


@remembered
def redact_message(message: Column) -> Column:
    """Message with bearer tokens, URL secrets and ``key=value`` secrets removed."""
    text = F.regexp_replace(message, REDACT_BEARER, "Bearer [redacted]")

    def without_urls(message: Column) -> Column:
        found = F.transform(F.regexp_extract_all(message, F.lit(REDACT_URL), F.lit(0)), redact_url)
        between = F.split(message, REDACT_URL, -1)
        woven = F.zip_with(between, found, lambda piece, url: F.concat(piece, F.coalesce(url, F.lit(""))))
        return F.when(message.rlike(REDACT_URL), F.array_join(woven, "")).otherwise(message)

    return F.regexp_replace(let(text, without_urls), REDACT_SECRET, "$1=[redacted]")


@remembered
def leaked_math(text: Column) -> Column:
    """Dollar-delimited formulas left in prose, as an array of ``$…$`` fragments."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MATH_PAIR), F.lit(1)), lambda f: F.trim(f))

    def is_formula(formula: Column) -> Column:
        command = formula.rlike(MATH_COMMAND)
        evidence = command | formula.rlike(MATH_SCRIPT) | formula.rlike(MATH_OPERATOR) | formula.rlike(MATH_SYMBOL)
        return evidence & ~(formula.rlike(SENTENCE_LIKE) & ~command)

    hits = F.transform(F.filter(found, is_formula), lambda f: F.concat(F.lit("$"), f, F.lit("$")))
    return F.when(text.contains("$"), hits).otherwise(F.array().cast("array<string>"))


def paired_math(text: Column) -> Column:
    """Every matched, unescaped inline ``$…$`` pair on one line, contents trimmed."""
    pair = r"(?<!\\)(?:\\\\)*\$(?!\s*\$)((?:\\.|[^$\\\r\n])+)\$"
    found = F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), lambda f: F.trim(f))
    return F.when(text.contains("$"), F.filter(found, lambda f: f != "")).otherwise(F.array().cast("array<string>"))


def raw_tex_commands(text: Column) -> Column:
    commands = F.regexp_extract_all(text, F.lit(f"({RAW_TEX})"), F.lit(1))
    return F.when(text.contains("\\"), commands).otherwise(F.array().cast("array<string>"))


def tex_links(html: Column) -> Column:
    r"""``\url{…}`` and ``\href{…}{…}`` in prose as plain links."""
    named = F.regexp_replace(html, r"\\href\{(https?://[^}\s]+)\}\{([^}]+)\}", '<a href="$1">$2</a>')
    bare = F.regexp_replace(named, r"\\href\{(https?://[^}\s]+)\}\{\}", '<a href="$1">$1</a>')
    return F.regexp_replace(bare, r"\\url\{(https?://[^}\s]+)\}", '<a href="$1">$1</a>')


def excerpt_parts(text: Column, length: int = EXCERPT_LENGTH) -> Column:
    """Tag-free, collapsed text as an array of pieces of ``length`` code points; null when empty."""

    def cut(clean: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(clean), F.lit(length))
        return F.when(clean != "", F.transform(starts, lambda at: F.substr(clean, at, F.lit(length))))

    return let(collapse(strip_tags(text)), cut)


def selection(text: Column, length: int = SELECTION_LENGTH) -> Column:
    """What a reader marked, as the same kind of pieces."""
    return excerpt_parts(text, length)


def normal_doi(value: Column) -> Column:
    doi = F.lower(F.trim(F.regexp_replace(F.trim(value), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))
    return F.when(doi.rlike(DOI), doi)


def normal_orcid(value: Column) -> Column:
    found = F.trim(F.regexp_replace(F.trim(value), r"(?i)^https?://orcid\.org/", ""))
    return F.when(found.rlike(ORCID), F.upper(found))


def normal_openalex(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), r"(?i)^https?://openalex\.org/", "")
    return blank_to_null(F.regexp_replace(bare, r"(?i)^authors/", ""))


def partial_date_ms(year: Column, month: Column, day: Column) -> Column:
    """Day of a partial date; a missing month or day counts as the first."""
    return day_ms(year, F.coalesce(blank_to_null(month), F.lit("01")), F.coalesce(blank_to_null(day), F.lit("01")))


def largest_srcset(value: Column) -> Column:
    """URL of the widest ``srcset`` candidate; commas inside a URL do not split it."""
    items = F.split(value, r"(?i),\s*(?=(?:(?:https?:)?//|/))")
    parsed = F.transform(
        items,
        lambda item, i: F.struct(
            F.coalesce(F.regexp_extract(F.trim(item), r"^\S+\s+(\d+)", 1).try_cast("int"), F.lit(0)).alias("width"),
            (-i).alias("order"),
            F.regexp_extract(F.trim(item), r"^(\S+)", 1).alias("url"),
        ),
    )
    best = F.array_max(F.filter(parsed, lambda c: c["url"] != ""))
    return F.when(value != "", best["url"])


def category_label(value: Column) -> Column:
    """Collapsed folder label; null when empty. Check ``category_too_long`` to reject long ones."""
    return blank_to_null(collapse(value))


def category_too_long(value: Column, limit: int = 60) -> Column:
    return F.coalesce(F.length(collapse(value)) > limit, F.lit(False))


def json_object(value: Column) -> Column:
    """JSON object text as a map of texts; null for anything else."""
    return F.when(value.rlike(r"^\s*\{"), F.from_json(value, "map<string,string>"))


def json_strings(value: Column) -> Column:
    """The string elements of a JSON array text; empty for anything else."""
    items = F.from_json(value, "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    return F.coalesce(F.when(value.rlike(r"^\s*\["), texts), F.array().cast("array<string>"))


def failure_class(message: Column) -> Column:
    return (
        F.when(message.rlike(r"(?i)ERR_(?:PROXY|TUNNEL|SOCKS)_|proxy"), F.lit("proxy"))
        .when(message.rlike(r"(?i)ERR_NAME_NOT_RESOLVED|ENOTFOUND|dns"), F.lit("dns"))
        .when(message.rlike(r"(?i)ERR_TIMED_OUT|timeout|timed out|aborted"), F.lit("timeout"))
        .otherwise(F.lit("other"))
    )
