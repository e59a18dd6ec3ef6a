import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contentflow.functions import text


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_compact(values):
    raw = ["  a  　 b﻿ ", " \n\t", None, "x" * 12]
    assert values(lambda c: text.shortened(c, 10), raw) == ["a b", None, None, "x" * 9 + "…"]
    assert values(text.compact, raw) == ["a b", None, None, "x" * 12]


@pytest.mark.parametrize(
    "label, want",
    [
        ("2026-08-16T12:00:00Z", ms(2026, 8, 16)),
        ("2024.1.5", ms(2024, 1, 5)),
        ("2024/02/30", None),
        ("2024-02-30 or Jan 5, 2024", None),
        ("发布于 2023年9月7日", ms(2023, 9, 7)),
        ("Tue, 02 Jan 2024 23:30:00 -0500", ms(2024, 1, 2)),
        ("Jul 29, 2026Research note", ms(2026, 7, 29)),
        ("3 September, 2021", ms(2021, 9, 3)),
        ("Sept. 4th 2021", ms(2021, 9, 4)),
        ("12/31/2024", ms(2024, 12, 31)),
        ("12/31/2024 1:05 PM", ms(2024, 12, 31, 13, 5)),
        ("31/12/2024", None),
        ("Release 12.04", None),
        ("1999-01-01", None),
        ("2024-01-05x", None),
        ("", None),
        (None, None),
    ],
)
def test_published_day(values, label, want):
    assert values(text.published_day, [label]) == [want]


def test_rfc822_is_read_in_utc(values):
    raw = ["Tue, 02 Jan 2024 23:30:00 -0500", "2 Jan 2024 00:10 +0130", "Wed, 31 Jan 2024 22:00:00 PST", "no date"]
    assert values(text.rfc822_utc_day, raw) == ["2024-01-03", "2024-01-01", "2024-02-01", None]


def test_instants(values):
    raw = ["2024-01-05", "2024-01-05T10:00:00+02:00", "2024-01-05T10:00:00", "2024-13-05", "soon"]
    assert values(text.instant_ms, raw) == [ms(2024, 1, 5), ms(2024, 1, 5, 8), ms(2024, 1, 5, 10), None, None]
    assert values(text.unix_ms, ["1700000000", "1700000000123", "17000", "x"]) == [1_700_000_000_000, 1_700_000_000_123, None, None]


def test_hashes(spark):
    frame = spark.createDataFrame([("  T ", 5, " s "), ("T", None, None)], "t string, p bigint, s string")
    rows = frame.select(text.content_hash(F.col("t"), F.col("p"), F.col("s")), text.identity_hash(F.lit("x:1"), F.col("t"), F.col("s"))).collect()
    assert rows[0][0] == hashlib.sha256(b"T\x005\x00s").hexdigest()
    assert rows[1][0] == hashlib.sha256(b"T\x00\x00").hexdigest()
    assert rows[0][1] == hashlib.sha256(b"x:1\n  T \n s ").hexdigest()
    assert rows[1][1] == hashlib.sha256(b"x:1\nT\n").hexdigest()


def test_redaction(values):
    assert values(text.redact_url, ["https://u:p@Host.org/p?q=1#f", "https://host.org", "nonsense"]) == ["https://host.org/p?…", "https://host.org/", "[redacted URL]"]
    raw = ["Bearer abc.def at https://h.org/x?token=1 and https://g.org/y; api_key=zzz, sig : q", "plain"]
    assert values(text.redact_message, raw) == ["Bearer [redacted] at https://h.org/x?… and https://g.org/y; api_key=[redacted], sig=[redacted]", "plain"]


def test_leaked_math(values):
    raw = ["costs $5. @me_ pays $6 more", "let $x_i$ and $\\alpha$ be", "$19/mo. The 2× NVMe ~$", r"escaped \$a=b$ here", "a $t$ b", None]
    assert values(text.leaked_math, raw) == [[], ["$x_i$", r"$\alpha$"], [], [], ["$t$"], []]


def brute_pairs(source):
    """The lexer written out: position by position."""

    def escaped(at):
        n = 0
        while at - 1 - n >= 0 and source[at - 1 - n] == "\\":
            n += 1
        return n % 2 == 1

    out, i = [], 0
    while i < len(source):
        if source[i] == "$" and not escaped(i) and source[i + 1 : i + 2] != "$":
            j = i + 1
            while j < len(source) and (source[j] != "$" or escaped(j)):
                j += 1
            body = source[i + 1 : j].strip()
            if j < len(source) and body and "\n" not in source[i + 1 : j]:
                out.append(body)
                i = j + 1
                continue
        i += 1
    return out


def test_paired_math_on_plain_cases(values):
    raw = ["a $t$ b $(4,16)$", "price $5 only", r"\$x$ y $z$", "no\n$a\nb$ line"]
    assert values(text.paired_math, raw) == [["t", "(4,16)"], [], ["y"], []]


def test_paired_math_against_brute_force(values):
    rng = random.Random(7)
    made = ["".join(rng.choice("ab $") for _ in range(14)) for _ in range(300)]
    assert values(text.paired_math, made) == [[x for x in brute_pairs(m)] for m in made]


def test_ids(values):
    assert values(text.normal_doi, ["https://dx.doi.org/10.1000/AbC", "10.1/x", None]) == ["10.1000/abc", None, None]
    assert values(text.normal_orcid, ["https://orcid.org/0000-0001-2345-678x", "123"]) == ["0000-0001-2345-678X", None]
    assert values(text.normal_openalex, ["https://openalex.org/A1", "authors/A2", " "]) == ["A1", "A2", None]


def test_srcset(values):
    raw = ["https://c.org/a,w_1/x 100w, https://c.org/b 300w", "/one.png 1x, /two.png 2x", "/only.png", ""]
    assert values(text.largest_srcset, raw) == ["https://c.org/b", "/two.png", "/only.png", None]


def test_failure_classes(values):
    raw = ["net::ERR_TUNNEL_CONNECTION_FAILED", "getaddrinfo ENOTFOUND x", "The operation was aborted", "reset"]
    assert values(text.failure_class, raw) == ["proxy", "dns", "timeout", "other"]


def test_tex_links(values):
    raw = [r"see \url{https://e.org/x} and \href{https://e.org/y}{label}", r"\href{https://e.org/z}{}"]
    assert values(text.tex_links, raw) == [
        'see <a href="https://e.org/x">https://e.org/x</a> and <a href="https://e.org/y">label</a>',
        '<a href="https://e.org/z">https://e.org/z</a>',
    ]


def test_tolerant_json(values):
    assert values(text.json_object, ['{"a":1,"b":"x"}', "[1]", "{bad", None]) == [{"a": "1", "b": "x"}, None, None, None]
    assert values(text.json_strings, ['["a",1,null,"b",{"c":2}]', '{"a":1}', "[bad", None]) == [["a", "b"], [], [], []]


def test_references_are_read_once(values):
    texts = ["a &mdash; b", "&#8217;&#x2019;&#X2026;", "&amp;lt; &amp;amp;", "&lt;b&gt;&quot;&apos;&#39;&nbsp;", "AT&T & co; &", "&nosuch; &;", "&#0;&#xD800;&#1114112;&#99999999;", "&#150;&#129;", "&NotEqualTilde;", "&#128512;", "&hellip;\n&copy;", "plain", None, ""]
    assert values(text.unescape_entities, texts) == [
        "a \u2014 b", "\u2019\u2019\u2026", "&lt; &amp;", "<b>\"''\u00a0", "AT&T & co; &", "&nosuch; &;", "\ufffd" * 4, "\u2013\ufffd", "\u2242\u0338", "\U0001f600", "\u2026\n\u00a9", "plain", None, "",
    ]
