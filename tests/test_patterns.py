"""Request patterns: each finds a text made for it, verdicts of tricky spellings, entities."""

import html
import random
import re

import pytest
from hypothesis import HealthCheck, given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskwatch.functions.text import html_unescape, matches
from duskwatch.operators.patterns import DEFAULT_PATTERNS
from duskwatch.operators.requests import classify_requests

COUNT = {"sql_injection": 190, "xss_attempt": 213, "path_traversal": 93, "command_injection": 28, "ssrf_attempt": 13, "rce_attempt": 11,
         "html_injection": 9, "xml_injection": 9, "ldap_injection": 7, "template_injection": 6, "auth_bypass_attempt": 6, "bot_detected": 3}


def test_every_pattern_is_listed():
    assert {k: len(v) for k, v in DEFAULT_PATTERNS.items()} == COUNT


def samples(pattern, n=2):
    """Texts in which Python's own matcher finds the pattern."""
    found = []
    named = "".join(chr(int(c, 16)) for c in re.findall(r"(?<!\\)\\x([0-9a-fA-F]{2})", pattern))

    @seed(7)
    @settings(max_examples=n, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE), alphabet=st.characters(
        min_codepoint=32, max_codepoint=126, include_characters=named)))
    def make(text):
        found.append(text.lower()[:400])

    make()
    return [t for t in found if re.search(pattern, t, re.IGNORECASE)]


@pytest.mark.parametrize("category", list(DEFAULT_PATTERNS))
def test_generated_texts_are_found(spark, category):
    patterns = list(dict.fromkeys(DEFAULT_PATTERNS[category]))
    texts = [(i, t) for i, p in enumerate(patterns) for t in samples(p)]
    assert {i for i, _ in texts} == set(range(len(patterns)))
    frame = spark.createDataFrame(texts, "i int, t string")
    assert frame.filter(~matches(F.col("t"), patterns, lowered=True)).collect() == []
    assert frame.filter(~matches(F.col("t"), patterns)).collect() == []
    rng = random.Random(1)
    for i in rng.sample(range(len(patterns)), min(12, len(patterns))):
        assert frame.filter(F.col("i") == i).filter(~matches(F.col("t"), [patterns[i]])).count() == 0


def test_joined_patterns_keep_their_references(spark):
    frame = spark.createDataFrame([("x 'x' y",), ("'x\"",), ("foobar",), ("]",)], "t string")
    got = frame.filter(matches(F.col("t"), ["(foo)bar", "(['\"])x\\1", "[]abc]z"])).collect()
    assert sorted(r.t for r in got) == ["foobar", "x 'x' y"]


VERDICTS = {"/x?q=41<>7": "sql_injection", "/x?q=a' <= 'b": "sql_injection", "/x?q=' or 02!11": "sql_injection",
            r'/x?q=load_file!("\\\\': "sql_injection", "/x?q=</ script": "xss_attempt", "/%c0%ae%c0%ae/": "path_traversal",
            "/x?q=blue shoes": "none", "/x?q=&#x3c;&#115;cript&gt;": "sql_injection"}


def test_verdicts_of_tricky_spellings(spark):
    rows = [(i, url) for i, url in enumerate(VERDICTS)]
    frame = spark.createDataFrame(rows, "id long, url string").withColumns({
        "body": F.lit(None).cast("string"), "user_agent": F.lit("Mozilla"), "client_ip": F.lit("198.51.100.7"), "method": F.lit("GET")})
    got = {r.url: r.threat_type for r in classify_requests(frame).collect()}
    assert {u: got[u] for u in VERDICTS if u != "/%c0%ae%c0%ae/"} == {u: v for u, v in VERDICTS.items() if u != "/%c0%ae%c0%ae/"}
    assert got["/%c0%ae%c0%ae/"] != "none"


def test_entities(spark):
    texts = ["&lt;a&gt; &amp;lt; a & b &nosuch; &copyx &notit; &AMP", "&#60;&#x3C;&#60 &#0;&#128;&#xD800;&#99999999999;&#x;", "&NotEqualTilde;&frac34x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_unescape(F.col("t")).alias("o")).collect()
    assert [r.o for r in rows] == [html.unescape(r.t) for r in rows]
