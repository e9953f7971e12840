"""Wide patterns that look at texts before the exact ones."""

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from duskwatch.functions.prefilter import possible, possible_patterns, widened
from duskwatch.operators.patterns import DEFAULT_PATTERNS

TEXTS = ["", "1 union select 2", "' OR '1'='1", "<script>alert(1)</script>", "../../etc/passwd", "plain words", "a\x0bb", "x--\n", "$(whoami)",
         "<img src=x onerror=alert(1)>", "ſelect", "K", "; cat /etc/passwd;", "or 1=1\n", "http://127.0.0.1/a", "{{7*7}}"]


def test_widened_patterns_find_at_least_what_the_exact_ones_find():
    ascii_texts = [t for t in TEXTS if t.isascii()]
    for p in [p for ps in DEFAULT_PATTERNS.values() for p in ps] + [r"(['\"])a\1", r"^x(?!y)\s*$", r"\bk{2,90}", r"a\sb", r"[^\s<]+>"]:
        wide = widened(p)
        if wide is None:
            continue
        seen = pc.match_substring_regex(pa.array(ascii_texts), pattern="(?i)" + wide).to_pylist()
        assert all(s or not re.search("(?i)" + p, t) for t, s in zip(ascii_texts, seen)), p


def test_what_java_reads_differently_is_not_widened():
    for p in (r"[a[bc]]", r"[a-z&&[^b]]", r"\p{L}", r"\h", "(?x)a b", "İ"):
        assert widened(p) is None


def test_other_characters_and_unwidened_patterns_are_always_possible(spark):
    rows = spark.createDataFrame([(0, "ſelect"), (1, "nothing"), (2, "select"), (3, None)], "id int, t string")
    got = {r.id: r for r in rows.select("id", possible([F.col("t")], [([0], ["select"]), ([0], [r"\p{L}"]), ([0], [])]).alias("m"),
                                        possible_patterns(F.col("t"), F.lit("k"), {"k": ["zzz", "select"]}).alias("p")).collect()}
    assert [got[i].m for i in range(4)] == [[True, True], [False, True], [True, True], [False, False]]
    assert [got[i].p for i in range(4)] == [[0, 1], [], [1], []]
