import posixpath
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marrow.functions import text as T

# Fixed cases of globs: pattern, path, whether it matches.
GLOBS = [
    ("*.md", "a.md", True), ("*.md", "a/b.md", False), ("**/*.md", "a.md", True), ("**/*.md", "a/b/c.md", True), ("**", "a/b", True), ("docs/**", "docs/a/b.md", True), ("docs/**", "doc/a.md", False),
    ("**.md", "a.md", True), ("**.md", "a/b.md", False), ("a**b", "a", False), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[a-c", "a", False), ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True), ("\\*", "*", True), ("\\*", "a", False),
]


def test_globs(spark):
    rows = spark.createDataFrame([(p, w, k) for k, (_, p, w) in enumerate(GLOBS)], "path string, want boolean, k int")
    for k, (pattern, _, _) in enumerate(GLOBS):
        r = rows.where(F.col("k") == k).select(T.glob_matches(F.col("path"), pattern).alias("got"), "want").first()
        assert r["got"] == r["want"], GLOBS[k]


def test_clean_path(spark):
    paths = ["", ".", "a", "a/", "a//b", "./a", "a/./b", "a/../b", "../a", "a/../../b", "/..", "/a/../..", "/", "//a", "a/b/../../..", "..", "x/..", "a/...", ".a", "a/.b/"]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(T.clean_path(F.col("p"))).collect()]
    assert got == ["/" + posixpath.normpath(p).lstrip("/") if p.startswith("/") else posixpath.normpath(p) for p in paths]


def test_folds(spark):
    r = spark.createDataFrame([("ÉΑΣ İx ",)], "s string").select(T.ufold(F.col("s")), T.afold(F.col("s")), T.norm_key(F.col("s"))).first()
    assert r[0] == "éασ ix " and r[1] == "ÉΑΣ İx " and r[2] == "éασ ix"
    assert T.fold("ÉΑΣ İ") == "éασ i"


def test_linear_regex():
    assert T.linear_regex("a(?=b)") is None and T.linear_regex(r"(a)\1") is None and T.linear_regex("a++") is None
    assert T.linear_regex("c$") == r"(?d)c\z"
    assert T.linear_regex("(?m)c$") == "(?d)(?m)c$"
    assert T.linear_regex(r"\s[\s]") == "(?d)[\\t\\n\\f\\r ][\\t\\n\\f\\r ]"
    assert T.linear_regex("(?P<n>a)") == "(?d)(?<n>a)"
    assert T.linear_regex("[[:alpha:]]") == "(?d)[a-zA-Z]"


def test_regex_matches(spark):
    df = spark.createDataFrame([("abc\r\nd",), ("c\n",), ("c",)], "s string")
    got = lambda p: [r[0] for r in df.select(T.regex_matches(F.col("s"), p)).collect()]
    assert got("(?m)c$") == [False, True, True]
    assert got("c$") == [False, False, True]
    assert got("(") == [False] * 3
    assert got("[z-a]") == [False] * 3


@settings(max_examples=60, deadline=None)
@given(st.text("ab*?/", max_size=8), st.text("ab/", max_size=8))
def test_glob_regex_is_a_pattern(pattern, path):
    rx = T.glob_regex(pattern)
    if rx is not None:
        re.compile(rx.replace("\\z", "\\Z"))
