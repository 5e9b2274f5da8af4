from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T

WS_SAMPLE = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0  　"
ALPHABET = st.sampled_from(list(WS_SAMPLE) + list("aZé1٣ ßǅ​"))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=40, max_size=40))
def test_strip_and_collapse_match_python(spark, samples):
    import re
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(T.py_strip("s").alias("a"), T.collapse_ws("s").alias("b"),
                    T.is_upper("s").alias("u"), T.is_blank("s").alias("z")).collect()
    for s, r in zip(samples, got):
        assert r.a == s.strip()
        assert r.b == re.sub(r"\s+", " ", s.strip())
        assert r.u == s.isupper()
        assert r.z == (s.strip() == "")


def test_splitlines_and_suffix(spark):
    samples = ["a\nb", "a\r\nb\r", "", "x y\x85", "one\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(T.splitlines("s").alias("l")).collect()
    assert [list(r.l) for r in got] == [s.splitlines() for s in samples]
    from pathlib import Path
    paths = ["book.HTML", "a/b.c/story.txt", "noext", ".bashrc", "x.tar.gz", "doc.htm"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.x for r in df.select(T.file_suffix("p").alias("x")).collect()] == \
        [Path(p).suffix.lower() for p in paths]
