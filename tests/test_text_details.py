"""Line ends, white space and numbers as texts show them."""

import random

from pyspark.sql import functions as F

from panelyard.operators import report, text


def test_crlf_and_tabs(spark):
    df = spark.createDataFrame([(1, "# A\r\n\r\none\r\n\r\ntwo\r\n| a | b |\r\n|---|---|\r\n|\tc\t|\r\n\t- x \t\r\n"), (2, "\u3000## H\u3000\r\u2028p\tq\x0br\x85\x1cs "), (3, None), (4, "\r\n \t")], "id int, text string")
    blocks = [tuple(r) for r in text.markdown_blocks(df, ["id"]).where("id = 1").orderBy("ordinal").select("kind", "level", "text", "rows").collect()]
    assert blocks == [("heading", 1, "A", None), ("paragraph", 0, "one", None), ("paragraph", 0, "two", None), ("table", 0, "", [["a", "b"], ["c", ""]]), ("bullet", 0, "x", None)]
    got = [tuple(r) for r in text.paragraphs(df, ["id"]).orderBy("id", "ordinal").select("id", "kind", "heading", "block").collect()]
    want = [(1, "heading", "A", "A"), (1, "paragraph", "A", "one"), (1, "paragraph", "A", "two | a | b | |---|---| | c | - x"), (2, "heading", "H", "H"), (2, "paragraph", "H", "p q r"), (2, "paragraph", "H", "s")]
    assert got == want


def test_pages_split_at_any_blank_line(spark):
    df = spark.createDataFrame([(1, "a\n \t\n\nb\u3000c\fd")], "id int, text string")
    assert [(r.page, r.block) for r in text.page_paragraphs(df, ["id"]).orderBy("page", "paragraph").collect()] == [(1, "a"), (1, "b c"), (2, "d")]


def test_numbers_are_those_of_the_double(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.125, 0.375, 0.015, 0.01, 0.0, 1.0, -2.675, -0.125, 999999.995, 123456.785, 99.995, 9.995] + [rng.uniform(-1, 1) * 10 ** rng.uniform(-2, 6) for _ in range(2000)] + [k / 8 for k in range(-50, 50)]
    xs = [x for x in xs if x == 0 or 0.01 <= abs(x) < 1e6]
    got = [r.t for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(report.number_text(F.col("x")).alias("t")).collect()]
    assert got == [f"{x:.2f}" for x in xs]
