"""Scalar expressions against hand-derived golden values (FIXTURES.md, part C)."""

from pyspark.sql import functions as F

from verity.functions import (castable_float, closest_rating_label, column_role, date_shape,
                              is_title_style, is_valid_email, normalise_email, rating_word_number,
                              smart_title)
from verity.operators.repair import phone_format


def one(spark, expr, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_column_roles():
    got = [column_role(c) for c in ("plastic", "cancelled", "payment", "doc_id", "o_orderdate", "c_name", "value")]
    assert got == ["name", "phone", "critical", "id", "date", "name", "generic"]


def test_rating_words_first_hit_in_order(spark):
    vals = ["unsatisfactory", "unacceptable", "below average", "above average", "not good", "meh"]
    assert one(spark, rating_word_number(F.col("v")), vals) == ["3.5", "3.5", "3.0", "4.5", "4.0", None]


def test_closest_label_tie_goes_low(spark):
    got = one(spark, closest_rating_label(F.col("v")), [4.25, 3.0, 9.0, float("nan")], "v double")
    assert got == ["Competent", "Standard", "Exceptional", "Average"]


def test_smart_title(spark):
    got = one(spark, smart_title(F.col("v")), ["LUDWIG VAN  beethoven", "van gogh", "  de la cruz  ", ""])
    assert got == ["Ludwig van Beethoven", "Van Gogh", "De la Cruz", ""]


def test_title_style_matches_python(spark):
    vals = ["Hello World", "hello", "HELLO", "A", "123", "Don't", "McDonald", "Ab Cd", "x1Y"]
    assert one(spark, is_title_style(F.col("v")), vals) == [v == v.title() for v in vals]


def test_castable_float_python_grammar(spark):
    vals = ["1,200.5", "  7 ", "1_000", "inf", "-NaN", "12f", "1e5", ".5", "abc", "1-2"]
    expect = []
    for v in vals:
        try:
            float(v.strip().replace(",", ""))
            expect.append(True)
        except ValueError:
            expect.append(False)
    assert one(spark, castable_float(F.col("v")), vals) == expect


def test_email_normalise_and_check(spark):
    vals = ["  User5@Gmial.com ", "a@b@yahooo.com", "nope"]
    assert one(spark, normalise_email(F.col("v")), vals) == ["user5@gmail.com", "a@b@yahoo.com", "nope"]
    assert one(spark, is_valid_email(F.col("v")), ["a.b@c.com", "not-an-email", "x@y"]) == [True, False, False]


def test_phone_format(spark):
    got = one(spark, phone_format(F.col("v")), ["555-123-4567", "1 555 123 4567", "12345"])
    assert got == ["(555) 123-4567", "+1 (555) 123-4567", None]


def test_date_shapes(spark):
    got = one(spark, date_shape(F.col("v")), ["2024-01-05", "01/05/2024", "01-05-2024", "05.01.2024",
                                               "2024/01/05", "5/1/2024"])
    assert got == [0, 1, 2, 3, 4, None]
