import pytest
from pyspark.sql import functions as F

from shelfwright.functions.normalize import (alias_key, norm_chunk, norm_name, norm_title,
                                             person_from_string, person_key)


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    rows = df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_norm_name_golden(spark):
    # Names and what they must normalise to.
    got = values(spark, norm_name, ["1щёпкина ", "Щепкина-Куперник", " !4-###", "War and Peace", "1984", None])
    assert got == ["Щепкина", "Щепкина-Куперник", None, "Warandpeace", None, None]


def test_norm_chunk_case_mapping(spark):
    got = values(spark, norm_chunk, ["ßtraße", "!!! ТОЛСТОЙ !!!", "  ", "ΟΔΥΣΣΕΥΣ", "Ёлка"])
    # full upper-case mapping of a leading ß, per-character lower-casing of Σ
    assert got == ["SStraße", "Толстой", None, "Οδυσσευσ", "Елка"]


def test_norm_title_blank(spark):
    assert values(spark, norm_title, ["   ", "", "Война и мир"]) == [None, None, "Войнаимир"]


def test_person_key_golden(spark):
    df = spark.createDataFrame([(" Лёва /! ", "Николаёвич", "Тол,ст.ой 1.")], "l string, f string, m string")
    assert df.select(person_key("l", "f", "m")).first()[0] == "Лева Николаевич Толстой"
    df = spark.createDataFrame([(None, "!!", None)], "l string, f string, m string")
    assert df.select(person_key("l", "f", "m")).first()[0] is None


@pytest.mark.parametrize("s,ok,key", [
    ("Толстой Лев Николаевич", True, "Толстой Лев Николаевич"),
    ("  Иванов   Иван ", True, "Иванов Иван"),
    ("Петров", True, "Петров"),
    ("", False, None),
    ("a b c d", False, None),
    ("123", False, None),
])
def test_person_from_string(spark, s, ok, key):
    r = spark.createDataFrame([(s,)], "s string").select(person_from_string(F.col("s")).alias("p")).first()["p"]
    assert (r["error"] is None) == ok
    assert r["id"] == key


def test_alias_key_normalises_parts(spark):
    # the documented alias example matches the person key it names
    assert values(spark, alias_key, ["Иванов И. И.", "И.И. Иванов", " "]) == ["Иванов И И", "Ии Иванов", None]
