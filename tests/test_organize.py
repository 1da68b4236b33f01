from pyspark.sql import functions as F

from shelfwright.functions.naming import sanitize
from shelfwright.operators.organize import destination, move_plan, unique_destination
from shelfwright.operators.ranking import group_ordinal

PERSON = "struct<id:string,first_name:string,middle_name:string,last_name:string>"


def test_unique_destination_golden(spark):
    a = {"id": "A", "first_name": None, "middle_name": None, "last_name": "A"}
    b = {"id": "B", "first_name": None, "middle_name": None, "last_name": "B"}
    rows = [(f"in/{i}.fb2", "T", [a]) for i in range(4)]
    rows += [(f"in/{i}.fb2", "T(1)", [a]) for i in (4, 5)]
    rows += [("in/6.fb2.zip", "T", [b]), ("in/7.fb2", "Q", [])]
    df = spark.createDataFrame(rows, f"path string, title string, authors array<{PERSON}>")
    plan = unique_destination(destination(df, "lib"), "lib")
    got = {r["path"]: r["dest_unique"] for r in plan.collect()}
    assert [got[f"in/{i}.fb2"] for i in range(6)] == [
        "lib/A/T.fb2", "lib/A/T(2).fb2", "lib/A/T(3).fb2", "lib/A/T(4).fb2", "lib/A/T(1).fb2",
        "lib/A/T(1)(1).fb2"]
    assert got["in/6.fb2.zip"] == "lib/B/T.fb2.zip"
    assert got["in/7.fb2"] == "lib/UnknownAuthor/Q.fb2"
    mp = {r["source"]: r["action"] for r in move_plan(plan).collect()}
    assert set(mp.values()) == {"move"}


def test_unique_destination_is_unique_on_a_hot_name(spark):
    rows = [(f"in/{i:05d}.fb2", "Same", []) for i in range(3000)]
    rows += [(f"in/x{k}.fb2", f"Same({k})", []) for k in (1, 2, 5, 6, 7, 100)]
    df = spark.createDataFrame(rows, f"path string, title string, authors array<{PERSON}>").repartition(7)
    plan = unique_destination(destination(df, "lib"), "lib")
    names = [r["unique_name"] for r in plan.collect()]
    assert len(names) == len(set(names)) == len(rows)
    same = sorted(int(n[5:-1]) for n in names if n.startswith("Same(") and n.count("(") == 1)
    # 3000 copies: one keeps the name, 2999 take the free numbers 3,4,8,9,... and the 6 literals stay
    assert len(same) == 2999 + 6


def test_group_ordinal_matches_row_number(spark):
    from pyspark.sql import Window
    rows = [(i % 3, f"p{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "g int, p string").repartition(5)
    got = group_ordinal(df, ["g"], ["p"], out="o")
    ref = df.withColumn("o", F.row_number().over(Window.partitionBy("g").orderBy("p")) - 1)
    assert sorted(got.collect()) == sorted(ref.select("g", "p", "o").collect())


def test_sanitize(spark):
    df = spark.createDataFrame([("a/b:c*d?e\"f<g>h|i\x01j",), ("   ",), ("Война и мир",), ("abcdef",)], "s string")
    got = [r[0] for r in df.select(sanitize(F.col("s"))).collect()]
    assert got == ["a_b_c_d_e_f_g_h_i_j", "unnamed", "Война и мир", "abcdef"]
    got = [r[0] for r in df.select(sanitize(F.col("s"), 5)).collect()]
    # 5 bytes: "Во" is 4 bytes, "Вой" 6 -> cut at the character boundary
    assert got == ["a_b_c…", "unnamed", "Во…", "abcde…"]


def test_unique_destination_without_numbered_titles(spark):
    rows = [(f"in/{i}.fb2", "X", []) for i in range(3)] + [("in/y.fb2", "Y", [])]
    df = spark.createDataFrame(rows, f"path string, title string, authors array<{PERSON}>")
    got = sorted(r["unique_name"] for r in unique_destination(destination(df, "lib"), "lib").collect())
    assert got == ["X", "X(1)", "X(2)", "Y"]
