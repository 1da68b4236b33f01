from pyspark.sql import functions as F

from shelfwright.functions.digest import book_digest, hex_id, stable_id


def test_digest_golden(spark):
    # Books and the digests they must have.
    df = spark.createDataFrame([
        ("Booktitle", "12345", None, ["Аркадий Стругацкий"]),
        ("Названиекнижки", None, None, ["Толстой Лев"]),
        ("Title", None, None, []),
    ], "t string, e string, v string, ids array<string>")
    got = [r[0] for r in df.select(book_digest("t", "e", "v", "ids")).collect()]
    assert got[0] == "bf4f23dfe397875a6e0931b449ce440e"
    assert got[1] == "1e1359611be8b8a0512fb845018540a4"
    import hashlib
    assert got[2] == hashlib.md5("Title||".encode()).hexdigest()  # no trailing bar


def test_stable_id_matches_hex_prefix(spark):
    import hashlib
    r = spark.createDataFrame([("x",)], "k string").select(stable_id(F.col("k")).alias("i")).first()["i"]
    assert r == int(hashlib.md5(b"x").hexdigest()[:15], 16)
    r2 = spark.createDataFrame([("ffffffffffffffff",)], "k string").select(hex_id(F.col("k"))).first()[0]
    assert r2 == int("f" * 15, 16)
