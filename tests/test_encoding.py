import pytest
from pyspark.sql import functions as F

from shelfwright.functions.encoding import (CHARSETS, charset_table, decode_books, declared_encoding,
                                            recode)


@pytest.mark.parametrize("head,expected", [
    (b'<?xml version="1.0" encoding="windows-1251"?><a/>', "windows-1251"),
    (b'<?xml version="1.0"?><a/>', "utf-8"),
    (b"garbage", "utf-8"),
    (b'<?xml version="1.0" encoding="KOI8-R"?>', "koi8-r"),
    (b"<?xml version='1.0' encoding='koi8-r'?>", "utf-8"),
    (b'<?xml version="1.0" encoding="cp1251?>', "utf-8"),
    (b'<?xml version="1.0" encoding="cp1251"', None),
])
def test_declared_encoding(spark, head, expected):
    df = spark.createDataFrame([(bytearray(head),)], "c binary")
    assert df.select(declared_encoding(F.col("c"))).first()[0] == expected


@pytest.mark.parametrize("cs,name", [("cp1251", "windows-1251"), ("koi8-r", "koi8-r"),
                                     ("cp1252", "cp1252"), ("cp1255", "cp1255")])
def test_recode_whole_upper_half(spark, cs, name):
    raw = bytes(range(0x20, 0x100))
    df = spark.createDataFrame([(bytearray(raw), name)], "c binary, e string")
    got = df.select(recode(F.col("c"), F.col("e"))).first()[0]
    assert got == raw.decode(cs, errors="replace")


def test_iso_tables_have_no_c1_controls():
    for cs in ("iso-8859-1", "iso-8859-5"):
        assert charset_table(cs)[:32] == "�" * 32
    assert all(len(charset_table(c)) == 128 for c in CHARSETS)


def test_decode_books_errors(spark):
    rows = [
        ("a.fb2", bytearray(b'<?xml version="1.0" encoding="big5"?><a/>')),
        ("b.fb2", bytearray(b"\xff\xfe<a/>")),
        ("c.fb2", bytearray('<?xml version="1.0" encoding="windows-1251"?><a>'.encode() + "Лев".encode("cp1251") + b"</a>")),
        ("d.fb2", bytearray(b'<?xml version="1.0"')),
    ]
    df = decode_books(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["path"]: (r["encoding"], r["text"], r["error"]) for r in df.collect()}
    assert got["a.fb2"][2] == "unsupported encoding: big5"
    assert got["b.fb2"][2] == "malformed UTF-8"
    assert got["c.fb2"][2] is None and got["c.fb2"][1].endswith("<a>Лев</a>")
    assert got["d.fb2"][2] == "XML declaration incomplete"
