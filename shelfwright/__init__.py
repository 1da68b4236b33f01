"""shelfwright: a Spark-native e-book catalogue pipeline.

Scan FB2 files, decode legacy charsets, pull metadata out of the XML,
normalise titles and author names, resolve aliases, fingerprint and
de-duplicate books, maintain append-only ``books`` / ``persons`` /
``book_authors`` tables, keep a blacklist of broken files and plan a
by-author file layout -- all as DataFrame operations on built-in Spark
expressions.
"""

__version__ = "0.1.0"
