from pyspark.sql import functions as F

from shelfwright.llm import quote_links as Q


def links(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, text string, hash string, mid long")
    return {(r.conv_id, r.turn): r for r in Q.link_quotes(df).collect()}


def test_levels(spark):
    text = "hi\nOn Monday they wrote:\n> > deep line\n> On Sunday she wrote:\n>> other\n> near\n  > spaced\nown wrote:\nend"
    got = spark.createDataFrame([(text,)], "t string").select(Q.quote_lines(F.col("t")).alias("l")).first().l
    assert [(x.level, x.content) for x in got] == [(0, "hi"), (2, "deep line"), (2, "other"), (1, "near"), (1, "spaced"), (0, "own wrote:"), (0, "end")]


def test_replies_threads_and_other_conversations(spark):
    got = links(spark, [
        (1, 0, "First  message\nwith two lines"), (1, 1, "> first message\n> WITH two lines\nAnswer one here"),
        (1, 2, "> > First message\n> Answer one here\nthird"), (1, 3, "> with two lines\nfourth"), (1, 4, "> never said\nfifth"),
        (2, 0, "> Answer one here\nquoting another list"), (2, 1, None), (3, None, "> First message"), (None, 2, "> First message"),
        (0, 9, "> third\nmust not point forward"), (4, 0, ""), (4, 1, ">" * 20_000 + " x")])
    at = lambda k: (got[k].reply_conv, got[k].reply_turn, got[k].thread_conv, got[k].thread_turn, got[k].depth)
    assert at((1, 0)) == (None, None, 1, 0, 0) and at((1, 1)) == (1, 0, 1, 0, 1) and at((1, 2)) == (1, 1, 1, 0, 2)
    assert at((1, 3)) == (1, 0, 1, 0, 1) and at((1, 4)) == (None, None, 1, 4, 0) and at((2, 0)) == (1, 1, 1, 0, 2)
    assert at((0, 9))[:2] == (None, None) and at((3, None))[:2] == (None, None) and at((None, 2))[:2] == (None, None)
    assert got[1, 2].own_text == "third" and got[1, 2].max_level == 2 and (got[1, 2].n_quoted, got[1, 2].n_linked) == (2, 2)
    assert (got[1, 4].n_quoted, got[1, 4].n_linked) == (1, 0) and got[2, 1].own_text == "" and got[4, 1].max_level == 20_000


def test_long_chain_repeated_rows_and_empty_table(spark):
    rows = [(7, k, (f"> line number {k - 1}\n" if k else "") + f"line number {k}") for k in range(70)]
    got = links(spark, rows)
    assert all(got[7, k].depth == k and got[7, k].thread_turn == 0 for k in range(70))
    df = spark.createDataFrame([(1, 0, "a a"), (1, 0, "a a"), (1, 1, "> a a\nb")], "conv_id long, turn long, text string")
    rows = Q.link_quotes(df).collect()
    assert len(rows) == 3 and [(r.reply_turn, r.depth) for r in rows if r.turn == 1] == [(0, 1)]
    assert Q.link_quotes(df.limit(0)).count() == 0 and Q.link_quotes(Q.as_mail(df.limit(0))).count() == 0


def test_mail_quotes_two_levels(spark):
    df = spark.createDataFrame([(1, 0, "a\nb"), (1, 1, "c"), (1, 2, "d")], "conv_id long, turn long, text string")
    got = {r.turn: r.text for r in Q.as_mail(df).collect()}
    assert got[0] == "a\nb" and got[2] == "On turn 1 they wrote:\n> > a\n> > b\n> c\nd"


def test_quotes_wrapped_anew(spark):
    said = "the quick brown fox jumps over\nthe lazy dog. It\nruns far away"
    got = links(spark, [
        (1, 0, said), (1, 1, "> The quick brown\n> fox jumps over the lazy dog. It runs\n> far away\nno"),
        (1, 2, "> It\n>\n> runs far  away\n> > and runs far\n> nothing of this was ever said\nlast"), (2, 0, "> dog. It runs\nshort")])
    assert [got[1, k].reply_turn for k in range(3)] == [None, 0, 0]
    assert (got[1, 1].n_quoted, got[1, 1].n_linked) == (1, 1)
    assert (got[1, 2].n_quoted, got[1, 2].n_linked, got[1, 2].max_level) == (3, 1, 2)
    assert got[2, 0].reply_turn is None


def test_mail_wraps_a_share_of_its_quotes(spark):
    said = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(c, t, said) for c in range(20) for t in (0, 1)], "conv_id long, turn long, text string")
    mail = [r.text for r in Q.as_mail(df).filter("turn = 1").collect()]
    anew = sum("\n> w9 " in t for t in mail)
    assert 0 < anew < 20 and all(f"> {said}\n" in t or "\n> w9 " in t for t in mail)
    assert all(r.reply_turn == 0 and r.n_linked == 1 for r in Q.link_quotes(Q.as_mail(df)).collect() if r.turn == 1)
