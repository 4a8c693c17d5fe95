"""Character n-grams counted by distinct words are those of the whole texts."""

from pyspark.sql import functions as F

from terrace.operators import textvec


def test_each_word_of_the_table_is_cut_once(spark, monkeypatch):
    texts = [None, "", "   ", "a", "to be or not to be", "Be be BE", "été été ete", "banana  bandana", "ab́c", "banana"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    wanted = {(r.term, r.df, r.total_count) for r in textvec.token_counts(df, "text", "char").collect()}
    # Whole texts are not cut: only the words of the table and the distinct words of a text.
    monkeypatch.setattr(textvec, "with_tokens", lambda *_: 1 / 0)
    assert {(r.term, r.df, r.total_count) for r in textvec.char_counts(df, "text").collect()} == wanted
    assert textvec.term_stats(df, "text", "char", min_df=2).where(F.col("term") == " be").first()[1:3] == (2, 5)
