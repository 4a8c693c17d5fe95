"""Benchmark decontamination: winnowed word k-grams join, hits extend to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import written

#: What stands between words once A-Z are lower-cased: ASCII but for digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window; an item with fewer is one window of its own length.
WINDOW = 10
#: Benchmark tables of at most so many rows (16 to 40 bytes each) are broadcast after a count; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Salts of a shuffled fingerprint join, so that a passage in a third of all documents is dealt out.
SALTS = 16


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order; null has none."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def gram(length: int) -> int:
    """Words of a fingerprint's k-gram for windows of so many words: two k-grams cover a window."""
    return (length + 1) // 2


def ahead(values: Column, at: Column, n: int) -> list[Column]:
    return [F.get(values, at + i) for i in range(1, n)]


def with_marks(df: DataFrame, length: int) -> DataFrame:
    """From word hashes ``h``: ``grams``, the k-gram hashes, and ``marks``, the least of them in each window of ``length`` words."""
    k = gram(length)
    n = F.size("h")

    def first(values: Column, count: Column) -> Column:
        return F.slice(values, F.lit(1), F.greatest(count, F.lit(0)))

    grams = first(F.col("h"), n - (k - 1)) if k == 1 else F.transform(first(F.col("h"), n - (k - 1)), lambda x, i: F.xxhash64(x, *ahead(F.col("h"), i, k)))
    df = df.withColumn("grams", grams)
    width = length - k + 1
    marks = first(F.col("grams"), n - (length - 1))
    if width > 1:
        marks = F.transform(marks, lambda x, i: F.least(x, *ahead(F.col("grams"), i, width)))
    return df.withColumn("marks", marks)


def mark_key(mark: Column, length: int) -> Column:
    """One join key for the fingerprint and the window length; unequal ones that meet fall to the check of windows."""
    return mark.bitwiseXOR(F.lit(length))


def runs(df: DataFrame, length: int) -> DataFrame:
    """``run``: one entry per fingerprint of a text, with the k-grams of the windows that share it.

    Windows in a row with one least k-gram make one entry: ``mark``,
    ``length``, ``start`` (word number of the first of them) and ``grams``
    (k-gram hashes from there on, to the last k-gram of the last window).
    """
    df = with_marks(df, length)
    begins = F.filter(F.transform("marks", lambda x, i: F.when(~x.eqNullSafe(F.get(F.col("marks"), i - 1)), i)), lambda i: i.isNotNull())
    df = df.withColumn("begins", begins)
    rest = length - gram(length)

    def entry(s: Column, j: Column) -> Column:
        end = F.coalesce(F.get(F.col("begins"), j + 1), F.size("marks"))
        return F.struct(
            mark_key(F.get(F.col("marks"), s), length).alias("mark"), F.lit(length).alias("length"), s.alias("start"), F.slice("grams", s + 1, end - s + rest).alias("grams"),
        )

    return df.withColumn("run", F.transform("begins", entry)).drop("grams", "marks", "begins")


def window_entries(length: int) -> Column:
    """Fingerprint and both halves of every window."""
    second = length - gram(length)
    return F.transform("marks", lambda x, i: F.struct(
        mark_key(x, length).alias("mark"), F.get(F.col("grams"), i).alias("a"), F.get(F.col("grams"), i + second).alias("b"),
    ))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows with the number of the item set they occur in, the members of those sets, and the window lengths.

    Windows of the same items share one set number: a hash of a sum, an
    exclusive or and a count over item hashes, so no list of items is built.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    items = written(items.withColumn("length", F.least(F.size("h"), F.lit(WINDOW))), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # ten at most
    parts = None
    for length in lengths:
        part = with_marks(items.where(F.col("length") == length), length)
        part = part.select("item", "length", F.inline_outer(window_entries(length)))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = items.select("item", "length").limit(0).select("item", "length", *[F.lit(0).cast("long").alias(c) for c in ("mark", "a", "b")])
    each = written(parts.distinct(), "item-windows")
    low = [F.xxhash64("item", F.lit(s)) for s in (1, 2)]
    windows = each.groupBy("length", "mark", "a", "b").agg(
        F.bit_xor(low[0]).alias("x"), F.sum(F.shiftright(low[1], 24)).alias("s"), F.count("item").alias("n"),
    ).select("length", "mark", "a", "b", F.xxhash64("x", "s", "n").alias("items"))
    windows = written(windows, "windows")
    members = each.where(F.col("item").isNotNull()).join(windows, ["length", "mark", "a", "b"]).select("items", "item").distinct()
    return windows, written(members, "members"), lengths


def small(df: DataFrame, limit: int) -> DataFrame:
    """Marked for broadcasting where a count of its rows allows it."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    A window is ``WINDOW`` words in a row of a benchmark text, or all words of
    a shorter one; a document word inside an occurrence of a window is hit.
    Texts are reduced to fingerprints, the least k-gram hash of each window
    (k is half a window), which are kept once for windows in a row. Equal
    windows have equal fingerprints, so every shared window is met. A met
    fingerprint extends to the windows that it stands for; both halves of
    each must equal those of a benchmark window.

    Null and empty texts have no words: no hits in a document, no windows in
    an item. Repeated rows of documents each give a row; repeated items
    count once by ``item_id``. Items without id hit words and count as no
    item. Ties between equal least hashes need no rule, since a window's
    fingerprint is a value, not a place. A very long text is one row of hash
    arrays (about 60 bytes a word). Other columns play no part, whatever
    their names; empty tables give no rows, or rows without hits.
    """
    windows, members, lengths = benchmark_windows(benchmark)
    # Rows of one id and one text have one result.
    key = [F.xxhash64(F.lit(s), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).alias(n) for s, n in ((1, "k1"), (2, "k2"))]
    texts = docs.select("doc_id", "text")
    hashed = texts.select(*key, word_hashes(F.col("text")).alias("h"))
    # The outer form of inline(): for the plain one the optimiser adds a filter with all arrays spelt out inside each other.
    found = None
    for length in lengths or [WINDOW]:
        part = runs(hashed, length).select("k1", "k2", F.inline_outer("run"))
        found = part if found is None else found.unionByName(part)
    marks = windows.select("mark").distinct()
    if marks.count() <= limit:
        met = found.join(F.broadcast(marks), "mark", "left_semi")
    else:
        salted = marks.select("mark", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = found.withColumn("salt", F.pmod(F.col("k1"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["mark", "salt"], "left_semi")
    rest = F.col("length") - F.floor((F.col("length") + 1) / 2).cast("int")
    entries = F.transform(
        F.slice("grams", F.lit(1), F.size("grams") - rest), lambda a, i: F.struct(a.alias("a"), F.get(F.col("grams"), i + rest).alias("b"), (F.col("start") + i).alias("start")),
    )
    spread = met.select("k1", "k2", "length", entries.alias("entries")).select("k1", "k2", "length", F.inline_outer("entries"))
    hits = spread.join(small(windows.select("length", "a", "b", "items").distinct(), limit), ["length", "a", "b"])
    hits = hits.select("k1", "k2", "start", (F.col("start") + F.col("length")).alias("end"), "items").distinct()
    order = W.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(order), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    # The sets of a text are no more than its words.
    per_doc = written(hits.withColumn("fresh", fresh).groupBy("k1", "k2").agg(
        F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set("items")).alias("sets")).withColumn("sign", F.xxhash64("sets")), "hits")
    # Documents that met the same sets share one list of items.
    signs = per_doc.groupBy("sign").agg(F.first("sets").alias("sets")).select("sign", F.explode("sets").alias("items"))
    listed = signs.join(members, "items").select("sign", "item").distinct().groupBy("sign").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    results = per_doc.drop("sets").join(listed, "sign", "left").drop("sign")
    counted = texts.select("doc_id", *key, F.size(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(results, ["k1", "k2"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
