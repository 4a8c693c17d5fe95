"""I-Match fingerprints over randomised subsets of a mid-frequency lexicon."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import WHITE, body

#: Subsets per density, and the share of terms (1 / n) that a subset of each density holds.
SUBSETS = 16
DENSITIES = (32, 128, 512, 2048)
#: The band: terms in at least and at most this share of the documents.
RAREST, COMMONEST = 0.0002, 0.01
#: A text with fewer terms in the band has its band widened upwards, by doubling, until it has so many.
FEW = 16
#: More lexicon terms than this are not broadcast. The lexicon holds at most (distinct terms in a document, on average) / RAREST.
LEXICON_LIMIT = 20_000_000
LOWEST = -(1 << 63)


def slot(h: Column, scale: int) -> Column:
    """Number of the subset of this density that holds the term, or one that no subset has (``SUBSETS`` and above)."""
    return F.pmod(F.shiftrightunsigned(h, 12 * scale), F.lit(DENSITIES[scale]))


def term_hashes(text: Column) -> Column:
    """Distinct terms (lower case, split at white space) as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), f"{WHITE}+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def held_terms(terms: Column) -> Column:
    """Those that some subset holds; no others are counted or looked up."""

    def held(h: Column) -> Column:
        found = slot(h, 0) < SUBSETS
        for scale in range(1, len(DENSITIES)):
            found = found | (slot(h, scale) < SUBSETS)
        return found

    return F.filter(terms, held)


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Terms from the lower limit of the document-frequency band on, as ``term, level``.

    ``level`` 0 is the band; the terms of level k are in at most ``2**k``
    times its upper limit of the documents.

    The lower limit bounds the table: the frequencies of its terms sum to no
    more than all distinct terms of all documents, and each is at least
    ``rarest`` of the documents. Counts cover every document.
    """
    total = docs.count()
    low, high = max(2, math.ceil(rarest * total)), max(2, math.floor(commonest * total))
    terms = docs.select(F.explode(held_terms(term_hashes(body()))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= low).select("term", F.ceil(F.log2(F.greatest(F.col("n") / high, F.lit(1.0)))).cast("int").alias("level"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with the text of the next document by descending ``doc_id``; the first follows the last.

    Rows are dealt into ranges of ``doc_id`` by approximate quantiles. The
    first row of each range also goes to the range before it, as a guest, so
    the texts move once. Result: ``bucket, row, doc_id, text, next_text, guest``.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", body().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 100_000)).first()[0] or []))
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    table = F.lit(cuts) if cuts else F.array().cast("array<bigint>")

    def down(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= F.col("key")), at + step).otherwise(at)

    dealt = rows.withColumn("bucket", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), down))
    heads = sorted(((r.bucket, r.key) for r in dealt.groupBy("bucket").agg(F.max("key").alias("key")).collect()), reverse=True)
    # The head of each range visits the range above it, the first head the last range.
    visits = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    guests = spark.createDataFrame(visits, "key long, to int")
    visiting = dealt.join(F.broadcast(guests), "key").select("doc_id", "text", "key", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    both = dealt.select("doc_id", "text", "key", "bucket", F.lit(False).alias("guest")).unionByName(visiting)
    order = W.partitionBy("bucket").orderBy("guest", F.col("key").desc(), F.xxhash64("text"))
    return both.select("bucket", F.row_number().over(order).alias("row"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "guest")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def band_top(side: int) -> Column:
    """Level of the narrowest band that holds ``FEW`` of a side's known terms, or else all it has; it depends on that side's text alone."""
    own = F.array_sort(F.transform(F.filter("terms", lambda t: t["sides"].bitwiseAND(F.lit(side)) > 0), lambda t: t["level"]))
    return bind(own, lambda x: F.coalesce(F.get(x, F.least(F.size(x), F.lit(FEW)) - 1), F.lit(0)))


def subset_hashes(side: int, top: Column) -> Column:
    """One hash per subset over its sorted terms on one side up to a level; null where it has none."""
    own = F.transform(F.filter(F.array_sort("terms"), lambda t: (t["sides"].bitwiseAND(F.lit(side)) > 0) & (t["level"] <= top)), lambda t: t["term"])

    def parts(sorted_terms: Column, scale: int) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
        return bind(F.filter(sorted_terms, lambda h: slot(h, scale) < SUBSETS), lambda kept: F.transform(numbers, lambda j: F.filter(kept, lambda h: slot(h, scale) == j)))

    filled = bind(own, lambda x: F.concat(*[parts(x, scale) for scale in range(len(DENSITIES))]))
    return F.transform(filled, lambda held: F.when(F.size(held) > 0, F.xxhash64(held)))


def plain(terms: Column) -> Column:
    """Fingerprint of a text without lexicon terms: a hash of all its sorted distinct terms."""
    return bind(F.array_sort(terms), lambda x: F.concat(F.lit("t"), F.lower(F.hex(F.xxhash64(x))), F.lower(F.hex(F.xxhash64(F.lit(1), x)))))


def printed(side: str) -> Column:
    """The fingerprint as text: the hash of each subset, in order."""
    joined = F.array_join(F.transform(F.col(f"{side}_hashes"), lambda h: F.coalesce(F.lower(F.hex(h)), F.lit(""))), ".")
    return F.when(F.exists(f"{side}_hashes", lambda h: h.isNotNull()), joined).otherwise(F.col(f"{side}_plain"))


def likeness(one: str, other: str) -> Column:
    """Share of equal hashes among the subsets that either side fills; 1 or 0 for fingerprints without subsets."""
    pairs = F.zip_with(F.col(f"{one}_hashes"), F.col(f"{other}_hashes"), lambda a, b: F.struct((a.isNotNull() | b.isNotNull()).alias("any"), F.coalesce(a == b, F.lit(False)).alias("same")))
    filled = F.size(F.filter(pairs, lambda p: p["any"]))
    same = F.size(F.filter(pairs, lambda p: p["same"]))
    return F.when(filled > 0, same / filled).otherwise(F.coalesce(F.col(f"{one}_print") == F.col(f"{other}_print"), F.lit(False)).cast("double"))


def fingerprints(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """I-Match fingerprints of every text and of its edited form, with their likeness.

    Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The edited text replaces the last third of the
    code points by the head of the next document (descending ``doc_id``).

    Each subset holds a random share of all terms by hash; its fingerprint is
    the hash of the document's sorted distinct terms that lie in the subset
    and in the frequency band. Four densities serve short and long texts. Terms
    of a large group of copies lie above the band: a text with fewer than
    ``FEW`` terms in it takes the rarest known ones above. The edited text takes
    its own; where the two differ, they are compared on the wider band.

    Null texts count as empty; texts without lexicon terms are alike only when
    their term sets are equal. A null ``doc_id`` comes last. Repeated rows are
    reported as often as they come; rows with one ``doc_id`` follow each other
    by a hash of the text. A single document is its own next one. Other
    columns are ignored; an empty table gives no rows.

    The texts move once, into ranges of ``doc_id``; tokenising, the lookup in
    the broadcast lexicon, grouping and the comparison with the next document
    stay in that partitioning.
    """
    rows = docs.select("doc_id", "text")
    terms = lexicon(rows, rarest, commonest)
    size = terms.count()
    if size > LEXICON_LIMIT:
        raise ValueError(f"{size} terms in the band; raise `rarest`")
    third = F.floor(F.char_length("text") / 3).cast("int")
    texts = with_next(rows).select(
        "bucket", "row", "doc_id", "text", "guest", F.char_length("text").cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)).alias("edited"),
    )
    sets = texts.select(
        "bucket", "row", "doc_id", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        term_hashes(F.col("text")).alias("own_all"), term_hashes(F.col("edited")).alias("new_all"),
    )

    def marked(found: Column, sides: int) -> Column:
        return F.transform(found, lambda h: F.struct(h.alias("term"), F.lit(sides).alias("sides")))

    # Everything but the terms is computed before they are exploded, once a document.
    tagged = sets.select(
        "bucket", "row", "doc_id", "guest", "n_chars", "edited_sha256", plain(F.col("own_all")).alias("own_plain"), plain(F.col("new_all")).alias("edited_plain"),
        held_terms(F.col("own_all")).alias("own"), held_terms(F.col("new_all")).alias("new"),
    )
    both = F.concat(marked(F.array_intersect("own", "new"), 3), marked(F.array_except("own", "new"), 1), marked(F.array_except("new", "own"), 2))
    kept = ("bucket", "row", "doc_id", "guest", "n_chars", "edited_sha256", "own_plain", "edited_plain")
    flat = tagged.select(*kept, F.explode_outer(both).alias("t")).select(*kept, "t.term", "t.sides")
    known = F.broadcast(terms)
    held = flat.join(known, "term", "left").groupBy("bucket", "row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "guest", "n_chars", "edited_sha256", "own_plain", "edited_plain")],
        F.collect_list(F.when(F.col("level").isNotNull(), F.struct("term", "sides", "level"))).alias("terms"),
    ).withColumns({"own_top": band_top(1), "edited_top": band_top(2)})
    own_top, edited_top = F.col("own_top"), F.col("edited_top")
    hashed = held.select("*", subset_hashes(1, own_top).alias("own_hashes"), subset_hashes(2, edited_top).alias("edited_hashes"))
    # Where the two bands differ, the sides are compared on the wider one.
    wide = hashed.select(
        "*", F.when(own_top < edited_top, subset_hashes(1, edited_top)).otherwise(F.col("own_hashes")).alias("own_wide_hashes"),
        F.when(edited_top < own_top, subset_hashes(2, own_top)).otherwise(F.col("edited_hashes")).alias("edited_wide_hashes"),
    ).drop("terms", "own_top", "edited_top")

    shown_rows = wide.select("*", printed("own").alias("own_print"), printed("edited").alias("edited_print")).withColumns({"own_wide_print": F.col("own_print"), "edited_wide_print": F.col("edited_print")})
    order = W.partitionBy("bucket").orderBy("row")
    led = shown_rows.select("*", F.lead("own_hashes").over(order).alias("next_hashes"), F.lead("own_print").over(order).alias("next_print"))
    return led.where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", F.col("own_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness("own_wide", "edited_wide").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
