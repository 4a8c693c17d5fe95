"""Near duplicates by bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import body, map_batches, mix64, text_slices, words_of, written
from terrace.operators.dedup import component_labels

#: Values that a sketch retains.
RETAINED = 48
#: Two sets at the similarity bound share so many retained values at least, but for one pair in a billion
#: (the chance of 19 or fewer hits in 48 draws at 0.8 is 1e-9; it falls fast with the similarity).
SHARED = 20
WORDS, SIMILARITY = 5, 80
#: Lists of up to so many entries are paired as they are; longer ones only through the rarest shingles of the whole sets.
SHORT_LIST = 16
#: Union samples from this share of hits on are worth a star; it only saves work, no link depends on it.
STAR_SHARE = 0.6
#: Runs of retained values that make lists of closer classes for the stars.
STAR_RUNS = (1, 3, 6)
#: Rows of the table that tells which texts a verification may need: its size is fixed, a fuller table only lets more texts pass.
FILTER_WORDS = 1 << 16


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a shorter text is one shingle, a text without words has none."""
    hashes, owner = words_of(texts)
    n = len(texts)
    per_text = np.bincount(owner, minlength=n)
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(min(words, len(hashes))):
        # The words of a shingle are weighted by their place; those of short texts by what there is.
        rolled[: len(hashes) - i] += mix64(hashes[i:] + np.uint64(0x632BE59BD9B4E019 * (i + 1) & (1 << 64) - 1))
    out, at = [], 0
    for k in per_text:
        k = int(k)
        if k == 0:
            out.append(np.empty(0, np.uint64))
        elif k < words:
            whole = np.array([k], np.uint64)
            for i in range(at, at + k):
                whole = mix64(whole * np.uint64(31) + hashes[i : i + 1])
            out.append(whole)
        else:
            out.append(np.unique(mix64(rolled[at : at + k - words + 1])))
        at += k
    return out


def sketches(docs: DataFrame, words: int = WORDS, retained: int = RETAINED) -> DataFrame:
    """``doc_id, n, a, b, sketch``: set size, a 128-bit digest of the set, and its smallest values."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch):
                part = batch.slice(start, end - start)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                with np.errstate(over="ignore"):
                    a = [int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                    b = [int(np.bitwise_xor.reduce(mix64(s * np.uint64(0xC2B2AE3D27D4EB4F))).astype(np.int64)) if len(s) else 0 for s in sets]
                kept = [np.sort(s.view(np.int64))[:retained].tolist() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                    ["doc_id", "n", "a", "b", "sketch"],
                )

    return map_batches(docs.select("doc_id", body().alias("text")), sketch, f"doc_id {kind}, n long, a long, b long, sketch array<long>")


def inverted_lists(classes: DataFrame, retained: int, shared: int, similarity: int) -> DataFrame:
    """``value, rep, n, weight, place``: the entries of the inverted lists that can bring two classes together.

    ``weight`` sums the lengths of a class's lists: the text that others were
    edited from keeps what each of them shares with it, and has the largest.

    Classes that are near duplicates share at least ``m`` retained values, so
    they share one among all but the last ``m - 1`` in any common order. The
    order is rarest list first: the commonest values of a class need no entry.
    ``m`` is exact for sets that are retained whole with all their partners.
    """
    entries = classes.select("rep", "n", F.explode("sketch").alias("value"))
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    small = F.floor(F.lit(retained * similarity) / 100)
    need = F.when(F.col("n") <= small, F.ceil(F.col("n") * similarity / 100)).otherwise(F.least(F.lit(shared), F.ceil(F.least("n", F.lit(retained)) * similarity / 100)))
    met = entries.join(lists, "value")
    order = W.partitionBy("rep").orderBy("length", "value")
    ranked = met.select("value", "rep", "n", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(W.partitionBy("rep")).alias("listed"), F.sum("length").over(W.partitionBy("rep")).alias("weight"))
    alone = F.least("n", F.lit(retained)) - F.col("listed")
    # A class whose listed values are too few shares too little with any other.
    return ranked.where((F.col("listed") >= need) & (F.col("rank") <= F.least("n", F.lit(retained)) - need + 1 - alone)).select("value", "rep", "n", "weight", (F.col("rank") + alone).alias("place"))


def long_enough(n: Column, other: Column, similarity: int) -> Column:
    return F.least(n, other) * 100 >= F.greatest(n, other) * similarity


def star_pairs(lists: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Each entry with the class of the largest weight in its list: linear in the lists.

    Besides the lists of single values there are those of runs of neighbouring
    ones, which hold closer classes.
    """
    weights = lists.select("rep", "weight").distinct()
    found = classes.join(weights, "rep")
    pairs = None
    for k in STAR_RUNS:
        runs = F.transform(F.sequence(F.lit(1), F.size("sketch") - k + 1), lambda i: F.xxhash64(F.slice("sketch", i, k)))  # noqa: B023
        entries = lists if k == 1 else found.where(F.size("sketch") >= k).select("rep", "n", "weight", F.explode(runs).alias("value"))
        hubs = entries.groupBy("value").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("hub"), F.count(F.lit(1)).alias("length")).where("length > 1")
        met = entries.join(hubs, "value").where((F.col("rep") != F.col("hub.rep")) & long_enough(F.col("n"), F.col("hub.n"), similarity))
        some = met.select(F.least("hub.rep", "rep").alias("u"), F.greatest("hub.rep", "rep").alias("v"))
        pairs = some if pairs is None else pairs.unionByName(some)
    return pairs.distinct()


def placed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists that several components share: ``value, rep, n, place, c, main, length``."""
    placed = lists.join(labels, F.col("rep") == F.col("node"), "left").select("value", "rep", "n", "place", F.coalesce("component", "rep").alias("c"))
    parts = placed.groupBy("value", "c").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("value").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("length"), F.count(F.lit(1)).alias("parts"))
    return placed.join(main.where("parts > 1").drop("parts"), "value")


def crossing_pairs(marked: DataFrame, similarity: int, whole: bool = False) -> DataFrame:
    """All pairs of a list whose classes are not yet connected and may be near duplicates.

    Lists inside one component are dropped whole. In the others, the entries
    outside the list's largest component meet all entries: a group of near
    copies that is joined already is never paired within itself.

    With ``whole``, ``place`` is the rank of the entry's value in the rarest-first
    order of the whole set. Two sets of known sizes need ``o`` values in common,
    so their first common value has a place of ``n - o + 1`` at most in both.
    """
    outside = marked.where("c <> main").select("value", F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("c").alias("x_c"), F.col("place").alias("x_place"))
    ends = marked.select("value", F.col("rep").alias("y"), F.col("n").alias("y_n"), F.col("c").alias("y_c"), F.col("place").alias("y_place"), (F.col("c") == F.col("main")).alias("y_main"))
    # Of two entries outside, the smaller comes first; one inside comes as the partner.
    fit = (F.col("x_c") != F.col("y_c")) & (F.col("y_main") | (F.col("x") < F.col("y"))) & long_enough(F.col("x_n"), F.col("y_n"), similarity)
    if whole:
        overlap = F.ceil((F.col("x_n") + F.col("y_n")) * similarity / (100 + similarity) - 1e-9)
        fit = fit & (F.col("x_place") <= F.col("x_n") - overlap + 1) & (F.col("y_place") <= F.col("y_n") - overlap + 1)
    joined = outside.alias("x").join(ends.alias("y"), (F.col("x.value") == F.col("y.value")) & fit)
    return joined.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def whole_set_lists(marked: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Inverted lists over whole sets of the classes in long lists, rarest shingles first.

    Many texts may share a passage, and with it most retained values, without
    being near duplicates. Their own shingles tell: a class with more than a
    fifth of them has no partner, and the others meet in the lists of their
    rarest common shingles only. This is exact.
    """
    needed = written(marked.where(F.col("length") > SHORT_LIST).select("rep").distinct(), "needed")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch):
                part = batch.slice(start, end - start)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["rep", "n", "sketch"]
                )

    sets = written(map_batches(texts_of(needed, docs), explode, "rep long, n long, sketch array<long>"), "sets")
    return inverted_lists(sets, 1 << 40, 1 << 40, similarity)


def estimated(pairs: DataFrame, classes: DataFrame, retained: int, shared: int, similarity: int) -> DataFrame:
    """Pairs whose union sketch leaves the similarity bound possible.

    The smallest values of two sketches together are a sample of the union;
    those in both are hits. Where both sets are retained whole the test is exact.
    """
    sides = classes.select("rep", "n", "sketch")
    first = pairs.join(sides.select(F.col("rep").alias("u"), F.col("n").alias("u_n"), F.col("sketch").alias("u_s")), "u")
    both = first.join(sides.select(F.col("rep").alias("v"), F.col("n").alias("v_n"), F.col("sketch").alias("v_s")), "v")
    union = F.slice(F.array_sort(F.array_union("u_s", "v_s")), 1, retained)
    whole = F.greatest("u_n", "v_n") <= retained
    common = F.size(F.array_intersect("u_s", "v_s"))
    sample = F.size(F.array_intersect(union, F.array_intersect("u_s", "v_s")))
    possible = F.when(whole, common * 100 >= F.size(F.array_union("u_s", "v_s")) * similarity).otherwise(sample >= shared)
    return both.where(possible).select("u", "v")


def texts_of(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """``rep, text`` of the ids in ``needed``; the first of the texts of a repeated id.

    A table of fixed size, addressed by a hash of the id, keeps most other
    texts from moving; an exact join decides on the rest.
    """
    address = F.pmod(F.xxhash64(F.col("rep")), F.lit(FILTER_WORDS * 63))
    bits = needed.select((address / 63).cast("int").alias("cell"), (address % 63).cast("int").alias("bit"))
    table = bits.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), body().alias("text"))
    tagged = texts.select("*", (address / 63).cast("int").alias("cell"), (address % 63).cast("int").alias("bit"))
    passed = tagged.join(F.broadcast(table), "cell").where(F.expr("bits & shiftleft(1L, bit)") != 0).select("rep", "text")
    return passed.join(needed, "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    needed = written(pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct(), "needed")
    found = written(texts_of(needed, docs), "texts")
    one = pairs.join(found.select(F.col("rep").alias("v"), F.col("text").alias("v_text")), "v")
    both = one.join(found.select(F.col("rep").alias("u"), F.col("text").alias("u_text")), "u").select("u", "v", "u_text", "v_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch, "v_text"):
                part = batch.slice(start, end - start)
                us, vs = part.column("u_text").to_pylist(), part.column("v_text").to_pylist()
                # Each text of the slice is cut into shingles once.
                texts = list(dict.fromkeys(us + vs))
                sets = dict(zip(texts, shingle_sets(texts, words), strict=True))
                keep = []
                for u, v in zip(us, vs, strict=True):
                    one, other = sets[u], sets[v]
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    keep.append(100 * common >= similarity * (len(one) + len(other) - common))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, verify, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, retained: int = RETAINED, shared: int = SHARED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked where ``100 * intersection >= similarity * union`` of
    their word shingle sets; ``component_id`` is the smallest id reachable.
    Null and empty texts, and texts of white space, have no shingles and stay
    alone. A null ``doc_id`` takes part in no link and keeps itself. Rows with
    one ``doc_id`` are one document: the first of their texts by order counts
    in verification. Other columns are ignored; an empty table gives none.

    Equal sets form classes, which only their smallest id stands for. Stars
    from the most central class of each inverted list join the large groups;
    then all pairs of short lists that are not yet connected are compared, and
    those of long lists through the rarest shingles of the whole sets. Sketches
    filter all and full sets decide. No partner or candidate is left out.
    """
    base = written(sketches(docs, words, retained), "sketches")
    real = base.where("n > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "a", "b", "sketch")
    classes = written(real.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    lists = written(inverted_lists(classes, retained, shared, similarity), "lists")
    close = estimated(star_pairs(lists, classes, similarity), classes, retained, max(shared, int(STAR_SHARE * retained)), similarity)
    stars = written(verified(written(close, "pairs"), docs, words, similarity), "links")
    labels = component_labels(stars)
    marked = written(placed_lists(lists, labels), "lists")
    whole = written(whole_set_lists(marked, docs, words, similarity), "lists")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = written(estimated(pairs, classes, retained, shared, similarity), "pairs")
        return written(verified(left, docs, words, similarity), "links")

    # Copies that share a rare change meet in short lists; what is left of a large group after them is little.
    now = placed_lists(whole, labels)
    short = crossing_pairs(marked.where(F.col("length") <= SHORT_LIST), similarity).unionByName(crossing_pairs(now.where(F.col("length") <= SHORT_LIST), similarity, whole=True))
    links = written(stars.unionByName(confirmed(short.distinct())), "links")
    labels = component_labels(links)
    links = links.unionByName(confirmed(crossing_pairs(placed_lists(whole, labels), similarity, whole=True)))
    # Ids that stand for two classes (a repeated id with two texts) link them, too.
    joined = component_labels(links)
    final = classes.join(joined, F.col("rep") == F.col("node"), "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    # A text without shingles matches no class, and the smallest id of a class needs none.
    out = base.join(final, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).select(
        "*", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents without those that :func:`near_duplicates` doesn't keep, with all their columns."""
    gone = near_duplicates(docs, words, similarity).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
