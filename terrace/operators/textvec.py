"""TF-IDF and truncated SVD of text with a training-only vocabulary.

Weights live in a long table (row, term, weight) built by joins and
aggregates; sparse ML vectors are made from it only where MLlib needs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terrace.functions.parse import normalize_text
from terrace.session import durable

# Vectorizer settings.
WORD_SETTINGS = {"ngrams": (1, 2), "min_df": 5, "max_df": 0.95, "terms": 5000}
CHAR_SETTINGS = {"ngrams": (3, 5), "min_df": 5, "max_df": 1.0, "terms": 3000}
# Block width beyond the wanted components, most columns of the search space, error bound of the eigenpairs, most passes, and entries that a task multiplies at once.
EXTRA, SPACE, TOLERANCE, PASSES, ENTRIES = 10, 400, 1e-10, 300, 1 << 17


def plain(c: Column) -> Column:
    """Lower-cased text without accents: decomposed letters lose their marks.

    Covers the Latin accented letters one to one.
    """
    # Accented letters and their base letters.
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    base = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(normalize_text(c), accented, base)


def _runs(words: Column, n: int) -> Column:
    """Runs of n words. Shifted copies are zipped, so the word list is built
    n times per row and never once per position."""
    joined = words
    for shift in range(1, n):
        later = F.slice(words, F.lit(1 + shift), F.greatest(F.size(words), F.lit(1)))
        joined = F.zip_with(joined, later, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(joined, lambda x: x.isNotNull())


def _cuts(word: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substr(word, i, F.lit(n)))


def word_list(c: Column) -> Column:
    """Words of two or more characters."""
    return F.regexp_extract_all(plain(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_grams(words: Column, ngrams: tuple[int, int] = (1, 2)) -> Column:
    """Words and runs of them joined by a space."""
    return F.concat(*[words if n == 1 else _runs(words, n) for n in range(ngrams[0], ngrams[1] + 1)])


def padded_words(c: Column) -> Column:
    return F.transform(F.filter(F.split(plain(c), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def char_grams(words: Column, ngrams: tuple[int, int] = (3, 5)) -> Column:
    """Character n-grams inside words, each word padded with one space.

    A padded word shorter than n yields itself, once.
    """

    def of(word: Column) -> Column:
        pieces = []
        for n in range(ngrams[0], ngrams[1] + 1):
            shorter = F.length(word) < n if n > ngrams[0] else F.lit(False)
            pieces.append(F.when(shorter, F.array().cast("array<string>")).otherwise(_cuts(word, n)))
        return F.concat(*pieces)

    return F.flatten(F.transform(words, of))


def term_stats(df: DataFrame, text: str, analyzer: str = "word", min_df: int | None = None, terms: int | None = None) -> DataFrame:
    """Vocabulary: term, document frequency, total count, smoothed idf, index.

    ``idf = ln((1 + N) / (1 + df)) + 1``. Terms outside the document-frequency
    limits go first; of the rest the most frequent ones stay.
    """
    settings = WORD_SETTINGS if analyzer == "word" else CHAR_SETTINGS
    lowest = settings["min_df"] if min_df is None else min_df
    total = df.agg(F.count(F.lit(1)).alias("_docs"))
    found = char_counts(df, text) if analyzer == "char" else token_counts(df, text, analyzer)
    joined = found.join(F.broadcast(total), F.lit(True))
    kept = joined.where((F.col("df") >= lowest) & (F.col("df") <= settings["max_df"] * F.col("_docs")))
    # At most `terms` rows reach the numbering window.
    top = kept.orderBy(F.desc("total_count"), "term").limit(terms or settings["terms"])
    index = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("term")) - 1
    return top.select(
        "term", "df", "total_count", (F.log((1.0 + F.col("_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), index.alias("term_index")
    )


def token_counts(df: DataFrame, text: str, analyzer: str) -> DataFrame:
    """``term, df, total_count`` of all terms."""
    # A row's sorted tokens tell the first of each term, so only per-task counts of terms are shuffled.
    ordered = with_tokens(df.select(text), analyzer, text).select(F.sort_array("_tokens").alias("_t"))
    first = F.transform("_t", lambda t, i: F.struct(t.alias("term"), F.coalesce(F.get("_t", i - 1) != t, F.lit(True)).alias("first")))
    # An outer generator: Spark infers a filter in front of others, which would cut each text once more.
    marked = ordered.select(F.inline_outer(first)).where("term IS NOT NULL")
    return marked.groupBy("term").agg(F.sum(F.col("first").cast("long")).alias("df"), F.count(F.lit(1)).alias("total_count"))


def char_counts(df: DataFrame, text: str) -> DataFrame:
    """:func:`token_counts` of character n-grams, which depend on words alone.

    Total counts come from the words of the whole table, each cut once; the
    texts of a term from the distinct words of each text.
    """
    def listed(rows: DataFrame, entries: Column, name: str) -> DataFrame:
        # Outer generators: see token_counts.
        return rows.select("*", F.explode_outer(entries).alias(name)).where(F.col(name).isNotNull())

    ngrams = CHAR_SETTINGS["ngrams"]
    words = df.select(padded_words(F.col(text)).alias("_words"))
    counted = listed(words, F.col("_words"), "_word").groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    totals = listed(counted, char_grams(F.array("_word"), ngrams), "term").groupBy("term").agg(F.sum("_n").alias("total_count"))
    own = words.select(F.array_distinct("_words").alias("_words"))
    texts = listed(own, F.array_distinct(char_grams(F.col("_words"), ngrams)), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return texts.join(totals, "term").select("term", "df", "total_count")


def tfidf_rows(df: DataFrame, row_id: str, text: str, vocabulary: DataFrame, analyzer: str = "word") -> DataFrame:
    """Long sparse form: unit-length ``(1 + ln tf) * idf`` weights per row and term.

    The vocabulary is bounded by its term limit, so it is broadcast; terms
    outside it vanish before the weights are grouped by row. Texts move once,
    to the task of their row; counts and norms then need no further shuffle.
    """
    placed = df.select(row_id, text).repartition(F.col(row_id))
    exploded = with_tokens(placed, analyzer, text).select(row_id, F.explode_outer("_tokens").alias("term"))
    counts = exploded.join(F.broadcast(vocabulary.select("term", "idf", "term_index")), "term").groupBy(
        row_id, "term", "term_index", "idf"
    ).agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.withColumn("_w", (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(row_id)))
    return weighted.select(row_id, "term", "term_index", "tf", (F.col("_w") / norm).alias("weight"))


def with_tokens(df: DataFrame, analyzer: str, text: str) -> DataFrame:
    """Adds ``_tokens``. The words are a column of their own, so that each text is cut once, however often its words are used."""
    if analyzer not in ("word", "char"):
        raise ValueError(f"unknown analyzer: {analyzer}")
    cut, grams, settings = (word_list, word_grams, WORD_SETTINGS) if analyzer == "word" else (padded_words, char_grams, CHAR_SETTINGS)
    return df.withColumn("_words", cut(F.col(text))).withColumn("_tokens", grams(F.col("_words"), settings["ngrams"])).drop("_words")


def sparse_vectors(weights: DataFrame, row_id: str, size: int, output: str = "tfidf") -> DataFrame:
    """One ML sparse vector per row; a row holds at most ``size`` terms."""
    entries = weights.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("term_index", "weight"))).alias("_e"))
    fields = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"),
        F.transform("_e", lambda e: e["term_index"]).alias("indices"), F.transform("_e", lambda e: e["weight"]).alias("values"),
    )
    holder = StructType([StructField("v", VectorUDT())])
    return entries.select(row_id, F.from_json(F.to_json(F.struct(fields.alias("v"))), holder)["v"].alias(output))


def sparse_rows(weights: DataFrame, row_id: str) -> DataFrame:
    """``indices`` and ``values`` of each row, as arrays."""
    entries = weights.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("term_index", "weight"))).alias("_e"))
    return entries.select(row_id, F.col("_e.term_index").alias("indices"), F.col("_e.weight").alias("values"))


def gram_product(rows: DataFrame, size: int, block: np.ndarray) -> np.ndarray:
    """``X'X block`` of sparse rows ``X``: one pass, in which a task emits one line a term."""
    width = block.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(block)
    names = [f"c{i}" for i in range(width)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, total = shared.value, np.zeros((width, size))
        for batch in batches:
            index, value = (batch.column(n).flatten().to_numpy() for n in ("indices", "values"))
            lengths = np.diff(batch.column("indices").offsets.to_numpy())
            ends = np.cumsum(lengths)
            first = 0
            while first < len(ends):
                begin = ends[first] - lengths[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + ENTRIES, side="right")))
                i, v, per_row = index[begin : ends[last - 1]], value[begin : ends[last - 1]], lengths[first:last]
                sums = np.add.reduceat(v[:, None] * right[i], (ends[first:last] - per_row - begin), axis=0)
                spread = np.repeat(sums, per_row, axis=0) * v[:, None]
                for c in range(width):
                    total[c] += np.bincount(i, weights=spread[:, c], minlength=size)
                first = last
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *[pa.array(c) for c in total]], ["term_index", *names])

    parts = rows.select("indices", "values").mapInArrow(multiply, "term_index int, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("term_index").agg(*[F.sum(n).alias(n) for n in names]).collect()
    shared.destroy()
    out = np.zeros((size, width))
    for line in found:
        out[line[0]] = line[1:]
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what ``block`` adds to ``basis``; columns that add nothing vanish."""
    norms = np.linalg.norm(block, axis=0)
    left = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        left = left - basis @ (basis.T @ left)
    u, s, _ = np.linalg.svd(left, full_matrices=False)
    kept = u[:, s > 1e-12]
    kept = kept - basis @ (basis.T @ kept)
    return np.linalg.qr(kept)[0]


def truncated_svd(rows: DataFrame, size: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of sparse rows (``indices``, ``values``).

    Block Lanczos on ``X'X`` with full reorthogonalisation: a pass multiplies a
    whole block of vectors, so few passes are needed, and their number doesn't
    depend on the rows. Only term-by-block matrices reach the driver.
    """
    width = min(size, components + EXTRA)
    block = np.linalg.qr(np.random.default_rng(42).standard_normal((size, width)))[0]
    basis, products = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(PASSES):
        product = gram_product(rows, size, block)
        basis, products = np.hstack([basis, block]), np.hstack([products, product])
        small = basis.T @ products
        values, turns = np.linalg.eigh((small + small.T) / 2.0)
        turns = turns[:, ::-1]
        found, image = basis @ turns, products @ turns
        values = values[::-1]
        gaps = np.linalg.norm(image[:, :components] - found[:, :components] * values[:components], axis=0)
        if gaps.max() <= TOLERANCE * max(values[0], 0.0):
            break
        if basis.shape[1] + width > SPACE and basis.shape[1] > 3 * width:
            # Start again from the best part of the space; its products are known.
            held = 2 * width
            basis, products = found[:, :held], image[:, :held]
        block = _orthonormal(product, basis)
        if block.shape[1] == 0:
            break
    else:
        raise ValueError("the components did not converge")
    return found[:, :components], np.sqrt(np.maximum(values[:components], 0.0))


def project(weights: DataFrame, row_id: str, basis) -> DataFrame:
    """Component scores per row: the sum of weight times basis row, in long-form joins."""
    spark = weights.sparkSession
    rows = [(i, [float(x) for x in line]) for i, line in enumerate(basis)]
    table = spark.createDataFrame(rows, "term_index int, _basis array<double>")
    joined = weights.join(F.broadcast(table), "term_index")
    width = len(rows[0][1])
    sums = [F.sum(F.col("weight") * F.get("_basis", F.lit(i))).alias(f"svd_{i + 1:02d}") for i in range(width)]
    return joined.groupBy(row_id).agg(*sums)


def text_svd(train: DataFrame, rows: DataFrame, row_id: str, text: str, components: int, analyzer: str = "word", min_df: int | None = None, terms: int | None = None):
    """Component scores of ``rows`` from a vocabulary and basis fitted on ``train``.

    Returns (scores, explained variance per component). Rows without a known
    term score 0 everywhere.
    """
    vocabulary = term_stats(train, text, analyzer, min_df, terms)
    vocabulary = vocabulary.sparkSession.createDataFrame(vocabulary.collect(), vocabulary.schema)
    size = vocabulary.count()
    if components >= size:
        raise ValueError("fewer components than terms are needed")
    # Every step of the decomposition reads the rows again, so they are written once.
    vectors = durable(sparse_rows(tfidf_rows(train, row_id, text, vocabulary, analyzer), row_id), "tfidf-rows")
    basis, _ = truncated_svd(vectors, size, components)
    weights = vectors.select(row_id, F.inline(F.arrays_zip(F.col("indices").alias("term_index"), F.col("values").alias("weight"))))
    names = [f"svd_{i + 1:02d}" for i in range(components)]
    fitted = _zero_filled(train, project(weights, row_id, basis), row_id, names)
    scored = fitted if rows is train else _zero_filled(rows, project(tfidf_rows(rows, row_id, text, vocabulary, analyzer), row_id, basis), row_id, names)
    # A row counts as often as its id comes in the table.
    copies = train.groupBy(row_id).agg(F.count(F.lit(1)).alias("_k"))
    repeated = copies.where("_k > 1").withColumn("_k", F.col("_k") - 1).join(vectors, row_id)
    counted = vectors.where(F.col(row_id).isNotNull()).withColumn("_k", F.lit(1)).unionByName(repeated)
    entries = counted.select("_k", F.inline(F.arrays_zip(F.col("indices").alias("term_index"), F.col("values").alias("_w"))))
    spread = entries.groupBy("term_index").agg(F.sum(F.col("_k") * F.col("_w")).alias("_s"), F.sum(F.col("_k") * F.col("_w") * F.col("_w")).alias("_q"))
    docs = train.agg(F.count(F.lit(1)).alias("_n"))
    overall = spread.crossJoin(F.broadcast(docs)).agg(
        F.sum(F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), F.lit(2.0))).alias("_total")
    )
    parts = fitted.agg(*[F.var_pop(n).alias(n) for n in names]).unpivot([], names, "component", "variance")
    ratio = parts.crossJoin(F.broadcast(overall)).select("component", (F.col("variance") / F.col("_total")).alias("explained_ratio"))
    return scored, ratio


def _zero_filled(rows: DataFrame, scores: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    joined = rows.select(row_id).join(scores, row_id, "left")
    return joined.fillna(0.0, subset=names) if names else joined


def select_components(candidates: dict[int, DataFrame], order: str = "rmse") -> DataFrame:
    """Smallest inner error over candidate sizes; the smaller size wins a tie."""
    result = None
    for size, report in candidates.items():
        one = report.withColumn("components", F.lit(size))
        result = one if result is None else result.unionByName(one)
    return result.orderBy(order, "components")

