"""Token counts without token ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import body, map_batches, written

#: Pre-tokens in at least this share of the documents are counted on the map side. There are at most (distinct pre-tokens in a document, on average) / HOT_SHARE.
HOT_SHARE = 0.0002
#: More of them than this are not broadcast.
HOT_LIMIT = 4_000_000
#: Distinct pre-tokens that a map task gathers before it hands them on.
GATHERED = 200_000
TOKEN_LIMIT = 4096

#: Blanks and what follows them up to the next blank. No piece of the model has a blank after another character, so no merge crosses these borders.
PRE_TOKEN = re.compile(" *[^ ]+| +")


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pre_tokens(text: str) -> list[str]:
    """The model puts one blank before a text that is not empty, and its own mark U+2581 is a blank like any other."""
    return PRE_TOKEN.findall(" " + text.replace("\u2581", " ")) if text else []


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``word, df`` of all pre-tokens; a task sums its own documents first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "df"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(set(pre_tokens(text.as_py())))
                if len(seen) > GATHERED:
                    yield flush()
        if seen:
            yield flush()

    return map_batches(texts.select("text"), gather, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def count_pieces(words: DataFrame, model_path: str) -> DataFrame:
    """``word, df, pieces``: each distinct pre-token is tokenised once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            # The model adds the leading blank again; a blank alone is one piece.
            ids = model.encode([w[1:] for w in batch.column("word").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("df"), pa.array([max(1, len(x)) for x in ids], pa.int64())], ["word", "df", "pieces"])

    return map_batches(words, count, "word string, df long, pieces long")


def token_counts(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT, hot_share: float = HOT_SHARE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` under a sentencepiece model, one row per input row.

    A text is a sequence of pre-tokens that no merge crosses, so its count is
    the sum of theirs. Pieces are counted once per distinct pre-token of the
    whole table. The pre-tokens of many documents, a set of proven size, are
    broadcast and summed where the text is read; the frequencies of the others
    are joined to their counts by one shuffle and summed per row.

    Null texts count as empty and have no tokens. ``doc_id`` may be null or
    repeated: rows are told apart by their place in the input. Other columns
    are ignored; an empty table gives none.
    """
    texts = docs.select("doc_id", body().alias("text"))
    total = texts.count()
    pieces = written(count_pieces(document_frequencies(texts), model_path), "pieces")
    least = max(2.0, hot_share * total)
    hot_rows = pieces.where(F.col("df") >= least)
    if hot_rows.count() > HOT_LIMIT:
        raise ValueError("too many frequent pre-tokens; raise `hot_share`")
    table = hot_rows.select("word", "pieces").toArrow()
    hot = docs.sparkSession.sparkContext.broadcast(dict(zip(table.column("word").to_pylist(), table.column("pieces").to_pylist(), strict=True)))
    fields = [("uid", pa.int64()), ("doc_id", docs.schema["doc_id"].dataType), ("n_bytes", pa.int64()), ("word", pa.string()), ("freq", pa.int64())]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value.get
        for batch in batches:
            uids, words, freqs = [], [], []
            own, own_bytes, own_sum = batch.column("uid").to_pylist(), [], []
            for uid, value in zip(own, batch.column("text"), strict=True):
                text = value.as_py()
                sure = 0
                for word, n in Counter(pre_tokens(text)).items():
                    k = known(word)
                    if k is None:
                        uids.append(uid)
                        words.append(word)
                        freqs.append(n)
                    else:
                        sure += k * n
                own_bytes.append(value.as_buffer().size)
                own_sum.append(sure)
            # One row for the document, under a key that no pre-token has (they start with a blank), then its rare pre-tokens.
            n = len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array(own + uids, pa.int64()),
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(n, batch.column("doc_id").type)]),
                pa.array(own_bytes + [None] * n, pa.int64()),
                pa.array([f"#{u}" for u in own] + words, pa.string()),
                pa.array(own_sum + freqs, pa.int64()),
            ], [f for f, _ in fields])

    schema = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, word string, freq long"
    rows = map_batches(texts.withColumn("uid", F.monotonically_increasing_id()), split, schema)
    rare = pieces.where(F.col("df") < least).select("word", "pieces")
    summed = rows.join(rare, "word", "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("freq") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
