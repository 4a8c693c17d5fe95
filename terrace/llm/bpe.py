"""BPE encoding by a streaming transducer with bounded lookahead, and incremental decoding."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrace.llm.common import body, map_batches

END = "</w>"
#: Entries of each of the two generations of a worker's word cache.
CACHED_WORDS = 120_000
#: Words of up to so many symbols are merged at once.
SHORT = 64
NO_RULE = 1 << 62

_SPACE = "\t-\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = regex.compile(f"[{_SPACE}]+")
#: Fixed value: the pre-token pattern of the vocabulary file.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACE + r"\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where Latin-1 shows it, else the next letter from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def normalized(text: str) -> str:
    # Letters are lowered one by one, so a final sigma stays the plain one.
    return SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


class Merges:
    """A merge list over word-final symbols, read from a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.specials).items()}
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        self.size = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        #: ``left << 20 | right`` to ``rank << 20 | product``.
        self.rules: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rules[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.lookahead = self.sufficient_lookahead()
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        back = {c: b for b, c in enumerate(letters)}
        #: Bytes of each token's text: word ends become blanks.
        self.text_bytes = {i: bytes(back[c] for c in t.removesuffix(END)) + (b" " if t.endswith(END) else b"") for t, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}

    def sufficient_lookahead(self) -> int:
        """How many symbols before its end an unfinished word may still be cut otherwise.

        A merge turns out differently only if it touches the end, or if an
        earlier merge (a smaller rank) beside it did: that one took or left its
        right part, or made it. One pass over the rules by rank carries the
        farthest reach of such a chain to each token at its left edge.
        """
        left: dict[int, int] = {}
        anywhere: dict[int, int] = {}
        reach = 1
        for key, rule in sorted(self.rules.items(), key=lambda r: r[1]):
            a, b, product = key >> 20, key & 0xFFFFF, rule & 0xFFFFF
            far = max(self.size[a] + self.size[b], left.get(b, 0) + self.size[a], anywhere.get(a, 0))
            for t in (a, product):
                left[t] = max(left.get(t, 0), far)
            for t in (a, b, product):
                anywhere[t] = max(anywhere.get(t, 0), far)
            reach = max(reach, far)
        return reach

    def merge(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost of equals."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        get = self.rules.get
        found = [get(a << 20 | b, NO_RULE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while found and (best := min(found)) != NO_RULE:
            at = found.index(best)
            symbols[at : at + 2] = [best & 0xFFFFF]
            del found[at]
            if at:
                found[at - 1] = get(symbols[at - 1] << 20 | symbols[at], NO_RULE)
            if at < len(found):
                found[at] = get(symbols[at] << 20 | symbols[at + 1], NO_RULE)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, get = len(symbols), self.rules.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found >> 20, i, symbols[i], symbols[i + 1], found & 0xFFFFF) for i in range(n - 1) if (found := get(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, product = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = product, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (found := get(symbols[left] << 20 | symbols[right])):
                    heapq.heappush(heap, (found >> 20, left, symbols[left], symbols[right], found & 0xFFFFF))
        return [s for s in symbols if s >= 0]

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Token ids of one word that comes in chunks.

        What lies more than the lookahead before the end of the unfinished word
        is settled and leaves at once; any run of settled tokens is the
        encoding of its own symbols, so merging starts again behind it. The
        buffer holds the lookahead and one chunk.
        """
        held: list[int] = []
        final = None
        for chunk in chunks:
            for byte in chunk.encode():
                if final is not None:
                    held.append(self.first[final])
                final = byte
            if len(held) > 2 * self.lookahead:
                sizes, settled = self.size, len(held) - self.lookahead
                tokens, at, n = self.merge(list(held)), 0, 0
                for t in tokens:
                    if at + sizes[t] > settled:
                        break
                    at, n = at + sizes[t], n + 1
                yield from tokens[:n]
                held = held[at:]
        if final is not None:
            yield from self.merge([*held, self.last[final]])

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        if len(raw) <= 2 * self.lookahead:
            return self.merge([self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]])
        step = self.lookahead
        return list(self.stream(word[i : i + step] for i in range(0, len(word), step)))

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special tokens as ``(id, [])`` and the pre-tokens between them as ``(None, words)``."""
        for i, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if i % 2:
                yield self.specials[part], []
            elif part:
                yield None, PRE_TOKEN.findall(normalized(part))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, words in self.parts(text or ""):
            if special is not None:
                out.append(special)
            for word in words:
                out.extend(self.word(word))
        return out


class Decoder:
    """Ids to text, step by step: bytes of a token enter, whole characters leave.

    ``plain`` restores text (word ends become blanks); otherwise the tokens
    themselves are shown, parted by blanks, as the tokenizer file's own decode
    does, which names no decoder.
    """

    def __init__(self, merges: Merges, plain: bool = False):
        self.table = merges.text_bytes if plain else merges.token_bytes
        self.separator = b"" if plain else b" "
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            out.append(self.state.decode((self.separator if self.started else b"") + self.table[i]))
            self.started = True
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


class WordCache(dict):
    """Word to (ids as bytes, decoded bytes); two generations, each of a bounded size."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.old, self.decoder = merges, {}, Decoder(merges)

    def entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        # A word ends with a whole character, so the decoder stands at its start again.
        self.decoder.started = False
        shown = self.decoder.feed(ids) + self.decoder.finish()
        return struct.pack(f"<{len(ids)}I", *ids), shown.encode()

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        if len(word) > SHORT:
            return self.entry(self.merges.word(word))
        found = self.old.pop(word, None) or self.entry(self.merges.word(word))
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(Merges(path))


def encoded(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``ids`` the array ``ids``; one row per input row.

    Each text is encoded and decoded where it is read; nothing is shuffled.
    Null texts count as empty: no tokens, digests of nothing. Very long words
    are streamed with a constant buffer. A null ``doc_id`` and repeated rows
    stay as they are; other columns are ignored; an empty table gives none.
    """
    out_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            counts, id_digests, text_digests, lists = [], [], [], []
            for value in batch.column("text"):
                pairs: list[tuple[bytes, bytes]] = []
                for special, words in cache.merges.parts(value.as_py()):
                    if special is not None:
                        pairs.append(cache.entry([special]))
                    pairs += [cache[w] for w in words]
                packed = b"".join([p[0] for p in pairs])
                counts.append(len(packed) // 4)
                id_digests.append(hashlib.sha256(packed).hexdigest())
                text_digests.append(hashlib.sha256(b" ".join([p[1] for p in pairs])).hexdigest())
                if ids:
                    lists.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {out_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return map_batches(docs.select("doc_id", body().alias("text")), encode, schema)


def decoded(rows: DataFrame, path: str, plain: bool = True) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = word_cache(path).merges
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                decoder = Decoder(merges, plain)
                texts.append(None if ids is None else decoder.feed(ids) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", "ids"), decode, f"doc_id {kind}, text string")
