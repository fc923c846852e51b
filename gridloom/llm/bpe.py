"""Byte-pair encoding and decoding for a word-end BPE vocabulary file.

Encoding merges by rank with a priority queue over a doubly linked list of
symbols; queue entries whose symbols have changed since are skipped.  Decoding
concatenates the vocabulary's strings, with a space between tokens, which is
what the vocabulary's own library does for a file without a decoder.

Defined cases: a null text is the empty text and has no tokens; a very long text
is encoded whole, in memory in proportion to its length, and a long word's queue
takes n log n steps; of pairs with equal ranks the leftmost merges first; null
ids stay null; repeated rows and ids are encoded one by one; an empty table gives
an empty result.  Only the id and text columns are read, so other columns can't
clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import map_rows, text_or_empty

#: White space outside ASCII that the vocabulary's normaliser turns into a space (fixed values of Unicode's White_Space).
WHITE = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Entries of each half of a worker's cache of encoded chunks, and of the chunks that one text had so far; results don't depend on them.
CACHE_ENTRIES, FRESH_ENTRIES = 150_000, 75_000
#: Pre-tokens that are kept.
PIECES = 150_000
#: The usual pattern of pre-tokens, and what it amounts to in lines of lower-case ASCII without other white space.
USUAL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECES = r"[a-z]+|\n|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\na-z0-9]+"
#: Bytes of the texts whose chunks are looked up at once; the last text may be longer.
SLICE_BYTES = 1_000_000
#: Stands between the ids of chunks; no id has a fourth byte of 255, so it is found nowhere else.
MARK = b"\xff" * 4


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary of one file; ``encode_chunk`` works on text without ASCII white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces, self.line_pieces = regex.compile(pattern), regex.compile(pattern + "|\n")
        self.ascii_pieces = re.compile(ASCII_PIECES) if pattern == USUAL_PIECES else self.line_pieces
        self.white = regex.compile(WHITE)
        self.of_byte = byte_symbols()
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        symbols = [self.of_byte[b] for b in piece.encode()]
        symbols[-1] += self.end
        ids = [self.vocab[s] for s in symbols]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if found := ranks.get((ids[i], ids[j])):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return tuple(x for x in ids if x >= 0)

    def split(self, text: str) -> list[str]:
        """The normalised pre-tokens of text without special tokens."""
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[-1:] in ".,!?;:" and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
        else:
            text = self.white.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return self.pieces.findall(text.lower())

    def split_lines(self, lines: str) -> list[str]:
        """The normalised pre-tokens of lines that have no other ASCII white space and no special tokens, with the line feeds between them."""
        if lines.isascii():
            return self.ascii_pieces.findall(lines.lower())
        return self.line_pieces.findall(unicodedata.normalize("NFC", lines).replace("Σ", "σ").lower())

    def encode_plain(self, text: str) -> list[int]:
        """Ids of text without special tokens."""
        out: list[int] = []
        for piece in self.split(text):
            ids = self.words.get(piece)
            if ids is None:
                if len(self.words) >= PIECES:
                    self.words.clear()
                ids = self.words[piece] = self.merge(piece)
            out += ids
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        if not (self.cut and "<|" in chunk):
            return self.encode_plain(chunk)
        out: list[int] = []
        for part in self.cut.split(chunk):
            out += [self.special[part]] if part in self.special else self.encode_plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


@lru_cache(2)
def model(path: str) -> WordBpe:
    """One vocabulary for each worker process."""
    return WordBpe(path)


class Chunks:
    """Values of the chunks between ASCII white space, each computed once while it is cached; ``compute`` gets chunks and gives their values by chunk.

    No pre-token, special token or composition reaches across ASCII white
    space, so the chunks' values in order are the text's.  A chunk that only one
    text has, as most of a corpus's different chunks, stays among the new ones
    and is soon forgotten; one that a second text has goes to the cache.
    """

    def __init__(self, compute):
        self.compute, self.cache, self.older, self.fresh, self.faded = compute, {}, {}, {}, {}

    def of(self, text: str) -> list:
        """The values of a text's chunks, in order."""
        return self.values(text.encode().split())

    def values(self, parts: list[bytes]) -> list:
        cache = self.cache
        out = list(map(cache.get, parts))
        if not all(out):  # a miss, or a chunk without tokens
            places = [i for i, v in enumerate(out) if v is None]
            missing = {parts[i] for i in places}
            again = {}
            for known in (self.older, self.fresh, self.faded):
                found = known.keys() & missing
                again.update(zip(found, map(known.__getitem__, found)))
            new = self.compute(list(missing.difference(again)))
            if len(cache) + len(again) > CACHE_ENTRIES:  # what is still in use comes back from the older half
                self.older, self.cache = cache, {}
            if len(self.fresh) + len(new) > FRESH_ENTRIES:
                self.faded, self.fresh = self.fresh, {}
            self.cache.update(again)
            self.fresh.update(new)
            new.update(again)
            for i in places:
                out[i] = new[parts[i]]
        return out


@lru_cache(2)
def digested_chunks(path: str) -> Chunks:
    bpe = model(path)

    def compute(chunks: list[bytes]) -> dict[bytes, tuple[int, str, str]]:
        ids = [bpe.encode_chunk(c.decode()) for c in chunks]
        return {c: (len(x), " ".join(map(str, x)), bpe.decode(x)) for c, x in zip(chunks, ids)}

    return Chunks(compute)


@lru_cache(2)
def library_chunks(path: str) -> Chunks:
    """Chunks as little-endian 32-bit ids, encoded by the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # The library's model alone, for normalised pre-tokens in byte symbols between spaces: no step tracks offsets or normalises again.
    merger = Tokenizer(tokenizer.model)
    merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    bpe = model(path)
    symbols = {i: s for i, s in enumerate(bpe.of_byte)} | {ord(" "): " "}
    last = np.zeros(max(bpe.strings) + 1, bool)
    last[[i for i, x in bpe.strings.items() if bpe.end and x.endswith(bpe.end) and x not in bpe.special]] = True
    pieces: dict[str, bytes] = {"\n": MARK}

    def merged(new: list[str]) -> list[bytes]:
        # All pre-tokens are encoded at once; the word ends among the ids part them again.
        text = " ".join(new)
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(symbols)
        ids = np.array(merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(last[ids]) + 1) * 4).tolist()
        if len(ends) == len(new):
            data = ids.tobytes()
            return [data[a:b] for a, b in zip([0, *ends], ends)]
        return [np.array(e.ids, "<u4").tobytes() for e in merger.encode_batch_fast(text.split(" "), add_special_tokens=False)]  # a vocabulary without word ends

    def plain(chunks: list[bytes]) -> list[bytes]:
        # Chunks differ by case and marks more than by words: the library encodes each new pre-token once.
        found = bpe.split_lines(b"\n".join(chunks).decode())
        missing = set(found).difference(pieces)
        if len(pieces) + len(missing) > PIECES:
            pieces.clear()
            missing = set(found) - {"\n"}
            pieces["\n"] = MARK
        if missing:
            new = list(missing)
            pieces.update(zip(new, merged(new)))
        return b"".join(map(pieces.__getitem__, found)).split(MARK)

    def whole(chunks: list[bytes]) -> dict[bytes, bytes]:
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False))}

    def compute(chunks: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        if b"<|" in b"\n".join(chunks):
            out = whole([c for c in chunks if b"<|" in c])
            chunks = [c for c in chunks if c not in out]
        ascii_only, others = [c for c in chunks if c.isascii()], [c for c in chunks if not c.isascii()]
        # Whether a code point is a letter is agreed once it is assigned; of later ones the library alone knows what it takes them for.
        if unsure := {x for x in set(b"\n".join(others).decode()) if unicodedata.category(x) == "Cn"}:
            out |= whole([c for c in others if not unsure.isdisjoint(c.decode())])
            others = [c for c in others if c not in out]
        for part in (ascii_only, others):
            if part:
                out.update(zip(part, plain(part)))
        return out

    return Chunks(compute)


def library_ids(text: str, path: str) -> bytes:
    """Ids of a whole text as the tokenizers library gives them, as little-endian 32-bit integers."""
    return library_ids_of(pa.array([text]), path)[0]


def library_ids_of(texts: pa.Array, path: str) -> list[bytes]:
    """``library_ids`` of each of the texts, whose chunks are looked up once for all of them."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    known = library_chunks(path).values(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
    _, ends, data = pa.array(known, pa.large_binary()).take(coded.indices).buffers()
    if data is None:
        return [b""] * len(texts)
    at = np.frombuffer(ends, "<i8")[lists.offsets.to_numpy()].tolist()
    whole = memoryview(data)
    return [whole[a:b].tobytes() for a, b in zip(at, at[1:])]


def library_rows(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """A function from batches of a key and a text to the key and the ``library_ids`` of each row, in order; a null text is empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            # Runs of texts that begin within the same stretch of SLICE_BYTES.
            runs = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE_BYTES, prepend=-1)).tolist()
            for a, b in zip(runs, [*runs[1:], len(sizes)]):
                yield from zip(keys.slice(a, b - a).to_pylist(), library_ids_of(texts.slice(a, b - a), path))

    return rows


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids array<int>`` of every row's text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def fn(key, text):
        bpe = model(vocabulary)
        yield key, [i for c in text.encode().split() for i in bpe.encode_chunk(c.decode())]

    return map_rows(df.select(F.col(id_col), text_or_empty(text_col)), fn, f"`{id_col}` {id_type}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the decoded ``text`` of every row's ids (null ids: the empty text)."""
    id_type = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col), lambda key, ids: [(key, model(vocabulary).decode(ids or []))], f"`{id_col}` {id_type}, text string")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: the id, n_tokens, ids_sha256 and decoded_sha256."""
    id_type = df.schema[id_col].dataType.simpleString()

    def fn(key, text):
        found = [x for x in digested_chunks(vocabulary).of(text) if x[0]]
        ids, decoded = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
        yield key, sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return map_rows(df.select(F.col(id_col), text_or_empty(text_col)), fn, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
