"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last eight bytes says so, so equal passages give
equal chunks wherever they stand. Chunks that occur in more than one text are encoded once, by the text
that sorts first, and handed to the others: from their first to their last white space, for chunk borders
fall anywhere, also inside words. What stands between the bodies handed on, the cut words at both ends
included, is a window that is encoded anew. At each join the words on both sides are then encoded together;
where their tokens aren't those of the window and of the body, the window grows to the whole text. A
worker keeps the tokens of words that it has met: the tokenizer drops white space and never joins tokens
over it (`check_tokenizer`).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veridoc.llm.common import scratch, small_batches, whole

TOKENIZER = "word_bpe_49k.json"
#: Chunk sizes in bytes: no cut before LEAST, one of 2 ** AVERAGE_BITS places after it is a cut, always one at MOST.
LEAST, AVERAGE_BITS, MOST = 128, 9, 4096
#: Bytes of words and their tokens that one worker keeps, about: as many new ones, and those of the generation before. What an entry takes besides.
KEPT_BYTES, ENTRY = 32 << 20, 200
GEAR = np.uint64(0x9E3779B97F4A7C15)
#: White space of ASCII, and a full stop or comma that ends a word.
GAP, LAST_GAP, STOP = re.compile(rb"[ \t\n\r\x0b\x0c]"), re.compile(rb".*[ \t\n\r\x0b\x0c]", re.DOTALL), re.compile(rb"(?<=[a-z0-9])([.,])(?![^ \t\n\r\x0b\x0c])")

#: Capitals that no other character than one of ASCII follows.
CAPITALS = re.compile(rb"[A-Z]+(?![\x80-\xff])")


@cache
def load(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def check_tokenizer(name: str) -> None:
    """Raises unless white space is dropped and parts tokens, which is what encoding word by word needs."""
    t = load(name)

    def ids(x: str) -> list[int]:
        return t.encode(x, add_special_tokens=False).ids

    for a, b in (("ab", "cd"), ("don't", "'s"), ("é", "́e"), ("x9", "..."), ("<|startoftext|>", "a")):
        for gap in (" ", "\n", "\t\r ", "  \x0b\x0c"):
            if ids(a + gap + b) != ids(a) + ids(b):
                raise ValueError(f"{name} joins tokens over white space; it can't be encoded by words")
    if any(ids(w) != [i for x in simple_words(w.encode()) for i in ids(x.decode())] for w in ("Ab.", "x's,", "9,", "DON'T", "É.", "aB́,")):
        raise ValueError(f"{name} tells cases or full stops apart as this module doesn't expect")


def cuts(text: bytes) -> list[int]:
    """Where the chunks of a text end. A cut depends on the eight bytes before it and the last cut only; it never parts a character."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    grams = np.empty(n - 7, np.uint64)
    for k in range(8):
        part = np.frombuffer(text, "<u8", (n - k) // 8, k)
        grams[k::8] = part[: len(grams[k::8])]
    grams *= GEAR
    grams >>= np.uint64(64 - AVERAGE_BITS)
    places = np.flatnonzero(grams == 0) + 8
    ends, last, k = [], 0, 0
    while n - last > LEAST:
        k = max(k, int(np.searchsorted(places, last + LEAST)))
        end = min(int(places[k]) if k < len(places) else n, last + MOST, n)
        while end < n and text[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunks(text: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(text):
        out.append(text[at:end])
        at = end
    return out


def chunk_id(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def simple_words(text: bytes) -> list[bytes]:
    """Words with the tokens of `text` that other texts share: lower case, and a last full stop or comma by itself.

    Both hold for this family of tokenizers: it lowers case, and parts letters and digits from other characters.
    A capital before a mark that may join it keeps its case, for characters are composed first.
    """
    if b"<|" in text:  # special tokens keep their case
        return text.split()
    lower = text.lower() if text.isascii() else CAPITALS.sub(lambda m: m[0].lower(), text)
    return STOP.sub(rb" \1", lower).split()


class Encoder:
    """One worker's encoder: tokens of words, kept within a bound. The driver loads none."""

    def __init__(self, name: str):
        check_tokenizer(name)
        self.tokenizer = load(name)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.numbers = list(map(str, range(size)))

    def raw(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in got]

    def learn(self, words: set[bytes]) -> None:
        """Sees to it that the tokens of these words are kept."""
        if self.size > KEPT_BYTES:
            self.older, self.kept, self.size = self.kept, {}, 0
        new = words.difference(self.kept)
        again = new.intersection(self.older)
        first, again = [*new.difference(again)], [*again]
        for words, ids in ((first, self.raw(first)), (again, [*map(self.older.__getitem__, again)])):
            self.kept.update(zip(words, ids, strict=True))
            self.size += sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)

    def words(self, words: list[bytes]) -> bytes:
        """The tokens of words that were learnt."""
        return b"".join(map(self.kept.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))  # what the library does without a decoder


def body_of(chunk: bytes) -> tuple[int, int] | None:
    """From the first to the last white space of a chunk; None where it has none."""
    first = GAP.search(chunk)
    return (first.start(), LAST_GAP.match(chunk).end()) if first else None


def pieces_of(text: bytes, ready: dict[bytes, bytes]) -> tuple[list[tuple[bytes, bytes | None]], list[tuple[bytes, bytes]]]:
    """The windows and bodies of a text in order, and the words on both sides of each join.

    A piece is (text, None) for a window to encode here, or (text, tokens) for a body that was encoded
    elsewhere. Between two pieces there is white space, or nothing else to join.
    """
    if not ready:
        return [(text, None)], []
    pieces: list[tuple[bytes, bytes | None]] = []
    window = b""
    for chunk in chunks(text):
        body, at = ready.get(chunk_id(chunk)), body_of(chunk)
        if body is None or at is None:
            window += chunk
            continue
        pieces += [(window + chunk[: at[0]], None), (chunk[at[0] : at[1]], body)]
        window = chunk[at[1] :]
    pieces.append((window, None))
    pieces = [p for p in pieces if p[0]]
    joins = [(_last_word(a), _first_word(b)) for (a, _), (b, _) in zip(pieces, pieces[1:], strict=False)]
    return pieces, [x for x in joins if x[0] and x[1]]


def _last_word(piece: bytes) -> bytes:
    words = piece.rsplit(None, 1)
    return words[-1] if words else b""


def _first_word(piece: bytes) -> bytes:
    words = piece.split(None, 1)
    return words[0] if words else b""


def encode_texts(texts: list[bytes], ready: list[dict[bytes, bytes]], enc: Encoder) -> list[np.ndarray]:
    """The ids of whole texts. `ready` has, for each, the bodies of chunks that were encoded elsewhere."""
    split = [pieces_of(t, r) for t, r in zip(texts, ready, strict=True)]
    words = [[simple_words(p) if body is None else body for p, body in pieces] for pieces, _ in split]
    joins = {x for _, found in split for x in found}
    sides = {w: simple_words(w) for x in joins for w in x}
    enc.learn(set().union(*(x for parts in words for x in parts if isinstance(x, list)), *sides.values()))
    both = [*joins]
    together = enc.raw([a + b" " + b for a, b in both])
    apart = {x for x, ids in zip(both, together, strict=True) if ids != enc.words(sides[x[0]]) + enc.words(sides[x[1]])}
    out = []
    for text, parts, (_, found) in zip(texts, words, split, strict=True):
        ids = enc.raw([text])[0] if apart.intersection(found) else b"".join([enc.words(x) if isinstance(x, list) else x for x in parts])
        out.append(np.frombuffer(ids, enc.kind))
    return out


@cache
def _encoder(name: str) -> Encoder:
    return Encoder(name)


Batches = Iterator[pa.RecordBatch]


def encode_distinct(texts: DataFrame, *, text_col: str = "text", tokenizer: str = TOKENIZER, then: tuple[Callable[[Batches], Batches], str] | None = None) -> DataFrame:
    """(text_md5 binary, ids array<int>): the tokens of each distinct text; null counts as empty.

    `then` is a function of those batches that the same worker applies, with the schema that it gives: ids
    that are only needed there leave no worker, and there is one worker instead of two.
    Texts travel compressed. Only chunk ids, and the tokens of shared chunks, are moved besides.
    """
    small_batches(texts.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t) for t in b.column(1).to_pylist()], pa.binary())], names=["text_md5", "packed"])

    def unpacked(b: pa.RecordBatch) -> Iterator[tuple]:
        z = zstandard.ZstdDecompressor()
        for h, p, *more in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            yield h, z.decompress(p), *more

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(c, h) for h, t in unpacked(b) for c in dict.fromkeys(map(chunk_id, chunks(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["chunk", "text_md5"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            inner = {}
            for _, t, own in unpacked(b):
                wanted = set(own)
                inner |= {c: simple_words(x[at[0] : at[1]]) if (at := body_of(x)) else [] for x in chunks(t) if (c := chunk_id(x)) in wanted}
            enc.learn(set().union(*inner.values()))
            found = [(c, enc.words(x)) for c, x in inner.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["chunk", "body"])

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            rows = [(t, {r["chunk"]: r["body"] for r in ready or ()}) for _, t, ready in unpacked(b)]
            ids = encode_texts([t for t, _ in rows], [r for _, r in rows], enc)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["text_md5", "ids"])

    keyed = texts.select(_md5(F.col(text_col)).alias("text_md5"), whole(F.col(text_col)).cast("binary").alias("text"))
    # Texts are dealt out once; every use below takes that exchange again. Keys are never null, so no use adds a filter of its own.
    packed = keyed.mapInArrow(pack, _schema("text_md5", "packed")).dropDuplicates(["text_md5"])
    refs = scratch(packed.mapInArrow(pieces, _schema("chunk", "text_md5")), "refs")  # read by two joins; texts are cut once
    shared = refs.groupBy("chunk").agg(F.min("text_md5").alias("owner"), F.max("text_md5").alias("other")).filter("owner != other")
    owned = shared.groupBy(F.col("owner").alias("text_md5")).agg(F.collect_list("chunk").alias("own"))
    encoded = packed.join(owned, "text_md5").mapInArrow(bodies, _schema("chunk", "body"))
    used = refs.join(encoded, "chunk")  # by itself in its stage, so that Spark can split a chunk that a third of the texts hold
    ready = used.groupBy("text_md5").agg(F.collect_list(F.struct("chunk", "body")).alias("ready"))
    every = packed.join(ready, "text_md5", "left")
    if then is None:
        return every.mapInArrow(whole_texts, "text_md5 binary, ids array<int>")
    after, schema = then
    return every.mapInArrow(lambda batches: after(whole_texts(batches)), schema)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): a row for each row of `docs`, repeated rows and null ids included. Null text: no ids."""
    ids = encode_distinct(docs, text_col=text_col, tokenizer=tokenizer)
    return docs.select(F.col(id_col).alias("doc_id"), _md5(F.col(text_col)).alias("text_md5")).join(ids, "text_md5").select("doc_id", "ids")


def decode(tokens: DataFrame, *, ids_col: str = "ids", out_col: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """`tokens` with the text of its ids, special tokens included; null ids give null."""
    small_batches(tokens.sparkSession)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            got = [None if ids is None else enc.decode(ids) for ids in _lists(b.column(b.schema.get_field_index(ids_col)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, out_col])

    return tokens.mapInArrow(run, schema)


def digest_batches(batches: Batches, key: str, tokenizer: str) -> Batches:
    """(key, n_tokens, ids_sha256, decoded_sha256) of batches of (key, ids)."""
    enc = _encoder(tokenizer)
    for b in batches:
        ids = list(_lists(b.column(1)))
        cols = [pa.array(list(map(len, ids)), pa.int64()), pa.array([_sha(" ".join(map(enc.numbers.__getitem__, x))) for x in ids], pa.string()), pa.array([_sha(enc.decode(x)) for x in ids], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(tokens: DataFrame, *, key_col: str, ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of rows with ids: their number, their decimal form and their decoded text."""
    small_batches(tokens.sparkSession)
    kind = tokens.schema[key_col].dataType.simpleString()
    return tokens.select(key_col, ids_col).mapInArrow(lambda batches: digest_batches(batches, key_col, tokenizer), f"{key_col} {kind}, {DIGESTS}")


def encoded_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a row for each row of `docs`; ids stay where they were made."""
    then = (lambda batches: digest_batches(batches, "text_md5", tokenizer)), f"text_md5 binary, {DIGESTS}"
    told = encode_distinct(docs, text_col=text_col, tokenizer=tokenizer, then=then)
    return docs.select(F.col(id_col).alias("doc_id"), _md5(F.col(text_col)).alias("text_md5")).join(told, "text_md5").drop("text_md5")


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b, null in zip(ends[:-1], ends[1:], column.is_null().to_pylist(), strict=True):
        yield None if null else values[a:b].tolist()


def _schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.BinaryType(), False) for n in names])


def _md5(text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(whole(text).cast("binary"))), F.lit(b""))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
