"""Token ids in a compact binary form: static range asymmetric numeral systems.

Texts are tokenized once and staged. One table of symbol frequencies, counted
over every document, is shared by all blocks. Blocks hold whole documents in
ascending doc_id order and are independent of each other: `LANES` interleaved
states, words of 32 bits, checkpoints of all states on the way, checksums of
the header, the words and the ids. A block is one row of the output table, so
Spark's own committer makes the files whole when executors are lost, and any
task can decode any block, or a block from any of its checkpoints.

Layout of a block (little-endian): magic, version, lanes, scale bits,
documents, tokens, checkpoints, words; per document its number of ids; per
checkpoint the step, the place in the words and the lanes' states; the words;
crc32 of the ids as unsigned 32-bit numbers; crc32 of all before.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wareloom.session import staged, work_folder

END_ID = 0
LANES = 2048
BLOCK_TOKENS = 1 << 20
CHECKPOINT_STEPS = 256
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"WLRA"
HEADER = struct.Struct("<4sHHIIQIQ")
#: Characters of texts whose words are looked up together.
BATCH_CHARS = 4_000_000
#: Words, and pieces of words that are more than one piece, kept per worker.
MEMO, PIECES = 700_000, 50_000

# The tokenizer's split, spelled out for texts of Latin characters; other texts go to the library whole.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_STOPS = frozenset(",.;:!?")
_OPEN_SPACE = re.compile(rf" (?:[{_BLANK}]|\Z)")
_LATIN = re.compile("[\t\n\r -~\xa0-ɏ]*")


class _Pieces(dict):
    """Piece of the split -> its ids as bytes, by the library's merge model on first sight."""

    def __init__(self, model, kind) -> None:
        super().__init__()
        self.model, self.kind = model, kind
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        found = self[piece] = array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECES.findall(text)))


class _Words:
    """Known words and the ids of a space and the word, as flat arrays.

    No piece of the split goes over a space that a non-blank follows: such a
    space only begins a piece. So what stands between two such spaces has ids
    of its own.
    """

    def __init__(self, pieces: _Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.pool = np.empty(0, self.pieces.kind)
        self.lengths, self.starts = np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct words stands; new ones are encoded and added."""
        if len(self.known) + len(words) > MEMO:
            self.clear()
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            new = words.filter(at.is_null())
            ids, lengths = self._encode(new.to_pylist())
            at = pc.coalesce(at, pa.scalar(-1, pa.int32())).to_numpy(zero_copy_only=False).copy()
            at[at < 0] = len(self.known) + np.arange(len(lengths))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, ids])
            self.known = pa.concat_arrays([self.known, new])
            return at
        return at.to_numpy()

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each word's number of them. A word of letters, with or without a
        stop, is one piece (and one more) and goes straight to the merge model;
        other words are split into pieces."""
        pieces, tokenize = self.pieces, self.pieces.model.tokenize
        space, letters = pieces.letters[ord(" ")], pieces.letters
        flat, ends = array(pieces.kind), array("q")
        more, extend, ended = flat.frombytes, flat.extend, ends.append
        for word in words:
            last = word[-1:]
            bare = word[:-1] if last in _STOPS else word
            if bare.isalpha():
                shown = bare if bare.isascii() else bare.encode("utf-8").decode("latin-1").translate(letters)
                extend([t.id for t in tokenize(space + shown)])
                if bare is not word:
                    more(pieces[last])
            else:
                more(pieces.ids(" " + word))
            ended(len(flat))
        return np.frombuffer(flat, self.pool.dtype).copy(), np.diff(np.frombuffer(ends, np.int64), prepend=0)


class Encoder:
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.kind = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self.whole.model, self.kind)
        self.words = _Words(self.pieces)
        probe = " a'll, 12  b\n\n c\t\xe9\xdf !?\xa0x it's \n"
        self.plain = self.pieces.ids(probe) == self._library(probe)

    def _library(self, text: str) -> bytes:
        return array(self.kind, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list) -> list[bytes]:
        """The ids of each text; a null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            text = text or ""
            if not self.plain or not _LATIN.fullmatch(text) or any(a in text for a in self.added):
                out[i] = self._library(text)
            elif _OPEN_SPACE.search(text):
                out[i] = self.pieces.ids(text)
            elif text:
                plain.append(i)
                size += len(text)
                if size >= BATCH_CHARS:
                    self._by_words(texts, plain, out)
                    plain, size = [], 0
        if plain:
            self._by_words(texts, plain, out)
        return out

    def _by_words(self, texts: list, plain: list[int], out: list[bytes]) -> None:
        """Each distinct word of the texts is looked up once; the ids are then laid
        out by position. A text's first word has no space before it."""
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        place = self.words.places(words.dictionary).astype(np.int64)
        firsts = [self.pieces.ids(texts[i].split(" ", 1)[0]) for i in plain]
        extra = np.fromiter(map(len, firsts), np.int64, len(firsts)) // self.words.pool.itemsize
        lengths = np.concatenate([self.words.lengths[place], extra])
        starts = np.concatenate([self.words.starts[place], len(self.words.pool) + np.cumsum(extra) - extra])
        pool = np.concatenate([self.words.pool, np.frombuffer(b"".join(firsts), self.kind)])
        at = words.indices.to_numpy().copy()
        at[first] = len(place) + np.arange(len(plain))
        n = lengths[at]
        ends = np.cumsum(n)
        ids = pool[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        cuts = np.append((ends - n)[first], ends[-1]) * pool.itemsize
        for k, i in enumerate(plain):
            out[i] = ids[cuts[k] : cuts[k + 1]]


@functools.lru_cache(2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids (16- or 32-bit numbers), with the end id.

    A null text counts as empty and gives the end id alone. `tokenizer` is the
    file; without it the place of byte_bpe_50k.json on the executor.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer or vocabulary())
        end = array(encode.kind, [END_ID]).tobytes()
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [ids + end for ids in encode(list(frame["text"]))]})
        pa.default_memory_pool().release_unused()  # the worker lives on

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(work, f"doc_id {kind}, ids binary")


def symbol_counts(tokens: DataFrame, width: int) -> dict[int, int]:
    """How often each id occurs in all documents; at most one entry per id of the vocabulary."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1, np.int64)
        for frame in frames:
            ids = frame["ids"].to_numpy()
            # some megabytes at a time: counting widens every id
            cuts = np.flatnonzero(np.diff(np.cumsum([len(i) for i in ids]) >> 21, prepend=-1))
            for some in np.split(ids, cuts[1:]):
                one = np.bincount(np.frombuffer(b"".join(some), f"<u{width}"))
                if len(one) > len(total):
                    total = np.pad(total, (0, len(one) - len(total)))
                total[: len(one)] += one
        at = np.flatnonzero(total)
        yield pd.DataFrame({"symbol": at, "n": total[at]})

    rows = tokens.select("ids").mapInPandas(work, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    return {r["symbol"]: r["n"] for r in rows}


def frequencies(counts: dict[int, int], bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in order and their frequencies: at least 1 each, 2**bits in all."""
    symbols = np.array(sorted(counts) or [END_ID], np.int64)
    n = np.array([counts.get(int(s), 1) for s in symbols], np.float64)
    room = (1 << bits) - len(symbols)
    if room < 0:
        raise ValueError(f"{len(symbols)} symbols need more than {bits} scale bits")
    share = n / n.sum() * room
    freq = np.floor(share).astype(np.int64) + 1
    short = (1 << bits) - int(freq.sum())
    freq[np.lexsort((symbols, -(share - np.floor(share))))[:short]] += 1
    return symbols, freq


class Coder:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES) -> None:
        self.bits, self.lanes = bits, lanes
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.rank = np.zeros(int(symbols.max()) + 1, np.int64)
        self.rank[symbols] = np.arange(len(symbols))
        self.slot = np.repeat(np.arange(len(symbols)), freq)

    def pack(self, ids: np.ndarray, lengths: list[int]) -> bytes:
        rank, lanes, shift = self.rank[ids], self.lanes, np.uint64(self.bits)
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, int, np.ndarray]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            r = rank[step * lanes : (step + 1) * lanes]
            x, f = state[: len(r)], self.freq[r]
            full = x >= (f << np.uint64(63 - self.bits))
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                written += len(words[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(r)] = (q << shift) + (x - q * f) + self.start[r]
            if step % CHECKPOINT_STEPS == 0:
                marks.append((step, written, state.copy()))
        out = [HEADER.pack(MAGIC, 1, lanes, self.bits, len(lengths), len(ids), len(marks), written), np.array(lengths, "<u4").tobytes()]
        for step, before, states in reversed(marks):
            out += [struct.pack("<QQ", step, written - before), states.astype("<u8").tobytes()]
        out += [w.astype("<u4").tobytes() for w in reversed(words)]
        out.append(struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes())))
        return (body := b"".join(out)) + struct.pack("<I", zlib.crc32(body))

    def unpack(self, block: bytes, mark: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """lengths of the documents, ids from checkpoint `mark` on. Raises ValueError on damage."""
        if zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("damaged block")
        magic, version, lanes, bits, documents, tokens, marks, n_words = HEADER.unpack_from(block)
        if magic != MAGIC or version != 1 or bits != self.bits:
            raise ValueError("not a block of this table")
        at = HEADER.size
        lengths = np.frombuffer(block, "<u4", documents, at)
        at += 4 * documents
        words_at = at + marks * (16 + 8 * lanes)
        words = np.frombuffer(block, "<u4", n_words, words_at).astype(np.uint64)
        out = np.empty(tokens, np.int64)
        if not tokens:
            return lengths, out
        at += mark * (16 + 8 * lanes)
        first, place = struct.unpack_from("<QQ", block, at)
        state = np.frombuffer(block, "<u8", lanes, at + 16).copy()
        mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
        for step in range(first, -(-tokens // lanes)):
            m = min(lanes, tokens - step * lanes)
            x = state[:m]
            low = x & mask
            r = self.slot[low]
            out[step * lanes : step * lanes + m] = r
            x = self.freq[r] * (x >> shift) + low - self.start[r]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << np.uint64(32)) | words[place : place + len(need)]
                place += len(need)
            state[:m] = x
        ids = self.symbols[out[first * lanes :]]
        if mark == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != struct.unpack("<I", block[-8:-4])[0]:
            raise ValueError("ids do not match their checksum")
        return lengths, ids


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write `folder`/blocks and `folder`/table in ascending doc_id order.

    Rows without a doc_id come first; rows with the same doc_id are ordered by
    their ids. An empty table writes no block. Columns other than doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    width = array(encoder(tokenizer or vocabulary()).kind).itemsize
    tokens = staged(tokenize(docs, tokenizer), "token-ids")
    symbols, freq = frequencies(symbol_counts(tokens, width))
    table = spark.createDataFrame(pd.DataFrame({"symbol": symbols, "freq": freq}), "symbol long, freq long")
    table.coalesce(1).write.parquet(f"{folder}/table")
    sent = spark.sparkContext.broadcast((symbols, freq))  # one entry per id of the vocabulary at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(*sent.value)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def cut() -> pd.DataFrame:
            ids = np.concatenate(held)
            return pd.DataFrame(
                {"shard": [shard], "block": [block], "first": [first], "tokens": [len(ids)], "doc_ids": [list(names)], "data": [coder.pack(ids, [len(h) for h in held])]}
            )

        for frame in frames:
            for name, ids in zip(frame["doc_id"], frame["ids"]):
                names.append(None if pd.isna(name) else name)
                held.append(np.frombuffer(ids, f"<u{width}"))
                size += len(held[-1])
                if size >= block_tokens:
                    yield cut()
                    block, first, size = block + 1, first + size, 0
                    names.clear()
                    held.clear()
        if held:
            yield cut()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        tokens.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "ids")
        .mapInPandas(work, f"shard int, block int, first long, tokens long, doc_ids array<{kind}>, data binary")
        .write.parquet(f"{folder}/blocks")
    )


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, from the files of write()."""
    rows = spark.read.parquet(f"{folder}/table").orderBy("symbol").collect()
    sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(*sent.value)
        for frame in frames:
            for shard, first, names, data in zip(frame["shard"], frame["first"], frame["doc_ids"], frame["data"]):
                lengths, ids = coder.unpack(data)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for n, e in zip(lengths.tolist(), ends.tolist())]
                out = pd.DataFrame({"shard": shard, "doc_id": pd.Series(list(names), dtype=object), "at": first + ends - lengths, "n_tokens": lengths.astype(np.int64)})
                out["ids_crc32"] = [zlib.crc32(p) for p in parts]
                if with_ids:
                    out["ids"] = [np.frombuffer(p, "<u4").astype(np.int64) for p in parts]
                yield out

    schema = f"shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    documents = blocks.select("shard", "first", "doc_ids", "data").mapInPandas(work, schema)
    shards = (
        blocks.groupBy("shard")
        .agg(F.sum("tokens").alias("n"))
        .select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    )  # one row per shard
    return documents.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids to a fresh folder below the shared one and read the digests back."""
    folder = work_folder(docs.sparkSession, "token-blocks")
    write(docs, folder, tokenizer)
    return read(docs.sparkSession, folder, with_ids=False)
