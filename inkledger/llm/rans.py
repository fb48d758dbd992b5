"""Token-ID output in a compressed binary format: static range asymmetric numeral system (rANS).

One frequency table over all documents (exact counts, scaled to 2^20) is shared by all blocks. A block holds whole
documents in ascending doc_id order; its ids are dealt out to interleaved lanes that one numpy step encodes or
decodes together. Blocks are independent, and within a block each checkpoint (the lanes' states and the place among
the words, every ``CHECK_IDS`` ids) starts a stretch that decodes alone and has its own crc32.

Block format, little-endian: magic ``RANS``, u32 lanes, u32 ids between checkpoints, u64 ids, u64 words, u32
documents; for each checkpoint lanes x u64 states, then for each a u64 place among the words, then for each the u32
crc32 of its ids as u32; documents x i64 doc_id, documents x u64 token counts, u8 flags x documents (1: null id),
words x u32. The table file holds the 2^20-scaled frequencies as u32. A data set of blocks is a Parquet table
(part, block, n_tokens, payload), so that any store Spark writes to can hold it.

Defined cases: null or empty text: only the end id. A null doc_id comes first. Rows with one doc_id are ordered by
their text's crc32; repeated rows are separate documents. An added token's string in a text becomes that token's id,
as the library has it. A text of any length is one document of one block. Empty table: no blocks. Other columns are
not read, so they may have any name.
"""

from __future__ import annotations

import codecs
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c

MAGIC = b"RANS"
BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
#: A block is closed once it holds so many ids.
BLOCK_IDS = 1 << 18
END_ID = 2
#: Ids between two checkpoints of a block.
CHECK_IDS = 1 << 16
#: Distinct stretches between spaces that a worker remembers.
PIECES_KEPT = 900_000
HEAD = struct.Struct("<4sIIQQI")
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _shown() -> str:
    """The character that byte-level BPE writes for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class Pieces(dict):
    """The ids of each stretch that begins with a space, as little-endian u16, learnt on first sight.

    A stretch that ends in white space is flagged instead of learnt: its pre-tokens depend on what follows.
    """

    def __init__(self, bpe, split):
        self.tokenize, self.split, self.odd = bpe.tokenize, split, False
        self.blank: dict[str, bytes] = {}
        self.shown = _shown()

    def token(self, word: str) -> bytes:
        """The ids of one pre-token."""
        own = self.blank if word[-1:].isspace() else self
        found = own.get(word)
        if found is None:
            found = own[word] = self.learn(word)
        return found

    def learn(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", "\u0120")
        else:
            shown = codecs.charmap_decode(word.encode(), "strict", self.shown)[0]
        return array("H", [t.id for t in self.tokenize(shown)]).tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.token, self.split.findall(text)))

    def __missing__(self, piece: str) -> bytes:
        """The common shapes are cut without the pattern."""
        if piece[-1:].isspace():
            self.odd = True
            return b""
        core = piece.rstrip(".,!?;:")
        if core[:1] == " " and core[1:].isalpha():
            found = self.learn(piece) if len(core) == len(piece) else self[core] + self.token(piece[len(core) :])
        else:
            head, line, tail = piece.partition("\n")
            if tail.isalpha() and head and not head[-1].isspace():
                found = self[head] + self.token(line) + self.token(tail)
            else:
                found = self.whole(piece)
        self[piece] = found
        return found


class WordTokenizer:
    """Encodes whole texts with the ``tokenizers`` library, one distinct pre-token at a time.

    A byte-level BPE works on each pre-token alone, and a text may be cut before any space that follows a
    character other than white space without changing its pre-tokens; so ids of pieces are looked up and joined.
    A text with other cuts is split by the pattern as a whole; one that holds an added token's string is encoded by
    the library's own call.
    """

    def __init__(self, path: str):
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self.model.model, regex.compile(GPT2_SPLIT))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u16."""
        out = [self._one(t) for t in texts]
        if len(self.pieces) > PIECES_KEPT:  # frequent ones were met early
            for late in list(self.pieces)[PIECES_KEPT * 2 // 3 :]:
                del self.pieces[late]
        return out

    def _one(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return array("H", self.model.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self.pieces
        if "\0" not in text:
            pieces.odd = False
            found = b"".join(map(pieces.__getitem__, text.replace(" ", "\0 ").split("\0")))
            if not pieces.odd:
                return found
        return pieces.whole(text)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# ---- coder ---------------------------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 for every id that occurs, summing to 2^BITS."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    goal = 1 << BITS
    share = counts.astype(float) * goal / total
    out = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    gap = goal - int(out.sum())
    order = np.argsort(out - share, kind="stable") if gap > 0 else np.argsort(-out, kind="stable")
    while gap:
        able = order[(out[order] > (1 if gap < 0 else 0))][: abs(gap)]
        out[able] += 1 if gap > 0 else -1
        gap = goal - int(out.sum())
    return out


def encode_ids(ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = CHECK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, places, words): words come out in the order in which the decoder needs them.

    Row k of ``states`` and entry k of ``places`` are checkpoint k: the lanes' states and the number of words used
    before the ids from ``k * step`` on, where ``step`` is ``every`` rounded up to whole rows of lanes.
    """
    cum = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    f = freq.astype(np.uint64)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    step, count, states, places = row_step(lanes, every), 0, [], []
    for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
        row = ids[at : at + lanes]
        x, fr = state[: len(row)], f[row]
        spill = x >= fr << np.uint64(63 - BITS)
        words.append(x[spill].astype(np.uint32))  # the low 32 bits
        count += len(words[-1])
        x = np.where(spill, x >> np.uint64(32), x)
        quotient = x // fr
        state[: len(row)] = (quotient << np.uint64(BITS)) + (x - quotient * fr) + cum[row]
        if at % step == 0:
            states.append(state.copy())
            places.append(count)
    if not states:
        states, places = [state], [0]
    used = count - np.array(places[::-1], np.int64)
    return np.array(states[::-1]), used, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def row_step(lanes: int, every: int = CHECK_IDS) -> int:
    return -(-every // lanes) * lanes


class Decoder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    def ids(self, state: np.ndarray, words: np.ndarray, n: int, after: np.ndarray | None = None) -> np.ndarray:
        """The ``n`` ids that follow a checkpoint; they end at the states of the next one, or where the encoder began."""
        state, out, used, lanes = state.copy(), np.empty(n, np.uint32), 0, len(state)
        mask = np.uint64((1 << BITS) - 1)
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            low = x & mask
            symbol = self.slot[low]
            out[at : at + len(x)] = symbol
            x = self.freq[symbol] * (x >> np.uint64(BITS)) + low - self.cum[symbol]
            thin = np.flatnonzero(x < LOW)
            if used + len(thin) > len(words):
                break
            x[thin] = x[thin] << np.uint64(32) | words[used : used + len(thin)]
            used += len(thin)
            state[: len(x)] = x
        if used != len(words) or (state != (LOW if after is None else after)).any():
            raise ValueError("a token block does not decode to its end")
        return out


def pack_block(doc: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = CHECK_IDS) -> bytes:
    lanes = max(1, min(lanes, len(ids) // 64))
    states, places, words = encode_ids(ids, freq, lanes, every)
    step = row_step(lanes, every)
    sums = np.array([c.crc(ids[k * step : (k + 1) * step].astype("<u4").tobytes()) for k in range(len(states))], "<u4")
    head = HEAD.pack(MAGIC, lanes, step, len(ids), len(words), len(doc))
    return b"".join((head, states.astype("<u8").tobytes(), places.astype("<u8").tobytes(), sums.tobytes(), doc.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), null.astype(np.uint8).tobytes(), words.astype("<u4").tobytes()))


class Block:
    """A packed block; its stretches between checkpoints decode alone, in any order."""

    def __init__(self, block: bytes):
        magic, self.lanes, self.step, self.n, words, docs = HEAD.unpack_from(block)
        if magic != MAGIC or not self.lanes or not self.step:
            raise ValueError("not a token block")
        self.stretches = max(1, -(-self.n // self.step))
        shape = (("<u8", self.stretches * self.lanes), ("<u8", self.stretches), ("<u4", self.stretches), ("<i8", docs), ("<u8", docs), ("u1", docs), ("<u4", words))
        if len(block) != HEAD.size + sum(np.dtype(kind).itemsize * count for kind, count in shape):
            raise ValueError("not a whole token block")
        at, parts = HEAD.size, []
        for kind, count in shape:
            parts.append(np.frombuffer(block, kind, count, at))
            at += parts[-1].nbytes
        self.states, self.places, self.sums, self.doc, self.counts, self.null, self.words = parts
        self.states = self.states.reshape(self.stretches, self.lanes)
        if int(self.counts.sum()) != self.n:
            raise ValueError("a token block's counts do not add up")

    def stretch(self, k: int, decoder: Decoder) -> np.ndarray:
        """The ids from checkpoint ``k`` to the next; raises ValueError on any damage."""
        last = k + 1 == self.stretches
        words = self.words[int(self.places[k]) : None if last else int(self.places[k + 1])]
        ids = decoder.ids(self.states[k], words, min(self.step, self.n - k * self.step), None if last else self.states[k + 1])
        if c.crc(ids.astype("<u4").tobytes()) != self.sums[k]:
            raise ValueError("a token block's checksum does not match its ids")
        return ids


def unpack_block(block: bytes, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, null flags, token counts, ids); raises ValueError on any damage."""
    b = Block(block)
    return b.doc, b.null, b.counts, np.concatenate([b.stretch(k, decoder) for k in range(b.stretches)])


# ---- data sets -----------------------------------------------------------------------------------------------


def _tokenise(path: str, end_id: int, size: int):
    """doc_id, ver, ids of each document, and at each task's end one row with the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = tokenizer(path), np.zeros(size, np.int64)
        end = struct.pack("<H", end_id)
        names = ["doc_id", "ver", "ids", "counts"]
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(texts):
                part = [x + end for x in model.encode([t or "" for t in texts[at : at + 500].to_pylist()])]
                total += np.bincount(np.frombuffer(b"".join(part), "<u2"), minlength=size)
                rows = slice(at, at + len(part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], batch.column("ver")[rows], pa.array(part, pa.binary()), pa.nulls(len(part), pa.binary())], names=names)
                at += len(part)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=names)

    return run


def _added(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(blob), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return run


def _encode(freq: np.ndarray, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bool, bytes]] = []
        count = 0

        def closed() -> pa.RecordBatch:
            doc, null = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])
            counts = np.array([len(h[2]) // 2 for h in held])
            ids = np.frombuffer(b"".join(h[2] for h in held), "<u2").astype(np.int64)
            payload = pack_block(doc, null, counts, ids, freq)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "n_tokens", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append((doc or 0, doc is None, ids))
                count += len(ids) // 2
                if count >= block_ids:
                    yield closed()
                    held, count, block = [], 0, block + 1
        if held:
            yield closed()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Tokenise ``docs`` and write ``path``/blocks and ``path``/table; ids must fit 16 bits."""
    spark = docs.sparkSession
    size, before = 1 << 16, c.tables_written()
    coded = c.write_table(c.docs_with_version(docs).mapInArrow(_tokenise(tokenizer_path, end_id, size), "doc_id long, ver long, ids binary, counts binary"), "token-ids")
    ids = coded.where("ids is not null").drop("counts")
    counted = coded.select("counts").where("counts is not null").mapInArrow(_added(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(size, np.int64)
    for row in counted:
        counts[row.id] = row.n
    freq = scaled(counts)
    spark.createDataFrame([(BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").write.parquet(f"{path}/table")
    ordered = ids.repartitionByRange(c.partitions(spark), F.asc_nulls_first("doc_id"), "ver").sortWithinPartitions(F.asc_nulls_first("doc_id"), "ver")
    ordered.mapInArrow(_encode(freq, block_ids), "part int, block long, n_tokens long, payload binary").write.parquet(f"{path}/blocks")
    c.delete_tables(spark, before)


def _decode(freq: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(freq)
        for batch in batches:
            for part, block, payload in zip(*(batch.column(k).to_pylist() for k in ("part", "block", "payload"))):
                doc, null, counts, ids = unpack_block(payload, decoder)
                raw, counts = ids.astype("<u4").tobytes(), counts.astype(np.int64)
                ends = np.cumsum(counts)
                each = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(doc)
                cols = [pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, block), pa.int64()), pa.array(doc.astype(np.int64), mask=null.astype(bool)), pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in each], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, decoded block by block in parallel."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").head()["freq"], "<u4").astype(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a writing task
    before, total = {}, 0
    for p in sorted(parts):
        before[p], total = total, total + parts[p]
    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part int, before long")
    own = blocks.select("part", "block", "n_tokens").join(starts, "part")
    from pyspark.sql import Window

    order = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select("part", "block", (F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).alias("base"))
    ids = ", ids array<int>" if with_ids else ""
    rows = blocks.select("part", "block", "payload").mapInArrow(_decode(freq, with_ids), f"part int, block long, doc_id long, inside long, n_tokens long, ids_crc32 long{ids}")
    return rows.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
