"""Sequence packing: vector bin packing by the dot-product heuristic over pieces of tokenised texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.rows import MEMORY, map_texts
from fieldpulse.runtime import as_table

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 512
END_ID = 1
# Pieces that one task packs together; large enough that the last, part-filled sequence does not matter.
SHARD_PIECES = 2_000
KEPT_WORDS = 400_000
PIECE_BYTES = 1 << 20

PIECES = "row bigint, id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss bigint, own bigint"
# Sequences of one whole piece are numbered apart from those that a shard packs.
_OWN = 1 << 62


class WordEncoder:
    """Token bytes of words, little-endian and 32 bits each, remembered while they keep coming.

    For tokenizers that drop white space, never join across it, lower-case, and end every piece of
    their pre-tokenizer with a token that carries an end mark. Words of letters are encoded many at
    a time and cut apart at the end marks; anything else, and a batch whose end marks do not add up,
    is encoded word by word. Two generations of words are kept, each of a bounded number.
    """

    def __init__(self, path: str, kept_words: int):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept_words = Tokenizer.from_file(path), kept_words
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, words: list[str]) -> list[bytes]:
        from array import array

        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def letters(self, words: list[str]) -> list[bytes]:
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            raw = self.whole([" ".join(part)])[0]
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            if len(stops) != len(part):
                out += self.whole(part)
                continue
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > self.kept_words:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        plain: dict[bytes, tuple[str, bytes]] = {}
        odd: list[bytes] = []
        for w in words:
            if (held := older.get(w)) is not None:
                known[w] = held
                continue
            # A full stop or comma after a letter is a piece of its own.
            tail = w[-1:] if w[-1] in b".," and len(w) > 1 else b""
            stem = (w[:-1] if tail else w).decode()
            if stem.isalpha():
                plain[w] = (stem.lower() if stem.isascii() else stem, tail)
            else:
                odd.append(w)
        stems = {stem for stem, _ in plain.values()}
        new = [x for x in stems if x.encode() not in known]
        known.update(zip(map(str.encode, new), self.letters(new), strict=True))
        known.update(zip(odd, self.whole([w.decode() for w in odd]), strict=True))
        for tail in (b".", b","):
            if tail not in known:
                known[tail] = self.whole([tail.decode()])[0]
        known.update((w, known[stem.encode()] + (known[tail] if tail else b"")) for w, (stem, tail) in plain.items())

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words in a row."""
        get = self.known.get
        found = [list(map(get, words)) for words in texts]
        gaps = [[n for n, p in enumerate(parts) if p is None] for parts in found]
        if any(gaps):
            self.learn({words[n] for words, open_ in zip(texts, gaps, strict=True) for n in open_})
            get = self.known.get
            for words, parts, open_ in zip(texts, found, gaps, strict=True):
                for n in open_:
                    parts[n] = get(words[n])
        return [b"".join(parts) for parts in found]


def _cutter(tokenizer_path: str, limit: int, end_id: int, kept_words: int):
    def encoder() -> WordEncoder:
        """One for each worker process, kept from task to task."""
        import sys
        from types import ModuleType

        held = sys.modules.setdefault(MEMORY, ModuleType(MEMORY)).__dict__
        if (tokenizer_path, kept_words) not in held:
            held[tokenizer_path, kept_words] = WordEncoder(tokenizer_path, kept_words)
        return held[tokenizer_path, kept_words]

    def word_runs(data: bytes) -> Iterator[list[bytes]]:
        import re

        space, at = re.compile(rb"[\x20\x09-\x0d]"), 0
        while at < len(data):
            found = space.search(data, at + PIECE_BYTES)
            stop = found.start() if found else len(data)
            yield data[at:stop].split()
            at = stop

    def encoded(texts: Iterator[bytes], words: WordEncoder) -> Iterator[bytes]:
        """Ids of each text; small texts are encoded together, a long one piece by piece."""
        group: list[list[bytes]] = []
        size = 0
        for data in texts:
            if len(data) > PIECE_BYTES:
                yield from words.encode(group)
                group, size = [], 0
                yield b"".join(words.encode([run])[0] for run in word_runs(data))
                continue
            group.append(data.split())
            size += len(data)
            if size >= PIECE_BYTES:
                yield from words.encode(group)
                group, size = [], 0
        yield from words.encode(group)

    def lengths(n: int) -> list[int]:
        """Whole sequences, then one half and the rest; pieces of half a sequence or less pack almost gapless."""
        whole, rest = divmod(n, limit)
        half = limit // 2
        return [limit] * whole + ([half, rest - half] if rest > half else [rest] if rest else [])

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        words = encoder()
        row = own = TaskContext.get().partitionId() << 33
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, encoded((t.as_py() for t in batch.column(1)), words), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                for size in lengths(n):
                    crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])
                    out.append((row, doc, at, size, crc, n, size, own if size == limit else None))
                    own += size == limit
                    at += size
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["row", "id", "start", "length", "ids_crc32", "doc_tokens", "loss", "own"],
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
               limit: int = SEQUENCE_TOKENS, end_id: int = END_ID, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of at most ``limit`` ids of every text and its end id; every id lies in one piece.

    The tokenizer must drop white space and never join across it, so that a text's ids are those of
    its words in a row and each worker encodes a word once while it remembers it. All ids of a plain
    document bear loss.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    )
    return map_texts(rows, _cutter(tokenizer_path, limit, end_id, kept_words), PIECES, remembers=True)


def _packer(limits: tuple[int, int, int]):
    def pack(key, pieces):
        """Fill one sequence after another with the piece whose demand points most along what is left."""
        import numpy as np
        import pyarrow as pa

        pieces = pieces.sort_by([(c, "ascending") for c in ("length", "loss", "id", "row", "start")])
        demand = np.column_stack([
            pieces["length"].to_numpy(), np.ones(pieces.num_rows, np.int64), pieces["loss"].to_numpy()
        ])
        full = np.array(limits, np.int64)
        # Pieces of one demand are alike, so the choice is among kinds; each kind hands out its pieces in order.
        kinds, first, count = np.unique(demand, axis=0, return_index=True, return_counts=True)
        sequence, offset = np.zeros(pieces.num_rows, np.int64), np.zeros(pieces.num_rows, np.int64)
        weighted = kinds / full
        left_in, taken, made = count.copy(), np.zeros(len(kinds), np.int64), 0
        todo = int(count.sum())
        while todo:
            room, filled = full.copy(), 0
            while True:
                fits = (left_in > 0) & (kinds <= room).all(1)
                if not fits.any():
                    break
                gain = np.where(fits, weighted @ (room / full), -1.0)
                k = int(gain.argmax())
                place = first[k] + taken[k]
                sequence[place], offset[place] = made, filled
                taken[k] += 1
                left_in[k] -= 1
                todo -= 1
                filled += int(kinds[k, 0])
                room -= kinds[k]
            made += 1
        base = key[0].as_py() << 32
        return pieces.append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(pieces: DataFrame, max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS,
         max_loss_tokens: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, under the three limits at once.

    A piece with an ``own`` number fills a sequence by itself. The others are dealt into shards of
    about ``shard_pieces`` by a hash of row and position, whatever document they are from, and every
    shard is packed by itself: a longer corpus has more shards, not larger ones. A piece over one of
    the limits is refused.
    """
    limits = (max_tokens, max_segments, max_loss_tokens)
    if min(limits) < 1:
        raise ValueError("every limit must be at least 1")
    over = pieces.filter((F.col("length") > max_tokens) | (F.col("loss") > max_loss_tokens))
    if not over.isEmpty():
        raise ValueError("a piece is longer than a sequence may be")
    parts = pieces.filter("own is null")
    shards = max(1, -(-parts.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("row", "start"), F.lit(shards))
    fields = PIECES + ", shard bigint, sequence_id bigint, offset bigint"
    packed = parts.withColumn("shard", shard).groupBy("shard").applyInArrow(_packer(limits), fields).drop("shard")
    whole = pieces.filter("own is not null").select(
        "*", (F.lit(_OWN) + F.col("own")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.unionByName(whole)


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Null and empty texts are one piece of the end id alone. Rows that repeat an id are packed each;
    a null id is an id like any other. An empty table gives no rows; other columns are ignored.
    """
    pieces = as_table(cut_pieces(docs, tokenizer_path, id_col, text_col, max_tokens), "packing-pieces")
    return pack(pieces, max_tokens, max_segments, max_tokens).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
