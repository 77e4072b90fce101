"""Best-fit packing: token sequences of a fixed size, filled by bounded-space online best-fit.

Documents are tokenised, closed by an end id and cut into pieces of at most ``capacity`` tokens (only longer
ones are cut).  Pieces are dealt by hash into groups of about ``group_pieces``; each group is one stream,
longest pieces first, through ``BestFit``: a fixed number of open bins held in a bitset keyed by free space, where
the fullest bin is closed when a new one is needed and none may be opened.  A group's state is the open bins,
whatever its size; the number of groups grows with the input.

Defined results: null or empty text is one piece holding only the end id; an empty table gives no rows; repeated
rows are packed each; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import cut, worker_memo

CAPACITY = 2048
OPEN_BINS = 8192
GROUP_PIECES = 50_000
END_ID = 0
MEMO_ENTRIES = 400_000  # chunks a worker remembers
MEMO_CHARS = 48         # longer chunks are not remembered

# Separators of str.split() that the tokenizer's pattern does not take for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

# FIXED VALUES: the tokenizer file's own split pattern, and the byte alphabet of byte-level vocabularies
# (printable bytes stand for themselves, the others for the code points from 256 on).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class ChunkTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, with bounded memos of chunks and words.

    The tokenizer drops white space before it merges and never joins across it, so a text's ids are those of its
    white-space separated chunks one after another; chunks and their words repeat, texts do not.  Chunks with
    letters beyond U+024F (where normalisation may join characters) go through the library as they are, and so do whole
    texts with an added token of the vocabulary.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        self.tokenizer = Tokenizer.from_file(path)
        # texts that quote an added token, which the library finds before it splits, go through it whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_start = os.path.commonprefix(added) if added else None
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search
        self.merge = self.tokenizer.model.tokenize
        self.split = regex.compile(_SPLIT).findall
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalnum() else "".join(_BYTE_CHARS[b] for b in word.encode())
        ids = struct.pack(f"<{len(found := self.merge(spelled))}I", *[t.id for t in found])
        if len(word) <= MEMO_CHARS:
            if len(self.words) >= self.entries:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "\u0250":
            get = self.words.get
            ids = b"".join([get(w) or self._word(w) for w in self.split(chunk.lower())])
        else:
            ids = self._whole(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.chunks) >= self.entries:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or self.added_start is not None and self.added_start in text and self.added(text):
            return self._whole(text)
        chunks = (text.lower() if text.isascii() else text).split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.chunks.get(chunks[i]) or self._chunk(chunks[i])
        return b"".join(found)


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of this file."""
    return worker_memo(("words", path), lambda: ChunkTokenizer(path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each piece of each document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    fields = [("doc_id", arrow_id), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[i:i + 4 * capacity]
                        row = (doc, k, i // 4, len(own) // 4, zlib.crc32(own))
                        rows.append(row + ((np.frombuffer(own, "<i4"),) if with_ids else ()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut_up, ddl)


class BestFit:
    """Bounded-space online best-fit.

    ``free`` has bit f set while some open bin has f tokens left; ``bins[f]`` lists those bins.  A piece goes to
    the bin it fills best; if none has room a new bin is opened, for which the fullest is closed at the limit.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.bins, self.n_open, self.next_bin = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, f: int) -> int:
        own = self.bins[f]
        b = own.pop()
        if not own:
            self.free &= ~(1 << f)
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``length`` tokens."""
        roomy = self.free >> length
        if roomy:
            f = length + (roomy & -roomy).bit_length() - 1
            b = self._take(f)
        else:
            if self.n_open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            f, b = self.capacity, self.next_bin
            self.next_bin += 1
        left = f - length
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.n_open += 1
        return b, self.capacity - f


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``.

    The piece rows (without ids: a few numbers each) are kept in the shared folder, as they are counted first.
    """
    thin = cut(piece_rows)
    n_groups = max(1, -(-thin.count() // group_pieces))
    kind = thin.schema["doc_id"].dataType.simpleString()
    grouped = (thin.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)))
               .repartition(n_groups, "grp")
               .sortWithinPartitions("grp", F.desc("length"), "doc_id", "piece"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, fit = None, None
        for frame in frames:
            ids, offsets = [], []
            for g, n in zip(frame["grp"].tolist(), frame["length"].tolist(), strict=True):
                if g != grp:
                    grp, fit = g, BestFit(capacity, open_bins)
                b, at = fit.place(n)
                ids.append((g << 40) + b)
                offsets.append(at)
            yield frame.drop(columns="grp").assign(sequence_id=ids, offset=offsets)

    return grouped.mapInPandas(fill, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")


def sequences(packed: DataFrame, piece_ids: DataFrame) -> DataFrame:
    """The packed token arrays: ``sequence_id, ids``; ``piece_ids`` are the pieces with their ids.

    A sequence gathers at most ``capacity`` tokens.
    """
    keys = ["doc_id", "piece", "ids_crc32"]
    joined = packed.join(piece_ids.select(*keys, "ids").dropDuplicates(keys), keys)
    return joined.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
