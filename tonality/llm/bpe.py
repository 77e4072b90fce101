"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding.  Every prefix of a byte string has one last token in its BPE encoding, and a token may follow another
if and only if encoding the two together gives just these two.  The transducer reads bytes from left to right and keeps
the positions from which a token may still be running: for each, the place in the trie of tokens and the
token before it.  For each byte it gives the last token of the prefix that ends there; read backwards from the end, by the
tokens' lengths, these are the encoding.  States and transitions are made when first met and then looked up.

Decoding.  Token bytes go through an incremental UTF-8 machine that holds back an unfinished character.

Defined results: null text is the empty text (no ids); every other text is encoded whole; an empty table gives
no rows; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonality.llm.common import worker_memo

MAX_STATES = 300_000   # a worker's transducer starts anew beyond it
MEMO_ENTRIES = 800_000
MEMO_CHARS = 48
RUNS = -1              # no byte
NEVER = 1 << 60        # the rank of what is no token


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """BPE of one pre-token by lazily made states."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # trie: node << 8 | byte -> node
        self.ends: list[int] = [-1]      # token that ends at a node
        self.inner: list[bool] = [False]
        for t, r in ranks.items():
            node = 0
            for b in t:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.ends[node] = r
        self.follows: dict[int, bool] = {}  # last << 32 | new
        self.steps: dict[int, tuple[list[int], list[bytes], list[bytes]] | None] = {}
        self._restart()

    def _restart(self) -> None:
        # a state: byte -> (the last token up to there, the next state), and under RUNS its runs, the longest first: for each the
        # place in the trie and the token before it
        self.start: dict = {RUNS: (0, -1)}
        self.states = {(0, -1): self.start}

    def _steps(self, token: int) -> tuple[list[int], list[bytes], list[bytes]] | None:
        """Merging of a token's bytes by ranks: the rank of each step, and the first and the last part before it and at the end.

        None if the bytes do not merge into the token.
        """
        if token not in self.steps:
            data, ranks, get = self.token[token], [], self.ranks.get
            parts = [data[i:i + 1] for i in range(len(data))]
            firsts, lasts = parts[:1], parts[-1:]
            while len(parts) > 1:
                found = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
                rank = min(found)
                if rank == NEVER:
                    break
                best = found.index(rank)
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
                ranks.append(rank)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            self.steps[token] = (ranks + [NEVER], firsts, lasts) if len(parts) == 1 else None
        return self.steps[token]

    def _stay_apart(self, last: int, new: int) -> bool:
        """Whether merging the two tokens' bytes together gives just these two.

        Both sides go through their own steps, the lower rank first; the two parts at the boundary must never come before them (of
        equal ranks the leftmost goes first).
        """
        own, other = self._steps(last), self._steps(new)
        if own is None or other is None:
            return False
        get = self.ranks.get
        left, _, ends = own
        right, starts, _ = other
        i = j = 0
        while True:
            a, b = left[i], right[j]
            between = get(ends[i] + starts[j], NEVER)
            if between < a and between <= b and between != NEVER:
                return False
            if a <= b:
                if a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _may_follow(self, last: int, new: int) -> bool:
        if last < 0:
            return self._steps(new) is not None
        key = last << 32 | new
        may = self.follows.get(key)
        if may is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            may = self.follows[key] = self._stay_apart(last, new)
        return may

    def _move(self, state: dict, byte: int) -> tuple[int, dict]:
        child, inner = self.child, self.inner
        runs, new, old = [], -1, state[RUNS]
        for k in range(0, len(old), 2):
            at = child.get(old[k] << 8 | byte)
            if at is not None:
                last = old[k + 1]
                if new < 0 <= self.ends[at] and self._may_follow(last, self.ends[at]):
                    new = self.ends[at]
                if inner[at]:
                    runs += (at, last)
        if new < 0:
            raise ValueError(f"no token for byte {byte}")
        to = (*runs, 0, new)
        following = self.states.get(to)
        if following is None:
            following = self.states[to] = {RUNS: to}
        move = state[byte] = (new, following)
        return move

    def __call__(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._restart()
        state, last = self.start, []
        for b in piece:
            token, state = state.get(b) or self._move(state, b)
            last.append(token)
        out, at = [], len(last)
        while at:  # the last token, the one before it, and so on
            out.append(last[at - 1])
            at -= self.length[out[-1]]
        out.reverse()
        return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A boundary of the pattern always lies before a single space between other characters, so a text is cut
    there and the chunks' ids are remembered; texts with other runs of white space go through the pattern whole.
    """

    # runs of white space that the cut at single spaces would divide, and white space other than space and \n
    _RUNS = re.compile(r"\s \s|\s \Z|[^\S \n]")

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.transduce = Transducer(read_ranks(path))
        self.memo: dict[str, bytes] = {"": b""}  # of chunks and of the pattern's matches (a match by itself is one match)

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(part) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
                self.memo[""] = b""
            self.memo[part] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        found = self.transduce(piece.encode())
        return self._keep(piece, struct.pack(f"<{len(found)}I", *found))

    def _ids(self, text: str) -> bytes:
        get = self.memo.get
        return b"".join([get(p) or self._piece(p) for p in self.find(text)])

    def _chunk(self, chunk: str) -> bytes:
        ids = self.memo.get(chunk)
        if ids is None:
            found = self.find(chunk)
            ids = self._piece(chunk) if found == [chunk] else self._keep(chunk, self._ids(chunk))
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._RUNS.search(text) or "\0" in text:
            return self._ids(text)
        chunks = text.replace(" ", "\0 ").split("\0")
        out = list(map(self.memo.get, chunks))
        if None in out:
            out = [self._chunk(c) if ids is None else ids for c, ids in zip(chunks, out)]
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text of whole characters and holds back an unfinished one."""

    #: bytes a character has, by its first byte's high bits; 0 for a continuation byte
    _LENGTH = bytes([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 8 + [1] * 8)

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            need = self._LENGTH[data[end - back]]
            if need:  # the last character's first byte
                end -= back if need > back else 0
                break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def flush(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Decoder:
    """Text of ids, a block of tokens at a time."""

    def __init__(self, path: str):
        self.token = {r: t for t, r in read_ranks(path).items()}

    def stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        machine, ids = Utf8Stream(), list(ids)
        for i in range(0, len(ids), block):
            yield machine.feed(b"".join(map(self.token.__getitem__, ids[i:i + block])))
        yield machine.flush()


def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder of this rank file."""
    return worker_memo(("bytes", path, pattern), lambda: (Encoder(path, pattern), Decoder(path)))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _mapped(df: DataFrame, source: str, fields: list[tuple[str, pa.DataType]], ddl: str, row) -> DataFrame:
    """``doc_id`` and what ``row(value)`` returns, for each value of ``source``."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", _ARROW[kind]), *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [row(v) for v in batch.column(source).to_pylist()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))],
                    schema=schema)

    return df.select("doc_id", source).mapInArrow(work, f"doc_id {kind}, {ddl}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every text."""
    return _mapped(docs, "text", [("ids", pa.list_(pa.int32()))], "ids array<int>",
                   lambda t: (np.frombuffer(coder(path, pattern)[0](t or ""), "<i4"),))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of every array of ids (null ids: the empty text)."""
    return _mapped(tokens, "ids", [("text", pa.string())], "text string",
                   lambda ids: ("".join(coder(path, pattern)[1].stream(ids or [])),))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them, without storing either."""
    def row(text: str | None) -> tuple[int, str, str]:
        encoder, decoder = coder(path, pattern)
        ids = encoder(text or "")
        back = hashlib.sha256()
        for part in decoder.stream(np.frombuffer(ids, "<u4").tolist()):
            back.update(part.encode())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()

    return _mapped(docs, "text", [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())],
                   "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
