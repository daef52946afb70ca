"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

**Lookahead.** Take a prefix of a byte string, encoded alone and as part of the string. Where the two
differ, the leftmost difference began at the prefix's end and moved left by merges: a rule (w, t)
moves it by the length of w if one side has t there and the other has not, that is if an earlier
rule, whose left token begins t, moved it to that place. The rules along such a chain have rising ranks
(merges of one rank go from the left, so they don't carry a difference left), so one pass over the
merge list gives the farthest a difference can move: ``lookahead`` bytes (339 for this
vocabulary). Tokens that end that far before the end of what is known are stable.

**Encoding.** The transducer holds the bytes of the open pre-token that are not emitted yet. Once they
fill a window (two lookaheads and the longest token), the window is merged, and its stable tokens are
emitted and forgotten: at least one, since no token is longer. The end of a pre-token makes the rest stable.
So memory is constant for an unbroken run of any length, and the work is linear in it. Pieces of texts between plain spaces
and line feeds repeat; a table keeps what the transducer gave for them (see ``pieces``). Texts of
more than ``LONG`` characters go through the transducer alone.

**Decoding.** A state machine takes token by token: its state is the bytes of an unfinished
character, and each step gives text and the next state. Invalid sequences become U+FFFD, one for
each maximal part of a character, as in the tokenizers library.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens in a
text are encoded as such; repeated rows give the same ids; a null id passes through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from foliate.llm.common import id_and_text, table
from foliate.llm.pieces import PieceTable

#: Fixed value: the pre-tokenizer's pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No pair of tokens merges.
_NEVER = 1 << 62
#: Byte strings up to this length are merged by looking for the least rank; longer ones by a heap.
SHORT = 48
#: Longer pre-tokens of pieces are not merged many at a time.
MANY = 64
#: Pieces in a worker's table: workers stay, so what they hold is kept small.
PIECES = 300_000
#: Characters of a text from which on it is streamed, and that are fed at a time.
LONG = 1 << 20
#: Characters of texts in a group, and ids decoded at a time.
GROUP, STEP = 1 << 21, 1 << 14


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next above 255."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The farthest that what follows a byte string can change its tokens, in bytes before its end, from the merges in order."""
    reach: dict[bytes, int] = {}
    made = {bytes([b]) for b in range(256)}
    for w, t in merges:
        if w not in made or t not in made or w + t in made:
            raise ValueError(f"merges are not in order of their making: {w!r} {t!r}")
        made.add(w + t)
        far = len(w) + max(reach.get(t[:k], 0) for k in range(1, len(t) + 1))
        reach[w] = max(far, reach.get(w, 0))
    return max(reach.values(), default=0)


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, text: str) -> None:
        file, names = json.loads(text), _byte_names()
        as_bytes = lambda token: bytes(names[c] for c in token)
        vocab = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = as_bytes(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [vocab.get(c, -1) for c, _ in sorted(names.items(), key=lambda x: x[1])]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in file["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        #: Pairs of tokens as sorted numbers, and the rank and token of each.
        codes = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self._codes, self._ranks = codes[order], np.array([*self.merges.values()], np.int64)[order]
        self.longest = max(len(self.bytes[i]) for i in vocab.values())
        self.lookahead = sufficient_lookahead([(as_bytes(a), as_bytes(b)) for a, b in pairs])
        self.text = [self._whole(x) for x in self.bytes]
        self.decimals = [*map(str, range(len(self.bytes)))]
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pattern = regex.compile(PATTERN)

    @staticmethod
    def _whole(data: bytes) -> str | None:
        """A token's text if its bytes are whole characters."""
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a byte string: the pair of least rank, the leftmost first, until none is left."""
        if len(data) > SHORT:
            return self._merge_long(data)
        ids, get = [self.single[b] for b in data], self.merges.get
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            at = ranks.index(best)
            ids[at] = new = best & 0xFFFFFFFF
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], new), _NEVER)
            if at < len(ranks):
                ranks[at] = get((new, ids[at + 1]), _NEVER)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        """The same by a heap of (rank and token, place); places of merged tokens are skipped."""
        ids, get = [self.single[b] for b in data], self.merges.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(get(p, _NEVER) for p in zip(ids, ids[1:])) if r != _NEVER]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], _NEVER)

    def merge_many(self, data: bytes, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many byte strings that stand in a row, and their number in each: one merge of each string a round."""
        ids, left = np.array(self.single, np.int64)[np.frombuffer(data, np.uint8)], n.copy()
        out, count = [], np.zeros(len(n), np.int64)
        rank = np.full(len(ids), _NEVER)
        if len(ids):
            rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[np.cumsum(n)[n > 0] - 1] = _NEVER
        own = np.flatnonzero(n)
        left = left[own]
        while len(own):
            starts = np.cumsum(left) - left
            least = np.minimum.reduceat(rank, starts)
            done = least == _NEVER
            if done.any():
                rows = np.repeat(done, left)
                count[own[done]] = left[done]
                out.append((own[done], ids[rows]))
                ids, rank, own, left, least = ids[~rows], rank[~rows], own[~done], left[~done], least[~done]
                if not len(own):
                    break
                starts = np.cumsum(left) - left
            where = np.flatnonzero(rank == np.repeat(least, left))
            string = np.searchsorted(starts, where, "right") - 1
            at = where[np.concatenate(([True], string[1:] != string[:-1]))]
            ids[at] = least & 0xFFFFFFFF
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            last = at + 1 - starts == left - 1
            new = at - np.arange(len(at))  # one place before each is gone
            ids, rank, left = ids[stay], rank[stay], left - 1
            starts = np.cumsum(left) - left
            rank[new] = np.where(last, _NEVER, self._rank(ids[new], ids[np.minimum(new + 1, len(ids) - 1)]))
            inner = new[new > starts]
            rank[inner - 1] = self._rank(ids[inner - 1], ids[inner])
        # Strings came out by their number of rounds: put them back in order.
        ends = np.cumsum(count)
        found = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for strings, tokens in out:
            k = count[strings]
            found[np.repeat(ends[strings] - np.cumsum(k), k) + np.arange(len(tokens))] = tokens
        return found, count

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces of texts in one array, and the place and number of each one's.

        They are cut into pre-tokens as lines of one string. Pre-tokens end within a window here, so each is merged at its end; long ones stream.
        """
        if len(texts) < 2 or any("\n" in t[1:] for t in texts) or self._special and self._special.search("\n".join(texts)):
            found = [self.encode(t) for t in texts]
            n = np.array([*map(len, found)], np.int64)
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum(n) - n, n
        tokens = self._pattern.findall("\n" + "\n".join([t.removeprefix("\n") for t in texts]))
        data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.fromiter(map(len, data), np.int64, len(data))
        long = {k: self.encode(tokens[k]) for k in np.flatnonzero(size > MANY).tolist()}
        for k in long:
            data[k], size[k] = b"", 0
        ids, n = self.merge_many(b"".join(data), size)
        if long:
            parts, at = [], np.cumsum(n) - n
            for k in sorted(long):
                parts += [(int(at[k]), long[k])]
                n[k] = len(long[k])
            ids = np.insert(ids, np.repeat([a for a, _ in parts], [len(x) for _, x in parts]), [i for _, x in parts for i in x])
        lines = np.flatnonzero(np.fromiter((t == "\n" for t in tokens), bool, len(tokens)))
        ends = np.cumsum(n)
        led = np.fromiter((t.startswith("\n") for t in texts), np.int64, len(texts))
        start = ends[lines] - n[lines] * led
        stop = np.append(ends[lines[1:]] - n[lines[1:]], ends[-1])
        return ids, start, stop - start

    def stream(self, text: str, step: int = LONG) -> Iterator[list[int]]:
        """Ids of a whole text, as they become stable."""
        at, run = 0, Transducer(self)
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            stop = m.start() if m else len(text)
            for token in self._pattern.finditer(text, at, stop) if at < stop else ():
                a, b = token.span()
                for i in range(a, b, step):
                    yield from run.feed(text[i : min(b, i + step)].encode("utf-8", "surrogatepass"))
                yield run.end()
            if m:
                yield [self.special[m[0]]]
                at = m.end()

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for ids in self.stream(text) for i in ids]


class Transducer:
    """Bytes of one pre-token after the other to ids. It holds less than a window of bytes between two calls."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.held = vocabulary, b""
        self.window = 2 * vocabulary.lookahead + vocabulary.longest

    def feed(self, data: bytes) -> Iterator[list[int]]:
        """More bytes of the open pre-token: the ids that are stable by now."""
        at, room = 0, self.window
        while len(self.held) + len(data) - at >= room:
            need = room - len(self.held)
            self.held, at = self.held + data[at : at + need], at + need
            ids, end = self.vocabulary.merge(self.held), 0
            for n, i in enumerate(ids):
                if end + len(self.vocabulary.bytes[i]) > room - self.vocabulary.lookahead:
                    break
                end += len(self.vocabulary.bytes[i])
            self.held = self.held[end:]
            yield ids[:n]
        self.held += data[at:]

    def end(self) -> list[int]:
        """The pre-token ends: the rest is stable."""
        ids, self.held = self.vocabulary.merge(self.held), b""
        return ids


class ByteToText:
    """Incremental byte-to-text state machine: its state is the bytes of one unfinished character."""

    #: First bytes of characters (from, to), the bytes that follow, and the range of the first of these.
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    @lru_cache(maxsize=1 << 16)
    def step(held: bytes, data: bytes) -> tuple[str, bytes]:
        """Text and next state of a state and some bytes."""
        out = []
        for b in data:
            if held:
                follow, low, high = next(x[2:] for x in ByteToText.LEADS if x[0] <= held[0] <= x[1])
                if (low <= b <= high) if len(held) == 1 else 0x80 <= b <= 0xBF:
                    held += bytes([b])
                    if len(held) > follow:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if b < 0x80:
                out.append(chr(b))
            elif any(x[0] <= b <= x[1] for x in ByteToText.LEADS):
                held = bytes([b])
            else:
                out.append("�")
        return "".join(out), held

    def feed(self, data: bytes) -> str:
        text, self.held = self.step(self.held, data)
        return text

    def end(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""


def texts_of(vocabulary: Vocabulary, stretches: Iterator[np.ndarray]) -> Iterator[str]:
    """The text of stretches of ids. Tokens of whole characters keep the machine in its first state."""
    machine, texts, tokens = ByteToText(), vocabulary.text, vocabulary.bytes
    for ids in stretches:
        some = ids.tolist()
        parts = [texts[t] for t in some]
        if machine.held or None in parts:
            parts = [parts[k] if not machine.held and parts[k] is not None else machine.feed(tokens[t]) for k, t in enumerate(some)]
        yield "".join(parts)
    yield machine.end()


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> Iterator[str]:
    """The text of ids, a stretch at a time."""
    return texts_of(vocabulary, (ids[i : i + STEP] for i in range(0, len(ids), STEP)))


_loaded: dict[str, tuple[Vocabulary, PieceTable]] = {}


def _worker(text: str) -> tuple[Vocabulary, PieceTable]:
    """One vocabulary and table a worker process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        vocabulary = Vocabulary(text)
        _loaded[key] = vocabulary, PieceTable(vocabulary.encode_many, size=PIECES)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _digests(vocabulary: Vocabulary, stretches: Iterator[np.ndarray]) -> tuple[int, str, str]:
    """Number of ids, digest of their decimals and digest of their text, from stretches of ids."""
    n, written, decoded, decimals = 0, hashlib.sha256(), hashlib.sha256(), vocabulary.decimals

    def passed():
        nonlocal n
        for ids in stretches:
            if len(ids):
                written.update((("," if n else "") + ",".join([decimals[t] for t in ids.tolist()])).encode())
                n += len(ids)
                yield ids

    for text in texts_of(vocabulary, passed()):
        decoded.update(text.encode())
    return n, written.hexdigest(), decoded.hexdigest()


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (unless left out), ids_sha256, decoded_sha256 of every row.

    The vocabulary file is read on the driver and broadcast: its size does not depend on the data.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))
    source = id_and_text(docs, id_col, text_col)
    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), *[pa.list_(pa.int32())] * with_ids, pa.string(), pa.string()]

    def rows(vocabulary: Vocabulary, pieces: PieceTable, texts: list[str]):
        if len(texts) == 1 and len(texts[0]) > LONG:
            kept: list[np.ndarray] = []

            def stretches():
                for ids in vocabulary.stream(texts[0]):
                    ids = np.array(ids, np.int32)
                    kept.extend([ids] * with_ids)
                    yield ids

            n, *digests = _digests(vocabulary, stretches())
            yield n, *[np.concatenate(kept or [np.zeros(0, np.int32)])] * with_ids, *digests
            return
        ids, n = pieces.ids_of(texts)
        for own in np.split(ids.astype(np.int32), np.cumsum(n)[:-1]):
            count, *digests = _digests(vocabulary, (own[i : i + STEP] for i in range(0, len(own), STEP)))
            yield count, *[own] * with_ids, *digests

    def run(batches):
        vocabulary, pieces = _worker(file.value)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size <= GROUP and len(texts[to]) <= LONG:
                    to, size = to + 1, size + len(texts[to])
                columns = zip(*rows(vocabulary, pieces, texts[at:to]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *(pa.array(c, kind) for c, kind in zip(columns, types))], names)
                at = to

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_and_decode(table(spark, sf_dir, "documents"), path, with_ids=False)
