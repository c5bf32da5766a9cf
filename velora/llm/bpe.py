"""Operator 2: byte-level BPE encoding and decoding with a given, public vocabulary file.

Each piece of the pre-tokenisation is merged with a priority queue of (rank, place) over a doubly
linked list of symbols; entries made stale by a merge are skipped when they come up. Decoding
concatenates the vocabulary's strings. Pieces recur, so results are kept per piece in bounded
dictionaries, which change the speed and never the result. A long text is handled a section at a time.

Cases: a null text counts as empty: no tokens, empty decoded text. Texts are encoded whole.
Rows repeat as they come. Extra columns pass through `encode`'s input untouched and are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.staging import small_batches
from velora.llm.words import tidy

#: The white space of Unicode.
SPACE = "\t-\r \x85\xa0  -     　"
#: The public pattern that parts text into pieces.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Runs whose pieces don't depend on their neighbours: what lies between white space, with one space before it, or white space.
RUNS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Of runs and of pieces: how many that came once, and that came again (in each of two generations), are kept; about 150 MB in a worker.
KEPT = (300_000, 200_000), (150_000, 100_000)
#: The same for a worker that has to share its memory with other stages: a third of that, and a fifth more time.
FEW_KEPT = (80_000, 80_000), (50_000, 50_000)
Kept = tuple[tuple[int, int], tuple[int, int]] | None
#: The longest run or piece that is kept.
LONGEST = 64
#: Bytes of a piece from which on it is merged in typed arrays, some 20 bytes a byte instead of 115.
LONG_PIECE = 4096
#: Characters after which a section of a text ends at the next end of a run.
SECTION = 1 << 18
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def printable_bytes() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Recent:
    """A bounded dictionary. What comes once goes when the young part is full; what comes again moves to a part kept in two generations, of which the
    older goes, but for what was used meanwhile, when the newer is full."""

    def __init__(self, young: int, kept: int):
        self.most_young, self.most_kept = young, kept
        self.young, self.new, self.old = {}, {}, {}

    def get(self, key: str):
        got = self.new.get(key)
        if got is None:
            if (got := self.old.get(key)) is None and (got := self.young.pop(key, None)) is None:
                return None
            if len(self.new) >= self.most_kept:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.most_young:
            self.young = {}
        self.young[key] = value


class Codec:
    """A vocabulary with its merges, by the path of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = printable_bytes()
        to_byte = {c: b for b, c in letters.items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.vocab: dict[bytes, int] = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: s for s, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.names = {i: str(i) for i in self.strings}
        self.width = max(self.strings) + 1
        #: rank by left * width + right; by rank: the two symbols and what they make
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for pair in spec["model"]["merges"]:
            a, b = (raw(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks.setdefault(self.vocab[a] * self.width + self.vocab[b], len(self.merges))
            self.merges.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        pairs = ((a, b) for a in self.single for b in self.single)
        self.byte_ranks = [self.ranks.get(a * self.width + b) for a, b in pairs]  # by first byte * 256 + second
        self.runs, self.pieces = re.compile(RUNS), regex.compile(PIECES)
        self.edge = re.compile(f"[^{SPACE}](?=[{SPACE}])")
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self, kept: Kept = None) -> None:
        """Give back what the dictionaries hold: a worker lives on after its task, for tasks that need the memory. kept: how much they may hold from now on."""
        runs, pieces = kept or KEPT
        self._runs, self._pieces = Recent(*runs), Recent(*pieces)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The queue holds rank and place in one integer, rank first; equal ranks come by place."""
        if len(piece) >= LONG_PIECE:
            return self._merge_long(piece)
        n, first, rank, merges, width = len(piece), self.byte_ranks, self.ranks.get, self.merges, self.width
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = [r << shift | i for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := first[a << 8 | b]) is not None]
        ids = [self.single[b] for b in piece]
        if not queue:
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & mask
            a, b, made = merges[top >> shift]
            j = right[i]
            if ids[i] != a or j == n or ids[j] != b:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(made * width + ids[k])) is not None:
                    heapq.heappush(queue, r << shift | i)
            if (h := left[i]) >= 0 and (r := rank(ids[h] * width + made)) is not None:
                heapq.heappush(queue, r << shift | h)
        return [x for x in ids if x >= 0]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges in typed arrays: the queue holds each rank once, with the places that wait under it, in order when the rank comes up."""
        n, rank, merges, width = len(piece), self.ranks.get, self.merges, self.width
        data = np.frombuffer(piece, np.uint8)
        table = np.array([-1 if r is None else r for r in self.byte_ranks], np.int32)
        start = table[data[:-1].astype(np.int32) << 8 | data[1:]]
        places = np.flatnonzero(start >= 0).astype(np.int32)
        places = places[np.argsort(start[places], kind="stable")]
        own = start[places]
        del start
        lo = np.flatnonzero(np.diff(own, prepend=-1))
        waiting = {r: array("i", part.tobytes()) for r, part in zip(own[lo].tolist(), np.split(places, lo[1:]))} if len(own) else {}
        del own, places
        ids = array("i", np.array(self.single, np.int32)[data].tobytes())
        left, right = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        queue = list(waiting)
        heapq.heapify(queue)

        def wait(r: int, place: int) -> None:
            if (there := waiting.get(r)) is None:
                waiting[r] = array("i", (place,))
                heapq.heappush(queue, r)
            else:
                there.append(place)

        while queue:
            now = heapq.heappop(queue)
            todo = waiting.pop(now)
            if len(todo) > 1:
                todo = array("i", np.sort(np.frombuffer(todo, np.int32)).tobytes())
            a, b, made = merges[now]
            for at, i in enumerate(todo):
                j = right[i]
                if ids[i] != a or j == n or ids[j] != b:
                    continue  # stale: one of the two has been merged since
                ids[i], ids[j] = made, -1
                right[i] = k = right[j]
                if k < n:
                    left[k] = i
                    if (r := rank(made * width + ids[k])) is not None:
                        wait(r, i)
                if (h := left[i]) >= 0 and (r := rank(ids[h] * width + made)) is not None:
                    wait(r, h)
                if queue and queue[0] < now:  # what the merge made comes before the rest of this rank
                    for place in todo[at + 1 :]:
                        wait(now, place)
                    break
        done = np.frombuffer(ids, np.int32)
        return done[done >= 0].tolist()

    def run_ids(self, run: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pieces.findall(run):
            if (ids := self._pieces.get(piece)) is None:
                ids = self.merge(piece.encode())
                if len(piece) <= LONGEST:
                    self._pieces.put(piece, ids)
            out += ids
        return tuple(out)

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special tokens, a section after another; sections end where a run does."""
        known, lo = self._runs, 0
        while lo < len(text):
            end = self.edge.search(text, lo + SECTION) if len(text) - lo > SECTION else None
            hi = end.end() if end else len(text)
            ids: list[int] = []
            for run in self.runs.findall(text, lo, hi):
                if (got := known.new.get(run)) is None and (got := known.get(run)) is None:
                    got = self.run_ids(run)
                    if len(run) <= LONGEST:
                        known.put(run, got)
                ids += got
            yield ids
            lo = hi

    def sections(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a section after another, so that a long text's working set stays small."""
        if self.apart is None or not any(s in text for s in self.special):
            yield from self._plain(text)
            return
        for k, part in enumerate(self.apart.split(text)):
            if k % 2:
                yield [self.special[part]]
            else:
                yield from self._plain(part)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.sections(text) for i in ids]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.strings[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.joined(ids).decode("utf-8", "replace")

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the text that they decode to."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.sections(text):
            if ids:
                of_ids.update(((("," if n else "") + ",".join([self.names[i] for i in ids]))).encode())
                of_text.update(self.decode(ids).encode())  # a section's ids make whole characters
                n += len(ids)
        return n, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All ids of each text: (id_col, ids array<int>)."""

    def run(batches):
        c = codec(tokenizer)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each list of ids; null ids count as none: (id_col, text)."""

    def run(batches):
        c = codec(tokenizer)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, tokenizer: str, kept: Kept = None) -> DataFrame:
    """Encode every text, decode it again, and return the count and digests of both, in one pass without a shuffle. kept: sizes of the dictionaries."""

    def run(batches):
        c = codec(tokenizer)
        c.forget(kept)
        for b in batches:
            made = [c.round_trip(text.as_py() or "") for text in b.column(1)]
            counts, ids, texts = zip(*made) if made else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)
