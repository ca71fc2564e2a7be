"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are linked lists of tokens. Every pair of neighbours whose bytes together are a
token waits in the bucket of that token's rank. A bitmap of several levels marks the
buckets in use: find-first-set from the top gives the lowest rank, whose pairs merge from the left;
an entry whose pair has changed meanwhile is stale and skipped. A merge costs
two look-ups and at most two new entries whatever the length of the pre-token, so very long ones
take time in proportion to their length, and many short ones can share one queue. A bucket of many pairs
is merged on whole arrays, unless that brings up a lower rank.

Spark reads and splits the documents; each is encoded and decoded whole in its task, which keeps
bounded tables of the ids of recent pieces of text and pre-tokens. There is no shuffle.

Defined cases: a null text is an empty one, with no ids; repeated rows each get their result;
an empty table gives an empty result; a vocabulary lacking a single byte is refused.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tables of recent pieces and pre-tokens hold up to this many each, and none of more bytes of ids.
RECENT = 250_000
RECENT_BYTES = 128
# Short pre-tokens share a queue, and short texts a round, up to this many characters.
SHARED_CHARS = 1 << 20
TEXTS_CHARS = 1 << 21
# A bucket of so many pairs is merged on whole arrays.
MANY = 32

_BLANK_AFTER_SPACE = re.compile(r"\s ").search


class RankQueue:
    """Positions waiting by rank. Words of 64 bits: a set bit stands for a used bucket, or a word that is not 0."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)

    def put(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        for level in self.levels:
            word = rank >> 6
            was = level[word]
            level[word] = was | 1 << (rank & 63)
            if was:
                return
            rank = word

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use and its positions; the bucket is emptied."""
        word = 0
        for level in reversed(self.levels):
            bits = level[word]
            if not bits:
                return None
            word = word << 6 | (bits & -bits).bit_length() - 1
        rank = at = word
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        positions, self.buckets[rank] = self.buckets[rank], None
        return rank, positions


class Links:
    """The tokens of many pre-tokens as linked lists. What has no neighbour is linked to the last place, which no token joins with.

    ``ranks`` has the rank that waits at each position; another one in a bucket is stale.
    """

    def __init__(self, coder: Bpe, raw: np.ndarray, ends: np.ndarray):
        self.coder, n = coder, len(raw)
        self.ids = np.append(coder.of_byte[raw], np.int32(coder.size))
        self.following = np.arange(1, n + 2, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        self.ranks = np.full(n + 1, -1, dtype=np.int32)
        if n > 1:
            self.ranks[: n - 1] = coder.of_bytes[raw[:-1], raw[1:]]
        last = ends[ends > 0] - 1
        self.ranks[last] = -1
        self.following[last] = n
        self.before[last + 1] = n
        if n:
            self.before[0] = n
        # Rank of the popped token's pair with each token, while that bucket is merged.
        self.with_right = np.full(coder.size + 1, -1, dtype=np.int32)
        self.with_left = self.with_right.copy()

    def merge_each(self, queue: RankQueue, rank: int, positions: list[int]) -> None:
        """Merge the pairs of a bucket from the left, up to one that gives a pair of a lower rank."""
        ids, following, before, ranks = (memoryview(a) for a in (self.ids, self.following, self.before, self.ranks))
        pairs, buckets, put = self.coder.pairs, queue.buckets, queue.put
        with_left = pairs[rank].get
        for done, at in enumerate(positions, 1):
            if ranks[at] != rank:
                continue
            right = following[at]
            after = following[right]
            ids[at], ids[right], ranks[right] = rank, -1, -1
            following[at] = after
            before[after] = at
            lower = False
            left = before[at]
            for place, joined in ((at, with_left(ids[after], -1)), (left, pairs[ids[left]].get(rank, -1))):
                ranks[place] = joined
                if joined >= 0:
                    if (bucket := buckets[joined]) is None:
                        put(joined, [place])
                    else:
                        bucket.append(place)
                    lower = lower or joined < rank
            if lower:  # that rank comes first
                if done < len(positions):
                    rest = positions[done:]
                    put(rank, rest if buckets[rank] is None else buckets[rank] + rest)
                break

    def merge_many(self, queue: RankQueue, rank: int, positions: list[int]) -> bool:
        """The same on whole arrays; False, with nothing done, if a pair of a lower rank would come up."""
        ids, following, before, ranks = self.ids, self.following, self.before, self.ranks
        at = np.array(positions)
        at = at[ranks[at] == rank]
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        if not len(at):
            return True
        # Of pairs that overlap, every other one from the left.
        overlaps = following[at[:-1]] == at[1:]
        if overlaps.any():
            places = np.arange(len(at))
            starts = np.maximum.accumulate(np.where(np.append(False, overlaps), 0, places))
            at = at[(places - starts) % 2 == 0]
        right = following[at]
        after, left = following[right], before[at]
        (rights, their), (lefts, its) = self.coder.followers(rank), self.coder.leaders(rank)
        with_right, with_left = self.with_right, self.with_left
        with_right[rights], with_left[lefts] = their, its
        try:
            joined, joined_left = with_right[ids[after]], with_left[ids[left]]
            # As unsigned numbers, no rank is the highest one.
            least = min(joined.view(np.uint32).min(), joined_left.view(np.uint32).min(), with_right[rank : rank + 1].view(np.uint32)[0])
            if least < rank:
                return False
            ids[at], ids[right], ranks[right] = rank, -1, -1
            following[at] = after
            before[after] = at
            # Neighbours may have been merged as well.
            left = before[at]
            joined, joined_left = with_right[ids[after]], with_left[ids[left]]
        finally:
            with_right[rights] = with_left[lefts] = -1
        ranks[at], ranks[left] = joined, joined_left
        buckets, put = queue.buckets, queue.put
        for places, found in ((at, joined), (left, joined_left)):
            waits = found >= 0
            for place, new in zip(places[waits].tolist(), found[waits].tolist()):
                if (bucket := buckets[new]) is None:
                    put(new, [place])
                else:
                    bucket.append(place)
        return True


class Recent:
    """Ids of recent texts in two generations: when the younger is full, the older one goes."""

    def __init__(self):
        self.young: dict[str | tuple[str], bytes] = {}
        self.old: dict[str | tuple[str], bytes] = {}

    def found(self, texts: set) -> dict:
        young, old = self.young.get, self.old.get
        return {t: i for t in texts if (i := young(t) or old(t)) is not None}

    def remember(self, own: dict) -> None:
        if len(self.young) + len(own) > RECENT:
            self.old, self.young = self.young, {}
        if len(own) <= RECENT:
            self.young.update((t, packed) for t, packed in own.items() if len(packed) <= RECENT_BYTES)


def _by_token(token: np.ndarray, other: np.ndarray, rank: np.ndarray, size: int):
    """What gives, for a token, the tokens it makes a pair with and the ranks of these pairs."""
    order = np.argsort(token, kind="stable")
    other, rank = other[order], rank[order]
    bounds = np.searchsorted(token[order], np.arange(size + 1)).tolist()
    return lambda t: (other[bounds[t] : bounds[t + 1]], rank[bounds[t] : bounds[t + 1]])


class Bpe:
    """Encoder and decoder for a rank file: lines of a token in base 64 and its rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        # By left token: right token to the rank of their concatenation.
        self.pairs: list[dict[int, int]] = [{} for _ in range(self.size)]
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left][right] = rank
        self.pairs.append({})  # for the end of a pre-token, which stands for a token that joins with none
        cuts = [(left, right, rank) for left, rights in enumerate(self.pairs) for right, rank in rights.items()]
        left, right, rank = np.array(cuts, dtype=np.int32).reshape(-1, 3).T
        self.followers, self.leaders = _by_token(left, right, rank, self.size), _by_token(right, left, rank, self.size)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        single = self.of_byte.tolist()
        self.of_bytes = np.array([[self.pairs[x].get(y, -1) for y in single] for x in single], dtype=np.int32)
        self.split = regex.compile(pattern).findall
        self.recent_pieces, self.recent_tokens = Recent(), Recent()
        lengths = [len(token) for token in self.tokens]
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; pieces are merged separately."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        links = Links(self, raw, ends)
        queue = RankQueue(self.size)
        waiting = np.flatnonzero(links.ranks >= 0)
        waiting = waiting[np.argsort(links.ranks[waiting], kind="stable")]
        in_use, starts = np.unique(links.ranks[waiting], return_index=True)
        for rank, positions in zip(in_use.tolist(), np.split(waiting, starts[1:])):
            queue.put(rank, positions.tolist())

        while (lowest := queue.pop()) is not None:
            rank, positions = lowest
            positions.sort()
            if len(positions) < MANY or not links.merge_many(queue, rank, positions):
                links.merge_each(queue, rank, positions)

        merged = links.ids[:-1].astype("<i4")
        kept = merged >= 0
        packed = merged[kept].tobytes()
        cuts = [0, *(np.cumsum(kept)[ends - 1] * 4).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def pieces(text: str) -> list:
        """The text cut at every blank that follows something else than white space.

        No alternative of the split pattern goes on past such a place, so the pieces can be
        split into pre-tokens one by one, and frequent pieces only once. A piece stands for
        itself after its blank; the first, which has none, is in a tuple.
        """
        first, *rest = text.split(" ")
        if not _BLANK_AFTER_SPACE(text):
            return [(first,), *rest]
        joined = [[first]]
        for part in rest:
            last = joined[-1][-1][-1:] or " "
            if last.isspace():
                joined[-1].append(" " + part)
            else:
                joined.append([part])
        return [("".join(joined[0]),), *["".join(parts) for parts in joined[1:]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, packed like those of ``merge``."""
        cut = [self.pieces(text) for text in texts]
        recent = self.recent_pieces.young.get
        known = [list(map(recent, pieces)) for pieces in cut]
        missing = {p for pieces, ids in zip(cut, known) if None in ids for p, i in zip(pieces, ids) if i is None}
        own = self.recent_pieces.found(missing)
        self._encode_pieces([p for p in missing if p not in own], own)
        for pieces, found in zip(cut, known):
            if None in found:
                found[:] = [own[p] if i is None else i for p, i in zip(pieces, found)]
        self.recent_pieces.remember(own)
        return [b"".join(found) for found in known]

    def _encode_pieces(self, pieces: list, own: dict) -> None:
        """Adds the ids of pieces to ``own``. Those that end in no white space are split as one text, as they can follow each other."""
        whole = [p[0] if isinstance(p, tuple) else " " + p for p in pieces]
        closed = [isinstance(p, str) and not (p[-1:] or " ").isspace() for p in pieces]
        joint = "".join(compress(whole, closed))
        tokens = self.split(joint)
        if sum(map(len, tokens)) != len(joint):  # the pattern passes over something
            closed, tokens = [False] * len(pieces), []
        apart = [() if joined else self.split(text) for text, joined in zip(whole, closed)]
        ids = self._merged(set(tokens).union(*apart))
        packed = map(ids.__getitem__, tokens)
        lengths = map(len, tokens)
        for piece, text, joined, split in zip(pieces, whole, closed, apart):
            if not joined:
                own[piece] = b"".join([ids[token] for token in split])
                continue
            size, found = next(lengths), next(packed)
            while size < len(text):
                size += next(lengths)
                found += next(packed)
            own[piece] = found

    def _merged(self, tokens: set[str]) -> dict[str, bytes]:
        """Pre-tokens share a queue, up to a size that only a single long one exceeds."""
        ids = self.recent_tokens.found(tokens)
        group: list[str] = []
        held = 0

        def merge_group() -> None:
            if group:
                ids.update(zip(group, self.merge([t.encode() for t in group])))

        for token in tokens - ids.keys():
            group.append(token)
            held += len(token)
            if held >= SHARED_CHARS:
                merge_group()
                group, held = [], 0
        merge_group()
        self.recent_tokens.remember(ids)
        return ids

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = self.starts[ids] - (ends - lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, lengths)
        return self.bytes[at].tobytes()


# One per worker process: building the tables takes longer than most tasks.
_LOADED: dict[tuple[int, str], Bpe] = {}


def loaded(rank_file: bytes, pattern: str) -> Bpe:
    key = hash(rank_file), pattern
    if key not in _LOADED:
        _LOADED[key] = Bpe(rank_file, pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, *keep: str) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit), decoded (the bytes that the ids stand for), the columns in ``keep``.

    ``rank_path`` is read on the driver; the file, of fixed size, goes to the workers.
    """
    with open(rank_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(shipped.value, pattern)
        for batch in batches:
            # Rows are handled in groups of some hundred thousand characters, whatever the batch.
            start, held, texts = 0, 0, []
            for at in range(batch.num_rows):
                texts.append(batch.column(1)[at].as_py() or "")
                held += len(texts[-1])
                if held >= TEXTS_CHARS or at == batch.num_rows - 1:
                    ids = coder.encode(texts)
                    columns = [ids, [coder.decode(packed) for packed in ids]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0)[start : at + 1],
                            *[pa.array(c, pa.binary()) for c in columns],
                            *[kept[start : at + 1] for kept in batch.columns[2:]],
                        ],
                        names=["doc_id", "ids", "decoded", *keep],
                    )
                    start, held, texts = at + 1, 0, []

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "".join(f", {name} {docs.schema[name].dataType.simpleString()}" for name in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(encoded, f"doc_id {kind}, ids binary, decoded binary{kept}")


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents, and the columns in ``keep``."""
    return encoded.select(
        "doc_id",
        *keep,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
