"""Byte-level BPE over published rank files: encoding and decoding.

A pre-token is merged with a rank queue: every rank that a neighbouring pair of
parts has owns a bucket of linked-list positions; a two-level bitmap over the
ranks gives, by find-first-set, the lowest rank that is not empty. A position
whose pair has changed since it was queued is stale and skipped. A pre-token of
n bytes thus takes O(n) queue operations, whatever its length.

Texts are cut into runs that no pattern match crosses (white space before a
word excepted), and the ids of runs already seen are kept in a table of bounded
size, so the queue works on distinct runs.

Defined results: a null text is the empty text and has no ids; repeated rows
give equal values; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.runtime import keep_only, prepare, trim

#: Runs of a generation of the table; when one is full the one before it goes.
CACHED_RUNS = 200_000
CACHED_CHARS = 64
#: The published pattern of pre-tokens. Runs are cut for it alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by the Unicode property, as in the pattern's own \s.
_WS = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+?(?= ?[^{_WS}])")


class RankQueue:
    """Positions by rank, the lowest rank first.

    ``words`` has the bits of 64 ranks each and ``summary`` one bit for each
    word that is not zero; two find-first-set steps give the lowest rank.
    """

    __slots__ = ("buckets", "words", "summary")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.summary = 0

    def push(self, rank: int, positions: list[int]) -> None:
        b = self.buckets.get(rank)
        if b is None:
            self.buckets[rank] = positions
            w = rank >> 6
            self.words[w] = self.words.get(w, 0) | 1 << (rank & 63)
            self.summary |= 1 << w
        else:
            b += positions

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right."""
        w = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[w]
        rank = w << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.words[w] = bits
        if not bits:
            self.summary &= self.summary - 1
        b = self.buckets.pop(rank)
        b.sort()
        return rank, b


class Merges:
    """The ranks of pairs of ids: each way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)])
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All go through one queue; their linked
        lists are apart, so each is merged as it would be alone."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        starts = np.concatenate([[0], ends[:-1]])
        nxt[ends - 1], prv[starts] = -1, -1
        first = np.full(n, -1, np.int64)
        if n > 1:
            first[:-1] = self.byte_pairs[data[:-1], data[1:]]
        first[ends - 1] = -1
        q = RankQueue()
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        values, begin = np.unique(first[at], return_index=True)
        at, begin = at.tolist(), [*begin.tolist(), len(at)]
        for i, r in enumerate(values.tolist()):
            q.push(r, at[begin[i] : begin[i + 1]])
        #: The rank under which the pair that starts at a part is queued, or -1.
        queued, ids = first.tolist(), self.byte_ids[data].tolist()
        nxt, prv = nxt.tolist(), prv.tolist()
        get, push = self.pairs.get, q.push
        while q.summary:
            rank, bucket = q.pop()
            for done, i in enumerate(bucket, 1):
                if queued[i] != rank:
                    continue  # stale
                j = nxt[i]
                k = nxt[j]
                ids[i], nxt[i], queued[j] = rank, k, -1
                low = rank + 1
                if k >= 0:
                    prv[k] = i
                    r = get(rank << 20 | ids[k], -1)
                    if r >= 0:
                        push(r, [i])
                        low = r
                    queued[i] = r
                else:
                    queued[i] = -1
                h = prv[i]
                if h >= 0:
                    r = get(ids[h] << 20 | rank, -1)
                    if r >= 0 and r != queued[h]:
                        push(r, [h])
                    if 0 <= r < low:
                        low = r
                    queued[h] = r
                if low <= rank and done < len(bucket):  # a pair that comes before the rest
                    push(rank, bucket[done:])
                    break
        out = []
        for i in starts.tolist():
            part = []
            while i >= 0:
                part.append(ids[i])
                i = nxt[i]
            out.append(part)
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.merges = Merges(ranks)
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs that aren't in the table."""
        get = self.ranks.get
        cut, todo = [], {}
        for run in runs:
            pieces = [p.encode("utf-8") for p in self.pieces(run)]
            cut.append(pieces)
            for p in pieces:
                if get(p) is None:
                    todo[p] = None
        done = dict(zip(todo, self.merges.merge(list(todo)))) if todo else {}
        out = {}
        for run, pieces in zip(runs, cut):
            ids = array("I")
            for p in pieces:
                whole = get(p)
                if whole is None:
                    ids.extend(done[p])
                else:
                    ids.append(whole)
            out[run] = ids.tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [_RUNS.findall(t) for t in texts]
        known, older = self.runs, self.older
        missing = {r for rs in split for r in rs if r not in known}
        known |= {r: older[r] for r in missing if r in older}
        new = self._learn([r for r in missing if r not in known])
        known |= new
        look = known.__getitem__
        out = [b"".join(map(look, rs)) for rs in split]
        for k in new:
            if len(k) > CACHED_CHARS:
                del known[k]
        if len(known) > CACHED_RUNS:
            self.runs, self.older = {}, known
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    out = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def _codec(path: str, pattern: str) -> Codec:
    """The codec that a worker keeps from task to task."""

    def make() -> Codec:
        with open(path, "rb") as f:
            return Codec(read_ranks(f.read()), pattern)

    return keep_only(("byte_bpe", path, pattern), make)


def encode_decode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """DataFrame[key, n_tokens long, ids_sha256 string, decoded_sha256 string],
    and the ids and the decoded text's bytes if ``with_ids`` is set.

    ``rank_file`` is the path of the tokenizer's ranks on every worker; ``pattern``
    must be the published one.
    """
    if pattern != PATTERN:
        raise ValueError("texts are cut into runs for the published pattern only")
    kind = dict(df.dtypes)[key]

    def run(batches):
        codec = _codec(rank_file, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for ids in codec.encode([t or "" for t in part.column(1).to_pylist()]):
                    back = codec.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) + ((ids, back) if with_ids else ()))
                types = [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * 2 * with_ids
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=names)
        trim()

    prepare(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids)
