"""Operator 6, byte-level BPE: a segment tree over byte positions whose nodes hold the leftmost minimum pair rank.

A leaf holds the rank of the pair that starts at its position, times the width, plus the position; the minimum of two
such numbers is the lower rank, and the leftmost of equal ranks. A merge reads the root and updates the leaves of the
merged pair, of its dead right half and of its live left neighbour, with the nodes above them. Pieces of up to 64 bytes
are merged many at a time in numpy (one tree a row); longer ones one by one with the same tree.

Defined results: null and empty texts give no ids; any text decodes to its own UTF-8 bytes; repeated rows and ties give
equal ids; long texts and single pieces of any length are encoded whole (memory grows with one text, not with the
table); an empty table gives an empty result; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewake.llm.common import map_texts, text_or_empty

BIG = np.int32(1 << 30)
#: Chunks remembered by a worker; beyond it only those of the current slice stay. Longer ones are forgotten after their slice.
MEMO_CHUNKS, MEMO_LENGTH = 300_000, 200
#: White space as the tokenizers have it: Python's, without the four separators U+001C to U+001F.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: White space with the letters after it, or with all other characters after it. No match of the pattern crosses from
#: other characters into white space or from a letter to what is not one, and none looks further than one character,
#: so chunks can be encoded apart.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
#: What may be a letter or digit in some Unicode version, so that no chunk ends before it: all but older punctuation.
MAYBE_WORD = r"[\w\u02b0-\u1fff\u2070-\U0010ffff]"
CHUNK = re.compile(f"{SPACE}*[{LETTERS}]+(?!{MAYBE_WORD})|{SPACE}*{OTHER}+|{SPACE}+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def newer_than_library() -> str:
    """Ranges of what the regex module takes for a letter or digit and the tiktoken library, whose Unicode is older, does not.

    Asked of the library: with tokens of a letter or digit and a first byte, it joins the two if one match holds both.
    Only characters that Python's own, older Unicode does not know are in doubt."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {bytes([a, b]): 256 + 64 * k + b - 0xC0 for k, a in enumerate(b"a1") for b in range(0xC0, 0x100)}
    library = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
    everything = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    ranges: list[list[int]] = []
    for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
        for c in regex.findall(kind, everything):
            if unicodedata.category(c) == "Cn" and library.encode_ordinary(lead + c)[0] < 256:
                if ranges and ranges[-1][1] == ord(c) - 1:
                    ranges[-1][1] += 1
                else:
                    ranges.append([ord(c), ord(c)])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)


def as_library(pattern: str) -> regex.Pattern:
    """The pattern with letters and digits as the library has them."""
    if newer := newer_than_library():
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
    return regex.compile(pattern, regex.V1)


class SegmentTreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, as_library(pattern)
        token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            token[i] = t
        self.bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.size = np.fromiter(map(len, token), dtype=np.int32, count=len(token))
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.first = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.first_pair = np.full(65536, BIG, dtype=np.int32)
        pairs = []
        for t, r in ranks.items():
            if len(t) == 2:
                self.first_pair[t[0] << 8 | t[1]] = r
            pairs += [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pair_key, self.pair_rank = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int32)
        self.memo: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; BIG where there is none or an id is negative."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], BIG)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of 1 to width bytes; width is a power of two."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        step = width + 1
        ids = np.full(n * step, -1, dtype=np.int32)  # a row's last column is past the end
        ids[row * step + column] = self.first[raw]
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width, dtype=np.int32), n)
        tree = np.full((n, 2 * width), BIG, dtype=np.int32)
        ranks = self.first_pair[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ok = (row[1:] == row[:-1]) & (ranks < BIG)
        tree[row[:-1][ok], width + column[:-1][ok]] = ranks[ok] * width + column[:-1][ok]
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree, wide = tree.ravel(), 2 * width
        live = np.flatnonzero(tree[1::wide] < BIG)
        while len(live):
            top, cell = live * wide, live * step
            best = tree[top + 1]
            at, new = best % width, best // width
            gone = after[cell + at]
            then = after[cell + gone]
            ids[cell + at] = new
            ids[cell + gone] = -1
            after[cell + at] = then
            before[cell + np.minimum(then, width)] = at
            tree[top + width + gone] = BIG
            r = self.rank(new, ids[cell + np.minimum(then, width)])
            tree[top + width + at] = np.where(r < BIG, r * width + at, BIG)
            left = before[cell + at]
            has = left >= 0
            l_top, l_at = top[has], left[has]
            r = self.rank(ids[cell[has] + l_at], new[has])
            tree[l_top + width + l_at] = np.where(r < BIG, r * width + l_at, BIG)
            for base, places in ((top, at), (top, gone), (l_top, l_at)):
                node = (width + places) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                    node = node >> 1
            live = live[tree[top + 1] < BIG]
        kept = ids >= 0
        packed = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.reshape(n, step).sum(axis=1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same tree for one piece of any length."""
        ranks, n = self.ranks, len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        big = len(self.size) * width  # above every rank * width + position
        tree = [big] * (2 * width)
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k //= 2
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k //= 2

        def start(i: int) -> None:
            j = after[i]
            r = ranks.get(parts[i] + parts[j]) if j < n else None
            put(i, big if r is None else r * width + i)

        while tree[1] < big:
            i = tree[1] % width
            j = after[i]
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, big)
            start(i)
            if before[i] >= 0:
                start(before[i])
        return np.array([ranks[p] for p in parts if p is not None], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {8: [], 16: [], 32: [], 64: []}
        get = self.ranks.get
        for i, p in enumerate(pieces):
            if (r := get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif (n := len(p)) <= 16:
                by_width[8 if n <= 8 else 16].append(i)
            elif n <= 64:
                by_width[32 if n <= 32 else 64].append(i)
            else:
                out[i] = self.merge_long(p)
        for width, own in by_width.items():
            for k in range(0, len(own), 2048):
                for i, ids in zip(own[k : k + 2048], self.merge_many([pieces[i] for i in own[k : k + 2048]], width)):
                    out[i] = ids
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the chunks that are not yet remembered into the memo."""
        new = chunks.difference(self.memo)
        if not new:
            return
        if len(self.memo) + len(new) > MEMO_CHUNKS:
            self.memo = {k: self.memo[k] for k in chunks if k in self.memo}
        one = [c for c in new if c.isalpha() or c[0] == " " and c[1:].isalpha()]  # a single match each
        self.memo.update(zip(one, self.encode_pieces([c.encode() for c in one])))
        if len(one) < len(new):
            split = {c: self.pattern.findall(c) for c in new.difference(one)}
            pieces = list({p for own in split.values() for p in own})
            ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
            for c, own in split.items():
                self.memo[c] = b"".join([ids[p] for p in own])

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        chunks = [CHUNK.findall(t) for t in texts]
        every = set().union(*chunks)
        self.learn(every)
        out = [b"".join(map(self.memo.__getitem__, own)) for own in chunks]
        for c in [c for c in every if len(c) > MEMO_LENGTH]:
            del self.memo[c]
        return out

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            size = self.size[part]
            ends = np.cumsum(size, dtype=np.int64)
            place = np.repeat(self.start[part] - (ends - size), size) + np.arange(ends[-1])
            out.append(self.bytes[place].tobytes())
        return b"".join(out)


_loaded: dict[str, SegmentTreeBPE] = {}


def load(path: str | None) -> SegmentTreeBPE:
    """The coder of this worker process; path None is the multi-language file of the public tokenizers."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _loaded:
        _loaded[path] = SegmentTreeBPE(read_ranks(path), public_tokenizers.PATTERN)
    return _loaded[path]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", rank_path: str | None = None) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, as the ids and the decoded bytes of the whole text give them."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        coder, sha = load(rank_path), hashlib.sha256

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = coder.encode_texts(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([sha(p).hexdigest() for p in packed], pa.string()),
                    pa.array([sha(coder.decode(p)).hexdigest() for p in packed], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return map_texts(df.select(key, text_or_empty(text).alias("text")), "text", f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
