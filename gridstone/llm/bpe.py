"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Texts are cut to pre-tokens as the tokenizer file's byte-level pre-tokenizer
does; each distinct pre-token is encoded once a worker and remembered with its
bytes. In the tree the leaf of a position holds the rank of the pair that
starts there (and the position), an inner node the smaller of its children. The
root thus names the leftmost pair of lowest rank; a merge changes three leaves,
each with logarithmic updates, until no pair can be merged.

Edge cases: a null or empty text has no ids and decodes to ""; equal rows give
equal results; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, free_name, text_rows

U = np.uint64
#: The byte-level pre-tokenizer's pattern, a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Byte pairs of these leading bytes are all letters (but for two signs of the first).
LETTER_LEADS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1)
NEVER = np.int64(1) << np.int64(62)
#: Of a worker's table of pre-tokens: half of its places are used at most, at about 60 bytes each. Table cells that are merged in one step.
TABLE_BITS, CELLS = 20, 1 << 17


def byte_chars() -> dict[int, str]:
    """The format's printable stand-in of each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pieces:
    """Cuts a chunk of texts to pre-tokens; documents beyond the plain scripts go through the pattern."""

    def __init__(self, specials: list[str]):
        self.pattern = regex.compile(PATTERN)
        self.specials = [s.encode() for s in specials]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.kind = np.full(256, 2, np.uint8)  # 0 letter, 1 digit, 2 other, 3 white space
        self.kind[65:91] = self.kind[97:123] = 0
        self.kind[128:] = 0
        self.kind[48:58] = 1
        self.kind[9:14] = self.kind[32] = 3
        self.odd = np.zeros(256, bool)
        self.odd[0xC0:] = True
        self.odd[list(LETTER_LEADS)] = False

    def slow(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bad = self.odd[data]
        after = np.flatnonzero(data == 0xC3) + 1
        bad[after[np.isin(data[after], (0x97, 0xB7))]] = True
        out = K.per_doc(bad, offsets) > 0
        raw = None
        for s in self.specials:
            raw = raw if raw is not None else data.tobytes()
            at = raw.find(s)
            while at >= 0:
                out[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(s, at + 1)
        return out

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The sorted starts of all pre-tokens; each ends where the next starts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[data]
        space, white = data == 32, kind == 3
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = edge[:n].copy()
        change = np.zeros(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        start[1:] |= change[1:] & ~white[1:] & ~space[:-1]
        start |= change & white
        start[:-1] |= white[:-1] & ~white[1:] & ~edge[1:n]
        self.contractions(data, kind, start, edge)
        slow = np.flatnonzero(self.slow(data, offsets))
        for d in slow:
            a, b = offsets[d], offsets[d + 1]
            start[a:b] = False
            start[a + self.by_pattern(data[a:b].tobytes().decode("utf-8", "surrogateescape"))] = True
        return np.flatnonzero(start)

    def contractions(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
        n = len(data)
        at = np.flatnonzero((data == 39) & start)
        at = at[at + 1 < n]
        at = at[~edge[at + 1]]
        one = np.isin(data[at + 1], np.frombuffer(b"stmd", np.uint8))
        third = np.minimum(at + 2, n - 1)
        pair = data[at + 1].astype(np.int64) * 256 + data[third]
        two = (at + 2 < n) & ~edge[np.minimum(at + 2, n)] & np.isin(pair, [x[0] * 256 + x[1] for x in (b"re", b"ve", b"ll")])
        hit = one | two
        at, to = at[hit], (at + np.where(one, 2, 3))[hit]
        start[at + 1] = False
        within = to < n
        to = to[within]
        start[to[(kind[to] == 0) & ~edge[to]]] = True

    def by_pattern(self, text: str) -> np.ndarray:
        parts = [text] if self.special_split is None else self.special_split.split(text)
        pieces = [p for i, part in enumerate(parts) if part for p in ([part] if i % 2 else self.pattern.findall(part))]
        sizes = np.array([len(p.encode("utf-8", "surrogateescape")) for p in pieces], np.int64)
        return np.cumsum(sizes) - sizes


class Memo:
    """Ids of pre-tokens in an open-addressing table of at most 2^bits places, half of them used.

    When it is full the entries go that were not met again since they came or since it was full last; a chunk with more
    different pre-tokens than it has room for gets a wider table for itself. So a worker's table does not grow with its texts.
    An entry is found by the pre-token's hash (a worker draws its base) and counts only if its bytes
    are the same; a pre-token whose hash another one holds is encoded without the table."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int = TABLE_BITS, hash_: K.Hash | None = None):
        self.encode, self.bits, self.hash = encode, bits, hash_ or K.Hash(K.fresh_key())
        self.clear()

    def clear(self, bits: int | None = None) -> None:
        size = 1 << (bits or self.bits)
        self.mask = U(size - 1)
        self.keys, self.slots = np.zeros(size, U), np.zeros(size, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.raw, self.n_raw = np.zeros(1 << 16, np.uint8), 0
        self.start, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.of, self.again = np.zeros(1 << 14, U), np.zeros(1 << 14, bool)

    def renew(self) -> None:
        """Keeps the entries that were met again, if they are at most half of the room."""
        on = np.flatnonzero(self.again[: self.n])
        if 4 * len(on) > int(self.mask):
            on = on[:0]
        h, size, counts = self.of[on], self.size[on], self.length[on].astype(np.int64)
        ids, raw = K.gather(self.ids, self.start[on], counts), K.gather(self.raw, self.at[on], size)
        self.clear()
        self.add(h, counts, ids, size, raw)

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: np.ndarray) -> None:
        """New entries, with their ids and bytes end to end."""
        n = self.n + len(h)
        self.ids = self._room(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.raw = self._room(self.raw, self.n_raw + len(raw) + 8)  # `same` reads eight bytes at once
        self.raw[self.n_raw : self.n_raw + len(raw)] = raw
        for name, values in (("start", self.n_ids + np.cumsum(counts) - counts), ("length", counts), ("at", self.n_raw + np.cumsum(size) - size), ("size", size), ("of", h), ("again", False)):
            setattr(self, name, self._room(getattr(self, name), n))
            getattr(self, name)[self.n : n] = values
        self.insert(h, np.arange(self.n, n, dtype=np.int32))
        self.n, self.n_ids, self.n_raw = n, self.n_ids + len(ids), self.n_raw + len(raw)

    def find(self, h: np.ndarray) -> np.ndarray:
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & self.mask
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.slots[slot[hit]]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + U(1)) & self.mask
        return out

    def insert(self, h: np.ndarray, values: np.ndarray) -> None:
        slot = h & self.mask
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.slots[slot[won]] = values[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, values, slot = h[rest], values[rest], (slot[rest] + U(1)) & self.mask

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def same(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, at: np.ndarray) -> bool:
        """Whether all pre-tokens are those of their entries; up to SHORT bytes the hash holds all of them."""
        if np.any(self.size[at] != size):
            return False
        eight = lambda x, n: np.ndarray((n + 1,), "<u8", x, strides=(1,))
        a, b = eight(np.concatenate([data, np.zeros(8, np.uint8)]), len(data)), eight(self.raw, self.n_raw)
        on = np.flatnonzero(size > K.SHORT)
        mine, theirs, left = starts[on], self.at[at[on]], size[on]
        long = left > 4096
        for x, y, n in zip(mine[long].tolist(), theirs[long].tolist(), left[long].tolist(), strict=True):
            if not np.array_equal(data[x : x + n], self.raw[y : y + n]):
                return False
        mine, theirs, left = mine[~long], theirs[~long], left[~long]
        while len(left):
            unused = (U(8) - np.minimum(left, 8).astype(U)) << U(3)
            if np.any((a[mine] ^ b[theirs]) << unused):
                return False
            on = left > 8
            mine, theirs, left = mine[on] + 8, theirs[on] + 8, left[on] - 8
        return True

    def each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Without the table."""
        number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        counts, ids = self.encode(list(number))
        at = np.array([number[p] for p in pieces])
        return counts[at], K.gather(ids, (np.cumsum(counts) - counts)[at], counts[at])

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, full: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each pre-token's number of ids, and all ids end to end. full: the table was full and has been renewed."""
        h = K.splitmix(self.hash.words(data, starts, ends) + U(1))
        at = self.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.n + len(new) > int(self.mask) // 2:
                if not self.n:
                    self.clear(int(self.mask).bit_length() + 2)
                elif full:
                    self.clear()
                else:
                    self.renew()
                return self.ids_of(data, starts, ends, True)
            where, raw = missing[first], data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            counts, ids = self.encode(pieces)
            self.again[at[at >= 0]] = True
            self.add(new, counts, ids, (ends - starts)[where], np.frombuffer(b"".join(pieces), np.uint8))
            at[missing] = self.find(h[missing])
        else:
            self.again[at] = True
        if not self.same(data, starts, ends - starts, at):
            raw = data.tobytes()
            return self.each([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        counts = self.length[at].astype(np.int64)
        out = counts, K.gather(self.ids, self.start[at], counts)
        if int(self.mask) >> self.bits:  # the wider table was for this chunk alone
            self.clear()
        return out


class Merges:
    """A tokenizer file's vocabulary and merges, and the segment-tree encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_chars().items()}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(to_byte[c] for c in token)
        for token, i in self.specials.items():
            tokens[i] = token.encode()
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_chars().items())], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.by_bytes = {s.encode(): i for s, i in self.specials.items()}
        self.rank_of: dict[int, int] = {}  # made when the first long piece comes

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's number of ids, and all ids; pieces of like length share their vector steps."""
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            classes.setdefault(0 if p in self.by_bytes else max(1, (len(p) - 2).bit_length()), []).append(i)
        order, counts, flat = [], [], []
        for bits, members in classes.items():
            step = max(1, CELLS >> bits) if bits <= 8 else 1
            for k in range(0, len(members), step):
                some = [pieces[i] for i in members[k : k + step]]
                if bits == 0:
                    flat.append(np.array([self.by_bytes[p] for p in some], np.int64))
                    counts.append(np.ones(len(some), np.int64))
                elif bits > 8:
                    flat.append(self.one(some[0]))
                    counts.append(np.array([len(flat[-1])]))
                else:
                    n, ids = self.many(some, 1 << bits)
                    counts.append(n)
                    flat.append(ids)
            order += members
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        back = np.argsort(np.array(order))
        n, ids = np.concatenate(counts), np.concatenate(flat)
        return n[back], K.gather(ids, (np.cumsum(n) - n)[back], n[back])

    def many(self, pieces: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """One tree a row; all rows take their next merge in one step, until no root has a pair."""
        n, width = len(pieces), leaves + 1
        sizes = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        pos = np.arange(width)
        sym = np.where(pos < sizes[:, None], self.of_byte[raw], -1)
        after = np.where(pos + 1 < sizes[:, None], pos + 1, -1)
        before = np.broadcast_to(pos - 1, (n, width)).copy()
        tree = np.full((n, 2 * leaves), NEVER, np.int64)
        rank = self.ranks(np.maximum(sym[:, :-1], 0), np.maximum(sym[:, 1:], 0))
        pair = (sym[:, 1:] >= 0) & (rank < NEVER)
        tree[:, leaves:] = np.where(pair, rank << 20 | pos[:-1], NEVER)
        node = leaves
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            at = leaf + leaves
            tree[rows, at] = value
            for _ in range(leaves.bit_length() - 1):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            root = tree[rows, 1]
            at, new = root & 0xFFFFF, self.merged[root >> 20]
            gone = after[rows, at]
            beyond, prior = after[rows, gone], before[rows, at]
            sym[rows, at], sym[rows, gone] = new, -1
            after[rows, at] = beyond
            on = beyond >= 0
            before[rows[on], beyond[on]] = at[on]
            inner = gone < leaves
            put(rows[inner], gone[inner], np.full(int(inner.sum()), NEVER))
            r = self.ranks(new, np.where(on, sym[rows, np.maximum(beyond, 0)], 0))
            put(rows, at, np.where(on & (r < NEVER), r << 20 | at, NEVER))
            on = prior >= 0
            r = self.ranks(sym[rows[on], prior[on]], new[on])
            put(rows[on], prior[on], np.where(r < NEVER, r << 20 | prior[on], NEVER))
            rows = rows[tree[rows, 1] < NEVER]
        kept = sym >= 0
        return kept.sum(axis=1), sym[kept]

    def one(self, piece: bytes) -> np.ndarray:
        """A long piece, with its own tree."""
        n = len(piece)
        leaves = 1 << (n - 2).bit_length()
        sym = self.of_byte[np.frombuffer(piece, np.uint8)]
        top = np.full(2 * leaves, NEVER, np.int64)
        r = self.ranks(sym[:-1], sym[1:])
        top[leaves : leaves + n - 1] = np.where(r < NEVER, r << 31 | np.arange(n - 1), NEVER)
        node = leaves
        while node > 1:
            top[node // 2 : node] = np.minimum(top[node : 2 * node : 2], top[node + 1 : 2 * node : 2])
            node //= 2
        tree, sym, never = top.tolist(), sym.tolist(), int(NEVER)
        rank = self.rank_of = self.rank_of or dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True))
        after, before, merged = [*range(1, n), -1], list(range(-1, n - 1)), self.merged

        def put(leaf: int, value: int) -> None:
            at = leaf + leaves
            tree[at] = value
            while at > 1:
                at >>= 1
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low

        def pair(i: int) -> int:
            r = rank.get(sym[i] << 32 | sym[after[i]]) if after[i] >= 0 else None
            return never if r is None else r << 31 | i

        while tree[1] < never:
            at = tree[1] & 0x7FFFFFFF
            gone = after[at]
            sym[at], sym[gone] = int(merged[tree[1] >> 31]), -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            if gone < leaves:
                put(gone, never)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        return np.array([s for s in sym if s >= 0], np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each document's ids, end to end, and their offsets."""
        size = self.token_length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return K.gather(self.token_bytes, self.token_start[ids], size), ends[offsets]


class Encoder:
    """Texts of a chunk to ids; `encode` gives the ids of distinct pre-tokens."""

    def __init__(self, specials: list[str], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.pieces, self.memo = Pieces(specials), Memo(encode)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.pieces.cut(data, offsets)
        counts, ids = self.memo.ids_of(data, starts, np.append(starts[1:], len(data)))
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, offsets)]


_ready: dict[str, tuple[Merges, Encoder]] = {}


def ready(path: str) -> tuple[Merges, Encoder]:
    """A worker loads a tokenizer file once."""
    if path not in _ready:
        m = Merges(path)
        _ready[path] = m, Encoder(list(m.specials), m.encode)
    return _ready[path]


def valid_text(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column; ids that give no valid UTF-8 get replacement characters."""
    raw = data.tobytes()
    try:
        raw.decode()
        if not len(data) or not np.any((data[offsets[offsets < len(data)]] & 0xC0) == 0x80):
            return K.to_array(data, offsets, pa.string())
    except UnicodeDecodeError:
        pass
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every whole text."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = ready(path)
        for b in K.chunks(batches):
            ids, at = encoder(*K.buffer(K.column(b, "text")))
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), K.to_array(ids.astype("<u4").view(np.uint8), at * 4, pa.binary())], ["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that they stand for."""
    bound_arrow(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = ready(path)
        for b in K.chunks(batches, column="ids"):
            data, off = K.buffer(K.column(b, "ids"))
            text = valid_text(*merges.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), off // 4))
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), K.column(b, "ids"), text], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What op3 returns, from the ids and the decoded text."""
    out = decode(encode(docs, path), path)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """The documents with all their columns, ids (an array of integers) and n_tokens; the text is what the ids decode to.

    Where the documents have a column of such a name, it stays and the new one gets underscores before its name."""
    bound_arrow(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    kept = docs.select(*names, "text")
    added = [free_name(docs, "ids"), free_name(docs, "n_tokens")]
    schema = T.StructType([*kept.schema.fields, T.StructField(added[0], T.ArrayType(T.IntegerType())), T.StructField(added[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, encoder = ready(path)
        for b in K.chunks(batches):
            ids, at = encoder(*K.buffer(K.column(b, "text")))
            text = valid_text(*merges.decode(ids, at))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(K.column(b, c) for c in names), text, lists, pa.array(np.diff(at).astype(np.int64))], [*names, "text", *added])

    return kept.mapInArrow(run, schema)
