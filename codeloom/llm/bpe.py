"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Three facts carry the design.

* Splitting first: the tokenizer cuts a text into pieces with a pattern that never looks
  behind, so the pieces after a cut depend only on what follows the cut.  The pattern is
  evaluated here with array operations over character classes, many texts at a time.
* Prefix and suffix independence: when the encoding of a string has a token boundary at ``p``,
  no merge crosses ``p``; the two sides can be encoded on their own.
* Sufficient lookahead: what follows position ``n`` can change the tokens before it only through
  a chain of merges of increasing rank, each of which takes the token left of the frontier.
  ``MergeTable.lookahead`` is the longest such chain in bytes, found by one pass over the merge
  list.  Tokens that end that many bytes before the end of what has been read are final.

So a text of any length is encoded with memory for one chunk, one lookahead and one memo of fixed
size.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import unicodedata

import numpy as np

NO_RANK = 1 << 40
LETTER, NUMBER, OTHER, SPACE, SPECIAL = range(5)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by their published rule."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary, merges and special tokens of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], _byte_symbols()
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        raw = {t: bytes(symbols[c] for c in t) for t in model["vocab"] if all(c in symbols for c in t)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.n_ids = 1 + max([*model["vocab"].values(), *self.specials.values()])
        self.token_bytes = [b""] * self.n_ids
        for t, i in model["vocab"].items():
            self.token_bytes[i] = raw.get(t, t.encode())
        for t, i in self.specials.items():
            self.token_bytes[i] = t.encode()
        ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw and t not in self.specials}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = [ids[raw_of(a, symbols)] for a, _ in pairs]
        self.right = [ids[raw_of(b, symbols)] for _, b in pairs]
        self.made = [ids[raw_of(a, symbols) + raw_of(b, symbols)] for a, b in pairs]
        self.rank = {}
        for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            self.rank.setdefault(a << 32 | b, r)
        self.special_pattern = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.specials, key=len, reverse=True)) or b"(?!)")

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes at the end of what has been read whose tokens may still change.

        ``reach[t]``: how far left of the end a difference can have moved when token ``t`` starts at
        its frontier.  A merge ``(u, v)`` with ``v`` at the frontier moves it by ``len(u)``; later
        ranks only, hence one pass in rank order.
        """
        reach = [0] * self.n_ids
        for u, v, uv in zip(self.left, self.right, self.made, strict=True):
            moved = reach[v] + len(self.token_bytes[u])
            reach[uv] = max(reach[uv], reach[u], moved)
            reach[u] = max(reach[u], moved)
        return max(reach, default=0)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the pair of lowest rank first, the leftmost of equals."""
        if len(piece) > 200:
            return self._merge_long(piece)
        get, made = self.rank.get, self.made
        ids = [self.byte_id[b] for b in piece]
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], NO_RANK)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        get, ids, n = self.rank.get, [self.byte_id[b] for b in piece], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


def raw_of(token: str, symbols: dict[str, int]) -> bytes:
    return bytes(symbols[c] for c in token)


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    by = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            by[c] = LETTER
        elif k == "N":
            by[c] = NUMBER
    by[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return by


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    table = _classes()
    cls = table[:256][buf]
    at = np.flatnonzero(buf >= 0xC0)
    if at.size:
        b = buf[at].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = np.where(size == 2, b & 0x1F, np.where(size == 3, b & 0x0F, b & 0x07))
        last = buf.size - 1
        for k in range(1, 4):
            more = size > k
            code = np.where(more, code << 6 | (buf[np.minimum(at + k, last)] & 0x3F), code)
        kind = table[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            more = size > k
            cls[np.minimum(at[more] + k, last)] = kind[more]
    return cls


def piece_starts(buf: np.ndarray, hard: np.ndarray, specials: re.Pattern | None, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pattern's pieces start, and which of them are special tokens.

    ``hard``: sorted offsets at which a text starts.  ``inside``: the buffer goes on with a piece
    that has begun before, so neither a contraction nor a blank starts at offset 0.
    """
    n = buf.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    cls = byte_classes(buf)
    wall = np.zeros(n + 1, bool)
    wall[hard] = True
    wall[0] = wall[n] = True
    spans = [m.span() for m in specials.finditer(buf.tobytes())] if specials is not None and (buf == 0x3C).any() else []
    for a, b in spans:
        if wall[a + 1 : b].any():  # it would span two texts
            continue
        cls[a:b] = SPECIAL
        wall[a] = wall[b] = True
    edge = wall[:n].copy()
    edge[1:] |= cls[1:] != cls[:-1]
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    kind = cls[runs]
    blank = kind == SPACE
    start = edge
    # the last character of white space before something else stands alone or joins what follows
    before = np.flatnonzero(blank & ~wall[ends])
    last = ends[before] - 1
    for _ in range(2):
        last -= (buf[last] & 0xC0) == 0x80
    start[last] = True
    joins = buf[last] == 0x20
    start[ends[before[joins]]] = False
    # contractions
    quote = np.flatnonzero((kind == OTHER) & (ends - runs == 1) & (buf[runs] == 0x27) & ~wall[ends])
    if quote.size:
        quote = quote[start[runs[quote]]]
        if inside and quote.size and runs[quote[0]] == 0:
            quote = quote[1:]
        at, pad = runs[quote], np.append(buf, np.zeros(4, np.uint8))
        a, b = pad[at + 1], pad[at + 2]
        stop = ends[np.minimum(quote + 1, ends.size - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (stop - at >= 3) & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        for sure, size in ((one, 2), (two & ~one, 3)):
            p, e = at[sure], stop[sure]
            start[p + 1] = False
            rest = p + size
            start[rest[rest < e]] = True
    starts = np.flatnonzero(start)
    return starts, cls[starts] == SPECIAL


class PairRanks:
    """Rank of a pair of ids, for whole arrays: open addressing with linear probes."""

    BITS = 19

    def __init__(self, table: MergeTable):
        size = 1 << self.BITS
        self.key, self.rank = np.full(size + 64, 0xFFFFFFFF, np.uint32), np.full(size + 64, NONE, np.int32)
        for pair, r in table.rank.items():
            key = (pair >> 32) << 16 | (pair & 0xFFFF)
            at = ((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - self.BITS)
            while self.rank[at] != NONE:
                at += 1
            self.key[at], self.rank[at] = key, r

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)).astype(np.int64)
        held, out = self.key[at], self.rank[at]
        todo = np.flatnonzero((held != key) & (out != NONE))
        out[todo] = NONE
        while todo.size:
            at_next = at[todo] + 1
            at[todo] = at_next
            held, rank = self.key[at_next], self.rank[at_next]
            same = held == key[todo]
            out[todo[same]] = rank[same]
            todo = todo[~same & (rank != NONE)]
        return out


NONE = 1 << 24  # no such pair: above every rank


def merge_many(table: MergeTable, ranks: PairRanks, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``MergeTable.merge`` of many pieces at once: one merge of every piece in each step.

    ``rows``: bytes, a column for each piece, zero beyond its size.  Returns ids (likewise) and their
    numbers.
    """
    width, many = rows.shape
    made = np.array(table.made + [0], np.int32)
    ids = np.array(table.byte_id, np.int32)[rows]
    out, left = np.zeros((width, many), np.uint16), size.astype(np.int64).copy()
    rank = np.full((max(width, 2), many), NONE, np.int32)  # of the pair that starts in each place
    for k in range(width - 1):
        has = np.flatnonzero(size > k + 1)
        rank[k, has] = ranks(ids[k, has], ids[k + 1, has])
    active = np.arange(many)
    while True:
        wide = int(left[active].max(initial=0))
        best = np.full(active.size, NONE << 5, np.int32)
        for k in range(wide - 1):
            np.minimum(best, (rank[k] << 5) | k, out=best)
        done = best >= NONE << 5
        if done.any():
            end = np.flatnonzero(done)
            out[:, active[end]] = ids[:, end]
            go = np.flatnonzero(~done)
            active, ids, rank, best = active[go], ids[:, go], rank[:, go], best[go]
        if not active.size:
            return out, left
        at, r, every = best & 31, best >> 5, np.arange(active.size)
        for k in range(1, wide):  # close the gap that the right one leaves
            after = at < k
            ids[k] = np.where(after, ids[k + 1] if k + 1 < width else 0, ids[k])
            rank[k] = np.where(after, rank[k + 1] if k + 1 < width else NONE, rank[k])
        ids[at, every] = made[r]
        left[active] -= 1
        n = left[active]
        rank[at, every] = NONE
        right = np.flatnonzero(at + 1 < n)
        rank[at[right], right] = ranks(ids[at[right], right], ids[at[right] + 1, right])
        before = np.flatnonzero(at > 0)
        rank[at[before] - 1, before] = ranks(ids[at[before] - 1, before], ids[at[before], before])


class Memo:
    """Ids of pieces of up to ``8 * words - 1`` bytes, in a table of fixed size.

    It is direct-mapped: a slot holds one piece, its exact bytes and its ids, and a new piece takes
    the place of the old one.  Results never depend on what it holds.
    """

    MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, table: MergeTable, ranks: PairRanks, words: int, bits: int):
        self.table, self.ranks, self.words, self.bits, self.most = table, ranks, words, bits, 8 * words - 1
        self.keys = np.zeros((words, 1 << bits), np.uint64)
        self.count, self.ids = np.zeros(1 << bits, np.uint8), np.zeros((1 << bits, self.most), np.uint16)
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

    def look(self, padded: np.ndarray, view: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [view[at + 8 * w] & self.mask[np.clip(n - 8 * w, 0, 8)] for w in range(self.words)]
        keys[-1] |= n.astype(np.uint64) << np.uint64(56)
        mixed = np.zeros(at.size, np.uint64)
        for k, m in zip(keys, self.MIX, strict=False):
            mixed ^= k * np.uint64(m)
            mixed ^= mixed >> np.uint64(29)
        slot = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)
        other = np.zeros(at.size, bool)
        for w, k in enumerate(keys):
            other |= self.keys[w][slot] != k
        miss = np.flatnonzero(other)
        count, ids = self.count[slot], self.ids[slot]
        if miss.size:
            order = miss[np.lexsort([k[miss] for k in keys])]
            new = np.zeros(order.size, bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[order[1:]] != k[order[:-1]]
            first = order[new]
            got, many = np.zeros((first.size, self.most), np.uint16), np.zeros(first.size, np.uint8)
            by = np.argsort(n[first], kind="stable")
            for part in np.array_split(by, max(1, by.size >> 15)):
                if part.size:
                    f = first[part]
                    width = int(n[f].max())
                    rows = padded[at[f] + np.arange(width)[:, None]]
                    rows[np.arange(width)[:, None] >= n[f]] = 0
                    made, left = merge_many(self.table, self.ranks, rows, n[f])
                    got[part, :width], many[part] = made.T, left
            which = np.cumsum(new) - 1
            count[order], ids[order] = many[which], got[which]
            # slots may clash among the new ones: each slot takes all fields of one piece
            to, one = np.unique(slot[first], return_index=True)
            for w, k in enumerate(keys):
                self.keys[w][to] = k[first[one]]
            self.count[to], self.ids[to] = many[one], got[one]
        return count, ids


class ChunkEncoder:
    """Encodes many whole texts at once; all but very long pieces through two memos."""

    def __init__(self, table: MergeTable, slot_bits: int = 19):
        if table.n_ids > 1 << 16:
            raise ValueError("the memo stores ids in 16 bits")
        self.table = table
        ranks = PairRanks(table)
        self.memos = (Memo(table, ranks, 2, slot_bits), Memo(table, ranks, 4, slot_bits - 3))
        self.size = np.array([len(b) for b in table.token_bytes], np.int64)

    def pieces(self, buf: np.ndarray, hard: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
        return piece_starts(buf, hard, self.table.special_pattern if self.table.specials else None, inside)

    def encode(self, buf: np.ndarray, hard: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, piece starts, and tokens before each piece (one entry more than pieces).

        ``hard``: sorted offsets in ``buf`` at which a text starts.
        """
        starts, special = found if found is not None else self.pieces(buf, hard)
        size = np.diff(np.append(starts, buf.size))
        padded = np.concatenate([buf, np.zeros(40, np.uint8)])
        view = np.ndarray(buf.size + 32, "<u8", padded, 0, (1,))
        counts, parts, least = np.zeros(starts.size, np.int64), [], 0
        for memo in self.memos:
            mine = np.flatnonzero((size > least) & (size <= memo.most) & ~special)
            least = memo.most
            count, ids = memo.look(padded, view, starts[mine], size[mine])
            counts[mine] = count
            parts.append((mine, count, ids))
        longs: list[tuple[int, np.ndarray]] = []
        for k in np.flatnonzero((size > least) | special).tolist():
            piece = buf[starts[k] : starts[k] + size[k]].tobytes()
            ids = [self.table.specials[piece.decode()]] if special[k] else self.table.merge(piece)
            counts[k] = len(ids)
            longs.append((k, np.array(ids, np.uint32)))
        before = np.zeros(starts.size + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        if not with_ids:
            return np.zeros(0, np.uint32), starts, before
        out = np.empty(before[-1], np.uint32)
        for mine, count, ids in parts:
            put, k = before[mine], 0
            while put.size:
                more = count > k
                if not more.all():
                    put, count, ids = put[more], count[more], ids[more]
                out[put + k] = ids[:, k] if put.size else 0
                k += 1
                if k >= ids.shape[1]:
                    break
        for k, ids in longs:
            out[before[k] : before[k + 1]] = ids
        return out, starts, before


class StreamingEncoder:
    """The transducer: ``feed`` takes bytes of one text in any portions and returns the ids that
    have become final; ``finish`` returns the rest.  It keeps at most ``chunk`` bytes and one
    lookahead, whatever the text."""

    def __init__(self, encoder: ChunkEncoder, chunk: int = 1 << 16):
        self.encoder, self.table = encoder, encoder.table
        self.chunk = max(chunk, 2 * self.table.lookahead + 64)
        self.buffer = bytearray()
        self.inside = False  # the buffer starts within a piece
        self.keep = max([16, *map(len, map(str.encode, self.table.specials))]) + 8

    def feed(self, data: bytes) -> np.ndarray:
        out = []
        for k in range(0, len(data), self.chunk):
            self.buffer += data[k : k + self.chunk]
            if len(self.buffer) >= 2 * self.chunk:
                out += self._drain(False)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def finish(self) -> np.ndarray:
        out = self._drain(True)
        self.buffer, self.inside = bytearray(), False
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _drain(self, end: bool) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        if not self.buffer:
            return out
        # whole characters only; a special token or contraction near the end may still form
        cut = len(self.buffer)
        while not end and cut and (self.buffer[cut - 1] & 0xC0) == 0x80:
            cut -= 1
        if not end and cut and self.buffer[cut - 1] >= 0xC0:
            cut -= 1
        buf = np.frombuffer(bytes(self.buffer[:cut]), np.uint8)
        starts, special = self.encoder.pieces(buf, np.zeros(1, np.int64), self.inside)
        if end:
            ids, _, _ = self.encoder.encode(buf, np.zeros(1, np.int64), (starts, special))
            return [ids]
        stable = int(np.searchsorted(starts, cut - self.keep, "right")) - 2
        # a piece is final when another full piece follows it before the tail
        if stable >= 1:
            stop = int(starts[stable])
            head = buf[:stop]
            ids, _, _ = self.encoder.encode(head, np.zeros(1, np.int64), (starts[:stable], special[:stable]))
            del self.buffer[:stop]
            self.inside = False
            return [ids]
        # one piece fills the buffer: emit what lies before the lookahead
        held = bytes(buf[: (int(starts[1]) if starts.size > 1 else cut)])
        sure = min(len(held), cut - self.keep) - self.table.lookahead
        ids = self.table.merge(held)
        ends = np.cumsum(self.encoder.size[ids])
        m = int(np.searchsorted(ends, sure, "right"))
        if m:
            out.append(np.array(ids[:m], np.uint32))
            del self.buffer[: int(ends[m - 1])]
            self.inside = True
        return out


class StreamingDecoder:
    """Ids to text: bytes that do not yet make a character stay in the state machine."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        size = np.array([len(b) for b in table.token_bytes], np.int64)
        self.size, self.at = size, np.concatenate([[0], np.cumsum(size)])
        self.pool = np.frombuffer(b"".join(table.token_bytes), np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        put = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(put[-1], np.uint8)
        src, put = self.at[ids], put[:-1]
        k = 0
        while ids.size:
            out[put + k] = self.pool[src + k]
            k += 1
            more = size > k
            if not more.all():
                ids, size, src, put = ids[more], size[more], src[more], put[more]
        return out.tobytes()

    def feed(self, ids: np.ndarray) -> str:
        return self.state.decode(self.raw(np.asarray(ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", final=True)
        self.state.reset()
        return text


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(merge_table(path))
