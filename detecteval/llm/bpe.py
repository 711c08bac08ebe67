"""Byte-level BPE encoding and decoding (operator 10).

Method: *vectorised pre-tokenisation*. Code points become an array of classes
(letter, number, blank, other white space, rest, apostrophe of an English
contraction, end of text). A finite automaton over these classes marks the
token starts. Each class is a transition function on the automaton's states;
functions compose associatively, so a batch is cut into equal rows, every row
is folded into one function, the row functions are scanned by doubling, and
all rows are replayed at once from their entry states. No regular expression
runs. The slices are deduplicated by hash, and only slices not seen before are
merged, again for all slices at once (lowest rank, leftmost first). The token
offsets are kept, so a text's ids decode by gathering the tokens' bytes.

Null text is empty: 0 tokens, hashes of the empty string.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import Piece, codepoints, ragged, span_hashes, text_pieces

# Classes. LAST_* are the last character of a white-space run before a
# non-space; INNER is any other white space.
LETTER, NUMBER, REST, INNER, LAST_BLANK, LAST_SPACE, CONTR2, CONTR3, END = range(9)
# States: what the scan has just passed.
AT_START, IN_LETTERS, IN_NUMBERS, IN_REST, IN_SPACE, AFTER_BLANK, NEED2, NEED1 = range(8)
N_STATES = 8

#: The lower-case endings of the pattern's contractions.
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state] (a token starts here)."""
    nxt = np.zeros((9, N_STATES), np.uint8)
    start = np.ones((9, N_STATES), bool)
    for cls, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (REST, IN_REST)):
        nxt[cls] = own
        start[cls, [own, AFTER_BLANK]] = False
    nxt[LETTER, NEED2], nxt[LETTER, NEED1] = NEED1, AT_START
    start[LETTER, [NEED2, NEED1]] = False
    nxt[INNER] = IN_SPACE
    start[INNER, IN_SPACE] = False
    nxt[LAST_BLANK] = AFTER_BLANK
    nxt[LAST_SPACE] = AT_START
    for cls, need in ((CONTR2, NEED1), (CONTR3, NEED2)):
        nxt[cls] = need
        nxt[cls, [IN_REST, AFTER_BLANK]] = IN_REST  # the apostrophe belongs to a run of signs
        start[cls, [IN_REST, AFTER_BLANK]] = False
    nxt[END] = AT_START
    start[END] = False
    return nxt, start


NEXT, STARTS = _automaton()
#: Code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLANK, _OTHER_SPACE, _QUOTE = 3, 4, 6
_classes: np.ndarray | None = None


def classes_of(cps: np.ndarray) -> np.ndarray:
    """0 letter, 1 number, 2 rest, 3 blank, 4 other white space."""
    global _classes
    if _classes is None:
        table = np.full(sys.maxunicode + 1, REST, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
        table[WHITE_SPACE] = _OTHER_SPACE
        table[32] = _BLANK
        _classes = table
    return _classes[cps]


def scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each symbol, by composing transition functions."""
    n = len(symbols)
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    fold = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    flat = NEXT.reshape(-1)
    for j in range(width):
        fold = flat[(grid[j].astype(np.intp) * N_STATES)[:, None] + fold]
    step = 1
    while step < rows:  # inclusive scan of the row functions
        fold[step:] = np.take_along_axis(fold[step:], fold[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.full(rows, AT_START, np.uint8)
    state[1:] = fold[:-1, AT_START]
    before = np.empty((width, rows), np.uint8)
    for j in range(width):
        before[j] = state
        state = flat[grid[j].astype(np.intp) * N_STATES + state]
    return before.T.reshape(-1)[:n]


def token_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask over ``cps``: True where a pre-token starts. ``offsets`` bound the texts."""
    n, docs = len(cps), len(offsets) - 1
    if n == 0:
        return np.zeros(0, bool)
    # one END after each text, and two spare cells for the look-ahead
    place = np.arange(n) + np.repeat(np.arange(docs), np.diff(offsets))
    size = n + docs + 2
    sym = np.full(size, END, np.uint8)
    kind = classes_of(cps)
    sym[place] = kind
    char = np.zeros(size, np.uint32)
    char[place] = cps
    space = (sym == _BLANK) | (sym == _OTHER_SPACE)
    blank = sym == _BLANK
    after = np.roll(sym, -1)
    last = space & ~np.roll(space, -1) & (after != END)
    sym[space] = INNER
    sym[last & blank] = LAST_BLANK
    sym[last & ~blank] = LAST_SPACE
    quote = np.flatnonzero(char[:-2] == ord("'"))
    one, two = char[quote + 1], char[quote + 2]
    sym[quote[np.isin(one, [ord(c) for c in ENDINGS_1])]] = CONTR2
    for a, b in ENDINGS_2:
        sym[quote[(one == ord(a)) & (two == ord(b))]] = CONTR3
    state = scan(sym)
    return STARTS[sym[place], state[place]]


class Vocabulary(NamedTuple):
    """Tokens by rank, and every pair of tokens that joins into another one."""
    data: np.ndarray        # the tokens' bytes, one after the other, by rank
    starts: np.ndarray
    lengths: np.ndarray
    byte_rank: np.ndarray   # rank of each single byte
    pair_keys: np.ndarray   # sorted left * size + right
    pair_ranks: np.ndarray
    byte_pairs: np.ndarray  # rank of each pair of bytes, [first, second]
    token_hashes: np.ndarray  # sorted hashes of all tokens, and their ranks
    token_ranks: np.ndarray


NO_PAIR = np.int32(1 << 30)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a file of ``base64(token) rank`` lines (ranks 0, 1, 2, ...)."""
    with open(path, "rb") as f:
        whole = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    tokens = sorted(whole, key=whole.get)
    if [whole[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    lengths = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(tokens), np.uint8)
    pairs = {}
    byte_pairs = np.full((256, 256), NO_PAIR)
    for token, rank in whole.items():
        if len(token) == 2:
            byte_pairs[token[0], token[1]] = rank
        for cut in range(1, len(token)):
            a, b = whole.get(token[:cut]), whole.get(token[cut:])
            if a is not None and b is not None:
                pairs[a * len(tokens) + b] = rank
    keys = np.array(sorted(pairs), np.int64)
    hashes = span_hashes(data, starts, starts + lengths)
    order = np.argsort(hashes)
    return Vocabulary(data, starts, lengths, np.array([whole[bytes([b])] for b in range(256)], np.int32), keys,
                      np.array([pairs[k] for k in keys.tolist()], np.int32), byte_pairs,
                      hashes[order], order.astype(np.uint32))


def _pair_ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) * len(v.lengths) + right
    at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
    return np.where(v.pair_keys[at] == key, v.pair_ranks[at], NO_PAIR)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and where."""
    at = np.searchsorted(sorted_keys, keys)
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), at
    at = np.minimum(at, len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


#: Slices up to this length merge together, one array for each length; a longer
#: one (a run of thousands of equal signs, say) merges on its own with a heap.
PADDED = 64


def merge_slices(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the slices, one after the other, and their number for each slice.

    A slice that is a token is that token. Any other joins the adjacent pair of
    the lowest rank, leftmost first, until no pair joins. All slices of one
    length merge in step: after t joins each of them has length - t tokens, so
    those that go on stay a dense array."""
    n = len(starts)
    length = ends - starts
    is_token, at = _find(v.token_hashes, hashes)
    which = [np.flatnonzero(is_token)]
    found = [v.token_ranks[at[is_token]].astype(np.uint32)]
    counts = np.ones(n, np.int64)
    rest = np.flatnonzero(~is_token)
    for i in rest[length[rest] > PADDED]:
        ids = _merge_long(v, data[starts[i]:ends[i]])
        counts[i] = len(ids)
        which.append(np.array([i]))
        found.append(ids)
    rest = rest[length[rest] <= PADDED]
    rest = rest[np.argsort(length[rest], kind="stable")]
    bounds = np.searchsorted(length[rest], np.arange(PADDED + 2))
    for size in range(2, PADDED + 1):
        rows = rest[bounds[size]:bounds[size + 1]]
        if not len(rows):
            continue
        raw = data[starts[rows][:, None] + np.arange(size)]
        ids = v.byte_rank[raw]
        ranks = v.byte_pairs[raw[:, :-1], raw[:, 1:]]
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            joined = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NO_PAIR)
            go = joined < NO_PAIR
            if not go.all():
                done = ~go
                which.append(rows[done])
                found.append(ids[done].astype(np.uint32).reshape(-1))
                counts[rows[done]] = ids.shape[1]
                rows, ids, ranks, best, joined = rows[go], ids[go], ranks[go], best[go], joined[go]
                if not len(rows):
                    break
            row = np.arange(len(rows))
            width = ids.shape[1] - 1
            beyond = np.arange(width) > best[:, None]  # everything right of the pair moves left
            ids = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ids[row, best] = joined
            ranks = np.where(beyond[:, :-1], ranks[:, 1:], ranks[:, :-1])
            right = best < width - 1
            ranks[row[right], best[right]] = _pair_ranks(v, ids[row[right], best[right]], ids[row[right], best[right] + 1])
            left = best > 0
            ranks[row[left], best[left] - 1] = _pair_ranks(v, ids[row[left], best[left] - 1], ids[row[left], best[left]])
    order = np.concatenate(which)
    flat = np.concatenate(found)
    filled = np.cumsum(counts[order]) - counts[order]
    place = np.empty(n, np.int64)
    place[order] = filled
    return flat[ragged(place, counts)], counts


def _merge_long(v: Vocabulary, raw: np.ndarray) -> np.ndarray:
    """The same joins for one long slice, in O(n log n) with a heap."""
    ids = v.byte_rank[raw].tolist()
    n, size = len(ids), len(v.lengths)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    table = _pair_dict(v)
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
            if (r := table.get(ids[i] * size + ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = nxt[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for left, right in ((prv[i], i), (i, nxt[i])):
            if left >= 0 and right < n and (r := table.get(ids[left] * size + ids[right])) is not None:
                heapq.heappush(heap, (r, left, ids[left], ids[right]))
    return np.array([x for x in ids if x >= 0], np.uint32)


_dicts: dict[int, dict] = {}


def _pair_dict(v: Vocabulary) -> dict:
    if id(v.pair_keys) not in _dicts:
        _dicts[id(v.pair_keys)] = dict(zip(v.pair_keys.tolist(), v.pair_ranks.tolist()))
    return _dicts[id(v.pair_keys)]


class Encoder:
    """Encodes pieces of texts; remembers up to ``cache_size`` merged slices
    (about 40 bytes each) and forgets them all beyond that."""

    def __init__(self, vocabulary: Vocabulary, cache_size: int = 1_000_000):
        self.v, self.cache_size = vocabulary, cache_size
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)    # sorted hashes of the slices
        self.start = np.zeros(0, np.int64)    # where their ids are in the pool
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used:self.used + len(ids)] = ids
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.start = np.concatenate((self.start, self.used + np.cumsum(counts) - counts))[order]
        self.count = np.concatenate((self.count, counts))[order]
        self.used += len(ids)

    def encode(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the piece and the id offset of each text."""
        cps, offs = codepoints(p)
        starts = np.flatnonzero((p.data & 0xC0) != 0x80)[token_starts(cps, offs)]
        ends = np.append(starts[1:], len(p.data))
        hashes = span_hashes(p.data, starts, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        known, at = _find(self.keys, distinct)
        if len(self.keys) + (~known).sum() > self.cache_size:
            self._clear()
            known[:] = False
        if not known.all():
            new = where[~known]
            self._learn(distinct[~known], *merge_slices(self.v, p.data, starts[new], ends[new], hashes[new]))
            _, at = _find(self.keys, distinct)
        rows = at[back]
        counts = self.count[rows]
        ids = self.pool[ragged(self.start[rows], counts)]
        filled = np.concatenate(([0], np.cumsum(counts)))
        return ids, filled[np.searchsorted(starts, p.offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and the byte offset of each."""
        lengths = self.v.lengths[ids]
        filled = np.concatenate(([0], np.cumsum(lengths)))
        return self.v.data[ragged(self.v.starts[ids], lengths)], filled[offsets]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = load_vocabulary(path)
    return _vocabularies[path]


def encode_documents(docs: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id",
                     with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per input row.

    Columns: ``key``, n_tokens, ids_sha256 (ids as little-endian unsigned 32
    bit), decoded_sha256, and with ``with_ids`` the ids themselves. Only the
    two named columns are read, so others cannot clash. ``vocab_path`` must be
    readable where tasks run (it is a parameter of the tokeniser package).
    A null key stays null.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" \
        + (", ids array<int>" if with_ids else "")

    def run(batches):
        encoder = Encoder(vocabulary(vocab_path))
        for batch in batches:
            for p in text_pieces(batch.column(1)):
                ids, offs = encoder.encode(p)
                back, byte_offs = encoder.decode(ids, offs)
                n = p.hi - p.lo
                id_sha = [hashlib.sha256(ids[offs[i]:offs[i + 1]].astype("<u4").tobytes()).hexdigest() for i in range(n)]
                text_sha = [hashlib.sha256(back[byte_offs[i]:byte_offs[i + 1]].tobytes()).hexdigest() for i in range(n)]
                cols = [batch.column(0).slice(p.lo, n), pa.array(np.diff(offs), pa.int64()),
                        pa.array(id_sha), pa.array(text_sha)]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(docs[key], docs[text]).mapInArrow(run, schema)
