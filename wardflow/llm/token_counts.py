"""Token counts by a compiled tokenizer: transducers instead of an encoder.

A byte-level BPE tokenizer file is compiled into two deterministic transducers.

*Pieces.* The first one reads character classes and marks where pieces begin. It
has twelve states, so what a stretch of text does is a map from states to states.
All maps that occur form a small monoid, whose products are tabulated once. A
block of texts is cut into chunks; the chunks' maps are composed by a prefix scan,
which gives every chunk its entry state, and all chunks run at once. A mark after
each text leads every state back to the start, so texts need no borders of their
own.

*Tokens.* The second one reads the bytes of a piece. Its state holds, for every
suffix of what was read that may still grow into a token, the token before that
suffix and how many tokens more or fewer that place had. A transition carries the
change of the count of tokens; their sum at the end of the piece is its count. Of
the tokens that end at a byte exactly one may follow the token before it: no
merge across the two would have come first. States are made when they are first
reached and forgotten beyond ``STATES`` of them, so memory is bounded. A piece
returns to the start, so its map is constant; equal pieces are counted once.

Special strings of the file are cut out of the texts first and are one token each.
The classes of characters are asked of the tokenizer's own splitting, as its
tables of Unicode may be older than Python's.

Defined results: a null or empty text has 0 bytes and 0 tokens. A null id, extra
columns and repeated rows pass; an empty table gives an empty one. Very long
texts are taken in one block each; memory follows the longest text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructType
from tokenizers import pre_tokenizers

from wardflow.llm import words as W

LIMIT = 1024
# States and pieces a worker remembers before it begins anew.
STATES = 100_000
PIECES = 200_000
# Characters that a chunk of the prefix scan reads.
CHUNK = 64

FIELDS = (StructType().add("n_bytes", LongType()).add("n_tokens", LongType())
          .add("over_limit", BooleanType()))

# -- the transducer that cuts texts into pieces ---------------------------------

# Classes of characters. The letters that may follow an apostrophe are apart.
_OTHER, _LETTER, _DIGIT, _WHITE, _SPACE, _QUOTE, _SOLE, _RV, _L, _E, _END = range(11)
_UNKNOWN = 255
_NAMED = {" ": _SPACE, "'": _QUOTE, "s": _SOLE, "t": _SOLE, "m": _SOLE, "d": _SOLE,
          "r": _RV, "v": _RV, "l": _L, "e": _E}
_LETTERS = {_LETTER, _SOLE, _RV, _L, _E}
# States: at the start; in a run of letters, digits, others; after an apostrophe that
# begins a piece, with r or v, with l; after a whole contraction; after white space,
# one (space or not) or several (the last a space or not).
(_START, _IN_LETTERS, _IN_DIGITS, _IN_OTHERS, _AFTER_QUOTE, _QUOTE_RV, _QUOTE_L, _CLOSED,
 _ONE_SPACE, _ONE_WHITE, _MORE_SPACE, _MORE_WHITE) = range(12)
# What a transition marks: a piece begins here, or began one character ago.
_HERE, _BEFORE = 1, 2


def _run_of(kind: int) -> int:
    if kind in _LETTERS:
        return _IN_LETTERS
    return {_DIGIT: _IN_DIGITS, _OTHER: _IN_OTHERS, _QUOTE: _IN_OTHERS}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks on reading a character of a class."""
    if kind == _END:
        return _START, _BEFORE if state in (_QUOTE_RV, _QUOTE_L) else 0
    white = kind in (_WHITE, _SPACE)
    fresh = ({_SPACE: _ONE_SPACE, _WHITE: _ONE_WHITE, _QUOTE: _AFTER_QUOTE}.get(kind)
             or _run_of(kind)), _HERE
    if state in (_ONE_SPACE, _ONE_WHITE, _MORE_SPACE, _MORE_WHITE):
        if white:
            return (_MORE_SPACE if kind == _SPACE else _MORE_WHITE), 0
        # The last of several is a piece of its own or, a space, joins what follows.
        late = _BEFORE if state in (_MORE_SPACE, _MORE_WHITE) else 0
        if state in (_ONE_SPACE, _MORE_SPACE):
            return _run_of(kind), late
        return fresh[0], fresh[1] | late
    if white or state in (_START, _CLOSED):
        late = _BEFORE if state in (_QUOTE_RV, _QUOTE_L) else 0
        return fresh[0], fresh[1] | late
    if state == _AFTER_QUOTE:
        grown = {_SOLE: _CLOSED, _RV: _QUOTE_RV, _L: _QUOTE_L,
                 _OTHER: _IN_OTHERS, _QUOTE: _IN_OTHERS}.get(kind)
        return (grown, 0) if grown is not None else fresh
    if state in (_QUOTE_RV, _QUOTE_L):
        if kind == (_E if state == _QUOTE_RV else _L):
            return _CLOSED, 0
        # No contraction: the letter behind the apostrophe began a run.
        after, marks = _step(_IN_LETTERS, kind)
        return after, marks | _BEFORE
    return (state, 0) if _run_of(kind) == state else fresh


class PieceCutter:
    """The first transducer with the products of its state maps."""

    def __init__(self):
        states, kinds = range(12), range(11)
        self.marks = np.array([[_step(s, k)[1] for k in kinds] for s in states], np.uint8)
        letters = [tuple(_step(s, k)[0] for s in states) for k in kinds]
        identity = tuple(states)
        found = {identity: 0}
        todo = [identity]
        while todo:  # all maps that some text brings about
            one = todo.pop()
            for letter in letters:
                product = tuple(letter[s] for s in one)
                if product not in found:
                    found[product] = len(found)
                    todo.append(product)
        self.maps = np.array(list(found), np.uint8)
        # products[a, b]: first a, then b.
        self.products = np.array([[found[tuple(b[s] for s in a)] for b in found] for a in found],
                                 np.uint16)
        self.of_kind = np.array([found[x] for x in letters], np.uint16)

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """Product of the first 1, 2, 3, ... maps."""
        n = len(maps)
        if n <= CHUNK:
            out = maps.copy()
            for i in range(1, n):
                out[i] = self.products[out[i - 1], out[i]]
            return out
        chunks = -(-n // CHUNK)
        own = np.zeros(chunks * CHUNK, np.uint16)
        own[:n] = maps
        own = np.ascontiguousarray(own.reshape(chunks, CHUNK).T)
        for k in range(1, CHUNK):
            own[k] = self.products[own[k - 1], own[k]]
        before = np.zeros(chunks, np.uint16)  # the identity
        before[1:] = self.scan(own[-1])[:-1]
        return self.products[before[None, :], own].T.reshape(-1)[:n]

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character; ``_END`` stands after each text."""
        state = self.maps[self.scan(self.of_kind[kinds]), _START]
        before = np.empty(len(state), np.uint8)
        before[:1], before[1:] = _START, state[:-1]
        marks = self.marks[before, kinds]
        begins = (marks & _HERE).astype(bool)
        begins[:-1] |= (marks[1:] & _BEFORE).astype(bool)
        return begins


class Classes:
    """Classes of code points, asked of the tokenizer when they are first met."""

    def __init__(self):
        self._kind = np.full(0x110001, _UNKNOWN, np.uint8)
        self._kind[0x110000] = _END
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self._kind[points]
        new = kinds == _UNKNOWN
        if new.any():
            self._ask(np.unique(points[new]))
            kinds = self._kind[points]
        return kinds

    def _ask(self, points: np.ndarray) -> None:
        for k in range(0, len(points), 4096):
            part = points[k:k + 4096]
            # A character joins the run before it if it is of its class.
            asked = "".join(f"a{c}1{c}!{c}!" for c in map(chr, part))
            begins = np.zeros(len(asked), bool)
            begins[[span[0] for _, span in self._split.pre_tokenize_str(asked)]] = True
            begins = begins.reshape(-1, 7)
            self._kind[part] = np.select(
                [~begins[:, 1], ~begins[:, 3], ~begins[:, 5]], [_LETTER, _DIGIT, _OTHER], _WHITE)
        for c, kind in _NAMED.items():
            if self._kind[ord(c)] != _UNKNOWN:
                self._kind[ord(c)] = kind


# -- the transducer that counts a piece's tokens --------------------------------

def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """The second transducer over bytes. Tokens: 0 to 255 the bytes, then by merge."""

    def __init__(self, merges: list[tuple[bytes, bytes]], states: int = STATES):
        self._limit = states
        number = {bytes([b]): b for b in range(256)}
        self._parts: list[tuple[int, int] | None] = [None] * 256
        self._merge: dict[tuple[int, int], int] = {}
        for left, right in merges:
            if left + right in number:
                raise ValueError("two merges make the same token")
            self._merge[number[left], number[right]] = number[left + right] = len(self._parts)
            self._parts.append((number[left], number[right]))
        never = len(self._parts)
        # Of a token, what stands at its right or left end and the merge that consumes it.
        self._right, self._left = [], []
        for token, parts in enumerate(self._parts):
            self._right.append([(token, never)] + ([] if parts is None else [
                (x, min(m, token)) for x, m in self._right[parts[1]]]))
            self._left.append([(token, never)] + ([] if parts is None else [
                (x, min(m, token)) for x, m in self._left[parts[0]]]))
        # A trie of the tokens that the merges make of their own bytes.
        whole = [True] * 256
        self._child: dict[int, int] = {}
        self._token: list[int | None] = [None]
        self._inner: set[int] = set()
        for text, token in number.items():
            parts = self._parts[token]
            if parts is not None:
                whole.append(whole[parts[0]] and whole[parts[1]]
                             and not self._crossed(*parts, token))
            if whole[token]:
                node = 0
                for b in text:
                    self._inner.add(node)
                    key = node << 8 | b
                    if key not in self._child:
                        self._child[key] = len(self._token)
                        self._token.append(None)
                    node = self._child[key]
                self._token[node] = token
        self._follows: dict[tuple[int, int], bool] = {}
        self._forget()

    def _crossed(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge before ``limit`` would join the end of ``a`` to the start of ``b``."""
        for x, used_x in self._right[a]:
            for y, used_y in self._left[b]:
                made = self._merge.get((x, y))
                # Of equal merges the leftmost comes first.
                if made is not None and made < limit and made < used_x and made <= used_y:
                    return True
        return False

    def _may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        known = self._follows.get((a, b))
        if known is None:
            if len(self._follows) > 8 * self._limit:
                self._follows.clear()
            known = self._follows[a, b] = not self._crossed(a, b, len(self._parts))
        return known

    def _forget(self) -> None:
        start = ((0, -1, 0),)
        self._states, self._number = [start], {start: 0}
        self._next: dict[int, tuple[int, int]] = {}

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count. An entry: trie node, token before, count."""
        open_, last, change = [], None, 0
        for node, before, count in self._states[state]:
            grown = self._child.get(node << 8 | byte)
            if grown is None:
                continue
            token = self._token[grown]
            if last is None and token is not None and self._may_follow(before, token):
                last, change = token, count + 1
            if grown in self._inner:
                open_.append((grown, before, count))
        if last is None:
            raise ValueError("a byte is not in the vocabulary")
        reached = (*((n, t, c - change) for n, t, c in open_), (0, last, 0))
        place = self._number.get(reached)
        if place is None:
            place = self._number[reached] = len(self._states)
            self._states.append(reached)
        self._next[state << 8 | byte] = place, change
        return place, change

    def count(self, piece: bytes) -> int:
        """Number of the piece's tokens."""
        state = total = 0
        known = self._next
        for byte in piece:
            step = known.get(state << 8 | byte)
            if step is None:
                if len(self._states) > self._limit:
                    # Begin anew, but go on from where the piece is.
                    here = self._states[state]
                    self._forget()
                    known = self._next
                    state = self._number.setdefault(here, 1)
                    if state:
                        self._states.append(here)
                step = self._transition(state, byte)
            state, change = step
            total += change
        return total


class Compiled:
    """Both transducers of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model, split = file["model"], file["pre_tokenizer"] or {}
        special = file["added_tokens"]
        plain = (model["type"] == "BPE" and not file["normalizer"] and not file["post_processor"]
                 and split.get("type") == "ByteLevel" and split["use_regex"]
                 and not split["add_prefix_space"]
                 and not any(model[x] for x in ("dropout", "ignore_merges", "byte_fallback",
                                                "continuing_subword_prefix",
                                                "end_of_word_suffix"))
                 and not any(s[x] for s in special for x in ("single_word", "lstrip", "rstrip",
                                                             "normalized")))
        characters = _byte_characters()
        if not plain or not all(c in model["vocab"] for c in characters):
            raise ValueError(f"not a plain byte-level BPE file: {path}")

        def raw(text: str) -> bytes:
            return bytes(characters[c] for c in text)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.counter = TokenCounter([(raw(a), raw(b)) for a, b in pairs])
        self.cutter, self.classes = PieceCutter(), Classes()
        names = sorted((s["content"].encode() for s in special), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self._known: dict[bytes, int] = {}

    def piece_counts(self, pieces: list[bytes]) -> list[int]:
        known = self._known
        if len(known) > PIECES:
            known.clear()
        out = []
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                n = known[piece] = self.counter.count(piece)
            out.append(n)
        return out

    def _without_special(self, data: np.ndarray, bounds: np.ndarray):
        """Stretches between special strings, their bounds and texts, strings per text."""
        n = len(bounds) - 1
        whole = data.tobytes()
        if self.special is None or not self.special.search(whole):
            return whole, bounds, np.arange(n), np.zeros(n, np.int64)
        parts, text, found = [], [], np.zeros(n, np.int64)
        for i in range(n):
            own = self.special.split(whole[bounds[i]:bounds[i + 1]])
            found[i] = len(own) - 1
            parts += own
            text += [i] * len(own)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return b"".join(parts), np.concatenate([[0], np.cumsum(sizes)]), np.array(text), found

    def counts(self, block: W.Block) -> np.ndarray:
        """Number of tokens of each text of a block."""
        n = len(block.bounds) - 1
        whole, bounds, text, total = self._without_special(block.data, block.bounds)
        if not whole:
            return total
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole, np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        # An end mark after the last character of each stretch.
        ends = np.searchsorted(at, bounds[1:])
        marked = np.insert(points, ends, np.uint32(0x110000))
        begins = self.cutter.starts(self.classes.of(marked))
        begins = np.delete(begins, ends + np.arange(len(ends)))
        starts = at[begins]
        stops = np.append(starts[1:], len(data))
        _, first, which = np.unique(W.span_hashes(data, starts, stops), return_index=True,
                                    return_inverse=True)
        sizes = np.array(self.piece_counts([whole[a:b] for a, b in zip(
            starts[first].tolist(), stops[first].tolist(), strict=True)]), np.int64)
        owner = text[np.searchsorted(bounds, starts, "right") - 1]
        return total + np.bincount(owner, sizes[which], minlength=n).astype(np.int64)


@lru_cache(maxsize=2)
def compiled(path: str) -> Compiled:
    """The transducers of a file, kept by a worker for its next tasks."""
    return Compiled(path)


def with_counts(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "size",
                limit: int = LIMIT) -> DataFrame:
    """``docs`` with a struct of ``FIELDS`` about each whole text.

    ``tokenizer``: a byte-level BPE file of the tokenizers library, which every
    executor has at that path. ``over_limit``: more than ``limit`` tokens.
    """
    def compute(column: pa.Array) -> list:
        machine = compiled(tokenizer)
        parts = []
        for block in W.blocks(column):
            tokens = machine.counts(block)
            parts.append([np.diff(block.bounds), tokens, tokens > limit])
        return W.joined(parts, [np.int64, np.int64, bool])

    return W.add_struct(docs, text, name, FIELDS, compute)
