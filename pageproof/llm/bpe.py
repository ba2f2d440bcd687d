"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state that loops on every base
symbol, and one gadget per merge (left, right), in order of priority, is
applied to it:

* arcs on ``left`` are led to a new state, a copy of their old target without
  its arc on ``right``: the pair can no longer stand side by side;
* every state with an arc on ``left`` gets one on the merged token, to where
  ``right`` led before.

All arcs with one label share a target, so a gadget adds one state and moves
one target. The states that the gadgets of one label add form its chain; each
is the one before it (the first: what the label led to when it arose) without
one arc. Arcs are looked up along these chains, so that the automaton stays as
small as the merge list. What remains are exactly the token sequences that
merging leaves, one per word. A gadget whose right part can't follow its left
part never fires and adds nothing.

Encoding walks the automaton over a pre-split word: from each position reached,
tokens that start there and have an arc from the state of that position lead
on. A prefix has one tokenization, so a position has one state, whatever the
length of the word. Transitions once looked up are kept in a table. The first
state has an arc on every token, so a piece that is a token needs no walk.

Texts are lower-cased and pre-split by Python. Code points that its tables do not
know (``unicodedata``), or know only since a later version of Unicode than the
library, may be letters or have lower case there: texts with one of them are
normalised and pre-split by the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct pieces in each of the two generations that a worker remembers.
CACHE_PIECES = 100_000
#: Pieces of more bytes are not remembered.
CACHED_BYTES = 64
#: Ids decoded at a time.
DECODED_IDS = 1 << 16
#: Transitions it keeps in its table at a time.
CACHE_ARCS = 300_000

_END = "</w>"
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: Latin-1's printable
    ones for themselves, the others numbered from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, iter(range(0x100, 0x200))
    return [table[b] if b in table else chr(next(spare)) for b in range(256)]


class Automaton:
    """Deterministic automaton over tokens, compiled from an ordered merge list.

    ``target`` has the state that a label leads to; ``born`` and ``left`` when a
    token arose and its left part; ``chain`` and ``age`` of a state the label
    whose gadget added it and when. State 0 is the first state.
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        self.target = dict.fromkeys(base, 0)
        self.born = dict.fromkeys(base, 0)
        self.left: dict[int, int] = {}
        self.chain, self.age = [-1], [0]
        self.ages: dict[int, list[int]] = {}
        self.states: dict[int, list[int]] = {}
        self.first: dict[int, int] = {}
        self.taken: dict[tuple[int, int], int] = {}
        for when, merge in enumerate(merges, 1):
            self._gadget(when, *merge)

    def _gadget(self, when: int, left: int, right: int, merged: int) -> None:
        if merged in self.born:
            raise ValueError(f"two merges make token {merged}")
        self.born[merged], self.left[merged] = when, left
        before = self.target.get(left)
        if before is None or right not in self.target or not self.follows(before, right):
            return
        self.target[merged] = self.target[right]
        if left not in self.first:
            self.first[left], self.ages[left], self.states[left] = before, [], []
        self.target[left] = len(self.chain)
        self.ages[left].append(when)
        self.states[left].append(len(self.chain))
        self.chain.append(left)
        self.age.append(when)
        self.taken[left, right] = when

    def follows(self, state: int, token: int) -> bool:
        """Whether the state has an arc on the token. It has none if its chain
        took the label away by then. An arc younger than a state arose with the
        arc on the token's left part; an older one is that of the state before."""
        while state:
            label, age, born = self.chain[state], self.age[state], self.born[token]
            if self.taken.get((label, token), age + 1) <= age:
                return False
            at = bisect_right(self.ages[label], min(born, age))
            if at:
                state, token = self.states[label][at - 1], self.left[token]
            else:
                state = self.first[label]
        return True


class Tokenizer:
    """A word-level BPE file: normalisation, pre-split, automaton, labels."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {m[2] for m in merges}
        base = [i for i in vocab.values() if i not in made]
        self.automaton = Automaton(base, merges)
        # Tokens that are on an arc, by the bytes they spell: those with the end mark
        # in a table, the others in a trie of (token or -1, tables of the next bytes).
        byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
        spelt = {t: i for t, i in vocab.items() if i in self.automaton.target}
        spell = lambda t: bytes(byte_of[c] for c in t)
        self.words = {spell(t.removesuffix(_END)): i for t, i in spelt.items() if t.endswith(_END) and t != _END}
        self.starts: dict[int, list] = {}
        for t, i in spelt.items():
            if not t.endswith(_END):
                level, entry = self.starts, None
                for b in spell(t):
                    entry = level.setdefault(b, [-1, {}])
                    level = entry[1]
                entry[0] = i
        self._width = {i: len(t) for t, i in self.words.items()}
        self._width |= {i: len(t) for t, i in spelt.items() if not t.endswith(_END)}
        self._label_bytes = {i: t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        cut = r"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+"
        self._pieces = regex.compile(cut.format(letters=r"\p{L}", digits=r"\p{N}", space=_SPACE), regex.VERSION0)
        self._ascii_pieces = re.compile(cut.format(letters="a-z", digits="0-9", space=r"\t-\r\x20"))
        # The library only normalises and pre-splits here, for which it needs no vocabulary.
        bare = model | {"vocab": {}, "merges": [], "unk_token": None}
        unused = dict.fromkeys(["truncation", "padding", "post_processor", "decoder"])
        self._library = tokenizers.Tokenizer.from_str(json.dumps(spec | unused | {"model": bare, "added_tokens": []}))
        self._byte_of = byte_of
        self._arcs: dict[int, bool] = {}
        self._points: set[str] = set()

    def _open(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= CACHE_ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self.automaton.follows(state, token)
        return known

    def encode_word(self, word: bytes | str) -> list[int]:
        """Token ids of the bytes of one piece, or of a text's; its last symbol carries the end
        mark. Long tokens are tried first. Only one way leads to a position, so
        none is visited twice."""
        if isinstance(word, str):
            word = word.encode()
        words, starts = self.words, self.starts
        whole = words.get(word)
        if whole is not None:
            return [whole]
        n, arcs, target, width = len(word), self._arcs, self.automaton.target, self._width
        at, state, ids, options, trail, arrived = 0, 0, [], [], [], True
        while True:
            if arrived:
                # The tokens that start here, the longest last.
                options, level = [], starts
                for b in word[at:-1]:
                    entry = level.get(b)
                    if entry is None:
                        break
                    token, level = entry
                    if token >= 0:
                        options.append(token)
                token = words.get(word[at:])
                if token is not None:
                    options.append(token)
            arrived = False
            while options:
                token = options.pop()
                open_ = arcs.get(state << 20 | token)
                if open_ or (open_ is None and self._open(state, token)):
                    arrived = True
                    break
            if not arrived:
                at, state, options = trail.pop()
                ids.pop()
                continue
            ids.append(token)
            end = at + width[token]
            if end == n:
                return ids
            trail.append((at, state, options))
            at, state = end, target[token]

    def _coded(self, word: bytes) -> bytes:
        """A piece's ids, as little-endian unsigned 32-bit integers."""
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remembered(self, piece: str) -> bytes:
        """As ``_coded``, from the pieces remembered. When their table is full, it
        becomes the older one, so that frequent pieces are never all forgotten."""
        known = self._known.get(piece)
        if known is None:
            known = self._before.get(piece) or self._coded(piece.encode())
            if len(piece) <= CACHED_BYTES:
                if len(self._known) >= CACHE_PIECES:
                    self._known, self._before = {}, self._known
                self._known[piece] = known
        return known

    def _unknown(self, text: str) -> bool:
        """Whether a text has a code point without a category in Python's tables."""
        new = set(text) - self._points
        known = {c for c in new if unicodedata.category(c) != "Cn"}
        self._points |= known
        return len(known) < len(new)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii_pieces.findall(text.lower())
        # Lower-casing goes by the single character, without the final sigma rule.
        return self._pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _parts(self, text: str) -> list[bytes]:
        """The coded pieces of a text without special tokens."""
        if not text.isascii() and self._unknown(text):
            library, byte_of = self._library, self._byte_of
            split = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
            return [self._coded(bytes(byte_of[c] for c in piece)) for piece, _ in split]
        pieces = self._split(text)
        known = list(map(self._known.get, pieces))
        if None in known:
            for i, found in enumerate(known):
                if found is None:
                    known[i] = self._remembered(pieces[i])
        return known

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._special is None or not self._special.search(text):
            return b"".join(self._parts(text))
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts += [*self._parts(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join(parts + self._parts(text[at:]))

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text, in UTF-8, of ids as ``encode_bytes`` gives them: their labels,
        joined by spaces."""
        labels, step = self._label_bytes, 4 * DECODED_IDS
        if len(ids) <= step:
            return b" ".join([labels[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])
        return b" ".join([self.decode_bytes(ids[i : i + step]) for i in range(0, len(ids), step)])

    def encode(self, text: str) -> list[int]:
        ids = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once per worker. The path is read on
    the machine that runs the task; tokenizer files are installed there."""
    with open(path, encoding="utf-8") as file:
        return Tokenizer(json.load(file))


#: Result of ``encode``: ids as little-endian unsigned 32-bit integers.
CODED = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def encode(text: Column, path: str, keep_ids: bool = True) -> Column:
    """Struct of a text's token count, ids, and digests of ids and decoded text.
    Null and empty texts have no tokens. ``keep_ids=False`` leaves the ids out."""

    @F.arrow_udf(CODED)
    def coded(texts: pa.Array) -> pa.Array:
        own, counts, kept, digests = tokenizer(path), [], [], ([], [])
        # One text at a time becomes an object, and one decoded text is held.
        for value in texts:
            ids = own.encode_bytes(value.as_py() or "")
            counts.append(len(ids) // 4)
            kept.append(ids if keep_ids else None)
            digests[0].append(hashlib.sha256(ids).hexdigest())
            digests[1].append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(kept, pa.binary()), *(pa.array(d, pa.string()) for d in digests)]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return coded(text)


def decode(ids: Column, path: str) -> Column:
    """Text of ids as ``encode`` gives them: the labels of the arcs, joined by
    spaces. Null stays null; no ids give an empty text."""

    @F.arrow_udf("string")
    def decoded(values: pa.Array) -> pa.Array:
        own = tokenizer(path)
        return pa.array([own.decode_bytes(v.as_py()).decode() if v.is_valid else None for v in values], pa.string())

    return decoded(ids)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, digests, and ids if kept."""
    out = docs.select("doc_id", encode(F.col("text"), path, keep_ids).alias("coded"))
    columns = ["coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256"]
    return out.select("doc_id", *columns, *["coded.ids"] * keep_ids)
