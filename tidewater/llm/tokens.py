"""Fast exact tokenizing with the ``tokenizers`` library.

Both public vocabularies split a text into pre-tokens before they merge, and no
pre-token spans the blank between two words. A column of texts is therefore cut
at single blanks and line ends, its distinct pieces are found by a dictionary
encoding in Arrow, and only pieces that the worker doesn't remember go through
the tokenizer, many at a time. A document's ids are gathered from its pieces'.
Texts for which the cut isn't provably safe are encoded whole.

What a worker remembers is bounded: two generations of ``MOST`` pieces, of which
the older one goes when the newer one is full. A piece is known by 128 bits of
its hash and takes some 30 bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core


#: Pieces of a generation that a worker remembers, at some 30 bytes each.
MOST = 700_000
#: Bytes of texts that are cut at a time (one text at least).
SLICE_BYTES = 4 << 20
#: ASCII marks that end a word and never merge with a letter.
ENDINGS = ".,;:!?#$%&*|"
#: White space in any reading of it, but for the blank.
OTHER_SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DROPPED_SPACE = "\t\n\x0b\f\r"
#: An empty line between two words: its two line ends are pre-tokens of their own.
EMPTY_LINE = re.compile(r"(?<=\S)\n\n(?=\S)")
WORDS_AT_ONCE = 5_000


def _ends_word(c: str) -> bool:
    """A letter that stays one letter in lower case, so that it never joins the punctuation after it."""
    lower = c.lower()
    return c < "ɐ" and c.isalpha() and len(lower) == 1 and lower.isalpha()


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: itself if it is printable, else the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_SPELT = _byte_letters()


def _as_bytes(word: str, blank: bool) -> str:
    spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
    return "Ġ" + spelt if blank else spelt


class _Table:
    """Ids by 128-bit hash: sorted keys, and each key's place and size in a pool."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, begin: np.ndarray, pool: np.ndarray):
        self.keys, self.sizes, self.begin, self.pool = keys, sizes, begin, pool
        self.first = np.ascontiguousarray(keys[:, 0])

    @classmethod
    def empty(cls, kind) -> "_Table":
        return cls(np.zeros((0, 2), np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, kind))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1; quick for sorted keys."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.first, keys[:, 0]), len(self.keys) - 1)
        return np.where((self.first[at] == keys[:, 0]) & (self.keys[at, 1] == keys[:, 1]), at, -1)

    def with_rows(self, keys: np.ndarray, sizes: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> "_Table":
        """Both tables' rows; the other's ids lie at ``begin`` in ``pool``."""
        ends = np.cumsum(sizes)
        picked = pool[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys[:, 0], kind="stable")
        return _Table(
            all_keys[order],
            np.concatenate([self.sizes, sizes.astype(np.uint32)])[order],
            np.concatenate([self.begin, (len(self.pool) + ends - sizes).astype(np.uint32)])[order],
            np.concatenate([self.pool, picked]),
        )


class _Memory:
    """What a worker remembers: a small table that grows, the table it is merged into, and the generation before."""

    def __init__(self, kind, most: int):
        self.kind, self.most = kind, most
        self.tables = [_Table.empty(kind) for _ in range(3)]

    def _hashes(self, pieces: list[str]) -> np.ndarray:
        from xxhash import xxh3_128_digest

        return np.frombuffer(b"".join(map(xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2)

    def find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, places in a pool (-1: unknown), the pool and the hashes."""
        keys = self._hashes(pieces)
        sizes, begin, shift = np.zeros(len(keys), np.int64), np.full(len(keys), -1), 0
        left = np.argsort(keys[:, 0])
        for table in self.tables:
            found = table.places(keys[left])
            at, row = left[found >= 0], found[found >= 0]
            sizes[at] = table.sizes[row]
            begin[at] = table.begin[row].astype(np.int64) + shift
            left = left[found < 0]
            shift += len(table.pool)
        return sizes, begin, np.concatenate([t.pool for t in self.tables]), keys

    def add(self, pieces: list[str], ids: list[bytes]) -> None:
        if pieces:
            pool = np.frombuffer(b"".join(ids), self.kind)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // pool.itemsize
            self.keep(self._hashes(pieces), sizes, np.cumsum(sizes) - sizes, pool)

    def keep(self, keys: np.ndarray, sizes: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> None:
        """Remember these pieces as recent ones."""
        young, main, _ = self.tables
        new = np.argsort(keys[:, 0])
        for table in (young, main):
            new = new[table.places(keys[new]) < 0]
        young = young.with_rows(keys[new], sizes[new], begin[new], pool)
        if 8 * len(young.keys) > self.most:
            main = main.with_rows(young.keys, young.sizes.astype(np.int64), young.begin.astype(np.int64), young.pool)
            young = _Table.empty(self.kind)
        self.tables[:2] = young, main
        if len(main.keys) > self.most:
            self.tables = [young, _Table.empty(self.kind), main]


class PieceEncoder:
    """Encodes columns of texts to unsigned 32-bit ids.

    ``blank_joins``: the vocabulary puts a blank at the front of the following
    word (byte-level BPE); otherwise white space is dropped.
    """

    def __init__(self, path: str, blank_joins: bool, most: int = MOST):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.blank_joins = blank_joins
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # The same merges on words that are already lower-case and spelt as the vocabulary spells bytes.
        self.plain = None, pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token begins a word (with a joined blank) or ends one.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if blank_joins else t.endswith("</w>"))]] = True
        self.code, self.kind = ("H", np.uint16) if len(self.edge) <= 1 << 16 else ("I", np.uint32)
        self.memory = _Memory(self.kind, most)
        special = "|".join(re.escape(s) for s in self.specials)
        blanks = rf"[ {OTHER_SPACE}][ {OTHER_SPACE}]|^[ {OTHER_SPACE}]|[ {OTHER_SPACE}]$"
        self.risky = "|".join(x for x in (r"\x00", special, blanks if blank_joins else "") if x)

    # Whole texts -----------------------------------------------------------

    def _raw(self, texts: list[str], plain: bool = False) -> list[bytes]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain if plain else self.whole
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unsafe(self, text: str) -> bool:
        """Whether a text with risky places must be encoded whole."""
        if not self.blank_joins or "\0" in text or any(s in text for s in self.specials):
            return True
        # A blank starts a pre-token of its own when another white space is next to it.
        left = EMPTY_LINE.sub("\n", text)
        return left[:1].isspace() or left[-1:].isspace() or re.search(r"\s\s", left) is not None

    def _whole_rows(self, texts: pa.Array) -> list[int]:
        marked = np.flatnonzero(pc.match_substring_regex(texts, self.risky).to_numpy(zero_copy_only=False))
        return [i for i in marked.tolist() if self._unsafe(texts[i].as_py())]

    # Pieces ----------------------------------------------------------------

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Plain words, many as one text; a word's first (last) token says where it begins (ends)."""
        out: list[bytes] = []
        width = np.dtype(self.kind).itemsize
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = [_as_bytes(w, self.blank_joins) for w in words[at : at + WORDS_AT_ONCE]]
            ids = self._raw([" ".join(part)], plain=True)[0]
            edges = np.flatnonzero(self.edge[np.frombuffer(ids, self.kind)]) * width
            if len(edges) != len(part):
                out += self._raw(part, plain=True)
                continue
            cuts = [*edges.tolist(), len(ids)] if self.blank_joins else [0, *(edges + width).tolist()]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of unknown pieces; a word's trailing punctuation is a pre-token of its own."""
        parts: dict[str, tuple[str, str]] = {}
        for w in pieces:
            core = w.rstrip(ENDINGS)
            if len(core) != len(w) and core and _ends_word(core[-1]):
                parts[w] = core, "\0" + w[len(core) :]
        atoms = list({x for p in parts.values() for x in p})
        sizes, begin, pool, _ = self.memory.find(atoms)
        ids = {x: pool[b : b + n].tobytes() for x, n, b in zip(atoms, sizes.tolist(), begin.tolist(), strict=True) if b >= 0}
        own = set(pieces)
        other = [x for x in atoms if x not in ids and x not in own]
        new = [*other, *(w for w in pieces if w not in parts and w not in ids)]
        plain = [k for k in new if k.isalpha() and max(k) < "Ā"]
        if self.blank_joins:
            ids.update(zip(plain, self._encode_words(plain), strict=True))
        else:  # this vocabulary lower-cases
            lower = list({k.lower() for k in plain})
            ids_of = dict(zip(lower, self._encode_words(lower), strict=True))
            ids.update((k, ids_of[k.lower()]) for k in plain)
        rest = [k for k in new if k not in ids]
        asked = [k[1:] if k[:1] == "\0" else " " + k if self.blank_joins else k for k in rest]
        ids.update(zip(rest, self._raw(asked), strict=True))
        self.memory.add(other, [ids[k] for k in other])
        ids.update((w, ids[a] + ids[b]) for w, (a, b) in parts.items())
        return [ids[w] for w in pieces]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece's number of ids and its place in the pool, which comes third."""
        sizes, begin, pool, hashes = self.memory.find(pieces)
        new = np.flatnonzero(begin < 0)
        if len(new):
            ids = self._learn([pieces[i] for i in new.tolist()])
            more = np.frombuffer(b"".join(ids), self.kind)
            sizes[new] = n = np.fromiter(map(len, ids), np.int64, len(ids)) // more.itemsize
            begin[new] = len(pool) + np.cumsum(n) - n
            pool = np.concatenate([pool, more])
        self.memory.keep(hashes, sizes, begin, pool)
        return sizes, begin, pool

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (with the end as last).

        No text may be null.
        """
        whole = self._whole_rows(texts)
        own = texts
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            own = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        if self.blank_joins:
            # "\0" marks a piece without a joined blank: the first one and those after a line end.
            own = pc.binary_join_element_wise(pa.scalar("\0"), pc.replace_substring(own, "\n", " \0\n \0"), "")
        else:
            for c in DROPPED_SPACE:
                own = pc.replace_substring(own, c, " ")
        split = pc.split_pattern(own, " ")
        coded = split.flatten().dictionary_encode()
        sizes, begin, pool = self._encode_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out = pool[np.repeat(begin[at] - ends + each, each) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if whole:
            parts, sizes = [], np.diff(bounds)
            encoded = self._raw([texts[i].as_py() for i in whole])
            before = 0
            for i, ids in zip(whole, encoded, strict=True):
                parts += [out[before : bounds[i]], np.frombuffer(ids, self.kind)]
                before, sizes[i] = bounds[i + 1], len(parts[-1])
            out = np.concatenate([*parts, out[before:]])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        return out, bounds


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, blank_joins: bool) -> PieceEncoder:
    """One encoder per worker process; another vocabulary takes its place."""
    key = (path, blank_joins)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, blank_joins)
    return _ENCODERS[key]


def forget() -> None:
    """Give up the vocabulary and its pieces, in a worker that has turned to something else."""
    _ENCODERS.clear()


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts with a bounded number of bytes (one text at least)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield begin, end
        begin = end


def with_endings(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each document."""
    return np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False), bounds + np.arange(len(bounds))
