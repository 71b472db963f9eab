"""Operator 9, BPE encoding and decoding with a backtracking encoder.

The vocabulary is a file of the ``tokenizers`` library: BPE over byte-level
symbols with a word-end suffix.  Its path is a parameter.

Encoding a word takes time linear in its length.  An Aho-Corasick automaton over
the reversed tokens gives, in one pass, the longest token that starts at each
place.  The encoder takes it, checks it against its left neighbour in the
pair-compatibility table (do the merges keep these two tokens apart?), falls back
to the next shorter token where they do not fit, and steps back where none fits;
each place is given up at most once.  A sequence in which all neighbours fit is
the one that merging by rank yields.  Tokens that merging can never yield are
left out of the automaton.

Words recur, so a bounded cache in each worker holds the result by piece of text
between ASCII white space.  Cleaning and cutting a piece into words follows the
file's normalizer and pre-tokenizer; pieces with rare characters are handed to
the library for that step (not for merging).  A file with another normalizer, word
pattern, decoder or kind of special token is refused.

Decoding joins token strings from one byte blob by an offset table.

Defined results.  Null and empty texts have no ids and decode to the empty text.
Texts of any length are encoded whole, and so is a word of any length.  Ids may be null
or repeat; rows are encoded one by one, in any order.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack, unpack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

#: Entries of a worker's young cache; the old one is as large.  Longer pieces are not kept.
CACHE_ENTRIES, CACHE_BYTES = 150_000, 48
#: Entries of the table of pairs found (in)compatible before it is emptied.
PAIR_ENTRIES = 200_000
#: Marks that are a word of their own after letters.
_MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
#: Below this code point, lower-casing and letter classes are the same in all Unicode versions and NFC changes nothing.
_PLAIN = "ɐ"
_END = "</w>"
#: The normalizer that the code follows, and the word pattern of the vocabulary's pre-tokenizer.
_CLEANING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on in byte order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _TwoAges(dict):
    """A cache of at most two times CACHE_ENTRIES pieces; when the young half is full it becomes the old one."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: bytes):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class Cutter:
    """Cleans and cuts text into words as the vocabulary file says; merging is left to the subclasses."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix") != _END or json.dumps(_WORDS) not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("this encoder needs byte-level BPE with word ends and the pattern it knows")
        if (spec["normalizer"] or {}).get("normalizers") != _CLEANING:
            raise ValueError("this encoder follows another normalizer")
        odd = [t["content"] for t in spec["added_tokens"] if not t["content"].startswith("<|") or any(c.isspace() for c in t["content"]) or any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
        if odd:
            raise ValueError(f"special tokens of a kind that this encoder does not find: {odd}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(_WORDS)
        self.byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        self.build(spec)

    def build(self, spec: dict) -> None:
        """Tables that a subclass makes from the file's contents, which are not kept."""

    def words_of(self, piece: str) -> list[bytes]:
        """The words of a piece of text without ASCII white space or special tokens."""
        if max(piece) < _PLAIN and "İ" not in piece:
            piece = piece.lower()
            return [piece.encode()] if piece.isalpha() else [w.encode() for w in self.words.findall(piece)]
        cleaned = self.library.normalizer.normalize_str(piece)
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(cleaned)]

    def cut(self, piece: str) -> list[bytes | int]:
        """Words and ids of special tokens, in order."""
        if not self.special_pattern or "<|" not in piece:
            return self.words_of(piece)
        out: list[bytes | int] = []
        at = 0
        for m in self.special_pattern.finditer(piece):
            out += [*(self.words_of(piece[at : m.start()]) if m.start() > at else ()), self.special[m[0]]]
            at = m.end()
        return out + (self.words_of(piece[at:]) if at < len(piece) else [])


class LibraryVocabulary(Cutter):
    """Merges by the library itself; for uses that ask for ids, not for this encoder."""

    def build(self, spec: dict) -> None:
        self.symbols = {b: s for s, b in self.byte_of.items()}

    def encode_word(self, data: bytes) -> list[int]:
        text = data.decode("latin-1").translate(self.symbols) if data else ""
        return [t.id for t in self.library.model.tokenize(text)]


class Vocabulary(Cutter):
    """Tokens, merges and tables of one vocabulary file."""

    def build(self, spec: dict) -> None:
        vocab: dict[str, int] = spec["model"]["vocab"]
        # a word is a string with one character a byte; the last one is raised by 256, as its symbol holds the word end
        self.text_of: dict[int, str] = {}
        for token, i in vocab.items():
            body = token.removesuffix(_END) if token != _END else token
            if all(c in self.byte_of for c in body) and body:
                inner = [self.byte_of[c] for c in body]
                if len(body) < len(token):
                    inner[-1] += 256
                self.text_of[i] = "".join(map(chr, inner))
        self.id_of = {t: i for i, t in self.text_of.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = rank
            if whole not in self.rank:
                self.halves[whole], self.rank[whole] = (a, b), rank
        self.pairs: dict[tuple[int, int], bool] = {}
        yielded = [i for i in self.text_of if self._yielded(i)]
        self.longest = ahocorasick.Automaton()
        for i in yielded:
            self.longest.add_word(self.text_of[i][::-1], i)
        self.longest.make_automaton()
        live = {self.text_of[i]: i for i in yielded}
        self.shorter = {i: next((live[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in live), -1) for t, i in live.items()}
        self.length = {i: len(t) for t, i in live.items()}
        # decoding: token i is blob[offset[i]:offset[i + 1]]; the library joins token strings by a space where a file has no decoder
        if spec["decoder"] is not None:
            raise ValueError("this decoder needs a file without one")
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token.encode()
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=self.offset[1:])
        self.blob = b"".join(strings)

    def _fits(self, a: int, b: int, limit: float) -> bool:
        """Do merges of rank below ``limit`` never join across the border of ``a`` and ``b``?

        Looks at the pieces that touch the border from the last merges back to the
        first: while a piece is whole, only pairs with it can join.
        """
        rank, halves, merged = self.rank, self.halves, self.merged
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later of the two merges.  A border pair that was there before it must have lost
            # to it: of the left piece's merges those of its own rank come first (further left), of the
            # right piece's the border pair does.
            if ra >= rb:
                limit, a = min(limit, ra), halves[a][1]
            else:
                limit, b = min(limit, rb + 1), halves[b][0]

    def _yielded(self, i: int) -> bool:
        """Does merging the token's own text give the token?"""
        parts = self.halves.get(i)
        if parts is None:
            return True
        known = self.__dict__.setdefault("_known", {})
        if i not in known:
            known[i] = False
            known[i] = self._yielded(parts[0]) and self._yielded(parts[1]) and self._fits(*parts, self.rank[i])
        return known[i]

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[a, b] = self._fits(a, b, float("inf"))
        return found

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one word, given as bytes."""
        n = len(data)
        if not n:
            return []
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        whole = self.id_of.get(text)
        if whole in self.length:
            return [whole]
        best = [0] * n  # the longest token that starts at each place
        last = -1
        length = self.length
        for end, token in self.longest.iter(text[::-1]):
            if end != last:  # the longest of those that end here comes first
                best[n - 1 - end] = token
                last = end
        pairs, shorter, compatible = self.pairs, self.shorter, self.compatible
        out: list[int] = []
        given_up = bytearray(n + 1)
        at, token, left = 0, best[0], -1
        while True:
            size = length[token]
            if not given_up[at + size] and (left < 0 or (pairs[left, token] if (left, token) in pairs else compatible(left, token))):
                out.append(token)
                at += size
                if at == n:
                    return out
                left, token = token, best[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this place is given up
                given_up[at] = 1
                taken = out.pop()
                at -= length[taken]
                left = out[-1] if out else -1
                token = shorter[taken]

    def decode(self, ids: list[int]) -> bytes:
        blob, offset = self.blob, self.offset
        return b" ".join([blob[offset[i] : offset[i + 1]] for i in ids])


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary | LibraryVocabulary) -> None:
        self.vocabulary = vocabulary
        self.words = _TwoAges(self._word)
        self.pieces = _TwoAges(self._piece)
        self.views = _TwoAges(self._view)

    def _word(self, word: bytes) -> bytes:
        ids = self.vocabulary.encode_word(word)
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: bytes) -> bytes:
        words = self.words
        if piece.isalpha():  # ASCII letters only: most pieces are one word, or one and a mark
            return words[piece.lower()]
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return words[piece[:-1].lower()] + words[piece[-1:]]
        return b"".join([words[w] if isinstance(w, bytes) else pack("<I", w) for w in self.vocabulary.cut(piece.decode())])

    def _view(self, piece: bytes) -> tuple[bytes, bytes]:
        """Decimal ids and decoded text of a piece."""
        packed = self.pieces[piece]
        ids = unpack(f"<{len(packed) // 4}I", packed)
        return " ".join(map(str, ids)).encode(), self.vocabulary.decode(ids)

    def encode(self, text: bytes | None) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in (text or b"").split()])

    def decode(self, ids: bytes) -> str:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4").tolist()).decode()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, library: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, kept from task to task; ``library`` merges by the library."""
    if (path, library) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, library] = Encoder((LibraryVocabulary if library else Vocabulary)(path))
    return _ENCODERS[path, library]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit): the encoded texts."""
    C.ship(docs.sparkSession)
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t) for t in texts], pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(C.tidied(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text``: what the ids of :func:`encode_documents` decode to."""
    C.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(C.tidied(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids never leave the worker."""
    C.ship(docs.sparkSession)
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        views = e.views
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                parts = [v for p in (text or b"").split() if (v := views[p])[0]]
                shown = b" ".join([v[0] for v in parts])
                n.append(shown.count(b" ") + 1 if parts else 0)
                ids.append(hashlib.sha256(shown).hexdigest())
                decoded.append(hashlib.sha256(b" ".join([v[1] for v in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(C.tidied(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
