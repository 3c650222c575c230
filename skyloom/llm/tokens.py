"""Exact token ids and counts of whole texts, from distinct pieces between safe boundaries.

A byte-level BPE tokenizer whose pre-tokenizer is the common pattern
`'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|spaces` never joins what stands on both sides of a space that is followed by
something other than white space, nor a letter and an ASCII punctuation mark or digit right after it. So a text's ids are
those of its pieces one after another, and each distinct piece need be encoded only once. Texts are cut there by their bytes,
without a copy, the distinct pieces of a batch go to the library in batches of about equal bytes, and a bounded cache keeps what
came back: when it is full, pieces of few batches go first.
Pieces that begin with a space go joined to long texts, which spares the library's cost for each text; what came back is cut
where the bytes of its ids reach the pieces' ends (each id of a byte-level vocabulary stands for a fixed number of bytes).
A space and letters are one word to the pattern, so such pieces go to the same model with their bytes already written as the
vocabulary has them and split at a delimiter, which spares the library its pattern.
Files whose rules are not known to be of that kind are encoded text by text, whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space and what some libraries hold for it. Fixed values.
_SPACE = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_UNSAFE = f" [{_SPACE}]| $"
_AT_SPACE = re.compile(" (?=[^\\s᠎\x1c-\x1f])")
#: After a Latin letter, before an ASCII mark or digit.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[!-@\\[-`{-~]"
_AT_MARK = re.compile(f"(?<={_LETTER})(?={_MARK})")
#: Pieces that may follow any other piece.
_JOINS = f"^ [^{_SPACE}]"
#: Those that the library's pattern leaves whole, whatever their letters.
_WORDS = f"^ {_LETTER}+$"
#: Bytes of a text of joined pieces.
_JOINED = 1 << 15
#: Bytes that are looked through at a time.
_SCANNED = 1 << 18
#: Pieces whose ids are put together at a time.
_GATHERED = 1 << 16


def _written_bytes() -> np.ndarray:
    """The character by which a byte-level vocabulary writes each byte: printable ones as they are, others from 256 on. A line's end
    is the delimiter of words."""
    printable = np.zeros(256, bool)
    for a, b in ((33, 126), (161, 172), (174, 255)):
        printable[a : b + 1] = True
    out = np.arange(256, dtype="<u4")
    out[~printable] = 256 + np.arange((~printable).sum())
    out[ord("\n")] = ord(" ")
    return out


_BYTES = _written_bytes()


def byte_runs(size: np.ndarray, limit: int) -> np.ndarray:
    """Where runs of about `limit` bytes begin, and the end: a run ends with the item that reaches its limit."""
    if not len(size):
        return np.zeros(1, np.int64)
    filled = (np.cumsum(size) - 1) // limit
    return np.concatenate([[0], np.flatnonzero(np.diff(filled)) + 1, [len(size)]])


def _begins(x: np.ndarray) -> np.ndarray:
    """Which bytes begin a piece: spaces, and ASCII marks and digits after a Latin letter."""
    begins = x == ord(" ")
    letter = (x | 0x20) - np.uint8(ord("a")) < 26
    mark = x - np.uint8(ord("!")) < 94
    mark &= ~letter
    # Letters of two bytes, by their second: U+00C0 to U+024F but for the signs of times and division.
    wide = np.flatnonzero(x[:-1] - np.uint8(0xC3) < 7)
    lead, second = x[wide], x[wide + 1]
    letter[wide[(lead != 0xC3) & (lead != 0xC9) | (lead == 0xC3) & (second != 0x97) & (second != 0xB7) | (lead == 0xC9) & (second < 0x90)] + 1] = True
    begins[1:] |= letter[:-1] & mark[1:]
    return begins


def _spans(begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... of lens[0] numbers, and so on."""
    jump = begins - np.cumsum(lens, dtype=np.int32)
    jump += lens
    at = np.repeat(jump, lens)
    at += np.arange(len(at), dtype=np.int32)
    return at


class PieceEncoder:
    """Encodes texts with the tokenizers (.json) or sentencepiece (.model) library; add_special_tokens is off.

    batch_bytes: the bytes of a call to the library. cache: the number of pieces kept (about 40 bytes each); when it is full, those
    of the most batches stay, half of it at most.
    """

    def __init__(self, path: str, batch_bytes: int = 1 << 20, cache: int = 1_000_000):
        self.batch_bytes, self.limit = batch_bytes, cache
        self.pieces = pa.array([], pa.string())
        self.lens, self.begins, self.flat, self.uses = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32), np.empty(0, np.int32)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.special, self.cut = self._rules(path)
            self.vocab = self.tokenizer.get_vocab_size()
            self.bytes_of = self._bytes_of_ids()
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tokenizer, self.special, self.cut = None, (), False
            self.vocab = self.model.get_piece_size()
        self.words = self._words(path) if self.cut else None
        self.unsafe = "|".join([_UNSAFE, *(re.escape(x) for x in self.special)])

    @staticmethod
    def _rules(path: str) -> tuple[tuple[str, ...], bool]:
        """The added tokens, and whether texts may be cut: they may under the rules named above."""
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = rules.get("added_tokens") or []
        before = rules.get("pre_tokenizer") or {}
        known = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer") and rules["model"]["type"] == "BPE"
        plain = all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
        return tuple(x["content"] for x in added), bool(known and plain)

    @staticmethod
    def _words(path: str):
        """The tokenizer of bare words; none if an added token could be in a word."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        if any(re.fullmatch(f"{_LETTER}*", x["content"]) for x in rules.get("added_tokens") or []):
            return None
        return Tokenizer.from_str(json.dumps(rules | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}))

    def _forget(self, most: int) -> None:
        """Keeps pieces of two batches at least, counting half of those before the last time, and `most` at most."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > most:
            kept = np.flatnonzero(self.uses > np.partition(self.uses, -most - 1)[-most - 1])
        self.pieces = self.pieces.take(pa.array(kept))
        self.flat = self.flat[_spans(self.begins[kept], self.lens[kept])]
        self.lens, self.uses = self.lens[kept], self.uses[kept] >> 1
        self.begins = np.cumsum(self.lens, dtype=np.int32) - self.lens

    def _bytes_of_ids(self) -> np.ndarray:
        """How many bytes each id of a byte-level vocabulary stands for."""
        added = {i: len(x.content.encode()) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocab)]
        return np.array([added.get(i, len(x)) for i, x in enumerate(names)], np.int64)

    def _calls(self, texts: pa.Array, words: bool = False) -> Iterator[list[list[int]]]:
        """The ids of the texts (words: of bare words, one to a line), in calls of about batch_bytes."""
        cuts = byte_runs(pc.binary_length(texts).to_numpy(), self.batch_bytes).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            run = texts.slice(a, b - a).to_pylist()
            if words:
                yield [x.ids for x in self.words.encode_batch_fast([_BYTES[np.frombuffer(x.encode(), np.uint8)].tobytes().decode("utf-32-le") for x in run], add_special_tokens=False)]
            elif self.tokenizer is None:
                yield self.model.encode(run, num_threads=1)
            else:
                yield [x.ids for x in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]

    def _library(self, texts: pa.Array, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids one after another."""
        lens, flat = [np.empty(0, np.int32)], [np.empty(0, np.uint32)]
        for got in self._calls(texts, words):
            lens.append(np.fromiter(map(len, got), np.int32, len(got)))
            flat.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lens[-1].sum())))
        return np.concatenate(lens), np.concatenate(flat)

    def _joined(self, pieces: pa.Array, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """_library of pieces that may follow one another (words: all are bare words), joined to long texts."""
        size = pc.binary_length(pieces).to_numpy().astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(byte_runs(size, _JOINED), pa.int32()), pieces)
        _, flat = self._library(pc.binary_join(lists, "\n" if words else ""), words)
        reached, ends = np.cumsum(self.bytes_of[flat]), np.cumsum(size)
        last = np.searchsorted(reached, ends)
        if len(reached) != (last[-1] + 1 if len(last) else 0) or not np.array_equal(reached[last], ends):
            return self._library(pieces)
        return np.diff(last, prepend=-1).astype(np.int32), flat

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the kept arrays hold each of the distinct pieces; those that they lack are encoded first."""
        if len(self.pieces) + len(pieces) > self.limit:
            self._forget(max(0, min(self.limit // 2, self.limit - len(pieces))))
        # The kept are looked for among the batch's: a table of these is smaller and sooner made than one of all that is kept.
        found = pc.fill_null(pc.index_in(self.pieces, value_set=pieces), -1).to_numpy()
        at = np.flatnonzero(found >= 0)
        place = np.full(len(pieces), -1, np.int64)
        place[found[at]] = at
        lacking = np.flatnonzero(place < 0)
        if len(lacking):
            new = pieces.take(pa.array(lacking))
            joins = pc.match_substring_regex(new, _JOINS).to_numpy(zero_copy_only=False)
            words = pc.match_substring_regex(new, _WORDS).to_numpy(zero_copy_only=False) if self.words else np.zeros(len(new), bool)
            order = np.concatenate([np.flatnonzero(words), np.flatnonzero(joins & ~words), np.flatnonzero(~joins)])
            new, m, n = new.take(pa.array(order)), int(words.sum()), int(joins.sum())
            got = [self._joined(new.slice(0, m), True), self._joined(new.slice(m, n - m)), self._library(new.slice(n))]
            lens = np.concatenate([x for x, _ in got])
            self.begins = np.concatenate([self.begins, (len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens).astype(np.int32)])
            self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, *(x for _, x in got)])
            place[lacking[order]] = len(self.pieces) + np.arange(len(lacking))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.uses = np.append(self.uses, np.zeros(len(new), np.int32))
        self.uses[place] += 1
        return place

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of safe texts, which share their bytes, and where each text's begin, and the end."""
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first = ends[0]
        ends = ends - first
        if not ends[-1]:
            return pa.array([], pa.string()), np.zeros(len(ends), np.int64)
        x = np.frombuffer(data, np.uint8)[first : first + ends[-1]]
        starts = np.unique(ends[:-1][np.diff(ends) > 0])
        found = []
        for p in range(0, len(x), _SCANNED):
            # Two bytes more to the left: a letter before the first.
            q = max(0, p - 2)
            begins = _begins(x[q : p + _SCANNED])
            begins[starts[slice(*np.searchsorted(starts, [p, p + _SCANNED]))] - q] = True
            found.append(np.flatnonzero(begins[p - q :]) + p)
        at = np.concatenate([*found, ends[-1:]]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at + first), data)
        return pieces, np.searchsorted(at, ends)

    def _cut_slowly(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        pieces: list[str] = []
        begins: list[int] = []
        for x in texts:
            begins.append(len(pieces))
            if any(s in x for s in self.special):
                pieces += [" " * bool(i) + y for i, y in enumerate(_AT_SPACE.split(x))]
            else:
                pieces += [z for i, y in enumerate(_AT_SPACE.split(x)) for z in _AT_MARK.split(" " * bool(i) + y)]
        return pa.array(pieces, pa.string()), np.array([*begins, len(pieces)])

    def _encode_pieces(self, pieces: pa.Array, begins: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        coded = pieces.dictionary_encode()
        place, of = self._places(coded.dictionary), coded.indices.to_numpy()
        lens, starts = self.lens[place], self.begins[place]
        counts = np.diff(np.append(0, np.cumsum(lens[of], dtype=np.int64))[begins])
        if not ids:
            return counts, None
        # Some pieces at a time: what is made for them stays in the processor's cache.
        parts = [of[a : a + _GATHERED] for a in range(0, len(of), _GATHERED)]
        return counts, np.concatenate([np.empty(0, np.uint32), *(self.flat[_spans(starts[x], lens[x])] for x in parts)])

    def encode(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of ids of each text (null: none) and, if asked for, all ids one after another."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        if not n:
            return np.zeros(0, np.int64), np.empty(0, np.uint32)
        if not self.cut:
            counts, flat = self._library(texts)
            return counts.astype(np.int64), flat if ids else None
        odd = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_pieces(*self._cut(texts), ids)
        counts, own = np.zeros(n, np.int64), np.empty(n, object)
        for at, cut in ((np.flatnonzero(~odd), self._cut), (np.flatnonzero(odd), lambda x: self._cut_slowly(x.to_pylist()))):
            if len(at):
                counts[at], got = self._encode_pieces(*cut(texts.take(pa.array(at))), ids)
                if ids:
                    for i, x in zip(at.tolist(), np.split(got, np.cumsum(counts[at])[:-1]), strict=True):  # type: ignore[arg-type]
                        own[i] = x
        return counts, np.concatenate(own) if ids else None


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker: tasks that follow one another in a worker share what it has kept. A task has one core, so
    the library's own threads would only take those of other tasks."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
