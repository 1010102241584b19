"""Token ids of whole texts as a tokenizer file gives them, with every distinct piece of text encoded once.

Both tokenizers split a text before they merge, so a text can be cut where no split can reach across:

* byte-level BPE: before a space or line feed that stands between two characters which are not white space;
* word-end BPE, which drops white space: at every space and line feed.

A byte-level piece of one Latin word and marks after it goes to the same merges by a plain delimiter where the split
would cut it, which spares the library its search for that place.

The pieces between such cuts repeat, so a task keeps the ids of those it has met (a table of bounded pieces and
characters that is emptied when full) and asks the tokenizer only for new ones. Texts that hold a special token's string go to the tokenizer whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .common import coded_lists

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core

_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Letters whose class has never changed between versions of Unicode, and ASCII marks.
_LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_MARKS = r"!-/:-@\[-`{-~"
#: Marks a text's first piece, before which no space stands.
_FIRST = "\x02"
_JOIN = 512
#: The byte-level split never joins an ASCII letter and a digit, so long pieces are encoded in parts of about FAR characters.
_TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
FAR = 1 << 16
#: Distinct pieces whose ids a worker that encodes whole corpora keeps (some 200 bytes each): fewer are encoded again and again.
PIECES = 1_500_000
#: Characters of all pieces kept.
HELD = 32 << 20


def byte_letters(library: Tokenizer) -> tuple[list[str], Tokenizer]:
    """The letter that stands for each byte in a byte-level tokenizer's names, and its merges over such letters, split at line feeds alone."""
    whole = json.loads(library.to_str())
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = Tokenizer.from_str(json.dumps(whole | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
    merges.pre_tokenizer = CharDelimiterSplit("\n")
    return [hidden.get(b, chr(b)) for b in range(256)], merges


class PieceEncoder:
    """Encodes columns of texts. path: a tokenizers file, whose kind tells how texts may be cut. limit: pieces kept."""

    def __init__(self, path: str, limit: int = 500_000):
        self.library = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.words = self.library.model.end_of_word_suffix is not None
        self.lower = self.words and "Lowercase()" in str(self.library.normalizer)
        self.limit = limit
        strange = "|".join(map(re.escape, self.special)).replace("/", "\\/")
        self._whole = re.compile(f"(?i){strange}" if self.words else f"{strange}|{_FIRST}")
        self._whole_re2 = self._whole.pattern
        names = self.library.get_vocab()
        self._starts_piece = np.zeros(max(names.values()) + 1, bool)
        for name, at in names.items():
            self._starts_piece[at] = name[0] in "ĠĊ"
        self._zero = self.library.encode("0", add_special_tokens=False).ids
        self._simple = f"^[^{_BLANK}0]+$" if self.words else f"^[ \\n][^{_BLANK}]+$"
        if not self.words:
            self.letters, self.merges = byte_letters(self.library)
            self._spelt = [(chr(b), x) for b, x in enumerate(self.letters) if x != chr(b) and (b == 32 or b >= 127)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.length, self.start, self.flat, self.used = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 15, np.uint16), 0

    def ids(self, text: str) -> list[int]:
        """What the library says of the whole text."""
        return self.library.encode(text, add_special_tokens=False).ids

    def far_ids(self, text: str) -> np.ndarray:
        """The same of a long piece."""
        if self.words:
            return np.array(self.ids(text), np.uint16)
        out, at = [], 0
        while at < len(text):
            turn = _TURN.search(text, at + FAR)
            to = turn.start() if turn else len(text)
            out.append(np.array(self.ids(text[at:to]), np.uint16))
            at = to
        return np.concatenate(out)

    # -- pieces

    def cut(self, text: str) -> list[str]:
        """The keys of a text's pieces; the text must not match _whole."""
        if self.words:
            return text.replace("\n", " ").split(" ")
        first, *rest = _CUT.split(text)
        return [_FIRST + first, *(x if x[0] == "\n" else x[1:] for x in rest)]

    def stretches(self, text: str) -> list[str]:
        """The pieces themselves of a text without special tokens' strings."""
        return [x for x in (text.replace("\n", " ").split(" ") if self.words else _CUT.split(text)) if x]

    def piece(self, key: str) -> str:
        """The text that a key stands for."""
        return key if self.words or key[:1] == "\n" else key[1:] if key[:1] == _FIRST else " " + key

    def many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids of all pieces in one array, and where each piece's ids start and how many they are.

        Pieces of one simple word are joined into longer texts and taken apart again; their ids come first.
        """
        length, start = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
        column = pa.array(pieces, pa.string())
        plain = pc.match_substring_regex(column, self._simple).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        quick = np.zeros(len(pieces), bool)
        if not self.words:
            quick = plain & pc.match_substring_regex(column, f"^ [{_LATIN}]+[{_MARKS}]*$").to_numpy(zero_copy_only=False)
            spelt = pc.replace_substring_regex(column, f"([{_LATIN}])([{_MARKS}])", "\\1\n\\2")
        runs = [(own[i : i + _JOIN], how) for own, how in ((np.flatnonzero(quick), True), (np.flatnonzero(plain & ~quick), False)) for i in range(0, len(own), _JOIN)]
        flat, used = [], 0
        for run, fast in runs:
            if fast:
                joined = "\n".join(spelt.take(pa.array(run)).to_pylist()).encode().decode("latin-1")
                for byte, letter in self._spelt:
                    joined = joined.replace(byte, letter)
                found = self.merges.encode_batch_fast([joined], add_special_tokens=False)
            else:
                found = self.library.encode_batch_fast([(" 0 " if self.words else "").join([pieces[i] for i in run])], add_special_tokens=False)
            ids = np.array(found[0].ids, np.uint16)
            if self.words:
                ends = np.append(np.flatnonzero(ids == self._zero[0]), len(ids))
                begins = np.append(0, ends[:-1] + 1)
            else:
                begins = np.flatnonzero(self._starts_piece[ids])
                ends = np.append(begins[1:], len(ids))
            if len(begins) == len(run):
                start[run], length[run] = used + begins, ends - begins
                flat.append(ids)
                used += len(ids)
            else:
                rest = np.append(rest, run)
        near = [i for i in rest if len(pieces[i]) <= FAR]
        found = [x.ids for x in self.library.encode_batch_fast([pieces[i] for i in near], add_special_tokens=False)]
        for i, ids in itertools.chain(zip(near, found, strict=True), ((i, self.far_ids(pieces[i])) for i in rest if len(pieces[i]) > FAR)):
            start[i], length[i] = used, len(ids)
            flat.append(np.array(ids, np.uint16))
            used += len(ids)
        return np.concatenate([*flat, np.zeros(0, np.uint16)]), start, length

    def index(self, keys: list[str]) -> np.ndarray:
        """Where each key stands in the table, after adding those that are new."""
        at = np.fromiter(map(lambda k, get=self.known.get: get(k, -1), keys), np.int64, len(keys))
        if (at < 0).any():
            if self.known and (self.held > HELD or len(self.known) + int((at < 0).sum()) > self.limit):
                self.clear()
                at[:] = -1
            new = [keys[i] for i in np.flatnonzero(at < 0)]
            self.held += sum(map(len, new))
            self.add(new)
            at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return at

    def add(self, keys: list[str]) -> None:
        flat, start, length = self.many([self.piece(k) for k in keys])
        n = len(self.known)
        while n + len(keys) > len(self.length):
            self.length, self.start = np.resize(self.length, 2 * len(self.length)), np.resize(self.start, 2 * len(self.start))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[n : n + len(keys)] = length
        self.start[n : n + len(keys)] = self.used + start
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    # -- columns of texts

    def keyed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Codes of pieces, where each text's start (and the end), the distinct keys; and which texts must be taken whole (they have no codes)."""
        whole = pc.match_substring_regex(texts, self._whole_re2).to_numpy(zero_copy_only=False)
        cut = texts if not whole.any() else pc.if_else(pa.array(whole), "", texts)
        if self.words:
            lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(cut) if self.lower else cut, "\n", " "), " ")
        else:
            odd = pc.match_substring_regex(cut, f"[{_BLANK}]{{2}}").to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_FIRST, cut, ""), "\n", " \n"), " ")
            if odd.any():
                rows, slow = [], pa.array([self.cut(x) for x in cut.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
                take = np.arange(len(texts))
                take[odd] = len(texts) + np.arange(len(slow))
                rows = pa.concat_arrays([lists, slow])
                lists = pa.concat_arrays([rows.take(pa.array(take))])
        return *coded_lists(lists), whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (no nulls) in one array, and each text's number of ids."""
        codes, starts, keys, whole = self.keyed(texts)
        at = self.index(keys)[codes]
        length = self.length[at]
        ends = np.cumsum(length, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int32)
        place += np.repeat(self.start[at] - (ends - length).astype(np.int32), length)
        ids = self.flat[place]
        bound = np.concatenate([[0], ends])[starts]
        counts = np.diff(bound)
        if whole.any():
            parts, last = [], 0
            for i in np.flatnonzero(whole):
                own = np.array(self.ids(texts[i].as_py()), np.uint16)
                parts += [ids[last : bound[i]], own]
                last, counts[i] = bound[i + 1], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, limit: int = 500_000) -> PieceEncoder:
    """One encoder for each worker process and file, so that what a task has learned serves the next."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = PieceEncoder(path, limit)
    return _ENCODERS[path, limit]
