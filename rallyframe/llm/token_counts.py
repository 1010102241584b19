"""Exact token counts at every prefix of every text.

Prefix dynamic programming: count(prefix up to character i) = count(prefix up to the last cut at or before i) +
count(the started piece up to i). The counts of started pieces come from a table that a task fills once for each
distinct piece, and the counts at cuts accumulate. The profile answers how many tokens a truncated text has and how
much of a text fits a budget, without encoding again.

A piece's own counts come from its tokenizer's merges by the same recurrence: a prefix's last token is the one that merges
leave apart from the last token of what stands before it, which a table of token pairs tells. It goes over all new pieces
of a slice side by side, a byte a step. Pieces that the split cuts in other places than after a line feed and before their
marks are counted prefix by prefix; those of over LONG characters stay out of the table and are split first. Other than byte-level tokenizers count every prefix by itself, which for such long pieces takes time
with the square of the length.

Null texts count as empty; empty texts have the profile [0]; rows with equal or null ids are kept as they are; an empty
table gives an empty result; other columns pass only if named in `keep`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, slices, spread, texts_of
from .pieces import _LATIN, _MARKS, PieceEncoder


#: Characters of the longest piece whose prefixes are kept.
LONG = 256
#: Pairs of tokens whose verdict is kept: of long pieces, and of all others (as a power of two).
KNOWN_PAIRS = 500_000
PAIR_BITS = 22
#: A piece of one Latin word and marks, in the parts that the split makes of it and of all its prefixes.
_PLAIN = f"^(?P<feed>\\n?)(?P<word>(?:^ )?[{_LATIN}]+)(?P<marks>[{_MARKS}]*)$"
_PARTS = pa.struct([(x, pa.string()) for x in ("feed", "word", "marks")])


class PrefixCounter(PieceEncoder):
    """Knows of each piece its token counts at every prefix, from 1 character to all; pieces share the prefixes they begin with."""

    def __init__(self, path: str, limit: int = 500_000):
        self.token_of: dict[str, int] = {}
        self.apart: dict[int, bool] = {}  # by pairs of tokens
        super().__init__(path, limit)

    def clear(self) -> None:
        super().clear()
        self.prefixes: dict[str, int] = {}
        self.inner, self.inner_start, self.size, self.inner_used = np.zeros(1 << 15, np.uint16), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0

    def add(self, keys: list[str]) -> None:
        n, pieces = len(self.known), [self.piece(k) for k in keys]
        parted = pa.nulls(len(pieces), _PARTS) if self.words else pc.extract_regex(pa.array(pieces, pa.string()), _PLAIN)
        plain = parted.is_valid().to_numpy(zero_copy_only=False)
        flat, bounds = self.plain_counts(parted.filter(pa.array(plain)))
        odd = self.odd_counts([pieces[i] for i in np.flatnonzero(~plain)])
        size, start = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
        size[plain], start[plain] = np.diff(bounds), bounds[:-1]
        size[~plain] = np.fromiter(map(len, odd), np.int32, len(odd))
        start[~plain] = len(flat) + np.cumsum(size[~plain]) - size[~plain]
        flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(odd), np.uint16)])
        while n + len(keys) > len(self.length):
            self.length, self.inner_start, self.size = (np.resize(x, 2 * len(x)) for x in (self.length, self.inner_start, self.size))
        while self.inner_used + len(flat) > len(self.inner):
            self.inner = np.resize(self.inner, 2 * len(self.inner))
        self.length[n : n + len(keys)] = np.where(size, np.append(flat, 0)[start + size - 1], 0)
        self.size[n : n + len(keys)] = size
        self.inner_start[n : n + len(keys)] = self.inner_used + start
        self.inner[self.inner_used : self.inner_used + len(flat)] = flat
        self.inner_used += len(flat)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def odd_counts(self, pieces: list[str]) -> list[list[int]]:
        """The counts at 1, ..., all characters of pieces that the split may cut anywhere: the library's of each prefix."""
        known, new = self.prefixes, {}
        for x in pieces:
            for i in range(len(x), 0, -1):  # down to a prefix that is known, with which all before it are
                if (y := x[:i]) in known or y in new:
                    break
                new[y] = None
        found = list(new)
        known.update(zip(found, self.many(found)[2].tolist(), strict=True))
        return [[known[x[:i]] for i in range(1, len(x) + 1)] for x in pieces]

    def plain_counts(self, parted: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """The counts at 1, ..., all characters of pieces given in the parts that the split makes, one piece after the other, and where each begins (and the end)."""
        parts = pa.concat_arrays(parted.flatten()).dictionary_encode()
        flat, bounds = self.part_counts(parts.dictionary)
        size = np.diff(bounds)
        total = np.where(size, np.append(flat, 0)[bounds[1:] - 1], 0)
        codes = parts.indices.to_numpy(zero_copy_only=False).reshape(-1, len(parted)).T
        place, row = spread(bounds[codes.ravel()], size[codes.ravel()])
        before = np.cumsum(total[codes], axis=1) - total[codes]
        return (flat[place] + before.ravel()[row]).astype(np.uint16), np.append(0, np.cumsum(size[codes].sum(axis=1)))

    def learn(self) -> None:
        """The tables of the recurrence: tokens by names, and what each token becomes by a further byte, or read backwards from its end."""
        byte, vocabulary = {x: b for b, x in enumerate(self.letters)}, self.merges.get_vocab()
        found = self.merges.encode_batch_fast(list(vocabulary), add_special_tokens=False)
        self.token_of = {n: t for (n, t), x in zip(vocabulary.items(), found, strict=True) if x.ids == [t] and byte.keys() >= set(n)}
        self.name_of = {t: n for n, t in self.token_of.items()}
        self.ends = {n[i:] for n in self.token_of for i in range(len(n))}
        self.single, self.bytes_of = np.zeros(256, np.int64), np.zeros(max(self.name_of) + 1, np.int64)
        self.grown = np.zeros(len(self.bytes_of) << 8, np.int32)  # token and byte: the longer token, plus one
        steps: dict[int, int] = {}
        ended = {}
        for name, t in self.token_of.items():
            self.bytes_of[t], last = len(name), byte[name[-1]]
            if len(name) == 1:
                self.single[last] = t
            elif (head := self.token_of.get(name[:-1])) is not None:
                self.grown[head << 8 | last] = t + 1
            at = 0
            for x in reversed(name):
                at = steps.setdefault(at << 8 | byte[x], len(steps) + 1)
            ended[at] = t
        keys = np.fromiter(steps, np.int64, len(steps))
        self.back, self.back_to = np.sort(keys), np.fromiter(steps.values(), np.int64, len(steps))[np.argsort(keys)]
        self.ended = np.full(len(steps) + 2, -1)  # the last place: no token ends so
        self.ended[list(ended)] = list(ended.values())
        self.pairs, self.verdicts = np.zeros(1 << PAIR_BITS, np.uint32), np.full(1 << PAIR_BITS, -1, np.int8)

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merges leave the tokens of each pair apart. What was asked is kept until another pair takes its place."""
        pair = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = lambda x: x * np.uint32(2654435769) >> np.uint32(32 - PAIR_BITS)
        at = slot(pair)
        verdict = np.where(self.pairs[at] == pair, self.verdicts[at], -1)
        if (new := verdict < 0).any():
            asked, place = np.unique(pair[new], return_inverse=True)
            both = [(x >> 16, x & 0xFFFF) for x in asked.tolist()]
            found = self.merges.encode_batch_fast([self.name_of[a] + self.name_of[b] for a, b in both], add_special_tokens=False)
            told = np.fromiter((x.ids == [a, b] for x, (a, b) in zip(found, both, strict=True)), np.int8, len(both))
            self.pairs[slot(asked)], self.verdicts[slot(asked)] = asked, told
            verdict[new] = told[place]
        return verdict == 1

    def part_counts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As by_merges, of many short parts: the recurrence goes over their first bytes, their second ones and so on.

        The counts of one part after the other, and where each begins (and the end).
        """
        if not self.token_of:
            self.learn()
        bound = np.append(0, np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64))
        data = np.frombuffer("".join(parts.to_pylist()).encode(), np.uint8)
        size = np.diff(bound)
        order = np.argsort(-size, kind="stable")
        text, home = bound[order], (bound[:-1] + np.arange(len(size)))[order]  # a place before each part's first byte
        last, count = np.zeros(len(data) + len(size), np.int32), np.zeros(len(data) + len(size), np.int32)
        wide = len(size) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0)) + 1))
        for j in range(1, len(wide)):
            at, byte = home[: wide[j]], data[text[: wide[j]] + j - 1]
            if j == 1:
                token, start = self.single[byte], np.zeros(len(at), np.int64)
            else:  # mostly the last token grows, or a new one begins
                former = last[at + j - 1]
                start = j - 1 - self.bytes_of[former]
                token = self.grown[former.astype(np.int64) << 8 | byte].astype(np.int64) - 1
                good = token >= 0
                rows = np.flatnonzero(good & (start > 0))
                good[rows] = self.fit(last[at[rows] + start[rows]], token[rows])
                rows = np.flatnonzero(~good)
                token[rows], start[rows] = self.single[byte[rows]], j - 1
                rows = rows[~self.fit(former[rows], token[rows])]
                i, node = j, np.zeros(len(rows), np.int64)
                while len(rows):
                    if not i:
                        raise ValueError("no token of the file ends here")
                    i -= 1
                    step = node << 8 | data[text[rows] + i]
                    found = np.minimum(np.searchsorted(self.back, step), len(self.back) - 1)
                    node = np.where(self.back[found] == step, self.back_to[found], len(self.ended) - 1)
                    own = self.ended[node]
                    good = own >= 0
                    if i:
                        some = np.flatnonzero(good)
                        good[some] = self.fit(last[at[rows[some]] + i], own[some])
                    token[rows[good]], start[rows[good]] = own[good], i
                    rows, node = rows[~good], node[~good]
            last[at + j] = token
            count[at + j] = count[at + start] + 1
        ends = np.append((data[1:] & 0xC0) != 0x80, True)[: len(data)]  # bytes that end a character
        return np.delete(count, np.sort(home))[ends], np.append(0, np.cumsum(ends))[bound]

    def by_merges(self, part: str) -> list[int]:
        """The counts at 1, ..., all characters of what the split leaves together.

        A prefix's last token is the only one of the tokens it ends with that merges leave apart from the last token of
        what stands before it.
        """
        if not self.token_of:
            self.learn()
        ends, token_of, apart = self.ends, self.token_of, self.apart
        if len(apart) > KNOWN_PAIRS:
            apart.clear()
        last, count, begin = [0], [0], [0]

        def fits(i: int, token: int) -> bool:
            if not i:
                return True
            pair = last[i] << 20 | token
            if (known := apart.get(pair)) is None:
                known = apart[pair] = self.merges.encode(self.name_of[last[i]] + self.name_of[token]).ids == [last[i], token]
            return known

        names = "".join(map(self.letters.__getitem__, part.encode()))
        for j in range(1, len(names) + 1):
            i = begin[j - 1]  # mostly the last token grows, or a new one begins
            if (token := token_of.get(names[i:j])) is None or not fits(i, token):
                i = j - 1
                if not fits(i, token := token_of[names[i:j]]):
                    while i and names[i - 1 : j] in ends:
                        i -= 1
                    while (token := token_of.get(names[i:j])) is None or not fits(i, token):
                        i += 1
            last.append(token)
            count.append(count[i] + 1)
            begin.append(i)
        return [n for n, after in zip(count[1:], [*part.encode()[1:], 0], strict=True) if after & 0xC0 != 0x80]

    def merged_counts(self, part: str) -> np.ndarray:
        if len(part) <= 3:  # contractions: what begins them is split otherwise
            return np.array([len(self.ids(part[:i])) for i in range(1, len(part) + 1)], np.int32)
        return np.array(self.by_merges(part), np.int32)

    def piece_counts(self, piece: str) -> np.ndarray:
        """The counts at 1, ..., all characters of a piece that no table holds."""
        if len(piece) <= LONG or self.words or self.library.normalizer is not None:
            return np.array([len(self.ids(piece[:i])) for i in range(1, len(piece) + 1)], np.int32)
        spans = [own for _, own in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        out, base = [], 0
        for k, (a, b) in enumerate(spans):
            got = self.merged_counts(piece[a:b])
            if a and piece[a - 1].isspace() and piece[a].isspace():  # up to here, this blank and those before it are one
                got[0] = self.merged_counts(piece[spans[k - 1][0] : a + 1])[-1] - (base - before)
            out.append(base + got)
            before, base = base, int(out[-1][-1]) if b - a > 1 or k + 1 == len(spans) else base + len(self.ids(piece[a:b]))
        return np.concatenate(out)

    def profile_long(self, text: str) -> np.ndarray:
        """The profile of a text with long pieces, without strings of special tokens."""
        keys = self.cut(text)
        short = list(dict.fromkeys(k for k in keys if len(k) <= LONG))
        at = dict(zip(short, self.index(short).tolist(), strict=True))
        out, base = [np.zeros(1, np.int32)], 0
        for k in keys:
            own = self.inner[self.inner_start[at[k]] :][: self.size[at[k]]].astype(np.int32) if k in at else self.piece_counts(self.piece(k))
            out.append(base + own)
            base += int(own[-1]) if len(own) else 0
        return np.concatenate(out)

    def profile_whole(self, text: str) -> np.ndarray:
        """The profile of a text with strings of special tokens: each ends a stretch that is encoded by itself."""
        out, base, last, at = [np.zeros(1, np.int64)], 0, "", 0
        while at < len(text):
            found = min((m for x in self.special if (m := text.find(x, at)) >= 0), default=len(text))
            pieces = self.stretches(text[at:found])
            for last in pieces:
                got = self.piece_counts(last)
                out.append(base + got)
                before, base = base, base + (int(got[-1]) if len(got) else 0)
            if found < len(text):
                own = next(x for x in self.special if text.startswith(x, found))
                start, head = (before, last) if pieces else (base, "")
                out.append(np.array([start + len(self.ids(head + own[:i])) for i in range(1, len(own))] + [base + 1], np.int64))
                base, found = base + 1, found + len(own)
            at = found
        return np.concatenate(out)

    def profiles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The counts at 0, 1, ..., all characters of each text, one text after the other, and where each begins (and the end)."""
        codes, starts, keys, whole = self.keyed(texts)
        long = np.fromiter((len(k) > LONG for k in keys), bool, len(keys))
        if long.any():
            far = np.zeros(len(texts), bool)
            far[np.searchsorted(starts, np.flatnonzero(long[codes]), "right") - 1] = True
            counts, bounds = self.profiles(pc.if_else(pa.array(far), "", texts))
            parts = [self.profile_long(texts[i].as_py()) if far[i] else counts[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        at = self.index(keys)[codes]
        tokens, size = self.length[at], self.size[at]
        piece_ends, token_ends = np.cumsum(size, dtype=np.int64), np.cumsum(tokens, dtype=np.int64)
        first = np.concatenate([[0], token_ends])[starts[:-1]]  # tokens before each text
        base = token_ends - tokens - np.repeat(first, np.diff(starts))
        place = np.arange(piece_ends[-1] if len(size) else 0, dtype=np.int32)
        place += np.repeat((self.inner_start[at] - (piece_ends - size)).astype(np.int32), size)
        counts = self.inner[place] + np.repeat(base.astype(np.int32), size)
        bounds = np.concatenate([[0], piece_ends])[starts]
        counts = np.insert(counts, bounds[:-1], 0)  # the empty prefix of each text
        bounds = bounds + np.arange(len(bounds))
        if whole.any():
            parts = [self.profile_whole(texts[i].as_py()).astype(np.int32) if whole[i] else counts[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            counts, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return counts, bounds


_COUNTERS: dict[str, PrefixCounter] = {}


def count_prefixes(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", budgets: Sequence[int] = (512,), profile: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, and for each budget b fit_b: the characters of the longest prefix of at most b tokens.

    profile=True adds `profile`, the counts at 0, 1, ..., all characters, for tokens_at and longest_prefix.
    """
    schema = f"{id} {docs.schema[id].dataType.simpleString()}, n_bytes long, n_tokens long" + "".join(f", fit_{b} long" for b in budgets) + ", profile array<int>" * profile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, PrefixCounter(path, 400_000))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES // 2):
                texts = texts_of(part, text)
                counts, bounds = counter.profiles(texts)
                columns = [part.column(id), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts[bounds[1:] - 1], pa.int64())]
                names = [id, "n_bytes", "n_tokens"]
                for b in budgets:
                    within = np.where(counts <= b, np.arange(len(counts)), -1)
                    columns.append(pa.array(np.maximum.reduceat(within, bounds[:-1]) - bounds[:-1], pa.int64()))
                    names.append(f"fit_{b}")
                if profile:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts, pa.int32())))
                    names.append("profile")
                yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(docs).select(id, text).mapInArrow(run, schema)


def tokens_at(profile: Column, characters: Column | int) -> Column:
    """Tokens of the text cut after so many characters (all of it, if it is shorter)."""
    n = F.lit(characters) if isinstance(characters, int) else characters
    return F.element_at(profile, F.least(n, F.size(profile) - 1).cast("int") + 1)


def longest_prefix(profile: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most so many tokens."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(profile, lambda x, i: F.when(x <= b, i).otherwise(0)))
