"""Exact SentencePiece BPE encoding and decoding with a prefix table.

The model merges the pair whose joined piece has the best score, leftmost first. For such a vocabulary the encoding of
every prefix of a text ends in one token, and two neighbouring tokens of an encoding are exactly those that are stable
beside each other: merging the characters of both again gives the two. So one pass over a text suffices: at each end
position an automaton lists the pieces that end there, longest first, and the one that is compatible with the last token
of the prefix before it is stored; ids are then read backwards from the table. Which tokens are compatible is found once
for a pair and remembered.

No merge crosses from a non-space to a space, nor a character that is in no piece, so a text is encoded in such units,
and units are remembered up to a bound. Units not yet known are encoded many at a time: the pieces' automaton advances
from all positions at once, and the tables of all units are filled position by position, in numpy. Units of over LONG
characters are encoded one by one, in time linear in their length.

Defined results: null text is the empty text, which has no ids and decodes to the empty text; texts may be of any length;
doc_id plays no part and comes back as it is, null or repeated (repeated rows give repeated rows); other columns are
ignored by with_digests and pass through with_ids, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import made_of_text

SPACE = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6
#: Longest unit that is encoded together with others; units, characters of text, and rows, encoded at a time.
LONG, UNITS, CHARS, ROWS = 64, 1 << 14, 1_000_000, 512


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback and without normalisation is asked for")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.joined = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.alphabet = {c for p in self.ids for c in p}


class Table:
    """Whole numbers by whole-number key, in numpy: open addressing, at most half full."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, bits: int = 16):
        self.n = 0
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.n, self.bits = 0, bits
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none."""
        keys = keys.astype(np.uint64)
        at = self.place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1).astype(np.int64)
        left = np.flatnonzero((there != keys) & (there != self.EMPTY))
        mask = np.uint64((1 << self.bits) - 1)
        at, keys = at[left], keys[left]
        while len(left):
            at = (at + np.uint64(1)) & mask
            there = self.keys[at]
            hit = there == keys
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (there != self.EMPTY)
            left, at, keys = left[go], at[go], keys[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ and aren't there yet."""
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            used = self.keys != self.EMPTY
            keys, values = np.concatenate([self.keys[used], keys]), np.concatenate([self.values[used], values])
            self.clear(max(self.bits, int(4 * len(keys)).bit_length()))
        self.n += len(keys)
        at, mask = self.place(keys), np.uint64((1 << self.bits) - 1)
        while len(keys):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = keys[free]
            mine = free & (self.keys[at] == keys)
            self.values[at[mine]] = values[mine]
            at, keys, values = (at[~mine] + np.uint64(1)) & mask, keys[~mine], values[~mine]


class Encoder:
    def __init__(self, path: str, room: int = 48 << 20, pairs: int = 1_000_000):
        """room: bytes of encoded units that are remembered, from task to task; pairs: tested pairs that are remembered before starting anew."""
        self.v = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.v.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.room, self.held, self.pairs = room, 0, pairs
        self.stable = Table()
        self.known: dict[str, str] = {}  # ids of a unit in decimals joined by commas
        self.other: dict[str, str] = {}  # text of the pieces of units that they don't spell
        self.plain_from = 1 + max(i for i, k in enumerate(self.v.kinds) if k != NORMAL)
        self.decimal = [str(i) for i in range(len(self.v.pieces))]
        nodes: dict[str, int] = {"": 0}
        for piece in self.v.ids:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        self.steps = Table()
        self.steps.put(np.array([nodes[x[:-1]] << 21 | ord(x[-1]) for x in nodes if x]), np.array([n for x, n in nodes.items() if x]))
        self.token = np.full(len(nodes), -1, np.int32)
        for piece, i in self.v.ids.items():
            self.token[nodes[piece]] = i
        self.longest = max(map(len, self.v.ids))
        breaks = "" if "\n" in self.v.alphabet else "\n"
        inner = f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|{breaks}" if breaks else "")
        self.split = re.compile(inner).findall if not self.v.joined else (lambda text: [text] if text else [])

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which tokens of left and right stay as they are beside each other; each pair is tested once."""
        keys = left.astype(np.int64) << 20 | right
        found = self.stable.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            if self.stable.n + len(new) > self.pairs:
                self.stable.clear(16)
            self.stable.put(new, np.array([self.test(k >> 20, k & 0xFFFFF) for k in new.tolist()]))
            found = np.where(found < 0, self.stable.get(keys), found)
        return found == 1

    def test(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens by score, leftmost first, gives the two again."""
        a, b = self.v.pieces[left], self.v.pieces[right]
        parts, score = list(a + b), self.v.scores.get
        ranks = [score(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while best := [r for r in ranks if r is not None]:
            at = ranks.index(max(best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = score(parts[at] + parts[at + 1])
        return parts == [a, b]

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Prefix tables of many units of up to LONG characters, filled together: (tokens, number of tokens) a unit.

        tokens has a row for each unit, ids from the right end; -1 - c stands for character c that is in no piece.
        """
        lengths = np.array([len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        room = np.repeat(ends, lengths) - np.arange(len(chars))
        # ending[k - 1] at a position: the piece of k characters that ends there, or -1
        ending = np.full((self.longest, len(chars)), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for k in range(self.longest):
            node = self.steps.get(node << 21 | chars[at + k])
            on = node >= 0
            at, node = at[on], node[on]
            ending[k, at + k] = self.token[node]
            on = room[at] > k + 1
            at, node = at[on], node[on]
        deepest = 1 + max((k for k in range(self.longest) if (ending[k] >= 0).any()), default=0)
        last = np.full((len(texts), int(lengths.max()) + 1), -1, np.int64)
        size = np.ones(last.shape, np.int64)
        order = np.argsort(-lengths, kind="stable")
        for p in range(last.shape[1] - 1):
            rows = order[: np.searchsorted(-lengths[order], -p, "left")]
            open_ = rows
            for k in range(min(deepest, p + 1), 0, -1):
                token = ending[k - 1, starts[open_] + p]
                might = np.flatnonzero(token >= 0)
                if not len(might):
                    continue
                r, t, before = open_[might], token[might].astype(np.int64), last[open_[might], p + 1 - k]
                fits = np.full(len(r), k == p + 1) | (before < -1)
                if k <= p:
                    ask = np.flatnonzero(before >= 0)
                    fits[ask] = self.compatible(before[ask], t[ask])
                last[r[fits], p + 1], size[r[fits], p + 1] = t[fits], k
                stay = np.ones(len(open_), bool)
                stay[might[fits]] = False
                open_ = open_[stay]
                if not len(open_):
                    break
            last[open_, p + 1] = -2 - chars[starts[open_] + p]
        rows, at, out = np.arange(len(texts)), lengths.copy(), []
        while (at > 0).any():
            out.append(np.where(at > 0, last[rows, at], -1))
            at = np.maximum(at - size[rows, at], 0)
        found = np.stack(out, axis=1)
        return found, (found != -1).sum(axis=1)

    def learn(self, texts: list[str]) -> None:
        """Encode units and remember their ids, and the text of their pieces where it is another."""
        every = [t for t in texts if len(t) <= LONG]
        for at in range(0, len(every), UNITS):
            short = every[at : at + UNITS]
            found, counts = self.many(short)
            for text, row, n in zip(short, found.tolist(), counts.tolist(), strict=True):
                ids = row[n - 1 :: -1]
                if min(ids) < 0:
                    ids = [i for x in ids for i in ([x] if x >= 0 else [self.v.bytes[b] for b in chr(-2 - x).encode()])]
                self.remember(text, ids)
        for text in texts:
            if len(text) > LONG:
                self.remember(text, self.unit(text))

    def forget(self, most: int) -> None:
        """Let go of all units if they take more than `most` bytes."""
        if self.held > most:
            self.known, self.other, self.held = {}, {}, 0

    def remember(self, text: str, ids: list[int]) -> None:
        spelled = "".join(map(self.v.pieces.__getitem__, ids)) if min(ids) >= self.plain_from else self.spelled(ids)
        self.known[text] = own = ",".join(map(self.decimal.__getitem__, ids))
        self.held += 260 + 4 * len(text) + len(own)  # about what strings and tables take
        if spelled != text:
            self.other[text] = spelled
            self.held += 260 + 4 * len(spelled)

    def unit(self, text: str) -> list[int]:
        """Ids of a stretch of text by its prefix table."""
        n = len(text)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ending[end].append(found)
        last = [-1] * (n + 1)  # the last token of each prefix; -1: none, -2: a character of no piece
        size = [0] * (n + 1)
        tested: dict[tuple[int, int], bool] = {}
        for end in range(n):
            for length, token in sorted(ending[end], reverse=True):
                before = last[end + 1 - length]
                if before >= 0 and (before, token) not in tested:
                    tested[before, token] = self.test(before, token)
                if before == -2 or end + 1 == length or before >= 0 and tested[before, token]:
                    last[end + 1], size[end + 1] = token, length
                    break
            else:
                last[end + 1], size[end + 1] = -2, 1
        ids: list[int] = []
        at = n
        while at:
            if last[at] == -2:
                ids += [self.v.bytes[b] for b in reversed(text[at - 1].encode())]
            else:
                ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def escaped(self, text: str) -> str:
        return self.v.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> list[int]:
        return [i for unit in self.split(self.escaped(text or "")) for i in self.unit(unit)]

    def spelled(self, ids: Iterable[int]) -> str:
        """Pieces as text, with the space symbol as in the pieces; runs of byte tokens are decoded as UTF-8."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.v.byte_of:
                run.append(self.v.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            if i >= 0 and self.v.kinds[i] != CONTROL:
                out.append(self.v.pieces[i] if self.v.kinds[i] == NORMAL else " ⁇ ")
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.text_of(self.spelled(ids))

    def text_of(self, spelled: str) -> str:
        if self.v.prefix and spelled.startswith(SPACE):
            spelled = spelled[1:]
        return spelled.replace(SPACE, " ")

    def summaries(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, the ids in decimals joined by commas, and the text decoded from them."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text or "")
            if chars >= CHARS:
                yield from self._some(some)
                some, chars = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        units = [self.split(self.escaped(text or "")) for text in texts]
        used = set().union(*units)
        self.forget(self.room)  # before these are learned, so that all of them are at hand
        self.learn(list(used.difference(self.known)))
        for own in units:
            if own:
                ids = ",".join(map(self.known.__getitem__, own))
                spelled = own if self.other.keys().isdisjoint(own) else [self.other.get(u, u) for u in own]
                yield ids.count(",") + 1, ids, self.text_of("".join(spelled))
            else:
                yield 0, "", ""
        for long in (u for u in used if len(u) > LONG):
            self.held -= 260 + 4 * len(long) + len(self.known.pop(long))
            if long in self.other:
                self.held -= 260 + 4 * len(self.other.pop(long))


def _utf8(run: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is in no valid sequence."""
    out, at = [], 0
    while at < len(run):
        for length in (1, 2, 3, 4):
            try:
                out.append(run[at : at + length].decode())
                at += length
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept for its next tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def done(path: str) -> None:
    """What a worker's encoder remembers stays for its next task, within its room."""
    if path in _encoders:
        _encoders[path].forget(_encoders[path].room)


def with_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text, ...); other columns are ignored."""

    def make(texts: list[str | None]) -> dict[str, list]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found = [(n, sha(ids), sha(text)) for n, ids, text in encoder(path).summaries(texts)]
        return {c: [f[i] for f in found] for i, c in enumerate(new)}

    new = {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}
    return made_of_text(docs.select("doc_id", "text"), new, make, ROWS, lambda: done(path)).drop("text")


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` (array<int>) and `decoded`, the text decoded from them; columns of these names are replaced."""

    def make(texts: list[str | None]) -> dict[str, list]:
        found = list(encoder(path).summaries(texts))
        return {"ids": [np.fromstring(f[1], np.int32, sep=",") for f in found], "decoded": [f[2] for f in found]}

    new = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "decoded": (T.StringType(), pa.string())}
    return made_of_text(docs, new, make, ROWS, lambda: done(path))
