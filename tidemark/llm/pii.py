"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

Patterns give the base spans of each kind: leftmost, not overlapping, failing ones dropped without another try. They hold
for whole texts and are linear in their length (an e-mail is looked for at each @, numbers at each run of digits).

The network is trained in numpy, from the base spans of a hash sample of DOCUMENTS texts at most, and from what has their
shape and only fails a check (Luhn, numbers up to 255), which is made again of all that it finds; which windows of a text it
sees is drawn by hash. Their spans also come in VARIANTS windows in forms that no pattern has (foreign letters, parentheses,
other signs between groups of digits), in other contexts and beside numbers that are no personal data, so that the network
learns shapes rather than the contexts it saw. It reads classes of characters in windows of WINDOW characters that overlap by half, and decodes
each by Viterbi. A span of any kind holds a digit or an @, and an e-mail holds no white space, so windows are laid over
every stretch within half a window of a digit or @ and over the whole run of other characters around an @. The tags of
neighbouring windows are joined at the middle of their overlap and spans are built from the joined path, so a span may be
longer than a window. The spans of a text are then reconciled together: base spans stay, the others are taken by
confidence if they overlap none that was taken, and only if they have what their kind asks for (an e-mail an @ between letters or digits; an address four numbers up to 255; a card 12
to 19 digits that pass Luhn; a phone 9 to 15 digits and a + or parentheses).

Defined results: null text is the empty text and has no spans; a text in which all is base yields just that; offsets
count code points, ends exclusive; doc_id plays no part and comes back as it is, null or repeated; other columns are
ignored by with_spans and pass unchanged through redacted; an empty table gives an empty result, and where nothing can be
learned the base spans are the result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import made_of_text

KINDS = ("email", "ip", "card", "phone")
#: Texts learned from at most (in expectation), windows of them, variants made of these, window length, network sizes, steps, confidence asked for.
DOCUMENTS, WINDOWS, VARIANTS, WINDOW, EMBED, HIDDEN, STEPS, BATCH, SURE = 4000, 1500, 6000, 48, 6, 16, 400, 48, 0.6
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Rows of text handled at a time.
ROWS = 2048
DIGITS, TRIGGER, RUN = re.compile("[0-9]+"), re.compile("[0-9@]"), re.compile(r"\S*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(DIGITS.fullmatch(p) and int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in parts)


def is_card(text: str) -> bool:
    d = digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # no span may start before
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def shapes(text: str) -> list[tuple[str, int, int]]:
    """Spans to learn from: those of the patterns, before the checks that characters don't show (Luhn, numbers up to 255)."""
    found = base_spans(text)
    if DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text)]
        found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19]
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then by kind as listed."""
    text = text or ""
    found = [("email", *span) for span in emails(text)]
    if DIGITS.search(text):
        for kind, pattern, holds in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Classes of characters, tags: 0 outside; 2k + 1 a span of kind k begins, 2k + 2 it goes on.
SPECIAL = " \n@.-_+%():/=,;\"'"
CLASSES, TAGS = 5 + len(SPECIAL), 1 + 2 * len(KINDS)
_class = {c: 5 + i for i, c in enumerate(SPECIAL)}
_class |= {c: 1 for c in "0123456789"} | {c: 2 for c in "abcdefghijklmnopqrstuvwxyz"} | {c: 3 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def classes(text: str) -> np.ndarray:
    return np.array([_class.get(c) or (4 if c.isalpha() else 0) for c in text], np.int64)


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all that lies within half a window of a digit or @, or a quarter of the run around an @.

    Windows of one stretch overlap, those of two don't meet.
    """
    half, out, end = WINDOW // 2, [], 0  # end of the last run around an @
    near, stretches = [], []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - half), min(len(text), m.end() + half)
        if m[0] == "@" and m.start() >= end:
            start, low, end = m.start(), end, RUN.match(text, m.end()).end()
            while start > low and not text[start - 1].isspace():
                start -= 1
            a, b = min(a, max(0, start - half // 2)), max(b, min(len(text), end + half // 2))
        near.append((a, b))
    for a, b in sorted(near):
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    for a, b in stretches:
        reach = a
        while True:
            out.append((reach, min(reach + WINDOW, b)))
            if reach + WINDOW >= b:
                break
            reach += half
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; parameters in one dictionary of arrays."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p[f"w_{d}"] = rng.normal(0, 0.3, (EMBED + HIDDEN, 4 * HIDDEN))
            self.p[f"b_{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.p["out_b"][0] = 1.0
        # A span goes on only from its own begin or inside tag.
        self.allowed = np.zeros((TAGS, TAGS))
        for k in range(2, TAGS, 2):
            self.allowed[[t for t in range(TAGS) if t not in (k - 1, k)], k] = -1e4

    def lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        h, c, hs, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, length, HIDDEN)), []
        for t in range(length) if d == "f" else reversed(range(length)):
            z = np.concatenate([x[:, t], h], axis=1)
            g = z @ self.p[f"w_{d}"] + self.p[f"b_{d}"]
            s = sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            old, c = c, f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            hs[:, t] = h
            if keep:
                kept.append((t, z, i, f, o, u, old, tc))
        return hs, kept

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        e = self.p["embed"][x]
        (hf, kf), (hb, kb) = self.lstm(e, "f", keep), self.lstm(e, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["out_b"], (h, kf, kb)

    def chain(self, em: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log-sums and the log-partition of each row; positions outside mask carry them on."""
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, em.shape[1]):
            new = lse(alpha[:, t - 1, :, None] + trans, 1) + em[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(em.shape[1] - 2, -1, -1):
            new = lse(trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
        return alpha, beta, lse(alpha[:, -1], 1)

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths y and its gradients. mask: which positions are text."""
        em, (h, kf, kb) = self.emissions(x, True)
        trans = self.p["trans"] + self.allowed
        n, length, _ = em.shape
        rows = np.arange(n)
        alpha, beta, z = self.chain(em, trans, mask)
        gold = (np.take_along_axis(em, y[:, :, None], 2)[:, :, 0] * mask).sum()
        both = mask[:, 1:] & mask[:, :-1]
        gold += (trans[y[:, :-1], y[:, 1:]] * both).sum()
        d_em = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        np.subtract.at(d_em, (rows[:, None], np.arange(length)[None, :], y), mask.astype(float))
        pairs = np.exp(alpha[:, :-1, :, None] + trans + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        d_trans = (pairs * both[:, :, None, None]).sum(axis=(0, 1))
        np.subtract.at(d_trans, (y[:, :-1][both], y[:, 1:][both]), 1)
        g = {"trans": d_trans, "out": np.einsum("nth,ntk->hk", h, d_em), "out_b": d_em.sum(axis=(0, 1)), "embed": np.zeros_like(self.p["embed"])}
        d_h = d_em @ self.p["out"].T
        for d, kept, dh_all in (("f", kf, d_h[:, :, :HIDDEN]), ("b", kb, d_h[:, :, HIDDEN:])):
            w = self.p[f"w_{d}"]
            gw, gb, dh, dc, d_x = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, length, EMBED))
            for t, zt, i, f, o, u, old, tc in reversed(kept):
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dg = np.concatenate([dc * u * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
                gw += zt.T @ dg
                gb += dg.sum(axis=0)
                dz = dg @ w.T
                d_x[:, t], dh, dc = dz[:, :EMBED], dz[:, EMBED:], dc * f
            g["embed"] += np.eye(CLASSES)[x.ravel()].T @ d_x.reshape(-1, EMBED)
            g[f"w_{d}"], g[f"b_{d}"] = gw, gb
        return float(z.sum() - gold) / n, {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = STEPS, seed: int = 3) -> list[float]:
        """Adam over random batches; the losses."""
        rng, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), BATCH)
            loss, g = self.step(x[at], y[at], mask[at])
            losses.append(loss)
            rate = 0.03 * (1 - t / (steps + 1)) + 0.002
            for k in self.p:
                g[k] = np.clip(g[k], -5, 5)
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window, and each tag's marginal probability in the CRF; only one that begins a text can't start inside a span."""
        em, _ = self.emissions(x)
        em[begins, 0, 2::2] -= 1e4
        trans = self.p["trans"] + self.allowed
        n, length, _ = em.shape
        score, back = em[:, 0], np.zeros((n, length, TAGS), np.int8)
        for t in range(1, length):
            all_ = score[:, :, None] + trans
            back[:, t] = all_.argmax(axis=1)
            new = all_.max(axis=1) + em[:, t]
            on = (t < lengths)[:, None]
            score, back[:, t] = np.where(on, new, score), np.where(on, back[:, t], np.arange(TAGS))
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        alpha, beta, z = self.chain(em, trans, np.arange(length)[None, :] < lengths[:, None])
        return tags, np.exp(np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z[:, None])


def tagged(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        y[a:b] = 2 * k + 2
        y[a] = 2 * k + 1
    return y


def padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), WINDOW), np.int64)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def lessons(key: int, text: str) -> list[tuple[int, int, str, list[int]]]:
    """(round, draw, window, tags) of a text's windows: a hash puts them in order, two a round."""
    tags, out = tagged(text, shapes(text)), []
    drawn = sorted((int.from_bytes(hashlib.blake2b(f"{key}:{a}".encode(), digest_size=7).digest()), a, b) for a, b in windows(text))
    for n, (draw, a, b) in enumerate(drawn[:WINDOWS]):
        out.append((n // 2, draw, text[a:b], tags[a:b].tolist()))
    return out


#: Letters outside ASCII, what a number's groups are parted by, and what stands around a span.
FOREIGN, PARTING, AROUND = "äöüßéèàñçøåœščžğłαβγдежи", " -./", ["", " ", " ", " ", ": ", "(", ")", "[", "]", "<", ">", '"', "'", ", ", ". ", ";", "=", "\n", " - ", "/"]


def reshaped(kind: str, text: str, rng: random.Random) -> str:
    """Another span of a kind: its digits and letters drawn anew, and often in a form that no fixed pattern has."""
    drawn = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        sizes = rng.choice([[4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 1], [6, 10], [4, 4, 4, 4, 3], [16], [13]])
        return rng.choice(PARTING).join(map(drawn, sizes))
    if kind == "phone":
        lead = rng.choice(["+" + drawn(rng.randint(1, 3)) + rng.choice([" ", "-", " (0) ", " ("]), "(" + drawn(rng.randint(2, 4)) + ")" + rng.choice(["", " ", "-"]), "(" + drawn(rng.randint(2, 4)) + ")" + rng.choice([" ", "/"]), "(+" + drawn(2) + ") "])
        part = rng.choice([" ", "-", ".", ""])
        rest = part.join(drawn(rng.randint(3, 4)) for _ in range(rng.choice([2, 2, 3])))
        return lead + (drawn(3) + ") " if lead.endswith(" (") else "") + rest
    if rng.random() < 0.6:  # names and hosts of any length, as many labels as there may be
        name = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        local = rng.choice(["", name(1) + rng.choice("._-")]) + name(rng.randint(1, 12)) + rng.choice(["", "", str(rng.randint(1, 9999))])
        text = f"{local}@{rng.choice(['', '', name(rng.randint(2, 6)) + '.'])}{name(rng.randint(1, 14))}{rng.choice(['', '', '-' + name(rng.randint(2, 8)), str(rng.randint(1, 99))])}.{rng.choice(['', '', 'co.', 'com.'])}{name(rng.randint(2, 4))}"
    out = [rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.islower() else rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c for c in text]
    letters = [i for i, c in enumerate(out) if c.isalpha()]
    for i in rng.sample(letters, min(len(letters), rng.choice([0, 1, 1, 2, 4]))):
        out[i] = rng.choice(FOREIGN)
    for i in [i for i, c in enumerate(out) if c in "._-+%"]:
        out[i] = out[i] if rng.random() < 0.7 or out[i] == "." and "@" in out[:i] else rng.choice("._-+")
    return "".join(out)


def decoy(rng: random.Random) -> str:
    """Numbers and signs that are no personal data: dates, times, prices, versions, names, counts."""
    n = lambda a, b: str(rng.randint(a, b))
    return rng.choice([
        f"{n(1900, 2099)}-{n(10, 12)}-{n(10, 31)}", f"{n(1, 31)}/{n(1, 12)}/{n(1900, 2099)}", f"{n(0, 23)}:{n(10, 59)}", f"${n(1, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 20)}", f"#{n(1, 999999)}", f"@{rng.choice(['name', 'user', 'Joe_7'])}",
        f"({n(1, 99)})", f"({n(1900, 2099)})", f"{n(1900, 1999)}-{n(2000, 2099)}", f"{n(0, 9)}.{n(1000, 999999)}", n(0, 10**9), f"{n(1, 99)} %", f"x@{n(1, 9)}", f"{n(1, 9)}+{n(1, 9)}", f"[{n(1, 99)}]", f"{n(1, 99)}({n(1, 12)}): {n(1, 99)}-{n(100, 199)}",
    ])


def variants(rows: list[tuple[str, list[int]]], n: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """n windows made of others: their spans in new forms, or decoys, between stretches of other windows, random words, or nothing."""
    rng, out = random.Random(seed), []
    spans = [(k, window[a:b]) for window, tags in rows for (k, a, b) in spans_of(0, np.array(tags), np.ones(len(tags)))]
    kinds = sorted({k for k, _ in spans})
    own = {k: [t for kind, t in spans if kind == k] for k in kinds}
    plain = [window[: next((i for i, t in enumerate(tags) if t), len(tags))] for window, tags in rows]

    def words() -> str:
        made = lambda: "".join(rng.choices("aeiourstnldmcp" if rng.random() < 0.9 else "äéñжz", k=rng.randint(1, 10)))
        text = rng.choice(plain) if plain and rng.random() < 0.4 else " ".join(made().capitalize() if rng.random() < 0.2 else made() for _ in range(8))
        return text[: rng.choice([0, 3, 12, 24, 48, 48])]

    while kinds and len(out) < n:
        text, marks = words() + rng.choice(AROUND), []
        for _ in range(rng.choice([1, 1, 1, 2])):
            if rng.random() < 0.3:
                text += decoy(rng)
            else:
                kind = rng.choice(kinds)
                new = reshaped(kind, rng.choice(own[kind]), rng)
                marks.append((kind, len(text), len(text) + len(new)))
                text += new
            text += rng.choice(AROUND) + words()
        tags = tagged(text, marks)
        out += [(text[a:b], tags[a:b].tolist()) for a, b in windows(text)]
    return out[:n]


def learned(rows: list[tuple[str, list[int]]]) -> Tagger | None:
    """A tagger from windows and their tags, and from variants of them; None where none holds a span."""
    if not any(any(tags) for _, tags in rows):
        return None
    rows = rows + variants(rows, VARIANTS)
    y = [np.array(tags, np.int64) for _, tags in rows]
    mask = np.arange(WINDOW)[None, :] < np.array([len(t) for t in y])[:, None]
    tagger = Tagger()
    tagger.train(padded([classes(window) for window, _ in rows]), padded(y), mask)
    return tagger


def train(texts: list[str]) -> Tagger | None:
    """A tagger from the shapes in texts; None where no text has one."""
    rows = sorted(row for n, text in enumerate(texts) for row in lessons(n, text))
    return learned([row[2:] for row in rows[:WINDOWS]])


def admissible(kind: str, text: str) -> bool:
    if kind == "email":
        at = text.find("@")
        return 0 < at < len(text) - 3 and text[at - 1].isalnum() and text[at + 1].isalnum() and not re.search(r"\s", text) and "." in text[at:]
    if kind == "phone":
        return is_phone(text) and (text[0] == "+" or "(" in text) and text[-1].isdigit()
    return is_ip(text) if kind == "ip" else is_card(text) and text[0].isdigit() and text[-1].isdigit()


def spans_of(first: int, row: np.ndarray, p: np.ndarray) -> dict[tuple[str, int, int], float]:
    """Spans of a path of tags that starts at first, with the least probability of their tags."""
    out = {}
    for start in np.flatnonzero(row % 2 == 1):
        end = start + 1
        while end < len(row) and row[end] == row[start] + 1:
            end += 1
        out[KINDS[row[start] // 2], int(first + start), int(first + end)] = float(p[start:end].min())
    return out


def all_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger | None, at_once: int = 2048) -> list[list[tuple[str, int, int]]]:
    """Base spans and those that the windows of each text, reconciled, add."""
    if tagger is None:
        return base
    places = [(n, a, b) for n, text in enumerate(texts) for a, b in windows(text)]
    offers: dict[int, dict[tuple[str, int, int], float]] = {}
    path: list[tuple[np.ndarray, np.ndarray]] = []  # of the stretch that is being joined
    quarter, first = WINDOW // 4, 0
    for at in range(0, len(places), at_once):
        some = places[at : at + at_once]
        tags, sure = tagger.decode(padded([classes(texts[n][a:b]) for n, a, b in some]), np.array([b - a for _, a, b in some]), np.array([a == 0 for _, a, _ in some]))
        for k, ((n, a, b), row, p) in enumerate(zip(some, tags, sure, strict=True), at):
            if not path:
                first = a
            more = k + 1 < len(places) and places[k + 1][0] == n and places[k + 1][1] < b
            own = slice(quarter if path else 0, 3 * quarter if more else b - a)
            path.append((row[own], p[own]))
            if not more:
                offers.setdefault(n, {}).update(spans_of(first, *map(np.concatenate, zip(*path, strict=True))))
                path = []
    out = []
    for n, (text, taken) in enumerate(zip(texts, base, strict=True)):
        taken = list(taken)
        for (kind, a, b), p in sorted(offers.get(n, {}).items(), key=lambda o: (-o[1], o[0][1:])):
            if p >= SURE and all(b <= s[1] or s[2] <= a for s in taken) and TRIGGER.search(text[a:b]) and admissible(kind, text[a:b]):
                taken.append((kind, a, b))
        out.append(sorted(taken, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def fitted(docs: DataFrame) -> Tagger | None:
    """Trained on texts with a digit or @ of a hash sample of docs; at most WINDOWS windows of them reach the driver."""
    able = docs.where(F.col("text").rlike("[0-9@]"))
    n = able.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, DOCUMENTS / max(n, 1)) * (1 << 30))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch["k"], batch["text"], strict=True):
                yield pd.DataFrame(lessons(int(k), text), columns=["round", "draw", "window", "tags"])

    drawn = able.where(draw).select(F.xxhash64("doc_id", F.lit(10)).alias("k"), "text").mapInPandas(parts, "round long, draw long, window string, tags array<long>")
    return learned([(r["window"], r["tags"]) for r in drawn.orderBy("round", "draw", "window", "tags").limit(WINDOWS).collect()])


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of docs (doc_id, text, ...)."""
    tagger = fitted(docs)

    def make(rows: list[str | None]) -> dict[str, list]:
        texts = [t or "" for t in rows]
        base = [base_spans(t) for t in texts]
        every = all_spans(texts, base, tagger)
        out = {f"n_{k}": [sum(s[0] == k for s in own) for own in base] for k in KINDS}
        return out | {"base_sha256": [hashlib.sha256(written(s).encode()).hexdigest() for s in base], "spans": [written(s) for s in every]}

    new = {f"n_{k}": (T.LongType(), pa.int64()) for k in KINDS} | {c: (T.StringType(), pa.string()) for c in ("base_sha256", "spans")}
    return made_of_text(docs.select("doc_id", "text"), new, make, ROWS).drop("text")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    n_chars, where present, is the new text's length; a null text stays null.
    """
    tagger = fitted(docs)

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def make(rows: list[str | None]) -> dict[str, list]:
        texts = [t or "" for t in rows]
        spans = all_spans(texts, [base_spans(t) for t in texts], tagger)
        return {"text": [None if old is None else clean(t, s) if s else t for old, t, s in zip(rows, texts, spans, strict=True)]}

    out = made_of_text(docs, {"text": (T.StringType(), pa.string())}, make, ROWS)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
