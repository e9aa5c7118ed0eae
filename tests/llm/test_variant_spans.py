"""The trained network on forms that no fixed pattern matches, in contexts it never saw, and on numbers that are no personal data."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import pii

CONTEXTS = [
    ("Please contact {} before Friday.", 0), ("{}", 0), ("reach me at {} or leave a message", 0), ("Tel.: {}, Fax on request", 0), ("<td>{}</td>", 0), ("My new number/address is: {}!", 0), ("({})", 0), ("Kundenservice {} (kostenlos)", 0),
    ("'{}' was written on the receipt from 2021", 0), ("Réservations : {} tous les jours", 0), ("see {}\nThanks, Ann", 0), ("billing={};", 0),
]


def luhn_complete(rng, n):
    head = "".join(rng.choices("0123456789", k=n - 1))
    return next(head + d for d in "0123456789" if pii.luhn(head + d))


def spans(seed, n):
    """(kind, text) that the base patterns don't match: mail with foreign letters in its domain, dotted or slashed cards, phones in parentheses."""
    rng = random.Random(seed)
    names = ["jörg.weiß", "ana", "info", "søren_k", "łukasz", "d.meyer", "büro"]
    hosts = ["firma-süd.de", "café-noir.fr", "español.com.mx", "smørrebrød.dk", "žena.cz", "bücher24.at"]
    out = []
    while len(out) < n:
        kind = ("email", "card", "phone")[len(out) % 3]
        if kind == "email":
            text = f"{rng.choice(names)}{rng.choice(['', str(rng.randint(1, 99))])}@{rng.choice(hosts)}"
        elif kind == "card":
            c = luhn_complete(rng, 16)
            text = rng.choice("./").join(c[i : i + 4] for i in range(0, 16, 4))
        else:
            d = "".join(rng.choices("0123456789", k=10))
            text = rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"({d[:4]}) {d[4:7]}-{d[7:]}", f"({d[:3]}){d[3:6]}.{d[6:]}"])
        if not pii.base_spans(text):
            out.append((kind, text))
    return out


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fitted(docs)


def test_forms_that_no_pattern_matches(tagger):
    rng = random.Random(40)
    texts, want = [], []
    for kind, text in spans(41, 300):
        form = rng.choice(CONTEXTS)[0]
        texts.append(form.format(text))
        want.append((kind, form.index("{}"), form.index("{}") + len(text)))
    found = pii.all_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    hits = sum(w in f for w, f in zip(want, found, strict=True))
    extra = sum(len([s for s in f if s != w]) for w, f in zip(want, found, strict=True))
    for kind in ("email", "card", "phone"):
        own = [w in f for w, f in zip(want, found, strict=True) if w[0] == kind]
        print(kind, sum(own), len(own))
    print("hits", hits, "others", extra)
    assert hits >= 0.9 * len(want) and hits >= 0.95 * (hits + extra)


def test_bare_spans_without_their_patterns(tagger):
    """What the patterns find, left to the network alone."""
    texts = ["a.b@c.de", "+49 30 1234567", "192.168.0.1", "4111 1111 1111 1111", "4111111111111111", "write joe@mail.example.org now", "(415) 555-0132"]
    found = pii.all_spans(texts, [[] for _ in texts], tagger)
    print(found)
    assert sum(bool(f) for f in found) >= 6


def test_other_numbers_are_left_alone(tagger):
    rng = random.Random(3)
    forms = ["on {:02d}/{:02d}/2019 we met", "version {}.{}.7 of it", "pages {}-{} (2nd ed.)", "it cost ${}.{:02d} (plus tax)", "{}:{:02d} o'clock, room ({})", "@user{} replied to @other{}", "Table {} ({} rows)", "{} + {} = 3"]
    texts = [rng.choice(forms).format(*(rng.randint(1, 28) for _ in range(3))) for _ in range(300)]
    found = pii.all_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    assert sum(map(len, found)) <= 1
