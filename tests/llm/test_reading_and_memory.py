"""What the archive reader fetches, and what the encoder remembers of long texts."""

from __future__ import annotations

import hashlib
import random

import pytest

from tidemark.llm import tokens, warc
from tidemark.llm.queries import piece_model


def archive(path, sizes):
    rng = random.Random(3)
    with open(path, "wb") as f:
        for i, n in enumerate(sizes):
            body = rng.randbytes(n).hex()[:n].encode()
            f.write(warc.member(str(i), f"u:{i}", body, hashlib.sha256(body).hexdigest(), None))
    return path.stat().st_size


@pytest.mark.parametrize("split", [1 << 16, 1 << 20, 1 << 23, 1 << 30])
@pytest.mark.parametrize("sizes", [[100 + i % 400 for i in range(6000)], [100, 5_000_000, 3000, 250_000] * 3])
def test_a_range_is_fetched_once(tmp_path, split, sizes):
    size = archive(tmp_path / "a.warc.gz", sizes)
    largest, found = max(sizes) + 1000, []
    for start in range(0, size, split):
        end = min(size, start + split)
        source = warc.Source(str(tmp_path / "a.warc.gz"), end)
        found += [int(r[0]) for r in warc.records_of(source, start, end)]
        assert source.fetched <= 1.1 * (end - start) + largest + 2 * source.step
    assert found == list(range(len(sizes)))


def test_long_units_are_not_kept():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    own = tokens.Encoder(piece_model(), room=1 << 20)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdeéß", k=400_000)) for _ in range(3)] + [" ".join(rng.choices(["one", "two", "three"], k=400_000)), "".join(rng.choices("abc  d", k=300_000)), "x" * 100_000, ""]
    for text, (n, ids, decoded) in zip(texts, own.summaries(texts), strict=True):
        want = library.encode(text)
        assert n == len(want) and ids == ",".join(map(str, want)) and decoded == library.decode(want)
    assert all(len(u) <= tokens.LONG for u in own.known) and set(own.other) <= set(own.known)
    list(own.summaries(["next"]))
    assert own.held <= 2 << 20


def test_what_is_held_is_counted():
    own = tokens.Encoder(piece_model(), room=100_000)
    rng = random.Random(1)
    for _ in range(5):
        list(own.summaries([" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300))]))
    assert 0 < own.held <= 100_000 + 300 * 400 and len(own.known) * 260 <= own.held
