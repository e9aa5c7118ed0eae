"""Personal data: spans longer than a window, wherever they lie, and the draw of training windows."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import pii


class Words:
    """Tags every run of other characters than a space as an e-mail, as far as it sees it."""

    def decode(self, x, lengths, begins):
        word = x != pii._class[" "]
        starts = word & np.c_[begins, ~word[:, :-1]]
        return np.where(starts, 1, np.where(word, 2, 0)), np.ones(x.shape)


@pytest.mark.parametrize("local", [3, 20, 24, 25, 60])
@pytest.mark.parametrize("domain", [4, 19, 48, 200])
def test_spans_of_any_length_are_found_whole(local, domain):
    mail = "l" * local + "@" + "\u00fc" * domain + ".example"
    for gap in range(0, 60, 7):
        text = "version 2" + " and" * gap + " " + mail + " words " * 9 + "3"
        at = text.index(mail)
        assert pii.all_spans([text], [[]], Words(), at_once=3) == [[("email", at, at + len(mail))]]


def test_windows_hold_the_run_around_an_at():
    text = "words here " + "a" * 70 + "@" + "b" * 70 + " and more words of no matter at all, far from any trigger"
    covered = {i for a, b in pii.windows(text) for i in range(a, b)}
    assert covered == set(range(0, 164))
    assert len(pii.windows("@" * 20000)) <= 20000 // 24 + 1


def test_training_windows_are_drawn_from_whole_texts():
    text = " ".join(f"n{i} " + "w" * 60 for i in range(100))
    firsts = set()
    for key in range(40):
        rows = pii.lessons(key, text)
        assert sorted(r[2] for r in rows) == sorted(text[a:b] for a, b in pii.windows(text))
        firsts |= {r[2] for r in rows if r[0] == 0}
    assert len(firsts) > 40
    mail = "x" * 40 + "@example.com"
    tags = [r[3] for r in pii.lessons(1, "see " + mail + " now")]
    assert any(t[0] == 2 for t in tags)  # a window that starts inside a span says so
