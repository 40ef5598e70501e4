"""Every place of a notice within its edits is found, whatever stands beside it."""

from __future__ import annotations

import random

from attestry.llm import license_scan as L

GPL2, GPL3 = "gnu general public license version 2", "gnu general public license version 3"


def scan(text):
    return [(s["label"], s["first_word"], s["edits"]) for s in L.Scanner(L.BASE, L.NOTICES, 0.1).scan(text)[2]]


def edited(text, edits, rng):
    """``text`` with letters inside it replaced, all others kept, so that exactly ``edits`` letters differ."""
    at = rng.sample([i for i in range(1, len(text) - 1) if text[i] != " "], edits)
    return "".join("q" if i in at else c for i, c in enumerate(text))


def test_edited_notice_before_exact():
    assert scan(f"gnu generall publik license version 2 {GPL3}") == [("gpl-2.0", 0, 2), ("gpl-3.0", 6, 0)]
    assert scan(f"gnu generall publik license version 2 {GPL2}") == [("gpl-2.0", 0, 2), ("gpl-2.0", 6, 0)]
    assert scan(f"gnu general public license version {GPL2}")[-1] == ("gpl-2.0", 5, 0)


def test_every_place_of_a_list():
    rng = random.Random(7)
    for label, notice in L.NOTICES:
        most = L.edits_allowed(notice, 0.1)
        for order in (range(most, -1, -1), range(most + 1)):
            got = scan(" ".join(edited(notice, e, rng) for e in order))
            step = len(notice.split())
            for i, _ in enumerate(order):
                assert any(abs(w - i * step) <= 1 for _, w, _ in got), (label, i, got)


def test_long_notices_have_all_their_edits():
    """Edits spread evenly, as many as the rate gives, and one more than that."""
    for label, notice in L.NOTICES:
        most = len(notice) // 10
        for n in (most, most + 1):
            at = {len(notice) * (2 * i + 1) // (2 * n) for i in range(n)}
            text = "".join("0" if i in at else c for i, c in enumerate(notice))
            got = [x for x in scan(f"some words {text} and more") if x[0] == label]
            assert [e for _, _, e in got] == ([n] if n == most else []), (label, n, got)


def test_least_edits_against_plain_search():
    rng = random.Random(1)
    for _ in range(500):
        notice, text = ("".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abcd", k=rng.randint(0, 20))))
        row = [0] * (len(text) + 1)
        for i, a in enumerate(notice, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert L._least_edits(L._bits(notice), len(notice), text) == min(row)


def least_edits(notice, text):
    """Least edits from ``notice`` to any part of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(notice, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_notices_against_brute_force():
    """Each notice is found in a text exactly if some part of it is within the notice's edits, with 1 to e and e + 1 edits of all three sorts."""
    rng = random.Random(11)
    scanner = L.Scanner(L.BASE, L.NOTICES, 0.1)
    checked = 0
    for label, notice in L.NOTICES:
        most = L.edits_allowed(notice, 0.1)
        for n in (1, most, most + 1):
            text = notice
            for _ in range(n):
                at = rng.randrange(len(text))
                text = rng.choice([text[:at] + "z" + text[at + 1 :], text[:at] + "z" + text[at:], text[:at] + text[at + 1 :]])
            words = f"some words {text} and more of it".split()
            joined, starts = " ".join(words), [0]
            for w in words:
                starts.append(starts[-1] + len(w) + 1)
            found = {(s["label"], s["edits"]) for s in scanner.near(joined.encode(), starts)}
            want = set()
            for other, phrase in L.NOTICES:
                if (d := least_edits(phrase, joined)) <= L.edits_allowed(phrase, 0.1):
                    want.add((other, d))
            assert {x for x, _ in found} == {x for x, _ in want}, (label, n, found, want)
            assert all(min(e for x, e in found if x == y) == min(e for x, e in want if x == y) for y, _ in want)
            checked += len(want)
    assert checked > 2 * len(L.NOTICES)


def test_time_follows_the_length():
    import time

    began = time.time()
    words, places, spans = L.Scanner(L.BASE, L.NOTICES, 0.1).scan("released under the mit license " * 33_000)
    assert (words, len(places), len(spans)) == (165_000, 33_000, 33_000)
    assert time.time() - began < 60
