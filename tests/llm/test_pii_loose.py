"""Loose forms: whole tokens, and written-out addresses in every case."""

import random

from papyra.llm import pii


def test_tokens_to_their_end():
    long = "eyJhbGciOi" + "aB3_" * 300
    for text, start in ((f"token={long} end", 6), (f"key sk-{long} end", 4)):
        assert ("secret", start, text.index(" end")) in list(pii._loose_matches(text))


def test_written_out_addresses():
    for address in ("jo (At) example (Dot) org", "jo at example DOT org", "bob at example.com", "bob AT example.com", "jo[aT]example.org"):
        assert [(s, e) for k, s, e in pii._loose_matches(f"see {address}, or") if k == "email"] == [(4, 4 + len(address))]


def test_scan_is_that_of_the_whole_pattern():
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice(["at", " at ", "(AT)", "[at] ", " dot ", ".", "com", " ", "a1", "b-", "<", "x" * 40, "\n"]) for _ in range(rng.randrange(2, 25)))
        want = [m.span() for m in pii.SPELT.finditer(text)]
        assert [(s, e) for k, s, e in pii._loose_matches(text) if k == "email"] == want, text
