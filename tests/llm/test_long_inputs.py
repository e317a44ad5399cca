"""Texts and pages of a megabyte that are hard on patterns: every scan stays linear."""

import re
import time

import pyarrow as pa
import pytest

from driftlane.llm import bpe, html, pii, quality
from driftlane.llm.minhash import shingle_sets, tile_links

MB = 1_000_000
TEXTS = {
    "digits": "ip " + "1" * MB + ".1.1.1", "dotted": "1." * (MB // 2), "card": "1 " * (MB // 2) + "x", "phone": "+1" + " " * MB + "x", "local": "a" * MB + "@" * 10,
    "ats": "a@" * (MB // 2), "one word": "x" * MB, "blank": " " * MB, "cjk": "日本" * (MB // 6),
}
PAGES = {
    "open": "<a " * (MB // 3), "nested": "<div>" * (MB // 5), "names": "<a" * (MB // 2) + ' "x>', "quotes": "<a '\"" * (MB // 5) + ">", "closing": "<div>" * 90_000 + "</p>" * 90_000,
    "attribute": "<a " + "x" * MB + " b>", "class": '<div class="' + "nav_" * (MB // 4) + '.">text</div>', "less": "<" * MB, "digits": "<p>" + "1" * MB, "word": "<p>" + "w" * MB,
}


def within(seconds, call):
    start = time.perf_counter()
    out = call()
    assert time.perf_counter() - start < seconds
    return out


@pytest.mark.parametrize("name", TEXTS)
def test_texts(name):
    text = TEXTS[name]
    within(5, lambda: pii.identifiers(text))
    within(5, lambda: list(shingle_sets(pa.array([text]), 3)))
    within(5, lambda: list(quality.ngrams(pa.array([text]))))


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    within(5, lambda: html.blocks(PAGES[name]))


def test_long_tokens_round_trip():
    encoder = bpe.encoder(bpe.default_vocabulary())
    for text in ("x" * 30_000, "1" * 30_000, "日本" * 10_000, "a\x1cb" * 2_000):
        assert encoder.encode(text) == encoder.library.encode(text, add_special_tokens=False).ids
    memory = bpe.Memory(4_000)
    for k in range(200):
        memory.add(k, b"1234" * (1 + k % 3))
    memory.add("long", b"1" * 2_000)
    assert memory.known({199, 0, "long"}).keys() == {199} and memory.size <= 2_000


def test_addresses_equal_their_pattern():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    text = "1.2.3.4.5.6.7.8 9.9.9 256.1.1.1 0255.00.000.1 1..2.3.4.5 a1.2.3.4b 99.1.1.1.1.1.1 12.34.56.78.9"
    want = [m.span() for m in plain.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    assert [(s, e) for s, kind, e, _ in pii.identifiers(text) if kind == 1] == want
    assert not pii.small("9" * 5000) and pii.small("0" * 5000 + "255") and not pii.small("256")


def test_furniture_by_name():
    def text(page):
        return [t for t, _, waste in html.blocks(page) if not waste]

    for gone in ('<div class="comment">', '<ol class="comment-list">', '<div id="respond">', '<div class="cookie-notice">', '<div class="popup">', '<div class="notice">',
                 '<div class="consent">', '<div class="search">', '<p class="newsletter">', '<p class="share">', '<div class="ad-slot">'):
        tag = gone[1:gone.index(" ")]
        assert text(f"<article><p>Told.</p>{gone}Gone.</{tag}><p>More.</p></article>") == ["Told.", "More."], gone
    for kept in ('<div class="navy">', '<div class="navigator">', '<div class="promote">', '<h2 class="copyright">', '<p class="notice">', '<div class="share-prices">'):
        tag = kept[1:kept.index(" ")]
        assert text(f"<p>Told.</p>{kept}Kept.</{tag}>") == ["Told.", "Kept."], kept
    assert text('<article><section id="legal-issues"><p class="notice-period">A</p></section><h2 id="related-work">B</h2></article>') == ["A", "B"]


def test_tiles_in_blocks(monkeypatch):
    import numpy as np
    import pandas as pd

    from driftlane.llm import minhash

    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.append(base[draw.random(40) < 0.9], draw.integers(0, 1 << 60, draw.integers(0, 4)).astype(np.uint64))) for _ in range(60)]
    rows = pd.DataFrame({"node": range(60), "side": [1, 2] * 30, "shingles": [s.tobytes() for s in sets]})

    def groups(links):
        top = list(range(60))
        for a, b in links:
            a, b = top[a], top[b]
            top = [min(a, b) if t in (a, b) else t for t in top]
        return top

    want = groups([(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 != b % 2
                   and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))])
    for block in (100, 1_000, 4_000_000):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert groups(tile_links(rows, 80)) == want
