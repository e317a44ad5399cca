"""Operators against plain versions of the same contract, on small tables of random prose."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftlane.llm import bpe, html, licenses, minhash, neighbours, pii, quality, substrings, toxicity, words

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, share):
    return " ".join("zzz" + w if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    base, passage = prose(rng, 120), prose(rng, 50)
    out += [edited(rng, base, 0.01 * k) for k in range(12)] + [base, base]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)] + [f"{passage} {passage}", " ".join(["same"] * 60)]
    out += [prose(rng, n) for n in range(5)] + [passage, "Über " + base.upper(), "x" * 5000]
    return dict(enumerate(out, 100))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def groups(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain_components(texts, shingle, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    return {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_minhash(docs, texts, shingle, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.linked(docs, shingle, percent).collect()}
    assert got == plain_components(texts, shingle, percent)


def test_minhash_group_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 2_000)
    rng = random.Random(5)
    base = prose(rng, 100)
    rows = [(k, edited(rng, base, 0.01)) for k in range(120)]
    want = plain_components(dict(rows), 3, 85)
    found = minhash.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want
    assert sum(w[1] == 0 for w in want.values()) > 60


@pytest.mark.parametrize("length,seed", [(35, 8), (12, 4)])
def test_substrings(docs, texts, length, seed):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    seen = Counter(tuple(w[k:k + length]) for w in split.values() for k in range(len(w) - length + 1))
    want = {}
    for i, w in split.items():
        gone = {p for k in range(len(w) - length + 1) if seen[tuple(w[k:k + length])] > 1 for p in range(k, k + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substrings.deduplicated(docs, length, seed, texts=True).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_substrings_by_shuffle(docs, monkeypatch):
    want = sorted(map(repr, substrings.deduplicated(docs).collect()))
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, substrings.deduplicated(docs).collect())) == want


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 24))
    rows = [(len(base) * c + k, [float(x) for x in (b + rng.standard_normal(24) * 0.12 * (c % 4))], c % 2) for c in range(8) for k, b in enumerate(base)]
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(4)]
    unit = {i: (np.float32(v).astype(float), label) for i, v, label in rows}
    links = [(a, b) for a, (u, x) in unit.items() for b, (v, y) in unit.items()
             if a < b and x == y and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93]
    degree = Counter(i for link in links for i in link)
    want = groups(unit, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()}
    found = sum(n for n, _ in got.values()) / 2
    assert found >= 0.98 * len(links) and len(links) > 200
    assert all(n <= degree[i] for i, (n, _) in got.items())
    if found == len(links):
        assert {i: c for i, (_, c) in got.items()} == want


def test_bpe_equals_the_library(texts):
    path = bpe.default_vocabulary()
    own, library = bpe.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    given = [*texts.values(), "", "I'll we've it's O'Neil's", "a<|endoftext|>B <|startoftext|>", "ΣΑΣ İst ﬁ 12³ ½ é 🙂🙂\x1c\x85x", "ab" * 3000,
             *("".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 126), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(80)) for _ in range(60))]
    for (ids, n, text), want in zip(own.encode_batch(given), library.encode_batch(given, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids and n == len(want.ids)
        assert text == library.decode(want.ids, skip_special_tokens=False) == own.decode(want.ids)


def test_bpe_long_words_as_short_ones():
    own = bpe.Encoder(bpe.default_vocabulary())
    for word in (b"thething", b"a", b"internationalisation", bytes(range(200, 240))):
        width = max(2, 1 << (len(word) - 1).bit_length())
        assert own.merge_many([word], width)[0].tolist() == own.merge_long(word).tolist()


def plain_identifiers(text):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and max(int(x) for x in m.group().split(".")) > 255:
                continue
            if kind == 2:
                rest = [int(c) for c in digits]
                rest[-2::-2] = [sum(divmod(2 * d, 10)) for d in rest[-2::-2]]
                if not 12 <= len(digits) <= 19 or sum(rest) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_identifiers_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a.b@x.org", "a@b", "@", "a@@b.c", "..@-.-", "x@y.z@w.v", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (656) 555-6510",
             "+44 20 7946 0958", "+1", "é", " ", "word", "4863730426282943", ".", "5@6.7", "\n", "-", "_%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert [f[:3] for f in pii.identifiers(text)] == plain_identifiers(text), text


def test_revealing_terms(spark):
    rng = random.Random(6)
    rows = [(k, f"{prose(rng, 12)} zorblax wrote from zed@example.org {prose(rng, 12)}") for k in range(8)]
    rows += [(100 + k, f"{prose(rng, 20)} common {prose(rng, 5)}") for k in range(20)] + [(200 + k, f"{prose(rng, 9)} common zed@example.org") for k in range(6)]
    rows += [(300, f"{prose(rng, 9)} Zorblax came back"), (301, "ünder zorblax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert cleaned[301] == "ünder [TERM]" and cleaned[300].endswith("[TERM] came back")
    assert "[EMAIL]" in cleaned[0] and "zorblax" not in cleaned[0] and "common" in cleaned[100] and "common" in cleaned[200]
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert [tuple(s) for s in spans[301]] == [(6, 4, 13)]


def test_revealing_terms_inside_the_value(spark):
    rng = random.Random(16)
    rows = [(k, f"{prose(rng, 12)} Zorblax wrote from zorblax@example.org {prose(rng, 12)}") for k in range(8)]
    rows += [(100 + k, f"{prose(rng, 20)} common {prose(rng, 5)}") for k in range(20)] + [(300, f"{prose(rng, 9)} Zorblax came back")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("orblax" not in cleaned[k] and "[EMAIL]" in cleaned[k] for k in range(8))
    assert cleaned[300].endswith("[TERM] came back") and "common" in cleaned[100]
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    assert spans[0].count(0) == 1 and 4 in spans[0] and 4 in spans[300]


def test_revealing_terms_of_few_letters(spark):
    rng = random.Random(26)
    rows = [(k, f"{prose(rng, 12)} the Wu of {prose(rng, 2)} x@example.org {prose(rng, 12)}") for k in range(8)]
    rows += [(100 + k, " ".join(f"{prose(rng, 4)} the" for _ in range(30))) for k in range(5)] + [(300, f"{prose(rng, 9)} Wu came back")]
    cleaned = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Wu" not in cleaned[k] for k in range(8)) and cleaned[300].endswith("[TERM] came back")
    assert all(" the" in cleaned[k] for k in (*range(8), *range(100, 105)))


def test_licenses():
    for rng in (random.Random(k) for k in range(200)):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        match = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in match)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(match, match[1:]))
    assert len(licenses.aligned(list("xaybzc"), list("abc"))) == 3


def test_license_scan(spark):
    rng = random.Random(8)
    rows = [(k, f"{prose(rng, 300)}\n{text}\n{prose(rng, 300)}") for k, text in enumerate(licenses.TEMPLATES.values())]
    rows += [(50, prose(rng, 500)), (51, "Released under the MIT License. x y z. Released under the MIT license!"), (52, "licensed under an agreement")]
    found = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert found[k]["license"].removesuffix("-header") == name.removesuffix("-header") and found[k]["coverage"] == 1.0 and found[k]["start_word"] == 300
    assert found[50]["license"] is found[52]["license"] is None and found[51]["n_notices"] == 2


def test_sibling_licenses(spark):
    said = [
        ("Released under the Apache License", "Apache"), ("Released under the BSD License", "BSD"), ("Released under the GNU General Public License", "GPL"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("Licensed under the Apache License, Version 1.1", "Apache-1.1"), ("Licensed under CC0 1.0", "CC0-1.0"), ("Licensed under the MIT License", "MIT"), ("Released under the Zorb License", None),
        (licenses.TEMPLATES["BSD-3-Clause"], "BSD-3-Clause"), (licenses.TEMPLATES["BSD-2-Clause"], "BSD-2-Clause"), (licenses.TEMPLATES["LGPL-2.1-header"], "LGPL-2.1-header")]
    rows = [(k, f"Some words. {text}. More words") for k, (text, _) in enumerate(said)]
    found = {r["doc_id"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k] for k in range(len(said))] == [name for _, name in said]


def test_every_notice_of_a_text(spark):
    texts = [
        f"Released under the MIT License. Some words between. {licenses.TEMPLATES['GPL-3.0']}.", licenses.TEMPLATES["Apache-2.0-header"], "Licensed under CC BY-NC 4.0",
        "Released under the MIT License and the GNU General Public License", "Licensed under the GNU General Public License, version 2", "nothing"]
    found = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    named = [[n["license"] for n in found[k]["notices"]] for k in range(len(texts))]
    assert named == [["MIT", "GPL-3.0"], ["Apache-2.0-header"], ["CC-BY-NC-4.0"], ["MIT", "GPL"], ["GPL-2.0"], []]
    assert all(r["n_notices"] == len(r["notices"]) for r in found.values())
    assert [tuple(n) for n in found[0]["notices"]] == [("MIT", 1.0, 0, 5), ("GPL-3.0", 1.0, 8, 20)]
    assert (found[0]["license"], found[0]["start_word"], found[0]["end_word"]) == ("GPL-3.0", 8, 20) and found[5]["license"] is None


def test_html(spark):
    shared = "terms of use apply to every page here"
    page = ("<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>menu {k}</a></nav><div>{shared}</div><div id=main-text>{k}x stays here &lt;b&gt;</div>"
            "<article><h1>Title&nbsp;{k}</h1><p><b>first<br>line<p>second {shared}</p><!-- no --><div class='share'>share me</div><script>x('</p>')</script></article>"
            "<div class=comments>nice</div><footer>&copy; {k}</footer>")
    rows = [(k, f"https://h.example/{k}", page.format(k=k, shared=shared)) for k in range(4)]
    found = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert found[k] == f"{k}x stays here <b>\nTitle {k}\nfirst line\nsecond {shared}"


def test_html_names_that_only_look_like_furniture():
    parts = ["<section id='legal-issues'>one</section>", "<h2 id='related-work'>two</h2>", "<div id='search-engines'>three</div>", "<p class='notice-period'>four</p>",
             "<section id='share-prices'>five</section>", "<div id='navigation-systems'>six</div>", "<div class='social-security'>seven</div>"]
    gone = ["<div class='ad'>x</div>", "<div class='share-buttons'>x</div>", "<ul class='social_links'><li>x</ul>", "<span class='ad'>x</span>", "<div id='comments'>x</div>"]
    seven = "one two three four five six seven".split()
    for page in ("<article>{}</article>", "<main><div>{}</div></main>", "<body>{}</body>"):
        assert [t for t, _, waste in html.blocks(page.format("".join(parts + gone))) if not waste] == seven, page
    assert all(waste for _, _, waste in html.blocks("<div class='site-footer'>x</div><div id='cookie-banner'>y</div><div class='widget search-form'>z</div>"))
    inside = "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds<noscript>still here</noscript><object>and this</object>"
    assert [t for t, *_ in html.blocks(f"<article>{inside}</article>")] == ["so x=1 holds", "still here", "and this"]
    assert [t for t, *_ in html.blocks("<noscript>turn scripts on</noscript>")] == []


def test_html_repeats_need_a_share_or_length(spark):
    rng = random.Random(12)
    phrase, often, passage = "as far as anyone can tell", "all rights of every kind kept", prose(rng, 40)
    bodies = [f"{prose(rng, 30)} {phrase if k < 2 else ''} {prose(rng, 30)} {often if k % 3 == 0 else ''} {passage if k in (4, 5) else ''}" for k in range(60)]
    rows = [(k, f"https://h.example/{k}", f"<div>{b}</div>") for k, b in enumerate(bodies)]
    rows += [(100 + k, f"https://h.example/copy{k}", f"<nav>{k}</nav><div>{bodies[7]}</div>") for k in range(2)]
    found = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    plain = {k: " ".join(b.replace(often, "").replace(passage, "").split()) for k, b in enumerate(bodies)}
    assert all(found[k] == plain[k] for k in range(60)) and phrase in found[0] and phrase in found[1]
    assert found[100] == found[101] == plain[7]


def test_quality_tells_junk_apart(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        junk = k % 6 == 0
        text = " ".join([prose(rng, 1)] * 40) if junk and k % 12 else " ".join(w.upper() + "!!" for w in prose(rng, 40).split()) if junk else prose(rng, 60).capitalize() + "."
        rows.append((k, text))
        if k % 2 == 0 or k % 3 == 1:
            labels.append((k, 0 if junk else 1))
    found = {r["doc_id"]: r["kept"] for r in quality.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    wrong = [k for k in range(300) if found[k] == (k % 6 == 0)]
    assert len(wrong) <= 6


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(size=500)] + [7.0] * 5
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 3, 100, 505):
        cut = quality.kth_largest(frame, "x", k)
        assert sum(v >= cut for v in values) == max(k, 5 if k < 5 else k)


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    bad = ["foulword", "nastyish", "grimterm"]
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 8 == 0
        w = prose(rng, 60).split()
        for _ in range(4 * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    found = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200
    assert sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) >= 0.97 * len(held)


def test_toxicity_words_of_few_positives(spark):
    """A word of LEAST positives is a feature however many positives there are; one of fewer is none.

    Buckets that other words happen to share are left out of the comparison.
    """
    import pyarrow as pa

    rng = random.Random(11)
    plain = [(f"{prose(rng, 20)} {'number' if k < 2000 else 'plain'}{k}", int(k < 2000)) for k in range(6000)]
    slurs = [" uncommonslur" * (k < toxicity.LEAST) + " rarerslur" * (k < toxicity.LEAST - 1) for k in range(6000)]
    frame = spark.createDataFrame([(text + slur, positive) for (text, positive), slur in zip(plain, slurs)], "text string, positive int")
    chosen = set(toxicity.chosen_buckets(frame, 2000, 4000).tolist())
    of = lambda texts: {int(b) for *_, buckets in toxicity.features(pa.array(texts)) for b in buckets}
    shared = of([text for text, _ in plain])
    common, rare = of(["uncommonslur"]) - shared, of(["rarerslur"]) - shared
    assert common and common <= chosen
    assert rare and not rare & chosen


def test_windows_and_slices(monkeypatch):
    import pyarrow as pa

    texts = ["a b c", "", None, "d e", "  f\tg\nh i  ", "é ü"]
    def of(size):
        monkeypatch.setattr(words, "SLICE", size)
        out = defaultdict(list)
        for at, found in words.slices(pa.array(texts).slice(0), True):
            own = words.inside(found.first, 2)
            hashes = words.window_hashes(found.hashes(), 2)
            for p in own:
                out[at + np.searchsorted(found.first, p, "right") - 1].append(int(hashes[p]))
        return out
    whole = of(1 << 20)
    assert {k: len(v) for k, v in whole.items()} == {0: 2, 3: 1, 4: 3, 5: 1} and of(1) == whole
