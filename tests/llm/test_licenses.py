"""License scan: planted notices, alignment against brute force, odd rows."""

from functools import cache

import pytest
from hypothesis import given, settings, strategies as st

from dqspark.llm import licenses

WORDS = "lorem ipsum dolor the sit amet and of in".split() * 30


@pytest.mark.parametrize("name,notice", [(n, t) for n, some in licenses.NOTICES.items() for t in some])
def test_every_notice_is_found_where_it_stands(name, notice):
    text = " ".join(WORDS) + "\n" + notice.upper() + ".\n" + " ".join(WORDS)
    hits = licenses.scan(text)
    assert [h[0] for h in hits] == [name] and hits[0][1] == 1
    assert text[hits[0][2]:hits[0][3]].upper().startswith(notice[:10].upper())


GNU = {name: licenses.NOTICES[name][1] for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}


@pytest.mark.parametrize("name", GNU)
def test_gnu_headers_keep_their_names(name):
    wrapped = "\n".join(" * " + x for x in GNU[name].split(". "))
    assert [h[0] for h in licenses.scan(f"/*\n{wrapped}\n */")] == [name]
    strange = GNU[name].replace("Public License", "Mozilla Public License")
    assert licenses.scan(strange) == []


@pytest.mark.parametrize("text,name", [
    ("x licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.",
     "CC0-1.0"),
    ("Neither the name of the company nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission.", "BSD-3-Clause")])
def test_notices_that_files_carry(text, name):
    assert [h[0] for h in licenses.scan(text)] == [name]


def test_whole_texts():
    mit = licenses.NOTICES["MIT"][2]
    (hit,) = licenses.scan("MIT License. Copyright (c) 2001 J. Doe\n" + mit)
    assert hit[0] == "MIT" and hit[1] == 1
    assert [h[0] for h in licenses.scan(mit.partition("subject to")[2])] == []       # less than 0.8 of it
    body = mit.partition("including without limitation ")[2]
    (hit,) = licenses.scan(body)
    assert hit[0] == "MIT" and 0.8 <= hit[1] < 1
    two, three = licenses.NOTICES["BSD-2-Clause"][0], licenses.NOTICES["BSD-3-Clause"][1]
    assert [h[0] for h in licenses.scan(two)] == ["BSD-2-Clause"]
    assert [h[0] for h in licenses.scan(three)] == ["BSD-3-Clause"]
    isc, zero = licenses.NOTICES["ISC"][0], licenses.NOTICES["0BSD"][0]
    assert [h[0] for h in licenses.scan(isc)] == ["ISC"] and [h[0] for h in licenses.scan(zero)] == ["0BSD"]


def brute_scan(text):
    """All windows of every notice, at every place."""
    words, spans = licenses.words_of(text)
    hits = []
    for n in licenses.notices()[0]:
        size = len(n.words)
        slack = size // 4 + 1
        if len(set(n.words) & set(words)) < 2:
            continue
        for lo in range(1 - size, len(words)):
            hit = licenses._aligned(n, words, spans, max(0, lo - slack), lo + size + slack)
            if hit:
                hits.append(hit)
    return licenses._best(hits)


@pytest.mark.parametrize("seed", range(12))
def test_scan_against_all_windows(seed):
    import random
    rng = random.Random(seed)
    every = [t for some in licenses.NOTICES.values() for t in some]
    parts = []
    for _ in range(3):
        words = rng.choice(every).split()
        for _ in range(rng.randrange(1 + len(words) // 12)):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice(([], ["other"], [words[at], "lorem"], [words[at], "affero"]))
        parts += [" ".join(words), " ".join(rng.choices(WORDS, k=rng.randrange(30)))]
    text = ". ".join(parts)
    assert [h[:2] for h in licenses.scan(text)] == [h[:2] for h in brute_scan(text)]


def test_repeats_and_gaps():
    one = "Licensed under CC BY-NC 4.0."
    assert [h[0] for h in licenses.scan(f"{one} {one}\n{one}")] == ["CC-BY-NC-4.0"] * 3
    long = licenses.NOTICES["MIT"][2].replace("without restriction,", "")
    (hit,) = licenses.scan("x " + long)
    assert hit[0] == "MIT" and 0.9 < hit[1] < 1
    assert [h[0] for h in licenses.scan(long + " Released under the MIT License")] == ["MIT", "MIT"]


@pytest.mark.parametrize("text", ["", "all the men have rights and seats reserved", "a licensed driver under age",
                                  "GNU General Public License", "Licensed under CC", " ".join(WORDS)])
def test_near_misses(text):
    assert licenses.scan(text) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))

    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(best(i + 1, j), best(i, j + 1), (a[i] == b[j]) and 1 + best(i + 1, j + 1))
    assert len(pairs) <= best(0, 0) and (a != b or len(pairs) == len(a))


def test_rising_is_longest():
    assert licenses._rising([(0, 3), (1, 1), (2, 2), (3, 9), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    assert licenses._rising([]) == []


def test_odd_rows(odd, empty):
    got = licenses.find_licenses(odd).collect()
    assert len(got) == odd.count() and all(r.license is None and r.licenses == [] for r in got)
    assert licenses.find_licenses(empty).collect() == []


def test_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in licenses.find_licenses(documents).collect():
        low = texts[r.doc_id].lower()
        assert (r.n_hits > 0) == any(x in low for x in ("licensed under", "released under", "all rights reserved"))
