"""Kernels of the training-data operators against brute force, without Spark."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from topicgauge.llm import language, licenses, lines, near, packing, secret_scan, topk, toxicity


def test_every_place_of_a_phrase_and_all_longest_runs():
    automaton = licenses.SuffixAutomaton(licenses.TEMPLATES, licenses.PHRASES)
    phrases = [p for p, _ in automaton.phrases]
    templates = [licenses.tokens(t) for ts in licenses.TEMPLATES.values() for t in ts] + phrases
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    draw = random.Random(4)
    vocabulary = b"under the mit license apache version 2 cc by nc foo licensed".split()
    for _ in range(400):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        places, found = automaton.scan(words)
        assert sorted(places) == sorted(
            (i, n) for n, p in enumerate(phrases) for i in range(len(words)) if words[i : i + len(p)] == p
        )
        ends = []
        for end in range(len(words) + 1):
            size = 0
            while size < end and tuple(words[end - size - 1 : end]) in runs:
                size += 1
            ends.append(size)
        longest = {
            (end - ends[end], ends[end])
            for end in range(1, len(words) + 1)
            if ends[end] >= licenses.MIN_RUN and (end == len(words) or ends[end + 1] <= ends[end])
        }
        assert longest == {(first, size) for first, size, _ in found}


@pytest.mark.parametrize(
    ("text", "labels", "base"),
    [
        (None, "", 0),
        ("", "", 0),
        ("Released under the MIT License.", "mit", 1),
        ("x This work is licensed under the GNU General Public License, version 3. y", "gpl-3", 0),
        ("Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "cc-by-nc", 2),
        ("the license of the work is under the table", "", 0),
    ],
)
def test_labels(text, labels, base):
    automaton = licenses.SuffixAutomaton(licenses.TEMPLATES, licenses.PHRASES)
    found = licenses.scan_text(automaton, text)
    assert (found["labels"], found["n_base"]) == (labels, base)
    assert 0 <= found["score"] <= 1


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(2)
    scores, moves, starts = draw.normal(size=(3, 5, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    sizes = np.array([5, 3, 1])
    found, joint = language.forward_backward(scores, sizes, moves, starts, pairs=True)
    total = np.zeros((3, 3))
    for chain, size in enumerate(sizes):
        mass, each, pairs = 0.0, np.zeros((size, 3)), np.zeros((3, 3))
        for labels in itertools.product(range(3), repeat=int(size)):
            line = starts[labels[0]] + sum(scores[chain, t, y] for t, y in enumerate(labels))
            line += sum(moves[a, b] for a, b in zip(labels, labels[1:]))
            weight = np.exp(line)
            mass += weight
            for t, y in enumerate(labels):
                each[t, y] += weight
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += weight
        assert np.allclose(found[chain, :size], each / mass)
        total += pairs / mass
    assert np.allclose(joint, total)


def test_words_of_a_mixed_line_are_told_apart():
    draw = random.Random(3)
    sounds = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "ung", "ver", "itz"]}
    word = lambda lang: "".join(draw.choice(sounds[lang]) for _ in range(draw.randint(1, 3)))
    names = sorted(sounds)
    chains = [([word(x) for _ in range(20)], names.index(x)) for x in names for _ in range(60)]
    labeller = language.Labeller(language.train(chains, names))
    line = [word("aa") for _ in range(12)] + [word("bb") for _ in range(12)]
    found = labeller.words([line])[0].argmax(axis=1).tolist()
    assert sum(a == b for a, b in zip(found, [0] * 12 + [1] * 12)) >= 23
    assert labeller.texts([None, "", "12 ½ !", "balo mira"]) [:3] == [("und", 0.0)] * 3


def _padding(pieces, ends):
    return sum(min(e for e in ends if e >= x) - x for x in pieces)


def test_bounds_have_the_least_padding():
    draw = random.Random(7)
    for _ in range(60):
        lengths = draw.sample(range(1, 40), draw.randint(1, 8))
        counts = [draw.randint(1, 9) for _ in lengths]
        pieces = [x for x, n in zip(lengths, counts) for _ in range(n)]
        for buckets in (1, 2, 3):
            found = packing.bounds(lengths, counts, buckets)
            assert len(found) <= buckets and max(lengths) in found
            others = itertools.combinations(sorted(lengths), min(buckets, len(lengths)))
            best = min(_padding(pieces, e) for e in others if max(lengths) in e)
            assert _padding(pieces, found) == best
    assert packing.bounds([], []) == []


def test_filters_lose_no_repeat():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    stream = np.concatenate([hashes, hashes[:500]])
    draw.shuffle(stream)
    pair = lines.TwoFilters(1 << 16)
    for start in range(0, len(stream), 700):
        pair.add(stream[start : start + 700])
    held = pair.twice[lines.probes(hashes, 1 << 16)].all(axis=1)
    assert held[:500].all()
    assert held[500:].mean() < 0.2


def _plain_spans(text):
    name = "(?:password|passwd|secret|token|api_?key)"
    assign = [
        (m.start(), m.end(), "assign")
        for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m.group(1)) >= 12
    ]
    access = [m.span() + ("access",) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    runs = [m.span() + ("hex",) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(assign + access + runs, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_pattern_spans_equal_plain_search():
    draw = random.Random(5)
    parts = ["token", "api_key", "secret", "apikey", "=", ": ", " ", '"', "AKIA", "ABCDEF123456789", "é"]
    parts += ["0123456789abcdef", "abcdef", "password", "Zz9+/", "key", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert secret_scan.base_spans(text) == _plain_spans(text)
    assert secret_scan.base_spans("ToKeN='abcdefghijkl'") == [(0, 19, "assign")]
    assert secret_scan.base_spans("to\u212aen=abcdefghijkl") == []  # the Kelvin sign is no k


def test_novel_strings_are_told_from_names():
    novelty = secret_scan.Novelty()
    prose = "Nothing of note happens in these lines of ordinary prose, which go on for a while. " * 2
    secret = prose + "the bearer was Zk3+q9XvT7/wLm2RbYc8Hd1e yesterday. " + prose
    plain = prose + "the bearer was settings.SECRET_KEY.get_value_2 yesterday. " + prose
    assert "novel" in secret_scan.scan_text(secret, novelty)[4]
    assert secret_scan.scan_text(plain, novelty)[4] == ""
    assert secret_scan.scan_text(prose + "Zk3+q9XvT7/wLm2RbYc8Hd1e", novelty)[4] == ""
    assert secret_scan.scan_text(None, novelty) == secret_scan.scan_text("", novelty)


@pytest.mark.parametrize("size", [16, 32, 64, 128, 256, 512, 1024])
def test_random_strings_are_novel_at_every_length(size):
    novelty = secret_scan.Novelty()
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [digits + "ABCDEF", upper + "234567", digits + upper.lower(), digits + upper + upper.lower() + "+/"]
    prose = "Some of the lines around it say little, and others go on about the weather at length. " * 6
    draw = random.Random(size)
    found = dict.fromkeys(itertools.product(alphabets, ["", prose[:256]]), 0)
    for alphabet, before in found:
        for _ in range(20):
            # A digit and a letter are in every string.
            string = "A7".lower() if "a" in alphabet and "A" not in alphabet else "A7"
            string += "".join(draw.choices(alphabet, k=size - 2))
            text = f"{before}Authorization: Bearer {string} {before}"
            at = text.index(string)
            found[alphabet, before] += f"novel:{at}:{at + size}" in secret_scan.scan_text(text, novelty)[4]
    assert min(found.values()) >= 19


def test_long_names_are_not_novel():
    novelty = secret_scan.Novelty()
    names = "alpha2 bravo customer delivery element format gateway handler index7 journal kernel".split()
    draw = random.Random(5)
    for _ in range(20):
        name = "_".join(draw.choices(names, k=60))
        assert secret_scan.scan_text(f"the token {name} there", novelty)[4] == ""


@pytest.mark.parametrize("gap", [0, 1, 32, 33, 40, 47, 48])
def test_reach_after_a_sensitive_word(gap):
    secret = "Zk3+q9XvT7/wLm2R"
    text = "token" + " " * gap + secret
    found = secret_scan.scan_text(text, secret_scan.Novelty())[4]
    assert found == (f"novel:{5 + gap}:{21 + gap}" if gap < secret_scan.REACH else "")


def test_random_strings_without_digits_are_told_from_words():
    novelty = secret_scan.Novelty()
    draw = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    before, after = "The harbour was quiet before the storm; token ", " and nobody had answered the last letters."
    strings = ["".join(draw.choices(letters, k=16)) for _ in range(100)]
    assert sum(secret_scan.scan_text(before + s + after, novelty)[4] != "" for s in strings) >= 90
    for name in ["internationalization", "getAuthorizationHeader", "/usr/local/share/applications"]:
        assert secret_scan.scan_text(before + name + after, novelty)[4] == ""


def _edits(a, b):
    """Distance with swaps of neighbours, each part edited once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    draw = random.Random(6)
    terms = {"abcab": 2.0, "bbaca": 3.0, "cab": 1.0, "aabbcc": 4.0}
    automaton = toxicity.Automaton(terms, {})
    for _ in range(4000):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 8)))
        near_terms = [w for t, w in terms.items() if len(t) >= 5 and len(word) >= 4 and _edits(t, word) == 1]
        expected = (terms[word], True) if word in terms else (max(near_terms), False) if near_terms else None
        assert automaton.judge(word) == expected, word


def test_quotation_counts_apart():
    automaton = toxicity.Automaton({"moron": 5.0}, {"lowei": 4.0})
    abuse = toxicity.features(automaton, "you are a moron and loweitum")
    quote = toxicity.features(automaton, 'the word "moron" is rude')
    assert abuse[0] > 0 and abuse[2] == 0 and quote[0] == 0 and quote[2] > 0
    assert toxicity.features(automaton, "you morron")[1] > 0
    assert toxicity.features(automaton, None) == [0.0] * toxicity.FEATURES


def test_registers_estimate_resemblance():
    draw = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        values = draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
        cut = int(4000 * (1 - share) / 2)
        a, b = np.unique(values[: 4000 - cut]), np.unique(values[cut:])
        found, used = near.estimates(near.registers_of(a)[None], near.registers_of(b)[None])
        assert abs(found[0] - share) < 0.15 and used[0] == near.REGISTERS
    one = near.registers_of(np.array([5], dtype=np.uint64))
    assert (near.filled(one) > 0).all() and (near.registers_of(values[:0]) == 0).all()


def test_reading_stops_with_the_exact_best():
    draw = np.random.default_rng(5)
    for n in (1, 3, 60):
        parts = draw.integers(-256, 256, (n, 6)).astype(float)
        parts[draw.random(n) < 0.3] = parts[0]
        ids = draw.permutation(n) * 10
        lists = topk.SortedLists(ids, parts)
        found = lists.best(ids, parts, 4)
        for i in range(n):
            scores = sorted((-int(parts[i] @ parts[j]), ids[j]) for j in range(n) if j != i)[:4]
            assert [(-s, v) for s, v in scores] == [(s, v) for q, v, s in found if q == ids[i]]
        for depth in range(1, n + 1):
            least, most, unseen = lists.bounds(parts, depth)
            exact = parts @ lists.parts.T
            assert (least <= exact + 1e-6).all() and (exact <= most + 1e-6).all()


def test_a_crafted_run_of_sensitive_words_costs_no_more_than_its_length():
    novelty = secret_scan.Novelty()
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"

    def spent(count):
        text = "".join("token" + "".join(draw.choices(letters, k=5)) for _ in range(count))
        start = time.process_time()
        secret_scan.scan_text(text, novelty)
        return time.process_time() - start

    small = spent(2_000)
    # A megabyte: fifty times the text, and far from 2,500 times the work.
    assert spent(100_000) < max(400 * small, 30)


def test_a_secret_between_words_of_one_run_is_found():
    novelty = secret_scan.Novelty()
    wording = "the_customer_delivery_gateway_handler_of_the_journal_" * 30
    text = f"token{wording}token_Zk3q9XvT7wLm2RbYc8Hd1eQ0token{wording}"
    at = text.index("_Zk3")
    assert secret_scan.scan_text(text, novelty)[4] == f"novel:{at}:{text.index('token' + wording, at)}"


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 1.", ""),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
        ("Licensed under the Apache License, Version 1.0", ""),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("subject to the terms of the Mozilla Public License, v. 1.1. This Source Code Form is", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
        (
            "under the terms of the GNU Lesser General Public License as published by the Free Software "
            "Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "lgpl-2.1",
        ),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
        ("Licensed under CC BY 4.0.", "cc-by"),
    ],
)
def test_decisive_words_tell_licences_apart(text, labels):
    automaton = licenses.SuffixAutomaton(licenses.TEMPLATES, licenses.PHRASES)
    for around in ("", "some words before it, "):
        assert licenses.scan_text(automaton, around + text + " And more words after it")["labels"] == labels


def test_chains_equal_plain_chaining():
    """Covered spans of edited templates, against a search by place in the template."""
    templates = {"one": ["a b c d e f g h i j 2 k l m n"], "two": ["p q r s t u v 3 w x"]}
    automaton = licenses.SuffixAutomaton(templates, {"zz zz": "z"})
    draw = random.Random(8)
    for _ in range(300):
        label = draw.choice(["one", "two"])
        body = templates[label][0].split()
        kept = [w for w in body if draw.random() > 0.08]
        text = [w.encode() for w in ["x1", *kept, "x2"]]
        _, runs = automaton.scan(text)
        spans = [s for s in automaton.chains(runs, text) if s[3] >= licenses.MIN_COVER]
        # Without repeated words a run is a stretch of neighbours in template and text.
        stretches, last = [], None
        for w in kept:
            at = body.index(w)
            if last is not None and at == last + 1:
                stretches[-1].append(at)
            else:
                stretches.append([at])
            last = at
        long = [s for s in stretches if len(s) >= licenses.MIN_RUN]
        number = next(i for i, w in enumerate(body) if w.isdigit())
        held = {x for s in long for x in s}
        expected = len(held) / len(body) if number in held else 0
        # A number between two long runs parts them; none is left over here but the template's own.
        loose = number not in held and body[number] in kept
        if expected >= licenses.MIN_COVER and not loose:
            assert [s[0] for s in spans] == [label] and abs(spans[0][3] - expected) < 1e-9
        else:
            assert spans == []
