"""Licences, secrets and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from milldam.llm import fingerprints, licenses, secrets

from .cases import awkward, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LICENCES = [
    (50, "Licensed under CC BY-NC 4.0. All rights reserved. all  rights\nRESERVED", "en", "a", 1),
    (51, "the GNU General Public License, version 3. General Public Licenses", "en", "a", 1),
    (52, "cc cc by by cc by; CC-BY all rights all rights reserved", "en", "a", 1),
    (53, "Released under the MIT License. " * 500, "en", "a", 1),
    (54, "rights reserved all general license public ccby", "en", "a", 1),
]


def base_places(words):
    out = []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out)


def idf_of(lists):
    """IDF of the template words over the word lists of all documents."""
    lexicon = {w for _, _, whole in licenses.TEMPLATES for w in whole.split()}
    return {w: max(math.log((len(lists) + 1) / (sum(w in x for x in map(set, lists)) + 0.5)), 1e-6) for w in lexicon}


def all_labels(words, idf):
    """Distinct labels and the best share, by trying every template at every place."""
    out, best = set(), 0.0
    for label, phrase, whole in licenses.TEMPLATES:
        p, t = phrase.split(), whole.split()
        lead = next(j for j in range(len(t)) if t[j : j + len(p)] == p)
        rare = sorted(range(len(t)), key=lambda j: (-idf[t[j]], j))[: licenses.RARE]
        for i in range(len(words)):
            if words[i : i + len(p)] != p:
                continue
            met = [j for j in rare if t[j] in words[max(i - lead + j - licenses.SLACK, 0) : max(i - lead + j + licenses.SLACK + 1, 0)]]
            share = 1.0 if p == t else sum(idf[t[j]] for j in met) / sum(idf[t[j]] for j in rare)
            if share >= licenses.MIN_SHARE:
                out.add(label)
                best = max(best, share)
    return ",".join(sorted(out)), best


def notices():
    """Every notice whole, with a word put in or lost, and its key phrase in other company."""
    r, out = random.Random(5), []
    for label, phrase, whole in licenses.TEMPLATES[licenses.BASE :]:
        words = whole.split()
        if phrase == whole:
            continue
        for k, changed in enumerate((words, [*words[:3], "kindly", *words[3:]], words[1:], words[: len(words) // 2], phrase.split())):
            out.append((1000 + len(out), " ".join([prose(r, r.choice([0, 20])), *changed, prose(r, 20)]), label, "whole" if k == 0 else "", 1))
    return out


def test_licences(spark):
    rows = awkward() + LICENCES + notices()
    got = licenses.scan(frame(spark, rows, clash=True)).collect()
    lists = [WORD.findall((t or "").translate(LOW)) for _, t, *_ in rows]
    idf, want, score = idf_of(lists), [], []
    for (i, *_), w in zip(rows, lists):
        b = base_places(w)
        found, best = all_labels(w, idf)
        want.append((i, len(w), len(b), b[0][0] if b else None, b[-1][0] if b else None, ",".join(sorted({x for _, x in b})), found))
        score.append((repr(i), round(best, 9)))
    keys = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert sorted((tuple(r[k] for k in keys) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in got) == sorted(score)
    labels = {r["doc_id"]: r["labels"].split(",") for r in got}
    for i, _, label, kind, _ in notices():
        if kind:
            assert label in labels[i]


def test_notices_are_told_from_decoys(spark):
    """Two notices share their key phrase and a decoy has nothing but it; words off by a place still count."""
    r = random.Random(6)
    text = {label: whole for label, _, whole in licenses.TEMPLATES}
    phrase = "permission is hereby granted free of charge"
    moved = text["mit-notice"].replace("obtaining", "lawfully obtaining", 1)
    docs = [text["mit-notice"], text["boost-notice"], f"{prose(r, 30)} {phrase} {prose(r, 30)}", moved]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(docs)] + [(10 + i, prose(r, 30), "en", "a", 1) for i in range(50)]
    got = {x["doc_id"]: x["labels"] for x in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == ["mit-notice", "boost-notice", "", "mit-notice"]


def test_licences_of_nothing(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


# -- secrets -------------------------------------------------------------------------------------

KEY = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile(KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_rows():
    r = random.Random(6)
    rows, parts = awkward(), ["password", "PassWd: ", "secret=", "token = \"", "api_key:'", "APIKEY=", "AKIA", "é", " ", "=", ":", "\n", "ſ", "K"]
    for i in range(300):
        text = ""
        for _ in range(r.randint(1, 12)):
            text += r.choice(parts) if r.random() < 0.6 else "".join(r.choice("0123456789abcdefABCXYZ/_-") for _ in range(r.choice([1, 5, 6, 19, 24, 40])))
        rows.append((500 + i, text, None, None, None))
    return rows


def test_base_spans(spark):
    rows = secret_rows()
    got = {}
    for x in secrets.scan(frame(spark, rows, clash=True)).collect():
        got.setdefault(x["doc_id"], []).append(x)
    for i, t, *_ in rows:
        want = base_spans(t)
        for x in got[i] if i is not None else []:
            if i != 2 and i is not None:
                assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(s[1] == k for s in want) for k in range(3))
                assert x["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
                assert listed([s for s in want]) == ",".join(p for p in x["spans"].split(",") if not p.startswith("guess"))


def brute_bits(value):
    """The same minimum over all segmentations, by recursion over the last piece."""
    char = secrets._class_bits(value)
    pieces = secrets._pieces(value)

    def best(j, brute):
        if j == 0:
            return 0.0 if not brute else float("inf")
        options = [best(j - 1, True) + char, best(j - 1, False) + char + (1.0 if j > 1 else 0.0)]
        if not brute:
            options += [best(i, False) + bits + (1.0 if i else 0.0) for i, e, bits in pieces if e == j]
        return min(options)

    return best(len(value), False)


@pytest.mark.parametrize("value", ["abc1", "password", "qwerty12", "x9$K", "aaaa1", "2024ab", "passpass", "zxcvb", "a"])
def test_guess_cost_is_the_minimum(value):
    assert secrets.guess_bits(value) == pytest.approx(brute_bits(value))


def test_guess_cost_tells_secrets_from_words():
    cheap = ["changeme", "password123", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-31", "your_api_key_here", "abcdefghijkl", "example_password"]
    dear = ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "xK9$mP2vQ8zR", "Zp4mN8sW1qLx7"]
    assert max(map(secrets.guess_bits, cheap)) < secrets.LEAST_BITS < min(map(secrets.guess_bits, dear))


def test_context_values(spark):
    rows = [(1, "pwd: xK9$mP2vQ8zR!", None, None, None), (2, "color: xK9$mP2vQ8zR!", None, None, None), (3, "private_key = changeme", None, None, None), (4, "é Authorization: Bearer Zp4mN8sW1qLx7", None, None, None)]
    got = {x["doc_id"]: (x["spans"], x["guess_bits"]) for x in secrets.scan(frame(spark, rows)).collect()}
    assert got[1][0] == "guess:5:18" and got[2] == ("", None) and got[3][0] == "" and got[3][1] < 40
    assert got[4][0] == "guess:24:37"
    assert secrets.scan(frame(spark, [])).count() == 0


def test_names_of_any_length(spark):
    """The key word may stand anywhere in a long name, far from its mark."""
    rows = [(1, "my_token_for_the_production_server_x: Zp4mN8sW1qLx7Qq"), (2, "token" + " " * 70 + ": Zp4mN8sW1qLx7Qq"), (3, "config['api_key'] = \"Zp4mN8sW1qLx7Qq\"")]
    rows += [(4, "x" * 200 + "_secret_" + "y" * 200 + " := Zp4mN8sW1qLx7Qq"), (5, "colour: Zp4mN8sW1qLx7Qq"), (6, "token\n: Zp4mN8sW1qLx7Qq")]
    got = {x["doc_id"]: x["spans"] for x in secrets.scan(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()}
    for i, t in rows[:4]:
        at = t.index("Zp4")
        assert f"guess:{at}:{at + 15}" in got[i]
    assert "guess" not in got[5] + got[6]


def test_words_of_the_corpus_are_cheap(spark):
    """Values made of words that many documents use are no secrets, though no fixed list has them."""
    value = "quorvantzelbriskomnifal"
    rows = [(i, f"quorvant zelbrisk omnifal {i}", None, None, None) for i in range(25)] + [(100, f"private_key: {value}", None, None, None)]
    assert secrets.guess_bits(value) > secrets.LEAST_BITS
    found = {x["doc_id"]: x for x in secrets.scan(frame(spark, rows)).collect()}
    assert found[100]["spans"] == "" and found[100]["guess_bits"] < secrets.LEAST_BITS
    alone = {x["doc_id"]: x["spans"] for x in secrets.scan(frame(spark, rows[-1:])).collect()}
    assert "guess" in alone[100]


def plain_bits(value):
    """The minimum over all segmentations into listed pieces, forwards."""
    char, ends = secrets._class_bits(value), {}
    for i, j, bits in secrets._pieces(value):
        ends.setdefault(j, []).append((i, bits))
    best, brute = [0.0], [float("inf")]
    for j in range(1, len(value) + 1):
        brute.append(min(brute[-1] + char, best[-1] + char + (j > 1)))
        best.append(min([brute[-1], *(best[i] + bits + (i > 0) for i, bits in ends.get(j, ()))]))
    return best[-1]


def test_values_are_judged_whole(spark):
    r = random.Random(8)
    walk = "q"
    while len(walk) < 700:
        walk += r.choice(sorted(secrets._NEXT[walk[-1]]) + [walk[-1]])
    mixed = "".join(r.choice([r.choice(["asdf", "qwerty", "fghj", "password", "2024-01-31", "abcdef", "xxxxx", "P4ss", "tyuuytr"]), chr(r.randint(33, 126))]) for _ in range(150))
    for value in ("x" * 300, "deadbeef" * 50, walk, mixed, walk[:200] + mixed[:90] + walk[300:500], "as" * 200, "/usr/local/data/" * 30):
        assert secrets.guess_bits(value) == pytest.approx(plain_bits(value))
    assert max(secrets.guess_bits(v) for v in ("x" * 300, "todo" * 100, "as" * 4500)) < secrets.LEAST_BITS
    rows = [(1, "token: " + "x" * 300, None, None, None), (2, "token: " + "x" * 300 + "xK9$mP2vQ8zR", None, None, None)]
    got = {x["doc_id"]: x["spans"] for x in secrets.scan(frame(spark, rows)).collect()}
    assert "guess" not in got[1] and "guess:7:319" in got[2]


# -- fingerprints --------------------------------------------------------------------------------


MASK = (1 << 64) - 1


def plain_mix(v):
    v = (v ^ (v >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    v = (v ^ (v >> 27)) * 0x94D049BB133111EB & MASK
    return v ^ (v >> 31)


def plain_names(x):
    """The names of a sequence's phrases."""
    base = 0x9E3779B97F4A7C15
    return [plain_mix((sum(plain_mix(v) * pow(base, j, 1 << 64) for j, v in enumerate(block)) + len(block)) & MASK) for block in plain_level(x)]


def plain_sample(text):
    x, level, found = [ord(c) + 1 for c in text], 0, set()
    while x and (level < fingerprints.FIRST or len(x) > 1):
        level += 1
        x = plain_names(x)
        if level >= fingerprints.FIRST:
            found |= {plain_mix((v + level) & MASK) >> 32 for v in x}
    return sorted(found)[: fingerprints.SAMPLE]


def plain_likeness(x, y):
    if not x or not y:
        return float(x == y)
    smallest = sorted(set(x) | set(y))[: fingerprints.SAMPLE]
    return sum(v in x and v in y for v in smallest) / len(smallest)


def plain_rows(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, near_edited, near_next) of rows with ids of their own."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out, sample = [], {t: plain_sample(t) for t in {r[1] or "" for r in rows}}
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        own = sample[t]
        near = plain_likeness(own, plain_sample(edited)), plain_likeness(own, sample[after])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v:08x}" for v in own), *near))
    return out


@pytest.mark.parametrize("count,part", [(1, 1 << 20), (2, 1 << 20), (9, 300), (60, 2_000), (60, 1 << 20)])
def test_fingerprints_equal_plain(spark, monkeypatch, count, part):
    r = random.Random(count)
    monkeypatch.setattr(fingerprints, "PART_BYTES", part)
    rows = [x if x[0] != 8 else (8, prose(r, 300), *x[2:]) for x in awkward() if x[0] not in (2, None)]
    rows = (rows + [(20 + 7 * i, prose(r, r.randint(0, 90)), None, None, None) for i in range(60)])[:count]
    got = {x["doc_id"]: x for x in fingerprints.fingerprints(frame(spark, rows, clash=True)).collect()}
    assert len(got) == len(rows)
    for i, n, sha, own, edited, after in plain_rows(rows):
        x = got[i]
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"]) == (n, sha, own)
        assert (x["near_edited"], x["near_next"]) == pytest.approx((edited, after))


def test_repeated_and_null_ids(spark):
    rows = awkward()
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(x["n_chars"] for x in got) == sorted(len(t or "") for _, t, *_ in rows)
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0


def plain_level(x):
    """One level of the parsing of a single text, symbol by symbol."""
    mask = (1 << 64) - 1
    mix = lambda v: int(fingerprints.mix(np.array([v & mask], dtype=np.uint64))[0])
    runs = []
    for v in x:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    y = [v if n == 1 else mix(v + n * 0xA0761D6478BD642F) for v, n in runs]

    def toss(cur, left):
        d = cur ^ left
        low = (d & -d).bit_length() - 1
        return 2 * low + ((cur >> low) & 1)

    lab = [toss(v, y[i - 1] if i else v ^ mask) for i, v in enumerate(y)]
    for _ in range(3):
        lab = [toss(v, lab[i - 1] if i else v ^ 1) for i, v in enumerate(lab)]
    cut = [0] + [i for i in range(1, len(y) - 1) if lab[i - 1] < lab[i] > lab[i + 1]]
    return [tuple(y[a:b]) for a, b in zip(cut, cut[1:] + [len(y)])]


@pytest.mark.parametrize("text", ["a", "aaaa", "hello hello world", "mississippi river missouri", "", "xxxyyyzzz" * 4])
def test_level_equals_plain(text):
    x = np.array([ord(c) + 1 for c in text], dtype=np.uint64)
    names, at = fingerprints._level(x, np.array([0, len(x)]))
    blocks = plain_level([int(v) for v in x]) if text else []
    assert len(names) == len(blocks) == at[-1]
    seen = {}
    for n, b in zip(names.tolist(), blocks):
        assert seen.setdefault(b, n) == n
    assert len(set(seen.values())) == len(seen)


def test_equal_substrings_share_names():
    r = random.Random(3)
    body = prose(r, 2000)
    a, b = fingerprints._samples([body, prose(r, 37) + body])
    assert fingerprints.likeness(a, b) > 0.85
    c = fingerprints._samples([prose(r, 2000)])[0]
    assert fingerprints.likeness(a, c) < 0.1
    assert fingerprints.likeness(a, a) == 1.0 and fingerprints.likeness(a[:0], a) == 0.0
    assert (fingerprints.decoded(fingerprints._encoded(a).hex()) == a).all()


def test_block_borders_do_not_matter():
    r = random.Random(4)
    texts = [prose(r, r.randint(0, 300)) for _ in range(50)]
    together = fingerprints._samples(texts)
    assert all((x == fingerprints._samples([t])[0]).all() for x, t in zip(together, texts))
