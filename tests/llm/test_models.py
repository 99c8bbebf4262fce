"""Trained operators: held-out accuracy on planted differences, and rows without anything to learn."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from milldam.llm import langid, learning, quality, textops, toxicity

from .cases import auc, awkward, crc, frame, labels, prose

ALPHABETS = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "opqrstuvéü"}


def language_rows(n=240):
    r, rows = random.Random(1), []
    vocabulary = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 6))) for _ in range(150)] for k, a in ALPHABETS.items()}
    for i in range(n):
        lang = r.choice(list(ALPHABETS))
        rows.append((i, " ".join(r.choice(vocabulary[lang]) for _ in range(r.randint(1, 200))), lang, "s", 1))
    return rows


def test_languages(spark):
    rows = language_rows() + [(1000, None, "aa", None, None), (1001, "", "aa", None, None), (1002, "123 !!", "aa", None, None), (None, "abc abd", None, None, None)]
    got = langid.identify(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for i, _, lang, *_ in rows[:240]:
        assert by[i]["held_out"] == (crc(i, 4) == 2)
    held = [by[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:240] if crc(i, 4) == 2]
    assert np.mean(held) > 0.97
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in got)


def test_language_of_nothing(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    got = langid.identify(frame(spark, [(1, "some text", None, None, None)])).collect()
    assert [(x["lang_pred"], x["score"]) for x in got] == [("und", 0.0)]
    assert langid.identify(frame(spark, awkward())).count() == len(awkward())


@pytest.mark.parametrize("text", [None, "", "12 !", "q", " " * langid.SAMPLE_CHARS + "qqqq", "q " * langid.SAMPLE_CHARS])
def test_rare_language_does_not_win(spark, text):
    """One labelled row with little or no text, or a long one, takes no text from the others."""
    rows = language_rows() + [(i, text, "rare", "s", 1) for i in range(1000, 1020)]
    learned = langid.learned(frame(spark, rows))
    assert ("rare" in learned.languages) == any(ch.isalpha() for ch in text or "")
    got = langid.identify(frame(spark, rows)).collect()
    right = {i: lang for i, _, lang, *_ in rows[:240]}
    assert np.mean([x["lang_pred"] == right[x["doc_id"]] for x in got if x["doc_id"] in right and x["held_out"]]) > 0.97


def test_languages_of_many_scripts(spark):
    """Letters beyond the commonest, of alphabets with thousands of them, still tell languages apart."""
    r, rows = random.Random(4), []
    letters = {"ru": [chr(c) for c in range(0x430, 0x450)], "el": [chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2], "en": list("abcdefghijklmnopqrstuvwxyz")}
    letters |= {"th": [chr(c) for c in range(0xE01, 0xE2F)], "han": [chr(c) for c in range(0x4E00, 0x5400)], "hangul": [chr(c) for c in range(0xAC00, 0xB200)]}
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 5))) for _ in range(300)] for k, a in letters.items()}
    words["han2"] = ["".join(r.choice(letters["han"]) for _ in range(r.randint(2, 5))) for _ in range(300)]
    for i in range(420):
        lang = list(words)[i % 7]
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 40))), lang, "s", 1))
    got = langid.identify(frame(spark, rows)).collect()
    held = [x["lang_pred"] == rows[x["doc_id"]][2] for x in got if x["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_cross_parsing_equals_plain():
    """Phrases by the tables are greedy longest matches in the sample."""
    r = random.Random(2)
    sample = prose(r, 400)
    model = langid.LanguageModel({"x": [sample], "y": [prose(r, 300)]})
    known = "".join(chr(c) for c in model._collapsed(model.symbol[[ord(c) for c in sample]]))
    known = known[: langid.SYMBOLS] + chr(1)

    def phrases(s):
        at = count = 0
        while at < len(s):
            end = at + 1
            while end < len(s) and s[at : end + 1] in known:
                end += 1
            count, at = count + 1, end
        return count

    for n in (1, 2, 9, 60, 700):
        text = prose(r, n)
        sym = "".join(chr(c) for c in model._collapsed(model.symbol[[ord(c) for c in text]]))
        starts = range(min(len(sym), langid.STARTS))
        total = sum(phrases(sym[j : langid.STRETCH]) for j in starts) / len(starts)
        total += sum(phrases(sym[lo : lo + langid.STRETCH]) for lo in range(langid.STRETCH, len(sym), langid.STRETCH))
        raw = text.encode()
        cost, _ = model.costs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert cost[0, 0] == pytest.approx(total * model.bits[0])
        best, score = model.predict(pa.array([text]))
        p = np.exp2(-(cost[0] - cost[0].min()) / 4)
        assert best[0] == cost[0].argmin() and score[0] == pytest.approx(1 / p.sum())


def test_ties_go_to_the_first_language():
    r = random.Random(3)
    sample = prose(r, 200)
    model = langid.LanguageModel({"b": [sample], "a": [sample], "c": [prose(r, 200, "zq")]})
    out = model(pa.array([sample[:40], "12 34", "", None]))
    assert list(out["lang_pred"]) == ["a", "und", "und", "und"] and list(out["score"][1:]) == [0.0] * 3


def scored_rows(n=400, seed=5):
    """Texts of three lines; bad ones have shouting or symbol lines, toxic ones a slur-like stem."""
    r, rows, marks = random.Random(seed), [], []
    for i in range(n):
        bad, toxic = r.random() < 0.4, r.random() < 0.4
        lines = [prose(r, r.randint(5, 20)) + "." for _ in range(3)]
        if bad:
            lines[r.randrange(1, 3)] = " ".join(w.upper() + "!!" for w in prose(r, 25).split())
        if toxic:
            words = lines[0].split()
            words.insert(r.randrange(len(words)), "zqxv" + prose(r, 1))
            lines[0] = " ".join(words)
        rows.append((i, "\n".join(lines), "en", "s", 1))
        marks.append((i, int(not bad), int(toxic)))
    return rows, marks


def held_out(got, marks, column, modulus, held):
    label = {m[0]: m[column] for m in marks}
    own = [x for x in got if x["doc_id"] in label and crc(x["doc_id"], modulus) == held]
    return auc([x["score"] for x in own if label[x["doc_id"]] == 1], [x["score"] for x in own if label[x["doc_id"]] == 0]), own, label


def test_quality(spark):
    rows, marks = scored_rows()
    rows += awkward(9)[3:7]
    got = quality.quality(frame(spark, [(i + 10_000 if k >= 400 and i else i, *r) for k, (i, *r) in enumerate(rows)], clash=True), labels(spark, marks + [(None, 1, 1), (5000, None, None), (1, 1 - marks[1][1], 0)])).collect()
    assert len(got) == len(rows)
    area, own, label = held_out(got, marks, 1, 3, 1)
    assert area > 0.95 and all(x["held_out"] for x in own)
    assert np.mean([x["predicted"] == label[x["doc_id"]] for x in own]) > 0.9
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)


def test_toxicity(spark):
    rows, marks = scored_rows(600)
    extra = [(None, None, None, None, None), (9001, "", "en", None, None), (9002, prose(random.Random(1), 20_000), "en", None, None)]
    got = toxicity.scored(frame(spark, rows + extra, clash=True), labels(spark, marks)).collect()
    assert len(got) == len(rows) + 3
    area, own, _ = held_out(got, marks, 2, 5, 0)
    assert area > 0.9 and all(x["held_out"] for x in own)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)


@pytest.mark.parametrize("marks", [[], [(1, 1, 1)], [(1, 1, 1), (7, 1, 1)]])
def test_nothing_to_learn(spark, marks):
    for f in (quality.quality, toxicity.scored):
        got = f(frame(spark, awkward()), labels(spark, marks)).collect()
        assert len(got) == len(awkward()) and len({x["score"] for x in got}) == 1
        assert f(frame(spark, []), labels(spark, marks)).count() == 0


def test_keep_good_keeps_columns(spark):
    rows, marks = scored_rows()
    df = frame(spark, rows, clash=True)
    out = quality.keep_good(df, labels(spark, marks))
    assert out.columns == df.columns and 0 < out.count() < len(rows)


def test_marginals_equal_enumeration():
    """Forward-backward against the sum over all state sequences."""
    rng = np.random.default_rng(1)
    at = np.array([0, 3, 3, 8, 9])
    u, t = rng.normal(size=9), rng.normal(size=(2, 2))
    fwd, bwd = quality.chains(u, at, t)
    p = learning.sigmoid(fwd + bwd)
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        total, good = 0.0, np.zeros(n)
        for state in range(2**n):
            s = [(state >> k) & 1 for k in range(n)]
            w = np.exp(sum(u[a + k] * s[k] for k in range(n)) + sum(t[s[k], s[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(s)
        assert np.allclose(p[a:b], good / total)


def test_convolution_equals_plain():
    """Scores by tables equal windows of embeddings times filters, padded with zeros."""
    model = toxicity.ToxicityModel(langid.LanguageModel({}))
    text = b"one two THREE four, one"
    ids, _ = toxicity.word_ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    x = model.embed[ids[0]] + model.embed[ids[1]]
    x = np.concatenate([x, np.zeros((toxicity.PAD, toxicity.SIZE))])
    tops = [np.max([sum(x[i + j] @ f[j] for j in range(w)) for i in range(len(x) - toxicity.PAD)], axis=0) for w, f in zip(toxicity.WIDTHS, model.filters)]
    want = np.maximum(np.concatenate(tops) + model.bias, 0) @ model.out + model.const
    assert model._raw([ids])[0] == pytest.approx(want[0], abs=1e-4)


def test_pieces_change_nothing(monkeypatch):
    """Scores and hashes of texts that are cut into many pieces equal those of whole ones."""
    r = random.Random(8)
    texts = [prose(r, n) for n in (1, 0, 7, 3, 400, 1, 1, 64, 63, 65)]
    column = pa.array([*texts, None, "x" * 300 + " " + prose(r, 20)])
    model = toxicity.ToxicityModel(langid.LanguageModel({}))
    model.ready = True
    whole = model(column)["score"]
    data, ends = textops.utf8(column)
    hashes = textops.words(data, ends)[0]
    monkeypatch.setattr(toxicity, "PLACES", 16)
    monkeypatch.setattr(textops, "BLOCK_BYTES", 40)
    assert np.array_equal(model(column)["score"], whole) and len(set(whole)) > 5
    assert np.array_equal(textops.words(data, ends)[0], hashes)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    rows = [(i, f"text {i}", None, None, None) for i in range(300)]
    marks = [(i, i % 2, 0) for i in range(300)]
    got = learning.labelled_sample(frame(spark, rows), labels(spark, marks), "quality", 3, 1, per_class=20)
    assert len(got) == 40 and sum(y for _, y in got) == 20
    assert all(crc(int(t.split()[1]), 3) != 1 and int(t.split()[1]) % 2 == y for t, y in got)


def test_words_of_arrow_slices():
    column = pa.array(["zero", None, "Ab é  b", "", "b"]).slice(1)
    seen = [(lo, hi, len(textops.words(d, e)[0])) for lo, hi, d, e in textops.blocks(column, 3)]
    assert sum(n for *_, n in seen) == 4 and seen[-1][1] == 4
    data, ends = textops.utf8(column)
    h, at, _ = textops.words(data, ends)
    assert at.tolist() == [0, 0, 3, 3, 4] and h[2] == h[3] and h[0] != h[2]


def test_every_labelled_row_teaches_toxicity(spark, monkeypatch):
    """Each labelled row outside the fold reaches the weights or the thresholds once, to its last word, in one shard or many."""
    r, tail = random.Random(12), "q " * learning.SAMPLE_CHARS
    rows = [(i, prose(r, 2) + " " + (tail if i % 40 == 0 else "") + f"word{i}", "en", "s", 1) for i in range(2 * learning.SAMPLE_PER_CLASS + 1600)]
    marks = [(i, 1, int(i % 7 == 0)) for i, *_ in rows]
    docs = frame(spark, rows + rows[:9], clash=True)
    want = sorted((i, t, text) for (i, text, *_), (*_, t) in zip(rows, marks) if crc(i, 5) != 0)
    for limit in (learning.BROADCAST_LABELS, 0):
        monkeypatch.setattr(learning, "BROADCAST_LABELS", limit)
        got = learning.labelled_rows(docs, labels(spark, marks), "toxic", 5, 0).collect()
        assert sorted((x["id"], x["y"], x["text"]) for x in got) == want
    assert len(want) > 2 * learning.SAMPLE_PER_CLASS and sum(1 - t for _, t, _ in want) > learning.SAMPLE_PER_CLASS
    taught, judged = [], []
    trained, thresholds = toxicity._trained, toxicity._set_thresholds
    monkeypatch.setattr(toxicity, "_trained", lambda x, *rest: (taught.append(sorted(t["text"] for t in x.collect())), trained(x, *rest)))
    monkeypatch.setattr(toxicity, "_set_thresholds", lambda x, model: (judged.extend(t["text"] for t in x.collect()), thresholds(x, model)))
    monkeypatch.setattr(toxicity, "STEPS", 60)
    for rows_of_shard in (1 << 20, 900):
        taught.clear(), judged.clear()
        monkeypatch.setattr(toxicity, "SHARD_ROWS", rows_of_shard)
        assert toxicity.fitted(docs, labels(spark, marks)).ready
        assert sorted([*taught[-1], *judged]) == sorted(text for *_, text in want)


def test_toxicity_after_long_beginnings(spark):
    """What tells the labels apart may stand beyond the characters that a sample takes."""
    rows, marks = scored_rows(600)
    rows = [(i, "q" * learning.SAMPLE_CHARS + " " + text, *rest) for i, text, *rest in rows]
    got = toxicity.scored(frame(spark, rows), labels(spark, marks)).collect()
    assert held_out(got, marks, 2, 5, 0)[0] > 0.9


def test_toxicity_in_shards(spark, monkeypatch):
    """Workers of many shards, joined, tell held-out rows apart; a second run gives the same scores."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    rows, marks = scored_rows(2500)
    got = toxicity.scored(frame(spark, rows), labels(spark, marks)).collect()
    assert held_out(got, marks, 2, 5, 0)[0] > 0.9
    again = toxicity.scored(frame(spark, rows[::-1]).repartition(7), labels(spark, marks)).collect()
    assert {x["doc_id"]: x["score"] for x in got} == {x["doc_id"]: x["score"] for x in again}


def test_joined_workers():
    """Filters join by rows; an embedding that one worker moved moves as far as there."""
    start = toxicity.ToxicityModel()
    parts = []
    for rows, bucket, by in ((30, 5, 1.0), (10, 6, -2.0)):
        m = toxicity.ToxicityModel()
        m.embed[bucket] += by
        m.seen[bucket] += 0.5
        m.embed[9] += by
        m.seen[9] += 0.25 * rows / 10
        m.out += by
        m.dense.t = 8
        parts.append(m.changes(start, rows))
    joined = toxicity.ToxicityModel()
    joined.join({k: sum(p[k].astype(float) for p in parts) for k in parts[0]})
    assert np.allclose(joined.embed[[5, 6, 7]], start.embed[[5, 6, 7]] + np.array([[1.0], [-2.0], [0.0]]), atol=1e-5)
    assert np.allclose(joined.embed[9], start.embed[9] + (0.75 - 2 * 0.25), atol=1e-5)
    assert np.allclose(joined.out, start.out + (30 * 1.0 - 10 * 2.0) / 40, atol=1e-5)
    assert np.allclose(joined.seen[[5, 9]], [0.5, 1.0], atol=1e-5) and joined.dense.t == 8


def test_steps_in_pieces(monkeypatch):
    """A batch of training whose texts are cut into pieces learns what it learns from whole ones."""
    r = random.Random(13)
    docs = toxicity.texts_ids(pa.array([prose(r, n) for n in (1, 0, 90, 33, 7)]))
    y, models = np.array([1, 0, 1, 0, 1], dtype=np.float32), []
    for places in (toxicity.PLACES, 16):
        monkeypatch.setattr(toxicity, "PLACES", places)
        models.append(toxicity.ToxicityModel())
        models[-1].train(docs, y, np.ones(5), 3, 0)
    assert not np.allclose(models[0].out, toxicity.ToxicityModel().out)
    for a, b in ((models[0].embed, models[1].embed), (models[0].out, models[1].out), *zip(models[0].filters, models[1].filters)):
        assert np.allclose(a, b, atol=1e-5)


def test_neighbours_change_nothing():
    """A text scores the same alone and between others, to the bit."""
    r = random.Random(16)
    texts = [prose(r, n) for n in (1, 2, 0, 3, 40, 1, 2)]
    model = toxicity.ToxicityModel()
    model.ready = True
    together = model(pa.array(texts))["score"]
    assert together.tolist() == [model(pa.array([t]))["score"][0] for t in texts] and len(set(together)) == len(texts)


def test_thresholds_equal_plain():
    """A threshold has the least sum of both labels' error shares, by trying all."""
    r = random.Random(14)
    cells = {r.randint(-900, 900): (r.randint(0, 4), r.randint(0, 3)) for _ in range(200)}
    n, p = (sum(x[k] for x in cells.values()) for k in (0, 1))
    cost = lambda cut: sum(b for c, (_, b) in cells.items() if c / toxicity.CELLS < cut) / p + sum(a for c, (a, _) in cells.items() if c / toxicity.CELLS >= cut) / n
    assert cost(toxicity._cut(cells)) == pytest.approx(min(cost((c + 0.5) / toxicity.CELLS) for c in range(-902, 902)))
    assert toxicity._cut({3: (2, 0)}) == 0.0


def test_language_words():
    """Languages are told by plain sums of log frequencies; texts without words by none."""
    r = random.Random(15)
    texts = [prose(r, 300), prose(r, 300, "x"), prose(r, 40, "é")]
    count = [np.sum([np.bincount(row, minlength=toxicity.BUCKETS) for row in ids], axis=0) for ids in toxicity.texts_ids(pa.array(texts))]
    model = toxicity.LanguageWords(["a", "b", None], np.array(count))
    data, ends = textops.utf8(pa.array([texts[0][:50], "12 xab", "", "é", texts[1][-60:], None]))
    ids, at = toxicity.word_ids(data, ends)
    told = model.tell(ids, at)
    assert told[[0, 2, 4, 5]].tolist() == [0, -1, 1, -1]
    for k in (0, 1, 3, 4):
        assert model.table[ids[:, at[k] : at[k + 1]]].sum(axis=(0, 1)).argmax() == told[k]
