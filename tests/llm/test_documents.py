"""Near duplicates, mixing, quality, language, licenses."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import gbdt, langid, licenses, minhash, mixing

WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "sto", "ven", "ti") for c in ("", "n", "ssa", "lo", "que")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def copies(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t or "") for _, t in rows]
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (a or "") == (rows[j][1] or "") or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    members: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(root(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((doc_id, least[root(i)]) for i, (doc_id, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [text_of(rng, rng.randint(30, 200)) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(10):
        rows += [(100 + i * 20 + j, copies(rng, base[i], j)) for j in range(6)]
    rows += [(500, None), (501, ""), (502, "!!!"), (503, "!!!"), (504, "two words"), (505, "Two, words"), (None, base[20]), (21, base[21]), (21, text_of(rng, 40)), (506, base[1] * 40)]
    return rows


def test_classes_are_those_of_all_pairs(spark, corpus):
    df = spark.createDataFrame([(*r, "x", 1) for r in corpus], "doc_id long, text string, node string, bands int").repartition(5)
    found = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str)
    assert found == brute_classes(corpus)
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    due = {}
    for (doc_id, class_id), in zip(found):
        due.setdefault(class_id, doc_id)
    assert kept.count() == len(set(c for _, c in found)) + 1  # id 21 has two texts, each a class of its own


def test_links_within_a_crowd(spark):
    """Texts of one template, alike by about 0.78, of which few pairs reach 0.8: neither of a pair leads a band."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = " ".join(word() for _ in range(204))
    rows = []
    for i in range(300):
        both = [word() for _ in range(4)]
        for j in range(2 if i < 20 else 1):
            rows.append((len(rows), " ".join([template, *both, *(word() for _ in range(24))])))
    rng.shuffle(rows)
    due = brute_classes(rows)
    assert sum(i != c for i, c in due) == 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str) == due


def test_one_row_of_repeats_stays(spark):
    df = spark.createDataFrame([(1, "same text", "a"), (1, "same text", "b"), (2, "same text", "c"), (None, None, None), (None, None, None)], "doc_id long, text string, source string")
    assert sorted(((r.doc_id, r.text) for r in minhash.deduplicated(df).collect()), key=str) == [(1, "same text"), (None, None)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 9, 60), rng.uniform(0.1, 9, 60)
    s = minhash.signatures(np.concatenate([item, item]), np.concatenate([a, b]), np.array([0, 60, 120]), 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    assert minhash.signatures(item[:0], a[:0], np.array([0, 0]), 8).tolist() == [[0] * 8]


def test_counted_shingles(spark):
    df = spark.createDataFrame([(1, "a b c d e " * 50), (2, "a b c d e " * 100)], "doc_id long, text string")
    assert {r.class_id for r in minhash.near_duplicates(df).collect()} == {1}
    assert {r.class_id for r in minhash.near_duplicates(df, weights="count").collect()} == {1, 2}


# Mixing


def brute_mix(counts, shares, block, quanta):
    """Slot by slot: of all released blocks the one with the earliest deadline, until every row has been placed."""
    done, order = {k: 0 for k in counts}, []
    while any(done[k] * block < n for k, n in counts.items()):
        slot = len(order)
        ready = [(-(-(done[k] + 1) * quanta // shares[k]), k) for k in counts if done[k] * quanta // shares[k] <= slot]
        k = min(ready)[1]
        done[k] += 1
        order.append(k)
    return order


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 2.5}])
def test_mix_is_the_schedule(spark, weights):
    counts = {"a": 300, "b": 41, "c": 7}
    rows = [(i, s) for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, source string, position int, _n int").repartition(3)
    found = mixing.mix(df, weights=weights, block=4, quanta=64, bucket=50).orderBy("position").collect()
    shares = mixing.shares_of(weights or {k: n**0.7 for k, n in counts.items()}, 64)
    order = brute_mix(counts, shares, 4, 64)
    assert [r.position for r in found] == list(range(4 * len(order)))
    assert [r.source for r in found] == [k for k in order for _ in range(4)]
    for k, n in counts.items():  # every row once in each epoch, all of the first
        own = [r for r in found if r.source == k]
        for e in range(max(r.epoch for r in own) + 1):
            ids = [r.doc_id for r in own if r.epoch == e]
            assert len(set(ids)) == len(ids) and (e == max(r.epoch for r in own) or len(ids) == n)
        seen = 0
        for slot, s in enumerate(order, 1):
            seen += s == k
            assert abs(seen - slot * shares[k] / 64) < 1


def test_mix_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "s"), (2, "s")], "doc_id long, source string")
    assert {(r.doc_id, r.source) for r in mixing.mix(df, block=2).collect()} == {(1, None), (None, "s"), (2, "s")}
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(df, weights={"s": 1})
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(df, weights={"s": 1, None: 0})


def test_mix_in_order(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    mixed, rows = mixing.mix_and_length(df)
    assert [r.position for r in mixing.in_order(mixed, rows).collect()] == list(range(rows))


# Quality


def test_trees_learn_and_score(spark):
    rng = random.Random(2)
    good = [text_of(rng, rng.randint(20, 80)).capitalize() + "." for _ in range(150)]
    bad = [" | ".join(text_of(rng, 1) for _ in range(40)) if i % 2 else (rng.choice(WORDS) + " ") * 60 for i in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(900, None, None), (901, "", "x"), (0, good[0], "y"), (None, "null id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300) if i % 3] + [(5, None), (None, 1), (900, 0), (5, 1), (77777, 1)], "doc_id long, quality int")
    trees = gbdt.learn(docs, labels)
    found = gbdt.score(docs, trees).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 3 == 0]
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 150) for r in held]) > 0.97
    assert gbdt.score(docs.limit(0), trees).count() == 0
    none = gbdt.learn(docs, labels.limit(0))
    assert {r.score for r in gbdt.score(docs, none).collect()} == {0.5}


def test_flattened_trees_are_the_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + (x[:, 1] > 0.3) > 0.5).astype(float)
    trees = gbdt.fit(x, y, trees=10, depth=3)

    def walk(row):
        raw = trees.base
        for t in range(10):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
            raw += trees.value[t, node - 7]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


# Language


def brute_language(profiles, text):
    grams: dict = {}
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " ":
                    grams[g] = grams.get(g, 0) + 1
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    order = sorted(grams, key=lambda g: (-grams[g], number(g)))[: profiles.top]
    best = []
    for name in profiles.languages:
        ranks = {int(k): r for r, k in enumerate(profiles.rows[name])}
        best.append((sum(abs(ranks[number(g)] - i) if number(g) in ranks else profiles.top for i, g in enumerate(order)), name))
    return min(best)[1]


def test_language_by_rank_order(spark):
    rng = random.Random(4)
    tongues = {"aa": ["thin", "gath", "wher", "ough"], "bb": ["schö", "keit", "über", "ung"], "cc": ["eaux", "quel", "être", "oui"]}
    make = lambda k, n: " ".join("".join(rng.choice(tongues[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 60)), k) for i, k in enumerate(list(tongues) * 40)] + [(500, None, "aa"), (501, "123 !?", "aa"), (502, "", None), (503, make("bb", 3000), None), (0, "thing", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    profiles = langid.learn(docs, where=F.col("doc_id") < 90)
    found = {(r.doc_id, r.text): r for r in langid.predict(docs, profiles).collect()}
    for doc_id, text, lang in rows:
        r = found[doc_id, text]
        if not text or doc_id == 501:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == brute_language(profiles, text) and 0 <= r.score <= 1
            assert lang is None or doc_id == 0 or r.lang_pred == lang
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_no_language_is_lost(spark, monkeypatch):
    """Languages whose rows are copies are learned from their copies, whatever the bound; profiles in parts give the same languages."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["thin", "gath", "wher"]) + rng.choice(["ough", "ing"]) for _ in range(9)), "aa") for i in range(200)]
    for name, word in (("bb", "schön"), ("cc", "queleau"), ("dd", "zwrk"), ("ee", "ommalu")):
        rows += [(1000 * len(rows) + i % 7, f"{word} {word}{word} ", name) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for key in (None, "doc_id"):
        profiles = langid.learn(docs, key=key, train_rows=5)
        assert profiles.languages == ["aa", "bb", "cc", "dd", "ee"]
    whole = langid.learn(docs, key="doc_id")
    for name in whole.languages:  # the rank order of all n-grams of the language's rows, counted one by one
        grams: dict = {}
        for _, text, lang in rows:
            for word in text.split() if lang == name else []:
                padded = f" {word} "
                for n in (1, 2, 3):
                    for i in range(len(padded) - n + 1):
                        if padded[i : i + n] != " ":
                            grams[padded[i : i + n]] = grams.get(padded[i : i + n], 0) + 1
        number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        assert whole.rows[name] == [number(g) for g in sorted(grams, key=lambda g: (-grams[g], number(g)))[: whole.top]]
    due = sorted((r.doc_id, r.text, r.lang_pred, r.score) for r in langid.predict(docs, whole).collect())
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert sorted((r.doc_id, r.text, r.lang_pred, r.score) for r in langid.predict(docs, whole).collect()) == due
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, whole).collect())


# Licenses


def brute_matched(template, words, at, past):
    """The most words of a template that match, in order, within a window of the text."""
    lcs = [0] * (past - at + 1)
    for a in template:
        row = [0]
        for j, b in enumerate(words[at:past]):
            row.append(lcs[j] + 1 if a == b else max(lcs[j + 1], row[j]))
        lcs = row
    return lcs[-1]


def test_findings_are_those_of_every_place(spark):
    """Notices with words changed, dropped and put in: a text has a finding just where brute force over all windows reaches the coverage."""
    rng = random.Random(13)
    templates = {"long": " ".join(f"l{i}" for i in range(40)), "short": "released under the mit license", "middle": "this work is licensed under some fine license version three"}
    rows = []
    for i in range(120):
        name = rng.choice(list(templates))
        words = templates[name].split()
        for _ in range(rng.randrange(0, len(words) // 3 + 1)):
            at, how = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + 1] = [["zz"], [], [words[at], "zz"]][how]
        rows.append((i, " ".join([*text_of(rng, 12).split(), *words, *text_of(rng, 12).split()])))
    found = {r.doc_id: {x.license: x.coverage for x in r.licenses} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    for i, text in rows:
        words = text.split()
        for name, template in templates.items():
            own = template.split()
            reach = len(own) + 4
            best = max(brute_matched(own, words, a, min(len(words), a + reach)) for a in range(len(words))) / len(own)
            assert (name in found[i]) == (best >= 0.8), (name, text)
            assert name not in found[i] or found[i][name] <= best



def test_whole_license_texts(spark):
    """Texts and headers with another holder, other line breaks and a few words changed are found as such, with their spans; English that is none is not."""
    rng = random.Random(2)
    full = licenses.full_templates()
    names = ["MIT text", "ISC text", "Unlicense text", "BSL-1.0 text", "BSD-2-Clause text", "BSD-3-Clause text", "GPL-2.0 text", "MPL-2.0 text", "AGPL-3.0-or-later header", "Apache-2.0 header"]
    rows = []
    for name in names:
        words = full[name].split()
        for _ in range(len(words) // 60):
            words[rng.randrange(5, len(words) - 5)] = "acme"
        rows.append((len(rows), f"Copyright 2020 {text_of(rng, 30)}. " + " ".join(words) + f" {text_of(rng, 50)}"))
    rows.append((len(rows), "You may use, copy and modify the work under the terms of this agreement, without any warranty"))
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found.pop(len(names)) == []
    for i, name in enumerate(names):
        (x,) = found[i]
        assert x.license == name and x.coverage > 0.95
        assert x.end_char - x.start_char > 0.98 * len(" ".join(full[name].split()))


def test_license_findings(spark):
    filler = text_of(random.Random(6), 60)
    line = "This work is licensed under the GNU General Public License, version 3"
    rows = [
        (1, f"{filler} Released under the MIT license. {filler}"), (2, f"{line}.\n{filler}\n{line}"), (3, line.replace("General ", "")), (4, "licensed under the"), (5, None), (6, ""),
        (7, "ⅷ İ " + line.upper()), (8, (filler + " ") * 300 + line), (1, "Released under the MIT License"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Licenses int")
    found = [(r.doc_id, r.text, r.licenses) for r in licenses.scan(df).collect()]
    for doc_id, text, got in found:
        if doc_id in (4, 5, 6):
            assert got == []
        else:
            assert {x.license for x in got} == {"MIT" if doc_id == 1 else "GPL-3.0"} and len(got) == 1 + (doc_id == 2)
            for x in got:
                span = text[x.start_char : x.end_char].lower()
                assert span.split()[0] in ("released", "this") and span.split()[-1] in ("license", "3")
                assert x.coverage == (pytest.approx(11 / 12) if doc_id == 3 else 1.0)
    assert licenses.scan(df.limit(0)).count() == 0


def test_alignment_finds_most_matches():
    rng = random.Random(7)
    for _ in range(50):
        template = [rng.choice("abcdef") for _ in range(12)]
        words = [w for w in template if rng.random() > 0.15]
        if rng.random() < 0.5 and words:
            words.insert(rng.randrange(len(words)), "x")
        lcs = [[0] * (len(words) + 1) for _ in range(13)]
        for i, a in enumerate(template):
            for j, b in enumerate(words):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a == b else max(lcs[i][j + 1], lcs[i + 1][j])
        matched, first, last = licenses.align(template, words, -12, 12)
        assert lcs[-1][-1] - 2 <= matched <= lcs[-1][-1] and first <= last
