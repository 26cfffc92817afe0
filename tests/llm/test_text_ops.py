import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logarc.llm.decontaminate import contaminated_pairs, decontaminate
from logarc.llm.host_rules import _prior, quality_verdicts
from logarc.llm.language import DIMENSIONS, fit_languages, keep_known_languages, predict_languages
from logarc.llm.license_scan import PHRASES, license_scan
from logarc.llm.line_spread import remove_boilerplate

from .fixtures import awkward, doc, empty, frame, prose, words


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- decontamination ---------------------------------------------------------


def items(spark):
    made = [(i, prose(3000 + i, 15 + i)) for i in range(12)]
    made += [(50, None), (51, ""), (52, "Too few"), (53, "six words of a short item"), (54, made[0][1]), (None, prose(3100, 20))]
    return spark.createDataFrame(made, "item_id long, text string"), made


def test_leaks_are_found_and_clean_documents_are_not(spark):
    benchmark, made = items(spark)
    rows, wanted = awkward(), set()
    for i, (item, text) in enumerate(made[:12]):
        parts = tokens(text)
        for k, changed in enumerate([parts, [p.upper() for p in parts], [*parts[:7], "other", *parts[8:]]]):
            own = 1000 + 10 * i + k
            rows.append(doc(own, f"{prose(own, 30)}\n{' '.join(changed)} {prose(own + 1, 25)}"))
            wanted |= {(own, item)} | ({(own, 54)} if item == 0 else set())
        half = parts[: len(parts) // 2]
        rows.append(doc(5000 + i, f"{prose(i, 30)} {' '.join(half)} {prose(i + 1, 25)}"))
        if len(half) >= 11:  # with two other words still a stretch of 13, equal enough
            wanted.add((5000 + i, item))
    rows.append(doc(8000, "well six words of a short item here"))
    wanted.add((8000, 53))
    rows.append(doc(8001, f"x {made[-1][1]} y"))
    wanted.add((8001, None))
    got = contaminated_pairs(frame(spark, rows), benchmark)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found - wanted == set() and wanted - found == set()
    kept = decontaminate(frame(spark, rows), benchmark)
    assert kept.columns == frame(spark, rows).columns
    bad = {d for d, _ in wanted}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in bad)


def test_decontamination_of_empty_tables(spark):
    benchmark, _ = items(spark)
    assert contaminated_pairs(empty(spark), benchmark).collect() == []
    assert decontaminate(frame(spark, awkward()), benchmark.limit(0)).count() == len(awkward())


# --- language ----------------------------------------------------------------

SOUNDS = {"aa": "abkt", "bb": "elmn", "cc": "iöüs"}


def speech(lang, seed, n):
    made = np.random.default_rng(seed)
    return " ".join("".join(made.choice(list(SOUNDS[lang]), 5)) for _ in range(n))


def test_languages(spark):
    train = [doc(i, speech(lang, i, 40), lang) for lang in SOUNDS for i in range(40)]
    model = fit_languages(frame(spark, train + awkward()[3:7] + [doc(None, "abc abc", None)]), per_language=30)
    rows = [doc(1000 + i, speech(lang, 1000 + i, 5 + i), lang) for i, lang in enumerate(list(SOUNDS) * 8)]
    got = {r.doc_id: r for r in predict_languages(frame(spark, rows), model).collect()}
    assert all(got[r[0]].lang_pred == r[2] and not got[r[0]].rejected for r in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = [doc(1, None), doc(2, ""), doc(3, "12 -- 7"), doc(3, "12 -- 7"), doc(4, "@ Ж"), doc(None, "ab")]
    answers = predict_languages(frame(spark, odd), model).collect()
    assert len(answers) == len(odd)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) for r in answers)
    kept = keep_known_languages(frame(spark, rows + odd), model)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in rows}
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_languages_of_few_texts_in_many_copies(spark):
    train = [doc(i, speech(lang, i % 12, 40), lang) for lang in SOUNDS for i in range(1200)]
    train += [doc(i, f"{i} !", "aa") for i in range(200)]  # without n-grams, so of no use
    model = fit_languages(frame(spark, train), per_language=8)
    assert np.bincount(model.language, minlength=3).tolist() == [4, 4, 4]
    assert all(len({c.tobytes() for c in model.centroids[model.language == k]}) == 4 for k in range(3))
    rows = [doc(1000 + i, speech(lang, 1000 + i, 30), lang) for i, lang in enumerate(list(SOUNDS) * 8)]
    got = {r.doc_id: r for r in predict_languages(frame(spark, rows), model).collect()}
    assert all(got[r[0]].lang_pred == r[2] and not got[r[0]].rejected for r in rows)


def test_features_and_cosine_by_hand(spark):
    from pyarrow import array

    from logarc.llm.language import _counts, classify

    counts = _counts(array(["Ab, b", "", None, "ab"]))
    assert counts.shape == (4, DIMENSIONS)
    assert counts.sum(axis=1).tolist() == [3 + 1, 0, 0, 1]  # ab, "b ", " b" and "ab "; two blanks don't count
    train = [doc(i, speech("aa", i, 30), "aa") for i in range(5)]
    model = fit_languages(frame(spark, train), centroids=1)
    _, score, _ = classify(array([train[0][1]]), model)
    vectors = np.log1p(_counts(array([r[1] for r in train]))) * model.idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centre = vectors.mean(axis=0)
    assert abs(score[0] - vectors[0] @ centre / np.linalg.norm(centre)) < 1e-4


def test_no_labelled_rows(spark):
    model = fit_languages(empty(spark))
    assert [r.lang_pred for r in predict_languages(frame(spark, [doc(1, "abc")]), model).collect()] == ["und"]
    assert predict_languages(empty(spark), model).collect() == []


# --- host rules --------------------------------------------------------------


def features(text):
    found = tokens(text)
    seen = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {k for i in range(len(found) - 4) if seen[tuple(found[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    return (
        len(found),
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


RULES = {
    "base": lambda r: r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words,
    "symbols": lambda r: 10 * r.n_symbols > r.n_words,
    "lines": lambda r: 3 * r.n_dup_lines > r.n_lines,
    "length": lambda r: r.n_words and (r.word_chars < 2 * r.n_words or r.word_chars > 15 * r.n_words),
}


def shrunk_rates(rows):
    """The largest shrunk rate of each host."""
    hosts, worst = Counter(r.host for r in rows), {}
    for rule in RULES.values():
        fails = Counter(r.host for r in rows if rule(r))
        alpha, beta = _prior(len(rows), len(hosts), fails.total(), sum(n * (fails[h] / n) ** 2 for h, n in hosts.items()))
        for h, n in hosts.items():
            worst[h] = max(worst.get(h, 0), (fails[h] + alpha) / (n + alpha + beta))
    return worst


def test_counts_and_verdicts(spark):
    rows = awkward() + [
        doc(100, "a b c d e a b c d e f a b c d e\n\nx\nx \nx"),
        doc(101, "# *$ %&|<>\n" * 3 + "é" * 9),
        doc(102, "a a a a a a a"),
        doc(103, "line\n\nline\nline\n"),
    ]
    rows += [doc(200 + i, "bad " * 3, "en", "junk") for i in range(60)] + [doc(300, prose(9, 50), "en", "junk")]
    rows += [doc(400 + i, prose(400 + i, 50), "en", f"h{i % 4}") for i in range(80)]
    got = quality_verdicts(frame(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == Counter((r[0], *features(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_failed)
    rates = shrunk_rates(got)
    assert all(abs(r.host_rate - rates[r.host]) < 1e-9 and r.host_failed == (rates[r.host] > 0.6) for r in got)
    assert rates["junk"] > 0.6 > max(rates[f"h{i}"] for i in range(4))
    assert quality_verdicts(empty(spark)).collect() == []


def test_shrinking_by_hand():
    alpha, beta = _prior(100, 4, 20, 4 * 25 * 0.2**2)
    assert abs(alpha / (alpha + beta) - 20.5 / 101) < 1e-9
    assert alpha + beta == 1000  # hosts alike: the prior is as strong as it gets
    assert sum(_prior(0, 0, 0, 0.0)) >= 1


# --- license scan ------------------------------------------------------------


def license_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_license_labels_and_places(spark):
    texts = [
        "Under CC-BY, all rights reserved. All rights reserved.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the (well-known) Apache License, Version 2.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "licensed under the quick brown fox",
        "cc",
        "by cc",
        "ALL RIGHTS",
        f"{prose(1, 300)} Released under the MIT License. {prose(2, 10)} cc by",
    ]
    rows = awkward() + [doc(500 + i, t) for i, t in enumerate(texts)] + [doc(500, texts[0])]
    got = license_scan(frame(spark, rows)).collect()
    wanted = Counter()
    for r in rows:
        found = license_tokens(r[1])
        places = [(i, label) for i in range(len(found)) for phrase, label in PHRASES if found[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        wanted[(r[0], len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == wanted
    labels = {r.doc_id: r.labels for r in got}
    assert [labels[500 + i] for i in range(9)] == ["cc-by,reserved", "apache-2.0", "apache-2.0", "gpl", "", "", "", "", "cc-by,mit"]
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert license_scan(empty(spark)).collect() == []


# --- line spread -------------------------------------------------------------


def brute_lines(rows, min_sites):
    sites, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(" ") and r[3] is not None:
                sites[line.strip(" ")].add(r[3])
                texts[line.strip(" ")].add(r[1])
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        kept = [x for x in lines if min(len(sites[x.strip(" ")]), len(texts[x.strip(" ")])) < min_sites]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("min_sites", [2, 5, 10])
def test_lines_of_many_sites_go(spark, min_sites):
    rows = awkward()
    for i in range(120):
        footer = [f"footer {k}" for k in range(12) if i % 24 < 2 * k + 2]
        rows.append(doc(100 + i, "\n".join([prose(i, 40), " shared of few" if i < 5 else "own", *footer, ""]), "en", f"h{i % 24}"))
    rows.append(doc(900, "footer 11", "en", "h3"))
    source = frame(spark, rows)
    got = remove_boilerplate(source, min_sites)
    assert got.columns[: len(source.columns)] == source.columns
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute_lines(rows, min_sites)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    assert remove_boilerplate(empty(spark)).collect() == []


def test_short_pages_lose_their_boilerplate_and_copies_stay(spark, tmp_path):
    from logarc.llm.queries import op9_line_spread

    menu = "\n".join(f"entry {k} of the long menu that every site shows" for k in range(6))
    copied = "\n".join(prose(50 + k, 12) for k in range(4))
    rows = [doc(i, f"own {i}\n{menu}", "en", f"s{i % 15}") for i in range(30)]
    rows += [doc(100, menu, "en", "s3")]
    rows += [doc(200 + i, copied, "en", f"s{i % 15}") for i in range(30)]
    rows += [doc(300 + i, f"{copied}\n{menu}", "en", f"s{i % 15}") for i in range(30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = remove_boilerplate(frame(spark, rows))
    wanted = {r[0]: f"own {r[0]}" if r[0] < 100 else "" if r[0] == 100 else copied for r in rows}
    assert {r.doc_id: r.text for r in got.collect()} == wanted
    left = {r.doc_id: (r.n_removed, r.n_left) for r in op9_line_spread(spark, str(tmp_path)).collect()}
    assert left == {r[0]: (0 if 200 <= r[0] < 300 else 6, len(wanted[r[0]])) for r in rows}


def test_words_fixture_is_stable():
    assert words(1, 2) == words(1, 2)
