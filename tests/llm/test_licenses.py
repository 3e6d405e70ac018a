"""The licence scan against brute force."""

import random
import re
import textwrap

import pytest

from lamina.llm import licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    w = re.findall(WORD, low(text))
    places, labels = [], set()
    for p, label in licenses.PHRASES.items():
        want = p.split()
        for i in range(len(w)):
            if w[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    added, best = set(labels), 1.0 if labels else 0.0
    for t in licenses.TEMPLATES:
        s, width = set(licenses.template_words(t.text)), licenses.window(t.text)
        for i in range(max(len(w) - width, 0) + 1):
            own = set(w[i : i + width])
            if 100 * len(own & s) >= 80 * len(s) and own >= set(t.telling) and not own & set(t.barred):
                added.add(t.label)
                best = max(best, len(own & s) / len(s))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(added)), pytest.approx(best))


def corpus():
    r = random.Random(2)
    rows = [None, "", "\n\n", "MIT license mit LICENSE\nmit license", "the general public. license", "é MIT\tLicense ÀPACHE license apache-license", "x " * 100_000 + "mit license", "The " + " ".join(t.text for t in licenses.TEMPLATES), "license mit the " * 2000]
    for gap in (0, 230, 250, 256, 260, 270, 505, 512):
        rows.append("x " * gap + licenses.TEMPLATES[gap % len(licenses.TEMPLATES)].text + " lesser" * (gap % 3))
        rows.append("x " * gap + licenses.TEMPLATES[gap % 7].text + " y" * 300)
    for _ in range(300):
        w = r.choice(licenses.TEMPLATES).text.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(["word", "the", "License,", "under", "", "lesser", "nc", "new\nline"])
        r.shuffle(w) if r.random() < 0.3 else None
        rows.append("some text\n" + r.choice(["", "and before "]) + " ".join(w) + r.choice(["", "\n", " and after the rest of this"]))
    return rows


def test_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_edges(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "mit license", 1), (None, "mit license", 1), (1, "apache license", 1), (1, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = sorted((r.doc_id or 0, r.base_labels, r.n_base) for r in licenses.license_scan(df).collect())
    assert got == [(0, "mit", 1), (0, "mit", 1), (1, "", 0), (1, "apache", 1)]
    with pytest.raises(ValueError):
        licenses.license_scan(df, templates=[("x", "word " * 2)] * 6000)


def labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.labels for r in licenses.license_scan(rows).collect()}


def test_notices_that_are_wrapped(spark):
    long = [t for t in licenses.TEMPLATES if len(t.text) > 72]
    texts = ["Some words before.\n\n" + "\n".join(textwrap.wrap(t.text, width, initial_indent=mark, subsequent_indent=mark)) + "\nand after" for t in long for width in (40, 72) for mark in ("", " * ", "# ")]
    # the phrase of the base label gpl stands in the lesser one too
    assert labels(spark, texts) == {i: long[i // 6].label.replace("lgpl", "gpl,lgpl") for i in range(len(texts))}


def test_licences_are_told_apart(spark):
    wanted = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY 4.0 International.": "cc-by", "Licensed under CC BY 4.0.": "cc-by",
        "Released under the BSD License.": "", "Released under the zzz License": "", "This software is licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl",
        "This work is licensed under the GNU Affero General Public License, version 3.": "gpl", "Released under the " + "far and wide " * 9 + "MIT-like License.": "",
    }
    # the phrase of the contract's base label gpl stands in the lesser and the affero one too
    assert labels(spark, list(wanted)) == dict(enumerate(wanted.values()))


def test_templates_without_telling_words(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d x y z e"), (3, "e d c b")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(rows, [("t", "a b c d e")]).collect()}
    assert got == {1: ("t", 1.0), 2: ("t", 0.8), 3: ("t", 0.8)}
