"""Personal data: base kinds against Python's re; the method by held-out accuracy."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lamina.llm import personal_data as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def fits(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    found, counts = [], []
    for o, (k, p) in enumerate(PLAIN.items()):
        own = [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if fits(k, m[0])]
        counts.append(len(own))
        found += own
    listed = [x[2] for x in sorted(found)]
    return (*counts, hashlib.sha256(",".join(listed).encode()).hexdigest()), listed


def long_texts(n):
    return ["1" * n, "1 " * n, "a." * n + "@b" + ".c" * n, "+1" + "(" * n, "a@" * n, "1." * n, "x" * n + " a@b.co " + "é" * n + " 10.0.0.1", "A0" * n, "a@b.co " * n]


def corpus():
    r = random.Random(4)
    bits = ["a.b@c.de", "a@b.cd_e@f.g", "x@y", "@z.a", "é@b.co", "b@é.co", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.003.0255", "1.2.3", "9.9.9.99999999999999999999", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467", "4539148803436468", "1 2 3 4", "12  34", "+1 (659) 555-3949", "+1", "+12 3", "+1-2-3-4-5-6-7-8-9-0", "++1 23456789", "😀", "a@b.c@d.e", "0.0.0.0@x.y", "-", " ", ".", "+", "7", "42", "word", "\n", "a@b..c", "a@b.c.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    rows = [None, "", *long_texts(2000)]
    return rows + ["".join(r.choice(bits) + r.choice(["", " ", "  ", "-"]) for _ in range(r.randint(1, 25))) for _ in range(500)]


def test_base_against_re(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for r in pd.personal_data(df).collect():
        want, listed = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == want, texts[r.doc_id][:200]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if s.split(":")[0] in PLAIN] == listed
        assert r.n_spans == len(every)


def test_very_long_texts(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(long_texts(200_000)[:-1])], SCHEMA)
    found = {r.doc_id: r for r in pd.personal_data(df).collect()}
    assert found[2].n_email == 1 and found[6].n_email == 1 and found[6].n_ip == 1 and found[5].n_ip == 50_000


def test_method(spark):
    _, thresholds, quality = pd.fitted(spark)
    for kind, (kept, right, personal) in quality.items():
        assert kept and right / kept >= 0.97, (kind, kept, right)
        assert right / personal >= 0.8, (kind, right, personal)
    texts = ['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "plain words and nothing else 12 times", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "call (555) 123-4567 now", "thereandthereforeandnothing1word"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.spans for r in pd.personal_data(df).collect()}
    assert got[0] == "secret:11:51" and got[1] == "" and got[2] == "" and got[3].startswith("local_phone:5:19") and got[4] == ""


def test_edges(spark):
    assert pd.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a@b.co", 1), (None, "a@b.co", 1), (1, None, 2), (1, "b@c.de", 2)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pd.personal_data(df).collect())
    assert got == [(0, 1, "email:0:6"), (0, 1, "email:0:6"), (1, 0, ""), (1, 1, "email:0:6")]


def test_chains_and_spans_beyond_base(spark):
    """What a beaten span overlapped stays; a span that reaches beyond a base span stays whole, one inside it goes."""
    kind = "array<struct<start: int, order: int, end: int, kind: string, score: double>>"
    base = "array<struct<start: int, order: int, end: int, kind: string>>"
    rows = [
        (0, [], [(20, 4, 30, "c", 0.7), (0, 4, 12, "a", 0.9), (10, 4, 22, "b", 0.8)]),
        (1, [(5, 2, 17, "card")], [(0, 4, 40, "secret", 0.9)]),
        (2, [(5, 2, 17, "card")], [(5, 4, 17, "secret", 0.9), (6, 4, 9, "secret", 0.8)]),
        (3, [], [(0, 5, 9, "y", 0.5), (0, 4, 9, "x", 0.5)]),
        (4, [], []),
    ]
    df = spark.createDataFrame(rows, f"id int, base {base}, added {kind}")
    got = {r.id: sorted(s.kind for s in r.kept) for r in df.select("id", pd.settled(F.col("base"), F.col("added")).alias("kept")).collect()}
    assert got == {0: ["a", "c"], 1: ["secret"], 2: [], 3: ["x"], 4: []}


def test_secret_with_a_card_inside(spark):
    text = 'x token = "24be64a4539148803436467cf46b2d7c90f3602a" y'
    found = pd.personal_data(spark.createDataFrame([(1, text, None, None, None)], SCHEMA)).first()
    assert found.n_card == 1 and any(s.startswith("secret:") for s in found.spans.split(",")), found.spans
