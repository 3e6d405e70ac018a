"""Personal data by candidate generation and boosted trees, in column expressions only.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns with a
check each. Spark gives matches without places, so a text is also split at them: places are the
sums of what stands before. The patterns are written so that Java matches them without recursion
and without scanning a run of characters twice.

The method adds kinds: high-recall generators propose spans, which may overlap; features of each
span's format and of the text around it go through boosted trees; a span is kept when its score
reaches its kind's threshold, calibrated on held-out examples for ``PRECISION``. Overlapping spans
are settled from the best on; base spans stay, and hide only what lies inside them. The trees are
fitted in the job, on ``EXAMPLES`` made-up examples from a fixed seed (no corpus has labels for
them), and become nested CASE expressions.

Results: one row per document. Null and empty texts have no spans; places are code points, end
exclusive; rows with equal id and text have equal results; extra columns are left out.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Made-up examples (half of them held out), boosting rounds, learning rate, and the precision that thresholds are calibrated for.
EXAMPLES, ROUNDS, RATE, PRECISION, SEED = 3000, 30, 0.3, 0.99, 11
#: The base kinds' patterns, equal in matches to the plain ones.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match of the kind.
SIGNS = {"email": "@", "phone": "+"}
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
    "ssn": r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++ ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,}+",
}
KINDS = [*BASE, *GENERATORS]
SPAN = "array<struct<start: int, end: int, value: string, before: string, after: string>>"
ADDED = "array<struct<start: int, order: int, end: int, kind: string, score: double>>"
NEAR, LOT = 30, 128


def spans(found: str, gaps: str) -> Column:
    """Places of a pattern's matches (columns of them and of the text's parts between them), with what stands around them."""
    gaps, n = F.col(gaps), F.size(found)
    rows = F.zip_with(F.zip_with(F.col(found), F.slice(gaps, F.lit(1), n), lambda v, b: F.struct(v.alias("v"), b.alias("b"))), F.slice(gaps, F.lit(2), n), lambda x, a: F.struct(x["v"].alias("v"), x["b"].alias("b"), F.left(a, F.lit(NEAR)).alias("a")))

    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["v"])
        one = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), F.right(x["b"], F.lit(NEAR)).alias("before"), x["a"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def add_lot(acc: Column, lot: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(lot, F.struct(at.alias("at"), none.alias("out")), add)))

    # growing an array copies it, so places are added up in lots
    lots = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LOT).cast("int")), lambda i: F.slice(rows, i * LOT + 1, F.lit(LOT)))
    state = F.array().cast(f"array<struct<at: int, out: {SPAN}>>")
    short = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    long = F.aggregate(lots, state, add_lot, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))
    return F.when(n > LOT, long).when(n > 0, short).otherwise(none)


def with_spans(rows: DataFrame, patterns: dict[str, str], text: str = "_text") -> DataFrame:
    """Adds a column of spans for each pattern, by its name with ``_s_`` before it."""

    def matched(kind: str) -> Column:
        all_of = F.regexp_extract_all(F.col(text), F.lit(patterns[kind]), F.lit(0))
        return F.when(F.contains(F.col(text), F.lit(SIGNS[kind])), all_of).otherwise(F.array().cast("array<string>")) if kind in SIGNS else all_of

    rows = rows.withColumns({f"_m_{k}": matched(k) for k in patterns})
    rows = rows.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(F.col(text), p, -1)) for k, p in patterns.items()})
    rows = rows.withColumns({f"_s_{k}": spans(f"_m_{k}", f"_g_{k}") for k in patterns})
    return rows.drop(*(f"_{x}_{k}" for k in patterns for x in "mg"))


def _luhn(digits: Column) -> Column:
    def weigh(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), weigh) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def checks() -> dict[str, object]:
    """What a match of each base kind must pass."""
    return {
        "email": lambda v: F.lit(True),
        "ip": lambda v: F.forall(F.split(v, r"\."), _byte),
        "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), _luhn(_digits(v))).otherwise(False),
        "phone": lambda v: F.length(_digits(v)).between(9, 15),
    }


def candidates(rows: DataFrame) -> DataFrame:
    """_id, _hash, kind, start, end, value, before, after: every span that a generator proposes."""
    found = with_spans(rows, GENERATORS)

    def named_as(kind: str) -> Column:
        return F.transform(f"_s_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("start", "end", "value", "before", "after"))))

    named = F.concat(*(named_as(k) for k in GENERATORS))
    return found.select("_id", "_hash", F.explode(named).alias("s")).select("_id", "_hash", "s.*")


def features() -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    v, before, after = F.col("value"), F.lower("before"), F.col("after")
    count = lambda chars: F.length(v) - F.length(F.regexp_replace(v, chars, ""))
    near = lambda pattern: before.rlike(pattern).cast("int")
    return {
        "kind": F.array_position(F.array(*(F.lit(k) for k in GENERATORS)), F.col("kind")).cast("int"),
        "length": F.length(v),
        "digits": count("[0-9]"),
        "lower": count("[a-z]"),
        "upper": count("[A-Z]"),
        "marks": count("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))),
        "turns": F.regexp_count(v, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")),
        "is_hex": v.rlike("^[0-9a-f]+$").cast("int"),
        "says_secret": near("secret|token|passw|api.?key|auth|bearer|credential|private|access"),
        "says_phone": near("phone|tel|call|mobile|fax|cell|contact"),
        "says_number": near("ssn|social|security|tax"),
        "says_bank": near("iban|bank|account"),
        "says_address": near("ip|addr|host|ping"),
        "says_other": near("commit|sha|version|build|order|isbn|invoice|serial|part|ref|model|digest|checksum|revision|blob"),
        "assigned": F.trim(F.col("before")).rlike("[=:][ \"']*$").cast("int"),
        "quoted": after.rlike("^[\"']").cast("int"),
        "in_path": (F.col("before").rlike("[/.\\\\]$") | after.rlike("^[/\\\\]|^\\.[a-z]")).cast("int"),
    }


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[int, str, int]]:
    """(number, text, 1 if its candidate is personal): made up, the same every time."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick(string.ascii_lowercase, r.randint(2, 9))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    secret = lambda: r.choice([pick(hexes, r.choice([32, 40, 64])), pick(mixed, r.randint(20, 48)), "sk-" + pick(mixed, 32), "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(mixed, 36)])
    phone = lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(pick("23456789", 3), pick("0123456789", 3), pick("0123456789", 4))
    good = [
        lambda: f'{r.choice(["token", "api_key", "secret", "password", "access token", "auth", "bearer", "private key"])}{r.choice([" = ", ": ", "=", " "])}{(q := r.choice(["", chr(34), chr(39)]))}{secret()}{q}',
        lambda: f'{r.choice(["call", "phone", "tel", "mobile", "contact", "fax"])}{r.choice([" ", ": "])}{phone()}',
        lambda: f'{r.choice(["ssn", "social security number", "tax number"])}{r.choice([" ", ": "])}{pick("12345678", 3)}-{pick("0123456789", 2)}-{pick("0123456789", 4)}',
        lambda: f'{r.choice(["ip", "host", "address", "from host"])} ' + ":".join(pick(hexes, 4) for _ in range(8)),
        lambda: f'{r.choice(["iban", "bank account", "account"])}{r.choice([" ", ": "])}{r.choice(["DE", "FR", "ES", "GB"])}{pick("0123456789", 2)}' + "".join(" " + pick("0123456789", 4) for _ in range(4)),
        lambda: f"{word()}.{word()} {r.choice(['(at)', '[at]'])} {word()} {r.choice(['(dot)', '[dot]'])} {r.choice(['com', 'org', 'de'])}",
    ]
    bad = [
        lambda: f'{r.choice(["commit", "sha", "digest", "checksum", "revision", "blob"])} {pick(hexes, r.choice([20, 32, 40, 64]))}',
        lambda: f"{word()}{word()}-{word()}-{pick('0123456789', r.randint(1, 4))}-{word()}{word()}",
        lambda: f"see /{word()}/{word()}{pick('0123456789', 2)}{word()}{word()}/{word()}.html",
        lambda: f'{r.choice(["order", "part", "serial", "model", "invoice", "isbn", "ref"])} {r.choice([pick("0123456789", 3) + "-" + pick("0123456789", 2) + "-" + pick("0123456789", 4), phone(), pick(string.ascii_uppercase + string.digits, 18) + "7"])}',
        lambda: f"{word()} {pick('0123456789', 3)} {pick('0123456789', 2)} {pick('0123456789', 4)} {word()}",
        lambda: "at " + ":".join(pick("0123456789", 2) for _ in range(r.randint(4, 6))),
        lambda: f"{word()}{word()}{word()}{pick('0123456789', r.randint(1, 2))}{word()}",
        lambda: f"{pick('0123456789', r.randint(20, 40))}",
    ]
    out = []
    for i in range(n):
        yes = i % 2
        filler = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
        out.append((i, f"{filler()} {r.choice(good if yes else bad)()} {filler()}".strip(), yes))
    return out


class Trees:
    """Boosted trees of depth two for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
        self.start, self.trees = float(np.log(y.mean() / (1 - y.mean()))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)))[1:] for c in x.T]
        score = np.full(len(y), self.start)

        def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
            best, where = 1e-6, None
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f, own in enumerate(cuts):
                for c in own:
                    left = rows[x[rows, f] < c]
                    if 10 <= len(left) <= len(rows) - 10:
                        a, b = g[left].sum(), h[left].sum()
                        gain = a * a / (b + 1) + (g[rows].sum() - a) ** 2 / (h[rows].sum() - b + 1) - whole
                        if gain > best:
                            best, where = gain, (f, float(c))
            return where

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            every = np.arange(len(y))
            leaf = lambda rows: float(rate * g[rows].sum() / (h[rows].sum() + 1))
            root = split(every, g, h)
            if root is None:
                break
            sides = []
            for rows in (every[x[:, root[0]] < root[1]], every[x[:, root[0]] >= root[1]]):
                own = split(rows, g, h)
                sides.append((own, leaf(rows[x[rows, own[0]] < own[1]]), leaf(rows[x[rows, own[0]] >= own[1]])) if own else (None, leaf(rows), 0.0))
            self.trees.append((root, *sides))
            score = score + self._tree(x, self.trees[-1])

    @staticmethod
    def _tree(x: np.ndarray, tree: tuple) -> np.ndarray:
        root, *sides = tree
        values = [np.where(x[:, own[0]] < own[1], a, b) if own else np.full(len(x), a) for own, a, b in sides]
        return np.where(x[:, root[0]] < root[1], *values)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._tree(x, t) for t in self.trees)

    def column(self, names: list[str]) -> Column:
        """The score as an expression of feature columns."""
        out = F.lit(self.start)
        for (f, c), *sides in self.trees:
            values = [F.when(F.col(names[own[0]]) < own[1], a).otherwise(b) if own else F.lit(a) for own, a, b in sides]
            out = out + F.when(F.col(names[f]) < c, values[0]).otherwise(values[1])
        return out


def fitted(spark: SparkSession) -> tuple[Trees, dict[str, float], dict[str, tuple[int, int, int]]]:
    """Trees, each kind's threshold, and (kept, rightly kept, personal) of the held-out examples by kind."""
    made = examples()
    rows = spark.createDataFrame([(i, t) for i, t, _ in made], "_id long, _text string").withColumn("_hash", F.lit(0).cast("long"))
    names = list(features())
    found = candidates(rows).select("_id", F.col("kind").alias("_kind"), *(c.alias(n) for n, c in features().items())).collect()
    found.sort(key=lambda r: (r[0], r[1]))
    x = np.array([[r[n] for n in names] for r in found], float)
    y = np.array([made[r[0]][2] for r in found], float)
    kind = np.array([r[1] for r in found])
    fit = np.array([r[0] // 2 % 2 == 0 for r in found])
    trees = Trees(x[fit], y[fit])
    score, thresholds, quality = trees.score(x), {}, {}
    for k in GENERATORS:
        own = ~fit & (kind == k)
        s, t = score[own], y[own]
        by = np.argsort(-s, kind="stable")
        right = np.cumsum(t[by]) / np.arange(1, len(by) + 1)
        last = np.concatenate((s[by][1:] != s[by][:-1], [True])) if len(by) else np.zeros(0, bool)
        good = np.flatnonzero((right >= PRECISION) & last)
        # half way to the first score that is not kept
        cut = float(s[by][good[-1]]) - 1e-9 if len(good) else float("inf")
        thresholds[k] = cut
        quality[k] = (int((s >= cut).sum()), int(t[s >= cut].sum()), int(t.sum()))
    return trees, thresholds, quality


def added_spans(rows: DataFrame) -> DataFrame:
    """_id, _hash, kind, start, end, score of the candidates that reach their kind's threshold."""
    trees, thresholds, _ = fitted(rows.sparkSession)
    names = [f"_f_{n}" for n in features()]
    scored = candidates(rows).withColumns({f"_f_{n}": c for n, c in features().items()}).withColumn("score", trees.column(names))
    reach = F.lit(False)
    for k, cut in thresholds.items():
        if np.isfinite(cut):
            reach = reach | ((F.col("kind") == k) & (F.col("score") >= cut))
    return scored.filter(reach).select("_id", "_hash", "kind", "start", "end", "score")


def settled(base: Column, added: Column) -> Column:
    """Of the added spans: from the best on, each that no base span holds whole and that overlaps none kept before it.

    A span that reaches beyond a base span stays whole beside it, so that all its characters are reported.
    """
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    beyond = F.filter(added, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    ranked = F.array_sort(F.transform(beyond, lambda s: F.struct((-s["score"]).alias("rank"), s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s.alias("span"))))
    return F.aggregate(F.transform(ranked, lambda r: r["span"]), F.array().cast(ADDED), lambda kept, s: F.when(F.exists(kept, lambda k: overlap(s, k)), kept).otherwise(F.concat(kept, F.array(s))))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of order, start, end, kind) and added (the same with a score) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    base = with_spans(rows, BASE).drop("_text")
    passing = checks()

    def passed(order: int, kind: str) -> Column:
        right = F.filter(f"_s_{kind}", lambda s: passing[kind](s["value"]))
        return F.transform(right, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = base.select("_id", "_hash", F.array_sort(F.concat(*(passed(o, k) for o, k in enumerate(BASE)))).alias("base"))
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    found = added_spans(rows).groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", order.alias("order"), "end", "kind", "score")).alias("added"))
    found = found.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "added")
    joined = base.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.array().cast(ADDED)
    best = settled(F.col("base"), F.coalesce("added", none))
    return joined.select(F.col("_id").alias("doc_id"), "base", best.alias("added"))


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (how many, the method's included) of every document."""
    found = personal_spans(docs)
    bare = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(k) for k in BASE),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", bare))).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
