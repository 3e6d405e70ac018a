"""Column functions over names, numbers and texts; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a second copy of a model name, and how long its key must be to match loosely.
JUNK_WORDS, MIN_ALIAS_KEY = ("REDUNDANT", "DUPLICATE"), 3
#: Names written in their own way, names read letter by letter, and the length of a teaser.
SPECIAL_NAMES = {"MCLAREN": "McLaren", "BRIGHTDROP": "BrightDrop"}
ACRONYMS = "AMG AWD CLA CLS EQA EQB EQE EQS ESV FWD GLA GLB GLC GLE GTE GTI GTO GTS HEV IROC PHEV RWD SLK SRT STI SUV TRD TTS USA".split()
TEASER_CHARS = 110
#: Words common to two texts up to which each is counted by a pass of its own.
COUNTED_WORDS = 8
#: Words the analyser drops.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what stands inside a lambda is otherwise worked out anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_model(raw: Column) -> Column:
    """Upper case, hyphens as spaces, single spaces; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.replace(F.upper(raw), F.lit("-"), F.lit(" ")), r"\s+", " ")), F.lit(""))


def compact_model(raw: Column) -> Column:
    """Upper case without hyphens and spaces."""
    return F.coalesce(F.translate(F.upper(raw), "- ", ""), F.lit(""))


def is_junk(model: Column) -> Column:
    return F.coalesce(model.rlike(rf"^(?:{'|'.join(JUNK_WORDS)})\s"), F.lit(False))


def without_junk(model: Column) -> Column:
    """The name without a leading word that marks a copy."""
    return F.regexp_replace(model, rf"^(?:{'|'.join(JUNK_WORDS)})\s+", "")


def revision_stem(number: Column, own_id: Column) -> Column:
    """The number without its revision mark; without a number, a key of its own.

    A dash and two digits count only behind a long campaign number, a letter only behind a digit.
    """
    n = F.regexp_replace(F.upper(number), r"^\s+|\s+$", "")
    return (
        F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit("id:"), own_id))
        .when(n.rlike(r"^[A-Z]?[0-9]{6,}-[0-9]{1,2}$"), F.regexp_replace(n, r"-[0-9]{1,2}$", ""))
        .when(n.rlike(r"^.*[0-9][A-Z]$"), F.regexp_replace(n, r"[A-Z]$", ""))
        .otherwise(n)
    )


def csv_list(value: str | None) -> list[str] | None:
    """A comma list from a request, blanks dropped; empty means no filter."""
    return [v.strip() for v in (value or "").split(",") if v.strip()] or None


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of a-z and 0-9 without stop words: the analyser of text search."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))  # ``split`` compiles its pattern anew for every row
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def matches_all(lexemes: Column, terms: Sequence[str]) -> Column:
    """All terms occur; no term matches nothing."""
    found = F.lit(bool(terms))
    for term in terms:
        found = found & F.array_contains(lexemes, term)
    return found


def text_rank(lexemes: Column, terms: Sequence[str]) -> Column:
    """Sum over the terms of ln(1 + times the term occurs) (C17)."""

    def times(term: str) -> Column:
        return F.size(F.filter(lexemes, lambda w: w == term)).cast("double")

    return sum((F.log1p(times(term)) for term in terms), F.lit(0.0))


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    """Any tag equals a wanted one, whatever the case."""
    low = [w.lower() for w in wanted]
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(*low)), F.lit(False))


def matched_keywords(summary: Column, keywords: Column) -> Column:
    """The keywords that stand in the summary."""
    return F.filter(keywords, lambda k: F.coalesce(F.contains(F.lower(summary), F.lower(k)), F.lit(False)))


def lenient_timestamp(raw: Column) -> Column:
    """The first format that reads the text, else null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in formats])


def compose_input(summary: Column, symptoms: Column, systems: Column, components: Column) -> Column:
    """Summary, then labelled tags, one to a line, blank lines left out."""
    lines = [F.coalesce(summary, F.lit(""))]
    for label, tags in (("Symptoms", symptoms), ("Systems", systems), ("Components", components)):
        lines.append(F.when(F.size(tags) > 0, F.concat(F.lit(f"{label}: "), F.array_join(tags, ", "))).otherwise(""))
    return F.array_join(F.filter(F.array(*lines), lambda p: F.trim(p) != ""), "\n")


def _display_word(word: Column) -> Column:
    up = F.upper(word)
    special = F.lit(None).cast("string")
    for name, shown in SPECIAL_NAMES.items():
        special = F.when(up == name, shown).otherwise(special)
    vowel = up.rlike("[AEIOU]")
    return (
        F.when(special.isNotNull(), special)
        .when(up.isin(*ACRONYMS), up)
        .when(up.rlike("^[A-Z]*[AEIOU][A-Z]*[0-9]+$") & up.rlike("^[A-Z]{4,}[0-9]+$"), F.concat(F.substring(up, 1, 1), F.lower(F.substr(up, F.lit(2)))))
        .when(up.rlike("[0-9]") | (F.length(up) <= 2) | ~vowel, up)
        .otherwise(F.concat(F.substring(up, 1, 1), F.lower(F.substr(up, F.lit(2)))))
    )


def display_name(raw: Column) -> Column:
    """Title case, with codes, acronyms and special names kept."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(F.split(p, "-"), _display_word), "-")), " ")


def opening(text: Column, chars: int = TEASER_CHARS) -> Column:
    """The first words of a text, cut at a word, with an ellipsis."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.regexp_replace(F.substring(one, 1, chars), r" [^ ]*$", ""), r"[,;:.]+$", "")
    return F.when(F.length(one) <= chars, one).otherwise(F.concat(cut, F.lit("…")))


def safe_link(url: Column) -> Column:
    """Only http and https."""
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def archive_name(url: Column) -> Column:
    """A file name that is safe on any disk."""
    return F.substring(F.regexp_replace(url, "[^A-Za-z0-9._-]+", "_"), 1, 200)


def checksum(value: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def lock_key(value: Column) -> Column:
    """The first 8 bytes of SHA-256 as a signed number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, -10).cast("long")


def storable(text: Column) -> Column:
    """Without NUL and lone surrogates."""
    return F.regexp_replace(text, r"[\x00\x{D800}-\x{DFFF}]", "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def letter_share(text: Column) -> Column:
    """Letters among characters that are not white space."""
    return F.round(F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(F.regexp_count(text, F.lit(r"\S")), F.lit(1)), 3)


def extraction_yield(pages: Column, low: float) -> Column:
    """What the texts of a document's pages give, and whether that is enough to keep them.

    Below ``low`` characters a page the text is left out and the method is another one; a document
    without pages has an error and nothing else. Pages with less than 50 characters count as empty.
    """
    whole = storable(F.array_join(pages, "\n", ""))
    n, total = F.size(pages), F.length(whole)
    per_page = F.round(total / n, 2)
    found = F.struct(
        n.alias("page_count"), total.alias("char_count"), per_page.alias("chars_per_page"), F.when(total > 0, F.round(F.regexp_count(whole, F.lit(r"\p{L}")) / total, 3)).otherwise(0.0).alias("alpha_ratio"),
        F.size(F.filter(pages, lambda p: F.length(F.coalesce(p, F.lit(""))) < 50)).alias("empty_pages"), F.when(per_page < low, "vision-fallback").otherwise("text").alias("method"),
        F.when(per_page >= low, whole).alias("text"), F.lit(None).cast("string").alias("error"),
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("page_count", "int"), ("char_count", "int"), ("chars_per_page", "double"), ("alpha_ratio", "double"), ("empty_pages", "int"), ("method", "string"), ("text", "string"))]
    return F.when(F.coalesce(n, F.lit(0)) > 0, found).otherwise(F.struct(*nothing, F.lit("zero pages").alias("error")))


def plural(n: Column, word: str) -> Column:
    """A number with its noun."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def revision_note(superseded: Column) -> Column:
    """How many revisions an item stands for, where there are more than itself."""
    return F.when(superseded > 0, F.concat(F.lit(" (latest of "), (superseded + 1).cast("string"), F.lit(" revisions)"))).otherwise("")


def alert_subject(n_items: Column, labels: Column) -> Column:
    """A subject line from the number of new bulletins and the labels of the cars."""
    one = F.when(F.size(labels) == 1, F.get(labels, F.lit(0)))
    ready = F.coalesce(F.concat(F.lit("Your "), one, F.lit(" is ready to read")), F.lit("Your cars are ready to read"))
    return F.when(n_items > 0, F.concat(plural(n_items, "new bulletin"), F.lit(" for your "), F.coalesce(one, F.lit("cars")))).otherwise(ready)


def guarded_citations(answer: Column, retrieved: Column) -> Column:
    """valid and hallucinated citations in order of first use, and the answer without the latter."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[\s*(\d{6,})\s*\]"), 1))
    bad = F.array_except(cited, retrieved)
    clean = F.aggregate(bad, answer, lambda acc, b: F.regexp_replace(acc, F.concat(F.lit(r"\[\s*"), b, F.lit(r"\s*\]")), F.lit("")))
    return F.struct(
        F.trim(F.regexp_replace(clean, r"[ \t]{2,}", " ")).alias("clean"), F.filter(cited, lambda c: F.array_contains(retrieved, c)).alias("valid"), bad.alias("hallucinated")
    )


def norm_set(values: Column) -> Column:
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))  # drops nulls too


def sets_agree(a: Column, b: Column) -> Column:
    """Similarity of two sets without repeats or nulls; two empty ones agree."""
    both = F.size(a) + F.size(b)
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(both == 0, 1.0).otherwise(n / (both - n)))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity after lower-casing and trimming; two empty sets agree."""
    return let(F.struct(norm_set(a).alias("a"), norm_set(b).alias("b")), lambda s: sets_agree(s["a"], s["b"]))


def _numbered(words: Column) -> Column:
    """Words with how many equal ones stand before them, by one pass over the sorted words."""

    def numbered(ordered: Column) -> Column:
        # places where a new word begins; a word's number is its place less the last of them
        first = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))

        def of(begins: Column) -> Column:
            ends = F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(ordered) + 1))
            runs = F.arrays_zip(begins.alias("b"), ends.alias("e"))
            return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), r["e"] - r["b"]), lambda n: F.concat_ws(" ", F.get(ordered, r["b"] - 1), n.cast("string")))))

        return F.when(F.size(ordered) > 0, let(first, of)).otherwise(F.array().cast("array<string>"))

    return let(F.sort_array(words), numbered)


def word_bag(text: Column) -> Column:
    """Words of a text in lower case; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")


def bags_agree(a: Column, b: Column) -> Column:
    """F1 of two bags of words; two empty ones agree."""
    times = lambda bag, w: F.size(bag) - F.size(F.array_remove(bag, w))
    # few words that both have are counted one by one; else the nth time a word comes is a thing of its own, so bags meet as sets
    counted = lambda both: F.aggregate(both, F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
    numbered = F.size(F.array_intersect(_numbered(a), _numbered(b)))
    overlap = let(F.array_intersect(a, b), lambda both: F.when(F.size(both) <= COUNTED_WORDS, counted(both)).otherwise(numbered))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * overlap / total)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two word bags; two empty texts agree."""
    return let(F.struct(word_bag(a).alias("a"), word_bag(b).alias("b")), lambda s: bags_agree(s["a"], s["b"]))


def years_named(text: Column) -> Column:
    """Years of a text, stated ranges of up to 40 years filled in."""
    text = F.coalesce(text, F.lit(""))
    span = r"(?i)\b((?:19|20)\d{2})\s*(?:-|–|—|to|through|thru)\s*((?:19|20)\d{2})\b"
    ends = F.transform(F.regexp_extract_all(text, F.lit(span), 0), lambda s: F.struct(F.left(s, F.lit(4)).cast("int").alias("lo"), F.right(s, F.lit(4)).cast("int").alias("hi")))
    spans = F.filter(ends, lambda s: (s["lo"] <= s["hi"]) & (s["hi"] - s["lo"] <= 40))
    single = F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), 0), lambda y: y.cast("int"))
    return F.sort_array(F.array_distinct(F.concat(single, F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"]))))))


def _units(text: Column) -> Column:
    """Runs of A-Z and 0-9, and every other character by itself."""
    return F.regexp_extract_all(text, F.lit(r"[A-Z0-9]+|[^A-Z0-9]"), 0)


def names_in(text: Column, names: Column) -> Column:
    """The names of an array that stand in a text with no letter or digit right before or after; both in normal form.

    A name is a sequence of units, so its ends are ends of units. For each number of units that a
    name has, the text's sequences of that many are looked up as a set: the work grows with the
    text and the different lengths, not with the names.
    """
    key = lambda n, u: F.struct(n.alias("name"), F.concat_ws("\u0001", u).alias("key"), F.size(u).alias("size"))
    keyed = F.transform(names, lambda n: let(_units(n), lambda u: key(n, u)))

    def found(s: Column) -> Column:
        """Sequences of the text, of every length that a name has."""
        units = s["units"]
        sizes = F.filter(F.array_distinct(F.transform(s["keyed"], lambda k: k["size"])), lambda n: n > 0)

        def among(letters: Column) -> Column:
            is_letter = lambda i: F.coalesce(F.get(letters, i), F.lit(False))

            def sequences(size: Column) -> Column:
                last = F.size(units) - size

                def at(i: Column) -> Column:
                    end = i + size
                    # a sequence that begins or ends with another sign must not touch a letter there
                    clear = ~(~is_letter(i) & is_letter(i - 1)) & ~(~is_letter(end - 1) & is_letter(end))
                    return F.when(clear, F.array_join(F.slice(units, i + 1, size), "\u0001"))

                return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<string>"))

            return F.array_distinct(F.flatten(F.transform(sizes, sequences)))

        return let(F.transform(units, lambda u: u.rlike("^[A-Z0-9]")), among)

    def named(s: Column) -> Column:
        keys = F.array_intersect(F.transform(s["keyed"], lambda k: k["key"]), found(s))
        return let(keys, lambda hits: F.array_distinct(F.transform(F.filter(s["keyed"], lambda k: F.array_contains(hits, k["key"])), lambda k: k["name"])))

    return let(F.struct(_units(text).alias("units"), keyed.alias("keyed")), named)


def applicability_recall(products: Column, named: Column) -> Column:
    """Shares of a bulletin's own years and models (array of ``year``, ``model`` texts) that a text names; null where it lists none."""
    years = F.array_distinct(F.transform(F.filter(products, lambda p: F.coalesce(p["year"].rlike("^[0-9]+$"), F.lit(False))), lambda p: p["year"].cast("int")))
    models = F.array_distinct(F.filter(F.transform(products, lambda p: normal_model(p["model"])), lambda m: m != ""))
    share = lambda part, whole: F.when(whole > 0, F.round(part / whole, 6))
    counts = lambda s: F.struct(
        F.size(s["y"]).alias("ny"), F.size(s["m"]).alias("nm"), F.size(F.array_intersect(s["y"], years_named(named))).alias("hy"), F.size(names_in(normal_model(named), s["m"])).alias("hm")
    )
    shares = lambda c: F.struct(share(c["hy"], c["ny"]).alias("year_recall"), share(c["hm"], c["nm"]).alias("model_recall"), share(c["hy"] + c["hm"], c["ny"] + c["nm"]).alias("recall"))
    return let(let(F.struct(years.alias("y"), models.alias("m")), counts), shares)
