"""Column functions over text: normal form, phrase tests, line predicates, title parsers, display repair.

All are compositions of built-in functions but for compatibility normalisation (``nfkc``), which Spark lacks. The predicates
expect text that went through it already; ``n`` is always the normal form of the text beside it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as lx

Text = Column


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


#: Beside ASCII, letters and quotation marks that are their own normal form, alone and beside each other.
STABLE = r"\x{AB}\x{BB}\x{C0}-\x{FF}\x{621}-\x{64A}\x{2013}\x{2014}\x{2018}-\x{201D}"


def nfkc(c: Column) -> Column:
    """Compatibility normalisation. Text of stable characters is its own normal form: the Arrow function gets null in its place."""
    return F.coalesce(_nfkc(F.when(~plain_ascii(c) & c.rlike(rf"[^\x{{0}}-\x{{7F}}{STABLE}]"), c)), c)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: inside a lambda no rule finds what is repeated."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _or(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


# ---------------------------------------------------------------- strings
def fold_digits(c: Column) -> Column:
    return F.translate(c, lx.EASTERN_DIGITS, lx.WESTERN_DIGITS)


def fold_digits_rare(c: Column) -> Column:
    """fold_digits() of a column in which few rows have something to fold."""
    return F.when(~plain_ascii(c) & c.rlike(f"[{lx.EASTERN_DIGITS}]"), fold_digits(c)).otherwise(c)


def squash(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def unbullet(c: Column) -> Column:
    return F.ltrim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(lx.BULLETS))


#: lx.OUTSIDE with a class that Java looks up in a table.
OUTSIDE = r"[^\p{Alnum}؀-ۿ]+"
#: ASCII white space beside the blank.
BLANKS = "\t\n\x0b\f\r"


def norm(c: Column) -> Column:
    """Folded letters and digits, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, lx.FOLD_FROM, lx.FOLD_TO)), OUTSIDE, " "))


def plain_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def squash_line(c: Column) -> Column:
    """squash() of a column, without its pattern where ASCII text has single blanks already."""
    spaced = F.contains(c, F.lit("  "))
    for blank in BLANKS:
        spaced = spaced | F.contains(c, F.lit(blank))
    return F.when(plain_ascii(c) & ~spaced, F.trim(c)).otherwise(squash(c))


def norm_line(c: Column) -> Column:
    """norm() of a column, without the folding where no letter is Arabic, as only those are folded."""
    return F.when(~plain_ascii(c) & c.rlike("[؀-ۿ]"), norm(c)).otherwise(F.trim(F.regexp_replace(F.lower(c), r"\P{Alnum}+", " ")))


def arabic(n: Column) -> Column:
    """Has a normal form Arabic letters? Its other characters take a byte each."""
    return F.octet_length(n) > F.length(n)


def n_words(n: Column) -> Column:
    return F.when(n == "", 0).otherwise(count_char(n, " ") + 1)


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def begins(n: Column, phrases) -> Column:
    """Equal to a phrase, or going on after it with a blank."""
    return n.rlike(f"^{lx.alternatives(phrases)}(?: |$)")


def opens(n: Column, phrases) -> Column:
    """Begins with a phrase's characters."""
    return n.rlike(f"^{lx.alternatives(phrases)}")


def holds(n: Column, phrases) -> Column:
    """Has a phrase's characters anywhere."""
    found = n.rlike(lx.alternatives(phrases))
    return found if any(lx.normal(p).isascii() for p in phrases) else arabic(n) & found


def equals(n: Column, phrases) -> Column:
    return n.rlike(f"^{lx.alternatives(phrases)}$")


def tokens_among(n: Column, words) -> Column:
    """How many tokens are among the words."""
    return F.size(F.filter(F.split(n, " "), lambda t: t.isin(*dict.fromkeys(map(lx.normal, words)))))


def has_phrase(hay: Column, needle: Column) -> Column:
    """The needle's tokens stand in the hay, in a row."""
    return (needle != "") & F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


# ---------------------------------------------------------------- names
ENTITY_NOUNS = lx.PROGRAM_NOUNS + lx.STRONG_PROJECT_NOUNS + lx.FLEXIBLE_NOUNS


def name_forms(name: Column) -> Column:
    """The name, and the name without a generic noun before it; longest first."""
    s = squash(F.coalesce(name, F.lit("")))
    bare = F.trim(F.regexp_replace(s, "(?i)" + lx.GENERIC_PREFIX, ""))
    return F.filter(F.array_distinct(F.array(s, bare)), lambda x: x != "")


def name_key(name: Column) -> Column:
    """Identity of a name: no parenthesis, no leading entity noun, no blanks."""
    n = norm(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s*\(.*$", ""))
    return F.replace(F.regexp_replace(n, f"^{lx.alternatives(lx.PROJECT_NOUNS + lx.PROGRAM_NOUNS)}(?: |$)", ""), F.lit(" "), F.lit(""))


def without_numbering(raw: Column) -> Column:
    """No bullets, and none of the numbering of a table of contents (page and sequence, or sequence)."""
    both, one = r"\d{1,3}\s+\d{1,2}\s*[.\-:]\s*", r"\.?\s*\d{1,2}\s*[.\-:]\s*"
    return F.regexp_replace(F.regexp_replace(unbullet(raw), f"(?U)^(?:{both}|{one})", ""), r"(?U)^\s+|\s+$", "")


def title_text(raw: Column) -> Column:
    return strip_chars(without_numbering(raw), lx.TITLE_EDGES)


def lexemes(n: Column) -> Column:
    """Distinct tokens without stop words, an attached particle and the article."""
    stop = list(dict.fromkeys(map(lx.normal, lx.STOP_LEXEMES)))

    def base(t: Column) -> Column:
        x = F.when((F.length(t) > 4) & F.substring(t, 1, 1).isin(*"وفبكل"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
        return F.when(x.startswith("ال") & (F.length(x) > 4), F.substring(x, F.lit(3), F.length(x))).otherwise(x)

    kept = F.filter(F.split(n, " "), lambda t: (F.length(t) > 2) & ~t.isin(*stop))
    return F.array_distinct(F.filter(F.transform(kept, base), lambda t: F.length(t) > 2))


def overlap(a: Column, b: Column) -> Column:
    """N11, of two arrays of lexemes."""
    return F.size(F.array_intersect(a, b))


# ---------------------------------------------------------------- line predicates
def page_artifact(n: Column) -> Column:
    """Page labels and running footers."""
    page = (arabic(n) & n.rlike(r"صفح(?:ة|ه)\s*pdf\s*رقم\s*\d+")) | (F.contains(n, F.lit("page")) & n.rlike(r"page\s*\d+(?:\s*of\s*\d+)?$"))
    return page | (_or(F.contains(n, F.lit(lx.normal(p))) for p in lx.ANNUAL_REPORT) & n.rlike(r"\d"))


def short_heading(raw: Column, n: Column, t: Column | None = None) -> Column:
    """P2; n may be that of the raw text, which bullets and blanks don't change. t: the text without bullets, in single blanks, where it is at hand."""
    t = squash(unbullet(raw)) if t is None else t
    return (t != "") & (F.length(t) <= 140) & (n != "") & ~page_artifact(n) & (n_words(n) <= 12) & (count_char(t, ".") < 2) & (count_char(t, "؛") < 2)


def list_type(raw: Column, n: Column, short: Column | None = None) -> Column:
    """The type that a list heading declares, else null. short: P2, where it is at hand."""
    kind = F.when(begins(n, lx.PROGRAM_LISTS), "program").when(begins(n, lx.PROJECT_LISTS + lx.ACTIVITY_LISTS), "project")
    return F.when(short_heading(raw, n) if short is None else short, kind)


def major_heading(raw: Column, n: Column, short: Column | None = None, listed: Column | None = None, t: Column | None = None) -> Column:
    """A heading that ends the list before it. short: P2, listed: P3, t: the text in single blanks, where they are at hand."""
    t = squash(raw) if t is None else t
    short = short_heading(raw, n) if short is None else short
    return short & (list_type(raw, n) if listed is None else listed).isNull() & (t.rlike("^[:：]|[:：]$") | opens(n, lx.SECTION_STARTS))


def prose_like(text: Column, n: Column, words: Column | None = None) -> Column:
    """P5. words: how many words n has, where that is at hand."""
    words = n_words(n) if words is None else words
    early = arabic(n) & n.rlike(rf"^(?:\S+ ){{0,6}}{lx.alternatives(lx.PROSE_VERBS)}(?: |$)")
    return (n != "") & ((words >= 13) | opens(n, lx.PROSE_OPENERS) | ((words >= 6) & text.rlike("[،;؛]")) | early | ((words >= 3) & opens(n, [lx.COURSE_OPENER])))


def connector_prose(n: Column) -> Column:
    """P6."""
    return begins(n, lx.CONNECTORS)


def entity_noun(n: Column) -> Column:
    """P7."""
    return begins(n, ENTITY_NOUNS)


def plausible_name(text: Column, n: Column) -> Column:
    """May a candidate that only the model saw be a name?"""
    t = squash(text)
    bare = ~entity_noun(n)
    return (t != "") & (n != "") & ~page_artifact(n) & ~connector_prose(n) & ~(t.rlike('["“”«»]') & bare) & ~(prose_like(t, n) & bare) & ~((n_words(n) > 10) & bare)


def detail_start(text: Column, n: Column) -> Column:
    """A numbered achievement or person."""
    return (text != "") & (text.rlike(r"(?U)^(?:[.\-]?\s*\d{1,2}\s*[.)\-:]|\d{1,2}\s+)") | text.rlike(r"(?U)[.\s]\d{1,2}$") | opens(n, lx.PLACES_WON))


def title_score(t: Column, n: Column, words: Column | None = None) -> Column:
    """P10: how much a fragment, without bullets and in single blanks, looks like a title. words: how many words n has, where that is at hand."""
    w = n_words(n) if words is None else words
    score = (
        F.when(w <= 4, 5).when(w <= 8, 3).when(w <= 12, 1).otherwise(-6)
        + F.when(F.length(t) <= 90, 2).otherwise(0)
        + F.when(entity_noun(n), 3).otherwise(0)
        + F.when(prose_like(t, n, w), -7).otherwise(0)
        + F.when(equals(n, lx.FIELD_HINTS), -8).otherwise(0)
        + F.when(equals(n, lx.GENERIC_HEADINGS), -8).otherwise(0)
    )
    return F.when((t == "") | (n == "") | page_artifact(n), -99).otherwise(score)


# ---------------------------------------------------------------- title parsers
def project_title(raw: Column, following: Column, s: Column | None = None, n: Column | None = None) -> Column:
    """The title of a line that starts with a project noun, with a subtitle in parentheses that wraps to the next line.

    s: the line without numbering, n: its normal form, where they are at hand.
    """
    s = without_numbering(raw) if s is None else s
    n = norm(s) if n is None else n
    parts = F.split(s, "[:：]")
    tail = squash(unbullet(F.element_at(parts, -1)))
    swapped = s.rlike("[:：]") & (tail != "") & (title_score(tail, norm(tail)) >= 1) & prose_like(F.element_at(parts, 1), norm(F.element_at(parts, 1)))
    own, more = squash(s), squash(F.coalesce(following, F.lit("")))
    title = F.when(more.startswith("(") & F.contains(more, F.lit(")")) & (F.length(more) <= 100) & ~F.contains(own, F.lit("(")), F.concat(own, F.lit(" "), more)).otherwise(own)
    ok = (tokens_among(n, lx.PROJECT_NOUNS) == 1) & ~n.rlike(f"^{lx.alternatives(lx.NOT_TITLES)} ") & ~swapped & ~prose_like(s, n)
    # a conditional of its own: what is repeated on both sides of an AND would be computed for every line
    return F.when(begins(n, lx.PROJECT_NOUNS), F.when(ok & (F.length(title) <= 180), title))


def program_title(raw: Column, n: Column | None = None) -> Column:
    """What follows an ordinal that opens a section heading. n: the line's normal form, where it is at hand."""
    s = unbullet(raw)
    n = norm(s) if n is None else n
    after = F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, r"(?s)^[^:]*:", "")).when(F.contains(s, F.lit("：")), F.regexp_replace(s, r"(?s)^[^：]*：", "")).otherwise(F.ltrim(F.regexp_extract(s, r"(?Us)^\S+\s+(.*)$", 1), F.lit(":：.-–— ")))
    title = squash(after)
    ordinals = list(lx.ORDINAL_RANK)
    ok = (tokens_among(n, ordinals) == 1) & (tokens_among(n, [lx.PROGRAM_FAMILY]) <= 1)
    return F.when(begins(n, ordinals), F.when(ok & (title != "") & (F.length(title) <= 160) & ~equals(norm(title), lx.GENERIC_HEADINGS), title))


def ordinal_rank(raw: Column, n: Column | None = None) -> Column:
    n = norm(unbullet(raw)) if n is None else n
    first = F.element_at(F.split(n, " "), 1)
    out = F.lit(None).cast("int")
    for word, rank in lx.ORDINAL_RANK.items():
        out = F.when(first == word, rank).otherwise(out)
    return F.when(begins(n, list(lx.ORDINAL_RANK)), out)


def standalones(texts: Column, norms: Column | None = None) -> Column:
    """S5 of each text of an array, which title_text() cleaned, as structs: text, ok (an entity inside a list), program (it has a program noun), free (its type outside any list), plausible.

    Each step names what the step before computed, so nothing is computed twice. norms: the texts' normal forms, where they are at hand.
    """
    none = F.lit(None).cast("string")
    known = F.transform(texts, lambda t, k: F.struct(t.alias("text"), (norm(t) if norms is None else F.get(norms, k)).alias("n")))
    known = F.transform(known, lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n"), n_words(s["n"]).alias("w"), entity_noun(s["n"]).alias("entity")))

    def told(s: Column) -> Column:
        more = F.struct(squash(unbullet(s["text"])).alias("t"), page_artifact(s["n"]).alias("artifact"), connector_prose(s["n"]).alias("connector"), prose_like(s["text"], s["n"], s["w"]).alias("prose"), begins(s["n"], lx.PROGRAM_NOUNS).alias("program"), begins(s["n"], lx.STRONG_PROJECT_NOUNS).alias("project"))
        return bound(more, lambda m: bound(judged(s, m), lambda j: typed(s, m, j)))

    def judged(s: Column, m: Column) -> Column:
        text, n, w, t, bare = s["text"], s["n"], s["w"], m["t"], ~s["entity"]
        short = (t != "") & (F.length(t) <= 140) & (n != "") & ~m["artifact"] & (w <= 12) & (count_char(t, ".") < 2) & (count_char(t, "؛") < 2)
        later = arabic(n) & text.rlike(r"(?U)\s\d{1,2}\s*[.]\s*(?:" + "|".join(lx.NUMBERED_NOUNS) + ")")
        ok = short & ~m["prose"] & ~m["connector"] & ~n.rlike(r"^\d+$") & (tokens_among(n, ENTITY_NOUNS) <= 1) & ~later & ~equals(n, lx.GENERIC_HEADINGS)
        # P8 with what is known
        plausible = (n != "") & ~m["artifact"] & ~m["connector"] & ~(m["prose"] & bare) & ~((w > 10) & bare) & ~(bare & text.rlike('["“”«»]'))
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), plausible.alias("plausible"))

    def typed(s: Column, m: Column, j: Column) -> Column:
        free = F.when(j["ok"] & m["program"], F.when((s["w"] <= 5) & ~s["n"].rlike(r"\d"), "program")).when(j["ok"] & m["project"], "project")
        return F.struct(s["text"].alias("text"), j["ok"].alias("ok"), m["program"].alias("program"), free.alias("free"), j["plausible"].alias("plausible"))

    # over 12 words are no heading (P2), and without an entity noun prose (P5): nothing else need be known of them
    long = lambda s: F.struct(s["text"].alias("text"), F.lit(False).alias("ok"), F.lit(False).alias("program"), none.alias("free"), F.lit(False).alias("plausible"))
    return F.transform(known, lambda s: F.when((s["w"] > 12) & ~s["entity"], long(s)).otherwise(told(s)))


def standalone(raw: Column) -> Column:
    """S5 of one text."""
    return F.get(standalones(F.array(title_text(raw))), F.lit(0))


def scored_pairs(raw: Column, text: Column | None = None) -> Column:
    """S4's candidates: at every colon, both ways round, structs (k, base, bonus, long, title, desc); null without a colon. text: the line in single blanks, where it is at hand."""
    text = squash(raw) if text is None else text
    # places by the lengths of what stands between the colons: a substring for each character would cost the square of a line
    sizes = F.transform(F.split(text, "[:：]", -1), lambda part: F.length(part))
    at = bound(sizes, lambda z: F.transform(F.sequence(F.lit(1), F.size(z) - 1), lambda k: F.aggregate(F.slice(z, F.lit(1), k), k, lambda acc, n: acc + n)))
    sides = F.transform(at, lambda i: F.struct(F.trim(F.substring(text, F.lit(1), i - 1)).alias("l"), F.trim(F.substring(text, i + 1, F.length(text))).alias("r")))
    both = F.flatten(F.transform(sides, lambda s: F.array(F.struct(s["l"].alias("title"), s["r"].alias("desc"), s["l"].alias("l"), s["r"].alias("r")), F.struct(s["r"].alias("title"), s["l"].alias("desc"), s["l"].alias("l"), s["r"].alias("r")))))
    told = F.transform(both, lambda p, k: F.struct(k.alias("k"), p["title"].alias("title"), squash(unbullet(p["title"])).alias("flat"), p["desc"].alias("desc"), norm(p["title"]).alias("tn"), norm(p["desc"]).alias("dn"), norm(p["l"]).alias("ln"), (p["title"] == p["r"]).alias("tail")))
    seen = F.transform(told, lambda p: F.struct(p["k"].alias("k"), p["title"].alias("title"), p["flat"].alias("flat"), p["desc"].alias("desc"), p["tn"].alias("tn"), p["dn"].alias("dn"), ((p["title"] != "") & ~connector_prose(p["tn"]) & ~(p["tail"] & connector_prose(p["ln"]) & ~entity_noun(p["tn"]))).alias("fair")))

    def scored(p: Column) -> Column:
        return F.struct(
            (-p["k"]).alias("k"),
            title_score(p["flat"], p["tn"]).alias("base"),
            F.when((p["desc"] != "") & (prose_like(p["desc"], p["dn"]) | (n_words(p["dn"]) >= 5)), 2).otherwise(0).alias("bonus"),
            (~entity_noun(p["tn"]) & (n_words(p["tn"]) > 5)).alias("long"),
            title_text(p["title"]).alias("title"),
            F.nullif(p["desc"], F.lit("")).alias("desc"),
        )

    return F.when(text.rlike("[:：]"), F.transform(F.filter(seen, lambda p: p["fair"]), scored))


def best_pair(scored: Column, listed: bool) -> Column:
    """The first of the best candidates as a struct (title, desc), null if none is good enough."""

    def total(p: Column) -> Column:
        score = p["base"]
        if listed:
            score = F.when(score >= 0, score + 3 - 8 * p["long"].cast("int")).otherwise(score)
        return F.struct((score + p["bonus"]).alias("score"), p["k"].alias("k"), p["title"].alias("title"), p["desc"].alias("desc"))

    best = F.array_max(F.transform(scored, total))
    ok = (best["score"] >= (1 if listed else 4)) & (best["title"] != "") & (F.length(best["title"]) <= 180)
    return F.when(ok, F.struct(best["title"].alias("title"), best["desc"].alias("desc")))


def row_cells(raw: Column) -> Column:
    """The cells of a row 'A | B | …' that hold something."""
    return F.when(F.contains(raw, F.lit("|")), F.filter(F.transform(F.split(raw, r"\|"), squash), lambda c: c != "")).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- display
def display(c: Column) -> Column:
    """Repair of spacing and of words that character recognition broke; blank becomes null."""
    marks = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]+"

    def mended(s: Column) -> Column:
        t = F.regexp_replace(s, rf"(?U)(^|\s){marks}", "$1")
        for broken, whole in lx.BROKEN_WORDS:
            t = F.regexp_replace(t, broken.replace(" ", r"(?U)\s+"), whole)
        for broken, whole in lx.BROKEN_WHOLE_WORDS:
            t = F.regexp_replace(t, rf"(?U)\b{broken}\b", whole)
        for broken, whole in lx.BROKEN_LITERALS:
            t = F.replace(t, F.lit(broken), F.lit(whole))
        # all of these have Arabic letters
        return F.when(~plain_ascii(s) & s.rlike("[؀-ۿ]"), t).otherwise(s)

    s = bound(F.replace(nfkc(c), F.lit(lx.TATWEEL), F.lit("")), mended)
    s = F.regexp_replace(s, r"(?U)^\s*[.،,؛;: ]*", "")
    for pattern, into in (
        (r"(?U)\s*[،,]\s*", "، "),
        (r"(?U)\s+([؛;:.!?؟])", "$1"),
        (r"(?U)([(\[«])\s+", "$1"),
        (r"(?U)\s+([)\]»])", "$1"),
    ):
        s = F.regexp_replace(s, pattern, into)

    def spaced(s: Column) -> Column:
        t = s
        for pattern, into in (
            (r"(?U)\b(" + "|".join(lx.LIST_VERBS) + r")\s*\(\s*:\s*", "$1: ("),
            (r"([.!؟])(?=[؀-ۿ])", "$1 "),
            (r"ة(?=(?:بال|لل)[؀-ۿ])", "ة "),
        ):
            t = F.regexp_replace(t, pattern, into)
        for broken, whole in lx.BROKEN_MARKS:
            t = F.replace(t, F.lit(broken), F.lit(whole))
        # the list comma is Arabic, too
        return F.when(~plain_ascii(s) & s.rlike("[؀-ۿ]"), t).otherwise(s)

    s = bound(s, spaced)
    return F.nullif(squash(s), F.lit(""))


def display_delivery(c: Column) -> Column:
    """display(), and a list comma after the headquarters."""
    s = F.regexp_replace(display(c), rf"(?U)^({lx.HEADQUARTERS})\s+(?=(?:{'|'.join(lx.AFTER_HEADQUARTERS)}))", "$1، ")
    return F.regexp_replace(s, r"(?U)\s+،\s*", "، ")


def without_metrics(c: Column) -> Column:
    """No one to three numbers before Arabic text."""
    return squash(F.regexp_replace(F.trim(fold_digits(c)), r"^(?:\d+(?:[.,]\d+)?\s+){1,3}(?=[؀-ۿ])", ""))
