"""Authors of a manuscript: names after a marker, or a block of names under the title; and their order on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.functions.lines import BY, CHAPTER, CONTACT, SUFFIXES, TITLE_WORDS, author_line, let, like, name_like, noise_key, structural, words_of

#: Names kept, lines of a title page, and how far the walk from name to name goes over other lines and blank ones.
MOST, PAGE, OTHERS, BLANKS, MARKED_BLANKS = 12, 60, 48, 3, 2
AFFILIATION = (
    r"(?i)\b(?:university|college|school|institute|campus|faculty|department|computing\s+studies|state|dhvsu|don\s+honorio(?:\s+ventura)?|pampanga|philippines|"
    r"province|city|municipality|barangay|barrio|purok|sitio|street|avenue|road|highway|village|subdivision)\b"
)
ROLE = r"(?i)^\s*(?:thesis\s+)?(?:adviser|advisor|panel(?:ist|ists|\s+members?)?|chair(?:person)?|committee|approved\s+by|reviewed\s+by|examined\s+by)\b"
SURNAME = r"(?i)(?<![A-Za-z])(?:(?:de|del|dela|delos|delas|da|di|du|van|von|der|la|le)\s+)?[A-Z][A-Za-z'’\-]{1,},\s+"
DATED = r"(?i)^(?:19|20)\d{2}$|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+(?:\d{1,2},?\s+)?(?:19|20)\d{2}\b"
_NAMES = "array<string>"


def _trimmed(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, rf"^[{chars}]+|[{chars}]+$", "")


def bare(line: Column) -> Column:
    """A line without addresses and numbers of people."""
    return _trimmed(F.trim(F.regexp_replace(F.regexp_replace(line, "(?U)" + CONTACT, " "), r"\s+", " ")), r" ,;:|\-–—")


def person(line: Column) -> Column:
    """The shape of a name, and no part of the frame."""
    return name_like(line) & ~structural(line)


def listed(line: Column) -> Column:
    """The names of a line that holds two or more as surname, comma and given name, each of which is one; else none."""
    # a mark before each surname, at which the line is cut
    marked = F.split(F.regexp_replace(line, "(" + SURNAME + ")", "\u0001$1"), "\u0001")
    names = F.transform(F.slice(marked, 2, 1 << 30), lambda p: _trimmed(F.trim(p), " ,;"))
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    plain = ~line.rlike(r"\p{Nd}") & ~((commas >= 2) & like(line, AFFILIATION))
    good = lambda n: (F.size(n) >= 2) & F.forall(n, lambda x: x.rlike(r",\s+[A-Z]") & person(x))
    return let(F.when(plain, names), lambda n: F.when(good(n), n).otherwise(F.array().cast(_NAMES)))


def unmarked_name(line: Column) -> Column:
    """Is a line a name without a label: surname, comma and two to four words, or three to five words with an initial inside or a suffix?"""
    words = words_of(line)
    n, parts = F.size(words), F.split(line, ",")
    low = lambda w: F.lower(F.regexp_replace(w, r"[.,]+$", ""))
    titled = F.exists(F.array(*map(F.lit, TITLE_WORDS)), lambda t: F.contains(F.lower(line), t))
    given = words_of(F.trim(F.get(parts, F.lit(1))))
    comma = (F.size(parts) == 2) & F.size(words_of(F.get(parts, F.lit(0)))).between(1, 2) & F.size(given).between(2, 4)
    inner = F.exists(F.slice(words, 2, F.greatest(n - 2, F.lit(0))), lambda w: w.rlike(r"^(?:[A-Z]\.,*|(?:[A-Z]\.){2,})$"))
    plain = (F.size(parts) == 1) & n.between(3, 5) & (inner | F.exists(words, lambda w: low(w).isin(SUFFIXES)))
    return person(line) & ~like(line, AFFILIATION) & ~titled & (comma | plain)


def marker(line: Column) -> Column:
    """A line that begins a list of authors: a label, or one with a name after it. Prose that begins with such a word is none."""
    by = like(line, r"(?i)^by\b")
    alone = ~like(line, r"(?i)^researcher") | line.rlike(r"(?i)^researchers?\s*:?\s*$")

    def candidate(rest: Column) -> Column:
        shown = author_line(rest) | (F.when(by, F.size(words_of(rest)) <= 3).otherwise(True) & person(rest)) | (~by & (F.size(listed(rest)) >= 2))
        return F.when(rest == "", alone).otherwise(shown)

    return F.when(like(line, BY), let(bare(_trimmed(F.regexp_replace(line, BY, ""), " :,")), candidate)).otherwise(False)


def _state(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, ("names", "blanks", "others", "over"))])


def _marked_step(s: Column, line: Column) -> Column:
    """After a marker: names one after the other, two blank lines between them at most."""
    over = _state(s["names"], s["blanks"], s["others"], F.lit(True))
    empty = _state(s["names"], s["blanks"] + 1, s["others"], s["blanks"] + 1 > MARKED_BLANKS)

    def taken(new: Column) -> Column:
        names = F.concat(s["names"], new)
        return F.when(F.size(new) == 0, over).otherwise(_state(names, F.lit(0), s["others"], F.size(names) >= MOST))

    return F.when(s["over"], s).otherwise(let(bare(line), lambda clean: F.when(clean == "", empty).otherwise(let(_named(clean, person(clean), clean), taken))))


def _named(clean: Column, is_name: Column, name: Column) -> Column:
    """The names of a line: several, or one, or none."""
    none = F.array().cast(_NAMES)
    return let(listed(clean), lambda many: F.when(F.size(many) > 0, many).when(is_name, F.array(name)).otherwise(none))


def _unmarked_step(s: Column, line: Column) -> Column:
    """Under a title: the first line is a name; affiliations and addresses may stand between names, up to a budget; a role or the frame ends the block."""
    begun = F.size(s["names"]) > 0
    over = _state(s["names"], s["blanks"], s["others"], F.lit(True))
    blank = _state(s["names"], s["blanks"] + 1, s["others"], begun & (s["blanks"] + 1 > BLANKS))
    passed = _state(s["names"], F.lit(0), s["others"] + 1, s["others"] + 1 > OTHERS)
    place = like(line, AFFILIATION)
    stop = like(line, ROLE) | like(line, DATED) | (~like(line, CONTACT) & ~place & structural(line))
    other = place | like(line, CONTACT) | F.contains(line, F.lit("@")) | (F.length(F.regexp_replace(line, r"\P{Nd}", "")) >= 6)

    def before_place(clean: Column) -> Column:
        """A name without the affiliation after its comma."""
        parts = F.split(clean, r",\s*")
        far = F.get(F.filter(F.transform(parts, lambda p, i: F.when(like(p, AFFILIATION), i)), lambda i: i.isNotNull()), F.lit(0))
        return let(far, lambda k: F.when(k.isNull(), clean).otherwise(F.array_join(F.slice(parts, 1, k), ", ")))

    def taken(new: Column) -> Column:
        names = F.concat(s["names"], new)
        added = _state(names, F.lit(0), F.lit(0), F.size(names) >= MOST)
        return F.when(F.size(new) > 0, added).when(begun & other, passed).otherwise(over)

    named = let(bare(line), lambda clean: let(before_place(clean), lambda head: _named(clean, unmarked_name(head), head)))
    return F.when(s["over"], s).when(line == "", blank).when(stop, over).otherwise(let(named, taken))


def letters_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def title_span(lines: Column, title: Column) -> Column:
    """(start, end): the numbers of the title's first line and of the line after it; its lines follow each other. Null if it is not there."""
    keys = F.transform(F.slice(lines, 1, PAGE), lambda x, i: F.struct(letters_of(x).alias("key"), i.alias("at")))
    none = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    whole = F.struct(F.lit("").alias("met"), F.lit(0).alias("start"), F.when(F.lit(False), none).alias("span"))

    def found(wanted: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            blank, longer = x["key"] == "", F.concat(s["met"], x["key"])
            on = (s["met"] != "") & F.startswith(wanted, longer)
            met = F.when(blank, s["met"]).when(on, longer).when(F.startswith(wanted, x["key"]), x["key"]).otherwise(F.lit(""))
            start = F.when(blank | on, s["start"]).otherwise(x["at"])
            span = F.when((met == wanted) & (wanted != ""), F.struct(start.alias("start"), (x["at"] + 1).alias("end")))
            return F.struct(met.alias("met"), start.alias("start"), F.coalesce(s["span"], span).alias("span"))

        return F.aggregate(keys, whole, step)["span"]

    return let(letters_of(title), found)


def detected_authors(rows: DataFrame, text: str, title: str) -> DataFrame:
    """``rows`` with ``found_authors``: the names after a marker ("by", "submitted by", "researchers:"), or else in a block right under the title.

    A marker counts before the abstract and the first chapter, in two title pages of
    lines. The lines of the title in column ``title`` are neither of these, whatever they
    begin or end with. Under the title two names at least must be found. At most
    twelve names are kept, each once in any case, without addresses. Such a list is never
    sure, so there is no confidence. Names cut over two lines are left to a person.
    Null texts have none.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    none = F.array().cast(_NAMES)

    def marked(rows_: Column, at: Column) -> Column:
        rest = bare(_trimmed(F.regexp_replace(F.get(rows_, at), BY, ""), " :,"))
        given = let(rest, lambda r: _named(r, person(r), r))
        start = let(given, lambda g: _state(g, F.lit(0), F.lit(0), F.size(g) >= MOST))
        return F.aggregate(F.slice(rows_, at + 2, 3 * PAGE), start, _marked_step)["names"]

    def under(rows_: Column, end: Column) -> Column:
        start = _state(none, F.lit(0), F.lit(0), F.lit(False))
        block = F.aggregate(F.slice(rows_, end + 1, F.greatest(F.lit(PAGE) - end, F.lit(0))), start, _unmarked_step)["names"]
        return let(block, lambda b: F.when(F.size(b) >= 2, b))

    def names_of(rows_: Column) -> Column:
        return let(title_span(rows_, F.col(title)), lambda span: names_beside(rows_, span))

    def names_beside(rows_: Column, span: Column) -> Column:
        def head(x: Column, i: Column) -> Column:
            stop = like(x, r"(?i)^abstract\b") | like(noise_key(x), CHAPTER)
            return F.when((i >= span["start"]) & (i < span["end"]), F.lit(None)).when(stop, -1).when(marker(x), i)

        heads = F.transform(F.slice(rows_, 1, 2 * PAGE), head)
        first = F.get(F.filter(heads, lambda i: i.isNotNull()), F.lit(0))
        block = F.when(span.isNotNull(), under(rows_, span["end"]))
        return let(first, lambda at: F.when(at >= 0, marked(rows_, at)).otherwise(block))

    def once(names: Column) -> Column:
        clean = F.filter(F.transform(F.coalesce(names, none), lambda n: F.regexp_replace(n, r"[,;\s]+$", "")), lambda n: n != "")
        lower = lambda c: F.transform(c, lambda n: F.lower(n))
        return let(clean, lambda c: F.slice(F.filter(c, lambda n, i: F.array_position(lower(c), F.lower(n)) == i + 1), 1, MOST))

    return rows.withColumn("found_authors", once(let(F.slice(lines, 1, 3 * PAGE), names_of)))


def in_page_order(names: Column, rows: Column) -> Column:
    """Names in the order in which they stand in the rows of a page; as they are unless every one is found, each at a place of its own."""
    keys = F.transform(rows, letters_of)
    places = F.transform(
        names,
        lambda n: F.get(
            F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("row"), F.instr(k, letters_of(n)).alias("at"))), lambda p: (p["at"] > 0) & (letters_of(n) != "")),
            F.lit(0),
        ),
    )
    sure = F.forall(places, lambda p: p.isNotNull()) & (F.size(F.array_distinct(places)) == F.size(names)) & (F.size(names) >= 2)
    ordered = F.transform(F.array_sort(F.arrays_zip(places.alias("p"), names.alias("n"))), lambda x: x["n"])
    return F.when(sure, ordered).otherwise(names)
