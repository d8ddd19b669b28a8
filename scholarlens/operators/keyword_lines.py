"""Keywords of a manuscript: an automaton over its lines, folded from the label on.

The label's line has the list, or the first line with text after it has. The list goes
on while lines look like parts of one: they have a separator, or the line before ended
with one, or they are a short wrapped end. Prose, headings and names stop it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.functions.lines import CHAPTER, HONORIFICS, NOISE, SUFFIXES, TITLE_WORDS, author_line, like, noise_key, structural, words_of
from scholarlens.operators.abstracts import STOP

#: Items kept, their longest, the labels, and what tells prose.
ITEMS, LONGEST = 15, 64
LABEL = r"(?i)^(keyword\s*/\s*s|keywords?|key\s*words?|index\s+terms?)\s*[:\-—]\s*(.*)$"
LOOSE = (
    r"^(?:Keyword\s*/\s*s|KEYWORD\s*/\s*S|Keywords?|Key\s*Words?|KEYWORDS?|KEY\s*WORDS?|Index\s+Terms?|INDEX\s+TERMS?)"
    r"(?:\s*[:\-—]\s*|\s+|\s*$)(.*)$"
)
PARTS = r"[;,·•|]"
SUBJECT = r"(?i)^(?:the|this|these|those|it|they|we|our|their|study|research|results?|findings?|students?|researchers?|participants?|respondents?)\b"
VERB = (
    r"(?i)\b(?:am|is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|will|would|should|must|may|might|shall|supports|supported|tracks|tracked|"
    r"reports|reported|improves|improved|provides|provided|uses|used|includes|included|focuses|focused|examines|examined|investigates|investigated|develops|"
    r"developed|presents|presented|describes|described|discusses|discussed|suggests|suggested)\b"
)
OPENING = r"(?i)^(?:are|is|was|were|has|have|had|do|does|did|can|could|will|would|should|must|may|might|shall)\b"
NUMBERED = r"(?i)^\s*\d+(?:\.\d+)*\.?\s*(?:introduction|references|bibliography|appendix)\b"
SMALL = ["a", "an", "the", "this", "that", "these", "those", "it", "we", "our", "in", "on", "at", "for", "with"]
_STATE = "struct<raw:string,before:string,bridge:boolean,blank:boolean,cut:boolean,over:boolean>"


def prose(line: Column) -> Column:
    """A sentence or a part of one."""
    n, ended = F.size(words_of(line)), line.rlike(r"[.?!]$")
    verb = like(line, VERB)
    return like(line, OPENING) | (like(line, SUBJECT) & verb) | ((n >= 6) & verb & ended) | ((n >= 8) & ended & ~line.rlike(PARTS))


def _core(word: Column) -> Column:
    return F.regexp_replace(word, r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", "")


def wrapped_end(line: Column, before: Column) -> Column:
    """A short rest of the last item: one word, two to four that begin with and or or, or two or three capitals after a one-word item."""
    words = words_of(line)
    n, first = F.size(words), F.get(words, F.lit(0))
    one = (n == 1) & _core(line).rlike(r"^[A-Za-z][A-Za-z0-9'’\-]*$")
    joined = n.between(2, 4) & F.lower(first).isin("and", "or") & ~like(line, VERB) & ~line.rlike(r"[.?!]$")
    tail = F.element_at(F.split(before, PARTS), -1)
    capital = F.forall(words, lambda w: (_core(w) != "") & (_core(w).rlike(r"^\p{Lu}|\p{Nd}") | ((F.upper(_core(w)) == _core(w)) & (F.lower(_core(w)) != _core(w)))))
    after = n.between(2, 3) & before.rlike(PARTS) & (F.size(words_of(F.trim(tail))) == 1) & ~_core(F.lower(first)).isin(SMALL) & capital
    return (line != "") & ~prose(line) & ~line.rlike(PARTS) & F.when(n == 1, one).otherwise(joined | after)


def stops(line: Column) -> Column:
    """A section that follows a list."""
    return like(line, STOP) | like(noise_key(line), CHAPTER) | like(line, NUMBERED)


def _count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(PARTS + "+"))


def ends_list(line: Column) -> Column:
    """The frame, or an author's line, which a list of several parts or with a title word in front is none of."""
    first = _core(F.lower(F.get(words_of(F.get(F.split(line, PARTS + "+", 2), F.lit(0))), F.lit(0))))
    initial = F.exists(words_of(line), lambda w: w.rlike(r"^[A-Z]\.$"))
    list_like = ~initial & ((_count(line) >= 2) | F.coalesce(first.isin(TITLE_WORDS), F.lit(False)))
    return structural(line) | (author_line(line) & ~list_like)


def _goes_on(line: Column, before: Column) -> Column:
    """A line that reads like a surname and a given name is a part of the list when the list is plainly going on."""
    words, pieces = words_of(line), F.split(line, PARTS + "+")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[,.]+$", ""))
    person = F.exists(words, lambda w: w.rlike(r"^[A-Z]\.,*$") | bare(w).isin(SUFFIXES + HONORIFICS))
    pairs = F.forall(F.slice(pieces, 1, 2), lambda p: F.size(words_of(p)) >= 2)
    clear = (before.rlike(PARTS + r"\s*$") & (F.size(words) >= 3)) | ((_count(before) >= 2) & (F.size(pieces) >= 2) & pairs)
    return line.rlike(PARTS) & ~prose(line) & ~person & clear


def _step(s: Column, line: Column) -> Column:
    """One line: state (the list so far, the line before, may a blank be bridged, was there one, is an end cut off, is it over)."""
    state = lambda *x: F.struct(*[v.alias(n) for v, n in zip(x, ("raw", "before", "bridge", "blank", "cut", "over"))])
    yes, no = F.lit(True), F.lit(False)
    over = state(s["raw"], s["before"], s["bridge"], s["blank"], s["cut"], yes)
    same = state(*[s[n] for n in ("raw", "before", "bridge", "blank", "cut", "over")])
    heading = stops(line) | noise_key(line).isin(NOISE)
    # before the list: the first line with text must be one, or a single word in capitals
    token = F.regexp_replace(line, r"^[ .;:!?()\[\]{}]+|[ .;:!?()\[\]{}]+$", "")
    single = token.rlike(r"^[A-Za-z][A-Za-z0-9'’\-]*$") & (token.rlike(r"^.+[A-Z]") | ((F.upper(token) == token) & (F.lower(token) != token)))
    begins = ~(heading | ends_list(line) | prose(line)) & (line.rlike(PARTS) | single)
    seek = F.when(line == "", same).when(begins, state(line, line, no, no, no, no)).otherwise(over)
    # within it
    tail, parts, open_ = wrapped_end(line, s["before"]), line.rlike(PARTS), s["before"].rlike(PARTS + r"\s*$")
    blank = F.when(s["bridge"] & ~s["blank"], state(s["raw"], s["before"], s["bridge"], yes, s["cut"], no)).otherwise(over)
    ends = heading | (ends_list(line) & ~_goes_on(line, s["before"])) | (s["blank"] & ~tail)
    more = (~prose(line) & (parts | open_)) | tail
    piece = F.regexp_replace(line, r"^[ .;:!?()\[\]{}]+|[ .;:!?()\[\]{}]+$", "")
    cut = s["cut"] | (tail & (F.size(words_of(line)) == 1) & piece.rlike(r"^[A-Z][a-z]?$"))
    added = state(F.concat(s["raw"], F.lit(" "), line), line, open_ & ~parts, no, cut, no)
    inside = F.when(line == "", blank).when(ends | ~more, over).otherwise(added)
    return F.when(s["over"], same).when(s["raw"] == "", seek).otherwise(inside)


def detected_keywords(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``found_keywords`` (an array) and ``keywords_confidence`` for the manuscript in column ``text``.

    The first labelled line counts: a label with a colon or dash in any case, or one
    that is capitalised. At most fifteen items of 64 characters that hold a letter are
    kept, each once in any case. Confidence is high from three items on, unless the list
    or its last word is cut off, else medium; without items it is low. Null texts have none.
    Texts without a word of a label are not looked at line by line.
    """
    maybe = F.coalesce(F.col(text).rlike(r"(?i)key\s*words?|index\s+terms?"), F.lit(False))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    strict, loose = (lambda x: like(x, LABEL)), (lambda x: x.rlike(LOOSE))
    at = F.transform(F.col("_lines"), lambda x, i: F.when(strict(x) | loose(x), i))
    first = F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0))
    line = F.get("_lines", F.col("_at"))
    given = F.trim(F.when(strict(line), F.regexp_extract(line, _u(LABEL), 2)).otherwise(F.regexp_extract(line, LOOSE, 1)))
    unsure = (given != "") & ((~strict(line) & ~given.rlike(PARTS)) | prose(given))
    start = F.struct(given.alias("raw"), line.alias("before"), F.lit(False).alias("bridge"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), unsure.alias("over")).cast(_STATE)
    rest = F.slice("_lines", F.col("_at") + 2, F.size("_lines"))
    out = rows.withColumn("_lines", F.when(maybe, lines)).withColumn("_at", first).withColumn("_unsure", F.col("_at").isNotNull() & unsure)
    # an array of one state, so that it is computed once and not wherever a field of it is named
    out = out.withColumn("_end", F.when(F.col("_at").isNotNull(), F.array(F.aggregate(rest, start, _step))))

    def items_of(end: Column) -> Column:
        parts = F.split(end["raw"], PARTS + "+")
        bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^[ .;:]+|[ .;:]+$", ""), r"(?U)(?<=\w)\s+-(?=\w)", "-"))
        good = F.filter(bare, lambda p: (F.length(p) <= LONGEST) & p.rlike(r"\p{L}"))
        lower = F.transform(good, lambda p: F.lower(p))
        return F.slice(F.filter(good, lambda p, i: F.array_position(lower, F.lower(p)) == i + 1), 1, ITEMS)

    def told(end: Column) -> Column:
        broken = end["raw"].rlike(r"(?:[;,·•|]\s*|\.{2,}\s*|…\s*)$") | end["cut"]
        return F.struct(items_of(end).alias("items"), broken.alias("broken"))

    out = out.withColumn("_told", F.get(F.transform("_end", told), F.lit(0)))
    items = F.when(~F.col("_unsure"), F.col("_told.items"))
    kept = F.coalesce(items, F.array().cast("array<string>"))
    sure = F.when(F.size(kept) == 0, "low").when((F.size(kept) >= 3) & ~F.col("_told.broken"), "high").otherwise("medium")
    return out.withColumns({"found_keywords": kept, "keywords_confidence": sure}).drop("_lines", "_at", "_unsure", "_end", "_told")


def _u(pattern: str) -> str:
    return "(?U)" + pattern
