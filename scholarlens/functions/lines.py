"""What a line of a manuscript looks like, as column expressions over lines with white space squeezed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings that are no text, words of titles, name parts, and the patterns of structural lines.
NOISE = [
    "abstract", "introduction", "table of contents", "chapter", "acknowledgements", "acknowledgment", "dedication", "preface", "references", "bibliography",
    "appendix", "index", "list of figures", "list of tables", "methodology", "review of related literature", "related literature", "background of the study",
    "statement of the problem", "scope and limitations", "significance of the study", "definition of terms", "theoretical framework", "conceptual framework",
    "college of computing studies", "pampanga state university", "psu", "ccs", "dhvsu", "thesis", "dissertation", "capstone project", "submitted", "presented",
    "partial fulfillment", "degree", "bachelor", "master", "doctor",
]
TITLE_WORDS = [
    "system", "using", "based", "approach", "study", "analysis", "design", "development", "implementation", "monitoring", "detection", "recognition", "learning",
    "classification", "prediction", "platform", "application", "framework", "model", "management", "technology",
]
PARTICLES = ["de", "del", "dela", "delos", "delas", "da", "di", "du", "van", "von", "der", "la", "le", "y"]
SUFFIXES, HONORIFICS = ["jr", "jr.", "sr", "sr.", "ii", "iii", "iv"], ["dr", "dr.", "engr", "engr.", "prof", "prof.", "mr", "mr.", "ms", "ms.", "mrs", "mrs."]
CHAPTER = (
    r"(?i)^(chapter\s+[ivxlcdm\d]+|the problem and its background|review of related literature|related literature|introduction|methodology|"
    r"results and discussion|conclusion|recommendations|references|bibliography|appendix|abstract)[\s.:\-]*$"
)
BY = r"(?i)^(by|submitted\s+by|prepared\s+by|presented\s+by|researchers?)\b\s*:?"
FRONT = (
    r"(?i)^(a|an)\s+(capstone|thesis|dissertation|research|project|undergraduate\s+thesis)\b|"
    r"^(in\s+partial\s+fulfilment|in\s+partial\s+fulfillment|in\s+fulfilment|in\s+fulfillment|presented\s+to|submitted\s+to)\b"
)
CONTACT = r"[\w.+-]+@[\w-]+\.[\w.-]+|(?:\+?63|0)[\s\-]?9\d{2}[\s\-]?\d{3}[\s\-]?\d{4}|\b\d{7,}\b"
_U = "(?U)"


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)``, with the value computed once however often it is named: it goes through an array of one."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def like(line: Column, pattern: str) -> Column:
    """Words, digits and white space are those of all scripts."""
    return line.rlike(_U + pattern)


def noise_key(line: Column) -> Column:
    """A line in lower case without punctuation at its ends."""
    return F.regexp_replace(F.lower(line), r"""^[ .,;:!?\-'"“”()\[\]{}]+|[ .,;:!?\-'"“”()\[\]{}]+$""", "")


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def has_contact_details(line: Column) -> Column:
    return like(line, CONTACT)


def name_like(line: Column) -> Column:
    """Two to six words of letters, each with a capital but for particles and suffixes, with four letters at least."""
    words = words_of(line)
    core = lambda w: F.regexp_replace(w, r"^[.,\-']+|[.,\-']+$", "")
    shaped = F.forall(words, lambda w: (core(w) == "") | F.lower(core(w)).isin(PARTICLES + SUFFIXES) | core(w).rlike(r"^\p{Lu}"))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return ~like(line, r"[^A-Za-z.,\-'À-ɏ\s]") & F.size(words).between(2, 6) & (letters >= 4) & shaped


def author_line(line: Column) -> Column:
    """An entry of a list of authors: an initial, a title or a suffix in a line without title words, or a surname, comma and given name."""
    words = words_of(line)
    titled = F.exists(F.array(*map(F.lit, TITLE_WORDS)), lambda t: F.contains(F.lower(line), t))
    marked = F.exists(words, lambda w: w.rlike(r"^[A-Z]\.,*$") | F.lower(w).isin(SUFFIXES + HONORIFICS))
    return (~titled & ~like(line, r"[^A-Za-z.,\-'À-ɏ\s]") & marked) | (name_like(line) & line.rlike(r",\s+[A-Z]"))


def structural(line: Column) -> Column:
    """A line that is part of the frame: a heading, who it is by or for, an address. "By" with four words or more after it may be a title's."""
    rest = F.trim(F.regexp_replace(line, r"(?i)^by\b\s*:?", ""))
    of_title = like(line, r"(?i)^by\b(?!:)") & let(rest, lambda r: (r != "") & (F.size(words_of(r)) > 3) & ~author_line(r))
    heading = let(noise_key(line), lambda k: k.isin(NOISE) | like(k, CHAPTER))
    return heading | (like(line, BY) & ~of_title) | like(line, FRONT) | has_contact_details(line)


def ends_block(line: Column) -> Column:
    """A line that no title goes on with."""
    return structural(line) | author_line(line)
