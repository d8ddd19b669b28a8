"""Abstracts of documents by page: margins that repeat are taken off, and only a body with a sure beginning and end is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.functions.lines import let

#: Pages looked at, lines of a margin, longest margin line, and the bounds of an abstract.
PAGES, MARGIN, MARGIN_LENGTH = 15, 3, 120
MOST_CHARS, FEWEST_WORDS, LETTERS, SINGLE, SHORT = 6000, 20, 0.7, 0.12, 80
#: What lines look like.
HEADING = r"(?i)^abstract\s*(?:[:.\-—]\s*(.*))?$"
ROMAN = r"m*(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
NUMBER = rf"(?i)^(?:[\d\s]+|{ROMAN})$"
INSTITUTION = r"(?i)^(?:.{0,90}\b(?:university|college)|college of .{1,80}|(?:main|\w+) campus)$"
#: Stands in all that INSTITUTION matches, and is told faster.
INSTITUTION_HINT = r"(?i)(?:university|college|campus)$|^college of "
SECTION = (
    r"(?i)^(?:(?:\d+(?:\.\d+)*|[IVX]+)(?:[.)]\s*|\s+))?(?:introduction|background(?: of the study)?|methodology|methods?|materials and methods|"
    r"results(?: and discussion)?|discussion|conclusions?|recommendations?|literature review|review of related literature)\s*[:.]?$"
)
KEYWORDS = r"(?i)\b(?:keywords?|key\s+words?|index\s+terms)\s*:"
STOP = (
    r"(?i)^(?:keyword\s*/\s*s|keywords?|key\s*words?|index\s+terms?)(?:\s*[:\-—]\s*|\s*$)|^(table\s+of\s+contents|list\s+of\s+(figures|tables|appendices)|"
    r"acknowledge?ments?|acknowledgment|dedication|preface|chapter\s+[ivxlcdm\d]+|introduction|references|bibliography|appendix|the\s+problem\s+and\s+its\s+background)\b"
)
LEADER = r"([^\w\s])\1{2,}"
CONTENTS = r"(?i)^(table\s+of\s+contents|contents)\s*[:.\-—]?\s*$"
ENDED = r"[.!?]$"
FINISHED = r"""[.!?][”’"')]*$"""


def _like(line: Column, pattern: str) -> Column:
    """Words and white space are those of all scripts."""
    return line.rlike("(?U)" + pattern)


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (doc, page, pos, line) of the first pages without numbers, institutions and margins, white space squeezed; blank ones stay.

    A margin is one of the three lines at either end of a page that is no blank; it goes
    with all lines like it on its page if it is a margin on two pages or more, is no
    heading and no end of a sentence.
    """
    # most lines have single spaces and nothing else to squeeze
    squeezed = F.trim(F.when(F.col("line").rlike(r"[^ -~]|  "), F.regexp_replace("line", r"(?U)\s+", " ")).otherwise(F.col("line")))
    rows = lines.filter((F.col("page") < PAGES) & F.col("doc").isNotNull() & F.col("line").isNotNull())
    # one shuffle, by document, serves all windows and what follows
    rows = rows.select("doc", "page", "pos", squeezed.alias("line")).repartition("doc")
    line, page = F.col("line"), Window.partitionBy("doc", "page")
    real = F.when(line != "", 1)
    rows = rows.withColumns({"_top": F.count(real).over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.count(real).over(page)})
    edge = (line != "") & ((F.col("_top") <= MARGIN) | (F.col("_all") - F.col("_top") < MARGIN))
    rows = rows.withColumns({"_h": F.xxhash64("line"), "_edge": edge})
    like = Window.partitionBy("doc", "_h", "line")
    rows = rows.withColumn("_here", F.max("_edge").over(Window.partitionBy("doc", "_h", "line", "page")))
    on = F.when(F.col("_edge"), F.col("page"))
    margin = F.col("_here") & (F.min(on).over(like) < F.max(on).over(like))
    rows = rows.withColumn("_margin", margin)
    keeps = (F.length(line) >= MARGIN_LENGTH) | _like(line, HEADING) | _like(line, STOP) | line.rlike(ENDED)
    kept = rows.filter((line == "") | ~(_like(line, NUMBER) | (_like(line, INSTITUTION_HINT) & _like(line, INSTITUTION)) | (F.col("_margin") & ~keeps)))
    return kept.select("doc", "page", "pos", "line")


def _joined(parts: str) -> Column:
    """Lines as one text; a word cut by a hyphen is put together if it goes on in lower case."""

    def put(text: Column, line: Column) -> Column:
        cut = text.endswith("-") & line.rlike(r"^\p{Ll}")
        return F.when(text == "", line).when(cut, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)).otherwise(F.concat(text, F.lit(" "), line))

    return F.trim(F.regexp_replace(F.aggregate(parts, F.lit(""), put), r"\s+", " "))


def recovered(lines: DataFrame, scanned: bool = False) -> DataFrame:
    """(doc, page, abstract, confidence): the first sure abstract of each document of ``lines`` (doc, page, pos, line); pages count from 0.

    It follows a heading, on its page and at most the next one, up to keywords, a
    section or another part that must follow; another heading, a row of dots or a title
    in capitals before that make it unsure. A page with a table of contents has no
    heading. What is too long or short, has few letters or many single ones, or does not
    end a sentence is left out. Confidence is high, but medium for scans, for bodies of
    which a third of the lines are a word or two, and under 80 words.

    Lines are shuffled once, by document; headings reach the lines of their page and the
    next through a window over pages, so a document costs its lines, twice where headings are.
    """
    line, rows = F.col("line"), cleaned_lines(lines)
    page = Window.partitionBy("doc", "page")
    contents = F.max(_like(line, CONTENTS)).over(page)
    heading = _like(line, HEADING) & ~contents
    head = F.struct(F.col("page").alias("from"), F.col("pos").alias("at"), F.regexp_extract("line", "(?U)" + HEADING, 1).alias("rest"))
    reach = Window.partitionBy("doc").orderBy("page").rangeBetween(-1, 0)
    rows = rows.withColumn("head", F.when(heading, head)).withColumn("heads", F.collect_list("head").over(reach))
    after = rows.filter("line <> ''").select("doc", "page", "pos", "line", F.explode("heads").alias("head")).select("doc", "page", "pos", "line", "head.*")
    after = after.filter((F.col("page") > F.col("from")) | (F.col("pos") > F.col("at")))
    head = Window.partitionBy("doc", "from", "at")
    before = F.coalesce(F.lag("line").over(head.orderBy("page", "pos")), F.when(F.col("rest") != "", F.col("rest")), F.lit(""))
    section = _like(line, SECTION) & (line.rlike(r"^[\p{Lu}\p{Nd}]") | before.rlike(ENDED))
    display = (F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.split(line, " ")) >= 2)
    kind = (
        F.when(_like(line, KEYWORDS), "keywords")
        .when(_like(line, STOP) | section, "end")
        .when(_like(line, HEADING) | _like(line, LEADER) | display, "unsure")
    )
    typed = after.select("doc", "from", "at", "rest", "line", F.struct("page", "pos").alias("place"), kind.alias("kind"))
    ends = F.min(F.when(F.col("kind").isNotNull(), F.struct("place", "kind", "line"))).over(head)
    body = typed.withColumn("end", ends).filter("end.kind <> 'unsure'").filter(F.col("place") <= F.col("end.place"))
    # a body that may be one is of bounded length; two pages are what a heading meets
    inner = F.collect_list(F.when(F.col("place") < F.col("end.place"), F.struct("place", "line")))
    found = body.groupBy("doc", "from", "at").agg(F.first("rest").alias("rest"), F.first("end").alias("end"), F.array_sort(inner).alias("parts"))
    tail = F.when(F.col("end.kind") == "keywords", F.trim(F.split("end.line", "(?U)" + KEYWORDS, 2)[0]))
    middle = F.transform("parts", lambda p: p["line"])
    parts = F.filter(F.concat(F.array(F.col("rest")), middle, F.array(F.coalesce(tail, F.lit("")))), lambda x: x != "")
    size = F.length("rest") + F.aggregate(middle, F.lit(0), lambda n, x: n + F.length(x))
    told = found.filter(size <= MOST_CHARS).select("doc", "from", "at", parts.alias("parts")).filter(F.size("parts") > 0)

    def judged(text: Column, words: Column) -> Column:
        """(abstract, confidence), null for a text that reads like none."""
        letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
        single = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
        good = (
            (F.length(text) <= MOST_CHARS) & (F.size(words) >= FEWEST_WORDS) & (letters >= LETTERS * F.length(text))
            & text.rlike(FINISHED) & (single <= SINGLE * F.size(words)) & ~F.contains(text, F.lit("�"))
        )
        broken = F.size(F.filter("parts", lambda p: F.size(F.split(p, " ")) <= 2)) * 3 > F.size("parts")
        sure = F.when(F.lit(scanned) | broken | (F.size(words) < SHORT), "medium").otherwise("high")
        return F.when(good, F.struct(text.alias("abstract"), sure.alias("confidence")))

    told = told.select("doc", "from", "at", let(_joined("parts"), lambda t: let(F.split(t, " "), lambda w: judged(t, w))).alias("told"))
    first = told.filter("told is not null").groupBy("doc").agg(F.min_by(F.struct(F.col("from").alias("page"), "told.abstract", "told.confidence"), F.struct("from", "at")).alias("x"))
    return first.select("doc", "x.page", "x.abstract", "x.confidence")
