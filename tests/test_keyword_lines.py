import random
import re

from scholarlens.functions import lines as L
from scholarlens.operators import abstracts as A
from scholarlens.operators import keyword_lines as K

ENDS = ".,;:!?()[]{}"


def letters(x):
    return sum(c.isalpha() for c in x)


def is_prose(x):
    n, verb, dot = len(x.split()), re.search(K.VERB, x), x[-1:] in ".?!" and x != ""
    return bool(re.match(K.OPENING, x) or (re.match(K.SUBJECT, x) and verb) or (n >= 6 and verb and dot) or (n >= 8 and dot and not re.search(K.PARTS, x)))


def key(x):
    return x.lower().strip(" .,;:!?-'\"“”()[]{}")


def is_author(x):
    plain = not re.search(r"[^A-Za-z.,\-'À-ɏ\s]", x)
    words = x.split()
    if plain and not any(t in x.lower() for t in L.TITLE_WORDS):
        if any(re.fullmatch(r"[A-Z]\.", w.rstrip(",")) or w.lower() in L.SUFFIXES + L.HONORIFICS for w in words):
            return True
    cores = [w.strip(".,-'") for w in words]
    shaped = plain and 2 <= len(words) <= 6 and letters(x) >= 4
    shaped = shaped and all(not c or c.lower() in L.PARTICLES + L.SUFFIXES or c[0].isupper() for c in cores)
    return bool(shaped and re.search(r",\s+[A-Z]", x))


def is_structural(x):
    by = re.match(L.BY, x)
    if by and re.match(r"(?i)by\b(?!:)", x):
        rest = re.sub(r"(?i)^by\b\s*:?", "", x).strip()
        if rest and len(rest.split()) > 3 and not is_author(rest):
            by = None
    return bool(key(x) in L.NOISE or re.match(L.CHAPTER, key(x)) or by or re.match(L.FRONT, x) or re.search(L.CONTACT, x))


def is_heading(x):
    return bool(re.match(A.STOP, x) or re.match(L.CHAPTER, key(x)) or re.match(K.NUMBERED, x) or key(x) in L.NOISE)


def parts_in(x):
    return len(re.findall(K.PARTS + "+", x))


def ends_list(x):
    if is_structural(x):
        return True
    first = (re.split(K.PARTS + "+", x, maxsplit=1)[0].split() or [""])[0].strip(ENDS).lower()
    if any(re.fullmatch(r"[A-Z]\.", w) for w in x.split()):
        return is_author(x)
    return is_author(x) and parts_in(x) < 2 and first not in L.TITLE_WORDS


def open_end(x):
    return bool(re.search(K.PARTS + r"\s*$", x))


def overrides(x, before):
    words = x.split()
    if not parts_in(x) or is_prose(x):
        return False
    if any(re.fullmatch(r"[A-Z]\.", w.rstrip(",")) or w.rstrip(",.").lower() in L.SUFFIXES + L.HONORIFICS for w in words):
        return False
    pieces = re.split(K.PARTS + "+", x)
    return (open_end(before) and len(words) >= 3) or (parts_in(before) >= 2 and len(pieces) >= 2 and all(len(p.split()) >= 2 for p in pieces[:2]))


def is_tail(x, before):
    words = x.split()
    if not x or is_prose(x) or parts_in(x):
        return False
    if len(words) == 1:
        return bool(re.fullmatch(r"[A-Za-z][A-Za-z0-9'’\-]*", x.strip(ENDS)))
    if 2 <= len(words) <= 4 and words[0].lower() in ("and", "or") and not re.search(K.VERB, x) and x[-1] not in ".?!":
        return True
    if not parts_in(before) or not 2 <= len(words) <= 3 or len(re.split(K.PARTS + "+", before)[-1].split()) != 1:
        return False
    cores = [w.strip(ENDS) for w in words]
    return words[0].lower().strip(ENDS) not in K.SMALL and all(c and (c[0].isupper() or c.isupper() or any(d.isdigit() for d in c)) for c in cores)


def detect(text):
    """The automaton, a line at a time."""
    rows = [" ".join(x.split()) for x in (text or "").split("\n")]
    for at, x in enumerate(rows):
        strict = re.match(K.LABEL, x)
        label = strict or re.match(K.LOOSE, x)
        if label:
            break
    else:
        return [], "low"
    raw = label[2 if strict else 1].strip()
    if raw and ((not strict and not parts_in(raw)) or is_prose(raw)):
        return [], "low"
    before, bridge, cut, queue = x, False, False, rows[at + 1 :]
    if not raw:
        while queue and not queue[0]:
            queue.pop(0)
        if not queue:
            return [], "low"
        x = queue.pop(0)
        token = x.strip(" .;:!?()[]{}")
        single = re.fullmatch(r"[A-Za-z][A-Za-z0-9'’\-]*", token) and (token.isupper() or any(c.isupper() for c in token[1:]))
        if is_heading(x) or ends_list(x) or is_prose(x) or not (parts_in(x) or single):
            return [], "low"
        raw = before = x
    while queue:
        x = queue.pop(0)
        if not x:
            if not bridge or not queue or not is_tail(queue[0], before):
                break
            x = queue.pop(0)
        if is_heading(x) or (ends_list(x) and not overrides(x, before)):
            break
        tail = is_tail(x, before)
        if not tail and (is_prose(x) or not (parts_in(x) or open_end(before))):
            break
        if tail and len(x.split()) == 1 and re.fullmatch(r"[A-Z][a-z]?", x.strip(" .;:!?()[]{}")):
            cut = True
        raw, bridge, before = f"{raw} {x}", open_end(before) and not parts_in(x), x
    items, seen = [], set()
    for p in re.split(K.PARTS + "+", raw):
        p = re.sub(r"(?<=\w)\s+-(?=\w)", "-", p.strip().strip(" .;:"))
        if p and len(p) <= K.LONGEST and letters(p) and p.lower() not in seen and len(items) < K.ITEMS:
            seen.add(p.lower())
            items.append(p)
    if not items:
        return [], "low"
    broken = cut or re.search(r"(?:[;,·•|]\s*|\.{2,}\s*|…\s*)$", raw)
    return items, "high" if len(items) >= 3 and not broken else "medium"


LABELS = ["Keywords: IoT, Rain, real -time alert", "KEYWORDS", "Keyword/s: a; b", "keywords, authors and the system", "Index Terms — x | y · z", "Keywords smart farm, soil", "Keywords The system is good",
          "key words:", "Keywords: Web App, Geofencing", "keywords", "Keywords: The study improves access, and supports students.", "Keywords: one, two,", "Key Words Water Level", "Keywords:    "]
REST = ["", "", "Technology", "and Memorizing Information", "Level Monitoring.", "Cats, Mabalacat City", "Software Development Methodology, Web-based Approach", "Santos, Juan P.", "Cruz, Maria", "INTRODUCTION",
        "1. Introduction", "The study was done in town.", "abstract", "CyberEscape", "machine learning, Machine Learning, deep learning", "Dr. Reyes, Ana", "juan@psu.edu.ph, 09171234567", "by SMART SENSORS AND EARLY WARNING",
        "by Juan Cruz", "A thesis presented", "S", "Te", "x" * 70 + ", ok", "one; two; three, four", "it works", "are used", "Rain gauge, sensor,", "Moreover, it provides a quick answer to all of them.", "College of Computing Studies",
        "Security, Privacy", "...", "data…", "12, 34", "de la Cruz, Ana, Maria", "Chapter IV", "or others", "and it is used", "Web 2.0", "Smart Farm, and"]


def test_automaton_against_the_rules(spark):
    rng = random.Random(11)
    texts = [None, "", "no label\nat all, here", *[x for x in LABELS]]
    for _ in range(700):
        texts.append("\n".join([*rng.choices(["A title", "", "Some text, here"], k=rng.randint(0, 2)), rng.choice(LABELS), *rng.choices(REST, k=rng.randint(0, 6))]))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {r.id: (r.found_keywords, r.keywords_confidence) for r in K.detected_keywords(frame, "body").collect()}
    wrong = [(t, got[k], detect(t)) for k, t in enumerate(texts) if got[k] != detect(t)]
    assert not wrong, wrong[:3]
    kinds = {c for _, c in got.values()}
    assert kinds == {"high", "medium", "low"} and sum(len(i) > 3 for i, _ in got.values()) > 40


def test_line_types(spark):
    rows = [*LABELS, *REST, "Juan de la Cruz III", "MARIO PAUL B. REYES, Don Honorio Ventura State University", "A SYSTEM FOR DR. JOSE RIZAL", "Researchers: all", "by: Ana Maria Cruz Santos Lim", "Ñandú, Á", "O'Neil, Ann", "cruz, Ana"]
    frame = spark.createDataFrame([(k, " ".join(x.split())) for k, x in enumerate(rows)], "id int, x string")
    line = frame.x
    got = {r.id: tuple(r)[1:] for r in frame.select("id", L.author_line(line), L.structural(line), L.noise_key(line), K.prose(line), K.ends_list(line)).collect()}
    for k, x in enumerate(" ".join(r.split()) for r in rows):
        assert got[k] == (is_author(x), is_structural(x), key(x), is_prose(x), ends_list(x)), x
