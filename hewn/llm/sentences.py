"""Sentence boundaries across languages and scripts (problem 10).

Breaks follow the sentence-break character properties (terminators of all
scripts, closing marks), with abbreviation lists per language, with quoted
speech and brackets kept whole, and with the blank rule for Thai.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.session import bounded_batches

# Abbreviations by language, lower case, without the last full stop.
# title: a name follows, and the word is capitalised in Latin script ("Ms. Venn", but "8 ms. The").
# always: a word must follow, so the stop never ends a sentence.
# refer: ends no sentence before a figure or a word in lower case ("art. 5", but "modern art. The").
# maybe: ends a sentence unless the next word goes on in lower case.
ABBREVIATIONS = {
    "en": {
        "title": "dr mr mrs ms prof st gen rep sen mt messrs",
        "always": "e.g i.e vs cf viz resp",
        "refer": "fig figs tab eq eqs sec vol ch pp p s n no nos app approx art c ca cap nr",
        "maybe": "etc inc ltd co corp jr sr bros u.s u.k u.n e.u a.m p.m al est dept min max",
    },
    "de": {
        "title": "dr prof st hr fr ing dipl",
        "always": "z.b d.h u.a bzw vgl ggf evtl s.o s.u z.t i.d.r vs cf",
        "refer": "ca nr abb tab abs art kap bd s p fig tel",
        "maybe": "usw u.s.w o.ä u.ä etc sek min max",
    },
    "fr": {
        "title": "m mm mme mlle dr pr prof st",
        "always": "p.ex c.-à-d cf vs",
        "refer": "chap ex env art fig tab vol p pp n no nos",
        "maybe": "etc min max",
    },
    "es": {
        "title": "sr sra srta sres dr dra d dña ud prof",
        "always": "p.ej ee cf vs",
        "refer": "cap núm pág art fig tab vol aprox n p pp ej n.º no.º",
        "maybe": "etc etcétera ee.uu cía s.a a.m p.m min max",
    },
    "ru": {"always": "т.е т.к см им ул", "refer": "рис табл стр гл", "maybe": "т.д т.п др г гг мин сек тыс млн млрд руб", "title": ""},
    "ar": {"title": "د أ م", "always": "", "refer": "", "maybe": ""},
    "hi": {"title": "डॉ श्री पं", "always": "", "refer": "", "maybe": "म.प्र"},
}
# First parts of abbreviations written in two parts ("z. B.", "p. ex.", "т. д.").
FIRST_PART = {"en": "i e", "de": "z d u i s o", "fr": "p c", "es": "p", "ru": "т и"}
# Frequent words by language; a sentence may begin with them, a name does not.
FREQUENT = {
    "en": "the a an this that these those it its he she they we you i is are was then there here in on at of by for from with if when while after before but and so as to not no nothing every each all only",
    "de": "der die das den dem des ein eine einen es er sie wir ich ist sind war dann danach dort hier in im am an auf bei für von mit wenn nach vor aber und so als zu nicht nichts jede jeder jedes nur wer",
    "fr": "le la les l un une des il elle nous on ce cette ces est sont puis dans en au aux du de par pour avec si quand après avant mais et ne pas rien chaque qui que",
    "es": "el la los las un una es son esto esta este luego en al del de por para con si cuando después antes pero y no nada cada que se quien",
}

# Words before a German ordinal ("den 91. Abschnitt").
ORDINAL_LEAD = frozenset("der die das den dem des am im vom zum zur beim ab bis seit nach vor jeder jede jedes jeden jedem".split())

# Verbs after quoted speech ("‘Too slow?’ Ann asked").
SPEECH = (
    "asked|asks|said|says|replied|wrote|writes|answered|added|noted|cried|called|wanted|wondered|thought|explained|"
    "fragte|sagte|schrieb|rief|meinte|demanda|dit|écrivit|répondit|preguntó|dijo|escribió|respondió|спросил|спросила|сказал|сказала"
)


def _chars(prop: str) -> str:
    """All characters with a property of the Unicode data, as the inside of a character class."""
    found = regex.findall(prop, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)])), regex.V1)
    return "".join(re.escape(c) for c in found)


_MARKS = _chars(r"[\p{Sentence_Terminal}…‥．｡]")
_LINE = "(?:\r\n|[\n\r\x0b\x0c\x85 ])"
_PARAGRAPH = re.compile(rf"{_LINE}[^\S\r\n]*(?:{_LINE}[^\S\r\n]*)*{_LINE}| ")
_SPAN = re.compile(
    r'"[^"]*"|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|»[^«»]*«|‹[^‹›]*›|「(?:[^「」]|「[^「」]*」)*」|『[^『』]*』|《[^《》]*》'
    r"|(?<!\w)‘(?:[^‘’]|(?<=\w)’(?=\w))*’|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】"
)
_HAS_SPAN = re.compile(r"[\"“„«‹「『（(\[【《»‘]")
#: Closing marks that may also open; they count as closing only at the end of a span.
_BOTH = frozenset("\"“”«»‘")
_CLOSE = frozenset(regex.findall(r"[\p{Pe}\p{Pf}]", "".join(map(chr, range(0x10000))))) | _BOTH | frozenset("'’*_`")
_EMOJI = re.compile(f"(?:[^\\S\r\n]*[{_chars(r'[\p{Emoji_Presentation}\p{Extended_Pictographic}--[\d#*©®™‼⁉]]')}][️‍\U0001F3FB-\U0001F3FF]*)+")
_MARK = re.compile(f"[{_MARKS}]+")
_BLANKS = re.compile(r"\s*")
_THAI = re.compile("(?<=[ก-๛])\\s+(?=[\"“(]?[ก-๛])")
_HAS_THAI = re.compile("[ก-๛]")
_WORD_BEFORE = re.compile(r"[^\s\"“„«‹「『（(\[【《〈…。！？]+\Z")
_SPACED_ABBREVIATION = re.compile(r"(?:^|[\s\"“„«(\[])((?:[^\W\d_]{1,4}\.\s?){1,3}[^\W\d_][\w.]{0,3})\Z")
_DIGITS = re.compile(r"\d{1,4}\Z")
_WIDE = frozenset("。！？｡．।॥؟۔")
_SQUASH = re.compile(r"\s+")
_ELISION = re.compile(r"^(?:[^\W\d_]{1,2}|[Qq]u)['’](?=\w)")
_NAME = re.compile(r"[\w.]+")
_SPEAKER = re.compile(rf"(?:[\w.-]+\s+){{1,3}}(?:{SPEECH})\b|(?:{SPEECH})\b")


KINDS = {k: {w: kind for kind, words in by.items() for w in words.split()} for k, by in ABBREVIATIONS.items()}
# words of one script cannot be taken for those of another, so those of the other scripts hold everywhere
for _k in ("en", "de", "fr", "es"):
    KINDS[_k] |= KINDS["ru"] | KINDS["ar"] | KINDS["hi"]
    FIRST_PART[_k] += " " + FIRST_PART["ru"]
KNOWN = frozenset(w for k in KINDS.values() for w in k)
# titles of two letters or more before a name, and words before a figure, are as clear in a text of another language
TITLES = frozenset(w for k in KINDS.values() for w, kind in k.items() if kind == "title" and len(w) > 1)
REFER = frozenset(w for k in KINDS.values() for w, kind in k.items() if kind == "refer" and len(w) > 1)
FIRST_PART = {k: frozenset(v.split()) for k, v in FIRST_PART.items()}
FREQUENT = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
_LATIN_WORD = re.compile(r"[^\W\d_]+")


class Language:
    """The languages that a stop may stand in: those with most frequent words near it, else in its paragraph, in the whole text, else ``hint``, else English."""

    def __init__(self, text: str, hint: str | None = None):
        hint = (hint or "").strip().lower()[:2]
        self.text, self.hint, self.last, self.found = text, (hint if hint in FREQUENT else "en",), None, ()

    @staticmethod
    def of(text: str) -> tuple[str, ...]:
        words = _LATIN_WORD.findall(text.lower())
        hits = {k: sum(w in v for w in words) for k, v in FREQUENT.items()}
        most = max(hits.values())
        return tuple(k for k, n in hits.items() if n == most) if most else ()

    def __call__(self, paragraph: str, start: int, end: int) -> tuple[str, ...]:
        near = self.of(paragraph[max(start, end - 80) : end + 60])
        if near:
            return near
        if paragraph is not self.last:
            self.last, self.found = paragraph, self.of(paragraph) or self.of(self.text) or self.hint
        return self.found


def _lower_start(text: str, at: int) -> bool:
    while at < len(text) and not text[at].isalnum():
        at += 1
    return at < len(text) and text[at].islower()


def _name_start(text: str, at: int) -> bool:
    """A lower-case identifier such as ``rank_digest`` or ``shard7qk``."""
    m = _NAME.match(text, at, at + 60)
    return bool(m) and ("_" in m[0] or any(c.isdigit() for c in m[0]))


def _end_marks(p: str, spans, ends):
    """(mark, start, end of closing marks, end of emoji, end of blanks) of each run of end marks in a paragraph."""
    at, size, found = 0, len(p), _MARK.search
    while m := found(p, at):
        c = m.end()
        while c < size:
            if p[c] in _CLOSE and (p[c] not in _BOTH or c + 1 in ends):
                c += 1
            elif p[c].isspace() and c + 1 < size and p[c + 1] == "»" and c + 2 in ends:
                c += 2
            else:
                break
        e = c
        if c < size and (p[c] > "※" or (p[c].isspace() and c + 1 < size and (p[c + 1] > "※" or p[c + 1].isspace()))):
            k = _EMOJI.match(p, c)
            e = k.end() if k else c
        at = _BLANKS.match(p, e).end()
        yield m[0], m.start(), c, e, at


def _ends(p: str, start: int, mark: str, first: int, close: int, emoji: int, nxt: int, spans, starts, language) -> bool:
    """Whether the end marks at ``first`` in paragraph ``p`` end the sentence that began at ``start``."""
    if nxt >= len(p):
        return True
    gap = nxt > emoji
    if starts:
        i = bisect.bisect_right(starts, first) - 1
        if i >= 0 and spans[i][1] > first:  # inside a quote or bracket
            a, b = spans[i]
            if close < b or not gap:
                return False
            if p[a] in "(（[【" and a > start:
                return False
            if _lower_start(p, nxt):
                return a > start and _name_start(p, nxt)
            return not (a <= start and _SPEAKER.match(p, nxt))
    if mark[-1] in _WIDE:
        return True
    if not gap:
        return emoji > close or (mark[-1] in "!?…" and p[nxt] > "⺀")
    if "!" in mark or "?" in mark or emoji > close:
        return not (close > first + len(mark) and _lower_start(p, nxt) and not _name_start(p, nxt))
    if mark[0] == "…" or len(mark) > 1:
        return not _lower_start(p, nxt) or _name_start(p, nxt)
    if mark != ".":
        return True
    head = p[max(start, first - 80) : first]
    w = _WORD_BEFORE.search(head)
    if not w:
        return False
    word = _ELISION.sub("", w[0])
    low, c = word.lower(), p[nxt]
    if len(word) <= 4 and word.isdigit():
        if len(word) == len(head.strip()):
            return False  # an enumerator opens the sentence
        if _lower_start(p, nxt):
            return _name_start(p, nxt)
        before = _WORD_BEFORE.search(head[: len(head) - len(word)].rstrip())
        return not (before and before[0].lower() in ORDINAL_LEAD and c.isupper())
    if len(word) > 8:
        return True
    spaced = _SPACED_ABBREVIATION.search(head[-16:]) if len(word) <= 4 else None
    for known in (_SQUASH.sub("", spaced[1]).lower() if spaced else "", low):
        kind = next((KINDS[k][known] for k in language(p, start, nxt) if known in KINDS[k]), None) if known in KNOWN else None
        if kind is None and (known in REFER and c.isdigit() or known in TITLES and c.isupper() and word[0].isupper()):
            return False
        if kind == "maybe" or (kind == "refer" and not c.isdigit()):
            return not _lower_start(p, nxt) or _name_start(p, nxt)
        if kind in ("always", "refer") or (kind == "title" and (word[0].isupper() or word[0] > "ɏ")):
            return False
    if len(word) == 1:
        langs = language(p, start, nxt)
        unit = head[:-1].rstrip()[-1:].isdigit()
        if any(word in FIRST_PART[k] for k in langs) and not unit and "." in p[nxt + 1 : nxt + 4]:
            return False
        if word.isupper() and c.isupper():
            if any(_LATIN_WORD.match(p, nxt)[0].lower() in FREQUENT[k] for k in langs):
                return True  # "Plan B. Then", unlike "J. Strand"
            before = _WORD_BEFORE.search(head[:-1].rstrip())
            return bool(before) and before[0][-1] == "." and any(KINDS[k].get(before[0][:-1].lower()) == "refer" for k in langs)
    return True


def _within(at: int, spans, starts) -> bool:
    i = bisect.bisect_right(starts, at) - 1
    return i >= 0 and spans[i][1] > at


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, blanks at either end left out; none for null or blank texts. ``lang`` counts where a text's own words don't tell its language."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []

    def emit(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    language = Language(text, lang)
    at, thai_text = 0, bool(_HAS_THAI.search(text))
    cuts = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    for a, b in [*cuts, (len(text), len(text))]:
        p = text[at:a]
        spans = [m.span() for m in _SPAN.finditer(p)] if _HAS_SPAN.search(p) else []
        starts, closed = [x for x, _ in spans], {y for _, y in spans}
        start = 0
        blanks = [m.end() for m in _THAI.finditer(p)] if thai_text and _HAS_THAI.search(p) else []
        k = 0
        for mark, first, close, emoji, nxt in _end_marks(p, spans, closed):
            while k < len(blanks) and blanks[k] <= nxt:
                if blanks[k] > start and not _within(blanks[k] - 1, spans, starts):
                    emit(at + start, at + blanks[k])
                    start = blanks[k]
                k += 1
            if _ends(p, start, mark, first, close, emoji, nxt, spans, starts, language):
                emit(at + start, at + nxt)
                start = nxt
        for e in blanks[k:]:
            if e > start and not _within(e - 1, spans, starts):
                emit(at + start, at + e)
                start = e
        emit(at + start, at + len(p))
        at = b
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_text: bool = False) -> DataFrame:
    """One row (id, start_at, end_at[, sentence]) per sentence, in one narrow pass over the whole texts.

    Null, empty and blank texts give no row; repeated rows give their sentences
    each; other columns are not read. The language column may be missing, null or wrong.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string").alias("lang"))
    names = ["id", "start_at", "end_at"] + ["sentence"] * with_text

    def run(batches):
        for b in batches:
            ids, s, e, t = [], [], [], []
            for doc, text, lang in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py()
                for x, y in sentence_spans(text, lang):
                    ids.append(doc)
                    s.append(x)
                    e.append(y)
                    if with_text:
                        t.append(text[x:y])
            cols = [pa.array(ids, pa.int64()), pa.array(np.array(s, np.int32)), pa.array(np.array(e, np.int32))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(t, pa.string())] * with_text, names=names)

    schema = "id long, start_at int, end_at int" + ", sentence string" * with_text
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
