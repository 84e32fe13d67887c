"""Sentences of texts in any language, script and layout.

Marks are found by their Unicode sentence-break properties, so the terminators of all scripts count. A blank line
always ends a sentence and a single line break never does by itself. Text between a pair of quotation marks is never
cut; whether its own end mark ends the sentence depends on what follows. A full stop is dropped as an end mark where
the word before it is an abbreviation of its language that takes what follows, where a number goes on, or
where the next word starts in lower case. In Thai a space ends a sentence. The language is told sentence by
sentence, by its script and its frequent words, with the paragraph and the text's label beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\r 　"
#: Marks that end a sentence wherever they stand, those that may (full stops), and the ellipsis.
_MARK = re.compile(r"[\p{SB=STerm}\p{SB=ATerm}…;;]+")
_STOPS = re.compile(r"[\p{SB=ATerm}…]+")
_BREAK = r"(?:\r\n|\r|\n)"
_BLANK = re.compile(rf"{_BREAK}[ \t 　]*{_BREAK}[{WHITE}]*")
_QUOTE = re.compile(r"[\"“”„‟‘‚«»‹›「『]")
_WHITE_RUN = re.compile(rf"[{WHITE}]+")
_WORD_BEFORE = re.compile(r"(?r)[\p{L}\p{M}\p{N}./-]*\G")
_THAI = re.compile(r"\p{Thai}")
_THAI_GAP = re.compile(rf"[{WHITE}]+")
_CAMEL = re.compile(r"\p{Ll}{1,2}\p{Lu}")
_LETTER = re.compile(r"\p{L}")
_UPPER = re.compile(r"[\p{Lu}\p{Lt}]")
_LOWER = re.compile(r"\p{Ll}")
_CASELESS = re.compile(r"\p{Lo}")
_SYMBOL = re.compile(r"[\p{So}\p{Sk}️‍]+")
_GOES_ON = re.compile(r"[,:;،؛、，：；\p{Pe}%/]")
_DASH = re.compile(rf"[-–—―]+[{WHITE}]*")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_CLOSERS = re.compile(r"[)\]}）】》〉」』”’\"'›»«“]")

#: Closing marks of every opening one.
_CLOSING = {
    '"': '"', "“": "”“", "”": "”", "„": "“”‟", "‟": "”", "‘": "’", "‚": "‘’",
    "«": "»", "»": "«»", "‹": "›", "›": "‹›", "「": "」", "『": "』",
}


class _Words(NamedTuple):
    """What a language suppresses full stops for."""

    #: Abbreviations before a name or a word: no sentence ends behind them.
    words: frozenset
    #: Abbreviations as above that are other words in lower case, so the capital counts.
    names: frozenset = frozenset()
    #: Abbreviations before a number; before anything else they may end a sentence.
    numbers: frozenset = frozenset()
    #: Words of one letter in lower case, which are no abbreviations.
    letters: frozenset = frozenset()
    #: Frequent words, by which a paragraph's language is told.
    common: frozenset = frozenset()


def _of(words: str, names: str = "", numbers: str = "", letters: str = "", common: str = "") -> _Words:
    return _Words(*[frozenset(x.split()) for x in (words, names, numbers, letters, common)])


# Abbreviations, one-letter words and frequent words of each language.
LANGUAGES = {
    "da": _of(
        "adr afd ang bl.a ca cand dir dr d.v.s dvs e.kr eks evt f.eks fhv f.kr f.m forf frk gl hhv hr iflg inkl insp jf jfr jvf kpt kst lign modsv mdl nuv obl opr overs p.g.a pga pr prof præs resp sct sekr skt smed sml spec st stk tidl tilsv vedr vejl",
        "", "apr aug bd bl ca d dec feb fig jan jul jun kap kl mar nov nr okt p pp s sep sept tab tel tlf vol", "å ø ö i",
        "og i at det er en til på som med for af de ikke den han hun et vi jeg du har var fra sig blev kan skal vil om men nu efter ved ud op der også mere hvad mens siden ifølge eller over under fik får blev bliver dem sin deres mod uden",
    ),
    "sv": _of(
        "adr ang bl.a ca d.v.s dr dvs e.kr enl ev evt f.kr f.m forts hr inkl jfr kpt modsv p.g.a pga prof resp sekr skt spec s.k st t.ex tidl",
        "", "apr aug bd bl ca d dec feb fig jan jul jun kap kl mar nov nr okt p pp s sep sept tab tel vol", "å ö i",
        "och i att det är en till på som med för av de inte den han hon ett vi jag du har var från sig blev kan ska vill om men nu efter vid ut upp där också mer vad medan sedan enligt eller över under fick får blir dem sin deras mot utan ej",
    ),
    "en": _of(
        "approx brig capt cdr cf cmdr cpl dr e.g esp ft i.e messrs mr mrs ms mt mx prof resp sgt st supt viz vs v",
        "Col Gen Gov Hon Lt Maj Rep Rev Sen", "apr aug c ca ch chap dec feb fig jan jul jun mar nov oct p para pp sec sect sep sept tab tel vol v", "a i",
        "the and of to a in is that it for was on with as he she his her be at by this they we you not have had from or an were their which one all would there been has more after who when but will down then into its",
    ),
    "de": _of(
        "abg bzw ca d.h dipl.-ing dr ehem einschl evtl geb ggf hl hr i.d.r inkl insb kath m.e niederl o.g prof s.o s.u sog st u.a vgl z.b z.t z.zt zzgl",
        "Fr Ing Lic", "abb abs apr art aug bd bl ca dez feb jan jul jun kap kl mar nov nr nrn okt p s sep sept tab tel vol", "",
        "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an er sie wir ich dem war bei nach aus wie im am wird oder um noch über einen hat so zum zur wer was ihr mir dir uns aber wenn nur vor bis man sind einer durch wurde dann doch jetzt",
    ),
    "fr": _of("c.-à-d cf dr env m mgr mlle mme p.ex prof st ste", "", "apr art cap ch chap déc fig fol n no nos nov nº oct p para pp s sept t tel v vol", "y à a", "le la les et de des du un une est en que qui dans pour il elle pas sur au aux ce se avec ne par plus nous vous je ils son sa ses ont été mais ou leur cette fut après selon"),
    "es": _of("d.a dr dra ej lic p.ej prof sr sra sres srta ud uds", "Fr Gen Ing Lic", "art c cap fig fol n no nos num núm nº p pag pp pág t tel v vol", "y e o u a ó", "el la los las y de del un una es en que para se con no por más su al lo como pero sus le ya o fue ha este sí porque esta entre cuando muy sin sobre también me hasta hay donde quién según quien"),
    "it": _of("dott dott.ssa dr prof sig sig.ra", "", "art cap fig n p pag pp t vol", "e o è é i a", "il lo la gli le e di del della un una è in che per si con non da più suo al come ma anche sono ha nel alla dei delle dal questo"),
    "ru": _of("акад бул гр инж ок проф пр рис см ср т.е т.к т.н тов ул", "", "апр гл п рис с стр", "а и о у я в к с"),
    "el": _of("δηλ δρ κ.κ κα π.χ περ πρβλ σ.σ", "", "αρ σ σελ", "ο η α ω ή"),
    "hi": _of("डॉ श्री प्रो पं"),
    "ar": _of("د أ م ش"),
}
#: Other names of these languages.
_SAME = {"no": "da", "nb": "da", "nn": "da", "dan": "da", "nor": "da", "swe": "sv", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "rus": "ru", "ell": "el", "gre": "el", "hin": "hi", "ara": "ar"}
_TOLD_BY_WORDS = [x for x, w in LANGUAGES.items() if w.common]
_PLAIN_WORD = re.compile(r"\p{L}+")


def _together(*langs: str) -> _Words:
    return _Words(*[frozenset().union(*[part[i] for part in (LANGUAGES[x] for x in langs)]) for i in range(len(_Words._fields))])


#: Lists of the languages told by script; they share no word with the others, and stand beside those of every text.
_OTHER_SCRIPTS = _together("ru", "el", "hi", "ar")


def language_code(lang: str | None) -> str | None:
    """The language of LANGUAGES that a label like "da", "DAN " or "en-GB" names; None if it names none."""
    code = re.split(r"[-_]", lang.strip().lower())[0] if lang else ""
    code = _SAME.get(code, code)
    return code if code in LANGUAGES else None


#: The languages of every frequent word of two letters or more; single letters are initials.
_LANGUAGES_OF = {w: [x for x in _TOLD_BY_WORDS if w in LANGUAGES[x].common] for x in _TOLD_BY_WORDS for w in LANGUAGES[x].common if len(w) > 1}


def _told(text: str) -> list[tuple[int, str]]:
    """How many frequent words of each language a text has, the most first."""
    counts = dict.fromkeys(_TOLD_BY_WORDS, 0)
    for w in _PLAIN_WORD.findall(text.lower()):
        for x in _LANGUAGES_OF.get(w, ()):
            counts[x] += 1
    return sorted(((n, x) for x, n in counts.items()), reverse=True)


def _near(told: list[tuple[int, str]]) -> list[str]:
    """The language with the most words, and close seconds."""
    return [x for n, x in told if n and n >= 0.75 * told[0][0]]


class _Language:
    """The lists for a sentence as far as it is read. Texts change language from one sentence to the next."""

    def __init__(self, label: str | None):
        self.label = language_code(label)
        self._paragraph: tuple[str, list[str]] = ("", [])

    def of(self, paragraph: str, start: int, end: int) -> _Words:
        """By the words of paragraph[start:end]; where these tell little, by the paragraph and the label as well.

        A sentence without any frequent word is given all lists.
        """
        told = _told(paragraph[start:end])
        near = _near(told)
        if not near:
            return _join(*_TOLD_BY_WORDS)
        if told[0][0] < 2:
            if self._paragraph[0] is not paragraph:
                self._paragraph = paragraph, _near(_told(paragraph))
            near = [*near, *self._paragraph[1], *([self.label] if self.label in _TOLD_BY_WORDS else [])]
        return _join(*dict.fromkeys(near))


@lru_cache(maxsize=256)
def _join(*langs: str) -> _Words:
    return _Words(*[a | b for a, b in zip(_together(*langs), _OTHER_SCRIPTS)])


# Fixed values. German ordinals are numbers with a full stop; words before them, and nouns in capitals that go on behind.
_GERMAN_AFTER_ORDINAL = frozenset(
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner Quartal Klasse Jahrhundert Platz Stock Etage Liga Tag Runde Spieltag Mal Halbzeit Minute Stunde Woche Monat Jahr Jahrestag Geburtstag Auflage Kapitel Reihe Semester Bezirk Weltkrieg".split()
)
_ANY = _join(*_TOLD_BY_WORDS)
_GERMAN_BEFORE_ORDINAL = frozenset("am im vom zum zur der die das dem den des bis ab seit beim ins".split())
# Fixed values. Words of speech that tie the clause behind a quotation to it, in scripts without case.
_SPEECH = re.compile(r"^(?:と|って|と)|[说說喊问問叫称稱道讲講]|(?:कहा|पूछा|बोल|बताया|कहना)|(?:กล่าว|พูด|ถาม|บอก)|(?:قال|قالت|سأل|أضاف|صرح)|(?:言った|述べた|語った|話した)")


def _quotes(text: str) -> list[tuple[int, int]]:
    """Spans (start, end exclusive) of the outermost quotations of a paragraph; marks without a partner open none."""
    spans: list[tuple[int, int]] = []
    gone: set[str] = set()
    at = 0
    while m := _QUOTE.search(text, at):
        i = m.start()
        at = i + 1
        mark = text[i]
        if mark in gone or i + 1 == len(text):
            continue
        before = text[i - 1] if i else " "
        if mark in "\"”‘“" and (before.isalnum() or (mark in "\"”" and text[i + 1] in WHITE)) and not _CJK.match(before) and not _THAI.match(before):
            continue
        close = -1
        for c in _CLOSING[mark]:
            j = text.find(c, i + 1)
            if mark in "‘‚":
                while j >= 0 and j + 1 < len(text) and text[j + 1].isalnum():  # an apostrophe
                    j = text.find(c, j + 1)
            if j >= 0 and (close < 0 or j < close):
                close = j
        if close < 0:
            gone.add(mark)
        else:
            spans.append((i, close + 1))
            at = close + 1
    return spans


def _abbreviated(text: str, start: int, dot: int, following: str, after: str, language: _Language) -> bool:
    """Whether the full stop at ``dot`` belongs to the word before it, with ``following`` the next character."""
    m = _WORD_BEFORE.search(text, start, dot) if dot > start else None
    token = m.group() if m else ""
    token = token.lstrip("./-")
    if not token:
        return False
    word = token.rsplit("/", 1)[-1].rsplit("-", 1)[-1]
    low = token.lower()
    number = following.isdigit()
    if word.isdigit():
        if _UPPER.match(following):
            head = text[max(start, dot - len(token) - 12) : dot - len(token)].split()
            noun = re.match(r"\p{L}+", after)
            return bool(head) and head[-1] in _GERMAN_BEFORE_ORDINAL and bool(noun) and noun.group() in _GERMAN_AFTER_ORDINAL
        return False
    if "/" in token and len(word) == 1:
        return False
    last = word.rsplit(".", 1)[-1]
    # the language is asked for only where some language has the word
    maybe = low in _ANY.words or low in _ANY.numbers or last.lower() in _ANY.numbers or token in _ANY.names or len(last) == 1
    lists = language.of(text, start, dot) if maybe else _ANY
    if number and (low in lists.numbers or last.lower() in lists.numbers or low in lists.words or (token in ("No", "Nos"))):
        return True
    if low in lists.words or token in lists.names:
        if token == "St" and not number:  # Main St. is a street, which may end a sentence; St. Ives is none
            before = _PLAIN_WORD.search(text[start : dot - len(token)].rstrip(WHITE).rsplit(" ", 1)[-1])
            return before is None or not _UPPER.match(before.group()) or before.start() > 0 or not text[start : dot - len(token)].strip(WHITE).count(" ")
        return True
    head = text[max(start, dot - len(token) - 6) : dot - len(token)].rstrip(WHITE)
    if low in ("п", "д", "б", "h", "b", "ej") and (head.endswith(".") and head[-2:-1].isalpha() and head[-3:-2] in (" ", "", " ")):
        # the second half of an abbreviation written with a space: z. B., d. h.; i t. d. may end a sentence
        return low in ("ej", "h", "b")
    if len(last) == 1 and last.isalpha() and not _CASELESS.match(last):
        if _UPPER.match(last):
            return bool(_UPPER.match(following)) and not (len(word) > 1 and "." not in word)
        if "." in word:  # a.m., m.v., u.s.w.: taken above if they never end a sentence
            return False
        if last == "г" and head[-1:].isdigit():
            return False
        return last not in lists.letters and not head[-1:].isdigit()
    return False


def _ends(text: str, start: int, end: int, mark: re.Match, quoted: bool, lead: bool, language: _Language) -> bool:
    """Whether a sentence ends at ``end``, behind ``mark`` and its closing marks; there is more text behind it."""
    gap = _WHITE_RUN.match(text, end)
    at = gap.end() if gap else end
    following = text[at]
    stop = _STOPS.fullmatch(mark.group()) is not None
    if _GOES_ON.match(following):
        return False
    dash = _DASH.match(text, at)
    if dash and dash.end() < len(text):
        behind = text[dash.end()]
        if quoted or not gap:
            return False
        return not _LOWER.match(behind)
    if _LOWER.match(following) and not _CAMEL.match(text, at):
        return False
    if quoted:
        if not stop and not gap and not _CASELESS.match(following) and not _UPPER.match(following) and following not in _CLOSING:
            return False
        if _CASELESS.match(following):
            until = _MARK.search(text, at)
            clause = text[at : until.start() if until else len(text)]
            if _THAI.match(following):
                return bool(gap)
            said = _SPEECH.search(clause[:40])
            if said and clause.startswith(("と", "って")):
                return False
            return not (said and not lead)
        return True
    if not stop:
        return True
    dots = mark.group()
    if len(dots) > 1 or dots == "…":  # an ellipsis
        return bool(gap) or not _CASELESS.match(following)
    before = text[mark.start() - 1] if mark.start() > start else ""
    if not gap and end == mark.end():
        if following.isdigit() or not before:
            return False
        if _UPPER.match(following):
            m = _WORD_BEFORE.search(text, start, mark.start())
            token = m.group() if m else ""
            if "." in token and not token[-1:].isdigit():
                return len(token.rsplit(".", 1)[-1]) > 2 and at + 1 < len(text) and not _abbreviated(text, start, mark.start(), following, text[at : at + 24], language)
            if len(token) < 2 and not token.isdigit():
                return False
            nxt = text[at + 1 : at + 2]
            return (bool(_LOWER.match(nxt)) or nxt in WHITE) and not _abbreviated(text, start, mark.start(), following, text[at : at + 24], language)
        if _CASELESS.match(following) and (before.isdigit() or before.isascii()):
            return False
    return end != mark.end() or not _abbreviated(text, start, mark.start(), following, text[at : at + 24], language)


def _paragraph(text: str, language: _Language) -> Iterator[tuple[int, int]]:
    """Sentences of a text without blank lines, which starts and ends with a non-white character."""
    spans = _quotes(text)
    opens = {a for a, _ in spans}
    n = len(text)
    start = at = 0
    k = 0
    thai = _THAI.search(text) is not None
    while at < n:
        # the next place where a sentence may end: a mark outside quotations, the end of a quotation, a Thai space
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        limit = spans[k][0] if k < len(spans) else n
        quoted = lead = False
        m = _MARK.search(text, at, limit) if at < limit else None
        if m is None or (thai and _THAI_GAP.search(text, at, m.start())):
            gap = _THAI_GAP.search(text, at, m.start() if m else limit) if thai and at < limit else None
            if gap:
                at = gap.end()
                if at < n and _thai_end(text, start, gap):
                    yield start, gap.start()
                    start = at
                continue
        if m is None:
            if k == len(spans):
                break
            a, end = spans[k]
            k += 1
            at = end
            if end >= n:
                break
            inner = end - 1
            while inner > a + 1 and text[inner - 1] in WHITE:
                inner -= 1
            marks = _MARK.search(text, inner - 1, inner) if inner - 1 > a else None
            if marks is None:
                continue
            b = inner - 1
            while b - 1 > a and _MARK.match(text[b - 1]):
                b -= 1
            m = _MARK.match(text, b)
            quoted, lead = True, text[start:a].strip(WHITE) != ""
        else:
            end = at = m.end()
            if ";" in m.group() or ";" in m.group():  # the Greek question mark
                if not re.match(r"\p{Greek}", text[m.start() - 1 : m.start()]):
                    continue
        while end < n and end not in opens and _CLOSERS.match(text, end):
            end += 1
        sign = _SYMBOL.match(text, w.end() if (w := _WHITE_RUN.match(text, end)) else end) if end < n else None
        if sign:  # a symbol behind the mark goes with the sentence, and so do marks behind the symbol
            tail = _WHITE_RUN.match(text, sign.end())
            more = _MARK.match(text, tail.end() if tail else sign.end())
            if more:
                at = max(at, sign.end())
                continue
            end = sign.end()
        at = max(at, end)
        if end >= n:
            break
        if _ends(text, start, end, m, quoted, lead, language):
            yield start, end
            gap = _WHITE_RUN.match(text, end)
            start = at = gap.end() if gap else end
    if start < n:
        yield start, n


def _thai_end(text: str, start: int, gap: re.Match) -> bool:
    """Whether a gap ends a Thai sentence."""
    before, after = text[gap.start() - 1], text[gap.end()]
    if _SYMBOL.match(after) or _GOES_ON.match(after):
        return False
    held = _THAI.search(text, start, gap.start()) is not None
    if _THAI.match(before):
        return True
    return held and (_THAI.match(after) is not None or not before.isalnum())


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, end exclusive) of the sentences of a text, in code points; none for null or blank text.

    ``lang`` is a label, which may be missing or wrong: a sentence's own words come first.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    language = _Language(lang)

    def add(a: int, b: int) -> None:
        while a < b and text[a] in WHITE:
            a += 1
        while b > a and text[b - 1] in WHITE:
            b -= 1
        if a < b:
            part = text[a:b]
            out.extend((a + x, a + y) for x, y in _paragraph(part, language))

    at = 0
    for m in _BLANK.finditer(text):
        add(at, m.start())
        at = m.end()
    add(at, len(text))
    return out


def split_sentences(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc, start_pos INT, end_pos INT): one row per sentence of every document; end_pos is exclusive.

    ``lang`` names the column of language labels, None if there is none. Positions count code points. Null and blank
    texts give no rows; repeated documents give repeated rows; texts of any length are processed whole. Other columns
    are ignored.
    """
    label = F.col(f"`{lang}`") if lang else F.lit(None).cast("string")
    rows = documents.select(F.col(f"`{doc}`"), F.col(f"`{text}`"), label.alias("__lang")).where(f"`{text}` IS NOT NULL")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids: list = []
            spans: list = []
            for i, t, label in zip(x[doc], x[text], x["__lang"]):
                got = sentences(t, label)
                ids.extend([i] * len(got))
                spans.extend(got)
            yield pd.DataFrame({doc: pd.Series(ids, dtype=x[doc].dtype), "start_pos": pd.Series([a for a, _ in spans], dtype="int32"), "end_pos": pd.Series([b for _, b in spans], dtype="int32")})

    return rows.mapInPandas(split, f"`{doc}` {documents.schema[doc].dataType.simpleString()}, start_pos int, end_pos int")
