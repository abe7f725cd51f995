"""Sentence boundaries by cascading tables of break and no-break rules, for mixed languages and scripts.

A rule is (break?, what stands before, what stands after). The rules of a table are tried in order and the first that
fits decides a position, whatever the mark; positions are what follows a run of end marks with its closing quotes and
brackets, and the spaces after Thai words. Texts are mixed and their language tag is often wrong, so tables are chosen by the
text: ``marks`` comes first, then the tables of the languages of its scripts, those whose small words the paragraph has most
of before others (a sentence of another language may stand in any paragraph), the common table last. Thai positions have a table of their own.

A text is first cut into paragraphs: at blank lines, and at every line feed unless the lines of its block
between blank lines are wrapped to a width (:func:`wrapped_blocks`). A paragraph end always ends a sentence. Thai has no end marks: there a space between two Thai
words, or between Thai and a run of other text that is no mere insertion, ends one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: End marks, closing marks that belong to the sentence they follow, and opening quotes with their partners.
END_MARKS = ".。!！?？…।؟｡॥‼⁇⁈⁉"
CLOSERS = "”’»」』）)]】〉》｣"
QUOTES = {"“": "”", "„": "“", "「": "」", "『": "』", "«": "»", '"': '"', "‘": "’", "｢": "｣"}

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-Я"
_LOW = "a-zß-öø-ÿāăąćčďđēęěğīıłńňőœřśşšťūůűźżžα-ωа-я"
_CJK = "぀-ヿ㐀-鿿豈-﫿가-힯"

_GO_ON = ",;:、，；：،؛"
#: Nothing, or what may stand before a word.
_B = rf"(?<![^\s(„“\"«.’'{re.escape(END_MARKS + CLOSERS)}-])"
_TH = "฀-๿"
_OTHER = rf"[^{_TH}{_CJK}ऀ-ॿ؀-ۿ]"
_WIDE_CLASS = "ᄀ-ᅟ⺀-〾ぁ-㏿㐀-鿿가-힣豈-﫿︰-﹏＀-｠￠-￦"
#: (break?, before, after) by language; before is matched up to the position, after from it (white space included). What
#: stands before begins no earlier than the sentence where it starts with ``\\A``.
RULES: dict[str, list[tuple[bool, str, str]]] = {
    "marks": [
        # one mark that is never anything else
        (True, rf"(?<![{re.escape(END_MARKS)}])[。！？।؟]", rf"(?![{_GO_ON}])"),
        # Japanese that goes on after a quotation
        (False, r"[。！？…][」』]", r"(?:と|って)"),
        # a whole quoted sentence that the sentence around it goes on after
        *[(False, rf"\A\s*{o}[^{c}]*[{re.escape(END_MARKS)}]+{c}", rf"\s*(?=[^\W\d_])[^{_UP}]") for o, c in QUOTES.items()],
        # marks other than the full stop are only undone by text that goes on
        (False, r"[^.…]", rf"\s*(?:[{_GO_ON}]|[{_LOW}])"),
        (True, r"[^.…]", r"\s*\S"),
        (True, rf"[{re.escape(END_MARKS + CLOSERS)}]…", rf"(?!\s*(?:[{_LOW},;:、，；：]))"),
        (True, r"…", rf"(?![\s{_LOW},;:、，；：])"),
    ],
    "en": [
        (True, r"\b(?:[Pp]lan|[Vv]itamin|[Gg]rade|[Cc]lass|[Tt]ype|[Gg]roup|[Oo]ption|[Pp]art|[Aa]ppendix|an?) [A-Z]\.", r"\s+(?:The|Then|This|That|These|Those|There|She|He|It|We|They|You|I|In|An?|But|And)\b"),
        (False, r"\b(?:Mr|Mrs|Ms|Messrs|Dr|Prof|Gen|Col|Lt|Capt|Sgt|Rev|Hon|Gov|Sen|Rep|Mt|St|Ft|vs|cf|viz|e\. ?g|i\. ?e)\.", r"\s*\S"),
        (False, r"\b(?:No|Nos|Fig|Figs|Eq|Sec|Ch|Vol|Art|Rev|Tab|App|pp?|approx|ca|c|est)\.", r"\s*[0-9(]"),
        (True, r"\b[ap]\.\s?m\.", rf"\s+[{_UP}]"),
        (False, r"\b(?:[ap]\.\s?m|et al|etc|Inc|Ltd|Co|Corp|ret|dept|approx)\.\)?", rf"\s*[{_LOW}0-9,;:]"),
    ],
    "de": [
        (False, r"\b(?:Hr|Hrn|Fr|Frl|Dr|Prof|Dipl|Ing|Nr|Abs|Art|Kap|Abb|Tab|Bd|Aufl|vgl|sog|bzw|ca|inkl|zzgl|evtl|ggf|Str|S|z\.\s?B|d\.\s?h|u\.\s?a|o\.\s?ä|i\.\s?d\.\s?R|z\.\s?T|v\.\s?a|u\.\s?U)\.", r"\s*\S"),
        (False, r"\b(?:usw|u\.\s?ä|etc)\.", rf"\s*[{_LOW},;:]"),
        (False, r"\b[0-9]{1,2}\.", r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Quartal|Auflage|Kapitel|Platz)\b"),
    ],
    "fr": [
        (False, r"\b(?:M|MM|Mme|Mlle|Dr|Me|Mgr|St|Ste|env|cf|p\.\s?ex|c\.-à-d|av|bd)\.", r"\s*\S"),
        (False, r"\b(?:art|chap|fig|vol|p|n)\.", r"\s*[0-9]"),
    ],
    "es": [
        (False, r"\b(?:Sr|Sra|Srta|Sres|Dr|Dra|Ud|Uds|Lic|Ing|Prof|aprox|p\.\s?ej|Av)\.", r"\s*\S"),
        (False, r"\b(?:art|págs?|cap|fig|núm|vol)\.", r"\s*[0-9]"),
        (False, r"\bEE\.", r"\s*UU\."),
    ],
    "it": [
        (False, r"\b(?:Sig|Sigg|Sig\.ra|Dott|Dr|Prof|Ing|Avv|On|Spett|cfr|es)\.", r"\s*\S"),
        (False, r"\b(?:pagg?|artt?|cap|fig|n|vol|ca)\.", r"\s*[0-9]"),
        (False, r"\becc\.", rf"\s*[{_LOW}{_GO_ON}]"),
    ],
    "pt": [
        (False, r"\b(?:Sr|Sra|Srs|Dra?|Profa?|Exmo|Av|p\.\s?ex)\.", r"\s*\S"),
        (False, r"\b(?:págs?|art|cap|fig|n|vol)\.", r"\s*[0-9]"),
    ],
    "ru": [
        (False, r"\b(?:[Сс]м|[Рр]ис|[Тт]абл|[Сс]тр|[Гг]л|[Сс]р|[Нн]апр|им|ул|проф|акад|доц|инж|[Тт]\.\s?е|[Тт]\.\s?к)\.", r"\s*\S"),
        (False, r"\b(?:гг?|вв?|руб|коп|тыс|млн|млрд|[Дд]р|[Тт]\.\s?[дп])\.", rf"\s*[{_LOW}0-9{_GO_ON}]"),
    ],
    "ja": [
        (False, r"\b(?:No|Vol|Fig)\.", r"\s*[0-9０-９]"),
    ],
    "hi": [
        (False, _B + r"(?:प्रा|लि|डॉ|श्री|प्रो|सं|कं|पं|स्व|रु|ई)\.", r"\s*\S"),
        (False, r"[ऀ-ॣ]\.", r"\s*[ऀ-ॿ]"),
    ],
    "ar": [(False, _B + r"[؀-ۿ]\.", r"\s*\S")],
    "common": [
        # text that goes on: another mark, a small letter
        (False, r"", r"\s*[,;:、，；：،؛%]"),
        (False, rf"[{_LOW}0-9{_UP}]\.", rf"[{_LOW}0-9_/\\-]"),
        (False, r"", rf"\s*(?:[-–—]\s*)?[{_LOW}]"),
        # initials, paragraph numbers, decimals
        (False, _B + rf"[{_UP}{_LOW}]\.", r"\s*\S"),
        (False, r"\A\s*(?:[0-9]{1,3}|[ivxIVX]{1,4})\.", r"\s*\S"),
        # the space after an end mark is missing
        (False, rf"[{_UP}]\.", rf"[{_UP}][{_UP}.]"),
        (True, r"[.…]", r"\s"),
        (True, rf"[^\s.]\.", rf"(?:[{_UP}][{_LOW}'’ .]|[{_CJK}]|[„“\"«¿¡「‘]|[฀-๿ऀ-ॿ؀-ۿ])"),
        (False, r"[^.]\.", r"\S"),
        (True, r"", r""),
    ],
    "th": [
        (True, "", rf"\s+[{_TH}{_WIDE_CLASS}ऀ-ॿ؀-ۿ“「『]"),
        # an insertion is short, and Thai goes on after it
        (True, "", rf"\s+{_OTHER}+(?=[{_WIDE_CLASS}])"),
        (True, "", rf"\s+(?:(?!\s){_OTHER}+?\s+){{3}}(?!\s){_OTHER}"),
        (True, "", rf"\s+{_OTHER}*?[?!] "),
        (False, "", ""),
    ],
}
#: Small words by which a paragraph in Latin script shows its languages.
SMALL_WORDS = {
    "en": "the of and is that it was for are with this", "de": "der die das und ist den nicht mit ein eine für von", "fr": "le les des et est dans une pour que du sont",
    "es": "el los las y es una por con para del se", "it": "il gli di che è una per con della sono", "pt": "o os e um uma para com não da do são",
}
_SMALL: dict[str, list[str]] = {}
for _lang, _words in SMALL_WORDS.items():
    for _w in _words.split():
        _SMALL.setdefault(_w, []).append(_lang)
_SMALL_RE = re.compile(rf"\b(?:{'|'.join(sorted(_SMALL, key=len, reverse=True))})\b")
_SCRIPT = {"hi": re.compile("[ऀ-ॿ]"), "ar": re.compile("[؀-ۿ]"), "ru": re.compile("[а-яА-Я]"), "ja": re.compile("[぀-ヿ]")}
_LATIN = re.compile(r"[A-Za-zÀ-ÿ]\.")


class Rule:
    """One rule. What stands before is looked for as far back as the expression can reach, or from the sentence start."""

    def __init__(self, brk: bool, before: str, after: str):
        self.brk = brk
        self.whole = before.startswith(r"\A")
        self.before = re.compile((before[2:] if self.whole else f"(?:{before})") + r"\Z") if before else None
        self.after = re.compile(after) if after else None
        self.reach = 0 if self.whole or not before else re._parser.parse(before).getwidth()[1]

    def fits(self, text: str, start: int, at: int, stop: int) -> bool:
        if self.after is not None and not self.after.match(text, at, stop):
            return False
        if self.before is None:
            return True
        if self.whole:
            return self.before.match(text, start, at) is not None
        return self.before.search(text, max(start, at - self.reach), at) is not None


TABLES = {lang: [Rule(*row) for row in rows] for lang, rows in RULES.items()}

_MARKS = re.compile(rf"(?:[{re.escape(END_MARKS)}]+(?:[{re.escape(CLOSERS)}\"“']|[ \xa0\u202f]»)*)+")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[ \t\n\xa0]+(?=\S)")
_THAI = re.compile("[฀-๿]")
_WIDE = re.compile(f"[{_WIDE_CLASS}]")

#: Shortest and longest width that lines are wrapped to.
NARROWEST, WIDEST = 20, 120


def _filled(a: str, b: str, width: float) -> bool:
    """Whether what line ``b`` begins with is more than would have fitted on line ``a``."""
    return len(a) + 1 + (1 if _WIDE.match(b) else len(b.split(None, 1)[0])) > width


def _is_open(line: str) -> bool:
    """Whether a line ends without an end mark."""
    return line.rstrip("”’»」』）)\"“'")[-1:] not in END_MARKS


def _lines(paragraph: str) -> list[str]:
    return [x.strip() for x in paragraph.split("\n") if x and not x.isspace()]


def _width(lines: list[str]) -> int | None:
    """The width that lines keep to, but for a tenth of them and a quarter over ``WIDEST``; None if more are over it."""
    lengths = sorted(len(x) for x in lines if len(x) <= WIDEST)
    if not lengths or len(lengths) < 0.75 * len(lines):
        return None
    return lengths[-1 - len(lengths) // 10]


def is_wrapped(paragraphs: list[str]) -> bool:
    """Whether the line feeds inside these paragraphs only wrap the text to a width.

    Lines that end where a sentence does are paragraphs. Where most do not and few lines are long, they are wrapped. Where
    that says little (a few lines, or a script or text without end marks) what lines begin with must also be more than
    would have fitted on the line before.
    """
    parts = [_lines(p) for p in paragraphs if "\n" in p]
    pairs = [pair for lines in parts for pair in zip(lines, lines[1:])]
    n = len(pairs)
    widest = _width([x for lines in parts for x in lines])
    if not n or widest is None or widest < NARROWEST:
        return False
    open_ends = [(a, b) for a, b in pairs if _is_open(a)]
    if len(open_ends) < (0.5 if n > 3 else 0.6) * n:
        return False
    thai = sum(bool(_THAI.match(a[-1])) for a, _ in open_ends) > 0.5 * n
    if n > 3 and not thai and len(open_ends) < n:
        return True
    return sum(_filled(a, b, 0.82 * widest) for a, b in pairs) >= (0.7 if n > 1 else 1) * n


def wrapped_blocks(blocks: list[str]) -> list[bool]:
    """For each block between blank lines whether its line feeds only wrap it.

    A block of more than four lines is judged by itself; where that fails and not nearly all its lines end where
    sentences do, the blocks of short lines together decide. A smaller block says little and follows those at
    once; where it has long lines itself, its other lines must also fill their width.
    """
    if not any("\n" in p for p in blocks):
        return [False] * len(blocks)
    lines = [_lines(p) if "\n" in p else [] for p in blocks]
    short = {i for i, x in enumerate(lines) if x and _width(x) is not None}
    whole = is_wrapped([blocks[i] for i in short])
    width = _width([x for i in short for x in lines[i]]) if whole else None
    out = []
    for i, own in enumerate(lines):
        if len(own) > 4:
            closed = sum(map(_is_open, own[:-1])) <= 0.2 * (len(own) - 1)
            out.append(is_wrapped([blocks[i]]) or whole and i in short and not closed)
        elif not own or not whole:
            out.append(False)
        else:
            out.append(i in short or all(len(a) <= width and _filled(a, b, width) for a, b in zip(own, own[1:])))
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(from, to) of the paragraphs of a text, white space around them left out."""
    spans, at = [], 0
    for m in _BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    if "\n" in text:
        lines = []
        for (a, b), wrapped in zip(spans, wrapped_blocks([text[a:b] for a, b in spans])):
            while not wrapped and (z := text.find("\n", a, b)) >= 0:
                lines.append((a, z))
                a = z + 1
            lines.append((a, b))
        spans = lines
    out = []
    for a, b in spans:
        piece = text[a:b]
        if piece and not piece.isspace():
            out.append((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())))
    return out


@lru_cache(maxsize=4096)
def _cascade(langs: tuple[str, ...]) -> list[Rule]:
    return [rule for lang in ("marks", *langs, "common") for rule in TABLES[lang]]


def _tables(text: str, a: int, b: int, scripts: tuple[str, ...], latin: bool) -> list[Rule]:
    """The cascade for a paragraph."""
    if not latin or not _LATIN.search(text, a, b):
        return _cascade(scripts)
    hits = Counter(lang for w in _SMALL_RE.findall(text, a, b) for lang in _SMALL[w])
    return _cascade((*sorted(SMALL_WORDS, key=lambda lang: -hits[lang]), *scripts))


def _closed(sentence: str, marks: str) -> int:
    """How many of the trailing characters ``marks`` belong to the sentence."""
    for i, c in enumerate(marks):
        if c in '“"':
            so_far = sentence + marks[:i]
            is_open = so_far.count("„") > so_far.count("“") if c == "“" else so_far.count('"') % 2 == 1
            if not is_open:
                return i
    return len(marks)


def _first(rules: list[Rule], text: str, start: int, at: int, stop: int) -> bool:
    for rule in rules:
        if rule.fits(text, start, at, stop):
            return rule.brk
    return False


def _ends(text: str, a: int, b: int, rules: list[Rule]) -> Iterator[int]:
    """End offsets (exclusive) of the sentences of one paragraph."""
    start = a
    thai = [m.start() for m in _THAI_GAP.finditer(text, a, b) if _first(TABLES["th"], text, a, m.start(), b)] if _THAI.search(text, a, b) else []
    spots = sorted([(m.end(), m.start()) for m in _MARKS.finditer(text, a, b)] + [(at, -1) for at in thai])
    for end, mark in spots:
        if end >= b or mark < 0 and end <= start or 0 <= mark < start:
            continue
        if mark >= 0:
            run = text[mark:end]
            lead = len(run) - len(run.lstrip(END_MARKS))
            if lead < len(run):  # which of the closing marks belong to the sentence
                end = mark + lead + _closed(text[start : mark + lead], run[lead:])
            if not _first(rules, text, start, end, b):
                continue
        yield end
        start = end
    if start < b:
        yield b


def sentence_ends(text: str | None) -> list[int]:
    """1-based code point positions of the last character of each sentence; [] for a null or blank text."""
    if not text or text.isspace():
        return []
    scripts = tuple(lang for lang, has in _SCRIPT.items() if has.search(text))
    latin = _LATIN.search(text) is not None
    out = []
    for a, b in paragraphs(text):
        for end in _ends(text, a, b, _tables(text, a, b, scripts, latin)):
            while end > a and text[end - 1].isspace():
                end -= 1
            if not out or end > out[-1]:
                out.append(end)
    return out


def split_sentences(df: DataFrame, key: str, text: str, *, with_text: bool = True) -> DataFrame:
    """``key, sentence_no, start_char, end_char[, sentence]``: the sentences of each text in order.

    Positions are 1-based code points of the text as stored; every character but white space belongs to one sentence.
    Only ``key`` and ``text`` of ``df`` are read. Null and blank texts give no rows; repeated rows are split each time;
    an empty table gives an empty table. No shuffle; long texts are read in one pass.
    """
    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("sentence_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("sentence", T.StringType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, nos, starts, stops, texts = [], [], [], [], []
            for k, t in zip(pdf["key"], pdf["text"]):
                at = 0
                for i, end in enumerate(sentence_ends(t)):
                    piece = t[at:end]
                    begin = at + len(piece) - len(piece.lstrip())
                    keys.append(k)
                    nos.append(i)
                    starts.append(begin + 1)
                    stops.append(end)
                    if with_text:
                        texts.append(t[begin:end])
                    at = end
            out = {"key": keys, "sentence_no": nos, "start_char": starts, "end_char": stops}
            if with_text:
                out["sentence"] = texts
            yield pd.DataFrame(out)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInPandas(run, schema).withColumnRenamed("key", key)
