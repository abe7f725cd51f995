"""Text of scanned pages: lines of the page layout, divided words and misread characters.

None of the passes gathers a document in one task:

1. A document counts as scanned if hardly any line of its current nodes is longer than a printed line and lines are wrapped.
2. Lines at the edges of its nodes, or beside page numbers within them, are brought to a form in which look-alike
   characters are equal; forms that come back are its running heads, and the kinds of page number that come back are its page numbers.
3. Corpus counts over all rows: words and pairs of neighbouring words, and for scripts without spaces characters and pairs
   of characters around those that have look-alikes. They stay distributed.
4. The vocabulary of scanned documents is joined with the counts: for each word its candidate readings by one confusion, and
   for rare words that none explains by two. How often each confusion happens is learned from these, as errors over
   occurrences of what was written.
5. Each node asks for the readings of its words and for the counts of the word pairs they may form; the answers are
   joined to it by key. Only what is bounded is broadcast: counts of words and pairs that make up a given share of the
   corpus, bit sets of fixed size that say what is worth asking for, and characters.
6. Every line is decoded as a noisy channel: confusion probabilities times n-gram likelihood, by Viterbi over the candidate
   words of the line. Running characters are decoded likewise over pair counts. Divided words are joined as the counts of the
   joined word and of the compound with its hyphen say.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.common import current_rows, cut, release

#: Longest line that can be a printed line.
LINE = 100
#: Share of a document's lines that may be longer, and of a node's.
LONG_LINES, LONG_IN_NODE = 0.02, 0.5
#: Words and pairs of words that make up at least this share of the corpus have their counts broadcast: at most 1 / share each.
FREQUENT = 1e-5
#: Bits of the sets that say which words have readings, and which are readings.
BITS = 1 << 22
#: Characters and rows of a frame that a pass returns, but for a single longer row: Arrow takes 2 GB of a column at most.
FRAME_CHARS, FRAME_ROWS = 1 << 24, 100_000
#: Longest word that is its own key in counts; a longer one goes by its digest. Characters and words that are counted at once.
LONGEST, SLICE, AT_ONCE = 100, 1 << 20, 4_000_000
#: Odds of a misread word or character against a rightly read one before the counts are seen; how far the learned
#: probability of a confusion may move them, and what neighbours on each side may.
WORD_ODDS, LETTER_ODDS, MOVE, CONTEXT = 0.15, 0.3, 3.0, 6.0
#: A word seen less often may be read with two confusions; a reading of a word of letters alone is seen so often at least.
RARE, LEAST = 5, 5
#: Pseudo-count of pairs of words.
SMOOTH = 3.0
#: What is read, and what may have been written.
CONFUSED = {
    "c": ("e",), "0": ("o",), "!": ("i", "l"), "5": ("s",), "@": ("a",), "1": ("l", "i"), "9": ("g",), "b": ("h", "ß"), "8": ("b",), "6": ("b",), "$": ("s",), "|": ("l", "i"),
    "rn": ("m",), "li": ("h",), "ii": ("u", "ü"), "cl": ("d",), "vv": ("w",), "a": ("ä",), "o": ("ö",), "u": ("ü",), "ri": ("n",), "m": ("rn",), "nn": ("m",), "d": ("cl",), "ü": ("ti",),
}
#: Groups of characters that are taken for one another.
LOOK_ALIKE = ("的旳", "航舫", "目日曰", "页贞", "人入八", "年牟", "于千干", "本木", "土士", "处外", "未末", "已己巳", "大犬太", "天夫", "今令", "王玉", "问间", "折拆", "贝见", "白自", "治冶", "代伐", "线钱", "侯候", "晴睛", "拨拔", "辨辩", "免兔", "戊戌戍", "住佳", "鸟乌", "田由甲", "ロ口", "ソン", "シツ", "カ力")
PAIRS = [(read, w) for read, written in CONFUSED.items() for w in written]
LIKE = {c: [x for x in group if x != c] for group in LOOK_ALIKE for c in group}
#: Words that head the figures of a table.
TOTALS = {"total", "summe", "合计", "sum", "合計", "小计"}

_LIKES = re.compile("[" + "".join(LIKE) + "]+")
_WIDE = re.compile("[぀-ヿ㐀-鿿]")
_BROKEN = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*)[-‐‑¬\xad]\s*$")
_HYPHENS = "-‐‑¬\xad"
_PIECE = re.compile(r"[^\W\d_][\w!@$|]*")
_TOKEN = re.compile(r"[A-Za-zÀ-ÿ0-9!@$|]*[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9!@$|]*")
_NUMBER = re.compile(r"[0-9lIiOoSsBbgqZz|!]{1,4}")
_ROMAN = re.compile(r"[ivxlcIVXLC!1|]{1,7}")
_SHAPES = {"page N", "page N of N", "seite N", "seite N von N", "seite N / N", "page N / N", "第 N 页", "第 N 页 共 N 页", "共 N 页 第 N 页", "第 N 页 / 共 N 页", "第 N 頁", "- N -", "– N –", "— N —", "[ N ]", "( N )", "N", "N / N", "p. N", "s. N", "R", "- R -", "– R –", "— R —", "[ R ]"}
_EXPLICIT = {s for s in _SHAPES if s not in ("N", "R")}
_FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "i": "l", "|": "l", "5": "s", "$": "s", "9": "g", "@": "a", "c": "e", "8": "h", "6": "h", "b": "h", "u": "h", "ü": "h", "ß": "h", "ä": "a", "ö": "o", **{c: g[0] for g in LOOK_ALIKE for c in g}})
_FOLD_PAIRS = (("rn", "m"), ("nn", "m"), ("el", "d"), ("vv", "w"), ("tl", "h"), ("ll", "h"), ("rl", "n"))


_BLANKS = re.compile(r"\s{3,}")


def fold(text: str) -> str:
    """A form in which characters and pairs of characters that are taken for one another are equal."""
    s = "".join(text.casefold().replace("ss", "s").translate(_FOLD).split())
    for pair, one in _FOLD_PAIRS:
        s = s.replace(pair, one)
    return s


_MAY_COUNT = re.compile(r"[0-9lIiOoSsBbgqZz|!vxcXVC]")
_SPACED = re.compile(r"([第页頁贞共\[\]()/·])")
_PAGE_WORDS = {fold(w): w for w in ("page", "seite", "of", "von", "页")}


def shape(line: str) -> str | None:
    """The kind of page number that a line may hold alone, or None.

    Kinds that begin with ``~`` are any short line with a number in it: page numbers only where they come back on page
    after page.
    """
    if len(line.split(None, 7)) > 7 or not _MAY_COUNT.search(line):
        return None
    tokens = _SPACED.sub(r" \1 ", line).split()
    if not 0 < len(tokens) <= 7 or max(map(len, tokens)) > 20:  # no kind has longer or more words
        return None
    if not any(_NUMBER.fullmatch(t) or _ROMAN.fullmatch(t) for t in tokens):  # every kind has a number
        return None
    out = []
    for i, t in enumerate(tokens):
        if _NUMBER.fullmatch(t) and (any(c.isdigit() for c in t) or t.strip("lI|!") == "") or i and _NUMBER.fullmatch(t):
            out.append("N")
        elif _ROMAN.fullmatch(t) and len(tokens) in (1, 3):
            out.append("R")
        else:
            out.append(_PAGE_WORDS.get(fold(t)) or t.casefold())
    got = " ".join(out)
    if got in _SHAPES:
        return got
    rest = [t for t in out if t not in ("N", "R")]
    if "N" in out and sum(map(len, rest)) <= 8 and not line.rstrip().endswith((".", "。", "%", ")", "）", "”", "，", ",", ";")):
        return "~" + got
    return None


def head_form(line: str) -> str | None:
    """The folded form of what may be a running head, without a page number at either end; None if it is too short."""
    s = _BLANKS.sub("  ", line.strip())
    s = re.sub(r"^[0-9lIoO|!ivxIVX]{1,6}\s{2,}|\s{2,}[0-9lIoO|!ivxIVX]{1,6}$", "", s)
    form = fold(s)
    wide = len(_WIDE.findall(s))
    if s.casefold() in TOTALS or (len(form) < 4 if wide else len(form) < 7) or len(s) > LINE:
        return None
    return form


def _same(form: str, known: str) -> bool:
    """Equal but for up to two neighbouring characters (one, in a short form)."""
    if form == known:
        return True
    a, b = (form, known) if len(form) <= len(known) else (known, form)
    most = 2 if len(b) >= 12 else 1
    if len(b) - len(a) > most:
        return False
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + tail >= len(b) - most


def candidates(word: str, edits: int = 1) -> Iterator[tuple[str, tuple[int, ...]]]:
    """(reading, confusions by number in :data:`PAIRS`) of a word, all of letters, that differ by so many confusions."""
    seen, level = {name(word)}, [(word, ())]
    for left in range(edits - 1, -1, -1):
        made: list[tuple[str, tuple[int, ...]]] = []
        for form, used in level:
            for number, (read, written) in enumerate(PAIRS):
                at = form.find(read)
                while at >= 0:
                    other = form[:at] + written + form[at + len(read) :]
                    key = other if len(other) <= LONGEST else name(other)
                    if key not in seen:
                        seen.add(key)
                        if left:
                            made.append((other, (*used, number)))
                        elif other.isalpha():
                            yield other, (*used, number)
                    at = form.find(read, at + 1)
        level = made


def bit(key: str) -> int:
    return zlib.crc32(key.encode()) % BITS


def name(word: str) -> str:
    """The key of a word: itself, or the digest of a long one, which may stand in any number of pairs."""
    return word if len(word) <= LONGEST else "\x01" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=20).hexdigest()


def frames(rows: Iterable[tuple], columns: list[str], texts: int = 1) -> Iterator[pd.DataFrame]:
    """The rows in frames of a bounded number of characters and rows; one without rows if there are none.

    Only the first columns, as many as ``texts``, are counted.
    """
    # an empty list would become a column of floats, which Arrow does not make one array of texts of
    frame = lambda: pd.DataFrame({c: [r[i] for r in out] for i, c in enumerate(columns)}, dtype=None if out else object)
    out: list[tuple] = []
    size, spots = 0, range(texts)
    for row in rows:
        more = len(row[0]) if texts == 1 else sum([len(row[i] or "") for i in spots])
        if out and (size + more > FRAME_CHARS or len(out) >= FRAME_ROWS):
            yield frame()
            out, size = [], 0
        out.append(row)
        size += more
    yield frame()


class Model:
    """Counts of characters, of frequent words and pairs, of what one node asked for; and the decisions that rest on them.

    ``words``: "w" + word and "b" + word + " " + word to counts; "r" + word to (count, [(reading, count, confusions)]), all by
    their :func:`name`.
    ``odds``: of each confusion, by its number.
    """

    def __init__(self, words: dict[str, object], pairs: dict[str, int], odds: list[float] | None = None, total: int = 1):
        self.words, self.pairs = words, pairs
        self.odds = odds or [WORD_ODDS] * len(PAIRS)
        self.total = max(1, sum(v for k, v in pairs.items() if len(k) == 1))
        self.all_words = max(1, total)
        self.asked: dict[str, object] = {}
        self.kept: dict[str, list[tuple[str, float]]] = {}  # readings of broadcast words
        self.runs: dict[tuple[str, str, str], tuple[str, ...]] = {}  # likely characters between two neighbours

    def get(self, key: str):
        return self.asked.get(key) or self.words.get(key)

    def readings(self, word: str) -> list[tuple[str, float]]:
        """(form, log of odds times count) of a word: itself first."""
        if word in self.kept:
            return self.kept[word]
        key = "r" + name(word)
        own, found = self.get(key) or (0, ())
        out = [(word, math.log(max(own, 0.1)))]
        mixed = not word.isalpha()
        for reading, n, used in found:
            if reading[0] == "\x01":  # the name of a long one
                reading = next(form for form, _ in _possible(word, len(used)) if name(form) == reading)  # noqa: PLW2901
            out.append((reading, math.log(n) + (0.0 if mixed else sum(math.log(self.odds[i]) for i in used))))
        if key in self.words:
            self.kept[word] = out
        return out

    def misread(self, token: str) -> str | None:
        """The likely reading of a word that stands alone, if it was misread."""
        states = self.readings(token.lower())
        best = max(states, key=lambda s: (s[1], s[0]))
        return _case(token, best[0]) if best[1] > states[0][1] else None

    def lift(self, a: str, b: str, less: int) -> float:
        """Log of how much more often the words stand side by side than by chance; ``less`` own occurrences do not count."""
        a, b = name(a), name(b)
        together = max(0, (self.get(f"b{a} {b}") or 0) - less)
        chance = (self.get("w" + a) or 0) * (self.get("w" + b) or 0) / self.all_words
        most = math.log(CONTEXT)
        return min(most, max(-most, math.log((together + SMOOTH) / (chance + SMOOTH))))

    def line(self, low: list[str], run: Running) -> list[tuple[int, str]]:
        """(number, likely reading) of the words of a line that were misread: Viterbi over candidate words.

        How often words stand side by side in this text itself does not count: what a misread word stands beside is no
        evidence for it (each text may have been counted twice). Words without choice part the line.
        """
        kept, asked, words = self.kept, self.asked, self.words
        states = [kept.get(x) or (self.readings(x) if (r := "r" + x) in asked or r in words or len(x) > LONGEST else (None,)) for x in low]
        out = []
        end = 0
        for i in range(len(low)):
            if i < end or len(states[i]) == 1:
                continue
            end = i
            while end < len(low) and len(states[end]) > 1:
                end += 1
            paths: list[tuple[float, tuple[str, ...]]] = [(0.0, (low[i - 1],))] if i else [(score, ("", form)) for form, score in states[0]]
            for k in range(max(i, 1), min(end + 1, len(low))):
                own = 2 * run.beside[low[k - 1], low[k]]
                step = []
                for form, score in states[k] if k < end else ((low[k], 0.0),):
                    s, p = max(((s + self.lift(p[-1], form, own if (p[-1], form) == (low[k - 1], low[k]) else 0), p) for s, p in paths), key=lambda x: x[0])
                    step.append((s + score, (*p, form)))
                paths = step
            best = max(paths, key=lambda x: x[0])[1]
            out += [(k, form) for k, form in zip(range(i, end), best[1:]) if form != low[k]]
        return out

    def joined(self, left: str, right: str) -> tuple[str, str | None]:
        """("join" | "keep", likely reading of the joined word if it was misread) of a word divided at a line end."""
        low_l, low_r = left.lower(), right.lower()
        part = low_l.rsplit("-", 1)[-1]
        count = lambda w: (self.get("r" + name(w)) or (0,))[0]
        join = max(count(low_l + low_r), count(part + low_r))
        keep = max(count(f"{low_l}-{low_r}"), count(f"{part}-{low_r}"))
        if not join and not keep:
            miss = self.misread(part + low_r)
            as_compound = len(self.readings(f"{part}-{low_r}")) > 1
            return ("keep", None) if as_compound and not miss else ("join", miss)
        return ("keep" if keep > join else "join"), None

    def letters(self, text: str) -> list[tuple[int, str]]:
        """(place, likely reading) of misread characters of a script without spaces, by Viterbi over the candidates."""
        out = []
        for m in _LIKES.finditer(text):
            i, j = m.span()
            key = text[i - 1] if i else "", m[0], text[j : j + 1]
            best = self.runs.get(key)
            if best is None:
                if len(self.runs) > 100_000:
                    self.runs.clear()
                best = self.runs[key] = self._run(*key)
            out += [(i + k, c) for k, c in enumerate(best) if c != m[0][k]]
        return out

    def _run(self, before: str, text: str, after: str) -> tuple[str, ...]:
        stay, flip = math.log(1 - LETTER_ODDS), math.log(LETTER_ODDS)
        states = [(0.0, before, ())]
        for own in text:
            step = []
            for c in (own, *LIKE[own]):
                if c != own and not self.pairs.get(c):
                    continue
                score, _, path = max(((s + self._next(p, c), p, path) for s, p, path in states), key=lambda x: x[0])
                step.append((score + (stay if c == own else flip), c, (*path, c)))
            states = step
        return max(((s + self._next(p, after), p, path) for s, p, path in states), key=lambda x: x[0])[2]

    def _next(self, a: str, b: str) -> float:
        if not a or not b:
            base = (self.pairs.get(a or b, 0) + 0.5) / self.total if b else 1.0
            return math.log(base)
        base = (self.pairs.get(b, 0) + 0.5) / self.total
        return math.log((self.pairs.get(a + b, 0) + 2 * base) / (self.pairs.get(a, 0) + 2))


def _case(token: str, word: str) -> str:
    return word.upper() if token.isupper() and len(token) > 1 else word[:1].upper() + word[1:] if token[:1].isupper() else word


#: Kinds of line: blank, running text, running head, page number, figures of a table, title.
BLANK, TEXT, HEAD, PAGE, TABLE, TITLE = "b", "t", "h", "p", "g", "i"


def layout(text: str, heads: list[str], shapes: list[str], opens: bool) -> str:
    """The kind of each line of one node of a scanned document, a letter a line.

    ``heads`` and ``shapes`` are the running heads and kinds of page number of the document; ``opens`` says that the
    node begins the document, whose first line may be its title.
    """
    kinds = []
    widest = 4 * (max(map(len, heads), default=-4) + 2) + 12  # folding makes at most four characters one; page numbers beside
    first = opens
    for line in text.split("\n"):
        bare = "".join(line.split())
        if not bare:
            kinds.append(BLANK)
            continue
        form = head_form(line) if len(bare) <= widest else None
        is_head = form is not None and any(_same(form, h) for h in heads)
        if first:
            first = False
            if is_head:
                kinds.append(TITLE)
                continue
        got = shape(line)
        if got and (got in shapes or got in _EXPLICIT) and not (got == "N" and len(bare) > 3):
            kinds.append(PAGE)
        elif is_head:
            kinds.append(HEAD)
        elif line.strip().casefold() in TOTALS or re.fullmatch(r"[0-9][0-9.,]*", bare):
            kinds.append(TABLE)
        else:
            kinds.append(TEXT)
    return "".join(kinds)


class Running:
    """The running lines of a node: their words, and the words divided at their ends."""

    def __init__(self, text: str, kinds: str):
        self.lines = text.split("\n")
        self.at = [i for i, k in enumerate(kinds) if k == TEXT]
        self.divided: list[tuple[int, int, int, str, str]] = []  # line, line of the rest, end of the first half, both halves
        for a, b in zip(self.at, self.at[1:]):
            m = _BROKEN.search(self.lines[a]) if self.lines[a].rstrip()[-1:] in _HYPHENS else None
            if not m:
                continue
            between = kinds[a + 1 : b]
            if TABLE in between or TITLE in between or BLANK in between and not (PAGE in between or HEAD in between):
                continue
            n = _PIECE.match(self.lines[b].lstrip())
            if not n or n[0].lower() in ("und", "oder", "bzw", "and", "or", "bis"):
                continue
            self.divided.append((a, b, m.end(1), re.search(r"[\w!@$|-]*$", self.lines[a][: m.end(1)])[0], n[0]))

    @cached_property
    def low(self) -> dict[int, list[str]]:
        """Words by line, in small letters."""
        found = {i: _TOKEN.findall(self.lines[i]) for i in self.at if _has_words(self.lines[i])}
        return {i: "\n".join(words).lower().split("\n") for i, words in found.items() if words}

    def running(self) -> str:
        """The running text in small letters."""
        return "\n".join([self.lines[i] for i in self.at]).lower()

    def joins(self) -> set[str]:
        """The words that divided words may be halves of."""
        out = set()
        for *_, left, right in self.divided:
            low_l, low_r = left.lower(), right.lower()
            part = low_l.rsplit("-", 1)[-1]
            out |= {low_l + low_r, part + low_r, f"{low_l}-{low_r}", f"{part}-{low_r}"}
        return out

    @cached_property
    def beside(self) -> Counter:
        """How often words stand side by side."""
        out: Counter = Counter()
        for low in self.low.values():
            out.update(zip(low, low[1:]))
        return out


def tokens(running: str) -> set[str]:
    """What readings of a running text may be asked for."""
    out = set(_TOKEN.findall(running))
    out.update([x[:-1] for x in out if x[-1] in "!|" and len(x) > 2])
    return {x for x in out if len(x) > 1}


def _has_words(line: str) -> bool:
    return line.isascii() or not _WIDE.search(line) or re.search("[A-Za-z]{3}", line) is not None


def label(text: str, kinds: str, model: Model, repair: bool = True) -> tuple[list[tuple[int, str]], list[str]]:
    """([(line_no, noise)], repaired paragraphs if wanted) of one node of a scanned document, whose lines are of these kinds."""
    run = Running(text, kinds)
    lines = run.lines
    found: list[tuple[int, str]] = [(i + 1, "page_no" if k == PAGE else "header") for i, k in enumerate(kinds) if k in (PAGE, HEAD)]
    fixed = {i: lines[i] for i in run.at}
    wrong: set[int] = set()
    # characters: over the running text without its line ends; one for one, so places in the line stay
    if any(_WIDE.search(lines[i]) for i in run.at):
        changed = model.letters("".join("".join([lines[i] for i in run.at]).split()))
        owner = [(i, k) for i in run.at for k, c in enumerate(lines[i]) if not c.isspace()] if changed else []
        for at, c in changed:
            i, k = owner[at]
            wrong.add(i)
            fixed[i] = fixed[i][:k] + c + fixed[i][k + 1 :]
    taken: dict[int, tuple[int, int]] = {}  # characters of a line that belong to a divided word: at its start, at its end
    glue: set[int] = set()
    starts: dict[int, str] = {}  # what a line begins with instead of the second half of a divided word
    for a, b, end, left, right in run.divided:
        how, reading = model.joined(left, right)
        glue.add(a)
        if how == "keep":
            fixed[a] = fixed[a].rstrip()
            continue
        found.append((a + 1, "hyphen"))
        fixed[a] = fixed[a][:end]
        part = left.rsplit("-", 1)[-1]
        taken[a] = (taken.get(a, (0, 0))[0], len(lines[a]) - end + len(part))
        taken[b] = (len(lines[b]) - len(lines[b].lstrip()) + len(right), taken.get(b, (0, 0))[1])
        if reading:
            low = reading.lower()
            if low.endswith(right.lower()):  # the first half was misread
                halves = reading[: len(reading) - len(right)], right
            elif low.startswith(part.lower()):
                halves = part, low[len(part) :]
            else:
                halves = reading[: len(part)], low[len(part) :]
            wrong |= {i for i, old, new in ((a, part, halves[0]), (b, right, halves[1])) if old.lower() != new.lower()}
            fixed[a] = fixed[a][: len(fixed[a]) - len(part)] + _case(part, halves[0].lower())
            starts[b] = _case(right, halves[1].lower())
    for i, low in run.low.items():
        line, numbers = lines[i], range(len(low))
        if i in taken:
            skip = taken[i]
            numbers = [k for k, m in enumerate(_TOKEN.finditer(line)) if m.start() >= skip[0] and m.end() <= len(line) - skip[1]]
            low = [low[k] for k in numbers]  # noqa: PLW2901
        if "!" in line or "|" in line:
            low = [w[:-1] if w[-1] in "!|" and len(w) > 2 and len(model.readings(w)) == 1 else w for w in low]  # noqa: PLW2901
        changed = model.line(low, run)
        if not changed:
            continue
        wrong.add(i)
        places = [m.start() for m in _TOKEN.finditer(line)]
        new, shift = fixed[i], 0
        for k, form in changed:
            at, size = places[numbers[k]], len(low[k])
            reading = _case(line[at : at + size], form)
            new = new[: at + shift] + reading + new[at + shift + size :]
            shift += len(reading) - size
        fixed[i] = new
    for i, start in starts.items():
        indent = len(lines[i]) - len(lines[i].lstrip())
        fixed[i] = fixed[i][:indent] + start + fixed[i][taken[i][0] :]
    found += [(i + 1, "misread") for i in wrong]
    return sorted(found), _paragraphs(kinds, lines, fixed, glue) if repair else []


def _paragraphs(kind: str, lines: list[str], fixed: dict[int, str], glue: set[int]) -> list[str]:
    out: list[str] = []
    last = None
    for i, k in enumerate(kind):
        if k in (PAGE, HEAD):
            continue
        if k == BLANK:
            # a blank line beside page layout does not end a paragraph that goes on
            if not (last is not None and kind[last] == TEXT and (kind[i - 1 : i] in (PAGE, HEAD) and i or kind[i + 1 : i + 2] in (PAGE, HEAD))):
                last = None
            continue
        line = (fixed[i] if k == TEXT else lines[i]).strip()
        if k != TEXT or last is None or kind[last] != TEXT:
            out.append(line)
        elif last in glue:
            out[-1] += line
        else:
            wide = _WIDE.match(out[-1][-1:]) or _WIDE.match(line[:1]) or out[-1][-1:] in "，。、；：！？…”」）》" or line[:1] in "，。、；：！？…”」）》"
            out[-1] += ("" if wide else " ") + line
        last = i
    return out


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter of a word (``[^\\W\\d_]``), and whether it has look-alikes."""
    letter, like = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    letter[[ord(c) for c in re.findall(r"[^\W\d_]", "".join(map(chr, range(0x110000))))]] = True
    like[[ord(c) for c in LIKE]] = True
    return letter, like


class _Numbers(dict):
    """Numbers of words: from 1 for plain ones, -1 for those of wide scripts, from -2 downwards for compounds; 0 ends a text."""

    def __init__(self):
        super().__init__({"\0": 0})
        self.plain, self.compounds, self.parts, self.size = ["\0"], [], [], 0

    def __missing__(self, word: str) -> int:
        self.size += len(word)
        if word >= "⺀":
            n = -1
        elif "-" in word:
            self.compounds.append(word)
            self.parts.append([self.part(x) for x in word.split("-")])
            n = -1 - len(self.compounds)
        else:
            n = self.part(word)
        self[word] = n
        return n

    def part(self, word: str) -> int:
        """Parts of compounds count whatever their script."""
        n = self.get(word, -1)
        if n < 0:
            n = len(self.plain)
            self.plain.append(word)
            if word < "⺀":
                self[word] = n
        return n


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


class _Tally:
    """Counts of :func:`counts` over some texts: words become numbers, and numbers are counted by sorting."""

    def __init__(self):
        self.numbers = _Numbers()
        self.words: list[np.ndarray] = []
        self.whole: Counter = Counter()
        self.letters = np.zeros(0x110000, dtype=np.int64)
        self.around: list[np.ndarray] = []
        self.n = 0

    def add(self, texts: list[str]) -> None:
        letter, like = _classes()
        codes = _codes(" \0 ".join([t.replace("\0", " ") if "\0" in t else t for t in texts]).lower() + " \0 ")
        known = letter[codes]
        keep = known | (codes == 0)
        keep[1:-1] |= (codes[1:-1] == 45) & known[:-2] & known[2:]
        codes[~keep] = 32
        split = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split()
        got = np.fromiter(map(self.numbers.__getitem__, split), dtype=np.int64, count=len(split))
        got = got[got != -1]
        special = got < 0
        if special.any():
            which = (-2 - got[special]).tolist()
            self.whole.update(which)
            parts = [self.numbers.parts[k] for k in which]
            times = np.ones(len(got), dtype=np.int64)
            times[special] = [len(x) for x in parts]
            got, special = np.repeat(got, times), np.repeat(special, times)
            got[special] = [x for part in parts for x in part]
        self.words.append(got)
        wide = ["".join(t.split()) for t in texts if not t.isascii() and _WIDE.search(t)]
        if wide:
            codes = _codes("".join(wide))
            found = np.bincount(codes)
            self.letters[: len(found)] += found
            near = like[codes]
            pairs = near[:-1] | near[1:]
            ends = np.cumsum([len(x) for x in wide])[:-1] - 1
            pairs[ends] = False
            self.around.append((codes[:-1] << 32 | codes[1:])[pairs])
            self.n += len(self.around[-1])
        self.n += len(got)

    def full(self) -> bool:
        return self.n > AT_ONCE or self.numbers.size > FRAME_CHARS

    def rows(self) -> Iterator[tuple[str, int]]:
        both = lambda codes: (x.tolist() for x in (codes >> 32, codes & 0xFFFFFFFF))
        names = [name(w) for w in self.numbers.plain]
        words = np.concatenate([*self.words, np.zeros(1, dtype=np.int64)])
        singles = np.bincount(words, minlength=len(names)).tolist()
        compounds = self.numbers.compounds
        yield from (("w" + w, n) for w, n in zip(names[1:], singles[1:]) if n)
        yield from (("w" + name(compounds[k]), n) for k, n in self.whole.items())
        inside = (words[:-1] != 0) & (words[1:] != 0)
        codes, times = np.unique((words[:-1] << 32 | words[1:])[inside], return_counts=True)
        yield from ((f"b{names[a]} {names[b]}", n) for a, b, n in zip(*both(codes), times.tolist()))
        wide = 0x2E80 + np.flatnonzero(self.letters[0x2E80:])
        yield from ((chr(c), n) for c, n in zip(wide.tolist(), self.letters[wide].tolist()))
        if self.around:
            codes, times = np.unique(np.concatenate(self.around), return_counts=True)
            yield from ((chr(a) + chr(b), n) for a, b, n in zip(*both(codes), times.tolist()))


def tallied(texts: Iterable[str]) -> Iterator[tuple[str, int]]:
    """``token, n`` of the texts; a token may come more than once."""
    tally, some, size = _Tally(), [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > SLICE:
            tally.add(some)
            some, size = [], 0
            if tally.full():
                yield from tally.rows()
                tally = _Tally()
    if some:
        tally.add(some)
    yield from tally.rows()


def counts(texts: DataFrame, text: str) -> DataFrame:
    """``token, n`` over all rows: words (small letters, compounds also whole), pairs of words, characters and pairs of those.

    A word begins with "w", a pair of words with "b"; what is left are characters. Words stand by their :func:`name`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames(tallied(t for pdf in batches for t in pdf["text"]), ["token", "n"])

    parts = texts.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(run, "token string, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def scanned(nodes: DataFrame, salts: int = 16) -> DataFrame:
    """Current nodes of scanned documents: ``node, doc_id, pos, text, kinds`` (a number, and the kinds of lines).

    ``nodes`` has ``doc_id, pos, text, ingested_at``. Rows with a null key are left out; of equal keys the latest row
    counts; null and blank texts have no lines.
    """
    lengths = F.transform(F.split("text", "\n"), F.length)
    n_lines, n_long = F.coalesce(F.size(lengths), F.lit(0)), F.coalesce(F.size(F.filter(lengths, lambda n: n > LINE)), F.lit(0))
    rows = nodes.filter("doc_id is not null and pos is not null").select("doc_id", "pos", "ingested_at", n_lines.alias("lines"), n_long.alias("long"), "text")
    # a node of long lines is not printed lines: its text is not shuffled
    rows = rows.withColumn("text", F.when(F.col("long") <= LONG_IN_NODE * F.col("lines"), F.col("text")))
    now = cut(current_rows(rows, ["doc_id", "pos"], "ingested_at"))
    wrapped = F.col("text").rlike(r"[^\s.。!！?？।:：]\s*\n[^\n]*\S")
    docs = now.groupBy("doc_id").agg(F.sum("lines").alias("lines"), F.sum("long").alias("long"), F.max(wrapped).alias("wrapped"), F.count("text").alias("nodes"), F.min("pos").alias("first"))
    docs = docs.filter((F.col("long") <= LONG_LINES * F.col("lines")) & F.col("wrapped")).select("doc_id", "nodes", "first")
    spread = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = now.filter("text is not null").withColumn("salt", F.pmod(F.xxhash64("pos"), F.lit(salts)).cast("int"))
    mine = salted.join(spread(docs), ["doc_id", "salt"])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                lines = [x for x in t.split("\n") if x.strip()]
                inner = [i for i in range(3, len(lines) - 3) if len(lines[i].strip()) <= 40 and shape(lines[i]) in _EXPLICIT]  # a page ends inside
                near = {0, 1, len(lines) - 2, len(lines) - 1, *inner, *(i - 1 for i in inner), *(i + 1 for i in inner)}
                for x in [lines[i] for i in sorted(near) if 0 <= i < len(lines)]:
                    got = shape(x)
                    if got:
                        out.append((d, "#" + got))
                    if (got is None or got[0] == "~") and (form := head_form(x)):
                        out.append((d, form))
            yield from frames(out, ["doc_id", "form"], 2)

    forms = mine.select("doc_id", "text").mapInPandas(edges, "doc_id string, form string").groupBy("doc_id", "form").count().join(docs, "doc_id")
    often = F.when(F.col("form").startswith("#~"), F.col("count") >= F.greatest(F.lit(3), 0.3 * F.col("nodes"))).when(F.col("form").startswith("#"), (F.col("count") >= 2) & (F.col("count") >= 0.1 * F.col("nodes"))).otherwise((F.col("count") >= 2) & (F.col("count") >= 0.15 * F.col("nodes")))
    # at most four edge lines a node, each form on a tenth of the nodes: no more than 40 a document
    kept = forms.filter(often).groupBy("doc_id").agg(F.array_sort(F.collect_list("form")).alias("forms"))
    profile = docs.join(kept, "doc_id", "left").select(
        "doc_id", "first",
        F.coalesce(F.filter("forms", lambda f: ~f.startswith("#")), F.array().cast("array<string>")).alias("heads"),
        F.coalesce(F.transform(F.filter("forms", lambda f: f.startswith("#")), lambda f: F.substring(f, 2, 40)), F.array().cast("array<string>")).alias("shapes"),
    )

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given = zip(pdf["doc_id"], pdf["text"], pdf["pos"], pdf["heads"], pdf["shapes"], pdf["opens"])
            yield from frames(((d, t, layout(t, list(h), list(s), bool(o)), p) for d, t, p, h, s, o in given), ["doc_id", "text", "kinds", "pos"], 3)

    ready = salted.join(spread(profile), ["doc_id", "salt"]).select("doc_id", "pos", "text", "heads", "shapes", (F.col("pos") == F.col("first")).alias("opens"))
    ready = ready.mapInPandas(laid_out, "doc_id string, pos int, text string, kinds string")
    out = cut(ready.withColumn("node", F.monotonically_increasing_id()))
    release(now)
    return out


def vocabulary(pages: DataFrame) -> DataFrame:
    """``word, joins, long``: the distinct words of the running text, and those that divided words may be halves of.

    ``word`` is the :func:`name`; where that is not the word itself, ``long`` is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            own, joins, running, size = set(), set(), [], 0
            for pdf in batches:
                for t, k in zip(pdf["text"], pdf["kinds"]):
                    r = Running(t, k)
                    joins |= r.joins()
                    running.append(r.running())
                    size += len(running[-1])
                    if size > SLICE:
                        own |= tokens("\n".join(running))
                        running, size = [], 0
                        if len(own) + len(joins) > 200_000 or sum(map(len, own)) > FRAME_CHARS:
                            yield from ((w, w in joins) for w in own | joins)
                            own, joins = set(), set()
            own |= tokens("\n".join(running))
            yield from ((w, w in joins) for w in own | joins)

        yield from frames(((key := name(w), None if key == w else w, j) for w, j in rows()), ["word", "long", "joins"], 2)

    found = pages.select("text", "kinds").mapInPandas(run, "word string, joins boolean, long string")
    return found.groupBy("word", "long").agg(F.max("joins").alias("joins"))  # a name has one word


def readings(words: DataFrame, table: DataFrame) -> DataFrame:
    """``word, joins, n, found``: words with their count and the readings (``reading, n, used``) that the counts know.

    One confusion for every word, two for rare words that none explains. Readings that even the best context could not
    make likely are left out, and so are words without any, but for those that divided words may be.
    """
    counted = table.filter(F.col("token").startswith("w")).select(F.substring("token", 2, 10_000).alias("word"), F.col("n"))
    own = cut(words.join(counted, "word", "left").select("word", "joins", "long", F.coalesce("n", F.lit(0)).alias("n")))

    def made(source: DataFrame, edits: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = ((w, name(r), list(used), n, bool(long) and not long.replace("-", "").isalpha()) for w, long, n in zip(pdf["word"], pdf["long"], pdf["n"]) for r, used in _possible(long or w, edits))
                yield from frames(rows, ["word", "reading", "used", "own", "mixed"], 2)

        tried = source.select("word", "long", "n").mapInPandas(run, "word string, mixed boolean, own long, reading string, used array<int>")
        met = tried.join(counted.select(F.col("word").alias("reading"), "n"), "reading")
        mixed = F.col("mixed") | ~F.col("word").startswith("\x01") & ~F.col("word").rlike(r"^[\p{L}-]+$")
        odds = (WORD_ODDS * MOVE) ** edits * CONTEXT**2
        return met.filter(mixed | (F.col("n") >= LEAST) & (F.col("n") * odds > F.col("own"))).select("word", "reading", "n", "used")

    once = cut(made(own, 1))
    rest = own.filter((F.col("n") < RARE) & (F.length("word") >= 5)).join(once.select("word").distinct(), "word", "left_anti")
    found = once.unionByName(made(rest, 2)).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("n", "reading", "used")), asc=False).alias("found"))
    both = own.join(found, "word", "left").filter("found is not null or joins and n > 0")
    return both.select("word", "joins", "n", F.coalesce("found", F.array().cast("array<struct<n:bigint,reading:string,used:array<int>>>")).alias("found"))


def _possible(word: str, edits: int) -> Iterator[tuple[str, tuple[int, ...]]]:
    if len(word) < 2 or word.isdigit() or not word.replace("-", "").isalpha() and word.endswith("!"):
        return
    if "-" in word:  # a compound: either side may be misread
        left, right = word.rsplit("-", 1)
        yield from ((f"{x}-{right}", used) for x, used in candidates(left, edits))
        yield from ((f"{left}-{x}", used) for x, used in candidates(right, edits))
    else:
        yield from candidates(word, edits)


def confusion_odds(known: DataFrame) -> list[float]:
    """Odds of each confusion of :data:`PAIRS`, learned: errors over occurrences of what was written, against the mean."""
    first = known.filter("size(found) > 0").select("word", "n", F.col("found")[0].alias("f"))
    # words that their best reading explains at flat odds, by their single confusion
    bad = first.filter(F.col("word").rlike(r"^\p{L}+$") & (F.size("f.used") == 1) & (F.col("f.n") * WORD_ODDS > F.col("n")))
    errors = {r["u"]: r["n"] for r in bad.groupBy(F.col("f.used")[0].alias("u")).agg(F.sum(F.greatest("n", F.lit(1))).alias("n")).collect()}
    written = sorted({w for _, w in PAIRS})
    right = bad.select(F.col("f.reading").alias("word"), F.col("f.n").alias("n")).distinct()
    sums = right.agg(*[F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(w), F.lit("")))) / len(w)).alias(f"w{i}") for i, w in enumerate(written)]).first()
    times = {w: sums[f"w{i}"] or 0 for i, w in enumerate(written)}
    rate = [errors.get(i, 0) / times[w] if times[w] else 0.0 for i, (_, w) in enumerate(PAIRS)]
    seen = [(r, times[w]) for r, (_, w) in zip(rate, PAIRS) if r]
    mean = sum(r * n for r, n in seen) / sum(n for _, n in seen) if seen else 0.0
    return [WORD_ODDS * min(MOVE, max(1 / MOVE, r / mean)) if mean else WORD_ODDS for r in rate]


def _bit_set(keys: DataFrame) -> np.ndarray:
    """Which of :data:`BITS` bits some key has: of a fixed size, so what is collected does not grow."""
    spot = (F.crc32(F.encode("key", "UTF-8")) % BITS).alias("b")
    words = keys.select(spot).groupBy(F.expr("b div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).toPandas()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words["i"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


class _Forms(dict):
    """Of each word that is worth asking for, (itself and its readings by one confusion that may be known, keys to ask for)."""

    def __init__(self, worth: np.ndarray, readable: np.ndarray):
        super().__init__()
        self.worth, self.readable = worth, readable

    def __missing__(self, word: str) -> tuple[list[str], list[str]] | None:
        if len(self) > 100_000:
            self.clear()
        bare = dict.fromkeys((word, word[:-1], word.rstrip("!|")) if word[-1] in "!|" else (word,))
        own = [x for x in bare if len(x) > 1 and self.worth[bit(name(x))]]
        forms = [word, *[c for x in own for c, _ in candidates(x) if self.readable[bit(name(c))]]]
        got = (forms, ["r" + name(x) for x in own]) if own else None
        if len(word) <= LONGEST:
            self[word] = got
        return got


def _asked(r: Running, frequent: dict, forms: _Forms) -> set[str]:
    """Keys of the counts that decoding a node may use and that are not broadcast."""
    out = {"r" + name(w) for w in r.joins()}
    for low in r.low.values():
        some = [forms[w] for w in low]
        if not any(some):
            continue
        for x in some:
            if x:
                out.update(x[1])
        for k in range(len(low) - 1):
            a, b = (x[0] if x else [w] for x, w in zip(some[k : k + 2], low[k : k + 2]))
            if len(a) > 1 or len(b) > 1:
                b = [name(y) for y in b]
                for x in map(name, a):
                    out.add("w" + x)
                    out.update([f"b{x} {y}" for y in b])
                out.update(["w" + y for y in b])
    return {k for k in out if k not in frequent}


def _answer(line: str) -> tuple[str, object]:
    key, n, found = line.split("\t")
    if found == "-":
        return key, int(n)
    forms = [f.split(" ") for f in found.split("|")] if found else []
    return key, (int(n), [(r, int(m), tuple(map(int, used.split(",")))) for r, m, used in forms])


def _labelled(nodes: DataFrame, schema: str, rows_of) -> DataFrame:
    spark = nodes.sparkSession
    table = cut(counts(nodes, "text"))
    pages = scanned(nodes)
    known = cut(readings(vocabulary(pages), table))
    odds = confusion_odds(known)
    is_word, is_pair = F.col("token").startswith("w"), F.col("token").startswith("b")
    of_words = F.length("token") > 2
    total = table.filter(is_word & of_words).agg(F.sum("n")).first()[0] or 1
    # no more than 1 / FREQUENT words and as many pairs; characters and their pairs are bounded by the script
    frequent: dict[str, object] = {r["token"]: r["n"] for r in table.filter((is_word | is_pair) & of_words & (F.col("n") >= total * FREQUENT)).toLocalIterator()}
    for r in known.filter(F.col("n") >= total * FREQUENT).toLocalIterator():
        frequent["r" + r["word"]] = (r["n"], [(f["reading"], f["n"], tuple(f["used"])) for f in r["found"]])
    letters = {r["token"]: r["n"] for r in table.filter((~is_word & ~is_pair | ~of_words) & (F.ascii("token") > 127)).toLocalIterator()}
    some = known.filter("size(found) > 0")
    worth = _bit_set(some.select(F.col("word").alias("key")))
    readable = _bit_set(some.select(F.explode("found.reading").alias("key")))
    shared = spark.sparkContext.broadcast((frequent, letters, odds, total, worth, readable))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, _, _, _, some_word, some_reading = shared.value
        forms = _Forms(some_word, some_reading)
        for pdf in batches:
            rows = ((k, n) for n, t, kinds in zip(pdf["node"], pdf["text"], pdf["kinds"]) for k in _asked(Running(t, kinds), common, forms))
            yield from frames(rows, ["key", "node"])

    none = F.lit(None).cast("array<struct<n:bigint,reading:string,used:array<int>>>")
    answers = table.filter((is_word | is_pair) & of_words).select(F.col("token").alias("key"), "n", none.alias("found"))
    answers = answers.unionByName(known.select(F.concat(F.lit("r"), "word").alias("key"), "n", "found"))
    got = pages.select("node", "text", "kinds").mapInPandas(ask, "node long, key string").join(answers, "key")
    # of one node's words; as text, which reaches Python much faster than nested arrays
    forms = F.transform("found", lambda f: F.concat_ws(" ", f["reading"], f["n"].cast("string"), F.array_join(f["used"].cast("array<string>"), ",")))
    line = F.concat_ws("\t", "key", F.col("n").cast("string"), F.coalesce(F.array_join(forms, "|"), F.lit("-")))
    got = got.groupBy("node").agg(F.array_join(F.collect_list(line), "\n").alias("got"))
    _, _, number, last = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, chars, learned, everything, _, _ = shared.value
        own = Model(common, chars, learned, everything)

        def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
            for d, p, t, kinds, answered in zip(pdf["doc_id"], pdf["pos"], pdf["text"], pdf["kinds"], pdf["got"]):
                own.asked = dict(map(_answer, answered.split("\n"))) if answered else {}
                for k, x in rows_of(t, kinds, own):
                    yield d, x, p, k

        for pdf in batches:
            yield from frames(rows(pdf), ["doc_id", last, "pos", number], 2)

    return pages.join(got, "node", "left").select("doc_id", "pos", "text", "kinds", "got").mapInPandas(run, schema)


def noisy_lines(nodes: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no, noise`` of the noisy lines in the current nodes of scanned documents."""
    return _labelled(nodes, "doc_id string, pos int, line_no int, noise string", lambda t, kinds, model: label(t, kinds, model, repair=False)[0])


def repaired(nodes: DataFrame) -> DataFrame:
    """``doc_id, pos, para_no, text``: the text of the current nodes of scanned documents as whole paragraphs."""
    return _labelled(nodes, "doc_id string, pos int, para_no int, text string", lambda t, kinds, model: enumerate(label(t, kinds, model)[1]))
