"""Repair of texts from scanned pages: broken words, misread characters, running heads and page numbers.

A lexicon of the whole corpus tells which spellings are words.  A text's lines lose running heads and page numbers.
What is left is one stream of characters without line ends, and a lattice over it holds arcs for words as they stand,
words that were split, run together, misread or broken by a hyphen; the best path through it gives the kinds of noise
and the repaired words.  Words that allow no other reading are on every path, so the lattice is only laid out for the stretches
between them.  Paragraph boundaries are then chosen among the line ends by dynamic programming.

The lexicon's common words go to every task, its others only to the documents that ask for them: strings and words that
confusions can turn into one another have a key in common, by which they are joined.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product, zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chunking import latest
from graphloom.session import cut

KINDS = ("hyphenation", "misread", "page_furniture")
LEAST = 3  # documents that hold a word of the lexicon
#: A word is common, and sent to every task, if it is in one of so many documents: there can't be more common
#: words than this number times the mean of different words in a document, however large the corpus is.
ONE_OF = 2_000
RATIO = 20  # a word is taken for a misreading of one that is so many times as frequent
FLUSH = 200_000  # words that a task counts before it hands them on
PIECES = 3  # further pieces that a split word may have
UNKNOWN = 20.0  # cost of a token that is no word
SMALL = 10_000  # documents with words of their own that are broadcast at most

# ---- Fixed values: confusions of characters, as read -> as printed ----
SIGNS = {"0": "o", "1": "li", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "8": "b", "9": "g", "@": "a", "$": "s", "|": "li", "!": "li", "€": "e"}
LETTERS = {
    "rn": ["m"], "m": ["rn"], "cl": ["d"], "d": ["cl"], "li": ["h"], "h": ["li", "b"], "ii": ["u"], "u": ["ii"], "ri": ["n"], "n": ["ri"], "vv": ["w"], "w": ["vv"], "nn": ["m"], "lc": ["k"],
    "c": ["e"], "e": ["c"], "f": ["t"], "t": ["f"], "l": ["i"], "i": ["l", "j"], "v": ["y"], "y": ["v"], "b": ["h"],
}
PAGE_WORDS = r"page|pages|seite|página|pagina|pág|pag|p|s|blatt|feuille|folio|hoja|sheet"
JOINING = {"and", "or", "to", "nor", "und", "oder", "bis", "sowie", "et", "ou", "y", "o", "e", "u", "ni"}  # after a hyphen that stands for a later word's end
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
# ---- End of fixed values ----

HYPHENS = "-‐¬­"
EDGES = ".,;:!?\"'()[]{}|/*“”„«»’…–—<>#=_+~"
BREAK = re.compile(rf"[{HYPHENS}][ \t]*[\r\n\x0b\x0c]\s*")
LINES = re.compile(r"\r\n|[\n\r\x0b\x0c]")
NUMBER = re.compile(rf"(?i)^(?:(?P<word>(?:{PAGE_WORDS})\.?) ?(?P<a>\d{{1,5}})(?: ?(?:of|/|von|de|sur) ?\d+)?|(?P<left>[-–—\[(*]? ?)(?P<b>\d{{1,5}})(?P<right> ?[-–—\])*]?)|(?P<c>\d{{1,5}}) ?(?:[|·•/]|\s{{2,}}) ?(?P<head>\S.{{0,80}})|(?P<e>[ivxlc]{{1,8}})|(?P<head2>\S.{{0,80}}?) ?(?:[|·•/] ?|\s{{2,}})(?P<d>\d{{1,5}}))$")
FIGURE = re.compile(r"\d")
HEX = re.compile(r"\d.*\d.*\d|[A-Z].*\d|\d.*[A-Z].*[A-Z]")
SOFT = {"¬", "­"}


def words_of(text: str) -> set[str]:
    """Different words of a text, lower-cased; words broken at line ends are left out."""
    text = BREAK.sub("\x00", text.lower())
    return {w for w in (t.strip(EDGES) for t in set(text.split())) if w and len(w) <= 40 and "\x00" not in w}


def lexicon(docs: DataFrame) -> DataFrame:
    """word and n, the number of documents that hold it, for words of at least LEAST documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(words_of(text))
            if len(counts) > FLUSH:
                yield handed()
        if counts:
            yield handed()

    words = docs.select("content").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= LEAST)


_ALIKE = str.maketrans({"0": "o", "1": "i", "2": "z", "3": "c", "4": "a", "5": "s", "8": "ii", "9": "g", "@": "a", "$": "s", "|": "i", "!": "i", "€": "c", "j": "i", "l": "i", "y": "v", "f": "t", "e": "c", "w": "vv", "k": "ic", "d": "ci", "h": "ii", "b": "ii", "u": "ii", "m": "rri", "n": "ri"})


def alike(s: str) -> list[str]:
    """Keys of a string: whatever confusions of the tables make of it has one of them in common."""
    parts = s.translate(_ALIKE).split("6")  # read for b or g; in more than two places it isn't read
    signs = [()] if len(parts) > Decoder.LIMIT + 1 else product(("ii", "g"), repeat=len(parts) - 1)
    return sorted({re.sub("(?:r+i)+", "n", "".join(x + y for x, y in zip_longest(parts, some or ["6"] * (len(parts) - 1), fillvalue=""))) for some in signs})


class Decoder:
    """Readings of characters as words of the lexicon: the common words, and those of the text at hand."""

    LIMIT = 2  # confusions in a word

    def __init__(self, words: dict[str, int], top: int = 0):
        self.common = words
        self.top = top = top or max(words.values(), default=1)  # documents of the lexicon's most common word
        self.often = min(words.values(), default=LEAST)  # only common words may have been split or run together
        self.starts = self.beginnings(words)
        self.rules: dict[str, list[tuple[str, str, float]]] = {}
        for table, cost in ((SIGNS, 1.0), (LETTERS, 1.6)):
            for read, printed in table.items():
                for p in printed:
                    self.rules.setdefault(read[0], []).append((read, p, cost))
        self.known: dict[str, str | None] = {}
        self.sure: set[str] = set()
        self.turn({})

    def beginnings(self, words: dict[str, int]) -> dict[str, float]:
        """Beginnings of words, with the weight of those that are words themselves and 0 for the others."""
        out: dict[str, float] = {}
        for w in words:
            if _readable(w):
                for i in range(1, len(w)):
                    out.setdefault(w[:i], 0.0)
                out[w] = self.weight(words[w])
        return out

    def turn(self, own: dict[str, int]) -> None:
        """Go on to a text that has words of its own.

        They follow from the text's strings, so that what is known of a string holds in all texts.
        """
        self.own = own
        self.more = self.beginnings(own)

    def n(self, word: str) -> int:
        return self.common.get(word) or self.own.get(word, 0)

    def weight(self, n: int) -> float:
        return 1 + math.log(1 + self.top / n) / 2 if n else UNKNOWN

    def readings(self, s: str, start: int, stop: int) -> list[tuple[int, float, int, int, str]]:
        """Words that the characters from ``start`` on can be: end, cost, confusions, spaces in it, word.

        \\x01 is a line end with a hyphen, \\x02 white space and \\x03 an end for all words.
        """
        out, todo = [], [(start, 0.0, 0, 0, "")]
        starts, more, rules = self.starts, self.more, self.rules
        while todo:
            i, cost, wrong, gaps, word = todo.pop()
            if i >= stop:
                continue
            c = s[i]
            if c < "\x04":
                if c == "\x01":
                    todo.append((i + 1, cost + 0.2, wrong, gaps, word))
                elif c == "\x02" and word:
                    todo.append((i + 1, cost + 2.5, wrong, gaps + 1, word))
                continue
            after = word + c
            weight = starts.get(after)
            if more and not weight:
                weight = more.get(after, weight)
            if weight is not None:
                todo.append((i + 1, cost, wrong, gaps, after))
                if weight:
                    out.append((i + 1, cost + weight, wrong, gaps, after))
            if wrong < self.LIMIT and c in rules:
                for read, printed, dear in rules[c]:
                    if len(read) > 1 and not s.startswith(read, i):
                        continue
                    after = word + printed
                    weight = starts.get(after)
                    if more and not weight:
                        weight = more.get(after, weight)
                    if weight is not None:
                        to = i + len(read)
                        todo.append((to, cost + dear, wrong + 1, gaps, after))
                        if weight and to <= stop:
                            out.append((to, cost + dear + weight, wrong + 1, gaps, after))
        return out

    def decode(self, s: str) -> tuple[float, int, list[str]] | None:
        """Cost, confusions and words of the best way through characters without rules for its words, or None."""
        best: list[tuple[float, int, list[str]] | None] = [None] * (len(s) + 1)
        best[0] = (0.0, 0, [])
        for i in range(len(s)):
            if best[i] is None:
                continue
            cost, wrong, words = best[i]
            if s[i] in "\x01\x02" and i:
                if best[i + 1] is None or cost < best[i + 1][0]:
                    best[i + 1] = (cost, wrong, words)
            apart = i > 0 and s[i - 1] != "\x02"
            for end, more, bad, _, word in self.readings(s, i, len(s)):
                if apart and (len(word) < 3 or len(words[-1]) < 3):
                    continue
                whole = cost + more + (5.0 if apart else 0.0)  # a space that was lost
                if best[end] is None or whole < best[end][0]:
                    best[end] = (whole, wrong + bad, [*words, word])
        return best[len(s)]

    def settled(self, token: str) -> bool:
        """Whether a token (without edges) stands for itself wherever it is."""
        low = token.lower()
        n = self.n(low)
        if n * RATIO > self.top or self.misread(token) is None and (n >= LEAST or not spelled(token)):
            if len(self.sure) > 300_000:
                self.sure.clear()
            self.sure.add(token)
            return True
        return False

    def misread(self, token: str) -> str | None:
        """The word that a token (without edges) was misread from, or None where it stands as it is."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 300_000:
            self.known.clear()
        found = self.known[token] = self._misread(token)
        return found

    def _misread(self, token: str) -> str | None:
        low = token.lower()
        letters = sum(c.isalpha() for c in low)
        if not 2 <= letters or len(low) > 40 or len(low) < 3:
            return None
        signs = [c for c in low if not c.isalpha()]
        own = self.n(low)
        if own * RATIO > self.top:
            return None
        if signs:
            if any(c not in SIGNS and c not in "-’'" for c in signs) or sum(c.isdigit() for c in low) > max(1, letters // 3):
                return None
            # codes: a capital with figures, or parts of figures only
            if any(not any(c.isalpha() for c in part) for part in low.split("-")) or (HEX.search(token) and letters < 4):
                return None
        got = self.decode(low)
        if got is None or got[1] == 0 or len(got[2]) != 1:
            return None
        word = got[2][0]
        n = self.n(word)
        strong = any(c in SIGNS for c in signs)
        if len(word) < 3 or n < (LEAST if strong else RATIO * max(1, own)) or strong and n < 2 * own:
            return None
        if len(word) == 3 and n < self.top / 20 or len(word) == 4 and not strong and n < 2 * RATIO * max(1, own):
            return None
        return word


def spelled(token: str) -> bool:
    """Whether a token (without edges) can be words: letters, and at most one sign in six characters that is read for one."""
    return token.isalpha() or len(token) >= 6 and 6 * sum(c in SIGNS for c in token) <= len(token) and all(c.isalpha() or c in SIGNS for c in token)


def _readable(word: str) -> bool:
    return len(word) >= 2 and any(c.isalpha() for c in word) and not any(c in SIGNS for c in word)


_SAME = str.maketrans("015@2689eltfy!|", "oisazbbgciiivii")
_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("ri", "n"))


class _Folded(dict):
    """Letters with those made equal that are often confused; all else is left out."""

    def __missing__(self, code: int) -> int | None:
        c = _SAME.get(code, code)
        self[code] = c if 97 <= c <= 122 or 0xE0 <= c <= 0xFF else None
        return self[code]


_FOLDED = _Folded()
ALONE = re.compile(r"\b\d+\b")


def fold(line: str) -> str:
    """A line's letters with those made equal that are often confused; figures that stand alone are left out."""
    low = line.lower()
    if FIGURE.search(low):
        low = ALONE.sub("", low)
    for read, printed in _PAIRS:
        low = low.replace(read, printed)
    return low.translate(_FOLDED)


def roman(figures: str) -> int:
    values = [ROMAN[c] for c in figures]
    return sum(-v if any(v < w for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def ends_open(line: str) -> bool:
    """Whether a line ends inside a sentence."""
    return bool(line) and line[-1] not in ".!?:;…\"”»)|"


def furniture(lines: list[str]) -> set[int]:
    """Positions of running heads and page numbers among the lines.

    Page numbers are lines of one shape whose numbers go up by one with text between them; a single one must be of
    an explicit shape and at an edge, or inside a sentence.  Running heads repeat beside page numbers, or
    repeat and cut a sentence in two.  Repeated labels between finished sentences stay.
    """
    text = [i for i, x in enumerate(lines) if x]
    place = {i: k for k, i in enumerate(text)}
    shapes: dict[tuple, list[tuple[int, int]]] = {}
    for i in text:
        if len(lines[i]) <= 100 and (FIGURE.search(lines[i]) or len(lines[i]) <= 8) and (m := NUMBER.match(lines[i])):
            g = m.groupdict()
            n = next((int(g[x]) for x in "abcd" if g[x]), 0) or roman(g["e"].lower())
            head = g["head"] or g["head2"] or ""
            if head and (head.count("|") or not re.search(r"[^\W\d_]{2}", head) or "\t" in lines[i]):
                continue
            shape = (g["word"] or "").lower(), (g["left"] or "").strip() + (g["right"] or "").strip(), bool(g["c"]), bool(g["d"]) + 2 * bool(g["e"]), fold(head)[:12]
            shapes.setdefault(shape, []).append((i, n))
    gone: set[int] = set()

    def inside(i: int) -> bool:
        k = place[i]
        around = [lines[j] for j in text[max(0, k - 2) : k] if j not in gone][-1:], [lines[j] for j in text[k + 1 : k + 3] if j not in gone][:1]
        return bool(around[0] and around[1]) and ends_open(around[0][0]) and around[1][0][:1].islower()

    # A head is a short line that is no row of a table and no item.
    folded = {i: fold(lines[i]) for i in text if 3 <= len(lines[i]) <= 100 and "\t" not in lines[i] and not (": " in lines[i] and " | " in lines[i])}
    heads = Counter(folded.values())
    for shape, found in shapes.items():
        explicit = bool(shape[0] or shape[1] or shape[4])
        runs, run = [], [found[0]]
        for a, b in zip(found, found[1:]):
            if b[1] == a[1] + 1 and place[b[0]] - place[a[0]] >= 3:
                run.append(b)
            else:
                runs.append(run)
                run = [b]
        runs.append(run)
        for run in runs:
            if len(run) >= 2:
                gone |= {i for i, _ in run}
            elif explicit or heads:
                i = run[0][0]
                beside = [fold(lines[j]) for j in text[max(0, place[i] - 1) : place[i] + 2] if j != i]
                edge = place[i] in (0, len(text) - 1) and len(text) > 3
                if explicit and (edge and (shape[0] or shape[1] or heads[shape[4]]) or inside(i)) or any(len(h) >= 4 and heads[h] >= 2 for h in beside) and (explicit or inside(i)):
                    gone.add(i)
    numbers = set(gone)
    beside: Counter[str] = Counter()
    for i in {text[j] for k in map(place.get, numbers) for j in (k - 1, k + 1) if 0 <= j < len(text)} - numbers:
        beside[folded.get(i, "")] += 1
    known = {fold(NUMBER.match(lines[i]).groupdict()["head"] or NUMBER.match(lines[i]).groupdict()["head2"] or "") for i in numbers} - {""}
    repeated = {h for h, n in heads.items() if n >= 2 and len(h) >= 4}
    if not known and not repeated:
        return gone
    cutting = Counter(h for i, h in folded.items() if i not in numbers and h in repeated and inside(i))
    for i, h in folded.items():
        if i in gone:
            continue
        if h in known and heads[h] >= 1 and len(h) >= 4 or h in repeated and (beside[h] >= 2 or cutting[h]):
            gone.add(i)
    return gone


def paragraphs(lines: list[str], blank_before: list[bool]) -> list[str]:
    """Lines joined to paragraphs.  Each line end is kept or joined at the least total cost, given what the line before did."""
    if not lines:
        return []
    width = sorted(len(x) for x in lines)[int(len(lines) * 0.9)]
    cost, back = [0.0, 0.0], []
    for i in range(1, len(lines)):
        last, line = lines[i - 1], lines[i]
        open_, low = ends_open(last), line[:1].islower()
        short = len(last) < 0.75 * width
        listed = bool(re.match(r"(?:[-*•–]|\d{1,3}[.)])\s|[^|]*\|", line))
        apart = (0.0 if blank_before[i] else 2.0) + (3.0 if open_ and low else 0.0) + (0.0 if not open_ or short else 1.0)
        join = (2.5 if blank_before[i] else 0.0) + (1.5 if not open_ and short else 0.0) + (2.5 if listed else 0.0) + (1.0 if short and not low else 0.0)
        step, choice = [], []
        for kept in (0, 1):  # whether a paragraph begins here
            own = apart if kept else join
            options = [cost[0] + own, cost[1] + own + (0.5 if kept and len(last) > 40 and open_ else 0.0)]
            choice.append(int(options[1] < options[0]))
            step.append(min(options))
        cost = step
        back.append(choice)
    state, begins = int(cost[1] < cost[0]), []
    for i in range(len(lines) - 1, 0, -1):
        if state:
            begins.append(i)
        state = back[i - 1][state]
    out, edges = [], [0, *reversed(begins), len(lines)]
    for a, b in zip(edges, edges[1:]):
        out.append(" ".join(lines[a:b]))
    return out


def restored(token: str, word: str) -> str:
    """A decoded word in the case and with the edges of its token."""
    core = token.strip(EDGES)
    at = token.find(core)
    cased = word.upper() if core.isupper() and len(core) > 1 else word.capitalize() if core[:1].isupper() or not core[:1].isalpha() and core[1:2].isupper() else word
    return token[:at] + cased + token[at + len(core) :]


class Arc(NamedTuple):
    """A way on in the lattice: up to which position, its cost, the tokens that come out, and the kinds of noise that it shows."""

    end: int
    cost: float
    tokens: list[str]
    kinds: tuple[str, ...] = ()


class Lattice:
    """The stream of a text's tokens.  ``lines`` are lists of tokens; the last of a line may end in a hyphen."""

    def __init__(self, lines: list[list[str]], decoder: Decoder):
        self.d = decoder
        self.tokens = [t for line in lines for t in line]
        self.line = [i for i, line in enumerate(lines) for _ in line]
        self.core = [t.strip(EDGES) for t in self.tokens]
        last = len(self.tokens) - 1
        ends = {k for k in range(last) if self.line[k + 1] != self.line[k]}
        self.broken = {k for k in ends if self.breaks(k)}

    def breaks(self, k: int) -> bool:
        """Whether a token ends its line with a hyphen and goes on in the next."""
        t = self.tokens[k]
        if t[-1] not in HYPHENS or len(t) < 2 or not t[-2].isalpha():
            return False
        a, b = self.halves(k)
        return bool(a and b and (b[0].isalpha() or b[0] in SIGNS))

    def halves(self, k: int) -> tuple[str, str]:
        return self.tokens[k][:-1].lstrip(EDGES).lower(), self.tokens[k + 1].rstrip(EDGES).lower().split("/")[0]

    def doubtful(self, k: int, core: str) -> bool:
        """Whether a token that isn't settled has other readings than itself here."""
        if core.islower() or self.d.misread(core) is not None:
            return True
        # Capitalised unknown tokens are names, but for the first part of a word.
        return k + 1 < len(self.core) and self.open(k) and self.core[k + 1].islower() and self.d.n(core.lower() + self.core[k + 1]) >= self.d.often

    def open(self, k: int) -> bool:
        """Whether no sign stands between a token and the next."""
        return self.tokens[k].endswith(self.core[k]) and self.tokens[k + 1].startswith(self.core[k + 1])

    def stretches(self) -> Iterator[tuple[int, int]]:
        """Tokens with more than one reading, with their neighbours: from, to."""
        held: list[int] | None = None
        loose = {c for c in set(self.core) - self.d.sure if not self.d.settled(c)}
        for k, core in enumerate(self.core):
            if k in self.broken or core in loose and self.doubtful(k, core):
                low, high = max(0, k - 1), min(len(self.tokens), k + 2)
                if held and low < held[1]:
                    held[1] = high
                else:
                    if held:
                        yield held[0], held[1]
                    held = [low, high]
        if held:
            yield held[0], held[1]

    def best_path(self, low: int, high: int) -> list[tuple[int, int, Arc]]:
        """Arcs of the best way from token ``low`` to ``high``, each with its first token and the one after its last."""
        d = self.d
        s, start, end = "", [], []
        for k in range(low, high):
            broken = k in self.broken and k + 1 < high
            core = self.core[k].lower()
            start.append(len(s))
            s += self.halves(k)[0] if broken else core
            end.append(len(s))
            if k + 1 < high:
                s += "\x01" if broken else "\x02" if self.open(k) else "\x03"
        place = {p: k for k, p in enumerate(start)}
        token_at = {p: k for k, p in enumerate(end)}
        best: dict[int, tuple[float, int, Arc | None]] = {0: (0.0, -1, None)}
        for i in range(len(s) + 1):
            if i not in best:
                continue
            cost = best[i][0]
            if i in token_at and i < len(s):
                ways = [Arc(i + 1, 0.0, [])]
            elif i in place:
                ways = self.arcs(s, low, place[i], start, end, token_at)
            elif i < len(s):
                ways = self.parts(s, i, end, cost)
            else:
                break
            for arc in ways:
                if arc.end not in best or cost + arc.cost < best[arc.end][0]:
                    best[arc.end] = (cost + arc.cost, i, arc)
        path, i = [], len(s)
        while i > 0:
            _, before, arc = best[i]
            path.append((before, i, arc))
            i = before
        out: list[tuple[int, int, Arc]] = []
        for a, b, arc in reversed(path):
            if not arc.tokens:
                continue
            first = max(k for k, p in enumerate(start) if p <= a)
            last = min(k for k, p in enumerate(end) if p >= b)
            if out and out[-1][1] == low + first + 1:  # further words of one token
                f, t, whole = out.pop()
                arc = Arc(arc.end, 0.0, [*whole.tokens, *arc.tokens], (*whole.kinds, *arc.kinds))
                out.append((f, t, arc))
            else:
                out.append((low + first, low + last + 1, arc))
        return out

    def arcs(self, s: str, low: int, at: int, start: list[int], end: list[int], token_at: dict[int, int]) -> list[Arc]:
        """Ways on from the beginning of a token."""
        d, k = self.d, low + at
        if k in self.broken and at + 1 < len(start):
            return self.hyphen_arcs(s, k, start[at], end[at], end[at + 1])
        token, core = self.tokens[k], self.core[k]
        lower = core.lower()
        n = d.n(lower)
        out = [Arc(end[at], d.weight(n), [token])]
        word = d.misread(core)
        if word is not None:
            out.append(Arc(end[at], d.weight(d.n(word)) + 0.5, [restored(token, word)], ("misread",)))
        if not spelled(core):
            return out
        last, strange = at, n < LEAST  # tokens that a split word may go on with, as many as PIECES
        while last + 1 < len(start) and last < at + PIECES and s[end[last]] == "\x02" and low + last + 1 not in self.broken and self.core[low + last + 1].islower() and self.core[low + last + 1].isalpha():
            last += 1
            strange = strange or d.n(self.core[low + last]) < LEAST
        if last > at and strange:
            for to, cost, wrong, gaps, word in d.readings(s, start[at], end[last]):
                if not gaps or to not in token_at or d.n(word) < d.often or wrong and (wrong > 1 or len(word) < 7 or d.n(word) < RATIO * LEAST):
                    continue
                rest = range(k + 1, low + token_at[to] + 1)
                if all(d.n(self.core[j].lower()) >= LEAST for j in (k, *rest)):
                    continue
                whole = "".join(self.core[j] for j in (k, *rest))
                text = self.tokens[k][: self.tokens[k].find(core)] + whole + self.tokens[rest[-1]][len(self.core[rest[-1]]) :]
                out.append(Arc(to, cost, [restored(text, word) if wrong else text], ("misread",) if wrong else ()))
        return out + (self.parts(s, start[at], end, 0.0) if n < LEAST and len(core) >= 6 and core.islower() else [])

    def parts(self, s: str, i: int, end: list[int], cost: float) -> list[Arc]:
        """Words that a token without a space holds, from a position in it on."""
        stop = min(e for e in end if e > i)
        begin = next(p for p in range(i, -1, -1) if p == 0 or s[p - 1] < "\x04")
        out = []
        for to, more, wrong, _, word in self.d.readings(s, i, stop):
            n = self.d.n(word)
            if len(word) < 3 or n < self.d.often or len(word) == 3 and n * RATIO < self.d.top or i == begin and to == stop or wrong and (wrong > 1 or len(word) < 7 or n < RATIO * LEAST):
                continue
            out.append(Arc(to, more + (5.0 if i > begin else 0.0), [word], ("misread",) if wrong else ()))
        return out

    def hyphen_arcs(self, s: str, k: int, start: int, mid: int, stop: int) -> list[Arc]:
        """Ways on over a line end with a hyphen: the halves of one word, a word with its own hyphen, or two words."""
        d = self.d
        a, b = self.halves(k)
        left, right = self.tokens[k], self.tokens[k + 1]
        whole, tied = d.n(a + b), d.n(f"{a}-{b}")
        soft = left[-1] in SOFT

        def joined(cost: float) -> Arc:
            token = left[:-1] + right
            word = d.misread(token.strip(EDGES))
            return Arc(stop, cost, [restored(token, word)] if word is not None else [token], ("hyphenation", "misread") if word is not None else ("hyphenation",))

        def kept(cost: float) -> Arc:
            token = left[:-1] + "-" + right
            word = d.misread(token.strip(EDGES))
            return Arc(stop, cost, [restored(token, word)] if word is not None else [token], ("misread",) if word is not None else ())

        if soft:
            return [joined(d.weight(whole))]
        out = []
        if whole:
            out.append(joined(d.weight(whole)))
        if tied:
            out.append(kept(d.weight(tied) - 1e-9))
        if not out and b in JOINING:
            out.append(kept(0.0))
        if not out:
            # Neither is known: two words of their own keep their hyphen, unless they read as one word.
            known = d.n(a.split("-")[-1]) and d.n(b)
            got = d.decode(a + "\x01" + b) if len(a) + len(b) <= 40 else None
            one = got is not None and len(got[2]) == 1
            figures = any(c.isdigit() for c in a + b) and got is None
            out.append(joined(got[0]) if one else kept(UNKNOWN) if known or figures else joined(UNKNOWN))
        return out


def body(text: str) -> tuple[list[list[str]], list[bool], set[int]]:
    """Tokens of the lines that stay, whether a blank line is before each, and the positions of running heads and page numbers."""
    raw = [x.strip() for x in LINES.split(text)]
    gone = furniture(raw) if len(raw) > 2 else set()
    kept, blank, gap = [], [], False
    for i, x in enumerate(raw):
        if i in gone:
            continue
        if not x:
            gap = True
            continue
        near = range(max(0, i - 3), i)
        blank.append(gap and not any(j in gone for j in near))
        kept.append(x.split())
        gap = False
    return kept, blank, gone


def read_page(text: str, decoder: Decoder) -> tuple[list[str], str]:
    """Kinds of noise in a text, and the text repaired.

    A text without noise keeps its lines; words in it that were split or run together are mended in their place.
    """
    kept, blank, gone = body(text)
    lattice = Lattice(kept, decoder)
    edits = [(a, b, arc) for low, high in lattice.stretches() for a, b, arc in lattice.best_path(low, high) if arc.tokens != lattice.tokens[a:b]]
    seen = {kind for *_, arc in edits for kind in arc.kinds} | ({"page_furniture"} if gone else set())
    kinds = [k for k in ("hyphenation", "page_furniture", "misread") if k in seen]
    if not kinds:
        return [], mended(text, lattice, edits) if edits else text
    out: list[list[str]] = [[] for _ in kept]
    at = 0
    for a, b, arc in [*edits, (len(lattice.tokens), 0, Arc(0, 0.0, []))]:
        for k in range(at, a):
            out[lattice.line[k]].append(lattice.tokens[k])
        if arc.tokens:
            out[lattice.line[a]] += arc.tokens
        at = b
    pairs = [(" ".join(x), b) for x, b in zip(out, blank) if x]
    return kinds, "\n\n".join(paragraphs([x for x, _ in pairs], [b for _, b in pairs]))


def mended(text: str, lattice: Lattice, edits: list[tuple[int, int, Arc]]) -> str:
    """A text with words put together or apart where they stand; white space elsewhere stays."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) != len(lattice.tokens):
        return text
    out, at = [], 0
    for a, b, arc in edits:
        if not lattice.broken.isdisjoint(range(a, b)):
            continue
        out += [text[at : spans[a][0]], " ".join(arc.tokens)]
        at = spans[b - 1][1]
    return "".join(out) + text[at:]


def asked(text: str, decoder: Decoder) -> set[str]:
    """Strings of a text that aren't common words and whose standing in the lexicon matters."""
    some = {t.strip(EDGES).lower() for t in set(text.split())}
    if BREAK.search(text):
        lattice = Lattice(body(text)[0], decoder)
        for k in lattice.broken:
            a, b = lattice.halves(k)
            some |= {a + b, f"{a}-{b}", a.split("-")[-1], b}
    return {x for x in some.difference(decoder.common) if 3 <= len(x) <= 40 and sum(map(str.isalpha, x)) >= 2 and sum(map(str.isdigit, x)) <= max(1, len(x) // 3)}


def own_words(once: DataFrame, rare: DataFrame, words: Broadcast) -> DataFrame:
    """doc_id and own: the rare words (word, n) of the lexicon that strings of a document are, or can be confused with."""
    kind = once.schema["doc_id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.__new__(Decoder)
        decoder.common = words.value
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = {k for x in asked(text, decoder) for k in alike(x)} if text else ()
                at += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], names=["doc_id", "key"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [alike(w)[0] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=["word", "n", "key"])

    strings = once.mapInArrow(ask, f"doc_id {kind}, key string")
    held = rare.mapInArrow(keyed, "word string, n long, key string")
    return strings.join(held, "key").groupBy("doc_id").agg(F.collect_set(F.struct("word", "n")).alias("own"))  # no more than a text's strings call for


def repair(docs: DataFrame) -> DataFrame:
    """doc_id, noise (kinds in the text) and repaired text, one row for each document.

    ``docs`` has doc_id, content and ingested_at; other columns are ignored.  A document taken in again counts once,
    by its latest row.  Null, empty and blank contents have no noise and stay, as all contents without noise do
    but for words in them that were split or run together.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    once = cut(latest(docs.select("doc_id", "content", "ingested_at").filter(F.col("doc_id").isNotNull()), "doc_id", "ingested_at", ["content"]).select("doc_id", "content"))
    known = cut(lexicon(once))
    bar = max(LEAST, -(-once.count() // ONE_OF))
    words = once.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in known.filter(F.col("n") >= bar).toLocalIterator()})
    rare, top = known.filter(F.col("n") < bar), known.agg(F.max("n")).first()[0] or 1
    texts = once.withColumn("own", F.lit(None).cast("array<struct<word:string,n:bigint>>"))
    if bar > LEAST:
        own = cut(own_words(once, rare, words))
        texts = once.join(F.broadcast(own) if own.count() <= SMALL else own, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(words.value, top)
        for batch in batches:
            kinds, fixed = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                decoder.turn({x["word"]: x["n"] for x in own or ()})
                k, t = read_page(text, decoder) if text else ([], text)
                kinds.append(k)
                fixed.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(fixed, pa.string())], names=["doc_id", "noise", "repaired"])

    return texts.mapInArrow(run, f"doc_id {kind}, noise array<string>, repaired string")
