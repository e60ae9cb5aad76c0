"""Repair of text from scanned pages, by averaged perceptrons over characters, line joins and lines."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.ids import known
from strataframe.functions.latest import checkpointed, latest
from strataframe.llm.transcripts import counted_up

KIND = "pdf_ocr_page_block"
#: Most frequent words the lexicon holds (others are looked up by a join), words and pages the perceptrons are trained on, rounds of training.
LEXICON, TRAIN_WORDS, TRAIN_PAGES, ROUNDS = 50_000, 2_000, 4_000, 4
#: Times a correction must be more frequent than the word as read; occurrences elsewhere that show a word is one.
RATIO, SURE = 15, 2
#: Lines at each end of a page that may be furniture, and pages on which a repeated one must be.
EDGE, REPEATED = 3, 2
HYPHENS = "-¬‐‑­"
# What is printed and what a scanner commonly reads for it.
CONFUSIONS = [
    ("a", "o"), ("b", "6"), ("b", "h"), ("c", "("), ("c", "e"), ("cl", "d"), ("d", "cl"), ("e", "c"), ("f", "t"), ("g", "9"), ("g", "q"), ("h", "b"), ("h", "li"), ("i", "l"), ("i", "1"), ("i", "j"), ("in", "m"),
    ("l", "1"), ("l", "i"), ("li", "h"), ("m", "rn"), ("n", "ri"), ("n", "u"), ("o", "0"), ("q", "g"), ("r", "i'"), ("rn", "m"), ("s", "5"), ("t", "7"), ("t", "f"), ("u", "ii"), ("u", "n"), ("v", "y"), ("w", "vv"), ("y", "v"), ("z", "2"),
]
_NUMBER = re.compile(r"^[\W_]*(?:(?:page|pg|p|seite|s|folio)\b\.?)?[\s.\-–—\[(]*([0-9lIoO|]{1,5})(?:\s*(?:/|of|von)\s*[0-9lIoO|]{1,5})?[\s.\-–—\])]*$", re.I)
_ROMAN = re.compile(r"^[\W_]*(?:(?:page|pg|p)\b\.?)?[\s.\-–—\[(]*(?=[ivxlc1])(?:x[cl1]|[l1]?x{0,3})(?:[i1][xv]|v?[i1l]{0,3})[\s.\-–—\])]*$", re.I)
_TRIM = ".,;:!?\"“”„»«"


class Perceptron:
    """Averaged multi-class perceptron over string features."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._n = 0

    def scores(self, features: list[str], classes: Iterable[str]) -> dict[str, float]:
        out = dict.fromkeys(classes, 0.0)
        for f in features:
            for c, v in self.w.get(f, {}).items():
                if c in out:
                    out[c] += v
        return out

    def learn(self, features: list[str], classes: Iterable[str], truth: str) -> None:
        self._n += 1
        s = self.scores(features, classes)
        guess = max(s, key=lambda c: (s[c], c == "keep"))
        if guess != truth:
            for f in features:
                for c, by in ((truth, 1.0), (guess, -1.0)):
                    row = self.w.setdefault(f, {})
                    key = (f, c)
                    self._sum[key] += (self._n - self._at[key]) * row.get(c, 0.0)
                    self._at[key] = self._n
                    row[c] = row.get(c, 0.0) + by

    def average(self) -> Perceptron:
        for f, row in self.w.items():
            for c in list(row):
                total = self._sum[(f, c)] + (self._n - self._at[(f, c)]) * row[c]
                row[c] = round(total / max(1, self._n), 4)
            self.w[f] = {c: v for c, v in row.items() if v}
        self._sum, self._at = defaultdict(float), defaultdict(int)
        return self


def _operations() -> dict[str, set[str]]:
    """Operations by the character they act on: keep, delete, replace:x, insert:x (replace, then insert)."""
    out: dict[str, set[str]] = defaultdict(lambda: {"keep"})
    for printed, read in CONFUSIONS:
        for c, op in _labels(printed, read):
            out[c].add(op)
    return dict(out)


def _labels(printed: str, read: str) -> list[tuple[str, str]]:
    if len(printed) > len(read):  # two letters read as one
        return [(read[0], f"insert:{printed}")]
    return [(read[0], f"replace:{printed}" if read[0] != printed else "keep")] + [(c, "delete") for c in read[1:]]


OPERATIONS = _operations()


def _features(word: str, i: int) -> list[str]:
    w = "^^^" + word + "$$$"
    k = i + 3
    return [
        "0" + w[k], "l" + w[k - 1 : k + 1], "r" + w[k : k + 2], "m" + w[k - 1 : k + 2], "L" + w[k - 2 : k + 1], "R" + w[k : k + 3], "x" + w[k - 2 : k + 2], "y" + w[k - 1 : k + 3],
        "5" + w[k - 2 : k + 3], "7" + w[k - 3 : k + 4], "a" + w[k - 3 : k] + w[k], "b" + w[k] + w[k + 1 : k + 4], "n" + w[k - 1] + w[k + 1], "N" + w[k - 2 : k] + "_" + w[k + 1 : k + 3],
    ]


def train_editor(words: list[tuple[str, int]], seed: int = 7) -> Perceptron:
    """Character editor trained on frequent words with one or two confusions put in, and on the words as they are."""
    rng, model, samples = random.Random(seed), Perceptron(), []
    for word, _ in words[:TRAIN_WORDS]:
        samples += [(word, ["keep"] * len(word))] * 2
        places = [(i, p, r) for p, r in CONFUSIONS for i in range(len(word) - len(p) + 1) if word.startswith(p, i)]
        for i, p, r in places:
            ops = ["keep"] * i + [op for _, op in _labels(p, r)] + ["keep"] * (len(word) - i - len(p))
            samples.append((word[:i] + r + word[i + len(p) :], ops))
    for _ in range(ROUNDS):
        rng.shuffle(samples)
        for seen, ops in samples:
            for i, op in enumerate(ops):
                allowed = OPERATIONS.get(seen[i])
                if allowed and len(allowed) > 1 and op in allowed:
                    model.learn(_features(seen, i), allowed, op)
    return model.average()


def _size(n: int) -> int:
    """Order of magnitude of a count, up to 8."""
    return min(8, int(n).bit_length())


def join_features(r: Repairer, left: str, right: str | None, count: Callable[[str], int]) -> list[str]:
    """What a line end with a hyphen looks like: how often both spellings occur, what they may misread, and the letters at the break."""
    if not right:
        return [f"open{r.begins(left + '-')}", "open", "alone"]
    whole, joined = f"{left}-{right}", left + right
    h, j = count(whole), count(joined)
    fix_h = not h and not j and (r.correction(whole) or "").count("-") == 1
    fix_j = not j and not fix_h and r.correction(joined) is not None
    more = "=" if h == j else "h" if h > j else "j"
    known = [f"H{_size(h)}", f"J{_size(j)}", f"H{h > 0}", f"J{j > 0}", f"more{more}", f"fixH{fix_h}", f"fixJ{fix_j}"]
    return known + [f"{known[2]}{known[3]}{more}{fix_h}{fix_j}", "l" + left[-2:], "r" + right[:2], f"n{min(9, len(left))}", f"m{min(9, len(right))}", "bias"]


def train_joiner(r: Repairer, words: list[tuple[str, int]], seed: int = 5) -> Perceptron:
    """Line-join operation, trained on frequent words broken at places of chance and compounds broken at their hyphen.

    Each comes as it is and with a confusion put in; some plain words as if never seen, which is how a rare word
    looks. ``join`` takes the hyphen out, ``keep`` leaves it.
    """
    rng, model, samples = random.Random(seed), Perceptron(), []
    plain = [w for w, _ in words if "-" not in w and len(w) > 4][:TRAIN_WORDS]
    compounds = [w for w, _ in words if w.count("-") == 1 and len(w) > 4][:TRAIN_WORDS]
    every = max(1, len(plain) // max(1, len(compounds)))

    def broken(left: str, right: str, label: str, times: int) -> None:
        samples.extend([(join_features(r, left, right, r.count), label)] * times)
        places = [(p, x) for p, x in CONFUSIONS if p in right]
        if places:
            p, x = rng.choice(places)
            samples.append((join_features(r, left, right.replace(p, x, 1), r.count), label))

    for k, w in enumerate(plain):
        at = rng.randrange(2, len(w) - 1)
        broken(w[:at], w[at:], "join", 1)
        samples.append((join_features(r, w[:at], None, r.count), "join"))
        if k % 3 == 0:
            samples.append((join_features(Repairer({}, set(), r.editor), w[:at], w[at:], lambda _: 0), "join"))
    for w in compounds:
        left, right = w.split("-")
        broken(left, right, "keep", min(8, every))
        samples += [(join_features(r, left, None, r.count), "keep")] * min(8, every)
    for _ in range(ROUNDS):
        rng.shuffle(samples)
        for f, label in samples:
            model.learn(f, ("join", "keep"), label)
    return model.average()


def _apply(word: str, ops: list[str]) -> str:
    out = []
    for c, op in zip(word, ops, strict=True):
        out.append(c if op == "keep" else "" if op == "delete" else op.split(":", 1)[1])
    return "".join(out)


def proposals(model: Perceptron, word: str) -> Iterator[str]:
    """Corrections in the order of their scores: the editor's own, then those that differ from it, or from the word, in one or two places."""
    best, other = [], []
    for i, c in enumerate(word):
        allowed = OPERATIONS.get(c, {"keep"})
        s = model.scores(_features(word, i), allowed)
        top = max(s, key=lambda o: (s[o], o == "keep"))
        best.append(top)
        other += [(s[o] - s["keep"], i, o) for o in allowed if o != "keep"]
    yield _apply(word, best)
    other.sort(reverse=True)
    singles = []
    for _, i, o in other:
        width = next((len(r) for p, r in CONFUSIONS if o in ("replace:" + p, "insert:" + p) and word.startswith(r, i)), 1)
        if o == "delete":
            continue
        ops = ["keep"] * len(word)
        ops[i] = o
        for j in range(1, width):
            ops[i + j] = "delete"
        singles.append((i, width, ops))
        yield _apply(word, ops)
    for x, (i, n, a) in enumerate(singles):
        for j, m, b in singles[x + 1 : x + 40]:
            if i + n <= j or j + m <= i:
                yield _apply(word, [p if p != "keep" else q for p, q in zip(a, b, strict=True)])


@dataclass
class Repairer:
    """Lexicon and trained models. ``counts``: occurrences of a word; ``sure``: words seen outside scans.

    ``floor``: most occurrences of a word that ``counts`` doesn't hold; 0 if it holds all. ``beyond``: what a page
    needs of those: word to (occurrences, sure, correction), and `` prefix-`` for beginnings of sure compounds.
    """

    counts: dict[str, int]
    sure: set[str]
    editor: Perceptron
    joiner: Perceptron = field(default_factory=Perceptron)
    furniture: Perceptron = field(default_factory=Perceptron)
    floor: int = 0
    beyond: dict[str, tuple[int, bool, str | None]] = field(default_factory=dict)
    _cache: dict[str, str | None] = field(default_factory=dict)
    _starts: set[str] | None = None

    def correction(self, token: str) -> str | None:
        """The word that ``token`` misrecognises, in lower case; null if it is a word or nothing fits."""
        word = token.lower()
        if word in self.sure or not any(c.isalpha() for c in word) or len(word) < 2:
            return None
        if word in self.beyond:
            _, sure, fix = self.beyond[word]
            return None if sure else fix
        if word not in self._cache:
            if len(self._cache) > 200_000:
                self._cache.clear()
            own = self.counts.get(word, 0)
            self._cache[word] = next((p for p in proposals(self.editor, word) if p != word and self.counts.get(p, 0) >= max(RATIO * own, SURE)), None)
        return self._cache[word]

    def is_word(self, word: str) -> bool:
        word = word.lower()
        return self.known(word) or (self.count(word) > 0 and self.correction(word) is None)

    def count(self, word: str) -> int:
        return self.counts.get(word) or self.beyond.get(word, (0, False, None))[0]

    def known(self, word: str) -> bool:
        return word in self.sure or self.beyond.get(word, (0, False, None))[1]

    def keeps_hyphen(self, left: str, right: str | None) -> bool:
        """Whether the hyphen between the end of a line and the next one belongs to the word: else the lines are joined."""
        left, right = left.lower().lstrip("("), right.lower().strip(_TRIM) if right else None
        s = self.joiner.scores(join_features(self, left, right, self.count), ("join", "keep"))
        return s["keep"] > s["join"]

    def begins(self, prefix: str) -> bool:
        """Whether a sure compound begins so."""
        if self._starts is None:
            self._starts = {w[: i + 1] for w in self.sure for i, c in enumerate(w) if c == "-"}
        return " " + prefix in self.beyond or prefix in self._starts


class Wanted:
    """Stands for a ``Repairer`` and notes the words and prefixes that a page may ask for, whatever the answers are."""

    def __init__(self, hyphens: bool) -> None:
        self.hyphens, self.words, self.prefixes = hyphens, set(), set()

    def correction(self, token: str) -> None:
        self.words.add(token.lower())

    def is_word(self, word: str) -> bool:
        self.words.add(word.lower())
        return False

    def keeps_hyphen(self, left: str, right: str | None) -> bool:
        left = left.lower().lstrip("(")
        if right:
            right = right.lower().strip(_TRIM)
            self.words |= {f"{left}-{right}", left + right}
        else:
            self.prefixes.add(left + "-")
        return self.hyphens


def wanted(r: Repairer, text: str, taken: dict[int, str], before: str | None, after: str | None) -> set[str]:
    """What the page may need that the lexicon doesn't hold, as keys of ``beyond``."""
    found: set[str] = set()
    for hyphens in (True, False):
        w = Wanted(hyphens)
        repaired(w, text, taken, before, after)
        found |= {x for x in w.words if x not in r.counts} | {" " + x for x in w.prefixes if not r.begins(x)}
    return found


def open_proposals(r: Repairer, word: str, own: int) -> Iterator[tuple[int, str, int | None]]:
    """(rank, proposal, occurrences) of the corrections that may hold for a word beyond the lexicon; null occurrences are beyond it too.

    The first that the lexicon confirms ends them; those beyond it have ``floor`` occurrences at most.
    """
    if not any(c.isalpha() for c in word) or len(word) < 2:
        return
    least, seen = max(RATIO * own, SURE), {word}
    for rank, p in enumerate(proposals(r.editor, word)):
        if p in seen:
            continue
        seen.add(p)
        n = r.counts.get(p)
        if n is None and r.floor >= least or n is not None and n >= least:
            yield rank, p, n
        if n is not None and n >= least:
            return


@lru_cache(maxsize=100_000)
def skeleton(line: str) -> str:
    """The line as it looks: alike for common misreadings and for other page numbers."""
    s = re.sub(r"[^\w(' ]|[0-9]{2,}|(?<!\w)[0-9lI]+(?!\w)", "", line.lower().strip())
    for p, r in (("rn", "m"), ("cl", "d"), ("ri", "n"), ("i'", "r"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("in", "m")):
        s = s.replace(p, r)
    table = {"c": "e", "(": "e", "o": "a", "0": "a", "l": "i", "1": "i", "5": "s", "9": "g", "q": "g", "h": "b", "6": "b", "f": "t", "u": "n", "v": "y", "j": "i", "2": "z"}
    return re.sub(r"\s+", " ", "".join(table.get(c, c) for c in s)).strip()


def edges(text: str) -> list[tuple[int, str, int]]:
    """Lines that may be furniture: (line number, ``top`` or ``bottom``, rank from the edge among lines with text)."""
    filled = [i for i, x in enumerate(text.split("\n")) if x.strip()]
    top = [(i, "top", k) for k, i in enumerate(filled[:EDGE])]
    low = [(i, "bottom", k) for k, i in enumerate(reversed(filled[EDGE:]))][:EDGE]
    return top + low


def line_features(lines: list[str], i: int, zone: str, rank: int, median: float) -> list[str]:
    """Position and look of a line at the edge of a page."""
    x = lines[i].strip()
    w = x.split()
    letters = [a for a in w if a[:1].isalpha() and len(a) > 3]
    titled = sum(a[:1].isupper() for a in letters) / len(letters) if letters else 0.0
    step = 1 if zone == "top" else -1
    beyond = lines[i + step].strip() if 0 <= i + step < len(lines) else ""
    out = [
        f"{zone}{rank}", f"titled{round(titled * 4)}", f"words{min(len(w), 9)}", f"width{round(min(1.5, len(x) / max(1.0, median)) * 5)}",
        f"end{'.' if x[-1:] in '.!?' else ',' if x[-1:] in ',;:' else '-' if x[-1:] in HYPHENS else 'x'}", f"lower{x[:1].islower()}",
        f"gap{not beyond}", f"upper{x.isupper()}", f"digit{any(c.isdigit() for c in x)}", f"indent{len(lines[i]) - len(lines[i].lstrip()) > 3}",
    ]
    return out + [f"{a}&{b}" for a in out[:2] for b in out[2:8]] + [f"{out[1]}&{out[4]}&{out[5]}", f"{out[2]}&{out[4]}&{out[6]}", "bias"]


def _median_width(lines: list[str]) -> float:
    widths = sorted(len(x.strip()) for x in lines if len(x.strip()) > 12)
    return widths[len(widths) // 2] if widths else 40.0


def train_furniture(pages: list[tuple[str, list[str]]], seed: int = 11) -> Perceptron:
    """Line classifier: lines that other pages of the document repeat against edge lines that plainly run on.

    ``pages``: text and the skeletons repeated in its document. What it is not told is whether a line repeats.
    """
    rng, model, samples = random.Random(seed), Perceptron(), []
    for text, repeated in pages:
        lines, again = text.split("\n"), set(repeated)
        median = _median_width(lines)
        for i, zone, rank in edges(text):
            x = lines[i].strip()
            if _NUMBER.match(x) or _ROMAN.match(x):
                continue
            if f"{zone}:{skeleton(x)}" in again:
                samples.append((line_features(lines, i, zone, rank, median), "furniture"))
            elif x[:1].islower() or len(x.split()) > 6 or x[-1:] in HYPHENS:
                samples.append((line_features(lines, i, zone, rank, median), "keep"))
    for _ in range(ROUNDS):
        rng.shuffle(samples)
        for f, label in samples:
            model.learn(f, ("keep", "furniture"), label)
    return model.average()


def furniture(r: Repairer, text: str, repeated: Iterable[str], page: int | None, index: int) -> dict[int, str]:
    """Lines of the page that belong to the page: line number to ``running_line`` or ``page_number``."""
    lines, again = text.split("\n"), set(repeated)
    median, found = _median_width(lines), {}
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for zone, run in (("top", filled[:EDGE]), ("bottom", filled[::-1][:EDGE])):
        for rank, i in enumerate(run):
            if i in found:
                break
            x = lines[i].strip()
            if _ROMAN.match(x):
                found[i] = "page_number"
                continue
            m = _NUMBER.match(x)
            if m and any(c.isdigit() or c in "lIoO|" for c in x) and not re.fullmatch(r"[A-Za-z]+", x.strip()):
                value = m.group(1)
                if value.isdigit() and page is not None and int(value) not in (page, index, index + 1) and x.strip().isdigit():
                    break
                found[i] = "page_number"
                continue
            if f"{zone}:{skeleton(x)}" in again:
                found[i] = "running_line"
                continue
            s = r.furniture.scores(line_features(lines, i, zone, rank, median), ("keep", "furniture"))
            if s["furniture"] > s["keep"] and x[-1:] not in HYPHENS:
                found[i] = "running_line"
                continue
            break
    return found


def _fragment(line: str) -> str | None:
    """The beginning of a word that a hyphen at the line's end breaks off."""
    x = line.rstrip()
    if x and x[-1] in HYPHENS:
        left = x[:-1].split(" ")[-1] if x[:-1] and not x[:-1][-1].isspace() else ""
        if any(c.isalpha() for c in left) and (left[-1].isalnum() or left[-1] in "('"):
            return left.lstrip("\"“„")
    return None


def page_ends(text: str, taken: Iterable[int]) -> tuple[str | None, str | None]:
    """First token of the page's text, and what a hyphen at its end breaks off."""
    skip = set(taken)
    body = [x for i, x in enumerate(text.split("\n")) if i not in skip and x.strip()]
    return (body[0].split()[0], _fragment(body[-1])) if body else (None, None)


def repaired(r: Repairer, text: str, taken: dict[int, str], before: str | None, after: str | None) -> tuple[list[tuple[int, str]], list[str], bool, bool]:
    """Findings (line, kind), paragraphs, whether the first goes on from the page before and the last goes on.

    ``before``: what the page before breaks off; ``after``: the first token of the next page.
    """
    lines = text.split("\n")
    found = [(i, k) for i, k in sorted(taken.items())]
    body = [(i, lines[i].replace("\r", "")) for i in range(len(lines)) if i not in taken]
    filled = [i for i, x in body if x.strip()]
    follow = dict(zip(filled, filled[1:]))
    token_of = {i: x.split()[0] for i, x in body if x.strip()}
    paragraphs: list[list[str]] = [[]]
    carried = before
    misread: set[int] = set()
    carried_line: int | None = None
    for i, x in body:
        if not x.strip():
            if carried is None and paragraphs[-1]:
                paragraphs.append([])
            continue
        tokens = x.split()
        left = _fragment(x)
        right = token_of.get(follow[i]) if i in follow else after
        keeps = left is not None and r.keeps_hyphen(left, right)
        if left is not None and not keeps:
            found.append((i, "hyphen_break"))
        words = []
        for k, t in enumerate(tokens):
            if k == 0 and carried is not None:
                hyphen = "-" if r.keeps_hyphen(carried, t) else ""
                core = t.rstrip(_TRIM)
                whole = carried + hyphen + core
                fix = None if r.is_word(whole) else r.correction(whole)
                if fix is not None:
                    if not fix.startswith(carried.lower()) and carried_line is not None:
                        misread.add(carried_line)
                    if not fix.endswith(core.lower()):
                        misread.add(i)
                words.append((_cased(whole, fix) if fix else whole) + t[len(core) :])
                carried = None
                continue
            if k == len(tokens) - 1 and left is not None:
                break
            core = t.strip(_TRIM)
            fix = r.correction(core) if core else None
            if fix is not None:
                misread.add(i)
                at = t.index(core)
                t = t[:at] + _cased(core, fix) + t[at + len(core) :]
            if not re.fullmatch(r"[-–—]", t):
                words.append(t)
        paragraphs[-1] += words
        if left is not None:
            carried, carried_line = left, i
    found += [(i, "misread") for i in sorted(misread)]
    texts = [" ".join(p) for p in paragraphs if p]
    first_goes_on = before is not None or bool(texts and texts[0][:1].islower())
    last_goes_on = carried is not None or bool(texts and texts[-1][-1:] not in ".!?\"”")
    return found, texts, first_goes_on, last_goes_on


def _cased(seen: str, fix: str) -> str:
    return fix.upper() if seen.isupper() and len(seen) > 2 else fix[:1].upper() + fix[1:] if seen[:1].isupper() else fix


def scanned_pages(items: DataFrame) -> DataFrame:
    """doc, item, page, text of the latest delivery of each scanned page."""
    rows = items.where(F.col("kind") == KIND).select(
        known(F.col("document_key")).alias("doc"), F.col("item_index").alias("item"), F.col("location.page").alias("page"), F.col("text_or_value").alias("text"), "recorded_at"
    ).where("doc is not null and item is not null")
    return latest(rows, ["doc", "item"], ["page", "text"]).where("text is not null and trim(text) <> ''")


def word_counts(items: DataFrame) -> DataFrame:
    """word, n, sure (occurrences outside scanned pages), over all items."""
    scan = F.col("kind") == KIND
    inner = F.when(scan, F.regexp_replace("text_or_value", r"[-¬‐‑­]\s*\n\s*\S+|\S+\s*$", " ")).otherwise(F.col("text_or_value"))
    pieces = items.where("text_or_value is not null").select(scan.alias("scan"), F.explode(F.split(F.lower(inner), r"\s+")).alias("w"))
    # Pieces are counted as written; only the different ones are cleaned.
    words = pieces.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("scan")).alias("sure"))
    clean = words.select("n", "sure", F.regexp_replace("w", r"^[.,;:!?\"“”„»«]+|[.,;:!?\"“”„»«]+$", "").alias("word")).where(F.length("word").between(2, 40))
    own = clean.where(F.col("word").rlike(r"^[\p{L}][\p{L}0-9(']*(-[\p{L}]+)*$"))
    return own.groupBy("word").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"))


def fitted(items: DataFrame, pages: DataFrame, repeated: DataFrame) -> Repairer:
    """Trains both perceptrons on bounded samples: the most frequent words, and pages in the order of a hash."""
    rows = word_counts(items).orderBy(F.desc("n"), "word").limit(LEXICON + 1).collect()
    floor = rows[LEXICON]["n"] if len(rows) > LEXICON else 0
    rows = rows[:LEXICON]
    counts = {x["word"]: x["n"] for x in rows}
    sure = {x["word"] for x in rows if x["sure"] >= SURE}
    basis = [(w, n) for w, n in counts.items() if w in sure and re.fullmatch(r"[^\W\d_]{2,}(?:-[^\W\d_]+)?", w)] or [(w, n) for w, n in counts.items() if re.fullmatch(r"[^\W\d_]{2,}", w)]
    sample = pages.join(repeated, ["doc", "item"], "left").orderBy(F.xxhash64("doc", "item"), "doc", "item").limit(TRAIN_PAGES)
    made = [(x["text"], x["again"] or []) for x in sample.select("text", "again").collect()]
    return trained(counts, sure, basis, made, floor)


def trained(counts: dict[str, int], sure: set[str], basis: list[tuple[str, int]], pages: list[tuple[str, list[str]]], floor: int = 0) -> Repairer:
    """A repairer with its three perceptrons: characters, line joins, lines of the page."""
    r = Repairer(counts, sure, train_editor(basis), furniture=train_furniture(pages), floor=floor)
    r.joiner = train_joiner(r, basis)
    r._cache.clear()
    return r


def beyond_lexicon(items: DataFrame, pages: DataFrame, shared: Broadcast) -> DataFrame:
    """doc, item, beyond: what each page needs of the words that the lexicon doesn't hold, with exact counts.

    ``pages``: doc, item, text, at, kinds, before, after. Distinct words meet the counts of all words; of their
    corrections only those that could still hold are looked up.
    """
    all_words = checkpointed(word_counts(items))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for b in batches:
            rows = [(x.doc, x.item, w) for x in b.itertuples(index=False) for w in sorted(wanted(r, x.text, dict(zip(map(int, x.at), x.kinds)), x.before, x.after))]
            yield pd.DataFrame(rows, columns=["doc", "item", "word"]).astype({"item": "int32"})

    asks = checkpointed(pages.mapInPandas(asked, "doc string, item int, word string"))
    distinct = asks.select("word").distinct()
    whole = ~F.col("word").startswith(" ")
    own = checkpointed(distinct.where(whole).join(all_words, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("sure", F.lit(0)) >= SURE).alias("sure")))

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for b in batches:
            rows = [(w, n, *p) for w, n in zip(b["word"], b["n"], strict=True) for p in open_proposals(r, w, int(n))]
            yield pd.DataFrame(rows, columns=["of", "own", "rank", "word", "known"]).astype({"own": "int64", "rank": "int32", "known": "Int64"})

    offers = own.where("not sure").select("word", "n").mapInPandas(proposed, "of string, own bigint, rank int, word string, known bigint")
    held = offers.join(all_words.select("word", "n"), "word", "left").where(F.coalesce("known", "n", F.lit(0)) >= F.greatest(F.lit(RATIO) * F.col("own"), F.lit(SURE)))
    fixes = held.groupBy(F.col("of").alias("word")).agg(F.min_by("word", "rank").alias("fix"))
    parts = F.split("word", "-")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit(" "), F.array_join(F.slice(parts, F.lit(1), k), "-"), F.lit("-")))
    prefixes = all_words.where((F.col("sure") >= SURE) & F.contains("word", F.lit("-"))).select(F.explode(starts).alias("word")).distinct()
    answers = own.join(fixes, "word", "left").unionByName(
        distinct.where(~whole).join(prefixes, "word", "left_semi").select("word", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("sure"), F.lit(None).cast("string").alias("fix"))
    )
    return asks.join(answers, "word").groupBy("doc", "item").agg(F.collect_list(F.struct("word", "n", "sure", "fix")).alias("beyond"))  # the words of one page


def repeated_lines(pages: DataFrame) -> DataFrame:
    """doc, item, again: for each page the edge lines, as ``zone:skeleton``, that other pages of its document have too."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for doc, item, text in zip(b["doc"], b["item"], b["text"], strict=True):
                all_lines = text.split("\n")
                for i, zone, _ in edges(text):
                    if len(s := skeleton(all_lines[i])) > 3:
                        rows.add((doc, item, f"{zone}:{s}"))
            yield pd.DataFrame(sorted(rows), columns=["doc", "item", "key"]).astype({"item": "int32"})

    each = pages.select("doc", "item", "text").mapInPandas(lines, "doc string, item int, key string")
    often = each.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATED)
    return each.join(often, ["doc", "key"]).groupBy("doc", "item").agg(F.collect_set("key").alias("again"))


def _pages_repaired(items: DataFrame) -> DataFrame:
    """doc, item, findings, paragraphs, first_on, last_on per page."""
    pages = checkpointed(scanned_pages(items))
    repeated = checkpointed(repeated_lines(pages))
    model = fitted(items, pages, repeated)
    shared = items.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and the training sizes

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                again = [] if x.again is None else list(x.again)
                taken = furniture(r, x.text, again, None if pd.isna(x.page) else int(x.page), int(x.item))
                rows.append((x.doc, x.item, x.text, list(taken), list(taken.values()), *page_ends(x.text, taken)))
            yield pd.DataFrame(rows, columns=["doc", "item", "text", "at", "kinds", "first", "last"])

    flagged = checkpointed(pages.join(repeated, ["doc", "item"], "left").mapInPandas(
        ends, "doc string, item int, text string, at array<int>, kinds array<string>, first string, last string"
    ))
    after = flagged.select("doc", (F.col("item") - 1).alias("item"), F.col("first").alias("after"))
    before = flagged.select("doc", (F.col("item") + 1).alias("item"), F.col("last").alias("before"))
    full = flagged.select("doc", "item", "text", "at", "kinds").join(after, ["doc", "item"], "left").join(before, ["doc", "item"], "left")
    more = bool(model.floor)  # else the lexicon holds all words
    if more:
        full = full.join(beyond_lexicon(items, full, shared), ["doc", "item"], "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                if more:
                    r.beyond = {} if x.beyond is None else {y["word"]: (y["n"], y["sure"], y["fix"]) for y in x.beyond}
                found, texts, on, off = repaired(r, x.text, dict(zip(map(int, x.at), x.kinds)), x.before, x.after)
                rows.append((x.doc, x.item, [{"line_no": i, "noise_kind": k} for i, k in found], texts, on, off))
            yield pd.DataFrame(rows, columns=["doc", "item", "findings", "paragraphs", "first_on", "last_on"])

    return full.mapInPandas(
        repair, "doc string, item int, findings array<struct<line_no int, noise_kind string>>, paragraphs array<string>, first_on boolean, last_on boolean"
    )


def page_noise(items: DataFrame) -> DataFrame:
    """Noise of scanned pages: document_key, item_index, line_no, noise_kind (running_line, page_number, hyphen_break, misread).

    One row per line and kind. Null, blank and other items give no rows; a redelivered page is judged in its
    latest delivery. Word counts and statistics cover all items (words beyond the lexicon by a join); the perceptrons are fitted on bounded samples.
    """
    return _pages_repaired(items).select("doc", "item", F.explode("findings").alias("f")).select(
        F.col("doc").alias("document_key"), F.col("item").alias("item_index"), "f.line_no", "f.noise_kind"
    ).distinct()


def page_paragraphs(items: DataFrame) -> DataFrame:
    """Repaired text in order: document_key, paragraph_no, item_index, piece_no, text.

    A paragraph that runs over pages has one piece per page; a word broken between pages is whole in the later
    piece. Pieces are rows, so a document of any length stays spread.
    """
    pages = checkpointed(_pages_repaired(items))
    goes_on = pages.select("doc", (F.col("item") + 1).alias("item"), F.col("last_on").alias("runs_on"))
    pieces = pages.join(goes_on, ["doc", "item"], "left").select(
        "doc", "item", "first_on", F.coalesce("runs_on", F.lit(False)).alias("runs_on"), F.posexplode("paragraphs").alias("piece", "text")
    ).withColumn("begins", ~((F.col("piece") == 0) & F.col("first_on") & F.col("runs_on"))).withColumn("block", F.floor(F.col("item") / 1024))
    out = counted_up(pieces, ["doc"], "block", [F.col("item"), F.col("piece")], "begins", "paragraph_no")
    return out.select(F.col("doc").alias("document_key"), F.greatest(F.lit(0), F.col("paragraph_no") - 1).alias("paragraph_no"), F.col("item").alias("item_index"), F.col("piece").alias("piece_no"), "text")
