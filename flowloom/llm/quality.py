"""Problem 8: text statistics, and whether a text is prose, a list, a table or junk.

A text is described by a few distributions: its characters over character classes, its characters over the lengths of the
segments they stand in, its words over the function words of the language that fits best, and some shares and counts. Function words are
compared with prose profiles of each language by Jensen-Shannon divergence; the whole description is then compared, by the same divergence, with
structural profiles learnt from a labelled sample, and the nearest profile gives the kind, whatever the length of the text. Shares of few
words or letters are drawn towards those of the labelled texts by a few words that are added.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.batches import slices
from flowloom.session import materialize

MAX_LABELLED = 8000  # labelled texts that profiles are learnt from; more are thinned by a hash of their id
RADIUS = 0.015  # every labelled text is at most so far from a profile of its kind
NUMBERS_AT_A_TIME = 1_000_000  # numbers compared at a time, however many profiles there are
KINDS = ("prose", "list", "table", "junk")

LONG_WORD = 20  # letters; hardly any word of prose has more
KNOWN_BITS = 24  # letter sequences known from prose are kept in a bitmap of so many bits; n of them let n / 2**24 of strange ones pass
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
WORD = rf"[{_CJK}]|[\p{{L}}\p{{M}}\p{{N}}'’]+"
# Character classes in the order of the counts; the last one takes what no other does.
CLASSES = ("vowel", "consonant", "upper", "accented", "kana_han", "cyrillic", "letter", "digit", "space", "newline", "tab", "stop", "comma", "colon", "pipe", "dash", "quote", "round", "angle", "slash", "code", "mark", "punct", "symbol", "damaged", "other")
SEGMENT_WORDS = np.array([1, 2, 3, 4, 6, 9])  # upper ends of the classes of segment length in words
_AT = {c: i for i, c in enumerate(CLASSES)}
_SETS = {"vowel": "aeiouy", "newline": "\n\r\u2028\u2029", "tab": "\t", "stop": ".!?。！？…¡¿", "comma": ",、，", "colon": ":;：；", "pipe": "|¦│", "dash": "-–—•*·‣▪", "quote": "\"'«»“”‘’`´", "round": "()[]（）「」【】", "angle": "<>", "slash": "/\\", "code": "&={}#%_~^@+$"}
_CLASS_OF = {c: k for k, chars in _SETS.items() for c in chars}
_CATEGORY = {"N": "digit", "M": "mark", "P": "punct", "S": "symbol", "Z": "space", "C": "damaged"}
# What a character may be, a bit each above the five bits of its class.
_LETTER, _SINGLE, _APOSTROPHE, _DIGIT, _BREAK, _STOP, _ENDING, _BLANK, _NEWLINE, _TRIM = (1 << (5 + i) for i in range(10))
_TAG = re.compile(r"<[^<>]*>")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|\{\{[^{}]*\}\}|&#?\w+;|(?:https?://|www\.)\S+")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_KANA = re.compile("[぀-ヿ㐀-鿿]")
_PAIR = re.compile(r"(?<! )  (?! )")
_TEXT = re.compile(r"[^\s\u0000-\u001f\u00a0\u00ad\u200b-\u200f\u2028-\u202f\u2060-\u206f\u3000\ufeff]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


class _Characters:
    """The properties and the lower case of code points, looked up once for each code point that occurs."""

    def __init__(self):
        self.bits = np.zeros(0x110000, np.int32)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.known = np.zeros(0x110000, bool)

    def __reduce__(self):
        return _Characters, ()  # a task fills its own, so that none travels

    def see(self, points: np.ndarray) -> None:
        fresh = points[~self.known[points]]
        for p in np.unique(fresh).tolist():
            self.bits[p] = self._describe(chr(p))
            low = chr(p).lower()
            self.lower[p] = ord(low) if len(low) == 1 else p
            self.known[p] = True

    @staticmethod
    def _describe(c: str) -> int:
        p, cat = ord(c), unicodedata.category(c)
        kana = 0x3040 <= p < 0x3100 or 0x3400 <= p < 0xA000
        if c in _CLASS_OF:
            k = _CLASS_OF[c]
        elif p == 0xFFFD:
            k = "damaged"
        elif cat[0] != "L":
            k = _CATEGORY[cat[0]]
        elif p < 128:
            k = "consonant" if cat == "Ll" else "upper"
        else:
            k = "accented" if p < 0x250 else "cyrillic" if 0x400 <= p < 0x530 else "kana_han" if kana else "letter"
        bits = _AT[k]
        if kana:
            bits |= _SINGLE
        elif c.isalnum():
            bits |= _LETTER | (_DIGIT if c.isdigit() else 0)
        for flag, chars in ((_APOSTROPHE, "'’"), (_BREAK, "\n\r\t|;,、，:：[](){}\"•*"), (_STOP, ".!?。！？…"), (_ENDING, ".!?。！？…:)\"'"), (_NEWLINE, "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"), (_TRIM, "-–—_=")):
            bits |= flag if c in chars else 0
        return bits | (_BLANK | _TRIM if c.isspace() else 0)


_CHARACTERS: list[_Characters] = []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash_of_word(word: str) -> int:
    """The hash that `Batch` gives a word."""
    total, power = 0, 1
    for c in word:
        total = (total + (ord(c) + 1) * int(_ODD) * power) % 2**64
        power = power * _BASE % 2**64
    return total


class Batch:
    """Some texts as one array of code points, a line break before, between and after them, so that no run crosses from text to text."""

    def __init__(self, texts: list[str]):
        if not _CHARACTERS:
            _CHARACTERS.append(_Characters())
        self.texts, n = texts, len(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
        x = np.frombuffer(("\n" + "\n".join([*texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
        _CHARACTERS[0].see(x)
        self.count, self.starts = n, 1 + np.cumsum(sizes) - sizes
        self.sizes = np.maximum(sizes - 1, 1)
        self.owner = np.concatenate([[n], np.repeat(np.arange(n), sizes)])
        self.owner[self.starts + sizes - 1] = n
        self.bits, self.low = _CHARACTERS[0].bits[x], _CHARACTERS[0].lower[x]
        letter = self.has(_LETTER)
        joint = self.has(_APOSTROPHE)
        joint[1:-1] &= letter[:-2] & letter[2:]
        self.letter = letter | joint
        self.single = self.has(_SINGLE)
        first, last = self.letter.copy(), self.letter.copy()
        first[1:] &= ~self.letter[:-1]
        last[:-1] &= ~self.letter[1:]
        self.first = first | self.single
        self.last = last | self.single
        self.begin, self.end = np.flatnonzero(self.first), np.flatnonzero(self.last)
        self.word_owner = self.owner[self.begin]
        self.words = self.per_text(self.word_owner)

    def has(self, flag: int) -> np.ndarray:
        return (self.bits & flag) != 0

    def per_text(self, owners: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(owners, weights, self.count + 1)[: self.count].astype(float)

    def classes(self) -> np.ndarray:
        k = len(CLASSES)
        return np.bincount(self.owner * k + (self.bits & 31), minlength=(self.count + 1) * k).reshape(-1, k)[: self.count].astype(float)

    def word_hashes(self) -> np.ndarray:
        """A hash of each word's lower-case letters: a difference of prefix sums, brought to the word's beginning."""
        powers = _powers(_BASE, len(self.low))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * _ODD * powers, dtype=np.uint64)])
        back = _powers(pow(_BASE, -1, 2**64), len(self.low))
        return (sums[self.end + 1] - sums[self.begin]) * back[self.begin]

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """(owner, key) of every letter with its neighbours in the word, the ends of the word being neighbours too."""
        at = np.flatnonzero(self.letter | self.single)
        low = self.low.astype(np.uint64)
        left = np.where(self.first[at], np.uint64(1), low[at - 1])
        right = np.where(self.last[at], np.uint64(2), low[at + 1])
        key = (left * np.uint64(0xBF58476D1CE4E5B9) + low[at]) * np.uint64(0x94D049BB133111EB) + right
        key = (key ^ (key >> np.uint64(29))) * _ODD
        return self.owner[at], (key >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """How many times each text's commonest word comes again."""
        key = hashes + self.word_owner.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(key)
        same = key[order]
        run = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, int)
        most = np.zeros(self.count + 1)
        np.maximum.at(most, self.word_owner[order[run]], np.diff(np.append(run, len(same))))
        return np.maximum(most[: self.count] - 1, 0)

    def spans(self, pattern: re.Pattern, among: Iterable[int]) -> list[tuple[int, int]]:
        """Places of a pattern in some of the texts."""
        return [(self.starts[i] + m.start(), self.starts[i] + m.end()) for i in among for m in pattern.finditer(self.texts[i])]

    def covered(self, spans: list[tuple[int, int]]) -> np.ndarray:
        edge = np.zeros(len(self.bits) + 1, np.int32)
        for a, b in spans:
            edge[a] += 1
            edge[b] -= 1
        return np.cumsum(edge[:-1]) > 0

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text over the classes of segment length, and the number of its segments.

        Segments end at breaks, at stops before a blank, at several blanks and at tags; blanks and dashes around them do not count.
        """
        blank = self.has(_BLANK)
        cut = self.has(_BREAK)
        cut[:-1] |= self.has(_STOP)[:-1] & blank[1:]
        cut[1:] |= blank[1:] & blank[:-1]
        cut[:-1] |= blank[1:] & blank[:-1]
        tagged = [i for i, t in enumerate(self.texts) if "<" in t and ">" in t]
        if tagged:
            cut |= self.covered(self.spans(_TAG, tagged))
        core = np.flatnonzero(~cut & ~self.has(_TRIM))
        number = np.cumsum(cut)[core]
        new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(core) else np.zeros(0, int)
        a, b = core[new], core[np.append(new[1:], len(core)) - 1] if len(core) else core
        before = np.cumsum(self.first)
        words = np.maximum(before[b] - before[a] + self.first[a], 1)
        k = len(SEGMENT_WORDS) + 1
        kind = np.searchsorted(SEGMENT_WORDS, words)
        out = np.bincount(self.owner[a] * k + kind, b - a + 1, (self.count + 1) * k).reshape(-1, k)[: self.count]
        return out, self.per_text(self.owner[a])

    def markup(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text in markup or link addresses, and its letters and digits outside them."""
        signs = ("<", "{{", "&", "://", "www.")
        marked = [i for i, t in enumerate(self.texts) if any(s in t for s in signs)]
        alnum = np.flatnonzero(self.has(_LETTER) | self.single)
        if not marked:
            return np.zeros(self.count), self.per_text(self.owner[alnum])
        spans = self.spans(_MARKUP, marked)
        for i in marked:
            # Behind the last end of a comment none is looked for, so that many beginnings are not each searched to the end.
            t = self.texts[i]
            spans += [(self.starts[i] + m.start(), self.starts[i] + m.end()) for m in _COMMENT.finditer(t, 0, t.rfind("-->") + 3)] if "-->" in t else []
        inside = self.covered(spans)
        return self.per_text(self.owner[inside]), self.per_text(self.owner[alnum[~inside[alnum]]])

    def ended_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """How many lines of each text end in punctuation, and how many are not blank."""
        newline, shown = self.has(_NEWLINE), np.flatnonzero(~self.has(_BLANK))
        line = np.cumsum(newline)[shown]
        last = shown[np.flatnonzero(np.concatenate([line[1:] != line[:-1], [True]]))] if len(shown) else shown
        return self.per_text(self.owner[last], self.has(_ENDING)[last].astype(float)), self.per_text(self.owner[last])


def _entropy(x: np.ndarray) -> np.ndarray:
    """-x log2 x, 0 where x is 0."""
    return -x * np.log2(np.maximum(x, np.finfo(x.dtype).tiny))


def divergences(p: np.ndarray, q: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum over the columns of the Jensen-Shannon divergence, in bits, of each row of p from the row of q beside it, or from q's only row.

    Rows may hold several distributions side by side, each column with the weight of its distribution.
    """
    return np.maximum((_entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2) @ weights, 0)


# The Jensen-Shannon divergence in bits is at least the squared Hellinger distance and at most 1 / ln 2 = 1.4427 times that.
HELLINGER = 1.4428


def nearest(p: np.ndarray, q: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of p the row of q of least divergence, the first of several, and that divergence.

    Hellinger distances, a product of matrices, leave out the rows of q that cannot be the nearest; the rest are compared.
    """
    index, least = np.empty(len(p), int), np.empty(len(p))
    root, mass, step = np.sqrt(q) * weights, q @ weights / 2, max(1, NUMBERS_AT_A_TIME // max(1, len(q)))
    for a in range(0, len(p), step):
        x = p[a : a + step]
        apart = (x @ weights / 2)[:, None] + mass[None] - np.sqrt(x) @ root.T
        i, j = np.nonzero(apart <= apart.min(1, keepdims=True) * HELLINGER + 1e-9)
        for b in range(0, len(i), max(1, NUMBERS_AT_A_TIME // q.shape[1])):
            at = slice(b, b + max(1, NUMBERS_AT_A_TIME // q.shape[1]))
            apart[i[at], j[at]] = divergences(x[i[at]], q[j[at]], weights)
        kept = np.full(apart.shape, np.inf)
        kept[i, j] = apart[i, j]
        index[a : a + step], least[a : a + step] = kept.argmin(1), kept.min(1)
    return index, least


def _normal(x: np.ndarray) -> np.ndarray:
    total = x.sum(1, keepdims=True)
    return np.divide(x, total, out=np.full_like(x, 1 / x.shape[1]), where=total > 0)


def plain(text: str) -> str:
    """Text without settings that say nothing of its kind: all capitals, doubled spaces, invisible marks."""
    if text.isupper():
        text = text.lower()
    text = text.replace("\ufeff", "").replace("\u200b", "").replace("\u00ad", "")
    return _PAIR.sub(" ", text) if "  " in text else text


class Languages:
    """Function words of each language, their distribution in prose, and the letter sequences of prose."""

    def __init__(self, common: dict[str, list[str]]):
        self.names = sorted(common)
        words = sorted({w for ws in common.values() for w in ws})
        hashes = np.array([_hash_of_word(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]
        at = {w: i for i, w in enumerate(self.words)}
        self.columns = {lang: np.array(sorted({at[w] for w in common[lang]}), int) for lang in self.names}
        # Kana words of several characters are not set off by blanks, so they are searched for, the longest first.
        kana = sorted((w for w in words if _KANA.match(w) and len(w) > 1), key=lambda w: (-len(w), w))
        self.kana = re.compile("|".join(map(re.escape, kana))) if kana else None
        self.at = at
        self.prose = {lang: np.full(len(c) + 1, 1 / (len(c) + 1)) for lang, c in self.columns.items()}
        self.known, self.bitmap = np.zeros(0, np.int64), None

    def counts(self, batch: Batch, hashes: np.ndarray) -> np.ndarray:
        """Function words of every text, a column each."""
        v = len(self.words)
        if not v:
            return np.zeros((batch.count, 0))
        at = np.minimum(np.searchsorted(self.hashes, hashes), v - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        owners, columns = batch.word_owner[hit], at[hit]
        if self.kana:
            found = [(i, self.at[m]) for i in np.unique(batch.owner[batch.single]).tolist() if i < batch.count for m in self.kana.findall(batch.texts[i])]
            if found:
                more = np.array(found)
                owners, columns = np.concatenate([owners, more[:, 0]]), np.concatenate([columns, more[:, 1]])
        return np.bincount(owners * v + columns, minlength=batch.count * v)[: batch.count * v].reshape(-1, v).astype(float)

    def by_language(self, counts: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of each language's words, the last column for all other words of the text."""
        out = {}
        for lang in self.names:
            own = counts[:, self.columns[lang]]
            out[lang] = np.concatenate([own, np.maximum(words - own.sum(1), 0)[:, None]], 1)
        return out

    def prose_part(self, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of some prose texts: each language's counts over the texts that have most of its words, and the letter sequences."""
        batch = Batch([plain(t) for t in texts])
        by = self.by_language(self.counts(batch, batch.word_hashes()), batch.words)
        most = np.stack([by[x][:, :-1].sum(1) for x in self.names]).argmax(0) if self.names else np.zeros(0, int)
        return {lang: by[lang][most == i].sum(0) for i, lang in enumerate(self.names)}, np.unique(batch.sequences()[1])

    def fit(self, counts: dict[str, np.ndarray], known: np.ndarray) -> Languages:
        """Profiles from summed counts, one of each word added, and the sequences of all prose."""
        self.prose = {lang: (c + 1) / (c + 1).sum() for lang, c in counts.items()}
        self.known, self.bitmap = np.unique(known), None
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"bitmap": None}

    def seen(self, keys: np.ndarray) -> np.ndarray:
        if self.bitmap is None:
            self.bitmap = np.zeros(1 << KNOWN_BITS, bool)
            self.bitmap[self.known] = True
        return self.bitmap[keys]


# Shares of a description: hits, base, and how many of the base are added with the share of the labelled texts.
SHARES = (("function", "words", 2), ("common", "words", 2), ("numbers", "words", 1), ("repeated", "words", 1), ("ended", "lines", 0), ("vowels", "latin", 8), ("long", "chars", 0), ("markup", "chars", 0), ("seen", "sequences", 2))
# Counts n of a description, as the share n / (n + scale).
COUNTS = (("entries", 3), ("words", 8))
# The parts of a description: how many columns each has, and its weight.
PARTS = (("classes", len(CLASSES), 1.0), ("segments", len(SEGMENT_WORDS) + 1, 1.0), ("function", 2, 0.7), ("common", 2, 0.5), ("numbers", 2, 0.5), ("repeated", 2, 1.0), ("ended", 2, 0.3), ("vowels", 2, 0.5), ("long", 2, 0.7), ("markup", 2, 0.7), ("seen", 2, 1.0), ("entries", 2, 1.0), ("words", 2, 1.0), ("outside", 2, 0.5))
WEIGHTS = np.concatenate([np.full(k, w) for _, k, w in PARTS]) / sum(w for *_, w in PARTS)
MEASURES = (*(f"class_{c}" for c in CLASSES), *(f"segment_{i}" for i in range(len(SEGMENT_WORDS) + 1)), *(s for s, *_ in SHARES), "words", "lines", "latin", "chars", "sequences", "entries", "outside")


class Profiles:
    """Prose profiles of the languages' function words, and structural profiles of the kinds."""

    def __init__(self, languages: Languages):
        self.languages = languages
        self.priors = np.zeros(len(SHARES))
        self.profiles = np.zeros((0, len(WEIGHTS)))
        self.kinds = np.zeros(0, int)

    def measure(self, texts: list[str]) -> np.ndarray:
        """The MEASURES of each text, all of them sums over its characters, words, lines or segments."""
        batch = Batch([plain(t) for t in texts])
        lang, n, words = self.languages, batch.count, batch.words
        classes = batch.classes()
        hashes = batch.word_hashes()
        by = lang.by_language(lang.counts(batch, hashes), words)
        function, common = np.ones(n), np.zeros(n)
        for x in lang.names:
            own = by[x][:, :-1].sum(1)
            some = np.flatnonzero(own)
            if len(some):
                w = np.ones(by[x].shape[1])
                function[some] = np.minimum(function[some], divergences(_normal(by[x][some]), lang.prose[x][None], w))
            common = np.maximum(common, own)
        owner, keys = batch.sequences()
        length = batch.end + 1 - batch.begin
        long = length > LONG_WORD
        segments, entries = batch.segments()
        markup, outside = batch.markup()
        ended, lines = batch.ended_lines()
        digits = batch.has(_DIGIT)[batch.begin].astype(float)
        sequences = batch.per_text(owner)
        hits = {
            "function": function * words, "common": common, "numbers": batch.per_text(batch.word_owner, digits), "repeated": batch.repeated(hashes), "ended": ended, "vowels": classes[:, 0],
            "long": batch.per_text(batch.word_owner[long], length[long].astype(float)), "markup": markup, "seen": batch.per_text(owner, lang.seen(keys).astype(float)),
        }
        bases = [words, lines, classes[:, 0] + classes[:, 1], batch.sizes.astype(float), sequences, entries, outside]
        return np.concatenate([classes, segments, np.stack([*(hits[s] for s, *_ in SHARES), *bases], 1)], 1)

    def describe(self, measures: np.ndarray) -> np.ndarray:
        """The parts of the description side by side, each a distribution."""
        col = {c: measures[:, i] for i, c in enumerate(MEASURES)}
        parts = [_normal(measures[:, : len(CLASSES)]), _normal(measures[:, len(CLASSES) : len(CLASSES) + len(SEGMENT_WORDS) + 1])]
        shares = [self._share(col[s], col[b], m, p) for (s, b, m), p in zip(SHARES, self.priors, strict=True)]
        shares += [col[c] / (col[c] + scale) for c, scale in COUNTS]
        shares.append((col["outside"] > 0).astype(float))
        for x in shares:
            x = np.clip(x, 0, 1)
            parts.append(np.stack([x, 1 - x], 1))
        return np.concatenate(parts, 1)

    @staticmethod
    def _share(hits: np.ndarray, base: np.ndarray, added: float, prior: float) -> np.ndarray:
        total = base + added
        return np.divide(hits + added * prior, total, out=np.full(len(hits), float(prior)), where=total > 0)

    def fit(self, measures: np.ndarray, kinds: list[str]) -> Profiles:
        """Learns from the measures of labelled texts.

        Of each kind the text farthest from all profiles so far becomes the next, until none is farther than RADIUS; every text then goes to
        its nearest, and a profile is the mean of its texts. So profiles do not depend on the order of the texts.
        """
        col = {c: measures[:, i] for i, c in enumerate(MEASURES)}
        self.priors = np.array([col[s].sum() / max(col[b].sum(), 1) for s, b, _ in SHARES])
        d, chosen, owners = self.describe(measures), [], []
        label = np.array([KINDS.index(k) for k in kinds], int)
        for kind in range(len(KINDS)):
            own = d[label == kind]
            if not len(own):
                continue
            own = own[np.lexsort(own.T)]
            entropy = _entropy(own)
            least, home = np.full(len(own), np.inf), np.zeros(len(own), int)
            at = int(divergences(own, own.mean(0)[None], WEIGHTS).argmin())
            for k in range(len(own)):
                x = np.maximum((_entropy((own + own[at]) / 2) - (entropy + entropy[at]) / 2) @ WEIGHTS, 0)
                nearer = x < least
                least[nearer], home[nearer] = x[nearer], k
                least[at], home[at] = -1, k  # a text becomes a profile once
                at = int(least.argmax())
                if least[at] < RADIUS:
                    break
            for i in range(k + 1):
                chosen.append(own[home == i].mean(0))
                owners.append(kind)
        self.profiles = np.stack(chosen) if chosen else self.profiles
        self.kinds = np.array(owners, int)
        return self

    def kind_of(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The kind of each text, its distance from the nearest profile, and its function words' divergence from prose. Without labelled texts all are prose."""
        m = self.measure(texts)
        words = m[:, MEASURES.index("words")]
        prose = np.divide(m[:, MEASURES.index("function")], words, out=np.ones(len(m)), where=words > 0)
        if not len(self.kinds):
            return ["prose"] * len(texts), np.zeros(len(texts)), prose
        at, least = nearest(self.describe(m), self.profiles, WEIGHTS)
        return [KINDS[k] for k in self.kinds[at]], least, prose


# Texts that are junk by definition: markup or link addresses only.
MARKUP_ONLY = ("<p></p>", "<br/><hr/>&nbsp;", "<div><p></p></div><!-- - -->", "{{a}} {{b}}", "&nbsp;&nbsp;&amp;", "https://a.example/b", "www.a.example http://b.example/c?d=1")


def by_definition(common: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Texts, and their kinds, that need no labels: a common word, alone and with another, is prose, over and over it is junk, as is bare markup."""
    texts, kinds = list(MARKUP_ONLY), ["junk"] * len(MARKUP_ONLY)
    for lang in sorted(common):
        words = sorted(set(common[lang]))
        gap = "" if any(map(_KANA.match, words)) else " "
        for a, b in zip(words, words[1:] + words[:1], strict=True):
            texts += [a, a + gap + b + ".", gap.join([a] * 7)]
            kinds += ["prose", "prose", "junk"]
    return texts, kinds


def _with_definitions(profiles: Profiles, measures: np.ndarray, kinds: list[str], common: dict[str, list[str]]) -> tuple[np.ndarray, list[str]]:
    texts, more = by_definition(common) if kinds else ([], [])
    return np.concatenate([measures, profiles.measure(texts)]), [*kinds, *more]


def learn_from(texts: list[str], kinds: list[str], common: dict[str, list[str]]) -> Profiles:
    """Profiles from labelled texts at hand."""
    languages = Languages(common)
    profiles = Profiles(languages.fit(*languages.prose_part([t for t, k in zip(texts, kinds, strict=True) if k == "prose"])))
    return profiles.fit(*_with_definitions(profiles, profiles.measure(texts), kinds, common))


def _sliced(column: pa.Array) -> Iterable[tuple[int, list[str]]]:
    """Texts of bounded total size, with the place of the first."""
    texts = column.to_pylist()
    for start, n in slices([len(t) for t in texts]):
        yield start, texts[start : start + n]


def _prose_parts(languages: Languages):
    """Arrow batches of prose texts as rows (lang, at, n): counts of function words, and with lang -1 the known sequences, 64 bits a row."""

    def run(batches):
        for b in batches:
            for _, texts in _sliced(b.column(0)):
                counts, known = languages.prose_part(texts)
                lang, at, n = [], [], []
                for i, x in enumerate(languages.names):
                    some = np.flatnonzero(counts[x])
                    lang.append(np.full(len(some), i))
                    at.append(some)
                    n.append(counts[x][some].astype(np.int64))
                word, first = np.unique(known >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (known & 63).astype(np.uint64)), first) if len(known) else np.zeros(0, np.uint64)
                lang.append(np.full(len(word), -1))
                at.append(word)
                n.append(bits.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (lang, at, n)], names=["lang", "at", "n"])

    return run


def _measured(profiles: Profiles):
    def run(batches):
        for b in batches:
            for start, texts in _sliced(b.column(0)):
                m = profiles.measure(texts)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(MEASURES), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(start, len(texts)), rows], names=["kind", "measures"])

    return run


def learn(documents: DataFrame, labelled: DataFrame, common: dict[str, list[str]]) -> Profiles:
    """Profiles from the labelled documents, at most MAX_LABELLED of them.

    Texts stay with the executors; the driver gets counts of function words, the known sequences (at most 2**KNOWN_BITS bits) and the
    measures of the labelled texts. Labels of other kinds and labelled texts that are null are left out.
    """
    ids = labelled.select("doc_id", "kind").where(F.col("kind").isin(*KINDS)).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "kind").limit(MAX_LABELLED)
    text = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = materialize(text.join(F.broadcast(ids), "doc_id").select("text", "kind"), "labelled")  # ids: at most MAX_LABELLED
    languages = Languages(common)
    parts = rows.where("kind = 'prose'").select("text").mapInArrow(_prose_parts(languages), "lang bigint, at bigint, n bigint")
    got = parts.groupBy("lang", "at").agg(F.sum(F.when(F.col("lang") >= 0, F.col("n"))).alias("n"), F.bit_or("n").alias("bits")).toArrow()
    lang, at, n, bits = (got[c].to_numpy() for c in ("lang", "at", "n", "bits"))
    counts = {x: np.zeros(len(languages.columns[x]) + 1) for x in languages.names}
    for i, x in enumerate(languages.names):
        counts[x][at[lang == i]] = n[lang == i].astype(float)
    words, bits = at[lang == -1], bits[lang == -1].view(np.uint64)
    set_bits = (bits[:, None] >> np.arange(64, dtype=np.uint64)[None]) & np.uint64(1)
    row, bit = np.nonzero(set_bits)
    profiles = Profiles(languages.fit(counts, words[row] * 64 + bit))
    known = rows.mapInArrow(_measured(profiles), "kind string, measures array<double>").toArrow()
    measures = known["measures"].combine_chunks()
    flat = measures.flatten().to_numpy() if known.num_rows else np.zeros(0)
    return profiles.fit(*_with_definitions(profiles, flat.reshape(-1, len(MEASURES)), known["kind"].to_pylist(), common))


def _classify(profiles: Profiles):
    def run(batches):
        for b in batches:
            texts = [t if t is not None and _TEXT.search(t) else None for t in b.column(1).to_pylist()]
            at = [i for i, t in enumerate(texts) if t is not None]
            kinds, far, prose = np.full(len(texts), None, object), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            for start, n in slices([len(texts[i]) for i in at]):
                part = at[start : start + n]
                kinds[part], far[part], prose[part] = profiles.kind_of([texts[i] for i in part])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(far, from_pandas=True), pa.array(prose, from_pandas=True)], names=["doc_id", "kind", "distance", "prose_divergence"])

    return run


def text_kinds(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, kind, distance, prose_divergence) of every document.

    Null, empty and blank texts have null in all but doc_id. Without any profile every text is prose. Texts are read whole; only doc_id and text are read.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_classify(profiles), "doc_id bigint, kind string, distance double, prose_divergence double")


def text_statistics(documents: DataFrame, common_words: list[str]) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_share, ended_lines, common_share) of every document, all computed in the JVM.

    words: runs of letters, marks, digits and apostrophes, and single kana or han characters. symbol_share: of the characters that
    are not blank, those that are no letter, mark or digit. ended_lines: of the lines that are not blank, those ending in . ! ? or their like.
    common_share: of the words, those in common_words, for kana words the characters they cover. Shares without a base and
    the mean of no words are 0; a null text has 0 throughout.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = sorted({w for w in common_words if not re.match(r"[぀-ヿ㐀-鿿]", w)})
    kana = sorted({w for w in common_words if w not in spaced}, key=lambda w: (-len(w), w))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"[^\s\p{Z}]"))
    ended = F.filter(F.col("lines"), lambda x: x.rlike(r"""[.!?。！？…]["'”»)]*[\s\p{Z}]*$"""))
    common = F.filter(F.col("low"), lambda x: x.isin(spaced)) if spaced else F.array()
    covered = F.length(F.col("text")) - F.length(F.regexp_replace(F.col("text"), "|".join(kana), "")) if kana else F.lit(0)
    letters = F.length(F.regexp_replace(F.col("text"), r"[^\p{L}\p{M}\p{N}]", ""))
    shown = F.length(F.regexp_replace(F.col("text"), r"[\s\p{Z}\p{C}]", ""))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), words.alias("word_list"), lines.alias("lines"))
    d = d.withColumn("low", F.transform("word_list", F.lower)).withColumn("words", F.size("word_list").cast("bigint"))
    d = d.withColumn("letters", letters).withColumn("shown", shown)
    return d.select(
        "doc_id",
        "words",
        ratio(F.length(F.array_join("word_list", "")), F.col("words")).alias("mean_word_length"),
        F.when(F.col("shown") > 0, F.round(F.greatest(F.col("shown") - F.col("letters"), F.lit(0)) / F.col("shown"), 6)).otherwise(0.0).alias("symbol_share"),
        ratio(F.size(ended), F.size("lines")).alias("ended_lines"),
        ratio(F.size(common) + covered, F.col("words")).alias("common_share"),
    )


def text_statistics_sql(documents: str, common_words: str) -> str:
    """The same in SQL for DuckDB."""
    word = r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}\p{N}''’]+"
    kana = r"(SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) FROM (SELECT DISTINCT word FROM {t} WHERE regexp_matches(word, '^[\p{Han}\p{Hiragana}\p{Katakana}]')))".replace("{t}", common_words)
    ended = r"""[.!?。！？…]["''”»)]*[\s\p{Z}]*$"""
    return rf"""
WITH pat AS (SELECT coalesce({kana}, 'x{{0}}y') AS kana, (SELECT list(DISTINCT word) FROM {common_words}) AS common),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS word_list,
  list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^\s\p{{Z}}]')) AS lines,
  length(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')) AS letters, length(regexp_replace(text, '[\s\p{{Z}}\p{{C}}]', '', 'g')) AS shown FROM d),
s AS (SELECT *, len(word_list) AS n, length(text) - length(regexp_replace(text, kana, '', 'g')) AS covered,
  len(list_filter(word_list, lambda x: list_contains(common, lower(x)))) AS known FROM w, pat)
SELECT doc_id, CAST(n AS BIGINT) AS words,
  CASE WHEN n > 0 THEN round(length(array_to_string(word_list, '')) / n, 6) ELSE 0 END AS mean_word_length,
  CASE WHEN shown > 0 THEN round(greatest(shown - letters, 0) / shown, 6) ELSE 0 END AS symbol_share,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '{ended}'))) / len(lines), 6) ELSE 0 END AS ended_lines,
  CASE WHEN n > 0 THEN round((covered + (CASE WHEN n > 0 THEN len(list_filter(word_list, lambda x: list_contains(common, lower(x)) AND NOT regexp_matches(x, '^[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]'))) END)) / n, 6) ELSE 0 END AS common_share
FROM s"""
