"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained by maximum likelihood on a small labelled table written in this module, and decoded by Viterbi in
numpy batches. A name can only begin after a word that introduces one (CUES), with a capital. All other words without a
digit and without @ can only be labelled O, so a text decomposes exactly into the runs of words that need not be O; only
those runs are decoded, each with the shapes of its neighbours. So the field finds no names that nothing introduces, and no
places that are written in letters only. What it finds must also be possible: a card has 13 to 19 digits, parts of an
ip are at most 255, a phone has 7 to 15 digits. A card may fail Luhn: the pattern drops it, but a mistyped number where a
card's stands is personal data still, and its neighbours tell the field so. Counts of digits, lengths, dots and hyphens are features in bins, the last of them
open; words themselves are looked at whole.

Null text is empty and has no span. Positions are in code points, ends exclusive. Spans of the field that touch a span
of a pattern are dropped; spans of the patterns always stay. Every pattern looks at a text's characters a bounded number of
times, so very long runs of digits or separators cost no more than other text; a run of marked words takes about 100 bytes
of memory a word. Repeated rows get equal results, rows without an id too; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "id", "name")
#: Words after which a capital may begin a name.
CUES = ("mr", "mrs", "ms", "dr", "prof", "dear", "signed", "sincerely", "herr", "frau", "señor", "señora", "monsieur", "madame", "mme", "named", "called", "name is", "name ist", "m'appelle", "me llamo")
_LABELS = ("O", *KINDS)
_DIMENSIONS = 1 << 12
#: Words whose features are in memory at once.
_PART = 20_000

# --- exact patterns ------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
#: From the beginning of a run of digits, which is taken whole: a start inside a run fails where its beginning does.
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE_START = re.compile(r"\+[0-9]")
_PHONE_REST = re.compile(r"[\x20().0-9-]+")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Same matches as the pattern, found from each @ so that long runs of letters cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield "email", start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str):
    """Four parts at a time of each chain of numbers and single dots; parts beyond 255 drop the match."""
    for m in _CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str):
    """Each + and digit with what may follow, up to the last digit of it, without looking at any character twice."""
    m = _PHONE_START.search(text)
    while m:
        rest = _PHONE_REST.match(text, m.end())
        end = rest.end() if rest else m.end()
        while end > m.end() and not "0" <= text[end - 1] <= "9":
            end -= 1
        if end >= m.end() + 2:
            if 9 <= len(_DIGIT.findall(text, m.start(), end)) <= 15:
                yield "phone", m.start(), end
            m = _PHONE_START.search(text, end)
        else:  # what follows holds no + either
            m = _PHONE_START.search(text, rest.end() if rest else m.end())


def exact_spans(text: str) -> list[tuple[str, int, int]]:
    out = list(emails(text))
    if re.search("[0-9]", text):
        out += [*ips(text), *cards(text), *phones(text)]
    return out


# --- the labelled table --------------------------------------------------------------------------------------------

#: Sentences with slots; a slot's name is its label, names that start with _ are labelled O.
SENTENCES = (
    "write to {email} for details", "contact {email} or call {phone}", "my address is {email}", "mail {email}",
    "reach me at {phone}", "phone {phone}", "call {phone} after {_time}", "tel {phone} fax {phone}", "ring {phone} today",
    "the server {ip} is down", "from host {ip} on port {_number}", "blocked {ip} at {_time}", "ping {ip} again",
    "pay with {card}", "card {card} expires {_date}", "charged {card} for {_price}", "visa {card}",
    "ssn {id}", "social security number {id}", "account {id} of the client", "iban {id}", "passport {id}",
    "in {_year} there were {_number} of them", "version {_version} was out on {_date}", "it costs {_price} now",
    "see page {_number} and table {_number}", "at {_time} on {_date}", "about {_number} words in {_year}",
    "follow {_handle} there", "meet {_handle} and {_handle}", "commit {_hash} broke it", "key {_key} was rotated",
    "license version {_version}", "cc by {_version}", "token = {_hash} was set", "room {_number}", "the {_ordinal} of may",
    "order {_long} shipped on {_date}", "rows {_number} | {_number} | {_number}", "{_number} {_number} {_number} {_number}",
    "my name is {name} and i live here", "dear {name}, thanks", "mr {name} called {phone}", "mrs. {name} wrote", "dr {name} is in room {_number}", "signed {name}", "sincerely {name}", "prof {name} left at {_time}",
    "contact mr {name} at {email}", "herr {name} kommt", "frau {name} schreibt", "señor {name} vive", "madame {name} est", "named {name} and others", "dear {_title}, thanks", "sincerely {_title}", "signed {_title} in {_year}",
    "password={_hash} leaked", "route {_number} and {_code}", "part {_code} of {_number}", "isbn {_isbn}",
)


def _slot(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    x = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if kind == "name":
        return " ".join(w(1).upper() + w(r.randint(2, 8)) for _ in range(r.choice([1, 1, 2, 2, 2, 3])))
    if kind == "email":
        return f"{w(r.randint(2, 7))}{r.choice(['', '.', '_'])}{r.choice([w(4), d(2)])}@{w(r.randint(3, 8))}.{r.choice(['com', 'org', 'example.com', 'net'])}"
    if kind == "phone":
        return r.choice([f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}"])
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return r.choice([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"])
    if kind == "id":
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{w(2).upper()}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"{w(2).upper()}{d(18)}"])
    return {
        "_time": f"{d(2)}:{d(2)}", "_date": r.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}"]), "_year": f"{r.choice(['19', '20'])}{d(2)}",
        "_number": r.choice([d(1), d(2), d(3), d(4), d(5), f"{d(1)},{d(3)}", f"{d(2)}.{d(1)}", f"{d(2)}%"]), "_price": f"${d(2)}.{d(2)}", "_version": r.choice([f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", d(1)]),
        "_title": r.choice(["Sir", "Madam", "All", "Team", "Customer", "Sirs", "Friends", "Colleagues", "Yours"]),
        "_handle": f"@{w(6)}", "_hash": f'"{x(40)}"' if r.random() < 0.5 else x(r.choice([16, 18, 32, 40])), "_key": "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        "_ordinal": f"{r.randint(1, 31)}th", "_long": d(r.randint(6, 9)), "_code": f"{w(1).upper()}{d(2)}", "_isbn": f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
    }[kind]


def labelled_table(rows: int = 1200, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Words and labels of sentences made from SENTENCES."""
    r, out = random.Random(seed), []
    for k in range(rows):
        words, labels = [], []
        for part in SENTENCES[k % len(SENTENCES)].split(" "):
            m = re.search(r"\{(\w+)\}", part)
            if m:
                got = part.replace(m[0], _slot(m[1], r)).split(" ")
                words += got
                labels += ["O" if m[1][0] == "_" else m[1]] * len(got)
            else:
                words.append(part)
                labels.append("O")
        if r.random() < 0.5:
            words[-1] += r.choice([".", ",", "!"])
        out.append((words, labels))
    return out


# --- the field -----------------------------------------------------------------------------------------------------

_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:|", ".,;:!?\"'>]}|"


def _shape(word: str) -> str:
    out, last, n = [], "", 0
    for c in word + "\0":
        k = "d" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isupper() else c
        if k == last:
            n += 1
            continue
        if last:
            out.append(f"{last}{n if n <= 4 else '+'}" if last in "dDaA" else last)
        last, n = k, 1
    return "".join(out)


def _features(words: list[str], k: int) -> list[int]:
    from zlib import crc32

    word = words[k].lstrip(_TRIM_LEFT).rstrip(_TRIM_RIGHT)
    shape = _shape(word)
    digits = sum("0" <= c <= "9" for c in word)
    side = lambda w: "<>" if not w else "w" if not _MARK.search(w) else _shape(w.strip(_TRIM_LEFT + _TRIM_RIGHT))
    before, after = side(words[k - 1] if k else ""), side(words[k + 1] if k + 1 < len(words) else "")
    plain = words[k - 1].lower().strip(".:,=") if k and before == "w" else ""
    title = f"t{word.lower()}" if shape[:1] == "A" and not digits else "t"
    found = (
        title, f"s{shape}", f"c{re.sub('[0-9+]', '', shape)}", f"n{min(digits, 20)}", f"l{min(len(word), 24)}", f"@{'@' in word}{word[:1] == '@'}",
        f".{min(word.count('.'), 4)}-{min(word.count('-'), 4)}", f"p{before}", f"q{after}", f"k{plain}", f"f{word[:1] in '+('}{digits}", f"s{shape}p{before}", f"s{shape}q{after}",
    )
    return [crc32(f.encode()) % _DIMENSIONS for f in found]


_N_FEATURES = 13
_MARKED = re.compile(r"\S+")


def _capital(word: str) -> bool:
    return word.lstrip(_TRIM_LEFT)[:1].isupper()


def _introduces(words: list[str], k: int) -> bool:
    """Whether the words before k end in a cue."""
    last = words[k - 1].lower().strip(_TRIM_LEFT + _TRIM_RIGHT) if k else ""
    return last in _CUES or (k > 1 and f"{words[k - 2].lower().strip(_TRIM_LEFT + _TRIM_RIGHT)} {last}" in _CUES)


def _runs(words: list[str]) -> list[tuple[int, int]]:
    """Runs of words with a digit or @, and of capitals after a cue."""
    out, k = [], 0
    while k < len(words):
        j = k
        if _MARK.search(words[k]):
            while j < len(words) and _MARK.search(words[j]):
                j += 1
        elif _capital(words[k]) and _introduces(words, k):
            while j < len(words) and _capital(words[j]) and not _MARK.search(words[j]):
                j += 1
        if j > k:
            out.append((k, j))
        k = max(j, k + 1)
    return out


_CUES = frozenset(CUES)


class Field:
    """Weights of emissions by feature and label, and of transitions; the first and last step come from and go to O."""

    def __init__(self):
        self.emit = np.zeros((_DIMENSIONS, len(_LABELS)))
        self.move = np.zeros((len(_LABELS), len(_LABELS)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(-2)

    def fit(self, rows: list[tuple[list[str], list[str]]], steps: int = 60, rate: float = 0.3, penalty: float = 1e-3) -> Field:
        runs = [(words, labels, a, b) for words, labels in rows for a, b in _runs(words)]
        longest, many = max(b - a for _, _, a, b in runs), len(_LABELS)
        x = np.zeros((len(runs), longest, _N_FEATURES), np.int64)
        y, there = np.zeros((len(runs), longest), np.int64), np.zeros((len(runs), longest), bool)
        for i, (words, labels, a, b) in enumerate(runs):
            for t in range(a, b):
                x[i, t - a], y[i, t - a], there[i, t - a] = _features(words, t), _LABELS.index(labels[t]), True
        squares = [np.full(self.emit.shape, 1e-8), np.full(self.move.shape, 1e-8)]
        n, lengths = len(runs), there.sum(1)
        for _ in range(steps):
            e = self.scores(x)
            alpha, beta = np.zeros((n, longest, many)), np.zeros((n, longest, many))
            for t in range(longest):
                came = self.move[0][None] if t == 0 else _logsum(alpha[:, t - 1, :, None] + self.move[None], 1)
                alpha[:, t] = e[:, t] + came
            for t in range(longest - 1, -1, -1):
                last = (lengths - 1 == t)[:, None]
                goes = _logsum(self.move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2) if t + 1 < longest else 0
                beta[:, t] = np.where(last, self.move[:, 0][None], goes)
            total = _logsum(alpha[:, 0] + beta[:, 0], 1)
            share = np.exp(alpha + beta - total[:, None, None]) * there[..., None]
            g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
            step = (np.eye(many)[y] * there[..., None]) - share
            for f in range(_N_FEATURES):
                np.add.at(g_emit, x[there][:, f], step[there])
            for t in range(longest):
                on = there[:, t]
                if t == 0:
                    g_move[0] += step[on, 0].sum(0)
                else:
                    pair = np.exp(alpha[on, t - 1, :, None] + self.move[None] + (e[on, t] + beta[on, t])[:, None, :] - total[on, None, None])
                    np.add.at(g_move, (y[on, t - 1], y[on, t]), 1)
                    g_move -= pair.sum(0)
                g_move[:, 0] += step[lengths - 1 == t, t].sum(0)
            for w, g, s in ((self.emit, g_emit, squares[0]), (self.move, g_move, squares[1])):
                g = g / n - penalty * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return self

    def decode(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """Best labels of each sequence of feature rows."""
        return [x.tolist() for x in self.best([self.scores(np.array(x, np.int64)) for x in sequences])]

    def best(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each sequence of emission scores, by Viterbi over batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        k = 0
        while k < len(order):
            size = max(1, min(2048, 60_000 // max(1, len(scores[order[min(k + 2047, len(order) - 1)]]))))
            part = order[k : k + size]
            k += size
            lengths = np.array([len(scores[i]) for i in part])
            longest = int(lengths.max())
            e = np.zeros((len(part), longest, len(_LABELS)), np.float32)
            for row, i in enumerate(part):
                e[row, : lengths[row]] = scores[i]
            best = e[:, 0] + self.move[0]
            back = np.zeros((len(part), longest, len(_LABELS)), np.int8)
            ends = np.where((lengths == 1)[:, None], best, 0)
            for t in range(1, longest):
                ways = best[:, :, None] + self.move[None]
                back[:, t] = ways.argmax(1)
                best = ways.max(1) + e[:, t]
                ends = np.where((lengths - 1 == t)[:, None], best, ends)
            label = (ends + self.move[:, 0]).argmax(1)
            found = np.zeros((len(part), longest), np.int8)
            for t in range(longest - 1, -1, -1):
                inside = t < lengths
                found[:, t] = np.where(inside, label, 0)
                label = np.where(inside, back[np.arange(len(part)), t, label], label) if t else label
            for row, i in enumerate(part):
                out[i] = found[row, : lengths[row]].copy()
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def trained() -> Field:
    return Field().fit(labelled_table())


#: A cue's last word with what may stand around it, and white space; a capital must follow.
_CUE = re.compile(r"(?<!\S)[\"'<\[{(,;:|]*(?i:" + "|".join(sorted({re.escape(c.rpartition(" ")[2]) for c in CUES})) + r")[.,:;!?\"'>\]})|]*\s+(?=[^\sa-z0-9])")


def _names(text: str):
    """Runs of capitals after cues, as starts and ends."""
    at = 0
    for m in _CUE.finditer(text):
        if m.end() < at:
            continue
        two = _word_before(text, m.start())
        if not _introduces([two, m[0].strip()], 2):
            continue
        starts, ends = array("q"), array("q")
        word = _MARKED.match(text, m.end())
        while word and _capital(word[0]) and not _MARK.search(word[0]):
            starts.append(word.start())
            ends.append(word.end())
            at = word.end()
            space = _SPACE.match(text, at)
            word = _MARKED.match(text, space.end()) if space else None
        if starts:
            yield starts, ends


def _text_runs(text: str):
    """Runs of words with a digit or @, as starts and ends, found from the marks without splitting the whole text; then
    runs of names."""
    starts, ends, at = array("q"), array("q"), 0
    m = _MARK.search(text, 0)
    while m:
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _MARKED.match(text, start).end()
        if ends and not text[ends[-1] : start].isspace():
            yield starts, ends
            starts, ends = array("q"), array("q")
        starts.append(start)
        ends.append(end)
        at = end
        m = _MARK.search(text, end)
    if ends:
        yield starts, ends
    yield from _names(text)


_SPACE = re.compile(r"\s+")


def _word_before(text: str, at: int) -> str:
    while at > 0 and text[at - 1].isspace():
        at -= 1
    end = at
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return text[at:end]


_AFTER = re.compile(r"\s*(\S+)")


def _run_scores(text: str, starts, ends, field: Field) -> np.ndarray:
    """Emission scores of a run's words, a part of them at a time."""
    after, out, before = _AFTER.match(text, ends[-1]), [], _word_before(text, starts[0])
    for k in range(0, len(starts), _PART):
        words = [before, *[text[a:b] for a, b in zip(starts[k : k + _PART], ends[k : k + _PART], strict=True)]]
        n = len(words)
        if k + _PART < len(starts):
            words.append(text[starts[k + _PART] : ends[k + _PART]])
        else:
            words.append(after[1] if after else "")
        out.append(field.scores(np.array([_features(words, j) for j in range(1, n)], np.int64)).astype(np.float32))
        before = words[n - 1]
    return out[0] if len(out) == 1 else np.concatenate(out)


def _possible(kind: str, word: str) -> bool:
    digits = "".join(c for c in word if "0" <= c <= "9")
    if kind == "email":
        return "@" in word.strip("@") and "." in word
    if kind == "ip":
        return word.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in re.findall("[0-9]+", word)) and len(re.findall("[0-9]+", word)) == 4
    if kind == "card":
        return 13 <= len(digits) <= 19
    if kind == "name":
        return not digits and "@" not in word and _capital(word)
    return 7 <= len(digits) <= (15 if kind == "phone" else 34)


def added_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field labels, before those touching exact spans are dropped."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    held, size = [], 0

    def decoded() -> None:
        for (i, starts, ends, _), labels in zip(held, field.best([h[3] for h in held]), strict=True):
            text, cuts = texts[i], np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
            for t, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                kind = _LABELS[labels[t]]
                if kind == "O":
                    continue
                a, b = starts[t], ends[j - 1]
                while a < b and text[a] in _TRIM_LEFT:
                    a += 1
                while b > a and text[b - 1] in _TRIM_RIGHT:
                    b -= 1
                if _possible(kind, text[a:b]):
                    out[i].append((kind, a, b))
        held.clear()

    for i, text in enumerate(texts):
        for starts, ends in _text_runs(text):
            held.append((i, starts, ends, _run_scores(text, starts, ends, field)))
            size += len(starts)
            if size >= _PART:
                decoded()
                size = 0
    decoded()
    return out


def spans_of(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, exact) of each text, in order."""
    rows = []
    for t, more in zip(texts, added_spans(texts, field), strict=True):
        base = exact_spans(t)
        order = sorted((b, e) for _, b, e in base)
        starts, reach, most = [b for b, _ in order], [], -1
        for _, e in order:
            most = max(most, e)
            reach.append(most)
        free = []
        for k, b, e in more:
            j = bisect_left(starts, e)  # of those that begin before it ends, none may reach into it
            if j == 0 or reach[j - 1] <= b:
                free.append((k, b, e))
        rows.append(sorted([(KINDS.index(k), b, e, True) for k, b, e in base] + [(KINDS.index(k), b, e, False) for k, b, e in free]))
    return rows


def found(spark, text_col: str = "text", field: Field | None = None) -> Column:
    """An array of (kind, start, end, exact) by kind as in KINDS, then start."""
    shared = spark.sparkContext.broadcast(field or trained())

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,exact:boolean>>")
    def spans(text: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": b, "end": e, "exact": x} for k, b, e, x in row] for row in spans_of(text.to_pylist(), shared.value)]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _cut_out(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def cleaned(spark, text_col: str = "text", field: Field | None = None) -> Column:
    """The text with each span replaced by its kind in square brackets, upper case; overlapping spans become one. Finding
    and replacing are one function, so that a task needs one Python worker. Null stays null."""
    shared = spark.sparkContext.broadcast(field or trained())

    @F.arrow_udf("string")
    def replaced(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        found = spans_of([t or "" for t in texts], shared.value)
        return pa.array([_cut_out(t, [(KINDS[k], b, e) for k, b, e, _ in row]) if row else t for t, row in zip(texts, found, strict=True)], pa.string())

    return replaced(F.col(text_col).cast("string"))


def redacted(text_col: str = "text", spans_col: str = "spans") -> Column:
    """The same from a column of spans."""

    @F.arrow_udf("string")
    def replaced(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([_cut_out(t, [(x["kind"], x["start"], x["end"]) for x in found]) if t is not None and found else t for t, found in rows], pa.string())

    return replaced(F.col(text_col), F.col(spans_col))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    got = common.table(spark, sf_dir, "documents").select("doc_id", found(spark).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["exact"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return got.select(
        "doc_id", *[count(k) for k in KINDS[:4]],
        F.sha2(joined(F.filter("s", lambda s: s["exact"])).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )
