"""Personal data: four patterns, and a linear-chain conditional random field for the forms that they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers of regular form. The field labels tokens (runs of
letters, runs of digits, single signs) by their shapes and their neighbours' shapes, by cue words around and by the numbers
they belong to. It is trained from a small labelled table of marked rows; ``labelled_rows`` makes the one used here by a rule from
a seed, with the forms that patterns miss (phones without a plus, addresses written with ``(at)`` or in words, cards with
other separators, IPv6) and with numbers that are nobody's (dates, versions, prices, order numbers). No row of the table
comes from the documents.

A text is searched wherever a digit, an ``@`` or a written ``at`` / ``dot`` stands, with ``REACH`` bytes around; such
regions are decoded by Viterbi, many at a time, in blocks of ``BLOCK`` tokens whose ``MARGIN`` first and last tokens only give
context. A decoded span counts if it can be of its kind (``plausible``) and overlaps no pattern finding; its kind is
``crf_email`` and so on.

Defined cases: a null or empty text has no findings; equal rows have equal findings; an empty table gives an empty
result; other columns pass, also one named like the new one. Positions count code points and ends are exclusive;
patterns take time linear in the text. An empty labelled table leaves the patterns alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.common import column, documents, free_name
from custlens.llm.textbytes import buffers, slices

# The patterns' characters, and the digits that a number of a kind has.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_OCTET = (12, 19), (9, 15), 255
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + tuple(f"crf_{k}" for k in BASE)

SPANS = "struct<kinds:array<string>,starts:array<int>,ends:array<int>>"
REACH, BLOCK, MARGIN = 64, 128, 16
TABLE_ROWS, TABLE_SEED = 1500, 17
STEPS, RATE, RIDGE = 80, 0.08, 2e-5


# -- patterns -------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match ends its first part at an ``@``, so only the run before each of them is looked at."""
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and LOCAL.match(text, first - 1):
            first -= 1
        found = DOMAIN.match(text, at + 1) if first < at else None
        if found:
            yield first, found.end()
            end = found.end()
        else:
            end = max(end, at)
        at = text.find("@", max(end, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= MOST_OCTET


def sure(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of what the patterns find, in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m.group()) <= PHONE_DIGITS[1]:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# -- tokens and features --------------------------------------------------------------------------------------

GAP, LETTER, DIGIT, SIGN = range(4)
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[:33] = GAP
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_CLASS[48:58] = DIGIT
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER_SIZE = np.array([0, 0, 1, 2, 3, 3, 3, 4])
_DIGIT_SIZE = np.array([0, 0, 1, 2, 3, 4, 4, 4, 5, 5, 5, 5, 6, 7, 7, 7, 7, 8, 8, 8, 9])
# What may stand inside a written number.
_LINK = np.zeros(256, dtype=bool)
_LINK[[*b"()-./: "]] = True
CUES = (
    "at dot com org net de mail email e phone tel call fax mobile cell contact reach number no "
    "card visa credit debit account paid pay ip ipv host server address addr ping login from "
    "order invoice version isbn page chapter section price total year date time ref id item"
).split()
_CUE = {word.encode(): i + 1 for i, word in enumerate(CUES)}
_ANCHOR_WORD = re.compile(rb"(?<![A-Za-z])(?:dot|DOT|Dot)(?![A-Za-z])|[(\[{] ?(?:at|AT) ?[)\]}]")
_ANCHOR = np.zeros(256, dtype=bool)
_ANCHOR[[*range(48, 58), 64]] = True
TEMPLATES = 17


@dataclass
class Tokens:
    """Tokens of a buffer: where they begin and end, and the sequence each belongs to."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray


def tokens(raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> Tokens:
    """Tokens of the ranges ``begins`` to ``stops`` (in order, apart), which are the sequences."""
    sizes = stops - begins
    own = np.repeat(np.arange(len(begins)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    kind = _CLASS[raw[at]]
    edge = np.ones(len(at) + 1, dtype=bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == SIGN) | (own[1:] != own[:-1])
    cuts = np.flatnonzero(edge)
    firsts, lasts = cuts[:-1], cuts[1:]
    real = kind[firsts] != GAP
    firsts, lasts = firsts[real], lasts[real]
    return Tokens(raw, at[firsts], at[lasts - 1] + 1, own[firsts])


def features(t: Tokens) -> np.ndarray:
    """``TEMPLATES`` numbers for each token, each telling a template and what it sees."""
    n = len(t.starts)
    raw, size = t.raw, t.ends - t.starts
    kind = _CLASS[raw[t.starts]]
    uppers = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    upper = uppers[t.ends] - uppers[t.starts]
    case = np.where(upper == 0, 0, np.where(upper == size, 1, np.where((upper == 1) & (_UPPER[raw[t.starts]] == 1), 2, 3)))
    shape = np.where(
        kind == LETTER,
        1 + case * 5 + _LETTER_SIZE[np.minimum(size, 7)],
        np.where(kind == DIGIT, 30 + _DIGIT_SIZE[np.minimum(size, 20)], 64 + raw[t.starts].astype(np.int64)),
    )
    same = np.zeros(n + 1, dtype=bool)  # the token has one before it in its sequence
    same[1:n] = t.owner[1:] == t.owner[:-1]
    near = np.zeros(n + 1, np.int64)  # 0 apart, 1 one blank between, 2 joined
    near[1:n] = np.where(t.starts[1:] == t.ends[:-1], 2, np.where((t.starts[1:] == t.ends[:-1] + 1) & (raw[t.ends[:-1]] == 32), 1, 0))
    near *= same

    def shifted(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if abs(k) < n:
            if k < 0:
                out[-k:] = np.where(t.owner[-k:] == t.owner[:k], values[:k], 0)
            elif k > 0:
                out[:-k] = np.where(t.owner[k:] == t.owner[:-k], values[k:], 0)
        return out

    cue = np.zeros(n, np.int64)
    words = np.flatnonzero((kind == LETTER) & (size <= 9))
    text = raw.tobytes()
    for i, a, b in zip(words.tolist(), t.starts[words].tolist(), t.ends[words].tolist()):
        cue[i] = _CUE.get(text[a:b].lower(), 0)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in (4, 3, 2, 1):  # the nearest wins
        far, ahead = shifted(cue, -k), shifted(cue, k)
        before, after = np.where(far > 0, far, before), np.where(ahead > 0, ahead, after)
    # Numbers: digit runs and what links them, without a wide gap.
    part = (kind == DIGIT) | ((kind == SIGN) & _LINK[raw[t.starts]])
    begins = part & ~(np.concatenate([[False], part[:-1]]) & (near[:n] > 0))
    group = np.cumsum(begins) * part
    digits = np.bincount(group, weights=np.where(part & (kind == DIGIT), size, 0), minlength=1)
    runs = np.bincount(group, weights=part & (kind == DIGIT), minlength=1)
    digits[0] = runs[0] = 0
    digits, runs = np.minimum(digits[group], 25).astype(np.int64), np.minimum(runs[group], 9).astype(np.int64)
    value = np.zeros(n, np.int64)
    short = np.flatnonzero((kind == DIGIT) & (size <= 4))
    numbers = np.zeros(len(short), np.int64)
    for k in range(4):
        inside = k < size[short]
        numbers = np.where(inside, numbers * 10 + raw[np.minimum(t.starts[short] + k, len(raw) - 1)] - 48, numbers)
    value[short] = np.where(numbers <= 255, 1, np.where((numbers >= 1900) & (numbers < 2100), 2, 3))
    left, right, join, follow = shifted(shape, -1), shifted(shape, 1), near[:n], near[1:] * same[1:]
    seen = [
        shape,
        left * 4 + join,
        right * 4 + follow,
        shifted(shape, -2),
        shifted(shape, 2),
        (left * 512 + shape) * 4 + join,
        (shape * 512 + right) * 4 + follow,
        ((left * 512 + shape) * 512 + right) * 16 + join * 4 + follow,
        cue,
        before * 2 + (kind == DIGIT),
        after * 2 + (kind == DIGIT),
        digits * 512 + shape,
        runs * 32 + digits,
        value * 512 + shape,
        np.where(digits > 0, before * 32 + digits, 0),
        shifted(shape, -3) * 512 + left,
        right * 512 + shifted(shape, 2),
    ]
    return np.stack(seen, axis=1) * TEMPLATES + np.arange(TEMPLATES)


# -- the field ------------------------------------------------------------------------------------------------


def _states() -> list[str]:
    return ["O", *(f"{p}-{k}" for k in BASE for p in "BI")]


STATES = _states()
N = len(STATES)
# An inner state follows its own beginning or itself only.
ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in STATES] for a in STATES])
FIRST_ALLOWED = np.array([not s.startswith("I") for s in STATES])
NEVER = -1e9


@dataclass
class Field:
    """Weights of known features by state, and of pairs of states."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, N)))
    steps: np.ndarray = field(default_factory=lambda: np.where(ALLOWED, 0.0, NEVER))

    def rows(self, seen: np.ndarray) -> np.ndarray:
        """Row of ``weights`` of each feature; unknown ones have the last row, which is 0."""
        if not len(self.known):
            return np.zeros(seen.shape, np.int64)
        place = np.minimum(np.searchsorted(self.known, seen), len(self.known) - 1)
        return np.where(self.known[place] == seen, place, len(self.known))

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), N))
        for k in range(rows.shape[1]):
            out += self.weights[rows[:, k]]
        return out

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, state and pair probabilities of padded sequences ``(tokens, sequences, states)``."""
        length, n, _ = emissions.shape
        tops = emissions.max(axis=2, keepdims=True)
        weights, moves = np.exp(emissions - tops), np.exp(self.steps)
        inside = np.arange(length)[:, None] < lengths
        ahead, scales = np.zeros_like(emissions), np.ones((length, n))
        for i in range(length):
            before = ahead[i - 1] @ moves if i else FIRST_ALLOWED.astype(float)
            ahead[i] = before * weights[i]
            scales[i] = ahead[i].sum(axis=1)
            ahead[i] /= scales[i][:, None]
        total = ((np.log(scales) + tops[:, :, 0]) * inside).sum(axis=0)
        back, pairs = np.ones((n, N)), np.zeros((N, N))
        states = np.zeros_like(emissions)
        for i in range(length - 1, -1, -1):
            states[i] = ahead[i] * back * inside[i][:, None]
            if i:
                ready = weights[i] * back / scales[i][:, None]
                pairs += (ahead[i - 1].T @ (ready * inside[i][:, None])) * moves
                back = np.where(inside[i][:, None], ready @ moves.T, 1.0)
        return total, states, pairs

    def fit(self, seen: np.ndarray, states: np.ndarray, lengths: np.ndarray, steps: int = STEPS, rate: float = RATE) -> None:
        """Adam on the penalised negative log likelihood. ``seen`` and ``states`` hold the tokens of all sequences in turn."""
        self.known = np.unique(seen)
        self.weights = np.zeros((len(self.known) + 1, N))
        rows = self.rows(seen)
        n, length = len(lengths), int(lengths.max())
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        home = np.repeat(np.arange(n), lengths)
        place = np.arange(len(states)) - firsts[home]
        truth = np.eye(N)[states]
        follows = np.ones(len(states), dtype=bool)
        follows[firsts] = False
        at = np.flatnonzero(follows)
        true_pairs = np.zeros((N, N))
        np.add.at(true_pairs, (states[at - 1], states[at]), 1)
        # Tokens by feature: every known feature occurs.
        order = np.argsort(rows, axis=None, kind="stable")
        token, cuts = order // rows.shape[1], np.searchsorted(rows.ravel()[order], np.arange(len(self.known)))
        moments = [np.zeros_like(x) for x in (self.weights, self.weights, self.steps, self.steps)]
        for step in range(1, steps + 1):
            emissions = np.zeros((length, n, N))
            emissions[place, home] = self.emissions(rows)
            _, chances, pairs = self.marginals(emissions, lengths)
            error = (chances[place, home] - truth) / n
            grad = RIDGE * self.weights
            grad[:-1] += np.add.reduceat(error[token], cuts)
            for x, g, k in ((self.weights, grad, 0), (self.steps, (pairs - true_pairs) / n * ALLOWED, 2)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
                x -= rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest states of padded sequences, by Viterbi over all of them at once."""
        n, length, _ = emissions.shape
        best = emissions[:, 0] + np.where(FIRST_ALLOWED, 0, NEVER)
        origins = np.zeros((n, length, N), np.int8)
        for i in range(1, length):
            paths = best[:, :, None] + self.steps
            origin = paths.argmax(axis=1)
            moved = np.take_along_axis(paths, origin[:, None, :], 1)[:, 0] + emissions[:, i]
            open_ = (i < lengths)[:, None]
            best = np.where(open_, moved, best)
            origins[:, i] = np.where(open_, origin, np.arange(N))
        out = np.zeros((n, length), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for i in range(length - 1, 0, -1):
            out[:, i - 1] = np.take_along_axis(origins[:, i], out[:, i, None].astype(np.int64), 1)[:, 0]
        return out


def label(model: Field, t: Tokens) -> np.ndarray:
    """State of each token: sequences are decoded in blocks that overlap by ``2 * MARGIN``, of which the middle counts."""
    n = len(t.starts)
    if not n:
        return np.zeros(0, np.int8)
    emissions = model.emissions(model.rows(features(t)))
    firsts = np.flatnonzero(np.concatenate([[True], t.owner[1:] != t.owner[:-1]]))
    sizes = np.diff(np.append(firsts, n))
    hop = BLOCK - 2 * MARGIN
    parts = np.maximum(1, -(-(sizes - 2 * MARGIN) // hop))
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, size = np.repeat(firsts, parts), np.repeat(sizes, parts)
    begin = first + turn * hop
    length = np.minimum(BLOCK, first + size - begin)
    states = np.zeros(n, np.int8)
    order = np.argsort(length, kind="stable")
    for lo in range(0, len(order), 1024):
        block = order[lo : lo + 1024]
        at = begin[block][:, None] + np.arange(length[block].max())
        inside = np.arange(at.shape[1]) < length[block][:, None]
        padded = emissions[np.where(inside, at, begin[block][:, None])]
        got = model.decode(padded, length[block])
        skip = np.where(turn[block] > 0, MARGIN, 0)[:, None]
        middle = inside & (np.arange(at.shape[1]) >= skip)
        # The next block takes over where its own middle begins.
        more = (turn[block] + 1 < np.repeat(parts, parts)[block])[:, None]
        middle &= ~more | (np.arange(at.shape[1]) < BLOCK - MARGIN)
        states[at[middle]] = got[middle]
    return states


def spans(states: np.ndarray, t: Tokens) -> Iterator[tuple[int, int, int, int]]:
    """Sequence, kind, first byte and end of each labelled run of tokens."""
    kinds = (states.astype(np.int64) + 1) // 2
    edge = np.ones(len(kinds) + 1, dtype=bool)
    edge[1:-1] = (states[1:] % 2 == 1) | (kinds[1:] != kinds[:-1]) | (t.owner[1:] != t.owner[:-1])
    edges = np.flatnonzero(edge)
    # A run that ends inside a word takes all of it.
    word = _CLASS[t.raw[t.starts]] != SIGN
    glued = np.append((t.starts[1:] == t.ends[:-1]) & word[1:] & word[:-1] & (t.owner[1:] == t.owner[:-1]), False)
    done = 0
    for i, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if kinds[i] and i >= done:
            kind = int(kinds[i]) - 1
            while i > done and glued[i - 1]:
                i -= 1
            while glued[end - 1]:
                end += 1
            done = end
            yield int(t.owner[i]), kind, int(t.starts[i]), int(t.ends[end - 1])


_AT = rb"(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?| at )"
_ADDRESS = re.compile(rb"(?:[A-Za-z0-9_%+-]+(?:\.| dot ))*[A-Za-z0-9_%+-]+" + _AT + rb"[A-Za-z0-9].{2,}", re.I | re.S)
_IN_LOCAL = np.array([bool(LOCAL.match(chr(c))) for c in range(128)] + [False] * 128)
_NUMBER = {
    1: re.compile(rb"[0-9a-f:].*[0-9a-f:]", re.I | re.S),
    2: re.compile(rb"[0-9].*[0-9]", re.S),
    3: re.compile(rb"(?:\+|\()?[0-9].*[0-9]", re.S),
}


def plausible(kind: int, text: bytes) -> tuple[int, int] | None:
    """The part of a labelled span that can be of its kind, without signs and words at its borders."""
    m = (_NUMBER[kind] if kind else _ADDRESS).search(text)
    if not m:
        return None
    digits = [chr(c) for c in m.group() if 48 <= c < 58]
    if kind == 1 and (not digits or len(re.findall(rb"[.:]|\bdot\b", m.group())) < 2):
        return None
    if kind == 2 and not (CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn("".join(digits))):
        return None
    if kind == 3 and not 7 <= len(digits) <= PHONE_DIGITS[1]:
        return None
    return m.span()


# -- the labelled table ---------------------------------------------------------------------------------------

_NAMES = "jane doe mario rossi anna kim lee peter hans olga info sales bob may".split()
_HOSTS = "example mail7 acme shop uni-bonn webmail contoso mail3.example big-co".split()
_ENDS = "com org net de fr es co.uk".split()
_FILLER = (
    "the of and in to with on for by is was have new old form went there und der die das ist von le la les des est "
    "que el los una con para or as be this that it red house water people Before After They When Also"
).split()


def _values(rng: np.random.Generator) -> list[str]:
    """One example of every form, marked as ``<kind:text>``; an unmarked one is nobody's."""
    pick = lambda *xs: str(xs[rng.integers(len(xs))])
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    nz = lambda n: str(rng.integers(1, 10)) + d(n - 1)
    octets = lambda sep: sep.join(str(x) for x in rng.integers(0, 256, 4))
    name, host, end = pick(*_NAMES), pick(*_HOSTS), pick(*_ENDS)
    if rng.random() < 0.6:
        name += pick("", ".", "_", "-") + pick(*_NAMES)
    start = nz(15)
    right = next(start + str(c) for c in range(10) if luhn(start + str(c)))
    grouped = lambda sep: sep.join(right[i : i + 4] for i in range(0, 16, 4))
    six = ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8))
    at, dot = pick(" (at) ", " [at] ", "(at)", "[at]", " {at} "), pick(".", ".", " dot ", " (dot) ")
    call = pick("call", "tel", "phone", "Tel.", "tel:", "fax", "mobile", "reach us at", "call me on", "Phone:", "contact")
    pay = pick("card", "visa", "credit card", "paid with card", "card number", "debit card no", "Visa:")
    net = pick("ip", "host", "server", "IP:", "ping", "address", "login from")
    return [
        f"<phone:({nz(3)}) {nz(3)}-{d(4)}>",
        f"<phone:({nz(3)}) {nz(3)}-{d(4)}>",
        f"<phone:{nz(3)}-{nz(3)}-{d(4)}>",
        f"<phone:{nz(3)}.{nz(3)}.{d(4)}>",
        f"<phone:+{nz(1)} ({d(3)}) {d(3)}-{d(4)}>",
        f"<phone:00{nz(2)} {nz(2)} {d(3)} {d(4)}>",
        f"{call} <phone:{nz(3)} {d(4)}>",
        f"{call} <phone:{nz(3)}-{d(4)}>",
        f"{call} <phone:0{nz(3)} {d(6)}>",
        f"{call} <phone:0{nz(2)}/{d(7)}>",
        f"{call} <phone:{nz(10)}>",
        f"{call} <phone:{nz(3)} {nz(3)} {d(4)}>",
        f"{call} <phone:0{nz(1)} {d(2)} {d(2)} {d(2)} {d(2)}>",
        f"<email:{name}{at}{host}{dot}{end}>",
        f"<email:{name}{at}{host}{dot}{end}>",
        f"<email:{name}{d(2)}{at}{host}{dot}{end}>",
        f"<email:{pick(*_NAMES)} dot {pick(*_NAMES)} at {host.split('.')[0]} dot {end.split('.')[0]}>",
        f"<email:{name} at {host.split('.')[0]} dot {end.split('.')[0]}>",
        f"{pick('mail', 'email', 'e-mail', 'contact')} <email:{name}@{pick('localhost', 'intranet', 'mailhost')}>",
        f"<email:{name} @ {host}.{end}>",
        f"<email:{name}{d(2)}@{host}.{end}>",
        f"<card:{grouped('.')}>",
        f"<card:{grouped('/')}>",
        f"<card:{grouped('  ')}>",
        f"<card:{grouped(' - ')}>",
        f"<card:{grouped(' ')}>",
        f"<card:{grouped('-')}>",
        f"{pay} <card:{right}>",
        f"<card:{right}>",
        f"<ip:{six}>",
        f"<ip:{':'.join(six.split(':')[:4])}::{six.split(':')[0]}>",
        f"<ip:{octets(' . ')}>",
        f"{net} <ip:{octets(' dot ')}>",
        f"<ip:{octets('[.]')}>",
        f"<ip:{octets('.')}>",
        # Numbers and signs that are nobody's.
        nz(int(rng.integers(1, 15))),
        f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        f"{rng.integers(10, 29)}.{rng.integers(10, 13)}.{rng.integers(1900, 2100)}",
        f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1900, 2100)}",
        f"{rng.integers(0, 24)}:{d(1)}{d(1)}:{d(1)}{d(1)}",
        f"{rng.integers(1900, 2100)}-{rng.integers(1900, 2100)}",
        f"{pick('version', 'v', 'release', '')} {rng.integers(0, 20)}.{rng.integers(0, 20)}{pick('', '.', '.1', '.0.1')}",
        f"${nz(1)},{d(3)}.{d(2)}",
        f"{nz(3)},{d(3)},{d(3)}",
        f"{nz(2)} {d(3)} {d(3)}",
        f"{pick('order', 'invoice', 'ref', 'item', 'id', 'No.')} {pick('', '#')}{nz(int(rng.integers(5, 13)))}",
        f"ISBN 978-{nz(1)}-{d(2)}-{d(6)}-{d(1)}",
        f"{pick('page', 'chapter', 'section')} {nz(2)}.{nz(1)}",
        f"{nz(2)}%",
        f"{nz(1)} + {nz(1)} = {nz(2)}",
        f"{nz(1)}. {pick(*_FILLER)} {nz(1)}. {pick(*_FILLER)}",
        f"{nz(1)}-{nz(1)}",
        f"@{pick(*_NAMES)}",
        f"{nz(2)} @ {nz(1)}.{d(2)}",
        f"{pick('token', 'secret', 'key')} = \"{rng.bytes(16).hex()}\"",
        f"{rng.bytes(20).hex()}",
        f"AKIA{rng.bytes(8).hex().upper()}",
        f"meet {pick('me', 'us')} at {nz(2)} dot {pick(*_FILLER)}",
        f"the dot {pick(*_FILLER)} at the {pick(*_FILLER)} {nz(2)}",
        f"| {nz(3)} | {nz(4)} | {nz(2)} |",
        f"{pick(*_FILLER)}{nz(1)} {pick(*_FILLER)}-{nz(2)}",
    ]


def labelled_rows(rows: int = TABLE_ROWS, seed: int = TABLE_SEED) -> list[str]:
    """Marked texts: the personal parts of each stand in ``<kind:...>``."""
    rng = np.random.default_rng(seed)

    def word() -> str:
        if rng.random() < 0.5:
            return _FILLER[rng.integers(len(_FILLER))]
        made = "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10)))
        return made if rng.random() < 0.8 else made.capitalize() if rng.random() < 0.7 else made.upper()

    def some() -> str:
        ends = ["", "", "", "", ",", ".", "!!", "%%%"]
        return " ".join(word() + ends[rng.integers(len(ends))] for _ in range(rng.integers(0, 7)))

    out = []
    while len(out) < rows:
        for value in _values(rng):
            tail = [" ", " ", " ", ". ", ", ", "\n", "!! ", "### ", ") "][rng.integers(9)]
            out.append(f"{some()} {value}{tail}{some()}".strip())
    return out[:rows]


_MARK = re.compile(rb"<(" + "|".join(BASE).encode() + rb"):([^<>]*)>")


def unmarked(row: str) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text without its marks, and (first byte, kind, end) of each marked part."""
    text, found, at, raw = b"", [], 0, row.encode()
    for m in _MARK.finditer(raw):
        text += raw[at : m.start()]
        found.append((len(text), BASE.index(m.group(1).decode()), len(text) + len(m.group(2))))
        text += m.group(2)
        at = m.end()
    return text + raw[at:], found


@lru_cache(maxsize=4)
def train(rows: tuple[str, ...], steps: int = STEPS) -> Field:
    """The field that marked rows teach; equal rows give the same one."""
    model = Field()
    parsed = [unmarked(row) for row in rows]
    if not any(text.strip() for text, _ in parsed):
        return model
    raw = np.frombuffer(b"".join(text for text, _ in parsed), np.uint8)
    places = np.concatenate([[0], np.cumsum([len(text) for text, _ in parsed])])
    t = tokens(raw, places[:-1], places[1:])
    states = np.zeros(len(t.starts), np.int64)
    for (_, found), place in zip(parsed, places):
        for a, kind, b in found:
            inside = np.flatnonzero((t.starts >= place + a) & (t.ends <= place + b))
            states[inside] = 2 * kind + 2
            states[inside[:1]] = 2 * kind + 1
    _, lengths = np.unique(t.owner, return_counts=True)
    model.fit(features(t), states, lengths, steps)
    return model


def labelled_table(spark: SparkSession, rows: int = TABLE_ROWS, seed: int = TABLE_SEED) -> DataFrame:
    return spark.createDataFrame([(row,) for row in labelled_rows(rows, seed)], "marked string")


# -- scan -----------------------------------------------------------------------------------------------------


def regions(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of bytes around what may be personal data, cut at whole words and inside one text each."""
    text = raw.tobytes()
    anchors = np.flatnonzero(_ANCHOR[raw])
    spelled = [m.start() for m in _ANCHOR_WORD.finditer(text)]
    anchors = np.sort(np.concatenate([anchors, np.array(spelled, np.int64)]))
    if not len(anchors):
        return anchors, anchors
    home = np.searchsorted(places, anchors, side="right") - 1
    lows, highs = np.maximum(anchors - REACH, places[home]), np.minimum(anchors + REACH, places[home + 1])
    new = np.concatenate([[True], (lows[1:] > highs[:-1]) | (home[1:] != home[:-1])])
    firsts = np.flatnonzero(new)
    lows, highs = lows[firsts], highs[np.append(firsts[1:], len(anchors)) - 1]
    # A word at a border is left out unless the border is the text's own; an anchor is further away than that.
    blanks = np.flatnonzero(raw <= 32)
    home = home[firsts]
    after = np.searchsorted(blanks, lows)
    before = np.searchsorted(blanks, highs) - 1
    inner_low = np.append(blanks, len(raw))[after]
    inner_high = np.append(blanks, 0)[before] if len(blanks) else np.zeros(len(lows), np.int64)
    low_ok = (lows > places[home]) & (inner_low < np.minimum(lows + REACH, highs))
    high_ok = (highs < places[home + 1]) & (before >= 0) & (inner_high > np.maximum(highs - REACH, lows))
    return np.where(low_ok, inner_low, lows), np.where(high_ok, inner_high, highs)


def extra(model: Field, raw: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, first byte in it, kind and end of what the field finds in texts."""
    lows, highs = regions(raw, places)
    if not len(lows):
        return
    t = tokens(raw, lows, highs)
    homes = np.searchsorted(places, lows, side="right") - 1
    for region, kind, a, b in spans(label(model, t), t):
        part = plausible(kind, raw[a:b].tobytes())
        if part:
            home = int(homes[region])
            begin, end = a + part[0], a + part[1]
            # The first part of an address reaches back to a blank or another sign, within the region.
            while kind == 0 and begin > lows[region] and _IN_LOCAL[raw[begin - 1]]:
                begin -= 1
            yield home, begin - int(places[home]), kind, end - int(places[home])


def scan(model: Field, texts: pa.Array) -> pa.Array:
    """Findings of each text, by start and then by kind."""
    raw, places = buffers(texts)
    out = []
    for lo, hi in slices(places):
        part, own = raw[places[lo] : places[hi]], places[lo : hi + 1] - places[lo]
        more: dict[int, list] = {}
        if len(model.known):
            for row, a, kind, b in extra(model, part, own):
                more.setdefault(row, []).append((a, kind, b))
        # No pattern matches without a digit or an @.
        marks = np.concatenate([[0], np.cumsum(_ANCHOR[part], dtype=np.int64)])
        marked = (marks[own[1:]] > marks[own[:-1]]).tolist()
        for row in range(hi - lo):
            if not marked[row] and row not in more:
                out.append({"kinds": [], "starts": [], "ends": []})
                continue
            data = part[own[row] : own[row + 1]].tobytes()
            found = sure(data.decode())
            if row in more:
                points = np.cumsum((np.frombuffer(data + b"\0", np.uint8) & 0xC0) != 0x80) - 1
                firsts = np.array([a for a, _, _ in found], np.int64)
                lasts = np.maximum.accumulate(np.array([b for _, _, b in found], np.int64))
                for a, kind, b in more[row]:
                    a, b = int(points[a]), int(points[b])
                    at = int(np.searchsorted(firsts, b))
                    if not at or lasts[at - 1] <= a:
                        found.append((a, len(BASE) + kind, b))
                found.sort()
            out.append(
                {
                    "kinds": [KINDS[k] for _, k, _ in found],
                    "starts": [a for a, _, _ in found],
                    "ends": [b for _, _, b in found],
                }
            )
    ints = pa.list_(pa.int32())
    return pa.array(out, pa.struct([("kinds", pa.list_(pa.string())), ("starts", ints), ("ends", ints)]))


def _scanner(shared):
    def found(texts: pa.Array) -> pa.Array:
        return scan(shared.value, texts)

    return arrow_udf(found, SPANS)


def find(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: ``kinds``, ``starts`` and ``ends`` of the findings.

    ``labelled`` is a small table with a string column ``marked``; the driver trains on all its rows.
    """
    spark = docs.sparkSession
    table = labelled_table(spark) if labelled is None else labelled
    rows = sorted(r[0] for r in table.select("marked").collect() if r[0])
    name = free_name(docs, "personal")
    return docs.withColumn(name, _scanner(spark.sparkContext.broadcast(train(tuple(rows))))(column(docs, text))), name


def _masked(texts: pa.Array, kinds: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, names, firsts, lasts in zip(texts.to_pylist(), kinds.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        if text is not None and names:
            kept, at = [], 0
            for name, first, last in zip(names, firsts, lasts):
                if first >= at:
                    kept += [text[at:first], f"[{name.removeprefix('crf_').upper()}]"]
                at = max(at, last)
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with the name of its kind in place of each finding; of findings that overlap, the first names it."""
    found, name = find(docs, text, labelled)
    hits = F.col(name)
    masked = arrow_udf(_masked, "string")(column(docs, text), hits["kinds"], hits["starts"], hits["ends"])
    clean = F.when(F.size(hits["starts"]) > 0, masked).otherwise(column(docs, text))
    return found.select(*(column(docs, c) if c != text else clean.alias(text) for c in docs.columns))


def op11_personal_data(spark, folder):
    found, name = find(documents(spark, folder).select("doc_id", "text"))
    rows = found.select("doc_id", F.arrays_zip(*(F.col(f"{name}.{p}") for p in ("kinds", "starts", "ends"))).alias("hits"))
    listed = lambda hits: F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kinds"], h["starts"], h["ends"])), ",")
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kinds"] == kind)).cast("long")
    base = F.filter("hits", lambda h: h["kinds"].isin(*BASE))
    return rows.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("hits")).alias("spans"),
    )
