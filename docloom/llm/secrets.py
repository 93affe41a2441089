"""Secret scans: fixed patterns and a linear-chain conditional random field.

The fixed patterns give the base spans.  The field adds spans: it tags every
token of a text as outside, begin or inside of a secret, from the token's
shape, the look of the run that it stands in, its neighbouring words and
features of the whole text, and is decoded by Viterbi.  It is trained here, by
stochastic gradient on the exact log-likelihood (forward and backward sums),
over lines that a seeded generator writes and labels.

A token is a run of letters and digits (all non-ASCII bytes are letters) or one
punctuation character.  A secret holds no white space: inside can't follow a
gap.  So a stretch without white space in which no token gains more by begin
or inside than transitions can cost is outside on the best path; only other
stretches are decoded, each run of neighbouring ones from outside to outside.
That is the best path of the whole text, found without scoring paths elsewhere.

Offsets are code points, ends exclusive.  Added spans are the parts of tagged
runs that no base span covers, if ``least`` bytes or longer.

Defined results: null is the empty text and has no spans; repeated rows give
the same spans; texts of any length are scanned whole; the digest of no base
span is that of the empty string.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm import text as tx
from docloom.llm.runtime import add_columns

#: The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "field")

#: Words that announce a secret, words of harmless identifiers, and words between the two.
KEYWORDS = "password passwd pwd pass passphrase passcode secret token apikey api key auth bearer credential credentials private license signing psk".split()
HARMLESS = "http https www com org net html php commit sha md5 version id uuid isbn doi tel phone fax ip mail order ticket page".split()
LINKING = "is are as was".split()


@dataclass(frozen=True)
class Settings:
    examples: int = 6000
    epochs: int = 8
    batch: int = 128
    rate: float = 0.3
    decay: float = 1e-4
    seed: int = 11
    #: Shortest added span, in bytes.
    least: int = 6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# --- tokens and features ------------------------------------------------------

_SPACE, _DIGIT, _LOWER, _UPPER, _WIDE, _PUNCT = range(6)
_CLASS = np.full(256, _PUNCT, np.uint8)
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = _DIGIT, _LOWER, _UPPER, _WIDE
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
#: Punctuation that ends the run that a token stands in.
_BREAK = np.zeros(256, bool)
_BREAK[list(b"\"'`,;()<>[]{}|=:")] = True
_CODE = np.zeros(256, bool)
_CODE[list(b"{};$<>")] = True
#: Bit length of a size, at most 7.
_BITS = np.array([min(7, i.bit_length()) for i in range(256)])

#: Word classes after the 128 of punctuation characters.
_KEY, _OK, _LINK, _NUMBER, _WORD, _TITLE, _MIXED, _FOREIGN, _EDGE = range(128, 137)
_WORDS = 137
_SHAPES = 16 * 8 * 5 + 1
#: Values of each kind of feature, in order; their tables lie end to end.
_SIZES = (1, _SHAPES * 3, _WORDS, _WORDS * _WORDS, _WORDS, 32 * 8 * 4 * 3, 16 * 5 * 8 * 3, 2 * 2 * 3 * 16, 8 * 2 * 16, 8 * 3, 5 * 2 * 8 * 3)
_STARTS = np.cumsum([0, *_SIZES])


def _hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        out.append(tx.Rolling(raw).span(np.array([0]), np.array([len(raw)]))[0])
    return np.sort(np.array(out, np.uint64))


_KNOWN = ((_KEY, _hash_words(KEYWORDS)), (_OK, _hash_words(HARMLESS)), (_LINK, _hash_words(LINKING)))


def _sum(flags: np.ndarray) -> np.ndarray:
    """Counts of true values before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


@dataclass
class Tokens:
    """The tokens of a run of rows. ``start`` and ``end`` lie in the rows put apart by a zero byte, which begin at ``begin``."""

    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    #: Whether white space or the row's start comes before.
    gap: np.ndarray
    #: One row for each kind of feature: places in the table of weights.
    feature: np.ndarray
    #: Code points before each byte.
    points: np.ndarray


def tokens(buf: np.ndarray, offs: np.ndarray) -> Tokens:
    data, begin = tx.separated(buf, offs)
    kind = _CLASS[data]
    word = (kind != _SPACE) & (kind != _PUNCT)
    before = np.concatenate(([False], word[:-1]))
    start = np.flatnonzero((kind == _PUNCT) | (word & ~before))
    end = np.flatnonzero((kind == _PUNCT) | (word & ~np.concatenate((word[1:], [False])))) + 1
    n = len(start)
    row = np.searchsorted(begin, start, "right") - 1
    points = _sum((data & 0xC0) != 0x80)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(begin, none, none, none, np.zeros(0, bool), np.zeros((len(_SIZES), 0), np.int32), points)
    sums = {k: _sum(kind == k) for k in (_DIGIT, _LOWER, _UPPER, _WIDE, _PUNCT)}
    sums["vowel"], sums["turn"] = _sum(_VOWEL[data]), _sum(np.concatenate(([False], kind[1:] != kind[:-1])))

    def over(what, a, b):
        return sums[what][b] - sums[what][a]

    def bits(a, b, wide_at=3):
        return (over(_DIGIT, a, b) > 0) + 2 * (over(_UPPER, a, b) > 0) + 4 * (over(_LOWER, a, b) > 0) + (over(_WIDE, a, b) > 0) * (1 << wide_at)

    def vowels(a, b):
        letters = over(_LOWER, a, b) + over(_UPPER, a, b)
        return np.minimum(4, over("vowel", a, b) * 8 // np.maximum(letters, 1))

    size = end - start
    punct = kind[start] == _PUNCT
    comp = np.where(punct, 0, bits(start, end))
    length = _BITS[np.minimum(size, 255)]
    turns = np.minimum(4, 8 * over("turn", start + 1, end) // size)
    shape = np.where(punct, _SHAPES - 1, (comp * 8 + length) * 5 + turns)
    cls = np.select([punct, comp == 1, comp == 4, (comp == 2) | (comp == 6), comp >= 8], [data[start].astype(np.int64), _NUMBER, _WORD, _TITLE, _FOREIGN], _MIXED)
    code = tx.Rolling(tx.lower_ascii(data)).span(start, end)
    for value, hashes in _KNOWN:
        cls[hashes[np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)] == code] = value

    at = np.arange(n)
    space = _sum(kind == _SPACE)
    gap = np.concatenate(([True], space[start[1:]] != space[end[:-1]]))
    newline = _sum((data == 10) | (data == 0))
    line = newline[start]

    def back(k):  # word class k tokens before, on the same line
        out = np.full(n, _EDGE)
        out[k:][line[k:] == line[:-k]] = cls[:-k][line[k:] == line[:-k]]
        return out

    prev, prev2 = back(1), back(2)
    after = np.full(n, _EDGE)
    same = line[1:] == line[:-1]
    after[:-1][same] = cls[1:][same]
    last = np.maximum.accumulate(np.where(cls == _KEY, at, -1))
    last = np.concatenate(([-1], last[:-1]))
    far = np.where((last >= 0) & (line[last] == line), at - last, n + 9)
    key = np.where(far <= 3, 2, np.where(far <= 8, 1, 0))
    lastok = np.maximum.accumulate(np.where(cls == _OK, at, -1))
    ok = (lastok >= 0) & (line[lastok] == line) & (at - lastok <= 5)

    stop = punct & _BREAK[data[start]]
    new = gap | stop | np.concatenate(([True], stop[:-1]))
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    a, b = start[first], end[np.concatenate((first[1:], [n])) - 1]
    width = b - a
    r_bits = bits(a, b) + 16 * (over(_PUNCT, a, b) > 0)
    r_len = _BITS[np.minimum(width, 255)]
    r_turn = np.minimum(3, 6 * over("turn", a + 1, b) // width)
    r_code = (r_bits * 8 + r_len) * 4 + r_turn
    mark = sum((_sum(data == c)[b] - _sum(data == c)[a] > 0) * v for c, v in ((64, 1), (47, 2), (46, 4)))
    many = np.diff(np.concatenate((first, [n]))) > 1
    r_alpha = (vowels(a, b) * 2 + (r_bits & 9 == 0)) * 8 + r_len

    rows = np.diff(begin)
    ends = begin[1:] - 1
    odd = rows - 1 - sum(sums[k][ends] - sums[k][begin[:-1]] for k in (_LOWER, _UPPER, _WIDE)) - (space[ends] - space[begin[:-1]])
    codes = _sum(_CODE[data])
    whole = np.minimum(3, 10 * odd // np.maximum(rows - 1, 1)) * 2 + (codes[ends] > codes[begin[:-1]])

    values = (
        np.zeros(n, np.int64),
        shape * 3 + key,
        prev,
        prev2 * _WORDS + prev,
        after,
        r_code[run] * 3 + key,
        ((comp * 5 + vowels(start, end)) * 8 + length) * 3 + key,
        ((new * 2 + many[run]) * 3 + key) * 16 + comp,
        (mark[run] * 2 + ok) * 16 + comp,
        whole[row] * 3 + key,
        r_alpha[run] * 3 + key,
    )
    return Tokens(begin, start, end, row, gap, np.stack([v + f for v, f in zip(values, _STARTS)]).astype(np.int32), points)


# --- the field ---------------------------------------------------------------

_O, _B, _I = 0, 1, 2
#: Inside follows begin or inside only.
_BANNED = np.zeros((3, 3))
_BANNED[_O, _I] = -1e9


@dataclass
class Field:
    #: A row for each feature, a column for each tag.
    weight: np.ndarray
    #: From tag, to tag.
    trans: np.ndarray

    def emissions(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.start), 3))
        for f in t.feature:
            out += self.weight[f]
        out[t.gap, _I] = -1e9
        return out

    def decode(self, e: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Viterbi: tags of the tokens of several sequences, each between outside tokens; 0 elsewhere."""
        tags, back = np.zeros(len(e), np.int8), np.zeros((len(e), 3), np.int8)
        if not len(start):
            return tags
        by = np.argsort(-size, kind="stable")
        start, size, t = start[by], size[by], self.trans + _BANNED
        best = e[start] + t[_O]
        live = [np.searchsorted(-size, -k, "left") for k in range(int(size[0]))]  # sequences longer than k
        for k, m in enumerate(live[1:], 1):
            score = best[:m, :, None] + t
            back[start[:m] + k] = score.argmax(1)
            best[:m] = score.max(1) + e[start[:m] + k]
        now = (best + t[:, _O]).argmax(1)
        for k in range(len(live) - 1, -1, -1):
            m = live[k]
            tags[start[:m] + k] = now[:m]
            now[:m] = back[start[:m] + k, now[:m]]
        return tags

    def tag(self, t: Tokens) -> np.ndarray:
        """The best tags of whole rows."""
        e = self.emissions(t)
        if not len(e):
            return np.zeros(0, np.int8)
        free = self.trans[np.array([_O, _O, _B, _B, _I, _I, _B]), np.array([_O, _B, _O, _B, _O, _B, _I])]
        free = np.concatenate((free, [self.trans[_I, _I]]))
        cost = 2 * (free.max() - self.trans[:, _O].min())
        gains = e[:, 1:].max(1) - e[:, _O] + cost > 0
        piece = np.cumsum(t.gap) - 1
        active = np.zeros(int(piece[-1]) + 1, bool)
        active[piece[gains]] = True
        a, b = tx.runs(np.concatenate((active[piece], [False])))
        # Rows are sequences of their own; a stretch that goes on into the next row is cut there.
        edge = np.flatnonzero(np.diff(t.row)) + 1
        inner = edge[(np.searchsorted(a, edge, "left") > np.searchsorted(b, edge, "right"))]
        a, b = np.sort(np.concatenate((a, inner))), np.sort(np.concatenate((b, inner)))
        return self.decode(e, a, b - a)


def _expected(e: np.ndarray, size: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each token's tags, and expected transitions, of padded sequences (sequence, token, tag)."""
    n, most = len(size), e.shape[1]
    f, b = np.zeros(e.shape), np.zeros(e.shape)
    f[:, 0] = e[:, 0] + t[_O]
    for k in range(1, most):
        f[:, k] = e[:, k] + np.logaddexp.reduce(f[:, k - 1, :, None] + t, axis=1)
    for k in range(most - 1, -1, -1):
        ends = (size == k + 1)[:, None]
        on = np.logaddexp.reduce(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2) if k + 1 < most else np.zeros((n, 3))
        b[:, k] = np.where(ends, t[:, _O], on)
    z = np.logaddexp.reduce(f[:, 0] + b[:, 0], axis=1)
    inside = np.arange(most) < size[:, None]
    one = np.where(inside[:, :, None], np.exp(np.minimum(f + b - z[:, None, None], 0)), 0)
    two = np.zeros((3, 3))
    two[_O] += one[:, 0].sum(0)
    two[:, _O] += one[np.arange(n), size - 1].sum(0)
    for k in range(1, most):
        some = size > k
        two += np.exp(f[some, k - 1, :, None] + t + (e[some, k] + b[some, k])[:, None, :] - z[some, None, None]).sum(0)
    return one, two


# --- training lines -----------------------------------------------------------


def examples(s: Settings) -> list[tuple[str, int, int]]:
    """Texts and the span of the secret in each; an empty span for none."""
    rng = random.Random(s.seed)
    pick, some = rng.choice, rng.random
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    rand = lambda chars, a, b: "".join(pick(chars) for _ in range(rng.randint(a, b)))
    parts = "ba co di fu ge ha il jo ka le mi no pe ra si to un ve wo za the er ing tion schaft lich é ção ñ ü".split()
    syllables = lambda a, b: "".join(pick(parts) for _ in range(rng.randint(a, b)))
    word = lambda: syllables(1, 4)
    plain_word = lambda: "".join(pick(parts[:24]) for _ in range(rng.randint(1, 4)))
    num = lambda n: rand(string.digits, n, n)

    def words(a: int, b: int) -> str:
        out = [word() for _ in range(rng.randint(a, b))]
        if some() < 0.2:  # shouted, or with marks after each word
            mark, loud = pick(["!!", "!", "***", "$$$", "%%%", "&&&", "###", "...", "??", ""]), some() < 0.5
            out = [(w.upper() if loud else w) + (mark if some() < 0.8 else "") for w in out]
        return " ".join(out)

    strong = [
        lambda: rand(alnum, 20, 48),
        lambda: rand(alnum + "+/", 30, 60) + pick(["", "=", "=="]),
        lambda: "ghp_" + rand(alnum, 36, 36),
        lambda: pick(["sk_live_", "pk_test_", "rk_live_"]) + rand(alnum, 24, 24),
        lambda: "sk-" + rand(alnum, 32, 48),
        lambda: "xoxb-" + num(11) + "-" + num(12) + "-" + rand(alnum, 24, 24),
        lambda: "AIza" + rand(alnum + "_-", 35, 35),
        lambda: "eyJ" + rand(alnum, 20, 30) + "." + "eyJ" + rand(alnum, 30, 50) + "." + rand(alnum + "_-", 30, 43),
        lambda: rand(string.ascii_uppercase + string.digits, 24, 40),
    ]
    weak = [  # secrets only after a word that announces one
        lambda: plain_word() + rand(alnum, 6, 14),
        lambda: plain_word() + num(rng.randint(1, 4)) + pick(["", "!", "#", plain_word()]),
        lambda: rand(string.ascii_lowercase, 14, 30),
        lambda: rand(string.ascii_uppercase, 14, 30),
        lambda: "".join(plain_word() for _ in range(4)),
        lambda: plain_word().capitalize().replace("a", "@").replace("o", "0") + pick("!#%&*?") + num(4),
        lambda: rand(alnum + "!@#$%^&*", 9, 20),
        lambda: rand(alnum, 10, 20),
    ]
    harmless = [
        lambda: f"{plain_word()}.{num(2)}@{plain_word()}{num(1)}.example.com",
        lambda: f"{plain_word()}@{plain_word()}.org",
        lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: num(rng.randint(1, 16)),
        lambda: f"+{num(2)} {num(3)}-{num(4)}-{num(4)}",
        lambda: f"{num(4)}-{num(2)}-{num(2)}T{num(2)}:{num(2)}",
        lambda: f"https://www.{plain_word()}.com/{plain_word()}/{plain_word()}{num(3)}.html",
        lambda: f"/usr/{plain_word()}/{plain_word()}_{num(2)}/{plain_word()}.py",
        lambda: f"{plain_word()}_{plain_word()}_{num(2)}_{plain_word()}",
        lambda: plain_word() + plain_word().capitalize() + plain_word().capitalize() + "()",
        lambda: f"v{num(1)}.{num(2)}.{num(3)}-{plain_word()}.{num(1)}",
        lambda: f"{plain_word()}-{plain_word()}-{num(4)}-{plain_word()}",
        lambda: f"978-{num(1)}-{num(5)}-{num(3)}-{num(1)}",
        lambda: f"{rand(hexa, 8, 8)}-{rand(hexa, 4, 4)}-{rand(hexa, 4, 4)}-{rand(hexa, 4, 4)}-{rand(hexa, 12, 12)}",
        lambda: f"{pick(['commit', 'sha', 'md5', 'version'])} {rand(hexa, 7, 16)}",
        lambda: syllables(5, 9),
        lambda: syllables(4, 7).capitalize(),
        lambda: word() + pick(["***", "$$$", "%%%", "&&&", "###", "!!!", "..."]),
        lambda: word().upper(),
        lambda: f"{num(2)}{pick(['kg', 'km', 'GB', 'ms', 'th', 'px'])}",
    ]
    keys = ["password", "pwd", "secret", "token", "api_key", "auth", "Bearer", "credential", "private key", "passphrase", "passcode", "access token", "Password", "PASSWORD", "signing key", "psk"]
    others = ["see", "id", "order", "mail", "version", "file", "call", "from", "page", "name", "is", "was", "at"]
    out = []
    for _ in range(s.examples):
        lines = [words(3, 14) + pick([".", ",", ""]) for _ in range(rng.randint(0, 3))]
        lead, tail = words(0, 6), pick(["", '"', " ", ". ", "\n", "; ", ","]) + words(0, 5)
        kind = some()
        secret = ""
        if kind < 0.25:
            secret = pick(strong)()
            lead += " " + (pick(keys) if some() < 0.6 else pick(others)) + pick([" = ", ": ", " ", ' "', "=", " is ", " := "])
        elif kind < 0.5:
            secret = pick(weak)()
            lead += " " + pick(keys) + pick([" = ", ": ", ': "', ' "', "=", " is ", " is ", " is: ", " := ", " '", " "])
        elif kind < 0.62:  # a word that announces a secret, and none
            lead += " " + pick(keys) + pick([" is ", ": ", " ", " = ", " and "]) + pick([word, lambda: words(2, 4), lambda: num(rng.randint(1, 3)), lambda: pick(["required", "null", "None", "not set", "true", "<your password>", "***", "invalid"])])()
        elif kind < 0.9:
            lead += " " + (pick(others) + pick([" ", ": ", " = "]) if some() < 0.5 else "") + pick(harmless)()
        text = lead + secret + tail
        before = "\n".join([*lines, ""]) if lines else ""
        at = len(before) + len(lead)
        after = "\n" + "\n".join(words(2, 12) for _ in range(rng.randint(0, 2)))
        out.append((before + text + after, at, at + len(secret)))
    return out


def _sequences(made: list[tuple[str, int, int]]) -> tuple[Tokens, np.ndarray]:
    """The tokens of labelled texts, and their tags."""
    texts = pa.array([t for t, _, _ in made])
    ((_, _, buf, offs),) = tx.slices(texts, 1 << 30)
    t = tokens(buf, offs)
    a = np.array([len(x[:i].encode()) for x, i, _ in made]) + t.begin[:-1]
    b = np.array([len(x[:j].encode()) for x, _, j in made]) + t.begin[:-1]
    inside = (t.start >= a[t.row]) & (t.end <= b[t.row])
    first = inside & ~np.concatenate(([False], inside[:-1] & (t.row[1:] == t.row[:-1])))
    return t, np.where(first, _B, np.where(inside, _I, _O))


@lru_cache(maxsize=2)
def train(s: Settings = Settings()) -> Field:
    t, tags = _sequences(examples(s))
    field = Field(np.zeros((int(_STARTS[-1]), 3)), np.zeros((3, 3)))
    power, t_power = np.full(field.weight.shape, 1e-2), np.full((3, 3), 1e-2)
    first = np.searchsorted(t.row, np.arange(len(t.begin)))
    size = np.diff(first)
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        order = rng.permutation(np.flatnonzero(size))
        for k in range(0, len(order), s.batch):
            pick = order[k : k + s.batch]
            inside = np.arange(size[pick].max()) < size[pick][:, None]
            at = np.where(inside, first[pick][:, None] + np.arange(inside.shape[1]), 0)
            e = field.weight[t.feature[:, at]].sum(0)
            e[t.gap[at], _I] = -1e9
            one, two = _expected(e, size[pick], field.trans + _BANNED)
            want = np.eye(3)[tags[at]] - one
            used, flat = t.feature[:, at[inside]], want[inside]
            grad = np.stack([np.bincount(used.ravel(), np.tile(flat[:, y], len(used)), len(field.weight)) for y in range(3)], axis=1) / len(pick)
            seen = grad.any(1)
            grad[seen] -= s.decay * field.weight[seen]
            power[seen] += grad[seen] ** 2
            field.weight[seen] += s.rate * grad[seen] / np.sqrt(power[seen])
            moved = np.zeros((3, 3))
            for i in pick:
                path = np.concatenate(([_O], tags[first[i] : first[i] + size[i]], [_O]))
                np.add.at(moved, (path[:-1], path[1:]), 1)
            grad = (moved - two) / len(pick)
            t_power += grad**2
            field.trans += s.rate * grad / np.sqrt(t_power)
    return field


# --- scanning -----------------------------------------------------------------


def field_spans(t: Tokens, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the tagged runs, in bytes of the rows put apart."""
    begin = np.flatnonzero(tags == _B)
    on = np.concatenate((tags[1:] == _I, [False]))
    last = np.flatnonzero((tags != _O) & ~on)
    return t.row[begin], t.start[begin], t.end[last]


def _outside(a: int, b: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of [a, b) that no base span covers."""
    parts = []
    for _, x, y in base:
        if y <= a or x >= b:
            continue
        if x > a:
            parts.append((a, x))
        a = max(a, y)
    return [*parts, (a, b)] if a < b else parts


def may_match(low: np.ndarray, begin: np.ndarray, run_size: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """Rows that can have a base span: a cheap sieve over the lowered bytes of many rows."""
    out = np.zeros(len(begin) - 1, bool)
    # A base match needs a run of letters and digits this long, or a word of ASSIGN.
    out[np.searchsorted(begin, run_start[run_size >= min(ACCESS_LEAST, HEX_LEAST)], "right") - 1] = True
    raw = low.tobytes()
    for word in (b"passw", b"secret", b"token", b"key"):
        at = raw.find(word)
        while at >= 0:
            row = int(np.searchsorted(begin, at, "right")) - 1
            out[row] = True
            at = raw.find(word, int(begin[row + 1]))  # on from the next row
    return out


def spans(col: pa.Array, field: Field, s: Settings = Settings()) -> list[tuple[list, list]]:
    """For each text (base spans, all spans), both by start and then kind."""
    out: list[tuple[list, list]] = []
    for _, _, buf, offs in tx.slices(col):
        t = tokens(buf, offs)
        row, a, b = field_spans(t, field.tag(t))
        found: dict[int, list[tuple[int, int]]] = {}
        for r, x, y in zip(row.tolist(), a.tolist(), b.tolist()):
            found.setdefault(r, []).append((x, y))
        low = tx.separated(tx.lower_ascii(buf), offs)[0]
        base_rows = may_match(low, t.begin, t.end - t.start, t.start)
        for r in range(len(offs) - 1):
            base: list[tuple[str, int, int]] = []
            if base_rows[r]:
                base = base_spans(buf[offs[r] : offs[r + 1]].tobytes().decode())
            both = base
            if r in found:
                zero = int(t.points[t.begin[r]])
                extra = []
                for x, y in found[r]:
                    x, y = int(t.points[x]) - zero, int(t.points[y]) - zero
                    extra += [("field", i, j) for i, j in _outside(x, y, base) if j - i >= s.least]
                both = sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0])))
            out.append((base, both))
    return out


def all_spans(text: str, field: Field, s: Settings = Settings()) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    return spans(pa.array([text]), field, s)[0]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """Docs with the counts of base spans, their digest and all spans added."""
    shared = docs.sparkSession.sparkContext.broadcast(train(s))
    empty = hashlib.sha256(b"").hexdigest()

    def compute(col: pa.Array) -> list[pa.Array]:
        found = spans(col, shared.value, s)
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS[:3]]
        digest = [hashlib.sha256(_joined(base).encode()).hexdigest() if base else empty for base, _ in found]
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_joined(both) for _, both in found], pa.string())]

    return add_columns(docs, text_col, FIELDS, compute, keep)


def run(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(docs, keep=["doc_id"], s=s)
