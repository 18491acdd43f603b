"""Secret scans: fixed patterns, and password guess costs in credential contexts.

A value that stands behind a credential word is a secret if guessing it is expensive. The cost
is the cheapest segmentation of the value into dictionary words, dates, repeats, keyboard walks
and brute-force spans, found by dynamic programming over positions. Walks and repeats are cut
from maximal ones, whose length enters their cost, so any length and any period is one step of
the program and its work stays near to proportional to the value's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
COSTLY = 8.0
MASK = "[SECRET]"

ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider credential contexts. After "is" or "bearer", as prose has it, only a value with a digit or a
#: capital inside counts.
CONTEXT = re.compile(
    r"(?ai)(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?|login)"
    r"(?:[\"']?[\x20\t]*(?:=>|->|[:=]{1,2})[\x20\t]*|(?P<prose>[\x20\t]+is[\x20\t]+|(?<=bearer)[\x20\t]+))[\"']?(?P<value>[^\s\"'<>]{6})"
)
#: What a value, whose first six characters CONTEXT holds, goes on with.
RUN = re.compile(r"[^\s\"'<>]*")

#: What a login may be without being secret; a credential context inside a URL is judged for itself.
URL, MAIL = re.compile(r"(?i)[a-z][a-z0-9+.-]{1,20}://"), re.compile(r"[^\s@:/]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")

# Common password words, most common first; a word's rank is its cost in guesses.
WORDS = (
    "password qwerty admin welcome login letmein dragon master monkey shadow sunshine princess football baseball iloveyou trustno "
    "superman batman michael jordan hunter ranger soccer hockey killer george charlie andrew pepper daniel access joshua buster "
    "thomas tigger robert jennifer summer winter spring autumn secret flower cookie orange banana purple silver golden diamond "
    "computer internet server root user guest test temp demo default changeme public private token key pass word love god sex money "
    "freedom whatever starwars matrix phoenix mustang corvette ferrari mercedes maggie ginger jessica ashley nicole amanda "
    "hello world example sample company office manager service system network database backup oracle mysql cisco"
).split()


class Ranks(dict):
    """word -> its place in a list of words, from 1."""

    def __init__(self, words):
        super().__init__((w, k + 1) for k, w in enumerate(words))
        self.longest = max(map(len, self), default=1)
        #: What words begin and end with, so that a look for words stops early.
        self.starts = {w[:k] for w in self for k in range(1, len(w) + 1)}
        self.ends = {w[k:] for w in self for k in range(len(w))}


RANK = Ranks(WORDS)


@lru_cache(maxsize=2)
def dictionary(path: str | None) -> Ranks:
    """word -> rank: the password words above, then the whole words of three letters or more of a
    public vocabulary file, which lists them from frequent to rare. Without a path the former only."""
    if path is None:
        return RANK
    from .bpe_stream import Vocabulary

    v = Vocabulary.load(path)
    whole = sorted((i, t.removesuffix(v.suffix)) for t, i in v.ids.items() if v.suffix and t.endswith(v.suffix))
    return Ranks(dict.fromkeys([*WORDS, *(w for _, w in whole if len(w) >= 3 and w.isascii() and w.isalpha())]))


LEET = str.maketrans("013457@$!", "oleastasi")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d"
)
WALK_MIN, DATE_MAX = 3, 10
#: Characters of the first look at a value; each further look takes four times as many.
LOOK = 32


#: Key -> (row, column); each row of the keyboard lies half a key right of the one above.
PLACE = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
#: Steps between neighbouring keys: along a row, and to the two keys below or above.
STEPS = frozenset([(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)])


def on_keys(a: str, b: str) -> tuple | None:
    """The direction from a key to a neighbouring one; else null."""
    if a in PLACE and b in PLACE:
        (r, k), (s, j) = PLACE[a], PLACE[b]
        if (s - r, j - k) in STEPS:
            return s - r, j - k
    return None


def in_alphabet(a: str, b: str) -> int | None:
    """1 or -1 from a letter to the next or the one before; else null."""
    return ord(b) - ord(a) if "a" <= a <= "z" and "a" <= b <= "z" and abs(ord(b) - ord(a)) == 1 else None


#: What a walk may follow.
WAYS = (on_keys, in_alphabet)


#: Kinds of characters, and how many of each a guess would try.
CLASSES = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26), (lambda c: not c.isalnum(), 33))


def _alphabet(value: str) -> float:
    """log10 of the characters a brute-force guess would try at each place."""
    return log10(max(10, sum(n for kind, n in CLASSES if any(map(kind, value)))))


class _Run:
    """A cheap value, and the costs of its ends for the contexts inside it."""

    def __init__(self, text: str, start: int, end: int, ranks: Ranks):
        self.value, self.start, self.ranks, self.costs = text[start:end], start, ranks, {}
        self.last = [next((k for k in range(len(self.value) - 1, -1, -1) if kind(self.value[k])), -1) for kind, _ in CLASSES]

    def cost(self, at: int) -> float:
        k = at - self.start
        single = log10(max(10, sum(n for last, (_, n) in zip(self.last, CLASSES) if last >= k)))
        if single not in self.costs:
            self.costs[single] = costs_to_go(self.value, single, self.ranks)
        return self.costs[single][k]


def _alike(value: str, i: int, j: int, way: int) -> int:
    """How many characters from i on and from j on are equal (way 1), or before i and before j (way -1); i < j."""
    most = len(value) - j if way > 0 else i
    m, size, grows = 0, 8, True
    while m < most:
        size = min(size, most - m)
        same = value[i + m : i + m + size] == value[j + m : j + m + size] if way > 0 else value[i - m - size : i - m] == value[j - m - size : j - m]
        if same:
            m += size
            size *= 2 if grows else 1
        elif size == 1:
            break
        else:
            size, grows = size // 2, False
    return m


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal stretches that hold their smallest period twice or more.

    Such a stretch has two places a period apart at multiples of the period, so only these are
    tried: n/1 + n/2 + ... places in all.
    """
    n, found, longest = len(value), {}, (0, 0, 1)
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            if value[k] != value[k + p]:
                k += p
                continue
            a, e, q = longest
            if p % q == 0 and a <= k and k + p < e:  # a multiple of a known period, in the same stretch
                k = ((e - p - 1) // p + 1) * p
                continue
            a, e = k - _alike(value, k, k + p, -1), k + p + _alike(value, k, k + p, 1)
            if e - a >= 2 * p and (a, e) not in found:
                found[a, e] = p
                longest = max(longest, (a, e, p), key=lambda r: r[1] - r[0])
            k = max(k + p, ((e - p) // p + 1) * p)
    return [(a, e, p) for (a, e), p in found.items()]


def walks(low: str, step) -> list[tuple[int, int, list[int]]]:
    """(start, end, turns) of all maximal walks of WALK_MIN keys or more by ``step``; ``turns`` counts the
    changes of direction up to each of its keys."""
    out, start, turns, heading = [], 0, [0], None
    for k in range(1, len(low) + 1):
        now = step(low[k - 1], low[k]) if k < len(low) else None
        if now is None:
            if k - start >= WALK_MIN:
                out.append((start, k, turns))
            start, turns, heading = k, [0], None
        else:
            turns.append(turns[-1] + (heading is not None and now != heading))
            heading = now
    return out


def _word_cost(piece: str, low: str, plain: str, ranks: Ranks) -> float:
    rank, extra = ranks.get(low), 0.0
    if rank is None and (rank := ranks.get(plain)) is not None:
        extra = log10(4)
    if rank is None:
        return float("inf")
    if piece != low:
        extra += log10(2 if piece in (low.capitalize(), low.upper()) else 2 ** min(8, len(low)))
    return log10(rank + 1) + extra


def _date_cost(low: str, k: int, j: int) -> float:
    return (log10(200) if j - k == 4 else log10(365 * 120 * 4)) if j - k >= 4 and DATE.fullmatch(low, k, j) else float("inf")


WALK, TURN = log10(47), log10(4)


def _lower(value: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    return value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _cheapest(value: str, single: float, ranks: Ranks) -> list[float]:
    """Least cost of each beginning of ``value``."""
    n, low = len(value), _lower(value)
    plain = low.translate(LEET)
    leet = plain != low
    best = [0.0] + [float("inf")] * n
    known = iter(sorted(repeats(low), key=lambda r: r[0] + 2 * r[2]))
    coming, active = next(known, None), []
    ahead = sorted((w for way in WAYS for w in walks(low, way)), key=lambda w: w[0], reverse=True)
    walking: list[list] = []  # walk and the least cost before it, less the turns up to there
    for j in range(1, n + 1):
        cost = best[j - 1] + single
        for k in range(j - 2, max(0, j - ranks.longest) - 1, -1):
            if low[k:j] not in ranks.ends and not (leet and plain[k:j] in ranks.ends):
                break
            if j - k > 2 and best[k] < cost:
                cost = min(cost, best[k] + _word_cost(value[k:j], low[k:j], plain[k:j], ranks))
        if low[j - 1].isdigit():
            for k in range(max(0, j - DATE_MAX), j - 3):
                cost = min(cost, best[k] + _date_cost(low, k, j))
        while ahead and ahead[-1][0] + WALK_MIN <= j:
            walking.append([ahead.pop(), float("inf")])
        if walking:
            walking = [w for w in walking if w[0][1] >= j]
            for w in walking:
                (start, end, turns), before = w
                w[1] = min(before, best[j - WALK_MIN] - TURN * turns[j - WALK_MIN + 1 - start])
                cost = min(cost, w[1] + WALK + log10(end - start) + TURN * turns[j - 1 - start])
        while coming and coming[0] + 2 * coming[2] <= j:
            active.append([coming[1], coming[2], log10(coming[1] - coming[0]), float("inf")])
            coming = next(known, None)
        if active:
            active = [r for r in active if r[0] >= j]
            for r in active:
                r[3] = min(r[3], best[j - r[1]])
                cost = min(cost, r[3] + r[2])
        best[j] = cost
    return best


def costs_to_go(value: str, single: float, ranks: Ranks = RANK) -> list[float]:
    """Least cost of each end of ``value``, by the pieces of ``_cheapest``: one pass from the end gives all starts.

    Walks, repeats and their lengths are those of the whole ``value``, so an end may repeat what stands before it.
    """
    n, low = len(value), _lower(value)
    plain = low.translate(LEET)
    leet = plain != low
    best = [float("inf")] * n + [0.0]
    # Each with the least cost after it so far; the nearest to the end is last.
    behind = sorted(repeats(low), key=lambda r: r[1] - r[2])
    ahead = sorted((w for way in WAYS for w in walks(low, way)), key=lambda w: w[1])
    active: list[list] = []
    walking: list[list] = []
    for i in range(n - 1, -1, -1):
        cost = best[i + 1] + single
        for j in range(i + 2, min(n, i + ranks.longest) + 1):
            if low[i:j] not in ranks.starts and not (leet and plain[i:j] in ranks.starts):
                break
            if j - i > 2 and best[j] < cost:
                cost = min(cost, best[j] + _word_cost(value[i:j], low[i:j], plain[i:j], ranks))
        if low[i].isdigit():
            for j in range(i + 4, min(n, i + DATE_MAX) + 1):
                if low[j - 1].isdigit():
                    cost = min(cost, best[j] + _date_cost(low, i, j))
        while ahead and ahead[-1][1] - WALK_MIN >= i:
            walking.append([ahead.pop(), float("inf")])
        if walking:
            walking = [w for w in walking if w[0][0] <= i]
            for w in walking:
                (start, end, turns), after = w
                w[1] = min(after, best[i + WALK_MIN] + TURN * turns[i + WALK_MIN - 1 - start])
                cost = min(cost, w[1] + WALK + log10(end - start) - TURN * turns[i + 1 - start])
        while behind and behind[-1][1] - behind[-1][2] >= i:
            a, e, p = behind.pop()
            active.append([a + p, p, log10(e - a), float("inf")])
        if active:
            active = [r for r in active if r[0] <= i]
            for r in active:
                r[3] = min(r[3], best[i + r[1]])
                cost = min(cost, r[3] + r[2])
        best[i] = cost
    return best


def _open(value: str, best: list[float], enough: float, longest: int) -> bool:
    """Whether a segmentation that costs less than ``enough`` so far can still go on beyond ``value``."""
    m, low = len(value), _lower(value)
    cheap = [i for i, b in enumerate(best) if b < enough]
    if cheap[-1] >= m - max(longest, DATE_MAX) or len(cheap) > LOOK:
        return True
    tails = []
    for way in WAYS:
        tail = m - 1
        while tail and way(low[tail - 1], low[tail]):
            tail -= 1
        tails.append(tail)
    return cheap[-1] >= min(tails) or any(low[i:] == low[i - p : m - p] for i in cheap for p in range(1, i + 1))


def guess_cost(value: str, enough: float = float("inf"), ranks: Ranks = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; "": 0.

    Pieces are single characters (the value's alphabet), words of ``ranks`` (their rank; more for capitals
    and digits in place of letters), dates, stretches of three keys or more of a maximal keyboard walk (by keys
    or in the alphabet: its length and the turns), and stretches of a period or more that repeat the text one period before (the
    length of the maximal repeat). The value is looked at in growing beginnings; once no segmentation of less
    than ``enough`` can go on, the result is ``enough``.
    """
    n, look = len(value), LOOK
    single = _alphabet(value)
    while look < n:
        best = _cheapest(value[:look], single, ranks)
        if not _open(value[:look], best, enough, ranks.longest):
            return enough
        look *= 4
    return _cheapest(value, single, ranks)[n]


def spans(text: str, costly: float = COSTLY, ranks: Ranks = RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, end exclusive, by start and kind.

    The fixed kinds are leftmost and non-overlapping within each kind. "guess" spans are the
    values of credential contexts that cost at least 10^costly guesses and aren't wholly inside
    one of the fixed spans; they may overlap those. A value that is an e-mail address or a URL without a
    password is none. Where contexts stand inside a cheap value, their values are its ends and are all costed in one
    pass as parts of it.
    """
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted(found)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    at, stop, b, sign, run = 0, 0, 0, -1, None
    while m := CONTEXT.search(text, at):
        at = a = m.start("value")  # a cheap value can be the next context: "login: password: ..."
        if a >= stop:
            stop, run = RUN.match(text, a).end(), None
            b = a + len(text[a:stop].rstrip(".,;:!?)]}"))
            sign = text.rfind("@", a, b)
        if b - a < 6 or (m["prose"] is not None and not MIXED.search(text, a, b)) or MAIL.fullmatch(text, a, b) or (sign < a and URL.match(text, a)):
            continue
        cost = run.cost(a) if run else guess_cost(text[a:b], costly, ranks)
        if cost >= costly:
            at = b
            k = bisect_right(starts, a)
            if not (k and ends[k - 1] >= b):
                found.append((m.start(), b, "guess"))
        else:
            run = run or _Run(text, a, b, ranks)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in found])


def masked(text: str, mask: str = MASK, ranks: Ranks = RANK) -> str:
    """``text`` with every secret replaced; overlapping spans are replaced once."""
    out, at = [], 0
    for a, b, _ in spans(text, ranks=ranks):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", costly: float = COSTLY, words: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    ``words`` is the path of a vocabulary file for dictionary(); it is read once in each worker. Null and empty texts have no spans. Repeated rows and null ids are kept.
    """

    def make():
        ranks = dictionary(words)

        def work(ids, texts):
            made = [spans(t or "", costly, ranks) for t in texts]
            base = [[x for x in m if x[2] != "guess"] for m in made]
            counts = [[sum(x[2] == kind for x in m) for m in made] for kind in KINDS]
            hashes = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
            return ids, *counts[:3], hashes, [listed(m) for m in made], counts[3]

        return work

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint"
    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, {schema}")


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK, words: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked; null texts stay null, other columns stay as they are."""

    @F.arrow_udf("string")
    def clean(texts):
        import pyarrow as pa

        ranks = dictionary(words)
        return pa.array([None if (t := x.as_py()) is None else masked(t, mask, ranks) for x in texts], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))
