"""Personal data: rules for four base kinds, and boosted trees over further candidate spans.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping for each kind. Beyond them,
generators of high recall propose overlapping candidate spans of further kinds: secrets (long tokens), national numbers, phone
numbers without a country sign, spelled-out e-mail addresses. Boosted regression trees score each candidate by its
format, by how much its letters read like words, and by the words around it; which letters and words speak for what is
learned from the examples. Scores are calibrated on examples that the trees did not see, and each kind has the threshold
above which the target precision holds there. Of overlapping candidates the best stays, and none that overlaps a base span.

No table marks personal data, so there are three sources of examples. A seeded generator draws true formats and look-alikes
(versions, dates, order numbers, hashes of files, addresses of pages, names of classes). All documents of the corpus give their
own: places of base spans, with the phone number stripped of its country sign or the address spelled out, are true ones in
their real surroundings; runs of digits that fail the base rules, and other candidates in documents without any base span, are
look-alikes. And a table of texts without secrets, such as raw pages, gives further look-alikes (`plain`). Documents whose
crc32(doc_id as text) mod 3 is 1 are for calibration only, and so are some of the generator's words.

Every row of the tables counts in the fit (`learn`, `Corpus`): letters, the words around examples, the cuts of features, the trees' sums
and the calibration are sums that Spark makes over all rows; only such sums, of bounded size, come to the driver. All documents
together weigh as much as MASS of them would on average, and so do all plain texts, so that the generator's examples keep
their share however large the tables are. Sums are of integers: they don't depend on partitions.

Edge cases: null and empty texts have no spans; an empty table leaves the generator's examples; repeated rows count in the fit each time; texts are scanned whole,
candidates have no longest length, and overlaps are settled in n log n steps; repeated rows give equal rows. Places are
code points, the end is exclusive.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, in_python, lean
from .text import pieces, strings, with_columns

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "national", "localphone", "spelled")
ORDER = {k: i for i, k in enumerate(BASE + MORE)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_+/=.-]{16,}+"),
    "national": re.compile(r"(?<![0-9A-Za-z.-])(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{9})(?![0-9A-Za-z-])"),
    "localphone": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
}
#: What stands for @ in a spelled-out address; the words around it are looked for from there.
AT = re.compile(r"(?i) at |(?: ?[\[(]at[\])] ?)")
SPELLED_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._")
SPELLED_RIGHT = re.compile(r"(?i)[A-Z0-9-]++(?: dot | ?[\[(]dot[\])] ?)[a-z]{2,12}(?![a-z])")
#: A token without a digit is a candidate if its case changes inside, or if it is assigned or quoted.
CASES, GIVEN = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]"), re.compile(r"[=:\"']\s?$")
#: Rows that `sampled` looks at, at most.
SAMPLE = 2000
#: All rows of a table weigh as much in the fit as so many of them would on average; pairs of letters of the corpus, as so many of them.
MASS, LETTERS = 2000, 50000
#: Words around examples are counted in so many buckets for each kind.
BUCKETS = 1 << 18
#: Scores are rounded to these parts, and gradients counted in those, so that sums over rows are exact.
STEP, UNIT = 1 << 10, 1 << 24
#: Distinct examples of the corpus that one task sums up.
BLOCK = 50000
PRECISION = 0.98
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_spans string, spans string"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(int(d) * 2 % 9 if d != "9" else 9 for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each match has one @, so the search goes from @ to @ and widens to the left."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted by start, then kind as listed."""
    out = [(s, e, "email") for s, e in emails(text)]
    if "." in text:
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]], x[1]))


WORD = re.compile(r"[A-Za-z]+")
#: Ordinary words: what letters look like where no corpus is given, and what the generator's look-alikes are made of.
PLAIN = (
    "the river runs along old stone walls while people walk home from market with bread and fruit every child knows that winter brings snow and "
    "summer brings long warm evenings our engineers built writers readers stream catalog manager session factory handler buffer reader partition "
    "table index query plan report article season weather garden history science network service driver client server local default simple abstract "
    "common internal public static library module image style theme header footer content upload download archive release notes chapter section"
).split()


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Counts of pairs of letters (and borders: 0) in all words of three letters or more."""
    code = np.frombuffer(("  " + "\n".join(texts) + "  ").encode(errors="replace").translate(LETTER), dtype=np.uint8).copy()
    letter = code > 0
    alone = ~letter[:-3] & letter[1:-2] & (~letter[2:-1] | ~letter[3:])  # where words of one or two letters start
    starts = np.flatnonzero(alone) + 1
    code[starts] = 0
    two = starts[letter[starts + 1]] + 1
    code[two] = 0
    out = np.zeros(27 * 27, dtype=np.int64)
    for i in range(0, len(code) - 1, 1 << 20):
        own = code[i : i + (1 << 20) + 1].astype(np.int16)
        out += np.bincount(own[:-1] * 27 + own[1:], minlength=27 * 27)
    out[0] = 0
    return out


#: Bytes to the numbers of their letters, 1 to 26; 0: no letter of ASCII.
LETTER = bytes(c - 64 if 65 <= c <= 90 else c - 96 if 97 <= c <= 122 else 0 for c in range(256))


class Letters:
    """How much letters read like words: the mean logarithm of a letter's share after the one before."""

    def __init__(self, words, pairs: np.ndarray | None = None):
        n = np.ones((27, 27))
        for w in words:
            own = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in f" {w.lower()} "]
            for x, y in zip(own, own[1:], strict=False):
                n[x, y] += 1
        if pairs is not None:
            n += pairs.reshape(27, 27) * min(1.0, LETTERS / max(pairs.sum(), 1))
        self.table = np.log(n / n.sum(1, keepdims=True))

    def score(self, run: str) -> float:
        own = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in run.lower()]
        return float(np.mean(self.table[own[:-1], own[1:]])) if len(own) > 1 else -3.3


def around(text: str, start: int, end: int) -> list[tuple[str, str]]:
    """The last three words of the 40 characters before a span and the first two of the 20 behind it, with their side."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])][-3:]
    return [("before", w) for w in before] + [("behind", w.lower()) for w in WORD.findall(text[end : end + 20])[:2]]


def buckets(text: str, start: int, end: int, kind: str) -> list[tuple[str, int]]:
    """The words around a span as side and bucket."""
    first = MORE.index(kind) * BUCKETS
    return [(side, first + zlib.crc32(f"{side} {w}".encode()) % BUCKETS) for side, w in around(text, start, end)]


class Words:
    """What the words around examples say: logarithms of odds by kind, side and word, from weighted counts of look-alikes and true ones."""

    def __init__(self, no: np.ndarray, yes: np.ndarray, total: np.ndarray):
        """no, yes: by bucket; total: by kind, look-alikes and true ones."""
        self.no, self.yes, self.total = no, yes, total + 1.0
        low, high = np.repeat(self.total, BUCKETS, axis=0).T
        self.said = np.where(no + yes > 0, self._odds(no, yes, low, high), 0).astype(np.float32)

    @staticmethod
    def _odds(no, yes, low, high):
        return np.log((yes + 0.5) / (high + 1)) - np.log((no + 0.5) / (low + 1))

    def score(self, text: str, start: int, end: int, kind: str, own: tuple[int, float] | None = None) -> tuple[float, float, float, float]:
        """What the nearest word before says, the one before that speaks most for it, the one that speaks most against it, and the words behind.

        An example's own count (own: its label and weight) is taken out, and words without a count say nothing.
        """
        before, behind = [0.0], 0.0
        for side, i in buckets(text, start, end, kind):
            if own is None:
                said = float(self.said[i])
            else:
                no, yes = self.no[i] - (own[0] == 0) * own[1], self.yes[i] - (own[0] == 1) * own[1]
                said = float(self._odds(max(no, 0.0), max(yes, 0.0), *self.total[MORE.index(kind)])) if no + yes > own[1] / 2 else 0.0
            if side == "before":
                before.append(said)
            else:
                behind += said
        return before[-1], max(before), min(before), behind


def features(text: str, start: int, end: int, kind: str, letters: Letters, words: Words, own: tuple[int, float] | None = None) -> list[float]:
    """Format of the span, how its letters read, and what the words around it say."""
    span, near = text[start:end], text[max(0, start - 3) : start]
    n = len(span)
    digits, upper, lower = (sum(f(c) for c in span) for f in (str.isdigit, str.isupper, str.islower))
    counts = [span.count(c) for c in set(span)]
    runs = [x for w in WORD.findall(span) if len(w) > 2 for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", w) if len(x) > 2]
    long = sum(map(len, runs))
    return [
        MORE.index(kind), n, digits / n, upper / n, lower / n, 1 - (digits + upper + lower) / n,
        -sum(c / n * math.log2(c / n) for c in counts), len(counts) / n,
        *words.score(text, start, end, kind, own), float("=" in near or ":" in near), float('"' in near or "'" in near),
        float(bool(re.fullmatch("[0-9a-f]+", span))), float("(" in span), max(map(len, re.findall("[0-9]+", span)), default=0) / n,
        sum(letters.score(x) * len(x) for x in runs) / long if long else -3.3, long / n, max(map(len, runs), default=0), float(len(runs)),
        float(span.count("/")), float(span.count(".")), float(span.count("-") + span.count("_")), float(span.isupper()),
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "secret") for m in CANDIDATES["secret"].finditer(text) if any(map(str.isdigit, m[0])) or CASES.search(m[0]) or GIVEN.search(text[max(0, m.start() - 2) : m.start()])]
    out += [(*m.span(), k) for k in ("national", "localphone") for m in CANDIDATES[k].finditer(text)]
    last = 0
    for at in AT.finditer(text) if "dot" in text or "DOT" in text else ():
        start = at.start()
        while start > last and text[start - 1] in SPELLED_LEFT:
            start -= 1
        m = SPELLED_RIGHT.match(text, at.end()) if start < at.start() else None
        if m:
            out.append((start, m.end(), "spelled"))
            last = m.end()
        else:
            last = at.end()
    return out


def grid(x: np.ndarray) -> np.ndarray:
    """Values to steps that keep their order: 1/128 of a doubling, finer than any cut needs, a few thousand at most."""
    return (np.sign(x) * np.floor(128 * np.log2(1 + 64 * np.abs(x)))).astype(np.int64)


def cells(x: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(feature, step of the grid, rows, largest value) of the rows of x."""
    out = []
    for f, c in enumerate(x.T):
        steps, at, n = np.unique(grid(c), return_inverse=True, return_counts=True)
        most = np.full(len(steps), -np.inf)
        np.maximum.at(most, at, c)
        out += [(f, int(s), int(k), float(m)) for s, k, m in zip(steps, n, most, strict=True)]
    return out


def cuts(found: list[tuple[int, int, float, float]], bins: int) -> list[np.ndarray]:
    """Quantiles of each feature over all examples, from weighted cells."""
    of: dict[int, dict[int, list[float]]] = {}
    for f, s, n, m in found:
        own = of.setdefault(f, {}).setdefault(s, [0.0, -np.inf])
        own[0], own[1] = own[0] + n, max(own[1], m)
    out = []
    for _, steps in sorted(of.items()):
        n, most = np.array([steps[s] for s in sorted(steps)]).T
        share = np.cumsum(n) / n.sum()
        out.append(np.unique(most[np.minimum(np.searchsorted(share, np.linspace(0, 1, bins)[1:-1] - 1e-12), len(most) - 1)]))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


def sums(b: np.ndarray, y: np.ndarray, count: np.ndarray, trees: list[list[tuple]], nodes: list[int], bins: int) -> np.ndarray:
    """Sums of gradients, curvatures (both in 1/UNIT) and rows by node of the last tree, feature and bin; the trees before it have made the scores."""
    rows, score = np.arange(len(b)), np.zeros(len(b))
    for tree in trees:
        f, k, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(b), dtype=np.int64)
        while (f[at] >= 0).any():
            at = np.where(f[at] < 0, at, np.where(b[rows, f[at]] <= k[at], left[at], right[at]))
        if tree is not trees[-1]:
            score += value[at]
    p = 1 / (1 + np.exp(-score))
    out = np.zeros((len(nodes), 3, b.shape[1], bins), dtype=np.int64)
    for i, node in enumerate(nodes):
        own = at == node
        for j, w in enumerate((np.rint((y - p) * UNIT) * count, np.rint(p * (1 - p) * UNIT) * count, count)):
            for f in range(b.shape[1]):
                out[i, j, f] = np.bincount(b[own, f], w[own], bins)  # whole numbers below 2^53
    return out


class Trees:
    """Gradient boosting for a logistic loss with trees of depth 3 over quantile-binned features, grown level by level from sums."""

    def __init__(self, rounds=40, rate=0.3, depth=3, bins=32, leaf=8.0):
        self.rounds, self.rate, self.depth, self.bins, self.leaf = rounds, rate, depth, bins, leaf
        self.trees: list[list[tuple]] = []

    def fit(self, cuts: list[np.ndarray], total) -> Trees:
        """total(trees, nodes): the weighted `sums` over all examples; these trees compare numbers of bins."""
        grown: list[list[tuple]] = []
        for _ in range(self.rounds):
            tree: list[tuple] = [(-1, 0, 0, 0, 0.0)]
            nodes = [0]
            for _ in range(self.depth):
                found = total([*grown, tree], nodes) if nodes else ()
                nodes = [x for node, own in zip(nodes, found, strict=True) for x in self._split(tree, node, own, cuts)]
            grown.append(tree)
        self.trees = [[(f, float(cuts[f][k]) if f >= 0 else 0.0, left, right, value) for f, k, left, right, value in tree] for tree in grown]
        return self

    def _split(self, tree, node, own, cuts) -> list[int]:
        """Splits a node where that gains most; the numbers of the new ones."""
        value = lambda g, h: float(self.rate * g / (h + 1.0))
        g, h, n = own[:, 0].sum(1)
        best = (1e-3, None, None)
        for f, q in enumerate(cuts):
            gs, hs, ns = (np.cumsum(own[j, f])[: len(q)] for j in range(3))
            if not len(q):
                continue
            gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
            gain[(ns < self.leaf) | (n - ns < self.leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        _, f, k = best
        if f is None:
            tree[node] = (-1, 0, 0, 0, value(g, h))
            return []
        left = len(tree)
        low = own[:, f, : k + 1].sum(1)
        tree[node] = (f, k, left, left + 1, 0.0)
        tree += [(-1, 0, 0, 0, value(low[0], low[1])), (-1, 0, 0, 0, value(g - low[0], h - low[1]))]
        return [left, left + 1]

    def score(self, row: list[float]) -> float:
        total = 0.0
        for tree in self.trees:
            f, at, left, right, value = tree[0]
            while f >= 0:
                f, at, left, right, value = tree[left if row[f] <= at else right]
            total += value
        return total


#: Words around true spans and look-alikes; of each list the last third is for calibration only.
TRUE_WORDS = {
    "secret": "api_key = |token: |secret = \"|password=|auth token |key: |bearer |authorization: |passwd: |credential |access_token=|client_secret: |private key |export API_TOKEN=|my password is |set secret=".split("|"),
    "national": "ssn |SSN: |social security |social security number |tax id: |national id |identity number |insurance number |taxpayer |my social is |tin: |id number: ".split("|"),
    "localphone": "call |tel: |phone |mobile |reach me on |my number is |telephone: |cell |contact us: |fax |dial |text me at ".split("|"),
    "spelled": "write to |mail |contact |e-mail: |send it to |my address is |reach me: |email ||ask ".split("|"),
}
OTHER_WORDS = {
    "secret": "sha |commit |checksum |md5: |hash |digest |see |item |revision |etag: |build |fixed in |import |from |at |file |class |merge |blob |tree |path: |href=|src=\"|reverts ||".split("|"),
    "national": "order |part |version |ticket |serial |invoice |batch |item |case |row |parcel |lot |tracking |model |reference |sku: ".split("|"),
    "localphone": "order |build |isbn |serial |ticket |room |lot |part |pallet |row |batch |invoice |rack |shelf |sku |page |container |article |locker ".split("|"),
    "spelled": "look |order |part |item |stop |point |stare |aim |meet |glance ".split("|"),
}
UNITS = " pallets| units| boxes| pieces|, shelf two| items| crates| copies| sheets| rolls".split("|")


def examples(n: int, seed: int, late: bool = False) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, 1 if personal) drawn from true formats and look-alikes; `late` draws with the words kept for calibration."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    mixed = lambda k: "".join(r.choice(letters + "0123456789") for _ in range(k))
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))
    word = lambda: r.choice([r.choice(PLAIN), r.choice(PLAIN), name()])
    filler = lambda: " ".join(word() for _ in range(r.randint(3, 9)))
    part = lambda of: r.choice(of[-(-2 * len(of) // 3) :] if late else of[: -(-2 * len(of) // 3)])
    camel = lambda: "".join(word().title() for _ in range(r.randint(2, 4)))
    slug = lambda c="-": c.join(word() for _ in range(r.randint(2, 6)))
    site = lambda: f"{r.choice(['www.', '', 'docs.'])}{word()}{r.choice(['', '.' + word()])}.{r.choice(['com', 'org', 'net', 'io'])}"
    date = lambda c="/": f"{r.randint(1990, 2029)}{c}{r.randint(1, 12):02}{c}{r.randint(1, 28):02}"
    phone = lambda: f"{digits(3)}{r.choice('-. ')}{digits(3)}-{digits(4)}"
    national = lambda: r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", digits(9)])
    tokens = [
        lambda: hexed(r.choice([32, 40, 64])), lambda: mixed(r.randint(20, 48)), lambda: f"{r.choice(['sk', 'pk', 'ghp', 'xoxb', 'key'])}{r.choice('-_')}{mixed(32)}", lambda: mixed(r.randint(120, 400)),
        lambda: f"eyJ{mixed(33)}.eyJ{mixed(r.randint(60, 200))}.{mixed(43)}", lambda: "".join(r.choice(letters) for _ in range(r.randint(18, 40))), lambda: mixed(r.randint(38, 42)) + r.choice(["=", "==", "/" + mixed(6), "+" + mixed(4)]),
    ]
    others = [
        lambda: f"//{site()}/{slug()}/{date()}/{slug()}", lambda: f"{site()}/{slug('/')}", lambda: f"{word()}/{word()}/{slug('_')}_{digits(2)}.{r.choice(['txt', 'html', 'py', 'png'])}", lambda: f"/{slug('/')}/{slug()}.{r.choice(['html', 'css', 'js'])}",
        lambda: f"{r.choice(['org', 'com', 'net', 'io'])}.{slug('.')}.{camel()}{r.choice(['', digits(1), 'V2'])}", lambda: camel() + r.choice(["", digits(1), "V2"]) + camel(), lambda: slug("_").upper() + r.choice(["", "_" + digits(2)]), lambda: slug() + "-" + digits(4),
        lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: hexed(r.choice([32, 40, 40, 64])), lambda: f"{date('-')}T{digits(2)}.{digits(2)}.{digits(2)}", lambda: f"{date('-')}-{slug()}", lambda: digits(r.randint(16, 24)), lambda: "a" * 20 + digits(2),
        lambda: r.choice("=-_.") * r.randint(20, 300) + digits(1), lambda: f"{slug('.')}-{digits(1)}.{digits(1)}.{digits(1)}.jar", lambda: slug("-") * r.randint(1, 6) + digits(2), lambda: f"{camel()}.{word()}{camel()}",
    ]
    kinds = [
        ("secret", 1, lambda: (part(TRUE_WORDS["secret"]), r.choice(tokens)())), ("secret", 1, lambda: (part(TRUE_WORDS["secret"]), r.choice(tokens)())), ("secret", 0, lambda: (part(OTHER_WORDS["secret"]), r.choice(others)())),
        ("secret", 0, lambda: ("", r.choice(others)())), ("secret", 0, lambda: (part(OTHER_WORDS["secret"]), r.choice(others)())), ("national", 1, lambda: (part(TRUE_WORDS["national"]), national())),
        ("national", 0, lambda: (r.choice([part(OTHER_WORDS["national"]), word() + " "]), national())), ("localphone", 1, lambda: (part(TRUE_WORDS["localphone"]), r.choice([phone(), f"({digits(3)}) {digits(3)}-{digits(4)}"]))),
        ("localphone", 1, lambda: ("", f"({digits(3)}) {digits(3)}-{digits(4)}")), ("localphone", 0, lambda: (r.choice([part(OTHER_WORDS["localphone"]), word() + " "]), phone() + part([*UNITS, ""]))),
        ("spelled", 1, lambda: (part(TRUE_WORDS["spelled"]), r.choice([f"{name()} at {name()} dot com", f"{name()}.{name()} [at] {name()} [dot] org", f"{name()} AT {name()} DOT NET".upper(), f"{name()}{digits(2)} (at) {word()} (dot) io"]))),
        ("spelled", 0, lambda: (part(OTHER_WORDS["spelled"]), r.choice([f"{word()} at {r.choice(['the', 'a', 'one', 'this', 'each'])} dot {word()}", f"LOOK AT THE DOT {word()}".replace("LOOK", word()).upper()])[:64])),
    ]
    out = []
    while len(out) < n:
        kind, label, make = kinds[r.randrange(len(kinds))]
        cue, span = make()
        text = f"{filler()} {cue}{span}{r.choice(['. ', ' ', ', ', chr(34) + ' '])}{filler()}"
        start = text.index(cue + span) + len(cue)
        out += [(text, s, e, k, label) for s, e, k in candidates(text) if k == kind and s < start + len(span) and e > start]
    return out[:n]


def corpus_examples(text: str) -> list[tuple[str, int, int, str, int]]:
    """Examples that a text gives by its base spans: (text around, start, end, kind, 1 if personal)."""
    if not TRIGGER.search(text):
        return []
    base, out = base_spans(text), []
    for s, e, kind in base:
        span, before, after = text[s:e], text[max(0, s - 60) : s], text[e : e + 20]
        new, name = span, None
        if kind == "phone" and (m := re.search(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", span)):
            new, name = m[0], "localphone"
        elif kind == "email":
            user, host = span.split("@")
            host, _, top = host.rpartition(".")
            new, name = f"{user} at {host.split('.')[0]} dot {top}", "spelled"
        if name:
            around = before + new + after
            out += [(around, x, y, k, 1) for x, y, k in candidates(around) if k == name and x < len(before) + len(new) and y > len(before)]
    taken = Taken(base)
    for x, y, k in candidates(text):
        if taken.free(x, y) and (text[x:y].isdigit() or not base):
            low = max(0, x - 60)
            # A long mixed token is left out, as the corpus doesn't say whether it is a secret.
            if k != "secret" or text[x:y].isdigit():
                out.append((text[low : y + 20], x - low, y - low, k, 0))
    return out


class Taken:
    """Places that are taken, as disjoint intervals."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, *_ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)  # the last interval that starts before e is number k - 1
        return k == 0 or self.ends[k - 1] <= s

    def take(self, s: int, e: int) -> None:
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


Examples = tuple[tuple[str, int, int, str, int], ...]


def sampled(docs: DataFrame, text="text", id_col="doc_id", sample: int = SAMPLE, plain: DataFrame | None = None, plain_text="html") -> tuple[Examples, Examples, tuple[str, ...]]:
    """A look at the corpus examples of a few documents, as rows for `model`: those for fitting, those for calibration, and words.

    `find` doesn't use it: it learns from all rows (`Corpus`). At most `sample` documents, that their ids' hashes choose, are read.

    plain: texts without secrets, of which at most as many rows (those with the smallest hashes) give look-alikes.
    """
    picked = docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col(id_col))
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text")).select(F.col("_id").cast("string").alias("_id"), "_text", F.lit(False).alias("_plain"))
    if plain is not None:
        # Only rows under a cut of their hashes, about twice as many as are wanted, are sorted.
        share = min(1.0, 2 * sample / max(plain.count(), 1))
        under = F.xxhash64(plain_text) <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))
        some = plain.where(F.col(plain_text).isNotNull() & under).select(F.xxhash64(plain_text).alias("_h"), F.col(plain_text).alias("_text")).orderBy("_h", "_text").limit(sample)
        rows = rows.union(some.select(F.col("_h").cast("string"), "_text", F.lit(True)))

    def run(batches):
        for b in pieces(batches, "_text"):
            found, seen = [], []
            for i, t, only in zip(b.column("_id").to_pylist(), strings(b, "_text"), b.column("_plain").to_pylist(), strict=True):
                out = zlib.crc32(str(i).encode()) % 3 == 1
                own = [(t[max(0, s - 60) : e + 20], min(s, 60), min(s, 60) + e - s, k, 0) for s, e, k in candidates(t)[:40]] if only else corpus_examples(t)
                found += [(out, *x) for x in own]
                seen += [] if only else [w for w in WORD.findall(t[:2000]) if len(w) > 2][:20]
            found += [(False, " ".join(seen), 0, 0, "", -1)] if seen else []
            cols = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["out", "text", "s", "e", "kind", "y"])

    got = sorted({tuple(r) for r in rows.transform(in_python, run, "out boolean, text string, s int, e int, kind string, y int").collect()})
    seen = sorted({w for r in got if r[5] < 0 for w in r[1].split()})
    return tuple(r[1:] for r in got if not r[0] and r[5] >= 0), tuple(r[1:] for r in got if r[0] and r[5] >= 0), tuple(seen)


class Corpus:
    """The examples that all rows of the tables give, as a stored table, and the sums over them that a fit needs."""

    SCHEMA = "src int, out boolean, text string, s int, e int, kind string, y int, words array<int>, seen array<long>"

    def __init__(self, docs: DataFrame, text="text", id_col="doc_id", plain: DataFrame | None = None, plain_text="html"):
        of = lambda df, src, key, text: df.select(F.lit(src).alias("_src"), (F.coalesce(F.crc32(key.cast("string")), F.lit(0)) % 3 == 1).alias("_out"), F.col(text).alias("_text"))
        rows = of(docs, 0, F.col(id_col), text)
        if plain is not None:
            rows = rows.union(of(plain, 1, F.xxhash64(plain_text), plain_text))

        @lean
        def run(batches):
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            record = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [()] * 9, kinds, strict=True)], [f.split()[0] for f in Corpus.SCHEMA.split(", ")])
            seen = np.zeros((2, 2 + 27 * 27), dtype=np.int64)  # texts, examples to fit on, pairs of letters
            for b in pieces(batches, "_text"):
                found, texts = [], strings(b, "_text")
                sources = b.column("_src").to_pylist()
                for src, out, t in zip(sources, b.column("_out").to_pylist(), texts, strict=True):
                    own = [(t[max(0, s - 60) : e + 20], min(s, 60), min(s, 60) + e - s, k, 0) for s, e, k in candidates(t)] if src else corpus_examples(t)
                    found += [(src, out, *x, [i for _, i in buckets(*x[:4])], None) for x in own]
                    seen[src, :2] += 1, 0 if out else len(own)
                seen[0, 2:] += letter_pairs([t for t, src in zip(texts, sources, strict=True) if not src])
                yield record(found)
            yield record([(src, None, None, None, None, None, None, None, n.tolist()) for src, n in enumerate(seen)])

        self.found = cut(rows.transform(in_python, run, self.SCHEMA))
        total = self.found.where("seen is not null").select("src", F.posexplode("seen").alias("i", "n")).groupBy("src", "i").agg(F.sum("n").alias("n"))
        seen = np.zeros((2, 2 + 27 * 27))
        for src, i, n in total.collect():
            seen[src, i] = n
        self.weight = [min(1.0, MASS / max(n, 1)) for n in seen[:, 0]]
        self.n, self.pairs = int(seen[:, 1].sum()), seen[0, 2:]
        self.fit, self.held = (self.found.where(F.col("seen").isNull() & (F.col("out") == out)) for out in (False, True))

    def words(self, no: np.ndarray, yes: np.ndarray, total: np.ndarray) -> None:
        """Adds the words around the examples to counts by bucket, and the examples to those by kind."""
        weight = np.array(self.weight)
        got = self.fit.select("src", "y", F.explode("words").alias("i")).groupBy("i").pivot("y", [0, 1]).agg(*(F.count(F.when(F.col("src") == src, 1)).alias(str(src)) for src in (0, 1))).fillna(0).toArrow()
        i = got.column("i").to_numpy()
        for y, to in ((0, no), (1, yes)):
            to[i] += sum(got.column(f"{y}_{src}").to_numpy() * weight[src] for src in (0, 1))
        for src, kind, y, n in self.fit.groupBy("src", "kind", "y").count().collect():
            total[MORE.index(kind), y] += n * weight[src]

    def measure(self, letters: Letters, words: Words) -> None:
        """Stores the features of the examples to fit on."""
        shared, weight = self.found.sparkSession.sparkContext.broadcast((letters, words)), self.weight

        def run(batches):
            for b in pieces(batches, "text"):
                rows = b.to_pylist()
                x = [np.array(features(r["text"], r["s"], r["e"], r["kind"], *shared.value, (r["y"], weight[r["src"]]))).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([b.column("src"), b.column("y"), pa.array(x, pa.binary())], ["src", "y", "x"])

        self.x = cut(self.fit.select("src", "y", "text", "s", "e", "kind").transform(in_python, run, "src int, y int, x binary"))

    @staticmethod
    def _matrix(b: pa.RecordBatch, column: str, kind=np.float64) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(column).to_pylist()), dtype=kind).reshape(b.num_rows, -1)

    def cells(self) -> list[tuple[int, int, float, float]]:
        def run(batches):
            for b in batches:
                src = b.column("src").to_numpy()
                found = [(s, *c) for s in (0, 1) if (src == s).any() for c in cells(Corpus._matrix(b, "x")[src == s])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [()] * 5, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()], strict=True)], ["src", "f", "step", "n", "most"])

        got = self.x.select("src", "x").transform(in_python, run, "src int, f int, step long, n long, most double").groupBy("src", "f", "step").agg(F.sum("n"), F.max("most"))
        return [(f, step, n * self.weight[src], most) for src, f, step, n, most in got.collect()]

    def bin(self, cuts: list[np.ndarray]) -> None:
        """Stores the distinct binned examples with their numbers."""

        def run(batches):
            for b in batches:
                x = [row.tobytes() for row in binned(Corpus._matrix(b, "x"), cuts)] if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column("src"), b.column("y"), pa.array(x, pa.binary())], ["src", "y", "b"])

        distinct = self.x.transform(in_python, run, "src int, y int, b binary").groupBy("src", "y", "b").agg(F.count("*").alias("n"))
        self.b = cut(distinct.coalesce(-(-self.n // BLOCK)))

    def sums(self, trees: list[list[tuple]], nodes: list[int], bins: int) -> np.ndarray:
        """`sums` over all examples of the corpus, weighted by their tables."""

        def run(batches):
            found: dict[int, np.ndarray] = {}
            for batch in (x for x in batches if x.num_rows):
                b, src, y, n = Corpus._matrix(batch, "b", np.uint8), *(batch.column(c).to_numpy() for c in ("src", "y", "n"))
                for s in np.unique(src).tolist():
                    found[s] = found.get(s, 0) + sums(b[src == s], y[src == s], n[src == s], trees, nodes, bins)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["src", "sums"])

        total = [0, 0]
        for src, got in self.b.transform(in_python, run, "src int, sums binary").collect():
            total[src] = total[src] + np.frombuffer(got, dtype=np.int64)
        return sum(w * t for w, t in zip(self.weight, total, strict=True))

    def scores(self, fitted: Fitted) -> list[tuple[str, int, int, float]]:
        """(kind, label, rounded score, weight) of the examples for calibration."""
        shared = self.found.sparkSession.sparkContext.broadcast(fitted)

        def run(batches):
            for b in pieces(batches, "text"):
                z = [shared.value.raw(r["text"], r["s"], r["e"], r["kind"]) for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("src"), b.column("kind"), b.column("y"), pa.array(z, pa.int64())], ["src", "kind", "y", "z"])

        got = self.held.select("src", "text", "s", "e", "kind", "y").transform(in_python, run, "src int, kind string, y int, z long").groupBy("src", "kind", "y", "z").count()
        return sorted((kind, y, z, n * self.weight[src]) for src, kind, y, z, n in got.collect())


class Fitted:
    """Letters, words and trees, the two numbers of the calibration curve, and a threshold of the calibrated score for each kind."""

    def __init__(self, letters: Letters, words: Words, trees: Trees):
        self.letters, self.words, self.trees = letters, words, trees
        self.curve, self.limits = (1.0, 0.0), dict.fromkeys(MORE, 1.0)

    def calibrate(self, held: list[tuple[str, int, int, float]], precision: float) -> Fitted:
        """held: (kind, label, rounded score, weight)."""
        y, z, w = (np.array([r[i] for r in held], dtype=float) for i in (1, 2, 3))
        mean = lambda x: float((x * w).sum() / w.sum())
        z /= STEP
        for _ in range(200):  # Platt scaling by gradient steps
            p = self.probability(z)
            a, c = self.curve
            self.curve = a + 0.5 * mean((y - p) * z) / max(1e-9, mean(z * z)), c + 0.5 * mean(y - p)
        p = self.probability(z)
        of = {k: [i for i, r in enumerate(held) if r[0] == k] for k in MORE}
        self.limits = {k: self._limit(p[own], y[own], w[own], precision) for k, own in of.items()}
        return self

    @staticmethod
    def _limit(p: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float) -> float:
        """The middle between the last score down to which the precision holds and the next one; 1 where it never does."""
        order = np.argsort(-p, kind="stable")
        p, y, w = p[order], y[order], w[order]
        good = np.flatnonzero((np.cumsum(y * w) / np.cumsum(w) >= precision) & np.append(np.diff(p) != 0, True)[: len(p)])
        if not len(good):
            return 1.0
        last = good[-1]
        return float((p[last] + p[last + 1]) / 2 if last + 1 < len(p) else p[last])

    def probability(self, z):
        a, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))

    def raw(self, text: str, start: int, end: int, kind: str) -> int:
        return round(self.trees.score(features(text, start, end, kind, self.letters, self.words)) * STEP)

    def score(self, text: str, start: int, end: int, kind: str) -> float:
        return float(self.probability(self.raw(text, start, end, kind) / STEP))


def learn(fit: list, held: list, seen=(), corpus: Corpus | None = None, precision: float = PRECISION) -> Fitted:
    """Fitted on examples given as rows (weight 1) and on those of a corpus."""
    letters, rows = Letters([*PLAIN * 3, *seen], corpus.pairs if corpus else None), corpus
    corpus = corpus if corpus and corpus.n else None  # there may be none to fit on
    no, yes, total = np.zeros(len(MORE) * BUCKETS), np.zeros(len(MORE) * BUCKETS), np.zeros((len(MORE), 2))
    for t, s, e, k, y in fit:
        total[MORE.index(k), y] += 1
        for _, i in buckets(t, s, e, k):
            (yes if y else no)[i] += 1
    if corpus:
        corpus.words(no, yes, total)
    words = Words(no, yes, total)
    x, y, one = np.array([features(t, s, e, k, letters, words, (y, 1.0)) for t, s, e, k, y in fit]), np.array([r[4] for r in fit]), np.ones(len(fit))
    if corpus:
        corpus.measure(letters, words)
    trees = Trees()
    found = cuts([*cells(x), *(corpus.cells() if corpus else ())], trees.bins)
    b = binned(x, found)
    if corpus:
        corpus.bin(found)

    def sum_up(grown, nodes):
        own = sums(b, y, one, grown, nodes, trees.bins).astype(float)
        own += np.reshape(corpus.sums(grown, nodes, trees.bins), own.shape) if corpus else 0
        own[:, :2] /= UNIT
        return own

    trees.fit(found, sum_up)
    words.no = words.yes = None  # only examples' own counts needed them
    fitted = Fitted(letters, words, trees)
    own = [(k, y, fitted.raw(t, s, e, k), 1.0) for t, s, e, k, y in held]
    return fitted.calibrate([*own, *(rows.scores(fitted) if rows else ())], precision)


@functools.lru_cache(maxsize=2)
def model(seed: int = 11, n: int = 5000, precision: float = PRECISION, corpus: tuple[Examples, Examples, tuple[str, ...]] = ((), (), ())) -> Fitted:
    """Fitted on the generator's examples and on rows of a corpus's own; calibrated on others, with words around them that the trees did not see."""
    return learn([*examples(n, seed), *corpus[0]], [*examples(n, seed + 1, True), *corpus[1]], corpus[2], precision=precision)


def model_of(corpus: Corpus, seed: int = 11, n: int = 5000, precision: float = PRECISION) -> Fitted:
    """The same, on the examples of all rows of a corpus."""
    return learn(examples(n, seed), examples(n, seed + 1, True), corpus=corpus, precision=precision)


def more_spans(text: str, base: list[tuple[int, int, str]], fitted: Fitted) -> list[tuple[int, int, str]]:
    """The method's spans: accepted candidates, best first, that overlap nothing kept before."""
    scored = [(-p, s, e, k) for s, e, k in candidates(text) if (p := fitted.score(text, s, e, k)) >= fitted.limits[k]]
    kept: list[tuple[int, int, str]] = []
    taken = Taken(base)
    for _, s, e, k in sorted(scored):
        if taken.free(s, e):
            kept.append((s, e, k))
            taken.take(s, e)
    return kept


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]], x[1])))


TRIGGER = re.compile(r"[0-9@]|\b(?:dot|DOT)\b|[A-Za-z_+/=.-]{16}")


def spans(text: str, fitted) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, base + more_spans(text, base, fitted)


def find(docs: DataFrame, text="text", keep=("doc_id",), id_col="doc_id", plain: DataFrame | None = None) -> DataFrame:
    """The columns of keep with counts of the base kinds and of all spans, base_spans and spans as ``kind:start:end`` lists."""
    keep = [c for c in keep if c not in [f.split()[0] for f in SCHEMA.split(", ")]]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])
    fitted = docs.sparkSession.sparkContext.broadcast(model_of(Corpus(docs, text, id_col, plain)) if id_col in docs.columns else model())

    @lean
    def run(batches):
        for b in pieces(batches, text):
            got = [spans(t, fitted.value) for t in strings(b, text)]
            new = {f"n_{k}": pa.array([sum(x[2] == k for x in base) for base, _ in got], pa.int64()) for k in BASE}
            new |= {"n_spans": pa.array([len(x) for _, x in got], pa.int64())}
            new |= {"base_spans": pa.array([listed(x) for x, _ in got], pa.string()), "spans": pa.array([listed(x) for _, x in got], pa.string())}
            yield with_columns(b, keep, new)

    return docs.select(*dict.fromkeys([*keep, text])).transform(in_python, run, schema)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, k in sorted(found):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
