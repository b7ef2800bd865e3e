"""Byte-pair encoding by backtracking, and decoding by an offset table.

A sequence of tokens is the result of the merges exactly if each pair of neighbours is: two neighbours can stand side
by side if no merge across their border comes before the merges that built them. So the encoder needs no merge loop.
It takes the longest token that an Aho-Corasick automaton finds at a position, steps down to shorter prefixes while the
pair with the token before it is incompatible, and backs up where nothing fits. A position that failed once is never
tried again, so the time is linear in the length of the piece.

Edge cases: null and empty texts have no tokens; texts of any length are encoded whole; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import in_python, keeper, lean
from .text import Cache, pieces, strings, with_columns

#: White space as the tokenizer's regular expressions have it; str.split() also takes \x1c-\x1f.
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD = regex.compile("[\x1c-\x1f]")
END = "\0"  # stands for the word-end suffix inside pieces
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Tables of one vocabulary file with word ends, byte letters and a split pattern."""

    def __init__(self, spec: bytes, decoded: bool = True, entries: int = 1 << 18):
        self.decoded = decoded
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"]["pretokenizers"]
        suffix = model.get("end_of_word_suffix") or ""
        put = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        self.suffixed = bool(suffix)
        self.ids = {put(t): i for t, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in d["added_tokens"]}
        shown = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.added.items()}}
        #: Decoding: all tokens in one string; token i is blob[offsets[i]:offsets[i + 1]].
        size = max(shown) + 1
        self.offsets = [0, *accumulate(len(shown.get(i, "")) for i in range(size))]
        self.blob = "".join(shown.get(i, "") for i in range(size))
        self.decimal = [str(i) for i in range(size)]
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        #: A special token can only stand in a chunk that holds its first letter; those with white space aren't cut by chunks().
        self.firsts = tuple(sorted({t[0] for t in self.added if t}))
        if any(SPACE.search(t) or not t for t in self.added):
            raise ValueError("special tokens with white space aren't supported")
        self.letters = byte_letters()
        merges = [tuple(put(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.rank = {}
        self.parts = {}
        born = {}
        for r, (a, b) in enumerate(merges):
            if a not in self.ids or b not in self.ids or a + b not in self.ids or a + b in self.parts:
                raise ValueError("merges must build each token in one way from known tokens")
            if max(born.get(a, -1), born.get(b, -1)) >= r:
                raise ValueError("a merge comes before the merges that build its parts")
            self.rank[a, b], self.parts[a + b], born[a + b] = r, (a, b, r), r
        self.find = ahocorasick.Automaton()
        base = {c for c in self.letters} | {c + END for c in self.letters}
        tokens = [t for t in self.ids if t in self.parts or t in base]
        for t in tokens:
            self.find.add_word(t, t)
        self.find.make_automaton()
        known = set(tokens)
        self.shorter = {t: next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in known), None) for t in tokens}
        self.ends = [Cache(lambda t, k=k: self._spine(t, k), len(self.ids)) for k in (0, 1)]
        self.pairs = Cache(self._pair, 1 << 18)
        #: Decimal ids and decoded text of words, and of texts without white space.
        self.words = Cache(self._word, entries)
        self.pieces = Cache(self._piece, entries // 2)

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """Tokens at one end of token, with the rank of the merge that ends each."""
        out, ends = [(token, NEVER)], NEVER
        while token in self.parts:
            ends = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, ends))
        return out

    def _pair(self, pair: tuple[str, str]) -> bool:
        """Can the two stand side by side: no merge across the border comes first. At equal rank the left one wins."""
        rank, right = self.rank, self.ends[0][pair[1]]
        for a, a_ends in self.ends[1][pair[0]]:
            for b, b_ends in right:
                if (a, b) in rank and (r := rank[a, b]) < a_ends and r <= b_ends:
                    return False
        return True

    def tokens(self, piece: str) -> list[str]:
        """Tokens of one piece in byte letters with its end mark; no tokens where a letter isn't in the vocabulary."""
        if piece in self.parts:
            return [piece]
        greedy = [t for _, t in self.find.iter_long(piece)]
        if sum(map(len, greedy)) == len(piece) and all(map(self.pairs.__getitem__, zip(greedy, greedy[1:], strict=False))):
            return greedy  # the longest matches fit as they are
        longest: list[str | None] = [None] * len(piece)
        for end, token in self.find.iter(piece):
            longest[end - len(token) + 1] = token
        out: list[str] = []
        failed: set[int] = set()
        at, token = 0, longest[0] if piece else None
        while at < len(piece):
            while token is not None and (
                at + len(token) in failed or (out and not self.pairs[out[-1], token])
            ):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += len(token)
                token = longest[at] if at < len(piece) else None
            elif out:
                failed.add(at)
                token = out.pop()
                at -= len(token)
                token = self.shorter[token]
            else:
                return []
        return out

    def _piece(self, chunk: str) -> tuple[str, str]:
        found: list[tuple[str, str]] = []
        special = False
        for letter in self.firsts:
            special = special or letter in chunk
        for part in self.specials.split(chunk) if special else (chunk,):
            if special and part in self.added:
                found.append((str(self.added[part]), part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # str.lower() looks around a capital sigma, the tokenizer doesn't.
            part = "".join(c.lower() for c in part) if "\u03a3" in part else part.lower()
            found += map(self.words.__getitem__, self.split.findall(part))
        if len(found) == 1:
            return found[0]
        return " ".join([x for x, _ in found if x]), " ".join([y for _, y in found if y])

    def _word(self, word: str) -> tuple[str, str]:
        letters = "".join(map(self.letters.__getitem__, word.encode()))
        found = self.tokens(letters + END if self.suffixed else letters)
        ids = [self.ids[t] for t in found]
        return " ".join([self.decimal[i] for i in ids]), self.decode(ids) if self.decoded else ""

    def chunks(self, text: str) -> list[str]:
        if ODD.search(text):
            return [x for x in SPACE.split(text) if x]
        return text.split()

    def both(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the text decoded from them."""
        found = [x for x in map(self.pieces.__getitem__, self.chunks(text)) if x[0]]
        if not found:
            return "", ""
        ids, decoded = zip(*found, strict=True)
        return " ".join(ids), " ".join(decoded)

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.both(text)[0].split())]

    def decode(self, ids) -> str:
        """Tokens one after another with spaces between; the vocabulary names no decoder that would join them."""
        o, blob = self.offsets, self.blob
        return " ".join([blob[o[i] : o[i + 1]] for i in ids])


_made: dict[bytes, Bpe] = keeper("bpe")


def tables(spec: bytes, decoded: bool = True, entries: int = 1 << 18) -> Bpe:
    """The tables of a vocabulary, made once in each process. Without decoded texts their caches are half as large."""
    key = hashlib.sha256(spec).digest(), decoded, entries
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(spec, decoded, entries)
    return _made[key]


FIELDS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "token_ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "ids_text": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
}


def encode(docs: DataFrame, vocabulary: str, fields=("n_tokens", "token_ids"), text="text", keep=None, hold: bool = True) -> DataFrame:
    """Encode each whole text and return the columns of keep (default: all but the text) with fields.

    vocabulary: path of the vocabulary file, read on the driver; its few MB go to the executors. fields: n_tokens,
    token_ids, ids_text (decimal ids joined by a space), decoded (the ids decoded again). A column of the input that
    has the name of a field is replaced. hold: workers keep the tables and large caches from one task to the next, which
    saves a third of the time and costs some hundred MB in each.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in (docs.columns if keep is None else keep) if c not in fields and (keep is not None or c != text)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f, FIELDS[f][0]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(spec.value, "decoded" in fields, 1 << 18 if hold else 1 << 16)
        for b in pieces(batches, text):
            found = [bpe.both(x) for x in strings(b, text)]
            new = {
                "n_tokens": lambda: [x.count(" ") + 1 if x else 0 for x, _ in found],
                "token_ids": lambda: [[*map(int, x.split())] for x, _ in found],
                "ids_text": lambda: [x for x, _ in found],
                "decoded": lambda: [y for _, y in found],
            }
            yield with_columns(b, keep, {f: pa.array(new[f](), FIELDS[f][1]) for f in fields})

    return docs.select(*dict.fromkeys([*keep, text])).transform(in_python, lean(run, "bpe" if hold else None, hold), schema)


def decode(tokens: DataFrame, vocabulary: str, ids="token_ids", into="decoded") -> DataFrame:
    """Add the text of a column of id lists, by the offset table. Null and empty lists give an empty text."""
    with open(vocabulary, "rb") as f:
        spec = tokens.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in tokens.columns if c != into]
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField(into, T.StringType())])

    def run(batches):
        bpe = tables(spec.value)
        for b in batches:
            out = [bpe.decode(x or ()) for x in b.column(ids).to_pylist()]
            yield with_columns(b, keep, {into: pa.array(out, pa.string())})

    return tokens.select(*keep).transform(in_python, run, schema)
