"""Token counts of every prefix of a text, by a dynamic program over byte-pair merges.

Of the tokens that end at a place, exactly one can be the last token of the prefix that ends there: the one that
stands unmerged beside the last token of the prefix before it. So one pass gives the count of every prefix, and
what is stored answers for truncations and budgets without encoding again.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import text_buffers, text_chunks

# Fixed value: how byte-level vocabularies cut a text before they merge. LETTER and NUMBER are classes of characters, OTHER is neither nor white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?OTHER+|\s+(?!\S)|\s+"
#: Characters of pieces that a task remembers the counts of, and pairs of tokens; beyond that it starts anew.
REMEMBERED, MOST_PAIRS = 64_000_000, 2_000_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it can be seen in Latin-1, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A byte-pair vocabulary: which tokens there are, and which may stand beside each other."""

    def __init__(self, ranked: list[tuple[bytes, bytes]]):
        #: Tokens are numbered from 0: the bytes, then one for each merge in order, so a number tells when a token is made.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        self.made: dict[tuple[int, int], int] = {}
        for left, right in ranked:
            pair = self.number[left], self.number[right]
            if left + right in self.number:
                raise ValueError("a token that two merges make")
            self.number[left + right] = self.made[pair] = len(self.halves)
            self.halves.append(pair)
        never = len(self.halves)
        whole = [True] * never  # whether merging a token's bytes gives that token alone
        for token in range(256, never):
            left, right = self.halves[token]
            whole[token] = whole[left] and whole[right] and self._apart(left, right, token)
        self.never = never
        #: Steps of a trie over tokens read from their ends: node * 256 + byte to node; tokens by node, -1 where none begins.
        self.steps: dict[int, int] = {}
        self.token: list[int] = [-1]
        for text, number in self.number.items():
            if whole[number]:
                node = 0
                for byte in reversed(text):
                    node = self.steps.setdefault(node << 8 | byte, len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                self.token[node] = number
        self.beside: dict[int, bool] = {}

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge joins left's end and right's beginning before the time until.

        Goes back in time: of the two pieces at the border, the one made later is undone. A merge across the border
        happens if it comes before its left piece grows, or no later than its right piece does (of equal pairs, the leftmost merges first).
        """
        halves, made = self.halves, self.made
        left_grows = right_grows = until
        while True:
            across = made.get((left, right))
            if across is not None and across < left_grows and across <= right_grows:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                left_grows, left = left, halves[left][1]
            else:
                right_grows, right = right, halves[right][0]

    def prefix_counts(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """For each piece the tokens of piece[:i], for every i from 0 on.

        A piece goes on from the prefix that it shares with the piece before it, so sorted pieces cost least. A list is valid until the next is asked for.
        """
        steps, token, beside, never = self.steps, self.token, self.beside, self.never
        counts, last, former = [0], [-1], b""
        for piece in pieces:
            shared = 0
            for x, y in zip(former, piece):
                if x != y:
                    break
                shared += 1
            del counts[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                node = 0
                for start in range(end - 1, -1, -1):
                    node = steps[node << 8 | piece[start]]
                    here = token[node]
                    if here < 0:
                        continue
                    if start:
                        key = last[start] * never + here
                        fits = beside.get(key)
                        if fits is None:
                            fits = beside[key] = self._apart(last[start], here, never)
                        if not fits:
                            continue
                    counts.append(counts[start] + 1)
                    last.append(here)
                    break
            former = piece
            yield counts
        if len(beside) > MOST_PAIRS:
            beside.clear()


class Vocabulary:
    """What a tokenizers file says: merges, and the strings that are tokens of their own wherever they stand."""

    def __init__(self, ranked: list[tuple[bytes, bytes]], special: list[str], unknown: dict[str, str]):
        self.ranked, self.special, self.unknown = ranked, special, unknown

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From the .json of a byte-level BPE; any other kind is an error."""
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, cut = said["model"], said["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and said["normalizer"] is None
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what stands beside them")
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls([(as_bytes(a), as_bytes(b)) for a, b in pairs], [t["content"] for t in said["added_tokens"]], _unknown(path))


def _unknown(path: str) -> dict[str, str]:
    """Letters (L) and numbers (N) of regex that the tokenizers library doesn't know, as its tables are older."""
    cut = Tokenizer.from_file(path).pre_tokenizer
    found = {}
    for kind, like, unlike in (("L", "a", "1"), ("N", "1", "a")):
        known = regex.compile(rf"\p{{{kind}}}").fullmatch
        asked = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and known(c)]
        ends = {end for _, (_, end) in cut.pre_tokenize_str("".join(like + c + unlike for c in asked))}
        found[kind] = "".join(c for i, c in enumerate(asked) if 3 * i + 1 in ends)  # cut off from its like
    return found


def _expression(unknown: dict[str, str]) -> regex.Pattern:
    listed = {kind: "".join(f"\\U{ord(c):08X}" for c in chars) for kind, chars in unknown.items()}
    minus = {kind: f"--[{chars}]" if chars else "" for kind, chars in listed.items()}
    out = PIECES.replace("LETTER", rf"[\p{{L}}{minus['L']}]").replace("NUMBER", rf"[\p{{N}}{minus['N']}]")
    return regex.compile(out.replace("OTHER", rf"[[^\s\p{{L}}\p{{N}}]{listed['L']}{listed['N']}]"), regex.V1)


class Counter:
    """Counts of all prefixes of texts, from those of their pieces, which are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.merges = Merges(vocabulary.ranked)
        self.common, self.any = _expression({"L": "", "N": ""}).findall, _expression(vocabulary.unknown).findall
        self.unknown = set("".join(vocabulary.unknown.values()))
        self.white = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))  # str.isspace has more characters
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[str, bytes] = {}  # a piece's changes of the count, a 32-bit integer for each character
        self.odd: set[str] = set()  # pieces that begin as another piece would
        self.words: dict[str, bytes] = {}  # the same for what stands between two spaces, the first of them included
        self.held = 0

    def find(self, text: str) -> list[str]:
        return self.common(text) if text.isascii() or self.unknown.isdisjoint(text) else self.any(text)

    def _learn(self, pieces: set[str]) -> None:
        new = sorted((piece.encode(), piece) for piece in pieces if piece not in self.steps)
        for (raw, piece), counts in zip(new, self.merges.prefix_counts(raw for raw, _ in new)):
            if len(raw) > len(piece):  # a prefix ends where no byte continues a character
                counts = [counts[i] for i in range(len(raw)) if raw[i] & 0xC0 != 0x80] + counts[-1:]
            self.steps[piece] = array("i", map(sub, counts[1:], counts)).tobytes()
            self.held += len(piece) + 32
            if piece[0] == "'" and piece[1:].isalpha() or not self.white.isdisjoint(piece[1:]) or piece[0] in self.white and len(piece) == 1:
                self.odd.add(piece)

    def learn(self, texts: list[str]) -> None:
        """Remembers the words between spaces of texts, but for those that white space other than a space begins or ends."""
        white = self.white
        new = set().union(*(text.split(" ") for text in texts)).difference(self.words)
        new = [word for word in new if word and word[0] not in white and word[-1] not in white]
        self._learn({piece for word in new for piece in self.find(" " + word)})
        for word in new:
            whole = self.steps.pop(" " + word, None)  # a piece of its own, which is kept once
            self.words[word] = self._from_pieces(" " + word) if whole is None else whole
            self.held += len(word) + 32

    def _from_pieces(self, part: str) -> bytes:
        """Changes of the count of a part that doesn't depend on what stands beside it."""
        pieces = self.find(part)
        if any(p not in self.steps for p in pieces):
            self._learn(set(pieces))
        joined = b"".join(map(self.steps.__getitem__, pieces))
        odd = [k for k, piece in enumerate(pieces) if piece in self.odd]
        if not odd:
            return joined
        out = np.frombuffer(bytearray(joined), np.int32)
        at = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        for k in odd:
            piece, end = pieces[k], int(at[k])
            if piece[0] not in self.white:  # a contraction, of which a prefix is two pieces
                alone = np.frombuffer(self.steps[piece], np.int32)
                counts = [0, *(self._total(piece[:n]) for n in range(1, len(piece))), int(alone.sum())]
                out[end - len(piece) : end] += np.diff(np.array(counts, np.int32)) - alone
            elif k + 1 < len(pieces) and pieces[k + 1][0] in self.white:
                # as long as nothing follows it, the white space that the next piece begins with belongs to this one
                run = piece + pieces[k + 1][0]
                self._learn({run})
                less = self._sum(self.steps[run]) - self._sum(self.steps[piece]) - int(out[end])
                out[end] += less
                out[end + 1] -= less
        return out.tobytes()

    @staticmethod
    def _sum(changes: bytes) -> int:
        return int(np.frombuffer(changes, np.int32).sum())

    def _total(self, part: str) -> int:
        return self._sum(self._from_pieces(part))

    def _changes(self, part: str) -> np.ndarray:
        """text() for a part without special strings: by words between single spaces, which stand alone, and by pieces around other white space."""
        words = part.split(" ")
        first = words[0]
        alone = bool(first) and first[-1] not in self.white
        try:
            if alone:
                return np.frombuffer(self._from_pieces(first) + b"".join(map(self.words.__getitem__, words[1:])), np.int32)
        except KeyError:
            pass
        self.learn([part])
        whole = [k > 0 and word in self.words for k, word in enumerate(words)]  # others go with the words beside them
        apart = [k for k in range(1, len(words)) if whole[k] and (whole[k - 1] or (k == 1 and alone))]
        out: list[bytes] = []
        for at, to in zip([0, *apart], [*apart, len(words)]):
            one = to == at + 1 and whole[at]
            out.append(self.words[words[at]] if one else self._from_pieces((" " if at else "") + " ".join(words[at:to])))
        return np.frombuffer(b"".join(out), np.int32)

    def text(self, text: str) -> np.ndarray:
        """How the count of tokens changes with each character of text."""
        if not text:
            return np.zeros(0, np.int32)
        if self.special is None or not self.special.search(text):
            return self._changes(text)
        found: list[np.ndarray] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:  # its beginnings are plain text, which lengthens the last piece before it
                before = parts[-1] if (parts := self.find(last)) else ""
                base = self._total(before)
                counts = [0, *(self._total(before + part[:n]) - base for n in range(1, len(part))), 1]
                found.append(np.diff(np.array(counts, np.int32)))
            else:
                found.append(self._changes(part))
            last = part if not i % 2 else ""
        return np.concatenate(found)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > REMEMBERED:
            self._forget()
        self.learn(texts)
        return [self.text(text) for text in texts]


def pack(changes: np.ndarray) -> bytes:
    """Changes of a count in the narrowest integers that hold them, 1, 2 or 4 bytes a character."""
    top = int(np.abs(changes).max()) if len(changes) else 0
    return changes.astype(np.int8 if top < 128 else np.int16 if top < 32768 else np.int32).tobytes()


def unpack(prefixes: bytes, n_chars: int) -> np.ndarray:
    """Tokens of the first i characters, for every i from 0 on."""
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(prefixes) // n_chars] if n_chars else np.int8
    return np.concatenate(([0], np.cumsum(np.frombuffer(prefixes, kind), dtype=np.int64)))


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and prefixes of every row of docs (doc_id, text).

    prefixes holds the change of the count with each character, in 1 byte a character (2 or 4 if a change needs it);
    tokens_within and longest_within read it. Counts are those of the tokenizers library for the vocabulary in the
    file at path, a byte-level BPE, without added begin or end; a special string inside a text is one token. A null
    or empty text has no tokens; rows that repeat are counted each; other columns are left out. The merges, whose number the
    vocabulary fixes, go to all tasks with the code. A text is read at once, so it holds 2 GB at most.
    """
    vocabulary = Vocabulary.read(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in text_chunks(batches):
            sizes = np.diff(text_buffers(batch.column("text"))[1])
            texts = [t or "" for t in batch.column("text").to_pylist()]
            changes = counter.texts(texts)
            totals = [int(c.sum()) for c in changes]
            arrays = [batch.column("doc_id"), pa.array(sizes), pa.array(map(len, changes), pa.int64()), pa.array(totals, pa.int64()), pa.array(map(pack, changes), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefixes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_chars long, n_tokens long, prefixes binary")


def _asked(prefixes: Column, n_chars: Column, asked: Column, answer) -> Column:
    @F.arrow_udf("long")
    def run(held: pa.Array, chars: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = zip(held.to_pylist(), chars.to_pylist(), wanted.to_pylist())
        return pa.array([None if p is None or n is None or w is None else int(answer(unpack(p, n), w)) for p, n, w in rows], pa.int64())

    return run(prefixes, n_chars.cast("long"), asked.cast("long"))


def tokens_within(prefixes: Column, n_chars: Column, chars: Column) -> Column:
    """Tokens of a text's first `chars` characters (all of a shorter text; below 0 as 0), from what prefix_counts stored."""
    return _asked(prefixes, n_chars, chars, lambda counts, n: counts[min(max(n, 0), len(counts) - 1)])


def longest_within(prefixes: Column, n_chars: Column, budget: Column) -> Column:
    """Characters of a text's longest prefix with at most `budget` tokens, from what prefix_counts stored.

    A longer prefix can have fewer tokens than a shorter one, so this is the last that fits, not the last before one that doesn't. A budget below 0 gives 0.
    """
    return _asked(prefixes, n_chars, budget, lambda counts, most: np.flatnonzero(counts <= max(most, 0))[-1])


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every row, from the counts of prefix_counts."""
    return prefix_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
