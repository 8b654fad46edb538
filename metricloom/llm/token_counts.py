"""Token counts by a compiled finite-state tokenizer (operator 5).

The byte-pair tokenizer becomes a deterministic transducer over a word's bytes.
Its base is this fact: a sequence of tokens is what merging yields exactly if
each token and each two neighbours, merged on their own, stay as they are.  So
every prefix of a word has one last token that fits the last token before it.
A state holds, for each earlier position at which a vocabulary entry may still
begin, the entry's trie node, the last token there and the number of tokens
since; each transition is annotated with the tokens that it emits (a negative
number takes back), and each final transition with those at a word's end, where
the vocabulary has entries of its own.  States are determinised when first
reached; the tables are cleared at a bound and built again, so that memory is
bounded while results stay the same.

White space resets the transducer.  A text is cut into chunks at fixed sizes.  A
chunk's state map takes what is read before it to what is read after it: its
first fragment completes the word that comes in; its inner words have a fixed
count; its last fragment leaves the state from which the next chunk goes on: the
transducer's state, the letter that may still be the last of its piece, and the
tokens emitted.  (Bytes for which the library's own splitting is asked are kept
from the last point where a word is certain to be split.)  A chunk without white
space only passes its bytes on.  Maps compose associatively; a parallel prefix
scan's tree composes those of a text, and no fragment is copied on the way."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, ship, slices

#: Entries of the word and transition tables of one Python worker.
WORDS, ARCS = 1_000_000, 600_000
CHUNK = 1 << 16
LIMIT = 2048
#: Words longer than this are cut where splitting is certain.
LONG = 1 << 12
#: Where the pre-tokenizer splits whatever stands around: before a digit; after
#: an ASCII letter before ASCII punctuation (but an apostrophe, and the bar of
#: special tokens); between an ideographic comma or stop and an ideograph.
SPLIT = re.compile(rb"(?=[0-9])|(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{}~])|(?<=\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9f])(?=[\xe5-\xe9]|\xe4[\xb8-\xbf])")


def cut_word(word: bytes, most: int = LONG) -> Iterator[bytes]:
    """``word`` in parts of ``most`` bytes and what is left up to the next
    certain split; tokens of the parts are those of the word."""
    at = 0
    while len(word) - at > most and (m := SPLIT.search(word, at + most)):
        yield word[at : m.start()]
        at = m.start()
    yield word[at:] if at else word


class Open(NamedTuple):
    """A word of which a part has been read.  ``count`` tokens are certain.  With
    ``simple``, the transducer is in ``state`` and ``held`` is read but may be
    its piece's last letter; else ``parts`` are the bytes since a certain split."""

    count: int = 0
    simple: bool = True
    state: int = 0
    held: str = ""
    parts: tuple[bytes, ...] = ()
    size: int = 0
    tried: int = LONG
    epoch: int = 0


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the 256 bytes: itself
    for a visible Latin-1 character, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """The compiled tokenizer; ``count(word)`` runs one word through it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.trie: list[dict[str, int]] = [{}]
        self.inner: list[str | None] = [None]
        self.final: list[str | None] = [None]
        for entry in model["vocab"]:
            last = bool(self.end) and entry.endswith(self.end)
            node = 0
            for letter in entry[: -len(self.end)] if last else entry:
                if letter not in self.trie[node]:
                    self.trie[node][letter] = len(self.trie)
                    self.trie.append({})
                    self.inner.append(None)
                    self.final.append(None)
                node = self.trie[node][letter]
            (self.final if last else self.inner)[node] = entry
        self.fits: dict[tuple[str | None, str], bool] = {}
        # simple words: visible ASCII without an apostrophe, which needs the library's own
        # split, and without what special tokens begin with
        self.runs = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
        self.simple = re.compile(rb"[!-&(-;=-~]+")
        self.words: dict[bytes, int] = {}
        self.epoch = 0
        self._clear()

    def _clear(self) -> None:
        self.epoch += 1
        self.states: list[tuple] = [((), None)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.size = 0
        self.ends: dict[tuple[int, str], int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first."""
        while len(symbols) > 1:
            order = [self.ranks.get(p, 1 << 60) for p in zip(symbols, symbols[1:], strict=False)]
            if (rank := min(order)) == 1 << 60:
                break
            at = order.index(rank)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def letters(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = list(token[: -len(self.end)])
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fit(self, last: str | None, token: str) -> bool:
        if (last, token) not in self.fits:
            if len(self.fits) >= ARCS:
                self.fits.clear()
            want = [token] if last is None else [last, token]
            self.fits[last, token] = self.merged([x for t in want for x in self.letters(t)]) == want
        return self.fits[last, token]

    def _open(self, state: int):
        """(trie node, last token, tokens since) of each position at which an
        entry may still begin, the present one too."""
        alive, last = self.states[state]
        return (*alive, (0, last, 0))

    def arc(self, state: int, letter: str) -> tuple[int, int]:
        """A new transition: next state, tokens emitted."""
        on = [(child, last, n) for node, last, n in self._open(state) if (child := self.trie[node].get(letter)) is not None]
        token, total = next((t, n + 1) for child, last, n in on if (t := self.inner[child]) is not None and self.fit(last, t))
        new = (tuple((child, last, n - total) for child, last, n in on if self.trie[child]), token)
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.arcs.append({})
        self.size += 1
        self.arcs[state][letter] = to = self.number[new], total
        return to

    def last_arc(self, state: int, letter: str) -> int:
        """Tokens emitted by the word's last letter."""
        if (state, letter) not in self.ends:
            entries = self.final if self.end else self.inner
            on = ((self.trie[node].get(letter), last, n) for node, last, n in self._open(state))
            self.ends[state, letter] = next(n + 1 for child, last, n in on if child is not None and (t := entries[child]) is not None and self.fit(last, t))
        return self.ends[state, letter]

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token in byte letters."""
        if self.size + len(self.ends) > ARCS:
            self._clear()
        arcs = self.arcs
        state = count = 0
        for letter in piece[:-1]:
            state, emitted = arcs[state].get(letter) or self.arc(state, letter)
            count += emitted
        return count + self.last_arc(state, piece[-1])

    def _fresh(self, word: bytes) -> int:
        if self.simple.fullmatch(word):
            return sum(self.piece(m.group()) for m in self.runs.finditer(word.decode().lower()))
        text, count, at = word.decode("utf-8", "replace"), 0, 0
        for m in [*self.special.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                count += sum(self.piece(p) for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)) if p)
            if m:
                count, at = count + 1, m.end()
        return count

    def count(self, word: bytes) -> int:
        """Tokens of a word without ASCII white space."""
        n = self.words.get(word)
        if n is None:
            n = sum(map(self._fresh, cut_word(word))) if word else 0
            if len(word) <= 64:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = n
        return n

    def read(self, word: Open, data: bytes) -> Open:
        """``word`` with ``data`` read."""
        if word.simple and self.simple.fullmatch(data):
            if self.size + len(self.ends) > ARCS:
                self._clear()
            word = self._current(word)
            count, state, held = word.count, word.state, word.held
            arcs = self.arcs
            for letter in data.decode().lower():
                if held:
                    if held.isalpha() and letter.isalpha() or not (held.isalnum() or letter.isalnum()):
                        state, emitted = arcs[state].get(held) or self.arc(state, held)
                    else:
                        state, emitted = 0, self.last_arc(state, held)
                    count += emitted
                held = letter
            return Open(count, True, state, held, (*word.parts, data), word.size + len(data), LONG, self.epoch)
        parts, size, count, tried = (*word.parts, data), word.size + len(data), 0 if word.simple else word.count, word.tried
        if size > tried:
            *sure, rest = cut_word(b"".join(parts))
            count += sum(map(self._fresh, sure))
            parts, size = (rest,), len(rest)
            tried = max(LONG, 2 * size)  # a word without certain splits isn't joined again and again
        return Open(count, False, 0, "", parts, size, tried)

    def _current(self, word: Open) -> Open:
        """``word`` in the present numbers of states."""
        if word.simple and word.parts and word.epoch != self.epoch:
            word = self.read(Open(epoch=self.epoch), b"".join(word.parts))
        return word

    def close(self, word: Open) -> int:
        """Tokens of ``word`` if it ends here."""
        if word.simple:
            word = self._current(word)
            return word.count + (self.last_arc(word.state, word.held) if word.held else 0)
        return word.count + sum(map(self._fresh, cut_word(b"".join(word.parts))))

    def state_map(self, chunk: bytes) -> tuple[tuple[bytes, ...], int | None, Open]:
        """(first fragment in parts, tokens of the inner words, the word left
        open); without white space the number is None and all is first fragment."""
        words = chunk.split()
        if not words or (len(words) == 1 and len(words[0]) == len(chunk)):
            return ((chunk,), None, Open()) if words or not chunk else ((), 0, Open())
        first = (words.pop(0),) if not chunk[:1].isspace() else ()
        last = self.read(Open(), words.pop()) if words and not chunk[-1:].isspace() else Open()
        known = self.words
        return first, sum(n if (n := known.get(w)) is not None else self.count(w) for w in words), last

    def then(self, a: tuple, b: tuple) -> tuple:
        """The composed map."""
        if a[1] is None:
            return ((*a[0], *b[0]), b[1], b[2])
        word = a[2]
        for part in b[0]:
            word = self.read(word, part)
        return (a[0], a[1], word) if b[1] is None else (a[0], a[1] + self.close(word) + b[1], b[2])

    def text(self, text: bytes) -> int:
        """Tokens of a whole text."""
        if len(text) <= CHUNK:
            known = self.words
            return sum(n if (n := known.get(w)) is not None else self.count(w) for w in text.split())
        start = ((), 0, Open())  # before a text, as after white space
        maps = [start, *(self.state_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK))]
        while len(maps) > 1:
            maps = [self.then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1] + self.close(maps[0][2])


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``documents`` (text, ...) with n_bytes (UTF-8), n_tokens and over_limit
    (n_tokens > limit), tokens as the library gives them for the file at
    ``path`` without added special tokens; columns of these names are replaced.

    Memory: the text, its chunks' maps and, of a word beyond ASCII, about a
    hundred bytes for each byte between two certain splits.
    Null and empty texts have none.  Rows don't depend on each other: ids may
    repeat or be null.  The file is a BPE vocabulary whose texts are split at
    white space before merging, and must be at ``path`` on every executor."""
    ship(documents.sparkSession)
    extra = ["n_bytes", "n_tokens", "over_limit"]
    names = [c for c in documents.columns if c not in extra]

    def run(batches):
        counter = compiled(path)
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            n = [counter.text(t) for t in texts]
            columns = [*(batch.column(c) for c in names), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *extra])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in names)
    return documents.select(*names).mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")
