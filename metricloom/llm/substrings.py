"""Substring dedup by recompression (operator 10).

A word sequence is parsed as in recompression, level by level.  A level merges
runs of one symbol, then pairs whose first symbol falls in the left class and
whose second falls in the right class of a global two-way split of the
alphabet.  Symbols are named by hashing their parts, hence the same in every
task and on every attempt, without a dictionary that travels; a run's class and
comparison take one occurrence for all.  Equal substrings therefore have equal
symbols inside, up to a few words from their ends: whether a level-2 symbol ends
between words p-1 and p depends on words p-2 .. p+1 alone.  Two levels are what
a window of WINDOW words can decide for itself; a third would need twelve words
around each end.  So the high-level symbol of a window is the phrase of CORE
words around one end of a level-2 symbol in its middle: of up to SPAN ends the
one whose phrase has the least name (all middle positions where a long run
leaves no end).  It depends on the window's own words alone, so documents that
share a window share its high-level symbol.

Spark rounds: (1) names of high-level symbols meet, by hash range, and the
shared ones go back to their documents; (2) only windows under shared symbols
are named, meet under their symbol (64 bits of it and 64 of the window) and
reveal the smallest document that has each; (3) covered words are dropped.
Names travel as packed binary columns, one row for each slice of a task and
range; there are as many ranges as the texts' counted bytes ask for.  What a
slice of some thousand documents can settle alone (a name that two of its
documents have; a window that its smaller document has) goes straight to the
result, and each slice sends one document for each name, so that a passage in a
third of all documents doesn't fill one task."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix, odd, ship, slices, small, window_hashes, word_hashes, written

WINDOW = 13
CORE, BEFORE = 8, 3
SPAN = WINDOW - CORE + 1
#: Bytes of text for each hash range of the rounds.
RANGE_BYTES = 32 << 20
KEY = ["doc_id", "_variant"]


# -- the parse ----------------------------------------------------------


def _left(names: np.ndarray, level: int) -> np.ndarray:
    """Whether each symbol is in the left class of a level's split."""
    return (mix(names * odd(900 + level)) & np.uint64(1)).astype(bool)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a run (equal symbols) or of a pair."""
    return np.where(a == b, mix(a * odd(910)), mix(a * odd(911) + b * odd(912)))


def _ends(before: np.ndarray, after: np.ndarray, level: int) -> np.ndarray:
    """Whether a level keeps symbols apart: neither run nor pair joins them."""
    return (before != after) & ~(_left(before, level) & ~_left(after, level))


def symbol_ends(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level 1, level 2): ends[p] tells whether a symbol of that level ends
    before word p, 0 <= p <= len(words).  Level 2 reads the names of the level-1
    symbols on both sides, of each two words at most."""
    n = len(words)
    one = np.ones(n + 1, bool)
    two = np.ones(n + 1, bool)
    if n > 1:
        one[1:n] = _ends(words[:-1], words[1:], 1)
        before, after = words[:-1].copy(), words[1:].copy()
        pairs = _merged(words[:-1], words[1:])
        # position p is place p - 1: the symbol before it may begin at word p - 2
        long = ~one[1 : n - 1]
        before[1:] = np.where(long, pairs[:-1], before[1:])
        after[:-1] = np.where(~one[2:n], pairs[1:], after[:-1])
        two[1:n] = one[1:n] & _ends(before, after, 2)
    return one, two


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the high-level symbol, its name) for each window of WINDOW
    words, by the window's start."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    names = window_hashes(words, CORE, 1)  # by the first word; the end is BEFORE words later
    ends = symbol_ends(words)[1]
    ranked = np.where(ends[BEFORE : BEFORE + len(names)], names >> np.uint64(1), (names >> np.uint64(1)) | np.uint64(1 << 63))
    best, at = ranked[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, SPAN):
        less = ranked[j : j + n] < best
        best[less] = ranked[j : j + n][less]
        at[less] = j
    at += np.arange(n)
    return at, names[at]


# -- packed columns -----------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one value, byte plane by byte plane."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return struct.pack("<I", len(columns[0])) + zstandard.compress(b"".join(planes), 1)


def unpacked(values: Iterable[bytes | None], *kinds: type) -> list[np.ndarray]:
    """The columns of several packed values, one after the other."""
    out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for value in values:
        if value:
            (n,) = struct.unpack_from("<I", value)
            data, at = np.frombuffer(zstandard.decompress(value[4:]), np.uint8), 0
            for i, k in enumerate(kinds):
                size = np.dtype(k).itemsize
                out[i].append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).reshape(-1).view(k))
                at += n * size
    return [np.concatenate(x) for x in out]


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small numbers where x ascends."""
    return np.diff(x, prepend=x.dtype.type(0))


def _ranges(names: np.ndarray, n: int) -> np.ndarray:
    """Hash ranges 0 .. n-1."""
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _parts(range_of: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(range, rows) of each range, rows in their order."""
    order = np.argsort(range_of, kind="stable")
    cuts = np.flatnonzero(np.diff(range_of[order])) + 1
    return [(int(range_of[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows)]


def _grouped(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups) of rows with equal names, the last one first."""
    order = np.lexsort(same)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in same:
        new[1:] |= x[order][1:] != x[order][:-1]
    return order, np.flatnonzero(new)


def _each(first: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.r_[first, n]))


def _low(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least id of its group, for each row in order."""
    return _each(first, np.minimum.reduceat(ids, first), len(ids))


SENT = pa.schema([("part", pa.int32()), ("data", pa.binary()), ("sure", pa.binary())])
SENT_SQL = "part int, data binary, sure binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class Slice:
    """Documents of a slice: ids, variants and numbers of values of each."""

    def __init__(self, batch: pa.RecordBatch):
        self.docs = np.array(batch.column("doc_id").to_pylist(), np.int64)
        self.variants = np.array(batch.column("_variant").to_pylist(), np.int64)
        # documents in ascending order, so that differences of ids are small
        order = np.argsort(self.docs, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.words: list[np.ndarray] = []
        for text in as_bytes(batch.column("text")):
            words = text.split() if text else []
            self.words.append(word_hashes(words, len(words)))

    def sent(self, parts: int, range_of: np.ndarray, row: np.ndarray, columns: list[np.ndarray], sure_row: np.ndarray, sure: list[np.ndarray]) -> pa.RecordBatch:
        """Rows of SENT: ``columns`` by range, and what is settled by any range."""
        out = {part: [part, self._pack(row[at], [c[at] for c in columns]), None] for part, at in _parts(range_of)}
        if len(sure_row):
            part = int(_ranges(mix(self.docs[:1].view(np.uint64)), parts)[0])
            out.setdefault(part, [part, None, None])[2] = self._pack(sure_row, sure)
        return _rows([tuple(r) for r in out.values()], SENT)

    def _pack(self, row: np.ndarray, columns: list[np.ndarray]) -> bytes:
        order = np.argsort(self.rank[row], kind="stable")
        row = row[order]
        return packed(_steps(self.docs[row]), self.variants[row], *(c[order] for c in columns))


def _read(values: Iterable[bytes | None], *kinds: type) -> list[np.ndarray]:
    """(docs, variants, columns) of packed values."""
    parts = [unpacked([v], np.int64, np.int64, *kinds) for v in values if v]
    parts = [[np.cumsum(p[0]), *p[1:]] for p in parts]
    empty = [np.empty(0, k) for k in (np.int64, np.int64, *kinds)]
    return [np.concatenate(c) for c in zip(empty, *parts, strict=True)]


def _back(docs: np.ndarray, variants: np.ndarray, values: np.ndarray, parts: int) -> pa.Table:
    """Values on their way to their documents: one row for each range."""
    rows = []
    for part, at in _parts(_ranges(mix(docs.view(np.uint64)), parts)):
        at = at[np.lexsort((values[at], variants[at], docs[at]))]
        rows.append((part, packed(_steps(docs[at]), variants[at], values[at]), None))
    return pa.Table.from_batches([_rows(rows, SENT)], SENT)


def _gathered(df: DataFrame, kind: type, name: str, parts: int) -> DataFrame:
    """(doc_id, _variant, name): one row for each document, its values packed."""
    schema = pa.schema([("doc_id", pa.int64()), ("_variant", pa.int64()), (name, pa.binary())])

    def gather(rows):
        docs, variants, values = _read(rows.column("data").to_pylist(), kind)
        out = []
        if len(docs):
            order, first = _grouped(docs, variants)
            for at in np.split(order, first[1:]):
                out.append((int(docs[at[0]]), int(variants[at[0]]), packed(np.sort(values[at]))))
        return pa.Table.from_batches([_rows(out, schema)], schema)

    grouped = df.repartitionById(parts, F.col("part")).groupBy("part")
    return written(grouped.applyInArrow(gather, f"doc_id long, _variant long, {name} binary"), name)


# -- the rounds ---------------------------------------------------------


def _short(names: np.ndarray, parts: int) -> np.ndarray:
    """The range and the lower 32 bits of a name: what round 1 compares."""
    return (names & np.uint64(0xFFFFFFFF)) | _ranges(names, parts).astype(np.uint64) << np.uint64(32)


def _flat(lists: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each value."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.empty(0, kind), *lists])


def covered_words(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, _variant, _starts): for each document that has any, the starts of
    windows whose words also start a window in a document with a smaller id, as
    packed unsigned 32-bit integers.  ``docs``: doc_id, _variant, text."""

    def symbols(batches):
        for batch in slices(batches, "text"):
            s = Slice(batch)
            row, names = _flat([np.unique(anchors(w)[1]) for w in s.words], np.uint64)
            if len(names):
                docs = s.docs[row]
                order, first = _grouped(docs, names)
                row, names, docs = row[order], names[order], docs[order]
                new = np.zeros(len(names), bool)
                new[0] = True
                new[1:] = names[1:] != names[:-1]
                first = np.flatnonzero(new)
                sure = _low(docs, first) < _each(first, np.maximum.reduceat(docs, first), len(docs))
                # the upper 32 bits choose the range and the lower 32 travel, with the least document
                yield s.sent(parts, _ranges(names[first], parts), row[first], [names[first].astype(np.uint32)], row[sure], [_short(names[sure], parts)])

    def shared(table):
        """Names that two documents have; each goes back to its documents."""
        docs, variants, names = _read(table.column("data").to_pylist(), np.uint32)
        sure_docs, sure_variants, sure = _read(table.column("sure").to_pylist(), np.uint64)
        if len(docs):
            order, first = _grouped(names)
            docs, variants, names = docs[order], variants[order], names[order]
            keep = _low(docs, first) < _each(first, np.maximum.reduceat(docs, first), len(docs))
            part = np.uint64(table.column("part")[0].as_py())
            sure_docs, sure_variants, sure = np.r_[sure_docs, docs[keep]], np.r_[sure_variants, variants[keep]], np.r_[sure, names[keep].astype(np.uint64) | part << np.uint64(32)]
        return _back(sure_docs, sure_variants, sure, parts)

    sent = docs.mapInArrow(symbols, SENT_SQL)
    found = _gathered(sent.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(shared, SENT_SQL), np.uint64, "names", parts)

    def named(batches):
        for batch in slices(batches, "text"):
            s = Slice(batch)
            symbol, window, starts = [], [], []
            for words, want in zip(s.words, batch.column("names").to_pylist(), strict=True):
                own = anchors(words)[1]
                at = np.flatnonzero(np.isin(_short(own, parts), unpacked([want], np.uint64)[0]))
                symbol.append(own[at])
                window.append(window_hashes(words, WINDOW, 2)[at])
                starts.append(at.astype(np.uint32))
            row, symbol = _flat(symbol, np.uint64)
            window, starts = np.concatenate(window), np.concatenate(starts)
            if len(row):
                order, first = _grouped(window, symbol)
                row, symbol, window, starts = row[order], symbol[order], window[order], starts[order]
                docs = s.docs[row]
                sure = docs > _low(docs, first)
                # of what is left, in the order of the text: its symbols and starts repeat or ascend
                left = np.flatnonzero(~sure)
                left = left[np.lexsort((starts[left], row[left]))]
                yield s.sent(parts, _ranges(symbol[left], parts), row[left], [symbol[left], window[left], starts[left]], row[sure], [starts[sure]])

    def later(table):
        """Starts of windows whose name a smaller document also has."""
        docs, variants, symbol, window, starts = _read(table.column("data").to_pylist(), np.uint64, np.uint64, np.uint32)
        sure_docs, sure_variants, sure = _read(table.column("sure").to_pylist(), np.uint32)
        if len(docs):
            order, first = _grouped(window, symbol)
            docs, variants, starts = docs[order], variants[order], starts[order]
            more = docs > _low(docs, first)
            sure_docs, sure_variants, sure = np.r_[sure_docs, docs[more]], np.r_[sure_variants, variants[more]], np.r_[sure, starts[more]]
        return _back(sure_docs, sure_variants, sure, parts)

    # joined by a shuffle at every size: names and starts grow with the texts
    met = docs.join(found, KEY).mapInArrow(named, SENT_SQL)
    return _gathered(met.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(later, SENT_SQL), np.uint32, "_starts", parts)


def drop_repeats(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """``documents`` (doc_id, text, ...) without words that windows of WINDOW
    words repeat from a document with a smaller id.

    Adds n_words, n_removed and kept_text (kept words joined by one space);
    columns of these names are replaced.
    Words are runs of bytes other than the six ASCII white space characters.
    Windows are judged on the input.  Null and empty texts have no words and an
    empty kept_text; rows with a null id are kept whole and remove nothing; rows
    that share an id, with equal texts or not, remove nothing from each other,
    and each loses the words that a smaller id covers in its own text.
    ``parts``: hash ranges of the rounds; by default one for each shuffle
    partition, or for RANGE_BYTES of text if these are more.  The columns _variant
    and _starts are used inside and must not be given."""
    spark = ship(documents.sparkSession)
    names = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept_text")]
    hashed = F.xxhash64("text")
    ids = documents.filter("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high"), F.sum(F.octet_length("text")).alias("bytes"))
    ids = written(ids, "ids")
    if parts is None:
        size = ids.agg(F.sum("bytes")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # ids with unlike texts: their rows are told apart by the text's hash
    unlike = written(ids.filter("low <> high").select("doc_id"), "unlike")
    rows = documents.select(*names)
    if unlike.isEmpty():
        rows = rows.withColumn("_variant", F.lit(0).cast("long"))
    else:
        rows = rows.join(small(unlike.withColumn("_unlike", F.lit(True)), 16), "doc_id", "left")
        rows = rows.select(*names, F.when(F.col("_unlike"), F.coalesce(hashed, F.lit(0))).otherwise(0).cast("long").alias("_variant"))
    starts = covered_words(rows.filter("doc_id is not null and text is not null").select(*KEY, "text"), parts)
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut(batches):
        for batch in slices(batches, "text"):
            out = []
            for text, got in zip(as_bytes(batch.column("text")), batch.column("_starts").to_pylist(), strict=True):
                kept = words = text.split() if text else []
                if got:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(unpacked([got], np.uint32)[0])
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    gone = np.cumsum(edge)[: len(words)] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            extra = _rows(out, schema)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra.columns], names=[*names, *schema.names])

    joined = rows.join(starts, KEY, "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in names)
    return joined.mapInArrow(cut, f"{kinds}, n_words long, n_removed long, kept_text string")


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the query's contract."""

    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
