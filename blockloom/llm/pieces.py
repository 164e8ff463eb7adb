"""Encoding and decoding with a SentencePiece BPE model by a table of each prefix's last token.

Byte-pair encoding has this property: of the pieces that end at a position, exactly one is the last token of the
encoding of the text up to there, and it is the one whose predecessor, the last token of the prefix before it, stays
next to it when the two are encoded together. So one pass of an Aho-Corasick automaton over the text, with a test of
compatibility for the pieces that end at each position, fills a table of last tokens from left to right; the ids are
then read from it backwards. The time is linear in the length of the text.

Two tokens are compatible if no merge across their border comes before the merges that build them. The pieces at the
border are the right halves of the left token and the left halves of the right one, down to single characters.

Pieces never hold a space mark behind another character, nor a character that the vocabulary lacks, so a text falls
into independent chunks (a word with the marks before it). Their encodings are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import slices, table

MARK = "▁"
#: The first space of a run of marks.
RUN = re.compile("(?<=[^ ▁]) ")


class PieceTable:
    """A BPE model with byte fallback, identity normalization and a dummy prefix, from a SentencePiece file."""

    def __init__(self, path: str, max_chunks: int = 600_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.control = {i for i in range(len(self.text)) if sp.is_control(i)}
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(len(self.text)) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        special = self.control | set(self.byte) | {self.unknown}
        self.id = {p: i for i, p in enumerate(self.text) if i not in special}
        if len(self.of_byte) != 256:
            raise ValueError("the model has no byte fallback")
        # Merges come in order of score, ties from left to right: an order of pieces by score alone.
        scores = sorted({sp.get_score(i) for i in self.id.values()}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        self.rank = {i: place[sp.get_score(i)] for i in self.id.values()}
        self.known = frozenset(p for p in self.id if len(p) == 1)
        self.joined: dict[tuple[int, int], int] = {}
        for p, i in self.id.items():
            for at in range(1, len(p)):
                a, b = self.id.get(p[:at]), self.id.get(p[at:])
                if a is not None and b is not None:
                    self.joined[a, b] = i
        # Halves of each piece in its last merge; only pieces that merges reach are tokens.
        self.halves: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            tree = self.merge(p)
            if tree is not None:
                if len(p) > 1:
                    self.halves[i] = tree
                automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()
        self.automaton = automaton
        self.right = {i: self.spine(i, 1) for i in self.id.values()}
        self.left = {i: self.spine(i, 0) for i in self.id.values()}
        self.beside: dict[int, bool] = {}
        self.words = words = not any(MARK in p.lstrip(MARK) for p in self.id)
        free = not any("\n" in p for p in self.id)
        if words and free:
            self.chunk = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        else:
            self.chunk = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if words else r"(?s).+")
        self.max_chunks = max_chunks
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merge(self, piece: str) -> tuple[int, int] | None:
        """The halves of the last merge that builds ``piece`` from its characters, or None if no merge does."""
        if any(c not in self.known for c in piece):
            return None
        parts = [self.id[c] for c in piece]
        last = (parts[0], parts[0])
        while len(parts) > 1:
            best = None
            for at in range(len(parts) - 1):
                whole = self.joined.get((parts[at], parts[at + 1]))
                if whole is not None and (best is None or self.rank[whole] < self.rank[best[0]]):
                    best = whole, at
            if best is None:
                return None
            whole, at = best
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [whole]
        return last

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one border of ``token``, outermost first, each with the rank of the merge that ends it."""
        out, ends = [(token, len(self.text))], token
        while ends in self.halves:
            inner = self.halves[ends][side]
            out.append((inner, self.rank[ends]))
            ends = inner
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart when encoded together: of equal ranks, the merge to the left is first."""
        key = a << 20 | b
        known = self.beside.get(key)
        if known is None:
            known = True
            for x, x_ends in self.right[a]:
                for y, y_ends in self.left[b]:
                    whole = self.joined.get((x, y))
                    if whole is not None and self.rank[whole] < x_ends and self.rank[whole] <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            self.beside[key] = known
        return known

    def encode_known(self, run: str) -> list[int]:
        """Ids of a text whose characters the vocabulary has."""
        last, before, beside, compatible = [-1] * (len(run) + 1), [0] * (len(run) + 1), self.beside, self.compatible
        for end, (token, size) in self.automaton.iter(run):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    left = last[start]
                    if left < 0:
                        continue
                    fits = beside.get(left << 20 | token)
                    if fits is None:
                        fits = compatible(left, token)
                    if not fits:
                        continue
                last[end], before[end] = token, start
        ids, at = [], len(run)
        while at:
            ids.append(last[at])
            at = before[at]
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        if self.known.issuperset(chunk):
            return self.encode_known(chunk)
        ids, start = [], 0
        for at, c in enumerate(chunk):
            if c not in self.known:
                if at > start:
                    ids += self.encode_known(chunk[start:at])
                ids += [self.of_byte[b] for b in c.encode("utf-8", "surrogatepass")]
                start = at + 1
        return ids + (self.encode_known(chunk[start:]) if start < len(chunk) else [])

    def parts(self, text: str) -> Iterator[tuple[int, str, str]]:
        """For each chunk of a text the number of ids, the ids as text, and the ids decoded inside a text."""
        if not text:
            return
        if len(self.chunks) > self.max_chunks:  # chunks in use come back from the older half
            self.older, self.chunks = self.chunks, {}
        get = self.chunks.get
        marked = (part.replace(" ", MARK) for part in (slices(text, RUN) if self.words else [text]))
        chunks = itertools.chain.from_iterable(self.chunk.findall(MARK * (i == 0) + part) for i, part in enumerate(marked))
        for chunk in chunks:
            part = get(chunk)
            if part is None:
                part = self.older.get(chunk)
                if part is None:
                    ids = self.encode_chunk(chunk)
                    part = len(ids), " ".join(map(str, ids)), self.surface(ids)
                if len(chunk) <= 64:
                    self.chunks[chunk] = part
            yield part

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, numbers, _ in self.parts(text) for i in numbers.split()]

    def surface(self, ids: list[int]) -> str:
        """The text of ids, a leading space included. Bytes that are no UTF-8 become U+FFFD one by one."""
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        size = 0
                if not size:
                    out.append("�")
                at += size or 1
            raw.clear()

        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                flush()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.text[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy space before it."""
        first = next((i for i in ids if i not in self.control), None)
        text = self.surface(ids)
        marked = first is not None and first not in self.byte and first != self.unknown and self.text[first].startswith(MARK)
        return text[1:] if marked else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, and SHA-256 of the ids and of the decoded text, from the same ids."""
        n, ids, decoded, first = 1, hashlib.sha256(), hashlib.sha256(), True
        for block in itertools.batched(self.parts(text), 100_000):
            counts, numbers, surface = zip(*block)
            n += sum(counts)
            ids.update((" ".join(numbers) + " ").encode())
            here = "".join(surface)
            decoded.update((here[1:] if first else here).encode("utf-8", "surrogatepass"))  # the dummy space goes
            first = False
        ids.update(str(self.end).encode())
        return n, ids.hexdigest(), decoded.hexdigest()


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One table for each Python worker, which later tasks find again."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encode_texts(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with ``ids``, the end id last. A null text is encoded as an empty one: the end id
    alone. Equal texts get equal ids; an empty table stays empty; ``keep`` may not name the added column."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_table(model_path)
        for b in batches:
            ids = [[*t.encode(x.as_py() or ""), t.end] for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32()))], names=[f.name for f in schema])

    return docs.select(*keep, F.col(text_col).cast("string").alias("piece__text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` of each row with ``decoded``; null ids give an empty text."""
    schema = rows.select(*keep).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_table(model_path)
        for b in batches:
            texts = [t.decode(x.as_py() or []) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return rows.select(*keep, F.col(ids_col).cast("array<int>").alias("piece__ids")).mapInArrow(run, schema)


def round_trips(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256: ``encode_texts`` and ``decode_ids`` in one pass
    that keeps a text's ids chunk by chunk. The same defined results hold."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_table(model_path)
        for b in batches:
            found = [t.digest(x.as_py() or "") for x in b.column(len(keep))]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names=[f.name for f in schema])

    return docs.select(*keep, F.col(text_col).cast("string").alias("piece__text")).mapInArrow(run, schema)


def op4_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 32k BPE model."""
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
