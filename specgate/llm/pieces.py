"""Texts to the ids of a sentencepiece BPE model, and back.

The model merges the adjacent pair whose joined piece has the best score, leftmost first, until no pair is a piece. Two
tokens are compatible if merging their joined text anew gives the same two. A sequence of tokens is the encoding of its text
just when all its neighbours are compatible: the first merge across a border would be the best of the whole text, so also the
best of the two tokens at that border. So the text is encoded left to right: an Aho-Corasick automaton gives the longest
piece at every place; a piece that is not compatible with the token before it, or ends where the rest has failed before,
gives way to the next shorter one; if none is left, the place is marked in a bitfield of failed places and the last token is
taken back. Every place fails once at most, so the work is linear in the text. Pieces that merging does not give from their
own text never come out and are not in the automaton. A character outside the vocabulary is a token of its own, written as
its bytes.

No piece of the usual models holds a word's start behind other characters, or joins a line break or digit with others.
Where the vocabulary shows that, texts are cut there first and a worker encodes each distinct chunk once.

Defined cases: a null or empty text has the end id alone and decodes to an empty text; repeated rows are encoded each for
itself; an empty table gives no rows; extra columns stay untouched, but for one that has the name
of the result, which is replaced. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgate.llm.common import ARROW_BYTES, by_bytes, on_workers

SPACE = "▁"
#: Chunks of up to this many characters are remembered, and so many of them; they change the speed only.
CHUNK_CHARS, CHUNKS = 32, 300_000
#: Compatibilities that are remembered.
PAIRS = 1_000_000
#: Bytes of text that a worker encodes at once; their ids take up to some ten times that.
BATCH_BYTES = 1 << 20


class Pieces:
    """The encoder and decoder of a model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        normal = {n: i for i, n in enumerate(self.names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(model.is_unused(i) for i in normal.values()):
            raise ValueError("the model has unused pieces")
        self.scores = {n: model.get_score(i) for n, i in normal.items()}
        self.bigrams = {n[i : i + 2] for n in normal for i in range(len(n) - 1)}
        #: Tokens: pieces by their id, then characters that are no piece; by text and by number.
        self.tokens = {n: i for n, i in normal.items() if self.merge(n) == [n]}
        self.texts = {i: n for n, i in self.tokens.items()}
        self.lengths = {i: len(n) for i, n in self.texts.items()}
        self.ids = {i: (i,) for i in self.texts}
        self.shorter: dict[int, int] = {}
        for text in list(self.tokens):
            if len(text) > 1:
                prefix = next((p for k in range(len(text) - 1, 0, -1) if (p := text[:k]) in self.tokens), text[0])
                self.shorter[self.tokens[text]] = self._token(prefix)
        self.automaton = ahocorasick.Automaton()
        for text, token in self.tokens.items():
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.chunks = self._pattern()
        self.controls = {i for i in range(size) if model.is_control(i)}
        self.surface = [n.replace(SPACE, " ").encode() for n in self.names]
        for value, i in self.byte_ids.items():
            self.surface[i] = bytes([value])
        self.surface[model.unk_id()] = model.decode([model.unk_id()]).encode()

    def _pattern(self) -> re.Pattern:
        """Chunks whose borders no piece crosses: no piece holds the characters on both sides of one next to each other."""
        if any(b[1] == SPACE != b[0] for b in self.bigrams):
            return re.compile(".+", re.DOTALL)
        single = [c for c in map(chr, range(128)) if not any(c in b for b in self.bigrams)]
        single = "".join(map(re.escape, single))
        return re.compile(f"{SPACE}*[^{SPACE}{single}]+|{SPACE}+" + (f"|[{single}]" if single else ""))

    def _token(self, text: str) -> int:
        """The number of a piece or character."""
        if text not in self.tokens:
            token = len(self.names) + ord(text)
            self.texts[token], self.lengths[token] = text, 1
            self.ids[token] = tuple(self.byte_ids[b] for b in text.encode())
            return token
        return self.tokens[text]

    def merge(self, text: str) -> list[str]:
        """The merges of the model on a short text, one by one."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are next to each other."""
        a, b = self.texts[left], self.texts[right]
        found = a[-1] + b[0] not in self.bigrams or self.merge(a + b) == [a, b]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[left, right] = found
        return found

    def tokens_of(self, text: str) -> list[int]:
        """The tokens of a text by backtracking."""
        n, longest = len(text), {}
        for end, (token, length) in self.automaton.iter(text):
            longest[end + 1 - length] = token  # a later end is a longer piece
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        place, last = 0, None
        token = longest[0] if 0 in longest else self._token(text[0])
        while True:
            end = place + lengths[token]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and last is not None:
                fits = compatible.get((last, token))
                if fits is None:
                    fits = self.fits(last, token)
            if fits:
                out.append(token)
                place, last = end, token
                if place == n:
                    return out
                token = longest[place] if place in longest else self._token(text[place])
                continue
            while token not in shorter:
                failed[place >> 3] |= 1 << (place & 7)
                token = out.pop()
                place -= lengths[token]
                last = out[-1] if out else None
            token = shorter[token]

    def encode(self, text: str) -> array:
        """The ids of a text, without an end id."""
        known, out = self.known, bytearray()
        for chunk in self.chunks.findall(self.model.normalize(text)):
            ids = known.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                known = self.known
            out += ids
        return array("i", bytes(out))

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk that is not known, as 32-bit numbers. What the last clearing but one has left is still known."""
        ids = self.former.get(chunk)
        if ids is None:
            ids = array("i", chain.from_iterable(map(self.ids.__getitem__, self.tokens_of(chunk)))).tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self.known) >= CHUNKS:
                self.former, self.known = self.known, {}
            self.known[chunk] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of any ids. Bytes that are no character, also as a control token parts them, are left to the library."""
        if ids and ids[-1] == self.end:
            ids = ids[:-1]
        if not self.controls.isdisjoint(ids):
            return self.model.decode(ids)
        try:
            text = b"".join(map(self.surface.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.model.decode(ids)
        return text[1:] if ids and self.names[ids[0]][0] == SPACE else text  # the space that encoding has put first


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _encoded(batches: Iterator[pa.RecordBatch], text: str, name: str, path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in by_bytes(batches, text, BATCH_BYTES):
        ids, offsets = array("i"), array("i", [0])
        for t in batch.column(text).to_pylist():
            if t:
                ids += model.encode(t)
            ids.append(model.end)
            offsets.append(len(ids))
        values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
        yield _with(batch, name, pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), values))


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, name: str, path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        column = batch.column(ids)
        texts = (model.decode([] if i is None else i.to_numpy().tolist()) for i in (c.values for c in column))
        yield _with(batch, name, pa.array(texts, pa.string()))


def encode(docs: DataFrame, text: str = "text", ids: str = "piece_ids", path: str | None = None) -> DataFrame:
    """The rows with the ids of their text and the end id."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    docs = docs.drop(ids)
    kind = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(on_workers(_encoded, text, ids, path or default_path()), kind)


def decode(rows: DataFrame, ids: str = "piece_ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """The rows with the text of their ids; no text for null."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    rows = rows.drop(text)
    kind = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    return rows.mapInArrow(on_workers(_decoded, ids, text, path or default_path()), kind)


def op11_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = decode(encode(docs).drop("text"))
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("piece_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
