"""SentencePiece encoding and decoding by a table of each prefix's last token.

For merge-type models, a text's encoding ends, at every prefix, in one certain token: of the tokens that end there, the one whose
left neighbour (the last token of the prefix before it) is compatible with it. Two tokens are compatible if the encoding of their
concatenation is just these two. So one walk over the text fills the table, from the matches of an automaton of all pieces, and the
ids are read from it backwards. The walk is linear in the text, however long a word is.

Words repeat, so a worker keeps the result of short words, a bounded number of them. A text is cut before a run of marks for spaces,
where no piece reaches across; a vocabulary with such pieces is walked in whole texts.

Null texts count as empty, and an empty text has no tokens. Other columns are not read, repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from setscope.llm.common import fields, worker_object

MARK = "▁"
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 700_000, 48, 400_000
#: Before the ids of a word that is not decoded to itself.
ODD = "!"


class PieceTable:
    """Encodes and decodes with one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules, kind = spec.normalizer_spec, {n: v.number for n, v in spec.SentencePiece.Type.DESCRIPTOR.values_by_name.items()}
        known = {kind[n] for n in ("NORMAL", "UNKNOWN", "CONTROL", "BYTE")}
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        if spec.trainer_spec.model_type != 2 or rules.remove_extra_whitespaces or not plain or {p.type for p in spec.pieces} - known:
            raise ValueError("only merge-type models with unchanged text, a leading space and no pieces set by users are supported")
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind["NORMAL"]}
        # A better score merges first.
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == kind["NORMAL"]}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind["BYTE"]}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kind["UNKNOWN"])
        if not spec.trainer_spec.byte_fallback:
            self.bytes = {}
        self.surface = {i: p for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_surface = spec.trainer_spec.unk_surface
        self.steps: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, str] = {}
        self.spaced = {i: p.replace(MARK, " ") for i, p in self.surface.items()}
        self.digits = [str(i) for i in range(len(spec.pieces))]
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            # Pieces that their own text does not encode to can never be a token.
            if len(piece) > 1 and self.merges(piece) is not None:
                self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.cut = all(MARK not in p.lstrip(MARK) for p in self.ids)

    def merges(self, piece: str) -> tuple | None:
        """Merges that build a piece from its characters: (rank, rightmost symbol, leftmost symbol) before each and at the end."""
        if piece in self.steps:
            return self.steps[piece]
        symbols, out, rank = list(piece), [], self.rank
        while len(symbols) > 1:
            found = [(r, i) for i in range(len(symbols) - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
            if not found:
                break
            r, i = min(found)
            out.append((r, symbols[-1], symbols[0]))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        out.append((float("inf"), symbols[-1], symbols[0]))
        self.steps[piece] = tuple(out) if len(symbols) == 1 else None
        return self.steps[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of ``left + right`` is these two: no merge across wins before either is complete."""
        a, b, i, j, rank, out = self.merges(left), self.merges(right), 0, 0, self.rank, True
        while True:
            (next_a, x, _), (next_b, _, y) = a[i], b[j]
            across = rank.get(x + y)
            # Of equal ranks the leftmost merges first.
            if across is not None and across < next_a and across <= next_b:
                out = False
                break
            if next_a == next_b == float("inf"):
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = out
        return out

    def tokens(self, text: str) -> list[str]:
        """Tokens of an escaped text, as pieces; a character outside the vocabulary is a token of its own."""
        n, known, compatible = len(text), self.pairs.get, self.compatible
        last: list[str] = [""] * (n + 1)
        for end, piece in self.matches.iter(text):
            end += 1
            if last[end]:
                continue
            before = end - len(piece)
            if before:
                pair = last[before] or text[before - 1], piece
                fits = known(pair)
                if fits is None:
                    fits = compatible(*pair)
                if not fits:
                    continue
            last[end] = piece
        out, at = [], n
        while at:
            out.append(last[at] or text[at - 1])
            at -= len(out[-1])
        return out[::-1]

    def token_ids(self, tokens: list[str]) -> list[int]:
        out = [self.ids.get(t) for t in tokens]
        if None not in out:
            return out
        each = ([i] if i is not None else [self.bytes.get(b, self.unknown) for b in t.encode()] for t, i in zip(tokens, out, strict=True))
        return [i for ids in each for i in (ids if self.bytes else ids[:1])]

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids with the leading space still there; bytes that form no character become U+FFFD, one each."""
        out = [self.spaced.get(i) for i in ids]
        if None not in out:
            return "".join(out)
        out, at = [], 0
        while at < len(ids):
            if ids[at] in self.byte_of:
                run = bytearray()
                while at < len(ids) and ids[at] in self.byte_of:
                    run.append(self.byte_of[ids[at]])
                    at += 1
                out.append(_utf8(bytes(run)))
            else:
                out.append(self.spaced.get(ids[at], self.unknown_surface))
                at += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        out = self.pieces_text(ids)
        return out[1:] if ids and self.surface.get(ids[0], "").startswith(MARK) else out

    def word(self, word: str) -> str:
        """Ids of a segment, given without its first mark, joined by commas; marked if it is not decoded to itself."""
        ids = self.token_ids(self.tokens(MARK + word))
        got = ",".join([self.digits[i] for i in ids])
        if self.pieces_text(ids) != " " + word:
            got = ODD + got
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def segments(self, text: str) -> list[str]:
        """Segments of a text without their first mark."""
        if self.cut and MARK not in text and "  " not in text and text[:1] != " ":
            return text.split(" ")
        text = MARK + text.replace(" ", MARK)
        return [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", text)] if self.cut else [text[1:]]

    def encode_decode(self, text: str | None) -> tuple[str, str]:
        """Ids joined by commas and the text decoded from them."""
        if not text:
            return "", ""
        segments, known, word = self.segments(text), self.words.get, self.word
        ids = ",".join([known(s) or word(s) for s in segments])
        if ODD not in ids:
            return ids, " ".join(segments)
        ids = ids.replace(ODD, "")
        return ids, self.decode([int(i) for i in ids.split(",")])

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_decode(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        ids, decoded = self.encode_decode(text)
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _table(model: bytes) -> PieceTable:
    return worker_object(("pieces", hashlib.sha256(model).hexdigest()), lambda: PieceTable(model))


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of each text. The model file, read by the driver, travels with the tasks."""
    model = open(model_path, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for b in batches:
            ids = [table.encode(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return fields(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give an empty text."""
    model = open(model_path, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for b in batches:
            texts = [table.decode(i or []) for i in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return fields(encoded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, text string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encodes and decodes in one pass and keeps the digests only."""
    model = open(model_path, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for b in batches:
            n, ids, texts = zip(*[table.digests(t.as_py()) for t in b["text"]], strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return fields(docs, doc_id="bigint", text="string").mapInArrow(run, schema)
