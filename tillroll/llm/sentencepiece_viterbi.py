"""SentencePiece encoding and decoding by streaming Viterbi.

A lattice over the characters: an edge for each piece, the best way to each
position kept with a pointer to where its last piece begins. No piece is longer
than ``max_len`` characters, so the pointers of the last ``max_len`` positions
are all that later ones can build on; once the ways of these survivors have a
boundary in common, the ids before it are committed and forgotten.

What "best" means follows the model. Unigram models: the highest sum of piece
scores (equal sums: the longer last piece). BPE models: of all ways the one
that byte-pair merging itself would take. That one is told piece by piece: a
sequence is the merge result exactly if each two neighbours in it are the merge
result of their own two strings, so one way alone survives at each position.
The ids equal those of the sentencepiece library, for both kinds.

Where no piece can cross (before a run of word marks, and around characters of
no longer piece), all ways meet by necessity; the text is cut there first and
short parts are remembered, since most parts of a corpus come again.

Edge cases: a null text counts as empty and an empty one has no ids; characters
outside the vocabulary become byte pieces (or the unknown id, without byte
pieces); decoding drops control ids, gives null for null ids, the mark
U+2047 for the unknown id and ids outside the vocabulary, and U+FFFD for bytes that are no UTF-8. A text that
holds the word mark U+2581 itself decodes to spaces there. Repeated rows and
null ids of documents are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm._common import free_name, kept, text_chunks, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: A model file is broadcast up to this size.
MAX_MODEL_BYTES = 64 << 20
PART_CHARS, PARTS, PAIRS = 48, 400_000, 400_000
#: Positions between two looks for a common boundary.
STRIDE = 64
#: Texts of about this size are encoded together.
TOGETHER = 6_000_000
#: The name under which a worker keeps the model, and the parts it has seen, for its next task.
KEPT = "pieces"


class PieceModel:
    """Vocabulary and search. ``kind`` is "bpe" or "unigram"."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, unk: int = 0,
                 byte_ids: dict[int, int] | None = None, control: Iterable[int] = (), dummy_prefix: bool = True):
        self.pieces, self.kind, self.unk, self.dummy_prefix = pieces, kind, unk, dummy_prefix
        self.byte_ids = byte_ids or {}
        special = {unk, *self.byte_ids.values(), *control}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = scores
        self.max_len = max(map(len, self.ids), default=1)
        self.unk_score = min((scores[i] for i in self.ids.values()), default=0.0) - 10
        longer = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        some = "[" + "".join(re.escape(c) for c in sorted(longer)) + "]" if longer else "(?!)"
        # without pieces that go on over a word mark, each run of marks begins a new part
        self.parts = re.compile(rf"(?:{MARK}|{some})+|[\s\S]" if inner else rf"{MARK}*{some}+|{MARK}+|[\s\S]")
        self.known = _Parts(self)
        self.pairs: dict[int, bool] = {}
        self.latest: tuple = ("", [0], [0], [0.0])
        self.lengths = _Lengths(self.ids)
        self.surface = [b"" if i in set(control) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.surface[unk] = " ⁇ ".encode()
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])

    @classmethod
    def load(cls, data: bytes) -> PieceModel:
        """From the bytes of a model file (identity normalisation, as the public vocabulary has)."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(data)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if m.trainer_spec.model_type not in (1, 2) or any(p.type == 4 for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        kinds = {i: p.type for i, p in enumerate(m.pieces)}
        return cls(
            [p.piece for p in m.pieces], [p.score for p in m.pieces], {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type],
            unk=next(i for i, k in kinds.items() if k == 2),
            byte_ids={int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6},
            control=[i for i, k in kinds.items() if k in (3, 5)], dummy_prefix=m.normalizer_spec.add_dummy_prefix)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as 32-bit numbers."""
        if not text:
            return np.zeros(0, np.int32)
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.parts.findall(text))), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; new parts are searched in order first, as neighbours begin alike."""
        mark = MARK if self.dummy_prefix else ""
        one: dict[str, str] = {}  # a part that comes again is held once
        split = [list(map(one.setdefault, x, x)) for x in (self.parts.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts)]
        here = {p for p in one if len(p) <= PART_CHARS}
        new = here - self.known.keys()
        if len(new) + len(self.known) > PARTS:  # those that these texts have too are the likeliest to come again
            kept = {p: self.known[p] for p in here & self.known.keys()}
            self.known.clear()
            self.known.update(kept)
        for p in sorted(new):
            self.known[p]
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.int32) for x in split]

    def decode(self, ids: Sequence[int]) -> str:
        ids = np.asarray(ids, np.int64)
        surface = self.surface
        known = np.where((ids < 0) | (ids >= len(surface)), self.unk, ids).tolist()
        text = b"".join([surface[i] for i in known]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def search(self, part: str) -> list[int]:
        """Ids of a part that no piece crosses the ends of, in a window of bounded length.

        What was found for the characters that this part has in common with
        the one before still holds, so parts are best searched in order.
        """
        out: list[int] = []
        base, n, far = 0, len(part), self.max_len
        # of position base + i: where its last piece begins, that piece's id, and the sum of scores
        before, back, piece, score = self.latest
        same = 0
        for x, y in zip(before, part):
            if x != y:
                break
            same += 1
        del back[same + 1:], piece[same + 1:], score[same + 1:]
        bpe, ids, scores, pairs, lengths = self.kind == "bpe", self.ids, self.scores, self.pairs, self.lengths
        for end in range(same + 1, n + 1):
            best, best_id, best_score = None, 0, 0.0
            for size in lengths[part[end - 3 if end > 3 else 0:end]]:
                begin = end - size
                if begin < 0:
                    continue
                i = ids.get(part[begin:end])
                if i is None:
                    continue
                if bpe:
                    if not begin:
                        best, best_id = begin, i
                        break
                    key = piece[begin - base] << 21 | i
                    apart = pairs.get(key)
                    if self._merge_apart(key, piece[begin - base], i) if apart is None else apart:
                        best, best_id = begin, i
                        break
                else:
                    s = score[begin - base] + scores[i]
                    if best is None or s > best_score:
                        best, best_id, best_score = begin, i, s
            if best is None or (not bpe and best < end - 1 and part[end - 1] not in ids):
                # a character by itself: a piece, or outside the vocabulary (numbered below zero)
                i = ids.get(part[end - 1], -1 - ord(part[end - 1]))
                s = 0.0 if bpe else score[end - 1 - base] + (scores[i] if i >= 0 else self.unk_score)
                if best is None or s > best_score:
                    best, best_id, best_score = end - 1, i, s
            back.append(best)
            piece.append(best_id)
            if not bpe:
                score.append(best_score)
            if end - base >= far + STRIDE:
                # later pieces begin at one of the last max_len positions: follow them to a common boundary
                ways = set(range(end - far + 1, end + 1))
                while len(ways) > 1:
                    last = max(ways)
                    ways.remove(last)
                    ways.add(back[last - base])
                meet = ways.pop()
                if meet > base:
                    out += self._trace(back, piece, base, meet)
                    del back[:meet - base], piece[:meet - base], score[:meet - base]
                    base = meet
        out += self._trace(back, piece, base, n)
        self.latest = (part, back, piece, score) if not base else ("", [0], [0], [0.0])
        return out

    def _trace(self, back: list, piece: list, base: int, end: int) -> list[int]:
        got: list[int] = []
        while end > base:
            i = piece[end - base]
            got += [i] if i >= 0 else self._bytes(i)[::-1]
            end = back[end - base]
        return got[::-1]

    def _bytes(self, i: int) -> list[int]:
        return [self.byte_ids[b] for b in chr(-1 - i).encode()] if len(self.byte_ids) == 256 else [self.unk]

    def _merge_apart(self, key: int, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces together gives just these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        both = [self.pieces[i] if i >= 0 else chr(-1 - i) for i in (left, right)]
        known = self.pairs[key] = self.merge(both[0] + both[1]) == both
        return known

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: the best pair first, the left one of equals."""
        s = list(text)
        while len(s) > 1:
            at, best = -1, 0.0
            for i in range(len(s) - 1):
                k = self.ids.get(s[i] + s[i + 1])
                if k is not None and (at < 0 or self.scores[k] > best):
                    at, best = i, self.scores[k]
            if at < 0:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s


class _Lengths(dict):
    """Lengths of the pieces that may end where these last (three, or fewer at the start) characters stand, the longest first."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self.by_end: dict[str, set[int]] = {}
        for p in ids:
            if len(p) > 2:
                self.by_end.setdefault(p[-3:], set()).add(len(p))

    def __missing__(self, end: str) -> tuple[int, ...]:
        if len(self) >= PAIRS:
            self.clear()
        short = [n for n in (2, 1) if n <= len(end) and end[-n:] in self.ids]
        got = self[end] = (*sorted(self.by_end.get(end, ()), reverse=True), *short)
        return got


class _Parts(dict):
    """Ids (as bytes) of parts seen before; a bounded number of short ones is kept."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, part: str) -> bytes:
        got = np.array(self.model.search(part), np.int32).tobytes()
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS:
                self.clear()
            self[part] = got
        return got

    def __reduce__(self):
        return _Parts, (self.model,)


def _model(data: bytes) -> PieceModel:
    return kept(KEPT, hash(data), lambda: PieceModel.load(data))


def _broadcast(spark: SparkSession, path: str | None):
    with open(path or tokenizer_path(MODEL), "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"the model file is larger than {MAX_MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``docs`` with all columns and a further one of ids (array of int); see :func:`free_name` for its name."""
    sent, out, text = _broadcast(docs.sparkSession, model_path), free_name(docs, ids_col), free_name(docs, "own_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for b in text_chunks(batches, text, TOGETHER, KEPT):
            ids = model.encode_all(b.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            columns = [c for name, c in zip(b.schema.names, b.columns) if name != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], schema_names)

    schema_names = [*docs.columns, out]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.withColumn(text, F.coalesce(docs[text_col].cast("string"), F.lit(""))).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``encoded`` with all columns and a further one of the decoded text."""
    sent, out = _broadcast(encoded.sparkSession, model_path), free_name(encoded, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for b in text_chunks(batches, ids_col, keep=KEPT):
            lists = b.column(ids_col)
            flat = pc.fill_null(lists.values, model.unk).to_numpy()
            ends = lists.offsets.to_numpy()
            texts = [model.decode(flat[i:j]) if ok else None for i, j, ok in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    names = [*encoded.columns, out]
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_ids``, ``ids_hash`` (XXH64 of the ids), ``decodes`` (the ids give the text back)."""
    slim = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    back = decode(encode(slim, model_path=model_path), model_path=model_path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                       (F.col("decoded") == F.col("text")).alias("decodes"))
