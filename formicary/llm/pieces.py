"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

A giant document is cut into chunks anywhere. What may stand at a cut is a boundary state: where the
token that reaches the cut ends, and which token it is. Each chunk gives the matrix of the best weights
from its entry states to its exit states; matrices are combined by the max-plus product, which is
associative; then the states chosen at the cuts let every chunk be traced back on its own.

Weights: a unigram model's are its scores. A BPE model's are 0 for a token that may follow another (the
two would come out of merging their joint text) and minus infinity otherwise; exactly one path through
a text has weight 0, and it is what merging the whole text gives. Where no piece crosses the start of a
word, all states meet there, so a chunk's matrix is that of its two broken words around an inside that
the library encodes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.llm.shared import arrow_map, materialize

#: Characters in a chunk; longer documents are giant.
CHUNK = 16_384
SPACE = "▁"
NONE = -np.inf

State = tuple[int, str]  # (end of the last token, that token; '' where it doesn't matter)


class PieceModel:
    """A SentencePiece file and its merging rules."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [k for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.ids = {sp.id_to_piece(k): k for k in normal}
        self.scores = {sp.id_to_piece(k): sp.get_score(k) for k in normal}
        self.longest = max(map(len, self.ids))
        self.words_apart = not any(SPACE in x.lstrip(SPACE) for x in self.ids)
        proto = sp.serialized_model_proto()
        self.merges = _model_type(proto) == 2
        self.pairs: dict[tuple[str, str], bool] = {}
        self.follow: dict[tuple[str, str], list[tuple[str, float]]] = {}
        self.bytes = [self._bytes(k) for k in range(sp.get_piece_size())]

    def _bytes(self, k: int) -> bytes:
        sp = self.library
        if sp.is_byte(k):
            return bytes([int(sp.id_to_piece(k)[3:5], 16)])
        if sp.is_control(k) or sp.is_unknown(k):
            return sp.decode([k]).encode()
        return sp.id_to_piece(k).replace(SPACE, " ").encode()

    def text_of(self, ids: list[int]) -> str:
        """The text of ids, as the library decodes them."""
        if not ids:
            return ""
        try:
            out = b"".join(map(self.bytes.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # byte pieces that are no text: the library knows what to put there
            return self.library.decode(ids)
        if not out.startswith(" ") or not self.library.id_to_piece(ids[0]).startswith(SPACE):
            return out if all(self.bytes[k] for k in ids[:1]) else self.library.decode(ids)
        return out[1:]

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text: the pair of best score first, of equals the leftmost."""
        out = list(text)
        while len(out) > 1:
            best = max(((self.scores[a + b], -k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                break
            k = -best[1]
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def weight(self, last: str, token: str) -> float:
        """Of a token after another ('' if anything may stand before)."""
        if not self.merges:
            return self.scores.get(token, min(self.scores.values()) - 10)
        key = (last, token)
        if key not in self.pairs:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = self.merged(token) == [token] if not last else self.merged(last + token) == [last, token]
        return 0.0 if self.pairs[key] else NONE

    def starts_word(self, text: str, at: int) -> bool:
        """Whether nothing crosses this place, whatever stands on either side."""
        return self.words_apart and 0 < at < len(text) and text[at] == SPACE and text[at - 1] != SPACE

    def tokens_at(self, text: str, at: int, end: int) -> Iterator[str]:
        yield text[at]
        for to in range(at + 2, min(at + self.longest, end) + 1):
            if text[at:to] in self.ids:
                yield text[at:to]

    def followers(self, last: str, text: str, at: int, end: int) -> list[tuple[str, float]]:
        """The tokens that may come here after another, with their weights; remembered by what the text goes on with."""
        key = (last, text[at : min(at + self.longest, end)])
        found = self.follow.get(key)
        if found is None:
            if len(self.follow) > 200_000:
                self.follow.clear()
            weighed = ((token, self.weight(last, token)) for token in self.tokens_at(text, at, end))
            found = self.follow[key] = [(token, w) for token, w in weighed if w != NONE]
        return found

    def states(self, text: str, cut: int) -> list[State]:
        """Every state that a path may have at the cut, given the characters around it."""
        if cut in (0, len(text)) or self.starts_word(text, cut):
            return [(cut, "")]
        found: list[State] = []
        for end in range(cut, min(cut + self.longest, len(text) + 1)):
            for start in range(max(0, end - self.longest), min(cut, end)):
                token = text[start:end]
                if end - start == 1 or token in self.ids:
                    state = (end, "" if end == len(text) or self.starts_word(text, end) else token)
                    if state not in found:
                        found.append(state)
            if self.starts_word(text, end) and end > cut:
                break
        return found

    def paths(self, text: str, entries: list[State], goal: int) -> dict[int, dict[str, np.ndarray]]:
        """Best weights from each entry to every (place, token) up to the states at the goal."""
        at: dict[int, dict[str, np.ndarray]] = {}
        for k, (place, token) in enumerate(entries):
            row = at.setdefault(place, {}).setdefault(token, np.full(len(entries), NONE))
            row[k] = 0.0
        place = min(at)
        while place < goal:
            for last, reached in at.get(place, {}).items():
                for token, w in self.followers(last, text, place, len(text)):
                    end = place + len(token)
                    name = "" if end == len(text) or self.starts_word(text, end) else token
                    row = at.setdefault(end, {})
                    row[name] = np.maximum(row[name], reached + w) if name in row else reached + w
            place += 1
        return at

    def trace(self, text: str, entry: State, exit_: State) -> list[str]:
        """The tokens of the best path between two states."""
        if entry[0] >= exit_[0]:
            return []
        best: dict[State, tuple[float, State | None, str]] = {entry: (0.0, None, "")}
        by_place: dict[int, list[State]] = {entry[0]: [entry]}
        for place in range(entry[0], exit_[0]):
            for state in by_place.get(place, ()):
                for token, w in self.followers(state[1], text, place, exit_[0]):
                    end = place + len(token)
                    to = (end, "" if end == len(text) or self.starts_word(text, end) else token)
                    if to not in best:
                        by_place.setdefault(end, []).append(to)
                        best[to] = (NONE, None, "")
                    if best[state][0] + w > best[to][0]:
                        best[to] = (best[state][0] + w, state, token)
        out, state = [], exit_
        while state != entry:
            _, state, token = best[state]
            out.append(token)
        return out[::-1]

    def _inside(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """First and last word start in the range, if the library can encode what lies between."""
        if not self.merges or not self.words_apart:
            return None
        first = next((k for k in range(start, end + 1) if self.starts_word(text, k)), None)
        if first is None:
            return None
        last = next(k for k in range(end, first - 1, -1) if self.starts_word(text, k))
        return first, last

    def transfer(self, text: str, start: int, end: int) -> np.ndarray:
        """Matrix of best weights from the states at start to those at end."""
        entries, exits = self.states(text, start), self.states(text, end)
        inside = self._inside(text, start, end)
        if inside and max(e[0] for e in entries) <= inside[0]:
            first = self.paths(text, entries, inside[0])[inside[0]][""]
            last = self.paths(text, [(inside[1], "")], end)
            return first[:, None] + np.array([last.get(p, {}).get(t, np.full(1, NONE))[0] for p, t in exits])[None, :]
        at = self.paths(text, entries, end)
        return np.stack([at.get(p, {}).get(t, np.full(len(entries), NONE)) for p, t in exits], axis=1)

    def tokens(self, text: str, start: int, end: int, entry: int, exit_: int) -> list[int]:
        """Ids of the tokens that end after the entry state, up to the exit state."""
        first, last = self.states(text, start)[entry], self.states(text, end)[exit_]
        inside = self._inside(text, first[0], end)
        if inside and last[0] >= inside[1]:
            between = text[inside[0] + 1 : inside[1]].replace(SPACE, " ")
            if self.library.normalize(between) == text[inside[0] : inside[1]] or inside[0] == inside[1]:
                middle = self.library.encode(between) if inside[0] < inside[1] else []
                return self.ids_of(self.trace(text, first, (inside[0], ""))) + middle + self.ids_of(self.trace(text, (inside[1], ""), last))
        return self.ids_of(self.trace(text, first, last))

    def ids_of(self, tokens: list[str]) -> list[int]:
        """Ids; a character without a piece falls back to its bytes, or to the unknown id."""
        out: list[int] = []
        for token in tokens:
            if token in self.ids:
                out.append(self.ids[token])
            else:
                known = [self.library.piece_to_id(f"<0x{b:02X}>") for b in token.encode()]
                out.extend(known if self.library.is_byte(known[0]) else [self.library.unk_id()])
        return out


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialized model: 1 unigram, 2 BPE."""

    def varint(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 0x80:
                return value, at

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0
        while at < len(data):
            tag, at = varint(data, at)
            if tag & 7 == 2:
                size, at = varint(data, at)
                yield tag >> 3, data[at : at + size]
                at += size
            elif tag & 7 == 0:
                value, at = varint(data, at)
                yield tag >> 3, value
            else:
                at += 4 if tag & 7 == 5 else 8

    trainer = next((v for n, v in fields(proto) if n == 2), b"")
    return next((v for n, v in fields(trainer) if n == 3), 1)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by a scan that halves its input at each level."""
    if len(matrices) == 1:
        return matrices
    pairs = prefixes([combine(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else combine(pairs[k // 2 - 1], matrices[k]))
    return out


def choose_states(matrices: list[np.ndarray]) -> list[int]:
    """The state of the best path at every cut, from the first to the last."""
    upto = prefixes(matrices)
    state = int(upto[-1][0].argmax())
    out = [state]
    for k in range(len(matrices) - 1, 0, -1):
        state = int((upto[k - 1][0] + matrices[k][:, state]).argmax())
        out.append(state)
    return [*out, 0][::-1]


# --- Spark ------------------------------------------------------------------------------------

_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def cuts_of(plain: str, chunk: int) -> list[int]:
    """The bounds of the chunks of a normalised text; one that came to nothing has one empty chunk."""
    return [*range(0, max(1, len(plain)), chunk), len(plain)]


def encode_chunked(model: PieceModel, text: str, chunk: int) -> list[int]:
    """A whole text by the scan, in one process (what the Spark operator does in many)."""
    plain = model.library.normalize(text)
    cuts = cuts_of(plain, chunk)
    spans = list(zip(cuts, cuts[1:], strict=False))
    states = choose_states([model.transfer(plain, a, b) for a, b in spans])
    return [x for (a, b), i, j in zip(spans, states, states[1:], strict=False) for x in model.tokens(plain, a, b, i, j)]


def _listed(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _small(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = piece_model(path).library
        for batch in batches:
            ids = [np.asarray(sp.encode_as_numpy(x), np.int32) if x else np.zeros(0, np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ones(len(ids), np.int32)), _listed(ids)], ["doc_id", "n_chunks", "ids"])

    return run


def _chunks(path: str, chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        row = (TaskContext.get().partitionId() << 33) - 1
        around = 2 * model.longest
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row += 1
                plain = model.library.normalize(text)
                cuts = cuts_of(plain, chunk)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    lo, hi = max(0, a - around), min(len(plain), b + around)
                    # a state depends on whether the text ends or begins there, so a window ends inside it only where that can't be seen
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (doc, pa.int64()), (k, pa.int32()), (len(cuts) - 1, pa.int32()), (plain[lo:hi], pa.string()), (a - lo, pa.int32()), (b - lo, pa.int32()))], ["row", "doc_id", "chunk", "n_chunks", "text", "start", "end"])

    return run


def _transfers(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            out = [pickle.dumps(model.transfer(t, a, b)) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(out, pa.binary())], ["row", "chunk", "matrix"])

    return run


def _documents(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows with one value in the first column, across batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _documents(batches, ["row", "chunk", "matrix"]):
        states = choose_states([pickle.loads(m) for _, _, m in rows])
        columns = zip(*((row, chunk, i, j) for (row, chunk, _), i, j in zip(rows, states, states[1:], strict=False)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["row", "chunk", "entry", "exit"])


def _trace(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "start", "end", "entry", "exit")]
            out = [np.array(model.tokens(*x), np.int32).tobytes() for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "chunk", "n_chunks")] + [pa.array(out, pa.binary())], ["row", "doc_id", "chunk", "n_chunks", "part"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _documents(batches, ["row", "chunk", "doc_id", "n_chunks", "part"]):
        ids = np.frombuffer(b"".join(r[4] for r in rows), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][2]], pa.int64()), pa.array([rows[0][3]], pa.int32()), _listed([ids])], ["doc_id", "n_chunks", "ids"])


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chunks, ids) for every row of docs: the ids that the library gives for the whole text.

    Texts of up to `chunk` characters are one chunk. Longer ones are dealt out by chunk, and only a
    document's boundary matrices, then its ids, come together. Nulls and empty texts have no ids; repeated rows
    are encoded each; other columns of docs are left out.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small = arrow_map(narrow.filter(F.length("text") <= chunk), _small(model), "doc_id long, n_chunks int, ids array<int>")
    cut = arrow_map(narrow.filter(F.length("text") > chunk), _chunks(model, chunk), "row long, doc_id long, chunk int, n_chunks int, text string, start int, end int")
    cut = materialize(cut, "chunks")
    matrices = arrow_map(cut.select("row", "chunk", "text", "start", "end").repartition("row", "chunk"), _transfers(model), "row long, chunk int, matrix binary")
    chosen = arrow_map(matrices.repartition("row").sortWithinPartitions("row", "chunk"), _choose, "row long, chunk int, entry int, exit int")
    parts = arrow_map(cut.join(chosen, ["row", "chunk"]), _trace(model), "row long, doc_id long, chunk int, n_chunks int, part binary")
    giant = arrow_map(parts.repartition("row").sortWithinPartitions("row", "chunk"), _assemble, "doc_id long, n_chunks int, ids array<int>")
    return small.union(giant)


def _decoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            texts = [model.text_of(x.values.to_numpy().tolist() if x.is_valid else []) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """`encoded` with the text of its `ids` as column `decoded`; null or no ids give the empty text."""
    from pyspark.sql.types import StringType, StructField, StructType

    kept = encoded.drop("decoded")
    return arrow_map(kept, _decoded(model), StructType([*kept.schema.fields, StructField("decoded", StringType())]))
